"""Training-data operators that once took less than the whole of their input, on small tables of their own."""

import math

from pyspark.sql import functions as F

from cadenza.llm import mixing, quality, sitetree


def test_mix_spreads_passes_and_cuts_the_last(spark):
    """Two sources, the second wanted three times over: its passes follow each other, and taken words equal the targets."""
    made = [(k, " ".join(f"w{k}x{j}" for j in range(1 + k % 7)), "a") for k in range(90)] + [(k, f" \t{k}a  {k}b\n{k}c ", "b") for k in range(100, 120)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    for weights in ((1, 9), (2, 1), (3, 2)):
        plan = {r.doc_id: r for r in mixing.passes(docs, weights=weights).collect()}
        mix = mixing.take(docs, weights=weights).collect()
        assert [r.doc_id for r in mix] == [d for _, _, d in sorted((x.position, k, d) for d, r in plan.items() for k, x in enumerate(r.passes))]
        for source in "ab":
            own = [r for r in mix if r.source == source]
            assert sum(len(r.text.split()) for r in own) == math.floor(next(plan[r.doc_id].target for r in own))
            ids = [r.doc_id for r in own]
            size = len({d for d, _, s in made if s == source})
            assert all(ids[k] == ids[k - size] for k in range(size, len(ids)))  # a pass ends before the next begins
            whole = {d: t for d, t, _ in made}
            assert all(r.text == whole[r.doc_id] for r in own[:-1]) and whole[ids[-1]].lstrip().startswith(own[-1].text.lstrip())
        u = {s: sorted(x.position for r in mix for x in plan[r.doc_id].passes if r.source == s) for s in "ab"}
        assert all(0 <= x[0] and x[-1] <= 1 for x in u.values())


def test_class_words_do_not_take_the_article():
    def text(body):
        return sitetree.main_text(f"<html><body>{body}</body></html>", None)

    for open_, close in (("div class='content has-sidebar'", "div"), ("article class='post tag-social comment-open'", "article"), ("section id='related-work'", "section"), ("article class='share'", "article"), ("div class='no-comments with-nav'", "div"), ("div class='widget'", "div")):
        assert text(f"<{open_}><p>One two.</p><p>Three.</p></{close}>") == "One two. Three."
    assert text("<div class='sidebar'><article><p>Text.</p><div class='share-buttons'>Share</div></article></div><p>Else</p>") == "Text."
    assert text("<div class='cookie-banner'>We bake</div><div id='related-posts'>More</div><div class='post-footer'>Foot</div><div class='x'>Text.</div>") == "Text."


def test_copies_of_a_page_count_once(spark):
    def page(body):
        return f"<html><body><article>{body}</article></body></html>"

    many = page("<p>The page that has many copies.</p><p>It says so.</p>")
    made = [(k, "http://h/c", many) for k in range(300)]
    made += [(1000 + k, "http://h/o", page(f"<p>Paragraph {k} of its own page.</p><p>And {k} more.</p><ul><li>Point {k}</ul>")) for k in range(12)]
    found = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert found[0] == "The page that has many copies. It says so."
    assert all(found[1000 + k] == f"Paragraph {k} of its own page. And {k} more. Point {k}" for k in range(12))
    assert sitetree.main_text(page("<p>" + "Much text. " * 30 + "</p><ul><li>Point</ul>"), ["/html/body/article/p"]).startswith("Much text.")


def test_rare_labels_are_all_in_the_sample(spark):
    """15 toxic documents of 9,000, all labelled: at most 6,000 can be used."""
    made = [(k, f"poison bile {k} " * 3 if k % 600 == 7 else f"honest words {k % 90} here", "en", "web") for k in range(9000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 600 == 7).cast("int").alias("toxic"))
    wanted = quality._wanted(docs, labels, "doc_id").collect()
    assert len(wanted) <= quality.LABELLED and sum(r.toxic == 1 for r in wanted) == 15
    assert round(sum(r.stands_for for r in wanted)) == 9000
    model = quality.fit(docs, labels)
    assert model["toxic"] is not None
    assert math.isclose(model["toxic"]["prior"], math.log(15 / 8985), abs_tol=0.5)
