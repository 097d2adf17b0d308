"""The training-data operators against brute force, on a small table that holds every edge case, and on empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import ann, media, mixing, ngram_join, packing, quality, sharding, sitetree, suffix_dedup, warc
from cadenza.llm.components import components
from cadenza.llm.entries import QUERIES, SQL
from tests.conftest import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, did long, token string, site string"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def texts():
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    passage = " ".join(words(40, 2))
    out = [None, "", "  \n", "one two", "One  two\n", "a b c d e", " ".join(base), " ".join(near), " ".join(base).upper(), " ".join(base[:118]), "é ü ß " * 60, "line of words again and again, over and over.\n" * 30]
    out += [" ".join(words(50, k)) + " " + passage + " " + " ".join(words(30, -k)) for k in range(3, 9)]
    out += [" ".join(words(4000, 99)), "x" * 700, " ".join(base), "ab" * 400]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    made = [(k, t, "en" if k % 2 else None, None if k % 7 == 0 else f"s{k % 3}", len(t or ""), 1, 2, "t", "x") for k, t in enumerate(texts())]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(docs):
    """With null ids and repeated rows."""
    return docs.unionByName(docs.where("doc_id in (6, 12)")).unionByName(docs.where("doc_id in (7, 13)").withColumn("doc_id", F.lit(None).cast("long")))


def by_id(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_packing(docs):
    tokenizer = packing.load_tokenizer()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for key, text in by_id(docs).items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[key], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(part.tobytes()), part.tolist())
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        size = sum(r.length for r in own)
        assert size <= 4096 and size & (size - 1) == 0
        assert sorted(r.offset for r in own) == [sum(x.length for x in own if x.offset < r.offset) for r in sorted(own, key=lambda r: r.offset)]


def test_plan_covers_everything_once():
    r = random.Random(1)
    for _ in range(30):
        lengths = [r.choice([0, 1, 5, 900, 1024, 2048, 3000, 4096, 9001]) for _ in range(r.randrange(1, 40))]
        seen = Counter()
        for window in packing.plan(lengths):
            assert sum(n for _, _, n in window).bit_count() == 1
            seen.update((doc, at + k) for doc, at, n in window for k in range(n))
        assert seen == Counter((doc, k) for doc, n in enumerate(lengths) for k in range(n))


def test_media(docs):
    for r in media.text_media(docs, with_media=True).collect():
        body = by_id(docs)[r.doc_id].encode()
        payload = body + bytes(-len(body) % 64 or (0 if body else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.decode(r.media).tobytes() == payload and r.media_sha256 == hashlib.sha256(r.media).hexdigest()


def test_image_formats():
    grey = np.arange(48, dtype=np.uint8).reshape(6, 8)
    for data in (media.to_pgm(grey), media.to_bmp(grey), b"P2\n# c\n8 6\n255\n" + b" ".join(b"%d" % x for x in grey.ravel())):
        assert (media.decode(data)[:, :, 0] == grey).all()
    assert media.decode(b"P1\n2 2\n1 0 0 1\n")[:, :, 0].tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n2 2\n\x80\x40")[:, :, 0].tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P6 1 1 65535 " + bytes(range(6)))[0, 0].tolist() == [1, 0x0203, 0x0405]
    resized = media.area_resize(grey[:, :, None].astype(float), 4, 3)[:, :, 0]
    fine = np.kron(grey, np.ones((4, 3)))  # 24 x 24: divisible by both
    assert np.allclose(resized, fine.reshape(4, 6, 3, 8).mean((1, 3)))
    with pytest.raises(ValueError):
        media.decode(b"nothing")


def test_tiles(spark):
    images = spark.createDataFrame([(1, bytearray(media.to_pgm(np.zeros((5, 7), np.uint8)))), (2, bytearray(b"bad")), (3, None)], "id long, content binary")
    found = media.tiles(images, "id", "content", tile=4).collect()
    assert sorted((r.id, r.tile_row, r.tile_col) for r in found if r.npy) == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]
    assert {r.id for r in found if r.npy is None} == {2, 3}


def test_sharding_loads_and_moves(spark, odd):
    table = {r.slot: r.shard for r in sharding.lookup_table(spark, 5, 503).collect()}
    assert sorted(table) == list(range(503)) and max(Counter(table.values()).values()) - min(Counter(table.values()).values()) <= 1
    assert sharding.place(odd, "doc_id", shards=5).count() == odd.count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    assert rows(QUERIES[name](spark, sf_dir)) == rows(duck.sql(SQL[name]))


def test_mixing(odd):
    found = mixing.schedule(odd).collect()
    assert len(found) == odd.count()
    for target in {r.target for r in found}:
        own = [r for r in found if r.target == target]
        assert sum(r.taken for r in own) in {int(target) * k for k in range(1, 5)} or abs(sum(r.taken for r in own) - target) < 1
    assert all(r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0) for r in found)
    assert mixing.take(odd).columns == odd.columns


def brute_components(by, threshold=80):
    sets = {}
    for key, text in by.items():
        w = text.encode().lower().split()
        k = min(5, len(w))
        sets[key] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_ngram_join(docs, odd):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(docs).collect()} == brute_components(by_id(docs))
    assert ngram_join.similar(odd).count() == odd.count()


def test_ngram_join_of_many_near_copies(spark):
    """A cloud of copies with growing distance, small sets, and a passage that all share."""
    r = random.Random(8)
    base, passage = words(60, 50), words(30, 51)
    made = {}
    for k in range(60):
        own = base[:]
        for _ in range(k // 12):
            own[r.randrange(60)] = f"w{k}"
        made[k] = " ".join(own)
    for k in range(60, 100):
        made[k] = " ".join(words(25, k) + passage)
    for k in range(100, 130):
        made[k] = " ".join(words(7 + k % 5, 1000 + k // 6))
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar(df).collect()} == brute_components(made)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 60), (60, 70), (80, 80)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {k: 0 for k in range(31)} | {50: 50, 60: 50, 70: 50}


def brute_removals(ordered, depth=100):
    seen, out = set(), []
    for text in ordered:
        body = text.encode()
        gone = bytearray(len(body))
        for k in range(len(body) - depth + 1):
            window = body[k : k + depth]
            if window in seen:
                gone[k : k + depth] = b"\1" * depth
            seen.add(window)
        spans = sum(1 for k in range(len(body)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(body), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(body, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup(docs, odd):
    by = by_id(docs)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removals(docs).collect()}
    assert found == dict(zip(sorted(by), brute_removals([by[k] for k in sorted(by)])))
    ordered = sorted(odd.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or ""))
    found = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removals(odd).collect()]
    assert Counter(found) == Counter(brute_removals([r.text or "" for r in ordered]))
    assert suffix_dedup.dedup(docs).columns == docs.columns


def test_ann(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(300, 8)), np.repeat(r.normal(size=(1, 8)), 60, 0)]).astype(np.float32)
    made = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0]), (None, [1.0] * 8), (1004, [None] * 8)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    found = defaultdict(dict)
    for row in ann.search(df, F.col("id") % 10 == 0).collect():
        found[row.query_id][row.rank] = (row.vec_id, row.score)
    assert set(found) == set(range(0, 360, 10))
    hits = 0
    for q, own in found.items():
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        true = [k for k in np.lexsort((np.arange(len(x)), far)) if k != q][:10]
        hits += len(set(true) & {v for v, _ in own.values()})
        assert sorted(own) == list(range(1, 11)) and all(score == far[v] for v, score in own.values())
        assert [own[k][::-1] for k in range(1, 11)] == sorted(v[::-1] for v in own.values())
    assert hits >= 0.9 * 10 * len(found)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="page"><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>First {n}<br>line</b> <p>Sec<i>ond</i> {n}</p><div class="reader-comments">Nice</div><div id="x">Always here</div></article><footer>&copy;</footer></body></html>"""


def test_sitetree(spark):
    made = [(k, "https://H.example/p", PAGE.format(n=k)) for k in range(12)] + [(20, None, "<p>Only &lt;text&gt;"), (21, "bad", None), (22, "http://e/x", "<div class='cookie'>no"), (23, "http://e/x", "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>")]
    found = {r.page_id: r for r in sitetree.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert found[3].text == "First 3 line Second 3"  # what all twelve pages share goes
    assert [found[k].text for k in (20, 21, 22, 23)] == ["Only <text>", "", "", "a b c d"]
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://e/x", "<html lang=de><title>A</title><p>x &amp; y<a href='/z'>z</a>"), (2, None, None)], "page_id long, url string, html string")
    records = warc.responses(pages)
    found = {(r.page_id, r.record_type): r for r in warc.derive(records, "page_id", "content").collect()}
    assert len(found) == 4
    source = {r.page_id: warc.parse(bytes(r.content)) for r in records.collect()}
    for (page, kind), r in found.items():
        headers = dict(source[page][1])
        assert r.refers_to == headers["WARC-Record-ID"] and r.source_block_digest == headers["WARC-Block-Digest"] and r.target_uri == headers.get("WARC-Target-URI")
        first, own, block = warc.parse(bytes(r.record))
        assert first == "WARC/1.0" and dict(own)["WARC-Type"] == kind and dict(own)["WARC-Block-Digest"] == warc.digest(block) and block.decode() == r.block
    assert found[1, "conversion"].block == "x & yz" and '"links": ["http://e/z"]' in found[1, "metadata"].block
    bad = spark.createDataFrame([(1, bytearray(b"no record")), (2, None)], "id long, content binary")
    assert warc.derive(bad, "id", "content").count() == 0


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 3 > 0")
    scored = quality.score(docs, quality.fit(docs, seen)).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in scored]) > 0.95
    assert np.mean([(r.toxic_score >= 0.5) == (r.toxic == 1) for r in scored]) > 0.9


def test_quality_without_labels(odd, spark):
    none = spark.createDataFrame([(1, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, none)
    assert all(r.keep for r in quality.score(odd, model).collect())
    assert quality.kept(odd, none).count() == odd.count()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for made in (packing.pack(none), media.text_media(none), sharding.place(none, "doc_id"), mixing.schedule(none), mixing.take(none), ngram_join.similar(none), suffix_dedup.removals(none), suffix_dedup.dedup(none)):
        assert made.count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 2 == 0).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert sitetree.extract(pages).count() == 0 and warc.derive(warc.responses(pages), "page_id", "content").count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.kept(none, labels).count() == 0 and quality.score(none, quality.fit(none, labels)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        before = by_id(now)
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        after = by_id(now)
        if k == 1:
            assert set(after) == {d for d, (n, c) in brute_components(before).items() if c == d or not n}
        if k == 2:
            gone = {d: r for d, r in zip(sorted(before), brute_removals([before[d] for d in sorted(before)]))}
            assert all(len(t.encode()) <= gone[d][0] - gone[d][1] for d, t in after.items())
    assert p.run(spark, str(tmp_path)).count() > 0
