"""Queries that once took less than the whole of their input, on small tables of their own."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest

from cadenza.operators.layout import compact
from cadenza.plans import registry


def test_similarity_of_long_lines(spark, tmp_path):
    rng = random.Random(4)
    text = "\n".join("".join(rng.choice("abcdef ,") for _ in range(n)) for n in (5, 199, 200, 900, 900, 30, 1500))
    spark.createDataFrame([(1, text), (2, "alone"), (3, "a\n\nb")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.rec, r.ix): r for r in registry.QUERIES["ud3_similarity"](spark, str(tmp_path)).collect()}
    assert sorted(found) == [(1, k) for k in range(6)] + [(3, 0)]
    for k, (a, b) in enumerate(zip(text.split("\n"), text.split("\n")[1:], strict=False)):
        matcher = SequenceMatcher(None, compact(a), compact(b), autojunk=False)
        points = {(0, 0), (len(compact(a)), len(compact(b)))} | {p for m in matcher.get_matching_blocks() for p in ((m.a, m.b), (m.a + m.size, m.b + m.size))}
        assert found[1, k].ratio == matcher.ratio() and found[1, k].anchors == sorted(points)


def test_join_words_of_any_line(spark, tmp_path):
    text = "Wait , what ?! (yes)\n  Das kostet 3.5 % : «gut» …\n\n»Ja” ; nein !\n. , [a] 50%\nplain words, here."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.ix: r.text for r in registry.QUERIES["ag11_join_words"](spark, str(tmp_path)).collect()}
    assert found == dict(enumerate(["Wait, what?! (yes)", "Das kostet 3.5%: «gut»…", "»Ja”; nein!", "., [a] 50%", "plain words, here."]))


def events(spark, tmp_path, made):
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=at), user, "x", value, "{}") for k, (user, at, value) in enumerate(made)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))


def test_pairwise_mean_of_long_chains(spark, tmp_path):
    rng = random.Random(6)
    made = [(k % 7 % 4, rng.randrange(500), rng.random()) for k in range(60)] + [(9, 3, 0.5), (9, 4, None), (9, 5, 1.0)]
    events(spark, tmp_path, made)
    wanted = {}
    for _, _, user, value in sorted((at, k, user, value) for k, (user, at, value) in enumerate(made)):
        before = wanted.get(user)
        wanted[user] = value if before is None else before if value is None else (before + value) / 2
    found = {r.rec: r.probability for r in registry.QUERIES["ag10_pairwise_mean"](spark, str(tmp_path)).collect()}
    assert found == {user: None if value is None else pytest.approx(value, abs=1e-9) for user, value in wanted.items()}


def test_every_point_finds_its_first_holder(spark, tmp_path):
    rng = random.Random(7)
    made = [(k % 3, rng.randrange(3000), rng.choice((1.0, 5.0, 20.0, 300.0))) for k in range(300)] + [(5, 0, 1e4), *((5, k, 1.0) for k in range(1, 60)), (6, 0, 2.0), (6, 1, 1.0), (6, 2, 1.0)]
    events(spark, tmp_path, made)
    by = {}
    for at, _, user, value in sorted((at, k, user, value) for k, (user, at, value) in enumerate(made)):
        by.setdefault(user, []).append((at, at + value))
    wanted = {(u, k): next((j for j, (a, b) in enumerate(own) if a <= p < b), None) for u, own in by.items() for k, (_, p) in enumerate(own)}
    assert {(r.rec, r.ix): r.holder for r in registry.QUERIES["jn8_point_in_interval"](spark, str(tmp_path)).collect()} == wanted


def test_middles_behind_all_ends_have_no_row(spark, tmp_path):
    import duckdb

    from tests.conftest import rows

    events(spark, tmp_path, [(1, 0, 5.0), (1, 9, 0.0), (1, 2, 1.0), (2, 4, 0.0), (3, 0, 0.0), (3, 0, 7.0), (3, 8, 1.0)])
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = rows(registry.QUERIES["jn9_first_attribute"](spark, str(tmp_path)))
    assert found == rows(con.sql(registry.SQL["jn9_first_attribute"])) and len(found) == 1 + 5


def test_batches_over_the_cap_are_counted_whole(spark, tmp_path):
    made = [(k, "x", "en", "big" if k < 97 else "small", 1) for k in range(130)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["so11_batch_cap"](spark, str(tmp_path)).collect()
    assert sorted((r.source, r.n_files, r.too_many) for r in found) == [("big", 97, True), ("small", 33, False)]


def test_tokens_are_counted_where_they_are_cut(spark, tmp_path):
    """Rows of one id are one document, also without an id; neither tokens nor their counts are dealt."""
    import duckdb

    from tests.conftest import rows

    rng = random.Random(8)
    odd = [*"aБé9٣ß_'’-.,- \t\n  ²Ⅷ中'’A", "Wort", "word's", "x-y", "😀"]
    made = [(k % 90 if k % 9 else None, "".join(rng.choice(odd) for _ in range(rng.randrange(60)))) for k in range(200)] + [(500, None), (501, ""), (502, "... -"), (503, "Ab_ab-AB’ab " * 30_000)]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = registry.QUERIES["st4_tokens"](spark, str(tmp_path))
    assert rows(result) == rows(con.sql(registry.SQL["st4_tokens"])) and result.where("doc_id IN (500, 501, 502)").isEmpty()
    dealt = [x for x in result._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert dealt and all("hashpartitioning(doc_id#" in x and "token" not in x for x in dealt)
