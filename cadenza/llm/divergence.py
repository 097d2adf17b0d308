"""Source divergence audit: how far the sources of a language are apart in their terms, on distinct count columns.

A term is a run of letters (ASCII, lower-cased) and other non-ASCII characters. A language keeps the terms that at least `LEAST_DOCS`
of its documents have. Every source of a language gives each kept term a smoothed share in billionths, and so does the whole language;
two shares p and q are floor((p - q)^2 / (p + q)) apart.

* A kept term's column is its count in each source that has it. Terms with the same column in a language are one vector with a
  multiplicity: what two sources are apart in it is worked out once and multiplied.
* Sources without a term give it the share of count 0, which is the same for all terms. A pair's sum over all kept terms is therefore
  that of two such shares times the terms, plus corrections for what each source has (by its distinct counts), plus a correction for
  each vector that both have; so that a vector costs the pairs of the sources that have it, and not of all sources.
* Terms are counted by group within each task first, and then by Spark; per vector and pair, sums are pre-aggregated too. Sums and shares
  are whole numbers, in decimals where counts are multiplied.

A language has one row for each two of its sources, as the result asks for: sources must not be many thousands, vectors hold one entry
for each. Kept terms and documents may be any number.

Edge cases: null texts, languages and sources are empty ones; a source without kept terms takes part with shares of count 0; a language
without kept terms has sums 0 and no term rows; ties go to the item that is less in UTF-8; repeated rows are separate documents; an empty
table gives no rows; columns beyond the three named are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import discard, table, written

LEAST_DOCS = 10
#: Ranks of the term part.
TOP = 10
#: Shares are in these parts of one; what is added to every count.
PARTS, ADDED = 1_000_000_000, 2
#: Terms that a task counts together at most.
HELD = 1 << 18

#: Bytes to bytes: letters in lower case and bytes of non-ASCII characters stay, all others are blanks.
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and how many of its documents have it; a term '' for every group."""
    chosen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    names = ["lang", "source", "term", "n", "docs"]

    def rows(held: dict) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for (lang, source), (counts, having) in held.items():
            many = len(counts) + 1
            for col, values in zip(cols, ([lang] * many, [source] * many, ["", *(t.decode() for t in counts)], [0, *counts.values()], [0, *(having[t] for t in counts)]), strict=True):
                col += values
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names)

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = text.as_py().translate(_FOLD).split()
                counts, having = held.setdefault((lang, source), (Counter(), Counter()))
                counts.update(terms)
                having.update(set(terms))
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    counted = chosen.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS * (count + ADDED) / (total + ADDED * kept)); null where nothing is kept."""
    return _div(F.lit(PARTS).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)"), F.nullif(total + ADDED * kept, F.lit(0))) + 1


def apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _sources(counts: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, kept, whole, p0): one row a group; kept and whole are the language's terms and their occurrences."""
    groups = counts.where("term = ''").select("lang", "source")
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = groups.join(totals, ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("whole")), "lang", "left")
    found = found.fillna(0, ["total", "kept", "whole"])
    return found.withColumn("p0", share(F.lit(0), F.col("total"), F.col("kept")))


def vectors(rows: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, p, p0) to (lang, column, many): the distinct columns, as arrays of (source, n, p, p0), and how many terms have each."""
    column = F.array_sort(F.collect_list(F.struct("source", "n", "p", "p0"))).alias("column")
    return rows.groupBy("lang", "term").agg(column).groupBy("lang", "column").agg(F.count("*").alias("many"))


def _pair_sums(columns: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, a, b, value) with a before b: what two sources are apart in all kept terms."""
    a = sources.select("lang", F.col("source").alias("a"), "kept", F.col("p0").alias("a0"))
    b = sources.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    base = a.join(b, "lang").where("a < b").select("lang", "a", "b", F.coalesce(F.col("kept") * apart(F.col("a0"), F.col("b0")), F.lit(0)).alias("value"))
    entries = columns.select("lang", "many", F.explode("column").alias("x")).select("lang", "many", "x.*")
    own = entries.groupBy("lang", "source", "n", "p", "p0").agg(F.sum("many").alias("many"))
    one = own.join(b, "lang").where("source != b").select(
        "lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"),
        (F.col("many") * (apart(F.col("p"), F.col("b0")) - apart(F.col("p0"), F.col("b0")))).alias("value"),
    )
    both = columns.select("lang", "many", "column", F.explode("column").alias("x")).select("lang", "many", "x", F.explode(F.filter("column", lambda y: y["source"] > F.col("x.source"))).alias("y"))
    p, p0, q, q0 = (F.col(c) for c in ("x.p", "x.p0", "y.p", "y.p0"))
    both = both.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), (F.col("many") * (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))).alias("value"))
    return base.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each other source of the language is, and the terms that a source has more of than its language."""
    counts = written(term_counts(docs, lang_col, source_col, text_col))
    of_lang = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    kept = written(of_lang.select("lang", "term", "all"))
    plain = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all")
    sources = written(_sources(counts, plain, kept))
    rows = written(plain.join(sources, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))))
    columns = written(vectors(rows))
    sums = written(_pair_sums(columns, sources))
    discard(counts, columns)
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    q = share(F.col("all"), F.col("whole"), F.col("kept"))
    terms = rows.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order)
    pairs = pairs.withColumn("rank", ranked).withColumn("part", F.lit("pair"))
    terms = terms.withColumn("rank", ranked).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH chosen AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
found AS (SELECT r, lang, source, unnest(terms) AS term FROM chosen),
kept AS (SELECT lang, term, count(*) AS total FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
grp AS (SELECT DISTINCT lang, source FROM chosen),
cells AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS n_all,
         sum(k.total) OVER (PARTITION BY g.lang, g.source) AS l_all, count(*) OVER (PARTITION BY g.lang, g.source) AS v
  FROM grp g JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (n_all + 2 * v))::HUGEINT AS p, (1 + (1000000000::HUGEINT * (total + 2)) // (l_all + 2 * v))::HUGEINT AS q FROM dense),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= 10
"""
