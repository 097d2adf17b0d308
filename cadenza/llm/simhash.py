"""SimHash near-duplicates: fingerprints met in an index of bytes by position, filtered by how many of these they share.

A fingerprint has 64 bits; a bit is 1 if more than half of the hashes of the text's word shingles have it. Fingerprints that differ
in at most `BITS` = 4 bits differ in at most four of their eight bytes, so they share at least `SHARED` = 4 bytes at their positions.

* The index posts every distinct fingerprint once for each of 20 sets of three positions, with the bytes that it has there. The sets
  are chosen so that any four positions contain one of them (20 is the least number for which that can be done). Lists of one byte
  would hold a 256th of all fingerprints, whose pairs grow with the square of the table; lists of three hold a 2^24th.
* A list of more than `LONG` fingerprints is split by a fourth byte, which every pair that we look for shares as well.
* In a list, the bytes that two fingerprints share are tallied; pairs with fewer than `SHARED` are dropped, the others verified by
  their differing bits.

Near copies of one text have many fingerprints that are all close to each other, and their pairs are not needed: rounds follow each
other. Lists with no more than `CENTRES` fingerprints outside of their largest component are compared whole and are done; in longer
ones, each fingerprint outside is compared with so many of the list, and what links joins a component. Then `CENTRES` is raised to its
next power, so that in the end each list has been compared whole, but for pairs within a component. Documents meet the index only by
their fingerprint: copies are one entry.

Edge cases: null, empty and blank texts have fingerprint 0 and link like others; fewer than four words make one shingle; repeated rows
are separate documents of one fingerprint; a null id takes part and gets its component's smallest non-null id; ids keep their type; an
empty table gives no rows; only the named id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import discard, table, written
from cadenza.llm.components import components

WORDS = 4
SEED = 42
#: Bits that linked fingerprints may differ in, and bytes that they share then.
BITS, SHARED = 4, 4
#: Lists with more fingerprints are split by a fourth byte.
LONG = 64
#: Fingerprints outside a list's largest component that a list compared whole has at most in the first round; in the next ones, powers of it.
CENTRES = 8
#: Bytes of text that are split into words at once.
CHUNK = 1 << 20
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def _words(body: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part."""
    at = 0
    while len(body) - at > CHUNK:
        cut = max(body.rfind(s, at, at + CHUNK) for s in _SPACES)
        if cut < at:  # a word longer than a part
            cut = min((x for x in (body.find(s, at + CHUNK) for s in _SPACES) if x >= 0), default=len(body))
        yield body[at:cut].split()
        at = cut + 1
    yield body[at:].split()


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits that more than half of the shingles' hashes have; 0 without words."""
    counts, n, last = np.zeros((8, 256), np.int64), 0, []
    for part in _words(text.lower()):
        own = last + part
        k = len(own) - words + 1
        if k > 0:
            joined = b" ".join(own)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            starts = np.concatenate([[0], ends[: k - 1]]).tolist()
            digest = xxhash.xxh64_intdigest
            hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)
            counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
            n += k
        last = own[max(0, k) :]
    if not n and last:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED)
    ones = (counts @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def covering() -> list[tuple[int, ...]]:
    """20 sets of three of eight positions, of which any four positions contain one: three in one group, or two and one of the next group."""
    groups = ({0, 1, 2}, {3, 4, 5}, {6, 7})
    split = [tuple(len(g.intersection(c)) for g in groups) for c in combinations(range(8), 3)]
    return [c for c, n in zip(combinations(range(8), 3), split, strict=True) if 3 in n or any(n[k] == 2 and n[(k + 1) % 3] == 1 for k in range(3))]


def _byte(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))


def _mask(positions: tuple[int, ...]) -> int:
    return sum(1 << k for k in positions)


def _token(fp: Column, positions: tuple[int, ...]) -> Column:
    """The positions and the bytes there, as one number."""
    out = F.lit(_mask(positions)).cast("long")
    for k in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(fp, k))
    return out


def shared_bytes(a: Column, b: Column) -> Column:
    differ = a.bitwiseXOR(b)
    return sum(((_byte(differ, k) == 0).cast("int") for k in range(1, 8)), (_byte(differ, 0) == 0).cast("int"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): the fingerprint as a signed number."""
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return chosen.mapInArrow(run, f"id {chosen.schema[0].dataType.simpleString()}, fp long")


def _index(entries: DataFrame) -> DataFrame:
    """(token, fp) of all lists that have at least two fingerprints; long ones are split."""
    fp = F.col("fp")
    posted = entries.select(F.explode(F.array(*[_token(fp, c) for c in covering()])).alias("token"), "fp")
    rows = written(posted.join(posted.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "token"))
    mask = F.shiftright("token", 24)
    deeper = [F.when(mask.bitwiseAND(F.lit(_mask(c))) == mask, _token(fp, c)) for c in combinations(range(8), SHARED)]
    split = rows.where(F.col("size") > LONG).select(F.explode(F.array_compact(F.array(*deeper))).alias("token"), "fp").distinct()
    out = written(rows.where(F.col("size") <= LONG).select("token", "fp").unionByName(split))
    discard(rows)
    return out


def _mixed(rows: DataFrame, labels: DataFrame | None, centres: int) -> DataFrame:
    """Rows of lists that join different components: each with its component, whether that is the list's largest, and whether the list is short."""
    named = rows.select("token", "fp")
    if labels is None:
        named = named.withColumn("component", F.col("fp"))
    else:
        named = named.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    parts = named.groupBy("token", "component").count()
    most = F.max_by("component", F.struct("count", "component")).alias("major")
    lists = parts.groupBy("token").agg(most, F.max("count").alias("largest"), F.sum("count").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    lists = lists.select("token", "major", (F.col("size") - F.col("largest") <= centres).alias("short"))
    return written(named.join(lists, "token").select("token", "fp", "component", (F.col("component") == F.col("major")).alias("inside"), "short"))


def _near(bits: int) -> Column:
    """Different components, enough shared bytes, and few differing bits."""
    a, b = F.col("fp"), F.col("fp_b")
    return (F.col("component") != F.col("component_b")) & (shared_bytes(a, b) >= SHARED) & (F.bit_count(a.bitwiseXOR(b)) <= bits)


def _other(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("token", F.col("fp").alias("fp_b"), F.col("component").alias("component_b"), *[F.col(c).alias(f"{c}_b") for c in more])


def _pairs(mixed: DataFrame, bits: int, turn: int, centres: int) -> DataFrame:
    """Links (a, b) found in one round, each once."""
    short, long = mixed.where("short"), mixed.where("not short")
    whole = short.where("not inside").join(_other(short, "inside"), "token").where(_near(bits) & (F.col("inside_b") | (F.col("fp") < F.col("fp_b"))))
    chance = F.xxhash64("fp", "token", F.lit(turn))
    one = F.min_by(F.struct("fp", "component"), chance).alias("one")
    chosen = long.groupBy("token", F.pmod(chance, F.lit(centres))).agg(one).select("token", "one.*")
    star = long.where("not inside").join(_other(chosen), "token").where(_near(bits))
    found = whole.select("fp", "fp_b").unionByName(star.select("fp", "fp_b"))
    return found.select(F.least("fp", "fp_b").alias("a"), F.greatest("fp", "fp_b").alias("b")).distinct()


def _components(live: DataFrame, bits: int) -> DataFrame:
    """(node, component) of the fingerprints that have a link."""
    links, rows, before, labels, turn = [], live, None, None, 0
    while True:
        centres = CENTRES ** (turn + 1)
        mixed = _mixed(rows, labels, centres)
        new = written(_pairs(mixed, bits, turn, centres))
        if before is not None:
            discard(before)
        rows, before = mixed.where("not short"), mixed
        if labels is None or not new.isEmpty():
            links.append(new)
            if labels is not None:
                discard(labels)
            every = links[0]
            for more in links[1:]:
                every = every.unionByName(more)
            labels = components(every)
        else:
            discard(new)
        if rows.isEmpty():
            discard(before, *links)
            return labels
        turn += 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits) and component_id, the smallest id that links lead to. ``bits`` is at most 4."""
    if not 0 <= bits <= 8 - SHARED:
        raise ValueError(f"fingerprints that differ in more than {8 - SHARED} bits need not share {SHARED} bytes")
    found = written(fingerprints(docs, id_col, text_col, words))
    entries = written(found.groupBy("fp").agg(F.min("id").alias("least")))
    live = _index(entries)
    labels = _components(live, bits)
    discard(live)
    named = entries.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    joined = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("least").alias("joined"))
    own = written(named.join(joined, "component", "left").select("fp", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("joined")).alias("component_id")))
    discard(labels, entries)
    return found.join(own, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
