"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through their first `DEPTH` bytes only; suffixes that are equal so far begin with the same repeated window. The
order is made by most-significant-digit passes, and after each pass the groups that can't hold a repeat are dropped:

1. Of each window, the first digit is its k-byte string with the least hash. Neighbouring windows share it, so that one row stands
   for a run of windows, about a 35th of all bytes. Strings that occur once drop out: their windows are new.
2. The second digit is the run's whole byte range. In a group of equal ranges all but the first run are repeats, window by window.
   A group with one range only is done.
3. What is left - the first run of each range where ranges differ, which is where passages begin and end - is told apart by the
   windows themselves.

Equal windows have the same least string, so that no pass parts them. Digits are hashes, as a row with the bytes would take several
times the input: a range counts as equal if 64 bits of its string and 64 bits of the whole are, a window if `CHECK` bits of a second
hash with another root are too. Tasks combine their own
rows before each exchange: later rows of a group are known to be repeats there and then, and a string with many ranges sends on one
row that says so, so that a passage in every document gives each exchange a few rows per task.

Edge cases: null and empty texts, and those under `DEPTH` bytes, have no windows and lose nothing; rows whose id is null or repeated
are taken as different documents, in order of id (null last), then text; an empty table gives no rows; only named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import numbered, table, unused, written
from cadenza.llm.features import ROOT, mix, powers

DEPTH = 100
GRAM = 32
#: Windows of a text that are hashed at once, rows that a task combines before it sends them on, ranges of a string that it sends.
BLOCK, COMBINED, RANGES = 1 << 19, 1 << 19, 16
#: Bits of the second hash, and of a window's place in its text (so that a text may have 256 GB).
CHECK, PLACE = 8, 38

FIRST, MANY, REPEAT, OPEN = range(4)
OTHER_ROOT = 0xD1B54A32D192ED03


class Hasher:
    """Hashes of any part of a block of bytes."""

    def __init__(self, raw: np.ndarray, root: int = ROOT):
        up, self.down = powers(len(raw) + 1, root)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])

    def __call__(self, starts, ends) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: from running minima of blocks, forwards and backwards."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def runs(body: bytes, depth: int = DEPTH, gram: int = GRAM):
    """Runs of windows with the same least string at the same place, block by block: string, range (hashes), first and last window."""
    raw = np.frombuffer(body, np.uint8)
    for at in range(0, len(raw) - depth + 1, BLOCK):
        part = raw[at : at + BLOCK + depth - 1]
        hasher = Hasher(part)
        grams = hasher.every(gram)
        least = sliding_min(grams, depth - gram + 1)
        # a run also ends with the window that its string begins: so no two windows of a run are equal
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        yield least[first], hasher(first, last + depth), first + at, last + at


def _changes(*cols: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _batch(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64, copy=False)) for c in cols], names)


# A row's place: first window, how many follow it in the run, and kind, in one number (the run's length is under 256).
_RUN = ["gram", "span", "did", "place"]
_WINDOW = ["window", "did", "place"]
_MARK = ["did", "lo", "hi", "kind"]
_KIND = "place & 3"
_LONGS = lambda names: ", ".join(f"{n} long" for n in names)


def _place(lo: np.ndarray, hi: np.ndarray, kind) -> np.ndarray:
    return lo << 10 | (hi - lo) << 2 | kind


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = place >> 10
    return lo, lo + (place >> 2 & 255), place & 3


def _combine_runs(gram, span, did, lo, hi) -> pa.RecordBatch:
    order = np.lexsort((lo, did, span, gram))
    gram, span, did, lo, hi = (x[order] for x in (gram, span, did, lo, hi))
    new = _changes(gram, span)
    group = np.cumsum(_changes(gram)) - 1
    many = (np.bincount(group, new) > RANGES)[group]
    place = _place(lo, hi, np.where(new, np.where(many, OPEN, FIRST), REPEAT))
    says = many & _changes(gram)  # one row a group that says that it has many ranges
    cols = [np.concatenate([x, y]) for x, y in ((gram, gram[says]), (span, span[says]), (did, did[says]), (place, place[says] & ~3 | MANY))]
    return _batch(_RUN, *cols)


def _ranges(batches):
    """Passes 1 and 2 over batches in order of string, kind, range, document and place: rows of (did, lo, hi, kind).

    Of a string that goes on in the next batch, only its last range is carried on, whether it has several, and, while it has not, its
    first row, of which it is not known yet whether it stays.
    """
    gram = span = first = None  # of the string that may go on; first is (did, lo, hi) while one range has been seen
    for batch in batches:
        if not batch.num_rows:
            continue
        g, s, did, place = (batch.column(k).to_numpy() for k in range(4))
        lo, hi, kind = _unplace(place)
        passed = kind > MANY  # dealt by themselves: known already
        out = [(did[passed], lo[passed], hi[passed], kind[passed])]
        g, s, did, lo, hi, plain = (x[~passed] for x in (g, s, did, lo, hi, kind == FIRST))
        if len(g):
            goes_on = g[0] == gram
            starts = _changes(g)
            starts[0] = not goes_on
            new = _changes(g, s) & plain
            new[0] = plain[0] and not (goes_on and s[0] == span)
            group = np.cumsum(starts) - starts[0]  # the string that goes on is group 0
            ranges = np.bincount(group, new) + 2 * np.bincount(group, ~plain)
            if goes_on:
                ranges[0] += 2 if first is None else 1
                if first is not None and ranges[0] > 1:
                    out.append((*([np.array([x]) for x in first]), np.array([OPEN])))
            several = ranges[group] > 1
            keep = plain & (~new | several)
            out.append((did[keep], lo[keep], hi[keep], np.where(new, OPEN, REPEAT)[keep]))
            if ranges[-1] > 1:
                first = None
            elif not (goes_on and group[-1] == 0):
                k = np.flatnonzero(starts)[-1]
                first = did[k], lo[k], hi[k]
            gram, span = g[-1], s[-1]
        yield _batch(_MARK, *(np.concatenate(c) for c in zip(*out, strict=True)))


def _marks(docs: DataFrame, depth: int, gram: int) -> DataFrame:
    """Passes 1 and 2: (did, lo, hi, kind) of runs that repeat, and of those that are still open."""

    def send(batches):
        kept, n = [], 0
        for batch in batches:
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = text.as_py()
                for g, s, lo, hi in runs(body, depth, gram):
                    kept.append((g, s, np.full(len(g), did), lo, hi))
                    n += len(g)
                    if n >= COMBINED:
                        yield _combine_runs(*(np.concatenate(c) for c in zip(*kept, strict=True)))
                        kept, n = [], 0
        if kept:
            yield _combine_runs(*(np.concatenate(c) for c in zip(*kept, strict=True)))

    sent = docs.mapInArrow(send, _LONGS(_RUN)).repartition(F.expr(f"if({_KIND} <= {MANY}, gram, xxhash64(did, place))"))
    return sent.sortWithinPartitions("gram", F.expr(_KIND), "span", "did", "place").mapInArrow(_ranges, _LONGS(_MARK))


def _open_windows(docs: DataFrame, marks: DataFrame, depth: int) -> DataFrame:
    """Pass 3: (did, lo, hi) of windows, in open runs, that begin earlier too; lo and hi are equal."""
    todo = written(marks.where(f"kind = {OPEN}").groupBy("did").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")))

    def combine(kept):
        window, check, did, lo = (np.concatenate(c) for c in zip(*kept, strict=True))
        order = np.lexsort((lo, did, check, window))
        window, check, did, lo = (x[order] for x in (window, check, did, lo))
        return _batch(_WINDOW, window, did, (check << PLACE | lo) << 2 | np.where(_changes(window, check), FIRST, REPEAT))

    def send(batches):
        kept, n = [], 0
        for batch in batches:
            for did, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = np.frombuffer(text.as_py(), np.uint8)
                spans = sorted((x["lo"], x["hi"]) for x in spans.as_py())
                while spans:  # open runs of one block are hashed together
                    at = spans[0][0]
                    here = [x for x in spans if x[1] < at + BLOCK]
                    spans = spans[len(here) :]
                    part = raw[at : here[-1][1] + depth]
                    lo = np.concatenate([np.arange(a, b + 1) for a, b in here])
                    check = Hasher(part, OTHER_ROOT)(lo - at, lo - at + depth) >> np.uint64(64 - CHECK)
                    kept.append((Hasher(part)(lo - at, lo - at + depth), check.astype(np.int64), np.full(len(lo), did), lo))
                    n += len(lo)
                    if n >= COMBINED:
                        yield combine(kept)
                        kept, n = [], 0
        if kept:
            yield combine(kept)

    def sort_out(batches):
        before = None  # the last window that no task had seen before
        for batch in batches:
            window, did, place = (batch.column(k).to_numpy() for k in range(3))
            check, lo = place >> 2 + PLACE, place >> 2 & (1 << PLACE) - 1
            again = (place & 3) == REPEAT
            fresh = np.flatnonzero(~again)
            if len(fresh):
                same = ~_changes(window[fresh], check[fresh])
                same[0] = (window[fresh[0]], check[fresh[0]]) == before
                again[fresh] = same
                before = window[fresh[-1]], check[fresh[-1]]
            yield _batch(["did", "lo", "hi"], did[again], lo[again], lo[again])

    opened = docs.join(todo, "did").select("did", "body", "runs")
    sent = opened.mapInArrow(send, _LONGS(_WINDOW)).repartition(F.expr(f"if({_KIND} = {FIRST}, window, xxhash64(did, place))"))
    return sent.sortWithinPartitions("window", F.expr(_KIND), F.expr(f"shiftright(place, {2 + PLACE})"), "did", "place").mapInArrow(sort_out, _LONGS(["did", "lo", "hi"]))


def _merged(spans, depth: int) -> list[tuple[int, int]]:
    """First and last windows to the byte runs that they cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + depth)
        else:
            out.append([lo, hi + depth])
    return out


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """did, body and the document's columns; did orders the documents. And its id: from did where that is the id, so that both joins read one exchange of the texts."""
    number = unused(docs, "did")
    rows, is_id = numbered(docs, id_col, text_col, number)
    key = F.col("did").cast(docs.schema[id_col].dataType) if is_id else F.col(f"doc.`{id_col}`")
    rows = rows.select(F.col(number).alias("did"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows, key


def repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(did, body) to (did, spans): the windows (lo to hi) that also begin earlier."""
    if not gram <= depth < gram + 256:
        raise ValueError(f"a string has {gram} to {gram + 255} bytes: a run's length is held in 8 bits")
    marks = written(_marks(docs.select("did", "body"), depth, gram))
    windows = _open_windows(docs.select("did", "body"), marks, depth)
    spans = marks.where(f"kind = {REPEAT}").select("did", "lo", "hi").unionByName(windows)
    return spans.groupBy("did").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, key = _numbered(docs.select(id_col, text_col), id_col, text_col)
    joined = rows.join(repeats(rows, depth), "did", "left").select(key.alias("key"), "body", "spans")

    def make(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                body, gone, kept = cut(text.as_py(), found.as_py(), depth)
                rows.append((len(body), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(make, f"`{id_col}` {joined.schema[0].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(body: bytes, spans: list | None, depth: int = DEPTH) -> tuple[bytes, list, bytes]:
    """The text, the byte runs to remove, and what remains."""
    gone = _merged(((x["lo"], x["hi"]) for x in spans or ()), depth)
    ends = [0, *(x for span in gone for x in span), len(body)]
    return body, gone, b"".join(body[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if gone else body


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """The documents without their repeated strings; those of which only white space is left are dropped.

    Characters that a cut leaves in part are left out.
    """
    rows, _ = _numbered(docs, id_col, text_col)
    text = F.col(f"doc.`{text_col}`")
    joined = rows.select("did", "doc").join(repeats(rows, depth), "did", "left")

    @F.pandas_udf("string")
    def remaining(bodies, spans):
        return bodies.combine(spans, lambda body, found: cut(body, None if found is None else [{"lo": x["lo"], "hi": x["hi"]} for x in found], depth)[2].decode("utf-8", "ignore"))

    kept = joined.withColumn("kept", F.when(F.col("spans").isNull(), text).otherwise(remaining(F.coalesce(text, F.lit("")).cast("binary"), "spans")))
    kept = kept.where(F.col("spans").isNull() | (F.trim(F.regexp_replace("kept", r"\s+", " ")) != ""))
    return kept.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
