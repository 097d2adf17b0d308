"""Layout of timed words as subtitle lines and cues: the steps that need a dynamic program, a fold or text alignment.

All run per recording (or sentence) with Arrow batches; a group is one recording's words. Everything else is a window (see intervals).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import blocks
from cadenza.functions.text import bound, join_glued
from cadenza.operators.reconcile import SIMILAR, compact, display_units, display_units_of  # noqa: F401  units are part of the layout

# Word lists of the layout rules (Russian) and their weights.
CONJUNCTIONS = ("а", "да", "и", "или", "либо", "но")
WEAK_ENDS = ("без", "в", "для", "до", "за", "из", "и", "к", "на", "над", "о", "об", "от", "по", "под", "при", "про", "с", "со", "у")
GOOD_ENDS = (",", ";", ":", "—")
SHORT_LINE = {1: 20, 2: 6}
ORPHAN = {1: 10, 2: 3}
WEAK_END, CONJUNCTION, PLAIN = 6, 1, 3
PAIR_GAP = 0.5
#: What is around a token.
AROUND = ".,!?…;:—-\"'«»“”’()[]{}"


@F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("x", T.ArrayType(T.LongType())), T.StructField("y", T.ArrayType(T.LongType()))]))
def _alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    ratios, xs, ys = [], [], []
    for x, y in zip(a, b, strict=True):
        x, y = compact(x or ""), compact(y or "")
        found = blocks.matching_blocks(x, y)
        ratios.append(blocks.ratio(found, x, y))
        points = sorted({(0, 0), (len(x), len(y)), *((i, j) for i, j, _ in found), *((i + n, j + n) for i, j, n in found)})
        xs.append([i for i, _ in points])
        ys.append([j for _, j in points])
    return pd.DataFrame({"ratio": ratios, "x": xs, "y": ys})


def alignment(a: str, b: str) -> Column:
    """Of the compact forms: ratio, the share of characters in longest matching blocks; anchors, the ends of all blocks and of the texts."""
    made = _alignment(a, b)
    anchors = F.zip_with(made["x"], made["y"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.struct(made["ratio"].alias("ratio"), anchors.alias("anchors"))


def join_units(words: list[str]) -> str:
    out = ""
    for word in words:
        out += word if not out or out.endswith("-") else " " + word
    return out


def plain(token: str) -> str:
    """A token as the word lists have it."""
    return token.casefold().strip(AROUND)


def line_breaks(words: list[str], width: int, gap: int) -> list[int]:
    """Ends of the lines of one sentence: fewest lines, then least penalty, overflow and raggedness; the earliest on a tie.

    A unit may hold several tokens (a dash and a word), and one that ends in a hyphen makes one token with the next: lines are judged
    by the tokens of their text.
    """
    if all(w[-1:] != "-" and w.split() == [w] for w in words):
        return _plain_line_breaks(words, width, gap)
    first = [plain(w) for w in words]
    best: list[tuple | None] = [(0, 0, 0, 0)] + [None] * len(words)
    came = [0] * (len(words) + 1)
    for start in range(len(words)):
        lines, penalty, over, ragged = best[start]
        text = ""
        for end in range(start + 1, len(words) + 1):
            text = words[start] if end == start + 1 else text + ("" if text.endswith("-") else " ") + words[end - 1]
            size = len(text)
            if size > width + gap and end > start + 1:
                break
            tokens = text.split()
            cost = SHORT_LINE.get(len(tokens), 0)
            if end < len(words):
                if tokens and plain(tokens[-1]) in WEAK_ENDS:
                    cost += WEAK_END
                elif not text.rstrip().endswith(GOOD_ENDS):
                    cost += CONJUNCTION if first[end] in CONJUNCTIONS else PLAIN
            rank = (lines + 1, penalty + cost, over + max(0, size - width), ragged + size * size)
            if best[end] is None or rank < best[end]:
                best[end], came[end] = rank, start
    return _way(came)


def _plain_line_breaks(words: list[str], width: int, gap: int) -> list[int]:
    """`line_breaks` of units that are one token each: what a line's end costs depends on the words around it only."""
    n, sizes, first = len(words), [len(w) for w in words], [plain(w) for w in words]
    tails = [0] * (n + 1)
    for end in range(1, n):
        if first[end - 1] in WEAK_ENDS:
            tails[end] = WEAK_END
        elif not words[end - 1].endswith(GOOD_ENDS):
            tails[end] = CONJUNCTION if first[end] in CONJUNCTIONS else PLAIN
    best: list[tuple | None] = [(0, 0, 0, 0)] + [None] * n
    came = [0] * (n + 1)
    for start in range(n):
        lines, penalty, over, ragged = best[start]
        size = -1
        for end in range(start + 1, n + 1):
            size += sizes[end - 1] + 1
            if size > width + gap and end > start + 1:
                break
            known, count = best[end], end - start
            if known is None or known[0] > lines:
                cost = penalty + tails[end] + (SHORT_LINE.get(count, 0) if count < 3 else 0)
                rank = (lines + 1, cost, over + size - width if size > width else over, ragged + size * size)
                if known is None or rank < known:
                    best[end], came[end] = rank, start
    return _way(came)


def _way(came: list[int]) -> list[int]:
    """Ends of the parts that lead to the last state."""
    ends, at = [], len(came) - 1
    while at:
        ends.append(at)
        at = came[at]
    return ends[::-1]


def _taken(ends: Column, items: Column) -> Column:
    """The runs of ``items`` that end at ``ends``."""
    return F.transform(ends, lambda end, k: F.slice(items, F.coalesce(F.get(ends, k - 1), F.lit(0)) + 1, end - F.coalesce(F.get(ends, k - 1), F.lit(0))))


def _spans(parts: Column) -> Column:
    """(start, end, texts) of runs of (start, end, text)."""
    return F.transform(parts, lambda p: F.struct(p[0]["start"].alias("start"), F.array_max(F.transform(p, lambda w: w["end"])).alias("end"), F.transform(p, lambda w: w["text"]).alias("texts")))


def _in_turn(*columns: str) -> Column:
    """A group's rows as an array, in order of the first column."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


def pack_lines(words: DataFrame, width: int = 42, gap: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words (rec, sentence, ix, start, end, text) to lines (rec, sentence, line, start, end, text, n_words, sentence_end); ``keep`` names columns that a recording has one value of.

    A sentence is a row, so that a long recording is no task of its own; words that are already dealt by recording stay where they are.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def breaks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda own: line_breaks(list(own), width, gap))

    rows = words.groupBy("rec", "sentence").agg(_in_turn("ix", "start", "end", "text").alias("_w"), *[F.first(c).alias(c) for c in keep])
    rows = rows.withColumn("_cuts", breaks(F.col("_w.text")))
    lines = rows.select("rec", "sentence", *keep, F.posexplode(_spans(_taken(F.col("_cuts"), F.col("_w")))).alias("line", "_l"), F.size("_cuts").alias("_n"))
    return lines.select(
        "rec", "sentence", F.col("line").cast("long").alias("line"), "_l.start", "_l.end", join_glued(F.col("_l.texts")).alias("text"),
        F.size("_l.texts").cast("long").alias("n_words"), (F.col("line") == F.col("_n") - 1).alias("sentence_end"), *keep,
    )


def cue_breaks(starts: list[float], ends: list[float], sentences: list[int], sizes: list[int], max_lines: int, pause: float) -> list[int]:
    """Ends of the cues: fewest cues, then fewest short single lines and sentence crossings, single lines late; the earliest on a tie."""
    best: list[tuple | None] = [(0, 0, 0, 0)] + [None] * len(starts)
    came = [0] * (len(starts) + 1)
    for start in range(len(starts)):
        if best[start] is None:
            continue
        cues, orphans, crossings, single = best[start]
        for end in range(start + 1, min(start + max_lines, len(starts)) + 1):
            last = end - 1
            if last > start and sentences[last] != sentences[last - 1] and starts[last] - ends[last - 1] >= min(pause, PAIR_GAP):
                continue
            alone = end == start + 1
            rank = (cues + 1, orphans + (ORPHAN.get(sizes[start], 0) if alone else 0), crossings + (sentences[start] != sentences[last]), single - (start if alone else 0))
            if best[end] is None or rank < best[end]:
                best[end], came[end] = rank, start
    return _way(came)


def group_cues(lines: DataFrame, max_lines: int = 2, pause: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines (rec, sentence, line, start, end, text) to cues (rec, ix, start, end, cue_text) of one or two lines.

    Where a pause parts two sentences, no cue goes across, and as ranks are sums, the lines between such places are grouped by
    themselves: these runs are rows, not the recordings. ``keep`` is as in `pack_lines`.
    """
    if max_lines not in (1, 2):
        raise ValueError("a cue has one line or two")
    w = Window.partitionBy("rec").orderBy("sentence", "line")
    apart = (F.col("sentence") != F.lag("sentence").over(w)) & (F.col("start") - F.lag("end").over(w) >= min(pause, PAIR_GAP))
    rows = lines.withColumns({"_ix": F.row_number().over(w), "_new": F.coalesce(apart, F.lit(False)).cast("int")}).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def breaks(starts: pd.Series, ends: pd.Series, sentences: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([cue_breaks(list(a), list(b), list(s), list(n), max_lines, pause) for a, b, s, n in zip(starts, ends, sentences, sizes, strict=True)])

    rows = rows.withColumn("_tokens", F.size(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")))
    runs = rows.groupBy("rec", "_run").agg(_in_turn("_ix", "start", "end", "text", "sentence", "_tokens").alias("_l"), *[F.first(c).alias(c) for c in keep])
    runs = runs.withColumn("_cuts", breaks(*[F.col(f"_l.{c}") for c in ("start", "end", "sentence", "_tokens")]))
    cues = runs.select("rec", "_run", *keep, F.posexplode(_spans(_taken(F.col("_cuts"), F.col("_l")))).alias("_k", "_c"))
    ix = (F.row_number().over(Window.partitionBy("rec").orderBy("_run", "_k")) - 1).cast("long")
    return cues.select("rec", ix.alias("ix"), "_c.start", "_c.end", F.array_join("_c.texts", "\n").alias("cue_text"), *keep)


def _fold(df: DataFrame, needs: tuple[str, ...], judge: Callable, made: dict[str, pa.DataType], schema: str | T.StructType | None = None) -> DataFrame:
    """Per recording, in order of ix: ``judge()`` gives a function of the columns ``needs`` of a row, which gives values for the columns ``made``, or None to drop it.

    Rows are dealt by recording, sorted, and stream by in batches; nothing is held but what the function keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            kept, new = [], []
            for k, (rec, *row) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("rec", *needs)], strict=True)):
                if step is None or rec != at:
                    at, step = rec, judge()
                values = step(*row)
                if values is not None:
                    kept.append(k)
                    new.append(values)
            if kept:
                out = batch if len(kept) == batch.num_rows else batch.take(pa.array(kept, pa.int32()))
                columns = dict(zip(out.schema.names, out.columns, strict=True))
                columns |= {c: pa.array(values, kind, from_pandas=True) for (c, kind), values in zip(made.items(), zip(*new, strict=True), strict=True)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.repartition("rec").sortWithinPartitions("rec", "ix").mapInArrow(run, schema or df.schema)


def _missing(x: float | None) -> bool:
    return x is None or x != x


def drop_boundary_repeats(words: DataFrame) -> DataFrame:
    """Words that overlap the last accepted one and say the same are dropped; others that overlap begin at its end."""

    def judge():
        last, said = None, None

        def step(start: float | None, end: float | None, text: str) -> tuple | None:
            nonlocal last, said
            text = text.casefold()
            if not _missing(last) and not _missing(start) and start < last:
                if text == said or not _missing(end) and end <= last:
                    return None
                start = last
            last, said = end, text
            return (start,)

        return step

    return _fold(words, ("start", "end", "text"), judge, {"start": pa.float64()})


def fill_and_sweep(words: DataFrame, least: float = 0.001) -> DataFrame:
    """A missing start is the last accepted end, a missing end ``least`` after the start; what can't move forward is dropped."""

    def judge():
        last = 0.0

        def step(start: float | None, stop: float | None, text: str) -> tuple | None:
            nonlocal last
            start = last if _missing(start) else max(start, last)
            stop = start + least if _missing(stop) else stop
            if not (stop > start and str(text).strip()):
                return None
            last = stop
            return start, stop

        return step

    return _fold(words, ("start", "end", "text"), judge, {"start": pa.float64(), "end": pa.float64()})


def greedy_groups(words: DataFrame, longest: float) -> DataFrame:
    """With group: a new one whenever the time from its first start would exceed ``longest``."""

    def judge():
        first, group = None, -1

        def step(start: float, end: float) -> tuple:
            nonlocal first, group
            if first is None or end - first > longest:
                first, group = start, group + 1
            return (group,)

        return step

    return _fold(words, ("start", "end"), judge, {"group": pa.int64()}, ", ".join(f"`{n}` {t}" for n, t in [*words.dtypes, ("group", "bigint")]))


def merged_probabilities(rows: DataFrame) -> DataFrame:
    """(rec, ix, probability) to (rec, probability): pairwise means in order of ix, so that of three the last counts half; null ones count for nothing.

    The k-th from the end weighs 2^-k, the first as much as the second: weighted sums, and no recording in one place.
    """
    known = rows.where(F.col("probability").isNotNull())
    w = Window.partitionBy("rec")
    placed = known.withColumns({"_k": F.row_number().over(w.orderBy(F.desc("ix"))), "_n": F.count("*").over(w)})
    weight = F.pow(F.lit(0.5), F.least("_k", F.col("_n") - 1).cast("double"))
    made = placed.groupBy("rec").agg(F.sum(F.col("probability") * weight).alias("probability"))
    return rows.select("rec").distinct().join(made, "rec", "left")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cut_greedily(text: Column, most: Column) -> Column:
    """Parts of a text of at most ``most`` characters, each up to the last space or hyphen that fits; null where none fits or a part is blank.

    The text is cut at every space and hyphen once; only the lengths of the pieces are gone through, and what is left is never copied.
    """

    def step(acc: Column, size: Column) -> Column:
        new = (acc["k"] == 0) | (acc["used"] + size > most)
        starts = F.when(new, F.array_append(acc["starts"], acc["k"])).otherwise(acc["starts"])
        return F.struct(F.when(new, size).otherwise(acc["used"] + size).alias("used"), starts.alias("starts"), (acc["k"] + 1).alias("k"))

    def joined(pieces: Column, starts: Column) -> Column:
        return F.transform(starts, lambda a, i: _stripped(F.array_join(F.slice(pieces, a + 1, F.coalesce(F.get(starts, i + 1), F.size(pieces)) - a), "")))

    def parts(pieces: Column) -> Column:
        state = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("k"))
        starts = F.aggregate(F.transform(pieces, F.length), state, step, lambda acc: acc["starts"])
        return F.when(~F.exists(pieces, lambda x: F.length(x) > most), bound(starts, lambda at: bound(joined(pieces, at), whole)))

    def whole(made: Column) -> Column:
        return F.when(~F.exists(F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0))), lambda x: x == ""), F.filter(made, lambda x: x != ""))

    return bound(F.regexp_extract_all(text, F.lit("[^ -]*+[ -]|[^ -]++"), F.lit(0)), parts)


def split_capacity(word: Column, most: int = 50) -> Column:
    """Parts of at most ``most`` characters, cut at the last space, else behind the last hyphen; the whole word where that can't be; null for null.

    One pattern goes through the word once: the end if it fits, else up to a space, else up to a hyphen, else all that is left, which is then too long.
    """
    ways = [rf".{{1,{most}}}+\z", rf".{{1,{most}}}(?= )", *([rf".{{1,{most - 1}}}-"] if most > 1 else []), ".+"]
    piece = F.lit(rf"(?sU)\G\s*+({'|'.join(ways)})")

    def parts(text: Column) -> Column:
        return bound(F.regexp_extract_all(text, piece, F.lit(1)), lambda p: F.when(F.length(F.get(p, F.size(p) - 1)) > most, F.array(text)).otherwise(F.transform(p, _stripped)))

    return bound(F.when(word.isNotNull(), _stripped(word)), lambda text: F.when(text.isNotNull(), parts(text)))
