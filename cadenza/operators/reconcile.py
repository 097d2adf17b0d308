"""Recognised text and timed words of a segment, brought together.

A segment is a row: start, end, text, and its words as an array of (start, end, text, probability). Steps that need the order of marks
or a text alignment are small Arrow functions over segments; the others are Column expressions or windows. Nothing is grouped: a
segment is at most a few minutes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import blocks
from cadenza.functions import text as t
from cadenza.functions.text import AMBIGUOUS_QUOTES, CLOSING, HYPHEN_PARTICLES, OPENING, TERMINAL
from cadenza.operators.intervals import before, in_order, upto

# When text and words say the same, and what a leading island is.
SIMILAR = 0.72
ISLAND_WORDS, ISLAND_CHARS, ISLAND_GAP, RIGHT_WORDS, SURER, NEAR_START = 2, 12, 3.0, 4, 0.05, 0.25

WORD = "struct<start:double,end:double,text:string,probability:double>"

_SUFFIX = re.compile(r"-(?:" + "|".join(HYPHEN_PARTICLES) + r")\W*", re.I)
_GLUED = re.compile(r"([.!?…][\"'»”’)]*)(?=[A-ZА-ЯЁ«“\"(\[])")


def compact(text: str) -> str:
    folded = text.casefold().replace("ё", "е")
    return folded if folded.isalnum() else "".join(filter(str.isalnum, folded))


def separated(text: str) -> list[str]:
    """Tokens between white space, where glued sentences count as apart."""
    return _GLUED.sub(r"\1 ", " ".join(text.split())).split()


def closes(token: str) -> bool:
    """Closing marks only; quotes that may open as well count beside a mark that ends a sentence."""
    only = all(c in CLOSING for c in token)
    return bool(token) and (only or all(c in CLOSING + AMBIGUOUS_QUOTES for c in token) and any(c in TERMINAL for c in token))


def in_front(marks: list[str], word: str = "") -> str:
    """Marks before a word: dashes stand apart, others touch what follows."""
    out = ""
    for mark in marks:
        out += (" " if mark == "—" and out and not out.endswith(" ") else "") + (mark + " " if mark == "—" else mark)
    return (out + word).rstrip()


def attach(tokens: list[str], glue: bool = False) -> list[tuple[str, list[int], list[int]]]:
    """Units of display as (text, positions of marks in front, positions of all its tokens).

    Dashes and opening marks wait for a word; closing marks wait with them, else join the unit before, else are a unit. A particle with
    its hyphen joins the unit before, unless a dash waits. With ``glue``, so does what follows a unit that ends in a hyphen. Marks
    that no word follows join the last unit behind a space.
    """
    out: list[tuple[str, list[int], list[int]]] = []
    waiting: list[tuple[str, int]] = []

    def join(k: int, token: str) -> None:
        text, front, own = out[-1]
        out[-1] = text + token, front, [*own, k]

    for k, token in enumerate(tokens):
        if token[:1].isalnum() and not waiting:  # most are: no mark, no particle, no dash
            if glue and out and out[-1][0].endswith("-"):
                join(k, token)
            else:
                out.append((token.rstrip(), [], [k]))
            continue
        token = "—" if token == "-" else token
        if token == "—" or token and all(c in OPENING for c in token) or closes(token) and waiting:
            waiting.append((token, k))
        elif closes(token) and out:
            join(k, token)
        elif _SUFFIX.fullmatch(token) and not any(mark == "—" for mark, _ in waiting):
            if out:
                join(k, token)
            else:
                out.append((token, [], [k]))
        else:
            token = "— " + token[1:] if token.startswith("-") and len(token) > 1 else token
            if glue and out and not waiting and out[-1][0].endswith("-"):
                join(k, token)
                continue
            front = [at for _, at in waiting]
            out.append((in_front([mark for mark, _ in waiting], token), front, [k, *front]))
            waiting = []
    if waiting:
        text, at = in_front([mark for mark, _ in waiting]), [k for _, k in waiting]
        if out:
            out[-1] = f"{out[-1][0]} {text}", out[-1][1], [*out[-1][2], *at]
        else:
            out.append((text, at, at))
    return out


def display_units(text: str) -> list[str]:
    return [unit for unit, _, _ in attach(separated(text))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def display_units_of(text: pd.Series) -> pd.Series:
    return text.fillna("").map(display_units)


def shares(start: float, end: float, weights: list[int]) -> list[tuple[float, float]]:
    """Consecutive parts of an interval by weight; the last end is exact."""
    cuts = [start + (end - start) * at / max(1, sum(weights)) for at in accumulate(weights, initial=0)]
    return list(zip(cuts[:-1], [*cuts[1:-1], end], strict=True)) if weights else []


def mean(values: list) -> float | None:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def tidy_words(words: list[dict]) -> list[dict]:
    """Words of an aligner as units of display: glued sentences parted by weight, marks attached, probabilities averaged."""
    apart = []
    for w in words:
        said = w["text"]
        if said.isalnum():
            apart.append(w)
            continue
        parts = _GLUED.sub(r"\1 ", said).split()
        if len(parts) < 2:
            apart.append(w)
            continue
        spans = shares(w["start"], w["end"], [max(1, len(compact(p))) for p in parts])
        apart += [w | {"start": a, "end": b, "text": p} for p, (a, b) in zip(parts, spans, strict=True)]
    out = []
    for text, front, own in attach([" ".join(w["text"].split()) for w in apart], glue=True):
        if len(own) == 1 and not front:
            w = apart[own[0]]
            out.append({"start": w["start"], "end": w["end"], "text": text, "probability": w["probability"]})
            continue
        start = min(apart[k]["start"] for k in front or own[:1])
        out.append({"start": start, "end": max(apart[k]["end"] for k in own), "text": text, "probability": mean([apart[k]["probability"] for k in own])})
    return out


def spread_text(start: float, end: float, text: str) -> list[dict]:
    """Units of a text without words: the segment's time by letters and digits."""
    units = display_units(text)
    spans = shares(start, end, [max(1, len(compact(u))) for u in units])
    return [{"start": a, "end": b, "text": u, "probability": None} for u, (a, b) in zip(units, spans, strict=True)]


class Aligned:
    """Where the characters of a text stand among those of timed words, and when."""

    def __init__(self, source: str, words: list[dict], letters: list[str], found: list[tuple[int, int, int]] | None = None):
        """``letters`` are those of the words; ``found``, the blocks of the source and them, if known."""
        self.words, lengths = words, [len(x) for x in letters]
        self.ends = list(accumulate(lengths))
        self.lexical = [k for k, n in enumerate(lengths) if n]
        self.stops = [self.ends[k] for k in self.lexical]
        target = "".join(letters)
        points = {(0, 0), (len(source), len(target))}
        for i, j, size in blocks.matching_blocks(source, target) if found is None else found:
            points |= {(i, j), (i + size, j + size)}
        self.x, self.y = zip(*sorted(points), strict=True)

    def place(self, at: float) -> float:
        """Linear between the anchors around ``at``."""
        k = bisect_left(self.x, at, 1)
        if k == len(self.x):
            return self.y[-1]
        width = self.x[k] - self.x[k - 1]
        return self.y[k] if width <= 0 else self.y[k - 1] + (at - self.x[k - 1]) / width * (self.y[k] - self.y[k - 1])

    def time(self, at: float, is_end: bool) -> float:
        if not self.lexical:
            return self.words[-1]["end"] if is_end else self.words[0]["start"]
        if at <= 0:
            return self.words[self.lexical[0]]["start"]
        if at >= self.stops[-1]:
            return self.words[self.lexical[-1]]["end"]
        k = bisect_right(self.stops, at)
        if is_end and k and math.isclose(at, self.stops[k - 1]):
            k -= 1
        elif not is_end and math.isclose(at, self.stops[k]) and k + 1 < len(self.stops):
            return self.words[self.lexical[k + 1]]["start"]
        word, begin = self.words[self.lexical[k]], self.stops[k - 1] if k else 0
        return word["start"] + min(1.0, max(0.0, (at - begin) / (self.stops[k] - begin))) * (word["end"] - word["start"])

    def probability(self, at: float) -> float | None:
        k = bisect_left(self.stops, at)
        return self.words[self.lexical[k]]["probability"] if k < len(self.stops) else None


def word_by_word(units: list[str], words: list[dict]) -> list[dict]:
    """`reconcile` where each unit has the letters of one word: nothing needs to be aligned."""
    out, last, final = [], words[0]["start"], len(words) - 1
    for k, (unit, w) in enumerate(zip(units, words, strict=True)):
        last = max(last, w["start"])
        end = w["end"] if k == final else w["start"] + (w["end"] - w["start"])
        out.append({"start": last, "end": max(last + 0.001, end), "text": unit, "probability": w["probability"]})
    return out


def reconcile(text: str, words: list[dict], own: list[str] | None = None, found: list[tuple[int, int, int]] | None = None) -> list[dict]:
    """The text's units with the times of the characters that they are aligned with; starts never go back, no unit is under 1 ms.

    ``own``, the letters of each word, and ``found``, the blocks of the text's letters and theirs, are made if they aren't known.
    """
    units = display_units(text)
    letters = [compact(u) for u in units]
    own = [compact(w["text"]) for w in words] if own is None else own
    if all(letters) and letters == own:
        return word_by_word(units, words)
    source = "".join(letters)
    aligned = Aligned(source, words, own, found if source == compact(text) else None)
    out, cursor, last = [], 0, words[0]["start"]
    for unit, said in zip(units, letters, strict=True):
        a = aligned.place(cursor)
        cursor += len(said)
        b = aligned.place(cursor)
        last = max(last, aligned.time(a, False))
        out.append({"start": last, "end": max(last + 0.001, aligned.time(b, True)), "text": unit, "probability": aligned.probability((a + b) / 2)})
    return out


def common_blocks(a: str, b: str) -> list[tuple[int, int, int]] | None:
    """The matching blocks of two texts that say the same; None for others, or if one is empty."""
    if not a or not b or a == b:
        return blocks.matching_blocks(a, b) if a and b else None
    # the cheap ones are upper bounds
    least = SIMILAR * (len(a) + len(b)) / 2
    if min(len(a), len(b)) < least - 1 or sum(min(n, b.count(c)) for c, n in Counter(a).items()) < least - 1:
        return None
    found = blocks.matching_blocks(a, b)
    return found if blocks.ratio(found, a, b) >= SIMILAR else None


def says_the_same(text: str, words: list[dict]) -> bool:
    return common_blocks(compact(text), "".join(compact(w["text"]) for w in words)) is not None


def prepared(start: float, end: float, text: str, words: list[dict]) -> tuple[str, list[dict]]:
    """How a segment's words were got, and the words: its text by its words' times, its text by its own time, or its words."""
    if words and text:
        own = [compact(w["text"]) for w in words]
        found = common_blocks(compact(text), "".join(own))
        return ("spread", spread_text(start, end, text)) if found is None else ("reconciled", reconcile(text, words, own, found))
    if words:
        return "words", tidy_words(words)
    return ("spread", spread_text(start, end, text)) if text else ("none", [])


_LISTS = T.StructType([T.StructField("how", T.StringType()), *[T.StructField(c, T.ArrayType(T.StringType() if c == "text" else T.DoubleType())) for c in ("start", "end", "text", "probability")]])
_NAMES = ("start", "end", "text", "probability")


def _plain(values) -> list:
    """A list of plain numbers with None for what is missing."""
    return [None if v is None or v != v else v for v in values.tolist()]


@F.pandas_udf(_LISTS)
def _prepared_lists(start: pd.Series, end: pd.Series, text: pd.Series, starts: pd.Series, ends: pd.Series, texts: pd.Series, probabilities: pd.Series) -> pd.DataFrame:
    made: dict[str, list] = {"how": [], **{c: [] for c in _NAMES}}
    for a, b, said, *lists in zip(start, end, text, starts, ends, texts, probabilities, strict=True):
        own = [dict(zip(_NAMES, w, strict=True)) for w in zip(lists[0].tolist(), lists[1].tolist(), lists[2].tolist(), _plain(lists[3]), strict=True)]
        how, words = prepared(a, b, said, own)
        made["how"].append(how)
        for c in _NAMES:
            made[c].append([w[c] for w in words])
    return pd.DataFrame(made)


#: So that a filter on its result isn't pushed below it, where the expressions above would be inlined over and over.
_prepared_lists = _prepared_lists.asNondeterministic()


def prepared_of(start: Column, end: Column, text: Column, words: Column) -> Column:
    """(how, start, end, text, probability): the way taken, and the words' fields as lists, in which Arrow passes them best."""
    return _prepared_lists(start, end, text, *[words[c] for c in _NAMES])


def words_of_lists(made: str) -> Column:
    lists = [F.col(f"{made}.{c}") for c in _NAMES]
    return F.transform(F.arrays_zip(*lists), lambda w: F.struct(*[w[c].alias(c) for c in _NAMES]))


@F.pandas_udf(_LISTS)
def _tidy_lists(starts: pd.Series, ends: pd.Series, texts: pd.Series, probabilities: pd.Series) -> pd.DataFrame:
    made: dict[str, list] = {"how": ["words"] * len(starts), **{c: [] for c in _NAMES}}
    for a, b, said, p in zip(starts, ends, texts, probabilities, strict=True):
        words = tidy_words([dict(zip(_NAMES, w, strict=True)) for w in zip(a.tolist(), b.tolist(), said.tolist(), _plain(p), strict=True)])
        for c in _NAMES:
            made[c].append([w[c] for w in words])
    return pd.DataFrame(made)


_tidy_lists = _tidy_lists.asNondeterministic()  # as above


def with_tidy_words(segments: DataFrame) -> DataFrame:
    """Segments whose words are units of display; their fields pass as lists."""
    made = segments.withColumn("_tidy", _tidy_lists(*[F.col("words")[c] for c in _NAMES]))
    return made.withColumn("words", words_of_lists("_tidy")).drop("_tidy")


def are_in_order(words: Column, start: Column, end: Column) -> Column:
    """Is every word an interval inside the segment that doesn't begin before the one before it ends (to 1e-9)."""

    def good(w: Column, i: Column) -> Column:
        floor = F.when(i == 0, start).otherwise(F.get(words, i - 1)["end"])
        fine = (F.abs(w["start"]) < float("inf")) & (F.abs(w["end"]) < float("inf")) & (w["start"] >= 0) & (w["end"] > w["start"])
        return F.coalesce(fine & (w["start"] + 1e-9 >= F.greatest(floor, start)) & (w["end"] <= end + 1e-9), F.lit(False))

    return (start >= 0) & (end > start) & F.forall(F.transform(words, good), lambda x: x)


def island_size(words: Column, start: Column, text: Column) -> Column:
    """How many words at a segment's start stand apart by mistake: short, far before the rest, less sure than it; null if none."""
    clean = lambda w: t.collapse_space(w["text"])

    def sure(part: Column, n: int) -> Column:
        total = F.aggregate(part, F.lit(0.0), lambda acc, w: acc + w["probability"])  # null if any is
        return F.when(F.size(part) == n, total / n)

    def is_island(n: int) -> Column:
        left, right = F.slice(words, 1, n), F.slice(words, n + 1, RIGHT_WORDS)
        last, following = F.get(words, F.lit(n - 1)), F.get(words, F.lit(n))
        same = F.startswith(t.compact(text), F.array_join(F.transform(F.slice(words, 1, n + RIGHT_WORDS), lambda w: t.compact(w["text"])), ""))
        apart = (following["start"] - last["end"] >= ISLAND_GAP) & (F.length(F.array_join(F.transform(left, clean), " ")) <= ISLAND_CHARS)
        return (F.size(words) >= n + RIGHT_WORDS) & apart & ~t.ends_sentence(clean(last)) & (sure(left, n) + SURER < sure(right, RIGHT_WORDS)) & same

    near = F.get(words, F.lit(0))["start"] - start <= NEAR_START
    return F.when(near, F.coalesce(*[F.when(is_island(n), F.lit(n)) for n in range(1, ISLAND_WORDS + 1)]))


def retime_island(words: Column, size: Column, start: Column) -> Column:
    """The first ``size`` words moved up to the next one, back to front with their own durations, if there is room."""
    left, right = F.slice(words, 1, F.coalesce(size, F.lit(0))), F.get(words, size)["start"]
    rest = lambda i: F.aggregate(F.slice(left, i + 1, F.size(left)), F.lit(0.0), lambda acc, w: acc + (w["end"] - w["start"]))
    moved = F.transform(words, lambda w, i: F.when(i < size, F.struct((right - rest(i)).alias("start"), (right - rest(i + 1)).alias("end"), w["text"].alias("text"), w["probability"].alias("probability"))).otherwise(w))
    return F.when(size.isNotNull() & (rest(F.lit(0)) < right - start), moved).otherwise(words)


def prepare(segments: DataFrame) -> DataFrame:
    """Segments (rec, seg, start, end, text, words) with how (the way taken), retimed (had a leading island) and words as prepared; other columns stay.

    Blank words are left out first; words that are not in order count as none.
    """
    start, end = F.col("start"), F.col("end")
    real = F.filter(F.coalesce("words", F.array().cast(f"array<{WORD}>")), lambda w: F.coalesce(w["text"].rlike(r"\S"), F.lit(False)))
    out = segments.withColumn("words", real).withColumn("text", F.coalesce(t.collapse_space(F.col("text")), F.lit("")))
    out = out.withColumn("words", F.when(are_in_order(F.col("words"), start, end), F.col("words")).otherwise(F.array().cast(f"array<{WORD}>")))
    out = out.withColumn("_size", island_size(F.col("words"), start, F.col("text"))).withColumn("_moved", retime_island(F.col("words"), F.col("_size"), start))
    out = out.withColumn("retimed", F.coalesce(F.col("_moved") != F.col("words"), F.lit(False)))
    out = out.withColumn("_made", prepared_of(start, end, F.col("text"), F.col("_moved")))
    return out.select(*[c for c in segments.columns if c not in ("text", "words")], "_made.how", "retimed", words_of_lists("_made").alias("words"))


def merged_hyphens(words: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words (rec, ix, start, end, text, probability) where particles and what follows a hyphen are joined to the word before, over segments too; ``keep`` names columns that a recording has one value of."""
    last = F.lag("text").over(in_order())
    joined = F.coalesce(last.isNotNull() & t.is_hyphen_suffix(F.col("text")) | last.endswith("-"), F.lit(False))  # the first word is joined to none
    rows = words.withColumn("_open", (~joined).cast("int")).withColumn("_word", F.sum("_open").over(upto(in_order())))
    parts = F.array_sort(F.collect_list(F.struct("ix", "text", "probability")))
    pairwise = F.aggregate(F.transform(parts, lambda p: p["probability"]), F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).when(x.isNull(), acc).otherwise((acc + x) / 2))
    made = rows.groupBy("rec", "_word").agg(F.min("ix").alias("ix"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), pairwise.alias("probability"), *[F.first(c).alias(c) for c in keep])
    return made.drop("_word")


def retime_vocalisations(lines: DataFrame, longest: float, slack: float = 0.05) -> DataFrame:
    """Lines (rec, ix, start, end, text, n_words) with run and start and end: a vocalisation that is too long shares its time with those squeezed in behind it.

    A run begins with a single word of two hyphens or more, longer than ``longest``; single words of that kind of at most ``slack``, that
    follow within ``slack``, go on with it. Time is shared by characters.
    """
    w = in_order()
    single = (F.col("n_words") == 1) & t.is_vocalisation(F.col("text"))
    length = F.col("end") - F.col("start")
    follows = single & (length <= slack) & (F.col("start") - F.lag("end").over(w) <= slack)
    out = lines.withColumns({"_heads": single & (length > longest), "_follows": F.coalesce(follows, F.lit(False))})
    out = out.withColumn("run", F.sum(F.when(F.col("_follows"), 0).otherwise(1)).over(upto(w)))
    whole = Window.partitionBy("rec", "run")
    within = whole.orderBy("ix")
    out = out.withColumns({"_n": F.count("*").over(whole), "_led": F.first("_heads").over(upto(within)), "_first": F.min("start").over(whole), "_last": F.last("end").over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    last = F.lead("ix").over(within).isNull()
    gap = F.when(last | F.rtrim("text").endswith("-"), 0).otherwise(1)
    out = out.withColumn("_w", F.greatest(F.lit(1), t.visible_length(F.col("text")) + gap))
    out = out.withColumns({"_at": F.coalesce(F.sum("_w").over(before(within)), F.lit(0)), "_all": F.sum("_w").over(whole), "_end": last})
    moves, span = F.col("_led") & (F.col("_n") > 1), F.col("_last") - F.col("_first")
    begin = F.col("_first") + span * F.col("_at") / F.col("_all")
    stop = F.when(F.col("_end"), F.col("_last")).otherwise(F.col("_first") + span * (F.col("_at") + F.col("_w")) / F.col("_all"))
    moved = out.withColumns({"start": F.when(moves, begin).otherwise(F.col("start")), "end": F.when(moves, stop).otherwise(F.col("end")), "retimed": moves})
    return moved.select(*lines.columns, "retimed")


def duration_chunks(text: str, duration: float, longest: float) -> list[str] | None:
    """Parts that last ``longest`` at most at an even pace, cut at the last space or behind the last hyphen; None if that can't be."""
    text = " ".join(text.split())
    if not text:
        return None
    most = len(text) * longest / duration + 1e-9
    cuts = [k + 1 for k, c in enumerate(text[:-1]) if c in "- "]
    out, at = [], 0
    while len(text) - at > most:
        fits = bisect_right(cuts, at + most)
        if not fits or cuts[fits - 1] <= at or not text[at : cuts[fits - 1]].strip():
            return None
        out.append(text[at : cuts[fits - 1]].strip())
        at = cuts[fits - 1]
    return [*out, text[at:].strip()] if out else None


def split_long(start: float, end: float, text: str, probability: float | None, longest: float) -> list[dict]:
    """A word that lasts too long in parts, by characters; one that can't be cut keeps its end and loses the silence before it."""
    if end - start <= longest + 1e-9:
        return [{"start": start, "end": end, "text": text, "probability": probability}]
    chunks = duration_chunks(text, end - start, longest)
    if chunks is None:
        begin = max(0.0, end - longest)
        return [{"start": begin if begin < end else max(0.0, math.nextafter(end, -math.inf)), "end": end, "text": text, "probability": probability}]
    weights = [max(1, len(c) + (k < len(chunks) - 1 and not c.endswith("-"))) for k, c in enumerate(chunks)]
    return [{"start": a, "end": b, "text": c, "probability": probability} for c, (a, b) in zip(chunks, shares(start, end, weights), strict=True)]
