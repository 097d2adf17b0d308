"""Words of whole recordings to cues with their times, as columns: the steps of `cues.build` once segments have texts and times.

Each step goes through some ten thousand words at once (see `stream`); the few words, sentences and lines that need a text to be cut go
through the functions of `reconcile` and `layout` one at a time. The schedule is running sums, maxima and minima.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numbers import READING_MARGIN, TOLERANCE
from cadenza.operators import layout, reconcile, stream
from cadenza.operators.stream import CLOSES, DASH, SINGLE, Tokens, Words, firsts, visible

# Seconds that a boundary may move, the shortest cue, and what counts as equal.
DRIFT, SHORTEST, SLACK = 1.0, 0.001, TOLERANCE
#: Counters of a recording, with the ways that they count.
TOLD = {"reconciled_segments": "reconciled", "alignment_text_segments": "words", "synthetic_timing_segments": "spread", "retimed_leading_islands": None, "timing_anomaly_adjustments": None}
#: Bits of a line's rank below its lines, penalty and overflow, the bits of the sums, and a rank above all.
_PENALTY, _OVER, _RAGGED, _NEVER = 51, 37, 24, 1 << 62
_WEAK, _GOOD, _CONJUNCTION = 1, 2, 4


class _Ends(dict):
    """What a token is at a line's end or start."""

    def __missing__(self, token: str) -> int:
        if len(self) >= stream._LATE:
            self.clear()
        word = "" if len(token) > 4 and token.isalnum() else layout.plain(token)
        self[token] = found = _WEAK * (word in layout.WEAK_ENDS) | _GOOD * token.endswith(layout.GOOD_ENDS) | _CONJUNCTION * (word in layout.CONJUNCTIONS)
        return found


_ends = _Ends()


def shared(parts: list[str], start: float, end: float) -> list[tuple[float, float, str]]:
    """As `cues.in_parts`."""
    final = len(parts) - 1
    weights = [max(1, visible(p) + (k < final and not p.rstrip(" ").endswith("-"))) for k, p in enumerate(parts)]
    return [(a, b, p) for p, (a, b) in zip(parts, reconcile.shares(start, end, weights), strict=True)]


def capacity_parts(text: str, most: int) -> list[str]:
    """As `layout.split_capacity`."""
    space = stream._SPACE.pattern.removesuffix("+")
    strip = lambda x: re.sub(rf"\A{space}+|{space}+\Z", "", x)
    text, out, at = strip(text), [], 0
    piece = re.compile(rf"(?s){space}*+(.{{1,{most}}}+\Z|.{{1,{most}}}(?= )|{rf'.{{1,{most - 1}}}-|' if most > 1 else ''}.+)")
    while found := piece.match(text, at):
        out.append(found[1])
        at = found.end()
    return [text] if out and len(out[-1]) > most else [strip(x) for x in out]


def fixed_anchors(words: Words, cps: float, least: float, longest: float, told: np.ndarray) -> None:
    """Words that last too long and can't be cut keep their end, or end where the next one begins inside, and lose the silence before; in place."""
    long = np.flatnonzero(words.end - words.start > longest + SLACK)
    if not len(long):
        return
    following = np.append(words.start[1:], np.nan)
    following[:-1][words.row[1:] != words.row[:-1]] = np.nan
    needed = np.minimum(longest, np.maximum(least, words.text.sizes()[long] / cps) + READING_MARGIN)
    for j, text, need in zip(long.tolist(), words.text.take(long).texts(), needed.tolist(), strict=True):
        start, end, then = float(words.start[j]), float(words.end[j]), float(following[j])
        if reconcile.duration_chunks(stream.collapsed(text), end - start, longest) is None:
            stop = then if start + need <= then < end else end
            words.start[j], words.end[j] = max(0.0, stop - need), stop
            told[words.row[j]] += 1


def within_capacity(words: Words, most: int) -> Words:
    """Words that are too long for a line in parts."""
    wide = words.text.sizes() > most
    if not wide.any():
        return words
    rows, made, order = [], [], [np.flatnonzero(~wide)]
    for j, text in zip(np.flatnonzero(wide).tolist(), words.text.take(wide).texts(), strict=True):
        parts = shared(capacity_parts(text, most), float(words.start[j]), float(words.end[j]))
        made += [{"start": a, "end": b, "text": x, "probability": None} for a, b, x in parts]
        rows += [words.row[j]] * len(parts)
        order.append(np.full(len(parts), j))
    return words.take(~wide).plus(Words.of(rows, made)).take(np.argsort(np.concatenate(order), kind="stable"))


def _most_back(sizes: np.ndarray, most: int) -> np.ndarray:
    """How many words up to each one fit a line, not minding sentences."""
    upto = np.concatenate([[0], np.cumsum(sizes + 1)])
    return np.maximum(1, np.arange(1, len(sizes) + 1) - np.searchsorted(upto, upto[1:] - 1 - most))


def _ranks(sizes: np.ndarray, ends: np.ndarray, n: np.ndarray, width: int, gap: int) -> np.ndarray:
    """Where the lines of sentences of single tokens begin, as `layout.line_breaks` has it; ``n``: their words.

    All sentences go word by word together. A rank's parts are sums, so that it is one number; of equal ones the earliest start is taken.
    """
    count, at = len(sizes), np.cumsum(n) - n
    upto = np.concatenate([[0], np.cumsum(sizes + 1)])
    stop = np.arange(1, count + 1)
    back = np.minimum(_most_back(sizes, width + gap), stop - np.repeat(at, n))
    most = int(back.max())
    steps = np.arange(most, 0, -1)
    length = upto[1:, None] - upto[np.maximum(0, stop[:, None] - steps)] - 1
    weak, good, follows = ends & _WEAK > 0, ends & _GOOD > 0, np.append(ends[1:] & _CONJUNCTION > 0, False)
    tail = np.where(weak, layout.WEAK_END, np.where(good, 0, np.where(follows, layout.CONJUNCTION, layout.PLAIN)))
    tail[at + n - 1] = 0
    cost = tail[:, None] + np.array([layout.SHORT_LINE.get(int(k), 0) for k in steps])
    rank = (1 << _PENALTY) + (cost << _OVER) + (np.maximum(0, length - width) << _RAGGED) + length * length
    rank[steps > back[:, None]] = _NEVER
    order = np.argsort(-n, kind="stable")
    base, left = (at + np.arange(len(n)))[order], n[order]
    best, came = np.zeros(count + len(n), np.int64), np.zeros(count + len(n), np.int64)
    for p in range(1, int(left[0]) + 1):
        k = int(np.searchsorted(-left, -p, "right"))
        here = base[:k] + p
        ways = best[np.maximum(0, here[:, None] - steps)] + rank[at[order[:k]] + p - 1]
        taken = ways.argmin(1)
        best[here], came[here] = ways[np.arange(k), taken], steps[taken]
    starts = np.zeros(count, bool)
    while len(base):
        left = left - came[base + left]
        starts[at[order] + left] = True
        go = left > 0
        base, left, order = base[go], left[go], order[go]
    return starts


def line_starts(words: Words, first: np.ndarray, width: int, gap: int) -> np.ndarray:
    """Where lines begin; ``first``: the words that begin a sentence."""
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(first)))
    sizes, out = words.text.sizes(), first.copy()
    odd = ~words.text.has(SINGLE) | words.text.has(DASH) | (sizes > width + gap)
    many = (n * (layout.WEAK_END + max(layout.SHORT_LINE.values())) >= 1 << _PENALTY - _OVER) | (n * gap >= 1 << _OVER - _RAGGED) | (n * (width + gap) ** 2 >= 1 << _RAGGED) | (n >= 1 << 9)
    one_by_one = np.add.reduceat(odd.astype(np.int64), at) > 0 if len(at) else np.zeros(0, bool)
    one_by_one |= many
    for k in np.flatnonzero(one_by_one).tolist():
        own = slice(int(at[k]), int(at[k] + n[k]))
        out[[int(at[k]) + cut for cut in layout.line_breaks(words.text.take(own).texts(), width, gap)[:-1]]] = True
    together = np.flatnonzero(~one_by_one)
    ends = np.fromiter(map(_ends.__getitem__, words.text.known), np.int64, len(words.text.known))[words.text.code] if len(together) else None
    # sentences of short words, which have many ways to a line, are kept apart
    dense = np.maximum.reduceat(np.minimum(_most_back(sizes, width + gap), np.repeat(n, n)), at) > 12 if len(at) else one_by_one
    for part in [x for some in (together[~dense[together]], together[dense[together]]) for x in np.split(some, np.flatnonzero(np.diff(np.cumsum(n[some]) // 20_000)) + 1)]:
        if len(part):
            own = np.repeat(at[part] - (np.cumsum(n[part]) - n[part]), n[part]) + np.arange(int(n[part].sum()))
            out[own] |= _ranks(sizes[own], ends[own], n[part], width, gap)
    return out


class Lines:
    """Lines in order, as columns: row (the recording), sentence, start, end, text, words."""

    def __init__(self, row, sentence, start, end, text: list[str], words):
        self.row, self.sentence, self.start, self.end, self.text, self.words = row, sentence, start, end, text, words


def pack(words: Words, width: int, gap: int) -> Lines:
    """As `layout.pack_lines`, where a sentence ends with a mark or the recording."""
    first = firsts(words.row)
    first[1:] |= words.text.has(CLOSES)[:-1]
    at = np.flatnonzero(line_starts(words, first, width, gap))
    said, dash = words.text.texts(), words.text.has(DASH)
    to = np.append(at[1:], len(said))
    glued = np.add.reduceat(dash.astype(np.int64), at) > 0
    text = [layout.join_units(said[i:j]) if x else " ".join(said[i:j]) for i, j, x in zip(at.tolist(), to.tolist(), glued.tolist(), strict=True)]
    return Lines(words.row[at], (np.cumsum(first) - 1)[at], words.start[at], np.maximum.reduceat(words.end, at), text, to - at)


def normal(lines: Lines, longest: float, told: np.ndarray, slack: float = 0.05) -> Lines:
    """Vocalisations share their time (see `reconcile.retime_vocalisations`), single words that still last too long are cut or lose the silence before them."""
    length, last = lines.end - lines.start, len(lines.text)
    alone = np.flatnonzero((lines.words == 1) & ((length > longest) | (length <= slack)))
    single = {k for k in alone.tolist() if lines.text[k].count("-") >= 2}
    start, end = lines.start.copy(), lines.end.copy()
    follows = lambda k: k < last and k in single and k > 0 and lines.row[k] == lines.row[k - 1] and length[k] <= slack and lines.start[k] - lines.end[k - 1] <= slack
    for k in sorted(single):
        if length[k] <= longest or follows(k):
            continue
        to = k + 1
        while follows(to):
            to += 1
        if to - k < 2:
            continue
        parts = shared(lines.text[k:to], float(lines.start[k:to].min()), float(lines.end[to - 1]))
        start[k:to], end[k:to] = [a for a, _, _ in parts], [b for _, b, _ in parts]
        told[lines.row[k]] += int((length[k:to] > longest).sum())
    lines.start, lines.end = start, end
    long = np.flatnonzero((lines.words == 1) & (end - start > longest + SLACK)).tolist()
    if not long:
        return lines
    cut = {}
    for k in long:
        told[lines.row[k]] += 1
        parts = reconcile.duration_chunks(stream.collapsed(lines.text[k]), float(end[k] - start[k]), longest)
        if parts is None:
            start[k] = max(0.0, end[k] - longest)
        else:
            cut[k] = shared(parts, float(start[k]), float(end[k]))
    if not cut:
        return lines
    times = np.ones(last, np.int64)
    times[list(cut)] = list(map(len, cut.values()))
    own, at = np.repeat(np.arange(last), times), np.cumsum(times) - times
    text = list(map(lines.text.__getitem__, own.tolist()))
    made = Lines(lines.row[own], lines.sentence[own], start[own], end[own], text, lines.words[own])
    for k, parts in cut.items():
        for j, (a, b, x) in enumerate(parts, int(at[k])):
            made.start[j], made.end[j], text[j] = a, b, x
    return made


def cue_ends(sentences: list[int], sizes: list[int]) -> list[int]:
    """`layout.cue_breaks` for two lines in a run without a parting pause: a rank is one number, whose parts are sums."""
    n = len(sizes)
    crossing, orphan = n * n + 1, (n * n + 1) * (n + 1)
    cue = orphan * (max(layout.ORPHAN.values()) * n + 1)
    before, best, came = 0, cue + layout.ORPHAN.get(sizes[0], 0) * orphan, [0, 0]
    for end in range(2, n + 1):
        pair = before + cue + (sentences[end - 2] != sentences[end - 1]) * crossing
        alone = best + cue + layout.ORPHAN.get(sizes[end - 1], 0) * orphan - (end - 1)
        came.append(end - 1 if alone < pair else end - 2)
        before, best = best, min(alone, pair)
    return layout._way(came)


def grouped(lines: Lines, max_lines: int, pause: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """As `layout.group_cues`: row, start, end and text of cues."""
    if max_lines not in (1, 2):
        raise ValueError("a cue has one line or two")
    first = firsts(lines.row)
    first[1:] |= (lines.sentence[1:] != lines.sentence[:-1]) & (lines.start[1:] - lines.end[:-1] >= min(pause, layout.PAIR_GAP))
    bounds = [*np.flatnonzero(first).tolist(), len(first)]
    at = list(range(len(first)))
    if max_lines == 2:
        sentences, sizes, at = lines.sentence.tolist(), [len(x.split()) for x in lines.text], []
        for i, j in pairwise(bounds):
            at += [i, *[i + cut for cut in cue_ends(sentences[i:j], sizes[i:j])[:-1]]]
    places = np.array(at)
    text = ["\n".join(lines.text[i:j]) for i, j in pairwise([*at, len(first)])]
    return lines.row[places], lines.start[places], np.maximum.reduceat(lines.end, places), text


class Cues:
    """Cues in order, as columns: row (the recording), start, end, text, until (the recording's time; nan: unknown)."""

    def __init__(self, row, start, end, text: list[str], until):
        self.row, self.start, self.end, self.text, self.until = row, start, end, text, until
        self.first = firsts(row)
        bounds = [*np.flatnonzero(self.first).tolist(), len(row)]
        self.runs = [slice(i, j) for i, j in pairwise(bounds)]
        self.n = np.repeat(np.diff(bounds), np.diff(bounds))
        self.i = np.arange(len(row)) - np.repeat(bounds[:-1], np.diff(bounds))

    def running(self, step: np.ufunc, values: np.ndarray, backwards: bool = False) -> np.ndarray:
        """Sums, maxima or minima so far, by recording."""
        turn = slice(None, None, -1 if backwards else 1)
        return np.concatenate([step.accumulate(values[run][turn])[turn] for run in self.runs])

    def whole(self, step: np.ufunc, values: np.ndarray) -> np.ndarray:
        """What a recording has in all, for each of its cues."""
        return np.repeat(step.reduceat(values, np.flatnonzero(self.first)), self.n[self.first])

    def last(self, values: np.ndarray, none) -> np.ndarray:
        """The cue's before, or ``none``."""
        return np.where(self.first, none, np.roll(values, 1))

    def next(self, values: np.ndarray) -> np.ndarray:
        """The next cue's, or nan."""
        return np.where(np.roll(self.first, -1), np.nan, np.roll(values, -1))


def target_schedule(cues: Cues, cps: float, least: float, longest: float, pause: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends as reading needs them, and: can the whole recording keep them?

    A cue lasts as long as it is said, or as reading takes; it begins no earlier than a second before that ends with it and no later
    than a second after it begins, after the block before has ended and before the next block begins.
    """
    start, end, until = cues.start, cues.end, cues.until
    needed = np.maximum(least, np.array(list(map(len, cues.text)), np.float64) / cps) + READING_MARGIN
    d = np.maximum(np.minimum(end - start, longest), needed)
    last, then = cues.last(end, 0.0), cues.next(start)
    begins = cues.first | (start - last >= pause)
    deadline = np.where(np.isnan(then), until, np.where(then - end >= pause, then, np.nan))
    low = np.maximum(np.maximum(0.0, end - d - DRIFT), np.where(begins, last, 0.0))
    high = np.fmin(np.fmin(start + DRIFT, until - d), deadline - d)
    upto = cues.running(np.add, d)
    before = cues.last(upto, 0.0)
    latest = cues.running(np.minimum, high - before, backwards=True)
    at = before + np.maximum(0.0, cues.running(np.maximum, np.minimum(np.maximum(start, low) - before, latest)))
    fine = (d <= longest + SLACK) & (high + SLACK >= low) & (latest + before + SLACK >= low)
    # no start before the end before, no end within a billionth of the start
    i = cues.i * 1e-9
    stop = i + cues.running(np.maximum, np.maximum(at + d, at + 1e-9) - i)
    return np.maximum(at, cues.last(stop, 0.0)), stop, cues.whole(np.logical_and, fine)


def compacted(cues: Cues, feasible: np.ndarray) -> tuple[Cues, np.ndarray, np.ndarray]:
    """Where no schedule is feasible and the time has fewer milliseconds than cues: as many groups of neighbours as it has.

    With the places of the groups' first cues, and whether a recording's cues were put together. The cues' until is the end of the time.
    """
    until = np.maximum(SHORTEST, np.where(np.isnan(cues.until), cues.whole(np.maximum, cues.end), cues.until))
    most = np.where(feasible | (until >= cues.n * SHORTEST), cues.n, np.maximum(1.0, np.floor(until / SHORTEST))).astype(np.int64)
    merged = most < cues.n
    group = np.floor(((cues.i + 1) * most - 1) / cues.n)
    at = np.flatnonzero(firsts(cues.row, group))
    text = cues.text
    if merged.any():
        texts = [text[i:j] for i, j in pairwise([*at.tolist(), len(text)])]
        text = [own[0] if len(own) == 1 else " ".join(own).replace("\n", " ") for own in texts]
    return Cues(cues.row[at], cues.start[at], np.maximum.reduceat(cues.end, at), text, until[at]), at, merged[at]


def anchor_schedule(cues: Cues) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends with boundaries at the middle between neighbours, at least a millisecond apart.

    With e the millisecond and i the row's place, boundary less i e is a running maximum of the middles less i e, bounded from both
    sides by constants. Should that not be an order of intervals (times too large for milliseconds), cues share the time equally from 0.
    """
    until, span, following = cues.until, cues.n * SHORTEST, np.roll(cues.first, -1)
    of = lambda values, places: np.repeat(values[places], cues.n[cues.first])
    begin = np.minimum(np.maximum(0.0, of(cues.start, cues.first)), np.maximum(0.0, until - span))
    final = np.minimum(until, np.maximum(np.minimum(until, np.maximum(begin, of(cues.end, following))), begin + span))
    middle = np.where(following, -np.inf, (cues.end + np.roll(cues.start, -1)) / 2 - (cues.i + 1) * SHORTEST)
    stop = (cues.i + 1) * SHORTEST + np.minimum(final - span, np.maximum(begin, cues.running(np.maximum, middle)))
    stop = np.where(following, final, stop)
    start = cues.last(stop, begin)
    fine = cues.whole(np.logical_and, (stop > start) & (start >= 0))
    return np.where(fine, start, until * cues.i / cues.n), np.where(fine, stop, until * (cues.i + 1) / cues.n)


def drifts(cues: Cues, start: np.ndarray, end: np.ndarray, merged: np.ndarray, pause: float) -> pa.Array:
    """How far a cue's end and the next one's start lie outside the gap between them as they are said, within blocks; one number where they meet."""
    said, given = cues.next(cues.start), cues.next(start)
    same = (said - cues.end < pause) & ~merged
    low, high = np.minimum(cues.end, said), np.maximum(cues.end, said)
    outside = lambda x: np.maximum(np.maximum(low - x, x - high), 0.0)
    left, right = outside(end), outside(given)
    meet = np.abs(end - given) <= SLACK
    both = np.stack([np.where(meet, np.maximum(left, right), left), np.where(meet, 0.0, right)], 1)
    keep = (both > SLACK) & same[:, None]
    places = np.concatenate([[0], np.cumsum(keep.sum(1))])
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(both[keep]), mask=pa.array(~same))


def ticked(cues: Cues, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `intervals.quantise` in milliseconds."""

    def ticks(seconds: np.ndarray) -> np.ndarray:
        whole = np.floor(seconds)
        return (whole.astype(np.int64) * 1000 + np.rint((seconds - whole) * 1000)).astype(np.int64)

    a = ticks(start)
    stop = cues.i + cues.running(np.maximum, np.maximum(ticks(end), a + 1) - cues.i)
    return np.maximum(np.maximum(a, cues.last(stop, 0)), 0), stop


def timed_cues(segments: DataFrame, width: int, gap: int, max_lines: int, cps: float, least: float, longest: float, pause: float) -> DataFrame:
    """Segments (rec, seg, start, end, text, words, duration) to cues (rec, ix, tick_start, tick_end, cue_text, drifts, told): by the target schedule where it is feasible for the whole recording, else by boundaries between neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream.pieces(batches, whole=True):
            how, moved, words = stream.prepared(table)
            if not len(words):
                continue
            recs, durations = (table.column(c).combine_chunks() for c in ("rec", "duration"))
            own, at = stream.recordings(recs)
            told = {name: stream.per_row(own, how == way, len(at)) for name, way in TOLD.items() if way}
            told["retimed_leading_islands"] = stream.per_row(own, moved, len(at))
            told["timing_anomaly_adjustments"] = adjusted = np.zeros(len(at), np.int64)
            words.row = own[words.row]
            words, _ = stream.merged_hyphens(words)
            fixed_anchors(words, cps, least, longest, adjusted)
            lines = normal(pack(within_capacity(words, width + gap), width, gap), longest, adjusted)
            row, start, end, text = grouped(lines, max_lines, pause)
            cues = Cues(row, start, end, text, stream.numbers_of(durations)[0][at[row]])
            start, end, feasible = target_schedule(cues, cps, least, longest, pause)
            cues, places, merged = compacted(cues, feasible)
            start, end, feasible = start[places], end[places], feasible[places]
            if not feasible.all():
                other, other_end = anchor_schedule(cues)
                start, end = np.where(feasible, start, other), np.where(feasible, end, other_end)
            begin, stop = ticked(cues, start, end)
            columns = [recs.take(pa.array(at[cues.row])), pa.array(cues.i), pa.array(begin), pa.array(stop), pa.array(cues.text, pa.string()), drifts(cues, start, end, merged, pause), *[pa.array(told[c][cues.row]) for c in TOLD]]
            yield pa.RecordBatch.from_arrays(columns, names=["rec", "ix", "tick_start", "tick_end", "cue_text", "drifts", *TOLD])

    kind = dict(segments.dtypes)["rec"]
    made = stream.in_turn(segments).mapInArrow(run, f"rec {kind}, ix long, tick_start long, tick_end long, cue_text string, drifts array<double>, " + ", ".join(f"{c} long" for c in TOLD))
    return made.select("rec", "ix", "tick_start", "tick_end", "cue_text", "drifts", F.struct(*TOLD).alias("told"))
