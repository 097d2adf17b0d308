"""Words of segments and of whole recordings as columns, so that single words are neither sorted nor dealt.

Spark deals segments by recording and sorts them; Arrow functions are given some ten thousand words at a time, and each step is a few
numpy operations on all of them. What is asked of a token is asked once per distinct token of a batch. What plain rules can't decide
goes through the functions of `reconcile` one segment at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import SENTENCE_END
from cadenza.operators import reconcile
from cadenza.operators.intervals import in_order

#: Words of a batch, about.
WORDS = 100_000

# White space as Unicode has it; `str.split` also takes the four separators below 0x20.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATOR = re.compile("[\x1c-\x1f]")
_INK = re.compile("[^ \t-\r]")
_END = re.compile(SENTENCE_END)
_BREAK = re.compile("\r\n|[\n-\r\x85\u2028\u2029]")

#: What is known of a token: what holds for it in the low bits, then its letters and digits, then its characters.
BLANK, PLAIN, DASH, SUFFIX, CLOSES, SINGLE = 1, 2, 4, 8, 16, 32
_LETTERS, _SIZE, _LATE = 6, 35, 200_000


def collapsed(text: str) -> str:
    """As `text.collapse_space`."""
    return _SPACE.sub(" ", text).strip(" ") if _SEPARATOR.search(text) else " ".join(text.split())


def visible(text: str) -> int:
    """As `text.visible_length`."""
    return len(_BREAK.sub(" ", text))


def _facts(token: str | None) -> int:
    """What is known of a token. A plain one begins with a letter or digit and has no white space and no glued sentences: it is a unit of display by itself."""
    if token is None:
        return BLANK
    most = token[:-1] if token[-1:] in (".", ",") else token
    if most.isalnum():  # most are
        return PLAIN | SINGLE | CLOSES * token.endswith(".") | (len(most) if most.isascii() else len(reconcile.compact(most))) << _LETTERS | len(token) << _SIZE
    if not _INK.search(token):
        return BLANK
    single = token.split() == [token]
    plain = single and token[0].isalnum() and not reconcile._GLUED.search(token)
    holds = PLAIN * plain | SINGLE * single | DASH * token.endswith("-") | SUFFIX * bool(reconcile._SUFFIX.fullmatch(token)) | CLOSES * bool(_END.search(collapsed(token)))
    return holds | len(reconcile.compact(token)) << _LETTERS | visible(token) << _SIZE


class _Known(dict):
    """What is known of the tokens of late."""

    def __missing__(self, token: str | None) -> int:
        if len(self) >= _LATE:
            self.clear()
        self[token] = found = _facts(token)
        return found


_known = _Known()


def _facts_of(tokens: list[str | None]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, tokens), np.int64, len(tokens))


class Tokens:
    """Texts by their place in a list of distinct ones (but for lists that were put together), with what is known of these."""

    def __init__(self, known: list[str | None], code: np.ndarray, facts: np.ndarray | None = None):
        self.known, self.code = known, code
        self.facts = _facts_of(known) if facts is None else facts

    @staticmethod
    def of(texts: pa.Array | list) -> Tokens:
        found = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).dictionary_encode("encode")
        return Tokens(found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64))

    def __len__(self) -> int:
        return len(self.code)

    def take(self, rows: np.ndarray | slice) -> Tokens:
        return Tokens(self.known, self.code[rows], self.facts)

    def plus(self, other: Tokens) -> Tokens:
        return Tokens(self.known + other.known, np.concatenate([self.code, other.code + len(self.known)]), np.concatenate([self.facts, other.facts]))

    def has(self, fact: int) -> np.ndarray:
        return (self.facts & fact > 0)[self.code]

    def letters(self) -> np.ndarray:
        return (self.facts >> _LETTERS & (1 << _SIZE - _LETTERS) - 1)[self.code]

    def sizes(self) -> np.ndarray:
        return (self.facts >> _SIZE)[self.code]

    def texts(self) -> list[str]:
        return list(map(self.known.__getitem__, self.code.tolist()))

    def arrow(self) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(self.code), pa.array(self.known, pa.string())).dictionary_decode()


class Words:
    """Words in order, as columns: row (that of the table they came from), start, end, text, probability (nan: none)."""

    def __init__(self, row: np.ndarray, start: np.ndarray, end: np.ndarray, text: Tokens, probability: np.ndarray):
        self.row, self.start, self.end, self.text, self.probability = row, start, end, text, probability

    def __len__(self) -> int:
        return len(self.row)

    def take(self, rows: np.ndarray) -> Words:
        return Words(self.row[rows], self.start[rows], self.end[rows], self.text.take(rows), self.probability[rows])

    def plus(self, other: Words) -> Words:
        joined = lambda c: np.concatenate([getattr(self, c), getattr(other, c)])
        return Words(joined("row"), joined("start"), joined("end"), self.text.plus(other.text), joined("probability"))

    @staticmethod
    def of(row: list[int], words: list[dict]) -> Words:
        column = lambda c: np.array([w[c] for w in words], np.float64)
        return Words(np.array(row, np.int64), column("start"), column("end"), Tokens.of([w["text"] for w in words]), column("probability"))


def per_row(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by row."""
    return np.bincount(row, values, n).astype(np.int64)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Does a row differ from the one before?"""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Doubles with nan for what is missing, and what is missing."""
    return np.array(column.to_numpy(zero_copy_only=False), np.float64), column.is_null().to_numpy(zero_copy_only=False)


def _sure(values: list[float | None]) -> float | None:
    return None if None in values else sum(values, 0.0) / len(values)


def _is_island(n: int, said: list[str], sure: list[float | None], text: str) -> bool:
    """The rest of `reconcile.island_size` for the first ``n`` words, which a gap follows; the lists hold them and those right of it."""
    clean, left, right = [collapsed(x) for x in said[:n]], _sure(sure[:n]), _sure(sure[n:])
    if left is None or right is None or len(" ".join(clean)) > reconcile.ISLAND_CHARS or _END.search(clean[-1]):
        return False
    less = left + reconcile.SURER < right or left == left and right != right  # Spark has what is no number last
    return less and reconcile.compact(text).startswith("".join(map(reconcile.compact, said)))


def prepared(segments: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, Words]:
    """Segments (start, end, text, words) to how each one's words were got, whether it had a leading island, and its words (see `reconcile.prepare`)."""
    column = lambda c: segments.column(c).combine_chunks() if isinstance(segments, pa.Table) else segments.column(c)
    n, lists = segments.num_rows, column("words")
    (start, _), (end, no_end) = numbers_of(column("start")), numbers_of(column("end"))
    text = [collapsed(x or "") for x in column("text").to_numpy(zero_copy_only=False).tolist()]
    a, b, said, p = lists.flatten().flatten()
    no_p = p.is_null().to_numpy(zero_copy_only=False)
    words = Words(np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy()), numbers_of(a)[0], numbers_of(b)[0], Tokens.of(said), numbers_of(p)[0])

    def leave(drop: np.ndarray) -> None:
        nonlocal words, no_p
        if drop.any():
            words, no_p = words.take(~drop), no_p[~drop]

    leave(words.text.has(BLANK))
    # words that are not in order count as none
    row, s, e = words.row, start[words.row], end[words.row]
    floor = np.where(firsts(row), s, np.concatenate([[0.0], words.end])[:-1])
    endless = np.isnan(end) & ~no_end  # ends later than anything
    good = np.isfinite(words.start) & np.isfinite(words.end) & (words.start >= 0) & (words.end > words.start)
    good &= (words.start + 1e-9 >= np.maximum(floor, s)) & ((words.end <= e + 1e-9) | endless[row])
    leave(~((start >= 0) & ((end > start) | endless) & (per_row(row, ~good, n) == 0))[row])
    # leading islands move up to the next word
    count = np.bincount(words.row, minlength=n)
    at, moved = np.cumsum(count) - count, np.zeros(n, bool)
    size = np.zeros(n, np.int64)
    for k in range(1, reconcile.ISLAND_WORDS + 1):
        asked = np.flatnonzero((count >= k + reconcile.RIGHT_WORDS) & (size == 0))
        i = at[asked]
        apart = (words.start[i] - start[asked] <= reconcile.NEAR_START) & (words.start[i + k] - words.end[i + k - 1] >= reconcile.ISLAND_GAP)
        for j in asked[apart].tolist():
            own = slice(int(at[j]), int(at[j]) + k + reconcile.RIGHT_WORDS)
            sure = [None if no else v for v, no in zip(words.probability[own].tolist(), no_p[own].tolist(), strict=True)]
            size[j] = k * _is_island(k, words.text.take(own).texts(), sure, text[j])
    for j in np.flatnonzero(size).tolist():
        own, right = slice(int(at[j]), int(at[j] + size[j])), words.start[at[j] + size[j]]
        lengths = (words.end[own] - words.start[own]).tolist()
        rest = [sum(lengths[k:], 0.0) for k in range(len(lengths) + 1)]
        if rest[0] < right - start[j]:
            moved[j] = True
            words.start[own], words.end[own] = [right - x for x in rest[:-1]], [right - x for x in rest[1:]]
    how, made = _units(start, end, text, words, count)
    return how, moved, made


def _units(start: np.ndarray, end: np.ndarray, text: list[str], words: Words, count: np.ndarray) -> tuple[np.ndarray, Words]:
    """The three ways of `reconcile.prepared`: segments of plain tokens by columns, others one by one."""
    n, cuts, said = len(text), (np.cumsum(count) - count).tolist(), words.text.texts()
    has_words, has_text = count > 0, np.array([x != "" for x in text], bool)
    plain = per_row(words.row, ~words.text.has(PLAIN), n) == 0
    same = np.array([ok and " ".join(said[i : i + m]) == x for i, m, x, ok in zip(cuts, count.tolist(), text, (has_words & has_text & plain).tolist(), strict=True)], bool)
    back = ~firsts(words.row)
    back[1:] &= words.start[1:] < words.start[:-1]
    reconciled = same & (per_row(words.row, back, n) == 0)
    as_said = has_words & ~has_text & plain & (per_row(words.row, words.text.has(DASH), n) == 0)
    # texts by their own time: those without words, and those with too few or too many letters to say the same
    asked = has_text & ~same
    split = [x.split() if ask else [] for x, ask in zip(text, asked.tolist(), strict=True)]
    units, own = Tokens.of(list(chain.from_iterable(split))), np.repeat(np.arange(n), list(map(len, split)))
    letters = units.letters()
    mine, theirs = per_row(own, letters, n), per_row(words.row, words.text.letters(), n)
    differ = ~has_words | (mine == 0) | (theirs == 0) | (np.minimum(mine, theirs) < reconcile.SIMILAR * (mine + theirs) / 2 - 1)
    spread = asked & differ & (per_row(own, ~units.has(PLAIN), n) == 0)

    how = np.full(n, "none", object)
    how[reconciled], how[as_said], how[spread] = "reconciled", "words", "spread"
    made = words.take((reconciled | as_said)[words.row])
    last = np.roll(firsts(made.row), -1)
    timed = np.maximum(made.start + 0.001, np.where(last, made.end, made.start + (made.end - made.start)))
    made.end = np.where(reconciled[made.row], timed, made.end)
    if spread.any():
        keep = spread[own]
        row, weight = own[keep], np.maximum(1, letters[keep])
        first, upto = firsts(row), np.cumsum(weight)
        before = (upto - weight) - (upto - weight)[first][np.cumsum(first) - 1]
        s, e, total = start[row], end[row], per_row(row, weight, n)[row]
        stop = np.where(np.roll(first, -1), e, s + (e - s) * (before + weight) / total)
        made = made.plus(Words(row, s + (e - s) * before / total, stop, units.take(keep), np.full(len(row), np.nan)))
    rows, rest = [], []
    for j in np.flatnonzero((has_words | has_text) & ~reconciled & ~as_said & ~spread).tolist():
        mine = slice(cuts[j], cuts[j] + int(count[j]))
        given = [dict(zip(reconcile._NAMES, w, strict=True)) for w in zip(words.start[mine].tolist(), words.end[mine].tolist(), said[mine], reconcile._plain(words.probability[mine]), strict=True)]
        how[j], found = reconcile.prepared(float(start[j]), float(end[j]), text[j], given)
        rows += [j] * len(found)
        rest += found
    if rest:
        made = made.plus(Words.of(rows, rest))
    return how, made.take(np.argsort(made.row, kind="stable"))


def pieces(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.Table]:
    """Segments in tables of about ``WORDS`` words; ``whole``: of whole recordings, in whose order they come."""
    held, words, at = [], 0, None
    for batch in batches:
        sizes = batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) + pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False) // 6 + 1
        recs = batch.column("rec").to_pylist() if whole else None
        begin = 0
        for k, size in enumerate(sizes.tolist()):
            if words >= WORDS and (not whole or recs[k] != at):
                yield pa.Table.from_batches([*held, batch.slice(begin, k - begin)])
                held, words, begin = [], 0, k
            words += size
            at = recs[k] if whole else None
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def in_turn(segments: DataFrame) -> DataFrame:
    """Segments dealt by recording and in order of seg; those that are dealt so already stay where they are."""
    return segments.withColumn("_turn", F.row_number().over(in_order("rec", "seg"))).sortWithinPartitions("rec", "seg")


def _missing(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), from_pandas=True)


def prepare(segments: DataFrame) -> DataFrame:
    """`reconcile.prepare`, with words as rows: k, start, end, text, probability."""
    keep = [c for c in segments.columns if c not in ("start", "end", "text", "words")]
    kept = ", ".join(f"`{c}` {kind}" for c, kind in segments.select(keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            how, moved, words = prepared(table)
            first = np.flatnonzero(firsts(words.row))
            k = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
            of_row = table.select(keep).append_column("how", pa.array(how, pa.string())).append_column("retimed", pa.array(moved)).take(pa.array(words.row))
            made = {c: of_row.column(c) for c in of_row.column_names} | {"k": pa.array(k, pa.int32()), "start": _missing(words.start), "end": _missing(words.end), "text": words.text.arrow(), "probability": _missing(words.probability)}
            yield from pa.table(made).to_batches()

    return segments.mapInArrow(run, f"{kept}, how string, retimed boolean, k int, start double, end double, text string, probability double")


def merged_hyphens(words: Words) -> tuple[Words, np.ndarray]:
    """Particles and what follows a hyphen joined to the word before, within rows (here: recordings), and the places of the first words."""
    joins = ~firsts(words.row)
    joins[1:] &= words.text.has(DASH)[:-1] | words.text.has(SUFFIX)[1:]
    if not joins.any():
        return words, np.arange(len(words))
    first = np.flatnonzero(~joins)
    made = words.take(first)
    made.start, made.end = np.minimum.reduceat(words.start, first), np.maximum.reduceat(words.end, first)
    to = np.append(first[1:], len(words))
    texts = []
    for j in np.flatnonzero(to - first > 1).tolist():
        own = slice(int(first[j]), int(to[j]))
        texts.append("".join(words.text.take(own).texts()))
        p = None
        for x in reconcile._plain(words.probability[own]):
            p = x if p is None else p if x is None else (p + x) / 2
        made.probability[j] = np.nan if p is None else p
        made.text.code[j] = len(made.text.known) + len(texts) - 1
    made.text = Tokens(made.text.known + texts, made.text.code, np.concatenate([made.text.facts, _facts_of(texts)]))
    return made, first


def reconciled_words(segments: DataFrame) -> DataFrame:
    """The words (rec, ix, start, end, text, probability) of the segments whose text and words say the same; ix counts those words before hyphens were joined."""
    kind = dict(segments.dtypes)["rec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, whole=True):
            how, _, words = prepared(table)
            words = words.take((how == "reconciled")[words.row])
            if not len(words):
                continue
            recs = table.column("rec").combine_chunks()
            own, at = recordings(recs)
            words.row = own[words.row]
            begin = np.flatnonzero(firsts(words.row))
            ix = np.arange(len(words)) - np.repeat(begin, np.diff(np.append(begin, len(words)))) + 1
            words, first = merged_hyphens(words)
            columns = [recs.take(pa.array(at[words.row])), pa.array(ix[first], pa.int32()), _missing(words.start), _missing(words.end), words.text.arrow(), _missing(words.probability)]
            yield pa.RecordBatch.from_arrays(columns, names=["rec", "ix", "start", "end", "text", "probability"])

    return in_turn(segments).mapInArrow(run, f"rec {kind}, ix int, start double, end double, text string, probability double")


def recordings(recs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's recording, and the first row of each recording; rows come in order of rec."""
    new = firsts(recs.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False))
    return np.cumsum(new) - 1, np.flatnonzero(new)
