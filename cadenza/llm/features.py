"""Features of many texts at once: which words they have, and how they are laid out.

Texts are joined into one run of bytes, and every feature is a sum or a search over it, so that no Python code runs per word. A token
is a run of letters, digits, underscores and non-ASCII bytes, or a run of other marks; the beginnings of words (in bytes) count
too, for inflected and compound words share them. Features are numbered by a hash of `BITS` bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BITS = 20
#: Lengths, in bytes, of the beginnings of words that are features.
PREFIXES = (4, 5, 6, 7, 8)
#: Bytes of text that are looked at together; a longer text is looked at alone.
BATCH_BYTES = 1 << 18
LAYOUT = 10

_SPACE, _MARK, _WORD = 0, 1, 2
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = _WORD
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True  # of a letter beyond ASCII, its first byte
ROOT = 0x9E3779B97F4A7C15
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, root: int = ROOT) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a root and of its inverse, modulo 2^64."""
    if root not in _TABLES or len(_TABLES[root][0]) < n:
        steps = np.full(1 << max(16, (n - 1).bit_length()), 1, np.uint64)
        made = []
        for r in (root, pow(root, -1, 1 << 64)):
            steps[1:] = r
            made.append(np.multiply.accumulate(steps))
        _TABLES[root] = tuple(made)
    return _TABLES[root]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(of: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many are true from each start to each end."""
    total = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
    return total[ends] - total[starts]


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values of each owner, in order: owners, values, and how many each of the ``n`` owners has."""
    both = np.sort(owner.astype(np.uint64) << np.uint64(40) | value & np.uint64((1 << 40) - 1))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    who = (both >> np.uint64(40)).astype(np.int64)
    return who, both & np.uint64((1 << 40) - 1), np.bincount(who, minlength=n)


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text, its different features: their numbers one text after the other, how many each has; and its layout, a row each."""
    n = len(texts)
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    two = np.zeros(len(raw), bool)  # of C3 80 to C3 9E, the capitals from À to Þ, the second byte
    two[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    capital = (raw >= 65) & (raw <= 90) | two
    low = np.where(capital, raw + 32, raw)
    kind = _CLASS[raw]
    edges = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]])) if len(raw) else np.zeros(1, np.int64)
    first, last = edges[:-1], edges[1:]
    real = kind[first] != _SPACE if len(first) else np.zeros(0, bool)
    first, last = first[real], last[real]
    owner = np.searchsorted(ends, first)
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], dtype=np.uint64)])

    def hashed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return mix((sums[b] - sums[a]) * down[a] + np.uint64(salt))

    whole = hashed(first, last, 0)
    _, tokens, different = _distinct(owner, whole >> np.uint64(24), n)
    owners, values = [owner], [whole >> np.uint64(64 - BITS)]
    word = kind[first] == _WORD if len(first) else real
    for length in PREFIXES:
        longer = word & (last - first > length)
        owners.append(owner[longer])
        values.append(hashed(first[longer], first[longer] + length, length) >> np.uint64(64 - BITS))
    _, features, counts = _distinct(np.concatenate(owners), np.concatenate(values), n)

    # lines: those with anything but white space
    breaks = np.flatnonzero(raw == 10)
    line_starts, line_ends = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks, breaks
    visible = _sums(kind != _SPACE, line_starts, line_ends) > 0
    line_starts, line_ends = line_starts[visible], line_ends[visible]
    line_owner = np.searchsorted(ends, line_starts)
    _, _, lines_different = _distinct(line_owner, hashed(line_starts, line_ends, 0) >> np.uint64(24), n)
    lines = np.bincount(line_owner, minlength=n)

    letters = _sums(_LETTER[raw], starts, ends)
    characters = _sums((raw & 0xC0) != 0x80, starts, ends)
    some, many, some_lines = np.maximum(characters, 1), np.maximum(np.bincount(owner, minlength=n), 1), np.maximum(lines, 1)
    space = np.concatenate([kind == _SPACE, [True]])
    closes = ~space[:-1] & space[1:]  # the last byte of each run between white space
    runs = np.maximum(_sums(closes, starts, ends), 1)
    layout = np.stack([
        np.log1p(characters), np.log1p(lines), np.log1p(characters / some_lines),
        _sums(capital, starts, ends) / np.maximum(letters, 1), letters / some, _sums((raw >= 48) & (raw <= 57), starts, ends) / some,
        1 - lines_different / some_lines, different / many, letters / runs / 10, _sums(closes & (kind == _MARK), starts, ends) / runs,
    ], 1)
    return features.astype(np.int32), counts, layout


def groups(texts: pa.Array):
    """(first, end) of groups of neighbouring texts of about `BATCH_BYTES`."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > BATCH_BYTES:
            yield at, k
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)
