"""Similarity join on word n-grams: size-aware, heavy and light, exact at any threshold.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Documents with equal sets are one class, and only classes are
joined. Two sets whose Jaccard similarity reaches the threshold must share a token within the first n - ceil(t n) + 1 of each, and two
tokens within one more, in any common order of tokens.

* Small (light) sets enumerate all 2-subsets of that longer prefix: chance rarely makes two sets share two rare tokens.
* Large (heavy) sets post the single tokens of the shorter prefix, and inverted lists are scanned. Small sets that are large enough
  to pair with a large one post single tokens too.
* The boundary is the size with the least cost: signatures posted, and verifications that chance collisions cause. Sizes and
  collisions are counted over all sets of up to `LARGEST_BOUNDARY` shingles.

The order puts long shingles first (in bytes: a longer shingle is a rarer one) and those last that are in very many sets, the most
frequent at the very end. These are found by counting within blocks of sets and adding up; as they only set the order, a bounded number
of them suffices. So what pages of one template share is in no prefix unless they are similar.

Of a pair, the smaller set must have the first shared token within a still shorter prefix: it needs an overlap of 2 t / (1 + t) of its
own size. Rows within that prefix hold a list, the others only ask it, lists that nobody holds are dropped, and pairs are made of
holders and askers of at least their size. Rounds follow each other: lists that have no more than `CENTRES` pairs a row
are compared whole and are done; of longer ones, each class outside the list's largest component is compared with so many classes of
the list (a star), and what is similar joins a component. Then lists that lie within one component are done too, and `CENTRES` is
raised to its next power, so that in the end every list has been compared whole but for pairs within a component. A candidate pair
must pass an exact upper bound on the overlap from parity bitmaps; then the sets are compared.

A class is told by 128 bits of a cryptographic hash of its set, in which small sets stand with their very words: two documents of one
class need no further proof. The joins use 64 of these bits; of classes that agree in them by chance all but one get other ones.

Edge cases: null, empty and blank texts have an empty set and no links; fewer than five words make one shingle; repeated rows are in
one class; a null id takes part and gets its component's smallest non-null id; ids keep their type, and where they are null or no
whole numbers, rows are told apart by numbers; an empty table gives no rows; only the named id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import discard, numbered, table, unused, written
from cadenza.llm.components import components
from cadenza.llm.features import mix

WORDS = 5
#: Similarity in hundredths.
THRESHOLD = 80
LARGEST_BOUNDARY = 96
#: Cost of a verification in posted signatures.
VERIFY_COST = 4
#: Shingles counted together when very frequent ones are looked for, sets of a block that must share one, sets in all, and how many are kept.
BLOCK_SHINGLES, LOCAL_SETS, FREQUENT_SETS, FREQUENT = 1 << 20, 3, 48, 1 << 17
#: Classes of a long list that each of its rows is compared with in the first round; in the next ones, powers of that.
CENTRES = 8
#: Sets of up to so many shingles have bitmaps of under 256 bits.
SKETCHED = 32
#: Bytes of text that are hashed at once.
CHUNK = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_COEFFICIENTS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)
#: Sets of up to so many shingles are told apart by their words, not by the shingles' hashes.
BY_WORDS = 8


PLACES = 64
_RANDOM = mix(mix(np.arange(PLACES << 8, dtype=np.uint64) >> np.uint64(8)) + (np.arange(PLACES << 8, dtype=np.uint64) & np.uint64(255)))


def _chunks(body: bytes) -> Iterator[bytes]:
    """Parts of at most about `CHUNK` bytes that end where words end."""
    while len(body) > CHUNK:
        cut = max(body.rfind(s, 0, CHUNK) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            break
        yield body[:cut]
        body = body[cut + 1 :]
    yield body


def _at_place(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A random number for each byte and its place in its word, so that no structure of a word cancels out; 0 between words."""
    marks = np.zeros(len(raw), np.int64)
    marks[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(marks)
    near = place < PLACES
    out = _RANDOM[np.where(near, place, 0) << 8 | raw]
    if not near.all():
        out[~near] = mix(mix(place[~near].astype(np.uint64)) + raw[~near])
    out[~inside] = 0
    return out


def word_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the length of every word of a lower-cased text."""
    hashes, lengths = [], []
    for part in _chunks(body):
        raw = np.frombuffer(part, np.uint8)
        inside = np.concatenate([[False], ~_SPACE[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_at_place(raw, starts, inside[1:-1]), dtype=np.uint64)])
        hashes.append(mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64)))
        lengths.append(ends - starts)
    return np.concatenate(hashes), np.concatenate(lengths)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct shingles in their order: the top byte falls with the shingle's length, the rest is a hash."""
    hashes, lengths = word_hashes(text.lower())
    k = min(words, len(hashes))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    mixed, sums = np.full(n, k, np.uint64), np.concatenate([[0], np.cumsum(lengths)])
    for j in range(k):
        mixed += hashes[j : j + n] * _COEFFICIENTS[j]
    rank = (255 - np.minimum(sums[k:] - sums[:-k], 255)).astype(np.uint64)
    return np.unique(rank << np.uint64(56) | mix(mixed) >> np.uint64(8))


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n + 1 - -(-threshold * n // 100)


def set_key(tokens: np.ndarray, text: bytes) -> tuple[int, int]:
    """128 bits, in two halves, of the set's hash."""
    told = hashlib.blake2b(tokens.tobytes(), digest_size=16)
    if len(tokens) <= BY_WORDS:
        words = text.lower().split()
        told.update(b"\n".join(sorted({b" ".join(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))})))
    whole = told.digest()
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def name_of(tokens: np.ndarray, text: bytes, renamed: dict[tuple[int, int], int]) -> int:
    key = set_key(tokens, text)
    return renamed.get(key, key[0])


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of token counts in a power of two of at least 4 n bits."""
    bits = 1 << max(6, (4 * len(tokens) - 1).bit_length())
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def sketch(bits: bytes) -> list[int]:
    """The bitmap folded to 256 bits, as four numbers."""
    words = np.frombuffer(bits, np.int64)
    if len(words) < 4:  # not comparable with a longer one: see SKETCHED
        return [0, 0, 0, 0]
    return np.bitwise_xor.reduce(words.reshape(-1, 4), axis=0).tolist()


def largest_overlap(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """No more tokens than this are in both sets: each bit that differs is due to a token of one only."""
    a, b = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    while len(a) != len(b):
        if len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(a ^ b).sum())) // 2


def signatures(tokens: np.ndarray, boundary: int, frequent: np.ndarray, threshold: int = THRESHOLD, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """2-subsets for a small set, single tokens for a large one or one that may pair with such.

    With each, the largest overlap with a set for which it is the first that both have: what comes before is not shared.
    ``frequent`` shingles come last, in order of their ``place``.
    """
    n = len(tokens)
    p = prefix_length(n, threshold)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = frequent[at] == tokens
        last = tokens[late] if place is None else tokens[late][np.argsort(place[at[late]], kind="stable")]
        tokens = np.concatenate([tokens[~late][: p + 1], last[: p + 1]])
    out, most = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if n <= boundary:
        first, second = np.triu_indices(min(p + 1, n), 1)
        if n == 1:
            return out[0], most[0]  # similar to equal sets only, and those are one class
        low, high = np.minimum(tokens[first], tokens[second]), np.maximum(tokens[first], tokens[second])
        out.append(mix(low * _COEFFICIENTS[0] + high * _COEFFICIENTS[1]) | np.uint64(1))
        most.append(n - second + 1)
    if 100 * n > threshold * boundary:
        out.append(mix(tokens[:p]) & ~np.uint64(1))
        most.append(n - np.arange(min(p, n)))
    return np.concatenate(out), np.concatenate(most)


def holds(n, most, threshold: int = THRESHOLD):
    """Can the overlap be what similarity with a set of at least this size asks for?"""
    return (100 + threshold) * most >= 2 * threshold * n


def choose_boundary(sizes: dict[int, int], collisions: float, threshold: int = THRESHOLD) -> int:
    """The size up to which sets enumerate subsets, with the least cost over all sets of up to `LARGEST_BOUNDARY`."""

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            p = prefix_length(n, threshold)
            total += count * ((comb(min(p + 1, n), 2) if n <= x else 0) + (p * (1 + VERIFY_COST * collisions) if n > x else p if 100 * n > threshold * x else 0))
        return total

    return min(range(LARGEST_BOUNDARY + 1), key=cost)


def _each_set(docs: DataFrame, fields: str, make) -> DataFrame:
    """mapInArrow over (did, text): ``make(did, text, tokens)`` gives rows."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = text.as_py()
                rows += make(did, body, shingles(body))
            yield _record(rows, names, fields)

    return docs.mapInArrow(run, fields)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}


def _record(rows: list[tuple], names: list[str], fields: str) -> pa.RecordBatch:
    kinds = [_ARROW[f.split()[1]] for f in fields.split(", ")]
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names)


def _sets(docs: DataFrame, threshold: int) -> DataFrame:
    """did, n, key, rest, bits and, for small sets, the prefix; rows without bits are frequent shingles: key and, as n, how many sets have it."""
    fields = "did long, n long, key long, rest long, bits binary, sketch array<long>, prefix array<long>"
    names = [f.split()[0] for f in fields.split(", ")]

    def frequent(block: list[np.ndarray]) -> list[tuple]:
        if not block:
            return []
        tokens, counts = np.unique(np.concatenate(block), return_counts=True)
        often = counts >= LOCAL_SETS
        return [(None, c, t, None, None, None, None) for t, c in zip(tokens[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]

    def run(batches):
        block, seen, held = [], set(), 0
        for batch in batches:
            rows = []
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = text.as_py()
                tokens = shingles(body)
                (key, rest), n = set_key(tokens, body), len(tokens)
                bits = bitmap(tokens)
                rows.append((did, n, key, rest, bits, sketch(bits), tokens[: prefix_length(n, threshold)].view(np.int64) if 0 < n <= LARGEST_BOUNDARY else None))
                if key not in seen:
                    seen.add(key)
                    block.append(tokens)
                    held += n
                if held >= BLOCK_SHINGLES:
                    rows += frequent(block)
                    block, seen, held = [], set(), 0
            yield _record(rows, names, fields)
        yield _record(frequent(block), names, fields)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, fields)


def _live(docs: DataFrame, boundary: int, frequent: np.ndarray, place: np.ndarray, renamed: dict, threshold: int) -> DataFrame:
    """(token, key, n, most) of every signature that a class holds and at least one other posts.

    Signatures that are known to be frequent are dealt out by class and kept, so that no task gets one's whole list.
    """
    names = ["token", "key", "n", "most"]
    fields = "token long, key long, n int, most int"
    shared = docs.sparkSession.sparkContext.broadcast((frequent, place, np.sort(mix(frequent) & ~np.uint64(1)), renamed))  # at most FREQUENT values

    def post(batches):
        frequent, place, known, renamed = shared.value
        for batch in batches:
            token, cols = [np.zeros(0, np.uint64)], [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int32)]
            for text in batch.column(1):
                body = text.as_py()
                found = shingles(body)
                if len(found):
                    posted, most = signatures(found, boundary, frequent, threshold, place)
                    token.append(posted)
                    for col, x in zip(cols, (np.full(len(posted), name_of(found, body, renamed)), np.full(len(posted), len(found), np.int32), most.astype(np.int32)), strict=True):
                        col.append(x)
            token, rest = np.concatenate(token), [np.concatenate(c) for c in cols]
            order = np.lexsort((rest[0], token))
            token, rest = token[order], [x[order] for x in rest]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (rest[0][1:] != rest[0][:-1])
            token, rest = token[new], [x[new] for x in rest]
            deal = np.where(np.isin(token, known), mix(token ^ rest[0].view(np.uint64)), token).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token.view(np.int64), *rest, deal)], [*names, "deal"])
        pa.default_memory_pool().release_unused()

    def shared_only(batches):
        """From rows in order of token, who holds, and key: one per class, of lists that one holds and another has too."""
        held = None  # the last row, not yet known to be alone; whether its list had rows before; whether its list is held
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(5)]
            if held is not None:
                cols = [np.concatenate([h, x]) for h, x in zip(held[0], cols, strict=True)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [x[new] for x in cols]
            same = cols[0][1:] == cols[0][:-1]
            before = np.concatenate([[held is not None and held[1]], same])
            first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(before)), 0))
            is_held = holds(cols[2].astype(np.int64), cols[3].astype(np.int64), threshold)[first]
            if held is not None:
                is_held[first == 0] = held[2]
            keep = (is_held & (before | np.concatenate([same, [False]])) | (cols[0] != cols[4]))[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in cols[:4]], names)
            held = [x[-1:] for x in cols], bool(before[-1]), bool(is_held[-1])
        if held is not None and (held[1] and held[2] or held[0][0] != held[0][4]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0][:4]], names)
        pa.default_memory_pool().release_unused()

    posted = docs.mapInArrow(post, fields + ", deal long")
    asks = f"{100 + threshold} * cast(most as long) < {2 * threshold} * cast(n as long)"
    return posted.repartition("deal").sortWithinPartitions("token", F.expr(asks), "key").mapInArrow(shared_only, fields)


def _bounded(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that the sizes and bitmaps leave possible."""
    sides = [classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"]
    fields = "a long, b long"

    def check(batches):
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            rows = []
            for a, b, n_a, bits_a, n_b, bits_b in zip(*cols, strict=True):
                if 100 * min(n_a, n_b) >= threshold * max(n_a, n_b):
                    most = largest_overlap(n_a, bits_a, n_b, bits_b)
                    if 100 * most >= threshold * (n_a + n_b - most):
                        rows.append((a, b))
            yield _record(rows, ["a", "b"], fields)

    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return joined.mapInArrow(check, fields)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, renamed: dict, threshold: int) -> DataFrame:
    """Pairs whose sets are similar: the sets are made anew from one text a class."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes.select("key", "rep"), "key")
    wanted = written(wanted)  # its size is then known: few are sent to the texts, many are met by a shuffle
    texts = docs.join(wanted.select(F.col("rep").alias("did"), "key"), "did").select("key", "text")

    def make(key, text, tokens):
        return [(key, tokens.tobytes())] if name_of(tokens, text, renamed) == key else []

    sets = _each_set(texts, "key long, tokens binary", make).groupBy("key").agg(F.first("tokens").alias("tokens"))
    fields = "a long, b long"

    def compare(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= threshold * (len(x) + len(y) - both):
                    rows.append((a, b))
            yield _record(rows, ["a", "b"], fields)
        pa.default_memory_pool().release_unused()

    with_a = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    found = written(with_b.mapInArrow(compare, fields))
    discard(wanted)
    return found


def _mixed(rows: DataFrame, labels: DataFrame | None, classes: DataFrame, threshold: int, centres: int) -> DataFrame:
    """Rows of the lists that are held and still join different components: each with its component, whether that is the list's largest, whether it holds, its sketch, and whether its list is short: all its pairs are no more than ``centres`` for each row."""
    named = rows.select("token", "key", "n", "most", *(["sketch"] if "sketch" in rows.columns else []))
    if labels is None:
        named = named.withColumn("component", F.col("key"))
    else:
        named = named.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = named.withColumn("holds", holds(F.col("n").cast("long"), F.col("most").cast("long"), threshold))
    counts = named.groupBy("token", "component").agg(F.count("*").alias("count"), F.count_if("holds").alias("held"))
    most = F.max_by(F.struct("component", "count", "held"), F.struct("count", "component")).alias("most")
    lists = counts.groupBy("token").agg(most, F.count("*").alias("parts"), F.sum("count").alias("size"), F.sum("held").alias("held")).where("parts > 1 and held > 0")
    outside = F.col("size") - F.col("most.count")
    pairs = outside * F.col("held") + F.col("most.count") * (F.col("held") - F.col("most.held"))
    lists = lists.select("token", F.col("most.component").alias("major"), (pairs <= centres * F.col("size")).alias("short"))
    out = named.join(lists, "token").withColumn("inside", F.col("component") == F.col("major")).drop("major")
    return written(out if "sketch" in rows.columns else out.join(classes.select("key", "sketch"), "key"))


def _fits(threshold: int):
    sizes = F.col("n") + F.col("n_b")
    near = (100 * F.least("n", "n_b") >= threshold * F.greatest("n", "n_b")) & ((100 + threshold) * F.least("most", "most_b") >= threshold * sizes)
    differ = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(1, 4)), F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("sketch_b")[0])))
    comparable = (F.least("n", "n_b") <= SKETCHED) | ((100 + threshold) * differ <= (100 - threshold) * sizes)
    return near & (F.col("component") != F.col("component_b")) & comparable


def _other(rows: DataFrame) -> DataFrame:
    return rows.select("token", F.col("key").alias("key_b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"), F.col("component").alias("component_b"), F.col("sketch").alias("sketch_b"))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b")).distinct()


def _star(mixed: DataFrame, threshold: int, turn: int, centres: int) -> DataFrame:
    """Classes outside their list's largest component, each with up to ``centres`` classes of the list; the lists choose different ones."""
    chance = F.xxhash64("key", "token", F.lit(turn))
    one = F.min_by(F.struct("key", "n", "most", "component", "sketch"), chance).alias("centre")
    chosen = mixed.groupBy("token", F.pmod(chance, F.lit(centres))).agg(one).select("token", "centre.*")
    return _pairs(mixed.where("not inside").join(_other(chosen), "token").where(_fits(threshold)))


def _between(mixed: DataFrame, threshold: int) -> DataFrame:
    """Askers and holders of one list and different components, the holder the smaller set."""
    smaller = (F.col("n_b") < F.col("n")) | (F.col("n_b") == F.col("n")) & (F.col("key_b") < F.col("key"))
    outside, holders = mixed.where("not inside"), mixed.where("holds")
    joined = outside.join(_other(holders), "token").where(smaller & _fits(threshold)).select("key", "key_b")
    return _pairs(joined.unionByName(mixed.where("inside").join(_other(holders.where("not inside")), "token").where(smaller & _fits(threshold)).select("key", "key_b")))


def _links(live: DataFrame, chosen: DataFrame, classes: DataFrame, renamed: dict, threshold: int) -> DataFrame | None:
    """Components of the classes. A round compares all pairs of short lists, and of long ones each row with some; what is short grows with every round."""
    links, labels, turn, before, rows = None, None, 0, None, live
    while True:
        centres = CENTRES ** (turn + 1)
        mixed = _mixed(rows, labels, classes, threshold, centres)
        if before is not None:
            discard(before)
        if mixed.isEmpty():
            return labels
        rows = mixed.where("not short")
        bounded = written(_bounded(_between(mixed.where("short"), threshold).unionByName(_star(rows, threshold, turn, centres)).distinct(), classes, threshold))
        new = _verified(bounded, chosen, classes, renamed, threshold)
        discard(bounded)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links)
        if rows.isEmpty():
            return labels
        before, turn = mixed, turn + 1


def _named_apart(members: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Members whose key tells their class, and which (key, rest) have another key for that; of 2^32 classes, about one does."""
    several = members.groupBy("key").agg(F.min("rest").alias("first"), F.max("rest").alias("last")).where("first != last").select("key", "first")
    wrong = members.join(F.broadcast(several), "key").where("rest != first").select("key", "rest").distinct().collect()
    if not wrong:
        return members, {}
    renamed = {(r["key"], r["rest"]): int(mix(np.array([r["key"] ^ (r["rest"] | 1)]).view(np.uint64)).view(np.int64)[0]) for r in wrong}
    other = members.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "key long, rest long, other long")
    return members.join(F.broadcast(other), ["key", "rest"], "left").withColumn("key", F.coalesce("other", "key")).drop("other"), renamed


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Per document: id, n_shingles and component_id, the smallest id that links lead to."""
    name, kind, ids = id_col, docs.schema[id_col].dataType.simpleString(), None
    if kind not in ("bigint", "int", "smallint", "tinyint") or not docs.where(F.col(id_col).isNull()).isEmpty():
        number = unused(docs, "_number")  # what tells rows apart is then not their id
        docs, _ = numbered(docs.select(id_col, text_col), id_col, text_col, number)
        ids = docs.select(F.col(number).alias("did"), F.col(id_col).alias("id"))
        id_col = number
    chosen = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("did"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    sets = written(_sets(chosen, threshold))
    members, renamed = _named_apart(sets.where("bits is not null"))
    members = members.withColumn("id", F.col("did").cast(kind)) if ids is None else members.join(ids, "did")
    classes = members.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch"), F.min("did").alias("rep"), F.min("id").alias("least"))
    # bounded: LARGEST_BOUNDARY sizes, one number, FREQUENT shingles
    small = members.where("prefix is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    sizes = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    lists = small.select(F.explode("prefix").alias("token")).groupBy("token").count()
    squares = lists.agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("squares"), F.sum("count").alias("all")).first()
    boundary = choose_boundary(sizes, squares["squares"] / squares["all"] - 1 if squares["all"] else 0.0, threshold)
    common = sets.where("bits is null").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_SETS).orderBy(F.desc("n"), "key").limit(FREQUENT)
    by_count = np.array([r["key"] for r in common.orderBy("n", "key").select("key").collect()], np.int64).view(np.uint64)
    place = np.argsort(by_count, kind="stable")
    live = written(_live(chosen, boundary, by_count[place], place, renamed, threshold))
    labels = _links(live, chosen, classes, renamed, threshold)
    discard(live)
    if labels is None:
        labels = classes.select(F.col("key").alias("node"), F.col("key").alias("component")).limit(0)
    # one row a class; then every document finds its own, and a hot class is a skewed join's matter
    named = written(classes.select("key", "least").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    joined = named.groupBy("component").agg(F.count("*").alias("classes"), F.min("least").alias("component_id")).where("classes > 1")
    linked = written(joined.select("component", "component_id"))
    own = named.join(linked, "component", "left").select("key", F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    found = members.select("id", "n", "key").join(written(own), "key", "left")
    return found.select(F.col("id").alias(name), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The documents, of those that similarity leads between only the first by id (of repeated or null ids, by text); those without words stay."""
    number = unused(docs, "_number")
    rows, _ = numbered(docs, id_col, text_col, number)
    gone = similar(rows, number, text_col, threshold).where((F.col(number) != F.col("component_id")) & (F.col("n_shingles") > 0)).select(number)
    return rows.join(gone, number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
