"""Hierarchical multi-length packing of tokenised documents.

Every document becomes its token ids and one end id. A document is cut into full long windows first; what is left is routed to the
smallest context size (tier) that holds it. Tiers are packed from long to short: a piece opens a window of its tier, the gap is
filled with the largest pieces of shorter tiers that fit, and what then still gapes takes the head of a shorter piece, whose rest
goes back to its tier. Windows that nothing is left to fill are joined and cut into powers of two. So every sequence is exactly as
long as its window, and there is no padding at all.

Sequences of one tier are dealt into step groups of equal token counts, in order of attention cost (the sum of squared piece
lengths), to and fro, so that the steps of a tier cost about the same.

Packing needs no shuffle: a task packs the documents that it reads, `GROUP_TOKENS` at a time, which also bounds its memory. Another
file layout gives other sequences, each as tight.

Edge cases: null and blank texts have the end id alone; repeated rows are packed each; null ids pass through; an empty table gives
no rows; only the named id and text columns are read, so that other columns can't clash.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table

TIERS = (4096, 2048, 1024)
END_ID = 2
#: Tokens that are packed together, characters that are tokenised together, tokens of a training step.
GROUP_TOKENS, BATCH_CHARS, STEP_TOKENS = 1 << 21, 1 << 22, 1 << 16
#: Words that are encoded in one call, and pieces that a task remembers.
WORDS_AT_ONCE, REMEMBERED = 2_000, 1_000_000

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*%&$#]*)").fullmatch
_WORD = re.compile(r"[a-zß-öø-ÿ]+").fullmatch


def load_tokenizer(path: str | None = None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of texts, each different word encoded once.

    The tokenizer drops white space and never joins what stands on both sides of it, so that a text's ids are those of its pieces
    between ASCII white space, one after the other. A piece of letters and the marks behind it is two pre-tokens, again encoded apart;
    these letters have no combining forms, so that their case may be folded first. Other pieces are encoded as they are. Words are
    remembered over batches, up to `REMEMBERED`.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_words = self._has_word_ends()
        self.forget()

    def _has_word_ends(self) -> bool:
        """Does the tokenizer behave as said above? On a text with every kind of piece; others encode whole texts."""
        probe = "Straße ÉCOLE naïve, word; (x) it's 3.5% a-b\n日本 ПРИВЕТ  ñandú!! $9 😀 e\u0301"
        encode = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        pieces = [part for piece in probe.split() for m in [_PLAIN(piece)] for part in ((m[1].lower(), m[2]) if m else (piece,)) if part]
        words = [ids for p in pieces if _WORD(p) for ids in [encode(p)]]
        one_end = all(ids and self.ends[ids[-1]] and not self.ends[ids[:-1]].any() for ids in words)
        return bool(one_end) and encode(probe) == [i for p in pieces for i in encode(p)]

    def forget(self) -> None:
        self.known, self.ids, self.lengths = {"": 0}, [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        self.pieces: dict[str, int] = {}  # to rows of pairs: the word and the marks behind it
        self.pairs = np.zeros((0, 2), np.int64)

    def learn(self, words: list[str], whole: list[str]) -> None:
        """``words`` are one pre-token each, whose last id ends a word; ``whole`` may be any pieces."""
        self.known.update(zip([*words, *whole], range(len(self.known), len(self.known) + len(words) + len(whole)), strict=True))
        parts = [" ".join(words[at : at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)]
        for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False):
            ids = np.array(x.ids, np.uint32)
            self.ids.append(ids)
            self.lengths.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        for at in range(0, len(whole), WORDS_AT_ONCE):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(whole[at : at + WORDS_AT_ONCE], add_special_tokens=False)]
            self.lengths.append(np.array([len(x) for x in found], np.int64))
            self.ids.append(np.fromiter((i for x in found for i in x), np.uint32))
        self.ids, self.lengths = [np.concatenate(self.ids)], [np.concatenate(self.lengths)]
        assert len(self.lengths[0]) == len(self.known)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one vector, and how many each text has."""
        if not self.by_words:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for ids in found for i in ids), np.uint32), np.array([len(ids) for ids in found], np.int64)
        if len(self.pieces) > REMEMBERED:
            self.forget()
        pieces = pc.ascii_split_whitespace(texts)
        coded = pc.list_flatten(pieces).dictionary_encode()
        different = coded.dictionary.to_pylist()
        unseen = [w for w in different if w not in self.pieces]
        split = [(m[1].lower(), m[2]) if m else (w, "") for w, m in zip(unseen, map(_PLAIN, unseen), strict=True)]
        known = self.known
        new = dict.fromkeys(part for pair in split for part in pair if part not in known)
        words = [w for w in new if _WORD(w)]
        self.learn(words, [w for w in new if not _WORD(w)])
        self.pieces.update(zip(unseen, range(len(self.pairs), len(self.pairs) + len(unseen)), strict=True))
        made = np.fromiter((known[part] for pair in split for part in pair), np.int64, 2 * len(split)).reshape(-1, 2)
        self.pairs = np.concatenate([self.pairs, made])
        rows = np.fromiter(map(self.pieces.__getitem__, different), np.int64, len(different))
        codes = self.pairs[rows[coded.indices.to_numpy(zero_copy_only=False)]].ravel()
        vocabulary, lengths = self.ids[0], self.lengths[0]
        first, counts = (np.cumsum(lengths) - lengths)[codes], lengths[codes]
        ends = np.cumsum(counts)
        flat = vocabulary[np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.asarray(pieces.offsets)
        return flat, np.diff(np.concatenate([[0], ends])[2 * (last - last[0])])


class Pool:
    """Pieces (length, document, start) in order of length."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.pieces = sorted(pieces)

    def largest(self, most: int) -> tuple[int, int, int] | None:
        at = bisect_right(self.pieces, (most, 1 << 62, 0))
        return self.pieces.pop(at - 1) if at else None

    def smallest(self) -> tuple[int, int, int] | None:
        return self.pieces.pop(0) if self.pieces else None

    def add(self, piece: tuple[int, int, int]) -> None:
        self.pieces.insert(bisect_left(self.pieces, piece), piece)


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Documents' token counts to sequences, each a list of (document, start, length)."""
    long = max(tiers)
    out, routed = [], {t: [] for t in sorted(tiers, reverse=True)}
    for doc, n in enumerate(lengths):
        out += [[(doc, at, long)] for at in range(0, n - long + 1, long)]
        if rest := n % long:
            routed[min(t for t in tiers if t >= rest)].append((rest, doc, n - rest))
    pools, loose = {t: Pool(x) for t, x in routed.items()}, []
    order = list(pools)
    for k, tier in enumerate(order):
        # a tier fills its gaps from shorter tiers, the shortest from itself
        donors = [pools[t] for t in order[k + 1 :]] or [pools[tier]]
        while opened := pools[tier].largest(tier):
            window, gap = [opened], tier - opened[0]
            for pool in donors:
                while gap and (piece := pool.largest(gap)):
                    window.append(piece)
                    gap -= piece[0]
            if gap and (whole := next(filter(None, (p.smallest() for p in donors)), None)):
                n, doc, at = whole
                window.append((gap, doc, at))
                rest = (n - gap, doc, at + gap)
                pools[min(t for t in order if t >= rest[0])].add(rest)
                gap = 0
            if gap:
                loose += window
            else:
                out.append([(doc, at, n) for n, doc, at in window])
    return out + _powers([(doc, at, n) for n, doc, at in loose], long)


def _powers(pieces: list[tuple[int, int, int]], long: int) -> list[list[tuple[int, int, int]]]:
    """The pieces, one after the other, cut into long windows and the powers of two that add up to the rest."""
    left = sum(n for _, _, n in pieces)
    sizes = [long] * (left // long) + [1 << b for b in reversed(range(long.bit_length())) if (left % long) >> b & 1]
    out, todo = [], pieces[::-1]
    for size in sizes:
        window = []
        while size:
            doc, at, n = todo.pop()
            if n > size:
                todo.append((doc, at + size, n - size))
                n = size
            window.append((doc, at, n))
            size -= n
        out.append(window)
    return out


def step_groups(sequences: list[list[tuple[int, int, int]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each sequence: one length a group, equal token counts, about equal attention costs."""
    by_size: dict[int, list[int]] = {}
    for k, window in enumerate(sequences):
        by_size.setdefault(sum(n for _, _, n in window), []).append(k)
    group, out = 0, [0] * len(sequences)
    for size, members in sorted(by_size.items(), reverse=True):
        members.sort(key=lambda k: (-sum(n * n for _, _, n in sequences[k]), k))
        groups = -(-len(members) * size // step_tokens)
        for j, k in enumerate(members):
            lap, at = divmod(j, groups)
            out[k] = group + (at if lap % 2 == 0 else groups - 1 - at)
        group += groups
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, tokenizer_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, step_group, and ids if asked for."""
    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = pa.int64() if chosen.schema[0].dataType.simpleString() == "bigint" else None
    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"
    fields = f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, {fields}" + ", ids array<int>" * with_ids

    def emit(ids: list, tokens: list[np.ndarray], number: int) -> tuple[pa.RecordBatch, int]:
        sequences = plan([len(x) for x in tokens], tiers)
        cols: list[list] = [[] for _ in range(9 + with_ids)]
        for k, (window, group) in enumerate(zip(sequences, step_groups(sequences), strict=True)):
            offset, size = 0, sum(n for _, _, n in window)
            for doc, start, n in window:
                part = tokens[doc][start : start + n]
                row = (ids[doc], start, n, zlib.crc32(part.astype("<u4").tobytes()), len(tokens[doc]), number + k, offset, size, number + group)
                for col, value in zip(cols, row, strict=False):
                    col.append(value)
                if with_ids:
                    cols[9].append(part.astype(np.int32))
                offset += n
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group", "ids"]
        arrays = [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:9]], *[pa.array(c, pa.list_(pa.int32())) for c in cols[9:]]]
        return pa.RecordBatch.from_arrays(arrays, names[: len(arrays)]), number + len(sequences)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        encode, number = Encoder(tokenizer), TaskContext.get().partitionId() << 32
        small = np.uint16 if max(end_id + 1, tokenizer.get_vocab_size(with_added_tokens=True)) <= 1 << 16 else np.uint32
        ids, tokens, held = [], [], 0
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS, "right")))
                flat, counts = encode(texts[at:end])
                ends = np.cumsum(counts)
                for doc, stop, n in zip(batch.column(0)[at:end].to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                    ids.append(doc)
                    tokens.append(np.append(flat[stop - n : stop], end_id).astype(small))
                    held += n + 1
                    if held >= GROUP_TOKENS:
                        out, number = emit(ids, tokens, number)
                        yield out
                        ids, tokens, held = [], [], 0
                at = end
        if ids:
            yield emit(ids, tokens, number)[0]

    return chosen.mapInArrow(packed, fields)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
