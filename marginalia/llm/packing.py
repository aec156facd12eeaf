"""Operator 9: hierarchical packing of tokenized documents into sequences of several lengths.

The documents that a task reads are gathered into shards of about `SHARD_TOKENS` tokens. In a shard each document is cut
into whole windows of the longest tier and a rest, and the rest is routed to the shortest tier that holds it. From the
longest tier down, each rest opens a window of its tier, whose gap is filled with the longest rests of shorter tiers that
fit; what is left is filled with a cut of a shorter tier's rest. The shortest tier is laid end to end. Windows that
nothing can fill are cut into powers of two, so that no sequence needs padding. Sequences are then grouped into steps of
nearly equal token counts (longest first, each to the lightest step).

No row is shuffled: a shard is packed where it was read, and ids never leave the worker. Memory is that of a shard
and of the longest document. A sequence's number holds the task's number, the shard's and its own.

Cases: null or empty text: only the end id; repeated rows and equal doc_ids are packed separately; an empty table: no
rows; a document longer than a shard makes a shard of its own; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import table, utf8

TIERS = (512, 1024, 2048, 4096)
SHARD_TOKENS = 1 << 21
STEP_TOKENS = 8 * 4096
END_ID = 2
#: Bytes of text that are tokenized side by side.
TOGETHER = 4 << 20
#: Words and pieces of a worker's cache (about 150 bytes each); a fuller one is emptied.
CACHE = 400_000
#: Stands for the end of a document among its words; no word holds a space.
END = b" "
#: A word with other characters than these, or with upper case, is left to the tokenizer whole.
PLAIN_LETTERS = "a-z\u00df-\u00f6\u00f8-\u024f\u0430-\u045f"
PUNCTUATION = r"!-&(-/:-@\[-`{-~"
UNPLAIN = re.compile(f"[^{PLAIN_LETTERS}0-9{PUNCTUATION}]|<\\|")
#: What the tokenizer parts a plain word into, and the line ends between words.
PIECE = re.compile(f"[{PLAIN_LETTERS}]+|[0-9]|[{PUNCTUATION}]+|\n")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_id long"


class Ragged:
    """Runs of ids, numbered in the order in which they were added."""

    def __init__(self):
        self.ids, self.ends = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64)
        self.n = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        ends = np.cumsum(lengths) + self.ends[self.n]
        self.ids = _placed(self.ids, int(self.ends[self.n]), ids)
        self.ends = _placed(self.ends, self.n + 1, ends)
        self.n += len(lengths)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs end to end, and each one's length."""
        first = self.ends[numbers]
        lengths = self.ends[numbers + 1] - first
        at = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return self.ids[at], lengths


def _placed(into: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    if at + len(more) > len(into):
        into = np.concatenate([into, np.zeros(max(len(into), len(more)), into.dtype)])
    into[at : at + len(more)] = more
    return into


class WordIds(dict):
    """The number of each run between ASCII white space, whose ids are kept under it.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its runs in order, and a
    plain run's ids are those of its pieces. Pieces are encoded many at once: the last id of each, and no other, ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.words, self.pieces, self.piece = Ragged(), Ragged(), {}
        self.new: list[bytes] = []
        self[END] = 0
        self.words.add(np.array([END_ID]), np.array([1]))

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 500):
            own = pieces[i : i + 500]
            ids = np.array(self._encode([" ".join(own)])[0], np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(own):
                each = self._encode(own)
                ids, ends = np.array([x for e in each for x in e], np.int64), np.cumsum([len(e) for e in each])
            for piece in own:
                self.piece[piece] = len(self.piece)
            self.pieces.add(ids, np.diff(np.r_[0, ends]))

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [not UNPLAIN.search(t) and (t.isascii() or (t == t.lower() and unicodedata.is_normalized("NFC", t))) for t in texts]
        parts = PIECE.findall("\n".join(t for t, p in zip(texts, plain) if p))
        self._learn_pieces([x for x in dict.fromkeys(parts) if x != "\n" and x not in self.piece])
        cut = np.array([x == "\n" for x in parts], bool)
        ids, lengths = self.pieces.take(np.array([self.piece[x] for x in parts if x != "\n"], np.int64))
        own = np.bincount(np.cumsum(cut)[~cut], lengths, minlength=sum(plain)).astype(np.int64)
        rest = [e for i in range(0, len(words), 20_000) for e in self._encode([t for t, p in zip(texts[i : i + 20_000], plain[i : i + 20_000]) if not p])]
        if rest:  # back into the words' order
            every = Ragged()
            every.add(np.r_[ids, np.array([x for e in rest for x in e], np.int64)], np.r_[own[: sum(plain)], [len(e) for e in rest]].astype(np.int64))
            order = np.argsort(np.r_[np.flatnonzero(plain), np.flatnonzero(~np.array(plain))])
            ids, own = every.take(order)
        self.words.add(ids, own[: len(words)])

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self) + len(self.piece) > CACHE:
            self._forget()
        runs = [(t if b"<|" in t else t.lower()).split() for t in texts]  # lower case is the tokenizer's own first step, but for special strings
        for r in runs:
            r.append(END)
        sizes = np.array([len(r) for r in runs])
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(runs)), np.int64, int(sizes.sum()))
        if self.new:
            self._learn(self.new)
            self.new = []
        ids, lengths = self.words.take(numbers)
        ends = np.cumsum(lengths)[np.cumsum(sizes) - 1] if len(sizes) else sizes
        yield from (ids[i:j] for i, j in zip(np.r_[0, ends[:-1]], ends))


_CACHES: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's cache for a vocabulary file."""
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


Piece = tuple[int, int, int]  # document, first id, ids


def powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces (document, start, length) that hold every id of documents of these lengths once.

    Each sequence's length is one of the tiers, or a smaller power of two.
    """
    top = tiers[-1]
    out: list[list[Piece]] = []
    pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # by tier: (length, document, start), shortest first
    for d, n in enumerate(lengths):
        whole = n - n % top
        out += [[(d, at, top)] for at in range(0, whole, top)]
        if n > whole:
            pools[next(k for k, t in enumerate(tiers) if n - whole <= t)].append((n - whole, d, whole))
    for pool in pools:
        pool.sort()

    def shorter(k: int, gap: int) -> tuple[int, int, int] | None:
        """The longest rest of the tiers below k that fits."""
        for pool in reversed(pools[:k]):
            if at := bisect_right(pool, (gap, 1 << 62, 0)):
                return pool.pop(at - 1)
        return None

    def cut(k: int, gap: int) -> Piece | None:
        """gap ids off a rest below tier k, of which the remainder goes back to its pool."""
        for pool in pools[:k]:
            if pool and pool[-1][0] > gap:
                n, d, start = pool.pop()
                rest = n - gap
                insort(pools[next(j for j, t in enumerate(tiers) if rest <= t)], (rest, d, start + gap))
                return d, start, gap
        return None

    tail: list[Piece] = []
    for k in range(len(tiers) - 1, 0, -1):
        while pools[k]:
            n, d, start = pools[k].pop()
            window, gap = [(d, start, n)], tiers[k] - n
            while gap and (fit := shorter(k, gap)):
                window.append((fit[1], fit[2], fit[0]))
                gap -= fit[0]
            if gap and (piece := cut(k, gap)):
                window.append(piece)
                gap = 0
            if gap:
                tail += window
            else:
                out.append(window)
    tail += [(d, start, n) for n, d, start in reversed(pools[0])]
    left = sum(n for _, _, n in tail)
    base = tiers[0] if left < top else top
    sizes = [base] * (left // base) + powers(left % base)
    window, at = [], 0
    for d, start, n in tail:
        while n:
            take = min(n, sizes[at] - sum(p[2] for p in window))
            window.append((d, start, take))
            start, n = start + take, n - take
            if sum(p[2] for p in window) == sizes[at]:
                out.append(window)
                window, at = [], at + 1
    return out


def steps(sizes: list[int], tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each sequence, so that steps hold nearly equal token counts."""
    n = max(1, round(sum(sizes) / tokens))
    light, out = [(0, i) for i in range(n)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, step = heapq.heappop(light)
        out[i] = step
        heapq.heappush(light, (load + sizes[i], step))
    return out


def _packed(docs: list[tuple[int, np.ndarray]], first: int) -> pa.RecordBatch:
    sequences = pack([len(ids) for _, ids in docs])
    sizes = [sum(p[2] for p in s) for s in sequences]
    rows = []
    for i, (s, step) in enumerate(zip(sequences, steps(sizes))):
        offset = 0
        for d, start, n in s:
            doc_id, ids = docs[d]
            rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), first + i, offset, sizes[i], first + step))
            offset += n
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)


def _tokenized(ids: WordIds, names: list, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Documents with their ids, tokenized side by side as long as they hold TOGETHER bytes at most."""
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= TOGETHER:
            size += len(texts[last])
            last += 1
        yield from zip(names[first:last], ids.ids(texts[first:last]))
        first = last


def pack_documents(docs: DataFrame, vocabulary: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece: SCHEMA."""

    def run(batches):
        ids, task = word_ids(vocabulary), TaskContext.get().partitionId()
        held, tokens, shard = [], 0, 0
        for batch in batches:
            for doc_id, own in _tokenized(ids, batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, own))
                tokens += len(own)
                if tokens >= shard_tokens:
                    yield _packed(held, task << 44 | shard << 28)
                    held, tokens, shard = [], 0, shard + 1
        if held:
            yield _packed(held, task << 44 | shard << 28)

    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
