"""Operator 11: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The library's model is built from a file of ranks: a token's bytes are written in the byte-level alphabet, one character a
byte, and every way to part a token into two others is a merge of its rank; a piece that is a token itself is taken whole.
So ids are those of the ranks. A text is cut before each white space that follows another character, where the library's
pattern cuts too, and the library encodes each distinct part once; a part's ids are found again by its hash, and what
they decode to is compared with the text. Offsets come from the tokens' bytes and a map from bytes to characters. Decoding
looks up each id's bytes by the reversed alphabet, so that characters which several tokens share come back whole.

A worker holds the vocabulary and at most about `CACHE` parts' ids; nothing is shuffled.

Cases: null text: empty, no ids; bytes that aren't UTF-8 (which Spark's readers can bring): replaced by U+FFFD before
encoding; repeated rows: each its own; an id outside the vocabulary cannot be decoded and is an error; an empty table: no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import SPACE, side_by_side, span_hashes, table, utf8

#: Bytes of text that are encoded side by side.
TOGETHER = 4 << 20
#: Parts that a worker remembers (about 40 bytes each), before it forgets them all.
CACHE = 1_000_000
#: White space beyond ASCII, as the numbers of its UTF-8 bytes.
WIDE_SPACE = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

ENCODED = "ids array<int>, starts array<int>, ends array<int>"


def alphabet() -> list[str]:
    """The byte-level alphabet: visible Latin-1 characters stand for their bytes, the others' are U+0100 and on, in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in shown]
    out = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Runs:
    """Runs of numbers under their own numbers: 0, 1, 2 and on, as they were added."""

    def __init__(self, kind: type):
        self.held, self.ends, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), 0

    def add(self, held: np.ndarray, lengths: np.ndarray) -> None:
        at = int(self.ends[self.n])
        self.held = self._put(self.held, at, held)
        self.ends = self._put(self.ends, self.n + 1, at + np.cumsum(lengths))
        self.n += len(lengths)

    @staticmethod
    def _put(into: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
        if at + len(more) > len(into):
            into = np.concatenate([into, np.zeros(max(len(into), len(more)), into.dtype)])
        into[at : at + len(more)] = more
        return into

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These runs end to end, and each one's length."""
        first = self.ends[numbers]
        lengths = self.ends[numbers + 1] - first
        at = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return self.held[at], lengths


def parts_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes end to end, where parts start and end, and whose they are.

    A text is cut before each ASCII white space that follows another character than white space.
    """
    a = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    white = SPACE[a]
    cut = np.r_[False, white[1:] & ~white[:-1]][: len(a)]
    at = np.flatnonzero(cut)
    wide = at[a[at - 1] >= 0x80]  # behind a character of several bytes: is it white space?
    two = a[wide - 2].astype(np.int64) << 8 | a[wide - 1]
    three = a[np.maximum(wide, 3) - 3].astype(np.int64) << 16 | two
    cut[wide[np.isin(two, WIDE_SPACE) | np.isin(three, WIDE_SPACE)]] = False
    begins = (np.cumsum(sizes) - sizes)[sizes > 0]
    cut[begins] = True
    starts = np.flatnonzero(cut)
    owner = np.flatnonzero(sizes > 0)[np.searchsorted(begins, starts, "right") - 1] if len(starts) else starts
    return a, starts, np.r_[starts[1:], len(a)][: len(starts)], owner


class Table:
    """The bytes of each id, by the reversed alphabet."""

    def __init__(self, path: str):
        letters = alphabet()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.spelled = {"".join([letters[b] for b in t]): r for t, r in read_ranks(path).items()}
        bytes_of = [b""] * (max(self.spelled.values()) + 1)
        for token, i in self.spelled.items():
            bytes_of[i] = bytes([self.byte_of[c] for c in token])
        self.width = np.array([len(b) for b in bytes_of])
        self.tokens = Runs(np.uint8)
        self.tokens.add(np.frombuffer(b"".join(bytes_of), np.uint8), self.width)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.width) and self.width[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.tokens.take(ids)[0].tobytes()

    def pieces(self, ids: np.ndarray) -> list[str]:
        """Each token's text; a character that several tokens share is the last one's, bytes of no character are U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.decode(ids[i : i + 1]), i == len(ids) - 1) for i in range(len(ids))]


class Codec(Table):
    """Encodes parts of texts and keeps their ids under the parts' hashes.

    What ids a hash stands for is not trusted: they are decoded, and a text that they don't give is encoded as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        of = self.spelled
        merges = [(t[:i], t[i:]) for t in sorted(of, key=of.__getitem__) for i in range(1, len(t)) if t[:i] in of and t[i:] in of]
        self.tokenizer = Tokenizer(models.BPE(vocab=of, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.numbers, self.parts = np.zeros(0, np.uint64), np.zeros(0, np.int64), Runs(np.int32)

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        """Encodes new parts, whose hashes rise: those that white space opens and none closes stand end to end, as the pattern cuts between them."""
        runs = np.array([SPACE[p[0]] and not p.decode()[-1].isspace() for p in parts], bool)
        for own, joined in ((np.flatnonzero(runs), True), (np.flatnonzero(~runs), False)):
            for group in side_by_side([parts[i] for i in own]):
                if joined:
                    ids = self._plain([b"".join(group)])[0]
                    ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p) for p in group])) + 1
                    lengths = np.diff(np.r_[0, ends])
                else:
                    found = self._plain(group)
                    ids, lengths = np.concatenate(found), np.array([len(f) for f in found])
                self.parts.add(ids, lengths)
            at = np.searchsorted(self.hashes, hashes[own])
            self.hashes = np.insert(self.hashes, at, hashes[own])
            self.numbers = np.insert(self.numbers, at, np.arange(self.parts.n - len(own), self.parts.n))

    def _numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number kept under each hash, and whether there is one."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return (self.numbers[at], self.hashes[at] == hashes) if len(self.hashes) else (at, np.zeros(len(at), bool))

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids. Texts are UTF-8."""
        if self.parts.n > CACHE:
            self._forget()
        if not any(texts):
            return [np.zeros(0, np.int32)] * len(texts)
        a, starts, ends, owner = parts_of(texts)
        hashes, first, again = np.unique(span_hashes(a, starts, ends), return_index=True, return_inverse=True)
        numbers, known = self._numbers(hashes)
        if not known.all():
            raw = a.tobytes()
            new = first[~known]
            self._learn(hashes[~known], [raw[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist())])
            numbers, _ = self._numbers(hashes)
        ids, lengths = self.parts.take(numbers[again])
        cuts = np.r_[0, np.cumsum(np.bincount(owner, lengths, len(texts)).astype(np.int64))]
        out = [ids[i:j] for i, j in zip(cuts, cuts[1:])]
        if self.decode(ids) == b"".join(texts):
            return out
        return [x if self.decode(x) == t else self._plain([t])[0] for x, t in zip(out, texts)]

    def offsets(self, ids: list[np.ndarray], texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Starts and ends (code points, end exclusive) of tokens: of the characters of their first and last bytes."""
        a = np.frombuffer(b"".join(texts), np.uint8)
        char = np.cumsum((a & 0xC0) != 0x80) - 1
        last = np.cumsum(self.width[np.concatenate(ids)]) if ids else np.zeros(0, np.int64)
        starts, ends = char[np.r_[0, last[:-1]]] if len(last) else last, char[last - 1] + 1
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.r_[char, len(a) and char[-1] + 1][np.cumsum(sizes) - sizes]
        counts = np.array([len(x) for x in ids], np.int64)
        cuts = np.cumsum(counts)[:-1]
        return tuple(np.split((x - np.repeat(base, counts)).astype(np.int32), cuts) for x in (starts, ends))


@cache
def table_of(path: str) -> Table:
    """This worker's table of a file of ranks."""
    return Table(path)


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def _lists(runs: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(runs) if runs else np.zeros(0, np.int32), pa.int32()))


def encode_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, and of each text's tokens ids, starts and ends (code points, end exclusive)."""

    def run(batches):
        own = codec(ranks)
        for b in batches:
            rows, first = b.column(1).to_pylist(), 0
            for texts in side_by_side(rows, TOGETHER):
                texts = [t if valid(t) else t.decode("utf-8", "replace").encode() for t in texts]
                ids = own.ids(texts)
                columns = [_lists(x) for x in (ids, *own.offsets(ids, texts))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), *columns], ["doc_id", "ids", "starts", "ends"])
                first += len(texts)

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ENCODED}")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """The columns of encoded with decoded (the bytes of each row's ids) behind them."""
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        own = table_of(ranks)
        for b in batches:
            column = b.column("ids")
            ids, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            decoded = [own.decode(ids[i:j]) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(decoded, pa.binary())], [*names, "decoded"])

    kept = encoded.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, decoded binary")


def _digests(encoded: DataFrame, ranks: str) -> DataFrame:
    """Of each row's ids their number, their hash as little-endian unsigned 32-bit integers, that of the bytes they decode to, and the number of tokens that begin within a character."""

    def run(batches):
        own = table_of(ranks)
        for b in batches:
            column, starts, ends = b.column("ids"), b.column("starts").values.to_numpy(), b.column("ends").values.to_numpy()
            ids, cuts, rows = column.values.to_numpy(), column.offsets.to_numpy(), []
            for i, j in zip(cuts, cuts[1:]):
                shared = int((starts[i + 1 : j] < ends[i : j - 1]).sum()) if j > i else 0
                rows.append((int(j - i), hashlib.sha256(ids[i:j].astype("<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids[i:j])).hexdigest(), shared))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_shared"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_shared long")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return _digests(encode_documents(table(spark, sf_dir, "documents"), ranks), ranks)
