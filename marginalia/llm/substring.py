"""Operator 8: removal of repeated word windows, by level-wise doubling.

A window of 20 words can be repeated only if its halves of 10 are, so windows are first looked at by length `FIRST`: of
the shorter windows in each long one the one with the least hash stands for it (equal windows have equal ones), and only
long windows whose shorter one is repeated at that length alone are extended to the full length and compared. At the
last level each window's first place (least doc_id, then start) is found, and the words of later windows go.

At the first level a task sends, in one block for each bucket, a 32-bit hash (beside the bucket's own bits: more
buckets, more bits) and its first place; that a hash is repeated within the task's batch is known there and not sent.
False matches only make candidates. The last level compares 64 bits beside the bucket's, taken from another hash, again
with one place for each batch: the later places in a batch are decided where they are read. So a passage that a third of
all documents share sends one entry for each 2,000 documents. Texts travel compressed.

Cases: null or empty text: no words; fewer words than a window: all kept; overlapping repeats within a document: the
later ones go; rows of equal doc_id are one document (windows of equal start are at one place), so repeated rows
stay as they are; null doc_id: counts as the least; an empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import mixed, partitions, saved, table, utf8, window_hashes, word_hashes

WINDOW = 20
FIRST = 10
LEAST_ID = -(1 << 63)
#: Seed of the hash that deals windows to buckets at the last level.
DEAL = 0x6A09E667


def sliding(x: np.ndarray, k: int, pick=np.minimum) -> np.ndarray:
    """The least (or greatest) of each k neighbours, by doubling."""
    width = 1
    while 2 * width <= k:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (k - width)], x[k - width :]) if k > width else x


def anchors(words: np.ndarray, window: int = WINDOW, first: int = FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shorter windows; the least one in each long window; which of them stand for some long window."""
    short = window_hashes(words, first)
    k = window - first + 1
    least = sliding(short, k)
    pad = np.zeros(k - 1, np.uint64)
    return short, least, sliding(np.concatenate([pad, least, pad]), k, np.maximum) == short


def _blobs(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket: its entries' columns as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, np.int64)
    cells = [pa.array([x[order[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int64)), *cells], ["bucket", *columns])


PLACES = "part long, doc binary, key binary, at binary"


def _part(doc: np.ndarray, key: np.ndarray, parts: int) -> np.ndarray:
    """Where a document's texts and places meet."""
    return (mixed(doc.view(np.uint64) ^ (key.view(np.uint64) >> np.uint64(1))) % np.uint64(parts)).astype(np.int64)


def _places(doc: np.ndarray, key: np.ndarray, at: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part: the documents and starts of its places as bytes."""
    out = _blobs(_part(doc, key, parts), {"doc": doc, "key": key, "at": at.astype(np.int32)})
    return out.rename_columns(["part", "doc", "key", "at"])


def _by_document(places: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Starts of each document."""
    if not len(places):
        return {}
    doc, key, at = _columns(places, {"doc": np.int64, "key": np.int64, "at": np.int32})
    order = np.lexsort((key, doc))
    doc, key, at = doc[order], key[order], at[order]
    cut = np.r_[np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]), len(doc)]
    return {(int(doc[i]), int(key[i])): at[i:j] for i, j in zip(cut[:-1], cut[1:])}


def _flat(sizes: list[int], values) -> np.ndarray:
    return np.repeat(np.array(values, np.int64), sizes)


def _first_level(batches, buckets: int, ask: bool, window: int, first: int):
    """ask: blobs of each hash's first place; else: the places of hashes that are repeated within the batch."""
    for b in batches:
        ids, keys, sig, at = b.column(0).to_pylist(), b.column(1).to_pylist(), [], []
        for words in word_hashes(b.column(2).to_pylist()):
            if len(words) < window:
                sig.append(np.empty(0, np.uint64)), at.append(np.empty(0, np.int64))
                continue
            short, _, stands = anchors(words, window, first)
            at.append(np.flatnonzero(stands))
            sig.append(short[at[-1]])
        sizes = [len(x) for x in sig]
        if not sum(sizes):
            continue
        doc, key, sig, at = _flat(sizes, ids), _flat(sizes, keys), np.concatenate(sig), np.concatenate(at)
        _, one, back, n = np.unique(sig, return_index=True, return_inverse=True, return_counts=True)
        if ask:
            s = sig[one]
            yield _blobs(((s >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), {"sig": s.astype(np.uint32), "doc": doc[one], "key": key[one], "at": at[one].astype(np.int32)})
        else:
            yield _places(*(x[n[back] > 1] for x in (doc, key, at)), buckets)


def _columns(group: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, kind) for x in group[name].to_pylist()]) for name, kind in kinds.items()]


def _repeated(group: pa.Table, parts: int) -> pa.Table:
    sig, doc, key, at = _columns(group, {"sig": np.uint32, "doc": np.int64, "key": np.int64, "at": np.int32})
    _, back, n = np.unique(sig, return_inverse=True, return_counts=True)
    many = n[back] > 1
    return pa.Table.from_batches([_places(doc[many], key[many], at[many], parts)])


def _later(group: pa.Table, parts: int) -> pa.Table:
    """Of each hash the places but the first."""
    sig, doc, key, at = _columns(group, {"sig": np.uint64, "doc": np.int64, "key": np.int64, "at": np.int32})
    keep = _not_first(sig, doc, at)
    return pa.Table.from_batches([_places(doc[keep], key[keep], at[keep], parts)])


def _not_first(sig: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where an equal hash has an earlier place."""
    order = np.lexsort((at, doc, sig))
    s, d, a = sig[order], doc[order], at[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.zeros(len(sig), bool)
    out[order] = (d != d[head]) | (a != a[head])
    return out


def _last_level(docs: pa.Table, places: pa.Table, buckets: int, ask: bool, window: int, first: int) -> pa.Table:
    """Candidates' full windows. ask: blobs of the first place of each in the part; else: its later places."""
    unpack, starts = zstandard.ZstdDecompressor(), _by_document(places)
    ids, keys, sig, deal, at = [], [], [], [], []
    marked_docs = [x for x in zip(*(docs[k].to_pylist() for k in ("doc_id", "key", "z"))) if (x[0], x[1]) in starts]
    for (doc_id, key, _), words in zip(marked_docs, word_hashes([unpack.decompress(x[2]) for x in marked_docs])):
        own = starts[doc_id, key]
        short, least, _ = anchors(words, window, first)
        marked = np.full(len(short), np.iinfo(np.uint64).max, np.uint64)
        marked[own] = short[own]
        at.append(np.flatnonzero(sliding(marked, window - first + 1) == least))
        sig.append(window_hashes(words, window)[at[-1]])
        deal.append(window_hashes(words, window, DEAL)[at[-1]])
        ids.append(doc_id), keys.append(key)
    sizes = [len(x) for x in sig]
    joined = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    doc, key, sig, deal, at = _flat(sizes, ids), _flat(sizes, keys), joined(sig, np.uint64), joined(deal, np.uint64), joined(at, np.int64)
    later = _not_first(sig, doc, at)
    if ask:
        out = _blobs((deal[~later] % np.uint64(buckets)).astype(np.int64), {"sig": sig[~later], "doc": doc[~later], "key": key[~later], "at": at[~later].astype(np.int32)})
    else:
        out = _places(doc[later], key[later], at[later], buckets)
    return pa.Table.from_batches([out])


def _packed(batches, parts: int):
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        part = _part(b.column(0).to_numpy(), b.column(1).to_numpy(), parts)
        yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0), b.column(1), pa.array([pack.compress(t) for t in b.column(2).to_pylist()], pa.binary())], ["part", "doc_id", "key", "z"])


def _kept(docs: pa.Table, places: pa.Table, window: int) -> pa.Table:
    unpack, starts = zstandard.ZstdDecompressor(), _by_document(places)
    n, gone, kept = [], [], []
    for doc_id, key, z in zip(*(docs[k].to_pylist() for k in ("doc_id", "key", "z"))):
        words = unpack.decompress(z).split()
        n.append(len(words))
        if (at := starts.get((doc_id, key))) is not None:
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
        gone.append(n[-1] - len(words))
        kept.append(b" ".join(words))
    return pa.table([docs["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.large_binary() if sum(map(len, kept)) >> 31 else pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space, as bytes)."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), utf8("text").alias("text"))
    packed = rows.mapInArrow(partial(_packed, parts=n), "part long, doc_id long, key long, z binary").groupBy("part")
    blobs = "bucket long, sig binary, doc binary, key binary, at binary"
    how = {"buckets": n, "window": window, "first": first}

    def repeated(group: pa.Table) -> pa.Table:
        return _repeated(group, n)

    def later(group: pa.Table) -> pa.Table:
        return _later(group, n)

    def asked(docs: pa.Table, places: pa.Table) -> pa.Table:
        return _last_level(docs, places, ask=True, **how)

    def known(docs: pa.Table, places: pa.Table) -> pa.Table:
        return _last_level(docs, places, ask=False, **how)

    def kept(docs: pa.Table, places: pa.Table) -> pa.Table:
        return _kept(docs, places, window)

    short = rows.mapInArrow(partial(_first_level, ask=True, **how), blobs).groupBy("bucket").applyInArrow(repeated, PLACES)
    candidates = saved(short.union(rows.mapInArrow(partial(_first_level, ask=False, **how), PLACES)))
    full = packed.cogroup(candidates.groupBy("part"))
    removed = saved(full.applyInArrow(asked, blobs).groupBy("bucket").applyInArrow(later, PLACES).union(full.applyInArrow(known, PLACES)))
    out = packed.cogroup(removed.groupBy("part")).applyInArrow(kept, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {LEAST_ID})"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
