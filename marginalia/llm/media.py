"""Operator 3: a media column: texts' bytes stored as lossless WebP images, read back, and described.

A payload, padded with spaces to a multiple of 192 bytes, fills rows of 64 pixels of red, green and blue. A file holds at
most FRAME_ROWS rows; longer payloads are several files end to end, so any length is stored, and memory and steps of
decoding are those of small images. The digests and the feature are computed from the pixels that the decoder gives back.

Cases: null or empty text: one row of spaces; equal texts give equal values; repeated rows: each its own; an empty
table: no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import table, utf8
from marginalia.llm.webp import decode, encode_rgb

ROW = 192
FRAME_ROWS = 32
#: Bytes of payload that are encoded and decoded side by side.
GROUP = 8 << 20


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW if text else ROW)


def _parts(frames: list) -> list[list]:
    """Frames, GROUP bytes of payload at most at a time: what is coded side by side stays bounded however long a text is."""
    n = GROUP // (ROW * FRAME_ROWS)
    return [frames[i : i + n] for i in range(0, len(frames), n)]


def _rgb(x: np.ndarray) -> np.ndarray:
    return np.stack([x >> np.uint32(s) & np.uint32(255) for s in (16, 8, 0)], 2).astype(np.uint8)


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload's files, end to end."""
    frames, counts = [], []
    for p in payloads:
        x = np.frombuffer(p, np.uint8).reshape(-1, ROW // 3, 3)
        own = [x[i : i + FRAME_ROWS] for i in range(0, len(x), FRAME_ROWS)]
        frames += own
        counts.append(len(own))
    files, ends = [f for own in _parts(frames) for f in encode_rgb(own)], np.cumsum(counts)
    return [b"".join(files[e - n : e]) for e, n in zip(ends, counts)]


def files_of(media: bytes) -> list[bytes]:
    """The files that stand end to end."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at:end])
        at = end
    return out


def read(media: list[bytes]) -> list[np.ndarray]:
    """Pixel arrays [rows, 64, 3] of each."""
    files = [files_of(m) for m in media]
    images = [_rgb(x) for own in _parts([f for own in files for f in own]) for x in decode(own)]
    out, at = [], 0
    for own in files:
        out.append(np.concatenate(images[at : at + len(own)]))
        at += len(own)
    return out


def feature(pixels: np.ndarray) -> str:
    """Rows, distinct bytes, and of each channel the mean and the entropy in bits."""
    flat = pixels.reshape(-1, 3)
    counts = np.stack([np.bincount(flat[:, c], minlength=256) for c in range(3)])
    share = counts / len(flat)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    means = (counts * np.arange(256)).sum(1) / len(flat)
    return f"rows={len(pixels)};distinct={int((counts.sum(0) > 0).sum())};mean={','.join(f'{m:.3f}' for m in means)};entropy={','.join(f'{e:.3f}' for e in entropy)}"


def _grouped(texts: list[bytes]):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored files)."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            media = [m for own in _grouped(texts) for m in store([payload(t) for t in own])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe_media(stored: DataFrame) -> DataFrame:
    """The columns of stored but media, and READ, from the pixels read back."""
    kept = [c for c in stored.columns if c != "media"]

    def run(batches):
        for b in batches:
            media, rows = b.column("media").to_pylist(), []
            for own in _grouped(media):
                for m, pixels in zip(own, read(own)):
                    p = pixels.tobytes()
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(x, k) for x, k in zip(columns, kinds))], [*kept, *(c.split()[0] for c in READ.split(", "))])

    schema = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in kept)
    return stored.mapInArrow(run, f"{schema}, {READ}")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(media_column(table(spark, sf_dir, "documents")))
