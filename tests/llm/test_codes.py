"""Byte-level BPE against the rank file's own library, resampling and vector codes against plain Python and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe, resampling, vector_codes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "\n\n", "  two  spaces \n and\tlines\n", "naïve 日本語 🙂🙂 é", "don't I'll 's", "\x1c\x85　  x", "  y", "z" * 5000, "same", "same", "a " * 3000, "<|endoftext|>", "�"]
DOCS = "doc_id long, text string, ids long, starts string, `decoded` int, row int, words string, rank string, bucket string, score string"


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RANKS)


def docs_of(spark, texts):
    return spark.createDataFrame([(None if i == 7 else i, t, 1, "s", 2, 3, "w", "r", "b", "c") for i, t in enumerate(texts)], DOCS).repartition(3)


@given(st.lists(st.text(st.sampled_from("ab'st .,1\n\t  　\x85\x1cé日🙂") | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=12))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_ranks(own, codec, texts):
    raw = [t.encode() for t in texts]
    ids = codec.ids(raw)
    starts, ends = codec.offsets(ids, raw)
    for t, found, a, b in zip(texts, ids, starts, ends):
        assert found.tolist() == own.encode_ordinary(t)
        assert codec.decode(found) == t.encode()
        assert "".join(codec.pieces(found)) == t
        covered = set()
        for i, x, y in zip(found.tolist(), a.tolist(), b.tolist()):
            assert own.decode_single_token_bytes(i) in t[x:y].encode()
            covered |= set(range(x, y))
        assert covered == set(range(len(t)))


def test_a_hash_that_lies_is_found_out(own, codec):
    codec.ids([b"one two three"])
    numbers = codec.numbers.copy()
    codec.numbers[:] = np.roll(codec.numbers, 1)
    assert codec.ids([b"one two three"])[0].tolist() == own.encode_ordinary("one two three")
    codec.numbers[:] = numbers


def test_split_characters_and_unknown_ids(codec):
    ids = codec.ids(["🙂".encode()])[0]
    assert len(ids) > 1 and codec.pieces(ids) == [""] * (len(ids) - 1) + ["🙂"]
    assert "".join(codec.pieces(ids[:-1])) == "�" * len(codec.pieces(ids[:-1])[-1])
    with pytest.raises(ValueError):
        codec.decode(np.array([50_256]))


def test_a_full_cache_is_emptied(own, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 10)
    codec = byte_bpe.Codec(RANKS)
    for k in range(5):
        text = " ".join(f"word{k}{i}" for i in range(20))
        assert codec.ids([text.encode()])[0].tolist() == own.encode_ordinary(text)
    assert codec.parts.n <= 30


def test_byte_bpe_documents(spark, own):
    docs = docs_of(spark, TEXTS)
    encoded = byte_bpe.encode_documents(docs, RANKS)
    rows = byte_bpe.decode_documents(encoded, RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((t or "").encode() for t in TEXTS)
    for r in rows:
        assert r["ids"] == own.encode_ordinary(bytes(r["decoded"]).decode())
    assert sum(r["doc_id"] is None for r in rows) == 1
    broken = docs.where("doc_id = 0").withColumn("text", F.unhex(F.lit("61FF62")).cast("string"))
    assert [bytes(r["decoded"]) for r in byte_bpe.decode_documents(byte_bpe.encode_documents(broken, RANKS), RANKS).collect()] == ["a�b".encode()]
    assert byte_bpe.encode_documents(docs.limit(0), RANKS).count() == 0


def test_byte_bpe_query(spark, own):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = byte_bpe.op11_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resampling(docs, target, grams=(1, 1), buckets=10_000, least=20, percent=10, seed=2024):
    def features(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in own for f in features(x)[1]) for own in ([d for _, d in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def many(seed=5):
    rng = random.Random(seed)
    words = ["Été", "ÉTÉ", "naïve", "THE", "the", "日本", "x1", "don't", "a_b", "ÀB"] + [f"w{i}" for i in range(60)]
    texts = [None, "", " .,", "one", "One one"] + [" ".join(rng.choices(words, k=rng.choice((5, 19, 20, 21, 200)))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(9, texts[9]), (9, "another of this id " * 8), (None, texts[30]), (None, texts[30]), (200, "hot " * 5000)]
    return rows, ["the w1 w2 w3 naïve", None, "日本 w5 The"]


@pytest.mark.parametrize("grams, buckets", [((1, 1), 10_000), ((1, 2), 50), ((2, 3), 10_000)])
def test_resampling(spark, monkeypatch, grams, buckets):
    rows, target = many()
    docs = spark.createDataFrame([(i, t, 1, "s", 2, 3, "w", "r", "b", "c") for i, t in rows], DOCS).repartition(5)
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    want = plain_resampling(rows, target, grams, buckets, percent=30)
    if buckets == 50:
        monkeypatch.setattr(resampling, "SMALL", 10)  # a table too large to broadcast
    got = resampling.resample(docs, aims, grams, buckets, percent=30)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert Counter(map(tuple, got.collect())) == want


def test_resampling_of_little(spark):
    rows, target = many()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert Counter(map(tuple, resampling.resample(docs, none).collect())) == plain_resampling(rows, [])
    assert resampling.resample(docs.limit(0), none).count() == 0
    assert resampling.resample(docs.limit(3), none).where("rank is not null").count() == 0


def test_ranks_of_ties(spark):
    rows = spark.range(1000, numPartitions=7).select(F.lit(1).alias("a"), (F.col("id") % 3).alias("b"))
    got = resampling.ranked(rows, [F.col("a"), F.col("b").desc()]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))
    assert [r["b"] for r in sorted(got, key=lambda r: r["rank"])] == sorted((i % 3 for i in range(1000)), reverse=True)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """vec_id, code, error of each row; the codebooks; in Python's whole numbers."""
    kept = [(i, x) for i, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    lengths = Counter(len(x) for _, x in kept)
    n = max(lengths, key=lambda k: (lengths[k], k)) if kept else 0
    kept = sorted(((i, x) for i, x in kept if len(x) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [(i, [math.floor(4096 * v) for v in x]) for i, x in kept]
    edges = [0]
    for p in range(parts):
        edges.append(edges[-1] + n // parts + (p < n % parts))
    books = [[v[edges[p] : edges[p + 1]] for _, v in vectors[:entries]] for p in range(parts)]

    def best(v, p):
        own = v[edges[p] : edges[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, v in vectors:
                groups.setdefault(best(v, p)[1], []).append(v[edges[p] : edges[p + 1]])
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])])
        books = new
    found = [(i, [best(v, p) for p in range(parts)]) for i, v in vectors]
    return Counter((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found), books


VECTORS = "vec_id long, embedding array<float>, label int, x string, code string, salt int, block string"


def vectors_of(n, width, seed=1, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(scale * rng.choice((0.5, -0.5, 2)) * rng.random())) for _ in range(width)]) for i in range(n)]
    if n > 20:
        rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (1000, None), (1001, [None] * width), (1002, [math.nan] * width), (1003, [math.inf] * width), (1004, []), (1005, [1.0]), (1006, [0.0] * width), (2, [0.25] * width)]
        rows += [(2000 + i, rows[5][1]) for i in range(60)]  # copies
    return rows


@pytest.mark.parametrize("n, width, scale", [(60, 16, 1.0), (5, 16, 1.0), (40, 11, 1.0), (30, 5, 1.0), (40, 16, 1e9), (30, 8, 1e30), (0, 8, 1.0)])
def test_vector_codes(spark, monkeypatch, n, width, scale):
    monkeypatch.setattr(vector_codes, "BLOCK", 16)
    rows = vectors_of(n, width, scale=scale)
    df = spark.createDataFrame([(i, x, None if k % 3 else 1, "x", "c", 1, "b") for k, (i, x) in enumerate(rows)], VECTORS).repartition(5)
    coded, books = vector_codes.compress(df)
    want, theirs = plain_codes(rows)
    long = (1 << 63) - 1
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in coded.collect()) == Counter({(i, c, min(e, long)): k for (i, c, e), k in want.items()})
    if n:
        assert [[[int(v) for v in e] for e in c] for c in books] == theirs
        assert vector_codes.digest(books) == hashlib.sha256(",".join(str(v) for c in theirs for e in c for v in e).encode()).hexdigest()
        assert books[0].dtype == (np.int64 if scale == 1 else object)


def test_label_errors(spark, monkeypatch):
    coded = spark.createDataFrame([(i, "00", i, None if i % 2 else i % 3) for i in range(50)], "vec_id long, code string, error long, label int")
    want = Counter()
    for i in range(50):
        want[None if i % 2 else i % 3] += i
    for small in (100, 1):
        monkeypatch.setattr(vector_codes, "SMALL", small)
        rows = vector_codes.with_label_error(coded).collect()
        assert len(rows) == 50 and all(r["label_error"] == want[r["label"]] for r in rows)
    huge = spark.createDataFrame([(i, "00", (1 << 63) - 1, 1) for i in range(3)], coded.schema)
    assert {r["label_error"] for r in vector_codes.with_label_error(huge).collect()} == {(1 << 63) - 1}


def test_restored_vectors(spark):
    rows = vectors_of(60, 16)
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(df)
    for r in vector_codes.restore(coded, books).collect():
        assert r["x"] == [float(v) / 4096 for p, c in enumerate(books) for v in c[int(r["code"][2 * p : 2 * p + 2], 16)]]


@pytest.mark.parametrize("query, sql", [(resampling.op12_resampling, resampling.SQL), (vector_codes.op13_vector_codes, vector_codes.SQL)])
def test_query_equals_sql(spark, query, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = query(spark, SF).toPandas(), con.execute(sql).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (ours, theirs))
    assert a.equals(b.astype(a.dtypes))
