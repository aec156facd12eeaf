"""Operator 7: scoring by a hierarchical Pitman-Yor model.

A token's restaurant is chosen by its context: the word before it. Every observed word has a restaurant of its own; all
share a parent, the restaurant without context, whose base is uniform over the training words and one unknown word. A
training token is a customer of its context's restaurant, and each table there is a customer of the parent. Seating is
sampled by Gibbs: in a sweep, customers leave their tables in turn and sit down again, given all other dishes' tables
and the parent's probabilities as the sweep before left them (so all dishes of a sweep are seated side by side). After
burn-in the predictive probabilities of SAMPLES sweeps are averaged.

What Spark holds: words are 64-bit hashes, dealt to buckets by them. A row holds a bucket's words, each with the contexts it
was met in and their customers and tables. Before each sweep, a bucket sends its tables of every context to the bucket of the
context's word, which adds them up and answers in the same order. Blocks of documents ask each bucket for their own
distinct words and pairs, so no vocabulary is broadcast or gathered; to the driver come only some sums. A frequent pair is
counted in each task first, so it sends one count for each COUNTED tokens.

Cases: null or empty text: the end token alone; no training text: every token is the unknown word; repeated rows are
scored alike and all learned from; a null doc_id is in training and scored; an empty table: no rows; other columns are
ignored.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import Stored, partitions, released, table, utf8, word_hashes

#: The hash that stands for the end of a text, and for what is before its first word.
END = np.uint64(0x3C6EF372FE94F82B)
ALPHA = 0.1
#: Contexts in the dense table by which a test holds State's formulas; the model's contexts are all words.
CLASSES = 8
BURN, SAMPLES = 1, 2
#: Strengths of the contexts' restaurants and of their parent. Most contexts are met a few times only, so theirs is small.
STRENGTH, STRENGTH0 = 0.1, 20.0
#: Tokens that a task counts before it sends them.
COUNTED = 1 << 20
#: Blocks of documents are scored in so many turns, so that requests and answers of a part only are on disk at once.
WAVES = 4
#: Bytes of text of a block, about.
BLOCK_BYTES = 16 << 20
SEED = 5


def hashed(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's tokens as hashes."""
    return [np.append(words, END) for words in word_hashes([t.lower() for t in texts])]


def z(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def uz(x: bytes, kind: type, columns: int = 0) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(x), kind)
    return flat.reshape(-1, columns) if columns else flat


def _binary(x: list[bytes]) -> pa.Array:
    return pa.array(x, pa.binary())


def grouped(texts: list[np.ndarray], buckets: int) -> tuple[np.ndarray, ...]:
    """Distinct words by bucket and hash; of the distinct pairs, in order, the places of the word and the one before; each token's pair; each pair's count."""
    flat = np.concatenate(texts)
    words, at = np.unique(flat, return_inverse=True)
    order = np.lexsort((words, words % np.uint64(buckets)))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    words, at = words[order], rank[at]
    before = np.r_[at[-1], at[:-1]]  # every text ends with END, which is before the next one's first word
    pair, own, count = np.unique(at * len(words) + before, return_inverse=True, return_counts=True)
    return words, pair // len(words), pair % len(words), own, count


def cuts(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words ordered by bucket, and where each begins, with the end."""
    own = words % np.uint64(buckets)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return own[first].astype(np.int64), np.r_[first, len(own)]


# --- the vocabulary, by bucket ----------------------------------------------

#: A row for each bucket: words by hash, each one's number of contexts; contexts by their bucket and hash; of each pair, by word and context,
#: the context's place, customers, tables and averaged own customers; tables of the parent; [word, sample] the parent's probabilities, and what the word's own restaurant passes up.
VOCABULARY = "bucket long, words binary, k binary, ctx binary, at binary, c binary, t binary, own binary, t0 binary, parent binary, up binary"
KINDS = {"words": np.uint64, "k": np.int32, "ctx": np.uint64, "at": np.int32, "c": np.int64, "t": np.int32, "own": np.float32, "t0": np.int32, "parent": np.float32, "up": np.float32}


def _opened(row: dict, *names: str) -> list[np.ndarray]:
    return [uz(row[x], KINDS[x], SAMPLES if x in ("parent", "up") else 0) for x in names]


def _count(batches, buckets: int):
    def out(texts):
        words, w, u, _, c = grouped(texts, buckets)
        own, at = cuts(words, buckets)
        rows = []
        for b, i, j in zip(own, at[:-1], at[1:]):
            lo, hi = np.searchsorted(w, [i, j])
            rows.append((int(b), z(words[i:j]), z(np.bincount(w[lo:hi] - i, minlength=j - i).astype(np.int32)), z(words[u[lo:hi]]), z(c[lo:hi].astype(np.int64))))
        b, *cells = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), *map(_binary, cells)], ["bucket", "words", "k", "u", "c"])

    texts, held = [], 0
    for b in batches:
        for own in hashed(b.column(0).to_pylist()):
            texts.append(own)
            held += len(texts[-1])
            if held > COUNTED:
                yield out(texts)
                texts, held = [], 0
    if texts:
        yield out(texts)


def _merged(group: pa.Table, buckets: int) -> pa.Table:
    rows = group.to_pylist()
    w = np.concatenate([np.repeat(*_opened(r, "words", "k")) for r in rows])
    u = np.concatenate([uz(r["u"], np.uint64) for r in rows])
    c = np.concatenate([uz(r["c"], np.int64) for r in rows])
    order = np.lexsort((u, w))
    w, u, c = w[order], u[order], c[order]
    first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (u[1:] != u[:-1])])
    w, u, c = w[first], u[first], np.add.reduceat(c, first)
    words, k = np.unique(w, return_counts=True)
    ctx, at = np.unique(u, return_inverse=True)
    order = np.lexsort((ctx, ctx % np.uint64(buckets)))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    cells = {"words": words, "k": k, "ctx": ctx[order], "at": rank[at], "c": c, "t": np.ones(len(c)), "own": np.zeros(len(c)), "t0": np.ones(len(words)), "parent": np.zeros((len(words), SAMPLES)), "up": np.zeros((len(words), SAMPLES))}
    return pa.table({"bucket": group["bucket"][:1]} | {x: _binary([z(cells[x].astype(kind))]) for x, kind in KINDS.items()})


def _starts(k: np.ndarray) -> np.ndarray:
    return np.cumsum(k) - k


#: Of the buckets: words, the parent's tables, words met once, twice; customers, tables, pairs met once, twice.
SUMS = ["v", "up", "n1", "n2", "c", "t", "o", "w"]


def _sums(batches):
    for b in batches:
        rows = []
        for row in b.select(["k", "c", "t", "t0"]).to_pylist():
            k, c, t, t0 = _opened(row, "k", "c", "t", "t0")
            n = np.add.reduceat(c, _starts(k))
            rows.append([len(k), int(t0.sum()), int((n == 1).sum()), int((n == 2).sum()), int(c.sum()), int(t.sum()), int((c == 1).sum()), int((c == 2).sum())])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], SUMS)


class State:
    """What a sweep knows of all buckets: words, customers and tables of the contexts' restaurants, the parent's tables."""

    def __init__(self, vocabulary: DataFrame):
        sums = vocabulary.select("k", "c", "t", "t0").mapInArrow(_sums, ", ".join(f"{x} long" for x in SUMS)).agg(*(F.sum(x).alias(x) for x in SUMS)).first()
        got = {x: sums[x] or 0 for x in SUMS}
        self.v, self.t0 = got["v"], got["up"]
        self.c, self.t = np.array([got["c"]], float), np.array([got["t"]], float)
        share = lambda a, b: float(min(0.95, max(0.05, a / (a + 2 * b)))) if a else 0.5
        self.discount, self.discount0 = share(got["o"], got["w"]), share(got["n1"], got["n2"])

    def parent_p(self, customers: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """The parent's probability of dishes with these customers (tables of the contexts' restaurants) and tables."""
        fresh = (STRENGTH0 + self.discount0 * self.t0) / (self.v + 1)
        return (np.maximum(customers - self.discount0 * t0, 0) + fresh) / (STRENGTH0 + self.t.sum())

    def passed_up(self) -> np.ndarray:
        """The share of each context that goes to the parent."""
        return self.weight_up(self.t) / (STRENGTH + self.c)

    def weight_up(self, t: np.ndarray) -> np.ndarray:
        """What contexts of so many tables pass to the parent, against their customers."""
        return STRENGTH + self.discount * t


def expected(c: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Tables to start from: about those that c customers open one after another."""
    return np.clip(np.round(weight * np.log1p(c / np.maximum(weight, 1e-300))), np.minimum(c, 1), c)


def seated(c: np.ndarray, t: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after a sweep: all of its c customers leave, in turn, and sit down again.

    weight: (strength + discount * the restaurant's tables) * the parent's probability of the dish. One of c customers at t
    tables sits alone with chance discount * (t - 1) / c, about (all do if c is 1); who leaves opens a table in proportion
    to weight and joins one in proportion to the other customers less discount * tables. As long as t stays, turns are alike,
    so the turns until t changes are drawn at once (geometric): the work is the changes, not the customers.
    """
    t = t.astype(np.float64)
    live = np.flatnonzero(c > 1)
    left = c[live].astype(np.float64)
    while len(live):
        n, k, a = c[live], t[live], weight[live]
        alone = np.clip((k - 1) * discount / n, 0, 1)
        opens = lambda k: a / np.maximum(np.maximum(n - 1 - discount * k, 0) + a, 1e-300)
        up, down = np.where(k < n, (1 - alone) * opens(k), 0), alone * (1 - opens(k - 1))
        change = np.minimum(up + down, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            wait = np.where(change > 0, np.floor(np.log(1 - rng.random(len(live))) / np.log1p(-change)) + 1, np.inf)
        left = left - wait
        kept = left >= 0
        live, left, up, change = live[kept], left[kept], up[kept], change[kept]
        t[live] += np.where(rng.random(len(live)) * change < up, 1, -1)
    return t


# --- tables of each context's restaurant, over all buckets ------------------


def _told(batches, buckets: int):
    """Each bucket's tables by context, to the buckets of the contexts; with own, its words ask for their restaurants' tables."""
    for b in batches:
        for row in b.select(["bucket", "words", "ctx", "at", "t"]).to_pylist():
            words, ctx, at, t = _opened(row, "words", "ctx", "at", "t")
            tables = np.bincount(at, t, minlength=len(ctx)).astype(np.int64)
            to, cut = cuts(ctx, buckets)
            sent = [(int(j), row["bucket"], False, z(ctx[x:y]), z(tables[x:y])) for j, x, y in zip(to, cut[:-1], cut[1:])]
            sent.append((row["bucket"], row["bucket"], True, z(words), z(np.zeros(len(words), np.int64))))
            to, bucket, own, ctx, tables = zip(*sent)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(bucket, pa.int64()), pa.array(own), _binary(ctx), _binary(tables)], ["to", "bucket", "own", "ctx", "n"])


def _added(group: pa.Table) -> pa.Table:
    """Sums over all buckets, to each that told, in the order told."""
    ctx = [uz(x, np.uint64) for x in group["ctx"].to_pylist()]
    at = np.unique(np.concatenate(ctx), return_inverse=True)[1]
    n = np.bincount(at, np.concatenate([uz(x, np.int64) for x in group["n"].to_pylist()])).astype(np.int64)[at]
    parts = np.split(n, np.cumsum([len(x) for x in ctx])[:-1])
    return pa.table({"bucket": group["bucket"], "to": group["to"], "own": group["own"], "n": _binary([z(x) for x in parts])})


def _step(known: pa.Table, added: pa.Table, state: State, sweep: int | None, sample: int | None) -> pa.Table:
    """Keeps the predictive probabilities of the seating as it is (sample), then seats all customers of the contexts' restaurants, then their parent's, anew (sweep)."""
    if not len(known):
        return known
    row = known.to_pylist()[0]
    words, k, at, c, t, own, t0, parent, up = _opened(row, "words", "k", "at", "c", "t", "own", "t0", "parent", "up")
    rows = sorted(added.to_pylist(), key=lambda x: x["to"])
    restaurant = np.concatenate([uz(x["n"], np.int64) for x in rows if not x["own"]])[at].astype(np.float64)
    starts = _starts(k)
    p = state.parent_p(np.add.reduceat(t, starts, dtype=np.int64), t0)
    new = {}
    if sample is not None:
        parent, up = parent.copy(), up.copy()
        parent[:, sample] = p
        up[:, sample] = state.weight_up(uz(next(x["n"] for x in rows if x["own"]), np.int64))
        new |= {"own": own + (c - state.discount * t) / SAMPLES, "parent": parent, "up": up}
    if sweep is not None:
        rng = np.random.default_rng([SEED + sweep, row["bucket"]])
        weight = state.weight_up(restaurant) * np.repeat(p, k)
        flat = c.astype(np.float64)
        t = seated(flat, expected(flat, weight) if sweep == 0 else t, weight, state.discount, rng)
        customers = np.add.reduceat(t, starts)
        fresh = np.full(len(words), (STRENGTH0 + state.discount0 * state.t0) / (state.v + 1))
        new |= {"t": t, "t0": seated(customers, expected(customers, fresh) if sweep == 0 else np.minimum(t0, customers), fresh, state.discount0, rng)}
    return pa.table({x: _binary([z(new[x].astype(KINDS[x]))]) if x in new else known[x] for x in known.column_names})


def _stepped(state: State, sweep: int | None, sample: int | None):
    def step(known: pa.Table, added: pa.Table) -> pa.Table:
        return _step(known, added, state, sweep, sample)

    return step


# --- scoring ----------------------------------------------------------------


def _compressed(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary([pack.compress(t) for t in b.column(2).to_pylist()])], ["block", "doc_id", "z"])


def _texts(group: pa.Table) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return hashed([unpack.decompress(x) for x in group["z"].to_pylist()])


def _ask(group: pa.Table, buckets: int) -> pa.Table:
    """A block's distinct words, each with its contexts, by bucket."""
    words, w, u, _, _ = grouped(_texts(group), buckets)
    own, at = cuts(words, buckets)
    rows = []
    for i, j in zip(at[:-1], at[1:]):
        lo, hi = np.searchsorted(w, [i, j])
        rows.append((z(words[i:j]), z(np.bincount(w[lo:hi] - i, minlength=j - i).astype(np.int32)), z(words[u[lo:hi]])))
    cells = dict(zip(("words", "k", "u"), map(_binary, zip(*rows))))
    return pa.table({"bucket": pa.array(own), "block": pa.array([group["block"][0].as_py()] * len(own), pa.int64())} | cells)


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys, -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Customers, the parent's probabilities and what is passed up of the words asked for, own customers of the pairs, in their order; zeros if unknown."""
    names = ("c", "parent", "up", "own")
    if not len(asked):
        return pa.table({"block": asked["block"], "bucket": asked["bucket"]} | {x: _binary([]) for x in names})
    words, k, u = ([uz(x, kind) for x in asked[name].to_pylist()] for name, kind in (("words", np.uint64), ("k", np.int32), ("u", np.uint64)))
    ends, pair_ends = np.cumsum([len(x) for x in words]), np.cumsum([len(x) for x in u])
    words, k, u = np.concatenate(words), np.concatenate(k), np.concatenate(u)
    n, parent, up, own = np.zeros(len(words), np.int64), np.zeros((len(words), SAMPLES), np.float32), np.zeros((len(words), SAMPLES), np.float32), np.zeros(len(u), np.float32)
    if len(known):
        all_words, all_k, ctx, at, c, all_own, all_parent, all_up = _opened(known.to_pylist()[0], "words", "k", "ctx", "at", "c", "own", "parent", "up")
        w = found(all_words, words)
        has = w >= 0
        n[has], parent[has], up[has] = np.add.reduceat(c, _starts(all_k))[w[has]], all_parent[w[has]], all_up[w[has]]
        order = np.argsort(ctx)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        keys = np.repeat(np.arange(len(all_words)), all_k) * len(ctx) + place[at]
        w, x = np.repeat(w, k), found(ctx[order], u)
        pair = np.where((w >= 0) & (x >= 0), found(keys, w * len(ctx) + x), -1)
        own[pair >= 0] = all_own[pair[pair >= 0]]
    told = [[z(x) for x in np.split(a, e[:-1])] for a, e in ((n, ends), (parent, ends), (up, ends), (own, pair_ends))]
    return pa.table({"block": asked["block"], "bucket": asked["bucket"]} | {x: _binary(y) for x, y in zip(names, told)})


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(docs: pa.Table, answers: pa.Table, states: list[State], n: int, v: int, buckets: int) -> pa.Table:
    texts = _texts(docs)
    lengths = np.array([len(x) for x in texts])
    words, w, u, token, _ = grouped(texts, buckets)
    rows = sorted(answers.to_pylist(), key=lambda x: x["bucket"])
    c = np.concatenate([uz(x["c"], np.int64) for x in rows])
    parent, up = (np.concatenate([uz(x[name], np.float32, SAMPLES) for x in rows]).astype(float) for name in ("parent", "up"))
    own = np.concatenate([uz(x["own"], np.float32) for x in rows])
    unknown = np.array([s.parent_p(np.zeros(1), np.zeros(1))[0] for s in states])
    parent = np.where(c[:, None] > 0, parent, unknown[None])
    up = np.where(c[:, None] > 0, up, STRENGTH)  # nobody was met after an unknown word
    p = (own + (up[u] * parent[w]).mean(1)) / (STRENGTH + c[u])
    base = np.log10((c + ALPHA) / (n + ALPHA * (v + 1)))
    starts = np.cumsum(lengths) - lengths
    own_word = w[token]
    of = lambda x: np.add.reduceat(x, starts)
    columns = [docs["doc_id"].to_numpy(zero_copy_only=False) if not docs["doc_id"].null_count else docs["doc_id"].to_pylist(), lengths, of((c[own_word] > 0).astype(np.int64)), of(base[own_word]), of(np.log10(p)[token])]
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 2)], names=[x.split()[0] for x in SCORES.split(", ")])


def _vocabulary(training: DataFrame, buckets: int) -> DataFrame:
    def merge(group: pa.Table) -> pa.Table:
        return _merged(group, buckets)

    counted = training.mapInArrow(partial(_count, buckets=buckets), "bucket long, words binary, k binary, u binary, c binary")
    return counted.groupBy("bucket").applyInArrow(merge, VOCABULARY)


def _next(vocabulary: DataFrame, buckets: int, state: State, sweep: int | None, sample: int | None) -> DataFrame:
    told = vocabulary.mapInArrow(partial(_told, buckets=buckets), "to long, bucket long, own boolean, ctx binary, n binary")
    added = told.groupBy("to").applyInArrow(_added, "bucket long, to long, own boolean, n binary")
    return vocabulary.groupBy("bucket").cogroup(added.groupBy("bucket")).applyInArrow(_stepped(state, sweep, sample), VOCABULARY)


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity (a token's) of each text, learned from the rows not held out."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    training = docs.where(~F.col("held")).select("text")
    vocabulary, states = Stored(_vocabulary(training, buckets), "vocabulary"), []
    state = State(vocabulary.df)
    n, v = int(state.c.sum()), state.v
    released(spark)
    for done in range(BURN + SAMPLES + 1):  # so many sweeps are done; after burn-in each one's seating is kept before the next
        sweep, sample = done if done < BURN + SAMPLES else None, done - BURN - 1 if done > BURN else None
        new = Stored(_next(vocabulary.df, buckets, state, sweep, sample), "vocabulary")
        vocabulary.drop()
        vocabulary = new
        if sample is not None:
            states.append(state)
        state = State(vocabulary.df) if sweep is not None else state
        released(spark)

    def ask(group: pa.Table) -> pa.Table:
        return _ask(group, buckets)

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        return _score(own, answers, states, n, v, buckets)

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * buckets, total // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(blocks)).alias("block")
    known = vocabulary.df.select("bucket", "words", "k", "ctx", "at", "c", "own", "parent", "up")
    out = []
    for wave in range(WAVES):
        dealt = docs.select(block, "doc_id", "text").where(F.col("block") % WAVES == wave).mapInArrow(_compressed, "block long, doc_id long, z binary")
        asked = dealt.groupBy("block").applyInArrow(ask, "bucket long, block long, words binary, k binary, u binary")
        answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answer, "block long, bucket long, c binary, parent binary, up binary, own binary")
        out.append(Stored(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES), "scores").df)
        released(spark)
    vocabulary.drop()
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return reduce(DataFrame.union, out).withColumn("train_tokens", F.lit(n).cast("long")).withColumn("perplexity", perplexity)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    out = score_documents(table(spark, sf_dir, "documents"), held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
