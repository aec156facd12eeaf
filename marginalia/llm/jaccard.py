"""Operator 10: exact self-join of documents on the Jaccard similarity of their word n-grams, by universe partition.

Sets of equal n-grams are one node. Sizes fall into bands so that linked sets are in one band or in neighbouring ones;
scheme k covers the pairs whose smaller set is in band k. Of such a pair at most H_k elements are in one set alone, so
when hashing deals the universe into m segments, of which t tolerate one difference, and m + t > H_k, then the two sets
agree in one segment within its tolerance (pigeonhole). A set is indexed under the hash of each segment's elements, and in
tolerant segments also under the hashes that leave one element out. m and t are chosen by cost for each band, with
enough segments left over for those that a set has no element in: these are not indexed. A set that has too few others
(`short` below) is indexed under its empty segments too, among such sets only.

The pigeonhole gives more than one common segment: a set that has s segments with elements, of which a linked one can spoil
h (counted from its own size), shares s - h of them. So pairs that share fewer signatures are dropped before any text
is read. Signatures that more than `HOT` sets share are costly and not paired: of its hot ones a set leaves out those that
most sets share, as many as it can lose, and is found by the others. Sets that keep some (they have many near copies, or a
passage that many share) are first rid of
all sets of which more than a fifth of the elements is in no other one of them: these link with nothing. The rest falls
into families, the components of sets and hot signatures. A family is dealt in blocks of bounded size, each pair of blocks
to one task, which counts all common elements at once and returns what is connected there: at most one row for each set. So
every link is decided by exact comparison, and rows grow with sets, not with pairs.

n-grams and nodes are 64-bit hashes; a set's node is the hash of all its elements.

Cases: null or empty text: n_shingles 0, its own component; fewer words than n: the whole sequence is one n-gram;
repeated texts are one node; repeated rows too; null doc_id: the least; an empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import mixed, partitions, saved, table, utf8, window_hashes, word_hashes
from marginalia.llm.components import components

N = 5
#: A link needs intersection * DOWN >= union * UP.
UP, DOWN = 80, 100
#: A signature that more sets share is a hot one.
HOT = 6
#: Segments beyond the pigeonhole's need that the allocation aims at, for larger sets.
SPARE = 8
#: Sets and elements of a block of a family.
BLOCK_SETS, BLOCK_GRAMS = 1_024, 1_000_000
#: Elements that more sets of two blocks share are counted by products of matrices of COLUMNS columns, others by pairs.
COMMON, COLUMNS = 16, 1_024
#: Pairs that are counted at once, and signatures that a task holds before it sends them.
PAIRS, HELD = 1 << 20, 1 << 21
#: Signatures that a set may be compared under before blocks are dealt.
PICKS = 3
#: Stands for a null doc_id.
NO_ID = -(1 << 63)

def shingles(texts: list[bytes], n: int = N) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams."""

    def of(words: np.ndarray) -> np.ndarray:
        return np.unique(window_hashes(words, n)) if len(words) >= n else window_hashes(words, len(words), seed=len(words)) if len(words) else words

    return map(of, word_hashes([t.lower() for t in texts]))


def node(grams: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((mixed(grams.copy()).sum() + mixed(grams ^ np.uint64(0x5BD1E995)).max()).view(np.int64)) if len(grams) else 0


@cache
def bands(size: int) -> tuple[int, int, int]:
    """The band of a size: its number, least and greatest size."""
    k, low = 0, 1
    while True:
        high = low * DOWN // UP
        if size <= high:
            return k, low, high
        k, low = k + 1, high + 1


@cache
def scheme(low: int, high: int) -> tuple[int, int, int]:
    """H, m, t for pairs whose smaller set has low to high elements: the cheapest m and t that leave SPARE segments."""
    h = (high + high * DOWN // UP) * (DOWN - UP) // (DOWN + UP)
    best = None
    for surety in (3, 2, 1, 0):  # small sets can't have three deviations to spare
        for t_share in (0, 1):
            for m in range(max(1, (h + 2) // 2 if t_share else h + 1), 4 * (h + 2) + 2):
                t, load = m * t_share, low / m
                empty, one = math.exp(-load), load * math.exp(-load)
                if m == 1:
                    holds, sd = (2.0 if t and low > 1 else 1.0), 0.0
                else:
                    holds = m * (1 - empty) + t * (1 - empty - one)
                    sd = math.sqrt(m * empty * (1 - empty) + t * (empty + one) * (1 - empty - one))
                if holds - surety * sd >= h + 1 + min(SPARE, h // 20):
                    cost = m + t * load + 6 * m * empty  # a nearly empty segment's signature is shared by many sets
                    if best is None or cost < best[0]:
                        best = (cost, m, t)
                    break
        if best:
            break
    assert best
    return h, best[1], best[2]


def signatures(grams: np.ndarray) -> Iterator[tuple[np.ndarray, int, bool]]:
    """For both schemes of a set: signatures, the segments that the set can lose, and whether it is in the scheme's own band.

    What differs between this set and one that links is counted from its own size, so most sets can lose many.
    """
    n = len(grams)
    k, low, high = bands(n)
    pairs = [(k, low, high, True)]
    if k:
        pairs.append((*bands(low - 1), False))
    with np.errstate(over="ignore"):
        spread = mixed(grams ^ np.uint64(0x27D4EB2F))
        for k, low, high, own in pairs:
            _, m, t = scheme(low, high)
            h = (n + (n * DOWN // UP if own else min(n, high))) * (DOWN - UP) // (DOWN + UP)
            segment = ((grams >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the sorted hashes
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            at, sums = segment[starts], np.add.reduceat(spread, starts)
            name = lambda seg, s: mixed(s + seg * np.uint64(0x9E3779B97F4A7C15) + np.uint64((k + 1) * 0xD1342543DE82EF95 % 2**64))  # noqa: B023, E731
            out = [name(at, sums)]
            if t:
                lengths = np.diff(np.r_[starts, len(grams)])
                keep = np.repeat(lengths > 1, lengths)
                out.append(name(segment, np.repeat(sums, lengths) - spread)[keep])
                lose = (int((lengths > 1).sum()) + len(at) - h - 1) // 2  # a segment without one of its signatures counts for nothing
                ones = lengths == 1
            else:
                lose = len(at) - h - 1
                ones = np.zeros(len(at), bool)
            none = np.empty(0, np.uint64)
            if lose < 0:
                blank = np.ones(m, bool)
                blank[at[~ones].astype(np.int64)] = False
                gaps = np.flatnonzero(blank).astype(np.uint64)
                none = name(gaps, np.full(len(gaps), 0xABCDEF0123456789, np.uint64))
            yield np.concatenate([*out, none]), lose, own


BLOB = "bucket long, sigs binary, nodes binary, slack binary, docs binary"


def _blob(bucket, *cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *(pa.array(x, pa.binary()) for x in cells)], [x.split()[0] for x in BLOB.split(", ")])


def _sent(sig: list[np.ndarray], who: list[np.ndarray], slack: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A row for each bucket of the signatures."""
    s, w, f = np.concatenate(sig), np.concatenate(who), np.concatenate(slack)
    part = ((s >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    s, w, f, part = s[order].astype(np.uint32), w[order], f[order], part[order]
    cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
    return _blob(part[cut[:-1]], *([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])] for x in (s, w, f)), [b""] * (len(cut) - 1))


def _index(buckets: int):
    def run(batches):
        seen: set[int] = set()  # copies within a task are indexed once
        for b in batches:
            sig, who, slack, rows, held = [], [], [], [], 0
            for doc_id, text, g in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), shingles(b.column(1).to_pylist())):
                name = node(g)
                rows.append((doc_id, len(g), name, text))
                if not len(g) or name in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(name)
                for s, lose, own in signatures(g):
                    sig.append(s)
                    who.append(np.full(len(s), name, np.int64))
                    slack.append(np.full(len(s), 2 * min(max(lose, -1), 16_000) + own, np.int16))
                    held += len(s)
                if held > HELD:
                    yield _sent(sig, who, slack, buckets)
                    sig, who, slack, held = [], [], [], 0
            if rows:
                yield _blob([rows[0][2] % buckets], *[[b""]] * 3, [np.array(rows, np.int64).tobytes()])
            if sig:
                yield _sent(sig, who, slack, buckets)

    return run


#: Rows of three kinds: a document (doc_id, n, node, its text's hash); a pair that shares cheap signatures (a, b, how many, segments that a and that b
#: can lose); a hot signature of a set (signature, node, segments that it can lose, whether in the scheme's own band, how many sets have it).
ROWS = "kind long, v0 long, v1 long, v2 long, v3 long, v4 long"


def _pairs_within(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within runs that begin at first."""
    left, right = [], []
    for g in np.unique(size):
        i, j = np.triu_indices(int(g), 1)
        start = first[size == g][:, None]
        left.append((start + i).ravel()), right.append((start + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _shared(group: pa.Table) -> pa.Table:
    """Of a bucket's signatures those that several sets share, as pairs or as hot ones; and the documents that came along."""
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in group["docs"].to_pylist()]).reshape(-1, 4)
    sig = np.concatenate([np.frombuffer(x, np.uint32) for x in group["sigs"].to_pylist()])
    who = np.concatenate([np.frombuffer(x, np.int64) for x in group["nodes"].to_pylist()])
    slack = np.concatenate([np.frombuffer(x, np.int16) for x in group["slack"].to_pylist()])
    order = np.argsort(sig, kind="stable")
    new = np.r_[True, np.diff(sig[order]) != 0]
    n = np.diff(np.r_[np.flatnonzero(new), len(sig)])
    order = order[np.repeat(n > 1, n)] if len(sig) else order
    order = order[np.lexsort((who[order], sig[order]))]
    sig, who, slack = sig[order], who[order], slack[order].astype(np.int64)
    if len(sig):
        once = np.r_[True, (np.diff(sig) != 0) | (np.diff(who) != 0)]
        sig, who, slack = sig[once], who[once], slack[once]
    first = np.flatnonzero(np.r_[True, np.diff(sig) != 0]) if len(sig) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(sig)])
    hot = np.repeat(n > HOT, n)
    few = (n > 1) & (n <= HOT)
    a, b = _pairs_within(first[few], n[few])
    covered = (slack[a] | slack[b]) & 1 == 1  # two sets of the upper band meet in their own scheme
    a, b = a[covered], b[covered]
    both = np.stack([who[a], who[b], slack[a] >> 1, slack[b] >> 1], 1)
    pairs, count = np.unique(both, axis=0, return_counts=True) if len(both) else (both, np.zeros(0, np.int64))
    names = sig.astype(np.int64) << 20 | np.int64(group["bucket"][0].as_py() & 0xFFFFF)
    blank = lambda k: np.zeros(k, np.int64)
    parts = [
        [np.full(len(docs), 0), docs[:, 0], docs[:, 1], docs[:, 2], docs[:, 3], blank(len(docs))],
        [np.full(len(pairs), 1), pairs[:, 0], pairs[:, 1], count, pairs[:, 2], pairs[:, 3]],
        [np.full(hot.sum(), 2), names[hot], who[hot], slack[hot] >> 1, slack[hot] & 1, np.repeat(n, n)[hot]],
    ]
    cells = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)]
    return pa.table(cells, names=[x.split()[0] for x in ROWS.split(", ")])


def _packed(batches):
    """Texts (doc_id, text, its hash), packed; rows that repeat within a task are sent once."""
    pack, seen = zstandard.ZstdCompressor(level=1), set()
    for b in batches:
        if len(seen) > 1_000_000:
            seen.clear()
        names = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist()))
        keep = [i for i, n in enumerate(names) if n not in seen and not seen.add(n)]
        b = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([pack.compress(t) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "hash", "z"])


def _named(batches):
    """Texts (z, node) whose set is that node; another text under the same doc_id and hash is dropped."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        own = map(node, shingles([unpack.decompress(z) for z in b.column("z").to_pylist()]))
        keep = [i for i, (got, name) in enumerate(zip(own, b.column("node").to_pylist())) if got == name]
        yield b.take(pa.array(keep, pa.int64())).select(["node", "z"])


def _linked(batches):
    """The pairs (a, b) whose texts (za, zb) link."""
    unpack, held = zstandard.ZstdDecompressor(), {}

    def grams(name: int, z: bytes) -> np.ndarray:
        if (got := held.get(name)) is None:
            if len(held) > 200:
                held.clear()
            got = held[name] = next(shingles([unpack.decompress(z)]))
        return got

    for b in batches:
        keep = []
        for i, (a, other, za, zb) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
            x, y = grams(a, za), grams(other, zb)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both * DOWN >= (len(x) + len(y) - both) * UP:
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64())).select([0, 1])


def _elements(batches, buckets: int):
    """Elements of sets (node, z) for the buckets that count how many sets have each; 32 bits beside the bucket, so equal ones stay equal."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        own = list(shingles([unpack.decompress(x) for x in b.column(1).to_pylist()]))
        if not own:
            continue
        grams = np.concatenate(own)
        who = np.repeat(b.column(0).to_numpy(), [len(g) for g in own])
        part = ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        grams, who, part = grams[order].astype(np.uint32), who[order], part[order]
        cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        cells = ([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])] for x in (grams, who))
        yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), *(pa.array(x, pa.binary()) for x in cells)], ["bucket", "grams", "nodes"])


def _alone(group: pa.Table) -> pa.Table:
    """How many of a bucket's elements no other set has, by set."""
    grams = np.concatenate([np.frombuffer(x, np.uint32) for x in group["grams"].to_pylist()])
    who = np.concatenate([np.frombuffer(x, np.int64) for x in group["nodes"].to_pylist()])
    _, first, n = np.unique(grams, return_index=True, return_counts=True)
    name, count = np.unique(who[first[n == 1]], return_counts=True)
    return pa.table({"node": name, "alone": count})


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """[left, right] how many elements two sets share."""
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(g) for g in (*left, *right)])
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    in_left = np.bincount(at[row < len(left)], minlength=len(n))
    both = (in_left > 0) & (in_left < n)
    out = np.zeros(len(left) * len(right), np.float32)
    order = np.argsort(at, kind="stable")  # by element, those of the left before those of the right
    first = np.cumsum(n) - n
    few = np.flatnonzero(both & (n <= COMMON))
    for a, b in {(int(x), int(y)) for x, y in zip(in_left[few], n[few] - in_left[few])}:
        own = first[few[(in_left[few] == a) & (n[few] - in_left[few] == b)]]
        step = max(1, PAIRS // (a * b))
        for i in range(0, len(own), step):
            some = own[i : i + step, None]
            x, y = row[order[some + np.arange(a)]], row[order[some + a + np.arange(b)]] - len(left)
            pair, times = np.unique((x[:, :, None] * len(right) + y[:, None, :]).ravel(), return_counts=True)
            out[pair] += times
    out = out.reshape(len(left), len(right))
    many = both & (n > COMMON)
    column = np.cumsum(many) - 1
    kept = many[at]
    row, column = row[kept], column[at[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for i in range(0, int(many.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [i, i + COLUMNS])
        m = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        m[row[lo:hi], column[lo:hi] - i] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _families(group: pa.Table) -> pa.Table:
    """Of two blocks of a family (or one with itself): each set with the least that links connect it with."""
    unpack, i, j = zstandard.ZstdDecompressor(), group["i"][0].as_py(), group["j"][0].as_py()
    order = np.argsort(group["block"].to_numpy(), kind="stable")
    names, cells = group["node"].to_numpy()[order], group["z"].to_pylist()
    sets = list(shingles([unpack.decompress(cells[k]) for k in order]))
    cut = len(sets) if i == j else int((group["block"].to_numpy() == i).sum())
    left, right, offset = (sets, sets, 0) if i == j else (sets[:cut], sets[cut:], cut)
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not left or not right:
        return none
    both = common(left, right).astype(np.int64)  # as floats, products of long sets would be rounded
    n = np.array([len(g) for g in sets], np.int64)
    linked = both * DOWN >= (n[:cut, None] + n[None, offset:] - both) * UP
    del both
    by_name = np.argsort(names)
    least, far = np.argsort(by_name).astype(np.int32), np.int32(len(names))
    while True:
        new = least.copy()
        new[:cut] = np.minimum(new[:cut], np.where(linked, least[None, offset:], far).min(1))
        new[offset:] = np.minimum(new[offset:], np.where(linked, least[:cut, None], far).min(0))
        np.minimum.at(new, by_name[least], new)  # a root that found a lesser one tells so
        new = new[by_name[new]]
        if (new == least).all():
            break
        least = new
    root = np.sort(names)[least]
    moved = root != names
    return pa.table({"a": root[moved], "b": names[moved]})


def starred(met: DataFrame, texts: DataFrame) -> DataFrame:
    """node, comp: what links with chosen sets connect among the sets of hot signatures. met: sig, node; texts: node, z.

    A set picks one of its signatures a round, the least under a hash of the round, so near copies pick alike; of those that
    picked one, one is compared with all others, and what links with it is held by it and takes no part any more. So a
    round compares each set once at most. Rounds end when what is left fits one block or hardly shrinks, or picks are
    used up; blocks do the rest exactly.
    """
    picks = saved(met.groupBy("node").agg(*(F.min(F.struct(F.xxhash64("sig", F.lit(turn)), "sig"))["sig"].alias(f"pick{turn}") for turn in range(PICKS))))
    comp, alive, left = picks.select("node", F.col("node").alias("comp")), picks, picks.count()
    x, y = (texts.select(F.col("node").alias(k), F.col("z").alias(f"z{k}")) for k in "ab")
    for turn in range(PICKS):
        if left <= BLOCK_SETS:
            break
        pick = F.col(f"pick{turn}")
        heads = alive.groupBy(pick.alias("pick")).agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node"))["node"].alias("a"))
        pairs = alive.join(heads, pick == heads["pick"]).select("a", F.col("node").alias("b")).where("a <> b")
        found = saved(pairs.join(x, "a").join(y, "b").sortWithinPartitions("a").select("a", "b", "za", "zb").mapInArrow(_linked, "a long, b long"))
        comp = comp.join(found, F.col("comp") == F.col("b"), "left").select("node", F.coalesce("a", "comp").alias("comp"))
        alive = alive.join(found, F.col("node") == F.col("b"), "left_anti")
        gone = found.count()
        if gone < left / 4:
            break
        left -= gone
    return saved(comp)


def dealt(own: DataFrame) -> DataFrame:
    """root, i, j, block, node, z: the sets of families (root, comp, node, n, z) for each pair of blocks that may hold an unknown link.

    A component that is larger than a block has blocks of its own, which aren't compared with each other; the others share
    blocks. Families of one component are done.
    """
    several = own.groupBy("root").agg((F.min("comp") != F.max("comp")).alias("open")).where("open").select("root")
    own = own.join(several, "root", "left_semi")
    count = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS))
    large = own.groupBy("root", "comp").agg(count.alias("k")).where("k > 1").select("root", "comp", F.lit(True).alias("large"))
    own = own.join(large, ["root", "comp"], "left").withColumn("part", F.when(F.col("large"), F.col("comp")))
    parts = own.groupBy("root", "part").agg(count.alias("k"))
    order = Window.partitionBy("root").orderBy("part")  # a row for each block at most
    parts = parts.withColumn("first", F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("k"))
    listed = F.array_sort(F.collect_list(F.struct("first", "part", "k")))
    plan = parts.groupBy("root").agg(F.flatten(F.transform(listed, lambda s: F.array_repeat(s["part"], s["k"].cast("int")))).alias("parts"))
    mine = parts.select(F.col("root").alias("r"), F.col("part").alias("p"), "k", "first")
    own = own.join(mine, (F.col("root") == F.col("r")) & F.col("part").eqNullSafe(F.col("p"))).join(plan, "root")
    own = own.withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), "k"))
    open_to = F.filter(F.transform("parts", lambda p, i: F.when(p.isNull() | F.col("part").isNull() | (p != F.col("part")), i.cast("long"))), lambda i: i.isNotNull())
    own = own.withColumn("other", F.explode(open_to))
    return own.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "z")


def hot_links(groups: DataFrame, texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): connects the sets of each hot signature that links connect. groups: sig, node; texts: node, z; sizes: node, n."""
    spark = groups.sparkSession
    buckets = partitions(spark)
    mine = saved(texts.join(groups.select("node").distinct(), "node", "left_semi").join(sizes, "node"))
    elements = mine.select("node", "z").mapInArrow(partial(_elements, buckets=buckets), "bucket long, grams binary, nodes binary")
    alone = elements.groupBy("bucket").applyInArrow(_alone, "node long, alone long").groupBy("node").agg(F.sum("alone").alias("alone"))
    able = saved(mine.join(alone, "node", "left").where(F.coalesce("alone", F.lit(0)) * DOWN <= F.col("n") * (DOWN - UP)).drop("alone"))
    met = saved(groups.join(able.select("node"), "node", "left_semi"))
    comp = starred(met, able)
    least = met.groupBy("sig").agg(F.min("node").alias("a"))
    families = components(met.join(least, "sig").where("node > a").select("a", F.col("node").alias("b")).distinct())
    own = families.join(comp, "node").join(able, "node")
    links = dealt(own).groupBy("root", "i", "j").applyInArrow(_families, "a long, b long")
    return comp.where("comp <> node").select(F.col("comp").alias("a"), F.col("node").alias("b")).union(links)


def ngram_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), utf8("text").alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    blobs = docs.mapInArrow(_index(partitions(spark)), BLOB)
    rows = saved(blobs.groupBy("bucket").applyInArrow(_shared, ROWS))
    found = rows.where("kind = 0").select(F.col("v0").alias("doc_id"), F.col("v1").alias("n"), F.col("v2").alias("node"), F.col("v3").alias("hash"))
    pairs = rows.where("kind = 1").groupBy(F.col("v0").alias("a"), F.col("v1").alias("b")).agg(F.sum("v2").alias("shared"), F.max("v3").alias("lose_a"), F.max("v4").alias("lose_b"))
    hot = rows.where("kind = 2").select(F.col("v0").alias("sig"), F.col("v1").alias("node"), F.col("v2").alias("lose"), F.col("v3").alias("own"), F.col("v4").alias("sets"))
    first = found.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "hash")).alias("own"), F.first("n").alias("n")).select("node", "own.*", "n")

    # A linked pair shares at least so many signatures as either set can lose, and one; less its hot ones, which weren't paired.
    every = hot.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    for x in "ab":
        pairs = pairs.join(every.select(F.col("node").alias(x), F.col("k").alias(f"k_{x}")), x, "left")
    cold = F.greatest(F.col("lose_a") - F.coalesce("k_a", F.lit(0)), F.col("lose_b") - F.coalesce("k_b", F.lit(0))) + 1
    near = saved(pairs.where(F.col("shared") >= cold).select("a", "b"))
    # What a set can lose it needn't be found by: of its hot signatures the ones that most sets share. Of all that two linked sets
    # share, the one with the fewest sets comes before more than either can lose, so both keep it.
    mine = Window.partitionBy("node", "own")
    place = F.row_number().over(mine.orderBy("sets", "sig"))
    kept = hot.select("sig", "node", place.alias("place"), (F.count(F.lit(1)).over(mine) - F.min("lose").over(mine)).alias("needs"))
    groups = saved(kept.where("place <= needs").select("sig", "node"))

    needed = near.select(F.explode(F.array("a", "b")).alias("node")).union(groups.select("node")).distinct().join(first.select("node", "doc_id", "hash"), "node")
    packed = docs.mapInArrow(_packed, "doc_id long, hash long, z binary")
    texts = saved(packed.join(needed.hint("shuffle_hash"), ["doc_id", "hash"]).mapInArrow(_named, "node long, z binary").dropDuplicates(["node"]))
    x, y = (texts.select(F.col("node").alias(k), F.col("z").alias(f"z{k}")) for k in "ab")
    links = near.join(x, "a").join(y, "b").sortWithinPartitions("b").select("a", "b", "za", "zb").mapInArrow(_linked, "a long, b long")
    roots = components(links.union(hot_links(groups, texts, first.select("node", "n"))))
    named = found.join(roots, "node", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))
    ids = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    real = F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id")
    return named.join(ids, "root", "left").select(real, F.col("n").alias("n_shingles"), F.expr(f"nullif(coalesce(least, doc_id), {NO_ID})").alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))
