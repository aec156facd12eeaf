"""Operator 6: approximate nearest neighbours by NN-descent, searched greedily.

Equal vectors are one node (its ten least ids and one more stand for it, which is all that ten nearest can need). Nodes are
dealt to home blocks: those of equal signs under random hyperplanes, split by a hash where they exceed CELL nodes. A
block is one row: its vectors and, as a matrix, each node's DEGREE nearest so far, which begin as the nearest in the block,
in a block under other hyperplanes, and in one of SPREAD nodes dealt by a hash, so that a node alone in its cell, or a small
group, is in the graph and leaves itself. Then rounds join the graph with itself: a node's neighbours and a sample of
those whose neighbour it is are compared pairwise, and every node keeps its DEGREE nearest, until few change. Since a block's
nodes are near each other, so are most neighbours, and a block asks others once for a vector that several nodes need.

A query starts at its own node and visits, again and again, the neighbours of the nearest WIDTH nodes that it has seen,
until all are visited. What goes between blocks are requests and answers, as rows that hold arrays. Neither rounds
nor visits have a limit: distances only fall and nodes are visited once, so both end. Nothing is broadcast or gathered but
the hyperplanes (a fixed number), the means of the dimensions and counts.

Cases: vectors that are null, zero, of another length than most, or that hold null or a non-finite number take no
part, as do null ids; a repeated id counts once, with its least vector that takes part; ties go to the smaller id; fewer than
k candidates: all of them; no rows: no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from marginalia.llm.common import Stored, mixed, saved, table

K = 10
DEGREE = 24
#: Sampled of those whose neighbour a node is.
REVERSE = 20
#: Nodes of a home block, and of one under other hyperplanes, about.
CELL = 2_048
#: Nodes of a block dealt by a hash; well over DEGREE.
SPREAD = 100
#: Rounds end when fewer edges than this share of all change.
SETTLED = 0.002
WIDTH = 100
SEED = 77
#: A node's number is its block's, shifted by so many bits, and its place there.
SHIFT = 24

#: A block: its nodes' least ids, whether a query, cell under the other hyperplanes, vectors, neighbours' numbers (-1: none) and squared distances; edges that changed.
BLOCK = "block long, node binary, asked binary, cell binary, vec binary, nbr binary, d binary, moved long"
#: To a block: places of its nodes, the numbers of others, squared distances.
EDGES = "to long, at binary, who binary, d binary"


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, vec of the rows that take part but for their vectors' length."""
    x = F.col("embedding")
    fit = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    kind = "double" if isinstance(rows.schema["embedding"].dataType.elementType, DoubleType) else "float"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast(f"array<{kind}>").alias("embedding")).where("vec_id is not null").where(fit)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("vec"))


def nodes(rows: DataFrame) -> DataFrame:
    """node (its least id), ids (at most K + 1, ascending), vec."""
    rows = taking_part(rows)
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    rows = rows.join(F.broadcast(most.select("n")), F.size("vec") == F.col("n"), "left_semi")
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))  # each task keeps K + 1 of a vector before any move
    least = rows.withColumn("place", place).where(F.col("place") <= K + 1)
    return saved(least.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "vec"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the last two axes' rows, by the products' way; not below zero."""
    xx, yy = (x * x).sum(-1), (y * y).sum(-1)
    with np.errstate(invalid="ignore", over="ignore"):
        d = np.maximum(xx[..., :, None] + yy[..., None, :] - 2 * x @ np.swapaxes(y, -1, -2), 0)
    return np.nan_to_num(d, copy=False, nan=np.inf, posinf=np.inf)


def _nearest_in(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of each vector's nearest others, at most DEGREE."""
    k, near, far = min(DEGREE, len(x) - 1), [], []
    if k <= 0:
        return np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0))
    for i in range(0, len(x), 512):
        d = _distances(x[i : i + 512], x)
        d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
        near.append(np.argpartition(d, k - 1, axis=1)[:, :k])
        far.append(np.take_along_axis(d, near[-1], 1))
    return np.concatenate(near), np.concatenate(far)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, pa.int64() if kind == "long" else pa.binary()) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run."""
    cut = np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)] if len(x) else np.zeros(1, np.int64)
    return zip(x[cut[:-1]].tolist(), cut[:-1], cut[1:])


def _sent(target: np.ndarray, who: np.ndarray, d: np.ndarray) -> pa.Table:
    """Edges of the nodes numbered target, to their blocks."""
    order = np.argsort(target, kind="stable")
    target, who, d = target[order], who[order], d[order].astype(np.float64)
    at = (target & ((1 << SHIFT) - 1)).astype(np.int32)
    return _rows(EDGES, [(to, at[i:j].tobytes(), who[i:j].tobytes(), d[i:j].tobytes()) for to, i, j in _runs(target >> SHIFT)])


def _first(key: np.ndarray, *order: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` entries of each key, by these orders."""
    by = np.lexsort((*reversed(order), key))
    sorted_key = key[by]
    head = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(key) else np.zeros(0, np.int64)
    rank = np.arange(len(key)) - np.repeat(head, np.diff(np.r_[head, len(key)]))
    return by[rank < most]


class Space:
    """The shape of the vectors, and what blocks do; sent to the tasks with its methods."""

    def __init__(self, dimension: int, kind: str, n: int, planes: list[np.ndarray], mean: np.ndarray):
        self.dimension, self.kind, self.n, self.planes, self.mean = dimension, kind, n, planes, mean

    def vectors(self, cell: bytes) -> np.ndarray:
        return np.frombuffer(cell, self.kind).reshape(-1, self.dimension)

    def signed(self, batches):
        """Each node's cells under the hyperplanes."""
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(self.kind).reshape(-1, self.dimension)
            codes = [pa.array(((x - self.mean) @ p > 0) @ (1 << np.arange(p.shape[1])).astype(np.int64), pa.int64()) for p in self.planes]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("asked"), pa.array([v.tobytes() for v in x], pa.binary()), *codes], ["node", "asked", "vec", "home", "cell"])

    def built(self, group: pa.Table) -> pa.Table:
        """A home block, each node with its nearest there."""
        order = np.argsort(group["node"].to_numpy())
        node, asked, cell = (group[k].to_numpy()[order] for k in ("node", "asked", "cell"))
        vec = group["vec"].to_pylist()
        x, block = self.vectors(b"".join(vec[i] for i in order)), group["block"][0].as_py()
        near, d = _nearest_in(x)
        nbr, far = np.full((len(x), DEGREE), -1, np.int64), np.full((len(x), DEGREE), np.inf)
        nbr[:, : near.shape[1]], far[:, : near.shape[1]] = block << SHIFT | near, d
        return _rows(BLOCK, [(block, node.tobytes(), asked.tobytes(), cell.tobytes(), x.tobytes(), nbr.tobytes(), far.tobytes(), 0)])

    def dealt(self, batches):
        """Numbers and vectors by the other cells, and by a hash."""
        for b in batches:
            for row in b.to_pylist():
                x, cell = self.vectors(row["vec"]), np.frombuffer(row["cell"], np.int64)
                gid = row["block"] << SHIFT | np.arange(len(x))
                spread = (mixed(gid.astype(np.uint64) ^ np.uint64(SEED)) % np.uint64(-(-self.n // SPREAD))).astype(np.int64)
                parts = [np.repeat([0, 1], len(x)), np.r_[cell, spread], np.r_[gid, gid]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in parts), pa.array([v.tobytes() for v in x] * 2, pa.binary())], ["t", "code", "gid", "vec"])

    def near_there(self, group: pa.Table) -> pa.Table:
        """The nearest within another block, to the home blocks."""
        gid, x = group["gid"].to_numpy(), self.vectors(b"".join(group["vec"].to_pylist()))
        near, d = _nearest_in(x)
        return _sent(np.repeat(gid, near.shape[1]), gid[near.ravel()], d.ravel())

    def opened(self, row: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        nbr = np.frombuffer(row["nbr"], np.int64)
        x = self.vectors(row["vec"])
        return row["block"], x, nbr.reshape(len(x), -1), np.frombuffer(row["d"], np.float64).reshape(len(x), -1)

    def merged(self, known: pa.Table, told: pa.Table) -> pa.Table:
        """A block after edges told: each node keeps the DEGREE nearest."""
        row = known.to_pylist()[0]
        block, x, nbr, d = self.opened(row)
        at, who, far = self._edges(told)
        u, v, e = np.r_[np.repeat(np.arange(len(x)), DEGREE), at], np.r_[nbr.ravel(), who], np.r_[d.ravel(), far]
        new = np.r_[np.zeros(nbr.size, bool), np.ones(len(at), bool)]
        there = np.flatnonzero((v >= 0) & (v != (block << SHIFT | u)))
        there = there[np.lexsort((new[there], v[there], u[there]))]
        once = np.r_[True, (u[there][1:] != u[there][:-1]) | (v[there][1:] != v[there][:-1])] if len(there) else np.zeros(0, bool)
        u, v, e, new = (z[there[once]] for z in (u, v, e, new))
        keep = _first(u, e, v, most=DEGREE)
        u, v, e, new = (z[keep] for z in (u, v, e, new))
        head = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
        rank = np.arange(len(u)) - np.repeat(head, np.diff(np.r_[head, len(u)]))
        nbr, d = np.full((len(x), DEGREE), -1, np.int64), np.full((len(x), DEGREE), np.inf)
        nbr[u, rank], d[u, rank] = v, e
        row |= {"nbr": nbr.tobytes(), "d": d.tobytes(), "moved": int(new.sum())}
        return _rows(BLOCK, [tuple(row[c.split()[0]] for c in BLOCK.split(", "))])

    @staticmethod
    def _edges(told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, who, d = (np.frombuffer(b"".join(told[k].to_pylist()), kind) for k, kind in (("at", np.int32), ("who", np.int64), ("d", np.float64)))
        return at.astype(np.int64), who, d

    def turned(self, batches):
        """Edges the other way, at most REVERSE of a block to one node, by a hash."""
        for b in batches:
            for row in b.to_pylist():
                block, x, nbr, d = self.opened(row)
                u, v, d = np.repeat(block << SHIFT | np.arange(len(x)), DEGREE), nbr.ravel(), d.ravel()
                u, v, d = u[v >= 0], v[v >= 0], d[v >= 0]
                keep = _first(v, mixed(u.astype(np.uint64) * np.uint64(31) ^ v.astype(np.uint64)), most=REVERSE)
                yield from _sent(v[keep], u[keep], d[keep]).to_batches()

    def members(self, row: dict, told: pa.Table) -> np.ndarray:
        """Of each node the numbers of its neighbours and a sample of those whose neighbour it is."""
        block, x, nbr, _ = self.opened(row)
        at, who, _ = self._edges(told)
        keep = _first(at, mixed(who.astype(np.uint64) * np.uint64(31) ^ (block << SHIFT | at).astype(np.uint64)), most=REVERSE)
        at, who = at[keep], who[keep]
        head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        more = np.full((len(x), REVERSE), -1, np.int64)
        more[at, np.arange(len(at)) - np.repeat(head, np.diff(np.r_[head, len(at)]))] = who
        return np.concatenate([nbr, more], axis=1)

    def asking(self, known: pa.Table, told: pa.Table) -> pa.Table:
        """Members, and to each other block the places of those of its nodes that are among them."""
        row = known.to_pylist()[0]
        members = self.members(row, told)
        wanted = np.unique(members[members >= 0])
        wanted = wanted[wanted >> SHIFT != row["block"]]
        at = (wanted & ((1 << SHIFT) - 1)).astype(np.int32)
        rows = [(to, row["block"], None, at[i:j].tobytes()) for to, i, j in _runs(wanted >> SHIFT)]
        return _rows("to long, block long, members binary, at binary", [(row["block"], row["block"], members.tobytes(), None), *rows])

    def answering(self, known: pa.Table, asked: pa.Table) -> pa.Table:
        """The vectors asked for, and each one's greatest distance to a neighbour."""
        rows = []
        if len(asked):
            block, x, _, d = self.opened(known.to_pylist()[0])
            worst = d.max(1)
            for r in asked.to_pylist():
                at = np.frombuffer(r["at"], np.int32)
                rows.append((r["block"], None, (block << SHIFT | at.astype(np.int64)).tobytes(), x[at].tobytes(), worst[at].tobytes()))
        return _rows("block long, members binary, gid binary, vec binary, worst binary", rows)

    def compared(self, known: pa.Table, told: pa.Table) -> pa.Table:
        """Among each node and its members, the pairs nearer than what either has."""
        block, x, _, d = self.opened(known.to_pylist()[0])
        rows = told.to_pylist()
        gid = [block << SHIFT | np.arange(len(x))] + [np.frombuffer(r["gid"], np.int64) for r in rows if r["gid"]]
        vec = np.concatenate([x, *(self.vectors(r["vec"]) for r in rows if r["gid"])])
        worst = np.concatenate([d.max(1), *(np.frombuffer(r["worst"], np.float64) for r in rows if r["gid"])])
        gid = np.concatenate(gid)
        order = np.argsort(gid)
        gid, vec, worst = gid[order], vec[order], worst[order]
        members = np.frombuffer(next(r["members"] for r in rows if r["members"]), np.int64).reshape(len(x), -1)
        members = np.concatenate([(block << SHIFT | np.arange(len(x)))[:, None], members], axis=1)
        place = np.where(members >= 0, np.searchsorted(gid, members), -1)
        found = []
        for i in range(0, len(place), 100):
            m = place[i : i + 100]
            far = _distances(vec[m], vec[m])
            better = (far < worst[m][:, :, None] * (1 - 1e-6)) & (m >= 0)[:, :, None] & (m >= 0)[:, None, :] & (m[:, :, None] != m[:, None, :])
            a, r, c = np.nonzero(better)
            found.append((m[a, r], m[a, c], far[a, r, c]))
        a, b, far = (np.concatenate(z) for z in zip(*found))
        _, one = np.unique(a * len(gid) + b, return_index=True)
        a, b, far = a[one], b[one], far[one]
        keep = _first(a, far, b, most=DEGREE)  # a node's nearest of this block are enough
        return _sent(gid[a[keep]], gid[b[keep]], far[keep])

    # --- search -------------------------------------------------------------

    def linked(self, known: pa.Table, told: pa.Table) -> pa.Table:
        """The block with members as neighbours."""
        row = known.to_pylist()[0]
        row["nbr"] = self.members(row, told).tobytes()
        return _rows(BLOCK, [tuple(row[c.split()[0]] for c in BLOCK.split(", "))])

    def started(self, batches):
        """A block's queries, each about to visit its own node."""
        for b in batches:
            for row in b.to_pylist():
                at = np.flatnonzero(np.frombuffer(row["asked"], bool))
                if len(at):
                    names, gid = np.frombuffer(row["node"], np.int64)[at], row["block"] << SHIFT | at
                    none, who = b"", np.arange(len(at), dtype=np.int32)
                    yield from _rows(SEARCH, [(row["block"], names.tobytes(), self.vectors(row["vec"])[at].tobytes(), none, none, none, none, who.tobytes(), gid.tobytes(), len(at))]).to_batches()

    def visiting(self, batches):
        """To each block: which queries visit which of its nodes, and the queries' vectors."""
        for b in batches:
            rows = []
            for row in b.to_pylist():
                who, gid = np.frombuffer(row["next_who"], np.int32), np.frombuffer(row["next"], np.int64)
                order = np.argsort(gid >> SHIFT, kind="stable")
                who, gid, x = who[order], gid[order], self.vectors(row["x"])
                for to, i, j in _runs(gid >> SHIFT):
                    own, at = np.unique(who[i:j], return_inverse=True)
                    rows.append((to, row["grp"], who[i:j].tobytes(), gid[i:j].tobytes(), at.astype(np.int32).tobytes(), x[own].tobytes()))
            yield from _rows("to long, grp long, who binary, gid binary, own binary, x binary", rows).to_batches()

    def visited(self, known: pa.Table, asked: pa.Table) -> pa.Table:
        """Exact distances and neighbours of the nodes visited."""
        rows = []
        if len(asked):
            row = known.to_pylist()[0]
            _, x, nbr, _ = self.opened(row)
            names = np.frombuffer(row["node"], np.int64)
            for r in asked.to_pylist():
                at, own = np.frombuffer(r["gid"], np.int64) & ((1 << SHIFT) - 1), np.frombuffer(r["own"], np.int32)
                q, d = self.vectors(r["x"]).astype(np.float64), np.zeros(len(at))
                for i in range(0, len(at), 5_000):
                    d[i : i + 5_000] = np.sqrt(((x[at[i : i + 5_000]].astype(np.float64) - q[own[i : i + 5_000]]) ** 2).sum(1))
                rows.append((r["grp"], r["who"], r["gid"], names[at].tobytes(), d.tobytes(), nbr[at].tobytes()))
        return _rows("grp long, who binary, gid binary, name binary, d binary, nbr binary", rows)

    def advanced(self, known: pa.Table, told: pa.Table) -> pa.Table:
        """The queries after a visit: what they have seen, and what the nearest WIDTH of it lead to that they haven't."""
        if not len(told):
            return known.set_column(known.column_names.index("todo"), "todo", pa.array([0] * len(known), pa.int64()))
        row, rows = known.to_pylist()[0], told.to_pylist()
        kinds = {"who": np.int32, "gid": np.int64, "name": np.int64, "d": np.float64}
        seen = {k: np.concatenate([np.frombuffer(x[k], kind) for x in (row, *rows)]) for k, kind in kinds.items()}
        fresh = np.r_[np.zeros(len(seen["who"]) - sum(len(r["who"]) // 4 for r in rows), bool), np.ones(sum(len(r["who"]) // 4 for r in rows), bool)]
        nbr = np.concatenate([np.frombuffer(r["nbr"], np.int64).reshape(len(r["who"]) // 4, -1) for r in rows])
        nearest = _first(seen["who"], seen["d"], seen["name"], most=WIDTH)
        opened = nearest[fresh[nearest]]
        lead = nbr[opened - (len(fresh) - len(nbr))]
        who, gid = np.repeat(seen["who"][opened], nbr.shape[1]), lead.ravel()
        who, gid = who[gid >= 0], gid[gid >= 0]
        old = np.r_[np.ones(len(fresh), bool), np.zeros(len(who), bool)]
        all_who, all_gid = np.r_[seen["who"], who], np.r_[seen["gid"], gid]
        order = np.lexsort((~old, all_gid, all_who))
        all_who, all_gid, old = all_who[order], all_gid[order], old[order]
        new = np.r_[True, (all_who[1:] != all_who[:-1]) | (all_gid[1:] != all_gid[:-1])] & ~old
        row |= {k: x.tobytes() for k, x in seen.items()} | {"next_who": all_who[new].astype(np.int32).tobytes(), "next": all_gid[new].tobytes(), "todo": int(new.sum())}
        return _rows(SEARCH, [tuple(row[c.split()[0]] for c in SEARCH.split(", "))])

    def results(self, batches, most: int):
        for b in batches:
            for row in b.to_pylist():
                q, who, name, d = (np.frombuffer(row[k], kind) for k, kind in (("q", np.int64), ("who", np.int32), ("name", np.int64), ("d", np.float64)))
                keep = _first(who, d, name, most=most)
                yield pa.RecordBatch.from_arrays([pa.array(q[who[keep]]), pa.array(name[keep]), pa.array(d[keep])], ["q", "v", "d"])


#: A block's queries: their nodes' ids and vectors; of each node seen the query's place, number, id and exact distance; what is to be visited next, and how much.
SEARCH = "grp long, q binary, x binary, who binary, gid binary, name binary, d binary, next_who binary, next binary, todo long"


def _two(method: Callable) -> Callable:
    """A method as a function of two tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return method(left, right)

    return run


def _one(method: Callable) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        return method(group)

    return run


def space(points: DataFrame, n: int, dimension: int) -> Space:
    rng = np.random.default_rng(SEED)
    bits = min(30, max(0, math.ceil(math.log2(max(1, n / CELL)))))
    means = points.select(*(F.avg(F.col("vec")[i]).alias(f"m{i}") for i in range(dimension))).first()
    kind = "f8" if isinstance(points.schema["vec"].dataType.elementType, DoubleType) else "f4"
    mean = np.nan_to_num(np.array([float(m or 0) for m in means])).astype(kind)
    return Space(dimension, kind, n, [rng.normal(size=(dimension, bits)).astype(kind) for _ in range(2)], mean)


def _split(rows: DataFrame, by: list[str], most: int, codes: int) -> DataFrame:
    """rows with `parts`: into how many parts their cell is to be split."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("parts"))
    return rows.join(F.broadcast(sizes) if codes <= 1 << 16 else sizes, by)


def start_graph(points: DataFrame, own: Space) -> Stored:
    """Blocks, each node with its nearest of three blocks. points: node, asked, vec."""
    codes = 1 << own.planes[0].shape[1]
    signed = points.select("node", "asked", "vec").mapInArrow(own.signed, "node long, asked boolean, vec binary, home long, cell long")
    parted = _split(signed, ["home"], CELL, codes)
    most = parted.agg(F.max("parts")).first()[0]
    shift = (most - 1).bit_length()
    block = F.shiftleft("home", shift).bitwiseOR(F.pmod(F.xxhash64("node", F.lit(SEED)), "parts")).alias("block")
    home = Stored(parted.select(block, "node", "asked", "vec", "cell").groupBy("block").applyInArrow(_one(own.built), BLOCK), "blocks")
    dealt = home.df.select("block", "cell", "vec").mapInArrow(own.dealt, "t long, code long, gid long, vec binary")
    other = _split(dealt, ["t", "code"], max(CELL, 2 * SPREAD), codes + own.n // SPREAD).withColumn("part", F.pmod(F.xxhash64("gid", F.lit(SEED)), "parts"))
    edges = other.groupBy("t", "code", "part").applyInArrow(_one(own.near_there), EDGES)
    blocks = Stored(home.df.groupBy("block").cogroup(edges.groupBy("to")).applyInArrow(_two(own.merged), BLOCK), "blocks")
    home.drop()
    return blocks


def descend(blocks: Stored, own: Space) -> Stored:
    """Rounds of comparing neighbours of neighbours; the blocks given are dropped."""
    while True:
        by_block = blocks.df.groupBy("block")
        turned = blocks.df.mapInArrow(own.turned, EDGES)
        asked = Stored(by_block.cogroup(turned.groupBy("to")).applyInArrow(_two(own.asking), "to long, block long, members binary, at binary"), "asked")
        answers = "block long, members binary, gid binary, vec binary, worst binary"
        told = by_block.cogroup(asked.df.where("at is not null").groupBy("to")).applyInArrow(_two(own.answering), answers)
        none = F.lit(None).cast("binary")
        told = told.union(asked.df.where("at is null").select("block", "members", none, none, none))
        edges = by_block.cogroup(told.groupBy("block")).applyInArrow(_two(own.compared), EDGES)
        new = Stored(by_block.cogroup(edges.groupBy("to")).applyInArrow(_two(own.merged), BLOCK), "blocks")
        asked.drop(), blocks.drop()
        blocks = new
        if blocks.df.agg(F.sum("moved")).first()[0] <= SETTLED * own.n * DEGREE:
            return blocks


def search(blocks: Stored, own: Space, most: int) -> DataFrame:
    """q, v, d: of each query's node the nearest `most` nodes that a greedy search finds, itself included; the blocks given are dropped."""
    turned = blocks.df.mapInArrow(own.turned, EDGES)
    graph = Stored(blocks.df.groupBy("block").cogroup(turned.groupBy("to")).applyInArrow(_two(own.linked), BLOCK), "graph")
    blocks.drop()
    queries = Stored(graph.df.mapInArrow(own.started, SEARCH), "queries")
    while queries.df.agg(F.sum("todo")).first()[0]:
        asked = queries.df.where("todo > 0").mapInArrow(own.visiting, "to long, grp long, who binary, gid binary, own binary, x binary")
        told = graph.df.groupBy("block").cogroup(asked.groupBy("to")).applyInArrow(_two(own.visited), "grp long, who binary, gid binary, name binary, d binary, nbr binary")
        new = Stored(queries.df.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(_two(own.advanced), SEARCH), "queries")
        queries.drop()
        queries = new
    graph.drop()
    found = saved(queries.df.mapInArrow(lambda batches: own.results(batches, most), "q long, v long, d double"))
    queries.drop()
    return found


def nearest(rows: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k (at most K) nearest found of each row of vec_id, embedding for which is_query holds."""
    points = nodes(rows)
    shape = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dimension")).first()
    asked = taking_part(rows.where(is_query))
    # A query's node is found by its vector, for it may be beyond the node's K + 1 least ids.
    placed = saved(asked.join(points, "vec").select(F.col("vec_id").alias("query_id"), "node"))
    if not shape["n"] or placed.isEmpty():
        return placed.select("query_id", F.lit(0).alias("rank"), F.col("node").alias("vec_id"), F.lit(0.0).alias("score"))
    own = space(points, shape["n"], shape["dimension"])
    marked = placed.select("node").distinct().withColumn("asked", F.lit(True))
    blocks = start_graph(points.join(marked, "node", "left").select("node", F.coalesce("asked", F.lit(False)).alias("asked"), "vec"), own)
    found = search(descend(blocks, own), own, k + 1)
    near = placed.join(found, F.col("node") == F.col("q")).select("query_id", "v", "d")
    near = near.join(points.select(F.col("node").alias("v"), "ids"), "v").select("query_id", "d", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
