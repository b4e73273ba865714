"""Exact top-k search by integer inner product: a ball tree for each shard, searched best bound first.

Components become integers (``floor(256 * x)``). Candidates are dealt to shards of about ``SHARD`` vectors, so no shard is
hot, and each shard's ball tree is stored as one row. Queries are packed into blocks; a task holds one shard and one
block. No vector of a ball with centre ``c`` and radius ``r`` has a greater product with ``q`` than ``q.c + |q| r``, so a
node whose bound is below the query's kth score is left out with all below it; the leaves that remain are met in order of
their bounds, which raises the kth score early. Each block first searches one shard, and the kth scores found there are
shared with its searches of all others: these return only what reaches them, and everything is exact.

Of equal vectors in a shard, those with the ``k + 1`` smallest ids can be in a result (one of them may be the query's own),
so copies cost nothing however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, usable_parts

K = 5
SCALE = 256
#: Vectors of a shard, queries of a block, vectors of a leaf: about 2.5 MB and 0.3 MB for 64 parts of two bytes.
SHARD, BLOCK, LEAF = 16_384, 2_048, 64
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Bounds are taken higher by this share of their terms, far more than rounding costs.
MARGIN = 1e-9


def packed(x: np.ndarray) -> tuple[bytes, str]:
    """Integers held in doubles, in the smallest type that holds them."""
    top = np.abs(x).max(initial=0)
    kind = "<i1" if top < 2**7 else "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return x.astype(kind).tobytes(), kind


def unpacked(data: bytes, kind: str, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.float64).reshape(n, dim)


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows, and for each node, parents first: centre, radius, and (parent, begin, end, is a leaf)."""
    order, queue = np.arange(len(x)), [(-1, 0, len(x))]
    centres, radii, shape = [], [], []
    for parent, begin, end in queue:  # grows while it is read
        own = x[order[begin:end]]
        centre = own.mean(0)
        away = np.linalg.norm(own - centre, axis=1)
        split = end - begin > leaf
        if split:
            middle = (end - begin) // 2
            along = np.argpartition(own @ (own[away.argmax()] - centre), middle)
            order[begin:end] = order[begin:end][along]
            queue += [(len(shape), begin, begin + middle), (len(shape), begin + middle, end)]
        centres.append(centre)
        radii.append(away.max())
        shape.append((parent, begin, end, not split))
    return order, np.array(centres).reshape(len(shape), -1), np.array(radii), np.array(shape, np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers; beyond 64 bits they stay at the end of the range."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(whole, LOWEST + 1, HIGHEST).astype(np.int64)


class Search:
    """The best candidates of a block of queries so far; ``floor`` is the kth score known from elsewhere."""

    def __init__(self, q: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int):
        self.q, self.rows, self.floor, self.k = q, rows, floor, k
        self.scores = np.full((len(q), k), LOWEST)
        self.ids = np.full((len(q), k), HIGHEST)

    def meet(self, some: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Holds the queries ``some`` against the vectors ``x``."""
        scores = products(self.q[some], x)
        scores[self.rows[some][:, None] == rows] = LOWEST
        hit = (scores >= self.kth(some)[:, None]).any(1)
        some, scores = some[hit], scores[hit]
        both = np.concatenate([self.scores[some], scores], 1)
        names = np.concatenate([self.ids[some], np.broadcast_to(ids, scores.shape)], 1)
        best = np.lexsort((names, ~both), axis=1)[:, : self.k]
        self.scores[some], self.ids[some] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)

    def kth(self, some: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[some], self.scores[some, self.k - 1])

    def through(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Branch and bound: nodes below a query's kth score are left out, leaves are met in order of their bounds.

        The leaves of a query are taken 1, 2, 4, ... at a time, and its kth score is looked at again before each, so that
        the queries that meet a leaf can be multiplied with it together.
        """
        centres, radii, shape = tree
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.linalg.norm(self.q, axis=1)[:, None] * radii
            bound = self.q @ centres.T
            bound += far + MARGIN * (np.abs(self.q) @ np.abs(centres).T + far) + 1e-6
        every = np.arange(len(self.q))
        alive = ~(bound < self.kth(every)[:, None])  # a bound that is not a number excludes nothing
        for node, parent in enumerate(shape[1:, 0], 1):
            alive[:, node] &= alive[:, parent]
        leaves = np.flatnonzero(shape[:, 3])
        bound = np.where(alive[:, leaves], np.nan_to_num(bound[:, leaves], nan=np.inf), -np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")
        at = 0
        while at < len(leaves):
            query, place = np.divmod(np.arange(len(every) * min(at + 1, len(leaves) - at)), min(at + 1, len(leaves) - at))
            leaf = order[query, at + place]
            met = ~(bound[query, leaf] < self.kth(query)) & (bound[query, leaf] > -np.inf)
            query, leaf = query[met], leaf[met]
            grouped = np.argsort(leaf, kind="stable")
            query, leaf = query[grouped], leaf[grouped]
            for some in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
                if len(some):
                    own = query[some]
                    own = own[~(bound[own, leaf[some[0]]] < self.kth(own))]
                    a, b = shape[leaves[leaf[some[0]]], 1:3]
                    self.meet(own, x[a:b], ids[a:b], rows[a:b])
            at += at + 1


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns row_no, vec_id, dim, parts (doubles) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, dims, parts = usable_parts(batch.column(2), float(SCALE))
            parts = np.floor(parts) + 0.0
            ends = np.concatenate([[0], np.cumsum(dims)])
            cut = [parts[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            some = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(dims, pa.int32()), pa.array(cut, pa.binary())], ["row_no", "vec_id", "dim", "parts"])

    own = vectors.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return own.where("vec_id is not null").mapInArrow(run, "row_no long, vec_id long, dim int, parts binary")


def _rows(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dim = int(group.column("dim")[0].as_py())
    x = np.frombuffer(b"".join(group.column("parts").to_pylist()), np.float64).reshape(len(group), dim)
    return x, group.column("vec_id").to_numpy(), group.column("row_no").to_numpy()


def _indexed(k: int, leaf: int):
    def run(group: pa.Table) -> pa.Table:
        x, ids, rows = _rows(group)
        same = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1) if x.shape[1] else np.zeros(len(x), np.int64)
        order = np.lexsort((rows, ids, same))
        begins = np.flatnonzero(np.diff(same[order], prepend=-1))
        kept = order[np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order))) <= k]
        x, ids, rows = x[kept], ids[kept], rows[kept]
        order, centres, radii, shape = ball_tree(x, leaf)
        data, kind = packed(x[order])
        row = {"dim": x.shape[1], "shard": group.column("shard")[0].as_py(), "kind": kind, "parts": data, "ids": ids[order].tobytes(), "rows": rows[order].tobytes()}
        row |= {"centres": centres.tobytes(), "radii": radii.tobytes(), "shape": shape.tobytes()}
        return pa.Table.from_pylist([row], pa.schema(_TREE))

    return run


_TREE = [("dim", pa.int32()), ("shard", pa.int64()), ("kind", pa.string())] + [(c, pa.binary()) for c in ("parts", "ids", "rows", "centres", "radii", "shape")]
_BLOCK = [("dim", pa.int32()), ("block", pa.int64()), ("kind", pa.string())] + [(c, pa.binary()) for c in ("parts", "ids", "rows", "floor")]


def _schema(fields: list) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{c} {names[t]}" for c, t in fields)


def _pack(group: pa.Table) -> pa.Table:
    x, ids, rows = _rows(group)
    data, kind = packed(x)
    row = {"dim": x.shape[1], "block": group.column("block")[0].as_py(), "kind": kind, "parts": data}
    return pa.Table.from_pylist([row | {"ids": ids.tobytes(), "rows": rows.tobytes(), "floor": group.column("floor").to_numpy().tobytes()}], pa.schema(_BLOCK))


def _search(k: int):
    def run(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        empty = {"row_no": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if not len(shards) or not len(blocks):
            return pa.table(empty)
        tree, block = shards.to_pylist()[0], blocks.to_pylist()[0]
        dim = tree["dim"]
        number = lambda row, c: np.frombuffer(row[c], np.int64)
        ids, rows, queries = number(tree, "ids"), number(tree, "rows"), number(block, "ids")
        search = Search(unpacked(block["parts"], block["kind"], dim, len(queries)), number(block, "rows"), number(block, "floor"), k)
        nodes = np.frombuffer(tree["radii"])
        shape = (np.frombuffer(tree["centres"]).reshape(len(nodes), dim), nodes, number(tree, "shape").reshape(-1, 4))
        search.through(shape, unpacked(tree["parts"], tree["kind"], dim, len(ids)), ids, rows)
        good = (search.scores > LOWEST) & (search.scores >= search.floor[:, None])
        query, _ = np.nonzero(good)
        return pa.table(dict(zip(empty, (search.rows[query], queries[query], search.ids[good], search.scores[good]))))

    return run


def top_products(
    vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF
) -> DataFrame:
    """The ``k`` highest products of each query: query_id, rank, vec_id, score; equal scores by ascending vec_id.

    Queries are the rows whose id ``every`` divides, candidates all rows but the query's own. Vectors that are null or
    have null or non-finite parts, and rows with a null id, take no part. Vectors meet those of their own length only, and
    empty ones have product 0. Rows that repeat an id are queries and candidates of their own, so ranks then repeat for
    the id. Products beyond 64 bits stay at the end of the range. A table with too few rows gives what there is.
    """
    usable = stored(_usable(vectors, id_col, vector_col))
    asked = F.col("vec_id") % every == 0
    sizes = stored(usable.groupBy("dim").agg(F.ceil(F.count("*") / shard).alias("shards"), F.ceil(F.count_if(asked) / block).alias("blocks")))
    known = usable.join(sizes, "dim")
    deal = lambda n, seed: F.pmod(F.xxhash64("row_no", F.lit(seed)), F.col(n))
    trees = stored(known.withColumn("shard", deal("shards", 1)).groupBy("dim", "shard").applyInArrow(_indexed(k, leaf), _schema(_TREE)))
    queries = stored(known.where(asked).select("dim", "row_no", "vec_id", "parts", deal("blocks", 2).alias("block")))
    home = F.col("block") % F.col("shards") == F.col("shard")

    def searched(floors: DataFrame | None, where) -> DataFrame:
        floor = F.lit(LOWEST) if floors is None else F.coalesce("floor", F.lit(LOWEST))
        asking = queries if floors is None else queries.join(floors, "row_no", "left")
        blocks = asking.withColumn("floor", floor).groupBy("dim", "block").applyInArrow(_pack, _schema(_BLOCK))
        every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = trees.join(sizes, "dim").where("blocks > 0").withColumn("block", every_of("blocks")).where(where).drop("shards", "blocks")
        right = stored(blocks).join(sizes, "dim").withColumn("shard", every_of("shards")).where(where).drop("shards", "blocks")
        pair = ["dim", "shard", "block"]
        return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(_search(k), "row_no long, query_id long, vec_id long, score long")

    first = stored(searched(None, home))
    floors = first.groupBy("row_no").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
    found = first.unionByName(stored(searched(floors, ~home)))
    rank = F.row_number().over(Window.partitionBy("row_no").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
