"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal unit vectors are one entry with a weight. Centroids are fitted on a bounded sample; every entry is assigned to its
cell. Two vectors closer than the threshold can lie on both sides of a cell border. Their chord is at most
``sqrt(2 - 2 threshold)``, so one of the two is within half of it of the plane between the two centroids; that one visits
the other's cell. So comparing each cell's own members with its members and visitors finds every pair, and few visit if
the vectors cluster. (A second test by the cells' angular radius excludes no further visit on the given tables.)

A cell larger than a block is dealt as pairs of blocks. Tasks count links and send a tree of each block's links; pairs
are not sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored, usable_parts
from .simhash import forest

THRESHOLD = 0.95
#: Vectors that the centroids are fitted on, a share by the hash of their id: so many, or so many for each cell if that is
#: more (and a tenth and a thousand besides). The sample then grows with the square root of the number of vectors.
FIT_VECTORS, FIT_PER_CELL = 10_000, 8
#: Vectors of a sample that the driver takes whole.
LOCAL_VECTORS = 20_000
#: Cells: this times the square root of the number of entries, so that finding the cell of a vector and comparing it
#: within cells cost alike at every size.
CELLS = 1.0
BLOCK = 512
#: Cosines with centroids that a task holds at a time.
COSINES = 4_000_000


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are not zero, and their unit vectors."""
    top = np.abs(x).max(1, initial=0)
    some = np.flatnonzero(top > 0)
    x = x[some] / top[some, None]  # so that squares neither vanish nor overflow
    return some, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cell_sums(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The sum of the rows nearest to each centroid, with a bounded number of cosines at a time."""
    sums, rows = np.zeros_like(centroids), max(1, COSINES // len(centroids))
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        np.add.at(sums, np.argmax(part @ centroids.T, 1), part)
    return sums


def moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The unit sums; a cell without members keeps its centroid."""
    norms = np.linalg.norm(sums, axis=1)
    return np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centroids)


def fit_centroids(sample: DataFrame, dim: int, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a sample (unit, order): unit centroids by cosine, beginning with its first rows.

    A sample of few vectors comes to the driver whole. Of a larger one only the centroids do: each round broadcasts them,
    and tasks send the sums of the vectors nearest to each, which are added up by cell.
    """
    spark = sample.sparkSession
    centroids = _vectors(sample.orderBy("order").limit(cells).select("unit").collect(), dim)
    if sample.count() <= LOCAL_VECTORS:
        x = _vectors(sample.orderBy("order").select("unit").collect(), dim)
        for _ in range(rounds):
            centroids = moved(centroids, cell_sums(x, centroids))
        return centroids
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros_like(sent.value)
            for batch in batches:
                own += cell_sums(_parts(batch.column(0), dim), sent.value)
            some = np.flatnonzero(own.any(1))
            for at in range(0, len(some), 1024):
                part = some[at : at + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([own[c].tobytes() for c in part], pa.binary())], ["cell", "total"])

        def added(group: pa.Table) -> pa.Table:
            total = _parts(group.column("total").combine_chunks(), dim).sum(0)
            return pa.table({"cell": group.column("cell")[:1], "total": pa.array([total.tobytes()], pa.binary())})

        found = sample.select("unit").mapInArrow(partial, "cell long, total binary").groupBy("cell").applyInArrow(added, "cell long, total binary")
        sums = np.zeros_like(centroids)
        for r in found.collect():  # one row for each cell
            sums[r["cell"]] = np.frombuffer(bytes(r["total"]))
        centroids = moved(centroids, sums)
    return centroids


def _parts(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _vectors(rows: list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.float64).reshape(-1, dim)


def visits(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and for each the other cells it visits (boolean matrix)."""
    cos = x @ centroids.T
    home = np.argmax(cos, 1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids[home] @ centroids.T)))
    half = math.sqrt(2 - 2 * threshold) / 2 + 1e-9
    near = cos[np.arange(len(x)), home][:, None] - cos <= half * apart
    near[np.arange(len(x)), home] = False
    return home, near


def _entries(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns vec_id, unit (binary, doubles), dim: one row for each usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, dims, parts = usable_parts(batch.column(1))
            ends = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims[dims > 0]).tolist():
                at = np.flatnonzero(dims == dim)
                some, x = units(parts[ends[at][:, None] + np.arange(dim)])
                x = x + 0.0  # no negative zero, so that equal vectors have equal bytes
                ids = batch.column(0).take(pa.array(rows[at[some]]))
                columns = [ids, pa.array([r.tobytes() for r in x], pa.binary()), pa.array([dim] * len(ids), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "unit", "dim"])

    own = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return own.mapInArrow(run, "vec_id long, unit binary, dim int")


def _cells(entries: DataFrame, fitted: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """One row for each cell that an entry belongs to or visits: cell, dim, own (its home cell), guests, entry columns."""
    centroids = entries.sparkSession.sparkContext.broadcast(fitted)  # one vector for each cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                fit = centroids.value[int(dim)]
                for at in range(0, some.num_rows, max(1, COSINES // len(fit))):
                    yield from cells_of(some.slice(at, max(1, COSINES // len(fit))), fit, int(dim))

    def cells_of(some: pa.RecordBatch, fit: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(b"".join(some.column(1).to_pylist()), np.float64).reshape(-1, dim)
        home, near = visits(x, fit, threshold)
        row, guest_of = np.nonzero(near)
        order = np.concatenate([np.arange(len(x)), row])
        cell = np.concatenate([home, guest_of]).astype(np.int32)
        # Only the row at home needs the list of cells that it visits.
        ends = np.concatenate([[0], np.cumsum(near.sum(1)), np.full(len(row), len(row))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(guest_of.astype(np.int32)))
        taken = some.take(pa.array(order))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell), pa.array(home[order].astype(np.int32)), lists, *taken.columns],
            ["cell", "own", "guests", *taken.schema.names],
        )

    return entries.select("vec_id", "unit", "weight", "dim").mapInArrow(
        run, "cell int, own int, guests array<int>, vec_id long, unit binary, weight long, dim int"
    )


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        left, cell = (group.column(c).to_numpy() for c in ("left", "cell"))
        own, ids, weight = (group.column(c).to_numpy() for c in ("own", "vec_id", "weight"))
        dim = int(group.column("dim")[0].as_py())
        x = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(-1, dim)
        lists = group.column("guests").combine_chunks()
        guests, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        # (row, visited cell) as one number.
        width = int(max(own.max(), guests.max(initial=0))) + 1
        visited = np.repeat(np.arange(len(ids)), np.diff(ends)) * width + guests[ends[0] : ends[-1]]
        # Single precision screens: its error for unit vectors is far below the margin. Double precision decides.
        rough = x.astype(np.float32)
        margin = np.float32(threshold - 1e-3)
        # Left rows are at home here; right rows are members or visitors. A row may stand on both sides.
        at, to = np.flatnonzero(left), np.flatnonzero(~left)
        right = rough[to]
        links = np.zeros(len(ids), np.int64)
        edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(at), BLOCK):
            rows = at[k : k + BLOCK]
            i, j = np.nonzero(rough[rows] @ right.T >= margin)
            i, j = rows[i], to[j]
            linked = ids[i] != ids[j]
            for n in range(0, len(i), 65_536):
                linked[n : n + 65_536] &= np.einsum("ij,ij->i", x[i[n : n + 65_536]], x[j[n : n + 65_536]]) >= threshold
            i, j = i[linked], j[linked]
            edges.append((i, j))
            # A pair of two cells that visit each other is met in both; the smaller cell counts it.
            guest = own[j] != cell[j]
            twice = guest & (own[j] < cell[j]) & np.isin(i * width + own[j], visited)
            i, j, guest = i[~twice], j[~twice], guest[~twice]
            np.add.at(links, i, weight[j])
            np.add.at(links, j[guest], weight[i[guest]])
        names, place = np.unique(ids, return_inverse=True)
        root = forest(len(names), *(place[np.concatenate(x)] for x in zip(*edges)))
        total = np.zeros(len(names), np.int64)
        np.add.at(total, place, links)
        some = np.flatnonzero((total > 0) | (root != np.arange(len(names))))
        return pa.table({"vec_id": names[some], "links": total[some], "root": names[root[some]]})

    return run


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", fit_vectors: int = FIT_VECTORS
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Pairs with a cosine of ``threshold`` or more in double precision link. A vector that is null, empty or zero, or has
    null or non-finite parts, links with nothing; so do vectors of different lengths and rows with a null id. Repeated
    rows of one id are vectors of their own, which link; each gets the row of its id. An empty table stays empty.
    """
    usable = stored(_entries(vectors, id_col, vector_col))
    entries = stored(
        usable.groupBy("unit", "dim").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    )
    fitted = {}
    for dim, n in entries.groupBy("dim").count().collect():  # one row for each length of vector
        k = math.ceil(CELLS * math.sqrt(n))
        share = min(1.0, 1.1 * max(fit_vectors, FIT_PER_CELL * k) / n + 1000 / n)  # by hashes, which are even
        order = F.pmod(F.xxhash64("vec_id"), F.lit(2**40)).alias("order")
        sample = entries.where(F.col("dim") == dim).select("unit", order).where(F.col("order") < share * 2**40)
        fitted[dim] = fit_centroids(stored(sample), dim, k)
    cells = stored(_cells(entries, fitted, threshold))
    home = F.col("own") == F.col("cell")
    sizes = cells.groupBy("dim", "cell").agg(F.ceil(F.count_if(home) / BLOCK).alias("lefts"), F.ceil(F.count("*") / (4 * BLOCK)).alias("rights"))
    known = cells.join(stored(sizes), ["dim", "cell"])
    pick = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    lefts = known.where(home).select(
        "*", F.lit(True).alias("left"), pick(F.col("lefts")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights").cast("int") - 1)).alias("j")
    )
    rights = known.where("lefts > 0").select(
        "*", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("lefts").cast("int") - 1)).alias("i"), pick(F.col("rights")).alias("j")
    )
    dealt = lefts.unionByName(rights).drop("lefts", "rights")
    found = stored(
        dealt.groupBy("dim", "cell", "i", "j").applyInArrow(_compare(threshold), "vec_id long, links long, root long")
    )
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    entries = stored(
        entries.join(links, "vec_id", "left")
        .join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("unit", "dim", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    )
    rows = stored(usable.join(entries, ["unit", "dim"]).select("vec_id", "n_links", "component_id"))
    rows = rows.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    component = F.coalesce("component_id", "vec_id")
    return ids.join(rows, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
