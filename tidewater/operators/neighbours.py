"""Exact k nearest neighbours of every query, without comparing all with all.

Sampled pivots cut the labelled rows into Voronoi cells. What is known of a cell (its size, its least and largest distance to the pivot, its
k least ones) bounds each query's k-th distance from above, and by the triangle inequality and the planes halfway between
pivots its distance to a cell's rows from below. A query goes only to the cells that can hold one of its k nearest. Cells are worked
on in blocks of bounded size, so neither a crowded cell nor its queries meet in one task. Of equal vectors only
the k rows that ties prefer are kept, and every task drops the others before rows are exchanged.

Only the pivots and the cells' bounds, at most PIVOTS * (dimensions + k + 3) numbers, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.lineage import cut

#: Pivots at most; of fewer than the square of that many rows their square root.
PIVOTS = 1024
#: Labelled rows of a block, about.
BLOCK = 4096
#: Pairs of a query and a row that are compared at once.
PAIRS = 1 << 20


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the rows of each length."""
    sizes = np.asarray(column.value_lengths())
    flat, ends = np.asarray(column.flatten(), float), np.cumsum(sizes)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a and those of b, row by row of b, so that memory follows len(a) * dimensions."""
    return np.stack([np.sqrt(((a - row) ** 2).sum(1)) for row in b], 1) if len(b) else np.zeros((len(a), 0))


@dataclass
class Cells:
    """Pivots by vector length, the number of their first cell, and each cell's bounds. Rows of a length without a pivot are a cell
    of its own, -length, of which nothing is known."""

    pivots: dict[int, np.ndarray]
    first: dict[int, int]
    bounds: dict[int, tuple[int, float, float, list[float]]]

    def nearest(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Cell, distance to its pivot, and distances to all pivots of the length."""
        n = matrix.shape[1]
        if n not in self.pivots:
            return np.full(len(matrix), -n), np.zeros(len(matrix)), None
        far = _apart(matrix, self.pivots[n])
        at = far.argmin(1)
        return self.first[n] + at, far[np.arange(len(matrix)), at], far

    def visits(self, matrix: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """Row of matrix, cell and the bound of the row's k-th distance, of each cell that the row has to visit."""
        n = matrix.shape[1]
        _, own, far = self.nearest(matrix)
        if far is None:
            if -n in self.bounds:
                yield from ((i, -n, float("inf")) for i in range(len(matrix)))
            return
        cells = [self.bounds.get(self.first[n] + j) for j in range(far.shape[1])]
        between = _apart(self.pivots[n], self.pivots[n])
        low = np.array([c[1] if c else np.inf for c in cells])
        high = np.array([c[2] if c else -np.inf for c in cells])
        least = np.array([(c[3] + [np.inf] * k)[:k] if c else [np.inf] * k for c in cells])
        for i, d in enumerate(far):
            at = int(d.argmin())
            best = np.partition((d[:, None] + least).ravel(), k - 1)[k - 1]
            # what rounding may have taken away
            best += 1e-9 * (1 + best)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between[at] > 0, (d**2 - own[i] ** 2) / (2 * between[at]), 0.0)
            for j in np.flatnonzero((d - best <= high) & (d + best >= low) & (plane <= best)):
                yield i, self.first[n] + int(j), float(best)


def cells_of(labelled: DataFrame, k: int, most: int = PIVOTS) -> tuple[Cells, DataFrame]:
    """Cells of labelled(s, label, sv), and its rows with their cell and distance to the pivot, as a table."""
    n = labelled.count()
    sample = labelled.orderBy(F.xxhash64("s"), "s").limit(max(1, min(most, int(n**0.5)))).select("sv").collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r["sv"]), []).append(r["sv"])
    pivots = {size: np.unique(np.array(v, float), axis=0) for size, v in sorted(by.items())}
    starts = np.cumsum([0, *map(len, pivots.values())]).tolist()
    cells = Cells(pivots, dict(zip(pivots, starts, strict=False)), {})
    schema = to_arrow_schema(labelled.select("s", "label", "sv", F.lit(0).alias("cell"), F.lit(0.0).alias("far")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for rows, matrix in _vectors(batch.column(2)):
                cell[rows], far[rows], _ = cells.nearest(matrix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], schema=schema)

    types = dict(labelled.dtypes)
    rows = cut(labelled.select("s", "label", "sv").mapInArrow(run, f"s {types['s']}, label {types['label']}, sv {types['sv']}, cell int, far double"))
    first = rows.select("cell", "far", F.row_number().over(Window.partitionBy("cell").orderBy("far")).alias("p")).where(F.col("p") <= k)
    nearest = first.groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("least"))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    cells.bounds.update({r["cell"]: (r["n"], r["low"], r["high"], r["least"]) for r in sizes.join(nearest, "cell").collect()})
    return cells, rows


def visits(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """q, qv, cell, bound of queries(q, qv), for each cell that may hold one of the query's k nearest."""
    types = dict(queries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _vectors(batch.column(1)):
                # a query goes to many cells: some at a time
                for a in range(0, len(rows), 256):
                    to = list(cells.visits(matrix[a : a + 256], k))
                    at = pa.array(rows[a : a + 256][[i for i, _, _ in to]] if to else [], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([c for _, c, _ in to], pa.int32()), pa.array([b for *_, b in to], pa.float64())], names=["q", "qv", "cell", "bound"])

    return queries.select("q", "qv").mapInArrow(run, f"q {types['q']}, qv {types['qv']}, cell int, bound double")


def closest(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and distance of each query's k nearest rows, of equal distances the first. Products find which rows can be among
    them, distances decide."""
    squares, own = (queries**2).sum(1), (rows**2).sum(1)
    about = squares[:, None] + own[None] - 2 * (queries @ rows.T)
    k = min(k, len(rows))
    limit = np.partition(about, k - 1, axis=1)[:, k - 1] + 1e-9 * (squares + own.max() + 1e-300)
    q, s = np.nonzero(about <= limit[:, None])
    far = np.sqrt(((queries[q] - rows[s]) ** 2).sum(1))
    order = np.lexsort((s, far, q))
    q, s, far = q[order], s[order], far[order]
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    place = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
    return q[place < k], s[place < k], far[place < k]


def k_nearest(queries: DataFrame, labelled: DataFrame, k: int, q_id: str, s_id: str, vector: str, label: str, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """q, s, label, distance, place (from 1) of the k labelled rows nearest to each query, of equal distances the smallest s. Rows and queries without a
    vector, or with one that isn't finite, are left out, and only vectors of the same length have a distance."""
    q = queries.where(_finite(F.col(vector))).select(F.col(q_id).alias("q"), F.col(vector).cast("array<double>").alias("qv"))
    s = labelled.where(_finite(F.col(vector))).select(F.col(s_id).alias("s"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("sv"))
    # only k rows of equal vectors can be among a query's nearest
    s = s.withColumn("p", F.row_number().over(Window.partitionBy("sv").orderBy("s"))).where(F.col("p") <= k).drop("p")
    cells, rows = cells_of(s, k, pivots)
    spark = queries.sparkSession
    blocks = spark.createDataFrame([(c, -(-b[0] // block)) for c, b in cells.bounds.items()], "cell int, blocks int")
    blocks = F.broadcast(blocks)  # a row for each cell
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    held = rows.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "s", "label", none("q", q), F.lit(None).cast("double").alias("bound"), F.col("sv").alias("v"))
    went = visits(q, cells, k).join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), none("s", s), none("label", s), "q", "bound", F.col("qv").alias("v"))
    dealt = held.union(went).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind", "s")
    schema = to_arrow_schema(dealt.select("q", "s", "label", "bound").withColumnRenamed("bound", "distance").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, labels, parts, matrix = None, [], [], [], None
        for batch in batches:
            cell, blk, kind = (np.asarray(batch.column(i)) for i in range(3))
            new = np.flatnonzero(np.diff(cell) | np.diff(blk) | np.diff(kind)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(batch)], strict=True):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if (cell[a], blk[a]) != at:
                    at, ids, labels, parts, matrix = (cell[a], blk[a]), [], [], [], None
                ((_, v),) = _vectors(own.column(7))
                if kind[a] == 0:
                    ids += own.column(3).to_pylist()
                    labels += own.column(4).to_pylist()
                    parts.append(v)
                    continue
                if not parts:
                    continue
                matrix = np.concatenate(parts) if matrix is None else matrix
                step = max(1, PAIRS // len(matrix))
                for c in range(0, len(v), step):
                    i, j, far = closest(v[c : c + step], matrix, k)
                    near = far <= np.asarray(own.column(6))[c : c + step][i]
                    i, j, far = i[near], j[near], far[near]
                    yield pa.RecordBatch.from_arrays([own.column(5).take(pa.array(i + c)), pa.array([ids[x] for x in j], schema[1].type), pa.array([labels[x] for x in j], schema[2].type), pa.array(far)], schema=schema)

    types = {**dict(s.dtypes), **dict(q.dtypes)}
    found = dealt.mapInArrow(run, f"q {types['q']}, s {types['s']}, label {types['label']}, distance double")
    best = Window.partitionBy("q").orderBy("distance", "s")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def compared_pairs(queries: DataFrame, labelled: DataFrame, k: int, q_id: str, s_id: str, vector: str, label: str, pivots: int = PIVOTS) -> DataFrame:
    """compared (pairs of a query and a row that k_nearest() compares) and all_pairs."""
    q = queries.where(_finite(F.col(vector))).select(F.col(q_id).alias("q"), F.col(vector).cast("array<double>").alias("qv"))
    s = labelled.where(_finite(F.col(vector))).select(F.col(s_id).alias("s"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("sv"))
    cells, rows = cells_of(s, k, pivots)
    sizes = q.sparkSession.createDataFrame([(c, b[0]) for c, b in cells.bounds.items()], "cell int, n bigint")
    total = q.agg(F.count("*").alias("m")).join(rows.agg(F.count("*").alias("n")), F.lit(True)).select((F.col("m") * F.col("n")).alias("all_pairs"))
    return visits(q, cells, k).join(F.broadcast(sizes), "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared")).join(total, F.lit(True))
