"""k nearest neighbours and k-means.

Neighbours: a training set of up to BROADCAST_BYTES is sent to the tasks and queries stream past it, without a shuffle. A larger
one meets its queries in the cells of pivots that can hold a neighbour, by the triangle inequality; neither side passes the driver.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..frame import dimension, positive
from ..ranges import shared
from ..stats import majority

BROADCAST_BYTES = 64 << 20
#: Pivots of two large sides, and the rows and queries that one task compares at once.
PIVOTS, CELL_ROWS, CELL_QUERIES = 256, 20_000, 4096
#: A pivot for so many rows, but FEWEST at least: a query is sent to each cell that it meets, so cells aren't made smaller than they need be.
PIVOT_ROWS, FEWEST = 4096, 8
#: Rows whose distances to a query are computed directly at once.
PIECE = 8192
#: Queries and rows of a tile at most, and those that are worth a tile of their own where cores are idle.
TILE_ROWS, TILE_LEAST = 80_000, 4096


def _nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places and distances of its k nearest rows, ties by id.

    Candidates come from a matrix product: all rows up to the k-th rough distance plus a bound of both roundings, so that no tie
    is lost. They are ranked by distances computed directly.
    """
    k = min(k, len(rows))
    squares = (rows * rows).sum(1)
    rough = squares - 2 * queries @ rows.T
    reach = (np.sqrt((queries * queries).sum(1)) + np.sqrt(squares.max())) ** 2
    most = np.partition(rough, k - 1, axis=1)[:, k - 1] + 16 * (rows.shape[1] + 4) * np.finfo(float).eps * reach
    place, far = np.empty((len(queries), k), np.int64), np.empty((len(queries), k))
    for q, query in enumerate(queries):
        pick = np.flatnonzero(~(rough[q] > most[q]))  # what isn't comparable stays
        true = np.concatenate([np.sqrt(((rows[pick[at : at + PIECE]] - query) ** 2).sum(1)) for at in range(0, len(pick), PIECE)])
        kept = np.flatnonzero(~(true > np.partition(true, k - 1)[k - 1]))
        order = kept[np.lexsort((ids[pick[kept]], true[kept]))[:k]]
        place[q], far[q] = pick[order], true[order]
    return place, far


def _nearest_within(queries: np.ndarray, bound: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of up to k nearest rows within each query's bound, ties by id: (query's place, row's place, distance) by query, then rank.

    As `_nearest`, but rows pass in pieces, and the bound shrinks to the k-th distance met so far.
    """
    squares, out = (rows * rows).sum(1), []
    longest = np.sqrt(squares.max())
    for at in range(0, len(queries), 512):
        q, least = queries[at : at + 512], bound[at : at + 512] * (1 + 1e-12)
        own = (q * q).sum(1)
        slack = 16 * (rows.shape[1] + 4) * np.finfo(float).eps * (np.sqrt(own) + longest) ** 2
        of, place, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for start in range(0, len(rows), 4096):
            piece = rows[start : start + 4096]
            rough = q @ piece.T
            rough *= -2.0
            rough += squares[start : start + 4096]
            hit, near = np.nonzero(~(rough > (least * least - own + slack)[:, None]))  # what isn't comparable stays
            if not len(hit):
                continue
            true = np.concatenate([np.sqrt(((piece[near[i : i + PIECE]] - q[hit[i : i + PIECE]]) ** 2).sum(1)) for i in range(0, len(hit), PIECE)])
            kept = ~(true > least[hit])
            of, place, far = np.concatenate([of, hit[kept]]), np.concatenate([place, near[kept] + start]), np.concatenate([far, true[kept]])
            order = np.lexsort((ids[place], far, of))
            of, place, far = of[order], place[order], far[order]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            of, place, far, rank = (v[rank < k] for v in (of, place, far, rank))
            last = rank == k - 1
            least[of[last]] = np.fmin(least[of[last]], far[last])
        out.append((of + at, place, far))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def tiling(queries: int, rows: int, visits: int, cores: int) -> tuple[int, int] | None:
    """Into how many groups queries and rows are cut to meet tile by tile, or None where sending queries to `visits` cells moves no more rows.

    A query goes to each group of rows and a row to each group of queries: the square root of the tiles' number, not the number of cells.
    """
    side = 1 + int((2 * cores) ** 0.5)
    across, down = (max(-(-n // TILE_ROWS), min(side, -(-n // TILE_LEAST)), 1) for n in (queries, rows))
    return None if visits <= queries * down + rows * across else (across, down)


def nearest(test: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(query, neighbor, rank from 1, distance, y) of the k nearest training rows (row_id, x, y) of each test row, by Euclidean distance."""
    positive(k=k)
    d, n = dimension(train), train.count()
    context = test.sparkSession.sparkContext
    schema = "query long, neighbor long, rank int, distance double, y double"

    def ranked(q, ids, rows, numbers, y):
        place, far = _nearest(q, rows, numbers, k)
        w = place.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, w)), pa.array(numbers[place].ravel()), pa.array(np.tile(np.arange(1, w + 1, dtype=np.int32), len(ids))), pa.array(far.ravel()), pa.array(y[place].ravel())], ["query", "neighbor", "rank", "distance", "y"])

    if n * (d + 2) * 8 <= BROADCAST_BYTES:
        table = train.select("row_id", "x", F.col("y").cast("double")).toArrow().combine_chunks()
        known = context.broadcast((table.column("x").combine_chunks().flatten().to_numpy().astype(float).reshape(n, d), table.column("row_id").to_numpy(), table.column("y").to_numpy()))

        def past(batches):
            rows, numbers, y = known.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield ranked(_matrix(part), part.column("row_id").to_numpy(), rows, numbers, y)

        return test.select("row_id", "x").mapInArrow(past, schema)
    return nearest_by_pivots(test, train, k, PIVOTS, CELL_ROWS, CELL_QUERIES)


def nearest_by_pivots(test: DataFrame, train: DataFrame, k: int, pivots: int = PIVOTS, rows: int = CELL_ROWS, asked: int = CELL_QUERIES) -> DataFrame:
    """The same as `nearest` for two sides of any size: nothing but at most `pivots` rows and their cells' sizes and radii passes the driver.

    Training rows go to the cell of their nearest pivot. A query first meets the nearest cells that hold k rows together; its k-th distance there
    bounds the true one, and by the triangle inequality it then meets the other cells that can hold a row as near: cells whose pivot is no
    farther than their radius and the bound. Cells of more than `rows` rows are cut into parts, queries of a part into groups of `asked`, so that
    copies of one vector are spread over tasks. Every row within the k-th distance is met: results are exact, ties by id. Where data without clusters
    would send queries to most cells, groups of queries meet groups of rows instead (`tiling`), within the same bounds.
    """
    positive(k=k)
    d = dimension(train)
    context = test.sparkSession.sparkContext
    base = train.select(F.col("row_id").alias("id"), "x", F.col("y").cast("double").alias("y"))
    size = base.count()
    chosen = base.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(max(1, min(pivots, max(FEWEST, -(-size // PIVOT_ROWS))))).collect()
    centres = context.broadcast(np.array([r["x"] for r in chosen], float).reshape(len(chosen), d))

    def far(x: np.ndarray) -> np.ndarray:
        c = centres.value
        return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]))

    def celled(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                f = far(_matrix(part))
                cell = f.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(f[np.arange(len(cell)), cell])], ["id", "x", "y", "cell", "far"])

    cells = base.mapInArrow(celled, StructType([*base.schema.fields, *StructType.fromDDL("cell int, far double").fields]))
    stats = {r["cell"]: (r["n"], r["far"]) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    held = np.array([stats.get(c, (0, 0.0))[0] for c in range(len(chosen))], np.int64)
    radius = np.array([stats.get(c, (0, 0.0))[1] for c in range(len(chosen))])
    parts = np.maximum(1, -(-held // rows))
    shape = context.broadcast((held, radius, parts))
    dealt = cells.select("id", "x", "y", "cell", F.pmod(F.xxhash64("id"), F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("cell") + 1)).cast("int").alias("part"))

    def reached(part: pa.RecordBatch, first: bool) -> np.ndarray:
        held, radius, _ = shape.value
        x = _matrix(part)
        f = far(x)
        order = np.argsort(np.where(held > 0, f, np.inf), axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        near = np.zeros(f.shape, bool)
        np.put_along_axis(near, order, before < k, axis=1)
        near &= held > 0
        if first:
            return near
        bound = part.column("bound").to_numpy(zero_copy_only=False)
        slack = 1e-6 * (1 + np.sqrt((x * x).sum(1)) + np.sqrt((centres.value**2).sum(1).max()))  # squares are rounded
        return ~near & (held > 0) & (f - radius[None] <= (bound + slack)[:, None])

    def visits(first: bool):
        def run(batches):
            parts = shape.value[2]
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    q, cell = np.nonzero(reached(part, first))
                    times = parts[cell]
                    q, cell = np.repeat(q, times), np.repeat(cell, times)
                    nth = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                    yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(q)), part.column("x").take(pa.array(q)), pa.array(cell.astype(np.int32)), pa.array(nth.astype(np.int32))], ["query", "x", "cell", "part"])

        return run

    def counted(batches):
        for batch in batches:
            n = sum(int((reached(batch.slice(at, 256), False) * shape.value[2]).sum()) for at in range(0, batch.num_rows, 256))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([n])], ["queries", "visits"])

    queries = test.select(F.col("row_id").alias("query"), "x")
    met = StructType([*queries.schema.fields, *StructType.fromDDL("cell int, part int").fields])
    schema = "query long, neighbor long, rank int, distance double, y double"

    def nothing() -> pa.Table:
        return pa.table({"query": pa.array([], pa.int64()), "neighbor": pa.array([], pa.int64()), "rank": pa.array([], pa.int32()), "distance": pa.array([], pa.float64()), "y": pa.array([], pa.float64())})

    def within(key, asked_: pa.Table, own: pa.Table) -> pa.Table:
        if not asked_.num_rows or not own.num_rows:
            return nothing()
        numbers = own.column("id").to_numpy()
        q, place, distance = _nearest_within(_matrix(asked_, "asked"), asked_.column("bound").to_numpy(), _matrix(own), numbers, k)
        return pa.table({"query": asked_.column("query").to_numpy()[q], "neighbor": numbers[place], "rank": np.zeros(len(q), np.int32), "distance": distance, "y": own.column("y").to_numpy()[place]})

    def best(key, asked_: pa.Table, own: pa.Table) -> pa.Table:
        if not asked_.num_rows or not own.num_rows:
            return nothing()
        ids, numbers, x, y = asked_.column("query").to_numpy(), own.column("id").to_numpy(), _matrix(own), own.column("y").to_numpy()
        q, out = _matrix(asked_), []
        for at in range(0, len(q), 256):
            place, distance = _nearest(q[at : at + 256], x, numbers, k)
            w = place.shape[1]
            out.append(pa.table({"query": np.repeat(ids[at : at + 256], w), "neighbor": numbers[place].ravel(), "rank": np.tile(np.arange(1, w + 1, dtype=np.int32), len(place)), "distance": distance.ravel(), "y": y[place].ravel()}))
        return pa.concat_tables(out)

    def met_in(frame: DataFrame) -> DataFrame:
        """The k best of each query in each part that it meets; a part's queries in groups, with a copy of the part's rows for each."""
        groups = frame.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("groups"))
        dealt_ = frame.join(groups, ["cell", "part"]).withColumn("group", F.pmod(F.xxhash64("query"), "groups").cast("int")).select("query", "x", "cell", "part", "group")
        copies = dealt.join(groups, ["cell", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("id", "x", "y", "cell", "part", "group")
        return dealt_.groupBy("cell", "part", "group").cogroup(copies.groupBy("cell", "part", "group")).applyInArrow(best, schema)

    ranks = F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbor")).cast("int")
    top = lambda df: df.withColumn("rank", ranks).filter(F.col("rank") <= k)
    first = shared(top(met_in(queries.mapInArrow(visits(True), met))))
    bounds = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound"))
    again = shared(queries.join(bounds, "query").select("query", "x", "bound"))
    n, met_n = again.mapInArrow(counted, "queries long, visits long").agg(F.sum("queries"), F.sum("visits")).first()
    cut = tiling(n or 0, size, met_n or 0, context.defaultParallelism)
    if cut is None:
        return top(first.unionByName(met_in(again.mapInArrow(visits(False), met))))
    across, down = cut
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asking = again.withColumn("g", F.pmod(F.xxhash64("query"), F.lit(across))).withColumn("s", every(down)).withColumn("tile", (F.col("g") * down + F.col("s")).cast("int"))
    owned = base.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(down))).withColumn("g", every(across)).withColumn("tile", (F.col("g") * down + F.col("s")).cast("int"))
    # all rows are met here, so what the nearest cells held comes once more: only its bounds count
    return top(asking.select("tile", "query", F.col("x").alias("asked"), "bound").groupBy("tile").cogroup(owned.select("tile", "id", "x", "y").groupBy("tile")).applyInArrow(within, schema))


def _matrix(batch, x: str = "x") -> np.ndarray:
    column = batch.column(x)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)


def knn_predict(test: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(query, y): the majority of the k nearest labels, the smallest label of a tie. k beyond the training rows counts them all."""
    return majority(nearest(test, train, k), ["query"], "y")


def assign(df: DataFrame, centroids: np.ndarray, x: str = "x") -> DataFrame:
    """Adds `cluster`: the nearest centroid, the first of equals. Centroids are k x d literals in one expression for each."""
    far = [sum(((F.col(x)[j] - F.lit(float(v))) * (F.col(x)[j] - F.lit(float(v))) for j, v in enumerate(c)), F.lit(0.0)) for c in centroids]
    nearest_ = F.least(*far) if len(far) > 1 else far[0]
    choice = F.lit(len(far) - 1)
    for i in reversed(range(len(far) - 1)):
        choice = F.when(far[i] == nearest_, F.lit(i)).otherwise(choice)
    return df.withColumn("cluster", choice.cast("int"))


def column_exponents(df: DataFrame, d: int, x: str = "x") -> list[int] | None:
    """For each column the exponent of a power of two above its absolute values; None where one isn't a finite number, or too great or small to be scaled."""
    most = df.agg(*[F.max(F.abs(F.col(x)[j])) for j in range(d)]).first()
    finite = all(v is not None and np.isfinite(v) for v in most)
    exponents = [int(np.frexp(v)[1]) for v in most] if finite else []
    return exponents if finite and all(abs(e) < 1000 for e in exponents) else None


def cluster_means(assigned: DataFrame, k: int, d: int, x: str = "x", exponents: list[int] | None = None) -> dict[int, np.ndarray]:
    """Means by cluster. With the columns' exponents, values are summed as integers of 60 bits in two halves, so that sums don't depend on the order of rows:
    clusters of equal rows have equal means.
    """
    if exponents is None:
        means = assigned.groupBy("cluster").agg(*[F.avg(F.col(x)[j]).alias(f"m{j}") for j in range(d)]).collect()
        return {r["cluster"]: np.array([r[f"m{j}"] for j in range(d)]) for r in means}
    scaled = [F.col(x)[j] * F.lit(2.0**-e) * F.lit(2.0**30) for j, e in enumerate(exponents)]
    high = [F.floor(v) for v in scaled]
    low = [F.round((v - h) * F.lit(2.0**30)).cast("long") for v, h in zip(scaled, high, strict=True)]
    halves = assigned.select("cluster", *[h.alias(f"h{j}") for j, h in enumerate(high)], *[v.alias(f"l{j}") for j, v in enumerate(low)])
    sums = halves.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"{c}{j}").alias(f"{c}{j}") for c in "hl" for j in range(d)]).collect()
    return {r["cluster"]: np.array([float(Fraction((r[f"h{j}"] << 30) + r[f"l{j}"], r["n"]) * Fraction(2) ** (e - 60)) for j, e in enumerate(exponents)]) for r in sums}


def kmeans(df: DataFrame, k: int, max_iter: int = 100, tolerance: float = 1e-10, seed: int = 0, row: str = "row_id", refill: bool = True) -> tuple[DataFrame, np.ndarray]:
    """(df with `cluster`, centroids). Rows start in cluster (row number mod k); centroids and assignments alternate until neither
    changes. A cluster that empties takes a random row; without `refill` it stays empty, with a centroid of infinities. `row` numbers the rows from 0.
    """
    positive(k=k, max_iter=max_iter)
    d = dimension(df)
    base = df.persist()
    assigned = base.withColumn("cluster", F.pmod(F.col(row), F.lit(k)).cast("int"))
    centroids, exponents = np.zeros((k, d)), column_exponents(base, d)
    for it in range(max_iter):
        means = cluster_means(assigned, k, d, exponents=exponents)
        new = np.full((k, d), np.inf)
        for c in range(k):
            if c in means or refill:
                new[c] = means[c] if c in means else np.array(base.orderBy(F.xxhash64(row, F.lit(seed + 31 * it + c))).first()["x"], float)
        still = it > 0 and bool(np.isclose(new, centroids, rtol=0.0, atol=tolerance).all())
        centroids = new
        assigned = assign(base, centroids)
        if still:
            break
    base.unpersist()
    return assigned, centroids
