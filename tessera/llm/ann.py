"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few random directions, shifted and laid along several Hilbert curves. Spark range-partitions
the curves, which gives each vector a rank on each of them. A window holds the ranks around a query; the windows of all
curves merge and are reranked. How wide windows are is measured: the true neighbours of some sampled queries show how far
apart neighbours lie on the nearest of their curves.

What windows miss is then added: stretches of the first curve carry a centre and a radius, and a query goes to each
stretch that may still hold a nearer vector by the triangle inequality, and to no other. The result is exact in any data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import binary_matrix, clean_vectors, stash

CURVES, AXES, BITS = 6, 7, 9
#: Queries whose neighbours are searched by brute force to set the windows' width, and the share of these neighbours that
#: windows hold. The sample is bounded; windows are the same for all queries.
SAMPLED, RECALL = 64, 0.95
#: Ranks of a cell, in which rows and queries meet, at the most and at the least.
CELL, LEAST_CELL = 4096, 64
#: Vectors of a stretch of the first curve, or more where centres and radii of all stretches would pass so many bytes.
STRETCH, STRETCH_BYTES = 512, 8 << 20
#: Queries that are compared with a cell at once.
TOGETHER = 256
_FOUND = "query_id long, vec_id long, score double"
_MEETS = "cell long, kind int, id long, vec binary, reach double"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of (n, axes) cells with coordinates below 2**bits; axes * bits is 63 at most."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the curve's cells, from the largest to the smallest
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def directions(dim: int, seed: int = 42) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.normal(size=(dim, AXES)))[0] if dim >= AXES else rng.normal(size=(dim, AXES)) for _ in range(CURVES)]


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to rows in double precision, summed in the order of the components; scaled where
    squares pass the range of doubles."""
    d = query.astype(np.float64) - rows.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.sqrt(np.add.accumulate(d * d, axis=1)[:, -1])
        for i in np.flatnonzero(~np.isfinite(total)):
            half = query.astype(np.float64) / 2 - rows[i].astype(np.float64) / 2
            most = np.abs(half).max()
            total[i] = most * np.sqrt(np.add.accumulate((half / most) ** 2)[-1]) * 2
    return total


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest distances, of each id the nearest, nearest first, ties to smaller ids."""
    order = np.lexsort((ids, dist))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def rerank(q: np.ndarray, qid: np.ndarray, reach: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[list, list, list]:
    """For each query its k nearest of the rows x within its reach, as lists of arrays: query ids, ids, distances.

    Squared distances by a matrix product choose rows, with what rounding may have taken from them; the chosen ones are
    measured. Rows with a query's own id don't count.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
        slack = 1e-12 * q.shape[1] * (qq + xx.max())
        near = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
        limit = reach * reach * (1 + 1e-9)
    query, other, dist = [], [], []
    plain = np.isfinite(near).all(axis=1) & (len(np.unique(xid)) == len(xid))
    for i in range(len(q)):
        ok = xid != qid[i]
        if plain[i]:
            row = np.where(ok, near[i], np.inf)
            most = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            ok &= row <= min(most, limit[i]) + 2 * slack[i]
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        d = distances(q[i], x[at])
        inside = d <= reach[i]
        at, d = at[inside], d[inside]
        pick = _best(d, xid[at], k)
        query.append(np.full(len(pick), qid[i]))
        other.append(xid[at[pick]])
        dist.append(d[pick])
    return query, other, dist


def _table(query: list, other: list, dist: list) -> pa.RecordBatch:
    cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
    return pa.RecordBatch.from_arrays([cat(query, pa.int64()), cat(other, pa.int64()), cat(dist, pa.float64())], ["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    least = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return least.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _meet(dim: int, kind: str, k: int):
    """Rows of a cell (kind 0) come before the queries that ask there (kind 1): a task holds one cell and some queries."""

    def run(batches):
        now, ids, vecs, held = None, [], [], None
        for b in batches:
            cell, side, own, reach = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            v = binary_matrix(b.column(3), kind, dim)
            edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (side[1:] != side[:-1]), [True]])) if len(cell) else []
            for a, e in zip(edges[:-1], edges[1:]):
                if side[a] == 0:
                    if cell[a] != now:
                        now, ids, vecs = cell[a], [], []
                    ids.append(own[a:e])
                    vecs.append(v[a:e])
                    held = None
                elif cell[a] == now:
                    held = held or (np.concatenate(vecs).astype(np.float64), np.concatenate(ids))
                    for s in range(a, e, TOGETHER):
                        t = min(e, s + TOGETHER)
                        yield _table(*rerank(v[s:t].astype(np.float64), own[s:t], reach[s:t], *held, k))

    return run


def _met(rows: DataFrame, asked: DataFrame, dim: int, kind: str, k: int) -> DataFrame:
    """Candidates (query_id, vec_id, score) of rows (cell, vec_id, vec) and queries (cell, query_id, vec, reach)."""
    both = rows.select("cell", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "vec", F.lit(0.0).alias("reach")).unionByName(asked.select("cell", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vec", "reach"))
    return both.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_meet(dim, kind, k), _FOUND)


def _true_neighbours(vectors: DataFrame, sample: list, dim: int, kind: str, k: int) -> list:
    """(query_id, vec_id) of the sampled queries' k nearest, by brute force: a task hands on k rows for each of them."""
    asked = np.stack([np.frombuffer(r["vec"], kind) for r in sample]).astype(np.float64)
    ids, far = np.array([r["vec_id"] for r in sample]), np.full(len(sample), np.inf)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield _table(*rerank(asked, ids, far, binary_matrix(b.column(1), kind, dim).astype(np.float64), b.column(0).to_numpy(), k))

    return _top(vectors.mapInArrow(run, _FOUND), k).select("query_id", "vec_id").collect()


def _window(ranked: DataFrame, truth: list) -> int:
    """The distance in rank that the share RECALL of the pairs of neighbours keep, each on the curve where it is least."""
    wanted = sorted({x for r in truth for x in r})
    places = {(r["vec_id"], r["curve"]): r["rank"] for r in ranked.where(F.col("vec_id").isin(wanted)).groupBy("vec_id", "curve").agg(F.min("rank").alias("rank")).collect()}
    away = [min(abs(places[a, c] - places[b, c]) for c in range(CURVES)) for a, b in truth]
    return int(np.ceil(np.quantile(away, RECALL))) if away else LEAST_CELL


def nearest(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42, widen: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every`, its k nearest other vectors by Euclidean
    distance, nearest first, ties to smaller ids; all candidates if there are fewer. Without `widen`, what the windows
    alone find.

    Rows with a null id or a vector that can't take part (see clean_vectors) are neither queries nor candidates. Of rows
    that repeat an id with other vectors, the nearest counts; of a repeated query, the one with the smallest vector
    bytes asks. Empty tables give empty results. Columns besides the two are ignored.
    """
    spark = df.sparkSession
    vectors, dim, kind = clean_vectors(df, id_col, vec_col)
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return nothing
    vectors = stash(vectors.where("vec_id is not null").distinct(), "vectors")
    ask = stash(vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vec").alias("vec")), "asked")
    sample = ask.orderBy(F.xxhash64(F.lit("curves"), "vec_id"), "vec_id").limit(SAMPLED).collect()
    if not sample:
        return nothing
    ranked, rows = _lay(vectors, ask, dim, kind, seed)
    width = _window(ranked, _true_neighbours(vectors, sample, dim, kind, k))
    size = max(LEAST_CELL, min(CELL, width))
    cell = lambda rank: F.col("curve").cast("long") * (1 << 48) + F.floor(rank / size)
    span = F.sequence(F.floor(F.greatest(F.col("rank") - width, F.lit(0)) / size), F.floor((F.col("rank") + width) / size))
    asked = ranked.where("asks").select(F.explode(F.transform(span, lambda x: F.col("curve").cast("long") * (1 << 48) + x)).alias("cell"), F.col("vec_id").alias("query_id"), "vec", F.lit(float("inf")).alias("reach"))
    near = _top(_met(ranked.withColumn("cell", cell(F.col("rank"))), asked, dim, kind, k), k)
    if widen:
        near = stash(near, "near")
        near = _top(near.drop("rank").unionByName(_widened(ranked.where("curve = 0"), rows, ask, near, dim, kind, k)), k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _lay(vectors: DataFrame, ask: DataFrame, dim: int, kind: str, seed: int) -> tuple[DataFrame, int]:
    """(curve, rank, vec_id, vec, asks) of every vector on every curve, and the number of vectors. Ranks come from the
    place in a partition and the sizes of those before: no task walks a curve."""
    spark = vectors.sparkSession
    turn = spark.sparkContext.broadcast(directions(dim, seed))
    low, high = _bounds(vectors, dim, kind, turn)
    shifts = np.random.default_rng(seed + 1).random((CURVES, AXES)) * 0.5
    asked = ask.select(F.col("vec_id").alias("_id"), F.col("vec").alias("_vec"))
    marked = vectors.join(asked, (vectors["vec_id"] == asked["_id"]) & (vectors["vec"] == asked["_vec"]), "left").select("vec_id", "vec", F.col("_id").isNotNull().alias("asks"))

    def keys(batches):
        for b in batches:
            v = _tame(binary_matrix(b.column(1), kind, dim))
            for c, p in enumerate(turn.value):
                at = (v @ p - low[c]) / np.maximum(high[c] - low[c], 1e-300)
                cells = np.clip((at + shifts[c]) / 1.5 * (1 << BITS), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(hilbert(cells)), *b.columns], ["curve", "key", "vec_id", "vec", "asks"])

    def number(batches):
        part, counts = TaskContext.get().partitionId(), np.zeros(CURVES, np.int64)
        for b in batches:
            curve = b.column(0).to_numpy()  # sorted
            first = np.searchsorted(curve, curve, "left")
            place = counts[curve] + np.arange(len(curve)) - first
            counts += np.bincount(curve, minlength=CURVES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(curve), part, np.int32)), pa.array(place), *(b.column(i) for i in (2, 3, 4))], ["curve", "part", "place", "vec_id", "vec", "asks"])

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    line = marked.mapInArrow(keys, "curve int, key long, vec_id long, vec binary, asks boolean")
    # The id splits keys that many vectors share.
    line = line.repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    laid = stash(line.mapInArrow(number, "curve int, part int, place long, vec_id long, vec binary, asks boolean"), "laid")
    sizes = laid.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n"))
    before = stash(before, "sizes")
    rows = before.where("curve = 0").agg(F.sum("n")).first()[0]
    return laid.join(before.drop("n"), ["curve", "part"]).select("curve", (F.col("base") + F.col("place")).alias("rank"), "vec_id", "vec", "asks"), rows


def _widened(line: DataFrame, rows: int, ask: DataFrame, near: DataFrame, dim: int, kind: str, k: int) -> DataFrame:
    """Candidates out of every stretch of the first curve that may hold one nearer than the k that a query has."""
    size = max(STRETCH, -(-rows // max(64, STRETCH_BYTES // (8 * dim + 16))))
    line = line.select(F.floor(F.col("rank") / size).alias("cell"), "vec_id", "vec")

    def ball(table: pa.Table) -> pa.Table:
        v = _tame(binary_matrix(table["vec"], kind, dim))
        centre = v.mean(axis=0)
        return pa.table({"cell": table["cell"][:1], "centre": pa.array([centre.tobytes()], pa.binary()), "radius": [float(np.sqrt(((v - centre) ** 2).sum(axis=1)).max())]})

    balls = line.groupBy("cell").applyInArrow(ball, "cell long, centre binary, radius double").toArrow()  # their bytes are bounded
    cells, centres, radii = balls["cell"].to_numpy(), binary_matrix(balls["centre"], "<f8", dim), balls["radius"].to_numpy()
    model = line.sparkSession.sparkContext.broadcast((cells, centres, radii))
    reach = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("reach"))
    asked = ask.select(F.col("vec_id").alias("query_id"), "vec").join(reach, "query_id", "left").select("query_id", "vec", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))

    def where(batches):
        cells, centres, radii = model.value
        for b in batches:
            v, reach = _tame(binary_matrix(b.column(1), kind, dim)), b.column(2).to_numpy()
            for i in range(0, len(v), 64):
                q = v[i : i + 64]
                away = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * q @ centres.T, 0))
                row, at = np.nonzero(away - radii <= reach[i : i + 64, None] + 1e-6 * (away + radii))
                part = b.slice(i, 64).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cells[at]), *part.columns], ["cell", "query_id", "vec", "reach"])

    return _met(line, asked.mapInArrow(where, "cell long, query_id long, vec binary, reach double"), dim, kind, k)


def _tame(vectors: np.ndarray) -> np.ndarray:
    """Vectors as doubles whose products stay finite: only where they lie on a curve or in a stretch hangs on them, and
    components beyond 1e140 count as that there."""
    return np.clip(vectors.astype(np.float64), -1e140, 1e140)


def _bounds(vectors: DataFrame, dim: int, kind: str, turn) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest coordinate on each axis of each curve: two numbers for each task come to the driver's query."""

    def ends(batches):
        low, high = np.full((CURVES, AXES), np.inf), np.full((CURVES, AXES), -np.inf)
        for b in batches:
            v = _tame(binary_matrix(b.column(1), kind, dim))
            if len(v):
                at = np.stack([v @ p for p in turn.value])
                low, high = np.minimum(low, at.min(axis=1)), np.maximum(high, at.max(axis=1))
        n = CURVES * AXES
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(low.ravel()), pa.array(high.ravel())], ["i", "low", "high"])

    got = vectors.mapInArrow(ends, "i long, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    low, high = np.zeros(CURVES * AXES), np.ones(CURVES * AXES)
    for r in got:
        low[r["i"]], high[r["i"]] = (r["low"], r["high"]) if np.isfinite(r["low"]) else (0, 1)
    return low.reshape(CURVES, AXES), high.reshape(CURVES, AXES)
