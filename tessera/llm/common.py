"""Helpers shared by the operators: staged tables, text blocks, dense vectors and sorted runs."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage.
SPACE = r"\x20\x09-\x0D"
#: Rows of a batch that goes to Python, see short_batches().
ROWS = 2000
#: Tables that stash() wrote and nothing has deleted yet.
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. The session names it in spark.checkpoint.dir; where that is unset a session on
    one machine takes a local folder, and one on a cluster is an error, since executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns a read of it: lineage ends there, and a lost executor
    costs a read, not a recomputation. The table goes with unstash(), with the scratch() around it, or with the driver."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex[:12]}/{name}"
    if not _WRITTEN:
        atexit.register(_sweep, 0)
    _WRITTEN.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at.getParent(), True)


def _sweep(first: int) -> None:
    """Deletes what was written from the `first` table on; a session that is gone can't delete any more."""
    while len(_WRITTEN) > first:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):
            _delete(spark, path)


def unstash(df: DataFrame) -> None:
    """Deletes a table that stash() wrote and nothing reads any more."""
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] != df._stash_path]
    _delete(df.sparkSession, df._stash_path)


@contextlib.contextmanager
def scratch():
    """Deletes the tables that are written inside at its end, but for those that the function it gives has been told to
    keep: for steps whose result is written, too."""
    first, keep = len(_WRITTEN), []

    def kept(df: DataFrame) -> DataFrame:
        keep.append((df.sparkSession, df._stash_path))
        return df

    try:
        yield kept
    finally:
        paths = {path for _, path in keep}
        _WRITTEN[first:] = [x for x in _WRITTEN[first:] if x[1] not in paths]
        _sweep(first)
        _WRITTEN.extend(keep)


def free_name(name: str, *taken: str) -> str:
    """The name, with as many underscores behind it as it takes to differ from those taken, whatever their case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names: an operator's results replace columns of the same name."""
    low = {n.lower() for n in names}
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in low))


def short_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends ROWS rows at most to Python at once, or fewer if it is set so. With whole
    texts the default of 10,000 rows makes batches of tens of MB, held by the JVM and by Python, in every task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return df


def crc_mod(id_col: Column, n: int) -> Column:
    return F.crc32(id_col.cast("string")) % n


def text_blocks(texts: list, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Slices [a, b) of texts, each of one text or of about `most` characters at the most; texts stay whole."""
    a = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(texts):
        yield a, len(texts)


def text_parts(b: pa.RecordBatch, at: int, most: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with their texts in column `at`: whole texts, about `most` characters; only few rows' texts are
    Python objects at a time."""
    for i in range(0, b.num_rows, 500):
        rows = b.slice(i, 500)
        texts = rows.column(at).to_pylist()
        for s, e in text_blocks(texts, most):
            yield rows.slice(s, e - s), texts[s:e]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def binary_matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A column of equally long binary values as a matrix, without copies where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, width), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


# ---- dense vectors ---------------------------------------------------------------------------------------------------


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, str]:
    """(vec_id long, vec binary: little-endian components) of the rows that can take part, the dimension and the type of
    a component: float32 for an array of floats, else float64, so that values are those of the column.

    Null vectors, zero vectors and vectors holding null or non-finite components take no part. The dimension is that of
    the longest vector; shorter ones count as if zeros followed. It is 0 for a table without vectors.
    """
    kind = "<f4" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("vec"))
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(ok, F.lit(False)))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0

    def pack(batches):
        for b in batches:
            v = b.column(1)
            flat, size = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), kind), np.diff(v.offsets.to_numpy())
            ends = np.cumsum(size)
            made = [flat[e - n : e].tobytes().ljust(dim * flat.itemsize, b"\0") for e, n in zip(ends.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["vec_id", "vec"])

    return rows.mapInArrow(pack, "vec_id long, vec binary"), dim, kind


# ---- equal keys: sorted runs, hot keys split into pairs of chunks ----------------------------------------------------


def spread(rows: DataFrame, id_col: str, chunk: int) -> DataFrame:
    """Deals rows with a column `key` so that every two rows of a key meet in a run of at most about 2 * chunk rows.

    Adds run (long), the sort key of runs, side (int) and cross (boolean). A key with more than `chunk` rows is dealt
    into c = ceil(rows / chunk) chunks by a hash of id_col; run (i, j) holds chunks i and j, and only pairs of different
    sides count where cross is set. No row or pair is dropped, and no task gathers a whole key.
    """
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_key")).where(F.col("n_key") > chunk)
    # Written first: its size is then known, and where it's small the rows aren't shuffled for the join.
    hot = stash(hot.select("key", F.ceil(F.col("n_key") / chunk).cast("int").alias("chunks")), "hot")
    dealt = rows.join(hot, "key", "left")
    c, mine = F.coalesce("chunks", F.lit(1)), F.pmod(F.xxhash64(F.lit("chunk"), F.col(id_col)), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = dealt.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), c - 1)))
    lo, hi = F.least("side", "other"), F.greatest("side", "other")
    return dealt.withColumn("run", F.when(c == 1, F.col("key")).otherwise(F.xxhash64("key", lo, hi))).withColumn("cross", lo != hi).drop("chunks", "other")


def sorted_runs(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.Table]:
    """Whole runs of equal `run`, `key` out of batches sorted by them, some runs at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < most:
            continue
        t = pa.Table.from_batches(held)
        run, key = t["run"].to_numpy(), t["key"].to_numpy()
        same = np.flatnonzero((run != run[-1]) | (key != key[-1]))
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            n -= cut
    if held:
        yield pa.Table.from_batches(held)


def pair_lags(run: np.ndarray, key: np.ndarray, side: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of rows of a run that counts, as index arrays, one distance in the sort order at a time."""
    at, n, lag = np.arange(len(run)), len(run), 0
    while True:
        lag += 1
        at = at[at + lag < n]
        at = at[(run[at + lag] == run[at]) & (key[at + lag] == key[at])]
        if not len(at):
            return
        use = at[~cross[at] | (side[at] != side[at + lag])]
        if len(use):
            yield use, use + lag


class Forest:
    """Union-find over 0..n-1 whose unions and finds are array operations."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.root[a] != self.root[b]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            far = x != y
            a, b, x, y = a[far], b[far], x[far], y[far]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]
