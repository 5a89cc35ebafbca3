"""Embedding near-dedup by iterative quantisation.

Rotations of the unit vectors are learned so that the signs of the rotated coordinates make balanced codes with little
quantisation error. Substrings of the codes are the keys of Hamming tables; vectors that share a key are retrieved and
reranked by the cosine of the original vectors.

A key has about as many bits as it takes to number the vectors, so that buckets don't grow with them, and there are as
many tables as it takes to retrieve a pair at the threshold with the probability FOUND. Vectors are centred only where
that takes nothing from it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Forest, binary_matrix, clean_vectors, pair_lags, sorted_runs, spread, stash
from tessera.llm.components import components

THRESHOLD = 0.95
#: Vectors that the rotations are fitted on at most; every vector is coded and indexed.
SAMPLE = 20_000
STEPS = 30
#: Bits of one rotation's code; bits of a table's key at the least and at the most.
CODE_BITS = 64
KEY_BITS = (8, 30)
#: Probability of retrieving a pair at the threshold that tables are made for.
FOUND = 0.985
CHUNK = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def differing(threshold: float, length: float = 1.0) -> float:
    """Share of bits in which unit vectors at that cosine differ on average, seen from a centre at this distance of both:
    their distance is the same from everywhere, their angle grows as the centre comes near."""
    return 2 * math.asin(min(1.0, math.sqrt((1 - threshold) / 2) / max(length, 1e-9))) / math.pi


@dataclass
class Codes:
    """The mean, a matrix (dim, bits), tables and bits of a table's key, and the most differing bits of a pair."""

    mean: np.ndarray
    matrix: np.ndarray
    tables: int
    key_bits: int
    most: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """(n, bits / 64) unsigned 64-bit codes."""
        return np.packbits((unit(vectors) - self.mean) @ self.matrix >= 0, axis=1).view(np.uint64)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """(n, tables) keys: consecutive substrings of the codes."""
        bits = np.unpackbits(codes.view(np.uint8), axis=1)[:, : self.tables * self.key_bits].reshape(len(codes), self.tables, self.key_bits)
        return bits.astype(np.int64) @ (1 << np.arange(self.key_bits, dtype=np.int64))


def fit(sample: np.ndarray, dim: int, rows: int, threshold: float = THRESHOLD, steps: int = STEPS, seed: int = 42) -> Codes:
    """Codes for a table of so many rows. Each block of CODE_BITS columns is learned from its own random start: signs of
    the projected sample and the rotation that brings it closest to them, in turn. Where the vectors have fewer
    dimensions than a code has bits, random projections stand before the rotation instead of principal ones.

    Centring balances codes, but near a centre pairs differ in more bits: vectors are centred only if a tenth of the
    sample at most lies so near that they do.
    """
    rng = np.random.default_rng(seed)
    x = unit(sample) if len(sample) else np.zeros((1, dim))
    share = differing(threshold)
    mean = x.mean(axis=0)
    if differing(threshold, float(np.quantile(np.sqrt(((x - mean) ** 2).sum(axis=1)), 0.1))) > 1.1 * share:
        mean = np.zeros(dim)
    share *= 1.05
    key_bits = int(np.clip(round(math.log2(max(2, rows))), *KEY_BITS))
    tables = math.ceil(math.log(1 - FOUND) / math.log(1 - (1 - share) ** key_bits))
    blocks = -(-tables * key_bits // CODE_BITS)
    x = x - mean
    axes = np.linalg.svd(x.T @ x)[0]
    found = []
    for _ in range(blocks):
        if dim >= CODE_BITS:
            base = axes[:, :CODE_BITS] if dim == CODE_BITS else axes @ np.linalg.qr(rng.normal(size=(dim, CODE_BITS)))[0]
        else:
            base = rng.normal(size=(dim, CODE_BITS))
        v = x @ base
        r = np.linalg.qr(rng.normal(size=(CODE_BITS, CODE_BITS)))[0]
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        found.append(base @ r)
    bits = blocks * CODE_BITS
    return Codes(mean, np.concatenate(found, axis=1), tables, key_bits, round(bits * share + 6 * math.sqrt(bits * share * (1 - share))))


def _links(model, dim: int, kind: str, threshold: float):
    def run(batches):
        """Rows (0, rep, links found) and (1, a, b): every pair counts in the first table that both share, and the edges
        connect what the run links, at most one for each row."""
        known: Codes = model.value
        for t in sorted_runs(batches, 1 << 13):
            order, key, side, cross = (t[c].to_numpy() for c in ("run", "key", "side", "cross"))
            rep, copies, table = t["rep"].to_numpy(), t["copies"].to_numpy(), t["table"].to_numpy()
            code = binary_matrix(t["code"], np.uint64, known.matrix.shape[1] // 64)
            parts = known.keys(code)
            v = unit(binary_matrix(t["vec"], kind, dim))
            found, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
            for a, b in pair_lags(order, key, side, cross):
                for i in range(0, len(a), 1 << 14):
                    x, y = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
                    near = np.bitwise_count(code[x] ^ code[y]).sum(axis=1) <= known.most
                    x, y = x[near], y[near]
                    first = (parts[x] == parts[y]).argmax(axis=1) == table[x]
                    x, y = x[first], y[first]
                    near = np.einsum("ij,ij->i", v[x], v[y]) >= threshold
                    x, y = x[near], y[near]
                    np.add.at(found, x, copies[y])
                    np.add.at(found, y, copies[x])
                    forest.join(x, y)
            child, root = forest.edges()
            has = np.flatnonzero(found)
            made = np.repeat(np.array([0, 1], np.int32), [len(has), len(child)])
            yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(np.concatenate([rep[has], rep[child]])), pa.array(np.concatenate([found[has], rep[root]]))], ["kind", "a", "b"])

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links long, component_id long, kept boolean) for every row of df.

    Pairs that are retrieved and have a cosine of at least `threshold`, in double precision, link; equal vectors are one
    class and count each other, without pairs. Vectors that can't take part (see clean_vectors) link with nothing. A row
    with a null id takes no part; a repeated id stands for the class of each of its rows. component_id is the smallest
    id that links reach; kept is vec_id = component_id. An empty table gives an empty one; other columns are ignored.
    """
    spark = df.sparkSession
    vectors, dim, kind = clean_vectors(df, id_col, vec_col)
    ids = df.select(F.col(id_col).cast("long").alias("vec_id"))
    if not dim:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    vectors = stash(vectors.where("vec_id is not null"), "vectors")
    classes = stash(vectors.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "copies", "vec"), "classes")
    sample = classes.orderBy(F.xxhash64(F.lit("itq"), "rep"), "rep").limit(SAMPLE).toArrow()
    model = spark.sparkContext.broadcast(fit(binary_matrix(sample["vec"], kind, dim), dim, classes.count(), threshold))

    def code(batches):
        known: Codes = model.value
        for b in batches:
            got = known.of(binary_matrix(b.column(2), kind, dim)) if b.num_rows else np.empty((0, known.matrix.shape[1] // 64), np.uint64)
            keys = known.keys(got)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, known.tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in got], pa.binary()), lists], ["rep", "copies", "vec", "code", "parts"])

    rows = classes.mapInArrow(code, "rep long, copies long, vec binary, code binary, parts array<long>")
    rows = rows.select("rep", "copies", "vec", "code", F.posexplode("parts").alias("table", "part"))
    rows = spread(rows.withColumn("key", F.col("table").cast("long") * (1 << KEY_BITS[1]) + F.col("part")), "rep", CHUNK)
    found = rows.select("run", "key", "side", "cross", "rep", "copies", "table", "code", "vec").repartition("run").sortWithinPartitions("run", "key").mapInArrow(_links(model, dim, kind, threshold), "kind int, a long, b long")
    found = stash(found, "links")
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("found"))
    nodes = components(found.where("kind = 1"), "a", "b")
    named = classes.join(links, F.col("rep") == links["a"], "left").join(nodes, F.col("rep") == nodes["node"], "left")
    named = named.select(F.col("vec").alias("_vec"), (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = vectors.join(named, vectors["vec"] == named["_vec"]).groupBy(F.col("vec_id").alias("_id")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = ids.join(linked, ids["vec_id"] == linked["_id"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
