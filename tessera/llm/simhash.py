"""SimHash near-dedup with pivot distance tables.

Fingerprints are compared class by class. Tables of fingerprint bits bring pairs that may be near together; within a
table's bucket, precomputed Hamming distances to many reference fingerprints discard pairs by their largest coordinate
difference, and only survivors are compared bit by bit.

Two schemes are in use. EXACT: 64 bits of 3-word shingles, at most three differing bits; some two of five blocks of bits
are then alike, so ten tables find every pair. SIMILAR: 512 bits of the set of 5-word shingles bring pairs that may have a
Jaccard similarity of 0.8 together; its radius and tables of drawn bits retrieve a pair at the threshold with a joint
probability of 0.993, a nearer one sooner. Only pairs whose shingles, counted in the texts, have that similarity link.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Forest, binary_matrix, pair_lags, short_batches, sorted_runs, spread, stash
from tessera.llm.components import components

SEED = 42
PIVOTS = 24
#: Rows of a bucket that are compared in one go; larger buckets are dealt into pairs of chunks.
CHUNK = 1024
#: A fingerprint of more than one in HOT rows is dealt to SALTS tasks where rows get their class.
HOT, SALTS = 256, 256
_SHINGLES_AT_ONCE, _AT_ONCE = 1 << 14, 1 << 12


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, 64-bit words of a fingerprint, the most differing bits of a link, the bits that each table's
    key consists of, and the least Jaccard similarity of a link. With the latter, shingles count once, their hashes are
    expanded to as many words, and a digest of their set stands behind a fingerprint's bits, so that a class has one
    set."""

    words: int
    width: int
    radius: int
    tables: tuple[tuple[int, ...], ...] = field(repr=False)
    least: float = 0.0

    @property
    def bytes(self) -> int:
        """Of a fingerprint, and of the digest behind it."""
        return 8 * self.width + (16 if self.least else 0)


def _alike_blocks(widths: tuple[int, ...], radius: int) -> tuple[tuple[int, ...], ...]:
    """Of len(widths) blocks, `radius` may hold differing bits; the others are alike."""
    ends = list(accumulate(widths))
    blocks = [range(e - w, e) for w, e in zip(widths, ends)]
    return tuple(tuple(i for b in chosen for i in b) for chosen in combinations(blocks, len(blocks) - radius))


def _drawn(bits: int, key: int, tables: int) -> tuple[tuple[int, ...], ...]:
    rng = np.random.default_rng(SEED)
    return tuple(tuple(sorted(rng.choice(bits, key, replace=False).tolist())) for _ in range(tables))


def differing_share(similarity: float) -> float:
    """Share of bits in which two sets of that Jaccard similarity and of one size differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(scheme: Scheme, n: int) -> tuple[tuple[int, ...], ...]:
    """Drawn tables for n fingerprints. Keys grow with their number, so that a bucket holds some hundreds at most on
    average, and tables are added for what longer keys lose."""
    key = max(KEY_BITS, round(math.log2(max(2, n))) - 8)
    share = (1 - differing_share(scheme.least)) ** key
    return _drawn(64 * scheme.width, key, math.ceil(math.log(1 - FOUND) / math.log(1 - share)))


EXACT = Scheme(3, 1, 3, _alike_blocks((13, 13, 13, 13, 12), 3))
_WIDTH, _SHARE = 8, differing_share(0.8)
#: The radius is the mean of pairs at the threshold and 2.5 standard deviations more: a wider one would let pass what only
#: shares a passage. The tables hang on the number of fingerprints, see tables_for().
SIMILAR = Scheme(5, _WIDTH, round(64 * _WIDTH * _SHARE + 2.5 * math.sqrt(64 * _WIDTH * _SHARE * (1 - _SHARE))), (), 0.8)
#: Probability that tables bring a pair at the threshold together, and the least bits of a key.
FOUND, KEY_BITS = 0.999, 10
#: Tables of SIMILAR that join what is nearly alike, before pairs are made of the rest.
FIRST_TABLES = 8
#: Pivots of SIMILAR: its radius is so wide that more of them discard no more pairs.
FEW_PIVOTS = 4


def _shingles(text: str | None, words: int):
    """Lists of the shingles of a text, some at a time."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts, n = [0, *ends[:-1]], max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    for a in range(0, n, _SHINGLES_AT_ONCE):
        yield [joined[s : e - 1] for s, e in zip(starts[a : min(n, a + _SHINGLES_AT_ONCE)], last[a : a + _SHINGLES_AT_ONCE])]


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The different shingles of a text, each as 64 bits of its hash; sorted."""
    parts = [np.fromiter((xxhash.xxh3_64_intdigest(x, SEED) for x in part), np.uint64, len(part)) for part in _shingles(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def fingerprint(text: str | None, scheme: Scheme = EXACT) -> bytes:
    """The fingerprint of a text, see near_groups(); most significant bit first."""
    ones, n = np.zeros(64 * scheme.width, np.int64), 0
    if scheme.least:
        found = shingle_set(text, scheme.words)
        step = np.arange(1, scheme.width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        parts = (_mixed(found[a : a + _AT_ONCE, None] + step) for a in range(0, len(found), _AT_ONCE))
    else:
        parts = (np.frombuffer(b"".join([xxhash.xxh64_digest(x, SEED) for x in some]), ">u8").reshape(-1, 1) for some in _shingles(text, scheme.words))
    for part in parts:
        n += len(part)
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int32)
    bits = np.packbits(ones * 2 > n).tobytes()
    return bits + _digest(found) if scheme.least else bits


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit value's bits mixed, as independent ones."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes(), SEED)


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """(doc_id, fp binary) of every row, see near_groups(): null texts count as empty, rows that repeat stay, an empty table
    gives an empty one, other columns are ignored."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t, scheme) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "fp"])

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp binary")


def _keys(scheme: Scheme, tables: int | None = None):
    """Rows (fingerprint, ...) with their keys, one for each of the first tables; fingerprints are never null, and equal
    ones have equal keys."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                bits = np.unpackbits(binary_matrix(part.column(0), np.uint8, 8 * scheme.width), axis=1).astype(np.int64)
                keys = np.stack([(t << 32) + bits[:, chosen] @ (1 << np.arange(len(chosen))) for t, chosen in enumerate(scheme.tables[:tables])], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "keys"])

    return run


def _links(scheme: Scheme):
    def run(batches):
        """Edges (a, b) that connect what lies within the radius in each run: at most one for each row."""
        pivots = np.random.default_rng(SEED).integers(0, 1 << 64, (PIVOTS, scheme.width), dtype=np.uint64)
        for t in sorted_runs(batches):
            order, key, side, cross = (t[c].to_numpy() for c in ("run", "key", "side", "cross"))
            fp = binary_matrix(t["fp"], ">u8", scheme.width).astype(np.uint64)
            table = np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int16) for p in pivots])
            forest = Forest(len(fp))
            for a, b in pair_lags(order, key, side, cross):
                far = forest.apart(a, b)
                a, b = a[far], b[far]
                for row in table:
                    if not len(a):
                        break
                    near = np.abs(row[a] - row[b]) <= scheme.radius
                    a, b = a[near], b[near]
                near = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1) <= scheme.radius
                forest.join(a[near], b[near])
            child, root = forest.edges()
            rep = t["rep"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[root])], ["a", "b"])

    return run


_MEMBERS = "run long, key long, side int, cross boolean, node long, bits binary, part long"


def _near(t: pa.Table, scheme: Scheme, pivots: np.ndarray):
    """(x, y, differing bits) of the pairs of a run's rows that lie within the radius and have not met yet (their `part`
    differs), in the first table that both share."""
    chosen = [np.array(c) for c in scheme.tables]
    raw = binary_matrix(t["bits"], np.uint8, 8 * scheme.width)
    fp = raw.view(">u8").astype(np.uint64)
    away = np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int16) for p in pivots])
    part, table = t["part"].to_numpy(), t["key"].to_numpy() >> 32
    for a, b in pair_lags(*(t[c].to_numpy() for c in ("run", "key", "side", "cross"))):
        for i in range(0, len(a), 1 << 15):
            x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
            new = part[x] != part[y]
            x, y = x[new], y[new]
            for row in away:
                near = np.abs(row[x] - row[y]) <= scheme.radius
                x, y = x[near], y[near]
            bits = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1)
            near = bits <= scheme.radius
            x, y, bits = x[near], y[near], bits[near]
            if not len(x):
                continue
            differ = np.unpackbits(raw[x] ^ raw[y], axis=1)
            earlier = np.zeros(len(x), bool)
            for k in range(int(table[x].max())):
                earlier |= (k < table[x]) & ~differ[:, chosen[k]].any(axis=1)
            yield x[~earlier], y[~earlier], bits[~earlier]


def _pivots(scheme: Scheme) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, (FEW_PIVOTS, scheme.width), dtype=np.uint64)


def _members(scheme: Scheme):
    """The rows that have a pair in their run."""

    def run(batches):
        for t in sorted_runs(batches, 1 << 14):
            some = np.zeros(t.num_rows, bool)
            for x, y, _ in _near(t, scheme, _pivots(scheme)):
                some[x] = some[y] = True
            yield from t.filter(pa.array(some)).combine_chunks().to_batches()

    return run


def _sets(scheme: Scheme):
    """Rows (..., digest, text) of members with the text's set of shingles instead. Of rows that repeat an id, the one with
    the node's digest counts."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                found = [shingle_set(x, scheme.words) for x in part.column(part.num_columns - 1).to_pylist()]
                keep = [k for k, (x, d) in enumerate(zip(found, part.column(part.num_columns - 2).to_pylist())) if _digest(x) == d]
                own = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns[:-2], pa.array([found[k].tobytes() for k in keep], pa.binary())], [*own.schema.names[:-2], "shingles"])

    return run


def _verified(scheme: Scheme):
    """Edges (a, b) between nodes whose shingles have the least similarity, as many as connect them: the nearest pairs of
    a run come first, and what is connected isn't compared again. No pair leaves the run unless it is an edge."""

    def run(batches):
        for t in sorted_runs(batches, 1 << 11):
            held, sets, root = t["shingles"], {}, list(range(t.num_rows))

            def of(i):
                if i not in sets:
                    sets[i] = set(np.frombuffer(held[i].as_py(), np.uint64).tolist())
                return sets[i]

            def top(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            found = list(_near(t, scheme, _pivots(scheme)))
            x, y, bits = map(np.concatenate, zip(*found)) if found else (np.zeros(0, int),) * 3
            order, edges = np.argsort(bits, kind="stable"), []
            for i, j in zip(x[order].tolist(), y[order].tolist()):
                if (p := top(i)) == (q := top(j)):
                    continue
                m, n = of(i), of(j)
                if min(len(m), len(n)) < scheme.least * max(len(m), len(n)):
                    continue
                both = len(m & n)
                if both >= scheme.least * (len(m) + len(n) - both):
                    root[max(p, q)] = min(p, q)
                    edges.append((i, j))
            node = t["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[[e[0] for e in edges]] if edges else [], pa.int64()), pa.array(node[[e[1] for e in edges]] if edges else [], pa.int64())], ["a", "b"])

    return run


def _similar(docs: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """(fp, component_id) of the classes, which link if their shingles are alike. First what few tables bring together is
    joined; then what all tables do, but for pairs that have met. Rows of a bucket that may have a link travel once more,
    with their shingles, and are compared in one task; pairs never travel, so a large group makes no more rows than it
    has members in each table."""
    bits = 8 * scheme.width
    nodes = stash(classes.where(F.col("rep").isNotNull()).select("fp", "rep", F.xxhash64("fp").alias("node"), F.substring("fp", bits + 1, 16).alias("digest")), "nodes")
    scheme = replace(scheme, tables=tables_for(scheme, nodes.count()))

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))

    def links(tables: int, of: DataFrame) -> DataFrame:
        rows = of.mapInArrow(_keys(scheme, tables), "bits binary, node long, part long, keys array<long>").select("bits", "node", "part", F.explode("keys").alias("key"))
        rows = spread(rows, "node", CHUNK).select("run", "key", "side", "cross", "node", "bits", "part").repartition("run").sortWithinPartitions("run", "key")
        found = stash(rows.mapInArrow(_members(scheme), _MEMBERS), "members").join(nodes.select("node", "rep", "digest"), "node")
        found = found.join(texts, F.col("rep") == F.col("_id")).select("run", "key", "side", "cross", "node", "bits", "part", "digest", "_text")
        sets = short_batches(found).mapInArrow(_sets(scheme), f"{_MEMBERS}, shingles binary").dropDuplicates(["run", "key", "side", "node"])
        return sets.repartition("run").sortWithinPartitions("run", "key").mapInArrow(_verified(scheme), "a long, b long").distinct()

    own = nodes.select(F.substring("fp", 1, bits).alias("bits"), "node")
    first = stash(links(FIRST_TABLES, own.withColumn("part", F.col("node"))), "first")
    met = components(first, "a", "b").select(F.col("node").alias("_node"), "component")
    named = own.join(met, own["node"] == met["_node"], "left").select("bits", "node", F.coalesce("component", "node").alias("part"))
    rest = stash(links(len(scheme.tables), stash(named, "met")), "rest")
    found = components(first.unionByName(rest), "a", "b").select(F.col("node").alias("_node"), "component")
    named = nodes.join(found, nodes["node"] == found["_node"], "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_groups(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """(doc_id, fp binary, component_id) for every row of docs.

    Texts are lower-cased in A-Z only and cut at ASCII white space; their shingles of words, repeats included, are joined
    by a space; fewer words than a shingle make one shingle, none (null and empty texts) the fingerprint 0, which links
    like any other. A bit is set if more than half of the shingles' hashes have it. Fingerprints within the scheme's
    radius link, if the scheme has no least similarity; else their sets of shingles must have it too. component_id is the smallest doc_id that links reach. Equal fingerprints are one class, so copies never
    make pairs. A null doc_id stays in the result and is never a component_id; a class of null ids only has none and
    links with nothing. Repeated rows stay; an empty table gives an empty one; other columns are ignored.
    """
    fps = stash(fingerprints(docs, scheme), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    if scheme.least:
        classes = stash(classes, "classes")
        named = classes.select("fp").join(_similar(docs, classes, scheme).withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp"), "left").select("fp", "component_id")
        return _named(fps, named, classes).select("doc_id", "fp", "component_id")
    rows = classes.where(F.col("rep").isNotNull()).select("fp", "rep").mapInArrow(_keys(scheme), "fp binary, rep long, keys array<long>").select("fp", "rep", F.explode("keys").alias("key"))
    rows = spread(rows, "rep", CHUNK).select("run", "key", "side", "cross", "fp", "rep")
    edges = rows.repartition("run").sortWithinPartitions("run", "key").mapInArrow(_links(scheme), "a long, b long")
    found = components(edges, "a", "b")
    named = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return _named(fps, named, classes).select("doc_id", "fp", "component_id")


def _named(fps: DataFrame, named: DataFrame, classes: DataFrame) -> DataFrame:
    """fps with the component of each fingerprint. A class with more than one in HOT rows is dealt to SALTS tasks; there
    are fewer than HOT such classes, whatever the input, so their list is broadcast."""
    hot = classes.where(F.col("n") * HOT > fps.count()).select("fp", F.lit(SALTS).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = fps.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int")).drop("salts")
    right = named.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, ["fp", "salt"], "left")


def hex_of(fp: Column) -> Column:
    return F.lower(F.hex(fp))


def deduplicate(docs: DataFrame, scheme: Scheme = SIMILAR) -> DataFrame:
    """docs, of each group of near copies the document with the smallest doc_id; rows without doc_id stay, and rows that
    repeat a kept doc_id stay with it. Empty and null texts are copies of each other. An empty table gives an empty one,
    and all columns stay as they are."""
    groups = near_groups(docs, scheme)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_keep")).distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    return named.join(kept, named["doc_id"] == kept["_keep"], "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
