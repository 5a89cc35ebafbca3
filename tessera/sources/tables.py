"""Reading and writing relations: Parquet, separated text, and workloads that read them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.builder import drawn
from tessera.schema import Schema
from tessera.sources.catalog import Database
from tessera.types import date_number

#: Letters of a line's format and how a field's text becomes a value.
_LETTERS = {"i": lambda c: c.cast("int"), "d": lambda c: c.cast("double"), "s": lambda c: F.regexp_replace(c, r"[\x00 \n]+\z", ""), "t": lambda c: date_number(c)}


def read_parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a folder, its timestamps as dates: statistics of columns then work in the optimizer."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*(F.col(c).cast("date").alias(c) if t.startswith("timestamp") and table != "events" else F.col(c) for c, t in df.dtypes))


def read_text(spark: SparkSession, path: str, names: list[str], letters: str, sep: str = "|") -> DataFrame:
    """Lines of separated fields by a format of letters: i integer, d double, s string, t date to yyyymmdd. Fields
    behind the last letter are dropped."""
    if len(names) != len(letters) or set(letters) - set(_LETTERS):
        raise ValueError("a letter for each name is needed")
    parts = F.split(F.col("value"), "[" + sep + "]")
    return spark.read.text(path).where(F.col("value") != "").select(*(_LETTERS[k](F.get(parts, F.lit(i))).alias(n) for i, (n, k) in enumerate(zip(names, letters))))


def write_text(df: DataFrame, path: str, sep: str = "|") -> None:
    df.select(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))).write.text(path)


def write_records(df: DataFrame, path: str) -> None:
    """Rows as a columnar file: the binary sink."""
    df.write.parquet(path)


def read_records(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    return schema.fit(spark.read.schema(schema.struct()).parquet(path))


def load(db: Database, schema: Schema, df: DataFrame, factor: float = 1.0, seed: int = 12345) -> int:
    """Creates a relation with about a share `factor` of the rows, each by itself; returns their number."""
    db.create(schema)
    db.append(schema.name, df if factor >= 1 else df.sample(factor, seed=seed))
    return db.table(schema.name).count()


def read_all(db: Database, relation: str) -> dict:
    """The sequential workload: rows read and rows a second, by a sink that keeps nothing."""
    start = time.perf_counter()
    db.table(relation).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    rows = db.table(relation).count()
    return {"rows": rows, "seconds": seconds, "rows_per_second": rows / seconds}


def read_random(db: Database, relation: str, key: str, share: float, seed: int = 12345) -> DataFrame:
    """The random workload: the rows of a share of keys, drawn by a hash, by a semi join on them."""
    keys = db.table(relation).select(key).distinct().where(drawn(seed, [key], share))
    return db.table(relation).join(keys, key, "left_semi")
