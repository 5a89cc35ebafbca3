"""Physical design: caching, sorted and bucketed copies, materialized views, statistics and parallelism."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.catalog import Database


def in_memory(db: Database, relation: str) -> None:
    db.spark.catalog.cacheTable(f"{db.name}.{relation}")


def not_in_memory(db: Database, relation: str) -> None:
    db.spark.catalog.uncacheTable(f"{db.name}.{relation}")


def sorted_copy(df: DataFrame, path: str, *keys: str, files: int = 8) -> None:
    """Files by ranges of the keys, sorted within: a range or point predicate on them skips most row groups."""
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def bucketed_copy(db: Database, df: DataFrame, relation: str, key: str, buckets: int = 16) -> None:
    """A table in buckets of a key: joins and groups on the key need no shuffle of it."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(f"{db.name}.{relation}")


def analyze(db: Database, relation: str, columns: bool = True) -> None:
    """Statistics for the optimizer. Columns of timestamps stay out: the optimizer can't use their histograms."""
    db.spark.sql(f"ANALYZE TABLE `{db.name}`.`{relation}` COMPUTE STATISTICS")
    if columns and (names := [c for c, t in db.table(relation).dtypes if not t.startswith("timestamp")]):
        db.spark.sql(f"ANALYZE TABLE `{db.name}`.`{relation}` COMPUTE STATISTICS FOR COLUMNS {', '.join(f'`{c}`' for c in names)}")


@contextmanager
def settings(spark: SparkSession, **values):
    """Session settings for a while: underscores stand for points, as in spark_sql_shuffle_partitions=4."""
    names = {k.replace("__", ".").replace("_", "."): str(v) for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@contextmanager
def parallel(spark: SparkSession, degree: int):
    with settings(spark, spark_sql_shuffle_partitions=degree):
        yield


@contextmanager
def cost_based(spark: SparkSession):
    """Join order by statistics."""
    keys = ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "true")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


class Materialized:
    """Named results that are stored: made from a query, refreshed on demand, read instead of it.

    A view is used where it's asked for by name; read(rows, since) gives the rest of a predicate from the base, so that a
    view that covers a part of the question still serves.
    """

    def __init__(self, db: Database):
        self.db, self.queries = db, {}

    def create(self, name: str, query: DataFrame) -> None:
        self.queries[name] = query
        query.write.mode("overwrite").format("parquet").saveAsTable(f"{self.db.name}.{name}")

    def refresh(self, name: str) -> None:
        self.create(name, self.queries[name])

    def read(self, name: str) -> DataFrame:
        return self.db.table(name)

    def covering(self, name: str, inside: str, rest: DataFrame) -> DataFrame:
        """The view's rows for a predicate, and the rows of the base that the view lacks."""
        return self.read(name).where(F.expr(inside)).unionByName(rest)

    def drop(self, name: str) -> None:
        self.queries.pop(name)
        self.db.spark.sql(f"DROP TABLE IF EXISTS `{self.db.name}`.`{name}`")
