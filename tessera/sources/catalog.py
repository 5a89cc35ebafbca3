"""A database: relations with declared schemas over Spark's catalog, and queries over them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expressions import column
from tessera.operators.builder import Node, Query
from tessera.schema import Schema


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Database:
    """Relations are Parquet tables of one catalog database; their declared schemas are table properties, so a database
    that is opened again knows them."""

    PROPERTY = "tessera.schema"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")

    def _full(self, relation: str) -> str:
        return f"`{self.name}`.`{relation}`"

    def relations(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.name) if not t.isTemporary)

    def exists(self, relation: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.name}.{relation}")

    def create(self, schema: Schema) -> None:
        if self.exists(schema.name):
            raise ValueError(f"{schema.name} exists")
        fields = ", ".join(f"`{f}` {k.spark.simpleString()}" for f, k in schema.fields)
        self.spark.sql(f"CREATE TABLE {self._full(schema.name)} ({fields}) USING parquet TBLPROPERTIES ('{self.PROPERTY}' = {_literal(schema.to_json())})")

    def drop(self, relation: str, missing_ok: bool = False) -> None:
        if not self.exists(relation):
            if missing_ok:
                return
            raise ValueError(f"no relation {relation}")
        self.spark.sql(f"DROP TABLE {self._full(relation)}")

    def describe(self, relation: str) -> Schema:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._full(relation)}").where(F.col("key") == self.PROPERTY).collect()
        if not rows:
            raise ValueError(f"{relation} has no declared schema")
        return Schema.from_json(rows[0]["value"])

    def table(self, relation: str) -> DataFrame:
        return self.spark.table(f"{self.name}.{relation}")

    def tuples(self, relation: str):
        """An iterator over the relation's rows, a partition at a time."""
        return self.table(relation).toLocalIterator()

    def query(self, relation: str) -> Query:
        return Query(self.table(relation), Node("TableScan", relation), self)

    def append(self, relation: str, df: DataFrame) -> None:
        """Inserts rows; values are made to fit the declared types."""
        self.describe(relation).fit(df).write.insertInto(f"{self.name}.{relation}")

    def insert(self, relation: str, rows: list[tuple]) -> None:
        self.append(relation, self.spark.createDataFrame(rows, self.describe(relation).struct()))

    def _rewrite(self, relation: str, df: DataFrame) -> None:
        """A table can't be overwritten while it's read, so the new rows are written first and then swapped in."""
        staged = f"{relation}_{uuid.uuid4().hex[:8]}"
        schema = self.describe(relation)
        self.create(Schema(staged, schema.fields))
        df.select(*schema.names).write.insertInto(f"{self.name}.{staged}")
        old = f"{relation}_{uuid.uuid4().hex[:8]}_old"
        # The old rows go last: a crash on the way loses a name, never rows.
        self.spark.sql(f"ALTER TABLE {self._full(relation)} RENAME TO {self._full(old)}")
        self.spark.sql(f"ALTER TABLE {self._full(staged)} RENAME TO {self._full(relation)}")
        self.spark.sql(f"ALTER TABLE {self._full(relation)} SET TBLPROPERTIES ('{self.PROPERTY}' = {_literal(schema.to_json())})")
        self.spark.sql(f"DROP TABLE {self._full(old)}")

    def delete(self, relation: str, predicate: str | Column) -> None:
        """Rewrites the relation without the rows for which the predicate is true."""
        self._rewrite(relation, self.table(relation).where(~F.coalesce(column(predicate, self.table(relation)), F.lit(False))))

    def update(self, relation: str, predicate: str | Column, values: dict[str, str | Column]) -> None:
        kinds, hit = dict(self.describe(relation).fields), F.coalesce(column(predicate, self.table(relation)), F.lit(False))
        new = {f: F.when(hit, kinds[f].fit(column(v, self.table(relation)))).otherwise(F.col(f)) for f, v in values.items()}
        self._rewrite(relation, self.table(relation).withColumns(new))

    def clear(self, relation: str, predicate: str | Column) -> None:
        """Sets all fields of the rows to their types' defaults; the rows stay."""
        fields = self.describe(relation).fields
        self.update(relation, predicate, {f: F.lit(k.default) for f, k in fields})

    def lookup(self, relation: str, **key) -> DataFrame:
        """Rows with these values; the filter reaches the files' statistics."""
        out = self.table(relation)
        for field, value in key.items():
            out = out.where(F.col(field) == F.lit(value))
        return out

    def scan_ordered(self, relation: str, *key: str) -> DataFrame:
        return self.table(relation).orderBy(*key)

    def view(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)
