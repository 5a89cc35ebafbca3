"""A fluent builder of queries. Each step returns a new Query over a lazy DataFrame; nothing runs before an action."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.aggregates import Aggregate, Fold
from tessera.functions.expressions import column
from tessera.types import field_type

if TYPE_CHECKING:
    from tessera.sources.catalog import Database

#: Join methods and the hint that asks Spark for the nearest physical join; None leaves the choice to the optimizer.
METHODS = {"auto": None, "nested-loops": "shuffle_replicate_nl", "block-nested-loops": "broadcast", "indexed": None, "hash": "shuffle_hash", "merge": "merge"}
#: Estimated bytes of a side that may be broadcast by a block-nested-loops join; beyond that the optimizer chooses.
BLOCK_BYTES = 64 << 20


@dataclass(frozen=True)
class Node:
    """One operator of a query, for introspection; Spark has the plan that runs."""

    kind: str
    detail: str = ""
    inputs: tuple[Node, ...] = field(default=())

    def walk(self) -> Iterator[Node]:
        yield self
        for node in self.inputs:
            yield from node.walk()

    def lines(self, depth: int = 0) -> list[str]:
        return [f"{'  ' * depth}{self.kind}[{self.detail}]", *(x for n in self.inputs for x in n.lines(depth + 1))]


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def drawn(seed: int, by: list[str], share: float) -> Column:
    """Whether the MD5 of the seed and the columns lies in the first `share` of its range."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in by))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))


class Query:
    def __init__(self, df: DataFrame, node: Node, db: Database | None = None):
        self.df, self.node, self.db = df, node, db

    @classmethod
    def of(cls, df: DataFrame, name: str = "relation") -> Query:
        return cls(df, Node("TableScan", name))

    def _next(self, df: DataFrame, kind: str, detail: str = "", *others: Query) -> Query:
        return Query(df, Node(kind, detail, (self.node, *(q.node for q in others))), self.db)

    def where(self, expr) -> Query:
        """Rows for which a predicate is true."""
        return self._next(self.df.where(column(expr, self.df)), "Select", str(expr))

    def select(self, outputs: Mapping[str, tuple | str] | None = None, **more) -> Query:
        """Computed columns: name to an expression, or to (expression, type)."""
        outputs = {**(outputs or {}), **more}
        made = []
        for name, spec in outputs.items():
            expr, kind = spec if isinstance(spec, tuple) else (spec, None)
            made.append((field_type(kind).fit(column(expr, self.df)) if kind is not None else column(expr, self.df)).alias(name))
        return self._next(self.df.select(*made), "Project", ", ".join(outputs))

    def rename(self, names: Mapping[str, str]) -> Query:
        return self._next(self.df.withColumnsRenamed(dict(names)), "Rename", ", ".join(names.values()))

    def join(self, other: Query, on: list[tuple[str, str]] | str | None = None, expr=None, method: str = "auto", how: str = "inner") -> Query:
        """All columns of this side and then of the other, which must not share names.

        on: pairs of key columns, or the name of one pair by (left, right); expr: a predicate, alone or besides the keys.
        Neither gives all pairs. A method is a wish about the physical join and never changes the result. how may also be
        left_semi or left_anti, which give this side's columns.
        """
        if method not in METHODS:
            raise ValueError(f"no such join method: {method}")
        if shared := set(self.df.columns) & set(other.df.columns):
            raise ValueError(f"both sides have {sorted(shared)}")
        keys = [(on, on)] if isinstance(on, str) else list(on or [])
        condition = None
        for part in [*(F.col(a) == F.col(b) for a, b in keys), *([] if expr is None else [column(expr)])]:
            condition = part if condition is None else condition & part
        right, hint = other.df, METHODS[method]
        if hint == "broadcast" and estimated_bytes(right) > BLOCK_BYTES:
            hint = None
        right = right.hint(hint) if hint else right
        joined = self.df.crossJoin(right) if condition is None else self.df.join(right, condition, how)
        return self._next(joined, "Join", f"{how}, {method}", other)

    def union(self, other: Query) -> Query:
        """All rows of both, repeats kept; both sides must have the same names and types in the same order."""
        if self.df.dtypes != other.df.dtypes:
            raise ValueError(f"schemas differ: {self.df.dtypes} and {other.df.dtypes}")
        return self._next(self.df.unionAll(other.df), "UnionAll", "", other)

    def group_by(self, keys: Mapping[str, str] | list[str], **aggregates: Aggregate | Fold) -> Query:
        """One row for each value of the keys, which may be expressions. Constant keys give one row, or none if there is
        no input."""
        keys = {k: k for k in keys} if isinstance(keys, list) else dict(keys)
        df = self.df.withColumns({f"_key_{k}": column(e, self.df) for k, e in keys.items()})
        grouped = df.groupBy(*(F.col(f"_key_{k}").alias(k) for k in keys)).agg(*(a.column().alias(n) for n, a in aggregates.items()))
        return self._next(grouped, "GroupBy", ", ".join(keys))

    def having(self, expr) -> Query:
        return self.where(expr)

    def order(self, *keys: str, ascending: bool | list[bool] = True) -> Query:
        return self._next(self.df.orderBy(*keys, ascending=ascending), "Sort", ", ".join(keys))

    def limit(self, n: int) -> Query:
        return self._next(self.df.limit(n), "Limit", str(n))

    def top(self, n: int, key: str, *ties: str) -> Query:
        """The n rows with the largest key; ties by other columns, so that the result is one and the same."""
        return self._next(self.df.orderBy(F.desc(key), *ties).limit(n), "TopK", f"{n} by {key}")

    def top_ranks(self, n: int, key: str, by: list[str] | None = None) -> Query:
        """Rows whose rank by descending key, within the groups `by`, is n at most; ties share a rank and all stay."""
        from pyspark.sql import Window

        rank = F.rank().over(Window.partitionBy(*(by or [])).orderBy(F.desc(key)))
        return self._next(self.df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank"), "TopRanks", f"{n} by {key}")

    def sample(self, factor: float, seed: int = 12345, by: list[str] | None = None) -> Query:
        """About one of `factor` rows: drawn by the generator, or by a hash of the columns `by`, the same in every run."""
        if by is None:
            return self._next(self.df.sample(1.0 / factor, seed=seed), "Sample", str(factor))
        return self._next(self.df.where(drawn(seed, by, 1.0 / factor)), "Sample", str(factor))

    def map_batches(self, function: Callable[[Iterator], Iterator], schema: str) -> Query:
        """Rows through a Python function over iterators of Arrow batches: for what no expression says. The optimizer
        sees nothing of it."""
        return self._next(self.df.mapInArrow(function, schema), "MapBatches", schema)

    # ---- introspection and execution

    def relations(self) -> list[str]:
        return [n.detail for n in self.node.walk() if n.kind == "TableScan"]

    def joins(self) -> list[Node]:
        return [n for n in self.node.walk() if n.kind == "Join"]

    def operators(self) -> list[str]:
        return [n.kind for n in self.node.walk()]

    def explain(self) -> str:
        """The operators of this query; physical() has Spark's plan."""
        return "\n".join(self.node.lines())

    def physical(self) -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def cardinality(self, estimate: bool = True, factor: float = 10.0, seed: int = 12345) -> float:
        """The number of rows, or an estimate of it: rows of a sample times its factor."""
        return self.df.sample(1.0 / factor, seed=seed).count() * factor if estimate else self.df.count()

    def cost(self) -> dict[str, float]:
        """The optimizer's estimates, without running anything: bytes of the result, and rows where statistics tell."""
        stats = self.df._jdf.queryExecution().optimizedPlan().stats()
        rows = stats.rowCount()
        return {"bytes": float(stats.sizeInBytes())} | ({"rows": float(rows.get())} if rows.isDefined() else {})

    def selectivity(self, expr, factor: float = 10.0, seed: int = 12345) -> float:
        """The share of rows for which a predicate is true, on a sample; 0 for no rows."""
        hit = self.df.sample(1.0 / factor, seed=seed).select(F.avg(F.coalesce(column(expr, self.df), F.lit(False)).cast("int"))).first()[0]
        return float(hit or 0)

    def finalize(self) -> DataFrame:
        return self.df


