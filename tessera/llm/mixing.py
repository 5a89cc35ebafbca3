"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of shuffled documents, passed through at most twice. A document's virtual finish time is its
source's words up to and including it, divided by the source's target. All documents and passes are range-sorted by that
time over the cluster and cut where the budget is used up; what is left, in that order, is the mix.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, stash

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
PASSES = 2
#: Ranges of the shuffled order whose sums are taken first, so that no task walks a whole source.
RANGES = 4096
#: Columns of a document in its queue, and of an item of the mix: a document in one pass.
_ORDER = ("time", "source_key", "pass", "place", "doc_id", "size")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of the MD5 of the seed, the id and the text's MD5: the shuffled order, the same in every run. Rows without
    an id, or of one id, have places of their own if their texts differ."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """(source_key, source, source_size, target) from (source_key, source, source_size), one row per source.

    Sources by code point, null last, get the weights in turn and share budget * all sizes; what exceeds passes times a
    source's size is shared again by weight. The level is found on the sources in order of size over weight. The windows
    here run over sources, not rows, in one task: about 100 bytes for each source, so some ten million sources.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("total", F.sum("source_size").over(everything)).withColumn("cap", F.col("source_size") * passes)
    by = Window.orderBy(F.col("cap") / F.col("w"), "source_key")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(budget)) * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("rank", F.row_number().over(by)).withColumn("level", level)
    s = s.withColumn("first", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("rank"))).over(everything))
    s = s.withColumn("common", F.max(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first")), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("w"))
    return s.select("source_key", "source", "source_size", target.alias("target"))


def _running(batches):
    """Rows of a sorted partition with its number and the sum of their sizes (the last column) so far."""
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        ends = total + np.cumsum(b.column(b.num_columns - 1).to_numpy())
        total = int(ends[-1]) if len(ends) else total
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(ends, pa.int64())], [*b.schema.names, "part", "run"])


def _items(docs: DataFrame, seed: str, weights, budget: float) -> tuple[DataFrame, DataFrame]:
    """(queued, items): every document with its target and its words in the queue up to it; and of every document and pass
    that the mix takes something of, besides its key: time, taken and end, the words of the mix up to it."""
    source = F.col("source").cast("string")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    sized = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), words_in(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text"), seed).alias("place"), key.alias("source_key")), "sized")
    part = F.shiftright("place", 48).cast("int")
    assert RANGES == 1 << 12
    sums = sized.groupBy("source_key", part.alias("part")).agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    sources = targets(sums.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights, budget)
    starts = sums.select("source_key", "part", (F.sum("words").over(Window.partitionBy("source_key").orderBy("part")) - F.col("words")).alias("base"))
    starts = starts.join(sources.drop("source"), "source_key")
    inside = Window.partitionBy("source_key", "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("part", part).join(starts, ["source_key", "part"])
    queued = stash(queued.withColumn("upto", F.col("base") + F.sum("size").over(inside)).drop("base", "part"), "queued")

    both = queued.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
    time = (F.col("upto") + F.col("pass") * F.col("source_size")).cast("double") / F.col("target")
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    line = both.select("upto", time.alias("time"), "source_key", "pass", "place", "doc_id", "size").repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    line = stash(line.mapInArrow(_running, "upto long, time double, source_key string, pass int, place long, doc_id long, size long, part int, run long"), "sorted")
    # One row for each partition.
    before = line.groupBy("part").agg(F.sum("size").alias("words"))
    before = before.select("part", (F.sum("words").over(Window.orderBy("part")) - F.col("words")).alias("before"))
    left = math.floor(budget * (sized.agg(F.sum("size")).first()[0] or 0))
    end = F.col("before") + F.col("run")
    items = line.join(before, "part").withColumn("end", end).withColumn("taken", F.least("size", F.lit(left) - F.col("end") + F.col("size")))
    return queued, items.where("taken > 0").select(*_ORDER, "upto", "taken", F.least("end", F.lit(left)).alias("end"))


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """(doc_id, source, size, source_size, target, finish, first, second): a document's virtual finish time in its first
    pass, null if it has no words, and how many words of its first and of its second pass the mix takes from it.

    A null text has no words, nothing of it is taken. Rows that repeat are documents of their own, ties in the shuffled
    order go by id and size. An empty table gives an empty one. The cut may fall inside one document, which is then
    taken in part. Columns besides doc_id, text and source are ignored.
    """
    queued, items = _items(docs, seed, weights, budget)
    taken = lambda turn: F.sum(F.when(F.col("pass") == turn, F.col("taken")).otherwise(0)).alias(("first", "second")[turn])
    # Of one source, documents with words differ in the words up to them.
    plan = items.groupBy(F.col("source_key").alias("_key"), F.col("upto").alias("_upto")).agg(taken(0), taken(1))
    some = F.col("size") > 0
    rows = queued.join(plan, (F.col("source_key") == F.col("_key")) & (F.col("upto") == F.col("_upto")) & some, "left")
    finish = F.when(some & (F.col("target") > 0), F.col("upto").cast("double") / F.col("target"))
    return rows.select("doc_id", "source", "size", "source_size", "target", finish.alias("finish"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("first", "second")))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix with the columns of docs, in the order of their virtual finish times: one row for each
    pass that takes words of a document, cut to those words where it takes only some.

    Rows that repeat are documents of their own; null texts have no words and aren't taken, null ids and sources are. An
    empty table gives an empty one. All columns of docs stay as they are, but for the text that the cut falls in.
    """
    _, items = _items(docs, seed, WEIGHTS, BUDGET)
    # Ids are never null here, since places tell rows without one apart: one shuffle of the texts does for numbers and join.
    same = ["id", "size", "source_key", "place"]
    never_null = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id")
    # Equal rows are told apart by number, each in all its passes.
    alike = Window.partitionBy(*same, "pass").orderBy("upto")
    plan = items.select("*", never_null).withColumn("number", F.row_number().over(alike)).select(*same, "number", "taken", "end").alias("plan")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), F.col("text").alias("text"), never_null, words_in(F.col("text")).alias("size"), key.alias("source_key"), place(F.col("doc_id"), F.col("text"), seed).alias("place"))
    rows = rows.where("size > 0").withColumn("number", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))).alias("rows")
    on = [*(F.col(f"rows.{c}") == F.col(f"plan.{c}") for c in same), F.col("rows.number") - F.col("plan.number") == 0]
    out = rows.join(plan, on).select("rows.row", "rows.text", "rows.size", "plan.taken", "plan.end")
    # The words up to a document say where it belongs: equal shares of the mix, in order, without a sample.
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = max(1, -(-(items.agg(F.max("end")).first()[0] or 0) // parts))
    out = out.withColumn("share", F.floor((F.col("end") - 1) / share).cast("int")).repartitionById(parts, "share").sortWithinPartitions("end")
    first_words = F.array_join(F.slice(F.filter(F.split("text", f"[{SPACE}]+"), lambda x: x != ""), F.lit(1), F.col("taken").cast("int")), " ")
    text = F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(first_words)
    return out.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
