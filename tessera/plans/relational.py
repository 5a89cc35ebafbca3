"""One query for each operator, source and expression of the engine."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.aggregates import Fold, count, greatest, least, mean, total
from tessera.operators.builder import Query
from tessera.schema import Schema
from tessera.sources.catalog import Database
from tessera.sources.layout import Materialized, analyze
from tessera.sources.tables import load, read_parquet, read_random, read_text, write_text
from tessera.types import date_number, date_of_number

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> Query:
    return Query.of(read_parquet(spark, sf_dir, name), name)


def employees(spark: SparkSession) -> Query:
    """Twenty employees of two departments."""
    return Query.of(spark.range(20).select(F.col("id").cast("int").alias("id"), (F.col("id") * 2 + 20).cast("int").alias("age"), (F.col("id") % 2).cast("int").alias("dept_id")), "employee")


def renamed(q: Query) -> Query:
    return q.rename({"id": "id2", "age": "age2", "dept_id": "dept_id2"})


_E = "WITH e AS (SELECT range::INTEGER AS id, (range * 2 + 20)::INTEGER AS age, (range % 2)::INTEGER AS dept_id FROM range(20)), f AS (SELECT id AS id2, age AS age2, dept_id AS dept_id2 FROM e) "

# ---- scans, filters, projections


@query(_E + "SELECT * FROM e")
def scan(spark, sf_dir):
    return employees(spark).finalize()


@query("SELECT * EXCLUDE (l_shipdate), l_shipdate::DATE AS l_shipdate FROM lineitem")
def full_scan(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").finalize()


@query(_E + "SELECT * FROM e WHERE age < 30")
def select_where(spark, sf_dir):
    return employees(spark).where("age < 30").finalize()


@query(_E + "SELECT id FROM e")
def project(spark, sf_dir):
    return employees(spark).select({"id": ("id", "int")}).finalize()


@query("SELECT l_orderkey AS okey, round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) AS flag FROM lineitem")
def project_computed(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select({"okey": "l_orderkey", "net": "l_extendedprice * (1 - l_discount)", "flag": ("l_returnflag.upper()", "char(1)")})
    return q.finalize().withColumn("net", F.round("net", 4))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_orderkey == 7").select({c: c for c in ("l_orderkey", "l_linenumber", "l_quantity")}).finalize()


@query("SELECT l_orderkey, l_shipdate::DATE AS l_shipdate, l_quantity FROM lineitem WHERE l_shipdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-01-31'")
def range_scan(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").where("'1996-01-01' <= l_shipdate <= '1996-01-31'")
    return q.select({c: c for c in ("l_orderkey", "l_shipdate", "l_quantity")}).finalize()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R' AND l_discount > 0.05")
def conjunctive_filter(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").where("l_quantity < 5 and l_returnflag == 'R' and l_discount > 0.05")
    return q.select({"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"}).finalize()


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice > 200000) OR o_orderpriority = '1-URGENT'")
def disjunctive_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("(o_orderstatus == 'O' and o_totalprice > 200000) or o_orderpriority == '1-URGENT'").select({"o_orderkey": "o_orderkey"}).finalize()


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def in_lists(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (1, 2, 3)").select({"c_custkey": "c_custkey", "c_name": "c_name"}).finalize()


@query("SELECT o_orderkey, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::INTEGER AS number, o_orderdate::DATE AS day, year(o_orderdate)::INTEGER AS year FROM orders")
def dates(spark, sf_dir):
    df = read_parquet(spark, sf_dir, "orders").withColumn("number", date_number(F.col("o_orderdate")))
    return df.select("o_orderkey", "number", date_of_number(F.col("number")).alias("day"), F.year("o_orderdate").alias("year"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey - 50 - 7 * floor((l_partkey - 50) / 7.0)::BIGINT AS fmod, floor((50 - l_partkey) / 7.0)::BIGINT AS fdiv, pow(l_linenumber, 2)::DOUBLE AS square, l_linenumber / 2.0::DOUBLE AS half,
  CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS size, (l_orderkey & 7)::BIGINT AS low, (l_orderkey | 8)::BIGINT AS high, xor(l_orderkey, 5)::BIGINT AS flip, (~l_orderkey)::BIGINT AS inverse, (l_orderkey << 2)::BIGINT AS up, (l_orderkey >> 1)::BIGINT AS down,
  abs(l_partkey - 50)::BIGINT AS distance, least(l_partkey, l_suppkey)::BIGINT AS small, greatest(l_partkey, l_suppkey)::BIGINT AS large, l_quantity::DOUBLE AS q, trunc(l_extendedprice)::BIGINT AS whole, l_orderkey::VARCHAR AS name FROM lineitem"""
)
def arithmetic(spark, sf_dir):
    exprs = {
        "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "fmod": "(l_partkey - 50) % 7", "fdiv": "(50 - l_partkey) // 7", "square": "l_linenumber ** 2", "half": "l_linenumber / 2", "size": "'many' if l_quantity > 25 else 'few'", "low": "l_orderkey & 7", "high": "l_orderkey | 8",
        "flip": "l_orderkey ^ 5", "inverse": "~l_orderkey", "up": "l_orderkey << 2", "down": "l_orderkey >> 1", "distance": "abs(l_partkey - 50)", "small": "min(l_partkey, l_suppkey)", "large": "max(l_partkey, l_suppkey)", "q": "float(l_quantity)", "whole": "int(l_extendedprice)", "name": "str(l_orderkey)",
    }
    return table(spark, sf_dir, "lineitem").select(exprs).finalize()


@query(
    """SELECT p_partkey, p_name[1:3] AS head, right(p_name, 4) AS tail, p_name[2:2] AS second, length(p_name)::INTEGER AS n, upper(p_name) AS up, replace(p_name, 'a', '*') AS starred, starts_with(p_name, 'b') AS with_b, contains(p_type, 'A') AS has_a, p_brand || '!' AS loud,
  not (p_size > 10 and p_size <= 40) AS outside, sqrt(p_size)::DOUBLE AS root FROM part"""
)
def text_expressions(spark, sf_dir):
    exprs = {"p_partkey": "p_partkey", "head": "p_name[:3]", "tail": "p_name[-4:]", "second": "p_name[1]", "n": "len(p_name)", "up": "p_name.upper()", "starred": "p_name.replace('a', '*')", "with_b": "p_name.startswith('b')", "has_a": "'A' in p_type", "loud": "p_brand + '!'", "outside": "not (10 < p_size <= 40)", "root": "math.sqrt(p_size)"}
    return table(spark, sf_dir, "part").select(exprs).finalize()


# ---- joins


@query(_E + "SELECT * FROM e JOIN f ON id = id2")
def join_nested_loops(spark, sf_dir):
    e = employees(spark)
    return e.join(renamed(e), expr="id == id2", method="nested-loops").finalize()


@query(_E + "SELECT * FROM e JOIN f ON id <= id2")
def join_block_nested_loops_theta(spark, sf_dir):
    e = employees(spark)
    return e.join(renamed(e), expr="id <= id2", method="block-nested-loops").finalize()


@query(_E + "SELECT * FROM e JOIN f ON age = age2 WHERE id + id2 < 30")
def join_indexed_residual(spark, sf_dir):
    e = employees(spark)
    return e.join(renamed(e), on=[("age", "age2")], expr="id + id2 < 30", method="indexed").finalize()


@query(_E + "SELECT * FROM e JOIN f ON id = id2 AND dept_id = dept_id2")
def join_hash_composite(spark, sf_dir):
    e = employees(spark)
    return e.join(renamed(e), on=[("id", "id2"), ("dept_id", "dept_id2")], method="hash").finalize()


def _orders_lines(spark, sf_dir, method):
    o = table(spark, sf_dir, "orders").select({"o_orderkey": "o_orderkey", "o_custkey": "o_custkey"})
    ln = table(spark, sf_dir, "lineitem").select({"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_quantity": "l_quantity"})
    return o.join(ln, on=[("o_orderkey", "l_orderkey")], method=method).finalize()


_OL = "SELECT o_orderkey, o_custkey, l_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(_OL)
def join_hash(spark, sf_dir):
    return _orders_lines(spark, sf_dir, "hash")


@query(_OL)
def join_merge(spark, sf_dir):
    return _orders_lines(spark, sf_dir, "merge")


@query(_OL)
def join_optimizer_choice(spark, sf_dir):
    return _orders_lines(spark, sf_dir, "auto")


@query("SELECT n_name, r_name FROM nation, region")
def join_cartesian(spark, sf_dir):
    n, r = (table(spark, sf_dir, t).select({c: c}) for t, c in (("nation", "n_name"), ("region", "r_name")))
    return n.join(r).finalize()


@query("SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey")
def join_multiway(spark, sf_dir):
    q = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), on=[("c_nationkey", "n_nationkey")]).join(table(spark, sf_dir, "region"), on=[("n_regionkey", "r_regionkey")])
    return q.select({c: c for c in ("c_custkey", "n_name", "r_name")}).finalize()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def join_semi(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select({"l_orderkey": "l_orderkey"})
    return table(spark, sf_dir, "orders").join(big, on=[("o_orderkey", "l_orderkey")], how="left_semi").select({"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"}).finalize()


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select({"l_orderkey": "l_orderkey"})
    return table(spark, sf_dir, "orders").join(lines, on=[("o_orderkey", "l_orderkey")], how="left_anti").select({"o_orderkey": "o_orderkey"}).finalize()


# ---- groups


@query(_E + "SELECT id % 2 AS id, min(age) AS lowest, max(age) AS highest FROM e GROUP BY id % 2")
def group_by_expression(spark, sf_dir):
    return employees(spark).group_by({"id": "id % 2"}, lowest=least("age"), highest=greatest("age")).select({"id": ("id", "int"), "lowest": "lowest", "highest": "highest"}).finalize()


@query(_E + "SELECT dept_id, sum(age * age)::INTEGER AS squares FROM e GROUP BY dept_id")
def group_by_fold(spark, sf_dir):
    return employees(spark).group_by(["dept_id"], squares=Fold("age", F.lit(0), lambda acc, x: acc + x * x)).finalize()


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(avg(l_extendedprice), 3) AS price, min(l_discount) + 0.0 AS lowest, max(l_tax) AS highest, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def group_by_builtin(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").group_by(["l_returnflag", "l_linestatus"], quantity=total("l_quantity"), price=mean("l_extendedprice"), lowest=least("l_discount"), highest=greatest("l_tax"), n=count())
    return q.finalize().withColumn("price", F.round("price", 3)).withColumn("lowest", F.col("lowest") + 0.0)


@query("SELECT 0 AS att, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM lineitem HAVING count(*) > 0")
def global_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").group_by({"att": "0"}, n=count(), quantity=total("l_quantity")).finalize()


@query("SELECT 0 AS att, count(*)::BIGINT AS n FROM lineitem WHERE l_quantity > 1000 HAVING count(*) > 0")
def global_aggregate_of_nothing(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 1000").group_by({"att": "0"}, n=count()).finalize()


@query("SELECT count(*)::BIGINT AS n, max(o_totalprice) AS most FROM orders")
def scalar_aggregate(spark, sf_dir):
    return read_parquet(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))


@query("SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200")
def group_having(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").group_by(["l_orderkey"], quantity=total("l_quantity")).having("quantity > 200").finalize()


@query("SELECT l_suppkey, max(quantity) AS most FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def group_of_groups(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").group_by(["l_suppkey", "l_partkey"], quantity=total("l_quantity")).group_by(["l_suppkey"], most=greatest("quantity")).finalize()


@query("SELECT o_custkey, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def eager_aggregate(spark, sf_dir):
    """The sums below the join: lines shrink to one row for each order first."""
    lines = table(spark, sf_dir, "lineitem").group_by(["l_orderkey"], part=total("l_quantity"))
    return table(spark, sf_dir, "orders").join(lines, on=[("o_orderkey", "l_orderkey")]).group_by(["o_custkey"], quantity=total("part")).finalize()


@query("SELECT p_brand, any_value(b) AS brand_again, count(*)::BIGINT AS n FROM (SELECT p_brand, p_brand AS b FROM part) GROUP BY p_brand")
def group_bare_column(spark, sf_dir):
    return read_parquet(spark, sf_dir, "part").groupBy("p_brand").agg(F.any_value("p_brand").alias("brand_again"), F.count(F.lit(1)).alias("n"))


# ---- order, limits, ranks, sets


@query(_E + "SELECT id, age FROM e ORDER BY age DESC")
def sort_descending(spark, sf_dir):
    return employees(spark).select({"id": "id", "age": "age"}).order("age", ascending=False).finalize()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select({"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"}).top(10, "o_totalprice", "o_orderkey").finalize()


@query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) <= 2")
def top_ranks_with_ties(spark, sf_dir):
    return table(spark, sf_dir, "part").select({"p_brand": "p_brand", "p_partkey": "p_partkey", "p_size": "p_size"}).top_ranks(2, "p_size", ["p_brand"]).finalize()


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def sort_multi_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select({c: c for c in ("c_custkey", "c_nationkey", "c_acctbal")}).order("c_nationkey", "c_acctbal", "c_custkey", ascending=[True, False, True]).finalize()


@query(_E + "SELECT * FROM e UNION ALL SELECT * FROM e")
def union_all(spark, sf_dir):
    return employees(spark).union(employees(spark)).finalize()


@query("SELECT c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal < 0")
def union_filtered(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select({"name": "c_name", "bal": "c_acctbal"})
    return c.union(table(spark, sf_dir, "supplier").select({"name": "s_name", "bal": "s_acctbal"})).where("bal < 0").select({"name": "name"}).finalize()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE ('0x' || substr(md5('12345:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT < 429496729")
def sampled_scan(spark, sf_dir):
    """About a tenth of the rows, drawn by a hash of the key."""
    return table(spark, sf_dir, "lineitem").select({"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"}).sample(10, by=["l_orderkey", "l_linenumber"]).finalize()


def _database(spark: SparkSession) -> Database:
    """A database of its own for each call: what these queries store is gone when they are done, or with the session."""
    return Database(spark, f"tessera_{uuid.uuid4().hex[:8]}")


_PART = Schema.of("part", [("p_partkey", "double"), ("p_name", "char(55)"), ("p_size", "int")])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1996")
def view_and_rest(spark, sf_dir):
    """A materialized view that covers a part of the question, and the base for the rest."""
    orders, views = read_parquet(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), Materialized(_database(spark))
    views.create("early", orders.where("o_orderdate < date '1996-07-01'"))
    rest = orders.where("o_orderdate >= date '1996-07-01' and o_orderdate < date '1997-01-01'")
    return views.covering("early", "o_orderdate >= date '1996-01-01'", rest).select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, rank() OVER (ORDER BY s_acctbal DESC)::INTEGER AS place FROM supplier")
def rank_all(spark, sf_dir):
    return read_parquet(spark, sf_dir, "supplier").select("s_suppkey", F.rank().over(Window.orderBy(F.desc("s_acctbal"))).alias("place"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def semi_join_of_keys(spark, sf_dir):
    """Rows of a set of keys by a semi join."""
    keys = table(spark, sf_dir, "customer").where("c_custkey % 5 == 0").select({"c_custkey": "c_custkey"})
    return table(spark, sf_dir, "orders").join(keys, on=[("o_custkey", "c_custkey")], how="left_semi").select({"o_orderkey": "o_orderkey", "o_custkey": "o_custkey"}).finalize()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE ('0x' || substr(md5('12345:' || o_custkey), 1, 8))::BIGINT < 858993459")
def random_reads(spark, sf_dir):
    """The random workload over a stored relation: the rows of a fifth of the customers."""
    db = _database(spark)
    read_parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").write.saveAsTable(f"{db.name}.orders")
    return read_random(db, "orders", "o_custkey", 0.2)


def _stored_parts(spark, sf_dir) -> Database:
    db = _database(spark)
    load(db, _PART, read_parquet(spark, sf_dir, "part").select(F.col("p_partkey").cast("double").alias("p_partkey"), "p_name", "p_size"))
    return db


@query("SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_size FROM part")
def loaded_relation(spark, sf_dir):
    """Bulk import into a declared relation, and its scan."""
    return _stored_parts(spark, sf_dir).table("part")


@query("SELECT p_partkey::DOUBLE AS p_partkey, p_name, CASE WHEN p_size < 10 THEN 0 ELSE p_size END::INTEGER AS p_size FROM part WHERE p_size <> 25")
def update_and_delete(spark, sf_dir):
    """Rows deleted by a key, and a field of others updated, in a stored relation."""
    db = _stored_parts(spark, sf_dir)
    db.delete("part", "p_size == 25")
    db.update("part", "p_size < 10", {"p_size": "0"})
    return db.table("part")


@query("SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_size FROM part UNION ALL SELECT -1, 'it''s new', 3 UNION ALL SELECT -2, '', 0")
def inserted_rows(spark, sf_dir):
    """Rows inserted into a stored relation; one is then cleared, which keeps the row."""
    db = _stored_parts(spark, sf_dir)
    db.insert("part", [(-1.0, "it's new", 3), (-2.0, "to be cleared", 9)])
    db.update("part", "p_partkey == -2", {"p_name": "''", "p_size": "0"})
    return db.table("part")


@query("SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_size FROM part WHERE p_partkey = 7")
def stored_lookup(spark, sf_dir):
    """A point lookup in a stored, analyzed relation."""
    db = _stored_parts(spark, sf_dir)
    analyze(db, "part")
    return db.lookup("part", p_partkey=7.0)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def separated_text(spark, sf_dir):
    """Separated text written, and read by a format of letters."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-text-{uuid.uuid4().hex[:8]}"
    write_text(read_parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return read_text(spark, path, ["n_nationkey", "n_name", "n_regionkey"], "isi")


@query("SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON (n_nationkey = s_nationkey AND n_regionkey = 1) OR (n_nationkey = s_nationkey AND s_acctbal < 0)")
def join_disjunction(spark, sf_dir):
    """A join on a disjunction with comparisons of columns: the optimizer takes out what both parts have."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    q = n.join(s, expr="(n_nationkey == s_nationkey and n_regionkey == 1) or (n_nationkey == s_nationkey and s_acctbal < 0)")
    return q.select({"n_nationkey": "n_nationkey", "s_suppkey": "s_suppkey"}).finalize()


@query("SELECT p_partkey, p_brand || p_type AS label, p_brand IS NOT NULL AS has_brand, (p_partkey * 9007199254740993 + 4) // 3 AS third, 7 - 10 * floor(7 / 10.0)::BIGINT AS rest FROM part WHERE p_partkey < 100")
def joined_texts(spark, sf_dir):
    """Texts joined by +, is not, and whole division beyond the range of doubles."""
    exprs = {"p_partkey": "p_partkey", "label": "p_brand + p_type", "has_brand": "p_brand is not None", "third": "(p_partkey * 9007199254740993 + 4) // 3", "rest": "int(7 % 10)"}
    return table(spark, sf_dir, "part").where("p_partkey < 100").select(exprs).finalize()
