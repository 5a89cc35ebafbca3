"""The analytical questions: reports on parts, customers, nations and segments, and the decision-support queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import read_parquet

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read_parquet(spark, sf_dir, n) for n in names]


def net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def money(of: Column, digits: int = 3) -> Column:
    return F.round(F.sum(of), digits)


def partsupp(lines: DataFrame) -> DataFrame:
    """The relation of parts and suppliers, which the tables lack: the pairs that lines have, with the least quantity
    as availability and the least price of a piece as supply cost."""
    return lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.min("l_quantity").alias("ps_availqty"), F.min(F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)).alias("ps_supplycost"))


_PS = "WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_quantity) AS ps_availqty, min(round(l_extendedprice / l_quantity, 2)) AS ps_supplycost FROM lineitem GROUP BY 1, 2) "

# ---- reports


@query("SELECT l_partkey, p_name, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL ORDER BY quantity DESC, l_partkey LIMIT 10")
def returned_parts(spark, sf_dir):
    """The ten parts that are returned most. The sums form before the join."""
    lines, part = tables(spark, sf_dir, "lineitem", "part")
    sums = lines.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return sums.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select("l_partkey", "p_name", "quantity").orderBy(F.desc("quantity"), "l_partkey").limit(10)


def _gaps(spark, sf_dir, gap: Column) -> DataFrame:
    lines, orders, customer = tables(spark, sf_dir, "lineitem", "orders", "customer")
    waits = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum(gap).alias("s"), F.count(F.lit(1)).alias("n"))
    return waits.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", (F.col("s") / F.col("n")).alias("avg_gap")).orderBy(F.desc("avg_gap"), "c_custkey").limit(10)


def _gap_sql(gap: str) -> str:
    return f"SELECT c_custkey, c_name, sum({gap})::DOUBLE / count(*) AS avg_gap FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey GROUP BY ALL ORDER BY avg_gap DESC, c_custkey LIMIT 10"


@query(_gap_sql("year(l_shipdate) - year(o_orderdate)"))
def waiting_customers_years(spark, sf_dir):
    """The ten customers that wait longest, in differences of years. The tables have no receipt date; the wait is that
    from order to shipping."""
    return _gaps(spark, sf_dir, F.year("l_shipdate") - F.year("o_orderdate"))


@query(_gap_sql("date_diff('day', o_orderdate::DATE, l_shipdate::DATE)"))
def waiting_customers_days(spark, sf_dir):
    return _gaps(spark, sf_dir, F.date_diff("l_shipdate", "o_orderdate"))


@query(
    """WITH s AS (SELECT n_nationkey, n_name, p_partkey, p_name, sum(l_quantity) AS quantity FROM lineitem, orders, customer, nation, part
  WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND l_partkey = p_partkey GROUP BY ALL)
SELECT * FROM s QUALIFY rank() OVER (PARTITION BY n_nationkey ORDER BY quantity DESC) = 1"""
)
def favourite_parts(spark, sf_dir):
    """The part that each nation orders most, ties kept."""
    lines, orders, customer, nation, part = tables(spark, sf_dir, "lineitem", "orders", "customer", "nation", "part")
    owners = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sums = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    best = sums.withColumn("r", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("quantity")))).where("r = 1")
    named = best.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return named.select("n_nationkey", "n_name", "p_partkey", "p_name", "quantity").orderBy("n_nationkey", "p_partkey")


@query(
    """WITH top AS (SELECT c_nationkey AS ck, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 QUALIFY rank() OVER (ORDER BY round(sum(o_totalprice), 2) DESC) <= 5),
v AS (SELECT c_nationkey AS ck, s_nationkey AS sk, round(sum(p_retailprice), 2) AS value FROM lineitem, orders, customer, supplier, part
  WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND l_partkey = p_partkey AND c_nationkey IN (SELECT ck FROM top) GROUP BY 1, 2)
SELECT c.n_name AS customers, s.n_name AS suppliers, value FROM v JOIN nation c ON ck = c.n_nationkey JOIN nation s ON sk = s.n_nationkey QUALIFY rank() OVER (PARTITION BY ck ORDER BY value DESC) <= 5"""
)
def trading_nations(spark, sf_dir):
    """The five nations whose customers order most, and for each the five nations whose suppliers sell it most, by the
    retail prices of parts. Ties share a rank."""
    lines, orders, customer, supplier, part, nation = tables(spark, sf_dir, "lineitem", "orders", "customer", "supplier", "part", "nation")
    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_nationkey")
    totals = owned.groupBy("c_nationkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    top = totals.withColumn("r", F.rank().over(Window.orderBy(F.desc("total")))).where("r <= 5").select("c_nationkey")
    sold = lines.join(owned.join(top, "c_nationkey", "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    value = sold.groupBy("c_nationkey", "s_nationkey").agg(F.round(F.sum("p_retailprice"), 2).alias("value"))
    best = value.withColumn("r", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("value")))).where("r <= 5")
    a = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customers"))
    b = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("suppliers"))
    return best.join(a, "c_nationkey").join(b, "s_nationkey").select("customers", "suppliers", "value").orderBy("customers", F.desc("value"), "suppliers")


@query(
    """WITH y AS (SELECT c_mktsegment, year(o_orderdate)::INTEGER AS y, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), m AS (SELECT max(y) AS y FROM y)
SELECT a.c_mktsegment, b.n AS before, a.n AS last, b.n - a.n AS decrease FROM y a JOIN y b ON a.c_mktsegment = b.c_mktsegment, m WHERE a.y = m.y AND b.y = m.y - 1 AND b.n > a.n"""
)
def shrinking_segments(spark, sf_dir):
    """Market segments with fewer orders in the last year than in the one before."""
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    by_customer = orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    years = by_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "y").agg(F.sum("n").alias("n"))
    years = years.withColumn("m", F.max("y").over(Window.partitionBy(F.lit(0))))
    out = years.groupBy("c_mktsegment").agg(F.sum(F.when(F.col("y") == F.col("m") - 1, F.col("n"))).alias("before"), F.sum(F.when(F.col("y") == F.col("m"), F.col("n"))).alias("last"))
    return out.withColumn("decrease", F.col("before") - F.col("last")).where("decrease > 0").orderBy("c_mktsegment")


# ---- queries of the builder


@query(_PS + "SELECT p_name, s_name FROM part, supplier, ps WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND ps_availqty = 1 UNION ALL SELECT p_name, s_name FROM part, supplier, ps WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND ps_supplycost < 5")
def scarce_or_cheap_parts(spark, sf_dir):
    lines, part, supplier = tables(spark, sf_dir, "lineitem", "part", "supplier")
    both = partsupp(lines).join(part, F.col("p_partkey") == F.col("ps_partkey")).join(supplier, F.col("s_suppkey") == F.col("ps_suppkey"))
    return both.where("ps_availqty = 1").select("p_name", "s_name").unionAll(both.where("ps_supplycost < 5").select("p_name", "s_name"))


@query("SELECT p_name, count(*)::BIGINT AS count FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY p_name")
def returned_names(spark, sf_dir):
    lines, part = tables(spark, sf_dir, "lineitem", "part")
    counts = lines.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name").agg(F.sum("n").alias("count"))


@query("WITH t AS (SELECT n_name, p_name, sum(l_quantity) AS num FROM customer, nation, orders, lineitem, part WHERE c_nationkey = n_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey GROUP BY ALL) SELECT n_name, max(num) AS most FROM t GROUP BY n_name")
def most_of_a_name(spark, sf_dir):
    lines, orders, customer, nation, part = tables(spark, sf_dir, "lineitem", "orders", "customer", "nation", "part")
    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sums = lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    named = sums.join(part, F.col("l_partkey") == F.col("p_partkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name", "p_name").agg(F.sum("q").alias("num")).groupBy("n_name").agg(F.max("num").alias("most"))


# ---- decision support


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 3) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 3) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 3) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 3) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS count_order FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    (lines,) = tables(spark, sf_dir, "lineitem")
    out = lines.where("l_shipdate <= date '2001-09-02'").groupBy("l_returnflag", "l_linestatus")
    return out.agg(F.sum("l_quantity").alias("sum_qty"), money(F.col("l_extendedprice")).alias("sum_base"), money(net()).alias("sum_disc"), money(net() * (1 + F.col("l_tax"))).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 3).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order")).orderBy("l_returnflag", "l_linestatus")


@query("SELECT l_orderkey, o_orderdate::DATE AS o_orderdate, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate::DATE > DATE '1998-03-15' GROUP BY ALL")
def shipping_priority(spark, sf_dir):
    lines, orders, customer = tables(spark, sf_dir, "lineitem", "orders", "customer")
    mine = orders.where("o_orderdate < date '1998-03-15'").join(customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return lines.where("l_shipdate > date '1998-03-15'").join(mine, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate", "o_orderpriority").agg(money(net(), 4).alias("revenue"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 3) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name")
def local_supplier_volume(spark, sf_dir):
    lines, orders, customer, supplier, nation, region = tables(spark, sf_dir, "lineitem", "orders", "customer", "supplier", "nation", "region")
    asia = nation.join(region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    sellers = supplier.join(asia, F.col("s_nationkey") == F.col("n_nationkey"))
    bought = orders.where("o_orderdate >= date '1996-01-01' AND o_orderdate < date '1997-01-01'").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return sold.groupBy("n_name").agg(money(net()).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 3) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND round(l_discount, 2) BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def forecast_revenue(spark, sf_dir):
    (lines,) = tables(spark, sf_dir, "lineitem")
    kept = lines.where("l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' AND l_quantity < 24").where(F.round("l_discount", 2).between(0.05, 0.07))
    return kept.agg(money(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 3) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'")
def promotion_revenue(spark, sf_dir):
    lines, part = tables(spark, sf_dir, "lineitem", "part")
    kept = lines.where("l_shipdate >= date '1996-09-01' AND l_shipdate < date '1996-10-01'").join(part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return kept.agg(money(net()).alias("promo"))


@query("SELECT c_custkey, c_name, c_acctbal, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY ALL")
def returned_items(spark, sf_dir):
    lines, orders, customer, nation = tables(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    mine = orders.where("o_orderdate >= date '1996-10-01' AND o_orderdate < date '1997-01-01'").select("o_orderkey", "o_custkey")
    sums = lines.where("l_returnflag = 'R'").join(mine, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(money(net(), 4).alias("revenue"))
    named = sums.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("c_custkey", "c_name", "c_acctbal", "n_name", "revenue")


@query("SELECT c_name, c_custkey, o_orderkey, o_orderdate::DATE AS o_orderdate, o_totalprice, sum(l_quantity) AS quantity FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 220) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY ALL")
def large_orders(spark, sf_dir):
    """One aggregate of lines gives both the orders that count and their quantities."""
    lines, orders, customer = tables(spark, sf_dir, "lineitem", "orders", "customer")
    big = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")).where("quantity > 220")
    named = big.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return named.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "quantity")


@query("SELECT c_nationkey AS code, count(*)::BIGINT AS customers, round(sum(c_acctbal), 3) AS balance FROM customer WHERE c_nationkey IN (1, 3, 7, 11, 13, 17, 23) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (1, 3, 7, 11, 13, 17, 23)) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY 1")
def sales_opportunity(spark, sf_dir):
    """Customers above the mean balance without a large order, by nation: the tables have neither telephone numbers nor
    customers without any order."""
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    some = customer.where(F.col("c_nationkey").isin(1, 3, 7, 11, 13, 17, 23))
    level = some.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("level"))
    rich = some.join(F.broadcast(level), F.col("c_acctbal") > F.col("level"))  # one row
    idle = rich.join(orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return idle.groupBy(F.col("c_nationkey").alias("code")).agg(F.count(F.lit(1)).alias("customers"), money(F.col("c_acctbal")).alias("balance"))
