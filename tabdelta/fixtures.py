"""Snapshot pairs derived from the order tables, by the same rules in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SHIFT = 10_000_000
_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_pair(spark: SparkSession, sf_dir: str, copies: bool = True) -> tuple[DataFrame, DataFrame]:
    """OLD and NEW of orders, all text, with __rid. With ``copies`` some rows stand twice in OLD."""
    o = table(spark, sf_dir, "orders").select(*_COLUMNS)
    k = F.col("o_orderkey")
    text = {c: F.col(c).cast("string") for c in _COLUMNS}
    old = o.select(*[x.alias(c) for c, x in text.items()], (k * 2).alias("__rid"))
    if copies:
        old = old.unionAll(o.where(k % 53 == 0).select(*[x.alias(c) for c, x in text.items()], (k * 2 + 1).alias("__rid")))
    price = F.when(k % 31 == 0, F.round(F.col("o_totalprice") + 1, 2)).otherwise(F.col("o_totalprice")).cast("string")
    new_text = dict(text)
    new_text["o_totalprice"] = F.when(k % 11 == 0, F.concat(price, F.lit("0"))).otherwise(price)
    new_text["o_orderstatus"] = F.when(k % 7 == 0, F.concat(F.lit("  "), F.lower("o_orderstatus"), F.lit(" "))).otherwise(F.col("o_orderstatus"))
    new_text["o_orderpriority"] = F.when(k % 41 == 0, F.lit("")).otherwise(F.col("o_orderpriority"))
    new = o.where(k % 97 != 0).select(*[x.alias(c) for c, x in new_text.items()], (k * 2).alias("__rid"))
    shifted = dict(text, o_orderkey=(k + SHIFT).cast("string"))
    new = new.unionAll(o.where(k % 89 == 0).select(*[x.alias(c) for c, x in shifted.items()], ((k + SHIFT) * 2).alias("__rid")))
    return old, new


ORDERS_SQL = f"""
old_rows AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority, o_orderkey * 2 AS rid FROM orders
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), o_orderpriority, o_orderkey * 2 + 1 FROM orders WHERE o_orderkey % 53 = 0
),
new_rows AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
    CASE WHEN o_orderkey % 7 = 0 THEN '  ' || lower(o_orderstatus) || ' ' ELSE o_orderstatus END AS o_orderstatus,
    CAST(CASE WHEN o_orderkey % 31 = 0 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS VARCHAR) || CASE WHEN o_orderkey % 11 = 0 THEN '0' ELSE '' END AS o_totalprice,
    CAST(o_orderdate AS VARCHAR) AS o_orderdate, CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority, o_orderkey * 2 AS rid
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT CAST(o_orderkey + {SHIFT} AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), o_orderpriority, (o_orderkey + {SHIFT}) * 2 FROM orders WHERE o_orderkey % 89 = 0
)"""


def lineitem_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of lineitem whose key repeats; the order is that of line, part, supplier and quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("l_quantity"), "l_returnflag")
    k = F.col("l_orderkey")
    rid = ((F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity")
    shown = ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    old = li.where(k % 19 != 0).select(*[F.col(c).cast("string").alias(c) for c in shown], rid.alias("__rid"))
    new = li.where(k % 23 != 0).select(k.cast("string").alias("l_orderkey"), F.col("l_partkey").cast("string").alias("l_partkey"), F.when(k % 13 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).cast("string").alias("l_quantity"), F.when(k % 5 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("l_returnflag"), rid.alias("__rid"))
    return old, new


LINEITEM_SQL = """
li AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS q, l_returnflag, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS rid FROM lineitem),
old_rows AS (SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(q AS VARCHAR) AS l_quantity, l_returnflag, rid FROM li WHERE l_orderkey % 19 <> 0),
new_rows AS (SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(CASE WHEN l_orderkey % 13 = 0 THEN q + 1 ELSE q END AS VARCHAR) AS l_quantity, CASE WHEN l_orderkey % 5 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag, rid FROM li WHERE l_orderkey % 23 <> 0)"""
