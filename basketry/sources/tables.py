"""Canonical retail tables over the parquet test tables.

``order_items`` and ``event_log`` have the shape of the two flat inputs (order lines and
clickstream events). Only the source tables that the asked-for columns need are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table, times read as UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def stamp(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> tuple:
    """The files of some tables by number, size and newest change: a new one where a table was written again."""
    files = spark.read.parquet(*[f"{sf_dir}/{n}.parquet" for n in names[:1]]).select("_metadata.*")
    for n in names[1:]:
        files = files.union(spark.read.parquet(f"{sf_dir}/{n}.parquet").select("_metadata.*"))
    per_file = files.select("file_path", "file_size", "file_modification_time").distinct()
    return tuple(per_file.agg(F.count("*"), F.sum("file_size"), F.max("file_modification_time")).first())


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute an input that reads as fewer tasks than there are cores.

    Only a small or single-file table is affected; a large one already splits well and is
    left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _days(n: Column) -> Column:
    return F.make_dt_interval(n)


# column -> (tables it needs beside lineitem, expression)
_ORDER_ITEM_COLUMNS: dict[str, tuple[str, Callable[[], Column]]] = {
    "order_id": ("", lambda: F.col("l_orderkey")),
    "user_id": ("orders", lambda: F.col("o_custkey")),
    "product_id": ("", lambda: F.col("l_partkey")),
    "distribution_center_id": ("", lambda: F.col("l_suppkey")),
    "status": (
        "orders",
        lambda: F.when(F.col("o_orderstatus") == "F", "Complete")
        .when(F.col("o_orderstatus") == "O", "Shipped")
        .otherwise("Cancelled"),
    ),
    "created_at": ("orders", lambda: F.col("o_orderdate")),
    "shipped_at": ("", lambda: F.col("l_shipdate")),
    "delivered_at": ("", lambda: F.when(F.col("l_linestatus") == "F", F.col("l_shipdate") + _days(F.col("l_linenumber")))),
    "returned_at": ("", lambda: F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + _days(F.lit(14)))),
    "num_of_item": ("", lambda: F.col("l_quantity").cast("int")),
    "retail_price": ("", lambda: F.col("l_extendedprice") / F.col("l_quantity")),
    "sale_price": ("", lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")),
    "cost": ("", lambda: F.lit(0.6) * F.col("l_extendedprice") / F.col("l_quantity")),
    "category": ("part", lambda: F.col("p_type")),
    "brand": ("part", lambda: F.col("p_brand")),
    "product_name": ("part", lambda: F.col("p_name")),
    "department": ("part", lambda: F.when(F.col("p_size") <= 25, "Women").otherwise("Men")),
    "country": ("region", lambda: F.col("r_name")),
    "state": ("nation", lambda: F.col("n_name")),
    "city": ("nation", lambda: F.concat(F.col("n_name"), F.lit("-"), (F.col("c_custkey") % 10).cast("string"))),
    "traffic_source": ("customer", lambda: F.col("c_mktsegment")),
    "gender": ("orders", lambda: F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("M")),
    "age": ("orders", lambda: (10 + F.col("o_custkey") % 95).cast("double")),
    "is_loyal": ("customer", lambda: F.col("c_acctbal") > 5000),
    "customer_review": ("documents", lambda: F.col("text")),
}

_NEEDS = {
    "": set(),
    "orders": {"orders"},
    "part": {"part"},
    "customer": {"orders", "customer"},
    "nation": {"orders", "customer", "nation"},
    "region": {"orders", "customer", "nation", "region"},
    "documents": {"documents"},
}

ORDER_ITEM_COLUMNS = [c for c in _ORDER_ITEM_COLUMNS if c != "customer_review"]


def _customers(spark: SparkSession, sf_dir: str, needed: set[str]) -> DataFrame:
    df = load(spark, sf_dir, "customer")
    if "nation" in needed:
        df = df.join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if "region" in needed:
        df = df.join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df


def _with_part(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


def order_items(spark: SparkSession, sf_dir: str, *columns: str, by_product: bool = False) -> DataFrame:
    """Order lines with the named columns (all but the review text by default).

    ``by_product``: the lines lie by product whether the parts are broadcast or not, so that counts and sums by product
    combine where the lines are.
    """
    wanted = list(columns) or ORDER_ITEM_COLUMNS
    needed: set[str] = set()
    for c in wanted:
        needed |= _NEEDS[_ORDER_ITEM_COLUMNS[c][0]]
    df = spread(load(spark, sf_dir, "lineitem"), "l_orderkey")
    # Lines that customers are told of end arranged by order, so that sums by user and order combine before they are shuffled.
    # The customer's columns come by way of the orders: that join is shuffled per order, not per line.
    part_last = by_product or "customer" not in needed
    if "part" in needed and not part_last:
        df = _with_part(df, spark, sf_dir)
    if "orders" in needed:
        orders = load(spark, sf_dir, "orders")
        if "customer" in needed:
            orders = orders.join(_customers(spark, sf_dir, needed), F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if by_product:
        df = df.repartition("l_partkey")
    if "part" in needed and part_last:
        df = _with_part(df, spark, sf_dir)
    if "documents" in needed:
        df = df.join(load(spark, sf_dir, "documents").select("doc_id", "text"), F.col("l_orderkey") == F.col("doc_id"), "left")
    return df.select(*[_ORDER_ITEM_COLUMNS[c][1]().alias(c) for c in wanted])


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clickstream events, moved back 23 years so that they overlap the orders."""
    raw = spread(load(spark, sf_dir, "events"), "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        (F.col("ts") - F.make_ym_interval(F.lit(23))).alias("created_at"),
        "event_type",
        F.concat(F.lit("b"), (k % 5).cast("string")).alias("browser"),
        F.concat(F.lit("/"), F.col("event_type")).alias("uri"),
        "value",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents standing in for review texts."""
    return spread(load(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("text").alias("customer_review"))
