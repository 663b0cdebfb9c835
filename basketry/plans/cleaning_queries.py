"""Source, sink and cleaning queries.

The test tables are clean, so columns are dirtied by fixed rules that the SQL repeats.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from basketry.functions import scalars as sc
from basketry.operators import cleaning as cl
from basketry.operators import segments as sg
from basketry.plans.catalog import query, view
from basketry.plans.customers_queries import CUSTOMER_INPUTS, FIXTURE_ROLES, customer_features, enriched
from basketry.plans.marts_queries import fixture_predictions
from basketry.plans.products_queries import PRODUCT_INPUTS, product_quality
from basketry.plans.profiling_queries import time_texts
from basketry.operators import customers as cu
from basketry.operators import products as pr
from basketry.session import shared_folder, stage
from basketry.sources import flatfiles, publish
from basketry.sources.tables import ORDER_ITEM_COLUMNS, event_log, load, order_items


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _as_csv(spark, df, name):
    path = _folder(spark, name)
    texts = {f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS") for f in df.schema.fields if f.dataType.typeName() == "timestamp"}
    # as data frames of other tools are written: ids of columns with gaps as 12.0, quotes doubled
    written = df.withColumns(texts | {"user_id": F.col("user_id").cast("double").cast("string")})
    written.write.options(header=True, quote='"', escape='"').csv(path)
    return path


def _reviewed(lines):
    """Lines with a review that holds quotes, commas and a line break."""
    return lines.withColumn("customer_review", F.concat(F.lit('"'), "category", F.lit('", said '), "city", F.lit(",\nthen left")))


_REVIEW = "'\"' || category || '\", said ' || city || ',' || chr(10) || 'then left' AS customer_review"


ORDER_SPEC = (
    "order_id:i user_id:i status:s created_at:t returned_at:t num_of_item:i sale_price:f cost:f age:f category:s city:s is_loyal:b"
)


@query(
    "a01_order_csv_scan",
    ORDER_SPEC + " warehouse_name:s customer_review:s",
    f"SELECT *, CAST(NULL AS VARCHAR) AS warehouse_name, {_REVIEW} FROM order_items",
)
def a01(spark, d):
    path = _as_csv(spark, _reviewed(order_items(spark, d)), "orders-csv")
    return cl.parse_times(flatfiles.read_orders(spark, path))


@query(
    "a02_event_csv_scan",
    "user_id:i session_id:s created_at:t browser:s uri:s event_type:s traffic_source:s",
    "SELECT *, CAST(NULL AS VARCHAR) AS traffic_source FROM event_log",
)
def a02(spark, d):
    path = _as_csv(spark, event_log(spark, d), "events-csv")
    return cl.parse_times(flatfiles.read_events(spark, path))


@query("a03_full_csv_scan", ORDER_SPEC + " product_id:i department:s country:s customer_review:s", f"SELECT *, {_REVIEW} FROM order_items")
def a03(spark, d):
    path = _as_csv(spark, _reviewed(order_items(spark, d)), "orders-csv")
    return cl.parse_times(flatfiles.read_csv(spark, path))


def _published(spark, d):
    root = _folder(spark, "published")
    # four tables come from the lines: they are joined once, with the columns that these need
    lines = stage(enriched(spark, d, *dict.fromkeys([*CUSTOMER_INPUTS, *PRODUCT_INPUTS, "department"])), "lines")
    customers = stage(cu.customer_features(lines), "customers")
    tables = {
        "customer_features": customers,
        "churn_predictions": fixture_predictions(customers),
        "category_quality": pr.category_sales(lines),
        "product_quality": pr.product_quality(lines),
    }
    return root, publish.publish_tables(tables, root)


@query(
    "a04_publish_tables",
    "table:s rows:i",
    "SELECT 'customer_features' AS \"table\", count(DISTINCT user_id) AS rows FROM enriched UNION ALL "
    "SELECT 'churn_predictions', count(*) FROM fixture_predictions UNION ALL "
    "SELECT 'category_quality', count(*) FROM (SELECT DISTINCT category, department FROM enriched) UNION ALL "
    "SELECT 'product_quality', count(*) FROM product_quality",
)
def a04(spark, d):
    _, folders = _published(spark, d)
    counts = [spark.read.parquet(f).agg(F.lit(f.rsplit("/", 1)[1]).alias("table"), F.count(F.lit(1)).alias("rows")) for f in folders]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "a05_publish_metrics",
    "customers:i high_risk_share:f",
    "SELECT count(*) AS customers, avg(CAST(risk_group = 'high' AS INTEGER)) AS high_risk_share FROM fixture_predictions",
)
def a05(spark, d):
    predictions = fixture_predictions(customer_features(spark, d))
    share = F.avg((F.col("risk_group") == "high").cast("int"))
    folder = publish.publish_metrics(
        predictions.agg(F.count(F.lit(1)).alias("customers"), share.alias("high_risk_share")), _folder(spark, "metrics")
    )
    return spark.read.json(folder)


@query(
    "a06_read_published",
    "user_id:i churn_probability:f risk_group:s",
    "SELECT * FROM fixture_predictions",
)
def a06(spark, d):
    root = _folder(spark, "published")
    publish.publish_tables({"churn_predictions": fixture_predictions(customer_features(spark, d))}, root)
    return publish.read_published(spark, root, "churn_predictions")


@query(
    "b01_parse_timestamps",
    "order_id:i product_id:i created_text:s parsed:t",
    "SELECT order_id, product_id, created_text, CASE WHEN form < 4 THEN created_at END AS parsed FROM time_texts",
)
def b01(spark, d):
    return time_texts(spark, d).withColumn("parsed", sc.parse_timestamp(F.col("created_text")))


# Numbers as text: every fifth is unreadable, every seventh missing.
view(
    "number_texts",
    "SELECT order_id, product_id, retail_price AS fallback, sale_price AS number, CASE WHEN product_id % 5 = 0 THEN 'n/a' "
    "WHEN product_id % 7 = 0 THEN NULL ELSE 'ok' END AS form FROM order_items",
)


@query(
    "b02_to_number",
    "order_id:i product_id:i plain:f zero:f fallback_price:f",
    "SELECT order_id, product_id, CASE WHEN form = 'ok' THEN number END AS plain, CASE WHEN form = 'ok' THEN number ELSE 0 END AS zero, "
    "CASE WHEN form = 'ok' THEN number ELSE fallback END AS fallback_price FROM number_texts",
)
def b02(spark, d):
    lines = order_items(spark, d, "order_id", "product_id", "sale_price", "retail_price")
    text = F.when(F.col("product_id") % 5 == 0, "n/a").when(F.col("product_id") % 7 != 0, F.col("sale_price").cast("string"))
    dirty = lines.withColumn("price_text", text)
    number = F.col("price_text")
    return dirty.select(
        "order_id",
        "product_id",
        sc.to_number(number).alias("plain"),
        sc.to_number(number, 0).alias("zero"),
        sc.to_number(number, F.col("retail_price")).alias("fallback_price"),
    )


@query(
    "b03_repair_text",
    "doc_id:i chars:i repaired:s",
    "SELECT doc_id, length(text) + 9 AS chars, md5('®©''--' || text || ' it''s') AS repaired FROM documents",
)
def b03(spark, d):
    docs = load(spark, d, "documents")
    broken = F.concat(F.lit("Â®Â©â€™â€“â€”"), F.col("text"), F.lit(" itâ€™s"))
    fixed = sc.repair_text(broken)
    return docs.select("doc_id", (F.length(fixed) - 1).alias("chars"), F.md5(fixed).alias("repaired"))


@query(
    "b04_blanks_to_null",
    "product_id:i brand:s category:s",
    "SELECT p_partkey AS product_id, CASE WHEN p_partkey % 4 IN (0, 1, 2) THEN NULL ELSE p_brand END AS brand, p_type AS category FROM part",
)
def b04(spark, d):
    key = F.col("p_partkey") % 4
    dirty = F.when(key == 0, " nan ").when(key == 1, "None").when(key == 2, "   ").otherwise(F.concat(F.lit("  "), "p_brand", F.lit(" ")))
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("product_id"), dirty.alias("brand"), F.col("p_type").alias("category"))
    return cl.blanks_to_null(parts)


view("gappy_parts", "SELECT p_partkey AS product_id, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand, p_name AS name, "
     "CASE WHEN p_partkey % 3 <> 1 THEN p_retailprice END AS price, p_size AS size FROM part")


def gappy_parts(spark, d):
    key = F.col("p_partkey") % 3
    return load(spark, d, "part").select(
        F.col("p_partkey").alias("product_id"), F.when(key != 0, F.col("p_brand")).alias("brand"), F.col("p_name").alias("name"),
        F.when(key != 1, F.col("p_retailprice")).alias("price"), F.col("p_size").alias("size"),
    )


@query("b05_fill_constant", "product_id:i brand:s", "SELECT product_id, coalesce(brand, 'Unknown') AS brand FROM gappy_parts")
def b05(spark, d):
    return cl.fill_constant(gappy_parts(spark, d), ["brand"])


@query("b06_fill_from", "product_id:i brand:s", "SELECT product_id, coalesce(brand, name) AS brand FROM gappy_parts")
def b06(spark, d):
    return cl.fill_from(gappy_parts(spark, d), "brand", "name")


@query(
    "b07_fill_mode",
    "product_id:i brand:s",
    "SELECT product_id, coalesce(brand, (SELECT brand FROM gappy_parts WHERE brand IS NOT NULL GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 1)) "
    "AS brand FROM gappy_parts",
)
def b07(spark, d):
    return cl.fill_mode(gappy_parts(spark, d), "brand")


@query(
    "b08_fill_median",
    "product_id:i price:f",
    "SELECT product_id, coalesce(price, (SELECT median(price) FROM gappy_parts)) AS price FROM gappy_parts",
)
def b08(spark, d):
    return cl.fill_median(gappy_parts(spark, d), ["price"])


@query(
    "b09_age_range",
    "order_id:i product_id:i age:f",
    "WITH a AS (SELECT order_id, product_id, CASE WHEN age BETWEEN 14 AND 100 THEN age END AS age FROM order_items) "
    "SELECT order_id, product_id, coalesce(age, (SELECT median(age) FROM a)) AS age FROM a",
)
def b09(spark, d):
    return cl.fill_median(cl.null_outside(order_items(spark, d, "order_id", "product_id", "age"), "age", 14, 100), ["age"])


view("signed_prices", "SELECT order_id, product_id, CASE WHEN product_id % 6 = 0 THEN -sale_price ELSE sale_price END AS sale_price, "
     "num_of_item - 3 AS num_of_item FROM order_items")


def signed_prices(spark, d):
    price = F.when(F.col("product_id") % 6 == 0, -F.col("sale_price")).otherwise(F.col("sale_price"))
    lines = order_items(spark, d, "order_id", "product_id", "sale_price", "num_of_item")
    return lines.withColumns({"sale_price": price, "num_of_item": F.col("num_of_item") - 3})


@query(
    "b10_negative_amounts",
    "order_id:i product_id:i sale_price:f",
    "WITH a AS (SELECT order_id, product_id, CASE WHEN sale_price >= 0 THEN sale_price END AS sale_price FROM signed_prices) "
    "SELECT order_id, product_id, coalesce(sale_price, (SELECT median(sale_price) FROM a)) AS sale_price FROM a",
)
def b10(spark, d):
    return cl.fill_median(cl.null_negative(signed_prices(spark, d), ["sale_price"]), ["sale_price"])


@query(
    "b11_floor_counts",
    "order_id:i product_id:i num_of_item:i",
    "SELECT order_id, product_id, CASE WHEN num_of_item <= 0 THEN 1 ELSE num_of_item END AS num_of_item FROM signed_prices",
)
def b11(spark, d):
    return cl.floor_counts(signed_prices(spark, d))


@query(
    "b12_winsorise",
    "order_id:i product_id:i sale_price:f cost:f",
    "SELECT order_id, product_id, least(greatest(sale_price, s1), s2) AS sale_price, least(greatest(cost, c1), c2) AS cost FROM order_items, "
    "(SELECT quantile_cont(sale_price, 0.01) AS s1, quantile_cont(sale_price, 0.99) AS s2, quantile_cont(cost, 0.01) AS c1, "
    "quantile_cont(cost, 0.99) AS c2 FROM order_items)",
)
def b12(spark, d):
    return cl.winsorise(order_items(spark, d, "order_id", "product_id", "sale_price", "cost"), ["sale_price", "cost"])


# order and line number repeat in the test tables, so some of these rows are full duplicates
_KEYS = ["l_orderkey", "l_linenumber", "l_returnflag"]


@query("b13_drop_duplicates", "l_orderkey:i l_linenumber:i l_returnflag:s", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def b13(spark, d):
    return load(spark, d, "lineitem").select(*_KEYS).dropDuplicates()


@query(
    "b13_duplicate_summary",
    "rows_before:i duplicates:i rows_after:i",
    "SELECT count(*) AS rows_before, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) "
    "AS duplicates, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) AS rows_after FROM lineitem",
)
def b13_summary(spark, d):
    return cl.duplicate_summary(load(spark, d, "lineitem").select(*_KEYS))


@query("b14_drop_empty_columns", "order_id:i product_id:i columns:i", "SELECT order_id, product_id, 2 AS columns FROM order_items")
def b14(spark, d):
    lines = order_items(spark, d, "order_id", "product_id").withColumn("sold_at", F.lit(None).cast("string"))
    kept = cl.drop_empty_columns(lines)
    return kept.withColumn("columns", F.lit(len(kept.columns)))


@query(
    "b15_duplicate_columns",
    "column:s same_as:s",
    "SELECT 'product_category' AS \"column\", 'category' AS same_as FROM order_items HAVING bool_and(category IS NOT DISTINCT FROM category) "
    "UNION ALL SELECT 'returned_copy', 'returned_at' FROM order_items HAVING bool_and(returned_at IS NOT DISTINCT FROM returned_at) "
    "UNION ALL SELECT 'brand', 'product_name' FROM order_items HAVING bool_and(brand IS NOT DISTINCT FROM product_name)",
)
def b15(spark, d):
    lines = order_items(spark, d, "order_id", "category", "product_name", "brand", "returned_at", "sale_price")
    wide = lines.withColumns({"product_category": F.col("category"), "returned_copy": F.col("returned_at"), "nearly": F.col("sale_price") + (F.col("order_id") == 0).cast("int")})
    found = cl.duplicate_columns(wide)
    entries = [F.struct(F.lit(c).alias("column"), F.lit(o).alias("same_as")) for c, o in found.items()]
    return spark.range(1).select(F.inline(F.array(*entries)))


@query(
    "b16_identifier_columns",
    "column:s",
    "SELECT 'o_orderkey' AS \"column\" FROM orders HAVING count(DISTINCT o_orderkey) = count(*) "
    "UNION ALL SELECT 'o_custkey' FROM orders HAVING count(DISTINCT o_custkey) = count(*) "
    "UNION ALL SELECT 'o_totalprice' FROM orders HAVING count(DISTINCT o_totalprice) = count(*) "
    "UNION ALL SELECT 'o_orderdate' FROM orders HAVING count(DISTINCT o_orderdate) = count(*)",
)
def b16(spark, d):
    found = cl.identifier_columns(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in found])).alias("column"))


@query("b17_drop_missing_keys", "product_id:i brand:s price:f", "SELECT * FROM gappy_parts WHERE brand IS NOT NULL AND price IS NOT NULL")
def b17(spark, d):
    return cl.drop_missing_keys(gappy_parts(spark, d), ["brand", "price"])


@query(
    "b18_known_values",
    "order_id:i product_id:i delivery_days_is_known:i delivery_days_value:f sale_price_is_known:i sale_price_value:f",
    "SELECT order_id, product_id, CAST(k AS INTEGER) AS delivery_days_is_known, CASE WHEN k THEN delivery_days ELSE -1 END AS delivery_days_value, "
    "1 AS sale_price_is_known, sale_price AS sale_price_value FROM (SELECT *, coalesce(delivery_days IS NOT NULL AND delivered_at <= created_at, "
    "false) AS k FROM enriched)",
)
def b18(spark, d):
    lines = enriched(spark, d, "order_id", "product_id")
    masked = sc.known_value(lines, "delivery_days", "delivered_at", fill=F.lit(-1.0))
    return sc.known_value(masked, "sale_price")


@query(
    "b19_safe_ratio",
    "user_id:i ratio:f",
    "SELECT user_id, coalesce(cancelled_items / nullif(completed_items, 0), 0) AS ratio FROM customer_base",
)
def b19(spark, d):
    ratio = sc.safe_ratio(F.col("cancelled_items"), F.col("completed_items"))
    return customer_features(spark, d).select("user_id", ratio.alias("ratio"))


@query(
    "b20_min_max",
    "product_id:i price:f size:f",
    "SELECT product_id, (coalesce(price, 0) - lo) / (hi - lo) AS price, (\"size\" - slo) / (shi - slo) AS size FROM gappy_parts, "
    "(SELECT min(coalesce(price, 0)) AS lo, max(coalesce(price, 0)) AS hi, min(\"size\") * 1.0 AS slo, max(\"size\") * 1.0 AS shi FROM gappy_parts)",
)
def b20(spark, d):
    return cl.min_max(gappy_parts(spark, d), ["price", "size"])


@query(
    "b21_percentile_score",
    "product_id:i score:i reversed:i",
    "SELECT product_id, CAST(least(5, (5 * r + n - 1) // n) AS INTEGER) AS score, CAST(greatest(1, least(5, (5 * (n - r) + n - 1) // n)) AS INTEGER) AS reversed "
    "FROM (SELECT product_id, count(*) OVER () AS n, row_number() OVER (ORDER BY coalesce(price, (SELECT median(price) FROM gappy_parts)), product_id) AS r FROM gappy_parts)",
)
def b21(spark, d):
    return sg.percentile_scores(stage(gappy_parts(spark, d)), [("score", "price", False), ("reversed", "price", True)], key="product_id")


@query(
    "b22_quintile",
    "product_id:i quintile:i",
    "SELECT product_id, greatest(1, CAST((5 * (r - 1) + n - 2) // (n - 1) AS INTEGER)) AS quintile FROM (SELECT product_id, count(*) OVER () AS n, "
    "row_number() OVER (ORDER BY \"size\", product_id) AS r FROM gappy_parts)",
)
def b22(spark, d):
    return cl.add_quintile(stage(gappy_parts(spark, d)), "size", "quintile", "product_id")


@query(
    "b23_one_hot_top",
    "product_id:i level:s",
    "WITH v AS (SELECT product_id, coalesce(brand, 'unknown') AS brand FROM gappy_parts), "
    "t AS (SELECT brand FROM v GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 8) "
    "SELECT product_id, 'brand_' || CASE WHEN brand IN (SELECT brand FROM t) THEN brand ELSE 'other' END AS level FROM v",
)
def b23(spark, d):
    encoded = cl.one_hot_top(gappy_parts(spark, d).select("product_id", "brand"), "brand", "brand", 8)
    names = [c for c in encoded.columns if c.startswith("brand_")]
    long = encoded.unpivot(["product_id"], names, "level", "value")
    return long.where(F.col("value") == 1)


@query(
    "b25_clip",
    "order_id:i product_id:i low:f both:f",
    "SELECT order_id, product_id, greatest(delivery_days, 0) AS low, greatest(least(delivery_days, 8), -8) AS both FROM "
    "(SELECT order_id, product_id, delivery_days FROM enriched WHERE delivery_days IS NOT NULL) UNION ALL "
    "SELECT order_id, product_id, NULL, NULL FROM enriched WHERE delivery_days IS NULL",
)
def b25(spark, d):
    days = F.col("delivery_days")
    return enriched(spark, d, "order_id", "product_id").select(
        "order_id", "product_id", sc.clip(days, 0.0).alias("low"), sc.clip(days, -8.0, 8.0).alias("both")
    )


# Raw order lines as text, with blanks, negatives, odd counts and full duplicates.
_CLEAN_COLUMNS = ["order_id", "product_id", "created_at", "num_of_item", "sale_price", "cost", "age", "city", "brand"]
view(
    "cleaned_lines",
    """
WITH raw AS (SELECT DISTINCT order_id, product_id, created_at, CASE WHEN num_of_item % 9 = 0 THEN 0 ELSE num_of_item END AS num_of_item,
    CASE WHEN product_id % 6 = 0 THEN -sale_price ELSE sale_price END AS sale_price, cost, age,
    CASE WHEN product_id % 4 = 0 THEN 'Unknown' ELSE city END AS city, CASE WHEN product_id % 4 = 1 THEN 'Unknown' ELSE brand END AS brand FROM order_items),
  r AS (SELECT * REPLACE (CASE WHEN num_of_item <= 0 THEN 1 ELSE num_of_item END AS num_of_item, CASE WHEN age BETWEEN 14 AND 100 THEN age END AS age,
    CASE WHEN sale_price >= 0 THEN sale_price END AS sale_price) FROM raw)
SELECT * REPLACE (coalesce(age, (SELECT median(age) FROM r)) AS age, coalesce(sale_price, (SELECT median(sale_price) FROM r)) AS sale_price) FROM r
""",
)


@query(
    "clean_order_lines",
    "order_id:i product_id:i created_at:t num_of_item:i sale_price:f cost:f age:f city:s brand:s",
    "SELECT * FROM cleaned_lines",
)
def clean_order_lines(spark, d):
    lines = order_items(spark, d, *_CLEAN_COLUMNS)
    key = F.col("product_id") % 4
    dirty = lines.withColumns(
        {
            "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            "num_of_item": F.when(F.col("num_of_item") % 9 == 0, 0).otherwise(F.col("num_of_item")),
            "sale_price": F.when(F.col("product_id") % 6 == 0, -F.col("sale_price")).otherwise(F.col("sale_price")),
            "city": F.when(key == 0, " nan").otherwise(F.concat(F.col("city"), F.lit(" "))),
            "brand": F.when(key == 1, "").otherwise(F.col("brand")),
            "sold_at": F.lit(None).cast("string"),
        }
    )
    return cl.clean_orders(dirty.unionByName(dirty))
