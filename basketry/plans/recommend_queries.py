"""Recommendation, ranking and look-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import churn as ch
from basketry.operators import collective as co
from basketry.operators import customers as cu
from basketry.operators import factorization as fz
from basketry.operators import lookups as lk
from basketry.operators import products as pr
from basketry.operators import rank_eval as re_
from basketry.operators import recommend as rc
from basketry.operators import series as se
from basketry.plans.catalog import mode_sql, query, view
from basketry.plans.customers_queries import CUSTOMER_INPUTS, customer_profile, enriched
from basketry.plans.marts_queries import fixture_predictions
from basketry.plans.products_queries import PRODUCT_INPUTS, product_quality
from basketry.session import stage
from basketry.sources.tables import stamp

RULE_INPUTS = ["order_id", "user_id", *PRODUCT_INPUTS]
_ORDER = "quality_risk, round(revenue, 6) DESC, round(avg_margin, 6) DESC, product_id"


def _good_view(name, source):
    view(
        name,
        f"SELECT * FROM (SELECT q.*, quality_risk <= (SELECT quantile_cont(quality_risk, 0.75) FROM {source}) AND items >= "
        f"(SELECT greatest(3, quantile_cont(items, 0.1)) FROM {source}) AS good FROM {source} q) "
        "QUALIFY good OR NOT bool_or(good) OVER ()",
    )


def _offers_view(name, good, lines, users, offers):
    view(
        name,
        f"""
WITH pop AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS gplace, row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) AS cplace FROM {good}),
  bought AS (SELECT DISTINCT user_id, category FROM {lines} WHERE category IS NOT NULL AND user_id IN (SELECT user_id FROM {users})),
  a AS (SELECT user_id, 0 AS tier, p.category AS pcat, cplace AS place, product_id, product_name, p.category, brand, quality_risk
    FROM bought JOIN pop p USING (category) WHERE cplace <= 5),
  b AS (SELECT user_id, 1 AS tier, '' AS pcat, gplace AS place, product_id, product_name, category, brand, quality_risk FROM {users} u, pop p
    WHERE gplace <= 30 AND NOT EXISTS (SELECT 1 FROM bought x WHERE x.user_id = u.user_id AND x.category = p.category)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gplace) <= 10),
  c AS (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY tier, pcat, place) AS dup FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT user_id, churn_probability, row_number() OVER (PARTITION BY user_id ORDER BY tier, pcat, place) AS rank, product_id AS recommended_product_id,
  product_name AS recommended_product, category, brand, 'retention_offer_low_quality_risk' AS reason, quality_risk
FROM c JOIN {users} USING (user_id) WHERE dup = 1 QUALIFY rank <= {offers}
""",
    )


_good_view("good_products", "product_quality")
view("offer_users", "SELECT user_id, churn_probability FROM fixture_predictions ORDER BY churn_probability DESC, user_id LIMIT 5000")
_offers_view("rule_offers", "good_products", "order_items", "offer_users", 3)

QUALITY_SPEC = "product_id:i product_name:s category:s brand:s revenue:f items:i return_rate:f cancel_rate:f avg_margin:f quality_risk:f"
OFFER_SPEC = "user_id:i churn_probability:f rank:i recommended_product_id:i recommended_product:s category:s brand:s reason:s quality_risk:f"


def offer_lines(spark, d):
    """The lines behind scores, products and offers, joined and written once."""
    return stage(enriched(spark, d, *dict.fromkeys([*CUSTOMER_INPUTS, *RULE_INPUTS])), "lines")


def predictions(spark, d, lines=None):
    lines = lines if lines is not None else enriched(spark, d, *CUSTOMER_INPUTS)
    return stage(fixture_predictions(cu.customer_features(lines)), "predictions")


@query("h01_good_products", QUALITY_SPEC, "SELECT * FROM good_products")
def h01(spark, d):
    return rc.good_products(stage(product_quality(spark, d), "quality"))


def rule_offers(spark, d, scores=None):
    lines = offer_lines(spark, d)
    scores = scores if scores is not None else predictions(spark, d, lines)
    return rc.retention_offers(lines, stage(pr.product_quality(lines), "quality"), rc.riskiest_users(scores))


@query("h02_retention_offers", OFFER_SPEC, "SELECT * FROM rule_offers")
def h02(spark, d):
    return rule_offers(spark, d)


view(
    "newest_orders",
    "SELECT user_id, order_id FROM (SELECT user_id, order_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id "
    "ORDER BY newest_at DESC, order_id) AS p FROM (SELECT user_id, order_id, max(created_at) AS newest_at FROM enriched GROUP BY 1, 2)) WHERE n >= 2 AND p = 1",
)
view("split_test", "SELECT e.* FROM enriched e SEMI JOIN newest_orders n ON e.user_id = n.user_id AND e.order_id = n.order_id")
view("split_train", "SELECT e.* FROM enriched e ANTI JOIN newest_orders n ON e.user_id = n.user_id AND e.order_id = n.order_id")
view(
    "train_quality",
    "SELECT product_id, product_name, category, brand, sum(sale_price) AS revenue, count(*) AS items, avg(is_returned) AS return_rate, "
    "avg(is_cancelled) AS cancel_rate, avg(margin) AS avg_margin, avg(is_returned) * 0.55 + avg(is_cancelled) * 0.45 AS quality_risk "
    "FROM split_train GROUP BY 1, 2, 3, 4",
)
view("eval_users", "SELECT u.* FROM offer_users u SEMI JOIN newest_orders n ON u.user_id = n.user_id")
_good_view("train_good", "train_quality")
_offers_view("holdout_offers", "train_good", "split_train", "eval_users", 3)
_offers_view("holdout_offers_10", "train_good", "split_train", "eval_users", 10)


def holdout(spark, d, offers):
    """(offers rebuilt from the history, held-out lines) of the high-risk users."""
    lines = offer_lines(spark, d)
    newest = stage(rc.newest_orders(lines), "newest")
    users = stage(rc.riskiest_users(predictions(spark, d, lines)).join(newest.select("user_id"), "user_id", "left_semi"), "users")
    train, test = (stage(part, "part") for part in rc.temporal_split(lines, users))
    quality = stage(pr.product_quality(train), "quality")
    return rc.retention_offers(train, quality, users, offers), test


@query("h03_holdout_offers", OFFER_SPEC, "SELECT * FROM holdout_offers")
def h03(spark, d):
    return holdout(spark, d, 3)[0]


@query(
    "h04_temporal_split",
    "part:s user_id:i order_id:i lines:i",
    "SELECT 'test' AS part, user_id, order_id, count(*) AS lines FROM split_test GROUP BY ALL UNION ALL "
    "SELECT 'train', user_id, order_id, count(*) FROM split_train GROUP BY ALL",
)
def h04(spark, d):
    train, test = rc.temporal_split(enriched(spark, d, "order_id", "user_id"))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "user_id", "order_id").agg(F.count(F.lit(1)).alias("lines"))


def _minmax(c):
    return (
        f"CAST(CASE WHEN max(coalesce({c}, 0)) OVER () = min(coalesce({c}, 0)) OVER () THEN 0 ELSE (coalesce({c}, 0) - min(coalesce({c}, 0)) OVER ()) / "
        f"(max(coalesce({c}, 0)) OVER () - min(coalesce({c}, 0)) OVER ()) END AS FLOAT)"
    )


def _side_sql(source, key, out_key, numbers, encoded):
    parts = [f"SELECT {key} AS {out_key}, '{c}' AS feature, {_minmax(c)} AS value FROM {source}" for c in numbers]
    parts += [f"SELECT {key}, '{prefix}_' || {c}, 1.0 FROM {source}" for c, prefix in encoded]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value > 0"


view(
    "user_side_base",
    "SELECT user_id, gender, country, traffic_source, items AS user_items, unique_products AS user_unique_items, unique_categories AS user_unique_categories, "
    "total_spend AS user_total_spend, total_margin AS user_total_margin, avg_item_price AS user_avg_price, return_rate AS user_return_rate, "
    "cancel_rate AS user_cancel_rate, completion_rate AS user_completion_rate, avg_shipping_days AS user_avg_shipping_days, "
    "avg_delivery_days AS user_avg_delivery_days, age AS user_age, orders AS user_orders, recency_days AS user_recency_days, "
    "tenure_days AS user_tenure_days, avg_order_value AS user_avg_order_value, purchase_frequency AS user_purchase_frequency FROM customer_base",
)
for _c in ["category", "brand", "department", "product_name"]:
    view(f"item_mode_{_c}", mode_sql("enriched", "product_id", _c))
view(
    "item_side_base",
    "SELECT i.*, category, brand, department, product_name, item_return_rate * 0.55 + item_cancel_rate * 0.45 AS item_quality_risk, "
    "coalesce(item_margin / nullif(item_revenue, 0), 0) AS item_margin_rate FROM (SELECT product_id, count(*) AS item_sales, "
    "count(DISTINCT user_id) AS item_buyers, sum(sale_price) AS item_revenue, sum(margin) AS item_margin, avg(sale_price) AS item_avg_price, "
    "avg(retail_price) AS item_retail_price, avg(is_returned) AS item_return_rate, avg(is_cancelled) AS item_cancel_rate, "
    "avg(is_completed) AS item_completion_rate FROM enriched GROUP BY product_id) i JOIN item_mode_category USING (product_id) "
    "JOIN item_mode_brand USING (product_id) JOIN item_mode_department USING (product_id) JOIN item_mode_product_name USING (product_id)",
)
USER_INPUTS = ["order_id", "user_id", "product_id", "category", "age", "gender", "country", "traffic_source", "is_loyal"]
ITEM_INPUTS = ["order_id", "user_id", "product_id", "category", "brand", "department", "product_name", "retail_price"]


def _long(side, key):
    names = [c for c in side.columns if c != key]
    return side.unpivot([key], names, "feature", "value").where(F.col("value") > 0)


@query(
    "h05_user_side",
    "UserId:i feature:s value:f",
    _side_sql("user_side_base", "user_id", "UserId", fz.USER_NUMBERS, [("gender", "gender"), ("country", "country"), ("traffic_source", "traffic")]),
)
def h05(spark, d):
    return _long(fz.user_side(enriched(spark, d, *USER_INPUTS)), "UserId")


@query(
    "h06_item_side",
    "ItemId:i feature:s value:f",
    _side_sql("item_side_base", "product_id", "ItemId", fz.ITEM_NUMBERS, [("category", "category"), ("brand", "brand"), ("department", "department")]),
)
def h06(spark, d):
    return _long(fz.item_side(enriched(spark, d, *ITEM_INPUTS, by_product=True))[0], "ItemId")


@query(
    "h06_item_lookup",
    "ItemId:i product_name:s category:s brand:s item_quality_risk:f",
    "SELECT product_id AS ItemId, product_name, category, brand, item_quality_risk FROM item_side_base",
)
def h06_lookup(spark, d):
    return fz.item_side(enriched(spark, d, *ITEM_INPUTS, by_product=True))[1]


@query(
    "h07_interactions",
    "UserId:i ItemId:i Value:f times_bought:i total_spend:f last_seen:t",
    """
WITH p AS (SELECT user_id AS UserId, product_id AS ItemId, count(*) AS times_bought, sum(sale_price) AS total_spend, sum(is_completed) AS c,
    sum(is_returned) AS r, sum(is_cancelled) AS x, max(created_at) AS last_seen FROM enriched GROUP BY 1, 2),
  s AS (SELECT *, ln(1 + total_spend) AS l FROM p), m AS (SELECT *, (l - min(l) OVER ()) / (max(l) OVER () - min(l) OVER ()) AS spend FROM s)
SELECT *, CAST(greatest(1.0 + ln(1 + times_bought) + 0.75 * spend + 0.15 * c - (0.35 * r + 0.45 * x), 0.1) AS FLOAT) AS Value FROM m
""",
)
def h07(spark, d):
    return fz.interactions(enriched(spark, d, "user_id", "product_id"))


_FITTED = {}


def fitted_model(spark, d):
    """One fit for the queries of a session that show it; another after a table was written again."""
    key = (spark.sparkContext.applicationId, d, stamp(spark, d, MODEL_TABLES))
    if key not in _FITTED:
        _FITTED[key] = _fit(spark, d)
    return _FITTED[key]


MODEL_TABLES = ["lineitem", "orders", "customer", "part", "nation", "region"]


def _fit(spark, d):
    train, test = rc.temporal_split(enriched(spark, d, *dict.fromkeys([*USER_INPUTS, *ITEM_INPUTS])))
    train = stage(train, "train")
    pairs = stage(fz.interactions(train), "pairs")
    items, lookup = fz.item_side(train.repartition("product_id"))
    users, items = stage(fz.user_side(train), "user-side"), stage(items, "item-side")
    return co.fit_collective(pairs, users, items), pairs, lookup, train, test, users, items


@query("h08_factorization", "ItemId:i strength:f")
def h08(spark, d):
    """Length of every item's shared factors in the collective factorization."""
    model = fitted_model(spark, d)[0]
    shared = F.slice("f", model.item_side.own + 1, model.shared)
    return model.items.select("ItemId", F.sqrt(F.aggregate(shared, F.lit(0.0), lambda a, x: a + x * x)).alias("strength"))


@query("h08_attribute_factors", "entity:s attribute:s strength:f")
def h08_attributes(spark, d):
    """Length of every attribute's factors."""
    model = fitted_model(spark, d)[0]
    sides = (("user", model.user_side), ("item", model.item_side))
    rows = [(kind, name, float((f**2).sum() ** 0.5)) for kind, side in sides for name, f in zip(side.names, side.factors, strict=True)]
    return spark.createDataFrame(rows, "entity string, attribute string, strength double")


MODEL_SPEC = "user_id:i rank:i recommended_product_id:i score:f product_name:s category:s brand:s item_quality_risk:f"


@query("h09_model_recommendations", MODEL_SPEC)
def h09(spark, d):
    model, pairs, lookup, train, *_ = fitted_model(spark, d)
    return co.recommend(model, pairs, lookup, rc.offer_targets(train, pairs))[0]


@query("h09_skipped_blocks", "users:i blocks:i visited:i skipped_share:f")
def h09_skipped(spark, d):
    """How many blocks of items the users of the model look at for their exact lists."""
    model, pairs, lookup, *_ = fitted_model(spark, d)
    return co.recommend(model, pairs, lookup, model.users.select(F.col("UserId").alias("user_id")))[1]


@query(
    "h09_model_rank_metrics",
    "evaluated_users:i k:i product_hit_rate_at_k:f product_precision_at_k:f product_recall_at_k:f product_mrr_at_k:f category_hit_rate_at_k:f "
    "category_precision_at_k:f category_recall_at_k:f category_mrr_at_k:f",
)
def h09_metrics(spark, d):
    model, pairs, lookup, _, test, *_ = fitted_model(spark, d)
    return re_.rank_metrics(co.recommend(model, pairs, lookup, test.select("user_id").distinct())[0], test)


@query(
    "h09_pseudo_row_rank_metrics",
    "evaluated_users:i k:i product_hit_rate_at_k:f product_precision_at_k:f product_recall_at_k:f product_mrr_at_k:f category_hit_rate_at_k:f "
    "category_precision_at_k:f category_recall_at_k:f category_mrr_at_k:f",
)
def h09_pseudo_rows(spark, d):
    """The same measures for alternating least squares with attributes as extra interactions, for comparison."""
    _, pairs, lookup, _, test, users, items = fitted_model(spark, d)
    fitted = fz.fit_factorization(pairs, users, items)
    return re_.rank_metrics(fz.recommend(fitted, pairs, lookup, test.select("user_id").distinct()), test)


def _hits_sql(offers, k):
    return f"""
WITH t AS (SELECT user_id, count(DISTINCT product_id) AS nt, count(DISTINCT category) AS nc FROM eval_test GROUP BY user_id),
  r AS (SELECT o.*, EXISTS (SELECT 1 FROM eval_test x WHERE x.user_id = o.user_id AND x.product_id = o.recommended_product_id) AS ih,
    EXISTS (SELECT 1 FROM eval_test x WHERE x.user_id = o.user_id AND x.category = o.category) AS ch FROM {offers} o WHERE rank <= {k}),
  u AS (SELECT user_id, any_value(nt) AS nt, any_value(nc) AS nc, count(*) FILTER (ih) AS ihits, count(*) FILTER (ch) AS chits,
    count(DISTINCT recommended_product_id) FILTER (ih) AS ifound, count(DISTINCT category) FILTER (ch) AS cfound,
    min(rank) FILTER (ih) AS ifirst, min(rank) FILTER (ch) AS cfirst FROM r JOIN t USING (user_id) GROUP BY user_id)"""


view("eval_test", "SELECT s.* FROM split_test s SEMI JOIN eval_users u ON s.user_id = u.user_id")


@query(
    "h10_rank_metrics",
    "evaluated_users:i k:i product_hit_rate_at_k:f product_precision_at_k:f product_recall_at_k:f product_mrr_at_k:f category_hit_rate_at_k:f "
    "category_precision_at_k:f category_recall_at_k:f category_mrr_at_k:f",
    _hits_sql("holdout_offers_10", 10)
    + """
SELECT count(*) AS evaluated_users, 10 AS k, avg(CAST(ifirst IS NOT NULL AS INTEGER)) AS product_hit_rate_at_k, avg(ifound / 10) AS product_precision_at_k,
  avg(ifound / nt) AS product_recall_at_k, avg(coalesce(1.0 / ifirst, 0)) AS product_mrr_at_k, avg(CAST(cfirst IS NOT NULL AS INTEGER)) AS category_hit_rate_at_k,
  avg(cfound / 10) AS category_precision_at_k, avg(cfound / nc) AS category_recall_at_k, avg(coalesce(1.0 / cfirst, 0)) AS category_mrr_at_k FROM u""",
)
def h10(spark, d):
    offers, test = holdout(spark, d, 10)
    return re_.rank_metrics(offers, test, 10)


@query(
    "h11_holdout_metrics",
    "evaluated_users:i k:i product_hit_rate_at_1:f product_hit_rate_at_k:f product_precision_at_k:f product_recall_at_k:f product_mrr_at_k:f "
    "category_hit_rate_at_1:f category_hit_rate_at_k:f category_recall_at_k:f category_mrr_at_k:f",
    _hits_sql("holdout_offers", 3)
    + """
SELECT count(*) AS evaluated_users, 3 AS k, avg(CAST(coalesce(ifirst = 1, false) AS INTEGER)) AS product_hit_rate_at_1,
  avg(CAST(ifirst IS NOT NULL AS INTEGER)) AS product_hit_rate_at_k, avg(ifound / 3) AS product_precision_at_k, avg(ihits / nt) AS product_recall_at_k,
  avg(coalesce(1.0 / ifirst, 0)) AS product_mrr_at_k, avg(CAST(coalesce(cfirst = 1, false) AS INTEGER)) AS category_hit_rate_at_1,
  avg(CAST(cfirst IS NOT NULL AS INTEGER)) AS category_hit_rate_at_k, avg(chits / nc) AS category_recall_at_k,
  avg(coalesce(1.0 / cfirst, 0)) AS category_mrr_at_k FROM u""",
)
def h11(spark, d):
    offers, test = holdout(spark, d, 3)
    return re_.holdout_metrics(offers, test, 3)


@query(
    "h12_coverage",
    "recommended_rows:i recommended_users:i avg_recommendations_per_user:f min_recommendations_per_user:i max_recommendations_per_user:i "
    "unique_recommended_products:i unique_recommended_categories:i catalog_coverage_product:f catalog_coverage_category:f "
    "avg_unique_categories_per_user:f avg_quality_risk:f median_quality_risk:f zero_quality_risk_share:f",
    """
WITH u AS (SELECT user_id, count(*) AS n, count(DISTINCT category) AS c FROM rule_offers GROUP BY user_id)
SELECT count(*) AS recommended_rows, count(DISTINCT user_id) AS recommended_users, (SELECT avg(n) FROM u) AS avg_recommendations_per_user,
  (SELECT min(n) FROM u) AS min_recommendations_per_user, (SELECT max(n) FROM u) AS max_recommendations_per_user,
  count(DISTINCT recommended_product_id) AS unique_recommended_products, count(DISTINCT category) AS unique_recommended_categories,
  count(DISTINCT recommended_product_id) / (SELECT count(DISTINCT product_id) FROM order_items) AS catalog_coverage_product,
  count(DISTINCT category) / (SELECT count(DISTINCT category) FROM order_items) AS catalog_coverage_category,
  (SELECT avg(c) FROM u) AS avg_unique_categories_per_user, avg(quality_risk) AS avg_quality_risk, median(quality_risk) AS median_quality_risk,
  avg(CAST(quality_risk = 0 AS INTEGER)) AS zero_quality_risk_share FROM rule_offers
""",
)
def h12(spark, d):
    return re_.coverage(enriched(spark, d, "product_id", "category"), stage(rule_offers(spark, d), "offers"))


def _mm(c):
    return f"(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0))"


@query(
    "h13_offer_targets",
    "user_id:i score:f",
    f"""
WITH s AS (SELECT user_id, floor((epoch_us((SELECT max(created_at) FROM enriched)) - epoch_us(max(created_at))) / 86400e6) AS recency_days,
    count(DISTINCT order_id) * 1.0 AS orders, avg(is_cancelled) AS cancel_rate, avg(is_returned) AS return_rate FROM enriched GROUP BY user_id)
SELECT user_id, round({_mm("recency_days")} * 0.45 + {_mm("cancel_rate")} * 0.25 + {_mm("return_rate")} * 0.20 + (1 - {_mm("orders")}) * 0.10, 9) AS score
FROM s ORDER BY score DESC, user_id LIMIT 5000
""",
)
def h13(spark, d):
    lines = enriched(spark, d, "order_id", "user_id", "product_id")
    return rc.offer_targets(lines, fz.interactions(lines))


@query(
    "h14_fallback_offers",
    "user_id:i rank:i recommended_product_id:i product_name:s category:s brand:s score:f item_quality_risk:f source:s",
    f"""
SELECT user_id, rank, product_id AS recommended_product_id, product_name, category, brand, 1.0 - quality_risk + churn_probability * 0.1 AS score,
  quality_risk AS item_quality_risk, 'business_rule_fallback' AS source
FROM fixture_predictions, (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM product_quality QUALIFY rank <= 5)
""",
)
def h14(spark, d):
    return rc.fallback_offers(predictions(spark, d), product_quality(spark, d))


@query("h15_tiered_offers", "user_id:i rank:i recommended_product_id:i product_name:s category:s brand:s score:f item_quality_risk:f source:s")
def h15(spark, d):
    scores = predictions(spark, d)
    model, pairs, lookup, train, *_ = fitted_model(spark, d)
    targets = stage(rc.offer_targets(train, pairs), "targets")
    stored = fz.stored_offers(co.recommend(model, pairs, lookup, targets)[0])
    # every other user that the model knows has its own offers as well
    others = model.users.select(F.col("UserId").alias("user_id")).join(targets, "user_id", "left_anti")
    live = fz.stored_offers(co.recommend(model, pairs, lookup, others)[0], "hybrid_als")
    rules = rc.rule_offers_as_tier(rule_offers(spark, d, scores))
    return rc.tiered_offers([stored, live, rules, rc.fallback_offers(scores, product_quality(spark, d))])


@query(
    "h15_tier_rule",
    "user_id:i rank:i recommended_product_id:i score:f source:s",
    f"""
WITH last AS (SELECT user_id, rank, product_id AS recommended_product_id, 1.0 - quality_risk + churn_probability * 0.1 AS score
    FROM fixture_predictions, (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM product_quality QUALIFY rank <= 5)),
  t AS (SELECT 0 AS tier, user_id, rank, recommended_product_id, score, 'hybrid_prebuilt' AS source FROM last WHERE user_id % 3 = 0
    UNION ALL SELECT 1, user_id, rank, recommended_product_id, 1.0 - quality_risk, 'retention_rules' FROM rule_offers WHERE user_id % 3 < 2
    UNION ALL SELECT 2, user_id, rank, recommended_product_id, score, 'business_rule_fallback' FROM last)
SELECT * FROM t WHERE rank <= 5 QUALIFY tier = min(tier) OVER (PARTITION BY user_id)
""",
)
def h15_rule(spark, d):
    """The choice of tiers on lists that SQL can repeat: a third of the users has stored lists, another rules alone."""
    lines = offer_lines(spark, d)
    scores = predictions(spark, d, lines)
    last = stage(rc.fallback_offers(scores, product_quality(spark, d)), "fallback")
    stored = fz.stored_offers(last.where("user_id % 3 = 0"))
    rules = rc.rule_offers_as_tier(rule_offers(spark, d, scores).where("user_id % 3 < 2"))
    return rc.tiered_offers([stored, rules, last])


@query("j01_known_users", "user_id:i", "SELECT user_id FROM fixture_predictions ORDER BY user_id LIMIT 200")
def j01(spark, d):
    return lk.known_users(predictions(spark, d))


@query("j02_platform_summary", "users:i high_risk_share:f recommendation_rows:i forecast_months:i churn_auc:f top_features:s")
def j02(spark, d):
    profile = stage(customer_profile(spark, d), "profile")
    model = ch.train_rule_model(profile)
    outlook = se.sales_outlook(se.monthly_revenue(enriched(spark, d, "order_id")))
    summary = lk.platform_summary(
        stage(model.predictions, "scores"), rule_offers(spark, d, fixture_predictions(profile)), outlook, model.metrics, model.importance
    )
    return summary.withColumn("top_features", F.array_join("top_features", ","))


@query(
    "j03_customer_overview",
    "user_id:i churn_probability:f risk_group:s orders:i total_spend:f return_rate:f cancel_rate:f recency_days:i purchase_frequency:f "
    "customer_segment:s abc_segment:s xyz_segment:s",
    "SELECT f.*, p.* EXCLUDE (user_id) FROM fixture_predictions f LEFT JOIN customer_profile p USING (user_id)",
)
def j03(spark, d):
    profile = stage(customer_profile(spark, d), "profile")
    return ch.customer_overview(fixture_predictions(profile), profile)
