"""End-to-end batch jobs from flat files to published tables.

Each input is read once, typed and staged as parquet in the shared folder; every table is
then built from that copy and written by its own action.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import churn, collective, factorization, products, rank_eval, recommend, sales, segments, series, snapshots
from basketry.operators import customers as cu
from basketry.operators.cleaning import parse_numbers, parse_times, repair_texts
from basketry.operators.derive import enrich_orders
from basketry.session import stage
from basketry.sources import flatfiles, publish


def load_orders(spark: SparkSession, path: str) -> DataFrame:
    """Typed and enriched order lines, staged."""
    raw = repair_texts(parse_times(flatfiles.read_orders(spark, path)))
    raw = parse_numbers(raw, ["sale_price", "cost"], 0.0)
    raw = parse_numbers(raw, ["age"]).withColumn("retail_price", F.coalesce("retail_price", "sale_price"))
    return stage(enrich_orders(raw), "orders")


def load_events(spark: SparkSession, path: str) -> DataFrame:
    events = parse_times(flatfiles.read_events(spark, path), ["created_at"])
    return stage(events.withColumn("user_id", F.col("user_id").cast("long")), "events")


def profile_customers(lines: DataFrame, events: DataFrame, roles: Mapping[str, str] = cu.EVENT_ROLES) -> DataFrame:
    """Features, RFM, ABC, XYZ, event features and named segment of every customer, staged."""
    base = stage(cu.customer_features(lines), "customers")
    scored = segments.add_rfm_scores(base, staged=True).join(segments.customer_abc(base, staged=True), "user_id")
    scored = scored.join(segments.customer_xyz(lines), "user_id")
    return stage(segments.name_segments(cu.join_event_features(scored, cu.event_features(events, roles))), "profile")


def customer_analytics(
    spark: SparkSession, orders: str, events: str, out: str, roles: Mapping[str, str] = cu.EVENT_ROLES
) -> list[str]:
    """Customer, category and product tables, rule-churn scores, offers and the outlook."""
    lines = load_orders(spark, orders)
    profile = profile_customers(lines, load_events(spark, events), roles)
    model = churn.train_rule_model(profile)
    scores = stage(model.predictions, "scores")
    quality = stage(products.product_quality(lines), "quality")
    offers = recommend.retention_offers(lines, quality, recommend.riskiest_users(scores))
    folders = publish.publish_tables(
        {
            "customer_features": profile,
            "churn_predictions": scores,
            "churn_feature_importance": model.importance,
            "category_quality": products.category_sales(lines),
            "product_quality": quality,
            "recommendations": offers,
            "sales_forecast": series.sales_outlook(series.monthly_revenue(lines)),
            "headline_figures": sales.headline_figures(lines, scores),
        },
        out,
    )
    return [*folders, publish.publish_metrics(model.metrics, out, "model_metrics")]


def recommender(spark: SparkSession, orders: str, out: str, n: int = 10, users: int = 5000, **model: float) -> list[str]:
    """Factorization on the history before each user's newest order, its measures and lists."""
    lines = load_orders(spark, orders).na.drop(subset=["user_id", "product_id", "created_at"])
    train, test = recommend.temporal_split(lines)
    train = stage(train, "train")
    pairs = stage(factorization.interactions(train), "pairs")
    user_info = stage(factorization.user_side(train), "user-side")
    item_info, lookup = factorization.item_side(train.repartition("product_id"))
    item_info = stage(item_info, "item-side")
    fitted = collective.fit_collective(pairs, user_info, item_info, **model)
    held_out, _ = collective.recommend(fitted, pairs, lookup, test.select("user_id").distinct(), n, user_info)
    production, _ = collective.recommend(fitted, pairs, lookup, recommend.offer_targets(train, pairs, users), n, user_info)
    held_out = stage(held_out, "held-out")
    folders = publish.publish_tables(
        {
            "user_info": user_info,
            "item_info": item_info,
            "item_lookup": lookup,
            "user_item": pairs,
            "eval_recommendations": held_out,
            "model_recommendations": production,
        },
        out,
    )
    return [*folders, publish.publish_metrics(rank_eval.rank_metrics(held_out, test, n), out, "rank_metrics")]


def churn_scoring(
    spark: SparkSession, orders: str, events: str, out: str, event_types: Sequence[str], roles: Mapping[str, str] = cu.EVENT_ROLES,
    rounds: int = 300,
) -> list[str]:
    """Snapshot panel, boosted model, newest scores and the customer overview."""
    lines, log = load_orders(spark, orders), load_events(spark, events)
    prepared = snapshots.prepare_orders(lines)
    dates = snapshots.snapshot_dates(prepared)
    panel = snapshots.snapshot_panel(prepared, snapshots.prepare_events(log), dates, event_types)
    panel = stage(snapshots.time_split(panel, dates), "panel")
    result = churn.train_boosted(snapshots.fill_features(panel), rounds)
    overview = churn.customer_overview(result.predictions, profile_customers(lines, log, roles))
    folders = publish.publish_tables(
        {"snapshot_panel": panel, "churn_overview": overview, "churn_importance": result.importance},
        out,
        partition_by={"snapshot_panel": "snapshot_date"},
    )
    folders.append(publish.publish_metrics(snapshots.dataset_report(panel), out, "dataset_report"))
    return [*folders, publish.publish_metrics(result.metrics, out, "churn_metrics")]
