"""The batch jobs on a small part of the shipped tables' schema, and the query catalogue."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from basketry.plans import jobs
from basketry.sources.tables import event_log, order_items

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
ROLES = {"cart": "click", "purchase": "purchase", "cancel": "error", "product": "view", "department": "signup"}


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("flat")
    for name, df in (("orders", order_items(spark, SF)), ("events", event_log(spark, SF))):
        times = {f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss") for f in df.schema.fields if f.dataType.typeName() == "timestamp"}
        df.withColumns(times).write.option("header", True).csv(str(root / name))
    return root


@needs_data
def test_customer_analytics_job(spark, flat, tmp_path):
    folders = jobs.customer_analytics(spark, str(flat / "orders"), str(flat / "events"), str(tmp_path), ROLES)
    assert len(folders) == 9
    customers = spark.read.parquet(f"{tmp_path}/customer_features")
    assert customers.count() == order_items(spark, SF, "user_id").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/sales_forecast").count() == 3
    offers = spark.read.parquet(f"{tmp_path}/recommendations")
    assert offers.groupBy("user_id").count().where("count > 3").isEmpty() and offers.count() > 0
    assert 0.5 < spark.read.json(f"{tmp_path}/model_metrics").first()["roc_auc"] <= 1


@needs_data
def test_recommender_job(spark, flat, tmp_path):
    folders = jobs.recommender(spark, str(flat / "orders"), str(tmp_path), n=5, rank=4, rounds=2)
    assert len(folders) == 7
    lists = spark.read.parquet(f"{tmp_path}/model_recommendations")
    assert lists.groupBy("user_id").agg(F.max("rank").alias("n")).where("n > 5").isEmpty() and lists.count() > 0
    seen = spark.read.parquet(f"{tmp_path}/user_item")
    again = lists.join(seen, (lists.user_id == seen.UserId) & (lists.recommended_product_id == seen.ItemId))
    assert again.isEmpty()


LIGHT = [
    "a02_event_csv_scan", "b07_fill_mode", "b12_winsorise", "b23_one_hot_top", "c02_missing_report", "d07_calendar", "d10_review_features",
    "e05_event_features", "e07_daily_sales", "e13_logistics_summary", "e29_weekly_series", "f05_customer_xyz", "g19_binary_metrics",
    "h07_interactions", "i01_sales_outlook", "i05_weekly_model_table",
]


@needs_data
@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    found = con.execute(contract.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)
    df = contract.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == expected


def test_catalogue_is_complete():
    queries, texts = contract.queries(), contract.oracle_sql()
    assert set(texts) <= set(queries)
    areas = {n[:3] for n in queries}
    expected = {"a": 6, "b": 25, "c": 8, "d": 11, "e": 33, "f": 11, "g": 22, "h": 15, "i": 16, "j": 3, "k": 5}
    for area, last in expected.items():
        missing = {f"{area}{i:02d}" for i in range(1, last + 1)} - areas
        assert not missing, missing
