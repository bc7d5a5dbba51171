from __future__ import annotations

from datetime import date

import pytest
from helpers import rows, tx

from tidemark import schemas
from tidemark.models.metrics import confusion
from tidemark.operators import overview, snapshots
from tidemark.plans import catalogue, staging
from tidemark.sources import extracts, fx, tables


def test_read_table_uses_declared_schema(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "user_id long, extra int").write.parquet(str(tmp_path / "users.parquet"))
    df = tables.read_table(spark, str(tmp_path), "users")
    assert df.columns == schemas.USERS.names and df.head()["user_id"] == 1


def test_run_sql(spark, tmp_path):
    df = spark.createDataFrame([(1,), (5,)], "x int")
    assert tables.run_sql(spark, "SELECT x FROM {t} WHERE x > :low", {"t": df}, {"low": 2}).collect()[0][0] == 5
    (tmp_path / "q.sql").write_text("SELECT count(*) AS n FROM {t}")
    assert tables.run_sql_file(spark, str(tmp_path / "q.sql"), {"t": df}).head()["n"] == 2
    with pytest.raises(FileNotFoundError):
        tables.run_sql_file(spark, str(tmp_path / "none.sql"))


def test_catalog_info(spark):
    spark.createDataFrame([(1, "a")], "id long, name string").createOrReplaceTempView("listed_view")
    assert ("listed_view", 1, "name", "string") in rows(tables.catalog_info(spark))


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "fx.csv"
    path.write_text(
        "date,A_open,A_high,A_low,A_close,A_adj_close,B_open,B_high,B_low,B_close,B_adj_close\n"
        "2024-01-01,1,2,0.5,1.5,1.5,,,,,\n2024-01-02,1,2,0.5,1.6,1.6,3,4,2,3.5,3.5\n"
    )
    df = fx.read_fx_daily(spark, str(path), ["A", "B"])
    assert rows(df)[0] == ("A", date(2024, 1, 1), 1.0, 2.0, 0.5, 1.5) and df.count() == 3
    assert fx.source_profile(df, "files").head()["rows"] == 2


def test_normalise_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "date int, `Adj Close` double")
    assert fx.normalise_names(df, "P").columns == ["date", "P_adj_close"]


def test_extracts(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    assert extracts.write_extract(df, path) is True
    assert extracts.write_extract(df.where("id = 1"), path) is False
    assert rows(extracts.load_extract(spark, path, "id int, s string")) == [(1, "a"), (2, None)]
    assert extracts.write_extract(df.where("id = 1"), path, overwrite=True) is True
    assert extracts.load_extract(spark, path, "id int, s string").count() == 1
    assert extracts.load_extract(spark, str(tmp_path / "no"), "id int", required=False).count() == 0
    with pytest.raises(FileNotFoundError):
        extracts.load_extract(spark, str(tmp_path / "no"), "id int")


def test_staging_uses_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    df = staging.staged(spark.range(5).selectExpr("id", "id % 2 AS k"), "five")
    assert df.count() == 5 and all(f.startswith(f"file:{named}") or named in f for f in df.inputFiles())
    assert staging.release_staged(spark) >= 1


def test_mart_table(spark):
    mart = spark.range(20).withColumnRenamed("id", "user_id")
    saved = staging.build_mart(mart, "mart_for_test", buckets=4)
    assert saved.count() == 20
    plan = saved.groupBy("user_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_overview(spark):
    a = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01")], "id int, d string")
    assert rows(overview.row_counts({"a": a, "b": a.limit(0)})) == [("a", 2), ("b", 0)]
    assert rows(overview.date_coverage({"a": (a, "d")})) == [("a", "2024-01-01", "2024-02-01", 2)]
    assert rows(overview.balance(a.unionByName(a.limit(1)), "id"))[0][2] == pytest.approx(2 / 3)
    assert [r["id"] for r in overview.tail(a, 1, "id").collect()] == [2]
    assert [r["id"] for r in overview.head(a, 1, "id").collect()] == [1]


def test_snapshots_by_hand(spark):
    trades = tx(
        spark,
        [
            (1, "2024-01-10T00:00:00", {"amount": 10.0}),
            (1, "2024-01-20T00:00:00", {"status": "failed"}),
            (1, "2024-03-01T00:00:00", {"amount": 30.0}),
            (1, "2024-12-30T00:00:00", {"amount": 5.0}),
            (2, "2024-02-10T00:00:00", {"status": "failed"}),
        ],
    )
    last = snapshots.last_complete_month_end(trades)
    assert last == date(2024, 11, 30)
    got = {str(r["observation_date"]): r for r in snapshots.build_snapshots(trades, last).collect()}
    assert len(got) == 11 and {r["user_id"] for r in got.values()} == {1}
    jan, feb, mar, may, nov = (got[d] for d in ("2024-01-31", "2024-02-29", "2024-03-31", "2024-05-31", "2024-11-30"))
    assert (jan["recency_days"], jan["transactions_90d"], jan["failed_ratio_90d"], jan["target_repeat_30d"]) == (21, 1, 0.5, 1)
    assert (feb["target_repeat_30d"], feb["transactions_all"]) == (1, 1)
    assert (mar["transactions_90d"], mar["total_volume_90d"], mar["target_repeat_30d"]) == (2, 40.0, 0)
    assert (may["transactions_90d"], may["transactions_all"], may["recency_days"]) == (0, 2, 91)
    assert (nov["target_repeat_30d"], nov["total_volume_90d"]) == (1, 0.0)


def test_export_all(spark, tmp_path):
    cells = {"confusion": lambda i: confusion(i.mart, "a", "b", ["x"])}
    frame = spark.createDataFrame([("x", "x")], "a string, b string")
    inputs = catalogue.Inputs(frame, frame, frame, frame, frame, frame)
    took = catalogue.export_all(inputs, str(tmp_path), exports=cells)
    assert took["confusion"] > 0
    assert catalogue.export_all(inputs, str(tmp_path), exports=cells)["confusion"] is None
