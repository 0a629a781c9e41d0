import pytest
from pyspark.sql import types as T

from alertlift.sources import load_alerts, load_predictions, staging, write_predictions, write_table

from helpers import plan, rows

CSV = """airport,alert_id,duration_minutes,n_lightnings,start_time,lat_std,novelty
Nord,1,12.5,5.0,2017-09-10 03:40:05+00:00,NaN,1.5
,2,7,,2018-01-01 00:00:00+00:00,0.25,2.5
Sud,3,NaN,9,2018-01-01 00:00:00+00:00,,3.5
"""


@pytest.fixture
def alerts_csv(tmp_path):
    path = tmp_path / "alerts.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_types_and_missing_values(spark, alerts_csv):
    df = load_alerts(spark, alerts_csv)
    types = dict(df.dtypes)
    assert types["alert_id"] == "bigint" and types["n_lightnings"] == "bigint"
    assert types["start_time"] == "timestamp" and types["novelty"] == "double"
    got = rows(df.select("airport", "duration_minutes", "n_lightnings", "lat_std"), "novelty")
    assert got == [("Nord", 12.5, 5, None), (None, 7.0, None, 0.25), ("Sud", None, 9, None)]


def test_whole_numbers_stay_exact(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("alert_id,alert_airport_id\n2.0,9007199254740993\n3,9007199254740992\n")
    got = rows(load_alerts(spark, str(path)).select("alert_id", "alert_airport_id"), "alert_id")
    assert got == [(2, 9007199254740993), (3, 9007199254740992)]


@pytest.mark.parametrize(
    "column, cell", [("duration_minutes", "long"), ("alert_id", "x7"), ("alert_airport_id", "1.5"), ("alert_airport_id", "99999999999999999999")]
)
def test_an_unreadable_cell_is_an_error(spark, tmp_path, column, cell):
    path = tmp_path / "bad.csv"
    path.write_text(f"airport,{column}\nNord,{cell}\n")
    with pytest.raises(Exception, match=f"column {column}: not a .*{cell}"):
        load_alerts(spark, str(path)).collect()


def test_missing_markers_and_guessed_types(spark, tmp_path):
    path = tmp_path / "na.csv"
    path.write_text("airport,duration_minutes,a,b,c,d\nNA,N/A,1,1,x,NA\nNord,2,nan,2.5,None,\n-,null,3,NULL,y,n/a\n")
    df = load_alerts(spark, str(path))
    assert [dict(df.dtypes)[c] for c in "abcd"] == ["bigint", "double", "string", "string"]
    assert rows(df, "b") == [("-", None, 3, None, "y", None), (None, None, 1, 1.0, "x", None), ("Nord", 2.0, None, 2.5, None, None)]


def test_first_source_that_exists(spark, alerts_csv, tmp_path):
    df = load_alerts(spark, [str(tmp_path / "missing.csv"), alerts_csv])
    assert df.count() == 3
    with pytest.raises(FileNotFoundError):
        load_alerts(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])


def test_schema_by_name_not_position(spark, alerts_csv):
    schema = T.StructType(
        [T.StructField("novelty", T.StringType()), T.StructField("alert_id", T.LongType())]
    )
    df = load_alerts(spark, alerts_csv, schema)
    assert rows(df.select("alert_id", "novelty"), "alert_id")[0] == (1, "1.5")


def test_old_prediction_names(spark, tmp_path):
    old = spark.createDataFrame([(1.0, 2.0)], "duration_true double, duration_pred_best double")
    path = write_table(old, str(tmp_path / "p"))
    assert load_predictions(spark, path).columns == ["duration_true", "duration_pred"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, alerts_csv, tmp_path, fmt):
    df = load_alerts(spark, alerts_csv)
    path = write_table(df, str(tmp_path / "out"), fmt)
    write_table(df, path, fmt)
    again = load_alerts(spark, path, fmt=fmt)
    assert rows(again, "alert_id") == rows(df, "alert_id")


def test_one_model_is_read_from_its_own_folder(spark, tmp_path):
    preds = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "alert_id long, model string, duration_pred double")
    path = write_predictions(preds, str(tmp_path / "p"))
    best = spark.read.parquet(path).where("model = 'a'")
    assert best.count() == 1
    assert "PartitionFilters: [isnotnull(model" in plan(best).replace("\n", " ")


def test_filters_and_columns_reach_the_files(spark, alerts_csv, tmp_path):
    path = write_table(load_alerts(spark, alerts_csv), str(tmp_path / "q"))
    text = plan(load_alerts(spark, path, fmt="parquet").where("airport = 'Sud'").select("airport", "lat_std"))
    assert "EqualTo(airport,Sud)" in text
    assert "ReadSchema: struct<airport:string,lat_std:double>" in text


def test_staged_tables_live_in_the_shared_folder(spark):
    root = staging.staging_root(spark)
    setting = spark.conf.get("spark.checkpoint.dir", None)
    assert setting is None or root == setting.rstrip("/")
    df = staging.stage(spark.range(10))
    assert root in df.inputFiles()[0]
    assert df.count() == 10


def test_a_scope_deletes_what_it_staged(spark):
    with staging.staged_scope(spark):
        gone = staging.stage(spark.range(10))
        kept = staging.keep_staged(gone.filter("id > 4"))
    assert kept.count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        gone.count()
