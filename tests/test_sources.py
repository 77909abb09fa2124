import datetime as dt

import pytest

from appconv.names import EVENT_LOG_SCHEMA, REQUEST_COLUMNS
from appconv.session import checkpoint_dir
from appconv.sources import (
    cut_lineage,
    event_days,
    preview,
    read_app_map,
    read_orc_events,
    read_quoted_log,
    read_request_csv,
    read_request_log,
    read_requests,
    stage,
)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quoted_log(spark, tmp_path):
    (tmp_path / "log").write_text(
        '"u1" , "a1", 2018-05-01 \nu2,a2\nu3,"a,3",2018-05-02,extra\n "u4","  a4",\t2018-05-03\t\n'
    )
    assert _rows(read_quoted_log(spark, str(tmp_path / "log"), EVENT_LOG_SCHEMA)) == [
        ("u1", "a1", "2018-05-01"),
        ("u2", "a2", None),
        ("u3", "a", "3"),
        ("u4", "  a4", "2018-05-03"),
    ]


REQUEST_LINE = "2018-05-01,u1,94,3,v1,phone,m1,1,7"
REQUEST_ROW = ("2018-05-01", "u1", "phone", "v1", "m1", "3", "94", "1")


def test_request_files(spark, tmp_path):
    (tmp_path / "x_part0").write_text(REQUEST_LINE + "\n")
    (tmp_path / "x_part1").write_text(REQUEST_LINE.replace("u1", "u2") + "\n")
    (tmp_path / "log").write_text('"' + REQUEST_LINE.replace(",", '" , "') + '"\n')
    log = read_request_log(spark, str(tmp_path / "log"))
    assert log.columns == REQUEST_COLUMNS and _rows(log) == [REQUEST_ROW]
    assert {r["request_uid"] for r in read_request_csv(spark, str(tmp_path / "x_part*")).collect()} == {"u1", "u2"}


def test_app_map(spark, tmp_path):
    (tmp_path / "map.csv").write_text("g1,a1\ng1,a1\nNULL,a2\ng3,NULL\ng4,\n")
    assert _rows(read_app_map(spark, str(tmp_path / "map.csv"))) == [("g1", "a1")]


def test_requests_by_day(spark, tmp_path):
    schema = ", ".join(f"{c} string" for c in [*REQUEST_COLUMNS, "other"])
    for day in ("2018-05-01", "2018-05-02", "2018-05-03"):
        row = (day, *REQUEST_ROW[1:], "x")
        other = (day, *REQUEST_ROW[1:], "y")
        spark.createDataFrame([row, other], schema).write.parquet(str(tmp_path / day))
    got = read_requests(spark, str(tmp_path), "2018-05-03", 2)
    assert got.columns == REQUEST_COLUMNS
    assert _rows(got) == [("2018-05-02", *REQUEST_ROW[1:]), ("2018-05-03", *REQUEST_ROW[1:])]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_requests(spark, str(tmp_path), "2018-05-04", 2)


def test_orc_by_position(spark, tmp_path):
    names = [f"c{i}" for i in range(15)]
    schema = ", ".join(f"{n} {'timestamp' if n == 'c10' else 'string'}" for n in names)
    row = [str(i) for i in range(15)]
    for hour, day in ((0, 1), (1, 1), (0, 2), (0, 3)):
        row[10] = dt.datetime(2018, 5, day, 12, 30)
        path = f"{tmp_path}/load_time=2018/05/{day:02d}{hour:02d}"
        spark.createDataFrame([tuple(row)], schema).write.orc(path)
    events = read_orc_events(spark, str(tmp_path), "2018-05-02", 2)
    assert events.dtypes == [("request_uid", "string"), ("request_date", "timestamp"), ("app_id", "string")]
    assert _rows(event_days(events, "2018-05-01", "2018-05-08")) == [
        ("6", "14", "2018-05-01"),
        ("6", "14", "2018-05-02"),
    ]
    assert _rows(event_days(events, "2018-05-02", "2018-05-08")) == [("6", "14", "2018-05-02")]


def test_staging(spark, tmp_path):
    df = spark.range(50)
    path = str(tmp_path / "t")
    assert stage(df, path).count() == 50
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        stage(df, path)
    assert stage(df, path, "overwrite").count() == 50
    staged = cut_lineage(df)
    assert staged.inputFiles()[0].replace("file:", "").lstrip("/").startswith(
        checkpoint_dir(spark).replace("file:", "").lstrip("/")
    )
    assert preview(df).count() == 20
