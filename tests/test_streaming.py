import datetime as dt

from riverbed.streaming import visits

SCHEMA = "client long, path string, ts timestamp, event_id long"


def stream(spark, tmp_path, rows):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    return visits.read_events(spark, str(tmp_path / "in" / "*"), SCHEMA)


def at(minute):
    return dt.datetime(2024, 1, 1, 3) + dt.timedelta(minutes=minute)


def test_state_outlives_a_batch(spark, tmp_path):
    views = stream(spark, tmp_path, [[(1, "/a", at(0), 1), (1, "/a", at(29), 2), (2, "/a", at(5), 3)], [(1, "/a", at(30), 4), (1, "/a", at(59), 5), (1, "/b", at(31), 6)]])
    visits.drain(visits.first_views(views), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3, 4, 6}


def test_visitors_count_once_a_day(spark, tmp_path):
    views = stream(spark, tmp_path, [[(1, "/a", at(0), 1), (1, "/b", at(1), 2)], [(1, "/c", at(2), 3), (2, "/a", at(3), 4), (1, "/a", at(24 * 60), 5)]])
    visits.drain(visits.visitors_by_day(views), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("day").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2]
