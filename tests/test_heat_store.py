"""Stored hourly heat: only what changed is written, and a late file changes what a batch run would."""

import datetime as dt
import random

from pyspark.sql import functions as F

from riverbed.operators import heat_store
from riverbed.streaming import late

SIGNALS = "story long, participant long, editorial boolean, ts timestamp_ntz"
START = dt.datetime(2024, 1, 1)


def hours(n):
    return START + dt.timedelta(hours=n)


def made(n, seed):
    rng = random.Random(seed)
    return [(rng.randint(1, 5), rng.randint(1, 8), rng.random() < 0.3, START + dt.timedelta(minutes=rng.randint(0, 100 * 60))) for _ in range(n)]


def plain(signals, wanted, behind=lambda p, h: False):
    out = {}
    for story, hour in wanted:
        seen = {}
        for s, p, e, ts in signals:
            if s == story and hour - dt.timedelta(hours=72) < ts <= hour:
                before = seen.get(p, (ts, False))
                seen[p] = (max(before[0], ts), before[1] or e)
        if seen:
            heat = round(sum(0.5 ** ((hour - ts).total_seconds() / 86400) for ts, _ in seen.values()), 6)
            out[story, hour] = (int(heat * 100 + 0.5) / 10, len(seen), sum(e for _, e in seen.values()), not any(behind(p, hour) for p in seen))
    return out


def rows(df):
    got = df.collect()
    out = {(r.story, r.hour): (r.heat, r.participants, r.editorial, r.complete) for r in got}
    assert len(out) == len(got)
    return out


def files(spark, path):
    return {f.rsplit("/", 2)[1]: f for f in spark.read.parquet(path).inputFiles()}


def test_a_second_run_touches_incomplete_hours_only(spark, tmp_path):
    signals, path, staging = made(150, 1), str(tmp_path / "heat"), str(tmp_path / "staging")
    df = spark.createDataFrame(signals, SIGNALS)
    clock = lambda n, behind: spark.createDataFrame([(p, hours(n - 30) if p in behind else hours(n)) for p in range(1, 9)], "participant long, fetched_to timestamp_ntz")
    for n in (40, 41, 70):
        heat_store.snapshot(spark, path, df, clock(n, {2, 3}), F.lit(hours(n)), staging)
    stored = rows(heat_store.stored(spark, path))
    at = {(s, hours(n)) for s in range(1, 6) for n in (40, 41, 70)}
    # at 70, sources 2 and 3 were read up to 40: hour 40 is complete now, 41 and 70 are not
    assert stored == plain(signals, at, lambda p, h: p in {2, 3} and h > hours(40))
    assert not all(v[3] for v in stored.values()) and any(v[3] for v in stored.values())
    before = files(spark, path)
    # nothing is new: nothing is written
    assert heat_store.snapshot(spark, path, df, clock(70, {2, 3}), F.lit(hours(70)), staging) == {"stories": 0, "repaired": 0}
    assert files(spark, path) == before
    # the sources have caught up: the incomplete hours alone are repaired
    done = heat_store.snapshot(spark, path, df, clock(70, set()), F.lit(hours(70)), staging)
    open_ = {k for k, v in stored.items() if not v[3]}
    assert done["stories"] + done["repaired"] == len(open_) and rows(heat_store.stored(spark, path)) == plain(signals, at)
    days = {d for d, f in files(spark, path).items() if before.get(d) != f}
    assert days == {f"day={h.date()}" for _, h in open_}


def test_backfill_covers_a_storys_history(spark, tmp_path):
    signals, path = made(80, 2), str(tmp_path / "heat")
    df = spark.createDataFrame(signals + [(None, 1, True, START), (1, None, True, START), (1, 1, True, None)], SIGNALS)
    stories = spark.createDataFrame([(1,), (2,), (99,)], "story long")
    clocks = spark.createDataFrame([], "participant long, fetched_to timestamp_ntz")
    n = heat_store.backfill(spark, path, df, stories, clocks, F.lit(hours(90)), str(tmp_path))
    wanted = {(s, hours(h)) for s in (1, 2) for h in range(0, 91)}
    want = plain(signals, wanted)
    assert rows(heat_store.stored(spark, path)) == want and n == len(want)
    # a regrouping moves a participant's signals: the same call puts it right
    moved = [(2 if s == 1 and p < 4 else s, p, e, ts) for s, p, e, ts in signals]
    heat_store.backfill(spark, path, spark.createDataFrame(moved, SIGNALS), stories, clocks, F.lit(hours(90)), str(tmp_path))
    again = plain(moved, wanted)
    got = rows(heat_store.stored(spark, path))
    assert all(got[k] == v for k, v in again.items())


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SIGNALS)
    assert heat_store.merge(spark, str(tmp_path / "h"), heat_store.hourly_rows(none, none.select("story", F.col("ts").alias("hour")), None), str(tmp_path)) == 0
    assert heat_store.stored(spark, str(tmp_path / "h")).count() == 0


ARRIVALS = "event_id long, story long, participant long, editorial boolean, claimed timestamp, discovered timestamp"


def test_filing(spark):
    cases = [(None, 10), (12, 10), (11, 10), (10, 10), (-38, 10), (-39, 10)]
    df = spark.createDataFrame([(k, None if c is None else hours(c), hours(d)) for k, (c, d) in enumerate(cases)], "k int, claimed timestamp_ntz, discovered timestamp_ntz")
    got = {r.k: (r.reason, r.filed_at, r.historical) for r in late.filed(df).collect()}
    assert got == {0: ("unknown-publication-time", hours(10), True), 1: ("unknown-publication-time", hours(10), True), 2: (None, hours(10), False), 3: (None, hours(10), False), 4: (None, hours(10), False), 5: ("stale-on-discovery", hours(-39), True)}
    given = {r.k: (r.reason, r.filed_at, r.historical) for r in late.filed(df, given=F.lit("import")).collect()}
    assert given[3] == ("import", hours(10), False) and given[4] == ("import", hours(-38), False) and given[0] == ("import", hours(10), True)


def test_a_late_file_changes_what_a_batch_run_would(spark, tmp_path):
    rng = random.Random(5)
    parts, n = [], 0
    for part, (lo, hi) in enumerate(((0, 30), (25, 50), (10, 52), (90, 120))):  # the third comes late
        batch = []
        for _ in range(40):
            found = hours(lo) + dt.timedelta(minutes=rng.randint(0, (hi - lo) * 60))
            claimed = rng.choice([found, found - dt.timedelta(hours=rng.randint(0, 60)), None, found + dt.timedelta(hours=2)])
            batch.append((n, rng.choice([1, 2, 3, None]), rng.choice([*range(1, 7), None]), rng.random() < 0.5, claimed, found))
            n += 1
        parts.append(batch + parts[-1][:5] if parts else batch)  # some are sent again
        spark.createDataFrame(parts[-1], ARRIVALS).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    source = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    sink = late.LateHeat(str(tmp_path / "out"))
    late.run(source, sink, str(tmp_path / "cp"))
    live, dead = [], 0
    for e, s, p, ed, claimed, found in {r[0]: r for part in parts for r in part}.values():
        published = claimed if claimed and claimed <= found + dt.timedelta(hours=1) else None
        stale = published is not None and found - published > dt.timedelta(hours=48)
        if s is None or p is None or published is None or stale:
            dead += 1
        else:
            live.append((s, p, ed, found, found))
    now = max(r[4] for r in live)
    wanted = {(s, hours(h)) for s in (1, 2, 3) for h in range(0, 125) if hours(h) <= now}
    assert rows(heat_store.stored(spark, sink.heat)) == plain([r[:4] for r in live], wanted)
    letters = spark.read.parquet(sink.letters)
    assert letters.count() == dead and letters.filter("why is null").count() == 0
    # a batch that is run again changes nothing
    before = rows(heat_store.stored(spark, sink.heat))
    sink(spark.read.parquet(str(tmp_path / "in" / "3")).withColumn("claimed", F.col("claimed").cast("timestamp_ntz")).withColumn("discovered", F.col("discovered").cast("timestamp_ntz")), 3)
    assert rows(heat_store.stored(spark, sink.heat)) == before
