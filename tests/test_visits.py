"""Visit rules against a plain walk over all views."""

import datetime as dt
import random

from riverbed.operators import visits


def walk(rows):
    anchors, used, kept = {}, {}, set()
    for client, path, ts, event in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        minute, day = int(ts.timestamp() // 60), (ts + dt.timedelta(hours=8)).date()
        anchor = anchors.get((client, day, path))
        if (anchor is None or minute - anchor >= 30) and used.get((client, minute), 0) < 60:
            anchors[client, day, path] = minute
            used[client, minute] = used.get((client, minute), 0) + 1
            kept.add(event)
    return kept


def test_first_views_equal_a_plain_walk(spark):
    rng = random.Random(3)
    begin = dt.datetime(2024, 1, 1, 12, tzinfo=dt.UTC)
    at = lambda seconds: begin + dt.timedelta(seconds=seconds)
    rows = [(c, f"/{rng.randrange(4)}", at(rng.randrange(20_000)), 0) for c in range(5) for _ in range(200)]
    rows += [(9, f"/{k}", at(60 * m + k % 50), 0) for m in (0, 1, 31, 32) for k in range(90)]  # more than 60 paths a minute
    rows = [(c, p, t, k) for k, (c, p, t, _) in enumerate(rows)]
    views = spark.createDataFrame([(c, p, t.replace(tzinfo=None), k) for c, p, t, k in rows], "client long, path string, ts timestamp_ntz, event_id long")
    got = visits.counted(views).collect()
    assert len(got) == len(rows) and {r.event_id for r in got if r.counted} == walk(rows)
