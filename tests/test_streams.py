"""Stateful streams over several batches, with late rows, restarts and quiet areas."""

import datetime as dt
import os

import numpy as np
import pytest

from heatloom.streaming import forecast as S

SCHEMA = "aoi_id int, valid_time timestamp, heat_index_c double"
BASE = dt.datetime(2023, 1, 1)


class Feed:
    """A folder of files, one micro-batch each, read in the order of writing."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0

    def add(self, rows):
        part = self.path / f"tmp-{self.n}"
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(part))
        (self.path / "in").mkdir(exist_ok=True)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = self.path / "in" / f"{self.n:04d}.parquet"
        os.link(part / file, target)
        os.utime(target, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def stream(self):
        return S.read_forecast_stream(self.spark, str(self.path / "in"), self.spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def at(day, hour=12.0):
    return BASE + dt.timedelta(days=day, hours=hour)


def state_rows(query):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]


def sessions(rows, threshold, gap=dt.timedelta(days=1)):
    out = []
    for area in sorted({r[0] for r in rows}):
        for _, t, v in sorted(r for r in rows if r[0] == area and r[2] > threshold):
            if out and out[-1][0] == area and t - out[-1][2] < gap:
                out[-1] = (area, out[-1][1], t, out[-1][3] + 1, max(out[-1][4], v))
            else:
                out.append((area, t, t, 1, v))
    return sorted((a, s, e + gap, n, m) for a, s, e, n, m in out)


def test_episodes_are_written_once_and_leave_the_state(spark, tmp_path):
    rng = np.random.default_rng(3)
    feed, rows = Feed(spark, tmp_path), []
    for b in range(4):  # batches overlap by a day: late, but within the lateness
        part = [(int(a), at(b * 6 - (b > 0) + float(d), 0), float(30 + 15 * rng.random())) for a in (1, 2) for d in rng.uniform(0, 7, 25)]
        rows += part
        feed.add(part)
    feed.add([(3, at(60), 10.0)])  # a cool reading elsewhere moves the watermark
    got = S.run_available(S.stream_heat_episodes(feed.stream(), 38.0), "e", ["aoi_id", "start"], "append", folder=str(tmp_path / "run")).collect()
    assert sorted(tuple(r) for r in got) == sessions(rows, 38.0)
    # nothing is open after the last batch; a second start has nothing left to do
    feed.add([(3, at(61), 10.0)])
    query = S.run_batches(S.stream_heat_episodes(feed.stream(), 38.0), str(tmp_path / "run"), "append")
    assert state_rows(query)[-1] == 0
    assert spark.read.parquet(str(tmp_path / "run/out")).count() == len(got)


def test_an_open_episode_is_not_written_yet(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([(1, at(0), 40.0), (1, at(0, 20), 41.0), (1, at(2.5), 20.0)])
    stream = lambda: S.stream_heat_episodes(feed.stream(), 38.0)
    run = lambda: S.run_available(stream(), "e", [], "append", folder=str(tmp_path / "run")).collect()
    assert run() == []
    feed.add([(1, at(1), 42.0)])  # late, joins the session
    feed.add([(1, at(30), 20.0)])
    assert [tuple(r) for r in run()] == [(1, at(0), at(2), 3, 42.0)]


def runs_of(days):
    last = max(days)
    n = 1
    while last - n in days:
        n += 1
    return last, n


@pytest.mark.parametrize("restart", [False, True])
def test_alert_over_400_days_with_late_rows(spark, tmp_path, restart):
    """Area 1 is hot on all but a few days, in disorder within the lateness; area 2 falls quiet early."""
    rng = np.random.default_rng(5)
    hot = {d for d in range(400) if d not in (37, 200, 333)}
    epoch = (BASE - dt.datetime(1970, 1, 1)).days
    feed, seen, want = Feed(spark, tmp_path), set(), []
    stream = lambda: S.stream_heatwave_alert(feed.stream(), 38.0)
    held_back = set()
    for b in range(8):
        days = {d for d in hot if d // 50 == b} | held_back
        held_back = {d for d in days if d % 50 == 49}  # comes a batch later, within two days of the newest
        now = sorted(days - held_back, key=lambda d: rng.random())
        feed.add([(1, at(d, float(rng.uniform(0, 23))), 40.0) for d in now] + [(1, at(d, 1.0), 45.0) for d in now[:3]]
                 + ([(2, at(3), 39.0), (2, at(4), 39.0)] if b == 0 else []))
        seen |= set(now)
        want.append(runs_of(seen))
        if restart and b % 3 == 1:
            S.run_batches(stream(), str(tmp_path / "run"), "update", S.ROCKSDB)
    feed.add([(9, at(500), 10.0)])
    query = S.run_batches(stream(), str(tmp_path / "run"), "update", S.ROCKSDB)
    out = spark.read.parquet(str(tmp_path / "run/out")).where("aoi_id = 1").orderBy("batch").collect()
    assert [(r["last_day"] - epoch, r["run_days"], r["alert"]) for r in out] == [(d, n, n >= 3) for d, n in want]
    rows = state_rows(query)
    assert rows[-1] == 0 and max(rows) <= 4  # a value and a timer for each area that is hot just now


def test_too_late_readings_change_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([(1, at(10), 40.0), (1, at(11), 40.0)])
    feed.add([(1, at(20), 40.0)])
    feed.add([(1, at(12), 40.0), (1, at(21), 40.0)])  # day 12 is behind the watermark of day 18
    out = S.run_available(S.stream_heatwave_alert(feed.stream(), 38.0), "a", ["aoi_id"], folder=str(tmp_path / "run"), state_store=S.ROCKSDB)
    assert [r["run_days"] for r in out.collect()] == [2]


def test_cool_readings_reach_no_state(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([(a, at(d), 20.0) for a in range(20) for d in range(5)])
    assert S.run_available(S.stream_heatwave_alert(feed.stream(), 38.0), "a", ["aoi_id"], folder=str(tmp_path / "run"), state_store=S.ROCKSDB).count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != S.ROCKSDB
