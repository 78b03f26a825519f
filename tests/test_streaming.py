"""Streams with state of their own: what is late is told, and what a timer closes leaves the state."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyloom.streaming import jobs, stateful

DAY0 = dt.datetime(2024, 3, 1, 6)


def deliver(spark, rows, path):
    df = spark.createDataFrame(rows, "k long, ts timestamp, v double, id long")
    df.repartition(3).write.mode("append").parquet(path)
    return df.schema


def at(day, hour=0):
    return DAY0 + dt.timedelta(days=day, hours=hour)


def test_dry_spells_go_on_over_deliveries_and_end(spark, tmp_path):
    path, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    values = [5.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0]
    schema = deliver(spark, [(1, at(i), v / 2, i) for i, v in enumerate(values[:4])] + [(1, at(i, 3), v / 2, i) for i, v in enumerate(values[:4])], path)
    read = lambda: jobs.without_marks(jobs.read_new(spark, path, schema, late="2 days"), "id")
    run = lambda p=None: jobs.drain(stateful.dry_spells(read(), "k", "v", 1.0), "d", "append", mark, p)
    run()
    # out of order within the watermark; day 0 has been closed
    deliver(spark, [(1, at(6), 0.0, 6), (1, at(4), 5.0, 4), (1, at(5), 0.0, 5), (1, at(0, 9), 9.0, 7)], path)
    run()
    jobs.closing_mark(spark, path, schema, F.lit(at(60)))
    progress = []
    got = run(progress)
    assert [(r.last_day - 19783, r.length) for r in got.where("kind = 'run'").orderBy("last_day").collect()] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, 1), (6, 2)]
    assert [r.last_day - 19783 for r in got.where("kind = 'late'").collect()] == [0]


def test_state_of_keys_that_stop_is_dropped(spark, tmp_path):
    path, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    schema = deliver(spark, [(k, at(k // 100 * 10), 0.0, k) for k in range(400)], path)
    progress = []

    def run():
        stream = jobs.without_marks(jobs.read_new(spark, path, schema, late="1 day"), "id")
        return jobs.drain(stateful.dry_spells(stream, "k", "v", 1.0), "d", "append", mark, progress)

    run()
    jobs.closing_mark(spark, path, schema, F.lit(at(100)))
    got = run()
    assert got.where("kind = 'run' AND length = 1").select("k").distinct().count() == 400
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_a_key_has_one_value_and_one_timer_however_many_days_are_open(spark, tmp_path):
    path, mark, progress = str(tmp_path / "in"), str(tmp_path / "mark"), []
    schema = deliver(spark, [(1, at(i), 0.0, i) for i in range(30)], path)
    stream = jobs.without_marks(jobs.read_new(spark, path, schema, late="40 days"), "id")
    assert jobs.drain(stateful.dry_spells(stream, "k", "v", 1.0), "d", "append", mark, progress).count() == 0
    assert 0 < progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3


@pytest.mark.parametrize("salt", [1, 4])
def test_late_rows_are_those_of_closed_days(spark, tmp_path, salt):
    path, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    first, then = [(i % 2, at(i // 10), 1.0, i) for i in range(100)], [(i % 2, at(i - 100), 1.0, i) for i in range(100, 112)] + [(None, at(0), 1.0, 112), (None, at(11), 1.0, 113)]
    schema = deliver(spark, first, path)

    def run():
        stream = jobs.without_marks(jobs.read_new(spark, path, schema, late="3 days"), "id")
        return jobs.drain(stateful.daily_counts_and_late(stream, ["k"], "id", salt=salt), "late", "append", mark)

    run()
    deliver(spark, then, path)
    run()
    jobs.closing_mark(spark, path, schema, F.lit(at(60)))
    got = run()
    # the watermark stands at day 6, 06:00, so days 0 to 5 are closed
    late = [(k, i) for k, ts, _, i in then if ts < at(6) - dt.timedelta(hours=6)]
    assert sorted((r.k is None, r.k or 0, r.id) for r in got.where("kind = 'late'").collect()) == sorted((k is None, k or 0, i) for k, i in late)
    assert got.agg(F.sum("n")).first()[0] == len(first) + len(then)
    with_days = {(r.k, r.day): r.n for r in got.where("kind = 'day'").groupBy("k", "day").agg(F.sum("n").alias("n")).collect()}
    assert with_days[(0, 19783)] == 5 and with_days[(None, 19794)] == 1


def test_sessions_close_by_the_watermark(spark, tmp_path):
    path, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    schema = deliver(spark, [(1, at(0), 0.0, 1), (1, at(0, 5), 0.0, 2), (1, at(3), 0.0, 3), (2, at(1), 0.0, 4)], path)
    jobs.closing_mark(spark, path, schema, F.lit(at(30)))
    progress = []
    stream = jobs.without_marks(jobs.read_new(spark, path, schema, late="1 day"), "id")
    got = jobs.drain(jobs.acquisition_sessions(stream, ["k"], "12 hours"), "s", "append", mark, progress)
    assert sorted((r.k, r.start.replace(tzinfo=None), r.n) for r in got.collect()) == [(1, at(0), 2), (1, at(3), 1), (2, at(1), 1)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0
