"""Jobs that keep stored tables: restarts, repeated batches, late and repeated rows, bounded state."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from dekadal.functions import calendar as cal
from dekadal.sources import history, sinks
from dekadal.streaming import incremental

D = dt.date


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def sums(rows):
    """The plain rule: by key, in order of time, of the last value that came for each."""
    last = {}
    for batch in rows:
        own = {}
        for k, d, i, v in batch:
            own[k, d, i] = v if own.get((k, d, i)) is None else max(own[k, d, i], v if v is not None else own[k, d, i])
        last |= own
    out, total = {}, {}
    for (k, d, i), v in sorted(last.items()):
        total[k] = total.get(k, 0.0) + (v or 0.0)
        out[k, d, i] = (v, total[k])
    return out


SCHEMA = "k string, date date, i int, value double"


def test_running_sums_as_a_stream(spark, tmp_path):
    rng = random.Random(3)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    some = lambda lo, hi, n: [(rng.choice("abc"), day(rng.randrange(lo, hi)), rng.randrange(50), float(rng.randrange(100))) for _ in range(n)]
    batches = [some(0, 12, 40), some(12, 25, 40), [*some(25, 40, 30), ("d", day(26), 0, 5.0)], some(3, 38, 30), [], [("e", day(70), 0, 1.0), ("a", day(70), 0, None)]]
    batches[3] += [(*r[:3], r[3] + 1) for r in batches[0][:10]] + batches[1][:5] + batches[3][:5]  # revisions, rows that come again, repeats
    path, target, ends = (str(tmp_path / n) for n in ("in", "sums", "ends"))
    run = lambda state: incremental.cumulative_stream(incremental.parquet_stream(spark, path, SCHEMA), target, ends, str(tmp_path / state), ["k"], ["date", "i"]).awaitTermination()
    held = lambda: {(r.k, r.date, r.i): (r.value, r.cumulative) for r in spark.read.parquet(target).collect()}
    for n, batch in enumerate(batches):
        put(spark, path, batch, SCHEMA)
        run("state")  # a restart for each file
        got, want = held(), sums(batches[: n + 1])
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-9 for x in want)
    before = held()
    run("state")  # nothing new
    assert held() == before
    incremental.cumulative_stream(incremental.parquet_stream(spark, path, SCHEMA, 1), target, ends, str(tmp_path / "lost"), ["k"], ["date", "i"]).awaitTermination()
    assert {k for k in held()} == set(before)  # all files again, as after a lost checkpoint: the later ones win again
    last = {r.k: r.end for r in spark.read.parquet(ends).where("period = '2020-03-11'").collect()}
    assert last.keys() == set("abcde") and last["d"] == 5.0  # carried on over periods without rows


def test_sums_in_order_touch_their_newest_period_alone(spark, tmp_path):
    path, target, ends = (str(tmp_path / n) for n in ("in", "sums", "ends"))
    seen = None
    for n in range(3):
        put(spark, path, [("a", D(2020, 1, 1 + 10 * n), 0, 1.0)], SCHEMA)
        incremental.cumulative_stream(incremental.parquet_stream(spark, path, SCHEMA), target, ends, str(tmp_path / "state"), ["k"], ["date", "i"]).awaitTermination()
        now = files(target) | files(ends)
        assert seen is None or seen.items() <= now.items()
        seen = now
    assert sorted(r.cumulative for r in spark.read.parquet(target).collect()) == [1.0, 2.0, 3.0]


def test_revisions_as_a_stream(spark, tmp_path):
    target, late, path = (str(tmp_path / n) for n in ("history", "late", "in"))
    schema = "series string, value double, date date"
    days = [r.date for r in cal.dekad_spine(spark, "2020-01-01", "2020-12-31").orderBy("date").collect()]
    sinks.overwrite_parts(spark.createDataFrame([(s, float(k), d) for s in "ab" for k, d in enumerate(days[:30])], schema), target, ["date"])
    revised = [[("a", -1.0, days[28]), ("a", -2.0, days[11]), ("a", -3.0, days[3])], [("b", -4.0, days[31]), ("b", -5.0, days[31]), ("b", -6.0, days[12])], [("a", -7.0, days[13]), ("a", -8.0, days[12]), ("a", -8.0, None)]]
    for batch in revised:
        put(spark, path, batch, schema)
    untouched = files(f"{target}/date={days[5]}")
    run = lambda state: incremental.refresh_stream(incremental.parquet_stream(spark, path, schema), target, late, str(tmp_path / state)).awaitTermination()
    held = lambda: (sorted(map(tuple, sinks.stored(spark, target, schema).collect())), sorted((r.series, r.value) for r in sinks.stored(spark, late, schema).collect()))
    # files come in the order of their names; the newest dekad before a batch decides which of its rows are late
    run("state")
    rows, missed = held()
    assert len(rows) == 61 and ("b", -4.0, days[31]) in rows and ("a", -1.0, days[28]) in rows
    assert ("a", -2.0) in missed and ("a", -3.0) in missed and ("a", -8.0) in missed and len(missed) + sum(r[1] < 0 for r in rows) == 8
    run("lost")  # every batch once more, by its number
    assert held() == (rows, missed) and files(f"{target}/date={days[5]}") == untouched


def test_windows_as_a_stream_hold_few_dekads(spark, tmp_path):
    path, target = str(tmp_path / "in"), str(tmp_path / "dekads")
    schema, rng = "ts timestamp, value double, kind string", random.Random(4)
    start, want = dt.datetime(2020, 1, 1), {}
    for n in range(12):  # a month a file, with some rows of the month before
        rows = [(start + dt.timedelta(30 * n - 20 + rng.random() * 50), float(rng.randrange(9)), rng.choice("xy")) for _ in range(60)]
        put(spark, path, rows, schema)
        for t, v, k in rows:
            c = want.setdefault((D(t.year, t.month, min(t.day - 1, 20) // 10 * 10 + 1), k), [0, 0.0])
            c[0] += 1
            c[1] += v
    stream = lambda: incremental.parquet_stream(spark, path, schema)
    job = incremental.tumbling_dekad_stream(stream(), target, str(tmp_path / "state"), keys=["kind"], late="40 days")
    job.awaitTermination()
    got = {(r.dekad, r.kind): [r.n, r.total] for r in spark.read.parquet(target).collect()}
    assert got == want and len(want) > 70
    held = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress if p["stateOperators"]]
    assert max(held) <= 50 < len(want) and sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in job.recentProgress if p["stateOperators"]) == 0


def test_a_stored_tail_is_replaced_at_once(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "history"), "series string, value double, date date"
    days = [r.date for r in cal.dekad_spine(spark, "2020-01-01", "2020-12-31").orderBy("date").collect()]
    rows = lambda v, own: spark.createDataFrame([(s, v, d) for s in "ab" for d in own], schema)
    history.store_history(rows(0.0, days[:30]), path)
    held = lambda df: sorted((r.date, r.series, r.value) for r in df.collect())
    reader, old = history.read_history(spark, path), files(path)
    before = held(reader)
    history.refresh_stored_tail(path, rows(1.0, [d for d in days[5:33] if d != days[20]]), 18)
    got = held(history.read_history(spark, path))
    assert {d for d, _, _ in got} == set(days[:33]) - {days[20]} and {d for d, _, v in got if v == 1.0} == set(days[12:33]) - {days[20]}
    assert old.items() <= files(path).items()  # what was there is there, with its times
    assert held(reader) == before  # a reader of the version before still has it whole
    # a commit that ends before its manifest leaves readers what they had
    monkeypatch.setattr(type(reader), "unionByName", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        history.refresh_stored_tail(path, rows(2.0, days[:36]), 18)
    monkeypatch.undo()
    assert held(history.read_history(spark, path)) == got
    history.refresh_stored_tail(path, rows(3.0, days[33:34]), 0)
    assert len(held(history.read_history(spark, path))) == len(got) + 2
    history.store_history(rows(4.0, days[:2]), path)
    assert len(held(history.read_history(spark, path))) == 4


def test_upsert_keeps_the_largest_of_repeats(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([(1, 1.0, "p"), (1, 3.0, "p"), (2, None, "p"), (3, 1.0, "q")], [(2, 5.0, "p"), (4, None, "p"), (4, 2.0, "p")]):
        sinks.upsert(spark.createDataFrame(rows, "k int, v double, part string"), path, ["k", "part"], ["part"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 3.0), (2, 5.0), (3, 1.0), (4, 2.0)]
    sinks.upsert(spark.createDataFrame([], "k int, v double, part string"), path, ["k", "part"], ["part"])
    assert spark.read.parquet(path).where(F.col("k") == 3).count() == 1
