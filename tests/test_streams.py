"""State in event-time order over micro-batches, chunks of time, and the journal source."""

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from zenithal.operators import chunks
from zenithal.sources import journal
from zenithal.streaming import alerts, cache, events, leases
from zenithal.streaming.inorder import ROCKS

H = 3_600_000


def test_hold_times_step_by_step():
    step = alerts.hold(10)
    assert step([(0, 1, True)], None, 5) == ([("pending", 0, 0)], ("pending", 0), 10)
    assert step([], ("pending", 0), 10) == ([("firing", 10, 0)], ("firing", 0), None)
    assert step([(10, 2, False)], ("pending", 0), 12) == ([("dropped", 10, 0)], None, None)  # false at the very moment
    assert step([(11, 2, False)], ("pending", 0), 12) == ([("firing", 10, 0), ("resolved", 11, 0)], None, None)
    assert step([(1, 1, True), (2, 2, False), (3, 3, True), (4, 4, True)], None, 13)[0] == [("pending", 1, 1), ("dropped", 2, 1), ("pending", 3, 3), ("firing", 13, 3)]


def test_a_cached_value_expires():
    step = cache.keep(10)
    assert step([(0, 1, True, 5.0), (9, 2, False, None), (10, 3, False, None)], None, 9) == ([(2, 9, 5.0, 9), (3, 10, None, None)], None, None)
    assert step([(0, 1, True, 5.0), (3, 2, True, 6.0)], None, 4) == ([], (6.0, 3), 13)
    assert step([], (6.0, 3), 13) == ([], None, None)
    assert step([(1, 1, True, None), (2, 2, False, None)], None, 2)[0] == [(2, 2, None, 1)]


def test_two_owners_never_hold_one_lease():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        at = rng.randrange(3000)
        rows += [(at, i, f"o{i % 3}", False), (at + rng.randrange(1, 200), i, f"o{i % 3}", True)]
    out, state, _ = leases.lease(100, 150)(rows, None, 10_000)
    runs = [r for r in out if r[2] == "run"]
    ends = {r[0]: r[3] for r in out if r[2] == "released"}
    assert [r[4] for r in runs] == list(range(1, len(runs) + 1)) and state[2] == len(runs)  # fencing numbers only grow
    for a, b in zip(runs, runs[1:], strict=False):
        assert b[3] >= min(ends.get(a[0], 1 << 60), a[3] + 100)  # released or expired before the next
        assert b[5] == b[3] // 150 - a[3] // 150 >= 1  # folded runs
    assert {r[2] for r in out} == {"run", "busy", "done", "released"} and all(e < a[3] + 100 for a in runs if (e := ends.get(a[0])))


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    """Four files; rows come up to an hour late, also in a later file than their time."""
    rng, start = random.Random(1), datetime.datetime(2024, 1, 1)
    rows = [(i, i % 7 if i % 50 else None, rng.random() * 100, start + datetime.timedelta(minutes=3 * i + rng.random())) for i in range(600)]
    late = sorted(rows, key=lambda r: r[3] + datetime.timedelta(minutes=55 * rng.random()))
    folder = tmp_path_factory.mktemp("samples")
    import os

    for i in range(4):
        spark.createDataFrame(late[i * 150 : (i + 1) * 150], "event_id long, user_id long, value double, ts timestamp").coalesce(1).write.parquet(f"{folder}/{i}")
        for name in os.listdir(f"{folder}/{i}"):
            os.utime(f"{folder}/{i}/{name}", (1000 + i, 1000 + i))
    return f"{folder}/*", rows


@pytest.mark.parametrize("files", [1, None])
def test_alerts_over_micro_batches_are_those_of_the_whole(spark, samples, files):
    path, rows = samples
    fn = lambda df: alerts.alert_states(df, "user_id", "ts", "event_id", F.col("value") > 50, H, "1 hour")
    got = events.run_once(spark, path, "event_id long, user_id long, value double, ts timestamp", fn, conf=ROCKS, files=files)
    ms = lambda t: int(t.replace(tzinfo=datetime.UTC).timestamp() * 1e6) // 1000
    mark = max(ms(r[3]) for r in rows) - H
    want = []
    for user in range(7):
        due = sorted((ms(t), i, v > 50) for i, u, v, t in rows if u == user and ms(t) <= mark)
        want += [(user, *x) for x in alerts.hold(H)(due, None, mark)[0]]
    assert sorted(map(tuple, got.collect())) == sorted(want) and {r[1] for r in want} == {"pending", "firing", "resolved", "dropped"}


def test_cache_expiry_over_micro_batches(spark, samples):
    path, rows = samples
    fn = lambda df: cache.cached(df, "user_id", "ts", "event_id", F.col("event_id") % 3 == 0, F.col("value"), H, "1 hour")
    got = events.run_once(spark, path, "event_id long, user_id long, value double, ts timestamp", fn, conf=ROCKS, files=1).collect()
    ms = lambda t: int(t.replace(tzinfo=datetime.UTC).timestamp() * 1e6) // 1000
    mark = max(ms(r[3]) for r in rows) - H
    want = set()
    for i, u, _, t in rows:
        if u is not None and i % 3 and ms(t) <= mark:
            before = max(((ms(t2), i2, v2) for i2, u2, v2, t2 in rows if u2 == u and i2 % 3 == 0 and (ms(t2), i2) < (ms(t), i)), default=None)
            hit = before is not None and ms(t) - before[0] < H
            want.add((u, i, ms(t), before[2] if hit else None, ms(t) - before[0] if hit else None))
    assert set(map(tuple, got)) == want and len(got) == len(want) and {r.cached is None for r in got} == {True, False}


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_chunks_are_rewritten_compacted_and_dropped(spark, tmp_path):
    table = chunks.TimeChunks(spark, f"file://{tmp_path}/t", "at", 10)
    frame = lambda rows: spark.createDataFrame(rows, "id long, at timestamp_ntz, v string")
    for i in range(3):
        table.append(frame([(j, day(j), "old") for j in range(i, 100, 3)]))
    files = {c["chunk"]: c["files"] for c in table.chunks()}
    assert all(n > 1 for n in files.values()) and len(files) == 11
    first = set(tmp_path.glob("t/chunk=*/part-*"))
    touched = table.upsert(frame([(5, day(5), "new"), (200, day(200), "new")]), ["id", "at"])
    assert len(touched) == 2 and len(first - set(tmp_path.glob("t/chunk=*/part-*"))) == files[touched[0]]  # no other chunk was written
    compacted = table.compact(day(60))
    after = {c["chunk"]: c["files"] for c in table.chunks()}
    assert compacted and all(after[c] == 1 for c in compacted) and max(compacted) * 10 + 10 <= (day(60) - datetime.datetime(1970, 1, 1)).days
    assert table.compact(day(60)) == []
    gone = table.retain(day(30))
    got = {(r.id, r.v) for r in table.read().collect()}
    limit = (max(gone) + 1) * 10 - (day(0) - datetime.datetime(1970, 1, 1)).days
    assert 0 < 30 - limit < 10 or limit == 30
    assert got == {(j, "old") for j in range(limit, 100)} | {(200, "new")}
    some = table.read(day(50), day(60))
    assert {r.id for r in some.collect()} == set(range(50, 60))
    assert re.search(r"PartitionFilters: \[[^\]]*chunk#\d+ >= ", some._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(Exception, match="has no chunk"):
        table.append(frame([(1, None, "x")]))


@pytest.fixture(scope="module")
def journals(spark):
    journal.add_journal(spark)
    return spark


def test_pushed_filters_drop_segments_and_rows(journals, tmp_path):
    path = f"file://{tmp_path}/j"
    rows = [(i, f"n{i % 5}" if i % 7 else None, datetime.date(2024, 1, 1) + datetime.timedelta(days=i), float("nan") if i == 3 else i / 2) for i in range(40)]
    for i in range(4):
        journals.createDataFrame(rows[10 * i : 10 * i + 10], "id long, name string, d date, x double").coalesce(1).write.format("journal").mode("append").save(path)
    whole = journals.read.format("journal").load(path)
    told = lambda df: sorted(map(str, df.collect()))
    plain = journals.createDataFrame(rows, whole.schema)
    assert told(whole) == told(plain)
    some = journal.read(journals, path, "id >= 12 and id < 17 and name is not null")
    assert {r.id for r in some.collect()} == {i for i in range(12, 17) if i % 7} and some.rdd.getNumPartitions() == 1
    assert not re.search(r"Filter .*id#", some._jdf.queryExecution().executedPlan().toString())  # nothing is left for Spark to compare
    for base in (some, journal.read(journals, path, "id % 2 = 0")):  # queries over one relation don't see each other's filters
        n = base.count()
        assert base.where("id > 14").count() < n and base.where("x > 0").count() <= n and base.count() == n == base.select("name").count()
    for condition in ("name in ('n1', 'n3')", "name = 'n2' or id = 3", "d between date'2024-01-05' and date'2024-01-20'", "x > 3", "x < 3 and name > 'n2'", "id % 2 = 0", "name not in ('n1')", "id in (1, 39)"):
        assert told(journal.read(journals, path, condition)) == told(plain.where(condition)), condition
        assert told(whole.where(condition)) == told(plain.where(condition)), condition
    journals.createDataFrame(rows[:2], whole.schema).write.format("journal").mode("overwrite").save(path)
    assert journals.read.format("journal").load(path).count() == 2


def test_an_aborted_write_leaves_nothing(journals, tmp_path):
    path = f"file://{tmp_path}/j"
    bad = journals.range(100).repartition(4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.lit(1)).alias("x"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("journal").mode("append").save(path)
    assert journal.Folder(path).entries() == []


def test_a_restarted_stream_loses_and_repeats_nothing(journals, tmp_path):
    source, goal, marks = (f"file://{tmp_path}/{n}" for n in ("source", "goal", "marks"))
    add = lambda a, b: journals.range(a, b).repartition(3).write.format("journal").mode("append").save(source)

    def run():
        rows = journals.readStream.format("journal").load(source)
        rows.writeStream.format("journal").option("checkpointLocation", marks).trigger(availableNow=True).start(goal).awaitTermination()

    add(0, 100)
    run()
    add(100, 150)
    add(150, 175)
    run()
    run()
    # As after a crash between the sink's commit and the query's: the last batch is run again.
    import pathlib

    last = max((p for p in pathlib.Path(f"{tmp_path}/marks/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    add(175, 180)
    run()
    assert sorted(r.id for r in journals.read.format("journal").load(goal).collect()) == list(range(180))
    logged = [json.loads(p.read_text()) for p in sorted(pathlib.Path(f"{tmp_path}/goal/log").iterdir())]
    assert len({e["batch"] for e in logged}) == len(logged)
