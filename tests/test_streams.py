"""Stateful streams against their batch twins, and the versioned table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, changepoint
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import alerts as live_alerts
from tidemark.streaming import changes
from tidemark.streaming import events as streams

T0 = dt.datetime(2024, 1, 1)


def shuffled_files(spark, rows, schema, folder, files, seed):
    """Rows in random order over several files, and one that lets the watermark pass them all."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def greedy(rows, minutes):
    out, last = [], {}
    for key, ts, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or ts - last[key] >= dt.timedelta(minutes=minutes):
            last[key] = ts
            out.append((key, ts, v))
    return sorted(out)


def crossings(seed):
    r = random.Random(seed)
    rows = [(k, T0 + dt.timedelta(minutes=m), float(m)) for k, step in (("a", 7), ("b", 200), ("c", 61), ("d", 60)) for m in range(0, 3000, step) if r.random() < 0.8]
    return rows + [("e", T0, 5.0), ("e", T0, 5.0), ("e", T0 + dt.timedelta(minutes=60), 6.0), ("e", T0 + dt.timedelta(minutes=119, seconds=59), 7.0)]


@pytest.mark.parametrize("minutes", [1, 60, 100_000])
def test_cooldown_is_greedy(spark, minutes):
    rows = crossings(minutes)
    df = spark.createDataFrame([*rows, ("x", None, 1.0)], "key string, ts timestamp, v double").repartition(3)
    assert sorted(tuple(x) for x in alerts.cooled(df, minutes, "v").collect()) == greedy(rows, minutes)


def test_cooldown_of_a_stream_in_any_order(spark, tmp_path, rocks):
    """Rows over many batches, out of order, give the alerts of the batch; a late row gives none; states are cleared."""
    rows = crossings(1)
    schema = "key string, ts timestamp, v double"
    beat = [("beat", T0 + dt.timedelta(days=days), -1.0) for days in (30, 60)]  # below the threshold: it moves no watermark of these rows
    stream = shuffled_files(spark, rows, schema, str(tmp_path / "in"), 5, 3)
    spark.createDataFrame([("z", T0 + dt.timedelta(days=20), 9.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in/900"))
    spark.createDataFrame([("a", T0 + dt.timedelta(minutes=1), 999.0), *beat], schema).coalesce(1).write.parquet(str(tmp_path / "in/901"))
    spark.createDataFrame([("z", T0 + dt.timedelta(days=40), 9.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in/902"))
    query = live_alerts.with_cooldown(stream, 0.0 - 0.5, 60, late="10 days").writeStream.format("memory").queryName("cooled").outputMode("append").trigger(availableNow=True)
    query = query.option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = sorted(tuple(x) for x in spark.table("cooled").collect())
    want = greedy(rows, 60) + [("z", T0 + dt.timedelta(days=20), 9.0)]
    assert [x for x in got if x[0] != "z" or x[1] < T0 + dt.timedelta(days=30)] == sorted(want)
    last = [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]
    assert last["numRowsTotal"] <= 4  # what waits for the watermark, and its timer


def scores(seed):
    r = random.Random(seed)
    rows = []
    for bank, jump in (("A", 30), ("B", 20), ("C", 999)):
        for day in range(60):
            level = (0.4 if day >= jump else -0.3) + (0.5 if bank == "B" and day > 45 else 0)
            rows += [(bank, T0 + dt.timedelta(days=day, hours=r.randrange(24)), level + r.uniform(-0.1, 0.1)) for _ in range(r.randrange(3))]
    return rows + [("A", T0, 0.0), ("A", T0, None)]


def test_changes_of_a_stream_are_those_of_the_batch(spark, tmp_path, rocks):
    rows = scores(2)
    schema = "bank string, ts timestamp, net_score double"
    stream = shuffled_files(spark, rows, schema, str(tmp_path / "in"), 4, 5)
    spark.createDataFrame([("beat", T0 + dt.timedelta(days=200), 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in/900"))
    spark.createDataFrame([("beat", T0 + dt.timedelta(days=201), 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in/901"))
    found = streams.drain(changes.change_stream(stream, late="70 days"), "changed")
    got = sorted(tuple(x) for x in changes.newest(found).collect())
    batch = spark.createDataFrame(rows, schema).where("abs(net_score) > 0.001").withColumn("item_date", F.to_date("ts"))
    want = sorted(tuple(x) for x in changepoint.per_bank(batch).collect())
    near = lambda x: (*x[:3], *(round(v, 9) for v in x[3:]))
    assert want and list(map(near, got)) == list(map(near, want))


def files(folder):
    return {str(p.relative_to(folder)) for p in (folder / "data").rglob("*.parquet")}


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ["k"], "seq", buckets=8, shares=2, keep=2)
    rows = lambda *x: spark.createDataFrame(list(x), "k int, seq int, v string")
    assert table.read() is None
    assert table.merge(rows(*((i, 1, f"a{i}") for i in range(40))), 0) == 1
    first = files(tmp_path)
    assert table.merge(rows((3, 2, "new"), (3, 1, "older"), (40, 1, "more")), 1) == 2
    second = files(tmp_path)
    touched = {r.b for r in rows((3, 0, ""), (40, 0, "")).select(table.bucket().alias("b")).collect()}
    kept = {f for f in first if int(f.split("tidemark_bucket=")[1].split("/")[0]) not in touched}
    assert kept and kept <= second
    want = {i: f"a{i}" for i in range(40)} | {3: "new", 40: "more"}
    assert {r.k: r.v for r in table.read().collect()} == want
    # a batch that comes again, changed or not, changes nothing
    assert table.merge(rows((3, 9, "again")), 1) == 2 and files(tmp_path) == second and table.versions() == [1, 2]
    assert {r.k: r.v for r in table.read(1).collect()} == {i: f"a{i}" for i in range(40)}
    # an older row loses, a deletion takes its key out, and old versions go
    gone = spark.createDataFrame([(5, 7, None, True), (6, 0, "late", False)], "k int, seq int, v string, __deleted boolean")
    assert table.merge(gone, 2) == 3 and table.versions() == [2, 3]
    want = {k: v for k, v in want.items() if k != 5}
    assert {r.k: r.v for r in table.read().collect()} == want
    assert table.merge(rows((5, 6, "too old")), 3) == 4 and {r.k: r.v for r in table.read().collect()} == want
    assert table.merge(rows(), 4) == 5 and {r.k: r.v for r in table.read().collect()} == want


def test_a_failed_or_second_writer_leaves_no_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ["k"], "seq", buckets=4)
    rows = lambda *x: spark.createDataFrame(list(x), "k int, seq int")
    table.merge(rows((1, 1), (2, 1)), 0)
    with pytest.raises(Exception):
        table.merge(rows((1, 2)).withColumn("seq", F.raise_error(F.lit("lost"))), 1)
    assert table.versions() == [1] and sorted(tuple(r) for r in table.read().collect()) == [(1, 1), (2, 1)]
    held = table.manifest()
    other = VersionedTable(spark, str(tmp_path), ["k"], "seq", buckets=4)
    other.merge(rows((1, 3)), 1)
    with pytest.raises(RuntimeError):
        table._commit(held | {"version": 2})
    assert table.merge(rows((2, 5)), 2) == 3 and sorted(tuple(r) for r in table.read().collect()) == [(1, 3), (2, 5)]
    assert not [p for p in (tmp_path / "versions").iterdir() if not p.name.lstrip(".").rstrip(".crc").isdigit()]


def test_upserts_of_a_stream(spark, tmp_path):
    rows = [(i % 7, i, f"v{i}") for i in range(100)]
    stream = shuffled_files(spark, rows, "k int, seq int, v string", str(tmp_path / "in"), 4, 1)
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], "seq", buckets=4)
    for _ in range(2):  # the second run finds nothing new
        stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in table.read().collect()) == [(k, max(i for i in range(100) if i % 7 == k), f"v{max(i for i in range(100) if i % 7 == k)}") for k in range(7)]
    assert table.manifest()["batch"] == 3 and len(table.versions()) == 2
