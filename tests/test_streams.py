"""Streams give what the batch forms give, whatever is replayed, repeated or late."""

from __future__ import annotations

import os
import random
import uuid

from pyspark.sql import functions as F

from rankloom.operators.streaks import LIMIT, host_streaks, latch
from rankloom.schema import SNAPSHOT_COLUMNS
from rankloom.streaming import feeds

LOG = "host string, position long, outcome string"


def _log(seed: int, count: int = 600):
    rng = random.Random(seed)
    return [(rng.choice("aaabcdefgh"), at, rng.choice(["ok", "ok", "error", "empty"]))
            for at in range(count)]


def _swept(rows):
    streak, is_open, out = {}, set(), {}
    for host, at, outcome in rows:
        out[at] = host in is_open
        if host in is_open:
            continue
        if outcome == "ok":
            streak[host] = 0
        elif outcome == "error":
            streak[host] = streak.get(host, 0) + 1
        if streak.get(host, 0) >= LIMIT:
            is_open.add(host)
    return out, {h: n for h, n in streak.items() if n}


def test_streaks_carry_over_any_cut(spark):
    rows = _log(1, 240)
    want, hosts = _swept(rows)
    for cut in (0, 1, 50, 119, 240):
        carried, got = None, {}
        for part in (rows[:cut], rows[cut:]):
            log = latch(spark.createDataFrame(part, LOG), "host", "position", "outcome", 16,
                        carried)
            got |= {r.position: r.circuit_open for r in log.collect()}
            carried = spark.createDataFrame(
                host_streaks(log, "host", "position", "outcome", carried).collect(),
                "host string, failures int")
        assert got == want
        assert {r.host: r.failures for r in carried.collect()} == hosts


def _write(spark, rows, folder, name):
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{folder}-{name}")
    part = next(p for p in os.listdir(f"{folder}-{name}") if p.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.link(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


def test_latch_stream_equals_the_batch_form(spark, tmp_path):
    rows = _log(2)
    want, hosts = _swept(rows)
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    checkpoint = str(tmp_path / f"check-{uuid.uuid4()}")
    for name, low in (("a", 0), ("b", 200), ("c", 400)):     # a restart before every file
        _write(spark, rows[low:low + 200], folder, name)
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
        feeds.latch_stream(stream, out, checkpoint, 32).awaitTermination(120)
    got = spark.read.parquet(f"{out}/rows").select("position", "circuit_open").collect()
    assert {r.position: r.circuit_open for r in got} == want and len(got) == len(rows)
    last = feeds._hosts(spark, out, 3)
    assert {r.host: r.failures for r in last.collect()} == hosts
    assert sorted(os.listdir(f"{out}/hosts")) == ["batch=1", "batch=2"]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = _log(3, 300)
    want, hosts = _swept(rows)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "check"))

    def run():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
        feeds.latch_stream(stream, out, checkpoint, 32).awaitTermination(120)
    _write(spark, rows[:150], folder, "a")
    run()
    _write(spark, rows[150:], folder, "b")
    run()
    # the last batch was written, but its commit is lost: it runs again
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    run()
    got = spark.read.parquet(f"{out}/rows").select("position", "circuit_open").collect()
    assert {r.position: r.circuit_open for r in got} == want and len(got) == len(rows)
    assert {r.host: r.failures for r in feeds._hosts(spark, out, 2).collect()} == hosts


def _snapshot(path, names, hours):
    lines = [",".join(SNAPSHOT_COLUMNS)]
    for name in names:
        lines.append(",".join(name if c == "Institute" else "7" if c == "ClosingRank" else ""
                              for c in SNAPSHOT_COLUMNS))
    path.write_text("\n".join(lines) + "\n")
    when = 1_700_000_000 + hours * 3600
    os.utime(path, (when, when))


def test_repeated_and_late_files(spark, tmp_path):
    """Rows come once within the horizon; behind it they count again, and late files do not."""
    folder = tmp_path / "in"
    folder.mkdir()
    columns = ", ".join(f"{c} string" for c in SNAPSHOT_COLUMNS)

    def run():
        stream = feeds.snapshot_stream(spark, str(folder), columns, 1, "2 hours")
        feeds.append_stream(stream, str(tmp_path / "data"), str(tmp_path / "check")) \
            .awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "data")).groupBy("Institute").count().collect()
        return {r.Institute: r["count"] for r in rows}
    _snapshot(folder / "a.csv", ["A", "B", "B"], 0)
    assert run() == {"A": 1, "B": 1}
    _snapshot(folder / "b.csv", ["B", "C"], 1)          # the same row an hour later
    assert run() == {"A": 1, "B": 1, "C": 1}
    _snapshot(folder / "c.csv", ["D"], 30)              # the horizon moves past all of them
    assert run() == {"A": 1, "B": 1, "C": 1, "D": 1}
    _snapshot(folder / "d.csv", ["A"], 31)              # forgotten by now: a row of its own
    assert run() == {"A": 2, "B": 1, "C": 1, "D": 1}
    _snapshot(folder / "e.csv", ["E"], 2)               # older than the horizon: late
    assert run() == {"A": 2, "B": 1, "C": 1, "D": 1}
