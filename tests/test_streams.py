"""Streams over several batches: event time, replays, failures."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quizmill.operators import drill
from quizmill.sources import places
from quizmill.streaming import events

LATE = "10 minutes"


def run(spark, tmp_path, parts, schema, make, mode):
    """Each part is a file and a batch; a list of (batch, row)."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k:02d}"))
    events.use_rocks(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    found = []
    keep = lambda rows, batch: found.extend((batch, tuple(r)) for r in rows.collect())
    make(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return found


BLOCK = "user_id long, what string, activity string, ts double, id long"
BOX = "user_id long, item_id string, score int, ts double, id long"
CLOSE = [(None, None, None, 1e7, None)]


def in_batches(rows, n, seed):
    """The rows in n batches of mixed order: every batch has early and late ones, within the allowed delay."""
    r = random.Random(seed)
    rows = r.sample(rows, len(rows))
    return [rows[k::n] for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_of_blocks_equal_the_twin(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(r.randint(1, 4), r.choice(["start", "start", "end", "end", "cancel"]), r.choice("abc"), 1000.0 + r.randint(0, 500), k) for k in range(80)]
    found = run(spark, tmp_path, [*in_batches(rows, 3, seed), CLOSE], BLOCK, lambda s: events.blocks(s, LATE), "append")
    twin = events.blocks_batch(spark.createDataFrame(rows, BLOCK)).collect()
    assert twin and sorted(x for _, x in found) == sorted(map(tuple, twin))


def test_shuffled_batches_of_boxes_equal_the_twin(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randint(1, 3), r.choice("ij"), r.choice([0, 1, 2, 2, 2, None]), 1000.0 + r.randint(0, 400), k) for k in range(90)]
    found = run(spark, tmp_path, [*in_batches(rows, 3, 4), CLOSE], BOX, lambda s: events.boxes(s, LATE), "update")
    last = {x[:2]: x[2] for _, x in found}
    twin = drill.boxes(spark.createDataFrame(rows, BOX), "user_id", "item_id").collect()
    assert last == {(r.user_id, r.item_id): r.box for r in twin}


def test_boxes_come_with_each_batch(spark, tmp_path):
    """F8: no event waits for the watermark; after each batch the boxes are the twin's over all events so far, whatever their order. Ids beyond 2^53, nulls."""
    r = random.Random(5)
    rows = [(r.choice([1, 2, None]), r.choice(["i", "j", None]), r.choice([0, 1, 2, 2, 2, None]), 1000.0 + r.randint(0, 40), 2**60 + k) for k in range(150)]
    parts = in_batches(rows, 3, 6)
    found = run(spark, tmp_path, parts, BOX, lambda s: events.boxes(s, LATE), "update")
    for n in (1, 2, 3):
        last = {x[:2]: x[2] for b, x in found if b < n}
        twin = drill.boxes(spark.createDataFrame([x for part in parts[:n] for x in part], BOX), "user_id", "item_id").collect()
        assert last == {(r.user_id, r.item_id): r.box for r in twin}


class Calls:
    """A handle that counts the calls of a state with one value."""

    def __init__(self):
        self.value, self.n = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n += 1
        self.value = value


def test_calls_of_state_do_not_grow_with_items(spark):
    """F8: a batch reads and writes state once for a user, and what stands of an item does not grow with its events."""
    handle, boxes = Calls(), events.Boxes()
    boxes.init(handle)
    sizes = []
    for batch in range(4):
        rows = pd.DataFrame([(float(batch * 100 + k), batch * 100 + k, f"i{k % 50}", 2, True) for k in range(100)], columns=["ts", "id", "item_id", "score", "known"])
        (out,) = boxes.handleInputRows(("1",), iter([rows[:60], rows[60:]]), None)
        sizes.append(len(handle.value[0]))
    assert handle.n == 8 and len(out) == 50 and set(out.box) == {3}
    assert sizes[3] <= 1.1 * sizes[1]


def test_blocks_of_nulls_and_large_ids(spark, tmp_path):
    """Users and activities may be null, and ids that a double cannot hold decide the order."""
    rows = [(None, "start", None, 1000.0, 2**60 + 1), (None, "end", "a", 1000.0, 2**60 + 2), (2**60 + 1, "start", "b", 1000.0, 2**60 + 4), (2**60 + 1, "cancel", "b", 1000.0, 2**60 + 3), (2**60 + 1, "end", "b", 1060.0, 2**60), (2**60 + 1, "end", "x", 1060.0, None)]
    found = run(spark, tmp_path, [rows, CLOSE], BLOCK, lambda s: events.blocks(s, LATE), "append")
    assert sorted((x for _, x in found), key=str) == sorted([(None, None, 1000.0, 0.0), (2**60 + 1, "b", 1000.0, 1.0)], key=str)


def test_events_are_released_when_the_watermark_passes(spark, tmp_path):
    """What is settled comes out while the stream goes on; an event later than allowed is dropped; one without a time or id is ignored."""
    parts = [
        [(1, "start", "a", 1000.0, 1), (1, "end", "a", 1100.0, 3), (2, "start", "b", None, 8), (2, "end", "b", 1000.0, None)],
        [(1, "start", "z", 1050.0, 2), (9, "start", "x", 9000.0, 4)],  # an earlier start, within the delay; time goes on
        [(1, "start", "late", 500.0, 5), (1, "end", "late", 600.0, 6)],
        CLOSE,
    ]
    found = run(spark, tmp_path, parts, BLOCK, lambda s: events.blocks(s, LATE), "append")
    assert [x for _, x in found] == [(1, "z", 1050.0, 50.0 / 60)]
    assert found[0][0] <= 2  # before the stream's end


def test_outbox_stores_each_key_once(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = lambda *ids: spark.createDataFrame([(i, "x", None if i == 9 else f"2024-01-0{i} 10:00:00") for i in ids], "id long, v string, at string").withColumn("at", F.col("at").cast("timestamp"))
    write = events.append_to(out, ["id"], "at")
    write(rows(1, 2, 2, 9), 0)
    write(rows(2, 3), 1)
    write(rows(2, 3), 1)  # the batch again after a failure
    events.append_to(out, ["id"], "at", "other device")(rows(1, 4, 9), 0)
    write(rows(4), 2)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 9]


def test_a_batch_reads_its_own_days_only(spark, tmp_path, monkeypatch):
    """The sink holds many days; a batch of one day looks into that day's folder."""
    out = f"file://{tmp_path}/out"
    rows = spark.range(60).select("id", F.timestamp_seconds(F.col("id") * 86_400).alias("at"))
    write = events.append_to(out, ["id"], "at")
    write(rows, 0)
    asked = []
    real = places.exists
    monkeypatch.setattr(places, "exists", lambda s, p: asked.append(p) or real(s, p))
    write(rows.where("id = 7"), 1)
    assert len(asked) == 1 and asked[0].endswith("bucket=1970-01-08")
    assert spark.read.parquet(out).count() == 60


def test_outputs_that_fail_leave_letters(spark, tmp_path):
    """One output is broken: the other is complete, the batch goes through; attempts back off; later both are complete, once each."""
    base = f"file://{tmp_path}"
    lines, agent, up = events.lines_to(f"{base}/lines"), events.payloads_to(f"{base}/agent"), []

    def flaky(rows, batch):
        if not up:
            raise OSError("down")
        agent(rows, batch)

    outputs, dead = {"people": lines, "agent": flaky}, f"{base}/dead"
    batch = lambda n: spark.createDataFrame([(f"t{n}", n)], "text string, n int")
    write = events.notices_to(outputs, dead, lambda: 1000)
    write(batch(0), 0)
    write(batch(1), 1)
    write(batch(1), 1)  # a replay
    assert sorted(r.value for r in spark.read.text(f"{base}/lines").collect()) == ["t0", "t1"]
    waiting = events.dead_letters(spark, dead)
    assert [(w["output"], w["batch"], w["attempts"], w["next"]) for w in waiting] == [("agent", 0, 1, 1060), ("agent", 1, 1, 1060)] and "down" in waiting[0]["error"]
    assert events.drain(spark, outputs, dead, 1059) == 0 and events.dead_letters(spark, dead) == waiting  # not due
    assert events.drain(spark, outputs, dead, 1060) == 0
    assert [(w["attempts"], w["next"]) for w in events.dead_letters(spark, dead)] == [(2, 1180), (2, 1180)]
    up.append(1)
    write(batch(2), 2)
    assert events.drain(spark, outputs, dead, 1180) == 2 and events.dead_letters(spark, dead) == []
    assert sorted(r.value for r in spark.read.text(f"{base}/agent").collect()) == ['{"n":0}', '{"n":1}', '{"n":2}']
    assert sorted(r.value for r in spark.read.text(f"{base}/lines").collect()) == ["t0", "t1", "t2"]


def test_fan_out_commits_each_sink_once(spark, tmp_path):
    """The second sink fails twice, then the batch goes on where it broke; a restart after the commit changes nothing."""
    seen, ledger, broken = [], f"file://{tmp_path}/ledger", [True]

    def second(rows, batch):
        if broken:
            raise OSError("away")
        seen.append(("second", batch, rows.count()))

    write = events.fan_out({"first": lambda rows, batch: seen.append(("first", batch, rows.count())), "second": second, "third": lambda rows, batch: seen.append(("third", batch, rows.count()))}, ledger)
    rows = spark.range(5)
    for _ in range(2):
        with pytest.raises(OSError):
            write(rows, 0)
    broken.clear()
    write(rows, 0)
    write(rows, 0)
    write(rows, 1)
    assert seen == [("first", 0, 5), ("second", 0, 5), ("third", 0, 5), ("first", 1, 5), ("second", 1, 5), ("third", 1, 5)]
