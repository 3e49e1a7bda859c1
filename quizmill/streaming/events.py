"""Event streams: routing, replay protection, keyed state, sinks. Each state has a batch twin."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quizmill.operators.drill import TOP_BOX
from quizmill.sources import places

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HANDLED = ("checkout.session.completed", "customer.subscription.updated", "customer.subscription.deleted", "invoice.payment_failed")
BODY_CAP = 65_536
#: Seconds by which a signature's time may differ from the event's arrival: a fixed value.
TOLERANCE = 300


def use_rocks(spark) -> None:
    """Keyed processors need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def signed(body: Column, at: Column, secret: str) -> Column:
    """The HMAC-SHA256 of a time stamp, a dot and the body, in hex. The padded keys are constants of the plan, so it needs no Python."""
    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    message = F.concat_ws(".", at.cast("string"), body).cast("binary")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def verified(events: DataFrame, secret: str) -> DataFrame:
    """The events whose signature is that of their body, stamped at most five minutes from their arrival. events: body, signature (t=seconds,v1=hex, several v1 allowed), received (seconds)."""
    at = F.regexp_extract("signature", r"(?:^|,)t=(\d{1,18})(?:,|$)", 1)
    own = F.transform(F.filter(F.split("signature", ","), lambda x: x.startswith("v1=")), lambda x: F.substring(x, F.lit(4), F.lit(64)))
    fresh = F.abs(F.col("received") - at.cast("long")) <= TOLERANCE
    return events.where((at != "") & fresh & F.array_contains(own, signed(F.col("body"), at, secret)))


def routed(events: DataFrame) -> DataFrame:
    """``route`` of each event by type; unknown types are only logged. events: type, mode."""
    t = F.col("type")
    route = F.when((t == HANDLED[0]) & (F.col("mode") == "subscription"), "subscribe").when(t == HANDLED[0], "books").when(t == HANDLED[1], "change").when(t == HANDLED[2], "end").when(t == HANDLED[3], "failed").otherwise("log")
    return events.withColumn("route", route)


def changes(rows: DataFrame) -> DataFrame:
    """Database changes as notices: sign-ups of profiles, others by table. rows: body (JSON)."""
    r = rows.select(F.from_json("body", "type string, table string, schema string, record struct<id:string,display_name:string>").alias("e")).select("e.*")
    signup = (F.col("table") == "profiles") & (F.col("type") == "INSERT")
    return r.select(F.when(signup, "signup").otherwise("change").alias("kind"), F.coalesce("record.display_name", "record.id").alias("name"), F.when(signup, F.concat(F.lit("New account: "), F.coalesce("record.display_name", "record.id"))).otherwise(F.concat_ws(" ", "type", F.lit("on"), "table")).alias("text"))


def mails(rows: DataFrame) -> DataFrame:
    """What the agent would send: to, kind, subject. Bodies beyond the cap and events without an e-mail drop out. rows: body."""
    e = rows.where(F.length("body") <= BODY_CAP).select(F.from_json("body", "event string, email string, ebooks array<string>, tier string, app string, discount_code string, amount_cents int").alias("e")).select("e.*")
    kind = F.when(F.col("event").isin("ebook_purchase", "subscription", "signup"), F.col("event"))
    subject = F.when(kind == "ebook_purchase", F.concat(F.lit("Your books: "), F.array_join("ebooks", ", "))).when(kind == "subscription", F.concat_ws(" ", F.lit("Your plan:"), "tier", "app")).when(kind == "signup", "Welcome")
    return e.select(F.col("email").alias("to"), kind.alias("kind"), subject.alias("subject")).where("`to` is not null and kind is not null")


def once(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key combination once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counters(events: DataFrame) -> DataFrame:
    """Seen and right of each (user, item), for update mode."""
    return events.groupBy("user_id", "item_id").agg(F.count("*").alias("seen"), F.count_if(F.col("score") == 2).alias("right"))


class Keyed(StatefulProcessor):
    """Events of a user, as pandas brings them. ``FIELDS``: those of an event that count, ts (seconds) and id first."""

    FIELDS = ("ts", "id")

    def known(self, frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        """The events of each frame that have an id, nulls as None."""
        for frame in frames:
            frame = frame[frame["known"]]
            columns = [[None if x != x else x for x in frame[f].tolist()] for f in self.FIELDS]
            if len(frame):
                yield list(zip(*columns, strict=True))

    def close(self) -> None:
        pass


class InOrder(Keyed):
    """Holds each key's events until the watermark has passed them, and takes them in order of time and id.

    An event-time timer stands at the earliest event that waits. No event from before the watermark can come any more, so what is
    taken is complete: batches may bring events in any order, and the result is that of the batch twin. The events of a batch wait as one
    text, since every entry of a state is a call of its own. ``taken(key, events)`` gives the result rows of some events in order."""

    COLUMNS: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")

    def _wait(self, events: list[tuple]) -> None:
        self.waiting.appendValue((json.dumps(events),))
        self.handle.registerTimer(math.ceil(min(e[0] for e in events) * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for new in self.known(rows):
            self._wait(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        events = [tuple(e) for (batch,) in self.waiting.get() for e in json.loads(batch)]
        rest = [e for e in events if e[0] > passed]
        if len(rest) == len(events):
            return
        self.waiting.clear()
        if rest:
            self._wait(rest)
        found = list(self.taken(key, sorted((e for e in events if e[0] <= passed), key=lambda e: e[:2])))
        if found:
            yield pd.DataFrame(found, columns=list(self.COLUMNS))


def keyed(events: DataFrame, late: str, processor: Keyed, schema: str, mode: str) -> DataFrame:
    """``processor`` over the events of each user. Events without time or id are ignored, but a time without an id still moves the watermark on."""
    at = F.timestamp_seconds("ts").alias("at")
    # a null makes doubles of a batch's whole numbers in pandas: users go as strings, and a flag tells who has an id; a filter by id would go below the watermark
    rows = events.where("ts is not null").select(F.col("user_id").cast("string").alias("user"), "ts", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), *processor.FIELDS[2:], at)
    found = rows.withWatermark("at", late).groupBy("user").transformWithStateInPandas(processor, f"user string, {schema}", mode, "EventTime")
    return found.select(F.col("user").cast("long").alias("user_id"), *found.columns[1:])


class Boxes(Keyed):
    """The box of each item of a user: 2 moves up to three at most, 1 stays, anything else falls to 0.

    A box never exceeds three, so it is the number of moves up since the last fall, three at most: the last fall and the three latest moves
    up after it tell it, whatever order events come in, and no event waits. What a user's items have is one text, so a batch takes one read
    and one write of state for each user, however many items and events it brings."""

    FIELDS = ("ts", "id", "item_id", "score")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cards = handle.getValueState("cards", "cards string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old, cards, seen = None, {}, set()
        for events in self.known(rows):
            if not seen:
                old = self.cards.get()
                cards = {item: (fall, ups) for item, fall, ups in json.loads(old[0])} if old is not None else {}
            for ts, number, item, score in events:
                at, (fall, ups) = [ts, number], cards.get(item, (None, []))
                if score == 2:
                    if fall is None or at >= fall:
                        ups = sorted([*ups, at])[-TOP_BOX:]
                elif score != 1 and (fall is None or at > fall):
                    fall, ups = at, [u for u in ups if u >= at]
                cards[item] = (fall, ups)
                seen.add(item)
        if seen:
            self.cards.update((json.dumps([(item, *card) for item, card in cards.items()]),))
            yield pd.DataFrame([(key[0], item, len(cards[item][1])) for item in seen], columns=["user", "item_id", "box"])


def boxes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The box of each key by all events so far, for update mode. events: user_id, item_id, score, ts (seconds), id; those that come later than ``late`` are dropped."""
    return keyed(events, late, Boxes(), "item_id string, box int", "Update")


def tiers(events: DataFrame) -> DataFrame:
    """The tier of each customer, for update mode: the latest event wins, older ones change nothing. events: customer, tier, ts (seconds), id."""
    return events.groupBy("customer").agg(F.max_by("tier", F.struct("ts", "id")).alias("tier"))


def marks(events: DataFrame) -> DataFrame:
    """The mark of each (user, item), for update mode: the latest score's. events: user_id, item_id, score, ts (seconds), id."""
    mark = F.when(F.col("score") > 0, "known").otherwise("again")
    return events.groupBy("user_id", "item_id").agg(F.max_by(mark, F.struct("ts", "id")).alias("mark"))


class Blocks(InOrder):
    """Study blocks from start and end events: a second start replaces the first, an end without a start is ignored."""

    FIELDS = ("ts", "id", "what", "activity")
    COLUMNS = ("user", "activity", "started", "minutes")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "activity string, ts double")

    def taken(self, key, events: list[tuple]) -> Iterator[tuple]:
        before = self.open.get()
        open_ = before
        for ts, _, what, activity in events:
            if what == "start":
                open_ = (activity, ts)
            elif what == "end" and open_ is not None:
                yield key[0], open_[0], open_[1], (ts - open_[1]) / 60
                open_ = None
            else:
                open_ = None
        if open_ is not None:
            self.open.update(tuple(open_))
        elif before is not None:
            self.open.clear()


def blocks(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Blocks that ended before the watermark. events: user_id, what (start, end, cancel), activity, ts (seconds), id; those that come later than ``late`` are dropped."""
    return keyed(events, late, Blocks(), "activity string, started double, minutes double", "Append")


def blocks_batch(events: DataFrame) -> DataFrame:
    """The same from a table: an end closes the event right before it if that is a start."""
    from pyspark.sql.window import Window

    own = Window.partitionBy("user_id").orderBy("ts", "id")
    prior = lambda c: F.lag(c).over(own)
    out = events.withColumn("_what", prior("what")).withColumn("_activity", prior("activity")).withColumn("_ts", prior("ts"))
    return out.where("what = 'end' and _what = 'start'").select("user_id", F.col("_activity").alias("activity"), F.col("_ts").alias("started"), ((F.col("ts") - F.col("_ts")) / 60).alias("minutes"))


def append_to(path: str, keys: list[str], time: str, sender: str = "outbox", bucket: str = "yyyy-MM-dd"):
    """A foreachBatch sink that appends a batch's rows whose keys no other batch has stored, each key once. Replays of a batch replace it.

    Rows lie in buckets of their time, and a key's time is part of the event, so a row sent again falls into the bucket of the first: only the buckets
    of the batch's own rows are looked up, however much the sink holds. Rows without a time have a bucket of their own."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        new = rows.withColumn("bucket", F.coalesce(F.date_format(time, bucket), F.lit("none"))).dropDuplicates(keys)
        new = new.persist()  # read for its buckets and again for its rows; a lost executor's part is read from the source again
        try:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # buckets of one batch
            there = [f"{path}/bucket={b}" for b in touched if places.exists(spark, f"{path}/bucket={b}")]
            if there:
                others = spark.read.option("basePath", path).schema(stored_schema(new.schema)).parquet(*there).where(~((F.col("sender") == sender) & (F.col("batch") == batch)))
                new = new.join(others.select(*(F.col(k).alias(f"_{k}") for k in keys)), reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")
            for b in touched:  # a replay may store less than the attempt before it
                places.removed(spark, f"{path}/bucket={b}/sender={sender}/batch={batch}")
            new.withColumns({"sender": F.lit(sender), "batch": F.lit(batch).cast("long")}).write.mode("append").partitionBy("bucket", "sender", "batch").parquet(path)
        finally:
            new.unpersist()

    return write


def stored_schema(schema: T.StructType) -> T.StructType:
    """The columns of a sink's rows with those of its folders."""
    return T.StructType([*(f for f in schema.fields if f.name != "bucket"), T.StructField("bucket", T.StringType()), T.StructField("sender", T.StringType()), T.StructField("batch", T.LongType())])


def fan_out(sinks: dict, ledger: str):
    """A foreachBatch sink that gives each batch to several sinks, each once: a batch that failed after some of them goes on with the others.

    sinks: name to a function of (rows, batch), in the order in which they run; each must write a batch over what an attempt that broke off has left of it. A
    sink's batch is committed by a file of the ledger, so a restart from the stream's checkpoint, with the same batches, skips it."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        left = [n for n in sinks if not places.exists(spark, f"{ledger}/{n}/{batch}")]
        if len(left) > 1:
            rows = rows.persist()
        try:
            for name in left:
                sinks[name](rows, batch)
                places.put_once(spark, f"{ledger}/{name}/{batch}", "")
        finally:
            rows.unpersist()

    return write


def lines_to(path: str):
    """An output of notices: a line of text for people."""
    return lambda rows, name: rows.select("text").write.mode("overwrite").text(f"{path}/batch={name}")


def payloads_to(path: str):
    """An output of notices: JSON for the agent, without the text."""
    return lambda rows, name: rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "text"]))).write.mode("overwrite").text(f"{path}/batch={name}")


def notices_to(outputs: dict, dead: str, now=time.time):
    """A foreachBatch sink that gives each batch to every output. An output that fails never fails the batch: its rows become a dead letter.

    outputs: name to a function of (rows, batch) that writes them, over what an earlier attempt left. A dead letter is a folder for an output and
    batch with the rows and one file for each attempt, which says when the next is due."""

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            for name, output in outputs.items():
                try:
                    output(rows, batch)
                except Exception as e:  # whatever an output does, the event stands
                    at = f"{dead}/{name}/{batch}"
                    rows.write.mode("overwrite").parquet(f"{at}/rows")
                    _attempted(rows.sparkSession, at, 1, now(), e)
        finally:
            rows.unpersist()

    return write


#: Seconds until the second attempt; each further one waits twice as long.
BACK_OFF = 60


def _attempted(spark, at: str, number: int, now: float, error: Exception) -> None:
    places.put_once(spark, f"{at}/attempt-{number:04d}.json", json.dumps({"attempts": number, "next": now + BACK_OFF * 2 ** (number - 1), "error": str(error)[:500]}))


def dead_letters(spark, dead: str) -> list[dict]:
    """What waits: output, batch, attempts, when the next is due, the last error. One entry for each output and batch that failed."""
    out = []
    for name in places.names(spark, dead):
        for batch in places.names(spark, f"{dead}/{name}"):
            found = [n for n in places.names(spark, f"{dead}/{name}/{batch}") if n.startswith("attempt-") and n.endswith(".json")]
            if found:  # none while the rows are being written
                out.append({"output": name, "batch": int(batch), **json.loads(places.text(spark, f"{dead}/{name}/{batch}/{found[-1]}"))})
    return out


def drain(spark, outputs: dict, dead: str, now: float) -> int:
    """Give the dead letters that are due to their outputs again; those that succeed go. The number that did."""
    done = 0
    for letter in dead_letters(spark, dead):
        if letter["next"] > now or letter["output"] not in outputs:
            continue
        at = f"{dead}/{letter['output']}/{letter['batch']}"
        try:
            outputs[letter["output"]](spark.read.parquet(f"{at}/rows"), letter["batch"])
        except Exception as e:
            _attempted(spark, at, letter["attempts"] + 1, now, e)
        else:
            places.removed(spark, at)
            done += 1
    return done
