"""A table of keyed rows that batches and streams update: merge on read, with commits that happen whole or not at all.

A write puts its rows, at most one of each key, into a delta folder dealt by key bucket, and then commits: a new manifest, numbered one above the last
and created only if that number is free, names all folders that count. A crash before the commit leaves a folder that no manifest names,
so readers never see it and the repeated batch writes a new one. Writers that meet at a number take the next
and build on the manifest they found. A manifest also keeps each writer's last batch, so a replayed batch changes nothing.

Each column has a policy: the ``last`` write wins or the ``first`` stays, and with ``_known`` a null never counts as a write. Writes are ordered by the
table's order columns, then by commit, then by value, so what a reader sees does not depend on how rows were dealt. An update without ``insert``
changes rows that some write inserted and makes none. Compaction merges the folders of one manifest into one, keeping each value's place in the
order; deltas that are committed meanwhile stay. Rows with a null key are rows like others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.sources import places

EMPTY = {"number": 0, "seq": 0, "folders": [], "done": {}}


class KeyedTable:
    """keys and order: column names; policies: for each other column first, last, first_known or last_known; schema: the type of every column in DDL.

    buckets: parts of the key space. A lookup reads one of them, so have as many as the table has times 128 MB."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], policies: dict[str, str], schema: str, order: list[str] = (), buckets: int = 16, keep: int = 8):
        self.spark, self.path, self.keys, self.policies, self.order, self.buckets, self.keep = spark, path, list(keys), dict(policies), list(order), buckets, keep
        types = {f.name: f.dataType for f in T.StructType.fromDDL(schema)}
        self.types = {c: types[c] for c in dict.fromkeys([*self.keys, *self.policies, *self.order])}
        at = T.StructType([T.StructField(f"o{k}", types[c]) for k, c in enumerate(self.order)] + [T.StructField("seq", T.LongType())])
        entry = [T.StructField(c, T.StructType([T.StructField("at", at), T.StructField("value", types[c])])) for c in self.policies]
        self.schema = T.StructType([*(T.StructField(c, types[c]) for c in self.keys), *entry, T.StructField("_inserted", T.BooleanType())])

    def _bucket(self, key: dict[str, Column]) -> Column:
        return F.pmod(F.xxhash64(*(key[c].cast(self.types[c]) for c in self.keys)), F.lit(self.buckets)).cast("int")

    def manifest(self) -> dict:
        """The newest manifest."""
        found = [n for n in places.names(self.spark, f"{self.path}/versions") if n.endswith(".json")]
        return json.loads(places.text(self.spark, f"{self.path}/versions/{found[-1]}")) if found else EMPTY

    def _commit(self, change) -> bool:
        """Commit ``change(manifest)`` on the newest manifest; ``change`` returns None where there is nothing to commit any more."""
        while True:
            old = self.manifest()
            new = change(old)
            if new is None:
                return False
            new["number"] = old["number"] + 1
            if places.put_once(self.spark, f"{self.path}/versions/{new['number']:020d}.json", json.dumps(new)):
                return True

    def _best(self, column: str) -> Column:
        """The entry that the column's policy takes of a key's entries."""
        policy, entry = self.policies[column], F.col(column)
        if policy.endswith("_known"):
            entry = F.when(F.col(f"{column}.value").isNotNull(), entry)
        return (F.max if policy.startswith("last") else F.min)(entry).alias(column)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """The rows by key, each bucket in parts of its own: the only shuffle, so rows come as narrow as they are and are merged where they are written."""
        own = {"_bucket": self._bucket({c: F.col(c) for c in self.keys}), "_part": F.pmod(F.hash(*self.keys), F.lit(self.buckets))}
        return rows.withColumns(own).repartition(*own)

    def _store(self, dealt: DataFrame) -> str | None:
        """One entry of each key of rows that are dealt as a new folder; None if there is none."""
        name = uuid.uuid4().hex
        merged = dealt.groupBy("_bucket", "_part", *self.keys).agg(*(self._best(c) for c in self.policies), F.bool_or("_inserted").alias("_inserted"))
        merged.drop("_part").write.partitionBy("_bucket").parquet(f"{self.path}/data/folder={name}")
        return name if any(n.startswith("_bucket=") for n in places.names(self.spark, f"{self.path}/data/folder={name}")) else None

    def write(self, rows: DataFrame, writer: str, batch: int, insert: bool = True) -> bool:
        """Write the rows as the writer's batch; False, and no change, where that batch or a later one of the writer is in the table.

        Columns with a policy that the rows lack are not written."""
        if self.manifest()["done"].get(writer, -1) >= batch:
            return False
        dealt = self._dealt(rows.select(*(F.col(c).cast(t).alias(c) for c, t in self.types.items() if c in rows.columns)))
        at = F.struct(*((F.col(c) if c in rows.columns else F.lit(None)).cast(self.types[c]).alias(f"o{k}") for k, c in enumerate(self.order)), F.lit(None).cast("long").alias("seq"))
        entry = lambda c: F.struct(at.alias("at"), F.col(c).alias("value")) if c in rows.columns else F.lit(None).cast(self.schema[c].dataType)
        name = self._store(dealt.select("_bucket", "_part", *self.keys, *(entry(c).alias(c) for c in self.policies), F.lit(insert).alias("_inserted")))

        def change(old: dict) -> dict | None:
            if old["done"].get(writer, -1) >= batch:
                return None
            seq = old["seq"] + 1
            return {"seq": seq, "folders": old["folders"] + ([[name, seq]] if name else []), "done": old["done"] | {writer: batch}}

        return self._commit(change)

    def sink(self, writer: str, insert: bool = True):
        """For foreachBatch."""
        return lambda rows, batch: self.write(rows, writer, batch, insert)

    def _entries(self, manifest: dict, key: dict | None = None) -> DataFrame:
        if not manifest["folders"]:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("folder", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/folder={n}" for n, _ in manifest["folders"]))
        if key is not None:
            rows = rows.where(F.col("_bucket") == self._bucket({c: F.lit(key[c]) for c in self.keys}))
            for c in self.keys:
                rows = rows.where(F.col(c).eqNullSafe(F.lit(key[c]).cast(self.types[c])))
        seqs = F.create_map(*(F.lit(x) for entry in manifest["folders"] for x in entry))
        seq = lambda c: F.when(F.col(c).isNotNull(), F.col(c).withField("at.seq", F.coalesce(F.col(f"{c}.at.seq"), F.element_at(seqs, F.col("folder")).cast("long"))))
        return rows.select(*self.keys, *(seq(c).alias(c) for c in self.policies), "_inserted")

    def read(self, key: dict | None = None) -> DataFrame:
        """The table as of the newest manifest, or the row of one key, for which one bucket is read."""
        merged = self._entries(self.manifest(), key).groupBy(*self.keys).agg(*(self._best(c) for c in self.policies), F.bool_or("_inserted").alias("_inserted"))
        return merged.where("_inserted").select(*self.keys, *(F.col(f"{c}.value").alias(c) for c in self.policies))

    def compact(self) -> bool:
        """Merge the folders of the newest manifest into one; False where there are less than two."""
        old = self.manifest()
        merged = {n for n, _ in old["folders"]}
        if len(merged) < 2:
            return False
        name = self._store(self._dealt(self._entries(old)))

        def change(now: dict) -> dict | None:
            if not merged <= {n for n, _ in now["folders"]}:
                return None  # another compaction was first
            rest = [f for f in now["folders"] if f[0] not in merged]
            return now | {"folders": [[name, old["seq"]], *rest]}

        return self._commit(change)

    def vacuum(self) -> int:
        """Remove manifests older than the last ``keep``, and folders that only those name. Folders of writes that go on are named by no manifest and stay."""
        at = f"{self.path}/versions"
        found = [n for n in places.names(self.spark, at) if n.endswith(".json")]
        named = {n: {f for f, _ in json.loads(places.text(self.spark, f"{at}/{n}"))["folders"]} for n in found}
        live = set().union(*(named[n] for n in found[-self.keep :])) if found else set()
        gone = set().union(*(named[n] for n in found[: -self.keep])) - live if len(found) > self.keep else set()
        for name in gone:
            places.removed(self.spark, f"{self.path}/data/folder={name}")
        for n in found[: -self.keep]:
            places.removed(self.spark, f"{at}/{n}")
        return len(gone)
