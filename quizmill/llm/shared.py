"""Places and schemas that every operator of this subpackage shares.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which driver and
executors share, so a lost executor never takes the only copy of a result with it. They stay there, as
results are lazy; whoever owns the folder cleans it when a session's results are no longer read.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. One is made only where none is set (tests, local use)."""
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quizmill-")
        spark.conf.set("spark.checkpoint.dir", found)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there. ``options``: further ones of the writer."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, with a sign more while a column has that name."""
    low = {c.lower() for c in taken}
    while wish.lower() in low:
        wish += "_"
    return wish


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def aside(docs: DataFrame, own: tuple[str, ...], stage, new: tuple[str, ...] = ()) -> DataFrame:
    """``stage`` on ``docs``, whose columns other than ``own`` have neutral names meanwhile, so that none clashes with those of the stage.

    ``new``: columns that the stage adds; input columns of these names go."""
    names = [c for c in docs.columns if c not in new]
    mine = [c if c in own else f"column {k}" for k, c in enumerate(names)]
    out = stage(docs.select(*(column(c).alias(m) for c, m in zip(names, mine, strict=True))))
    return out.select(*(column(m).alias(c) for c, m in zip(names, mine, strict=True)), *new)


def texts_of(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and ``text``, with doc_id as long and a null text as the empty one."""
    shared_dir(docs.sparkSession)
    return docs.select(*(F.col(n).cast("long") if n == "doc_id" else F.col(n) for n in names), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def parts_for(spark: SparkSession, amount: int, each: int) -> int:
    """How many parts to deal an amount to: those of the session's shuffles, more when parts of ``each`` are more."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(amount) // each))


def bytes_of(rows: DataFrame) -> int:
    """UTF-8 bytes of all texts, and 8 for each row."""
    return rows.agg(F.sum(F.octet_length("text").cast("long") + 8)).first()[0] or 0


def rows_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow array and the offset of each row, without a copy of the bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    _, where, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(where, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, most: int):
    """Ranges of whole rows of at most ``most`` bytes each; a longer row stands alone."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    """``batch`` with further columns, in the order of ``names``."""
    have = dict(zip(batch.schema.names, batch.columns, strict=True)) | new
    return pa.RecordBatch.from_arrays([have[n] for n in names], names=names)
