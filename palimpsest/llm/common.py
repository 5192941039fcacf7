"""Helpers that the training-data operators share.

Conventions that hold for every operator of this subpackage:

* An operator reads only the columns it names; further columns, whatever
  their names, are ignored (or passed through untouched by pipeline stages).
* A null text counts as the empty text; a null id is an id like any other.
* Texts are read whole, however long they are.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: As many keys of rows are broadcast at most; beyond that rows and keys meet in a shuffle.
BROADCAST_KEYS = 1_000_000
#: A batch function gets rows of about so many bytes at a time: Python objects made of them take some ten times that.
BATCH_BYTES = 1 << 20
_temporary: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset, and then gets a temporary folder.
    """
    if (folder := spark.conf.get(CHECKPOINT_DIR, None)) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_DIR} is unset: name a folder that all machines share")
        application = spark.sparkContext.applicationId
        if application not in _temporary:
            _temporary[application] = tempfile.mkdtemp(prefix="palimpsest-")
        folder = _temporary[application]
    return folder.rstrip("/")


def deleted(spark: SparkSession, path: str) -> bool:
    """Deletes a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the folder that the cluster shares and cuts its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def known_by() -> dict[str, Column]:
    """What a row of documents is known by, in the order of rows."""
    return {"no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "text_hash": F.xxhash64("text")}


def keep_rows(docs: DataFrame, rows: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys (``known_by``) are in ``stay``, one for each key; ``rows`` has the keys of all, as often as they come.

    The keys that go are sent to every task where they are few, so that no text is shuffled; only rows whose key repeats are
    compared with one another.
    """
    names = list(known_by())
    counted = checkpoint(rows.groupBy(*names).agg(F.count("*").alias("n")).join(stay.withColumn("stays", F.lit(True)), names, "left"))
    go, twice = counted.where("stays IS NULL").select(*names), counted.where("stays AND n > 1").select(*names)
    sizes = counted.agg(F.expr("count_if(stays IS NULL)").alias("go"), F.expr("count_if(stays AND n > 1)").alias("twice")).first()
    own = {f"_{k}": c for k, c in known_by().items()}

    def of(keys: DataFrame, n: int, how: str, left: DataFrame) -> DataFrame:
        keys = keys.select(*(F.col(k).alias(f"_{k}") for k in names))
        return left.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, list(own), how)

    kept = of(go, sizes["go"], "left_anti", docs.withColumns(own))
    if sizes["twice"]:
        once = of(twice, sizes["twice"], "left_semi", kept).dropDuplicates(list(own))
        kept = of(twice, sizes["twice"], "left_anti", kept).unionByName(once)
    return kept.select(*docs.columns)


def arrow_map(df: DataFrame, batch_fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch, or part of one; empty results are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            if (out := batch_fn(batch)) is not None and out.num_rows:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in turn, about BATCH_BYTES at a time; a longer row is by itself."""
    for batch in batches:
        if batch.num_rows:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``: bytes.split() splits at just these characters."""
    return text.split()


def lowered_words(text: bytes) -> list[bytes]:
    """As words(), with A-Z (and nothing else) in lower case."""
    return text.lower().split()


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each unsigned integer (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
