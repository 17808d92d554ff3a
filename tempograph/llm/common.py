"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Rows and bytes of an Arrow batch that are turned into Python objects at one time; a longer row comes alone.
SLICE, SLICE_BYTES = 256, 16 << 20
#: A key that has more than one in so many rows is heavy; there are fewer than so many.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file lies; files are never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. On one machine a new folder serves where neither is set; on a cluster that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    if ":" not in folder.split("/")[0]:  # the default file system is meant
        folder = context._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + folder
    return folder.rstrip("/")


#: Folders that this process has named in the shared one and not discarded.
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def discard_others(spark: SparkSession, kept: list[str]) -> None:
    """Deletes the folders that fresh_path() has named since, but for those to keep; for when no result that reads them is needed any more."""
    for path in [p for p in _made if p not in kept]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _made.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() has written, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(file)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def made() -> list[str]:
    """The folders that are there now."""
    return list(_made)


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a checkpoint in the shared folder, so a lost executor repeats no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows written as Parquet in the shared folder; for wide or large tables that are read more than once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_classes(rows: DataFrame, classes: DataFrame, key: str, spread: str, total: int, wanted: str = "true", how: str = "inner") -> DataFrame:
    """rows joined to the wanted ones of classes (a row for each key, with n, how many rows have it) where a few keys may hold most of the rows.

    Fewer than ``HEAVY`` keys can have more than one in ``HEAVY`` of the total;
    those are broadcast, and their rows are dealt out by the column spread. The
    others meet by shuffle, and no key of theirs has many rows. Column n is dropped.
    """
    least = max(1, total // HEAVY)
    others = [c for c in classes.columns if c not in (key, "n")]
    heavy = cut(classes.where(F.col("n") > least).select(F.col(key).alias("_heavy"), F.expr(wanted).alias("_wanted"), *[F.col(c).alias(f"_heavy_{c}") for c in others]))
    light = classes.where((F.col("n") <= least) & F.expr(wanted)).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_light_{c}") for c in others])
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy"), "left")
    # Whatever a heavy row meets in the second join does not count.
    kind = rows.schema[key].dataType
    at = F.when(F.col("_heavy").isNull(), F.col(key)).otherwise(F.hash(spread) if isinstance(kind, IntegerType) else F.xxhash64(spread).cast(kind))
    met = marked.withColumn("_at", at).join(light, F.col("_at") == F.col("_key"), "left")
    is_heavy = F.col("_heavy").isNotNull()
    found = met.where(F.when(is_heavy, F.col("_wanted")).otherwise(F.col("_key").isNotNull())) if how == "inner" else met
    return found.select(*rows.columns, *[F.when(is_heavy & F.col("_wanted"), F.col(f"_heavy_{c}")).when(~is_heavy, F.col(f"_light_{c}")).alias(c) for c in others])


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows and few bytes, so Python objects stay few."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for column in b.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(size), 0
        while at < b.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + SLICE_BYTES, "right"))))
            yield b.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()  # else a worker that waits for its next task holds it


def strings(column: pa.Array) -> list[str]:
    """Texts, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def doc_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names; other columns cannot clash then."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
