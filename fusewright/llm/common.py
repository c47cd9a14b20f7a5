"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a writer of scratch tables gathers.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode only (tests), one of its own where that is unset."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not told and not (sc.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="fusewright-"))
    return (told or sc.getCheckpointDir()).rstrip("/")


class Scratch:
    """Tables written to the shared folder; drop() removes them once nothing lazy reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder: cuts the lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """For the jobs run within: so many rows at most go to Python at once, since rows that hold whole sets are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: A group with more than this share of all rows is hot; so there are at most 20,000 hot ones.
HOT = 20_000


def with_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """rows left joined with their groups (keys without nulls, one row each, n rows of `rows` in it), large groups unsplit by no shuffle.

    Groups with more than 1 / HOT of all rows are at most HOT in number, so they are broadcast and
    their rows stay where they are; other rows meet their groups in a shuffle, in which no key is
    large. Both tables are read several times: settle them first.
    """
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = groups.where(F.col(n) * HOT > total)
    cold = groups.where(F.col(n) * HOT <= total)
    few = F.broadcast(hot)
    first = rows.join(few, list(keys), "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(cold, list(keys), "left")
    return first.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """The name, or one made longer until no column of docs has it, upper and lower case taken for the same."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def numbered(docs: DataFrame) -> DataFrame:
    """Columns by number: mapInArrow doesn't take names with dots."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0: such labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about most_bytes of the given text column, so that long texts don't add up in memory."""
    for b in batches:
        if not b.num_rows:
            continue
        each = max(1, int(b.num_rows * most_bytes / max(1, b.column(column).nbytes)))
        for i in range(0, b.num_rows, each):
            yield b.slice(i, each)


_tenant: list = []


def tenant(name: str, forget: Callable[[], object] = lambda: None) -> None:
    """To be called where a task begins: workers outlive tasks, so what another operator remembers in this one is dropped, and memory returned."""
    if _tenant and _tenant[0] != name:
        _tenant[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    _tenant[:] = [name, forget]
