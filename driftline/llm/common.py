"""Shared plumbing of the corpus operators: tables in the shared folder, sized joins, label folds."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 16 << 20

#: Words of the contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else (tests) one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return root or f"{spark.conf.get('spark.sql.warehouse.dir')}/.driftline-scratch"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches, rows: int = 256):
    """Arrow batches in small parts, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidied() -> None:
    """Give memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """`run` for mapInArrow, whose worker gives its memory back when a task is done: workers stay for later tasks."""

    def whole(batches):
        yield from run(batches)
        tidied()

    return whole


_scopes: list[list[Written]] = []


@contextlib.contextmanager
def scratch():
    """Tables written inside go at its end, but for those told to `keep`."""
    _scopes.append([])
    try:
        yield
    finally:
        for t in _scopes.pop():
            t.drop()


class Written:
    """A DataFrame written as Parquet in the shared folder: lineage ends here and survives lost executors."""

    def __init__(self, df: DataFrame, tag: str, files: int | None = None):
        """files: the most that a table of few rows is written to."""
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/driftline-{tag}-{uuid.uuid4().hex}"
        (df.coalesce(files) if files else df).write.parquet(self.path)
        self.schema = df.schema
        atexit.register(_remove, self.spark, self.path)
        if _scopes:
            _scopes[-1].append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)

    def keep(self) -> Written:
        """Stays when the innermost `scratch` ends."""
        if _scopes and self in _scopes[-1]:
            _scopes[-1].remove(self)
        return self


#: What a row takes in a broadcast table besides its values: header, key and pointers of the hash map (measured: 48 to 56).
ROW_OVERHEAD = 56


def sized(small: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a written table of fixed-width rows (`row_bytes` of values) for broadcast if its counted size allows; else
    leave the join to shuffle (AQE splits skew)."""
    return F.broadcast(small) if fits(small.count(), row_bytes) else small


def fits(rows: int, row_bytes: int) -> bool:
    return rows * (row_bytes + ROW_OVERHEAD) <= BROADCAST_BYTES


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, limit: int) -> DataFrame:
    """At most about `limit` labelled rows of `docs` as (text, label): a bounded training sample.

    `usable` is a predicate on doc_id; null ids and null labels are left out; a document labelled
    twice takes its highest label, an id met twice its least text. Rows are taken in the order of a hash of the id,
    so reruns agree.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    return text.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


#: Bits of a key sieve, in words of 64: at most 65,536 rows, so it is always broadcast.
SIEVE_BITS = 22


class Sieve:
    """Which 64-bit keys may be in a set: a bitmap of fixed size over the keys' top bits.

    It only spares rows a shuffle; the join behind it decides. With more keys it lets more rows through."""

    def __init__(self, keys: DataFrame, key: str):
        word, bit = self._place(F.col(key))
        one = keys.select(word.alias("word"), bit.alias("bit")).distinct()
        self.words = Written(one.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")), "sieve")

    @staticmethod
    def _place(key: Column) -> tuple[Column, Column]:
        return F.shiftrightunsigned(key, 70 - SIEVE_BITS), F.shiftrightunsigned(key, 64 - SIEVE_BITS).bitwiseAND(F.lit(63)).cast("int")

    def marked(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """`df` with a boolean: false only for keys outside the set."""
        word, bit = self._place(F.col(key))
        words = F.broadcast(self.words.df.toDF("__word", "__mask"))
        hit = F.coalesce(F.getbit("__mask", bit) == 1, F.lit(False))
        return df.withColumn("__word", word).join(words, "__word", "left").withColumn(out, hit).drop("__word", "__mask")
