"""Helpers the text operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "[ \\t-\\r]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet in the folder all executors share, and read back.

    Cuts the lineage: a lost executor costs no recomputation of what stands before. The files' sizes
    also let Spark see how large the table is."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of intermediate tables that goes when the block ends; what outlives it is `stored` elsewhere."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        """`df` written under `label` and read back; a label is used once unless dropped."""
        df.write.parquet(f"{self.folder}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{label}")

    def drop(self, label: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{label}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_: object) -> None:
        self.drop()


def broadcast_within(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """`df` marked for broadcast if its counted `rows` are at most `limit`; else left to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def lower_ascii(text: Column) -> Column:
    """`text` with A-Z lower-cased and all other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, breaks: str = SPACES) -> Column:
    """The words between `breaks`; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), breaks), "")


def text_key(text: Column) -> list[Column]:
    """Columns that tell texts apart: with the row's id they name a row without comparing whole texts."""
    return [F.xxhash64(text), F.md5(F.coalesce(text, F.lit("\0"))).substr(1, 16)]


# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64_of(*columns: np.ndarray) -> np.ndarray:
    """What `F.xxhash64` gives for columns of longs, as unsigned numbers."""
    seed = np.full(len(columns[0]), 42, np.uint64)
    for values in columns:
        x = seed + _P5 + np.uint64(8)
        x ^= _turned(values.astype(np.uint64, copy=False) * _P2, 31) * _P1
        x = _turned(x, 27) * _P1 + _P4
        x = (x ^ (x >> np.uint64(33))) * _P2
        x = (x ^ (x >> np.uint64(29))) * _P3
        seed = x ^ (x >> np.uint64(32))
    return seed


#: Bits of a bit table, a power of two: 4 MB, whatever the input.
TABLE_BITS = 1 << 25


def bit_table(hashes: DataFrame, column: str, bits: int = TABLE_BITS) -> bytes:
    """One bit for each value of the long `column`, by its low bits: a filter of fixed size that lets every listed value through.

    It only spares work. What passes wrongly must not change a result."""
    at = F.pmod(F.col(column), F.lit(bits)) + 1
    rows = hashes.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit"))
    parts = rows.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    table = bytearray(bits // 8)
    for part, piece in parts:
        size = min(len(piece), bits // 8)
        table[(part - 1) * size:part * size] = piece[:size]
    return bytes(table)


def is_listed(table: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes a bit table lets through."""
    at = hashes & np.uint64(len(table) * 8 - 1)
    byte = np.frombuffer(table, np.uint8)[(at >> np.uint64(3)).astype(np.int64)]
    return (byte >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def listed(table: bytes, hashed: Column) -> Column:
    """Whether a bit table lets the long `hashed` through, as a column."""

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        return pd.Series(is_listed(table, values.to_numpy(np.int64).view(np.uint64)))

    return found(hashed)
