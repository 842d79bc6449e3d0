"""Shared storage for intermediate tables, and word hashing used by several operators.

Everything that cuts lineage is a Parquet table under ``spark.checkpoint.dir`` (the folder that the driver and all
executors share), so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and the master is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tickloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """A folder of intermediate tables in the shared root.

    As a context manager it deletes on exit every table that was not kept; kept ones back the returned DataFrame and
    stay until the checkpoint folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*self.tables)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        df.write.parquet(self.path(name))
        if not keep:
            self.tables.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self.tables.discard(name)
            delete_path(self.spark, self.path(name))


def text_key() -> F.Column:
    """64-bit key of the text column, with which a row is found again even where doc_id is null or repeated."""
    return F.xxhash64("text")


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with per-worker state: ``make`` runs once in each task and returns the function for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                yield step(batch)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words, remembered; the memory is emptied when it holds ``limit`` words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    start = np.uint64(seed * 0x632BE59BD9B4E019 % 2**64)
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def runs_of(hashes: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """Hash of every ``width`` consecutive values; empty when there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = constants(width, seed)
    total = hashes[:n] * factors[0]
    for k in range(1, width):
        total += hashes[k : k + n] * factors[k]
    return mix(total)


#: Maps every byte that is no ASCII letter or digit, below 0x80, to a space, and A-Z to a-z.
ALNUM_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_space_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def lower_alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_LOWER).split() if text else []
