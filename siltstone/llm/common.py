"""Helpers shared by the training-data operators: tables, shared storage, row-local lets, Arrow text hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SEGMENT_BYTES = 256 << 10
GROUP_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on this machine, as in tests, a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that the driver and all executors see is needed")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which the driver and all executors see."""
    return f"{shared_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the cluster's shared folder; a folder is set only where none is."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to the shared folder in an operator's course: compact, read back with known sizes, and dropped when done with."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.base, self.n = spark, shared_dir(spark, purpose), 0

    def put(self, df: DataFrame) -> DataFrame:
        """df, cut off from its lineage."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes the files of a table that put() gave and that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once per row and hands it to body, inside one projection."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bit_table(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of 2^bits bits with those set that the low bits of a long column name; its size does not grow with keys."""
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column).bitwiseAND(63).cast("int"))
    words = keys.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)
    return table


def has_bit(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    slot = keys & np.uint64((1 << bits) - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


# --- Arrow text hashing -------------------------------------------------------------------------------------


def byte_class(excluded: Callable[[int], bool], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A table of word bytes, and a table of random 64-bit values by byte in which A-Z equal a-z if lower."""
    words = np.array([not excluded(b) for b in range(256)])
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return words, values


PLAIN = byte_class(lambda b: b in WHITESPACE, lower=False)
LOWERED = byte_class(lambda b: b in WHITESPACE, lower=True)
ALNUM = byte_class(lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F, lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    if isinstance(salt, np.ndarray):
        return mix(x + (salt + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return mix(x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column on end, and the offsets of its rows; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_groups(offs: np.ndarray, limit: int = GROUP_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes and of at most `rows` rows; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, i + rows, max(i + 1, j))
        yield i, j
        i = j


def _cuts(data: np.ndarray, offs: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int]]:
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + SEGMENT_BYTES)
        if b < n:
            gap = np.flatnonzero(~words[data[a:b]])
            if len(gap):
                b = a + int(gap[-1]) + 1
            else:  # one word longer than a segment
                rest = np.flatnonzero(~words[data[b:]])
                b = b + int(rest[0]) + 1 if len(rest) else n
                edge = offs[np.searchsorted(offs, a, "right")]
                b = int(min(b, edge)) if edge > a else b
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offs: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of all words of rows on end, and the word offsets of the rows."""
    words, values = kind
    hashes, starts, ends = [], [], []
    for a, b in _cuts(data, offs, words):
        piece = data[a:b]
        is_word = words[piece]
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        edges = offs[(offs > a) & (offs < b)] - a
        first[edges] = is_word[edges]
        idx = np.flatnonzero(is_word)
        if not len(idx):
            continue
        at = np.flatnonzero(first[idx])
        lens = np.diff(np.append(at, len(idx)))
        power = np.cumprod(np.full(int(lens.max()), 0x100000001B3, np.uint64))
        pos = np.arange(len(idx)) - np.repeat(at, lens)
        hashes.append(np.add.reduceat(values[piece[idx]] * power[pos], at))
        starts.append(idx[at] + a)
        ends.append(idx[at] + lens + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    start = np.concatenate(starts)
    return mix(np.concatenate(hashes)), start, np.concatenate(ends), np.searchsorted(start, offs).astype(np.int64)


def hash_words(words: list[str], kind: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The hashes that word_hashes gives these words."""
    raw = [w.encode() for w in words]
    offs = np.cumsum([0, *map(len, raw)]).astype(np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), offs, kind)[0]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position; the caller drops those that cross rows."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total, m = np.zeros(len(h) - n + 1, np.uint64), len(h) - n + 1
    factor = 0x2545F4914F6CDD1D
    for j in range(n):
        total += h[j : j + m] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return mix(total)
