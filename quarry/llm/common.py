"""Helpers that the corpus operators share: table access, bounded text blocks, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_R = pow(0x9E3779B97F4A7C15 | 1, 1, 1 << 64)
_R_INV = pow(_R, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of the warehouse where none is set (tests)."""
    ctx = spark.sparkContext
    if ctx.getCheckpointDir() is None:
        ctx.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return ctx.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Hands freed memory back to the system: Python workers live on from stage to stage, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def blocks(batches, max_bytes: int = 1 << 20, column: str = "text"):
    """Slices Arrow batches into record batches of about max_bytes of text; a longer text is a block of its own."""
    yield from _blocks(batches, max_bytes, column)
    give_back()


def _blocks(batches, max_bytes: int, column: str):
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = offsets(col)[1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else offsets(col)[0]
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, with its slice taken into account."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets into them); a null text has no bytes."""
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = offsets(col)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if _TABLES.get("r", np.zeros(0)).size < n:
        size = max(n, 1 << 16)
        for key, base in (("r", _R), ("i", _R_INV)):
            out = np.empty(size, U64)
            out[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                np.multiply(out[:step], U64(pow(base, done, 1 << 64)), out=out[done : done + step])
                done += step
            _TABLES[key] = out
    return _TABLES["r"], _TABLES["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def word_bounds(data: np.ndarray, doc_off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of word bytes; runs never cross documents."""
    mask = is_word[data]
    n = mask.size
    edge = np.zeros(n + 1, bool)
    edge[doc_off] = True
    before = np.concatenate(([False], mask[:-1])) if n else mask
    after = np.concatenate((mask[1:], [False])) if n else mask
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span, by prefix sums of a polynomial."""
    r, inv = powers(data.size + 1)
    sums = np.zeros(data.size + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * r[: data.size], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts])


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of every n consecutive word hashes (length len(h) - n + 1)."""
    size = h.size - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = h[:size].copy()
    for k in range(1, n):
        out = out * U64(0xD6E8FEB86659FD93) + h[k : k + size]
    return mix(out)


def byte_table(word: bytes | None = None, separators: bytes = b"") -> np.ndarray:
    """Which of the 256 byte values belong to words."""
    out = np.ones(256, bool) if word is None else np.zeros(256, bool)
    if word is not None:
        out[list(word)] = True
    out[list(separators)] = False
    return out


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
#: `[^\x20\x09-\x0D]+`
SPACED = np.array([b != 0x20 and not 9 <= b <= 13 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def held_out(doc_id, mod: int, rest: int):
    """Column: crc32 of the id as text leaves `rest` modulo `mod`; a null id is never held out."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


MARK_WORDS = 1 << 19  # of 64 bits: what `may_be_among` broadcasts at most


def may_be_among(rows: DataFrame, column, keys: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column `name`: false only where the number `column` is surely not in keys (one column).

    The keys are folded into a bitmap of MARK_WORDS words, which is broadcast: its size is bounded whatever their number
    (the more there are, the less it tells). So a join needs to shuffle only rows that may have a partner."""
    from pyspark.sql import functions as F

    h = lambda c: F.xxhash64(c.cast("long"))
    word = lambda c: F.shiftrightunsigned(h(c), 6).bitwiseAND(F.lit(MARK_WORDS - 1))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), h(c).bitwiseAND(F.lit(63)).cast("int"))
    key = F.col(keys.columns[0])
    marks = keys.select(word(key).alias(f"{name}_word"), bit(key).alias("b")).groupBy(f"{name}_word").agg(F.bit_or("b").alias(f"{name}_mask"))
    found = rows.withColumn(f"{name}_word", word(column)).withColumn(f"{name}_bit", bit(column)).join(F.broadcast(marks), f"{name}_word", "left")
    may = F.coalesce(F.col(f"{name}_mask").bitwiseAND(F.col(f"{name}_bit")) != 0, F.lit(False))
    return found.withColumn(name, may).drop(f"{name}_word", f"{name}_bit", f"{name}_mask")


def as_long(values, mask=None) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), mask=mask)
