"""What the operators of this subpackage share: tables in the shared folder, and vectorised words of UTF-8 text."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
#: Words above this many bytes are hashed one by one.
LONG_WORD = 1 << 16
#: Characters that separate words: the white space of ASCII.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


_C = ctypes.CDLL(None)

#: Large tables that a worker process keeps between tasks, by operator.
KEPT: dict[str, dict] = {}


def release(owner: str = "") -> None:
    """In a worker: gives back what other operators kept there, so that tables of several stages don't add up."""
    others = [kept for name, kept in KEPT.items() if name != owner and kept]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):  # glibc keeps what arrays leave behind
        _C.malloc_trim(0)


def tune(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that all executors share: spark.checkpoint.dir. Where that is unset, as in tests, a local master may use one beside the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.tidemark"
    return f"{at.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor."""
    spark, at = df.sparkSession, shared_dir(df.sparkSession)
    (df.coalesce(partitions) if partitions else df).write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def training_row(doc_id: Column) -> Column:
    """The rows that models may learn from: crc32(doc_id as text) mod 5 is not 0; null ids are not among them."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def n_words(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


# --- UTF-8 columns as arrays ---------------------------------------------------------------------------------------


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows with about so many bytes; a longer row is a range of its own."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, min(end, n)
        begin = end


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPAN = SLICE_BYTES + LONG_WORD + 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < _SPAN:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:_SPAN]


_POW: dict[int, np.ndarray] = KEPT.setdefault("words", {})


def spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word reaches over the end of a text. between: whether a byte separates words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~between[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = word[cut]
    ends[cut - 1] = word[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; spans are in order. lower: A-Z count as a-z."""
    if not _POW:
        _POW.update({0: _powers(int(_BASE)), 1: _powers(pow(int(_BASE), -1, 1 << 64))})
    table, out = _LOWER if lower else _TABLE, np.empty(len(begin), np.uint64)
    i, n = 0, len(begin)
    while i < n:
        base = begin[i]
        if end[i] - base > LONG_WORD:
            raw = data[base : end[i]].tobytes()
            out[i] = xxhash.xxh64_intdigest(raw.lower() if lower else raw)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(begin, base + SLICE_BYTES, "left")))
        long = np.flatnonzero(end[i:j] - begin[i:j] > LONG_WORD)
        j = i + int(long[0]) if len(long) else j
        total = np.zeros(end[j - 1] - base + 1, np.uint64)
        np.cumsum(table[data[base : end[j - 1]]] * _POW[0][: len(total) - 1], out=total[1:])
        b, e = begin[i:j] - base, end[i:j] - base
        out[i:j] = mix((total[e] - total[b]) * _POW[1][b] + (e - b).astype(np.uint64))
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and, for n texts, the n + 1 places where their words begin."""
    begin, end = spans(data, offsets)
    return hashes(data, begin, end, lower), np.searchsorted(begin, offsets, "left")


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; at len(h) - n + 1 and after, nothing."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _BASE
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def text_or_empty(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int, unlabelled: int = 0) -> DataFrame:
    """A bounded sample of texts: doc_id, label (0, 1 or null) and text, at most per_class rows of each label and unlabelled ones without.

    The rows are those of the training fold whose ids hash lowest; of rows that share an id, one counts. Labels
    other than 0 and 1, and texts that are null or longer than most_chars, don't count.
    """
    place = F.xxhash64(F.col("doc_id"))
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(training_row(F.col("doc_id")))
    picked = [known.where(F.col("label") == y).orderBy(place, "doc_id").limit(per_class) for y in (0, 1)]
    if unlabelled:
        first = docs.where(training_row(F.col("doc_id"))).select("doc_id").orderBy(place, "doc_id").limit(4 * unlabelled)
        rest = first.distinct().join(known.where("label is not null").select("doc_id"), "doc_id", "left_anti")
        picked.append(rest.orderBy(place, "doc_id").limit(unlabelled).withColumn("label", F.lit(None).cast("int")))
    every = picked[0]
    for p in picked[1:]:
        every = every.unionByName(p)
    picked = F.broadcast(every.groupBy("doc_id").agg(F.max("label").alias("label")))
    texts = docs.select("doc_id", "text").where(F.length("text") <= most_chars).join(picked, "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
