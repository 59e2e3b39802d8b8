"""Token counts of flat, unindexed token files.

A file holds ids as little-endian unsigned 16-bit integers; an end-of-document id follows every document, and there is
nothing else in it. Ranges of a file's bytes are dealt out to tasks. Each task searches its ranges for end ids with vectorised
comparisons, a block at a time; a document that reaches over blocks is stitched while the range is read, and one that reaches
over ranges by a prefix scan over the ranges' open ends.

Files are read and written by pyarrow's file systems, by the URI of the folder, so that any range can be read by itself.
"""

from __future__ import annotations

import posixpath
import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.llm import byte_bpe, common

#: Ids are 16 bits wide.
MOST_ID = 0xFFFF
#: Bytes of a range that one row of a task stands for, and of a block that is searched at once; both even.
RANGE_BYTES, BLOCK_BYTES = 16 << 20, 1 << 20


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    if not re.match(r"[a-z][a-z0-9+.\-]*:", uri):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, to: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes docs into flat files under the folder to; a row for each document: the columns of keep, file (its name) and place in it.

    The rows come from the pass that wrote the ids, so they can't disagree with the files, whatever tasks are run again: a task
    that is tried again writes a file of another name, and only files that the rows name count. The result is a
    written table. A null text has no ids. An id (of the vocabulary, or end_id) beyond 16 bits is a ValueError.
    """
    ranks = byte_bpe.read_ranks(vocabulary)
    most = max((int(x.split()[1]) for x in ranks.splitlines() if x), default=0)
    if max(most, end_id) > MOST_ID:
        raise ValueError(f"id {max(most, end_id)} is above {MOST_ID}")
    raw = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        common.release("byte_bpe")
        made = byte_bpe.transducer(raw.value, pattern)
        where, folder = _opened(to)
        name, out, place = f"{uuid.uuid4().hex}.bin", None, 0
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            if out is None:
                where.create_dir(folder, recursive=True)
                out = where.open_output_stream(posixpath.join(folder, name))
            for x in batch.column(len(keep)).to_pylist():
                out.write(made.encode(x or "").astype("<u2").tobytes() + end)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([name] * n, pa.string()), pa.array(np.arange(place, place + n), pa.int64())], [*keep, "file", "place"])
            place += n
        if out is not None:
            out.close()

    schema = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes) + "file string, place long"
    return common.written(docs.select(*keep, text).mapInArrow(run, schema))


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """file, start and size of the ranges of bytes that the files of a folder are cut into, dealt out by their hash."""
    found = [x for x in _listed(path) if x[1] > 0]
    files = spark.createDataFrame(found, "file string, length long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE_BYTES).cast("long")))
    cut = files.select("file", "length", starts.alias("start")).select("file", "start", F.least(F.col("length") - F.col("start"), F.lit(RANGE_BYTES)).cast("long").alias("size"))
    total = sum(-(-n // RANGE_BYTES) for _, n in found)
    return cut.repartition(max(1, min(total, 100_000)), "file", "start")


def _listed(path: str) -> list[tuple[str, int]]:
    """Names and lengths of the files of a folder; none if there is no folder."""
    where, folder = _opened(path)
    found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((x.base_name, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")))


def count(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """A row for each document: file (its name), place (from 0, in file order) and n_tokens (without the end id).

    Ids after a file's last end id are a document of their own; an odd last byte is no id. No folder, no file, or empty ones: no rows.
    """

    def run(batches):
        where, folder = _opened(path)
        names = ["file", "start", "nth", "ends", "n_tokens"]
        for batch in batches:
            for file, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends, open_ids = 0, 0
                with where.open_input_file(posixpath.join(folder, file)) as f:
                    for at in range(start, start + size, BLOCK_BYTES):
                        data = f.read_at(min(BLOCK_BYTES, start + size - at), at)
                        ids = np.frombuffer(data, "<u2", len(data) // 2)
                        hit = np.flatnonzero(ids == end_id)
                        if not len(hit):
                            open_ids += len(ids)
                            continue
                        n = np.diff(np.r_[-1, hit]) - 1
                        n[0] += open_ids
                        k = len(n)
                        yield pa.RecordBatch.from_arrays([pa.array([file] * k, pa.string()), pa.array([start] * k, pa.int64()), pa.array(np.arange(ends, ends + k), pa.int64()), pa.array([k] * k, pa.int64()), pa.array(n, pa.int64())], names)
                        ends, open_ids = ends + k, len(ids) - 1 - int(hit[-1])
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.string()), (start, pa.int64()), (-1, pa.int64()), (ends, pa.int64()), (open_ids, pa.int64()))], names)

    found = common.written(ranges(spark, path).mapInArrow(run, "file string, start long, nth long, ends long, n_tokens long"))
    # The scan: what is open before a range is what the ranges since the last one with an end id left open.
    parts = found.where("nth < 0").withColumn("stops", (F.col("ends") > 0).cast("long"))
    order = W.Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(W.Window.unboundedPreceding, -1)
    parts = parts.withColumns({"before": F.coalesce(F.sum("ends").over(before), F.lit(0)), "run": F.coalesce(F.sum("stops").over(before), F.lit(0))})
    # A run is a range with an end id and those after it without one: their open ids add up for the next that has one.
    within = W.Window.partitionBy("file", "run").orderBy("start").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = parts.where("stops = 1").select("file", (F.col("run") + 1).alias("run"), F.col("n_tokens").alias("carried"))
    parts = parts.join(carried, ["file", "run"], "left").withColumn("inner", F.coalesce(F.sum(F.when(F.col("stops") == 0, F.col("n_tokens"))).over(within), F.lit(0)))
    parts = parts.withColumn("opened", F.coalesce("carried", F.lit(0)) + F.col("inner"))
    table = common.written(parts.select("file", "start", "before", "opened", "ends", F.col("n_tokens").alias("open_ids"), F.row_number().over(W.Window.partitionBy("file").orderBy(F.col("start").desc())).alias("from_last")))
    docs = found.where("nth >= 0").drop("ends").join(table.drop("ends", "open_ids", "from_last"), ["file", "start"])
    docs = docs.select("file", (F.col("before") + F.col("nth")).alias("place"), (F.col("n_tokens") + F.when(F.col("nth") == 0, F.col("opened")).otherwise(0)).alias("n_tokens"))
    rest = F.col("open_ids") + F.when(F.col("ends") == 0, F.col("opened")).otherwise(0)
    last = table.where("from_last = 1").select("file", (F.col("before") + F.col("ends")).alias("place"), rest.alias("n_tokens")).where("n_tokens > 0")
    return docs.unionByName(last)


def count_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int) -> DataFrame:
    """Writes docs as flat files in the shared folder, counts them, and gives each count its doc_id: doc_id, file, place, n_tokens.

    Repeated rows count each; a null or empty text has no tokens. Columns beside doc_id and text don't matter. An empty table gives no rows.
    """
    spark, at = docs.sparkSession, f"{common.shared_dir(docs.sparkSession)}/flat"
    listed = write(docs.select("doc_id", "text"), vocabulary, pattern, end_id, at)
    return listed.join(count(spark, at, end_id), ["file", "place"]).select("doc_id", "file", "place", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.read(spark, sf_dir, "documents")
    return count_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
