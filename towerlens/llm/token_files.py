"""Token ids of documents in Parquet files, in ascending key order.

Each row holds one document: its ids as a list column, its number of ids and where they start
within its file part. Parts are ranges of the key, so part numbers and in-part starts give the
place of a document in the whole token stream. List values are dictionary encoded, the sorted
number columns stay plain enough for delta encoding, row groups and pages have a set size, and
the page indexes that the writer adds let readers skip row groups and pages: a reader of a few
documents, or of the numbers alone, does not touch other ids.

Defined cases: a null text is empty and holds the end id only; null keys sort first; rows of the
same key are ordered by text; an empty table gives empty files. Other columns are not written.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from towerlens.llm.tokens import tokenizer_for

SCHEMA = "part int, doc_id long, start long, n_tokens long, ids array<int>"


def write(docs, path, tokenizer, row_group_bytes=16 << 20, page_bytes=64 << 10, key="doc_id", text="text"):
    """Encode ``docs`` and write them to ``path``; an id 0 closes every document."""

    def run(batches):
        encoder = tokenizer_for(tokenizer)
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, ids, counts in encoder.blocks(batch.column(1)):
                ends = np.cumsum(counts)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), part, np.int32)),
                        batch.column(0).slice(first, len(counts)),
                        pa.array(done + ends - counts),
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids"],
                )
                done += int(ends[-1])

    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.enable.dictionary#start", "false")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .parquet(path)
    )


def read(spark, path):
    """The documents as written; columns and rows that are not asked for are not read."""
    return spark.read.schema(SCHEMA).parquet(path)


def part_starts(spark, path):
    """part and the number of ids in all parts before it, from the number column alone."""
    totals = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def read_documents(spark, path, low, high):
    """Documents with ``low <= doc_id <= high``; the filter reaches row groups and pages."""
    return read(spark, path).filter(F.col("doc_id").between(low, high))


def read_lengths(spark, path):
    """doc_id, start in the whole stream and n_tokens, without reading any id."""
    slim = read(spark, path).select("part", "doc_id", "start", "n_tokens")
    return slim.join(part_starts(spark, path), "part").select(
        "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens"
    )


def digests(spark, path):
    """doc_id, start in the whole stream, n_tokens and the crc32 of the ids, from the files."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            data = memoryview(ids.flatten().to_numpy().astype("<u4").tobytes())
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(crc, pa.int64())],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = read(spark, path).mapInArrow(run, schema)
    return rows.join(part_starts(spark, path), "part").select(
        "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
