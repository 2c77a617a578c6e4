"""Token ids as ORC files in the order of the documents.

General texts with an id (this library's own records are numbers, which need no
tokenizer).  Documents are range-partitioned and sorted by id, encoded inside the
tasks, and written by Spark's ORC writer:

* the ids of a document are one list of integers, which ORC stores run-length encoded;
* a file is cut into stripes of about ``stripe_bytes``, which scans read in parallel;
* row indexes (least and largest values of every ``index_rows`` documents) let a scan skip
  what lies outside a range of documents or of places in the stream;
* a Bloom filter on the document ids lets it skip where a wanted id cannot be.

``part`` is the number of a file in the order of ids, ``before`` and ``after`` the numbers of
ids that the file holds up to the start and the end of a document.  A small table beside the files (one row per
file) has the number of ids before each file, so a place in the whole stream is the sum
of two numbers and no pass over the data numbers it.

Nothing is grouped: rows that share an id are spread by their text and order of reading.
A lost task is run again over the same range and gives the same rows; Spark's commit
keeps half-written files out.

Defined results: a NULL or empty text has the end id only; a row without id comes first;
rows with equal ids are documents of their own, in the order of the first letters of their
texts and of reading; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.packing import encoder
from foldwise.operators.storage import shared_folder

#: Ids that a task passes on at once; a longer document is a batch of its own.
FLUSH_IDS = 1 << 20
#: First letters of the texts by which rows with equal ids are put in order.
TIE_LETTERS = 32


def new_token_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"


def _encode(vocabulary: str, ranks: str | None, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        encode, part, before = encoder(vocabulary, ranks), TaskContext.get().partitionId(), 0
        for batch in batches:
            first, held, sizes = 0, [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype=np.int32)
                held.append(ids)
                sizes.append(len(ids))
                if k + 1 == batch.num_rows or sum(sizes) >= FLUSH_IDS:
                    ends = np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(sizes)), pa.array(np.full(len(sizes), part, dtype=np.int32)),
                         pa.array(before + ends - sizes), pa.array(before + ends),
                         pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(held)))],
                        ["id", "part", "before", "after", "ids"])
                    first, before, held, sizes = k + 1, before + int(ends[-1]), [], []

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 2, stripe_bytes: int = 16 << 20, index_rows: int = 1000, bloom_fpp: float = 0.01) -> None:
    """Write the ids of all texts below ``folder`` (a shared one), in ascending order of ``id_col``.

    ``vocabulary`` is a file of the ``tokenizers`` library; ``ranks`` may name the same
    vocabulary as ranks, by which plain texts are encoded faster.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_read"))
    order = ["id", F.substring("text", 1, TIE_LETTERS), "_read"]  # the cut points are sampled on the driver: no whole texts
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    kind = ordered.schema["id"].dataType.simpleString()
    tokens = ordered.mapInArrow(_encode(vocabulary, ranks, end_id), f"id {kind}, part int, before long, after long, ids array<int>")
    (tokens.write.option("orc.create.index", "true").option("orc.row.index.stride", str(index_rows)).option("orc.stripe.size", str(stripe_bytes))
     .option("orc.bloom.filter.columns", "id").option("orc.bloom.filter.fpp", str(bloom_fpp)).option("compression", "zstd").orc(f"{folder}/ids"))
    spark = docs.sparkSession
    written = spark.read.schema(tokens.schema).orc(f"{folder}/ids")
    # One row per written file: as many as the write had tasks.
    sizes = written.groupBy("part").agg(F.max("after").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs")).orderBy("part").collect()
    starts = [0, *itertools.accumulate(r["n_tokens"] for r in sizes)]
    parts = [(r["part"], start, r["n_tokens"], r["n_docs"]) for r, start in zip(sizes, starts)]
    spark.createDataFrame(parts, "part int, part_start long, part_tokens long, part_docs long").coalesce(1).write.orc(f"{folder}/parts")


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parts = spark.read.schema("part int, part_start long, part_tokens long, part_docs long").orc(f"{folder}/parts")
    return spark.read.orc(f"{folder}/ids"), parts


def _placed(files: DataFrame, parts: DataFrame) -> DataFrame:
    joined = files.join(F.broadcast(parts), "part")  # one row per file
    return joined.select("id", (F.col("part_start") + F.col("before")).alias("start"), (F.col("after") - F.col("before")).alias("n_tokens"), "ids")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``id, start, n_tokens, ids`` of all documents; ``start`` counts the ids of all documents before."""
    return _placed(*_files(spark, folder))


def read_documents(spark: SparkSession, folder: str, ids) -> DataFrame:
    """The documents with some ids (a short list); stripes and row groups are skipped by their ranges and Bloom filters."""
    files, parts = _files(spark, folder)
    return _placed(files.where(F.col("id").isin(list(ids))), parts)


def read_stream(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """``id, start, ids``: the ids at the places from ``start`` to before ``stop`` of the whole stream.

    Files, stripes and row groups outside are skipped by their places.
    """
    files, parts = _files(spark, folder)
    held = parts.where((F.col("part_start") < stop) & (F.col("part_start") + F.col("part_tokens") > start)).orderBy("part").collect()
    if not held:
        return _placed(files.where("false"), parts).select("id", "start", "ids")
    first, last = held[0], held[-1]  # the files between these two lie inside as a whole
    inside = (F.col("part").between(first["part"], last["part"])
              & ((F.col("part") > first["part"]) | (F.col("after") > start - first["part_start"]))
              & ((F.col("part") < last["part"]) | (F.col("before") < stop - last["part_start"])))
    low = F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int")
    high = F.least(F.lit(stop) - F.col("start"), F.col("n_tokens")).cast("int")
    return _placed(files.where(inside), parts).select("id", (F.col("start") + low).alias("start"), F.slice("ids", low + 1, high - low).alias("ids"))


def token_digests(tokens: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of rows ``id, start, ids``: counted and summed up from the ids themselves.

    The checksum is over the ids as little-endian unsigned 32-bit integers.
    """
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            values = memoryview(np.asarray(lists.flatten()).astype("<u4")).cast("B")
            ends = np.cumsum(np.asarray(lists.value_lengths()))
            sizes = np.diff(ends, prepend=0)
            crc = [zlib.crc32(values[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(crc, type=pa.int64())],
                                             ["id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "start", "ids").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
