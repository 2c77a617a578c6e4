"""Packing token streams into training sequences, online and in bounded space.

General texts with an id (this library's own records are numbers).  Every
partition of the scan keeps a fixed number of open windows.  Whole windows are cut
from long documents as they come; the rest of a document goes to the open window
with the least room that holds it.  When none does, the fullest window is emitted
and a new one opened.  What is still open at the end of a partition is merged
with the leftovers of a fixed number of other partitions, end to end, so that
each such group leaves at most one sequence that is not full.

A task holds ``open_windows`` windows, a merging task ``merge_partitions`` times as
many: both are constants.  Text is not shuffled.  A lost task is run again over
the same part of the files and places the same pieces.

Defined results: a NULL or empty text has the end id only; rows with equal ids are
packed each for itself; an empty table has no pieces; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.tables import small_batches
from foldwise.operators.storage import materialize

#: Characters on which both tokenizer libraries are known to cut alike.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ–—‘-„…€]*")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None):
    """Text to ids of the ``vocabulary`` file.

    ``ranks`` may name the same vocabulary as ranks: plain texts then take the
    faster library, every other text the one that owns the format.
    """
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary)
    if ranks is None:
        return lambda text: full.encode(text, add_special_tokens=False).ids
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str):
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return fast.encode_ordinary(text)
        return full.encode(text, add_special_tokens=False).ids

    return encode


class Packer:
    """Best fit into at most ``limit`` open windows of ``size`` ids; ``emit(window)`` gets closed ones."""

    def __init__(self, size: int, limit: int, emit):
        self.size, self.limit, self.emit = size, limit, emit
        self.rooms: list[tuple[int, int]] = []  # (room, window), least room first
        self.windows: dict[int, list] = {}
        self.made = 0

    def add(self, piece, length: int) -> None:
        at = bisect_left(self.rooms, (length, -1))
        if at == len(self.rooms):
            if len(self.rooms) == self.limit:
                self._close(self.rooms.pop(0)[1])
            insort(self.rooms, (self.size, self.made))
            self.windows[self.made] = []
            at = len(self.rooms) - 1
            self.made += 1
        room, window = self.rooms.pop(at)
        self.windows[window].append((self.size - room, piece))
        if room == length:
            self._close(window)
        else:
            insort(self.rooms, (room - length, window))

    def _close(self, window: int) -> None:
        self.emit(window, self.windows.pop(window))

    def leftovers(self):
        return sorted(self.windows.items())


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
           ("offset", pa.int64()), ("ids", pa.binary())]
_SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _place(vocabulary, ranks, end_id, size, open_windows, schema):
    from pyspark import TaskContext

    schema = schema.append(pa.field("part", pa.int64()))

    def run(batches):
        encode = encoder(vocabulary, ranks)
        part = TaskContext.get().partitionId()
        out: list[tuple] = []

        def emit(window, pieces, leftover=None):
            for offset, (doc, start, total, ids) in pieces:
                out.append((doc, start, len(ids) // 4, total, (part << 32) + window, offset, ids, leftover))

        def flush():
            done = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return done

        packer = Packer(size, open_windows, emit)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, ids = doc.as_py(), array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                total, data = len(ids), np.asarray(ids, dtype="<u4").tobytes()
                whole = total // size * size
                for start in range(0, whole, size):
                    emit(packer.made, [(0, (doc, start, total, data[4 * start:4 * (start + size)]))])
                    packer.made += 1
                if whole < total:
                    packer.add((doc, whole, total, data[4 * whole:]), total - whole)
                if len(out) >= 1024:
                    yield flush()
        for window, pieces in packer.leftovers():
            emit(window, pieces, part)
        if out:
            yield flush()

    return run


def _merge(size, schema):
    def run(key, table):
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        base, at, rows = (1 << 62) + (key[0].as_py() << 32), 0, []
        for r in table.select(schema.names).to_pylist():
            done = 0
            while done < r["length"]:
                n = min(size - at % size, r["length"] - done)
                rows.append((r["_id"], r["start"] + done, n, r["doc_tokens"], base + at // size, at % size, r["ids"][4 * done:4 * (done + n)]))
                done, at = done + n, at + n
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


@small_batches
def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "", ranks: str | None = None,
         size: int = 1024, end_id: int = 0, open_windows: int = 64, merge_partitions: int = 16) -> DataFrame:
    """One row per piece: ``id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers;
    ``start`` is its place in the document, ``offset`` that in its sequence.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T._parse_datatype_string(f"{_SCHEMA}, part long")
    schema = T.StructType([T.StructField("_id", kind), *schema.fields])
    arrow = pa.schema([("_id", to_arrow_type(kind)), *_FIELDS])
    placed = materialize(source.mapInArrow(_place(vocabulary, ranks, end_id, size, open_windows, arrow), schema))
    closed = placed.where("part is null").drop("part")
    merged = (placed.where("part is not null").withColumn("_group", F.floor(F.col("part") / merge_partitions))
              .groupBy("_group").applyInArrow(_merge(size, arrow), closed.schema))
    return closed.unionByName(merged).withColumnRenamed("_id", id_col)
