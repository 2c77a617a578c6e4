"""Alignment of the tokens of two tokenizers over the same text.

General texts with an id (this library's own records are numbers, which need no
tokenizer).  Whole texts go through both tokenizers: ``A`` of the ``tokenizers``
library (byte-level pairs) and ``B`` of the ``sentencepiece`` library (pairs with byte
fallback).  A text takes part if the bytes of its tokens, joined, are a space and the
text for both.

* **Groups and links.**  Both sides cover the same bytes, so the sorted places at which their
  tokens end give all of it for a whole slice of texts at once: groups are cut where both
  sides end, and a token is linked with those from the first one that ends after its start.
* **Counts.**  A pair's count is the number of documents that link it.  Pairs are counted
  from one row per document and pair, added up before the shuffle.  The most frequent
  pairs, as many as ``broadcast_pairs``, are broadcast for the scores, so that they are
  never shuffled; all others (each in few documents, so none is hot) are joined by a shuffle.

Memory: a slice of texts (about 1 MB, or one document) is handled at once.

Defined results: NULL and empty texts, and texts whose tokens do not give back their bytes
(such as those with U+2581), have no tokens, only zeros and an empty digest; special tokens
in texts are plain text; rows with equal ids are documents of their own; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.packing import _PLAIN
from foldwise.llm.words import lists, slices
from foldwise.operators.storage import materialize

#: Ids of a pair are packed into one number.
ID_BITS = 20


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Bytes of every token of one side: their number, and themselves."""

    def __init__(self, pieces: list[bytes]):
        if len(pieces) >= 1 << ID_BITS:
            raise ValueError(f"a vocabulary of {len(pieces)} tokens; ids must stay below {1 << ID_BITS}")
        self.pieces = pieces
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)


@lru_cache(maxsize=2)
def byte_level(vocabulary: str, ranks: str | None):
    """``(encode, Vocabulary)`` of a byte-level file; ``ranks`` may name the same vocabulary as ranks."""
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary)
    full.encode_special_tokens = True
    letters, names = _byte_letters(), full.get_vocab()
    pieces = [b""] * (max(names.values()) + 1)
    for name, k in names.items():
        pieces[k] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
    if ranks is None:
        return (lambda text: full.encode(text, add_special_tokens=False).ids), Vocabulary(pieces)
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str):
        return fast.encode_ordinary(text) if _PLAIN.fullmatch(text) else full.encode(text, add_special_tokens=False).ids

    return encode, Vocabulary(pieces)


@lru_cache(maxsize=2)
def piece_level(model: str):
    """``(encode, Vocabulary)`` of a ``sentencepiece`` model; ``encode`` takes a list of texts."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [bytes([int(own.id_to_piece(k)[3:5], 16)]) if own.is_byte(k) else own.id_to_piece(k).replace("▁", " ").encode()
              for k in range(own.get_piece_size())]
    return (lambda texts: own.encode(texts, num_threads=1)), Vocabulary(pieces)


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``first[k]`` to before ``first[k] + size[k]``, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


@lru_cache(maxsize=2)
def _names(n: int) -> list[bytes]:
    """Ids below ``n`` as text inside a group, then as the last one of side A, then of side B."""
    return [b"%d%s" % (k, mark) for mark in (b",", b"|", b";") for k in range(n)]


def align_ids(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
    """Ids of both sides over the same bytes: names of their groups, where A's ids end one, and B's linked with each id of A.

    The names are places in ``_names`` of the larger vocabulary, in the order of the text; ids linked are
    ``number`` ones from place ``first`` on.
    """
    n, ends_a, ends_b = max(len(size_a), len(size_b)), np.cumsum(size_a[a]), np.cumsum(size_b[b])
    at = np.searchsorted(ends_b, ends_a)
    last_a = ends_b[at] == ends_a
    last_b = np.zeros(len(b), dtype=bool)
    last_b[at[last_a]] = True
    first = np.append(0, (at + last_a)[:-1])
    names = np.empty(len(a) + len(b), dtype=np.int64)
    names[np.arange(len(a)) + np.append(0, np.flatnonzero(last_b) + 1)[np.cumsum(last_a) - last_a]] = a + n * last_a
    names[np.arange(len(b)) + (np.flatnonzero(last_a) + 1)[np.cumsum(last_b) - last_b]] = b + 2 * n * last_b
    return names, last_a, first, at - first + 1


def _linked_ids(a: np.ndarray, b: np.ndarray, first: np.ndarray, number: np.ndarray) -> np.ndarray:
    return np.repeat(a, number) << ID_BITS | b[_ragged(first, number)]


def align_window(a: list[int], b: list[int], size_a, size_b) -> tuple[bytes, int, list[int]]:
    """Groups as text, their number, and the linked pairs of ids that both sides cover exactly."""
    a, b, size_a, size_b = (np.asarray(x, dtype=np.int64) for x in (a, b, size_a, size_b))
    names, ends, first, number = align_ids(a, b, size_a, size_b)
    text = b"".join(map(_names(max(len(size_a), len(size_b))).__getitem__, names.tolist()))
    return text[:-1], int(ends.sum()), _linked_ids(a, b, first, number).tolist()


_COLUMNS = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>"


def _align(vocabulary: str, model: str, ranks: str | None):
    def slice_rows(texts: list[str], side_a, side_b):
        """Counts, digests, and distinct pairs with their numbers of links, per text."""
        (encode_a, voc_a), (encode_b, voc_b) = side_a, side_b
        n = len(texts)
        counts, digests = np.zeros((4, n), dtype=np.int64), [""] * n
        all_a, all_b, used = [], [], []
        for k, ids_b in zip(range(n), encode_b(texts)):
            if texts[k]:
                spaced = " " + texts[k]
                ids_a, whole = encode_a(spaced), spaced.encode()
                if b"".join([voc_b.pieces[x] for x in ids_b]) == whole and b"".join([voc_a.pieces[x] for x in ids_a]) == whole:
                    all_a.append(np.array(ids_a, dtype=np.int64))
                    all_b.append(np.array(ids_b, dtype=np.int64))
                    used.append(k)
        if not used:
            return counts, digests, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        counts[0, used], counts[1, used] = [len(x) for x in all_a], [len(x) for x in all_b]
        a, b = np.concatenate(all_a), np.concatenate(all_b)
        names, ends, first, number = align_ids(a, b, voc_a.size, voc_b.size)
        edges_a, edges_b = (np.append(0, np.cumsum([len(x) for x in y])) for y in (all_a, all_b))
        counts[2, used], counts[3, used] = (np.add.reduceat(x.astype(np.int64), edges_a[:-1]) for x in (ends, number))
        text, order = _names(max(len(voc_a.size), len(voc_b.size))).__getitem__, names.tolist()
        edges = (edges_a + edges_b).tolist()
        for k, lo, hi in zip(used, edges[:-1], edges[1:]):
            digests[k] = hashlib.sha256(b"".join(map(text, order[lo:hi]))[:-1]).hexdigest()
        owner = np.repeat(np.repeat(np.array(used, dtype=np.int64), np.diff(edges_a)), number)
        mixed, times = np.unique(owner << (2 * ID_BITS) | _linked_ids(a, b, first, number), return_counts=True)
        return counts, digests, mixed & ((1 << 2 * ID_BITS) - 1), times, np.searchsorted(mixed >> (2 * ID_BITS), np.arange(n + 1))

    def run(batches):
        from pyspark import TaskContext

        side_a, side_b = byte_level(vocabulary, ranks), piece_level(model)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, _, _ in slices(texts):
                counts, digests, pairs, times, edges = slice_rows([t or "" for t in texts.slice(lo, hi - lo).to_pylist()], side_a, side_b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.arange(row, row + hi - lo)), *[pa.array(c) for c in counts],
                     pa.array(digests, type=pa.string()), lists(pairs, edges), lists(times.astype(np.int32), edges)],
                    ["id", *[c.split()[0] for c in _COLUMNS.split(", ")]])
                row += hi - lo

    return run


def align(docs: DataFrame, vocabulary: str, model: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: ``id, row`` (a number of its own), counts, digest of the groups, and the linked ``pairs`` with their ``times``.

    ``vocabulary`` is a byte-level file of the ``tokenizers`` library, which encodes a
    space and the text; ``model`` is a ``sentencepiece`` model, which adds the space.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_align(vocabulary, model, ranks), f"id {rows.schema['id'].dataType.simpleString()}, {_COLUMNS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n_docs, best``: documents that link each pair, and whether no pair of its A id is in more."""
    counted = materialize(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")))
    a = F.shiftright("pair", ID_BITS).alias("_a")
    most = counted.groupBy(a).agg(F.max("n_docs").alias("_most"))  # at most one row per token of A
    joined = counted.withColumn("_a", a).join(F.broadcast(most), "_a")
    return joined.select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def _frequent_enough(counts: DataFrame, limit: int) -> int | None:
    """The least power of two so that at most ``limit`` pairs are in as many documents; None if all pairs are few enough."""
    level = F.floor(F.log2("n_docs")).cast("int").alias("level")
    sizes = counts.groupBy(level).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()  # at most 64 rows
    total = 0
    for r in sizes:
        total += r["n"]
        if total > limit:
            return 2 ** (r["level"] + 1)
    return None


def link_scores(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = 500_000) -> DataFrame:
    """``row, n_best, count_sum`` for the rows of ``aligned`` (written) with links, by ``counts`` (written)."""
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")]
    least = _frequent_enough(counts, broadcast_pairs)
    if least is None:
        return links.join(F.broadcast(counts), "pair").groupBy("row").agg(*sums)
    often = counts.where(F.col("n_docs") >= least)
    near = links.join(F.broadcast(often), "pair").groupBy("row").agg(*sums)
    rest = links.join(F.broadcast(often.select("pair")), "pair", "left_anti")
    far = rest.join(counts.where(F.col("n_docs") < least), "pair").groupBy("row").agg(*sums)
    return near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_table(docs: DataFrame, vocabulary: str, model: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                    broadcast_pairs: int = 500_000) -> DataFrame:
    """One row per text: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts the links whose pair is in no fewer documents than any other pair of
    its A id; ``count_sum`` adds up the documents of the pairs over all links.
    """
    aligned = materialize(align(docs, vocabulary, model, ranks, id_col, text_col))
    scores = link_scores(aligned, materialize(pair_counts(aligned)), broadcast_pairs)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs", "times").join(scores, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
