"""Near-duplicate documents by a chosen-path set similarity join.

General texts with an id.  A document is the set of its word shingles, kept as
minwise tokens: per hash order the smallest shingle.  A tree branches documents by
chosen tokens: a node picks one of the orders (now and then two, so that a pair at
the threshold stays together in one child on average), and documents with the same
token there go to the same child.  Small nodes are compared exhaustively by their
tokens; in a large node every document is compared with one pivot, and then the
node branches again.  Independent trees repeat this until the target recall is met.  Candidate
pairs are confirmed on the full shingle sets, read again from the texts.

How groups of copies are kept cheap without losing links: documents with equal sets
are one item; after every level, items that confirmed links already connect are
not compared with each other again, and a node whose items are all connected is
done.  In the last level all nodes are compared exhaustively, whatever their size,
so no node is ever dropped or cut.

Defined results: a NULL text, an empty one or one without words has an empty set
and is linked with nothing; rows with equal ids are one document (all their sets
count as linked); NULL ids keep their row, linked with nothing; an empty table stays
empty.  Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.tables import components, small_batches, small_side
from foldwise.llm.words import SMALL_SLICE_BYTES, Words, constants, distinct_sets, lists, minhashes, shingles, slices
from foldwise.operators.storage import materialize

#: Hash orders per document; branching reads 32 bits of each, comparing 8 bits.
ORDERS = 128
#: More orders for the items of nodes that are compared in full.
FINE_ORDERS = 512
#: Standard errors by which the estimate of a linked pair may fall short before it is confirmed.
SIGMAS = 4.5


def _sets(batches, shingle_words, lower, give):
    """Per slice of documents: ids, word sets and their bounds, for ``give``."""
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, bounds in slices(batch.column(1), SMALL_SLICE_BYTES):
            words = Words(data, bounds, lower)
            hashes, owner = shingles(words, shingle_words)
            flat, edges = distinct_sets(hashes, owner, hi - lo)
            yield give(ids.slice(lo, hi - lo), flat, edges)


def signatures(docs: DataFrame, shingle_words: int, lower: bool = True, orders: int = ORDERS) -> DataFrame:
    """``id, n_shingles, key, key2, tokens, marks`` per row: set size, two hashes of the set, minwise tokens, their last bytes."""
    seeds = constants(21, orders)

    def give(ids, flat, edges):
        n = np.diff(edges)
        some = np.flatnonzero(n > 0)
        starts = np.append(edges[:-1][some], edges[-1])
        tokens = minhashes(flat, starts, seeds)
        keys = []
        for multiplier in constants(22, 2):
            sums = np.zeros(len(n), dtype=np.uint64)
            if len(some):
                mixed = (flat ^ (flat >> np.uint64(29))) * multiplier
                sums[some] = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts[:-1])
            keys.append(pa.array(sums.view(np.int64)))
        packed, marks = [None] * len(n), [None] * len(n)
        last = (tokens & 255).astype(np.uint8)
        for row, doc in enumerate(some):
            packed[doc], marks[doc] = tokens[row].tobytes(), last[row].tobytes()
        return pa.RecordBatch.from_arrays([ids, pa.array(n), *keys, pa.array(packed, type=pa.binary()), pa.array(marks, type=pa.binary())],
                                          ["id", "n_shingles", "key", "key2", "tokens", "marks"])

    return docs.select("id", "text").mapInArrow(
        lambda batches: _sets(batches, shingle_words, lower, give),
        f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, key long, key2 long, tokens binary, marks binary")


def full_sets(docs: DataFrame, shingle_words: int, lower: bool = True) -> DataFrame:
    """``id, set`` with the distinct shingle hashes of every document."""
    def give(ids, flat, edges):
        return pa.RecordBatch.from_arrays([ids, lists(flat, edges)], ["id", "set"])

    return docs.select("id", "text").mapInArrow(lambda batches: _sets(batches, shingle_words, lower, give),
                                                f"id {docs.schema['id'].dataType.simpleString()}, set array<bigint>")


def fine_marks(docs: DataFrame, shingle_words: int, orders: int = FINE_ORDERS) -> DataFrame:
    """``item, fine, set``: last bytes of the minwise tokens of ``orders`` further hash orders, and the full set."""
    seeds = constants(23, orders)

    def give(ids, flat, edges):
        some = np.flatnonzero(np.diff(edges) > 0)
        tokens = (minhashes(flat, np.append(edges[:-1][some], edges[-1]), seeds) & 255).astype(np.uint8)
        sets = [flat[edges[d]:edges[d + 1]].tobytes() for d in some]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array([t.tobytes() for t in tokens], type=pa.binary()),
                                           pa.array(sets, type=pa.binary())], ["item", "fine", "set"])

    return docs.select("id", "text").mapInArrow(lambda batches: _sets(batches, shingle_words, True, give),
                                                f"item {docs.schema['id'].dataType.simpleString()}, fine binary, set binary")


def trees_for(threshold: float, recall: float, levels: int = 3) -> int:
    """Independent trees so that a pair at the threshold shares a leaf ``levels`` deep with chance ``recall``.

    A pair of similarity s stays together in s / threshold children on average, so
    survival follows a branching process: q' = 1 - (1 - s q)(1 - (1/threshold - 1) s q).
    """
    stay, extra = 1.0, 1 / threshold - 1
    for _ in range(levels):
        hit = threshold * stay
        stay = 1 - (1 - hit) * (1 - extra * hit)
    return math.ceil(math.log(1 - recall) / math.log(1 - stay))


def _children(rows: DataFrame, threshold: float, orders: int) -> DataFrame:
    """The children of ``rows(node, item, tokens, ...)``, one row per chosen token."""
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(orders)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(orders - 1)), F.lit(orders)).cast("int")
    twice = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * (1 / threshold - 1))
    chosen = F.filter(F.array(first, F.when(twice, second)), lambda k: k.isNotNull())
    rows = rows.withColumn("_order", F.explode(chosen))
    return rows.withColumn("node", F.xxhash64("node", "_order", F.substring("tokens", 4 * F.col("_order") + 1, F.lit(4)))).drop("_order")


def marks_of(column: pa.Array, orders: int) -> np.ndarray:
    """The marks of a binary column as rows of bytes."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at:at + len(column) * orders].reshape(len(column), orders)


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Share of equal marks per row, and whether it allows a similarity of ``threshold``."""
    orders = a.shape[1]
    share = np.add.reduce((a == b).view(np.uint8), axis=1, dtype=np.uint8 if orders < 256 else np.uint16) / orders
    # Different tokens have equal marks once in 256 times.
    return share, share >= threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / orders)


def _likely(orders: int, threshold: float):
    """The pairs ``(a, b, marks_a, marks_b)`` that are similar enough by their marks."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, ok = alike(marks_of(batch.column(2), orders), marks_of(batch.column(3), orders), threshold)
                at = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` with ``100 * |intersection| >= percent * |union|`` on full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("_b")), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(100 * common >= percent * (F.size("_a") + F.size("_b") - common)).select("a", "b")


def compare(percent: int, all_pairs: int, orders: int):
    """Pairs ``a, b, sure`` within the nodes of a partition sorted by node.

    Rows are compared with the ``d``-th row after them, for all nodes of a batch at
    once.  Items that links connect already (equal roots) are no pair.  In a node of
    over ``all_pairs`` items every item at first only names its most similar
    partner, which connects most of a group of copies.  A node that is compared in
    full has the sets of its items: pairs are confirmed here (``sure``), the most
    similar ones first, and only those that connect something are given.
    """
    threshold = percent / 100

    def compared(nodes, roots, sizes, marks, full, fine):
        count = np.unique(nodes, return_counts=True)[1]
        every = (np.repeat(count, count) <= all_pairs) | full
        best, partner = np.zeros(len(nodes)), np.full(len(nodes), -1)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        at, d = np.arange(len(nodes)), 0
        while len(at):
            d += 1
            at = at[at + d < len(nodes)]
            at = at[nodes[at] == nodes[at + d]]
            to = at + d
            ok = (roots[at] != roots[to]) & (100 * np.minimum(sizes[at], sizes[to]) >= percent * np.maximum(sizes[at], sizes[to]))
            i, j = at[ok], to[ok]
            like, near = alike(marks[i], marks[j], threshold)
            i, j, like = i[near], j[near], like[near]
            if fine is not None and len(i):
                closer, sure = alike(np.concatenate([marks[i], fine[i]], axis=1), np.concatenate([marks[j], fine[j]], axis=1), threshold)
                sure |= ~full[i]
                i, j, like = i[sure], j[sure], np.where(full[i], closer, like)[sure]
            whole = every[i]
            found.append((i[whole], j[whole], like[whole]))
            for x, y in ((i, j), (j, i)):
                better = (like > best[x]) & ~every[x]
                best[x[better]], partner[x[better]] = like[better], y[better]
        named = np.flatnonzero(partner >= 0)
        found.append((named, partner[named], best[named]))
        return [np.concatenate(x) for x in zip(*found)]

    def confirmed(i, j, like, nodes, roots, sets):
        up: dict = {}

        def top(x):
            while x in up:
                x = up[x]
            return x

        keep = []
        for k in np.argsort(-like, kind="stable"):
            x, y = top((nodes[i[k]], roots[i[k]])), top((nodes[j[k]], roots[j[k]]))
            if x != y:
                one, two = (np.frombuffer(sets[r].as_buffer(), dtype=np.uint64) for r in (int(i[k]), int(j[k])))
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    up[x] = y
                    keep.append(k)
        return np.array(keep, dtype=np.int64)

    def give(table):
        table = table.combine_chunks()
        column = {n: table.column(n).chunk(0) for n in table.column_names}
        nodes, full = column["node"].to_numpy(), column["full"].to_numpy(zero_copy_only=False)
        roots, fine = column["root"].dictionary_encode().indices.to_numpy(zero_copy_only=False), None
        if full.any() and "fine" in column:
            # Items of other nodes have no fine marks; theirs are not looked at.
            none = bytes(FINE_ORDERS)
            fine = np.frombuffer(b"".join(x if x is not None else none for x in column["fine"].to_pylist()), dtype=np.uint8).reshape(-1, FINE_ORDERS)
        i, j, like = compared(nodes, roots, column["size"].to_numpy(), marks_of(column["marks"], orders), full, fine)
        sure = full[i]
        done = np.flatnonzero(sure)
        keep = np.concatenate([np.flatnonzero(~sure), done[confirmed(i[done], j[done], like[done], nodes, roots, column["set"])]]).astype(np.int64)
        return pa.RecordBatch.from_arrays([column["item"].take(pa.array(i[keep])), column["item"].take(pa.array(j[keep])), pa.array(sure[keep])],
                                          ["a", "b", "sure"])

    def run(batches):
        held: list = []  # all that came but the last node is compared; that one may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(batch.schema.get_field_index("node")).to_numpy()
            cut = int(np.searchsorted(nodes, nodes[-1]))
            if cut or held and held[-1].column("node")[-1].as_py() != nodes[-1]:
                yield give(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield give(pa.Table.from_batches(held))

    return run


@small_batches
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80,
                    recall: float = 0.9999, all_pairs: int = 32, small_node: int = 2048, levels: int = 4, orders: int = ORDERS,
                    first_trees: int = 2) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    Two documents are linked if their sets of ``shingle_words``-word shingles (A-Z
    lower-cased) have ``100 * |intersection| >= percent * |union|``.
    ``component_id`` is the smallest id that links reach; ``kept`` marks it.
    ``first_trees`` grow before the others, so that large groups of copies are
    connected before most trees are planted.  Nodes of up to ``all_pairs`` items are
    compared at once; up to ``small_node`` first by best partners, then, with the
    links found, in full; larger ones with one pivot before they branch.
    """
    threshold = percent / 100
    trees = trees_for(threshold, recall)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(source, shingle_words, orders=orders))
    kind = signed.schema["id"].dataType.simpleString()
    groups = signed.where("n_shingles > 0 and id is not null").groupBy("key", "key2", "n_shingles").agg(
        F.min("id").alias("item"), F.count(F.lit(1)).alias("copies"))
    copies = materialize(groups.where("copies > 1").select("key", "key2", "n_shingles", F.col("item").alias("_item")))
    placed = signed.join(small_side(copies), ["key", "key2", "n_shingles"], "left").withColumn("item", F.coalesce("_item", "id"))
    own = (F.col("id") == F.col("item")) & (F.col("n_shingles") > 0)
    placed = materialize(placed.select("id", "n_shingles", "item", *[F.when(own, F.col(c)).alias(c) for c in ("tokens", "marks")]))
    items = placed.where("tokens is not null").select("item", F.col("n_shingles").alias("size"), "tokens", "marks")

    def rooted(rows: DataFrame, full: bool) -> DataFrame:
        rows = rows.withColumn("full", F.lit(full))
        if roots is None:
            return rows.withColumn("root", F.col("item"))
        return rows.join(small_side(roots), "item", "left").withColumn("root", F.coalesce("root", "item"))

    edges = roots = work = again = None
    planted = level = 0
    while work is not None or again is not None or planted < trees:
        level += 1
        last = level >= levels and planted == trees
        close = [x for x in (again, work if last else None) if x is not None]
        fine = None
        if close:
            wanted = materialize(reduce(DataFrame.union, [x.select(F.col("item").alias("id")) for x in close]).distinct())
            fine = materialize(fine_marks(source.join(small_side(wanted), "id", "left_semi"), shingle_words))
        take = range(planted, min(trees, planted + (trees if planted else first_trees)))
        planted += len(take)
        parts = []
        if len(take):
            starts = F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in take])
            parts.append(rooted(_children(items.withColumn("node", F.explode(starts)), threshold, orders).select("node", "item"), last))
        if work is not None:
            parts.append(rooted(_children(items.join(work, "item"), threshold, orders).select("node", "item"), last))
        if again is not None:
            parts.append(rooted(again, True))
        members = materialize(reduce(DataFrame.unionByName, parts))
        nodes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        rows = members.join(small_side(materialize(nodes.where("n > 1 and r0 <> r1").select("node", "n"))), "node")
        rows = materialize(rows.select("node", "n", "item", "root", "full"))
        few = rows.where(F.col("full") | (F.col("n") <= small_node)).drop("n").join(items.select("item", "size", "marks"), "item")
        none = {"fine": F.lit(None).cast("binary"), "set": F.lit(None).cast("binary")}
        few = few.withColumns(none) if fine is None else few.where("not full").withColumns(none).unionByName(few.where("full").join(fine, "item"))
        near = few.repartition("node").sortWithinPartitions("node").mapInArrow(compare(percent, all_pairs, orders), f"a {kind}, b {kind}, sure boolean")
        many = rows.where(~F.col("full") & (F.col("n") > small_node))
        work = many.select("node", "item")
        if work.isEmpty():
            work = None
        else:
            work = materialize(work)
            many = many.join(items.select("item", "size", "marks"), "item")
            pivots = many.groupBy("node").agg(F.min_by(F.struct("item", "root", "size", "marks"), F.xxhash64("node", "item")).alias("p"))
            star = many.join(small_side(materialize(pivots), 10_000), "node").where("root <> p.root").where(
                F.least("size", "p.size") * 100 >= percent * F.greatest("size", "p.size"))
            star = star.select("item", "p.item", "marks", "p.marks").toDF("a", "b", "ma", "mb")
            near = near.union(star.mapInArrow(_likely(orders, threshold), f"a {kind}, b {kind}").withColumn("sure", F.lit(False)))
        near = materialize(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure").where("a <> b").distinct())
        # Only items that had a likely partner can have another one.
        touched = materialize(near.select(F.col("a").alias("item")).union(near.select("b")).distinct())
        again = rows.where(~F.col("full") & (F.col("n") > all_pairs) & (F.col("n") <= small_node)).select("node", "item")
        again = again.join(small_side(touched), "item", "left_semi").select("node", "item")
        again = None if again.isEmpty() else materialize(again)
        likely = near.where("not sure").select("a", "b")
        new = near.where("sure").select("a", "b")
        if not likely.isEmpty():
            wanted = materialize(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct())
            sets = materialize(full_sets(source.join(small_side(wanted), "id", "left_semi"), shingle_words))
            new = new.union(confirm(likely, sets, percent))
        edges = materialize(new if edges is None else edges.union(new))
        roots = components(edges)
    base = placed.select("id", "n_shingles", "item")
    base = base.join(small_side(roots), "item", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("root", "item")).otherwise(F.col("id"))
    out = base.withColumn("component_id", component)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                      F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
