"""Nearest periods by the cosine of their control vectors: multiprobe p-stable hashing.

Works on the rows of a sample: ``pos`` and an array of controls (``F.array`` of the
feature columns), for the question which periods were most alike.  Any id and
vector column will do.

A table hashes a vector of length one by ``hashes`` projections on Gaussian
directions, each cut into cells of width ``width``.  A query looks into its own cell
and into perturbed ones, in the order of their estimated success: the sum of
squared distances to the cell borders that a perturbation crosses.  The candidates
of all tables are ranked by their exact cosine in double precision.

The number of probes is fitted on a bounded sample (``sample`` vectors) for the
wanted recall; all vectors are indexed.  Equal vectors are one index entry that keeps
the few smallest ids, which are all a nearest list can show.  Candidates never become
rows: a task reads a cell's queries, then its vectors in blocks, multiplies the two
and keeps each query's best. A query whose cells hold too few candidates for a full list
is compared with all vectors instead, some thousand such queries at a time.

Defined results: vectors that are NULL, zero or hold NULL or non-finite numbers take no
part, as do NULL ids; other vectors of several lengths are an error, as is a recall that
is not met with eight times the tables; ties go to the smaller id; a query has as many rows as there are candidates, at most ``k``; an empty table gives
an empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.tables import small_side
from foldwise.operators.storage import materialize

BLOCK = 4096
#: Queries that are compared with all vectors at once, where cells held too few candidates.
SCAN_QUERIES = 4096


class Tables:
    """Projections of all tables; the same everywhere for one seed."""

    def __init__(self, dimensions: int, tables: int, hashes: int, width: float, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes = tables, hashes
        self.directions = rng.normal(size=(dimensions, tables * hashes)) / width
        self.shift = rng.uniform(0, 1, tables * hashes)
        self.mixer = rng.integers(1, 1 << 62, (tables, hashes)) * 2 + 1

    def places(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return (unit @ self.directions + self.shift).reshape(len(vectors), self.tables, self.hashes)

    def cells(self, places: np.ndarray) -> np.ndarray:
        """One number per vector and table for the cell."""
        return (np.floor(places).astype(np.int64) * self.mixer).sum(axis=2)


def probe_order(inside: np.ndarray, probes: int) -> list[tuple]:
    """The first ``probes`` perturbations ``((hash, step), ...)`` for a place ``inside`` its cell.

    Sets of border crossings in order of their summed squared distances; a set never
    crosses both borders of one hash.
    """
    moves = sorted([(x * x, k, -1) for k, x in enumerate(inside)] + [((1 - x) ** 2, k, 1) for k, x in enumerate(inside)])
    out: list[tuple] = [()]
    queue = [(moves[0][0], (0,))]
    while queue and len(out) < probes:
        cost, chosen = heapq.heappop(queue)
        if len({moves[m][1] for m in chosen}) == len(chosen):
            out.append(tuple(moves[m][1:] for m in chosen))
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(queue, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(queue, (cost + moves[last + 1][0], (*chosen, last + 1)))
    return out


def probed_cells(tables: Tables, places: np.ndarray, probes: int) -> np.ndarray:
    """Cells to look into, per table and probe, for one vector's ``places``."""
    base, out = tables.cells(places[None])[0], np.empty((tables.tables, probes), dtype=np.int64)
    for t in range(tables.tables):
        inside = places[t] - np.floor(places[t])
        steps = [sum(step * int(tables.mixer[t, k]) for k, step in p) for p in probe_order(inside, probes)]
        steps += [0] * (probes - len(steps))
        out[t] = base[t] + np.array([((s + (1 << 63)) % (1 << 64)) - (1 << 63) for s in steps], dtype=np.int64)
    return out


def fit_probes(vectors: np.ndarray, tables: Tables, recall: float, k: int, choices=(1, 2, 4, 8, 16, 32, 64), queries: int = 100) -> int:
    """The least of ``choices`` whose recall on the sample is enough; an error if none is."""
    if len(vectors) <= k + 1:
        return choices[0]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    places = tables.places(vectors)
    cells, probed = tables.cells(places), [probed_cells(tables, p, choices[-1]) for p in places[:queries]]
    near = unit[:queries] @ unit.T
    near[np.arange(len(near)), np.arange(len(near))] = -2
    best = np.argsort(-near, axis=1)[:, :k]
    for n in choices:
        hit = [np.mean([any(cells[b, t] in p[t, :n] for t in range(tables.tables)) for b in row]) for row, p in zip(best, probed)]
        if np.mean(hit) >= recall:
            return n
    raise ValueError(f"recall {np.mean(hit):.3f} of the wanted {recall} with {choices[-1]} probes of {tables.tables} tables")


def fit_tables(vectors: np.ndarray, dimensions: int, tables: int, hashes: int, width: float, recall: float, k: int, rounds: int = 3) -> tuple[Tables, int]:
    """Tables and probes that reach the wanted recall on the sample; tables double up to ``rounds`` times."""
    for left in range(rounds, -1, -1):
        made = Tables(dimensions, tables, hashes, width)
        try:
            return made, fit_probes(vectors, made, recall, k)
        except ValueError:
            if not left:
                raise
            tables *= 2


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _indexer(tables: Tables, probes: int):
    """``cell, side, id, vector`` rows: side 0 for every probe of a query, 1 for every entry and table."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                vectors, asks = _vectors(part.column("vector")), part.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                places = tables.places(vectors)
                rows, cells, sides, number = [], [], [], np.arange(tables.tables)
                for i in range(len(vectors)):
                    if asks[i]:
                        probed = probed_cells(tables, places[i], probes)
                        cells.append(probed.ravel())
                        rows.append(np.full(probed.size, i))
                        sides.append(np.stack([np.repeat(number, probes), np.zeros(probed.size, np.int64)]))
                own = tables.cells(places)
                cells.append(own.ravel())
                rows.append(np.repeat(np.arange(len(vectors)), tables.tables))
                sides.append(np.stack([np.tile(number, len(vectors)), np.ones(own.size, np.int64)]))
                rows, sides = np.concatenate(rows), np.concatenate(sides, axis=1)
                packed = [v.tobytes() for v in vectors]
                for a in range(0, len(rows), 8192):
                    s = slice(a, a + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sides[0][s].astype(np.int32)), pa.array(np.concatenate(cells)[s]), pa.array(sides[1][s].astype(np.int32)),
                         part.column("id").take(pa.array(rows[s])), pa.array([packed[r] for r in rows[s]], type=pa.binary())],
                        ["table", "cell", "side", "id", "vector"])

    return run


def _offer(best: dict, names: list, q: np.ndarray, ids: np.ndarray, block: np.ndarray, keep: int) -> None:
    """Add to ``best`` what each query finds among the vectors of a block: exact cosines of its top ``keep``."""
    length = np.sqrt((block * block).sum(axis=1))
    near = (q @ block.T) / length
    for i, name in enumerate(names):
        scores = near[i]
        limit = np.partition(scores, -keep)[-keep] if len(scores) > keep else -np.inf
        some = np.flatnonzero(scores >= limit - 1e-9 * abs(limit) if np.isfinite(limit) else scores >= limit)
        exact = (block[some] * q[i]).sum(axis=1) / (np.sqrt((q[i] * q[i]).sum()) * length[some])
        found = best.setdefault(name, {})
        found.update(zip(ids[some].tolist(), exact.tolist()))
        if len(found) > 4 * keep:
            best[name] = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:keep])


def _rows(best: dict) -> pa.RecordBatch:
    out = [(q, c, s) for q, found in best.items() for c, s in found.items()]
    best.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))],
                                      ["query", "candidate", "score"])


def _scan(names: list, q: np.ndarray, keep: int):
    """The best candidates of a bounded set of queries among all vectors of a partition."""
    def run(batches):
        best: dict[int, dict] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                _offer(best, names, q, part.column(0).to_numpy(), _vectors(part.column(1)), keep)
        if best:
            yield _rows(best)

    return run


def _completed(found: DataFrame, index: DataFrame, keep: int) -> DataFrame:
    """``found`` with the full lists of queries whose cells held fewer than ``keep`` candidates.

    Such queries are compared with all vectors, ``SCAN_QUERIES`` at a time.
    """
    need = min(keep, index.count())
    enough = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
    short = materialize(index.where("asks").join(enough, F.col("id") == F.col("query"), "left_anti").select("id", "vector"))
    rounds = -(-short.count() // SCAN_QUERIES)
    for k in range(rounds):
        rows = short.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k).collect()
        if rows:
            more = index.select("id", "vector").mapInArrow(_scan([r["id"] for r in rows], np.array([r["vector"] for r in rows]), keep),
                                                           "query long, candidate long, score double")
            found = found.unionByName(more)
    return found.dropDuplicates(["query", "candidate"]) if rounds else found


def _ranker(keep: int):
    """Best candidates of each query over the cells of a partition, sorted by table, cell and side."""
    def run(batches):
        best: dict[int, dict] = {}
        cell, asked, names = None, [], []
        for batch in batches:
            table, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            side, ids = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (table[1:] != table[:-1]) | (place[1:] != place[:-1]) | (side[1:] != side[:-1])]))
            for a, b in zip(cuts, [*cuts[1:], len(ids)]):
                if (table[a], place[a]) != cell:
                    cell, asked, names = (table[a], place[a]), [], []
                if side[a] == 0:
                    asked += [np.frombuffer(v.as_buffer(), dtype=np.float64) for v in batch.column(4).slice(a, b - a)]
                    names += ids[a:b].tolist()
                    continue
                for lo in range(a, b, BLOCK) if asked else ():
                    hi = min(b, lo + BLOCK)
                    block = np.stack([np.frombuffer(v.as_buffer(), dtype=np.float64) for v in batch.column(4).slice(lo, hi - lo)])
                    for at in range(0, len(asked), BLOCK):
                        _offer(best, names[at:at + BLOCK], np.stack(asked[at:at + BLOCK]), ids[lo:hi], block, keep)
                    if len(best) > 50_000:
                        yield _rows(best)
        if best:
            yield _rows(best)

    return run


def nearest_periods(sample: DataFrame, queries: Column, id_col: str = "pos", vector_col: str = "controls", k: int = 5, tables: int = 8,
                    hashes: int = 8, width: float = 2.5, recall: float = 0.98, sample_size: int = 5000) -> DataFrame:
    """``query_id, rank, id, score``: for the rows where ``queries`` (a condition on ``id``) holds, their ``k`` nearest others."""
    raw = sample.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = raw.where(F.col("id").isNotNull() & sound & F.exists("vector", lambda x: x != 0))
    shortest, longest = valid.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} to {longest} components; all must be of one length")
    longest = longest or 1
    marked = materialize(valid.select("id", F.xxhash64("vector").alias("key"), F.xxhash64(F.lit(1), "vector").alias("key2"), queries.alias("asks")))
    place = F.row_number().over(Window.partitionBy("key", "key2").orderBy("id"))
    entries = materialize(marked.select("key", "key2", "id").withColumn("_n", place).where(F.col("_n") <= k + 1)
                          .groupBy("key", "key2").agg(F.min("id").alias("entry"), F.collect_list("id").alias("ids")))
    asking = materialize(marked.where("asks").select("id", "key", "key2").join(entries.select("key", "key2", "entry"), ["key", "key2"])
                         .select(F.col("id").alias("query_id"), "entry"))
    asked = asking.select(F.col("entry").alias("id")).distinct().withColumn("asks", F.lit(True))
    index = valid.join(entries.select(F.col("entry").alias("id")), "id").join(asked, "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    index = materialize(index.dropDuplicates(["id"]))
    fitted = index.orderBy(F.xxhash64("id")).limit(sample_size).select("vector").collect()
    hasher, probes = fit_tables(np.array([r[0] for r in fitted], dtype=float).reshape(len(fitted), longest), longest, tables, hashes, width, recall, k)
    placed = index.select("id", "vector", "asks").mapInArrow(_indexer(hasher, probes), "table int, cell long, side int, id long, vector binary")
    met = placed.repartition("table", "cell").sortWithinPartitions("table", "cell", "side")
    found = met.mapInArrow(_ranker(k + 1), "query long, candidate long, score double").dropDuplicates(["query", "candidate"])
    found = _completed(materialize(found), index, k + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    best = materialize(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1))
    named = best.join(small_side(entries.select(F.col("entry").alias("candidate"), "ids")), "candidate")
    lists = materialize(named.groupBy(F.col("query").alias("entry")).agg(F.collect_list(F.struct("score", "ids")).alias("near")))
    rows = asking.join(small_side(lists), "entry").select("query_id", F.explode("near").alias("n")).select(
        "query_id", F.col("n.score").alias("score"), F.explode("n.ids").alias("id")).where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
