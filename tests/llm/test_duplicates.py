"""Near duplicates and repeated passages, beside all-pairs versions."""

import glob
import os
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm import near_duplicates as near_module, packing, passages
from foldwise.llm.near_duplicates import FINE_ORDERS, compare, near_duplicates, trees_for
from foldwise.llm.passages import ORDERS, _linked, cut_spans, paragraph_nodes, paragraph_table, remove_repeats, repeated_passages, tune_bands
from foldwise.llm.tables import BATCH_BYTES, components, small_batches
from foldwise.llm.words import Words, constants, distinct_sets, minhashes, mix, shingles, slices
from foldwise.operators.storage import materialize, scratch, shared_folder

from .helpers import documents, linked, odd_texts, prose, shingle_set, words


def edited(text, times, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(times):
        w[r.randrange(len(w))] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(w)


def corpus(n=60):
    base = prose(1, 120)
    texts = [*odd_texts(), base, base, base.upper(), *[edited(base, k % 7, k) for k in range(n)]]
    texts += [edited(prose(100 + k // 4, 80), k % 4, 300 + k) for k in range(n)]
    texts += [prose(7, 25) + " " + prose(900 + k, 25) for k in range(n)]
    return texts


def test_sets_equal_plain_sets():
    texts = odd_texts() + ["A b C a b c", "x"]
    for n in (1, 3, 5):
        for _, _, data, bounds in slices(pa.array(texts), 40):
            flat, edges = distinct_sets(*shingles(Words(data, bounds, True), n), len(bounds) - 1)
            assert len(flat) == edges[-1]
        sizes = []
        for lo, hi, data, bounds in slices(pa.array(texts)):
            flat, edges = distinct_sets(*shingles(Words(data, bounds, True), n), hi - lo)
            sizes += np.diff(edges).tolist()
        assert sizes == [len(shingle_set(t, n)) for t in texts]


@pytest.mark.parametrize("shingle_words,percent,limits", [
    (3, 85, {}), (5, 80, {"all_pairs": 3, "small_node": 8, "levels": 3}), (3, 85, {"all_pairs": 2, "small_node": 4, "levels": 2, "first_trees": 1})])
def test_components_equal_all_pairs(spark, shingle_words, percent, limits):
    texts = corpus()
    docs = documents(spark, [(k, t, "s") for k, t in enumerate(texts)]).repartition(6)
    got = {r["doc_id"]: r for r in near_duplicates(docs, shingle_words=shingle_words, percent=percent, **limits).collect()}
    sets = {k: shingle_set(t, shingle_words) for k, t in enumerate(texts)}
    want = linked(sets, percent)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[k]) and r["kept"] == (want[k] == k) for k, r in got.items())


def test_rows_without_id_and_repeated_rows(spark):
    t = prose(3, 40)
    docs = documents(spark, [(5, t, "s"), (5, t, "s"), (9, t, "s"), (None, t, "s"), (4, None, "s"), (4, "", "s")])
    got = sorted(map(tuple, near_duplicates(docs).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (None, None, True), (4, 4, True), (4, 4, True)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_trees_and_bands_grow_with_recall():
    assert trees_for(0.85, 0.999) < trees_for(0.85, 0.999999) and trees_for(0.95, 0.999) <= trees_for(0.8, 0.999)
    for recall in (0.9, 0.98, 0.999):
        assert 1 - (1 - 0.8 ** 2) ** tune_bands(0.8, recall) >= recall


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 3), (61, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in [7, 61, *range(8, 60)]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def passages_corpus():
    passage, line = prose(50, 52), "this short line stands in many texts"
    texts = []
    for k in range(40):
        own = prose(2000 + k, 150).split(" ")
        if k % 4 == 0:
            at = 20 + k
            own[at:at] = passage.split(" ") if k % 8 else passage.upper().split(" ")
        texts.append(line + "\n" + " ".join(own[:70]) + "\n" + " ".join(own[70:]))
    return [*texts, *odd_texts()]


def test_repeated_passages_are_found_and_clean_texts_stay(spark):
    texts = passages_corpus()
    docs = documents(spark, [(k, t, "s") for k, t in enumerate(texts)]).repartition(5)
    spans = repeated_passages(docs).collect()
    flagged = {r["doc_id"] for r in spans}
    assert flagged & set(range(40)) == {k for k in range(4, 40, 4)}  # the first place stays
    for r in spans:
        part = words(texts[r["doc_id"]])[r["start_word"]:r["end_word"]]
        home = " ".join(words(texts[r["kept_id"]]))
        assert " ".join(part) in home or r["kept_id"] == r["doc_id"]
    cut = {r["doc_id"]: r for r in remove_repeats(docs, length_col="n_chars").collect()}
    assert len(cut) == len(texts)
    for k, t in enumerate(texts):
        if k not in flagged:
            assert cut[k]["text"] == t
        else:
            gone = sum(r["end_word"] - r["start_word"] for r in spans if r["doc_id"] == k)
            assert len(words(cut[k]["text"])) == len(words(t)) - gone and cut[k]["n_chars"] == len(cut[k]["text"])


def test_near_paragraphs_are_confirmed_exactly(spark, monkeypatch):
    monkeypatch.setattr("foldwise.llm.passages.LARGE_BUCKET", 4)
    common = prose(77, 400)
    w = common.split(" ")
    docs = documents(spark, [(k, " ".join(w if k == 0 else [*w[:9 * k], f"new{k}", *w[9 * k + 1:]]), "s") for k in range(12)])
    got = repeated_passages(docs, percent=80).groupBy("doc_id").agg(F.sum(F.col("end_word") - F.col("start_word")).alias("n")).collect()
    assert {r["doc_id"] for r in got} == set(range(1, 12)) and min(r["n"] for r in got) > 300


def test_copies_with_salts_and_clashing_rows(spark, monkeypatch):
    t = prose(4, 90)
    docs = documents(spark, [(1, t, "s"), (1, t, "s"), (2, t, "s"), (None, t, "s"), (3, None, "s")])
    assert {r["doc_id"] for r in repeated_passages(docs).collect()} == {2}
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == 5
    assert repeated_passages(docs.limit(0)).count() == 0
    assert cut_spans("a b  c\nd e", [(1, 3), (4, 5)]) == "a d "
    assert cut_spans("a b", [(5, 9)]) == "a b"


def set_nodes(spark, sets, node=1):
    """Nodes of ``_linked`` for shingle sets of numbers."""
    seeds = constants(33, ORDERS)
    rows = []
    for k, x in enumerate(sets):
        flat = np.unique(mix(np.array(sorted(x), dtype=np.uint64) + np.uint64(1)))
        marks = (minhashes(flat, np.array([0, len(flat)]), seeds) & 255).astype(np.uint8)
        rows.append((k, len(flat), bytearray(flat.tobytes()), bytearray(marks[0].tobytes()), [node]))
    return spark.createDataFrame(rows, "item long, size long, set binary, marks binary, nodes array<bigint>").repartition(4)


def test_hot_bucket_is_linked_without_large_nodes(spark, monkeypatch):
    monkeypatch.setattr("foldwise.llm.passages.LARGE_BUCKET", 32)
    seen = []

    def counted(*how):
        seen.append(1)
        run = compare(*how)

        def guarded(batches):
            for batch in batches:
                nodes = np.unique(batch.column(batch.schema.get_field_index("node")).to_numpy(), return_counts=True)[1]
                assert nodes.max(initial=0) <= 64, "a task compares a hot bucket in full"
                yield from run(iter([batch]))

        return guarded

    monkeypatch.setattr("foldwise.llm.passages.compare", counted)
    core = set(range(20))
    hot = [core | {1000 + k} for k in range(300)]
    # A stray item that only some members are similar to, a chain away from the pivots, and one of its own.
    chain = [set(range(100 + 2 * k, 124 + 2 * k)) for k in range(100)]
    sets = [*hot, {*range(16), 5000, 5001}, *chain, set(range(90_000, 90_020))]
    got = _linked(set_nodes(spark, sets), 80).collect()
    assert seen and len(got) < 10 * len(sets)
    for a, b in ((r["a"], r["b"]) for r in got):
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    roots = {r["item"]: r["root"] for r in components(spark.createDataFrame(got)).collect()}
    want = linked(dict(enumerate(sets)), 80)
    assert {k: roots.get(k, k) for k in want} == want


def test_linked_keeps_no_tables_of_earlier_rounds(spark, monkeypatch):
    """When the last members are compared, their rows are the only table of bucket rows on disk."""
    monkeypatch.setattr("foldwise.llm.passages.LARGE_BUCKET", 32)
    left = []

    def counted(*how):
        folder = os.path.join(shared_folder(spark), "foldwise")
        tables = [pq.read_schema(glob.glob(f"{folder}/{name}/*.parquet")[0]).names for name in set(os.listdir(folder)) - before]
        left.append(tables.count(["node", "item", "root"]))
        return compare(*how)

    monkeypatch.setattr("foldwise.llm.passages.compare", counted)
    nodes = set_nodes(spark, [*[set(range(2 * k, 2 * k + 24)) for k in range(100)], *[set(range(20)) | {1000 + k} for k in range(100)]])
    with scratch(spark):
        materialize(nodes)
        before = set(os.listdir(os.path.join(shared_folder(spark), "foldwise")))
        _linked(nodes, 80).collect()
    assert left and set(left) == {1}


def test_any_shared_run_of_51_words_is_cut_whole(spark):
    """Passages of few or many different words, and periodic ones, each in two texts of other words."""
    r, texts, runs = random.Random(5), [], []
    for k in range(150):
        run = [f"p{k}x{r.randrange(8 if k % 2 else 4000)}" for _ in range(51 + k % 10)]
        if k >= 120:
            run = [f"p{k}x{j % (k - 119)}" for j in range(51)] if k < 126 else run
        runs.append(run)
        texts += [" ".join([*prose(4000 + 2 * k + j, 40).split(" "), *run, *prose(9000 + 2 * k + j, 40).split(" ")]) for j in (0, 1)]
    docs = documents(spark, [(k, t, "s") for k, t in enumerate(texts)]).repartition(5)
    cut = {x["doc_id"]: words(x["text"]) for x in remove_repeats(docs, length_col="n_chars").collect()}
    for k, run in enumerate(runs):
        own = prose(4001 + 2 * k, 40).split(" ") + prose(9001 + 2 * k, 40).split(" ")
        # A near paragraph goes whole, with one outer word at either side, or some more where few words repeat.
        few = k % 2 or k >= 120
        assert not set(run) & set(cut[2 * k + 1]) and len(own) - (8 if few else 2) <= len(cut[2 * k + 1]) <= len(own), k
        if k < 120:
            assert cut[2 * k] == words(texts[2 * k])
        else:  # a text keeps the start of what it repeats
            assert set(run) <= set(cut[2 * k])


def test_repeated_word_keeps_one_place(spark):
    docs = documents(spark, [(1, "same " * 80, "s"), (2, prose(8, 30) + " same" * 60, "s"), (3, "row 1 of 9 " * 30, "s"), (4, "few words", "s")])
    cut = {x["doc_id"]: words(x["text"]) for x in remove_repeats(docs).collect()}
    # The first place begins within 7 words of the start.
    assert set(cut[1]) == {"same"} and 19 <= len(cut[1]) <= 26 and cut[2] == words(prose(8, 30)) and cut[4] == ["few", "words"]
    assert 19 <= len(cut[3]) <= 33 and cut[3][:4] == ["row", "1", "of", "9"]


def test_similar_paragraphs_meet_at_any_shift(spark):
    """Texts of one paragraph, beside those whose first or last word differs or that begin a word later: every pair is found."""
    texts = []
    for k in range(200):
        run = [f"q{k}x{j}" for j in range(20)]
        texts += [" ".join(run[:19]), " ".join([run[1:], ["new", *run[1:19]], [*run[:18], "new"]][k % 3 if k > 120 else 0])]
    docs = documents(spark, [(k, t, "s") for k, t in enumerate(texts)]).repartition(3)
    assert {r["doc_id"] for r in repeated_passages(docs).collect()} == set(range(1, 400, 2))


def test_common_phrases_and_neighbours_of_copies_are_not_compared(spark, monkeypatch):
    compared = []

    def counted(docs, members, *how):
        compared.append(members.count())
        return paragraph_nodes(docs, members, *how)

    monkeypatch.setattr("foldwise.llm.passages.paragraph_nodes", counted)
    phrase = "at the end of the day as it were".split(" ")
    texts = [" ".join(w for j in range(12) for w in (*phrase, *[f"t{k}x{j}y{i}" for i in range(12)])) for k in range(60)]
    copies = [prose(300 + k // 2, 120, 100_000) for k in range(20)]
    docs = documents(spark, [(k, t, "s") for k, t in enumerate([*texts, *copies])]).repartition(3)
    assert {r["doc_id"] for r in repeated_passages(docs).collect()} == set(range(61, 80, 2))
    assert compared[0] < 50  # some own neighbours in one text


def test_similar_paragraphs_are_linked_by_runs_and_sets_that_repeat_words_by_equal_parts():
    """Every similar pair shares a bucket; pairs in a run's bucket are similar, so none has to be compared."""
    draw, lines = np.random.default_rng(5), []
    for k in range(300):
        own = [f"a{k}b{j}" for j in range(int(draw.choice([2, 3, 6, 20])))]
        one = (own * 19)[:19] if k % 2 else sorted((own * 19)[:19])
        for _ in range(4):
            other = list(one)
            for at in draw.choice(19, draw.integers(0, 3)):
                other[at] = own[int(draw.integers(len(own)))]
            lines.append(" ".join(other[(s := int(draw.integers(0, 2))):] + [f"new{k}"] * s))
    table = pa.record_batch([pa.array(range(len(lines))), pa.array(lines)], ["id", "text"])

    class Rows:  # what paragraph_table asks of a table
        schema = {"id": T.StructField("id", T.LongType())}

        def mapInArrow(self, run, _):
            return next(run([table]))

    rows = paragraph_table(Rows(), 6, 5, 80, 3, 2).to_pylist()
    sets = [{tuple(w[j:j + 5]) for j in range(15)} for w in map(str.split, lines)]
    sure, close = lambda x: {b for b in x["bands"] if b & 15 == 0}, 0
    for k in range(0, len(lines), 4):
        for i, j in combinations(range(k, k + 4), 2):
            alike = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if alike:
                close += 1
                assert set(rows[i]["bands"]) & set(rows[j]["bands"])
            else:
                assert not sure(rows[i]) & sure(rows[j])
    assert close > 300


LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_go_to_python_in_small_batches(spark):
    docs = spark.createDataFrame([(k, chr(97 + k % 26) * 200_000) for k in range(60)], "id long, text string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    own = spark.conf.get(LIMIT)
    seen = [r["n"] for r in small_batches(lambda d: d.mapInArrow(sizes, "n long").collect())(docs)]
    assert sum(seen) >= 60 * 200_000 and max(seen) <= BATCH_BYTES + 250_000
    assert spark.conf.get(LIMIT) == own
    with pytest.raises(ZeroDivisionError):
        small_batches(lambda d: 1 // 0)(docs)
    assert spark.conf.get(LIMIT) == own


def test_operators_of_the_pipeline_write_under_the_small_limit(spark, monkeypatch):
    import corpus_pipeline
    import public_tokenizers

    limits = []

    def watched(df):
        limits.append(spark.conf.get(LIMIT))
        return materialize(df)

    for module in (near_module, passages, packing):
        monkeypatch.setattr(module, "materialize", watched)
    docs = documents(spark, [(k, prose(k % 7, 90), "s") for k in range(30)])
    own = spark.conf.get(LIMIT)
    near_duplicates(docs)
    repeated_passages(docs)
    packing.pack(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    assert limits and set(limits) == {str(BATCH_BYTES)}
    monkeypatch.setattr(corpus_pipeline, "materialize", watched)
    limits.clear()
    cut = corpus_pipeline.substring_stage(spark, docs, "")
    # The texts themselves are cut under the limit: the stage gives a written table.
    assert limits[-1] == str(BATCH_BYTES) and hasattr(cut, "_folder") and cut.count() == 30
    assert spark.conf.get(LIMIT) == own


def test_nodes_are_compared_alike_in_batches_of_any_size():
    rng = np.random.default_rng(4)
    rows = []
    for node, n in enumerate((1, 5, 2, 9, 1, 3)):
        base = rng.integers(1, 1 << 60, 40, dtype=np.uint64)
        for k in range(n):
            own = base.copy()
            own[:k % 4] = rng.integers(1, 1 << 60, k % 4, dtype=np.uint64)
            own.sort()
            edges = np.array([0, 40])
            marks = (minhashes(own, edges, constants(21, 128)) & 255).astype(np.uint8).tobytes()
            fine = (minhashes(own, edges, constants(23, FINE_ORDERS)) & 255).astype(np.uint8).tobytes()
            rows.append({"node": node, "item": len(rows), "root": len(rows), "full": node % 2 == 1, "size": 40, "marks": marks, "fine": fine, "set": own.tobytes()})
    table = pa.Table.from_pylist(rows)

    def pairs(n):
        empty = table.schema.empty_table().to_batches() or [pa.RecordBatch.from_pylist([], schema=table.schema)]
        found = [b.to_pylist() for b in compare(80, 4, 128)([*empty, *table.to_batches(max_chunksize=n), *empty])]
        return sorted((r["a"], r["b"], r["sure"]) for x in found for r in x)

    assert pairs(100) and pairs(1) == pairs(2) == pairs(3) == pairs(7) == pairs(100)
