"""The language model, the classifier and the neighbour search."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import quality_classifier as Q
from foldwise.llm.language_model import END, Bilinear, Vocabulary, score_texts
from foldwise.llm.neighbours import Tables, fit_probes, fit_tables, nearest_periods, probe_order, probed_cells
from foldwise.llm.quality_classifier import CHUNK_WINDOWS, STEP, Network, score_quality

from .helpers import documents, odd_texts, prose, words


def toy_vocabulary():
    w = np.array([END, *range(10, 40)], dtype=np.uint64)
    return Vocabulary(w, np.arange(100, 69, -1), 12, 5000, 400)


def test_probabilities_add_up_to_one():
    v = toy_vocabulary()
    net = Bilinear(v, 6)
    rng = np.random.default_rng(0)
    net.p = {k: rng.normal(size=x.shape).astype(np.float32) for k, x in net.p.items()}
    for one, two in ((1, 2), (0, 5), (11, 11)):
        n = v.classes
        logs = net.log_probabilities(np.full(n, one), np.full(n, two), np.arange(n), block=5)
        assert np.exp(logs).sum() == pytest.approx(1, rel=1e-5)


def test_noise_contrastive_steps_learn_a_rule():
    v = toy_vocabulary()
    net, rng = Bilinear(v, 8), np.random.default_rng(1)
    one = rng.integers(1, 12, 40_000)
    net.learn(one, np.ones_like(one), one % 11 + 1, v.noise, rng, 0.3)
    logs = net.log_probabilities(one[:500], np.ones(500, int), one[:500] % 11 + 1)
    assert logs.mean() > np.log(v.noise[one % 11 + 1]).mean() + 0.5


def test_scores_equal_counts_and_model_beats_them(spark):
    r = np.random.default_rng(3)
    texts = odd_texts()
    for k in range(400):  # two "languages" with words of their own
        side = "a" if k % 2 else "b"
        texts.append(" ".join(f"{side}{int(x)}" for x in r.geometric(0.08, 120)))
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(3, "one", "s"), (None, "one", "s")]
    docs = documents(spark, rows).repartition(3)
    learned = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    got = score_texts(docs, learn_from=F.crc32(F.col("id").cast("string").cast("binary")) % 7 != 2, classes=64, head_words=90).collect()
    assert len(got) == len(rows)
    count: dict = {}
    for k, t, _ in rows:
        if k is not None and learned(k):
            for w in [*words(t), None]:
                count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    base, known = {}, {}
    for k, t, _ in rows:
        w = [*words(t), None]
        base[k] = sum(math.log10((count.get(x, 0) + 1) / (total + len(count) + 1)) for x in w)
        known[k] = (len(w), sum(x in count for x in w))
    for r in got:
        assert r["base_score"] == pytest.approx(base[r["doc_id"]], rel=1e-9) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == known[r["doc_id"]] and r["score"] < 0
    prose_rows = [r for r in got if (r["doc_id"] or 0) >= len(odd_texts())]
    assert sum(r["score"] for r in prose_rows) > sum(r["base_score"] for r in prose_rows)
    assert score_texts(docs.limit(0)).count() == 0


def test_pooling_covers_the_whole_text_and_gradient_is_right():
    net, rng = Network(2), np.random.default_rng(4)
    net.p["weights"] = rng.normal(size=net.p["weights"].shape).astype(np.float32)
    for n in (0, 1, 8, 9, 1023, 1024, 1031, 5000, CHUNK_WINDOWS * STEP * 64 + 700):
        data = rng.integers(32, 120, n).astype(np.uint8)
        pooled, _ = Q._pool(net.answers(data)[1])
        z = Q._features(pooled) @ net.p["weights"] + net.p["bias"][0]
        assert net.score(data) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
    data = rng.integers(32, 120, 1500).astype(np.uint8)
    loss = lambda: -np.log(1 - net.score(data))
    g = net.gradient(data, 0.0)
    for name, at in (("weights", 3), ("filters", (5, 7)), ("offsets", 2), ("vectors", (int(data[0]), 1)), ("bias", 0)):
        old, found = net.p[name][at], []
        for step in (1e-2, -1e-2):
            net.p[name][at] = old + step
            found.append(loss())
        net.p[name][at] = old
        assert (found[0] - found[1]) / 2e-2 == pytest.approx(float(g[name][at]), abs=2e-2)
    assert Network.load(net.dump()).score(data) == net.score(data)


def test_classifier_separates_held_out_texts(spark):
    good = [prose(k, 40 + k % 60) for k in range(160)]
    bad = [prose(k, 40 + k % 60).upper() + " $$$" for k in range(40)]
    rows = [(k, t, "s") for k, t in enumerate([*odd_texts(), *good, *bad])] + [(3, "one", "s"), (None, None, "s")]
    first, cut = len(odd_texts()), len(odd_texts()) + len(good)
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(k < cut)) for k in range(first, cut + len(bad))] + [(0, None)], "doc_id long, quality int")
    learn = F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2
    got = score_quality(docs, labels, learn_from=learn, epochs=8).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= first and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = [(r["score"] >= 0.5) == (r["doc_id"] < cut) for r in held]
    assert np.mean(right) >= 0.9
    assert {r["score"] for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_probes_come_in_order_of_cost():
    inside = np.array([0.1, 0.45, 0.8])
    cost = lambda p: sum((inside[k] if s < 0 else 1 - inside[k]) ** 2 for k, s in p)
    order = probe_order(inside, 27)
    assert len(order) == len(set(order)) == 27 and order[0] == () and [cost(p) for p in order] == sorted(cost(p) for p in order)
    tables = Tables(5, 3, 4, 1.0)
    places = tables.places(np.random.default_rng(0).normal(size=(2, 5)))
    assert (probed_cells(tables, places[0], 6)[:, 0] == tables.cells(places)[0]).all()


def periods(spark, vectors, schema="pos long, controls array<float>"):
    return spark.createDataFrame(vectors, schema).withColumns({"score": F.lit("x"), "query_id": F.lit(0), "rank": F.lit(0)})


def test_neighbours_beside_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12))
    x = (centres[rng.integers(0, 30, 900)] + 0.3 * rng.normal(size=(900, 12))).astype(np.float32)
    x[300:600] = x[300]  # a third are equal
    rows = [(k, [float(v) for v in x[k]]) for k in range(900)]
    odd = [(1000, None), (1050, [0.0] * 12), (1100, [float("nan")] * 12), (1150, [float("inf")] + [1.0] * 11), (1200, []), (None, [1.0] * 12),
           (1250, [None] + [1.0] * 11)]
    frame = periods(spark, rows + odd).repartition(4)
    got = nearest_periods(frame, F.col("id") % 50 == 0).collect()
    y = x.astype(float)
    n = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    hits, by = 0, {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["pos"] if "pos" in r else r["id"], r["score"]))
    assert set(by) == set(range(0, 900, 50))
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        s = n @ n[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        hits += len(set(best.tolist()) & {f[1] for f in found})
        assert all(f[2] == pytest.approx(s[f[1]], abs=1e-12) for f in found)
        if 300 <= q < 600:
            assert [f[1] for f in found] == [k for k in range(300, 306) if k != q][:5]
    assert hits >= 0.9 * 5 * len(by)
    few = nearest_periods(periods(spark, rows[:3]), F.col("id") % 50 == 0).collect()
    assert len(few) == 2
    assert nearest_periods(periods(spark, rows[:1]).limit(0), F.col("id") % 50 == 0).count() == 0
    with pytest.raises(ValueError, match="of one length"):
        nearest_periods(periods(spark, [*rows[:3], (1200, [1.0])]), F.col("id") % 50 == 0)


def test_tables_grow_until_recall_is_met():
    x = np.random.default_rng(4).normal(size=(1500, 256))
    with pytest.raises(ValueError, match="of the wanted 0.98"):
        fit_probes(x, Tables(256, 2, 8, 2.5), 0.98, 5)
    made, probes = fit_tables(x, 256, 2, 8, 2.5, 0.98, 5)
    assert made.tables > 2 and fit_probes(x, made, 0.98, 5) == probes
    with pytest.raises(ValueError, match="of the wanted"):
        fit_tables(x, 256, 1, 8, 0.1, 0.98, 5, rounds=0)
