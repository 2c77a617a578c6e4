"""Quality rules and mixing, beside row-by-row versions and DuckDB."""

import collections

import pytest
from pyspark.sql import functions as F

from foldwise.llm.mixing import mix, mix_plan
from foldwise.llm.quality_rules import RULES, STOP_WORDS, keep_good, quality_rules

from .helpers import documents, odd_texts, prose, words


def plain_rules(text):
    w, lines = words(text, lower=False), [x for x in (text or "").split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
    stop = {x for v in STOP_WORDS.values() for x in v}
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
         "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_stop_words": sum(x in stop for x in w), "n_lines": len(lines)}
    m["base_failed"] = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
    m["kept"] = not m["base_failed"] and all(
        not m[r.bottom] or (r.low is None or m[r.top] / m[r.bottom] >= r.low) and (r.high is None or m[r.top] / m[r.bottom] <= r.high) for r in RULES)
    return m


def test_rules_equal_plain_version(spark):
    texts = [*odd_texts(), "the cat of the day\n" * 12, "the # of * and $ % & | < > to in that it is was", prose(1, 40) + " the of and",
             "the of and " + " ".join(f"{k}x" for k in range(30)), "a b c d e a b c d e a b c d e " + prose(2, 80)]
    docs = documents(spark, [(k, t, "s") for k, t in enumerate(texts)] + [(0, None, "s")])
    got = quality_rules(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = plain_rules(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]


def test_keep_good_keeps_columns_and_rows(spark):
    good = "the cat sat on the mat and it was a day of the sun in the sky"
    docs = documents(spark, [(1, good, "a"), (2, "x", "a"), (1, good, "a"), (3, None, None)])
    out = keep_good(docs)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [1, 1]
    assert keep_good(docs.limit(0)).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        total = sum(w[s] for s in rest)
        now = {s: left * w[s] / total for s in rest} if rest else {}
        over = [s for s in rest if now[s] > most * sizes[s]]
        if not over:
            return {**target, **now}
        for s in over:
            full.add(s)
            target[s] = most * sizes[s]
            left -= target[s]


def test_mixing_targets_and_copies(spark):
    rows = [(k, prose(k, 5 + k % 40), [None, "a", "b", "Z", "é", "big"][k % 6 if k % 3 else 5]) for k in range(900)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (5001, "", "empty")]
    docs = documents(spark, rows)
    plan = mix_plan(docs).collect()
    again = {tuple(r) for r in mix_plan(docs.repartition(7)).collect()}
    assert {tuple(r) for r in plan} == again
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, source = plain_targets(sizes), {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in plan:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.15, abs=1)
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    expected = collections.Counter()
    for r in plan:
        expected[r["doc_id"]] += r["copies"]
    assert copies == {k: v for k, v in expected.items() if v}
    assert mix_plan(docs.limit(0)).count() == 0
