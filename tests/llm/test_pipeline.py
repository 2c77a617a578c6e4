"""The corpus pipeline stage by stage, beside plain versions of its decisions."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foldwise.operators.storage import materialize

from .helpers import linked, prose, shingle_set, words
from .test_rules_and_mixing import plain_rules

SF = "/root/testdata/sf0.001"
STOP = "the of and to in that it is was for "


def rows():
    passage = prose(50, 52)
    out = [(k, STOP + prose(k, 60 + k) + ".", ["a", "b", None][k % 3]) for k in range(40)]
    out += [(100 + k, STOP + prose(3, 63).replace("w1", f"w1{k}", 1 if k else 0), "a") for k in range(4)]
    out += [(200 + k, STOP + prose(500 + k, 40) + " " + passage + " " + prose(700 + k, 40), "b") for k in range(5)]
    return [*out, (300, None, "a"), (301, "", "b"), (302, "x " * 400, "a"), (303, "# $ % & | " * 20, None)]


def stage_results(spark):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows()],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""))
        found.append(docs)
    return found


def test_every_stage(spark):
    docs, good, single, cut, mixed, packed = stage_results(spark)
    text = {i: t for i, t, _ in rows()}
    for frame in (good, single, cut, mixed):
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {i for i, t in text.items() if plain_rules(t)["kept"]}
    roots = linked({i: shingle_set(text[i], 5) for i in kept}, 80)
    left = {r["doc_id"] for r in single.collect()}
    assert left == {i for i in kept if roots[i] == i}
    after = {r["doc_id"]: r for r in cut.collect()}
    assert set(after) == left and all(r["n_chars"] == len(r["text"]) for r in after.values())
    shared = [i for i in left if 200 <= i < 300]
    for i in left:
        gone = len(words(text[i])) - len(words(after[i]["text"]))
        assert gone >= 19 if i in shared and i != min(shared) else gone == 0
    copies = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(copies) <= left and max(copies.values()) <= 2
    total = sum(len(words(r["text"])) for r in after.values())
    taken = sum(len(words(after[i]["text"])) * n for i, n in copies.items())
    assert taken == pytest.approx(1.5 * total, rel=0.2)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces: dict = {}
    for r in packed.collect():
        ids = np.array(own.encode(after[r["doc_id"]]["text"], add_special_tokens=False).ids + [0], dtype="<u4")
        assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= 1024
    for i, n in copies.items():
        assert pieces[i] == n * (len(own.encode(after[i]["text"], add_special_tokens=False).ids) + 1)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""))
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_near_duplicates", "op8_warc", "op10_mixing"])
def test_queries_with_sql(spark, name):
    import __spark_entry__ as entry
    from compare import connect, differences

    n, why = differences(spark, connect(SF), name, entry.queries()[name], SF, entry.oracle_sql()[name])
    assert n > 0 and not why, why
