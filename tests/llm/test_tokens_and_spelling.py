"""Token files, alignment of two tokenizers and spelling variants beside plain versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldwise.llm.alignment import align, align_ids, align_window, alignment_table, byte_level, piece_level
from foldwise.llm.spelling import Decomposed, _spans, counted_words, spelling_variants
from foldwise.llm.token_files import new_token_folder, read_documents, read_stream, read_token_files, token_digests, write_token_files

from .helpers import documents, odd_texts, prose

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _some(spark, n=120):
    texts = [*odd_texts(), "a <|endoftext|> b <s> </s>", "the ▁ mark", " two  spaces ", *[prose(k, 3 * k) for k in range(n)]]
    rows = [(3 * k, t, "s") for k, t in enumerate(texts)] + [(9, "one", "s"), (9, "other", "s"), (None, "no id", "s")]
    return rows, documents(spark, rows[::-1]).repartition(5)


def test_token_files_hold_all_ids_in_order(spark):
    rows, docs = _some(spark)
    folder = new_token_folder(spark)
    write_token_files(docs, folder, VOCABULARY, RANKS, index_rows=1000)
    own = Tokenizer.from_file(VOCABULARY)
    want, at = [], 0
    for k, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_digests(read_token_files(spark, folder)).orderBy("start").collect()]
    assert got == want
    stream = np.concatenate([np.array(r["ids"]) for r in read_token_files(spark, folder).orderBy("start").collect()])
    for lo, hi in ((0, 5), (at // 3, at // 3 + 4000), (at - 3, at + 50), (at, at + 1)):
        part = read_stream(spark, folder, lo, hi).orderBy("start").collect()
        assert [x for r in part for x in r["ids"]] == stream[lo:hi].tolist()
        assert not part or part[0]["start"] == lo
    assert sorted(r["start"] for r in read_documents(spark, folder, [9, 12]).collect()) == [w[1] for w in want if w[0] in (9, 12)]


def test_token_files_of_an_empty_table(spark):
    _, docs = _some(spark, 1)
    folder = new_token_folder(spark)
    write_token_files(docs.limit(0), folder, VOCABULARY)
    assert token_digests(read_token_files(spark, folder)).count() == 0 and read_stream(spark, folder, 0, 9).count() == 0


def _rows_read(df):
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return max(found)


def test_token_files_are_cut_and_pruned(spark):
    docs = spark.range(0, 40_000, 2, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.xxhash64("id").cast("string")).alias("text"))
    folder = new_token_folder(spark)
    write_token_files(docs.coalesce(1), folder, VOCABULARY, RANKS, stripe_bytes=1 << 17, index_rows=1000)
    files = [f for f in spark.read.orc(f"{folder}/ids").inputFiles()]
    stripes = [pyarrow.orc.ORCFile(f.removeprefix("file://")).nstripes for f in files]
    assert sum(stripes) > len(files)
    with_size = spark.read.option("maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert with_size.orc(f"{folder}/ids").rdd.getNumPartitions() > len(files)
        assert token_digests(read_token_files(spark, folder)).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = spark.read.orc(f"{folder}/ids")
    assert _rows_read(rows.where("id = 30000").select("id")) <= 2000  # row groups by their ranges
    assert _rows_read(rows.where("id = 30001").select("id")) == 0  # no such id by the Bloom filter
    start = rows.where("id = 30000").select("before").first()[0]
    part = rows.where("id = 30000").first()["part"]
    assert _rows_read(rows.where((F.col("part") == part) & (F.col("after") > start) & (F.col("before") < start + 3)).select("id")) <= 2000


def _plain_alignment(texts):
    own, pieces = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own.encode_special_tokens = True
    bytes_a, bytes_b = byte_level(VOCABULARY, None)[1].pieces, piece_level(MODEL)[1].pieces
    docs = []
    for t in texts:
        t = t or ""
        a, b = own.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)
        whole = (" " + t).encode()
        if not t or b"".join(bytes_a[x] for x in a) != whole or b"".join(bytes_b[x] for x in b) != whole:
            docs.append(None)
            continue
        ends = [list(itertools.accumulate(len(v[x]) for x in ids)) for v, ids in ((bytes_a, a), (bytes_b, b))]
        links, j0 = [], 0
        for i, e in enumerate(ends[0]):
            s = ends[0][i - 1] if i else 0
            while ends[1][j0] <= s:
                j0 += 1
            j = j0
            while j < len(b) and (ends[1][j - 1] if j else 0) < e:
                links.append((a[i], b[j]))
                j += 1
        groups, i0, j0 = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i1, j1 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[i0:i1])) + "|" + ",".join(map(str, b[j0:j1])))
            i0, j0 = i1, j1
        docs.append((len(a), len(b), groups, links))
    count: dict = {}
    for d in docs:
        for pair in set(d[3]) if d else ():
            count[pair] = count.get(pair, 0) + 1
    best: dict = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest())
            for d in docs]


@pytest.mark.parametrize("broadcast_pairs", [500_000, 40])
def test_alignment_equals_a_plain_one(spark, broadcast_pairs):
    mixed = ["naïve café — “quotes” 漢字かな Ελληνικά", "x" * 300, "tab\tand\nlines\r\n", "C++ != c#; 12,345.67", "\U0001F600\U0001F468‍\U0001F469 joined", "the ▁ mark", "  lead", "trail  ", "<s> <|endoftext|>"]
    texts = [*odd_texts()[:9], *mixed, *[prose(k, 2 * k) + " ünder-scores_" + str(k) for k in range(40)], *mixed]
    docs = documents(spark, [(k, t, "s") for k, t in enumerate(texts)]).repartition(3)
    for ranks in (RANKS, None):
        got = {r["id"]: tuple(r)[1:] for r in alignment_table(docs, VOCABULARY, MODEL, ranks, broadcast_pairs=broadcast_pairs).collect()}
        assert [got[k] for k in range(len(texts))] == _plain_alignment(texts)


def test_alignment_of_long_texts_repeated_rows_and_nothing(spark):
    texts = ["", prose(6, 30_000), "y" * 20_000]
    docs = documents(spark, [(1, t, "s") for t in texts] + [(None, "no id", "s")])
    got = alignment_table(docs, VOCABULARY, MODEL, RANKS).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(_plain_alignment([*texts, "no id"]))
    assert alignment_table(docs.limit(0), VOCABULARY, MODEL, RANKS).count() == 0
    assert align(docs, VOCABULARY, MODEL).select("row").distinct().count() == 4


def test_window_alignment_by_hand():
    sizes = [0, 1, 2, 3, 4]
    assert align_window([2, 1, 3], [1, 2, 3], sizes, sizes) == (b"2,1|1,2;3|3", 2, [2 << 20 | 1, 2 << 20 | 2, 1 << 20 | 2, 3 << 20 | 3])
    assert align_window([4], [1, 3], sizes, sizes) == (b"4|1,3", 1, [4 << 20 | 1, 4 << 20 | 3])


def test_ids_are_aligned_in_one_step_for_many_groups():
    draw, sizes = np.random.default_rng(3), np.arange(9)
    a, b = draw.integers(1, 9, 4000), draw.integers(1, 9, 4000)
    a, b = (np.append(x, np.ones(max(0, y.sum() - x.sum()), dtype=np.int64)) for x, y in ((a, b), (b, a)))
    names, ends, first, number = align_ids(a, b, sizes, sizes)
    end_a, end_b = np.cumsum(a), np.cumsum(b)
    assert ends.sum() == len(set(end_a.tolist()) & set(end_b.tolist())) and len(names) == len(a) + len(b)
    for k in range(0, len(a), 97):
        linked = np.flatnonzero((end_b > end_a[k] - a[k]) & (end_b - b < end_a[k]))
        assert linked.tolist() == list(range(first[k], first[k] + number[k]))


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _plain_variants(words, ratio=10):
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n, form[w], words[form[w]] if form[w] else None, len(near[w]), root(w)) for w, n in words.items()}


@pytest.mark.parametrize("min_gram, max_gram, frequent", [(2, 3, 5), (2, 3, 10_000), (2, 2, 0), (3, 3, 1), (1, 3, 20), (2, 4, 3)])
def test_variants_equal_all_pairs(spark, min_gram, max_gram, frequent):
    r = random.Random(min_gram * 100 + max_gram)
    words: dict = {}
    while len(words) < 700:
        base = "".join(r.choice("abc" if r.random() < 0.5 else "abcdeéü") for _ in range(r.randint(8, 11)))
        words[base] = r.choice([2, 3, 50, 4000])
        for _ in range(3):
            k = r.randrange(len(base))
            other = r.choice([base[:k] + base[k + 1:], base[:k] + r.choice("abcé") + base[k:], base[:k] + r.choice("abcé") + base[k + 1:]])
            words[other] = r.choice([2, 7, 90])
    words = {w: n for w, n in words.items() if len(w) >= 8}
    table = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 5, "x")], "word string, n long, form string").repartition(7)
    got = spelling_variants(table, min_gram=min_gram, max_gram=max_gram, frequent=frequent).collect()
    assert len(got) == len(words) and {tuple(x) for x in got} == _plain_variants(words)


def test_variant_chains_ties_and_short_words(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "zaaabbb": 20_000, "ccccccc": 2, "cccccca": 20, "ccccccb": 20}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(x) for x in spelling_variants(table).collect()} == _plain_variants(words)
    assert spelling_variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="letters"):
        spelling_variants(spark.createDataFrame([("abc", 5)], "word string, n long"))


def test_every_place_leaves_a_gram_unaffected():
    r = random.Random(4)
    words = ["".join(r.choice("ab") for _ in range(r.randint(6, 9))) for _ in range(200)]
    frequent = ["aa", "ab", "ba"]
    known = {2: np.sort(_spans(np.frombuffer("".join(frequent).encode("utf-32-le"), dtype="<u4"), 2)[::2])}
    cut = Decomposed(words, known, 2, 3)
    for k, w in enumerate(words):
        for gap in (0, 1):
            at = np.arange(len(w) + gap)
            first, until, begin, last = cut.unaffected(np.full(len(at), k), at, at + 1 - gap)
            assert np.all((until - first) + (last - begin) >= 1)


def test_counted_words_by_hand(spark):
    texts = [None, "", "Wörter-ÀÿÖ wörter Wörter×÷ plain plain PLAIN naïveté7naïveté", "ſtraße straße straße 漢字 straßeÿ"]
    docs = documents(spark, [(k, t, "s") for k, t in enumerate(texts)] + [(None, "plain", "s")])
    got = {r["word"]: r["n"] for r in counted_words(docs, min_length=5, min_count=2).collect()}
    assert got == {"wörter": 2, "plain": 4, "naïveté": 2, "straße": 2}
    want: dict = {}
    for key, text in [(0, None), (1, ""), (2, texts[2]), (3, texts[3]), ("", "plain")]:
        import re
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{key}:{w}".encode())
            w = w[:h % len(w)] + w[h % len(w) + 1:] if h % 3 == 0 else w
            if len(w) >= 2:
                want[w] = want.get(w, 0) + 1
    assert {r["word"]: r["n"] for r in counted_words(docs, min_length=2, min_count=1, shorten_every=3).collect()} == want
