"""Registered queries of the corpus operators: thin steps from the given tables and back."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP3 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), l AS (
  SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines
  FROM l LEFT JOIN covered c USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {rules} AS kept, n_stop_words, n_lines FROM b
"""


def _op3_sql() -> str:
    from foldwise.llm.quality_rules import RULES, STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    tests = []
    for r in RULES:
        ratio = f"({r.top}::DOUBLE / nullif({r.bottom}, 0)::DOUBLE)"
        tests += [f"coalesce({ratio} >= {r.low}, true)"] if r.low is not None else []
        tests += [f"coalesce({ratio} <= {r.high}, true)"] if r.high is not None else []
    return OP3.replace("{stop}", stop).replace("{rules}", " AND ".join(tests))


@query("op3_quality_rules", _op3_sql())
def op3_quality_rules(spark, sf_dir):
    from foldwise.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source
), cap AS (
  SELECT *, sum(source_size * 2.0::DOUBLE) OVER o AS used, sum(weight) OVER () - sum(weight) OVER o AS open, (sum(source_size) OVER ())::DOUBLE AS total,
         row_number() OVER o AS k FROM s
  WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT max(v) AS v FROM (
    SELECT 1.5::DOUBLE * any_value(total) / sum(weight) AS v FROM cap
    UNION ALL SELECT (1.5::DOUBLE * total - used) / open FROM cap c
    WHERE open > 0 AND source_size * 2.0::DOUBLE <= weight * (1.5::DOUBLE * total - used + source_size * 2.0::DOUBLE) / (open + weight))
), t AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, v * weight) AS target FROM s, level)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate)
     THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size::DOUBLE END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""


@query("op10_mixing", OP10)
def op10_mixing(spark, sf_dir):
    from foldwise.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents")).drop("copies")


OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""


@query("op1_packing")
def op1_packing(spark, sf_dir):
    import public_tokenizers

    from foldwise.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"),
                  ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_warc", OP8)
def op8_warc(spark, sf_dir):
    from foldwise.llm.warc import new_folder, read_warc, write_warc

    folder = new_folder(spark)
    index = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, index).select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                                  "record_type", "refers_to")


OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), way AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT b.y, r.r FROM reach r JOIN way b ON b.x = r.doc_id)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.r) AS component_id, min(r.r) = w.doc_id AS kept
FROM w JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""


@query("op4_near_duplicates", OP4)
def op4_near_duplicates(spark, sf_dir):
    from foldwise.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


@query("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir):
    from foldwise.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def crc_class(id_col: str, classes: int):
    """crc32 of an id as text, modulo ``classes``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % classes


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf_dir):
    from foldwise.llm.quality_classifier import score_quality

    held_out = crc_class("doc_id", 4) == 2
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=crc_class("id", 4) != 2)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op7_language_model")
def op7_language_model(spark, sf_dir):
    from foldwise.llm.language_model import score_texts

    scored = score_texts(table(spark, sf_dir, "documents"), learn_from=crc_class("id", 7) != 2)
    return scored.select("doc_id", (crc_class("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_nearest")
def op9_nearest(spark, sf_dir):
    from foldwise.llm.neighbours import nearest_periods

    vectors = table(spark, sf_dir, "embeddings")
    return nearest_periods(vectors, F.col("id") % 50 == 0, "vec_id", "embedding").withColumnRenamed("id", "vec_id")


@query("op2_html_text")
def op2_html_text(spark, sf_dir):
    from foldwise.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query("op12_token_files")
def op12_token_files(spark, sf_dir):
    import public_tokenizers

    from foldwise.llm.token_files import new_token_folder, read_token_files, token_digests, write_token_files

    folder = new_token_folder(spark)
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_digests(read_token_files(spark, folder)).withColumnRenamed("id", "doc_id")


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    import public_tokenizers

    from foldwise.llm.alignment import alignment_table

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    return alignment_table(table(spark, sf_dir, "documents"), *paths).withColumnRenamed("id", "doc_id")


# The crc32 in SQL goes by half bytes, whose 16 entries follow from the polynomial.
OP11 = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(16))::BIGINT AS i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 4
), steps AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 4
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents
), counted AS (SELECT doc_id, w, count(*) AS c FROM runs GROUP BY doc_id, w
), hashed AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(2 * strlen(coalesce(doc_id::VARCHAR, '') || ':' || w)),
      lambda i: strpos('0123456789ABCDEF', substr(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), (i + 1 - 2 * (i % 2) + 1)::INT, 1))::BIGINT - 1)),
    lambda a, x: xor(a // 16, t[(xor(a % 16, x) + 1)::INT])), 4294967295) AS h
  FROM counted, steps
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1
), v AS (SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2
), gone AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)
), pairs AS (
  SELECT a.word AS x, a.n AS xn, b.word AS y, b.n AS yn FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, g.n, v.word, v.n FROM gone g JOIN v ON v.word = g.rest
  UNION SELECT v.word, v.n, g.word, g.n FROM gone g JOIN v ON v.word = g.rest
), best AS (
  SELECT x, count(DISTINCT y) AS n_near, max(yn) AS top FROM pairs GROUP BY x
), forms AS (
  SELECT b.x, b.top, min(p.y) AS form FROM best b JOIN pairs p ON p.x = b.x AND p.yn = b.top WHERE b.top >= 10 * p.xn GROUP BY b.x, b.top
), way AS (
  SELECT x, form AS stop, 1 AS d FROM forms UNION ALL SELECT w.x, f.form, w.d + 1 FROM way w JOIN forms f ON f.x = w.stop
), ends AS (SELECT x, arg_max(stop, d) AS root FROM way GROUP BY x)
SELECT v.word, v.n, f.form, f.top AS form_n, coalesce(b.n_near, 0)::BIGINT AS n_near, coalesce(e.root, v.word) AS root
FROM v LEFT JOIN best b ON b.x = v.word LEFT JOIN forms f ON f.x = v.word LEFT JOIN ends e ON e.x = v.word
"""


@query("op11_spelling", OP11)
def op11_spelling(spark, sf_dir):
    from foldwise.llm.spelling import counted_words, spelling_variants

    return spelling_variants(counted_words(table(spark, sf_dir, "documents"), shorten_every=31))
