"""Spelling variants: words one edit apart, by an index of variable-length grams.

Works on any table of words with their counts (this library's own records are numbers
by time, so it is kept general); ``counted_words`` makes one from texts.

* **Dictionary.**  Grams have ``min_gram`` to ``max_gram`` letters.  A gram is replaced by its
  extensions, one letter longer, where more than ``frequent`` places of the words hold it; rare
  ones stay short.  Only the frequent grams have to be known to cut a word: at each place the
  gram grows until it is not frequent, or has ``max_gram`` letters.  There are at most
  ``MAX_FREQUENT`` of them (the bound ``frequent`` rises with the words), so tasks hold them.
* **Decomposition.**  The grams of a word that do not lie inside an earlier one.
* **Affected grams.**  An edit at place ``i`` can only change grams whose letters, or whose letter
  after the end in case they grow, reach ``i``, and those that a gram from before the edit may
  come to cover.  All others, fixed by the letters before and after ``i`` alone, stay: two
  words with this edit share every one of them, at equal distances from start and end.
* **List merging.**  Words with all unaffected grams of a place in common are the merge of these
  grams' lists with the number of unaffected grams as the bound.  The lists are merged at
  once: the grams are summed to one key per word and place, and words with equal keys meet in a
  join.  A key leaves at most the letters next to the edit open, so what meets does
  not grow with the lists of single grams.
* **Verification.**  The words are compared letter by letter; a pair is found at one
  place only, so pairs need no second shuffle to become distinct.

Words are at least ``2 * max_gram`` letters long; then every place leaves a gram unaffected.

Defined results: NULL words take no part; repeated words add up their counts; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.words import PLACE, mix
from foldwise.operators.storage import materialize

#: Frequent grams that the dictionary holds at most.
MAX_FREQUENT = 100_000
#: Different words that a task counts before it passes them on.
FLUSH_WORDS = 200_000
_LETTERS = re.compile(b"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shortened(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2,
                  shorten_every: int | None = None) -> DataFrame:
    """``word, n``: runs of ``A-Z``, ``a-z`` and U+00C0 to U+00FF in whole texts, A-Z in lower case, with their counts.

    With ``shorten_every`` a run whose hash with the row's id it divides loses one letter, as slips
    of the pen do: the hash ``h`` is the crc32 of ``<id>:<run>`` and the letter is ``h % length``.  A
    missing id is an empty text there.
    """
    def run(batches):
        held: Counter = Counter()

        def words():
            rows = [(w.decode(), n) for w, n in held.items()]
            rows = [(w, n) for w, n in rows if len(w) >= min_length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], type=pa.string()), pa.array([n for _, n in rows], type=pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = _LETTERS.findall((text.as_py() or "").encode().translate(_LOWER))
                if shorten_every:
                    seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                    runs = [w if (h := zlib.crc32(w, seed)) % shorten_every else _shortened(w, h) for w in runs]
                held.update(runs)
                if len(held) > FLUSH_WORDS:
                    yield words()
        yield words()

    found = docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def frequent_grams(words: DataFrame, min_gram: int, max_gram: int, frequent: int) -> list[str]:
    """The grams of ``min_gram`` to ``max_gram - 1`` letters that more than ``frequent`` places of ``words(word)`` hold."""
    out = []
    for size in range(min_gram, max_gram):
        places = F.transform(F.sequence(F.lit(1), F.char_length("word") - size + 1), lambda i: F.substring("word", i, F.lit(size)))
        grams = words.where(F.char_length("word") >= size).select(F.explode(places).alias("gram"))
        counted = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        bound = max(frequent, total * (max_gram - min_gram) // MAX_FREQUENT)
        out += [r["gram"] for r in counted.where(F.col("n") > bound).select("gram").collect()]
    return sorted(out)


def _spans(letters: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` letters from each place; past the end without meaning."""
    padded = np.append(letters, np.zeros(size, dtype=letters.dtype)).astype(np.uint64)
    return mix(sum(padded[k:k + len(letters)] * PLACE[k] for k in range(size)) + PLACE[62:63] * np.uint64(size))


class Decomposed:
    """The grams of many words, end to end: ``start``, ``stop`` (after the last letter), ``need`` (after the last letter looked at)."""

    def __init__(self, words: list[str], known: dict[int, np.ndarray], min_gram: int, max_gram: int):
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.bounds = np.append(0, np.cumsum(self.length))
        n, place = len(self.letters), np.arange(len(self.letters))
        end = np.repeat(self.bounds[1:], self.length)
        grown, hashes = np.full(n, min_gram, dtype=np.int64), {size: _spans(self.letters, size) for size in range(min_gram, max_gram + 1)}
        for size in range(min_gram, max_gram):
            if len(known[size]):
                at = np.minimum(np.searchsorted(known[size], hashes[size]), len(known[size]) - 1)
                grown[(grown == size) & (place + size <= end) & (known[size][at] == hashes[size])] += 1
        size = np.minimum(grown, end - place)
        stop = np.where(size >= min_gram, place + size, 0)
        before = np.append(0, np.maximum.accumulate(stop)[:-1]) if n else stop
        kept = np.flatnonzero(stop > np.maximum(before, np.repeat(self.bounds[:-1], self.length)))
        self.start, self.stop, self.need = kept, stop[kept], kept + grown[kept]
        own = np.zeros(len(kept), dtype=np.uint64)
        for length in range(min_gram, max_gram + 1):
            mine = size[kept] == length
            own[mine] = hashes[length][kept[mine]]
        word = np.searchsorted(self.bounds, kept, side="right") - 1
        # Sums of gram hashes, with places counted from the start and from the end of the word.
        self.from_start = np.append(np.uint64(0), np.cumsum(mix(own + PLACE[60] * (kept - self.bounds[word]).astype(np.uint64)), dtype=np.uint64))
        self.from_end = np.append(np.uint64(0), np.cumsum(mix(own + PLACE[61] * (self.bounds[word + 1] - kept).astype(np.uint64)), dtype=np.uint64))
        self.max_gram = max_gram

    def unaffected(self, word: np.ndarray, left: np.ndarray, right: np.ndarray):
        """Bounds of the grams fixed by the letters before place ``left``, and by those from place ``right`` on (places within a word)."""
        base, after = self.bounds[word], self.bounds[word + 1]
        first, last = np.searchsorted(self.start, base), np.searchsorted(self.start, after)
        until = np.clip(np.searchsorted(self.need, base + left, side="right"), first, last)
        begin = np.maximum(np.searchsorted(self.start, base + right), np.searchsorted(self.stop, base + right + self.max_gram))
        return first, until, np.clip(begin, first, last), last

    def keys(self, word: np.ndarray, left: np.ndarray, right: np.ndarray, place: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """One key per word and place: all unaffected grams, the place, and the letters that stay."""
        first, until, begin, last = self.unaffected(word, left, right)
        sums = (self.from_start[until] - self.from_start[first]) * PLACE[56] + (self.from_end[last] - self.from_end[begin]) * PLACE[57]
        return mix(sums + place.astype(np.uint64) * PLACE[58] + rest.astype(np.uint64) * PLACE[59])


def _keyed(grams: list[str], min_gram: int, max_gram: int):
    known = {}
    for size in range(min_gram, max_gram):
        mine = [g for g in grams if len(g) == size]
        letters = np.frombuffer("".join(mine).encode("utf-32-le"), dtype="<u4")
        known[size] = np.sort(_spans(letters, size)[::size])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = Decomposed(batch.column(0).to_pylist(), known, min_gram, max_gram)
            for gap in (0, 1):  # a letter of the word goes; a letter comes in before it
                places = cut.length + gap
                word = np.repeat(np.arange(len(places)), places)
                at = np.arange(len(word)) - np.repeat(np.cumsum(places) - places, places)
                keys = cut.keys(word, at, at + 1 - gap, at, cut.length[word] - 1 + gap)
                rows = pa.array(word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array((at + 1).astype(np.int32)), pa.array(np.full(len(word), bool(gap))),
                     batch.column(0).take(rows), batch.column(1).take(rows)], ["key", "at", "gap", "word", "n"])

    return run


def near_words(words: DataFrame, min_gram: int = 2, max_gram: int = 3, frequent: int = 1000) -> DataFrame:
    """``word, n, other, other_n`` for all words exactly one edit apart, in both directions; ``words(word, n)`` are distinct and written."""
    grams = frequent_grams(words, min_gram, max_gram, frequent)
    keyed = words.mapInArrow(_keyed(grams, min_gram, max_gram), "key long, at int, gap boolean, word string, n long")
    keyed = keyed.repartition("key")
    gone, gap = keyed.where("not gap").drop("gap"), keyed.where("gap").drop("gap")
    a, b = gone.alias("a"), gone.alias("b")
    behind = [F.expr(f"substring({x}.word, a.at + {k})") for x, k in (("a", 1), ("b", 1), ("b", 0))]
    same_start = F.expr("substring(a.word, 1, a.at - 1) = substring(b.word, 1, a.at - 1)")
    both = (F.col("a.key") == F.col("b.key")) & (F.col("a.at") == F.col("b.at")) & same_start
    replaced = a.join(b, both & (F.col("a.word") < F.col("b.word")) & (behind[0] == behind[1]))
    # Of the places at which a repeated letter may have gone, the last one counts.
    c = gap.alias("b")
    lost = a.join(c, both & (behind[0] == behind[2]) & F.expr("substring(a.word, a.at, 1) <> substring(b.word, a.at, 1)"))
    pairs = replaced.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).union(
        lost.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")))
    ways = F.explode(F.array(F.struct("word", "n", "other", "other_n"),
                             F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(ways.alias("w")).select("w.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``, written, with a form each: the word at the end of the way from form to form.

    Every step doubles the length of way; a form has ``ratio`` times the count of its word, so ways are short.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, word_col: str = "word", count_col: str = "n", ratio: int = 10, min_gram: int = 2, max_gram: int = 3,
                      frequent: int = 1000) -> DataFrame:
    """``word, n, form, form_n, n_near, root`` for every word of a table of words with counts.

    ``n_near`` words are exactly one inserted, deleted or replaced letter away; ``form`` is the one
    of largest count (the first in code-point order of several), if that is at least ``ratio``
    times the word's; ``root`` is reached by following forms.
    """
    own = words.where(F.col(word_col).isNotNull()).groupBy(F.col(word_col).alias("word")).agg(F.sum(count_col).cast("long").alias("n"))
    own = materialize(own)
    shortest = own.agg(F.min(F.char_length("word"))).first()[0]
    if shortest is not None and shortest < 2 * max_gram:
        raise ValueError(f"words of {shortest} letters with grams of up to {max_gram}: words need {2 * max_gram} letters")
    found = near_words(own, min_gram, max_gram, frequent)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    per_word = materialize(found.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best))
    formed = materialize(per_word.where(-F.col("best.less") >= ratio * F.col("n")).select("word", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")))
    ends = formed.join(roots(formed), "word")
    joined = own.join(per_word.select("word", "n_near"), "word", "left").join(ends, "word", "left")
    return joined.select("word", "n", "form", "form_n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("root", "word").alias("root"))
