"""A log-bilinear language model, trained with noise-contrastive estimation in numpy.

General texts with an id.  The corpus gives the counts of all words; the most
frequent ones are the model's own vocabulary, every other word is the class
``rest`` followed by the word's share within that class.  The context of a word is
the two words before it (at the start of a text: the end token).  Its vector is
the sum of the context words' vectors, each times a learned diagonal; the score of
a next word is the product with its own vector plus an offset.  Scoring normalises
over the whole vocabulary with one matrix product per block of distinct contexts.

Training data is all training text: every task runs noise-contrastive estimation
over its own part, starting from the same parameters; the tasks' parameters are
averaged by tokens in a Spark aggregation, and the next round starts from there.
Rounds take turns over the documents, so all rounds together read each once.

Sizes: the vocabulary and the table of head counts are bounded by parameters and
travel to the tasks; counts of all other words stay in a table that is joined with
the rare words of the documents.  Frequent words never enter that join, so no key
of it holds more than a small share of the rows.

Defined results: NULL or empty texts have the end token only; rows with equal ids are
scored each for itself; an empty table gives an empty table; without training
texts all counts are zero.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foldwise.llm.words import Words, lists, slices
from foldwise.operators.storage import materialize

#: The id of the end token among word hashes (fixed; no word hashes to it but by chance).
END = np.uint64(0x5EED0F0E4D000001)
REST = 0  # class of all words outside the vocabulary
NOISE, BATCH = 64, 1024


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end token after every text, and the place of each text's first token."""
    n = len(words.count)
    out = np.empty(len(words.hash) + n, dtype=np.uint64)
    first = words.first[:-1] + np.arange(n)
    ends = words.first[1:] + np.arange(n)
    keep = np.ones(len(out), dtype=bool)
    keep[ends] = False
    out[keep], out[ends] = words.hash, END
    return out, np.append(first, len(out))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all rows of ``texts(text)``; words are 64-bit hashes, the end token is one of them."""
    def run(batches):
        held, size = [], 0

        def counted():
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for _, _, data, bounds in slices(batch.column(0)):
                held.append(_tokens(Words(data, bounds, True))[0])
                size += len(held[-1])
                if size > 4_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Head words by falling count: the first are the model's classes, from 1 on."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, classes: int, total: int, distinct: int):
        self.classes, self.total, self.distinct = min(classes, len(words) + 1), total, distinct
        rank = np.arange(1, len(words) + 1)
        order = np.argsort(words)
        self.words, self.counts, self.rank = words[order], counts[order], rank[order]
        own = counts[:self.classes - 1]
        self.rest_total, self.rest_distinct = total - int(own.sum()), distinct - len(own)
        self.noise = np.concatenate([[self.rest_total + 1], own]).astype(float)
        self.noise /= self.noise.sum()

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and its count where it is a head word (else -1)."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64), np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        hit = self.words[at] == tokens
        rank = np.where(hit, self.rank[at], self.classes)
        return np.where(rank < self.classes, rank, REST), np.where(hit, self.counts[at], -1)

    def contexts(self, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two classes before each token; before a text begins stands the end token."""
        end = self.find(np.array([END]))[0][0]
        one, two = np.roll(classes, 1), np.roll(classes, 2)
        starts = first[:-1]
        one[starts], two[starts] = end, end
        second = starts[np.diff(first) > 1] + 1
        two[second] = end
        return one, two


class Bilinear:
    """Context vectors, target vectors, two diagonals, offsets."""

    def __init__(self, vocabulary: Vocabulary, size: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        v = vocabulary.classes
        self.p = {"context": rng.normal(0, 0.1, (v, size)), "target": rng.normal(0, 0.1, (v, size)), "diagonal": np.ones((2, size)),
                  "offset": np.log(vocabulary.noise)[:, None]}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.squares = {k: np.full(x.shape, 1e-2, dtype=np.float32) for k, x in self.p.items()}

    def query(self, one, two):
        p = self.p
        return p["context"][one] * p["diagonal"][0] + p["context"][two] * p["diagonal"][1]

    def log_probabilities(self, one, two, target, block: int = 2048) -> np.ndarray:
        """Natural logs, normalised over all classes; each distinct context is normalised once."""
        v = len(self.p["offset"])
        pairs, back = np.unique(one * v + two, return_inverse=True)
        norm = np.empty(len(pairs))
        for a in range(0, len(pairs), block):
            q = self.query(pairs[a:a + block] // v, pairs[a:a + block] % v)
            z = q @ self.p["target"].T + self.p["offset"][:, 0]
            top = z.max(axis=1)
            norm[a:a + block] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        out = np.empty(len(target))
        for a in range(0, len(target), 1 << 16):
            s = slice(a, a + (1 << 16))
            out[s] = (self.query(one[s], two[s]) * self.p["target"][target[s]]).sum(axis=1) + self.p["offset"][target[s], 0]
        return out - norm[back]

    def _step(self, name, rows, gradient, rate):
        """AdaGrad on some rows; equal rows are summed first."""
        if rows is not None:
            order = np.argsort(rows, kind="stable")
            rows, starts = np.unique(rows[order], return_index=True)
            gradient = np.add.reduceat(gradient[order], starts, axis=0)
        else:
            rows = slice(None)
        self.squares[name][rows] += gradient * gradient
        self.p[name][rows] += rate * gradient / np.sqrt(self.squares[name][rows])

    def learn(self, one, two, target, noise: np.ndarray, rng, rate: float = 0.1) -> None:
        """One pass of noise-contrastive estimation; a batch shares its noise words."""
        logs, p = np.log(noise), self.p
        for a in range(0, len(target), BATCH):
            s = slice(a, a + BATCH)
            w1, w2, w = one[s], two[s], target[s]
            drawn = rng.choice(len(noise), NOISE, p=noise)
            c1, c2 = p["context"][w1], p["context"][w2]
            q = c1 * p["diagonal"][0] + c2 * p["diagonal"][1]
            own, other = p["target"][w], p["target"][drawn]
            true = (q * own).sum(axis=1) + p["offset"][w, 0] - np.log(NOISE) - logs[w]
            false = q @ other.T + p["offset"][drawn, 0] - np.log(NOISE) - logs[drawn]
            up = (1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32)[:, None]
            down = (-1 / (1 + np.exp(np.clip(-false, -30, 30)))).astype(np.float32)
            dq = up * own + down @ other
            n = np.float32(1 / len(w))
            self._step("diagonal", None, n * np.stack([(dq * c1).sum(axis=0), (dq * c2).sum(axis=0)]), rate)
            rows = np.concatenate([w1, w2])
            self._step("context", rows, np.concatenate([dq * p["diagonal"][0], dq * p["diagonal"][1]]), rate)
            both = np.concatenate([w, drawn])
            self._step("target", both, np.concatenate([up * q, down.T @ q]), rate)
            self._step("offset", both, np.concatenate([up, down.sum(axis=0)[:, None]]), rate)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.tables())
        return out.getvalue()

    def tables(self) -> dict:
        """Parameters, and the sums of squares that set their steps."""
        return self.p | {f"{k}_squares": x for k, x in self.squares.items()}

    def load(self, data: bytes) -> Bilinear:
        with np.load(io.BytesIO(data)) as stored:
            for k in self.p:
                self.p[k], self.squares[k] = stored[k], stored[f"{k}_squares"]
        return self


def _head(counts: DataFrame, size: int):
    """The ``size`` most frequent words with counts (a bound of the model), and totals."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rows = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    words = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    return words, np.array([r["n"] for r in rows], dtype=np.int64), int(totals[0]), int(totals[1])


def train(texts: DataFrame, vocabulary: Vocabulary, size: int, rounds: int) -> bytes:
    """Parameters after ``rounds`` of training in all tasks and averaging; ``texts(text, turn)``."""
    state = Bilinear(vocabulary, size).dump()
    for turn in range(rounds):
        def run(batches, state=state):
            net, rng, seen = Bilinear(vocabulary, size).load(state), np.random.default_rng(5), 0
            for batch in batches:
                for _, _, data, bounds in slices(batch.column(0)):
                    tokens, first = _tokens(Words(data, bounds, True))
                    classes, _ = vocabulary.find(tokens)
                    one, two = vocabulary.contexts(classes, first)
                    mixed = rng.permutation(len(classes))
                    net.learn(one[mixed], two[mixed], classes[mixed], vocabulary.noise, rng)
                    seen += len(classes)
            if seen:
                for name, x in net.tables().items():
                    rows = x.astype(np.float64) * seen
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows)), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), float(seen))),
                         *[pa.array(rows[:, k] if k < rows.shape[1] else np.zeros(len(rows))) for k in range(size)]],
                        ["name", "row", "weight", *[f"x{k}" for k in range(size)]])

        fields = ", ".join(f"x{k} double" for k in range(size))
        parts = texts.where(F.col("turn") == turn).select("text").mapInArrow(run, f"name string, row int, weight double, {fields}")
        means = parts.groupBy("name", "row").agg(*[(F.sum(f"x{k}") / F.sum("weight")).alias(f"x{k}") for k in range(size)]).collect()
        if not means:
            continue
        net = Bilinear(vocabulary, size)
        tables = net.tables()
        for r in means:
            own = tables[r["name"]][r["row"]]
            own[:] = [r[f"x{k}"] for k in range(len(own))]
        state = net.dump()
    return state


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_from: Column | None = None, classes: int = 1024,
                head_words: int = 65536, size: int = 16, rounds: int = 2) -> DataFrame:
    """One row per input row: ``id, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the add-one unigram score and ``score`` the model's, both
    log10 over all tokens of the text (A-Z lower-cased words and one end token).
    Texts for which ``learn_from`` (a condition on ``id``) holds are learned from.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    learned = named.where(learn_from) if learn_from is not None else named
    learned = learned.withColumn("turn", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(rounds)))
    counts = materialize(word_counts(learned))
    words, n, total, distinct = _head(counts, head_words)
    vocabulary = Vocabulary(words, n, classes, total, distinct)
    state = train(learned, vocabulary, size, rounds)
    kind = named.schema["id"].dataType
    arrow = to_arrow_type(kind)
    rest_log = np.log10(vocabulary.rest_total + vocabulary.rest_distinct + 1)

    def run(batches):
        from pyspark import TaskContext

        net, row = Bilinear(vocabulary, size).load(state), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(1)):
                tokens, first = _tokens(Words(data, bounds, True))
                found, count = vocabulary.find(tokens)
                one, two = vocabulary.contexts(found, first)
                logs = net.log_probabilities(one, two, found) / np.log(10)
                known = np.log10(np.maximum(count, 0) + 1.0)
                logs += np.where(found == REST, known - rest_log, 0.0)
                sums = [np.add.reduceat(x, first[:-1]) for x in (known, logs, (count > 0).astype(np.int64))]
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                rare = np.flatnonzero(count < 0)
                pairs, times = _grouped(doc[rare], tokens[rare])
                edges = np.searchsorted(pairs[0], np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(arrow), pa.array(row + np.arange(hi - lo)), pa.array(np.diff(first)), pa.array(sums[2]),
                     pa.array(sums[0]), pa.array(sums[1]), lists(pairs[1], edges), lists(times.astype(np.int32), edges, pa.int32())],
                    ["id", "row", "n_tokens", "known", "base", "model", "words", "times"])
                row += hi - lo

    first = materialize(named.mapInArrow(run, f"id {kind.simpleString()}, row long, n_tokens long, known long, base double, model double, "
                                              "words array<bigint>, times array<int>"))
    rare = first.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("t"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("t") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("t").alias("seen"))
    out = first.drop("words", "times").join(found, "row", "left")
    more, base = F.coalesce("more", F.lit(0.0)), float(np.log10(total + distinct + 1))
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * F.lit(base)).alias("base_score"),
                      (F.col("model") + more).alias("score"))


def _grouped(doc: np.ndarray, word: np.ndarray):
    """Distinct pairs in order of document, with how often each occurs."""
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    return (doc[at], word[at]), np.diff(np.append(at, len(doc)))
