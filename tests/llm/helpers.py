"""Plain versions and small tables for the corpus operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text, lower=True):
    return WORD.findall((text or "").translate(_LOWER) if lower else text or "")


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(sets, percent):
    """Smallest reachable id per id, over all pairs."""
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def prose(seed, n, vocabulary=4000):
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    """Documents with extra columns whose names clash with those of results."""
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)
    from pyspark.sql import functions as F

    return frame.withColumns({"kept": F.lit("x"), "component_id": F.lit(-1), "size": F.lit("y"), "key": F.lit(0), "score": F.lit("z")})


def odd_texts():
    """Texts at the edges: none, empty, blank, one word, repeats, odd characters, very long."""
    return [None, "", " \t\n ", "one", "one", "a b c", "é ü ñ 漢字 \U0001F600 done", "same " * 50, prose(5, 60) + "\n" + prose(5, 60),
            prose(6, 30_000), "\x00 nul \x1f unit \x85 next", "line\n\nline\r\nline"]
