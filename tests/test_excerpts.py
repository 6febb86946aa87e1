"""Best windows and excerpts against a plain version; time in proportion to the text."""

import random
import re
import time

from pyspark.sql import functions as F

from lodestone.operators import evidence as E

WHITE = " \t\n\x0b\x0c\r"


def low(text):
    return "".join(c.lower() if len(c.lower()) == 1 else "" for c in text)


def plain_window(text, terms, most, counted=None):
    terms = list(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))
    text = text or ""
    small, base = low(text), low(text if counted is None else counted)
    worth = {t: 100 + 1000 // max(1, base.count(t)) + len(t) for t in terms}
    best = None
    for term in terms:
        at = small.find(term)
        while at >= 0:
            start = max(0, min(at - most // 4, len(text) - most))
            value = len(term) + sum(v for t, v in worth.items() if t in small[start : start + most])
            if best is None or (value, -start) > (best[0], -best[1]):
                best = (value, start)
            at = small.find(term, at + len(term))
    if best is None:
        return None
    start = best[1]
    return best[0], ("..." if start else "") + text[start : start + most].strip(WHITE) + ("..." if start + most < len(text) else "")


def plain_excerpt(values, terms, most):
    one = [re.sub(r"[ \t\n\x0b\f\r]+", " ", v or "").strip(" ") for v in values]
    every = "\n".join(v for v in one if v)
    best = None
    for v in one:
        found = plain_window(v, terms, most, every)
        if found and (best is None or found[0] > best[0]):
            best = found
    if best:
        return best[1]
    first = next((v for v in one if v), "")
    return first if len(first) <= most else first[:most].strip(" ") + "..."


def texts(seed=4, n=120):
    rng = random.Random(seed)
    words = ["aa", "aaa", "aba", "ab", "b", "É", "İ", "the", "Token", "toke", "\n", "x" * 9, "ß", "𝔘"]
    return [None, "", "aa", "İaba", "aaaa", "x" * 500] + ["".join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(rng.randint(1, 400))) for _ in range(n)]


def test_windows(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i int, t string").repartition(4)
    for terms, most in ((["aba", "aa", "token"], 20), (["aa"], 5), (["b", " B ", "é", ""], 60), (["zz"], 10), ([], 10)):
        got = {r.i: r.w and tuple(r.w) for r in df.select("i", E.best_window(F.col("t"), terms, most).alias("w")).collect()}
        for i, t in rows:
            assert got[i] == plain_window(t, terms, most), (i, t, terms)


def test_excerpts(spark):
    rng = random.Random(9)
    pool = texts(5, 40)
    rows = [(i, rng.choice(pool), rng.choice(pool), rng.choice(pool)) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string")
    for terms, most in ((["aba", "token"], 30), (["zz"], 12)):
        got = dict(df.select("i", E.excerpt([F.col("a"), F.col("b"), F.col("c")], terms, most)).collect())
        for i, *values in rows:
            assert got[i] == plain_excerpt(values, terms, most), (i, values)


def test_time_grows_with_the_text(spark):
    """Eight times the text, all of it hits, takes far less than sixty-four times the time."""

    def took(n):
        df = spark.range(1).select(F.repeat(F.lit("a token is under it, "), n).alias("t")).select(E.best_window(F.concat("t", F.rand(1).cast("string")), ["token", "under"], 160).alias("w"))
        best = 1e9
        for _ in range(2):
            begin = time.perf_counter()
            assert df.first().w.score > 0
            best = min(best, time.perf_counter() - begin)
        return best

    took(100)
    assert took(40_000) < 24 * max(took(5_000), 0.2)
