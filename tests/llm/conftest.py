import random

import pytest

WORDS = "the of and thre ble that oui eau éau Straße über ñandú 12 it's (x) end. STOP a,b zz".split()


def sample(n: int = 120, seed: int = 1) -> list[tuple]:
    """Documents with nulls, empties, copies, near copies, shared passages, repeated lines and one very long text."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "ab", "cd", "ef"]) for _ in range(k))
    passage, line = prose(60), prose(9)
    texts: list = [None, "", " \t\n", "one", "a b", "x " * 70, prose(9000), "\x0b\x0ca\x85b c\n\n"]
    texts += ["mail me@x.org or +49 (30) 1234-5678, 10.0.0.255; 4539 1488 0343 6467 token = \"ab12cd34ef56\"", "a@b.c@d.e 1.2.3.4.5.6.7.8 300.1.1.1 +1"]
    while len(texts) < n:
        k = rng.random()
        if k < 0.15:
            texts.append(rng.choice(texts))
        elif k < 0.3:
            words = prose(rng.randint(80, 200)).split(" ")
            words[rng.randrange(len(words))] = "edited"
            texts += [" ".join(words), " ".join([*words[:-1], "last"])]
        elif k < 0.45:
            texts.append(f"{prose(20)} {passage} {prose(rng.randint(0, 30))}")
        elif k < 0.6:
            texts.append("\n".join([line, prose(30), line, prose(5), line[:-1]]))
        elif k < 0.7:
            texts.append("!! ".join(["SPAM"] * rng.randint(5, 90)))
        else:
            texts.append("\n".join(prose(rng.randint(1, 60)) for _ in range(rng.randint(1, 6))))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    full = [(i, t, "en", f"src{i % 3}", len(t or ""), "h", 1, "c") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h string, words int, candidates string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < 0")
