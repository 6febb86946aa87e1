"""Each operator against a brute-force version, with edge rows, repeated rows and an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import common, decontam, lines, lmscore, packing, pii, quality, rules, simhash, substring, tokens

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 1


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(docs, rows, empty):
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_spans(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert [s for s in got[i] if s[0] in pii.BASE] == base_spans(t or "")
        assert all(a < b for _, a, b in got[i])
    assert pii.find_spans(empty).count() == 0


def test_pii_extras_and_mask(docs):
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t) if k not in pii.BASE]
    assert found('token = "ab12cd34ef56"') == [("secret", "ab12cd34ef56")]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 and more") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("see https://user:pw@host/x and SSN 078-05-1120") == [("ssn", "078-05-1120"), ("login", "user:pw")]
    assert found("the token of the account was secret") == []
    assert pii.masked("x me@x.org y", [("email", 2, 10)]) == "x <email> y"
    assert pii.mask(docs).columns == docs.columns


# 2


def without_repeats(rows, n):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        gone, new = [False] * len(w), []
        for a in range(len(w) - n + 1):
            k = tuple(w[a : a + n])
            if seen.get(k, i) < i:
                gone[a : a + n] = [True] * n
            else:
                new.append(k)
        for k in new:
            seen.setdefault(k, i)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("n", [50, 7])
def test_substrings(docs, rows, empty, n):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, n).collect()}
    assert got == without_repeats(rows, n)
    assert sum(x[1] for x in got.values()) > 0
    if n == 50:
        assert substring.remove_repeats(empty).count() == 0


# 3


def fingerprint(t, k):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[a : a + k]), 42) for a in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def connected(fps, distance):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= distance and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [3, 5])
def test_near_duplicates(docs, rows, empty, k):
    fps = {i: fingerprint(t, k) for i, t in rows}
    got = simhash.near_duplicates(docs, k).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == connected(fps, 2)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowded", [2, 1000])
def test_crowded_buckets_lose_no_link(spark, crowded):
    rng = np.random.default_rng(4)
    fps = {int(rng.integers(0, 2**62))}
    for _ in range(150):  # chains of one and two bits around one point
        fps.add(int(rng.choice(sorted(fps))) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 3), replace=False)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = connected({signed(x): x for x in fps}, 2)
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 2, crowded)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_allocation_is_the_best():
    costs = [[0, 5.0, 9.0, 99.0], [0, 2.0, 30.0, 99.0], [0, 4.0, 5.0, 99.0]]
    best, thresholds = simhash.allocate(costs, 3)
    assert best == 7.0 and thresholds == [-1, 0, 1]


# 4


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 0 if "SPAM" in (t or "") else 1, 0) for i, t in rows if t], "doc_id long, quality int, toxic int")
    machine = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, machine).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    held = [(got[i].score, "SPAM" in (t or "")) for i, t in rows if t and got[i].held_out]
    assert all(a < b for a, spam in held if spam for b, other in held if not other)
    assert quality.score(empty, machine).count() == 0
    again = quality.train(docs, labels)
    assert np.array_equal(machine.linear, again.linear)
    assert quality.train(empty, labels.limit(0)).bias == 0.0


def test_quality_without_n_chars(spark):
    held = spark.createDataFrame([(i, "SPAM " * (i % 2) + "some words of a text" * 3, i) for i in range(60)], "doc_id long, text string, score int")
    machine = quality.train(held, held.selectExpr("doc_id", "1 - doc_id % 2 AS quality"))
    got = {r.doc_id: r.score for r in quality.score(held, machine).collect()}
    assert max(got[i] for i in range(1, 60, 2)) < min(got[i] for i in range(0, 60, 2))


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    j, x = np.array([1, 4, 7]), np.array([0.5, 2.0, 1.0])
    pairs = sum(m.factors[j[a]] @ m.factors[j[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert m.logits(np.zeros(3, int), j, x)[0] == pytest.approx(0.3 + m.linear[j] @ x + pairs)


# 5


def line_decisions(rows, least=20):
    first, occurrences = {}, []
    for i, t in sorted(rows):
        for n, raw in enumerate((t or "").split("\n")):
            if line := raw.strip(SPACES):
                occurrences.append((i, n, line))
                first.setdefault(line, (i, n))

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    long = [x for x in first if len(x) >= least]
    late = {a for a in long for b in long if abs(len(a) - len(b)) < 2 and first[b] < first[a] and close(a, b)}
    return {(i, n): first[line] != (i, n) or line in late for i, n, line in occurrences}


@pytest.mark.parametrize("crowded", [128, 4, 1])
def test_lines(spark, docs, rows, empty, crowded):
    extra = [(5000 + i, "a long line with a letter " + c + " in it\n" + "x" * i) for i, c in enumerate("abcdefgh")] + [(6000, "a long line with a letter  in it")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = line_decisions(rows + extra)
    found = lines.line_decisions(more, crowded=crowded).collect()
    assert {(r.doc_id, r.no): r.removed for r in found} == want
    assert all((tuple(r.head) < (r.doc_id, r.no)) == r.removed for r in found)
    if crowded == 128:
        assert lines.line_decisions(empty).count() == 0
        kept = {r.doc_id: r.text for r in lines.remove_lines(docs).collect()}
        plain = line_decisions(rows)
        for i, t in rows:
            assert kept[i] == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not plain.get((i, n))))


def test_lines_keep_columns_of_any_name(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 2)
    names = "_gone _doc h g line no key removed head deal first _others earlier n".split()
    held = [(i, "a common line of the texts\nx", *range(len(names))) for i in range(1, 10)] + [(None, "a common line of the texts!", *range(len(names)))]
    frame = spark.createDataFrame(held, "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    got = lines.remove_lines(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id or -1, r.text, r.deal) for r in got.collect()) == [(-1, "a common line of the texts!", 9), (1, "x", 9), *((i, "", 9) for i in range(2, 10))]


@pytest.mark.parametrize("crowded", [1, 8])
def test_lines_that_share_almost_all(spark, crowded):
    """Substitutions, insertions and deletions at every place of a line, long and short, and letters beyond the basic plane."""
    rng = random.Random(11)
    base = "".join(rng.choice("abcdé\U0001f600") for _ in range(23))
    held = [base] + [base[:i] + c + base[i + 1 :] for i in range(23) for c in "xy"] + [base[:i] + "z" + base[i:] for i in range(24)] + [base[:i] + base[i + 1 :] for i in range(23)]
    held += [base[:5] + chr(0x4E00 + i) + base[6:] for i in range(40)] + [base[:9] + chr(0x4E00 + i) + base[9:] for i in range(40)]
    long = "".join(rng.choice("abcdef ") for _ in range(1500)) + "."
    held += [long[:i] + "#" + long[i + 1 :] for i in range(3, 1500, 150)] + [long[:i] + "#" + long[i:] for i in range(5, 1500, 150)] + [long[:i] + "##" + long[i:] for i in range(5, 1500, 300)]
    rng.shuffle(held)
    rows = [(i // 7, "\n".join(held[i : i + 7])) for i in range(0, len(held), 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lines.line_decisions(frame, crowded=crowded).collect()
    assert {(r.doc_id, r.no): r.removed for r in found} == line_decisions(rows)


def test_pairs_grow_with_the_lines_not_their_square(spark, monkeypatch):
    """120 lines that share almost all meet a few others each, and none that is alike is lost."""
    made, real = [], lines._pairs
    monkeypatch.setattr(lines, "_pairs", lambda stored, held: made.append(stored.agg(F.sum(F.size(held))).first()[0] or 0) or real(stored, held))
    base = "every one of these lines differs from the others in a single letter, which may stand at any of its places, from the first to the very last"
    held = [(i, base[:i] + "#" + base[i + 1 :]) for i in range(120)] + [(500, base)]
    found = lines.line_decisions(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.no): r.removed for r in found} == line_decisions(held)
    assert 0 < sum(made) <= 16 * len(held)


def test_equal_hashes_remove_no_line(spark, monkeypatch):
    """Keys that collide make candidates, never decisions."""
    monkeypatch.setattr(lines, "halves", lambda context, window, probe, real=lines.halves: F.transform(real(context, window, probe), lambda k: F.struct(F.pmod(k["key"], F.lit(4)).alias("key"), k["window"].alias("window"))))
    keys = lines.segment_keys
    monkeypatch.setattr(lines, "segment_keys", lambda line: F.transform(keys(line), lambda k: F.struct(F.pmod(k["key"], F.lit(4)).alias("key"), k["probe"].alias("probe"), k["n"].alias("n"))))
    rows = [(i, f"{chr(97 + i) * 12} another line {chr(98 + i) * 12}") for i in range(20)]
    found = lines.line_decisions(spark.createDataFrame(rows, "doc_id long, text string"), crowded=1).collect()
    assert len(found) == 20 and not any(r.removed for r in found)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rng, pairs = random.Random(4), [("", ""), ("a", ""), ("", "abc")]
    letters = "abé\U0001f600 "
    for _ in range(1500):
        a = [rng.choice(letters) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(lines.banded_distance(F.col("a"), F.col("b"), most).alias("d"), F.least(F.levenshtein("a", "b"), F.lit(most + 1)).alias("e"))
    assert got.where("d <> e").count() == 0 < got.where(f"d <= {most}").count()


# 6, 7


def ids_of(t):
    encoder = tokens.Encoder.of(tokens.tokenizer_path())
    return np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")


def test_token_files(docs, rows, empty):
    manifest = tokens.write_shards(docs, tokens.scratch(docs.sparkSession, "t"), tokens.tokenizer_path(), 700)
    assert manifest.count() > 3
    got = tokens.read_shards(manifest).orderBy("doc_id").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(rows)):
        ids = ids_of(t)
        assert (r.doc_id, r.start, bytes(r.ids)) == (i, at, ids.tobytes())
        at += len(ids)
    assert len(got) == len(rows)
    assert tokens.token_files(empty).count() == 0


def test_special_words_are_encoded_alike():
    encoder = tokens.Encoder(tokens.tokenizer_path())
    fixed = ["a~b ~ c", "<|endoftext|>x <|ENDOFTEXT|>", "It's DON'T 12.5 é́ É x́.", "Ünï. ,,, a,b. 　x", "İI ſ", "TAKSİ.", "I\u0307\u0338 I\u0338\u0307. AI\u0307!"]
    for t in fixed + [f"{w}{m}" for m in tokens.TAIL for w in ("İ", "TAKSİ", "aİ", "ﬁ", "ǅ", "ß", "I\u0307")]:
        assert encoder.encode(pa.array([t]))[0].tolist() == ids_of(t).tolist()


def test_random_texts_are_encoded_alike():
    rng = random.Random(11)
    letters = [*"abIKAzE  ", *tokens.TAIL, *"İıſßéÉǅﬁΣςйЖ漢字½²٣'~_-<|>", "\u0307", "\u0338", "\u0301", "\u0327", "\u200d", "\u00a0", "\u2028", "\x85", "\U0001f600", "\u212a", "\n"]
    encoder = tokens.Encoder(tokens.tokenizer_path())
    for _ in range(40):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(250)]
        texts += ["".join(chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x1E00, 0x2100)))) for _ in range(8)) for _ in range(250)]
        flat, bounds = encoder.encode(pa.array(texts))
        want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        wrong = [t for t, a, b, w in zip(texts, bounds, bounds[1:], want) if flat[a:b].tolist() != [*w.ids, 2]]
        assert not wrong


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    a = np.random.default_rng(n).integers(0, 300, n).astype(np.uint16)
    raw = tokens.shard_bytes([7], [n], a, 9)
    doc_ids, sizes, m = tokens.read_shard(raw)
    assert doc_ids == [7] and sizes.tolist() == [n] and (m.decode() == a).all()
    for x in a[:5].tolist():
        assert m.occurrences(x) == np.flatnonzero(a == x).tolist()
        assert m.rank(x, n // 2) == (a[: n // 2] == x).sum()
    assert [m.access(i) for i in range(min(n, 50))] == a[:50].tolist()
    assert m.count(511) == 0 and m.count(1 << 20) == 0


@pytest.mark.parametrize("meet", [64, 1])
def test_packing(docs, rows, empty, monkeypatch, meet):
    monkeypatch.setattr(packing, "MEET", max(meet, 2))
    got = packing.pack(docs.repartition(3 if meet == 64 else 9)).collect()
    text = dict(rows)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(text)
    for i, t in text.items():
        ids, at = ids_of(t), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    tail = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at & (at - 1) == 0 and at <= 4096
        (k,) = {r.size_class for r in held}
        tail += at if k == 0 else 0
        if k:
            assert at == 4096
            lengths = [r.length for r in sorted(held, key=lambda r: r.offset)]
            assert len(lengths) in (k, k + 1) or k == 16
            assert all(k == 16 or 4096 / (k + 1) < x <= 4096 / k for x in lengths[: len(lengths) - 1])
    assert tail < 16 * 4096
    assert packing.pack(empty).count() == 0


def test_packer_cuts_little():
    rng = random.Random(2)
    packer = packing.Packer(0, 4096, 16)
    sizes = [min(9000, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000)]
    for i, n in enumerate(sizes):
        packer.add(i, 0, np.zeros(n, np.uint16), n)
    waiting = packer.waiting()
    assert sum(len(x[2]) for x in waiting) < 16 * 4096
    assert len(packer.done) + len(waiting) < 1.3 * sum(1 + n // 4096 for n in sizes)


# 8


def plain_posteriors(kinds, right=0.9, strength=0.5):
    """Expectation-maximisation over documents, one by one, in arrays."""
    votes = np.array([v for v, n in kinds.items() for _ in range(n)])
    belief = np.where((votes == -1).any(1), 0.01, 0.99)
    for _ in range(200):
        good = belief.sum()
        z = np.full(len(votes), np.log((good + 1) / (len(votes) - good + 1)))
        for r in range(votes.shape[1]):
            for vote, share in ((1, right), (-1, 1 - right)):
                cast = votes[:, r] == vote
                a = (belief[cast].sum() + strength * cast.sum() * share + share) / (good + 1)
                b = ((1 - belief)[cast].sum() + strength * cast.sum() * (1 - share) + 1 - share) / (len(votes) - good + 1)
                z[cast] += np.log(a / b)
        belief = 1 / (1 + np.exp(-z))
    return {tuple(v): p for v, p in zip(votes.tolist(), belief.tolist())}


def test_rules(docs, rows, empty):
    got = {r.doc_id: r.rules for r in rules.judge(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w, t = words(t), t or ""
        real = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
        covered = {p for a in range(len(w) - 7) if windows[tuple(w[a : a + 8])] > 1 for p in range(a, a + 8)}
        s = got[i].s
        assert (s.w.n_words, s.w.word_chars, s.n_symbols, s.l.n_dup_lines, s.w.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(real) - len(set(real)), len(covered))
        assert got[i].base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (got[i].base_failed and got[i].kept)
        if "SPAM" in t:
            assert not got[i].kept
    assert sum(r.kept for r in got.values()) > len(rows) / 3
    kinds = Counter(tuple(r.votes) for r in got.values())
    chance = plain_posteriors(kinds)
    for r in got.values():
        assert r.posterior == pytest.approx(chance[tuple(r.votes)], abs=1e-4)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    assert rules.judge(empty).count() == 0


def test_label_model_finds_accuracies():
    rng, counts = random.Random(3), Counter()
    for _ in range(20000):
        good = rng.random() < 0.85
        sure = [rng.random() < (0.02 if good else 0.7) for _ in range(3)]
        counts[tuple(-1 if s else 1 if good and rng.random() < 0.6 else 0 for s in sure)] += 1
    model = rules.fit(sorted(counts.items()), 3)
    assert model.prior == pytest.approx(0.85, abs=0.1)
    assert all(w[rules.BAD] < -2 for w in model.weights)
    assert model.posterior((-1, -1, 0)) < 0.5 < model.posterior((1, 1, 0))


# 9


def benchmark_hits(rows, items, n=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for k, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).add("null" if k is None else str(k))
    out = {}
    for i, t in rows:
        w, hit, who = cut(t), set(), set()
        for size in {len(x) for x in wins}:
            for a in range(len(w) - size + 1):
                if found := wins.get(tuple(w[a : a + size])):
                    hit.update(range(a, a + size))
                    who |= found
        out[i] = (len(w), len(hit), sorted(who))
    return out


def test_decontamination(spark, docs, rows, empty):
    long = next(t for _, t in rows if t and 60 < len(words(t)) < 100)
    items = [(1, " ".join(words(long)[5:40]).upper()), (12, "one"), (3, "of the zz"), (4, None), (5, "..."), (6, "no such words as these are anywhere in all of it"), (7, words(long)[8] + " " + words(long)[9]), (8, " ".join(words(long)[20:32])), (None, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.phrase_matches(docs, bench)
    assert set(docs.columns) - {"words", "candidates"} <= set(got.columns)
    listed = {r.doc_id: (r.n, r.hit or 0, sorted(set(r.who))) for r in got.select("doc_id", decontam.count_words(F.col("words")).alias("n"), decontam.covered(F.col("hits")).alias("hit"), F.transform("hits", lambda h: h["item_id"]).alias("who")).collect()}
    assert listed == benchmark_hits(rows, items)
    assert sum(x[1] for x in listed.values()) > 50
    assert decontam.phrase_matches(empty, bench).count() == 0
    assert decontam.phrase_matches(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_decontamination_without_broadcasts(spark, docs, rows, monkeypatch):
    """Beyond the bytes that may be broadcast the joins shuffle, with the same hits."""
    bench = spark.createDataFrame([(1, " ".join(words(rows[6][1])[5:40]))], "item_id long, text string")
    hits = lambda: {(r.doc_id, str(r.hits)) for r in decontam.phrase_matches(docs, bench).collect()}
    want = hits()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10)
    asked = []
    monkeypatch.setattr(F, "broadcast", lambda df: asked.append(df))
    assert hits() == want and not asked


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x y z beta"), (2, "alpha beta"), (3, "alpha " + "x " * 60 + "beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta")], "item_id long, text string")
    got = {r.doc_id for r in decontam.proximity_matches(docs, bench, slop=5).collect()}
    assert got == {1, 2}


# 10


def lattice_scores(rows, held):
    """Weights from the vocabulary's own segmentation of the training words, and each word's sum over all segmentations."""
    sp = lmscore.processor(lmscore.vocabulary_path())
    said = {i: (t or "").encode().lower().decode().split() if (t or "").isascii() else [w.decode() for w in (t or "").encode().lower().split()] for i, t in rows}
    counts = np.full(sp.get_piece_size(), 0.5)
    for i, w in said.items():
        if not held[i]:
            for piece in (p for x in w for p in sp.encode(x)):
                counts[piece] += 1
    ends = sum(not h for h in held.values())
    total = counts.sum() + ends + 0.5
    known = {sp.id_to_piece(k): counts[k] / total for k in range(len(counts)) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))}
    byte = {int(sp.id_to_piece(k)[3:5], 16): counts[k] / total for k in range(len(counts)) if sp.is_byte(k)}
    longest, memo = max(map(len, known)), {}

    def log_prob(word):
        if word not in memo:
            text = "\u2581" + word
            inward = [0.0] * len(text) + [1.0]
            scale = 0.0
            for k in range(len(text) - 1, -1, -1):
                inward[k] = sum(known.get(text[k:e], 0.0) * inward[e] for e in range(k + 1, min(len(text), k + longest) + 1))
                if text[k] not in known:
                    inward[k] += math.prod(byte[b] for b in text[k].encode()) * inward[k + 1]
                if inward[k] < 1e-200:
                    inward = [x * 1e200 for x in inward]
                    scale -= 200
            memo[word] = math.log10(inward[0]) + scale
        return memo[word]

    return {i: sum(map(log_prob, w)) + math.log10((ends + 0.5) / total) for i, w in said.items()}


def test_likelihood(docs, rows, empty):
    got = {r.doc_id: r for r in lmscore.log_likelihood(docs).collect()}
    said = {i: [w for w in (t or "").encode().lower().split()] + [b"\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in said}
    c = Counter(w for i in said if not held[i] for w in said[i])
    n, v = sum(c.values()), len(c)
    want = lattice_scores(rows, held)
    assert len(got) == len(rows)
    for i, w in said.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(want[i], rel=1e-9)
    copies = {}
    for i, t in rows:
        assert copies.setdefault(t or "", got[i].score) == got[i].score
    assert lmscore.log_likelihood(empty).count() == 0


def test_lattice_sums_all_segmentations():
    path = lmscore.vocabulary_path()
    size = lmscore.processor(path).get_piece_size()
    rng = np.random.default_rng(1)
    lattice = lmscore.Lattice(path, np.log(rng.dirichlet(np.ones(size))))

    def total(text):
        if not text:
            return 1.0
        out = sum(math.exp(p) * total(text[k:]) for k in range(1, len(text) + 1) if (p := lattice.known.get(text[:k])) is not None)
        if lattice.known.get(text[0]) is None:
            out += math.exp(sum(lattice.bytes[b] for b in text[0].encode())) * total(text[1:])
        return out

    for word in ("the", "thing", "éau", "x", "\U0001f9ff", "a\U0001f9ffb", "restor"):
        assert lattice.log_prob(word) == pytest.approx(math.log(total(lmscore.MARK + word)))
    assert lattice.log_prob("x" * 5000) < lattice.log_prob("x" * 4000) < 0


def test_only_empty_texts(spark):
    """Null ids, null and empty texts alone, and repeated rows."""
    held = spark.createDataFrame([(None, None, 0), (1, "", None), (1, "", None), (2, None, 3), (None, "a b", 3)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, "a b"), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert pii.find_spans(held).count() == 5
    assert [r.n_removed for r in substring.remove_repeats(held).collect()] == [0] * 5
    assert {r.component_id for r in simhash.near_duplicates(held).where("fp = 0").collect()} == {1}
    assert quality.score(held, quality.train(held, labels)).where("score between 0 and 1").count() == 5
    assert lines.remove_lines(held).count() == 5
    assert tokens.token_files(held).count() == 5
    assert packing.pack(held).where("length = 1").count() == 4
    assert rules.judge(held).where("rules.base_failed").count() == 5
    assert decontam.phrase_matches(held, bench).where("size(hits) > 0").count() == 1
    assert lmscore.log_likelihood(held).where("n_tokens = 1").count() == 4
