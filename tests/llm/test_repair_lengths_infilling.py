"""Conversation repair, token counts and infilling against plain versions."""

import hashlib
import heapq
import random
import zlib
from itertools import count

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversations as C
from lodestone.llm import infilling, lengths, tokens

WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11: cheapest edits by search over single edits, in order of cost and then of the edits


def by_search(rows):
    """(cost, audit, repaired) of rows (role, text, fault)."""
    tick, seen = count(), set()
    queue = [(0, "", next(tick), 0, "", ())]
    while queue:
        cost, audit, _, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        if (i, state, audit) in seen or len(audit) > 3 * len(rows) + 4:
            continue
        seen.add((i, state, audit))
        legal = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[state]
        name = "assistant" if state == "u" else "user"
        more = [(2, "I", i, name[0], ((name, ""),))] if not audit.endswith("III") else []
        if i < len(rows):
            role, text, fault = rows[i]
            more.append((3, "D", i + 1, state, ()))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] in legal:
                    more.append((late, "K", i + 1, role[:1], ((role, text),)))
                more.append((2 + late, "R", i + 1, name[0], ((name, text),)))
        for c, e, j, s, o in more:
            heapq.heappush(queue, (cost + c, audit + e, next(tick), j, s, out + o))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plainly(table):
    groups = {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        groups[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        turns = [t for t, _, _ in rows if t is not None]
        found = faults([r[1:] for r in rows])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, kept = by_search([(r, t, f) for (_, r, t), f in zip(rows, found)])
        out[conv] = (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept)))
    return out


def chats(seed=5, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "x\x85.", "Ünder!", None, "long " * 40]
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    table = []
    for conv in range(n):
        turn = rng.choice([0, 5, -3])
        for _ in range(rng.randint(1, 7)):
            table.append((conv, None if rng.random() < 0.1 else turn, rng.choices(roles, [9, 9, 3, 1, 1, 1, 1])[0], rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 2])
    table += [(None, None, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), (99, 2, "user", "?")] + [(100, 7, "user", "Same.")] * 9
    return table


SCHEMA = "conv_id long, turn long, role string, text string"


def audits(spark, table, **sizes):
    df = spark.createDataFrame([(*r, 1, "c") for r in table], SCHEMA + ", seq int, cost string").repartition(5)
    found, rows = C.repair(C.damaged(df), **sizes)
    return {r.conv_id: tuple(r)[1:] for r in C.with_all(found, df).collect()}, rows


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "fan": 2}])
def test_repair(spark, sizes):
    table = chats()
    got, rows = audits(spark, table, **sizes)
    assert got == plainly(table)
    assert rows.where("role is null or text is null").count() == 0


def test_repair_of_a_long_conversation(spark):
    """One conversation holds nearly all rows: blocks, levels and several parts give what one block gives."""
    rng = random.Random(3)
    table = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"Text {t}.", f"text {t}", "Again."])) for t in range(900)] + [(2, 0, "user", "Hi.")]
    got, rows = audits(spark, table, block=4, fan=3)
    want, _ = audits(spark, table, block=200, fan=64)
    assert got == want
    assert rows.where("conv_id = 1").select("part").distinct().count() > 1
    by_place = [r for r in rows.orderBy("part", "seq", "place").collect() if r.conv_id == 1]
    assert [r.role for r in by_place] == ["user", "assistant"] * (len(by_place) // 2)
    assert sha("\n".join(f"{r.role}:{r.text}" for r in by_place)) == got[1][-1]
    kept = {r.text for r in by_place}
    assert kept <= {t for _, _, _, t in table} | {t.replace(".", "") for _, _, _, t in table} | {""}


def test_repair_of_nothing(spark):
    got, rows = audits(spark, [])
    assert got == {} and rows.count() == 0
    zero = (0, 0, 0, 0, 0, 0, "", sha(""))
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert audits(spark, [(7, gone, "user", "Hi.")])[0] == {7: zero}


def test_each_signature_is_solved_by_itself(spark):
    """Blocks against the search, ends of all states included."""
    rng = random.Random(8)
    for _ in range(150):
        letters = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(1, 6)))
        costs, ranks, edits = C.solve(letters)
        cost, end = C.finish(costs, ranks)
        rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], "", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in letters]
        want = by_search(rows)
        assert (cost, edits[end] + C.ENDING[end]) == want[:2]


# 12


@pytest.mark.parametrize("part_bytes", [1 << 16, 40])
def test_token_counts(docs, rows, empty, part_bytes):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path())
    got = {r.doc_id: r for r in lengths.token_counts(docs, part_bytes=part_bytes, batch_bytes=3000, limit=50).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 50)
    assert lengths.token_counts(empty).count() == 0


ODD = ["<|endoftext|> a <|endoftext|>b c", "a <|endoftext |> b", "É É é x ́y", "don't we'll DON'T 12 345a", "a  b   c\n\nd \t e", "日本語 テキスト x y", "a.b a. b a, b a! b", "İ İ ß ẞ", "x" * 300, "▁a ▁ b"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_parts_of_texts_add_up(name):
    """Every public tokenizer, cut at every safe place."""
    path = tokens.tokenizer_path(name)
    counter = lengths.Counter(path)
    assert not counter.whole
    if name.endswith("json"):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    else:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(ODD + ["the", "end.", "of", "a,", "Zwölf", "9"]) for _ in range(30)) for _ in range(80)]
    for most in (1, 17, 1 << 16):
        assert counter.count([t.encode() for t in texts], most, 500).tolist() == [count(t) for t in texts]


# 13


def plain_infilling(doc_id, text, seed=1):
    text = text or ""
    n, digest = len(text), sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in infilling.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("giant", [16 << 20, 100, 0])
def test_infilling(spark, docs, rows, empty, giant):
    """Both ways, the one for giant texts with parts of 64 bytes and chunks of 7."""
    odd = [(None, "null id €"), (None, None), (4, "a <P> b"), (5, "<S"), (6, "<<M>>"), (7, "𝔘𝔫𝔦 <" * 50), (7, "𝔘𝔫𝔦 <" * 50), (7, "other" * 40), (8, "<" * 200 + "P" + ">")]
    table = [(i, t, "en") for i, t in [*rows, *odd]]
    df = spark.createDataFrame(table, "doc_id long, text string, low string").repartition(3)
    found = infilling.fill_in_middle(df, giant=giant, part_bytes=64, chunk=7)
    assert found.columns == [*df.columns, "fim"]
    got = sorted(map(repr, ((r.doc_id, r.text, tuple(r.fim)) for r in found.collect())))
    assert got == sorted(map(repr, ((i, t, plain_infilling(i, t)) for i, t, _ in table)))
    back = found.select("text", infilling.restored(F.col("fim.output"), F.col("fim.form")).alias("back"))
    assert back.where("back <> coalesce(text, '')").count() == 0
    assert infilling.fill_in_middle(empty, giant=giant).count() == 0


def test_infilling_by_words(spark, docs, rows):
    """Another automaton: cuts stand where words begin."""
    found = infilling.fill_in_middle(docs, units=infilling.Automaton.words(), chunk=5, percent=100)
    for r in found.collect():
        text, f = r.text or "", r.fim
        assert f.n == len(text.encode().split())
        if f.form == "psm":
            assert len(f.output[3 : f.output.index("<S>")].encode().split()) == f.prefix_units


def test_functions_of_chunks_compose():
    """Any cut into chunks gives the states and counts of one run."""
    rng = np.random.default_rng(4)
    automaton = infilling.Automaton.words().beside(infilling.Automaton.occurrences(infilling.MARKERS))
    data = rng.choice(np.frombuffer(b"<PSM> ab", np.uint8), 3000)
    offsets = np.array([0, 0, 10, 1500, 1500, 3000])
    want = infilling.Scan(automaton, data, offsets, 4000)
    for chunk in (1, 3, 64):
        got = infilling.Scan(automaton, data, offsets, chunk)
        assert (got.exits == want.exits).all() and (got.counts == want.counts).all()
