"""Fusion of passages and consolidation against a plain version, ties and odd rows included."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fusion

SCHEMA = "parent string, chunk string, ordinal long, section long, start long, end long, text string, protected boolean, seq long"
NONE = 10**9


def lanes(seed):
    rng = random.Random(seed)
    pool = [(f"p{i // 6}", f"c{i}", i % 6, (i % 6) // 3, 10 * (i % 6), 10 * (i % 6) + rng.choice([8, 10, 14]), i // 6 == 4) for i in range(48)]
    text = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    pool = [(*p[:6], text(p[5] - p[4]), p[6]) for p in pool]
    whole = [(f"p{i}", None, None, None, None, None, f"all of p{i}", i % 5 == 4) for i in range(12)]
    lexical = [(*r, i) for i, r in enumerate(rng.choices(whole + pool[:20], k=25))] + [(None, None, None, None, None, None, "lost", True, 99)]
    semantic = [(*r, i) for i, r in enumerate(rng.choices(pool, k=40))]
    return lexical, semantic


def order(r):
    ranks = [r["lex"] or NONE, r["sem"] or NONE]
    return (-r["score"], not r["protected"], min(ranks), *ranks, r["parent"], r["chunk"] or "")


def plainly(lexical, semantic, depth, budget, window):
    def unique(rows):
        seen, out = set(), []
        for r in rows:
            if r[0] is not None and (r[0], r[1]) not in seen and len(out) < depth:
                seen.add((r[0], r[1]))
                out.append(r)
        return out

    found = {}
    for rank, r in enumerate(unique(lexical), 1):
        found[r[0], r[1]] = dict(parent=r[0], chunk=r[1], ordinal=r[2], section=r[3], a=r[4], b=r[5], t=r[6], protected=r[7], lex=rank, sem=None)
    for rank, r in enumerate(unique(semantic), 1):
        new = dict(parent=r[0], chunk=r[1], ordinal=r[2], section=r[3], a=r[4], b=r[5], t=r[6], protected=r[7], lex=None, sem=rank)
        if (r[0], r[1]) in found:
            found[r[0], r[1]]["sem"] = rank
            found[r[0], r[1]]["protected"] |= r[7]
            continue
        if (r[0], None) in found:
            old = found.pop((r[0], None))
            new |= {"lex": old["lex"], "protected": r[7] or old["protected"]}
        found[r[0], r[1]] = new
    rows = list(found.values())
    for r in rows:
        r["score"] = (1 / (60 + r["lex"]) if r["lex"] else 0) + (1 / (60 + r["sem"]) if r["sem"] else 0)
    rows.sort(key=order)

    def joined(group):
        out, reach = "", None
        for g in sorted(group, key=lambda g: (g["a"], g["chunk"])):
            if reach is not None and g["a"] > reach:
                out += "\n"
            out += g["t"][max(0, (reach if reach is not None else -1) - g["a"]) :]
            reach = max(reach if reach is not None else -1, g["b"])
        return out

    out = []
    for parent in dict.fromkeys(r["parent"] for r in rows):
        group = [r for r in rows if r["parent"] == parent]
        lead, rest = group[0], group[1:]
        if lead["chunk"] is None:
            out.append(lead | {"chunks": []})
            continue
        most = len(group) if any(r["protected"] for r in group) else 3
        near = []
        for want in (lead["ordinal"] - 1, lead["ordinal"] + 1):
            near += [r for r in rest if r["chunk"] and r["ordinal"] == want and r["section"] == lead["section"]][:1]
        same = lambda r: r["chunk"] is not None and r["section"] == lead["section"]
        chosen = [*near, *(r for r in rest if same(r) and r not in near), *(r for r in rest if not same(r))][: most - 1]
        held = [lead]
        for r in chosen:
            if r in near and (not budget or len(joined([*held, r])) <= budget):
                held.append(r)
            else:
                out.append(r | {"chunks": [r["chunk"]] if r["chunk"] else []})
        held.sort(key=lambda g: (g["a"], g["chunk"]))
        out.append(lead | {"t": joined(held) if len(held) > 1 else lead["t"], "a": held[0]["a"], "b": held[-1]["b"], "chunks": [g["chunk"] for g in held]})
    out.sort(key=order)
    kept, late = out[:window], [r for r in out[window:] if r["protected"]]
    for r in late:
        free = [i for i, x in enumerate(kept) if not x["protected"]]
        if free:
            kept[free[-1]] = r
    return [(r["parent"], r["chunk"], r["a"], r["b"], r["t"], r["lex"], r["sem"], r["protected"], tuple(r["chunks"])) for r in sorted(kept, key=order)]


@pytest.mark.parametrize("seed", range(6))
def test_consolidation(spark, seed):
    lexical, semantic = lanes(seed)
    depth, budget, window = [(50, 0, 40), (50, 22, 40), (12, 18, 9)][seed % 3]
    a, b = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (lexical, semantic))
    found = fusion.retained(fusion.consolidated(fusion.fused_passages(a, b, depth), budget), window)
    got = [(r.parent, r.chunk, r.start, r.end, r.text, r.lexical_rank, r.semantic_rank, r.protected, tuple(r.chunks)) for r in found.collect()]
    assert got == plainly(lexical, semantic, depth, budget, window)


def test_empty_lanes(spark):
    lexical, semantic = lanes(1)
    none, a, b = spark.createDataFrame([], SCHEMA), spark.createDataFrame(lexical, SCHEMA), spark.createDataFrame(semantic, SCHEMA)
    assert fusion.consolidated(fusion.fused_passages(none, none), 100).count() == 0
    assert [r.parent for r in fusion.retained(fusion.consolidated(fusion.fused_passages(a, none), 0), 5).collect()] == [r[0] for r in plainly(lexical, [], 50, 0, 5)]
    assert fusion.fused_passages(none, b).where("lexical_rank is not null").count() == 0


def test_window_hash(spark):
    number = lambda n: struct.pack(">Q", n)
    field = lambda v: number(len(v.encode())) + v.encode()
    for ids, hashes, excerpt in ((["a", "bé"], ["x", ""], "text"), ([], [], "")):
        raw = number(len(ids)) + b"".join(map(field, ids)) + number(len(hashes)) + b"".join(map(field, hashes)) + field(excerpt)
        row = spark.createDataFrame([(ids, hashes, excerpt)], "ids array<string>, hashes array<string>, excerpt string")
        assert row.select(fusion.window_hash(F.col("ids"), F.col("hashes"), F.col("excerpt"))).first()[0] == hashlib.sha256(raw).hexdigest()
