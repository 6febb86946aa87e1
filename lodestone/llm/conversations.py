"""Conversation repair: each distinct sequence of roles and faults is solved once.

Rows become letters: x must go (blank or said before); s, u, a by the role's initial and o for others, capitals where the text is
truncated. The rows of a conversation, in order, are a string of letters, cut into blocks. Each distinct block is solved once by memoised
recursion, for every state in which it may begin and end. Answers of blocks compose associatively, so that a conversation of any number
of rows is put together level by level, `fan` pieces at a time, and the choice goes back down the same way. Texts move only when the edits
are known: they join the rows that stay, and are hashed in order.

The states are those of the wanted sequence (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise, small

WHITE = " \t\n\x0b\x0c\r"
#: State after each letter that is kept; others cannot be kept there.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: State and role after an inserted or reroled row.
GIVEN = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What is inserted at the end, by state.
ENDING = {0: "", 1: "II", 2: "I", 3: ""}
LEGAL = ("su", "ua", "au")


@cache
def _from(letters: str, state: int) -> dict[int, tuple[int, str]]:
    """End state -> (cost, edits): the cheapest edits of a short string, least on ties. Inserts stand before the row they precede."""
    if not letters:
        return {state: (0, "")}
    out: dict[int, tuple[int, str]] = {}

    def offer(now: int, cost: int, edits: str) -> None:
        for end, (more, rest) in _from(letters[1:], now).items():
            found = (cost + more, edits + rest)
            if end not in out or found < out[end]:
                out[end] = found

    letter, late = letters[0].lower(), TRUNCATED if letters[0].isupper() else 0
    at = state
    for n in range(3):  # a third insert would only lead back
        lead, cost = "I" * n, INSERT * n
        offer(at, cost + DELETE, lead + "D")
        if letter != "x":
            if (at, letter) in KEEP:
                offer(KEEP[at, letter], cost + late, lead + "K")
            offer(GIVEN[at][0], cost + late + REROLE, lead + "R")
        at = GIVEN[at][0]
    return out


def solve(letters: str) -> tuple[list[int], list[int], list[str]]:
    """(costs, ranks, edits), 16 of each, by state before and state after: cost -1 where there is no way; ranks order the edits of one state before.

    Edits of a block end with a row's, so none is the beginning of another: comparing blocks in order compares whole conversations.
    """
    _from.cache_clear()  # holds what one block needs
    costs, ranks, edits = [], [], []
    for state in range(4):
        found = _from(letters, state)
        order = sorted(e for _, e in found.values())
        for end in range(4):
            cost, way = found.get(end, (-1, ""))
            costs.append(cost)
            ranks.append(order.index(way) if cost >= 0 else -1)
            edits.append(way)
    return costs, ranks, edits


def compose(parts: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int], list[str]]:
    """(costs, ranks, paths) of pieces in a row; a path lists the state after each piece."""
    best = [{end: (0, (), "")} for end in range(4)]  # state -> end -> (cost, ranks in order, path)
    for costs, ranks in reversed(parts):
        now: list[dict] = []
        for state in range(4):
            out: dict[int, tuple] = {}
            for mid in range(4):
                if (cost := costs[4 * state + mid]) >= 0:
                    for end, (more, rest, path) in best[mid].items():
                        found = (cost + more, (ranks[4 * state + mid], *rest), f"{mid}{path}")
                        if end not in out or found < out[end]:
                            out[end] = found
            now.append(out)
        best = now
    out_costs, out_ranks, paths = [], [], []
    for state in range(4):
        order = sorted(r for _, r, _ in best[state].values())
        for end in range(4):
            cost, rank, path = best[state].get(end, (-1, (), ""))
            out_costs.append(cost)
            out_ranks.append(order.index(rank) if cost >= 0 else -1)
            paths.append(path)
    return out_costs, out_ranks, paths


def finish(costs: list[int], ranks: list[int]) -> tuple[int, int]:
    """(cost, last state) of a whole conversation, the inserts at its end included."""
    cost, _, end = min((costs[e] + INSERT * len(ENDING[e]), ranks[e], e) for e in range(4) if costs[e] >= 0)
    return cost, end


def replay(letters: str, state: int, edits: str) -> list[tuple[int, str | None, int]]:
    """(place in the block, given role or None, which row that may stay, -1 for an inserted one) of each row of the result."""
    out, row, held = [], 0, 0
    for place, edit in enumerate(edits):
        if edit == "I":
            state, role = GIVEN[state]
            out.append((place, role, -1))
            continue
        letter = letters[row].lower()
        if edit == "K":
            state = KEEP[state, letter]
            out.append((place, None, held))
        elif edit == "R":
            state, role = GIVEN[state]
            out.append((place, role, held))
        held += letter != "x"
        row += 1
    return out


def _plain(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32 of conv_id:turn modulo 20; nulls count as one space. 0 drops a row, 1 empties its text, 2 removes full stops, question and exclamation marks, 3 repeats it, 4 makes it a user's."""
    kind = F.crc32(F.concat(_plain("conv_id"), F.lit(":"), _plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_plain("text"), ".!?", "")).otherwise(_plain("text"))
    role = F.when(kind == 4, "user").otherwise(_plain("role"))
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def skeleton(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, dig, fault, copies): distinct rows without their texts, which their digests name; fault is of the text alone: blank, truncated or empty."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", "blank").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    keyed = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("dig"), fault.alias("fault"), "copies")
    return keyed.groupBy("conv_id", "turn", "role", "dig", "fault").agg(F.sum("copies").alias("copies"))


def meet(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`a` joined to the other columns of `b` on keys, null equal to null."""
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(other, same, how).drop(*(f"_{k}" for k in keys))


def marked(rows: DataFrame) -> DataFrame:
    """The skeleton with `fresh`: the first row of its conversation that says this in this role. First turns are aggregates; rows meet them by their whole keys, of which each is one row."""
    said = rows.groupBy("conv_id", "role", "dig").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"))
    said = said.select("conv_id", "role", "dig", F.when(~F.col("none"), F.col("least")).alias("turn"), F.lit(True).alias("fresh"))
    return meet(rows, said, ["conv_id", "turn", "role", "dig"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


def statistics(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated)."""
    copies, blank, fresh = F.col("copies"), F.col("fault") == "blank", F.col("fresh")
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    counts = [
        total(F.when(blank, copies).otherwise(0), "blank"),
        total(F.when(~blank, copies - fresh.cast("long")).otherwise(0), "duplicate"),
        total(F.when(fresh & (F.col("fault") == "truncated"), 1).otherwise(0), "truncated"),
    ]
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    sums = rows.groupBy("conv_id").agg(*counts)
    return meet(sums, turns, ["conv_id"]).select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated")


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, part, seq, letters, first, last, illegal, held): at most `block` letters each, in order of part and seq; held has the keys of rows that may stay.

    Rows are ordered over all tasks by conversation, turn (nulls first), role and digest, so that a conversation of any size is spread; part is the task.
    """
    schema, order = rows.schema, ["conv_id", "turn", "role", "dig"]
    kinds = {c: schema[c].dataType.simpleString() for c in order}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    letter = F.when((F.col("fault") == "blank") | ~F.col("fresh"), "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    ranged = rows.select(*order, initial.alias("initial"), letter.alias("letter"), "copies").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = ["conv_id", "part", "seq", "letters", "first", "last", "illegal", "held"]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        done: list[tuple] = []
        now: list | None = None  # conv_id, seq, letters, first, last, illegal, held

        def close() -> None:
            nonlocal now
            if now and now[2]:
                done.append((now[0], part, now[1], now[2], now[3], now[4], now[5], now[6]))

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 8, types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        types = None
        for b in batches:
            types = [b.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([(c, b.schema.field(c).type) for c in order[1:]]))]
            for conv, turn, role, dig, head, mark, copies in zip(*(b.column(i).to_pylist() for i in range(7))):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, "", head, "", 0, []]
                first = True
                while copies:
                    if len(now[2]) == block:
                        close()
                        now = [conv, now[1] + 1, "", head, "", 0, []]
                    take = min(copies, block - len(now[2]))
                    now[5] += (take - 1) + (bool(now[2]) and now[4] + head not in LEGAL)
                    now[2] += (mark if first else "x") + "x" * (take - 1)
                    now[4] = head
                    if first and mark != "x":
                        now[6].append({"turn": turn, "role": role, "dig": dig})
                    first, copies = False, copies - take
                if len(done) >= 4096:
                    yield batch()
        close()
        if types and done:
            yield batch()

    return ranged.mapInArrow(run, f"conv_id {kinds['conv_id']}, part int, seq long, letters string, first string, last string, illegal long, held array<struct<turn:{kinds['turn']},role:string,dig:string>>")


def solutions(cut: DataFrame) -> DataFrame:
    """(signature, costs, ranks, edits) of each distinct block."""

    def run(batches):
        for batch in batches:
            letters = batch.column(0).to_pylist()
            columns = list(zip(*map(solve, letters))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string())))], names=["signature", "costs", "ranks", "edits"])

    one = cut.select(F.col("letters").alias("signature")).distinct()
    return one.mapInArrow(run, "signature string, costs array<int>, ranks array<int>, edits array<string>")


def _pieces(level: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of a level put together by keys: costs, ranks, paths, first, last, illegal, kids (part and seq of each, in order)."""
    fields = ["part", "seq", "costs", "ranks", "first", "last", "illegal"]
    listed = level.groupBy(*(F.expr(k) for k in keys)).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in fields)))).alias("l"))
    kept = [k.split(" AS ")[-1] for k in keys]
    held = listed.select(*kept, F.transform("l", lambda x: F.struct(x["part"].alias("part"), x["seq"].alias("seq"))).alias("kids"), "l")
    kind = {f.name: f.dataType.simpleString() for f in held.schema}

    def run(batches):
        for batch in batches:
            found = []
            for rows in batch.column("l").to_pylist():
                costs, ranks, paths = compose([(r["costs"], r["ranks"]) for r in rows])
                seams = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
                found.append((costs, ranks, paths, rows[0]["first"], rows[-1]["last"], sum(r["illegal"] for r in rows) + seams, *finish(costs, ranks)))
            types = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 8, types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*kept, "kids")), *columns], names=[*kept, "kids", "costs", "ranks", "paths", "first", "last", "illegal", "cost", "end"])

    same = ", ".join(f"{c} {kind[c]}" for c in (*kept, "kids"))
    return held.mapInArrow(run, f"{same}, costs array<int>, ranks array<int>, paths array<string>, first string, last string, illegal long, cost long, end int")


def _down(pieces: DataFrame, state: Column, end: Column) -> DataFrame:
    """(conv_id, part, seq, state, end) of the kids of pieces that begin and end in these states."""
    path = F.element_at("paths", (4 * state + end + 1).cast("int"))
    one = lambda i: F.substring(path, i, F.lit(1)).cast("int")
    kids = F.transform("kids", lambda k, i: F.struct(k["part"].alias("part"), k["seq"].alias("seq"), F.when(i == 0, state).otherwise(one(i)).cast("int").alias("state"), one(i + 1).alias("end")))
    return pieces.select("conv_id", F.inline(kids))


def edited(cut: DataFrame, fan: int = 64) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (conv_id, part, seq, parts, state, edits, letters, held) of each block, and (conv_id, cost, illegal, end, parts, last_part) of each conversation.

    Pieces of one task's part of a conversation meet `fan` at a time; then those of its parts, of which there are as many as tasks at most.
    """
    key = ["conv_id", "part", "seq"]
    known = small(materialise(solutions(cut), "signatures"))
    solved = materialise(cut.join(known, cut["letters"] == known["signature"]).drop("signature"), "solved")
    levels, level = [], solved
    while level.where("seq > 0").limit(1).count():
        level = materialise(_pieces(level, ["conv_id", "part", f"seq div {fan} AS seq"]), "pieces")
        levels.append(level)
    whole = materialise(_pieces(level, ["conv_id"]), "conversations")
    states = _down(whole, F.lit(0), F.col("end"))
    for pieces in reversed(levels):
        states = _down(meet(pieces.drop("cost", "end"), states, key), F.col("state"), F.col("end"))
    way = F.element_at("edits", (4 * F.col("state") + F.col("end") + 1).cast("int")).alias("edits")
    ends = whole.select("conv_id", "cost", "illegal", "end", F.size(F.array_distinct(F.transform("kids", lambda k: k["part"]))).alias("parts"), F.element_at("kids", -1)["part"].alias("last_part"))
    each = meet(meet(solved, states, key), ends.select("conv_id", "parts"), ["conv_id"])
    return materialise(each.select(*key, "parts", "state", way, "letters", "held"), "edits"), ends


def audits(each: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, audit): the edits in order, a letter each. The value itself grows with its conversation."""
    listed = F.array_sort(F.collect_list(F.struct("part", "seq", "edits")))
    joined = each.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["edits"]), "").alias("edits"))
    last = F.element_at(F.array(*(F.lit(ENDING[e]) for e in range(4))), F.col("end") + 1)
    return meet(joined, ends, ["conv_id"]).select("conv_id", F.concat("edits", last).alias("audit"))


def repaired_rows(rows: DataFrame, each: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, part, seq, place, parts, role, text): the repaired conversations, in order of part, seq and place."""
    kind = {f.name: f.dataType.simpleString() for f in each.schema}

    def run(batches):
        for batch in batches:
            found = [replay(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("letters", "state", "edits")))]
            item = pa.struct([("place", pa.int32()), ("given", pa.string()), ("row", pa.int32())])
            items = pa.array([[{"place": p, "given": g, "row": r} for p, g, r in f] for f in found], pa.list_(item))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "seq", "parts", "held")), items], names=["conv_id", "part", "seq", "parts", "held", "items"])

    steps = each.mapInArrow(run, f"conv_id {kind['conv_id']}, part int, seq long, parts int, held {kind['held']}, items array<struct<place:int,given:string,row:int>>")
    steps = steps.select("conv_id", "part", "seq", "parts", "held", F.explode("items").alias("i"))
    steps = steps.select("conv_id", "part", "seq", "parts", "i.place", "i.given", F.when(F.col("i.row") >= 0, F.get("held", F.col("i.row"))).alias("k"))
    wanted = steps.where("k is not null").select("conv_id", "part", "seq", "parts", "place", "given", "k.turn", "k.role", "k.dig")
    texts = rows.withColumn("dig", F.sha2("text", 256)).groupBy("conv_id", "turn", "role", "dig").agg(F.first("text").alias("text"))
    kept = meet(wanted, texts, ["conv_id", "turn", "role", "dig"]).select("conv_id", "part", "seq", "place", "parts", F.coalesce("given", "role").alias("role"), "text")
    added = steps.where("k is null").select("conv_id", "part", "seq", "place", "parts", F.col("given").alias("role"), F.lit("").alias("text"))
    after = F.array(*(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(role).alias("role")) for i, role in enumerate(roles))) for roles in (["user"], ["user", "assistant"], ["assistant"], ["user"])))
    tail = ends.where("end in (1, 2)").select("conv_id", F.col("last_part").alias("part"), F.lit(2**62).alias("seq"), "parts", F.inline(F.element_at(after, F.col("end") + 1)))
    return kept.unionByName(added).unionByName(tail.withColumn("text", F.lit("")))


def digests(rows: DataFrame, blob_bytes: int = 1 << 20) -> DataFrame:
    """(conv_id, sha256 of the rows as role:text, joined by line breaks).

    A part of a conversation is written out in one task, in order, and hashed there if it is the only part. Else it gives blobs, and
    the few large rows are hashed in their order, as SHA-256 needs it; nothing holds more than a blob.
    """
    kind, parts = rows.schema["conv_id"].dataType.simpleString(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "part", "seq", "place"]
    line = F.concat("role", F.lit(":"), "text").alias("line")
    dealt = bounded(rows).select(*order, "parts", line).repartition(parts, "conv_id", "part").sortWithinPartitions(*order)
    names = ["conv_id", "sha256", "part", "nth", "blob"]

    def run(batches):
        conv_type, out, size = None, [], 0
        now: tuple | None = None  # conv_id, part
        single, digest, held, held_bytes, nth = True, None, [], 0, 0

        def close(final: bool) -> None:
            nonlocal held, held_bytes, nth
            if single and final:
                out.append((now[0], digest.hexdigest(), None, None, None))
            elif not single and held:
                out.append((now[0], None, now[1], nth, b"\n".join(held)))
                held, held_bytes, nth = [], 0, nth + 1

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, [conv_type, pa.string(), pa.int32(), pa.int32(), pa.binary()])]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            conv_type = b.schema.field("conv_id").type
            for conv, part, many, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "parts", "line"))):
                raw = text.encode()
                if now != (conv, part):
                    if now:
                        close(True)
                    now, single, digest, held, held_bytes, nth = (conv, part), many == 1, hashlib.sha256(raw), [], 0, 0
                elif single:
                    digest.update(b"\n" + raw)
                if not single:
                    held.append(raw)
                    held_bytes += len(raw)
                    if held_bytes >= blob_bytes:
                        close(False)
                size += len(raw)
                if size >= 4 << 20 or len(out) >= 4096:
                    yield batch()
                    size = 0
        if now:
            close(True)
            yield batch()

    found = materialise(dealt.mapInArrow(run, f"conv_id {kind}, sha256 string, part int, nth int, blob binary"), "digests")
    blobs = bounded(found).where("blob is not null").select("conv_id", "part", "nth", "blob").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "nth")

    def chain(batches):
        conv_type, out, now, digest = None, [], None, None
        for b in batches:
            conv_type = b.schema.field("conv_id").type
            for conv, blob in zip(b.column("conv_id").to_pylist(), b.column("blob")):
                if now is None or now[0] != conv:
                    if now:
                        out.append((now[0], digest.hexdigest()))
                    now, digest = (conv,), hashlib.sha256(blob.as_py())
                else:
                    digest.update(b"\n" + blob.as_py())
        if now:
            out.append((now[0], digest.hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], conv_type), pa.array(columns[1])], names=["conv_id", "sha256"])

    return found.where("blob is null").select("conv_id", "sha256").unionByName(blobs.mapInArrow(chain, f"conv_id {kind}, sha256 string"))


def repair(rows: DataFrame, block: int = 64, fan: int = 64) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of rows (conv_id, turn, role, text, copies; other columns are not read; null role or text must be filled before).

    Audits have conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, a row for each conv_id, null included. Rows of one turn
    stand by role and then by the digest of their text; null turns come first. Equal rows are copies of one another, all but the first duplicates.
    An empty table gives empty tables; a conversation of which all rows go has an empty audit of deletions and the hash of empty text.
    """
    flagged = materialise(marked(materialise(skeleton(rows), "skeleton")), "marked")
    cut = materialise(blocks(flagged, block), "blocks")
    each, ends = edited(cut, fan)
    stats, said = statistics(flagged), audits(each, ends)
    out = repaired_rows(rows, each, ends)
    hashes = digests(out)
    found = meet(meet(stats, ends.select("conv_id", "illegal", "cost"), ["conv_id"]), said, ["conv_id"])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    found = meet(found, hashes.withColumnRenamed("sha256", "repaired_sha256"), ["conv_id"], "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing))
    return found, out


def with_all(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """Audits of every conv_id of `conversations`; those without rows have zeros, an empty audit and the hash of empty text."""
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    fill = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    columns = [F.coalesce(c, F.lit(fill.get(c, 0)).cast(found.schema[c].dataType)).alias(c) for c in found.columns if c != "conv_id"]
    return ids.join(found, ids["_id"].eqNullSafe(found["conv_id"]), "left").select(F.col("_id").alias("conv_id"), *columns)
