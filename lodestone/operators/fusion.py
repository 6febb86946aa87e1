"""Fusion of ranked lanes and consolidation of passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def reciprocal_rank(lanes: dict[str, tuple[DataFrame, float]], key: str, window: int = 20, k: int = K) -> DataFrame:
    """Fuse lanes (key, rank): score = sum of weight / (k + rank). Ties: best rank, then lane ranks in order (absent last), then key.

    Lanes are bounded by their depth, so the full outer join and the final sort are small whatever the corpus.
    """
    fused = None
    for name, (lane, _) in lanes.items():
        ranked = lane.select(key, F.col("rank").alias(f"{name}_rank"))
        fused = ranked if fused is None else fused.join(ranked, key, "full_outer")
    return fused_ranks(fused.withColumnsRenamed({f"{n}_rank": n for n in lanes}), {n: w for n, (_, w) in lanes.items()}, key, window, k)


def fused_ranks(wide: DataFrame, weights: dict[str, float], key: str, window: int = 20, k: int = K) -> DataFrame:
    """The same for rows (key, a rank for each lane, null where it has none); ranks are named lane_rank then."""
    score, worst = F.lit(0.0), F.lit(2**31 - 1)
    ranks = [F.coalesce(F.col(f"{n}_rank").cast("int"), worst) for n in weights]
    for name, weight in weights.items():
        score = score + F.coalesce(F.lit(float(weight)) / (k + F.col(f"{name}_rank")), F.lit(0.0))
    best = F.least(*ranks) if len(ranks) > 1 else ranks[0]
    order = [F.desc("score"), best.asc(), *(r.asc() for r in ranks), F.asc(key)]
    return wide.select(key, *(F.col(n).alias(f"{n}_rank") for n in weights)).withColumn("score", score).orderBy(*order).limit(window)


def joined(passages: Column) -> Column:
    """One excerpt of sorted passages (structs a, b, t: start, end, text): overlaps once, a line break at gaps."""
    zero = F.struct(F.lit("").alias("out"), F.lit(-1).cast("long").alias("reach"))

    def step(acc: Column, x: Column) -> Column:
        skip = F.greatest(acc["reach"] - x["a"], F.lit(0)).cast("int")
        gap = F.when((acc["reach"] >= 0) & (x["a"] > acc["reach"]), F.lit("\n")).otherwise("")
        return F.struct(F.concat(acc["out"], gap, F.substring(x["t"], skip + 1, F.length(x["t"]))).alias("out"), F.greatest(acc["reach"], x["b"].cast("long")).alias("reach"))

    return F.aggregate(passages, zero, step, lambda acc: acc["out"])


def joined_excerpts(chunks: DataFrame, group: str, start: str, end: str, text: str, budget: int) -> DataFrame:
    """(group, excerpt, n): passages of a group in order, joined and cut at the budget.

    A group holds the few passages that a search kept of one parent.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"), F.col(text).alias("t"))))
    return chunks.groupBy(group).agg(ordered.alias("held")).select(group, F.substring(joined(F.col("held")), 1, budget).alias("excerpt"), F.size("held").cast("long").alias("n"))


def window_hash(ids: Column, hashes: Column, excerpt: Column) -> Column:
    """SHA-256 over both lists, each after its size, and the excerpt; sizes and lengths in eight bytes, big end first."""
    number = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))
    field = lambda v: F.concat(number(F.octet_length(v)), F.encode(v, "utf-8"))
    listed = lambda values: F.aggregate(values, number(F.size(values)), lambda acc, v: F.concat(acc, field(v)))
    return F.sha2(F.concat(listed(ids), listed(hashes), field(excerpt)), 256)


PASSAGE = ["chunk", "ordinal", "section", "start", "end", "text"]


def fused_passages(lexical: DataFrame, semantic: DataFrame, depth: int = 50, weights: tuple[float, float] = (1.0, 1.0), k: int = K) -> DataFrame:
    """One row for each passage that a lane found: parent, PASSAGE, lexical_rank, semantic_rank, protected, score.

    Lanes have parent, PASSAGE, protected and seq (their order); chunk is null for a row that means the parent as a whole. Such a lexical row is taken
    in by the first semantic chunk of its parent that no lexical row names by itself; semantic rows need a chunk. The first `depth` passages of a lane count.
    """
    lanes = []
    for i, (lane, have) in enumerate(((lexical, "parent is not null"), (semantic, "parent is not null and chunk is not null"))):
        once = lane.where(have).withColumn("_n", F.row_number().over(Window.partitionBy("parent", "chunk").orderBy("seq"))).where("_n = 1")
        best = top(once, [F.asc("seq"), F.asc("parent"), F.asc("chunk")], depth)  # `depth` rows from here on
        lanes.append(best.select("parent", *PASSAGE, "protected", F.lit(i).alias("lane"), "rank"))
    rank = lambda i: F.max(F.when(F.col("lane") == i, F.col("rank")))
    fields = [c for c in PASSAGE if c != "chunk"]
    each = lanes[0].unionByName(lanes[1]).groupBy("parent", "chunk").agg(F.min_by(F.struct(*fields), "lane").alias("f"), F.max("protected").alias("protected"), rank(0).alias("lexical_rank"), rank(1).alias("semantic_rank"))
    free, whole, parent = F.expr("semantic_rank is not null and lexical_rank is null"), F.col("chunk").isNull(), Window.partitionBy("parent")
    heir = F.col("semantic_rank").eqNullSafe(F.min(F.when(free, F.col("semantic_rank"))).over(parent)) & free
    given = F.max(F.when(whole, F.struct("lexical_rank", "protected"))).over(parent)
    told = each.withColumn("_heir", heir).withColumn("_given", given)
    told = told.withColumn("_gone", whole & F.max("_heir").over(parent)).where("not _gone")
    own = F.when(F.col("_heir") & F.col("_given").isNotNull(), F.col("_given.lexical_rank")).otherwise(F.col("lexical_rank"))
    guard = F.col("protected") | (F.col("_heir") & F.coalesce(F.col("_given.protected"), F.lit(False)))
    out = told.select("parent", "chunk", "f.*", own.alias("lexical_rank"), "semantic_rank", guard.alias("protected"))
    score = F.coalesce(F.lit(weights[0]) / (k + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(F.lit(weights[1]) / (k + F.col("semantic_rank")), F.lit(0.0))
    return out.withColumn("score", score)


def document_order() -> list[Column]:
    """Score, protected first, best rank, lexical rank, semantic rank (absent last), parent, chunk."""
    last = lambda c: F.coalesce(c, F.lit(2**31 - 1))
    return [F.desc("score"), F.desc("protected"), F.least(last("lexical_rank"), last("semantic_rank")).asc(), last("lexical_rank").asc(), last("semantic_rank").asc(), F.asc("parent"), F.asc_nulls_first("chunk")]


def consolidated(rows: DataFrame, budget: int, most: int = 3) -> DataFrame:
    """Rows of `fused_passages` with at most `most` passages of a parent (all, if one is protected), and chunks: the ids that an excerpt is made of.

    The best row of a parent leads. If it is the parent as a whole, it stands alone. Else the best passages just before and just after it in its section come
    next, then others of its section, then the rest. Neighbours are joined to the leading passage while the excerpt has `budget` characters
    at most (0: no bound); others stand by themselves. Groups are as small as the lanes are deep.
    """
    order, parent = document_order(), Window.partitionBy("parent")
    inside = parent.orderBy(*order)
    lead = F.first(F.struct("chunk", "ordinal", "section")).over(inside)
    led = rows.withColumn("_n", F.row_number().over(inside)).withColumn("_lead", lead).withColumn("_guard", F.max("protected").over(parent))
    fits = F.col("chunk").isNotNull() & F.col("_lead.chunk").isNotNull() & F.col("section").eqNullSafe(F.col("_lead.section")) & (F.col("_n") > 1)
    side = F.when(fits & (F.col("ordinal") == F.col("_lead.ordinal") - 1), 1).when(fits & (F.col("ordinal") == F.col("_lead.ordinal") + 1), 2).otherwise(0)
    beside = led.withColumn("_fits", fits).withColumn("_side", side)
    first = F.row_number().over(Window.partitionBy("parent", "_side").orderBy("_n")) == 1
    kind = F.when(F.col("_n") == 1, 0).when((F.col("_side") > 0) & first, F.col("_side")).when(F.col("_fits"), 3).otherwise(4)
    chosen = beside.withColumn("_kind", kind).withColumn("_place", F.row_number().over(parent.orderBy("_kind", "_n")))
    chosen = chosen.where(F.when(F.col("_lead.chunk").isNull(), F.col("_kind") == 0).otherwise((F.col("_place") <= most) | F.col("_guard")))
    passage = F.struct(F.col("start").alias("a"), F.col("chunk").alias("c"), F.col("end").alias("b"), F.col("text").alias("t"))
    of = lambda i: F.max(F.when(F.col("_kind") == i, passage)).over(parent)
    near = chosen.withColumn("_p", of(0)).withColumn("_l", of(1)).withColumn("_r", of(2))
    listed = lambda *names: F.array_sort(F.filter(F.array(*(F.col(n) for n in names)), lambda x: x.isNotNull()))
    fit = lambda text: F.length(text) <= budget if budget > 0 else F.lit(True)
    near = near.withColumn("_l", F.when(F.col("_l").isNotNull() & fit(joined(listed("_l", "_p"))), F.col("_l")))
    near = near.withColumn("_r", F.when(F.col("_r").isNotNull() & fit(joined(listed("_l", "_p", "_r"))), F.col("_r")))
    taken = ((F.col("_kind") == 1) & F.col("_l").isNotNull()) | ((F.col("_kind") == 2) & F.col("_r").isNotNull())
    held = F.when((F.col("_kind") == 0) & F.col("chunk").isNotNull(), listed("_l", "_p", "_r")).when(F.col("chunk").isNotNull(), F.array(passage)).otherwise(F.array().cast("array<struct<a:long,c:string,b:long,t:string>>"))
    left = near.where(~taken).withColumn("_held", held)
    edge = lambda name, get: F.coalesce(get, F.col(name)).alias(name)
    text = F.when(F.size("_held") > 1, joined(F.col("_held"))).otherwise(F.col("text")).alias("text")
    kept = ["parent", "chunk", "ordinal", "section", edge("start", F.get("_held", F.lit(0))["a"]), edge("end", F.try_element_at("_held", F.lit(-1))["b"]), text]
    return left.select(*kept, "lexical_rank", "semantic_rank", "protected", "score", F.transform("_held", lambda x: x["c"]).alias("chunks"))


def retained(rows: DataFrame, window: int) -> DataFrame:
    """The first `window` rows in document order; protected rows beyond take the places of the last unprotected ones. The lanes' depth bounds the rows."""
    whole = Window.partitionBy(F.lit(0))
    placed = rows.withColumn("_n", F.row_number().over(Window.orderBy(*document_order())))
    group = F.when(F.col("_n") > window, F.when(F.col("protected"), "late").otherwise("gone")).otherwise(F.when(F.col("protected"), "safe").otherwise("free"))
    counted = placed.withColumn("_g", group).withColumn("_given", F.least(F.count_if(F.col("_g") == "late").over(whole), F.count_if(F.col("_g") == "free").over(whole)))
    ahead, behind = (F.row_number().over(Window.partitionBy("_g").orderBy(o)) for o in (F.asc("_n"), F.desc("_n")))
    kept = counted.withColumn("_a", ahead).withColumn("_z", behind).where("_g = 'safe' or (_g = 'free' and _z > _given) or (_g = 'late' and _a <= _given)")
    return kept.orderBy("_n").drop("_n", "_g", "_given", "_a", "_z")


def compare_lanes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ranks of two lists side by side, and how far each row moved."""
    both = a.select(key, F.col("rank").alias("rank_a")).join(b.select(key, F.col("rank").alias("rank_b")), key, "full_outer")
    return both.withColumn("moved", F.col("rank_a") - F.col("rank_b"))


def top(df: DataFrame, order: list[Column], depth: int) -> DataFrame:
    """The best rows with a rank from 1; only `depth` rows reach the window."""
    return df.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
