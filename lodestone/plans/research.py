"""A question becomes an evidence pack: its family's searches, a lane for each, fusion, excerpts; and many questions are checked at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evidence, fusion, search
from lodestone.plans import families
from lodestone.plans.families import Concept
from lodestone.plans.terms import terms_of


def variants(question: str, most: int = families.MOST_VARIANTS, concepts: list[Concept] | None = None) -> list[list[str]]:
    """Term lists to try: those of the family's searches; of lists that are equal the first."""
    lists = (tuple(search.query_terms(v)) for v in families.variants(question, concepts, most))
    return [list(v) for v in dict.fromkeys(lists)]


def evidence_pack(docs: DataFrame, key: str, text: str, question: str, window: int = 20, depth: int = 50, most: int = 240, concepts: list[Concept] | None = None) -> DataFrame:
    """(key, score, a rank for each lane, excerpt): documents fused over the lanes of the question's variants, which one scan scores."""
    lanes = {f"lane{i}": terms for i, terms in enumerate(variants(question, concepts=concepts))}
    ranked = search.ranked_lanes(docs, key, text, lanes, depth)
    wide = ranked.groupBy(key).pivot("lane", list(lanes)).agg(F.min("rank"))  # `depth` rows for each lane
    fused = fusion.fused_ranks(wide, dict.fromkeys(lanes, 1.0), key, window)
    return docs.join(F.broadcast(fused), key).select(key, "score", *(f"{n}_rank" for n in lanes), evidence.excerpt([F.col(text)], terms_of(question), most).alias("excerpt"))


def checked(docs: DataFrame, key: str, text: str, cases: list[dict], depth: int = 10) -> DataFrame:
    """One row for each case (id, question, and any of expected, forbidden, top: keys): found, missing and forbidden keys, the first key, and whether it passes.

    All questions are scored in one scan, as lanes. A case passes if all expected keys are among its first `depth`, no forbidden one is, and the first is `top`.
    """
    spark = docs.sparkSession
    lanes = {str(c["id"]): terms_of(c["question"]) for c in cases}
    if len(lanes) < len(cases):
        raise ValueError("two cases have one id")
    kind = docs.schema[key].dataType.simpleString()
    rows = [(str(c["id"]), list(c.get("expected", [])), list(c.get("forbidden", [])), c.get("top")) for c in cases]
    asked = spark.createDataFrame(rows, f"id string, expected array<{kind}>, forbidden array<{kind}>, top {kind}")
    ranked = search.ranked_lanes(docs, key, text, lanes, depth)
    hits = ranked.groupBy("lane").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("hits"))  # `depth` for each case
    both = asked.join(F.broadcast(hits), asked["id"] == hits["lane"], "left").withColumn("hits", F.coalesce("hits", F.array().cast(f"array<{kind}>")))
    missing, wrong, first = F.array_except("expected", "hits"), F.array_intersect("forbidden", "hits"), F.get("hits", F.lit(0))
    passes = (F.size(missing) == 0) & (F.size(wrong) == 0) & (F.col("top").isNull() | F.coalesce(first == F.col("top"), F.lit(False)))
    return both.select("id", "hits", missing.alias("missing"), wrong.alias("forbidden"), first.alias("first"), passes.alias("passes"))
