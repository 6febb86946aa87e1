"""Links, topics and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalised_url, tokens


def link_candidates(df: DataFrame, key: str, urls: str) -> DataFrame:
    """(key, url, kind, host, source_key): normalised links of an array column, each once for each row."""
    exploded = df.select(key, F.explode(urls).alias("raw")).select(key, normalised_url(F.col("raw")).alias("u")).where("u is not null")
    return exploded.select(key, "u.url", "u.kind", "u.host", F.col("u.key").alias("source_key")).distinct()


def grams(text: Column, most: int = 3, least_length: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Distinct runs of one to `most` words, stop words and short words left out first."""
    kept = F.filter(tokens(text), lambda w: (F.length(w) >= least_length) & (~w.isin(*stop) if stop else F.lit(True)))

    def whole(words: Column) -> Column:
        def runs(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.when(i + (n - 1) <= F.size(words), F.array_join(F.slice(words, i, n), " ")))

        return F.filter(F.array_distinct(F.concat(*(runs(n) for n in range(1, most + 1)))), lambda g: g.isNotNull())

    return F.transform(F.array(kept), whole)[0]  # the words are taken once, not for each place


def signal_clusters(df: DataFrame, key: str, text: Column, limit: int = 6, **rules) -> DataFrame:
    """Phrases of several rows: by rows, then words, then phrase; a phrase inside a chosen one of as many rows is left out.

    The counts and their order are distributed; the greedy choice reads the best 64 phrases, then eight times as many, and so on until it has `limit` of them or has seen all.
    """
    spark = df.sparkSession
    counts = df.select(key, F.explode(grams(text, **rules)).alias("phrase")).groupBy("phrase").agg(F.count_distinct(key).alias("n")).where("n > 1").persist()
    best, most = counts.orderBy(F.desc("n"), F.size(F.split("phrase", " ")).desc(), "phrase"), 64
    while True:
        chosen: list[tuple[str, int]] = []
        rows = best.limit(most).collect()
        for row in rows:
            if len(chosen) < limit and not any(f" {row.phrase} " in f" {p} " and n >= row.n for p, n in chosen):
                chosen.append((row.phrase, row.n))
        if len(chosen) == limit or len(rows) < most:
            counts.unpersist()
            return spark.createDataFrame(chosen, "phrase string, n long")
        most *= 8


def merged_entities(mentions: DataFrame) -> DataFrame:
    """One row for each entity_key of mentions (entity_key, seq, name, url, alias, kind, ref): first non-empty fields, sets of the rest."""
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("seq"))), F.lit("")).alias(c)
    return mentions.groupBy("entity_key").agg(first("name"), first("url"), F.array_sort(F.collect_set(F.nullif("alias", F.lit("")))).alias("aliases"), F.min("kind").alias("kind"), F.count_distinct("ref").alias("refs"))


def one_hop(seeds: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """(seed, neighbour): up to `cap` neighbours of each seed over (a, b) edges, in either direction, by how many edges lead there."""
    both = edges.select(F.col("a").alias("seed"), F.col("b").alias("neighbour")).unionByName(edges.select(F.col("b").alias("seed"), F.col("a").alias("neighbour")))
    found = both.join(seeds.select("seed"), "seed", "left_semi").groupBy("seed", "neighbour").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("n"), "neighbour"))
    return found.withColumn("r", rank).where(F.col("r") <= cap).select("seed", "neighbour", "n")


def _subsets(tokens: Column) -> Column:
    """All sets of some of a few tokens, each in the tokens' order."""
    bit = lambda m, i: m.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) > 0
    return F.transform(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(tokens)) - 1), lambda m: F.filter(tokens, lambda _, i: bit(m, i)))


def linked_classes(left: DataFrame, right: DataFrame, token: str, few: int = 8) -> DataFrame:
    """(left_key, class_id, links, shared) for each key of `left` (left_key, token): how many keys of `right` (right_key, token) share a token, and how many tokens all of them share.

    Keys with the same tokens are one class, named by its smallest key. Between keys of up to `few` tokens no pair is made: right keys are counted by
    the sets of tokens that they hold, and a left class adds and subtracts the counts of its own sets (inclusion and exclusion), so a token that all rows
    have costs 2^few rows for each class and no more. Classes with more tokens meet on tokens. Tokens that the left has not are left out first.
    """
    both = right.join(left.select(token).distinct(), token, "left_semi")

    def by_key(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.array_sort(F.collect_set(token)).alias("tokens"))

    l = by_key(left, "left_key")
    heads = l.groupBy("tokens").agg(F.min("left_key").alias("class_id"))
    many = by_key(both, "right_key").groupBy("tokens").agg(F.min("right_key").alias("other"), F.count(F.lit(1)).alias("n"))
    holders = many.select(F.explode("tokens").alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    shared = heads.select("class_id", F.explode("tokens").alias("t")).join(holders, "t").groupBy("class_id").agg(F.sum("n").alias("shared"))
    short = F.size("tokens").between(1, few)
    counted = many.where(short).select(F.explode(_subsets(F.col("tokens"))).alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n"))
    asked = heads.where(short).select("class_id", F.explode(_subsets(F.col("tokens"))).alias("s"))
    added = asked.join(counted, "s").select("class_id", F.when(F.size("s") % 2 == 1, F.col("n")).otherwise(-F.col("n")).alias("n"))
    a = heads.select("class_id", short.alias("_short"), F.explode("tokens").alias("t"))
    b = many.select("other", "n", short.alias("_few"), F.explode("tokens").alias("t"))
    met = a.join(b, "t").where("not (_short and _few)").select("class_id", "other", "n").distinct().select("class_id", "n")
    links = added.unionByName(met).groupBy("class_id").agg(F.sum("n").alias("links"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    found = heads.join(links, "class_id", "left").join(shared, "class_id", "left")
    return l.join(found, "tokens").select("left_key", "class_id", zero("links"), zero("shared"))
