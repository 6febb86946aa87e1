"""Evidence rules: windows of text, entity scores, concepts, citations, keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import stored

#: Host labels that name no one, and hosts that many share.
GENERIC_LABELS = ("co", "com", "net", "org", "gov", "edu", "ac")


def best_sentence(text: Column, longest: int = 220) -> Column:
    """The first sentence, cut at the first of `. `, `? `, `! ` that occurs, in that order; else the beginning."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    out = F.substring(one, 1, longest)
    for mark in ("! ", "? ", ". "):
        out = F.when(F.instr(one, mark) > 1, F.substring(one, F.lit(1), F.instr(one, mark))).otherwise(out)
    return out


def running(sizes: Column, block: int = 256) -> Column:
    """The sum of all sizes before each; summed in blocks, so that a long array is not copied for each of its places."""

    def whole(all_: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            one = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
            part = F.aggregate(F.slice(all_, i * block + 1, F.lit(block)), F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("out")), one)
            return F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))[0]

        blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / block).cast("int"))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")), step, lambda acc: F.flatten(acc["out"]))

    return F.transform(F.array(sizes), whole)[0]


def _low(text: Column) -> Column:
    """Lower case that keeps every place: the one letter that would become two is none of any term."""
    return F.lower(F.translate(text, "\u0130", "\ue000"))


def _events(low: Column, terms: list[str], most: int) -> Column:
    """(minus place, kind, size), last place first: where terms stand (kind: the term's number) and, after those of the same place, where windows begin (kind: the number of terms)."""
    size = F.length(low)

    def listed(i: int, term: str) -> list[Column]:
        quoted = re.escape(term)
        event = lambda at, kind, n: F.struct((-at).alias("at"), F.lit(kind).alias("kind"), F.lit(n).alias("size"))
        stands = F.filter(running(F.transform(F.split(low, f"(?={quoted})"), F.length)), lambda at: (at > 0) | F.startswith(low, F.lit(term)))
        met = F.filter(running(F.transform(F.split(low, quoted), lambda p: F.length(p) + len(term))), lambda _, n: n > 0)
        begin = lambda after: F.greatest(F.least(after - len(term) - most // 4, size - most), F.lit(0))
        return [F.transform(stands, lambda at: event(at, i, 0)), F.transform(met, lambda after: event(begin(after), len(terms), len(term)))]

    lists = [x for i, term in enumerate(terms) for x in listed(i, term)]
    return F.array_sort(F.concat(*lists))


def best_window(text: Column, terms: list[str], most: int = 160, counted: Column | None = None) -> Column:
    """(score, text): the stretch of `most` characters, a quarter of it before a term, that is worth most; the earliest on ties; null without any term.

    It is worth the length of the term that it is around and, for each term in it, 100, its length and 1000 by how often it stands in `counted` (this text,
    if not given). Trimmed, with `...` where text is left out. One pass over the places of the terms from the last to the first, which
    carries the next place of each term: linear in the text but for sorting the places.
    """
    terms = list(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))
    text = F.coalesce(text, F.lit(""))
    if not terms:
        return F.lit(None).cast("struct<score:int,text:string>")
    far = 2**30

    def whole(low: Column) -> Column:
        base = _low(counted) if counted is not None else low
        often = [F.size(F.split(base, re.escape(t))) - 1 for t in terms]
        rare = F.array(*(100 + F.floor(F.lit(1000) / F.greatest(n, F.lit(1))).cast("int") + len(t) for n, t in zip(often, terms)))
        start = F.struct(F.array(*(F.lit(far) for _ in terms)).alias("next"), F.lit(-1).alias("score"), F.lit(0).alias("start"))

        def scan(worth: Column) -> Column:
            def step(s: Column, e: Column) -> Column:
                at = -e["at"]
                moved = F.transform(s["next"], lambda v, i: F.when(i == e["kind"], at).otherwise(v))
                value = e["size"]
                for i, t in enumerate(terms):
                    value = value + F.when(F.get(s["next"], F.lit(i)) + len(t) <= at + most, F.get(worth, F.lit(i))).otherwise(0)
                better = (e["kind"] == len(terms)) & (value >= s["score"])
                return F.struct(F.when(e["kind"] == len(terms), s["next"]).otherwise(moved).alias("next"), F.when(better, value).otherwise(s["score"]).alias("score"), F.when(better, at).otherwise(s["start"]).alias("start"))

            return F.aggregate(_events(low, terms, most), start, step)

        return F.transform(F.array(rare), scan)[0]

    found = F.transform(F.array(_low(text)), whole)[0]
    trimmed = lambda t: F.trim(F.regexp_replace(t, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""))

    def shown(s: Column) -> Column:
        cut = F.concat(F.when(s["start"] > 0, "...").otherwise(""), trimmed(F.substring(text, s["start"] + 1, F.lit(most))), F.when(s["start"] + most < F.length(text), "...").otherwise(""))
        return F.when(s["score"] >= 0, F.struct(s["score"].alias("score"), cut.alias("text")))

    return F.transform(F.array(found), shown)[0]


def excerpt(values: list[Column], terms: list[str], most: int = 160) -> Column:
    """The best window among several texts (white space as one space; the first on ties), terms counted over all of them; without any, the beginning of the first text that is not empty."""
    one = [F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s+", " ")) for v in values]
    every = F.array_join(F.filter(F.array(*one), lambda v: v != ""), "\n")

    def ranked(i: int, value: Column) -> Column:
        mark = lambda w: F.when(w.isNotNull(), F.struct((-w["score"]).alias("s"), F.lit(i).alias("i"), w["text"].alias("t")))
        return F.transform(F.array(best_window(value, terms, most, every)), mark)[0]

    best = F.array_sort(F.filter(F.array(*(ranked(i, v) for i, v in enumerate(one))), lambda w: w.isNotNull()))
    first = F.coalesce(F.get(F.filter(F.array(*one), lambda v: v != ""), F.lit(0)), F.lit(""))
    short = F.when(F.length(first) > most, F.concat(F.trim(F.substring(first, 1, most)), F.lit("..."))).otherwise(first)
    return F.coalesce(F.get(best, F.lit(0))["t"], short)


def text_score(candidates: Column, query: str) -> Column:
    """10 if a candidate is the query, 6 if it holds a query of five characters or more, 4 if it holds a shorter one."""
    inside = 6 if len(query) >= 5 else 4
    return F.coalesce(F.array_max(F.transform(candidates, lambda c: F.when(c == query, 10).when(F.contains(c, F.lit(query)), inside).otherwise(0))), F.lit(0))


def topic_score(matched: Column, refs: Column, priority: Column, candidates: Column, topic: str, terms: list[str]) -> Column:
    """20 for each matched reference, up to 10 for references, the kind's priority, and 16, 12, 8 or 4 for the best match of a name."""

    def one(c: Column) -> Column:
        scores = [F.when(c == topic, 16).when(F.contains(c, F.lit(topic)), 12).otherwise(0)]
        scores += [F.when(c == t, 8).when(F.contains(c, F.lit(t)), 4 if len(t) >= 5 else 0).otherwise(0) for t in terms]
        return reduce(F.greatest, scores) if len(scores) > 1 else scores[0]

    return matched * 20 + F.least(refs, F.lit(10)) + priority + F.coalesce(F.array_max(F.transform(candidates, one)), F.lit(0))


def brand(host: Column) -> Column:
    """The label of a host that names its owner."""
    parts = F.split(host, r"\.")
    last = F.element_at(parts, -2)
    return F.when(F.size(parts) == 1, parts[0]).when((F.size(parts) > 2) & last.isin(*GENERIC_LABELS), F.element_at(parts, -3)).otherwise(last)


def identity_tokens(*values: Column) -> Column:
    """Lower-case parts of names and addresses of four characters or more, each once."""
    parts = F.flatten(F.array(*(F.split(F.lower(v), r"[@/_\-.:\s]+") for v in values)))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 4))


def always_missing(rows: DataFrame, group: str, missing: str) -> DataFrame:
    """(group, missing): what every row of a group misses; counts combine, arrays are never gathered."""
    total = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    each = rows.select(group, F.explode(F.array_distinct(missing)).alias("concept")).groupBy(group, "concept").agg(F.count(F.lit(1)).alias("n"))
    return each.join(total, group).where("n = rows").select(group, "concept")


def edit_patterns(word: Column, most: int) -> Column:
    """(pattern, wild, edits) of a word for up to `most` edits, two at most: the word without some of its letters, the places in what is left where one of these was replaced (as text), and how
    many were taken away otherwise.

    Two words are within `most` edits if and only if they have a pattern with the same places where the replaced letters and the edits of both are no more than `most`.
    """
    text = lambda x: x.cast("string")
    start = F.struct(word.alias("pattern"), F.lit("").alias("wild"), F.lit(0).alias("edits"), F.lit(0).alias("at"))

    def less(p: Column) -> Column:
        """One letter less, at or after the place of the last one."""
        size = F.length(p["pattern"])
        places = F.filter(F.sequence(p["at"], F.greatest(size, p["at"])), lambda i: i < size)
        cut = lambda i: F.concat(F.substring(p["pattern"], F.lit(1), i), F.substring(p["pattern"], i + 2, size))
        gone = F.transform(places, lambda i: F.struct(cut(i).alias("pattern"), p["wild"].alias("wild"), (p["edits"] + 1).alias("edits"), i.alias("at")))
        other = F.transform(places, lambda i: F.struct(cut(i).alias("pattern"), F.concat(p["wild"], text(i), F.lit(",")).alias("wild"), p["edits"].alias("edits"), i.alias("at")))
        return F.concat(gone, other)

    levels = [F.array(start)]
    for _ in range(most):
        levels.append(F.flatten(F.transform(levels[-1], less)))
    return F.array_distinct(F.transform(F.concat(*levels), lambda p: F.struct(p["pattern"].alias("pattern"), p["wild"].alias("wild"), p["edits"].alias("edits"))))


def nearest_keys(wanted: DataFrame, allowed: DataFrame) -> DataFrame:
    """(key, near, distance): for each key the allowed key of its namespace within two edits, the nearest and then the smallest.

    Keys that have no nearer one go on to the next distance. They meet on patterns of edits, each of which holds the smallest
    allowed key alone, so that no pairs are made, however many keys are alike.
    """
    low = F.lower("key")
    space = F.split_part(low, F.lit(":"), F.lit(1))
    parts = (space.alias("space"), F.substring(low, F.length(space) + 1, F.length(low)).alias("rest"))
    left = wanted.where("key is not null").select("key", *parts).distinct()
    have = stored(allowed.where("key is not null").select("key", *parts).groupBy("space", "rest").agg(F.min("key").alias("near")), "allowed")
    found = left.join(have, ["space", "rest"]).select("key", "near", F.lit(0).alias("distance"))
    left = stored(left.join(have, ["space", "rest"], "left_anti"), "left")
    for most in (1, 2):
        if left.isEmpty():
            break
        ask = left.select("key", "space", F.explode(edit_patterns(F.col("rest"), most)).alias("p")).select("key", "space", "p.*")
        asked = stored(ask, "asked")
        met = ["space", "pattern", "wild"]
        hold = have.select("space", "near", F.explode(edit_patterns(F.col("rest"), most)).alias("p")).select("space", "near", "p.*")
        hold = hold.join(stored(asked.select(*met).distinct(), "patterns"), met, "left_semi")
        hold = hold.groupBy(*met, "edits").agg(F.min("near").alias("near")).withColumnRenamed("edits", "more")  # three rows of a pattern at most
        replaced = F.size(F.split("wild", ",")) - 1
        near = asked.join(hold, met).where(replaced + F.col("edits") + F.col("more") <= most)
        near = stored(near.groupBy("key").agg(F.min("near").alias("near")).select("key", "near", F.lit(most).alias("distance")), "near")
        found = found.union(near)
        if most < 2:
            left = stored(left.join(near, "key", "left_anti"), "left")
    return found


def latest_time(texts: Column) -> Column:
    """The latest of RFC 3339 texts; if none can be read, the greatest text; else empty."""
    read = F.array_max(F.transform(texts, lambda t: F.try_to_timestamp(t)))
    return F.coalesce(F.date_format(read, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.array_max(texts), F.lit(""))


def latest_in_group(text: Column) -> Column:
    """`latest_time` of a group's texts, by aggregates that combine before the shuffle."""
    return F.coalesce(F.date_format(F.max(F.try_to_timestamp(text)), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.max(text), F.lit(""))


def missing_targets(links: DataFrame, pages: DataFrame, target: str, path: str) -> DataFrame:
    """Links whose target is no page."""
    return links.join(pages.select(F.col(path).alias(target)).distinct(), target, "left_anti")
