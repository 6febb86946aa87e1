"""Evidence for questions: fields and weights, concepts, entities that boost, pools of lanes, sections, index upkeep, derived entities."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import empty_page

#: Fields in the order in which a term is looked for, and what it counts there.
FIELD_WEIGHTS = {"title": 12, "tags": 10, "summary": 8, "author": 6, "excerpt": 5, "url": 2, "full_text": 4}
#: Words that stand for another in questions.
CANONICAL = {
    "models": "model", "kid": "children", "kids": "children", "child": "children", "killed": "kill", "killing": "kill", "kills": "kill",
    "charged": "charge", "charges": "charge", "charging": "charge", "tools": "tool", "projects": "project", "packages": "package",
    "libraries": "library", "comparisons": "comparison", "compared": "comparison", "compare": "comparison", "histories": "history",
    "historical": "history", "transcripts": "transcript", "screenshots": "screenshot", "images": "image", "photos": "photo",
    "videos": "video", "recordings": "recording",
}


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def _flag(condition: Column, weight: int | Column = 1) -> Column:
    return F.when(condition, weight).otherwise(0)


def field_score(fields: dict[str, Column], terms: list[str], source: Column, github: Column, question: str, entities: Column) -> Column:
    """Additive score over all fields (lower-cased here; null is empty), named as in FIELD_WEIGHTS.

    Each term counts in the first field that holds it. Besides: phrases in title (15) and tags (12), all of several terms (12),
    each missing one of three or more (-8), a summary (3), a source (1), a GitHub source where repositories are asked for (2),
    three for each matched entity up to nine.
    """
    low = {name: F.lower(F.coalesce(c, F.lit(""))) for name, c in fields.items()}
    terms, phrase = list(dict.fromkeys(terms)), " ".join(terms)

    def first(term: str) -> Column:
        return F.coalesce(*(F.when(F.contains(low[n], F.lit(term)), w) for n, w in FIELD_WEIGHTS.items() if n in low), F.lit(0))

    score = _sum(map(first, terms)) + F.least(entities * 3, F.lit(9)) + _flag(source)
    for name, weight in (("title", 15), ("tags", 12)):
        if phrase and name in low:
            score = score + _flag(F.contains(low[name], F.lit(phrase)), weight)
    if "summary" in low:
        score = score + _flag(F.trim(low["summary"]) != "", 3)
    if "repo" in question.lower():
        score = score + _flag(github, 2)
    missing = _sum(_flag(first(t) == 0) for t in terms)
    if len(terms) > 1:
        score = score + _flag(missing == 0, 12)
    return score - 8 * missing if len(terms) > 2 else score


def has_word(text: Column, term: str) -> Column:
    """A term between characters other than a-z and 0-9; terms of several words anywhere."""
    low, term = F.lower(text), term.strip().lower()
    if not term:
        return F.lit(False)
    return F.contains(low, F.lit(term)) if " " in term else F.regexp_like(low, F.lit(f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])"))


def concept_hits(text: Column, concepts: dict[str, list[str]]) -> Column:
    """Names of the concepts of which a text has any word."""
    marks = [F.when(reduce(lambda a, b: a | b, (has_word(text, w) for w in words)), F.lit(name)) for name, words in concepts.items()]
    return F.filter(F.array(*marks), lambda c: c.isNotNull())


def strategy_score(score: Column, rank: Column, hits: Column, required: list[str]) -> Column:
    """A score moved by rank (8 less the rank), concepts (14 if required, else 4), and, for several required ones, 12 less for each missing and 24 more for all."""
    got = F.size(F.array_intersect(hits, F.array(*map(F.lit, required)).cast("array<string>")))
    out = score + F.greatest(8 - rank, F.lit(0)) + got * 14 + (F.size(hits) - got) * 4
    return out - 12 * (len(required) - got) + _flag(got == len(required), 24) if len(required) > 1 else out


def with_required(rows: DataFrame, text: str, required: dict[str, list[str]]) -> DataFrame:
    """Rows that have every required concept."""
    return rows.where(F.size(concept_hits(F.col(text), required)) == len(required))


def entity_boosts(entities: DataFrame, references: DataFrame, question: str, terms: list[str], score, limit: int) -> DataFrame:
    """(ref, boost, entities) for what the best `limit` entities refer to.

    `entities` has key, name, refs and candidates (lower-case names); `score(candidates, query)` rates one query. Queries are the question
    (8), the joined terms (6) and each term (4, short ones 3); each that matches adds its weight, its score and up to three for references. Of several terms
    the phrase, or two terms of three letters, must be there. A boost is at most 8 for each entity.
    """
    full, joined = question.strip().lower(), " ".join(terms).strip().lower()
    queries = ([(full, 8)] if full else []) + ([(joined, 6)] if joined and joined != full else []) + [(t, 4 if len(t) >= 5 else 3) for t in terms]
    inside = lambda t: F.exists("candidates", lambda c: F.contains(c, F.lit(t)))
    gate = F.lit(True) if len(terms) < 2 else inside(joined) | (_sum(_flag(inside(t)) for t in set(terms) if len(t) >= 3) >= 2)
    each = [_flag(score(F.col("candidates"), q) > 0, score(F.col("candidates"), q) + w + F.least("refs", F.lit(3))) for q, w in queries if len(q) >= 3]
    best = entities.where(gate).withColumn("_score", _sum(each)).where("_score > 0").orderBy(F.desc("_score"), F.desc("refs"), F.lower("name"), "key").limit(limit)
    hit = references.join(F.broadcast(best.select("key", "name", F.least("_score", F.lit(8)).alias("_boost"))), "key")  # `limit` rows
    return hit.groupBy("ref").agg(F.sum("_boost").alias("boost"), F.array_sort(F.collect_set("name")).alias("entities"))


def expanded(boosts: DataFrame, seen: DataFrame) -> DataFrame:
    """What matched entities refer to and no lane has found."""
    return boosts.join(seen.select(F.col("key").alias("ref")).distinct(), "ref", "left_anti")


def pooled(lanes: dict[str, DataFrame]) -> DataFrame:
    """(key, lanes): each key of any lane once, with the lanes that found it, in the lanes' order."""
    union = reduce(DataFrame.unionByName, (df.select("key", F.lit(i).alias("i"), F.lit(name).alias("lane")) for i, (name, df) in enumerate(lanes.items())))
    return union.groupBy("key").agg(F.transform(F.array_sort(F.collect_set(F.struct("i", "lane"))), lambda x: x["lane"]).alias("lanes"))  # as many as lanes


def primary_and_related(found: DataFrame, limit: int, related: int, order: list[Column]) -> DataFrame:
    """(key, role): at most `limit` of (key, is_related, ...): limit - related primary ones, then related ones with keys of their own."""
    share = min(related, limit - 1)
    first = found.where("not is_related").orderBy(*order).limit(limit - share)
    rest = found.where("is_related").join(F.broadcast(first.select("key")), "key", "left_anti").orderBy(*order).limit(limit)
    both = first.withColumn("_p", F.lit(0)).unionByName(rest.withColumn("_p", F.lit(1))).orderBy("_p", *order).limit(limit)
    return both.select("key", F.when(F.col("_p") == 0, "primary").otherwise("related").alias("role"))


def sections(rows: DataFrame, key: list[str], parts: dict[str, Column]) -> DataFrame:
    """(key, ordinal, role, text): the trimmed parts that are not empty; of equal texts the first."""
    held = F.filter(F.array(*(F.struct(F.lit(n).alias("role"), F.trim(F.coalesce(c, F.lit(""))).alias("text")) for n, c in parts.items())), lambda s: s["text"] != "")
    whole = rows.select(*key, held.alias("_s"))
    once = F.filter("_s", lambda s, i: F.array_position(F.transform("_s", lambda x: x["text"]), s["text"]) == i + 1)
    return whole.select(*key, F.posexplode(once).alias("ordinal", "s")).select(*key, "ordinal", "s.role", "s.text")


def index_text(*parts: Column) -> Column:
    """Trimmed parts that are not empty, an empty line between them."""
    return F.array_join(F.filter(F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts)), lambda p: p != ""), "\n\n")


def refreshed(index: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """An index (or a table of links) with the rows of some keys replaced: `changed` holds their new rows, `removed` names all keys whose old rows go."""
    return index.join(removed.select(key).distinct(), key, "left_anti").unionByName(changed)


def poor_summary(extract_status: Column, summary_status: Column, tool: Column, extract: Column) -> Column:
    """A good summary of what was no article: an empty extract, a short archived one, or a page that says it is none."""
    text = F.trim(extract)
    short = ((tool == "wayback") & (F.length(text) < 500)) | empty_page(extract)
    return (summary_status == "ok") & ((extract_status == "empty") | ((extract_status == "ok") & short))


def media_flags(media: DataFrame, key: str) -> DataFrame:
    """(key, kinds): the kinds of media that are downloaded, local and not pruned; a few for each key."""
    return media.where("download_status = 'downloaded' and local_path <> '' and pruned_at = ''").groupBy(key).agg(F.array_sort(F.collect_set("media_type")).alias("kinds"))


def transcription_due(kinds: Column, text: Column, status: Column, done_at: Column, cutoff: str) -> Column:
    """No transcript, a moving picture, and never tried or failed at a time (RFC 3339, UTC) up to the cutoff."""
    runnable = F.coalesce(F.array_contains(kinds, "video") | F.array_contains(kinds, "animated_gif"), F.lit(False))
    return (text == "") & runnable & ((status == "") | ((status == "error") & (done_at != "") & (done_at <= F.lit(cutoff))))


def ocr_due(kinds: Column, status: Column) -> Column:
    return F.coalesce(F.array_contains(kinds, "photo"), F.lit(False)) & status.isin("", "error")


def allowed(rows: DataFrame, lists: dict[str, list]) -> DataFrame:
    """Rows whose columns are in all the lists that are not empty; at most 1000 values each."""
    if any(len(v) > 1000 for v in lists.values()):
        raise ValueError("at most 1000 values in a list")
    return rows.where(reduce(lambda a, b: a & b, (F.col(c).isin(v) for c, v in lists.items() if v), F.lit(True)))


def canonical_terms(words: Column) -> Column:
    """Words with plural and other forms folded, each once; parts of keys (8 digits, or 10 hex digits, or more) go."""
    names = F.create_map(*(F.lit(x) for pair in CANONICAL.items() for x in pair))
    folded = F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), w))
    return F.array_distinct(F.filter(folded, lambda w: ~F.regexp_like(w, F.lit(r"^([0-9]{8,}|[0-9a-f]{10,})$"))))


def author_entities(rows: DataFrame, handle: str, name: str) -> DataFrame:
    """(entity_key, name, aliases, refs): authors by handle, lower-cased, else by name; rows without either give none."""
    given, shown = F.trim(F.coalesce(F.col(handle), F.lit(""))), F.trim(F.coalesce(F.col(name), F.lit("")))
    slug = F.regexp_replace(F.regexp_replace(F.lower(shown), "[^a-z0-9]+", "-"), "^-|-$", "")
    key = F.when(given != "", F.concat(F.lit("author:"), F.lower(given))).otherwise(F.concat(F.lit("author:name:"), slug))
    rows = rows.where((given != "") | (shown != "")).select(key.alias("entity_key"), given.alias("h"), shown.alias("n"))
    marks = F.array("n", "h", F.lower("h"), F.when(F.col("h") != "", F.concat(F.lit("@"), "h")), F.when(F.col("h") != "", F.concat(F.lit("@"), F.lower("h"))))
    one = rows.groupBy("entity_key", "h", "n").agg(F.count(F.lit(1)).alias("refs"), F.first(marks).alias("marks"))
    label = F.coalesce(F.min(F.when(F.col("n") != "", F.col("n"))), F.min(F.concat(F.lit("@"), F.lower("h"))))
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter("marks", lambda m: m.isNotNull() & (m != ""))))))  # spellings of one author
    return one.groupBy("entity_key").agg(label.alias("name"), every.alias("aliases"), F.sum("refs").alias("refs"))


def site_entities(pages: DataFrame, url: str, code_host: str) -> DataFrame:
    """(entity_key, kind, refs): owner and repository for pages of a code host with both in their path, else the site."""
    host = F.regexp_replace(F.regexp_extract(F.lower(F.col(url)), r"^[a-z]+://([^/?#:]+)", 1), r"^www\.", "")
    path = F.split(F.regexp_extract(F.lower(F.col(url)), r"^[a-z]+://[^/?#]+/([^?#]+)", 1), "/")
    owner, repo = F.coalesce(F.get(path, F.lit(0)), F.lit("")), F.coalesce(F.get(path, F.lit(1)), F.lit(""))
    entity = lambda kind, *parts: F.struct(F.concat(F.lit(f"{kind}:"), *parts).alias("entity_key"), F.lit(kind).alias("kind"))
    code = (host == code_host) & (owner != "") & (repo != "")
    found = F.when(code, F.array(entity("owner", owner), entity("repo", owner, F.lit("/"), repo))).when(host != "", F.array(entity("site", host)))
    return pages.select(F.explode(found).alias("e")).groupBy("e.entity_key", "e.kind").agg(F.count(F.lit(1)).alias("refs"))


def kept_aliases(proposed: DataFrame, tokens: DataFrame, mapped: DataFrame, safe) -> DataFrame:
    """(old, new): proposed aliases whose old token occurs and is not mapped yet, whose new one (mapped on) is a token or a target, is
    safe by `safe(old, new)` and is not rarer. `tokens` has token and n, `mapped` old and new."""
    chain = mapped.select(F.col("old").alias("new"), F.col("new").alias("_on"))
    rows = proposed.join(mapped.select("old"), "old", "left_anti").join(chain, "new", "left").select("old", F.coalesce("_on", "new").alias("new"))
    rows = rows.join(tokens.select(F.col("token").alias("old"), F.col("n").alias("_old")), "old").join(tokens.select(F.col("token").alias("new"), F.col("n").alias("_new")), "new", "left")
    rows = rows.join(mapped.select("new").distinct().withColumn("_target", F.lit(True)), "new", "left")
    known = F.col("_new").isNotNull() | F.col("_target").isNotNull()
    return rows.where(known & (F.col("old") != F.col("new")) & safe(F.col("old"), F.col("new")) & (F.coalesce("_new", "_old") >= F.col("_old"))).select("old", "new")


def html_text(html: Column) -> Column:
    """The text of a page: comments, scripts and styles go, other tags become spaces, five entities are read, white space is one space."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(bare, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\x0B\f\r]+", " "))
