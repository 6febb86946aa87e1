"""Line dedup by a segment-partition edit join. DataFrame and SQL functions only.

Lines (stripped of white space at both ends; blank ones never count) are equal or, if both have `least` characters or more, alike
within one edit. A line is removed if an equal or alike line stands earlier, by doc_id and then line number; lines are judged on the input, not on
what is left.

For one edit a line is cut into two segments. Two lines within one edit share a segment at a place that their lengths
allow, so each line stores its segments by length and probes, for its own length and one less, the substrings that can match.
Keys with one line go no further. The lines of a key that many share are not paired: what is left of them beside the shared segment, the
window, is cut into two in turn, and they meet by the key and one half of the window, level by level, until few share a key.
Windows are cut, never joined again, so that all windows of a level hold twice the text at most, stored and probing, and a line takes as many
levels as its length has binary digits. At windows of one character all lines that share a key are within one substitution of each other,
and the earliest stands for all; at windows of none a single line is left, with those that have one character more.
Whatever the way, a pair counts only if a banded, bit-parallel edit distance of both whole lines says so.

Null and empty texts have no lines. Null doc_ids sort first. Rows that share a doc_id are told apart by nothing else and share their decisions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, narrow, small, wide
from lodestone.llm.rules import let

SPACES = " \t\n\x0b\x0c\r"
#: Keys or hashes up to which a counted side is broadcast, a long each.
KNOWN = 1_000_000
#: Occurrences of a line that one task takes from the join with its decision.
HOT = 10_000
#: Lines of a key up to which they are paired, each with as many others at most; a key that more share goes a level deeper, which loses no pair and keeps the pairs in proportion to the lines.
CROWDED = 8
#: Characters of a window up to which the lines of a key are paired and their windows compared; longer ones pair if they are FEW.
WINDOW, FEW = 256, 4


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, no, line, h, g): the lines that have a word; no counts from 0, h and g are independent hashes."""
    lines = docs.select("doc_id", "text").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "raw"))
    lines = lines.select("doc_id", "no", F.btrim("raw", F.lit(SPACES)).alias("line")).where("line <> ''")
    return lines.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), F.col("line"))})


def segment_keys(line: Column) -> Column:
    """(key, probe, n) of a line: two stored segments, then the substrings that may equal a stored one of a line of n, as long or one shorter."""
    n = F.length(line)
    half = F.floor(n / 2).cast("int")
    less = F.floor((n - 1) / 2).cast("int")

    def key(length: Column, side: int, part: Column, probe: int) -> Column:
        return F.struct(F.xxhash64(length, F.lit(side), part).alias("key"), F.lit(probe).alias("probe"), length.alias("n"))

    def at(begin: Column, size: Column) -> Column:
        return F.substring(line, begin, size)

    one = F.lit(1)
    return F.array(
        key(n, 0, at(one, half), 0),
        key(n, 1, at(half + 1, n - half), 0),
        key(n - 1, 0, at(one, less), 1),
        key(n - 1, 1, at(less + 2, n - 1 - less), 1),
    )


def halves(context: Column, window: Column, probe: Column) -> Column:
    """(key, window) twice: the context with the first half of a window and what is left, then with the last half.

    A stored window has m characters, the window of a probing line one more; both give away what m characters have in a half. One
    character is given away at either side. With a line's length as context these are its `segment_keys`.
    """
    n = F.length(window)
    m = n - probe
    head = F.greatest(F.floor(m / 2).cast("int"), F.least(m, F.lit(1)))
    tail = m - F.floor(m / 2).cast("int")

    def child(side: int, part: Column, rest: Column) -> Column:
        return F.struct(F.xxhash64(context, F.lit(side), part).alias("key"), rest.alias("window"))

    def cut(begin: Column, size: Column) -> Column:
        return F.substring(window, begin, size)

    one = F.lit(1)
    return F.array(child(0, cut(one, head), cut(head + 1, n - head)), child(1, cut(n - tail + 1, tail), cut(one, n - tail)))


def _many(crowded: int, window: int) -> Column:
    """Whether the lines of a key go a level deeper: few long ones do, so that a pair's texts travel a few times at most."""
    return (F.col("size") > crowded) | (F.col("size") > FEW) & (F.col("n") > window)


def _pairs(stored: DataFrame, held: str) -> DataFrame:
    """(x, y) of a key's lines: stored ones of one length, and stored ones with those that probe."""
    return stored.select("a", F.explode(held).alias("b")).where("b.h <> a.h and (b.probe = 1 or b.h > a.h)")


def near_pairs(lines: DataFrame, least: int, crowded: int) -> DataFrame:
    """(a, b) of hashes of lines that may be within one edit: each line meets the earliest of those that are, if not all.

    Keys are counted before they meet, so that no crowded key is ever gathered.
    """
    if least < 2:
        raise ValueError("a line of one character is within one edit of any other: least is 2 or more")
    distinct = lines.where(F.length("line") >= least).groupBy("line").agg(F.first("h").alias("h"))
    keys = materialise(distinct.select("h", F.explode(segment_keys(F.col("line"))).alias("k")).select("k.*", "h"), "keys")
    sizes = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("n"), F.min("probe").alias("stored")).where("size > 1 and stored = 0"), "sizes")
    deeper = _many(crowded, 2 * WINDOW)
    full = small(sizes.where(deeper).select("key"), KNOWN)
    shared = keys.join(full, "key", "left_anti").join(sizes.where(~deeper).select("key"), "key", "left_semi")
    few = shared.groupBy("key").agg(F.collect_list(F.struct("probe", "h")).alias("held"))  # crowded at most
    stored = few.select("held", F.explode(F.filter("held", lambda x: x["probe"] == 0)).alias("a"))
    found = [_pairs(stored, "held").select(F.col("a.h").alias("x"), F.col("b.h").alias("y"))]

    crowd = small(materialise(keys.join(full, "key", "left_semi").select("h").distinct(), "crowd"), KNOWN)
    texts = lines.join(crowd, "h", "left_semi").where(F.length("line") >= least).groupBy("line").agg(F.first("h").alias("h"), F.min(F.struct("doc_id", "no")).alias("first"))
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("probe")
    cut = texts.select("h", "first", "line", both).select("h", "first", "probe", F.explode(halves(F.length("line") - F.col("probe"), F.col("line"), F.col("probe"))).alias("k"))
    level = materialise(cut.select("k.*", "h", "first", "probe").join(full, "key", "left_semi"), "level")
    while not level.isEmpty():
        more, level = _deeper(level, crowded)
        found.append(more)
    pairs = functools.reduce(DataFrame.union, found)
    return materialise(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")


def _deeper(level: DataFrame, crowded: int) -> tuple[DataFrame, DataFrame]:
    """(x, y) of lines that meet at half the windows of a level (key, window, h, first, probe), and the level of those that too many share."""
    size = F.length("window") - F.col("probe")
    ends = level.where(size == 0)  # a line, and those that have one character more here
    ends = ends.where("probe = 0").select("key", F.col("h").alias("x")).join(ends.where("probe = 1").select("key", F.col("h").alias("y")), "key").select("x", "y")
    classes = level.where((size == 1) & (F.col("probe") == 0))
    heads = classes.groupBy("key").agg(F.min_by("h", F.struct("first", "h")).alias("x"))
    classes = classes.select("key", F.col("h").alias("y")).join(heads, "key").where("x <> y").select("x", "y")

    cut = level.where(size > 0).select("h", "first", "probe", F.explode(halves(F.col("key"), F.col("window"), F.col("probe"))).alias("k"))
    cut = materialise(cut.select("k.*", "h", "first", "probe"), "windows")
    sizes = cut.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.length("window")).alias("n"), F.min("probe").alias("stored")).where("size > 1 and stored = 0")
    sizes = materialise(sizes.withColumn("deeper", _many(crowded, WINDOW)), "sizes")
    full = small(sizes.where("deeper").select("key"), KNOWN)
    few = cut.join(sizes.where("not deeper").select("key"), "key", "left_semi")
    window = F.when(F.length("window") <= WINDOW + 1, F.col("window")).alias("window")  # of longer ones only the whole lines are compared
    few = few.groupBy("key").agg(F.collect_list(F.struct("probe", "h", window)).alias("held"))
    stored = few.select("held", F.explode(F.filter("held", lambda x: x["probe"] == 0)).alias("a"))
    near = F.coalesce(F.levenshtein("a.window", "b.window", 1) >= 0, F.lit(True))
    met = _pairs(stored, "held").where(near).select(F.col("a.h").alias("x"), F.col("b.h").alias("y"))
    return materialise(ends.union(classes).union(met), "met"), materialise(cut.join(full, "key", "left_semi"), "level")


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance in characters of two texts, or most + 1 if it is more: a bit-parallel column at a time, in a band.

    Bits 0 to 2 * most of the words stand for rows j - most to j + most of column j. Vertical differences (up, down), the zero
    diagonal and horizontal differences follow from the matches by word operations; the distance is followed down the lowest
    diagonal of the band, then along the last row.
    """
    width = 2 * most + 1
    mask = (1 << width) - 1

    def number(x: int) -> Column:
        return F.lit(x).cast("long")

    def no(x: Column) -> Column:
        return x.bitwiseXOR(number(mask))

    def bit(x: Column, at: Column) -> Column:
        return F.call_function("shiftrightunsigned", x, at).bitwiseAND(number(1)).cast("int")

    def run(s: Column) -> Column:
        m, n = ((F.octet_length(s[c]) / 4).cast("int") for c in "ab")  # four bytes a character

        def matches(j: Column) -> Column:
            char, out = F.substring(s["b"], 4 * j - 3, F.lit(4)), number(0)
            for k in range(width):
                i = j + (k - most)
                same = (i >= 1) & (F.substring(s["a"], F.greatest(4 * i - 3, F.lit(1)), F.lit(4)) == char)
                out = out.bitwiseOR(F.when(same, number(1 << k)).otherwise(number(0)))
            return out

        def step(acc: Column, j: Column) -> Column:
            up, down = acc["up"], acc["down"]

            def zero(match: Column) -> Column:
                carried = (match.bitwiseAND(up) + up).bitwiseXOR(up)
                return carried.bitwiseOR(match).bitwiseOR(down).bitwiseAND(number(mask))

            def moved(z: Column) -> Column:
                rise, fall, below = down.bitwiseOR(no(z.bitwiseOR(up))), z.bitwiseAND(up), F.shiftrightunsigned(z, 1)
                row = m - j + most  # the bit of the last row
                change = F.when(row >= 2 * most, 1 - bit(z, F.lit(2 * most))).otherwise(bit(rise, row) - bit(fall, row))
                return F.struct(fall.bitwiseOR(no(below.bitwiseOR(rise))).alias("up"), below.bitwiseAND(rise).alias("down"), (acc["distance"] + change).alias("distance"))

            following = let(let(matches(j), zero), moved)
            return F.when(acc["distance"] > 3 * most, acc).otherwise(following)  # more than the last row can make good

        begin = F.struct(number(mask ^ ((1 << most) - 1)).alias("up"), number(0).alias("down"), F.lit(most).alias("distance"))
        found = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), begin, step, lambda acc: acc["distance"])
        return F.when(F.abs(m - n) > most, most + 1).when(n == 0, m).when(m <= most, F.least(F.levenshtein(a, b), F.lit(most + 1))).otherwise(F.least(found, F.lit(most + 1)))

    return let(F.struct(F.encode(a, "UTF-32").alias("a"), F.encode(b, "UTF-32").alias("b")), run)


def alike(docs: DataFrame, least: int = 20, crowded: int = CROWDED) -> DataFrame:
    """(h, g, earlier): lines that have an earlier line within one edit, not equal, and where the earliest of those stands. `crowded` changes the way, never the result."""
    lines = lines_of(docs)
    pairs = near_pairs(lines, least, crowded)
    ends = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    ends = small(materialise(ends, "ends"), KNOWN)
    texts = lines.join(ends, "h").groupBy("h", "g", "line").agg(F.min(F.struct("doc_id", "no")).alias("first"))
    texts = materialise(texts, "texts")
    a = texts.select(F.col("h").alias("a"), F.struct("h", "g", "line", "first").alias("u"))
    b = texts.select(F.col("h").alias("b"), F.struct("h", "g", "line", "first").alias("v"))
    close = pairs.join(a, "a").join(b, "b").where(banded_distance(F.col("u.line"), F.col("v.line"), 1) == 1)
    after = F.col("u.first") > F.col("v.first")
    late = close.select(F.when(after, F.col("u")).otherwise(F.col("v")).alias("w"), F.when(after, F.col("v.first")).otherwise(F.col("u.first")).alias("earlier")).select("w.h", "w.g", "earlier")
    return late.groupBy("h", "g").agg(F.min("earlier").alias("earlier"))


def line_decisions(docs: DataFrame, least: int = 20, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, no, removed, near, head): for each line that has a word, whether it goes, whether for an alike line alone, and the line (doc_id, no) that stands for it.

    Lines with more than HOT occurrences are dealt to several tasks, and their decision goes to each.
    """
    occurrences = lines_of(docs).select("doc_id", "no", "h", "g")
    firsts = materialise(occurrences.groupBy("h", "g").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    known = firsts.join(alike(docs, least, crowded), ["h", "g"], "left").withColumn("head", F.least("first", "earlier"))  # nulls do not count
    deals = F.ceil(F.col("n") / HOT).cast("int")
    hot = firsts.where(F.col("n") > HOT).select("h", "g", deals.alias("deals"))
    dealt = occurrences.join(small(hot), ["h", "g"], "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("doc_id", "no"), F.col("deals")).cast("int"), F.lit(0))).drop("deals")
    known = known.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("n")
    found = dealt.join(known, ["h", "g", "deal"])
    equal = ~F.struct("doc_id", "no").eqNullSafe(F.col("first"))
    late = F.col("earlier").isNotNull()
    return found.select("doc_id", "no", (equal | late).alias("removed"), (~equal & late).alias("near"), "head")


def by_document(docs: DataFrame, least: int = 20, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_near, removed): removed holds (no, head) of the lines that go, ascending. Documents without lines are missing."""
    found = line_decisions(docs, least, crowded)
    one = lambda c: F.sum(F.col(c).cast("long"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), one("removed").alias("n_removed"), one("near").alias("n_near"), F.array_sort(F.collect_set(F.when(F.col("removed"), F.struct("no", "head")))).alias("removed"))


def remove_lines(docs: DataFrame, least: int = 20, crowded: int = CROWDED) -> DataFrame:
    """`docs` with the lines gone from its text; other columns, whatever their names, and rows stay, and so do texts of which nothing goes."""
    gone = by_document(docs, least, crowded).where("n_removed > 0").select(F.col("doc_id").alias("_doc"), F.transform("removed", lambda r: r["no"]).alias("_gone"))
    held = narrow(docs).join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left")

    def kept_lines(found: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col("_gone"))  # by a hash set, in order
        return F.array_join(F.transform(places, lambda i: found[i]), "\n")

    kept = let(F.split("text", "\n"), kept_lines)
    return wide(held.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)), docs)
