"""Quality rules that vote, weighed by expectation-maximisation.

Each rule says good, bad or nothing about a document. A two-class model gives each rule the chances of its votes among good and among bad
documents, that is, its accuracy; expectation-maximisation fits them to the counts of vote patterns over all documents, without labels.
A document is kept if its posterior chance of being good is at least the threshold and the base conditions hold.

Patterns are at most 3 to the number of rules, so their counts, and the fit on them, do not grow with the corpus. DataFrame and SQL functions only;
the fit itself runs on the driver over those counts.

Null and empty texts have no words and fail the base. All columns of the input stay, but for one named rules, which gives way to the verdict.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

SPACES = " \t\n\x0b\x0c\r"
GOOD, BAD, ABSTAIN = 1, -1, 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; none: an empty array."""
    return let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def repeated_words(words: Column, span: int) -> Column:
    """Words in windows of `span` words that occur more than once in the array."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (span - 1)), lambda i: F.xxhash64(F.slice(words, i, span)))

    def places(sorted_: Column) -> Column:
        """Where windows begin whose neighbour in hash order is equal, ascending."""
        n = F.size(sorted_)
        before = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))), F.slice(sorted_, 1, n - 1))
        both = F.arrays_zip(sorted_.alias("t"), before.alias("p"), F.slice(sorted_, 2, n).alias("n"))
        twice = F.filter(both, lambda x: (x["t"]["h"] == x["p"]["h"]) | (x["t"]["h"] == x["n"]["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["t"]["i"]))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def count(starts: Column) -> Column:
        return F.aggregate(starts, zero, lambda acc, i: F.struct((i + span).alias("end"), (acc["n"] + i + span - F.greatest(acc["end"], i)).alias("n")), lambda acc: acc["n"].cast("long"))

    def some(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(count(let(ordered, places)))

    return F.when(F.size(words) < span, F.lit(0).cast("long")).otherwise(let(hashes, some))


def statistics(text: Column) -> Column:
    """The counts that rules look at, in one struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    by_line = let(lines, lambda found: F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines")))
    by_word = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), repeated_words(w, 8).alias("n_repeat_words")))
    return F.struct(by_word.alias("w"), by_line.alias("l"), count(r"[#*$%&|<>]").alias("n_symbols"), count(r"[A-Z]").alias("n_upper"), count("!").alias("n_bangs"), count(r"\|").alias("n_bars"), F.length(text).cast("long").alias("n_chars"))


@dataclass(frozen=True)
class Rule:
    """A vote: bad where `bad` holds, good where `good` holds, else nothing."""

    name: str
    bad: Callable[[Column], Column]
    good: Callable[[Column], Column]

    def vote(self, s: Column) -> Column:
        return F.when(self.bad(s), BAD).when(self.good(s), GOOD).otherwise(ABSTAIN)


def _words(s: Column) -> Column:
    return s["w"]["n_words"]


def _never(s: Column) -> Column:
    return F.lit(False)


RULES = (
    Rule("length", lambda s: _words(s) < 20, lambda s: _words(s) >= 50),
    Rule("variety", lambda s: (_words(s) >= 30) & (100 * s["w"]["n_distinct"] < 20 * _words(s)), lambda s: 100 * s["w"]["n_distinct"] >= 35 * _words(s)),
    Rule("repeats", lambda s: 100 * s["w"]["n_repeat_words"] > 25 * _words(s), _never),
    Rule("symbols", lambda s: 10 * s["n_symbols"] > _words(s), _never),
    Rule("capitals", lambda s: 100 * s["n_upper"] > 30 * s["w"]["word_chars"], _never),
    Rule("bangs", lambda s: 10 * s["n_bangs"] > _words(s), _never),
    Rule("lines", lambda s: 100 * s["l"]["n_dup_lines"] > 40 * s["l"]["n_lines"], _never),
    Rule("word size", lambda s: (s["w"]["word_chars"] < 3 * _words(s)) | (s["w"]["word_chars"] > 12 * _words(s)), _never),
    Rule("tables", lambda s: 20 * s["n_bars"] > _words(s), _never),
)


@dataclass
class LabelModel:
    """Chance that a document is good, and for each rule the weights of its good and its bad vote: log P(vote | good) / P(vote | bad).

    An abstention says nothing.
    """

    prior: float
    weights: list[dict[int, float]]

    def posterior(self, votes: tuple[int, ...]) -> float:
        z = math.log(self.prior / (1 - self.prior)) + sum(w[v] for w, v in zip(self.weights, votes) if v != ABSTAIN)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

    def column(self, votes: list[Column]) -> Column:
        """The same as a column of the votes."""
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for w, v in zip(self.weights, votes):
            z = z + F.when(v == GOOD, w[GOOD]).when(v == BAD, w[BAD]).otherwise(0.0)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200, right: float = 0.9, strength: float = 0.5) -> LabelModel:
    """Expectation-maximisation over (votes, count).

    It begins with documents that any rule calls bad as likely bad. The prior on each rule says that its votes are `right`
    that often and counts as `strength` times its votes: it names the two classes, which votes alone leave open.
    """
    belief = [0.01 if BAD in votes else 0.99 for votes, _ in patterns]
    total = sum(n for _, n in patterns)
    model = LabelModel(0.5, [])
    for _ in range(rounds):
        good = sum(p * n for p, (_, n) in zip(belief, patterns))
        weights = []
        for r in range(rules):
            weight = {}
            for vote, share in ((GOOD, right), (BAD, 1 - right)):
                cast = sum(n for votes, n in patterns if votes[r] == vote)
                by_good = sum(p * n for p, (votes, n) in zip(belief, patterns) if votes[r] == vote)
                in_good = (by_good + strength * cast * share + share) / (good + 1)
                in_bad = (cast - by_good + strength * cast * (1 - share) + 1 - share) / (total - good + 1)
                weight[vote] = math.log(in_good / in_bad)
            weights.append(weight)
        model = LabelModel((good + 1) / (total + 2), weights)
        after = [model.posterior(votes) for votes, _ in patterns]
        moved = max((abs(a - b) for a, b in zip(after, belief)), default=0.0)
        belief = after
        if moved < 1e-6:
            break
    return model


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` (text and any others, less those in `drop`) with a struct `rules`: statistics s, votes, posterior, base_failed, kept."""
    held = docs.drop("rules").withColumn("rules", F.struct(statistics(F.col("text")).alias("s"))).drop(*drop)
    held = held.withColumn("rules", F.struct(F.col("rules.s").alias("s"), F.array(*(rule.vote(F.col("rules.s")).cast("int") for rule in rules)).alias("votes")))
    held = materialise(held, "votes")
    patterns = [(tuple(r.votes), r["count"]) for r in held.groupBy(F.col("rules.votes").alias("votes")).count().collect()]
    model = fit(sorted(patterns), len(rules))
    s, votes = F.col("rules.s"), F.col("rules.votes")
    failed = (_words(s) < 20) | (100 * s["w"]["n_repeat_words"] > 30 * _words(s))
    chance = model.column([votes[i] for i in range(len(rules))])
    return held.withColumn("rules", F.struct(s.alias("s"), votes.alias("votes"), chance.alias("posterior"), failed.alias("base_failed"), (~failed & (chance >= threshold)).alias("kept")))
