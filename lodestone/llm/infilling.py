"""Fill-in-the-middle: texts cut in three and put into another order, by a parallel scan with an automaton.

A text is cut into chunks. Each chunk gives, for every state in which it may begin, the state in which it ends and what it counts
(units that begin, and marker words that end). Such functions compose associatively, so the state before every chunk follows
from a prefix scan; a cut after k units lies in the chunk whose counts pass k, and only that chunk is looked at again.

Texts up to `giant` bytes are handled in one task each, many chunks in step. Longer ones are dealt out in parts to many
tasks: the parts' functions (some numbers for each) meet by text, and cuts are selected in the parts that hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise, narrow, pieces, utf8

#: Words that structure the output; a text that holds one stays as it is.
MARKERS = ("<P>", "<S>", "<M>")
#: Bytes that one automaton runs over in sequence.
CHUNK = 1024


class Automaton:
    """next[state, byte], and for each counter counts[state, byte]; state 0 begins a text."""

    def __init__(self, step: np.ndarray, counts: Sequence[np.ndarray]):
        self.states = len(step)
        self.step = np.ascontiguousarray(step, np.uint8).ravel()
        self.counts = [np.ascontiguousarray(c, np.int32).ravel() for c in counts]

    @classmethod
    def code_points(cls) -> Automaton:
        """A unit begins at each byte that does not continue a code point."""
        lead = (np.arange(256) & 0xC0) != 0x80
        return cls(np.zeros((1, 256)), [lead[None]])

    @classmethod
    def words(cls) -> Automaton:
        """A unit begins where a word does; words lie between U+0009 to U+000D and U+0020."""
        inside = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        return cls(np.stack([inside, inside]), [np.stack([inside, np.zeros(256, bool)])])

    @classmethod
    def occurrences(cls, words: Sequence[str]) -> Automaton:
        """Counts places where one of the words ends: the states are the words' beginnings."""
        coded = [w.encode() for w in words]
        heads = sorted({w[:i] for w in coded for i in range(len(w))} | {b""}, key=lambda h: (len(h), h))
        place = {h: i for i, h in enumerate(heads)}
        step, ends = np.zeros((len(heads), 256)), np.zeros((len(heads), 256))
        for h, i in place.items():
            for b in range(256):
                now = h + bytes([b])
                ends[i, b] = any(now.endswith(w) for w in coded)
                step[i, b] = next(place[now[j:]] for j in range(len(now) + 1) if now[j:] in place)
        return cls(step, [ends])

    def beside(self, other: Automaton) -> Automaton:
        """Both at once, with the counters of both."""
        pair = np.arange(self.states * other.states)
        a, b = pair // other.states, pair % other.states
        table = lambda flat, n: flat.reshape(n, 256)
        step = table(self.step, self.states)[a].astype(int) * other.states + table(other.step, other.states)[b]
        return Automaton(step, [*(table(c, self.states)[a] for c in self.counts), *(table(c, other.states)[b] for c in other.counts)])

    def functions(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exits [chunk, state], counts [chunk, counter, state]) of chunks of a buffer, all chunks in step."""
        size, n = end - begin, len(begin)
        order = np.argsort(-size, kind="stable")
        state = np.repeat(np.arange(self.states, dtype=np.intp)[:, None], n, 1)
        total = np.zeros((len(self.counts), self.states, n), np.int64)
        first, alive = begin[order], np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
        for at, live in enumerate(alive.tolist()):
            where = state[:, :live] * 256 + data[first[:live] + at]
            for c, table in enumerate(self.counts):
                total[c, :, :live] += table[where]
            state[:, :live] = self.step[where]
        exits, counts = np.empty((n, self.states), np.int64), np.empty((n, len(self.counts), self.states), np.int64)
        exits[order], counts[order] = state.T, total.transpose(2, 0, 1)
        return exits, counts

    def places(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """For each chunk and the state before it, the byte where the unit after `skip` units (of the first counter) begins."""
        out, now, left = end.copy(), state.astype(np.intp), skip.astype(np.int64) + 1
        live = np.arange(len(begin))
        for at in range(int((end - begin).max(initial=0))):
            live = live[(begin[live] + at < end[live]) & (left[live] > 0)]
            if not len(live):
                break
            where = now[live] * 256 + data[begin[live] + at]
            left[live] -= self.counts[0][where]
            now[live] = self.step[where]
            out[live[left[live] <= 0]] = begin[live[left[live] <= 0]] + at
        return out


def composed(exits: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix scan: chunk i becomes all chunks of its text up to and with i; `first` says with which chunk its text begins. Doubling steps."""
    exits, counts, index, width = exits.copy(), counts.copy(), np.arange(len(exits)), 1
    reach = int((index - first).max(initial=0)) + 1
    while width < reach:
        late = np.flatnonzero(index - width >= first)
        before = exits[late - width]
        counts[late] = counts[late - width] + np.take_along_axis(counts[late], before[:, None, :], 2)
        exits[late] = np.take_along_axis(exits[late], before, 1)
        width *= 2
    return exits, counts


class Scan:
    """The chunks of some texts in one buffer, with the state and the counts before each."""

    def __init__(self, automaton: Automaton, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, start: np.ndarray | None = None):
        size = np.diff(offsets)
        many = -(-size // chunk)
        self.first = np.concatenate([[0], np.cumsum(many)])
        self.owner = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(self.owner)) - self.first[self.owner]
        self.automaton, self.data = automaton, data
        self.begin = offsets[self.owner] + nth * chunk
        self.end = np.minimum(self.begin + chunk, offsets[self.owner + 1])
        exits, counts = composed(*automaton.functions(data, self.begin, self.end), self.first[self.owner])
        last = self.first[1:] - 1
        none = many == 0
        #: Of each text as a whole: exits and counts for every state in which it may begin.
        self.exits = np.where(none[:, None], np.arange(automaton.states), exits[last] if len(exits) else 0)
        self.counts = np.where(none[:, None, None], 0, counts[last] if len(counts) else np.zeros((len(size), *counts.shape[1:]), np.int64))
        start = np.zeros(len(size), np.int64) if start is None else start
        self.total = self.counts[np.arange(len(size)), :, start]
        own = start[self.owner]
        self.after = counts[np.arange(len(own)), 0, own]  # units up to the end of each chunk
        self.before = np.where(nth > 0, np.roll(self.after, 1), 0)
        self.entry = np.where(nth > 0, np.roll(exits[np.arange(len(own)), own], 1), own)
        self.offsets = offsets

    def cut(self, texts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The byte of each named text after so many units; the text's end if it has no more."""
        out = self.offsets[texts + 1] - self.offsets[texts]
        inside = np.flatnonzero(units < self.total[texts, 0])
        if len(inside):
            text, want = texts[inside], units[inside]
            stride = int(self.after.max()) + 1
            chunk = np.searchsorted(self.owner * stride + self.after, text * stride + want, "right")
            found = self.automaton.places(self.data, self.begin[chunk], self.end[chunk], self.entry[chunk], want - self.before[chunk])
            out[inside] = found - self.offsets[text]
        return out


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from seed and doc_id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _cuts(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = a % (n + 1), b % (n + 1)
    return np.minimum(x, y), np.maximum(x, y)


FOUND = "n long, markers long, low long, high long, low_byte long, high_byte long"


def _small(docs: DataFrame, automaton: Automaton, chunk: int) -> DataFrame:
    """docs (doc_id, text, _a, _b, ...) with what FOUND lists; texts stay in their tasks."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                data, offsets = utf8(part.column("text"))
                scan = Scan(automaton, data, offsets, chunk)
                n, markers = scan.total[:, 0], scan.total[:, 1]
                low, high = _cuts(n, part.column("_a").to_numpy(), part.column("_b").to_numpy())
                every = np.arange(len(n))
                found = [n, markers, low, high, scan.cut(every, low), scan.cut(every, high)]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, found)], schema=pa.schema([*part.schema, *((x, pa.int64()) for x in names)]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, {FOUND}")


def _giant(docs: DataFrame, automaton: Automaton, chunk: int, part_bytes: int) -> DataFrame:
    """The same for long texts, each dealt out in parts. A text's parts are at most 2 GB / `part_bytes`, the bound of one value."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.withColumn("_text", F.sha2(F.col("text"), 256))
    raw = F.encode("text", "utf-8")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / part_bytes).cast("int")), lambda i: F.substring(raw, i * part_bytes + 1, F.lit(part_bytes)))
    parts = keyed.dropDuplicates(["doc_id", "_text"]).select("doc_id", "_text", "_a", "_b", F.posexplode(cut).alias("part", "raw"))
    parts = materialise(parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "_text", "part"), "parts")
    states, counters = automaton.states, len(automaton.counts)

    def summaries(batches):
        for batch in batches:
            for rows in pieces(batch, "raw", 2 << 20):
                scan = Scan(automaton, *utf8(rows.column("raw")), chunk)
                lists = [pa.array(x.reshape(len(rows), -1).tolist(), pa.list_(pa.int64())) for x in (scan.exits, scan.counts)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "_text", "part", "_a", "_b")), *lists], names=["doc_id", "_text", "part", "_a", "_b", "exits", "counts"])

    functions = parts.mapInArrow(summaries, f"doc_id {kind}, _text string, part int, _a long, _b long, exits array<long>, counts array<long>")
    listed = F.array_sort(F.collect_list(F.struct("part", "exits", "counts")))
    zero = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("markers"), F.array().cast("array<struct<part:int,state:long,before:long,units:long>>").alias("held"))

    def step(acc: Column, x: Column) -> Column:
        at = lambda i: F.get(x["counts"], (acc["state"] + i * states).cast("int"))
        row = F.struct(x["part"].alias("part"), acc["state"].alias("state"), acc["n"].alias("before"), at(0).alias("units"))
        return F.struct(F.get(x["exits"], acc["state"].cast("int")).alias("state"), (acc["n"] + at(0)).alias("n"), (acc["markers"] + at(counters - 1)).alias("markers"), F.concat(acc["held"], F.array(row)).alias("held"))

    whole = functions.groupBy("doc_id", "_text", "_a", "_b").agg(listed.alias("l")).select("doc_id", "_text", "_a", "_b", F.aggregate("l", zero, step).alias("w"))
    draws = (F.pmod("_a", F.col("w.n") + 1), F.pmod("_b", F.col("w.n") + 1))
    texts = materialise(whole.select("doc_id", "_text", F.col("w.n").alias("n"), F.col("w.markers").alias("markers"), F.least(*draws).alias("low"), F.greatest(*draws).alias("high"), F.col("w.held").alias("held")), "texts")
    wanted = texts.select("doc_id", "_text", "held", F.explode(F.array("low", "high")).alias("unit")).distinct().select("doc_id", "_text", "unit", F.explode("held").alias("h"))
    wanted = wanted.where((F.col("unit") >= F.col("h.before")) & (F.col("unit") < F.col("h.before") + F.col("h.units"))).select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), F.col("h.part").alias("_p"), F.col("h.state").alias("state"), (F.col("unit") - F.col("h.before")).alias("skip"), "unit")
    asked = parts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")) & (F.col("part") == F.col("_p"))).select("doc_id", "_text", "part", "raw", "state", "skip", "unit")

    def select(batches):
        for batch in batches:
            for rows in pieces(batch, "raw", 2 << 20):
                scan = Scan(automaton, *utf8(rows.column("raw")), chunk, start=rows.column("state").to_numpy())
                at = scan.cut(np.arange(len(rows)), rows.column("skip").to_numpy()) + rows.column("part").to_numpy().astype(np.int64) * part_bytes
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("_text"), rows.column("unit"), pa.array(at)], names=["doc_id", "_text", "unit", "at"])

    places = asked.mapInArrow(select, f"doc_id {kind}, _text string, unit long, at long")
    found = places.groupBy("doc_id", "_text").agg(F.map_from_entries(F.collect_set(F.struct("unit", "at"))).alias("at"))  # two cuts at most
    t, f = texts.drop("held").select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "n", "markers", "low", "high"), found.select(F.col("doc_id").alias("_e"), F.col("_text").alias("_u"), "at")
    both = t.join(f, F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_t") == F.col("_u")), "left")
    place = lambda c: F.coalesce(F.try_element_at("at", F.col(c)), F.octet_length("text").cast("long")).alias(f"{c}_byte")
    return keyed.join(both, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))).select(*docs.columns, "n", "markers", "low", "high", place("low"), place("high"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone."""
    parts = F.split(output, "|".join(MARKERS))
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, units: Automaton | None = None, giant: int = 16 << 20, part_bytes: int = 4 << 20, chunk: int = CHUNK) -> DataFrame:
    """All columns of `docs` (doc_id, text) and fim: a struct of n (units), form (plain, psm, spm), prefix_units, middle_units (null if plain) and output.

    Places and form are drawn from seed and doc_id. Null text is empty; empty texts and texts with a marker are plain. Rows with equal doc_ids draw
    alike; null doc_ids draw as an empty id. A column named fim gives way. Texts over `giant` bytes take the way of many tasks; both ways
    give the same.
    """
    automaton = (units or Automaton.code_points()).beside(Automaton.occurrences(MARKERS))
    h = drawn(F.col("doc_id"), seed)
    rows = narrow(docs.drop("fim"))
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("_null"), "_others", *(x.alias(n) for x, n in zip(h, ("_a", "_b", "_c", "_d4"))))
    size = F.octet_length("text")
    found = _small(bounded(rows.where(size <= giant)), automaton, chunk).unionByName(_giant(rows.where(size > giant), automaton, chunk, part_bytes))
    plain = (F.col("text") == "") | (F.col("markers") > 0) | (F.col("_c") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("_d4") % 100 < spm_percent, "spm").otherwise("psm")
    raw = F.encode("text", "utf-8")
    stretch = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = stretch(F.lit(0), F.col("low_byte")), stretch(F.col("low_byte"), F.col("high_byte")), stretch(F.col("high_byte"), F.octet_length(raw))
    p, s, m = (F.encode(F.lit(x), "utf-8") for x in MARKERS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.decode(F.concat(p, prefix, s, suffix, m, middle), "utf-8")).otherwise(F.decode(F.concat(s, suffix, p, prefix, m, middle), "utf-8"))
    cut = lambda c, name: F.when(F.col("form") != "plain", c).alias(name)
    fim = F.struct("n", "form", cut(F.col("low"), "prefix_units"), cut(F.col("high") - F.col("low"), "middle_units"), output.alias("output"))
    text = F.when(~F.col("_null"), F.col("text")).alias("text")
    kept = [F.col("doc_id") if c == "doc_id" else text if c == "text" else F.col("_others")[c].alias(c) for c in docs.columns if c != "fim"]
    return found.withColumn("form", form).select(*kept, fim.alias("fim"))
