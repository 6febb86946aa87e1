"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and cue words. From each anchor a
small parser walks to the boundaries of the email, address, number or secret around it and checks it (ranges, Luhn, mod 97).
Kinds are independent: spans of different kinds may overlap, spans of one kind never do.

Null text and empty text have no spans. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded

#: Kinds in the order in which spans are listed; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "account", "secret", "login")

DIGITS = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALNUM = DIGITS | UPPER | frozenset("abcdefghijklmnopqrstuvwxyz")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
VALUE = ALNUM | frozenset("_-+/=.")

#: Cue words (in lower case, upper case and title case) and the kind that they announce.
CUES = {
    "iban": "iban",
    "ssn": "ssn",
    "account": "account",
    "acct": "account",
    "token": "secret",
    "secret": "secret",
    "password": "secret",
    "passwd": "secret",
    "api_key": "secret",
    "apikey": "secret",
    "access_key": "secret",
}

_automaton = None


def automaton():
    """Built once for each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        found = ahocorasick.Automaton()
        for digit in DIGITS:
            found.add_word(digit, "digit")
        found.add_word("@", "email")
        found.add_word("+", "phone")
        found.add_word("://", "login")
        for cue, kind in CUES.items():
            for spelt in {cue, cue.upper(), cue.title()}:
                found.add_word(spelt, kind)
        found.make_automaton()
        _automaton = found
    return _automaton


def run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that begins at `at`."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def parse_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expand both ways from an at-sign; nothing before `floor` may be used."""
    begin = at
    while begin > floor and text[begin - 1] in LOCAL:
        begin -= 1
    end = run(text, at + 1, LABEL)
    if begin == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (after := run(text, end + 1, LABEL)) > end + 1:
        end, labels = after, labels + 1
    return (begin, end) if labels else None


def parse_dotted(text: str, at: int) -> tuple[int, int | None]:
    """End of a chain of dotted digit groups, and where its fourth group ends if it has four."""
    end, groups = run(text, at, DIGITS), 1
    while groups < 4 and end < len(text) and text[end] == "." and (after := run(text, end + 1, DIGITS)) > end + 1:
        end, groups = after, groups + 1
    return end, end if groups == 4 else None


def parse_digits(text: str, at: int) -> int:
    """End of a chain of digits with at most one space or hyphen between neighbours."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def parse_phone(text: str, at: int) -> int | None:
    """End of a number that begins at a plus sign."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end >= at + 4 else None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def only(text: str, allowed: frozenset) -> str:
    return "".join(c for c in text if c in allowed)


def _after_cue(text: str, end: int) -> int:
    """First place after a cue and its separators."""
    while end < len(text) and text[end] in " :=#\"'":
        end += 1
    return end


def parse_iban(text: str, end: int) -> tuple[int, int] | None:
    begin = _after_cue(text, end)
    stop, last = begin, begin
    while stop < len(text) and stop - begin < 42 and (text[stop] in UPPER or text[stop] in DIGITS or text[stop] == " "):
        stop += 1
        if text[stop - 1] != " ":
            last = stop
    for stop in range(last, begin + 14, -1):  # words may follow
        if text[stop - 1] == " " or stop < len(text) and text[stop] in ALNUM:
            continue
        code = text[begin:stop].replace(" ", "")
        if 15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return begin, stop
    return None


def parse_ssn(text: str, end: int) -> tuple[int, int] | None:
    begin = _after_cue(text, end)
    code = text[begin : begin + 11]
    whole = len(code) == 11 and code[3] == code[6] == "-" and all(c in DIGITS for c in code[:3] + code[4:6] + code[7:])
    return (begin, begin + 11) if whole and (begin + 11 == len(text) or text[begin + 11] not in ALNUM) else None


def parse_account(text: str, end: int) -> tuple[int, int] | None:
    begin = _after_cue(text, end)
    for word in ("number", "no."):
        if text[begin : begin + len(word)].lower() == word:
            begin = _after_cue(text, begin + len(word))
    stop = run(text, begin, DIGITS)
    return (begin, stop) if 8 <= stop - begin <= 17 and (stop == len(text) or text[stop] not in ALNUM) else None


def parse_secret(text: str, end: int) -> tuple[int, int] | None:
    """The value that is assigned to a cue: eight characters or more, with a letter and a digit."""
    begin = _after_cue(text, end)
    if not any(c in ":=" for c in text[end:begin]):
        return None
    stop = run(text, begin, VALUE)
    while stop > begin and text[stop - 1] == ".":
        stop -= 1
    value = text[begin:stop]
    return (begin, stop) if len(value) >= 8 and any(c in DIGITS for c in value) and any(c in ALNUM - DIGITS for c in value) else None


def parse_login(text: str, end: int) -> tuple[int, int] | None:
    """user:password before the host of an address."""
    stop = end
    while stop < len(text) and not text[stop].isspace() and text[stop] not in "/@?#\"'<>":
        stop += 1
    return (end, stop) if stop < len(text) and text[stop] == "@" and ":" in text[end:stop] else None


_CUED = {"iban": parse_iban, "ssn": parse_ssn, "account": parse_account, "secret": parse_secret, "login": parse_login}


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind as listed and then start."""
    found: list[tuple[str, int, int]] = []
    reach = dict.fromkeys(KINDS, 0)  # for each kind, where the last match or failed chain ends
    for last, kind in automaton().iter(text):
        if kind == "digit":
            if last >= reach["card"]:
                reach["card"] = end = parse_digits(text, last)
                if 13 <= len(digits := only(text[last:end], DIGITS)) <= 19 and luhn(digits):
                    found.append(("card", last, end))
            if last >= reach["ip"]:
                reach["ip"], fourth = parse_dotted(text, last)
                if fourth and all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in text[last:fourth].split(".")):
                    found.append(("ip", last, fourth))
        elif kind == "email":
            if span := parse_email(text, last, reach["email"]):
                found.append(("email", *span))
                reach["email"] = span[1]
        elif kind == "phone":
            if last >= reach["phone"] and (end := parse_phone(text, last)):
                reach["phone"] = end
                if 9 <= len(only(text[last:end], DIGITS)) <= 15:
                    found.append(("phone", last, end))
        elif last + 1 >= reach[kind] and (span := _CUED[kind](text, last + 1)):
            found.append((kind, *span))
            reach[kind] = span[1]
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for `docs` (doc_id, text); spans is an array of (kind, start, end, text). One row for each row."""

    def scan(batches):
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                spans = [[{"kind": k, "start": a, "end": b, "text": text[a:b]} for k, a, b in find(text)] if text else [] for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, shape)], names=["doc_id", "spans"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,text:string>>")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Text with each span replaced by its kind; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with its text masked; all other columns stay. Null stays null."""

    @F.pandas_udf("string")
    def udf(texts):
        return texts.map(lambda t: masked(t, find(t)), na_action="ignore")

    return docs.withColumn("text", udf("text"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
