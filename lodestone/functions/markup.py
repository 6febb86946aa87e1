"""Web pages as Markdown, and the links of Markdown, as expressions.

Both are scans with a small state over a text's tokens (tags, brackets). Pages are folded in blocks of tokens, so that what is written
grows by blocks; the work is linear in the page but for `BLOCK` times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of characters that pages write as entities.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·", "euro": "€", "pound": "£", "sect": "§",
    "deg": "°", "times": "×", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç",
}
#: Elements whose content is no text, those that stand in lines of their own, and headings.
HIDDEN = ("head", "script", "style", "template", "noscript")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "figure", "footer", "form", "header", "html", "main", "nav", "p", "section", "table", "title")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A tag may hold `>` in quotes; a comment or tag that never ends is text.
TOKEN = r"""(?s)<!--.*?-->|</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[A-Za-z][^<>]*+>|<[!?][^<>]*+>|[^<]++|<"""
BLOCK = 256
#: Stand for a space and a line break that stay as they are; these two characters of a page itself go.
_KEPT_SPACE, _KEPT_BREAK = "\ue000", "\ue001"
_WHITE = r"[ \t\n\x0B\f\r]+"


def unescaped(text: Column) -> Column:
    """Named and numeric entities that end in a semicolon, read once; others stay."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def read(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.regexp_extract(name, r"^#[xX]?([0-9A-Fa-f]+)$", 1)
        code = F.when(F.startswith(F.lower(name), F.lit("#x")), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        wrong = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        char = F.when(wrong, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32"))
        found = F.when(F.startswith(name, F.lit("#")), char).otherwise(F.try_element_at(names, name))
        return F.when((name != "") & found.isNotNull(), F.concat(found, F.substring(part, F.length(name) + 2, F.length(part)))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), read), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(unescaped(F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))))


_STATE = "struct<hidden:string,pre:boolean,lists:array<int>,href:string,out:array<string>>"


def _step(s: Column, token: Column) -> Column:
    """The state after one token, with what it writes."""
    name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    close, tag = F.startswith(token, F.lit("</")), F.startswith(token, F.lit("<")) & (F.length(token) > 1)
    seen, here = s["hidden"] == "", lambda *names: name.isin(*names)
    hidden = F.when(seen & tag & ~close & here(*HIDDEN), name).when(~seen & close & (name == s["hidden"]), "").otherwise(s["hidden"])
    depth = F.size(s["lists"])
    counter = F.element_at(F.concat(F.array(F.lit(-1)), s["lists"]), -1)
    up = F.slice(s["lists"], F.lit(1), F.greatest(depth - 1, F.lit(0)))
    lists = F.when(~seen | ~tag, s["lists"]).when(here("ul", "ol"), F.when(close, up).otherwise(F.concat(s["lists"], F.array(F.when(name == "ul", -1).otherwise(0)))))
    lists = lists.when(here("li") & ~close & (counter >= 0), F.concat(up, F.array(counter + 1))).otherwise(s["lists"])
    pre = F.when(seen & tag & (name == "pre"), ~close).otherwise(s["pre"])
    link = seen & tag & (name == "a")
    href = F.when(link, F.when(close, "").otherwise(_attribute(token, "href"))).otherwise(s["href"])
    text = F.translate(unescaped(token), _KEPT_SPACE + _KEPT_BREAK, "")
    kept = F.translate(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit("    ")), " \n", _KEPT_SPACE + _KEPT_BREAK)
    words = F.when(s["pre"], kept).otherwise(F.regexp_replace(text, _WHITE, " "))
    mark = F.when(counter >= 0, F.concat((counter + 1).cast("string"), F.lit(". "))).otherwise("- ")
    item = F.concat(F.lit("\n"), F.repeat(F.lit(_KEPT_SPACE * 2), F.greatest(depth - 1, F.lit(0))), mark)
    ended = F.when(s["href"] != "", F.concat(F.lit("]("), s["href"], F.lit(")"))).otherwise("")
    image = _attribute(token, "src")
    written = (
        F.when(~seen, "")
        .when(~tag, words)
        .when(here("a"), F.concat(ended, F.when(~close & (href != ""), "[").otherwise("")))
        .when(here("br"), "\n")
        .when(here("hr"), "\n\n---\n\n")
        .when(here("tr"), "\n")
        .when(here("td", "th") & close, " | ")
        .when(here("li"), F.when(close, "").otherwise(item))
        .when(here("ul", "ol"), F.when(F.when(close, depth <= 1).otherwise(depth == 0), "\n\n").when(close, "\n").otherwise(""))
        .when(here("pre"), F.when(close, F.lit(f"{_KEPT_BREAK}```\n\n")).otherwise(f"\n\n```{_KEPT_BREAK}"))
        .when(here(*HEADINGS), F.concat(F.lit("\n\n"), F.when(close, "").otherwise(F.concat(F.repeat(F.lit("#"), F.right(name, F.lit(1)).cast("int")), F.lit(" ")))))
        .when(here("img") & (image != ""), F.concat(F.lit("!["), _attribute(token, "alt"), F.lit("]("), image, F.lit(")")))
        .when(here(*BLOCKS), "\n\n")
        .otherwise("")
    )
    out = F.when(written == "", s["out"]).otherwise(F.concat(s["out"], F.array(written)))
    return F.struct(hidden.alias("hidden"), pre.alias("pre"), lists.alias("lists"), href.alias("href"), out.alias("out")).cast(_STATE)


def markdown(html: Column) -> Column:
    """A page as Markdown: headings, paragraphs, nested lists, links, images, preformatted text; hidden elements, comments and other tags go.

    White space runs become one space, empty lines at most one. A list item begins with `- ` or its number, two spaces deeper for each list around
    it. A link without address is its text; one inside another ends it. Entities are read in text and addresses. Null stays null.
    """
    start = F.struct(F.lit("").alias("hidden"), F.lit(False).alias("pre"), F.array().cast("array<int>").alias("lists"), F.lit("").alias("href"), F.array().cast("array<string>").alias("out")).cast(_STATE)
    bare = lambda s, out: F.struct(s["hidden"].alias("hidden"), s["pre"].alias("pre"), s["lists"].alias("lists"), s["href"].alias("href"), out.alias("out")).cast(_STATE)
    none = F.array().cast("array<string>")

    def whole(tokens: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(tokens), F.lit(1)) - 1) / BLOCK).cast("int"))

        def block(s: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(tokens, i * BLOCK + 1, F.lit(BLOCK)), bare(s, none), _step)
            return F.transform(F.array(part), lambda p: bare(p, F.concat(s["out"], F.array(F.array_join(p["out"], "")))))[0]

        return F.aggregate(blocks, start, block, lambda s: F.concat(F.array_join(s["out"], ""), F.when(s["href"] != "", F.concat(F.lit("]("), s["href"], F.lit(")"))).otherwise("")))

    made = F.transform(F.array(F.regexp_extract_all(html, F.lit(TOKEN), 0)), whole)[0]
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(made, " +", " "), " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.when(html.isNotNull(), F.translate(F.trim(F.regexp_replace(lines, r"^\n+|\n+$", "")), _KEPT_SPACE + _KEPT_BREAK, " \n"))


def outside(text: Column, begin: str, end: str) -> Column:
    """Text without the stretches between two marks; one that never ends takes the rest."""
    parts = F.split(text, f"\\Q{begin}\\E")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(F.contains(p, F.lit(end)), F.substring(p, F.instr(p, end) + len(end), F.length(p))).otherwise(""))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def without_code(text: Column) -> Column:
    """Fenced blocks (to their closing fence or the end) and code in lines become a space."""
    fenced = F.regexp_replace(text, r"(?sm)^ {0,3}(`{3,}|~{3,})(?=[^`\n]*(?:\n|\z)).*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)", " ")
    return F.regexp_replace(fenced, r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", " ")


def destinations(text: Column) -> Column:
    """Where links lead, in order: what stands between `](` and the bracket that closes it, trimmed, without `<` and `>` around it.

    Brackets inside nest. A link inside the brackets of another is part of it, unless the outer one never ends.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"\]\(|[()]|\](?!\()|[^()\]]+"), 0)
    zero = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<a:int,b:int>>").alias("found"))

    def scan(ts: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            t, depth = F.element_at(ts, i), F.size(s["open"])
            top, down = F.element_at(F.concat(F.array(F.lit(0)), s["open"]), -1), F.slice(s["open"], F.lit(1), F.greatest(depth - 1, F.lit(0)))
            opened = F.when(t == "](", F.concat(s["open"], F.array(i))).when((t == "(") & (depth > 0), F.concat(s["open"], F.array(-i))).when((t == ")") & (depth > 0), down).otherwise(s["open"])
            closes = (t == ")") & (depth > 0) & (top > 0)
            found = F.when(closes, F.concat(F.filter(s["found"], lambda f: f["a"] < top), F.array(F.struct(top.alias("a"), i.alias("b"))))).otherwise(s["found"])
            return F.struct(opened.alias("open"), found.alias("found"))

        spans = F.aggregate(F.filter(F.sequence(F.lit(1), F.greatest(F.size(ts), F.lit(1))), lambda i: F.try_element_at(ts, i).isin("](", "(", ")")), zero, step, lambda s: s["found"])
        return F.transform(spans, lambda f: F.trim(F.regexp_replace(F.array_join(F.slice(ts, f["a"] + 1, f["b"] - f["a"] - 1), ""), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")))

    raw = F.transform(F.array(tokens), scan)[0]
    return F.transform(raw, lambda d: F.when(F.startswith(d, F.lit("<")) & F.endswith(d, F.lit(">")) & (F.length(d) > 1), F.substring(d, F.lit(2), F.length(d) - 2)).otherwise(d))


def resolved(path: Column, destination: Column) -> Column:
    """The file that a link in the file `path` means: no fragment, `.` and `..` worked out, from the root if it begins with a slash; empty if nothing is left."""
    bare = F.trim(F.split_part(destination, F.lit("#"), F.lit(1)))
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    whole = F.when(F.startswith(bare, F.lit("/")), F.substring(bare, F.lit(2), F.length(bare))).otherwise(F.concat(folder, F.lit("/"), bare))
    steps = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))

    def walk(done: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    clean = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")
    return F.when(bare == "", "").when(clean == "", ".").otherwise(clean)


def external(destination: Column) -> Column:
    """A scheme, or `//`, or `mailto:`."""
    return F.regexp_like(destination, F.lit(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"))
