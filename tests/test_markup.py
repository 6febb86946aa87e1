"""Pages as Markdown and links of Markdown against plain parsers."""

import html
import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import markup as M


def plain_unescaped(text):
    def read(m):
        name = m[1]
        if name[0] != "#":
            return M.ENTITIES.get(name, m[0])
        n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return "\ufffd" if n == 0 or 0xD800 <= n <= 0xDFFF or n > 0x10FFFF else chr(n)

    return re.sub(r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", read, text)


class Page:
    """A reader with one character position, a stack of lists and a list of lines."""

    def __init__(self, source):
        self.s, self.i, self.out, self.lists, self.href, self.pre = source, 0, [], [], "", False

    def tag_end(self):
        """Where the tag at the position ends, quotes respected; else at the first `>` before any other bracket; else None."""
        if not re.match(r"</?[A-Za-z]", self.s[self.i :]):
            m = re.match(r"<[!?][^<>]*>", self.s[self.i :])
            return self.i + m.end() if m else None
        quote, j = "", self.i + 1
        while j < len(self.s):
            c = self.s[j]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == ">":
                return j + 1
            j += 1
        m = re.match(r"<[^<>]*>", self.s[self.i :])
        return self.i + m.end() if m else None

    def read(self):
        while self.i < len(self.s):
            if self.s.startswith("<!--", self.i) and (j := self.s.find("-->", self.i)) >= 0:
                self.i = j + 3
            elif self.s[self.i] == "<":
                end = self.tag_end()
                if end is None:
                    self.words("<")
                    self.i += 1
                else:
                    tag, self.i = self.s[self.i : end], end
                    self.tag(tag)
            else:
                j = self.s.find("<", self.i)
                j = len(self.s) if j < 0 else j
                self.words(self.s[self.i : j])
                self.i = j
        if self.href:
            self.out.append(f"]({self.href})")
        made = "".join(self.out)
        made = re.sub(" ?\n ?", "\n", re.sub(" +", " ", made))
        return re.sub("\n{3,}", "\n\n", made).strip("\n").strip(" ").replace("\ue000", " ").replace("\ue001", "\n")

    def words(self, text):
        text = plain_unescaped(text)
        if self.pre:
            self.out.append(text.replace("\r\n", "\n").replace("\t", "    ").replace(" ", "\ue000").replace("\n", "\ue001"))
        else:
            self.out.append(re.sub("[ \t\n\x0b\f\r]+", " ", text))

    def attribute(self, tag, name):
        m = re.search(rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", tag)
        return plain_unescaped("".join(g or "" for g in m.groups())).strip(" ") if m else ""

    def tag(self, tag):
        m = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", tag)
        if not m:
            return
        name, close = m[1].lower(), tag[1] == "/"
        if name in M.HIDDEN:
            if not close:
                while self.i < len(self.s):  # to the closing tag, over anything that reads as comment, tag or text
                    if self.s.startswith("<!--", self.i) and (j := self.s.find("-->", self.i)) >= 0:
                        self.i = j + 3
                        continue
                    if self.s[self.i] != "<" or (end := self.tag_end()) is None:
                        self.i += 1
                        continue
                    found, self.i = self.s[self.i : end], end
                    if re.match(rf"(?i)</{name}(?![A-Za-z0-9])", found):
                        break
        elif name == "a":
            if self.href:
                self.out.append(f"]({self.href})")
            self.href = "" if close else self.attribute(tag, "href")
            self.out.append("[" if self.href and not close else "")
        elif name in ("ul", "ol"):
            if close:
                self.out.append("\n\n" if len(self.lists) <= 1 else "\n")
                self.lists = self.lists[:-1]
            else:
                self.out.append("" if self.lists else "\n\n")
                self.lists.append(-1 if name == "ul" else 0)
        elif name == "li":
            if not close:
                mark = "- "
                indent = "\ue000\ue000" * (len(self.lists) - 1)
                if self.lists and self.lists[-1] >= 0:
                    self.lists[-1] += 1
                    mark = f"{self.lists[-1]}. "
                self.out.append(f"\n{indent}{mark}")
        elif name == "pre":
            self.pre = not close
            self.out.append("\ue001```\n\n" if close else "\n\n```\ue001")
        elif name in M.HEADINGS:
            self.out.append("\n\n" if close else "\n\n" + "#" * int(name[1]) + " ")
        elif name == "img":
            src = self.attribute(tag, "src")
            self.out.append(f"![{self.attribute(tag, 'alt')}]({src})" if src else "")
        elif name == "td" or name == "th":
            self.out.append(" | " if close else "")
        else:
            self.out.append({"br": "\n", "hr": "\n\n---\n\n", "tr": "\n"}.get(name, "\n\n" if name in M.BLOCKS else ""))


FIXED = [
    "<ul><li>a<ol><li>x<li>y</ol></li><li>b <a href='/q?a=1&amp;b=2'>link <b>bold</b></a></ul>after",
    "<p title=\"a > b\">x &lt;y&gt; &#65;&#x42;&#0;&#xD800; &nope; &amp;lt; &copy</p>",
    "<pre>  keep\n\tthis <b>x</b>\n</pre><h2>Two</h2><h6>Six</h6><img alt=A src=b.png><img alt=none>",
    "<script>if (a<b) { x = '</p>' }</script><style>p{}</style><p>t</p><!-- <p>no</p> --><!-- open",
    "<a href=/one>one <a href=/two>two</a> <a>none</a> </a> tail <a href=/x>open",
    "<table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table><hr>x<br/>y<br>z",
    "a < b <  c <3 <p", "", "<li>loose</li>", "</ul></ol>x", "<HEAD><title>no</title></HEAD><DIV>Up</DIV>", "<?xml v?><!DOCTYPE html>x", "<p \"unclosed>text", "\ue000x\ue001",
]


def made_up(rng):
    names = ["p", "div", "ul", "ol", "li", "li", "a", "b", "h1", "pre", "br", "td", "tr", "script", "span", "img"]
    out = []
    for _ in range(rng.randint(1, 900)):
        k = rng.random()
        if k < 0.35:
            out.append(rng.choice(["word ", " two  words", "&amp;", "\n", "x&lt;", "\t", "é", "<", '"']))
        else:
            name = rng.choice(names)
            out.append(f"</{name}>" if rng.random() < 0.4 else f'<{name} href="/{rng.randint(0, 9)}" src=s{rng.randint(0, 9)}>' if name in ("a", "img") else f"<{name}>")
    return "".join(out)


def test_markdown(spark):
    rng = random.Random(1)
    sources = FIXED + [made_up(rng) for _ in range(60)] + ["<ul>" + "<li>x" * 3000]
    df = spark.createDataFrame(list(enumerate(sources)), "i int, h string").repartition(4)
    got = dict(df.select("i", M.markdown(F.col("h"))).collect())
    for i, s in enumerate(sources):
        assert got[i] == Page(s.replace("\ue000", "").replace("\ue001", "")).read(), s[:200]
    assert spark.createDataFrame([(None,)], "h string").select(M.markdown(F.col("h"))).first()[0] is None


def test_markdown_of_nested_lists(spark):
    got = spark.createDataFrame([(FIXED[0],)], "h string").select(M.markdown(F.col("h"))).first()[0]
    assert got == "- a\n  1. x\n  2. y\n\n- b [link bold](/q?a=1&b=2)\n\nafter"


@pytest.mark.parametrize("name", ["pages"])
def test_markdown_of_all_pages(spark, name):
    df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    for r in df.select("html", M.markdown(F.col("html")).alias("md")).collect():
        assert r.md == Page(r.html).read()


def test_named_entities_are_those_of_html():
    assert all(html.unescape(f"&{k};") == v or k == "nbsp" for k, v in M.ENTITIES.items())


def plain_destinations(text):
    out, i = [], 0
    while (i := text.find("](", i)) >= 0:
        depth, j = 0, i + 2
        while j < len(text) and (text[j] != ")" or depth):
            depth += (text[j] == "(") - (text[j] == ")")
            j += 1
        if j == len(text):
            i += 1
            continue
        d = text[i + 2 : j].strip(" \t\n\x0b\f\r")
        out.append(d[1:-1] if len(d) > 1 and d[0] == "<" and d[-1] == ">" else d)
        i = j
    return out


LINKS = ["[a](b)", "[a [b](c) d](e)", "[x](a(b)c)", "[x](a [y](b)", "[x](<a b>)", "[x]( p \n)", "[x](", "](a)](b)", "((](c)))", "[n](a(b[m](c)d)e)f", "[x]()", "<](>)", "]](q)", ""]


def test_destinations(spark):
    rng = random.Random(6)
    texts = LINKS + ["".join(rng.choice(["](", "(", ")", "[", "]", "a", " ", "<b>", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", M.destinations(F.col("t"))).collect())
    for i, t in enumerate(texts):
        assert got[i] == plain_destinations(t), t


def plain_without_code(text):
    """Fences line by line, then runs of backticks that meet one of their own length."""
    lines, out, fence = text.split("\n"), [], None
    for line in lines:
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if fence is None and m and "`" not in m[2]:
            fence = m[1]
        elif fence is not None:
            if re.fullmatch(rf" {{0,3}}{re.escape(fence)}[`~]*[ \t]*", line):
                fence = None
                out.append(" ")
        else:
            out.append(line)
    if fence is not None:
        out.append(" ")
    text, i, done = "\n".join(out), 0, ""
    while i < len(text):
        m = re.match("`+", text[i:])
        if not m:
            done, i = done + text[i], i + 1
            continue
        end = re.search(rf"(?<!`){m[0]}(?!`)", text[i + len(m[0]) + 1 :])
        if end:
            done, i = done + " ", i + len(m[0]) + 1 + end.end()
        else:
            done, i = done + m[0], i + len(m[0])
    return done


def test_code_and_marked_ranges(spark):
    texts = ["a `[x](y)` b", "``a ` [x](y)`` z", "```\n[x](y)\n```\n[k](l)", "~~~ py\n[x](y)\n```\n~~~\nq", "```\nopen [x](y)", "`one [x](y)", "p\n   ````\n[x](y)\n```\n[z](z)\n`````  \nend [e](f)", "", "``", "a ``` [x](y) ``` b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", M.destinations(M.without_code(F.col("t")))).collect())
    assert got == {i: plain_destinations(plain_without_code(t)) for i, t in enumerate(texts)}
    marks = spark.createDataFrame([("a<!b>x<!e>c<!b>d<!e>e<!b>rest",), ("none",), ("<!b><!e>",)], "t string")
    assert [r[0] for r in marks.select(M.outside(F.col("t"), "<!b>", "<!e>")).collect()] == ["ace", "none", ""]


def test_resolved(spark):
    cases = [(a, d) for a in ("a.md", "x/y/a.md", "/r/a.md") for d in ("b.md", "../b.md", "../../../b.md", "/c/./d.md#f", "#only", "", ".", "..", "z//q/../w.md", "/", " s.md ")]
    got = [tuple(r) for r in spark.createDataFrame(cases, "a string, d string").select("a", "d", M.resolved(F.col("a"), F.col("d"))).collect()]
    for a, d, target in got:
        bare = d.strip(" ").split("#")[0].strip(" ")
        want = "" if not bare else posixpath.normpath(bare[1:] or ".") if bare[0] == "/" else posixpath.normpath(posixpath.join(posixpath.dirname(a).lstrip("/"), bare))
        assert target == want, (a, d)
    kinds = spark.createDataFrame([("http://a",), ("mailto:x",), ("//h/p",), ("a/b:c.md",), ("a.md",)], "d string")
    assert [r[0] for r in kinds.select(M.external(F.col("d"))).collect()] == [True, True, True, False, False]
