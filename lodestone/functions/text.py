"""Scalar rules on text, tags and URLs. Empty text means absent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(*columns: Column) -> Column:
    """The first that is neither null nor empty, or empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def best_text(*columns: Column, length: int = 200) -> Column:
    return F.substring(F.trim(F.replace(present(*columns), F.lit("\n"), F.lit(" "))), 1, length)


def family(source_type: Column) -> Column:
    """What stands before the first underscore, unless nothing does."""
    return F.when(F.instr(source_type, "_") > 1, F.split_part(source_type, F.lit("_"), F.lit(1))).otherwise(source_type)


def tags(csv: Column) -> Column:
    """Trimmed tags in order, each once; empty ones go."""
    return F.array_distinct(F.filter(F.transform(F.split(csv, "[,\n]"), lambda t: F.trim(t)), lambda t: t != ""))


def tag_token(tag: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(tag), "[^a-z0-9]+", "-"), "^-|-$", "")


def has_tag(csv: Column, tag: str) -> Column:
    return F.array_contains(tags(csv), tag)


def compact(text: Column, length: int) -> Column:
    """White space runs become one space; cut with an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > length, F.concat(F.rtrim(F.substring(one, 1, length - 3)), F.lit("..."))).otherwise(one)


def tokens(text: Column) -> Column:
    """The analyser: lower case, runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def matched_terms(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text holds."""
    return reduce(lambda a, b: a + b, (F.when(F.contains(text, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))


def word_set(text: Column) -> Column:
    """Distinct words of two characters or more."""
    return F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) >= 2))


def containment(baseline: Column, candidate: Column) -> Column:
    """Share of the baseline's words that the candidate has; 0 without any."""
    return F.when(F.size(baseline) == 0, 0.0).otherwise(F.size(F.array_intersect(baseline, candidate)) / F.size(baseline))


def links(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>)]+)"), 1))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([\p{L}\p{N}_-]+)"), 1), lambda t: F.lower(t)))


#: What a page says when it was not read properly.
EMPTY_PAGE_PHRASES = (
    "redirecting",
    "you will be redirected",
    "if you are not redirected automatically",
    "loading...",
    "coming soon",
    "<div></div>",
    "we use cookies to improve user experience",
    "nothing to see here",
    "google drive",
    "your browser does not support frames",
    "click here to enter the site",
    "sign in or sign up",
    "you are not logged in",
    "manage account",
    "your profile",
    "continue with google",
    "continue with github",
    "open full screen to view more",
    "google apps",
)


def empty_page(text: Column, longest: int = 300) -> Column:
    """Short text with one of the phrases."""
    low = F.lower(F.trim(text))
    said = reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in EMPTY_PAGE_PHRASES))
    return (F.length(F.trim(text)) <= longest) & said


#: Kinds of failure and the texts that tell them, first match first.
FAILURE_KINDS = (
    ("dns_nxdomain", ("host does not resolve", "no such host", "nxdomain")),
    ("tls_certificate", ("self signed certificate", "unable to verify the first certificate", "altname invalid", "x509", "certificate")),
    ("cloudflare_edge", ("status 522", "status 523", "status 524", "status 525", "status 526")),
    ("x_article_shell", ("x article returned an x error shell",)),
    ("http_access_denied", ("status 401", "401 unauthorized", "status 403", "403 forbidden", "status 451", "451 unavailable")),
    ("unsupported_file", ("unsupported file type",)),
    ("timeout", ("signal: killed", "context deadline exceeded", "timeout", "timed out")),
    ("fetch_failed", ("fetch failed",)),
    ("rate_limited", ("status 429", "429 too many requests", "too many requests")),
    ("connectivity", ("unable to connect", "connection refused", "network is unreachable", "no route to host")),
    ("http_5xx", ("status 502", "status 503", "status 504")),
)

#: Failures of a kind after which no further attempt is made.
FINAL_ATTEMPT = {"unknown": 4, "fetch_failed": 4, "http_5xx": 4, "tls_certificate": 2, "cloudflare_edge": 2, "connectivity": 2, "x_article_shell": 2, "http_access_denied": 2, "timeout": 2, "dns_nxdomain": 1, "unsupported_file": 1}


def failure_kind(error: Column) -> Column:
    low = F.lower(F.trim(error))
    out = F.lit("unknown")
    for kind, texts in reversed(FAILURE_KINDS):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(t)) for t in texts)), kind).otherwise(out)
    return out


def final_attempt(kind: Column, failures: Column) -> Column:
    limit = F.lit(None).cast("int")
    for name, most in FINAL_ATTEMPT.items():
        limit = F.when(kind == name, most).otherwise(limit)
    return F.coalesce((failures > 0) & (failures >= limit), F.lit(False))


#: Query parameters that only track.
TRACKING = ("fbclid", "gclid", "igshid", "ref_src", "si")
VIDEO_HOSTS = ("youtube.com", "youtu.be")
VIDEO_TRACKING = ("t", "start", "feature")


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^m\.", "")
    return F.when(bare.isin("twitter.com", "mobile.twitter.com"), "x.com").otherwise(bare)


def url_kind(host: Column, path: Column) -> Column:
    return (
        F.when(host.isin("t.co", "pbs.twimg.com", "video.twimg.com"), "skip")
        .when(host == "x.com", F.when(F.startswith(path, F.lit("/i/article/")), "x_article").otherwise("skip"))
        .when(host == "github.com", "github")
        .when(host.isin(*VIDEO_HOSTS), "youtube")
        .when(F.endswith(F.lower(path), F.lit(".pdf")), "pdf")
        .otherwise("web")
    )


def _resolved(path: Column) -> Column:
    """Path without empty, `.` and `..` steps."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    up = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(up, "/"))


def normalised_url(raw: Column) -> Column:
    """A struct (url, kind, host, key); null for what is not a page to keep. Parameters are sorted by name."""
    url = F.trim(raw)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = url_host(url)
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+(:[0-9]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    video = host.isin(*VIDEO_HOSTS)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(name(p), F.lit("utm_")) & ~name(p).isin(*TRACKING) & ~(video & name(p).isin(*VIDEO_TRACKING)))
    kept = F.transform(F.array_sort(F.transform(kept, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("n"), i.alias("i"), p.alias("p")))), lambda s: F.when(F.contains(s["p"], F.lit("=")), s["p"]).otherwise(F.concat(s["p"], F.lit("="))))
    clean = _resolved(path)
    local = (host == "localhost") | host.rlike(r"^[0-9.]+$")
    whole = F.concat(F.when(local, scheme).otherwise("https"), F.lit("://"), host, port, clean, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    repo = F.regexp_extract(clean, r"^(/[^/]+/[^/]+)", 1)
    whole = F.when((host == "github.com") & (repo != ""), F.concat(F.lit("https://github.com"), repo)).otherwise(whole)
    kind = url_kind(host, path)
    key = F.concat(F.lit("src:"), F.substring(F.sha2(whole, 256), 1, 12))
    return F.when((host != "") & scheme.isin("http", "https") & (kind != "skip"), F.struct(whole.alias("url"), kind.alias("kind"), host.alias("host"), key.alias("key")))


def length_prefixed_sha256(*fields: Column) -> Column:
    """SHA-256 over fields, each after its size in eight bytes, big end first."""
    parts = [p for f in fields for p in (F.unhex(F.lpad(F.hex(F.octet_length(f)), 16, "0")), F.encode(f, "utf-8"))]
    return F.sha2(F.concat(*parts), 256)


def deletions(word: Column) -> Column:
    """The word and all that is left of it without one or two letters; for short words such as tags."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = without(word)
    return F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, without))))
