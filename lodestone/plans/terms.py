"""The terms of a question."""

from __future__ import annotations

from lodestone.operators import search

#: Words of a question that do not search.
STOP_WORDS = ("a", "about", "an", "and", "any", "are", "did", "do", "for", "from", "have", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "the", "there", "to", "was", "what", "when", "where", "which", "who", "why", "with")
NEGATIONS = ("not", "without", "except")


def terms_of(question: str) -> list[str]:
    """Terms of a question: stop words go, a negation takes the next word with it, long runs of digits are no words."""
    found, skip = [], False
    for term in search.query_terms(question):
        if term in NEGATIONS:
            skip = True
        elif skip:
            skip = False
        elif term not in STOP_WORDS and not (term.isdigit() and len(term) >= 8):
            found.append(term)
    return found or search.query_terms(question)
