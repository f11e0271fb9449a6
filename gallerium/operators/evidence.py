"""Evidence: which sentence and which spans of a text answer a query."""

from __future__ import annotations

import re

from ..functions import text as T


def excerpt(text: str, terms: set[str], limit: int = 700) -> str:
    """The sentence with most query terms (then the shortest, then the first), widened by neighbours while it fits."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", " ".join((text or "").split())) if s]
    if not sentences:
        return ""
    hits = [len(terms & set(T.fold_exact_py(s).split())) for s in sentences]
    low = high = min(range(len(sentences)), key=lambda i: (-hits[i], len(sentences[i]), i))
    while True:
        wider = [(low, high + 1)] * (high + 1 < len(sentences)) + [(low - 1, high)] * (low > 0)
        fits = next((w for w in wider if len(" ".join(sentences[w[0] : w[1] + 1])) <= limit), None)
        if fits is None:
            return " ".join(sentences[low : high + 1])[:limit]
        low, high = fits


def excerpts(query: str, limit: int = 700):
    terms = set(T.query_tokens(query))

    return T.by_text(lambda t: excerpt(t, terms, limit), "string")


def segments(text: str, query: str, mode: str = "whole_word") -> list[tuple[str, bool]]:
    """The text cut into runs that are highlighted or not: whole words, words of one stem, or words with the prefix."""
    wanted = T.fold_exact_py(query).split()
    stem = lambda w: re.sub(r"(ing|ed|es|s)$", "", w) if len(w) > 4 else w

    def hit(word: str) -> bool:
        folded = T.fold_exact_py(word)
        if mode == "prefix":
            return any(folded.startswith(w) for w in wanted)
        if mode == "english_stem":
            return stem(folded) in {stem(w) for w in wanted}
        return folded in wanted

    out: list[tuple[str, bool]] = []
    for part in re.findall(r"\w+|\W+", text or ""):
        marked = bool(part[0].isalnum() and hit(part))
        if out and out[-1][1] == marked:
            out[-1] = (out[-1][0] + part, marked)
        else:
            out.append((part, marked))
    return out


def highlighted(query: str, mode: str = "whole_word"):
    return T.by_text(lambda t: sum(m for _, m in segments(t, query, mode)), "int")
