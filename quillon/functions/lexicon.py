"""All terms of the vocabularies that a text holds, found in one pass over it.

Terms are put together in patterns that share their beginnings, so a place of a text is tried once
for each first letter and not once for each term. Every term that begins somewhere is found, also
inside another one: the patterns look ahead without taking anything, and of two terms of which one
continues the other the shorter goes to a further pattern. What follows are array functions over
the few terms found."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(term: str) -> str:
    return re.sub(r"([.()\[\]{}*+?^$|\\])", r"\\\1", term)


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def layers(terms: Iterable[str], alone: bool) -> list[list[str]]:
    """Terms in lists in none of which two can begin at the same place of a text. ``alone``: terms
    end where a word does."""
    out: list[list[str]] = []
    for term in sorted(set(terms), key=lambda t: (-len(t), t)):

        def clash(longer: str, term: str = term) -> bool:
            return longer.startswith(term) and (not alone or _word(term[-1]) != _word(longer[len(term)]))

        free = next((layer for layer in out if not any(map(clash, layer))), None)
        if free is None:
            out.append([term])
        else:
            free.append(term)
    return out


def prefix_pattern(terms: Iterable[str]) -> str:
    """One pattern of terms that share their beginnings."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [escaped(c) + pattern(sub) for c, sub in sorted(node.items()) if c]
        ends = "" in node
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
        return body + "?" * ends

    return pattern(root)


class Lexicon:
    """``words`` stand alone, ``phrases`` anywhere in the text's small letters; ``cased`` stand alone as
    they are written."""

    def __init__(self, words: Iterable[str] = (), phrases: Iterable[str] = (), cased: Iterable[str] = ()):
        self.words = [rf"\b(?=({prefix_pattern(x)})\b)" for x in layers(words, True)]
        self.phrases = [f"(?=({prefix_pattern(x)}))" for x in layers(phrases, False)]
        self.cased = [rf"\b(?=({prefix_pattern(x)})\b)" for x in layers(cased, True)]

    def found(self, text: Column) -> Column:
        """struct(words, phrases, cased): the different terms of a text; none in null."""

        def hits(t: Column, patterns: list[str]) -> Column:
            if not patterns:
                return F.array().cast("array<string>")
            found = [F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns]
            return F.array_distinct(F.concat(*found) if len(found) > 1 else found[0])

        both = F.coalesce(text, F.lit(""))
        return let(both, lambda t: let(F.lower(t), lambda low: F.struct(hits(low, self.words).alias("words"), hits(low, self.phrases).alias("phrases"), hits(t, self.cased).alias("cased"))))


def of_lists(lists: Iterable[Iterable[str]], alone: Iterable[str] = (), anywhere: Iterable[str] = (), cased: Iterable[str] = ()) -> Lexicon:
    """A lexicon of lists in which single words stand alone and phrases anywhere, and of terms that
    all stand ``alone`` or ``anywhere``."""
    terms = list(chain.from_iterable(lists))
    return Lexicon([*(t for t in terms if " " not in t), *alone], [*(t for t in terms if " " in t), *anywhere], cased)


def _literal(terms: Iterable[str]) -> Column:
    return F.array(*map(F.lit, dict.fromkeys(terms)))


def _split(terms: list[str]) -> list[tuple[str, list[str]]]:
    parts = [("words", [t for t in terms if " " not in t]), ("phrases", [t for t in terms if " " in t])]
    return [(field, own) for field, own in parts if own]


def holds(found: Column, terms: list[str]) -> Column:
    """Whether a list has a term among those found."""
    parts = [F.arrays_overlap(found[field], _literal(own)) for field, own in _split(terms)]
    return parts[0] if len(parts) == 1 else parts[0] | parts[1]


def count(found: Column, terms: list[str]) -> Column:
    """How many different terms of a list are among those found."""
    parts = [F.size(F.array_intersect(found[field], _literal(own))) for field, own in _split(terms)]
    return parts[0] if len(parts) == 1 else parts[0] + parts[1]


def holds_in(found: Column, field: str, terms: list[str]) -> Column:
    return F.arrays_overlap(found[field], _literal(terms))


def listed(found: Column, field: str, terms: list[str]) -> Column:
    """The terms of a list among those found, in the list's order."""
    return F.array_intersect(_literal(terms), found[field])
