"""Casualty counts. Match positions decide which numbers count, and Spark's functions don't
return positions, so this is an Arrow function over batches of texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
FUZZY = {"dozens": 24, "scores": 40, "several": 3, "both": 2}
# Patterns in order of precedence; group 1 is the number. Before each stands a word
# without which it can't match.
_GAP = r"(?:(?!{})\S+\s+){{0,15}}"
KILLED = [
    ("killed", r"(\d+)\s+" + _GAP.format("injured|wounded|hurt|hospitali") + r"(?:were\s+)?killed"), ("killed", r"killed\s+(\d+)(?:\s+people)?"), ("killing", r"killing\s+(\d+)(?:\s+people)?"), ("dead", r"(\d+)\s+(?:people\s+)?dead"),
    ("fatalities", r"(\d+)\s+fatalities"), ("deaths", r"(\d+)\s+deaths"), ("dead", r"left\s+(\d+)\s+dead"), ("claimed", r"claimed\s+(?:the\s+lives\s+of\s+)?(\d+)\s+lives?"), ("claimed", r"claimed\s+(\d+)\s+lives"),
    ("toll", r"death\s+toll\s+(?:of|rose\s+to|reached|stands\s+at)\s+(\d+)"), ("died", r"(\d+)\s+" + _GAP.format("killed|dead|fatalities") + r"died"), ("deaths", r"deaths\s+of\s+(\d+)"), ("death", r"resulted\s+in\s+the\s+deaths?\s+of\s+(\d+)"),
]
INJURED = [
    ("injured", r"(\d+)\s+" + _GAP.format("killed|dead|died|fatalities") + r"(?:were\s+)?injured"), ("injuring", r"injuring\s+(\d+)(?:\s+\w+)?"), ("injured", r"injured\s+(\d+)(?:\s+\w+)?"),
    ("injured", r"injured\s+(?:more\s+than|at\s+least|over|approximately|around|nearly|about)\s+(\d+)"), ("wounded", r"(\d+)\s+" + _GAP.format("killed|dead|died|fatalities") + r"(?:were\s+)?wounded"), ("wounding", r"wounding\s+(\d+)(?:\s+people)?"),
    ("hurt", r"(\d+)\s+(?:people\s+)?(?:were\s+)?hurt"), ("left", r"left\s+(\d+)\s+(?:injured|wounded|hurt)"), ("hospitali", r"(\d+)\s+(?:\w+\s+)?(?:were\s+)?hospitali[sz]ed"),
]
PREFIX = r"(?:at\s+least|more\s+than|over|approximately|around|nearly|about|up\s+to)?\s*"
# Numbers that share a verb, victims besides the attacker, and an attacker's death.
SHARED = r"(\d+)\s+\S+\s+(?:and|&|,)\s+\d+\s+\S+\s+(?:were\s+)?(?:{})"
SHARED_VERBS = {"killed": "killed|dead|died|fatalities", "injured": "injured|wounded|hurt"}
ADDED = r"in\s+addition\s+to\s+(?:the\s+)?(?:assailant|attacker|bomber|suicide bomber)|besides\s+(?:the\s+)?(?:assailant|attacker|bomber)"
ATTACKER = r"(?:assailant|gunman|attacker|bomber).{0,30}died"

VALUES = {w: i for i, w in enumerate(ONES)} | {w: 20 + 10 * i for i, w in enumerate(TENS)} | FUZZY
_NUMBER = re.compile(rf"\b({'|'.join(sorted(VALUES, key=len, reverse=True))})(?:\s*[-\s]\s*({'|'.join(ONES)}))?\b", re.IGNORECASE)
_COMPILED = {name: [(word, re.compile(PREFIX + p, re.IGNORECASE)) for word, p in patterns] for name, patterns in (("killed", KILLED), ("injured", INJURED))}
_BOTH = {name: re.compile(SHARED.format(verbs), re.IGNORECASE) for name, verbs in SHARED_VERBS.items()}
_ADDED = re.compile(ADDED, re.IGNORECASE)
_ATTACKER = re.compile(ATTACKER, re.IGNORECASE)
#: A text needs a number and a verb, or an attacker, to have counts. In the JVM, so that other texts
#: never get here; some of those that do have none.
_SOME = r"(?i)assailant|attacker|bomber|gunman|\d|\b(?:" + "|".join(VALUES) + r")\b"
_VERB = r"(?i)kill|dead|death|fatalit|claimed|died|injur|wound|hurt|hospitali|addition|besides"


def digits(text: str) -> str:
    """Number words as digits; tens join a following word below ten."""

    def number(m: re.Match) -> str:
        first, second = m[1].lower(), (m[2] or "").lower()
        if not second:
            return str(VALUES[first])
        return str(VALUES[first] + VALUES[second]) if first in TENS and VALUES[second] < 10 else m[0]

    return _NUMBER.sub(number, text)


def total(text: str, name: str, low: str | None = None) -> int:
    """Sum over matches that overlap none taken before, pattern by pattern, plus the first
    numbers of pairs that share a verb."""
    low = text.casefold() if low is None else low
    taken: list[tuple[int, int]] = []
    out = 0
    for word, pattern in _COMPILED[name]:
        if word not in low:
            continue
        for m in pattern.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
                out += int(m[1])
    return out + sum(int(m[1]) for m in _BOTH[name].finditer(text))


def casualties_of(text: str) -> tuple[int, int]:
    plain = digits(text)
    low = plain.casefold()
    killed = total(plain, "killed", low) + bool(_ADDED.search(plain))
    return killed or int(bool(_ATTACKER.search(text))), total(plain, "injured", low)


def casualties(text: Column) -> Column:
    """struct(killed, injured), at most the largest int; 0 and 0 of null."""

    @F.arrow_udf("killed int, injured int")
    def run(texts: pa.Array) -> pa.Array:
        rows = [(0, 0) if t is None else casualties_of(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([min(r[i], 2**31 - 1) for r in rows], pa.int32()) for i in (0, 1)], ["killed", "injured"])

    return run(F.when(text.rlike(_SOME) & text.rlike(_VERB), text))
