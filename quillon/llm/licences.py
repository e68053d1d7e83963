"""License scans: Aho-Corasick over normalised words, and a shunting-yard parser for
licence expressions.

A text is normalised to its words (runs of letters and digits, A-Z as a-z), one
space apart, so one automaton finds all identifier tags and notice phrases in a
single pass over whole texts, overlapping ones too. Behind an identifier tag
stands an expression of the raw text, evaluated with ``with`` binding tightest, then
``and``, then ``or``: ``and`` needs both sides (the less permissive decides), ``or``
lets the reader choose (the more permissive), ``with`` adds an exception (halfway to
permissive).

The score is how permissive a document's terms are in all: 1 without any finding or
with permissive licences only, 0 when all rights are reserved; the least over its
findings.

Defined results: null and empty texts have no words, no places and score 1; an
expression that doesn't parse counts as label ``unparsed`` with score 0.5; unknown
licence names keep their lower-case name as label and score 0.5; repeated rows are
scanned each.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import buffers

# Notice phrases and their labels. The first three are the base.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public": "lgpl",
    "gnu affero general public": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "the unlicense": "unlicense",
    "isc license": "isc",
    "boost software license": "bsl",
}
TAG = "spdx license identifier"
#: How permissive licences are, by the beginning of their names.
PERMISSIVE = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by-nc": 0.3,
    "cc-by-nd": 0.3, "cc-by-sa": 0.6, "cc-by": 0.9, "mpl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "reserved": 0.0,
}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_RANK = {"or": 1, "and": 2, "with": 3}
#: ASCII that is neither letter nor digit becomes a space; bytes of other characters are letters.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def permissiveness(name: str) -> float:
    name = name.lower()
    best = max((k for k in PERMISSIVE if name.startswith(k)), key=len, default=None)
    return 0.5 if best is None else PERMISSIVE[best]


def postfix(expression: str) -> list[str]:
    """Shunting yard: operands and operators in postfix order. Raises ValueError if it
    isn't an expression."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether an operand has just ended
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _RANK:
            if not operand:
                raise ValueError(expression)
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = False
        elif token == "(":
            if operand:
                raise ValueError(expression)
            waiting.append(token)
        elif token == ")":
            if not operand:
                raise ValueError(expression)
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError(expression)
            waiting.pop()
        else:
            if operand:
                break  # a comment behind the expression
            out.append(token)
            operand = True
    if not operand:
        raise ValueError(expression)
    while waiting:
        if (w := waiting.pop()) == "(":
            raise ValueError(expression)
        out.append(w)
    return out


def evaluate(expression: str) -> tuple[float, list[str]]:
    """How permissive an expression is, and the names in it."""
    stack: list[tuple[float, str]] = []
    names = []
    for token in postfix(expression):
        if token in _RANK:
            (b, _), (a, name) = stack.pop(), stack.pop()
            stack.append((max(a, b) if token == "or" else min(a, b) if token == "and" else (1 + a) / 2, name))
            if token == "with":
                names.remove(_)
        else:
            stack.append((permissiveness(token), token))
            names.append(token)
    return stack[0][0], [n.lower() for n in names]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in (BASE | NOTICES).items():
        found.add_word(f" {phrase} ", (label, phrase.count(" ") + 1, phrase in BASE))
    found.add_word(f" {TAG} ", (None, 3, False))
    found.make_automaton()
    return found


_AUTOMATON: list = []


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score of a text."""
    listed = text.translate(_TABLE).split()
    if not listed:
        return 0, 0, None, None, "", "", 1.0
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    line = (b" " + b" ".join(listed) + b" ").decode("latin-1")  # one character for each byte
    places, base, labels, score, tagged = [], set(), set(), 1.0, False
    at = word = 0  # words that begin before at
    for end, (label, length, is_base) in _AUTOMATON[0].iter(line):
        if label is None:
            tagged = True
            continue
        word += line.count(" ", at, end + 1)
        at = end + 1
        labels.add(label)
        score = min(score, permissiveness(label))
        if is_base:
            base.add(label)
            places.append(word - 1 - length)  # the space behind the phrase is number start + length + 1
    if tagged:
        for m in _TAG.finditer(text.decode("utf-8", "replace")):
            try:
                value, names = evaluate(m[1])
                labels.update(names)
                score = min(score, value)
            except ValueError:
                labels.add("unparsed")
                score = min(score, 0.5)
    return len(listed), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanned(text: Column | str) -> Column:
    """A struct of what ``scan`` finds."""

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        at, data = buffers(texts)
        rows = [scan(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run(text)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan finds in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", scanned("text").alias("s")).select("doc_id", "s.*")


def licence_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these the base alone, which SQL can find too."""
    return op9_licences(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _sql_places(phrase: str) -> str:
    fits = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split(), 1))
    return f"list_filter(range(0, len(w)), lambda i: {fits})"


BASE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, [{", ".join(_sql_places(x) for x in BASE)}] AS places FROM d),
q AS (SELECT doc_id, n, places, flatten(places) AS every FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN len(places[{k}]) > 0 THEN '{label}' END" for k, label in enumerate(BASE.values(), 1))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM q
"""
