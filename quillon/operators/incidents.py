"""Reports to incidents: sentences with their fields, filled from neighbours, grouped, folded.

Dates, places and terms of sentences are columns, found in one narrow pass. What hangs on the
positions of matches (casualties, names) or on the order of a document's sentences (filling,
grouping, merging) is one ``mapInArrow`` that holds a document at a time. A document without an
incident gives no row; null and empty texts give none."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from quillon.functions import lexicon, vocab
from quillon.functions import text as T
from quillon.functions.casualties import casualties_of
from quillon.functions.lexicon import let
from quillon.functions.location import location
from quillon.functions.organisations import organisations_of

LISTS = ["attack_types", "weapon_types", "target_types", "responsible_groups", "target_organizations"]
PLACE = ["city", "state", "country"]
FIELDS = "date string, country string, state string, city string, location_confidence double, " + ", ".join(f"{c} array<string>" for c in LISTS) + ", killed int, injured int, summary string"


COLUMNS = ["incident_id", "doc_id", *(f.split()[0] for f in FIELDS.split(", "))]


def schema(doc_id: DataType) -> StructType:
    """Of incidents, whose documents have ids of any type."""
    return StructType([*StructType.fromDDL("incident_id string").fields, StructField("doc_id", doc_id), *StructType.fromDDL(FIELDS).fields])


def terms(text: Column) -> Column:
    """struct of all that the vocabularies say of a sentence, after one pass over it."""

    def whole(f: Column) -> Column:
        return F.struct(
            T.categories_of(f, vocab.ATTACK).alias("attack_types"), T.categories_of(f, vocab.WEAPON).alias("weapon_types"), T.categories_of(f, vocab.TARGET).alias("target_types"), T.detection_of(f)["class"].alias("class"),
            lexicon.holds_in(f, "words", T.ANCHORS).alias("anchor"), lexicon.holds_in(f, "phrases", vocab.BOUNDARIES).alias("boundary"),
            lexicon.holds_in(f, "words", vocab.OPERATION_ANCHORS).alias("operation"), lexicon.holds_in(f, "words", vocab.ATTACK_ANCHORS).alias("attack"),
        )

    return let(T.EVERYTHING.found(text), whole)


def sentence_events(docs: DataFrame) -> DataFrame:
    """A row for each sentence of (doc_id, text): its date, place and terms; the first has the whole
    text. Sentence ids count from 0 and keep their gaps later on, as distance is measured by them."""
    whole = F.col("text")
    parts = F.transform(T.sentences(whole), lambda s, i: F.struct(s.alias("text"), F.when(i == 0, whole).alias("whole")))
    t = F.col("x.text")
    return docs.select("doc_id", F.posexplode(parts).alias("seq", "x")).select("doc_id", "seq", "x.text", "x.whole", T.date_of(t).cast("string").alias("date"), location(t).alias("place"), terms(t).alias("terms"))


def told_of(row: dict) -> dict:
    """A sentence's row with all fields side by side, and its casualties and names."""
    groups, targets = organisations_of(row["text"])
    killed, injured = casualties_of(row["text"])
    return {k: row[k] for k in ("doc_id", "seq", "text", "whole")} | row["terms"] | {f: row["place"][f] or "" for f in PLACE} | {
        "date": row["date"] or "", "responsible_groups": groups, "target_organizations": targets, "killed": killed, "injured": injured,
    }


def _differ(a: dict, b: dict, field: str) -> bool:
    return bool(a[field] and b[field] and a[field] != b[field])


def _apart(a: dict, b: dict) -> bool:
    return a["boundary"] or b["boundary"] or (a["anchor"] and b["anchor"]) or _differ(a, b, "date") or _differ(a, b, "city") or "REJECT" in (a["class"], b["class"])


def fill(rows: list[dict]) -> None:
    """Dates and places from the sentence before, else the one after, unless something parts the
    two. In order and in place, so what a sentence was given it passes on."""
    for i, row in enumerate(rows):
        near = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows)]
        for key, fields in (("date", ["date"]), ("city", PLACE)):
            giver = next((n for n in near if not row[key] and n[key] and not _apart(n, row)), None)
            if giver is not None:
                row.update({f: giver[f] for f in fields})


def boundary_score(row: dict, anchor: dict) -> float:
    """How much speaks for two sentences telling of different incidents."""
    kinds = [(r["operation"], r["attack"]) for r in (row, anchor)]
    score = float(row["boundary"]) + _differ(row, anchor, "date") + _differ(row, anchor, "city") + (sorted(kinds) == [(False, True), (True, False)])
    return score + sum(0.5 for f in ("attack_types", "responsible_groups") if row[f] and anchor[f] and not set(row[f]) & set(anchor[f]))


def similarity(row: dict, anchor: dict, gap: int) -> float:
    """Weighted likeness of a sentence and a group's first, -1 if they are apart; ``gap`` is the distance
    to the nearest member."""
    w, a = vocab.CLUSTER, anchor
    if boundary_score(row, a) >= 1:
        return -1.0

    def shared(*fields: str) -> float:
        return sum(0.5 for f in fields if set(row[f]) & set(a[f]))

    if row["city"] and a["city"]:
        place = 1.0 if row["city"] == a["city"] else -0.5
    elif row["state"] and a["state"]:
        place = 0.8 if row["state"] == a["state"] else -0.2
    else:
        place = 0.5 if row["country"] and row["country"] == a["country"] else 0.0
    day = (1.0 if row["date"] == a["date"] else -0.5) if row["date"] and a["date"] else 0.0
    near = 1.0 if gap <= 1 else 0.5 if gap == 2 else 0.2 if gap <= 4 else 0.0
    score = w["loc"] * place + w["date"] * day + w["actor"] * shared("responsible_groups", "target_organizations") + w["attack"] * shared("attack_types", "weapon_types") + w["prox"] * near
    return max(score, w["threshold"]) if near == 1.0 else score


def group(rows: list[dict]) -> list[list[dict]]:
    """One pass in order: to the likest group at or over the threshold, the earliest of equals; else an
    accepted sentence with a signal begins one. A group's nearest member is its last."""
    groups: list[list[dict]] = []
    for row in rows:
        if row["class"] == "REJECT":
            continue
        scores = [similarity(row, g[0], row["seq"] - g[-1]["seq"]) for g in groups]
        best = max(scores, default=-1.0)
        if best >= vocab.CLUSTER["threshold"]:
            groups[scores.index(best)].append(row)
        elif row["class"] == "ACCEPT" and (row["anchor"] or row["attack_types"] or row["weapon_types"] or row["killed"] or row["injured"]):
            groups.append([row])
    return groups


def fold(members: list[dict], whole: Callable[[], tuple[list[str], list[str]]] = lambda: ([], [])) -> dict:
    """One incident of a group's sentences: first of each field, largest counts, unions of lists; names
    that it lacks are those of the ``whole`` text, which is only read for them."""
    out = {f: next((m[f] for m in members if m[f]), "") for f in ["date", *PLACE]}
    out |= {f: {x for m in members for x in m[f]} for f in LISTS}
    for i, f in enumerate(("responsible_groups", "target_organizations")):
        out[f] = out[f] or set(whole()[i])
    first = members[0]
    return out | {f: max(m[f] for m in members) for f in ("killed", "injured")} | {
        "summary": " ".join(m["text"] for m in members), "location_confidence": 1.0 if out["city"] else 0.5, "doc_id": first["doc_id"], "incident_id": f"{first['doc_id']}-{first['seq']}",
    }


def _words(item: dict) -> set[str]:
    """The words of an item's summary, found once."""
    if item.get("_said") != item["summary"]:
        item["_said"], item["_words"] = item["summary"], set(re.findall(r"\w+", item["summary"].lower()))
    return item["_words"]


def alike(a: dict, b: dict) -> bool:
    """Whether two of date (a day apart at most), place, groups and text (Jaccard over 0.3) agree."""
    days = [date.fromisoformat(x["date"]) if x["date"] else None for x in (a, b)]
    key = "city" if a["city"] or b["city"] else "state"
    names = [{g.lower() for g in x["responsible_groups"]} for x in (a, b)]
    signs = (None not in days and abs((days[0] - days[1]).days) <= 1) + (bool(a[key]) and a[key].lower() == b[key].lower()) + bool(names[0] & names[1])
    if signs != 1:  # the wording decides
        return signs > 1
    words = [_words(x) for x in (a, b)]
    return bool(words[0] and words[1]) and len(words[0] & words[1]) / len(words[0] | words[1]) > 0.3


def merge(a: dict, b: dict) -> dict:
    """``a`` with what ``b`` adds: the earlier date, the place of the one with a city, the larger
    counts, unions, sentences it hasn't; ``n`` counts what has been merged."""
    owner, rest = (a, b) if a["city"] or not b["city"] else (b, a)
    said = set(a["summary"].split(". "))
    more = [s for s in b["summary"].split(". ") if s not in said]
    return a | {f: owner[f] or rest[f] for f in PLACE} | {f: a[f] | b[f] for f in LISTS} | {f: max(a[f], b[f]) for f in ("killed", "injured", "location_confidence")} | {
        "date": min(filter(None, (a["date"], b["date"])), default=""), "summary": " ".join([a["summary"], ". ".join(more)]) if more else a["summary"], "n": a.get("n", 1) + b.get("n", 1),
    }


def dedup(items: list[dict]) -> list[dict]:
    """Merge each with the later ones that are like what it has become, until nothing changes."""
    while True:
        kept, left = [], items
        while left:
            head, *others = left
            left = []
            for other in others:
                if alike(head, other):
                    head = merge(head, other)
                else:
                    left.append(other)
            kept.append(head)
        if len(kept) == len(items):
            return kept
        items = kept


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Sentences of one document after another; a document may run on into the next batch."""
    told: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if told and row["seq"] == 0:
                yield told
                told = []
            told.append(told_of(row))
    if told:
        yield told


def of_sentences(told: list[dict]) -> list[dict]:
    """Incidents of one document's sentences in order."""
    fill(told)
    whole = cache(lambda: organisations_of(told[0]["whole"]))
    return dedup([fold(g, whole) for g in group(told)])


def build(docs: DataFrame) -> DataFrame:
    """Incidents of (doc_id, text) rows, with the text that each is embedded by. No shuffle: a document's
    sentences come out of its one row, so they follow each other in its partition. Rows that repeat an
    id are documents of their own."""
    made = schema(docs.schema["doc_id"].dataType)
    arrow = to_arrow_schema(made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for told in _documents(batches):
            if found := [{c: sorted(i[c]) if c in LISTS else i[c] for c in arrow.names} for i in of_sentences(told)]:
                yield pa.RecordBatch.from_pylist(found, arrow)

    found = sentence_events(docs).mapInArrow(run, made).withColumn("has_summary", F.trim("summary") != "")
    return found.withColumn("retrieval_text", T.retrieval_text({c: F.col(c) for c in found.columns}))


def process(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incidents and pictures of ingested documents (doc_id, source_type, title, raw_text, caption,
    image_embedding); every picture is an asset besides what its text tells of."""
    pictures = docs.where("source_type = 'IMAGE'")
    have = set(docs.columns)
    optional = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    assets = pictures.select(F.col("doc_id").alias("asset_id"), F.col("title").alias("filename"), F.col("raw_text").alias("ocr_text"), optional("caption", "string"), F.col("doc_id").alias("source_document_id"), optional("image_embedding", "array<float>"))
    return build(docs.select("doc_id", F.col("raw_text").alias("text"))), assets.withColumn("retrieval_text", T.image_text(F.col("caption"), F.col("ocr_text")))
