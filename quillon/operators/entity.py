"""Entity resolution of reports whose date, city and group are coded, by the rules of ``incidents``.

Scores of pairs are expressions. Clustering and dedup are greedy loops whose results hang on the
order, so a document's sentences go to one ``applyInArrow`` call, which runs ``incidents.group`` and
``incidents.dedup``; a document is the unit of parallelism. Pairs are those of one document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vocab
from quillon.functions.casualties import casualties
from quillon.functions.location import location
from quillon.operators import incidents

_CLUSTER = pa.schema([("doc", pa.int64()), ("seq", pa.int32()), ("cluster", pa.int32())])
_DEDUP = pa.schema([("doc", pa.int64()), ("seq", pa.int32()), ("day", pa.int32()), ("killed", pa.int32()), ("groups", pa.string()), ("n", pa.int32())])


def neighbour_jaccard(docs: DataFrame) -> DataFrame:
    """Word Jaccard of each document and the one with the next id."""
    a, b = docs.alias("a"), docs.alias("b")
    return a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 1).select("a.doc_id", F.round(T.jaccard(F.col("a.text"), F.col("b.text")), 6).alias("jaccard"))


def document_pairs(rows: DataFrame) -> DataFrame:
    """Each two rows of a document, the earlier as ``a``: an equi-join on the document."""
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.seq") < F.col("b.seq")))


def _sides(a: str, b: str):
    """Functions from a field to its columns in two told rows."""
    return (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))


def dates_match(a: str, b: str) -> Column:
    """Both known and a day apart at most."""
    x, y = _sides(a, b)
    return F.coalesce(F.abs(F.datediff(F.try_to_date(x("date"), "yyyy-MM-dd"), F.try_to_date(y("date"), "yyyy-MM-dd"))) <= 1, F.lit(False))


def places_match(a: str, b: str) -> Column:
    """The same city in any case of letters; the same state where neither has a city."""
    x, y = _sides(a, b)
    both = lambda f: (F.lower(x(f)) == F.lower(y(f))) & (x(f) != "")
    return F.when((x("city") != "") | (y("city") != ""), both("city")).otherwise(both("state"))


def groups_match(a: str, b: str) -> Column:
    x, y = _sides(a, b)
    return F.arrays_overlap(*[F.transform(side("responsible_groups"), F.lower) for side in (x, y)])


def texts_match(a: str, b: str) -> Column:
    x, y = _sides(a, b)
    return T.jaccard(x("text"), y("text")) > 0.3


CRITERIA = {"dates": dates_match, "places": places_match, "groups": groups_match, "texts": texts_match}


def should_merge(a: str, b: str) -> Column:
    """Whether two of the four criteria hold."""
    return sum((c(a, b).cast("int") for c in CRITERIA.values()), F.lit(0)) >= 2


def boundary_score(row: str, anchor: str) -> Column:
    """How much speaks for two told rows telling of different incidents."""
    x, y = _sides(row, anchor)
    differ = lambda f: ((x(f) != "") & (y(f) != "") & (x(f) != y(f))).cast("double")
    kinds = ((x("operation") != y("operation")) & (x("attack") != y("attack")) & (x("operation") != x("attack"))).cast("double")
    apart = lambda f: ((F.size(x(f)) > 0) & (F.size(y(f)) > 0) & ~F.arrays_overlap(x(f), y(f))).cast("double")
    return x("boundary").cast("double") + differ("date") + differ("city") + kinds + 0.5 * apart("attack_types") + 0.5 * apart("responsible_groups")


def place_similarity(a: str, b: str) -> Column:
    x, y = _sides(a, b)
    both = lambda f: (x(f) != "") & (y(f) != "")
    return F.when(both("city"), F.when(x("city") == y("city"), 1.0).otherwise(-0.5)).when(both("state"), F.when(x("state") == y("state"), 0.8).otherwise(-0.2)).when(both("country") & (x("country") == y("country")), 0.5).otherwise(0.0)


def date_similarity(a: str, b: str) -> Column:
    x, y = _sides(a, b)
    return F.when((x("date") != "") & (y("date") != ""), F.when(x("date") == y("date"), 1.0).otherwise(-0.5)).otherwise(0.0)


def _shared(a: str, b: str, *fields: str) -> Column:
    x, y = _sides(a, b)
    first, *more = [0.5 * F.arrays_overlap(x(f), y(f)).cast("double") for f in fields]
    return sum(more, first)


def actor_similarity(a: str, b: str) -> Column:
    return _shared(a, b, "responsible_groups", "target_organizations")


def attack_similarity(a: str, b: str) -> Column:
    return _shared(a, b, "attack_types", "weapon_types")


def nearness(gap: Column) -> Column:
    return F.when(gap <= 1, 1.0).when(gap == 2, 0.5).when(gap <= 4, 0.2).otherwise(0.0)


def similarity(row: str, anchor: str, gap: Column) -> Column:
    """The weighted likeness of two told rows that the clusterer goes by; -1 if they are apart."""
    w = vocab.CLUSTER
    score = w["loc"] * place_similarity(row, anchor) + w["date"] * date_similarity(row, anchor) + w["actor"] * actor_similarity(row, anchor) + w["attack"] * attack_similarity(row, anchor) + w["prox"] * nearness(gap)
    return F.when(boundary_score(row, anchor) >= 1, -1.0).when(gap <= 1, F.greatest(score, F.lit(w["threshold"]))).otherwise(score)


def pair_measures(rows: DataFrame) -> DataFrame:
    """doc, i, j and every criterion and partial likeness of each two reports of a document."""
    gap = F.col("b.seq") - F.col("a.seq")
    parts = {k: c("a", "b") for k, c in CRITERIA.items()} | {
        "boundary": boundary_score("b", "a"), "place": place_similarity("b", "a"), "date": date_similarity("b", "a"), "actor": actor_similarity("b", "a"), "attack": attack_similarity("b", "a"), "near": nearness(gap),
    }
    return document_pairs(told(rows)).select("a.doc", F.col("a.seq").alias("i"), F.col("b.seq").alias("j"), *[c.alias(k) for k, c in parts.items()])


def merge_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a document's reports that are one incident."""
    return document_pairs(told(rows)).where(should_merge("a", "b")).select("a.doc", F.col("a.seq").alias("i"), F.col("b.seq").alias("j"))


def pair_similarity(rows: DataFrame) -> DataFrame:
    """Likeness of each report and an earlier one of its document as its group's first and only one."""
    score = similarity("b", "a", F.col("b.seq") - F.col("a.seq"))
    return document_pairs(told(rows)).select("a.doc", F.col("a.seq").alias("i"), F.col("b.seq").alias("j"), F.round(score, 6).alias("similarity"))


def told(rows: DataFrame) -> DataFrame:
    """Reports as the sentences that ``incidents`` groups: date, city and group as they were coded, null
    as unknown, the rest from the text; target organisations aren't coded."""
    t, none = F.col("text"), F.array().cast("array<string>")
    found = rows.select(
        "doc", "seq", "text", "killed", F.coalesce(F.format_string("2019-04-%02d", "day"), F.lit("")).alias("date"), F.col("day").isNull().alias("undated"), F.coalesce("city", F.lit("")).alias("city"),
        F.when(F.col("grp").isNull(), none).otherwise(F.array("grp")).alias("responsible_groups"), location(t).alias("place"), none.alias("target_organizations"), casualties(t).alias("hurt"), incidents.terms(t).alias("terms"),
    )
    places = [F.coalesce(F.col("place")[c], F.lit("")).alias(c) for c in ("state", "country")]
    return found.select("doc", "seq", "text", F.when(F.col("undated"), "").otherwise(F.col("date")).alias("date"), "city", "responsible_groups", "target_organizations", "terms.*", *places, "hurt.killed", "hurt.injured")


def _cluster(table: pa.Table) -> pa.Table:
    groups = incidents.group(table.sort_by("seq").to_pylist())
    rows = [(r["doc"], r["seq"], i) for i, members in enumerate(groups) for r in members]
    return pa.table(dict(zip(_CLUSTER.names, zip(*rows, strict=True) if rows else [[]] * 3, strict=True)), schema=_CLUSTER)


def cluster_reports(rows: DataFrame) -> DataFrame:
    """doc, seq, cluster of every sentence that belongs to an incident, by ``incidents.group``."""
    return told(rows).groupBy("doc").applyInArrow(_cluster, "doc long, seq int, cluster int")


def _dedup(table: pa.Table) -> pa.Table:
    none = {f: set() for f in incidents.LISTS} | {"state": "", "country": "", "injured": 0, "location_confidence": 0.0}
    items = [none | r | {"responsible_groups": {r["grp"]} - {None}, "date": r["date"] or "", "city": r["city"] or "", "summary": r["text"] or ""} for r in table.sort_by("seq").to_pylist()]
    found = incidents.dedup(items)
    return pa.table({
        "doc": [i["doc"] for i in found], "seq": [i["seq"] for i in found], "day": [int(i["date"][8:]) if i["date"] else None for i in found], "killed": [i["killed"] for i in found],
        "groups": [",".join(sorted(i["responsible_groups"])) for i in found], "n": [i.get("n", 1) for i in found],
    }, schema=_DEDUP)


def dedup_reports(rows: DataFrame) -> DataFrame:
    """A document's reports after ``incidents.dedup``: two of date, place, group and wording agree."""
    coded = rows.select("doc", "seq", F.when(F.col("day").isNotNull(), F.format_string("2019-04-%02d", "day")).alias("date"), "city", "grp", "killed", "text")
    return coded.groupBy("doc").applyInArrow(_dedup, "doc long, seq int, day int, killed int, groups string, n int")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys; the last of a key wins."""
    last = new.withColumn("_at", F.monotonically_increasing_id())
    last = last.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at")))).where("_n = 1").drop("_at", "_n")
    return old.join(last.select(key), key, "left_anti").unionByName(last)
