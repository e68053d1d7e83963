"""Measures of extraction, clustering and retrieval against what is known to be right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vocab
from quillon.functions.casualties import casualties
from quillon.functions.lexicon import let

SCALARS = ["date", "country", "state", "city", "killed", "injured"]
LISTS = ["responsible_groups", "target_organizations", "attack_types", "weapon_types", "target_types"]


def normal(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)), F.lit(""))


def exact_match(expected: Column, actual: Column) -> Column:
    """Texts agree but for case and outer spaces; null is empty."""
    return normal(expected) == normal(actual)


def numeric_match(expected: Column, actual: Column) -> Column:
    return expected.eqNullSafe(actual)


def mapped_match(label: Column, predicted: Column, mapping: dict[str, list[str]]) -> Column:
    """Whether one of the categories that a source's label stands for is predicted; a label that stands
    for none is never right."""
    wanted = F.coalesce(*[F.when(label == k, F.array(*map(F.lit, v))) for k, v in mapping.items()], F.array().cast("array<string>"))
    return F.coalesce(F.arrays_overlap(wanted, predicted), F.lit(False))


def set_score(expected: Column, actual: Column) -> Column:
    """struct(precision, recall, f1, tp, fp, fn) of two lists. Expected items take, in order, the first
    item not yet taken that holds them or that they hold; two empty lists agree wholly."""
    none = F.array().cast("array<string>")
    clean = lambda items: F.transform(F.coalesce(items, none), normal)

    def scored(x: Column) -> Column:
        e, a = x["e"], x["a"]
        places = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))

        def take(used: Column, item: Column) -> Column:
            fits = F.filter(places, lambda i: ~F.array_contains(used, i) & (F.contains(F.get(a, i), item) | F.contains(item, F.get(a, i))))
            return F.concat(used, F.slice(fits, 1, 1))

        tp = F.size(F.aggregate(e, F.array().cast("array<int>"), take))
        return let(F.struct(tp.alias("tp"), (F.size(a) - tp).alias("fp"), (F.size(e) - tp).alias("fn")), rated)

    def rated(c: Column) -> Column:
        ratio = lambda n, d: F.coalesce(F.try_divide(n.cast("double"), d), F.lit(0.0))
        empty = (c["tp"] + c["fp"] + c["fn"]) == 0
        p, r = (F.when(empty, 1.0).otherwise(ratio(c["tp"], c["tp"] + c[other])) for other in ("fp", "fn"))
        return F.struct(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), c["tp"].alias("tp"), c["fp"].alias("fp"), c["fn"].alias("fn"))

    return let(F.struct(clean(expected).alias("e"), clean(actual).alias("a")), scored)


def coded_results(rows: DataFrame) -> DataFrame:
    """field, unknown, correct, summary, ground_truth, prediction of every coded field of every summary,
    extracted from it. Expects summary and the coded columns attacktype1_txt, weaptype1_txt,
    targtype1_txt, nkill, nwound. An unknown field is right if nothing is predicted."""
    t, c = F.col("summary"), F.col
    found = rows.select("*", T.attack_types(t).alias("_attack"), T.weapon_types(t).alias("_weapon"), T.target_types(t).alias("_target"), casualties(t).alias("_hurt"))
    parts = []
    for field, label, got, mapping in (("attack_type", "attacktype1_txt", "_attack", "attack"), ("weapon_type", "weaptype1_txt", "_weapon", "weapon"), ("target_type", "targtype1_txt", "_target", "target")):
        unknown = F.coalesce(c(label) == "Unknown", F.lit(False))
        right = F.when(unknown, F.size(got) == 0).otherwise(mapped_match(c(label), c(got), vocab.LABEL_MAPS[mapping]))
        parts.append(F.struct(F.lit(field).alias("field"), unknown.alias("unknown"), right.alias("correct"), c(label).alias("ground_truth"), F.array_join(got, ", ").alias("prediction")))
    for field, label, got in (("killed", "nkill", "killed"), ("wounded", "nwound", "injured")):
        want, have = T.parse_casualty(c(label)), c("_hurt")[got]
        right = F.when(want.isNull(), have == 0).otherwise(have == want)
        parts.append(F.struct(F.lit(field).alias("field"), want.isNull().alias("unknown"), right.alias("correct"), want.cast("string").alias("ground_truth"), have.cast("string").alias("prediction")))
    return found.select("summary", F.inline(F.array(*parts)))


def field_metrics(results: DataFrame) -> DataFrame:
    """field, total, known, correct, correct_unknown, accuracy_known, accuracy_all (per cent) of ``coded_results``."""
    known = ~F.col("unknown")
    counts = results.groupBy("field").agg(F.count("*").alias("total"), F.count_if(known).alias("known"), F.count_if(known & F.col("correct")).alias("correct"), F.count_if(~known & F.col("correct")).alias("correct_unknown"))
    pct = lambda n, d: F.round(F.coalesce(F.try_divide(n * 100.0, d), F.lit(0.0)), 6)
    return counts.withColumn("accuracy_known", pct(F.col("correct"), F.col("known"))).withColumn("accuracy_all", pct(F.col("correct") + F.col("correct_unknown"), F.col("total")))


def coded_failures(results: DataFrame) -> DataFrame:
    """Known fields that were missed: field, summary, ground_truth, prediction."""
    return results.where("not unknown and not correct").select("field", "summary", "ground_truth", "prediction")


def _list_row(field: str, expected: Column, actual: Column) -> Column:
    """What ``compare`` says of a list field."""
    listed = [F.array_join(items, ", ") for items in (expected, actual)]

    def row(s: Column) -> Column:
        numbers = [s[c].alias(c) for c in ("precision", "recall", "f1", "fp", "fn")]
        return F.struct(F.lit(field).alias("field"), F.lit("list").alias("kind"), ((s["fp"] == 0) & (s["fn"] == 0)).alias("correct"), *numbers, listed[0].alias("expected"), listed[1].alias("actual"))

    return let(set_score(expected, actual), row)


def compare(truth: DataFrame, found: DataFrame, key: str = "name") -> DataFrame:
    """name, field, kind, correct, precision, recall, f1, fp, fn, expected, actual for every field of every
    document that both tables have."""
    t, f = truth.alias("t"), found.alias("f")
    parts, double, long = [], F.lit(None).cast("double"), F.lit(None).cast("int")
    for field in SCALARS:
        e, a = F.col(f"t.{field}"), F.col(f"f.{field}")
        right = numeric_match(F.coalesce(e, F.lit(0)), F.coalesce(a, F.lit(0))) if field in ("killed", "injured") else exact_match(e, a)
        parts.append(F.struct(F.lit(field).alias("field"), F.lit("scalar").alias("kind"), right.alias("correct"), double.alias("precision"), double.alias("recall"), double.alias("f1"), long.alias("fp"), long.alias("fn"), e.cast("string").alias("expected"), a.cast("string").alias("actual")))
    for field in LISTS:
        parts.append(_list_row(field, F.col(f"t.{field}"), F.col(f"f.{field}")))
    return t.join(f, key).select(F.col(key).alias("name"), F.inline(F.array(*parts)))


def macro(compared: DataFrame) -> DataFrame:
    """field, documents, correct, pct, precision, recall, f1, fp, fn of every field, and of all scalar and all
    list fields together (field ``all scalar``, ``all list``): averages over documents and fields."""
    average = lambda c: F.round(F.avg(c), 6).alias(c)
    scalar = F.col("kind") == "scalar"
    grouped = compared.groupingSets([[F.col("kind"), F.col("field")], [F.col("kind")]], F.col("kind"), F.col("field")).agg(
        F.count("*").alias("documents"), F.count_if(scalar & F.col("correct")).alias("correct"), average("precision"), average("recall"), average("f1"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    pct = F.when(F.col("kind") == "scalar", F.round(F.col("correct") * 100.0 / F.col("documents"), 6))
    return grouped.select(F.coalesce("field", F.concat(F.lit("all "), "kind")).alias("field"), "documents", F.when(F.col("kind") == "scalar", F.col("correct")).alias("correct"), pct.alias("pct"), "precision", "recall", "f1", "fp", "fn")


def failures(compared: DataFrame) -> DataFrame:
    return compared.where("not correct").select("name", "field", "expected", "actual", "fp", "fn")


def top_failures(failed: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` failures of each field by name, and the field's number of failures, which ranks
    fields (1 has the most)."""
    own = Window.partitionBy("field")
    counts = failed.groupBy("field").agg(F.count("*").alias("errors"))
    ranks = counts.withColumn("field_rank", F.row_number().over(Window.orderBy(F.desc("errors"), "field")))  # one row for each field
    return failed.withColumn("n", F.row_number().over(own.orderBy("name"))).where(F.col("n") <= most).join(F.broadcast(ranks), "field")


def cluster_counts(rows: DataFrame) -> DataFrame:
    """documents, accuracy (per cent), expected, predicted, false_splits, false_merges of (expected, predicted) counts."""
    e, p = F.col("expected"), F.col("predicted")
    whole = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return rows.agg(
        F.count("*").alias("documents"), F.round(F.coalesce(F.try_divide(F.count_if(e == p) * 100.0, F.count("*")), F.lit(0.0)), 6).alias("accuracy"), whole(e, "expected"), whole(p, "predicted"),
        whole(F.greatest(p - e, F.lit(0)), "false_splits"), whole(F.greatest(e - p, F.lit(0)), "false_merges"),
    )


def incident_counts(truth: DataFrame, incidents: DataFrame) -> DataFrame:
    """doc_id, expected, predicted: how many incidents were built of each document of ``truth`` (doc_id,
    expected); a document without one has 0."""
    return truth.join(incidents.groupBy("doc_id").agg(F.count("*").alias("predicted")), "doc_id", "left").select("doc_id", "expected", F.coalesce("predicted", F.lit(0)).alias("predicted"))


def cardinalities(counts: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """name, rows, expected, ok of datasets that should have so many rows. Nothing fails."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(expected.get(name)).cast("long").alias("expected")) for name, df in counts.items()]
    return reduce(DataFrame.union, parts).withColumn("ok", F.col("rows").eqNullSafe(F.col("expected")))


def mean_latency(timings: DataFrame) -> DataFrame:
    """step, runs, mean_seconds of (step, seconds) rows."""
    return timings.groupBy("step").agg(F.count("*").alias("runs"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))


def mean_reciprocal_rank(ranked: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """mrr, hit1, hit5, hit10 over (query_id, rank, relevant); ``queries`` (query_id) adds those without results."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    if queries is not None:
        first = queries.select("query_id").distinct().join(first, "query_id", "left")
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6).alias(f"hit{k}")
    return first.agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), hit(1), hit(5), hit(10))


def relevant(r: dict[str, Column], wanted: dict[str, Column]) -> Column:
    """Whether a result answers an evaluation question: any of its lists or places holds a wanted term."""
    hits = [T.contains_any(terms, F.array(r[c]) if c in ("city", "state", "country") else r[c]) for c, terms in wanted.items()]
    return reduce(lambda a, b: a | b, hits, F.lit(False))
