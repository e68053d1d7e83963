"""Mixing sources to target weights by Pareto order sampling.

A source's target is split over its documents by weight: a document is expected in the mix
``rate = min(most, level * weight)`` times, and the level is solved for each source so that
the expected words are its target exactly. The whole part of a rate is certain: every document
is taken that often. The rest is a fixed-size sample of unequal chances, its size counted in
words: documents are ranked by random odds over inclusion odds, and taken in that order while
they come nearer to the words still missing. Without a weight column a document weighs as many
as its number of words has binary digits, so longer documents are likelier.

The random number of a document is drawn from a digest of its id and a seed, so
reruns agree on any cluster. No task ever ranks a whole source: ranks fall into
``bins`` bins, sums by bin find the one bin where the source's words run out, and
only that bin's documents are ranked one by one. Weights of a column are rounded to the
next 64th of an octave, so a source has a bounded number of them.

Defined results: a null or empty text has size 0, is never over its target and takes
0 words; a null source is a source of its own, after all others; repeated rows count
and are ranked each, in any order among equals; a weight that is null, not finite or not
positive counts as 1; an empty table gives an empty mix. A target of a source of size 0 is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import fresh, save

#: Weights of sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^ \t\n\x0B\f\r]+"


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 digest: any engine can draw the same one."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> plus ``target``. Weights repeat in code-point order of the
    names, null last. Targets rise with the weights until they stop at ``most`` times the
    source's size; what is left goes to the others by weight. The water level has a
    closed form over the sources sorted by where they stop; one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    rows = sizes.select("source", "source_size", w.alias("w"), cap.alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    below, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(rest)
    levels = rows.withColumn("_level", level).withColumn("_own", F.col("cap") / F.col("w") >= F.col("_level"))
    first = F.min(F.when(F.col("_own"), F.col("_level"))).over(Window.partitionBy())  # levels fall from the first one that holds
    chosen = F.max(F.when(F.col("_own"), F.col("_level"))).over(Window.partitionBy())
    return levels.withColumn("_final", F.coalesce(chosen, first)).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("_final") * F.col("w"), F.col("cap"))).alias("target"))


def grid(weight: Column) -> Column:
    """A weight to the next 64th of an octave; what is no positive number is 1."""
    good = weight.cast("double")
    good = F.when((good > 0) & (good < float("inf")), good).otherwise(1.0)
    return F.pow(F.lit(2.0), F.round(F.log2(good) * 64) / 64)


def levels(by_weight: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(_s, level): by what the weights of a source rise until the words expected are its target.
    From the largest weight down, those that would pass ``most`` stop there and the others share
    what is left; the first weight that stays below settles the level. A source has few weights."""
    t = targets.select(F.col("source").alias("_s"), "target")
    rows = by_weight.where("words > 0").join(t, F.col("source").eqNullSafe(F.col("_s")))
    order = Window.partitionBy("_s").orderBy(F.desc("weight"))
    above = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("weight") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    tried = rows.withColumn("level", (F.col("target") - F.lit(float(most)) * above) / rest)
    fine = F.col("level") * F.col("weight") <= most + 1e-9
    return tried.groupBy("_s").agg(F.max(F.when(fine, F.struct("weight", "level"))).alias("l")).select("_s", F.col("l.level").alias("level"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weight: Column | None = None,
    seed: int = 8,
    bins: int = 4096,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies for every row of ``docs``, and the
    columns that ``carry`` names."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), uniform(F.col(id_col), seed).alias("u"), (F.lit(None) if weight is None else grid(weight)).cast("double").alias("weight"), *carry)
    if weight is None:
        rows = rows.withColumn("weight", F.length(F.bin("size")).cast("double"))
    rows = save(spark, rows, "mix")
    by_weight = rows.groupBy("source", "weight").agg(F.sum("size").alias("words"))
    targets = source_targets(by_weight.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    plan = save(spark, targets.join(levels(by_weight, targets, most), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "targets")

    p = plan.select(F.col("source").alias("_s"), "source_size", "target", "level")
    expected = F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))
    # what is the cap but for rounding is the cap
    rate = F.when(F.col("size") == 0, 0.0).when(expected >= most - 1e-9, float(most)).otherwise(expected)
    ranked = rows.join(p, rows.source.eqNullSafe(p._s)).drop("_s").withColumn("rate", rate)
    ranked = ranked.withColumn("whole", F.floor("rate").cast("long")).withColumn("chance", F.col("rate") - F.col("whole"))
    # random odds over inclusion odds, on the scale x / (1 + x) so that bins are even
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("chance")) / F.col("chance")
    ranked = ranked.withColumn("q", F.when(F.col("chance") > 0, odds / (1 + odds))).withColumn("bin", F.floor(F.col("q") * bins).cast("int"))

    by_bin = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    every, upto = Window.partitionBy("source"), Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col("target") - F.sum("certain").over(every)
    ends = by_bin.withColumn("missing", missing).where("bin is not null").withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ends = ends.select(F.col("source").alias("_s"), F.col("bin").alias("_bin"), "missing", "before", (F.col("before") + F.col("words") <= F.col("missing")).alias("all_in"), (F.col("before") >= F.col("missing")).alias("none_in"))
    joined = ranked.join(ends, ranked.source.eqNullSafe(ends._s) & (ranked.bin == ends._bin), "left")
    open_bin = F.col("_bin").isNotNull() & ~F.col("all_in") & ~F.col("none_in")
    inside = joined.where(open_bin)
    order = Window.partitionBy("source", "bin").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_at", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    inside = inside.withColumn("extra", (2 * F.col("_at") + F.col("size") <= 2 * F.col("missing")).cast("long"))
    outside = joined.where(~F.coalesce(open_bin, F.lit(False))).withColumn("extra", F.coalesce(F.col("all_in"), F.lit(False)).cast("long"))
    out = ["doc_id", "source", "size", "source_size", "target", "rate", (F.col("whole") + F.col("extra")).alias("copies"), *carry]
    return inside.select(*out).unionByName(outside.select(*out))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken words for every document."""
    mixed = mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a document appears as often as the mix takes it. Rows are numbered in a
    written table, so those with a null or repeated id get their own numbers of copies."""
    row, times, each = fresh(docs, "_row", "_copies", "_k")
    numbered = save(spark, docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    copies = mix(spark, numbered.select("doc_id", "source", "text", F.col(row).alias("_row")), carry=("_row",)).where("copies > 0").select(F.col("_row").alias(row), F.col("copies").cast("int").alias(times))
    return numbered.join(copies, row).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  (CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':8'), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(lev) FROM l WHERE cap / w >= lev) * w, cap)) AS target FROM l),
b AS (SELECT source, length(bin(size))::DOUBLE AS weight, CAST(sum(size) AS BIGINT) AS words FROM d WHERE size > 0 GROUP BY ALL),
v AS (SELECT b.source, weight, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight * words) OVER (PARTITION BY b.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
m AS (SELECT source, arg_max(level, weight) AS level FROM v WHERE level * weight <= 2.0::DOUBLE + 0.000000001::DOUBLE GROUP BY source),
e AS (SELECT d.*, t.source_size, t.target, coalesce(m.level * length(bin(size))::DOUBLE, 0) AS expected FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source),
j AS (SELECT *, CASE WHEN size = 0 THEN 0.0::DOUBLE WHEN expected >= 2.0::DOUBLE - 0.000000001::DOUBLE THEN 2.0::DOUBLE ELSE expected END AS rate FROM e),
k AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS chance FROM j),
q AS (SELECT *, CASE WHEN chance > 0 THEN u / (1 - u) * (1 - chance) / chance END AS odds, target - sum(CAST(whole * size AS BIGINT)) OVER (PARTITION BY source) AS missing FROM k),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds / (1 + odds), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM q)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN odds IS NOT NULL AND 2 * earlier + size <= 2 * missing THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
