"""Every query of the library by name, with its oracle SQL where there is one.

The reports that the extractors read are rendered from ``events`` by expressions that Spark
and DuckDB share, so an oracle knows what was written into a text without reading it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vocab
from quillon.functions.casualties import casualties
from quillon.functions.location import location
from quillon.functions.organisations import organisations
from quillon.operators import entity, evaluation, incidents, ranking, retrieval
from quillon.sources import datasets, files
from quillon.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]


def _case(values: list[str], by: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {by} % {len(values)} {whens} END"


_CITY = _case(["Srinagar", "Mumbai", "Delhi", "Pune", "Imphal", "Patna", "Jammu"], "event_id")
_DO = _case(["detonated a car bomb near", "opened fire on", "kidnapping officials at", "torched", "attacked with grenades"], "event_id")
_TARGET = _case(["a police station", "an army convoy", "a mosque", "a market", "a railway bridge", "a bus"], "event_id")
_GROUP = _case(["CPI-Maoist", "ULFA", "Lashkar-e-Taiba"], "cast(floor(event_id / 2.0) as bigint)")
_N = "cast(event_id % 50 + 2 as varchar(10))"
_M = "cast(event_id % 9 + 1 as varchar(10))"
_DAY = "cast(event_id % 28 + 1 as varchar(10))"
_TEXT = f"""CASE event_id % 8 WHEN 6 THEN concat('The NIA court received the charge sheet against accused persons in ', {_CITY}, '.')
 WHEN 7 THEN concat('Officials visited ', {_CITY}, ' on Monday.')
 ELSE concat({_N}, ' people were killed and ', {_M}, ' others were injured. ', CASE WHEN event_id % 8 = 5 THEN 'Meanwhile, on ' ELSE 'On ' END, {_DAY}, ' April 2019 ', {_GROUP}, ' rebels ', {_DO}, ' ', {_TARGET}, ' in ', {_CITY}, '.') END"""
REPORT = {
    "report_id": "event_id", "doc": "cast(floor(event_id / 5.0) as bigint)", "seq": "cast(event_id % 5 as int)", "text": _TEXT, "city": _CITY, "grp": _GROUP,
    "killed": "cast(CASE WHEN event_id % 8 >= 6 THEN 0 ELSE event_id % 50 + 2 END as int)", "injured": "cast(CASE WHEN event_id % 8 >= 6 THEN 0 ELSE event_id % 9 + 1 END as int)", "day": "cast(event_id % 28 + 1 as int)",
}
_R = "r AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in REPORT.items()) + " FROM events)"


def reports(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The reports; with ``spread`` dealt over all cores by their ids, as a file may be one split."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    if spread:
        rows = rows.select("event_id").repartition(spark.sparkContext.defaultParallelism, "event_id")
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in REPORT.items()])


def _sql_has(terms: list[str], by: str = "lower(text)") -> str:
    return f"regexp_matches({by}, '{T.alternation(terms)}')".replace("people's", "people''s")


def _sql_categories(vocabulary: dict[str, list[str]]) -> str:
    whens = ", ".join(f"CASE WHEN {_sql_has(t)} THEN '{c}' END" for c, t in vocabulary.items())
    return f"array_to_string(list_filter([{whens}], lambda x: x IS NOT NULL), ',')"


def _sql_count(terms: list[str], by: str = "lower(text)") -> str:
    return "(" + " + ".join(f"CAST({_sql_has([t], by)} AS INT)" for t in terms) + ")"


_EVENT = " + ".join(f"{w}::DOUBLE * {_sql_count(t)}" for w, t in vocab.EVENT_TERMS)
_EVENT = f"(({_EVENT}) + CASE WHEN ({_EVENT}) > 0 THEN {vocab.CORE_BONUS}::DOUBLE * {_sql_count(vocab.CORE_VERBS)} ELSE 0 END)"
_ADMIN = "(" + " + ".join(f"{w}::DOUBLE * {_sql_count(t)}" for w, t in vocab.ADMIN_TERMS) + f" + {vocab.ADMIN_CASED[0]}::DOUBLE * {_sql_count(vocab.ADMIN_CASED[1], 'text')})"
_D = f"d AS (SELECT *, {_EVENT} AS event_score, {_ADMIN} AS admin_score FROM r)"
_CLASS = "CASE WHEN admin_score > 0 AND admin_score >= event_score THEN 'REJECT' WHEN event_score > 0 AND event_score > admin_score THEN 'ACCEPT' ELSE 'NEUTRAL' END"

_Q: dict[str, Query] = {}
_S: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _Q[name] = query
    if sql is not None:
        _S[name] = sql


def _on_reports(name: str, make: Callable[[DataFrame], DataFrame], select: str = "", more: str = "") -> None:
    _add(name, lambda s, d: make(reports(s, d)), f"WITH {_R}{more} {select}")


for _name, _vocabulary in (("attack", vocab.ATTACK), ("weapon", vocab.WEAPON), ("target", vocab.TARGET)):
    _on_reports(f"fx_{_name}", lambda r, v=_vocabulary: r.select("report_id", F.array_join(T.categories(F.col("text"), v), ",").alias("found")), f"SELECT report_id, {_sql_categories(_vocabulary)} AS found FROM r")
_on_reports("fx_anchor", lambda r: r.select("report_id", T.is_anchor(F.col("text")).alias("anchor")), f"SELECT report_id, {_sql_has(vocab.ATTACK_ANCHORS + vocab.OPERATION_ANCHORS + vocab.OTHER_ANCHORS)} AS anchor FROM r")
_on_reports("fx_boundary", lambda r: r.select("report_id", T.has_boundary(F.col("text")).alias("boundary")), "SELECT report_id, report_id % 8 = 5 AS boundary FROM r")


def _scored(r: DataFrame) -> DataFrame:
    return r.withColumn("event_score", T.event_score(F.col("text"))).withColumn("admin_score", T.admin_score(F.col("text")))


_on_reports("fx_event_score", lambda r: _scored(r).select("report_id", "event_score"), "SELECT report_id, event_score FROM d", f", {_D}")
_on_reports("fx_admin_score", lambda r: _scored(r).select("report_id", "admin_score"), "SELECT report_id, admin_score FROM d", f", {_D}")
_on_reports("fx_detect", lambda r: r.select("report_id", T.detect(F.col("text"))["class"].alias("class")), f"SELECT report_id, {_CLASS} AS class FROM d", f", {_D}")
# Dates in the five forms that are read, one that is none before one that is, and one without a year.
_MONTH = "CASE day % 3 WHEN 0 THEN 'March' WHEN 1 THEN 'June' ELSE 'November' END"
_MM = "CASE day % 3 WHEN 0 THEN '03' WHEN 1 THEN '06' ELSE '11' END"
_DATED = f"""CASE report_id % 7 WHEN 0 THEN concat('Seen on 2018-', {_MM}, '-', lpad(cast(day as varchar(2)), 2, '0'), ' there') WHEN 1 THEN concat('on ', cast(day % 12 + 1 as varchar(2)), '/', cast(day as varchar(2)), '/2017')
 WHEN 2 THEN concat('on ', cast(day + 12 - 12 * cast(floor(day / 17.0) as int) as varchar(2)), '-', cast(day % 12 + 1 as varchar(2)), '-2016') WHEN 3 THEN concat(cast(day as varchar(2)), ' ', {_MONTH}, ' 2015, ', {_MONTH}, ' 9, 2001')
 WHEN 4 THEN concat({_MONTH}, ' ', cast(day as varchar(2)), 'th, 2014') WHEN 5 THEN concat('2019-99-99 and ', {_MONTH}, ' ', cast(day as varchar(2))) ELSE 'at no time' END"""
_add("fx_date", lambda s, d: reports(s, d).select("report_id", T.date_of(F.expr(_DATED), F.lit("2013-01-01").cast("date")).cast("string").alias("date")), f"""
WITH {_R}, x AS (SELECT *, lpad(CAST(day AS VARCHAR), 2, '0') AS dd, lpad(CAST(day % 12 + 1 AS VARCHAR), 2, '0') AS m12, day + 12 - 12 * CAST(floor(day / 17.0) AS INT) AS shifted FROM r)
SELECT report_id, CASE report_id % 7 WHEN 0 THEN concat('2018-', {_MM}, '-', dd) WHEN 1 THEN concat('2017-', m12, '-', dd) WHEN 2 THEN concat('2016-', CASE WHEN shifted > 12 THEN m12 ELSE lpad(CAST(shifted AS VARCHAR), 2, '0') END, '-', CASE WHEN shifted > 12 THEN lpad(CAST(shifted AS VARCHAR), 2, '0') ELSE m12 END)
 WHEN 3 THEN concat('2015-', {_MM}, '-', dd) WHEN 4 THEN concat('2014-', {_MM}, '-', dd) WHEN 5 THEN concat('2013-', {_MM}, '-', dd) END AS date FROM x""")
_on_reports("fx_casualties", lambda r: r.select("report_id", casualties(F.col("text")).alias("c")).select("report_id", "c.killed", "c.injured"), "SELECT report_id, killed, injured FROM r")
_on_reports("fx_sentences", lambda r: r.select("report_id", F.size(T.sentences(F.col("text"))).alias("n")), "SELECT report_id, CAST(CASE WHEN report_id % 8 < 6 THEN 2 ELSE 1 END AS INT) AS n FROM r")
_on_reports("fx_csv_dec", lambda r: r.select("report_id", F.array_join(T.csv_decode(F.expr("CASE report_id % 3 WHEN 0 THEN concat(' ', city, ' ,, ', grp, ',') WHEN 1 THEN city END")), "|").alias("items")), "SELECT report_id, CASE report_id % 3 WHEN 0 THEN concat(city, '|', grp) WHEN 1 THEN city ELSE '' END AS items FROM r")
_on_reports("fx_csv_enc", lambda r: r.select("report_id", T.csv_encode(F.array("city", "grp")).alias("stored"), T.csv_encode(F.array("city", "grp"), ", ").alias("shown")), "SELECT report_id, concat(city, ',', grp) AS stored, concat(city, ', ', grp) AS shown FROM r")
_on_reports("fx_trim_sentence", lambda r: r.select("report_id", T.whole_sentence(F.concat("text", F.lit(" and so"))).alias("cut")), "SELECT report_id, text AS cut FROM r")
_on_reports("q_preview", lambda r: r.select("report_id", T.preview(F.col("text"), 60).alias("preview")), "SELECT report_id, CASE WHEN length(text) > 60 THEN concat(text[:60], '...') ELSE text END AS preview FROM r")
_on_reports("q_attack", lambda r: r.where(F.array_join(T.attack_types(F.col("text")), ",").ilike("%bomb%")).select("report_id"), f"SELECT report_id FROM r WHERE {_sql_categories(vocab.ATTACK)} ILIKE '%bomb%'")
_on_reports("q_date_range", lambda r: r.where(T.date_of(F.col("text")).between(F.lit("2019-04-05").cast("date"), F.lit("2019-04-11").cast("date"))).select("report_id"), "SELECT report_id FROM r WHERE report_id % 8 < 6 AND day BETWEEN 5 AND 11")
_on_reports("fx_format_date", lambda r: r.select("report_id", T.format_date(F.lit(2019), F.col("day") % 13, F.col("day")).alias("d")), "SELECT report_id, concat('2019-', lpad(CAST(CASE WHEN day % 13 = 0 THEN 1 ELSE day % 13 END AS VARCHAR), 2, '0'), '-', lpad(CAST(day AS VARCHAR), 2, '0')) AS d FROM r")
_on_reports("ag_counts", lambda r: r.groupBy("city").agg(F.count("*").alias("n"), F.sum("killed").alias("killed"), F.max("injured").alias("most")), "SELECT city, count(*) AS n, CAST(sum(killed) AS BIGINT) AS killed, max(injured) AS most FROM r GROUP BY city")


def _flagship(r: DataFrame) -> DataFrame:
    """Accepted reports by attack type and city: one scan, one small shuffle. Class and types come of one
    pass over a text, and the texts that aren't accepted go where the types become rows."""
    exploded = r.select("city", "killed", F.explode(T.accepted_attacks(F.col("text"))).alias("attack"))
    return exploded.groupBy("attack", "city").agg(F.count("*").alias("n"), F.sum("killed").alias("killed"))


_on_reports("flagship", _flagship, f"SELECT attack, city, count(*) AS n, CAST(sum(killed) AS BIGINT) AS killed FROM (SELECT city, killed, unnest(string_split({_sql_categories(vocab.ATTACK)}, ',')) AS attack FROM d WHERE {_CLASS} = 'ACCEPT') GROUP BY attack, city", f", {_D}")

_add("fx_jaccard", lambda s, d: entity.neighbour_jaccard(s.read.parquet(f"{d}/documents.parquet")), r"""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS w FROM documents)
SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE END, 6) AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
# Stories: six reports of a document, whose dates, cities and groups repeat, differ or are missing.
STORY = {
    "doc": "cast(floor(event_id / 6.0) as bigint)", "seq": "cast(event_id % 6 as int)", "text": _TEXT, "city": f"CASE WHEN event_id % 7 <> 5 THEN {_case(['Srinagar', 'Mumbai', 'Pune'], 'cast(floor(event_id / 4.0) as bigint)')} END",
    "grp": f"CASE WHEN event_id % 3 <> 1 THEN {_GROUP} END", "day": "CASE WHEN event_id % 4 <> 3 THEN cast(cast(floor(event_id / 3.0) as bigint) % 28 + 1 as int) END", "killed": REPORT["killed"], "injured": REPORT["injured"],
}
_STORIES = "st AS (SELECT event_id, " + ", ".join(f"{e} AS {c}" for c, e in STORY.items()) + " FROM events)"


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{e} AS {c}" for c, e in STORY.items()])


def _sql_list(vocabulary: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_sql_has(t)} THEN '{c}' END" for c, t in vocabulary.items()) + "], lambda x: x IS NOT NULL)"


def _sql_alone(terms: list[str]) -> str:
    return f"regexp_matches(lower(text), '{T.alternation(terms, False)}')"


_TOLD = rf"""{_STORIES}, sd AS (SELECT *, {_EVENT} AS event_score, {_ADMIN} AS admin_score FROM st),
x AS MATERIALIZED (SELECT *, {_CLASS} AS class, event_id % 8 = 5 AS bnd, {_sql_alone(vocab.OPERATION_ANCHORS)} AS op, {_sql_alone(vocab.ATTACK_ANCHORS)} AS atk, {_sql_list(vocab.ATTACK)} AS attacks, {_sql_list(vocab.WEAPON)} AS weapons, {_sql_alone(T.ANCHORS)} AS anchor,
  list_distinct(regexp_extract_all(lower(text), '\w+')) AS words FROM sd),
p AS MATERIALIZED (SELECT a.doc, a.seq AS i, b.seq AS j, CAST(b.bnd AS INT) + CAST(coalesce(a.day <> b.day, false) AS INT) + CAST(coalesce(a.city <> b.city, false) AS INT) + CAST(a.op <> b.op AND a.atk <> b.atk AND a.op <> a.atk AS INT)
   + 0.5::DOUBLE * CAST(len(a.attacks) > 0 AND len(b.attacks) > 0 AND NOT list_has_any(a.attacks, b.attacks) AS INT) + 0.5::DOUBLE * CAST(coalesce(a.grp <> b.grp, false) AS INT) AS boundary,
  0.35::DOUBLE * CASE WHEN a.city = b.city THEN 1 WHEN a.city <> b.city THEN -0.5::DOUBLE ELSE __STATES__ END + 0.25::DOUBLE * CASE WHEN a.day = b.day THEN 1 WHEN a.day <> b.day THEN -0.5::DOUBLE ELSE 0 END
   + 0.2::DOUBLE * CASE WHEN a.grp = b.grp THEN 0.5::DOUBLE ELSE 0 END + 0.1::DOUBLE * (0.5::DOUBLE * CAST(list_has_any(a.attacks, b.attacks) AS INT) + 0.5::DOUBLE * CAST(list_has_any(a.weapons, b.weapons) AS INT)) AS base,
  coalesce(abs(a.day - b.day) <= 1, false) AS c_dates, coalesce(CASE WHEN a.city IS NOT NULL OR b.city IS NOT NULL THEN a.city = b.city ELSE a.state = b.state END, false) AS c_places, coalesce(a.grp = b.grp, false) AS c_groups,
  len(list_intersect(a.words, b.words)) / nullif(len(list_distinct(list_concat(a.words, b.words))), 0)::DOUBLE > 0.3::DOUBLE AS c_texts,
  CASE WHEN a.city = b.city THEN 1 WHEN a.city <> b.city THEN -0.5::DOUBLE ELSE __STATES__ END::DOUBLE AS s_place, CASE WHEN a.day = b.day THEN 1 WHEN a.day <> b.day THEN -0.5::DOUBLE ELSE 0 END::DOUBLE AS s_date, CASE WHEN a.grp = b.grp THEN 0.5::DOUBLE ELSE 0 END::DOUBLE AS s_actor,
  0.5::DOUBLE * CAST(list_has_any(a.attacks, b.attacks) AS INT) + 0.5::DOUBLE * CAST(list_has_any(a.weapons, b.weapons) AS INT) AS s_attack
  FROM x a JOIN x b ON a.doc = b.doc AND a.seq < b.seq)"""
# what stands in the text decides the state and country of a report whose city isn't coded
_WRITTEN = "CASE event_id % 7 WHEN 0 THEN 'Jammu and Kashmir' WHEN 1 THEN 'Maharashtra' WHEN 2 THEN 'Delhi' WHEN 3 THEN 'Maharashtra' WHEN 4 THEN 'Manipur' WHEN 5 THEN 'Bihar' ELSE 'Jammu and Kashmir' END"
_TOLD = _TOLD.replace("AS words FROM sd)", f"AS words, {_WRITTEN} AS state FROM sd)").replace("__STATES__", "CASE WHEN a.state = b.state THEN 0.8::DOUBLE ELSE -0.2::DOUBLE END")


def _sql_near(base: str, boundary: str, gap: str) -> str:
    prox = f"CASE WHEN {gap} <= 1 THEN 1 WHEN {gap} = 2 THEN 0.5::DOUBLE WHEN {gap} <= 4 THEN 0.2::DOUBLE ELSE 0 END"
    return f"CASE WHEN {boundary} >= 1 THEN -1 WHEN {gap} <= 1 THEN greatest({base} + 0.1::DOUBLE * {prox}, 0.5::DOUBLE) ELSE {base} + 0.1::DOUBLE * {prox} END"


_add("er_should_merge", lambda s, d: entity.merge_pairs(stories(s, d)), f"WITH {_TOLD} SELECT doc, i, j FROM p WHERE CAST(c_dates AS INT) + CAST(c_places AS INT) + CAST(c_groups AS INT) + CAST(c_texts AS INT) >= 2")
_add("er_similarity", lambda s, d: entity.pair_similarity(stories(s, d)), f"WITH {_TOLD} SELECT doc, i, j, round({_sql_near('base', 'boundary', '(j - i)')}, 6) AS similarity FROM p")
for _name, _column, _sql in (
    ("er_dates", "dates", "c_dates"), ("er_locs", "places", "c_places"), ("er_groups", "groups", "c_groups"), ("er_texts", "texts", "c_texts"), ("er_boundary", "boundary", "boundary"), ("er_loc_sim", "place", "s_place"),
    ("er_date_sim", "date", "s_date"), ("er_actor_sim", "actor", "s_actor"), ("er_attack_sim", "attack", "s_attack"), ("er_prox_sim", "near", "CASE WHEN j - i <= 1 THEN 1 WHEN j - i = 2 THEN 0.5::DOUBLE WHEN j - i <= 4 THEN 0.2::DOUBLE ELSE 0 END::DOUBLE"),
):
    _add(_name, lambda s, d, c=_column: entity.pair_measures(stories(s, d)).select("doc", "i", "j", F.col(c).alias("value")), f"WITH {_TOLD} SELECT doc, i, j, {_sql} AS value FROM p")
# The greedy clusterer, a sentence at a time: states after each of a document's six sentences.
_SEEDS = "class = 'ACCEPT' AND (anchor OR len(attacks) > 0 OR len(weapons) > 0 OR killed > 0 OR injured > 0)"
_STEPS = [f"c0 AS MATERIALIZED (SELECT doc, seq, 0 AS cluster FROM x WHERE seq = 0 AND {_SEEDS})"]
for _k in range(1, 6):
    _STEPS.append(f"""c{_k} AS MATERIALIZED (WITH g AS (SELECT doc, cluster, min(seq) AS first, max(seq) AS last FROM c{_k - 1} GROUP BY ALL), n AS (SELECT doc, count(*) AS n FROM g GROUP BY doc),
 s AS (SELECT p.doc, g.cluster, {_sql_near('p.base', 'p.boundary', f'({_k} - g.last)')} AS score FROM p JOIN g ON p.doc = g.doc AND p.i = g.first WHERE p.j = {_k}), b AS (SELECT doc, cluster, score FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, cluster) = 1)
 SELECT * FROM c{_k - 1} UNION ALL SELECT x.doc, x.seq, CASE WHEN b.score >= 0.5::DOUBLE THEN b.cluster ELSE coalesce(n.n, 0) END AS cluster FROM x LEFT JOIN b ON b.doc = x.doc LEFT JOIN n ON n.doc = x.doc WHERE x.seq = {_k} AND class <> 'REJECT' AND (b.score >= 0.5::DOUBLE OR ({_SEEDS})))""")
_add("er_cluster", lambda s, d: entity.cluster_reports(stories(s, d)), f"WITH {_TOLD}, {', '.join(_STEPS)} SELECT doc, seq, CAST(cluster AS INT) AS cluster FROM c5")
_add("er_dedup", lambda s, d: entity.dedup_reports(stories(s, d)))
_on_reports("snk_upsert", lambda r: entity.upsert(r.where("report_id % 2 = 0").select("report_id", "killed"), r.where("report_id % 3 = 0").select("report_id", (F.col("killed") + 1).alias("killed")), "report_id"),
            "SELECT report_id, CAST(CASE WHEN report_id % 3 = 0 THEN killed + 1 ELSE killed END AS INT) AS killed FROM r WHERE report_id % 2 = 0 OR report_id % 3 = 0")

_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), k AS (SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"


def _knn(s: SparkSession, d: str, k: int = 10, where: str | None = None) -> DataFrame:
    """The k nearest of every vector whose id is divisible by 20, with both labels."""
    rows = s.read.parquet(f"{d}/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0")
    found = retrieval.nearest(rows if where is None else rows.where(where), asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k)
    labels = rows.select("vec_id", "label")
    return found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


_add("r_query", lambda s, d: _knn(s, d).select("query_id", "rank", "vec_id", "score"), f"WITH {_V} SELECT query_id, CAST({_RANK} AS INT) AS rank, vec_id, score FROM k QUALIFY {_RANK} <= 10")
_add("r_filtered", lambda s, d: _knn(s, d, 5, "label = 3").select("query_id", "rank", "vec_id", "score"), f"WITH {_V} SELECT query_id, CAST({_RANK} AS INT) AS rank, vec_id, score FROM k WHERE label = 3 QUALIFY {_RANK} <= 5")
_add("w_window", lambda s, d: retrieval.similarity_window(_knn(s, d)).select("query_id", "vec_id", "score"), f"WITH {_V}, t AS (SELECT * FROM k QUALIFY {_RANK} <= 10) SELECT query_id, vec_id, score FROM t QUALIFY score >= max(score) OVER (PARTITION BY query_id) - 0.05")
_add("ag_mrr", lambda s, d: evaluation.mean_reciprocal_rank(_knn(s, d).withColumn("relevant", F.col("label") == F.col("query_label"))), f"""WITH {_V}, t AS (SELECT query_id, label = ql AS relevant, {_RANK} AS rank FROM k QUALIFY {_RANK} <= 10), f AS (SELECT query_id, min(rank) FILTER (relevant) AS first FROM t GROUP BY query_id)
SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(CAST(coalesce(first <= 1, false) AS INT)), 6) AS hit1, round(avg(CAST(coalesce(first <= 5, false) AS INT)), 6) AS hit5, round(avg(CAST(coalesce(first <= 10, false) AS INT)), 6) AS hit10 FROM f""")
_add("w_budget", lambda s, d: retrieval.budget(s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("text").alias("block")), 1200).select("query_id", "rank", F.length("block").alias("n")), """
WITH c AS (SELECT conv_id AS query_id, turn AS rank, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS cum, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
x AS (SELECT *, 1200 - (cum - n) AS room, min(CASE WHEN cum > 1200 THEN i END) OVER (PARTITION BY query_id) AS cross_at FROM c)
SELECT query_id, rank, CAST(CASE WHEN i = cross_at THEN room + length('... [TRUNCATED]') + 2 ELSE n END AS INT) AS n FROM x WHERE cross_at IS NULL OR i < cross_at OR (i = cross_at AND room > 200)""")
_QUESTIONS = ["List all bombings in Mumbai in 2008", "How many police were attacked in 2010 and 2011?", "Compare kidnapping and arson", "What happened at the temple market?", "top trends of gun attacks on soldiers", "Tell me about the grenade blast near the airport", ""]
_QV = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_QUESTIONS)) + ") AS t(id, question))"


def _questions(s: SparkSession) -> DataFrame:
    return s.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_QUESTIONS)) + " AS t(id, question)")


def _sql_first(labels: dict[str, str], plural: str = "") -> str:
    return "CASE " + " ".join(rf"WHEN regexp_matches(lower(question), '\b{k}{plural}\b') THEN '{v}'" for k, v in labels.items()) + " END"


_add("qf_filters", lambda s, d: _questions(s).select("id", F.array_join(T.query_years(F.col("question")), ",").alias("years"), T.first_label(F.col("question"), vocab.QUERY_ATTACK, True).alias("attack"), T.first_label(F.col("question"), vocab.QUERY_TARGET).alias("target"), T.first_label(F.col("question"), vocab.QUERY_WEAPON).alias("weapon"), F.array_join(T.document_words(F.col("question")), ",").alias("words")),
     rf"WITH {_QV} SELECT id, array_to_string(regexp_extract_all(question, '\b(?:19\d{{2}}|20\d{{2}})\b'), ',') AS years, {_sql_first(vocab.QUERY_ATTACK, 's?')} AS attack, {_sql_first(vocab.QUERY_TARGET)} AS target, {_sql_first(vocab.QUERY_WEAPON)} AS weapon, array_to_string(list_filter({vocab.DOCUMENT_WORDS}, lambda w: contains(lower(question), w)), ',') AS words FROM q")
_add("qf_classify", lambda s, d: _questions(s).select("id", T.classify_query(F.col("question")).alias("class"), T.is_broad(F.col("question")).alias("broad")),
     f"WITH {_QV} SELECT id, CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{T.alternation(w, False)}') THEN '{c}'" for c, w in vocab.QUERY_CLASSES.items()) + f" ELSE 'summary' END AS class, regexp_matches(lower(question), '{T.alternation(vocab.BROAD, False)}') AS broad FROM q")
_add("e1_tumbling", lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("start").alias("start"), "event_type", "n"), "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")


# Places, organisations and whole incidents of rendered reports.
_STATE = "CASE city WHEN 'Srinagar' THEN 'Jammu and Kashmir' WHEN 'Jammu' THEN 'Jammu and Kashmir' WHEN 'Mumbai' THEN 'Maharashtra' WHEN 'Pune' THEN 'Maharashtra' WHEN 'Delhi' THEN 'Delhi' WHEN 'Imphal' THEN 'Manipur' WHEN 'Patna' THEN 'Bihar' END"
# Places: text, country, state, city, confidence of each form.
_PLACES = [
    ("concat('Blast in ', city)", "'India'", _STATE, "city", 1.0), ("'Raid in New Delhi, India'", "'India'", "'Delhi'", "'New Delhi'", 1.0), ("'Protest in Nepal'", "'Nepal'", "NULL", "NULL", 0.7), ("'Fighting in Sindh'", "NULL", "'Sindh'", "NULL", 0.0),
    ("concat('From Lahore to Trincomalee by way of ', 'Uri')", "'Sri Lanka'", "''", "'Trincomalee'", 1.0), ("'Nothing was said of a place'", "NULL", "NULL", "NULL", 0.0), ("concat('In KABUL, Afghanistan, and ', upper(city))", "'Afghanistan'", "CASE WHEN length(city) > 5 THEN " + _STATE + " ELSE 'Kabul' END", "CASE WHEN length(city) > 5 THEN city ELSE 'Kabul' END", 1.0),
]
_by_form = lambda i: "CASE report_id % 7 " + " ".join(f"WHEN {k} THEN {f[i]}" for k, f in enumerate(_PLACES)) + " END"
_on_reports("fx_location", lambda r: r.select("report_id", location(F.expr(_by_form(0))).alias("l")).select("report_id", "l.*"), f"SELECT report_id, {_by_form(1)} AS country, {_by_form(2)} AS state, {_by_form(3)} AS city, CAST({_by_form(4)} AS DOUBLE) AS confidence FROM r")
# Names: text, groups, targets of each form.
_NAMED = [
    ("concat('The Taliban claimed responsibility. ', 'Four CRPF men were hurt.')", "'Taliban'", "'CRPF'"), ("concat(grp, ' struck in ', city, '; the Red Cross claimed responsibility.')", "CASE WHEN grp = 'Lashkar-e-Taiba' THEN grp ELSE '' END", "''"),
    ("concat('It was carried out by Jamaat-ul-Ahrar, of Tehrik-i-Taliban Pakistan, in ', city, '.')", "'Jamaat-ul-Ahrar,Taliban'", "''"), ("'The hotel was attacked by nobody known, said the NIA and the BSF.'", "''", "'BSF,NIA'"), ("'they let him go, and jem is no name in small letters'", "''", "''"), ("'Nothing'", "''", "''"),
    ("'LeT and JeM were linked to Boko Haram.'", "'Boko Haram,JeM,LeT'", "''"),
]
_by_name = lambda i: "CASE report_id % 7 " + " ".join(f"WHEN {k} THEN {f[i]}" for k, f in enumerate(_NAMED)) + " END"
_on_reports("fx_orgs", lambda r: r.select("report_id", organisations(F.expr(_by_name(0))).alias("o")).select("report_id", F.array_join("o.groups", ",").alias("groups"), F.array_join("o.targets", ",").alias("targets")), f"SELECT report_id, {_by_name(1)} AS groups, {_by_name(2)} AS targets FROM r")
_FOUND = f"SELECT report_id AS doc_id, CASE WHEN told THEN concat('2019-04-', lpad(CAST(day AS VARCHAR), 2, '0')) ELSE '' END AS date, CASE WHEN told THEN city ELSE '' END AS city, CASE WHEN told THEN {_STATE} ELSE '' END AS state, CASE WHEN hurt THEN killed ELSE 0 END AS killed, CASE WHEN hurt THEN injured ELSE 0 END AS injured FROM r, (VALUES (true, true, 0, 4), (true, false, 5, 5), (false, true, 5, 5)) AS t(told, hurt, a, b) WHERE report_id % 8 BETWEEN a AND b"
_on_reports("er_build", lambda r: incidents.build(r.select(F.col("report_id").alias("doc_id"), "text")).select("doc_id", "date", "city", "state", "killed", "injured"), _FOUND)


# Sources: bytes made of pages, coded rows and JSON made of reports.
_BYTES = "CASE page_id % 5 WHEN 0 THEN unhex('255044462D') WHEN 1 THEN unhex('89504E470D0A') WHEN 2 THEN unhex('00010203') WHEN 3 THEN unhex('') ELSE encode(concat('Caf', chr(233), ' '), 'ISO-8859-1') END"


def _files(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id"), F.col("url").alias("path"), F.expr(f"concat({_BYTES}, encode(coalesce(html, ''), 'UTF-8'))").alias("content"))


_add("src_classify", lambda s, d: _files(s, d).select("page_id", files.category(F.col("content")).alias("kind")), "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'IMAGE' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN CASE WHEN coalesce(html, '') = '' THEN 'UNKNOWN' ELSE 'TXT' END ELSE 'TXT' END AS kind FROM pages")
_add("src_txt", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", files.line_count(files.plain_text(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("lines")),
     r"SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_extract_all(text, '\r\n|[\n\v\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')) + CAST(NOT regexp_matches(text, '[\n\v\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]$') AS INT) END AS INT) AS lines FROM documents")
_add("src_ingest", lambda s, d: files.ingest(_files(s, d).select("path", "content")).groupBy("source_type").agg(F.count("*").alias("n"), F.count("error").alias("errors")),
     "SELECT CASE page_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'IMAGE' ELSE 'TXT' END AS source_type, count(*) AS n, count(*) FILTER (page_id % 5 < 2) AS errors FROM pages WHERE page_id % 5 <> 2 AND NOT (page_id % 5 = 3 AND coalesce(html, '') = '') GROUP BY 1")


_add("src_pdf", lambda s, d: files.ingest(_files(s, d).select("path", "content"), {"PDF": lambda c: F.when(F.octet_length(c) % 2 == 0, F.lit("p" * 60)), "SCANNED_PDF": lambda c: F.when(c.isNotNull(), F.lit("scanned"))}).where("source_type like '%PDF'").groupBy("source_type", "raw_text").agg(F.count("*").alias("n")),
     "SELECT CASE WHEN strlen(coalesce(html, '')) % 2 = 1 THEN 'PDF' ELSE 'SCANNED_PDF' END AS source_type, CASE WHEN strlen(coalesce(html, '')) % 2 = 1 THEN repeat('p', 60) ELSE 'scanned' END AS raw_text, count(*) AS n FROM pages WHERE page_id % 5 = 0 GROUP BY ALL")
_add("src_image", lambda s, d: files.image_documents(_files(s, d).select("path", "content"), ocr=lambda c: F.array(F.lit("two"), F.lit("words")), caption=lambda c: F.when(F.octet_length(c) % 2 == 0, "seen")).select("title", "raw_text", "detections", "caption"),
     "SELECT string_split(url, '/')[-1] AS title, 'two words' AS raw_text, 2 AS detections, CASE WHEN strlen(coalesce(html, '')) % 2 = 0 THEN 'seen' ELSE '' END AS caption FROM pages WHERE page_id % 5 = 1")


def _by_sql(s: SparkSession, d: str) -> DataFrame:
    from quillon.plans import sql

    sql.register(s)
    return reports(s, d).select("report_id", F.call_function("extract_casualties", F.col("text")).alias("c"), F.call_function("extract_organizations", F.concat(F.lit("The Taliban claimed responsibility. "), "text")).alias("o")).select("report_id", "c.killed", "c.injured", F.array_contains("o.groups", "Taliban").alias("claimed"))


_add("x_sql_functions", _by_sql, f"WITH {_R} SELECT report_id, killed, injured, true AS claimed FROM r")


def _coded(s: SparkSession, d: str) -> DataFrame:
    """Reports as the coded CSV's text columns, with bad and missing values among them."""
    return reports(s, d).selectExpr(
        "cast(report_id as string) AS eventid", "'2019' AS iyear", "cast(day % 13 as string) AS imonth", "CASE WHEN report_id % 4 = 0 THEN 'x' ELSE cast(day as string) END AS iday", "CASE WHEN report_id % 3 = 0 THEN 'Nepal' ELSE 'India' END AS country_txt",
        "'' AS provstate", "city", "'Bombing/Explosion' AS attacktype1_txt", "'Unknown' AS targtype1_txt", "'' AS weaptype1_txt", "grp AS gname", "concat(cast(killed as string), '.7') AS nkill", "'n/a' AS nwound", "CASE WHEN report_id % 2 = 0 THEN text ELSE ' ' END AS summary",
    )


_add("src_gtd", lambda s, d: datasets.coded_incidents(_coded(s, d)).select("incident_id", "date", "country", F.array_join("attack_types", ",").alias("attack"), F.size("target_types").alias("targets"), "killed", "injured", "has_summary"),
     f"WITH {_R} SELECT CAST(report_id AS VARCHAR) AS incident_id, concat('2019-', lpad(CAST(greatest(day % 13, 1) AS VARCHAR), 2, '0'), '-', lpad(CASE WHEN report_id % 4 = 0 THEN '01' ELSE CAST(day AS VARCHAR) END, 2, '0')) AS date, CASE WHEN report_id % 3 = 0 THEN 'Nepal' ELSE 'India' END AS country, 'Bombing/Explosion' AS attack, 0 AS targets, killed, 0 AS injured, report_id % 2 = 0 AS has_summary FROM r")
_add("ag_totals", lambda s, d: datasets.totals(datasets.coded_incidents(_coded(s, d))),
     f"WITH {_R} SELECT count(*) AS total, count(*) FILTER (report_id % 2 = 0) AS with_summary, round(count(*) FILTER (report_id % 2 = 0) * 100.0::DOUBLE / count(*), 6) AS pct, count(*) FILTER (report_id % 3 <> 0) AS home, count(*) FILTER (report_id % 3 <> 0 AND report_id % 2 = 0) AS home_summary FROM r")
_add("src_json", lambda s, d: datasets.with_defaults(reports(s, d).select(datasets.parse_json(F.expr("concat('{\"incident_id\":\"', report_id, '\"', CASE WHEN report_id % 2 = 0 THEN concat(',\"killed\":', killed) ELSE '' END, '}')")).alias("i")).select("i.*")).select("incident_id", "killed", "city", F.size("attack_types").alias("attacks")),
     f"WITH {_R} SELECT CAST(report_id AS VARCHAR) AS incident_id, CAST(CASE WHEN report_id % 2 = 0 THEN killed ELSE 0 END AS INT) AS killed, '' AS city, 0 AS attacks FROM r")
_on_reports("snk_add", lambda r: datasets.add_new(r.where("report_id % 2 = 0").select("report_id"), r.where("report_id % 3 = 0").select("report_id"), "report_id"), "SELECT report_id FROM r WHERE report_id % 3 = 0 AND report_id % 2 <> 0")

# Ranking and prompts: a stated list of questions against all reports.
_ASKED = ["Attacks in Mumbai in 2019", "maoist violence", "Who is lashkar-e-taiba?", "Let us list blasts near Pune in 2018 and 2019", "ulfa in Imphal 2019"]
_AV = "a AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_ASKED)) + ") AS t(id, question))"


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Every report with each question of the list, which is a part of the expression and no table."""
    return reports(s, d).select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("question")) for i, t in enumerate(_ASKED)])))


_add("r_bonus", lambda s, d: _asked(s, d).select("id", "report_id", F.round(ranking.metadata_bonus(F.col("question"), F.lit("2019-04-01"), [F.col("city")], F.array("grp")), 6).alias("bonus")),
     rf"WITH {_R}, {_AV} SELECT id, report_id, round(0.10::DOUBLE * CAST(contains(question, '2019') AS INT) + 0.10::DOUBLE * CAST(contains(lower(question), lower(city)) AS INT) + 0.15::DOUBLE * CAST(contains(lower(question), lower(grp)) OR (id = 1 AND grp = 'CPI-Maoist') OR (id IN (2, 3) AND regexp_matches(lower(question), '\blet\b') AND grp = 'Lashkar-e-Taiba') AS INT), 6) AS bonus FROM r, a")
_add("r_final", lambda s, d: _asked(s, d).select("id", "report_id", F.round(ranking.final_score(F.lit(0.5), F.lit(0.1), F.col("killed") > 10, F.when(F.col("id") < 2, "Bombing"), T.attack_types(F.col("text"))), 6).alias("score")),
     f"WITH {_R}, {_AV} SELECT id, report_id, round(0.6::DOUBLE + 0.15::DOUBLE * CAST(killed > 10 AS INT) + CASE WHEN id >= 2 THEN 0 WHEN list_contains(string_split({_sql_categories(vocab.ATTACK)}, ','), 'Bombing') THEN 1 ELSE -0.5::DOUBLE END, 6) AS score FROM r, a")
_add("r_union", lambda s, d: ranking.best_of([_knn(s, d).select("query_id", "vec_id", "score"), _knn(s, d, 5, "label = 3").select("query_id", "vec_id", "score")], ["query_id", "vec_id"]),
     f"WITH {_V}, t AS (SELECT query_id, vec_id, score FROM k QUALIFY {_RANK} <= 10), f AS (SELECT query_id, vec_id, score FROM k WHERE label = 3 QUALIFY {_RANK} <= 5) SELECT DISTINCT * FROM (SELECT * FROM t UNION ALL SELECT * FROM f)")


def _blocks(r: DataFrame) -> DataFrame:
    none, c = F.array().cast("array<string>"), F.col
    fields = {"date": F.lit(""), "city": c("city"), "state": F.lit(""), "country": F.lit("India"), "attack_types": none, "target_types": none, "weapon_types": none, "responsible_groups": F.array("grp"), "killed": c("killed"), "injured": c("injured"), "summary": c("text")}
    return r.select(c("doc").alias("query_id"), c("seq").alias("rank"), ranking.incident_block(fields, c("seq") + 1, F.lit(0.5)).alias("block"))


_SQL_BLOCK = "concat('--- Incident Report #', seq + 1, ' (Relevance: 0.500) ---', chr(10), 'Date: Unknown', chr(10), 'Location: ', city, ', India', chr(10), 'Responsible Group: ', grp, chr(10), 'Killed: ', killed, ' | Injured: ', injured, chr(10), 'Summary: ', text, chr(10))"
_on_reports("g_block", lambda r: _blocks(r), f"SELECT doc AS query_id, seq AS rank, {_SQL_BLOCK} AS block FROM r")


def _prompts(r: DataFrame) -> DataFrame:
    none, c = F.array().cast("array<string>"), F.col
    fields = {"date": F.lit(""), "state": F.lit(""), "country": F.lit("India"), "attack_types": none, "target_types": none, "weapon_types": none, "responsible_groups": F.array("grp"), "summary": c("text")}
    ranked = r.select(c("doc").alias("id"), (c("seq") + 1).alias("rank"), F.lit(0.5).alias("score"), "city", "killed", "injured", *[v.alias(k) for k, v in fields.items()])
    questions = r.groupBy(c("doc").alias("id")).agg(F.concat(F.lit("What is told of "), F.min("city")).alias("question"))
    return ranking.prompts(ranked, questions, 600)


_on_reports("g_prompt", lambda r: _prompts(r).select("id", "n", "user_prompt"), f"""SELECT id, CAST(n AS INT) AS n, concat('ANALYTICAL QUERY: What is told of ', city, chr(10), chr(10), 'RELEVANT INCIDENTS (', n, ' retrieved):', chr(10), context, chr(10), {', chr(10), '.join(repr(t).replace(chr(34), chr(39)) if chr(39) not in t else "'" + t.replace("'", "''") + "'" for t in ranking.CLOSING.split(chr(10)))}) AS user_prompt
 FROM (SELECT id, min(c) AS city, count(*) AS n, string_agg(CASE WHEN cum <= 600 THEN block ELSE concat(block[:600 - cum + length(block)], '... [TRUNCATED]', chr(10), chr(10)) END, '' ORDER BY seq) AS context
  FROM (SELECT doc AS id, seq, (min(city) OVER (PARTITION BY doc)) AS c, block, sum(length(block)) OVER (PARTITION BY doc ORDER BY seq) AS cum FROM (SELECT *, {_SQL_BLOCK} AS block FROM r)) WHERE cum <= 600 OR (cum - length(block) <= 600 AND 600 - cum + length(block) > 200) GROUP BY id)""")
_add("e2_sliding", lambda s, d: stream.counts(s.read.parquet(f"{d}/events.parquet"), "1 hour", "30 minutes"),
     "SELECT CAST(epoch(date_trunc('hour', ts + INTERVAL 30 MINUTE * o)) AS BIGINT) - 1800 * o AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS t(o) GROUP BY ALL")
_add("e3_sessions", lambda s, d: stream.sessions(s.read.parquet(f"{d}/events.parquet")),
     """WITH g AS (SELECT user_id, ts, CAST(coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS INT) AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM n GROUP BY user_id, i""")


from quillon.plans import incident_tables  # noqa: E402, F401  (it adds its queries to these)


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
