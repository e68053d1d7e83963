"""Queries on a table of incidents: lookups, sinks, searches, prompts and measures, each with its SQL.

The table is rendered from ``events`` by expressions that both engines share; so are the questions, one
for each event whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vocab
from quillon.functions.casualties import digits
from quillon.functions.embedding import DIM, embed
from quillon.operators import evaluation, ranking, retrieval, search
from quillon.plans import registry as R
from quillon.sources import datasets, tables

_LABELS = {  # array columns as items by the remainder of the id
    "attack_types": [["Bombing/Explosion"], ["Armed Assault"], ["Hostage Taking (Kidnapping)"], ["Facility/Infrastructure Attack"], ["Bombing/Explosion", "Armed Assault"]],
    "target_types": [["Police"], ["Military"], ["Religious Figures/Institutions"], ["Private Citizens & Property"], [], ["Transportation"]],
    "weapon_types": [["Explosives"], ["Firearms"], [], ["Incendiary"]],
    "target_organizations": [["CRPF"], ["Border Security Force", "BSF"], []],
}


def _array(values: list[list[str]], sql: bool) -> str:
    made = lambda v: ("[" + ", ".join(f"'{x}'" for x in v) + "]" + ("::VARCHAR[]" if not v else "")) if sql else f"array({', '.join(repr(x) for x in v)})" if v else "cast(array() as array<string>)"
    return f"CASE report_id % {len(values)} " + " ".join(f"WHEN {i} THEN {made(v)}" for i, v in enumerate(values)) + " END"


_DATE = "CASE WHEN report_id % 8 < 6 THEN concat('2019-04-', lpad(cast(day as varchar(2)), 2, '0')) ELSE '' END"
_COUNTRY = "CASE WHEN report_id % 9 = 4 THEN 'Nepal' ELSE 'India' END"
_PLAIN = {"incident_id": "cast(report_id as varchar(20))", "date": _DATE, "country": _COUNTRY, "state": R._STATE, "city": "city", "killed": "killed", "injured": "injured", "summary": "text", "has_summary": "report_id % 3 <> 1", "source_document_id": "cast(doc as varchar(20))"}
_I = "i AS MATERIALIZED (SELECT report_id, " + ", ".join(f"{e} AS {c}" for c, e in _PLAIN.items()) + ", " + ", ".join(f"{_array(v, True)} AS {c}" for c, v in _LABELS.items()) + ", [grp] AS responsible_groups, 1.0::DOUBLE AS location_confidence FROM r)"
_WITH = f"WITH {R._R}, {_I}"


def incidents(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    plain = [f"{e} AS {c}" for c, e in _PLAIN.items()]
    return R.reports(spark, sf_dir, spread).selectExpr("report_id", *plain, *[f"{_array(v, False)} AS {c}" for c, v in _LABELS.items()], "array(grp) AS responsible_groups", "cast(1.0 as double) AS location_confidence")


def _on(name: str, make, sql: str) -> None:
    R._add(name, lambda s, d: make(incidents(s, d)), f"{_WITH} {sql}")


# --- lookups ---

_on("q_by_id", lambda i: tables.by_id(i, "7").select("incident_id", "city", "killed"), "SELECT incident_id, city, killed FROM i WHERE incident_id = '7'")
_on("q_country", lambda i: tables.by_country(i, "Nepal").select("incident_id"), "SELECT incident_id FROM i WHERE country = 'Nepal'")
_on("q_state", lambda i: tables.by_state(i, "Jammu and Kashmir").select("incident_id"), "SELECT incident_id FROM i WHERE state = 'Jammu and Kashmir'")
_on("q_attack_label", lambda i: tables.by_attack(i, "bomb_ng").select("incident_id"), "SELECT incident_id FROM i WHERE array_to_string(attack_types, ',') ILIKE '%bomb_ng%'")
_on("q_group", lambda i: tables.by_group(i, "lashkar%taiba").select("incident_id"), "SELECT incident_id FROM i WHERE array_to_string(responsible_groups, ',') ILIKE '%lashkar%taiba%'")
_on("q_target_org", lambda i: tables.by_target_organization(i, "force,bsf").select("incident_id"), "SELECT incident_id FROM i WHERE array_to_string(target_organizations, ',') ILIKE '%force,bsf%'")
_on("q_date", lambda i: tables.by_date(i, "2019-04-05", "2019-04-11").select("incident_id"), "SELECT incident_id FROM i WHERE date >= '2019-04-05' AND date <= '2019-04-11'")
_on("q_explorer_cols", lambda i: tables.explorer(i, ["incident_id", "city", "no such column", "killed"]), "SELECT incident_id, city, killed FROM i")
_on("q_badge", lambda i: i.select("incident_id", T.badge(F.col("killed") / 51.0).alias("badge")), "SELECT incident_id, concat(CASE WHEN killed / 51.0::DOUBLE > 0.8 THEN 'High ' ELSE '' END, 'Match (', printf('%.2f', killed / 51.0::DOUBLE), ')') AS badge FROM i")
_on("q_defaults", lambda i: i.select("incident_id", T.default(F.col("date")).alias("date"), T.list_default(F.col("target_types")).alias("targets")), "SELECT incident_id, CASE WHEN date = '' THEN 'Unknown' ELSE date END AS date, CASE WHEN len(target_types) = 0 THEN 'Unknown' ELSE array_to_string(target_types, ', ') END AS targets FROM i")
_on("src_sql_scan", lambda i: datasets.with_defaults(i.withColumn("city", F.nullif("city", F.lit("Pune"))).withColumn("killed", F.nullif("killed", F.lit(2)))).select("incident_id", "city", "killed", F.size("attack_types").alias("n")), "SELECT incident_id, CASE WHEN city = 'Pune' THEN '' ELSE city END AS city, CASE WHEN killed = 2 THEN 0 ELSE killed END AS killed, CAST(len(attack_types) AS INT) AS n FROM i")

# --- texts and numbers ---

_TEXT_SQL = """concat('Date: ', CASE WHEN date = '' THEN 'Unknown' ELSE date END, chr(10), 'Location: ', city, ', ', state, ', ', country, chr(10), 'Attack Type: ', array_to_string(attack_types, ', '), chr(10),
 'Target Type: ', CASE WHEN len(target_types) = 0 THEN 'Unknown' ELSE array_to_string(target_types, ', ') END, chr(10), 'Weapon Type: ', CASE WHEN len(weapon_types) = 0 THEN 'Unknown' ELSE array_to_string(weapon_types, ', ') END, chr(10),
 'Responsible Group: ', array_to_string(responsible_groups, ', '), chr(10), 'Killed: ', killed, chr(10), 'Injured: ', injured, CASE WHEN has_summary THEN concat(chr(10), chr(10), 'Summary:', chr(10), summary) ELSE '' END)"""
_as_text = lambda i: i.withColumn("retrieval_text", T.retrieval_text({c: F.col(c) for c in i.columns}))
_on("fx_retrieval_text", lambda i: _as_text(i).select("incident_id", "retrieval_text"), f"SELECT incident_id, {_TEXT_SQL} AS retrieval_text FROM i")
_on("fx_image_text", lambda i: i.select("incident_id", T.image_text(F.when(F.col("report_id") % 2 == 0, F.col("city")), F.when(F.col("report_id") % 3 == 0, F.col("state")).otherwise("")).alias("t")),
    "SELECT incident_id, CASE WHEN report_id % 6 = 0 THEN concat('Caption: ', city, chr(10), 'OCR: ', state) WHEN report_id % 2 = 0 THEN concat('Caption: ', city) WHEN report_id % 3 = 0 THEN concat('OCR: ', state) ELSE 'Image with no caption or extracted text.' END AS t FROM i")
_NUMBERS = ["'12'", "' 7.9 '", "'-3.5'", "'1e20'", "'NaN'", "'inf'", "'x'", "''", "cast(null as varchar(9))", "cast(killed as varchar(9))"]
_NUMBER = f"CASE report_id % {len(_NUMBERS)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_NUMBERS)) + " END"
_VALUE = f"CASE report_id % {len(_NUMBERS)} WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 2 THEN -3 WHEN 9 THEN killed END"
_on("fx_parse_int", lambda i: i.select("incident_id", T.parse_int(F.expr(_NUMBER)).alias("n")), f"SELECT incident_id, CAST(coalesce({_VALUE}, 0) AS INT) AS n FROM i")
_on("fx_parse_casualty", lambda i: i.select("incident_id", T.parse_casualty(F.expr(_NUMBER)).alias("n")), f"SELECT incident_id, CAST({_VALUE} AS INT) AS n FROM i")
_on("fx_contains_any", lambda i: i.select("incident_id", T.contains_any(F.array(F.lit("BOMB"), F.lit("taking")), F.col("attack_types")).alias("hit")), "SELECT incident_id, report_id % 5 IN (0, 2, 4) AS hit FROM i")
_WORDS = ["twenty-five were seen", "Forty two, dozens", "one hundred seventeen", "twenty nineteen", "both and several"]
_on("fx_wordnum", lambda i: i.select("incident_id", F.element_at(F.array(*[F.lit(digits(w)) for w in _WORDS]), (F.col("report_id") % 5 + 1).cast("int")).alias("t")), "SELECT incident_id, ['25 were seen', '42, 24', '1 hundred 17', 'twenty nineteen', '2 and 3'][report_id % 5 + 1] AS t FROM i")
_on("ag_set_union", lambda i: i.groupBy("city").agg(F.array_join(tables.set_union("attack_types"), ",").alias("attacks")), "SELECT city, array_to_string(list_sort(list_distinct(flatten(list(attack_types)))), ',') AS attacks FROM i GROUP BY city")

# --- collections ---


def _records(i: DataFrame) -> DataFrame:
    return tables.incident_records(_as_text(i).withColumn("embedding", F.when(F.col("report_id") % 4 != 0, F.array(F.lit(1.0)))))


def _pictures(i: DataFrame) -> DataFrame:
    vector = lambda n: F.when(F.col("report_id") % n == 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    return i.select(F.col("incident_id").alias("asset_id"), F.concat("city", F.lit(".png")).alias("filename"), F.col("state").alias("ocr_text"), F.lit(None).cast("string").alias("caption"), "source_document_id", F.lit("t").alias("retrieval_text"), vector(2).alias("text_embedding"), vector(3).alias("image_embedding"))


_on("snk_add_incidents", lambda i: _records(i).select("id", "collection", "modality", F.col("metadata")["attack_types"].alias("attacks"), F.col("metadata")["killed"].alias("killed"), F.col("metadata")["embedding_type"].alias("kind")),
    "SELECT incident_id AS id, 'incidents' AS collection, 'text' AS modality, array_to_string(attack_types, ', ') AS attacks, CAST(killed AS VARCHAR) AS killed, 'hashed-words' AS kind FROM i WHERE report_id % 4 <> 0")
_on("snk_add_image", lambda i: tables.picture_records(_pictures(i)).select("id", "collection", "modality", F.col("metadata")["filename"].alias("filename"), F.col("metadata")["embedding_type"].alias("kind")),
    "SELECT incident_id AS id, c AS collection, m AS modality, concat(city, '.png') AS filename, k AS kind FROM i, (VALUES ('incidents', 'text', 'hashed-words', 2), ('incidents_images', 'image', 'picture', 3)) AS v(c, m, k, n) WHERE report_id % n = 0")
_on("snk_add_raw", lambda i: i.select("incident_id", F.to_json(tables.raw_metadata({"n": F.col("killed").cast("string"), "list": F.to_json("target_organizations")})).alias("metadata")),
    "SELECT incident_id, concat('{\"n\":\"', killed, '\",\"list\":\"', CASE report_id % 3 WHEN 0 THEN '[\\\"CRPF\\\"]' WHEN 1 THEN '[\\\"Border Security Force\\\",\\\"BSF\\\"]' ELSE '[]' END, '\"}') AS metadata FROM i")
_on("x_metadata", lambda i: i.select(tables.metadata(i).alias("m")).select(*tables.incident_of(F.col("m")).values()).select("incident_id", "date", "killed", "has_summary", F.array_join("target_types", "|").alias("targets"), F.array_join("attack_types", "|").alias("attacks")),
    "SELECT incident_id, date, killed, has_summary, array_to_string(target_types, '|') AS targets, array_to_string(attack_types, '|') AS attacks FROM i")
_on("ag_collection_count", lambda i: tables.counts(tables.union_all([_records(i), tables.picture_records(_pictures(i))])).select(F.coalesce("collection", F.lit("all")).alias("collection"), "n"),
    "SELECT collection, count(*) AS n FROM (SELECT 'incidents' AS collection FROM i WHERE report_id % 4 <> 0 UNION ALL SELECT 'incidents' FROM i WHERE report_id % 2 = 0 UNION ALL SELECT 'incidents_images' FROM i WHERE report_id % 3 = 0) GROUP BY ALL UNION ALL SELECT 'all', count(*) FILTER (report_id % 4 <> 0) + count(*) FILTER (report_id % 2 = 0) + count(*) FILTER (report_id % 3 = 0) FROM i")

# --- questions ---

_M = "cast(floor(report_id / 20.0) as bigint)"
_MCITY = R._case(["Srinagar", "Mumbai", "Delhi", "Pune", "Imphal", "Patna", "Jammu"], _M)
_ASK = f"""CASE {_M} % 8 WHEN 0 THEN concat('Bombings in ', {_MCITY}, ' in 2019') WHEN 1 THEN concat('maoist attacks on police in ', {_MCITY}) WHEN 2 THEN 'What happened at the market in Imphal?' WHEN 3 THEN 'ULFA shooting near the railway bridge'
 WHEN 4 THEN 'Who is lashkar-e-taiba in Srinagar and kashmir' WHEN 5 THEN 'List soldiers killed by a grenade in 2018 and 2019' WHEN 6 THEN concat('trend of gun attacks in ', {_MCITY}) ELSE CASE WHEN {_M} % 16 = 7 THEN ' ' ELSE 'Compare kidnapping and arson in 2019' END END"""
_QI = f"a AS MATERIALIZED (SELECT report_id AS id, {_ASK} AS question FROM r WHERE report_id % 20 = 0)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reports(spark, sf_dir).where("report_id % 20 = 0").selectExpr("report_id AS id", f"{_ASK} AS question")


def _sql_named(names: list[str], spelled: dict[str, str]) -> str:
    ordered = sorted(names, key=lambda n: (-len(n), n))
    return "CASE " + " ".join(f"WHEN contains(lower(question), '{n}') THEN '{spelled.get(n, n.title())}'" for n in ordered) + " END"


def _sql_aliases() -> str:
    quoted = lambda v: v.replace("'", "''")
    parts = [rf"WHEN regexp_matches(lower(question), '\b{k}\b') OR " + " OR ".join(f"contains(lower(question), '{quoted(n)}')" for n in names) + " THEN [" + ", ".join(f"'{quoted(n)}'" for n in names) + "]" for k, names in ranking.ALIASES.items()]
    return "CASE " + " ".join(parts) + " END"


_FILTERS = rf"""{_QI}, f AS MATERIALIZED (SELECT id, question, {_sql_named(search.STATES, search.STATE_NAMES)} AS state, {_sql_named(search.CITIES, search.CITY_NAMES)} AS city, {_sql_aliases()} AS aliases, {R._sql_first(vocab.QUERY_ATTACK, 's?')} AS attack,
 {R._sql_first(vocab.QUERY_TARGET)} AS target, {R._sql_first(vocab.QUERY_WEAPON)} AS weapon, list_filter({vocab.DOCUMENT_WORDS}, lambda w: contains(lower(question), w)) AS words FROM a)"""


def _question_query(name: str, make, column: str) -> None:
    R._add(name, lambda s, d: questions(s, d).select("id", make(F.col("question")).alias("found")), f"WITH {R._R}, {_FILTERS} SELECT id, {column} AS found FROM f")


_question_query("qf_state", search.question_state, "state")
_question_query("qf_city", search.question_city, "city")
_question_query("qf_group", lambda q: F.array_join(ranking.group_aliases(q), "|"), "array_to_string(aliases, '|')")
_question_query("qf_dockw", lambda q: F.array_join(T.document_words(q), "|"), "array_to_string(words, '|')")

_CLAUSE = """coalesce(i.city = f.city, f.city IS NULL) AND coalesce(i.state = f.state, f.state IS NULL) AND (f.attack IS NULL OR contains(array_to_string(attack_types, ', '), f.attack)) AND (f.target IS NULL OR contains(array_to_string(target_types, ', '), f.target))
 AND (f.weapon IS NULL OR contains(array_to_string(weapon_types, ', '), f.weapon)) AND (f.aliases IS NULL OR len(list_filter(f.aliases, lambda x: contains(lower(array_to_string(responsible_groups, ', ')), x))) > 0)"""
_ASKS = "coalesce(f.city, f.state, f.attack, f.target, f.weapon, array_to_string(f.aliases, ',')) IS NOT NULL"


def _where(s: SparkSession, d: str) -> DataFrame:
    """How many incidents are what each question asks for."""
    asked = questions(s, d)
    texts, fits = retrieval.gathered(asked.select("question").distinct().select(F.col("question").alias("id"), search.question_filters(F.col("question")).alias("filters")))
    hits = search.matching(incidents(s, d, True), texts).withColumnRenamed("query_id", "question")
    return asked.join(retrieval.few(hits, fits), "question", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


R._add("qf_where", _where, f"{_WITH}, {_FILTERS}, g AS (SELECT state, city, aliases, attack, target, weapon, words FROM f GROUP BY ALL), h AS (SELECT f.*, (SELECT count(*) FROM i WHERE {_CLAUSE}) AS n FROM (SELECT *, {_ASKS} AS asks FROM g f) f WHERE asks) SELECT f.id, coalesce(h.n, 0) AS n FROM f LEFT JOIN h ON (f.state, f.city, f.attack, f.target, f.weapon) IS NOT DISTINCT FROM (h.state, h.city, h.attack, h.target, h.weapon) AND f.aliases IS NOT DISTINCT FROM h.aliases AND f.words = h.words")

# --- searches: vectors of whole numbers, so that both engines add the same ---

_counts = lambda t: embed(t, unit=False)
_FETCH, _TOP = 50, 10


def _indexed(s: SparkSession, d: str) -> DataFrame:
    return incidents(s, d, True).withColumn("document", F.col("summary")).withColumn("embedding", _counts(F.col("summary")))


def _sql_vectors(name: str, rows: str, key: str, text: str) -> str:
    return f"""{name}w AS (SELECT {key} AS key, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {rows}), {name}b AS MATERIALIZED (SELECT key, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {DIM} AS p, sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}w GROUP BY ALL),
 {name}n AS (SELECT key, sqrt(sum(v * v)) AS norm FROM {name}b GROUP BY key)"""


_DOT = f"""{_sql_vectors('d', 'i', 'incident_id', 'summary')}, {_sql_vectors('f', "(SELECT * FROM f WHERE trim(question) <> '')", 'id', 'question')}, dots AS (SELECT f.key AS id, d.key AS incident_id, sum(f.v * d.v) AS dot FROM fb f JOIN db d ON f.p = d.p GROUP BY ALL),
 s AS MATERIALIZED (SELECT q.key AS id, n.key AS incident_id, round(coalesce(dot, 0) / (q.norm * n.norm), 6) AS score FROM fn q CROSS JOIN dn n LEFT JOIN dots ON dots.id = q.key AND dots.incident_id = n.key)"""
_BY = "ORDER BY score DESC, incident_id"
_VARIANTS = "list_distinct([w, concat(upper(w[1]), w[2:]), upper(w)])"
_FOUND = f"""{_WITH}, {_FILTERS}, {_DOT}, x AS (SELECT s.*, f.question, f.words, f.attack, i.* EXCLUDE (incident_id), {_ASKS} AND {_CLAUSE} AS fits FROM s JOIN f ON f.id = s.id JOIN i ON i.incident_id = s.incident_id),
 hits AS (SELECT id, incident_id, false AS kw FROM x WHERE fits QUALIFY row_number() OVER (PARTITION BY id {_BY}) <= {_FETCH} UNION ALL SELECT id, incident_id, false FROM x QUALIFY row_number() OVER (PARTITION BY id {_BY}) <= {_FETCH}
  UNION ALL SELECT id, incident_id, true FROM (SELECT id, incident_id, score, summary, unnest(flatten(list_transform(words, lambda w: {_VARIANTS}))) AS variant FROM x WHERE len(words) > 0) WHERE contains(summary, variant) QUALIFY row_number() OVER (PARTITION BY id, variant {_BY}) <= 20),
 u AS (SELECT id, incident_id, bool_or(kw) AS kw FROM hits GROUP BY ALL)"""
_NAMED = " OR ".join(rf"(regexp_matches(lower(question), '\b{k}\b') AND (" + " OR ".join("contains(lower(responsible_groups[1]), '" + n.replace("'", "''") + "')" for n in names) + "))" for k, names in ranking.ALIASES.items())
_SCORED = f"""{_FOUND}, z AS (SELECT x.id, x.incident_id, x.city, x.summary, round(x.score + (0.10::DOUBLE * CAST(date <> '' AND contains(question, date[:4]) AS INT) + 0.10::DOUBLE * CAST(contains(lower(question), lower(x.city)) OR contains(lower(question), lower(x.state)) OR contains(lower(question), lower(country)) AS INT)
  + 0.15::DOUBLE * CAST(contains(lower(question), lower(responsible_groups[1])) OR {_NAMED} AS INT)) + CASE WHEN kw THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN x.attack IS NULL THEN 0 WHEN list_contains(attack_types, x.attack) THEN 1 ELSE -0.5::DOUBLE END, 6) AS score
  FROM u JOIN x ON x.id = u.id AND x.incident_id = u.incident_id), t AS (SELECT *, row_number() OVER (PARTITION BY id {_BY}) AS rank FROM z QUALIFY rank <= {_TOP})"""
R._add("r_search", lambda s, d: search.search(_indexed(s, d), questions(s, d), _TOP, embedder=_counts).select("id", "incident_id", "rank", "score"), f"{_SCORED} SELECT id, incident_id, CAST(rank AS INT) AS rank, score FROM t QUALIFY score >= max(score) OVER (PARTITION BY id) - 0.05::DOUBLE")
R._add("r_sort_topk", lambda s, d: search.search(_indexed(s, d), questions(s, d), _TOP, None, _counts).select("id", "incident_id", "rank", "score"), f"{_SCORED} SELECT id, incident_id, CAST(rank AS INT) AS rank, score FROM t")
R._add("r_unfiltered_diff", lambda s, d: search.window_effect(search.search(_indexed(s, d), questions(s, d), _TOP, None, _counts).withColumnRenamed("id", "query_id")), f"{_SCORED}, b AS (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM t) SELECT id AS query_id, count(*) AS candidates, count(*) FILTER (score >= best - 0.05::DOUBLE) AS kept, round(max(score) - min(score), 6) AS spread FROM b GROUP BY id")
R._add("r_mem", lambda s, d: search.search_uploaded(_indexed(s, d), questions(s, d), embedder=_counts).select("id", "incident_id", "rank", "score"), f"{_WITH}, {_FILTERS}, {_DOT}, t AS (SELECT *, row_number() OVER (PARTITION BY id {_BY}) AS rank FROM s QUALIFY rank <= 10), k AS (SELECT * FROM t WHERE score > 0.25) SELECT id, incident_id, CAST(rank AS INT) AS rank, score FROM k QUALIFY score >= max(score) OVER (PARTITION BY id) - 0.05::DOUBLE")
R._add("r_embed_d", lambda s, d: _indexed(s, d).select("incident_id", F.posexplode("embedding").alias("p", "v")).where("v <> 0").select("incident_id", "p", F.col("v").cast("double").alias("v")), f"{_WITH}, {_sql_vectors('d', 'i', 'incident_id', 'summary')} SELECT key AS incident_id, CAST(p AS INT) AS p, v FROM db WHERE v <> 0")
_on("r_scope", lambda i: search.in_scope(i.withColumn("collection", F.expr("CASE report_id % 3 WHEN 0 THEN 'incidents' WHEN 1 THEN 'uploaded_incidents' ELSE 'other' END")), "combined").select("incident_id"), "SELECT incident_id FROM i WHERE report_id % 3 < 2")
_SEEN = "concat(city, CASE WHEN report_id % 6 = 0 THEN ' market' ELSE ' police station' END)"


def _seen(s: SparkSession, d: str) -> DataFrame:
    pictures = incidents(s, d, True).where("report_id % 3 = 0").select(F.col("incident_id").alias("asset_id"), F.expr("CASE WHEN report_id % 2 = 0 THEN concat('On what happened at the market in imphal?', incident_id) ELSE 'x.png' END").alias("filename"), _counts(F.expr(_SEEN)).alias("embedding"))
    return search.search_pictures(pictures, questions(s, d), 7, _counts).select("query_id", "asset_id", "score")


R._add("r_image", _seen, f"""{_WITH}, {_QI}, k AS (SELECT incident_id, {_SEEN} AS t FROM i WHERE report_id % 3 = 0), {_sql_vectors('d', 'k', 'incident_id', 't')}, {_sql_vectors('f', "(SELECT * FROM a WHERE trim(question) <> '')", 'id', 'question')},
 dots AS (SELECT f.key AS id, d.key AS incident_id, sum(f.v * d.v) AS dot FROM fb f JOIN db d ON f.p = d.p GROUP BY ALL), s AS (SELECT q.key AS id, n.key AS incident_id, round(coalesce(dot, 0) / (q.norm * n.norm), 6) AS score FROM fn q CROSS JOIN dn n LEFT JOIN dots ON dots.id = q.key AND dots.incident_id = n.key QUALIFY row_number() OVER (PARTITION BY q.key ORDER BY round(coalesce(dot, 0) / (q.norm * n.norm), 6) DESC, n.key) <= 7)
 SELECT s.id AS query_id, s.incident_id AS asset_id, round(score + CASE WHEN i.report_id % 2 = 0 AND question = 'What happened at the market in Imphal?' THEN 0.10::DOUBLE ELSE 0 END, 6) AS score FROM s JOIN a ON a.id = s.id JOIN i ON i.incident_id = s.incident_id""")
R._add("g_rag", lambda s, d: search.answers(_indexed(s, d), questions(s, d), embedder=_counts).select("id", F.when(F.col("answer").isin(search.REFUSAL, search.NOTHING), F.col("answer")).otherwise("answered").alias("answer")),
       f"WITH {R._R}, {_QI} SELECT id, CASE WHEN question = ' ' THEN '{search.NOTHING}' WHEN contains(question, 'trend') THEN '{search.REFUSAL}' ELSE 'answered' END AS answer FROM a")
_QUOTED = lambda t: "concat(" + ", chr(10), ".join("'" + part.replace("'", "''") + "'" for part in t.split("\n")) + ")"
R._add("g_system_prompt", lambda s, d: questions(s, d).select("id", ranking.system_prompt(F.col("question")).alias("prompt")),
       f"WITH {R._R}, {_QI} SELECT id, concat({_QUOTED(ranking.SYSTEM)}, CASE WHEN regexp_matches(lower(question), '\\blist\\b') THEN {_QUOTED(ranking.FORMATS['enumeration'])} WHEN contains(question, 'Compare') THEN {_QUOTED(ranking.FORMATS['comparison'])} WHEN contains(question, 'Who is') THEN {_QUOTED(ranking.FORMATS['factual'])} ELSE {_QUOTED(ranking.FORMATS['summary'])} END) AS prompt FROM a")

# --- measures ---

_CODED = {"summary": "text", "attacktype1_txt": R._case(["Bombing/Explosion", "Armed Assault", "Hostage Taking (Kidnapping)", "Facility/Infrastructure Attack", "Unknown", "Hijacking"], "report_id"), "weaptype1_txt": R._case(["Explosives", "Firearms", "Unknown"], "report_id"),
          "targtype1_txt": R._case(["Police", "Military", "Business", "Unknown", "NGO", "no such label"], "report_id"), "nkill": "CASE WHEN report_id % 7 = 3 THEN '' ELSE concat(cast(killed as varchar(9)), '.0') END", "nwound": "CASE WHEN report_id % 5 = 3 THEN 'n/a' ELSE cast(injured + report_id % 2 as varchar(9)) END"}


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reports(spark, sf_dir).selectExpr("report_id", *[f"{e} AS {c}" for c, e in _CODED.items()])


def _sql_mapped(label: str, got: str, mapping: dict[str, list[str]]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN list_has_any({got}, {v})" for k, v in mapping.items())
    return f"CASE WHEN {label} = 'Unknown' THEN len({got}) = 0 ELSE CASE {label} {whens} ELSE false END END"


_RESULTS = f"""WITH {R._R}, c AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _CODED.items())}, {R._sql_list(vocab.ATTACK)} AS ga, {R._sql_list(vocab.WEAPON)} AS gw, {R._sql_list(vocab.TARGET)} AS gt FROM r),
m AS (SELECT report_id, summary, 'attack_type' AS field, attacktype1_txt = 'Unknown' AS unknown, {_sql_mapped('attacktype1_txt', 'ga', vocab.LABEL_MAPS['attack'])} AS correct FROM c UNION ALL SELECT report_id, summary, 'weapon_type', weaptype1_txt = 'Unknown', {_sql_mapped('weaptype1_txt', 'gw', vocab.LABEL_MAPS['weapon'])} FROM c
 UNION ALL SELECT report_id, summary, 'target_type', targtype1_txt = 'Unknown', {_sql_mapped('targtype1_txt', 'gt', vocab.LABEL_MAPS['target'])} FROM c UNION ALL SELECT report_id, summary, 'killed', report_id % 7 = 3, report_id % 7 <> 3 OR killed = 0 FROM c UNION ALL SELECT report_id, summary, 'wounded', report_id % 5 = 3, CASE WHEN report_id % 5 = 3 THEN injured = 0 ELSE report_id % 2 = 0 END FROM c)"""
_METRICS = "SELECT field, count(*) AS total, count(*) FILTER (NOT unknown) AS known, count(*) FILTER (NOT unknown AND correct) AS correct, count(*) FILTER (unknown AND correct) AS correct_unknown, round(count(*) FILTER (NOT unknown AND correct) * 100.0::DOUBLE / count(*) FILTER (NOT unknown), 6) AS accuracy_known, round(count(*) FILTER (correct) * 100.0::DOUBLE / count(*), 6) AS accuracy_all FROM m GROUP BY field"
R._add("ag_fieldmetrics", lambda s, d: evaluation.field_metrics(evaluation.coded_results(coded(s, d))), f"{_RESULTS} {_METRICS}")
R._add("snk_failures", lambda s, d: evaluation.coded_failures(evaluation.coded_results(coded(s, d))).groupBy("field").agg(F.count("*").alias("n"), F.min("summary").alias("first")), f"{_RESULTS} SELECT field, count(*) AS n, min(summary) AS first FROM m WHERE NOT unknown AND NOT correct GROUP BY field")
R._add("j_evalmap", lambda s, d: coded(s, d).select("report_id", evaluation.mapped_match(F.col("attacktype1_txt"), T.attack_types(F.col("summary")), vocab.LABEL_MAPS["attack"]).alias("hit")), f"{_RESULTS} SELECT report_id, correct AND NOT unknown AS hit FROM m WHERE field = 'attack_type'")


def _truth(i: DataFrame) -> DataFrame:
    return i.where("report_id % 10 <> 9").select(F.col("incident_id").alias("name"), *evaluation.SCALARS, *evaluation.LISTS)


def _extracted(i: DataFrame) -> DataFrame:
    """What an extractor would have made of them: some fields in other letters, missing, off by one or cut."""
    c, by = F.col, lambda n, k, a, b: F.when(F.col("report_id") % n == k, a).otherwise(b)
    none = F.array().cast("array<string>")
    changes = {"city": by(4, 1, F.upper("city"), c("city")), "state": by(6, 2, F.lit(None), c("state")), "killed": by(7, 3, c("killed") + 1, c("killed")), "responsible_groups": by(3, 1, none, F.transform("responsible_groups", lambda g: F.concat(F.lit(" the "), F.upper(g)))),
               "target_organizations": by(2, 0, F.array(F.lit("CRPF")), F.array(F.lit("bsf"), F.lit("Army"))), "attack_types": by(5, 4, F.slice("attack_types", 1, 1), c("attack_types"))}
    return i.where("report_id % 10 <> 8").select(F.col("incident_id").alias("name"), *[changes.get(f, c(f)).alias(f) for f in evaluation.SCALARS + evaluation.LISTS])


# expected and actual number of items, and hits, of each list field
_SIZES = {
    "responsible_groups": ("1", "CASE WHEN report_id % 3 = 1 THEN 0 ELSE 1 END", "CASE WHEN report_id % 3 = 1 THEN 0 ELSE 1 END"), "target_organizations": ("len(target_organizations)", "1 + report_id % 2", "CASE WHEN report_id % 6 = 0 THEN 1 WHEN report_id % 3 = 1 AND report_id % 2 = 1 THEN 1 ELSE 0 END"),
    "attack_types": ("len(attack_types)", "1", "1"), "weapon_types": ("len(weapon_types)", "len(weapon_types)", "len(weapon_types)"), "target_types": ("len(target_types)", "len(target_types)", "len(target_types)"),
}
_RIGHT = {"date": "true", "country": "true", "state": "report_id % 6 <> 2", "city": "true", "killed": "report_id % 7 <> 3", "injured": "true"}
_BOTH = "FROM i WHERE report_id % 10 < 8"
_COMPARED = f"""{_WITH}, l AS ({' UNION ALL '.join(f"SELECT incident_id AS name, '{f}' AS field, CAST({e} AS INT) AS e, CAST({a} AS INT) AS a, CAST({h} AS INT) AS tp {_BOTH}" for f, (e, a, h) in _SIZES.items())}),
 y AS (SELECT name, field, a - tp AS fp, e - tp AS fn, CASE WHEN e = 0 AND a = 0 THEN 1 WHEN a = 0 THEN 0 ELSE tp / a::DOUBLE END AS p, CASE WHEN e = 0 AND a = 0 THEN 1 WHEN e = 0 THEN 0 ELSE tp / e::DOUBLE END AS r FROM l),
 m AS (SELECT name, field, 'list' AS kind, fp = 0 AND fn = 0 AS correct, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1, fp, fn FROM y UNION ALL {' UNION ALL '.join(f"SELECT incident_id, '{f}', 'scalar', {e}, NULL, NULL, NULL, NULL, NULL {_BOTH}" for f, e in _RIGHT.items())})"""
_compared = lambda i: evaluation.compare(_truth(i), _extracted(i))
_on("j_truth", lambda i: _compared(i).groupBy("name").agg(F.count("*").alias("fields"), F.count_if("correct").alias("right")), "X")
R._S["j_truth"] = f"{_COMPARED} SELECT name, count(*) AS fields, count(*) FILTER (correct) AS \"right\" FROM m GROUP BY name"
_on("ag_setscore", lambda i: _compared(i).where("kind = 'list'").select("name", "field", F.round("precision", 6).alias("p"), F.round("recall", 6).alias("r"), F.round("f1", 6).alias("f"), "fp", "fn"), "X")
R._S["ag_setscore"] = f"{_COMPARED} SELECT name, field, round(precision, 6) AS p, round(recall, 6) AS r, round(f1, 6) AS f, fp, fn FROM m WHERE kind = 'list'"
_on("ag_macro", lambda i: evaluation.macro(_compared(i)), "X")
R._S["ag_macro"] = f"{_COMPARED} SELECT coalesce(field, 'all ' || kind) AS field, count(*) AS documents, CASE WHEN kind = 'scalar' THEN count(*) FILTER (correct) END AS correct, CASE WHEN kind = 'scalar' THEN round(count(*) FILTER (correct) * 100.0::DOUBLE / count(*), 6) END AS pct, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM m GROUP BY GROUPING SETS ((kind, field), (kind))"
_on("ag_failures", lambda i: evaluation.top_failures(evaluation.failures(_compared(i))).select("field", "field_rank", "errors", "n", "name"), "X")
R._S["ag_failures"] = f"{_COMPARED}, e AS (SELECT field, name, CAST(row_number() OVER (PARTITION BY field ORDER BY name) AS INT) AS n, count(*) OVER (PARTITION BY field) AS errors FROM m WHERE NOT correct), k AS (SELECT field, CAST(row_number() OVER (ORDER BY max(errors) DESC, field) AS INT) AS field_rank FROM e GROUP BY field) SELECT field, field_rank, errors, n, name FROM e JOIN k USING (field) WHERE n <= 5"
_on("ag_clusteval", lambda i: evaluation.cluster_counts(i.select(F.col("killed").alias("expected"), (F.col("killed") + F.col("report_id") % 3 - 1).alias("predicted"))), "SELECT count(*) AS documents, round(count(*) FILTER (report_id % 3 = 1) * 100.0::DOUBLE / count(*), 6) AS accuracy, CAST(sum(killed) AS BIGINT) AS expected, CAST(sum(killed + report_id % 3 - 1) AS BIGINT) AS predicted, count(*) FILTER (report_id % 3 = 2) AS false_splits, count(*) FILTER (report_id % 3 = 0) AS false_merges FROM i")
_on("ag_validate", lambda i: evaluation.cardinalities(datasets.subsets(i), vocab.EXPECTED_ROWS), f"SELECT n AS name, c AS rows, e AS expected, c = e AS ok FROM (SELECT 'full' AS n, count(*) AS c, {vocab.EXPECTED_ROWS['full']}::BIGINT AS e FROM i UNION ALL SELECT 'summary', count(*) FILTER (has_summary), {vocab.EXPECTED_ROWS['summary']} FROM i UNION ALL SELECT 'country', count(*) FILTER (country = 'India'), {vocab.EXPECTED_ROWS['country']} FROM i UNION ALL SELECT 'country_summary', count(*) FILTER (country = 'India' AND has_summary), {vocab.EXPECTED_ROWS['country_summary']} FROM i)")
_on("ag_latency", lambda i: evaluation.mean_latency(i.select(F.col("city").alias("step"), (F.col("killed") / 8).alias("seconds"))), "SELECT city AS step, count(*) AS runs, round(avg(killed / 8::DOUBLE), 6) AS mean_seconds FROM i GROUP BY city")
_on("x_corrected", lambda i: datasets.corrected(i, i.where("report_id % 5 = 0").select("incident_id", F.upper("state").alias("state")), "incident_id", "state").select("incident_id", "state"), "SELECT incident_id, CASE WHEN report_id % 5 = 0 THEN upper(state) ELSE state END AS state FROM i")
R._add("x_rendered", lambda s, d: datasets.rendered(R.reports(s, d).select(F.col("report_id").alias("n")), ["Pune", "Mumbai"]).select("name", "city", "killed", F.length("text").alias("length")),
       f"WITH {R._R} SELECT printf('incident_%05d', report_id) AS name, CASE report_id % 2 WHEN 0 THEN 'Pune' ELSE 'Mumbai' END AS city, CAST(report_id % 9 + 1 AS INT) AS killed, CAST(length(concat('On ', report_id % 28 + 1, ' April 2019 there was an attack. ', CASE report_id % 3 WHEN 0 THEN 'A car bomb exploded near ' WHEN 1 THEN 'Gunmen opened fire on ' ELSE 'Rebels torched ' END, CASE report_id % 3 WHEN 0 THEN 'a police station' WHEN 1 THEN 'a market' ELSE 'an army convoy' END, ' in ', CASE report_id % 2 WHEN 0 THEN 'Pune' ELSE 'Mumbai' END, '. ', report_id % 9 + 1, ' people were killed and ', report_id % 4 + 2, ' others were injured.')) AS INT) AS length FROM r")
