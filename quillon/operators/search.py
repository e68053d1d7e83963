"""Questions to incidents: what a question asks for, the union of three searches, scores, answers.

Searches run for a table of questions at once. What is asked in the same words is sought once, and the
results go to all who asked. Candidates come out of blocks of questions met with parts of the incidents, so
neither is ever held whole; scores are expressions over the candidates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillon.functions import text as T
from quillon.functions import vocab
from quillon.functions.embedding import embed
from quillon.operators import ranking, retrieval

# States and cities that a question may name, and cities that go by another name.
STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chandigarh", "chhattisgarh", "delhi", "goa", "gujarat", "haryana", "himachal pradesh", "jammu and kashmir", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra",
    "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "orissa", "puducherry", "punjab", "rajasthan", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttaranchal", "west bengal", "kashmir",
]
CITIES = [
    "mumbai", "new delhi", "delhi", "srinagar", "jammu", "imphal", "kolkata", "chennai", "hyderabad", "bangalore", "bengaluru", "pune", "ahmedabad", "jaipur", "lucknow", "patna", "guwahati", "agartala", "bhopal", "chandigarh",
    "thiruvananthapuram", "kochi", "coimbatore", "varanasi", "raipur", "ranchi", "shimla", "dehradun", "gangtok", "aizawl", "kohima", "itanagar", "panaji", "shillong", "dispur", "sopore", "baramulla", "anantnag", "pulwama", "kupwara",
    "uri", "pathankot", "gurdaspur", "amritsar", "ludhiana", "rajouri", "poonch", "doda", "kishtwar", "kathua", "udhampur", "handwara", "tral", "shopian", "kulgam", "bijbehara", "bandipora",
]
CITY_NAMES = {"delhi": "New Delhi", "bengaluru": "Bangalore"}
STATE_NAMES = {"kashmir": "Jammu and Kashmir"}
# Answers that need no search, and sizes of a search.
REFUSAL = "Broad statistical analysis is not currently supported by the retrieval engine. Please ask about a specific group, region, attack type, or incident."
NOTHING = "No relevant incidents found for the query."
TOP, WINDOW, KEYWORD_MOST, LEAST_SCORE = 20, 0.05, 20, 0.25


def _named(question: Column, names: list[str], spelled: dict[str, str]) -> Column:
    """The longest name that stands in a question, by name among equals; parts of words count."""
    low = F.lower(question)
    return F.coalesce(*[F.when(F.contains(low, F.lit(n)), spelled.get(n, n.title())) for n in sorted(names, key=lambda n: (-len(n), n))])


def question_state(question: Column, exact: bool = False) -> Column:
    """The state that a question names. Every word of a name gets a capital; with ``exact`` names are
    spelled as incidents have them."""
    spelled = STATE_NAMES | ({"jammu and kashmir": "Jammu and Kashmir"} if exact else {})
    return _named(question, STATES, spelled)


def question_city(question: Column) -> Column:
    return _named(question, CITIES, CITY_NAMES)


def question_filters(question: Column, exact: bool = False) -> Column:
    """struct(years, state, city, group_aliases, attack_type, target_type, weapon_type, doc_keywords)."""
    return F.struct(
        T.query_years(question).alias("years"), question_state(question, exact).alias("state"), question_city(question).alias("city"), ranking.group_aliases(question).alias("group_aliases"),
        T.first_label(question, vocab.QUERY_ATTACK, True).alias("attack_type"), T.first_label(question, vocab.QUERY_TARGET).alias("target_type"), T.first_label(question, vocab.QUERY_WEAPON).alias("weapon_type"), T.document_words(question).alias("doc_keywords"),
    )


def where_clause(filters: Column, r: dict[str, Column]) -> Column:
    """Whether an incident is all that a question asks for; null for one that asks for nothing. Years
    don't filter. Labels are sought in the joined lists, names of groups in any case of letters."""
    joined = lambda c: F.array_join(r[c], ", ")
    asks = [
        (filters["city"], r["city"] == filters["city"]), (filters["state"], r["state"] == filters["state"]), (filters["attack_type"], F.contains(joined("attack_types"), filters["attack_type"])),
        (filters["target_type"], F.contains(joined("target_types"), filters["target_type"])), (filters["weapon_type"], F.contains(joined("weapon_types"), filters["weapon_type"])),
        (filters["group_aliases"], F.exists(filters["group_aliases"], lambda a: F.contains(F.lower(joined("responsible_groups")), a))),
    ]
    holds = F.lit(True)
    for wanted, fits in asks:
        holds = holds & (wanted.isNull() | F.coalesce(fits, F.lit(False)))
    return F.when(F.coalesce(*[w.cast("string") for w, _ in asks]).isNotNull(), holds)


def _clause(asked: dict, city: list, state: list, lists: dict[str, list[str]], cache: dict) -> np.ndarray | None:
    """The same over a shard's incidents: one array of truths for each condition, kept for the next question."""

    def once(key: tuple, make: Callable[[], list]) -> np.ndarray:
        if key not in cache:
            cache[key] = np.fromiter(make(), bool, len(city))
        return cache[key]

    parts = []
    if asked["city"] is not None:
        parts.append(once(("city", asked["city"]), lambda: (c == asked["city"] for c in city)))
    if asked["state"] is not None:
        parts.append(once(("state", asked["state"]), lambda: (c == asked["state"] for c in state)))
    for name, column in (("attack_type", "attack_types"), ("target_type", "target_types"), ("weapon_type", "weapon_types")):
        if (label := asked[name]) is not None:
            parts.append(once((column, label), lambda column=column, label=label: (label in x for x in lists[column])))
    if asked["group_aliases"] is not None:
        parts.append(once(("groups", *asked["group_aliases"]), lambda: (any(a in x.lower() for a in asked["group_aliases"]) for x in lists["responsible_groups"])))
    return np.logical_and.reduce(parts) if parts else None


_SOUGHT = ["attack_types", "target_types", "weapon_types", "responsible_groups"]


def _columns(table: pa.Table) -> tuple[list, list, dict[str, list[str]]]:
    """Cities, states and joined lists of a shard's incidents."""
    return table["city"].to_pylist(), table["state"].to_pylist(), {c: [v or "" for v in table[c].to_pylist()] for c in _SOUGHT}


def matching(incidents: DataFrame, questions: DataFrame, shard: int = retrieval.SHARD, block: int = retrieval.BLOCK) -> DataFrame:
    """query_id, n: how many incidents are all that each question (id, filters) asks for; a question that asks
    for nothing has no row. Questions that ask for the same are counted once."""
    result = StructType.fromDDL("asks string, n long")
    rows = incidents.select("incident_id", "city", "state", *[F.array_join(c, ", ").alias(c) for c in _SOUGHT])

    def search(r: pa.Table, q: pa.Table) -> dict:
        own, cache = _columns(r), {}
        found = [(i, _clause(f, *own, cache)) for i, f in zip(q["asks"].to_pylist(), q["filters"].to_pylist(), strict=True)]
        return {"asks": [i for i, w in found if w is not None], "n": [int(w.sum()) for _, w in found if w is not None]}

    kinds, fits = retrieval.gathered(questions.select("filters").distinct().withColumn("asks", F.to_json("filters")), block)
    found = retrieval.in_blocks(rows, kinds, "incident_id", "asks", search, result, shard, block)
    counted = found.groupBy("asks").agg(F.sum("n").alias("n")).join(kinds, "asks")
    return questions.select(F.col("id").alias("query_id"), "filters").join(retrieval.few(counted, fits), "filters").select("query_id", "n")


def candidates(incidents: DataFrame, questions: DataFrame, fetch: int, keyword_most: int = KEYWORD_MOST, shard: int = retrieval.SHARD, block: int = retrieval.BLOCK) -> DataFrame:
    """query_id, vec_id, way, score: incidents (incident_id, embedding, document, city, state and lists) that
    a search of ``questions`` (id, filters, q) finds: the ``fetch`` nearest that are all it asks for (way
    ``filter``), the nearest of all (``any``), and for each of its words in three casings the nearest whose
    document holds it (``word:`` and the word)."""
    ids = StructType([StructField("query_id", questions.schema["id"].dataType), StructField("vec_id", incidents.schema["incident_id"].dataType)])
    result = StructType([*ids.fields, *StructType.fromDDL("way string, score double").fields])
    rows = incidents.select("incident_id", "embedding", "document", "city", "state", *[F.array_join(c, ", ").alias(c) for c in _SOUGHT])

    def search(r: pa.Table, q: pa.Table) -> dict:
        x, y = retrieval.matrix(r["embedding"]), retrieval.matrix(q["q"])
        names, documents = r["incident_id"].to_pylist(), [d or "" for d in r["document"].to_pylist()]
        own, out, cache = _columns(r), {c: [] for c in result.names}, {}

        def take(asked, scores: np.ndarray, where: np.ndarray | None, k: int, way: str) -> None:
            at = np.arange(len(scores)) if where is None else np.flatnonzero(where)
            for j in at[retrieval.best(scores[at], k)].tolist():
                out["query_id"].append(asked)
                out["vec_id"].append(names[j])
                out["way"].append(way)
                out["score"].append(float(scores[j]) + 0.0)

        for at in range(0, len(y), 128):
            for (asked, filters), scores in zip(zip(q["id"].to_pylist()[at : at + 128], q["filters"].to_pylist()[at : at + 128], strict=True), np.round(y[at : at + 128] @ x.T, 6), strict=True):
                where = _clause(filters, *own, cache)
                if where is not None:
                    take(asked, scores, where, fetch, "filter")
                take(asked, scores, None, fetch, "any")
                for word in filters["doc_keywords"]:
                    for cased in dict.fromkeys((word, word.title(), word.upper())):
                        if ("word", cased) not in cache:
                            cache["word", cased] = np.fromiter((cased in d for d in documents), bool, len(documents))
                        take(asked, scores, cache["word", cased], min(fetch, keyword_most), f"word:{cased}")
        return out

    found = retrieval.in_blocks(rows, questions.select("id", "filters", "q"), "incident_id", "id", search, result, shard, block, retrieval.best_of(fetch, "way"))
    ranked = retrieval.top(found, fetch, "way")
    return ranked.where(~F.col("way").startswith("word:") | (F.col("rank") <= keyword_most)).drop("rank")


def _texts(questions: DataFrame, embedder: Callable[[Column], Column]) -> tuple[DataFrame, bool]:
    """id, question, q of the different texts of questions that aren't blank, each its own id, and whether they fit one block."""
    texts = questions.where(F.trim(F.coalesce("question", F.lit(""))) != "").select("question").distinct()
    return retrieval.gathered(texts.select(F.col("question").alias("id"), "question", embedder(F.col("question")).alias("q")))


def _to_all(found: DataFrame, questions: DataFrame, fits: bool, name: str) -> DataFrame:
    """What is found for texts (query_id), for each question (id, question) of such a text, its id as ``name``."""
    asked = questions.select(F.col("id").alias("_asked"), F.col("question").alias("query_id"))
    return asked.join(retrieval.few(found, fits), "query_id").drop("query_id").withColumnRenamed("_asked", name)


def _pictures(pictures: DataFrame, texts: DataFrame, fits: bool, fetch: int) -> DataFrame:
    """``search_pictures`` for different texts, each its own id."""
    near = retrieval.nearest(pictures.select(F.col("asset_id").alias("vec_id"), "embedding"), texts.select(F.col("id").alias("query_id"), "q"), fetch, apart=True).drop("rank")
    named = retrieval.few(near, fits).join(pictures.drop("embedding"), F.col("vec_id") == F.col("asset_id"))
    by_name = F.when(F.contains(F.lower("filename"), F.lower("query_id")), 0.10).otherwise(0.0)
    return named.withColumn("score", F.round(F.col("score") + by_name, 6))


def search_pictures(pictures: DataFrame, questions: DataFrame, fetch: int, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """query_id, score and the picture's columns: the ``fetch`` pictures (asset_id, filename, embedding) nearest to each
    of ``questions`` (id, question) that isn't blank, a little more for one whose name holds the question."""
    texts, fits = _texts(questions, embedder)
    return _to_all(_pictures(pictures, texts, fits, fetch), questions, fits, "query_id")


def search(
    incidents: DataFrame, questions: DataFrame, top: int = TOP, window: float | None = WINDOW, embedder: Callable[[Column], Column] = embed, pictures: DataFrame | None = None, picture_embedder: Callable[[Column], Column] | None = None
) -> DataFrame:
    """id, incident_id, score, rank and the incident's columns: the ``top`` incidents of each question by
    similarity, bonuses and asked attack type, of these those within ``window`` of the best. A blank
    question has no results. Incidents need ``document`` and ``embedding``; ``pictures`` (asset_id, filename,
    embedding) take part by similarity, in the space of ``picture_embedder`` if it is another, and by name."""
    texts, fits = _texts(questions, embedder)
    asked = texts.withColumn("filters", question_filters(F.col("question")))
    found = candidates(incidents, asked, max(5 * top, 50))
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("similarity"), F.max(F.col("way").startswith("word:")).alias("keyword"))
    rows = retrieval.few(each, fits).join(incidents.drop("embedding", "document"), F.col("vec_id") == F.col("incident_id")).join(asked.select(F.col("id").alias("query_id"), "question", "filters"), "query_id")
    bonus = ranking.metadata_bonus(F.col("question"), F.col("date"), [F.col(c) for c in ("city", "state", "country")], F.col("responsible_groups"))
    scored = rows.withColumn("score", F.round(ranking.final_score(F.col("similarity"), bonus, F.col("keyword"), F.col("filters.attack_type"), F.col("attack_types")), 6))
    scored = scored.drop("question", "filters", "similarity", "keyword")
    if pictures is not None:
        look, small = _texts(questions, picture_embedder) if picture_embedder else (texts, fits)
        seen = _pictures(pictures, look, small, max(5 * top, 50)).join(asked.select(F.col("id").alias("query_id"), "filters"), "query_id")
        other = F.when(F.col("filters.attack_type").isNull(), 0.0).otherwise(ranking.WEIGHT["other_attack"])
        scored = scored.unionByName(seen.withColumn("score", F.round(F.col("score") + other, 6)).drop("filters"), allowMissingColumns=True)
    ranked = retrieval.top(scored, top)
    kept = ranked if window is None else retrieval.similarity_window(ranked, window)
    return _to_all(kept.drop("vec_id"), questions, fits, "id")


def search_uploaded(incidents: DataFrame, questions: DataFrame, top: int = 10, window: float | None = WINDOW, embedder: Callable[[Column], Column] = embed, least: float = LEAST_SCORE) -> DataFrame:
    """The same by similarity alone, above ``least``: of incidents that are in no collection yet."""
    texts, fits = _texts(questions, embedder)
    near = retrieval.nearest(incidents.select(F.col("incident_id").alias("vec_id"), "embedding"), texts.select(F.col("id").alias("query_id"), "q"), top, apart=True).where(F.col("score") > least)
    kept = near if window is None else retrieval.similarity_window(near, window)
    found = retrieval.few(kept, fits).join(incidents.drop("embedding"), F.col("vec_id") == F.col("incident_id")).drop("vec_id")
    return _to_all(found, questions, fits, "id")


#: What a search may cover, by the collections that take part.
SCOPES = {"upload": ["uploaded_incidents"], "history": ["incidents"], "combined": ["incidents", "uploaded_incidents"]}


def in_scope(rows: DataFrame, scope: str) -> DataFrame:
    return rows.where(F.col("collection").isin(SCOPES[scope]))


def window_effect(ranked: DataFrame, window: float = WINDOW) -> DataFrame:
    """query_id, candidates, kept, spread: what a similarity window leaves of ranked results."""
    highest = F.max("score").over(retrieval.Window.partitionBy("query_id"))
    told = ranked.withColumn("_in", F.col("score") >= highest - window)
    return told.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if("_in").alias("kept"), F.round(F.max("score") - F.min("score"), 6).alias("spread"))


def extract(prompt: Column) -> Column:
    """A stand-in for a language model: the summaries in a prompt's reports, as they are."""
    found = F.regexp_extract_all(prompt, F.lit(r"(?m)^Summary: (.*)$"), F.lit(1))
    return F.when(F.size(found) > 0, F.concat(F.lit("Extracted from the reports: "), F.array_join(found, " "))).otherwise("The reports have no summaries.")


def answers(incidents: DataFrame, questions: DataFrame, top: int = 10, window: float | None = WINDOW, generate: Callable[[Column, Column], Column] | None = None, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """id, answer, n (results) of every question that isn't blank or broad by way of a prompt; a broad question is
    refused, one without results told so. ``generate`` makes a text of (user prompt, system prompt);
    without it the answer is extracted. An answer ends with a whole sentence; questions of one text share one."""
    asked = questions.select("id", "question")
    broad = asked.where(T.is_broad(F.col("question"))).select("id", F.lit(REFUSAL).alias("answer"), F.lit(0).alias("n"))
    open_ = asked.where(~F.coalesce(T.is_broad(F.col("question")), F.lit(False)))
    texts, fits = retrieval.gathered(open_.where(F.col("question").isNotNull()).select("question").distinct().select(F.col("question").alias("id"), "question"))
    found = search(incidents, texts, top, window, embedder)
    prompts = ranking.prompts(found, texts)
    made = F.trim(generate(F.col("user_prompt"), F.col("system_prompt")) if generate else extract(F.col("user_prompt")))
    written = prompts.select(F.col("id").alias("question"), F.trim(T.whole_sentence(made)).alias("answer"), "n")
    told = open_.join(retrieval.few(written, fits), "question", "left").select("id", F.when(F.col("n").isNull(), NOTHING).otherwise(F.col("answer")).alias("answer"), F.coalesce("n", F.lit(0)).alias("n"))
    return broad.unionByName(told)
