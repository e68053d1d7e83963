"""Scores of incidents for questions, the union of several searches, and the prompt made of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.retrieval import budget

# Other names of groups by the key that a question uses, in order.
ALIASES = {
    "maoist": ["cpi-maoist", "maoist", "naxal", "maoists", "communist party of india - maoist (cpi-maoist)"],
    "jem": ["jaish-e-mohammad", "jem", "jaish-e-mohammed", "jaish-e-mohammad (jem)"],
    "let": ["lashkar-e-taiba", "let", "lashkar-e-toiba", "lashkar-e-tayyaba", "lashkar-e-taiba (let)"],
    "hm": ["hizbul mujahideen", "hizb-ul-mujahideen", "hizbul mujahideen (hm)"],
    "ulfa": ["united liberation front of assam", "ulfa", "united liberation front of assam (ulfa)"],
    "ndfb": ["national democratic front of bodoland", "ndfb", "national democratic front of bodoland (ndfb)"],
    "im": ["indian mujahideen", "im"],
    "simi": ["students islamic movement of india", "simi"],
    "bki": ["babbar khalsa international", "bki", "babbar khalsa international (bki)"],
    "ltte": ["liberation tigers of tamil eelam", "ltte"],
    "pwg": ["people's war group", "pwg", "people's war group (pwg)"],
}
# Weights of the bonus and of the final score.
WEIGHT = {"year": 0.10, "place": 0.10, "group": 0.15, "most": 0.35, "keyword": 0.15, "attack": 1.0, "other_attack": -0.5}


def group_aliases(query: Column) -> Column:
    """All names of the first group whose key stands in a query, or one of whose names it holds."""
    low = F.lower(query)
    return F.coalesce(*[F.when(low.rlike(rf"\b{k}\b") | reduce(lambda x, y: x | y, [F.contains(low, F.lit(n)) for n in names]), F.array(*map(F.lit, names))) for k, names in ALIASES.items()])


def _any(of: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, of)


def metadata_bonus(query: Column, date: Column, place: list[Column], groups: Column) -> Column:
    """Year, place and group of an incident that a query names, at most 0.35."""
    low = F.lower(query)
    year = F.coalesce(F.array_contains(T.query_years(query), F.substring(date, 1, 4)), F.lit(False))
    named = _any([F.coalesce((F.lower(p) != "unknown") & (p != "") & F.contains(low, F.lower(p)), F.lit(False)) for p in place])
    direct = lambda g: F.contains(low, g) | _any([low.rlike(rf"\b{k}\b") & _any([F.contains(g, F.lit(n)) for n in names]) for k, names in ALIASES.items()])
    group = F.coalesce(F.exists(F.transform(groups, F.lower), lambda g: (g != "") & (g != "unknown") & direct(g)), F.lit(False))
    return F.least(year.cast("double") * WEIGHT["year"] + named.cast("double") * WEIGHT["place"] + group.cast("double") * WEIGHT["group"], F.lit(WEIGHT["most"]))


def final_score(score: Column, bonus: Column, keyword_hit: Column, wanted_attack: Column, attacks: Column) -> Column:
    """Similarity, bonus, a keyword hit, and the asked attack type found or not."""
    attack = F.when(wanted_attack.isNull(), 0.0).when(F.coalesce(F.array_contains(attacks, wanted_attack), F.lit(False)), WEIGHT["attack"]).otherwise(WEIGHT["other_attack"])
    return score + bonus + F.when(keyword_hit, WEIGHT["keyword"]).otherwise(0.0) + attack


def best_of(parts: list[DataFrame], keys: list[str], score: str = "score") -> DataFrame:
    """Rows of several searches, each key once: its row with the best score, of equal ones that of the
    earliest search, with all its columns."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_part", F.lit(-i)) for i, p in enumerate(parts)])
    rest = [c for c in both.columns if c not in (*keys, score, "_part")]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(score, *rest), F.struct(score, "_part")).alias("_best"))
    return best.select(*keys, "_best.*")


def incident_block(r: dict[str, Column], rank: Column, score: Column) -> Column:
    """What a prompt says of an incident. Lists that are empty go, but for the groups."""
    known = lambda c: F.when((c != "") & (c != "Unknown"), c)
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")))
    groups = F.filter(r["responsible_groups"], lambda g: (g != "") & (F.lower(g) != "unknown"))
    return F.concat_ws(
        "\n", F.format_string("--- Incident Report #%d (Relevance: %.3f) ---", rank, score), F.concat(F.lit("Date: "), T.default(r["date"])), F.concat(F.lit("Location: "), T.default(F.concat_ws(", ", *[known(r[c]) for c in ("city", "state", "country")]))),
        listed("Attack Type", r["attack_types"]), listed("Target Type", r["target_types"]), listed("Weapon Type", r["weapon_types"]), F.concat(F.lit("Responsible Group: "), T.default(F.array_join(groups, ", "))),
        F.format_string("Killed: %d | Injured: %d", r["killed"], r["injured"]), F.when(F.trim(r["summary"]) != "", F.concat(F.lit("Summary: "), F.trim(r["summary"]))), F.lit(""),
    )


def image_block(r: dict[str, Column], rank: Column, score: Column) -> Column:
    """What a prompt says of a picture."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(r[c], F.lit(""))) for k, c in (("Filename", "filename"), ("Caption", "caption"), ("OCR Text", "ocr_text"))]
    return F.concat_ws("\n", F.format_string("--- Retrieved Image Asset #%d (Relevance: %.3f) ---", rank, score), *lines, F.lit("\n"))


def contexts(blocks: DataFrame, most: int = 12000) -> DataFrame:
    """query_id, number of blocks and their text by rank, within the budget. A query's blocks are its
    ranked results, a few; the budget bounds what is put together."""
    kept = budget(blocks, most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return kept.select("query_id", F.size("b").alias("n"), F.array_join(F.col("b.block"), "").alias("context"))


# What a prompt says besides the reports.
SYSTEM = (
    "You are a Senior Intelligence Analyst. You will be provided with several incident reports.\n"
    "Your task is to answer the user's analytical query based strictly on the provided incidents.\n"
    "Do not speculate beyond the provided context. If information is not present in the retrieved incidents, state that it is not available in the provided data.\n"
    "\n"
    "Requirements:\n"
    "- Answer ONLY the specific question asked. Do NOT generate additional questions or answers.\n"
    "- Use factual intelligence-report style.\n"
    "- No speculation, assumptions, or unsupported conclusions.\n"
    "- Use only retrieved context."
)
FORMATS = {
    "enumeration": (
        "\n\nFORMATTING INSTRUCTIONS:\n"
        "The user is asking for a list. Present each matching incident as a numbered item.\n"
        "For each incident include: Date, Location, Responsible Group, Attack Type, Killed, Injured.\n"
        "Use this exact format for each item:\n"
        "1. **[Date]** — [Location]\n"
        "   - Attack: [type] | Group: [group] | Killed: [N] | Injured: [N]\n"
        "   - [One-line summary]\n"
    ),
    "comparison": (
        "\n\nFORMATTING INSTRUCTIONS:\n"
        "The user is asking for a comparison. Present each incident side-by-side.\n"
        "For each incident, list: Date, Location, Attack Type, Responsible Group, Killed, Injured.\n"
        "Then provide a brief comparison of key differences and similarities.\n"
    ),
    "factual": (
        "\n\nFORMATTING INSTRUCTIONS:\n"
        "The user is asking a specific factual question. Answer directly in 1-3 sentences.\n"
        "State the fact first, then provide supporting detail if available.\n"
        "If the answer is not in the provided incidents, state that clearly.\n"
    ),
    "summary": (
        "\n\nFORMATTING INSTRUCTIONS:\n"
        "Provide a concise analytical summary (75-150 words).\n"
        "Include key facts: dates, locations, responsible groups, casualty figures.\n"
        "Use factual intelligence-report style.\n"
    ),
}
CLOSING = (
    "Please provide your answer based only on the incidents above.\n\n"
    "CRITICAL REMINDER: Provide the final answer directly. Do not output 'Question:' or 'Answer:' headers. Do not ask follow-up questions."
)


def system_prompt(question: Column) -> Column:
    kind = T.classify_query(question)
    return F.concat(F.lit(SYSTEM), F.coalesce(*[F.when(kind == k, v) for k, v in FORMATS.items()]))


def prompts(ranked: DataFrame, questions: DataFrame, most: int = 12000) -> DataFrame:
    """id, n, system_prompt, user_prompt of every question (id, question) with ranked results (id, rank, score
    and an incident's columns)."""
    fields = ("date", "city", "state", "country", "attack_types", "target_types", "weapon_types", "responsible_groups", "killed", "injured", "summary")
    block = incident_block({c: F.col(c) for c in fields}, F.col("rank"), F.col("score"))
    if "asset_id" in ranked.columns:
        picture = {c: F.col(c) for c in ("filename", "caption", "ocr_text")}
        block = F.when(F.col("asset_id").isNotNull(), image_block(picture, F.col("rank"), F.col("score"))).otherwise(block)
    blocks = ranked.select(F.col("id").alias("query_id"), "rank", block.alias("block"))
    told = contexts(blocks, most).withColumnRenamed("query_id", "id").join(questions.select("id", "question"), "id")
    user = F.concat(F.lit("ANALYTICAL QUERY: "), "question", F.lit("\n\nRELEVANT INCIDENTS ("), F.col("n").cast("string"), F.lit(" retrieved):\n"), "context", F.lit("\n" + CLOSING))
    return told.select("id", "n", system_prompt(F.col("question")).alias("system_prompt"), user.alias("user_prompt"))
