"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Spans: each kind's pattern is matched leftmost and non-overlapping over whole texts,
and matches that are too short are dropped. Positions come from the pieces between
matches: a match begins where the pieces and matches before it end, which a running sum over the
matches of a document tells in time that grows with their number.

Ownership: the value of every candidate is hashed, and over the whole corpus each
hash gets its numbers of distinct repositories and owners. A value that several
owners have is a widely copied example; one that a single owner has is live-looking.
A value is first counted once for each repository, then summed, and the counts are a written
table, so that a value that stands everywhere is dealt out when documents look it up.

What the frequencies decide: every span comes with its value's owners and repositories, and runs of
mixed characters, which are mostly identifiers and examples that get copied, are spans (kind
``owned``) only if their value has one owner and no other span holds them.

Defined results: a null or empty text has no spans and the digest of the empty string;
null repositories and owners count as one of their own; rows that repeat an id are
scanned and returned each, and their values count once for a repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import save

# The kinds in order, their patterns, and the least length of what counts.
KINDS = ("assign", "access", "hex", "token", "owned")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: The method's own kinds: credentials that show by their form, and runs of letters and digits, of
#: which those with small letters, capitals and digits are candidates.
TOKEN = (
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
)
MIXED = r"[A-Za-z0-9_-]{20,}"
OWNED = KINDS.index("owned")
LEAST = {"assign": 12}


def matches(text: Column, kind: int, pattern: str, value: str | None = None) -> Column:
    """array<struct<k, gap, size, value>> of the matches of a pattern that can't match nothing: the
    characters before it since the last match, its length, and the secret that ``value`` extracts."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    secret = lambda x: x["hit"] if value is None else F.regexp_extract(x["hit"], value, 1)
    listed = F.transform(F.filter(both, lambda x: x["hit"].isNotNull()), lambda x: F.struct(F.lit(kind).alias("k"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), secret(x).alias("value")))
    # the pieces are only made for texts that match
    return F.when(F.regexp_like(text, F.lit(pattern)), listed).otherwise(F.array().cast("array<struct<k:int,gap:int,size:int,value:string>>"))


def candidates(rows: DataFrame) -> DataFrame:
    """row, repo, owner, k, start, end, value of every candidate of ``rows`` (row, repo, owner, found)."""
    each = rows.where(F.size("found") > 0).select("row", "repo", "owner", F.posexplode("found").alias("at", "x")).select("row", "repo", "owner", "at", "x.*")
    before = Window.partitionBy("row", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")
    spans = each.withColumn("start", start.cast("int")).withColumn("end", F.col("start") + F.col("size"))
    long = F.length("value") >= F.lit(0)
    for kind, least in LEAST.items():
        long = long & ((F.col("k") != KINDS.index(kind)) | (F.length("value") >= least))
    mixed = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]")
    return spans.where(long & ((F.col("k") != OWNED) | mixed)).drop("at", "gap", "size")


def scan(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None
) -> DataFrame:
    """doc_id, found (spans by start and kind, with the owners and repositories of their values, and
    the values' hashes), and n_live, n_shared: how many different values of the document one owner
    has, and how many several owners have; most_repos: the most repositories of any. ``owner``
    defaults to what stands before a slash in the column source, ``repo`` to source and, if there is
    such a column, lang."""
    if repo is None:
        repo = F.concat_ws("/", "source", "lang") if "lang" in docs.columns else F.col("source")
    owner = F.regexp_extract(F.col("source"), "^[^/]*", 0) if owner is None else owner
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(matches(text, 0, ASSIGN, ASSIGN), matches(text, 1, ACCESS), matches(text, 2, HEX), matches(text, 3, TOKEN), matches(text, OWNED, MIXED))
    rows = save(spark, docs.select(F.col(id_col).alias("doc_id"), repo.alias("repo"), owner.alias("owner"), found.alias("found")).withColumn("row", F.monotonically_increasing_id()), "secrets")
    spans = save(spark, candidates(rows).withColumn("hash", F.sha2(F.col("value").cast("binary"), 256)).drop("value"), "spans")
    places = spans.select("hash", "repo", "owner").distinct()
    owners = save(spark, places.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")), "owners")
    # how far the other spans reach that begin no later
    reach = F.max(F.when(F.col("k") != OWNED, F.col("end"))).over(Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    judged = spans.join(owners, "hash").withColumn("reach", F.coalesce(reach, F.lit(-1)))
    judged = judged.where((F.col("k") != OWNED) | ((F.col("owners") == 1) & (F.col("reach") < F.col("end"))))
    own = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end", "owners", "repos", "hash"))).alias("found"))
    out = rows.select("row", "doc_id").join(own, "row", "left")
    none = F.array().cast("array<struct<start:int,k:int,end:int,owners:bigint,repos:bigint,hash:string>>")
    values = lambda few: F.size(F.array_distinct(F.transform(F.filter("found", lambda x: (x["owners"] == 1) if few else (x["owners"] > 1)), lambda x: x["hash"]))).cast("long")
    most = F.coalesce(F.array_max(F.transform("found", lambda x: x["repos"])), F.lit(0).cast("long"))
    return out.select("doc_id", F.coalesce("found", none).alias("found")).select("doc_id", "found", values(True).alias("n_live"), values(False).alias("n_shared"), most.alias("most_repos"))


def listed(found: Column, more: tuple[str, ...] = ()) -> Column:
    """kind:start:end, and other fields, of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), *[x[f].cast("string") for f in ("start", "end", *more)])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, spans and ownership of the secrets of every document."""
    rows = scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("found", lambda x: x["k"] < 3)
    return rows.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), listed(F.col("found"), ("owners", "repos")).alias("ownership"), "n_live", "n_shared", "most_repos")


def _sql_spans(kind: int, pattern: str, group: bool = False, least: int = 0, more: str = "") -> str:
    quoted = pattern.replace("'", "''")
    value = f"regexp_extract(hits[i], '{quoted}', 1)" if group else "hits[i]"
    before = "list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda h: length(h))), 0)"
    return f"""SELECT row, {kind} AS k, CAST({before} AS BIGINT) AS s, CAST({before} + length(hits[i]) AS BIGINT) AS e, {value} AS value
  FROM (SELECT row, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT row, regexp_extract_all(text, '{quoted}') AS hits, string_split_regex(text, '{quoted}') AS gaps FROM d)
  WHERE len(hits) > 0) WHERE length({value}) >= {least}{more}"""


_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][k + 1]"
_EACH = [_sql_spans(0, ASSIGN, True, 12), _sql_spans(1, ACCESS), _sql_spans(2, HEX), _sql_spans(3, TOKEN), _sql_spans(OWNED, MIXED, more="".join(f" AND regexp_matches(hits[i], '{c}')" for c in ("[a-z]", "[A-Z]", "[0-9]")))]
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_EACH)}),
v AS (SELECT f.*, concat_ws('/', source, lang) AS repo, coalesce(regexp_extract(source, '^[^/]*'), chr(1)) AS owner, sha256(value) AS hash FROM f JOIN d USING (row)),
o AS (SELECT hash, count(DISTINCT owner) AS owners, count(DISTINCT concat(owner, chr(1), repo)) AS repos FROM v GROUP BY hash),
j AS (SELECT v.*, owners, repos, max(CASE WHEN k <> {OWNED} THEN e END) OVER (PARTITION BY row ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM v JOIN o USING (hash)),
g AS (SELECT * FROM j WHERE k <> {OWNED} OR (owners = 1 AND coalesce(reach, -1) < e)),
n AS (SELECT row, {", ".join(f"count(*) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(KINDS))}, count(DISTINCT hash) FILTER (owners = 1) AS n_live, count(DISTINCT hash) FILTER (owners > 1) AS n_shared, max(repos) AS most_repos,
  string_agg({_NAMES} || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg({_NAMES} || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
  string_agg({_NAMES} || ':' || s || ':' || e || ':' || owners || ':' || repos, ',' ORDER BY s, k) AS ownership FROM g GROUP BY row)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(ownership, '') AS ownership,
  coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN n USING (row)
"""
