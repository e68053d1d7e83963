"""The incident table, the collections that searches read, and the lookups on both.

Tables are folders of Parquet. A folder is replaced by writing beside it and renaming, so a reader
finds the old rows or the new ones; lists are arrays, and become joined texts only where asked for."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.entity import upsert
from quillon.sources import datasets

# Columns of the incident table and of a collection, in order.
TABLE = (
    "incident_id string, date string, country string, state string, city string, location_confidence double, attack_types array<string>, target_types array<string>, weapon_types array<string>, responsible_groups array<string>, "
    "target_organizations array<string>, killed int, injured int, summary string, source_document_id string"
)
COLLECTION = "collection string, modality string, id string, embedding array<float>, document string, embedding_type string, metadata map<string,string>"
LISTS = ["attack_types", "target_types", "weapon_types", "responsible_groups", "target_organizations"]
# What an incident's flat metadata holds, and what the explorer shows.
METADATA = ["incident_id", "date", "country", "state", "city", "attack_types", "target_types", "weapon_types", "responsible_groups", "killed", "injured", "has_summary", "source_document_id"]
EXPLORER = ["incident_id", "date", "country", "state", "city", "attack_types", "responsible_groups", "killed", "injured", "summary", "source_document_id"]


# --- tables ---


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, store = _path(spark, path)
    return store.exists(found)


def create(spark: SparkSession, path: str, ddl: str = TABLE) -> None:
    """An empty table, unless there is one."""
    if not exists(spark, path):
        spark.createDataFrame([], ddl).write.parquet(path)


def read(spark: SparkSession, path: str, ddl: str = TABLE) -> DataFrame:
    """All rows, with empty texts and lists and 0 for what is null."""
    return datasets.with_defaults(spark.read.schema(ddl).parquet(path))


def replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Writes ``rows`` beside the table and puts them in its place."""
    beside, old = f"{path}-{uuid.uuid4().hex}", f"{path}-{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    (new, store), (there, _), (gone, _) = _path(spark, beside), _path(spark, path), _path(spark, old)
    if store.exists(there):
        store.rename(there, gone)
    store.rename(new, there)
    store.delete(gone, True)


def fitted(rows: DataFrame, ddl: str = TABLE) -> DataFrame:
    """The columns of a table; those that ``rows`` lacks are null."""
    from pyspark.sql.types import StructType

    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl).fields])


def save(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Rows of ``new`` in place of those with their ids; the last of an id wins."""
    create(spark, path)
    replace(spark, upsert(spark.read.schema(TABLE).parquet(path), fitted(new), "incident_id"), path)


# --- lookups ---


def by_id(rows: DataFrame, incident_id: str) -> DataFrame:
    return rows.where(F.col("incident_id") == incident_id).limit(1)


def by_country(rows: DataFrame, country: str) -> DataFrame:
    return rows.where(F.col("country") == country)


def by_state(rows: DataFrame, state: str) -> DataFrame:
    return rows.where(F.col("state") == state)


def by_label(rows: DataFrame, column: str, label: str) -> DataFrame:
    """Rows whose joined list is like a label: in any case of letters, % and _ stand for anything."""
    return rows.where(F.array_join(column, ",").ilike(f"%{label}%"))


def by_attack(rows: DataFrame, label: str) -> DataFrame:
    return by_label(rows, "attack_types", label)


def by_group(rows: DataFrame, label: str) -> DataFrame:
    return by_label(rows, "responsible_groups", label)


def by_target_organization(rows: DataFrame, label: str) -> DataFrame:
    return by_label(rows, "target_organizations", label)


def by_date(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Both ends belong to it; a row without a date doesn't."""
    return rows.where(F.col("date").between(first, last))


def explorer(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns for display that there are."""
    return rows.select(*[c for c in (columns or EXPLORER) if c in rows.columns])


# --- collections ---


def metadata(rows: DataFrame) -> Column:
    """An incident's flat metadata: joined lists, and no nulls."""
    kinds = dict(rows.dtypes)
    flat = lambda c: F.array_join(c, ", ") if kinds[c].startswith("array") else F.col(c).cast("string")
    parts = [x for c in METADATA if c in kinds for x in (F.lit(c), F.coalesce(flat(c), F.lit("")))]
    return F.create_map(*parts, F.lit("asset_type"), F.lit("incident"))


def raw_metadata(values: dict[str, Column]) -> Column:
    """Metadata of any columns: what is no text, number or truth becomes its JSON."""
    parts = [x for k, c in values.items() for x in (F.lit(k), c)]
    return F.create_map(*parts)


def incident_of(meta: Column) -> dict[str, Column]:
    """An incident's columns of its flat metadata; what it lacks is empty."""
    text = {c: F.coalesce(meta[c], F.lit("")).alias(c) for c in ("incident_id", "date", "country", "state", "city", "source_document_id")}
    lists = {c: T.csv_decode(meta[c]).alias(c) for c in LISTS[:4]}
    numbers = {c: T.parse_int(meta[c]).alias(c) for c in ("killed", "injured")}
    return text | lists | numbers | {"has_summary": F.coalesce(meta["has_summary"].try_cast("boolean"), F.lit(False)).alias("has_summary")}


def is_picture(meta: Column) -> Column:
    return F.coalesce((meta["asset_type"] == "image") | (meta["modality"] == "image"), F.lit(False))


def incident_records(rows: DataFrame, collection: str = "incidents", embedding_type: str = "hashed-words") -> DataFrame:
    """Records of incidents that have an embedding."""
    more = F.create_map(F.lit("modality"), F.lit("text"), F.lit("embedding_type"), F.lit(embedding_type))
    return rows.where(F.size("embedding") > 0).select(
        F.lit(collection).alias("collection"), F.lit("text").alias("modality"), F.col("incident_id").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("retrieval_text").alias("document"),
        F.lit(embedding_type).alias("embedding_type"), F.map_concat(metadata(rows), more).alias("metadata"),
    )


def picture_records(assets: DataFrame, collection: str = "incidents", text_type: str = "hashed-words", image_type: str = "picture") -> DataFrame:
    """Records of pictures (asset_id, filename, ocr_text, caption, source_document_id, retrieval_text, text_embedding,
    image_embedding): one by their text and one by their looks, each only if that embedding isn't empty."""
    meta = F.create_map(*[x for c in ("asset_id", "filename", "ocr_text", "caption", "source_document_id") for x in (F.lit(c), F.coalesce(F.col(c), F.lit("")))], F.lit("asset_type"), F.lit("image"), F.lit("modality"), F.lit("image"))
    both = F.array(*[F.struct(F.lit(where).alias("collection"), F.lit(mode).alias("modality"), F.col(vector).cast("array<float>").alias("embedding"), F.lit(kind).alias("embedding_type")) for where, mode, vector, kind in ((collection, "text", "text_embedding", text_type), (f"{collection}_images", "image", "image_embedding", image_type))])
    each = assets.select("asset_id", "retrieval_text", meta.alias("metadata"), F.explode(F.filter(both, lambda r: F.coalesce(F.size(r["embedding"]), F.lit(0)) > 0)).alias("r"))
    told = F.map_concat("metadata", F.create_map(F.lit("embedding_type"), F.col("r.embedding_type")))
    return each.select("r.collection", "r.modality", F.col("asset_id").alias("id"), "r.embedding", F.col("retrieval_text").alias("document"), "r.embedding_type", told.alias("metadata"))


def add(spark: SparkSession, records: DataFrame, path: str) -> None:
    """Appends records whose collection, modality and id the table doesn't have; one of each."""
    create(spark, path, COLLECTION)
    key = ["collection", "modality", "id"]
    new = records.dropDuplicates(key).join(spark.read.schema(COLLECTION).parquet(path).select(*key), key, "left_anti")
    fitted(new, COLLECTION).write.mode("append").parquet(path)


def build_index(spark: SparkSession, incidents: DataFrame, path: str, embedder: Callable[[Column], Column], collection: str = "incidents") -> None:
    """Incidents with their embeddings into a collection. Arrow batches are the batches of the embedder."""
    add(spark, incident_records(incidents.withColumn("embedding", embedder(F.col("retrieval_text"))), collection), path)


def get(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    rows = spark.read.schema(COLLECTION).parquet(path)
    return rows if collection is None else rows.where(F.col("collection") == collection)


def counts(records: DataFrame) -> DataFrame:
    """collection, n of every collection, and of all (null)."""
    return records.rollup("collection").agg(F.count("*").alias("n"))


def set_union(items: Column | str) -> Column:
    """An aggregate: all different items of a group's lists, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(items))))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
