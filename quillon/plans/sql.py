"""The extractors as functions of SQL.

``register`` gives a session extract_casualties, extract_organizations, embed_text, and the table function
incidents, which builds incidents of the rows of ``sentences``:

    SELECT * FROM incidents(TABLE(SELECT * FROM sentences) PARTITION BY doc_id ORDER BY seq)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions import embedding
from quillon.functions.casualties import casualties_of
from quillon.functions.organisations import organisations_of
from quillon.operators import incidents


def extract_casualties(texts: pa.Array) -> pa.Array:
    rows = [casualties_of(t or "") for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([min(r[i], 2**31 - 1) for r in rows], pa.int32()) for i in (0, 1)], ["killed", "injured"])


def extract_organizations(texts: pa.Array) -> pa.Array:
    found = [organisations_of(t or "") for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.list_(pa.string())) for i in (0, 1)], ["groups", "targets"])


def embed_text(texts: pa.Array) -> pa.Array:
    out = np.zeros((len(texts), embedding.DIM), np.float32)
    for row, t in zip(out, texts.to_pylist(), strict=True):
        for w in embedding._WORD.findall((t or "").lower()):
            at, sign = embedding.place(w)
            row[at] += sign
        norm = np.sqrt((row.astype(np.float64) ** 2).sum())
        if norm:
            row /= norm
    return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * embedding.DIM, out.reshape(-1))


class Incidents:
    """Incidents of the sentences of one document, in order: the builder of ``operators.incidents``."""

    def __init__(self):
        self.told: list[dict] = []

    def eval(self, row: Row) -> None:
        self.told.append(incidents.told_of(row.asDict(recursive=True)))

    def terminate(self) -> Iterator[tuple]:
        for found in incidents.of_sentences(self.told) if self.told else ():
            yield tuple(sorted(found[c]) if c in incidents.LISTS else found[c] for c in incidents.COLUMNS)


def sentences(docs: DataFrame) -> DataFrame:
    """Rows for the table function: the sentences of (doc_id, text), one document for each id."""
    return incidents.sentence_events(docs.withColumn("doc_id", docs["doc_id"].cast("string")))


def register(spark: SparkSession) -> None:
    for function, kind in ((extract_casualties, "killed int, injured int"), (extract_organizations, "groups array<string>, targets array<string>"), (embed_text, "array<float>")):
        spark.udf.register(function.__name__, F.arrow_udf(function, kind))
    spark.udtf.register("incidents", F.udtf(Incidents, returnType=incidents.schema(StringType())))
