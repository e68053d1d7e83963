"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its components. Codes are cut into segments; a shard
of codes keeps a bucket table for each. A query looks up the buckets at segment distance 0
in one segment after the other, then at distance 1, and so on. After segment ``i`` (of
m, from 0) at distance s, every code within ``m * s + i`` is verified or was seen: if a code
differs from the query in at most that many bits, some segment searched this far has
it. A query stops as soon as its k-th best verified distance is covered, so answers
are exact, ties included.

Shards of at most ``shard_rows`` codes meet blocks of at most ``query_rows`` queries in
tasks of bounded size; the k best of each shard are merged per query. Only codes and
ids (16 bytes a row) travel, once for each block of queries; a table of few rows is dealt into more
blocks, so that all cores have work.

Defined results: ids are whole numbers; a vector that is null, empty, or holds null or non-finite components
has no code, and neither asks nor answers; codes meet codes of the same length only;
a zero component counts as positive; ties go to the smaller id; repeated rows answer
each; a query is a row like any other and finds itself; fewer than k rows give fewer
answers.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import bounded_batches, emit, save, tidy

_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
_CODES = pa.schema([("vec_id", pa.int64()), ("bits", pa.int32()), ("code", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("qrow", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.int32())])


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, bits, code (packed signs, padded with zero bits to 8 bytes)."""

    @tidy
    def make(batches):
        for b in batches:
            ids, bits, out = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all():
                    packed = np.packbits(x >= 0).tobytes()
                    ids.append(i)
                    bits.append(len(x))
                    out.append(packed + bytes(-len(packed) % 8))
            if ids:
                yield emit(_CODES, {"vec_id": ids, "bits": bits, "code": out})

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(make, "vec_id long, bits int, code binary")


@lru_cache(maxsize=128)
def near(width: int, s: int) -> np.ndarray:
    """All masks of ``width`` bits with s bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), s)], np.int64)


class Shard:
    """Bucket tables of a shard's codes: one of each segment."""

    def __init__(self, ids: np.ndarray, packed: np.ndarray, bits: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.packed = ids[order], packed[order]
        self.words = self.packed.view(np.uint16).reshape(len(ids), -1)
        width = max(4, min(16, int(np.log2(max(2, len(ids))) + 0.5)))
        self.edges = [(a, min(bits, a + width)) for a in range(0, bits, width)]
        spread = np.unpackbits(self.packed, axis=1)[:, :bits]
        self.tables = []
        for a, e in self.edges:
            key = self.keys(spread, a, e)
            by = np.argsort(key, kind="stable")
            self.tables.append((by, np.searchsorted(key[by], np.arange((1 << (e - a)) + 1))))

    @staticmethod
    def keys(spread: np.ndarray, a: int, e: int) -> np.ndarray:
        return spread[:, a:e].astype(np.int64) @ (1 << np.arange(e - a, dtype=np.int64))

    def search(self, code: np.ndarray, keys: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest, nearest first, then by id."""
        seen = np.zeros(len(self.ids), bool)
        at, dist, m = np.zeros(0, np.int64), np.zeros(0, np.int64), len(self.edges)
        word = code.view(np.uint16)
        for s in range(17):
            for i, ((a, e), (by, starts)) in enumerate(zip(self.edges, self.tables, strict=True)):
                if s <= e - a:
                    buckets = near(e - a, s) ^ keys[i]
                    low, n = starts[buckets], starts[buckets + 1] - starts[buckets]
                    low, n = low[n > 0], n[n > 0]
                    if len(n):
                        ends = np.cumsum(n)
                        new = by[np.repeat(low - (ends - n), n) + np.arange(ends[-1])]
                        new = new[~seen[new]]
                        if len(new):
                            seen[new] = True
                            d = _BITS[self.words[new] ^ word].sum(axis=1, dtype=np.int64)
                            at, dist = np.concatenate([at, new]), np.concatenate([dist, d])
                            if len(at) > k:
                                best = np.lexsort((at, dist))[:k]  # places follow ids
                                at, dist = at[best], dist[best]
                if len(at) >= k and dist.max() <= m * s + i:
                    break
            else:
                continue
            break
        best = np.lexsort((at, dist))[:k]
        return at[best], dist[best]


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 1 << 18, query_rows: int = 1 << 14) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest of ``vectors`` for every row of
    ``queries`` (both vec_id, embedding)."""
    bounded_batches(spark, 8192)
    data = save(spark, codes(vectors).withColumn("row", F.monotonically_increasing_id()), "codes")
    asked = save(spark, codes(queries).withColumn("row", F.monotonically_increasing_id()), "asked")
    shards, n = max(1, -(-data.count() // shard_rows)), asked.count()
    blocks = max(1, -(-n // query_rows), min(-(-2 * spark.sparkContext.defaultParallelism // shards), -(-n // 64)))
    deal = lambda df, n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = data.withColumn("shard", deal(data, shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(False))
    right = asked.withColumn("block", deal(asked, blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids, rows = table["vec_id"].to_numpy(), table["row"].to_numpy()
        bits = table["bits"][0].as_py()
        packed = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        out = {"query_id": [], "qrow": [], "vec_id": [], "distance": []}
        if asks.any() and not asks.all():
            shard = Shard(ids[~asks], packed[~asks], bits)
            spread = np.unpackbits(packed[asks], axis=1)[:, :bits]
            keys = np.stack([Shard.keys(spread, a, e) for a, e in shard.edges], axis=1).tolist()
            for q, row, code, key in zip(ids[asks].tolist(), rows[asks].tolist(), packed[asks], keys, strict=True):
                at, dist = shard.search(code, key, k)
                out["query_id"] += [q] * len(at)
                out["qrow"] += [row] * len(at)
                out["vec_id"] += shard.ids[at].tolist()
                out["distance"] += dist.tolist()
        return pa.table({n: pa.array(v, _FOUND.field(n).type) for n, v in out.items()}, schema=_FOUND)

    cols = ["shard", "block", "bits", "asks", "vec_id", "row", "code"]
    key = ["shard", "block", "bits"]
    found = left.select(*cols).union(right.select(*cols)).repartition(shards * blocks, *key).groupBy(*key).applyInArrow(search, "query_id long, qrow long, vec_id long, distance int")
    order = Window.partitionBy("query_id", "qrow").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op5_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every row whose id is divisible by 20, against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(spark, rows, rows.where("vec_id % 20 = 0"))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x >= 0) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(v.c) + 1), lambda i: CASE WHEN v.c[i] <> q.c[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM v JOIN v q ON q.vec_id % 20 = 0 AND len(q.c) = len(v.c)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM d)
SELECT * FROM r WHERE rank <= 10
"""
