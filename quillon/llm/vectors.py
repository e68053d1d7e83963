"""Embedding near-dedup by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its
hash is the axis (of +-e_i) that it then lies nearest to. A table's bucket is the
hashes of ``width`` such turns; each vector also goes to the buckets where one of its hashes
is replaced by its next best axis (multiprobe). Vectors that meet in a bucket are
verified by cosine in double precision. The more vectors there are, the wider the buckets' names:
``plan`` takes the least width at which a vector meets few strangers, and as many tables as a pair at
the wanted cosine needs to share a bucket with probability ``recall``, by trial on random pairs of
the vectors' lengths.

Equal vectors of a label are one row with a multiplicity, so a very common vector
is one vector. Buckets with more than ``block`` rows are dealt out as pairs of blocks,
and tasks take buckets in parts of bounded size. A linked pair is counted in the
first table and bucket that its vectors share, so links are counted without a list of
pairs; a task returns sums and spanning edges only.

Defined results: rows with a null label or id, and vectors that are null, empty, zero or
hold null or non-finite components link with nothing; vectors of different lengths
never link; rows that repeat an id, label and vector are one vector, an id with several vectors
is one node, its links the sum over its vectors; every row is returned; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import shared
from quillon.llm.shared import emit, mixed, save, tidy

_BUCKETS = pa.schema([("rep", pa.int64()), ("key", pa.int64())])
_LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def signs(table: int, turn: int, size: int, seed: int) -> np.ndarray:
    """Three rows of random signs."""
    n = np.arange(3 * size, dtype=np.uint64) + np.uint64(((seed * 1009 + table) * 31 + turn) << 20)
    return np.where(mixed(n * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63), -1.0, 1.0).reshape(3, size)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # else squares overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def buckets(x: np.ndarray, tables: int, width: int, seed: int) -> np.ndarray:
    """For unit rows, an array (rows, tables, probes) of bucket numbers; probe 0 is the row's own."""
    size = 1 << max(0, int(x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    out = np.empty((len(x), tables, width + 1), np.int64)
    at = np.arange(len(x))
    for t in range(tables):
        best, second = [], []
        for turn in range(width):
            y = padded
            for s in signs(t, turn, size, seed):
                y = hadamard(y * s)
            strength = np.abs(y)
            first = strength.argmax(axis=1)
            strength[at, first] = -1
            then = strength.argmax(axis=1)
            best.append(first * 2 + (y[at, first] < 0))
            second.append(then * 2 + (y[at, then] < 0))
        for probe in range(width + 1):
            number = np.zeros(len(x), np.int64)
            for turn in range(width):
                number = number * (2 * size) + (second if probe == turn + 1 else best)[turn]
            out[:, t, probe] = number
    return out


def meeting(dim: int, cosine: float, width: int, seed: int, pairs: int = 400, tables: int = 6) -> float:
    """How likely a pair of random vectors at a cosine shares a bucket of one table, by trial."""
    r = np.random.default_rng(seed)
    x = unit(r.standard_normal((pairs, dim)))
    if dim < 2:
        return 1.0
    z = r.standard_normal((pairs, dim))
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    a, b = (buckets(v, tables, width, seed) for v in (x, cosine * x + np.sqrt(1 - cosine * cosine) * z))
    return float((a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean())


def plan(n: int, dims: list[int], cosine: float, seed: int, recall: float = 0.9995, strangers: float = 8.0) -> tuple[int, int]:
    """Width and tables for ``n`` vectors: random vectors share about n (width + 1)^2 / names buckets
    of a table with one of them; of the lengths the one that needs most decides."""
    size = min(1 << max(0, int(d - 1).bit_length()) for d in dims)
    width = 2
    while width < 8 and n * (width + 1) ** 2 / (2.0 * size) ** width > strangers and size > 1:
        width += 1
    met = min(meeting(d, cosine, width, seed) for d in dims)
    return width, 4 if met >= 1 else max(4, int(np.ceil(np.log(1 - recall) / np.log(1 - met))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(b: pa.RecordBatch, name: str):
    sizes = np.diff(b.column(name).offsets.to_numpy())
    for n in np.unique(sizes):
        yield b if len(sizes) and (sizes == n).all() else b.filter(pa.array(sizes == n))


def near_links(spark: SparkSession, reps: DataFrame, cosine: float, tables: int, width: int, seed: int, block: int, part: int) -> DataFrame:
    """(rep, links, root): partial sums of links, and edges that span what is linked."""

    @tidy
    def place(batches):
        for batch in batches:
            for b in _by_length(batch, "embedding"):
                if not b.num_rows:
                    continue
                x = unit(_matrix(b.column("embedding")))
                where = buckets(x, tables, width, seed)
                key = mixed(where.view(np.uint64) * np.uint64(tables) + np.arange(tables, dtype=np.uint64)[None, :, None])
                label = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                key = mixed(key + mixed(label * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1]))[:, None, None])
                each = key.reshape(len(x), -1)
                yield emit(_BUCKETS, {"rep": np.repeat(b.column("rep").to_numpy(), each.shape[1]), "key": each.reshape(-1).view(np.int64)})

    placed = reps.select("rep", "label", "embedding").mapInArrow(place, "rep long, key long").distinct().repartition("key")
    counts = placed.groupBy("key").agg(F.count("rep").alias("n")).where("n > 1")
    rows = placed.join(counts, "key").withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(13)), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = save(spark, rows.select("rep", "key", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")), "buckets")
    parts = max(1, -(-rows.count() // part))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "x", "y"), F.lit(parts)).cast("int"))
    full = rows.join(reps.select("rep", "label", "mult", "embedding"), "rep")

    def check(table: pa.Table) -> pa.Table:
        sums: dict[int, int] = {}
        parent: dict[int, int] = {}

        def root(i):
            while (up := parent.setdefault(i, i)) != i:
                parent[i] = i = parent[up]
            return i

        whole = table.combine_chunks().to_batches()
        for b in (g for batch in whole for g in _by_length(batch, "embedding")):
            ids, mult = b.column("rep").to_numpy(), b.column("mult").to_numpy()
            key, own, x, y = (b.column(c).to_numpy() for c in ("key", "own", "x", "y"))
            unique, first = np.unique(ids, return_index=True)
            place_of = np.searchsorted(unique, ids)
            vec = unit(_matrix(b.column("embedding").take(pa.array(first))))
            waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            label_at = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64)[first].view(np.uint64)

            def count():
                """Counts the waiting links that this bucket is the first to see; only vectors with links are hashed."""
                i, j, at_key = (np.concatenate(c) for c in zip(*waiting, strict=True))
                waiting.clear()
                nodes = np.unique(np.concatenate([i, j]))
                where = buckets(vec[nodes], tables, width, seed)
                x, y = where[np.searchsorted(nodes, i)], where[np.searchsorted(nodes, j)]
                # the first table, and in it the smallest bucket, that a pair shares
                common = (x[:, :, :, None] == y[:, :, None, :]).any(axis=3)
                t = common.any(axis=2).argmax(axis=1)
                at = np.arange(len(i))
                number = np.where(common[at, t], x[at, t], np.iinfo(np.int64).max).min(axis=1)
                mine = mixed(number.view(np.uint64) * np.uint64(tables) + t.astype(np.uint64))
                mine = mixed(mine + mixed(label_at[i] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(vec.shape[1])))
                keep = mine.view(np.int64) == at_key
                i, j = i[keep], j[keep]
                for a, c in ((i, j), (j, i)):
                    got = np.bincount(a, weights=mult[first[c]], minlength=len(unique))
                    for k in np.flatnonzero(got).tolist():
                        sums[int(unique[k])] = sums.get(int(unique[k]), 0) + int(got[k])
                for a, c in zip(unique[i].tolist(), unique[j].tolist(), strict=True):
                    ra, rc = root(a), root(c)
                    if ra != rc:
                        parent[max(ra, rc)] = min(ra, rc)

            order = np.lexsort((own, y, x, key))
            change = np.flatnonzero(np.diff(key[order]) | np.diff(x[order]) | np.diff(y[order])) + 1
            for rows_ in np.split(order, change):
                if x[rows_[0]] == y[rows_[0]]:
                    left = right = rows_
                else:
                    left, right = rows_[own[rows_] == x[rows_[0]]], rows_[own[rows_] == y[rows_[0]]]
                if not len(left) or not len(right):
                    continue
                p, q = place_of[left], place_of[right]
                i, j = np.nonzero(vec[p] @ vec[q].T >= cosine)
                keep = p[i] < p[j] if left is right else p[i] != q[j]
                i, j = p[i[keep]], q[j[keep]]
                if not len(i):
                    continue
                waiting.append((i, j, np.full(len(i), key[rows_[0]])))
                if sum(len(w[0]) for w in waiting[-64:]) > 100_000 or len(waiting) > 20_000:
                    count()
            if waiting:
                count()
        nodes = sorted(sums)
        return pa.table({"rep": nodes, "links": [sums[n] for n in nodes], "root": [root(n) for n in nodes]}, schema=_LINKS)

    return full.groupBy("part").applyInArrow(check, "rep long, links long, root long")


def embedding_components(
    spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, tables: int | None = None, width: int | None = None, seed: int = 6, block: int = 512, part: int = 16384
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    shared.bounded_batches(spark, 8192)
    rows = vectors.select("vec_id", F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label"), "embedding")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce((F.size("embedding") > 0) & ~bad & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    rows = save(spark, rows.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding", "label")), "vectors")
    good = rows.where("good")
    one = good.groupBy("h1", "h2", "vec_id").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    reps = save(spark, one.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("rep", F.monotonically_increasing_id()), "reps")
    if tables is None or width is None:
        told = reps.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        planned = plan(told.n, sorted({told.low or 1, told.high or 1}), cosine, seed)
        width, tables = width or planned[0], tables or planned[1]
    found = save(spark, near_links(spark, reps, cosine, tables, width, seed, block, part), "found")
    # nodes are ids from here on: an id with several vectors is one node
    ids = reps.select("rep", "id")
    pairs = found.join(ids, "rep").select("root", F.col("id").alias("a")).join(ids.withColumnRenamed("rep", "root"), "root").select("a", F.col("id").alias("b"))
    members = good.join(reps.select("h1", "h2", "rep", "id", "mult"), ["h1", "h2"]).select("vec_id", "rep", "id", "mult").distinct()
    several = members.join(members.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1"), "vec_id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    comp = shared.components(spark, pairs.union(several))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = members.join(sums, "rep", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    linked = linked.groupBy("vec_id").agg((F.sum(F.coalesce("links", F.lit(0))) + F.sum(F.col("mult") - 1)).alias("n_links"), F.min(F.least(F.coalesce("comp", "id"), "id")).alias("component_id"))
    every = rows.select("vec_id").join(save(spark, linked, "linked"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_links, component_id and kept for every embedding, within labels."""
    return embedding_components(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS comp FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.comp, v.vec_id) AS component_id, coalesce(c.comp, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
