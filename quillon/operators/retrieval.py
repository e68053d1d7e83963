"""Retrieval: exact cosine search in blocks, ranking windows and prompt budgets.

Queries that fit one block go to the rows: each task reads its rows a batch at a time and keeps the best,
so no row is shuffled. More queries are dealt into blocks and rows into shards, and each task meets one
of each. Either way what a task holds is bounded, whatever the sizes of both tables, and a query's best
rows of all tasks are merged by rank. Only ids and vectors travel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

SHARD, BLOCK = 1 << 15, 1 << 10


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision; null and zero vectors as zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths, flat = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten()
    width = max(int(lengths.max(initial=0)), 1)
    good = lengths == width
    if flat.null_count:
        holes = np.bincount(np.repeat(np.arange(len(lengths)), lengths), flat.is_null().to_numpy(zero_copy_only=False), len(lengths))
        good &= holes == 0
    values = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)
    if good.all():
        out = values.reshape(-1, width)
    else:
        out = np.zeros((len(lengths), width))
        out[good] = values[np.repeat(good, lengths)].reshape(-1, width)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, then by place."""
    if k < len(scores):
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))][:k]


def gathered(queries: DataFrame, block: int = BLOCK) -> tuple[DataFrame, bool]:
    """The queries as a local table if they fit one block, and whether they do."""
    held = queries.limit(block + 1).toArrow()
    return (queries.sparkSession.createDataFrame(held, queries.schema), True) if held.num_rows <= block else (queries, False)


def few(found: DataFrame, fits: bool) -> DataFrame:
    """What is found for the queries of one block goes to the rows that it is joined with."""
    return F.broadcast(found) if fits else found


def in_blocks(
    rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, search: Callable[[pa.Table, pa.Table], dict], result: StructType, shard: int = SHARD, block: int = BLOCK, keep: Callable[[pa.Table], pa.Table] | None = None
) -> DataFrame:
    """``search`` of all ``rows`` with all ``queries``, a part of the rows and a block of queries at a time. It
    gets both as tables, rows in order of their ids, and returns columns of ``result``. The two have no column
    in common. ``keep`` leaves of what several parts found all that can matter."""
    schema = to_arrow_schema(result)
    own, other = rows.columns, queries.columns

    def meet(r: pa.Table, q: pa.Table) -> pa.Table:
        found = search(r.sort_by(row_id), q) if r.num_rows and q.num_rows else {c: [] for c in schema.names}
        return pa.table({c: pa.array(found[c], schema.field(c).type) for c in schema.names}, schema=schema)

    held = queries.limit(block + 1).toArrow()
    if held.num_rows <= block:
        asked = held.sort_by(query_id)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, limit = schema.empty_table(), 1 << 16
            for batch in batches:
                whole = pa.Table.from_batches([batch])
                for at in range(0, whole.num_rows, shard):
                    kept = pa.concat_tables([kept, meet(whole.slice(at, shard), asked)])
                if kept.num_rows > limit and keep is not None:
                    kept = keep(kept)
                    limit = max(1 << 16, 2 * kept.num_rows)
                elif kept.num_rows > limit:
                    yield from kept.combine_chunks().to_batches(10_000)
                    kept = schema.empty_table()
            yield from (keep(kept) if keep is not None else kept).combine_chunks().to_batches(10_000)

        return rows.mapInArrow(read, result)

    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, shard), (queries, block)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.withColumn("_shard", deal(row_id, shards)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_asks", F.lit(False))
    right = queries.withColumn("_block", deal(query_id, blocks)).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_asks", F.lit(True))

    def run(table: pa.Table) -> pa.Table:
        asks = table["_asks"]
        return meet(table.filter(pc.invert(asks)).select(own), table.filter(asks).select(other).sort_by(query_id))

    both = left.unionByName(right, allowMissingColumns=True).repartition(shards * blocks, "_shard", "_block")
    return both.groupBy("_shard", "_block").applyInArrow(run, result)


def best_of(k: int, *by: str) -> Callable[[pa.Table], pa.Table]:
    """The k best rows of each query (and of each ``by``) in a table of found ones, as ``top`` takes them."""

    def keep(found: pa.Table) -> pa.Table:
        if not found.num_rows:
            return found
        groups = ["query_id", *by]
        t = found.sort_by([*[(c, "ascending") for c in groups], ("score", "descending"), ("vec_id", "ascending")])
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in groups:
            codes = t[c].combine_chunks().dictionary_encode()
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        at = np.arange(t.num_rows)
        return t.filter(pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) < k))

    return keep


def top(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each query (and of each ``by``), with their rank; ties go to the smaller id."""
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK, apart: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest of ``rows`` (vec_id, embedding) to each of ``queries``
    (query_id, q) by cosine to six places. A row doesn't answer the query of its own id; null and zero
    vectors answer nothing; ids that repeat answer each. With ``apart`` the ids of the two tables have nothing to
    do with each other, and any row answers any query."""
    result = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("vec_id", rows.schema["vec_id"].dataType), *StructType.fromDDL("score double").fields])

    def search(r: pa.Table, q: pa.Table) -> dict:
        x, y = matrix(r["embedding"]), matrix(q["q"])
        ids, out = r["vec_id"].to_pylist(), {"query_id": [], "vec_id": [], "score": []}
        if x.shape[1] != y.shape[1]:
            return out
        alive = x.any(axis=1)
        names = np.array(ids, dtype=object)
        for at in range(0, len(y), 128):
            for i, scores in enumerate(np.round(y[at : at + 128] @ x.T, 6), at):
                asked = q["query_id"][i].as_py()
                if not y[i].any():
                    continue
                scores = np.where(alive if apart else alive & (names != asked), scores, -np.inf)
                for j in best(scores, k).tolist():
                    if scores[j] > -np.inf:
                        out["query_id"].append(asked)
                        out["vec_id"].append(ids[j])
                        out["score"].append(float(scores[j]) + 0.0)
        return out

    found = in_blocks(rows.select("vec_id", "embedding"), queries.select("query_id", "q"), "vec_id", "query_id", search, result, shard, block, best_of(k))
    return top(found, k)


def similarity_window(ranked: DataFrame, drop: float = 0.05) -> DataFrame:
    """Results within ``drop`` of their query's best."""
    return ranked.withColumn("_best", F.max("score").over(Window.partitionBy("query_id"))).where(F.col("score") >= F.col("_best") - drop).drop("_best")


def budget(blocks: DataFrame, most: int = 12000, least: int = 200) -> DataFrame:
    """Blocks by rank while they fit ``most`` characters; the first that doesn't is cut to
    what is left if that is more than ``least``, and nothing follows it."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("_sum", F.sum(F.length("block")).over(upto)).withColumn("_over", F.sum((F.col("_sum") > most).cast("int")).over(upto))
    room = F.lit(most) - (F.col("_sum") - F.length("block"))
    cut = F.concat(F.expr(f"substring(block, 1, cast({most} - (_sum - length(block)) as int))"), F.lit("... [TRUNCATED]\n\n"))
    return b.withColumn("_room", room).where((F.col("_over") == 0) | ((F.col("_over") == 1) & (F.col("_room") > least))).withColumn("block", F.when(F.col("_over") == 0, F.col("block")).otherwise(cut)).drop("_sum", "_over", "_room")
