"""What several training-data operators share: scratch tables in the folder all
executors see, ASCII word splitting, array-valued statistics and Bloom filters
summed over tasks, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

CHUNK = 1 << 16
AT_ONCE = 4 << 20  # bytes of a summed array that one task holds and the driver gets at once


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's
    checkpoint folder. Where neither is set, a temporary one, on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            made = tempfile.mkdtemp(prefix="quillon-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            base = f"file://{made}"
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 2048) -> None:
    """At most ``rows`` rows in an Arrow batch: bounds what a Python worker holds of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Gives freed memory back to the system: workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches that leaves no freed memory behind when the task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names of new columns, none of which ``df`` has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def save(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns a scan of it: cuts
    the lineage, and a lost executor costs no recomputation."""
    path = f"{shared_folder(spark)}/quillon/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the table that ``save`` made, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quillon/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def signed64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text or binary column, without a Python object per row; null
    counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WINDOW = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LETTER[65:91] = _LETTER[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) >= n:
        return _POWERS["up"], _POWERS["down"]
    made = {}
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        made[name] = out
    if n <= 2 * _WINDOW:  # what a longer word needs isn't kept: at most 2 MB stay
        _POWERS.update(made)
    return made["up"], made["down"]


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\x20\x09-\x0D]+`` of all texts, A-Z counted as a-z,
    and where each text's words begin (one more entry than texts).

    The hash of a word is a polynomial in random numbers for its bytes, read off running
    sums; windows that fit the processor's cache, cut at white space, bound the memory."""
    found, starts_at, low, high = [], [], int(offsets[0]), int(offsets[-1])
    edge = np.zeros(high - low + 1, bool)
    edge[offsets - low] = True  # a text's end parts words as white space does
    at = low
    while at < high:
        end, step = min(high, at + _WINDOW), _WINDOW
        while end < high:  # back to the last border near the end, or on to the next one
            back = max(at + 1, end - 256) if step == _WINDOW else at + 1
            gaps = np.flatnonzero(_SPACE[data[back:end]] | edge[back - low : end - low])
            if len(gaps):
                end = back + int(gaps[-1])
                break
            step *= 2
            end = min(high, at + step)
        part = data[at:end]
        ink = ~_SPACE[part]
        before = np.empty_like(ink)
        before[0], before[1:] = False, ink[:-1]
        before &= ~edge[at - low : end - low]
        after = np.empty_like(ink)
        after[-1], after[:-1] = False, ink[1:]
        after &= ~edge[at - low + 1 : end - low + 1]
        first, last = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
        up, down = _powers(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LETTER[part] * up[: len(part)], out=sums[1:])
        found.append(mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        starts_at.append(first + at)
        at = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    begins = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    return hashes, np.searchsorted(begins, offsets, "left")


def slices(batch: pa.RecordBatch, rows: int = 256):
    """A batch by a few hundred rows at a time: keeps what numpy makes of texts small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def emit(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema
    )


# --- arrays summed (or united) over tasks -----------------------------------------

_PART = pa.schema([("chunk", pa.int32()), ("idx", pa.binary()), ("val", pa.binary())])
_PART_SQL = "chunk int, idx binary, val binary"


def array_parts(array: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's array as chunks; a chunk with few non-zero entries goes as pairs."""
    for k in range(0, len(array), CHUNK):
        part = array[k : k + CHUNK]
        at = np.flatnonzero(part).astype(np.int32)
        if not len(at):
            continue
        if len(at) * 3 < len(part):
            yield emit(_PART, {"chunk": [k // CHUNK], "idx": [at.tobytes()], "val": [part[at].tobytes()]})
        else:
            yield emit(_PART, {"chunk": [k // CHUNK], "idx": [b""], "val": [part.tobytes()]})


def reduce_arrays(parts: DataFrame, length: int, dtype: str, how: str) -> np.ndarray:
    """Adds (``add``) or unites (``or``) the chunks of all tasks. ``length`` is fixed, so
    the driver gets that many entries however large the corpus is, ``AT_ONCE`` bytes in a job: their number
    follows from the length, not from how many partitions the chunks are dealt to."""
    chunks = -(-length // CHUNK)
    out_type = "int64" if how == "add" and np.dtype(dtype).kind == "i" else dtype

    def merge_sums(batches):
        return merge(batches, out_type)

    def merge(batches, dtype=dtype):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, idx, val in zip(*(c.to_pylist() for c in b.columns), strict=True):
                acc = held.setdefault(chunk, np.zeros(min(CHUNK, length - chunk * CHUNK), out_type))
                v = np.frombuffer(val, dtype)
                if idx:
                    at = np.frombuffer(idx, np.int32)
                    acc[at] = acc[at] + v if how == "add" else acc[at] | v
                elif how == "add":
                    acc += v
                else:
                    acc |= v
        for chunk, acc in held.items():
            yield emit(_PART, {"chunk": [chunk], "idx": [b""], "val": [acc.tobytes()]})

    out = np.zeros(length, out_type)
    # two rounds: tasks' chunks meet in salted partitions first
    salted = parts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(8)))
    first = salted.repartition(8 * chunks, "chunk", "salt").drop("salt").mapInArrow(merge, _PART_SQL)
    last = merge if out_type == dtype else merge_sums
    jobs = max(1, -(-length * out.itemsize // AT_ONCE))
    for row in first.repartition(chunks, "chunk").coalesce(jobs).mapInArrow(last, _PART_SQL).toLocalIterator():
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(row.val) // out.itemsize] = np.frombuffer(row.val, out_type)
    return out


class Bloom:
    """Bloom filter over 64-bit ids, at most ``2 ** 27`` bits (16 MB). Too many ids only
    let more rows through; the join behind it decides."""

    def __init__(self, spark: SparkSession, ids: DataFrame, column: str):
        n = ids.count()
        self.log = min(27, max(19, int(12 * max(n, 1)).bit_length()))
        log = self.log

        def fill(batches):
            bits = np.zeros(1 << (log - 3), np.uint8)
            for b in batches:
                for at in Bloom.places(b.column(0).to_numpy(zero_copy_only=False), log):
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield from array_parts(bits)

        parts = ids.select(F.col(column).cast("long").alias("id")).where("id is not null").mapInArrow(fill, _PART_SQL)
        self.bits = spark.sparkContext.broadcast(reduce_arrays(parts, 1 << (log - 3), "uint8", "or"))

    @staticmethod
    def places(ids: np.ndarray, log: int) -> list[np.ndarray]:
        x = ids.astype(np.int64).view(np.uint64)
        out = []
        for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93):
            y = (x ^ (x >> np.uint64(31))) * np.uint64(k)
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((y >> np.uint64(64 - log)).astype(np.int64))
        return out

    @staticmethod
    def test(bits: np.ndarray, log: int, ids: np.ndarray) -> np.ndarray:
        hit = np.ones(len(ids), bool)
        for at in Bloom.places(ids, log):
            hit &= (bits[at >> 3] >> (at & 7)) & 1 == 1
        return hit


# --- hot keys -----------------------------------------------------------------------


SALTS = 32


def block_pairs(rows: DataFrame, key: str, member: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Left and right sides of a self-join on ``key`` in which a key with more than ``block`` rows
    is dealt out as pairs of blocks, so no task meets more than ``block`` x ``block`` rows of a
    key. Every pair of rows meets exactly once, as (left, right). Rows learn of their key's blocks by
    a join in which a key has ``SALTS`` parts, and only keys over ``block`` take part."""
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    hot = hot.select(key, F.ceil(F.col("_n") / block).cast("int").alias("_nb"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(member, F.lit(29)), F.lit(SALTS)).cast("int"))
    with_n = salted.join(hot, [key, "_salt"], "left").withColumn("_nb", F.coalesce("_nb", F.lit(1))).drop("_salt")
    own = with_n.withColumn("_own", F.pmod(F.xxhash64(member, F.lit(71)), F.col("_nb")).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    left = other.withColumnRenamed("_own", "_x").withColumnRenamed("_other", "_y").drop("_nb")
    right = other.withColumnRenamed("_other", "_x").withColumnRenamed("_own", "_y").drop("_nb")
    return left, right


# --- connected components -----------------------------------------------------------


def _united(batches, schema: pa.Schema):
    """Union-find over the edges of one task; the smallest node stays the root."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for b in batches:
        for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield emit(schema, {"node": nodes, "comp": [root(x) for x in nodes]})


def components(spark: SparkSession, edges: DataFrame, most: int = 60, in_task: int = 300_000) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node reachable.

    Up to ``in_task`` edges (a few tens of MB) go to one executor task, which unites them
    in memory. More go through alternating large-star and small-star steps: each is a minimum per node (combined
    before the shuffle) joined back to the edges, and the number of rounds grows with the
    logarithm of the longest path. Each round's edges are a written table."""
    e = save(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if e.count() <= in_task:
        kind = e.schema["u"].dataType
        schema = pa.schema([("node", to_arrow_type(kind)), ("comp", to_arrow_type(kind))])
        return e.repartition(1).mapInArrow(lambda batches: _united(batches, schema), StructType([StructField("node", kind), StructField("comp", kind)]))
    before = None
    for _ in range(most):
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (mark.n, mark.s) == before or not mark.n:
            break
        before = (mark.n, mark.s)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(low2, large.u == low2.k)
        pairs = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        new = save(spark, pairs.select("p.u", "p.v").where("u <> v").distinct(), "edges")
        drop(spark, e)
        e = new
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
