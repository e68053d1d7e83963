"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct five-word shingles, as 64-bit hashes. Two documents
link when 100 * |A and B| >= 80 * |A or B|. Prefix filtering: order all shingles
alike everywhere, rare ones first; sets that link must share one of the first
``n - ceil(0.8 n) + 1`` shingles of the larger and of the first ``n - ceil(8 n / 9) + 1`` of the
smaller, at places that leave enough overlap. Documents with the same prefix and size are one
group: a group puts its prefix into the index once, whatever its number of documents, group
pairs are filtered, and only then expanded to their members and verified.

* The order is by a corpus-wide count (a count sketch over all shingles of all documents,
  then the hash), so very common passages come last. The sketch has a cell for about
  every kilobyte of text, from 2 ** 16 to 2 ** 22 of them (16 MB); it only decides the
  order, so more text than that makes more candidates, not other results.
* First every group is verified against one leader per shared shingle: a linear
  number of pairs. Only pairs whose documents are then still in different components
  are generated, filtered by size, place and a 512-bit parity signature of the sets,
  and verified. Links inside one component can't change it, so none that matters is
  lost, and a group of near copies never becomes all of its pairs.
* Every posting knows the ``BEFORE`` postings before it. A pair that shares one of them has met
  there, so two documents meet about once and not on each of the shingles they share.
* Long posting lists are dealt out as pairs of blocks.
* Verification is exact over whole sets, fetched again from the texts of candidates.

Defined results: null and empty texts have an empty set (n_shingles 0) and link with
nothing; with fewer than five words the whole word sequence is one shingle; rows that
repeat an id are one node, each row is returned; a null id links with nothing and has
a null component; ids may be of any ordered type; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from quillon.llm import shared
from quillon.llm.shared import Bloom, array_parts, block_pairs, buffers, emit, mixed, save, signed64, slices, tidy, word_hashes

BEFORE = 4
_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts with repeats, and where each text's begin."""
    h, at = word_hashes(*buffers(column))
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    begins = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - begins[:-1], count) + np.arange(begins[-1])  # a shingle's first word
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    s = padded[first]
    for k in range(1, width):
        s = s * _P + padded[first + k]
    for d in np.flatnonzero((n > 0) & (n < width)):  # the whole sequence; its length keeps it apart
        x = np.full(1, n[d], np.uint64)
        for k in range(at[d], at[d + 1]):
            x = x * _P + h[k : k + 1]
        s[begins[d]] = x[0]
    return mixed(s), begins


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    s, begins = shingles(column, width)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        x = np.sort(s[a:b])
        yield x[np.concatenate([[True], x[1:] != x[:-1]])] if b - a > 1 else x


def needed(n: int, percent: int) -> int:
    """The prefix length of a set of n."""
    return n - -(-percent * n // 100) + 1


def typed(kind: DataType, ids: tuple[str, ...], rest: str) -> StructType:
    """A schema of id columns of a table's own type, and others."""
    return StructType([*(StructField(i, kind) for i in ids), *StructType.fromDDL(rest).fields]) if rest else StructType([StructField(i, kind) for i in ids])


_SETS = [("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("gid", pa.int64()), ("prefix", pa.list_(pa.int64())), ("sig", pa.binary())]
_SETS_SQL = "n int, h1 long, h2 long, gid long, prefix array<long>, sig binary"


def count_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How often the shingles of each cell occur, over all documents; a cell for about each kilobyte."""
    kilobytes = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) >> 10
    size = 1 << min(22, max(16, int(kilobytes).bit_length()))

    @tidy
    def count(batches):
        acc = np.zeros(size, np.int32)
        for b in batches:
            for part in slices(b, 1024):
                cells = (shingles(part.column(0), width)[0] & np.uint64(size - 1)).astype(np.int32)
                at, n = np.unique(cells, return_counts=True)
                acc[at] += n.astype(np.int32)
        yield from array_parts(acc)

    found = shared.reduce_arrays(docs.select("text").mapInArrow(count, shared._PART_SQL), size, "int32", "add")
    return np.minimum(found, np.iinfo(np.int32).max).astype(np.int32)


def sets_of(spark: SparkSession, docs: DataFrame, width: int, percent: int) -> DataFrame:
    held = spark.sparkContext.broadcast(count_sketch(docs, width))  # at most 16 MB, whatever the corpus
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *_SETS])

    @tidy
    def make(batches):
        counts = held.value
        mask = np.uint64(len(counts) - 1)
        for b in (part for batch in batches for part in slices(batch)):
            cols: dict[str, list] = {k: [] for k in ("n", "h1", "h2", "gid", "prefix", "sig")}
            for s in shingle_sets(b.column(1), width):
                n = len(s)
                cols["n"].append(n)
                if not n:
                    for k, v in (("h1", 0), ("h2", 0), ("gid", 0), ("prefix", s.view(np.int64)), ("sig", bytes(64))):
                        cols[k].append(v)
                    continue
                c = counts[(s & mask).astype(np.int64)]
                prefix = s[np.lexsort((s, c))[: needed(n, percent)]].view(np.int64)
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                cols["h1"].append(signed64(whole >> 64))
                cols["h2"].append(signed64(whole & (1 << 64) - 1))
                cols["gid"].append(signed64(xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n)))
                cols["prefix"].append(prefix)
                cols["sig"].append(np.packbits(np.bincount((s >> np.uint64(20) & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1).tobytes())
            ends = np.cumsum([0] + [len(p) for p in cols["prefix"]]).astype(np.int32)
            cols["prefix"] = pa.ListArray.from_arrays(ends, np.concatenate(cols["prefix"] or [np.zeros(0, np.int64)]))
            yield emit(schema, {"doc_id": b.column(0)} | cols)

    return docs.select("doc_id", "text").mapInArrow(make, typed(kind, ("doc_id",), _SETS_SQL))


def verify(spark: SparkSession, docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets link. Sets are made again from the texts of
    the ids in the pairs only; a Bloom filter keeps the other texts out of the shuffle."""
    kind = docs.schema["doc_id"].dataType
    own = to_arrow_type(kind)
    full, edge = pa.schema([("id", own), ("s", pa.binary())]), pa.schema([("a", own), ("b", own)])
    bloom = Bloom(spark, pairs.select(F.xxhash64("a").alias("id")).union(pairs.select(F.xxhash64("b"))).distinct(), "id")
    bits, log = bloom.bits, bloom.log

    @tidy
    def fetch(batches):
        for b in (part for batch in batches for part in slices(batch, 1024)):
            hit = Bloom.test(bits.value, log, b.column(1).to_numpy(zero_copy_only=False)) & pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False)
            keep = b.filter(pa.array(hit))
            for part in slices(keep):
                yield emit(full, {"id": part.column(0), "s": [s.tobytes() for s in shingle_sets(part.column(2), width)]})

    @tidy
    def test(batches):
        for b in batches:
            (xs, x), (ys, y) = buffers(b.column(2)), buffers(b.column(3))
            good = []
            for i in range(b.num_rows):
                p, q = x[xs[i] : xs[i + 1]].view(np.uint64), y[ys[i] : ys[i + 1]].view(np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                if len(p) and len(p) * 100 >= percent * len(q):
                    at = np.searchsorted(q, p)
                    at[at == len(q)] = 0
                    both = int((q[at] == p).sum())
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        good.append(i)
            if good:
                keep = b.select([0, 1]).take(pa.array(good))
                yield emit(edge, {"a": keep.column(0), "b": keep.column(1)})

    sets = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("h"), "text").mapInArrow(fetch, typed(kind, ("id",), "s binary"))
    sets = save(spark, sets, "full")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    rows = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")
    edges = save(spark, rows.mapInArrow(test, typed(kind, ("a", "b"), "")).distinct(), "links")
    shared.drop(spark, sets)
    return edges


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    shared.bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    sets = save(spark, sets_of(spark, docs, width, percent), "sets")
    real = sets.where("n > 0 and doc_id is not null")
    key = ["gid", "n", "h1", "h2"]
    # copies of one set are one class; classes with the same prefix and size one group
    classes = save(spark, real.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    sketch = [f"s{k}" for k in range(8)]
    signed = classes.select(*key, "rep", *[F.conv(F.hex(F.substring("sig", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"s{k}") for k in range(8)])
    classes = classes.drop("sig")
    groups = classes.groupBy("gid").agg(F.min("rep").alias("lead"), F.count("*").alias("members"))

    def least(n: Column, m: Column) -> Column:
        """Common shingles that a link needs."""
        return F.ceil((n + m) * percent / (100 + percent))

    def fits(l: str, r: str) -> Column:
        """Whether sizes and signatures leave room for a link."""
        n, m = F.col(f"{l}.n"), F.col(f"{r}.n")
        differ = sum((F.bit_count(F.col(f"{l}.s{k}").bitwiseXOR(F.col(f"{r}.s{k}"))) for k in range(1, 8)), F.bit_count(F.col(f"{l}.s0").bitwiseXOR(F.col(f"{r}.s0"))))
        return (F.least(n, m) * 100 >= percent * F.greatest(n, m)) & (differ <= n + m - 2 * least(n, m))

    # a group's prefix goes into the index once
    grouped = real.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    postings = grouped.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    dealt = postings.withColumn("inner", F.col("pos") <= F.col("n") - least(F.col("n"), F.col("n"))).repartition("token")
    # it looks at all columns, so that both uses need the same exchange, which then runs once
    tokens = dealt.groupBy("token").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi"), F.max("n").alias("n"), F.max("pos").alias("p"), F.max("inner").alias("inner"))
    index = save(spark, dealt.join(tokens.where("lo <> hi and inner and n > 0 and p >= 0").select("token"), "token"), "index")
    slim = save(spark, sets.drop("prefix", "sig"), "rows")
    shared.drop(spark, sets)
    real = slim.where("n > 0 and doc_id is not null")

    sized = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    # one leader per token, and one per group
    leads = index.where("inner").groupBy("token").agg(F.min(F.struct("gid", "n")).alias("l")).select("token", F.col("l.gid").alias("lead_gid"), F.col("l.n").alias("m"))
    star = index.join(leads, "token").where("gid <> lead_gid").where(sized).select(F.least("gid", "lead_gid").alias("lead_gid"), F.greatest("gid", "lead_gid").alias("gid")).distinct()
    heads = groups.select("gid", F.col("lead").alias("rep")).join(signed, ["gid", "rep"]).withColumnRenamed("gid", "lead_gid").alias("l")
    met = star.join(heads, "lead_gid").join(signed.alias("r"), "gid").where(fits("l", "r"))
    first = met.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))
    several = groups.where("members > 1").select("gid", "lead")
    first = first.union(classes.join(several, "gid").select(F.col("lead").alias("a"), F.col("rep").alias("b")))
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = save(spark, ordered(first), "tried")
    # an id with several sets is one node, which ties the classes of them
    ids = real.select("doc_id", *key)
    repeated = ids.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).where("lo <> hi").select("doc_id")
    same = ids.join(repeated, "doc_id").join(classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    edges = save(spark, verify(spark, docs, tried, width, percent).union(same), "edges")
    comp = save(spark, shared.components(spark, edges), "comp")

    # what is still apart: members of a token's groups, or of one group, in several components
    walk = Window.partitionBy("gid").orderBy("pos")
    told = index.withColumn("before", F.array(*[F.coalesce(F.lag("token", k).over(walk), F.col("gid")) for k in range(1, BEFORE + 1)]))
    rows = told.join(classes.drop("n"), "gid").select(F.xxhash64("token", F.lit(0)).alias("key"), *key, "rep", "pos", "inner", "before")
    rows = rows.union(classes.join(several, "gid").select(F.xxhash64("gid", F.lit(1)), *key, "rep", F.lit(0), F.lit(True), F.array().cast("array<long>")))
    rows = rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    rows = save(spark, rows, "met")
    shared.drop(spark, index)
    keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    apart = save(spark, rows.join(keys, "key").join(signed.drop("rep"), key), "apart")
    shared.drop(spark, rows)
    left, right = block_pairs(apart, "key", "rep", block)
    l, r = left.alias("l"), right.where("inner").alias("r")
    room = F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos")) >= least(F.col("l.n"), F.col("r.n"))
    smaller = (F.col("r.n") < F.col("l.n")) | ((F.col("r.n") == F.col("l.n")) & (F.col("r.rep") < F.col("l.rep")))
    # members of one group meet under their group, others where they first share a token
    once = F.when(F.col("l.gid") == F.col("r.gid"), F.size("l.before") == 0).otherwise(~F.arrays_overlap("l.before", "r.before"))
    same_key = (F.col("l.key") == F.col("r.key")) & (F.col("l._x") == F.col("r._x")) & (F.col("l._y") == F.col("r._y"))
    met = l.join(r, same_key & (F.col("l.comp") != F.col("r.comp")) & smaller & room & fits("l", "r") & once)
    second = ordered(met.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))).join(tried, ["a", "b"], "left_anti")
    second = save(spark, second, "second")
    shared.drop(spark, apart)
    if not second.isEmpty():
        more = verify(spark, docs, second, width, percent)
        comp = save(spark, shared.components(spark, edges.union(more)), "comp")
    for table in (tried, second):
        shared.drop(spark, table)
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("comp", "rep").alias("comp"))
    out = slim.join(named, key, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the smallest id stays.
    Documents without words are no copies and stay; rows that repeat a kept id stay."""
    found = jaccard_components(spark, docs)
    (name,) = shared.fresh(docs, "_gone")
    gone = save(spark, found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


#: By way of all pairs that share a shingle: for small tables.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM d),
s AS MATERIALIZED (SELECT row, unnest(shingles) AS x FROM e),
p AS (SELECT a.row AS a, b.row AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.row < b.row GROUP BY ALL),
k AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN e x ON x.row = p.a JOIN e y ON y.row = p.b WHERE 100 * common >= 80 * (len(x.shingles) + len(y.shingles) - common) AND x.doc_id <> y.doc_id),
l AS MATERIALIZED (SELECT a, b FROM k UNION SELECT b, a FROM k),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS comp FROM r GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(comp, doc_id) AS component_id FROM e LEFT JOIN c ON c.a = e.doc_id
"""
