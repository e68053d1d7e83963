"""Line dedup by a segment-partition edit join.

Two lines link when one becomes the other by at most k edits, where k is a tenth of the longer
one's characters, at most ``distance`` (2): lines below 10 characters link with their copies
only, those below 20 by one edit, so that linked lines always agree in nine tenths. A line of
length l is cut into k + 1 even segments; at least one of them stays whole in any line within
distance k, so segments are indexed under (l, k, number, text) and a line of length L probes the
indexes of lengths L - k .. L with only those substrings whose place allows k edits in all
(multi-match-aware windows). Candidates are verified over whole lines by banded bit-parallel edit
distance after common ends are cut off. All lines of a key meet; 64 parities of a line's
neighbouring characters, which two edits can't change much, keep most pairs from verification.

Equal lines are one node, by their 128-bit MD5 digest. Index keys that many lines
share are dealt out as pairs of blocks. Candidates carry 64 bits of the digest; the
lines themselves are read again for candidates only.

Which lines stay: a line goes only if it links with a line that stays, and no two that stay link.
Lines are taken in the order of their digests, which is as good as random, so all lines whose
earlier neighbours have gone can be decided at once, and the rounds grow with the logarithm of
the number of lines even along a chain of lines that each resemble the next.

Defined results: null and empty texts and lines without a word have no class and are never
removed; of equal lines the first occurrence (smallest document id, then line number, null ids
first) stands for all; rows that repeat an id with another text are documents of their own, and
rows equal in id and text are one document, whose rows stay or lose lines alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.llm import shared
from quillon.llm.shared import Bloom, block_pairs, emit, save, slices, tidy

DISTANCE, SHARE = 2, 10
BLANK = " \t\n\x0b\x0c\r"
_KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("role", pa.int8()), ("bag", pa.int64())])
_LINES = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("line", pa.string())])
_FOUND = pa.schema([("a", pa.binary()), ("b", pa.binary())])
INDEXED, PROBED = 1, 2


def segments(length: int, count: int) -> list[tuple[int, int]]:
    """(start, length) of even segments, the longer ones last."""
    short, longer = divmod(length, count)
    out, at = [], 0
    for i in range(count):
        n = short + (i >= count - longer)
        out.append((at, n))
        at += n
    return out


def allowed(length: int, k: int = DISTANCE) -> int:
    """The edits that link a line of this length with one that is no longer."""
    return min(k, length // SHARE)


def layout(length: int, k: int = DISTANCE) -> list[tuple[int, int, int, int]]:
    """(seed, start, end, role) of every key of a line of this length."""
    out: dict[tuple[int, int, int], int] = {}
    own = allowed(length, k)
    for less in range(own + 1 if own else 0):  # as the longer of two
        other = length - less
        for i, (p, n) in enumerate(segments(other, own + 1)):
            low, high = max(0, p - i, p + less - (own - i)), min(length - n, p + i, p + less + (own - i))
            for at in range(low, high + 1):
                out[(other * 8 + own) * 8 + i, at, at + n] = PROBED
    for edits in {allowed(length + more, k) for more in range(k + 1) if 0 < allowed(length + more, k) >= more}:  # as the shorter
        for i, (p, n) in enumerate(segments(length, edits + 1)):
            where = ((length * 8 + edits) * 8 + i, p, p + n)
            out[where] = out.get(where, 0) | INDEXED
    return [(*where, role) for where, role in out.items()]


def digest64(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def common_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def edit_distance(a: str, b: str, k: int) -> int:
    """The edit distance of a and b, or k + 1 if it is more than k."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return k + 1
    cut = common_start(a, b)
    a, b = a[cut:], b[cut:]
    cut = common_start(a[::-1], b[::-1])
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    m, n = len(a), len(b)
    if not m:
        return min(n, k + 1)
    if m <= 2 * k:  # the band would be wider than the line
        row = list(range(m + 1))
        for j, c in enumerate(b, 1):
            diagonal, row[0] = row[0], j
            for i in range(1, m + 1):
                diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (a[i - 1] != c))
        return min(row[m], k + 1)
    # bit r of column j stands for row j - k + r of the matrix; VP and VN hold where the
    # value rises or falls by one from the row above, D0 where it equals its diagonal
    width = 2 * k + 1
    full, last = (1 << width) - 1, 1 << 2 * k
    vp, vn, score = full ^ ((1 << k) - 1), 0, k
    for j in range(1, n + 1):
        c, x, bit = b[j - 1], 0, 1
        for i in range(j - k - 1, j + k):
            if 0 <= i < m and a[i] == c:
                x |= bit
            bit <<= 1
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j <= m - k:  # down the band's lowest diagonal
            score += not d0 & last
        else:  # along the last row
            bit = 1 << (m - j + k)
            score += bool(hp & bit) - bool(hn & bit)
        if score > 2 * k + n - m + 1:
            return k + 1
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
    return min(score, k + 1)


def bags(lines: list[str]) -> np.ndarray:
    """For each line, 64 parities of hashed pairs of neighbouring characters. An edit makes and
    unmakes at most four pairs, so lines within distance k differ in at most 4 k bits."""
    n = np.array([len(x) for x in lines])
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    pair = ((chars[:-1] * np.uint32(0x9E3779B1) ^ chars[1:]) * np.uint32(0x85EBCA77)) >> np.uint32(26)
    of = np.repeat(np.arange(len(lines), dtype=np.int64) * 64, n)
    same = of[:-1] == of[1:]
    odd = np.bincount((of[:-1] + pair)[same], minlength=64 * len(lines)).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, 64), axis=1).view(np.int64).ravel()


def row_key(docs: DataFrame) -> Column:
    """What tells a row's lines from those of other rows: a digest of its id and text."""
    number = docs["doc_id"].cast("string")
    return F.unhex(F.md5(F.concat(F.when(number.isNull(), "n").otherwise(F.concat(F.lit("i"), number)), F.lit("\0"), F.coalesce(docs["text"], F.lit(""))).cast("binary")))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, at (the row's key), line_no, digest of every line that holds a word."""
    exploded = docs.select("doc_id", row_key(docs).alias("at"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"[^ \t-\r]"))
    return exploded.select("doc_id", "at", "line_no", F.unhex(F.md5(F.col("line").cast("binary"))).alias("digest"))


def _keys(docs: DataFrame, k: int) -> DataFrame:
    """Index and probe keys of every line, once for each task that meets it."""

    @tidy
    def make(batches):
        layouts: dict[int, list] = {}
        seen: set[int] = set()
        for part in (p for b in batches for p in slices(b)):
            keys, ids, roles, new, times = [], [], bytearray(), [], []
            for text in part.column(0).to_pylist():
                for line in text.split("\n") if text else ():
                    n = len(line)
                    where = layouts.get(n)
                    if where is None:
                        if len(layouts) > 5000:
                            layouts.clear()
                        where = layouts[n] = layout(n, k)
                    if not where or not line.strip(BLANK):
                        continue
                    raw = line.encode()
                    own = digest64(hashlib.md5(raw).digest())
                    if own in seen:
                        continue
                    if len(seen) > 100_000:  # about 8 MB
                        seen.clear()
                    seen.add(own)
                    if len(raw) == n:
                        keys += [xxhash.xxh64_intdigest(raw[a:e], seed) for seed, a, e, _ in where]
                    else:
                        keys += [xxhash.xxh64_intdigest(line[a:e].encode(), seed) for seed, a, e, _ in where]
                    ids += [own] * len(where)
                    new.append(line)
                    times.append(len(where))
                    roles += bytes(r for *_, r in where)
            if keys:
                yield emit(_KEYS, {"key": np.array(keys, np.uint64).view(np.int64), "id": np.array(ids, np.int64), "role": np.frombuffer(bytes(roles), np.int8), "bag": np.repeat(bags(new), times)})

    return docs.select("text").mapInArrow(make, "key long, id long, role byte, bag long")


def verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Of pairs (a, b) of 64-bit line ids, those that link, as digests. The lines are read
    again; a Bloom filter keeps the others out of the shuffle."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    bloom = Bloom(spark, wanted, "id")
    bits, log = bloom.bits, bloom.log

    @tidy
    def fetch(batches):
        seen: set[bytes] = set()
        for part in (p for b in batches for p in slices(b)):
            lines = [x for t in part.column(0).to_pylist() if t for x in t.split("\n") if len(x) >= SHARE - 1]
            if not lines:
                continue
            digests = [hashlib.md5(x.encode()).digest() for x in lines]
            ids = np.array([digest64(d) for d in digests], np.int64)
            out = []
            for i in np.flatnonzero(Bloom.test(bits.value, log, ids)).tolist():
                if digests[i] not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(digests[i])
                    out.append(i)
            if out:
                yield emit(_LINES, {"id": ids[out], "digest": [digests[i] for i in out], "line": [lines[i] for i in out]})

    @tidy
    def test(batches):
        for part in (p for b in batches for p in slices(b, 1024)):
            a, b, x, y = (c.to_pylist() for c in part.columns)
            most = [allowed(max(len(p), len(q)), k) for p, q in zip(x, y, strict=True)]
            good = [i for i in range(len(a)) if edit_distance(x[i], y[i], most[i]) <= most[i]]
            if good:
                yield emit(_FOUND, {"a": [min(a[i], b[i]) for i in good], "b": [max(a[i], b[i]) for i in good]})

    lines = docs.select("text").mapInArrow(fetch, "id long, digest binary, line string")
    lines = save(spark, lines.join(wanted, "id", "left_semi").dropDuplicates(["digest"]), "lines")
    left = pairs.join(lines.select(F.col("id").alias("a"), F.col("digest").alias("da"), F.col("line").alias("la")), "a")
    both = left.join(lines.select(F.col("id").alias("b"), F.col("digest").alias("db"), F.col("line").alias("lb")), "b")
    links = save(spark, both.select("da", "db", "la", "lb").mapInArrow(test, "a binary, b binary").distinct(), "links")
    shared.drop(spark, lines)
    return links


def edit_links(spark: SparkSession, docs: DataFrame, k: int = DISTANCE, block: int = 512) -> DataFrame:
    """Pairs (a < b) of digests of different lines that link, every one of them."""
    shared.bounded_batches(spark)
    dealt = _keys(docs, k).repartition("key")
    # it looks at all columns, so that both uses need the same exchange, which then runs once
    several = dealt.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_or("role").alias("r"), F.max("bag").alias("g")).where(f"lo <> hi and r = {INDEXED | PROBED} and g is not null").select("key")
    rows = save(spark, dealt.join(several, "key").distinct(), "segments")
    indexed, probed = F.col("role").bitwiseAND(INDEXED) > 0, F.col("role").bitwiseAND(PROBED) > 0
    left, right = block_pairs(rows, "key", "id", block)
    left, right = left.where(indexed).alias("l"), right.where(probed).alias("r")
    close = F.bit_count(F.col("l.bag").bitwiseXOR(F.col("r.bag"))) <= 4 * k
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l._x") == F.col("r._x")) & (F.col("l._y") == F.col("r._y")) & (F.col("l.id") != F.col("r.id")) & close)
    pairs = save(spark, met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct(), "pairs")
    shared.drop(spark, rows)
    links = verified(spark, docs, pairs, k)
    shared.drop(spark, pairs)
    return links


def stand_ins(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(digest, rep) of every line that goes, and a line that stays and links with it. ``links``
    has the smaller digest as ``a``."""
    left, out = links, []
    while not left.isEmpty():
        later = save(spark, left.select("b").distinct(), "later")
        # a line that comes after no undecided one stays, and what links with it goes
        ahead = left.join(later.select(F.col("b").alias("a")), "a", "left_anti")
        gone = save(spark, ahead.groupBy("b").agg(F.min("a").alias("rep")).select(F.col("b").alias("digest"), "rep"), "gone")
        rest = left.join(gone.select(F.col("digest").alias("b")), "b", "left_anti").join(gone.select(F.col("digest").alias("a")), "a", "left_anti")
        rest = save(spark, rest.select("a", "b"), "left")
        shared.drop(spark, later)
        if out:
            shared.drop(spark, left)
        out.append(gone)
        left = rest
    if not out:
        return links.select(F.col("a").alias("digest"), F.col("b").alias("rep"))
    found = out[0]
    for gone in out[1:]:
        found = found.union(gone)
    return found


def line_classes(spark: SparkSession, docs: DataFrame, k: int = DISTANCE) -> DataFrame:
    """doc_id, at, line_no, class_doc_id, class_line_no, n_links, n_link_rows, kept for every line of
    ``docs`` (doc_id, text) that holds a word. The class is the place of the line that stands for
    this one: an equal line or one that it links with. n_links counts the other different lines
    that it links with, n_link_rows the rows these stand in, so that copies weigh as often as they
    occur."""
    docs = docs.select("doc_id", "text")
    links = edit_links(spark, docs, k)
    lines = save(spark, line_rows(docs), "linerows")
    both = links.select(F.col("a").alias("digest"), F.col("b").alias("other")).union(links.select("b", "a"))
    linked = both.select("digest").distinct().withColumn("linked", F.lit(True))
    first = lines.groupBy("digest").agg(F.min(F.struct("doc_id", "line_no", "at")).alias("first"), F.count("*").alias("rows"))
    # all others stand for themselves and have no links
    told = save(spark, first.join(linked, "digest", "left").where("rows > 1 or linked"), "told")
    near = told.where("linked")
    degree = both.join(near.select(F.col("digest").alias("other"), "rows"), "other").groupBy("digest").agg(F.count("*").alias("n_links"), F.sum("rows").alias("n_link_rows"))
    reps = stand_ins(spark, links).join(near.select(F.col("digest").alias("rep"), F.col("first").alias("class")), "rep").select("digest", "class")
    classes = told.join(degree, "digest", "left").join(reps, "digest", "left").select("digest", F.coalesce("class", "first").alias("class"), "n_links", "n_link_rows")
    classes = save(spark, classes, "classes")
    out = lines.join(classes, "digest", "left")
    place = F.coalesce("class", F.struct("doc_id", "line_no", "at"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    kept = (F.col("at") == F.col("class.at")) & (F.col("line_no") == F.col("class.line_no"))
    return out.withColumn("class", place).select("doc_id", "at", "line_no", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"), count("n_links"), count("n_link_rows"), kept.alias("kept"))


@F.arrow_udf(StringType())
def without_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for text, drop in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        if text is not None and drop:
            bad = set(drop)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in bad)
        out.append(text)
    return pa.array(out, pa.string())


def remove_lines(spark: SparkSession, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` without the lines that are not kept; a text that loses all its words goes."""
    cols = docs.columns
    at, own, lost, new = shared.fresh(docs, "_at", "_own", "_gone", "_new")
    gone = save(spark, classes.where("not kept").groupBy(F.col("at").alias(at)).agg(F.collect_set("line_no").alias(lost)), "lost")
    joined = docs.withColumn(own, row_key(docs)).join(gone, F.col(own) == F.col(at), "left")
    joined = joined.withColumn(new, F.when(F.col(lost).isNull(), F.col("text")).otherwise(without_lines("text", lost)))
    full = joined.where(F.col(lost).isNull() | F.col(new).rlike(r"[^ \t-\r]"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col(new).alias(c)
        if c == "n_chars":  # follows the text where it has changed
            return F.when(F.col(lost).isNull(), F.col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c)
        return F.col(f"`{c}`")

    return full.select(*[column(c) for c in cols])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its class, links and whether it is kept."""
    return line_classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("at")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines that repeat or nearly repeat a line that stays go. A document of
    which nothing is left goes too: all of it stands in other documents."""
    return remove_lines(spark, docs, line_classes(spark, docs))
