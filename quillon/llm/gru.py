"""Language-model scoring by a gated recurrent network.

Words are counted over all training documents. The words that occur at least a tenth of
the root of the number of tokens times (the end of a text among them), 254 at least, and one
symbol for all others make the network's vocabulary: it grows about as that root does. Its
output softmax is factored into classes of words by frequency: the i-th has the 2 i + 1 words after the
i * i most frequent ones, so frequent words, which most tokens are, have small classes.
A word outside has the symbol's probability times its smoothed share of
the corpus counts of such words, so the model draws on every word of the corpus.

Training is truncated backpropagation in numpy. Training documents are dealt by a hash of id and
text into shards, whose number follows from the corpus's tokens alone; a shard is trained in the
order of the hashes, from common weights, in windows that carry the state on, and the weights
of all shards are averaged by tokens, once for each round (a round is a half of the shards). So
neither partitions nor their order change the model. Only sums of fixed size reach the driver.
Scoring carries the state through each whole text.

Frequent words' counts are a broadcast of at most ``common`` entries; all other words of a
text are looked up by a join on the full count table.

Defined results: a null or empty text is the end alone; a null id trains; ids may be of any type;
repeated rows train and are scored each; without training texts every count is 0 and the model is its
initial weights; words are told apart by 64-bit hashes, the end is none of them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from quillon.llm import shared
from quillon.llm.shared import array_parts, buffers, emit, reduce_arrays, save, slices, tidy, word_hashes

END = np.int64(0)  # words are moved off this hash
SIGN = np.uint64(1 << 63)  # turns the order of signed numbers into that of unsigned ones
LEAST_SIDE = 16
SHARD_TOKENS = 1 << 21
CACHED = 1 << 10
TOGETHER = 16 << 20  # bytes of texts that are scored together
_COUNTS = pa.schema([("h", pa.int64()), ("c", pa.int64())])
_SCORES = (
    [("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("outside", pa.int64()), ("gru", pa.float64()), ("rare", pa.list_(pa.int64()))]
)
_SCORES_SQL = "held_out boolean, n_tokens long, known long, logs double, outside long, gru double, rare array<long>"


def normal(a: np.ndarray, rows: np.ndarray, at: np.ndarray, ones: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of logits, which are overwritten: log-probabilities of the entries ``at``, exponentials, and their
    sums. ``small``: none is beyond 80, so that they can be taken as they are."""
    picked = a[rows, at]
    if not small:
        most = a.max(1, keepdims=True)
        picked = picked - most[:, 0]
        a -= most
    np.exp(a, out=a)
    sums = a @ ones[: a.shape[1]]  # a product adds up short rows faster than a sum does
    return picked - np.log(sums), a, sums[:, None]


class Gru:
    """Weights and the passes through them. Input weights are a table by word: they stand
    for embedding and input matrix at once."""

    def __init__(self, size: int = 256, hidden: int = 16, seed: int = 4):
        r = np.random.default_rng(seed)
        self.size, self.hidden, self.classes = size, hidden, math.ceil(math.sqrt(size))
        self.starts = np.minimum(np.arange(self.classes + 1) ** 2, size)
        self.kind = np.repeat(np.arange(self.classes, dtype=np.uint16), np.diff(self.starts))  # the class of a word; short numbers sort faster
        self.shapes = {"x": (size, 3 * hidden), "u": (hidden, 3 * hidden), "c": (hidden, self.classes), "cb": (self.classes,), "w": (size, hidden), "wb": (size,)}
        self.p = {k: (r.standard_normal(s) * (0.0 if k in ("cb", "wb") else 0.15)).astype(np.float32) for k, s in self.shapes.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            self.p[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return self

    def start_from(self, counts: np.ndarray) -> Gru:
        """Biases that give the words their shares in ``counts`` before any training."""
        share = np.pad(counts, (0, self.size - len(counts))) + 1.0
        mass = np.bincount(self.kind, weights=share)
        self.p["cb"] = np.log(mass / mass.sum()).astype(np.float32)
        self.p["wb"] = np.log(share / mass[self.kind]).astype(np.float32)
        return self

    def laid(self) -> tuple:
        """The weights as the passes use them: transposed ones of the gates, output weights with the biases
        in one piece (for a one after each state), and how far logits can be for states up to 1 and without any."""
        p = self.p
        reach = [(float(np.abs(p[a]).sum(axis).max(initial=0)), float(np.abs(p[b]).max(initial=0))) for a, b, axis in (("c", "cb", 0), ("w", "wb", 1))]
        return np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["x"].T), np.vstack([p["c"], p["cb"]]), np.column_stack([p["w"], p["wb"]]), reach

    def forward(self, inputs: np.ndarray, resets: np.ndarray, h: np.ndarray, keep: bool = False, laid: tuple | None = None):
        """States after each step of a window (steps, slots); a reset empties a slot's state
        before the step."""
        # a step's numbers lie by unit and then by slot, so that each gate is one piece of memory
        n, (u, x_of, *_) = self.hidden, laid or self.laid()
        states, kept, h = np.empty((*inputs.shape, n), np.float32), [], np.ascontiguousarray(h.T)
        for t in range(len(inputs)):
            if resets[t].any():
                h = np.where(resets[t], np.float32(0), h)
            hu, x = u @ h, x_of.take(inputs[t], axis=1)
            zr = x[: 2 * n]
            zr += hu[: 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:n], zr[n:]
            m = r * hu[2 * n :]
            m += x[2 * n :]
            np.tanh(m, out=m)
            if keep:
                kept.append((h, z, r, m, hu[2 * n :]))
            h = h - m
            h *= z
            h += m
            states[t] = h.T
        return states, h.T, kept

    def output(self, states: np.ndarray, targets: np.ndarray, learn: bool = False, laid: tuple | None = None):
        """Natural log-probabilities of the targets; if ``learn``, gradients of minus their sum as well
        (those of the words' weights for the classes at hand only, with these). Rows are put in order of
        their targets' classes once, so that every class has a slice of them."""
        k = self.kind[targets]
        order = np.argsort(k, kind="stable")
        n, k, (*_, cs, ws, reach) = self.hidden, k[order], laid or self.laid()
        s = np.ones((len(k), n + 1), np.float32)
        s[:, :n] = states[order]
        own, rows, k = targets[order] - self.starts[k], np.arange(len(k)), k.astype(np.int64)
        ends = np.searchsorted(k, np.arange(self.classes + 1))
        used = np.flatnonzero(np.diff(ends)).tolist()
        logs = np.empty(len(k), np.float32)
        ones = np.ones(max(self.classes, 2 * self.classes - 1), np.float32)
        far = float(np.abs(states).max(initial=0))
        small = all(far * most + alone < 80 for most, alone in reach)
        if learn:
            gc, gw, dh = np.zeros_like(cs), np.zeros_like(ws), np.empty((len(k), n), np.float32)
        # in blocks that the processor's cache holds
        for x in range(0, len(k), CACHED):
            y = min(len(k), x + CACHED)
            part, at = s[x:y], rows[: y - x]
            logs[x:y], e, sums = normal(part @ cs, at, k[x:y], ones, small)
            if learn:
                e *= 1 / sums
                e[at, k[x:y]] -= 1
                gc += part.T @ e
                np.matmul(e, self.p["c"].T, out=dh[x:y])
        for c, x, y in [(c, x, min(ends[c + 1], x + CACHED)) for c in used for x in range(ends[c], ends[c + 1], CACHED)]:
            words = slice(self.starts[c], self.starts[c + 1])
            if words.stop - words.start == 1:
                continue  # a class of one word is certain
            at, part = rows[: y - x], s[x:y]
            log, f, q = normal(part @ ws[words].T, at, own[x:y], ones, small)
            logs[x:y] += log
            if learn:
                f *= 1 / q
                f[at, own[x:y]] -= 1
                gw[words] += f.T @ part
                dh[x:y] += f @ self.p["w"][words]
        back = np.empty_like(logs)
        back[order] = logs
        if not learn:
            return back
        g = {"c": gc[:n].copy(), "cb": gc[n].copy(), "w": gw[:, :n].copy(), "wb": gw[:, n].copy()}
        if len(used) < self.classes:
            of_used = np.flatnonzero(np.isin(self.kind, used))
            g["w"], g["wb"] = (of_used, g["w"][of_used]), (of_used, g["wb"][of_used])
        out = np.empty_like(dh)
        out[order] = dh
        return back, g, out

    def learn(self, inputs: np.ndarray, targets: np.ndarray, resets: np.ndarray, h: np.ndarray, adam: dict, rate: float) -> np.ndarray:
        """One step on a window: the gradient goes back to its beginning only."""
        n, u = self.hidden, self.p["u"]
        laid = self.laid()
        states, last, kept = self.forward(inputs, resets, h, True, laid)
        _, g, dout = self.output(states.reshape(-1, n), targets.reshape(-1), True, laid)
        dout = dout.reshape(states.shape)
        dx = np.empty((*inputs.shape, 3 * n), np.float32)
        du, dh, d, dhu = np.zeros_like(u), np.zeros((n, len(h)), np.float32), np.empty((3 * n, len(h)), np.float32), np.empty((3 * n, len(h)), np.float32)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, m, hum = kept[t]
            dh += dout[t].T
            dm = d[2 * n :]
            np.subtract(1, z, out=dm)
            dm *= dh
            np.subtract(before, m, out=d[:n])
            d[:n] *= z
            d[:n] *= dm
            rest = m * m
            np.subtract(1, rest, out=rest)
            dm *= rest
            np.multiply(dm, r, out=dhu[2 * n :])
            np.subtract(1, r, out=rest)
            rest *= hum
            np.multiply(dhu[2 * n :], rest, out=d[n : 2 * n])
            dhu[: 2 * n] = d[: 2 * n]
            dx[t] = d.T
            du += before @ dhu.T
            dh *= z
            dh += u @ dhu
            if resets[t].any():
                dh[:, resets[t]] = 0
        ids, flat = inputs.reshape(-1), dx.reshape(-1, 3 * n)
        order = np.argsort(ids.astype(np.uint16) if self.size <= 1 << 16 else ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        g["x"] = ids[order][first], np.add.reduceat(flat[order], first, axis=0)
        g["u"] = du
        adam["t"] = adam.get("t", 0) + 1
        for k, v in g.items():
            at, v = v if isinstance(v, tuple) else (slice(None), v)  # words and classes that the window hasn't stay as they are
            if not isinstance(at, slice) and len(at) == len(self.p[k]):
                at = slice(None)
            v *= np.float32(1 / targets.size)
            np.clip(v, -0.05, 0.05, out=v)
            if (k, 1) not in adam:
                adam[k, 1], adam[k, 2] = np.zeros_like(self.p[k]), np.zeros_like(self.p[k])
            m1, m2 = adam[k, 1][at], adam[k, 2][at]
            m1 *= 0.9
            m1 += 0.1 * v
            m2 *= 0.99
            v *= v
            v *= 0.01
            m2 += v
            if not isinstance(at, slice):
                adam[k, 1][at], adam[k, 2][at] = m1, m2
            np.sqrt(m2 / (1 - 0.99 ** adam["t"]), out=v)
            v += 1e-6
            np.divide(m1, v, out=v)
            v *= rate / (1 - 0.9 ** adam["t"])
            self.p[k][at] -= v
        return last

    def score(self, texts: list[np.ndarray], slots: int = 512, window: int = 32) -> np.ndarray:
        """Natural log-probability of each whole text (word numbers, the end last). Texts are laid
        one after another into slots, longest first; the state is carried across windows, and a
        window's words are laid out only when it is reached, so a very long text costs its own length."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        slots = min(slots, len(texts))
        lanes: list[list[int]] = [[] for _ in range(slots)]
        heap = [(0, s) for s in range(slots)]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            n, s = heap[0]
            lanes[s].append(i)
            heapq.heapreplace(heap, (n + len(texts[i]), s))
        width = np.zeros(slots, np.int64)
        width[[s for _, s in heap]] = [n for n, _ in heap]
        by_load = np.argsort(-width, kind="stable")  # slots that end first are the last columns
        lanes, width = [lanes[s] for s in by_load], width[by_load]
        words = [np.concatenate([texts[i] for i in lane]) for lane in lanes]
        owners = [np.repeat(np.array(lane, np.int32), [len(texts[i]) for i in lane]) for lane in lanes]
        end, h, laid = np.int64(self.end), np.zeros((slots, self.hidden), np.float32), self.laid()
        before, previous = np.full(slots, end), np.full(slots, -1, np.int32)
        for a in range(0, int(width[0]), window):
            live = int((width > a).sum())
            b = min(int(width[0]), a + window)
            t, o = np.zeros((b - a, live), np.int64), np.full((b - a, live), -1, np.int32)
            for col in range(live):
                n = min(b, int(width[col])) - a
                t[:n, col], o[:n, col] = words[col][a : a + n], owners[col][a : a + n]
            resets = np.vstack([previous[None, :live], o[:-1]]) != o
            inputs = np.where(resets, end, np.vstack([before[None, :live], t[:-1]]))
            states, h, _ = self.forward(inputs, resets, h[:live], False, laid)
            mask = o.reshape(-1) >= 0
            logs = self.output(states.reshape(-1, self.hidden)[mask], t.reshape(-1)[mask], False, laid)
            out += np.bincount(o.reshape(-1)[mask], weights=logs, minlength=len(out))
            previous, before = o[-1], t[-1]
        return out

    end: int = 0


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def apart(h: np.ndarray) -> np.ndarray:
    """Hashes of words, none of which is the end's."""
    h[h.view(np.int64) == END] = 1
    return h


def count_words(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(h, c) over all words and ends of ``texts`` (text): counted in each task, then summed."""

    @tidy
    def count(batches):
        held, size, n = [], 0, 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return emit(_COUNTS, {"h": h.view(np.int64), "c": c.astype(np.int64)})

        for part in (p for b in batches for p in slices(b, 1024)):
            n += part.num_rows
            held.append(apart(word_hashes(*buffers(part.column(0)))[0]))
            size += len(held[-1])
            if size > 2_000_000:
                yield flush()
                size = 0
        if size:
            yield flush()
        if n:
            yield emit(_COUNTS, {"h": [int(END)], "c": [n]})

    return save(spark, texts.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words from some count on, as many as ``most`` allows, most frequent first."""
    level = F.floor(F.log2("c") * 32).cast("int")
    hist = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # at most 2048 rows
    low, total = 1 << 30, 0
    for row in hist:
        if total + row.n > most:
            break
        low, total = row.level, total + row.n
    rows = counts.where(level >= low).select("h", "c").toArrow()
    h, c = rows["h"].to_numpy(), rows["c"].to_numpy()
    order = np.lexsort((h, -c))
    return h[order], c[order]


class Lexicon:
    """Sorted hashes of the frequent words with their counts, and network numbers of the first ones."""

    def __init__(self, h: np.ndarray, c: np.ndarray, size: int, total: int):
        inside = h[: size - 1]
        if END not in inside:
            inside = np.concatenate([inside[: size - 2], [END]])
        counts = {int(a): int(b) for a, b in zip(h, c, strict=True)}
        named = sorted(((counts.get(int(x), 0), int(x)) for x in inside), key=lambda t: (-t[0], t[1]))
        rest = total - sum(n for n, _ in named)
        ranked = sorted([*named, (rest, None)], key=lambda t: (-t[0], t[1] is not None, t[1] or 0))
        self.inside_tokens, self.inside_words = total - rest, sum(n > 0 for n, _ in named)
        self.start = np.array([n for n, _ in ranked] + [0] * (size - len(ranked)), float)
        self.other = next(i for i, (_, x) in enumerate(ranked) if x is None)
        number = {x: i for i, (_, x) in enumerate(ranked)}
        self.end = number[int(END)]
        every = np.unique(np.concatenate([h, np.array([int(END)], np.int64)]))
        self.h = every
        self.c = np.array([counts.get(int(x), 0) for x in every], np.int64)
        # hashes are even, so a table of their first bits leads to the right place, or a few before it
        self.shift = np.uint64(64 - max(1, len(every).bit_length() + 1))
        self.key = np.append(every, np.iinfo(np.int64).max)  # the last one stops the search
        top = (every.view(np.uint64) ^ SIGN) >> self.shift
        self.lead = np.searchsorted(top, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.deep = int(np.diff(self.lead).max())
        self.number = np.array([number.get(int(x), self.other) for x in every], np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.lead[(h.view(np.uint64) ^ SIGN) >> self.shift]
        there = self.key[at] == h
        left = np.flatnonzero(~there)
        for _ in range(self.deep - 1):  # those that stand later among hashes with the same first bits
            left = left[self.key[at[left]] < h[left]]
            if not len(left):
                break
            at[left] += 1
            hit = self.key[at[left]] == h[left]
            there[left[hit]] = True
            left = left[~hit]
        there &= at < len(self.h)
        at[~there] = 0
        return at, there


def network_size(counts: np.ndarray, total: int) -> int:
    """Entries of the network for a corpus of ``total`` tokens with these frequent words: the square of
    the number of classes."""
    return max(LEAST_SIDE, math.ceil(math.sqrt(2 + int((counts >= math.sqrt(total) / 10).sum())))) ** 2


def tokens(column: pa.Array, lexicon: Lexicon):
    """Hashes, places in the lexicon and whether they are there, with each text's end put in; and
    where texts begin."""
    h, at = word_hashes(*buffers(column))
    full = np.insert(apart(h).view(np.int64), at[1:], END)
    return (full, *lexicon.find(full), at + np.arange(len(at)))


def train(spark: SparkSession, docs: DataFrame, total: int, lexicon, size: int, hidden: int, rounds: int, slots: int = 512, window: int = 24, rate: float = 0.02) -> np.ndarray:
    """Weights after ``rounds`` rounds over ``docs`` (id, text), which are the training documents and
    have ``total`` tokens."""
    weights = Gru(size, hidden).start_from(lexicon.value.start).flat()
    shards = rounds * max(1, -(-total // (rounds * SHARD_TOKENS)))
    dealt = docs.select(F.xxhash64(F.col("id").cast("string"), "text", F.lit(5)).alias("h"), "text").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    for k in range(rounds):
        begin = spark.sparkContext.broadcast(weights)

        @tidy
        def work(batches, begin=begin, k=k):
            lex = lexicon.value
            model, adam, done, shard = Gru(size, hidden), {}, 0, None
            h, waiting, held = None, [], 0

            def step(inputs, targets, h):
                return model.learn(inputs, targets, inputs == lex.end, h, adam, rate / (1 + 3 * k) / (1 + adam.get("t", 0) / 400))

            def steps():
                nonlocal h, done
                stream = np.concatenate(waiting)
                n = len(stream) // slots // window * window
                lanes = stream[: n * slots].reshape(slots, n).T.astype(np.int64)
                inputs = np.vstack([np.full((1, slots), lex.end), lanes[:-1]]) if n else lanes
                for a in range(0, n, window):
                    h = step(inputs[a : a + window], lanes[a : a + window], h)
                    done += window * slots
                return [stream[n * slots :]]

            def finish():
                """The rest of a shard, and its weights."""
                nonlocal done
                left = steps()[0]  # what doesn't fill all slots: one step in shorter lanes
                few = min(slots, len(left) // 8)
                if few:
                    n = len(left) // few
                    lanes = left[: n * few].reshape(few, n).T.astype(np.int64)
                    step(np.vstack([np.full((1, few), lex.end), lanes[:-1]]), lanes, np.zeros((few, hidden), np.float32))
                    done += n * few
                if done:
                    yield from array_parts(np.append(model.flat().astype(np.float64) * done, float(done)))

            for part in (p for b in batches for p in slices(b, 1024)):
                of = part.column(0).to_numpy()
                ends = [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    if of[a] != shard:
                        if waiting:
                            yield from finish()
                        shard, adam, done, waiting, held = of[a], {}, 0, [], 0
                        h = np.zeros((slots, hidden), np.float32)
                        model.load(begin.value)
                    _, at, there, _ = tokens(part.column(1).slice(a, b - a), lex)
                    waiting.append(np.where(there, lex.number[at], lex.other).astype(np.int32))
                    held += len(waiting[-1])
                    if held > 600_000:
                        waiting = steps()
                        held = len(waiting[0])
            if waiting:
                yield from finish()

        part = dealt.where(F.col("shard") % rounds == k).repartition("shard").sortWithinPartitions("shard", "h", "text").select("shard", "text")
        sums = reduce_arrays(part.mapInArrow(work, shared._PART_SQL), len(weights) + 1, "float64", "add")
        if sums[-1]:
            weights = (sums[:-1] / sums[-1]).astype(np.float32)
    return weights


def score(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None, hidden: int = 16, rounds: int = 2, common: int = 1 << 18
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.
    Without ``size`` the network's vocabulary follows the corpus."""
    shared.bounded_batches(spark)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), is_held_out(id_col).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("id", "text")
    counts = count_words(spark, training.select("text"))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words, times = frequent(counts, common)
    size = size or network_size(times, sums.n)
    lex = Lexicon(words, times, size, sums.n)
    lexicon = spark.sparkContext.broadcast(lex)
    weights = spark.sparkContext.broadcast(train(spark, training, sums.n, lexicon, size, hidden, rounds))
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *_SCORES])

    @tidy
    def run(batches):
        words = lexicon.value
        model = Gru(size, hidden).load(weights.value)
        model.end = words.end
        logs = np.log10(words.c + 1.0)
        def scored(waiting: list[tuple]):
            """Rows that are scored together: the more texts, the fewer steps with few lanes."""
            column = pa.concat_arrays([c.cast(pa.large_string()) for _, _, c in waiting])
            h, at, there, begins = tokens(column, words)
            number = np.where(there, words.number[at], words.other)
            value = np.where(there, logs[at], 0.0)
            ends, add = begins[1:], lambda x: np.add.reduceat(x, begins[:-1]) if len(x) else np.zeros(0)
            texts = np.split(number.astype(np.int32), ends[:-1])
            rare = ~there
            rare_at = np.concatenate([[0], np.cumsum(add(rare.astype(np.int64)))]).astype(np.int32)
            return emit(
                schema,
                {
                    "doc_id": pa.concat_arrays([c for c, _, _ in waiting]),
                    "held_out": pa.concat_arrays([c for _, c, _ in waiting]),
                    "n_tokens": np.diff(begins).astype(np.int64),
                    "known": add((there & (words.c[at] > 0)).astype(np.int64)),
                    "logs": add(value),
                    "outside": add((number == words.other).astype(np.int64)),
                    "gru": model.score(texts) / np.log(10) + add(np.where(number == words.other, value, 0.0)),
                    "rare": pa.ListArray.from_arrays(rare_at, h[rare]),
                },
            )

        waiting, held = [], 0
        for part in (p for b in batches for p in slices(b, 512)):
            waiting.append(tuple(part.columns))
            held += part.column(2).nbytes
            if held > TOGETHER:
                yield scored(waiting)
                waiting, held = [], 0
        if waiting:
            yield scored(waiting)

    parts = rows.select("id", "held_out", "text").mapInArrow(run, StructType([StructField("doc_id", kind), *StructType.fromDDL(_SCORES_SQL).fields])).withColumn("row", F.monotonically_increasing_id())
    parts = save(spark, parts, "scores")
    rare = parts.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("tf"))
    found = rare.join(counts, "h").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    out = parts.drop("rare").join(found, "row", "left").fillna({"more": 0, "more_logs": 0.0})
    outside = float(np.log10(sums.n - lex.inside_tokens + sums.v - lex.inside_words + 1.0))
    base = F.col("logs") + F.col("more_logs") - F.col("n_tokens") * F.lit(float(np.log10(sums.n + sums.v + 1.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(sums.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("gru") + F.col("more_logs") - F.col("outside") * outside).alias("score")
    )


def op4_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probabilities of every whole document."""
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
