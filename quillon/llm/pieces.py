"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model is compiled to three machines, and a text's pieces are the tropical shortest path
through their composition with the text:

* the normaliser rewrites the text: longest matches of the model's own map (a compiled trie in the
  model file), white space as the model treats it, a space as U+2581;
* the piece transducer has an arc for each piece, and for each character one to its byte
  pieces (or to the unknown piece), which stands in where no piece spells the character;
* the acceptor of neighbours weighs pairs of pieces. Its states are the pieces themselves. For
  unigram models every pair weighs 0 and an arc minus its piece's score. For models trained by byte-pair
  merges arcs weigh 0, and a pair weighs 0 if the model's merges leave it apart and infinity
  if they don't. Merges made inside two neighbours never hang on anything outside
  them, so a sequence is what the merges produce exactly when all its neighbours are: its path is the
  one that is finite.

The composition is expanded lazily: its states are (place in the text, piece before), arcs of
infinite weight lead nowhere, and states are settled by least weight first, of equal ones the
furthest first, so few of them are ever made. Decoding runs the piece transducer backwards.

No piece continues after a U+2581 that follows other text, and no merge touches a character
that only bytes spell, so the composition falls apart there; paths of parts are
remembered up to a bound in bytes, until the task ends.

Defined results: a null text gives null ids (n_pieces 0); an empty text gives no ids;
a U+2581 in a text decodes to a space; control and byte pieces are never matched in
a text; ``exact`` says whether the ids decode to the text, for models whose normaliser changes
nothing but spaces; repeated rows are encoded each.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import shared

SPACE = "▁"
MODEL = os.environ.get("QUILLON_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Normaliser:
    """The first machine: a text to the characters that pieces spell.

    ``chart`` is the model's map: the size of a trie in bytes, the trie as a double array of 32-bit
    units (bits 0-7 the label, bit 8 whether a value hangs below, bits 10-30 the offset, which
    bit 9 shifts by 8), and the replacements, each ended by a zero byte."""

    def __init__(self, chart: bytes = b"", prefix: bool = True, strip: bool = True, escape: bool = True):
        self.prefix, self.strip, self.escape = prefix, strip, escape
        size = int.from_bytes(chart[:4], "little")
        self.units = np.frombuffer(chart[4 : 4 + size], "<u4").tolist()
        self.texts = chart[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """Length of the longest match of the map at a place, and what replaces it."""
        node, found = 0, (0, None)
        units = self.units
        node ^= self._offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return found

    def mapped(self, text: str) -> str:
        if not self.units:
            return text
        data, out, at = text.encode(), [], 0
        while at < len(data):
            n, new = self.longest(data, at)
            if new is None:  # a character that the map doesn't name stays
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at : at + n]
            out.append(new)
            at += n
        return b"".join(out).decode()

    def __call__(self, text: str) -> str:
        text = self.mapped(text)
        if self.strip:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.prefix:
            text = " " + text
        if self.escape:
            text = text.replace(" ", SPACE)
        return text.rstrip(SPACE if self.escape else " ") if self.strip else text  # a U+2581 of the text itself counts here


class Transducer:
    """The compiled model. ``data`` is the model file's bytes, ``remember`` the bytes that paths of
    parts may take."""

    def __init__(self, data: bytes, remember: int = 24 << 20):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.merges, self.normaliser = False, Normaliser()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("models of words or characters have no transducer here")
                self.merges = kind == 2
            elif number == 3:
                spec = dict(_fields(value))
                self.normaliser = Normaliser(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        # spaces alone change: encoding can skip the other machines of the normaliser
        self.plain = not self.normaliser.units and not self.normaliser.strip and self.normaliser.escape
        self.prefix, self.remember = self.normaliser.prefix, remember
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.parts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.spelled = set("".join(self.ids))
        self.trie = self._trie()
        normal = [x for x, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL] or [0.0]
        if max(normal) > 0 and not self.merges:
            raise ValueError("scores of a unigram model are logarithms of probabilities")
        # a piece that the user set is likelier than any that the model learnt; 10 below the least for what isn't spelled
        self.fallback = 0.0 if self.merges else 10.0 - min(normal)
        own = [0.1 - len(p) * max(normal) if k == USER else -x for p, x, k in zip(self.pieces, self.scores, self.kinds, strict=True)]
        self.weight = [0.0] * len(self.pieces) if self.merges else own
        self.tree: dict[str, tuple[str, str] | None] = {}
        self.rows: defaultdict[int, dict[int, bool]] = defaultdict(dict)  # what is known of pairs, by the piece before
        self.pairs = 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known_bytes = 0
        table = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else (" ⁇ " if k == UNKNOWN else p.replace(SPACE, " ")).encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.spell_len = np.array([len(b) for b in table], np.int64)
        self.spell_at = np.concatenate([[0], np.cumsum(self.spell_len)[:-1]])
        self.spell = np.frombuffer(b"".join(table), np.uint8)

    def _trie(self) -> dict:
        """Pieces by their characters: for each character the piece that ends there (-1 for none) and what
        may follow."""
        leaf: dict = {}
        root: dict = {}
        for piece, i in self.ids.items():
            kids = root
            for c in piece[:-1]:
                found = kids.get(c)
                if found is None or found[1] is leaf:
                    found = kids[c] = (-1 if found is None else found[0], {})
                kids = found[1]
            last = kids.get(piece[-1])
            kids[piece[-1]] = (i, leaf if last is None else last[1])
        return root

    def forget(self) -> None:
        """Drops the paths that encoding has remembered; of neighbours few are known, and they stay."""
        self.known, self.older, self.known_bytes = {}, {}, 0

    # --- the acceptor of adjacent pieces ---

    def score(self, piece: str) -> float:
        return self.scores[self.ids[piece]]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece, None if merges never make it."""
        if piece not in self.tree:
            parts, last = list(piece), None
            while len(parts) > 1:
                best = max(((self.scores[self.ids[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids), default=None)
                if best is None:
                    break
                i = -best[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.tree[piece] = last if len(parts) == 1 else None
        return self.tree[piece]

    def made(self, piece: str) -> bool:
        return len(piece) == 1 or self.split(piece) is not None

    def apart(self, left: str, right: str) -> bool:
        """Whether merges leave the border between two pieces: undo the later of both sides'
        last merges again and again; no merge across the border may come before one undone."""
        a, b = left, right
        limit, undone_right = -np.inf, False  # the score of the merge undone last; higher scores merge first
        while True:
            cross = self.ids.get(a + b)
            if cross is not None and ((s := self.scores[cross]) > limit or (s == limit and undone_right)):
                return False
            sa = self.score(a) if len(a) > 1 else np.inf
            sb = self.score(b) if len(b) > 1 else np.inf
            if sa == sb == np.inf:
                return True
            if sb <= sa:  # of equal merges the left one comes first
                limit, undone_right, b = sb, True, self.split(b)[0]
            else:
                limit, undone_right, a = sa, False, self.split(a)[1]

    def fits(self, before: int, piece: int) -> bool:
        """Whether a pair's weight is finite; ``before`` is -1 where no piece of the part stands before."""
        row = self.rows[before]
        known = row.get(piece)
        if known is None:
            if self.pairs > 150_000:  # about 12 MB
                self.rows, self.pairs = defaultdict(dict), 0
                row = self.rows[before]
            right = self.pieces[piece]
            known = row[piece] = self.made(right) and (before < 0 or self.apart(self.pieces[before], right))
            self.pairs += 1
        return known

    # --- shortest paths ---

    def shortest(self, text: str) -> list[int]:
        """Piece ids on the tropical shortest path through a part of a text; -2 minus its code stands
        for a character that falls back to bytes.

        A state is (place, piece before): the composition's places of the text and the acceptor's
        states. The queue holds (weight, minus place, where the last piece begins, number of a visit), so
        of equal paths the one with the longer last piece wins; visits link back to the ones before
        them, and a state is settled once."""
        if self.merges:
            return self.unweighted(text)
        n, trie = len(text), self.trie
        visits = [(-1, -1, 0.0)]  # (visit before, piece, weight)
        queue = [(0.0, 0, 0, 0)]
        settled = set()
        while queue:
            weight, place, _, visit = heapq.heappop(queue)
            at = -place
            if at == n:
                break
            if at in settled:  # every pair weighs 0, so the piece before doesn't tell states apart
                continue
            settled.add(at)
            arcs, kids = [], trie
            for end in range(at + 1, n + 1):
                found = kids.get(text[end - 1])
                if found is None:
                    break
                i, kids = found
                if i >= 0:
                    arcs.append((end, i, weight + self.weight[i]))
            if not arcs or arcs[0][0] > at + 1:
                arcs.append((at + 1, -2 - ord(text[at]), weight + self.fallback))
            for end, i, total in arcs:
                visits.append((visit, i, total))
                heapq.heappush(queue, (total, -end, at, len(visits) - 1))
        else:
            raise ValueError("no finite path")
        out = []
        while visit:
            visit, i, _ = visits[visit]
            out.append(i)
        return out[::-1]

    def unweighted(self, text: str) -> list[int]:
        """The same where every finite weight is 0, as for models of merges: the first path that arrives is
        shortest, so the queue is a stack, the path itself, and arcs are tried longest first. A state is
        (place, piece before, -1 for none); one without a finite arc is not entered again."""
        n, trie, ids, rows = len(text), self.trie, self.ids, self.rows
        out: list[int] = []
        sizes: list[int] = []
        closed: set[tuple[int, int]] = set()
        at, before, most = 0, -1, n  # arcs end at ``most`` at the furthest
        while at < n:
            stop, end, i, kids = at, at, -1, trie
            while end < most:  # the longest arc
                found = kids.get(text[end])
                if found is None:
                    break
                end += 1
                x, kids = found
                if x >= 0:
                    stop, i = end, x
            if i < 0 and most > at:
                stop = at + 1
            row = rows[before]
            fits = row.get(i) if i >= 0 else stop > at
            if fits is None:
                fits = self.fits(before, i)
            while not fits and stop > at:  # else the next shorter one
                stop -= 1
                i = ids.get(text[at:stop], -1)
                if i >= 0:
                    fits = row.get(i)
                    if fits is None:
                        fits = self.fits(before, i)
                else:
                    fits = stop == at + 1 and text[at] not in ids  # no piece spells the character
            if fits:
                out.append(i if i >= 0 else -2 - ord(text[at]))
                sizes.append(stop - at)
                at, before, most = stop, i, n  # i is -1 behind a character that falls back
                if not closed or (at, before) not in closed:
                    continue
            else:
                closed.add((at, before))
            if not out:
                raise ValueError("no finite path")
            out.pop()
            most = at - 1
            at -= sizes.pop()
            before = max(out[-1], -1) if out else -1
        return out

    def spelled_out(self, path: list[int]) -> list[int]:
        """A path with the bytes of characters that fall back."""
        ids: list[int] = []
        for i in path:
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in chr(-2 - i).encode()]
            elif not ids or ids[-1] != self.unknown:  # unknown characters that follow each other are one
                ids.append(self.unknown)
        return ids

    def part(self, text: str) -> bytes:
        """Ids of a part as int32 bytes; the paths of short parts are remembered."""
        got = self.known.get(text)
        if got is None:
            got = self.older.get(text)
            if got is None:
                ids = self.unweighted(text) if self.merges else self.shortest(text)
                if ids and min(ids) < 0:
                    ids = self.spelled_out(ids)
                got = array("i", ids).tobytes()
            if len(text) <= 64:
                self.known_bytes += 200 + len(text) * 2 + len(got)  # a dictionary entry, its string and bytes
                if 2 * self.known_bytes > self.remember:  # two generations: what is used again stays
                    self.known, self.older, self.known_bytes = {}, self.known, 0
                self.known[text] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if not self.plain:
            text = self.normaliser(text)
            found = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text) if self.parts else [text] if text else []
            return np.frombuffer(b"".join(map(self.part, found)), np.int32)
        if not text:
            return np.zeros(0, np.int32)
        if self.prefix:
            text = " " + text
        if not self.parts:
            return np.frombuffer(self.part(text.replace(" ", SPACE)), np.int32)
        out, part = [], self.part
        for k, line in enumerate(text.split("\n")) if "\n" not in self.spelled else [(0, text)]:
            if k:
                out.append(part("\n"))
            if SPACE in line or "  " in line or line.endswith(" "):
                out += [part(x) for x in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line.replace(" ", SPACE))]
                continue
            words = line.split(" ")
            if words[0]:
                out.append(part(words[0]))
            new = self.known
            for w in words[1:]:
                w = SPACE + w
                got = new.get(w)
                if got is None:
                    got = part(w)
                    new = self.known
                out.append(got)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids spell; ill-formed byte sequences become U+FFFD."""
        n = self.spell_len[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.spell_at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        text = self.spell[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(data: bytes) -> Transducer:
    return Transducer(data)


def read_model(path: str = MODEL) -> bytes:
    """The model file, read on the driver; executors get it as a broadcast of its size (about 0.5 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encoded(spark: SparkSession, text: Column | str, path: str = MODEL) -> Column:
    """A struct of ids (array<int>) and exact: whether the ids decode to the text."""
    shared.bounded_batches(spark)
    model = spark.sparkContext.broadcast(read_model(path))

    @F.arrow_udf("ids array<int>, exact boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = transducer(model.value)
        try:
            for texts in batches:
                chunks, exact = [], []
                for k in range(0, len(texts), 256):
                    for t in texts.slice(k, 256).to_pylist():
                        ids = None if t is None else machine.encode(t)
                        chunks.append(ids)
                        exact.append(None if t is None else machine.decode(ids) == t.replace(SPACE, " "))
                ends = np.cumsum([0] + [0 if c is None else len(c) for c in chunks]).astype(np.int32)
                flat = np.concatenate([c for c in chunks if c is not None] or [np.zeros(0, np.int32)])
                missing = pa.array([c is None for c in chunks], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=missing)
                yield pa.StructArray.from_arrays([lists, pa.array(exact, pa.bool_())], ["ids", "exact"])
        finally:
            machine.forget()
            shared.release()

    return run(text)


def decoded(spark: SparkSession, ids: Column | str, path: str = MODEL) -> Column:
    """The text of an array of ids."""
    model = spark.sparkContext.broadcast(read_model(path))

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        machine = transducer(model.value)
        return pa.array([None if x is None else machine.decode(np.array(x, np.int64)) for x in lists.to_pylist()], pa.string())

    return run(ids)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and whether the round trip is exact, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return stage(spark, docs, sf_dir).select("doc_id", "ids", "n_pieces", "exact")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents' ids in place of their texts. Columns of the names that it
    makes are replaced."""
    (found,) = shared.fresh(docs, "_e")
    e = docs.withColumn(found, encoded(spark, F.col("text")))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "ids", "n_pieces", "exact")]
    return e.select(*rest, F.col(f"{found}.ids").alias("ids"), F.coalesce(F.size(f"{found}.ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col(f"{found}.exact").alias("exact"))
