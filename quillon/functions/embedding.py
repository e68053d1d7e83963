"""Text vectors by feature hashing: a stand-in for embedding models, which aren't here.

A text's words (letters a-z and digits, case apart) are hashed into ``dim`` places with a sign each;
the vector has unit length, and is all zeros for a text without words. It knows words, not meanings.
Where a model is at hand, a function of a text column that returns its vectors takes its place."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 256
_WORD = re.compile(r"[a-z0-9]+")


def place(word: str, dim: int = DIM) -> tuple[int, int]:
    """Where a word stands in a vector, and its sign: the first eight and the ninth digit of its MD5."""
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:8], 16) % dim, 1 if digest[8] < "8" else -1


class _Places(dict):
    """Twice the place of a word, and one more for a positive sign, for at most 50,000 words at a time."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        at, sign = place(word, self.dim)
        self[word] = code = 2 * at + (sign > 0)
        return code


def embed(text: Column, dim: int = DIM, prefix: str = "", unit: bool = True) -> Column:
    """array<float> of a text; null gives zeros. ``prefix`` is put before texts that are queries, for
    models that want it. Without ``unit`` the places hold whole numbers."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        known = _Places(dim)
        out = np.zeros((len(texts), dim))
        listed = texts.to_pylist()
        for at in range(0, len(listed), 1024):
            words = [_WORD.findall((prefix + (t or "")).lower()) for t in listed[at : at + 1024]]
            rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
            codes = np.fromiter((known[w] for ws in words for w in ws), np.int64, len(rows))
            places, signs = codes >> 1, np.where(codes & 1, 1.0, -1.0)
            out[at : at + 1024] = np.bincount(rows * dim + places, signs, len(words) * dim).reshape(-1, dim)
        if unit:
            norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
            np.divide(out, norm, out=out, where=norm > 0)
        out = out.astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dim, out.reshape(-1))

    return run(text)
