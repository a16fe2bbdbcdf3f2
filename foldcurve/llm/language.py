"""Language identification by hyperdimensional profiles.

Each letter has a random bipolar vector, made from its code point by a fixed integer
hash; runs of anything that is no letter are one gap symbol with a vector of its own.
The vector of a three-letter window is the product of the first letter's vector shifted
twice, the second's shifted once and the third's. A document's vector is the sum of its
windows' vectors; a language's prototype bundles the unit vectors of its documents; the
prediction is the prototype with the largest cosine.

Training passes over all training rows: every task sums its own documents per language,
so that what is shuffled is one vector per language and Arrow batch, and a few numbers
per language reach the driver. Prediction shuffles nothing. Whole texts are read; memory
is one Arrow batch and a bounded cache of window vectors.

Null texts and texts without a letter get `und` and score 0; so does every text when
nothing was learned. Null languages and texts without letters teach nothing. Equal
cosines go to the smaller language value. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
#: Windows whose vectors a worker keeps: 512 bytes each.
CACHE_WINDOWS = 60_000
#: Characters whose windows are counted at once.
BLOCK_CHARS = 1 << 20
UNKNOWN = "und"
GAP = 0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-cased letter, or GAP."""
    table = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def random_vectors(symbols: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of -1 and 1 for each symbol, by the splitmix64 finaliser of symbol and place."""
    with np.errstate(over="ignore"):
        z = symbols.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(dimensions, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(63)).astype(np.int8) * np.int8(2) - np.int8(1)


class Profiles:
    """Window vectors of one worker."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.known = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, dimensions), np.float32)

    def bound(self, windows: np.ndarray) -> np.ndarray:
        """Vectors of windows given as three code points of 21 bits each."""
        out = np.ones((len(windows), self.dimensions), np.int8)
        for place, shift in ((0, 42), (1, 21), (2, 0)):
            symbols, back = np.unique((windows >> shift) & 0x1FFFFF, return_inverse=True)
            out *= np.roll(random_vectors(symbols, self.dimensions), 2 - place, axis=1)[back]
        return out.astype(np.float32)

    def places(self, windows: np.ndarray) -> np.ndarray:
        """Rows of self.vectors for sorted distinct windows."""
        at = np.searchsorted(self.known, windows)
        new = windows[(at >= len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != windows)] if len(self.known) else windows
        if len(new):
            if len(self.known) + len(new) > CACHE_WINDOWS:
                new, self.known, self.vectors = windows, np.zeros(0, np.int64), np.zeros((0, self.dimensions), np.float32)
            merged = np.concatenate([self.known, new])
            order = np.argsort(merged, kind="stable")
            self.known = merged[order]
            self.vectors = np.concatenate([self.vectors, self.bound(new)])[order]
            at = np.searchsorted(self.known, windows)
        return at

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: the sum of its windows' vectors; zeros where it has no letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        block, size = [], 0
        for i, text in enumerate(texts):
            text = text or ""
            if len(text) > BLOCK_CHARS:
                self.add_long(out, i, text)
                continue
            block.append((i, text))
            size += len(text)
            if size >= BLOCK_CHARS:
                self.add(out, block)
                block, size = [], 0
        self.add(out, block)
        return out

    @staticmethod
    def symbols(joined: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of `joined` without gaps that precede a gap of the same text, and the places of those that stay."""
        symbol = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.zeros(len(symbol), bool)
        first[starts] = True
        keep = np.flatnonzero(first | (symbol != GAP) | np.append(False, symbol[:-1] != GAP))
        return symbol[keep].astype(np.int64), keep

    def add(self, out: np.ndarray, block: list[tuple[int, str]]) -> None:
        """Whole texts, a gap before and after each."""
        if not block:
            return
        lengths = np.array([len(text) + 2 for _, text in block])
        symbol, keep = self.symbols("".join(" " + text + " " for _, text in block), np.cumsum(lengths) - lengths)
        self.tally(out, symbol, np.repeat(np.arange(len(block)), lengths)[keep], [i for i, _ in block])

    def add_long(self, out: np.ndarray, i: int, text: str) -> None:
        """One text, its symbols in cuts that overlap by the two that their windows share."""
        symbol, _ = self.symbols(" " + text + " ", np.zeros(1, int))
        for at in range(0, len(symbol) - 2, BLOCK_CHARS):
            cut = symbol[at : at + BLOCK_CHARS + 2]
            self.tally(out, cut, np.zeros(len(cut), int), [i])

    def tally(self, out: np.ndarray, symbol: np.ndarray, owner: np.ndarray, rows_of: list[int]) -> None:
        """Adds the windows of `symbol` to the rows that their owners stand for."""
        same = owner[2:] == owner[:-2]
        windows = ((symbol[:-2] << 42) | (symbol[1:-1] << 21) | symbol[2:])[same]
        if not len(windows):
            return
        owner = owner[2:][same]
        distinct, inverse = np.unique(windows, return_inverse=True)
        cells, counts = np.unique(owner * len(distinct) + inverse, return_counts=True)

        places = self.places(distinct)
        rows = self.vectors[places]
        kind, doc = cells % len(distinct), cells // len(distinct)
        for a in range(0, len(rows_of), 64):
            b = min(a + 64, len(rows_of))
            lo, hi = np.searchsorted(doc, [a, b])
            table = np.zeros((b - a, len(distinct)), np.float32)
            table[doc[lo:hi] - a, kind[lo:hi]] = counts[lo:hi]
            part = table @ rows
            for j in range(a, b):
                out[rows_of[j]] += part[j - a]


@lru_cache(maxsize=2)
def profiles(dimensions: int) -> Profiles:
    return Profiles(dimensions)


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def prototypes(rows: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, list[float]]:
    """Language to prototype, of rows with text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = profiles(dimensions)
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vectors = unit(own.encode(texts)).astype(np.float64)
            names, back = np.unique(np.array(langs, object), return_inverse=True)
            sums = np.zeros((len(names), dimensions))
            np.add.at(sums, back, vectors)
            rows = sums.any(axis=1)
            if rows.any():
                lists = pa.ListArray.from_arrays(np.arange(0, rows.sum() * dimensions + 1, dimensions, dtype=np.int32), pa.array(sums[rows].reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(names[rows].tolist(), pa.string()), lists], ["lang", "vector"])

    kept = rows.where("lang is not null and text is not null").selectExpr("cast(text as string) as text", "cast(lang as string) as lang")
    parts = kept.mapInArrow(run, "lang string, vector array<double>")
    placed = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = placed.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("vector"))
    return {r.lang: list(r.vector) for r in whole.collect()}


def identify(docs: DataFrame, learned: dict[str, list[float]], dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, lang_pred and score: the largest cosine, 0 where it is negative."""
    names = sorted(learned)
    matrix = unit(np.array([learned[n] for n in names], np.float64).reshape(len(names), dimensions)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = profiles(dimensions)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if names:
                cosines = unit(own.encode(texts)) @ matrix.T
                best = cosines.argmax(axis=1)
                known = np.array([has_letter(t) for t in texts], bool)
                pred = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
                score = np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0.0).astype(np.float64)
            else:
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, lang_pred string, score double")
