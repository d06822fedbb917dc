"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter trigram is the
elementwise product (binding) of its three letters' vectors, the first rotated twice, the second once. A
text is the sum (bundle) of its trigrams' vectors; a language prototype is the bundle of all its training
texts. A text gets the language whose prototype has the largest cosine with it.

Trigrams with a space in the middle are left out; a word's first and last letters form trigrams
with the space beside them. Letters are compared in lower case; what is no letter counts as space.

Edge cases: a null text, or one without letters, gives `und` with score 0; without training rows, as for an
empty table, every text gives `und`; a tie goes to the alphabetically first language; null languages train
nothing; equal texts give equal rows, in whatever batch they are: bundles and their products with the
prototypes, which are kept as whole numbers, are sums of whole numbers that a double holds exactly; very
long texts are read whole; columns in `keep` pass untouched, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineshed.llm.textops import byte_batches, filter_texts, map_texts, mix64, tidy

DIM = 1024
SEED = 20240607
SCALE = 1 << 20  # prototypes are whole numbers of this length
MOST_CELLS = 1 << 22
MOST_BOUND = 8192
MOST_CHARS = 1 << 20  # of the texts that are bundled at once, but for a longer text
MOST_HELD = 1 << 17  # trigrams that a task counts before it binds them
UND = "und"
U = np.uint64
_letters: np.ndarray | None = None


def letter_points() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([unicodedata.category(chr(cp))[0] == "L" for cp in range(0x110000)])
    return _letters


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A row of +1 and -1 for each code point; 0 stands for a space."""
    blocks = np.arange(dim // 64, dtype=U) * U(0x9E3779B97F4A7C15)
    words = mix64(mix64(points.astype(U)[:, None] + U(SEED)) + blocks)
    return np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1).astype(np.float32) * 2 - 1


def bind(trigrams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The vectors of trigram codes, one a row."""
    parts = [(trigrams >> shift) & 0x1FFFFF for shift in (42, 21, 0)]
    points = np.unique(np.concatenate(parts))
    vectors = letter_vectors(points, dim)
    first, second, third = (np.searchsorted(points, p) for p in parts)
    twice, once = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    out = np.empty((len(trigrams), dim), dtype=np.float32)
    for k in range(0, len(trigrams), 1024):
        rows = slice(k, k + 1024)
        np.multiply(twice[first[rows]], once[second[rows]], out=out[rows])
        out[rows] *= vectors[third[rows]]
    return out


def trigram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes, of three code points, of all texts, and the number of the text that each comes from."""
    points = np.frombuffer(("\n" + "\n".join(t.replace("\n", " ").lower() for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letter_points()[points]
    doc = np.cumsum(points == 10, dtype=np.int32) - np.int32(1)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # of a run of spaces the first stays
    kind, doc = np.where(letter, points, 0)[keep].astype(np.int64), doc[keep]
    if len(kind) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    middle = kind[1:-1] > 0
    code = (kind[:-2] << 42) | (kind[1:-1] << 21) | kind[2:]
    return code[middle], doc[1:-1][middle]


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, rising, and the place of each code among them."""
    parts = [(codes >> shift) & 0x1FFFFF for shift in (42, 21, 0)]
    known = np.zeros(0x110000, dtype=bool)
    for p in parts:
        known[p] = True
    points = np.flatnonzero(known)
    n = len(points)
    if n**3 > MOST_CELLS:
        return np.unique(codes, return_inverse=True)
    place = np.zeros(0x110000, dtype=np.int32)
    place[points] = np.arange(n)
    cell = (place[parts[0]] * n + place[parts[1]]) * n + place[parts[2]]
    seen = np.zeros(n**3, dtype=bool)
    seen[cell] = True
    used = np.flatnonzero(seen)
    column = np.zeros(n**3, dtype=np.int32)
    column[used] = np.arange(len(used))
    return (points[used // (n * n)] << 42) | (points[used // n % n] << 21) | points[used % n], column[cell]


def parts_of(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about `MOST_CHARS` characters at most, one text at least."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > MOST_CHARS:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def count_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigram codes of all texts and how often each stands there."""
    used, column = distinct(trigram_codes(texts)[0])
    return used, np.bincount(column, minlength=len(used))


def added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with the sums of their counts."""
    used, place = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
    total = np.zeros(len(used), dtype=np.int64)
    np.add.at(total, place, np.concatenate([n for _, n in counts]))
    return used, total


def bundle(codes: np.ndarray, often: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The sum of the codes' vectors, each as often as told."""
    total = np.zeros(dim)
    for k in range(0, len(codes), MOST_BOUND):
        total += often[k : k + MOST_BOUND].astype(np.float64) @ bind(codes[k : k + MOST_BOUND], dim).astype(np.float64)
    return total


@dataclass
class Profiles:
    """Language names in alphabetical order and their prototypes, one a row, whole numbers of length SCALE or so."""

    languages: list[str]
    prototypes: np.ndarray

    def score(self, texts: list[str]) -> list:
        """Language and cosine of each text; cosines under 0 count as 0."""
        return self.measure(texts)[:2]

    def measure(self, texts: list[str]) -> list:
        """Language, cosine and number of trigrams of each text. Texts are bundled in parts, which changes memory only."""
        got = [self._measure(texts[part]) for part in parts_of(texts)] or [self._measure(texts)]
        return [sum((g[0] for g in got), []), *[np.concatenate([g[k] for g in got]) for k in (1, 2)]]

    def _measure(self, texts: list[str]) -> list:
        best = np.full(len(texts), UND, dtype=object)
        scores = np.zeros(len(texts))
        sizes = np.zeros(len(texts), dtype=np.int64)
        if not self.languages:
            return [list(best), scores, sizes]
        code, doc = trigram_codes(texts)
        if not len(code):
            return [list(best), scores, sizes]
        dim = self.prototypes.shape[1]
        sizes = np.bincount(doc, minlength=len(texts))
        exact = np.float32 if sizes.max() < 1 << 24 else np.float64  # sums of so many are exact
        used, column = distinct(code)
        step = max(1, 2_000_000 // len(used))
        first = np.searchsorted(doc, np.arange(0, len(texts) + step, step))
        bundles = np.zeros((len(texts), dim), dtype=np.float64)
        for low in range(0, len(used), MOST_BOUND):  # the trigrams' vectors, a part at a time
            part = bind(used[low : low + MOST_BOUND], dim).astype(exact, copy=False)
            inside = slice(None) if len(used) <= MOST_BOUND else (column >= low) & (column < low + MOST_BOUND)
            for k, start in enumerate(range(0, len(texts), step)):
                rows = min(step, len(texts) - start)
                here = slice(first[k], first[k + 1])
                cell = (doc[here] - start) * len(part) + column[here] - low
                cell = cell if len(used) <= MOST_BOUND else cell[inside[here]]
                counts = np.bincount(cell, minlength=rows * len(part)).reshape(rows, len(part)).astype(exact)
                bundles[start : start + rows] += counts @ part
        length = np.sqrt(np.array([row @ row for row in bundles]) * np.einsum("ij,ij->i", self.prototypes, self.prototypes)[:, None]).T
        cosine = (bundles @ self.prototypes.T) / np.maximum(length, 1e-9)
        top = cosine.argmax(axis=1)
        known = sizes > 0
        best[known] = np.array(self.languages, dtype=object)[top[known]]
        scores[known] = np.clip(cosine[np.arange(len(texts)), top], 0, 1)[known]
        return [list(best), scores, sizes]


def fit(training: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> Profiles:
    """Bundles every training text. Each task bundles its own rows and sends one vector a language."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        held: dict[str, list] = {}

        def bind_held(name: str) -> None:
            totals[name] = totals.get(name, 0) + bundle(*added(held.pop(name)), dim)

        for pdf in byte_batches(frames, "t"):
            for name, rows in pdf.groupby("l"):
                texts = list(rows["t"])
                for part in parts_of(texts):
                    held.setdefault(name, []).append(count_codes(texts[part]))
                    if sum(len(c) for c, _ in held[name]) > MOST_HELD:
                        held[name] = [added(held[name])]
                        if 2 * len(held[name][0][0]) > MOST_HELD:
                            bind_held(name)
        for name in list(held):
            bind_held(name)
        for name, total in totals.items():
            yield pd.DataFrame({"l": name, "k": np.arange(dim), "v": np.rint(total).astype(np.int64)})

    rows = (
        training.select(F.col(text).alias("t"), F.col(lang).alias("l"))
        .filter("t is not null and l is not null")
        .mapInPandas(tidy(partial), "l string, k int, v long")
        .groupBy("l", "k")
        .agg(F.sum("v").alias("v"))
        .collect()  # languages x dim rows
    )
    names = sorted({r["l"] for r in rows})
    table = np.zeros((len(names), dim), dtype=np.float64)
    place = {n: i for i, n in enumerate(names)}
    for r in rows:
        table[place[r["l"]], r["k"]] = r["v"]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return Profiles(names, np.rint(table / np.maximum(norm, 1e-9) * SCALE))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, lang_pred and score for every row of docs."""
    return map_texts(docs, text, keep, "lang_pred string, score double", lambda texts: profiles.score([t or "" for t in texts]))


def keep_known(docs: DataFrame, profiles: Profiles, least: float, half: float, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language and a cosine that is large enough.

    A text of n trigrams needs `least` * n / (n + half) or more: a short text is little like its language.
    """

    def known(texts: list) -> np.ndarray:
        best, scores, sizes = profiles.measure([t or "" for t in texts])
        return (np.array(best, dtype=object) != UND) & (scores >= least * sizes / (sizes + half))

    return filter_texts(docs, text, known)
