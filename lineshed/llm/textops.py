"""Vectorised word and shingle hashing of one text, and maps over texts, shared by the corpus operators.

Words are the lower-cased runs of bytes between ASCII white space. A text of fewer than
`size` words has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

U = np.uint64
MOST = 4_000_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
_powers = np.array([pow(_BASE, k, 1 << 64) for k in range(64)], dtype=U)


def _power_table(n: int) -> np.ndarray:
    """Powers of the base modulo 2^64, for words of up to n bytes at least."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * U(pow(_BASE, len(_powers), 1 << 64))])
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, so that equal low bits don't survive."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_spans(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words, from the mask of the bytes between words."""
    inside = np.empty(len(space) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~space
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str | None, plain: bool = False) -> np.ndarray:
    """A 64-bit hash for each word of the text, in order. plain: ASCII punctuation parts words too."""
    return hashed_words(text, plain)[0]


def hashed_words(text: str | None, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and their lengths in bytes."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    between = _PUNCTUATION if plain else _SPACE
    starts, ends = word_spans(between[data])
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, dtype=U), lengths
    data = data[starts[0] :]
    ends = ends - starts[0]
    starts = starts - starts[0]
    space = between[data]
    within = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    within[space] = 0
    terms = (data.astype(U) + U(1)) * _power_table(int(lengths.max()))[within]
    terms[space] = 0
    return mix64(np.add.reduceat(terms, starts) ^ (lengths.astype(U) << U(40))), lengths


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A 64-bit hash for each run of `size` words, in order."""
    n = len(words)
    if not n:
        return words
    take = min(size, n)
    out = words[: n - take + 1].copy()
    for k in range(1, take):
        out = out * U(_BASE) + words[k : n - take + 1 + k]
    return mix64(out + U(take))


def byte_batches(frames: Iterator[pd.DataFrame], column: str, most: int = MOST) -> Iterator[pd.DataFrame]:
    """Cuts pandas batches so that each holds about `most` characters at most, one row at least."""
    for pdf in frames:
        if pdf.empty:
            continue
        sizes = pdf[column].map(lambda t: len(t) if t is not None else 0).to_numpy(dtype=np.int64)
        if sizes.sum() <= most:
            yield pdf
            continue
        part = np.cumsum(sizes) // most
        for _, rows in pdf.groupby(part, sort=True):
            yield rows


def give_back() -> None:
    """Returns freed memory to the system: else a worker keeps the most it ever had beside what its executor needs next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a map over batches, whose worker gives memory back when a task ends."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def text_slices(batches: Iterator[pa.RecordBatch], most: int = MOST, at: int = -1) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of about `most` bytes of a column, the last one if not told, at most, one row at least, and that column's values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(at % batch.num_columns)
        part = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            piece = batch.slice(start, end - start)
            yield piece, piece.column(at % piece.num_columns).to_pylist()


def fresh(name: str, taken: Sequence[str]) -> str:
    """The name, with underscores in front until no taken one equals it, whatever the case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def map_texts(df: DataFrame, text: str, keep: Sequence[str], fields: str, compute: Callable[[list], Sequence]) -> DataFrame:
    """The columns in `keep`, untouched, and `fields`: compute(values of the text column) gives a sequence for each.

    compute may instead give (rows, sequences) with the number of the row that each result belongs to.
    """
    added = StructType.fromDDL(fields)
    types = [to_arrow_type(f.dataType) for f in added]
    names = [*keep, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            got = compute(texts)
            kept = [batch.column(k) for k in range(len(keep))]
            if isinstance(got, tuple):
                rows = pa.array(got[0], type=pa.int64())
                kept, got = [c.take(rows) for c in kept], got[1]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, type=t) for v, t in zip(got, types, strict=True)]], names=names)

    schema = StructType([*df.select(*keep).schema.fields, *added.fields])
    return df.select(*keep, F.col(text).alias(fresh("__text", keep))).mapInArrow(tidy(run), schema)


def filter_texts(df: DataFrame, text: str, wanted: Callable[[list], Sequence[bool]]) -> DataFrame:
    """The rows of df, with all their columns untouched, for which wanted(values of the text column) is true."""
    names = df.columns if text in df.columns else [c.lower() for c in df.columns]
    at = names.index(text if text in names else text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, at=at):
            yield batch.filter(pa.array(np.asarray(wanted(texts), dtype=bool)))

    return df.mapInArrow(tidy(run), df.schema)
