"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased and parted by white space and ASCII punctuation. For every benchmark item of L
words, the windows of L words of a document are compared with it: 64-bit SimHash fingerprints of the
words, in `BLOCKS` blocks of 16 bits. Two fingerprints within `RADIUS` differ in at most `PER_BLOCK` bits
in one block at least, so looking up all values that near in each block, by length, finds all of them, and
some 4 % of the unlike ones. A text shorter than an item is one window, compared with every item of that
length whatever the distance. Found pairs are verified exactly: weighted Jaccard similarity of the word
five-shingles, each weighing the letters of its words, of `THRESHOLD` or more.

Only windows that hold enough shingles of the items of their length to reach the threshold with one of
them get a fingerprint; the bound is exact, so none that could be verified is passed over.

The benchmark is read in parts of about `PART_BYTES` of text, so what a task holds is bounded whatever
the benchmark's size; all parts are searched in the same pass when documents are cleaned.

Edge cases: null, empty or word-less texts and items match nothing; an item of fewer than five words
has one shingle of all its words; items with equal words each match; of several windows the most
similar counts, then the first; rows with null ids are judged like others; repeated rows are each judged;
very long texts are read whole; an empty benchmark or table matches nothing; further columns, of any name,
pass through `clean` untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineshed.llm.textops import filter_texts, hashed_words, map_texts, shingle_hashes

SIZE = 5
THRESHOLD = 0.8
BLOCKS, PER_BLOCK = 4, 3
RADIUS = BLOCKS * (PER_BLOCK + 1) - 1
PART_BYTES = 4 << 20
U = np.uint64
#: All 16-bit patterns of at most PER_BLOCK bits.
NEAR = np.array([sum(1 << k for k in bits) for n in range(PER_BLOCK + 1) for bits in combinations(range(16), n)], dtype=np.int64)


def bit_signs(words: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each word hash."""
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def fingerprints(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the windows of `length` words that begin at starts."""
    sums = np.zeros((len(words) + 1, 64), dtype=np.int32)
    np.cumsum(bit_signs(words), axis=0, dtype=np.int32, out=sums[1:])
    window = sums[starts + length] - sums[starts]
    return np.packbits(window > 0, axis=1).reshape(-1, 8).copy().view(">u8").ravel().astype(U)


def block_values(fingerprint: int) -> list[int]:
    return [fingerprint >> 16 * b & 0xFFFF for b in range(BLOCKS)]


def weights(lengths: np.ndarray, size: int) -> np.ndarray:
    """Letters of the words of each shingle."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    size = min(size, len(lengths))
    return total[size:] - total[:-size] if size else total[:0]


def similarity(a: dict[int, float], b: dict[int, float]) -> float:
    """Weighted Jaccard similarity of two maps from shingle to weight."""
    shared = sum(min(w, b.get(s, 0)) for s, w in a.items())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a or b else 0.0


def shingle_weights(words: np.ndarray, lengths: np.ndarray, size: int = SIZE) -> dict[int, float]:
    out: Counter = Counter()
    for s, w in zip(shingle_hashes(words, size).tolist(), weights(lengths, size).tolist()):
        out[s] += w
    return out


@dataclass
class ItemIndex:
    """A part of the benchmark, ready to be searched."""

    threshold: float = THRESHOLD
    items: list[tuple] = field(default_factory=list)  # id, length, fingerprint, shingle weights
    blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)  # by length and block: values, rising, and items
    least: dict[int, int] = field(default_factory=dict)  # by length: the fewest shared shingles of a match
    shingles: dict[int, np.ndarray] = field(default_factory=dict)  # by shingle size, rising
    by_length: dict[int, list[int]] = field(default_factory=dict)
    own_shingles: dict[int, np.ndarray] = field(default_factory=dict)  # by length, rising

    def add(self, item_id: int, text: str | None) -> None:
        words, lengths = hashed_words(text, plain=True)
        n = len(words)
        if not n:
            return
        own = shingle_weights(words, lengths)
        print_ = int(fingerprints(words, np.zeros(1, dtype=np.int64), n)[0])
        self.by_length.setdefault(n, []).append(len(self.items))
        self.items.append((item_id, n, print_, own))
        fewest = max(1, int(np.ceil(self.threshold * sum(own.values()) / max(own.values()) - 1e-9)))
        self.least[n] = min(self.least.get(n, fewest), fewest)

    def seal(self) -> ItemIndex:
        by_size: dict[int, set] = {}
        for _, n, _, own in self.items:
            by_size.setdefault(min(n, SIZE), set()).update(own)
        self.shingles = {k: np.array(sorted(v), dtype=U) for k, v in by_size.items()}
        for n, members in self.by_length.items():
            self.own_shingles[n] = np.array(sorted(set().union(*[self.items[k][3] for k in members])), dtype=U)
            at = np.array(members)
            values = np.array([block_values(self.items[k][2]) for k in members])
            order = np.argsort(values, axis=0, kind="stable")
            self.blocks[n] = [(values[order[:, b], b], at[order[:, b]]) for b in range(BLOCKS)]
        return self

    def near(self, fingerprint: int, n: int) -> np.ndarray:
        """Items of n words of which a block differs in at most PER_BLOCK bits."""
        found = []
        for value, (values, items) in zip(block_values(fingerprint), self.blocks[n]):
            wanted = value ^ NEAR
            low, high = np.searchsorted(values, wanted), np.searchsorted(values, wanted, side="right")
            found += [items[i:j] for i, j in zip(low[low < high].tolist(), high[low < high].tolist())]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, text: str | None) -> list[tuple]:
        """(item_id, start word, words, similarity, Hamming distance) for every item that the text holds."""
        if not self.items or not text:
            return []
        words, lengths = hashed_words(text, plain=True)
        if not len(words):
            return []
        best: dict[int, tuple] = {}
        for size, known in self.shingles.items():
            if len(words) < size:
                continue
            shingles = shingle_hashes(words, size)
            at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            hit = known[at] == shingles
            if not hit.any():
                continue
            places = np.flatnonzero(hit)
            found = shingles[places]
            for n, fewest in self.least.items():
                if min(n, SIZE) != size or len(places) < fewest:
                    continue
                of_length = places[np.isin(found, self.own_shingles[n])]
                if len(of_length) < fewest:
                    continue
                if n > len(words):
                    self._compare_whole(words, lengths, n, best)
                    continue
                # a repeated shingle weighs as often as it stands, so positions bound the shared weight
                seen = np.searchsorted(of_length, np.arange(len(shingles) + 1))
                inside = seen[n - size + 1 :] - seen[: len(words) - n + 1]
                starts = np.flatnonzero(inside >= fewest)
                if len(starts):
                    self._compare(words, lengths, n, starts, best)
        return [(self.items[k][0], int(s), n, sim, d) for k, (sim, s, n, d) in sorted(best.items())]

    def _compare(self, words: np.ndarray, lengths: np.ndarray, n: int, starts: np.ndarray, best: dict[int, tuple]) -> None:
        low, high = int(starts[0]), int(starts[-1]) + n
        for start, found in zip(starts.tolist(), fingerprints(words[low:high], starts - low, n).tolist()):
            own = None
            for k in self.near(found, n).tolist():
                distance = (self.items[k][2] ^ found).bit_count()
                if distance > RADIUS:
                    continue
                if own is None:
                    own = shingle_weights(words[start : start + n], lengths[start : start + n])
                sim = similarity(self.items[k][3], own)
                if sim >= self.threshold and (k not in best or sim > best[k][0]):
                    best[k] = (sim, start, n, distance)

    def _compare_whole(self, words: np.ndarray, lengths: np.ndarray, n: int, best: dict[int, tuple]) -> None:
        own = shingle_weights(words, lengths)
        found = int(fingerprints(words, np.zeros(1, dtype=np.int64), len(words))[0])
        for k in self.by_length[n]:
            if own.keys().isdisjoint(self.items[k][3]):
                continue
            sim = similarity(self.items[k][3], own)
            if sim >= self.threshold:
                best[k] = (sim, 0, len(words), (self.items[k][2] ^ found).bit_count())


def item_parts(benchmark: DataFrame, item: str, text: str, threshold: float, part_bytes: int = PART_BYTES) -> Iterator[ItemIndex]:
    """Indexes of parts of the benchmark, each of about `part_bytes` of text."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t"))
    parts = max(1, -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // part_bytes))
    for part in range(parts):
        index = ItemIndex(threshold)
        own = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        for r in sorted(own.collect(), key=lambda r: (r["i"] is None, r["i"] or 0, r["t"] or "")):  # one part, of bounded size
            index.add(r["i"], r["t"])
        yield index.seal()


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, distance), a row for each document and item it holds."""
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in item_parts(benchmark, item, item_text, threshold):

        def run(texts: list, index: ItemIndex = index) -> tuple:
            rows = [(k, *m) for k, t in enumerate(texts) for m in index.matches(t)]
            number, *columns = zip(*rows) if rows else [[] for _ in range(6)]
            return number, columns

        part = map_texts(named, "text", ["doc_id"], "item_id long, start_word long, n_words int, similarity double, distance int", run)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    for index in item_parts(benchmark, item, item_text, threshold):
        docs = filter_texts(docs, text, lambda texts, index=index: [not index.matches(t) for t in texts])
    return docs
