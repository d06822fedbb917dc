"""Self-join of texts by the Jaccard similarity of their word n-grams, with Bayesian pruning.

1. Texts with equal shingle sets form a copy class; from here on a class counts once, however many
   copies it has.
2. Each class has `HASHES` MinHash values in `BANDS` bands of `ROWS`. Classes that share a band are
   candidates; a band's classes are tied to its least class, so that ties stay linear in the rows.
   At a similarity of 0.8 a pair shares no band with probability (1 - 0.8^5)^32, about 3e-6.
3. Connected ties form clusters. A cluster of over `BLOCK` classes is dealt into blocks, and each
   pair of blocks is a task of its own, so no task grows with a cluster. Small clusters are put together.
   Blocks and bundles are bounded in rows and in bytes of shingles, but for a single very long text.
4. A task compares MinHash values `STEP` at a time. After n values with m equal ones, the similarity
   has the posterior Beta(m + 1, n - m + 1); a pair whose probability of reaching the threshold is
   under `TOLERANCE` is dropped. The exact Jaccard similarity of the others decides. Tasks return
   counts and a spanning forest of the links, never the pairs.
5. Links form the near-duplicate classes.

Edge cases: a text without words (null, empty, blank) links to nothing and is its own class; a row
with null id has a null class and no links; an empty table gives no rows; very long texts are read whole;
columns of any name pass `one_of_each` untouched; rows that repeat an id with equal text are copies; a text
of fewer than five words has one shingle. Ids only name rows: the least id of a class names it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineshed.llm.graph import components
from lineshed.llm.textops import byte_batches, fresh, map_texts, mix64, shingle_hashes, word_hashes
from lineshed.session import materialize

SIZE = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 32
HASHES = ROWS * BANDS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512
BUNDLE = 2048
BYTES = 16 << 20
U = np.uint64
_factors = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) * U(2) + U(1)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingle hashes of a text, rising."""
    return np.unique(shingle_hashes(word_hashes(text), size))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits; the shingles must not be empty."""
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(out, ((shingles[k : k + 1024, None] * _factors) >> U(32)).min(axis=0), out=out)
    return out.astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of its values and number."""
    rows = values.reshape(BANDS, ROWS).astype(U)
    key = np.arange(1, BANDS + 1, dtype=U)
    for k in range(ROWS):
        key = mix64(key * U(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest equal values with which a pair stays a candidate.

    P(Beta(m + 1, n - m + 1) >= t) is the probability of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out.append(m)
                break
    return out


def similar_pairs(signatures: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similarity `threshold` or more. side: only pairs between False and True count."""
    left = np.arange(len(sets)) if side is None else np.flatnonzero(~side)
    right = left if side is None else np.flatnonzero(side)
    least = least_matches(threshold)
    equal = np.zeros((len(left), len(right)), dtype=np.int16)
    for k in range(STEP):
        equal += signatures[left, k][:, None] == signatures[right, k][None, :]
    candidate = equal >= least[0]
    if side is None:
        candidate = np.triu(candidate, 1)
    i, j = np.nonzero(candidate)
    matches = equal[i, j]
    a, b = left[i], right[j]
    for step in range(1, HASHES // STEP):
        if not len(a):
            return a, b
        part = slice(step * STEP, (step + 1) * STEP)
        for at in range(0, len(a), 65536):
            rows = slice(at, at + 65536)
            matches[rows] += (signatures[a[rows], part] == signatures[b[rows], part]).sum(axis=1, dtype=np.int16)
        keep = matches >= least[step]
        a, b, matches = a[keep], b[keep], matches[keep]
    size = np.array([len(s) for s in sets])
    shared = shared_counts(sets, a, b)
    union = size[a] + size[b] - shared
    keep = shared >= threshold * union - 1e-9
    return a[keep], b[keep]


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact size of the intersection for each index pair."""
    if len(a) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)
    rows = np.unique(np.concatenate([a, b]))
    place = np.zeros(len(sets), dtype=np.int64)
    place[rows] = np.arange(len(rows))
    values, column = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    shared = np.zeros((len(rows), len(rows)), dtype=np.float32)  # exact up to 2^24
    total = np.zeros((len(rows), len(rows)), dtype=np.int64)
    for start in range(0, len(values), 8192):
        cells = slice(*np.searchsorted(column, [start, start + 8192]))
        x = np.zeros((len(rows), 8192), dtype=np.float32)
        x[row[cells], column[cells] - start] = 1
        np.matmul(x, x.T, out=shared)
        total += shared.astype(np.int64)
    return total[place[a], place[b]]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each index is linked to, over any number of links."""
    label = np.arange(n)
    while len(a):  # least label of the neighbours, until nothing changes
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            break
    return label


def sign(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(doc_id, set_key, bands, n_shingles) for each row; the first two null for a text without words."""

    def run(texts: list) -> list:
        keys, bands, sizes = [], [], []
        for t in texts:
            s = shingle_set(t, size)
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            bands.append(band_keys(minhash(s)).view(np.int64) if len(s) else None)
            sizes.append(len(s))
        return [keys, bands, sizes]

    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(named, "text", ["doc_id"], "set_key binary, bands array<long>, n_shingles long", run)


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), rows in pdf.groupby(["cluster", "i", "j"], sort=False):
            if len(rows) < 2:
                continue
            rows = rows.drop_duplicates("cid").sort_values("cid")
            signatures = np.stack([np.frombuffer(s, dtype=np.uint32) for s in rows["signature"]])
            sets = [np.frombuffer(s, dtype=U) for s in rows["shingles"]]
            side = None if i == j else rows["part"].to_numpy() == j
            a, b = similar_pairs(signatures, sets, side, threshold)
            if not len(a):
                continue
            cid, copies = rows["cid"].to_numpy(), rows["copies"].to_numpy(dtype=np.float64)
            n = len(cid)
            classes = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            linked = np.bincount(a, copies[b], minlength=n) + np.bincount(b, copies[a], minlength=n)
            got = classes > 0
            out.append(pd.DataFrame({"cid": cid[got], "root": cid[forest(n, a, b)][got], "classes": classes[got], "linked": linked[got].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("cid", "root", "classes", "linked")})

    return run


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs.

    doc_id; class_id, the least id of the near-duplicate class; copy_id, the least id of the rows with
    the same shingle set; n_copies, how many these are; n_links, how many other rows have a similarity of
    `threshold` or more; n_class_links, how many other copy classes have.
    """
    signed = materialize(sign(docs, text, key, size), "signed")
    named = signed.filter("doc_id is not null and set_key is not null")
    classes = materialize(
        named.groupBy("set_key")
        .agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    banded = classes.select("cid", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("cid").alias("head")).filter("n > 1")
    ties = banded.join(shared, "band").filter("cid != head").select("cid", "head")
    found = components(ties, "cid", "head").withColumnsRenamed({"node": "cid", "component": "cluster"})
    clusters = materialize(found.join(classes.select("cid", "n_shingles"), "cid"), "clusters")
    n, held = F.count("*"), (HASHES * 4 + 8) * F.count("*") + 8 * F.sum("n_shingles")
    parts = clusters.groupBy("cluster").agg(F.ceil(F.greatest(n / BLOCK, held / BYTES)).cast("int").alias("parts"))
    members = clusters.drop("n_shingles").join(parts, "cluster").join(classes.select("cid", "set_key", "copy_id", "copies"), "cid")
    all_of = clusters.agg(n.alias("n"), held.alias("held")).first()
    bundles = max(1, all_of["n"] // BUNDLE, (all_of["held"] or 0) // BYTES)

    def payload(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in byte_batches(frames, "t"):
            signatures, sets, right = [], [], []
            for t, own in zip(pdf["t"], pdf["set_key"]):
                s = shingle_set(t, size)
                right.append(len(s) > 0 and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(own))
                signatures.append(minhash(s).tobytes() if right[-1] else b"")
                sets.append(s.tobytes())
            pdf = pdf.assign(signature=signatures, shingles=sets)[right]  # an id may stand for several texts
            yield pdf.drop(columns=["t", "set_key"])

    texts = docs.select(F.col(key).alias("copy_id"), F.col(text).alias("t"))
    loaded = (
        texts.join(members, "copy_id")
        .select("cid", "cluster", "parts", "copies", "set_key", "t")
        .mapInPandas(payload, "cid long, cluster long, parts int, copies long, signature binary, shingles binary")
    )
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).otherwise(F.lit(0))
    tasks = (
        loaded.withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .withColumn("task", F.when(F.col("parts") > 1, F.xxhash64("cluster", "i", "j")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(bundles))))
        .drop("other", "parts")
    )
    found = materialize(tasks.groupBy("task").applyInPandas(_verify(threshold), "cid long, root long, classes long, linked long"), "found")
    links = found.groupBy("cid").agg(F.sum("classes").alias("classes"), F.sum("linked").alias("linked"))
    groups = components(found, "cid", "root")
    grouped = groups.select(F.col("node").alias("cid"), F.col("component").alias("grp"))
    named_groups = grouped.join(classes.select("cid", "copy_id"), "cid").groupBy("grp").agg(F.min("copy_id").alias("class_id"))
    labels = grouped.join(named_groups, "grp").join(links, "cid", "left").select("cid", "class_id", "classes", "linked")
    result = materialize(
        classes.select("set_key", "cid", "copy_id", "copies")
        .join(labels, "cid", "left")
        .select("set_key", "copy_id", "copies", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("linked", F.lit(0)).alias("linked")),
        "result",
    )
    rows = named.select("doc_id", "set_key").join(result, "set_key")
    alone = signed.filter("doc_id is null or set_key is null").select("doc_id")  # not joined: they share the null key
    return rows.select(
        "doc_id",
        "class_id",
        "copy_id",
        F.col("copies").alias("n_copies"),
        (F.col("copies") - 1 + F.col("linked")).alias("n_links"),
        F.col("classes").alias("n_class_links"),
    ).unionByName(
        alone.select(
            "doc_id",
            F.col("doc_id").alias("class_id"),
            F.col("doc_id").alias("copy_id"),
            F.lit(1).cast("long").alias("n_copies"),
            F.lit(0).cast("long").alias("n_links"),
            F.lit(0).cast("long").alias("n_class_links"),
        )
    )


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are the first of their near-duplicate class; rows with null id stay.

    Of rows that repeat an id with equal text one stays.
    """
    first = near_duplicates(docs, text, key, size, threshold).filter("doc_id = class_id").select(F.col("doc_id").alias(key)).distinct()
    again = Window.partitionBy(key, F.sha2(F.col(text).cast("binary"), 256)).orderBy(key)
    number = fresh("__again", docs.columns)
    kept = docs.filter(F.col(key).isNotNull()).join(first, key, "left_semi").withColumn(number, F.row_number().over(again)).filter(F.col(number) == 1)
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))
