"""N-gram Jaccard join and benchmark decontamination."""

import random

import numpy as np
import pytest

pytest.importorskip("lineshed.llm")
from lineshed.llm import decontaminate, graph, jaccard_join  # noqa: E402
from lineshed.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (class_id, n_links) by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in sets}


def near_copies(seed=2, families=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    rows, n = [], 0
    for family in range(families):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 40, 200]))
        for _ in range(rng.choice([1, 2, 5, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "   "), (n + 3, "one"), (n + 4, "One")]
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_join_is_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies()
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(rows)


def test_jaccard_join_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op7_ngram_jaccard_join"](spark, SF).collect()}
    assert got == want


def test_jaccard_join_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "x"), (4, "X")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, bands int")
    got = sorted((tuple(r)[:2] + (r["n_links"],) for r in jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, None, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1)], key=str)
    kept = jaccard_join.one_of_each(docs).select("doc_id").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "None"]
    assert jaccard_join.near_duplicates(docs.filter("false")).count() == 0


def test_pruning_keeps_the_threshold():
    least = jaccard_join.least_matches()
    assert least == sorted(least) and 0 < least[0] < 12 and least[-1] < 128
    rng = np.random.default_rng(0)
    for n, m in zip(range(16, 161, 16), least):
        assert (rng.binomial(n, 0.8, 200_000) < m).mean() < 1e-4


def test_shared_counts_both_ways():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    a, b = np.triu_indices(12, 1)
    want = [len(set(sets[x].tolist()) & set(sets[y].tolist())) for x, y in zip(a, b)]
    assert jaccard_join.shared_counts(sets, a, b).tolist() == want
    assert jaccard_join.shared_counts(sets, a[:5], b[:5]).tolist() == want[:5]


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 103), (102, 103), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys([100, 101, 102, 103], 100)}


def test_fingerprints_and_blocks():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    got = decontaminate.fingerprints(words, np.array([0, 7]), 20)
    for start, value in zip([0, 7], got.tolist()):
        want = 0
        for bit in range(64):
            ones = sum(int(w) >> bit & 1 for w in words[start : start + 20])
            want |= (ones > 10) << bit
        assert value == want
    for _ in range(500):
        a = rng.integers(0, 1 << 63).item()
        b = a
        for bit in rng.choice(64, decontaminate.RADIUS, replace=False):
            b ^= 1 << int(bit)
        near = [(x ^ y).bit_count() <= decontaminate.PER_BLOCK for x, y in zip(decontaminate.block_values(a), decontaminate.block_values(b))]
        assert any(near) and len(near) == 4


def test_index_finds_all_within_the_radius_and_few_others():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 400).tolist()
    index = decontaminate.ItemIndex()
    index.items = [(k, 20, f, {}) for k, f in enumerate(prints)]
    index.by_length = {20: list(range(400))}
    index.seal()
    met = 0
    for f in prints[:60]:
        for bit in rng.choice(64, rng.integers(0, 40), replace=False):
            f ^= 1 << int(bit)
        got = set(index.near(f, 20).tolist())
        assert got == {k for k, g in enumerate(prints) if any((x ^ y).bit_count() <= 3 for x, y in zip(decontaminate.block_values(f), decontaminate.block_values(g)))}
        assert {k for k, g in enumerate(prints) if (f ^ g).bit_count() <= decontaminate.RADIUS} <= got
        met += len(got)
    assert met / 60 / 400 < 0.08


def brute_contamination(text, items):
    """All windows; those that share no shingle with an item have a similarity of 0."""
    from lineshed.llm.textops import hashed_words, shingle_hashes

    words, lengths = hashed_words(text, plain=True)
    out = {}
    for item, body in items:
        w, n = hashed_words(body, plain=True)
        if not len(w) or not len(words):
            continue
        own = decontaminate.shingle_weights(w, n)
        size = min(len(w), len(words))
        hits = np.flatnonzero(np.isin(shingle_hashes(words, min(len(w), decontaminate.SIZE)), np.array(list(own), dtype=np.uint64)))
        starts = sorted({k for h in hits.tolist() for k in range(max(0, h - size), min(h, len(words) - size) + 1)})
        sims = [(decontaminate.similarity(own, decontaminate.shingle_weights(words[k : k + size], lengths[k : k + size])), -k) for k in starts]
        if sims and max(sims)[0] >= 0.8:
            out[item] = (-max(sims)[1], round(max(sims)[0], 9))
    return out


def test_decontamination_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {}
    for r in QUERIES["op8_benchmark_decontamination"](spark, SF).collect():
        got.setdefault(r["doc_id"], {})[r["item_id"]] = (r["start_word"], round(r["similarity"], 9))
    for r in docs.collect():
        assert got.get(r["doc_id"], {}) == brute_contamination(r["text"], items)
    assert got


def test_benchmark_parts_and_odd_columns(spark):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(30)] + [(3, " ".join(f"w3x{j}" for j in range(20)))], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20)), "x") for k in range(40)] + [(None, None, "y"), (5, "", "z")], "doc_id long, text string, __text string")
    parts = list(decontaminate.item_parts(items, "item_id", "text", 0.8, 500))
    assert len(parts) > 3 and sum(len(p.items) for p in parts) == 31
    assert sorted((r["doc_id"] or -1, r["__text"]) for r in decontaminate.clean(docs, items).collect()) == [(-1, "y"), (5, "z"), *[(k, "x") for k in range(30, 40)]]
    assert decontaminate.clean(docs.filter("false"), items).count() == 0


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"term{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 20, 60])))) for k in range(30)] + [(90, None), (91, ""), (92, "!!")]
    docs = []
    for k in range(60):
        words = rng.choices(vocabulary, k=80)
        passage = items[k % 30][1].split()
        for _ in range(k % 3):
            passage[rng.randrange(len(passage))] = "changed"
        at = rng.randrange(80)
        docs.append((k, " ".join(words[:at]) + "\n" + ", ".join(passage).upper() + ". " + " ".join(words[at:])))
    docs += [(100, None), (101, ""), (None, items[1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.find(frame, bench).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert got == {d: set(m) for d, t in docs if (m := brute_contamination(t, items))}
    kept = {r["doc_id"] for r in decontaminate.clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - set(got)
    assert decontaminate.find(frame, bench.filter("false")).count() == 0


def test_decontamination_finds_items_cut_short(spark):
    rng = random.Random(5)
    words = [[f"term{rng.randrange(300)}" for _ in range(n)] for n in (16, 30, 60)]
    items = [(k, " ".join(w)) for k, w in enumerate(words)]
    docs = [(100 * k + cut, " ".join(w[:-cut])) for k, w in enumerate(words) for cut in (1, 2, 12)] + [(1000 + k, " ".join(w[1:])) for k, w in enumerate(words)]
    want = set()
    for d, t in docs:
        shorter = decontaminate.shingle_weights(*decontaminate.hashed_words(t, plain=True))
        want |= {(d, k) for k, body in items if decontaminate.similarity(shorter, decontaminate.shingle_weights(*decontaminate.hashed_words(body, plain=True))) >= 0.8}
    assert {(100 * k + 1, k) for k in range(3)} <= want and len(want) < len(docs)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["start_word"] == 0 and r["n_words"] < len(words[r["item_id"]]) for r in got)
    assert {r["doc_id"] for r in decontaminate.clean(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
