"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest

pytest.importorskip("lineshed.llm")
from pyspark.sql import functions as F  # noqa: E402

from lineshed.llm import decontaminate, jaccard_join, language_id, license_scan, media_ts, quality_lm, token_counts, url_filter  # noqa: E402
from lineshed.llm.queries import tokenizer_path  # noqa: E402

WORDS = "the quick brown fox jumps over the lazy dog while many small birds sing in green trees near cold water".split()
LONG = " ".join(WORDS[(k * 7 + k // 5) % len(WORDS)] + str(k % 91) for k in range(60_000))
TEXT = "Released under the MIT License. " + " ".join(WORDS * 3)


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that share names with what the operators use inside or add."""
    rows = [(1, TEXT, "en"), (1, TEXT, "en"), (2, TEXT, "en"), (3, None, "en"), (4, "", None), (5, "   ", "en"), (None, TEXT, "fr"), (None, None, None), (6, LONG, "en"), (7, "x", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return frame.withColumns({n: F.lit(n) for n in ("__text", "lang_pred", "n_tokens", "media", "__row", "__again", "row", "g", "block", "shard", "band", "w", "perplexity")}).cache()


def test_language_id(docs):
    p = language_id.fit(docs)
    got = language_id.predict(docs, p, keep=("doc_id", "__text")).collect()
    assert len(got) == 10 and {r["__text"] for r in got} == {"__text"}
    same = {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    tied = language_id.Profiles(["a", "b"], p.prototypes[[0, 0]])
    assert tied.score([TEXT])[0] == ["a"]
    kept = language_id.keep_known(docs, p, 0.05, 10)
    assert kept.columns == docs.columns and all(r["__text"] == "__text" for r in kept.collect())
    none = docs.filter("false")
    assert language_id.predict(none, language_id.fit(none)).count() == 0 and language_id.keep_known(none, p, 0.1, 10).count() == 0


def test_token_counts(docs):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    got = token_counts.token_counts(docs, path, keep=("doc_id", "g", "__text")).collect()
    n = {r["doc_id"]: r["n_tokens"] for r in got}
    assert n[1] == n[2] > 50 and n[3] == n[4] == n[5] == 0 and n[6] > 60_000 and {r["g"] for r in got} == {"g"}
    assert token_counts.token_counts(docs.filter("false"), path).count() == 0


def test_media_columns(docs):
    got = media_ts.probe(media_ts.store(docs, keep=("doc_id", "block", "__text"))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[1]["media_sha256"] == by[2]["media_sha256"] and by[3]["payload_bytes"] == 64
    assert by[6]["n_bytes"] == len(LONG) and {r["block"] for r in got} == {"block"}
    assert media_ts.probe(media_ts.store(docs.filter("false"))).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_lm.judge(docs, labels).collect()
    assert len(got) == 10 and len({r["perplexity"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert {r["kept"] for r in got if r["perplexity"] is None} == {False}
    tied = spark.createDataFrame([(1, 5.0, 10), (2, 5.0, 10), (3, None, 0)], "doc_id long, perplexity double, chars long").withColumn("lang", F.lit("x"))
    bound = quality_lm.thresholds(tied, 1.0, 1.0).filter("not everything").first()["threshold"]
    assert bound * 1.001 >= 5.0 / 2.718281828 ** (2 / 10**0.5) and quality_lm.thresholds(tied.filter("false")).count() == 0
    kept = quality_lm.keep(docs, labels)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and kept.filter("doc_id = 1").count() == 2


def test_near_duplicates(docs):
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert got[1]["class_id"] == got[2]["class_id"] == 1 and got[1]["n_copies"] == 3 and got[6]["n_links"] == 0 and got[3]["class_id"] == 3
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7]
    assert jaccard_join.near_duplicates(docs.filter("false")).count() == 0 and jaccard_join.one_of_each(docs.filter("false")).count() == 0


def test_licenses(spark, docs):
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs, license_scan.notices(spark)).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (None, "MIT")}


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, " ".join(WORDS)), (2, " ".join(WORDS)), (None, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items).collect()} == {(d, i) for d in (1, 2, None) for i in (1, 2)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7]


def test_urls(spark):
    urls = ["http://a.org/" + "x" * 100_000, "http://a.org/y", "http://a.org/y", None, "", "no scheme"]
    pages = spark.createDataFrame([(k if k != 4 else None, u, "t") for k, u in enumerate(urls)], "page_id long, url string, tokens string").withColumn("host", F.lit("h"))
    rules = [(("host:a.org",), "block", 0.9, 0.5), (("label:a",), "allow", 0.9, 0.5)]  # a tie: the first by name decides
    got = url_filter.judge(pages, rules, [("org", "/x", "allow")]).collect()
    assert [r["verdict"] for r in sorted(got, key=lambda r: (r["page_id"] is None, r["page_id"]))] == ["allow", "block", "block", "allow", "allow", "allow"]
    assert url_filter.judge(pages.filter("false"), rules).count() == 0
