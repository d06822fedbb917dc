"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineshed.llm import decontaminate, html_text, jaccard_join, language_id, license_scan, media_ts, packing, quality_lm, token_counts, url_filter
from lineshed.session import materialize, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: By brute force over all pairs that share a shingle, and their transitive closure.
ORACLES: dict[str, str] = {
    "op7_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
copies AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(b), d.doc_id)) AS copy_id, count(b) + 1 AS n_copies FROM documents d LEFT JOIN l ON a = d.doc_id AND same GROUP BY d.doc_id),
links AS (SELECT a, count(*) AS n_links, count(DISTINCT CASE WHEN NOT same THEN copy_id END) AS n_class_links FROM l JOIN copies ON copies.doc_id = b GROUP BY a),
classes AS (SELECT a, min(b) AS least_id FROM r GROUP BY a)
SELECT c.doc_id, least(c.doc_id, coalesce(least_id, c.doc_id)) AS class_id, copy_id, n_copies, coalesce(n_links, 0) AS n_links, coalesce(n_class_links, 0) AS n_class_links
FROM copies c LEFT JOIN links k ON k.a = c.doc_id LEFT JOIN classes z ON z.a = c.doc_id""",
}
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"
BATCH_ROWS = 1000
#: Notices of 5 to 40 words are one segment each. A shingle at a position lies in the windows that start at
#: the multiples of the step from size - 5 words before it up to it.
ORACLES["op4_license_scan"] = (
    r"""WITH t(template_id, license, template) AS (VALUES """
    + ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(license_scan.NOTICES))
    + r"""),
tw AS (SELECT template_id, license, list_filter(string_split_regex(lower(template), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t),
ts AS (SELECT template_id, license, len(w) AS m, 1 + (len(w) - 4) // 4 AS step, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM tw),
own AS (SELECT template_id, count(*) AS n FROM ts GROUP BY template_id),
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g, unnest(range(0, len(w) - 4)) AS p FROM dw WHERE len(w) >= 5),
h AS (SELECT doc_id, p, ds.g, template_id, license, step, m + step - 1 AS size FROM ds JOIN ts ON ds.g = ts.g),
x AS (SELECT doc_id, template_id, license, g, unnest(range(greatest(0, (p - size + 5 + step - 1) // step), p // step + 1)) * step AS start FROM h),
v AS (SELECT doc_id, template_id, license, start, count(DISTINCT g) AS c FROM x GROUP BY ALL),
f AS (SELECT doc_id, v.template_id, license, start, c / n AS share FROM v JOIN own ON own.template_id = v.template_id WHERE c / n >= 0.8)
SELECT doc_id, template_id::BIGINT AS template_id, license, max(share) AS containment, min(start)::BIGINT AS start_word, count(DISTINCT start) AS n_windows FROM f GROUP BY doc_id, template_id, license"""
)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers f under its name. Texts are long, so Arrow batches are kept small."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = language_id.fit(docs.filter(f"not {HELD_OUT}"))
    return language_id.predict(docs, profiles).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


@query
def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media_ts.store(read(spark, sf_dir, "documents")), "media")  # what is probed is what was stored
    return media_ts.probe(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_points"
    )


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    pieces = packing.tokenize(docs, tokenizer_path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, docs.count()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"), license_scan.notices(spark))


# The rules of this query's contract: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rules = url_filter.mine(url_filter.labelled_urls(pages, read(spark, sf_dir, "labels")))
    return url_filter.judge(pages, rules, URL_RULES)
