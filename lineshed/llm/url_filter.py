"""URL filtering by association rules between URL tokens and labels.

A URL's tokens and its label form a transaction. Tokens that always stand together count as one, the
shortest of them, and those in every URL or in too few are left out, as no rule of theirs could stay; so
the mining isn't swamped by hosts that always bring their parts. FP-growth then finds the token
combinations that hold at least `SUPPORT` of the labelled URLs, and `LEAST` of them; a rule
`tokens => verdict` stays if its confidence and lift reach their bounds and no rule of fewer of its tokens
with the same verdict is as confident. The number of rules depends on the support and on the tokens of a
URL, not on how many URLs there are. An inverted index lists each rule under its rarest token, so that a URL
meets only rules whose rarest token it has. Of the fitting rules the most confident decides, then the best
supported, then the shortest, then the first by name; without any the URL is allowed.

Given rules (host, path, verdict) come first: a rule fits its host and all subdomains if the path
starts with the rule's; the longest wins, of equally long ones the last by name.

Edge cases: a null URL or one without `://` has an empty host and path, no tokens,
and is allowed unless a rule fits; very long URLs keep their whole tokens; repeated URLs have equal verdicts;
labels that are null, of unknown ids or repeated do no harm; without labels nothing is mined; an empty table
of pages gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineshed.session import materialize

SUPPORT = 0.005
LEAST = 20
CONFIDENCE = 0.6
LIFT = 1.1
VERDICTS = ("allow", "block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and tokens."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    parts = pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("__rest", "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract("__rest", "^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract("__rest", "^[^?#]*[?]([^#]*)", 1)
    parts = parts.withColumns({"host": host, "path": path, "__query": query})

    def named(prefix: str, items):
        return F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))

    labels = F.split("host", "[.]")
    tokens = F.concat(
        named("scheme:", F.array(F.coalesce(F.when(at > 0, F.lower(F.expr(f"substring(`{url}`, 1, instr(`{url}`, '://') - 1)"))), F.lit("")))),
        named("host:", F.array("host")),
        named("label:", F.flatten(F.transform(labels, lambda x: F.split(x, "-")))),
        named("path:", F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "0"), "[/._-]")),
        named("key:", F.transform(F.split("__query", "&"), lambda x: F.lower(F.substring_index(x, "=", 1)))),
        named("mark:", F.array(F.when(F.col("__rest").contains("#"), F.lit("fragment")).otherwise(F.lit("")))),
    )
    return parts.withColumn("tokens", F.array_distinct(tokens)).drop("__rest", "__query")


def condensed(labelled: DataFrame, least: float) -> DataFrame:
    """Rows (items, verdict): of tokens that always stand together the shortest, without those in all rows or in under `least`."""
    numbered = labelled.withColumn("__row", F.xxhash64(F.monotonically_increasing_id()))
    found = (
        numbered.select("__row", F.explode(F.array_distinct("tokens")).alias("t"))
        .groupBy("t")
        .agg(F.count("*").alias("n"), F.bit_xor("__row").alias("x"), F.sum(F.col("__row").cast("decimal(20,0)")).alias("s"))
        .filter((F.col("n") >= least) & (F.col("n") < labelled.count()))
    )
    names = [r["t"] for r in found.groupBy("n", "x", "s").agg(F.min_by("t", F.struct(F.length("t"), "t")).alias("t")).collect()]  # at most (tokens of a URL) / support
    wanted = F.array(*[F.lit(t) for t in sorted(names)]).cast("array<string>")
    return labelled.select(F.array_intersect("tokens", wanted).alias("items"), "verdict")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least: int = LEAST) -> list[tuple]:
    """Rules (tokens, verdict, confidence, support) from rows (tokens, verdict)."""
    labelled = materialize(labelled, "labelled")
    n = labelled.count()
    if n < least:
        return []
    support = max(support, least / n)
    baskets = condensed(labelled, support * n).select(F.array_append("items", F.concat(F.lit("="), F.col("verdict"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(materialize(baskets, "baskets")).associationRules
    verdicts = [f"={v}" for v in VERDICTS]
    rows = (
        found.filter((F.size("consequent") == 1) & F.col("consequent")[0].isin(verdicts) & (F.col("lift") >= lift))
        .filter(~F.exists("antecedent", lambda x: x.isin(verdicts)))
        .select(F.sort_array("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), "confidence", "support")
        .collect()  # at most (token combinations of a URL) / support rules
    )
    return pruned((tuple(r["tokens"]), r["verdict"], r["confidence"], r["support"]) for r in rows)


def pruned(rules: Iterable[tuple]) -> list[tuple]:
    """The rules without those that have a rule of fewer of their tokens, with the same verdict and as confident."""
    kept: dict[str, dict[frozenset, tuple]] = {}
    holding: dict[tuple[str, str], list[frozenset]] = {}
    for r in sorted(rules, key=lambda r: (len(r[0]), r[0], r[1])):
        own, verdict = frozenset(r[0]), r[1]
        smaller = {s for t in own for s in holding.get((verdict, t), ()) if s < own}
        if not any(kept[verdict][s][2] >= r[2] for s in smaller):
            kept.setdefault(verdict, {})[own] = r
            for t in own:
                holding.setdefault((verdict, t), []).append(own)
    return [r for held in kept.values() for r in held.values()]


def rule_index(rules: Sequence[tuple]) -> dict[str, list[tuple]]:
    """Rules by the token that the fewest rules have; each as (rank, token set, verdict, name, confidence)."""
    often: dict[str, int] = {}
    for tokens, *_ in rules:
        for t in tokens:
            often[t] = often.get(t, 0) + 1
    index: dict[str, list[tuple]] = {}
    for tokens, verdict, confidence, support in rules:
        name = " & ".join(tokens)
        pivot = min(tokens, key=lambda t: (often[t], t))
        index.setdefault(pivot, []).append(((-confidence, -support, len(tokens), name), frozenset(tokens), verdict, name, confidence))
    for held in index.values():
        held.sort(key=lambda r: r[0])
    return index


def given_rule(rules: Sequence[tuple[str, str, str]]):
    """The longest fitting rule of (host, path, verdict) as a struct (length, rule, verdict), or null."""
    fits = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path),
            F.struct(F.lit(len(host + path)).alias("length"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for host, path, verdict in rules
    ]
    none = F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    return F.greatest(none, none, *fits)


def judge(pages: DataFrame, rules: Sequence[tuple], given: Sequence[tuple[str, str, str]] = (), key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) for every row."""
    index = rule_index(rules)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            verdicts, names, confidences = [], [], []
            for tokens in pdf["tokens"]:
                have = set(tokens)
                best = None
                for t in have:
                    for rule in index.get(t, ()):
                        if best is not None and rule[0] >= best[0]:
                            break  # the rest of this list ranks lower
                        if rule[1] <= have:
                            best = rule
                            break
                verdicts.append(best[2] if best else "allow")
                names.append(best[3] if best else None)
                confidences.append(best[4] if best else None)
            yield pdf.drop(columns="tokens").assign(mined=verdicts, mined_rule=names, confidence=pd.array(confidences, dtype="Float64"))

    parts = with_parts(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))).select("page_id", "host", "path", "tokens")
    kind = parts.schema["page_id"].dataType.simpleString()
    judged = parts.mapInPandas(run, f"page_id {kind}, host string, path string, mined string, mined_rule string, confidence double")
    own = judged.withColumn("__given", given_rule(given))
    return own.select(
        "page_id", "host", "path", F.col("__given.rule").alias("rule"), F.coalesce(F.col("__given.verdict"), F.col("mined")).alias("verdict"), "mined_rule", "confidence"
    )


def labelled_urls(pages: DataFrame, labels: DataFrame, page_key: str = "page_id", label_key: str = "doc_id", url: str = "url") -> DataFrame:
    """(tokens, verdict) of the pages whose id has a label: block if of low quality or toxic."""
    verdict = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit("block")).when(F.col("quality").isNotNull(), F.lit("allow"))
    known = labels.select(F.col(label_key).alias("__key"), verdict.alias("verdict")).filter("verdict is not null")
    return with_parts(pages.select(F.col(page_key).alias("__key"), F.col(url).alias("url"))).join(known, "__key").select("tokens", "verdict")
