"""Queries of reference tables, derivatives, likelihoods, space-filling curves and exact samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineshed.functions import codec, lineshape, scores
from lineshed.operators import reference
from lineshed.plans.registry import query
from lineshed.session import read


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'small g')")
def compound_search(spark: SparkSession, d: str) -> DataFrame:
    return reference.search(read(spark, d, "part").select("p_partkey", "p_name"), "p_name", "SMALL G")


@query(
    """WITH b AS (SELECT p_brand, avg(p_size) AS size, avg(p_retailprice) AS price FROM part GROUP BY 1)
    SELECT round(avg(size), 6) AS mean_size, round(avg(price), 6) AS mean_price, round(max(CASE WHEN p_brand = 'Brand#11' THEN size END), 6) AS stored_size FROM b"""
)
def compound_average(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
    means = reference.average_row(b, "p_brand", ["size", "price"], stored="none of these")
    stored = reference.average_row(b, "p_brand", ["size"], stored="Brand#11").select(F.col("size").alias("stored"))
    both = means.crossJoin(F.broadcast(stored))  # one row each
    own = F.when(F.lit(b.filter("p_brand = 'Brand#11'").count() > 0), F.col("stored"))
    return both.select(F.round("size", 6).alias("mean_size"), F.round("price", 6).alias("mean_price"), F.round(own, 6).alias("stored_size"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN p_retailprice END AS p_retailprice, p_size % 10 = 0 AS withheld FROM part"""
)
def withheld_cells(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    cells = p.filter("p_size % 10 = 0").select("p_partkey", "p_retailprice")
    return reference.withhold(p, cells, ["p_partkey"], "p_retailprice").select("p_partkey", "p_retailprice", "withheld")


_LINES = "SELECT p_brand AS element, CASE p_size % 5 WHEN 0 THEN '1s' WHEN 1 THEN '2p1/2' WHEN 2 THEN '2p3/2' WHEN 3 THEN '3d3/2' ELSE '3d5/2' END AS orbital, avg(p_retailprice) AS binding_energy FROM part GROUP BY ALL"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    orbitals = F.array(*[F.lit(x) for x in ("1s", "2p1/2", "2p3/2", "3d3/2", "3d5/2")])
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("element"), F.element_at(orbitals, (F.col("p_size") % 5 + 1).cast("int")).alias("orbital")).agg(F.avg("p_retailprice").alias("binding_energy"))


@query(
    f"""WITH l AS ({_LINES}), s AS (SELECT element, substr(orbital, 1, 2) AS shell, max(CASE WHEN orbital IN ('2p1/2', '3d3/2') THEN binding_energy END) AS a,
      max(CASE WHEN orbital IN ('2p3/2', '3d5/2') THEN binding_energy END) AS b FROM l GROUP BY ALL)
    SELECT element, shell, round(CASE WHEN shell = '1s' THEN 0.0::DOUBLE ELSE abs(a - b) END, 6) AS split FROM s"""
)
def spin_orbit_split(spark: SparkSession, d: str) -> DataFrame:
    return reference.spin_orbit_split(_lines(spark, d)).select("element", "shell", F.round("split", 6).alias("split"))


@query(
    """WITH t AS (SELECT p_brand AS b, sum(p_retailprice) AS v FROM part GROUP BY 1), p AS (SELECT x.b AS element, y.b AS element_2, x.v AS v1, y.v AS v2 FROM t x JOIN t y ON x.b < y.b)
    SELECT element, element_2, round(v1 / v2, 8) AS ratio, 'tabulated' AS status_1, 'tabulated' AS status_2 FROM p"""
)
def sensitivity_ratio(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "part").groupBy(F.col("p_brand").alias("element")).agg(F.sum("p_retailprice").alias("cross_section")).select("element", F.lit("1s").alias("orbital"), F.lit(1000.0).alias("energy"), "cross_section")
    one, two = table.select("element", "orbital"), table.select(F.col("element").alias("element_2"), F.col("orbital").alias("orbital_2"))
    pairs = one.join(two, F.col("element") < F.col("element_2")).withColumn("photon_energy", F.lit(1000.0))  # brands are a fixed list
    return reference.sensitivity_ratio(pairs, table).select("element", "element_2", F.round("ratio", 8).alias("ratio"), "status_1", "status_2")


@query("""SELECT p_partkey, substr(md5('{"p0":' || p_size || ',"p1":"' || p_brand || '"}'), 1, 12) AS cache_key FROM part""")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", reference.cache_key(F.col("p_size"), F.col("p_brand")).alias("cache_key"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 200")
def sample_exactly(spark: SparkSession, d: str) -> DataFrame:
    return reference.sample_exactly(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 200, seed=7)


_W = 4.5
_G = f"(2.3548200450309493 / ({_W} * sqrt(2 * pi())) * exp(-4 * ln(2) * x * x / ({_W} * {_W})))"
_L = f"({_W} / (2 * pi()) / (x * x + {_W} * {_W} / 4))"


@query(
    f"""WITH p AS (SELECT p_partkey, (p_size - 25)::DOUBLE AS x FROM part)
    SELECT p_partkey, round(0.3 * {_L} + 0.7 * {_G}, 9) AS value,
      round(0.3 * {_L} * 2 * x / (x * x + {_W} * {_W} / 4) + 0.7 * {_G} * 8 * ln(2) * x / ({_W} * {_W}), 9) AS by_center,
      round(0.3 * {_L} * (1.0::DOUBLE / {_W} - {_W} / 2.0::DOUBLE / (x * x + {_W} * {_W} / 4)) + 0.7 * {_G} * (8 * ln(2) * x * x / pow({_W}, 3) - 1.0::DOUBLE / {_W}), 9) AS by_width,
      round({_L} - {_G}, 9) AS by_share FROM p"""
)
def pseudo_voigt_derivatives(spark: SparkSession, d: str) -> DataFrame:
    got = lineshape.pseudo_voigt_derivatives("p_size", 25.0, _W, 0.3)
    return read(spark, d, "part").select("p_partkey", *[F.round(v, 9).alias(n) for v, n in zip(got, ("value", "by_center", "by_width", "by_share"))])


@query(
    """WITH p AS (SELECT p_partkey, (p_size - 25) / (8.617333262e-5 * 30000) AS t FROM part), f AS (SELECT p_partkey, t, 1 / (1 + exp(t)) AS f FROM p)
    SELECT p_partkey, round(f * (1 - f) / (8.617333262e-5 * 30000), 9) AS by_edge, round(f * (1 - f) * t / 30000, 12) AS by_temperature FROM f"""
)
def edge_derivatives(spark: SparkSession, d: str) -> DataFrame:
    _, by_edge, by_temperature = lineshape.fermi_edge_derivatives("p_size", 25.0, 30000.0)
    return read(spark, d, "part").select("p_partkey", F.round(by_edge, 9).alias("by_edge"), F.round(by_temperature, 12).alias("by_temperature"))


@query(
    """WITH m AS (SELECT p_brand, avg(p_size) AS mu FROM part GROUP BY 1), l AS (SELECT p_brand, sum(p_size * ln(mu) - mu - lgamma(p_size + 1.0::DOUBLE)) AS l, count(*) AS n FROM part JOIN m USING (p_brand) GROUP BY 1)
    SELECT p_brand, round(l, 6) AS log_likelihood, round(2 - 2 * l, 6) AS aic, round(ln(n) - 2 * l, 6) AS bic FROM l"""
)
def poisson_likelihood(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_brand", "p_size")
    means = p.groupBy("p_brand").agg(F.avg("p_size").alias("mu"))
    s = p.join(means, "p_brand").groupBy("p_brand").agg(F.sum(scores.poisson_log_likelihood_term("p_size", "mu")).alias("l"), F.count("*").alias("n"))
    return s.select("p_brand", F.round("l", 6).alias("log_likelihood"), F.round(scores.poisson_aic("l", 1), 6).alias("aic"), F.round(scores.poisson_bic("l", "n", 1), 6).alias("bic"))


@query(
    """WITH s AS (SELECT p_brand, p_type, sum(p_retailprice) AS bic, count(*) AS k FROM part GROUP BY ALL)
    SELECT p_brand, p_type, round(bic - min(bic) OVER (PARTITION BY p_brand), 6) AS delta, row_number() OVER (PARTITION BY p_brand ORDER BY bic, k) = 1 OR k = first(k) OVER (PARTITION BY p_brand ORDER BY bic, k) AS best FROM s"""
)
def best_k(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("bic"), F.count("*").alias("k"))
    return scores.best_k(s, ["p_brand"], "k", "bic").select("p_brand", "p_type", F.round("delta", 6).alias("delta"), "best")


@query(
    """SELECT p_partkey, round((p_retailprice - 1500) / p_size, 9) AS by_std, round((p_retailprice - 1500) / sqrt(p_size), 9) AS by_variance,
      round((p_size - 25) / sqrt(greatest(p_size, 1)), 9) AS by_counts FROM part"""
)
def whitened_residuals(spark: SparkSession, d: str) -> DataFrame:
    got = [scores.whitened("p_retailprice", 1500.0, "p_size", "std"), scores.whitened("p_retailprice", 1500.0, "p_size", "variance"), scores.whitened("p_size", 25.0, "p_size", "counts")]
    return read(spark, d, "part").select("p_partkey", *[F.round(v, 9).alias(n) for v, n in zip(got, ("by_std", "by_variance", "by_counts"))])


@query(
    """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, 2.0::DOUBLE AS b, 30.0::DOUBLE AS d, p_retailprice AS x FROM part), e AS (SELECT *, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b) AS low, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS high FROM p)
    SELECT p_partkey, CASE WHEN low > 0 THEN round(high / low, 5) END AS condition, CASE WHEN low > 0 THEN round(sqrt(x * d / (a * d - b * b)), 6) END AS sd_a,
      CASE WHEN low > 0 THEN round(sqrt(x * a / (a * d - b * b)), 6) END AS sd_b, CASE WHEN low > 0 THEN round(sqrt(x / low), 6) END AS sd_soft FROM e"""
)
def fit_quality(spark: SparkSession, d: str) -> DataFrame:
    condition, *sds = scores.fit_quality("p_retailprice", ("p_size", 2.0, 30.0))
    return read(spark, d, "part").select("p_partkey", F.round(condition, 5).alias("condition"), *[F.round(v, 6).alias(n) for v, n in zip(sds, ("sd_a", "sd_b", "sd_soft"))])


@query("SELECT p_partkey, (p_size % 32)::BIGINT AS x, (p_partkey % 32)::BIGINT AS y, (p_partkey // 32 % 32)::BIGINT AS z, (p_size % 32)::BIGINT AS x2, (p_partkey % 32)::BIGINT AS y2 FROM part")
def hilbert_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") % 32).cast("bigint").alias("x"), (F.col("p_partkey") % 32).alias("y"), F.floor(F.col("p_partkey") / 32).alias("t")).withColumn("z", F.col("t") % 32)
    cube = codec.hilbert_cell(codec.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 5), 5, 3)
    flat = codec.hilbert_cell(codec.hilbert_index([F.col("x"), F.col("y")], 5), 5, 2)
    return p.select("p_partkey", cube.alias("c"), flat.alias("f")).select("p_partkey", F.col("c.v0").alias("x"), F.col("c.v1").alias("y"), F.col("c.v2").alias("z"), F.col("f.v0").alias("x2"), F.col("f.v1").alias("y2"))


_SCALE = 1e4


@query(
    f"""WITH p AS (SELECT p_partkey, p_size, max(p_size) OVER () AS top FROM part)
    SELECT p_partkey, round(pow({_SCALE} / 100, 2) * p_size / top, 6) AS mean_counts, round(sqrt(pow({_SCALE} / 100, 2) * p_size / top), 6) AS snr FROM p"""
)
def noise_level_means(spark: SparkSession, d: str) -> DataFrame:
    from lineshed.functions import encode

    p = read(spark, d, "part").select("p_partkey", "p_size")
    top = p.agg(F.max("p_size").cast("double").alias("top"))  # one row
    mean = encode.poisson_mean(F.array(F.col("p_size").cast("double")), 100.0, F.col("top"))[0]
    return p.crossJoin(F.broadcast(top)).select("p_partkey", F.round(mean, 6).alias("mean_counts"), F.round(F.sqrt(mean), 6).alias("snr"))


@query(
    """WITH c AS (SELECT l_orderkey AS spectrum_id, l_linenumber AS comp, l_quantity AS center, sum(l_extendedprice) AS area FROM lineitem GROUP BY ALL),
    n AS (SELECT a.spectrum_id, a.comp AS main, b.comp AS partner, abs(b.center - a.center - 5) + abs(a.area / b.area / 2 - 1) AS off FROM c a JOIN c b ON a.spectrum_id = b.spectrum_id AND a.comp <> b.comp
      WHERE b.area > 0 AND abs(b.center - a.center - 5) <= 2 AND abs(a.area / b.area / 2 - 1) <= 0.5),
    f AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id, main ORDER BY off, partner) AS p, row_number() OVER (PARTITION BY spectrum_id, partner ORDER BY off, main) AS q FROM n)
    SELECT spectrum_id, main, partner, round(off, 6) AS off FROM f WHERE p = 1 AND q = 1"""
)
def pair_doublets(spark: SparkSession, d: str) -> DataFrame:
    from lineshed.operators import relate

    c = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("spectrum_id"), F.col("l_linenumber").alias("comp"), F.col("l_quantity").alias("center")).agg(F.sum("l_extendedprice").alias("area"))
    got = relate.pair_doublets(c, 5.0, 2.0, most_off=2.0, ratio_off=0.5)
    return got.select("spectrum_id", "main", "partner", F.round("off", 6).alias("off"))


@query(
    """WITH b AS (SELECT p_brand, min(p_retailprice) AS lp, max(p_retailprice) AS hp, min(p_size::DOUBLE) AS ls, max(p_size::DOUBLE) AS hs FROM part GROUP BY 1),
    k AS (SELECT p_partkey, p_retailprice, CASE WHEN hp > lp THEN 32767.0::DOUBLE / (hp - lp) ELSE 1 END AS sp, CASE WHEN hs > ls THEN 32767.0::DOUBLE / (hs - ls) ELSE 1 END AS ss, lp, ls, p_size FROM part JOIN b USING (p_brand))
    SELECT p_partkey, round(trunc((p_retailprice - lp) * sp) / sp + lp, 5) AS price, round(trunc((p_size - ls) * ss) / ss + ls, 5) AS size FROM k"""
)
def component_codec(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    back = codec.dequantize_columns(codec.quantize_columns(p, ["price", "size"], ["p_brand"]), ["price", "size"])
    return back.select("p_partkey", F.round("price", 5).alias("price"), F.round("size", 5).alias("size"))


@query(
    """WITH p AS (SELECT p_partkey, 2.0::DOUBLE * (p_size / 50.0::DOUBLE - 0.5) + 1.0 * (p_retailprice / 2000 - 0.5) AS u, 3.0::DOUBLE * (p_retailprice / 2000 - 0.5) AS v FROM part),
    c AS (SELECT p_partkey, least(greatest(floor((u + 2) / 4 * 16), 0), 15) AS a, least(greatest(floor((v + 2) / 4 * 16), 0), 15) AS b FROM p),
    m AS (SELECT p_partkey, (a + 0.5) / 16 * 4 - 2 AS u, (b + 0.5) / 16 * 4 - 2 AS v FROM c)
    SELECT p_partkey, round((u - v / 3) / 2 + 0.5, 8) AS size, round(v / 3 + 0.5, 8) AS price FROM m"""
)
def fisher_hilbert_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    from lineshed.functions import encode

    lower = np.array([[2.0, 0.0], [1.0, 3.0]])
    fisher, reference_ = lower @ lower.T, np.array([0.5, 0.5])
    index = encode.fisher_hilbert(fisher, [F.col("p_size") / 50.0, F.col("p_retailprice") / 2000], reference_, 2.0, 4)
    coded = read(spark, d, "part").select("p_partkey", index.alias("index"))
    size, price = encode.of_fisher_hilbert(fisher, F.col("index"), reference_, 2.0, 4)
    return coded.select("p_partkey", F.round(size, 8).alias("size"), F.round(price, 8).alias("price"))
