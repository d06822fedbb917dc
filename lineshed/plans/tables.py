"""Queries that apply the column functions and relational operators to the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineshed.functions import axis, codec, lineshape, physics, scores
from lineshed.operators import ordered, quantify, relate, robust
from lineshed.plans.registry import query
from lineshed.session import read


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def seconds(ts: str = "ts"):
    """Seconds since 2020-01-01, fractions included."""
    return ((F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(1577836800000000)) / 1e6).alias("s")


SQL_SECONDS = "(epoch_us(ts) - 1577836800000000) / 1e6"


@query(
    """WITH med AS (SELECT event_type, median(value) AS center FROM events GROUP BY event_type),
    mad AS (SELECT e.event_type, any_value(m.center) AS center, median(abs(e.value - m.center)) AS mad
            FROM events e JOIN med m USING (event_type) GROUP BY e.event_type)
    SELECT e.event_id, e.event_type, e.value, round(center + 3 * 1.4826 * mad, 6) AS threshold
    FROM events e JOIN mad USING (event_type) WHERE mad >= 1e-10 AND e.value > center + 3 * 1.4826 * mad"""
)
def mad_anomaly(spark: SparkSession, d: str) -> DataFrame:
    out = robust.mad_outliers(read(spark, d, "events"), "value", ["event_type"])
    return out.select("event_id", "event_type", "value", r6(F.col("threshold"), "threshold"))


@query(
    """WITH med AS (SELECT p_brand, median(p_size) AS center FROM part GROUP BY p_brand),
    mad AS (SELECT p.p_brand, any_value(center) AS center, median(abs(p_size - center)) AS mad FROM part p JOIN med USING (p_brand) GROUP BY p.p_brand)
    SELECT p_brand, round(center, 6) AS center, round(mad, 6) AS mad, round(center + 3 * 1.4826 * mad, 6) AS threshold, mad >= 1e-10 AS active FROM mad"""
)
def robust_threshold_guard(spark: SparkSession, d: str) -> DataFrame:
    t = robust.mad_thresholds(read(spark, d, "part"), "p_size", ["p_brand"])
    return t.select("p_brand", r6(F.col("center"), "center"), r6(F.col("mad"), "mad"), r6(F.col("threshold"), "threshold"), (F.col("mad") >= robust.MAD_FLOOR).alias("active"))


@query(
    """WITH m AS (SELECT avg(l_extendedprice / l_quantity) AS unit FROM lineitem),
    e AS (SELECT l_returnflag, l_extendedprice - l_quantity * unit AS e FROM lineitem, m)
    SELECT l_returnflag, round(avg(e), 4) AS bias, round(stddev_pop(e), 4) AS std, round(sqrt(avg(e * e)), 4) AS rmse,
           round(median(abs(e)), 4) AS mae, round(quantile_cont(abs(e), 0.95), 4) AS p95 FROM e GROUP BY l_returnflag"""
)
def error_stats(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    unit = items.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    rows = items.crossJoin(F.broadcast(unit)).withColumn("e", F.col("l_extendedprice") - F.col("l_quantity") * F.col("unit"))
    s = robust.error_stats(rows, "e", ["l_returnflag"])
    return s.select("l_returnflag", *[F.round(x, 4).alias(x) for x in ("bias", "std", "rmse", "mae", "p95")])


@query(
    """WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS mean, max(o_totalprice) AS peak FROM orders GROUP BY 1)
    SELECT o.o_orderpriority, round(20 * log10(any_value(peak) / sqrt(avg((o_totalprice - mean) * (o_totalprice - mean)))), 6) AS psnr_db
    FROM orders o JOIN m USING (o_orderpriority) GROUP BY 1"""
)
def psnr_pair(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    m = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("peak"))
    e = F.col("o_totalprice") - F.col("mean")
    s = o.join(m, "o_orderpriority").groupBy("o_orderpriority").agg(F.avg(e * e).alias("ms"), F.first("peak").alias("peak"))
    return s.select("o_orderpriority", r6(scores.psnr("ms", "peak"), "psnr_db"))


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high,
       count(*) FILTER (value > 100) AS n_over FROM events GROUP BY event_type"""
)
def streaming_summary(spark: SparkSession, d: str) -> DataFrame:
    from lineshed.streaming.summary import summarize

    return summarize(read(spark, d, "events"), "value", ["event_type"], F.col("value") > 100).select(
        "event_type", "n", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), "low", "high", "n_over"
    )


@query(
    """WITH w AS (SELECT p_brand, l_returnflag, sum(l_extendedprice * (1 - l_discount)) AS area FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT p_brand, l_returnflag, round(area / sum(area) OVER (PARTITION BY l_returnflag), 9) AS fraction FROM w"""
)
def composition_share(spark: SparkSession, d: str) -> DataFrame:
    items, parts = read(spark, d, "lineitem"), read(spark, d, "part")
    w = items.join(parts, items["l_partkey"] == parts["p_partkey"]).groupBy("p_brand", "l_returnflag").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("area"))
    return quantify.shares(w, "area", ["l_returnflag"]).select("p_brand", "l_returnflag", F.round("fraction", 9).alias("fraction"))


@query(
    """WITH l AS (SELECT n_name AS sample, p_brand AS element, sum(s_acctbal) AS area, 1 + avg(p_size) / 50 AS cs, 1 + avg(p_retailprice) / 1000 AS imfp
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
    f AS (SELECT *, min(CASE WHEN area > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sample) = 1 AS fine, area / (cs * imfp) AS w FROM l)
    SELECT sample, element, CASE WHEN fine THEN round(w / sum(w) OVER (PARTITION BY sample), 9) END AS fraction, CASE WHEN fine THEN 'inputs_stated' ELSE 'refused' END AS status FROM f"""
)
def composition_refusal(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = j.groupBy(F.col("n_name").alias("sample"), F.col("p_brand").alias("element")).agg(
        F.sum("s_acctbal").alias("area"), (1 + F.avg("p_size") / 50).alias("cross_section"), (1 + F.avg("p_retailprice") / 1000).alias("imfp")
    )
    return quantify.composition(lines).select("sample", "element", F.round("fraction", 9).alias("fraction"), "status")


@query("SELECT event_id, round(value / max(value) OVER (PARTITION BY user_id), 9) AS scaled FROM events")
def normalise_max(spark: SparkSession, d: str) -> DataFrame:
    return quantify.beside(read(spark, d, "events"), ["user_id"], top=F.max("value")).select("event_id", F.round(F.col("value") / F.col("top"), 9).alias("scaled"))


@query(
    """SELECT event_id, CASE WHEN max(value) OVER w > min(value) OVER w THEN round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 9) END AS scaled
    FROM events WINDOW w AS (PARTITION BY user_id)"""
)
def normalise_minmax(spark: SparkSession, d: str) -> DataFrame:
    low, high = F.col("low"), F.col("high")
    return quantify.beside(read(spark, d, "events"), ["user_id"], low=F.min("value"), high=F.max("value")).select("event_id", F.when(high > low, F.round((F.col("value") - low) / (high - low), 9)).alias("scaled"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, value, {SQL_SECONDS} AS s FROM events),
    p AS (SELECT *, (value + lag(value) OVER w) / 2 * (s - lag(s) OVER w) AS part FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
    SELECT user_id, round(coalesce(sum(part), 0), 3) AS area FROM p GROUP BY user_id"""
)
def trapezoid_area(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "value", seconds())
    return ordered.trapezoid_area(e, "s", "value", ["user_id"], ["s", "event_id"]).select("user_id", F.round("area", 3).alias("area"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, value, {SQL_SECONDS} AS s FROM events),
    a AS (SELECT user_id, sum(part) AS area FROM (SELECT user_id, (value + lag(value) OVER w) / 2 * (s - lag(s) OVER w) AS part FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)) GROUP BY 1)
    SELECT event_id, round(value / abs(area) * 1e6, 6) AS scaled FROM e JOIN a USING (user_id) WHERE area <> 0"""
)
def normalise_area(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "value", seconds())
    a = ordered.trapezoid_area(e, "s", "value", ["user_id"], ["s", "event_id"]).filter("area != 0")
    return e.join(a, "user_id").select("event_id", r6(F.col("value") / F.abs("area") * 1e6, "scaled"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, value, {SQL_SECONDS} AS s FROM events),
    p AS (SELECT *, coalesce((value + lag(value) OVER w) / 2 * (s - lag(s) OVER w), 0) AS part FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
    SELECT event_id, round(sum(part) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) / sum(part) OVER (PARTITION BY user_id), 6) AS integral FROM p"""
)
def running_integral(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "value", seconds())
    return ordered.running_integral(e, "s", "value", ["user_id"], ["s", "event_id"]).select("event_id", r6(F.col("integral"), "integral"))


@query(
    """SELECT event_id, round(first(value) OVER a + (last(value) OVER a - first(value) OVER a) * (sum(value) OVER r) / (sum(value) OVER a), 6) AS background
    FROM events WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
    r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
)
def shirley_step(spark: SparkSession, d: str) -> DataFrame:
    return ordered.shirley_step(read(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", r6(F.col("background"), "background"))


@query(
    """WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
    b AS (SELECT a.vec_id, a.k, sum(b.y * ((a.k - b.k) * 0.5) / pow(1643 + pow((a.k - b.k) * 0.5, 2), 2)) AS s FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.k <= a.k GROUP BY ALL)
    SELECT vec_id, k::INT AS k, round(s * 1e6, 6) AS loss FROM b"""
)
def tougaard_sum(spark: SparkSession, d: str) -> DataFrame:
    from lineshed.operators.background import tougaard_loss

    v = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("y"))
    return v.select("vec_id", F.posexplode(tougaard_loss(F.col("y"), 0.5)).alias("k", "s")).select("vec_id", "k", r6(F.col("s") * 1e6, "loss"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, value, {SQL_SECONDS} AS s FROM events)
    SELECT event_id, round(CASE WHEN last(s) OVER a <> first(s) OVER a THEN first(value) OVER a + (last(value) OVER a - first(value) OVER a) / (last(s) OVER a - first(s) OVER a) * (s - first(s) OVER a)
      ELSE first(value) OVER a END, 6) AS background
    FROM e WINDOW a AS (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def linear_background(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "value", seconds())
    return ordered.linear_background(e, "s", "value", ["user_id"], ["s", "event_id"]).select("event_id", r6(F.col("background"), "background"))


@query(
    """SELECT event_id, least(first(value) OVER a, last(value) OVER a) AS background FROM events
    WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def constant_background(spark: SparkSession, d: str) -> DataFrame:
    return ordered.constant_background(read(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "background")


S = "(4.5 / 2.3548200450309493)"


@query(f"SELECT p_partkey, round(1 / ({S} * sqrt(2 * pi())) * exp(-pow((p_size - 25) / {S}, 2) / 2), 9) AS y FROM part")
def gaussian_profile(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(lineshape.gaussian("p_size", 25.0, 4.5), 9).alias("y"))


@query("SELECT p_partkey, round(1 / pi() * 2.25 / (pow(p_size - 25, 2) + 2.25 * 2.25), 9) AS y FROM part")
def lorentzian_profile(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(lineshape.lorentzian("p_size", 25.0, 4.5), 9).alias("y"))


@query(
    f"""SELECT p_partkey, round(0.3 / pi() * 2.25 / (pow(p_size - 25, 2) + 2.25 * 2.25) + 0.7 / ({S} * sqrt(2 * pi())) * exp(-pow((p_size - 25) / {S}, 2) / 2), 9) AS y FROM part"""
)
def pseudo_voigt_profile(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(lineshape.pseudo_voigt("p_size", 25.0, 4.5, 0.3), 9).alias("y"))


@query(
    f"""SELECT p_partkey, round({math.gamma(0.85)!r} * cos(pi() * 0.15 / 2 + 0.85 * atan((25 - p_size) / 0.6)) / pow(pow(25 - p_size, 2) + 0.36, 0.425), 9) AS y FROM part"""
)
def ds_core_profile(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(lineshape.doniach_sunjic("p_size", 25.0, 1.2, 0.15), 9).alias("y"))


@query("SELECT p_partkey, round(1 / (1 + exp(-(p_size - 25) / (8.617333262e-5 * 30000))), 9) AS y FROM part")
def fermi_dirac_profile(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(lineshape.fermi_dirac("p_size", 25.0, 30000.0), 9).alias("y"))


@query(
    """WITH w AS (SELECT p_partkey, p_size / 50.0 AS g, p_retailprice / 1000 AS l FROM part),
    t AS (SELECT *, pow(pow(g, 5) + 2.69269 * pow(g, 4) * l + 2.42843 * pow(g, 3) * pow(l, 2) + 4.47163 * pow(g, 2) * pow(l, 3) + 0.07842 * g * pow(l, 4) + pow(l, 5), 0.2) AS w FROM w)
    SELECT p_partkey, round(w, 8) AS width, round(least(greatest(1.36603 * (l / w) - 0.47719 * pow(l / w, 2) + 0.11116 * pow(l / w, 3), 0), 1), 8) AS eta FROM t"""
)
def tch_eta(spark: SparkSession, d: str) -> DataFrame:
    g, w = F.col("p_size") / 50.0, F.col("p_retailprice") / 1000
    return read(spark, d, "part").select("p_partkey", F.round(lineshape.tch_width(g, w), 8).alias("width"), F.round(lineshape.tch_eta(g, w), 8).alias("eta"))


@query("SELECT p_partkey, round(0.5346 * (p_retailprice / 1000) + sqrt(0.2166 * pow(p_retailprice / 1000, 2) + pow(p_size / 50.0, 2)), 9) AS width FROM part")
def voigt_fwhm(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(lineshape.voigt_width(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000), 9).alias("width"))


@query(
    """WITH w AS (SELECT p_partkey, p_retailprice AS a, 0.5 + p_size / 50.0 AS f FROM part)
    SELECT p_partkey, round(a * 2.3548200450309493 / (f * sqrt(2 * pi())), 6) AS height_g, round(a * 2 / (pi() * f), 6) AS height_l,
      round(0.4 * a * 2 / (pi() * f) + 0.6 * a * 2.3548200450309493 / (f * sqrt(2 * pi())), 6) AS height_pv FROM w"""
)
def area_to_height(spark: SparkSession, d: str) -> DataFrame:
    a, f = F.col("p_retailprice"), 0.5 + F.col("p_size") / 50.0
    return read(spark, d, "part").select("p_partkey", r6(lineshape.gaussian_height(a, f), "height_g"), r6(lineshape.lorentzian_height(a, f), "height_l"), r6(lineshape.pseudo_voigt_height(a, f, 0.4), "height_pv"))


@query(
    """WITH w AS (SELECT p_partkey, p_size / 51.0 AS eta FROM part)
    SELECT p_partkey, round(sqrt(greatest(pow(2 - 0.5346 * eta * 2, 2) - 0.2166 * pow(eta * 2, 2), 0)) / 2.3548200450309493, 8) AS sigma FROM w"""
)
def eta_inverse(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(lineshape.sigma_of_eta(F.col("p_size") / 51.0, 2.0), 8).alias("sigma"))


@query(
    """WITH dict AS (SELECT vec_id AS j, embedding::DOUBLE[] AS dv FROM embeddings WHERE vec_id < 16),
    s AS (SELECT e.vec_id, j, list_dot_product(e.embedding::DOUBLE[], dv) AS sc FROM embeddings e, dict)
    SELECT vec_id, arg_max(j, (sc, -j))::INT AS dict_idx, round(max(sc), 6) AS score FROM s GROUP BY vec_id"""
)
def dict_lookup_argmax(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    dictionary = [r["embedding"] for r in e.filter("vec_id < 16").orderBy("vec_id").collect()]  # 16 rows
    return relate.dictionary_match(e, "embedding", dictionary).select("vec_id", "dict_idx", r6(F.col("score"), "score"))


@query(
    """WITH n AS (SELECT date_trunc('day', o_orderdate)::DATE AS day, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
    k AS (SELECT day, lag(n) OVER (ORDER BY day) AS a, n AS b, lead(n) OVER (ORDER BY day) AS c FROM n)
    SELECT day, round(CASE WHEN abs(2 * (2 * b - a - c)) > 1e-30 THEN least(greatest((c - a) / (2 * (2 * b - a - c)), -0.5), 0.5) ELSE 0 END, 8) AS vertex
    FROM k WHERE a IS NOT NULL AND c IS NOT NULL AND b >= a AND b >= c"""
)
def parabola_vertex(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").cast("double").alias("b"))
    w = Window.orderBy("day")  # one row a day
    k = n.withColumns({"a": F.lag("b").over(w), "c": F.lead("b").over(w)}).filter("a is not null and c is not null and b >= a and b >= c")
    return k.select("day", F.round(ordered.parabola_vertex(F.col("a"), F.col("b"), F.col("c")), 8).alias("vertex"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS amplitude FROM lineitem GROUP BY 1")
def amp_lls_1(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.sum(q * p) / F.sum(q * q), "amplitude"))


@query(
    """WITH s AS (SELECT l_returnflag, sum(l_quantity * l_quantity) a, sum(l_quantity * l_discount) b, sum(l_discount * l_discount) c,
      sum(l_quantity * l_extendedprice) u, sum(l_discount * l_extendedprice) v FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round((c * u - b * v) / (a * c - b * b), 4) AS amp_0, round((a * v - b * u) / (a * c - b * b), 4) AS amp_1 FROM s"""
)
def amp_lls_2(spark: SparkSession, d: str) -> DataFrame:
    from lineshed.operators.fit import two_amplitudes

    return two_amplitudes(read(spark, d, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", ["l_returnflag"]).select(
        "l_returnflag", F.round("amp_0", 4).alias("amp_0"), F.round("amp_1", 4).alias("amp_1")
    )


@query(
    """WITH e AS (SELECT user_id, value AS y, 1 + (event_id % 7) / 7.0 AS phi, ((event_id % 5) - 2) / 10.0 AS jc, ((event_id % 3) - 1) / 10.0 AS js FROM events),
    a AS (SELECT user_id, sum(y * phi) / sum(phi * phi) AS amp FROM e GROUP BY 1),
    s AS (SELECT e.user_id, any_value(amp) AS amp, sum((y - amp * phi) * amp * jc) AS rc, sum(amp * amp * jc * jc) AS cc, sum((y - amp * phi) * amp * js) AS rs,
       sum(amp * amp * jc * js) AS cs, sum(amp * amp * js * js) AS ss, avg((y - amp * phi) * (y - amp * phi)) AS chi2, sum(phi * js) / sum(phi * phi) AS c FROM e JOIN a USING (user_id) GROUP BY 1),
    t AS (SELECT *, CASE WHEN cc > 1e-20 THEN rc / cc ELSE 0 END AS de FROM s), u AS (SELECT *, CASE WHEN ss > 1e-20 THEN (rs - de * cs) / ss ELSE 0 END AS ds FROM t)
    SELECT user_id, round(amp / CASE WHEN abs(1 + ds * c) > 1e-6 THEN 1 + ds * c ELSE 1 END, 6) AS amplitude, round(de, 6) AS shift, round(ds, 6) AS width, round(chi2, 6) AS chi2 FROM u"""
)
def four_step_1comp(spark: SparkSession, d: str) -> DataFrame:
    from lineshed.operators.fit import four_step_rows

    k = F.col("event_id")
    e = read(spark, d, "events").select(
        "user_id", F.col("value").alias("y"), (1 + (k % 7) / 7.0).alias("phi"), (((k % 5) - 2) / 10.0).alias("jc"), (((k % 3) - 1) / 10.0).alias("js")
    )
    return four_step_rows(e, ["user_id"]).select("user_id", *[r6(F.col(x), x) for x in ("amplitude", "shift", "width", "chi2")])


@query(
    """WITH v AS (SELECT date_trunc('day', ts)::DATE AS sweep, extract(hour FROM ts)::INT AS channel, sum(value) AS x FROM events GROUP BY ALL),
    t AS (SELECT sweep, sum(x) AS t FROM v GROUP BY 1), n AS (SELECT v.*, x / (t / (SELECT avg(t) FROM t)) AS xn FROM v JOIN t USING (sweep)),
    p AS (SELECT channel, xn, pow(xn - lag(xn) OVER (PARTITION BY channel ORDER BY sweep), 2) / 2 AS h FROM n), c AS (SELECT channel, avg(xn) AS m, avg(h) AS h FROM p GROUP BY 1)
    SELECT round(regr_slope(h, m), 6) AS gain, round(regr_intercept(h, m), 4) AS "offset", count(*) AS n_channels FROM c"""
)
def gain_estimate(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("sweep"), F.hour("ts").alias("channel")).agg(F.sum("value").alias("x"))
    return quantify.detector_gain(v, "sweep", "channel", "x").select(r6(F.col("gain"), "gain"), F.round("offset", 4).alias("offset"), "n_channels")


@query(
    """WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS mu FROM lineitem GROUP BY ALL),
    s AS (SELECT l_returnflag, l_linestatus, sum(pow(l_extendedprice - mu, 2)) AS rss, count(*) AS n FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, round(n * ln(rss / n) + 4, 5) AS aic, round(n * ln(rss / n) + 4 + 12.0 / (n - 3), 5) AS aicc, round(n * ln(rss / n) + 2 * ln(n), 5) AS bic FROM s"""
)
def gaussian_ic(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((F.var_pop("l_extendedprice") * F.count("*")).alias("rss"), F.count("*").alias("n"))
    aic = scores.gaussian_aic("rss", "n", 2)
    return s.select(
        "l_returnflag", "l_linestatus", F.round(aic, 5).alias("aic"), F.round(aic + scores.aicc_correction("n", 2), 5).alias("aicc"), F.round(scores.gaussian_bic("rss", "n", 2), 5).alias("bic")
    )


@query(
    """WITH g AS (SELECT l_returnflag, 1 AS k, var_pop(l_extendedprice) * count(*) AS rss, count(*) AS n FROM lineitem GROUP BY ALL
      UNION ALL SELECT l_returnflag, 2, sum(v), sum(n) FROM (SELECT l_returnflag, l_linestatus, var_pop(l_extendedprice) * count(*) AS v, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1
      UNION ALL SELECT l_returnflag, 7, sum(v), sum(n) FROM (SELECT l_returnflag, l_linenumber, var_pop(l_extendedprice) * count(*) AS v, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1),
    s AS (SELECT l_returnflag, k, n * ln(rss / n) + k * ln(n) AS bic FROM g)
    SELECT l_returnflag, k::INT AS k, round(bic - min(bic) OVER (PARTITION BY l_returnflag), 4) AS delta_bic, bic = min(bic) OVER (PARTITION BY l_returnflag) AS best FROM s"""
)
def select_k(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice")

    def fitted(k: int, *by: str) -> DataFrame:
        s = items.groupBy("l_returnflag", *by).agg((F.var_pop("l_extendedprice") * F.count("*")).alias("v"), F.count("*").alias("n"))
        return s.groupBy("l_returnflag").agg(F.sum("v").alias("rss"), F.sum("n").alias("n")).withColumn("k", F.lit(k))

    g = fitted(1).unionByName(fitted(2, "l_linestatus")).unionByName(fitted(7, "l_linenumber")).withColumn("bic", scores.gaussian_bic("rss", "n", "k"))
    least = F.min("bic").over(Window.partitionBy("l_returnflag"))
    return g.select("l_returnflag", "k", F.round(F.col("bic") - least, 4).alias("delta_bic"), (F.col("bic") == least).alias("best"))


@query(
    """WITH c AS (SELECT event_type, extract(hour FROM ts) AS h, count(*)::DOUBLE AS y FROM events GROUP BY ALL), m AS (SELECT *, avg(y) OVER (PARTITION BY event_type) AS mu FROM c)
    SELECT event_type, round(sum(2 * (y * ln(y / mu) - (y - mu))), 6) AS deviance FROM m GROUP BY 1"""
)
def poisson_deviance(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count("*").cast("double").alias("y"))
    m = c.withColumn("mu", F.avg("y").over(Window.partitionBy("event_type")))
    return m.groupBy("event_type").agg(r6(F.sum(scores.deviance_term("y", "mu")), "deviance"))


@query(
    """WITH r AS (SELECT user_id, event_id, ts, value - avg(value) OVER (PARTITION BY user_id) AS r FROM events),
    s AS (SELECT user_id, r, r * lag(r) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM r), a AS (SELECT user_id, count(*) AS n, sum(n) AS x, sum(r * r) AS y FROM s GROUP BY 1)
    SELECT user_id, n, round(CASE WHEN n >= 3 AND y <> 0 THEN x / y ELSE 0 END, 7) AS acf1, round(CASE WHEN n >= 3 AND y <> 0 THEN x / y ELSE 0 END * sqrt(n), 6) AS z FROM a"""
)
def lag1_autocorr(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "events").withColumn("r", F.col("value") - F.avg("value").over(Window.partitionBy("user_id")))
    return ordered.lag1_autocorrelation(r, "r", ["user_id"], ["ts", "event_id"]).select("user_id", "n", F.round("acf1", 7).alias("acf1"), r6(F.col("z"), "z"))


@query(
    """WITH c AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000),
    p AS (SELECT c_custkey, c, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c - c_custkey), c_custkey - c) AS rn FROM customer JOIN c ON abs(c - c_custkey) BETWEEN 1 AND 10)
    SELECT k.c_custkey, p.c AS inherited_from FROM customer k LEFT JOIN p ON k.c_custkey = p.c_custkey AND rn = 1"""
)
def nearest_inherit(spark: SparkSession, d: str) -> DataFrame:
    cache = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.col("o_custkey").alias("cached")).distinct()
    return relate.nearest(read(spark, d, "customer").select("c_custkey"), cache, "c_custkey", "cached")


@query(
    """WITH r AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey, coalesce(v, o_totalprice) AS price FROM orders LEFT JOIN r ON o_orderkey = l_orderkey"""
)
def merge_refined(spark: SparkSession, d: str) -> DataFrame:
    refined = read(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("price"))
    base = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return relate.merge(base, refined, "o_orderkey", ["price"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def cache_miss_anti(spark: SparkSession, d: str) -> DataFrame:
    cached = read(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return relate.missing(read(spark, d, "customer").select("c_custkey"), cached, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def work_semi(spark: SparkSession, d: str) -> DataFrame:
    return relate.wanted(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    """SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.s_acctbal - b.s_acctbal), 6) AS distance FROM supplier a JOIN supplier b
    ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 25"""
)
def separation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return relate.pairs_within(read(spark, d, "supplier"), "s_suppkey", "s_acctbal", 25.0).select("a", "b", r6(F.col("distance"), "distance"))


@query(
    """WITH g AS (SELECT *, CASE WHEN s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) >= 500 THEN 1 ELSE 0 END AS new FROM supplier)
    SELECT s_suppkey, s_nationkey, (sum(new) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM g"""
)
def group_islands(spark: SparkSession, d: str) -> DataFrame:
    return ordered.islands(read(spark, d, "supplier"), "s_acctbal", 500.0, ["s_nationkey"]).select("s_suppkey", "s_nationkey", "island")


@query(
    """WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)
    SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || '_' || n END AS unique_name FROM r"""
)
def dedup_names(spark: SparkSession, d: str) -> DataFrame:
    return axis.dedup_names(read(spark, d, "part"), "p_type", "p_partkey").select("p_partkey", "unique_name")


@query("SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS angle_idx, (l_orderkey // 5) % 7 AS y, (l_orderkey // 35) % 11 AS x, l_orderkey // 385 AS t, l_orderkey AS again FROM lineitem")
def encode_decode_index(spark: SparkSession, d: str) -> DataFrame:
    at = axis.decode_index(F.col("l_orderkey"), 5, 7, 11)
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in at.items()])
    return rows.withColumn("again", axis.encode_index("angle_idx", "y", "x", "t", 5, 7, 11))


@query(
    """WITH b AS (SELECT l_returnflag, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, CAST(trunc((l_extendedprice - low) * (32767.0::DOUBLE / (high - low))) AS SMALLINT) AS code FROM lineitem JOIN b USING (l_returnflag)"""
)
def quantize_int16(spark: SparkSession, d: str) -> DataFrame:
    return codec.quantize_int16(read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "code")


@query(
    """WITH p AS (SELECT p_partkey, (p_size % 4)::BIGINT AS x, ((p_partkey // 3) % 4)::BIGINT AS y FROM part),
    h(x,y,d,u) AS (VALUES (0,0,0,0),(1,0,2,1),(1,1,1,2),(0,1,3,3),(0,2,8,4),(0,3,10,5),(1,3,9,6),(1,2,11,7),(2,2,4,8),(2,3,6,9),(3,3,5,10),(3,2,7,11),(3,1,12,12),(2,1,14,13),(2,0,13,14),(3,0,15,15))
    SELECT p_partkey, p.x, p.y, h.d::BIGINT AS hilbert, h.u::BIGINT AS curve FROM p JOIN h ON p.x = h.x AND p.y = h.y"""
)
def hilbert2d_order2(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).cast("bigint").alias("x"), (F.floor(F.col("p_partkey") / 3) % 4).cast("bigint").alias("y"))
    return p.withColumn("hilbert", codec.hilbert_2d(F.col("x"), F.col("y"), 2)).withColumn("curve", codec.hilbert_2d(F.col("x"), F.col("y"), 2, True))


@query(
    """WITH k AS (SELECT p_partkey, p_retailprice, CAST(floor(least(greatest((p_retailprice - 900) / 1200 * 255, 0), 255)) AS INT) AS channel FROM part)
    SELECT p_partkey, channel, round(900 + channel / 255.0::DOUBLE * 1200, 6) AS decoded FROM k"""
)
def rgb_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "part").select("p_partkey", codec.to_channel("p_retailprice", 900, 2100).alias("channel"))
    return k.withColumn("decoded", F.round(codec.of_channel("channel", 900, 2100), 6))


@query(
    """WITH s AS (SELECT p_partkey, 0.7 * p_size + 0.2 * p_retailprice / 100 AS r, 0.1 * p_size + 0.9 * p_retailprice / 100 AS g, 0.5 * p_size AS b FROM part)
    SELECT p_partkey, CAST(floor(255 * r / max(r) OVER ()) AS INT) AS r, CAST(floor(255 * g / max(g) OVER ()) AS INT) AS g, CAST(floor(255 * b / max(b) OVER ()) AS INT) AS b FROM s"""
)
def amplitudes_to_rgb(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_size"), F.col("p_retailprice")
    s = read(spark, d, "part").select("p_partkey", (0.7 * a + 0.2 * b / 100).alias("r"), (0.1 * a + 0.9 * b / 100).alias("g"), (0.5 * a).alias("b"))
    top = s.agg(*[F.max(x).alias(f"m{x}") for x in "rgb"])  # one row
    return s.crossJoin(F.broadcast(top)).select("p_partkey", *[F.floor(255 * F.col(x) / F.col(f"m{x}")).cast("int").alias(x) for x in "rgb"])


MATERIAL = "(300.0::DOUBLE + p_retailprice) AS e, 4 + p_size % 12 AS nv, 2.0::DOUBLE + p_size / 10.0 AS rho, 20.0::DOUBLE + p_size AS m, (p_size % 9)::DOUBLE AS eg"


@query(
    f"""WITH x AS (SELECT p_partkey, {MATERIAL} FROM part), u AS (SELECT *, nv * rho / m AS u, pow(28.8 * sqrt(nv * rho / m), 2) AS ep2 FROM x),
    b AS (SELECT *, (-0.10 + 0.944 / sqrt(ep2 + eg * eg) + 0.069 * pow(rho, 0.1)) * ln(0.191 * pow(rho, -0.5) * e) - (1.97 - 0.91 * u) / e + (53.4 - 20.8 * u) / (e * e) AS br FROM u)
    SELECT p_partkey, round(e / (ep2 * br) / 10, 7) AS imfp FROM b"""
)
def imfp_tpp2m(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_size")
    imfp = physics.imfp_tpp2m(300.0 + F.col("p_retailprice"), 4 + p % 12, 2.0 + p / 10.0, 20.0 + p, (p % 9).cast("double"))
    return read(spark, d, "part").select("p_partkey", F.round(imfp, 7).alias("imfp"))


@query("SELECT p_partkey, round(-(1 + p_size / 10.0) * ln(1 - 0.95::DOUBLE), 7) AS depth FROM part")
def sampling_depth(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(physics.sampling_depth(1 + F.col("p_size") / 10.0), 7).alias("depth"))


@query(
    """WITH x AS (SELECT p_partkey, 1 + p_size / 10.0::DOUBLE AS l, 5 + p_retailprice / 100 AS t, p_size AS a FROM part), w AS (SELECT *, l / (l + t) AS w FROM x)
    SELECT p_partkey, round(w, 6) AS albedo, round(l * (1 - 0.738 * w), 6) AS eal, round(l * cos(radians(a)) * (1 - 0.736 * w), 6) AS med, round(l * cos(radians(a)) * ln(1 / (1 - 95.0::DOUBLE / 100)) * (1 - 0.787 * w), 6) AS depth FROM w"""
)
def albedo_eal(spark: SparkSession, d: str) -> DataFrame:
    imfp, trmfp, angle = 1 + F.col("p_size") / 10.0, 5 + F.col("p_retailprice") / 100, F.col("p_size")
    cols = {"albedo": physics.albedo(imfp, trmfp), "eal": physics.overlayer_eal(imfp, trmfp), "med": physics.mean_escape_depth(imfp, trmfp, angle), "depth": physics.information_depth(imfp, trmfp, angle, 95.0)}
    return read(spark, d, "part").select("p_partkey", *[F.round(v, 6).alias(k) for k, v in cols.items()])


@query("SELECT p_partkey, round(1 - (p_size / 30.0::DOUBLE) / 2 * ((3 * pow(cos(radians(p_size * 3)), 2) - 1) / 2), 8) AS factor FROM part")
def angular_dipole(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(physics.angular_dipole(F.col("p_size") / 30.0, F.col("p_size") * 3), 8).alias("factor"))


@query(
    """SELECT p_partkey, round(1 - 0.6::DOUBLE * ((3 * pow(cos(radians(p_size * 3)), 2) - 1) / 2) + (0.05 + 0.4::DOUBLE * pow(sin(radians(p_size * 3)), 2)) * cos(radians(p_size * 3)), 8) AS factor FROM part"""
)
def angular_unpolarized(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(physics.angular_unpolarized(1.2, 0.8, 0.05, F.col("p_size") * 3), 8).alias("factor"))


@query("SELECT p_partkey, round(45 * pow(least(greatest(p_retailprice / 8, 1), 200), -0.35::DOUBLE), 8) AS t FROM part")
def transmission_power_law(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(physics.transmission_power_law(F.col("p_retailprice") / 8), 8).alias("t"))


@query("SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 7) AS exponent, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 4) AS scale FROM lineitem GROUP BY 1")
def loglog_powerlaw(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.ln("l_quantity"), F.ln("l_extendedprice")
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 7).alias("exponent"), F.round(F.exp(F.regr_intercept(y, x)), 4).alias("scale"))


@query(
    """WITH g AS (SELECT p_brand, p_size AS x0, avg(p_retailprice) AS y0 FROM part GROUP BY ALL),
    c AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1, min(x0) OVER (PARTITION BY p_brand) AS lo, max(x0) OVER (PARTITION BY p_brand) AS hi FROM g WINDOW w AS (PARTITION BY p_brand ORDER BY x0)),
    q AS (SELECT p_partkey, p_brand, p_retailprice / 40 AS x FROM part), j AS (SELECT p_partkey, least(greatest(x, lo), hi) AS h, x0, y0, x1, y1 FROM q JOIN c USING (p_brand))
    SELECT p_partkey, round(CASE WHEN x1 IS NULL THEN y0 ELSE exp(ln(y0) + (ln(h) - ln(x0)) / (ln(x1) - ln(x0)) * (ln(y1) - ln(y0))) END, 5) AS interpolated FROM j WHERE h >= x0 AND (x1 IS NULL OR h < x1)"""
)
def loglog_interpolation(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    grid = p.groupBy("p_brand", F.col("p_size").cast("double").alias("x0")).agg(F.avg("p_retailprice").alias("y0"))
    q = p.select("p_partkey", "p_brand", (F.col("p_retailprice") / 40).alias("x"))
    return relate.log_log(q, grid, "x", "x0", "y0", ["p_brand"]).select("p_partkey", F.round("interpolated", 5).alias("interpolated"))


@query(
    """WITH r AS (SELECT p_partkey, sqrt(p_size / 1000.0::DOUBLE) / (p_retailprice / 1000) AS r FROM part)
    SELECT p_partkey, CASE WHEN r < 0.02 THEN 'easy' WHEN r < 0.1 THEN 'hard' WHEN r < 0.4 THEN 'shoulder' ELSE 'impossible' END AS level FROM r"""
)
def solvability_level(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", physics.solvability(F.col("p_size") / 1000.0, F.col("p_retailprice") / 1000).alias("level"))


@query("SELECT p_partkey, abs((p_size - 25) / 60.0::DOUBLE / 0.6::DOUBLE) < 0.35 AS within FROM part")
def taylor_range(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", physics.within_taylor((F.col("p_size") - 25) / 60.0, 0.6).alias("within"))


@query(
    """WITH s AS (SELECT l_returnflag, l_shipdate, sum(l_quantity) AS s FROM lineitem GROUP BY ALL), p AS (SELECT l_returnflag, s * s / sum(s * s) OVER (PARTITION BY l_returnflag) AS p FROM s)
    SELECT l_returnflag, round(exp(-sum(p * ln(p))), 4) AS rank FROM p GROUP BY 1"""
)
def entropy_rank(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "lineitem").groupBy("l_returnflag", "l_shipdate").agg(F.sum("l_quantity").alias("s"))
    p = s.withColumn("p", F.col("s") * F.col("s") / F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("l_returnflag")))
    return p.groupBy("l_returnflag").agg(F.round(F.exp(-F.sum(F.col("p") * F.ln("p"))), 4).alias("rank"))


@query(
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders),
    w AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 99) AS BIGINT) AS k FROM (SELECT max(n) AS n FROM r), range(100) t(i))
    SELECT o_orderkey FROM r JOIN w USING (k)"""
)
def evenly_spaced_sample(spark: SparkSession, d: str) -> DataFrame:
    return ordered.evenly_spaced(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 0")
def every_kth(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").filter("o_orderkey % 7 = 0").select("o_orderkey", "o_totalprice")


@query(
    """WITH p AS (SELECT user_id, event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT user_id, event_id, least(value - a, value - b) AS rise, row_number() OVER (PARTITION BY user_id ORDER BY least(value - a, value - b) DESC, event_id) AS place FROM p WHERE value > a AND value > b)
    SELECT user_id, event_id, round(rise, 6) AS rise, place::INT AS place FROM k WHERE place <= 10"""
)
def topk_prominence(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = read(spark, d, "events").withColumns({"a": F.lag("value").over(w), "b": F.lead("value").over(w)}).filter("value > a and value > b")
    k = p.withColumn("rise", F.least(F.col("value") - F.col("a"), F.col("value") - F.col("b")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("rise"), "event_id"))
    return k.withColumn("place", place).filter("place <= 10").select("user_id", "event_id", r6(F.col("rise"), "rise"), "place")


@query(
    """WITH e AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL)
    SELECT a.user_id, round(a.v, 6) AS click, round(b.v, 6) AS view FROM (SELECT * FROM e WHERE event_type = (SELECT min(event_type) FROM events)) a
    JOIN (SELECT * FROM e WHERE event_type = (SELECT max(event_type) FROM events)) b USING (user_id)"""
)
def multi_element_align(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("user_id", "event_type", "value")
    names = events.agg(F.min("event_type"), F.max("event_type")).first()
    e = events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    side = lambda name, out: e.filter(F.col("event_type") == name).select("user_id", r6(F.col("v"), out))
    return side(names[0], "click").join(side(names[1], "view"), "user_id")


@query(
    """WITH m AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1), w AS (SELECT extract(hour FROM ts)::INT AS h, event_type, avg(value) AS v FROM events GROUP BY ALL)
    SELECT event_type, round(max(CASE WHEN h = 0 THEN v END), 6) AS base, round(min(v) - max(CASE WHEN h = 0 THEN v END), 6) AS low_change, round(max(v) - max(CASE WHEN h = 0 THEN v END), 6) AS high_change FROM w GROUP BY 1"""
)
def condition_dependence(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "events").groupBy(F.hour("ts").alias("h"), "event_type").agg(F.avg("value").alias("v"))
    return quantify.condition_dependence(w, "v", "h", 0, ["event_type"]).select("event_type", *[r6(F.col(x), x) for x in ("base", "low_change", "high_change")])


@query(
    """WITH v AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY 1), p AS (SELECT *, least(greatest(0.9 * (len(v) + 1), 1), len(v)) AS k FROM v)
    SELECT user_id, round(v[floor(k)::INT] + (k - floor(k)) * (v[least(floor(k) + 1, len(v))::INT] - v[floor(k)::INT]), 6) AS quantile FROM p"""
)
def weibull_quantile(spark: SparkSession, d: str) -> DataFrame:
    return quantify.weibull_quantile(read(spark, d, "events"), "value", 0.9, ["user_id"]).select("user_id", r6(F.col("quantile"), "quantile"))


@query(
    """WITH s AS (SELECT user_id, event_id, value, abs(value - lag(value) OVER w) AS g, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT user_id, k, n, avg(coalesce(g, 0)) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) * (1 + 3 * (k + 3.5) / n) AS score FROM s)
    SELECT user_id, arg_min(k, (score, k))::BIGINT AS start, round(min(score), 6) AS score FROM m WHERE k <= n - 7 GROUP BY 1"""
)
def flattest_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = read(spark, d, "events").withColumn("g", F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0)))
    return ordered.flattest_window(g, "g", ["user_id"], ["ts", "event_id"]).select("user_id", "start", r6(F.col("score"), "score"))


@query(
    """WITH c AS (SELECT c_custkey, c_name, c_nationkey FROM customer), n AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 0)
    SELECT c_custkey, n_name, CASE WHEN n_name IS NULL THEN 'not_in_table' ELSE 'tabulated' END AS status FROM c LEFT JOIN n ON c_nationkey = n_nationkey"""
)
def lookup_with_status(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "nation").filter("n_nationkey % 3 != 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return relate.lookup(read(spark, d, "customer"), table, ["c_nationkey"]).select("c_custkey", "n_name", "status")


@query(
    """WITH base AS (SELECT o_custkey, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1),
    changed AS (SELECT o_custkey, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'O') WHERE rn = 1)
    SELECT * FROM changed UNION ALL SELECT * FROM base WHERE o_custkey NOT IN (SELECT o_custkey FROM changed)"""
)
def latest_fit_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The first fit of each customer, replaced by the latest of the open ones where there is one."""
    o, fit, at = read(spark, d, "orders"), F.struct("o_totalprice", "o_orderkey"), F.struct("o_orderdate", "o_orderkey")
    base = o.groupBy("o_custkey").agg(F.min_by(fit, at).alias("x")).select("o_custkey", "x.*")
    changed = o.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max_by(fit, at).alias("x")).select("o_custkey", "x.*")
    return relate.upsert(base, changed, ["o_custkey"])


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return read(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"
    )


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 hour OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g)
    SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, id"""
)
def events_session(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    s = read(spark, d, "events").groupBy("user_id", F.session_window(t, "6 hours").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return s.select("user_id", "start", "last", "n")
