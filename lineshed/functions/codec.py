"""Codecs as column expressions: 16-bit quantisation, Hilbert indices, colour channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineshed.functions.lineshape import Value, c


def quantize_int16(df: DataFrame, value: str, by: list[str], out: str = "code") -> DataFrame:
    """Truncated code of value between its group's bounds; adds low and scale to decode it."""
    bounds = df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    scale = F.when(F.col("high") > F.col("low"), 32767.0 / (F.col("high") - F.col("low"))).otherwise(F.lit(1.0))
    joined = df.join(bounds, by) if by else df.crossJoin(F.broadcast(bounds))  # one row
    coded = joined.withColumn("scale", scale)
    return coded.withColumn(out, ((F.coalesce(F.nanvl(value, "low"), F.col("low")) - F.col("low")) * F.col("scale")).cast("smallint")).drop("high")


def dequantize(code: Value, low: Value, scale: Value) -> Column:
    return c(code) / c(scale) + c(low)


def _bound(value: Column, body) -> Column:
    """body(value), with value evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k)


def hilbert_2d(x: Column, y: Column, order: int, unit_steps: bool = False) -> Column:
    """Index of a cell of a grid of 2^order cells a side, by Skilling's transform for two axes.

    From the highest bit down each axis reflects or swaps what lies below, then the bits are Gray coded
    and interleaved. With x in the lower bits the index is a bijection; with unit_steps x has the higher
    bits, and cells of neighbouring indices are neighbours. Bits are folded over, so the expression's
    size doesn't grow with the order.
    """

    def set_at(v: Column, high: Column) -> Column:
        return v.bitwiseAND(high) != 0

    def step(at: Column, k: Column) -> Column:
        high = _bit(k)
        below = high - 1
        turned = F.when(set_at(at["x"], high), at["x"].bitwiseXOR(below)).otherwise(at["x"])
        swap = turned.bitwiseXOR(at["y"]).bitwiseAND(below)
        reflect = set_at(at["y"], high)
        new_x = F.when(reflect, turned.bitwiseXOR(below)).otherwise(turned.bitwiseXOR(swap))
        return F.struct(new_x.alias("x"), F.when(reflect, at["y"]).otherwise(at["y"].bitwiseXOR(swap)).alias("y"))

    def grayed(at: Column) -> Column:
        coded = at["y"].bitwiseXOR(at["x"])
        flips = F.aggregate(
            F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("bigint"), lambda t, k: F.when(set_at(coded, _bit(k)), t.bitwiseXOR(_bit(k) - 1)).otherwise(t)
        )
        return F.struct(at["x"].bitwiseXOR(flips).alias("x"), coded.bitwiseXOR(flips).alias("y"))

    def woven(at: Column) -> Column:
        low, high = (at["y"], at["x"]) if unit_steps else (at["x"], at["y"])
        part = lambda v, k, odd: F.call_function("shiftleft", F.call_function("shiftright", v, k).bitwiseAND(F.lit(1).cast("bigint")), 2 * k + odd)
        return F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), F.lit(0).cast("bigint"), lambda index, k: index + part(low, k, 0) + part(high, k, 1))

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return _bound(_bound(F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), start, step), grayed), woven)


def to_channel(value: Value, low: float, high: float) -> Column:
    """0 to 255, truncated."""
    t = (c(value) - low) / (high - low) * 255
    return F.floor(F.least(F.greatest(t, F.lit(0.0)), F.lit(255.0))).cast("int")


def of_channel(channel: Value, low: float, high: float) -> Column:
    return low + c(channel) / 255 * (high - low)


def _bits(order: int, falling: bool = False) -> Column:
    return F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)) if falling else F.sequence(F.lit(0), F.lit(order - 1))


def _set(v: Column, high: Column) -> Column:
    return v.bitwiseAND(high) != 0


def _at(v: Column, k: Column) -> Column:
    return F.call_function("shiftright", v, k).bitwiseAND(F.lit(1).cast("bigint"))


def _put(bit: Column, k: Column) -> Column:
    return F.call_function("shiftleft", bit, k)


def _turn(axes: list[Column], k: Column, falling: bool) -> list[Column]:
    """One bit of Skilling's transform: each axis reflects the first below the bit, or swaps with it."""
    high = _bit(k)
    below = high - 1
    v = list(axes)
    for i in range(len(v)) if falling else reversed(range(len(v))):
        reflect = _set(v[i], high)
        if i == 0:
            v[0] = F.when(reflect, v[0].bitwiseXOR(below)).otherwise(v[0])
            continue
        swap = v[0].bitwiseXOR(v[i]).bitwiseAND(below)
        v[0], v[i] = F.when(reflect, v[0].bitwiseXOR(below)).otherwise(v[0].bitwiseXOR(swap)), F.when(reflect, v[i]).otherwise(v[i].bitwiseXOR(swap))
    return v


def _axes(at: Column, n: int) -> list[Column]:
    return [at[f"v{i}"] for i in range(n)]


def _named(v: list[Column]) -> Column:
    return F.struct(*[x.cast("bigint").alias(f"v{i}") for i, x in enumerate(v)])


def hilbert_index(axes: list[Column], order: int) -> Column:
    """Index of a cell of a grid of 2^order cells a side in any number of dimensions; the first axis has the lowest bits."""
    n = len(axes)

    def grayed(at: Column) -> Column:
        v = _axes(at, n)
        for i in range(1, n):
            v[i] = v[i].bitwiseXOR(v[i - 1])
        flips = F.aggregate(_bits(order, True), F.lit(0).cast("bigint"), lambda t, k: F.when(_set(v[n - 1], _bit(k)), t.bitwiseXOR(_bit(k) - 1)).otherwise(t))
        return _named([x.bitwiseXOR(flips) for x in v])

    def woven(at: Column) -> Column:
        return F.aggregate(_bits(order), F.lit(0).cast("bigint"), lambda index, k: index + sum((_put(_at(x, k), n * k + i) for i, x in enumerate(_axes(at, n))), F.lit(0).cast("bigint")))

    turned = F.aggregate(_bits(order, True), _named(axes), lambda at, k: _named(_turn(_axes(at, n), k, True)))
    return _bound(_bound(turned, grayed), woven)


def hilbert_cell(index: Column, order: int, n: int) -> Column:
    """The cell of an index, as a struct (v0, v1, ...): what hilbert_index undoes."""

    def every(i: int) -> Column:
        return F.aggregate(_bits(order), F.lit(0).cast("bigint"), lambda v, k: v + _put(_at(index.cast("bigint"), n * k + i), k))

    def ungrayed(at: Column) -> Column:
        v = _axes(at, n)
        last = F.call_function("shiftright", v[n - 1], F.lit(1))
        return _named([v[0].bitwiseXOR(last), *[v[i].bitwiseXOR(v[i - 1]) for i in range(1, n)]])

    start = _bound(_named([every(i) for i in range(n)]), ungrayed)
    return F.aggregate(F.sequence(F.lit(1), F.lit(order - 1)), start, lambda at, k: _named(_turn(_axes(at, n), k, False))) if order > 1 else start


def quantize_columns(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Each column as a 16-bit code with its group's low and scale: columns code_x, low_x, scale_x; the values go."""
    out = df
    for x in columns:
        out = quantize_int16(out, x, by, f"code_{x}").withColumnsRenamed({"low": f"low_{x}", "scale": f"scale_{x}"})
    return out.drop(*columns)


def dequantize_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    values = {x: dequantize(f"code_{x}", f"low_{x}", f"scale_{x}") for x in columns}
    return df.withColumns(values).drop(*[f"{part}_{x}" for x in columns for part in ("code", "low", "scale")])
