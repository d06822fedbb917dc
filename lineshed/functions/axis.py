"""Spectra as arrays: axis operators, validation, index arithmetic and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineshed.functions.lineshape import Value, c


def points(energy: Value, intensity: Value) -> Column:
    """Both arrays as an array of (e, i)."""
    return F.transform(F.arrays_zip(c(energy).alias("e"), c(intensity).alias("i")), lambda p: F.struct(p[0].alias("e"), p[1].alias("i")))


def window(pairs: Column, low: Value, high: Value) -> Column:
    """The points whose energy lies between both bounds, these included."""
    return F.filter(pairs, lambda p: (p["e"] >= c(low)) & (p["e"] <= c(high)))


def ascending(values: Column, energy: Column) -> Column:
    """The array turned if the axis falls."""
    return F.when(energy[0] > F.element_at(energy, -1), F.reverse(values)).otherwise(values)


def other_axis(energy: Column, photon_energy: Value) -> Column:
    """Binding to kinetic energy and back; an unknown photon energy is an error, not a zero."""
    hv = c(photon_energy)
    return F.when(hv.isNull(), F.raise_error(F.lit("photon energy is not known"))).otherwise(F.transform(energy, lambda x: hv - x))


def normalise(intensity: Column, method: str = "max", energy: Column | None = None) -> Column:
    """max, minmax, or area (by the size of the trapezoid, so that a falling axis keeps the sign)."""
    if method == "max":
        return F.transform(intensity, lambda x: x / F.array_max(intensity))
    if method == "minmax":
        low, high = F.array_min(intensity), F.array_max(intensity)
        return F.transform(intensity, lambda x: (x - low) / (high - low))
    if method == "area" and energy is not None:
        return F.transform(intensity, lambda x: x / F.abs(trapezoid(energy, intensity)))
    raise ValueError(f"unknown method {method}")


def trapezoid(energy: Column, intensity: Column) -> Column:
    """Signed trapezoid area of two arrays."""
    steps = F.zip_with(F.slice(energy, 2, F.greatest(F.size(energy) - 1, F.lit(0))), F.slice(energy, 1, F.greatest(F.size(energy) - 1, F.lit(0))), lambda b, a: b - a)
    means = F.zip_with(F.slice(intensity, 2, F.greatest(F.size(intensity) - 1, F.lit(0))), F.slice(intensity, 1, F.greatest(F.size(intensity) - 1, F.lit(0))), lambda b, a: (a + b) / 2)
    return F.aggregate(F.zip_with(steps, means, lambda s, m: s * m), F.lit(0.0), lambda acc, x: acc + x)


def valid(energy: Column, intensity: Column) -> Column:
    """At least 3 points, equal lengths, no null or NaN, strictly monotonic axis."""
    n = F.size(energy)
    steps = F.zip_with(F.slice(energy, 2, F.greatest(n - 1, F.lit(1))), F.slice(energy, 1, F.greatest(n - 1, F.lit(1))), lambda b, a: b - a)
    finite = lambda a: F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x))
    monotonic = F.forall(steps, lambda d: d > 0) | F.forall(steps, lambda d: d < 0)
    return F.coalesce((n >= 3) & (n == F.size(intensity)) & finite(energy) & finite(intensity) & monotonic, F.lit(False))


def preview(values: Column, step: int) -> Column:
    """Every step-th value."""
    return F.filter(values, lambda x, k: k % step == 0)


def encode_index(angle: Value, y: Value, x: Value, t: Value, n_angle: int, n_y: int, n_x: int) -> Column:
    """The flat index of four coordinates; the angle cycles fastest."""
    a, yy, xx, tt = (F.col(v) if isinstance(v, str) else v for v in (angle, y, x, t))
    return (a + n_angle * (yy + n_y * (xx + n_x * tt))).cast("bigint")


def decode_index(index: Column, n_angle: int, n_y: int, n_x: int) -> dict[str, Column]:
    """The coordinates of a flat index."""

    def div(v: Column, n: int) -> Column:
        return F.floor(v / n).cast("bigint")

    rest = div(index, n_angle)
    rest_x = div(rest, n_y)
    return {"angle_idx": (index % n_angle).cast("bigint"), "y": (rest % n_y).cast("bigint"), "x": (rest_x % n_x).cast("bigint"), "t": div(rest_x, n_x)}


def element_of(label: Column) -> Column:
    """The element symbol that a label such as Si2p3/2 starts with."""
    return F.regexp_extract(label, r"^([A-Z][a-z]?)\d[spdfg]", 1)


def orbital_of(label: Column) -> Column:
    return F.regexp_extract(label, r"^[A-Z][a-z]?(\d[spdfg](?:\d/2)?)", 1)


# The line with the higher j, which a label without j means.
MAIN_J = {"p": "3/2", "d": "5/2", "f": "7/2"}


def main_orbital(orbital: Column) -> Column:
    """2p becomes 2p3/2; an s orbital or one with j stays."""
    out = orbital
    for letter, j in MAIN_J.items():
        out = F.when(orbital.rlike(f"^[0-9]{letter}$"), F.concat(orbital, F.lit(j))).otherwise(out)
    return out


def safe_name(name: Column) -> Column:
    """Usable as a file name: separators become _, leading dots go."""
    return F.regexp_replace(F.regexp_replace(name, r"[\\/:*?\"<>|]", "_"), r"^\.+", "")


def dedup_names(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """The second and later bearers of a name get _2, _3, ... in the given order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string"))))


def end_means(intensity: Column, share: float = 0.1) -> tuple[Column, Column]:
    """The means of the first and the last tenth of the points, one point at least."""
    n = F.greatest(F.floor(F.size(intensity) * share).cast("int"), F.lit(1))
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x) / n
    return mean(F.slice(intensity, F.lit(1), n)), mean(F.slice(intensity, -n, n))
