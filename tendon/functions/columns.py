"""Column expressions over arrays of numbers, with the results that a numeric library gives at the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def once(x: Column) -> Column:
    """``x`` computed once per row: a plain column may be put into the lambdas that use it and be computed per entry."""
    return F.explode(F.array(x))


def split(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row of ``episode_id``, ``t`` and the struct ``x`` for each of the named structs that isn't null.

    The structs are columns of a projection of their own beside a lambda, which keeps them out of whole-stage code: its
    one method would be too large to compile, while a plain projection is compiled in small ones. The explosion is an outer one, as
    from others Spark infers a filter that makes the structs a second time.
    """
    made = rows.select("episode_id", "t", *(x.alias(n) for n, x in named.items()), F.exists(F.array("t"), lambda v: v >= 0).alias("own"))
    return made.select("episode_id", "t", F.explode_outer(F.when(F.col("own"), F.array(*named))).alias("x")).where("x is not null")


def safe_div(a: Column, b: Column, otherwise: float = float("inf")) -> Column:
    """a / b where b is above zero."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(otherwise))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def sum_sq(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def max_abs(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(x: Column) -> Column:
    return F.sqrt(sum_sq(x))


def all_finite(x: Column) -> Column:
    return F.forall(x, finite)


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < float("inf"))


def clipped_acos(x: Column) -> Column:
    return F.acos(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))


def quat_angle(a: Column, b: Column) -> Column:
    """Degrees between two rotations given as quaternions of any length but zero."""
    na, nb = norm(a), norm(b)
    return F.degrees(2 * clipped_acos(safe_div(F.abs(dot(a, b)), na * nb, 1.0)))


def rms(sum_of_squares: Column, n: Column) -> Column:
    """Root mean square from sums; 0 of nothing."""
    return F.sqrt(safe_div(sum_of_squares, n, 0.0))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate correlation; null where a side is constant or has fewer than two values."""
    n = F.count(x * y)
    sx, sy, sxx, syy, sxy = F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    small = 1e-12
    return F.when((n > 1) & (vx > small) & (vy > small), (n * sxy - sx * sy) / F.sqrt(F.when(vx > small, vx) * F.when(vy > small, vy)))


def slug(x: Column) -> Column:
    """Small letters and digits joined by underscores, "x" if there are none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.lit("x"))


def normal_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), r"[\s\-]+", "_")


def significant(x: Column, digits: int = 4) -> Column:
    """Rounded to so many significant digits; what isn't finite stays as it is."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.when(x != 0, F.abs(x)))))
    return F.when(~finite(x) | (x == 0), x).otherwise(F.round(x * scale) / scale)


def significant_text(x: Column, digits: int = 4) -> Column:
    """As ``significant`` in text; what isn't finite by its name."""
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(significant(x, digits).cast("string"))


def resolved_path(base: Column, path: Column) -> Column:
    """``base/path`` without empty, "." and ".." segments; null if it climbs above the root."""
    parts = F.split(F.concat_ws("/", base, path), "/")
    start = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array(F.lit("\0")))
        return F.when((x == "") | (x == "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    folded = F.aggregate(parts, start, step)
    return F.when(~F.array_contains(folded, "\0"), F.array_join(folded, "/"))
