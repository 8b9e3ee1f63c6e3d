"""Column functions over numbers, times and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stamp(x: Column | str) -> Column:
    """yyyyMMdd-HHmmss text to "yyyy-MM-dd HH:mm:ss"; NULL if it is none."""
    return F.date_format(F.try_to_timestamp(_c(x), F.lit("yyyyMMdd-HHmmss")), "yyyy-MM-dd HH:mm:ss")


def iso_folder(x: Column | str) -> Column:
    """dd-MM-yyyy anywhere in a path to yyyy-MM-dd."""
    return F.regexp_replace(_c(x), r"(\d\d)-(\d\d)-(\d{4})", "$3-$2-$1")


def comma_decimal(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit(","), F.lit(".")).try_cast("double")


def minute_tag(seconds: Column | str) -> Column:
    """mm:ss; the seconds are rounded (half to even) after the minutes are taken, so ":60" can appear."""
    s = _c(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), F.bround(s % 60, 0).cast("long"))


def time_bin(share: Column | str) -> Column:
    s = _c(share)
    return F.when(s.isNull() | F.isnan(s), "unknown").when((s >= 0) & (s <= 0.15), "early").when((s >= 0) & (s <= 0.65), "mid").otherwise("late")


def minutes_seconds(seconds: Column | str) -> Column:
    """75 s as 1.15."""
    s = F.floor(_c(seconds))
    return F.floor(s / 60) + (s % 60) / 100.0


def ratio(x: Column | str) -> Column:
    """"74%", "74" and "0.74" are 0.74; anything else is NULL."""
    c = F.trim(_c(x))
    v = F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), "%$", "").try_cast("double")
    return F.when(c.endswith("%") | (v > 1), v / 100).otherwise(v)


def finite(x: Column | str, other: float | None = 0.0) -> Column:
    """NULL, NaN and infinities become other."""
    c = _c(x)
    good = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(good, c).otherwise(F.lit(other).cast("double"))


def speed_class(wpm: Column | str) -> Column:
    w = _c(wpm)
    return F.when(w < 120, "low").when(w < 250, "mid").otherwise("high")


def volume_class(level: Column | str) -> Column:
    v = _c(level)
    return F.when(v < 0.25, "low").when(v < 0.6, "mid").otherwise("high")


def level_class(db: Column | str) -> Column:
    d = _c(db)
    return F.when(d < -45, "low").when(d < -20, "mid").otherwise("high")


def level_share(db: Column | str) -> Column:
    """-80..0 dB to 0..1."""
    return F.least(F.greatest((_c(db) + 80) / 80, F.lit(0.0)), F.lit(1.0))


def linear_ratio(x: Column | str, top: float) -> Column:
    return F.least(_c(x) / top, F.lit(1.0))


def machines(files: Column | str, ladder: tuple[tuple[int, int], ...] = ((600, 1), (1200, 2), (1800, 3)), most: int = 4) -> Column:
    n, out = _c(files), None
    for below, count in ladder:
        out = F.when(n < below, count) if out is None else out.when(n < below, count)
    return out.otherwise(most)


def two_means(values: Column | str, rounds: int = 20) -> Column:
    """For an array of numbers, 1 where a value is nearer to the upper of two centres, else 0. Centres start at the 20th and 80th percentile and move to the means of their values until one has none."""
    v = F.transform(F.col(values) if isinstance(values, str) else values, lambda x: x.cast("double"))
    n = F.size(v)

    def percentile(p: float) -> Column:
        place = (n - 1) * F.lit(p)
        low, ordered = F.floor(place).cast("int"), F.sort_array(v)
        a, b = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, n))
        return a + (b - a) * (place - low)

    upper = lambda x, c: F.abs(x - c["b"]) < F.abs(x - c["a"])

    def step(c: Column, _: Column) -> Column:
        sums = F.aggregate(v, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda t, x: F.when(upper(x, c), F.array(t[0] + x, t[1] + 1, t[2])).otherwise(F.array(t[0], t[1], t[2] + x)))
        moved = F.transform(F.array(sums), lambda t: F.when((t[1] > 0) & (t[1] < n), F.struct((t[2] / F.nullif(n - t[1], F.lit(0.0))).alias("a"), (t[0] / F.nullif(t[1], F.lit(0.0))).alias("b"))).otherwise(F.struct(c["a"].alias("a"), c["b"].alias("b"))))
        return moved[0]

    centres = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(percentile(0.2).alias("a"), percentile(0.8).alias("b")), step)
    labelled = F.transform(F.array(centres), lambda c: F.transform(v, lambda x: upper(x, c).cast("int")))[0]
    return F.when(n > 0, labelled).otherwise(F.transform(v, lambda x: F.lit(0)))
