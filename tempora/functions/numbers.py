"""Numbers of sound and of pages as expressions: levels, samples, limits, profiles, keys, times."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from tempora.operators import series


def decibels(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-9)))


def amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def root_mean_square(samples: Column) -> Column:
    """Of an array of samples; of none about 0."""
    squares = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(F.when(F.size(samples) > 0, squares / F.size(samples)).otherwise(0.0) + 1e-18)


def sample_of(t: Column, sr: int) -> Column:
    """The sample at a time; halves go to the even one."""
    return F.rint(t * sr).cast("long")


def stretch_of(samples: Column, start: Column, end: Column, sr: int) -> Column:
    """The samples from one time to another."""
    a, b = sample_of(start, sr), sample_of(end, sr)
    return F.slice(samples, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int"))


def fitted(samples: Column, n: Column) -> Column:
    """The first ``n`` samples, with zeros where there are fewer."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), n - F.size(samples)).cast("int"))), F.lit(1), n.cast("int"))


def limited(x: Column, ceiling: float = 0.97, knee: float = 0.8) -> Column:
    """A sample bent smoothly so that it never reaches the ceiling; unchanged up to the knee's share of it."""
    low, size = knee * ceiling, F.abs(x)
    return F.when(size <= low, x).otherwise(F.signum(x) * (low + (ceiling - low) * F.tanh((size - low) / (ceiling - low))))


def rising(p: Column) -> Column:
    """From 0 to 1 over the first 30 % of a stretch, smoothly."""
    up = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p / 0.30))
    return up * up * (3 - 2 * up)


def tempo_weight(p: Column, fast: bool) -> Column:
    """How strongly tempo changes at a place of a stretch: rushing eases out towards its end, dragging holds."""
    out = 0.6 + 0.4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - p) / 0.20))
    return rising(p) * out if fast else 0.35 + 0.65 * rising(p)


def pitch_limits(median_hz: Column, seconds: Column | None = None) -> tuple[Column, Column]:
    """Lowest and highest pitch to look for around a speaker's median; a short sound has no low ones."""
    low = F.greatest(F.lit(60.0), 0.55 * median_hz)
    low = low if seconds is None else F.greatest(low, 3.3 / seconds)
    return low, F.greatest(F.least(F.lit(600.0), 2.4 * median_hz), 2 * low)


def without_octaves(value: str, keys: list[str], order: list[str], most: float = 0.20) -> Column:
    """A pitch track without points that stray from the median of the seven around them."""
    usual = series.median_around(value, keys, order, 3, 3)
    return F.when(F.abs(F.col(value) / F.greatest(usual, F.lit(1.0)) - 1) > most, usual).otherwise(F.col(value))


def shown(v: Column, digits: int = 3) -> Column:
    """A number for a page: rounded, null where it is none."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.round(v, digits))


def request_key(*options: Column) -> Column:
    """A key for equal requests: 20 digits of a hash of the options in order of their names."""
    return F.substring(F.sha2(F.to_json(F.struct(*options)), 256), 1, 20)


def iso_time(t: Column) -> Column:
    """A time of the session's zone to the second, as ISO."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
