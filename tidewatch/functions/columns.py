"""Column expressions. Everything here stays inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c) -> Column:
    """NaN marks a missing value in the sources; NULL marks it here."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def ratio(num, den) -> Column:
    """Quotient that is NULL for a zero or missing denominator."""
    return F.try_divide(col(num), col(den))


def hash_text(*parts) -> Column:
    """Reproducible pseudo-random text: the MD5 of the parts joined by ':'."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_int(*parts) -> Column:
    """The first eight hex digits of hash_text as an integer below 2**32."""
    return F.conv(F.substring(hash_text(*parts), 1, 8), 16, 10).cast("long")


def hash_long(*parts) -> Column:
    """The first fifteen hex digits of hash_text as an integer below 2**60: its remainder by any row count is nearly uniform."""
    return F.conv(F.substring(hash_text(*parts), 1, 15), 16, 10).cast("long")


def hash_cell(hash_column, digits: int = 2) -> Column:
    """Monotone, uniform cell number of a hash text, used to split hot groups."""
    return F.conv(F.substring(col(hash_column), 1, digits), 16, 10).cast("long")


def clip(c, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), col(c)))


def signed_sqrt(c) -> Column:
    c = col(c)
    return F.signum(c) * F.sqrt(F.abs(c))


def asinh_scaled(c, scale: float) -> Column:
    return F.asinh(col(c) / F.lit(float(scale)))


def expit(c) -> Column:
    return 1.0 / (1.0 + F.exp(-col(c)))


def sinc_squared(j, n: int) -> Column:
    """Power response of a boxcar bin at Fourier index j of n; 1 at j = 0."""
    x = col(j) * F.lit(math.pi / n)
    return F.when(col(j) == 0, F.lit(1.0)).otherwise(F.pow(F.sin(x) / x, F.lit(2.0)))


def sep_deg(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle separation in degrees with the cosine clipped to [-1, 1]."""
    ra1, dec1, ra2, dec2 = (F.radians(col(c)) for c in (ra1, dec1, ra2, dec2))
    cosine = F.sin(dec1) * F.sin(dec2) + F.cos(dec1) * F.cos(dec2) * F.cos(ra1 - ra2)
    return F.degrees(F.acos(clip(cosine, -1.0, 1.0)))


def two_threshold_state(x, low: float, high: float, names=("soft-like", "intermediate", "hard-like")) -> Column:
    """Three classes by two cuts; a missing value is 'unknown'."""
    x = col(x)
    return (
        F.when(x.isNull(), "unknown").when(x > high, names[2]).when(x < low, names[0]).otherwise(names[1])
    )


def step_bin(x, breaks) -> Column:
    """Number of break points at or below x."""
    out = F.lit(0)
    for b in breaks:
        out = out + (col(x) >= F.lit(float(b))).cast("int")
    return out


def normalised_difference(a, b) -> Column:
    a, b = col(a), col(b)
    return F.try_divide(b - a, b + a)


def shape(arr) -> Column:
    """Every element over the total of its vector."""
    total = F.aggregate(col(arr), F.lit(0.0), lambda s, x: s + x)
    return F.transform(col(arr), lambda x: F.try_divide(x, total))


def epoch_seconds(ts) -> Column:
    """Seconds since 1970-01-01 of a timestamp (session time zone UTC)."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1e6)


def mjd(ts) -> Column:
    """Modified Julian date of a timestamp; 40587 is the date of the Unix epoch."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(86400e6) + F.lit(40587.0)


def fixed_text(c, digits: int) -> Column:
    """Fixed-point text without grouping separators."""
    return F.format_string(f"%.{digits}f", col(c))
