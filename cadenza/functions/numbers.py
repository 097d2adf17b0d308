"""Numbers, times and their text forms as Column expressions. Rounding is half to even on the fraction, as `rint` does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-9
#: Seconds that a cue is shown beyond what reading takes.
READING_MARGIN = 0.002


def ticks(seconds: Column, per_second: int = 1000) -> Column:
    whole = F.floor(seconds)
    return (whole * per_second + F.rint((seconds - whole) * per_second)).cast("long")


def clock(tick: Column, per_second: int = 1000, separator: str = ",") -> Column:
    """hh:mm:ss,mmm; hours may have more digits."""
    s = F.floor(tick / per_second).cast("long")
    digits = len(str(per_second)) - 1
    return F.format_string(f"%02d:%02d:%02d{separator}%0{digits}d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60, tick % per_second)


def ass_clock(tick: Column) -> Column:
    """h:mm:ss.cc of hundredths."""
    s = F.floor(tick / 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60, tick % 100)


def parse_clock(text: Column, separator: str = ",", digits: int = 3) -> Column:
    """Ticks of hh:mm:ss,mmm, or null."""
    pattern = rf"^(\d+):([0-5]\d):([0-5]\d)[{separator}](\d{{{digits}}})$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("long")
    return F.when(text.rlike(pattern), ((part(1) * 60 + part(2)) * 60 + part(3)) * 10**digits + part(4))


def parse_duration(text: Column) -> Column:
    """Seconds of 'h:m:s', a number, or null for anything else."""
    t = F.trim(text)
    parts = F.split(t, ":")
    at = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    value = F.when(F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2)).otherwise(t.try_cast("double"))
    return F.when((value >= 0) & ~F.isnan(value) & (value < float("inf")), value)


def required_display(chars: Column, cps: float = 17.0, least: float = 0.8) -> Column:
    return F.greatest(F.lit(least), chars / F.lit(cps)) + READING_MARGIN


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(TOLERANCE))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def progress(percent: Column) -> Column:
    """A stage's percent on the scale of the whole job."""
    return (20 + 0.65 * clamp(percent, 0.0, 100.0)).cast("int")


def optional_int(text: Column) -> Column:
    """A whole number between blanks, or null."""
    return F.trim(text).try_cast("long")


def one_decimal(x: Column) -> Column:
    """A finite number with one decimal as printf writes it: its exact binary value, half to even; format_string rounds ties up.

    Ten times the fraction is 8 f + 2 f, both exact, so that what their sum lost in rounding is known.
    """
    size = F.abs(x)
    f = size - F.floor(size)
    tenfold = f * 8 + f * 2
    lost = f * 2 - (tenfold - f * 8)
    half = (tenfold - F.floor(tenfold) == 0.5) & (lost != 0)
    tenths = (F.floor(size) * 10 + F.when(half, F.floor(tenfold) + (lost > 0).cast("int")).otherwise(F.rint(tenfold))).cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def human_bytes(n: Column) -> Column:
    """One decimal, steps of 1024."""
    step, unit = F.lit(1024.0**4), F.lit(" TB")
    for k, name in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        small = n < 1024.0 ** (k + 1)
        step, unit = F.when(small, F.lit(1024.0**k)).otherwise(step), F.when(small, F.lit(f" {name}")).otherwise(unit)
    return F.concat(one_decimal(n / step), unit)


def size_reserve(n: Column, ratio: float = 0.1, floor: int = 1 << 20) -> Column:
    return F.greatest(F.lit(floor).cast("long"), F.ceil(n * ratio).cast("long"))


def utc_text(ts: Column) -> Column:
    """ISO 8601 with six decimals and Z, whose order is that of time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def valid_interval(start: Column, end: Column) -> Column:
    finite = ~F.isnan(start) & ~F.isnan(end) & (F.abs(start) < float("inf")) & (F.abs(end) < float("inf"))
    return finite & (start >= 0) & (end > start)
