"""Settings, filter chains and captions as column expressions.

Formats of the strings are fixed values that players and readers expect.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that switch something off, by setting.
OFF = {"bandlimit": ("0", "off", "false", "no"), "pass": ("0", "off", "none", "false"), "loudness": ("0", "off", "false", "none"), "flag": ("", "0", "false", "no", "off")}
# Parts of filter chains.
LOUDNESS, BANDLIMIT, LIMITER = "speechnorm=p=0.95:e=12.5:c=2:t=0.02", "highpass=f=150,lowpass=f=3800", "alimiter=limit=0.95"


def off(value: Column, kind: str) -> Column:
    return F.lower(F.trim(value)).isin(*OFF[kind])


def flag(value: Column, missing: bool = False) -> Column:
    """Truth of a setting's text; NULL is ``missing``."""
    return F.coalesce(~off(value, "flag"), F.lit(missing))


def as_double(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))


def as_int(value: Column, default: int) -> Column:
    return F.coalesce(value.try_cast("double").cast("int"), F.lit(default))


def clamped(value: Column, low: float, high: float, places: int) -> Column:
    """A number held to its range and rounded half to even; no number: NULL."""
    v = F.bround(F.least(F.greatest(value.try_cast("double"), F.lit(float(low))), F.lit(float(high))), places)
    return v.cast("int") if places == 0 else v


def notch(center: Column, width: Column, low: Column, high: Column) -> Column:
    """A band-reject filter; NULL for a malformed band."""
    ranged = low.isNotNull() & high.isNotNull()
    f = F.when(ranged, (low + high) / 2).otherwise(center)
    w = F.when(ranged, high - low).otherwise(F.coalesce(width, F.lit(20.0)))
    return F.when((f > 0) & (w > 0), F.format_string("bandreject=f=%.1f:t=h:w=%.1f", f, w))


def repeated(prefix: str, frequency: Column, stages: Column) -> Column:
    """One to four equal stages of a pass filter, none if switched off."""
    n = F.least(F.greatest(as_int(stages, 1), F.lit(1)), F.lit(4))
    part = F.concat(F.lit(f"{prefix}=f="), F.trim(frequency))
    return F.when((F.trim(frequency) != "") & ~off(frequency, "pass"), F.array_repeat(part, n)).otherwise(F.array().cast("array<string>"))


def monitor_chain(notches: Column, high: Column, high_stages: Column, low: Column, low_stages: Column, gain: Column) -> Column:
    """Notches, high passes, low passes, gain unless 0, limiter."""
    volume = F.when(gain != 0, F.array(F.concat(F.lit("volume="), gain.cast("string"), F.lit("dB")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(notches, repeated("highpass", high, high_stages), repeated("lowpass", low, low_stages), volume, F.array(F.lit(LIMITER))), ",")


def talk_chain(loudness: Column, band: Column, gain: Column, mute: Column) -> Column:
    """Loudness, band limit, gain, mute last; nothing at all: zero gain."""
    level = F.coalesce(F.trim(loudness), F.lit(""))
    limit = F.coalesce(F.trim(band), F.lit(BANDLIMIT))
    volume = F.coalesce(F.nullif(F.trim(gain), F.lit("")), F.lit("-15"))
    parts = F.array_compact(F.array(
        F.when(~off(level, "loudness"), F.coalesce(F.nullif(level, F.lit("")), F.lit(LOUDNESS))),
        F.when((limit != "") & ~off(limit, "bandlimit"), limit),
        F.when(volume != "0", F.concat(F.lit("volume="), volume, F.lit("dB"))),
        F.when(F.lower(F.trim(mute)).isin("1", "on", "true", "yes"), F.lit("volume=0")),
    ))
    return F.coalesce(F.nullif(F.array_join(parts, ","), F.lit("")), F.lit("volume=0dB"))


def escaped(text: Column) -> Column:
    """HTML-safe text."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def identity(sources: list[Column], defaults: tuple[str, str, str]) -> Column:
    """``struct(product, short, link)``: the first of ``sources`` that is there; its
    lines without blank ones, in order; a missing line has its default."""
    lines = F.filter(F.transform(F.split(F.coalesce(*sources), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(*[F.coalesce(F.get(lines, F.lit(k)), F.lit(d)).alias(name) for k, (name, d) in enumerate(zip(("product", "short", "link"), defaults, strict=True))])
