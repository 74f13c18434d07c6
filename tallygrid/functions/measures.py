"""Numeric expressions of media features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reference intensity, the floor of levels in dBFS, and the level of silence: fixed values.
INTENSITY_0, FLOOR_DBFS, SILENCE_DBFS = 1e-12, -120.0, -80.0


def intensity_db(x: Column) -> Column:
    """Intensity in dB (M2); 0 for none."""
    return F.when(x <= 0, 0.0).otherwise(10 * F.log10(x / INTENSITY_0))


def dbfs(x: Column) -> Column:
    """Amplitude in dB of full scale with a floor (M3)."""
    return F.when(x > 0, F.greatest(F.lit(FLOOR_DBFS), 20 * F.log10(x))).otherwise(FLOOR_DBFS)


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """``#RRGGBB`` (M4)."""
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def hex_luminance(code: Column) -> Column:
    """Luminance of ``#RRGGBB`` from 0 to 255 (M5); 128 for anything else."""
    digits = F.ltrim(code, F.lit("#"))

    def part(k: int) -> Column:
        return F.conv(F.substring(digits, k, 2), 16, 10).cast("double")

    return F.when(digits.rlike("^[0-9a-fA-F]{6}$"), 0.299 * part(1) + 0.587 * part(3) + 0.114 * part(5)).otherwise(128.0)


def should_invert(code: Column, dark: Column) -> Column:
    """Whether a dark style or background asks for the light logo (M5)."""
    return F.coalesce(dark, F.lit(False)) | (hex_luminance(code) < 128)


def overlay_box(width: Column, height: Column, ratio: Column, corner: Column) -> Column:
    """Struct ``x``, ``y``, ``w``, ``h`` of a logo in a corner (M6): 6 % of the width, a third
    of its height as padding, half a percent as margin."""
    w = F.floor(width * 0.06)
    h = F.floor(w * ratio)
    margin = F.floor(width * 0.005) + F.floor(h * 0.33)
    right, bottom = F.contains(corner, F.lit("right")), F.contains(corner, F.lit("bottom"))
    return F.struct(F.when(right, width - w - margin).otherwise(margin).alias("x"), F.when(bottom, height - h - margin).otherwise(margin).alias("y"), w.alias("w"), h.alias("h"))


def scene_frames(first: Column, last: Column, mode: str = "middle", n: int = 3) -> Column:
    """Frames to take of a scene (M7): its middle, its two ends, or ``n`` evenly spaced."""
    if mode == "middle":
        return F.array(F.floor((first + last) / 2).cast("long"))
    if mode == "boundaries":
        return F.array_distinct(F.array(first.cast("long"), last.cast("long")))
    if n < 2:
        return scene_frames(first, last, "middle")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (first + F.rint(k * (last - first) / (n - 1))).cast("long")))


def hue_mean(hue: Column) -> Column:
    """Circular mean of hues in degrees (M8), an aggregate."""
    angle = F.degrees(F.atan2(F.avg(F.sin(F.radians(hue))), F.avg(F.cos(F.radians(hue)))))
    return F.pmod(angle + 360, F.lit(360.0))


def hue_deviation(hue: Column) -> Column:
    """Circular standard deviation of hues in degrees (M8), an aggregate."""
    r = F.sqrt(F.pow(F.avg(F.sin(F.radians(hue))), 2) + F.pow(F.avg(F.cos(F.radians(hue))), 2))
    return F.when(r >= 1, 0.0).otherwise(F.degrees(F.sqrt(-2 * F.log(F.greatest(r, F.lit(1e-10))))))


def signal_status(rms_dbfs: Column, threshold: float = SILENCE_DBFS) -> Column:
    """``ok`` or ``silent_or_near_silent``."""
    return F.when(rms_dbfs > threshold, "ok").otherwise("silent_or_near_silent")
