"""Planes of decoded frames: amplitude, phase and the ratio of the two chains, as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def amplitude_db(re: str, im: str) -> Column:
    """20 log10 |z|; null where a sample is zero (guard bins)."""
    return F.zip_with(re, im, lambda a, b: F.when((a != 0) | (b != 0), 10 * F.log10((a * a + b * b).cast("double"))))


def phase(re: str, im: str) -> Column:
    return F.zip_with(re, im, lambda a, b: F.when((a != 0) | (b != 0), F.atan2(b.cast("double"), a.cast("double"))))


def planes(frames: DataFrame) -> DataFrame:
    """``frames`` with amp, phase, ratio_amp (dB) and ratio_phase (chain 1 over chain 0); null arrays where a chain is missing."""
    df = frames.withColumns({"amp": amplitude_db("re0", "im0"), "phase": phase("re0", "im0"), "_amp1": amplitude_db("re1", "im1"), "_phase1": phase("re1", "im1")})
    turn = lambda a, b: F.pmod(b - a + math.pi, F.lit(2 * math.pi)) - math.pi
    return df.withColumns({"ratio_amp": F.zip_with("amp", "_amp1", lambda a, b: b - a), "ratio_phase": F.zip_with("phase", "_phase1", turn)}).drop("_amp1", "_phase1")


def ratio_cells(frames: DataFrame, *keep: str) -> DataFrame:
    """keep, sc, ratio_amp: a row for each subcarrier of a frame where both chains have samples; `planes` by rows instead of arrays."""
    power = lambda a, b: F.when((F.col(a) != 0) | (F.col(b) != 0), 10 * F.log10((F.col(a) * F.col(a) + F.col(b) * F.col(b)).cast("double")))
    others = ("im0", "re1", "im1")
    cells = frames.select(*keep, *(F.col(c).alias(f"_{c}") for c in others), F.posexplode("re0").alias("sc", "re0"))
    cells = cells.select(*keep, "sc", "re0", *(F.get(f"_{c}", F.col("sc")).alias(c) for c in others))
    return cells.select(*keep, "sc", (power("re1", "im1") - power("re0", "im0")).alias("ratio_amp")).where("ratio_amp IS NOT NULL")


def rate_words(flags: Column) -> tuple[Column, Column]:
    """Format (bits 8-10) and width in MHz (bits 11-13) of rate flags; unknown codes say so."""
    # Formats and widths by code.
    formats = ("CCK", "LEGACY_OFDM", "HT", "VHT", "HE", "EHT")
    widths = ("20", "40", "80", "160", "320")
    pick = lambda words, shift: F.coalesce(F.get(F.array(*map(F.lit, words)), F.shiftright(flags, shift).bitwiseAND(7).cast("int")), F.lit("unknown"))
    return pick(formats, 8), pick(widths, 11)
