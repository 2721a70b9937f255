"""Severities, scores and verdicts as Columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from kartei.settings import FAMILIES, OTHER_WEIGHT, VERDICT_FLOORS, VERDICTS, WEIGHTS


def ramp(value: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high, linear between; a step where high <= low."""
    if high <= low:
        return F.when(value >= high, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def weight_of(code: Column, weights: Mapping[str, float] = WEIGHTS) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, weight in sorted(weights.items()):
        out = out.when(code == name, float(weight))
    return out.otherwise(OTHER_WEIGHT)


def family_of(code: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, family in sorted(FAMILIES.items()):
        out = out.when(code == name, family)
    return out.otherwise(code)


def contribution(code: Column, severity: Column, weights: Mapping[str, float] = WEIGHTS) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), severity))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.999), weight_of(code, weights) * clamped))


def verdict(score: Column) -> Column:
    """0 tidy to 3 chaotic."""
    out = F.lit(0)
    for level, floor in enumerate(VERDICT_FLOORS[1:], 1):
        out = F.when(score >= floor, level).otherwise(out)
    return out


def verdict_label(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VERDICTS)), level + 1)


def smoothstep(progress: Column) -> Column:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress))
    return p * p * (3.0 - 2.0 * p)


def channel_mix(text: Column, name: Column, textual: Column, thin: float = 0.45, rich: float = 0.75, scale: int = 120) -> Column:
    """struct(text, name, kind): how much each channel counts; see the cases below."""
    has_text = F.regexp_replace(text, r"[\s\p{Z}]+", "") != ""
    has_name = F.trim(name) != ""
    grown = smoothstep(F.length(text) / F.lit(float(max(1, scale))))

    def blend(a: float, b: float) -> Column:
        return F.lit(a) + grown * (b - a)

    def mix(t: Column, n: Column, k: Column) -> Column:
        return F.struct(t.alias("text"), n.alias("name"), k.alias("kind"))

    described = mix(F.lit(0.85), F.lit(0.15), F.lit(0.0))  # words that describe a binary file
    written = mix(blend(thin, rich), blend((1 - thin) * 8 / 11, (1 - rich) * 4 / 5), blend((1 - thin) * 3 / 11, (1 - rich) / 5))
    named = mix(F.lit(0.0), F.lit(0.8), F.lit(0.2))
    bare = mix(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    words = text.rlike(r"[\p{L}\p{Nl}\p{No}]{3,}")
    return F.when(has_text & ~textual & words, described).when(has_text, written).when(has_name, named).otherwise(bare)
