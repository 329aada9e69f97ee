"""Scores as column arithmetic. ``now`` and other times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


#: Days in which the recency of a kind of fact halves; other kinds take OTHER_HALF_LIFE.
HALF_LIFE = {"identity": 730.0, "explicit": 365.0, "project": 120.0}
OTHER_HALF_LIFE = 240.0


def recency(kind: Column, updated: Column, now: Column) -> Column:
    """0.5 ^ (age in days / half-life of the kind)."""
    life = F.lit(OTHER_HALF_LIFE)
    for name, days in HALF_LIFE.items():
        life = F.when(kind == name, days).otherwise(life)
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (now - updated) / DAY_MS) / life)


def frequency(accesses: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(accesses.cast("double")) / F.log(F.lit(21.0)))


def temporal_alignment(mode: str, status: Column) -> Column:
    """How well a row's state fits the asked time: past (historical), present (current) or any (all)."""
    if mode == "historical":
        return F.when(status == "superseded", 1.0).otherwise(0.2)
    if mode == "current":
        return F.when(status == "active", 1.0).otherwise(0.0)
    return F.lit(0.7)


def concept_coverage(asked: Column, held: Column) -> Column:
    """Share of the asked concepts that are held; a general preference weighs a fifth of the others."""
    weight = lambda c: F.when(c == "preference.any", 0.2).otherwise(1.0)
    total = F.aggregate(asked, F.lit(0.0), lambda s, c: s + weight(c))
    return F.when(total == 0, 0.0).otherwise(F.aggregate(F.array_intersect(asked, held), F.lit(0.0), lambda s, c: s + weight(c)) / total)


def linear_score(semantic: Column, lexical: Column, importance: Column, recency_: Column, frequency_: Column, temporal: Column) -> Column:
    return clamp(semantic * 0.4 + lexical * 0.2 + importance * 0.14 + recency_ * 0.08 + frequency_ * 0.04 + temporal * 0.14)


def fused_score(normalized: Column, agreement: Column, importance: Column, confidence: Column, temporal: Column, recency_: Column) -> Column:
    """The final score of rank fusion: mostly the fused rank, a little quality, time and recency."""
    quality = importance * 0.45 + confidence * 0.55
    return clamp(normalized * 0.78 + agreement * 0.09 + quality * 0.06 + temporal * 0.05 + F.round(recency_, 2) * 0.02)


def tier_utility(importance: Column, evidence: Column, adopted: Column, accesses: Column, used: Column, now: Column, group_size: Column, confirmed: Column, denied: Column, corrected: Column) -> Column:
    """Worth of a fact for keeping it at hand; denials and corrections cost up to a half. used: last access or update."""
    access = clamp(adopted * 0.25 + accesses * 0.1)
    fresh = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), now - used) / (30.0 * DAY_MS))
    alone = F.when(group_size <= 1, 1.0).otherwise(0.4)
    gain = clamp(importance) * 0.30 + clamp(evidence) * 0.15 + access * 0.20 + fresh * 0.15 + alone * 0.10 + F.when(confirmed, 0.10).otherwise(0.0)
    return clamp(gain - F.least(F.lit(0.5), denied * 0.2 + corrected * 0.1))


def shadow_utility(importance: Column, accesses: Column) -> Column:
    return clamp(importance * 0.65 + (1 - F.exp(-accesses / 5.0)) * 0.35)


def verification(extraction: Column, evidence: Column, durability: Column, flags: Column) -> Column:
    """Trust in a candidate fact; each flag costs a quarter of its clarity."""
    clarity = F.greatest(F.lit(0.0), 1 - flags * 0.25)
    return clamp(extraction * 0.25 + evidence * 0.45 + durability * 0.20 + clarity * 0.10)


def route_distance(start: Column, low: Column | None = None, high: Column | None = None, as_of: Column | None = None) -> Column:
    """1 / (1 + years) between a row's start and a window or a moment."""
    if as_of is not None:
        days = F.abs(as_of - start) / DAY_MS
    else:
        days = F.when(start < low, (low - start) / DAY_MS).when(start >= high, (start - high) / DAY_MS).otherwise(0.0)
    return 1 / (1 + days / 365)
