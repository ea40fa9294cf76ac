"""Severities, confidence bands, grades and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: severity order, penalties, category weights, bands
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
PENALTY = {"CRITICAL": "20", "HIGH": "10", "MEDIUM": "5", "LOW": "2", "INFO": "0.5"}
FLAT_PENALTY = {"CRITICAL": 15, "HIGH": 8, "MEDIUM": 3, "LOW": 1, "INFO": 0}
WEIGHTS = {"bug": "0.30", "solid": "0.25", "architecture": "0.20", "security": "0.15", "complexity": "0.10"}
GRADES = [(90, "A"), (75, "B"), (60, "C"), (45, "D"), (0, "F")]
COLOURS = {"report": [(75, "green"), (50, "orange")], "card": [(90, "green"), (75, "blue"), (60, "orange")]}
THRESHOLDS = {"cyclomatic": [(40, "CRITICAL"), (25, "HIGH"), (15, "MEDIUM")], "cognitive": [(35, "CRITICAL"), (25, "HIGH"), (18, "MEDIUM")], "nesting": [(6, "HIGH"), (5, "MEDIUM")], "loc": [(120, "CRITICAL"), (80, "HIGH"), (60, "MEDIUM")]}


def rank(severity: Column) -> Column:
    """0 for CRITICAL to 4 for INFO, 5 for anything else."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.coalesce(severity, F.lit("")))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(5)


def downgrade(severity: Column, steps: int = 2) -> Column:
    names = F.array(*map(F.lit, SEVERITIES))
    return F.when(rank(severity) < 5, F.element_at(names, F.least(rank(severity) + steps, F.lit(4)) + 1)).otherwise(severity)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "High").when(confidence >= 0.55, "Medium").otherwise("Low")


def penalty(severity: Column) -> Column:
    out = F.lit("0.5").cast("decimal(5,1)")
    for name, points in PENALTY.items():
        out = F.when(severity == name, F.lit(points).cast("decimal(5,1)")).otherwise(out)
    return out


def band(value: Column, metric: str) -> Column:
    """Severity of a metric's value, or null under its lowest threshold or for a null value."""
    out = F.lit(None).cast("string")
    for least, name in reversed(THRESHOLDS[metric]):
        out = F.when(value >= least, name).otherwise(out)
    return out


def worst(cyclomatic: Column, cognitive: Column, nesting: Column, loc: Column) -> Column:
    """Worst severity of a function; its length counts if HIGH or worse, or together with another metric."""
    cc, cog, nest, size = band(cyclomatic, "cyclomatic"), band(cognitive, "cognitive"), band(nesting, "nesting"), band(loc, "loc")
    structural = F.least(*(F.when(x.isNotNull(), rank(x)) for x in (cc, cog, nest)))
    lines = F.when(size.isNotNull() & ((rank(size) <= 1) | structural.isNotNull()), rank(size))
    out = F.lit(None).cast("string")
    for k, name in enumerate(SEVERITIES):
        out = F.when(F.least(structural, lines) == k, name).otherwise(out)
    return out


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def round1(value: Column) -> Column:
    """One decimal, halves away from zero, computed in decimals."""
    return F.round(value, 1).cast("double")


def score_colour(score: Column, scale: str = "report") -> Column:
    """Colour of a score on the report's scale, or of a grade's band on the card's."""
    out = F.lit("red")
    for least, name in reversed(COLOURS[scale]):
        out = F.when(score >= least, name).otherwise(out)
    return out
