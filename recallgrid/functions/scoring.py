"""Scores of beliefs as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BM25_FLOOR = 1e-12
POSTERIOR_WEIGHT = 0.5
TEMPERATURE_FLOOR = 1e-6
ZETA_ALPHA, ZETA_BETA, ZETA_SCALE = 1.0, 0.25, 14.5
PRIOR_ALPHA, PRIOR_BETA = 0.5, 0.5
HALF_LIFE_HOURS = {"factual": 336, "requirement": 720, "preference": 2016, "correction": 4032}
ORIGIN_RANK = {"user_stated": 6, "user_corrected": 5, "user_validated": 4, "user_transcript": 3, "agent_inferred": 1}
ORIGIN_RANK_OTHER = 2
CHARS_PER_TOKEN = 4


def posterior_mean(alpha: Column, beta: Column) -> Column:
    """alpha / (alpha + beta); one half without evidence."""
    return F.when(alpha + beta > 0, alpha / (alpha + beta)).otherwise(0.5)


def half_life_seconds(kind: Column) -> Column:
    out = F.lit(HALF_LIFE_HOURS["factual"] * 3600.0)
    for name, hours in HALF_LIFE_HOURS.items():
        out = F.when(kind == name, hours * 3600.0).otherwise(out)
    return out


def decayed(value: Column, prior: float, age_seconds: Column, half_life: Column, lock_level: Column) -> Column:
    """Evidence drawn to its prior by half in each half-life; locked beliefs keep theirs."""
    moves = (lock_level != "user") & (half_life > 0) & (age_seconds > 0)
    return F.when(moves, prior + (value - prior) * F.pow(F.lit(0.5), age_seconds / half_life)).otherwise(value)


def _log_match(match: Column) -> Column:
    return F.log(F.greatest(match, F.lit(BM25_FLOOR)))


def log_additive(match: Column, alpha: Column, beta: Column, weight: float = POSTERIOR_WEIGHT) -> Column:
    """Logarithm of the match (positive) plus a weight times that of the posterior mean."""
    p = posterior_mean(alpha, beta)
    return _log_match(match) + weight * F.log(F.when(p > 0, p).otherwise(BM25_FLOOR))


def gamma_score(match: Column, alpha: Column, beta: Column, temperature: float = 1.0) -> Column:
    """The posterior term sharpened by a temperature."""
    return log_additive(match, alpha, beta, 1.0 / max(temperature, TEMPERATURE_FLOOR))


def zeta_score(match: Column, alpha: Column, beta: Column) -> Column:
    """The posterior term bounded by a sigmoid around one half."""
    p = F.greatest(posterior_mean(alpha, beta), F.lit(BM25_FLOOR))
    x = ZETA_BETA * (F.log(p) - F.log(F.lit(0.5)))
    return _log_match(match) + ZETA_ALPHA * (1 / (1 + F.exp(-x)) - 0.5) * ZETA_SCALE


def normalised_uncertainty(alpha: Column, beta: Column) -> Column:
    """Variance of the Beta distribution times 12, 1 at most (1: uniform)."""
    n = alpha + beta
    return F.least(F.lit(1.0), 12 * alpha * beta / (n * n * (n + 1)))


def origin_rank(origin: Column) -> Column:
    out = F.lit(ORIGIN_RANK_OTHER)
    for name, rank in ORIGIN_RANK.items():
        out = F.when(origin == name, rank).otherwise(out)
    return out


def estimated_tokens(text: Column) -> Column:
    """Characters by four, rounded up."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def length_norm(dl: Column, avgdl: Column, b: float) -> Column:
    return (1 - b) + b * dl / avgdl


def _shifted(x: Column, steps: int) -> list[Column]:
    return [x + k for k in range(steps)]


def log_gamma(x: Column, steps: int = 8) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series at x + ``steps``, carried back."""
    y = x + steps
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return series - sum((F.log(k) for k in _shifted(x, steps)), F.lit(0.0))


def digamma(x: Column, steps: int = 8) -> Column:
    """The derivative of ``log_gamma``, likewise."""
    y = x + steps
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4))) - 1 / (252 * F.pow(y, F.lit(6)))
    return series - sum((1 / k for k in _shifted(x, steps)), F.lit(0.0))


def beta_entropy(alpha: Column, beta: Column) -> Column:
    """Differential entropy of Beta(alpha, beta)."""
    log_b = log_gamma(alpha) + log_gamma(beta) - log_gamma(alpha + beta)
    return log_b - (alpha - 1) * digamma(alpha) - (beta - 1) * digamma(beta) + (alpha + beta - 2) * digamma(alpha + beta)
