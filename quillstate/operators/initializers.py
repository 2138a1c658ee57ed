"""Initial rows of missing keys, as hash-based columns.

A row's initial values depend on (seed, key, element) only, so a key that is pulled twice,
retried or recomputed gets the same values before it is ever stored.
"""

from __future__ import annotations

import math
from functools import reduce

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstate.types import StateError, configured

_REGISTRY: dict[str, type] = {}


def register(category: str) -> Callable[[type], type]:
    def add(cls: type) -> type:
        _REGISTRY[category] = dataclass(cls)
        return _REGISTRY[category]

    return add


def unit(seed: int, key: Column, i: Column, salt: int = 0) -> Column:
    """A number in [0, 1) fixed by (seed, key, element, salt)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key, i), F.lit(1 << 53)) / F.lit(float(1 << 53))


@register("constant")
class Constant:
    value: float = 0.0

    def vector(self, key: Column, dim: int) -> Column:
        return F.array_repeat(F.lit(float(self.value)), dim)


@register("uniform")
class Uniform:
    minval: float = 0.0
    maxval: float = 1.0
    seed: int = 0

    def vector(self, key: Column, dim: int) -> Column:
        span = F.lit(float(self.maxval) - float(self.minval))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.lit(float(self.minval)) + span * unit(self.seed, key, i))


# coefficients of P. J. Acklam's rational approximation of the inverse normal distribution (fixed values)
_CENTRE = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00], [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
_TAIL = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00], [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def _ratio(x: Column, coefficients: tuple[list[float], list[float]]) -> Column:
    up, down = (reduce(lambda v, c: v * x + F.lit(c), cs[1:], F.lit(cs[0])) for cs in coefficients)
    return up / down


def inverse_normal(p: Column) -> Column:
    """The value that a standard normal number stays below with chance ``p`` in (0, 1), to about nine digits."""
    q = p - 0.5
    low, high = F.sqrt(F.lit(-2.0) * F.log(p)), F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    return F.when(p < 0.02425, _ratio(low, _TAIL)).when(p > 1 - 0.02425, -_ratio(high, _TAIL)).otherwise(q * _ratio(q * q, _CENTRE))


@register("normal")
class Normal:
    """Normal numbers by inversion of one uniform number; with ``truncated > 0.1`` none lies beyond that many deviations."""

    mean: float = 0.0
    stddev: float = 1.0
    truncated: float = 0.0
    seed: int = 0

    def vector(self, key: Column, dim: int) -> Column:
        below = 0.5 * math.erfc(self.truncated / math.sqrt(2)) if self.truncated > 0.1 else 0.0
        least = max(below, 2.0**-54)  # 0 has no inverse
        wide = float(self.truncated) if below else math.inf

        def one(i: Column) -> Column:
            z = inverse_normal(F.lit(least) + F.lit(1 - 2 * least) * unit(self.seed, key, i))
            return F.lit(float(self.mean)) + F.lit(float(self.stddev)) * F.greatest(F.lit(-wide), F.least(F.lit(wide), z))

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)


def initializer(config: dict):
    """An initializer from ``{"category": ..., properties}``; unknown properties warn."""
    category = config.get("category", "constant")
    if category not in _REGISTRY:
        raise StateError(f"unknown initializer {category!r}")
    return configured(_REGISTRY[category], config)


def from_layer_config(name: str, config: dict | None = None, explicit: bool = True) -> dict:
    """The initializer config of a layer's initializer class name."""
    c = config or {}
    made = {
        "zeros": {"category": "constant", "value": 0.0},
        "ones": {"category": "constant", "value": 1.0},
        "constant": {"category": "constant", "value": c.get("value", 0.0)},
        "randomuniform": {"category": "uniform", "minval": c.get("minval", -0.05), "maxval": c.get("maxval", 0.05), "seed": c.get("seed") or 0},
        "randomnormal": {"category": "normal", "mean": c.get("mean", 0.0), "stddev": c.get("stddev", 0.05), "truncated": 0.0, "seed": c.get("seed") or 0},
    }.get(name.lower().replace("_", ""))
    if made is None:
        if explicit:
            raise StateError(f"unsupported initializer {name!r}")
        return {"category": "constant", "value": 0.0}
    return made
