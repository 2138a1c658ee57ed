"""Per-key stateful updates: nine optimizers as column expressions.

An optimizer declares its slots (vectors beside the weights), its row scalars, and one
element's update written on columns. The same update serves a scalar column, every element
of a weight array, and an ordered fold over many gradients. An update sees the summed
gradient and the count of pushes; rows without a gradient are left as they are, their
slots do not decay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstate.types import StateError, configured

_REGISTRY: dict[str, type] = {}


def register(category: str) -> Callable[[type], type]:
    """Adds an optimizer class under its category; the class becomes a dataclass of its properties."""

    def add(cls: type) -> type:
        made = dataclass(cls)
        made.category = category
        _REGISTRY[category] = made
        return made

    return add


class Columns:
    """The few functions of an update, on columns."""

    sqrt, abs, greatest, least = staticmethod(F.sqrt), staticmethod(F.abs), staticmethod(F.greatest), staticmethod(F.least)

    @staticmethod
    def lit(v: float) -> Column:
        return F.lit(float(v))

    @staticmethod
    def pow(a: Column, b: Column) -> Column:
        return F.pow(a, b)


class Floats:
    """The same on plain numbers, for tasks that carry a state along their rows."""

    lit, abs, greatest, least, pow = float, abs, max, min, math.pow

    @staticmethod
    def sqrt(v: float) -> float:
        return math.sqrt(v) if v >= 0 else math.nan


class Optimizer:
    category = ""

    def slots(self) -> dict[str, float]:
        """Slot vectors and their initial elements."""
        return {}

    def scalars(self) -> dict[str, float]:
        """Row scalars and their initial values."""
        return {}

    def advance(self, s: dict, x=Columns) -> dict:
        """Row scalars of the next update; they move once per update, not per element."""
        return s

    def step(self, e: dict, x=Columns) -> dict:
        """New ``w`` and slots of an element from ``w``, ``g``, ``count``, slots and advanced scalars."""
        raise NotImplementedError


@register("default")
class Default(Optimizer):
    learning_rate: float = 0.0

    def step(self, e, x=Columns):
        return {"w": e["w"] - x.lit(self.learning_rate) * e["g"] if self.learning_rate else e["w"]}


@register("sgd")
class Sgd(Optimizer):
    learning_rate: float = 0.01
    momentum: float = 0.0
    nesterov: bool = False

    def slots(self):
        return {"moment": 0.0}

    def step(self, e, x=Columns):
        m = x.lit(self.momentum) * e["moment"] + x.lit(self.learning_rate) * e["g"]
        move = x.lit(self.momentum) * m + x.lit(self.learning_rate) * e["g"] if self.nesterov else m
        return {"w": e["w"] - move, "moment": m}


@register("adagrad")
class Adagrad(Optimizer):
    learning_rate: float = 0.001
    initial_accumulator_value: float = 0.1
    epsilon: float = 1e-7

    def slots(self):
        return {"accum": self.initial_accumulator_value}

    def step(self, e, x=Columns):
        a = e["accum"] + e["g"] * e["g"]
        return {"w": e["w"] - x.lit(self.learning_rate) * e["g"] / (x.sqrt(a) + x.lit(self.epsilon)), "accum": a}


@register("adadelta")
class Adadelta(Optimizer):
    learning_rate: float = 0.001
    rho: float = 0.95
    epsilon: float = 1e-7

    def slots(self):
        return {"accum": 0.0, "accum_update": 0.0}

    def step(self, e, x=Columns):
        keep, take, eps = x.lit(self.rho), x.lit(1 - self.rho), x.lit(self.epsilon)
        a = keep * e["accum"] + take * e["g"] * e["g"]
        u = e["g"] * x.sqrt(e["accum_update"] + eps) / x.sqrt(a + eps)
        return {"w": e["w"] - x.lit(self.learning_rate) * u, "accum": a, "accum_update": keep * e["accum_update"] + take * u * u}


@register("adam")
class Adam(Optimizer):
    learning_rate: float = 0.001
    beta_1: float = 0.9
    beta_2: float = 0.999
    epsilon: float = 1e-7

    def slots(self):
        return {"m": 0.0, "v": 0.0}

    def scalars(self):
        return {"beta_1_t": 1.0, "beta_2_t": 1.0}

    def advance(self, s, x=Columns):
        return {"beta_1_t": s["beta_1_t"] * x.lit(self.beta_1), "beta_2_t": s["beta_2_t"] * x.lit(self.beta_2)}

    def step(self, e, x=Columns):
        lr = x.lit(self.learning_rate) * x.sqrt(x.lit(1) - e["beta_2_t"]) / (x.lit(1) - e["beta_1_t"])
        m = x.lit(self.beta_1) * e["m"] + x.lit(1 - self.beta_1) * e["g"]
        v = x.lit(self.beta_2) * e["v"] + x.lit(1 - self.beta_2) * e["g"] * e["g"]
        return {"w": e["w"] - lr * m / (x.sqrt(v) + x.lit(self.epsilon)), "m": m, "v": v}


@register("adamax")
class Adamax(Optimizer):
    learning_rate: float = 0.001
    beta_1: float = 0.9
    beta_2: float = 0.999
    epsilon: float = 1e-7

    def slots(self):
        return {"m": 0.0, "v": 0.0}

    def scalars(self):
        return {"beta_1_t": 1.0}

    def advance(self, s, x=Columns):
        return {"beta_1_t": s["beta_1_t"] * x.lit(self.beta_1)}

    def step(self, e, x=Columns):
        m = x.lit(self.beta_1) * e["m"] + x.lit(1 - self.beta_1) * e["g"]
        v = x.greatest(x.abs(e["g"]), x.lit(self.beta_2) * e["v"])
        return {"w": e["w"] - x.lit(self.learning_rate) / (x.lit(1) - e["beta_1_t"]) * m / (v + x.lit(self.epsilon)), "m": m, "v": v}


@register("ftrl")
class Ftrl(Optimizer):
    learning_rate: float = 0.001
    initial_accumulator_value: float = 0.1
    l1_regularization_strength: float = 0.0
    l2_regularization_strength: float = 0.0
    l2_shrinkage_regularization_strength: float = 0.0
    learning_rate_power: float = -0.5
    beta: float = 0.0

    def slots(self):
        return {"accum": self.initial_accumulator_value, "linear": 0.0}

    def _power(self, a, x):
        return x.sqrt(a) if self.learning_rate_power == -0.5 else x.pow(a, x.lit(-self.learning_rate_power))

    def step(self, e, x=Columns):
        l1 = x.lit(self.l1_regularization_strength)
        l2 = x.lit(self.l2_regularization_strength + self.beta / (2 * self.learning_rate))
        shrunk = e["g"] + x.lit(2 * self.l2_shrinkage_regularization_strength) * e["w"]
        a = e["accum"] + e["g"] * e["g"]
        sigma = (self._power(a, x) - self._power(e["accum"], x)) / x.lit(self.learning_rate)
        z = e["linear"] + shrunk - sigma * e["w"]
        clipped = x.least(x.greatest(z, -l1), l1)
        return {"w": (clipped - z) / (self._power(a, x) / x.lit(self.learning_rate) + x.lit(2) * l2), "accum": a, "linear": z}


@register("rmsprop")
class Rmsprop(Optimizer):
    learning_rate: float = 0.001
    rho: float = 0.9
    momentum: float = 0.0
    epsilon: float = 1e-7

    def slots(self):
        return {"accum": 0.0, "moment": 0.0}

    def step(self, e, x=Columns):
        a = x.lit(self.rho) * e["accum"] + x.lit(1 - self.rho) * e["g"] * e["g"]
        m = x.lit(self.momentum) * e["moment"] + x.lit(self.learning_rate) * e["g"] / x.sqrt(a + x.lit(self.epsilon))
        return {"w": e["w"] - m, "accum": a, "moment": m}


@register("test")
class Test(Optimizer):
    """Moves by the mean gradient plus a state that flips at every update."""

    __test__ = False
    learning_rate: float = 0.1
    flip: float = 10000.0
    init: float = 0.0

    def scalars(self):
        return {"state": self.init}

    def advance(self, s, x=Columns):
        return {"state": x.lit(self.flip) - s["state"]}

    def step(self, e, x=Columns):
        return {"w": e["w"] + x.lit(self.learning_rate) * e["g"] / e["count"] + e["state"]}


def optimizer(config: dict) -> Optimizer:
    """An optimizer from ``{"category": ..., properties}``; unknown properties warn, unknown categories raise."""
    category = config.get("category", "default")
    if category not in _REGISTRY:
        raise StateError(f"unknown optimizer {category!r}")
    return configured(_REGISTRY[category], config)


def from_layer_config(name: str, config: dict | None = None) -> dict:
    """The optimizer config of a layer library's optimizer class name; what rows cannot follow is refused."""
    c = dict(config or {})
    category = name.lower()
    if category == "nadam" or category not in _REGISTRY:
        raise StateError(f"unsupported optimizer {name!r}")
    for flag in ("amsgrad", "centered", "decay"):
        if c.pop(flag, None):
            raise StateError(f"optimizer option {flag} is not supported")
    c.pop("name", None)
    return {"category": category, **{k: v for k, v in c.items() if k in _REGISTRY[category].__dataclass_fields__}}


# ---- arrays ------------------------------------------------------------------------------


def slot_schema(opt: Optimizer) -> str:
    """DDL of the ``slots`` struct of an optimizer's rows; a placeholder field where it keeps none."""
    fields = [f"{s}: array<double>" for s in opt.slots()] + [f"{s}: double" for s in opt.scalars()]
    return f"struct<{', '.join(fields or ['none: boolean'])}>"


def fresh_slots(opt: Optimizer, dim: int) -> Column:
    parts = [F.array_repeat(Columns.lit(v), dim).alias(s) for s, v in opt.slots().items()] + [Columns.lit(v).alias(s) for s, v in opt.scalars().items()]
    return F.struct(*(parts or [F.lit(None).cast("boolean").alias("none")]))


def apply_to_arrays(opt: Optimizer, weights: Column, slots: Column, grad: Column, count: Column) -> Column:
    """struct(weights, slots) after one update of a whole row."""
    names, scalars = list(opt.slots()), opt.scalars()
    moved = opt.advance({s: slots[s] for s in scalars})
    zipped = F.arrays_zip(weights.alias("w"), grad.alias("g"), *[slots[s].alias(s) for s in names])
    fields = ["w", "g", *names]

    def one(x: Column) -> Column:
        e = {f: x.getField(str(i) if f not in ("w", "g") else str(i)) for i, f in enumerate(fields)}
        done = opt.step({**e, **moved, "count": count.cast("double")})
        return F.struct(*[done[f].alias(f) for f in ["w", *names]])

    # positional field names, whatever the inputs are called
    renamed = F.transform(zipped.cast("array<struct<" + ",".join(f"`{i}`:double" for i in range(len(fields))) + ">>"), one)
    parts = [renamed.getField(s).alias(s) for s in names] + [moved[s].alias(s) for s in scalars]
    return F.struct(renamed.getField("w").alias("weights"), F.struct(*(parts or [F.lit(None).cast("boolean").alias("none")])).alias("slots"))


# ---- ordered folds ---------------------------------------------------------------------------


def start(opt: Optimizer, w0: float) -> dict[str, float]:
    """One weight with its slots and scalars before any update."""
    return {"w": float(w0), **opt.slots(), **opt.scalars()}


def one_step(opt: Optimizer) -> Callable[[dict[str, float], float], dict[str, float]]:
    """The state of one weight, as ``start`` makes it, after one gradient."""
    names, scalars = list(opt.slots()), list(opt.scalars())

    def step(state: dict[str, float], g: float) -> dict[str, float]:
        moved = opt.advance({s: state[s] for s in scalars}, Floats) if scalars else {}
        return {**opt.step({"w": state["w"], "g": g, "count": 1.0, **{s: state[s] for s in names}, **moved}, Floats), **moved}

    return step
