"""Variable and model metadata, data types, and the errors operators raise."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

#: Vocabulary sizes from here on mean "unbounded keys".
UNBOUNDED = 1 << 63
META_VERSION = "0.2"

_DTYPES = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "float32": T.FloatType(), "float": T.FloatType(), "float64": T.DoubleType(), "double": T.DoubleType(),
}


class StateError(ValueError):
    """A request that does not fit the variable, storage or model it names."""


def spark_type(name: str) -> T.DataType:
    """The Spark type of a data type's name; spelling in any case."""
    try:
        return _DTYPES[name.strip().lower()]
    except (KeyError, AttributeError):
        raise StateError(f"unknown data type {name!r}") from None


def element_type(name: str) -> T.DataType:
    """The element type of a variable: only floating point types hold weights."""
    t = spark_type(name)
    if not isinstance(t, (T.FloatType, T.DoubleType)):
        raise StateError(f"variables of type {name!r} have no optimizer or initializer; use float32 or float64")
    return t


@dataclass(frozen=True)
class VariableMeta:
    """Identity of a variable: data type, dimension and vocabulary size."""

    datatype: str = "float32"
    embedding_dim: int = 1
    vocabulary_size: int = UNBOUNDED

    def __post_init__(self) -> None:
        element_type(self.datatype)
        if self.embedding_dim < 1:
            raise StateError("embedding_dim must be at least 1")
        if self.vocabulary_size < 0:
            object.__setattr__(self, "vocabulary_size", UNBOUNDED)

    @property
    def bounded(self) -> bool:
        return self.vocabulary_size < UNBOUNDED

    def check_same(self, other: VariableMeta) -> None:
        if (self.datatype.lower(), self.embedding_dim, self.vocabulary_size) != (other.datatype.lower(), other.embedding_dim, other.vocabulary_size):
            raise StateError(f"variable meta does not match: {self} and {other}")


@dataclass
class Variable:
    """A variable of a model with its configuration."""

    variable_id: int
    name: str
    meta: VariableMeta
    storage_name: str = "storage_0"
    initializer: dict = field(default_factory=lambda: {"category": "constant", "value": 0.0})
    optimizer: dict = field(default_factory=lambda: {"category": "default"})


def model_meta_json(model_sign: str, variables: list[Variable]) -> str:
    rows = [
        {"datatype": v.meta.datatype, "embedding_dim": v.meta.embedding_dim, "vocabulary_size": v.meta.vocabulary_size, "storage_name": v.storage_name, "name": v.name, "initializer": v.initializer, "optimizer": v.optimizer}
        for v in variables
    ]
    return json.dumps({"model_sign": model_sign, "variables": rows, "version": META_VERSION})


def parse_model_meta(text: str) -> tuple[str, list[Variable]]:
    try:
        d = json.loads(text)
    except ValueError as e:
        raise StateError(f"model meta is not JSON: {e}") from None
    if d.get("version") != META_VERSION:
        raise StateError(f"model meta version {d.get('version')!r}, expected {META_VERSION!r}")
    out = []
    for i, v in enumerate(d["variables"]):
        meta = VariableMeta(v["datatype"], v["embedding_dim"], v["vocabulary_size"])
        known = {k: v[k] for k in ("initializer", "optimizer") if k in v}
        out.append(Variable(i, v.get("name", f"variable_{i}"), meta, v["storage_name"], **known))
    return d["model_sign"], out


def configured(cls, config: dict):
    """An instance of a dataclass from a string-keyed config; unknown keys only warn."""
    names = {f for f in cls.__dataclass_fields__}
    unknown = [k for k in config if k not in names and k != "category"]
    if unknown:
        warnings.warn(f"{cls.__name__}: unknown properties {unknown}", stacklevel=2)
    values = {}
    for k, v in config.items():
        if k in names:
            kind = type(cls.__dataclass_fields__[k].default)
            values[k] = (str(v).lower() in ("1", "true", "yes")) if kind is bool else kind(v)
    return cls(**values)


__all__ = ["UNBOUNDED", "META_VERSION", "StateError", "Variable", "VariableMeta", "asdict", "configured", "element_type", "model_meta_json", "parse_model_meta", "spark_type"]
