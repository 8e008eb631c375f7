"""Chains of operators with checked parameters and named statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Order in which the stages of a picture chain run (fixed values).
STAGES = (
    "pre_detect_1", "pre_detect_2", "pre_detect_3", "detect", "pre_deint_1", "pre_deint_2", "pre_deint_3", "deint",
    "post_deint_1", "post_deint_2", "post_deint_3",
)


@dataclass(frozen=True)
class Param:
    """A parameter with its kind, neutral value and limits."""

    name: str
    kind: str
    neutral: object
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def check(self, value):
        if self.kind == "bool":
            if not isinstance(value, bool):
                raise ValueError(f"{self.name} must be true or false")
        elif self.kind == "enum":
            if value not in self.choices:
                raise ValueError(f"{self.name} must be one of {self.choices}")
        else:
            value = int(value) if self.kind == "int" else float(value)
            if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
                raise ValueError(f"{self.name} must be between {self.low} and {self.high}")
        return value


@dataclass(frozen=True)
class Stage:
    """One operator of a chain: where it runs, what it does, its parameters."""

    slot: str
    fn: Callable[..., DataFrame]
    params: tuple[Param, ...] = ()
    values: dict = field(default_factory=dict)

    def options(self) -> dict:
        known = {p.name: p for p in self.params}
        unknown = set(self.values) - set(known)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        return {n: p.check(self.values.get(n, p.neutral)) for n, p in known.items()}


class Pipeline:
    """Stages run by slot, in the order given within a slot.

    All parameters are checked before any plan is built.
    """

    def __init__(self, stages: Sequence[Stage]):
        for s in stages:
            if s.slot not in STAGES:
                raise ValueError(f"slot must be one of {STAGES}")
        self.stages = sorted(stages, key=lambda s: STAGES.index(s.slot))

    def run(self, df: DataFrame) -> DataFrame:
        ready = [(s.fn, s.options()) for s in self.stages]
        for fn, options in ready:
            df = df.transform(fn, **options)
        return df


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Named statistics collected while the frame is computed for something else."""
    o = Observation(name)
    return df.observe(o, *[m.alias(n) for n, m in (metrics or {"rows": F.count(F.lit(1))}).items()]), o
