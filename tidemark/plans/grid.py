"""Parameter grids: axis specs, checks, and the grid as a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate, chain, repeat, takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXIS_SLACK = 1e-12
BROADCAST_ROWS = 500_000  # at most ~60 MB of parameter rows


SPEC = re.compile(r"\s*([^:\s]+)\s*:\s*([^:\s]+)\s*:\s*([^:\s]+)\s*")


@dataclass(frozen=True)
class Range:
    """Evenly spaced axis values from ``start`` on, none beyond ``stop`` by more than the slack."""

    start: float
    stop: float
    step: float

    def __post_init__(self) -> None:
        if not (self.step > 0 and self.start <= self.stop):
            raise ValueError(f"a range rises from its start to its stop, not {self}")

    def __iter__(self) -> Iterator[float]:
        steps = chain([self.start], repeat(self.step))
        return takewhile(lambda v: v <= self.stop + AXIS_SLACK, accumulate(steps))

    @classmethod
    def parse(cls, spec: str) -> Range:
        """A range from its text form, three numbers with colons between."""
        match = SPEC.fullmatch(spec)
        if match is None:
            raise ValueError(f"{spec!r} is not a range of three numbers")
        return cls(*map(float, match.groups()))


def float_axis(spec: str) -> list[float]:
    """The values of a range given as text."""
    return [*Range.parse(spec)]


def int_axis(spec: str, positive: bool = True) -> list[int]:
    """The values of a range given as text, as whole numbers; with ``positive``, all from 1 on."""
    whole = [*map(round, Range.parse(spec))]
    if positive and whole[0] < 1:
        raise ValueError(f"{spec!r} begins below 1")
    return whole


@dataclass(frozen=True)
class Axis:
    """One grid axis: its type, the values it admits, and how to say so."""

    name: str
    kind: str
    admits: Callable[[float], bool] = lambda v: v > 0
    rule: str = "> 0"
    optional: bool = False


@dataclass(frozen=True)
class Grid:
    """Values per axis plus costs.  Combination number = mixed-radix index, first axis slowest."""

    axes: tuple[Axis, ...]
    values: dict[str, list]
    fee_per_side: float = 0.0005
    slippage: float = 0.0002
    checks: tuple[tuple[Callable[[dict], bool], str], ...] = field(default=())

    def __post_init__(self) -> None:
        if self.fee_per_side < 0 or self.slippage < 0:
            raise ValueError("fee and slippage must be >= 0")
        for axis in self.axes:
            vals = self.values.get(axis.name)
            if not vals:
                raise ValueError(f"grid axis {axis.name} must not be empty")
            if not all((v is None and axis.optional) or (v is not None and axis.admits(v)) for v in vals):
                raise ValueError(f"{axis.name} must be {axis.rule}")
        for ok, message in self.checks:
            if not ok(self.values):
                raise ValueError(message)

    @property
    def cost(self) -> float:
        return self.fee_per_side + self.slippage

    def size(self) -> int:
        total = 1
        for axis in self.axes:
            total *= len(self.values[axis.name])
        return total

    def distinct(self, name: str) -> list:
        return sorted(set(self.values[name]))

    def strides(self) -> dict[str, int]:
        """How far apart the numbers of neighbouring values of each axis are."""
        out, stride = {}, self.size()
        for axis in self.axes:
            stride //= len(self.values[axis.name])
            out[axis.name] = stride
        return out

    def row(self, i: int) -> dict:
        """The values of combination ``i``."""
        return {n: self.values[n][i // stride % len(self.values[n])] for n, stride in self.strides().items()}

    def columns(self, number: str) -> list[str]:
        """SQL for the values of the combination with this number, and for each value's position ``<axis>_i``."""
        cols, strides = [], self.strides()
        for axis in self.axes:
            vals, stride = self.values[axis.name], strides[axis.name]
            pos = f"CAST({number} DIV {stride} % {len(vals)} AS INT)"
            items = ", ".join(f"CAST('{v!r}' AS {axis.kind})" if v is not None else "NULL" for v in vals)
            cols.append(f"element_at(CAST(array({items}) AS array<{axis.kind}>), {pos} + 1) AS {axis.name}")
            cols.append(f"{pos} AS {axis.name}_i")
        return cols

    def part(self, names: list[str]) -> Grid:
        """The grid of some of the axes."""
        return replace(self, axes=tuple(a for a in self.axes if a.name in names), checks=())

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per combination: ``param_id``, the axis values, and each value's position ``<axis>_i``."""
        return spark.range(self.size()).selectExpr("id AS param_id", *self.columns("id"))

    def small_frame(self, spark: SparkSession) -> DataFrame:
        """The grid, broadcast when its known row count is within the bound."""
        df = self.frame(spark)
        return F.broadcast(df) if self.size() <= BROADCAST_ROWS else df
