"""Stages, filters, joins and sinks of one's own, shapes that a stage asks for, and branches that may fail alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Registry:
    """Stages by kind and name. A name is taken once unless it is replaced on purpose; an unknown one is an error that
    names the nearest."""

    KINDS = ("stage", "filter", "join", "sink", "source")

    def __init__(self):
        self._own: dict[tuple[str, str], Callable] = {}

    def add(self, kind: str, name: str, function: Callable, replace: bool = False) -> Callable:
        if kind not in self.KINDS:
            raise ValueError(f"no kind {kind} of stage")
        if (kind, name) in self._own and not replace:
            raise ValueError(f"the {kind} {name} is there already")
        self._own[kind, name] = function
        return function

    def get(self, kind: str, name: str) -> Callable:
        if (kind, name) not in self._own:
            near = nearest(name, [n for k, n in self._own if k == kind])
            raise KeyError(f"no {kind} {name}" + (f"; did you mean {near}?" if near else ""))
        return self._own[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._own if k == kind)


def nearest(name: str, choices: list[str]) -> str | None:
    """The choice within two edits of name, whatever its case; the first of the nearest."""

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    scored = [(edits(name.lower(), c.lower()), i, c) for i, c in enumerate(choices)]
    return min((s for s in scored if s[0] <= 2), default=(0, 0, None))[2]


def do(df: DataFrame, *stages) -> DataFrame:
    """Stages in order: functions of a DataFrame, or pairs (function, arguments)."""
    for stage in stages:
        function, arguments = (stage, {}) if callable(stage) else stage
        df = function(df, **arguments)
    return df


def map_messages(df: DataFrame, on_packet=None, on_frame=None, on_event=None, kind: str = "kind") -> DataFrame:
    """A stage of up to three functions of a DataFrame, each for the rows of its kind; rows of a kind without one pass."""
    out = None
    for name, function in (("packet", on_packet), ("frame", on_frame), ("event", on_event)):
        rows = df.where(F.col(kind) == name)
        rows = function(rows).select(*df.columns) if function else rows
        out = rows if out is None else out.unionByName(rows)
    return out.unionByName(df.where(F.coalesce(~F.col(kind).isin("packet", "frame", "event"), F.lit(True))))


def join(name: str, registry: Registry, key: str, left: DataFrame, right: DataFrame, schema: str) -> DataFrame:
    """A registered join of two arms: function(left table, right table) of one key's rows, in Arrow."""
    # columns of its own, as the planner would else take those of two arms of one DataFrame for each other
    right = right.select(*(F.col(f"`{c}`").alias(c) for c in right.columns))
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(registry.get("join", name), schema)


class ShapeError(ValueError):
    """A shape that a stage asks for isn't there and may not be converted to."""


def shape(df: DataFrame, wanted: str, policy: str = "require", allowed: frozenset[str] = frozenset()) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """df with the columns and types of ``wanted`` (DDL), and the conversions put in as (column, from, to).

    ``require`` refuses any other type, ``auto`` converts those that lose nothing or whose class is ``allowed`` (narrow: fewer
    bits, text: from and to strings), ``prefer`` converts what it may and leaves the rest as it is. A column
    that isn't there is refused, but by ``prefer``. Other columns stay.
    """
    made, own = [], {f.name: f.dataType for f in df.schema}
    for field in StructType.fromDDL(wanted):
        if field.name not in own:
            if policy == "prefer":
                continue
            raise ShapeError(f"no column {field.name}")
        have, want = own[field.name], field.dataType
        if have == want:
            continue
        kind = conversion(have.simpleString(), want.simpleString())
        if policy != "require" and (kind == "wider" or kind in allowed):
            made.append((field.name, have.simpleString(), want.simpleString()))
        elif policy != "prefer":
            raise ShapeError(f"{field.name} is {have.simpleString()}, not {want.simpleString()}" + (f" (a {kind} conversion)" if kind else ""))
    for name, _, to in made:
        df = df.withColumn(name, F.col(f"`{name}`").try_cast(to))
    return df, made


_WIDTHS = ["tinyint", "smallint", "int", "bigint", "double"]


def conversion(have: str, want: str) -> str | None:
    """The class of a conversion: wider, narrow, text, or None where there is none."""
    if have == "float" and want == "double":
        return "wider"
    if have == "double" and want == "float":
        return "narrow"
    if have in _WIDTHS and want in _WIDTHS:
        exact = _WIDTHS.index(have) < _WIDTHS.index(want) and not (have == "bigint" and want == "double")
        return "wider" if exact else "narrow"
    if "string" in (have, want) and {have, want} & {*_WIDTHS, "float", "boolean"}:
        return "text"
    return None


class Branches:
    """Branches of one DataFrame, each a function that writes or counts it. They can be added and removed between runs;
    one that fails is told apart from the others, or fails all, as its policy says."""

    def __init__(self):
        self._own: dict[str, tuple[Callable[[DataFrame], object], str]] = {}

    def attach(self, name: str, function: Callable[[DataFrame], object], failure: str = "isolate") -> None:
        if name in self._own:
            raise ValueError(f"the branch {name} is attached already")
        if failure not in ("isolate", "fail"):
            raise ValueError(f"no failure policy {failure}")
        self._own[name] = (function, failure)

    def detach(self, name: str) -> bool:
        return self._own.pop(name, None) is not None

    def run(self, df: DataFrame, batch: int | None = None) -> dict[str, tuple[str, object]]:
        """(outcome, result or error) of each branch; also a function for ``foreachBatch``. df is read once for all."""
        df = df.persist()
        told: dict[str, tuple[str, object]] = {}
        try:
            for name, (function, failure) in list(self._own.items()):
                try:
                    told[name] = ("done", function(df))
                except Exception as error:
                    if failure == "fail":
                        raise
                    told[name] = ("failed", error)
        finally:
            df.unpersist()
        return told
