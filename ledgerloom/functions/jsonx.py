"""Typed access to JSON text: scalars as a dynamically typed store reads them, structure tests, whole-tree walks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shipping import ship


def parsed(json_text: Column | str) -> Column:
    """A Variant; null for broken JSON."""
    return F.try_parse_json(json_text)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more; the parser itself takes what stands after a value for no fault, so ``1 x`` would pass.

    What closes a list too early leaves an object open, and the other way round; so a text that fits into both is whole.
    """
    within = lambda left, right: F.try_parse_json(F.concat(F.lit(left), text, F.lit(right))).isNotNull()
    return F.coalesce(within("[", "]") & within('{"a":', "}"), F.lit(False))


def with_parsed(df: DataFrame, name: str, column: str = "json_text") -> DataFrame:
    """``df`` with the Variant of a column, parsed once for each row.

    The Variant comes out of a one-element array, which the optimizer does not fold into what reads it; as a plain
    column it would be parsed anew in every filter and expression that is pushed below it.
    """
    return df.select("*", F.explode(F.array(parsed(column))).alias(name))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(_get(v, path, "map<string,variant>").isNotNull(), F.lit(False))


def is_array(v: Column, path: str = "$") -> Column:
    return F.coalesce(_get(v, path, "array<variant>").isNotNull(), F.lit(False))


def kind_of(v: Column, path: str = "$") -> Column:
    """Spark's name of the value's type; null where there is none."""
    return F.schema_of_variant(_get(v, path, "variant"))


def text(v: Column, path: str) -> Column:
    """The value if it is JSON text, else null."""
    return F.when(kind_of(v, path) == "STRING", _get(v, path, "string"))


def integer(v: Column, path: str) -> Column:
    """An integral number, or true/false as 1/0; null for anything else, text with digits too."""
    return F.when(kind_of(v, path).isin("BIGINT", "BOOLEAN"), _get(v, path, "bigint"))


def as_text(v: Column) -> Column:
    """``text`` of a whole Variant."""
    return F.when(F.schema_of_variant(v) == "STRING", _get(v, "$", "string"))


def as_integer(v: Column) -> Column:
    """``integer`` of a whole Variant, by way of its JSON: a cast inside of a Variant sets up a new cast for each value."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "BIGINT", F.to_json(v).cast("bigint")).when(kind == "BOOLEAN", (F.to_json(v) == "true").cast("bigint"))


def number(v: Column, path: str) -> Column:
    """A number (not a boolean) as double."""
    kind = kind_of(v, path)
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), _get(v, path, "double"))


def subtree(v: Column, path: str) -> Column:
    """JSON text of an object, array or scalar below ``path``."""
    return F.to_json(_get(v, path, "variant"))


def elements(v: Column, path: str) -> Column:
    """The array below ``path`` as an array of Variants; null if it is none."""
    return _get(v, path, "array<variant>")


def canonical(value: object) -> str:
    """Sorted keys, no blanks, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """Canonical text of JSON text; null for broken JSON, or NaN and infinities."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return s.map(one)


_TYPES = {dict: "object", list: "array", str: "text", bool: "boolean", int: "integer", float: "real", type(None): "null"}


def walk(value: object, path: str = "$") -> Iterator[tuple[str, str, object]]:
    """Every (path, type, value) in the order of the source, containers before their members."""
    stack = [(path, value)]
    while stack:
        p, v = stack.pop()
        yield p, _TYPES[type(v)], v
        if isinstance(v, dict):
            stack.extend((f"{p}.{k}", x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((f"{p}[{i}]", x) for i, x in reversed(list(enumerate(v))))


def all_fields(responses: DataFrame, key: str = "id", text_column: str = "json_text") -> DataFrame:
    """(key, ordinal, path, type, atom) for every node of every response's JSON; broken JSON has none.

    Trees are walked in Arrow batches, a document at a time: the built-in Variant sorts
    object keys, and the order of the source is part of the result.
    """
    ship(responses.sparkSession)
    rows = responses.where(F.col(text_column).isNotNull()).select(key, F.col(text_column).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t in zip(f[key], f["t"], strict=True):
                try:
                    tree = json.loads(t)
                except ValueError:
                    continue
                for i, (p, kind, v) in enumerate(walk(tree)):
                    out.append((k, i, p, kind, None if kind in ("object", "array", "null") else canonical(v) if kind != "text" else v))
            yield pd.DataFrame(out, columns=[key, "ordinal", "path", "type", "atom"])

    kind = responses.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"{key} {kind}, ordinal long, path string, type string, atom string")
