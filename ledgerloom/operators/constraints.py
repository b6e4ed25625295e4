"""Foreign keys and schema of a set of tables, checked in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of ``child`` name a row of ``parent`` by its ``parent_columns``; a null in any of them names none and breaks nothing."""

    name: str
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def _key(columns: tuple[str, ...]) -> Column:
    """The values as one text, null if one of them is; each part carries its length, so no two keys share a text."""
    return F.concat(*[F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in columns])


def violations(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """(constraint, key, problem, rows): keys of children without a parent (missing), and of parents that stand more than once (repeated).

    Every table is read once, whatever number of constraints it is in, on either side, itself included. Keys are counted before they
    are shuffled, so a key that most rows name is one row a task. ``key`` joins the values with a comma; ``rows`` counts the
    children, or the parents. Columns of both sides must have like types.
    """
    frames = []
    for name, df in tables.items():
        sides = []
        for fk in keys:
            if fk.child == name:
                sides.append(_side(fk, fk.columns, 1, 0))
            if fk.parent == name:
                sides.append(_side(fk, fk.parent_columns, 0, 1))
        if sides:
            frames.append(df.select(F.inline(F.array(*sides))).where("place is not null"))
    if not frames:
        raise ValueError("no table is in a constraint")
    met = reduce(DataFrame.unionByName, frames).groupBy("constraint", "place", "key").agg(F.sum("children").alias("children"), F.sum("parents").alias("parents"))
    problem = F.when((F.col("children") > 0) & (F.col("parents") == 0), F.struct(F.lit("missing").alias("problem"), F.col("children").alias("rows"))).when(F.col("parents") > 1, F.struct(F.lit("repeated").alias("problem"), F.col("parents").alias("rows")))
    return met.withColumn("_p", problem).where("_p is not null").select("constraint", "key", "_p.*")


def _side(fk: ForeignKey, columns: tuple[str, ...], child: int, parent: int) -> Column:
    shown = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    return F.struct(F.lit(fk.name).alias("constraint"), _key(columns).alias("place"), shown.alias("key"), F.lit(child).cast("long").alias("children"), F.lit(parent).cast("long").alias("parents"))


def orphans(tables: dict[str, DataFrame], fk: ForeignKey) -> DataFrame:
    """The child rows of one constraint without a parent, whole."""
    parent = tables[fk.parent].select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(fk.parent_columns)])
    rows = tables[fk.child].where(reduce(Column.__and__, [F.col(c).isNotNull() for c in fk.columns]))
    return rows.join(parent, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(fk.columns)], "left_anti")


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, place, column, type, nullable) of every column: what is published beside the data."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, place int, column string, type string, nullable boolean")


def schema_problems(want: DataFrame, got: DataFrame) -> DataFrame:
    """(table_name, column, problem): columns that are missing, unknown, of another type, or at another place."""
    g = got.select("table_name", "column", F.col("type").alias("_type"), F.col("place").alias("_place"))
    problem = F.when(F.col("_type").isNull(), "missing").when(F.col("type").isNull(), "unknown").when(F.col("type") != F.col("_type"), "type").when(F.col("place") != F.col("_place"), "place")
    return want.join(g, ["table_name", "column"], "full_outer").withColumn("problem", problem).where("problem is not null").select("table_name", "column", "problem")
