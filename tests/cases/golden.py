"""Worked cases: small tables of inputs dealt out over all runs (the driver's suppliers), through the operators, with
the results that the described rules ask for as SQL.

Every run has all the inputs under ids of its own, so an operator works on as many claims, items and facts as runs times
cases, in one plan; what it returns for each run is compared row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridock.session import table

MARK = ":"
#: The cases by name, and the SQL that states their results.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_TYPES = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def own(column: Column, kind: T.DataType, inner: str | None = None) -> Column:
    """Ids of a run: the run's number before each."""
    mark = lambda c: F.concat(F.col("run").cast("string"), F.lit(MARK), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: x.withField(inner, mark(x[inner])) if inner else mark(x))
    return mark(column)


class Cases:
    """Input tables for all runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.runs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("run"))

    def table(self, schema: str, rows: Sequence[tuple], ids: str = "") -> DataFrame:
        """The rows for every run, with a column ``run``; ``ids`` are the columns (``quotes.evidence_id`` for a field in an
        array) that become the run's own."""
        small = F.broadcast(self.spark.createDataFrame([tuple(r) for r in rows], schema))  # a fixed list
        df = self.runs.crossJoin(small)
        for name in ids.split():
            column, _, inner = name.partition(".")
            df = df.withColumn(column, own(F.col(column), df.schema[column].dataType, inner or None))
        return df


def back(df: DataFrame, id_col: str, *columns: Column | str) -> DataFrame:
    """run and the id without it, with further columns."""
    parts = F.split(id_col, MARK, 2)
    return df.select(parts[0].cast("long").alias("run"), parts[1].alias(id_col), *columns)


def bare(ids: Column) -> Column:
    """An array of ids without their run."""
    return F.transform(ids, lambda x: F.substring_index(x, MARK, -1))


def joined(c: Column | str) -> Column:
    """An array as text."""
    return F.array_join(c, "|")


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return repr(x)


def golden(columns: str, expected: Sequence[tuple], name: str | None = None):
    """Register cases: the function takes ``Cases`` and returns run and ``columns``; ``expected`` are the rows of
    each run."""
    fields = [tuple(c.strip().split()) for c in columns.split(",")]
    values = ", ".join("(" + ", ".join(_literal(x) for x in row) + ")" for row in expected)
    select = ", ".join(f"CAST({n} AS {_TYPES[t]}) AS {n}" for n, t in fields)
    sql = f"SELECT CAST(s_suppkey AS BIGINT) AS run, {select} FROM supplier, (VALUES {values}) AS c({', '.join(n for n, _ in fields)})"

    def add(f: Callable[[Cases], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Cases(spark, sf_dir)).select("run", *[F.col(n).cast(t).alias(n) for n, t in fields])

        run.__name__, run.__doc__ = name or f.__name__, f.__doc__
        CASES[run.__name__], SQL[run.__name__] = run, sql
        return run

    return add
