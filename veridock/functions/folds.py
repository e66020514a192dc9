"""Arrays in order, as column expressions: values used more than once, folds that stay linear, places of a pattern."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of an array that grow together.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str, every: bool = False) -> Column:
    """An array of what ``emit`` makes of each item and the state before it, but for nulls, of which ``every`` says that there are none;
    ``step`` gives the next state.
    An array that grows by one is copied each time: results are appended within blocks, and blocks to the whole."""
    none, nones = F.array().cast(kind), F.array().cast(f"array<{kind}>")

    def one(at: Column, item: Column) -> Column:
        made = emit(at["s"], item)
        grown = F.concat(at["out"], F.array(made)) if every else bound(made, lambda m: F.when(m.isNull(), at["out"]).otherwise(F.concat(at["out"], F.array(m))))
        return F.struct(step(at["s"], item).alias("s"), grown.alias("out"))

    def block(at: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(at["s"].alias("s"), none.alias("out")), one, lambda end: F.struct(end["s"].alias("s"), F.concat(at["out"], F.array(end["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK)), lambda i: F.slice(xs, i, F.lit(BLOCK)))
        few = F.aggregate(xs, F.struct(start.alias("s"), none.alias("out")), one, lambda end: end["out"])
        many = F.aggregate(parts, F.struct(start.alias("s"), nones.alias("out")), block, lambda end: F.flatten(end["out"]))
        return F.when(F.size(xs) <= BLOCK, few).otherwise(many)

    return bound(items, whole)


_MARK = "\u0001"
PLACES = "array<struct<start:int,end:int,raw:string>>"


def places(text: Column, pattern: Column | str) -> Column:
    """(start, end, raw) of the matches of a pattern, left to right, in code points from 0."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    # Spark compiles a pattern that splits for each row, but not one that replaces
    gaps = F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1))
    sizes = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(0)), gaps, lambda m, gap: F.when(m.isNotNull(), F.struct(F.length(gap).alias("gap"), m.alias("raw"))))
    step = lambda at, m: at + m["gap"] + F.length(m["raw"])
    emit = lambda at, m: F.struct((at + m["gap"]).alias("start"), step(at, m).alias("end"), m["raw"].alias("raw"))
    found = folded(F.filter(sizes, lambda s: s.isNotNull()), F.lit(0), step, emit, PLACES, every=True)
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(PLACES))


def between(text: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end``, in code points from 0."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
