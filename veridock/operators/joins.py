"""Joins on more than equality: intervals, containment, nearest, tolerant numbers, duplicates."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from veridock.functions import predicates as p
from veridock.functions import quantity as q
from veridock.functions import textnorm as t
from veridock.session import stored


def _cells(start: Column, end: Column, width: float) -> Column:
    """The cells of a time or space axis that an interval touches."""
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def within_latest(points: DataFrame, intervals: DataFrame, key: str, point_id: str, at: str, start: str, end: str, order: str, slack: float = 0.5, width: float = 600.0) -> DataFrame:
    """Each point with the interval of its key that contains it (up to ``slack`` behind its end) and starts last; of equal
    starts the last in order. Points in no interval get nulls. The axis is cut into cells, so that the join is on
    equality; an interval is in as many rows as it touches cells."""
    cut = intervals.withColumn("_cell", _cells(F.col(start), F.col(end) + slack, width))
    near = points.select(key, point_id, at, F.floor(F.col(at) / width).alias("_cell")).join(cut, [key, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end) + slack))
    best = near.groupBy(point_id).agg(F.max(F.struct(start, order)).alias("_best"))
    return points.join(best.select(point_id, F.col(f"_best.{order}").alias(order)), point_id, "left")


def overlapping(intervals: DataFrame, key: str, id_col: str, start: str, end: str, width: float = 600.0) -> DataFrame:
    """Ids of intervals that another of the same key overlaps. In a cell, sorted by start, an interval overlaps another if
    one before it ends later than it starts or the next one starts before it ends: windows decide, no pairs are made."""
    cut = intervals.select(key, id_col, start, end, _cells(F.col(start), F.col(end), width).alias("_cell"))
    w = W.partitionBy(key, "_cell").orderBy(start, end, id_col)
    seen = cut.withColumn("_before", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_next", F.min(start).over(w.rowsBetween(1, W.unboundedFollowing)))
    return seen.where((F.col("_before") > F.col(start)) | (F.col("_next") < F.col(end))).select(id_col).distinct()


#: Headings that lie on average in one cell of the grid that blocks are looked up in, and the most blocks that are looked up at once.
CROWD, AT_ONCE = 1000, 50_000


def _power(x: float) -> float:
    """A power of two not below x: division by it is exact, so that cells have exact edges."""
    return 2.0 ** math.ceil(math.log2(x))


def _fitting_reach(heads: DataFrame, page: str, width: float, reach: float) -> float:
    """The height of cells in which headings have ``CROWD`` others around them, counted on all of them. Where many have the same
    height, no cell is low enough for that, and the last that helped is taken."""
    before = math.inf
    while True:
        cells = heads.groupBy(page, F.floor(F.col("hx0") / width), F.floor(F.col("bottom") / reach)).agg(F.count("*").cast("double").alias("n"))
        crowd = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or CROWD
        steps = round(math.log2(crowd / CROWD))
        if steps <= 0 and before == math.inf:
            return reach / 2.0**steps
        if steps <= 0 or crowd > 0.9 * before:
            return reach
        reach, before = reach / 2.0**steps, crowd


class Nearest:
    """The nearest heading of each block of a cell, by walking up and down from the block's own height, all blocks a step at a time."""

    def __init__(self, schema: pa.Schema, slack: float, reach: float):
        self.schema, self.slack, self.reach = schema, slack, reach

    def __call__(self, blocks: pa.Table, heads: pa.Table) -> pa.Table:
        heads = heads.sort_by([("bottom", "ascending"), ("hid", "ascending")])
        bottom, hx0, hx1 = (heads.column(c).to_numpy() for c in ("bottom", "hx0", "hx1"))
        order = np.empty(len(heads), np.int64)
        order[pc.sort_indices(heads.column("hid")).to_numpy()] = np.arange(len(heads))
        x0, x1, top = (blocks.column(c).to_numpy() for c in ("x0", "x1", "top"))
        gap, best = np.full(len(blocks), np.inf), np.full(len(blocks), -1)
        first = np.searchsorted(bottom, top)
        for step, at in ((1, first.copy()), (-1, first - 1)):
            on = np.arange(len(blocks))
            while len(on):
                on = on[(at[on] >= 0) & (at[on] < len(heads))]
                j = at[on]
                far = np.abs(bottom[j] - top[on])
                near = (far <= gap[on]) & (far < self.reach) & (bottom[j] >= top[on] - self.slack)
                on, j, far = on[near], j[near], far[near]
                better = (np.minimum(x1[on], hx1[j]) > np.maximum(x0[on], hx0[j])) & ((far < gap[on]) | (order[j] < order[best[on]]))
                gap[on[better]], best[on[better]] = far[better], j[better]
                at[on] += step
        found = pa.array(best, pa.int64(), mask=best < 0)
        columns = [pa.array(gap, pa.float64(), mask=best < 0), *[heads.column(c).take(found) for c in ("hid", "hx0", "hx1", "bottom")]]
        return pa.table([*[blocks.column(c) for c in self.schema.names[:-5]], *columns], names=self.schema.names).cast(self.schema)


def closest_above(blocks: DataFrame, headings: DataFrame, page: str = "page", slack: float = 2.0, width: float = 100.0, height: float = 100.0) -> DataFrame:
    """The heading above each block (y grows upward; its bottom at most ``slack`` below the block's top) that overlaps it
    sideways, of smallest gap, of equal ones the smallest hid. ``blocks``: page, id, x0, x1, top and more; ``headings``: page, hid, hx0,
    hx1, bottom. Blocks without one, without width or with a place that is null or not finite are left out.

    Pages are cut into a grid. A block is in one cell, and meets the headings that reach into this cell, the one beside it, or
    one above or below; it is wider than no cell, as wide blocks have wider cells. What it finds less than a cell's height
    away is its nearest. Blocks that find nothing, which are few, look in cells eight times as high, until these are as high as
    what there is. The first height, near ``height`` where headings are few, falls with their number, so a cell holds as many
    however many there are; its blocks are looked up in parts. ``width`` should be near that of a box; a heading is in as many columns as it touches, and one more."""
    width = _power(width)
    finite = lambda *names: reduce(lambda a, b: a & b, [F.abs(F.col(c)) < math.inf for c in names])
    heads = headings.where(F.col(page).isNotNull() & finite("hx0", "hx1", "bottom") & (F.col("hx0") < F.col("hx1")))
    heads = stored(heads.groupBy(page, "hx0", "hx1", "bottom").agg(F.min("hid").alias("hid")))
    # the last level is one column, for blocks of any width
    column = lambda x, level: F.when(level >= 40, 0).otherwise(F.floor(x / (F.lit(width) * F.pow(F.lit(2.0), level))))
    wide = F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2((F.col("x1") - F.col("x0")) / width)))).cast("int")
    left = blocks.where(F.col(page).isNotNull() & finite("x0", "x1", "top") & (F.col("x0") < F.col("x1"))).withColumn("_level", wide)
    more = column(F.col("x1"), F.col("_level")) > column(F.col("x0"), F.col("_level")) + 1  # rounding only
    left = left.withColumn("_level", F.when(more, F.col("_level") + 1).otherwise(F.col("_level"))).withColumn("_column", column(F.col("x0"), F.col("_level")))
    facts = left.groupBy("_level").agg(F.min("top").alias("low")).collect()
    high = heads.agg(F.max("bottom")).first()[0]
    span = 0.0 if not facts or high is None else high - min(f["low"] for f in facts) + 2 * slack
    level = F.explode(F.array(*[F.lit(f["_level"]) for f in facts])) if facts else F.lit(0)
    near = heads.withColumn("_level", level).withColumn("_column", F.explode(F.sequence(column(F.col("hx0"), F.col("_level")) - 1, column(F.col("hx1"), F.col("_level")))))
    cell = [page, "_level", "_column", "_row"]
    out = StructType([*left.schema.fields, StructField("_gap", DoubleType()), *[StructField(c, heads.schema[c].dataType) for c in ("hid", "hx0", "hx1", "bottom")]])
    reach, last, found = _fitting_reach(heads, page, width, _power(height)), False, []
    while not last:
        last = reach > span
        row = F.floor(F.col("bottom") / reach)
        listed = near.withColumn("_row", F.explode(F.sequence(row - 1, F.least(row + 1, F.floor((F.col("bottom") + 2 * slack) / reach)))))
        asking = left.withColumn("_row", F.floor(F.col("top") / reach))
        if found:
            listed = listed.join(asking.select(*cell).distinct(), cell, "left_semi")
        full = stored(asking.groupBy(*cell).agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("_parts")).where("_parts > 1"))
        if full.isEmpty():
            asking, listed = asking.withColumn("_part", F.lit(0)), listed.withColumn("_part", F.lit(0))
        else:
            parts = lambda df: df.join(full, cell, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
            asking = parts(asking).withColumn("_part", F.pmod(F.xxhash64(*blocks.columns), "_parts").cast("int"))
            listed = parts(listed).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        work = Nearest(to_arrow_schema(out), slack, reach)

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            return work(a, b)

        asked = stored(asking.groupBy(*cell, "_part").cogroup(listed.groupBy(*cell, "_part")).applyInArrow(run, out))
        found.append(asked.where("_gap is not null"))
        left = asked.where("_gap is null").select(*left.columns)
        reach *= 8
    return reduce(DataFrame.unionByName, found).select(*blocks.columns, "hid", "hx0", "hx1", "bottom")


def not_contained(inner: DataFrame, boxes: DataFrame, page: str = "page", slack: float = 3.0, width: float = 100.0) -> DataFrame:
    """Rows of ``inner`` (page, x0, y0, x1, y1, text) that lie in no box of the page whose text has theirs.

    The page is cut into squares of ``width``; a box is in each that it reaches into, a row where its first corner is, and rows meet
    boxes of their square only. Normal forms are columns, taken once a text. A row with a null place lies in no box."""
    square = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - slack) / width), F.floor((F.col(high) + slack) / width)))
    b = boxes.select(F.col(page).alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")], t.normalised("text").alias("_shown"))
    b = b.where("_x0 <= _x1 and _y0 <= _y1").withColumn("_cx", square("_x0", "_x1")).withColumn("_cy", square("_y0", "_y1"))
    rows = inner.withColumns({"_wanted": t.normalised("text"), "_ix": F.floor(F.col("x0") / width), "_iy": F.floor(F.col("y0") / width)})
    meets = (F.col(page) == F.col("_p")) & (F.col("_ix") == F.col("_cx")) & (F.col("_iy") == F.col("_cy"))
    inside = (F.col("x0") >= F.col("_x0") - slack) & (F.col("y0") >= F.col("_y0") - slack) & (F.col("x1") <= F.col("_x1") + slack) & (F.col("y1") <= F.col("_y1") + slack)
    return rows.join(b, meets & inside & F.contains("_shown", F.col("_wanted")), "left_anti").drop("_wanted", "_ix", "_iy")


def tolerant(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float = q.TOLERANCE) -> DataFrame:
    """Rows whose numbers differ by no more than a share of the larger: an equality join on logarithmic buckets and their
    neighbours, then the exact test. Zero equals zero only."""
    cells = right.withColumn("_cell", F.explode(F.when(F.col(b) == 0, F.array(F.lit(0))).otherwise(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: q.bucket(F.col(b), tolerance) + d))))
    mine = left.withColumn("_cell", F.when(F.col(a) == 0, F.lit(0)).otherwise(q.bucket(F.col(a), tolerance)))
    return mine.join(cells, "_cell").where(q.close(F.col(a), F.col(b), tolerance)).drop("_cell")


def duplicates(items: DataFrame, key: str, text: str, overlap: float = p.OVERLAP) -> DataFrame:
    """(a, b) of statements that say the same (``predicates.duplicate``), a before b.

    No word that many have makes pairs: statements that share the given part of their words share one of their rarest, so
    only the rarest of each (a fifth of them, and one more) are joined on. Equal statements meet by the whole, contained ones
    by the first 21 characters of the shorter, all as digests; the exact test decides."""
    rows = items.select(F.col(key).alias("k"), F.regexp_replace(t.normalised(text), r"^[ .]+|[ .]+$", "").alias("s"), p.overlap_tokens(F.col(text)).alias("w"))
    words = rows.select("k", F.size("w").alias("n"), F.explode("w").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("k").orderBy("df", "word"))
    rare = words.join(counts, "word").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(overlap) * F.col("n")) + 1).select("k", F.xxhash64(F.lit(1), "word").alias("h"))
    whole = rows.select("k", F.xxhash64(F.lit(2), "s").alias("h"))
    met = rare.unionByName(whole)
    pairs = met.select(F.col("k").alias("a"), "h").join(met.select(F.col("k").alias("b"), "h"), "h").where("a < b").select("a", "b")
    long = rows.where(F.length("s") > 20)
    inner = long.select(F.col("k").alias("x"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - 20), lambda i: F.xxhash64(F.substring(F.col("s"), i, F.lit(21)))))).alias("h"))
    heads = long.select(F.col("k").alias("y"), F.xxhash64(F.left("s", F.lit(21))).alias("h"))
    inside = inner.join(heads, "h").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    candidates = pairs.unionByName(inside).distinct()
    of = lambda c: rows.select(F.col("k").alias(c), F.col("s").alias(f"s{c}"), F.col("w").alias(f"w{c}"))
    both = candidates.join(of("a"), "a").join(of("b"), "b")
    contained = (F.least(F.length("sa"), F.length("sb")) > 20) & (F.contains("sa", F.col("sb")) | F.contains("sb", F.col("sa")))
    near = (F.size("wa") > 0) & (F.size("wb") > 0) & (F.size(F.array_intersect("wa", "wb")) >= overlap * F.size(F.array_union("wa", "wb")))
    return both.where((F.col("sa") == F.col("sb")) | contained | near).select("a", "b")
