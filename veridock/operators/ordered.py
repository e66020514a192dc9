"""Order-dependent operators: numbering, continuation, clustering, greedy selection, forward fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veridock.session import stored


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "seq") -> DataFrame:
    """A running number from 1 within each group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def id_label(prefix: Column, seq: Column, width: int = 3) -> Column:
    """``<prefix>-007``."""
    return F.concat(prefix, F.lit("-"), F.when(F.length(seq.cast("string")) >= width, seq.cast("string")).otherwise(F.lpad(seq.cast("string"), width, "0")))


def continued(df: DataFrame, by: Sequence[str], order: str, text: str, starts: Column, name: str = "group") -> DataFrame:
    """Rows that do not start a group belong to the one before; the first row of all always starts one."""
    w = W.partitionBy(*by).orderBy(order)
    flag = F.when((F.row_number().over(w) == 1) | starts, 1).otherwise(0)
    return df.withColumn("_start", flag).withColumn(name, F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_start")


def anchored(values: Column, gap: float) -> Column:
    """Cluster numbers of an ascending array: a new cluster begins where a value is ``gap`` or more above the first value
    of the current one."""
    zero = F.struct(F.lit(None).cast("double").alias("first"), F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["first"].isNull() | (x - acc["first"] >= gap)
        n = acc["n"] + new.cast("int")
        return F.struct(F.when(new, x.cast("double")).otherwise(acc["first"]).alias("first"), F.concat(acc["out"], F.array(n)).alias("out"), n.alias("n"))

    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def _summaries(gap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each (group, block) of ascending values, what becomes of an anchor that enters it: its first value that is ``gap`` or
    more above the anchor begins a cluster, and from there on all is settled. One row for each run of first values (``high`` is
    the run's largest) with the same last anchor and the same number of clusters."""

    def settle(key: tuple[str, int], values: list[float]) -> Iterator[tuple[str, int, float, float, int]]:
        n, after = len(values), len(values)
        last, count, following = [0.0] * n, [0] * n, [n] * n
        for i in range(n - 1, -1, -1):
            while after > i + 1 and values[after - 1] - values[i] >= gap:
                after -= 1
            following[i] = after
            last[i], count[i] = (values[i], 1) if after == n else (last[after], count[after] + 1)
        until = min(following[0], n - 1)
        for i in range(until + 1):
            if i == until or (last[i], count[i]) != (last[i + 1], count[i + 1]):
                yield (*key, values[i], last[i], count[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", pa.string()), ("block", pa.int32()), ("high", pa.float64()), ("last", pa.float64()), ("n", pa.int64())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        key, values = None, []
        for batch in batches:
            for k, b, v in zip(*(batch.column(c).to_pylist() for c in ("k", "block", "v")), strict=True):
                if (k, b) != key and values:
                    yield made(list(settle(key, values)))
                    values = []
                key = (k, b)
                values.append(v)
        if values:
            yield made(list(settle(key, values)))

    return run


def _entries(gap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The summaries of a group's blocks in order, to the anchor and the cluster number with which each block is entered. Only
    these two are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, anchor, number, entered = None, None, None, 0, True
        for batch in batches:
            out = ([], [], [], [])
            for k, b, high, last, n in zip(*(batch.column(c).to_pylist() for c in ("k", "block", "high", "last", "n")), strict=True):
                if k != key:
                    key, block, anchor, number = k, None, None, 0
                if b != block:
                    block, entered = b, False
                    for column, x in zip(out, (k, b, anchor, number), strict=True):
                        column.append(x)
                if not entered and (anchor is None or high - anchor >= gap):
                    anchor, number, entered = last, number + n, True
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["k", "block", "anchor", "number"])

    return run


def _numbers(gap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cluster of each value, from the anchor and the number with which its block is entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor, number = None, None, 0
        for batch in batches:
            out = []
            for k, b, v, first, before in zip(*(batch.column(c).to_pylist() for c in ("k", "block", "v", "anchor", "number")), strict=True):
                if (k, b) != key:
                    key, anchor, number = (k, b), first, before or 0
                if anchor is None or v - anchor >= gap:
                    anchor, number = v, number + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), pa.array(out, pa.int64())], names=["k", "v", "cluster"])

    return run


def _half(v: Column, gap: float) -> Column:
    """The cell of a value, half a gap wide; values that are too far from zero for that are cells of their own."""
    x = v / F.lit(gap / 2) if gap > 0 else F.lit(float("inf"))
    far = F.abs(x) >= 2.0**52
    return F.struct(far.alias("far"), F.when(far, v).otherwise(F.floor(F.when(~far, x)).cast("double")).alias("at"))


def clustered(df: DataFrame, by: Sequence[str], value: str, gap: float, name: str = "cluster") -> DataFrame:
    """``anchored`` for groups of any size: rows of a group by ascending value, numbered from 1; a new cluster begins where a
    value is ``gap`` or more above the first of the current one. Null values and NaN get a null cluster; infinite ones stand
    at the ends, each infinity in one cluster.

    Different values are sorted by range, so a large group lies in several blocks, one a partition. Where a cluster begins
    depends on all before it, but a block's effect on whatever anchor enters it is a step function of few rows. These
    alone are composed in order; then each block numbers its own values. Rows look their cluster up by cells half a gap wide, in
    which one cluster at most begins: the cells are few where values are many, and small tables are not shuffled for."""
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    v = F.col(value).cast("double")
    rows = df.withColumns({"_k": key, "_v": F.when(v == 0, F.lit(0.0)).when(~F.isnan(v), v)})
    parts = rows.where("_v is not null").select(F.col("_k").alias("k"), F.col("_v").alias("v")).distinct()
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(parts.repartitionByRange(count, "k", "v").withColumn("block", F.spark_partition_id()))
    across = blocks.groupBy("k").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("k")
    inside = lambda d: d.repartition("block").sortWithinPartitions("block", "k", "v")
    effects = inside(blocks.join(across, "k", "left_semi")).mapInArrow(_summaries(gap), "k string, block int, high double, last double, n long")
    entries = effects.repartition("k").sortWithinPartitions("k", "block", "high").mapInArrow(_entries(gap), "k string, block int, anchor double, number long")
    numbered_values = inside(blocks.join(entries, ["k", "block"], "left")).mapInArrow(_numbers(gap), "k string, v double, cluster long")
    starts = numbered_values.groupBy(F.col("k").alias("_k"), _half(F.col("v"), gap).alias("_cell"), "cluster").agg(F.min("v").alias("start"))
    cells = stored(starts.groupBy("_k", "_cell").agg(F.min("cluster").alias("_low"), F.max("cluster").alias("_high"), F.max("start").alias("_start")))
    found = rows.withColumn("_cell", _half(F.col("_v"), gap)).join(cells, ["_k", "_cell"], "left")
    return found.select(*df.columns, F.when(F.col("_v") >= F.col("_start"), F.col("_high")).otherwise(F.col("_low")).alias(name))


def filled(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """The last value that is there, in order."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


def dense_by_first(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "number") -> DataFrame:
    """Different values numbered in the order in which they first appear."""
    first = df.withColumn("_first", F.min(order).over(W.partitionBy(*by, value)))
    return first.withColumn(name, F.dense_rank().over(W.partitionBy(*by).orderBy("_first"))).drop("_first")


def quota(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], most: int, name: str = "place") -> DataFrame:
    """The first ``most`` rows of each group. Spark limits each partition before it shuffles."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


#: Rounds that decide many rows at once, before what is left is folded in blocks; rows or conflicts of a block.
ROUNDS, BLOCK_ROWS = 3, 500_000


def _folded(block: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """A block, which a limit has brought into one partition in order, through a fold; stored, as later plans refer to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold(batches)

    return block.mapInArrow(run, schema).checkpoint()


def _fold_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, second = set(), set()
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            new = not (a is not None and a in first) and not (b is not None and b in second)
            keep.append(new)
            if new:
                first.add(a)
                second.add(b)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keep, pa.bool_())], names=[*batch.schema.names, "keep"])


def greedy_two_keys(df: DataFrame, order: str, first_key: str, second_key: str, rounds: int = ROUNDS, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows in ``order`` (unique), each kept unless a row kept before has its first or second key. Null keys match nothing.

    A row that is the earliest undecided one for both of its keys is kept for certain, as whatever is before it is
    dropped; rows that share a key with a kept one are dropped. A few rounds of this, a few aggregates and joins of (order,
    keys) rows each, decide almost all rows. What is left are chains, on which a round decides little: they are folded in
    order, so many rows at a time in one task, and what a block keeps rules out rows behind it as before."""
    left = df.select(F.col(order).alias("o"), F.col(first_key).alias("a"), F.col(second_key).alias("b")).checkpoint()
    kept, done = None, 0
    while not left.isEmpty():
        if done < rounds:
            lead = lambda k: left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("o").alias(f"m{k}"))  # noqa: B023, E731
            best = left.join(lead("a"), "a", "left").join(lead("b"), "b", "left")
            new = best.where("(a is null or ma = o) and (b is null or mb = o)").select("o", "a", "b").checkpoint()
            decided = new.select("o")
        else:
            types = dict(left.dtypes)
            judged = _folded(left.select("o", "a", "b").orderBy("o").limit(block), _fold_keys, f"o {types['o']}, a {types['a']}, b {types['b']}, keep boolean")
            new, decided = judged.where("keep").select("o", "a", "b"), judged.select("o")
        kept, done = new if kept is None else kept.unionByName(new), done + 1
        left = left.join(new.select("a").where("a is not null").distinct(), "a", "left_anti").join(new.select("b").where("b is not null").distinct(), "b", "left_anti")
        left = left.join(decided, "o", "left_anti").checkpoint()
    chosen = left.select("o") if kept is None else kept.select("o")
    return df.join(chosen.withColumnRenamed("o", order), order, "left_semi")


class _FoldConflicts:
    """Conflicts sorted by their later item to what becomes of that item. Items without a conflict behind them are kept. The
    last one's conflicts may go on beyond the block, so it waits for the next, unless the block is the rest."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[object, bool] = {}
        last, rows, kind = None, 0, None
        for batch in batches:
            kind = batch.column("b").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                kept[b] = kept.get(b, True) and not kept.get(a, True)
                last, rows = b, rows + 1
        if rows == self.size and len(kept) > 1:
            kept.pop(last)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), kind), pa.array(list(kept.values()), pa.bool_())], names=["o", "keep"])


def greedy_conflicts(items: DataFrame, conflicts: DataFrame, order: str = "ord", rounds: int = ROUNDS, block: int = BLOCK_ROWS) -> DataFrame:
    """Items in order, each kept unless it conflicts with one kept before. ``conflicts`` has (a, b) with a before b. As
    above, an item with no undecided item before it in conflict is decided, and with it what it rules out; after a few rounds the
    conflicts that are left are folded in blocks, by their later item. In a block of one item's conflicts alone, all others are
    free, so it falls, whatever more it has."""
    left = items.select(F.col(order).alias("o")).checkpoint()
    edges = conflicts.select("a", "b").distinct().checkpoint()
    kept, done = None, 0
    while not edges.isEmpty():
        judged = None
        if done >= rounds:
            judged = _folded(edges.select("a", "b").orderBy("b", "a").limit(block), _FoldConflicts(block), f"o {dict(left.dtypes)['o']}, keep boolean")
        free = left.join(edges.select(F.col("b").alias("o")).distinct(), "o", "left_anti")
        new = (free if judged is None else free.unionByName(judged.where("keep").select("o"))).checkpoint()
        kept, done = new if kept is None else kept.unionByName(new), done + 1
        out = edges.join(new.select(F.col("o").alias("a")), "a", "left_semi").select(F.col("b").alias("o")).distinct()
        if judged is not None:
            out = out.unionByName(judged.where("not keep").select("o"))
        left = left.join(new, "o", "left_anti").join(out, "o", "left_anti").checkpoint()
        edges = edges.join(left.select(F.col("o").alias("a")), "a", "left_semi").join(left.select(F.col("o").alias("b")), "b", "left_semi").checkpoint()
    chosen = left if kept is None else kept.unionByName(left)
    return items.join(chosen.select(F.col("o").alias(order)), order, "left_semi")
