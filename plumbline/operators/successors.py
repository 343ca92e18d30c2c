"""Greedy cuts of long groups without a task that holds one: prefix sums, range search, and chains of a successor function.

A greedy fill closes a window where the next row would exceed a budget. Where the next window ends depends only on where this
one does, so every row has a successor, and the windows are the chain of successors from the beginning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .scratch import placed, written

#: Rows of a group that one task of a chain takes.
BLOCK_ROWS = 50_000


def _earlier() -> WindowSpec:
    """The ranges of a group before one."""
    return Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)


def _of_range(group: str) -> Column:
    return F.col(group).eqNullSafe(F.col("__g")) & (F.col("__pid") == F.col("__r"))


def summed(rows: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """`rows` with n, their number from 1 in their group, and total, the sum of `size` up to each; written."""
    ranged = placed(rows, group, order)
    before = ranged.groupBy(F.col(group).alias("__g"), F.col("__pid").alias("__r")).agg(F.count("*").alias("__n0"), F.sum(F.col(size).cast("long")).alias("__s0"))
    before = before.select("__g", "__r", *[F.coalesce(F.sum(c).over(_earlier()), F.lit(0)).alias(c) for c in ("__n0", "__s0")])
    inside = Window.partitionBy(group, "__pid").orderBy(*order)
    ranged = ranged.withColumn("__n", F.row_number().over(inside)).withColumn("__s", F.sum(F.col(size).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ranged.join(before, _of_range(group))
    return written(joined.select(*rows.columns, (F.col("__n") + F.col("__n0")).cast("long").alias("n"), (F.col("__s") + F.col("__s0")).alias("total")), "summed")


def last_within(rows: DataFrame, asked: DataFrame, group: str) -> DataFrame:
    """`asked` (group, at, limit) with `last`: the greatest n of the group's `rows` (n, total) whose total is at most the limit,
    0 without one. Rows and limits are sorted together in ranges; totals must not fall with n."""
    both = rows.select(group, F.col("total").alias("__value"), F.lit(0).alias("__kind"), F.col("n").alias("__n"), F.lit(None).cast("long").alias("at"))
    both = both.unionByName(asked.select(group, F.col("limit").alias("__value"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__n"), "at"))
    ranged = placed(both, group, ["__value", "__kind"])
    before = ranged.groupBy(F.col(group).alias("__g"), F.col("__pid").alias("__r")).agg(F.max("__n").alias("__m")).select("__g", "__r", F.max("__m").over(_earlier()).alias("__n0"))
    inside = Window.partitionBy(group, "__pid").orderBy("__value", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("__in", F.max("__n").over(inside)).join(before, _of_range(group)).where("__kind = 1")
    return found.select(group, "at", F.coalesce(F.greatest("__in", "__n0"), F.lit(0)).cast("long").alias("last"))


def _walked(block: pd.DataFrame) -> pd.DataFrame:
    """`block` (at, next) sorted, with where each row's chain leaves the block (out) and after how many steps."""
    block = block.sort_values("at", ignore_index=True)
    at = block["at"].to_numpy(np.int64)
    following = block["next"].fillna(-1).to_numpy(np.int64)
    inside = np.searchsorted(at, following)
    out, steps = following.copy(), np.ones(len(at), np.int64)
    for i in range(len(at) - 1, -1, -1):
        j = inside[i]
        if following[i] >= 0 and j < len(at) and at[j] == following[i]:
            out[i], steps[i] = out[j], steps[j] + 1
    return block.assign(out=out, steps=steps, inside=inside)


def chain(steps: DataFrame, group: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """group, number, at: what is reached from 0 of each group by `steps` (group, at, next), numbered from 1 in order.

    `next` is greater than `at`, and null where the chain ends. Rows are cut into blocks of `block_rows`; a task finds where the
    chain of each row that is entered from outside leaves its block. From block to block the chain is followed by doubling:
    each round joins what is reached with jumps of twice the length, so rounds grow with the logarithm of the blocks. Then
    each block lists its part of the chain.
    """
    kind = dict(steps.dtypes)[group]
    block = lambda c: F.floor(F.col(c) / block_rows)
    entered = steps.where(F.col("next").isNotNull() & (block("next") != block("at"))).select(F.col(group).alias("__g"), F.col("next").alias("__a")).distinct()
    marked = steps.join(entered, F.col(group).eqNullSafe(F.col("__g")) & (F.col("at") == F.col("__a")), "left")
    marked = written(marked.select(group, "at", "next", block("at").alias("block"), (F.col("__a").isNotNull() | (F.col("at") == 0)).alias("entry")), "steps")

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        own = _walked(pdf)
        own = own[own["entry"] & (own["out"] >= 0)]
        return own[[group, "at", "out", "steps"]]

    reached = written(steps.where("at = 0").select(group, "at", F.lit(0).cast("long").alias("number")), "reached")
    jumps = written(marked.groupBy(group, "block").applyInPandas(leave, f"`{group}` {kind}, at long, out long, steps long"), "jumps")
    while jumps.limit(1).count():
        j = jumps.select(F.col(group).alias("__g"), F.col("at").alias("__a"), "out", "steps")
        further = reached.join(j, F.col(group).eqNullSafe(F.col("__g")) & (F.col("at") == F.col("__a"))).select(group, F.col("out").alias("at"), (F.col("number") + F.col("steps")).alias("number"))
        further = written(further, "reached-further")
        if not further.limit(1).count():
            break
        reached = written(reached.unionByName(further), "reached")
        twice = jumps.select(group, "at", F.col("out").alias("__o"), F.col("steps").alias("__s")).join(j, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__o") == F.col("__a")))
        jumps = written(twice.select(group, "at", "out", (F.col("__s") + F.col("steps")).alias("steps")), "jumps")

    def listed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = _walked(pdf)
        at, inside, following = own["at"].to_numpy(), own["inside"].to_numpy(), own["next"].fillna(-1).to_numpy(np.int64)
        rows = []
        for i, number in own["number"].dropna().items():
            number = int(number)
            while True:
                rows.append((number, int(at[i])))
                j = inside[i]
                if following[i] < 0 or j >= len(at) or at[j] != following[i]:
                    break
                i, number = j, number + 1
        out = pd.DataFrame(rows, columns=["number", "at"])
        out.insert(0, group, [key[0]] * len(out))
        return out

    r = reached.select(F.col(group).alias("__g"), F.col("at").alias("__a"), "number")
    blocks = r.select("__g", block("__a").alias("__b")).distinct()
    own = marked.join(blocks, F.col(group).eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__b")), "left_semi")
    own = own.join(r, F.col(group).eqNullSafe(F.col("__g")) & (F.col("at") == F.col("__a")), "left").select(group, "block", "at", "next", "number")
    return own.groupBy(group, "block").applyInPandas(listed, f"`{group}` {kind}, number long, at long").where("number > 0")
