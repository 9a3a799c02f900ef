"""Mixing sources to target weights by subset-sum budget fitting.

Targets come from weights (water-filling below a cap). A source's target is
met by whole passes over all its documents and by a budget for the rest. The
rest is fitted on counts of documents by exact token length. A budget of at most
DP_WIDTH words is fitted by a bounded-knapsack dynamic programme alone, which
finds the best sum; a greater one takes an equal share of every length first,
then ever shorter single documents, and always ends with the programme over the
lengths still at hand, so that less than the shortest document left is missed.
Which documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import checkpointed

#: Budgets that the dynamic programme fits as a whole, in words; of a greater one it fits the last half of this, or the shortest document's length if that is more.
DP_WIDTH = 1 << 18
#: Documents of one source and length that a single window may rank.
CELL_ROWS = 256
#: Sources and lengths up to which the fitted budgets are broadcast to the documents.
BROADCAST_CELLS = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Targets in proportion to the weights, at most cap times each size; the excess goes to the others by weight."""
    target = [0.0] * len(sizes)
    budget = share * sum(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = budget / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = weights[i] * unit
            break
        for i in over:
            target[i] = cap * sizes[i]
            budget -= target[i]
            open_.remove(i)
    return target


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes as near the budget as it can from below.

    reached[v] is the first bundle with which the sum v came about; each length
    is added in binary bundles, so its count bounds it. Time and memory grow
    with the budget, which the caller bounds.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return take
    reached = np.full(budget + 1, -2, dtype=np.int32)  # bundle that made the sum; -1 for 0
    reached[0] = -1
    bundles: list[tuple[int, int]] = []
    top = 0  # the greatest sum so far
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        if length <= 0 or length > budget:
            continue
        left, size = min(count, budget // length), 1
        while left > 0 and reached[budget] < -1:
            n = min(size, left)
            left -= n
            size *= 2
            step = n * length
            upto = min(budget, top + step)
            old = reached[: upto + 1] >= -1
            new = np.zeros_like(old)
            new[step:] = old[: upto + 1 - step]
            reached[: upto + 1][new & ~old] = len(bundles)
            bundles.append((i, n))
            top = int(np.flatnonzero(reached[: upto + 1] >= -1)[-1])
        if reached[budget] >= -1:
            break
    v = int(np.flatnonzero(reached >= -1)[-1])
    while v:
        i, n = bundles[reached[v]]
        take[i] += n
        v -= n * int(lengths[i])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take for the budget (words, at most the sum of all)."""
    total = int((lengths * counts).sum())
    budget = int(min(round(budget), total))
    if total == 0 or budget <= 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget == total:
        return counts.copy()
    if budget <= DP_WIDTH:
        return knapsack(lengths, counts, budget)
    take = np.minimum((counts * (budget / total)).astype(np.int64), counts)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        n = min(int(counts[i] - take[i]), max(0, rest - DP_WIDTH // 2) // int(lengths[i])) if lengths[i] > 0 else 0
        take[i] += n
        rest -= n * int(lengths[i])
    # what is left is less than DP_WIDTH / 2 plus the shortest document left
    return take + knapsack(lengths, counts - take, rest)


def plan(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_key, size, n, passes, extra, source_size, target): whole passes over the source and documents more of each length.

    histogram: (source_key, size, n), one row per source and length; a source's
    rows are as many as its distinct lengths, however many documents it has.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", kind="stable")
        lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        total, target = int((lengths * counts).sum()), float(group["target"].iloc[0])
        passes = int(min(2, (target + 1e-6) // total)) if total else 0
        extra = fit_budget(lengths, counts, target - passes * total) if passes < 2 else np.zeros(len(counts), dtype=np.int64)
        return pd.DataFrame({"source_key": group["source_key"], "size": lengths, "n": counts, "passes": passes, "extra": extra, "source_size": total, "target": target})

    return histogram.join(targets, "source_key").groupBy("source_key").applyInPandas(fit, "source_key string, size long, n long, passes int, extra long, source_size long, target double")


def source_targets(histogram: DataFrame, weights: tuple[float, ...], share: float, cap: float = 2.0) -> DataFrame:
    """(source_key, target), as water_fill has it, for any number of sources.

    Sources are numbered in ranges of their order: one count per range comes to
    the driver. The unit of weight only grows while sources meet their cap, so
    a round needs two sums, and the sources at their cap follow from the unit.
    """
    sizes = histogram.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("words"))
    ordered = sizes.orderBy(F.col("source_key") == NULL_KEY, "source_key").withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ordered = checkpointed(ordered)
    firsts, first = [], 0
    for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        firsts.append((r["_part"], first))
        first += r["n"]
    firsts = histogram.sparkSession.createDataFrame(firsts, "_part int, _first long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_first") + F.col("_in")) % len(weights) + 1).cast("int"))
    rows = ordered.join(F.broadcast(firsts), "_part").select("source_key", "words", weight.alias("w"))
    total = rows.agg(F.sum("words")).first()[0] or 0.0
    unit, closed = 0.0, 0
    while True:
        full = F.col("w") * unit > cap * F.col("words")
        is_open = (F.col("words") > 0) & ~full
        met, left, now = rows.agg(F.sum(F.when(full, cap * F.col("words"))), F.sum(F.when(is_open, F.col("w"))), F.count(F.when(full & (F.col("words") > 0), 1))).first()
        if (unit and now == closed) or not left:
            break
        unit, closed = (share * total - (met or 0.0)) / left, now
    return rows.select("source_key", F.when(F.col("words") > 0, F.least(F.col("w") * unit, cap * F.col("words")) if left else cap * F.col("words")).otherwise(0.0).alias("target"))


#: Stands for a null source in keys: "s" + source otherwise.
NULL_KEY = "n"


def row_keys(seed: str) -> dict[str, Column]:
    """What the mix needs of each row: its source's key, its size and its draw, a hash of 62 bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {
        "_key": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(NULL_KEY)),
        "_size": word_count(F.col("text")),
        "_draw": F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(text.cast("binary")), F.lit(seed)), 2),
    }


def narrow_rows(documents: DataFrame, seed: str) -> DataFrame:
    return documents.select("doc_id", *[e.alias(c) for c, e in row_keys(seed).items()])


def budgets(rows: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """(_key, _size, n, passes, extra, source_size, target) of every source and length, checkpointed."""
    histogram = checkpointed(rows.groupBy(F.col("_key").alias("source_key"), F.col("_size").alias("size")).agg(F.count("*").alias("n")))
    planned = plan(histogram, source_targets(histogram, weights, share))
    return checkpointed(planned.withColumnsRenamed({"source_key": "_key", "size": "_size"}))


def with_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with the columns of their cell. Cells are broadcast if they are few; else only those of many documents, so that none of these meets in one task."""
    at = ["_key", "_size"]
    if cells.count() <= BROADCAST_CELLS:
        return rows.join(F.broadcast(cells), at)
    hot = cells.filter(F.col("n") > BROADCAST_CELLS)  # at most one for each BROADCAST_CELLS documents
    marked = rows.join(F.broadcast(hot), at, "left")
    few = marked.filter("n is null").select(rows.columns).join(cells.filter(F.col("n") <= BROADCAST_CELLS), at)
    return marked.filter("n is not null").unionByName(few)


def ranked(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with their cell's columns and `_rank`, from 1 by the draw, where only some of the cell's documents are extra (else null).

    A cell of more than CELL_ROWS documents is ranked in several windows, by
    ranges of the draw; counts of the ranges put them in sequence.
    """
    joined = with_cells(rows, cells)
    partial = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    some = joined.filter(partial).withColumn("_salt", F.floor(F.col("_draw") / float(1 << 62) * (1 + F.floor(F.col("n") / CELL_ROWS))).cast("long"))
    cell = ["_key", "_size"]
    counts = some.groupBy(*cell, "_salt").agg(F.count("*").alias("_in"))
    before = Window.partitionBy(*cell).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*cell, "_salt", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*cell, "_salt").orderBy("_draw", "doc_id"))
    some = some.withColumn("_rank", rank).join(firsts, [*cell, "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_salt", "_first")
    return joined.filter(~partial).withColumn("_rank", F.lit(None).cast("long")).unionByName(some)


def mix_documents(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; taken = size times the passes that take it (0, 1 or 2).

    Sources stand by code point, null last, and take the weights in turn;
    only doc_id, text and source are read. Null
    texts and texts without words have size 0 and give 0 words. Repeated rows
    are documents of their own; an empty table gives no rows.
    """
    rows = checkpointed(narrow_rows(documents, seed))
    cells = budgets(rows, weights, share)
    extra = F.when(F.col("_rank").isNull(), F.col("extra") > 0).otherwise(F.col("_rank") <= F.col("extra")).cast("int")
    return ranked(rows, cells).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * (F.col("passes") + extra)).alias("taken"))


def repeat_mixed(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, seed: str = "mix") -> DataFrame:
    """The documents as the mix takes them, all columns kept: each 0, 1 or 2 times.

    Each cell's extra documents are those up to a cut of the draw, so the texts
    themselves are neither ranked nor, while the cells number at most
    BROADCAST_CELLS, shuffled. Rows equal in id and text share a draw and go
    together. Null sources are a source of their own; null texts and texts
    without words go as often as the mix takes length 0; an empty table gives
    no rows; columns named like the operator's own are kept as they are.
    """
    rows = checkpointed(narrow_rows(documents, seed))
    cells = budgets(rows, weights, share)
    cut = ranked(rows, cells).filter(F.col("_rank") <= F.col("extra")).groupBy("_key", "_size").agg(F.max("_draw").alias("_cut"))
    cells = checkpointed(cells.join(cut, ["_key", "_size"], "left").select("_key", "_size", "passes", "extra", "n", "_cut"))
    full = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), *[e.alias(c) for c, e in row_keys(seed).items()])
    extra = F.when(F.col("extra") >= F.col("n"), 1).when(F.col("_draw") <= F.col("_cut"), 1).otherwise(0)
    taken = with_cells(full, cells).withColumn("_copies", F.col("passes") + extra)
    return taken.filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
