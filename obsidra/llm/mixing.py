"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Source token shares p are raised to an exponent t in [0, 1] and normalised: w = p**t / sum(p**t); t = 1 keeps the
natural mixture, t = 0 is uniform. The exponent is found by bisection (in 32-way sections, every section one aggregate
over the table of sources): either the entropy of w meets ``target_entropy``, or t is the least exponent at which no
source is repeated more often than ``max_repeat`` times as often as the least repeated one. The token budget is the
given one, or by default the one at which every source is passed at least once (no row is lost).

Realisation: a source's documents fall into 2**block_bits blocks by hash. Every epoch of a source visits its blocks in
a keyed order of its own; whole epochs take all blocks, the last one takes blocks in that order until the budget is
reached, the block on the border gives the documents that still fit, in hash order.

Defined cases: null source is a source of its own; null or empty texts count one token; repeated rows are rows of their
own, and of equal hash go by their other columns; an empty table gives an empty result; one source gets weight 1; columns of
the input are kept, those with the names of result columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_struct, staged

#: Columns that mixing adds.
ADDED = ("mix_tokens", "mix_weight", "mix_repeats", "mix_epoch", "mix_block_rank", "mix_order")
#: Rows of a block aimed at, were all of one source.
BLOCK_ROWS = 1 << 14
#: Sections of the exponent's interval per pass, and passes.
SECTIONS, PASSES = 32, 5
#: Rows of the block plan up to which it is broadcast; beyond, it is joined by shuffling.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Whitespace-separated words, at least one."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1)).cast("long")


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeat: float | None) -> float:
    """The mixing exponent over ``sources`` (columns share in (0, 1])."""
    if target_entropy is None and max_repeat is None:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tries = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        aggs = []
        for i, t in enumerate(tries):
            power = F.pow("share", F.lit(t))
            if target_entropy is not None:
                aggs += [F.sum(power).alias(f"z{i}"), F.sum(power * t * F.log("share")).alias(f"e{i}")]
            else:
                ratio = F.pow("share", F.lit(t - 1.0))
                aggs.append((F.max(ratio) / F.min(ratio)).alias(f"r{i}"))
        got = sources.agg(*aggs).first()
        if got[0] is None:
            return 1.0
        if target_entropy is not None:  # entropy falls as the exponent rises
            enough = [math.log(got[f"z{i}"]) - got[f"e{i}"] / got[f"z{i}"] >= target_entropy for i in range(len(tries))]
            last = max((i for i, ok in enumerate(enough) if ok), default=0)
            low, high = tries[last], tries[min(last + 1, SECTIONS)]
        else:  # repetition falls as the exponent rises
            first = next((i for i in range(len(tries)) if got[f"r{i}"] <= max_repeat * (1 + 1e-9)), SECTIONS)
            low, high = tries[max(first - 1, 0)], tries[first]
        if high <= low:
            break
    # six digits, rounded to the side on which the target holds
    return math.floor(low * 1e6) / 1e6 if target_entropy is not None else min(1.0, math.ceil(high * 1e6) / 1e6)


def mix(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    target_entropy: float | None = None,
    max_repeat: float | None = 2.0,
    budget_tokens: int | None = None,
    block_bits: int | None = None,
    seed: int = 7,
    with_text: bool = True,
) -> DataFrame:
    """``docs`` mixed to temperature weights; a row for each time a document is passed.

    Added columns: mix_tokens, mix_weight, mix_repeats, mix_epoch, mix_block_rank, mix_order (read a source in the order
    of the last three). ``with_text=False`` leaves the text out of the result and of the shuffle.
    """
    if block_bits is None:
        block_bits = min(20, max(8, (docs.count() // BLOCK_ROWS).bit_length()))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(
        row_struct(docs, (*ADDED, *(() if with_text else (text_col,)))).alias("__row"),
        key.alias("__source"),
        word_count(F.col(text_col)).alias("__tokens"),
        h.alias("__h"),
    ).withColumn("__block", F.shiftright(F.xxhash64("__h"), 64 - block_bits).cast("int"))
    if not with_text:
        rows = staged(rows, "mix-rows")  # texts are read and counted once
    blocks = staged(rows.groupBy("__source", "__block").agg(F.sum("__tokens").alias("tokens")), "mix-blocks", small=True)
    totals = blocks.groupBy("__source").agg(F.sum("tokens").alias("source_tokens"))
    every = totals.agg(F.sum("source_tokens")).first()[0] or 1
    sources = totals.withColumn("share", F.col("source_tokens") / F.lit(float(every)))
    exponent = find_exponent(sources, target_entropy, max_repeat)
    stats = sources.agg(F.sum(F.pow("share", F.lit(exponent))).alias("z"), F.max(F.pow("share", F.lit(1.0 - exponent))).alias("cover")).first()
    z = stats["z"] or 1.0
    budget = float(budget_tokens) if budget_tokens is not None else every * z * (stats["cover"] or 1.0)
    weighted = sources.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(z)).withColumn(
        "repeats", F.round(F.lit(budget) * F.col("weight") / F.col("source_tokens"), 9)
    )
    per_epoch = (
        blocks.join(weighted, "__source")
        .withColumn("whole", F.floor("repeats").cast("int"))
        .withColumn("rest", F.floor((F.col("repeats") - F.col("whole")) * F.col("source_tokens")).cast("long"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
        .withColumn("turn", F.xxhash64(F.lit(seed), "__source", "epoch", "__block"))
    )
    order = Window.partitionBy("__source", "epoch").orderBy("turn", "__block")
    plan = (
        per_epoch.withColumn("block_rank", F.row_number().over(order) - 1)
        .withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
        .withColumn("room", F.when(F.col("epoch") < F.col("whole"), F.col("tokens")).otherwise(F.least("tokens", F.col("rest") - F.col("before"))))
        .where("room > 0")
        .select("__source", "__block", "weight", "repeats", "epoch", "block_rank", "room", (F.col("room") < F.col("tokens")).alias("cut"))
    )
    plan = staged(plan, "mix-plan", small=True)
    hint = F.broadcast if plan.count() <= BROADCAST_ROWS else (lambda df: df)
    out = lambda df: df.select(
        "__row.*",
        F.col("__tokens").alias("mix_tokens"),
        F.col("weight").alias("mix_weight"),
        F.col("repeats").alias("mix_repeats"),
        F.col("epoch").alias("mix_epoch"),
        F.col("block_rank").alias("mix_block_rank"),
        F.col("__h").alias("mix_order"),
    )
    whole = rows.join(hint(plan.where("not cut")), ["__source", "__block"])
    inside = Window.partitionBy("__source", "__block", "epoch").orderBy("__h", F.to_json("__row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = rows.join(hint(plan.where("cut")), ["__source", "__block"]).withColumn("__sum", F.sum("__tokens").over(inside)).where("__sum <= room").drop("__sum")
    return out(whole).unionByName(out(border))
