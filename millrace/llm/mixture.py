"""Mixing sources to target weights through a tree of domain, language and source.

A token budget flows down the tree. Children share their parent's budget by weight; what a child cannot use,
because all its epochs hold fewer tokens, goes to its siblings by weight, and only what no sibling can use stays
with the parent, whose own siblings then share it. As a node's room is the sum of its children's, one pass per level
from the top does this. A leaf's budget is met by whole epochs and by the beginning of one more: every epoch has
an order of its own from a seeded hash, and documents are taken until the budget is reached.

Everything is DataFrame and SQL functions. Tables passed between levels have a row per node; a leaf's cut is found
by narrowing the hash range digit by digit, so no leaf is ever sorted as a whole, however large it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
DIGITS, ROUNDS = 2, 2  # hexadecimal digits by which a round narrows the range of hashes
HUGE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def epoch_hash(seed: int, epoch: Column, id: Column) -> Column:
    """The place of a document in an epoch; null ids count as empty."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id.cast("string"), F.lit(""))))


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share ``budget`` of each parent among its children by ``weight``, none above its ``room``.

    Children are taken in the order of room by weight; a child is full when its weight's share of what is left
    is no less than its room. What the division leaves over, less than a token per child, is not given out.
    """
    order = [F.when(F.col("weight") > 0, F.col("room").cast("double") / F.col("weight")).asc_nulls_last(), F.col(name)]
    group = Window.partitionBy(*parent)
    so_far = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = group.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    marked = (
        children.withColumn("_before", F.coalesce(F.sum("room").over(so_far), F.lit(0).cast(HUGE)))
        .withColumn("_weights", F.sum("weight").over(rest))
        .withColumn("_full", F.expr("room * _weights <= (budget - _before) * weight"))
    )
    left = marked.withColumn(
        "_left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("room"))).over(group), F.lit(0))
    ).withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group))
    given = F.expr("CASE WHEN _full THEN room WHEN _open > 0 THEN CAST((_left * weight) div _open AS decimal(38,0)) "
                   "ELSE CAST(0 AS decimal(38,0)) END")
    return left.select(*parent, name, "room", given.alias("given"))


def leaf_budgets(
    leaves: DataFrame, weights: DataFrame, share: tuple[int, int], max_epochs: int, levels=LEVELS
) -> DataFrame:
    """``(*levels, tokens, budget)``: how many tokens every leaf gives.

    ``leaves`` has ``tokens`` per leaf; the whole budget is ``share`` (a fraction) of all tokens. ``weights`` is a table
    ``(level, name, weight)`` of whole numbers; a name without a row weighs 1, with weight 0 it gets nothing.
    """
    levels = list(levels)
    known = weights.groupBy("level", "name").agg(F.max("weight").cast(HUGE).alias("weight"))
    nodes = {len(levels): leaves.select(*levels, (F.col("tokens") * max_epochs).cast(HUGE).alias("room"))}
    for depth in range(len(levels), 0, -1):
        level = levels[depth - 1]
        own = known.filter(F.col("level") == level).select(F.col("name").alias(level), "weight")
        weighed = nodes[depth].join(own, level, "left").withColumn(
            "weight", F.coalesce("weight", F.lit(1).cast(HUGE))
        )
        weighed = weighed.withColumn("room", F.when(F.col("weight") > 0, F.col("room")).otherwise(F.lit(0).cast(HUGE)))
        nodes[depth] = weighed
        nodes[depth - 1] = weighed.groupBy(*levels[: depth - 1]).agg(F.sum("room").cast(HUGE).alias("room"))
    all_tokens = leaves.agg(F.sum("tokens").cast(HUGE).alias("_all"))
    given = nodes[0].join(F.broadcast(all_tokens)).select(  # one row and one row
        F.least(F.coalesce("room", F.lit(0)), F.expr(f"CAST((_all * {share[0]}) div {share[1]} AS decimal(38,0))")).alias("given")
    )
    for depth in range(1, len(levels) + 1):
        parent = levels[: depth - 1]
        above = given.select(*parent, F.col("given").alias("budget"))
        below = nodes[depth].join(above, parent) if parent else nodes[depth].join(F.broadcast(above))
        given = _fill(below, parent, levels[depth - 1])
    return leaves.join(given, levels).select(*levels, "tokens", F.col("given").cast("long").alias("budget"))


def leaf_cuts(sized: DataFrame, budgets: DataFrame, seed: int, levels=LEVELS) -> DataFrame:
    """``(*levels, full, cut_hash, cut_id)``: whole epochs of a leaf, and where the next one ends.

    The last document taken is the first with which the epoch reaches the rest of the budget; documents with equal ids are
    taken or left together. ``cut_hash`` is null when no more is needed.
    """
    levels = list(levels)
    turns = budgets.select(
        *levels,
        F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END").alias("full"),
        F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END").alias("rest"),
    )
    open_leaves = turns.filter("rest > 0").withColumn("prefix", F.lit(""))
    hashed = sized.join(turns.filter("rest > 0").select(*levels, "full"), levels).select(
        *levels, "id", "n_tokens", epoch_hash(seed, F.col("full"), F.col("id")).alias("hash")
    )
    for turn in range(ROUNDS):
        start = turn * DIGITS
        inside = hashed.join(open_leaves.select(*levels, "rest", "prefix", "full"), levels).filter(
            F.substring("hash", 1, start) == F.col("prefix") if turn else F.lit(True)
        )
        bins = inside.groupBy(*levels, "full", "rest", F.substring("hash", 1, start + DIGITS).alias("prefix")).agg(
            F.sum("n_tokens").alias("tokens")
        )
        order = Window.partitionBy(*levels).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("tokens").over(order), F.lit(0))
        open_leaves = (
            bins.withColumn("before", before)
            .filter("before < rest AND rest <= before + tokens")
            .select(*levels, "full", (F.col("rest") - F.col("before")).alias("rest"), "prefix")
        )
    last = hashed.join(open_leaves, levels).filter(F.substring("hash", 1, DIGITS * ROUNDS) == F.col("prefix"))
    last = last.groupBy(*levels, "rest", "hash", "id").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.partitionBy(*levels).orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        last.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
        .filter("before < rest AND rest <= before + tokens")
        .select(*levels, F.col("hash").alias("cut_hash"), F.col("id").alias("cut_id"))
    )
    return turns.select(*levels, "full").join(cut, levels, "left")


def mix(
    docs: DataFrame, domain: Column, weights: DataFrame, share: tuple[int, int] = (1, 2), max_epochs: int = 4,
    seed: int = 6, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """The rows of ``docs`` with ``epoch`` and ``n_tokens``, once for every epoch that takes them.

    Tokens are words. Null names of a level are the empty name, null texts have no tokens, null ids are one id. Rows with
    equal ids are taken or left together. A document without tokens comes with every whole epoch of its leaf, and with
    a part of one if it lies before the cut. Columns of ``docs`` stay; new names step aside for columns of the same name.
    """
    levels = list(LEVELS)
    epoch, tokens = fresh(docs, "epoch", "n_tokens")
    leaf = [domain, F.col(f"`{lang}`"), F.col(f"`{source}`")]
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(leaf, levels, strict=True)]
    sized = stage(
        docs.select(*named, F.col(f"`{id}`").alias("id"), word_count(F.col(f"`{text}`")).alias("n_tokens")), "sized"
    )
    leaves = sized.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    budgets = stage(leaf_budgets(leaves, weights, share, max_epochs, levels), "budgets")
    cuts = stage(leaf_cuts(sized, budgets, seed, levels), "cuts")
    columns = [*levels, "full", "cut_hash", "cut_id"]
    names = fresh(docs, *(f"_{c}" for c in columns))
    renamed = cuts.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)))
    same = reduce(
        lambda a, b: a & b,
        (F.coalesce(c.cast("string"), F.lit("")) == F.col(n) for c, n in zip(leaf, names, strict=False)),
    )
    full, cut_hash, cut_id = (F.col(n) for n in names[len(levels) :])
    place = epoch_hash(seed, full, F.col(f"`{id}`"))
    own = F.coalesce(F.col(f"`{id}`"), F.lit(-(2**63)))
    at_cut = (place == cut_hash) & (own <= F.coalesce(cut_id, F.lit(-(2**63))))
    partly = F.coalesce((place < cut_hash) | at_cut, F.lit(False))
    times = full + partly.cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return (
        docs.join(renamed, same)
        .filter(times > 0)
        .select(
            *kept,
            F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias(epoch),
            word_count(F.col(f"`{text}`")).alias(tokens),
        )
    )
