"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import materialize

#: Words are runs of anything but blanks and the controls 9 to 13.
WORD = r"[^ \t\n\x0B\f\r]+"
#: Hexadecimal digits of the order's hash that name a bucket of a leaf; a bucket in which a prefix ends is split by as many more while it has more rows than this.
BUCKET_DIGITS, EDGE_ROWS = 3, 1_000_000
#: Part of all words that a balanced budget takes at least.
LEAST_BALANCED = 1, 2


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    chosen = F.lit(1)
    for name, weight in sorted(weights.get(level, {}).items()):
        chosen = F.when(F.col(level) == name, int(weight)).otherwise(chosen)
    return chosen.cast("long")


def _fill(children: DataFrame, parents: DataFrame, above: list[str], level: str) -> DataFrame:
    """Shares each parent's budget among its children by weight w, none beyond its capacity.

    In order of capacity by weight, a child is full if its capacity is no more than its share of what the
    full ones before it leave. The rest is shared by weight, whole tokens that are left over go one each to
    the first. All in integers, so that nothing is lost or rounded twice.
    """
    rows = children.where("w > 0 and cap > 0")
    rows = rows.join(parents, above) if above else rows.withColumn("budget", parents.scalar())
    order = Window.partitionBy(*above).orderBy(F.col("cap").cast("double") / F.col("w"), level)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*above)
    rows = rows.withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("b_left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("over", (F.col("cap") * F.col("w_left") > F.col("b_left") * F.col("w")).cast("int"))
    rows = rows.withColumn("open", F.max("over").over(order.rowsBetween(Window.unboundedPreceding, 0)) > 0)
    open_w, full_cap = F.sum(F.when(F.col("open"), F.col("w")).otherwise(0)).over(whole), F.sum(F.when(F.col("open"), 0).otherwise(F.col("cap"))).over(whole)
    rows = rows.withColumn("w_open", open_w).withColumn("b_open", F.col("budget") - full_cap)
    rows = rows.withColumn("share", F.when(F.col("open"), F.expr("(b_open * w) div w_open")).otherwise(F.col("cap")))
    spare = F.col("b_open") - F.sum(F.when(F.col("open"), F.col("share")).otherwise(0)).over(whole)
    nth = F.sum(F.col("open").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("spare", spare).withColumn("nth", nth)
    budget = F.col("share") + F.when(F.col("open") & (F.col("nth") <= F.col("spare")), 1).otherwise(0)
    return rows.select(*above, level, budget.alias("budget"))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], total: Column) -> DataFrame:
    """(levels, budget) of leaves (levels, cap). total sees the column cap, the capacity of all; no more than that is given out.

    A node's capacity is its leaves'. Budgets go down level by level, so what a node's children cannot use
    first goes to their siblings, and to the node's own siblings only if all of them are full.
    """
    levels = list(levels)
    parents = leaves.agg(F.sum("cap").alias("cap")).where("cap is not null").select(F.least("cap", total.cast("long")).alias("budget"))
    for k, level in enumerate(levels):
        nodes = leaves.groupBy(*levels[: k + 1]).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        parents = _fill(nodes, parents, levels[:k], level)
    return parents


def balanced_budget(leaves: DataFrame, level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """The budget at which the scarcest of the level's values that weights name is just used up, but LEAST_BALANCED of all capacity at least: then it is short, and the others share the rest."""
    named = [name for name, w in weights.get(level, {}).items() if w]
    nodes = leaves.groupBy(level).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights)).where("w > 0 and cap > 0")
    whole = nodes.agg(F.sum("w")).scalar()
    scarcest = nodes.where(F.col(level).isin(named)).withColumn("whole", whole).agg(F.min(F.expr("cap * whole div w"))).scalar()
    return F.greatest(F.coalesce(scarcest, F.col("cap")), F.expr(f"cap * {LEAST_BALANCED[0]} div {LEAST_BALANCED[1]}"))


def mix_sources(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int] | None, seed: int = 0, max_epochs: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, levels, epoch, n_tokens, take_tokens): what is taken of each document in each epoch.

    levels names the tree's levels from the root and gives their values; weights holds integers for values
    of a level, 1 if not named, 0 to leave out. The budget is share[0] / share[1] of all words; without a share it is the
    largest that gives each value named in the first level's weights its part (see balanced_budget()). A leaf can
    give max_epochs times its words. Every epoch orders a leaf's documents by a hash of seed, epoch and
    id; whole epochs are taken first, then the next one's prefix, of which the last document may be cut
    (take_tokens < n_tokens). The budgets of all leaves are met to the word.

    Only the bucket of hashes in which a prefix ends is put in order, split until it is small and with equal rows counted, so that no leaf and no group of copies
    passes through one task.
    Null text has no words; documents without words are never taken. A null level value is the value `none`.
    A null id is hashed as empty. Repeated rows are taken one by one. Other columns are ignored; an empty
    table gives no rows.
    """
    names = list(levels)
    light = docs.select(F.col(id_col).alias("doc_id"), *(F.coalesce(c, F.lit("none")).alias(k) for k, c in levels.items()), token_count(F.col(text_col)).alias("n_tokens"))
    light = materialize(light.where("n_tokens > 0"), "counted")
    leaves = light.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs)
    total = F.expr(f"(cap div {int(max_epochs)}) * {int(share[0])} div {int(share[1])}") if share else balanced_budget(leaves, names[0], weights)
    budgets = leaf_budgets(leaves, names, weights, total)
    plan = leaves.join(budgets, names).select(*names, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest"))
    plan = materialize(plan, "plan")
    rows = light.join(plan, names)
    whole = rows.where("epochs > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, epochs - 1)")))
    whole = whole.select("doc_id", *names, "epoch", "n_tokens", F.col("n_tokens").alias("take_tokens"))

    last = rows.where("rest > 0").withColumn("mix", F.md5(F.concat_ws(":", F.lit(seed), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    ends = _ends(last, plan, names)
    last = last.join(ends, names).withColumn("bucket", F.expr("substring(mix, 1, length(end))"))
    inner = last.where("bucket < end").select("doc_id", *names, F.col("epochs").alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    order = Window.partitionBy(*names).orderBy("mix", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    same = [*names, "mix", "doc_id", "n_tokens", "epochs", "rest", "before"]
    edge = last.where("bucket = end").groupBy(*same).agg(F.count("*").alias("copies"))
    edge = edge.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")).over(order), F.lit(0))).where("left > 0")
    edge = edge.withColumn("copy", F.explode(F.expr("sequence(1L, least(copies, (left + n_tokens - 1) div n_tokens))")))
    edge = edge.select("doc_id", *names, F.col("epochs").alias("epoch"), "n_tokens", F.expr("least(n_tokens, left - (copy - 1) * n_tokens)").alias("take_tokens"))
    return whole.union(inner).union(edge)


def _ends(last: DataFrame, plan: DataFrame, names: list[str]) -> DataFrame:
    """(names, end, before): the bucket of each leaf in which its prefix ends, as the first digits of its hashes, and the words before it.

    A bucket that hardly shrinks when it is split holds copies of one id, which are counted together later.
    """
    inside, known, digits = last, plan.select(*names, "rest", F.lit(0).cast("long").alias("before")), 0
    while True:
        digits += BUCKET_DIGITS
        sums = inside.groupBy(*names, F.substring("mix", 1, digits).alias("end")).agg(F.sum("n_tokens").alias("inside"), F.count("*").alias("n"))
        order = Window.partitionBy(*names).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.join(known, names).withColumn("before", F.col("before") + F.coalesce(F.sum("inside").over(order), F.lit(0)))
        ends = materialize(sums.where("before < rest and before + inside >= rest").select(*names, "end", "before", "n"), "ends")
        size = ends.agg(F.max("n")).first()[0] or 0
        if size <= EDGE_ROWS or digits >= 32 or digits > BUCKET_DIGITS and size > was * 0.9:
            return ends.drop("n")
        inside = last.join(ends.select(*names, F.col("end").alias("upto")), names).where("substring(mix, 1, length(upto)) = upto")
        known, was = ends.join(plan, names).select(*names, "rest", "before"), size
