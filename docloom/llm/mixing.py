"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A budget of tokens goes down a tree of levels (such as domain, language, source) in proportion to weights. No node gets
more than its leaves can give; what a child cannot take goes to its siblings, and only what a whole family cannot
take goes to the parent's siblings. Each leaf then gives the longest prefix of its budget from a stream of seeded epochs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

#: Rows of a prefix bucket, and the number of leaves up to which the leaf table is broadcast.
BUCKET_ROWS, SMALL = 1000, 100_000


def n_words(text: Column) -> Column:
    """Words between white space; 0 for a null or blank text."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_fill(children: DataFrame, parents: DataFrame | None, parent_cols: Sequence[str], key: str, budget: int) -> DataFrame:
    """children (parent_cols, key, weight, capacity) with `alloc`: the parent's budget shared by weight, nobody above capacity.

    With the children in order of capacity / weight, the level at which the budget is used up is the largest of
    (budget - capacities before) / (weights from here on); a child gets its weight times that level, at most its capacity.
    """
    if parents is None:
        at = children.withColumn("given", F.lit(float(budget)))
    else:
        at = children.join(parents.select(*parent_cols, F.col("alloc").alias("given")), list(parent_cols))
    family = Window.partitionBy(*(parent_cols or [F.lit(0)]))
    ranked = family.orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(float("inf")), key)
    before = F.coalesce(F.sum("usable").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_on = F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    at = at.withColumn("usable", F.when(F.col("weight") > 0, F.col("capacity").cast("double")).otherwise(0.0))
    at = at.withColumn("level", F.when(F.col("weight") > 0, (F.col("given") - before) / weight_on))
    at = at.withColumn("level", F.max("level").over(family))
    return at.withColumn("alloc", F.coalesce(F.least(F.col("usable"), F.greatest(F.col("weight") * F.col("level"), F.lit(0.0))), F.lit(0.0))).drop("given", "level", "usable")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, float], budget: int, max_epochs: int) -> DataFrame:
    """leaves (levels, tokens, n) with `leaf_budget`, in whole tokens."""
    spark = leaves.sparkSession
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    given = None
    for depth in range(1, len(levels) + 1):
        cols = list(levels[:depth])
        level = nodes.groupBy(*cols).agg(F.sum("capacity").alias("capacity"))
        own = [(*path, float(w)) for path, w in weights.items() if len(path) == depth]
        if own:
            table = spark.createDataFrame(own, ", ".join(f"`{c}` string" for c in cols) + ", given_weight double")
            level = level.join(F.broadcast(table), cols, "left").withColumn("weight", F.coalesce("given_weight", F.lit(1.0))).drop("given_weight")
        else:
            level = level.withColumn("weight", F.lit(1.0))
        given = water_fill(level, given, cols[:-1], cols[-1], budget)
    return leaves.join(given.select(*levels, F.floor(F.col("alloc") + 1e-6).alias("leaf_budget")), list(levels))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, float] | None = None, budget: int | None = None, share: float = 0.5, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Rows (id, levels, epoch, n_tokens, leaf_budget, and the columns `keep`) for every copy of a document that is taken.

    budget: tokens to give out, by default floor(share * all tokens). weights: by path from the root, of a length from 1 to the
    number of levels; a child without one weighs 1. A leaf may give its documents max_epochs times. Epoch e of a leaf is its
    documents in order of md5("seed:e:id"); a leaf gives all of its first epochs that fit its budget, and of the next one
    the documents whose running sum of tokens does not exceed the rest.

    A null level value is a child named "(null)"; a null or blank text has no tokens and costs nothing; a null id sorts as
    "null"; repeated rows are documents each for itself; ties in md5 (repeated ids) are ordered by tokens. An empty table gives
    no rows, as does a budget of 0 but for documents without tokens that come first in their order. Columns of docs that are not named are not read.

    The running sum never gathers a leaf: each leaf is cut into buckets of about BUCKET_ROWS rows by the head of md5, sums
    of buckets tell the one bucket where the budget ends, and only that bucket's rows are ordered.
    """
    names = list(levels)
    source = docs.select(F.col(id_col).alias("id"), *[F.coalesce(c.cast("string"), F.lit("(null)")).alias(n) for n, c in levels.items()], n_words(F.col(text_col)).alias("n_tokens"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    narrow = materialize(source.select("id", *names, "n_tokens"), "tokens")
    leaves = narrow.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    leaves = materialize(leaves, "leaves")
    total, n_leaves = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    small = F.broadcast if n_leaves <= SMALL else (lambda x: x)
    plan = budgets(leaves, names, weights or {}, int(total * share) if budget is None else budget, max_epochs)
    full = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("leaf_budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(0)
    plan = plan.withColumn("full", full.cast("int")).withColumn("rest", F.col("leaf_budget") - F.col("full") * F.col("tokens")).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)))
    plan = materialize(plan.select(*names, "leaf_budget", "full", "rest", "buckets"), "plan")

    def with_bucket(df: DataFrame) -> DataFrame:
        df = df.withColumn("order", order_key(seed, F.col("full"), F.col("id")))
        return df.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("buckets")))

    part = F.col("full") < max_epochs
    sums = with_bucket(narrow.join(small(plan), names).where(part)).groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("b_tokens"), F.first("rest").alias("rest"))
    upto = F.sum("b_tokens").over(Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).where("upto > rest").groupBy(*names).agg(F.min("bucket").alias("cut"), F.min_by("upto", "bucket").alias("cut_upto"), F.min_by("b_tokens", "bucket").alias("cut_tokens"))
    plan = materialize(plan.join(ends.withColumn("before_cut", F.col("cut_upto") - F.col("cut_tokens")).drop("cut_upto", "cut_tokens"), names, "left"), "cuts")
    joined = with_bucket(source.join(small(plan), names))
    # All copies that need no order: full epochs, and of the last one the buckets before the cut (all, if there is no cut).
    last = F.when(part & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))), F.col("full")).otherwise(F.col("full") - 1)
    whole = joined.withColumn("epochs", F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))).withColumn("epoch", F.explode("epochs"))
    at_cut = joined.where(part & (F.col("bucket") == F.col("cut")))
    running = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("order", "n_tokens", *([F.col("id")])).rowsBetween(Window.unboundedPreceding, 0))
    at_cut = at_cut.withColumn("running", running).where(F.col("running") <= F.col("rest") - F.col("before_cut")).withColumn("epoch", F.col("full"))
    out = [F.col("id").alias(id_col), *names, F.col("epoch").cast("int").alias("epoch"), "n_tokens", "leaf_budget", *[F.col(f"keep_{c}").alias(c) for c in keep]]
    return whole.select(*out).unionByName(at_cut.select(*out))
