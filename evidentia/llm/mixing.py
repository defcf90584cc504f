"""Mixing sources to target weights, with hierarchical budgets and seeded epochs.

Leaves are the distinct values of the tree's levels, for instance domain, language, source. A token budget goes down the
tree: siblings share their parent's budget by weight, each up to what its subtree can give (its tokens times the most epochs).
What one can't use goes to its siblings by weight; only what all siblings together can't use is left to the parent's own
siblings, since a node is never given more than its subtree can use. A leaf with budget b and s tokens gives each document
b div s times, and once more the documents of a prefix of the next epoch: in the order of a seeded hash of that epoch, as many
as fit in what is left of b.

All of it is DataFrame operations. A leaf may hold a third of all rows: its order is cut into about as many hash ranges as each
range has rows, sums per range find the one range in which the prefix ends, and only that is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.llm.common import materialize, small

WORD = r"[^\x20\x09-\x0D]+"
#: Hashes are below this.
TOP = 1 << 32


@dataclass(frozen=True)
class MixParams:
    """levels: columns from the root down. weights: of values of a level among siblings (whole numbers; 1 where absent; 0
    leaves a value out). budget_percent: of all tokens. max_epochs: most copies of a document."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_percent: int = 60
    max_epochs: int = 2
    seed: int = 17


def count_tokens(text: Column) -> Column:
    """Runs of signs other than white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch, 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch, doc_id).cast("binary")), 1, 8), 16, 10).cast("long")


def _weight(level: str, p: MixParams) -> Column:
    known = p.weights.get(level, {})
    out = F.lit(1)
    for value, w in known.items():
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast("double")


def leaf_budgets(leaves: DataFrame, p: MixParams) -> DataFrame:
    """leaves (levels, supply, n_docs) with budget: tokens that each is to give."""
    keys = list(p.levels)
    able = F.col("supply").cast("double") * p.max_epochs
    for level in keys:
        able = F.when(_weight(level, p) > 0, able).otherwise(0.0)
    sized = leaves.withColumn("able", able)
    budgets = sized.agg(F.least(F.sum("able"), F.floor(F.sum("supply") * p.budget_percent / F.lit(100)).cast("double")).alias("given"))
    for depth in range(1, len(keys) + 1):
        nodes = sized.groupBy(keys[:depth]).agg(F.sum("able").alias("able")).withColumn("w", _weight(keys[depth - 1], p)).where("able > 0")
        nodes = nodes.join(budgets, keys[: depth - 1]) if depth > 1 else nodes.crossJoin(F.broadcast(budgets))  # one row
        siblings = Window.partitionBy(keys[: depth - 1])
        fullest = siblings.orderBy(F.col("able") / F.col("w"), *keys[depth - 1 : depth])
        before = F.coalesce(F.sum("able").over(fullest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("w").over(fullest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        # the share per weight if all that fill up earlier are full; the first node that doesn't fill at it sets it for the rest
        nodes = nodes.withColumn("share", (F.col("given") - before) / left).withColumn("open", F.col("able") / F.col("w") > F.col("share"))
        rate = F.max(F.when(F.col("open"), F.col("share"))).over(siblings)
        budgets = nodes.withColumn("given", F.when(F.col("open"), F.col("w") * rate).otherwise(F.col("able"))).select(*keys[:depth], "given")
    return leaves.join(budgets, keys, "left").withColumn("budget", F.floor(F.coalesce("given", F.lit(0.0))).cast("long")).drop("given")


def plan(docs: DataFrame, params: MixParams) -> tuple[DataFrame, DataFrame]:
    """The counted documents (doc_id, levels, n_tokens), and per leaf: levels, supply, n_docs, budget, epochs (full ones), cut_hash, cut_id.

    In the epoch after the full ones, documents up to (cut_hash, cut_id) are chosen. A null level counts as the empty string.
    """
    p = params
    keys = list(p.levels)
    counted = materialize(docs.select("doc_id", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], count_tokens(F.col("text")).alias("n_tokens")), "tokens")
    leaves = materialize(counted.groupBy(keys).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_docs")), "leaves")
    budgets = leaf_budgets(leaves, p)
    budgets = budgets.withColumn("epochs", F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))
    budgets = materialize(budgets.withColumn("ranges", F.ceil(F.sqrt("n_docs"))), "budgets")
    placed = counted.join(small(budgets.where("rest > 0").select(*keys, "epochs", "rest", "ranges")), keys)
    placed = placed.withColumn("u", order_hash(p.seed, F.col("epochs") + 1, F.col("doc_id"))).withColumn("range", F.floor(F.col("u") * F.col("ranges") / F.lit(TOP)))
    sums = placed.groupBy(*keys, "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("ranges").alias("ranges"))
    upto = F.sum("n").over(Window.partitionBy(keys).orderBy("range"))
    sums = sums.withColumn("upto", upto).where("upto > rest")
    # a leaf's rest is less than its tokens, so there is a range in which the prefix ends
    ends = materialize(sums.groupBy(keys).agg(F.min(F.struct("range", F.expr("rest - (upto - n)").alias("fits"), "ranges")).alias("e")).select(*keys, F.col("e.range").alias("range"), "e.fits", "e.ranges"), "ends")
    last = placed.drop("ranges").join(small(ends), [*keys, "range"])
    within = F.sum("n_tokens").over(Window.partitionBy(*keys, "range").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = last.withColumn("upto", within).where("upto <= fits").groupBy(keys).agg(F.max(F.struct("u", "doc_id")).alias("m"))
    # where no document of that range fits, all below its start are chosen
    start = F.ceil(F.col("range") * F.lit(TOP) / F.col("ranges")).cast("long") - 1
    cuts = ends.join(chosen, keys, "left").select(*keys, F.coalesce("m.u", start).alias("cut_hash"), F.coalesce("m.doc_id", F.lit((1 << 63) - 1)).alias("cut_id"))
    return counted, budgets.join(cuts, keys, "left").select(*keys, "supply", "n_docs", "budget", "epochs", "cut_hash", "cut_id")


def copies(docs: DataFrame, leaves: DataFrame, params: MixParams) -> DataFrame:
    """docs with n_copies (long): how often the mixture holds each document. docs needs doc_id and the levels."""
    p = params
    joined = docs
    named = leaves.select(*[F.col(k).alias(f"evidentia_{k}") for k in p.levels], F.col("epochs").alias("evidentia_epochs"), F.col("cut_hash").alias("evidentia_hash"), F.col("cut_id").alias("evidentia_id"))
    same = F.lit(True)
    for k in p.levels:
        same = same & (F.coalesce(F.col(k).cast("string"), F.lit("")) == F.col(f"evidentia_{k}"))
    joined = docs.drop("n_copies").join(small(named), same, "left")
    u = order_hash(p.seed, F.col("evidentia_epochs") + 1, F.col("doc_id"))
    once_more = F.coalesce((u < F.col("evidentia_hash")) | ((u == F.col("evidentia_hash")) & (F.col("doc_id") <= F.col("evidentia_id"))), F.lit(False))
    return joined.withColumn("n_copies", (F.coalesce("evidentia_epochs", F.lit(0)) + once_more.cast("long")).cast("long")).drop(*named.columns)


def mix(docs: DataFrame, params: MixParams) -> DataFrame:
    """Per document: doc_id, levels, n_tokens, n_copies (0: left out).

    Needs doc_id, text and the levels; other columns are ignored. A document without tokens is given as often as its place in
    the order says. Ties of the hash go by doc_id; repeated doc_ids share their place. An empty table gives an empty result.
    """
    counted, leaves = plan(docs, params)
    return copies(counted, materialize(leaves, "leaves"), params)


def select_mixture(docs: DataFrame, params: MixParams) -> DataFrame:
    """The rows of docs as often as the mixture holds them; no text is shuffled."""
    _, leaves = plan(docs, params)
    chosen = copies(docs, materialize(leaves, "leaves"), params).where("n_copies > 0")
    if params.max_epochs > 1:
        chosen = chosen.withColumn("n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    return chosen.drop("n_copies")
