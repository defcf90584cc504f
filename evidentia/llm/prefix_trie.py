"""A trie of conversations' prefixes, from ROLLUPs over columns of turn ids.

Turns get ids (128 bits of role and text, and the text's words). A conversation becomes rows of BLOCK turn-id columns; a row knows
the node at which the rows before it end: a sum of hashes of place and turn, which a scan gives for conversations of any length.
ROLLUP over the columns, grouped by that node besides, gives all prefixes at once; grouping_id tells how deep each is.

Sums over subtrees need no walk over the tree. A node belongs to its smallest member, and a member owns the nodes from some depth
on: the first ROLLUP tells from which, the second sums over each node's members what they own (leaves, words) and what they have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import discard, map_batches, materialize
from evidentia.operators import scan, skew

#: Turns of a row.
BLOCK = 8
#: Bits of a conv_id that ids in a text of ends may differ in: 4,096 ids at most.
_CHUNK_BITS = 12
_IDS = [f"t{k}" for k in range(1, BLOCK + 1)]
_WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), a, b, w: each turn's place, id and words. Null turns come first, ties go by the id; without a conv_id: none."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring(name, at, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), name.alias("name"), half(1).alias("a"), half(16).alias("b"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("w"))
    return scan.running(rows, ["conv_id"], ["turn", "name"], {"pos": scan.COUNT}).select("conv_id", "pos", "a", "b", "w")


def _node(pos: Column, turn: Column) -> tuple[Column, Column]:
    """What a turn at its place adds, by exclusive or, to the hash of a prefix."""
    return F.xxhash64(pos, turn["a"], turn["b"]), F.xxhash64(turn["b"], turn["a"], pos)


def rebuild(placed: DataFrame, period: int = 20, heads: int = 4) -> DataFrame:
    """Conversation c with the first h turns of conversation c - c % period (not negative), then its own after its first h; h is crc32(c) % heads.

    placed: see `turns`. Every conversation has one more row of pos 0 and no turn, so that one without turns is not lost.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("long")
    every = placed.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(period)))
    first = placed.where(F.col("pos") < heads).where(F.pmod("conv_id", F.lit(period)) == 0)
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "w"))).alias("taken"))
    every = materialize(every.join(first, "base", "left").select("conv_id", "h", F.filter(F.coalesce("taken", F.array()), lambda x: x["pos"] <= F.col("h")).alias("taken")), "trie-heads")
    moved = every.select("conv_id", "h", F.size("taken").alias("k"))
    own = placed.where(F.col("pos") > h).join(moved, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "a", "b", "w")
    head = every.select("conv_id", F.explode("taken").alias("x")).select("conv_id", "x.pos", "x.a", "x.b", "x.w")
    return own.unionByName(head).unionByName(every.select("conv_id", F.lit(0).cast("long").alias("pos"), *[F.lit(None).cast("long").alias(c) for c in "abw"]))


def blocks(rebuilt: DataFrame) -> DataFrame:
    """conv_id, block, x, y, before (the node before the block, and the words up to it), t1 to t8 (a, b, w; null after the end)."""
    turn = F.struct("a", "b", "w")
    x, y = _node(F.col("pos"), F.struct("a", "b"))
    at = F.greatest(F.col("pos") - 1, F.lit(0))
    some = F.col("pos") > 0
    cut = rebuilt.groupBy("conv_id", (at / BLOCK).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(F.when(some, F.struct("pos", turn.alias("turn"))))).alias("held"), F.coalesce(F.sum("w"), F.lit(0)).alias("w"),
        *[F.coalesce(F.bit_xor(F.when(some, v)), F.lit(0).cast("long")).alias(c) for c, v in (("x", x), ("y", y))],
    )
    # up to and with the block, less what the block itself has
    run = scan.running(cut, ["conv_id"], ["block"], {"to_x": scan.xor("x"), "to_y": scan.xor("y"), "to_w": scan.total("w")})
    return run.select("conv_id", "block", F.col("to_x").bitwiseXOR(F.col("x")).alias("x"), F.col("to_y").bitwiseXOR(F.col("y")).alias("y"), (F.col("to_w") - F.col("w")).alias("before"), *[F.get("held", F.lit(k))["turn"].alias(t) for k, t in enumerate(_IDS)])


def _prefixes(spark: SparkSession, rows: DataFrame, sums: str) -> DataFrame:
    """One row per prefix of the blocks: depth, its node (x, y) and its parent's (px, py), the words before its last turn, and the sums."""
    found = spark.sql(
        f"SELECT block, x, y, before, {', '.join(_IDS)}, {BLOCK} - bit_count(grouping_id()) AS d, {sums} FROM {{rows}} GROUP BY block, x, y, before, ROLLUP({', '.join(_IDS)})", rows=rows
    )
    # deeper than its members go, or the end of the block before
    held = F.array(*_IDS)
    found = found.where(((F.col("d") == 0) & (F.col("block") == 0)) | F.get(held, F.col("d") - 1).isNotNull())

    def added(turn: Column, k: Column) -> Column:
        one, two = _node(F.col("block") * BLOCK + k + 1, turn)
        return F.struct(one.alias("x"), two.alias("y"), turn["w"].alias("w"))

    kept = [c for c in found.columns if c not in ("block", "x", "y", "before", "d", *_IDS)]
    found = found.select("block", "d", "x", "y", "before", *kept, F.transform(F.slice(held, F.lit(1), F.col("d")), added).alias("path"))
    above = F.slice("path", F.lit(1), F.greatest(F.col("d") - 1, F.lit(0)))
    mixed = lambda start, path, c: F.aggregate(path, F.col(start), lambda so_far, t: so_far.bitwiseXOR(t[c])).alias
    return found.select(
        (F.col("block") * BLOCK + F.col("d")).alias("depth"), mixed("x", F.col("path"), "x")("x"), mixed("y", F.col("path"), "y")("y"), mixed("x", above, "x")("px"), mixed("y", above, "y")("py"),
        F.aggregate(above, F.col("before"), lambda so_far, t: so_far + t["w"]).alias("before"), *kept,
    )


def ends(totals: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256: of each node at which conversations end, the SHA-256 of their ids, ascending, comma-joined.

    Ids are joined in texts of 4,096 at most; a task hashes a node's texts in order, one after another.
    """
    key = ["depth", "x", "y"]
    texts = totals.groupBy(*key, F.shiftright("conv_id", _CHUNK_BITS).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, digest, found = None, None, []
        for b in batches:
            for *node, ids in zip(*(b.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if node != open_key:
                    if digest:
                        found.append((*open_key, digest.hexdigest()))
                    open_key, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], [*key, "ends_sha256"])
                found = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*open_key, digest.hexdigest())], [*key, "ends_sha256"])

    dealt = texts.repartition(*key).sortWithinPartitions(*key, "chunk").select(*key, "ids")
    return map_batches(dealt, run, "depth long, x long, y long, ends_sha256 string")


def trie(conversations: DataFrame, period: int = 20, heads: int = 4) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty, rows without a conv_id belong to no conversation, repeated rows are turns like others,
    other columns are ignored. An empty table has no root and gives an empty result. Very long conversations and texts are whole.
    """
    spark = conversations.sparkSession
    rebuilt = materialize(rebuild(materialize(turns(conversations), "trie-turns"), period, heads), "trie-rebuilt")
    rows = materialize(blocks(rebuilt), "trie-blocks")
    some = F.col("pos") > 0
    x, y = _node(F.col("pos"), F.struct("a", "b"))
    totals = rebuilt.groupBy("conv_id").agg(
        F.count_if(some).alias("depth"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"), *[F.coalesce(F.bit_xor(F.when(some, v)), F.lit(0).cast("long")).alias(c) for c, v in (("x", x), ("y", y))]
    )
    totals = materialize(totals, "trie-totals")
    long = materialize(rows.join(totals.select("conv_id", "words", F.col("depth").alias("turns")), "conv_id"), "trie-long")
    own = _prefixes(spark, long, "min(conv_id) AS conv_id, max(turns) AS turns").groupBy("conv_id").agg(F.min_by("before", "depth").alias("unowned"), F.max((F.col("turns") == F.col("depth")).cast("long")).alias("leaf"))
    held = long.join(own, "conv_id", "left").withColumn("owned", F.coalesce(F.col("words") - F.col("unowned"), F.lit(0))).na.fill(0, ["leaf"])
    sums = "min(conv_id) AS conv_id, count(*) AS n_convs, sum(words) AS words, sum(owned) AS owned, sum(leaf) AS n_leaves, min_by(unowned, conv_id) AS unowned"
    nodes = materialize(_prefixes(spark, held, sums), "trie-nodes")
    key = ["depth", "x", "y"]
    above = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    # tokens of all members' turns from here on, less those of each node once
    saved = F.col("words") - F.col("n_convs") * F.col("before") - (F.col("owned") + F.col("unowned") - F.col("before"))
    whole = nodes.join(above, key, "left").join(ends(totals), key, "left").withColumn("saved_tokens", saved)
    parent = F.struct((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
    whole = materialize(whole.select("*", F.when(F.col("depth") > 0, parent).alias("parent")), "trie-whole")
    parents = whole.where("n_children > 0").select(F.struct(*key).alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("copies"))
    out = skew.join_by_key(whole.drop("px", "py"), parents, "parent", "copies", whole.count())
    out = materialize(out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie")
    discard(rebuilt, rows, totals, long, nodes, whole)
    return out
