"""Prefix trie of conversations, built level by level and rolled up in reverse."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from almanack.llm.session import drop, write

#: Turns of one conversation that are numbered together, and ids of one node that are joined in one string.
TURNS, IDS = 1024, 4096


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, key, bytes) of every turn, ordered by turn (null first), then by key.

    key is the SHA-256 of role and text, so texts needn't travel. Turns are ranked within runs of 1,024
    turn numbers, runs by their sums, so a very long conversation isn't one task's. Rows without a
    conv_id belong to no conversation; null role or text is empty; repeated rows stay, each a turn.
    """
    said = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    said = said.select(
        "conv_id", "turn", F.expr(f"coalesce(floor(turn / {TURNS}), -1)").alias("run"), F.col("turn").isNull().alias("unset"),
        F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("key"),
        F.octet_length("text").alias("bytes"),
    )
    run = ["conv_id", "unset", "run"]
    so_far = Window.partitionBy("conv_id").orderBy(F.desc("unset"), "run").rowsBetween(Window.unboundedPreceding, -1)
    before = said.groupBy(run).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(run).orderBy("turn", "key"))
    return said.withColumn("within", within).join(before.select(*run, "before"), run).select("conv_id", (F.col("before") + F.col("within")).alias("pos"), "key", F.col("bytes").cast("long").alias("bytes"))


def shared_heads(placed: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuild each conversation c: the first h turns of conversation c - c % every (all if fewer, none if
    absent), then its own after its first h; h = crc32(decimal c) % most. Returns turns (conv_id, depth,
    key, bytes) and conversations (conv_id, length); a rebuilt conversation may have no turns."""
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = (
        sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
        .join(base, "base", "left")
        .withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    heads = placed.where(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "key", "bytes")
    tails = placed.join(convs.select("conv_id", "h", "head"), "conv_id").where("pos > h").select("conv_id", F.expr("pos - h + head").alias("depth"), "key", "bytes")
    return heads.unionByName(tails), convs.select("conv_id", "length")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of sequences of turns (conv_id, depth from 1 without gaps, key, bytes) of convs (conv_id, length).

    Returns nodes (conv_id: the smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved: over the subtree, (n_convs - 1) times bytes), and ends (depth, node, conv_id): the node at
    which each conversation ends. A node is named by its depth and its smallest member.

    Per depth, the live conversations, those that share their node, are grouped by (node, next turn) with
    partial aggregates and joined back; one that is alone goes, and what follows is a chain that a single
    join lists at the end, however long. So there are as many levels as turns that two conversations share.
    Turns are sorted by depth, so a level reads its own. The way back adds up leaves and savings level by
    level. A group that all conversations share is summed in every task; the joins may be split.

    An empty table has no nodes. Conversations without turns end at the root.
    """
    turns = write(turns.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"))
    convs = write(convs)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    levels = [write(root.select("conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes")))]
    live = convs.withColumn("node", F.lit((levels[0].first() or [None])[0]).cast("long"))
    ended = []
    while not live.isEmpty():
        d = len(levels)
        ended.append(live.where(F.col("length") == d - 1).select(F.lit(d - 1).cast("long").alias("depth"), "node", "conv_id"))
        step = live.where(F.col("length") >= d).join(turns.where(F.col("depth") == d).select("conv_id", "key", "bytes"), "conv_id")
        groups = write(step.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")))
        levels.append(groups.select("conv_id", F.col("node").alias("parent"), "n_convs", "bytes"))
        shared = groups.where("n_convs > 1").select("node", "key", F.col("conv_id").alias("least"))
        live = write(step.join(shared, ["node", "key"]).select("conv_id", "length", F.col("least").alias("node")))

    rolled, below = [], None
    for d in reversed(range(len(levels))):
        nodes = levels[d].where("n_convs > 1 OR parent IS NULL").withColumn("own", F.expr("(n_convs - 1) * bytes"))
        if below is None:
            nodes = nodes.select("*", *(F.lit(0).cast("long").alias(c) for c in ("n_children", "leaves", "kept")))
        else:
            sums = below.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("kept"))
            nodes = nodes.join(sums.withColumnRenamed("parent", "conv_id"), "conv_id", "left").na.fill(0, ["n_children", "leaves", "kept"])
        done = write(nodes.select("conv_id", F.lit(d).cast("long").alias("depth"), "parent", "n_convs", "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.col("kept")).alias("saved")))
        rolled.append(done)
        alone = levels[d].where("n_convs = 1 AND parent IS NOT NULL")
        below = done.select("parent", "n_leaves", "saved").unionByName(alone.select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")))

    of = lambda frames: frames[0] if len(frames) == 1 else of(frames[: len(frames) // 2]).unionByName(of(frames[len(frames) // 2 :]))
    many = of(rolled).withColumnRenamed("parent", "parent_conv_id")
    heads = of([x.where("n_convs = 1 AND parent IS NOT NULL").select("conv_id", F.col("parent"), F.lit(d).cast("long").alias("start")) for d, x in enumerate(levels)])
    heads = heads.join(convs, "conv_id")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = turns.select("conv_id", "depth").join(heads, "conv_id").where("depth >= start").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(F.col("depth") < F.col("length"), one).otherwise(zero).alias("n_children"), one.alias("n_leaves"), zero.alias("saved"),
    )
    ends = heads.select(F.col("length").alias("depth"), F.col("conv_id").alias("node"), "conv_id")
    return many.unionByName(chains), of([*ended, ends]) if ended else ends


def joined_digests(ends: DataFrame) -> DataFrame:
    """(depth, conv_id: the node, ends_sha256) of the ids that end at a node, ascending, joined by commas.

    Ids are joined in runs of 4,096 by many tasks; a node's runs then stream through one hash, in a buffer's memory.
    """
    runs = ends.groupBy("depth", "node", F.shiftright("conv_id", IDS.bit_length() - 1).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def stream(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids"))):
                if (depth, node) != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (depth, node), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "conv_id", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], ["depth", "conv_id", "ends_sha256"])

    return runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "run").mapInArrow(stream, "depth long, conv_id long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations (conv_id, turn, role, text) with shared heads, a row for each node."""
    placed = write(placed_turns(conversations))
    nodes, ends = prefix_trie(*shared_heads(placed))
    drop(placed)
    named = nodes.join(joined_digests(ends), ["depth", "conv_id"], "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
