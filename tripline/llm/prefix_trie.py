"""Operator 12, conversation prefix trie: one node per distinct sequence of first turns, subtree totals by depth-band rollup.

A turn's text is hashed once; a prefix is known by its length and the exclusive-or of its turns' hashes, each bound to its
place, in two independent 64-bit words.  These combine in any order, so a conversation of any length is prefixed in blocks of
``STRIDE`` turns.  A node is named by its smallest member and its depth.

Depth-band rollup: depths are cut into bands of a fixed height.  A node explodes to its ancestors inside its band only.  The totals
of the band's roots form a trie of their own, lower by the height, which is rolled up in the same way; then every band root's
whole total goes to its ancestors in the band above.  A row makes at most ``height`` copies a round, and rounds grow with the
logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripline.llm.text import partitions, table

HEIGHT, STRIDE, WORD = 16, 1024, r"[^\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, x, y, words): place from 1 in the order of turn (null first), role and text; two hashes and the words of the text.

    Places are counted per block of turn numbers, so a long conversation is never sorted in one task.
    """
    flat = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block = F.coalesce(F.floor(F.col("turn") / STRIDE), F.lit(-(1 << 62))).cast("long")
    rows = flat.withColumn("block", block)
    counts = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("conv", "block", F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = rows.withColumn("at", F.row_number().over(W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))).join(before, ["conv", "block"])
    return placed.select("conv", (F.col("at") + F.col("before")).cast("long").alias("pos"), F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit("second"), "text", "role").alias("y"),
                         F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def share_openings(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Rebuilt conversations: the first h turns of the conversation whose id ends the group, then the own turns after the first h."""
    convs = turns.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % group).alias("donor"), F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).alias("h"))
    opening = turns.where(F.col("pos") < most).select(F.col("conv").alias("donor"), *[c for c in turns.columns if c != "conv"])
    taken = convs.join(opening, "donor").where("pos <= h").select("conv", *[c for c in turns.columns if c != "conv"])
    got = convs.join(taken.groupBy("conv").agg(F.count(F.lit(1)).alias("k")), "conv", "left").select("conv", "h", F.coalesce("k", F.lit(0)).alias("k"))
    own = turns.join(got, "conv").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("k")).select(turns.columns)
    return taken.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, x, y, words): both hashes of the first ``depth`` turns."""
    bound = {c: F.xxhash64(F.lit(c), "pos", c, other) for c, other in (("x", "y"), ("y", "x"))}
    rows = turns.withColumns(bound).withColumn("block", F.floor(F.col("pos") / STRIDE).cast("long"))
    blocks = rows.groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    key = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(c).over(key), F.lit(0)).cast("long").alias(f"{c}0") for c in ("x", "y")])
    upto = W.partitionBy("conv", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumns({c: F.bit_xor(c).over(upto) for c in ("x", "y")}).join(before, ["conv", "block"])
    return summed.select("conv", F.col("pos").alias("depth"), F.col("x").bitwiseXOR(F.col("x0")).alias("x"), F.col("y").bitwiseXOR(F.col("y0")).alias("y"), "words")


def band_rollup(nodes: DataFrame, at: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """(conv, depth, *values): sums of ``values`` over each node's subtree, itself included.

    ``nodes`` (conv, depth, *values) name nodes by a member and the depth; ``at`` (conv, depth, node) gives for each member the name of its
    node at each depth from 0.
    """
    top = nodes.agg(F.max("depth")).head()[0] or 0
    band = F.floor(F.col("depth") / height).cast("long")
    lists = at.groupBy("conv", band.alias("band")).agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))

    def to_ancestors(rows: DataFrame) -> DataFrame:
        """Each row (conv, band, upto, *values) counts for the nodes of its member in its band down to depth ``upto``."""
        up = rows.join(lists, ["conv", "band"]).select(F.explode(F.filter("path", lambda p: p["depth"] <= F.col("upto"))).alias("p"), *values)
        return up.groupBy(F.col("p.node").alias("conv"), F.col("p.depth").alias("depth")).agg(*[F.sum(v).alias(v) for v in values])

    inside = to_ancestors(nodes.select("conv", band.alias("band"), F.col("depth").alias("upto"), *values))
    if top < height:
        return inside
    inside = table(inside)
    roots = inside.where(F.col("depth") % height == 0).select("conv", (F.col("depth") / height).cast("long").alias("depth"), *values)
    whole = band_rollup(roots, at.where(F.col("depth") % height == 0).select("conv", (F.col("depth") / height).cast("long").alias("depth"), "node"), values, height)
    below = to_ancestors(whole.where("depth > 0").select("conv", (F.col("depth") - 1).alias("band"), (F.col("depth") * height).alias("upto"), *values))
    return inside.unionByName(below).groupBy("conv", "depth").agg(*[F.sum(v).alias(v) for v in values])


def digests(members: DataFrame, chunk_bits: int = 12) -> DataFrame:
    """(node, depth, ends_sha256): SHA-256 of the members' ids, ascending and joined by commas.

    Ids are joined in chunks of neighbouring ids; a node's chunks stream through one task, which keeps only the hash's state.
    """
    joined = members.groupBy("node", "depth", F.shiftright("conv", chunk_bits).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    spread = joined.repartition(partitions(members.sparkSession), "node", "depth").sortWithinPartitions("node", "depth", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple] = []
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if (node, depth) == last:
                    state.update(b",")
                elif last:
                    out.append((*last, state.hexdigest()))
                if (node, depth) != last:
                    last, state = (node, depth), hashlib.sha256()
                state.update(ids.encode())
            yield _batch(out)
        if last:
            yield _batch([(*last, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["node", "depth", "ends_sha256"])

    return spread.mapInArrow(run, "node long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv, pos from 1 without holes, x, y, words) of all ``convs`` (conv): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without turns are members of the root only.  No conversation gives no row.  Two prefixes count as equal when length and both
    64-bit hashes are.
    """
    every = table(convs.select("conv").distinct())
    least = every.agg(F.min("conv")).head()[0]
    steps = table(prefixes(turns))
    by = ["depth", "x", "y"]
    named = steps.groupBy(*by).agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    root = every.groupBy().agg(F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(F.lit(least).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    at = table(steps.join(named.select(*by, "node"), by).select("conv", "depth", "node").unionByName(every.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("node"))))
    nodes = named.select("node", "depth", "n_convs", "words").unionByName(root)
    above = at.select(F.col("conv").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    linked = table(nodes.join(above, ["node", "depth"], "left"))
    children = linked.where("parent is not null").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    shape = table(linked.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    own = shape.select(F.col("node").alias("conv"), "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = band_rollup(own, at, ["n_leaves", "saved_tokens"], height).withColumnRenamed("conv", "node")
    last = at.groupBy("conv").agg(F.max_by("node", "depth").alias("node"), F.max("depth").alias("depth"))
    out = shape.join(totals, ["node", "depth"]).join(digests(last), ["node", "depth"], "left")
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of conversations that open with their group's shared turns (``share_openings``).

    ``conversations`` has conv_id, turn, role, text.  Rows without conv_id take no part; null role or text is empty; rows of one conversation with equal turn
    numbers are ordered by role, then text, and repeated rows are turns of their own.  Other columns are ignored.
    """
    turns = table(ordered_turns(conversations))
    return prefix_trie(share_openings(turns), turns.select("conv"), height)
