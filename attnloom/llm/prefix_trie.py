"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns, known by a digest of position-bound
turn digests, which are added up along a conversation by sums over buckets of
places, so that a conversation of any length is spread. Node facts are partial
aggregates.

Totals: each round rakes all leaves into their parents and compresses unary
chains. Of the nodes with one child, those are taken out whose label, from the
lowest bit in which their depth differs from their child's, is larger than that
of their neighbours in the chain: on an untouched chain every second node. A node
taken out leaves a link (total of this node = total of that one + a known rest).
Rounds therefore grow with the logarithm of the nodes, not with the depth.
Afterwards the links are followed back, last round first, so that every node has
its total. Each round is stored in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from .common import read_table, spread_join, stored

GROUP, SHARED = 5, 9  # contract: conversation c shares turns of c - c % GROUP, crc32(c) % SHARED of them
BUCKET = 1024
CHUNK = 1 << 15
_LANES = ["lane0", "lane1", "lane2", "lane3"]


# ------------------------------------------------------------ turns


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), length, digest, bytes of every turn, stored.

    Turns are ordered by `turn`, null first; equal turns by the digest of role
    and text. Null roles and texts are empty. Repeated rows are counted before
    they are dealt out. Rows of a null conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    counted = turns.groupBy("conv_id", "turn", "digest").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    # ranges of (conversation, turn) make buckets that follow the order and cut a long conversation
    ranged = stored(counted.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "ranged-turns")
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    ranked = running_totals(ranged, ["conv_id"], ["part"], order, ["copies"])
    places = ranked.select("conv_id", "digest", "bytes", F.col("all_copies").alias("length"), "below_copies", "copies",
                           F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BUCKET).cast("long"))).alias("step"))
    each = F.explode(F.sequence(F.col("step"), F.least(F.col("copies"), F.col("step") + BUCKET) - 1))
    placed = places.select("conv_id", "digest", "bytes", "length", "below_copies", each.alias("copy"))
    return stored(placed.select("conv_id", (F.col("below_copies") + F.col("copy") + 1).alias("place"), "length", "digest", "bytes"), "placed-turns")


def rebuilt_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, length, digest, bytes) of the rebuilt conversations, and (conv_id, length) of all, turnless too."""
    of = placed.filter("place = 1").select("conv_id", F.col("length").alias("own"))
    wanted = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("long")
    base = of.select(F.col("conv_id").alias("base"), F.col("own").alias("base_length"))
    convs = of.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("skip", wanted).join(base, "base", "left")
    head = F.least("skip", F.coalesce("base_length", F.lit(0)))
    convs = convs.withColumn("head", head).withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("skip"), F.lit(0)))
    convs = stored(convs.select("conv_id", "base", "skip", "head", "length"), "rebuilt")
    # a base lends at most SHARED - 1 turns to fewer than 2 * GROUP conversations
    lent = placed.filter(F.col("place") < SHARED).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "bytes")
    shared = convs.filter("head > 0").join(lent, "base").filter("depth <= head").select("conv_id", "depth", "length", "digest", "bytes")
    rest = spread_join(placed.select("conv_id", "place", "digest", "bytes"), convs.select("conv_id", "skip", "head", "length"), "conv_id")
    own = rest.filter("place > skip").select("conv_id", (F.col("head") + F.col("place") - F.col("skip")).alias("depth"), "length", "digest", "bytes")
    return shared.unionByName(own), convs.select("conv_id", "length")


# ------------------------------------------------------------ nodes


def _key(depth: Column, lanes: Sequence[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[c.cast("string") for c in lanes])))


def memberships(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, node, parent (null for the root), depth, bytes of the last text, ends (the conversation ends here), stored."""
    mixed = F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.col("digest")))
    lanes = [F.conv(F.substring(F.col("_mixed"), 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(_LANES)]
    rows = turns.withColumn("_mixed", mixed).select("conv_id", "depth", "length", "bytes", F.expr(f"depth div {BUCKET}").alias("bucket"), *lanes)
    summed = running_totals(rows, ["conv_id"], ["bucket"], [F.col("depth")], _LANES)
    below = [F.col(f"below_{c}") for c in _LANES]
    with_turns = summed.select(
        "conv_id", _key(F.col("depth"), [b + F.col(c) for b, c in zip(below, _LANES)]).alias("node"),
        _key(F.col("depth") - 1, below).alias("parent"), "depth", "bytes", (F.col("depth") == F.col("length")).alias("ends"),
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", _key(zero, [zero] * len(_LANES)).alias("node"), F.lit(None).cast("binary").alias("parent"),
                         zero.alias("depth"), zero.alias("bytes"), (F.col("length") == 0).alias("ends"))
    return stored(with_turns.unionByName(roots), "memberships")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, conv_id) to comma-joined ids of one node, at most about CHUNK characters each."""
    node, first, held, size = None, None, [], 0
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["node", "first", "ids"])

    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != node or size > CHUNK:
                if held:
                    out.append((node, first, ",".join(held)))
                node, first, held, size = own, conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        if len(out) > 1000:
            yield flushed()
    if held:
        out.append((node, first, ",".join(held)))
    if out:
        yield flushed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (node, first) to one digest per node; only the state of one digest is held."""
    node, state = None, None
    for batch in batches:
        nodes, digests = [], []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own != node:
                if state is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def end_digests(members: DataFrame) -> DataFrame:
    """node, ends_sha256 of every node at which a conversation ends.

    Ids are joined to chunks in ranges of (node, id), which cut a node of any
    size. The digest of one node is one chain by its definition, so its chunks
    pass through one task as a stream.
    """
    ends = members.filter("ends").select("node", "conv_id").distinct()
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = stored(ranged.mapInArrow(_chunks, "node binary, first long, ids string"), "end-chunks")
    ordered = chunks.repartition("node").sortWithinPartitions("node", "first")
    return ordered.mapInArrow(_hashed, "node binary, ends_sha256 string")


def nodes_of(members: DataFrame) -> DataFrame:
    """node, parent, depth, bytes, conv_id, n_convs, n_children of every node, stored."""
    nodes = members.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"),
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
    )
    nodes = stored(nodes, "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    return stored(nodes.join(children, "node", "left").fillna(0, ["n_children"]), "nodes")


# ------------------------------------------------------------ contraction


def _label(level: Column, below: Column) -> Column:
    """Twice the place of the lowest bit in which both differ, plus that bit of `level`."""
    bits = level.bitwiseXOR(below)
    lowest = bits.bitwiseAND(-bits)
    return 2 * F.bit_count(lowest - 1) + (level.bitwiseAND(lowest) != 0).cast("int")


def subtree_totals(nodes: DataFrame, weights: Sequence[str]) -> DataFrame:
    """node and, per weight, its sum over the node and all below it.

    `nodes` has node, parent (null for roots), level (long, larger than that of
    the parent), kids (number of children) and the weights, all integers. Any
    number of trees of any depth and any number of children.
    """
    extra = [f"extra_{w}" for w in weights]
    zero = F.lit(0).cast("long")
    alive = stored(nodes.select("node", "parent", "level", "kids", *weights, *[zero.alias(e) for e in extra]), "alive")
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while True:
        raked = alive.filter("kids = 0").select("node", *weights)
        leaf = F.col("kids") == 0
        # one aggregate per parent: what its leaves give, and its one other child if there is just one
        below = alive.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count_if(~leaf).alias("_kids"),
            *[F.coalesce(F.sum(F.when(leaf, F.col(w) + F.col(e))), zero).alias(f"_{w}") for w, e in zip(weights, extra)],
            F.min(F.when(~leaf, F.struct("node", "level", *extra))).alias("child"),
        )
        rest = alive.filter("kids > 0").drop("kids").join(below, "node")
        rest = rest.select("node", "parent", "level", F.col("_kids").alias("kids"), *[(F.col(w) + F.col(f"_{w}")).alias(w) for w in weights], *extra,
                           F.when(F.col("_kids") == 1, F.col("child")).alias("child"))
        rest = stored(rest, "rest")
        if rest.isEmpty():
            rounds.append((raked, None))
            break
        chain = rest.filter("child is not null and parent is not null").withColumn("label", _label(F.col("level"), F.col("child.level")))
        upper = chain.select(F.col("child.node").alias("node"), F.col("node").alias("above"), F.col("label").alias("label_above"))
        pairs = upper.join(chain.select("node", "label"), "node")
        losers = pairs.select(F.when(F.col("label_above") > F.col("label"), F.col("node")).otherwise(F.col("above")).alias("node")).distinct()
        out = chain.join(losers, "node", "left_anti").select(
            "node", "parent", F.col("child.node").alias("via"),
            *[(F.col(w) + F.col(f"child.{e}")).alias(w) for w, e in zip(weights, extra)], *extra,
        )
        out = stored(out, "links")
        rounds.append((raked, out))
        # a node out of the chain hands its parent, and what it holds, to its child
        news = out.select("node", F.lit(True).alias("_gone"), F.lit(None).cast("binary").alias("_parent"), *[F.lit(None).cast("long").alias(f"_{e}") for e in extra]).unionByName(
            out.select(F.col("via").alias("node"), F.lit(False).alias("_gone"), F.col("parent").alias("_parent"),
                       *[(F.col(w) + F.col(e)).alias(f"_{e}") for w, e in zip(weights, extra)])
        )
        moved = rest.drop("child").join(news, "node", "left").filter(~F.coalesce("_gone", F.lit(False)))
        alive = stored(moved.select("node", F.coalesce("_parent", "parent").alias("parent"), "level", "kids", *weights,
                                    *[F.coalesce(f"_{e}", e).alias(e) for e in extra]), "alive")
    return _expanded(rounds, weights)


def _expanded(rounds: list[tuple[DataFrame, DataFrame | None]], weights: Sequence[str]) -> DataFrame:
    known: DataFrame | None = None
    for raked, out in reversed(rounds):
        if out is not None:
            of = known.select(F.col("node").alias("via"), *[F.col(w).alias(f"_{w}") for w in weights])
            found = out.join(of, "via").select("node", *[(F.col(w) + F.col(f"_{w}")).alias(w) for w in weights])
            known = known.unionByName(stored(found, "expanded"))
        known = raked if known is None else known.unionByName(raked)
    return known


# ------------------------------------------------------------ operator


def trie(members: DataFrame) -> DataFrame:
    """One row per node of `members` (conv_id, node, parent, depth, bytes, ends) with its facts and subtree totals."""
    nodes = nodes_of(members)
    childless = (F.col("n_children") == 0).cast("long")
    weighed = nodes.select("node", "parent", F.col("depth").alias("level"), F.col("n_children").alias("kids"),
                           childless.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = stored(subtree_totals(weighed, ["n_leaves", "saved_tokens"]), "totals")
    ends = stored(end_digests(members), "ends")
    of_parent = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(totals, "node").join(ends, "node", "left")
    joined = spread_join(joined.drop("node", "bytes"), of_parent, "parent", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                         F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    `conversations` has conv_id, turn, role, text; other columns are ignored, and
    so are rows of a null conv_id. Null roles and texts are empty; turns that
    are equal in number are ordered by a digest of role and text; repeated rows
    are turns of their own. An empty table gives no rows.
    """
    return trie(memberships(*rebuilt_turns(placed_turns(conversations))))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversation_trie` of all rows of `conversations`."""
    return conversation_trie(read_table(spark, sf_dir, "conversations"))
