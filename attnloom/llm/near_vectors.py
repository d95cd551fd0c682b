"""Near-duplicate vectors by cover trees that are traversed in pairs.

Cosine >= c means a distance of at most sqrt(2 - 2 c) between unit vectors.
Equal vectors are taken together first. The top level of the tree is a bounded
set of CELLS centres; every vector goes to its nearest one, and cells are cut by
hash into chunks of about CHUNK vectors. A chunk's own tree has levels of
halving radii: a node keeps its centre, the exact distance to its farthest
member, and children that cover its members with half the radius.

Chunks meet in pairs unless centres lie farther apart than the limit plus both
radii. The same rule prunes pairs of nodes, level by level, with one matrix
product per pair of child lists. Where even the farthest members lie within the
limit, all members link at once, so groups of near copies are never compared
one by one. Links of a pair come back as counts per vector and a star of its
local component; components over all pairs follow.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, spread_join, stored
from .components import components
from .neighbours import distances, filled, matrix, usable

COSINE = 0.9
CELLS, CHUNK, FEW, BLOCK = 64, 2048, 24, 8
SLACK = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; powers of two taken out first keep squares from overflow and from vanishing."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]


class Node:
    __slots__ = ("centre", "radius", "members", "children")

    def __init__(self, centre: int, radius: float, members: np.ndarray, children: list[Node]) -> None:
        self.centre, self.radius, self.members, self.children = centre, radius, members, children


def cover_tree(points: np.ndarray) -> Node:
    """Nested covers with halving radii, down to single points and nodes of at most FEW members."""
    away = distances(points[:1], points)[0]
    return _cover(points, 0, np.arange(len(points)), away, float(away.max()))


def _cover(points: np.ndarray, centre: int, members: np.ndarray, away: np.ndarray, radius: float) -> Node:
    reach = float(away.max())
    if len(members) == 1:
        return Node(centre, 0.0, members, [])
    if len(members) <= FEW or reach <= SLACK:
        return Node(centre, reach, members, [])
    half = min(radius, reach) / 2
    # greedy: the first member left opens a child that takes all within half the radius
    children, left, far = [], members, away
    opener = centre
    while len(left):
        gap = distances(points[opener : opener + 1], points[left])[0]
        near = gap <= half
        near[left == opener] = True
        children.append((opener, left[near], gap[near]))
        left = left[~near]
        opener = int(left[0]) if len(left) else -1
    del far
    return Node(centre, reach, members, [_cover(points, c, m, g, half) for c, m, g in children])


class Side:
    """A chunk: ids, copies per vector, unit vectors, tree."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.copies = ids, copies
        self.points = unit(vectors)
        self.tree = cover_tree(self.points)


class Linker:
    """Dual traversal of two chunks, or of one with itself."""

    def __init__(self, a: Side, b: Side, cosine: float) -> None:
        self.a, self.b, self.same, self.cosine = a, b, a is b, cosine
        self.limit = float(np.sqrt(2 - 2 * cosine))
        self.counts = (np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64))
        self.stars: list[tuple[np.ndarray, np.ndarray]] = []

    def run(self) -> None:
        todo = [(self.a.tree, self.b.tree)]
        while todo:
            todo += self._meet(*todo.pop())

    def _meet(self, x: Node, y: Node) -> list[tuple[Node, Node]]:
        one = self.same and x is y
        if one and x.radius * 2 <= self.limit - SLACK:
            self._all(x.members, y.members, True)
            return []
        xs, ys = x.children or [x], y.children or [y]
        if not x.children and not y.children:
            self._compare(x.members, y.members, one)
            return []
        more: list[tuple[Node, Node]] = []
        rx, ry = np.array([n.radius for n in xs]), np.array([n.radius for n in ys])
        cx, cy = np.array([n.centre for n in xs]), np.array([n.centre for n in ys])
        single_x, single_y = np.array([len(n.members) == 1 for n in xs]), np.array([len(n.members) == 1 for n in ys])
        for s in range(0, len(xs), 1024):
            part = slice(s, s + 1024)
            gap = distances(self.a.points[cx[part]], self.b.points[cy])
            near = gap <= self.limit + rx[part, None] + ry + SLACK
            if one:
                near &= np.arange(len(ys)) >= np.arange(len(xs))[part, None]
            i, j = np.nonzero(near)
            gap, i = gap[i, j], i + s
            plain = single_x[i] & single_y[j]
            if one:
                plain &= i != j
                alone = (i == j) & single_x[i]
                i, j, gap, plain = i[~alone], j[~alone], gap[~alone], plain[~alone]
            self._exact(cx[i[plain]], cy[j[plain]])
            for p, q, g in zip(i[~plain].tolist(), j[~plain].tolist(), gap[~plain].tolist(), strict=True):
                u, v = xs[p], ys[q]
                if u is not v and g + u.radius + v.radius <= self.limit - SLACK:
                    self._all(u.members, v.members, False)
                else:
                    more.append((u, v))
        return more

    def _all(self, left: np.ndarray, right: np.ndarray, one: bool) -> None:
        """Every member of one side links with every member of the other."""
        if one:
            self.counts[0][left] += self.a.copies[left].sum() - self.a.copies[left]
            self.stars.append((left, np.full(len(left), left[0])))
            return
        self.counts[0][left] += self.b.copies[right].sum()
        self.counts[1][right] += self.a.copies[left].sum()
        self.stars.append((left, np.full(len(left), right[0] + self._shift())))
        self.stars.append((np.full(len(right), left[0]), right + self._shift()))

    def _shift(self) -> int:
        return 0 if self.same else len(self.a.ids)

    def _compare(self, left: np.ndarray, right: np.ndarray, one: bool) -> None:
        gap = distances(self.a.points[left], self.b.points[right])
        near = gap <= self.limit + SLACK
        if one:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        self._exact(left[i], right[j])

    def _exact(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count the pairs whose cosine reaches the threshold."""
        for s in range(0, len(i), 50_000):
            p, q = i[s : s + 50_000], j[s : s + 50_000]
            cosine = (self.a.points[p] * self.b.points[q]).sum(axis=1)
            p, q = p[cosine >= self.cosine], q[cosine >= self.cosine]
            np.add.at(self.counts[0], p, self.b.copies[q])
            np.add.at(self.counts[1], q, self.a.copies[p])
            self.stars.append((p, q + self._shift()))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with links, their counts, and the smallest id of their component within the pair."""
        ids = self.a.ids if self.same else np.concatenate([self.a.ids, self.b.ids])
        counts = self.counts[0] + self.counts[1] if self.same else np.concatenate(self.counts)
        low = ids.copy()
        if self.stars:
            i, j = (np.concatenate([s[k] for s in self.stars]) for k in (0, 1))
            while True:
                before = low.copy()
                np.minimum.at(low, i, before[j])
                np.minimum.at(low, j, low[i])
                if (low == before).all():
                    break
        keep = counts > 0
        return ids[keep], counts[keep], low[keep]


def _nearest_cell(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("vector"))
            gap = distances(unit(vectors), centres)
            cell = gap.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(gap.min(axis=1))], [*batch.schema.names, "cell", "away"])

    return run


def _chunk_blob(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id", ignore_index=True)
    side = Side(rows["id"].to_numpy(), rows["copies"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(np.float64))
    blob = pickle.dumps((side.ids, side.copies, side.points, side.tree))
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "cell": rows["cell"].iloc[:1], "away": [float(rows["away"].max())], "blob": [blob]})


def _load(blob: bytes) -> Side:
    side = Side.__new__(Side)
    side.ids, side.copies, side.points, side.tree = pickle.loads(blob)
    return side


def _linked(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {}
        for batch in batches:
            for number, own, chunk, others, blob in zip(*(batch.column(c) for c in ("block", "own", "chunk", "others", "blob")), strict=True):
                side, chunk = _load(blob.as_py()), chunk.as_py()
                if number.as_py() != block:
                    block, held = number.as_py(), {}
                if own.as_py():  # the chunks of a block come first
                    held[chunk] = side
                for other in others.as_py():
                    linker = Linker(held[other], side, cosine)
                    linker.run()
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in linker.links()], ["id", "links", "low"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; their component is their own id. Equal vectors link with
    each other. Vectors shorter than the longest count as filled up with zeros. Rows that share an id count as one vector if equal, else each
    for itself, in one component. Rows without an id are not compared, are their
    own null component and not kept. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")), "vectors")
    good = rows.filter(usable("vector") & F.col("id").isNotNull()).dropDuplicates(["id", "vector"])
    shortest, longest = good.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if shortest != longest:
        good = filled(good, "vector", longest).dropDuplicates(["id", "vector"])
    keyed = stored(good.withColumn("copy_of", F.xxhash64("vector")), "keyed-vectors")
    classes = stored(keyed.groupBy("vector", "copy_of").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    total = classes.count()
    if total:
        first = classes.orderBy(F.xxhash64("id"), "id").limit(CELLS).select("vector").collect()  # CELLS vectors at most
        centres = unit(np.array([r[0] for r in first], np.float64))
        schema = f"id long, copies long, vector {classes.schema['vector'].dataType.simpleString()}, cell long, away double"
        placed = stored(classes.select("id", "copies", "vector").mapInArrow(_nearest_cell(centres), schema), "placed")
        blobs = _chunks(placed)
        near = distances(centres, centres)
        found = _pairs(spark, blobs, near, float(np.sqrt(2 - 2 * cosine))).mapInArrow(_linked(cosine), "id long, links long, low long")
    else:
        found = spark.createDataFrame([], "id long, links long, low long")
    found = stored(found, "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    leads = classes.select("vector", "copy_of", F.col("id").alias("lead"), "copies")
    members = stored(_copies(keyed, leads).join(counts.withColumnRenamed("id", "lead"), "lead", "left"), "vector-members")
    edges = found.select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(members.select(F.col("id").alias("a"), F.col("lead").alias("b")))
    of = components(edges).withColumnRenamed("node", "id")
    n_links = members.groupBy("id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id").join(n_links, "id", "left").join(of, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _copies(keyed: DataFrame, leads: DataFrame) -> DataFrame:
    """Each vector with the lead of its class; the hash carries the join, so hot classes are spread."""
    right = leads.withColumnRenamed("vector", "of")
    return spread_join(keyed, right, "copy_of").filter(F.col("vector") == F.col("of")).select("id", "lead", "copies")


def _chunks(placed: DataFrame) -> DataFrame:
    """Stored chunks (chunk, cell, away, blob), numbered through all cells."""
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # CELLS rows at most
    first, cuts, at = {}, {}, 0
    for cell, n in sorted(sizes.items()):
        first[cell], cuts[cell] = at, -(-n // CHUNK)
        at += cuts[cell]
    lookup = lambda table: F.element_at(F.create_map(*[F.lit(int(x)) for kv in table.items() for x in kv]), F.col("cell").cast("int")).cast("long")
    chunk = lookup(first) + F.pmod(F.xxhash64("id"), lookup(cuts))
    schema = "chunk long, cell long, away double, blob binary"
    return stored(placed.withColumn("chunk", chunk).groupBy("chunk").applyInPandas(_chunk_blob, schema), "chunks")


def _pairs(spark: SparkSession, blobs: DataFrame, near: np.ndarray, limit: float) -> DataFrame:
    """Blocks of BLOCK chunks, each with all chunks that may hold links with some of them, its own first.

    Only cells that lie near enough for their widest chunks are joined. Of a
    pair, the chunk that stays in its block is the one or the other by parity,
    so blocks have like work and a chunk travels once per block.
    """
    heads = stored(blobs.select("chunk", "cell", "away"), "chunk-heads")
    widest = {r[0]: r[1] for r in heads.groupBy("cell").agg(F.max("away")).collect()}  # CELLS rows at most
    cells = [(i, j, float(near[i, j])) for i in widest for j in widest if near[i, j] <= widest[i] + widest[j] + limit + SLACK]
    met = spark.createDataFrame(cells, "cell_a long, cell_b long, gap double")
    for side in "ab":
        met = met.join(heads.select(F.col("chunk").alias(side), F.col("cell").alias(f"cell_{side}"), F.col("away").alias(f"away_{side}")), f"cell_{side}")
    met = met.filter((F.col("a") <= F.col("b")) & (F.col("gap") <= F.col("away_a") + F.col("away_b") + limit + SLACK))
    stays = ((F.col("a") + F.col("b")) % 2 == 0) | (F.floor(F.col("a") / BLOCK) == F.floor(F.col("b") / BLOCK))
    sent = met.select(F.when(stays, F.col("a")).otherwise(F.col("b")).alias("other"), F.when(stays, F.col("b")).otherwise(F.col("a")).alias("chunk"))
    block = F.floor(F.col("other") / BLOCK).cast("long")
    grouped = sent.groupBy(block.alias("block"), "chunk").agg(F.sort_array(F.collect_list("other")).alias("others"))  # BLOCK at most
    own = F.floor(F.col("chunk") / BLOCK) == F.col("block")
    rows = grouped.join(blobs.select("chunk", "blob"), "chunk").select("block", own.alias("own"), "chunk", "others", "blob")
    blocks = -(-(heads.agg(F.max("chunk")).first()[0] + 1) // BLOCK)
    return rows.repartition(int(min(blocks, 4096)), "block").sortWithinPartitions("block", F.desc("own"), "chunk")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
