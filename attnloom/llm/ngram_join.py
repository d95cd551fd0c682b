"""Exact Jaccard join of documents on word shingles: size-banded tiles, bitmap bounds, exact intersections.

Sets are 5-word shingles (lower-cased A-Z) as 64-bit hashes. Two documents link
when 100 * |intersection| >= 75 * |union|.

1. Documents with the same set form one class; its smallest id stands for it.
2. Classes that agree on one of a few minimum hashes are compared with a centre
   of their group, in a few rounds. This is only a cheap start: it joins most
   copies, so that later steps need not look at pairs inside a component.
3. Tiles find every remaining link. Under any common order of shingles, two
   linked sets share one within the first n - ceil(0.75 n) + 1 shingles of both.
   The order here is by hash, very frequent shingles last. A tile holds the
   classes that share such a shingle, cut by size bands (linked
   sizes lie in the same or the next band) and, where many share it, by
   blocks. Tiles whose rows all belong to one component are left out, and of
   shingles that the same documents hold only the first has tiles.
   In a tile, places and bit counts of hashed bitmaps bound the overlap from above.
4. Pairs that pass are checked by exact intersection; components of all links
   give the result.

Only shingles that several components share reach a tile, so work follows the
shared text and not the square of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, removed, slices, small_join, sparing, spread_join, stored
from .components import components
from .hashing import scramble, shingle_sets

SIMILAR = 75
STARTS, START_ROUNDS = 8, 2
_SEEDS = scramble(np.arange(1, STARTS + 1, dtype=np.uint64))[:, None]
MIN_BITS, MAX_BITS = 64, 1 << 17
#: A shingle counts as frequent when it is in one of so many documents of some block of texts; order only, never a filter.
FREQUENT_SHARE, FREQUENT_LIST, FREQUENT_BLOCK = 400, 200_000, 4 << 20
BLOCK = 2048
#: Shared shingles of 16 bytes that are broadcast at most (24 MB); more go by a shuffled join.
MOST_SHARED = 1_500_000
#: A little over 4/3, so that sizes of just that ratio never lie two bands apart.
_BAND = float(np.log(1.34))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield part.column("doc_id"), shingle_sets(part.column("text"))


def _bitmap(shingles: np.ndarray) -> bytes:
    bits = min(MAX_BITS, max(MIN_BITS, 2 << int(len(shingles) - 1).bit_length()))
    mask = np.zeros(bits, bool)
    mask[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(mask).tobytes()


_SIGNATURE = "doc_id long, n_shingles long, set_id binary, bits binary, starts array<long>"


@sparing
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _rows(batches):
        starts = [scramble(s ^ _SEEDS).min(axis=1).view(np.int64).tolist() if len(s) else [] for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([_bitmap(s) if len(s) else b"" for s in sets], pa.binary()),
                pa.array(starts, pa.list_(pa.int64())),
            ],
            ["doc_id", "n_shingles", "set_id", "bits", "starts"],
        )


@sparing
def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in at least 1 / FREQUENT_SHARE of the documents of one block of texts.

    A shingle in that share of all documents has it in some block, so none is missed.
    Blocks are larger than the slices that are hashed at once, as only hashes are held.
    """
    for block in (block for batch in batches for block in slices(batch, "text", FREQUENT_BLOCK)):
        sets = [s for _, some in _rows([block]) for s in some]
        every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        edges = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        counts = np.diff(np.append(edges, len(every)))
        keep = counts >= max(4, len(sets) / FREQUENT_SHARE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(every[edges][keep].view(np.int64)), pa.array(counts[keep])], ["shingle", "docs"]
        )


def _fronts(frequent: np.ndarray):
    """Per document the first n - ceil(0.75 n) + 1 shingles, frequent ones last, and how many are not frequent."""

    @sparing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _rows(batches):
            fronts, rare = [], []
            for s in sets:
                most = len(s)
                size = len(s) - (SIMILAR * len(s) + 99) // 100 + 1 if len(s) else 0
                if len(frequent):
                    at = np.searchsorted(frequent, s)
                    common = frequent[np.minimum(at, len(frequent) - 1)] == s
                    most -= int(common.sum())
                    s = np.concatenate([s[~common], s[common]])
                fronts.append(s[:size])
                rare.append(most)
            yield pa.RecordBatch.from_arrays([ids, _lists(fronts), pa.array(rare, pa.int64())], ["doc_id", "front", "rare"])

    return run


@sparing
def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("to"), _lists(shingle_sets(part.column("text")))], ["to", "shingles"])


def _fold(bits: bytes, size: int) -> np.ndarray:
    """The bitmap as 64-bit words, folded to `size` bytes."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def _linkable(n: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """An overlap of `most` suffices for sets of n and m."""
    return 100 * most >= SIMILAR * (n + m - most)


def bounded_pairs(ids, sizes, groups, sides, places, bits) -> list[tuple[int, int]]:
    """Pairs of a tile from different components that sizes, places and bit counts allow to link.

    Where the tile's shingle is the first that two sets share, they share none
    of the earlier ones, so |A n B| <= |A| - place in A, and the same from B; in
    another tile of the pair it is the first. A bit of one bitmap that the other
    lacks stands for at least one shingle the other lacks, so |A n B| <= |A| -
    popcount(A & ~B). Of two sides, pairs of equal sides 1 belong to another tile.
    """
    i, j = np.triu_indices(len(ids), 1) if len(ids) <= 512 else (None, None)
    found = []
    maps = None
    for first in range(1 if i is not None else len(ids) - 1):
        if i is not None:
            p, q = i, j
        else:  # a large tile goes row by row
            q = np.arange(first + 1, len(ids))
            p = np.full(len(q), first)
        n, m = sizes[p], sizes[q]
        near = (groups[p] != groups[q]) & ((sides[p] != 1) | (sides[q] != 1))
        near &= _linkable(n, m, np.minimum(np.minimum(n, m), np.minimum(n - places[p], m - places[q])))
        p, q = p[near], q[near]
        if not len(p):
            continue
        if maps is None:
            width = min(len(b) for b in bits)
            maps = np.stack([_fold(b, width) for b in bits])
        for at in range(0, len(p), 4096):
            a, b = p[at : at + 4096], q[at : at + 4096]
            lack = [np.bitwise_count(maps[x] & ~maps[y]).sum(axis=1, dtype=np.int64) for x, y in ((a, b), (b, a))]
            fit = _linkable(sizes[a], sizes[b], np.minimum(sizes[a] - lack[0], sizes[b] - lack[1]))
            found += [(int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))) for x, y in zip(a[fit], b[fit], strict=True)]
    return found


@sparing
def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, candidate pairs out; one tile is held at a time."""

    def pairs(rows: list) -> pa.RecordBatch:
        ids, sizes, groups, sides, places = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4, 5))
        found = bounded_pairs(ids, sizes, groups, sides, places, [r[6] for r in rows]) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    key, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("tile", "doc_id", "n_shingles", "component", "side", "place", "bits")]
        for row in zip(*columns, strict=True):
            if row[0] != key:
                if rows:
                    yield pairs(rows)
                key, rows = row[0], []
            rows.append(row)
    if rows:
        yield pairs(rows)


@sparing
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by centre, block and side in, linked pairs out; the sets of one centre are held at a time."""
    key, centre = None, {}
    for batch in batches:
        sets = batch.column("shingles")
        shingles, edges = sets.values.to_numpy(), sets.offsets.to_numpy()
        columns = [batch.column(c).to_pylist() for c in ("centre", "block", "side", "visitor")]
        found = []
        for i, (hub, block, side, visitor) in enumerate(zip(*columns, strict=True)):
            own = shingles[edges[i] : edges[i + 1]]
            if key != (hub, block):
                key, centre = (hub, block), {}
            if side == 0:  # rows may share an id; the batch is not held on to
                centre.setdefault(own.tobytes(), own.copy())
            elif any(_links(own, other) for other in centre.values()):
                found.append((visitor, hub) if side == 1 else (hub, visitor))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _links(one: np.ndarray, other: np.ndarray) -> bool:
    n, m = len(one), len(other)
    return bool(_linkable(n, m, min(n, m)) and _linkable(n, m, len(np.intersect1d(one, other, assume_unique=True))))


def _checked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stored pairs (a, b) whose shingle sets link, by exact intersection.

    Of each pair the document of more pairs is the centre. Its set goes once to
    each block of about BLOCK visitors, and the visitor's set once per pair. Sets
    learn where to go before they leave the task that hashes them, so none is
    shuffled to meet its pairs, and none is stored.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    degree = stored(ends.groupBy("doc_id").agg(F.count("*").alias("n")), "degree")
    if degree.isEmpty():
        return pairs
    left = spread_join(pairs, degree.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a")), "a")
    both = spread_join(left, degree.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b")), "b")
    hub = F.greatest(F.struct("n_a", "a"), F.struct(F.col("n_b").alias("n_a"), F.col("b").alias("a")))
    met = both.select("a", "b", hub["a"].alias("centre"), F.ceil(hub["n_a"] / BLOCK).alias("blocks"))
    visitor = F.when(F.col("centre") == F.col("b"), F.col("a")).otherwise(F.col("b"))
    side = F.when(F.col("centre") == F.col("b"), 1).otherwise(2)
    met = met.select(visitor.alias("doc_id"), "centre", F.pmod(F.xxhash64(visitor), "blocks").alias("block"), side.alias("side"))
    met = stored(met, "meetings")
    hosts = met.select(F.col("centre").alias("doc_id"), "centre", "block", F.lit(0).alias("side")).distinct()
    ways = met.unionByName(hosts).groupBy("doc_id").agg(F.collect_list(F.struct("centre", "block", "side", F.col("doc_id").alias("visitor"))).alias("to"))
    ways = stored(ways, "ways")
    own = small_join(docs.select("doc_id", "text"), ways, "doc_id").select("text", "to")
    to = "array<struct<centre: long, block: long, side: int, visitor: long>>"
    sets = own.mapInArrow(_dealt, f"to {to}, shingles array<long>").select(F.explode("to").alias("to"), "shingles").select("to.*", "shingles")
    placed = sets.repartition("centre", "block").sortWithinPartitions("centre", "block", "side")
    linked = stored(placed.mapInArrow(_met, "a long, b long"), "linked")
    removed(degree, met, ways)
    return linked


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` (doc_id, ...) with `component`, the smallest id reachable over `links`."""
    of = stored(components(links).withColumnRenamed("node", "doc_id"), "components")
    return nodes.join(of, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    Null or empty texts have an empty set, link with nothing and keep their own
    id. Rows that share a doc_id count as one document. A row whose doc_id is
    null is not compared; its component_id is null. Other columns are ignored.
    An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = stored(docs.mapInArrow(_signatures, _SIGNATURE), "signatures")
    known = signatures.filter("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("n_shingles", "set_id").agg(F.min("doc_id").alias("first"))
    copies = known.join(classes, ["n_shingles", "set_id"]).filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    copies = stored(copies.distinct(), "copies")
    leaders = stored(
        classes.withColumnRenamed("first", "doc_id").join(known.dropDuplicates(["doc_id", "set_id"]), ["doc_id", "n_shingles", "set_id"]), "leaders"
    )
    links = copies.unionByName(_started(docs, leaders))
    nodes = _grouped(leaders.select("doc_id", "n_shingles", "bits"), links)
    nodes = stored(nodes, "nodes")
    removed(leaders)
    links = stored(links.unionByName(_checked(docs, _tile_pairs(docs, nodes))), "all-links")
    component = F.col("component").alias("component_id")
    return _grouped(signatures.select("doc_id", "n_shingles"), links).select("doc_id", "n_shingles", component)


def _started(docs: DataFrame, leaders: DataFrame) -> DataFrame:
    """Links of classes to one centre of each group with the same minimum hash.

    The centre of a group is its class with most links of earlier rounds, at
    first the smallest; only members of other components are compared with it.
    Originals of many copies soon lead their groups. Rounds end when none adds a
    link, or after START_ROUNDS: what is left is found by the tiles.
    """
    keyed = stored(leaders.select("doc_id", F.posexplode("starts").alias("k", "least")).select("doc_id", F.xxhash64("k", "least").alias("key")), "start-keys")
    links = None
    for _ in range(START_ROUNDS):
        if links is None:
            known = keyed.select("*", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("degree"))
        else:
            degree = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("degree"))
            of = stored(_grouped(leaders.select("doc_id").distinct(), links).join(degree, "doc_id", "left"), "start-state")
            known = stored(keyed.join(of, "doc_id").fillna(0, ["degree"]), "start-known")
        lead = F.min(F.struct((-F.col("degree")).alias("less"), F.col("doc_id").alias("b"), F.col("component").alias("of"))).alias("lead")
        groups = known.groupBy("key").agg(lead, F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
        groups = stored(groups.select("key", "lead.b", "lead.of"), "centres")
        pairs = spread_join(known.select(F.col("doc_id").alias("a"), "key", "component"), groups, "key").filter("component <> of")
        pairs = _may_link(stored(pairs.select("a", "b").distinct(), "start-pairs"), leaders)
        if links is not None:
            pairs = pairs.join(links, ["a", "b"], "left_anti")
        new = _checked(docs, stored(pairs, "start-pairs"))
        links = new if links is None else stored(links.unionByName(new), "start-links")
        if new.isEmpty():
            break
    removed(keyed)
    return links


def _may_link(pairs: DataFrame, leaders: DataFrame) -> DataFrame:
    """The pairs that sizes allow to link."""
    of = leaders.select("doc_id", F.col("n_shingles").alias("n"))
    left = spread_join(pairs, of.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a")), "a")
    both = spread_join(left, of.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b")), "b")
    return both.filter(100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b")).select("a", "b").distinct()


def _tile_pairs(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate pairs of classes from different components, complete by the prefix rule."""
    often = docs.mapInArrow(_frequent, "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    listed = often.orderBy(F.desc("docs"), "shingle").limit(FREQUENT_LIST).toPandas()["shingle"].to_numpy(np.int64)
    fronts = docs.mapInArrow(_fronts(np.sort(listed.view(np.uint64))), "doc_id long, front array<long>, rare long")
    parts = nodes.select("doc_id", "component", "n_shingles")
    fronts = stored(fronts.filter("doc_id is not null").join(parts, "doc_id"), "fronts")
    keyed = fronts.select("doc_id", "component", "n_shingles", "rare", F.posexplode("front").alias("place", "shingle"))
    # of two linked sets the smaller has the first common shingle among its first 1/7
    inner = F.col("place") < F.col("n_shingles") - F.ceil(F.lit(2 * SIMILAR) * F.col("n_shingles") / F.lit(100 + SIMILAR)) + 1
    shared = keyed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(inner).alias("inner"))
    shared = stored(shared.filter("low <> high and inner").select("shingle"), "shared")
    rows = stored(small_join(keyed, shared, "shingle", "left_semi", rows=MOST_SHARED), "tile-rows")
    removed(fronts)
    rows = small_join(rows, stored(_first_shingles(rows), "first-shingles"), "shingle", rows=MOST_SHARED)
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / _BAND)
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    # a set of n reaches one of m in the next band only with n - place >= 3/7 (n + m), m > 1.34 ** (band + 1) (with slack)
    reach = (F.col("n_shingles") - F.col("place") + 1) * (100 + SIMILAR) >= SIMILAR * (F.col("n_shingles") + F.exp((band + 1) * _BAND))
    # side 1: a visitor from the band below, or the second block of a pair; two of them meet in their own tile
    own = F.struct(band.alias("band"), F.lit(0).alias("visit"))
    visit = F.struct((band + 1).alias("band"), F.lit(1).alias("visit"))
    banded = rows.withColumn("block", block).select("*", F.explode(F.when(reach, F.array(own, visit)).otherwise(F.array(own))).alias("at"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiled = banded.select("doc_id", "component", "n_shingles", "shingle", "place", "at.*", "block", other)
    tile = F.xxhash64("shingle", "band", F.least("block", "other"), F.greatest("block", "other")).alias("tile")
    tiled = stored(tiled.select("doc_id", "component", "n_shingles", tile, F.col("visit").alias("side"), "place"), "tiled")
    of = tiled.groupBy("tile").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("side").alias("side"), F.max(inner).alias("inner")
    )
    of = of.filter("low <> high and side = 0 and inner").select("tile")
    tiled = small_join(tiled, stored(of, "mixed-tiles"), "tile", "left_semi")
    tiled = spread_join(stored(tiled, "tiled"), nodes.select("doc_id", "bits"), "doc_id")
    found = tiled.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles, "a long, b long")
    return stored(found.distinct(), "pairs")


def _first_shingles(rows: DataFrame) -> DataFrame:
    """(shingle, blocks): of shingles held by the same documents only the first in the common order.

    A pair needs only the tile of its first common shingle. Where the same
    documents hold an earlier one, a shingle is the first of no pair. A passage
    that documents share so gives about one tile and not one for each word.
    Sets of documents are told apart by their number and two 64-bit sums of hashes.
    """
    member = [F.xxhash64("doc_id", F.lit(k)) for k in (1, 2)]
    late = F.col("place") >= F.col("rare")
    held = rows.groupBy("shingle").agg(
        F.count("*").alias("n"), F.bit_xor(member[0]).alias("x"), F.bit_xor(member[1]).alias("y"), F.max(late).alias("late")
    )
    # shingles are ordered as unsigned numbers
    order = F.struct("late", F.col("shingle").bitwiseXOR(F.lit(-(1 << 63))), "shingle")
    first = held.groupBy("n", "x", "y").agg(F.min(order).alias("first"))
    return first.select("first.shingle", F.ceil(F.col("n") / BLOCK).alias("blocks"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row per group of `docs`, all columns: that of the smallest id; rows of null ids all stay.

    Of several rows with one id the smallest stays, in the order of text and the other columns.
    """
    groups = jaccard_components(docs)
    gone = stored(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = small_join(docs, gone, "doc_id", "left_anti")
    again = stored(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = small_join(kept, again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("least"))
    return small_join(kept, again, "doc_id", "left_anti").unionByName(least.select("doc_id", "least.*").select(docs.columns))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
