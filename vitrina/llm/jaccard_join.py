"""N-gram Jaccard join of documents with a count-vector R-tree.

A document is the set of its distinct five-word shingles (64-bit hashes). Two
documents link when 4 * |A & B| >= 3 * |A | B|, that is 7 * |A & B| >= 3 * (|A|
+ |B|). Equal sets are one class from the start; everything after works on
classes, so copies cost nothing.

1. Hashes are dealt into groups, a power of two that leaves ``LEAST_IN_GROUP`` to
   twice as many in a group; the counts by group are the point of a set. The sum
   of the smaller coordinates of two points bounds the overlap. Points of twice
   as many groups are folded by adding up halves.
2. Sets that can link share one of their smallest hashes: in sets of up to 127
   shingles one of the first n / 4 + 1 (always), in longer ones one of the first
   ``KEYS``, but for a chance below 4^-32 a pair, that of a 64-bit hash clash. With
   ``keys=None`` the first n / 4 + 1 are taken whatever the size, without that chance.
   Sets that share a key meet; an R-tree over their points (sorted by size, pages
   with the largest coordinates and the range of sizes) finds the pairs that the
   bound allows. Its connected components are the clusters: links never leave one.
3. Clusters are verified on the texts themselves: again by R-tree, and what the
   bound allows is compared exactly, by an index of the shingles. Pairs already
   connected are not compared, so a cluster of near copies costs about one
   comparison a member, and each result is a spanning tree, never all pairs.

Large groups do not meet in one task. Groups of over ``TILE`` sets go by size
bands (linked sets lie in the same or in neighbouring bands), each band is dealt
into tiles, and tasks get pairs of tiles. First every tile meets itself and the
first one; only groups that are still not connected get their other pairs.

Defined cases: null or empty texts have no shingle and link with nothing; texts
of one to four words have one shingle, the whole sequence; rows are judged one by
one, so repeated rows are copies; the component of rows with null ids only is
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import EDGES_A_TASK, WordHash, checkpoint, components, field, mix64, read_table, words

N_WORDS = 5
LEAST_IN_GROUP, LEAST_GROUPS = 2, 32
KEYS = 32
FIRST_KEYS = 2
TILE = 2_048
#: Shingles in a tile of texts.
TILE_SHINGLES = 2_000_000
PAGE = 32
#: Parts that the rows of a group are spread over where they meet what is known of the group.
SALTS = 16
#: A coordinate that stands for this and more, and one that bounds nothing.
_SATURATED, _UNKNOWN = 255, 60_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = hashes.of(ws)
    n = min(len(h), N_WORDS)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _FACTORS[k]
    return np.unique(mix64(total + np.uint64(N_WORDS - n)))


def set_hash(s: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit number."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def point(s: np.ndarray) -> np.ndarray:
    """Counts by group; _SATURATED stands for that and more."""
    groups = max(LEAST_GROUPS, 1 << (max(1, len(s) // LEAST_IN_GROUP).bit_length() - 1))
    counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, _SATURATED).astype(np.uint8)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_keys: int | None = KEYS) -> DataFrame:
    """(doc_id, copy, n, cls, keys, point) of every row; copy is a hash of the text; cls, that of the set, is null for empty sets."""
    kind = field(docs, id_col).dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("copy", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("point", T.BinaryType()),
    ])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            n, cls, keys, points = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), hashes)
                n.append(len(s))
                cls.append(set_hash(s) if len(s) else None)
                # a set's first n - ceil(3 n / 4) + 1 hashes hold one of any linked set's
                needed = len(s) - -(-3 * len(s) // 4) + 1 if len(s) else 0
                keys.append(s[: needed if most_keys is None else min(most_keys, needed)].astype(np.int64))
                points.append(point(s).tobytes() if len(s) else None)
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(id_col, F.xxhash64(text_col).alias("copy"), text_col).mapInArrow(task, schema)


class Tree:
    """R-tree over points of equally many groups: pages of sets close in size, and pages of pages."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, points: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.members, self.sizes, self.points = members[order], sizes[order], points[order]
        self.levels = []  # (largest coordinates, least size, largest size), leaves first
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > PAGE:
            at = np.arange(0, len(top), PAGE)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def near(self, size: int, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Members (of the flagged ones) whose bound with a point of that size allows a link."""

        def allowed(top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            fits = np.flatnonzero((4 * high >= 3 * size) & (3 * low <= 4 * size))
            return fits[7 * np.minimum(top[fits], at).sum(1, dtype=np.int64) >= 3 * (size + low[fits])]

        found = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.members))
        for k in range(len(self.levels) - 1, -1, -1):  # from the root's pages down
            found = found[allowed(*(x[found] for x in self.levels[k]))]
            below = len(self.levels[k - 1][0]) if k else len(self.members)
            found = (found[:, None] * PAGE + np.arange(PAGE)).ravel()
            found = found[found < below]
        found = found[wanted[self.members[found]]]
        return self.members[found[allowed(self.points[found], self.sizes[found], self.sizes[found])]]


class Forest:
    """Trees over points of any numbers of groups; sets that can link differ by a factor of two at most."""

    def __init__(self, sizes: np.ndarray, points: list[np.ndarray]):
        self.sizes, self.points = sizes, [np.where(p == _SATURATED, _UNKNOWN, p).astype(np.uint16) for p in points]
        self.widths = np.array([len(p) for p in points])
        self.trees: dict[tuple[int, int], Tree] = {}

    @staticmethod
    def _folded(p: np.ndarray, width: int) -> np.ndarray:
        return np.minimum(p.reshape(-1, width).sum(0, dtype=np.int64), _UNKNOWN).astype(np.uint16) if len(p) > width else p

    def near(self, k: int, wanted: np.ndarray) -> np.ndarray:
        """Sets (of the flagged ones) whose bound with set k allows a link."""
        found, own = [], len(self.points[k])
        for width in (own // 2, own, 2 * own):
            common = min(width, own)
            if (width, common) not in self.trees:
                members = np.flatnonzero(self.widths == width)
                points = np.array([self._folded(self.points[j], common) for j in members], np.uint16).reshape(-1, max(1, common))
                self.trees[width, common] = Tree(members, self.sizes[members], points)
            tree = self.trees[width, common]
            if len(tree.members):
                found.append(tree.near(self.sizes[k], self._folded(self.points[k], common), wanted))
        return np.concatenate(found) if found else np.empty(0, np.int64)


class Overlaps:
    """Index of the shingles of several sets."""

    def __init__(self, sets: list[np.ndarray]):
        lengths = [len(s) for s in sets]
        found, self.places = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum([0, *lengths])
        owners = np.repeat(np.arange(len(sets), dtype=np.int32), lengths)
        self.owners = owners[np.argsort(self.places, kind="stable")]
        self.starts = np.cumsum([0, *np.bincount(self.places, minlength=len(found))])

    def of(self, k: int) -> np.ndarray:
        """Size of set k's overlap with every set."""
        mine = self.places[self.ends[k] : self.ends[k + 1]]
        starts, counts = self.starts[mine], self.starts[mine + 1] - self.starts[mine]
        at = np.repeat(starts - np.cumsum([0, *counts[:-1]]), counts) + np.arange(counts.sum())
        return np.bincount(self.owners[at], minlength=len(self.ends) - 1)


def linked(sizes: np.ndarray, points: list[np.ndarray], labels: np.ndarray, overlaps: Overlaps | None) -> list[tuple[int, int]]:
    """Edges that connect what links connect (of what the bound allows, without ``overlaps``) beyond the labels.

    Sets of equal label are connected already. All sets but those of the most
    frequent label look for sets that are not connected with them yet.
    """
    forest, edges = Forest(sizes, points), []
    _, part = np.unique(labels, return_inverse=True)
    for k in np.flatnonzero(part != np.bincount(part).argmax()):
        apart = part != part[k]
        if not apart.any():
            break
        near = forest.near(k, apart)
        if overlaps and len(near):
            near = near[7 * overlaps.of(k)[near] >= 3 * (sizes[k] + sizes[near])]
        if len(near):
            found, at = np.unique(part[near], return_index=True)
            edges += [(j, k) for j in near[at].tolist()]
            part[np.isin(part, found)] = part[k]
    return edges


def _by_group(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``n_keys`` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        if held and [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(n_keys)] != keys[:, 0].tolist():
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


_EDGES = "a long, b long"
_AT = ("g", "x", "y")


def _with_group(rows: DataFrame, facts: DataFrame, same: dict[str, str], how: str = "inner") -> DataFrame:
    """rows (with g and cls) joined with one row of facts for each group (``same``: columns of rows to those of facts).

    The facts are copied to SALTS parts and a group's rows dealt over these, so that a
    group of any size is spread.
    """
    part = F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(SALTS)).cast("int")
    facts = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_own", part)
    on = [F.col(a) == F.col(b) for a, b in same.items()] + [F.col("_own") == F.col("_part")]
    return rows.join(facts, on, how).drop("_own", "_part")


def _tiled(rows: DataFrame, near: bool, rest: bool) -> DataFrame:
    """Rows (g, cls, n, label) dealt to pairs of tiles (g, x, y).

    A group needs a tile for each TILE sets and each TILE_SHINGLES shingles. If it
    needs several, its sets go by size bands: linked sets differ in size by a third at
    most, so they meet in the band of the larger one, and each band has its own tiles.
    near: a tile with itself and with the first one; rest: all other pairs.
    """
    tiles = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("s") / TILE_SHINGLES)).cast("int")
    band = F.floor(F.log("n") / math.log(4 / 3)).cast("int")
    sums = rows.groupBy("g", band.alias("band")).agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    whole = sums.groupBy("g").agg(F.sum("m").alias("m"), F.sum("s").alias("s")).where("m > 1").select(F.col("g").alias("g2"), tiles.alias("tiles"))
    large = whole.where("tiles > 1").select(F.col("g2").alias("g3"))
    both = sums.join(large, F.col("g") == F.col("g3"), "left_semi").withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    of_band = both.groupBy(F.col("g").alias("g3"), F.col("band").alias("b3")).agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
    rows = _with_group(rows, whole, {"g": "g2"}).drop("g2")
    rows = rows.withColumn("band", F.explode(F.when(F.col("tiles") > 1, F.array(band, band + 1)).otherwise(F.array(F.lit(-1)))))
    rows = _with_group(rows, of_band.select("g3", "b3", tiles.alias("t")), {"g": "g3", "band": "b3"}, "left")
    rows = rows.withColumn("t", F.coalesce("t", F.lit(1))).withColumn("g", F.when(F.col("tiles") > 1, F.xxhash64("g", "band")).otherwise(F.col("g")))
    own = F.pmod(F.xxhash64("cls"), F.col("t")).cast("int")
    others = F.sequence(F.lit(0), F.col("t") - 1)
    pair = lambda o: F.struct(F.least(F.col("own"), o).alias("x"), F.greatest(F.col("own"), o).alias("y"))
    is_near = lambda p: (p.x == p.y) | (p.x == 0)
    pairs = F.filter(F.transform(others, pair), lambda p: (is_near(p) & F.lit(near)) | (~is_near(p) & F.lit(rest)))
    return rows.withColumn("own", own).withColumn("p", F.explode(pairs)).select("g", "p.x", "p.y", "cls", "n", "label")


def _meet(rows: DataFrame, task: Callable) -> DataFrame:
    """Edges that ``task`` finds in each (g, x, y)."""
    return rows.repartition(*_AT).sortWithinPartitions(*_AT).mapInArrow(task, _EDGES)


def _edges_of(names: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(names[e[:, 0]]), pa.array(names[e[:, 1]])], names=["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_group(batches, 3):
        if rows.num_rows > 1:
            points = [np.frombuffer(p.as_py(), np.uint8) for p in rows.column("point")]
            yield _edges_of(rows.column("cls").to_numpy(), linked(rows.column("n").to_numpy(), points, rows.column("label").to_numpy(), None))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for rows in _by_group(batches, 3):
        if rows.num_rows < 2:
            continue
        sets, labels = {}, {}
        for cls, label, text in zip(rows.column("cls").to_pylist(), rows.column("label").to_pylist(), rows.column("text")):
            s = shingles(text.as_py(), hashes)
            if set_hash(s) == cls:  # but for a clash of text hashes
                sets[cls], labels[cls] = s, label
        names, of = np.array(list(sets), np.int64), list(sets.values())
        if len(of) < 2:
            continue

        yield _edges_of(names, linked(np.array([len(s) for s in of]), [point(s) for s in of], np.array(list(labels.values())), Overlaps(of)))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their cls, or cls itself."""
    labels = labels.select(F.col("node").alias("cls2"), "label")
    return rows.join(labels, F.col("cls") == F.col("cls2"), "left").withColumn("label", F.coalesce("label", "cls")).drop("cls2")


def _unsettled(rows: DataFrame) -> DataFrame:
    """Rows (g, cls, n, label) of the groups whose members have more than one label."""
    open_ = rows.groupBy("g").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select(F.col("g").alias("g2"))
    return _with_group(rows, open_, {"g": "g2"}, "left_semi")


def _by_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("null")).alias("_id")


def _one_each(rows: DataFrame) -> DataFrame:
    """One row for each (_id, _copy); the rank limit holds before the shuffle as well, so repeated rows stay few."""
    one = W.partitionBy("_id", "_copy").orderBy("_copy")
    return rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: int | None = KEYS, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(doc_id, copy, n_shingles, component_id, label) of every row.

    keys: most keys of a set (None: as many as the prefix filter needs). edges_a_task:
    up to so many edges are joined by one task, more by rounds of joins.

    copy is a hash of the text; label is the smallest class of the component, null for
    texts without words. Components may share an id (that stands with several texts),
    and have none if all their ids are null; labels tell them apart.
    """
    rows = checkpoint(signatures(docs, id_col, text_col, keys))
    # a class stands for the row of its smallest id (null last), then text hash
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy")).alias("first")
    classes = rows.where("n > 0").groupBy("cls").agg(first, *(F.any_value(c).alias(c) for c in ("n", "keys", "point")))
    classes = checkpoint(classes.select("cls", F.col("first.doc_id").alias("rep"), F.col("first.copy").alias("rep_copy"), "n", "keys", "point"))
    points = classes.select(F.col("cls").alias("c2"), "point")
    with_points = lambda r: r.join(points, F.col("cls") == F.col("c2")).drop("c2")

    # clusters: first by few keys, then by all keys whose sets have not met yet
    first = classes.select(F.explode(F.slice("keys", 1, FIRST_KEYS)).alias("g"), "cls", "n", F.col("cls").alias("label"))
    edges = checkpoint(_meet(with_points(_tiled(first, True, False)), _candidates))
    met = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    met = met.select("node", F.least("node", "label").alias("label"))
    by_key = _labelled(classes.select("cls", "n", "keys"), met).select(F.explode("keys").alias("g"), "cls", "n", "label")
    more = _meet(with_points(_tiled(checkpoint(_unsettled(by_key)), True, True)), _candidates)
    clusters = checkpoint(components(edges.union(more), edges_a_task))

    # links inside clusters, on the texts
    members = _labelled(classes.select("cls", "rep", "rep_copy", "n"), clusters).withColumnRenamed("label", "g")
    several = members.groupBy("g").count().where("count > 1").select(F.col("g").alias("g2"))
    members = checkpoint(_with_group(members, several, {"g": "g2"}, "left_semi"))
    texts = _one_each(docs.select(_by_id(id_col), F.xxhash64(text_col).alias("_copy"), F.col(text_col).alias("text")))
    wanted = members.select(F.col("cls").alias("c2"), _by_id("rep"), F.col("rep_copy").alias("_copy"))
    texts = checkpoint(wanted.join(texts, ["_id", "_copy"]).select("c2", "text"))
    with_text = lambda r: r.join(texts, F.col("cls") == F.col("c2")).drop("c2")
    alone = members.select("g", "cls", "n", F.col("cls").alias("label"))
    links = checkpoint(_meet(with_text(_tiled(alone, True, False)), _verified))
    labels = checkpoint(components(links, edges_a_task))
    parted = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("s") / TILE_SHINGLES)) > 1
    parted = members.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where(parted).select(F.col("g").alias("g2"))
    large = checkpoint(_unsettled(_labelled(_with_group(members.select("g", "cls", "n"), parted, {"g": "g2"}, "left_semi"), labels)))
    if not large.isEmpty():
        links = links.union(_meet(with_text(_tiled(large, False, True)), _verified))
        labels = components(links, edges_a_task)

    named = _labelled(classes.select("cls", "rep"), labels)
    least = named.groupBy(F.col("label").alias("l2")).agg(F.min("rep").alias("component"), F.count("*").alias("m")).where("m > 1").drop("m")
    component = F.when(F.col("l2").isNull(), F.col("rep")).otherwise(F.col("component")).alias("component")
    of_class = _with_group(named, least, {"label": "l2"}, "left").select(F.col("cls").alias("c2"), component, "label")
    out = rows.select("doc_id", "copy", "n", "cls").join(of_class, F.col("cls") == F.col("c2"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", "copy", F.col("n").alias("n_shingles"), component, "label")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id; of rows equal in id, that of the smallest text hash.

    Ids that are null come last. Texts without words stay once for each id and
    text. The texts are shuffled once, by id and text hash, for both the join and
    the choice among repeated rows.
    """
    members = join(docs, id_col, text_col)
    alone = F.when(F.col("n_shingles") == 0, F.struct(_by_id("doc_id"), "copy")).alias("_alone")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy"))
    kept = members.groupBy("label", alone).agg(first.alias("_first"))
    kept = kept.select("_first.doc_id", F.col("_first.copy").alias("_copy")).select(_by_id("doc_id"), "_copy")
    row = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    rows = docs.select(row, _by_id(id_col), F.xxhash64(text_col).alias("_copy"))
    rows = _one_each(rows.join(kept, ["_id", "_copy"]))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return join(read_table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_shingles", F.col("component_id").cast("bigint").alias("component_id"))
