"""SimHash near-duplicates, found exactly with vantage-point trees over Hamming distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, LongType

from .common import bound_batches, components, cut, drop_cut, groups, star_edges, table

SHINGLE, SEED, RADIUS = 4, 42, 4
ALL = np.uint64((1 << 64) - 1)
#: Documents count as near-duplicates if they share so much of their shingles of so many words; they are looked for by
#: fingerprints of their distinct words within so many bits. Texts of one component that are compared in one group at most.
NEAR, NEAR_SHINGLE, NEAR_RADIUS, TOGETHER = 0.8, 5, 6, 1024
#: Fingerprints that trees are made from at most, sampled ones to a leaf at least, fingerprints that a shard shall hold,
#: that are dealt at once, and that are compared one by one in a shard's own tree.
SAMPLE, LEAST, SHARD, DEAL, LEAF = 1 << 16, 8, 1 << 14, 1 << 18, 256


def fingerprint(text: bytes, size: int = SHINGLE, distinct: bool = False) -> int:
    """The 64-bit SimHash of one text's shingles of ``size`` words, repeats included or not; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    if distinct and size == 1:
        words = list(set(words))
        return _majority(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=">u8", count=len(words)))
    n = max(1, len(words) - size + 1)
    if n == 1:
        shingles = [b" ".join(words)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        whole = b" ".join(words)
        starts = [0, *ends]
        shingles = [whole[a : b - 1] for a, b in zip(starts, ends[size - 1 :])]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in (set(shingles) if distinct else shingles)), dtype=">u8")
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    """The bits that over half of the big-endian hashes have."""
    ones, n = np.zeros(64, np.int64), len(h)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@arrow_udf(LongType())
def words_fingerprint_column(text: pa.Array) -> pa.Array:
    """Fingerprints of the distinct words, as signed longs; null texts count as empty."""
    values = [fingerprint(x or b"", 1, True) for x in text.cast(pa.binary()).to_pylist()]
    return pa.array(np.array(values, np.uint64).view(np.int64))


@arrow_udf(BinaryType())
def shingles_column(text: pa.Array) -> pa.Array:
    """Sorted distinct hashes of a text's shingles of NEAR_SHINGLE words; fewer words are one shingle, none have none."""
    return pa.array([shingle_hashes(x or b"").tobytes() for x in text.cast(pa.binary()).to_pylist()], pa.binary())


def shingle_hashes(text: bytes, size: int = 5) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + size]), SEED) for k in range(max(1, len(words) - size + 1))), "<u8"))


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets share at least this part of their union; two empty sets do."""
    if not len(a) and not len(b):
        return True
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return both >= least * (len(a) + len(b) - both)


@arrow_udf(LongType())
def fingerprint_column(text: pa.Array) -> pa.Array:
    """Fingerprints as signed longs; null texts count as empty."""
    values = [fingerprint(x or b"") for x in text.cast(pa.binary()).to_pylist()]
    return pa.array(np.array(values, np.uint64).view(np.int64))


def parts_of(radius: int) -> tuple[tuple[int, int, int], ...]:
    """Parts of a fingerprint as (lowest bit, bits, radius): their radii, each with one added, sum up to more than ``radius``."""
    each, more = divmod(max(0, radius - 2), 3)
    return tuple((shift, bits, each + (k < more)) for k, (shift, bits) in enumerate(((0, 22), (22, 22), (44, 20))))


class VantageTree:
    """A vantage-point tree over fingerprints, by the Hamming distance of the bits in ``mask``.

    A node holds a vantage point and a distance: fingerprints no farther from the point go to the inner child, others to
    the outer. The points are those given (a bounded sample), and any fingerprint has its leaf. Of some vantage points and
    distances near the median the pair is taken that the fewest balls of ``radius`` overlap. Points that are all equal
    under the mask cannot be split and stay in one leaf.
    """

    TRIES = 8

    def __init__(self, points: np.ndarray, mask: int, radius: int, leaves: int, seed: int = 7) -> None:
        self.mask, self.radius = np.uint64(mask), radius
        vantage, split, child = [], [], []
        rng, self.leaves = np.random.default_rng(seed), 0
        size = max(1, len(points) // max(1, leaves))
        todo: list[tuple[np.ndarray, int, int]] = [(points & self.mask, -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            found = self._best(own, rng) if len(own) > size else None
            if found is None:
                here, self.leaves = -1 - self.leaves, self.leaves + 1
            else:
                here, (point, at, near) = len(vantage), found
                vantage.append(point)
                split.append(at)
                child.append([0, 0])
                todo += [(own[~near], here, 1), (own[near], here, 0)]
            if parent >= 0:
                child[parent][side] = here
        self.vantage, self.split = np.array(vantage, np.uint64), np.array(split, np.int64)
        self.child = np.array(child, np.int64).reshape(-1, 2)

    def _best(self, own: np.ndarray, rng) -> tuple | None:
        best = None
        for point in own[rng.integers(0, len(own), self.TRIES)]:
            apart = np.bitwise_count(own ^ point).astype(np.int64)
            upto = np.cumsum(np.bincount(apart, minlength=66))
            inner = np.arange(int(apart.max()))
            inner = inner[(upto[inner] >= len(own) // 4) & (upto[inner] <= len(own) - len(own) // 4)] if len(own) > 8 else inner
            inner = inner if len(inner) else np.arange(int(apart.max()))
            if not len(inner):
                continue
            # Balls around points from just inside to just outside reach both children.
            both = upto[np.minimum(inner + self.radius, 65)] - np.where(inner >= self.radius, upto[np.maximum(inner - self.radius, 0)], 0)
            k = int(np.lexsort((np.abs(2 * upto[inner] - len(own)), both))[0])
            if best is None or both[k] < best[0]:
                best = both[k], point, int(inner[k]), apart <= inner[k]
        return best and best[1:]

    def leaves_of(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of a fingerprint, leaf) for all leaves that its ball of ``radius`` may overlap; its own leaf for 0."""
        own = fp & self.mask
        rows, node = np.arange(len(own)), np.full(len(own), 0 if len(self.vantage) else -1)
        done = []
        while len(rows):
            ended = node < 0
            done.append((rows[ended], -1 - node[ended]))
            rows, node = rows[~ended], node[~ended]
            apart, at = np.bitwise_count(own[rows] ^ self.vantage[node]).astype(np.int64), self.split[node]
            inner, outer = apart - radius <= at, apart + radius > at
            rows, node = np.concatenate([rows[inner], rows[outer]]), np.concatenate([self.child[node[inner], 0], self.child[node[outer], 1]])
        return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


def trees_of(sample: np.ndarray, fingerprints: int, radius: int = RADIUS) -> list[VantageTree]:
    """A tree for each part, with as many leaves as shards of SHARD fingerprints, or as the sample can tell apart."""
    leaves = min(-(-fingerprints // SHARD), max(1, len(sample) // LEAST))
    return [VantageTree(sample, ((1 << bits) - 1) << shift, radius, leaves) for shift, bits, radius in parts_of(radius)]


def _route(trees, first: list[int]):
    """Each fingerprint goes home to one leaf of each part's tree, and visits the later leaves that its ball overlaps."""

    def routed(fp: np.ndarray):
        for tree, base in zip(trees.value, first):
            rows, leaf = tree.leaves_of(fp, 0)
            home = np.empty(len(fp), np.int64)
            home[rows] = leaf
            sent = [(home, np.zeros(len(fp), np.int8), np.arange(len(fp)))]
            if tree.radius:
                rows, leaf = tree.leaves_of(fp, tree.radius)
                later = leaf > home[rows]
                sent.append((leaf[later], np.ones(int(later.sum()), np.int8), rows[later]))
            leaf, role, rows = (np.concatenate([x[k] for x in sent]) for k in range(3))
            order = np.lexsort((role, leaf))
            leaf, role, values = leaf[order], role[order], fp[rows[order]].astype("<u8")
            edges = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (role[1:] != role[:-1]), [True]])) if len(leaf) else np.zeros(1, int)
            payload = [values[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            at = edges[:-1]
            yield pa.RecordBatch.from_arrays([pa.array((leaf[at] + base).astype(np.int32)), pa.array(role[at]), pa.array(payload, pa.binary())], ["shard", "role", "payload"])

    def route(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.asarray(batch.column(0)).view(np.uint64))
            size += batch.num_rows
            if size >= DEAL:
                yield from routed(np.concatenate(held))
                held, size = [], 0
        if held:
            yield from routed(np.concatenate(held))

    return route


def near_pairs(home: np.ndarray, visitor: np.ndarray, mask: int, reach: int, radius: int = RADIUS, done: list | None = None):
    """Index pairs (home, visitor) whose fingerprints differ in ``radius`` bits or fewer, if they differ in ``reach`` or fewer under the mask.

    A vantage-point tree made on the way: home fingerprints fall into rings around a vantage point, and visitors enter the
    rings that the triangle bound leaves; first by the bits of the mask, where those are all equal by all bits. done:
    gets the number of comparisons.
    """
    todo = [(np.arange(len(home)), np.arange(len(visitor)), np.uint64(mask), reach)]
    while todo:
        h, v, bits, reach = todo.pop()
        if not len(h) or not len(v):
            continue
        if len(h) > LEAF:
            point = home[h[len(h) // 2]]
            to_home = np.bitwise_count((home[h] ^ point) & bits)
            if (to_home == to_home[0]).all():
                if bits != ALL:
                    todo.append((h, v, ALL, radius))
                    continue
            else:
                to_visitor = np.bitwise_count((visitor[v] ^ point) & bits).astype(np.int64)
                if done is not None:
                    done.append(len(h) + len(v))
                order_h, order_v = np.argsort(to_home, kind="stable"), np.argsort(to_visitor, kind="stable")
                at_h, at_v = np.searchsorted(to_home[order_h], np.arange(66)), np.searchsorted(to_visitor[order_v], np.arange(66))
                for ring in np.flatnonzero(np.diff(at_h)).tolist():
                    own = v[order_v[at_v[max(0, ring - reach)] : at_v[min(65, ring + reach + 1)]]]
                    todo.append((h[order_h[at_h[ring] : at_h[ring + 1]]], own, bits, reach))
                continue
        step = max(1, 1_000_000 // len(h))
        if done is not None:
            done.append(len(h) * len(v))
        own = home[h]
        for k in range(0, len(v), step):
            x, y = np.nonzero(np.bitwise_count(visitor[v[k : k + step], None] ^ own) <= radius)
            if len(x):
                yield h[y], v[k + x]


def _search(parts: list[tuple[int, int]], first: list[int], radius: int):
    """Links within each shard, reduced to a spanning forest for every batch of visitors."""

    def links(home: np.ndarray, visitor: np.ndarray, part: int):
        mask, reach = parts[part]
        ids = np.concatenate([home, visitor]).view(np.int64)
        held, size = [], 0

        def forest():
            h, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            used, ends = np.unique(np.concatenate([h, v + len(home)]), return_inverse=True)
            a, b = star_edges(ends[: len(h)], ends[len(h) :], ids[used])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for h, v in near_pairs(home, visitor, mask, reach, radius):
            live = home[h] != visitor[v]
            held.append((h[live], v[live]))
            size += int(live.sum())
            if size > 1 << 20:
                yield forest()
                held, size = [], 0
        if size:
            yield forest()

    def search(batches):
        for shard, group in groups(batches, "shard"):
            part, home, whole = int(np.searchsorted(first, shard, side="right") - 1), [], None
            for batch in group:
                for role, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    own = np.frombuffer(payload, "<u8")
                    if role == 0:
                        home.append(own)
                        continue
                    if not home:
                        continue
                    if whole is None:
                        whole = np.concatenate(home)
                        yield from links(whole, whole, part)
                    yield from links(whole, own, part)
            if whole is None and home:
                whole = np.concatenate(home)
                yield from links(whole, whole, part)

    return search


def fingerprint_components(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Components of distinct fingerprints (fp: long) whose Hamming distance is ``radius`` or less: (id, component) of linked ones.

    Fingerprints are cut into three parts; of two within 4 bits one part differs in no more than its radius (1, 1 or 0),
    since otherwise they differ in 2 + 2 + 1 bits; other radii likewise. Each part has a vantage-point tree over a bounded sample of the
    fingerprints, whose leaves are the shards.
    """
    spark = fingerprints.sparkSession
    sample = fingerprints.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toArrow().column("fp").to_numpy().view(np.uint64)
    trees = trees_of(sample, fingerprints.count(), radius)
    first = np.cumsum([0, *(t.leaves for t in trees[:-1])]).tolist()
    parts = [(int(t.mask), t.radius) for t in trees]
    sent = fingerprints.select("fp").mapInArrow(_route(spark.sparkContext.broadcast(trees), first), "shard int, role byte, payload binary")
    links = sent.repartition("shard").sortWithinPartitions("shard", "role").mapInArrow(_search(parts, first, radius), "a long, b long")
    return components(links, reduced=True)


def _grouped(docs: DataFrame, id_column: str, text_column: str, column=None, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Tables of all rows' fingerprints (doc_id, text_hash, fp), and of each fingerprint's component and least row in it."""
    bound_batches(docs.sparkSession)
    text = F.col(text_column)
    prints = cut(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), (column or fingerprint_column)(text.cast("binary")).alias("fp")))
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    distinct = cut(prints.groupBy("fp").agg(F.min(row).alias("first")))
    linked = fingerprint_components(distinct, radius)
    named = cut(distinct.join(linked, distinct.fp == linked.id, "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    drop_cut(distinct)
    return prints, named


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Group documents whose SimHash fingerprints differ in 4 bits or fewer, directly or through others.

    Returns (doc_id, fingerprint, component_id), a row for each row of ``docs``. Null texts count as empty; texts
    without words have fingerprint zero and link like any other; a null id stands in no component (null) but its
    fingerprint still links; repeated rows come back repeated; an empty table gives no rows. Columns other than the
    two are not read. Copies share one fingerprint and are searched once; no link between different fingerprints is
    lost, since what a ball overlaps is decided by triangle bounds alone.
    """
    prints, named = _grouped(docs, id_column, text_column)
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    by_print = named.join(smallest, "component").select(F.col("fp").alias("key"), F.col("smallest.doc_id").alias("smallest"))
    return prints.join(by_print, prints.fp == by_print.key).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("smallest")).alias("component_id")
    )


def _leaders(batches):
    """Of each group's texts, by id, those that are not alike to one that stayed before."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for _, part in groups(batches, "group"):
        stay: list[np.ndarray] = []
        for batch in part:
            rows = []
            for component, least, text_hash, blob in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                own = np.frombuffer(blob, "<u8")
                if not any(alike(own, x, NEAR) for x in stay):
                    stay.append(own)
                    rows.append((component, least, text_hash, blob))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["component", "least", "text_hash", "shingles"])


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less their near-duplicates, with their columns.

    Near-duplicates share NEAR of their distinct shingles of NEAR_SHINGLE words. Candidates are texts whose fingerprints,
    here those of their distinct words, lie within NEAR_RADIUS bits, directly or through others; of each such component
    texts go by their smallest id, and one that is alike to a text that stayed goes, so that each group keeps its
    smallest. Components of many texts are dealt to several groups first and their leaders meet afterwards.

    Rows are judged one by one: rows with one id and different texts go by their texts, of equal rows one stays. Rows
    with a null id stay and make nothing go. Null and empty texts are near-duplicates of each other. An empty table gives
    no rows.
    """
    prints, named = _grouped(docs, "doc_id", "text", words_fingerprint_column, NEAR_RADIUS)
    texts = prints.where("doc_id is not null").groupBy("fp", "text_hash").agg(F.min("doc_id").alias("least"))
    texts = cut(texts.join(named.select(F.col("fp").alias("of"), "component"), F.col("fp") == F.col("of")).select("component", "text_hash", "least"))
    size = texts.groupBy(F.col("component").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    sized = cut(texts.join(size, F.col("component") == F.col("of")).select("component", "text_hash", "least", "n"))
    single = sized.where("n = 1").select("least", "text_hash")
    several = sized.where("n > 1").select("component", F.col("text_hash").alias("of_hash"), "least", "n")
    held = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(several, (F.col("id") == F.col("least")) & (F.xxhash64("text") == F.col("of_hash")))
    parts = F.ceil(F.col("n") / TOGETHER)
    group = F.xxhash64("component", F.pmod("of_hash", parts))
    schema = "component long, least long, text_hash long, shingles binary"
    dealt = held.select(group.alias("group"), "component", "least", F.col("of_hash").alias("text_hash"), shingles_column(F.col("text").cast("binary")).alias("shingles"))
    order = ("group", "least", "text_hash")
    leaders = cut(dealt.repartition("group").sortWithinPartitions(*order).mapInArrow(_leaders, schema))
    again = leaders.select(F.col("component").alias("group"), "component", "least", "text_hash", "shingles")
    final = again.repartition("group").sortWithinPartitions(*order).mapInArrow(_leaders, schema)
    kept = cut(single.unionByName(final.select("least", "text_hash")).distinct().select(F.col("least").alias("__kept"), F.col("text_hash").alias("__hash")))
    for df in (texts, sized, leaders):
        drop_cut(df)
    again = prints.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    nameless = docs.where("doc_id is null")
    same = lambda left: (left["doc_id"].cast("long") == F.col("__kept")) & (F.xxhash64(left["text"]) == F.col("__hash"))
    if again.isEmpty():
        return docs.join(kept, same(docs)).select(*(docs[c] for c in docs.columns)).unionByName(nameless)
    # Repeated rows: the one whose other columns have the least hash stays.
    marked = kept.join(again.withColumn("__again", F.lit(True)), (F.col("__kept") == F.col("doc_id")) & (F.col("__hash") == F.col("text_hash")), "left").select("__kept", "__hash", "__again")
    once = docs.join(marked, same(docs)).select(*(docs[c] for c in docs.columns), "__kept", "__hash", "__again")
    nth = F.row_number().over(Window.partitionBy("__kept", "__hash").orderBy(F.xxhash64(*docs.columns)))
    single = once.where("__again is null").select(*docs.columns)
    return single.unionByName(once.where("__again").withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)).unionByName(nameless)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; see :func:`near_duplicates` for nulls, empties, repeats and empty tables."""
    return near_duplicates(table(spark, sf_dir, "documents"))
