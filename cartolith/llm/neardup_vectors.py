"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, groups, star_edges, table, tidy
from .substrings import _pack, _unpack

THRESHOLD = 0.95
#: Pivots that name cells at most, found in a sample of so many vectors; vectors and bytes of vectors in a group, and
#: vectors in a tree.
PIVOTS, SAMPLE, GROUP, GROUP_BYTES, TREE = 256, 8192, 16_384, 16 << 20, 2048
#: Radii of the cover trees' levels, each half of the one before; unit vectors lie within 2 of each other.
RADII = (2.0, 1.0, 0.5, 0.25, 0.125)
#: Points whose distances to the rest of their cell are worked out at once.
TOGETHER = 64

ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT links.b, reach.root FROM reach JOIN links ON reach.id = links.a),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def reach(threshold: float) -> float:
    """Distance of unit vectors at the threshold's angle, a little rounded up."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(units: np.ndarray, own: np.ndarray, radius: float) -> tuple[list[int], np.ndarray]:
    """Centres over ``radius`` apart among the rows ``own``, the first one of them, and which centre each row is within it of.

    Distances are worked out from a few rows at a time to those that no centre covers yet.
    """
    centres, of, least = [], np.full(len(own), -1), 1 - radius * radius / 2
    left = np.arange(len(own))
    while len(left):
        first = min(TOGETHER, len(left))
        near = units[own[left[:first]]] @ units[own[left]].T >= least
        free = np.ones(len(left), bool)
        for k in range(first):
            if free[k]:
                near[k, k] = True
                covered = near[k] & free
                of[left[covered]] = len(centres)
                centres.append(int(own[left[k]]))
                free &= ~covered
        left = left[free]
    return centres, of


class CoverTree:
    """Nested nets of unit vectors: a level's centres lie over its radius apart within their parent's cell and cover their members within it.

    ``levels`` has, from the coarsest on, the centres (rows of the vectors), each one's parent in the level above, and
    its covering radius, which is the distance to the farthest vector below it. A cell's own centre is its first centre
    in the level below. The last level is the vectors themselves.
    """

    def __init__(self, units: np.ndarray) -> None:
        self.units, self.narrow, n = units, units.astype(np.float32), len(units)
        centres, member = np.zeros(min(1, n), np.int64), np.zeros(n, np.int64)
        self.levels = [(centres, np.zeros(len(centres), np.int64), self._cover(centres, member))]
        for radius in RADII[1:]:
            order = np.argsort(member, kind="stable")
            bounds = np.searchsorted(member[order], np.arange(len(centres) + 1))
            sizes = np.diff(bounds)
            new, parent, of, made = [centres[sizes == 1]], [np.flatnonzero(sizes == 1)], np.empty(n, np.int64), int((sizes == 1).sum())
            of[order[bounds[:-1][sizes == 1]]] = np.arange(made)
            for k in np.flatnonzero(sizes > 1).tolist():
                own = order[bounds[k] : bounds[k + 1]]
                own = np.concatenate([[centres[k]], own[own != centres[k]]])
                found, within = net(units, own, radius)
                new.append(np.array(found))
                parent.append(np.full(len(found), k))
                of[own] = within + made
                made += len(found)
            centres, member = np.concatenate(new), of
            self.levels.append((centres, np.concatenate(parent), self._cover(centres, member)))
        self.levels.append((np.arange(n), member, np.zeros(n)))

    def _cover(self, centres: np.ndarray, member: np.ndarray) -> np.ndarray:
        apart = self.units - self.units[centres[member]]
        cover = np.zeros(len(centres))
        np.maximum.at(cover, member, np.sqrt((apart * apart).sum(axis=1)))
        return cover


def dual(a: CoverTree, b: CoverTree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of two trees with cosine at least ``threshold``.

    Both trees are descended together; a pair of nodes stays only if its centres are no farther apart than both covering
    radii and the threshold's distance. Levels that hardly split further are passed over. Only the last level decides, by
    the cosine in double precision; above, single precision with a margin only prunes.
    """
    far, live, last = reach(threshold), np.ones((1, 1), bool), len(a.levels) - 1
    up_a, up_b, seen = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    for k, ((ca, pa_, ra), (cb, pb, rb)) in enumerate(zip(a.levels, b.levels)):
        if k:
            up_a, up_b = up_a[pa_], up_b[pb]
        if k < last and len(ca) * len(cb) < 2 * seen:
            continue
        seen = len(ca) * len(cb)
        rows, columns = np.flatnonzero(live.any(axis=1)[up_a]), np.flatnonzero(live.any(axis=0)[up_b])
        if not len(rows) or not len(columns):
            return rows[:0], columns[:0]
        above = live[up_a[rows]][:, up_b[columns]]
        if k < last:
            cosine = a.narrow[ca[rows]] @ b.narrow[cb[columns]].T
            bound = (ra[rows, None] + (rb[columns] + far)[None, :]).astype(np.float32)
            bound *= bound
            keep = cosine >= np.where(bound < 4, 1 - bound / 2 - 1e-5, -2)
            live = np.zeros((len(ca), len(cb)), bool)
            live[np.ix_(rows, columns)] = above & keep
            up_a, up_b = np.arange(len(ca)), np.arange(len(cb))
        else:
            x, y = np.nonzero(above & (a.units[rows] @ b.units[columns].T >= threshold))
            return rows[x], columns[y]


def units_of(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(float)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    ends = np.asarray(column.offsets)
    values, n = np.asarray(column.values), np.diff(ends)
    if len(n) and (n == size).all():
        return values[ends[0] : ends[-1]].reshape(-1, size)
    out = np.zeros((len(n), size), values.dtype)
    for k in range(len(n)):
        out[k, : n[k]] = values[ends[k] : ends[k + 1]]
    return out


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cells(pivots, size: int):
    def cells(batches):
        for batch in batches:
            apart = distances(units_of(_matrix(batch.column(1), size)), pivots.value)
            cell = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(cell)), cell])], ["cell", "apart"])

    return cells


def grouped_cells(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """First group and number of groups of each cell, and the cells of each group; groups have about ``most`` vectors.

    Small cells that follow each other share a group, a larger one is dealt to several of its own.
    """
    first, parts, members, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), [], most + 1
    for k, n in enumerate(counts.tolist()):
        if n > most:
            first[k], parts[k] = len(members), -(-n // most)
            members += [[k]] * int(parts[k])
            held = most + 1
            continue
        if held + n > most:
            members.append([])
            held = 0
        first[k], held = len(members) - 1, held + n
        members[-1].append(k)
    return first, parts, members


def _route(pivots, cover: np.ndarray, counts: np.ndarray, most: int, size: int, threshold: float):
    """A vector goes to the pairs of its own group with each group that the covering radii of its cells let it link with."""
    first, parts, members = grouped_cells(counts, most)
    far, n = reach(threshold), len(members)
    cells, edges = np.concatenate(members).astype(np.int64), np.cumsum([0, *map(len, members)])[:-1]

    def route(batches):
        for batch in batches:
            nodes, copies, vectors = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2), size)
            apart = distances(units_of(vectors), pivots.value)
            cell = apart.argmin(axis=1)
            home = first[cell] + np.asarray(batch.column(3)) % parts[cell]
            may = np.logical_or.reduceat((apart <= cover + far)[:, cells], edges, axis=1)
            may[np.arange(len(home)), home] = True
            row, other = np.nonzero(may)
            pair = np.minimum(home[row], other) * n + np.maximum(home[row], other)
            role = (home[row] > other).astype(np.int8)
            order = np.lexsort((role, pair))
            row, pair, role = row[order], pair[order], role[order]
            begins = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (role[1:] != role[:-1])])) if len(row) else np.zeros(0, int)
            rows, vectors = [], vectors.astype("<f8" if vectors.dtype == np.float64 else "<f4")
            for a, b in zip(begins.tolist(), [*begins.tolist()[1:], len(row)]):
                at = row[a:b]
                rows.append((int(pair[a]), int(role[a]), _pack(nodes[at], copies[at], cell[at], vectors[at], level=1)))
            for k in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 16]), (pa.int64(), pa.int8(), pa.binary()))], ["pair", "role", "payload"])

    return route


def _join(kind: str, groups_: int, size: int, threshold: float):
    """Dual traversal of the cover trees of one group with those of the other, or with each other."""

    def load(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, CoverTree]]]:
        parts = [_unpack(p, np.int64, np.int64, np.int64, kind) for p in payloads]
        nodes, copies, cell, flat = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.argsort(cell, kind="stable")
        units = units_of(flat.reshape(-1, size)[order])
        return nodes[order], copies[order], [(a, CoverTree(units[a : a + TREE])) for a in range(0, len(units), TREE)]

    def found(a: np.ndarray, b: np.ndarray, nodes: np.ndarray, copies: np.ndarray):
        """Links between rows: copies linked to each row, and a spanning forest."""
        n = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
        own = np.flatnonzero(n)
        x, y = star_edges(a, b, nodes)
        blank = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), blank, pa.array(n[own].astype(np.int64))], ["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.zeros(len(x), np.int64))], ["a", "b", "n"])

    def joined(pair: int, one: list[bytes], two: list[bytes]):
        same = pair // groups_ == pair % groups_
        if not one or not (same or two):
            return
        left = load(one)
        right = left if same else load(two)
        nodes, copies = (left[k] if same else np.concatenate([left[k], right[k]]) for k in (0, 1))
        shift, held, size_ = 0 if same else len(left[0]), [], 0
        for a, tree in left[2]:
            for b, other in right[2]:
                if same and b < a:
                    continue
                x, y = dual(tree, other, threshold)
                if same and a == b:
                    x, y = x[x < y], y[x < y]
                held.append((x + a, y + b + shift))
                size_ += len(x)
                if size_ > 1 << 21:
                    yield from found(*(np.concatenate([h[k] for h in held]) for k in (0, 1)), nodes, copies)
                    held, size_ = [], 0
        if size_:
            yield from found(*(np.concatenate([h[k] for h in held]) for k in (0, 1)), nodes, copies)

    def join(batches):
        for pair, part in groups(batches, "pair"):
            sides: tuple[list, list] = [], []
            for batch in part:
                for role, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    sides[role].append(payload)
            yield from joined(pair, *sides)
        tidy()

    return join


def pivots_of(sample: np.ndarray) -> np.ndarray:
    """The finest level of a cover tree over the sample that has PIVOTS centres at most, filled up from the next.

    They come in the order of the tree, so that those under one parent follow each other.
    """
    tree = CoverTree(sample)
    at = max(k for k, (c, _, _) in enumerate(tree.levels) if len(c) <= PIVOTS)
    chosen = tree.levels[at][0]
    if at + 1 < len(tree.levels):
        finer, parent, _ = tree.levels[at + 1]
        fresh = ~np.isin(finer, chosen)
        finer, parent = finer[fresh][: PIVOTS - len(chosen)], parent[fresh][: PIVOTS - len(chosen)]
        chosen = np.concatenate([chosen, finer])[np.argsort(np.concatenate([np.arange(len(chosen)), parent]), kind="stable")]
    return sample[chosen]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Vectors linked by a cosine of at least ``threshold``: (vec_id, n_links, component_id, kept), a row for each row.

    Equal vectors are one node with a count of copies, which adds to links without a pair being made. Nodes fall into
    cells around pivots (the top of a cover tree over a bounded sample), and cells into groups. A node meets another group
    only where the covering radius of one of its cells leaves a link possible, and goes there as one row of a packed batch
    for each pair of groups; in a pair, cover trees are traversed together. Links leave it as counts and a spanning
    forest, never as all pairs. n_links counts the other rows that a row's vector links with. Vectors that are null,
    empty or zero or hold null or non-finite components, and those with a null vec_id, link with nothing; shorter
    vectors count as filled up with zeros; rows that share a vec_id stand in one component, whatever their vectors; an
    empty table gives no rows; columns other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("usable", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    nodes = rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # The numbers of nodes are fixed by the table that is written here.
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "least", "copies", "embedding"))
    size = nodes.agg(F.max(F.size("embedding"))).first()[0]
    if size is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    sample = nodes.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample
    pivots = spark.sparkContext.broadcast(pivots_of(units_of(_matrix(sample, size))))
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    dealt = nodes.select("node", "embedding").mapInArrow(_cells(pivots, size), "cell int, apart double")
    found = {r.cell: (r.n, r.cover) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("cover")).collect()}
    counts = np.array([found.get(k, (0, 0))[0] for k in range(len(pivots.value))], np.int64)
    cover = np.array([found.get(k, (0, -10.0))[1] for k in range(len(pivots.value))]) + 1e-9
    most = max(TREE, min(GROUP, GROUP_BYTES // (8 * size)))
    total = len(grouped_cells(counts, most)[2])
    salted = nodes.select("node", "copies", "embedding", F.pmod(F.xxhash64("node"), F.lit(1 << 30)).alias("salt"))
    sent = salted.mapInArrow(_route(pivots, cover, counts, most, size, threshold), "pair long, role byte, payload binary")
    links = sent.repartition("pair").sortWithinPartitions("pair", "role").mapInArrow(_join("<f8" if kind == "double" else "<f4", total, size, threshold), "a long, b long, n long")
    links = cut(links)
    edges = links.where("b is not null").select("a", "b")
    seen = F.xxhash64("embedding")
    twice = rows.where("usable").groupBy("vec_id").agg(F.min(seen).alias("low"), F.max(seen).alias("high")).where("low <> high").select(F.col("vec_id").alias("again"))
    if not twice.isEmpty():
        shared = rows.where("usable").join(twice, F.col("vec_id") == F.col("again"), "left_semi")
        shared = cut(shared.join(nodes.select("node", F.col("embedding").alias("key")), F.col("embedding") == F.col("key")).select("vec_id", "node"))
        edges = edges.unionByName(shared.join(shared.groupBy("vec_id").agg(F.min("node").alias("a")), "vec_id").select("a", F.col("node").alias("b")).where("a <> b"))
    linked = links.where("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    of = components(edges)
    placed = cut(nodes.select("node", "least").join(of, F.col("node") == F.col("id"), "left").select("node", "least", F.coalesce("component", "node").alias("component")))
    root = placed.groupBy("component").agg(F.min("least").alias("root"))
    named = placed.join(root, "component").select(F.col("node").alias("of"), "root").join(linked, F.col("of") == F.col("a"), "left")
    named = nodes.select("node", "copies", F.col("embedding").alias("key")).join(named, F.col("node") == F.col("of"))
    named = named.select("key", "root", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    out = rows.join(named, F.col("usable") & (F.col("embedding") == F.col("key")), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every row of ``embeddings``; see :func:`near_duplicates` for nulls, ties, repeats and empty tables."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
