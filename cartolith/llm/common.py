"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts define it; ``bytes.split()`` splits at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that is unset on one machine, as in tests, a temporary folder takes its place; on a cluster it must be set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cartolith-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Rows of whole texts that travel to a Python worker at once.
BATCH_ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, in the JVM and in the workers; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def tidy() -> None:
    """Give memory that this worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(f):
    """A function of batches that leaves no freed memory behind."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and return the table: lineage ends here.

    What a lost executor had is read again from the table instead of being computed again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cartolith-tables/{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cartolith-tables/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            with contextlib.suppress(Exception):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the undirected links ``i``-``j``."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (before == label).all():
            break
        live = label[i] != label[j]
        i, j = i[live], j[live]
    return label


def star_edges(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links ``i``-``j``, as links from each node to its tree's first node."""
    label = roots(i, j, len(ids))
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[own]], ids[own]


def _forest(batches):
    for batch in batches:
        a, b = (np.asarray(batch.column(k)) for k in (0, 1))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = star_edges(at[: len(a)], at[len(a) :], ids)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def components(edges: DataFrame, reduced: bool = False) -> DataFrame:
    """Connected components of ``edges`` (a, b: long), as (id, component), component being its smallest id.

    Contraction: every node hooks onto its smallest neighbour, pointers are jumped, links are renamed to what
    their ends hook onto, and what is left goes into the next round, so that the links shrink geometrically.
    Everything stays in tables of the shared folder; a node's links meet only in a partial minimum.
    ``reduced``: the links come as spanning forests already, and are not reduced once more in the stage that makes them,
    which keeps one Python worker to a task. Nodes without links are not returned. Null ends and self-links are ignored; no links give no rows.
    """
    forest = lambda df: df.mapInArrow(_forest, "a long, b long")
    own = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    live = cut(own if reduced else forest(own))
    spent, steps = [live], []
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up"))
        hook = cut(hook)
        spent.append(hook)
        for _ in range(3):
            over = hook.select(F.col("id").alias("mid"), F.col("up").alias("top"))
            hook = hook.join(over, F.col("up") == F.col("mid"), "left").select("id", F.coalesce("top", "up").alias("up"))
        hook = cut(hook)
        steps.append(hook)
        at = lambda name: hook.select(F.col("id").alias(name), F.col("up").alias(f"{name}_up"))  # noqa: B023, E731
        live = live.join(at("a"), "a").join(at("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).where("a <> b")
        live = cut(forest(live).distinct())
        spent.append(live)
    if not steps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = steps[0].select("id", F.col("up").alias("component"))
    for step in steps[1:]:
        over = step.select(F.col("id").alias("mid"), F.col("up").alias("top"))
        out = out.join(over, F.col("component") == F.col("mid"), "left").select("id", F.coalesce("top", "component").alias("component"))
    out = cut(out)
    for df in [*spent, *steps]:
        drop_cut(df)
    return out


def slice_hashes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """A 64-bit hash of each slice of the bytes; slices are not empty, ascend and don't overlap. Worked out in pieces of ``step``."""
    out = np.empty(len(starts), np.uint64)
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(flat), step)), len(starts)))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        n = sizes[a:b]
        before = np.cumsum(n) - n
        at = np.arange(int(n.sum()))
        offset = at - np.repeat(before, n)
        terms = _powers(int(n.max()))[offset]
        terms *= flat[offset + np.repeat(starts[a:b], n)].astype(np.uint64) + np.uint64(1)
        out[a:b] = np.add.reduceat(terms, before)
    x = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def distinct_slices(raw: bytes, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Each slice's place among the distinct ones, and the number of a slice that stands for each; compared by hash, then by bytes."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    lead = order[new]
    same = bool((sizes[lead][place] == sizes).all())
    for a in range(0, len(starts) if same else 0, step):
        n, own = sizes[a : a + step], starts[a : a + step]
        at = np.arange(int(n.sum())) + np.repeat(own - (np.cumsum(n) - n), n)
        if (flat[at] != flat[at + np.repeat(starts[lead[place[a : a + step]]] - own, n)]).any():
            same = False
            break
    if not same:  # two share a hash: group all by their bytes
        numbers: dict[bytes, int] = {}
        place = np.fromiter((numbers.setdefault(raw[x : x + m], len(numbers)) for x, m in zip(starts.tolist(), sizes.tolist())), np.int64, len(starts))
        _, lead = np.unique(place, return_index=True)
    return place, lead


def groups(batches, key: str):
    """Rows of a partition sorted by ``key``, as (key, iterator over record batches) without holding a group."""
    state = {"batch": None, "it": iter(batches)}

    def fill() -> bool:
        while state["batch"] is None or state["batch"].num_rows == 0:
            try:
                state["batch"] = next(state["it"])
            except StopIteration:
                return False
        return True

    def rows(k):
        while fill():
            batch = state["batch"]
            keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
            n = int(np.searchsorted(keys, k, side="right"))
            if n == 0:
                return
            state["batch"] = batch.slice(n)
            yield batch.slice(0, n)
            if n < len(keys):
                return

    while fill():
        k = state["batch"].column(state["batch"].schema.get_field_index(key))[0].as_py()
        part = rows(k)
        yield k, part
        for _ in part:
            pass
