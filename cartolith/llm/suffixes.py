"""Suffix dedup of 50-byte strings: difference-cover samples first, then one bucket of the remaining suffixes at a time.

Suffixes are compared to a depth of 50 bytes, so a suffix can tie with another only if the cover sample at one offset
under the period ties too: two equal suffixes have, wherever they stand, a common offset at which both are in the
cover, and there the samples of 20 bytes are equal. So the samples (6 of 31 positions) are sorted first, and only
suffixes with a tying sample ahead go on to be sorted, one bucket at a time, by their bytes to their full depth. Samples
stand for themselves as hashes, which may only let more suffixes through; whether one ties, not its rank, is what the
suffixes need of it, since no comparison goes beyond the depth. A block first drops what it holds more than once, by hash
and then by bytes. Suffixes travel as their bytes: those that follow each other and share the least sample of their depth
go to one bucket as one string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, groups, table, tidied, tidy
from .substrings import _pack, _unpack, mixed

#: Depth of comparison; the cover's period and residues, every difference of two positions being one of two residues.
DEPTH, PERIOD, COVER = 50, 31, (1, 5, 11, 24, 25, 27)
SAMPLE = DEPTH - PERIOD + 1
#: Text bytes in a block and dealt at once, buckets for each shuffle partition, bits of a sample's key.
BLOCK, DEAL, BUCKETS, SAMPLE_BITS = 16 << 20, 48 << 20, 2, 36

ORACLE_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM b WHERE len(h) >= 100)),
firsts AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, i FROM win JOIN firsts USING (s) WHERE d < win.doc_id),
edge AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM hit),
run AS (SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, r),
piece AS (
    SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, z,
        row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM span),
kept AS (
    SELECT piece.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || max(CASE WHEN last = 1 THEN substr(h, 2 * z + 1) END) AS k,
        sum(z - a) AS removed, count(*) AS spans
    FROM piece JOIN b USING (doc_id) GROUP BY piece.doc_id)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id)
"""


def window_hashes(flat: np.ndarray, width: int, at: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each of the ascending positions ``at``; worked out in pieces that fit a cache."""
    out, edges = np.empty(len(at), np.uint64), np.searchsorted(at, np.arange(0, len(flat) + step, step))
    for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
        if b > a:
            out[a:b] = _hash_piece(flat[k * step : (k + 1) * step + width - 1], width)[at[a:b] - k * step]
    return mixed(out)


def _hash_piece(flat: np.ndarray, width: int) -> np.ndarray:
    base, n = 0x9E3779B97F4A7C15, len(flat) - width + 1
    power, size, out, done = flat.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        factor = np.uint64(pow(base, size, 1 << 64))
        if width & size:
            part = power[done:][:n]
            out = part.copy() if out is None else out * factor + part
            done += size
        if done == width:
            return out
        longer = power[:-size] * factor
        longer += power[size:]
        power, size = longer, size * 2


def same_strings(flat: np.ndarray, p: np.ndarray, q: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Whether the DEPTH bytes from ``p`` are those from ``q``, for each pair of positions."""
    out = np.ones(len(p), bool)
    if len(p):
        strings = np.ndarray(len(flat) - DEPTH + 1, f"V{DEPTH}", flat, strides=(1,))
        for a in range(0, len(p), step):
            x, y = (strings[at[a : a + step]].view(np.uint16).reshape(-1, DEPTH // 2) for at in (p, q))
            if not np.array_equal(x, y):
                out[a : a + step] = (x == y).all(axis=1)
    return out


def ordered_strings(flat: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings at ``at`` in which equal ones stand together, and where each begins: by hash, then by bytes."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    ties = np.flatnonzero(~new)
    differ = ties[~same_strings(flat, at[order[ties - 1]], at[order[ties]])]
    if len(differ):
        edges = np.append(np.flatnonzero(new), len(order))
        for k in np.unique(np.searchsorted(edges, differ, side="right") - 1).tolist():
            a, b = int(edges[k]), int(edges[k + 1])
            own = sorted((flat[at[x] : at[x] + DEPTH].tobytes(), x) for x in order[a:b].tolist())
            order[a:b] = [x for _, x in own]
            new[a + 1 : b] = [s != t for (s, _), (t, _) in zip(own[1:], own)]
    return order, new


def bytes_from(flat: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """The eight bytes at an offset of each suffix as numbers in the order of the bytes, zeros from DEPTH on."""
    over = max(0, offset + 8 - DEPTH)
    found = np.ndarray(len(flat) - 7, ">u8", flat, strides=(1,))[at + offset - over].astype(np.uint64)
    return found << np.uint64(8 * over) if over else found


def sorted_suffixes(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``at`` in the order of their first DEPTH bytes, and where in that order each new string begins.

    Sorted by their first bytes; groups that tie there and are not one string all through are sorted by the bytes that
    follow, until none is left. Long copies, which tie all through, are done after one comparison of their bytes.
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    key = bytes_from(flat, at, 0)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    live, offset = np.arange(len(order)), 8
    while offset < DEPTH:
        ties = live[~new[live]]
        differ = ties[~same_strings(flat, at[order[ties - 1]], at[order[ties]])]
        if not len(differ):
            break
        group = np.cumsum(new[live]) - 1
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[np.searchsorted(live, differ)]] = True
        live = live[mixed[group]]
        group = np.cumsum(new[live]) - 1
        room = (64 - int(group[-1]).bit_length()) // 8  # bytes that go into a key beside the group's number
        key = bytes_from(flat, at[order[live]], offset)
        if room < 8:
            key = (group.astype(np.uint64) << np.uint64(8 * room)) | (key >> np.uint64(64 - 8 * room))
        by_key = np.argsort(key)
        order[live], key = order[live][by_key], key[by_key]
        new[live[1:]] |= key[1:] != key[:-1]
        offset += room
    return order, new


def string_buckets(flat: np.ndarray, at: np.ndarray, buckets: int, step: int = 1 << 15) -> np.ndarray:
    """The bucket of the string at each of the ascending positions ``at``, from the least hash of the samples within it."""
    out, edges = np.empty(len(at), np.uint64), np.searchsorted(at, np.arange(0, len(flat) + step, step))
    for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
        if b > a:
            least = mixed(_hash_piece(flat[k * step : (k + 1) * step + DEPTH - 1], SAMPLE))
            for size in (1, 2, 4, 8, PERIOD - 16):
                least = np.minimum(least[:-size], least[size:])
            out[a:b] = least[at[a:b] - k * step]
    return (mixed(out) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def pack_keys(sorted_keys: np.ndarray) -> bytes:
    steps = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Block:
    """Documents that follow each other in doc_id order, and what the rounds work out of them."""

    def __init__(self, number: int, rows: list[tuple[int, int, bytes]]) -> None:
        self.number, self.keys, self.raw = number, [r[:2] for r in rows], b"".join([r[2] for r in rows])
        self.flat, self.sizes = np.frombuffer(self.raw, np.uint8), np.array([len(r[2]) for r in rows], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        fresh = [k == 0 or self.keys[k] != self.keys[k - 1] for k in range(len(rows))]
        self.rank_at = np.repeat(np.cumsum(fresh).astype(np.int32), self.sizes)

    def left(self, width: int) -> np.ndarray:
        """For every position that ``width`` bytes can start at, whether they end in the same document."""
        n = max(0, len(self.flat) - width + 1)
        ok = np.ones(n, bool)
        for end, size in zip(self.ends.tolist(), self.sizes.tolist()):
            ok[max(end - size, end - width + 1, 0) : end] = False
        return ok

    def grouped(self, at: np.ndarray, keys: np.ndarray, exact: bool = False):
        """Distinct keys in order, each position's place among them and rank, the least and greatest rank of each key.

        exact: keys are hashes of the strings at ``at``, and different strings with one hash are kept apart.
        """
        rank = self.rank_at[at]
        if not len(at):
            return keys, np.zeros(0, np.int32), rank, rank, rank
        if exact:
            order, new = ordered_strings(self.flat, at, keys)
            ordered = keys[order]
        else:
            order = np.argsort(keys)
            ordered = keys[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        place = np.empty(len(order), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        first, ranks = np.flatnonzero(new), rank[order]
        return ordered[first], place, rank, np.minimum.reduceat(ranks, first), np.maximum.reduceat(ranks, first)

    def samples(self):
        """Cover positions and their keys' groups."""
        periods = -(-self.sizes // PERIOD)
        nth = np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods)
        at = (np.repeat(self.starts, periods) + PERIOD * nth)[:, None] + np.array(COVER)
        at = at[at + SAMPLE <= np.repeat(self.ends, periods)[:, None]]
        keys = window_hashes(self.flat, SAMPLE, at) >> np.uint64(64 - SAMPLE_BITS)
        return at, self.grouped(at, keys)

    def ahead(self, samples: np.ndarray) -> np.ndarray:
        """Positions that have one of these samples at an offset under the period."""
        step = np.zeros(len(self.flat) + 1, np.int8)  # at most six samples lie within a period
        step[np.minimum(samples + 1, len(self.flat))] -= 1
        low = samples - PERIOD + 1
        step[low[low >= 0]] += 1
        step[0] += int((low < 0).sum())
        return np.cumsum(step[:-1], dtype=np.int8) > 0

    def suffixes(self, tying: list | None):
        """Positions whose suffix can tie, their hashes, and which can tie with one of another block.

        tying: the bucket bits of the samples, true for those that other blocks have.
        """
        at, (keys, place, _, first, last) = self.samples()
        if not len(at):
            return at, keys, np.zeros(0, bool)
        across, ok = bits_of(tying, keys), self.left(DEPTH)
        elsewhere = self.ahead(at[across[place]])[: len(ok)]
        at = np.flatnonzero((self.ahead(at[(first != last)[place]])[: len(ok)] | elsewhere) & ok)
        return at, window_hashes(self.flat, DEPTH, at), elsewhere[at]

    def sent(self, at: np.ndarray, place: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Of suffixes at ``at`` the first of each place, by bucket and position, as indices into ``at``; their buckets."""
        lead = np.full(int(place.max()) + 1 if len(place) else 0, -1, np.int64)
        lead[place[::-1]] = np.arange(len(at))[::-1]  # the last that is written stays
        lead = np.sort(lead[lead >= 0])
        bucket = string_buckets(self.flat, at[lead], buckets)
        order = np.argsort(bucket, kind="stable")
        return lead[order], bucket[order]


def bits_of(parts: list | None, sent: np.ndarray) -> np.ndarray:
    """The truths that buckets gave back for what a block sent."""
    out = np.zeros(len(sent), bool)
    for part in parts or []:
        lo, hi = part["lo"], part["lo"] + part["n"]
        out[lo:hi] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=part["n"]).astype(bool)
    return out


def _emitted(block: int, keys: np.ndarray, bits: int, buckets: int) -> list[tuple]:
    """Sorted distinct keys cut into buckets, which are ranges of keys: (bucket, block, place, keys, packed)."""
    width = (1 << bits) // buckets + 1
    bounds = np.searchsorted(keys, np.array([min(k * width, (1 << bits) - 1) for k in range(1, buckets)], np.uint64))
    edges = [0, *bounds.tolist(), len(keys)]
    return [(k, block, a, b - a, pack_keys(keys[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _emitted_strings(block: Block, at: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    """Suffixes by bucket and position: (bucket, block, place, suffixes, packed lengths and bytes of those in a row)."""
    rows, edges = [], [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(at)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            first = np.flatnonzero(np.diff(at[a:b], prepend=-2) != 1)
            n, starts = np.diff(np.append(first, b - a)), at[a:b][first]
            held = b"".join([block.raw[s:e] for s, e in zip(starts.tolist(), (starts + n + DEPTH - 1).tolist())])
            rows.append((int(bucket[a]), block.number, a, b - a, _pack(n.astype("<i4"), held)))
    return rows


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])
_SENT_DDL, _MARKS = "bucket int, block long, lo long, n long, keys binary", "block long, lo long, n long, bits binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _send_samples(buckets: int, most: int):
    @tidied
    def send(batches):
        for shard, part in groups(batches, "shard"):
            for block in blocks_of(shard, [p for batch in part for p in batch.column(1).to_pylist()], most):
                _, (keys, *_) = block.samples()
                yield from _table(_emitted(block.number, keys, SAMPLE_BITS, buckets), _SENT).to_batches()

    return send


def _marks_of(marks: pa.Table) -> dict[tuple[int, int], list[dict]]:
    """Marks by kind (0 of samples, 1 of suffixes) and block."""
    out: dict[tuple[int, int], list[dict]] = {}
    for row in marks.to_pylist():
        out.setdefault((row["kind"], row["block"]), []).append(row)
    return out


def _send_suffixes(buckets: int, most: int):
    def send(shard: pa.Table, marks: pa.Table) -> pa.Table:
        found, rows = _marks_of(marks), []
        if len(shard):
            for block in blocks_of(shard.column(0)[0].as_py(), shard.column(1).to_pylist(), most):
                at, keys, across = block.suffixes(found.get((0, block.number)))
                at, keys = at[across], keys[across]
                own, bucket = block.sent(at, block.grouped(at, keys, exact=True)[1], buckets)
                rows += _emitted_strings(block, at[own], bucket)
        tidy()
        return _table(rows, _SENT)

    return send


def _marked(held: list[tuple], hit: np.ndarray):
    """The truths of a bucket, for each (block, lo, n) that sent to it."""
    at = 0
    for block, lo, n in held:
        own = hit[at : at + n]
        at += n
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lo]), pa.array([n]), pa.array([np.packbits(own).tobytes()], pa.binary())], ["block", "lo", "n", "bits"])


@tidied
def _mark_samples(batches):
    """Sort one bucket: which keys other blocks have too."""
    for _, part in groups(batches, "bucket"):
        held = []
        for batch in part:
            held += list(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), (unpack_keys(x) for x in batch.column(4).to_pylist())))
        held.sort(key=lambda x: x[0])
        keys = np.concatenate([x[3] for x in held])
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        hit = np.zeros(len(keys), bool)
        hit[order] = (np.diff(np.append(np.flatnonzero(new), len(keys))) > 1)[np.cumsum(new) - 1]
        yield from _marked([x[:3] for x in held], hit)


@tidied
def _mark_suffixes(batches):
    """Sort one bucket: which suffixes blocks before have too."""
    for _, part in groups(batches, "bucket"):
        held = []
        for batch in part:
            held += list(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), (_unpack(x, "<i4", None) for x in batch.column(4).to_pylist())))
        held.sort(key=lambda x: x[0])
        flat = np.frombuffer(b"".join([x[3][1] for x in held]), np.uint8)
        n = np.concatenate([x[3][0] for x in held]).astype(np.int64)
        held = [x[:3] for x in held]
        at = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (DEPTH - 1), n)
        del n
        order, new = sorted_suffixes(flat, at)
        hit = np.zeros(len(at), bool)  # places run with the blocks, so the least place of a suffix is in its earliest block
        hit[order] = order > np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
        yield from _marked(held, hit)


_DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _finish(with_bytes: bool, buckets: int, most: int):
    def finish(shard: pa.Table, marks: pa.Table) -> pa.Table:
        found, rows = _marks_of(marks), []
        for block in blocks_of(shard.column(0)[0].as_py(), shard.column(1).to_pylist(), most) if len(shard) else []:
            at, keys, across = block.suffixes(found.get((0, block.number)))
            keys, place, rank, first, _ = block.grouped(at, keys, exact=True)
            sent, _ = block.sent(at[across], place[across], buckets)
            earlier = np.zeros(len(keys), bool)
            earlier[place[across][sent[bits_of(found.get((1, block.number)), sent)]]] = True
            gone = at[(rank > first[place]) | earlier[place]] if len(at) else at
            step = np.zeros(len(block.flat) + 1, np.int8)  # at most DEPTH windows cover a byte
            step[gone] += 1
            step[gone + DEPTH] -= 1
            cover = np.cumsum(step[:-1], dtype=np.int8) > 0
            for (missing, i), a, b in zip(block.keys, block.starts.tolist(), block.ends.tolist()):
                own = cover[a:b]
                removed = int(own.sum())
                kept = block.flat[a:b][~own].tobytes() if removed else block.raw[a:b]
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed else 0
                rows.append((None if missing == 0 else i, b - a, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        tidy()
        return _table(rows, _DONE)

    return finish


def _deal(bounds: list[int]):
    """Documents packed by range of ids, some megabytes at a time."""

    @tidied
    def deal(batches):
        held: dict[int, list] = {}
        size = 0

        def sent():
            for shard, rows in held.items():
                ids, null, texts = zip(*rows)
                blob = _pack(np.array(ids, np.int64), np.array(null, np.int8), np.array([len(t) for t in texts], np.int64), b"".join(texts), level=9)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], ["shard", "payload"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = -(1 << 63) if i is None else i
                held.setdefault(int(np.searchsorted(bounds, key, side="left")), []).append((key, i is None, text or b""))
                size += len(text or b"")
                if size >= DEAL:
                    yield from sent()
                    held, size = {}, 0
        yield from sent()

    return deal


def blocks_of(shard: int, payloads: list[bytes], most: int):
    """A range's documents in order of id, null ids first, in blocks that end between different ids."""
    rows: list[tuple[int, int, bytes]] = []
    for payload in payloads:
        ids, null, sizes, raw = _unpack(payload, np.int64, np.int8, np.int64, None)
        ends = np.cumsum(sizes).tolist()
        rows += [(0 if n else 1, i, raw[a:b]) for i, n, a, b in zip(ids.tolist(), null.tolist(), [0, *ends], ends)]
    rows.sort()
    first, size, number = 0, 0, 0
    for k in range(len(rows)):
        size += len(rows[k][2])
        if k + 1 == len(rows) or size >= most and rows[k + 1][:2] != rows[k][:2]:
            yield Block((shard << 32) + number, rows[first : k + 1])
            first, size, number = k + 1, 0, number + 1


def remove_repeats(docs: DataFrame, with_bytes: bool = False, block: int = BLOCK) -> DataFrame:
    """Remove every byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), a row for each row of ``docs``; kept is null unless
    ``with_bytes``. Strings are judged on the input. Null texts are empty, texts of under 50 bytes lose nothing; a null
    id is smaller than all others; rows with one id lose nothing to each other; an empty table gives no rows; columns
    other than doc_id and text are not read. Documents are dealt once to ranges of ids and laid out in blocks in their order;
    each round reads the same exchange, and only keys, suffixes and bits travel between; a block sends a key or suffix once however often it holds it, so that a passage of a
    third of all documents reaches its bucket once a block. A sample's key of 36 bits may collide, which only lets a
    suffix through to be sorted; suffixes are compared and sorted by all their bytes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * partitions
    binary = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bounds = binary.agg(F.percentile_approx("doc_id", [k / partitions for k in range(1, partitions)] or [1.0], 10_000).alias("b")).first().b or []
    dealt = binary.mapInArrow(_deal(sorted(set(bounds))), "shard int, payload binary").repartition(partitions, "shard")

    def marked(sent: DataFrame, kind: int) -> DataFrame:
        marks = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_mark_suffixes if kind else _mark_samples, _MARKS)
        return marks.select(F.shiftright("block", 32).cast("int").alias("shard"), F.lit(kind).alias("kind"), "block", "lo", "n", "bits")

    def beside(marks: DataFrame, f, schema: str) -> DataFrame:
        return dealt.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(f, schema)

    samples = marked(dealt.sortWithinPartitions("shard").mapInArrow(_send_samples(buckets, block), _SENT_DDL), 0)
    suffixes = marked(beside(samples, _send_suffixes(buckets, block), _SENT_DDL), 1)
    return beside(samples.unionByName(suffixes), _finish(with_bytes, buckets, block), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every row of ``documents``; see :func:`remove_repeats` for nulls, short texts, equal ids and empty tables."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
