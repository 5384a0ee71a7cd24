"""Substring dedup by super-k-mers: windows of words that share a minimiser travel packed to its bucket."""

from __future__ import annotations

import hashlib
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bound_batches, groups, table, tidied

#: Words in a window, and in the pieces of which a window's smallest hash is its minimiser.
WINDOW, PIECE = 35, 5
#: Windows in one packed string at most, text bytes that are worked on at once, and buckets for each shuffle partition.
RUN, CHUNK, BUCKETS = 256, 4 << 20, 12

ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM split WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS j FROM win WHERE n > 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS j FROM split),
kept AS (
    SELECT word.doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY word.j) AS t
    FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j WHERE gone.j IS NULL GROUP BY word.doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that scatters 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.full(n, base | 1, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words follow each other with one byte between."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))
    terms = (flat.astype(np.uint64) + np.uint64(1)) * powers(int((ends - starts).max()) + 1)[at]
    terms[ends] = 0
    return mixed(np.add.reduceat(terms, starts))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def rolled(x: np.ndarray, width: int) -> np.ndarray:
    """An order-dependent hash of every ``width`` consecutive hashes."""
    n = len(x) - width + 1
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(powers(width, 0xD1B54A32D192ED03)):
        out += x[k : k + n] * p
    return mixed(out)


def super_kmers(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first word, windows, minimiser) of every run of windows that share a minimiser.

    counts: words of each document; hashes: of all their words in order. first word counts from the chunk's start.
    """
    if len(hashes) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    low = sliding_min(rolled(hashes, PIECE), WINDOW - PIECE + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    window = np.flatnonzero(np.arange(len(low)) + WINDOW <= (first + counts)[doc[: len(low)]])
    low, doc = low[window], doc[window]
    new = np.ones(len(window), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    began = np.flatnonzero(new)
    length = np.diff(np.append(began, len(window)))
    parts = -(-length // RUN)
    at = np.repeat(began, parts) + RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.minimum(at + RUN, np.repeat(began + length, parts))
    return doc[at], window[at], stop - at, low[at]


def _pack(*parts, level: int = 3) -> bytes:
    """Arrays and byte strings, one after the other, compressed."""
    raw = b"".join(struct.pack("<q", len(x)) + x for x in (p if isinstance(p, bytes) else p.tobytes() for p in parts))
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _unpack(blob: bytes, *kinds) -> list:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        (n,) = struct.unpack_from("<q", raw, at)
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8) if kind else raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


_SENT = [("bucket", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())]
_SENT_DDL = "bucket int, kind byte, payload binary"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chunks(batches):
    """(ids, text hashes, lists of words) of documents that have a window, some megabytes at a time."""
    ids, hashes, words, held = [], [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = (text or b"").split()
            if len(own) < WINDOW:
                continue
            ids.append(i)
            hashes.append(_signed(xxhash.xxh64_intdigest(text, 42)))
            words.append(own)
            held += len(text)
            if held >= CHUNK:
                yield ids, hashes, words
                ids, hashes, words, held = [], [], [], 0
    if ids:
        yield ids, hashes, words


def _sender(buckets: int):
    @tidied
    def send(batches):
        for ids, hashes, words in _chunks(batches):
            whole = b" ".join(b" ".join(w) for w in words) + b" "
            flat = np.frombuffer(whole, np.uint8)
            ends = np.flatnonzero(flat == 32)
            starts = np.concatenate([[0], ends[:-1] + 1])
            counts = np.array([len(w) for w in words])
            doc, word, windows, low = super_kmers(counts, word_hashes(flat, starts, ends))
            first = (np.cumsum(counts) - counts)[doc]
            texts = [whole[a:b] for a, b in zip(starts[word].tolist(), ends[word + windows + WINDOW - 2].tolist())]
            # Strings that the chunk holds more than once are known to repeat here and now: one goes on for all.
            place: dict[bytes, int] = {}
            group = np.fromiter((place.setdefault(t, len(place)) for t in texts), np.int64, len(texts))
            copies = np.bincount(group, minlength=len(place))
            _, one = np.unique(group, return_index=True)
            again = copies[group] > 1
            id_of, hash_of = np.array([-1 if x is None else x for x in ids]), np.array(hashes)
            bucket = (low % np.uint64(buckets)).astype(np.int32)
            out: list[tuple[int, int, bytes]] = []
            if again.any():
                own = np.flatnonzero(again)
                lo = word[own] - first[own]
                out.append((int(hash_of[0]) % buckets, 1, _pack(id_of[doc[own]], hash_of[doc[own]], (lo << 32) + lo + windows[own] + WINDOW - 1)))
            order = one[np.argsort(bucket[one], kind="stable")]
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                lo = (word[own] - first[own]).astype(np.int64)
                n = np.where(again[own], -windows[own], windows[own]).astype(np.int32)
                out.append((int(bucket[own[0]]), 0, _pack(id_of[doc[own]], hash_of[doc[own]], lo, n, b" ".join([texts[k] for k in own]) + b" ")))
            for k in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out[k : k + 256]), _SENT)], [n for n, _ in _SENT])

    return send


def _repeated(whole: bytes, starts: np.ndarray, ends: np.ndarray, window: np.ndarray, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which windows occur more than once: sorted by hash, runs of equal hashes compared byte by byte."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = np.flatnonzero(sorted_keys[1:] == sorted_keys[:-1])
    out = known.copy()
    if not len(same):
        return out
    a, b = starts[window[order]], ends[window[order] + WINDOW - 1]
    at, end = a.tolist(), b.tolist()
    equal = np.fromiter((whole[at[k] : end[k]] == whole[at[k + 1] : end[k + 1]] for k in same.tolist()), bool, len(same))
    good = same[equal]
    out[order[good]] = True
    out[order[good + 1]] = True
    for key in np.unique(sorted_keys[same[~equal]]):  # different windows with one hash
        own = np.arange(np.searchsorted(sorted_keys, key), np.searchsorted(sorted_keys, key, side="right"))
        texts = [whole[at[k] : end[k]] for k in own]
        n = Counter(texts)
        out[order[own]] |= np.array([n[t] > 1 for t in texts])
    return out


def _runs(mask: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end positions of runs of true values within a record."""
    before = np.concatenate([[False], mask[:-1] & (record[1:] == record[:-1])])
    after = np.concatenate([mask[1:] & (record[1:] == record[:-1]), [False]])
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


@tidied
def _count(batches):
    """Sort and count each bucket's windows; give back the runs of repeated ones as word ranges of their documents."""
    kinds = [("id", pa.int64()), ("hash", pa.int64()), ("range", pa.int64())]
    made = lambda *c: pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(c, kinds)], [n for n, _ in kinds])
    for _, part in groups(batches, "bucket"):
        held = []
        for batch in part:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == 1:
                    yield made(*_unpack(payload, np.int64, np.int64, np.int64))
                else:
                    held.append(_unpack(payload, np.int64, np.int64, np.int64, np.int32, None))
        if not held:
            continue
        ids, hashes, lo, n = (np.concatenate([x[k] for x in held]) for k in range(4))
        whole = b"".join(x[4] for x in held)
        held.clear()
        known, n = n < 0, np.abs(n).astype(np.int64)
        flat = np.frombuffer(whole, np.uint8)
        ends = np.flatnonzero(flat == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        words = n + WINDOW - 1
        record = np.repeat(np.arange(len(n)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = np.repeat(np.cumsum(words) - words, n) + nth
        keys = rolled(word_hashes(flat, starts, ends), WINDOW)[window]
        mask = _repeated(whole, starts, ends, window, keys, known[record]) & ~known[record]
        a, b = _runs(mask, record)
        if len(a):
            k = record[a]
            begin = lo[k] + nth[a]
            yield made(ids[k], hashes[k], (begin << 32) + begin + (b - a) + WINDOW - 1)


_KEPT = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType()), StructField("kept_sha256", StringType())])


def kept_words(text: bytes, ranges: np.ndarray) -> tuple[int, int, bytes]:
    words = text.split()
    if not len(ranges):
        return len(words), 0, b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, ranges >> 32, 1)
    np.add.at(step, ranges & 0xFFFFFFFF, -1)
    keep = np.cumsum(step[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join([w for w, k in zip(words, keep.tolist()) if k])


@arrow_udf(_KEPT)
def _kept_column(text: pa.Array, ranges: pa.Array) -> pa.Array:
    out = []
    for x, r in zip(text.to_pylist(), ranges):
        n, removed, kept = kept_words(x or b"", np.asarray(r.values) if r.is_valid else np.zeros(0, np.int64))
        out.append((n, removed, kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
    n, removed, kept, digest = zip(*out) if out else ((), (), (), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())], ["n_words", "n_removed", "kept_text", "kept_sha256"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(id, hash, range) of the repeated windows of docs (id: long, text: binary); range packs first and end word."""
    spark = docs.sparkSession
    bound_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.mapInArrow(_sender(BUCKETS * partitions), _SENT_DDL)
    return sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, "id long, hash long, range long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove every word covered by a window of 35 words that also starts anywhere else.

    Returns (doc_id, n_words, n_removed, kept_text, kept_sha256), a row for each row of ``docs``. Windows are judged on
    the input. Null texts have no words; texts of under 35 words lose none; of rows with one id each is judged by its
    own text (repeated rows repeat each other's windows and lose them all, as do rows with a null id); an empty table
    gives no rows; columns other than doc_id and text are not read. A chunk's equal strings are merged before they
    travel, so that a passage that a third of all documents hold reaches its bucket once a chunk.
    """
    binary = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    ranges = repeated_ranges(binary).groupBy("id", "hash").agg(F.collect_set("range").alias("ranges"))
    ranges = ranges.select(F.col("id").alias("range_id"), F.col("hash").alias("range_hash"), "ranges")
    own = binary.withColumn("hash", F.xxhash64("text"))
    joined = own.join(ranges, (F.coalesce("id", F.lit(-1)) == F.col("range_id")) & (F.col("hash") == F.col("range_hash")), "left")
    return joined.select(F.col("id").alias("doc_id"), _kept_column("text", "ranges").alias("kept")).select("doc_id", "kept.*")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every row of ``documents``; see :func:`remove_repeats` for nulls, short texts, repeats and empty tables."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
