"""Brown class-based bigrams: distributed exchange clustering, smoothed class transitions and word emissions.

Texts are cut into words once, in chunks whose words are numbered; counts, clustering and scores then work on numbers. A
chunk tells a bucket of words each of its distinct words once, and the bucket answers with counts and classes in the
same order, so that nothing is looked up word by word and no table of all words is ever held in one place.
"""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, distinct_slices, drop_cut, groups, slice_hashes, table, tidied, tidy
from .substrings import _pack, _unpack

#: Classes, rounds of exchange, the smoothing added to counts.
CLASSES, ROUNDS, ADDED = 32, 8, 0.5
#: Words clustered one by one, the most frequent, and the longest such word, which bound a broadcast; all other words stand
#: in groups by their last two bytes, and each group is clustered like a word, until each word of it gets a class by its
#: own neighbours.
OWN, ENDINGS, WORD_BYTES = 8192, 256, 64
#: Text bytes in a chunk; ranges of words in which moves are decided.
CHUNK, RANGES = 8 << 20, 64
#: Ids: words, groups of endings, and the end of a text, which is also what stands before its first word.
END = OWN + ENDINGS
IDS, SIZE = END + 1, CLASSES + 1

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The group of an ending, by its two bytes as one number; words of one byte have the groups from 65,536 on.
_ENDING = np.array([zlib.crc32(bytes((a, b))) % ENDINGS for a in range(256) for b in range(256)] + [zlib.crc32(bytes((a,))) % ENDINGS for a in range(256)], np.int64)


def remainder(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Of lower-cased texts: words of each, all distinct words, their hashes, and the texts as numbers of those."""
    raw = b"\n".join(texts) + b"\n"
    flat = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(flat) + 1, np.int8)
    inside[1:] = ~_IS_SPACE[flat]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    closes = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], closes])))
    if not len(starts):
        return counts, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = slice_hashes(flat, starts, ends - starts)
    place, lead = distinct_slices(raw, flat, starts, ends - starts, hashes)
    return counts, [raw[a:b] for a, b in zip(starts[lead].tolist(), ends[lead].tolist())], hashes[lead], place


def _chunks(buckets: int):
    """Texts in chunks: (chunk, documents, words by bucket with their training counts, words of the texts as numbers)."""

    def made(number: int, ids: list, learnt: list, texts: list[bytes]):
        counts, words, hashes, stream = numbered_words(texts)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        new = np.empty(len(order), np.int32)
        new[order] = np.arange(len(order), dtype=np.int32)
        stream = new[stream]
        own = np.bincount(stream[np.repeat(np.array(learnt, bool), counts)], minlength=len(words)).astype(np.int64)
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        docs = _pack(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.int8), np.array(learnt, np.int8), counts.astype(np.int64))
        blob = b"".join([words[k] + b" " for k in order.tolist()])
        return _rows([((TaskContext.get().partitionId() << 32) + number, docs, _pack(edges, own, blob), _pack(stream))], _CHUNK, [pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    @tidied
    def chunks(batches):
        ids, learnt, texts, held, number = [], [], [], 0, 0
        for batch in batches:
            for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids.append(i)
                learnt.append(own)
                texts.append((text.as_py() or b"").lower())
                held += len(texts[-1])
                if held >= CHUNK or len(ids) >= 1 << 16:
                    yield made(number, ids, learnt, texts)
                    ids, learnt, texts, held, number = [], [], [], 0, number + 1
        if ids:
            yield made(number, ids, learnt, texts)

    return chunks


_CHUNK, _CHUNK_DDL = ["chunk", "docs", "words", "stream"], "chunk long, docs binary, words binary, stream binary"
_PART, _PART_DDL = ["bucket", "kind", "chunk", "payload"], "bucket int, kind byte, chunk long, payload binary"
_KINDS = [pa.int32(), pa.int8(), pa.int64(), pa.binary()]


def _in_steps(rows: list[tuple], names: list[str], kinds: list, step: int = 64):
    for k in range(0, len(rows), step):
        yield _rows(rows[k : k + step], names, kinds)


@tidied
def _send_words(batches):
    """A chunk's distinct words and training counts, to their buckets."""
    for batch in batches:
        for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            edges, n, blob = _unpack(payload.as_py(), np.int64, np.int64, None)
            ends = np.concatenate([[0], np.flatnonzero(np.frombuffer(blob, np.uint8) == 32) + 1])
            cuts = edges.tolist()
            rows = [(k, 1, chunk, _pack(n[a:b], blob[ends[a] : ends[b]])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield from _in_steps(rows, _PART, _KINDS)


@tidied
def _add_words(batches):
    """A bucket's words with their counts (kind 0), and for each chunk which of them it has, in its order (kind 1)."""
    for bucket, part in groups(batches, "bucket"):
        place: dict[bytes, int] = {}
        total = np.zeros(1 << 12, np.int64)
        for batch in part:
            for chunk, payload in zip(batch.column(2).to_pylist(), batch.column(3)):
                n, blob = _unpack(payload.as_py(), np.int64, None)
                words = blob.split(b" ")[:-1]
                at = np.fromiter([place.setdefault(w, len(place)) for w in words], np.int32, len(words))
                if len(place) > len(total):
                    total = np.concatenate([total, np.zeros(max(len(total), len(place) - len(total)), np.int64)])
                total[at] += n  # a chunk has a word once
                yield _rows([(bucket, 1, chunk, _pack(at), 0, 0)], [*_PART, "tokens", "words"], [*_KINDS, pa.int64(), pa.int64()])
        n = total[: len(place)]
        blob = b"".join([w + b" " for w in place])
        yield _rows([(bucket, 0, -1, _pack(n, blob), int(n.sum()), int((n > 0).sum()))], [*_PART, "tokens", "words"], [*_KINDS, pa.int64(), pa.int64()])


def _frequent(batches):
    """Of every bucket the words that may be among the OWN most frequent."""
    for batch in batches:
        for payload in batch.column(0):
            n, blob = _unpack(payload.as_py(), np.int64, None)
            words = blob.split(b" ")[:-1]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            at = np.flatnonzero((sizes <= WORD_BYTES) & (n > 1))
            least = np.partition(n[at], len(at) - OWN)[len(at) - OWN] if len(at) > OWN else 0
            at = at[n[at] >= least]
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in at.tolist()], pa.binary()), pa.array(n[at], pa.int64())], ["word", "n"])


def ids_of(blob: bytes, own: dict[bytes, int]) -> np.ndarray:
    """Ids of words, each followed by a blank: their own, or that of their ending."""
    flat = np.frombuffer(blob, np.uint8).astype(np.int64)
    ends = np.flatnonzero(flat == 32)
    sizes = np.diff(ends, prepend=-1) - 1
    ending = np.where(sizes > 1, flat[ends - 2] * 256 + flat[ends - 1], 65_536 + flat[ends - 1])
    found = np.fromiter(map(own.get, blob.split(b" ")[:-1], repeat(-1)), np.int64, len(ends))
    return np.where(found < 0, OWN + _ENDING[ending], found)


def line_of(values: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts in a row, an end before each text and after the last; and the places of the words."""
    at = np.arange(len(values)) + np.repeat(np.arange(len(counts)), counts) + 1
    line = np.full(len(values) + len(counts) + 1, end, np.int64)
    line[at] = values
    return line, at


def _learnt(docs: bytes, stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's training texts: words of each, and their numbers."""
    _, _, learnt, counts = _unpack(docs, np.int64, np.int8, np.int8, np.int64)
    (own,) = _unpack(stream, np.int32)
    mask = learnt > 0
    return counts[mask], own[np.repeat(mask, counts)]


def _count_pairs(own, buckets: int):
    @tidied
    def count(batches):
        known = {w: k for k, w in enumerate(own.value)}
        for batch in batches:
            for docs, words, stream in zip(*(batch.column(k) for k in range(3))):
                counts, numbers = _learnt(docs.as_py(), stream.as_py())
                if not len(counts):
                    continue
                _, _, blob = _unpack(words.as_py(), np.int64, np.int64, None)
                line, _ = line_of(ids_of(blob, known)[numbers], counts, END)
                keys, n = _summed(line[:-1] * IDS + line[1:], np.ones(len(line) - 1, np.int64))
                bucket = (keys // IDS) % buckets
                rows = [(b, _pack(keys[bucket == b], n[bucket == b])) for b in np.unique(bucket).tolist()]
                yield _rows(rows, ["bucket", "payload"], [pa.int32(), pa.binary()])

    return count


def _add_pairs(batches):
    for bucket, part in groups(batches, "bucket"):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in part:
            got = [_unpack(p, np.int64, np.int64) for p in batch.column(1).to_pylist()]
            keys, n = _summed(np.concatenate([keys, *(g[0] for g in got)]), np.concatenate([n, *(g[1] for g in got)]))
        yield _rows([(bucket, _pack(keys, n))], ["bucket", "payload"], [pa.int32(), pa.binary()])


def _pairs(batches):
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            keys, n = _unpack(payload, np.int64, np.int64)
            yield keys // IDS, keys % IDS, n


def _transitions(classes: np.ndarray):
    def count(batches):
        total = np.zeros(SIZE**2, np.int64)
        for a, b, n in _pairs(batches):
            total += np.bincount(classes[a].astype(np.int64) * SIZE + classes[b], n, len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])

    return count


def summed_matrix(counts: DataFrame) -> np.ndarray:
    """The matrix of classes from (code, n) rows; the driver gets a row for each pair of classes."""
    out = np.zeros(SIZE**2, np.int64)
    for r in counts.groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(SIZE, SIZE)


def transition_matrix(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    return summed_matrix(pairs.select("payload").mapInArrow(_transitions(classes), "code long, n long"))


def log_likelihood(matrix: np.ndarray) -> float:
    """What the classes add to the log likelihood of the pairs that the matrix counts."""
    log = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return log(matrix.astype(float)) - log(matrix.sum(axis=0).astype(float)) - log(matrix.sum(axis=1).astype(float))


def _neighbours(classes: np.ndarray):
    """For every word the counts of the classes before and after it, sent in ranges of words."""

    def count(batches):
        total = np.zeros(2 * IDS * SIZE, np.int64)
        for a, b, n in _pairs(batches):
            total += np.bincount(np.concatenate([b * SIZE + classes[a], (IDS + a) * SIZE + classes[b]]), np.concatenate([n, n]), len(total)).astype(np.int64)
        total = total.reshape(2, IDS, SIZE)
        for k, own in enumerate(np.array_split(np.arange(IDS), RANGES)):
            if total[:, own].any():
                yield _rows([(k, _pack(total[:, own]))], ["chunk", "payload"], [pa.int32(), pa.binary()])

    return count


def better(before: np.ndarray, after: np.ndarray, classes: np.ndarray, matrix: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """The class of each word that makes the class bigrams likeliest, the other words staying; words not moving keep theirs.

    A word's own counts are taken out of its present class before that class is judged.
    """
    size, n = SIZE, matrix.sum(axis=0).astype(float)
    own = before.sum(axis=1).astype(float)
    score = before @ np.log(matrix + ADDED) + after @ np.log(matrix + ADDED).T - 2 * own[:, None] * np.log(n + ADDED * size)
    for k in np.flatnonzero(moving & (own > 0)):
        c = classes[k]
        column, row = np.maximum(matrix[:, c] - before[k], 0) + ADDED, np.maximum(matrix[c] - after[k], 0) + ADDED
        score[k, c] = before[k] @ np.log(column) + after[k] @ np.log(row) - 2 * own[k] * np.log(max(n[c] - own[k], 0) + ADDED * size)
    out = classes.copy()
    go = moving & (own > 0)
    out[go] = score[go, :CLASSES].argmax(axis=1)
    return out


def _decide(classes: np.ndarray, matrix: np.ndarray, moving: np.ndarray):
    ranges = np.array_split(np.arange(IDS), RANGES)

    def decide(batches):
        for chunk, part in groups(batches, "chunk"):
            own = ranges[chunk]
            total = np.zeros((2, len(own), SIZE), np.int64)
            for batch in part:
                for payload in batch.column(1).to_pylist():
                    total += _unpack(payload, np.int64)[0].reshape(total.shape)
            yield _rows([(chunk, better(total[0], total[1], classes[own], matrix, moving[own]).tobytes())], ["chunk", "classes"], [pa.int32(), pa.binary()])

    return decide


def exchange(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all ids by exchange clustering over the pair counts, their matrix, and the likelihood after each round.

    Classes start by frequency rank; the end of a text is a class of its own. In a round half of the words each move to
    the class that makes the class bigrams likeliest, the others staying; all that a word needs to decide, the classes
    beside it, meets in one range of words. Words move on counts of before the round, so the round's likelihood is
    computed, and a round that lowers it is taken back and the next moves half as many words: it never falls. The driver
    gets one class for each id and one matrix of classes, both of fixed size.
    """
    classes = (np.arange(IDS) % CLASSES).astype(np.int16)
    classes[END] = CLASSES
    matrix = transition_matrix(pairs, classes)
    told, every = [log_likelihood(matrix)], 2
    for step in range(ROUNDS):
        moving = (np.arange(IDS) // CLASSES + np.arange(IDS) + step) % every == 0
        moving[END] = False
        sent = pairs.select("payload").mapInArrow(_neighbours(classes), "chunk int, payload binary")
        decided = sent.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_decide(classes, matrix, moving), "chunk int, classes binary")
        ranges, new = np.array_split(np.arange(IDS), RANGES), classes.copy()
        for row in decided.collect():
            new[ranges[row.chunk]] = np.frombuffer(row.classes, np.int16)
        if (new == classes).all():
            if step >= every:
                break
            continue
        after = transition_matrix(pairs, new)
        if log_likelihood(after) < told[-1]:
            every *= 2
        else:
            classes, matrix = new, after
            told.append(log_likelihood(after))
    return classes, matrix, told


def _count_contexts(held):
    """For every word not clustered one by one the counts of the classes before and after it, sent to its bucket (kind 2)."""

    @tidied
    def count(batches):
        own, classes = held.value
        known = {w: k for k, w in enumerate(own)}
        for batch in batches:
            for chunk, docs, words, stream in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in range(1, 4))):
                counts, numbers = _learnt(docs.as_py(), stream.as_py())
                edges, _, blob = _unpack(words.as_py(), np.int64, np.int64, None)
                ids = ids_of(blob, known)
                line, at = line_of(classes[ids].astype(np.int64)[numbers], counts, CLASSES)
                rest = ids[numbers] >= OWN
                word, at = numbers[rest].astype(np.int64) * 2 * SIZE, at[rest]
                keys, n = _summed(np.concatenate([word + line[at - 1], word + SIZE + line[at + 1]]), np.ones(2 * len(word), np.int64))
                cuts, first, rows = np.searchsorted(keys, edges * 2 * SIZE).tolist(), (edges * 2 * SIZE).tolist(), []
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        rows.append((k, 2, chunk, _pack(keys[a:b] - first[k], n[a:b])))
                yield from _in_steps(rows, _PART, _KINDS)

    return count


_ANSWER, _ANSWER_DDL = ["chunk", "bucket", "payload"], "chunk long, bucket int, payload binary"
#: What stands for a chunk where a bucket tells its words' classes, and the distinct words of each class.
WORDS, DISTINCT = -1, -2


def _decide_words(held, matrix: np.ndarray):
    """The class of every word of a bucket, and the answers to chunks: counts and classes of the words that they have.

    Kind 0 are the bucket's words and counts, kind 1 the words of each chunk, kind 2 the classes beside them there.
    """

    @tidied
    def decide(batches):
        own, classes = held.value
        known = {w: k for k, w in enumerate(own)}
        kinds_ = [pa.int64(), pa.int32(), pa.binary()]
        for bucket, part in groups(batches, "bucket"):
            n, blob, of = np.zeros(0, np.int64), b"", {}
            parts, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
            for batch in part:
                for kind, chunk, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                    if kind == 0:
                        n, blob = _unpack(payload.as_py(), np.int64, None)
                    elif kind == 1:
                        of[chunk] = payload.as_py()
                    else:
                        keys, times = _unpack(payload.as_py(), np.int64, np.int64)
                        where = _unpack(of[chunk], np.int32)[0].astype(np.int64)
                        parts.append((where[keys // (2 * SIZE)] * 2 * SIZE + keys % (2 * SIZE), times))
                        waiting += len(keys)
                        if waiting > 1 << 22:
                            parts, waiting = [_summed(np.concatenate([k for k, _ in parts]), np.concatenate([t for _, t in parts]))], 0
            keys, times = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([t for _, t in parts]))
            found = classes[ids_of(blob, known)]
            for a in range(0, len(n), 4096):
                b = min(a + 4096, len(n))
                lo, hi = np.searchsorted(keys, [a * 2 * SIZE, b * 2 * SIZE])
                beside = np.zeros((b - a) * 2 * SIZE, np.int64)
                beside[keys[lo:hi] - a * 2 * SIZE] = times[lo:hi]
                beside = beside.reshape(-1, 2, SIZE)
                found[a:b] = better(beside[:, 0], beside[:, 1], found[a:b], matrix, np.ones(b - a, bool))
            found = found.astype(np.int8)
            yield _rows([(WORDS, bucket, _pack(n, found, blob)), (DISTINCT, bucket, np.bincount(found[n > 0], minlength=SIZE).astype(np.int64).tobytes())], _ANSWER, kinds_)
            for chunk, payload in of.items():
                at = _unpack(payload, np.int32)[0]
                yield _rows([(chunk, bucket, _pack(n[at], found[at]))], _ANSWER, kinds_)

    return decide


def _by_bucket(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket", *order)


def learn(chunks: DataFrame) -> tuple[DataFrame, int, int, int]:
    """Of a table of chunks: the table of all buckets' answers, training tokens, distinct words and texts."""
    spark = chunks.sparkSession
    sent = chunks.select("chunk", "words").mapInArrow(_send_words, _PART_DDL)
    counts = cut(_by_bucket(sent, "chunk").mapInArrow(_add_words, f"{_PART_DDL}, tokens long, words long"))
    n, v = (x or 0 for x in counts.agg(F.sum("tokens"), F.sum("words")).first())
    most = counts.where("kind = 0").select("payload").mapInArrow(_frequent, "word binary, n long").orderBy(F.col("n").desc(), "word").limit(OWN)
    own = most.select("word").toArrow().column("word").to_pylist()
    pairs = chunks.select("docs", "words", "stream").mapInArrow(_count_pairs(spark.sparkContext.broadcast(own), RANGES), "bucket int, payload binary")
    pairs = cut(_by_bucket(pairs).mapInArrow(_add_pairs, "bucket int, payload binary"))
    classes, matrix, _ = exchange(pairs)
    end = int(matrix[CLASSES].sum())
    drop_cut(pairs)
    held = spark.sparkContext.broadcast((own, classes))
    beside = chunks.mapInArrow(_count_contexts(held), _PART_DDL)
    answers = cut(_by_bucket(counts.select(*_PART).unionByName(beside), "kind", "chunk").mapInArrow(_decide_words(held, matrix), _ANSWER_DDL))
    drop_cut(counts)
    return answers, n + end, v + (end > 0), end


_FOUND = pa.schema([("docs", pa.binary()), ("numbers", pa.binary()), ("codes", pa.binary())])


def _look_up(end: int):
    """The documents of a chunk with what the answers say: known words, sum of logs, and the pairs of classes."""

    def look_up(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(chunk):
            return _FOUND.empty_table()
        order = np.argsort(answers.column(1).to_numpy())
        got = [_unpack(answers.column(2)[k].as_py(), np.int64, np.int8) for k in order.tolist()]
        n, kinds = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        _, docs, stream = (chunk.column(k)[0].as_py() for k in range(3))
        *_, counts = _unpack(docs, np.int64, np.int8, np.int8, np.int64)
        (numbers,) = _unpack(stream, np.int32)
        line, _ = line_of(kinds[numbers], counts, CLASSES)
        codes = (line[:-1] * SIZE + line[1:]).astype(np.int16)
        first = np.concatenate([[0], np.cumsum(counts)])
        known, logs = (np.diff(np.concatenate([[0], np.cumsum(x[numbers])])[first]) for x in ((n > 0).astype(np.int64), np.log10(n + ADDED)))
        found = np.stack([counts + 1, known + (end > 0), logs + math.log10(end + ADDED)]).astype(float)
        tidy()
        return pa.Table.from_arrays([pa.array([docs], pa.binary()), pa.array([_pack(found)], pa.binary()), pa.array([_pack(codes)], pa.binary())], schema=_FOUND)

    return look_up


def _documents(batches):
    for batch in batches:
        for docs, numbers, codes in zip(*(batch.column(k) for k in range(3))):
            ids, null, learnt, counts = _unpack(docs.as_py(), np.int64, np.int8, np.int8, np.int64)
            yield ids, null, learnt, counts, _unpack(numbers.as_py(), float)[0].reshape(3, -1), _unpack(codes.as_py(), np.int16)[0]


def _class_pairs(batches):
    total = np.zeros(SIZE**2, np.int64)
    for _, _, learnt, counts, _, codes in _documents(batches):
        total += np.bincount(codes[np.repeat(learnt > 0, counts + 1)], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])


def _weigh(weights: np.ndarray):
    """A row for each document, with the log probability of its class pairs."""

    @tidied
    def weigh(batches):
        for ids, null, _, counts, numbers, codes in _documents(batches):
            by_class = np.add.reduceat(weights[codes], np.concatenate([[0], np.cumsum(counts + 1)[:-1]]))
            columns = [pa.array(ids, mask=null > 0), *(pa.array(numbers[k].astype(np.int64)) for k in (0, 1)), pa.array(numbers[2]), pa.array(by_class)]
            for k in range(0, len(ids), 8192):
                yield pa.RecordBatch.from_arrays([c.slice(k, 8192) for c in columns], ["doc_id", "n_tokens", "n_known", "log", "by_class"])

    return weigh


def _chunked(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    learnt = (remainder(F.col("doc_id")) != 1).alias("learnt")
    binary = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), learnt)
    return cut(binary.mapInArrow(_chunks(int(spark.conf.get("spark.sql.shuffle.partitions"))), _CHUNK_DDL))


def _words_and_classes(batches):
    for batch in batches:
        for payload in batch.column(0):
            n, kinds, blob = _unpack(payload.as_py(), np.int64, np.int8, None)
            yield pa.RecordBatch.from_arrays([pa.array(blob.split(b" ")[:-1], pa.binary()), pa.array(n), pa.array(kinds.astype(np.int32))], ["word", "n", "kind"])


def word_classes(docs: DataFrame) -> DataFrame:
    """The classes that :func:`score_documents` scores with: (word, n, class), a row for each distinct word of all texts.

    n counts a word in training texts; words never learnt (n of 0) have the class of their ending. A table without words
    gives no rows; nulls and repeated rows are treated as :func:`score_documents` says.
    """
    answers, *_ = learn(_chunked(docs))
    rows = answers.where(F.col("chunk") == WORDS).select("payload").mapInArrow(_words_and_classes, "word binary, n long, kind int")
    return rows.select("word", "n", F.col("kind").alias("class"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Base-10 log probabilities of every whole text under the class bigrams and under single words.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), a row for each row of
    ``docs``. Null and empty texts are just an end; null ids are learnt from and so not held out; equal rows score
    alike, each with a row; without training documents every count is 0; an empty table gives no rows. Columns other
    than doc_id and text are not read. All counts (words, pairs, classes, distinct words) cover all training documents;
    what the driver and the broadcasts hold (words clustered one by one, classes, matrix) is of fixed size. Words outside
    of OWN are given their classes once, after the exchange, each by its own neighbours; words never learnt have the
    class of their ending. A word costs a bucket one entry a chunk, however often the chunk has it.
    """
    chunks = _chunked(docs)
    answers, n, v, end = learn(chunks)
    shown = chunks.select("chunk", "docs", "stream").groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk"))
    found = cut(shown.applyInArrow(_look_up(end), "docs binary, numbers binary, codes binary"))
    matrix = summed_matrix(found.mapInArrow(_class_pairs, "code long, n long"))
    told = answers.where(F.col("chunk") == DISTINCT).select("payload").mapInArrow(_distinct, "code long, n long")
    distinct = np.zeros(SIZE, np.int64)
    for r in told.groupBy("code").agg(F.sum("n").alias("n")).collect():
        distinct[r.code] = r.n
    distinct[CLASSES] += end > 0
    drop_cut(chunks)
    drop_cut(answers)
    weights = np.log10((matrix + ADDED) / (matrix.sum(axis=1, keepdims=True) + ADDED * SIZE)) - np.log10(matrix.sum(axis=0) + ADDED * (distinct + 1))
    base = math.log10(n + ADDED * (v + 1))
    rows = found.mapInArrow(_weigh(weights.ravel()), "doc_id long, n_tokens long, n_known long, log double, by_class double")
    return rows.select(
        "doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log") - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("log") + F.col("by_class")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _distinct(batches):
    total = np.zeros(SIZE, np.int64)
    for batch in batches:
        for payload in batch.column(0):
            total += np.frombuffer(payload.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE), pa.int64()), pa.array(total)], ["code", "n"])


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents``; see :func:`score_documents` for nulls, empties, repeats and empty tables."""
    return score_documents(table(spark, sf_dir, "documents"))
