"""Benchmark decontamination: block-max WAND over a BM25 index of test items, then word overlap of question and answer."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import bound_batches, cut, table

#: Words in a shingle, shingle overlap of the item as a whole and of its question and answer, share of its own BM25 score.
SHINGLE, OVERLAP, PART_OVERLAP, THRESHOLD = 5, 0.8, 0.5, 0.7
#: Questions and answers of fewer words are compared by single words, or one changed word would leave nothing of them.
SHORT = 10
K1, B = 1.2, 0.75
#: Postings in a block; words in half a passage at least; text bytes that one broadcast index holds at most.
BLOCK, HALF, INDEX_BYTES = 16, 64, 16 << 20
#: Ranges of items whose largest weights all passages are tried against at once, before any posting is read, and bytes of
#: those; postings lists and items that a worker keeps unpacked.
RANGES, RANGE_BYTES, UNPACKED = 64, 16 << 20, 20_000
#: A word as :func:`fold_words` has it, for counting in the JVM.
FOLDED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """Distinct shingles; under ``size`` words are one shingle, none have none."""
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def overlap(part: set[tuple[bytes, ...]], words: list[bytes]) -> float:
    """Share of a part's shingles that the words hold; a part without words is held."""
    if not part:
        return 1.0
    return len(part & shingles(words, len(next(iter(part))))) / len(part)


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence or line is its answer, what is before it the question; one sentence is both."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) < 2:
        return text, text
    return text[: text.rstrip().rfind(parts[-1])], parts[-1]


class Totals(NamedTuple):
    """What scores need of all items: how many have words, their mean and largest number of words."""

    items: int
    mean: float
    longest: int


class Index:
    """BM25 postings of some items, each weight divided by its item's score against itself, in blocks with their maxima.

    Postings are arrays, one term's after the other's; weights come from the totals and document frequencies of all
    items, so they don't depend on which items share an index.
    """

    def __init__(self, items: list[tuple[int, str]], totals: Totals | None = None, frequency: dict[bytes, int] | None = None) -> None:
        words = [(i, fold_words(t.encode()), t) for i, t in items]
        words = [(i, w, t) for i, w, t in words if w]
        self.ids, self.texts = [i for i, _, _ in words], [t for _, _, t in words]
        if totals is None:
            totals, frequency = Totals(len(words), sum(len(w) for _, w, _ in words) / max(1, len(words)), max([0, *(len(w) for _, w, _ in words)])), Counter(x for _, w, _ in words for x in set(w))
        self.half = max(HALF, totals.longest)
        self.vocabulary = {x: k for k, x in enumerate(sorted({x for _, w, _ in words for x in w}))}
        idf = np.array([math.log(1 + (totals.items - frequency[x] + 0.5) / (frequency[x] + 0.5)) for x in self.vocabulary])
        terms, docs, weights = [], [], []
        for d, (_, w, _) in enumerate(words):
            own, n = np.unique(np.fromiter(map(self.vocabulary.__getitem__, w), np.int32, len(w)), return_counts=True)
            score = idf[own] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / totals.mean))
            terms.append(own)
            docs.append(np.full(len(own), d, np.int32))
            weights.append(score / score.sum())
        terms, docs, weights = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((terms, np.int32), (docs, np.int32), (weights, float)))
        order = np.argsort(terms, kind="stable")
        terms, self.docs, self.weights = terms[order], docs[order], weights[order]
        self.first = np.searchsorted(terms, np.arange(len(self.vocabulary) + 1))
        self.most = np.zeros(len(self.vocabulary) + 1)  # the last stands for unknown words
        np.maximum.at(self.most, terms, self.weights)
        ranges = max(1, min(RANGES, -(-len(words) // 4), RANGE_BYTES // (4 * len(self.most))))
        self.range_max = np.zeros((len(self.most), ranges), np.float32)
        np.maximum.at(self.range_max, (terms, self.docs.astype(np.int64) * ranges // max(1, len(words))), self.weights.astype(np.float32))
        self.lists: dict[int, tuple] = {}
        self.parts: dict[int, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lists": {}, "parts": {}}

    def postings(self, term: int) -> tuple[list, list, list, list]:
        """Items and weights of a term, and the largest weight and last item of each block, as lists."""
        if term not in self.lists:
            if len(self.lists) >= UNPACKED:
                self.lists.clear()
            docs, weights = (x[self.first[term] : self.first[term + 1]].tolist() for x in (self.docs, self.weights))
            blocks = range(0, len(docs), BLOCK)
            self.lists[term] = docs, weights, [max(weights[k : k + BLOCK]) for k in blocks], [docs[min(k + BLOCK, len(docs)) - 1] for k in blocks]
        return self.lists[term]

    def shingles_of(self, item: int) -> tuple:
        """Shingles of an item, its question and its answer."""
        if item not in self.parts:
            if len(self.parts) >= UNPACKED:
                self.parts.clear()
            text = self.texts[item]
            parts = [fold_words(p.encode()) for p in question_and_answer(text)]
            self.parts[item] = shingles(fold_words(text.encode())), *(shingles(p, SHINGLE if len(p) >= SHORT else 1) for p in parts)
        return self.parts[item]

    def may_reach(self, passages: np.ndarray, threshold: float) -> np.ndarray:
        """Which passages (sorted distinct terms, the rest unknown) have a range of items whose bound is high enough."""
        out = np.zeros(len(passages), bool)
        for at in range(0, len(passages), 128):
            out[at : at + 128] = self.range_max[passages[at : at + 128]].sum(axis=1).max(axis=1) >= threshold - 1e-3
        return out

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items with at least ``threshold`` of their own score for a passage of these distinct terms."""
        held = {t: self.postings(t) for t in terms}
        cursors = [[held[t][0][0], t, 0] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            tight, until = 0.0, None
            for _, t, at in cursors[: pivot + 1]:
                _, _, highest, last = held[t]
                block = bisect_left(last, doc, at // BLOCK)
                if block < len(last):
                    tight += highest[block]
                    until = min(until, last[block]) if until is not None else last[block]
            if tight < threshold:  # no item up to the end of these blocks can reach it
                beyond = (until if until is not None else doc) + 1
                if pivot + 1 < len(cursors):
                    beyond = min(beyond, cursors[pivot + 1][0])
                move, to = cursors[: pivot + 1], max(beyond, doc + 1)
            elif cursors[0][0] == doc:
                score = sum(held[t][1][at] for d, t, at in cursors[: pivot + 1] if d == doc)
                if score >= threshold:
                    found.append((doc, score))
                move, to = cursors[: pivot + 1], doc + 1
            else:
                move, to = [c for c in cursors[:pivot] if c[0] < doc], doc
            for c in move:
                docs = held[c[1]][0]
                c[2] = at = bisect_left(docs, to, c[2])
                c[0] = docs[at] if at < len(docs) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def leaks(self, texts: list[bytes], threshold: float = THRESHOLD) -> list[list[dict]]:
        """For each text the items that it holds: best passage, its score, and the overlaps there.

        A passage is two halves of ``half`` words, each half starting one, so that an item lies wholly in a passage.
        Passages whose terms' largest weights, over all items or over each range of items, don't add up to the
        threshold end there; the rest goes through WAND.
        """
        out: list[list[dict]] = [[] for _ in texts]
        if not self.ids:
            return out
        known, unknown, size = self.vocabulary.get, len(self.vocabulary), self.half
        words = [fold_words(t) for t in texts]
        blocks = np.array([-(-len(w) // size) for w in words])
        total = int(blocks.sum())
        if not total:
            return out
        terms = np.full((total + 1) * size, unknown, np.int32)
        first = np.cumsum(blocks) - blocks
        for k, own in enumerate(words):
            terms[first[k] * size : first[k] * size + len(own)] = np.fromiter(map(known, own, repeat(unknown)), np.int32, len(own))
        terms = terms.reshape(-1, size)
        doc = np.append(np.repeat(np.arange(len(texts)), blocks), -1)
        best: dict[tuple[int, int], dict] = {}
        for at in range(0, total, 8192):
            stop = min(at + 8192, total)
            after = terms[at + 1 : stop + 1].copy()
            after[doc[at + 1 : stop + 1] != doc[at:stop]] = unknown
            passage = np.sort(np.concatenate([terms[at:stop], after], axis=1), axis=1)
            weight = self.most[passage]
            again = np.zeros(passage.shape, bool)
            again[:, 1:] = passage[:, 1:] == passage[:, :-1]
            weight[again] = 0
            passage[again] = unknown
            live = np.flatnonzero(weight.sum(axis=1) >= threshold - 1e-9)
            for k in live[self.may_reach(passage[live], threshold)]:
                distinct = [int(t) for t in np.unique(passage[k]) if t != unknown]
                hits = self.search(distinct, threshold)
                if not hits:
                    continue
                d = int(doc[at + k])
                begin = (at + k - int(first[d])) * size
                own = words[d][begin : begin + 2 * size]
                for item, score in hits:
                    overall, question, answer = (overlap(p, own) for p in self.shingles_of(item))
                    if overall >= OVERLAP and min(question, answer) >= PART_OVERLAP:
                        row = {"item_id": self.ids[item], "passage": int(begin // size), "score": float(score), "overlap": overall, "question_overlap": question, "answer_overlap": answer}
                        old = best.get((d, item))
                        if old is None or (row["overlap"], row["score"]) > (old["overlap"], old["score"]):
                            best[d, item] = row
        for (d, _), row in sorted(best.items()):
            out[d].append(row)
        return out


_FIELDS = ("item_id", "passage", "score", "overlap", "question_overlap", "answer_overlap")
_LEAK = ArrayType(StructType([StructField(n, LongType() if k < 2 else DoubleType()) for k, n in enumerate(_FIELDS)]))


def _words_of_items(batches):
    """Distinct words of items, with the number of their shard."""
    for batch in batches:
        for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = sorted(set(fold_words(text.encode())))
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(own), pa.int32()), pa.array(own, pa.binary())], ["shard", "word"])


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES):
    """Indexes of all items with a text, one after the other, each over ``index_bytes`` of item text at most, or one item.

    Items beyond that bound are dealt by size to several indexes, of which the driver makes, and workers hold, one at a
    time. Totals and document frequencies are aggregates over all items, so that scores don't depend on the dealing.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    n = F.regexp_count("text", F.lit(FOLDED_WORD))
    items = items.withColumn("n", n).where("n > 0")
    count, mean, longest, held = items.agg(F.count(F.lit(1)), F.avg("n"), F.max("n"), F.sum(F.octet_length("text"))).first()
    totals = Totals(count, mean or 0.0, longest or 0)
    shards = max(1, -(-2 * (held or 0) // index_bytes)) if (held or 0) > index_bytes else 1
    dealt = items.select(F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"), "item_id", "text")
    words = dealt.select("shard", "text").mapInArrow(_words_of_items, "shard int, word binary")
    frequency = words.groupBy("word").count()
    if shards > 1:
        frequency, words = cut(frequency), cut(words.distinct())
    for k in range(shards):
        own = sorted((r.item_id, r.text) for r in dealt.where(F.col("shard") == k).select("item_id", "text").collect())
        known = frequency if shards == 1 else frequency.join(words.where(F.col("shard") == k).select("word"), "word", "left_semi")
        table_ = known.toArrow()
        yield Index(own, totals, dict(zip(table_.column("word").to_pylist(), table_.column("count").to_pylist())))


def _leaks_of(spark: SparkSession, index: Index, text):
    """A column with the leaks of ``text`` in one index, an array of structs: item_id, passage, score, overlaps."""
    kind = pa.list_(pa.struct([(n, pa.int64() if k < 2 else pa.float64()) for k, n in enumerate(_FIELDS)]))
    held = spark.sparkContext.broadcast(index)

    @arrow_udf(_LEAK)
    def leaks(texts: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(texts), 512):
            found += held.value.leaks([x or b"" for x in texts.slice(at, 512).to_pylist()])
        return pa.array(found, kind)

    return leaks(text.cast("binary"))


def leaks(docs: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Test items that documents hold: (doc_id, item_id, passage, score, overlap, question_overlap, answer_overlap).

    A row for each item that a row of ``docs`` holds; no document is shuffled, an index being broadcast within its bound.
    Null and empty texts and items hold nothing; null ids and repeated rows are searched like others; items that are
    equal are all found; an empty table gives no rows; columns other than doc_id, item_id and text are not read. With
    several indexes the documents are read once for each, and what is found is written before the next is made.
    """
    spark = items.sparkSession
    bound_batches(spark)
    out, waiting = None, None
    for index in indexes(items, index_bytes):
        if waiting is not None:
            out = cut(waiting) if out is None else out.unionByName(cut(waiting))
        waiting = docs.select("doc_id", F.explode(_leaks_of(spark, index, F.col("text"))).alias("leak")).select("doc_id", "leak.*")
    return waiting if out is None else out.unionByName(cut(waiting))


def clean_documents(docs: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns.

    Null and empty texts hold nothing and stay; null ids and repeated rows are judged by their own text; without items all
    rows stay. With several indexes, what one leaves is written before the next is made.
    """
    spark = items.sparkSession
    bound_batches(spark)
    first = True
    for index in indexes(items, index_bytes):
        docs, first = (docs if first else cut(docs)).where(F.size(_leaks_of(spark, index, F.col("text"))) == 0), False
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` held by every row of ``documents``; see :func:`leaks` for nulls, empties, repeats and empty tables."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
