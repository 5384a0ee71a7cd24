"""Toxic spans by a linear-chain conditional random field; marginals give document scores and offending offsets."""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from itertools import chain as chained
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import bound_batches, table, tidy

#: The fit's bounded sample: documents of either label, bytes of each and of all together; tokens in a training segment,
#: random segments of each.
SAMPLE, SAMPLE_BYTES, SAMPLE_TOTAL, SEGMENT, RANDOM = {1: 1500, 0: 3000}, 65_536, 32 << 20, 12, 8
#: Hashed features; contexts that mark a feature as toxic, and the share of them that must be of toxic documents.
FEATURES, CONTEXTS, PURITY = 1 << 18, 10, 0.98
#: Slots in which documents are counted by feature before contexts are kept of the few that may be toxic.
SPREAD = 1 << 22
#: The score of every text where the labels hold no document of one of both kinds.
UNTRAINED = 0.01
#: Remembered words in a worker; documents whose chains run side by side.
MEMORY, SIDE_BY_SIDE = 150_000, 512
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Model(NamedTuple):
    """Feature weights of the toxic tag against the other, transition log weights [from, to], and the document's logistic."""

    weights: np.ndarray
    transitions: np.ndarray
    document: np.ndarray


def features_of(word: bytes) -> list[bytes]:
    return [b"w" + word, b"4" + word[:4], b"5" + word[:5], b"6" + word[:6], b"s" + word[-3:], b"bias"]


def _slots(word: bytes) -> list[int]:
    return [zlib.crc32(f) % FEATURES for f in features_of(word)]


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def mark_tokens(documents: list[list[bytes]], toxic: list[bool]) -> list[np.ndarray]:
    """Token labels from document labels: a token of a toxic document is marked if its word or one of its stems is toxic.

    A feature is toxic if the documents and the contexts (word before and word after) that it is seen in are several and nearly all of
    toxic documents. Contexts, unlike documents, don't multiply with copies of a document.
    """
    spread = np.zeros((2, SPREAD), np.int32)  # only discards what too few toxic documents hold
    for words, label in zip(documents, toxic):
        own = [zlib.crc32(f) % SPREAD for w in {w for w in words if len(w) >= 4} for f in features_of(w)[:4]]
        if own:
            np.add.at(spread[int(label)], own, 1)
    share = [max(1, sum(x == label for x in toxic)) for label in (False, True)]
    pure = lambda clean, own: own / share[1] >= PURITY * (own / share[1] + clean / share[0])
    likely = spread[1] >= CONTEXTS
    held: dict[bytes, list[bytes]] = {}
    holds: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
    for words, label in zip(documents, toxic):
        own = set()
        for word in set(words):
            if len(word) >= 4:
                if word not in held:
                    held[word] = [f for f in features_of(word)[:4] if likely[zlib.crc32(f) % SPREAD]]
                own.update(held[word])
        for f in own:
            holds[f][label] += 1
    likely_features = {f for f, (clean, own) in holds.items() if own >= CONTEXTS and pure(clean, own)}
    held = {w: kept for w, found in held.items() if (kept := [f for f in found if f in likely_features])}
    seen: dict[bytes, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for words, label in zip(documents, toxic):
        for k, word in enumerate(words):
            if word in held:
                for f in held[word]:
                    seen[f][label].add((words[k - 1] if k else b"", words[k + 1] if k + 1 < len(words) else b""))
    bad = {f for f, (clean, own) in seen.items() if len(own) >= CONTEXTS and pure(len(clean), len(own))}
    return [np.array([label and len(w) >= 4 and any(f in bad for f in features_of(w)[:4]) for w in words], bool) for words, label in zip(documents, toxic)]


def chain(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward marginals of the toxic tag for chains laid one after the other, many side by side.

    With two tags a message is one number, the ratio of the toxic tag's weight to the other's.
    """
    t, gain = np.exp(transitions), np.exp(np.clip(emission, -30, 30))
    order = np.argsort(-lengths, kind="stable")
    first, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    live = [int(x) for x in np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")]
    forward, backward = np.empty(len(emission)), np.empty(len(emission))
    state = np.zeros(len(size))
    for k, n in enumerate(live):
        at = first[:n] + k
        state = gain[at] * ((t[0, 1] + t[1, 1] * state[:n]) / (t[0, 0] + t[1, 0] * state[:n]) if k else t[0, 1] / t[0, 0])
        forward[at] = state
    last = first + size - 1
    state = np.ones(len(size))
    for k in range(len(live)):
        n = live[k]
        at = last[:n] - k
        if k:
            g = gain[at + 1] * state[:n]
            state = (t[1, 0] + t[1, 1] * g) / (t[0, 0] + t[0, 1] * g)
        else:
            state = np.ones(n)
        backward[at] = state
    both = forward * backward
    return both / (1 + both)


def document_features(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Largest marginal, and log of the sum and mean of those over 0.5, for each document; zeros without tokens.

    Small marginals are left out of the sums, or the length alone of a long text would add up to a toxic one.
    """
    out = np.zeros((len(lengths), 3))
    full = np.flatnonzero(lengths)
    if len(full):
        at = (np.cumsum(lengths) - lengths)[full]
        total = np.add.reduceat(np.where(marginals > 0.5, marginals, 0.0), at)
        out[full] = np.stack([np.maximum.reduceat(marginals, at), np.log1p(total), total / lengths[full]], axis=1)
    return out


def _adam(start: np.ndarray, gradient, rate: float, steps: int) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


def _expected(emission: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transition counts of equally long chains (rows)."""
    n, size = emission.shape
    e = np.stack([np.zeros_like(emission), emission], axis=2)
    forward, backward = np.empty_like(e), np.zeros_like(e)
    forward[:, 0] = e[:, 0] + transitions[0]
    for k in range(1, size):
        forward[:, k] = e[:, k] + np.logaddexp(forward[:, k - 1, :1] + transitions[0], forward[:, k - 1, 1:] + transitions[1])
    for k in range(size - 2, -1, -1):
        next_ = e[:, k + 1] + backward[:, k + 1]
        backward[:, k] = np.logaddexp(next_[:, :1] + transitions[:, 0], next_[:, 1:] + transitions[:, 1])
    z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    marginal = np.exp(forward + backward - z[:, None, None])
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = np.exp(forward[:, :-1, a] + transitions[a, b] + e[:, 1:, b] + backward[:, 1:, b] - z[:, None]).sum()
    pairs[0] += marginal[:, 0].sum(axis=0)
    return marginal[:, :, 1], pairs


def fit(texts: list[bytes], toxic: list[bool], seed: int = 0) -> Model:
    """Fit the field on marked tokens (in segments), then the logistic that turns marginals into a document's score.

    Without documents of both labels there is nothing to tell toxic texts by: the model gives every text UNTRAINED, which
    is under one half, so that nothing is called toxic.
    """
    document = np.array([np.log(UNTRAINED / (1 - UNTRAINED)), 0.0, 0.0, 0.0])
    weights, transitions = np.zeros(FEATURES, np.float32), np.zeros((2, 2))
    if len(set(toxic)) < 2:
        return Model(weights, transitions, document)
    one: dict[bytes, bytes] = {}
    documents = [[one.setdefault(w, w) for w in fold_words(t)] for t in texts]
    marks, rng = mark_tokens(documents, toxic), np.random.default_rng(seed)
    words, gold = [], []
    for own, mark in zip(documents, marks):
        if not own:
            continue
        at = {int(k) // SEGMENT for k in np.flatnonzero(mark)} | {int(k) for k in rng.integers(0, -(-len(own) // SEGMENT), RANDOM)}
        for k in sorted(at):
            part = own[k * SEGMENT : (k + 1) * SEGMENT]
            if len(part) == SEGMENT or len(own) < SEGMENT:
                pad = SEGMENT - len(part)
                words += part + [b""] * pad
                gold += mark[k * SEGMENT : k * SEGMENT + len(part)].tolist() + [False] * pad
    place: dict[bytes, int] = {}
    which = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words))
    slots = np.array([_slots(w) for w in place], np.int32)
    used, at = np.unique(slots, return_inverse=True)
    at, gold = at.reshape(slots.shape).astype(np.int32)[which], np.array(gold, float).reshape(-1, SEGMENT)
    del documents, marks, words, one, place, which, slots
    tags, n = gold.astype(int), len(gold)
    counts = np.array([[((tags[:, :-1] == a) & (tags[:, 1:] == b)).sum() + (a == 0) * (tags[:, 0] == b).sum() for b in (0, 1)] for a in (0, 1)], float)

    def gradient(x: np.ndarray) -> np.ndarray:
        emission = x[:-4][at].sum(axis=1).reshape(-1, SEGMENT)
        marginal, pairs = _expected(emission, x[-4:].reshape(2, 2))
        off = np.repeat((marginal - gold).ravel(), at.shape[1])
        return np.concatenate([np.bincount(at.ravel(), off, len(used)), (pairs - counts).ravel()]) / n + 1e-5 * x

    x = _adam(np.zeros(len(used) + 4), gradient, 0.15, 80)
    weights[used], transitions = x[:-4], x[-4:].reshape(2, 2)
    model = Model(weights, transitions, document)
    found = Scorer(model).features(texts)
    scale = np.concatenate([np.ones((len(found), 1)), found], axis=1)
    y = np.array(toxic, float)
    document = _adam(document, lambda b: scale.T @ (1 / (1 + np.exp(-scale @ b)) - y) / len(y) + 1e-4 * b, 0.1, 400)
    return Model(weights, transitions, document)


class _Emissions(dict):
    """Emissions by word, worked out when first asked for."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        self[word] = found = float(sum(self.weights[k] for k in _slots(word)))
        return found


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.known = model, _Emissions(model.weights.tolist())

    def marginals(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MEMORY:
            self.known.clear()
        lengths = np.array([len(own) for own in documents], np.int64)
        emission = np.fromiter(map(self.known.__getitem__, chained.from_iterable(documents)), float, int(lengths.sum()))
        full = lengths > 0
        return (chain(emission, lengths[full], self.model.transitions) if full.any() else emission), lengths

    def features(self, texts: list[bytes]) -> np.ndarray:
        parts = [document_features(*self.marginals([fold_words(t) for t in texts[k : k + SIDE_BY_SIDE]])) for k in range(0, len(texts), SIDE_BY_SIDE)]
        return np.concatenate(parts) if parts else np.zeros((0, 3))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and the toxic spans: byte offsets in the text and the mean marginal of neighbouring tokens over 0.5."""
        marginals, lengths = self.marginals([fold_words(t) for t in texts])
        b = self.model.document
        scores = 1 / (1 + np.exp(-(b[0] + document_features(marginals, lengths) @ b[1:])))
        spans: list[list[dict]] = [[] for _ in texts]
        first = np.cumsum(lengths) - lengths
        for d in np.unique(np.searchsorted(first, np.flatnonzero(marginals > 0.5), side="right") - 1).tolist():
            while lengths[d] == 0:  # empty texts share a start
                d -= 1
            own = marginals[first[d] : first[d] + lengths[d]]
            places = [m.span() for m in re.finditer(rb"[^ ]+", texts[d].translate(_FOLD))]
            on = np.flatnonzero(own > 0.5)
            for run in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1):
                spans[d].append({"start": places[run[0]][0], "end": places[run[-1]][1], "probability": float(own[run].mean())})
        return scores, spans


@functools.lru_cache(maxsize=1)
def _scorer(broadcast_id: int, broadcast) -> Scorer:
    return Scorer(broadcast.value)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents whose crc32(doc_id as text) mod 5 is not 0, a bounded sample of them (SAMPLE, SAMPLE_BYTES).

    The sample has the documents with the smallest hashes of their ids, as many of each label as SAMPLE and half of
    SAMPLE_TOTAL allow; only their ids and sizes are collected to find it. A document labelled twice is toxic if one label
    says so; null labels and ids are left out.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).withColumnRenamed("doc_id", "labelled")
    sized = docs.select(F.col("doc_id"), F.col("text")).where("text is not null").where(F.octet_length("text") <= SAMPLE_BYTES)
    sizes = sized.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size"))
    known = sizes.join(marked, F.col("doc_id") == F.col("labelled")).select("doc_id", "label", "size", F.xxhash64("doc_id").alias("h"))
    label_of: dict[int, bool] = {}
    first = known.where("label = 1").orderBy("h", "doc_id").limit(SAMPLE[1]).unionByName(known.where("label = 0").orderBy("h", "doc_id").limit(SAMPLE[0]))
    held = {0: 0, 1: 0}
    for r in sorted(first.collect(), key=lambda r: (r.h, r.doc_id)):
        held[r.label] += r.size
        if held[r.label] <= SAMPLE_TOTAL // 2:
            label_of[r.doc_id] = bool(r.label)
    if not label_of:
        return fit([], [])
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in label_of], "wanted long")
    rows = sized.join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted"), "left_semi").select("doc_id", F.col("text").cast("binary").alias("text")).collect()
    rows = sorted({(r.doc_id, bytes(r.text)) for r in rows})
    return fit([t for _, t in rows], [label_of[i] for i, _ in rows])


_SPANS = StructType([
    StructField("score", DoubleType()),
    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("probability", DoubleType())]))),
])


def toxicity_column(spark: SparkSession, model: Model, text):
    """A column with the score of ``text`` and its toxic spans; null counts as empty."""
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    @arrow_udf(_SPANS)
    def toxicity(texts: pa.Array) -> pa.Array:
        own, scores, spans = _scorer(held.id if hasattr(held, "id") else 0, held), [], []
        for at in range(0, len(texts), SIDE_BY_SIDE):
            s, p = own.score([x or b"" for x in texts.slice(at, SIDE_BY_SIDE).to_pylist()])
            scores.append(s)
            spans += p
        tidy()
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spans, kind)], ["score", "spans"])

    return toxicity(text.cast("binary"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every whole text: (doc_id, held_out, score, predicted, spans), a row for each row of ``docs``.

    Null and empty texts have no tokens and get the logistic's score of none. A null id was never learnt from, so it
    is held out. Repeated rows score alike; without labels of both kinds every text scores UNTRAINED, which is not toxic; an
    empty table gives no rows. Columns other than doc_id and text, and of labels other than doc_id and toxic, are not read.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity_column(docs.sparkSession, train(docs, labels), F.col("text")).alias("found"))
    return scored.select("doc_id", "held_out", F.col("found.score").alias("score"), F.when(F.col("found.score") >= 0.5, 1).otherwise(0).alias("predicted"), F.col("found.spans").alias("spans"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose toxicity is under 0.5, with their columns.

    Null and empty texts have no toxic token and stay as the logistic says; null ids and repeated rows are judged by their
    text alone; without labels of both kinds, and so with an empty ``labels``, all rows stay; no rows give none.
    """
    return docs.where(toxicity_column(docs.sparkSession, train(docs, labels), F.col("text"))["score"] < 0.5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, prediction and spans of every row of ``documents``; see :func:`score_documents` for nulls, empties, repeats and unusable labels."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
