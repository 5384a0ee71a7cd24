"""Every corpus operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeated
rows and columns whose names clash with the operators' own."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from cartolith.llm import brown, decontaminate, licenses, mixing, neardup_vectors, simhash, substrings, suffixes, tokens, toxicity
from cartolith.llm.common import components

CLASH = ("hash", "shard", "fp", "size", "key", "taken", "block", "bucket", "score", "range", "weight", "component", "n", "label", "wanted", "id")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASH)])


def words(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["the", "Of", "and", "in", "röt", "blue", "hill", "stone", "river", "cloud", "tree%d" % rnd.randint(0, 30)]) for _ in range(n))


def texts():
    shared, out = words(60, 99), []
    for k in range(40):
        out.append((k, words(20 + 7 * (k % 9), k) + (" " + shared if k % 6 == 0 else ""), ["a", "b", None, "c"][k % 4]))
    out += [(50, out[3][1], "a"), (51, out[3][1] + " extra", "b"), (52, None, "a"), (53, "", None), (54, " \n\t ", "b"), (55, "one", "c"), (56, "a  b   c \n\n d", "a")]
    out += [(60, words(5000, 7), "big"), (61, "x" * 3000, "b"), (61, "x" * 3000, "b"), (None, out[5][1], "a"), (None, None, None), (62, shared.upper(), "a")]
    out += [(63, "Released under the MIT License. The MIT license and GNU General Public License, version 3.", "a"), (64, "<|endoftext|> it's  licensed under the Apache License, Version 2.0", "b")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, *(["z"] * len(CLASH))) for r in texts()], SCHEMA).repartition(3)
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def split(text):
    return (text or "").encode().split()


def test_simhash(docs, empty):
    def fingerprint(text):
        w = split(text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    own = [(i, fingerprint(t)) for i, t, _ in texts()]
    label = list(range(len(own)))
    for _ in own:
        label = [min(label[j] for j in range(len(own)) if (own[i][1] ^ own[j][1]).bit_count() <= 4) for i in range(len(own))]
    smallest = {k: min(own[j][0] for j in range(len(own)) if label[j] == k and own[j][0] is not None) for k in set(label)}
    expected = sorted(((i, f"{f:016x}", None if i is None else smallest[label[k]]) for k, (i, f) in enumerate(own)), key=repr)
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.near_duplicates(empty).count() == 0


def scattered(n, seed):
    """Fingerprints of which some differ in few bits."""
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    for k in range(n // 2, n):
        fp[k] = fp[k - n // 2] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    return np.unique(fp)


def test_simhash_tree_finds_all_within_radius():
    fp = scattered(3000, 3)
    tree = simhash.VantageTree(fp[::3], (1 << 22) - 1, 1, 60)
    assert tree.leaves > 30
    rows, leaf = tree.leaves_of(fp, 0)
    home = dict(zip(rows.tolist(), leaf.tolist()))
    assert len(home) == len(fp) == len(rows)
    visits = collections.defaultdict(set)
    for r, n in zip(*(x.tolist() for x in tree.leaves_of(fp, 1))):
        visits[r].add(n)
    near = np.bitwise_count((fp[:, None] ^ fp) & np.uint64((1 << 22) - 1)) <= 1
    assert all(home[j] in visits[i] for i, j in zip(*(x.tolist() for x in np.nonzero(near))))


def test_simhash_parts_cover_the_radius():
    for radius in range(12):
        parts = simhash.parts_of(radius)
        assert sum(r + 1 for _, _, r in parts) > radius and sorted(b for s, n, _ in parts for b in range(s, s + n)) == list(range(64))


@pytest.mark.parametrize("fold", [0, 40])
def test_simhash_pairs_in_a_shard(fold):
    fp = np.unique(scattered(2500, 5) >> np.uint64(fold))  # folded: crowded together
    for radius in (4, 6):
        near = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(fp[:, None] ^ fp) <= radius)))}
        found = set()
        for shift, bits, reach in simhash.parts_of(radius):
            for h, v in simhash.near_pairs(fp, fp, ((1 << bits) - 1) << shift, reach, radius):
                found |= set(zip(h.tolist(), v.tolist()))
        assert found == near


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 256)
    fp = scattered(4000, 6)
    label = np.arange(len(fp))
    near = [np.flatnonzero(np.bitwise_count(fp ^ x) <= 4) for x in fp]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    signed = fp.view(np.int64)
    least = {k: int(signed[label == k].min()) for k in set(label.tolist()) if (label == k).sum() > 1}
    got = {r.id: r.component for r in simhash.fingerprint_components(spark.createDataFrame([(int(x),) for x in signed], "fp long").repartition(3)).collect()}
    assert got == {int(x): least[k] for x, k in zip(signed, label.tolist()) if k in least}


def test_simhash_comparisons_grow_less_than_the_square():
    count = []
    for n in (16_000, 64_000):
        fp, total = scattered(n, 8), []
        for tree in simhash.trees_of(fp[:: max(1, len(fp) // 8000)], len(fp) * 16):  # shards of 1,024
            rows, leaf = tree.leaves_of(fp, 0)
            home = np.empty(len(fp), np.int64)
            home[rows] = leaf
            rows, visit = tree.leaves_of(fp, tree.radius)
            rows, visit = rows[visit >= home[rows]], visit[visit >= home[rows]]
            order = np.argsort(visit, kind="stable")
            at = np.searchsorted(visit[order], np.arange(tree.leaves + 1))
            for k in range(tree.leaves):
                for _ in simhash.near_pairs(fp[home == k], fp[rows[order[at[k] : at[k + 1]]]], int(tree.mask), tree.radius, done=total):
                    pass
        count.append(sum(total))
    assert math.log(count[1] / count[0], 4) < 1.5 and count[1] < 0.05 * 64_000**2


def plain_distinct(data):
    """Texts by smallest id: one whose shingles are 0.8 those of a text that stayed goes, if a chain of close fingerprints links them."""
    first = {}
    for i, t in data:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    own = sorted((i, xxhash.xxh64_intdigest(repr(t)), t) for t, i in first.items())
    shown = [split(t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for _, _, t in own]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in shown]

    def bits(w):
        h = [xxhash.xxh64_intdigest(x, 42) for x in set(w)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp, label = [bits(w) for w in shown], list(range(len(own)))
    for _ in own:
        label = [min(label[j] for j in range(len(own)) if (fp[i] ^ fp[j]).bit_count() <= 6) for i in range(len(own))]
    stay = []
    for k in range(len(own)):
        same = lambda j: len(grams[k] & grams[j]) >= 0.8 * len(grams[k] | grams[j])  # noqa: E731, B023
        if not any(label[j] == label[k] and same(j) for j in stay):
            stay.append(k)
    return {own[k][0] for k in stay}


def test_distinct_documents_are_those_of_a_plain_version(docs, empty):
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns and simhash.distinct_documents(empty).count() == 0
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(plain_distinct([(i, t) for i, t, _ in texts()]))
    assert kept.where("doc_id is null").count() == 2


@pytest.mark.parametrize("together", [1024, 5])
def test_near_copies_go(spark, monkeypatch, together):
    """Edited copies go and other texts stay, also where a group is dealt to several tasks."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rnd, data = random.Random(12), []
    for k in range(60):
        own = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(60, 200))]
        data.append((k, " ".join(own)))
        for n in range(20 if k == 0 else 1):
            for at in rnd.sample(range(len(own)), max(1, len(own) // 100)):
                data.append((100 + 100 * k + n, " ".join([*own[:at], "edited", *own[at + 1 :]])))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in simhash.distinct_documents(docs).collect()}
    assert set(range(60)) <= got and len(got - set(range(60))) <= 0.05 * (len(data) - 60)
    assert together < 1024 or got == plain_distinct(data)


def test_distinct_documents_judges_rows(spark):
    long, other = words(200, 1), words(200, 2)
    data = [(5, long, "a"), (5, other, "a"), (3, long, "b"), (5, other, "a"), (5, other, "b"), (None, long, "a"), (None, long, "a"), (9, None, "a"), (10, "", "a")]
    docs = spark.createDataFrame(data, "doc_id long, text string, fp string").repartition(3)
    got = [simhash.distinct_documents(docs.repartition(k)).collect() for k in (1, 4)]
    assert sorted(map(repr, got[0])) == sorted(map(repr, got[1]))
    assert sorted(((r.doc_id, r.text) for r in got[0]), key=repr) == sorted([(3, long), (5, other), (None, long), (None, long), (9, None)], key=repr)
    assert simhash.distinct_documents(docs.where("false")).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: min(y for y in parent if find(y) == find(x)) for x in parent}


def test_substrings(docs, empty):
    own = [(i, split(t)) for i, t, _ in texts()]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in own for k in range(len(w) - 34))
    expected = []
    for i, w in own:
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        expected.append((i, len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest()))
    assert rows(substrings.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=repr)
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("block", [2_000, 6 << 20])
def test_suffixes(docs, empty, block):
    own = [(i, (t or "").encode()) for i, t, _ in texts()]
    rank = lambda i: (i is not None, i or 0)
    first = {}
    for i, b in own:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, rank(i)), rank(i))
    expected = []
    for i, b in own:
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < rank(i):
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        expected.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = suffixes.remove_repeats(docs, block=block)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)
    assert suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("block", [suffixes.BLOCK, 1])
def test_suffixes_that_tie_by_hash_only(spark, block):
    one, two, rest = "mlkqklplliooipnj", "nnojooknorlkqklp", "the same thirty-four bytes of both."[:34]
    both = np.frombuffer((one + rest + two + rest).encode(), np.uint8)
    assert len(set(suffixes.window_hashes(both, 50, np.array([0, 50])).tolist())) == 1
    data = [(1, one + rest + "A"), (2, two + rest + "B"), (3, "C" + one + rest), (4, two + rest + "D")]
    got = suffixes.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), with_bytes=True, block=block)
    assert rows(got, "doc_id", "n_removed", "kept") == [(1, 0, data[0][1].encode()), (2, 0, data[1][1].encode()), (3, 50, b"C"), (4, 50, b"D")]


def test_suffixes_are_sorted_by_their_bytes():
    rnd = random.Random(3)
    for letters, n in (("ab", 3000), ("a", 300), ("abcdefghijklmnop\x00\xff", 5000)):
        raw = "".join(rnd.choice(letters) for _ in range(n)).encode("latin-1")
        raw += raw[: n // 2] + raw[n // 3 : n // 2]
        at = np.array(sorted(rnd.sample(range(len(raw) - 49), min(2000, len(raw) - 49))))
        order, new = suffixes.sorted_suffixes(np.frombuffer(raw, np.uint8), at)
        strings = [raw[p : p + 50] for p in at[order].tolist()]
        assert strings == sorted(strings) and new.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def test_cover_has_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    sizes = collections.defaultdict(int)
    for _, t, s in texts():
        sizes[s] += len(split(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = {s: weight[s] for s in order if s not in capped}
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(free.values()) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert len(got) == len(texts())
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and math.isclose(r.target, target[s]) and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 1
    assert rows(mixing.mix(docs.repartition(5)), "doc_id", "size", "taken") == rows(mixing.mix(docs), "doc_id", "size", "taken")
    assert mixing.mix(empty).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    copies = collections.Counter((r.doc_id, r.source, len(split(r.text))) for r in whole.collect())
    want = collections.Counter()
    for r in got:
        if r.taken:
            want[r.doc_id, r.source, r.size] += -(-r.taken // r.size)
    assert copies == want


def test_tokens(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    order = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    encoded = {t or "": np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t, _ in order}
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_file(docs).collect()))
    at, expected = 0, []
    for start, i, n, crc in got:
        assert start == at
        at += n
        expected.append((i, n, crc))
    assert [i for i, _, _ in expected] == [r[0] for r in order]
    assert sorted(expected, key=repr) == sorted(((i, len(encoded[t or ""]), zlib.crc32(encoded[t or ""].tobytes())) for i, t, _ in order), key=repr)
    tokens.write_tokens(docs, str(tmp_path / "t"))
    one = tokens.read_tokens(spark, str(tmp_path / "t"), with_ids=True, doc_id=7).collect()
    assert [r.ids for r in one] == [encoded[dict((i, t) for i, t, _ in texts())[7]].tolist()]
    assert tokens.token_file(empty).count() == 0


def test_encoder_matches_the_tokenizer():
    from tokenizers import Tokenizer

    own, tokenizer = tokens.Encoder(tokens.tokenizer_path()), Tokenizer.from_file(tokens.tokenizer_path())
    rnd = random.Random(5)
    odd = ["a  b", "a \n b", "a\n\n b", "　x y", " a", " ", "a ", "", "it's we'll", "x.y, z!?", "é ü\xa0 x", "́a b́c ٣", "<|endoftext|> q", "a.\nB c", "a\n b"]
    odd += ["x\n \ny", "'s 'S a,'s b.'ll\n're", "€, a€,b é,c é, ß.", "word,,, word,abc 12,3 x1,2"]
    odd += ["".join(rnd.choice("ab .,'\n\té1-s!€\u3000\u0301") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    odd += ["".join(chr(rnd.choice([rnd.randint(32, 126), 10, 32, rnd.randint(128, 0x2FFF)])) for _ in range(rnd.randint(1, 60))) for _ in range(2000)]
    for k in range(0, len(odd), 300):
        for text, ids in zip(odd[k : k + 300], own.encode_all([t.encode() for t in odd[k : k + 300]])):
            assert np.frombuffer(ids, own.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_tells_pieces_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(tokens, "slice_hashes", lambda flat, starts, sizes: np.zeros(len(starts), np.uint64))
    own = tokens.Encoder(tokens.tokenizer_path())
    for text in ("one two, three\none two.", "é one"):
        assert np.frombuffer(own.encode(text), own.kind).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_of_a_hot_id(spark):
    data = [(None if k % 3 else k, f"text {k} of many") for k in range(300)] + [(7, f"seven {k}") for k in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = sorted(tokens.token_file(docs).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((i is not None, i or 0) for i, _ in data)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_brown(docs, empty):
    order = texts()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    token = [[*split(t and t.encode().lower().decode()), None] for _, t, _ in order]
    count = collections.Counter(w for own, (i, _, _) in zip(token, order) if not held(i) for w in own)
    n, v = sum(count.values()), len(count)
    expected = [(i, held(i), len(own), sum(count[w] > 0 for w in own), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)) for own, (i, _, _) in zip(token, order)]
    got = brown.score_documents(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r.score < 0 for r in got)
    assert brown.score_documents(empty).count() == 0


def test_brown_scores_are_those_of_its_classes(docs):
    """The classes are the operator's; transitions, emissions and scores are worked out anew."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    table = brown.word_classes(docs).collect()
    kind = {bytes(r.word): r["class"] for r in table}
    token = [(i, held(i), [None, *split(t and t.encode().lower().decode()), None]) for i, t, _ in texts()]
    kind[None] = brown.CLASSES
    assert set(kind) == {w for _, _, own in token for w in own}
    pair, into, count = collections.Counter(), collections.Counter(), collections.Counter()
    for _, out, own in token:
        if not out:
            count.update(own[1:])
            for a, b in zip(own, own[1:]):
                pair[kind[a], kind[b]] += 1
                into[kind[b]] += 1
    left = collections.Counter()
    for (a, _), n in pair.items():
        left[a] += n
    distinct = collections.Counter(kind[w] for w in count)
    assert {bytes(r.word): r.n for r in table} == {w: count[w] for w in kind if w is not None}
    size = brown.CLASSES + 1
    expected = []
    for i, _, own in token:
        total = 0.0
        for a, b in zip(own, own[1:]):
            c, d = kind[a], kind[b]
            total += math.log10((pair[c, d] + 0.5) / (left[c] + 0.5 * size)) + math.log10((count[b] + 0.5) / (into[d] + 0.5 * (distinct[d] + 1)))
        expected.append((i, len(own) - 1, round(total, 5)))
    got = [(r.doc_id, r.n_tokens, round(r.score, 5)) for r in brown.score_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_brown_likelihood_never_falls(spark, monkeypatch):
    told, own, rnd = [], brown.exchange, random.Random(2)
    monkeypatch.setattr(brown, "exchange", lambda pairs: told.append(own(pairs)) or told[-1])
    data = [(k, " ".join(f"{'ab'[k % 2]}{rnd.randint(0, 60)}" for _ in range(60))) for k in range(200)]
    brown.word_classes(spark.createDataFrame(data, "doc_id long, text string")).count()
    classes, matrix, rounds = told[0]
    assert len(rounds) > 2 and rounds == sorted(rounds) and rounds[-1] == brown.log_likelihood(matrix)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    data = [b"a bb a\tccc", b"", b" \n", b"bb  dd"]
    for hashes in (brown.slice_hashes, lambda flat, starts, sizes: np.zeros(len(starts), np.uint64)):
        monkeypatch.setattr(brown, "slice_hashes", hashes)
        counts, known, _, stream = brown.numbered_words(data)
        assert counts.tolist() == [4, 0, 0, 2] and len(set(known)) == 4
        assert [known[k] for k in stream.tolist()] == [w for t in data for w in t.split()]


def test_brown_learns_classes(spark):
    """Two tongues that never mix: the class bigrams must beat single words on held-out texts."""
    rnd = random.Random(2)
    data = [(k, " ".join(f"{'ab'[k % 2]}{rnd.randint(0, 60)}" for _ in range(60))) for k in range(300)]
    got = brown.score_documents(spark.createDataFrame(data, "doc_id long, text string")).where("held_out").collect()
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got) + 0.2 * sum(r.n_tokens for r in got)


def test_brown_learns_classes_of_rare_words(spark):
    """Words of two tongues with one ending, too long for the clustering: only their own neighbours can tell their class."""
    rnd = random.Random(3)
    long = lambda k: f"{'xy'[k % 2]}{rnd.randint(0, 60)}{'p' * 64}en"
    data = [(k, " ".join(rnd.choice((f"{'ab'[k % 2]}{rnd.randint(0, 60)}", long(k))) for _ in range(60))) for k in range(300)]
    got = brown.score_documents(spark.createDataFrame(data, "doc_id long, text string")).where("held_out").collect()
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got) + 0.2 * sum(r.n_tokens for r in got)


@pytest.fixture(scope="module")
def labelled(spark):
    rnd, data, marks = random.Random(4), [], []
    for k in range(600):
        own = [f"{rnd.choice(['ma', 'to', 'ri', 'ke'])}{rnd.choice(['lin', 'sam', 'dor', 'vek'])}{rnd.choice(['a', 'o', 'us'])}" for _ in range(rnd.randint(10, 40))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                own.insert(rnd.randint(0, len(own)), rnd.choice(["grumpf", "Blark", "zoggish"]))
        data.append((k, " ".join(own)))
        marks.append((k, int(toxic)))
    docs = spark.createDataFrame([*data, (None, "grumpf you"), (900, None), (901, ""), (902, "lin " * 5000)], "doc_id long, text string")
    return docs, spark.createDataFrame([*marks, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) for k in range(600)) and got[None].held_out
    assert sum((got[k].predicted == 1) == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert got[None].predicted == 1 and got[900].score == got[901].score and got[901].predicted == 0 and got[902].predicted == 0
    span = got[None].spans[0]
    assert (span.start, span.end) == (0, 6)
    clean = toxicity.clean_documents(docs, labels)
    assert clean.columns == docs.columns and clean.where("doc_id = 900").count() == 1
    for marks in ([], [(1, 1), (2, 1)], [(1, 0), (2, 0)], [(1, None), (None, 0)]):  # labels that nothing can be learnt from call nothing toxic
        few = spark.createDataFrame(marks, "doc_id long, toxic int")
        assert {r.predicted for r in toxicity.score_documents(docs, few).collect()} == {0}
        assert toxicity.clean_documents(docs, few).count() == docs.count()
    assert toxicity.score_documents(docs.where("false"), labels).count() == 0


def test_chain_marginals_match_enumeration():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 5):
        e, t = rnd.normal(size=n), rnd.normal(size=(2, 2))
        weight, on = 0.0, np.zeros(n)
        for path in np.ndindex(*(2,) * n):
            w = math.exp(sum(e[k] for k in range(n) if path[k]) + t[0, path[0]] + sum(t[a, b] for a, b in zip(path, path[1:])))
            weight += w
            on += w * np.array(path)
        assert np.allclose(toxicity.chain(e, np.array([n]), t), on / weight)


def test_licenses(docs, empty):
    expected = []
    for i, t, _ in texts():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, n) for k in range(len(w)) for p, n in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        expected.append((i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))))
    got = licenses.scan_licenses(docs)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(expected, key=repr)
    own = {r.doc_id: r for r in got.collect()}
    assert "gpl-3.0" in own[63].labels and "mit" in own[63].labels.split(",") and "apache-2.0" in own[64].labels
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in own.values())
    assert licenses.scan_licenses(empty).count() == 0


def plain_scan(text):
    """All rules over the folded text without the prefilter; what lies inside an interval taken before is dropped."""
    folded = licenses.fold(text)
    found = sorted(((r.priority, m.start() - m.end(), m.start(), r.name, r) for r in licenses.rules() for m in r.pattern.finditer(folded)), key=lambda x: x[:4])
    taken = []
    for _, minus, at, _, r in found:
        if not any(a <= at and at - minus <= b for a, b, _ in taken):
            taken.append((at, at - minus, r))
    doubt = math.prod(1 - r.confidence for *_, r in taken)
    base = {n for p, n in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) if f" {p} ".encode() in folded}
    return ",".join(sorted(base | {r.label for *_, r in taken})), 1 - (0.4 if base and not taken else doubt)


def example(pattern):
    """A text that a signature matches: options left out, first alternatives taken."""
    text = pattern.replace(licenses.SOMEBODY, "the person ").replace("[^ ]*", "oo").replace("\\d", "2").replace("[123]", "2").replace("[12]", "2").replace("[01]", "1")
    text = re.sub(r"\(\?:[^()]*\)\?", "", text).replace(" ?", " ")
    text = re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", text)
    return re.sub(" +", " ", text)


def test_license_signatures_match_their_text():
    for name, _, _, label, keyword, pattern in licenses.SINGLE:
        text = example(pattern)
        found = [r for r in licenses.rules() if r.name == name and r.pattern.search(licenses.fold(text.encode()))]
        assert found and keyword in text and label in licenses.scan_text(f"Some words. {text.upper() if text.isascii() else text}, and more.".encode())["labels"].split(","), name


def test_license_labels_are_those_of_a_plain_scan():
    rnd = random.Random(8)
    pieces = [example(r[5]) for r in licenses.SINGLE] + ["GPL-3.0-only", "SPDX-License-Identifier: MIT", "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "the BSD license", "Mozilla Public License, version 2.0", "mit license mit license", ""]
    for k in range(150):
        text = " ".join(x for _ in range(rnd.randint(0, 6)) for x in (words(rnd.randint(0, 5), rnd.randint(0, 99)), rnd.choice(pieces)))
        got = licenses.scan_text(text.encode())
        labels, score = plain_scan(text.encode())
        assert got["labels"] == labels and math.isclose(got["score"], score, abs_tol=1e-9), text


def test_license_scan_of_a_long_text_is_linear():
    import time

    seconds = []
    for n in (1 << 13, 1 << 16):
        began = time.process_time()
        found = licenses.scan_text(b"the MIT License, " * n)
        seconds.append(time.process_time() - began)
        assert found["n_base"] == n and found["last_word"] == 3 * n - 2 and len(found["detections"]) == n
    assert seconds[1] < 16 * max(seconds[0], 0.1)


def test_license_rules():
    assert len(licenses.rules()) > 200
    found = licenses.scan(licenses.fold(b"Licensed under the Apache License, Version 2.0."))
    assert [f[1] for f in found] == ["apache-2.0"]  # the shorter signatures inside are suppressed


def test_decontaminate(spark, docs, empty):
    items = [(1, "Which river is the longest of all in the north? The answer is the blue one."), (2, words(30, 500)), (3, None), (4, ""), (5, words(30, 500)), (6, "tiny one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(100, words(50, 501) + " " + items[1][1].title().replace("Ö", "ö").replace(" ", ",  ") + " " + words(300, 502)), (101, "say: " + items[0][1]), (102, items[1][1][:60]), (None, items[0][1]), (103, None)]
    own = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = rows(decontaminate.leaks(own, bench), "doc_id", "item_id")
    assert got == sorted([(100, 2), (100, 5), (101, 1), (None, 1)], key=repr)
    assert sorted(r.doc_id or -1 for r in own.join(decontaminate.clean_documents(own, bench).select("doc_id").distinct(), "doc_id", "left_anti").where("doc_id >= 100").collect()) == [100, 101]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(own, bench.where("false")).count() == 0


def plain_leaks(docs, items):
    """Every passage against every item: BM25 of distinct words as a share of the item's own, then overlaps."""
    fold = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own = [(i, fold(t), t) for i, t in items if i is not None and fold(t)]
    mean, half = sum(len(w) for _, w, _ in own) / len(own), max(64, *(len(w) for _, w, _ in own))
    df = collections.Counter(x for _, w, _ in own for x in set(w))
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    def weight(x, w):
        n = w.count(x)
        return math.log(1 + (len(own) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean))

    out = []
    for i, text in docs:
        w, best = fold(text), {}
        for k in range(0, len(w), half):
            passage = w[k : k + 2 * half]
            for item, words_, t in own:
                full = sum(weight(x, words_) for x in set(words_))
                score = sum(weight(x, words_) for x in set(words_) & set(passage)) / full
                sides = [fold(p) for p in decontaminate.question_and_answer(t)]
                over = []
                for side, n in ((words_, 5), *((x, 5 if len(x) >= 10 else 1) for x in sides)):
                    g = grams(side, n)
                    over.append(len(g & grams(passage, len(next(iter(g))))) / len(g) if g else 1.0)
                if score >= 0.7 and over[0] >= 0.8 and min(over[1:]) >= 0.5 and (over[0], score) > best.get(item, ((-1,),))[0]:
                    best[item] = ((over[0], score), k // half)
        out += [(i, item, at, round(score, 6), round(overall, 6)) for item, ((overall, score), at) in best.items()]
    return out


def test_decontaminate_finds_what_a_plain_search_finds(spark):
    rnd, data = random.Random(11), []
    items = [(k, f"{words(rnd.randint(6, 50), 700 + k)}. {words(rnd.randint(2, 12), 800 + k)}.") for k in range(40)] + [(40, "x"), (41, None), (None, "lost one of all")]
    for k in range(120):
        own = items[k % 40][1].replace(".", "").split()
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(len(own))] = "changed"
        data.append((k, f"{words(rnd.randint(0, 200), 900 + k)} {' '.join(own)} {words(rnd.randint(0, 90), 1900 + k)}"))
    docs = spark.createDataFrame([(*d, "z", 1.0) for d in data], "doc_id long, text string, item_id string, score double").repartition(3)
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")
    expected = sorted(plain_leaks(data, items))
    assert len(expected) > 40
    for size in (decontaminate.INDEX_BYTES, 3000):  # one index, and several
        got = decontaminate.leaks(docs, bench, size)
        assert sorted((r.doc_id, r.item_id, r.passage, round(r.score, 6), round(r.overlap, 6)) for r in got.collect()) == expected
        clean = decontaminate.clean_documents(docs, bench, size)
        assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in data} - {e[0] for e in expected}
    assert len(list(decontaminate.indexes(bench, 3000))) > 1


def test_wand_finds_what_brute_force_finds():
    rnd = random.Random(9)
    index = decontaminate.Index([(k, words(rnd.randint(5, 60), 1000 + k)) for k in range(120)])
    for _ in range(200):
        terms = sorted(rnd.sample(range(len(index.vocabulary)), rnd.randint(1, min(30, len(index.vocabulary)))))
        scores = collections.defaultdict(float)
        for t in terms:
            for d, w in zip(*index.postings(t)[:2]):
                scores[d] += w
        for threshold in (0.1, 0.3, 0.6):
            assert sorted(d for d, _ in index.search(terms, threshold)) == sorted(d for d, s in scores.items() if s >= threshold)


def test_near_vectors(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(40, 8))
    data = [(k, (base[k % 40] + rnd.normal(size=8) * (0.05 if k % 3 else 0.4)).astype(np.float32).tolist()) for k in range(260)]
    data += [(300 + k, data[k][1]) for k in range(5)] + [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] + [1.0] * 7), (404, [None] + [1.0] * 7), (None, data[0][1]), (405, [float("inf")] + [0.0] * 7)]
    vectors = spark.createDataFrame([(i, v, "z", "z") for i, v in data], "vec_id long, embedding array<float>, rep string, cell string").repartition(3)
    good = [i is not None and v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for i, v in data]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v), g in zip(data, good)]
    link = [[g and h and i != j and float(a @ b) >= 0.95 for j, (b, h) in enumerate(zip(unit, good))] for i, (a, g) in enumerate(zip(unit, good))]
    label = list(range(len(data)))
    for _ in range(8):
        label = [min([label[i]] + [label[j] for j in range(len(data)) if link[i][j]]) for i in range(len(data))]
    least = {k: min((data[j][0] for j in range(len(data)) if label[j] == k and data[j][0] is not None), default=None) for k in set(label)}
    expected = [(i, sum(link[k]), least[label[k]], i is not None and least[label[k]] == i) for k, (i, _) in enumerate(data)]
    assert rows(neardup_vectors.near_duplicates(vectors), "vec_id", "n_links", "component_id", "kept") == sorted(expected, key=repr)
    assert neardup_vectors.near_duplicates(vectors.where("false")).count() == 0


def test_near_vectors_in_many_groups(spark, monkeypatch):
    for name, value in (("GROUP", 64), ("TREE", 32), ("PIVOTS", 12), ("SAMPLE", 100)):
        monkeypatch.setattr(neardup_vectors, name, value)
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(150, 6))
    data = [(k, (base[k % 150] + rnd.normal(size=6) * 0.08).tolist()) for k in range(400)] + [(1000 + k, (base[0] + rnd.normal(size=6) * 0.01).tolist()) for k in range(200)]
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in data])
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.array([i for i, _ in data])
    while True:
        new = np.array([min(label[k], *label[link[k]]) if link[k].any() else label[k] for k in range(len(data))])
        if (new == label).all():
            break
        label = new
    got = neardup_vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4))
    assert rows(got, "vec_id", "n_links", "component_id") == sorted(((i, int(link[k].sum()), int(label[k])) for k, (i, _) in enumerate(data)), key=repr)


def test_cells_are_packed_into_groups():
    for counts in ([0, 3, 5, 0], [10, 0, 2], [0, 0], [4, 4, 4, 30, 1], []):
        first, parts, members = neardup_vectors.grouped_cells(np.array(counts, np.int64), 8)
        for k, n in enumerate(counts):
            assert [g for g, own in enumerate(members) if k in own] == list(range(first[k], first[k] + parts[k])) and parts[k] >= n / 8
        assert all(sum(counts[k] for k in own) <= 8 or len(own) == 1 for own in members)


def test_near_vectors_with_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.01]
    data = [(0, a), (1, a), (1, b), (5, c), (9, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, -1.0]), (9, [0.0, 0.0, -1.0])]
    got = neardup_vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == sorted(
        [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 0, False), (5, 1, 0, False), (9, 0, 9, True), (9, 1, 9, True), (9, 1, 9, True)], key=repr
    )


def test_cover_tree_covers_and_separates():
    for units in (neardup_vectors.units_of(np.random.default_rng(1).normal(size=(300, 3))), neardup_vectors.units_of(np.random.default_rng(2).normal(size=(200, 32)))):
        tree = neardup_vectors.CoverTree(units)
        above, top = np.zeros(len(units), int), None
        for (centres, parent, cover), radius in zip(tree.levels[:-1], neardup_vectors.RADII):
            assert (cover <= radius + 1e-9).all() and (top is None or set(top.tolist()) <= set(centres.tolist()))
            for k in set(parent.tolist()):
                own = units[centres[parent == k]]
                assert (neardup_vectors.distances(own, own)[np.triu_indices(len(own), 1)] > radius - 1e-9).all()
            top = centres
        assert sorted(tree.levels[-1][0].tolist()) == list(range(len(units))) and len(above) == len(units)
        a, b = neardup_vectors.CoverTree(units[:150]), neardup_vectors.CoverTree(units[150:])
        for threshold in (0.5, 0.9):
            x, y = neardup_vectors.dual(a, b, threshold)
            assert set(zip(x.tolist(), y.tolist())) == set(zip(*(z.tolist() for z in np.nonzero(units[:150] @ units[150:].T >= threshold))))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = [(k, t, "en", s or "s", len(t or "")) for k, (_, t, s) in enumerate(texts())]
    folder = str(tmp_path)
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, data[2][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = [r.doc_id for r in docs.collect()]
        assert name == "tokens" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 2 in seen["simhash"] and 2 not in seen["decontaminate"] and len(seen["toxicity"]) == len(data)
    assert sorted(seen["tokens"]) == sorted(seen["mix"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(seen["tokens"])


def _tables(spark, folder, documents, labels, items):
    extra = "lang string, source string, n_chars long, score string, fp string, shard string, component string"
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "z", "z", "z", "z") for i, t, s in documents], f"doc_id long, text string, {extra}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, null sources and texts, clashing columns, and nothing to learn from or to look for."""
    import corpus_pipeline

    a, b, c = words(80, 1), words(90, 2), words(70, 3)
    data = [(1, a, "s"), (1, b, "s"), (1, b, "s"), (2, c, None), (None, a, "s"), (None, None, None), (3, None, "t"), (4, "", "t")]
    _tables(spark, str(tmp_path), data, [], [])
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "tokens" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    assert len(seen["toxicity"]) == len(data)
    both = sorted(((r.doc_id, r.text) for r in seen["simhash"]), key=repr)
    assert both == sorted([(1, a), (1, b), (2, c), (None, a), (None, None), (3, None)], key=repr) and len(seen["decontaminate"]) == len(both)
    assert {r.text for r in seen["mix"]} <= {a, b, c} and len(seen["tokens"]) == len(seen["mix"])


def test_pipeline_of_three_documents(spark, tmp_path):
    import corpus_pipeline

    _tables(spark, str(tmp_path), [(1, words(30, 1), "s"), (1, words(30, 2), "s"), (2, words(30, 3), "s")], [], [])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2}


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    _tables(spark, str(tmp_path), [], [(1, 1, 1)], [(1, "an item")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxicity_scores_are_those_of_a_plain_field(labelled):
    """Scores of a fitted model by enumerating marginals with plain sums over both tags, text by text."""
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    shown = [r.text for r in docs.limit(40).collect()] + ["", "grumpf grumpf!", "a Zoggish zoggish b"]
    got, spans = toxicity.Scorer(model).score([(t or "").encode() for t in shown])
    for text, score, own in zip(shown, got, spans):
        words_ = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        e = [sum(float(model.weights[zlib.crc32(f) % toxicity.FEATURES]) for f in toxicity.features_of(w.encode())) for w in words_]
        t, n = model.transitions, len(e)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        for k in range(n):
            for b in (0, 1):
                alpha[k, b] = e[k] * b + (t[0, b] if k == 0 else np.logaddexp(alpha[k - 1, 0] + t[0, b], alpha[k - 1, 1] + t[1, b]))
        for k in range(n - 2, -1, -1):
            for a in (0, 1):
                beta[k, a] = np.logaddexp(t[a, 0] + beta[k + 1, 0], t[a, 1] + e[k + 1] + beta[k + 1, 1])
        p = [1 / (1 + math.exp(alpha[k, 0] + beta[k, 0] - alpha[k, 1] - beta[k, 1])) for k in range(n)]
        high = sum(x for x in p if x > 0.5)
        z = float(model.document @ [1, max(p, default=0), math.log1p(high), high / n if n else 0])
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-6)
        assert sum(x > 0.5 and (k == 0 or p[k - 1] <= 0.5) for k, x in enumerate(p)) == len(own)
