"""Token-ID output: every document compressed on its own under one shared zstandard dictionary, with an offset index."""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, distinct_slices, groups, shared_dir, slice_hashes, table, tidied

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: Bounds of the sample that the dictionary is trained on (documents, bytes of each), its size, and payload bytes in a block.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES, BLOCK_BYTES = 512, 65_536, 65_536, 1 << 20
#: What stands for a null id, which comes before all others.
NO_ID = -(1 << 63)
#: Pieces whose ids a worker remembers, and bytes of texts that it works on at once.
MEMORY, HELD = 400_000, 2 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte-level tokenizers write a byte as a printable letter: itself where it is one, else those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(other)}


#: Kinds of bytes: ASCII letters, closing marks, blanks, line ends, other ASCII white space; the rest is 0.
_LETTER, _MARK, _BLANK, _LINE, _SPACE = range(1, 6)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(b".,;:!?")] = _MARK
_KIND[32], _KIND[10] = _BLANK, _LINE
_KIND[[9, 11, 12, 13, 28, 29, 30, 31]] = _SPACE


class Encoder:
    """Whole-text encoding of many texts at once, in which each distinct piece is tokenized once.

    The usual byte-level word pattern never joins characters across a blank or a line's end that stands alone between
    others than white space, nor an ASCII letter and a mark that follows it. So such texts are the sequence of their
    pieces: words led by a blank, words led by nothing, line ends, and what follows from a closing mark on. Pieces are cut
    and grouped as arrays, by hash and then by bytes. Words of letters alone go to the tokenizer's own model together;
    pieces of other kinds go through the whole tokenizer. Texts with other white space, and those that may hold a special
    token, go through it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        parts = str(self.tokenizer.pre_tokenizer)
        self.split = self.tokenizer.normalizer is None and parts == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        # The model alone, on words that are separated by blanks and written in its own letters.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters, self.lead = _byte_letters(), chr(_byte_letters()[32])
        letters = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(letters.values(), default=0) + 1, bool)
        self.opens[[k for t, k in letters.items() if t[:1] == self.lead]] = True

    def packed(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _led(self, tokenizer, pieces: list[bytes], texts: list[str], alone) -> dict[bytes, bytes]:
        """Ids of blank-led pieces that are encoded as one text and cut where a token opens with a blank."""
        if not pieces:
            return {}
        ids = np.array(tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.int64)
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(pieces) or at[0]:  # a vocabulary that does not open words so
            return {p: alone(p) for p in pieces}
        raw, ends = ids.astype(self.kind).tobytes(), (np.append(at, len(ids)) * self.width).tolist()
        return {p: raw[a:b] for p, a, b in zip(pieces, ends, ends[1:])}

    def learn(self, pieces: list[bytes]) -> tuple[dict[bytes, bytes], set[bytes]]:
        """Ids of pieces not known yet, and those that hold white space beyond ASCII."""
        found, odd, led, texts, others, unled = {}, set(), [], [], [], []
        for piece in pieces:
            word = piece[1:] if piece[:1] == b" " else piece
            if word.isalpha():  # ASCII letters
                if word is piece:
                    unled.append((piece, piece.decode()))
                else:
                    led.append(piece)
                    texts.append(f" {self.lead}{word.decode()}")
            else:
                own = word.decode()
                if own.split() != [own] and piece != b"\n":
                    odd.add(piece)
                elif own.isalpha():
                    letters = word.decode("latin-1").translate(self.letters)
                    if word is piece:
                        unled.append((piece, letters))
                    else:
                        led.append(piece)
                        texts.append(f" {self.lead}{letters}")
                elif word is piece:
                    found[piece] = self.whole(own)
                else:
                    others.append(piece)
        for piece, letters in unled:
            found[piece] = self.packed([t.id for t in self.tokenizer.model.tokenize(letters)])
        found |= self._led(self.words, led, texts, lambda p: self.whole(p.decode()))
        found |= self._led(self.tokenizer, others, [p.decode() for p in others], lambda p: self.whole(p.decode()))
        for piece in list(found)[: max(0, MEMORY - len(self.known))]:
            self.known[piece] = found[piece]
        return found, odd

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts (UTF-8), as the file holds them before compression."""
        out = [b""] * len(texts)
        cut = [k for k, t in enumerate(texts) if t and self.split and not any(s in t for s in self.special)]
        rest = [k for k, t in enumerate(texts) if t and not (self.split and not any(s in t for s in self.special))]
        if cut:
            found = self._pieces([texts[k] for k in cut])
            for k, ids in zip(cut, found):
                if ids is None:
                    rest.append(k)
                else:
                    out[k] = ids
        for k in rest:
            out[k] = self.whole(texts[k].decode())
        return out

    def _pieces(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of texts as the sequence of their pieces; None for those that must be encoded whole."""
        sizes = np.array([len(t) for t in texts])
        first = np.cumsum(sizes + 1) - sizes - 1
        raw = b"\n".join(texts) + b"\n"  # a line's end closes each text and is left out of its ids
        flat = np.frombuffer(raw, np.uint8)
        kind = _KIND[flat]
        space = kind >= _BLANK
        doc = lambda at: np.searchsorted(first, at, side="right") - 1
        odd = np.zeros(len(texts), bool)
        odd[doc(np.flatnonzero(space[1:] & space[:-1]))] = True
        odd[doc(np.flatnonzero(kind == _SPACE))] = True
        begins = space.copy()
        begins[0] = True
        begins[1:] |= (kind[:-1] == _LINE) | ((kind[1:] == _MARK) & (kind[:-1] == _LETTER))
        starts = np.flatnonzero(begins)
        sizes_of = np.diff(np.append(starts, len(flat)))
        place, lead = distinct_slices(raw, flat, starts, sizes_of, slice_hashes(flat, starts, sizes_of))
        distinct = [raw[x : x + m] for x, m in zip(starts[lead].tolist(), sizes_of[lead].tolist())]
        fresh, strange = self.learn([p for p in distinct if p not in self.known])
        if strange:
            odd[doc(starts[np.array([p in strange for p in distinct])[place]])] = True
        ids = [self.known.get(p) or fresh.get(p, b"") for p in distinct]
        long = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        pool, at = np.frombuffer(b"".join(ids), self.kind), (np.cumsum(long) - long)[place]
        took = long[place]
        ends = np.cumsum(took)
        tokens = pool[np.repeat(at - ends + took, took) + np.arange(int(took.sum()))].tobytes()
        # Of each text the tokens from its first piece to the line's end that closes it.
        to = np.concatenate([[0], ends])
        lo, hi = np.searchsorted(starts, first), np.searchsorted(starts, first + sizes)
        return [None if skip else tokens[x : x + m] for skip, x, m in zip(odd.tolist(), (to[lo] * self.width).tolist(), ((to[hi] - to[lo]) * self.width).tolist())]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text.encode()])[0]


@functools.cache
def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def _serialized(texts: list[bytes], own: Encoder) -> list[bytes]:
    """Documents' ids with the end id."""
    end = np.array([END_ID], own.kind).tobytes()
    return [ids + end for ids in own.encode_all(texts)]


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from the documents with the smallest hashes of their texts, within SAMPLE_DOCS and SAMPLE_BYTES."""
    hashed = docs.where(F.octet_length("text").between(1, SAMPLE_BYTES)).withColumn("h", F.xxhash64("text"))
    chosen = hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).distinct().collect()
    rows = hashed.where(F.col("h").isin([r.h for r in chosen])).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect() if chosen else []
    own = encoder(path)
    samples = _serialized([r.text.encode() for r in rows], own)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: a raw prefix serves
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def _texts(batches):
    """Ids and texts, some megabytes at a time; a longer text comes alone."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            own = text.as_py() or b""
            if texts and held + len(own) > HELD:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(own)
            held += len(own)
        if ids:
            yield ids, texts


def _compressor(path: str, raw, bounds: np.ndarray):
    @tidied
    def compress(batches):
        own = encoder(path)
        press = zstandard.ZstdCompressor(level=1, dict_data=_dictionary(raw.value) if raw.value else None, write_content_size=True)
        for ids, texts in _texts(batches):
            done = _serialized(texts, own)
            key = np.array([NO_ID if i is None else i for i in ids], np.int64)
            shard, beyond = np.searchsorted(bounds, key, side="left"), np.searchsorted(bounds, key, side="right")
            # An id that fills several ranges is dealt to them by the texts.
            many = np.flatnonzero(beyond > shard + 1)
            shard[many] += np.array([zlib.crc32(texts[k]) % m for k, m in zip(many.tolist(), (beyond - shard)[many].tolist())], np.int64)
            shard = shard.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(ids, pa.int64()), pa.array([len(x) // np.dtype(own.kind).itemsize for x in done], pa.int64()), pa.array([press.compress(x) for x in done], pa.binary())], ["shard", "doc_id", "n_tokens", "payload"]
            )

    return compress


_BLOCK = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()), ("id_kind", pa.string()), ("start", pa.int64()), ("tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])
_BLOCK_DDL = "shard int, block int, dictionary string, id_kind string, start long, tokens long, first_doc long, last_doc long, doc_ids array<long>, doc_tokens array<long>, offsets array<long>, payload binary"


def _packer(name: str, kind: str):
    @tidied
    def pack(batches):
        for shard, part in groups(batches, "shard"):
            start, block, held, ids, counts, parts = 0, 0, 0, [], [], []

            def made():
                known = [i for i in ids if i is not None]
                row = [shard, block, name, kind, start, sum(counts), min(known, default=None), max(known, default=None), ids, counts, np.cumsum([0, *map(len, parts)]).tolist(), b"".join(parts)]  # noqa: B023
                return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, row))], _BLOCK)

            for batch in part:
                for i, n, payload in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    ids.append(i)
                    counts.append(n)
                    parts.append(payload)
                    held += len(payload)
                    if held >= BLOCK_BYTES:
                        yield made()
                        start, block, held, ids, counts, parts = start + sum(counts), block + 1, 0, [], [], []
            if ids:
                yield made()

    return pack


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write their ids to ``path`` in ascending doc_id order.

    The format: ``path/dictionary`` holds the dictionary and its SHA-256; ``path/blocks`` holds rows (shard, block), which
    in that order run through the documents by ascending doc_id, null ids first. A row has the dictionary's hash, the
    tokens of its shard before it, and for its documents the ids, the token counts, the offsets and the payload of
    separately compressed frames, so that one document is read by its offsets alone. Null texts are empty texts (just
    the end id); rows with one id are written one by one, in an order fixed by their texts, and where they fill several
    ranges they are dealt to them by their texts; an empty table writes empty tables.
    Spark's committer publishes both tables, so a lost executor leaves no partial file.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer = tokenizer or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(NO_ID))
    bounds = docs.agg(F.percentile_approx(key, [k / shards for k in range(1, shards)] or [1.0], 10_000).alias("b")).first().b or []
    raw = train_dictionary(docs, tokenizer)
    name, kind = hashlib.sha256(raw).hexdigest(), encoder(tokenizer).kind
    frames = docs.mapInArrow(_compressor(tokenizer, spark.sparkContext.broadcast(raw), np.array(sorted(bounds), np.int64)), "shard int, doc_id long, n_tokens long, payload binary")
    blocks = frames.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "payload").mapInArrow(_packer(name, kind), _BLOCK_DDL)
    # Payloads are compressed already; a second codec would only hold a buffer as large as a page of them.
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(name, bytearray(raw))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def _load(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(row.dictionary)
    if hashlib.sha256(raw).hexdigest() != row.hash:
        raise ValueError("the dictionary does not match its hash")
    return row.hash, raw


def _reader(name: str, raw, with_ids: bool):
    @tidied
    def read(batches):
        zip_ = zstandard.ZstdDecompressor(dict_data=_dictionary(raw.value) if raw.value else None)
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                if row["dictionary"] != name:
                    raise ValueError("a block was written under another dictionary")
                ids, counts, crcs, arrays = row["doc_ids"], [], [], []
                for a, b in zip(row["offsets"], row["offsets"][1:]):
                    values = np.frombuffer(zip_.decompress(row["payload"][a:b]), row["id_kind"]).astype("<u4")
                    counts.append(len(values))
                    crcs.append(zlib.crc32(values.tobytes()))
                    arrays.append(values.astype(np.int64).tolist() if with_ids else None)
                start = row["start"] + row["shard_start"] + np.cumsum([0, *counts[:-1]])
                columns = [pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(arrays, pa.list_(pa.int64()))] if with_ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return read


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, doc_id: int | None = None) -> DataFrame:
    """Documents of a written file: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    With ``doc_id`` only blocks whose id range holds it are read.
    """
    name, raw = _load(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row for each shard, of which there are as many as shuffle partitions when the file was written.
    totals = blocks.groupBy("shard").agg(F.sum("tokens").alias("shard_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("shard").alias("of"), F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("shard_start"))
    if doc_id is not None:
        blocks = blocks.where(F.lit(doc_id).between(F.col("first_doc"), F.col("last_doc")))
    wanted = blocks.join(F.broadcast(starts), F.col("shard") == F.col("of")).select("dictionary", "id_kind", "start", "shard_start", "doc_ids", "offsets", "payload")
    out = wanted.mapInArrow(_reader(name, spark.sparkContext.broadcast(raw), with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return out if doc_id is None else out.where(F.col("doc_id") == doc_id)


def token_file(docs: DataFrame) -> DataFrame:
    """Write ``docs`` into a new folder among the shared ones and read the file back, a row for each document.

    Null and empty texts have just the end id; null ids come first; rows of one id, equal ones too, have a row each; an
    empty table gives no rows; columns other than doc_id and text are not read.
    """
    path = f"{shared_dir(docs.sparkSession)}/cartolith-tokens/{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, read back from the file written; see :func:`write_tokens` for nulls, ties, repeats and empty tables."""
    return token_file(table(spark, sf_dir, "documents"))
