"""Token-id store: every document's ids in its own zstandard frame under one shared dictionary, with an offset index.

A store is a folder of two Parquet tables, so that Spark's committers write it and any file system Spark knows holds it:

* ``dictionary``: one row with the dictionary's bytes, their SHA-256, the width of an id and the end id;
* ``blocks``: runs of documents in ascending order of doc_id.  A block has its documents' ids and token counts, the
  offset of each document's frame in ``payload``, the number of tokens before the block in its part, and the
  dictionary's hash, which a reader checks before it decodes.

One document is read by its block's index alone: the block is found by its range of doc_ids (Parquet statistics skip the
others), one frame is cut out by its offset and decompressed.

The dictionary is trained on the serialized ids of at most ``sample_docs`` documents of at most ``sample_chars``
characters: those with the least seeded hash of id and text, wherever they lie, so that reruns train the same one; it
only affects how small frames get.

Encoding: a word (a run without ASCII white space) has the same ids wherever it stands, for tokenizers that lower case,
normalise and split at white space, as those with word ends do; so words are encoded once and remembered, in a bounded
table.
``whole=True`` hands whole texts to the tokenizer instead, for any other kind; a store does so too if the words of a
document of that sample don't give what its whole text gives.

Defined results: null text is empty and has the end id alone; rows go by doc_id (null first), then a hash of the text,
each row being a document; an empty table makes a store without blocks; other columns never take part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow_text import slices

BLOCK_BYTES = 4_000_000
REMEMBERED_WORDS = 600_000
#: Words whose ids are put in a row at once.
JOINED_WORDS = 500_000
SAMPLE_SEED = 42
#: ASCII marks: a run of them at the end of a word is a piece of its own after a letter.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters that byte-level models have for bytes; the space stays, to split at.
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)) if b != 32}
#: ASCII white space to line breaks.
BREAKS = bytes.maketrans(b" \t\x0b\x0c\r", b"\n" * 5)
BLOCKS = (
    "part int, block int, first_doc long, last_doc long, n_docs int, n_tokens long, before long, "
    "doc_ids binary, has_id binary, counts binary, offsets binary, dict_sha256 string, payload binary"
)
BLOCK_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("before", pa.int64()),
     ("doc_ids", pa.binary()), ("has_id", pa.binary()), ("counts", pa.binary()), ("offsets", pa.binary()), ("dict_sha256", pa.string()), ("payload", pa.binary())]
)


class WordEncoder:
    """Texts to serialized ids, by way of their words."""

    def __init__(self, path: str, end_id: int, whole: bool = False, most: int = REMEMBERED_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max([end_id, *vocab.values()]) < 65_536 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.whole, self.most = whole, most
        self.known: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}
        # the same model behind a plain split: for words of lower-case letters in normal form, which are one piece each
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of lower-case words of letters only."""
        out: dict[bytes, bytes] = {}
        width = self.dtype.itemsize
        for i in range(0, len(words), 1_024):
            some = words[i : i + 1_024]
            ids = np.array(self.letters.encode_batch_fast([b" ".join(some).decode("latin-1").translate(BYTE_LEVEL)], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self.closes[ids]) + 1) * width
            if len(ends) == len(some) and ends[-1] == len(ids) * width:
                packed = ids.tobytes()
                out |= zip(some, map(packed.__getitem__, map(slice, np.r_[0, ends[:-1]].tolist(), ends.tolist())), strict=True)
            else:  # not one piece a word after all
                out |= self._whole(some)
        return out

    def _whole(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return {word: self._pack(e.ids) for word, e in zip(words, found, strict=True)}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of different words that aren't known yet."""
        from unicodedata import is_normalized

        known, tails = self.known, self.tails
        plain: list[bytes] = []
        marked: list[tuple[bytes, bytes, bytes]] = []  # word, its letters, the marks after them
        other: list[bytes] = []
        for word in words:
            if word.isalpha() and word.islower():  # of bytes: ASCII only
                plain.append(word)
                continue
            core = word.rstrip(MARKS)
            if core.isalpha() and core.islower():
                marked.append((word, core, word[len(core) :]))
                continue
            if core and not core.isascii():
                text = core.decode("utf-8")
                # one piece of letters that lower case and the normal form leave as they are
                if text.isalpha() and text.lower() == text and is_normalized("NFC", text):
                    marked.append((word, core, word[len(core) :]))
                    continue
            other.append(word)
        cores = {core for _, core, _ in marked}
        out = {core: known[core] for core in cores if core in known}
        out |= self._letters(list(cores.union(plain).difference(out)))
        new = {tail for _, _, tail in marked}.difference(tails)
        if len(tails) > 20_000:
            tails.clear()
            tails[b""] = b""
            new = {tail for _, _, tail in marked if tail}
        tails |= self._whole(sorted(new))
        out |= [(word, out[core] + tails[tail]) for word, core, tail in marked]
        for i in range(0, len(other), 512):
            out |= self._whole(other[i : i + 512])
        return out

    def _words(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different words, in lower case where that can't make a special token; which stand where; each text's first.

        Words are told apart in columns, each with a line break after it: only different ones become Python objects.
        """
        low = [t if b"<|" in t else t.lower() for t in texts]
        data = np.frombuffer(b"\n".join([b"", *low, b""]).translate(BREAKS), np.uint8)
        within = data != 10
        cuts = np.flatnonzero(within[1:] != within[:-1]) + 1
        starts, sizes = cuts[::2], cuts[1::2] - cuts[::2] + 1
        first = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in low)]))
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        if not len(starts):
            return [], np.zeros(0, np.int32), first
        within[1:] |= data[:-1] != 10
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[within])]).dictionary_encode()
        _, ends, own = words.dictionary.buffers()
        different = own.slice(0, int(np.frombuffer(ends, np.int64)[len(words.dictionary)])).to_pybytes().split(b"\n")
        return different[:-1], words.indices.to_numpy(), first

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The serialized ids of each text, the end id included."""
        if self.whole:
            found = (self.tokenizer.encode_batch_fast([t.decode("utf-8")], add_special_tokens=False)[0].ids for t in texts)
            return [self._pack(ids) + self.end for ids in found]
        known = self.known
        different, which, first = self._words(texts)
        packed = list(map(known.get, different))
        new = self._encode([w for w, x in zip(different, packed, strict=True) if x is None])
        packed = [new[w] if x is None else x for w, x in zip(different, packed, strict=True)]
        if len(known) < self.most:
            known |= new
        # the end id stands for a word after each text's last
        which = np.insert(which, first[1:], len(packed))
        first = first + np.arange(len(first))
        packed.append(self.end)
        flat = np.frombuffer(b"".join(packed), self.dtype)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        begins = np.cumsum(sizes) - sizes
        parts, ends = [], np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes[which], out=ends[1:])
        for a in range(0, len(which), JOINED_WORDS):
            b = min(a + JOINED_WORDS, len(which))
            own, n = which[a:b], ends[b] - ends[a]
            parts.append(flat[np.repeat(begins[own] - (ends[a:b] - ends[a]), sizes[own]) + np.arange(n)].tobytes())
        out, at = b"".join(parts), (ends[first] * self.dtype.itemsize).tolist()
        return [out[a:b] for a, b in zip(at, at[1:], strict=False)]


def encoder(path: str, end_id: int, whole: bool) -> WordEncoder:
    """The process's encoder: functions come to the workers anew with every task, modules stay."""
    import sys
    import types

    kept = sys.modules.setdefault("_vaultlens_process", types.ModuleType("_vaultlens_process")).__dict__
    key = ("encoder", path, end_id, whole)
    if key not in kept:
        kept[key] = WordEncoder(path, end_id, whole)
    return kept[key]


def train_dictionary(samples: list[bytes], size: int = 65_536) -> bytes:
    """A zstandard dictionary of serialized ids; with too few samples to train on, their bytes are the dictionary."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _texts(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[list[int | None], list[bytes]]:
    own, cuts = data.tobytes(), offsets.tolist()
    return rows.column(0).to_pylist(), [own[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def write_store(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int, whole: bool = False, level: int = 3, sample_docs: int = 512,
    sample_chars: int = 16_384, block_bytes: int = BLOCK_BYTES,
) -> None:
    """Write docs(doc_id, text) as a store at path.  tokenizer is the path of a tokenizers file that all machines have."""
    import zstandard

    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    draw = F.xxhash64("doc_id", "text", F.lit(SAMPLE_SEED))
    # only as many draws as the sample needs twice over are sorted, so that what comes to the driver doesn't grow
    most = int((2 * sample_docs / max(docs.count(), 2 * sample_docs) - 0.5) * 2**64)
    short = plain.where((F.length("text") > 0) & (F.length("text") <= sample_chars) & (draw <= min(most, 2**63 - 1)))
    chosen = [r["text"].encode() for r in short.orderBy(draw, "doc_id", "text").limit(sample_docs).collect()]
    own = encoder(tokenizer, end_id, whole)
    sample = own.encode(chosen)
    if not whole and sample != (plainly := encoder(tokenizer, end_id, True).encode(chosen)):
        whole, sample = True, plainly
    data = train_dictionary(sample)
    sha = hashlib.sha256(data).hexdigest()
    width = own.dtype.itemsize
    spark.createDataFrame([(bytearray(data), sha, width, end_id)], "dictionary binary, sha256 string, width int, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, block = TaskContext.get().partitionId(), 0, 0
        words = encoder(tokenizer, end_id, whole)
        shared = _dictionary(data)
        if shared:
            shared.precompute_compress(level=level)
        frames = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False)
        runs = (_texts(*run) for batch in batches for run in slices(batch, "text", block_bytes))
        for docs_, texts in runs:
            ids = words.encode(texts)
            packed = [frames.compress(x) for x in ids]
            counts = np.array([len(x) // width for x in ids], "<u4")
            names = np.array([d or 0 for d in docs_], "<i8")
            known = [d for d in docs_ if d is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((
                    part, block, min(known, default=None), max(known, default=None), len(docs_), int(counts.sum()), before, names.tobytes(),
                    np.array([d is not None for d in docs_], "u1").tobytes(), counts.tobytes(),
                    np.cumsum([0, *map(len, packed)]).astype("<u8").tobytes(), sha, b"".join(packed),
                ), BLOCK_SCHEMA.types, strict=True)], schema=BLOCK_SCHEMA)
            before += int(counts.sum())
            block += 1

    by = ["doc_id", "text_hash"]
    ordered = plain.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(*by).sortWithinPartitions(*by)
    ordered.select("doc_id", "text").mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")


def _opened(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary isn't the one that was written")
    return data, row["sha256"], row["width"]


def _decoded(block: dict, only: set[int] | None, frames, sha: str, dtype: np.dtype) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, tokens before it in its part, ids) of a block's documents, or of some by their offsets alone."""
    if block["dict_sha256"] != sha:
        raise ValueError("the block was written with another dictionary")
    names, known = np.frombuffer(block["doc_ids"], "<i8"), np.frombuffer(block["has_id"], "u1")
    counts, offsets = np.frombuffer(block["counts"], "<u4"), np.frombuffer(block["offsets"], "<u8")
    starts = block["before"] + np.cumsum(counts, dtype=np.int64) - counts
    for i in range(len(names)):
        doc_id = int(names[i]) if known[i] else None
        if only is None or doc_id in only:
            frame = block["payload"][int(offsets[i]) : int(offsets[i + 1])]
            ids = np.frombuffer(frames.decompress(frame, max_output_size=int(counts[i]) * dtype.itemsize), dtype)
            if len(ids) != counts[i]:
                raise ValueError("a document's frame doesn't match the index")
            yield doc_id, int(starts[i]), ids


def _reader(data: bytes, sha: str, width: int, made: Callable, schema: pa.Schema, only: set[int] | None = None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        frames = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time
                block = batch.slice(i, 1).to_pylist()[0]
                rows = [(d, block["part"], s, *made(ids)) for d, s, ids in _decoded(block, only, frames, sha, np.dtype(f"<u{width}"))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return read


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store, from its frames."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    made = lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    rows = blocks.mapInArrow(_reader(*_opened(spark, path), made, schema), "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return _with_starts(rows, blocks).select("doc_id", "start", "n_tokens", "ids_crc32")


def _with_starts(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """start counted from the first document of the store: a part has one row here, and there are as many as tasks wrote."""
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("part_start"))


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """doc_id, ids of the named documents; only blocks that may hold one are read, and only their frames decompressed."""
    only = set(doc_ids)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if not only:
        return blocks.sparkSession.createDataFrame([], "doc_id long, ids array<long>")
    near = blocks.where((F.col("first_doc") <= max(only)) & (F.col("last_doc") >= min(only)))
    read = _reader(*_opened(spark, path), lambda ids: (ids.astype(np.int64).tolist(),), schema, only)
    return near.mapInArrow(read, "doc_id long, part int, start long, ids array<long>").select("doc_id", "ids")
