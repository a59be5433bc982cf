"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words (runs of letters and digits, hashed into ``2**WORD_BITS`` places, weighted by
1 + log count and scaled to unit length), its structure statistics, each cut into ``BINS`` bins of its own, and one
metadata field, the recorded n_chars, in bins of powers of two.  The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

where the last term is all pairwise interactions through rank-``RANK`` factors, in time linear in the features.

Learning takes at most ``sample_rows`` labelled documents, chosen by a hash of their ids; it is seeded, runs on the
driver on their sparse features, and its model has a fixed size, which is broadcast.  Scoring is one narrow map over
whole texts.  Labels, lang, source and ids are never features.

Defined results: null text is empty, and an empty text has a score from its statistics; a null n_chars has a bin of its
own; several labels of a document are averaged; without labels the score is 1/2; repeated rows each return; an empty
table gives no rows; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices
from .decontam import IN_WORD, words_of
from .hashing import BASE, U64, Powers
from .shared import giving_back

WORD_BITS, BINS, RANK = 14, 8, 4
RUN_BYTES = 2_000_000
#: Byte classes counted for the statistics.
_B = np.arange(256)
CLASSES = {
    "upper": (_B >= 65) & (_B <= 90),
    "digit": (_B >= 48) & (_B <= 57),
    "blank": np.isin(_B, [32, 9, 10, 11, 12, 13]),
    "line": _B == 10,
    "mark": np.isin(_B, [ord(c) for c in ".,;:?'\"-()"]),
    "shout": _B == ord("!"),
    "bar": np.isin(_B, [ord(c) for c in "|\\/_~^=+<>"]),
    "sign": np.isin(_B, [ord(c) for c in "#$%&*@{}[]`"]),
    "beyond": _B >= 128,
}
#: Bin edges of each share; shares are of bytes, or of words for the last three.
EDGES = np.array([0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])
N_STATS = len(CLASSES) + 5
WORDS, STATS = 1 << WORD_BITS, (len(CLASSES) + 5) * BINS
META_BINS = 34
FEATURES = WORDS + STATS + META_BINS


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.float64)]
    return total[first[1:]] - total[first[:-1]]


def features_of(data: np.ndarray, offsets: np.ndarray, n_chars: list[int | None], p: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, index, value): the sparse rows of several texts in a row."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    words = words_of(data, offsets, p)
    count = np.maximum(np.diff(words.first), 1)
    doc = np.repeat(np.arange(n), np.diff(words.first))
    # words of a document that differ, and how often each is there
    pair, times = np.unique((doc.astype(np.uint64) << U64(WORD_BITS)) | (words.hashes >> U64(64 - WORD_BITS)), return_counts=True)
    row = (pair >> U64(WORD_BITS)).astype(np.int64)
    weight = 1 + np.log(times)
    norm = np.sqrt(np.maximum(np.bincount(row, weight * weight, n), 1e-9))
    index, value = [(pair & U64(WORDS - 1)).astype(np.int64)], [weight / norm[row]]
    rows = [row]
    # shares of byte classes, then of words: different ones, repeats of the word before, and how long words are
    kinds = np.stack([_per_row(mask[data], offsets) / size for mask in CLASSES.values()]) if len(data) else np.zeros((len(CLASSES), n))
    again = np.zeros(len(doc), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    different = np.bincount(row, minlength=n) / count
    letters = _per_row(IN_WORD[data], offsets) / count if len(data) else np.zeros(n)
    stats = [*kinds, different, _per_row(again, words.first) / count, np.minimum(letters / 20, 1), np.minimum(np.log2(size) / 24, 1), np.minimum(np.log2(count) / 20, 1)]
    for k, share in enumerate(stats):
        edges = EDGES if k < len(CLASSES) + 2 else np.linspace(0.1, 0.8, BINS - 1)
        rows.append(np.arange(n))
        index.append(WORDS + k * BINS + np.searchsorted(edges, share, side="right"))
        value.append(np.ones(n))
    known = np.array([-1 if c is None else max(c, 0) for c in n_chars], np.int64)
    rows.append(np.arange(n))
    index.append(WORDS + STATS + np.where(known < 0, META_BINS - 1, np.minimum(np.log2(np.maximum(known, 1)).astype(np.int64), META_BINS - 2)))
    value.append(np.ones(n))
    rows_, index_, value_ = np.concatenate(rows), np.concatenate(index), np.concatenate(value)
    order = np.argsort(rows_, kind="stable")
    first = np.r_[0, np.cumsum(np.bincount(rows_, minlength=n))]
    return first, index_[order], value_[order].astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores before the logistic, sums of factors) of sparse rows, none of which is empty."""
        at = first[:-1]
        linear = np.add.reduceat(self.linear[index] * value, at)
        xv = self.factors[index] * value[:, None]
        sums = np.add.reduceat(xv, at, axis=0)
        pairs = 0.5 * ((sums * sums).sum(1) - np.add.reduceat((xv * xv).sum(1), at))
        return self.bias + linear + pairs, sums


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(rows: list[tuple[np.ndarray, np.ndarray, float]], *, seed: int = 11, epochs: int = 8, steps: int = 400, batch: int = 64, rate: float = 0.15, decay: float = 1e-4) -> Machine:
    """Adagrad on the logistic loss of (index, value, label) rows: so many epochs, more of few rows for so many steps."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32))
    if not rows:
        return Machine(0.0, m.linear, np.zeros_like(m.factors))
    share = float(np.clip(np.mean([y for _, _, y in rows]), 0.02, 0.98))
    m.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, RANK), 1e-2, np.float32), 1e-2
    for _ in range(max(epochs, min(10 * epochs, steps * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            some = [rows[j] for j in order[i : i + batch]]
            sizes = np.array([len(x[0]) for x in some])
            index, value = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
            y = np.array([x[2] for x in some])
            raw, sums = m.raw(np.r_[0, np.cumsum(sizes)], index, value)
            error = ((logistic(raw) - y) / len(some)).astype(np.float32)
            row = np.repeat(np.arange(len(some)), sizes)
            used, place = np.unique(index, return_inverse=True)
            g = error[row] * value
            grad_w = np.bincount(place, g, len(used)).astype(np.float32) + decay * m.linear[used]
            per = g[:, None] * (sums[row] - m.factors[index] * value[:, None])
            grad_v = np.stack([np.bincount(place, per[:, k], len(used)) for k in range(RANK)], 1).astype(np.float32) + decay * m.factors[used]
            seen_w[used] += grad_w * grad_w
            seen_v[used] += grad_v * grad_v
            m.linear[used] -= rate * grad_w / np.sqrt(seen_w[used])
            m.factors[used] -= 0.3 * rate * grad_v / np.sqrt(seen_v[used])
            step = float(error.sum())
            seen_b += step * step
            m.bias -= rate * step / seen_b**0.5
    return m


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 4_000, seed: int = 11) -> Machine:
    """Learn labels(doc_id, label) of docs(doc_id, text, n_chars); rows that are held out are never read for it."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # at most sample_rows small rows: a bounded broadcast; the texts aren't shuffled
    chosen = docs.select("doc_id", "n_chars", "text").join(F.broadcast(known), "doc_id")
    schema = "doc_id long, label double, place long, index binary, value binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("place", pa.int64()), ("index", pa.binary()), ("value", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Powers(BASE)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", RUN_BYTES):
                col = lambda c, r=rows: r.column(r.schema.get_field_index(c)).to_pylist()
                first, index, value = features_of(data, offsets, col("n_chars"), p)
                cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip((
                        col("doc_id"), col("label"), [b - a for a, b in cut], [index[a:b].astype("<i4").tobytes() for a, b in cut],
                        [value[a:b].astype("<f4").tobytes() for a, b in cut],
                    ), arrow.types, strict=True)], schema=arrow)

    found = chosen.mapInArrow(giving_back(extract), schema).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("index", "value")).limit(sample_rows).collect()
    return learn([(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4"), r["label"]) for r in found], seed=seed)


def _scorer(shared, keep: float | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p = Machine(*shared.value), Powers(BASE)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", RUN_BYTES):
                n_chars = rows.column(rows.schema.get_field_index("n_chars")).to_pylist()
                raw, _ = m.raw(*features_of(data, offsets, n_chars, p))
                scores = pa.array(logistic(raw).astype(np.float64))
                if keep is not None:
                    yield rows.filter(pa.array(logistic(raw) >= keep))
                else:
                    yield pa.RecordBatch.from_arrays([scores if c == "score" else rows.column(rows.schema.get_field_index(c)) for c in names], names=names)

    return giving_back(run)


def score(docs: DataFrame, machine: Machine, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns of docs(text, n_chars, ...) and score."""
    read = docs.select(*dict.fromkeys([*columns, "n_chars", "text"]))
    out = read.withColumn("score", F.lit(0.0)).select(*columns, "score").schema
    return read.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors)), None, out.fieldNames()), out)


def keep_good(docs: DataFrame, machine: Machine, least: float) -> DataFrame:
    """The rows of docs whose score reaches least."""
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors)), least, []), docs.schema)
