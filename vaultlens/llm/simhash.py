"""SimHash near-duplicates: fingerprints linked within a few bits, by multi-index hashing.

A document's fingerprint has the bits that are set in over half of the XXH64 hashes of its word shingles.  Documents with
one fingerprint are collapsed first; all that follows works on different fingerprints.

Search, for links of up to 3 bits: a fingerprint has two segments of 32 bits, and in one of them two linked fingerprints
differ by one bit at most.  A table holds every fingerprint under the value of each segment.  Each fingerprint looks up
the Hamming ball of radius 1 around its own value in each segment (of the two fingerprints of a pair, the one whose
differing bit is 0 asks, so half the ball is enough), fetches what the table has there, and the whole distance decides.

A table entry may be crowded: many different fingerprints that share half their bits.  Entries with more than
``crowded`` fingerprints are left out of the lookups.  All fingerprints whose balls touch one are searched another exact
way: two fingerprints differ by at most 2 bits if and only if the balls of radius 1 around the whole fingerprints meet.
A whole 64-bit value has 65 fingerprints within one bit at most, so no group can grow, and all of a group are linked; the
least of a group stands for its links.  For 3 bits the meeting balls have radii 1 and 2.

Spark sizes an exploded table as the one before it, so it would broadcast 17 or 65 times what it takes for small; joins of
balls are told to merge sorted sides, whatever their size.

Links are contracted to components by star contraction; no link, component or fingerprint list comes to the driver.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other; fewer words than a
shingle make one shingle of all; repeated shingles count as often as they stand there; repeated rows share a component;
rows without id are kept, with the component of the least id, or null if there is none; an empty table gives no rows;
other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import use_shared_dir

SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are counted at once.
RUN = 60_000
LOW_HALF = 0xFFFFFFFF


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every shingle of a text, in order."""
    from xxhash import xxh64_intdigest

    own = text.translate(LOWER).split()  # bytes split at ASCII white space only
    if not own:
        return []
    joined = b" ".join(own)
    if len(own) <= words:
        return [xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints_of(texts: list[bytes], words: int) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit numbers."""
    return fingerprints_of_hashes((np.array(shingle_hashes(text, words), np.uint64) for text in texts), len(texts))


def fingerprints_of_hashes(every: Iterable[np.ndarray], n: int) -> np.ndarray:
    """The fingerprint of each of n lists of shingle hashes."""
    out = np.zeros((n, 64), bool)
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def count() -> None:
        flat = np.concatenate([own for _, own in waiting])
        sizes = np.array([len(own) for _, own in waiting])
        bits = np.add.reduceat(_bit_counts(flat), np.r_[0, np.cumsum(sizes)[:-1]], axis=0, dtype=np.int64)
        out[[i for i, _ in waiting]] = 2 * bits > sizes[:, None]

    for i, own in enumerate(every):
        if len(own) > RUN:  # a very long text: its bits are counted run by run
            total = sum(_bit_counts(own[a : a + RUN]).sum(0, dtype=np.int64) for a in range(0, len(own), RUN))
            out[i] = 2 * total > len(own)
        elif len(own):
            waiting.append((i, own))
            held += len(own)
            if held >= RUN:
                count()
                waiting, held = [], 0
    if waiting:
        count()
    return np.packbits(out, axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(docs: DataFrame, *, words: int = 5) -> DataFrame:
    """doc_id and fp, a signed 64-bit fingerprint, of docs(doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                some = batch.slice(at, 1_000)
                texts = [t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(fingerprints_of(texts, words))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _segments() -> Column:
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(LOW_HALF)
    return F.array(F.struct(F.lit(0).alias("seg"), high.alias("val")), F.struct(F.lit(1).alias("seg"), low.alias("val")))


def _ball(value: Column, bits: int, *, zeros_only: bool = False) -> Column:
    """value and the values one bit away; zeros_only: those with one more bit set."""
    flips = F.array(*(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(bits)))
    if zeros_only:
        flips = F.filter(flips, lambda m: value.bitwiseAND(m) == 0)
    return F.concat(F.array(value), F.transform(flips, lambda m: value.bitwiseXOR(m)))


def links(fps: DataFrame, *, distance: int = 2, crowded: int = 64) -> DataFrame:
    """Edges (u, v) between different fingerprints of fps(fp): enough of them to connect all that differ by distance bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 find up to 3 bits")
    held = fps.select("fp", F.explode(_segments()).alias("s")).select("fp", "s.seg", "s.val")
    full = held.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("seg", "val").checkpoint()
    any_full = not full.isEmpty()
    cool = held.join(full, ["seg", "val"], "left_anti") if any_full else held
    asked = cool.select("fp", "seg", "val", F.explode(_ball(F.col("val"), 32, zeros_only=True)).alias("at"))
    probe = asked.select(F.col("fp").alias("u"), "seg", F.col("at"), (F.col("at") == F.col("val")).alias("same"))
    entry = cool.select(F.col("fp").alias("v"), "seg", F.col("val").alias("at"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    found = probe.join(entry.hint("merge"), ["seg", "at"]).where(near & (~F.col("same") | (F.col("u") < F.col("v")))).select("u", "v")
    if not any_full:
        return found
    touching = held.select("fp", "seg", F.explode(_ball(F.col("val"), 32)).alias("val")).join(full, ["seg", "val"], "left_semi").select("fp").distinct().checkpoint()
    return found.union(_meeting_balls(touching, distance))


def _meeting_balls(fps: DataFrame, distance: int) -> DataFrame:
    """Star edges between fingerprints whose balls of radius 1 (for 3 bits: 1 and 2) share a value."""
    ball = fps.select("fp", F.explode(_ball(F.col("fp"), 64)).alias("at"))
    least = ball.groupBy("at").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where(F.col("n") > 1)
    edges = ball.join(least.hint("merge"), "at").where(F.col("fp") != F.col("m")).select(F.col("fp").alias("u"), F.col("m").alias("v"))
    if distance < 2:
        edges = edges.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
        own = ball.join(fps.select(F.col("fp").alias("at")).hint("merge"), "at").where(F.col("fp") != F.col("at"))
        return own.select(F.col("fp").alias("u"), F.col("at").alias("v")) if distance else edges
    if distance == 3:
        outer = ball.select("fp", F.explode(_ball(F.col("at"), 64)).alias("at")).distinct()
        more = outer.join(least.select("at", "m").union(ball.select("at", F.col("fp").alias("m"))).distinct().hint("merge"), "at")
        edges = edges.union(more.where((F.col("fp") != F.col("m")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("m"))) <= 3)).select(F.col("fp").alias("u"), F.col("m").alias("v")))
    return edges


def near_duplicates(docs: DataFrame, *, words: int = 5, distance: int = 2, crowded: int = 64) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links, the document itself included)."""
    use_shared_dir(docs.sparkSession)
    own = fingerprints(docs, words=words).checkpoint()
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"), distance=distance, crowded=crowded))
    tied = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tied.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, *, words: int = 5, distance: int = 3) -> DataFrame:
    """docs without the documents that a component keeps another of: the one with the least id stays.

    Rows that repeat that id are thinned to one, the least by a hash of its text.
    """
    near = near_duplicates(docs, words=words, distance=distance)
    dropped = near.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    # ids that stand in several rows; without any, which is the rule, nothing more is needed
    again = near.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col("doc_id").isNotNull()).select("doc_id").checkpoint()
    kept = docs.join(dropped.distinct(), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    single = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    several = kept.join(again, "doc_id", "left_semi").select(*docs.columns)
    least = several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row"))
    return single.union(least.select("row.*"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
