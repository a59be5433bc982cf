"""Detection over chunk tables: chunks -> hits -> one detection for each value of a file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultlens.functions.text import any_of

from .spans import Detector, Settings, hits_of, normal_text, wanted

HITS = (
    "file_id string, norm_idx int, family string, category string, detector_id string, confidence string, validation string, start int, end int, "
    "raw_value string, normalized_value string, value_hash string, masked_preview string, fragment string, keywords array<string>, "
    "location_hints array<string>, order_key array<int>"
)
HIT_FIELDS = [
    ("family", pa.string()), ("category", pa.string()), ("detector_id", pa.string()), ("confidence", pa.string()), ("validation", pa.string()),
    ("start", pa.int32()), ("end", pa.int32()), ("raw_value", pa.string()), ("normalized_value", pa.string()), ("value_hash", pa.string()),
    ("masked_preview", pa.string()), ("fragment", pa.string()), ("keywords", pa.list_(pa.string())), ("location_hints", pa.list_(pa.string())),
    ("order_key", pa.list_(pa.int32())),
]
HIT_SCHEMA = pa.schema([("file_id", pa.string()), ("norm_idx", pa.int32()), *HIT_FIELDS])


def numbered(chunks: DataFrame, settings: Settings) -> DataFrame:
    """chunks(file_id, raw_idx, text) with norm_idx counted over them, as many as a file may have; they may not be blank."""
    place = F.row_number().over(W.partitionBy("file_id").orderBy("raw_idx"))
    return chunks.withColumn("place", place).where(F.col("place") <= settings.max_chunks).select("file_id", "raw_idx", (F.col("place") - 1).alias("norm_idx"), "text")


#: Texts with such characters may change when they are normalised: no gate holds for them.
UNSTABLE = (
    r"[^\x00-\x7F\x{00AB}\x{00BB}\x{00C0}-\x{00FF}\x{0400}-\x{045F}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}-\x{201E}]"
)


def gates(texts: pa.Array, detectors: list[Detector]) -> list[np.ndarray]:
    """For each detector, in which texts it could find anything, by what a text must have for it.  No text becomes a Python string.

    Case is ignored: within the characters that gates hold for, that is to look at the text in lower case.
    """

    def left(at: np.ndarray, pattern: str, ignore_case: bool = True) -> np.ndarray:
        own = texts if len(at) == len(texts) else texts.take(pa.array(at))
        found = pc.match_substring_regex(own, pattern, ignore_case=ignore_case)
        return at[pc.fill_null(found, False).to_numpy(zero_copy_only=False)]

    # blanks may differ before normalising, so of an entry only its longest word counts
    longest = lambda entry: max(entry.split(), key=len)
    every = np.arange(len(texts))
    loose, digits, out = left(every, UNSTABLE, False), left(every, r"\d"), []
    for d in detectors:
        # automata never go back, so nothing is possessive; where a pattern has a digit, all of its branches have
        pattern = (d.gate.pattern or "").replace("*+", "*")
        at = digits if r"\d" in pattern else every
        for needed in [*([pattern] if pattern else []), *(any_of([*map(longest, g)]) for g in d.gate.groups)]:
            at = left(at, needed)
        may = np.zeros(len(texts), dtype=bool)
        may[at] = may[loose] = True
        out.append(may)
    return out


def may_have(text: Column, detectors: list[Detector]) -> Column:
    """Whether a detector could find anything in a text; decided in Arrow batches."""
    run = lambda texts: pa.array(np.logical_or.reduce([np.zeros(len(texts), dtype=bool), *gates(texts, detectors)]))
    return F.arrow_udf(run, "boolean", F.ArrowUDFType.SCALAR)(text)


def _found_in(chunks: DataFrame, settings: Settings, categories: tuple[str, ...] | None) -> DataFrame:
    """Every hit of chunks(file_id, norm_idx, text) that passed the gate, by the detectors whose own gate they pass."""
    detectors = wanted(settings, categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            may = zip(*gates(batch.column(2), detectors), strict=True)
            for file_id, index, text, own in zip(*(c.to_pylist() for c in batch.columns), may, strict=True):
                hits = hits_of(normal_text(text), index, settings, [d for d, m in zip(detectors, own, strict=True) if m])
                out += [(file_id, index, *(h[name] for name, _ in HIT_FIELDS)) for h in hits]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), HIT_SCHEMA.types, strict=True)], schema=HIT_SCHEMA)

    found = chunks.select("file_id", "norm_idx", "text").mapInArrow(run, HITS)
    return found if categories is None else found.where(F.col("category").isin(*categories))


def hits_in(chunks: DataFrame, settings: Settings, categories: tuple[str, ...] | None = None) -> DataFrame:
    """Every hit of chunks(file_id, norm_idx, text).  Only texts that may have any become Python strings."""
    return _found_in(chunks.where(may_have(F.col("text"), wanted(settings, categories))), settings, categories)


def find_hits(chunks: DataFrame, settings: Settings, categories: tuple[str, ...] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Every hit of chunks(file_id, raw_idx, text), with raw and normalised values, which no sink may show.

    categories: only these are looked for, by the detectors that can find them.  files(file_id): only theirs.
    Chunks are numbered by file after the gate, so that texts in which nothing can be found aren't shuffled.
    """
    filled = chunks.where(F.col("text").rlike(r"(?U)\S"))
    gated = filled.select("file_id", "raw_idx", F.when(may_have(F.col("text"), wanted(settings, categories)), F.col("text")).alias("text"))
    if files is not None:
        gated = gated.join(files.select("file_id"), "file_id", "left_semi")
    return _found_in(numbered(gated, settings).where(F.col("text").isNotNull()), settings, categories)


def places_of(hits: DataFrame) -> DataFrame:
    """Every place of a value, a row each: a value may stand in a file any number of times."""
    return hits.select(
        "file_id", "family", "category", "value_hash", "order_key", F.col("norm_idx").alias("chunk_index"), F.col("start").alias("start_char"),
        F.col("end").alias("end_char"), "fragment",
    )


#: What a detection has of the first hit of its value.
FIRST = ("detector_id", "confidence", "validation", "masked_preview", "fragment", "raw_value", "norm_idx", "start", "end", "order_key")


def deduplicate(hits: DataFrame, first: Sequence[str] = FIRST) -> DataFrame:
    """One row for each (file, family, category, hash); null hashes are one value.  What isn't merged is the first hit's.

    first: those of its fields that are wanted.  Hints and keywords are gathered as different lists; places_of has the places.
    Hits are dealt out by value before they are merged: sets of lists can only be merged by sorting, and sorting what a
    task reads, however much that is, spilled more than the hits themselves take.
    """
    value = ("file_id", "family", "category", "value_hash")
    own = hits.select(*value, "location_hints", "keywords", *dict.fromkeys((*first, "order_key"))).repartition(*value)
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return (
        own.groupBy(*value)
        .agg(
            F.count("*").alias("occurrences"), joined("location_hints").alias("location_hints"), joined("keywords").alias("keywords"),
            F.min_by(F.struct(*first), "order_key").alias("f"),
        )
        .select(*value, "occurrences", "location_hints", "keywords", *(F.col(f"f.{c}").alias(c) for c in first))
    )


def detect(chunks: DataFrame, settings: Settings | None = None, files: DataFrame | None = None) -> DataFrame:
    return deduplicate(find_hits(chunks, settings or Settings(), files=files))
