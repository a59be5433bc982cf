"""Benchmark decontamination with suffix arrays of the training words.

Each run of training documents (about ``shard_bytes`` of text) becomes a shard: its words, lower-cased in A-Z, are hashed
to 64-bit numbers, and its suffixes are sorted by their first ``window`` words.  The array is sparse: suffixes whose
first two words (first word, for items of one word) start no benchmark suffix can't match one and are left out.  Every
different window that begins a benchmark suffix is binary-searched in every shard, once however many suffixes it begins,
which gives the training places where it stands.  Neighbouring places are joined to the longest verbatim match by
following the benchmark suffixes, as one set, from word to word: the set shrinks where suffixes end or differ, and those
that leave it have met their longest match.  So what is found grows with the training words that are hit, never with
their product with the suffixes that hit them.  All words inside a match are hit.

The benchmark is cut into blocks of at most ``block_bytes`` of text.  One block is on the driver, broadcast and in a task
at a time.  With one block, which is the rule, nothing is shuffled; with several, there is a job for each, whose matches
are written to the shared folder by text, and joined at the end.

Defined results: null or empty texts have no words and no hits; an item of fewer words than a window, but not none, is
one window; items with the same words are searched once and all named; repeated rows each count; an item without id hits
but isn't named; empty tables give no hits or no rows.  A match names the items that have it from its first word to its
last; an item is named again in a document only by a match that begins where its last one ended, or later.  Other columns
never take part: decontaminate keeps them, find_matches leaves out those that are called like its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .arrow_text import slices
from .hashing import BASE, U64, Powers, Words, byte_table, mixed
from .shared import free_name, giving_back, new_folder

SHARD_BYTES = 4_000_000
BLOCK_BYTES = 8_000_000

_BYTES = np.arange(256, dtype=np.uint8)
LOWERED = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words: digits, letters, and all of non-ASCII characters.
IN_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((LOWERED >= 0x61) & (LOWERED <= 0x7A)) | (_BYTES >= 0x80)
VALUES = byte_table(6)[LOWERED]


def words_of(data: np.ndarray, offsets: np.ndarray, p: Powers) -> Words:
    return hashing.words_of(data, offsets, p, inside=IN_WORD, values=VALUES)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * U64(BASE) + b)


class TestBlock:
    """The suffixes of a block of benchmark items."""

    __test__ = False

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        texts = [(t or "").encode() for _, t in items]
        found = words_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), Powers(BASE))
        same: dict[bytes, list] = {}
        for i, (item_id, _) in enumerate(items):
            own = found.hashes[found.first[i] : found.first[i + 1]]
            if len(own):
                same.setdefault(own.tobytes(), []).append(item_id)
        self.window = window
        self.ids = [sorted({i for i in ids if i is not None}) for ids in same.values()]
        own = [np.frombuffer(x, np.uint64) for x in same]
        sizes = np.array([len(x) for x in own], np.int64)
        self.hashes = np.concatenate([*own, np.zeros(window, np.uint64)]) if own else np.zeros(window, np.uint64)
        firsts = np.cumsum(sizes) - sizes
        need = np.minimum(sizes, window)
        counts = sizes - need + 1
        # suffixes of at least a window
        start = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        needs = np.repeat(need, counts)
        self.item_of = np.zeros(len(self.hashes) + 1, np.int64)  # of each word
        self.item_of[: int(sizes.sum())] = np.repeat(np.arange(len(own)), sizes)
        steps = np.arange(window)
        rows = np.where(steps < needs[:, None], self.hashes[np.minimum(start[:, None] + steps, len(self.hashes) - 1)], U64(0))
        # the different windows, and the suffixes that each begins, in order of their places
        order = np.lexsort((start, *rows.T[::-1], needs))
        rows, start, needs = rows[order], start[order], needs[order]
        new = np.ones(len(rows), bool)
        new[1:] = (needs[1:] != needs[:-1]) | (rows[1:] != rows[:-1]).any(1)
        at = np.flatnonzero(new)
        self.rows, self.need, self.starts, self.bounds = rows[at], needs[at], start, np.r_[at, len(rows)]
        # the window that follows a window, if it does so for each of its suffixes, else -1
        kind = np.full(len(self.hashes) + 2, -1, np.int64)
        full = needs == window
        kind[start[full]] = (np.cumsum(new) - 1)[full]
        follows = np.where(full & (self.item_of[start + 1] == self.item_of[start]), kind[start + 1], -1)
        count = np.diff(self.bounds)
        self.next = np.full(len(at), -1, np.int64)
        if len(at):
            low, high = np.minimum.reduceat(follows, at), np.maximum.reduceat(follows, at)
            same = (low == high) & (low >= 0)
            same[same] = count[low[same]] == count[same]
            self.next = np.where(same, low, -1)
        two = self.need > 1
        second = np.where(two, self.rows[:, min(1, window - 1)], U64(0)) if window > 1 else np.zeros(len(two), np.uint64)
        key = _pair(self.rows[:, 0], second) if len(at) else np.zeros(0, np.uint64)
        self.keys, self.single = np.unique(key[two]), np.unique(self.rows[~two, 0])
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.keys >> U64(42)] = True

    @classmethod
    def of(cls, fields: dict) -> TestBlock:
        """A block from its fields: broadcasts hold plain values, so that workers need no module of ours."""
        block = cls.__new__(cls)
        vars(block).update(fields)
        return block


def suffix_array(words: Words, test: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix starts in order, their first words, the end of each word's text) of a shard."""
    h, n = words.hashes, len(words.hashes)
    end = np.repeat(words.first[1:], np.diff(words.first))
    following = np.r_[h[1:], U64(0)] if n else h
    following = np.where(np.arange(1, n + 1) < end, following, U64(0))
    key = _pair(h, following)
    keep = np.flatnonzero(test.sieve[key >> U64(42)])
    keep = keep[np.isin(key[keep], test.keys)]
    if len(test.single):
        keep = np.union1d(keep, np.flatnonzero(np.isin(h, test.single)))
    steps = keep[:, None] + np.arange(test.window)
    rows = np.where(steps < end[keep][:, None], h[np.minimum(steps, max(n - 1, 0))], U64(0)) if n else np.zeros((0, test.window), np.uint64)
    order = np.lexsort(rows.T[::-1])
    return keep[order], rows[order], end


def _bound(rows: np.ndarray, wanted: np.ndarray, need: np.ndarray, past: bool) -> np.ndarray:
    """Binary search of every wanted row by its first need words: the first row not below it, or the first above."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(rows), np.int64)
    for _ in range(len(rows).bit_length()):
        open_ = low < high
        mid = (low + high) >> 1
        at = np.minimum(mid, len(rows) - 1)
        below, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for k in range(rows.shape[1]):
            a, b, counts = rows[at, k], wanted[:, k], k < need
            below |= equal & counts & (a < b)
            equal &= ~counts | (a == b)
        right = open_ & (below | (equal & past))
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def places(words: Words, test: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, training word, end of that word's text) of every place of every benchmark window, in order of places."""
    starts, rows, end = suffix_array(words, test)
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(test.need):
        return none, none, none
    there = np.flatnonzero(np.isin(test.rows[:, 0], rows[:, 0]))
    low = _bound(rows, test.rows[there], test.need[there], False)
    counts = _bound(rows, test.rows[there], test.need[there], True) - low
    kind = np.repeat(there, counts)
    at = starts[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
    order = np.lexsort((test.need[kind], at))
    return kind[order], at[order], end[at[order]]


class Chains:
    """Sets of benchmark places that match up to a training word, followed from window to window.

    Sets are numbered, and what becomes of a set is remembered, so a passage of many documents is followed once.
    """

    MOST = 2_000_000  # places remembered

    def __init__(self, test: TestBlock):
        self.test = test
        self.forget()

    def forget(self) -> None:
        self.sets: list[np.ndarray] = []
        self.held = 0
        self.number: dict[bytes, int] = {}
        self.steps: dict[tuple[int, int], tuple[int | None, int | None, int | None]] = {}
        self.names: dict[int, tuple[int, ...]] = {}

    def of(self, places: np.ndarray) -> int:
        n = self.number.setdefault(places.tobytes(), len(self.sets))
        if n == len(self.sets):
            self.sets.append(places)
            self.held += len(places)
        return n

    def window(self, kind: int, without: frozenset[int] = frozenset()) -> int | None:
        """The set of a window's places, without those in some items; none if there are no others."""
        t = self.test
        own = t.starts[t.bounds[kind] : t.bounds[kind + 1]]
        if without:
            own = own[[i not in without for i in t.item_of[own].tolist()]]
        return self.of(own) if len(own) else None

    def items(self, number: int) -> tuple[int, ...]:
        if number not in self.names:
            self.names[number] = tuple(np.unique(self.test.item_of[self.sets[number]]).tolist())
        return self.names[number]

    def step(self, number: int, kind: int) -> tuple[int | None, int | None]:
        """(what of a set goes on with a window that comes a word later, what of its items ends)."""
        if (number, kind) not in self.steps:
            own, t = self.sets[number], self.test
            on = np.intersect1d(own + 1, t.starts[t.bounds[kind] : t.bounds[kind + 1]], assume_unique=True)
            going = on[t.item_of[on] == t.item_of[on - 1]]
            ends = own[~np.isin(t.item_of[own], t.item_of[going])]
            self.steps[number, kind] = (self.of(going) if len(going) else None, self.of(ends) if len(ends) else None)
        return self.steps[number, kind]


def longest_matches(words: Words, test: TestBlock, chains: Chains) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(text, first word in it, length, item groups) of the longest matches of at least a window."""
    kind, at, end = places(words, test)
    if not len(kind):
        return []
    out: list[tuple[int, int, int, tuple[int, ...]]] = []
    doc = np.searchsorted(words.first, at, side="right") - 1
    short = test.need[kind] < test.window
    for d, a, k in zip(doc[short].tolist(), (at - words.first[doc])[short].tolist(), kind[short].tolist(), strict=True):
        out.append((d, a, int(test.need[k]), chains.items(chains.window(k))))
    kind, at, doc = kind[~short], at[~short], doc[~short]
    if not len(kind):
        return out
    # runs in which all suffixes of a window go on to the next
    beside = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1])
    joined = beside & (test.next[kind[:-1]] == kind[1:])
    first = np.flatnonzero(np.r_[True, ~joined])
    last = np.r_[first[1:], len(kind)] - 1
    begins_anew = np.r_[True, ~beside][first]
    w = test.window
    going: list[tuple[int, int]] = []  # (first word, set of places of the last window) of open matches
    seen: frozenset[int] = frozenset()  # their item groups
    before, d = -1, -1
    for i, j, anew in zip(first.tolist(), last.tolist(), begins_anew.tolist(), strict=True):
        k, a = int(kind[i]), int(at[i])
        if anew:
            out += [(d, x, before + w - x, chains.items(own)) for x, own in going]
            going, seen = [], frozenset()
            d = int(doc[i])
            if chains.held > Chains.MOST:
                chains.forget()
        kept = []
        for x, own in going:
            on, ends = chains.step(own, k)
            if ends is not None:
                out.append((d, x, before + w - x, chains.items(ends)))
                seen -= set(chains.items(ends))
            if on is not None:
                kept.append((x, on))
        going = kept
        own = chains.window(k)
        if seen and not seen.issuperset(chains.items(own)):
            own = chains.window(k, seen)
        if not seen or not seen.issuperset(chains.items(own)):
            going.append((a, own))
            seen |= set(chains.items(own))
        if j > i:
            going = [(x, chains.of(chains.sets[own] + (j - i))) for x, own in going]
        before = int(at[j])
    out += [(d, x, before + w - x, chains.items(own)) for x, own in going]
    return [(e, a - int(words.first[e]) if n >= w else a, n, items) for e, a, n, items in out]


MATCHES = "array<struct<item_ids:array<long>,first_word:int,n_words:int>>"
#: Ids that a batch of results names.
IDS = 2_000_000


def _block(benchmark: DataFrame, window: int, i: int, n: int) -> TestBlock:
    """Block i of n of benchmark(item_id, text): bounded, so it may come to the driver."""
    own = benchmark.where((F.length("text") > 0) & (F.pmod(F.xxhash64("text"), F.lit(n)) == i)).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return TestBlock(sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), window)


def find_matches(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, keep_text: bool = True
) -> DataFrame:
    """docs (without text, if it isn't kept) and n_words int, matches: the longest verbatim matches with the benchmark, of at least a window.

    A match has the ids of the items that hold it (equal items share one), its first word in the document and its length.
    """
    left = [c for c in docs.columns if c.lower() not in ("n_words", "matches")]
    found, n_words, matches = _found(docs.select(*left), benchmark, window, shard_bytes, block_bytes, keep_text)
    return found.select(*(c for c in left if keep_text or c != "text"), F.col(n_words).alias("n_words"), F.col(matches).alias("matches"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, shard_bytes: int, block_bytes: int, keep_text: bool) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and these columns' names, which docs has not."""
    n_words, matches = free_name(docs, "n_words"), free_name(docs, "matches")
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        return _searched(docs, _block(benchmark, window, 0, 1), shard_bytes, n_words, matches, keep_text), n_words, matches
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "matches")
    key = lambda t: (F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(window), t, F.octet_length(t)).alias("k2"))
    texts = docs.select("text").where(F.length("text") > 0)
    for i in range(blocks):  # one block after the other, each with a broadcast of its own
        block = _block(benchmark, window, i, blocks)
        own = _searched(texts, block, shard_bytes, "n_words", "matches", True).where(F.size("matches") > 0)
        own.select(*key(F.col("text")), "matches").dropDuplicates(["k1", "k2"]).write.mode("append").parquet(folder)
    k1, k2, more = (free_name(docs, c) for c in ("k1", "k2", "more"))
    every = spark.read.parquet(folder).groupBy("k1", "k2").agg(F.flatten(F.collect_list("matches")).alias(more)).withColumnsRenamed({"k1": k1, "k2": k2})
    counted = _searched(docs, TestBlock([], window), shard_bytes, n_words, matches, True)
    one, two = key(F.col("text"))
    keyed = counted.withColumn(k1, one).withColumn(k2, two)
    joined = keyed.join(every, [k1, k2], "left").select(*(c for c in docs.columns if keep_text or c != "text"), n_words, F.coalesce(more, matches).alias(matches))
    return joined, n_words, matches


def _searched(docs: DataFrame, block: TestBlock, shard_bytes: int, n_words: str, matches: str, keep_text: bool) -> DataFrame:
    out = docs.withColumn(n_words, F.lit(0)).withColumn(matches, F.lit(None).cast(MATCHES))
    schema = out.schema if keep_text else out.drop("text").schema
    shared = docs.sparkSession.sparkContext.broadcast(vars(block))
    return docs.mapInArrow(_search(shared, shard_bytes, n_words, matches, schema.fieldNames()), schema)


def _matches(found: list[list[tuple]], ids: list[list[int]], named: dict[tuple[int, ...], np.ndarray]) -> pa.Array:
    """The matches column of some documents."""
    every = [m for own in found for m in own]
    for _, _, items in every:
        if items not in named:
            named[items] = np.unique(np.array([i for k in items for i in ids[k]], np.int64))
    parts = [named[items] for _, _, items in every]
    names = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))
    rows = pa.StructArray.from_arrays([names, pa.array([a for a, _, _ in every], pa.int32()), pa.array([n for _, n, _ in every], pa.int32())], names=["item_ids", "first_word", "n_words"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), rows)


def _search(shared, shard_bytes: int, n_words: str, matches: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, p = TestBlock.of(shared.value), Powers(BASE)
        chains, named = Chains(test), {}
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", shard_bytes):
                words = words_of(data, offsets, p)
                found: list[list[tuple]] = [[] for _ in range(rows.num_rows)]
                cost = np.zeros(rows.num_rows, np.int64)
                for d, a, n, items in longest_matches(words, test, chains):
                    found[d].append((a, n, items))
                    cost[d] += sum(len(test.ids[k]) for k in items)
                counts, named = np.diff(words.first), named if len(named) < 10_000 else {}
                # results in runs that name a bounded number of ids
                run_of = np.cumsum(cost) // IDS
                cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), rows.num_rows]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    put = {n_words: pa.array(counts[x:y], pa.int32()), matches: _matches(found[x:y], test.ids, named)}
                    some = rows.slice(x, y - x)
                    yield pa.RecordBatch.from_arrays([put[c] if c in put else some.column(some.schema.get_field_index(c)) for c in kept], names=kept)

    return giving_back(run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents that hold a window of the benchmark."""
    found, _, matches = _found(docs, benchmark, window, shard_bytes, block_bytes, True)
    return found.where(F.size(matches) == 0).select(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from find_matches' rows."""
    ids = F.array_distinct(F.flatten(F.transform("matches", lambda m: m["item_ids"])))
    names = F.array_join(F.array_sort(F.transform(ids, lambda i: i.cast("string"))), ",")
    # words under the union of the matches: in order of their starts, each adds what lies past the furthest end so far
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["first_word"].alias("a"), (m["first_word"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    add = lambda s, m: F.struct((s["hit"] + F.greatest(F.lit(0), m["b"] - F.greatest(m["a"], s["end"]))).alias("hit"), F.greatest(s["end"], m["b"]).alias("end"))
    n_hit = F.aggregate(spans, start, add)["hit"].cast("long")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
