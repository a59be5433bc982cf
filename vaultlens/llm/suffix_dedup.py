"""Suffix-array dedup: removal of every byte that a repeated ``length``-byte string covers.

Equal groups of suffixes are told apart only through ``length`` bytes, in passes that drop groups of one at once.  These
aren't the byte-ordered passes of a radix sort, which would have to shuffle a first digit for every byte of the corpus (8
bytes each: 14 times the stored size of the check tables).  What is passed on instead is a long piece of a suffix,
wherever it lies, so that most suffixes of a corpus never travel:

1. The first piece of a suffix is its anchor, the least hash of the ``gram``-byte strings inside the first ``length``
   bytes (leftmost if there are several).  Neighbouring suffixes with one anchor form a segment.  Equal windows have
   equal anchors, so a segment whose anchor is nowhere else holds no repeat: most of a corpus ends here.
2. The second piece is the segment's whole text.  Segments that are equal elsewhere are repeated throughout; if all of an
   anchor's segments are equal, that is all there is to know.
3. Only where an anchor has several different segments are their suffixes sorted by their whole first ``length`` bytes:
   those of each segment text that is alone, and those of one of each repeated text.  Equal groups are the repeated
   windows.

Pieces ("digits" below) travel as 64-bit hashes and are equal if these are: an anchor by its own; a segment by its own
and its anchor's, 128 bits; a window by its own and half of its anchor's, 96 bits.  Bytes aren't compared again.

Two lanes go through the same passes: windows of bytes, and, if asked for, windows of words that stand in several rows,
which tell the passages that documents share.

Texts are dealt into units of about ``unit_bytes`` by a hash of the row.  A unit sends each different digit once, with
whether it has it twice, and gets back what it needs to know by digit, not by place; so a passage that a third of all
documents share is one entry a unit, and nothing depends on the order of rows, which makes lost tasks repeatable.  Digits
are dealt to buckets by their hash.  The unit's texts are shuffled once: the three passes reuse one exchange.

Defined results: null text is empty; texts shorter than ``length`` have no windows; matches never cross documents;
repeated rows repeat each other's windows; overlaps inside a document count; an empty table gives no rows; other columns
never take part.  What is kept is bytes: a span may begin or end inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices
from .hashing import BASE, SECOND_BASE, U64, Powers, byte_table, mixed, prefix_hashes, sliding_min, window_hashes, words_of

CHUNK_BYTES = 2_000_000
UNIT_BYTES = 8_000_000
VALUES = byte_table(8)
HASH32 = U64(0xFFFFFFFF)
#: Bytes of words: all but white space.
IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Kinds of digits in a lane: anchors, segments, windows.
KINDS = 3
#: What is said of digits: of anchors, of segments, of windows.
ALIKE, MIXED, FIRST, COPY, REPEATED = "alike", "mixed", "first", "copy", "repeated"
DIGITS = "bucket int, kind int, unit long, main binary, side binary, flags binary"
DIGIT_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("unit", pa.int64()), ("main", pa.binary()), ("side", pa.binary()), ("flags", pa.binary())])
ANSWERS = "unit long, lane int, said string, main binary"
ANSWER_SCHEMA = pa.schema([("unit", pa.int64()), ("lane", pa.int32()), ("said", pa.string()), ("main", pa.binary())])


@dataclass(frozen=True)
class Lane:
    """What is sorted: windows of length bytes, or of words; across: only what stands in several rows is a repeat."""

    length: int
    gram: int
    words: bool = False
    across: bool = False


class Segments:
    """The segments of several texts in a row: runs of windows [start, end) with one anchor.

    values are the texts' bytes or words as 64-bit numbers; row: the text that a segment stands in.
    """

    def __init__(self, values: np.ndarray, offsets: np.ndarray, length: int, gram: int, p: Powers):
        self.length, self.p, self.offsets, n = length, p, offsets, len(values)
        self.start = self.end = self.row = np.zeros(0, np.int64)
        self.anchor = self.text = self.key = np.zeros(0, np.uint64)
        if n < length:
            return
        self.prefix = prefix_hashes(values, p)
        grams = mixed(window_hashes(self.prefix, gram, p))
        least = sliding_min(grams, length - gram + 1)
        inside = np.zeros(n + 1, np.int32)  # windows that don't leave their text
        sizes = np.diff(offsets)
        long_ = sizes >= length
        np.add.at(inside, offsets[:-1][long_], 1)
        np.add.at(inside, (offsets[1:] - length + 1)[long_], -1)
        inside = np.cumsum(inside[: len(least)]) > 0
        # a new segment where the anchor changes, where it was left behind, and at a text's first window
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | ~inside[:-1]
        first = offsets[:-1][long_]
        new[first] = True
        edge = np.flatnonzero(new)
        ends = np.r_[edge[1:], len(least)]
        # a text's last segment ends with its last window
        doc = np.searchsorted(offsets, edge, side="right") - 1
        ends = np.minimum(ends, offsets[doc + 1] - length + 1)
        keep = inside[edge] & (ends > edge)
        self.start, self.end, self.row = edge[keep], ends[keep], doc[keep]
        self.anchor = least[self.start]
        size = (self.end - self.start).astype(np.uint64)
        self.text = mixed((self.prefix[self.end - 1 + length] - self.prefix[self.start]) * p.down[self.start] + size * U64(SECOND_BASE))
        self.key = mixed(self.anchor ^ (self.text * U64(BASE)))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of all windows of some segments."""
        sizes = self.end[which] - self.start[which]
        at = np.repeat(self.start[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return at, mixed((self.prefix[at + self.length] - self.prefix[at]) * self.p.down[at])


def _once(main: np.ndarray, side: np.ndarray, row: np.ndarray, across: bool) -> tuple[np.ndarray, ...]:
    """Each different (main, side), whether it is there twice (across: in two rows), the first and the last row with it."""
    order = np.lexsort((row, side, main))
    main, side, row = main[order], side[order], row[order]
    at, _ = _groups(main, side)
    last = np.r_[at[1:], len(main)][: len(at)] - 1
    return main[at], side[at], (row[at] != row[last]) if across else last > at, row[at], row[last]


def _by_bucket(kind: int, unit: int, main: np.ndarray, side: np.ndarray, flags: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Digits by bucket.  Anchors are least hashes, so their own leading bits are uneven: the bucket is of their hash."""
    where = ((mixed(main) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    main, side, flags, where = main[order], side[order], flags[order], where[order]
    cuts = np.flatnonzero(np.diff(where)) + 1
    for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(main)].tolist(), strict=True):
        if b > a:
            yield int(where[a]), kind, unit, main[a:b].tobytes(), side[a:b].tobytes(), flags[a:b].tobytes()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema.types, strict=True)], schema=schema)


def _segments(data: np.ndarray, offsets: np.ndarray, lane: Lane, p: Powers) -> Segments:
    if not lane.words:
        return Segments(VALUES[data], offsets, lane.length, lane.gram, p)
    found = words_of(data, offsets, p, inside=IN_WORD, values=VALUES)
    return Segments(found.hashes, found.first, lane.length, lane.gram, p)


def _chunks(table: pa.Table, lanes: list[Lane]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int, list[Segments]]]:
    """Runs of rows, their bytes, the number of rows before, and the segments of every lane."""
    p, before = Powers(BASE), 0
    for batch in table.to_batches():
        for rows, data, offsets in slices(batch, "text", CHUNK_BYTES):
            yield rows, data, offsets, before, [_segments(data, offsets, lane, p) for lane in lanes]
            before += rows.num_rows


def _first_digits(lanes: list[Lane], buckets: int):
    """A unit's anchors (kind 0, with the text of their only segment or 0 for several) and segments (kind 1) in each lane."""

    def run(key: tuple, texts: pa.Table) -> pa.Table:
        unit, rows = key[0].as_py(), []
        found: list[list[tuple]] = [[] for _ in lanes]
        for _, _, _, before, segments in _chunks(texts, lanes):
            for own, s in zip(found, segments, strict=True):
                own.append((s.anchor, s.text, s.key, s.row + before))
        for i, (lane, own) in enumerate(zip(lanes, found, strict=True)):
            if not own:
                continue
            anchor, text, seg, row = (np.concatenate([f[k] for f in own]) for k in range(4))
            main, side, twice, _, _ = _once(seg, text, row, lane.across)
            rows += _by_bucket(KINDS * i + 1, unit, main, side, twice.astype(np.uint8), buckets)
            # the anchors' different segments, then the anchors
            a, t, twice, low, high = _once(anchor, text, row, lane.across)
            at, _ = _groups(a)
            if len(at):
                several = np.diff(np.r_[at, len(a)]) > 1
                again = (np.minimum.reduceat(low, at) != np.maximum.reduceat(high, at)) if lane.across else several | np.logical_or.reduceat(twice, at)
                rows += _by_bucket(KINDS * i, unit, a[at], np.where(several, U64(0), t[at]), again.astype(np.uint8), buckets)
        return _table(rows, DIGIT_SCHEMA)

    return run


def _gathered(table: pa.Table, kind: int, side_type) -> tuple[np.ndarray, ...]:
    """(main, side, flags, unit) of a bucket's digits of one kind, in order of main, side and unit."""
    rows = [r for r in table.select(["kind", "unit", "main", "side", "flags"]).to_pylist() if r["kind"] == kind]
    take = lambda name, dtype: np.concatenate([np.frombuffer(r[name], dtype) for r in rows]) if rows else np.zeros(0, dtype)
    main, side, flags = take("main", np.uint64), take("side", side_type), take("flags", np.uint8)
    unit = np.repeat(np.array([r["unit"] for r in rows], np.int64), [len(r["main"]) // 8 for r in rows])
    order = np.lexsort((unit, side, main))
    return main[order], side[order], flags[order], unit[order]


def _groups(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups begin, and the group of each row."""
    n = len(same[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _answers(lane: int, said: str, unit: np.ndarray, main: np.ndarray) -> list[tuple]:
    order = np.argsort(unit, kind="stable")
    unit, main = unit[order], main[order]
    cuts = np.flatnonzero(np.diff(unit)) + 1
    return [(int(unit[a]), lane, said, main[a:b].tobytes()) for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(unit)].tolist(), strict=True) if b > a]


def _sort_first(_: tuple, table: pa.Table) -> pa.Table:
    """Which anchors are repeated, alike or with different segments, and which segments, in each lane."""
    lanes = sorted({kind // KINDS for kind in table["kind"].to_pylist()})
    return _table([row for lane in lanes for row in _sorted_lane(lane, table)], ANSWER_SCHEMA)


def _sorted_lane(lane: int, table: pa.Table) -> list[tuple]:
    rows: list[tuple] = []
    main, side, flags, unit = _gathered(table, KINDS * lane, np.uint64)
    if len(main):
        at, group = _groups(main)
        count = np.diff(np.r_[at, len(main)]) + np.maximum.reduceat(flags, at)
        mixed_ = (np.minimum.reduceat(side, at) != np.maximum.reduceat(side, at)) | (np.minimum.reduceat(side, at) == 0)
        again = (count > 1)[group]
        rows += _answers(lane, ALIKE, unit[again & ~mixed_[group]], main[again & ~mixed_[group]])
        rows += _answers(lane, MIXED, unit[again & mixed_[group]], main[again & mixed_[group]])
    main, side, flags, unit = _gathered(table, KINDS * lane + 1, np.uint64)
    if len(main):
        at, group = _groups(main, side)
        again = (np.diff(np.r_[at, len(main)]) + np.maximum.reduceat(flags, at) > 1)[group]
        first = np.zeros(len(main), bool)
        first[at] = True
        rows += _answers(lane, FIRST, unit[again & first], main[again & first])
        rows += _answers(lane, COPY, unit[again & ~first], main[again & ~first])
    return rows


def _told(answers: pa.Table, lanes: int) -> list[dict[str, np.ndarray]]:
    """What is said of digits, in each lane."""
    out: list[dict[str, list]] = [{} for _ in range(lanes)]
    for lane, said, main in zip(answers["lane"].to_pylist(), answers["said"].to_pylist(), answers["main"].to_pylist(), strict=True):
        out[lane].setdefault(said, []).append(np.frombuffer(main, np.uint64))
    return [{said: np.unique(np.concatenate(x)) for said, x in own.items()} for own in out]


_NONE = np.zeros(0, np.uint64)


def _standing(s: Segments, told: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks of segments: repeated throughout; first of a repeated text with a mixed anchor; alone with a mixed anchor."""
    alike, mixed_ = np.isin(s.anchor, told.get(ALIKE, _NONE)), np.isin(s.anchor, told.get(MIXED, _NONE))
    first = mixed_ & np.isin(s.key, told.get(FIRST, _NONE))
    copy = mixed_ & ~first & np.isin(s.key, told.get(COPY, _NONE))
    return alike | first | copy, first, mixed_ & ~first & ~copy


def _last_digits(lanes: list[Lane], buckets: int):
    """The windows of a unit that the third pass sorts (kind 2); flag 1: it wants to know, 2: it is there twice."""

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        told, rows = _told(answers, len(lanes)), []
        found: list[list[tuple]] = [[] for _ in lanes]
        wanted = [MIXED in own for own in told]
        for _, _, _, before, segments in _chunks(texts, [lane for lane, x in zip(lanes, wanted, strict=True) if x]) if any(wanted) else ():
            for i, s in zip(np.flatnonzero(wanted).tolist(), segments, strict=True):
                _, first, alone = _standing(s, told[i])
                for which, flag in ((first, 2), (alone, 1)):
                    which = np.flatnonzero(which)
                    if len(which):
                        _, own = s.windows(which)
                        size = s.end[which] - s.start[which]
                        found[i].append((own, np.repeat((s.anchor[which] & HASH32).astype(np.uint32), size), np.full(len(own), flag, np.uint8), np.repeat(s.row[which] + before, size)))
        for i, (lane, own) in enumerate(zip(lanes, found, strict=True)):
            if own:
                main, side, flag, row = (np.concatenate([f[k] for f in own]) for k in range(4))
                order = np.lexsort((row, side, main))
                main, side, flag, row = main[order], side[order], flag[order], row[order]
                at, _ = _groups(main, side)
                last = np.r_[at[1:], len(main)] - 1
                twice = row[at] != row[last] if lane.across else last > at
                flag = np.bitwise_or.reduceat(flag, at) | np.where(twice, 2, 0).astype(np.uint8)
                rows += _by_bucket(KINDS * i + 2, key[0].as_py(), main[at], side[at], flag, buckets)
        return _table(rows, DIGIT_SCHEMA)

    return run


def _sort_last(_: tuple, table: pa.Table) -> pa.Table:
    rows: list[tuple] = []
    for kind in sorted(set(table["kind"].to_pylist())):
        main, side, flags, unit = _gathered(table, kind, np.uint32)
        at, group = _groups(main, side)
        count = np.diff(np.r_[at, len(main)]) + (np.bitwise_or.reduceat(flags, at) & 2 > 0)
        again = (count > 1)[group] & (flags & 1 > 0)
        rows += _answers(kind // KINDS, REPEATED, unit[again], main[again])
    return _table(rows, ANSWER_SCHEMA)


def _covered(n: int, s: Segments, told: dict[str, np.ndarray]) -> np.ndarray:
    """Which of a chunk's n bytes or words a repeated window covers."""
    cover = np.zeros(n + 1, np.int64)
    if told:
        whole, _, alone = _standing(s, told)
        np.add.at(cover, s.start[whole], 1)
        np.add.at(cover, s.end[whole] - 1 + s.length, -1)
        if alone.any() and REPEATED in told:
            at, own = s.windows(np.flatnonzero(alone))
            at = at[np.isin(own, told[REPEATED])]
            cover[at] += 1  # places differ
            cover[at + s.length] -= 1
    return np.cumsum(cover[:-1]) > 0


KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, n_shared_words long"
KEPT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("n_shared_words", pa.int64())])


def _cut(lanes: list[Lane]):
    def run(_: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        told, out = _told(answers, len(lanes)), []
        for rows, data, offsets, _, segments in _chunks(texts, lanes):
            gone = _covered(len(data), segments[0], told[0])
            shared: list = [None] * rows.num_rows
            if len(lanes) > 1:
                first = segments[1].offsets
                shared = np.diff(np.r_[0, np.cumsum(_covered(int(first[-1]), segments[1], told[1]))][first]).tolist()
            begin, end = gone & ~np.r_[False, gone[:-1]], gone & ~np.r_[gone[1:], False]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            begin[inner] = gone[inner]  # runs end with their text
            end[inner - 1] = gone[inner - 1]
            starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
            first = np.searchsorted(starts, offsets)
            names = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
            for i, name in enumerate(names):
                a, b = int(offsets[i]), int(offsets[i + 1])
                own = slice(first[i], first[i + 1]) if b > a else slice(0, 0)
                spans = [{"start": x - a, "end": y - a} for x, y in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
                text = data[a:b]
                out.append((name, b - a, spans, (text[~gone[a:b]] if spans else text).tobytes(), shared[i]))
        return _table(out, KEPT_SCHEMA)

    return run


def remove_repeats(docs: DataFrame, *, length: int = 400, gram: int | None = None, unit_bytes: int = UNIT_BYTES, passage_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes) and kept (the other bytes) of every row of docs(doc_id, text).

    passage_words: n_shared_words then has the words of the row inside a run of so many words that another row has, too;
    else it is null.  Words are what white space divides.
    """
    gram = gram or length // 2
    if not 1 <= gram <= length:
        raise ValueError("a gram is a part of the length")
    lanes = [Lane(length, gram)] + ([Lane(passage_words, max(1, passage_words // 2), words=True, across=True)] if passage_words else [])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    units, buckets = max(8, -(-total // unit_bytes)), max(16, -(-total // (2 * unit_bytes)))
    texts = plain.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).alias("unit"), "doc_id", "text")
    digits = texts.groupBy("unit").applyInArrow(_first_digits(lanes, buckets), DIGITS)
    answers = digits.groupBy("bucket").applyInArrow(_sort_first, ANSWERS)
    windows = texts.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_last_digits(lanes, buckets), DIGITS)
    more = windows.groupBy("bucket").applyInArrow(_sort_last, ANSWERS)
    both = answers.union(more)
    return texts.groupBy("unit").cogroup(both.groupBy("unit")).applyInArrow(_cut(lanes), KEPT)


def digests(kept: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and more of its columns) from remove_repeats' rows."""
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *more,
    )
