"""Near copies, operator 10 where the rule is a similarity: documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

First operator 10's own method runs whole: fingerprints, multi-index hashing for links of up to ``BITS`` bits, star
contraction.  Each set is then compared with the one that stands for its fingerprint's component, and linked to it if the
sets themselves are that similar.

SimHash alone can't decide this rule: texts of similarity 0.8 differ by about 10 of 64 bits, and a Hamming ball of that
radius has 10**11 values (of 43 such pairs at sf0.1, links within 3 bits find none).  So the rest, and every pair that
this first step didn't link, is found by min-hashes.

Documents with one shingle set are collapsed first; all that follows works on different sets.  A set has a bucket for
each of ``BANDS`` bands of ``ROWS`` min-hashes, and sets that share a bucket are candidates: two sets of similarity 0.8
share none with a probability of (1 - 0.8**5)**30, 7 in a million, and nearer ones with less.  Every link is then decided
on the shingle sets themselves.

A bucket isn't expanded into pairs.  First its pivot, the set with the most company in all its buckets, is compared with
all others: the text that others were edited from is near to more of them than they are, so most links are found here,
and a bucket of one component is settled.  In the other buckets, each set outside the largest component is then compared
with all sets, in tiles of a bounded number of shingles, which give links that join a tile's sets, not all of its pairs.
So no pair of a bucket is left out, unless links already hold its sets together.

Defined results: null and empty texts have no shingles and are copies of each other; fewer words than a shingle make one
shingle of all; the row with the least doc_id of a component stays, of several with that id the least by a hash of its
text; rows of one id that aren't near copies have nothing to do with each other; rows without id stay; other columns
never take part.  Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import giving_back, release_shuffles, use_shared_dir
from .simhash import SEED, fingerprints_of_hashes, links, shingle_hashes

#: Bits by which linked fingerprints differ at most, as in operator 10.
BITS = 2
BANDS, ROWS = 30, 5
#: Shingles that are min-hashed at once.
RUN = 30_000
#: Pivots of a bucket in the rounds before the tiles.
PIVOTS = (1,)
#: Shingles of a tile's side, and rows and columns of its matrices.
TILE, BLOCK, COLUMNS = 200_000, 1_024, 4_096


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def set_key(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), SEED)


def buckets_of(sets: list[np.ndarray]) -> np.ndarray:
    """The bucket of each band, a row for each set; none may be empty."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2)
    spread = rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), BANDS), np.uint64)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= RUN):
            held += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.r_[0, np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64)].astype(np.int64)
        for b in range(BANDS):
            bucket = np.full(end - at, b + 1, np.uint64)
            for r in range(ROWS):
                least = np.minimum.reduceat(flat * factors[b, r] + shifts[b, r], starts)
                least ^= least >> np.uint64(32)
                bucket = (bucket ^ least) * spread[r]
                bucket ^= bucket >> np.uint64(29)
            out[at:end, b] = bucket
        at = end
    return out


def text_key() -> Column:
    """With doc_id, the key of a row."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, tk, sid (the shingle set), n (its size), buckets and fp (the fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets: list[np.ndarray] = []

                def hashed(texts: list, sets: list = sets) -> Iterator[np.ndarray]:
                    for text in texts:
                        own = np.array(shingle_hashes(text or b"", words), np.uint64)
                        sets.append(np.unique(own))
                        yield own

                fps = fingerprints_of_hashes(hashed(some.column(2).cast(pa.binary()).to_pylist()), some.num_rows)
                full = [i for i, s in enumerate(sets) if len(s)]
                buckets: list = [[]] * len(sets)
                if full:
                    for i, row in zip(full, buckets_of([sets[i] for i in full]).view(np.int64).tolist(), strict=True):
                        buckets[i] = row
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([set_key(s) for s in sets], pa.uint64()).view(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(fps)],
                    names=["doc_id", "tk", "sid", "n", "buckets", "fp"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    return own.mapInArrow(giving_back(run), "doc_id long, tk long, sid long, n long, buckets array<long>, fp long")


def _sets(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """sid and shingles of the texts of keys(tk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(t or b"", words) for t in batch.slice(at, 500).column(0).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.uint64()).view(pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "shingles"])

    texts = docs.select("text", text_key().alias("tk")).join(keys, "tk", "left_semi").select("text")
    return texts.mapInArrow(giving_back(run), "sid long, shingles array<long>").groupBy("sid").agg(F.first("shingles").alias("shingles"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(u, v) whose sets have a similarity of 0.8: 9 times the common ones are 4 times the sum of both sizes."""
    u, v = sets.select(F.col("sid").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("sid").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return pairs.join(u, "u").join(v, "v").where(9 * common >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _fingerprint_pairs(own: DataFrame) -> DataFrame:
    """Pairs (u, v): a set of own(sid, n, fp), and the least set of its fingerprint's component."""
    held = own.where(F.col("n") > 0).select("sid", "fp").distinct()
    fps = held.groupBy("fp").agg(F.min("sid").alias("least")).checkpoint()
    roots = components(links(fps.select("fp"), distance=BITS))
    tied = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    stands = tied.groupBy("root").agg(F.min("least").alias("v"))
    pairs = held.join(tied.select("fp", "root"), "fp").join(stands, "root").where(F.col("sid") != F.col("v"))
    return pairs.select(F.col("sid").alias("u"), "v").distinct().checkpoint()


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members and their roots, in the buckets that have several."""
    named = members.join(roots.withColumnRenamed("u", "sid"), "sid", "left").select("bucket", "sid", "n", "score", F.coalesce("v", "sid").alias("root"))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("bucket")
    return named.join(mixed, "bucket", "left_semi").checkpoint()


def _joined(roots: DataFrame, new: DataFrame) -> DataFrame:
    """roots with new links; what is linked already is a star."""
    return roots if new.isEmpty() else components(roots.union(new)).select(F.col("node").alias("u"), F.col("root").alias("v"))


def _links(members: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the linked sets of members(bucket, sid, n, score), and of those that roots links already."""
    for turn, k in enumerate(PIVOTS):
        rest = _named(members, roots)
        one = F.min_by(F.struct("sid", "n", "root"), F.struct((-F.col("score")).alias("a"), F.xxhash64("sid", F.lit(turn)).alias("b"), "sid"))
        pivots = rest.groupBy("bucket", F.pmod(F.xxhash64("sid"), F.lit(k)).alias("class")).agg(one.alias("p")).select("bucket", F.col("p.sid").alias("p"), F.col("p.n").alias("p_n"), F.col("p.root").alias("p_root")).checkpoint()
        # a similarity of 0.8 needs sizes at least that near
        near = (5 * F.least("n", "p_n") >= 4 * F.greatest("n", "p_n")) & (F.col("root") != F.col("p_root"))
        pairs = rest.join(pivots, "bucket").where(near).select(F.greatest("sid", "p").alias("u"), F.least("sid", "p").alias("v")).distinct()
        roots = _joined(roots, _similar(pairs, sets).checkpoint())
        members = rest.join(pivots.select("bucket", F.col("p").alias("sid")), ["bucket", "sid"], "left_anti").select("bucket", "sid", "n", "score")
    release_shuffles(sets.sparkSession)
    return _joined(roots, _tiled(_named(members, roots), sets).checkpoint())


def _tiled(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between the sets of rest(bucket, sid, n, root) with different roots."""
    by_root = rest.groupBy("bucket", "root").agg(F.count("*").alias("held"), F.sum("n").alias("n"))
    main = by_root.groupBy("bucket").agg(F.max(F.struct("held", "root", "n")).alias("m"), F.sum("n").alias("n"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    dealt = rest.drop("n").join(main.select("bucket", F.col("m.root").alias("main"), tiles(F.col("n") - F.col("m.n")).alias("n_asks"), tiles(F.col("n")).alias("n_told")), "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("sid", F.lit("tile")), n).cast("int")
    asks = dealt.where(F.col("root") != F.col("main")).select("bucket", own(F.col("n_asks")).alias("i"), every(F.col("n_told")).alias("j"), F.lit(True).alias("asks"), "sid", "root")
    told = dealt.select("bucket", every(F.col("n_asks")).alias("i"), own(F.col("n_told")).alias("j"), F.lit(False).alias("asks"), "sid", "root")
    return asks.union(told).join(sets, "sid").groupBy("bucket", "i", "j").applyInArrow(_tile, "u long, v long").distinct()


def _incidence(flat: np.ndarray, owner: np.ndarray, low: int, rows: int) -> np.ndarray:
    """Which of COLUMNS shingles, numbered from low, each set has."""
    out = np.zeros((rows, COLUMNS), np.float32)
    at = (flat >= low) & (flat < low + COLUMNS)
    out[owner[at], flat[at] - low] = 1
    return out


def _contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links (u, v) join: each end but the least with the least."""
    names, ends = np.unique(np.r_[u, v], return_inverse=True)
    x, y, least = ends[: len(u)], ends[len(u) :], np.arange(len(names))
    while len(x):
        low = np.minimum(least[x], least[y])
        before = least.copy()
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        if (before == least).all():
            break
    tied = np.flatnonzero(least != np.arange(len(names)))
    return names[tied], names[least[tied]]


def _tile(_: tuple, table: pa.Table) -> pa.Table:
    """Links (u, v) of a tile; BLOCK sets of either side are compared at once, and only shingles that such askers have."""
    table = table.combine_chunks()
    asks, sid, root = (table[c].to_numpy(zero_copy_only=False) for c in ("asks", "sid", "root"))
    lists = table["shingles"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]

    def blocks(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        some = [rows[at : at + BLOCK] for at in range(0, len(rows), BLOCK)]
        return [(r, np.concatenate([flat[ends[i] : ends[i + 1]] for i in r]), np.repeat(np.arange(len(r)), sizes[r])) for r in some]

    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    told = blocks(np.flatnonzero(~asks))
    for mine, own, a_owner in blocks(np.flatnonzero(asks)):
        known, a_at = np.unique(own, return_inverse=True)  # only shingles of the askers can be common
        for others, theirs, owner in told:
            at = np.minimum(np.searchsorted(known, theirs), len(known) - 1)
            there = known[at] == theirs
            b_at, b_owner = at[there], owner[there]
            common = np.zeros((len(mine), len(others)), np.float32)
            for low in range(0, len(known), COLUMNS):
                common += _incidence(a_at, a_owner, low, len(mine)) @ _incidence(b_at, b_owner, low, len(others)).T
            near = 9 * common >= 4 * (sizes[mine][:, None] + sizes[others][None, :])
            i, j = np.nonzero(near & (root[mine][:, None] != root[others][None, :]))
            if len(i):
                u, v = _contracted(np.r_[u, sid[mine[i]]], np.r_[v, sid[others[j]]])
    return pa.table([u, v], schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def near_copies(docs: DataFrame, *, words: int = 5) -> DataFrame:
    """doc_id, tk and first (the key, doc_id and tk, of the row that stays of its component) of every row."""
    use_shared_dir(docs.sparkSession)
    own = _marked(docs, words).checkpoint()
    nodes = own.groupBy("sid").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tk"))).alias("first"), F.min("tk").alias("tk"), F.first("n").alias("n"), F.first("buckets").alias("buckets")).checkpoint()
    placed = nodes.select("sid", "n", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("held")).where(F.col("held") > 1)
    joint = placed.join(shared.hint("merge"), "bucket").select("bucket", "sid", "n", "held").checkpoint()
    members = joint.join(joint.groupBy("sid").agg(F.sum("held").alias("score")), "sid").select("bucket", "sid", "n", "score").checkpoint()
    pairs = _fingerprint_pairs(own)
    compared = members.select("sid").union(pairs.select("u")).union(pairs.select("v")).distinct()
    sets = _sets(docs, nodes.join(compared, "sid", "left_semi").select("tk"), words).checkpoint()
    release_shuffles(docs.sparkSession)
    near = _joined(docs.sparkSession.createDataFrame([], "u long, v long"), _similar(pairs, sets).checkpoint())
    roots = _links(members, sets, near)
    release_shuffles(docs.sparkSession)
    tied = nodes.join(roots, nodes["sid"] == roots["u"], "left").select("sid", "first", F.coalesce("v", "sid").alias("root"))
    least = tied.groupBy("root").agg(F.min("first").alias("first"))
    return own.select("doc_id", "tk", "sid").join(tied.select("sid", "root"), "sid").join(least, "root").select("doc_id", "tk", "first")


def keep_rows(docs: DataFrame, near: DataFrame) -> DataFrame:
    """docs without the rows whose key, doc_id and tk in near(doc_id, tk, first), isn't first; of rows with one key, one."""
    near = near.where(F.col("doc_id").isNotNull()).checkpoint()
    dropped = near.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("tk") != F.col("first.tk"))).select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).distinct()
    same = lambda keys: (F.col("doc_id").cast("long") == keys["__id"]) & (text_key() == keys["__tk"])
    kept = docs.join(dropped, same(dropped), "left_anti")
    # keys of several rows; without any, which is the rule, nothing more is needed
    again = near.groupBy("doc_id", "tk").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).checkpoint()
    if again.isEmpty():
        return kept
    single, several = kept.join(again, same(again), "left_anti"), kept.join(again, same(again), "left_semi")
    return single.union(several.groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*"))


def keep_first(docs: DataFrame, *, words: int = 5) -> DataFrame:
    """docs without the rows that a component keeps another of."""
    return keep_rows(docs, near_copies(docs, words=words))
