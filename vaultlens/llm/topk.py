"""Exact top-k inner products: exhaustive term-at-a-time accumulation over sparse integer vectors.

Candidates are dealt into groups of about ``group_rows`` by a hash of their id; the queries, in packs of at most
``pack_rows``, go to every group.  In a task the group's vectors become postings, one list of (row, weight) for each term
(component).  A query's row starts an array of zero scores and, term after term, adds its weight times the posting's
weights at the posting's rows; a partial selection keeps the k best of the group.  The groups' winners, k for each query
and group, are merged by rank.  Every query meets every candidate, as the contract asks, but only in such blocks: no pair
ever is a row, and no task holds more than a group and a pack.

Defined results: a vector that is null, or holds a null or non-finite component, and a row without id take no part; an
empty vector scores 0; vectors may differ in length, missing components being 0; rows with the query's id are its own,
however often they stand there; equal query rows count once; ties go to the smaller id; with fewer than k candidates all
return; scores are 64-bit integers; other columns never take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RESULT = "query_id long, query_key long, vec_id long, score long"
RESULT_SCHEMA = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null unless all are finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def postings_of(values: np.ndarray, starts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights) of ragged rows values[starts[i]:starts[i + 1]], zeros left out."""
    lengths = np.diff(starts)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(values)) - np.repeat(starts[:-1], lengths)
    full = values != 0
    rows, terms, values = rows[full], terms[full], values[full]
    order = np.argsort(terms, kind="stable")
    rows, terms, values = rows[order], terms[order], values[order]
    cuts = np.flatnonzero(np.diff(terms)) + 1
    firsts = np.r_[0, cuts][: len(terms)] if len(terms) else np.zeros(0, int)
    return {int(terms[a]): (r, v) for a, r, v in zip(firsts, np.split(rows, cuts), np.split(values, cuts), strict=False) if len(r)}


def top_of_group(ids: np.ndarray, postings: dict, query_id: int, query: np.ndarray, k: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the group's k best for one query; scores is a buffer as long as the group."""
    n = len(ids)
    scores[:] = 0
    for term in np.flatnonzero(query).tolist():
        if term in postings:
            rows, weights = postings[term]
            if len(rows) == n:
                scores += weights * query[term]
            else:
                scores[rows] += weights * query[term]
    other = np.flatnonzero(ids != query_id)
    own = scores[other]
    if len(own) > k:
        least = np.partition(own, len(own) - k)[len(own) - k]
        keep = own >= least
        other, own = other[keep], own[keep]
    best = np.lexsort((ids[other], -own))[:k]
    return ids[other][best], own[best]


def exact_topk(
    vectors: DataFrame, is_query: Column, *, k: int = 5, group_rows: int = 8_192, pack_rows: int = 16_384
) -> DataFrame:
    """query_id, rank, vec_id, score for vectors(vec_id, terms array<long>); is_query says which rows are queries."""
    known = vectors.where(F.col("vec_id").isNotNull() & F.col("terms").isNotNull()).select("vec_id", "terms")
    queries = known.where(is_query).select("vec_id", "terms", F.xxhash64("vec_id", "terms").alias("key")).dropDuplicates(["vec_id", "key"])
    n, n_queries = known.count(), queries.count()
    groups, packs = max(1, -(-n // group_rows)), max(1, -(-n_queries // pack_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = known.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("pack", every(packs))
    right = queries.withColumn("pack", F.pmod(F.col("key"), F.lit(packs)).cast("int")).withColumn("group", every(groups))

    def search(_: tuple, candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if candidates.num_rows and asked.num_rows:
            ids = candidates["vec_id"].to_numpy()
            terms = candidates["terms"].combine_chunks()
            values = terms.flatten().to_numpy(zero_copy_only=False)
            lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
            postings = postings_of(values, np.r_[0, np.cumsum(lengths)])
            scores = np.zeros(len(ids), np.int64)
            for query_id, key, query in zip(asked["vec_id"].to_pylist(), asked["key"].to_pylist(), asked["terms"], strict=True):
                best, own = top_of_group(ids, postings, query_id, query.values.to_numpy(zero_copy_only=False), k, scores)
                out[0] += [query_id] * len(best)
                out[1] += [key] * len(best)
                out[2] += best.tolist()
                out[3] += own.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=RESULT_SCHEMA)

    found = left.groupBy("group", "pack").cogroup(right.groupBy("group", "pack")).applyInArrow(search, RESULT)
    place = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.terms, c.terms), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
