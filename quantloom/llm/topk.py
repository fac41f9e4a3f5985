"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

The index deals vectors into shards. A shard's postings (dimension, vector, component) are cut into
segments of equal quantised impact |component|, kept in falling order. A block of queries meets a
shard: segments are added to the accumulators from the highest impact down. After a segment, what a
vector can still gain from postings not yet seen is at most |query| times the norm of its unseen
components. Processing stops only when this proves that few enough vectors can be among a query's
k best of the shard; those are scored exactly. Without proof it runs to the last segment, where the
accumulators are the scores.

Queries are dealt in blocks too, and blocks in groups of GROUP. A shard meets a group of blocks in one
task of bounded size; shards and blocks are exchanged once, by that pair, whatever the index's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SHARD_ROWS, BLOCK_ROWS, GROUP = 8192, 256, 8
#: Impact levels are powers of this ratio; segments after which members are counted hold these shares of all postings.
RATIO = 2**0.5
STOPS = (0.35, 0.5, 0.62, 0.72, 0.82, 0.9)
#: Stop when a query's possible members number this share of the shard at most.
FEW = 1 / 64


def quantise(vector: Column) -> Column:
    """array<long>: floor(256 * x), x as double; null where a component is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("long"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def _matrix(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of numbers, short ones filled up with zeros."""
    lists = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _level(impact: np.ndarray) -> np.ndarray:
    """Quantised impact: 0 for 0, else one more than the power of RATIO below it."""
    return np.where(impact > 0, 1 + np.floor(np.log(np.maximum(impact, 1)) / np.log(RATIO) + 1e-9), 0).astype(np.int64)


def _index(group: pa.Table) -> pa.Table:
    """A shard: its ids, and the postings of its segments by falling impact, dimension by dimension."""
    ids = group.column("vec_id").to_numpy()
    values = _matrix(group.column("vec"))
    vector, dim = np.nonzero(values)
    value = values[vector, dim]
    level = _level(np.abs(value))
    order = np.lexsort((vector, dim, -level))
    pack = lambda a, kind: a.astype(kind).tobytes()
    row = {"shard": group.column("shard")[0].as_py(), "ids": pack(ids, "<i8"), "dims": values.shape[1], "level": pack(level[order], "<i2"), "dim": pack(dim[order], "<i4"), "vector": pack(vector[order], "<i4"), "value": pack(value[order], "<i8" if np.abs(value).max(initial=0) > 32767 else "<i2")}
    return pa.Table.from_pylist([row], schema=_SHARD_ARROW)


_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("dims", pa.int32()), ("level", pa.binary()), ("dim", pa.binary()), ("vector", pa.binary()), ("value", pa.binary())])
_SHARD = "shard long, ids binary, dims int, level binary, dim binary, vector binary, value binary"


def _block(group: pa.Table) -> pa.Table:
    values = _matrix(group.column("vec"))
    row = {"block": group.column("block")[0].as_py(), "query_ids": group.column("vec_id").to_numpy().astype("<i8").tobytes(), "query_dims": values.shape[1], "queries": values.astype("<i8").tobytes()}
    return pa.Table.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("query_ids", pa.binary()), ("query_dims", pa.int32()), ("queries", pa.binary())]))


def search_shard(ids: np.ndarray, values: np.ndarray, segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]], query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, vector ids, scores) of each query's k best in the shard, its own row left out."""
    n = len(ids)
    length = np.sqrt((queries.astype(float) ** 2).sum(1))
    total = (values.astype(float) ** 2).sum(1)
    acc = np.zeros((n, len(queries)))
    live = np.arange(len(queries))
    seen, seen_postings = np.zeros(n), 0
    postings = max(1, sum(len(v) for _, v, _ in segments))
    stops = list(STOPS)
    few = max(4 * k, int(n * FEW))
    own = {int(i): j for j, i in enumerate(ids)}
    for dim, vector, value in segments:
        edges = np.flatnonzero(np.diff(dim)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(dim)]):
            at = vector[lo:hi]
            acc[at] += value[lo:hi, None] * queries[live, dim[lo]]
            seen[at] += value[lo:hi].astype(float) ** 2
        seen_postings += len(dim)
        while stops and seen_postings >= stops[0] * postings:
            stops.pop(0)
            if not len(live) or n <= few:
                continue
            rest = np.sqrt(np.maximum(0.0, total - seen))[:, None] * length[live] * (1 + 1e-9) + 1e-6
            low = acc - rest
            for c, q in enumerate(live):  # a query's own row can't prove anything
                if (j := own.get(int(query_ids[q]))) is not None:
                    low[j, c] = -np.inf
            floor = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(live), -np.inf)
            may = acc + rest >= floor
            done = may.sum(0) <= few
            for c in np.flatnonzero(done):
                yield int(live[c]), *_best(ids, values, np.flatnonzero(may[:, c]), query_ids[live[c]], queries[live[c]], k)
            if done.any():
                acc, live = np.ascontiguousarray(acc[:, ~done]), live[~done]
        if not len(live):
            return
    for c, q in enumerate(live):  # all segments are in: the accumulators are the scores
        top = min(n, k + 1)
        bound = np.partition(acc[:, c], n - top)[n - top]
        yield int(q), *_best(ids, values, np.flatnonzero(acc[:, c] >= bound), query_ids[q], queries[q], k)


def _best(ids: np.ndarray, values: np.ndarray, members: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    members = members[ids[members] != query_id]
    score = values[members] @ query
    order = np.lexsort((ids[members], -score))[:k]
    return ids[members][order], score[order]


def _search(k: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, shard = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if kept != row["shard"]:
                    ids = np.frombuffer(row["ids"], "<i8")
                    dim, vector, level = (np.frombuffer(row[c], t) for c, t in (("dim", "<i4"), ("vector", "<i4"), ("level", "<i2")))
                    value = np.frombuffer(row["value"], "<i8" if len(row["value"]) == 8 * len(dim) else "<i2").astype(np.int64)
                    values = np.zeros((len(ids), row["dims"]), np.int64)
                    values[vector, dim] = value
                    cuts = np.flatnonzero(np.diff(level)) + 1
                    segments = list(zip(np.split(dim, cuts), np.split(vector, cuts), np.split(value, cuts))) if len(dim) else []
                    kept, shard = row["shard"], (ids, values, segments)
                ids, values, segments = shard
                query_ids = np.frombuffer(row["query_ids"], "<i8")
                queries = np.frombuffer(row["queries"], "<i8").reshape(len(query_ids), -1)
                width = max(values.shape[1], queries.shape[1])
                queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                wide = np.pad(values, ((0, 0), (0, width - values.shape[1])))
                found = list(search_shard(ids, wide, segments, query_ids, queries, k))
                if found:
                    q = np.concatenate([np.full(len(i), query_ids[p]) for p, i, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "vec_id", "score"])

    return read


def build_index(vectors: DataFrame, rows: int) -> DataFrame:
    """vectors (vec_id, vec array<long>) -> a row for each shard with its impact-ordered segments."""
    shards = max(1, -(-rows // SHARD_ROWS))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_index, _SHARD)


def top_k(embeddings: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row of `embeddings` where `queries` holds.

    A vec_id's row is no candidate of its own; ties go to smaller vec_id; fewer rows where there are
    fewer candidates. Rows with a null vec_id, or a vector that is null or holds a null or non-finite
    component, take no part. Of repeated vec_ids one row counts, the one with the smallest vector.
    Vectors of unlike lengths are filled up with zeros. Components beyond 2**20 in size are not
    meant to occur: scores are 64-bit.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding")).alias("vec"))
    vectors = stored(vectors.where("vec_id is not null and vec is not null").groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    asked = vectors.where(queries)
    rows, n_asked = vectors.count(), asked.count()
    index = stored(build_index(vectors, rows), "index")
    blocks = max(1, -(-n_asked // BLOCK_ROWS))
    shards = max(1, -(-rows // SHARD_ROWS))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).groupBy("block").applyInArrow(_block, "block long, query_ids binary, query_dims int, queries binary")
    groups = -(-blocks // GROUP)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    every = stored(dealt, "blocks").withColumn("group", F.col("block") % groups).withColumn("shard", each(shards))
    tasks = max(8, min(1 << 16, groups * shards))
    both = index.withColumn("group", each(groups)).repartition(tasks, "shard", "group").hint("merge")
    pairs = every.repartition(tasks, "shard", "group").join(both, ["shard", "group"])
    found = pairs.drop("query_dims", "block", "group").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
