"""Exact top-k search: histograms of all scores locate each query's k-th value, then a filter takes what reaches it."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from ..plans.workspace import new_path
from .frames import named, pieces

#: Queries that travel to the tasks at once, cells of a score block, bins of a histogram (a power of two).
QUERY_BLOCK, CELLS, BINS = 2048, 1 << 21, 64


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part: an id, and no null or non-finite component."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)


def _matrix(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """Rows of floor(scale * x), zeros where a vector is shorter than ``width``; what lies beyond is cut."""
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < width
    out[row[inside], place[inside]] = values[inside]
    return out


class Block:
    """A bounded set of queries and the interval of scores in which each one's k-th value lies."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, scale: int, largest: int):
        self.ids, self.vectors, self.scale = ids, vectors, scale
        if np.abs(vectors.astype(np.float64)).sum(1).max(initial=0) * largest >= 2.0 ** 61:
            raise ValueError("scores don't fit in 64 bits")
        bound = np.abs(vectors).sum(1) * largest + 1
        #: Sums below 2**53 are exact in doubles, for which products of matrices are fast.
        self.exact = bool(bound.max(initial=0) < 1 << 53)
        self.low = -bound
        self.shift = np.array([max(0, (2 * int(b)).bit_length() - BINS.bit_length() + 1) for b in bound])
        self.need = np.full(len(ids), k)
        #: Queries whose interval is one score; wider ranges of scores take more rounds.
        self.settled = np.zeros(len(ids), bool)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates' ids and their scores against all queries, a bounded number of cells at a time."""
        for part in pieces([batch], max(1, CELLS // max(1, len(self.ids)))):
            vectors = _matrix(part.column(1), self.scale, self.vectors.shape[1])
            if self.exact:
                found = (vectors.astype(np.float64) @ self.vectors.T.astype(np.float64)).astype(np.int64)
            else:
                found = vectors @ self.vectors.T
            yield part.column(0).to_numpy(), found

    def histogram(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per query with the counts of the bins, highest scores in the last bin."""
        counts = np.zeros(len(self.ids) * BINS, np.int64)
        base = np.arange(len(self.ids)) * BINS
        for batch in batches:
            for ids, found in self.scores(batch):
                bins = (found - self.low) >> self.shift
                inside = (bins >= 0) & (bins < BINS) & (ids[:, None] != self.ids)
                counts += np.bincount((bins + base)[inside], minlength=len(counts))
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(self.ids))),
                 *[pa.array(c) for c in np.ascontiguousarray(counts.reshape(-1, BINS).T)]],
                ["query", *[f"b{i}" for i in range(BINS)]])

    def refine(self, totals: np.ndarray) -> None:
        """Go to the bin that holds each query's k-th value; ``totals`` has a row of bins per query."""
        from_top = totals[:, ::-1].cumsum(1)
        reached = from_top >= self.need[:, None]
        place = np.where(reached.any(1), reached.argmax(1), BINS - 1)  # too few candidates: the lowest bin
        row = np.arange(len(totals))
        passed = from_top[row, place] - totals[row, BINS - 1 - place]
        self.need = np.where(self.settled, self.need, self.need - passed)
        self.low = np.where(self.settled, self.low, self.low + ((BINS - 1 - place) << self.shift))
        self.settled = self.shift == 0
        self.shift = np.maximum(0, self.shift - BINS.bit_length() + 1)

    def reaching(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What lies above the k-th value, and of what equals it the smallest ids that this task can contribute."""
        ties: dict[int, list[int]] = {}
        for batch in batches:
            for ids, found in self.scores(batch):
                other = ids[:, None] != self.ids
                row, query = np.nonzero((found > self.low) & other)
                yield self._hits(query, ids[row], found[row, query])
                query, row = np.nonzero(((found == self.low) & other).T)
                for q in np.unique(query).tolist():
                    need = int(self.need[q])
                    ties[q] = sorted(ties.get(q, []) + np.sort(ids[row[query == q]])[:need].tolist())[:need]
        query = np.repeat(np.array(list(ties), np.int64), [len(x) for x in ties.values()])
        yield self._hits(query, np.array([x for own in ties.values() for x in own], np.int64), self.low[query])

    def _hits(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[query]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


def search_block(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """The k best candidates of each query in ``block``: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    while True:
        fine = not block.shift.any()
        shared = spark.sparkContext.broadcast(block)
        schema = "query long, " + ", ".join(f"b{i} long" for i in range(BINS))
        parts = rows.mapInArrow(lambda batches: shared.value.histogram(batches), schema)
        totals = np.zeros((len(block.ids), BINS), np.int64)
        for row in parts.groupBy("query").agg(*[F.sum(f"b{i}").alias(f"b{i}") for i in range(BINS)]).collect():
            totals[row[0]] = row[1:]
        shared.unpersist()
        block.refine(totals)
        if fine:
            break
    shared = spark.sparkContext.broadcast(block)
    hits = rows.mapInArrow(lambda batches: shared.value.reaching(batches), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def histogram_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
    vector_col: str = "embedding", query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For each query its ``k`` best of ``vectors`` by integer inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x).  A row is no candidate for the query of
    the same id.  Equal scores are ranked by the smaller id.  Queries are taken
    in blocks of about ``query_block``, chosen by a hash of the id; a block is
    all that is ever sent to the tasks or comes back to the driver as counts.
    For every block all scores are computed in each of a few rounds and counted
    in 64 bins per query, then in 64 bins of the bin that holds the k-th value,
    until a bin is one score wide.  A last round takes what lies above it and,
    per task, as many of its ties as are still needed, smallest ids first.  The
    results of a block are written to the shared folder, so the plan doesn't grow
    with the number of blocks.

    Rows with a null id, a null vector, or a null or non-finite component take
    no part; an empty vector scores 0.  Vectors of unequal length are compared
    as if the shorter one ended in zeros.  A repeated id makes repeated
    candidates, but its query is asked once, with the smallest of its vectors.
    With fewer than ``k`` candidates all are returned; without queries or
    candidates the result is empty.  Other columns are ignored.
    Scores of 2^61 or more in absolute value might not fit in 64 bits: where a sum of absolute products could
    reach that, a ValueError says so.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    largest = rows.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(F.floor(scale * x))))).alias("m"),
                       F.max(F.size("vector")).alias("width")).first()
    width = largest["width"] or 0
    blocks = -(-asked.count() // query_block)
    path, schema = new_path(spark, "topk"), "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for number in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        if own.num_rows:
            ids = own.column("id").to_numpy()
            matrix = _matrix(own.column("vector").combine_chunks(), scale, width)
            block = Block(ids, matrix, k, scale, int(largest["m"] or 0))
            search_block(rows, block, k).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
