"""Importance resampling towards a target distribution over hashed word features, hashed in matrices of equal length."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..plans.workspace import write_through
from .byte_words import LOWER, array_of
from .frames import named

#: Bytes of text whose features are found at once (a longer text is taken alone), and bytes of a matrix of features.
TEXT_BYTES, MATRIX_BYTES = 4 << 20, 8 << 20
#: Ranges of ids within which equal scores are ranked.
RANGES = 64
IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32, eight shifts of every byte."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return value


TABLE = crc_table()


def crc32(features: pa.Array) -> np.ndarray:
    """CRC-32 of every value of a binary array (64-bit offsets, no nulls).

    Values of one length are the rows of a matrix of bytes.  All rows take a
    step together, one column after the other; the results go back to their
    values' places.
    """
    offsets = np.frombuffer(features.buffers()[1], np.int64)[features.offset:features.offset + len(features) + 1]
    data = np.frombuffer(features.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros(len(features), np.uint32)
    order = np.argsort(lengths, kind="stable")
    sizes, starts = np.unique(lengths[order], return_index=True)
    for length, own in zip(sizes.tolist(), np.split(order, starts[1:])):
        for at in range(0, len(own), max(1, MATRIX_BYTES // max(1, length))):
            some = own[at:at + max(1, MATRIX_BYTES // max(1, length))]
            crc = np.full(len(some), 0xFFFFFFFF, np.uint32)
            if len(some) == 1:  # a view: very long values are never copied
                columns = data[offsets[some[0]]:offsets[some[0]] + length, None]
            else:
                columns = np.ascontiguousarray(data[offsets[some, None] + np.arange(length)].T)
            for column in columns:
                crc = TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[some] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of lower-cased texts (binaries with 64-bit offsets, no nulls), and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = (texts.buffers()[2] or pa.py_buffer(b""))[offsets[0]:offsets[-1]].to_pybytes().translate(LOWER)
    data = np.frombuffer(raw, np.uint8)
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1] - offsets[0]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]  # a word ends where its text does
    starts = np.flatnonzero(begins)
    return array_of(starts, inside, data), np.diff(np.searchsorted(starts, offsets - offsets[0]))


def feature_buckets(texts: pa.Array, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all runs of 1 to ``width`` words of each text, and how many each text has.

    Only distinct features are hashed.
    """
    single, n_words = words(texts)
    row = np.repeat(np.arange(len(texts)), n_words)
    found, rows, runs = [], [], single
    for k in range(width):
        if k:  # runs of one word more; a run that would pass the end of its text is left out
            runs = pc.binary_join_element_wise(runs.slice(0, max(0, len(runs) - 1)), single.slice(k), pa.scalar(b" ", pa.large_binary()))
        there = np.ones(len(runs), bool) if not k else row[:len(runs)] == row[k:]
        distinct = runs.dictionary_encode()
        bucket = (crc32(distinct.dictionary) % np.uint32(buckets)).astype(np.int64)
        found.append(bucket[distinct.indices.to_numpy()][there])
        rows.append(row[:len(runs)][there])
    if width == 1:
        return found[0], n_words
    rows, found = np.concatenate(rows), np.concatenate(found)
    return found[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(texts))


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows, at most TEXT_BYTES of texts at a time, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > TEXT_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def hashed(docs: DataFrame, id_col: str, text_col: str, width: int, buckets: int) -> DataFrame:
    """id, n_words, n_features and the features' buckets (binary, unsigned little-endian integers of 16 or 32 bits)."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, 1):
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            bucket, counts = feature_buckets(texts, width, buckets)
            data = bucket.astype(_kind(buckets))
            ends = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
            n_words = counts if width == 1 else words(texts)[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words.astype(np.int64)), pa.array(counts.astype(np.int64)), packed.cast(pa.binary())], names)

    names = ["id", "n_words", "n_features", "buckets"]
    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    return texts.mapInArrow(found, "id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of the whole table fall into each bucket.

    A task counts its own features, so it sends at most one row per bucket.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), _kind(buckets)), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of the smoothed shares) per bucket."""
    size, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: ((t + 1.0) * (all_source + size)) / ((s + 1.0) * (all_target + size))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and weight, the floored mean gain of a document's features."""
    kind = _kind(len(gain))

    def meant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(value.as_buffer(), kind)].sum()) for value in batch.column(3)]
            weight = np.array(sums, np.int64) // np.maximum(1, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return found.mapInArrow(meant, "id long, n_words long, n_features long, weight long")


def noise(seed: int, key: Column) -> Column:
    """floor(1000 * a Gumbel variable) that depends on the seed and the id only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... over the highest scores of the eligible rows, ties to the smaller id.

    Scores are integers, so the number of distinct ones is small.  Their counts
    give the lowest drawn score and how many rows are above each.  Rows of one
    score are ranked within ranges of ids and moved on by the rows of the ranges
    before, so no score is a hot group.  Only drawn scores are shuffled.
    """
    spark = scored.sparkSession
    usual = scored.filter(eligible)
    counts = write_through(usual.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "score_counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = percent * total // 100
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = counts.withColumn("above", above).filter(F.col("above") < wanted)
    lowest = above.agg(F.min("score")).first()[0]
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    reaching = eligible & (F.col("score") >= lowest)
    cuts = usual.filter(F.col("score") >= lowest).agg(
        F.percentile_approx("id", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]
    cut_array = F.array(*[F.lit(c).cast("long") for c in cuts])
    drawn = scored.filter(reaching).withColumn("range", F.size(F.filter(cut_array, lambda c: c < F.col("id"))))
    per_range = drawn.groupBy("score", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("score").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = per_range.withColumn("earlier", earlier).join(above.select("score", "above"), "score").select(
        "score", "range", (F.col("above") + F.col("earlier")).alias("base"))
    within = Window.partitionBy("score", "range").orderBy("id", "n_features")
    placed = drawn.withColumn("place", F.row_number().over(within)).join(bases, ["score", "range"])
    placed = placed.withColumn("rank", F.col("base") + F.col("place"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    others = scored.filter(~F.coalesce(reaching, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others)


def resample(
    docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score and rank (all long).

    Features are runs of 1 to ``width`` words, hashed into ``buckets`` by CRC-32.
    Each bucket has a gain, the logarithm of its smoothed share in ``target``
    over that in ``docs``; a document's weight is the floored mean gain of its
    features, repeats counted.  The score adds noise that depends on the id
    only, so the ``percent`` highest scores are a sample without replacement by
    importance.  ``rank`` numbers the drawn documents; others have none.

    Texts are read once: their buckets (two bytes a feature) are written and
    serve the counts and the weights.  All rows count towards the gains.

    A null or empty text has no features and weight 0.  Documents of fewer than
    ``min_words`` words are scored, never drawn.  A row without an id has no
    score and isn't drawn, nor counted among those that may be.  Rows with equal
    ids are separate documents; equal scores of one id are ranked by
    ``n_features``.  An empty target has no features, which leaves all shares
    smoothed.  Without rows the result is empty.  Other columns are ignored.
    """
    found = write_through(hashed(docs, id_col, text_col, width, buckets), "feature_buckets")
    wanted = hashed(target.select(named(target_text_col).alias("text")).withColumn("id", F.lit(0)), "id", "text", width, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    scored = weighted(found, gain).withColumn("score", F.col("weight") + noise(seed, F.col("id")))
    scored = write_through(scored, "scored")
    out = ranked(scored, F.col("id").isNotNull() & (F.col("n_words") >= min_words), percent)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
