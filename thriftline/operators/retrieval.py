"""Embedding, exact top-k search, evaluation and incremental re-embedding.

Search is exact.  Queries are taken in blocks of bounded size, which travel to
the chunks; these are read in place, without a shuffle or a copy.  Scores are
computed with numpy, and a task keeps only the best candidates of each query over
all it reads, so no pair of query and chunk ever becomes a row.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import fixed_values as fv, vectors
from ..plans.workspace import new_path, write_through
from .analytics import rank_per_key

# Queries of a block (about; they are dealt by hash), similarities held at once (32 MB)
QUERY_BLOCK = 2_000
MAX_CELLS = 4_000_000
OVERFETCH = 3


# --- encoders ---------------------------------------------------------------------

def hashing_encoder(dims: int = 256) -> Callable[[list[str]], np.ndarray]:
    """An offline stand-in encoder: signed counts of word hashes, same result everywhere."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            words = (text or "").lower().encode("utf-8").split() if (text or "").isascii() else [
                w.encode("utf-8") for w in (text or "").lower().split()]
            hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
            out[row] = np.bincount(hashes % dims, np.where((hashes >> 16) & 1, 1.0, -1.0), dims)
        return out

    return encode


def embed(df: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None,
          text_col: str = "content", batch: int = 256) -> DataFrame:
    """Encode whole texts in batches inside tasks and add an ``embedding`` column."""
    encode = encoder or hashing_encoder()
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch].copy()
                part["embedding"] = list(np.asarray(encode(part[text_col].tolist()), dtype="float64"))
                yield part

    return df.mapInPandas(run, schema)


def embed_tfidf(df: DataFrame, text_col: str = "content", dims: int = 1 << 10) -> DataFrame:
    """The JVM-side default: hashed term counts, IDF fitted on the corpus, unit length."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"\W+"),
              HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
              IDF(inputCol="_tf", outputCol="_tfidf"),
              Normalizer(inputCol="_tfidf", outputCol="_unit")]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.withColumn("embedding", vector_to_array("_unit")).select(*df.columns, "embedding")


def l2_normalise(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, vectors.unit(F.col(column)))


# --- search -----------------------------------------------------------------------

def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in values])


def _admitted(query_states: list, states: list) -> np.ndarray:
    """Which chunks (columns) a query (row) may see: its own state or all states; no state sees everything."""
    own = np.asarray(states, dtype=object)
    everywhere = own == fv.ALL_STATES
    by_state = {s: everywhere | (own == s) if s is not None else np.ones(len(own), dtype=bool) for s in set(query_states)}
    return np.stack([by_state[s] for s in query_states])


def _keep_best(similarity: np.ndarray, keep: int) -> np.ndarray:
    """Mask of the ``keep`` largest values per row; among equal values the leftmost stay."""
    if similarity.shape[1] <= keep:
        return similarity > -np.inf
    cut = -np.partition(-similarity, keep - 1, axis=1)[:, keep - 1:keep]
    mask = similarity >= cut
    for row in np.flatnonzero(mask.sum(axis=1) > keep):
        above = similarity[row] > cut[row]
        ties = np.flatnonzero(similarity[row] == cut[row])[:keep - int(above.sum())]
        mask[row] = above
        mask[row, ties] = True
    return mask & (similarity > -np.inf)


def _best(chunk_rows: pd.DataFrame, query_ids, query_states, query_matrix, keep, state_filter) -> Iterator[pd.DataFrame]:
    """The best ``keep`` chunks of this block for every query, a slice of queries at a time."""
    chunk_rows = chunk_rows.sort_values("chunk_id", kind="stable")  # ties go to the smaller id
    matrix = _matrix(chunk_rows["embedding"]).T
    ids, states = chunk_rows["chunk_id"].to_numpy(), chunk_rows["state"].to_numpy(dtype=object)
    step = max(1, MAX_CELLS // max(1, len(ids)))
    for start in range(0, len(query_ids), step):
        part = slice(start, start + step)
        similarity = query_matrix[part] @ matrix
        if state_filter:
            similarity = np.where(_admitted(query_states[part], states), similarity, -np.inf)
        rows, columns = np.nonzero(_keep_best(similarity, keep))
        yield pd.DataFrame({
            "query_id": np.asarray(query_ids[part])[rows],
            "query_state": np.asarray(query_states[part], dtype=object)[rows],
            "chunk_id": ids[columns], "state": states[columns], "similarity": similarity[rows, columns]})


def _search_block(sent: pd.DataFrame, chunks: DataFrame, keep: int, state_filter: bool, schema: T.StructType) -> DataFrame:
    """For one block of queries the best ``keep`` chunks of every task."""
    ids, states, matrix = sent["query_id"].tolist(), sent["query_state"].tolist(), _matrix(sent["query_vector"])
    shared = chunks.sparkSession.sparkContext.broadcast((ids, states, matrix))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_states, query_matrix = shared.value
        best = None
        for frame in frames:
            if len(frame):
                found = _best(frame, query_ids, query_states, query_matrix, keep, state_filter)
                best = pd.concat([*([] if best is None else [best]), *found], ignore_index=True)
                best = best.sort_values(["similarity", "chunk_id"], ascending=[False, True], kind="stable").groupby(
                    "query_id", sort=False).head(keep)
        if best is not None and len(best):
            yield best

    return chunks.mapInPandas(scan, schema)


def _candidates(queries: DataFrame, chunks: DataFrame, keep: int, state_filter: bool, query_block: int) -> DataFrame:
    """(query, chunk, similarity) rows: a superset of the best ``keep`` chunks per query."""
    q = write_through(queries.select("query_id", "query_state", F.col("embedding").alias("query_vector")), "queries")
    c = chunks.select("chunk_id", "state", "embedding")
    schema = T.StructType([
        q.schema["query_id"], T.StructField("query_state", T.StringType()),
        c.schema["chunk_id"], T.StructField("state", T.StringType()),
        T.StructField("similarity", T.DoubleType())])
    blocks = -(-q.count() // query_block)
    # Every block's hits are written before the next is searched: the plan doesn't grow with the queries.
    path, searched = new_path(q.sparkSession, "hits"), False
    for number in range(blocks):
        sent = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toPandas()  # one block
        if len(sent):
            _search_block(sent, c, keep, state_filter, schema).write.mode("append").parquet(path)
            searched = True
    return q.sparkSession.read.schema(schema).parquet(path) if searched else q.sparkSession.createDataFrame([], schema)


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, state_filter: bool = False,
          boost: float = fv.STATE_BOOST, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best chunks per query (query_id, chunk_id, score, rank).

    queries: query_id, embedding and optionally query_state; chunks: chunk_id,
    embedding, state.  Vectors are brought to unit length, the best 3k by inner
    product are taken, rounded to three places, raised by ``boost`` where the
    query's state occurs in the chunk's, and sorted again.  With
    ``state_filter`` only chunks of the query's own state or all states count.
    """
    if "query_state" not in queries.columns:
        queries = queries.withColumn("query_state", F.lit(None).cast("string"))
    keep = k * OVERFETCH
    found = _candidates(l2_normalise(queries), l2_normalise(chunks), keep, state_filter, query_block)
    first = rank_per_key(found, "query_id", [F.desc("similarity"), F.col("chunk_id")], keep).drop("rank")
    inside = F.lower("state").contains(F.lower("query_state"))
    score = F.round("similarity", 3) + F.when(inside, F.lit(boost)).otherwise(0.0)
    scored = first.withColumn("score", F.round(score, 3))
    best = rank_per_key(scored, "query_id", [F.desc("score"), F.desc("similarity"), F.col("chunk_id")], k)
    return best.select("query_id", "chunk_id", "score", "rank")


def filtered_top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, **options) -> DataFrame:
    """Search only among chunks for all states or for the query's own state."""
    return top_k(queries, chunks, k, state_filter=True, **options)


# --- evaluation and sync --------------------------------------------------------------

def retrieval_eval(hits: DataFrame, expected: DataFrame, chunk_groups: DataFrame) -> DataFrame:
    """Per query: is the first hit's group the expected one, hit at k, reciprocal rank."""
    graded = (hits.join(chunk_groups.select("chunk_id", "target_group"), "chunk_id", "left")
              .join(expected.select("query_id", "expected_group"), "query_id", "left"))
    right = F.col("target_group") == F.col("expected_group")
    per_query = graded.groupBy("query_id").agg(
        F.coalesce(F.max(F.when(F.col("rank") == 1, right.cast("int"))), F.lit(0)).alias("top1"),
        F.min(F.when(right, F.col("rank"))).alias("_first"))
    return per_query.select(
        "query_id", "top1", F.when(F.col("_first").isNotNull(), 1).otherwise(0).alias("hit"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"))


def eval_summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.count("*").alias("queries"), F.avg("top1").alias("top1_rate"),
        F.avg("hit").alias("hit_at_k"), F.avg("reciprocal_rank").alias("mrr"))


def sync_embeddings(old_chunks: DataFrame, new_chunks: DataFrame, old_vectors: DataFrame,
                    encoder=None, key: str = "chunk_id") -> DataFrame:
    """Vectors for the new chunk table, encoding only inserted and changed chunks.

    Unchanged vectors are taken over; vectors of deleted chunks are dropped.
    """
    from ..sources.tables import changed_between, merge_upsert

    changed = changed_between(old_chunks, new_chunks, key)
    fresh = embed(new_chunks.join(changed, key, "left_semi"), encoder)
    kept = old_vectors.join(new_chunks.select(key), key, "left_semi")
    return merge_upsert(kept, fresh.select(*old_vectors.columns), key, check=False, source_keys=changed)
