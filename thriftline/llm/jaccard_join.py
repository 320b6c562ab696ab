"""Similarity join of documents by Jaccard coefficient over word n-grams, with Bayesian pruning of candidates."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.workspace import write_through
from .frames import named, pieces

WIDTH, THRESHOLD = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s**4)**24: all but 3 in a million at 0.8.
BANDS, BAND_ROWS = 24, 4
#: MinHash values of their own for pruning, compared so many at a time; the posterior below which a pair is dropped.
VALUES, STEP, TOLERANCE = 64, 16, 1e-6
#: Members of a bucket, and their n-grams, that meet in one task; larger buckets are cut into cells of two blocks.
BLOCK_ROWS, BLOCK_GRAMS = 2048, 4_000_000
CACHE = 300_000


class WordHashes(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode())
        return value


WORDS = WordHashes()


def grams(words: list[str], width: int = WIDTH) -> np.ndarray:
    """The distinct n-grams of a document as sorted 64-bit hashes; a shorter document is a single one."""
    hashes = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    found = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        found = (found ^ hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    found = found * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(found ^ (found >> np.uint64(32)))


def class_key(words: list[str]) -> bytes:
    """Documents of the same words are one class; 128 bits identify it."""
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(7).integers(0, 1 << 32, (2, BANDS * BAND_ROWS + VALUES, 1), dtype=np.uint32)
    return made[0] | np.uint32(1), made[1]


def minhash(found: np.ndarray) -> np.ndarray:
    factor, shift = permutations()
    low = found.astype(np.uint32)
    least = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (low[at:at + 2048] * factor + shift).min(1), out=least)
    return least


def band_hashes(values: np.ndarray) -> np.ndarray:
    """One 64-bit hash per document and band, different for equal values in another band."""
    rows = values[:, :BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    mixed = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), rows.shape[:2]).copy()
    for k in range(BAND_ROWS):
        mixed = (mixed ^ rows[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each STEP values, how many must be equal for the pair to stay.

    With a uniform prior, the probability that the similarity reaches t after m
    of n values were equal is that of at most m successes in n + 1 trials with
    probability t.
    """
    bounds = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        bounds.append(m)
    return bounds


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id of every row; key, n (distinct n-grams), bands and values where it has an id and words, else nulls."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            there = batch.column(0).is_valid().to_pylist()
            keys, sizes, least = [], [], []
            for known, text in zip(there, batch.column(1).to_pylist()):
                words = (text or "").split() if known else []
                found = grams(words, width) if words else None
                keys.append(class_key(words) if words else None)
                sizes.append(len(found) if words else None)
                least.append(minhash(found) if words else np.zeros(BANDS * BAND_ROWS + VALUES, np.uint32))
            least = np.array(least)
            blank = np.array([k is None for k in keys])
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(0, (len(keys) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band_hashes(least).ravel()),
                mask=pa.array(blank))
            values = [None if k is None else v.tobytes() for k, v in zip(keys, least[:, BANDS * BAND_ROWS:].astype("<u2"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), bands, pa.array(values, pa.binary())],
                ["id", "key", "n", "bands", "values"])

    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(signed, f"id {kind}, key binary, n int, bands array<long>, values binary")


def buckets(classes: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one class: bucket, a and b (blocks of the cell), block, key.

    A bucket with many members is cut into blocks; every two blocks are a cell,
    so no task gets more than two blocks, and no pair is made outside of one.
    """
    spread = classes.select("key", "n", F.explode("bands").alias("bucket"))
    counts = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams")).filter("rows > 1")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    members = spread.join(counts.select("bucket", blocks.alias("blocks")), "bucket")
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least("block", other).alias("a"), F.greatest("block", other).alias("b")))
    return members.select("bucket", "block", "key", F.explode(cells).alias("cell")).select(
        "bucket", "cell.a", "cell.b", "block", "key")


def _groups(batches: Iterator[pa.RecordBatch], keys: int, convert) -> Iterator[tuple[list, np.ndarray]]:
    """Columns (by ``convert``, from batch to list of arrays) of whole groups, with the groups' bounds.

    Rows come sorted by the first ``keys`` columns; a group that a batch cuts is
    kept until the rest has come.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = convert(batch)
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        change = np.zeros(len(columns[0]), bool)
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        if not len(starts):
            held = columns
            continue
        held = [c[starts[-1]:] for c in columns]
        yield [c[:starts[-1]] for c in columns], np.concatenate([[0], starts])
    if held is not None:
        change = np.zeros(len(held[0]), bool)
        for c in held[:keys]:
            change[1:] |= c[1:] != c[:-1]
        yield held, np.concatenate([[0], np.flatnonzero(change), [len(held[0])]])


def _fixed(column: pa.Array, kind: str) -> np.ndarray:
    """Binaries of one length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def candidates(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Pairs that survive pruning, as lists: bucket, a, b, key, seq, partners (seqs of the same bucket and cell).

    ``members`` has bucket, a, b, block, key, bands and values.  A pair that
    meets in several buckets is looked at in that of its first common band only.
    """
    bounds = least_matches(threshold, tolerance)

    def convert(batch: pa.RecordBatch) -> list[np.ndarray]:
        bands = batch.column(5).flatten().to_numpy().reshape(-1, BANDS)
        return [*[batch.column(i).to_numpy() for i in range(4)], _fixed(batch.column(4), "V16")[:, 0], bands,
                _fixed(batch.column(6), "<u2")]

    def surviving(i: np.ndarray, j: np.ndarray, bucket, bands, values) -> tuple[np.ndarray, np.ndarray]:
        first = (bands[i] == bands[j]).argmax(1)
        here = bands[i, first] == bucket[i]
        i, j = i[here], j[here]
        equal = np.zeros(len(i), np.int64)
        for at, least in zip(range(0, VALUES, STEP), bounds):
            equal += (values[i, at:at + STEP] == values[j, at:at + STEP]).sum(1)
            kept = equal >= least
            i, j, equal = i[kept], j[kept], equal[kept]
        return i, j

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, a, b, block, key, bands, values), bounds_ in _groups(batches, 3, convert):
            n = len(bucket)
            group = np.repeat(np.arange(len(bounds_) - 1), np.diff(bounds_))
            size = np.diff(bounds_)[group]
            seq = np.arange(n) - bounds_[group]
            left, right = [], []
            for step in range(1, int(size.max(initial=1))):  # all pairs at this distance, in all groups at once
                i = np.flatnonzero(seq + step < size)
                i = i[(a[i] == b[i]) | (block[i] != block[i + step])]
                i, j = surviving(i, i + step, bucket, bands, values)
                left.append(i)
                right.append(j)
            if not left:
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            rows = np.unique(np.concatenate([i, j]))
            ends = np.searchsorted(i, rows, side="right")
            starts = np.searchsorted(i, rows, side="left")
            if len(rows):
                partners = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([starts, ends[-1:]]).astype(np.int32)), pa.array(seq[j].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[rows]), pa.array(a[rows]), pa.array(b[rows]),
                     pa.array([k.tobytes() for k in key[rows]], pa.binary()), pa.array(seq[rows].astype(np.int32)), partners],
                    ["bucket", "a", "b", "key", "seq", "partners"])

    return members.mapInArrow(pruned, "bucket long, a int, b int, key binary, seq int, partners array<int>")


def _links(own: list[np.ndarray], partners: dict[int, list[int]], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a cell those of its partners that reach the threshold, by exact counts.

    The members' n-grams become small numbers; a member marks its own, and one
    sum over the partners' numbers gives all intersections.
    """
    sizes = np.array([len(g) for g in own])
    ends = np.cumsum(sizes)
    _, numbers = np.unique(np.concatenate(own), return_inverse=True)
    marked = np.zeros(numbers.max() + 1, bool)
    for i, others in partners.items():
        others = np.array(others)
        mine = numbers[ends[i] - sizes[i]:ends[i]]
        marked[mine] = True
        for at in range(0, len(others), 256):
            some = others[at:at + 256]
            spans = np.concatenate([numbers[ends[j] - sizes[j]:ends[j]] for j in some])
            common = np.add.reduceat(marked[spans].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            union = sizes[i] + sizes[some] - common
            yield i, some[common >= threshold * union - 1e-9]
        marked[mine] = False


def verified(found: DataFrame, threshold: float, width: int) -> DataFrame:
    """Exact links within each cell: key, links (documents linked to it there), root (a key of its group there).

    ``found`` has bucket, a, b, seq, key, partners, copies and text.  A text that
    isn't of the key's class (an id that occurs twice) is passed over.
    """
    def of_cell(rows: list[tuple]) -> Iterator[tuple]:
        place = {seq: at for at, (seq, *_) in enumerate(rows)}
        partners = {at: [place[p] for p in r[2] if p in place] for at, r in enumerate(rows) if len(r[2])}
        partners = {at: own for at, own in partners.items() if own}
        if not partners:
            return
        links, root = [0] * len(rows), list(range(len(rows)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, others in _links([r[4] for r in rows], partners, threshold):
            for j in others.tolist():
                links[i] += rows[j][3]
                links[j] += rows[i][3]
                x, y = top(i), top(j)
                if x != y:  # the smaller key stands for the group
                    x, y = (x, y) if rows[x][1] < rows[y][1] else (y, x)
                    root[y] = x
        for i, n in enumerate(links):
            if n:
                yield rows[i][1], n, rows[top(i)][1]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, out = None, {}, []
        for batch in pieces(batches, 512):
            for bucket, a, b, seq, key, partners, copies, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (bucket, a, b) != cell:
                    out += of_cell(list(rows.values()))
                    cell, rows = (bucket, a, b), {}
                words = (text or "").split()
                if words and class_key(words) == key:
                    rows[seq] = (seq, key, partners, copies, grams(words, width))
            if len(out) > 1024:
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "links", "root"), r)) for r in out], schema)
                out = []
        out += of_cell(list(rows.values()))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "links", "root"), r)) for r in out], schema)

    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
    return found.mapInArrow(checked, "key binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """The connected components of edges (key, root): key, label, the label being one of its keys.

    Each round every label that has a smaller neighbour takes the place of the
    smallest, and the edges are drawn between labels anew, so they get fewer.
    Keys are random digests: few rounds suffice.  Every round's tables are
    written, and hubs shrink before they are shuffled.
    """
    labels = write_through(
        edges.select("key").union(edges.select(F.col("root").alias("key"))).distinct().withColumn("label", F.col("key")), "labels")
    links = edges.select(F.col("key").alias("x"), F.col("root").alias("y"))
    while True:
        links = links.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        links = write_through(links, "label_links")
        if links.isEmpty():
            return labels
        parent = write_through(links.groupBy("x").agg(F.min("y").alias("parent")).withColumnRenamed("x", "child"), "parents")
        labels = write_through(
            labels.join(parent, F.col("label") == F.col("child"), "left").select("key", F.coalesce("parent", "label").alias("label")),
            "labels")
        moved = links.join(parent, F.col("x") == F.col("child")).select(F.col("parent").alias("x"), "y")
        links = moved.join(parent, F.col("y") == F.col("child"), "left").select("x", F.coalesce("parent", "y").alias("y"))


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per row of ``docs``: its id, class_id and n_links.

    Two documents are linked if the Jaccard coefficient of their sets of word
    n-grams is at least ``threshold``.  ``n_links`` counts the other documents
    that a document is linked to, copies included.  ``class_id`` is the smallest
    id among all documents that are connected by links.

    1. Documents of the same words become one class, with its number of copies.
    2. Bands of MinHash values put classes into buckets; only buckets with more
       than one class go on, large ones in cells of bounded size.
    3. Pairs in a cell compare further MinHash values step by step; a pair is
       dropped when the posterior probability that it reaches ``threshold`` falls
       below ``tolerance``.  A pair is looked at in its first common band only.
    4. The texts of the rest are fetched and their n-grams counted exactly.
    5. Links are summed per class, and connected classes get a common label.

    No pair is ever a row: cells return members with lists, then sums.  Words are
    what stands between white space.  A document with fewer than ``width`` words
    is one n-gram.  Null and empty texts, and rows without an id, have no words to
    compare: they have no links and are a class of their own.  Rows with equal ids
    are separate documents.  Other columns are ignored.
    """
    signed = write_through(signatures(docs, id_col, text_col, width), "signatures")
    classes = write_through(signed.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("values").alias("values")), "classes")

    members = buckets(classes).join(classes.select("key", "bands", "values"), "key")
    members = members.select("bucket", "a", "b", "block", "key", "bands", "values")
    members = members.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    found = write_through(candidates(members, threshold, tolerance), "candidates")

    wanted = found.select("key").distinct().join(classes.select("key", "first", "copies"), "key")
    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).join(
        wanted, F.col("id") == F.col("first")).select("key", "copies", "text")
    cells = found.join(texts, "key").select("bucket", "a", "b", "seq", "key", "partners", "copies", "text")
    cells = cells.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "seq")
    linked = write_through(verified(cells, threshold, width), "links")

    labels = components(linked.select("key", "root").filter("key <> root").distinct())
    per_class = linked.groupBy("key").agg(F.sum("links").alias("links"))
    named_labels = labels.join(classes.select("key", "first"), "key")
    smallest = named_labels.groupBy("label").agg(F.min("first").alias("smallest"))
    of_class = labels.join(smallest, "label").select("key", "smallest")
    facts = classes.select("key", "first", "copies").join(per_class, "key", "left").join(of_class, "key", "left").select(
        F.col("key").alias("c_key"), F.coalesce("smallest", "first").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))

    joined = signed.select("id", "key").join(facts, F.col("key") == F.col("c_key"), "left")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
