"""Near-duplicate documents by SetSketch registers: banded, compared by joint likelihood, confirmed on full sets."""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.workspace import write_through
from .frames import named, pieces
from .hot_keys import attach_listed as attach
from .jaccard_join import components

WIDTH, THRESHOLD = 5, 0.85
#: Base, rate and largest value of the registers, 16 bits each; with this base two registers are equal about as often as two minima.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: A pair of similarity s shares a band with probability 1 - (1 - s**4)**24, all but 2 in a hundred million at 0.85.
BANDS, BAND_ROWS = 24, 4
REGISTERS = BANDS * BAND_ROWS
#: A pair is dropped if its likelihood at the threshold is below the largest by more than so many standard deviations.
DEVIATIONS = 5.5
#: Members of a bucket, and their shingles, that meet in one task; members that are compared with one hub in a task.
BLOCK_ROWS, BLOCK_SHINGLES, HUB_ROWS = 2048, 4_000_000, 512
#: Pairs of a cell whose likelihoods are computed together.
PAIRS = 65_536
#: Bytes of text whose words are hashed at once.
PART = 1 << 20
SPACE = re.compile(rb"[ \t-\r]")
IN_WORD = np.array([b != 0x20 and not 9 <= b <= 13 for b in range(256)])


# --- sets and registers ---------------------------------------------------------------------------------------------

def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words in ``raw``, and their 64-bit hashes: sums of random numbers per byte times powers of a constant."""
    values, powers = _numbers()
    data = np.frombuffer(raw, np.uint8)
    inside = IN_WORD[data]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    data, inside = data[starts[0]:], inside[starts[0]:]
    starts_here = starts - starts[0]
    place = np.arange(len(data)) - np.repeat(starts_here, np.diff(np.append(starts_here, len(data))))
    terms = values[data] * powers[place & (len(powers) - 1)]
    far = place >= len(powers)  # the powers start anew, each time with other bits flipped
    if far.any():
        terms[far] ^= (place[far] // len(powers)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    terms[~inside] = 0
    found = np.add.reduceat(terms, starts_here)
    found ^= found >> np.uint64(32)
    return starts, found * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Per text the hashes of its words: what stands between ASCII white space, A-Z lower-cased.

    Bytes do both as the definition asks.  About PART bytes are hashed at a time;
    a longer text is cut between words.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def settle() -> None:
        starts, found = _hashed(b"\n".join(held))
        ends = np.cumsum([len(raw) + 1 for raw in held])
        out.extend(np.split(found, np.searchsorted(starts, ends[:-1])))
        held.clear()

    size = 0
    for text in texts:
        raw = (text or "").encode().lower()
        if held and size + len(raw) > PART:
            settle()
            size = 0
        if len(raw) <= PART:
            held.append(raw)
            size += len(raw) + 1
            continue
        parts, at = [], 0
        while at < len(raw):
            gap = SPACE.search(raw, at + PART)
            end = gap.start() if gap else len(raw)
            parts.append(_hashed(raw[at:end])[1])
            at = end
        out.append(np.concatenate(parts))
    if held:
        settle()
    return out


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The set of a document as sorted 64-bit hashes of its distinct shingles; fewer words than ``width`` are one."""
    own = hashes
    if not len(own):
        return np.zeros(0, np.uint64)
    n = max(1, len(own) - width + 1)
    found = np.full(n, min(width, len(own)), np.uint64)
    for k in range(min(width, len(own))):
        found = (found ^ hashes[k:k + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
        found ^= found >> np.uint64(31)
    found = np.sort(found * np.uint64(0x9E3779B185EBCA87))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


@lru_cache(maxsize=1)
def _numbers() -> tuple[np.ndarray, np.ndarray]:
    """A random odd number per byte, and 64 powers of a constant."""
    values = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
    powers = np.ones(64, np.uint64)
    powers[1:] = np.uint64(0xD1342543DE82EF95)
    return values, np.multiply.accumulate(powers)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(13).integers(0, 1 << 32, (2, REGISTERS, 1), dtype=np.uint32)
    return made[0] | np.uint32(1), made[1]


def minima(found: np.ndarray) -> np.ndarray:
    """Per register the smallest hash (32 bits) of the set."""
    factor, shift = _functions()
    high = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    room = np.empty((REGISTERS, min(len(high), 512)), np.uint32)
    for at in range(0, len(high), 512):
        own = high[at:at + 512]
        mixed = np.multiply(own, factor, out=room[:, :len(own)])
        mixed += shift
        np.minimum(least, mixed.min(1), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """SetSketch registers: floor(1 - log_b x) of minima x of exponential variables of rate RATE, cut to 0..TOP.

    The logarithm falls with x, so the largest value over a set belongs to the
    smallest hash: minima come first, one logarithm per register is enough.
    """
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def band_hashes(values: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row of registers and band; equal registers give another hash in another band."""
    rows = values.reshape(len(values), BANDS, BAND_ROWS).astype(np.uint64)
    mixed = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25), rows.shape[:2]).copy()
    for k in range(BAND_ROWS):
        mixed = (mixed ^ rows[:, :, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


# --- joint likelihood -----------------------------------------------------------------------------------------------

def _larger(share: np.ndarray) -> np.ndarray:
    """Probability that a register is larger in the set that has ``share`` of the weight for itself."""
    return -np.log1p(-np.maximum(share, 0) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of similarity ``j``, given how many registers are larger in the first and in the second set.

    ``u`` is the first set's size divided by the sum of both.
    """
    first, second = _larger(u - (1 - u) * j), _larger((1 - u) - u * j)
    tiny = 1e-300
    return (more * np.log(np.maximum(first, tiny)) + less * np.log(np.maximum(second, tiny))
            + (REGISTERS - more - less) * np.log(np.maximum(1 - first - second, tiny)))


def compared(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``more``, ``less`` and ``u`` of pairs of registers (rows) and set sizes."""
    return (a > b).sum(1), (a < b).sum(1), n_a / (n_a + n_b)


def estimate(more: np.ndarray, less: np.ndarray, u: np.ndarray, steps: int = 40) -> np.ndarray:
    """The similarity of greatest likelihood, by golden section: the likelihood has one peak."""
    ratio = (5 ** 0.5 - 1) / 2
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(steps):
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        right = log_likelihood(y, more, less, u) > log_likelihood(x, more, less, u)
        low, high = np.where(right, x, low), np.where(right, high, y)
    return (low + high) / 2


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a pair can't be excluded: sizes allow ``threshold``, and so does the ratio of likelihoods."""
    out = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    rows = np.flatnonzero(out)
    more, less, u = compared(a[rows], b[rows], n_a[rows].astype(float), n_b[rows].astype(float))
    unclear = REGISTERS - more - less < threshold * REGISTERS  # more equal registers than expected need no estimate
    some = rows[unclear]
    more, less, u = more[unclear], less[unclear], u[unclear]
    best = estimate(more, less, u)
    at = np.minimum(threshold, np.minimum(u / (1 - u), (1 - u) / u))
    gap = log_likelihood(best, more, less, u) - log_likelihood(at, more, less, u)
    out[some] = (best >= at) | (2 * gap <= DEVIATIONS ** 2)
    return out


@lru_cache(maxsize=4)
def least_equal(threshold: float) -> int:
    """Equal registers that a pair at the threshold has, but for a probability that DEVIATIONS allow on one side.

    A bound for the sake of speed: what it drops the likelihood would drop as well, or all but.
    """
    tolerance, total, m = math.erfc(DEVIATIONS / 2 ** 0.5) / 2, 0.0, -1
    while total < tolerance:
        m += 1
        total += math.comb(REGISTERS, m) * threshold ** m * (1 - threshold) ** (REGISTERS - m)
    return m


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on two full sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


# --- Spark ----------------------------------------------------------------------------------------------------------

def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, k1 and k2 (digest of the words), n (size of the set), registers (binary) and bands; nulls without words."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            keys, sizes, least = [], [], []
            for own in word_hashes(batch.column(1).to_pylist()):
                found = shingles(own, width)
                keys.append(_key(own) if len(own) else None)
                sizes.append(len(found))
                least.append(minima(found))
            values = registers(np.array(least))
            halves = np.frombuffer(b"".join(k or bytes(16) for k in keys), ">i8").astype(np.int64).reshape(-1, 2)
            blank = np.array([k is None for k in keys])
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(0, (len(keys) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band_hashes(values).ravel()),
                mask=pa.array(blank))
            packed = [None if k is None else v.tobytes() for k, v in zip(keys, values.astype("<u2"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(halves[:, 0], mask=blank), pa.array(halves[:, 1], mask=blank), pa.array(sizes, pa.int64()),
                 pa.array(packed, pa.binary()), bands],
                ["id", "k1", "k2", "n", "registers", "bands"])

    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    return texts.mapInArrow(made, "id long, k1 long, k2 long, n long, registers binary, bands array<long>")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), REGISTERS)


def _key(own: np.ndarray) -> bytes:
    """The digest of a document's words in their order."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _class_key(k1: str, k2: str) -> Column:
    """The 16 bytes of a class's digest from its halves."""
    return F.concat(*[F.unhex(F.lpad(F.hex(k), 16, "0")) for k in (k1, k2)])


EDGES = "key binary, root binary"


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.binary()) for i in (0, 1)], ["key", "root"])


def hub_pairs(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Each member of a bucket with the bucket's smallest and largest key, if their registers allow a link.

    Columns k1 and hub; two rows a member and bucket at most, however large it is.
    """
    pairs = members.select("k1", F.explode(F.array("low", "high")).alias("hub")).filter("k1 <> hub").distinct()
    pairs = write_through(pairs, "hub_pairs")
    own = classes.select("k1", "n", "registers")
    hubs = write_through(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("pairs")).join(
        own.select(F.col("k1").alias("hub"), F.col("n").alias("hub_n"), F.col("registers").alias("hub_registers")), "hub"), "hubs")
    both = attach(pairs, hubs, ["hub"], "pairs", pairs.count(), "inner").join(own, "k1")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8192):
            some = may_reach(_registers(batch.column(3)), _registers(batch.column(5)), batch.column(2).to_numpy(), batch.column(4).to_numpy(), threshold)
            yield batch.select(["k1", "hub"]).filter(pa.array(some))

    return both.select("k1", "hub", "n", "registers", "hub_n", "hub_registers").mapInArrow(kept, "k1 long, hub long")


def confirmed_hubs(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Edges between members and hubs whose full sets are linked.

    A hub's members are dealt into blocks, to each of which its text travels
    once.  It comes first in its block; then members are read one by one.
    """
    blocks = write_through(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("pairs")).withColumn(
        "blocks", F.ceil(F.col("pairs") / HUB_ROWS).cast("int")), "hub_blocks")
    dealt = attach(pairs, blocks, ["hub"], "pairs", pairs.count(), "inner")
    members = dealt.join(texts, "k1").select(
        "hub", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("place"), "text")
    hubs = blocks.join(texts, F.col("hub") == F.col("k1")).select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("place"), "text")
    cells = hubs.unionByName(members).repartition("hub", "block").sortWithinPartitions("hub", "block", "place")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own = None, []
        for batch in pieces(batches, 256):
            found = []
            columns = [c.to_pylist() for c in batch.columns]
            for hub, block, place, held in zip(*columns[:3], word_hashes(columns[3])):
                if cell != (hub, block):
                    cell, own = (hub, block), []
                if not place:  # two texts whose keys agree in 64 of 128 bits are both hubs
                    if (key := _key(held)) not in dict(own):
                        own.append((key, shingles(held, width)))
                elif own:
                    mine = shingles(held, width)
                    found += [(_key(held), key) for key, theirs in own if linked(mine, theirs, percent)]
            if found:
                yield _edges(found)

    return cells.mapInArrow(confirmed, EDGES)


def _cells(rows: Iterator[tuple], same=None) -> Iterator[list[tuple]]:
    """Rows of whole cells; they come sorted by bucket, a and b, the first three columns.

    Of rows for which ``same`` gives one value, a cell has the first.
    """
    cell, held, seen = None, [], set()
    for row in rows:
        if row[:3] != cell:
            if held:
                yield held
            cell, held, seen = row[:3], [], set()
        if same is None or (value := same(row)) not in seen:
            held.append(row)
            if same is not None:
                seen.add(value)
    if held:
        yield held


def _open_pairs(rows: list, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a cell whose labels differ, for which this is the first common band, and whose registers allow a link.

    A row is (bucket, a, b, block, k1, label, n, registers, bands).
    """
    bucket, a, b = rows[0][:3]
    block, label = np.array([r[3] for r in rows]), np.array([r[5] for r in rows])
    n, values, bands = np.array([r[6] for r in rows]), np.array([r[7] for r in rows]), np.array([r[8] for r in rows])
    band = int((bands[0] == bucket).argmax())
    needed = least_equal(threshold)
    found, held = [], []

    def settle() -> None:
        i, j = (np.concatenate(x) for x in zip(*held))
        kept = may_reach(values[i], values[j], n[i], n[j], threshold)
        found.append((i[kept], j[kept]))
        held.clear()

    for i in range(len(rows) - 1):
        j = np.flatnonzero(label[i + 1:] != label[i]) + i + 1
        if a != b:
            j = j[block[j] != block[i]]
        j = j[(values[j] == values[i]).sum(1) >= needed]
        j = j[~(bands[j, :band] == bands[i, :band]).any(1)]
        if len(j):
            held.append((np.full(len(j), i), j))
        if sum(len(x[1]) for x in held[-64:]) > PAIRS or len(held) >= 4096:
            settle()
    if held:
        settle()
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def mixed_cells(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets in which not all are connected yet: bucket, a, b, block, k1, label, n, registers, bands.

    ``labels`` has k1 and label of the classes that are connected to others.
    Large buckets are cut into blocks, every two of which are a cell, so a task
    holds two blocks at most, and each pair of a bucket meets in one cell.
    """
    labelled = members.select("bucket", "k1").join(labels, "k1", "left").withColumn("label", F.coalesce("label", "k1"))
    labelled = write_through(labelled, "labelled_members")
    mixed = labelled.groupBy("bucket").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("rows")).filter("x <> y")
    mixed = write_through(mixed.select("bucket", "rows"), "mixed_buckets")
    unsettled = attach(labelled, mixed, ["bucket"], "rows", labelled.count(), "inner")
    unsettled = write_through(unsettled.join(classes.select("k1", "n", "registers", "bands"), "k1"), "unsettled")
    blocks = unsettled.groupBy("bucket").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("rows")).select(
        "bucket", "rows", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = attach(unsettled, write_through(blocks, "bucket_blocks"), ["bucket"], "rows", unsettled.count(), "inner")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least("block", other).alias("a"), F.greatest("block", other).alias("b")))
    return dealt.withColumn("cell", F.explode(cells)).select(
        "bucket", "cell.a", "cell.b", "block", "k1", "label", "n", "registers", "bands")


def confirmed_cells(cells: DataFrame, texts: DataFrame, threshold: float, percent: int, width: int) -> DataFrame:
    """Edges inside cells.  A first pass names the members that need their text; only these come with it to the second.

    A pair whose ends are connected already is passed over, and no pair leaves
    its task.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in pieces(batches, 1024):
            values = _registers(batch.column(7))
            bands = batch.column(8).flatten().to_numpy().reshape(-1, BANDS)
            yield from zip(*[c.to_pylist() for c in batch.columns[:7]], values, bands, *[c.to_pylist() for c in batch.columns[9:]])

    def wanting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(read(batches)):
            i, j = _open_pairs(rows, threshold)
            own = [rows[at] for at in np.unique(np.concatenate([i, j])).tolist()]
            if own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own], pa.int32()),
                     pa.array([r[2] for r in own], pa.int32()), pa.array([r[4] for r in own], pa.int64())], ["bucket", "a", "b", "k1"])

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(read(batches), same=lambda r: (r[4], r[9])):
            i, j = _open_pairs(rows, threshold)
            sets, root = {}, {}

            def top(x):
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = up
                return x

            def own(x):
                if x not in sets:
                    held = word_hashes([rows[x][9]])[0]
                    sets[x] = _key(held), shingles(held, width)
                return sets[x]

            found = []
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = top(rows[x][5]), top(rows[y][5])
                if p != q and linked(own(x)[1], own(y)[1], percent):
                    root[p] = q
                    found.append((own(x)[0], own(y)[0]))
            if found:
                yield _edges(found)

    order = ["bucket", "a", "b"]
    columns = cells.columns
    wanted = cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(wanting, "bucket long, a int, b int, k1 long")
    needed = write_through(cells.join(wanted, [*order, "k1"], "left_semi").select(columns), "compared_members")
    ready = needed.join(texts, "k1").select(*columns, "text").repartition(*order).sortWithinPartitions(*order)
    return ready.mapInArrow(confirmed, EDGES)


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 85,
) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id and kept.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their
    sets of distinct ``width``-word shingles; a shorter document is one shingle.
    ``component_id`` is the smallest id reachable by links, ``kept`` is true where
    that is the document's own.

    1. Documents of the same words are one class; a class has 96 SetSketch registers.
    2. Bands of registers put classes into buckets.  Every member is compared with
       two hubs of its bucket, so a large group of near copies takes linear work.
    3. Only buckets whose members aren't all connected by then go on, in cells of
       bounded size; pairs that are connected already are passed over.
    4. Pairs are dropped only if the joint likelihood of their registers excludes
       the threshold; every link is confirmed on the full sets of the texts.
    5. Components of the links; classes of very many copies get theirs by broadcast.

    No pair but that of a member and a hub is ever a row.  A null or empty text,
    and one of white space, has no shingles and is linked with nothing.  A row
    without an id is linked with nothing, has a null component and is kept.  Rows
    with equal ids are separate documents.  Without rows the result is empty.
    Other columns are ignored.
    """
    threshold = percent / 100
    signed = write_through(sketches(docs, id_col, text_col, width), "sketches")
    usable = signed.filter("k1 IS NOT NULL AND id IS NOT NULL")
    copies = write_through(usable.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "copies")
    first = copies.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "first")
    same = (F.col("id") == F.col("first")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    classes = write_through(usable.join(first, same).dropDuplicates(["k1", "k2"]).select(
        _class_key("k1", "k2").alias("key"), "k1", "first", "n", "registers", "bands"), "classes")

    spread = write_through(classes.select("k1", F.explode("bands").alias("bucket")), "spread")
    counts = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("k1").alias("low"), F.max("k1").alias("high"))
    counts = write_through(counts.filter("rows > 1"), "buckets")
    members = write_through(attach(spread, counts, ["bucket"], "rows", spread.count(), "inner"), "members")
    wanted = members.select("k1").distinct().join(classes.select("k1", "first"), "k1")
    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    texts = write_through(texts.join(wanted, F.col("id") == F.col("first")).select("k1", "text"), "texts")

    pairs = write_through(hub_pairs(members, classes, threshold), "likely_hub_pairs")
    by_hub = write_through(confirmed_hubs(pairs, texts, percent, width), "hub_links")
    labels = components(by_hub)
    known = labels.join(classes.select("key", "k1"), "key")
    least = known.groupBy("label").agg(F.min("k1").alias("least"))
    known = write_through(known.join(least, "label").select("k1", F.col("least").alias("label")), "connected")
    cells = write_through(mixed_cells(members, classes, known), "cells")
    rest = write_through(confirmed_cells(cells, texts, threshold, percent, width), "cell_links")
    labels = components(rest.unionByName(labels.select("key", F.col("label").alias("root")).filter("key <> root")))

    named_labels = labels.join(classes.select("key", "first"), "key")
    smallest = named_labels.groupBy("label").agg(F.min("first").alias("smallest"))
    of_class = labels.join(smallest, "label").select("key", "smallest")
    facts = copies.withColumn("key", _class_key("k1", "k2")).join(of_class, "key", "left").select(
        "k1", "k2", "copies", F.coalesce("smallest", "first").alias("component"))
    facts = write_through(facts, "class_components")
    joined = attach(signed.select("id", "n", "k1", "k2"), facts, ["k1", "k2"], "copies", signed.count())
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
