"""Best-fit packing by a configuration linear program over the histogram of lengths."""
from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, Window

from ..plans.workspace import write_through
from .byte_words import array_of
from .frames import named, pieces

#: Entries of a generation of the cache of a task's process; there are two.
CACHE = 400_000
#: Buckets over which the pieces of one length are ranked, at least; a bucket for every so many pieces.
BUCKETS, BUCKET_ROWS = 256, 100_000
#: How much more a token of a long item is worth: short items are kept for the gaps of later rounds.
CONVEX = 0.1
#: Largest lengths for which one dynamic program prices a pattern.
PATTERNS = 32
#: Lengths in a program of the covering, lengths whose patterns it gives, and the power of the weights in its prices.
ACTIVE, HEADS, MILD = 128, 16, 0.0025

#: Bytes that are encoded at once.
PART = 2 << 20
GAP = re.compile(rb"[ \t-\r]")
# Classes of bytes: white space, letters, digits, other characters that show, and all that keeps its chunk whole.
LETTER, DIGIT, SHOWN, WHOLE = range(1, 5)
KINDS = np.array([
    0 if b == 0x20 or 9 <= b <= 13 else WHOLE if b < 0x20 or b >= 0x7F or b == 0x27 else LETTER if chr(b).isalpha()
    else DIGIT if chr(b).isdigit() else SHOWN for b in range(256)], np.uint8)

# The words of the vocabulary's own pre-tokenizer, and the chunks for which Python's tables surely agree with it.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[!-~¡-¬®-ɏ]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it shows, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in shown else next(spare)) for b in range(256)}


class Chunks(dict):
    """A stretch without white space to its ids, as little-endian unsigned 32-bit integers.

    When it is full its entries become the old generation, from which those that
    are met again come back; so frequent stretches stay known.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if (known := self.old.get(chunk)) is not None:
            self[chunk] = known
            return known
        if chunk.isascii() and chunk.isalpha():  # most chunks that are new: a word
            ids = self._ids(chunk)
        elif PLAIN.fullmatch(chunk):
            words = WORDS.findall(chunk)
            ids = self._word(chunk) if words == [chunk] else b"".join([self[w] for w in words])
        else:
            ids = b"".join([self.packed[i] for i in self.tokenizer.encode(chunk, add_special_tokens=False).ids])
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        return self._ids(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))

    def _ids(self, spelled: str) -> bytes:
        packed = self.packed
        return b"".join([packed[token.id] for token in self.tokenize(spelled)])


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def normal(text: str) -> bytes:
    """The text as the vocabulary normalises it, white space apart: NFC, lower-cased codepoint by codepoint."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}")
    return text.lower().encode()


def units(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """What can be encoded on its own, and where in ``raw`` it begins.

    A chunk between ASCII white space is a unit if it holds an apostrophe, a
    control character or anything but ASCII.  Any other chunk falls into runs of
    letters, single digits and runs of other characters.
    """
    data = np.frombuffer(raw, np.uint8)
    kind = KINDS[data]
    inside = kind > 0
    before = np.concatenate([[0], kind[:-1]]) if len(kind) else kind
    chunks = np.flatnonzero(inside & (before == 0))
    if not len(chunks):
        return array_of(chunks, inside, data), chunks
    whole = np.repeat(np.maximum.reduceat(kind, chunks) == WHOLE, np.diff(np.append(chunks, len(data))))
    begins = (kind != before) | (kind == DIGIT)
    begins[chunks[0]:] &= ~whole
    begins &= inside
    begins[chunks] = True
    starts = np.flatnonzero(begins)
    return array_of(starts, inside, data), starts


def _ids_of(raw: bytes, known: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all units of ``raw``, the number of ids of each unit, and where the units begin."""
    found, starts = units(raw)
    distinct = found.dictionary_encode()
    packed = list(map(known.__getitem__, distinct.dictionary.cast(pa.large_string()).to_pylist()))
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    flat = np.frombuffer(b"".join(packed), "<u4")
    which = distinct.indices.to_numpy()
    counts = sizes[which]
    shift = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(counts) - counts)
    return flat[np.repeat(shift, counts) + np.arange(counts.sum())], counts, starts


def encode_texts(texts: list[str | None], path: str, last: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts by the word-level vocabulary, each followed by ``last``, and how many each text has.

    About PART bytes are encoded at a time; a longer text is cut at white space.
    Only distinct units of these bytes are looked up.
    """
    known, out, sizes, held = chunks(path), [], [], []

    def settle() -> None:
        ids, counts, starts = _ids_of(b"\n".join(held), known)
        ends = np.cumsum([len(raw) + 1 for raw in held])
        total = np.concatenate([[0], np.cumsum(counts)])
        at = total[np.searchsorted(starts, ends)]
        out.append(np.insert(ids, at, last))
        sizes.extend((np.diff(at, prepend=0) + 1).tolist())
        held.clear()

    size = 0
    for text in texts:
        raw = normal(text or "")
        if held and size + len(raw) > PART:
            settle()
            size = 0
        if len(raw) <= PART:
            held.append(raw)
            size += len(raw) + 1
            continue
        at, parts = 0, []
        while at < len(raw):
            gap = GAP.search(raw, at + PART)
            end = gap.start() if gap else len(raw)
            parts.append(_ids_of(raw[at:end], known)[0])
            at = end
        out += [*parts, np.array([last], "<u4")]
        sizes.append(sum(map(len, parts)) + 1)
    if held:
        settle()
    return np.concatenate(out) if out else np.zeros(0, "<u4"), np.array(sizes, np.int64)


def encode(text: str, path: str, last: int = 0) -> bytes:
    """Ids of one text, then ``last``."""
    return encode_texts([text], path, last)[0].astype("<u4").tobytes()


def token_pieces(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    with_ids: bool = True,
) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            ids, sizes = encode_texts(batch.column(1).to_pylist(), vocabulary_path)
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(capacity, sizes[row] - piece * capacity)
            ends = 4 * np.concatenate([[0], np.cumsum(length)])
            data = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(memoryview(data)[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            arrays = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity),
                      pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                own = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                arrays.append(own.cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names[:len(arrays)])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    texts = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return texts.mapInArrow(cut, schema)


# --- the program over the histogram: on the driver, in size bounded by the capacity -------------------------------

@dataclass
class Plan:
    """Patterns in the order of their sequences: items per length, and how many sequences follow it."""
    capacity: int
    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)
    bound: float = 0.0  # no plan has fewer sequences

    @property
    def n_sequences(self) -> int:
        return sum(times for _, times in self.patterns)

    def runs(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, first sequence, items per sequence, offset of the first) in order of length and rank."""
        ranks: dict[int, int] = {}
        out, sequence = [], 0
        for pattern, times in self.patterns:
            offset = 0
            for length, items in sorted(pattern.items(), reverse=True):
                out.append((length, ranks.get(length, 0), sequence, items, offset))
                ranks[length] = ranks.get(length, 0) + items * times
                offset += length * items
            sequence += times
        return sorted(out)


def knapsack(lengths: list[int], prices: list[float], bounds: list[int], capacity: int):
    """Dynamic program over bounded items: a function that gives the best pattern within any room, and the best value."""
    best = np.zeros(capacity + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for length, price, bound in zip(lengths, prices, bounds):
        left, size = min(bound, capacity // length), 1
        while left > 0:  # 1, 2, 4, ... and the rest: every number up to the bound
            items = min(size, left)
            weight = items * length
            with_it = best[:capacity + 1 - weight] + items * price
            better = with_it > best[weight:] + 1e-9
            np.copyto(best[weight:], with_it, where=better)
            steps.append((length, items, better))
            left, size = left - items, 2 * size

    def pattern(room: int) -> dict[int, int]:
        found: dict[int, int] = {}
        for length, items, better in reversed(steps):
            weight = length * items
            if room >= weight and better[room - weight]:
                found[length] = found.get(length, 0) + items
                room -= weight
        return found

    return pattern, float(best[capacity])


@dataclass
class Covering:
    """A fractional solution of the program: sequences per pattern, their sum, and a lower bound on any solution's."""
    used: dict[tuple, float]
    value: float
    bound: float


def covering(demand: dict[int, int], capacity: int, passes: float = 3.0, rate: float = 8.0, seed: int = 0) -> Covering:
    """Cover the fixed ``demand`` by fractions of patterns: multiplicative weights, averaged.

    A length's weight is exp(-rate * c), c being the share of its demand that is
    covered so far.  Each round draws ACTIVE lengths by weight, prices them and
    solves one knapsack program; for each of the HEADS least covered lengths the
    program's best pattern around it is added, by half of what its scarcest
    length needs, so no length's weight drops by more than a bounded factor.
    When the least covered length has its demand ``passes`` times, the sum of
    all that was added is divided by that: a covering of the demand itself.

    Prices are sizes times a much milder power of the weights, for the prices of
    this program's solutions are close to sizes.  Those at the end, divided by the
    best pattern's over all lengths, are a solution of the dual program; it or the
    sum of sizes, whichever is more, bounds the number of sequences from below.
    """
    rng = np.random.default_rng(seed)
    lengths = np.array(sorted(demand, reverse=True))
    wanted = np.array([demand[n] for n in lengths.tolist()], np.float64)
    bounds = np.ceil(wanted).astype(np.int64)
    place = {n: i for i, n in enumerate(lengths.tolist())}
    covered, used = np.zeros(len(lengths)), {}
    while (share := covered / wanted).min() < passes - 1e-9:
        weight = -rate * (share - share.min())  # logarithms
        active = np.sort(np.argsort(-(weight + rng.gumbel(size=len(weight))), kind="stable")[:ACTIVE])
        price = lengths[active] * np.exp(MILD * weight[active])
        fill, _ = knapsack(lengths[active].tolist(), price.tolist(), bounds[active].tolist(), capacity)
        behind = np.lexsort((-lengths, share))[:HEADS]
        for i in behind[share[behind] <= share.min() + 0.25].tolist():
            head = int(lengths[i])
            pattern = fill(capacity - head)
            pattern[head] = pattern.get(head, 0) + 1
            own = [place[n] for n in pattern]
            items = np.array(list(pattern.values()), np.float64)
            amount = float((wanted[own] / items).min()) / 2
            key = tuple(sorted(pattern.items()))
            used[key] = used.get(key, 0.0) + amount
            covered[own] += amount * items
    used = {pattern: amount / share.min() for pattern, amount in used.items()}
    price = lengths * np.exp(-MILD * rate * (share - share.min()))
    _, best = knapsack(lengths.tolist(), price.tolist(), bounds.tolist(), capacity)
    bound = max(float(lengths @ wanted) / capacity, float(price @ wanted) / best)
    return Covering(used, sum(used.values()), bound)


def leftover(demand: dict[int, int], capacity: int, rate: float = 0.05) -> dict[tuple, float]:
    """Patterns for the few items per length that rounding leaves, and how many sequences (a fraction) follow each.

    Demand shrinks as patterns take it: the price of a length is its size times a
    weight that grows while more of the length is left than of the others.  One program prices a pattern for each
    of the largest lengths left; a pattern is used until its scarcest length is
    gone.  A length with less than one item left is done, so there are at most
    as many patterns as lengths.
    """
    left = {n: float(v) for n, v in demand.items() if v >= 1}
    total = dict(left)
    weight = dict.fromkeys(left, 1.0)
    used: dict[tuple, float] = {}
    while left:
        heads = sorted(left, reverse=True)[:PATTERNS]
        priced = [n for n in sorted(left, reverse=True) if n <= capacity - heads[-1]]
        fill, _ = knapsack(priced, [n * (1 + CONVEX * n / capacity) * weight[n] for n in priced], [int(left[n]) for n in priced], capacity - heads[-1])
        for head in heads:
            if left[head] < 1:
                continue
            pattern = fill(capacity - head)
            pattern[head] = pattern.get(head, 0) + 1
            times = min(left[n] / items for n, items in pattern.items())
            if times <= 0:  # an earlier head has taken what it needs: priced anew in the next round
                continue
            key = tuple(sorted(pattern.items()))
            used[key] = used.get(key, 0.0) + times
            for n, items in pattern.items():
                left[n] -= times * items
        behind = {n: left[n] / total[n] for n in left}
        mean = sum(behind.values()) / len(behind)
        weight = {n: weight[n] * float(np.exp(rate * (behind[n] - mean))) for n in left}
        left = {n: v for n, v in left.items() if v >= 1}
    return used


def best_fit(items: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing of single items: each goes where it leaves the least room."""
    rooms: dict[int, list[dict[int, int]]] = {}
    open_rooms = 0  # bit r: some sequence has room r
    for length in sorted(items, reverse=True):
        for _ in range(items[length]):
            fitting = open_rooms >> length
            if fitting:
                room = (fitting & -fitting).bit_length() - 1 + length
                own = rooms[room].pop()
                if not rooms[room]:
                    open_rooms ^= 1 << room
            else:
                room, own = capacity, {}
            own[length] = own.get(length, 0) + 1
            rooms.setdefault(room - length, []).append(own)
            open_rooms |= 1 << (room - length)
    grouped: dict[tuple, int] = {}
    for own in (x for kept in rooms.values() for x in kept):
        key = tuple(sorted(own.items()))
        grouped[key] = grouped.get(key, 0) + 1
    return [(dict(k), v) for k, v in sorted(grouped.items())]


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """Round the program's solution: whole sequences of its patterns, then patterns for what is left, then best fit.

    Of each full pattern the whole part is taken, the most used first, as long as
    the items are there.  What then is left has patterns of its own, which are
    rounded down in turn, until less than one sequence per pattern is left; the
    number of patterns is bounded by that of lengths, not of items.
    """
    plan = Plan(capacity)
    left = {n: v for n, v in histogram.items() if v > 0}
    if full := left.pop(capacity, 0):
        plan.patterns.append(({capacity: 1}, full))
    if left:
        solution = covering(left, capacity)
        plan.bound = full + solution.bound
        for pattern, amount in sorted(solution.used.items(), key=lambda x: (-x[1], x[0])):
            if sum(n * items for n, items in pattern) == capacity:
                times = min([int(amount), *[left[n] // items for n, items in pattern]])
                if times:
                    plan.patterns.append((dict(pattern), times))
                    for n, items in pattern:
                        left[n] -= items * times
        left = {n: v for n, v in left.items() if v > 0}
    while left:
        whole = [(dict(p), int(times)) for p, times in leftover(left, capacity).items() if times >= 1]
        for pattern, times in whole:
            for n, items in pattern.items():
                left[n] -= items * times
        plan.patterns += whole
        left = {n: v for n, v in left.items() if v > 0}
        if not whole or sum(left.values()) <= 4 * capacity:
            break
    plan.patterns += best_fit(left, capacity)
    return plan


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """``found`` (a table of pieces with ``length``, read more than once) with sequence_id and offset.

    Only the histogram of lengths, at most ``capacity`` numbers, comes to the
    driver.  Each piece gets a rank among those of its length: pieces are dealt
    into hashed buckets, ranked within a bucket, and moved on by what the buckets
    before hold, so a length that very many pieces have is no hot group.  The
    rank decides which pattern, sequence and place is the piece's own.
    """
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = solve(histogram, capacity).runs()
    lengths, ranks, sequences, items, offsets = (np.array(c, np.int64) for c in zip(*runs)) if runs else [np.zeros(0, np.int64)] * 5
    starts = (lengths << 44) + ranks
    buckets = max(BUCKETS, sum(histogram.values()) // BUCKET_ROWS)

    keyed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1).join(counts, ["length", "bucket"])
    columns = found.columns
    ranked = ranked.select(*columns, (F.col("before") + F.col("rank")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_length, at_rank = columns.index("length"), len(columns)
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            run = np.searchsorted(starts, (length << 44) + rank, side="right") - 1
            sequence, slot = np.divmod(rank - ranks[run], items[run])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequences[run] + sequence), pa.array(offsets[run] + slot * length)],
                [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, found.schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    with_ids: bool = True,
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, ids (binary, if
    asked for), sequence_id, offset.  Only documents longer than ``capacity`` are
    cut.  Sequences have no gaps, and no order.

    A null text is an empty one, which is the closing id alone.  Rows with equal
    or null ids are packed each on its own.  Texts of any length are encoded
    whole.  Without rows the result is empty.  Other columns are ignored.
    """
    found = write_through(
        token_pieces(docs, vocabulary_path, id_col, text_col, capacity, with_ids), "token_pieces")
    return pack(found, capacity)
