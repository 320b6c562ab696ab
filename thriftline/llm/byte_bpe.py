"""Byte-level BPE: boundaries by scans over codepoint classes, slices by cached pair merging, and decoding."""
from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .frames import named, packed, pieces, unpacked

# Codepoint classes.  C1 letters end a contraction on their own, C2 letters with the letter after them.
END, LETTER, C1, C2, NUMBER, SPACE, WHITE, QUOTE, OTHER = range(9)
# States: what stands to the left.  FREE: a token has just ended (start of a text, end of a contraction).
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, LONE_QUOTE, ONE_MORE = range(8)
#: Unicode's White_Space.
WHITE_SPACE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Ranges in which Unicode 16, the version of the rank files' library, added letters and numbers.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4),
    (0x11380, 0x113FF), (0x116D0, 0x116E3), (0x11BC0, 0x11BFF), (0x13460, 0x143FF), (0x16100, 0x1613F), (0x16D40, 0x16D7F),
    (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF),
)
#: Codepoints that are scanned at once, and entries that the cache of a task's process holds before it starts afresh.
CHUNK, BLOCK, CACHE = 1 << 19, 128, 400_000


def _step(state: int, kind: int) -> int:
    if kind == END or state == ONE_MORE:
        return FREE
    if kind in (LETTER, C1, C2):
        return {C1: FREE, C2: ONE_MORE}.get(kind, IN_LETTERS) if state == LONE_QUOTE else IN_LETTERS
    if kind == QUOTE:
        return IN_OTHERS if state in (IN_OTHERS, AFTER_SPACE, LONE_QUOTE) else LONE_QUOTE
    return {NUMBER: IN_NUMBERS, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, OTHER: IN_OTHERS}[kind]


def _begins(state: int, kind: int) -> bool:
    """Whether a token begins at a codepoint; white space before other text is decided by what follows."""
    if kind == END or state == ONE_MORE:
        return False
    if state == FREE:
        return True
    if kind in (LETTER, C1, C2):
        return not (state in (IN_LETTERS, AFTER_SPACE) or state == LONE_QUOTE and kind != LETTER)
    if kind == NUMBER:
        return state not in (IN_NUMBERS, AFTER_SPACE)
    if kind in (QUOTE, OTHER):
        return state not in (IN_OTHERS, LONE_QUOTE, AFTER_SPACE)
    return state not in (AFTER_SPACE, AFTER_WHITE)


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions that arise from the classes, numbered, and closed under composition.

    Returns: number of each class's function; table of compositions, flat, at
    ``256 * first + second``; table of results, flat, at ``8 * function +
    state``; and of whether a token begins, flat, at ``16 * state + class``.
    Composition is associative, so prefixes can be combined in any grouping.
    """
    own = [tuple(_step(s, k) for s in range(8)) for k in range(9)]
    functions = list(dict.fromkeys([tuple(range(8)), *own]))
    for first in functions:  # grows while it is read
        for second in own:
            both = tuple(second[s] for s in first)
            if both not in functions:
                functions.append(both)
    number = {f: i for i, f in enumerate(functions)}
    assert len(functions) <= 256
    compose = np.zeros(256 * 256, np.uint8)
    for f, i in number.items():
        for g, j in number.items():
            compose[256 * i + j] = number[tuple(g[s] for s in f)]
    begins = np.zeros(16 * 8, bool)
    for s in range(8):
        for k in range(9):
            begins[16 * s + k] = _begins(s, k)
    return np.array([number[f] for f in own], np.uint8), compose, np.array(functions, np.uint8).ravel(), begins


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every codepoint, from Unicode's properties; C1 and C2 letters still count as letters."""
    known = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    known += [c for a, b in UNICODE_16 for c in range(a, b + 1)]
    everything = "".join(map(chr, sorted(set(known))))
    table = np.full(0x110000, OTHER, np.uint8)
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        found = "".join(regex.findall(rf"\p{{{name}}}+", everything))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[WHITE_SPACE] = WHITE
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    return table


def scan(functions: np.ndarray) -> np.ndarray:
    """The number of the composition of ``functions[:i + 1]`` at every i.

    Blocks are scanned side by side, one position after another; then the
    blocks' totals are scanned in the same way and put in front.
    """
    _, compose, _, _ = automaton()
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[256 * int(out[i - 1]) + int(functions[i])]
        return out
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = functions
    across = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.uint16)
    for i in range(1, BLOCK):
        across[i] = compose[(across[i - 1] << 8) | across[i]]
    before = scan(across[-1].astype(np.uint8)).astype(np.uint16)
    across[:, 1:] = compose[(before[:-1] << 8) | across[:, 1:]]
    return across.T.reshape(-1)[:n].astype(np.uint8)


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where a token begins, and the ends of texts, in ascending order.

    ``points`` holds codepoints of texts one after another, each followed by one
    that stands at a position of ``ends``.
    """
    own, _, results, begins = automaton()
    kinds = classes()[points]
    kinds[ends] = END
    quotes = np.flatnonzero(kinds[:-2] == QUOTE) + 1  # where contractions may stand; the last codepoint is an end
    first, second = points[quotes], points[quotes + 1]
    lone = np.isin(first, [ord(c) for c in "stmd"])
    pair = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    letters = kinds[quotes] == LETTER
    kinds[quotes[lone & letters]] = C1
    kinds[quotes[pair & letters & (kinds[quotes + 1] == LETTER)]] = C2
    state = np.empty(len(points), np.uint8)
    state[:1] = FREE
    state[1:] = results[8 * scan(own[kinds]).astype(np.uint16)[:-1] + FREE]
    starts = begins[16 * state + kinds]
    white = (kinds == SPACE) | (kinds == WHITE)
    follows = np.append(~white[1:] & (kinds[1:] != END), False)
    return np.flatnonzero(starts | white & follows | (kinds == END))


def slices(texts: list[str]) -> Iterator[list[bytes]]:
    """Per text the slices that are merged separately, as UTF-8."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    marks = boundaries(points, ends)
    data = joined.encode()
    if len(data) == len(points):
        places = marks.tolist()
    else:
        size = (points > 0x7F).view(np.uint8) + (points > 0x7FF) + (points > 0xFFFF) + np.uint8(1)
        places = (np.cumsum(size, dtype=np.int64) - size)[marks].tolist()
    at = 0
    for end in np.searchsorted(marks, ends).tolist():
        yield [data[a:b] for a, b in zip(places[at:end], places[at + 1:end + 1])]
        at = end + 1


NONE = np.iinfo(np.int32).max


@lru_cache(maxsize=2)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every pair of tokens that together are a token: sorted keys, their ranks, and the ranks of single bytes."""
    ranks = vocabulary(path)
    pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
             if t[:i] in ranks and t[i:] in ranks]
    keys, values = np.array(sorted(pairs), np.int64).T.copy()
    return keys, values.astype(np.int32), np.array([ranks[bytes([b])] for b in range(256)], np.int32)


def _ranks(left: np.ndarray, right: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The rank of each pair, NONE where the two don't make a token."""
    wanted = left.astype(np.int64) << 32 | right
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], NONE)


def merge_many(words: list[bytes], path: str) -> list[bytes]:
    """``merge`` for words of one length at once: each round merges one pair in every word that still has one."""
    keys, values, single = pair_table(path)
    parts = single[np.frombuffer(b"".join(words), np.uint8)].reshape(len(words), -1)
    out: list[bytes] = [b""] * len(words)
    place = np.arange(len(words))
    pairs = _ranks(parts[:, :-1], parts[:, 1:], keys, values)
    while True:
        if pairs.shape[1]:
            at = pairs.argmin(1)
            best = pairs[np.arange(len(pairs)), at]
            over = best == NONE
        else:
            over = np.ones(len(parts), bool)
        for i, ids in zip(place[over].tolist(), parts[over].astype("<u4")):
            out[i] = ids.tobytes()
        if over.all():
            return out
        go = ~over
        place, parts, pairs, at, best = place[go], parts[go], pairs[go], at[go], best[go]
        row, n = np.arange(len(parts)), parts.shape[1]
        parts[row, at] = best
        after = np.arange(n - 1) > at[:, None]
        parts = np.where(after, parts[:, 1:], parts[:, :-1])
        pairs = np.where(after[:, :-1] if n > 2 else after[:, :0], pairs[:, 1:], pairs[:, :-1])
        inner = at < n - 2
        r = row[inner]
        pairs[r, at[inner]] = _ranks(parts[r, at[inner]], parts[r, at[inner] + 1], keys, values)
        r = row[at > 0]
        before = at[at > 0] - 1
        pairs[r, before] = _ranks(parts[r, before], parts[r, before + 1], keys, values)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of lowest rank, leftmost first, until none can be merged; a slice that is a token stays one.

    A heap of pairs over a linked list: n log n steps for a slice of n bytes.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts at i
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] < n and (rank := ranks.get(piece[i:end[right[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[right[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, upto = heapq.heappop(heap)
        j = right[i] if left[i] != -2 else n
        if j >= n or end[j] != upto:
            continue  # one of the two is gone or has grown
        end[i], right[i], left[j] = upto, right[j], -2
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = right[i]
    return out


class Encoder(dict):
    """Slice to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.ranks = path, vocabulary(path)

    def learn(self, parts: Iterable[bytes]) -> None:
        """Merge the slices that aren't known yet, those of equal length together."""
        if len(self) >= CACHE:
            self.clear()
        unknown: dict[int, list[bytes]] = {}
        for piece in set(parts).difference(self):
            if (rank := self.ranks.get(piece)) is not None:
                self[piece] = rank.to_bytes(4, "little")
            elif len(piece) <= 64:
                unknown.setdefault(len(piece), []).append(piece)
        for words in unknown.values():
            self.update(zip(words, merge_many(words, self.path)))

    def __missing__(self, piece: bytes) -> bytes:
        """A long slice is merged each time it is met."""
        return np.array(merge(piece, self.ranks), "<u4").tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each id, and their lengths."""
    ranks = vocabulary(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens, np.fromiter(map(len, tokens), np.int64, len(tokens))


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[bytes, bytes]]:
    """Per text the ids and the byte offsets where they end, both as little-endian unsigned 32-bit integers."""
    known = encoder(path)
    lengths = decoder(path)[1]
    cut = list(slices(texts))
    known.learn(chain.from_iterable(cut))
    for parts in cut:
        ids = b"".join(map(known.__getitem__, parts))
        yield ids, lengths[np.frombuffer(ids, "<u4")].cumsum().astype("<u4").tobytes()


def _portions(texts: Iterable[str], limit: int = CHUNK) -> Iterator[list[str]]:
    """Lists of texts with about ``limit`` codepoints; a longer text makes one of its own."""
    portion, size = [], 0
    for text in texts:
        if portion and size + len(text) > limit:
            yield portion
            portion, size = [], 0
        portion.append(text)
        size += len(text) + 1
    if portion:
        yield portion


def decode_ids(ids: bytes, offsets: bytes | None, path: str) -> bytes:
    """The bytes of the ids; the offsets at which their tokens end, if given, must agree with them."""
    tokens, lengths = decoder(path)
    numbers = np.frombuffer(ids, "<u4")
    if offsets is not None and not np.array_equal(lengths[numbers].cumsum(), np.frombuffer(offsets, "<u4")):
        raise ValueError("offsets don't belong to these ids")
    return b"".join(map(tokens.__getitem__, numbers.tolist()))


def encode(
    docs: DataFrame, vocabulary_path: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "offsets"),
) -> DataFrame:
    """``docs`` with n_tokens of the whole text, and the ``outputs`` asked for: ids, offsets, decoded.

    ``ids`` and ``offsets`` are binary: little-endian unsigned 32-bit integers.
    offsets[i] is the byte of the text's UTF-8 at which token i ends.
    ``decoded`` is what ``decode`` makes of the ids, in the same task, so that a
    round trip moves no ids between processes.  The file of ranks must exist at
    ``vocabulary_path`` on every executor.

    A null text is an empty one; an empty text has no tokens and empty binaries.
    Equal rows are encoded alike, in one pass without a shuffle.  Without rows
    the result is empty.  Input columns named like a result column are replaced.
    """
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, offsets = zip(*[x for portion in _portions(texts) for x in encode_texts(portion, vocabulary_path)])
            found = {"ids": ids, "offsets": offsets}
            if "decoded" in outputs:
                found["decoded"] = [decode_ids(*x, vocabulary_path) for x in zip(ids, offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 *[pa.array(found[name], pa.binary()) for name in outputs]], ["row", "n_tokens", *outputs])

    rows = packed(docs, text=named(text_col))
    schema = rows.select("row").schema.add("n_tokens", "long")
    for name in outputs:
        schema = schema.add(name, "binary")
    out = rows.mapInArrow(encoded, schema)
    return unpacked(out, docs.columns, n_tokens=F.col("n_tokens"), **{name: F.col(name) for name in outputs})


def decode(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """``encoded`` without ids and offsets but with ``decoded``, the bytes; the retained offsets must agree with the ids.

    Null ids are none.  Null offsets aren't checked.
    """
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            found = [decode_ids(ids or b"", ends, vocabulary_path)
                     for ids, ends in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["row", "decoded"])

    kept = [c for c in encoded.columns if c not in (ids_col, offsets_col)]
    rows = encoded.select(
        F.struct(*[named(c) for c in kept]).alias("row"), named(ids_col).alias("ids"), named(offsets_col).alias("offsets"))
    out = rows.mapInArrow(decoded, rows.select("row").schema.add("decoded", "binary"))
    return unpacked(out, kept, decoded=F.col("decoded"))
