"""Quality rules as a short-circuit cascade: the rules that reject most per unit of cost run first."""
from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .frames import SPACES, named, packed, unpacked

SYMBOLS = "#*$%&|<>"
#: At most so many rows, of at most so many code points each, are looked at to order the rules.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 50_000


class Text:
    """One text; each measure is computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # Splitting bytes knows just the white space of the contract.
        return self.text.encode().split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """How many words stand in a window of three words that the text holds more than once."""
        windows = list(zip(self.words, self.words[1:], self.words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen, covered, upto = Counter(windows), 0, 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                covered += at + 3 - max(at, upto)
                upto = at + 3
        return covered

    @cached_property
    def n_upper(self) -> int:
        return sum(map(str.isupper, self.text))


@dataclass(frozen=True)
class Rule:
    """A named test that is true for texts to reject."""
    name: str
    rejects: Callable[[Text], bool]


# The base rules of the contract, then bounds as are usual for web text.
BASE_RULES = (
    Rule("too_short", lambda t: t.n_words < 50),
    Rule("repetitive", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
MORE_RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 3 * t.n_words <= t.word_chars <= 10 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("capitals", lambda t: 2 * t.n_upper > t.word_chars),
)
RULES = BASE_RULES + MORE_RULES
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per rule its mean seconds and the share of rows it rejects, from at most ``rows`` rows: rule, seconds, rejected.

    Every rule is timed on texts of its own, so what an earlier rule has
    computed makes none cheaper.  The sample is the first rows with a text of at
    most SAMPLE_CHARS code points (or none): Spark reads only as many partitions
    as it takes to find them, and what comes to the driver is bounded.
    """
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                n += 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    hits[k] += rule.rejects(Text(value))
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({
            "rule": [r.name for r in rules], "spent": spent, "hits": hits, "n": [n] * len(rules)})

    short = docs.select(named(text_col).alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    sample = docs.sparkSession.createDataFrame([(r["text"],) for r in short.take(rows)], "text string")
    parts = sample.mapInArrow(measured, "rule string, spent double, hits long, n long")
    total = F.greatest(F.sum("n"), F.lit(1))
    return parts.groupBy("rule").agg(
        (F.sum("spent") / total).alias("seconds"), (F.sum("hits") / total).alias("rejected"))


def ordered(rules: tuple[Rule, ...], estimates: DataFrame) -> tuple[Rule, ...]:
    """Most rejected rows per second first; ties keep the given order."""
    rate = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in estimates.collect()}
    return tuple(sorted(rules, key=lambda r: -rate.get(r.name, 0.0)))


def rule_cascade(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
    measures: tuple[str, ...] = (),
) -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by``, the first rule of the cascade that rejects (null if kept).

    Cost and selectivity of each rule are estimated on a sample of at most
    ``sample_rows`` rows; then the rules run in the order of rejections per
    second, and a text that one rejects meets no later rule.  The order changes
    the cost and ``rejected_by`` but never ``kept``.  ``measures`` names
    properties of Text that are returned for every row, rejected or not.

    A null text is an empty one, which has no words and is too short.  Repeated
    rows get equal verdicts.  Without rows the result is empty and the rules keep
    their order.  Input columns named like a result column are replaced.
    """
    cascade = ordered(rules, estimate(docs, rules, text_col, sample_rows))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found: list[list] = [[] for _ in range(1 + len(measures))]
            for value in texts:
                text = Text(value.as_py())
                found[0].append(next((r.name for r in cascade if r.rejects(text)), None))
                for at, name in enumerate(measures, 1):
                    found[at].append(getattr(text, name))
            names = pa.array(found[0], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.is_null(names), names, *[pa.array(v, pa.int64()) for v in found[1:]]],
                ["row", "kept", "rejected_by", *measures])

    rows = packed(docs, text=named(text_col))
    schema = rows.select("row").schema.add("kept", "boolean").add("rejected_by", "string")
    for name in measures:
        schema = schema.add(name, "long")
    out = rows.mapInArrow(judged, schema)
    return unpacked(out, docs.columns, kept=F.col("kept"), rejected_by=F.col("rejected_by"),
                    **{m: F.col(m) for m in measures})
