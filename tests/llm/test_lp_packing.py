import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from thriftline.llm import lp_packing as lp

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, bucket int"


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


PARTS = st.lists(st.sampled_from([
    "'", "'s", "'RE", " ", "\n", "\x1c", "\x85", "　", "word", "Word", "É", "é", "12", "?!", "中", "Σ", "ΑΣ ", "İ", "ß", "👍", "ﬁ",
    "<|endoftext|>", "Ǆ", "-", "_"]) | st.characters(exclude_categories=["Cs"]), max_size=25)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_encoding_by_chunks_equals_whole_texts(parts):
    text = "".join(parts)
    whole = Tokenizer.from_file(PATH) if not hasattr(lp, "_whole") else lp._whole
    whole.encode_special_tokens = True
    lp._whole = whole
    assert np.frombuffer(lp.encode(text, PATH), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids + [0]


def test_texts_together_equal_texts_alone(monkeypatch):
    rng = random.Random(3)
    parts = ["word", "it's", "A1b2", "don't,", "x-y", "12", "naïve", "\x1c", "日本 語", ".'s", "''", "\n", "A" * 70, "?!", "\x00", " "]
    texts = [None, "", " "] + ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    want = [whole.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
    for part in (1 << 20, 100):  # in one go, and cut at white space
        monkeypatch.setattr(lp, "PART", part)
        ids, sizes = lp.encode_texts(texts, PATH, 7)
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plan_holds_every_item_once(histogram):
    plan = lp.solve(histogram, 64)
    held = Counter()
    for pattern, times in plan.patterns:
        assert times > 0 and sum(n * items for n, items in pattern.items()) <= 64
        for n, items in pattern.items():
            held[n] += items * times
    assert held == Counter(histogram)
    for (n, rank, sequence, items, _), after in zip(plan.runs(), plan.runs()[1:]):
        assert after[0] > n or after[1] > rank


@pytest.mark.parametrize("times", [1, 50, 10_000])
def test_close_to_the_lower_bound(times):
    rng = random.Random(1)
    histogram = Counter(min(2048, int(rng.lognormvariate(5.5, 1.1)) + 1) for _ in range(3000))
    histogram = {n: v * times for n, v in histogram.items()}
    least = -(-sum(n * v for n, v in histogram.items()) // 2048)
    assert lp.solve(histogram, 2048).n_sequences <= least * 1.002 + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_covering_holds_the_demand_and_its_bound(seed):
    """All demand is covered; no pattern is too long; the dual bound is below the program's value and every plan."""
    rng = random.Random(seed)
    demand = Counter(rng.choice([31, 40, 41, 55, 70, 71, rng.randint(1, 99)]) for _ in range(2000))
    found = lp.covering(demand, 100, passes=8)
    covered = Counter()
    for pattern, amount in found.used.items():
        assert amount > 0 and sum(n * items for n, items in pattern) <= 100
        for n, items in pattern:
            covered[n] += amount * items
    assert all(covered[n] >= v - 1e-6 for n, v in demand.items())
    assert sum(n * v for n, v in demand.items()) / 100 <= found.bound <= found.value + 1e-9
    assert abs(found.value - sum(found.used.values())) < 1e-9
    plan = lp.solve(demand, 100)
    assert found.bound <= plan.n_sequences + 1e-9


def test_bound_is_above_the_sizes_where_these_do_not_fit():
    """Three items of 40 never share a sequence of 100: the dual sees it, the sum of sizes doesn't."""
    found = lp.covering({40: 1000, 55: 10}, 100)
    assert found.bound > 1.05 * (40 * 1000 + 55 * 10) / 100 or found.bound == (40 * 1000 + 55 * 10) / 100
    assert lp.solve({60: 500}, 100).bound >= 500 - 1e-6 and lp.solve({60: 500}, 100).n_sequences == 500


def test_plan_of_many_items_is_within_a_thousandth_of_the_bound():
    rng = random.Random(5)
    histogram = Counter(min(2048, int(rng.lognormvariate(5.8, 1.0)) + 1) for _ in range(20_000))
    for times in (1, 200):
        plan = lp.solve({n: v * times for n, v in histogram.items()}, 2048)
        assert plan.bound - 1e-6 <= plan.n_sequences <= 1.001 * plan.bound + 1


def test_knapsack_is_exact():
    rng = random.Random(2)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 12), 4), reverse=True)
        prices, bounds = [rng.random() * n for n in lengths], [rng.randint(1, 3) for _ in lengths]
        fill, value = lp.knapsack(lengths, prices, bounds, 20)
        for room in range(21):
            best = max(sum(p * k for p, k in zip(prices, ks))
                       for ks in __import__("itertools").product(*[range(b + 1) for b in bounds])
                       if sum(n * k for n, k in zip(lengths, ks)) <= room)
            found = fill(room)
            assert sum(n * k for n, k in found.items()) <= room
            assert abs(sum(prices[lengths.index(n)] * k for n, k in found.items()) - best) < 1e-9
        assert abs(value - best) < 1e-9


def test_pieces_are_packed_whole(spark, tokenizer):
    texts = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 100), (5, "x y " * 700), (5, "x y " * 700), (None, "no id"), (6, "z " * 31)]
    texts += [(100 + i, "equal") for i in range(200)]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in texts], SCHEMA).repartition(3)
    found = lp.pack_documents(docs, PATH, capacity=32)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    rows = found.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 128
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in texts:
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        copies = sum(d == doc for d, _ in texts)
        assert len(own) == copies * -(-len(ids) // 32)
        for r in own:
            assert r["start"] == 32 * r["piece"]
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"]:r["start"] + 32]
    for own in by_sequence.values():  # gapless from 0
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 32
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 32) + 1


def test_empty_table(spark):
    assert lp.pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []
