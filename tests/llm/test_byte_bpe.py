import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from thriftline.llm import byte_bpe as bb

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, row int"
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bb.vocabulary(PATH), special_tokens={})
PARTS = st.lists(st.sampled_from([
    "'", "'s", "'re", "'v", "ve", "'ll", "l", " ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "s", "t", "m", "d", "word", "1", "٣", "²", "é",
    "é", "中", "!", "?!", "_", "👍"]) | st.characters(exclude_categories=["Cs"]), max_size=30)


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS.map("".join), min_size=1, max_size=4))
def test_equals_the_library(texts):
    for text, (ids, offsets) in zip(texts, bb.encode_texts(texts, PATH)):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == REFERENCE.encode_ordinary(text)
        ends = np.cumsum([len(REFERENCE.decode_single_token_bytes(i)) for i in ids]).tolist()
        assert np.frombuffer(offsets, "<u4").tolist() == ends


def test_every_codepoint():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}a1{chr(c)}1 {chr(c)}.{chr(c)}" for c in points]
    found = (ids for portion in bb._portions(texts) for ids, _ in bb.encode_texts(portion, PATH))
    wrong = [hex(c) for c, t, ids in zip(points, texts, found) if np.frombuffer(ids, "<u4").tolist() != REFERENCE.encode_ordinary(t)]
    assert wrong == []


@pytest.mark.parametrize("text", ["a" * 20_000, "ab'" * 9000, " " * 70_000, "\n " * 5000, "中" * 3000, "x" * 65, "é" * 33])
def test_long_runs(text):
    (ids, _), = bb.encode_texts([text], PATH)
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 100_000), st.integers(0, 2 ** 32))
def test_scan_equals_stepping(n, seed):
    own, _, results, _ = bb.automaton()
    kinds = np.random.default_rng(seed).integers(0, 9, n)
    state, states = bb.FREE, []
    for kind in kinds.tolist():
        state = bb._step(state, kind)
        states.append(state)
    assert results[8 * bb.scan(own[kinds]).astype(int) + bb.FREE].tolist() == states


def test_merging_one_by_one_and_together():
    words = [w for w in ("internationalisation", "aaaaaaaaaaaaaaaaaaaa", "zqxjkvbwmqpzxkjqhwez", " unbelievably strange")]
    words = [w.encode()[:20] for w in words]
    ranks = bb.vocabulary(PATH)
    for word, ids in zip(words, bb.merge_many(words, PATH)):
        assert np.frombuffer(ids, "<u4").tolist() == bb.merge(word, ranks) or word in ranks


def test_round_trip_of_a_table(spark):
    rows = [(1, "It's a test, they've said.", "c", 1), (2, None, "c", 1), (3, "", "c", 1), (4, "ü" * 100_000, "c", 1), (4, "ü" * 100_000, "c", 1)]
    encoded = bb.encode(spark.createDataFrame(rows, SCHEMA), PATH, outputs=("ids", "offsets", "decoded"))
    assert encoded.columns == ["doc_id", "text", "row", "n_tokens", "ids", "offsets", "decoded"]
    for r in encoded.collect():
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == REFERENCE.encode_ordinary(text) and r["n_tokens"] == len(r["ids"]) // 4
        assert hashlib.sha256(r["decoded"]).digest() == hashlib.sha256(text.encode()).digest()
    again = bb.decode(encoded.drop("decoded"), PATH)
    assert again.columns == ["doc_id", "text", "row", "n_tokens", "decoded"]
    assert all(r["decoded"].decode() == (r["text"] or "") for r in again.collect())
    assert bb.encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_wrong_offsets_are_noticed():
    (ids, offsets), = bb.encode_texts(["some text"], PATH)
    with pytest.raises(ValueError):
        bb.decode_ids(ids, offsets[4:], PATH)
