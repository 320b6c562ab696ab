from collections import Counter

from hypothesis import given, strategies as st

from thriftline.llm import rule_cascade as rc

SCHEMA = "doc_id long, text string, kept string, row int"
CLEAN = " ".join(f"Word{i} follows another" for i in range(60))


def brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


@given(st.text(alphabet="ab #\n\t\x1c\x85\xa0é", max_size=60))
def test_measures(text):
    t = rc.Text(text)
    assert tuple(getattr(t, m) for m in rc.MEASURES) == brute(text)


TEXTS = [CLEAN, CLEAN, None, "", " \n\t", "too short", "same words here " * 100, CLEAN.upper(), CLEAN.replace(" ", " ### "),
         "\n".join(["an equal line of many words"] * 2 + [CLEAN]), "x" * 2_000_000, CLEAN.replace("Word", "An" + "x" * 90)]


def test_cascade_equals_all_rules(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    out = rc.rule_cascade(docs, measures=rc.MEASURES)
    assert out.columns == ["doc_id", "text", "row", "kept", "rejected_by", *rc.MEASURES]
    for r in out.collect():
        text = rc.Text(r["text"])
        assert r["kept"] == (not any(rule.rejects(text) for rule in rc.RULES)) == (r["rejected_by"] is None)
        assert tuple(r[m] for m in rc.MEASURES) == brute(r["text"])
    kept = {r["doc_id"] for r in out.filter("kept").collect()}
    assert kept == {0, 1, 9}


def test_order_by_rejections_per_second(spark):
    def slow(text):
        __import__("time").sleep(0.002)
        return True

    rules = (rc.Rule("slow", slow), rc.Rule("never", lambda t: False), rc.Rule("cheap", lambda t: True))
    docs = spark.createDataFrame([(i, "a") for i in range(40)], "doc_id long, text string")
    estimates = rc.estimate(docs, rules)
    assert {r["rule"]: r["rejected"] for r in estimates.collect()} == {"slow": 1.0, "never": 0.0, "cheap": 1.0}
    assert [r.name for r in rc.ordered(rules, estimates)] == ["cheap", "slow", "never"]
    assert {r["rejected_by"] for r in rc.rule_cascade(docs, rules).collect()} == {"cheap"}


def test_empty_table(spark):
    assert rc.rule_cascade(spark.createDataFrame([], SCHEMA)).collect() == []
