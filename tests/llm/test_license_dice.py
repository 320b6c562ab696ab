import re
import textwrap

from hypothesis import given, settings, strategies as st

from thriftline.llm import license_dice as ld

SCHEMA = "doc_id long, text string, license string, found string"


def brute(text):
    best = []
    units = {text or "", *(text or "").split("\n")}
    for unit in units:
        words = re.findall(r"[0-9]+(?:\.[0-9]+)+|[^\W_]+", unit.lower())
        own = {f"{a} {b}" for a, b in zip(words, words[1:])}
        scores = []
        for i, (name, template) in enumerate(ld.TEMPLATES):
            theirs = set(ld.bigrams(template))
            if own:
                scores.append((2 * len(own & theirs) / (len(own) + len(theirs)), -i, name))
        if scores and max(scores)[0] >= ld.THRESHOLD:
            best.append(max(scores))
    return (max(best)[2], round(max(best)[0], 9), sorted({b[2] for b in best})) if best else (None, None, [])


TEXTS = [
    None, "", "\n\n", "one", "Licensed under the Apache License, Version 2.0.", "LICENSED under  the mit licence", "no licence here at all",
    "Prose before.\n  Released under the MIT License!\nProse after.\nLicensed under CC BY-NC 4.0.",
    dict(ld.TEMPLATES)["ISC"].replace("SOFTWARE", "PROGRAM", 2), ld.TEMPLATES[3][1].replace(". ", ".\n"), "word " * 50_000,
    "Released under" + " " * 200_000 + "the" + "! . " * 100_000 + "MIT License.", "..." * 100_000,
    ld.TEMPLATES[3][1] + " " + "and much more text follows here " * 30, ld.TEMPLATES[5][1].lower(),
]


def test_equals_brute_force(spark):
    rows = [(i, t, "clash", "f") for i, t in enumerate([*TEXTS, TEXTS[4]])]
    out = ld.license_scan(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "found", "license", "license_score", "licenses"]
    for r in out.collect():
        want = brute(r["text"])
        score = r["license_score"] and round(r["license_score"], 9)
        assert (r["license"], score, r["licenses"]) == want, r["doc_id"]
    assert {brute(t)[0] for t in TEXTS} >= {None, "MIT", "Apache-2.0", "ISC"}


def test_empty_table(spark):
    assert ld.license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=50)
@given(st.integers(1, 400), st.integers(1, 400), st.floats(0.5, 1.0))
def test_bounds_lose_nothing(own, theirs, threshold):
    lo, hi = ld.bounds(theirs, threshold)
    if 2 * min(own, theirs) / (own + theirs) >= threshold + 1e-6:
        assert lo <= own <= hi


def brute_windows(text):
    """All runs of words by template and first word, without those that overlap a better one, beside lines and whole text."""
    words = re.findall(r"[0-9]+(?:\.[0-9]+)+|[^\W_]+", text.lower())
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    found = []
    for i, (name, template) in enumerate(ld.TEMPLATES):
        theirs = set(ld.bigrams(template))
        for a in range(len(grams)):
            own, best = set(), (0, 0)
            for b in range(a, min(len(grams), a + ld.longest(template, ld.THRESHOLD))):
                own.add(grams[b])
                best = max(best, (2 * len(own & theirs) / (len(own) + len(theirs)), -b))
            if best[0] >= ld.THRESHOLD:
                found.append((best[0], -i, name, a, -best[1]))
    kept = [m[:3] for m in found if not any(o[:2] > m[:2] and o[3] <= m[4] and o[4] >= m[3] for o in found)]
    name, score, names = brute(text)
    best = max(kept, default=None)
    if best and (score is None or round(best[0], 9) > score):
        name, score = best[2], round(best[0], 9)
    return name, score, sorted({*names, *(m[2] for m in kept)})


def test_windows_equal_brute_force(spark):
    def wrapped(text):
        return textwrap.fill(text, 80, initial_indent="# ", subsequent_indent="# ")

    prose = " ".join(f"Of the {i} words in the text to the end this work {i} is long." for i in range(40))
    found = {
        "MIT": ["Copyright (c) 2024 X. Released under the MIT License.", f"{wrapped(ld.TEMPLATES[3][1])}\n\n{prose}\n{prose}",
                prose + ld.TEMPLATES[3][1].replace("DEALINGS", "USES") + prose],
        "ISC": [f"{prose}\n{wrapped(dict(ld.TEMPLATES)['ISC'])}\n{prose}"], "GPL-3.0": [f"{wrapped(ld.TEMPLATES[7][1])}\n{prose}"],
    }
    both = f"{prose} Licensed under CC BY 4.0. {prose}\n{wrapped(ld.TEMPLATES[9][1])}\n{prose}"
    texts = [*(t for ts in found.values() for t in ts), both, prose, prose + " Released under the old MIT License.", "Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    for r in ld.license_scan(docs, windows=True).collect():
        score = r["license_score"] and round(r["license_score"], 9)
        assert (r["license"], score, r["licenses"]) == brute_windows(r["text"]), r["doc_id"]
    assert all(brute_windows(t)[0] == name and name not in brute(t)[2] for name, ts in found.items() for t in ts)
    assert brute_windows(both)[2] == ["CC-BY-4.0", "GPL-2.0"] and brute_windows(prose)[2] == []


def test_telling_words_are_in_every_match():
    words = ld.telling(ld.TEMPLATES, ld.THRESHOLD)
    for _, template in ld.TEMPLATES:
        own = ld.bigrams(template)
        assert sum(not any(w in x for w in words) for x in own) < ld.bounds(len(own), ld.THRESHOLD)[0]
