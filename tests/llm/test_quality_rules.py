import math
import random
import re

from ladderlens.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(WORD.search(line)) and line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_measures_equal_brute_force():
    r = random.Random(8)
    for _ in range(500):
        text = "".join(r.choice(["a", "b ", " ", "\n", "é#", "\x85", "\t", "x y z ", "$", "a b\n", " "]) for _ in range(r.randint(0, 40)))
        assert q.measure(text) == slow(text)
    assert q.measure(None) == (0, 0, 0, 0, 0)


def test_bound_is_the_exact_one():
    assert math.isclose(q.upper_bound(0, 100, 0.05), 1 - 0.05**0.01, rel_tol=1e-9)
    p = q.upper_bound(3, 50, 0.01)
    assert math.isclose(sum(math.comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(4)), 0.01, rel_tol=1e-6)
    assert q.upper_bound(5, 5, 0.1) == 1.0


def test_choice_stops_at_the_first_failure_and_needs_labels():
    counts = {"a": (5000, [0, 3, 900, 0]), "b": (20, [0, 0, 0, 0])}
    assert q.choose(counts, 0.01, 0.05) == {"a": 1}


def test_false_rejections_of_the_verdict_are_limited():
    """Ladders on which five rules together truly reject 0.5 %, 1.5 % and 3 %, in four strata: the bound fails in at most error of the draws."""
    r, bad = random.Random(1), 0
    for _ in range(200):
        n, counts = 3000, {}
        for s in "abcd":
            x = [min(r.random() for _ in range(5)) for _ in range(n)]  # the rule that rejects first
            any_of = [1 - (1 - p) ** 0.2 for p in (0.005, 0.015, 0.03)]
            counts[s] = (n, [sum(v < p for v in x) for p in any_of])
        bad += any(step > 0 for step in q.choose(counts, 0.01, 0.05).values())
    assert bad <= 20


def test_copies_are_one_trial(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(i, good, "en") for i in range(3000)] + [(5000, good.replace(" ", "### "), "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] * 2, "doc_id long, quality int")
    assert all(r["kept"] for r in q.quality(docs, labels).collect())  # one text proves nothing


def test_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good + f" {i}", "en", 7) for i in range(3000)] + [(9000, good.replace(" ", "### "), "en", 7), (9001, good.replace(" ", "### "), None, 7), (9002, None, "en", 7), (9002, None, None, 7), (None, "", "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")
    got = q.quality(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(3000)) and not kept[9000] and kept[9001] and not kept[9002]
    assert all(r["kept"] for r in q.quality(docs.where("doc_id < 9000"), labels.limit(0)).collect())
    assert q.quality(docs.limit(0), labels).count() == 0
