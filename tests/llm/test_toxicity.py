import math
import random

from ladderlens.llm import toxicity as t


def plain_segments(scores):
    """The segment of largest sum (the shortest, then the first), and those of what is before and after it."""
    best = None
    for a in range(len(scores)):
        total = 0
        for z in range(a, len(scores)):
            total += scores[z]
            if total > 0 and (best is None or (total, a - z) > best[0]):
                best = ((total, a - z), a, z)
    if best is None:
        return []
    _, a, z = best
    return plain_segments(scores[:a]) + [(a, z, sum(scores[a : z + 1]))] + [(x + z + 1, y + z + 1, s) for x, y, s in plain_segments(scores[z + 1 :])]


def test_segments_equal_their_definition():
    r = random.Random(1)
    for _ in range(400):
        drift = -r.choice([1, 3, 7])
        scores = [r.randrange(1, 20) if r.random() < 0.4 else drift for _ in range(r.randrange(40))]
        hits = [(i, float(s)) for i, s in enumerate(scores) if s > 0]
        assert t.segments(hits, float(drift)) == plain_segments(scores), scores


def test_many_tokens_in_linear_time():
    hits = [(3 * i, 1.0 + i % 7) for i in range(200_000)]
    assert len(t.segments(hits, -2.0)) > 1


WORDS = ["stone", "river", "cloud", "lantern", "hill", "of", "the", "Über", "maison", "trees", "walks", "and"]
INSULTS = ["oaf", "dolt", "cad"]


def some_docs(n, seed=4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(30, 400))]
        if bad := i % 5 == 0:
            at = r.randrange(len(words) - 20)
            for k in range(3):
                words[at + 5 * k] = r.choice(INSULTS)
        out.append((i, " ".join(words) + ".", int(bad)))
    return out


def test_held_out_texts_and_passages(spark):
    rows = some_docs(700)
    copies = [(10_000 + i, "strange copied plover words " * 3 + str(i), 1) for i in range(300)]  # near copies with a wrong label
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, toxic int")
    training = df.where("doc_id < 500 or doc_id >= 10000")
    model = t.fit(training, df)
    assert set(model.table) == set(INSULTS) and model.drift < 0 and 0.5 < model.rate < 1.5
    got = {x["doc_id"]: x for x in t.score(df, model, ["doc_id"]).collect()}
    held = [r for r in rows if r[0] >= 500]
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, _, y in held)
    for i, text, y in held:
        if y:
            places = [m.span() for m in t.TOKEN.finditer(text) if m.group() in INSULTS]
            passage = max(got[i]["passages"], key=lambda p: p["score"])
            assert (passage["start"], passage["end"]) == (places[0][0], places[-1][1]) and passage["chance"] <= t.ALPHA
        else:
            assert got[i]["passages"] == []
    again = t.fit(training.repartition(3), df)
    assert again.table == model.table and abs(again.slope - model.slope) < 1e-9


def test_more_evidence_scores_higher():
    model = t.Model({"oaf": 5.0}, -0.05, 1.0, math.log(1e-3), 1.0, -4.0, None)
    one, two, long = (model.evidence(n, s) for n, s in ((100, [5.0]), (100, [5.0, 5.0]), (100_000, [5.0])))
    assert 0 <= long < one < two and model.score(long) < model.score(two)
    assert model.evidence(0, []) == 0 and model.evidence(10, [1e6]) == t.MOST


def test_chances_hold_on_random_tokens():
    """Texts of random tokens reach a score as often as the law of extremes says, within a factor."""
    r = random.Random(8)
    chance, score = 0.01, math.log(8)
    drift = math.log((1 - 8 * chance) / (1 - chance))
    model = t.Model({"x": score}, drift, t.tail_rate([score], [chance], drift))
    assert abs(model.rate - 1) < 1e-6
    texts = [[i for i in range(300) if r.random() < chance] for _ in range(4000)]
    found = [(0, 300, [s for *_, s in t.segments([(i, score) for i in hits], drift)]) for hits in texts]
    t.calibrate(model, found + [(1, 300, [30.0])])
    for least in (4.0, 6.0):
        said = 1 - math.exp(-math.exp(-model.normal(300, least)))
        seen = sum(max(s, default=0) >= least for *_, s in found) / len(found)
        assert said / 6 < seen < said * 3, (least, said, seen)


def test_rows(spark):
    df = spark.createDataFrame([(2**60 + 1, None, 1), (2**60, "", 0), (None, "12 -- 34", None), (1, "oaf " * 50_000, 1), (1, "oaf " * 50_000, 1)], "doc_id long, text string, toxic int").selectExpr("*", "1 as score", "2 as `pas``sages`")
    model = t.fit(df, df)
    got = t.score(df, model, ["doc_id", "pas`sages"]).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, (2**60 + 1, 2**60, None, 1, 1)))
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["pas`sages"] == 2 for r in got)
    assert t.fit(df.limit(0), df).constant == 0.0 and t.score(df.limit(0), model, ["doc_id"]).count() == 0
    only = t.fit(df, df.where("toxic = 1"))
    assert {r["score"] for r in t.score(df, only, ["doc_id"]).collect()} == {1.0}
