import random

import numpy as np

from ladderlens.llm import quality_model as q


def test_gradients_equal_differences():
    r = np.random.default_rng(1)
    x, starts, y = r.random((9, q.N_FEATURES)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    m = q.Model()

    def loss():
        p = m.forward(x, starts)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, g in m.gradients(x, starts, y).items():
        at = tuple(r.integers(0, n) for n in m.p[k].shape)
        m.p[k][at] += 1e-6
        up = loss()
        m.p[k][at] -= 2e-6
        down = loss()
        m.p[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-6, k


def some_docs(n):
    r = random.Random(4)
    out = []
    for i in range(n):
        words = [r.choice(["stone", "river", "cloud", "lantern", "hill", "of", "the"]) for _ in range(r.randint(60, 600))]
        bad = i % 4 == 0
        if bad:  # one passage of junk among others
            at = r.randrange(len(words) - 30)
            words[at : at + 30] = [w + "###$$$" for w in words[at : at + 30]]
        out.append((i, " ".join(words), int(not bad)))
    return out


def test_held_out_accuracy(spark):
    rows = some_docs(900)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = q.fit(df.where("doc_id < 600"))
    got = {r["doc_id"]: r["score"] for r in q.score(df, model, ["doc_id"]).collect()}
    right = [(got[i] >= 0.3) == bool(y) for i, _, y in rows if i >= 600]
    assert sum(right) / len(right) > 0.95
    apart = q.fit(df.where("doc_id < 600").select("doc_id", "text"), df.select("doc_id", "quality"))
    again = q.fit(df.where("doc_id < 600").repartition(3))
    assert all(np.allclose(model.p[k], apart.p[k]) for k in model.p)
    assert all(np.allclose(model.p[k], again.p[k]) for k in model.p)


def test_samples_are_distinct_and_bounded(spark):
    rows = [("copy", 1)] * 400 + [("copy", 0)] + [(f"text {i} " + "x" * 3000, i % 2) for i in range(300)] + [("y" * 10**6, 1), (None, 1), ("z", None)]
    df = spark.createDataFrame(rows, "text string, quality int")
    all_ = q.sampled(df, 10**6, 10**6).collect()
    assert len(all_) == 304 and sum(r["text"] == "copy" for r in all_) == 2
    few = q.sampled(df, 10**6, 100).collect()
    assert 10 < sum(len(q.encode(r["text"])) for r in few) <= 100 and all(r["text"] != "y" * 10**6 for r in few)
    assert 60 < len(q.sampled(df, 100, 10**6).collect()) < 140


def test_scores_equal_a_plain_loop():
    """Gated attention as it is stated, one passage at a time."""
    bags = [q.encode(t) for t in ("one text " * 200, "", "#### " * 300 + "é", "w")]
    model = q.train(bags * 10, np.array([1.0, 0, 0, 1] * 10), epochs=2)
    p = model.p
    for x, got in zip(bags, model.score(np.concatenate(bags).astype(float), np.cumsum([0, *map(len, bags)])[:-1]), strict=True):
        h = [np.tanh(p["W"].T @ ((row - model.mean) / model.scale) + p["b"]) for row in x.astype(float)]
        e = [float(p["w"] @ (np.tanh(p["V"].T @ v) / (1 + np.exp(-(p["U"].T @ v))))) for v in h]
        weight = np.exp(e) / np.exp(e).sum()
        z = sum(a * v for a, v in zip(weight, h, strict=True))
        assert abs(got - 1 / (1 + np.exp(-(p["c"] @ z + p["d"][0])))) < 1e-9


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", None), (None, "x" * 200_000, 1)], "doc_id long, text string, score int")
    got = q.score(df, q.fit(df.selectExpr("text", "score as quality")), ["doc_id"]).collect()
    assert len(got) == 4 and all(r["score"] == 1.0 for r in got)
    assert q.score(df.limit(0), q.train([], np.array([])), ["doc_id"]).count() == 0
