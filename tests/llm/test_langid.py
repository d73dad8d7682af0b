import random

import numpy as np

from ladderlens.llm import langid


def some_text(r, lang, n):
    parts = {"en": ["th", "ing", "er", "ou", "wh"], "fr": ["eau", "é", "ou", "qu", "ê"], "de": ["sch", "ü", "ung", "ei", "ß"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark):
    r = random.Random(6)
    rows = [(i, some_text(r, lang, r.randint(3, 60)), lang) for i, lang in enumerate(["en", "fr", "de"] * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 300"))
    assert model[0] == ["de", "en", "fr"]
    got = {x["doc_id"]: x["lang_pred"] for x in langid.predict(df, model, ["doc_id"]).collect()}
    right = [got[i] == lang for i, _, lang in rows if i >= 300]
    assert sum(right) / len(right) > 0.98


def slow_bucket(gram):
    """The hash of one n-gram, in plain integers."""
    code, half = ord(gram[0]), 1 << 32
    for ch in gram[1:]:
        code = (code * langid.MIX[0] + ord(ch)) % half
    m = (code + len(gram) * langid.MIX[1]) % half * langid.MIX[2] % half
    return ((m ^ m >> 13) * langid.MIX[3] % half) >> (32 - langid.BITS)


def slow_buckets(text):
    return sorted(slow_bucket(text[i : i + n]) for n in langid.ORDERS for i in range(len(text) - n + 1))


def test_scores_equal_brute_force(spark):
    df = spark.createDataFrame([(1, "abc ab", "x"), (2, "bcd dd \u00e9\u4e2d\u6587", "y"), (3, "dd", "y")], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert np.allclose(model.prior, np.log([1 / 3, 2 / 3]))
    texts = ["ab\u00e9 d", "\u4e2d\u6587 dd", "c"]
    want = [model.prior + sum(model.logp[b] for b in slow_buckets(t)) for t in texts]
    assert np.allclose(langid.log_posteriors(texts, model), want)
    rows = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]).orderBy("doc_id").collect()
    for row, total in zip(rows, want, strict=True):
        p = np.exp(total - total.max())
        assert row["lang_pred"] == model.langs[int(p.argmax())] and abs(row["score"] - p.max() / p.sum()) < 1e-6


def test_no_gram_is_lost_at_a_cut(monkeypatch):
    text = "abcdefghij\U0001f600xyz" * 3
    monkeypatch.setattr(langid, "PIECE", 7)
    monkeypatch.setattr(langid, "GATHERED", 20)
    assert sorted(np.concatenate(list(langid.ngram_buckets(text))).tolist()) == slow_buckets(text)
    model = langid.Model(["x", "y"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)), np.zeros(2))
    texts = [text, "a", text[:8], text[:7]]
    assert np.allclose(langid.log_posteriors(texts, model), [sum(model.logp[b] for b in slow_buckets(t)) for t in texts])


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "en"), (1, None, "en"), (2, "", "en"), (3, "12 ?! \n", "en"), (None, "the " * 100_000, "en"), (4, "thing", None)], "doc_id long, text string, lang string")
    got = langid.predict(df, langid.fit(df), ["doc_id"]).collect()
    assert sorted(r["lang_pred"] for r in got) == ["en", "en", "und", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got)
    none = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(df.limit(0), none, ["doc_id"]).count() == 0
