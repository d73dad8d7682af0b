import corpus_pipeline
import public_tokenizers
from ladderlens.llm import bpe, decontaminate, langid, secrets, simhash

ENGLISH = "the weather of this country is thought to be rather wet and there are many who think that it was never otherwise".split()
SPANISH = "la gente de este pueblo piensa que los caminos son largos y que nadie sabe donde termina el viejo sendero".split()
ITEM = "which of these rivers flows through the largest number of european capitals before it meets the sea"
KEY = "AKIA" + "ABCDEFGH23456789"


def turned(words, k, n=40):
    return " ".join(words[(i * (k + 2) + k) % len(words)] for i in range(n))


def fixture(spark, tmp_path):
    rows = [(i, turned(ENGLISH, i), "en", "s") for i in range(10)] + [(10 + i, turned(SPANISH, i), "es", "s") for i in range(10)]
    rows += [(30, turned(ENGLISH, 3), "en", "t"), (30, turned(ENGLISH, 3), "en", "t")]  # copies of 3
    rows += [(31, f"{turned(ENGLISH, 11)} {ITEM} {turned(ENGLISH, 12)}", "en", "s"), (32, f"{turned(SPANISH, 11)} key {KEY} end", "es", "s")]
    rows += [(33, None, "en", "s"), (34, "", None, "s"), (35, "12 34 !!", "en", "s"), (None, turned(ENGLISH, 14) + " wet " * 30_000, None, None)]
    docs = [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, ITEM), (1, None), (2, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


def slow_run(spark, docs, tmp_path):
    model = langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    told = langid.predict(rows, model, rows.columns).collect()
    left = [(r["doc_id"], r["text"], r["lang"] or r["lang_pred"], r["source"]) for r in told if r["lang_pred"] != "und" and r["score"] >= 0.5]
    left = list(dict.fromkeys(left))
    left.sort(key=lambda r: (r[0] is None, r[0] or 0))
    prints = [simhash.fingerprint(r[1]) % 2**64 for r in left]
    group = list(range(len(left)))
    for _ in left:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[j] = group[i] = min(group[i], group[j])
    left = [r for i, r in enumerate(left) if group[i] == i]
    item = decontaminate.normal(ITEM)
    left = [r for r in left if decontaminate.distance(item, decontaminate.normal(r[1]))[0] > int(0.08 * len(item))]
    automata = secrets.trained()
    left = [(i, secrets.redacted(t, secrets.spans(t, automata, secrets.THRESHOLD), "[SECRET]"), lang, source) for i, t, lang, source in left]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    return [(i, lang, source, len(t), [int(x) for x in codec.encode_pieces(codec.find.findall(t)).split()]) for i, t, lang, source in left]


def test_run_equals_brute_force(spark, tmp_path):
    docs = fixture(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = slow_run(spark, docs, tmp_path)
    key = lambda r: str(r[0])
    assert sorted([(r["doc_id"], r["lang"], r["source"], r["n_chars"], list(r["ids"])) for r in got], key=key) == sorted(want, key=key)
    ids = {r["doc_id"] for r in got}
    assert 31 not in ids and not ids & {30, 33, 34, 35} and {3, 32, None} <= ids
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_all_stages_but_the_last_keep_the_columns(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "'x' AS extra", "1 AS score", "2 AS _fp", "3 AS ids", "4 AS spans", "5 AS lang_pred", "6 AS fp", "7 AS key")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_redaction():
    text = f"a {KEY}, password: hunter2hunter2 b"
    assert secrets.redacted(text, secrets.spans(text, secrets.trained(), secrets.THRESHOLD), "*") == "a *, * b"
    assert secrets.redacted("ab", [], "*") == "ab"
