"""Ids and other columns come out as they went in, whatever is beside them."""

import public_tokenizers
import pytest

import corpus_pipeline
from ladderlens.llm import bpe, decontaminate, langid, merkle, near_copies, quality_model, quality_rules, repeats, secrets, simhash, toxicity

IDS = [2**60, 2**60 + 1, 2**60 + 3, None, 7]
ODD = "n`o"
SPEC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"A text with words of its own, {w}, that goes on for a while and has sk_live_{w}x0a1B2c3D4e5F6g7H8i9J0k1L2 in it." for w in ("stone", "river", "cloud", "lantern", "hill")]
    rows = [(i, t, "en", "s", None if i == 7 else 2**60 + 1) for i, t in zip(IDS, texts, strict=True)]
    return spark.createDataFrame(rows, SPEC).selectExpr("*", f"if(doc_id = 7, null, {2**60 + 1}) as `n``o`").coalesce(1)


def check(df, name="doc_id"):
    got = sorted((r[name] for r in df.collect()), key=str)
    assert got == sorted(IDS, key=str)
    return df


def test_operators(spark, docs):
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(IDS)], "doc_id long, quality int, toxic int")
    labelled = docs.join(labels, "doc_id")
    keep = ["doc_id", ODD]
    for df in (
        secrets.scan(docs, keep),
        secrets.redact(docs),
        langid.predict(docs, langid.fit(docs), keep),
        quality_model.score(docs, quality_model.fit(labelled), keep),
        toxicity.score(docs, toxicity.fit(docs, labels), keep),
        bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep),
        bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep, chunk=40, overlap=20),
        near_copies.one_of_each(docs),
        decontaminate.clean(docs, spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")),
    ):
        check(df)
        assert sorted((r[ODD] for r in df.collect()), key=str) == [2**60 + 1] * 4 + [None]
    check(simhash.near_duplicates(docs))
    check(repeats.deduplicate(docs))
    check(quality_rules.quality(docs, labels))
    check(merkle.verify(docs))
    found = decontaminate.contaminated(docs, spark.createDataFrame([(2**60 + 1, "that goes on for a while and has")], "item_id long, text string"))
    check(found)
    assert {r["item_id"] for r in found.collect()} == {2**60 + 1}


def test_measured_rows_join_their_labels_by_true_ids(spark):
    """Labels of one of two ids that differ in their last bit belong to that one alone."""
    rows = [(2**60, "word " * 60), (2**60 + 1, "other " * 60), (None, "x")]
    measured = quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    labels = spark.createDataFrame([(2**60 + 1, 1)], "doc_id long, quality int")
    assert [r["word_chars"] for r in measured.join(labels, "doc_id").collect()] == [300]


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        check(out)
        assert sorted((r["n_chars"] for r in out.collect()), key=str)[0] is not None
        assert name == "tokens" or out.columns == docs.columns
