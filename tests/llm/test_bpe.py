import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ladderlens.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stitching_equals_one_pass():
    find = bpe.regex.compile(public_tokenizers.PATTERN)
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab'slverd 0129\n\t  .,éß中") for _ in range(r.randint(0, 120)))
        t = t[:30] + "x" * r.choice([0, 0, 0, 60]) + t[30:]
        chunk, overlap = r.choice([(8, 4), (10, 6), (16, 8), (7, 7)])
        starts = [bpe.boundaries(find, t[i : i + chunk + overlap]) + i for i in range(0, len(t), chunk)]
        assert bpe.stitch(find, t, starts, chunk, overlap).tolist() == bpe.boundaries(find, t).tolist()


def test_encode_and_round_trip(spark, reference):
    texts = [None, "", "it's  we'll\n\n\tgo <|endoftext|> now 12345", "é" * 700, "ab cd " * 300, "x" * 900, "ab cd " * 300, " \x1c　 \n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for chunk, overlap in ((64, 16), (1 << 15, 512)):
        out = bpe.encode(docs, PATH, public_tokenizers.PATTERN, ["doc_id"], queries.bpe_digest, queries.BPE_FIELDS, chunk, overlap)
        got = {r["doc_id"]: r for r in out.collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = reference.encode_ordinary(t or "")
            assert got[i]["n_tokens"] == len(ids)
            assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    plain = bpe.encode(docs, PATH, public_tokenizers.PATTERN, ["doc_id"], chunk=64, overlap=16).collect()
    assert {r["doc_id"]: r["ids"] for r in plain} == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "y z " * 50)] * 3 + [(None, "q " * 99)] * 2, "doc_id long, text string")
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN, ["doc_id"], chunk=32, overlap=8).count() == 5
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN, ["doc_id"]).count() == 0
