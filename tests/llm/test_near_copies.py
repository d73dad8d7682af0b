import random

from ladderlens.llm import near_copies


def slow_set(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def slow_groups(texts):
    """Per text, the first one that similar ones lead to."""
    sets, group = [slow_set(t) for t in texts], list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while True:
        before = list(group)
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            return group


def edited(r, words, n):
    """words, n of them replaced: each changes five shingles."""
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.random()}"
    return words


def corpus(r):
    texts = []
    for _ in range(25):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 250))]
        texts += [" ".join(edited(r, words, r.randint(0, len(words) // 25))) for _ in range(r.randint(1, 6))]
    return [*texts, "Two words", "two  WORDS", "", " \n", "four words in here"]


def test_similar_copies_go(spark):
    r = random.Random(4)
    texts = corpus(r)
    group = slow_groups(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _node string").repartition(3)
    want = sorted(set(group))
    assert 30 < len(want) < len(texts) - 20
    for block in (near_copies.BLOCK, 2):
        got = near_copies.one_of_each(docs, block)
        assert got.columns == docs.columns and sorted(x["doc_id"] for x in got.collect()) == want


def test_the_stage_drops_a_copy_that_is_over_four_bits_away(spark):
    import corpus_pipeline
    from ladderlens.llm import simhash

    r = random.Random(1)
    words = [f"w{r.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(words), " ".join(edited(r, words, 4)), " ".join(edited(r, words, 60))]
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 4
    docs = spark.createDataFrame([(2, texts[0]), (1, texts[1]), (0, texts[2]), (None, texts[0])], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 1]
