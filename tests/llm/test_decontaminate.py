import random

from ladderlens.llm import decontaminate as d


def slow_distance(item, text):
    """Least edit distance of item to a substring of text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edit(r, text, n):
    for _ in range(n):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + r.choice("abxy ") + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def test_distance_equals_the_table():
    r = random.Random(1)
    for _ in range(400):
        item = "".join(r.choice("abc") for _ in range(r.randint(1, 70)))
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 90)))
        assert d.distance(item, text)[0] == slow_distance(item, text)


def test_matches_equal_brute_force():
    r = random.Random(2)
    words = ["stone", "river", "cloud", "ab", "of", "the", "lantern", "to"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, make(14)) for i in range(8)]
    matcher = d.Matcher(items, 0.1)
    for _ in range(60):
        key, item = r.choice(items)
        text = d.normal(make(20) + " " + edit(r, item, r.randint(0, 9)) + " " + make(20))
        want = {k for k, x in items if slow_distance(x, text) <= int(len(x) * 0.1)}
        assert {m[0] for m in matcher.matches(text)} == want


def test_rows(spark):
    item = "the exam question asks for the capital of a country that nobody knows well"
    docs = spark.createDataFrame([(1, "x " * 40 + item.upper().replace(" ", "\n  ") + " y" * 20, 1), (2, item.replace("capital", "capitol"), 1), (3, None, 1), (4, "", 1), (5, "clean " * 90, 1), (2, item.replace("capital", "capitol"), 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, None), (9, "short"), (10, "")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in d.contaminated(docs, items).collect())
    assert got == [(1, 7, 0), (2, 7, 1), (2, 7, 1)]
    two = d.contaminated(docs, items.union(items), block_chars=10).collect()
    assert len(two) == 6
    assert d.contaminated(docs, items.limit(0)).count() == 0 and d.contaminated(docs.limit(0), items).count() == 0


def test_short_items_are_found_unchanged_between_word_boundaries(spark):
    docs = spark.createDataFrame([(1, "it is Forty  two, he said"), (2, "forty twos"), (3, "fort two"), (4, "x" * 300_000 + " forty\ntwo")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "forty two"), (8, " \n "), (9, "a question of 28 characters")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["match_end"]) for r in d.contaminated(docs, items).collect())
    assert got == [(1, 7, 16), (4, 7, 300_010)]
    assert sorted(r["doc_id"] for r in d.clean(docs, items).collect()) == [2, 3]
    some = spark.createDataFrame([(1, "well, a question of 28 characters, then")], "doc_id long, text string")
    assert [(r["item_id"], r["edits"]) for r in d.contaminated(some, items).collect()] == [(9, 0)]


def test_ends_are_those_of_the_text():
    text = "  \u0130stanbul \n and\tMORE "
    normal = d.normal(text)
    for word in ("and", "more"):
        end = normal.index(word) + len(word)
        assert text[: d.original_end(text, end)].lower().endswith(word)


def test_blocks_of_items_give_what_one_block_gives(spark):
    r = random.Random(5)
    items = [(i, " ".join(r.choice("stone river cloud lantern market winter".split()) for _ in range(9))) for i in range(12)]
    rows = [(i, " ".join([r.choice(items)[1] if r.random() < 0.5 else "plain", "text", edit(r, r.choice(items)[1], 2)])) for i in range(30)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, d.contaminated(docs, items, block_chars=n).collect())) for n in (10**6, 100))
    assert one == many and one
    one, many = (sorted(map(tuple, d.clean(docs, items, block_chars=n).collect())) for n in (10**6, 100))
    assert one == many
