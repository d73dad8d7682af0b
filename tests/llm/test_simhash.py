import random

import numpy as np
import xxhash

from ladderlens.llm import simhash


def slow_print(text):
    words = []
    for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
        words.append(w)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    out = 0
    for j in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> j & 1 for s in shingles) > len(shingles):
            out |= 1 << j
    return out


def slow_groups(prints, radius):
    top = {p: p for p in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    prints = sorted(set(prints))
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {p: find(p) for p in prints}


def test_fingerprint_equals_the_definition():
    r = random.Random(2)
    for _ in range(200):
        text = " ".join(r.choice(["Ab", "é", "İ", "x\x85y", "zz z", "\n\x0b", "Q"]) for _ in range(r.randint(0, 12)))
        assert simhash.fingerprint(text) % 2**64 == slow_print(text)
    assert simhash.fingerprint(None) == 0
    long = " ".join(r.choice(["ab", "é", "zz", "Q"]) + str(r.randrange(9)) for _ in range(70_000))  # more shingles than are hashed at once
    assert simhash.fingerprint(long) % 2**64 == slow_print(long)


def some_prints(n, seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, n // 3, np.uint64)
    out = [*base]
    for b in r.choice(base, n - len(base)):
        for j in r.integers(0, 64, r.integers(0, 7)):
            b ^= np.uint64(1) << np.uint64(j)
        out.append(b)
    return np.unique(np.array(out, np.uint64))


def test_lanes_equal_brute_force():
    prints = some_prints(400, 5)
    bucket = prints >> np.uint64(61)
    got = {tuple(sorted(x)) for i, j in simhash.near_lanes(prints, bucket, 4) for x in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if bucket[i] == bucket[j] and int(prints[i] ^ prints[j]).bit_count() <= 4}
    assert got == want


def test_groups_equal_brute_force_also_in_blocks(spark):
    prints = some_prints(600, 6)
    want = slow_groups([int(p) for p in prints], 4)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    for block in (1 << 14, 8):
        label = {r["fp"] % 2**64: r["label"] for r in simhash.link(df, 4, block).collect()}
        mine, theirs = {}, {}
        for p in want:
            mine.setdefault(label.get(p, p), set()).add(p)
            theirs.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_every_mask_choice_keeps_all_links():
    for n in (10, 10**8, 10**10, 10**12):
        tables = [m % 2**64 for m in simhash.masks(n, 4)]
        r = random.Random(n)
        for _ in range(300):
            differ = sum(1 << j for j in r.sample(range(64), 4))
            assert any(differ & m == 0 for m in tables)


def test_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from it all day long"
    rows = [(5, text), (3, text), (3, text), (None, text.upper()), (9, None), (8, ""), (7, " \n"), (1, "other words here that nobody else has written " * 3), (None, "alone among nulls, far from the rest of them")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 7), (8, 7), (7, 7), (1, 1), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
