import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from ladderlens.llm import sharding


def check(docs, got, shards):
    assert len(got) == len(docs)
    assert Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards and r["grown_shard"] is None and r["law"] == "bytes"
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return slots


def test_balance_and_groups(spark):
    r = random.Random(4)
    docs = [(i, "".join(r.choice("ab é") for _ in range(r.randint(0, 400)))) for i in range(3000)]
    docs += [(5000 + i, "copy " * 20) for i in range(60)]  # less than a share: stays together
    docs += [(9000 + i, "hot row") for i in range(6000)]  # a group of more than a share
    got = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    check(docs, got, 8)
    load = Counter()
    for x in got:
        load[x["shard"]] += x["size"]
    assert max(load.values()) < 1.02 * min(load.values())
    text = dict(docs)
    where = defaultdict(set)
    for x in got:
        where[text[x["doc_id"]]].add(x["shard"])
    assert all(len(s) == 1 for t, s in where.items() if t != "hot row")


def test_rows(spark):
    docs = [(1, None), (1, None), (None, ""), (2, "x" * 100_000), (3, "x"), (None, "x")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int")
    check(docs, sharding.shard(df, 3).collect(), 3)
    assert sharding.shard(df.limit(0), 3).count() == 0


def test_all_three_sizes_are_balanced(spark):
    r = random.Random(7)
    docs = [(i, f"{i} " + (r.choice(["ab ", "abcdefgh ", "x y z "]) * int(r.paretovariate(1.2) * 8))[:4000]) for i in range(8000)]
    docs += [(None, "null id") for _ in range(100)]
    got = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 10).collect()
    check(docs, got, 10)
    size, rows = Counter(), Counter()
    for x in got:
        size[x["shard"]] += x["size"]
        rows[x["shard"]] += 1
    for load in (size, rows):
        assert max(load.values()) < 1.02 * min(load.values())


def test_packing_equals_a_plain_loop():
    """Vector bin packing as it is stated, one shard at a time."""
    r = np.random.default_rng(3)
    for shards, bytes_first in ((2, True), (3, True), (7, True), (3, False), (7, False)):
        sizes = r.pareto(1.5, (60, 3)) + 0.01
        share = (sizes / sizes.sum(axis=0) * shards).tolist()
        left, want = [[1.0] * 3 for _ in range(shards)], {}
        for i in sorted(range(60), key=lambda i: (-sum(share[i]), -share[i][0], i)):
            room = [[a - b for a, b in zip(left[s], share[i], strict=True)] for s in range(shards)]
            able, able_bytes = [s for s in range(shards) if min(room[s]) >= 0], [s for s in range(shards) if room[s][0] >= 0 or not bytes_first]
            if able:
                want[i] = max(able, key=lambda s: sum(a * b for a, b in zip(left[s], share[i], strict=True)))
            elif able_bytes:
                want[i] = max(able_bytes, key=lambda s: min(room[s]))
            else:
                want[i] = max(range(shards), key=lambda s: room[s][0])
            left[want[i]] = room[want[i]]
        assert sharding.place(sizes, shards, bytes_first).tolist() == [want[i] for i in range(60)]


def test_exchanges_keep_rows_and_bring_bytes_together():
    r = np.random.default_rng(4)
    sizes = np.stack([r.integers(1, 900, 500), r.integers(1, 90, 500), np.where(np.arange(500) % 9, 1, 5)], axis=1).astype(float)
    before = r.integers(0, 4, 500)
    after = sharding.even_out(sizes, before, 4)
    load, rows = ([np.bincount(x, sizes[:, k], 4) for x in (before, after)] for k in (0, 2))
    assert (rows[0] == rows[1]).all() and np.ptp(load[1]) <= 2 < np.ptp(load[0])


def test_place_takes_the_highest_dot_product():
    assert sharding.place(np.array([[8.0, 1, 1], [4, 1, 1], [4, 1, 1]]), 2).tolist() == [0, 1, 1]
