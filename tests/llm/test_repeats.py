import hashlib
import random

import numpy as np

from ladderlens.llm import queries, repeats


def brute(docs, length):
    """Per document (in order), the bytes removed: what a set of windows gives."""
    seen, out = set(), {}
    for key, data in docs:
        cut = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                cut[i : i + length] = b"\1" * length
            seen.add(w)
        out[key] = bytes(cut)
    return out


def digest(data, cut):
    return len(data), sum(cut), len([1 for i in range(len(cut)) if cut[i] and not (i and cut[i - 1])]), hashlib.sha256(bytes(b for b, c in zip(data, cut, strict=True) if not c)).hexdigest()


def corpus(r, n, size):
    base = ["".join(r.choice("abcde ") for _ in range(size)) for _ in range(4)]
    out = []
    for _ in range(n):
        text = "".join(r.choice("xyzwv é") for _ in range(r.randint(0, 90)))
        for _ in range(r.randint(0, 4)):
            b, i = r.choice(base), r.randint(0, size - 60)
            b = list(b[i : i + r.randint(60, 300)])
            for _ in range(r.randint(0, 2)):
                b[r.randrange(len(b))] = r.choice("QRS")
            text += "".join(b) + "".join(r.choice("pqrst") for _ in range(r.randint(0, 30)))
        out.append(text)
    return out


def some_texts(r, base, n, most=20):
    out = []
    for _ in range(n):
        i = r.randint(0, 100)
        out.append(bytes(r.choice(b"ab") for _ in range(r.randint(0, most))) + base[i : i + r.randint(0, 150)])
    return [t for t in out if t]


def test_matches_of_an_index_equal_brute_force():
    r = random.Random(1)
    for _ in range(200):
        length = r.choice([1, 3, 7, 10, 40])
        base = bytes(r.choice(b"ab\0\xff") for _ in range(150))
        indexed, streamed = some_texts(r, base, 6) or [b"x"], some_texts(r, base, 8)
        one, two = (np.array([r.randint(0, 2) for _ in x]) for x in (indexed, streamed))
        t, at = repeats.RunLengthIndex(indexed, one).matches(streamed, two, length)
        want = [(i, o) for i, x in enumerate(streamed) for o in range(len(x) - length + 1) if any(x[o : o + length] in y for y, tag in zip(indexed, one, strict=True) if tag == two[i])]
        assert sorted(zip(t.tolist(), at.tolist(), strict=True)) == want


def test_transform_is_run_compressed():
    text = bytes(random.Random(2).choices(b"abcdefgh", k=200))
    one, many = repeats.RunLengthIndex([text], [0]), repeats.RunLengthIndex([text] * 50, [0] * 50)
    assert len(many.start) <= len(one.start) + 2  # runs don't grow with copies


def test_resolved_runs_equal_brute_force(monkeypatch):
    r = random.Random(4)
    for it in range(120):
        monkeypatch.setattr(repeats, "BATCH_BYTES", r.choice([1, 300, 10**6]))
        length, rows, texts = 12, [], []
        for a in range(r.randint(1, 4)):
            base = bytes(r.sample(range(256), 60))  # no string twice in a text
            for _ in range(r.randint(1, 14)):
                i = r.randint(0, 40)
                x = bytearray(base[i : i + r.randint(length, 30)])
                if len(x) < length:
                    continue
                if r.random() < 0.4:
                    x[r.randrange(len(x))] = base[-1]
                rows.append((a * 7 + 1, r.randint(0, 5), 0, r.randint(0, 3) * 10_000 + 100 * len(rows), len(x) - length + 1))
                texts.append(bytes(x))
        rows = np.array(rows, repeats.RUN)
        seen, want = {}, set()
        for i in sorted(range(len(rows)), key=lambda i: tuple(rows[i][x] for x in "adhp")):
            own = {texts[i][o : o + length]: o for o in range(int(rows["n"][i]))}
            want |= {(int(rows["d"][i]), int(rows["p"][i]) + o) for w, o in own.items() if (int(rows["a"][i]), w) in seen}
            seen |= {(int(rows["a"][i]), w): 1 for w in own}
        got = repeats.resolve(rows, texts, length)
        assert sorted((int(x["d"]), int(x["p"]) + k) for x in got.marks(length) for k in range(int(x["n"]) - length + 1)) == sorted(want)
        left, of = got.rest()
        kept = sorted((int(x["d"]), int(x["p"]) + k) for x in left for k in range(int(x["n"])))
        assert kept == sorted((int(x["d"]), int(x["p"]) + k) for x in rows for k in range(int(x["n"])) if (int(x["d"]), int(x["p"]) + k) not in want)
        assert (rows["a"][of] == left["a"]).all() and (rows["d"][of] == left["d"]).all() and (rows["p"][of] <= left["p"]).all()
    none = repeats.resolve(np.zeros(0, repeats.RUN), [], 12)
    assert not len(none.marks(12)) and not len(none.rest()[0])


def test_intervals_merge():
    rows = np.array([(0, 1, 0, 5, 4), (0, 1, 0, 0, 3), (0, 0, 0, 7, 2), (0, 1, 0, 2, 3), (0, 0, 0, 1, 2), (0, 0, 1, 2, 2)], repeats.RUN)
    assert [(int(x["d"]), int(x["h"]), int(x["p"]), int(x["n"])) for x in repeats.merged(rows)] == [(0, 0, 1, 2), (0, 0, 7, 2), (0, 1, 2, 2), (1, 0, 0, 9)]


def run(spark, docs, block=repeats.BLOCK, kind="long"):
    df = spark.createDataFrame([(*d, b"x", 1) for d in docs], f"doc_id {kind}, text string, data binary, d int").repartition(3)
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.deduplicate(df, 100, queries.repeats_digest, queries.REPEATS_FIELDS, block).collect()), key=str)


def test_documents_equal_brute_force(spark, monkeypatch):
    r = random.Random(3)
    docs = list(enumerate(corpus(r, 120, 1500)))
    docs += [(1000 + i, "long run " * 300) for i in range(3)] + [(2000, "z" * 700), (2001, "z" * 99), (2002, "z" * 100)]
    cut = brute([(k, t.encode()) for k, t in docs], 100)
    want = sorted(((k, *digest(t.encode(), cut[k])) for k, t in docs), key=str)
    assert run(spark, docs) == want
    monkeypatch.setattr(repeats, "HOT_LEAST", 5)  # many anchors dealt by windows
    assert run(spark, docs) == want
    monkeypatch.setattr(repeats, "HELD", 20)
    assert run(spark, docs) == want
    monkeypatch.setattr(repeats, "HOT_LEAST", 10**9)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 1000)
    assert run(spark, docs, 256) == want  # texts cut into pieces


def test_rows(spark):
    a, b = "first text, long enough to hold a window of a hundred bytes, " * 3, "another " * 30
    docs = [(1, a), (1, a), (2, b), (2, a), (None, b), (3, None), (4, ""), (5, "short")]
    got = run(spark, docs)
    assert len(got) == len(docs)
    by = {}
    for g in got:
        by.setdefault(g[0], []).append(g[1:])
    assert len(set(by[1])) == 1 and by[None][0][1] == len(b) and by[3] == by[4] == [(0, 0, 0, hashlib.sha256(b"").hexdigest())]
    assert run(spark, []) == []


def test_repeated_rows_equal_brute_force(spark):
    r = random.Random(8)
    docs = list(enumerate(corpus(r, 20, 800)))
    cut = brute([(k, t.encode()) for k, t in docs], 100)
    rows = [(k, t) for k, t in docs for _ in range(1 + k % 3)]
    want = sorted(((k, *digest(t.encode(), cut[k])) for k, t in rows), key=str)
    assert any(n > 200 and not gone for _, n, gone, _, _ in want[1:])
    assert run(spark, rows) == want


def test_ids_of_text_count_in_their_order(spark):
    a, b = "first text, long enough to hold a window of a hundred bytes, " * 3, "another long text, which is not like the first one in any of its many words " * 3
    by = {g[0]: g[2] for g in run(spark, [("b", a), ("a", a), (None, b), ("z", b)], kind="string")}
    assert by["b"] == len(a.encode()) and by[None] == len(b) and 0 < by["a"] < len(a) and by["a"] + len(b) > by["z"] > 0
