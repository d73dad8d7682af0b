import hashlib
import random
import zlib

from ladderlens.llm import merkle
from ladderlens.llm.queries import op12_merkle_manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout=16):
    """Top, and for each leaf its siblings from the bottom up as (before, after)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k // fanout * fanout
            paths[i].append(("".join(level[run:k]), "".join(level[k + 1 : run + fanout])))
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [k // fanout for k in at]
    return level[0] if level else None, paths


def plain_rows(rows, fanout=16):
    """Rows of (doc_id, source, lang, n_chars, text) -> sorted rows of the query."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = (own, *plain_tree([plain_leaf(r) for r in own], fanout))
    root, above = plain_tree([trees[s][1] for s in sources], fanout)
    out = []
    for s, up in zip(sources, above, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            path = path + up
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if bad else r[4]
            d = plain_leaf((*r[:4], low))
            for before, after in path:
                d = sha(before, d, after)
            out.append((r[0], plain_leaf(r), subroot, root, sha(*(a + b for a, b in path)), d, d == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def some_rows():
    r = random.Random(3)
    rows = [(i, "hot", "en", i, f"Text {i} " + "Ää" * r.randrange(5)) for i in range(900)]
    rows += [(1000 + i, f"src{r.randrange(40)}", None, None, "A" * r.randrange(30)) for i in range(500)]
    rows += [(2000 + i, None, "de", 1, None) for i in range(17)]
    rows += [(2**60 + 1, "big", "x", 1, "Q"), (2**60, "big", "x", 1, "Q"), (None, "big", "x", 1, "Q"), (None, "big", "x", 1, "P")]
    rows += [(7, "again", "en", 1, "Same"), (7, "again", "en", 1, "Same"), (7, "again", "en", 1, ""), (5, "Ü", "en", 0, "x" * 100_000), (6, "", None, None, "")]
    r.shuffle(rows)
    return rows


def test_rows_equal_a_plain_tree(spark, tmp_path):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).selectExpr("*", "1 as leaf", "'x' as `ro``ot`")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_merkle_manifest(spark, str(tmp_path))
    assert got.columns == list(COLUMNS)
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == plain_rows(rows)
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)


def test_small_fanouts_and_tables(spark):
    for n, fanout in ((0, 2), (1, 2), (2, 2), (33, 2), (100, 3)):
        rows = [(i, "a" if i % 3 else "b", "en", i, str(i)) for i in range(n)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = [tuple(r) for r in merkle.verify(df, fanout=fanout).collect()]
        want = [(r[0], r[1], r[2], r[3], r[4], r[3], True) for r in plain_rows(rows, fanout)]
        assert sorted(got) == sorted(want)


def test_ranges_in_any_cut():
    """Whatever consecutive stretches the leaves come in, each node is made once, or left open for the run that lacks it."""
    r = random.Random(5)
    for n, fanout in ((1, 4), (4, 4), (5, 4), (64, 4), (200, 3), (257, 16)):
        leaves = [sha(str(i)) for i in range(n)]
        nodes, level = {}, leaves
        for k in range(20):
            nodes.update({(k, i): d for i, d in enumerate(level)})
            if len(level) == 1:
                break
            level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        for _ in range(10):
            cuts = sorted({0, n, *(r.randrange(n + 1) for _ in range(r.randrange(5)))})
            seen, open_ = {}, {}
            for a, b in zip(cuts, cuts[1:], strict=False):
                def emit(level, idx, digest, is_open):
                    assert (level, idx) not in seen and nodes[level, idx] == digest
                    seen[level, idx] = digest
                    if is_open:
                        open_[level, idx] = digest

                peaks = merkle.Range(n, fanout, emit)
                for i in range(a, b):
                    peaks.push(i, leaves[i])
                peaks.close()
            for k in range(20):  # what is missing follows from open nodes, level by level
                for up in {i // fanout for lv, i in open_ if lv == k}:
                    run = [open_[k, i] for i in range(up * fanout, up * fanout + fanout) if (k, i) in nodes and len([1 for lv, _ in nodes if lv == k]) > 1]
                    if run:
                        assert (k + 1, up) not in seen
                        seen[k + 1, up] = open_[k + 1, up] = sha(*run)
                        if not any(lv == k + 2 for lv, _ in nodes):
                            del open_[k + 1, up]
            assert seen == nodes


def test_the_manifest_has_every_node(spark):
    rows = some_rows()
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_rows(rows)
    roots = [r["digest"] for r in got if r["tree"] == "root" and r["n"] and r["level"] == 2]
    assert roots == [want[0][3]]
    assert {r["digest"] for r in got if r["tree"] == "root" and r["level"] == 0} == {r[2] for r in want}
    assert sum(r["tree"] == "source" and r["source"] == "hot" for r in got) == 57 + 4 + 1
