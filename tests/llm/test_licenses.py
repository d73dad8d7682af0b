import numpy as np

from ladderlens.llm import licenses


def slow_scan(text, model, confirm=0.8):
    """The rows of one text, line by line."""
    out = []
    for no, line in enumerate((text or "").split("\n")):
        tokens = licenses.words(line)
        x = np.array([g in licenses.grams(tokens) for g in model.grams], float)
        if not x.any():
            continue
        z = (x @ model.weights + model.constants) / model.temperature
        p = np.exp(z - z.max())
        best = model.classes[int(p.argmax())]
        if best == licenses.NONE or 1 - p[-1] / p.sum() < model.detect:
            continue
        own = {g for g in licenses.grams(tokens) if " " in g}
        near = 0.0
        for t in licenses.TEMPLATES.get(best, []):
            pairs = {g for g in licenses.grams(licenses.words(t)) if " " in g}
            least = min(len(own) or 1, len(pairs))
            near = max(near, len(own & pairs) / least)
        sure = 1 / p.sum() >= model.floor and near >= confirm
        out.append((no, best if sure else licenses.UNKNOWN, best, round(near, 6)))
    return out


TEXTS = [
    "Some text.\nLicensed under the Apache License, Version 2.0.\nMore text",
    "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.\n\nThis work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. " * 3,
    "Licensed under the Example Community License, version 1.2.",
    "The driver lost his license and the library may not use the work.",
    "permission notice software license " * 2000,
    "Der Vater geht mit dem Hund.",
    "LICENSED UNDER THE MOZILLA PUBLIC LICENSE, VERSION 2.0.",
    "",
    None,
    " \n \n",
]


def test_scan_equals_brute_force(spark):
    model = licenses.Model()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, family string")
    got = sorted((r["doc_id"], r["line"], r["family"], r["predicted"], r["similarity"]) for r in licenses.scan(df, model).collect())
    assert got == sorted((i, *row) for i, t in enumerate(TEXTS) for row in slow_scan(t, model))
    families = {(i, f) for i, _, f, _, _ in got}
    assert {(0, "apache"), (1, "mit"), (2, "gpl"), (3, "cc-by-nc"), (8, "mpl")} <= families
    assert not {i for i, f in families if i in (5, 7, 9, 10, 11)}
    assert (4, licenses.UNKNOWN) in families


def test_rows(spark):
    line = "Released under the MIT License."
    df = spark.createDataFrame([(1, line), (1, line), (None, line)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["line"], r["family"]) for r in licenses.scan(df).collect()) == [("1", 0, "mit"), ("1", 0, "mit"), ("None", 0, "mit")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_templates_are_recognised_and_probabilities_calibrated():
    model = licenses.Model()
    right = [[m[2] for m in slow_scan(t, model)] == [f] for f, ts in licenses.TEMPLATES.items() for t in ts]
    assert sum(right) / len(right) > 0.9
