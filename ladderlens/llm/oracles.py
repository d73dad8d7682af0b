"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from ladderlens.llm import langid, licenses, merkle, quality_rules

REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, hex(b[p + 1:p + 100]) AS s FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS p FROM d)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
isle AS (SELECT doc_id, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS new FROM dup)),
span AS (SELECT doc_id, i, min(p) AS a, max(p) + 100 AS z FROM isle GROUP BY 1, 2),
cut AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM span UNION ALL SELECT d.doc_id, coalesce((SELECT max(z) FROM span s WHERE s.doc_id = d.doc_id), 0), octet_length(b) FROM d),
kept AS (SELECT cut.doc_id, string_agg(hex(b[cut.a + 1:cut.z]), '' ORDER BY cut.a, cut.z) AS h FROM cut JOIN d USING (doc_id) WHERE cut.z > cut.a GROUP BY 1)
SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY 1) r USING (doc_id)
"""


_STEP = "list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
#: A table with the values of one byte, and crc32 of doc_id as text where that table is joined.
CRC_TABLE = f"crc AS (SELECT list({_STEP} ORDER BY i) AS v FROM (SELECT unnest(range(256)) AS i))"
CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(v[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8)), 4294967295)"


def _number(x: float) -> str:
    """A literal that DuckDB reads as a double."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def quality_sql(risk: float = 0.01, error: float = 0.05) -> str:
    """op7: measures, exact binomial bounds for each stratum and step of the ladder, and the verdicts."""
    grid = ", ".join(f"({_text(name)}, {order}, {i}, {_number(c)})" for order, (name, cutoffs) in enumerate(quality_rules.CUTOFFS.items()) for i, c in enumerate(cutoffs))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM t WHERE len(w) > 2),
tri AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k], w[k + 1], w[k + 2]) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT k + o) AS n_repeat_words FROM tri, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS l FROM t),
m AS (
  SELECT t.doc_id, lang, x, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM t JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, lang || '/' || CASE WHEN n_words < 200 THEN 'short' WHEN n_words < 1000 THEN 'middle' ELSE 'long' END AS stratum FROM m),
grid AS (SELECT * FROM (VALUES {grid}) v(rule, ord, i, cutoff)),
val AS (
  SELECT doc_id, stratum, base_failed, rule, value FROM (
    SELECT doc_id, stratum, base_failed, n_symbols / nullif(n_words, 0) AS symbols, n_repeat_words / nullif(n_words, 0) AS repeats, n_dup_lines / nullif(n_words, 0) AS duplicate_lines,
      word_chars / nullif(n_words, 0) AS long_words, -(word_chars / nullif(n_words, 0)) AS short_words FROM f) UNPIVOT (value FOR rule IN (symbols, repeats, duplicate_lines, long_words, short_words))),
hit AS (SELECT doc_id, i, max(CASE WHEN value > cutoff THEN 1 ELSE 0 END) AS gone FROM val JOIN grid USING (rule) GROUP BY 1, 2),
good AS (SELECT stratum, any_value(doc_id) AS doc_id FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY stratum, x),
cnt AS (SELECT stratum, i, count(*) AS n, sum(gone) AS k FROM good JOIN hit USING (doc_id) GROUP BY ALL),
each AS (SELECT {_number(error)} / greatest(count(DISTINCT stratum), 1) AS e FROM cnt),
ok AS (
  SELECT *, k <= {_number(risk)} * n AND k < n AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - lgamma(n - j + 1) + j * ln({_number(risk)}) + (n - j) * ln(1 - {_number(risk)})))) <= e AS fine
  FROM cnt, each),
run AS (SELECT *, bool_and(fine) OVER (PARTITION BY stratum ORDER BY i ROWS UNBOUNDED PRECEDING) AS proven FROM ok),
chosen AS (SELECT stratum, max(i) AS i FROM run WHERE proven GROUP BY 1),
bad AS (SELECT doc_id, string_agg(rule, ',' ORDER BY ord) AS failed_rules FROM val JOIN chosen USING (stratum) JOIN grid USING (rule, i) WHERE value > cutoff GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
FROM f LEFT JOIN bad USING (doc_id)"""


def license_sql(confirm: float = 0.8) -> str:
    """op1: features of every line, the trained weights, and the comparison with templates."""
    model = licenses.Model()
    n = len(model.classes)
    names = [f"w{i}" for i in range(n)]
    weights = ", ".join(f"({_text(g)}, {', '.join(map(_number, row))})" for g, row in zip(model.grams, model.weights, strict=True))
    pairs = [(family, sorted(p for p in licenses.grams(licenses.words(t)) if " " in p)) for family, ts in licenses.TEMPLATES.items() for t in ts]
    templates = ", ".join(f"({_text(f)}, [{', '.join(map(_text, own))}])" for f, own in pairs)
    logits = ", ".join(f"(sum({w}) + {_number(c)}) / {_number(model.temperature)} AS z{i}" for i, (w, c) in enumerate(zip(names, model.constants, strict=True)))
    top = f"greatest({', '.join(f'z{i}' for i in range(n))})"
    choice = " ".join(f"WHEN z{i} = top THEN {_text(c)}" for i, c in enumerate(model.classes))
    mass = " + ".join(f"exp(z{i} - top)" for i in range(n))
    return rf"""
WITH weights AS (SELECT * FROM (VALUES {weights}) v(gram, {", ".join(names)})), templates AS (SELECT * FROM (VALUES {templates}) v(family, own)),
lines AS (SELECT doc_id, i - 1 AS line, l[i] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
tok AS (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(s), '[^\pL\pN]+'), lambda w: w <> '') AS t FROM lines),
g AS (SELECT doc_id, line, t, CASE WHEN len(t) = 1 THEN t ELSE list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END AS pairs FROM tok WHERE len(t) > 0),
x AS (SELECT doc_id, line, unnest(list_distinct(list_concat(t, pairs))) AS gram FROM g),
z AS (SELECT doc_id, line, {logits} FROM x JOIN weights USING (gram) GROUP BY 1, 2),
s AS (SELECT *, {top} AS top FROM z),
p AS (SELECT doc_id, line, CASE {choice} END AS predicted, 1 / ({mass}) AS probability, 1 - exp(z{n - 1} - top) / ({mass}) AS licence FROM s),
sure AS (SELECT * FROM p WHERE predicted <> '{licenses.NONE}' AND licence >= {_number(model.detect)}),
near AS (SELECT a.doc_id, a.line, round(coalesce(max(len(list_intersect(pairs, own)) / least(len(pairs), len(own))), 0), 6) AS similarity FROM sure a JOIN g USING (doc_id, line) LEFT JOIN templates ON family = predicted GROUP BY 1, 2)
SELECT doc_id, CAST(line AS INTEGER) AS line, CASE WHEN probability >= {_number(model.floor)} AND similarity >= {_number(confirm)} THEN predicted ELSE '{licenses.UNKNOWN}' END AS family, round(probability, 4) AS probability, predicted, similarity
FROM sure JOIN near USING (doc_id, line)"""


def language_sql(smoothing: float = 0.5) -> str:
    """op10: hashed n-grams of all texts, counts by language, log-probabilities and posteriors.

    It trains on all rows of the training part; the operator does so up to its
    bound on rows, which the tables that this is run on don't reach.
    """
    half = 1 << 32
    code = "c[p]::UBIGINT"
    orders = []
    for n in langid.ORDERS:
        if n > 1:
            code = f"(({code}) * {langid.MIX[0]} + c[p + {n - 1}]) % {half}"
        orders.append(f"SELECT doc_id, {n * langid.MIX[1] % half} AS salt, {code} AS code FROM (SELECT doc_id, c, unnest(range(1, len(c) - {n - 2})) AS p FROM d)")
    orders = " UNION ALL ".join(orders)
    return rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, text, lang, list_transform(list_filter(regexp_extract_all(lower(coalesce(text, '')), '(?s).'), lambda x: x <> ''), lambda x: CAST(unicode(x) AS UBIGINT)) AS c, coalesce({CRC} % 4 = 2, false) AS held_out FROM documents, crc),
grams AS (SELECT doc_id, (((xor(m, m >> 13) * {langid.MIX[3]}::UBIGINT) % {half}) >> {32 - langid.BITS}) AS bucket FROM (SELECT doc_id, (((code + salt) % {half}) * {langid.MIX[2]}::UBIGINT) % {half} AS m FROM ({orders}))),
counts AS (SELECT doc_id, bucket, count(*) AS n FROM grams GROUP BY 1, 2),
used AS (SELECT doc_id, lang FROM d WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL),
prior AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM used)) AS w FROM used GROUP BY 1),
trained AS (SELECT lang, bucket, sum(n) AS n FROM counts JOIN used USING (doc_id) GROUP BY 1, 2),
total AS (SELECT lang, sum(n) + {_number(smoothing)} * {langid.BUCKETS} AS total FROM trained GROUP BY 1),
logp AS (SELECT t.lang, g.bucket, ln((coalesce(n, 0) + {_number(smoothing)}) / total) AS w FROM total t CROSS JOIN (SELECT unnest(range({langid.BUCKETS}))::UBIGINT AS bucket) g LEFT JOIN trained x ON x.lang = t.lang AND x.bucket = g.bucket),
sums AS (SELECT doc_id, lang, s + w AS s FROM (SELECT doc_id, lang, sum(n * w) AS s FROM counts JOIN logp USING (bucket) GROUP BY 1, 2) JOIN prior USING (lang)),
best AS (SELECT doc_id, arg_min(lang, (-s, lang)) AS lang_pred, 1 / sum(exp(s - top)) AS score FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top FROM sums) GROUP BY 1)
SELECT doc_id, held_out, CASE WHEN letters THEN lang_pred ELSE 'und' END AS lang_pred, CASE WHEN letters THEN round(score, 6) ELSE 0 END AS score
FROM (SELECT *, regexp_matches(coalesce(text, ''), '\pL') AS letters FROM d) LEFT JOIN best USING (doc_id)"""


def manifest_sql(fanout: int = 16, levels: int = 7) -> str:
    """op12: leaves, the trees of sources and the one above, proofs, and the roots that changed leaves fold to; up to fanout ** levels rows a tree.

    Each step takes every row one level up: d is its own node, f what its
    changed leaf folds to, and p its siblings so far.
    """

    def enc(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    def climb(name: str, start: str, carry: str) -> str:
        """CTEs name0 .. name<levels> from rows with (k, idx, n, d, f, p)."""
        out, size = [f"{name}0 AS ({start})"], "n"
        for i in range(levels):
            at, i_in = f"{name}{i}", f"CAST(idx % {fanout} AS INTEGER)"
            out.append(f"{name}_run{i} AS (SELECT k, idx // {fanout} AS up, string_agg(d, '' ORDER BY idx) AS run FROM (SELECT DISTINCT k, idx, d FROM {at}) GROUP BY 1, 2)")
            cut = f"run[1:64 * {i_in}]", f"run[64 * {i_in} + 65:]"
            more = f"{size} > 1"
            out.append(
                f"{name}{i + 1} AS (SELECT {carry} k, idx // {fanout} AS idx, ({size} + {fanout - 1}) // {fanout} AS n, CASE WHEN {more} THEN sha256(run) ELSE d END AS d, CASE WHEN {more} THEN sha256({cut[0]} || f || {cut[1]}) ELSE f END AS f,"
                f" CASE WHEN {more} THEN p || {cut[0]} || {cut[1]} ELSE p END AS p FROM {at} JOIN {name}_run{i} USING (k) WHERE idx // {fanout} = up)"
            )
        return ",\n".join(out)

    fields = lambda text: " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text))
    lower = f"translate(text, '{merkle.UPPER}', '{merkle.UPPER.lower()}')"
    return f"""
WITH {CRC_TABLE},
h AS (SELECT doc_id, source, sha256({fields("text")}) AS leaf, CASE WHEN {CRC} % 5 = 0 THEN sha256({fields(lower)}) END AS bad FROM documents, crc),
{climb("s", "SELECT doc_id, leaf, coalesce('=' || source, '') AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, leaf AS d, coalesce(bad, leaf) AS f, '' AS p FROM h", "doc_id, leaf,")},
sub AS (SELECT k AS grp, any_value(d) AS d FROM s{levels} GROUP BY 1),
{climb("r", "SELECT doc_id, leaf, s.d AS subroot, 0 AS k, o.idx, o.n, s.d, s.f, s.p FROM s" + str(levels) + " s JOIN (SELECT grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS n FROM sub) o ON s.k = o.grp", "doc_id, leaf, subroot,")}
SELECT doc_id, leaf, subroot, d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = d AS verified FROM r{levels}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_sql(), "op5_suffix_dedup": REPEATS, "op10_language_id": language_sql(), "op7_quality_rules": quality_sql(), "op12_merkle_manifest": manifest_sql()}
