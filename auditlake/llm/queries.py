"""Queries of the text operators (problems 1, 5, 8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import canonical, lookalike, mixing, neardup, tokens
from auditlake.session import table


def _notes(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates({
        "dataset_capability_rich": (table(spark, d, "dataset_capability_rich"), "investigation_notes"),
        "dataset_operational_pattern_renamed": (table(spark, d, "dataset_operational_pattern_renamed"), "analyst_findings"),
    })


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).row_pairs()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).groups()


TYPED = ["priority", "escalation_status", "threat_type"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "dataset_capability_rich"), table(spark, d, "reference_items"), TYPED)


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched_report(table(spark, d, "dataset_capability_rich"), table(spark, d, "reference_items"), TYPED)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), total_tokens=mixing.ALL)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).rows()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(table(spark, d, "documents"))


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_texts(table(spark, d, "documents")).select("doc_id", F.col("skeleton").alias("text"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_classes(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p5_found, p5_unmatched, p8_ids, p9_mixture, p9_shares, p10_found, p10_texts, p10_classes)}

# DuckDB counterparts, on whole tables: exact, by other means than the operators.
_P1 = r"""WITH n AS (SELECT 'dataset_capability_rich' AS table_name, row_id, list_distinct(regexp_extract_all(lower(investigation_notes), '[a-z0-9]+')) AS w FROM dataset_capability_rich WHERE investigation_notes IS NOT NULL UNION ALL SELECT 'dataset_operational_pattern_renamed', row_id, list_distinct(regexp_extract_all(lower(analyst_findings), '[a-z0-9]+')) FROM dataset_operational_pattern_renamed WHERE analyst_findings IS NOT NULL),
m AS (SELECT *, len(w) AS k FROM n WHERE len(w) >= 8), x AS (SELECT table_name, row_id, k, unnest(w) AS t FROM m), f AS (SELECT table_name, t, count(*) AS df FROM x GROUP BY ALL),
r AS (SELECT x.*, row_number() OVER (PARTITION BY table_name, row_id ORDER BY df, t) AS pos FROM x JOIN f USING (table_name, t)),
p AS (SELECT table_name, row_id, k, t FROM r WHERE pos <= k - ceil(0.7 * k) + 1),
c AS (SELECT DISTINCT a.table_name, a.row_id AS ia, b.row_id AS ib FROM p a JOIN p b ON a.table_name = b.table_name AND a.t = b.t AND a.row_id < b.row_id AND 10 * b.k >= 7 * a.k AND 10 * a.k >= 7 * b.k),
s AS (SELECT c.table_name, ia, ib, len(list_intersect(a.w, b.w)) AS o, a.k AS ka, b.k AS kb FROM c JOIN m a ON a.table_name = c.table_name AND a.row_id = ia JOIN m b ON b.table_name = c.table_name AND b.row_id = ib)
SELECT table_name, ia AS row_id_a, ib AS row_id_b FROM s WHERE 10 * o >= 7 * (ka + kb - o)"""

_P1_GROUPS = _P1.replace("WITH n AS", "WITH RECURSIVE n AS", 1).replace("SELECT table_name, ia AS row_id_a, ib AS row_id_b FROM s WHERE", ", e1 AS (SELECT table_name, ia, ib FROM s WHERE", 1) + """), e2 AS (SELECT * FROM e1 UNION ALL SELECT table_name, ib, ia FROM e1),
rc AS (SELECT DISTINCT table_name, ia AS id, ia AS root FROM e2 UNION SELECT rc.table_name, e2.ib, rc.root FROM rc JOIN e2 ON e2.table_name = rc.table_name AND e2.ia = rc.id), g AS (SELECT table_name, id, min(root) AS group_id FROM rc GROUP BY ALL),
l AS (SELECT e2.table_name, e2.ia AS id, count(DISTINCT list_sort(b.w)) FILTER (WHERE list_sort(a.w) <> list_sort(b.w)) AS links FROM e2 JOIN m a ON a.table_name = e2.table_name AND a.row_id = e2.ia JOIN m b ON b.table_name = e2.table_name AND b.row_id = e2.ib GROUP BY ALL)
SELECT g.table_name, g.id AS row_id, group_id, links FROM g JOIN l USING (table_name, id)"""

_ABSENT = r"lower(regexp_replace(v, '^\s+|\s+$', '', 'g')) IN ('','n/a','-','--','none','null','nan')"
# Look-alike letters that the typed values hold, and full-width forms; written out, not taken from the operator.
_LIKE = "АВЕЅІЈКМНОРСТУХаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιονρυ" + "".join(chr(0xFF01 + i) for i in range(94))
_AS = "ABESIJKMHOPCTYXaeopcyxsijABEZHIKMNOPTYXaiovpu" + "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_PLAIN = rf"lower(translate(regexp_replace(v, '\p{{Cf}}', '', 'g'), '{_LIKE}', '{_AS}'))"
_BEFORE = r"^(?:(?:suspected|possible|possibly|poss|probable|probably|likely|type|cat|category)\b[\s.:=\-]*|\p{L}+\s*[:=]\s*|#?\s*[0-9]+[.):]?\s+)"
_AFTER = r"(?:[\s\-,(\[]*\b(?:confirmed|unconfirmed|tbc|suspected)\b[)\].!?\s]*|\s*[(\[]\s*\p{L}+\s*[)\]]|\s+-\s+\p{L}+|(?:\s+#?|\s*#)\s*[0-9]+)$"
_SPLIT = r"list_filter(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_P5 = rf"""WITH c AS (""" + " UNION ALL ".join(f"SELECT row_id, '{t}' AS column_name, {t} AS v FROM dataset_capability_rich" for t in TYPED) + rf"""),
r AS (SELECT * FROM c WHERE row_id IS NOT NULL AND v IS NOT NULL AND NOT ({_ABSENT}) AND NOT EXISTS (SELECT 1 FROM reference_items i WHERE i.list_name = c.column_name AND i.label = c.v)),
d AS (SELECT DISTINCT column_name, v FROM r), p AS (SELECT column_name, v, {_PLAIN} AS p FROM d),
x AS (SELECT column_name, v, 0 AS cut, {_SPLIT.format("p")} AS ws FROM p UNION ALL SELECT column_name, v, 1, {_SPLIT.format(f"regexp_replace(regexp_replace(trim(p), '{_BEFORE}', ''), '{_AFTER}', '')")} FROM p),
n AS (SELECT DISTINCT column_name, item_id, {_SPLIT.format(_PLAIN)} AS ws FROM (SELECT list_name AS column_name, item_id, label AS v FROM reference_items UNION ALL SELECT list_name, item_id, unnest(string_split(other_names, '|')) FROM reference_items)),
e AS (SELECT x.column_name, v, item_id, 0 AS slips, cut FROM x JOIN n ON x.column_name = n.column_name AND len(x.ws) > 0 AND (list_sort(x.ws) = list_sort(n.ws) OR array_to_string(x.ws, '') = array_to_string(n.ws, ''))),
vw AS (SELECT column_name, v, cut, len(ws) AS k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM x), nw AS (SELECT column_name, item_id, ws, len(ws) AS k, unnest(ws) AS t, generate_subscripts(ws, 1) AS j FROM n),
h AS (SELECT vw.column_name, v, cut, item_id, ws, vw.k, i, j, CASE WHEN w = t THEN 0 ELSE damerau_levenshtein(w, t) END AS s FROM vw JOIN nw ON vw.column_name = nw.column_name AND vw.k = nw.k AND (w = t OR (len(t) >= 5 AND abs(len(w) - len(t)) <= 2 AND damerau_levenshtein(w, t) <= 2))),
hi AS (SELECT column_name, v, cut, item_id, ws, k, i, min(s) AS s FROM h GROUP BY ALL), hj AS (SELECT column_name, v, cut, item_id, ws, k, j, min(s) AS s FROM h GROUP BY ALL),
a AS (SELECT column_name, v, cut, item_id, ws, k, sum(s) AS s FROM hi GROUP BY ALL HAVING count(*) = k AND sum(s) <= 2), b AS (SELECT column_name, v, cut, item_id, ws, k, sum(s) AS s FROM hj GROUP BY ALL HAVING count(*) = k AND sum(s) <= 2),
f AS (SELECT column_name, v, item_id, greatest(a.s, b.s) AS slips, cut FROM a JOIN b USING (column_name, v, cut, item_id, ws)),
m AS (SELECT column_name, v, item_id, row_number() OVER (PARTITION BY column_name, v ORDER BY slips, cut, item_id) AS o FROM (SELECT * FROM e UNION ALL SELECT * FROM f))
SELECT row_id, r.column_name, coalesce(item_id, 'none') AS item_id FROM r LEFT JOIN m ON m.column_name = r.column_name AND m.v = r.v AND m.o = 1"""
_P5_UNMATCHED = _P5.replace("SELECT row_id, r.column_name, coalesce(item_id, 'none') AS item_id FROM r", "SELECT r.column_name, r.v AS value, count(*) AS n_rows FROM r") + " WHERE item_id IS NULL GROUP BY ALL"

# Looks by other means: composed form, format characters and kinds of space by their classes, letters by the list above.
_LOOK = rf"""WITH n AS (SELECT doc_id, text, nfc_normalize(translate(regexp_replace(regexp_replace(nfc_normalize(text), '[\p{{Cf}}\x{{FE00}}-\x{{FE0F}}\x{{034F}}]', '', 'g'), '\p{{Zs}}', ' ', 'g'), '{_LIKE}‐‑․µ', '{_AS}--.μ')) AS look FROM documents WHERE text IS NOT NULL),
v AS (SELECT * FROM n WHERE regexp_matches(look, '[^\s\x00-\x1f\x7f-\x9f]'))"""
_P10 = _LOOK + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text"
_P10_CLASSES = _LOOK + ", g AS (SELECT look, min(doc_id) AS class_id, count(DISTINCT text) AS texts FROM v GROUP BY 1 HAVING count(DISTINCT text) > 1) SELECT doc_id, class_id, texts FROM v JOIN g USING (look)"
ORACLE = {"p1_found": _P1, "p1_groups": _P1_GROUPS, "p5_found": _P5, "p5_unmatched": _P5_UNMATCHED, "p10_found": _P10, "p10_classes": _P10_CLASSES}
