"""DuckDB SQL for every registered query (the correctness oracle).

The stand-in views are written once as CTEs over the driver tables; each
query pulls in the CTEs it names (transitively).  The SQL is independent of
the Spark code: it restates the rules in plain SQL.
"""

from __future__ import annotations

import re

from proselens.operators.report import RECOMMENDATIONS

WS = r"'^\s+|\s+$'"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {WS}, '', 'g')"


def lines(x: str) -> str:
    return (f"list_filter(list_transform(string_split(coalesce({x}, ''), {NL}), lambda l: {strip('l')}), "
            f"lambda l: l <> '')")


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), '{w}')" for w in words) + ")"


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


CTES: dict[str, str] = {}

CTES["candidates"] = r"""
SELECT doc_id AS candidate_ord,
       CAST(CAST(floor(doc_id / 8.0) AS BIGINT) AS VARCHAR) AS product_id,
       CASE WHEN doc_id % 2 = 0 THEN 'model_a' ELSE 'model_b' END AS model,
       CAST(CAST(floor(doc_id / 2.0) AS BIGINT) % 4 AS INTEGER) AS iteration,
       'prompt' AS prompt_family,
       'prompt_iter' || CAST(CAST(CAST(floor(doc_id / 2.0) AS BIGINT) % 4 AS INTEGER) AS VARCHAR) AS prompt_name,
       text AS marketing_text, CAST(length(text) AS INTEGER) AS char_len, lang, source
FROM documents"""

CTES["scored0"] = r"""
SELECT c.*,
       c.char_len BETWEEN 450 AND 600 AS in_range,
       CAST(c.candidate_ord % 17 AS DOUBLE) / CAST(16.0 AS DOUBLE) AS sbert,
       CAST(6.0 AS DOUBLE) + CAST(2.5 AS DOUBLE) * CAST(l.quality AS DOUBLE) + CAST(c.candidate_ord % 10 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS judge_score,
       CAST(3.0 AS DOUBLE) + CAST(l.quality AS DOUBLE) + CAST(c.candidate_ord % 5 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS relevance_score,
       CAST(2.5 AS DOUBLE) + CAST(l.quality AS DOUBLE) + CAST(c.candidate_ord % 3 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS generalization_score,
       CASE c.candidate_ord % 7 WHEN 0 THEN 'too narrow and specific' WHEN 1 THEN 'generic and vague'
            WHEN 2 THEN 'unclear wording' WHEN 3 THEN 'unsupported claim' WHEN 4 THEN 'shows bias'
            WHEN 5 THEN 'Solid text' ELSE NULL END AS judge_reason,
       CAST(NULL AS DOUBLE) AS judge_score_secondary,
       CAST(NULL AS DOUBLE) AS relevance_score_secondary,
       CAST(NULL AS DOUBLE) AS generalization_score_secondary,
       l.toxic = 1 AS has_hallucination,
       CAST(9.5 AS DOUBLE) - CAST(3.0 AS DOUBLE) * CAST(l.toxic AS DOUBLE) - CAST(c.candidate_ord % 4 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS hallucination_score,
       CAST(c.candidate_ord % 21 AS DOUBLE) / CAST(20.0 AS DOUBLE) AS semantic_attribute_alignment,
       CAST(c.candidate_ord % 11 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS semantic_feature_coverage,
       CAST(c.candidate_ord % 7 AS INTEGER) AS num_features,
       c.candidate_ord = min(c.candidate_ord) OVER (PARTITION BY c.iteration, c.marketing_text) AS is_unique
FROM candidates c LEFT JOIN labels l ON l.doc_id = c.candidate_ord"""


def norm_cov(cov: str, n: str) -> str:
    m = f"({cov} * CAST({n} AS DOUBLE))"
    return (f"CASE WHEN CAST({n} AS DOUBLE) = 0 THEN 0.0 WHEN {m} < 2 THEN 0.75 * ({m} / 2) "
            f"WHEN {m} < 3 THEN 0.75 + ({m} - 2) * 0.15 WHEN {m} < 4 THEN 0.90 + ({m} - 3) * 0.05 "
            f"ELSE least(1.0, 0.95 + ({m} - 4) * 0.0125) END")


CTES["scored"] = f"""
SELECT *, {norm_cov('semantic_feature_coverage', 'num_features')} AS semantic_feature_coverage_normalized
FROM scored0"""

_OV = """
SELECT *, CASE WHEN o_hall < 7.0 THEN 3.0 WHEN o_align < 0.25 THEN 4.0
          ELSE (0.5 * (o_judge / 10.0) + 0.25 * o_align + 0.1 * o_cov + 0.15 * (o_hall / 10.0)) * 10.0 END AS overall_score
FROM (SELECT *, coalesce(TRY_CAST(hallucination_score AS DOUBLE), 10.0) AS o_hall,
             coalesce(TRY_CAST(semantic_attribute_alignment AS DOUBLE), 0.0) AS o_align,
             coalesce(TRY_CAST(judge_score AS DOUBLE), 0.0) AS o_judge,
             coalesce(TRY_CAST(semantic_feature_coverage_normalized AS DOUBLE), 0.0) AS o_cov
      FROM {src})"""

CTES["overall"] = _OV.format(src="scored")


def gate_sql() -> str:
    gates = [("judge_score", "judge_score", "7.0", "Judge score too low"),
             ("relevance_score", "relevance", "3.5", "Relevance too low"),
             ("generalization_score", "generalization", "3.0", "Generalization too low"),
             ("hallucination_score", "hallucination", "8.0", "Hallucination detected"),
             ("semantic_attribute_alignment", "attribute_alignment", "0.35", "Poor attribute alignment")]
    parts = []
    for col, label, lim, msg in gates:
        v = f"coalesce(TRY_CAST({col} AS DOUBLE), 0.0)"
        parts.append(f"WHEN {v} < {lim} THEN '{msg} ({label}: ' || printf('%.2f', {v}) || ' < {lim})'")
    parts.append("WHEN NOT coalesce(in_range, false) THEN 'Length out of range (in_range: False)'")
    ov = "coalesce(TRY_CAST(overall_score AS DOUBLE), 0.0)"
    parts.append(f"WHEN {ov} < 7.0 THEN 'Overall score below threshold (' || printf('%.2f', {ov}) || ' < 7.0)'")
    return "CASE " + " ".join(parts) + " ELSE NULL END"


def labels_sql() -> str:
    rel = "coalesce(TRY_CAST(relevance_score AS DOUBLE), 5.0)"
    gen = "coalesce(TRY_CAST(generalization_score AS DOUBLE), 5.0)"
    hall = "coalesce(TRY_CAST(hallucination_score AS DOUBLE), 10.0)"
    rng = "coalesce(in_range, true)"
    cov = "coalesce(TRY_CAST(semantic_feature_coverage_normalized AS DOUBLE), 1.0)"
    al = "coalesce(TRY_CAST(semantic_attribute_alignment AS DOUBLE), 1.0)"
    r = "judge_reason"
    items = [
        f"CASE WHEN {hall} < 8 THEN 'hallucination' WHEN {rel} < 3.5 THEN 'not_relevant' END",
        f"CASE WHEN {gen} < 3.0 THEN CASE WHEN {contains_any(r, ['specific', 'narrow', 'limited'])} THEN 'too_specific' "
        f"WHEN {contains_any(r, ['generic', 'vague', 'non-specific'])} THEN 'too_generic' ELSE 'poor_generalization' END END",
        f"CASE WHEN NOT {rng} THEN CASE WHEN char_len < 450 THEN 'too_short' ELSE 'too_long' END END",
        f"CASE WHEN {contains_any(r, ['unclear', 'confusing', 'hard to understand'])} THEN 'unclear' END",
        f"CASE WHEN {contains_any(r, ['claim', 'unsupported', 'unverified'])} THEN 'overclaim' END",
        f"CASE WHEN {contains_any(r, ['bias', 'stereotyp'])} THEN 'bias' END",
        f"CASE WHEN {cov} < 0.3 THEN 'missing_features' END",
        f"CASE WHEN {al} < 0.35 THEN 'off_topic' END",
    ]
    lst = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({lst}) = 0 THEN ['low_overall_quality'] ELSE {lst} END"


CTES["results"] = f"""
SELECT *, gate IS NULL AS passed_quality_gates, coalesce(gate, '') AS gate_failure_reason,
       CASE WHEN gate IS NULL THEN '' ELSE array_to_string(labels, ', ') END AS rejection_reasons
FROM (SELECT *, {gate_sql()} AS gate, {labels_sql()} AS labels FROM overall)"""

CTES["two_runs"] = """
SELECT *, CASE WHEN lang = 'en' THEN 'with_reference' ELSE 'without_reference' END AS dataset FROM scored"""
CTES["two_runs_overall"] = _OV.format(src="two_runs")


def pct_round(x: str) -> str:
    return f"round({x}, 6)"


# --- replies -------------------------------------------------------------------

_GEN = """'{"header": "Header ' || CAST(candidate_ord AS VARCHAR) || '", "subheader": "' || lang || ' ' || source || '", "marketing_text": "Text ' || CAST(candidate_ord AS VARCHAR) || '"}'"""
_JUDGE = """'{"overall_score": ' || CAST(CAST(floor((candidate_ord % 40) / 10.0) AS BIGINT) + 6 AS VARCHAR) || '.' || CAST(candidate_ord % 10 AS VARCHAR) || ', "relevance_score": ' || CAST(candidate_ord % 5 + 1 AS VARCHAR) || ', "generalization_score": "' || CAST(candidate_ord % 4 + 2 AS VARCHAR) || '.' || CAST(candidate_ord % 3 AS VARCHAR) || '", "reason": "' || CASE WHEN candidate_ord % 3 = 0 THEN 'too generic' WHEN candidate_ord % 3 = 1 THEN 'unclear claim' ELSE 'fine' END || '"}'"""
_FACT = """'{"has_hallucination": ' || CASE WHEN candidate_ord % 5 = 0 THEN 'true' ELSE 'false' END || ', "hallucination_score": ' || CAST(candidate_ord % 10 + 1 AS VARCHAR) || ', "hallucinated_claims": [{"claim": "c' || CAST(candidate_ord AS VARCHAR) || '", "issue": "made up", "severity": "low"}]' || ', "explanation": "checked"}'"""


def _variant(body: str, k: int) -> str:
    v = f"((candidate_ord + {k}) % 8)"
    cut = f"substring({body}, 1, length({body}) - 1)"
    return (f"CASE WHEN {v} = 0 THEN {body} WHEN {v} = 1 THEN 'Here is my answer:' || chr(10) || {body} "
            f"WHEN {v} = 2 THEN {body} || chr(10) || 'Let me know if you need more.' "
            f"WHEN {v} = 3 THEN replace({body}, '\"', '''') WHEN {v} = 4 THEN {cut} || ', }}' "
            f"WHEN {v} = 5 THEN {cut} WHEN {v} = 6 THEN 'I cannot produce JSON for this product.' ELSE NULL END")


CTES["replies"] = f"""
SELECT candidate_ord, product_id, model, iteration, prompt_name, 'generation' AS kind,
       CASE WHEN candidate_ord % 50 = 4 THEN '{{"header": "H", "subheader": null}}'
            WHEN candidate_ord % 50 = 5 THEN '{{"header": "H", "subheader": "S", "marketing_text": null}}'
            ELSE {_variant(_GEN, 0)} END AS raw
FROM candidates
UNION ALL
SELECT candidate_ord, product_id, model, iteration, prompt_name, 'judge' AS kind,
       CASE WHEN candidate_ord % 50 = 1 THEN '{{"overall_score": null, "relevance_score": 4}}'
            WHEN candidate_ord % 50 = 2 THEN '{{}}'
            ELSE {_variant(_JUDGE, 1)} END AS raw
FROM candidates
UNION ALL
SELECT candidate_ord, product_id, model, iteration, prompt_name, 'factcheck' AS kind,
       CASE WHEN candidate_ord % 50 = 3 THEN '{{"has_hallucination": false}}'
            ELSE {_variant(_FACT, 2)} END AS raw
FROM candidates"""

CTES["repaired"] = r"""
SELECT *, CASE WHEN raw IS NULL OR raw = '' THEN NULL
               ELSE regexp_replace(CASE WHEN contains(c1, '''') AND NOT contains(c1, '"') THEN replace(c1, '''', '"') ELSE c1 END,
                                   ',\s*\}', '}', 'g') END AS rep
FROM (SELECT *, CASE WHEN regexp_extract(raw, '(?s)\{.*\}', 0) <> '' THEN regexp_extract(raw, '(?s)\{.*\}', 0)
                     ELSE regexp_replace(raw, '^\s+|\s+$', '', 'g') END AS c1
      FROM replies)"""

CTES["parsed"] = r"""
SELECT *, CASE WHEN raw IS NULL OR raw = '' THEN 'no_reply'
               WHEN j IS NULL OR len(json_keys(j)) = 0 THEN 'parse_error' ELSE 'ok' END AS status
FROM (SELECT *, coalesce(
          CASE WHEN json_type(TRY_CAST(rep AS JSON)) = 'OBJECT' THEN TRY_CAST(rep AS JSON) END,
          CASE WHEN length(rep) - length(replace(rep, '{', '')) > length(rep) - length(replace(rep, '}', ''))
                    AND json_type(TRY_CAST(rep || '}' AS JSON)) = 'OBJECT' THEN TRY_CAST(rep || '}' AS JSON) END) AS j
      FROM repaired)"""

# --- products --------------------------------------------------------------------

CTES["raw_products"] = r"""
SELECT p_partkey AS id, p_brand AS brand, p_type AS type, p_name AS designation,
       p_name || chr(10) || chr(10) || ' ' || p_type || ' ' AS characteristics,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'size ' || CAST(p_size AS VARCHAR) END AS application_purposes,
       CAST(p_size AS VARCHAR) AS size, printf('%.2f', p_retailprice) AS price,
       CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'nan' WHEN p_partkey % 4 = 2 THEN NULL
            ELSE '  made by ' || p_brand || ' ' END AS note
FROM part"""

_TECH_ENTRIES = ("list_filter([{'key': 'size', 'value': " + strip("size") + "}, {'key': 'price', 'value': "
                 + strip("price") + "}, {'key': 'note', 'value': " + strip("note") + "}], "
                 "lambda e: e.value IS NOT NULL AND lower(e.value) NOT IN ('', 'nan', 'none'))")

CTES["norm_products"] = f"""
SELECT CAST(id AS VARCHAR) AS product_id, designation AS name, brand AS series, type,
       list_concat({lines('characteristics')}, {lines('application_purposes')}) AS features,
       {_TECH_ENTRIES} AS tech
FROM raw_products"""

CTES["descriptors"] = r"""
SELECT item_id AS ord,
       lower(regexp_replace(CASE WHEN item_id % 3 = 0 THEN
             (['ECONOMY', 'Medium ', ' large', 'standard'])[CAST(CAST(floor(item_id / 3.0) AS BIGINT) % 4 + 1 AS INTEGER)]
             ELSE 'Brand#' || CAST(item_id % 12 + 1 AS VARCHAR) END, '^\s+|\s+$', '', 'g')) AS asset_name,
       coalesce(substring(text, 1, 30), '') AS t_title,
       coalesce(CASE WHEN item_id % 5 = 0 THEN NULL ELSE substring(text, 31, 40) END, '') AS t_insight,
       coalesce(substring(text, CASE WHEN item_id % 5 = 0 THEN 31 ELSE 71 END,
                          CASE WHEN item_id % 4 = 1 THEN length(text) WHEN item_id % 5 = 0 THEN 80 ELSE 40 END), '') AS t_benefit,
       coalesce(CASE WHEN item_id % 4 = 1 THEN NULL ELSE substring(text, 111) END, '') AS t_feature
FROM benchmark"""

CTES["blocks"] = r"""
SELECT asset_name,
       string_agg(chr(10) || 'IBF ' || CAST(rn AS VARCHAR) || ':' || chr(10) || '  Title: ' || t_title || chr(10)
                  || '  Insight: ' || t_insight || chr(10) || '  Benefit: ' || t_benefit || chr(10)
                  || '  Feature: ' || t_feature || chr(10), '' ORDER BY ord) AS ibf_block
FROM (SELECT *, row_number() OVER (PARTITION BY asset_name ORDER BY ord) AS rn FROM descriptors)
GROUP BY asset_name"""

CTES["enriched"] = r"""
SELECT p.*, coalesce(bt.ibf_block, bb.ibf_block, '') AS ibf_data,
       CASE WHEN bt.ibf_block IS NOT NULL THEN 'type' WHEN bb.ibf_block IS NOT NULL THEN 'brand' ELSE 'none' END AS ibf_match
FROM norm_products p
LEFT JOIN blocks bt ON bt.asset_name = lower(regexp_replace(p.type, '^\s+|\s+$', '', 'g'))
LEFT JOIN blocks bb ON bb.asset_name = lower(regexp_replace(p.series, '^\s+|\s+$', '', 'g'))"""

_FEATS_CLEAN = f"list_filter(features, lambda f: f IS NOT NULL AND {strip('f')} <> '')"
_TECH_TEXT = "array_to_string(list_transform(list_filter(tech, lambda e: e.value IS NOT NULL AND e.value <> ''), lambda e: e.key || ': ' || e.value), ', ')"

CTES["products"] = f"""
SELECT *,
       concat_ws(' ', CASE WHEN ibf_data IS NOT NULL AND ibf_data <> '' THEN 'IBF: ' || ibf_data || '.' END,
                 CASE WHEN len({_FEATS_CLEAN}) > 0 THEN 'Features: ' || array_to_string({_FEATS_CLEAN}, ', ') || '.' END,
                 CASE WHEN {_TECH_TEXT} <> '' THEN 'Technical Data: ' || {_TECH_TEXT} || '.' END) AS attribute_text,
       list_concat(list_filter(list_transform(features, lambda f: {strip('f')}), lambda f: f IS NOT NULL AND f <> ''),
                   list_filter(list_transform(tech, lambda e: {strip('e.key')}), lambda k: k <> ''),
                   {lines('ibf_data')}) AS combined,
       array_to_string(list_transform(tech, lambda e: e.key || ': ' || e.value), ', ') AS specs
FROM enriched"""

# --- term counts -------------------------------------------------------------------


def tf_cte(src: str, keys: str, text: str) -> str:
    return (f"SELECT {keys}, token, count(*) AS tf FROM (SELECT {keys}, unnest(string_split_regex("
            f"lower(coalesce({text}, '')), '[ \\n]+')) AS token FROM {src}) WHERE token <> '' GROUP BY ALL")


CTES["cand_tf"] = tf_cte("candidates", "candidate_ord, product_id", "marketing_text")
CTES["cand_norm"] = "SELECT candidate_ord, sum(tf * tf) AS n2 FROM cand_tf GROUP BY candidate_ord"
CTES["attr_tf"] = tf_cte("products", "product_id", "attribute_text")
CTES["gold_tf"] = tf_cte("benchmark", "item_id", "text")
CTES["gold_pair"] = """
SELECT c.candidate_ord, g.item_id AS gold_id FROM candidates c
JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark) g
  ON c.candidate_ord % g.n = g.place"""
CTES["gold_norm"] = "SELECT item_id, sum(tf * tf) AS n2 FROM gold_tf GROUP BY item_id"


def cos(dot: str, a: str, b: str) -> str:
    return (f"coalesce(CASE WHEN {a} > 0 AND {b} > 0 THEN CAST({dot} AS DOUBLE) / "
            f"(sqrt(CAST({a} AS DOUBLE)) * sqrt(CAST({b} AS DOUBLE))) END, 0.0)")


CTES["cov_counts"] = f"""
SELECT c.candidate_ord, CAST(coalesce(len(p.combined), 0) AS BIGINT) AS n_features,
       CAST(coalesce(cv.n_cov, 0) AS BIGINT) AS n_covered
FROM candidates c LEFT JOIN products p ON p.product_id = c.product_id
LEFT JOIN (
  SELECT candidate_ord, count(*) FILTER (WHERE sim >= 0.10) AS n_cov FROM (
    SELECT f.candidate_ord, f.pos, {cos('sum(ct.tf * ft.tf)', 'any_value(cn.n2)', 'any_value(fn.n2)')} AS sim
    FROM (SELECT c.candidate_ord, unnest(generate_series(1, len(p.combined))) AS pos, unnest(p.combined) AS feature
          FROM candidates c JOIN products p ON p.product_id = c.product_id) f
    JOIN ({tf_cte('(SELECT DISTINCT unnest(combined) AS feature FROM products)', 'feature', 'feature')}) ft ON ft.feature = f.feature
    JOIN cand_tf ct ON ct.candidate_ord = f.candidate_ord AND ct.token = ft.token
    JOIN cand_norm cn ON cn.candidate_ord = f.candidate_ord
    JOIN (SELECT feature, sum(tf * tf) AS n2 FROM ({tf_cte('(SELECT DISTINCT unnest(combined) AS feature FROM products)', 'feature', 'feature')}) GROUP BY feature) fn ON fn.feature = f.feature
    GROUP BY f.candidate_ord, f.pos) GROUP BY candidate_ord) cv ON cv.candidate_ord = c.candidate_ord"""


def needed(sql: str) -> list[str]:
    """CTE names referenced by ``sql``, dependencies first."""
    order: list[str] = []
    active: set[str] = set()

    def visit(text: str):
        for name in CTES:
            if name in order or name in active or not re.search(rf"\b{name}\b", text):
                continue
            active.add(name)
            visit(CTES[name])
            active.discard(name)
            order.append(name)
    visit(sql)
    return order


def with_ctes(sql: str) -> str:
    names = needed(sql)
    if not names:
        return sql
    body = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    head = sql.lstrip()
    if head[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {body},\n{head[14:]}"
    if head[:4].upper() == "WITH":
        return f"WITH {body},\n{head[4:]}"
    return f"WITH {body}\n{sql}"


# --- queries ------------------------------------------------------------------------

def _rej(threshold: float, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""
    SELECT {k}reason, CAST(count(*) AS BIGINT) AS count FROM (
        SELECT {k}unnest(labels) AS reason FROM results WHERE overall_score < {threshold}) GROUP BY ALL"""


def _initcap(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
            f"lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ')")


Q: dict[str, str] = {}

Q["length_compliance"] = """
SELECT iteration, model, CAST(count(*) AS BIGINT) AS n_texts,
       CAST(count(*) FILTER (WHERE char_len BETWEEN 450 AND 600) AS BIGINT) AS n_in_range,
       round(avg(CAST(char_len BETWEEN 450 AND 600 AS INTEGER)), 6) AS compliance_rate,
       round(avg(char_len), 6) AS avg_char_len
FROM candidates GROUP BY iteration, model"""

Q["overall_score"] = "SELECT candidate_ord, round(overall_score, 6) AS overall_score FROM results"
Q["quality_gates"] = "SELECT candidate_ord, passed_quality_gates, gate_failure_reason FROM results"
Q["rejection_labels"] = "SELECT candidate_ord, rejection_reasons FROM results"

Q["rejection_patterns"] = f"""
SELECT p.reason, {_initcap('p.reason')} AS reason_display, p.count,
       round(p.count * 100.0 / t.rejected, 6) AS pct_of_rejected
FROM ({_rej(7.0)}) p, (SELECT CAST(count(*) AS BIGINT) AS rejected FROM results WHERE overall_score < 7.0) t"""

Q["rejection_totals"] = """
SELECT total, rejected, total - rejected AS approved,
       round(rejected * 100.0 / total, 6) AS rejected_pct, round((total - rejected) * 100.0 / total, 6) AS approved_pct
FROM (SELECT CAST(count(*) AS BIGINT) AS total,
             CAST(count(*) FILTER (WHERE overall_score < 7.0) AS BIGINT) AS rejected FROM results)"""

Q["top_issues"] = f"""
SELECT iteration, CAST(rank AS INTEGER) AS rank, reason, count, round(count * 100.0 / n, 6) AS pct_of_all
FROM (SELECT p.*, row_number() OVER (PARTITION BY p.iteration ORDER BY p.count DESC, p.reason) AS rank, a.n
      FROM ({_rej(7.5, 'iteration')}) p JOIN (SELECT iteration, count(*) AS n FROM results GROUP BY iteration) a
      USING (iteration))
WHERE rank <= 3"""

Q["quality_summary"] = f"""
SELECT t.total_outputs, t.rejected_count, round(CAST(t.rejected_count AS DOUBLE) / t.total_outputs, 6) AS rejection_rate,
       p.top_issue, CAST(p.top_issue_count AS BIGINT) AS top_issue_count, p.all_patterns
FROM (SELECT CAST(count(*) AS BIGINT) AS total_outputs,
             CAST(count(*) FILTER (WHERE overall_score < 7.0) AS BIGINT) AS rejected_count FROM results) t,
     (SELECT arg_max(reason, count * 100000 - rk) AS top_issue, max(count) AS top_issue_count,
             array_to_string(list_sort(list(reason || ':' || CAST(count AS VARCHAR))), ',') AS all_patterns
      FROM (SELECT *, row_number() OVER (ORDER BY count DESC, reason) AS rk FROM ({_rej(7.0)}))) p"""

Q["worst_example"] = """
SELECT candidate_ord, product_id, round(overall_score, 6) AS overall_score, round(judge_score, 6) AS judge_score,
       round(relevance_score, 6) AS relevance_score, round(hallucination_score, 6) AS hallucination_score,
       array_to_string(labels, ', ') AS reasons, substring(judge_reason, 1, 150) AS feedback
FROM results WHERE overall_score < 7.0 ORDER BY overall_score, candidate_ord LIMIT 1"""

_AGG_COLS = ["overall_score", "char_len", "sbert", "judge_score", "relevance_score", "generalization_score",
             "judge_score_secondary", "relevance_score_secondary", "generalization_score_secondary",
             "hallucination_score"]
Q["aggregate_by_run"] = ("SELECT iteration, model, prompt_name, "
                         + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _AGG_COLS)
                         + ", round(avg(CAST(has_hallucination AS INTEGER)), 6) AS hallucination_rate, "
                         + ", ".join(f"round(avg({c}), 6) AS {c}" for c in
                                     ["semantic_feature_coverage", "semantic_feature_coverage_normalized",
                                      "semantic_attribute_alignment"])
                         + " FROM results GROUP BY iteration, model, prompt_name")

Q["iteration_progress"] = """
SELECT iteration, round(avg(overall_score), 6) AS mean_score,
       round(avg(CAST(overall_score >= 8.0 AS INTEGER)), 6) AS pass_rate
FROM results GROUP BY iteration ORDER BY iteration"""

_FLAGS = """
coalesce(NOT in_range, false) AS fail_char_range,
coalesce(semantic_feature_coverage_normalized < 0.75, false) AS fail_feature,
coalesce(has_hallucination = true, false) AS fail_grounding,
false AS fail_prohibited,
coalesce(is_unique = false, false) AS fail_unique"""
_RULES = ["fail_char_range", "fail_feature", "fail_grounding", "fail_prohibited", "fail_unique"]


def _failure(src: str, keys: str) -> str:
    parts = [f"SELECT {keys}, '{r}' AS rule, round(avg(CAST({r} AS INTEGER)) * 100.0, 6) AS failure_rate_pct "
             f"FROM (SELECT *, {_FLAGS} FROM {src}) GROUP BY {keys}" for r in _RULES]
    return " UNION ALL ".join(parts)


Q["failure_rates"] = _failure("scored", "model")
Q["two_run_compare"] = _failure("two_runs", "dataset, model")

Q["score_box"] = """
WITH long AS (
  SELECT iteration, model, 'overall_score' AS metric, CAST(overall_score AS DOUBLE) AS value FROM results
  UNION ALL SELECT iteration, model, 'sbert', CAST(sbert AS DOUBLE) FROM results),
st AS (
  SELECT iteration, model, metric, CAST(count(*) AS BIGINT) AS n, quantile_cont(value, 0.25) AS q1,
         quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM long WHERE value IS NOT NULL GROUP BY ALL),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM st)
SELECT f.iteration, f.model, f.metric, f.n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(min(l.value) FILTER (WHERE l.value >= f.lo AND l.value <= f.hi), 6) AS whisker_lo,
       round(max(l.value) FILTER (WHERE l.value >= f.lo AND l.value <= f.hi), 6) AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT (l.value >= f.lo AND l.value <= f.hi)) AS BIGINT) AS n_outliers
FROM f JOIN long l ON l.iteration = f.iteration AND l.model = f.model AND l.metric = f.metric AND l.value IS NOT NULL
GROUP BY f.iteration, f.model, f.metric, f.n, f.q1, f.median, f.q3"""

Q["length_histogram"] = """
WITH r AS (SELECT iteration, model, CAST(min(char_len) AS BIGINT) AS mn, CAST(max(char_len) AS BIGINT) AS mx
           FROM candidates GROUP BY iteration, model),
b AS (SELECT c.iteration, c.model,
             CASE WHEN r.mx = r.mn THEN 10 ELSE least(CAST(floor((c.char_len - r.mn) * 20 / (r.mx - r.mn)) AS INTEGER), 19) END AS bin
      FROM candidates c JOIN r USING (iteration, model)),
cnt AS (SELECT iteration, model, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT r.*, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM r)
SELECT g.iteration, g.model, g.bin,
       round(CASE WHEN mx = mn THEN mn - 0.5 ELSE CAST(mn AS DOUBLE) END
             + g.bin * ((CASE WHEN mx = mn THEN mx + 0.5 ELSE CAST(mx AS DOUBLE) END - CASE WHEN mx = mn THEN mn - 0.5 ELSE CAST(mn AS DOUBLE) END) / 20), 6) AS bin_lo,
       round(CASE WHEN mx = mn THEN mn - 0.5 ELSE CAST(mn AS DOUBLE) END
             + (g.bin + 1) * ((CASE WHEN mx = mn THEN mx + 0.5 ELSE CAST(mx AS DOUBLE) END - CASE WHEN mx = mn THEN mn - 0.5 ELSE CAST(mn AS DOUBLE) END) / 20), 6) AS bin_hi,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN cnt USING (iteration, model, bin)"""

Q["score_curve"] = """
SELECT dataset, model, iteration, round(avg(overall_score), 6) AS mean_overall_score
FROM two_runs_overall GROUP BY dataset, model, iteration"""

Q["coverage_trend"] = """
SELECT model, iteration, round(avg(semantic_feature_coverage_normalized), 6) AS mean_coverage_normalized
FROM scored GROUP BY model, iteration"""

Q["parse_replies"] = "SELECT candidate_ord, kind, status FROM parsed"

_VALID = ("(status = 'ok' AND json_type(j, '$.header') IS NOT NULL AND json_type(j, '$.subheader') IS NOT NULL "
          "AND json_type(j, '$.marketing_text') IS NOT NULL)")

Q["reply_success_rate"] = f"""
SELECT iteration, model, CAST(count(*) AS BIGINT) AS tasks, CAST(count(*) FILTER (WHERE {_VALID}) AS BIGINT) AS valid,
       round(CAST(count(*) FILTER (WHERE {_VALID}) AS DOUBLE) / count(*), 6) AS success_rate
FROM parsed WHERE kind = 'generation' GROUP BY iteration, model"""

Q["generation_candidates"] = f"""
SELECT candidate_ord, json_extract_string(j, '$.header') AS header, json_extract_string(j, '$.subheader') AS subheader,
       json_extract_string(j, '$.marketing_text') AS marketing_text
FROM parsed WHERE kind = 'generation' AND {_VALID}"""

Q["judge_defaults"] = """
SELECT candidate_ord,
       CASE WHEN status = 'ok' THEN TRY_CAST(json_extract(j, '$.overall_score') AS DOUBLE) END AS judge_score,
       CASE WHEN status = 'ok' THEN TRY_CAST(json_extract(j, '$.relevance_score') AS DOUBLE) END AS relevance_score,
       CASE WHEN status = 'ok' THEN TRY_CAST(json_extract(j, '$.generalization_score') AS DOUBLE) END AS generalization_score,
       CASE WHEN status = 'no_reply' THEN 'API error' WHEN status <> 'ok' THEN 'Parse error'
            WHEN json_type(j, '$.reason') IS NOT NULL THEN json_extract_string(j, '$.reason') ELSE '' END AS judge_reason
FROM parsed WHERE kind = 'judge'"""

Q["factcheck_defaults"] = """
SELECT candidate_ord,
       CASE WHEN status = 'ok' THEN TRY_CAST(json_extract(j, '$.has_hallucination') AS BOOLEAN) ELSE false END AS has_hallucination,
       CASE WHEN status <> 'ok' THEN 10.0 WHEN json_type(j, '$.hallucination_score') IS NOT NULL
            THEN TRY_CAST(json_extract(j, '$.hallucination_score') AS DOUBLE) ELSE 10.0 END AS hallucination_score,
       CAST(CASE WHEN status = 'ok' AND json_type(j, '$.hallucinated_claims') IS NOT NULL
                 THEN json_array_length(j, '$.hallucinated_claims') ELSE 0 END AS BIGINT) AS n_claims,
       CASE WHEN status = 'ok' THEN json_extract_string(j, '$.hallucinated_claims[0].claim') END AS first_claim,
       CASE WHEN status = 'no_reply' THEN 'API error' WHEN status <> 'ok' THEN 'Parse error'
            WHEN json_type(j, '$.explanation') IS NOT NULL THEN json_extract_string(j, '$.explanation') ELSE '' END AS explanation
FROM parsed WHERE kind = 'factcheck'"""

Q["normalize_products"] = """
SELECT product_id, name, series, CAST(len(features) AS BIGINT) AS n_features,
       array_to_string(features, ' | ') AS features_text, CAST(len(tech) AS BIGINT) AS n_specs, specs, ibf_data
FROM products"""

Q["merge_features"] = """
SELECT product_id, CAST(pos - 1 AS BIGINT) AS pos, feature
FROM (SELECT product_id, unnest(generate_series(1, len(features))) AS pos, unnest(features) AS feature FROM norm_products)"""

Q["tech_specs"] = """
SELECT product_id, e.key AS spec_key, e.value AS spec_value
FROM (SELECT product_id, unnest(tech) AS e FROM norm_products)"""

Q["specs_text"] = """
SELECT product_id, array_to_string(list_transform(tech, lambda e: e.key || ': ' || e.value), ', ') AS specs
FROM norm_products"""

Q["descriptor_blocks"] = "SELECT asset_name, ibf_block FROM blocks"
Q["enrich_products"] = "SELECT product_id, ibf_match, ibf_data FROM enriched"
Q["enrich_match_rate"] = """
SELECT CAST(count(*) FILTER (WHERE ibf_data <> '') AS BIGINT) AS matched, CAST(count(*) AS BIGINT) AS total,
       round(CAST(count(*) FILTER (WHERE ibf_data <> '') AS DOUBLE) / count(*), 6) AS match_rate
FROM enriched"""

Q["prompt_tasks"] = """
SELECT p.product_id, t.prompt_family, t.prompt_family || '_iter0' AS prompt_name, m.model
FROM products p, (VALUES ('prompt'), ('prompt2')) t(prompt_family), (VALUES ('model_a'), ('model_b')) m(model)"""

_TPL1 = ("'Write a product text for {name} ({series}).' || chr(10) || 'Features: {features}' || chr(10) || "
         "'Specs: {specs}' || chr(10) || '{ibf_data}' || chr(10) || "
         "'Answer as JSON with {header}, {subheader} and {{marketing_text}}.'")
_TPL2 = "'Describe {name} of the {series} range in 450 to 600 characters. Use: {features}; {specs}.'"


def _render(tpl: str) -> str:
    out = tpl
    for k, v in [("name", "coalesce(name, '')"), ("series", "coalesce(series, '')"),
                 ("features", "coalesce(CAST(to_json(features) AS VARCHAR), '')"),
                 ("specs", "coalesce(specs, '')"), ("ibf_data", "coalesce(ibf_data, '')")]:
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


Q["render_prompt"] = f"""
SELECT product_id, 'prompt' AS prompt_family, {_render(_TPL1)} AS user_prompt FROM products
UNION ALL SELECT product_id, 'prompt2', {_render(_TPL2)} FROM products"""

Q["attribute_text"] = "SELECT product_id, attribute_text FROM products"
Q["combined_features"] = """
SELECT product_id, CAST(len(combined) AS BIGINT) AS n_combined, array_to_string(combined, ' | ') AS combined_text
FROM products"""

Q["attribute_alignment"] = f"""
SELECT c.candidate_ord,
       round({cos('coalesce(dt.dot, 0)', 'coalesce(cn.n2, 0)', 'coalesce(an.n2, 0)')}, 6) AS semantic_attribute_alignment
FROM candidates c
LEFT JOIN cand_norm cn ON cn.candidate_ord = c.candidate_ord
LEFT JOIN (SELECT product_id, sum(tf * tf) AS n2 FROM attr_tf GROUP BY product_id) an ON an.product_id = c.product_id
LEFT JOIN (SELECT ct.candidate_ord, sum(ct.tf * atf.tf) AS dot FROM cand_tf ct
           JOIN attr_tf atf ON atf.product_id = ct.product_id AND atf.token = ct.token GROUP BY ct.candidate_ord) dt
       ON dt.candidate_ord = c.candidate_ord"""

Q["paired_gold_similarity"] = f"""
SELECT c.candidate_ord,
       round({cos('coalesce(dt.dot, 0)', 'coalesce(cn.n2, 0)', 'coalesce(gn.n2, 0)')}, 6) AS semantic_similarity_gold
FROM candidates c
LEFT JOIN cand_norm cn ON cn.candidate_ord = c.candidate_ord
LEFT JOIN gold_pair gp ON gp.candidate_ord = c.candidate_ord
LEFT JOIN gold_norm gn ON gn.item_id = gp.gold_id
LEFT JOIN (SELECT ct.candidate_ord, sum(ct.tf * gt.tf) AS dot FROM cand_tf ct
           JOIN gold_pair gq ON gq.candidate_ord = ct.candidate_ord
           JOIN gold_tf gt ON gt.item_id = gq.gold_id AND gt.token = ct.token GROUP BY ct.candidate_ord) dt
       ON dt.candidate_ord = c.candidate_ord"""

Q["max_gold_similarity"] = f"""
SELECT c.candidate_ord, round(coalesce(b.best, 0.0), 6) AS sbert
FROM candidates c LEFT JOIN (
  SELECT d.candidate_ord, max({cos('d.dot', 'cn.n2', 'gn.n2')}) AS best
  FROM (SELECT ct.candidate_ord, gt.item_id, sum(ct.tf * gt.tf) AS dot FROM cand_tf ct
        JOIN gold_tf gt ON gt.token = ct.token GROUP BY ct.candidate_ord, gt.item_id) d
  JOIN cand_norm cn ON cn.candidate_ord = d.candidate_ord JOIN gold_norm gn ON gn.item_id = d.item_id
  GROUP BY d.candidate_ord) b ON b.candidate_ord = c.candidate_ord"""

Q["feature_coverage"] = """
SELECT candidate_ord, n_features, n_covered,
       round(CASE WHEN n_features > 0 THEN CAST(n_covered AS DOUBLE) / n_features ELSE 0.0 END, 6) AS semantic_feature_coverage
FROM cov_counts"""

Q["coverage_normalized"] = f"""
SELECT candidate_ord, n_features, round(cov, 6) AS semantic_feature_coverage,
       round({norm_cov('cov', 'n_features')}, 6) AS semantic_feature_coverage_normalized
FROM (SELECT *, CASE WHEN n_features > 0 THEN CAST(n_covered AS DOUBLE) / n_features ELSE 0.0 END AS cov FROM cov_counts)"""

Q["vector_cosine_topk"] = """
WITH e AS (
  SELECT vec_id, label, list_transform(v, lambda x: x / nrm) AS v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
           sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm
    FROM embeddings)),
dims AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM e),
cent AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM dims GROUP BY label, i) GROUP BY label),
s AS (SELECT e.label, e.vec_id,
             list_sum(list_transform(list_zip(e.v, cent.c), lambda p: p[1] * p[2]))
             / (sqrt(list_sum(list_transform(e.v, lambda x: x * x))) * sqrt(list_sum(list_transform(cent.c, lambda x: x * x)))) AS cosine
      FROM e JOIN cent USING (label))
SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, round(cosine, 6) AS cosine
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

Q["series_gold_last"] = r"""
SELECT series, arg_max(marketing_text, ord) AS marketing_text FROM (
  SELECT regexp_replace(' Brand#' || CAST(item_id % 7 + 1 AS VARCHAR), '^\s+|\s+$', '', 'g') AS series,
         regexp_replace(CASE WHEN item_id % 6 = 5 THEN '   ' ELSE '  ' || text END, '^\s+|\s+$', '', 'g') AS marketing_text,
         item_id AS ord FROM benchmark)
WHERE marketing_text IS NOT NULL AND marketing_text <> '' GROUP BY series"""


def _tf(b: str) -> str:
    return f"CASE WHEN {b} THEN 'TRUE' WHEN NOT {b} THEN 'FALSE' END"


Q["bool_export"] = f"""
SELECT candidate_ord, {_tf('in_range')} AS in_range, {_tf('has_hallucination')} AS has_hallucination,
       {_tf('passed_quality_gates')} AS passed_quality_gates, {_tf('is_unique')} AS is_unique FROM results"""

CTES["pmeans"] = """
SELECT iteration, prompt_family,
       coalesce(avg(judge_score), 0.0) AS avg_score, coalesce(avg(relevance_score), 0.0) AS avg_relevance,
       coalesce(avg(generalization_score), 0.0) AS avg_generalization, coalesce(avg(char_len), 0.0) AS avg_length,
       coalesce(avg(hallucination_score), 0.0) AS avg_hallucination_score,
       coalesce(avg(semantic_attribute_alignment), 0.0) AS avg_attribute_alignment,
       coalesce(avg(semantic_feature_coverage_normalized), 0.0) AS avg_feature_coverage,
       coalesce(avg(overall_score), 0.0) AS avg_overall_composite,
       coalesce(avg(semantic_feature_coverage * num_features), 0.0) AS avg_features,
       CAST(count(*) AS BIGINT) AS sample_size,
       arg_max(product_id, (overall_score, -candidate_ord)) AS best_product_id,
       arg_max(overall_score, (overall_score, -candidate_ord)) AS best_score,
       arg_max(char_len, (overall_score, -candidate_ord)) AS best_length,
       arg_max(model, (overall_score, -candidate_ord)) AS best_model
FROM results GROUP BY iteration, prompt_family"""

_AVGS = ["avg_score", "avg_relevance", "avg_generalization", "avg_length", "avg_hallucination_score",
         "avg_attribute_alignment", "avg_feature_coverage", "avg_overall_composite", "avg_features"]
Q["prompt_means"] = ("SELECT iteration, prompt_family, " + ", ".join(f"round({c}, 6) AS {c}" for c in _AVGS)
                     + ", sample_size FROM pmeans")
Q["best_example"] = """
SELECT iteration, prompt_family, best_product_id AS product_id, round(best_score, 6) AS score,
       best_length AS length, best_model AS model FROM pmeans"""

CTES["issues"] = """
SELECT iteration, prompt_family, list_filter([
  CASE WHEN avg_score < 8.5 THEN 'Average score ' || printf('%.1f', avg_score) || ' below threshold 8.5' END,
  CASE WHEN avg_length < 450 THEN 'Texts too short (avg ' || printf('%.0f', avg_length) || ' chars)' END,
  CASE WHEN avg_length > 600 THEN 'Texts too long (avg ' || printf('%.0f', avg_length) || ' chars)' END,
  CASE WHEN avg_features < 3 THEN 'Not enough features (avg ' || printf('%.1f', avg_features) || ')' END,
  CASE WHEN avg_hallucination_score < 8.0 THEN 'High hallucination rate (' || printf('%.1f', avg_hallucination_score) || '/10)' END,
  CASE WHEN avg_attribute_alignment < 0.50 THEN 'Low attribute alignment (' || printf('%.3f', avg_attribute_alignment) || ')' END,
  CASE WHEN avg_feature_coverage < 0.70 THEN 'Low feature coverage (' || printf('%.3f', avg_feature_coverage) || ')' END
  ], lambda x: x IS NOT NULL) AS issues, pmeans.*
FROM pmeans"""

Q["issue_report"] = """
SELECT iteration, prompt_family, CAST(issue_pos - 1 AS BIGINT) AS issue_pos, issue FROM (
  SELECT iteration, prompt_family, unnest(generate_series(1, len(issues))) AS issue_pos, unnest(issues) AS issue
  FROM issues)"""

Q["improvement_history"] = """
SELECT iteration, prompt_family, round(avg_score, 3) AS avg_score, round(avg_relevance, 3) AS avg_relevance,
       round(avg_generalization, 3) AS avg_generalization, round(avg_length, 3) AS avg_length,
       round(avg_hallucination_score, 3) AS avg_hallucination_score,
       round(avg_attribute_alignment, 3) AS avg_attribute_alignment,
       round(avg_feature_coverage, 3) AS avg_feature_coverage, round(avg_overall_composite, 3) AS avg_overall_composite,
       round(avg_features, 3) AS avg_features, sample_size, round(best_score, 3) AS best_score,
       array_to_string(issues, ' | ') AS issues
FROM issues"""

_REC_CASE = "CASE top_reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RECOMMENDATIONS.items()) + " END"

Q["recommendations"] = f"""
SELECT iteration, prompt_family, rejected, sample_size, top_reasons, top_counts, top_percentages, top_reason, {_REC_CASE} AS recommendation
FROM (
  SELECT s.iteration, s.prompt_family, s.rejected, s.sample_size,
         array_to_string(list(t.reason ORDER BY t.rk), ', ') AS top_reasons,
         array_to_string(list(CAST(t.count AS VARCHAR) ORDER BY t.rk), ', ') AS top_counts,
         array_to_string(list(printf('%.0f', t.count * 100.0 / s.rejected) || '%' ORDER BY t.rk), ', ') AS top_percentages,
         arg_min(t.reason, t.rk) AS top_reason
  FROM (SELECT iteration, prompt_family, CAST(count(*) AS BIGINT) AS sample_size,
               CAST(count(*) FILTER (WHERE overall_score < 7.5) AS BIGINT) AS rejected
        FROM results GROUP BY iteration, prompt_family) s
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY iteration, prompt_family ORDER BY count DESC, reason) AS rk
             FROM ({_rej(7.5, 'iteration, prompt_family')})) t
    ON t.iteration = s.iteration AND t.prompt_family = s.prompt_family AND t.rk <= 3
  GROUP BY s.iteration, s.prompt_family, s.rejected, s.sample_size)"""

Q["quality_report"] = """
SELECT CAST(count(*) AS BIGINT) AS total_samples, round(avg(sbert), 6) AS avg_gold_similarity,
       round(avg(semantic_attribute_alignment), 6) AS avg_attribute_alignment,
       round(avg(semantic_feature_coverage), 6) AS avg_feature_coverage,
       round(avg(CAST(is_unique AS INTEGER)), 6) AS uniqueness_rate,
       CAST(count(*) FILTER (WHERE NOT is_unique) AS BIGINT) AS duplicate_count
FROM scored"""


# --- duplicate detection: brute-force edges + a recursive walk in row order ---------

def dedup_sql(threshold: float, partitioned: bool) -> str:
    part = "iteration" if partitioned else "0"
    return f"""
WITH RECURSIVE
b AS (SELECT candidate_ord AS ord, product_id AS label, {part} AS part, marketing_text AS text FROM candidates),
tk AS (SELECT ord, part, token, count(*) AS tf FROM (
         SELECT ord, part, unnest(string_split_regex(lower(coalesce(text, '')), '[ \\n]+')) AS token FROM b)
       WHERE token <> '' GROUP BY ALL),
nn AS (SELECT b.ord, b.part, b.label, count(tk.token) AS n, coalesce(sum(tk.tf * tk.tf), 0) AS n2,
              coalesce(string_agg(tk.token, ' ' ORDER BY tk.token), '') AS wset
       FROM b LEFT JOIN tk ON tk.ord = b.ord GROUP BY b.ord, b.part, b.label),
eq AS (SELECT x.ord AS i, y.ord AS j, CAST(1.0 AS DOUBLE) AS sim FROM nn x JOIN nn y
       ON x.part = y.part AND x.wset = y.wset AND x.ord < y.ord),
sh AS (SELECT x.ord AS i, y.ord AS j, count(*) AS inter, sum(x.tf * y.tf) AS dot
       FROM tk x JOIN tk y ON x.token = y.token AND x.part = y.part AND x.ord < y.ord GROUP BY x.ord, y.ord),
sem AS (SELECT sh.i, sh.j, CAST(sh.dot AS DOUBLE) / (sqrt(CAST(a.n2 AS DOUBLE)) * sqrt(CAST(c.n2 AS DOUBLE))) AS sim
        FROM sh JOIN nn a ON a.ord = sh.i JOIN nn c ON c.ord = sh.j
        WHERE a.wset <> c.wset AND sh.inter * 20 >= greatest(a.n, 1) * 19
          AND CAST(sh.dot AS DOUBLE) / (sqrt(CAST(a.n2 AS DOUBLE)) * sqrt(CAST(c.n2 AS DOUBLE))) >= {threshold}),
edges AS (SELECT * FROM eq UNION ALL SELECT * FROM sem),
inn AS (SELECT j AS ord, list(i) AS ins FROM edges GROUP BY j),
v AS (SELECT ord, row_number() OVER (ORDER BY ord) AS rn, coalesce(inn.ins, []) AS ins
      FROM (SELECT i AS ord FROM edges UNION SELECT j FROM edges) LEFT JOIN inn USING (ord)),
walk(rn, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.rn + 1, CASE WHEN len(list_intersect(w.kept, v.ins)) > 0 THEN w.kept ELSE list_append(w.kept, v.ord) END
  FROM walk w JOIN v ON v.rn = w.rn + 1),
fin AS (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1),
best AS (SELECT e.j AS ord, min(e.i) AS di, arg_min(e.sim, e.i) AS dsim
         FROM edges e, fin WHERE list_contains(fin.kept, e.i) GROUP BY e.j)
SELECT {'b.part AS iteration, ' if partitioned else ''}b.ord AS candidate_ord, best.ord IS NULL AS is_unique,
       lab.label AS duplicate_of, best.di AS duplicate_of_candidate,
       round(coalesce(best.dsim, 0.0), 6) AS duplicate_similarity
FROM b LEFT JOIN best ON best.ord = b.ord LEFT JOIN b lab ON lab.ord = best.di"""


Q["unique_texts"] = dedup_sql(0.99, False)
Q["unique_per_iteration"] = dedup_sql(0.95, True)
Q["duplicate_rate"] = f"""
SELECT iteration, round(1.0 - avg(CAST(is_unique AS INTEGER)), 6) AS duplicate_rate
FROM ({dedup_sql(0.95, True)}) GROUP BY iteration"""
Q["lexical_duplicates"] = r"""
SELECT candidate_ord, first_ord, group_size FROM (
  SELECT candidate_ord, min(candidate_ord) OVER (PARTITION BY wset) AS first_ord,
         CAST(count(*) OVER (PARTITION BY wset) AS BIGINT) AS group_size
  FROM (SELECT c.candidate_ord, coalesce((SELECT string_agg(DISTINCT t, ' ' ORDER BY t)
                 FROM unnest(string_split_regex(lower(coalesce(c.marketing_text, '')), '[ \n]+')) u(t) WHERE t <> ''), '') AS wset
        FROM candidates c))
WHERE group_size > 1"""



# --- one iteration end to end (H4) ---------------------------------------------------

CTES["t_replies"] = """
SELECT candidate_ord, product_id, model, iteration, prompt_name, 'generation' AS kind,
       CASE WHEN candidate_ord % 5 = 1 THEN 'Here is my answer:' || chr(10) || body
            WHEN candidate_ord % 5 = 2 THEN body || chr(10) || 'Let me know if you need more.'
            WHEN candidate_ord % 5 = 4 THEN NULL ELSE body END AS raw
FROM (SELECT *, CAST(to_json({'header': 'Header ' || CAST(candidate_ord AS VARCHAR),
                               'subheader': lang || ' ' || source, 'marketing_text': marketing_text}) AS VARCHAR) AS body
      FROM candidates)
UNION ALL
SELECT candidate_ord, product_id, model, iteration, prompt_name, kind, raw FROM replies WHERE kind <> 'generation'"""
CTES["t_repaired"] = CTES["repaired"].replace("FROM replies", "FROM t_replies")
CTES["t_parsed"] = CTES["parsed"].replace("FROM repaired", "FROM t_repaired")

CTES["h_gen"] = f"""
SELECT candidate_ord, iteration, model, product_id, prompt_name,
       json_extract_string(j, '$.marketing_text') AS marketing_text,
       CAST(length(coalesce(json_extract_string(j, '$.marketing_text'), '')) AS INTEGER) AS char_len
FROM t_parsed WHERE kind = 'generation' AND {_VALID}"""
CTES["h_judge"] = Q["judge_defaults"].replace("FROM parsed", "FROM t_parsed")
CTES["h_fact"] = Q["factcheck_defaults"].replace("FROM parsed", "FROM t_parsed")
CTES["h_tf"] = tf_cte("h_gen", "candidate_ord, product_id", "marketing_text")
CTES["h_norm"] = "SELECT candidate_ord, sum(tf * tf) AS n2 FROM h_tf GROUP BY candidate_ord"
CTES["h_align"] = f"""
SELECT c.candidate_ord, {cos('coalesce(dt.dot, 0)', 'coalesce(cn.n2, 0)', 'coalesce(an.n2, 0)')} AS align
FROM h_gen c
LEFT JOIN h_norm cn ON cn.candidate_ord = c.candidate_ord
LEFT JOIN (SELECT product_id, sum(tf * tf) AS n2 FROM attr_tf GROUP BY product_id) an ON an.product_id = c.product_id
LEFT JOIN (SELECT ct.candidate_ord, sum(ct.tf * atf.tf) AS dot FROM h_tf ct
           JOIN attr_tf atf ON atf.product_id = ct.product_id AND atf.token = ct.token GROUP BY ct.candidate_ord) dt
       ON dt.candidate_ord = c.candidate_ord"""
CTES["h_cov"] = (CTES["cov_counts"].replace("FROM candidates c", "FROM h_gen c")
                 .replace("JOIN cand_tf ct", "JOIN h_tf ct").replace("JOIN cand_norm cn", "JOIN h_norm cn"))
CTES["h_sbert"] = Q["max_gold_similarity"].replace("FROM candidates c", "FROM h_gen c") \
    .replace("FROM cand_tf ct", "FROM h_tf ct").replace("JOIN cand_norm cn", "JOIN h_norm cn")
CTES["h_rows"] = f"""
SELECT g.*, g.char_len BETWEEN 450 AND 600 AS in_range,
       j.judge_score, j.relevance_score, j.generalization_score,
       CASE WHEN j.candidate_ord IS NULL THEN '' ELSE j.judge_reason END AS judge_reason,
       f.has_hallucination, CASE WHEN f.candidate_ord IS NULL THEN 10.0 ELSE f.hallucination_score END AS hallucination_score,
       al.align AS semantic_attribute_alignment,
       CASE WHEN cv.n_features > 0 THEN CAST(cv.n_covered AS DOUBLE) / cv.n_features ELSE 0.0 END AS semantic_feature_coverage,
       cv.n_features AS num_features, sb.sbert
FROM h_gen g
LEFT JOIN h_judge j ON j.candidate_ord = g.candidate_ord
LEFT JOIN h_fact f ON f.candidate_ord = g.candidate_ord
LEFT JOIN h_align al ON al.candidate_ord = g.candidate_ord
LEFT JOIN h_cov cv ON cv.candidate_ord = g.candidate_ord
LEFT JOIN h_sbert sb ON sb.candidate_ord = g.candidate_ord"""
CTES["h_scored"] = f"""
SELECT *, {norm_cov('semantic_feature_coverage', 'num_features')} AS semantic_feature_coverage_normalized FROM h_rows"""
CTES["h_overall"] = _OV.format(src="h_scored")
CTES["h_results"] = CTES["results"].replace("FROM overall)", "FROM h_overall)")

Q["iteration_results"] = """
SELECT candidate_ord, iteration, model, product_id, prompt_name, char_len, in_range, judge_reason, has_hallucination,
       round(judge_score, 6) AS judge_score, round(relevance_score, 6) AS relevance_score,
       round(generalization_score, 6) AS generalization_score, round(hallucination_score, 6) AS hallucination_score,
       round(semantic_attribute_alignment, 6) AS semantic_attribute_alignment,
       round(semantic_feature_coverage, 6) AS semantic_feature_coverage,
       round(semantic_feature_coverage_normalized, 6) AS semantic_feature_coverage_normalized,
       round(sbert, 6) AS sbert, round(overall_score, 6) AS overall_score,
       passed_quality_gates, gate_failure_reason, rejection_reasons
FROM h_results"""


Q["evaluate_texts"] = f"""
SELECT al.candidate_ord, al.semantic_attribute_alignment, pg.semantic_similarity_gold,
       fc.semantic_feature_coverage, fc.n_features AS num_features,
       ut.is_unique, ut.duplicate_of_candidate, ut.duplicate_similarity
FROM ({Q["attribute_alignment"]}) al
JOIN ({Q["paired_gold_similarity"]}) pg ON pg.candidate_ord = al.candidate_ord
JOIN ({Q["feature_coverage"]}) fc ON fc.candidate_ord = al.candidate_ord
JOIN ({dedup_sql(0.99, False)}) ut ON ut.candidate_ord = al.candidate_ord"""


# --- readers, sinks and report sets ----------------------------------------------------

Q["load_counts"] = """
SELECT 'products' AS name, CAST(count(*) AS BIGINT) AS rows FROM part
UNION ALL SELECT 'descriptors', count(*) FROM benchmark
UNION ALL SELECT 'gold', count(*) FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT 'series_gold', 0"""
Q["generated_ids"] = """
SELECT printf('prod_%04d', row_number() OVER (ORDER BY p_partkey)) AS product_id, p_name AS name FROM part"""
Q["series_gold_file_order"] = Q["series_gold_last"]
Q["standard_products"] = """
SELECT product_id, CAST(len(features) AS BIGINT) AS n_features, array_to_string(features, ' | ') AS features_text
FROM products"""
Q["list_features"] = """
SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE 1 END AS BIGINT) AS n,
       CASE doc_id % 4 WHEN 0 THEN 'it''s ' || lang || ' | ' || source || ' | 7' WHEN 1 THEN lang WHEN 2 THEN '[' || lang
       ELSE '' END AS features
FROM documents"""
Q["nan_scores"] = """
SELECT candidate_ord, CASE WHEN candidate_ord % 4 = 2 THEN 8.5::DOUBLE END AS judge_score,
       round(CASE WHEN candidate_ord % 4 = 2 THEN 8.85::DOUBLE ELSE 4.6::DOUBLE END, 6) AS overall_score,
       candidate_ord % 4 = 2 AS passed_quality_gates
FROM candidates"""
_MEANS_SQL = "CAST(count(*) AS BIGINT) AS n, round(avg(overall_score), 6) AS mean_score"
Q["written_runs"] = f"""
SELECT CASE WHEN lang = 'en' THEN 'with_reference' ELSE 'without_reference' END AS dataset, iteration, {_MEANS_SQL}
FROM results GROUP BY ALL"""
Q["rewritten_results"] = f"SELECT iteration, {_MEANS_SQL} FROM results WHERE iteration < 2 GROUP BY iteration"
Q["rerun_iteration"] = f"""
SELECT iteration, {_MEANS_SQL} FROM results WHERE iteration <> 1 OR lang = 'en' GROUP BY iteration"""
Q["history_rerun"] = """
SELECT iteration, prompt_family, round(avg_score, 3) AS avg_score, sample_size FROM pmeans"""
Q["aggregate_file"] = Q["aggregate_by_run"]
Q["summary_file"] = "SELECT total_outputs, rejected_count, rejection_rate, top_issue FROM (" + Q["quality_summary"] + ")"
Q["union_iterations"] = """
SELECT iteration, CAST(count(overall_score) AS BIGINT) AS n_scores,
       CAST(count(CASE WHEN iteration % 2 = 1 THEN judge_score END) AS BIGINT) AS n_judged
FROM results GROUP BY iteration"""
Q["prompt_families"] = """
SELECT CASE WHEN model = 'model_a' THEN 'prompt' ELSE 'prompt2' END AS family, CAST(count(*) AS BIGINT) AS n
FROM candidates GROUP BY ALL"""
# --- report sets: a row per cell -----------------------------------------------------

def long_sql(parts: list[tuple[str, str, list[str], list[str], list[str]]]) -> str:
    """(table, SQL, keys, numbers, texts) of each table of a set."""
    out = []
    for name, sql, keys, numbers, texts in parts:
        key = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys) or "''"
        cells = [f"{{'metric': '{c}', 'value': round(CAST({c} AS DOUBLE), 6), 'text': CAST(NULL AS VARCHAR)}}" for c in numbers]
        cells += [f"{{'metric': '{c}', 'value': CAST(NULL AS DOUBLE), 'text': CAST({c} AS VARCHAR)}}" for c in texts]
        out.append(f"SELECT '{name}' AS \"table\", key, c.metric AS metric, c.value AS value, c.text AS text FROM ("
                   f"SELECT {key} AS key, unnest([{', '.join(cells)}]) AS c FROM ({sql}))")
    return " UNION ALL ".join(out)


_BEST = ("best_product_id AS best_example_product_id, best_score AS best_example_score, best_length AS best_example_length, "
         "best_model AS best_example_model")
_BEST_CELLS = ["best_example_score", "best_example_length"], ["best_example_product_id", "best_example_model"]


def _by_dataset(sql: str, source: str) -> str:
    """A table by iteration and model, by dataset as well."""
    for old, new in ((f"FROM {source}", "FROM two_runs_overall"), ("SELECT iteration, model", "SELECT dataset, iteration, model"),
                     ("GROUP BY iteration, model", "GROUP BY dataset, iteration, model"),
                     ("SELECT c.iteration", "SELECT c.dataset, c.iteration"), ("SELECT f.iteration", "SELECT f.dataset, f.iteration"),
                     ("GROUP BY f.iteration", "GROUP BY f.dataset, f.iteration"), ("SELECT g.iteration", "SELECT g.dataset, g.iteration"),
                     ("ON l.iteration", "ON l.dataset = f.dataset AND l.iteration"), ("(iteration, model", "(dataset, iteration, model"),
                     ("SELECT model, iteration", "SELECT dataset, model, iteration"),
                     ("GROUP BY model, iteration", "GROUP BY dataset, model, iteration")):
        sql = sql.replace(old, new)
    return sql


Q["optimisation_report"] = long_sql([
    ("prompt_means", f"SELECT *, {_BEST} FROM pmeans", ["iteration", "prompt_family"],
     [*_AVGS, "sample_size", *_BEST_CELLS[0]], _BEST_CELLS[1]),
    ("improvement_history", "SELECT iteration, prompt_family, sample_size, " + ", ".join(f"round({c}, 3) AS {c}" for c in _AVGS)
     + ", array_to_string(issues, ' | ') AS issues, best_product_id AS best_example_product_id, "
     "round(best_score, 3) AS best_example_score, best_length AS best_example_length, best_model AS best_example_model FROM issues",
     ["iteration", "prompt_family"], [*_AVGS, "sample_size", *_BEST_CELLS[0]], [*_BEST_CELLS[1], "issues"]),
    ("rejection_focus", Q["recommendations"], ["iteration", "prompt_family"], ["rejected", "sample_size"],
     ["top_reasons", "top_counts", "top_percentages", "top_reason", "recommendation"]),
    ("top_issues", Q["top_issues"], ["iteration", "rank"], ["count", "pct_of_all"], ["reason"])])
Q["final_report"] = long_sql([
    ("results", f"SELECT r.iteration, r.candidate_ord, r.overall_score, r.passed_quality_gates, d.is_unique, d.duplicate_of "
     f"FROM results r JOIN ({dedup_sql(0.95, True)}) d USING (iteration, candidate_ord)", ["iteration", "candidate_ord"],
     ["overall_score", "passed_quality_gates", "is_unique"], ["duplicate_of"]),
    ("duplicate_rate", Q["duplicate_rate"], ["iteration"], ["duplicate_rate"], []),
    ("rejection_patterns", Q["rejection_patterns"], ["reason"], ["count", "pct_of_rejected"], ["reason_display"]),
    ("rejection_totals", Q["rejection_totals"], [], ["total", "rejected", "approved", "rejected_pct", "approved_pct"], []),
    ("worst_example", Q["worst_example"], ["candidate_ord"],
     ["overall_score", "judge_score", "relevance_score", "hallucination_score"], ["product_id", "reasons", "feedback"]),
    ("quality_summary", Q["quality_summary"], [], ["total_outputs", "rejected_count", "rejection_rate", "top_issue_count"],
     ["top_issue", "all_patterns"]),
    ("iteration_progress", Q["iteration_progress"], ["iteration"], ["mean_score", "pass_rate"], []),
    ("aggregate", Q["aggregate_by_run"], ["iteration", "model", "prompt_name"],
     [*_AGG_COLS, "hallucination_rate", "semantic_feature_coverage", "semantic_feature_coverage_normalized",
      "semantic_attribute_alignment"], [])])
Q["figure_tables"] = long_sql([
    ("failure_rates", Q["two_run_compare"], ["dataset", "model", "rule"], ["failure_rate_pct"], []),
    ("score_box", _by_dataset(Q["score_box"], "results"), ["dataset", "iteration", "model", "metric"],
     ["n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers"], []),
    ("length_histogram", _by_dataset(Q["length_histogram"], "candidates"), ["dataset", "iteration", "model", "bin"],
     ["bin_lo", "bin_hi", "n"], []),
    ("score_curve", Q["score_curve"], ["dataset", "model", "iteration"], ["mean_overall_score"], []),
    ("coverage_trend", _by_dataset(Q["coverage_trend"], "scored"), ["dataset", "model", "iteration"],
     ["mean_coverage_normalized"], [])])
Q["judge_requests"] = """
SELECT candidate_ord, 'Rate this text (' || CAST(char_len AS VARCHAR) || ' characters, 450 to 600 allowed, in range: '
       || CASE WHEN in_range THEN 'True' ELSE 'False' END || '; alignment ' || printf('%.3f', semantic_attribute_alignment)
       || ', coverage ' || printf('%.3f', semantic_feature_coverage_normalized) || ').' || chr(10) || marketing_text AS request
FROM scored"""
Q["factcheck_requests"] = """
SELECT c.candidate_ord, 'Check every claim against ' || coalesce(p.name, '') || ' (' || coalesce(p.series, '') || ').' || chr(10)
       || 'Features: ' || coalesce(CAST(to_json(p.features) AS VARCHAR), '') || chr(10) || 'Data: ' || coalesce(p.specs, '')
       || chr(10) || c.marketing_text AS request
FROM candidates c LEFT JOIN products p ON p.product_id = c.product_id"""
Q["own_gold_similarity"] = Q["paired_gold_similarity"]
CTES["first_vectors"] = """
SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS ref FROM embeddings GROUP BY label"""
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], f.ref)"
Q["paired_vector_cosine"] = f"SELECT vec_id, round({_COS}, 6) AS cosine FROM embeddings e JOIN first_vectors f USING (label)"
Q["best_vector_reference"] = f"""
SELECT vec_id, round(max({_COS}), 6) AS best FROM embeddings e, first_vectors f GROUP BY vec_id"""


# --- encoders and the scorer hook -----------------------------------------------------

# The small model: words counted in buckets of two hex digits of their MD5.
_BUCKET = "substr(md5(token), 1, 2)"


def hashed(sql: str) -> str:
    """The same measures on the model's vectors: every word becomes its bucket."""
    return with_ctes(sql).replace("token, count(*) AS tf FROM (SELECT", f"{_BUCKET} AS token, count(*) AS tf FROM (SELECT")


def dense_dedup_sql(threshold: float, similarity: str, tables: str) -> str:
    """D1 / D2 whose cosine is ``similarity`` of rows a and c of ``dv``."""
    sql = dedup_sql(threshold, False)
    start, end = sql.index("sem AS ("), sql.index("edges AS (")
    return sql[:start] + f"""{tables},
sem AS (SELECT * FROM (
        SELECT sh.i, sh.j, {similarity} AS sim
        FROM sh JOIN nn x ON x.ord = sh.i JOIN nn y ON y.ord = sh.j
        LEFT JOIN dv a ON a.ord = sh.i LEFT JOIN dv c ON c.ord = sh.j
        WHERE x.wset <> y.wset AND sh.inter * 20 >= greatest(x.n, 1) * 19) WHERE sim >= {threshold}),
""" + sql[end:]


_HASHED_DEDUP = dense_dedup_sql(0.99, "coalesce(list_cosine_similarity(a.v, c.v), 0.0)", f"""
hb AS (SELECT ord, {_BUCKET} AS bkt, CAST(sum(tf) AS DOUBLE) AS n FROM tk GROUP BY ALL),
bk AS (SELECT DISTINCT bkt FROM hb),
dv AS (SELECT o.ord, list(coalesce(hb.n, 0.0) ORDER BY bk.bkt) AS v
       FROM (SELECT DISTINCT ord FROM hb) o CROSS JOIN bk LEFT JOIN hb ON hb.ord = o.ord AND hb.bkt = bk.bkt GROUP BY o.ord)""")
_VECTOR_DEDUP = dense_dedup_sql(0.0, "coalesce(list_cosine_similarity(a.v, c.v), 0.0)", """
tv AS (SELECT text, min(embedding::DOUBLE[]) AS v FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY text),
dv AS (SELECT b.ord, tv.v FROM b JOIN tv ON tv.text = b.text)""")
DENSE: dict[str, str] = {
    "model_alignment": hashed(Q["attribute_alignment"]), "model_feature_coverage": hashed(Q["feature_coverage"]),
    "model_unique_texts": with_ctes(_HASHED_DEDUP), "vector_unique_texts": with_ctes(_VECTOR_DEDUP),
    "model_iteration_results": hashed("""
SELECT candidate_ord, round(semantic_attribute_alignment, 6) AS semantic_attribute_alignment,
       round(semantic_feature_coverage, 6) AS semantic_feature_coverage, round(sbert, 6) AS sbert,
       round(overall_score, 6) AS overall_score, passed_quality_gates, rejection_reasons FROM h_results"""),
}
DENSE["model_evaluate_texts"] = f"""
SELECT al.candidate_ord, al.semantic_attribute_alignment, pg.semantic_similarity_gold,
       fc.semantic_feature_coverage, fc.n_features AS num_features,
       ut.is_unique, ut.duplicate_of_candidate, ut.duplicate_similarity
FROM ({DENSE["model_alignment"]}) al
JOIN ({hashed(Q["paired_gold_similarity"])}) pg ON pg.candidate_ord = al.candidate_ord
JOIN ({DENSE["model_feature_coverage"]}) fc ON fc.candidate_ord = al.candidate_ord
JOIN ({DENSE["model_unique_texts"]}) ut ON ut.candidate_ord = al.candidate_ord"""

Q["scored_requests"] = f"""
SELECT candidate_ord, call_status, CASE WHEN call_status = 'failed' THEN 'ValueError: unlucky request' END AS error,
       CASE WHEN call_status = 'ok' THEN CAST(6 + n % 4 AS DOUBLE) END AS judge_score,
       CASE WHEN call_status = 'ok' THEN CAST(1 + n % 5 AS DOUBLE) END AS relevance_score,
       CASE WHEN call_status = 'ok' THEN CAST(2 + n % 3 AS DOUBLE) END AS generalization_score,
       CASE WHEN call_status = 'ok' THEN 'length ' || CAST(n AS VARCHAR) ELSE 'API error' END AS judge_reason
FROM (SELECT candidate_ord, n, CASE WHEN n % 13 = 0 THEN 'failed' WHEN n % 17 = 0 THEN 'no_reply' ELSE 'ok' END AS call_status
      FROM (SELECT candidate_ord, length(coalesce(request, '')) AS n FROM ({Q["judge_requests"]})))"""


def oracle_sql() -> dict[str, str]:
    return {k: with_ctes(v) for k, v in Q.items()} | DENSE
