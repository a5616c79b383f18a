"""Oracle SQL for the registered queries, written independently of the Spark code."""

from __future__ import annotations

from cohortry.cohorts import DOC_SQL, LINE_CATEGORICAL, LINE_NUMERIC, LINE_SQL
from cohortry.functions import special

LINE = f"WITH c AS ({LINE_SQL})"
DOC = f"WITH c AS ({DOC_SQL})"
LINE_FEATURES = LINE_NUMERIC + LINE_CATEGORICAL
ORACLES: dict[str, str] = {}


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def tall(columns, cast="DOUBLE", keep="", source="c") -> str:
    return union(f"SELECT {keep} '{c}' AS feature, CAST({c} AS {cast}) AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns)


def rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({x.strip()}, {digits}) AS {x.strip()}" for x in columns.split(","))


def chi_square_p(x: str, dof: str) -> str:
    """Upper tail by the series of the incomplete gamma function; zero where it is below 1e-12."""
    a, h = f"({dof}) / 2.0", f"({x}) / 2.0"
    series = f"(SELECT sum(exp(({a} + i) * ln({h}) - {h} - lgamma({a} + i + 1))) FROM range(3000) r(i))"
    return f"CASE WHEN ({x}) <= 0 THEN 1.0 WHEN {h} > {a} + 40 * sqrt({a}) + 60 THEN 0.0 ELSE greatest(1 - {series}, 0.0) END"


def student_p(t: str, dof: str) -> str:
    """Both tails by the series of the incomplete beta function; zero where it is below 1e-12."""
    b, y = f"({dof}) / 2.0", f"(({t}) * ({t}) / (({dof}) + ({t}) * ({t})))"
    series = f"(SELECT 1 + sum(exp(lgamma(1.5) + lgamma(1.5 + {b} + i) - lgamma(2.5 + i) - lgamma(0.5 + {b}) + (i + 1) * ln({y}))) FROM range(1500) r(i))"
    front = f"2 * exp(0.5 * ln({y}) + {b} * ln(1 - {y}) + lgamma(0.5 + {b}) - lgamma(0.5) - lgamma({b}))"
    return f"CASE WHEN ({t}) = 0 THEN 1.0 WHEN abs({t}) > 15 AND ({dof}) > 30 THEN 0.0 ELSE greatest(1 - {front} * {series}, 0.0) END"


def eliminated(source: str, name: str) -> str:
    """Gauss and Jordan's elimination of ``source`` (id, m: rows with further columns on the right), a step a row of the recursion."""
    row = "list_transform(row, lambda x, q: CASE WHEN i = k THEN x / m[k][k] ELSE x - row[k] * m[k][q] / m[k][k] END)"
    return f"""{name}_steps AS (SELECT id, 1 AS k, m FROM {source} UNION ALL
  SELECT id, k + 1, list_transform(m, lambda row, i: {row}) FROM {name}_steps WHERE k <= len(m)),
{name} AS (SELECT id, m FROM {name}_steps WHERE k = len(m) + 1)"""


ORACLES["prevalence_by_group"] = f"""{LINE}
SELECT segment, count(*) AS total, CAST(sum(outcome) AS BIGINT) AS positives, count(*) FILTER (outcome = 0) AS negatives,
       round(100.0 * sum(outcome) / count(*), 6) AS rate_pct
FROM c GROUP BY segment"""

ORACLES["crosstab_margins"] = f"""{LINE}
SELECT CASE WHEN grouping(segment) = 1 THEN 'Total' ELSE segment END AS row_level,
       CASE WHEN grouping(outcome) = 1 THEN 'Total' ELSE CAST(outcome AS VARCHAR) END AS col_level, count(*) AS n
FROM c GROUP BY CUBE (segment, outcome)"""

ORACLES["crosstab_dense"] = f"""{DOC}, k AS (SELECT * FROM c WHERE quality IS NOT NULL AND source IS NOT NULL)
SELECT 'source' AS variable, a.source AS row_level, CAST(b.quality AS VARCHAR) AS col_level, count(k.rid) AS n
FROM (SELECT DISTINCT source FROM k) a CROSS JOIN (SELECT DISTINCT quality FROM k) b
LEFT JOIN k ON k.source = a.source AND k.quality = b.quality GROUP BY ALL"""


def cells(cte: str, variables, col: str) -> str:
    pairs = union(f"SELECT '{v}' AS variable, CAST({v} AS VARCHAR) AS r, CAST({col} AS VARCHAR) AS k FROM c "
                  f"WHERE {v} IS NOT NULL AND {col} IS NOT NULL" for v in variables)
    return f"""{cte}, p AS ({pairs}),
o AS (SELECT variable, r, k, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT a.variable, a.r, b.k FROM (SELECT DISTINCT variable, r FROM p) a JOIN (SELECT DISTINCT variable, k FROM p) b ON a.variable = b.variable),
d AS (SELECT g.variable, g.r, g.k, coalesce(o.n, 0) AS n FROM g LEFT JOIN o ON g.variable = o.variable AND g.r = o.r AND g.k = o.k),
e AS (SELECT *, sum(n) OVER (PARTITION BY variable, r) * sum(n) OVER (PARTITION BY variable, k)
             / sum(n) OVER (PARTITION BY variable) AS expected FROM d),
s AS (SELECT variable, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT r) AS nr, count(DISTINCT k) AS nk, min(expected) AS min_expected FROM e GROUP BY variable),
x AS (SELECT e.variable, sum(CASE WHEN nr = 2 AND nk = 2 THEN pow(greatest(abs(e.n - expected) - 0.5, 0), 2)
                                 ELSE pow(e.n - expected, 2) END / expected) AS chi2
      FROM e JOIN s ON e.variable = s.variable GROUP BY e.variable)"""


LINE_PAIRS = cells(LINE, ["segment", "ptype", "rflag", "closed", "urgent"], "outcome")

ORACLES["expected_freq"] = cells(DOC, ["lang", "source"], "quality") + """
SELECT variable, r AS row_level, k AS col_level, n, round(expected, 6) AS expected, expected >= 5 AS large_enough FROM e"""
ORACLES["chi_square"] = LINE_PAIRS + """
SELECT s.variable, round(chi2, 6) AS chi2, (nr - 1) * (nk - 1) AS dof, n, round(min_expected, 6) AS min_expected
FROM s JOIN x ON s.variable = x.variable"""
ORACLES["chi_square_p_values"] = LINE_PAIRS + f""", y AS (SELECT s.variable, {chi_square_p('chi2', '(nr - 1) * (nk - 1)')} AS p FROM s JOIN x ON s.variable = x.variable)
SELECT variable, round(p, 9) AS p_value, p < 0.05 AS significant FROM y"""
ORACLES["cramers_v"] = LINE_PAIRS + """
SELECT s.variable, round(sqrt(chi2 / (n * (least(nr, nk) - 1))), 6) AS cramers_v FROM s JOIN x ON s.variable = x.variable"""
ORACLES["chi_square_missing"] = cells(
    DOC.replace("l.quality, l.toxic", "l.quality, l.toxic, CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END AS miss"),
    ["lang", "source"], "miss") + """
SELECT s.variable, round(chi2, 6) AS chi2, (nr - 1) * (nk - 1) AS dof, n, round(""" + chi_square_p("chi2", "(nr - 1) * (nk - 1)") + """, 6) AS p_value
FROM s JOIN x ON s.variable = x.variable"""

ORACLES["pairwise_chi_square"] = f"""{LINE},
t AS (SELECT b.segment AS o, count(*) FILTER (c.segment = 'BUILDING' AND outcome = 1) AS a, count(*) FILTER (c.segment = 'BUILDING' AND outcome = 0) AS b,
      count(*) FILTER (c.segment <> 'BUILDING' AND outcome = 1) AS c, count(*) FILTER (c.segment <> 'BUILDING' AND outcome = 0) AS d
      FROM c JOIN (SELECT DISTINCT segment FROM c WHERE segment <> 'BUILDING') b ON c.segment IN ('BUILDING', b.segment) GROUP BY b.segment),
e AS (SELECT *, CAST(a + b + c + d AS DOUBLE) AS n FROM t),
x AS (SELECT *, n * pow(greatest(abs(a * d - b * c) - n / 2, 0), 2) / (CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)) AS chi2 FROM e),
y AS (SELECT *, {chi_square_p('chi2', '1')} AS p FROM x)
SELECT 'BUILDING' AS base_level, o AS other_level, round(chi2, 6) AS chi2, round(100.0 * a / (a + b), 6) AS base_rate,
       round(100.0 * c / (c + d), 6) AS other_rate, round(p, 6) AS p_value, p < 0.05 AS significant FROM y"""

ORACLES["mutual_information"] = cells(LINE, ["segment", "ptype", "rflag", "closed"], "outcome") + """
SELECT e.variable, round(sum(CASE WHEN e.n > 0 THEN e.n / s.n * log2(e.n / expected) ELSE 0 END), 9) AS mutual_information
FROM e JOIN s ON e.variable = s.variable GROUP BY e.variable"""

SUMMARY_COLUMNS = ["rid", "qty", "price", "rate", "closed", "urgent", "rflag", "ptype", "segment", "outcome", "score"]
_summary = ["SELECT 'shape' AS section, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM c",
            f"SELECT 'shape', 'columns', CAST({len(SUMMARY_COLUMNS)} AS DOUBLE)"]
_summary += [f"SELECT 'missing', '{x}', CAST(count(*) - count({x}) AS DOUBLE) FROM c" for x in SUMMARY_COLUMNS]
_summary += [f"SELECT 'label', '{v}', CAST(count(*) FILTER (outcome = {v}) AS DOUBLE) FROM c" for v in (0, 1)]
for _x in ("qty", "price", "rate"):
    _summary += [f"SELECT '{s}', '{_x}', round({f}, 4) FROM c" for s, f in
                 (("min", f"min({_x})"), ("max", f"max({_x})"), ("mean", f"avg({_x})"), ("median", f"quantile_cont({_x}, 0.5)"))]
_summary += ["SELECT 'outliers', 'price', CAST(count(*) FILTER (price > 100000) AS DOUBLE) FROM c"]
ORACLES["table_summary"] = LINE + union(_summary)

ORACLES["level_counts"] = f"{LINE}, t AS ({tall(['rflag', 'ptype', 'segment'], 'VARCHAR')}) SELECT feature, value AS level, count(*) AS n FROM t GROUP BY ALL"

_types = {"qty": "double", "price": "double", "rate": "double", "rflag": "string", "closed": "int", "urgent": "int", "ptype": "string", "segment": "string"}
ORACLES["missing_profile"] = f"""{LINE}, m AS ({union(
    f"SELECT '{x}' AS feature, count(*) - count({x}) AS missing_count, 100.0 * (count(*) - count({x})) / count(*) AS pct, '{_types[x]}' AS data_type FROM c"
    for x in LINE_FEATURES)})
SELECT feature, missing_count, round(pct, 6) AS missing_pct, data_type,
       CASE WHEN pct < 5 THEN 'KNN Imputation (preserves relationships)' WHEN pct < 20 THEN 'KNN Imputation or Multiple Imputation'
            ELSE 'Consider dropping or separate ''Unknown'' category' END AS advice
FROM m WHERE missing_count > 0"""

ORACLES["cardinality_profile"] = f"""{LINE}, m AS ({union(
    f"SELECT '{x}' AS feature, count(DISTINCT {x}) AS u, count(*) AS total, {str(_types[x] != 'string').lower()} AS num FROM c"
    for x in LINE_FEATURES)})
SELECT feature, u AS unique_values, total AS total_samples, round(u / total, 9) AS ratio,
       CASE WHEN num AND u = 2 THEN 'Binary' WHEN num AND u < 10 THEN 'Discrete' WHEN num THEN 'Continuous'
            WHEN u < 10 THEN 'Categorical (Low)' WHEN u < 50 THEN 'Categorical (Medium)' ELSE 'Categorical (High)' END AS feature_type,
       CASE WHEN NOT num THEN 'Categorical' WHEN u = 2 THEN 'Binary' WHEN u < 10 THEN 'Discrete' ELSE 'Continuous' END AS family,
       CASE WHEN num AND u = 2 THEN 'None (already 0/1)' WHEN num AND u < 10 THEN 'None (keep as numeric)'
            WHEN num THEN 'None (RobustScaler for normalization)' WHEN u <= 10 THEN 'One-Hot Encoding (drop=''first'')'
            ELSE 'Target/Frequency Encoding' END AS encoding,
       u / total < 0.01 AS low_cardinality FROM m"""

ORACLES["top3_values"] = f"""{LINE}, t AS ({union(
    f"SELECT '{x}' AS feature, CAST({x} AS VARCHAR) AS value, count(*) AS n FROM c WHERE {x} IS NOT NULL GROUP BY {x}" for x in LINE_FEATURES)})
SELECT feature, value, n, position FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS position FROM t)
WHERE position <= 3"""

ORACLES["class_balance"] = f"""{LINE}, m AS (SELECT count(*) FILTER (outcome = 0) AS neg, count(*) FILTER (outcome = 1) AS pos FROM c)
SELECT neg AS n_negative, pos AS n_positive, round(neg / pos, 6) AS imbalance_ratio, round(100.0 * pos / (neg + pos), 6) AS minority_pct,
       CASE WHEN neg / pos < 3 THEN 'Mild' WHEN neg / pos < 10 THEN 'Moderate' ELSE 'Severe' END AS severity,
       CASE WHEN neg / pos < 3 THEN 'Standard cross-validation sufficient' WHEN neg / pos < 10 THEN 'Use stratified sampling + class weights'
            ELSE 'Use cost-sensitive learning (scale_pos_weight) + stratified CV' END AS recommendation FROM m"""

ORACLES["moments"] = LINE + union(
    f"SELECT '{x}' AS feature, count({x}) AS n, round(avg({x}), 6) AS mean, round(quantile_cont({x}, 0.5), 6) AS median, "
    f"round(stddev_samp({x}), 6) AS std, round(skewness({x}), 6) AS skewness, round(kurtosis({x}), 6) AS kurtosis FROM c" for x in LINE_NUMERIC)

CODES = f"""t AS ({union(f"SELECT '{x}' AS feature, {x} AS level, min(rid) AS first_seen FROM c GROUP BY {x}" for x in ('rflag', 'ptype', 'segment'))}),
k AS (SELECT feature, level, row_number() OVER (PARTITION BY feature ORDER BY first_seen) - 1 AS code FROM t)"""
ORACLES["label_codes"] = f"{LINE}, {CODES} SELECT feature, level, code FROM k"

CODED = f"""{LINE}, {CODES}, f AS (SELECT qty, price, rate, kr.code AS rflag, closed, urgent, kp.code AS ptype, ks.code AS segment, outcome
FROM c JOIN k kr ON kr.feature = 'rflag' AND kr.level = c.rflag JOIN k kp ON kp.feature = 'ptype' AND kp.level = c.ptype
JOIN k ks ON ks.feature = 'segment' AND ks.level = c.segment)"""
_all = [*LINE_FEATURES, "outcome"]
ORACLES["corr_matrix"] = CODED + union(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS r FROM f" for a in _all for b in _all)
ORACLES["target_corr"] = f"""{CODED}, m AS ({union(f"SELECT '{a}' AS feature, corr({a}, outcome) AS r FROM f" for a in LINE_FEATURES)})
SELECT feature, round(r, 6) AS r, CASE WHEN abs(r) > 0.5 THEN 'Strong' WHEN abs(r) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM m"""
_nums = [*LINE_NUMERIC, "closed", "urgent", "outcome", "score"]
ORACLES["high_corr_pairs"] = f"""{LINE}, m AS ({union(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM c" for i, a in enumerate(_nums) for b in _nums[i + 1:])})
SELECT feature_1, feature_2, round(r, 6) AS r FROM m WHERE abs(r) > 0.8"""

_docs = ["n_chars", "n_words", "quality", "toxic"]
ORACLES["cov_means"] = DOC + union(
    [f"SELECT 'mean' AS kind, '{a}' AS feature_1, CAST(NULL AS VARCHAR) AS feature_2, round(avg({a}), 4) AS value FROM c" for a in _docs]
    + [f"SELECT 'covariance', '{a}', '{b}', round(covar_samp({a}, {b}), 4) FROM c" for a in _docs for b in _docs])
ORACLES["missing_patterns"] = f"""{DOC} SELECT {' || '.join(f"CASE WHEN {a} IS NULL THEN '1' ELSE '0' END" for a in _docs)} AS pattern, count(*) AS n
FROM c GROUP BY ALL"""
ORACLES["group_means"] = f"""{LINE} SELECT CAST(rate IS NULL AS BIGINT) AS level, count(*) AS n, round(avg(qty), 6) AS mean_qty,
round(avg(price), 6) AS mean_price, round(avg(outcome), 6) AS mean_outcome FROM c GROUP BY ALL"""

_tested = ["qty", "price", "closed", "urgent", "outcome"]
ORACLES["point_biserial"] = f"""{LINE}, m AS ({union(
    f"SELECT '{x}' AS feature, corr(CASE WHEN rate IS NULL THEN 1.0 ELSE 0.0 END, {x}) AS r, count({x}) AS n FROM c" for x in _tested)}),
x AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM m), y AS (SELECT *, {student_p('t', 'n - 2')} AS p FROM x)
SELECT feature, round(r, 6) AS r, n, round(t, 6) AS t, round(p, 6) AS p_value, p < 0.05 AS significant FROM y"""
ORACLES["t_test_missing"] = f"""{LINE}, m AS ({union(
    f"SELECT '{x}' AS feature, count({x}) FILTER (rate IS NULL) AS na, count({x}) FILTER (rate IS NOT NULL) AS nb, "
    f"avg({x}) FILTER (rate IS NULL) AS ma, avg({x}) FILTER (rate IS NOT NULL) AS mb, "
    f"var_samp({x}) FILTER (rate IS NULL) AS va, var_samp({x}) FILTER (rate IS NOT NULL) AS vb FROM c" for x in _tested)}),
x AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) AS t FROM m),
y AS (SELECT *, {student_p('t', 'na + nb - 2')} AS p FROM x)
SELECT feature, na AS n_missing, nb AS n_present, round(ma, 6) AS mean_when_missing, round(mb, 6) AS mean_when_present,
       round(t, 6) AS t, na + nb - 2 AS dof, round(p, 6) AS p_value, p < 0.05 AS significant FROM y"""

_spd = ["qty", "price", "rate", "closed", "urgent"]
_pairs = ", ".join(f"corr({a}, {b}) AS r{i}{j}" for i, a in enumerate(_spd) for j, b in enumerate(_spd) if i < j)
_rows = ", ".join("[" + ", ".join([*(f"r{min(i, j)}{max(i, j)}" if i != j else "1.0" for j in range(5)), *("1.0" if i == j else "0.0" for j in range(5))]) + "]" for i in range(5))
ORACLES["vif"] = f"""{LINE.replace('WITH', 'WITH RECURSIVE', 1)}, r AS (SELECT {_pairs} FROM c), a AS (SELECT 0 AS id, [{_rows}] AS m FROM r), {eliminated('a', 'z')}
{union(f"SELECT '{x}' AS feature, round(m[{i + 1}][{i + 6}], 6) AS vif FROM z" for i, x in enumerate(_spd))}"""


def pattern_test(cte: str, columns) -> str:
    """Each pattern's gap to the overall means, weighed by the inverse of the covariances of the columns it has."""
    k = len(columns)
    cov = ", ".join("[" + ", ".join(f"covar_samp({a}, {b})" for b in columns) + "]" for a in columns)
    pattern = " || ".join(f"CASE WHEN {a} IS NULL THEN '1' ELSE '0' END" for a in columns)
    seen = "list_filter(range(1, %d), lambda i: substr(pattern, CAST(i AS INTEGER), 1) = '0')" % (k + 1)
    rows = "list_transform(seen, lambda i: list_concat(list_transform(seen, lambda j: cov[i][j] + CASE WHEN i = j THEN 1e-6 ELSE 0 END), [own[i] - mean[i]]))"
    return f"""{cte.replace('WITH', 'WITH RECURSIVE', 1)}, o AS (SELECT [{', '.join(f'avg({a})' for a in columns)}] AS mean, [{cov}] AS cov FROM c),
g AS (SELECT {pattern} AS pattern, count(*) AS n, [{', '.join(f'CAST(avg({a}) AS DOUBLE)' for a in columns)}] AS own FROM c GROUP BY ALL),
h AS (SELECT *, {seen} AS seen FROM g CROSS JOIN o), a AS (SELECT pattern AS id, {rows} AS m FROM h WHERE n >= 2 AND len(seen) BETWEEN 1 AND {k - 1}),
{eliminated('a', 'z')},
d AS (SELECT h.n * list_sum(list_transform(seen, lambda i, q: (own[i] - mean[i]) * z.m[q][len(seen) + 1])) AS distance, len(seen) AS used FROM h JOIN z ON h.pattern = z.id),
w AS (SELECT coalesce(sum(distance), 0.0) AS chi2, CAST(coalesce(sum(used), 0) AS BIGINT) AS dof FROM d),
v AS (SELECT *, {chi_square_p('chi2', 'dof')} AS p FROM w)
SELECT round(chi2, 6) AS chi2, dof, (SELECT count(*) FROM g) AS n_patterns, round(p, 6) AS p_value, p > 0.05 AS is_mcar FROM v"""


ORACLES["mcar_test"] = pattern_test(LINE, ["qty", "price", "rate", "closed", "urgent", "outcome"])
ORACLES["mcar_test_documents"] = pattern_test(DOC.replace("l.quality, l.toxic", "l.quality, CASE WHEN d.lang <> 'en' THEN l.toxic END AS toxic"),
                                              ["quality", "toxic", "rid", "n_chars", "n_words"])
ORACLES["missing_share"] = f"{LINE} SELECT count(*) - count(rate) AS missing_count, round(100.0 * (count(*) - count(rate)) / count(*), 6) AS missing_pct FROM c"

ORACLES["mean_impute_contrast"] = f"""{LINE}, f AS (SELECT rate, coalesce(rate, avg(rate) OVER ()) AS filled, qty FROM c)
SELECT 'before' AS stage, round(avg(rate), 6) AS mean, round(stddev_samp(rate), 6) AS std, round(corr(rate, qty), 6) AS corr FROM f
UNION ALL SELECT 'after', round(avg(filled), 6), round(stddev_samp(filled), 6), round(corr(filled, qty), 6) FROM f"""

K2 = f"""{LINE}, m AS ({union(
    f"SELECT '{x}' AS feature, count({x}) AS c, CAST(count({x}) AS DOUBLE) AS n, skewness({x}) AS sk, kurtosis({x}) AS ku, avg({x}) AS mean, "
    f"quantile_cont({x}, 0.5) AS median, stddev_samp({x}) AS std FROM c" for x in LINE_NUMERIC)}),
p AS (SELECT *, sk * (n - 2) / sqrt(n * (n - 1)) AS g1, (ku * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) AS g2 FROM m),
a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
      3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b,
      (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM p),
b AS (SELECT *, -1 + sqrt(2 * (b - 1)) AS w2, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS k FROM a),
d AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS q, 1 + x * sqrt(2 / (k - 4)) AS dd FROM b),
z AS (SELECT *, pow(ln(q + sqrt(q * q + 1)) / sqrt(0.5 * ln(w2)), 2)
      + pow((1 - 2 / (9 * k) - sign(dd) * pow((1 - 2 / k) / abs(dd), 1.0 / 3)) / sqrt(2 / (9 * k)), 2) AS k2 FROM d)"""
ORACLES["dagostino"] = f"{K2} SELECT feature, c AS n, round(k2, 3) AS statistic, round(exp(-k2 / 2), 12) AS p_value FROM z"
# every column of the line cohort has at least 5,000 values at all scales, so the large-sample test applies
ORACLES["distribution_table"] = f"""{K2} SELECT feature, c AS n, {rounded('mean, median, std')}, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis,
       'D''Agostino' AS normality_test, round(exp(-k2 / 2), 6) AS p_value, exp(-k2 / 2) > 0.05 AS is_normal,
       CASE WHEN exp(-k2 / 2) > 0.05 THEN 'StandardScaler (data is normally distributed)'
            WHEN abs(sk) > 1 THEN 'RobustScaler or Log Transform (highly skewed)' ELSE 'RobustScaler (not normal, use median/IQR)' END AS recommendation FROM z"""
ORACLES["vif_three"] = f"""{LINE}, m AS (SELECT corr(qty, price) AS a, corr(qty, rate) AS b, corr(price, rate) AS k FROM c),
d AS (SELECT *, 1 + 2 * a * b * k - a * a - b * b - k * k AS det FROM m)
SELECT 'qty' AS feature, round((1 - k * k) / det, 6) AS vif FROM d UNION ALL SELECT 'price', round((1 - b * b) / det, 6) FROM d
UNION ALL SELECT 'rate', round((1 - a * a) / det, 6) FROM d"""


def horner(x: str, coefficients) -> str:
    out = f"CAST({coefficients[-1]!r} AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def quantile_steps(source: str, p: str, name: str, out: str) -> str:
    """CTEs that add the normal quantile of ``p`` to ``source`` as column ``name`` of ``out``."""
    def ratio(x, kind):
        return f"{horner(x, getattr(special, kind + '_NUM'))} / {horner(x, getattr(special, kind + '_DEN'))}"
    return f"""{out}_1 AS (SELECT *, {p} AS pp FROM {source}),
{out}_2 AS (SELECT *, pp - 0.5 AS pq, sqrt(-ln(least(pp, 1 - pp))) AS pr FROM {out}_1),
{out} AS (SELECT *, CASE WHEN abs(pq) <= 0.425 THEN pq * {ratio('(0.180625 - pq * pq)', 'CENTRE')}
      ELSE sign(pq) * CASE WHEN pr <= 5 THEN {ratio('(pr - 1.6)', 'MIDDLE')} ELSE {ratio('(pr - 5)', 'TAIL')} END END AS {name} FROM {out}_2)"""


ORACLES["shapiro"] = f"""{DOC}, t AS ({tall(['n_chars', 'n_words', 'quality'])}),
r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS i, count(*) OVER (PARTITION BY feature) AS n FROM t),
{quantile_steps('r', '(i - 0.375) / (n + 0.25)', 'm', 's')},
e AS (SELECT feature, n, sum(m * m) AS mm, max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, 1 / sqrt(n) AS u FROM s GROUP BY feature, n),
w AS (SELECT *, m1 / sqrt(mm) + 0.221157 * u - 0.147981 * pow(u, 2) - 2.071190 * pow(u, 3) + 4.434685 * pow(u, 4) - 2.706056 * pow(u, 5) AS a1,
      m2 / sqrt(mm) + 0.042981 * u - 0.293762 * pow(u, 2) - 1.752461 * pow(u, 3) + 5.682633 * pow(u, 4) - 3.582633 * pow(u, 5) AS a2 FROM e),
x AS (SELECT *, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM w),
y AS (SELECT s.feature, s.n, value, CASE WHEN i = 1 THEN -a1 WHEN i = s.n THEN a1 WHEN i = 2 THEN -a2 WHEN i = s.n - 1 THEN a2 ELSE m / sqrt(phi) END AS a
      FROM s JOIN x ON s.feature = x.feature)
SELECT feature, n, round(pow(sum(a * value), 2) / (var_pop(value) * n), 6) AS statistic FROM y GROUP BY feature, n"""

_edge = "pow(CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE) / n)"
QQ = f"""r AS (SELECT feature, rid, value, row_number() OVER (PARTITION BY feature ORDER BY value, rid) AS rank, count(*) OVER (PARTITION BY feature) AS n FROM t),
{quantile_steps('r', f'CASE WHEN rank = n THEN {_edge} WHEN rank = 1 THEN 1 - {_edge} ELSE (rank - 0.3175) / (n + 0.365) END', 'theoretical', 's')}"""
ORACLES["qq_points"] = f"""{DOC}, t AS ({tall(['n_chars', 'n_words'], keep='rid,')}), {QQ}
SELECT feature, rid, rank, round(value, 6) AS value, round(theoretical, 6) AS theoretical FROM s"""
ORACLES["qq_fit"] = f"""{LINE}, t AS ({tall(LINE_NUMERIC, keep='rid,')}), {QQ}
SELECT feature, count(*) AS n, round(regr_slope(value, theoretical), 6) AS slope, round(regr_intercept(value, theoretical), 6) AS intercept,
       round(corr(theoretical, value), 6) AS r FROM s GROUP BY feature"""

ORACLES["histogram"] = f"""{LINE}, t AS ({tall(LINE_NUMERIC)}),
m AS (SELECT feature, min(value) AS lo, (max(value) - min(value)) / 50 AS w, count(*) AS total FROM t GROUP BY feature),
b AS (SELECT t.feature, CAST(least(floor((value - lo) / w), 49) AS BIGINT) AS bin, count(*) AS n FROM t JOIN m ON t.feature = m.feature GROUP BY ALL),
g AS (SELECT m.*, i AS bin FROM m CROSS JOIN range(50) r(i))
SELECT g.feature, g.bin, round(lo + g.bin * w, 9) AS lower, coalesce(n, 0) AS n, round(coalesce(n, 0) / total / w, 9) AS density
FROM g LEFT JOIN b ON b.feature = g.feature AND b.bin = g.bin"""
ORACLES["kde"] = f"""{DOC}, t AS ({tall(['n_chars', 'n_words'])}),
m AS (SELECT feature, min(value) AS lo, (max(value) - min(value)) / 99 AS step, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h FROM t GROUP BY feature),
g AS (SELECT m.*, p AS point, lo + p * step AS x FROM m CROSS JOIN range(100) r(p))
SELECT g.feature, point, round(x, 6) AS x, round(sum(exp(-pow((x - value) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 12) AS density
FROM g JOIN t ON g.feature = t.feature GROUP BY g.feature, point, x, n, h"""

ORACLES["pearson_ci"] = f"""{LINE}, m AS ({union(
    f"SELECT '{x}' AS feature, count({x}) AS n, corr({x}, outcome) AS r FROM c" for x in ['qty', 'price', 'rate', 'closed', 'urgent'])}),
x AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM m), y AS (SELECT *, {student_p('t', 'n - 2')} AS p FROM x)
SELECT feature, n, round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS lower,
       round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS upper, round(t, 6) AS t, round(p, 6) AS p_value,
       abs(r) < 0.05 AND p > 0.05 AS remove FROM y"""
ORACLES["iqr_outliers"] = f"""{LINE}, t AS ({tall(LINE_NUMERIC)}),
m AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM t GROUP BY feature)
SELECT t.feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 + 1.5 * (q3 - q1), 6) AS fence,
       count(*) FILTER (value > q3 + 1.5 * (q3 - q1)) AS n_outliers,
       round(100.0 * count(*) FILTER (value > q3 + 1.5 * (q3 - q1)) / count(*), 6) AS outlier_pct
FROM t JOIN m ON t.feature = m.feature GROUP BY t.feature, q1, q3"""

_start = "substr(rid, 1, 1)"
ORACLES["dirty_report"] = f"""{LINE},
d AS (SELECT {_start} = '0' AS text, {_start} = '1' AS low, {_start} = '2' AS gone, {_start} = '3' AS other, rflag, closed FROM c)
SELECT 'qty' AS column_name, 'type double' AS check_name, 'error' AS severity, count(*) FILTER (text) AS n_failed FROM d
UNION ALL SELECT 'qty', 'not null', 'error', 0 UNION ALL SELECT 'qty', 'greater than 0', 'error', count(*) FILTER (low) FROM d
UNION ALL SELECT 'closed', 'type int', 'error', 0 UNION ALL SELECT 'closed', 'not null', 'error', count(*) FILTER (gone) FROM d
UNION ALL SELECT 'closed', 'allowed values', 'error', 0 UNION ALL SELECT 'rflag', 'type string', 'error', 0
UNION ALL SELECT 'rflag', 'not null', 'error', 0 UNION ALL SELECT 'rflag', 'allowed values', 'error', count(*) FILTER (other) FROM d
UNION ALL SELECT 'rflag', 'must contain N', 'error', CAST(count(*) FILTER (rflag = 'N' AND NOT other) = 0 AS BIGINT) FROM d"""
ORACLES["csv_round_trip"] = f"""{LINE} SELECT rid, {rounded('qty, price, rate')}, closed, urgent, rflag, ptype, segment, outcome FROM c"""
ORACLES["plain_names"] = f"""{LINE} SELECT 'segment_' || segment AS feature, count(*) AS n FROM c GROUP BY ALL"""

# name of the check, severity, failing condition
LINE_RULES = [
    ("qty", "type double", "error", "false"), ("qty", "not null", "error", "qty IS NULL"), ("qty", "greater than 0", "error", "qty <= 0"),
    ("qty", "between 1 and 48", "error", "qty < 1 OR qty > 48"),
    ("price", "type double", "error", "false"), ("price", "not null", "error", "price IS NULL"), ("price", "greater than 0", "error", "price <= 0"),
    ("price", "greater than 100000 is an outlier", "warn", "price > 100000"),
    ("rate", "type double", "error", "false"), ("rate", "greater than 0", "error", "rate <= 0"),
    ("closed", "type int", "error", "false"), ("closed", "not null", "error", "closed IS NULL"), ("closed", "allowed values", "error", "closed NOT IN (0, 1)"),
    ("urgent", "type int", "error", "false"), ("urgent", "not null", "error", "urgent IS NULL"), ("urgent", "allowed values", "error", "urgent NOT IN (0, 1)"),
    ("rflag", "type string", "error", "false"), ("rflag", "not null", "error", "rflag IS NULL"), ("rflag", "allowed values", "error", "rflag NOT IN ('A', 'N')"),
    ("ptype", "type string", "error", "false"), ("ptype", "not null", "error", "ptype IS NULL"),
    ("segment", "type string", "error", "false"), ("segment", "not null", "error", "segment IS NULL"),
    ("segment", "allowed values", "error", "segment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"),
    ("outcome", "type int", "error", "false"), ("outcome", "not null", "error", "outcome IS NULL"), ("outcome", "allowed values", "error", "outcome NOT IN (0, 1)"),
]
ORACLES["validate_report"] = LINE + union(
    [f"SELECT '{c}' AS column_name, '{k}' AS check_name, '{s}' AS severity, count(*) FILTER ({cond}) AS n_failed FROM c" for c, k, s, cond in LINE_RULES]
    + ["SELECT 'rflag', 'must contain R', 'error', CAST(count(*) FILTER (rflag = 'R') = 0 AS BIGINT) FROM c"])
ORACLES["failing_values"] = LINE + union(
    f"SELECT rid, '{c}' AS column_name, '{k}' AS check_name, '{s}' AS severity FROM c WHERE {cond}" for c, k, s, cond in LINE_RULES if cond != "false")
ORACLES["validate_rows"] = f"""{LINE}, e AS (SELECT rid, list_filter([{', '.join(
    f"CASE WHEN {cond} THEN '{c}: {k}' END" for c, k, s, cond in LINE_RULES if s == 'error')}], lambda x: x IS NOT NULL) AS l FROM c)
SELECT rid, len(l) AS n_errors, array_to_string(l, '; ') AS errors FROM e"""
ORACLES["outlier_warning"] = f"""{LINE}, o AS (SELECT rid, price, row_number() OVER (ORDER BY rid) AS place FROM c WHERE price > 100000)
SELECT 'price' AS column_name, count(*) AS n_outliers, string_agg(CAST(round(price, 2) AS VARCHAR), ', ' ORDER BY rid) FILTER (place <= 5) AS examples FROM o"""
ORACLES["rare_merge"] = f"""{LINE} SELECT CASE WHEN rid = (SELECT min(rid) FROM c) THEN 'N' ELSE rflag END AS rflag, count(*) AS n FROM c GROUP BY 1"""

PLACED = "row_number() OVER (PARTITION BY outcome ORDER BY md5(rid || '|42'), rid)"
ORACLES["stratified_split"] = f"""{LINE} SELECT rid, outcome, {PLACED} <= round(0.2 * count(*) OVER (PARTITION BY outcome)) AS is_test FROM c"""
ORACLES["stratified_folds"] = f"{LINE} SELECT rid, outcome, ({PLACED} - 1) % 5 AS fold FROM c"
ORACLES["hash_sample"] = f"{LINE} SELECT rid, qty, price FROM c ORDER BY md5(rid || '|42'), rid LIMIT 500"

ORACLES["robust_scale"] = f"""{LINE}, m AS (SELECT {', '.join(
    f"quantile_cont({x}, 0.5) AS m_{x}, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS s_{x}" for x in LINE_NUMERIC)} FROM c)
SELECT rid, {', '.join(f'round(({x} - m_{x}) / s_{x}, 6) AS numerical__{x}' for x in LINE_NUMERIC)} FROM c CROSS JOIN m"""
_levels = {"rflag": ["N", "R"], "closed": ["1"], "urgent": ["1"], "ptype": ["LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
           "segment": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}
ORACLES["one_hot"] = f"""{LINE} SELECT rid, {', '.join(
    f'CAST(CAST({x} AS VARCHAR) = {v!r} AS DOUBLE) AS "categorical__{x}_{v}"' for x in LINE_CATEGORICAL for v in _levels[x])} FROM c"""
ORACLES["missing_indicator"] = f"{LINE} SELECT rid, rate, CAST(rate IS NULL AS BIGINT) AS rate_missing FROM c"


def scaled_docs(cte: str) -> str:
    return f"""{cte}, m AS (SELECT quantile_cont(n_chars, 0.5) AS mc, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS sc,
      quantile_cont(n_words, 0.5) AS mw, quantile_cont(n_words, 0.75) - quantile_cont(n_words, 0.25) AS sw FROM c),
s AS (SELECT rid, (n_chars - mc) / sc AS x, (n_words - mw) / sw AS w, CAST(quality AS DOUBLE) AS quality FROM c CROSS JOIN m)"""


def neighbour_steps(receivers: str, donors: str, value: str = "quality", x: str = "x", w: str = "w", k: int = 10) -> str:
    return f"""p AS (SELECT r.rid, d.{value} AS v, pow(r.{x} - d.{x}, 2) + pow(r.{w} - d.{w}, 2) AS d2, d.rid AS did FROM {receivers} r CROSS JOIN {donors} d),
q AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d2, did) AS k FROM p QUALIFY k <= {k})"""


ORACLES["knn_impute"] = f"""{scaled_docs(DOC)}, r AS (SELECT * FROM s WHERE quality IS NULL), d AS (SELECT * FROM s WHERE quality IS NOT NULL),
{neighbour_steps('r', 'd')}, f AS (SELECT rid, sum(v / sqrt(d2 + 1)) / sum(1 / sqrt(d2 + 1)) AS fill FROM q GROUP BY rid)
SELECT s.rid, round(x, 6) AS x, round(w, 6) AS w, round(coalesce(quality, fill), 6) AS quality FROM s LEFT JOIN f ON s.rid = f.rid"""
ORACLES["knn_impute_large"] = f"""{LINE}, m AS (SELECT {', '.join(
    f"quantile_cont({x}, 0.5) AS m_{x}, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS s_{x}" for x in LINE_NUMERIC)} FROM c),
s AS (SELECT rid, {', '.join(f"({x} - m_{x}) / s_{x} AS {x}" for x in LINE_NUMERIC)} FROM c CROSS JOIN m),
r AS (SELECT * FROM s WHERE rate IS NULL), d AS (SELECT * FROM s WHERE rate IS NOT NULL),
p AS (SELECT r.rid, min({{'d2': (r.qty - d.qty) * (r.qty - d.qty) + (r.price - d.price) * (r.price - d.price), 'did': d.rid, 'v': d.rate}}, 10) AS l
      FROM r CROSS JOIN d GROUP BY r.rid),
q AS (SELECT rid, unnest(l) AS e FROM p),
f AS (SELECT rid, sum(e.v / sqrt(e.d2 + 1)) / sum(1 / sqrt(e.d2 + 1)) AS fill FROM q GROUP BY rid)
SELECT s.rid, round(qty, 6) AS qty, round(price, 6) AS price, round(coalesce(rate, fill), 6) AS rate FROM s LEFT JOIN f ON s.rid = f.rid"""
ORACLES["impute_quality"] = f"""{scaled_docs(DOC)},
h AS (SELECT *, CAST('0x' || substr(md5(rid || '|42'), 1, 8) AS BIGINT) < 0.1 * 4294967296 AS hid FROM s WHERE quality IS NOT NULL),
r AS (SELECT * FROM h WHERE hid), d AS (SELECT * FROM h WHERE NOT hid),
{neighbour_steps('r', 'd')},
g AS (SELECT kk, q.rid, sum(v / sqrt(d2 + 1)) / sum(1 / sqrt(d2 + 1)) AS guess FROM q JOIN (VALUES (1), (3), (5), (7), (10)) t(kk) ON q.k <= kk GROUP BY kk, q.rid)
SELECT CAST(kk AS BIGINT) AS k, count(*) AS n, round(sqrt(avg(pow(quality - guess, 2))), 6) AS rmse, round(avg(abs(quality - guess)), 6) AS mae,
       round(1 - sum(pow(quality - guess, 2)) / (var_pop(quality) * count(*)), 6) AS r2
FROM g JOIN r ON g.rid = r.rid GROUP BY kk"""
ORACLES["feature_matrix"] = f"""{DOC},
b AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(rid || '|42'), rid) <= round(0.2 * count(*) OVER (PARTITION BY toxic)) AS is_test,
      CAST(quality IS NULL AS INTEGER) AS miss FROM c),
m AS (SELECT {', '.join(f"quantile_cont({a}, 0.5) AS m_{a}, quantile_cont({a}, 0.75) - quantile_cont({a}, 0.25) AS s_{a}" for a in ('n_chars', 'n_words', 'quality', 'miss'))}
      FROM b WHERE NOT is_test),
s AS (SELECT rid, is_test, lang, {', '.join(f"({a} - m_{a}) / CASE WHEN s_{a} = 0 THEN 1 ELSE s_{a} END AS {a}" for a in ('n_chars', 'n_words', 'quality', 'miss'))},
      pow(CASE WHEN s_miss = 0 THEN 1 ELSE s_miss END, -2) AS gap FROM b CROSS JOIN m),
r AS (SELECT * FROM s WHERE quality IS NULL), d AS (SELECT * FROM s WHERE quality IS NOT NULL AND NOT is_test),
{neighbour_steps('r', 'd', x='n_chars', w='n_words')},
f AS (SELECT q.rid, sum(v / sqrt(d2 + gap)) / sum(1 / sqrt(d2 + gap)) AS fill FROM q JOIN r ON q.rid = r.rid GROUP BY q.rid)
SELECT s.rid, is_test, round(n_chars, 6) AS numerical__n_chars, round(n_words, 6) AS numerical__n_words,
       round(coalesce(quality, fill), 6) AS numerical__quality, round(miss, 6) AS numerical__quality_missing,
       {', '.join(f'CAST(lang = {v!r} AS DOUBLE) AS categorical__lang_{v}' for v in ('en', 'es', 'fr'))} FROM s LEFT JOIN f ON s.rid = f.rid"""
ORACLES["missing_cells"] = f"{LINE} SELECT {' + '.join(f'count(*) - count({x})' for x in LINE_NUMERIC)} AS n_missing FROM c"

_confused = "count(*) FILTER (outcome = 0 AND score < 0.8) AS tn, count(*) FILTER (outcome = 0 AND score >= 0.8) AS fp, " \
            "count(*) FILTER (outcome = 1 AND score < 0.8) AS fn, count(*) FILTER (outcome = 1 AND score >= 0.8) AS tp"
ORACLES["confusion"] = f"{LINE} SELECT {_confused} FROM c"
ORACLES["clinical_metrics"] = f"""{LINE}, m AS (SELECT {_confused} FROM c)
SELECT tn, fp, fn, tp, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity,
       round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv FROM m"""
ORACLES["class_report"] = f"""{LINE}, m AS (SELECT {_confused} FROM c),
k AS (SELECT 'negative' AS class_name, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS s FROM m
      UNION ALL SELECT 'positive', tp / (tp + fp), tp / (tp + fn), tp + fn FROM m),
f AS (SELECT *, 2 * p * r / (p + r) AS f FROM k)
SELECT class_name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, s AS support FROM f
UNION ALL SELECT 'accuracy', round((tn + tp) / (tn + fp + fn + tp), 6), round((tn + tp) / (tn + fp + fn + tp), 6), round((tn + tp) / (tn + fp + fn + tp), 6), tn + fp + fn + tp FROM m
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM f"""
ORACLES["threshold_table"] = LINE + union(
    f"SELECT CAST({t} AS DOUBLE) AS threshold, round(count(*) FILTER (score >= {t} AND outcome = 1) / count(*) FILTER (outcome = 1), 6) AS recall, "
    f"round(count(*) FILTER (score >= {t} AND outcome = 1) / count(*) FILTER (score >= {t}), 6) AS precision, "
    f"count(*) FILTER (score >= {t}) AS n_selected FROM c" for t in (0.3, 0.5, 0.7))

STEPS = f"""{LINE}, h AS (SELECT score, count(*) FILTER (outcome = 1) AS pos, count(*) FILTER (outcome = 0) AS neg FROM c GROUP BY score),
u AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn,
      row_number() OVER (ORDER BY score DESC) AS i, sum(pos) OVER () AS allp, sum(neg) OVER () AS alln
      FROM h WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
ORACLES["roc_curve"] = f"""{STEPS}
SELECT CAST('Infinity' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
UNION ALL SELECT score, round(fp / alln, 6), round(tp / allp, 6) FROM u WHERE i = 1 OR np IS NULL OR NOT (pos = np AND neg = nn)"""
ORACLES["roc_auc"] = f"""{STEPS}, l AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY i) AS tp0, lag(fp, 1, 0) OVER (ORDER BY i) AS fp0 FROM u)
SELECT round(sum((fp - fp0) / alln * (tp + tp0) / allp / 2), 6) AS roc_auc, round(max(allp) / (max(allp) + max(alln)), 6) AS positive_rate FROM l"""
ORACLES["pr_curve"] = f"""{STEPS}
SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / allp, 6) AS recall FROM u UNION ALL SELECT NULL, 1.0, 0.0"""
ORACLES["avg_precision"] = f"""{STEPS}, l AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY i) AS tp0 FROM u)
SELECT round(sum((tp - tp0) / allp * tp / (tp + fp)), 6) AS average_precision FROM l"""
_points = [f"(SELECT 'threshold' AS kind, CAST({t} AS DOUBLE) AS target, score, tp, fp, allp FROM u ORDER BY abs(score - {t}), score LIMIT 1)" for t in (0.1, 0.3, 0.5, 0.7)]
_points.append("(SELECT 'recall', CAST(0.8 AS DOUBLE), score, tp, fp, allp FROM u ORDER BY abs(tp / allp - 0.8), score LIMIT 1)")
ORACLES["operating_points"] = f"""{STEPS}, o AS ({union(_points)})
SELECT kind, target, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / allp, 6) AS recall FROM o"""


def rates(columns) -> str:
    pairs = union(f"SELECT '{x}' AS attribute, CAST({x} AS VARCHAR) AS group_value, outcome, score FROM c" for x in columns)
    return f"""{LINE}, p AS ({pairs}),
g AS (SELECT attribute, group_value, count(*) AS support, count(*) FILTER (outcome = 1) AS positives,
      count(*) FILTER (outcome = 1 AND score >= 0.8) / count(*) FILTER (outcome = 1) AS tpr,
      count(*) FILTER (outcome = 0 AND score >= 0.8) / count(*) FILTER (outcome = 0) AS fpr,
      count(*) FILTER (score >= 0.8) / count(*) AS selection_rate FROM p GROUP BY ALL)"""


ORACLES["group_rates"] = rates(["rflag", "closed", "segment"]) + f"""
SELECT attribute, group_value, support, positives, {rounded('tpr, fpr, selection_rate')} FROM g"""
ORACLES["equalized_odds"] = rates(["closed"]) + """
SELECT attribute, count(*) AS n_groups, round(max(tpr) - min(tpr), 6) AS tpr_disparity, round(min(tpr) / max(tpr), 6) AS tpr_ratio,
       round(max(fpr) - min(fpr), 6) AS fpr_disparity FROM g GROUP BY attribute"""
ORACLES["demographic_parity"] = rates(["urgent"]) + """
SELECT attribute, count(*) AS n_groups, round(max(selection_rate) - min(selection_rate), 6) AS disparity,
       round(min(selection_rate) / max(selection_rate), 6) AS ratio FROM g GROUP BY attribute"""
ORACLES["fairness_audit"] = rates(["rflag", "closed"]) + """,
a AS (SELECT 'rflag' AS attribute, 'equalized_odds' AS metric, max(tpr) - min(tpr) AS d, min(tpr) / max(tpr) AS r FROM g WHERE attribute = 'rflag' AND group_value IN ('A', 'R')
      UNION ALL SELECT 'closed', 'demographic_parity', max(selection_rate) - min(selection_rate), min(selection_rate) / max(selection_rate) FROM g WHERE attribute = 'closed')
SELECT attribute, metric, round(d, 6) AS disparity, round(r, 6) AS ratio,
       CASE WHEN d > 0.001 THEN attribute || ': ' || metric || ' disparity exceeds the limit' END AS warning FROM a"""


def bands(p: str) -> str:
    return f"""CASE WHEN {p} < 0.2 THEN 'LOW' WHEN {p} < 0.5 THEN 'MODERATE' WHEN {p} < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
       CASE WHEN abs({p} - 0.5) > 0.4 THEN 'High' WHEN abs({p} - 0.5) > 0.2 THEN 'Moderate' ELSE 'Low' END AS confidence"""


ALERT = "'CRITICAL ALERT: Patient has extremely high stroke risk (>80%). Immediate clinical evaluation recommended.'"
ORACLES["risk_bands"] = f"""{LINE} SELECT rid, score AS probability, printf('%.1f%%', score * 100) AS risk_percentage, {bands('score')},
       CASE WHEN score >= 0.8 THEN {ALERT} END AS alert FROM c"""
_errors = " + ".join(f"CASE WHEN {cond} THEN 1 ELSE 0 END" for _, _, s, cond in LINE_RULES if s == "error")
ORACLES["score_records"] = f"""{LINE}, e AS (SELECT rid, score, CAST({_errors} AS BIGINT) AS n_errors FROM c), b AS (SELECT *, {bands('score')} FROM e)
SELECT rid, CASE WHEN n_errors = 0 THEN risk_level END AS risk_level, CASE WHEN n_errors = 0 THEN confidence END AS confidence, n_errors FROM b"""
_k = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
_bad = f"CASE WHEN {_k} BETWEEN 0 AND 90 THEN 0 ELSE 1 END"
ORACLES["json_records"] = f"SELECT event_id, {_k} AS k, CAST({_bad} AS BIGINT) AS n_errors FROM events"
ORACLES["score_stream"] = f"""WITH e AS (SELECT event_id, least(value / 100, 1.0) AS p, CAST({_bad} AS BIGINT) AS n_errors FROM events)
SELECT event_id, printf('%.1f%%', p * 100) AS risk_percentage, {bands('p')}, CASE WHEN p >= 0.8 THEN {ALERT} END AS alert, n_errors FROM e"""

# the fixed model: three trees as conditions, and the worth of every coalition of the features on their paths
_t1, _t2, _t3 = ("CASE WHEN price < 50000 THEN -0.6 WHEN qty < 25 THEN 0.2 ELSE 0.9 END",
                 "CASE WHEN closed >= 0.5 THEN 0.05 WHEN segment <> 'BUILDING' THEN -0.1 ELSE 0.3 END",
                 "CASE WHEN segment <> 'MACHINERY' THEN 0.02 ELSE -0.15 END")
FIXED = f"""{LINE}, m AS (SELECT *, CAST(-0.4 AS DOUBLE) + {_t1} + {_t2} + {_t3} AS margin FROM c),
s AS (SELECT *, 1 / (1 + exp(-margin)) AS p FROM m)"""
ORACLES["score_model"] = f"""{FIXED} SELECT rid, round(p, 6) AS probability, printf('%.1f%%', p * 100) AS risk_percentage, {bands('p')},
       CASE WHEN p >= 0.8 THEN {ALERT} END AS alert, '{{"closed":' || closed || '}}' AS features_used FROM s"""
ORACLES["stream_model"] = ORACLES["score_model"]
ORACLES["transform_new_rows"] = f"SELECT * EXCLUDE (is_test) FROM ({ORACLES['feature_matrix']}) WHERE is_test"
_exact = ORACLES["feature_matrix"].replace("round(coalesce(quality, fill), 6)", "coalesce(quality, fill)").replace("round(n_chars, 6)", "n_chars")
_bad = "CASE WHEN rid % 35 = 3 THEN 3 WHEN rid % 35 IN (1, 2) THEN 1 ELSE 0 END"
DOC_SCORES = f"""WITH x AS (SELECT * FROM ({_exact}) WHERE is_test), raw AS ({DOC_SQL}),
y AS (SELECT x.rid, CASE WHEN x.rid % 35 IN (1, 2, 3) THEN NULL ELSE 1 END AS ok, CAST({_bad.replace('rid', 'x.rid')} AS BIGINT) AS n_errors,
  -0.2 + CASE WHEN numerical__n_chars < 0.5 THEN CASE WHEN numerical__quality < -0.25 THEN -1.0 ELSE 0.2 END ELSE 0.9 END
  + CASE WHEN categorical__lang_es < 0.5 THEN -0.3 ELSE 0.4 END + CASE WHEN numerical__quality_missing < 0.5 THEN -0.1 ELSE 1.3 END AS margin,
  raw.n_chars, raw.n_words, raw.quality, raw.lang FROM x JOIN raw ON x.rid = raw.rid),
s AS (SELECT *, ok / (1 + exp(-CAST(margin AS DOUBLE))) AS p FROM y)"""
ORACLES["score_cohort"] = f"""{DOC_SCORES}, t AS (SELECT *, {bands('p')} FROM s)
SELECT rid, CASE WHEN ok = 1 THEN 'scored' ELSE 'rejected' END AS status, round(p, 5) AS probability,
       CASE WHEN ok = 1 THEN printf('%.1f%%', p * 100) END AS risk_percentage, CASE WHEN ok = 1 THEN risk_level END AS risk_level,
       CASE WHEN ok = 1 THEN confidence END AS confidence, CASE WHEN p >= 0.8 THEN {ALERT} END AS alert,
       CASE WHEN ok = 1 THEN '{{"n_chars":' || CAST(n_chars AS VARCHAR) || ',"n_words":' || CAST(n_words AS VARCHAR) || ',"quality":'
       || coalesce(CAST(CAST(quality AS DOUBLE) AS VARCHAR), 'null') || ',"lang":"' || lang || '"}}' END AS features_used, n_errors FROM t"""
ORACLES["stream_cohort"] = ORACLES["score_cohort"]
_deep = "CAST(0.375 * 0.2 + 0.625 * 0.9 AS DOUBLE)"
_flat = "CAST(0.8 * -0.1 + 0.2 * 0.3 AS DOUBLE)"
PHI = f"""{LINE}, v AS (SELECT *, CAST({_t1} AS DOUBLE) AS pq, CASE WHEN price < 50000 THEN CAST(-0.6 AS DOUBLE) ELSE {_deep} END AS p0,
     0.6 * -0.6 + 0.4 * CASE WHEN qty < 25 THEN CAST(0.2 AS DOUBLE) ELSE 0.9 END AS q0, 0.6 * -0.6 + 0.4 * {_deep} AS none1,
     CAST({_t2} AS DOUBLE) AS cb, CASE WHEN closed >= 0.5 THEN CAST(0.05 AS DOUBLE) ELSE {_flat} END AS c0,
     0.5 * CASE WHEN segment <> 'BUILDING' THEN CAST(-0.1 AS DOUBLE) ELSE 0.3 END + 0.5 * 0.05 AS b0, 0.5 * {_flat} + 0.5 * 0.05 AS none2 FROM c),
f AS (SELECT rid, qty, price, segment, ((p0 - none1) + (pq - q0)) / 2 AS phi_price, ((q0 - none1) + (pq - p0)) / 2 AS phi_qty,
      ((c0 - none2) + (cb - b0)) / 2 AS phi_closed, ((b0 - none2) + (cb - c0)) / 2 AS phi_building,
      CAST({_t3} AS DOUBLE) - (0.8 * 0.02 + 0.2 * -0.15) AS phi_machinery FROM v)"""
ORACLES["shap_fixed"] = f"{PHI} SELECT rid, {rounded('phi_price, phi_qty, phi_closed, phi_building, phi_machinery')} FROM f"
ORACLES["shap_dependence_fixed"] = f"""{PHI} SELECT rid, round(CAST(price AS DOUBLE), 6) AS feature_value, round(phi_price, 6) AS phi,
       round(CAST(qty AS DOUBLE), 6) AS interaction_value FROM f"""
_names = {"price": "price", "qty": "qty", "closed": "closed", "categorical__segment_BUILDING": "building", "categorical__segment_MACHINERY": "machinery"}
ORACLES["shap_tables_fixed"] = f"""{PHI}, e AS (SELECT avg(phi_building + phi_machinery) FILTER (segment NOT IN ('BUILDING', 'MACHINERY'))
     - avg(phi_building + phi_machinery) FILTER (segment IN ('BUILDING', 'MACHINERY')) AS x FROM f)
{union(f"SELECT '{name}' AS feature, 'mean_abs_phi' AS metric, round(avg(abs(phi_{c})), 6) AS value FROM f" for name, c in _names.items())}
UNION ALL SELECT 'categorical__segment_BUILDING', 'mean_phi', round(avg(phi_building), 6) FROM f WHERE segment = 'BUILDING'
UNION ALL SELECT 'categorical__segment_MACHINERY', 'mean_phi', round(avg(phi_machinery), 6) FROM f WHERE segment = 'MACHINERY'
UNION ALL SELECT CASE WHEN x > 0.01 THEN 'RAISES' WHEN x < -0.01 THEN 'LOWERS' ELSE 'MINIMAL' END, 'effect', round(x, 6) FROM e"""


def splits(rows: str, name: str) -> str:
    """Every split of each node of ``rows`` (node, g, h and the features), with the gain at the default penalties."""
    def shrunk(x: str) -> str:
        return f"(sign({x}) * greatest(abs({x}) - 1, 0))"

    places = ["qty", "closed", "urgent", "rflag_N", "rflag_R"]
    return f"""{name}_u AS ({union(f"SELECT node, '{f}' AS feature, {i} AS place, {f} AS value, g, h FROM {rows}" for i, f in enumerate(places))}),
{name}_v AS (SELECT node, feature, place, value, sum(g) AS g, sum(h) AS h FROM {name}_u GROUP BY ALL),
{name}_w AS (SELECT *, sum(g) OVER e AS gl, sum(h) OVER e AS hl, sum(g) OVER f AS gt, sum(h) OVER f AS ht FROM {name}_v
  WINDOW e AS (PARTITION BY node, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY node, feature)),
{name}_x AS (SELECT *, gt - gl AS gr, ht - hl AS hr FROM {name}_w WHERE gl IS NOT NULL),
{name} AS (SELECT node, feature, place, value AS cut, hl, hr, -{shrunk('gl')} / (hl + 1) AS wl, -{shrunk('gr')} / (hr + 1) AS wr,
  0.5 * (pow({shrunk('gl')}, 2) / (hl + 1) + pow({shrunk('gr')}, 2) / (hr + 1) - pow({shrunk('gt')}, 2) / (ht + 1)) - 0.1 AS gain
  FROM {name}_x WHERE hl >= 3 AND hr >= 3)"""


ROOT = f"""{LINE}, k AS (SELECT CAST(count(*) FILTER (outcome = 0) AS DOUBLE) / count(*) FILTER (outcome = 1) AS pw FROM c),
r AS (SELECT 1 AS node, CAST(qty AS DOUBLE) AS qty, CAST(closed AS DOUBLE) AS closed, CAST(urgent AS DOUBLE) AS urgent, CAST(rflag = 'N' AS DOUBLE) AS rflag_N,
  CAST(rflag = 'R' AS DOUBLE) AS rflag_R, CASE WHEN outcome = 1 THEN -0.5 * pw ELSE CAST(0.5 AS DOUBLE) END AS g,
  CASE WHEN outcome = 1 THEN 0.25 * pw ELSE CAST(0.25 AS DOUBLE) END AS h FROM c CROSS JOIN k), {splits('r', 'a')}"""
ORACLES["first_split"] = f"""{ROOT}, d(direction, way) AS (VALUES ('free', 0), ('rising', 1), ('falling', -1)),
o AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY gain DESC, place, cut) AS n FROM a CROSS JOIN d
      WHERE feature <> 'qty' OR way * (wr - wl) >= 0)
SELECT direction, feature, cut, {rounded('gain', 5)}, round(wl, 5) AS left_value, round(wr, 5) AS right_value, round(hl, 5) AS left_cover,
       round(hr, 5) AS right_cover FROM o WHERE n = 1 AND gain > 0"""
ORACLES["tree_importance"] = f"""{ROOT}, o AS (SELECT *, row_number() OVER (ORDER BY gain DESC, place, cut) AS n FROM a), b AS (SELECT * FROM o WHERE n = 1 AND gain > 0),
q AS (SELECT CASE WHEN CASE b.feature WHEN 'qty' THEN qty WHEN 'closed' THEN closed WHEN 'urgent' THEN urgent WHEN 'rflag_N' THEN rflag_N ELSE rflag_R END < b.cut
      THEN 2 ELSE 3 END AS node, r.* EXCLUDE (node) FROM r CROSS JOIN b), {splits('q', 'y')},
p AS (SELECT feature, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, place, cut) AS n FROM y) WHERE n = 1 AND gain > 0
      UNION ALL SELECT feature, gain FROM b),
m AS (SELECT f.feature, coalesce(avg(gain), 0) AS g FROM (VALUES ('qty'), ('closed'), ('urgent'), ('rflag_N'), ('rflag_R')) f(feature) LEFT JOIN p ON p.feature = f.feature GROUP BY f.feature)
SELECT feature, round(g / sum(g) OVER (), 6) AS importance FROM m"""
ORACLES["missing_logit_certificate"] = f"""{LINE} SELECT f.feature, CAST(0 AS DOUBLE) AS score, count(*) AS n,
       count(*) FILTER (qty IS NOT NULL AND price IS NOT NULL AND closed IS NOT NULL AND urgent IS NOT NULL) AS n_used,
       count(*) FILTER (qty IS NULL OR price IS NULL OR closed IS NULL OR urgent IS NULL) AS n_lacking
FROM c CROSS JOIN (VALUES ('intercept'), ('qty'), ('price'), ('closed'), ('urgent')) f(feature) GROUP BY f.feature"""


def finding(name: str, subject: str, metric: str, value: str, threshold: str, verdict: str, source: str) -> str:
    return (f"SELECT {name} AS finding, {subject} AS subject, {metric} AS metric, round(CAST({value} AS DOUBLE), 6) AS value, "
            f"CAST({threshold} AS DOUBLE) AS threshold, {verdict} AS verdict FROM ({source})")


_pairs_of = [(a, b) for i, a in enumerate([*LINE_FEATURES, "outcome"]) for b in [*LINE_FEATURES, "outcome"][i + 1:]]
_collinear = f"""{CODED}, m AS ({union(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM f" for a, b in _pairs_of)}) SELECT * FROM m WHERE abs(r) > 0.8"""
ORACLES["profile_report"] = union([
    finding("'missing values'", "feature", "'missing percent'", "missing_pct", "5", "advice", ORACLES["missing_profile"]),
    finding("'encoding'", "feature", "'distinct values'", "unique_values", "NULL", "encoding", ORACLES["cardinality_profile"]),
    finding("'class balance'", "'label'", "'negatives per positive'", "imbalance_ratio", "10", "severity || ': ' || recommendation", ORACLES["class_balance"]),
    finding("'target correlation'", "feature", "'r'", "r", "NULL", "strength || ' ' || direction", ORACLES["target_corr"]),
    finding("'collinear pair'", "a || ', ' || b", "'r'", "r", "0.8", "'monitor during importance analysis'", _collinear),
    finding("'scaling'", "feature", "'normality p'", "p_value", "0.05", "recommendation", ORACLES["distribution_table"])
    + f" WHERE feature IN (SELECT feature FROM ({ORACLES['cardinality_profile']}) WHERE family = 'Continuous')"])

_flagged = f"WITH c AS (SELECT *, CASE WHEN rate IS NULL THEN 1 ELSE 0 END AS miss FROM ({LINE_SQL}))"
_association = cells(_flagged, ["segment", "rflag", "ptype"], "miss") + f""", y AS (SELECT s.variable, {chi_square_p('chi2', '(nr - 1) * (nk - 1)')} AS p
FROM s JOIN x ON s.variable = x.variable) SELECT * FROM y"""
_said = "CASE WHEN {} THEN 'significant' ELSE 'not significant' END"
_linked = f"(SELECT string_agg(feature, ', ' ORDER BY feature) FROM ({ORACLES['point_biserial']}) WHERE significant)"
_mechanism = f"""CASE WHEN is_mcar THEN 'standard imputation is safe: missing completely at random'
  WHEN {_linked} IS NOT NULL THEN 'missing at random; goes with ' || {_linked} || ': model-based or multiple imputation, keep a missing flag'
  ELSE 'not completely at random, no linked variable: multiple imputation' END"""
ORACLES["missingness_report"] = union([
    finding("'segment and outcome'", "variable", "'chi-square p'", "p_value", "0.05", "CASE WHEN significant THEN 'keep BUILDING as a level of its own' "
            "ELSE 'keep BUILDING as a level or impute it' END", ORACLES["chi_square_p_values"]) + " WHERE variable = 'segment'",
    finding("'BUILDING against other levels'", "other_level", "'chi-square p'", "p_value", "0.05", _said.format("significant"), ORACLES["pairwise_chi_square"]),
    finding("'missing rate'", "'rate'", "'pattern test p'", "p_value", "0.05", _mechanism, ORACLES["mcar_test"]),
    finding("'missing rate'", "'rate'", "'missing percent'", "missing_pct", "NULL", "NULL", ORACLES["missing_share"]),
    finding("'missing rate and numeric'", "feature", "'correlation p'", "p_value", "0.05", _said.format("significant"), ORACLES["point_biserial"]),
    finding("'missing rate and numeric'", "feature", "'t-test p'", "p_value", "0.05", _said.format("significant"), ORACLES["t_test_missing"]),
    finding("'missing rate and category'", "variable", "'chi-square p'", "p", "0.05", _said.format("p < 0.05"), _association)])
