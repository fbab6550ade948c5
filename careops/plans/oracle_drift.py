"""DuckDB oracle SQL for the drift report (K1-K5): train rows as reference, test rows as production.

The p-value of samples of up to 10,000 values is exact: row by row, in how many ways the lattice
paths come to each point inside the band.
"""

from careops import schema as S
from careops.plans.oracle_features import MODEL_TABLE_SQL
from careops.sources.fixtures import with_fixtures

_PROBS = ", ".join(str(i / S.PSI_BINS) for i in range(S.PSI_BINS + 1))


def _sides(c: str, cast: str) -> str:
    return f"""
r_{c} AS (SELECT {cast} AS v FROM model_table WHERE split = 'train' AND {c} IS NOT NULL),
p_{c} AS (SELECT {cast} AS v FROM model_table WHERE split = 'test' AND {c} IS NOT NULL),
n_{c} AS (SELECT (SELECT COUNT(*) FROM r_{c}) AS nr, (SELECT COUNT(*) FROM p_{c}) AS np),
sr_{c} AS (SELECT v, COUNT(*) / (SELECT nr FROM n_{c}) AS e FROM r_{c} GROUP BY v),
sp_{c} AS (SELECT v, COUNT(*) / (SELECT np FROM n_{c}) AS a FROM p_{c} GROUP BY v),
cat_{c} AS (SELECT COALESCE(SUM((COALESCE(a, {S.PSI_MISSING_SHARE}) - COALESCE(e, {S.PSI_MISSING_SHARE}))
  * ln(COALESCE(a, {S.PSI_MISSING_SHARE}) / COALESCE(e, {S.PSI_MISSING_SHARE}))), 0.0) AS psi
  FROM sr_{c} FULL OUTER JOIN sp_{c} ON sr_{c}.v = sp_{c}.v)"""


def _numeric(c: str) -> str:
    return _sides(c, f"CAST({c} AS DOUBLE)") + f""",
cum_{c} AS (SELECT v, SUM(SUM(a)) OVER (ORDER BY v) AS ca, SUM(SUM(b)) OVER (ORDER BY v) AS cb
  FROM (SELECT v, 1 AS a, 0 AS b FROM r_{c} UNION ALL SELECT v, 0, 1 FROM p_{c}) GROUP BY v),
ks_{c} AS (SELECT COALESCE(MAX(ABS(ca / nr - cb / np)), 0.0) AS d, ANY_VALUE(nr) AS nr, ANY_VALUE(np) AS np
  FROM cum_{c}, n_{c}),
x_{c} AS (SELECT d, en, sqrt(en) * d AS x
  FROM (SELECT d, GREATEST(round_even(CAST(nr AS DOUBLE) * np / (nr + np), 0), 1) AS en FROM ks_{c})),
pg_{c} AS (SELECT d, x, en, pow((k + 0.5) * pi(), 2) AS h, pow(k * pi(), 2) AS g FROM x_{c}, range(0, 61) t(k) WHERE x > 0),
ps_{c} AS (SELECT SUM(exp(-h / (2 * x * x)) * (2 / x + (h - x * x) / (3 * pow(x, 4) * sqrt(en))
    + (6 * pow(x, 6) + 2 * pow(x, 4) + (2 * pow(x, 4) - 5 * x * x) * h + (1 - 2 * x * x) * h * h) / (36 * pow(x, 7) * en)
    + ((5 - 30 * x * x) * pow(h, 3) + (212 * pow(x, 4) - 60 * x * x) * h * h + (135 * pow(x, 4) - 96 * pow(x, 6)) * h
       - 30 * pow(x, 6) - 90 * pow(x, 8)) / (3240 * pow(x, 10) * pow(en, 1.5)))
  + exp(-g / (2 * x * x)) * (-g / (18 * pow(x, 3) * en) + (3 * g * x * x - g * g) / (54 * pow(x, 6) * pow(en, 1.5)))) AS s
  FROM pg_{c}),
ex_{c} AS (
  WITH RECURSIVE size AS (SELECT nr, np, CAST(round(d * nr * np) AS BIGINT) AS least FROM ks_{c}
    WHERE nr BETWEEN 1 AND 10000 AND np BETWEEN 1 AND 10000),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS lo, 0.0::DOUBLE AS scale,
      list_transform(range(0, LEAST(np, (least - 1) // nr) + 1), lambda j: 1.0::DOUBLE) AS ways FROM size WHERE least > 0
    UNION ALL
    SELECT i, lo, scale + ln(list_max(ways)), list_transform(ways, lambda w: w / list_max(ways)) FROM (
      SELECT walk.i + 1 AS i, b.lo, scale,
        list_transform(range(b.lo, b.hi + 1), lambda j: list_sum(ways[b.lo - walk.lo + 1:j - walk.lo + 1])) AS ways
      FROM walk, size, LATERAL (SELECT CAST(GREATEST(0, CEIL(((walk.i + 1) * np - least + 1) / nr)) AS BIGINT) AS lo,
                                LEAST(np, ((walk.i + 1) * np + least - 1) // nr) AS hi) b
      WHERE walk.i < nr))
  SELECT CASE WHEN least <= 0 THEN 1.0 ELSE GREATEST(0.0, 1 - (SELECT exp(ln(ways[len(ways)]) + scale
      - lgamma(nr + np + 1) + lgamma(nr + 1) + lgamma(np + 1)) FROM walk WHERE i = nr)) END AS p FROM size),
pv_{c} AS (SELECT d, CASE WHEN EXISTS (SELECT 1 FROM ex_{c}) THEN (SELECT p FROM ex_{c}) WHEN x < 0.1 THEN 1.0 WHEN x > 15 THEN 0.0
  ELSE GREATEST(0.0, LEAST(1.0, 1 - sqrt(pi() / 2) * (SELECT s FROM ps_{c}))) END AS p FROM x_{c}),
ed_{c} AS (SELECT list_sort(list_distinct(quantile_cont(v, [{_PROBS}]))) AS e FROM r_{c}),
bd_{c} AS (SELECT e, len(e) - 1 AS nb FROM ed_{c}),
br_{c} AS (SELECT len(list_filter(e[2:len(e) - 1], lambda x: x <= v)) AS bin, COUNT(*) AS cnt
  FROM r_{c}, bd_{c} WHERE v >= e[1] AND v <= e[len(e)] GROUP BY bin),
bp_{c} AS (SELECT len(list_filter(e[2:len(e) - 1], lambda x: x <= v)) AS bin, COUNT(*) AS cnt
  FROM p_{c}, bd_{c} WHERE v >= e[1] AND v <= e[len(e)] GROUP BY bin),
gr_{c} AS (SELECT UNNEST(range(nb)) AS bin FROM bd_{c}),
num_{c} AS (SELECT CASE WHEN (SELECT nb FROM bd_{c}) < 1 THEN 0.0 ELSE SUM((a - ee) * ln(a / ee)) END AS psi
  FROM (SELECT (COALESCE(br.cnt, 0) + 0.5) / (nr + 0.5 * nb) AS ee, (COALESCE(bp.cnt, 0) + 0.5) / (np + 0.5 * nb) AS a
        FROM gr_{c} g LEFT JOIN br_{c} br ON g.bin = br.bin LEFT JOIN bp_{c} bp ON g.bin = bp.bin, n_{c}, bd_{c})),
psi_{c} AS (SELECT CASE WHEN (SELECT COUNT(DISTINCT v) FROM r_{c}) < {S.PSI_MIN_DISTINCT}
  THEN (SELECT psi FROM cat_{c}) ELSE (SELECT psi FROM num_{c}) END AS psi)"""


def _numeric_row(c: str) -> str:
    return f"""SELECT 'Feature_Numeric' AS MetricType, '{c}' AS Feature, 'Kolmogorov-Smirnov' AS Method,
  round_even(d, 4) AS Statistic, round_even(p, 6) AS PValue, round_even((SELECT psi FROM psi_{c}), 4) AS PSI,
  CAST(CASE WHEN p < {S.KS_ALPHA} THEN 1 ELSE 0 END AS INT) AS DriftDetected,
  CASE WHEN p < {S.KS_ALPHA} THEN 'Drift Detected' ELSE 'Stable' END AS DriftStatus FROM pv_{c}"""


def _categorical_row(c: str) -> str:
    return f"""SELECT 'Feature_Categorical', '{c}', 'Population Stability Index', round_even(psi, 4),
  CAST(NULL AS DOUBLE), round_even(psi, 4),
  CAST(CASE WHEN psi >= {S.PSI_SIGNIFICANT} THEN 1 ELSE 0 END AS INT),
  CASE WHEN psi >= {S.PSI_SIGNIFICANT} THEN 'Significant Drift'
       WHEN psi >= {S.PSI_MODERATE} THEN 'Moderate Drift (Warning)' ELSE 'Stable' END FROM cat_{c}"""


K = {}
K["k05_drift_report"] = with_fixtures(
    MODEL_TABLE_SQL + "," + ",".join(_numeric(c) for c in S.DRIFT_NUMERIC) + ","
    + ",".join(_sides(c, c) for c in S.DRIFT_CATEGORICAL),
    "\nUNION ALL ".join([_numeric_row(c) for c in S.DRIFT_NUMERIC]
                        + [_categorical_row(c) for c in S.DRIFT_CATEGORICAL]))
