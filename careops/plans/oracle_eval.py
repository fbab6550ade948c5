"""DuckDB oracle SQL for evaluation (V2-V5, V7) on rule predictions and governance."""

from careops import schema as S
from careops.plans.oracle_drift import K
from careops.plans.oracle_features import SPLIT_SQL
from careops.sources.fixtures import with_fixtures

EVAL_SQL = SPLIT_SQL + """,
scored AS (SELECT *,
  CASE risk_score WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS risk_label,
  CASE claim_status WHEN 'Paid' THEN 0 WHEN 'Pending' THEN 1 WHEN 'Rejected' THEN 2 END AS claim_label,
  CASE WHEN length_of_stay_hours >= 40 THEN 2 WHEN length_of_stay_hours >= 20 THEN 1 ELSE 0 END AS risk_pred,
  CASE WHEN risk_score = 'High' THEN 2 WHEN visit_type = 'ER' THEN 1 ELSE 0 END AS claim_pred
  FROM mt WHERE risk_score IS NOT NULL AND claim_status IS NOT NULL),
ev AS (SELECT * FROM scored WHERE split = 'test')"""


def _names(classes):
    return "[" + ", ".join(f"'{c}'" for c in classes) + "]"


def _report(actual: str, pred: str, classes) -> str:
    k = len(classes)
    return with_fixtures(EVAL_SQL + f""",
conf AS (SELECT {actual} AS actual, {pred} AS predicted, COUNT(*) AS n FROM ev GROUP BY 1, 2),
cs AS (SELECT label, SUM(tp) AS tp, SUM(support) AS support, SUM(pred_n) AS pred_n FROM (
  SELECT actual AS label, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp, n AS support, 0 AS pred_n FROM conf
  UNION ALL SELECT predicted, 0, 0, n FROM conf) t GROUP BY label),
p1 AS (SELECT label, tp, support, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM cs),
p2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0.0 END AS f1_score FROM p1),
pc AS (SELECT {_names(classes)}[label + 1] AS label, precision, recall, f1_score, support FROM p2
  WHERE label BETWEEN 0 AND {k - 1})""", """
SELECT label, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1_score, 6) AS f1_score,
  CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND((SELECT SUM(tp) / SUM(support) FROM p2), 6),
  CAST(SUM(support) AS BIGINT) FROM pc
UNION ALL SELECT 'macro avg', ROUND(AVG(precision), 6), ROUND(AVG(recall), 6), ROUND(AVG(f1_score), 6),
  CAST(SUM(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', ROUND(SUM(precision * support) / SUM(support), 6),
  ROUND(SUM(recall * support) / SUM(support), 6), ROUND(SUM(f1_score * support) / SUM(support), 6),
  CAST(SUM(support) AS BIGINT) FROM pc""")


def _matrix(actual: str, pred: str, classes, normalize: bool) -> str:
    k = len(classes)
    if normalize:
        cells = ", ".join(
            f"ROUND(COALESCE(SUM(n) FILTER (WHERE predicted = {i}), 0) / NULLIF(COALESCE(SUM(n), 0), 0), 6)"
            f" AS pred_{c}" for i, c in enumerate(classes))
    else:
        cells = ", ".join(f"CAST(COALESCE(SUM(n) FILTER (WHERE predicted = {i}), 0) AS BIGINT) AS pred_{c}"
                          for i, c in enumerate(classes))
    return with_fixtures(EVAL_SQL + f""",
conf AS (SELECT {actual} AS actual, {pred} AS predicted, COUNT(*) AS n FROM ev GROUP BY 1, 2),
grid AS (SELECT UNNEST(range({k})) AS actual)""", f"""
SELECT {_names(classes)}[g.actual + 1] AS actual, {cells}
FROM grid g LEFT JOIN conf c ON g.actual = c.actual GROUP BY g.actual""")


V = {}
V["v02_report_risk_rule"] = _report("risk_label", "risk_pred", S.RISK_CLASSES)
V["v02_report_claim_rule"] = _report("claim_label", "claim_pred", S.CLAIM_CLASSES)
V["v03_confusion_claim_rule"] = _matrix("claim_label", "claim_pred", S.CLAIM_CLASSES, False)
V["v04_normalized_confusion_risk_rule"] = _matrix("risk_label", "risk_pred", S.RISK_CLASSES, True)

V["v05_revenue_protection_rule"] = with_fixtures(EVAL_SQL, """
SELECT CAST(COALESCE(SUM(billed_amount) FILTER (WHERE claim_label = 2), 0) AS DOUBLE) AS total_rejected_billed,
  CAST(COALESCE(SUM(billed_amount) FILTER (WHERE claim_label = 2 AND claim_pred = 2), 0) AS DOUBLE)
    AS flagged_rejected_billed,
  ROUND(CAST(COALESCE(SUM(billed_amount) FILTER (WHERE claim_label = 2 AND claim_pred = 2), 0) AS DOUBLE) * 100
    / NULLIF(CAST(COALESCE(SUM(billed_amount) FILTER (WHERE claim_label = 2), 0) AS DOUBLE), 0.0), 4) AS flagged_pct
FROM ev""")

V["v07_fairness_claim_rule"] = with_fixtures(EVAL_SQL + """,
long AS (SELECT claim_label AS a, claim_pred AS p, 'gender' AS segment, gender AS segment_value FROM ev
  UNION ALL SELECT claim_label, claim_pred, 'city', city FROM ev
  UNION ALL SELECT claim_label, claim_pred, 'insurance_provider', insurance_provider FROM ev),
conf AS (SELECT segment, segment_value, a AS actual, p AS predicted, COUNT(*) AS n FROM long
  WHERE segment_value IS NOT NULL GROUP BY ALL),
cs AS (SELECT segment, segment_value, label, SUM(tp) AS tp, SUM(support) AS support, SUM(pred_n) AS pred_n FROM (
  SELECT segment, segment_value, actual AS label, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp,
    n AS support, 0 AS pred_n FROM conf
  UNION ALL SELECT segment, segment_value, predicted, 0, 0, n FROM conf) t GROUP BY ALL),
p1 AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM cs),
p2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0.0 END AS f1_score FROM p1)""", """
SELECT segment, segment_value, CAST(SUM(support) AS BIGINT) AS volume,
  ROUND(SUM(tp) / SUM(support), 6) AS accuracy, ROUND(SUM(f1_score * support) / SUM(support), 6) AS weighted_f1,
  ROUND(MAX(CASE WHEN label = 2 AND support > 0 THEN recall END), 6) AS positive_recall
FROM p2 GROUP BY segment, segment_value HAVING SUM(support) > 0""")

W = {}
WEEKLY_SQL = EVAL_SQL + """,
wk AS (SELECT time_bucket(INTERVAL '7 days', CAST(visit_date AS TIMESTAMP), TIMESTAMP '1970-01-01') AS ws, *
  FROM ev),
weekly AS (SELECT CAST(ws AS DATE) AS week_start, CAST(ws + INTERVAL '7 days' AS DATE) AS week_end,
  COUNT(*) AS volume, ROUND(COUNT(*) FILTER (WHERE claim_label = claim_pred) / COUNT(*), 6) AS accuracy,
  ROUND(COUNT(*) FILTER (WHERE claim_label = 2 AND claim_pred = 2)
    / NULLIF(COUNT(*) FILTER (WHERE claim_label = 2), 0), 6) AS rejected_recall
  FROM wk GROUP BY ws)"""

W["w01_weekly_audit_metrics"] = with_fixtures(WEEKLY_SQL, "SELECT * FROM weekly")

W["w02_retrain_triggers"] = with_fixtures(WEEKLY_SQL + """,
tr_end AS (SELECT MAX(visit_date) AS d FROM mt WHERE split = 'train'),
psi AS (SELECT MAX("PSI") AS m FROM (""" + K["k05_drift_report"] + "))", f"""
SELECT week_start, week_end, concat_ws(';',
    CASE WHEN accuracy < {S.RETRAIN_MIN_ACCURACY} THEN 'accuracy_below_threshold' END,
    CASE WHEN rejected_recall < {S.RETRAIN_MIN_REJECTED_RECALL} THEN 'rejected_recall_below_threshold' END,
    CASE WHEN (SELECT d FROM tr_end) + INTERVAL {S.RETRAIN_MAX_AGE_MONTHS} MONTH <= week_end
         THEN 'model_older_than_6_months' END,
    CASE WHEN (SELECT m FROM psi) > {S.RETRAIN_MAX_PSI} THEN 'psi_above_threshold' END) AS reasons,
  (accuracy < {S.RETRAIN_MIN_ACCURACY} OR COALESCE(rejected_recall < {S.RETRAIN_MIN_REJECTED_RECALL}, FALSE)
   OR (SELECT d FROM tr_end) + INTERVAL {S.RETRAIN_MAX_AGE_MONTHS} MONTH <= week_end
   OR (SELECT m FROM psi) > {S.RETRAIN_MAX_PSI}) AS retrain
FROM weekly""")

W["w03_training_pull"] = with_fixtures(SPLIT_SQL, """
SELECT visit_id, bill_id, visit_date, claim_status FROM master
WHERE visit_date > (SELECT MAX(visit_date) FROM master) - INTERVAL 6 MONTH
  AND (claim_status IS NULL OR claim_status <> 'Pending')
  AND NOT COALESCE(age < 0 OR age > 120, FALSE)
  AND NOT (gender IS NULL OR gender NOT IN ('M', 'F'))
  AND NOT (chronic_flag IS NULL OR chronic_flag NOT IN (0, 1))
  AND NOT COALESCE(length_of_stay_hours <= 0, FALSE)
  AND NOT (risk_score IS NULL OR risk_score NOT IN ('Low', 'Medium', 'High'))
  AND NOT COALESCE(billed_amount < 0, FALSE)
  AND NOT COALESCE(approved_amount > billed_amount, FALSE)
  AND NOT COALESCE(payment_days < 0, FALSE)""")

W["w04_promotion_gate"] = with_fixtures(EVAL_SQL, f"""
SELECT COUNT(*) AS rows, ROUND(COUNT(*) FILTER (WHERE claim_label = 0) / COUNT(*), 6) AS active_accuracy,
  ROUND(COUNT(*) FILTER (WHERE claim_label = claim_pred) / COUNT(*), 6) AS candidate_accuracy,
  COUNT(*) FILTER (WHERE claim_label = claim_pred) / COUNT(*)
    >= COUNT(*) FILTER (WHERE claim_label = 0) / COUNT(*) - {S.PROMOTION_TOLERANCE} AS promote
FROM ev""")

W["w01_late_outcomes_stream"] = with_fixtures(EVAL_SQL + """,
timed AS (SELECT *, billing_date BETWEEN visit_date AND visit_date + INTERVAL 60 DAY AS in_time,
  time_bucket(INTERVAL '7 days', CAST(visit_date AS TIMESTAMP), TIMESTAMP '1970-01-01') AS ws FROM ev)""", """
SELECT CAST(ws AS DATE) AS week_start, CAST(ws + INTERVAL '7 days' AS DATE) AS week_end,
  COUNT(*) FILTER (WHERE in_time) AS volume,
  ROUND(COUNT(*) FILTER (WHERE in_time AND claim_label = claim_pred) / COUNT(*) FILTER (WHERE in_time), 6) AS accuracy,
  ROUND(COUNT(*) FILTER (WHERE in_time AND claim_label = 2 AND claim_pred = 2)
    / NULLIF(COUNT(*) FILTER (WHERE in_time AND claim_label = 2), 0), 6) AS rejected_recall,
  COUNT(*) FILTER (WHERE billing_date > visit_date + INTERVAL 60 DAY) AS late
FROM timed GROUP BY ws HAVING COUNT(*) FILTER (WHERE in_time) > 0""")
