"""Queries of override rules, selectors, deltas and gates."""

from pyspark.sql import functions as F

from textloom.operators import metrics as M
from textloom.operators import rules as R
from textloom.plans.feature_queries import BUCKET_SQL, surfaced
from textloom.plans.registry import query
from textloom.plans.views import RUNS, probability

_P = ", ".join(f"CAST((id * {a}) % {m} AS DOUBLE) / {m} AS p_{r}" for r, (a, m) in RUNS.items())
_ROWS = f"SELECT id, label, domain, bucket, length_words, p_step7, p_tfidf AS p_oof, p_neural AS p_roberta, p_round4 AS p_electra, p_guard, CAST(p_step7 >= 0.55 AS INT) AS pred_step7 FROM (SELECT *, {_P} FROM ({BUCKET_SQL}) WHERE label IS NOT NULL)"
_LEDGER = f"SELECT id, label, domain, bucket, length_words AS words, p_step7, pred_step7 AS step7_pred, CAST(p_electra >= 0.5 AS INT) AS new_pred, p_electra AS new_p, p_electra - p_step7 AS delta, p_guard AS p_unsafe, p_oof AS p_human, p_roberta AS p_safe FROM ({_ROWS})"
_N = lambda c: f"CAST(coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def rows(spark, sf):
    own = surfaced(spark, sf).where("label is not null")
    names = {"p_step7": "step7", "p_oof": "tfidf", "p_roberta": "neural", "p_electra": "round4", "p_guard": "guard"}
    own = own.withColumns({c: probability(r) for c, r in names.items()}).withColumn("pred_step7", (F.col("p_step7") >= 0.55).cast("int"))
    return own.select("id", "label", "domain", "bucket", "length_words", *names, "pred_step7")


def ledger(spark, sf):
    own = rows(spark, sf)
    return own.select("id", "label", "domain", "bucket", F.col("length_words").alias("words"), "p_step7", F.col("pred_step7").alias("step7_pred"), (F.col("p_electra") >= 0.5).cast("int").alias("new_pred"), F.col("p_electra").alias("new_p"), (F.col("p_electra") - F.col("p_step7")).alias("delta"), F.col("p_guard").alias("p_unsafe"), F.col("p_oof").alias("p_human"), F.col("p_roberta").alias("p_safe"))


_GUARD = {"oof_threshold": 0.5, "roberta_threshold": 0.45, "electra_threshold": 0.4, "high_risk_threshold_add": 0.1, "max_disagreement": 0.6, "min_votes": 2, "min_words": 20}
_ADD = "CASE WHEN bucket IN ('academic_formal', 'literary_old_prose', 'literary_short_fragment', 'ornate_literary_prose', 'poetry_classical', 'poetry_freeverse', 'short_fragment') THEN 0.1 ELSE 0.0 END::DOUBLE"


@query("fea37_precision_guard", f"SELECT id, override, CAST(votes AS INT) AS votes, CASE WHEN override THEN 1 ELSE pred_step7 END AS prediction, round(CASE WHEN override THEN greatest(p_step7, p_oof, p_roberta, p_electra) ELSE p_step7 END, 9) AS probability FROM (SELECT *, pred_step7 = 0 AND votes >= 2 AND p_oof >= 0.5 + a AND greatest(p_oof, p_roberta, p_electra) - least(p_oof, p_roberta, p_electra) <= 0.6 AND length_words >= 20 AS override FROM (SELECT *, (CASE WHEN p_oof >= 0.5 + a THEN 1 ELSE 0 END) + (CASE WHEN p_roberta >= 0.45 + a THEN 1 ELSE 0 END) + (CASE WHEN p_electra >= 0.4 + a THEN 1 ELSE 0 END) AS votes FROM (SELECT *, {_ADD} AS a FROM ({_ROWS}))))")
def precision_guard(spark, sf):
    g = R.guarded(_GUARD)
    return rows(spark, sf).select("id", g["override"].alias("override"), g["votes"].alias("votes"), g["prediction"].alias("prediction"), F.round(g["probability"], 9).alias("probability"))


_RES = {"bucket_group": "literary_poetry", "threshold": 0.5, "min_delta": 0.05, "unsafe_max": 0.8, "human_style_max": 0.9, "min_words": 10}
_RES_SQL = "step7_pred = 0 AND new_pred = 1 AND bucket IN ('literary_old_prose', 'literary_short_fragment', 'poetry_classical', 'poetry_freeverse') AND new_p >= 0.5 AND delta >= 0.05 AND p_unsafe <= 0.8 AND p_human <= 0.9 AND words >= 10"


@query("fea38_residual_override", f"SELECT id, {_RES_SQL} AS override FROM ({_LEDGER})")
def residual(spark, sf):
    return ledger(spark, sf).select("id", R.residual_override(_RES).alias("override"))


_POL = {"bucket_policy": "old_short_plus_general_strict", "unsafe_max": 0.9, "human_style_max": 0.95, "safe_min": 0.1, "threshold": 0.5, "min_delta": 0.0, "general_safe_min": 0.3, "general_unsafe_max": 0.7, "general_threshold": 0.6, "general_min_delta": 0.1}
_POL_SQL = "step7_pred = 0 AND new_pred = 1 AND (bucket IN ('literary_short_fragment', 'literary_old_prose') OR (bucket = 'general_prose' AND p_safe >= 0.3 AND p_unsafe <= 0.7 AND new_p >= 0.6 AND delta >= 0.1)) AND p_unsafe <= 0.9 AND p_human <= 0.95 AND p_safe >= 0.1 AND new_p >= 0.5 AND delta >= 0.0"


@query("flt29_policy_override", f"SELECT id, {_POL_SQL} AS override FROM ({_LEDGER})")
def policy(spark, sf):
    return ledger(spark, sf).select("id", R.policy_override(_POL).alias("override"))


@query("agg23_override_delta", f"SELECT domain, {_N('o')} AS overrides, {_N('o AND label = 1')} AS fixed_fn, {_N('o AND label = 0')} AS induced_fp FROM (SELECT *, {_POL_SQL} AS o FROM ({_LEDGER})) GROUP BY domain")
def override_delta(spark, sf):
    own = ledger(spark, sf).withColumn("o", R.policy_override(_POL))
    n = lambda c: F.coalesce(F.sum(F.when(F.expr(c), 1).otherwise(0)), F.lit(0)).cast("long")
    return own.groupBy("domain").agg(n("o").alias("overrides"), n("o and label = 1").alias("fixed_fn"), n("o and label = 0").alias("induced_fp"))


@query("fea39_routed_threshold", f"SELECT id, CAST(p_step7 >= CASE bucket WHEN 'poetry_freeverse' THEN 0.7 WHEN 'general_prose' THEN 0.4 ELSE 0.55 END AS INT) AS pred FROM ({_ROWS})")
def routed(spark, sf):
    return rows(spark, sf).select("id", R.routed("p_step7", "bucket", {"poetry_freeverse": 0.7, "general_prose": 0.4}, 0.55).alias("pred"))


@query("fea36_fused", f"SELECT id, round(0.5 * p_roberta + 0.5 * p_oof, 9) AS p, CAST(0.5 * p_roberta + 0.5 * p_oof >= 0.55 AS INT) AS pred FROM ({_ROWS})")
def fused(spark, sf):
    p = R.fuse(0.5, "p_roberta", "p_oof")
    return rows(spark, sf).select("id", F.round(p, 9).alias("p"), (p >= 0.55).cast("int").alias("pred"))


_SEL = f"SELECT *, p_step7 BETWEEN 0.35 AND 0.65 AND greatest(p_guard, 1 - p_guard) >= 0.7 AS u, CAST(p_step7 >= 0.5 AS INT) AS a FROM ({_ROWS})"
_FIN = f"SELECT *, CASE WHEN u THEN CAST(p_guard >= 0.5 AS INT) ELSE a END AS b FROM ({_SEL})"


@query("fea40_selector", f"SELECT id, u AS use_selector, b AS final_pred, round(CASE WHEN u THEN p_guard ELSE p_step7 END, 9) AS final_p FROM ({_FIN})")
def selector(spark, sf):
    s = R.selected("p_step7", "p_guard", 0.7)
    return rows(spark, sf).select("id", s["use_selector"].alias("use_selector"), s["final_pred"].alias("final_pred"), F.round(s["final_p"], 9).alias("final_p"))


@query("agg24_selector_delta", f"SELECT {_N('a = label')} AS before_correct, {_N('b = label')} AS after_correct, {_N('b = label')} - {_N('a = label')} AS net_gain, {_N('a <> label AND b = label')} AS fixed, {_N('a = label AND b <> label')} AS broken, {_N('label = 1 AND a = 0 AND b = 1')} AS fixed_fn, {_N('label = 0 AND a = 1 AND b = 0')} AS fixed_fp, {_N('label = 0 AND a = 0 AND b = 1')} AS new_fp, {_N('label = 1 AND a = 1 AND b = 0')} AS new_fn FROM ({_FIN})")
def selector_delta(spark, sf):
    own = rows(spark, sf).withColumn("a", (F.col("p_step7") >= 0.5).cast("int")).withColumn("b", R.selected("p_step7", "p_guard", 0.7)["final_pred"])
    return R.delta(own, "a", "b")


_GRID = R.grid(threshold=[0.5, 0.6, 0.7], min_delta=[0.0, 0.1], unsafe_max=[0.5, 0.9])


@query("jn21_rule_search", f"WITH g AS (SELECT CAST(row_number() OVER (ORDER BY t, d, u) - 1 AS INT) AS rule, t, d, u FROM (SELECT unnest([0.5, 0.6, 0.7]) AS t) CROSS JOIN (SELECT unnest([0.0, 0.1]) AS d) CROSS JOIN (SELECT unnest([0.5, 0.9]) AS u)) SELECT rule, {_N('o')} AS overrides, {_N('o AND label = 1')} AS fixed_fn, {_N('o AND label = 0')} AS induced_fp FROM (SELECT rule, label, step7_pred = 0 AND new_pred = 1 AND new_p >= t AND delta >= d AND p_unsafe <= u AND p_human <= 0.9 AS o FROM ({_LEDGER}) CROSS JOIN g) GROUP BY rule")
def rule_search(spark, sf):
    return R.search(ledger(spark, sf), _GRID, lambda r: R.residual_override(r | {"human_style_max": 0.9}))


_AXES = {"t": [round(0.05 * k, 2) for k in range(20)], "d": [round(-0.9 + 0.2 * k, 1) for k in range(10)], "u": [round(0.1 * k, 1) for k in range(10, 0, -1)], "h": [0.2, 0.4, 0.6, 0.8, 1.0]}


@query("ml25_rule_cube", f"WITH g AS (SELECT CAST(row_number() OVER (ORDER BY t, d, u DESC, h) - 1 AS INT) AS rule, t, d, u, h FROM {' CROSS JOIN '.join(f'(SELECT unnest([{", ".join(f"{v}::DOUBLE" for v in vs)}]) AS {n})' for n, vs in _AXES.items())}), o AS (SELECT rule, count(*) AS n, count(*) FILTER (label = 1) AS f, count(*) FILTER (label = 0) AS i FROM (SELECT label, new_p, delta, coalesce(p_unsafe, 1.0) AS pu, coalesce(p_human, 1.0) AS ph FROM ({_LEDGER}) WHERE step7_pred = 0 AND new_pred = 1) CROSS JOIN g WHERE new_p >= t AND delta >= d AND pu <= u AND ph <= h GROUP BY rule) SELECT rule, t, d, u, h, coalesce(n, 0) AS overrides, coalesce(f, 0) AS fixed_fn, coalesce(i, 0) AS induced_fp FROM g LEFT JOIN o USING (rule)")
def rule_cube(spark, sf):
    """Ten thousand rules from one aggregation."""
    one = F.lit(1.0)
    axes = {"t": (F.col("new_p"), ">=", _AXES["t"]), "d": (F.col("delta"), ">=", _AXES["d"]), "u": (F.coalesce("p_unsafe", one), "<=", _AXES["u"]), "h": (F.coalesce("p_human", one), "<=", _AXES["h"])}
    return R.cube(ledger(spark, sf), (F.col("step7_pred") == 0) & (F.col("new_pred") == 1), axes)


@query("agg34_gates", f"SELECT unnest(['accuracy', 'fp', 'recall']) AS gate, unnest([0.5, 200.0, 0.9])::DOUBLE AS required, unnest([(tp + tn)::DOUBLE / (tp + fp + fn + tn), fp::DOUBLE, tp::DOUBLE / (tp + fn)]) AS observed, unnest([(tp + tn)::DOUBLE / (tp + fp + fn + tn) >= 0.5, fp <= 200, tp::DOUBLE / (tp + fn) >= 0.9]) AS passed FROM (SELECT {_N('label = 1 AND pred_step7 = 1')} AS tp, {_N('label = 0 AND pred_step7 = 1')} AS fp, {_N('label = 1 AND pred_step7 = 0')} AS fn, {_N('label = 0 AND pred_step7 = 0')} AS tn FROM ({_ROWS}))")
def gates(spark, sf):
    return R.gates(M.metrics(rows(spark, sf), pred="pred_step7"), {"accuracy": (">=", 0.5), "fp": ("<=", 200), "recall": (">=", 0.9)})
