"""Queries of run alignment and comparison."""

from pyspark.sql import functions as F

from textloom.operators import align as A
from textloom.operators import metrics as M
from textloom.plans.registry import query
from textloom.plans.views import CORPUS_SQL, RUNS, corpus, preds, run_of, run_sql

_NAMES = ["step7", "tfidf", "neural"]


def _runs(spark, sf, names=_NAMES):
    return {n: run_of(spark, sf, n) for n in names}


@query("jn01_align_two_runs", f"SELECT a.id, a.label, coalesce(a.domain, b.domain) AS domain, round(a.p, 9) AS p_step7, round(b.p, 9) AS p_tfidf, a.pred AS pred_step7, b.pred AS pred_tfidf FROM ({run_sql('step7')}) a JOIN ({run_sql('tfidf')}) b ON a.id = b.id")
def align_two(spark, sf):
    own = A.pair(run_of(spark, sf, "step7"), run_of(spark, sf, "tfidf"), ("step7", "tfidf"))
    return own.select("id", "label", "domain", F.round("p_step7", 9).alias("p_step7"), F.round("p_tfidf", 9).alias("p_tfidf"), "pred_step7", "pred_tfidf")


_MANY = f"SELECT a.id, a.label, a.p AS p_step7, b.p AS p_tfidf, c.p AS p_neural, a.pred AS pred_step7, b.pred AS pred_tfidf, c.pred AS pred_neural FROM ({run_sql('step7')}) a JOIN ({run_sql('tfidf')}) b ON a.id = b.id JOIN ({run_sql('neural')}) c ON a.id = c.id"


@query("jn02_align_all_runs", f"SELECT id, label, round(p_step7, 9) AS p_step7, round(p_tfidf, 9) AS p_tfidf, round(p_neural, 9) AS p_neural FROM ({_MANY})")
def align_all(spark, sf):
    return A.many(_runs(spark, sf)).select("id", "label", *(F.round(f"p_{n}", 9).alias(f"p_{n}") for n in _NAMES))


@query("set03_run_coverage", f"WITH u AS ({' UNION ALL '.join(f"SELECT '{n}' AS run, id FROM ({run_sql(n)})" for n in _NAMES)}) SELECT run, count(*) AS ids, (SELECT count(DISTINCT id) FROM u) - count(*) AS missing FROM u GROUP BY run")
def run_coverage(spark, sf):
    return A.coverage(_runs(spark, sf))


@query("set02_common_ids", f"SELECT id FROM ({run_sql('step7')}) INTERSECT SELECT id FROM ({run_sql('round4')})")
def common(spark, sf):
    return run_of(spark, sf, "step7").select("id").intersect(run_of(spark, sf, "round4").select("id"))


@query("jn04_aligned_inference", f"SELECT s.id, s.label, round(s.p, 9) AS p_step7, round(r.p, 9) AS p_round4, round(g.p, 9) AS p_guard, c.source FROM ({run_sql('step7')}) s JOIN ({run_sql('round4')}) r ON s.id = r.id JOIN ({run_sql('guard')}) g ON s.id = g.id LEFT JOIN (SELECT id, source FROM ({CORPUS_SQL}) WHERE domain = 'en') c ON s.id = c.id")
def inference(spark, sf):
    own = A.many(_runs(spark, sf, ["step7", "round4", "guard"])).select("id", "label", *(F.round(f"p_{n}", 9).alias(f"p_{n}") for n in ("step7", "round4", "guard")))
    return own.join(corpus(spark, sf).where("domain = 'en'").select("id", "source"), "id", "left")


@query("jn07_default_branch", f"SELECT a.id, round(a.p, 9) AS p, round(coalesce(b.p, 0.0), 9) AS p_tfidf FROM ({run_sql('step7')}) a LEFT JOIN ({run_sql('tfidf')}) b ON a.id = b.id")
def default_branch(spark, sf):
    own = A.with_branch(run_of(spark, sf, "step7"), run_of(spark, sf, "tfidf"), "p_tfidf")
    return own.select("id", F.round("p", 9).alias("p"), F.round("p_tfidf", 9).alias("p_tfidf"))


@query("jn11_fill_from_source", f"SELECT a.id, coalesce(nullif(CASE WHEN a.id % 4 = 0 THEN '' WHEN a.id % 4 = 1 THEN NULL ELSE a.domain END, ''), b.domain) AS domain FROM ({run_sql('step7')}) a LEFT JOIN ({CORPUS_SQL}) b ON a.id = b.id AND b.source <> 'src3'")
def fill(spark, sf):
    base = run_of(spark, sf, "step7").select("id", F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.col("domain")).alias("domain"))
    return A.filled(base, corpus(spark, sf).where("source <> 'src3'"), "id", ["domain"])


_N = lambda c: f"CAST(coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS BIGINT)"


@query("jn25_baseline_delta", f"SELECT {_N('la IS NOT NULL AND lb IS NOT NULL')} AS common, {_N('lb IS NULL')} AS missing, {_N('la IS NULL')} AS extra, {_N('la <> lb')} AS label_mismatch, {_N('la = lb AND la = 0 AND pa = 1 AND pb = 0')} AS fixed_fp, {_N('la = lb AND la = 0 AND pa = 0 AND pb = 1')} AS new_fp, {_N('la = lb AND la = 1 AND pa = 0 AND pb = 1')} AS fixed_fn, {_N('la = lb AND la = 1 AND pa = 1 AND pb = 0')} AS new_fn FROM (SELECT id, label AS la, pred AS pa FROM ({run_sql('step7')})) a FULL OUTER JOIN (SELECT id, label AS lb, pred AS pb FROM ({run_sql('round4')})) b USING (id)")
def baseline_delta(spark, sf):
    return A.delta(run_of(spark, sf, "step7"), run_of(spark, sf, "round4"))


_ERR = " UNION ALL ".join(f"SELECT '{n}' AS run, id FROM ({run_sql(n)}) WHERE pred <> label" for n in _NAMES)


@query("jn23_set05_error_overlap", f"WITH e AS ({_ERR}), s AS (SELECT run, count(*) AS n FROM e GROUP BY run) SELECT x.run AS a, y.run AS b, x.n AS n_a, y.n AS n_b, coalesce(o.shared, 0) AS shared, round(coalesce(o.shared, 0)::DOUBLE / nullif(x.n + y.n - coalesce(o.shared, 0), 0), 6) AS jaccard FROM s x JOIN s y ON x.run < y.run LEFT JOIN (SELECT p.run AS a, q.run AS b, count(*) AS shared FROM e p JOIN e q ON p.id = q.id AND p.run < q.run GROUP BY ALL) o ON o.a = x.run AND o.b = y.run")
def error_overlap(spark, sf):
    return A.overlap(A.errors(_runs(spark, sf))).withColumn("jaccard", F.round("jaccard", 6))


@query("agg29_hard_cases", f"SELECT id, count(*) AS wrong FROM ({_ERR}) GROUP BY id")
def hard_cases(spark, sf):
    return A.hard_cases(_runs(spark, sf))


@query("set04_error_differences", f"SELECT 'fixed' AS kind, id FROM (SELECT id FROM ({run_sql('step7')}) WHERE pred <> label EXCEPT SELECT id FROM ({run_sql('round4')}) WHERE pred <> label) UNION ALL SELECT 'new', id FROM (SELECT id FROM ({run_sql('round4')}) WHERE pred <> label EXCEPT SELECT id FROM ({run_sql('step7')}) WHERE pred <> label)")
def error_differences(spark, sf):
    a, b = (run_of(spark, sf, n).where("pred <> label").select("id") for n in ("step7", "round4"))
    return a.join(b, "id", "left_anti").select(F.lit("fixed").alias("kind"), "id").unionAll(b.join(a, "id", "left_anti").select(F.lit("new"), "id"))


_ENS = f"SELECT 'step7+tfidf' AS ensemble, id, label, (p_step7 + p_tfidf) / 2 AS p FROM ({_MANY}) UNION ALL SELECT 'step7+neural', id, label, (p_step7 + p_neural) / 2 FROM ({_MANY}) UNION ALL SELECT 'tfidf+neural', id, label, (p_tfidf + p_neural) / 2 FROM ({_MANY}) UNION ALL SELECT 'step7+tfidf+neural', id, label, (p_step7 + p_tfidf + p_neural) / 3 FROM ({_MANY})"


@query("jn24_average_ensembles", f"SELECT ensemble, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1 FROM (SELECT ensemble, {_N('label = 1 AND p >= 0.5')} AS tp, {_N('label = 0 AND p >= 0.5')} AS fp, {_N('label = 1 AND p < 0.5')} AS fn, {_N('label = 0 AND p < 0.5')} AS tn FROM ({_ENS}) GROUP BY ensemble)")
def average_ensembles(spark, sf):
    own = A.ensembles(A.many(_runs(spark, sf)), _NAMES).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return M.metrics(own, ["ensemble"]).select("ensemble", "tp", "fp", "fn", "tn", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query("agg28_branch_agreement", f"SELECT pattern, count(*) AS n, round(avg(CASE WHEN pred_step7 = label THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM (SELECT *, pred_step7 || '-' || pred_tfidf || '-' || pred_neural AS pattern FROM ({_MANY})) GROUP BY pattern")
def agreement(spark, sf):
    own = A.many(_runs(spark, sf)).withColumn("pattern", F.concat_ws("-", *(F.col(f"pred_{n}").cast("string") for n in _NAMES)))
    return own.groupBy("pattern").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred_step7") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query("prj28_disagreement", f"SELECT id, CAST(len(list_distinct([CAST(p_step7 >= 0.5 AS INT), CAST(p_tfidf >= 0.5 AS INT), CAST(p_round4 >= 0.5 AS INT)])) - 1 AS INT) AS branch_disagreement_count FROM (SELECT id, label, {', '.join(f'CAST((id * {a}) % {m} AS DOUBLE) / {m} AS p_{r}' for r, (a, m) in RUNS.items())} FROM ({CORPUS_SQL}) WHERE label IS NOT NULL)")
def disagreement(spark, sf):
    sides = [(F.col(f"p_{n}") >= 0.5).cast("int") for n in ("step7", "tfidf", "round4")]
    return preds(spark, sf).select("id", (F.size(F.array_distinct(F.array(*sides))) - 1).alias("branch_disagreement_count"))
