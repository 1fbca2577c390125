"""Queries of projections, ledgers, guards and selectors."""

from pyspark.sql import functions as F

from textloom.operators import metrics as M
from textloom.operators import normalise as N
from textloom.plans.feature_queries import BUCKET_SQL, surfaced
from textloom.plans.metric_queries import _GRID, _N, _grid, scored
from textloom.plans.registry import query
from textloom.plans.views import CORPUS_SQL, PREDS_SQL, REWRITES_SQL, corpus, preds, rewrites, table


@query("prj01_human_rows", f"SELECT CAST(id AS VARCHAR) AS id, CAST(0 AS INT) AS label, domain, source, 'human' AS generator, CAST(pair_id AS VARCHAR) AS pair_id, CAST(id AS VARCHAR) AS source_id, 'human' AS prompt_type FROM ({CORPUS_SQL}) WHERE label = 0")
def human_rows(spark, sf):
    return N.human_rows(corpus(spark, sf).where("label = 0")).select("id", "label", "domain", "source", "generator", "pair_id", "source_id", "prompt_type")


@query("prj02_llm_rows", f"SELECT task_id AS id, CAST(1 AS INT) AS label, domain, CASE WHEN length(rewrite_text) % 2 = 0 THEN 'chatgpt' ELSE 'unknown' END AS source, CASE WHEN length(rewrite_text) % 2 = 0 THEN 'chatgpt' ELSE 'unknown' END AS generator, 'unknown' AS model, 'llm_rewrite' AS generation FROM ({REWRITES_SQL})")
def llm_rows(spark, sf):
    own = rewrites(spark, sf).select(F.col("task_id").alias("id"), F.col("task_id").alias("pair_id"), F.col("rewrite_text").alias("text"), "domain", F.when(F.length("rewrite_text") % 2 == 0, "chatgpt").alias("generator"))
    return N.llm_rows(own).select("id", "label", "domain", "source", "generator", "model", "generation")


@query("prj07_renumbered", f"SELECT printf('human_x_%06d', row_number() OVER (ORDER BY id)) AS id, CAST(id AS VARCHAR) AS original_id FROM ({CORPUS_SQL}) WHERE label = 0")
def renumbered(spark, sf):
    return N.renumbered(corpus(spark, sf).where("label = 0").select("id"), "x", ["id"]).select("id", "original_id")


@query("prj20_first_value", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), nullif(CAST(user_id AS VARCHAR), ''), 'none') AS v FROM events")
def first_value(spark, sf):
    own = table(spark, sf, "events").withColumn("k", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")))
    return own.select("event_id", N.present("k", F.col("user_id").cast("string"), default="none").alias("v"))


@query("prj26_enriched_predictions", f"SELECT id, CAST(p >= 0.55 AS INT) AS step7_pred, CASE WHEN label IS NOT NULL THEN CAST(p >= 0.55 AS INT) = label END AS step7_correct, p BETWEEN 0.35 AND 0.65 AS ambiguous_zone, coalesce(label = 0 AND p >= 0.55, false) AS hard_human_candidate, coalesce(label = 0 AND p >= 0.65, false) AS very_hard_human_candidate, coalesce(label = 1 AND p <= 0.45, false) AS hard_llm_candidate, coalesce(label = 1 AND p <= 0.35, false) AS very_hard_llm_candidate FROM (SELECT id, label, CAST((id * 7919) % 10007 AS DOUBLE) / 10007 AS p FROM ({CORPUS_SQL}))")
def enriched(spark, sf):
    from textloom.plans.views import probability

    own = N.enriched(corpus(spark, sf).withColumn("p_step7", probability("step7")))
    return own.select("id", "step7_pred", "step7_correct", "ambiguous_zone", "hard_human_candidate", "very_hard_human_candidate", "hard_llm_candidate", "very_hard_llm_candidate")


@query("prj29_error_ledger", f"SELECT id, CASE WHEN label = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type, round(abs(p_step7 - 0.55), 9) AS margin, array_to_string(list_filter([CASE WHEN abs(p_step7 - 0.55) <= 0.05 THEN 'near threshold' END, CASE WHEN abs(p_step7 - 0.55) >= 0.35 THEN 'confident error' END], lambda n: n IS NOT NULL), ';') AS notes FROM ({PREDS_SQL}) WHERE (label = 0) = (p_step7 >= 0.55)")
def error_ledger(spark, sf):
    return N.ledger(scored(spark, sf)).select("id", "error_type", F.round("margin", 9).alias("margin"), "notes")


_HB = "CASE WHEN label = 0 THEN CASE bucket WHEN 'poetry_classical' THEN 'classical_poetry_human' WHEN 'poetry_freeverse' THEN 'modern_freeverse_human' WHEN 'academic_formal' THEN 'formal_academic_human' WHEN 'literary_short_fragment' THEN 'short_fragment_human' ELSE 'ornate_literary_prose_human' END ELSE 'chatgpt_conservative_literary' END"


@query("fea19_25_hard_buckets", f"SELECT id, unnest(CASE WHEN b = 'chatgpt_conservative_literary' THEN [b, 'chatgpt_old_fiction'] ELSE [b] END) AS hard FROM (SELECT id, {_HB} AS b FROM ({BUCKET_SQL}) WHERE label IS NOT NULL)")
def hard_buckets(spark, sf):
    own = surfaced(spark, sf).where("label is not null")
    return N.expanded(own.select("id", N.hard_bucket("label", "bucket", "domain", F.lit("")).alias("hard")), "hard")


@query("fea21_inferred_bucket", f"SELECT id, CASE WHEN label = 1 AND contains(lower(source), 'old_prose') THEN 'literary_old_prose' ELSE bucket END AS bucket FROM (SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN 'OLD_PROSE mix' ELSE source END AS source) FROM ({BUCKET_SQL}) WHERE label IS NOT NULL)")
def inferred(spark, sf):
    own = surfaced(spark, sf).where("label is not null").withColumn("source", F.when(F.col("id") % 4 == 0, "OLD_PROSE mix").otherwise(F.col("source")))
    return own.select("id", N.inferred_bucket("label", "bucket", "source").alias("bucket"))


@query("fea23_row_weights", f"SELECT id, CASE WHEN id % 5 = 0 THEN 1.0 ELSE 1.5 END::DOUBLE * CASE label WHEN 1 THEN 2.0 ELSE 1.0 END * CASE domain WHEN 'en' THEN 0.5 WHEN 'fr' THEN 3.0 ELSE 1.0 END AS weight FROM ({CORPUS_SQL}) WHERE label IS NOT NULL")
def row_weights(spark, sf):
    own = corpus(spark, sf).where("label is not null").withColumn("w", F.when(F.col("id") % 5 == 0, 0.0).otherwise(1.5))
    return own.select("id", N.row_weight({"label_1": 2.0, "en": 0.5, "fr": 3.0}, "w", "label", "domain", "source").alias("weight"))


@query("agg14_guard_metrics", f"SELECT domain, rows, safe_pass, safe_veto, unsafe_miss, unsafe_veto, round(veto_rate, 6) AS veto_rate, round(CASE WHEN safe_pass + safe_veto = 0 THEN 0.0 ELSE safe_veto::DOUBLE / (safe_pass + safe_veto) END, 6) AS safe_veto_rate, round(CASE WHEN unsafe_miss + unsafe_veto = 0 THEN 0.0 ELSE unsafe_miss::DOUBLE / (unsafe_miss + unsafe_veto) END, 6) AS unsafe_miss_rate FROM (SELECT domain, count(*) AS rows, {_N('label = 0 AND p_guard < 0.6')} AS safe_pass, {_N('label = 0 AND p_guard >= 0.6')} AS safe_veto, {_N('label = 1 AND p_guard < 0.6')} AS unsafe_miss, {_N('label = 1 AND p_guard >= 0.6')} AS unsafe_veto, avg(CASE WHEN p_guard >= 0.6 THEN 1.0 ELSE 0.0 END)::DOUBLE AS veto_rate FROM ({PREDS_SQL}) GROUP BY domain)")
def guard(spark, sf):
    own = M.guard_metrics(preds(spark, sf), 0.6, ["domain"], p="p_guard")
    return own.select("domain", "rows", "safe_pass", "safe_veto", "unsafe_miss", "unsafe_veto", F.round("veto_rate", 6).alias("veto_rate"), F.round("safe_veto_rate", 6).alias("safe_veto_rate"), F.round("unsafe_miss_rate", 6).alias("unsafe_miss_rate"))


@query("agg15_selector_metrics", f"SELECT domain, sp AS safe_pass, sb AS safe_block, up AS unsafe_pass, ub AS unsafe_block, round(sp::DOUBLE / nullif(sp + sb, 0), 6) AS safe_pass_rate, round(ub::DOUBLE / nullif(up + ub, 0), 6) AS unsafe_block_rate FROM (SELECT domain, {_N('label = 1 AND p_guard >= 0.5')} AS sp, {_N('label = 1 AND p_guard < 0.5')} AS sb, {_N('label = 0 AND p_guard >= 0.5')} AS up, {_N('label = 0 AND p_guard < 0.5')} AS ub FROM ({PREDS_SQL}) GROUP BY domain)")
def selector(spark, sf):
    own = M.selector_metrics(preds(spark, sf), 0.5, ["domain"], p="p_guard")
    return own.select("domain", "safe_pass", "safe_block", "unsafe_pass", "unsafe_block", F.round("safe_pass_rate", 6).alias("safe_pass_rate"), F.round("unsafe_block_rate", 6).alias("unsafe_block_rate"))


@query("ml09_selector_threshold", f"SELECT threshold, feasible, round(sp, 6) AS safe_pass_rate, round(ub, 6) AS unsafe_block_rate FROM (SELECT *, coalesce(ub >= 0.7 AND sp >= 0.2, false) AS feasible FROM (SELECT threshold, tp::DOUBLE / nullif(tp + fn, 0) AS sp, tn::DOUBLE / nullif(tn + fp, 0) AS ub FROM (SELECT threshold, {_N('label = 1 AND p_guard >= threshold')} AS tp, {_N('label = 0 AND p_guard >= threshold')} AS fp, {_N('label = 1 AND p_guard < threshold')} AS fn, {_N('label = 0 AND p_guard < threshold')} AS tn FROM ({PREDS_SQL}) CROSS JOIN {_GRID} GROUP BY threshold))) ORDER BY feasible DESC, sp DESC, ub DESC, threshold LIMIT 1")
def selector_threshold(spark, sf):
    own = M.selector_threshold(preds(spark, sf), _grid(spark), 0.7, 0.2, p="p_guard")
    return own.select("threshold", "feasible", F.round("safe_pass_rate", 6).alias("safe_pass_rate"), F.round("unsafe_block_rate", 6).alias("unsafe_block_rate"))


@query("agg18_nested_counts", f"SELECT domain, tier, count(*) AS n FROM (SELECT domain, CASE WHEN p_step7 >= 0.55 THEN 'llm' ELSE 'human' END AS tier FROM ({PREDS_SQL})) GROUP BY ALL")
def nested(spark, sf):
    return preds(spark, sf).groupBy("domain", F.when(F.col("p_step7") >= 0.55, "llm").otherwise("human").alias("tier")).agg(F.count("*").alias("n"))


@query("agg21_flip_rollup", f"SELECT coalesce(kind, 'total') AS kind, count(*) AS n FROM (SELECT CASE WHEN label = 1 THEN 'safe' ELSE 'unsafe' END AS kind FROM ({PREDS_SQL}) WHERE p_step7 < 0.55 AND p_round4 >= 0.5) GROUP BY ROLLUP (kind)")
def flip_rollup(spark, sf):
    own = preds(spark, sf).where("p_step7 < 0.55 and p_round4 >= 0.5").withColumn("kind", F.when(F.col("label") == 1, "safe").otherwise("unsafe"))
    return own.rollup("kind").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


@query("agg31_watchlist", f"SELECT w.domain, count(p.id) AS n FROM (SELECT unnest(['en', 'fr', 'xx']) AS domain) w LEFT JOIN ({PREDS_SQL}) p ON p.domain = w.domain GROUP BY w.domain")
def watchlist(spark, sf):
    counts = preds(spark, sf).groupBy("domain").agg(F.count("*").alias("n"))
    return spark.createDataFrame([("en",), ("fr",), ("xx",)], "domain string").join(counts, "domain", "left").na.fill(0, ["n"])


@query("flt25_ambiguous_zone", f"SELECT id, round(p_step7, 9) AS p FROM ({PREDS_SQL}) WHERE p_step7 BETWEEN 0.35 AND 0.65")
def ambiguous(spark, sf):
    return preds(spark, sf).where(F.col("p_step7").between(0.35, 0.65)).select("id", F.round("p_step7", 9).alias("p"))


@query("set01_bag_union", f"SELECT id, domain, 'base' AS part FROM ({CORPUS_SQL}) WHERE label = 0 UNION ALL SELECT id, NULL, 'added' FROM ({CORPUS_SQL}) WHERE toxic = 1")
def bag_union(spark, sf):
    own = corpus(spark, sf)
    return own.where("label = 0").select("id", "domain", F.lit("base").alias("part")).unionByName(own.where("toxic = 1").select("id", F.lit("added").alias("part")), allowMissingColumns=True)


@query("set07_forbidden_union", f"SELECT pair_id FROM ({CORPUS_SQL}) WHERE toxic = 1 UNION SELECT id FROM ({CORPUS_SQL}) WHERE label = 0")
def forbidden_union(spark, sf):
    own = corpus(spark, sf)
    return own.where("toxic = 1").select("pair_id").union(own.where("label = 0").select("id")).distinct()


@query("msc13_target_status", f"SELECT label, n AS observed, CASE label WHEN 0 THEN 100 ELSE 300 END AS target, greatest(0, CASE label WHEN 0 THEN 100 ELSE 300 END - n) AS shortfall FROM (SELECT label, count(*) AS n FROM ({PREDS_SQL}) GROUP BY label)")
def target_status(spark, sf):
    own = preds(spark, sf).groupBy("label").agg(F.count("*").alias("observed"))
    target = F.when(F.col("label") == 0, 100).otherwise(300)
    return own.select("label", "observed", target.alias("target"), F.greatest(F.lit(0).cast("long"), target - F.col("observed")).alias("shortfall"))


@query("ext_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    from textloom.streaming.resume import windowed

    own = windowed(table(spark, sf, "events"))
    return own.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_CANDS = ["tfidf", "neural", "round4"]
_STATE = "CASE WHEN a <> label AND b = label THEN 'fixed' WHEN a = label AND b <> label THEN 'broken' WHEN a <> label THEN 'same_error' ELSE 'same_correct' END"
_AUDIT = " UNION ALL ".join(f"SELECT id, domain, label, '{c}' AS candidate, CAST(p_step7 >= 0.55 AS INT) AS a, CAST(p_{c} >= 0.5 AS INT) AS b FROM ({PREDS_SQL})" for c in _CANDS)


def audit(spark, sf):
    """A row for each labelled row and candidate run, with what the candidate changes against the base run."""
    made = F.array(*(F.struct(F.lit(c).alias("candidate"), (F.col(f"p_{c}") >= 0.5).cast("int").alias("b")) for c in _CANDS))
    own = preds(spark, sf).select("id", "domain", "label", (F.col("p_step7") >= 0.55).cast("int").alias("a"), F.explode(made).alias("m")).select("id", "domain", "label", "a", "m.*")
    y, a, b = F.col("label"), F.col("a"), F.col("b")
    state = F.when((a != y) & (b == y), "fixed").when((a == y) & (b != y), "broken").when(a != y, "same_error").otherwise("same_correct")
    return own.withColumn("state", state)


@query("jn26_candidate_audit", f"SELECT id, candidate, {_STATE} AS state FROM ({_AUDIT})")
def candidate_audit(spark, sf):
    return audit(spark, sf).select("id", "candidate", "state")


@query("agg25_candidate_deltas", f"SELECT candidate, {', '.join(f"count(*) FILTER (s = '{k}') AS {k}" for k in ('fixed', 'broken', 'same_error', 'same_correct'))} FROM (SELECT candidate, {_STATE} AS s FROM ({_AUDIT})) GROUP BY candidate")
def candidate_deltas(spark, sf):
    counts = [F.count_if(F.col("state") == k).alias(k) for k in ("fixed", "broken", "same_error", "same_correct")]
    return audit(spark, sf).groupBy("candidate").agg(*counts)


@query("agg26_bucket_deltas", f"SELECT domain, {', '.join(f"count(*) FILTER (candidate = '{c}' AND s = 'fixed') - count(*) FILTER (candidate = '{c}' AND s = 'broken') AS {c}" for c in _CANDS)} FROM (SELECT domain, candidate, {_STATE} AS s FROM ({_AUDIT})) GROUP BY domain")
def bucket_deltas(spark, sf):
    on = lambda c, s: F.count_if((F.col("candidate") == c) & (F.col("state") == s))
    return audit(spark, sf).groupBy("domain").agg(*((on(c, "fixed") - on(c, "broken")).alias(c) for c in _CANDS))


_HARD = {"hard_human": "label = 0 AND p_step7 >= 0.55", "very_hard_human": "label = 0 AND p_step7 >= 0.65", "hard_llm": "label = 1 AND p_step7 <= 0.45", "very_hard_llm": "label = 1 AND p_step7 <= 0.35", "ambiguous": "p_step7 BETWEEN 0.35 AND 0.65"}


@query("agg27_hard_residuals", " UNION ALL ".join(f"SELECT '{k}' AS flag, domain, count(*) AS n FROM ({PREDS_SQL}) WHERE {c} GROUP BY domain" for k, c in _HARD.items()))
def hard_residuals(spark, sf):
    own = N.enriched(preds(spark, sf))
    flags = {"hard_human": "hard_human_candidate", "very_hard_human": "very_hard_human_candidate", "hard_llm": "hard_llm_candidate", "very_hard_llm": "very_hard_llm_candidate", "ambiguous": "ambiguous_zone"}
    held = F.array_compact(F.array(*(F.when(F.col(c), F.lit(k)) for k, c in flags.items())))
    return own.select("domain", F.explode(held).alias("flag")).groupBy("flag", "domain").agg(F.count("*").alias("n"))


@query("msc20_length_stats", "SELECT source, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def length_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("agg12_error_ids", f"SELECT domain, CASE WHEN label = 0 THEN 'fp' ELSE 'fn' END AS kind, id FROM ({PREDS_SQL}) WHERE (label = 0) = (p_step7 >= 0.55)")
def error_ids(spark, sf):
    """A row for each error: the long form of id lists, which no task has to hold."""
    return scored(spark, sf).where("label <> pred").select("domain", F.when(F.col("label") == 0, "fp").otherwise("fn").alias("kind"), "id")
