"""Queries of thresholds and rules that are chosen, and pools and splits of candidates."""

from pyspark.sql import functions as F

from textloom.functions import features as X
from textloom.functions import text as T
from textloom.operators import candidates as K
from textloom.operators import metrics as M
from textloom.operators import normalise as N
from textloom.operators import reports as P
from textloom.operators import rules as R
from textloom.operators import splits as S
from textloom.operators.dedup import without
from textloom.operators.store import written
from textloom.plans.candidate_queries import _BLANK, _EXACT, _KEY, _OR, CAND_SQL, cand
from textloom.plans.metric_queries import _CONF, _N, _RATES, _rounded
from textloom.plans.registry import query
from textloom.plans.selection_queries import _walk
from textloom.plans.views import CORPUS_SQL, PREDS_SQL, corpus, preds

_T = [round(0.1 + 0.1 * k, 1) for k in range(9)]
_TS = ", ".join(f"{t}::DOUBLE" for t in _T)
_KIND = "CASE id % 3 WHEN 0 THEN 'hardpos' WHEN 1 THEN 'hardneg' ELSE 'internal' END"


@query("ml08_gate_threshold", f"SELECT threshold, round(sv, 9) AS safe_veto, round(ur, 9) AS unsafe_recall, round(cv, 9) AS candidate_veto, f AS feasible FROM (SELECT *, sv <= 0.45 AND cv <= 0.2 AS f FROM (SELECT t AS threshold, count(*) FILTER (k = 'hardpos' AND p_guard >= t)::DOUBLE / count(*) FILTER (k = 'hardpos') AS sv, count(*) FILTER (k = 'hardneg' AND p_guard >= t)::DOUBLE / count(*) FILTER (k = 'hardneg') AS ur, count(*) FILTER (k = 'internal' AND p_guard >= t) / 500.0::DOUBLE AS cv FROM (SELECT *, {_KIND} AS k FROM ({PREDS_SQL})) CROSS JOIN (SELECT unnest([{_TS}]) AS t) GROUP BY t)) ORDER BY f DESC, ur DESC, sv, cv, threshold DESC LIMIT 1")
def gate_threshold(spark, sf):
    i = F.col("id") % 3
    own = preds(spark, sf).withColumn("k", F.when(i == 0, "hardpos").when(i == 1, "hardneg").otherwise("internal"))
    out = R.gate_choice(own, _T, "p_guard", "k", "hardpos", "hardneg", "internal", 500, 0.45, 0.2)
    return out.select("threshold", *(F.round(c, 9).alias(c) for c in ("safe_veto", "unsafe_recall", "candidate_veto")), "feasible")


_SPL = "CASE id % 3 WHEN 0 THEN 'guard' WHEN 1 THEN 'valid' ELSE 'round2' END"
_F1 = lambda tp, fp, fn: f"(CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0 ELSE 2 * {tp}::DOUBLE / (2 * {tp} + {fp} + {fn}) END)"
_CNT = ", ".join(f"count(*) FILTER ({w} AND label = {y} AND p_neural {op} t) AS {n}{s}" for s, w in (("", "true"), ("g", "s = 'guard'"), ("r", "s = 'round2'")) for n, y, op in (("tp", 1, ">="), ("fp", 0, ">="), ("fn", 1, "<")))


@query("ml10_stacker_threshold", f"SELECT threshold, round(score, 9) AS score FROM (SELECT t AS threshold, {_F1('tp', 'fp', 'fn')} + 0.35 * {_F1('tpg', 'fpg', 'fng')} + 0.20 * {_F1('tpr', 'fpr', 'fnr')} - 0.01 * fpg AS score, {_F1('tp', 'fp', 'fn')} AS f1 FROM (SELECT t, {_CNT} FROM (SELECT *, {_SPL} AS s FROM ({PREDS_SQL})) CROSS JOIN (SELECT unnest([{_TS}]) AS t) GROUP BY t)) ORDER BY score DESC, f1 DESC, threshold DESC LIMIT 1")
def stacker_threshold(spark, sf):
    i = F.col("id") % 3
    own = preds(spark, sf).withColumn("s", F.when(i == 0, "guard").when(i == 1, "valid").otherwise("round2"))
    ts = spark.createDataFrame([(t,) for t in _T], "threshold double")
    by = M.at_grid(own, ts, ["s"], p="p_neural").groupBy("threshold").pivot("s", ["guard", "round2"]).agg(F.first("f1").alias("f1"), F.first("fp").alias("fp"))
    both = M.at_grid(own, ts, p="p_neural").select("threshold", "f1").join(by, "threshold")
    score = F.col("f1") + 0.35 * F.coalesce("guard_f1", F.lit(0.0)) + 0.20 * F.coalesce("round2_f1", F.lit(0.0)) - 0.01 * F.coalesce("guard_fp", F.lit(0))
    return both.withColumn("score", score).orderBy(F.desc("score"), F.desc("f1"), F.desc("threshold")).limit(1).select("threshold", F.round("score", 9).alias("score"))


_CT = [0.5, 0.6, 0.7, 0.8, 0.9]
_FIN = "CASE WHEN p_step7 BETWEEN 0.35 AND 0.65 AND greatest(p_guard, 1 - p_guard) >= t THEN CAST(p_guard >= 0.5 AS INT) ELSE CAST(p_step7 >= 0.5 AS INT) END"


@query("ml11_confidence_threshold", f"SELECT threshold, gain, used, fp_increase, f1 FROM (SELECT t AS threshold, count(*) FILTER (b = label) - count(*) FILTER (a = label) AS gain, count(*) FILTER (u) AS used, count(*) FILTER (label = 0 AND b = 1) - count(*) FILTER (label = 0 AND a = 1) AS fp_increase, round({_F1('count(*) FILTER (label = 1 AND b = 1)', 'count(*) FILTER (label = 0 AND b = 1)', 'count(*) FILTER (label = 1 AND b = 0)')}, 9) AS f1, count(*) FILTER (label = 1 AND a = 0 AND b = 1) AS fixed FROM (SELECT *, CAST(p_step7 >= 0.5 AS INT) AS a, {_FIN} AS b, p_step7 BETWEEN 0.35 AND 0.65 AND greatest(p_guard, 1 - p_guard) >= t AS u FROM ({PREDS_SQL}) CROSS JOIN (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _CT)}]) AS t)) GROUP BY t) ORDER BY (fp_increase <= 2 AND gain >= 1 AND used >= 3) DESC, gain DESC, greatest(0, fp_increase), f1 DESC, fixed DESC, threshold LIMIT 1")
def confidence_threshold(spark, sf):
    return R.confidence_choice(preds(spark, sf), _CT, "p_step7", "p_guard", most_fp=2, least_gain=1, least_used=3).select("threshold", "gain", "used", "fp_increase", F.round("f1", 9).alias("f1"))


_GRID = f"SELECT t AS threshold, tp, fp, fn, tn, {_RATES} FROM (SELECT t, {_CONF('p_tfidf', 't')} FROM ({PREDS_SQL}) CROSS JOIN (SELECT unnest([{_TS}]) AS t) GROUP BY t)"
_NEAR = "abs(threshold - 0.5), threshold"


@query("ml15_calibration_plan", f"WITH g AS ({_GRID}) SELECT * FROM (SELECT 'best_f1' AS plan, threshold, f1 FROM g ORDER BY f1 DESC, accuracy DESC, {_NEAR} LIMIT 1) UNION ALL SELECT * FROM (SELECT 'precision_ge_0.9', threshold, f1 FROM g ORDER BY precision >= 0.9 DESC, CASE WHEN precision >= 0.9 THEN f1 ELSE precision END DESC, CASE WHEN precision >= 0.9 THEN recall ELSE f1 END DESC, CASE WHEN precision >= 0.9 THEN precision ELSE recall END DESC, accuracy DESC, {_NEAR} LIMIT 1) UNION ALL SELECT * FROM (SELECT 'recall_ge_0.6', threshold, f1 FROM g ORDER BY recall >= 0.6 DESC, CASE WHEN recall >= 0.6 THEN f1 ELSE recall END DESC, CASE WHEN recall >= 0.6 THEN precision ELSE f1 END DESC, CASE WHEN recall >= 0.6 THEN recall ELSE precision END DESC, accuracy DESC, {_NEAR} LIMIT 1)")
def calibration_plan(spark, sf):
    g = written(_rounded(M.at_grid(preds(spark, sf), spark.createDataFrame([(t,) for t in _T], "threshold double"), p="p_tfidf"), "threshold"), "plan")
    best = M.best(g, [F.desc("f1"), F.desc("accuracy"), F.abs(F.col("threshold") - 0.5), "threshold"])
    parts = {"best_f1": best, "precision_ge_0.9": M.operating_point(g, "precision", 0.9), "recall_ge_0.6": M.operating_point(g, "recall", 0.6)}
    out = [df.select(F.lit(k).alias("plan"), "threshold", "f1") for k, df in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


_RULES = R.grid(a=[0.5, 0.7, 0.9], b=[0.2, 0.6])


@query("ml25_rule_families", f"SELECT CAST(rule AS INT) AS rule, round(3.0::DOUBLE * gf + 1.4 * rf - 5.0 * gi - 2.0 * vi - 0.03 * o, 6) AS score, gi <= 3 AND vi <= 5 AS constraints_passed FROM (SELECT rule, count(*) FILTER (h) AS o, count(*) FILTER (h AND s = 'guard' AND label = 1) AS gf, count(*) FILTER (h AND s = 'round2' AND label = 1) AS rf, count(*) FILTER (h AND s = 'guard' AND label = 0) AS gi, count(*) FILTER (h AND s = 'valid' AND label = 0) AS vi FROM (SELECT *, p_step7 < 0.55 AND p_round4 >= a AND p_guard <= b AS h FROM (SELECT *, {_SPL} AS s FROM ({PREDS_SQL})) CROSS JOIN (SELECT row_number() OVER (ORDER BY a, b) - 1 AS rule, a, b FROM (SELECT unnest([0.5, 0.7, 0.9]) AS a) CROSS JOIN (SELECT unnest([0.2, 0.6]) AS b))) GROUP BY rule)")
def rule_families(spark, sf):
    i = F.col("id") % 3
    own = preds(spark, sf).withColumn("s", F.when(i == 0, "guard").when(i == 1, "valid").otherwise("round2"))
    found = R.search_by(own, _RULES, lambda r: (F.col("p_step7") < 0.55) & (F.col("p_round4") >= r["a"]) & (F.col("p_guard") <= r["b"]), "s")
    out = R.ranked_rules(found, "s", {"guard": 3.0, "round2": 1.4}, {"guard": 5.0, "valid": 2.0}, {"guard": 3, "valid": 5})
    return out.select("rule", F.round("score", 6).alias("score"), "constraints_passed")


# pools and splits


@query("win20_dev_targets", _walk("h0, h1", "0::BIGINT, 0::BIGINT", "SELECT rn, pair_id, pick, h0 + CASE WHEN pick = 'dev' THEN n0 ELSE 0 END, h1 + CASE WHEN pick = 'dev' THEN n1 ELSE 0 END FROM (SELECT g.rn, g.pair_id, g.n0, g.n1, s.h0, s.h1, CASE WHEN CASE WHEN g.n0 > 0 THEN greatest(0, 7 - s.h0) ELSE 0 END + CASE WHEN g.n1 > 0 THEN greatest(0, 9 - s.h1) ELSE 0 END > 0 THEN 'dev' ELSE 'train' END AS pick FROM s JOIN g ON g.rn = s.rn + 1)", "pair_id, pick AS split"))
def dev_targets(spark, sf):
    own = corpus(spark, sf).where("label is not null").groupBy("pair_id").agg(F.sum((F.col("label") == 0).cast("long")).alias("n0"), F.sum((F.col("label") == 1).cast("long")).alias("n1"))
    return S.groups_until(own, {"n0": 7, "n1": 9}, ["pair_id"]).select("pair_id", F.when(F.col("selected"), "dev").otherwise("train").alias("split"))


_TAGGED = "CASE WHEN round4_tag IS NOT NULL AND round4_tag <> '' THEN round4_tag WHEN label = 0 THEN 'base_human' ELSE 'base_llm' END"


@query("prj25_enriched_train", f"SELECT id, {_OR('bucket', d='general_prose')} AS bucket, {_TAGGED} AS tag, coalesce(CASE WHEN id % 4 = 0 THEN 3.0::DOUBLE END, CASE WHEN label = 1 THEN 1.0 WHEN {_OR('bucket', d='general_prose')} IN ('poetry_classical', 'poetry_freeverse', 'literary_old_prose') THEN 2.0 WHEN bucket = 'literary_short_fragment' THEN 1.7 WHEN bucket = 'academic_formal' THEN 1.4 WHEN {_TAGGED} = 'human_polished_general_mirror' THEN 1.5 ELSE 1.2 END) AS weight FROM ({CAND_SQL}) WHERE label IN (0, 1) AND NOT {_BLANK}")
def enriched_train(spark, sf):
    own = cand(spark, sf).where(K.valid_detection()).withColumns({"bucket": N.present("bucket", default="general_prose"), "given": F.when(F.col("id") % 4 == 0, 3.0)})
    own = own.withColumn("tag", N.present("round4_tag", F.when(F.col("label") == 0, "base_human").otherwise("base_llm")))
    return own.select("id", "bucket", "tag", F.coalesce("given", K.mirror_weight("label", "bucket", "tag")).alias("weight"))


@query("prj14_pool_rows", f"SELECT 'round8_candidate_' || label || '_' || printf('%06d', n) AS id, CAST(id AS VARCHAR) AS source_record_id, {_OR('source_pair_id', 'pair_id')} AS source_pair_id, 'round8_' || {_OR('source_pair_id', 'pair_id')} AS pair_id, {_OR('md_paper', 'md_title', 'source_pair_id', 'pair_id')} AS source_doc_id, {_OR('round4_source_stage', 'round3_source_stage', 'generation', d='unknown_non_teacher_source')} AS origin, CASE WHEN label = 0 THEN 'human' ELSE {_OR('generator', 'source')} END AS generator, CASE WHEN label = 0 THEN 'human_hard_negative' ELSE 'llm_hard_positive' END AS family FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM ({CAND_SQL}) WHERE label IN (0, 1))")
def pool_rows(spark, sf):
    from textloom.operators.order import positions

    own = positions(cand(spark, sf).where("label in (0, 1)"), ["id"]).withColumn("original_id", F.lit(None).cast("string"))
    pair = N.present(F.col("source_pair_id"), F.col("pair_id").cast("string"))
    return own.select(
        F.format_string("round8_candidate_%d_%06d", "label", F.col("position").cast("int")).alias("id"), F.col("id").cast("string").alias("source_record_id"), pair.alias("source_pair_id"), F.concat(F.lit("round8_"), pair).alias("pair_id"), K.source_document().alias("source_doc_id"),
        K.origin("round4_source_stage", "round3_source_stage", "generation").alias("origin"), F.when(F.col("label") == 0, "human").otherwise(N.present("generator", "source")).alias("generator"), F.when(F.col("label") == 0, "human_hard_negative").otherwise("llm_hard_positive").alias("family"),
    )


@query("msc03_verse_candidates", f"SELECT min(id) AS id, 'hard_negative:' || min_by(source, id) AS source FROM (SELECT id, source, {_KEY.format('text')} AS k FROM ({CORPUS_SQL}) WHERE label = 0 AND id % 5 <> 0) WHERE k <> '' AND k NOT IN (SELECT {_KEY.format('text')} FROM ({CORPUS_SQL}) WHERE id % 5 = 0 AND text IS NOT NULL) GROUP BY k ORDER BY 1 LIMIT 25")
def verse_candidates(spark, sf):
    own = corpus(spark, sf)
    fresh = K.pool(own.where("label = 0 and id % 5 <> 0"), own.where("id % 5 = 0"), ["id"])
    return fresh.orderBy("id").limit(25).select("id", F.concat(F.lit("hard_negative:"), "source").alias("source"))


@query("msc04_hard_negative_report", f"SELECT 'title' AS part, coalesce(nullif(md_title, ''), 'unknown') AS value, count(*) AS n FROM ({CAND_SQL}) WHERE label = 0 GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM ({CAND_SQL}) WHERE label = 0 GROUP BY 2")
def hard_negative_report(spark, sf):
    own = P.summary(cand(spark, sf).where("label = 0"), {"title": F.col("metadata")["title"], "domain": "domain"})
    return own.select(F.col("dim").alias("part"), "value", "n")


@query("msc08_11_proxy_pool", f"SELECT kind, count(*) AS n, count(*) FILTER (e) AS exact FROM (SELECT CASE WHEN id % 3 = 0 THEN 'train' WHEN label = 1 THEN 'hardpos' ELSE 'hardneg' END AS kind, {_EXACT} AND id % 2 = 0 AS e FROM ({CAND_SQL}) WHERE (id % 3 = 0 AND NOT starts_with(coalesce(round4_tag, ''), 'base_') AND coalesce(round4_source_stage, '') NOT IN ('', 'step7_base_train')) OR (id % 3 <> 0 AND label IN (0, 1))) GROUP BY kind")
def proxy_pool(spark, sf):
    own = cand(spark, sf)
    exact = own.where(K.exact_override() & (F.col("id") % 2 == 0))
    parts = {"train": own.where("id % 3 = 0").where(K.residual_proxy()), "hardpos": own.where("id % 3 <> 0 and label = 1"), "hardneg": own.where("id % 3 <> 0 and label = 0")}
    tagged = [df.withColumn("kind", F.lit(k)) for k, df in parts.items()]
    both = K.overlaid(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]), exact, "id", ["step7_pred", "round4_pred"])
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("is_exact").cast("long")).alias("exact"))


@query("msc10_train_without_dev", f"WITH c AS (SELECT id, pair_id, {_KEY.format('text')} AS k FROM ({CORPUS_SQL}) WHERE text IS NOT NULL), d AS (SELECT * FROM c WHERE id % 9 = 0) SELECT id FROM c WHERE id % 9 <> 0 AND pair_id NOT IN (SELECT pair_id FROM d) AND k NOT IN (SELECT k FROM d)")
def train_without_dev(spark, sf):
    own = corpus(spark, sf).where("text is not null").withColumn("key", T.text_key("text"))
    dev, train = own.where("id % 9 = 0"), own.where("id % 9 <> 0")
    return without(without(train, "pair_id", dev.select("pair_id")), "key", dev.select("key")).select("id")


@query("msc33_configured_texts", rf"SELECT id, md5(CASE WHEN id % 2 = 0 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE text END) AS h FROM ({CORPUS_SQL})")
def configured(spark, sf):
    return corpus(spark, sf).select("id", F.md5(F.when(F.col("id") % 2 == 0, T.squeeze("text")).otherwise(F.col("text")).cast("binary")).alias("h"))


@query("msc45_acceptance", f"SELECT unnest(['train_rows', 'unique_texts', 'dev_pairs']) AS check_name, unnest([n >= 10, u = n, p >= 1000000]) AS passed FROM (SELECT count(*) AS n, count(DISTINCT k) AS u, count(DISTINCT pair_id) AS p FROM (SELECT pair_id, {_KEY.format('text')} AS k FROM ({CORPUS_SQL}) WHERE label IS NOT NULL))")
def acceptance(spark, sf):
    own = corpus(spark, sf).where("label is not null").agg(F.count("*").alias("n"), F.count_distinct(T.text_key("text")).alias("u"), F.count_distinct("pair_id").alias("p"))
    checks = {"train_rows": F.col("n") >= 10, "unique_texts": F.col("u") == F.col("n"), "dev_pairs": F.col("p") >= 1_000_000}
    return own.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check_name"), c.alias("passed")) for k, c in checks.items()))).alias("e")).select("e.*")


_CHANGED = _N(r"text <> trim(regexp_replace(text, '\s+', ' ', 'g'))")


@query("txt05_normalised_by_split", f"SELECT coalesce(split, 'none') AS split, count(*) AS n, {_CHANGED} AS changed FROM ({CAND_SQL}) GROUP BY 1")
def normalised(spark, sf):
    own = cand(spark, sf).withColumn("changed", F.col("text") != T.squeeze("text"))
    return own.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("changed").cast("long")), F.lit(0)).cast("long").alias("changed"))
