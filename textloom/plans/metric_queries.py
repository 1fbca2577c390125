"""Queries of evaluation aggregates, sweeps and reports."""

from pyspark.sql import functions as F

from textloom.functions.taxonomy import to_double
from textloom.operators import metrics as M
from textloom.plans.registry import query
from textloom.plans.views import CORPUS_SQL, PREDS_SQL, corpus, preds, table

_N = lambda c: f"CAST(coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS BIGINT)"
_CONF = lambda p, t: f"{_N(f'label = 1 AND {p} >= {t}')} AS tp, {_N(f'label = 0 AND {p} >= {t}')} AS fp, {_N(f'label = 1 AND {p} < {t}')} AS fn, {_N(f'label = 0 AND {p} < {t}')} AS tn"
_RATES = "round((tp + tn)::DOUBLE / greatest(1, tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END, 6) AS f1"
_COUNTS = ("tp", "fp", "fn", "tn")
_MEASURES = ("accuracy", "precision", "recall", "f1")


def _rounded(df, *keys):
    return df.select(*keys, *_COUNTS, *(F.round(m, 6).alias(m) for m in _MEASURES))


def scored(spark, sf, run="step7", t=0.55):
    return preds(spark, sf).withColumn("p", F.col(f"p_{run}")).withColumn("pred", (F.col("p") >= t).cast("int"))


@query("agg06_metrics", f"SELECT tp, fp, fn, tn, {_RATES} FROM (SELECT {_CONF('p_step7', 0.55)} FROM ({PREDS_SQL}))")
def metrics(spark, sf):
    return _rounded(M.metrics(scored(spark, sf)))


@query("agg09_grouped_metrics", f"SELECT domain, tp, fp, fn, tn, {_RATES} FROM (SELECT domain, {_CONF('p_step7', 0.55)} FROM ({PREDS_SQL}) GROUP BY domain)")
def grouped(spark, sf):
    return _rounded(M.metrics(scored(spark, sf), ["domain"]), "domain")


@query("agg10_metrics_by_sets", f"SELECT coalesce(domain, '*') AS domain, coalesce(source, '*') AS source, tp, fp, fn, tn, {_RATES} FROM (SELECT domain, source, {_CONF('p_step7', 0.55)} FROM ({PREDS_SQL}) GROUP BY GROUPING SETS ((domain), (source), ()))")
def by_sets(spark, sf):
    own = scored(spark, sf)
    sets = own.groupingSets([["domain"], ["source"], []], "domain", "source").agg(*M.confusion())
    return _rounded(M.rates(sets.select(F.coalesce("domain", F.lit("*")).alias("domain"), F.coalesce("source", F.lit("*")).alias("source"), *_COUNTS)), "domain", "source")


_AUC = "round(CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * sum(1 - label)) END, 6)"


@query("win05_roc_auc", f"SELECT domain, {_AUC} AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY domain ORDER BY q) + (count(*) OVER (PARTITION BY domain, q) - 1) / 2.0::DOUBLE AS r FROM (SELECT *, floor(p_step7 * 20) / 20 AS q FROM ({PREDS_SQL}))) GROUP BY domain")
def roc_auc(spark, sf):
    own = preds(spark, sf).withColumn("q", F.floor(F.col("p_step7") * 20) / 20)
    return M.roc_auc(own, ["domain"], p="q").withColumn("roc_auc", F.round("roc_auc", 6))


_SWEEP = "SELECT t AS threshold, tp, fp, np - tp AS fn, nn - fp AS tn FROM (SELECT t, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(neg) OVER (ORDER BY t DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM (SELECT {p} AS t, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM ({src}) GROUP BY 1))"
_SW = f"SELECT *, {_RATES} FROM (SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn FROM ({_SWEEP.format(p='p_step7', src=PREDS_SQL)}))"


@query("win06_threshold_sweep", f"SELECT round(threshold, 9) AS threshold, tp, fp, fn, tn, accuracy, precision, recall, f1 FROM ({_SW})")
def sweep(spark, sf):
    return _rounded(M.sweep(scored(spark, sf)).withColumn("threshold", F.round("threshold", 9)), "threshold")


@query("win06_best_threshold", f"SELECT round(threshold, 9) AS threshold, f1 FROM ({_SW}) ORDER BY f1 DESC, accuracy DESC, abs(threshold - 0.5), threshold LIMIT 1")
def best_threshold(spark, sf):
    own = _rounded(M.sweep(scored(spark, sf)), "threshold")
    return M.best(own, [F.desc("f1"), F.desc("accuracy"), F.abs(F.col("threshold") - 0.5), "threshold"]).select(F.round("threshold", 9).alias("threshold"), "f1")


_GRID = "(SELECT k / 100.0::DOUBLE AS threshold FROM range(5, 96) g(k))"
_ATG = f"SELECT threshold, tp, fp, fn, tn, {_RATES} FROM (SELECT threshold, {_CONF('p_step7', 'threshold')} FROM ({PREDS_SQL}) CROSS JOIN {_GRID} GROUP BY threshold)"


def _grid(spark, lo=5, hi=96):
    return spark.range(lo, hi).select((F.col("id") / F.lit(100.0)).alias("threshold"))


@query("jn22_threshold_grid", f"SELECT * FROM ({_ATG})")
def threshold_grid(spark, sf):
    return _rounded(M.at_grid(scored(spark, sf), _grid(spark)), "threshold")


@query("win08_operating_points", f"SELECT * FROM (SELECT 'precision' AS kind, threshold, precision, recall, precision >= 0.9 AS target_satisfied FROM ({_ATG}) ORDER BY precision >= 0.9 DESC, CASE WHEN precision >= 0.9 THEN f1 ELSE precision END DESC, CASE WHEN precision >= 0.9 THEN recall ELSE f1 END DESC, CASE WHEN precision >= 0.9 THEN precision ELSE recall END DESC, accuracy DESC, abs(threshold - 0.5), threshold LIMIT 1) UNION ALL SELECT * FROM (SELECT 'recall', threshold, precision, recall, recall >= 0.9 FROM ({_ATG}) ORDER BY recall >= 0.9 DESC, CASE WHEN recall >= 0.9 THEN f1 ELSE recall END DESC, CASE WHEN recall >= 0.9 THEN precision ELSE f1 END DESC, CASE WHEN recall >= 0.9 THEN recall ELSE precision END DESC, accuracy DESC, abs(threshold - 0.5), threshold LIMIT 1)")
def operating_points(spark, sf):
    own = _rounded(M.at_grid(scored(spark, sf), _grid(spark)), "threshold")
    pick = lambda k: M.operating_point(own, k, 0.9).select(F.lit(k).alias("kind"), "threshold", "precision", "recall", "target_satisfied")
    return pick("precision").unionAll(pick("recall"))


@query("win07_bucket_thresholds", f"SELECT domain, threshold, f1, met FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY met DESC, f1 DESC, accuracy DESC, abs(threshold - 0.55), threshold) AS r FROM (SELECT *, precision >= 0.8 AND recall >= 0.3 AS met FROM (SELECT domain, threshold, tp, fp, fn, tn, {_RATES} FROM (SELECT domain, threshold, {_CONF('p_step7', 'threshold')} FROM ({PREDS_SQL}) CROSS JOIN {_GRID} GROUP BY domain, threshold)))) WHERE r = 1")
def bucket_thresholds(spark, sf):
    own = _rounded(M.at_grid(scored(spark, sf), _grid(spark), ["domain"]), "domain", "threshold").withColumn("met", (F.col("precision") >= 0.8) & (F.col("recall") >= 0.3))
    return M.best(own, [F.desc("met"), F.desc("f1"), F.desc("accuracy"), F.abs(F.col("threshold") - 0.55), "threshold"], ["domain"]).select("domain", "threshold", "f1", "met")


@query("win09_alpha_threshold_search", f"SELECT alpha, threshold, f1 FROM (SELECT alpha, threshold, tp, fp, fn, tn, {_RATES} FROM (SELECT a.alpha, threshold, {_CONF('(alpha * p_neural + (1 - alpha) * p_tfidf)', 'threshold')} FROM ({PREDS_SQL}) CROSS JOIN (SELECT k / 10.0::DOUBLE AS alpha FROM range(0, 11) g(k)) a CROSS JOIN {_GRID} GROUP BY ALL)) ORDER BY f1 DESC, alpha, threshold LIMIT 1")
def alpha_search(spark, sf):
    mixed = [F.struct(F.lit(k / 10).alias("alpha"), (F.lit(k / 10) * F.col("p_neural") + (1 - F.lit(k / 10)) * F.col("p_tfidf")).alias("p")) for k in range(11)]
    own = preds(spark, sf).select("label", F.explode(F.array(*mixed)).alias("m")).select("label", "m.*")
    return _rounded(M.at_grid(own, _grid(spark), ["alpha"]), "alpha", "threshold").orderBy(F.desc("f1"), "alpha", "threshold").select("alpha", "threshold", "f1").limit(1)


@query("agg19_histograms", f"WITH b AS (SELECT domain, CASE WHEN p IS NULL THEN 'missing' ELSE printf('%.1f-%.1f', k / 10.0::DOUBLE, (k + 1) / 10.0::DOUBLE) END AS bin FROM (SELECT domain, p, least(floor(greatest(0, least(1, p)) * 10), 9)::INT AS k FROM (SELECT domain, CASE WHEN id % 17 = 0 THEN NULL ELSE p_step7 * 1.2 - 0.1 END AS p FROM ({PREDS_SQL})))) SELECT d.domain, s.bin, count(b.bin) AS n FROM (SELECT DISTINCT domain FROM b) d CROSS JOIN (SELECT printf('%.1f-%.1f', k / 10.0::DOUBLE, (k + 1) / 10.0::DOUBLE) AS bin FROM range(0, 10) g(k) UNION ALL SELECT 'missing') s LEFT JOIN b ON b.domain = d.domain AND b.bin = s.bin GROUP BY ALL")
def histograms(spark, sf):
    own = preds(spark, sf).withColumn("p", F.when(F.col("id") % 17 != 0, F.col("p_step7") * 1.2 - 0.1))
    return M.histogram(own, ["domain"], "p")


@query("agg38_class_weights", f"SELECT label, round(t::DOUBLE / (k * n), 6) AS weight FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM ({PREDS_SQL}) GROUP BY label)")
def class_weights(spark, sf):
    return M.class_weights(preds(spark, sf)).withColumn("weight", F.round("weight", 6))


_W = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"


@query("agg01_report", f"SELECT section, value, count(*) AS n FROM (SELECT unnest(['label', 'domain', 'source', 'domain|label']) AS section, unnest([coalesce(CAST(label AS VARCHAR), 'null'), domain, source, domain || '|' || coalesce(CAST(label AS VARCHAR), 'null')]) AS value FROM ({CORPUS_SQL})) GROUP BY ALL")
def report(spark, sf):
    label = F.coalesce(F.col("label").cast("string"), F.lit("null"))
    cells = {"label": label, "domain": F.col("domain"), "source": F.col("source"), "domain|label": F.concat_ws("|", "domain", label)}
    own = corpus(spark, sf).select(F.explode(F.array(*(F.struct(F.lit(k).alias("section"), v.alias("value")) for k, v in cells.items()))).alias("c"))
    return own.groupBy("c.section", "c.value").agg(F.count("*").alias("n"))


@query("agg01_word_lengths", f"SELECT source, CAST(min(w) AS BIGINT) AS least, CAST(max(w) AS BIGINT) AS most, round(avg(w), 6) AS mean FROM (SELECT source, {_W} AS w FROM ({CORPUS_SQL})) GROUP BY source")
def word_lengths(spark, sf):
    from textloom.functions.text import space_words

    own = corpus(spark, sf).select("source", space_words("text").cast("long").alias("w"))
    return own.groupBy("source").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.round(F.avg("w"), 6).alias("mean"))


@query("agg03_pair_stats", f"SELECT count(*) AS pairs, {_N('h = 1')} AS with_human, {_N('l = 1')} AS with_llm, {_N('h = 1 AND l = 1')} AS with_both, {_N('d > 1')} AS multi_domain FROM (SELECT pair_id, max(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS h, max(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS l, count(DISTINCT domain) AS d FROM ({CORPUS_SQL}) GROUP BY pair_id)")
def pair_stats(spark, sf):
    per = corpus(spark, sf).groupBy("pair_id").agg(F.max((F.col("label") == 0).cast("int")).alias("h"), F.max((F.col("label") == 1).cast("int")).alias("l"), F.count_distinct("domain").alias("d"))
    n = lambda c: F.coalesce(F.sum(F.when(F.expr(c), 1).otherwise(0)), F.lit(0)).cast("long")
    return per.agg(F.count("*").alias("pairs"), n("h = 1").alias("with_human"), n("l = 1").alias("with_llm"), n("h = 1 and l = 1").alias("with_both"), n("d > 1").alias("multi_domain"))


@query("agg30_paired_coverage", f"SELECT domain, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS llm, count(*) FILTER (label = 0) > 0 AND count(*) FILTER (label = 1) > 0 AS paired FROM ({PREDS_SQL}) GROUP BY domain")
def paired_coverage(spark, sf):
    own = preds(spark, sf).groupBy("domain").agg(F.count_if(F.col("label") == 0).alias("human"), F.count_if(F.col("label") == 1).alias("llm"))
    return own.withColumn("paired", (F.col("human") > 0) & (F.col("llm") > 0))


@query("agg33_acceptance", f"SELECT check_name, passed FROM (SELECT unnest(['enough_rows', 'both_labels', 'no_blank_text', 'no_repeated_text']) AS check_name, unnest([count(*) >= 100, count(DISTINCT label) = 2, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) = 0, count(DISTINCT md5(lower(text))) = count(*)]) AS passed FROM ({CORPUS_SQL}))")
def acceptance(spark, sf):
    own = corpus(spark, sf).agg((F.count("*") >= 100).alias("enough_rows"), (F.count_distinct("label") == 2).alias("both_labels"), (F.sum((F.trim("text") == "").cast("int")) == 0).alias("no_blank_text"), (F.count_distinct(F.md5(F.lower("text").cast("binary"))) == F.count("*")).alias("no_repeated_text"))
    return own.unpivot([], own.columns, "check_name", "passed")


@query("srt01_id_order", f"SELECT id, row_number() OVER (ORDER BY CASE WHEN regexp_matches(k, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(k AS BIGINT) NULLS FIRST, k) AS position FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'row_' || id ELSE CAST(id AS VARCHAR) END AS k FROM ({CORPUS_SQL}))")
def id_order(spark, sf):
    from textloom.operators.order import positions

    own = corpus(spark, sf).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("row_"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string")).alias("k"))
    return positions(own, [F.when(F.col("k").rlike("^[0-9]+$"), 0).otherwise(1), F.col("k").try_cast("long"), F.col("k")]).select("id", "position")


@query("srt02_top_errors", f"SELECT * FROM (SELECT 'fp' AS kind, id, round(p_step7, 9) AS p FROM ({PREDS_SQL}) WHERE label = 0 AND p_step7 >= 0.55 ORDER BY p_step7 DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'fn', id, round(p_step7, 9) FROM ({PREDS_SQL}) WHERE label = 1 AND p_step7 < 0.55 ORDER BY p_step7, id LIMIT 10)")
def top_errors(spark, sf):
    own = scored(spark, sf)
    fp = own.where("label = 0 and pred = 1").orderBy(F.desc("p"), "id").limit(10).select(F.lit("fp").alias("kind"), "id", F.round("p", 9).alias("p"))
    fn = own.where("label = 1 and pred = 0").orderBy("p", "id").limit(10).select(F.lit("fn").alias("kind"), "id", F.round("p", 9).alias("p"))
    return fp.unionAll(fn)


@query("srt04_most_common", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 5")
def most_common(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_")).orderBy(F.desc("n"), "first_").limit(5).drop("first_")


@query("fea34_safe_casts", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), -1.0) AS v FROM events")
def safe_casts(spark, sf):
    c = F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", to_double(c, -1.0).alias("v"))
