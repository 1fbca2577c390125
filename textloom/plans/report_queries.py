"""Queries of reports, resolvers of small values, text clean-up and feature blocks over candidate rows."""

from functools import reduce

from pyspark.sql import functions as F

from textloom.functions import features as X
from textloom.functions import quality as Q
from textloom.functions import text as T
from textloom.operators import align as A
from textloom.operators import candidates as K
from textloom.operators import metrics as M
from textloom.operators import normalise as N
from textloom.operators import reports as P
from textloom.operators import splits as S
from textloom.plans.candidate_queries import _EXACT, _OR, _PASS, CAND_SQL, cand
from textloom.plans.feature_queries import BUCKET_SQL, surfaced
from textloom.plans.metric_queries import _CONF, _COUNTS, _N, _RATES, _rounded, scored
from textloom.plans.registry import query
from textloom.plans.validity_queries import _NW, _STRIP
from textloom.plans.views import CORPUS_SQL, PREDS_SQL, corpus, preds, run_of, run_sql, table

# summaries


@query("agg02_composite_counts", " UNION ALL ".join(f"SELECT '{d}' AS dim, coalesce(nullif(v, ''), 'unknown') AS value, count(*) AS n FROM (SELECT {v} AS v FROM ({CAND_SQL})) GROUP BY ALL" for d, v in (("domain_label", "domain || '|' || label"), ("domain_generator", "domain || '|' || generator"))))
def composite(spark, sf):
    bar = lambda a, b: F.concat(F.col(a), F.lit("|"), F.col(b).cast("string"))
    return P.summary(cand(spark, sf), {"domain_label": bar("domain", "label"), "domain_generator": bar("domain", "generator")})


@query("agg04_split_summary", f"SELECT coalesce(split, 'none') AS split, count(*) AS n, count(DISTINCT pair_id) AS pairs, {_N('label = 0')} AS human, {_N('label = 1')} AS llm FROM ({CAND_SQL}) GROUP BY 1")
def split_summary(spark, sf):
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return cand(spark, sf).groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("pairs"), n(F.col("label") == 0).alias("human"), n(F.col("label") == 1).alias("llm"))


@query("agg05_summary", " UNION ALL ".join(f"SELECT '{d}' AS dim, coalesce(nullif(CAST({d} AS VARCHAR), ''), 'unknown') AS value, count(*) AS n FROM ({CAND_SQL}) GROUP BY ALL" for d in ("label", "bucket", "generator", "prompt_type", "round4_tag", "split")))
def summary(spark, sf):
    return P.summary(cand(spark, sf), {d: d for d in ("label", "bucket", "generator", "prompt_type", "round4_tag", "split")})


@query("agg07_08_metrics_at_thresholds", " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, tp, fp, fn, tn, {_RATES} FROM (SELECT {_CONF('p_tfidf', t)} FROM ({PREDS_SQL}))" for t in (0.25, 0.5, 0.75)))
def at_thresholds(spark, sf):
    return _rounded(M.at_grid(preds(spark, sf), spark.createDataFrame([(t,) for t in (0.25, 0.5, 0.75)], "threshold double"), p="p_tfidf"), "threshold")


@query("agg11_metrics_by_split", f"SELECT split, tp, fp, fn, tn, {_RATES} FROM (SELECT coalesce(split, 'none') AS split, {_CONF('p_step7', 0.55)} FROM ({CAND_SQL}) WHERE label IS NOT NULL GROUP BY 1)")
def by_split(spark, sf):
    own = cand(spark, sf).where("label is not null").withColumns({"split": F.coalesce("split", F.lit("none")), "pred": (F.col("p_step7") >= 0.55).cast("int")})
    return _rounded(M.metrics(own, ["split"]), "split")


@query("agg13_subset_metrics", f"SELECT 'metrics' AS part, '' AS value, tp, fp, fn, tn FROM (SELECT {_CONF('p_step7', 0.55)} FROM ({CAND_SQL}) WHERE label IN (0, 1) AND domain = 'en') UNION ALL SELECT 'fn_by_generator', coalesce(generator, 'unknown'), 0, 0, count(*), 0 FROM ({CAND_SQL}) WHERE label = 1 AND domain = 'en' AND p_step7 < 0.55 GROUP BY 2 UNION ALL SELECT 'fp_by_source', coalesce(source, 'unknown'), 0, count(*), 0, 0 FROM ({CAND_SQL}) WHERE label = 0 AND domain = 'en' AND p_step7 >= 0.55 GROUP BY 2")
def subset_metrics(spark, sf):
    own = K.subset(cand(spark, sf).withColumn("pred", (F.col("p_step7") >= 0.55).cast("int")), domain="en", generator="")
    zero = F.lit(0).cast("long")
    whole = own.agg(*M.confusion()).select(F.lit("metrics").alias("part"), F.lit("").alias("value"), *_COUNTS)
    fn = own.where("label = 1 and pred = 0").groupBy(F.coalesce("generator", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("fn_by_generator").alias("part"), "value", zero.alias("tp"), zero.alias("fp"), F.col("n").alias("fn"), zero.alias("tn"))
    fp = own.where("label = 0 and pred = 1").groupBy(F.coalesce("source", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("fp_by_source").alias("part"), "value", zero.alias("tp"), F.col("n").alias("fp"), zero.alias("fn"), zero.alias("tn"))
    return whole.unionAll(fn).unionAll(fp)


@query("agg16_style_guard_metrics", f"SELECT tp, fp, fn, tn, {_RATES}, round(v, 9) AS veto_rate, round(m, 9) AS mean_p FROM (SELECT {_CONF('p_guard', 0.6)}, avg(CAST(p_guard >= 0.6 AS INT)) AS v, avg(p_guard) AS m FROM ({PREDS_SQL}))")
def style_guard(spark, sf):
    own = P.style_guard_metrics(preds(spark, sf), 0.6, p="p_guard")
    return own.select(*_COUNTS, *(F.round(m, 6).alias(m) for m in ("accuracy", "precision", "recall", "f1")), F.round("veto_rate", 9).alias("veto_rate"), F.round("mean_p", 9).alias("mean_p"))


_SAFE = "flip_type = 'fixed_fn_candidate'"


def decided(spark, sf):
    own = cand(spark, sf).where("flip_type in ('fixed_fn_candidate', 'induced_fp')").withColumns({"limit": F.lit(0.6), "split": F.coalesce("split", F.lit("unknown"))})
    return own.withColumn("passes", K.selector_pass("flag", "limit", "p_guard"))


_DECIDED = f"SELECT *, {_PASS} AS passes FROM (SELECT * REPLACE (coalesce(split, 'unknown') AS split) FROM ({CAND_SQL})) WHERE flip_type IN ('fixed_fn_candidate', 'induced_fp')"


@query("agg17_selector_outcomes", f"SELECT split, {_N(_SAFE)} AS safe_total, {_N(_SAFE + ' AND passes')} AS safe_passed, {_N(_SAFE + ' AND NOT passes')} AS safe_blocked, round({_N(_SAFE + ' AND passes')} / nullif({_N(_SAFE)}, 0)::DOUBLE, 9) AS safe_pass_rate, {_N(f'NOT {_SAFE}')} AS unsafe_total, {_N(f'NOT {_SAFE} AND NOT passes')} AS unsafe_blocked, {_N(f'NOT {_SAFE} AND passes')} AS unsafe_false_passed, round({_N(f'NOT {_SAFE} AND NOT passes')} / nullif({_N(f'NOT {_SAFE}')}, 0)::DOUBLE, 9) AS unsafe_block_rate FROM ({_DECIDED}) GROUP BY split")
def selector_outcomes(spark, sf):
    own = P.outcomes(decided(spark, sf), ["split"], F.col("flip_type") == "fixed_fn_candidate", F.col("passes"))
    return own.withColumns({c: F.round(c, 9) for c in ("safe_pass_rate", "unsafe_block_rate")})


@query("agg20_safety_histograms", " UNION ALL ".join(f"SELECT '{k}' AS key, s AS safety, printf('%.1f-%.1f', b / 10.0::DOUBLE, (b + 1) / 10.0::DOUBLE) AS bin, count(*) AS n FROM (SELECT CASE WHEN {_SAFE} THEN 'safe' ELSE 'unsafe' END AS s, least(floor(greatest(0, least(1, {k})) * 10), 9)::INT AS b FROM ({_DECIDED})) GROUP BY ALL" for k in ("p_guard", "p_round4")))
def safety_histograms(spark, sf):
    own = decided(spark, sf).select(F.when(F.col("flip_type") == "fixed_fn_candidate", "safe").otherwise("unsafe").alias("safety"), F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("p")) for k in ("p_guard", "p_round4")))).alias("e")).select("safety", "e.*")
    return M.histogram(own, ["key", "safety"], "p").where("n > 0")


@query("agg22_buckets_by_flip", f"SELECT flip_type, {_OR('bucket', d='unknown')} AS bucket, count(*) AS n FROM ({CAND_SQL}) GROUP BY ALL")
def buckets_by_flip(spark, sf):
    return cand(spark, sf).groupBy("flip_type", N.present("bucket", default="unknown").alias("bucket")).agg(F.count("*").alias("n"))


_F1 = lambda p: f"SELECT round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END, 9) AS f1, fp, fn FROM (SELECT {_CONF(p, 0.55)} FROM ({PREDS_SQL}))"


@query("agg35_metric_deltas", f"SELECT a.f1 AS base_f1, b.f1 AS new_f1, round(b.f1 - a.f1, 6) AS f1_delta, a.fp AS base_fp, b.fp AS new_fp, b.fp - a.fp AS fp_delta, a.fn AS base_fn, b.fn AS new_fn, b.fn - a.fn AS fn_delta FROM ({_F1('p_step7')}) a CROSS JOIN ({_F1('p_neural')}) b")
def metric_deltas(spark, sf):
    own = preds(spark, sf).withColumns({f"pred_{r}": (F.col(f"p_{r}") >= 0.55).cast("int") for r in ("step7", "neural")})
    out = P.metric_delta(own, "step7", "neural")
    return out.withColumns({"base_f1": F.round("base_f1", 9), "new_f1": F.round("new_f1", 9), "f1_delta": F.round("f1_delta", 6)})


@query("agg37_seed_inspection", f"SELECT domain, source, count(*) AS n, min(w) AS shortest, max(w) AS longest, round(avg(w), 6) AS mean FROM (SELECT domain, source, {_NW('text')} AS w FROM ({CORPUS_SQL}) WHERE label = 0) GROUP BY ALL")
def seed_inspection(spark, sf):
    own = corpus(spark, sf).where("label = 0").withColumn("w", T.space_words("text").cast("long"))
    return own.groupBy("domain", "source").agg(F.count("*").alias("n"), F.min("w").alias("shortest"), F.max("w").alias("longest"), F.round(F.avg("w"), 6).alias("mean"))


# lists and orders


@query("srt03_prj30_case_lists", f"SELECT * FROM (SELECT 'unsafe_passed' AS \"case\", id, {_OR('bucket', d='unknown')} AS bucket, round(p, 9) AS p FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 0.0 ELSE p_guard END AS p FROM ({_DECIDED})) WHERE NOT {_SAFE} AND passes ORDER BY coalesce(nullif(p, 0), -1) DESC, id LIMIT 9) UNION ALL SELECT * FROM (SELECT 'safe_blocked', id, {_OR('bucket', d='unknown')}, round(p, 9) FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 0.0 ELSE p_guard END AS p FROM ({_DECIDED})) WHERE {_SAFE} AND NOT passes ORDER BY coalesce(nullif(p, 0), 2), id LIMIT 9)")
def case_lists(spark, sf):
    own = decided(spark, sf).withColumn("p", F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.col("p_guard")))
    return P.cases(own, F.col("flip_type") == "fixed_fn_candidate", F.col("passes"), "p", "id", 9).select("case", "id", N.present("bucket", default="unknown").alias("bucket"), F.round("p", 9).alias("p"))


@query("srt07_11_top_of_first", f"SELECT id, round(p_step7, 9) AS score FROM (SELECT * FROM ({PREDS_SQL}) ORDER BY id LIMIT 60) ORDER BY p_step7 DESC, id LIMIT 20")
def top_of_first(spark, sf):
    return preds(spark, sf).orderBy("id").limit(60).orderBy(F.desc("p_step7"), "id").limit(20).select("id", F.round("p_step7", 9).alias("score"))


@query("srt10_msc35_error_lists", f"SELECT kind, CASE WHEN len(l) > 5 THEN array_to_string(l[1:5], ', ') || ' ... (+' || (len(l) - 5) || ' more)' ELSE array_to_string(l, ', ') END AS ids FROM (SELECT kind, list(CAST(id AS VARCHAR) ORDER BY id) AS l FROM (SELECT id, unnest(CASE WHEN label = 0 THEN ['fp', 'all'] ELSE ['fn', 'all'] END) AS kind FROM ({PREDS_SQL}) WHERE CAST(p_step7 >= 0.55 AS INT) <> label AND domain = 'en') GROUP BY kind)")
def error_lists(spark, sf):
    own = scored(spark, sf).where("pred <> label and domain = 'en'").select("id", F.explode(F.array(F.when(F.col("label") == 0, "fp").otherwise("fn"), F.lit("all"))).alias("kind"))
    ids = F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string"))
    return own.groupBy("kind").agg(ids.alias("l")).select("kind", P.preview("l", 5).alias("ids"))


_AVG = lambda rs: "(" + " + ".join(f"p_{r}" for r in rs) + f") / {len(rs)}"
_SETS = [("step7", "tfidf"), ("step7", "neural"), ("tfidf", "neural"), ("step7", "tfidf", "neural")]


@query("srt05_msc36_top_ensembles", "SELECT ensemble, accuracy, f1 FROM (" + " UNION ALL ".join(f"SELECT '{'+'.join(s)}' AS ensemble, {len(s)} AS k, {_RATES} FROM (SELECT {_CONF(_AVG(s), 0.5)} FROM ({PREDS_SQL}))" for s in _SETS) + ") ORDER BY accuracy DESC, f1 DESC, k, ensemble LIMIT 3")
def top_ensembles(spark, sf):
    own = A.ensembles(preds(spark, sf).select("id", "label", "p_step7", "p_tfidf", "p_neural"), ["step7", "tfidf", "neural"])
    out = M.metrics(own.withColumn("pred", (F.col("p") >= 0.5).cast("int")), ["ensemble"]).select("ensemble", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))
    return out.orderBy(F.desc("accuracy"), F.desc("f1"), F.size(F.split("ensemble", r"\+")), "ensemble").limit(3)


@query("set06_msc19_disjoint_splits", f"SELECT CASE pair_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT pair_id) AS pairs FROM ({CORPUS_SQL}) GROUP BY 1")
def disjoint(spark, sf):
    own = corpus(spark, sf)
    lists = own.select("pair_id").distinct().withColumn("split", F.when(F.col("pair_id") % 3 == 0, "train").when(F.col("pair_id") % 3 == 1, "valid").otherwise("test"))
    return P.disjoint(own.join(lists, "pair_id"), "pair_id").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("pairs"))


# values


@query("fea28_29_errors", f"SELECT id, CASE WHEN label = 0 AND x = 1 THEN 'false_positive' WHEN label = 1 AND x = 0 THEN 'false_negative' WHEN label = 1 THEN 'true_positive' ELSE 'true_negative' END AS error, d AS domain, array_to_string(list_filter([CASE WHEN (p_tfidf >= 0.55) <> (p_neural >= 0.55) THEN 'tfidf_deberta_disagree' END, CASE WHEN label = 0 AND x = 1 THEN CASE d WHEN 'poetry' THEN 'human_poetry_or_fragment_fp' ELSE 'human_style_fp' END WHEN label = 1 AND x = 0 THEN CASE d WHEN 'poetry' THEN 'poetry_llm_fn' ELSE 'conservative_llm_rewrite_fn' END END], lambda v: v IS NOT NULL), ';') AS notes FROM (SELECT *, CAST(p_step7 >= 0.55 AS INT) AS x, CASE WHEN starts_with(bucket, 'poetry_') THEN 'poetry' WHEN bucket = 'academic_formal' THEN 'academic' WHEN starts_with(bucket, 'literary_') THEN 'literature' ELSE 'general_prose' END AS d FROM ({CAND_SQL}) WHERE label IS NOT NULL)")
def errors(spark, sf):
    own = cand(spark, sf).where("label is not null").withColumns({"x": (F.col("p_step7") >= 0.55).cast("int"), "d": P.rough_domain("bucket")})
    e = P.error_type("label", "x")
    return own.select("id", e.alias("error"), F.col("d").alias("domain"), P.error_notes(e, "d", "p_tfidf", "p_neural", 0.55).alias("notes"))


@query("fea12_entropy", f"SELECT id, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 9) AS entropy FROM (SELECT id, least(1 - 1e-9::DOUBLE, greatest(1e-9::DOUBLE, p_step7)) AS p FROM ({PREDS_SQL}))")
def entropy(spark, sf):
    return preds(spark, sf).select("id", F.round(X.entropy(F.col("p_step7")), 9).alias("entropy"))


@query("fea35_softmax", f"SELECT id, round(exp(p_step7 * 3) / (exp(p_step7 * 3) + exp(p_tfidf * 3)), 9) AS s FROM ({PREDS_SQL})")
def softmax(spark, sf):
    return preds(spark, sf).select("id", F.round(P.softmax(F.col("p_step7") * 3, F.col("p_tfidf") * 3)[0], 9).alias("s"))


@query("fea42_43_decision", f"SELECT c, b, CASE WHEN c >= 100000 THEN 'reached' WHEN c > b THEN 'partial_success' ELSE 'reject' END AS decision FROM (SELECT tp + tn AS c FROM (SELECT {_CONF('p_neural', 0.55)} FROM ({PREDS_SQL}))) CROSS JOIN (SELECT tp + tn AS b FROM (SELECT {_CONF('p_step7', 0.55)} FROM ({PREDS_SQL})))")
def decision(spark, sf):
    own = preds(spark, sf)
    n = lambda r: F.sum(((F.col(f"p_{r}") >= 0.55).cast("int") == F.col("label")).cast("long"))
    return own.agg(n("neural").alias("c"), n("step7").alias("b")).withColumn("decision", P.decision("c", "b", 100_000))


@query("fea44_msc14_label_targets", f"SELECT label, n, train, dev, n - train - dev AS probe FROM (SELECT label, n, round_even(n * 0.65::DOUBLE, 0)::BIGINT AS train, round_even(n * 0.25::DOUBLE, 0)::BIGINT AS dev FROM (SELECT label, count(*) AS n FROM ({PREDS_SQL}) GROUP BY label))")
def label_targets(spark, sf):
    return P.label_targets(preds(spark, sf).groupBy("label").agg(F.count("*").alias("n")), 0.65, 0.25)


@query("msc05_quality_accessor", f"SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN p_step7 END, -1.0) >= 0 AS known, round(coalesce(CASE WHEN id % 3 = 0 THEN p_step7 END, -1.0), 9) AS v FROM ({PREDS_SQL})")
def accessor(spark, sf):
    own = preds(spark, sf).withColumn("q", F.struct(F.when(F.col("id") % 3 == 0, F.col("p_step7")).alias("lexical_jaccard")))
    v = F.coalesce(F.col("q")["lexical_jaccard"], F.lit(-1.0))
    return own.select("id", (v >= 0).alias("known"), F.round(v, 9).alias("v"))


@query("msc18_source_buckets", f"SELECT id, CASE WHEN domain = 'academic' OR bucket = 'academic_formal' THEN 'chatgpt_natural_academic' WHEN domain = 'poetry' OR starts_with(bucket, 'poetry') THEN CASE WHEN bucket = 'poetry_classical' THEN 'chatgpt_archaic_poetry' ELSE 'chatgpt_poetry_freeverse' END WHEN bucket = 'literary_old_prose' THEN 'chatgpt_old_fiction' ELSE 'chatgpt_conservative_literary' END AS b FROM ({BUCKET_SQL})")
def source_buckets(spark, sf):
    b, d = F.col("bucket"), F.col("domain")
    out = F.when((d == "academic") | (b == "academic_formal"), "chatgpt_natural_academic").when((d == "poetry") | b.startswith("poetry"), F.when(b == "poetry_classical", "chatgpt_archaic_poetry").otherwise("chatgpt_poetry_freeverse")).when(b == "literary_old_prose", "chatgpt_old_fiction").otherwise("chatgpt_conservative_literary")
    return surfaced(spark, sf).select("id", out.alias("b"))


@query("msc21_candidate_summary", f"SELECT 'rows' AS part, '' AS value, count(*) AS n FROM ({CAND_SQL}) UNION ALL SELECT 'exact', '', count(*) FROM ({CAND_SQL}) WHERE {_EXACT} UNION ALL SELECT 'flip', flip_type, count(*) FROM ({CAND_SQL}) WHERE {_EXACT} GROUP BY flip_type UNION ALL SELECT 'bucket', {_OR('bucket', d='unknown')}, count(*) FROM ({CAND_SQL}) WHERE {_EXACT} GROUP BY 2")
def candidate_summary(spark, sf):
    own = cand(spark, sf)
    exact = own.where(K.exact_override())
    n = lambda df, p: df.agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), F.lit("").alias("value"), "n")
    per = P.summary(exact, {"flip": "flip_type", "bucket": "bucket"}).select(F.col("dim").alias("part"), "value", "n")
    return n(own, "rows").unionAll(n(exact, "exact")).unionAll(per)


@query("msc22_composite_index", f"SELECT split, k, max(id) AS id, count(*) - 1 AS duplicates FROM (SELECT coalesce(split, 'unknown') AS split, id % 40 AS k, id FROM ({CAND_SQL})) GROUP BY split, k")
def composite_index(spark, sf):
    own = cand(spark, sf).select(F.coalesce("split", F.lit("unknown")).alias("split"), (F.col("id") % 40).alias("k"), "id")
    return own.groupBy("split", "k").agg(F.max("id").alias("id"), (F.count("*") - 1).alias("duplicates"))


@query("msc25_alignment_report", f"SELECT 'step7' AS run, count(*) AS n, (SELECT count(*) FROM ({run_sql('step7')})) = count(*) AS row_alignment_passed FROM ({run_sql('step7')}) a JOIN ({run_sql('round4')}) b USING (id)")
def alignment_report(spark, sf):
    runs = {r: run_of(spark, sf, r) for r in ("step7", "round4")}
    both = A.many(runs).agg(F.count("*").alias("n"))
    return both.crossJoin(runs["step7"].agg(F.count("*").alias("all"))).select(F.lit("step7").alias("run"), "n", (F.col("n") == F.col("all")).alias("row_alignment_passed"))


@query("msc29_run_reports", " UNION ALL ".join(f"SELECT '{r}' AS run, coalesce(domain, '*') AS domain, tp, fp, fn, tn, {_RATES} FROM (SELECT domain, {_CONF('p', 0.55)} FROM ({run_sql(r)}) GROUP BY GROUPING SETS ((domain), ()))" for r in ("step7", "neural")))
def run_reports(spark, sf):
    long = reduce(lambda a, b: a.unionAll(b), (run_of(spark, sf, r).select(F.lit(r).alias("run"), "domain", "label", "pred") for r in ("step7", "neural")))
    own = long.groupingSets([["run", "domain"], ["run"]], "run", "domain").agg(*M.confusion())
    return _rounded(M.rates(own.withColumn("domain", F.coalesce("domain", F.lit("*")))), "run", "domain")


@query("msc34_guard_inputs", f"SELECT id FROM ({CAND_SQL}) WHERE split = 'dev' AND {_EXACT}")
def guard_inputs(spark, sf):
    return cand(spark, sf).where(F.col("split") == "dev").where(K.exact_override()).select("id")


@query("msc37_guarded_rows", f"SELECT id, CASE WHEN o THEN CAST(1 AS INT) ELSE CAST(p_step7 >= 0.55 AS INT) END AS prediction, o AS overridden, round(CASE WHEN o THEN greatest(p_step7, p_round4) ELSE p_step7 END, 9) AS probability FROM (SELECT *, p_step7 < 0.55 AND p_round4 >= 0.7 AND p_guard <= 0.4 AS o FROM ({PREDS_SQL}))")
def guarded_rows(spark, sf):
    o = (F.col("p_step7") < 0.55) & (F.col("p_round4") >= 0.7) & (F.col("p_guard") <= 0.4)
    return preds(spark, sf).withColumn("o", o).select("id", F.when(F.col("o"), 1).otherwise((F.col("p_step7") >= 0.55).cast("int")).alias("prediction"), F.col("o").alias("overridden"), F.round(F.when(F.col("o"), F.greatest("p_step7", "p_round4")).otherwise(F.col("p_step7")), 9).alias("probability"))


_ROUTE = "CASE bucket WHEN 'academic_formal' THEN 0.4 WHEN 'poetry_classical' THEN 0.7 ELSE 0.55 END"


@query("msc32_38_routed_metrics", f"SELECT tp, fp, fn, tn, {_RATES} FROM (SELECT {_N(f'label = 1 AND p_step7 >= {_ROUTE}')} AS tp, {_N(f'label = 0 AND p_step7 >= {_ROUTE}')} AS fp, {_N(f'label = 1 AND p_step7 < {_ROUTE}')} AS fn, {_N(f'label = 0 AND p_step7 < {_ROUTE}')} AS tn FROM ({CAND_SQL}) WHERE label IS NOT NULL)")
def routed_metrics(spark, sf):
    from textloom.operators.rules import routed

    own = cand(spark, sf).where("label is not null")
    return _rounded(M.metrics(own.withColumn("pred", routed("p_step7", "bucket", {"academic_formal": 0.4, "poetry_classical": 0.7}, 0.55))))


@query("msc39_deltas_by_split", f"SELECT split, {_N('a <> b')} AS overrides, {_N('label = 1 AND a = 0 AND b = 1')} AS fixed_fn, {_N('label = 0 AND a = 0 AND b = 1')} AS induced_fp, {_N('a = label AND b <> label')} AS broke FROM (SELECT coalesce(split, 'none') AS split, label, CAST(p_step7 >= 0.55 AS INT) AS a, CAST(p_neural >= 0.55 AS INT) AS b FROM ({CAND_SQL}) WHERE label IS NOT NULL) GROUP BY split")
def deltas_by_split(spark, sf):
    a, b, y = F.col("a"), F.col("b"), F.col("label")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    own = cand(spark, sf).where("label is not null").select(F.coalesce("split", F.lit("none")).alias("split"), "label", (F.col("p_step7") >= 0.55).cast("int").alias("a"), (F.col("p_neural") >= 0.55).cast("int").alias("b"))
    return own.groupBy("split").agg(n(a != b).alias("overrides"), n((y == 1) & (a == 0) & (b == 1)).alias("fixed_fn"), n((y == 0) & (a == 0) & (b == 1)).alias("induced_fp"), n((a == y) & (b != y)).alias("broke"))


@query("msc42_labelled_texts", f"SELECT id, label FROM ({CORPUS_SQL}) WHERE label IN (0, 1) AND length(trim(text)) > 0")
def labelled_texts(spark, sf):
    from textloom.sources.readers import labelled

    return labelled(corpus(spark, sf)).select("id", "label")


@query("msc43_44_sampler_weights", f"SELECT id, round(w / sum(1) OVER (PARTITION BY label), 9) AS weight FROM (SELECT id, label, CASE domain WHEN 'en' THEN 1.5::DOUBLE WHEN 'de' THEN 0.5 ELSE 1.0 END AS w FROM ({PREDS_SQL}))")
def sampler_weights(spark, sf):
    own = preds(spark, sf).withColumn("w", N.row_weight({"en": 1.5, "de": 0.5}, F.lit(1.0), "label", "domain"))
    per = own.groupBy("label").agg(F.count("*").alias("n"))
    return own.join(F.broadcast(per), "label").select("id", F.round(F.col("w") / F.col("n"), 9).alias("weight"))


@query("win25_bucket_quotas", f"SELECT domain, count(*) AS n FROM ({CORPUS_SQL}) WHERE domain IN ('en', 'fr') GROUP BY domain HAVING count(*) < 3 UNION ALL SELECT 'en', 3 UNION ALL SELECT 'fr', 2")
def bucket_quotas(spark, sf):
    own = corpus(spark, sf).withColumn("s", S.shuffled("id"))
    return S.quotas(own, "domain", {"en": 3, "fr": 2}, [F.col("s"), F.col("id")]).groupBy("domain").agg(F.count("*").alias("n"))


@query("win31_msc01_running_ids", f"SELECT id AS doc_id, k, printf('human_par_%06d', row_number() OVER (ORDER BY id, k)) AS id FROM (SELECT id, unnest(generate_series(1, n)) AS k FROM (SELECT id, 1 + id % 3 AS n FROM ({CORPUS_SQL})))")
def running_ids(spark, sf):
    from textloom.operators.order import positions

    own = corpus(spark, sf).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("id") % 3)).alias("k"))
    return positions(own, ["doc_id", "k"]).select("doc_id", "k", F.format_string("human_par_%06d", F.col("position").cast("int")).alias("id"))


# text


@query("txt02_replaced", f"SELECT id, md5(replace(replace(text, 'the', 'THE'), 'THE a', '<a>')) AS h FROM ({CORPUS_SQL})")
def replaced(spark, sf):
    return corpus(spark, sf).select("id", F.md5(T.replace_many(F.col("text"), [("the", "THE"), ("THE a", "<a>")]).cast("binary")).alias("h"))


@query("txt11_13_clean_keys", rf"SELECT id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key FROM ({CORPUS_SQL})")
def clean_keys(spark, sf):
    return corpus(spark, sf).select("id", F.md5(T.squeeze("text").cast("binary")).alias("clean"), F.md5(T.text_key("text").cast("binary")).alias("key"))


@query("txt16_alphabetic_words", f"SELECT id, CAST(len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS INT) AS n FROM ({CORPUS_SQL})")
def alphabetic(spark, sf):
    return corpus(spark, sf).select("id", T.word_count("text").alias("n"))


@query("txt08_boilerplate", f"SELECT id, md5({_STRIP.format('body')}) AS h FROM (SELECT id, CASE WHEN id % 3 = 0 THEN text ELSE text END AS body FROM ({CORPUS_SQL}) WHERE NOT contains(text, '***'))")
def boilerplate(spark, sf):
    own = corpus(spark, sf).where(~F.contains("text", F.lit("***"))).withColumn("w", F.when(F.col("id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("*** START OF BOOK\n"), "text")))
    return own.select("id", F.md5(T.strip_boilerplate("w").cast("binary")).alias("h"))


@query("txt09_10_blocks", f"SELECT id, CAST(1 + id % 2 AS INT) AS blocks, 'a line' || chr(10) || 'and another' AS first FROM ({CORPUS_SQL})")
def blocks(spark, sf):
    one = F.lit("_a_ line [12]\n \nand another  123\n42\nXIV.")
    own = corpus(spark, sf).withColumn("t", F.when(F.col("id") % 2 == 0, one).otherwise(F.concat(one, F.lit("\n\n \n"), F.lit("next block"))))
    b = T.blocks("t")
    return own.select("id", F.size(b).alias("blocks"), T.normalize_block(F.get(b, F.lit(0))).alias("first"))


@query("txt19_21_run_names", "SELECT n, CASE WHEN ends_with(s, '_predictions') THEN s[1:length(s) - 12] ELSE s END AS name FROM (SELECT n, CASE WHEN starts_with(stem, 'teacher_test_') THEN stem[14:] ELSE stem END AS s FROM (SELECT event_type AS n, 'teacher_test_' || event_type || '_predictions' AS stem FROM events GROUP BY event_type))")
def run_names(spark, sf):
    own = table(spark, sf, "events").select("event_type").distinct().select(F.col("event_type").alias("n"), F.concat(F.lit("x/teacher_test_"), "event_type", F.lit("_predictions.jsonl")).alias("path"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return own.select("n", F.regexp_replace(F.regexp_replace(stem, "^teacher_test_", ""), "_predictions$", "").alias("name"))


@query("txt23_prompt_tasks", f"SELECT id, prompt, text_md5, kind FROM (SELECT id, md5('Rewrite: ' || text) AS prompt, md5(text) AS text_md5, 'verse' AS kind FROM ({CORPUS_SQL}) WHERE label = 0 AND domain = 'fr' UNION ALL SELECT id, md5('Turn into ' || text || ' now'), md5(text), 'prose' FROM ({CORPUS_SQL}) WHERE label = 0 AND domain = 'en')")
def prompt_tasks(spark, sf):
    prompts = spark.createDataFrame([("fr", "verse", "Rewrite: {text}"), ("en", "prose", "Turn into {text} now")], "domain string, kind string, template string")
    own = corpus(spark, sf).where("label = 0").join(F.broadcast(prompts), "domain")
    return own.select("id", F.md5(T.fill_prompt("template", "text").cast("binary")).alias("prompt"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "kind")


# feature blocks


@query("fea03_kept_buckets", f"SELECT c.id, coalesce(nullif(c.given, ''), b.bucket) AS bucket FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'given' WHEN 1 THEN '' END AS given FROM ({CORPUS_SQL})) c JOIN ({BUCKET_SQL}) b ON c.id = b.id")
def kept_buckets(spark, sf):
    own = surfaced(spark, sf).withColumn("given", F.when(F.col("id") % 3 == 0, "given").when(F.col("id") % 3 == 1, ""))
    return own.select("id", N.present("given", "bucket").alias("bucket"))


@query("fea07_stacker_features", f"SELECT id, round(abs(p_tfidf - p_neural), 9) AS abs_a_b, round(abs(p_neural - p_round4), 9) AS abs_b_c, round(greatest(p_tfidf, p_neural, p_round4), 9) AS top, round(least(p_tfidf, p_neural, p_round4), 9) AS low, {_OR('bucket', 'domain')} AS bucket FROM ({CAND_SQL}) WHERE label IS NOT NULL")
def stacker_features(spark, sf):
    r9 = lambda c, n: F.round(c, 9).alias(n)
    f = X.fusion_features(["tfidf", "neural", "round4"])
    return cand(spark, sf).where("label is not null").select("id", r9(f["abs_tfidf_neural"], "abs_a_b"), r9(f["abs_neural_round4"], "abs_b_c"), r9(f["prob_max"], "top"), r9(f["prob_min"], "low"), N.present("bucket", "domain").alias("bucket"))


@query("fea08_11_guard_features", f"SELECT id, round(p_step7, 9) AS p_base, round(p_round4 - p_step7, 9) AS delta, round(abs(p_step7 - 0.55), 9) AS margin, coalesce(generator, 'unknown') AS generator, coalesce(split, 'unknown') AS split, {_NW('text')} AS words FROM ({CAND_SQL})")
def guard_features(spark, sf):
    return cand(spark, sf).select("id", F.round("p_step7", 9).alias("p_base"), F.round(F.col("p_round4") - F.col("p_step7"), 9).alias("delta"), F.round(F.abs(F.col("p_step7") - 0.55), 9).alias("margin"), F.coalesce("generator", F.lit("unknown")).alias("generator"), F.coalesce("split", F.lit("unknown")).alias("split"), T.space_words("text").cast("long").alias("words"))


@query("fea09_missing_indicators", f"SELECT id, round(coalesce(a, 0.0), 9) AS a, CAST(a IS NOT NULL AS DOUBLE) AS has_a, round(coalesce(b, 0.0), 9) AS b, CAST(b IS NOT NULL AS DOUBLE) AS has_b FROM (SELECT id, CASE WHEN id % 2 = 0 THEN p_step7 END AS a, CASE WHEN id % 3 = 0 THEN p_guard END AS b FROM ({PREDS_SQL}))")
def indicators(spark, sf):
    own = preds(spark, sf).select("id", F.when(F.col("id") % 2 == 0, F.col("p_step7")).alias("a"), F.when(F.col("id") % 3 == 0, F.col("p_guard")).alias("b"))
    f = P.missing_indicators(["a", "b"])
    return own.select("id", *(F.round(c, 9).alias(n) for n, c in f.items()))


@query("fea10_moments", f"SELECT id, round((a + b + c) / 3, 9) AS p_mean, round(sqrt(((a - m) ** 2 + (b - m) ** 2 + (c - m) ** 2) / 3), 9) AS p_std, round(greatest(a, b, c), 9) AS p_max, round(least(a, b, c), 9) AS p_min, round((abs(a - 0.5) + abs(b - 0.5) + abs(c - 0.5)) / 3, 9) AS p_margin FROM (SELECT id, p_step7 AS a, p_round4 AS b, p_neural AS c, (p_step7 + p_round4 + p_neural) / 3 AS m FROM ({PREDS_SQL}))")
def moments(spark, sf):
    return preds(spark, sf).select("id", *(F.round(c, 9).alias(n) for n, c in P.moments("p_step7", "p_round4", "p_neural").items()))


@query("fea14_thresholds", f"SELECT id, CAST(CASE WHEN starts_with(p, 'chatgpt_conservative') OR contains(p, 'old_fiction') THEN 20 WHEN contains(p, 'archaic_poetry') OR contains(p, 'poetry_freeverse') THEN 12 ELSE 20 END AS INT) AS words, CASE WHEN contains(p, 'old_fiction') THEN 0.9 WHEN contains(p, 'archaic_poetry') THEN 0.92 ELSE 0.82 END::DOUBLE AS jaccard FROM (SELECT id, lower(coalesce(prompt_type, '')) AS p FROM ({CAND_SQL}))")
def quality_thresholds(spark, sf):
    q = Q.thresholds("domain", "prompt_type")
    return cand(spark, sf).select("id", q["min_abs_words"].alias("words"), q["max_jaccard"].alias("jaccard"))
