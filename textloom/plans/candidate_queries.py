"""Queries of candidate rows: projections, eligibility, resolvers and joins over a wide surrogate table."""

from pyspark.sql import functions as F

from textloom.functions import features as X
from textloom.functions import lexicon as L
from textloom.functions import quality as Q
from textloom.operators import align as A
from textloom.operators import candidates as K
from textloom.operators import normalise as N
from textloom.plans.feature_queries import BUCKET_SQL, _has
from textloom.plans.registry import query
from textloom.plans.validity_queries import _META, _NW, _STRIP, TRUNCATED_SQL
from textloom.plans.views import CORPUS_SQL, PREDS_SQL, REWRITES_SQL, RUNS, corpus, preds, probability, rewrites, run_of, run_sql, table

#: Columns that the driver tables lack: picked from lists by id // d % n, alike in both engines.
PICKS = {
    "bucket": (1, ["poetry_classical", "poetry_freeverse", "academic_formal", "literary_old_prose", "literary_short_fragment", "general_prose", None, ""]),
    "generator": (3, ["", "gemini", "chatgpt", None]),
    "assigned_generator": (5, ["deepseek", None, ""]),
    "generation": (7, ["llm_rewrite", None, "", "draft"]),
    "prompt_type": (2, ["archaic_poetry", "old_fiction", "academic_plain", "", None]),
    "input_name": (1, ["round3_pool.jsonl", "my_round2_set.jsonl", "llm_rewrite_hardpos.jsonl", "Poetry more.jsonl", "academic_seed.jsonl", "hard_negative_human.jsonl", "llm_rewrite_gemini.jsonl"]),
    "round4_tag": (2, ["base_keep", "human_polished_general_mirror", None, "llm_old_fiction_x"]),
    "round4_source_stage": (3, ["", "step7_base_train", "poetry_pool", None, "generic_rewrite_pool"]),
    "round3_source_stage": (5, [None, "r3", ""]),
    "flip_type": (1, ["fixed_fn_candidate", "induced_fp", "unchanged_correct", "unchanged_wrong", "fixed_fp_candidate"]),
    "override_safety": (2, ["safe_override", "unsafe_override", None, ""]),
    "split": (1, ["train", "dev", "probe", None]),
    "origin_split": (4, ["train", "dev", None]),
    "finish_reason": (5, ["stop", "length", None]),
    "source_pair_id": (2, [None, "", "sp1", "sp2", "sp3"]),
    "source_id": (3, ["s1", "", None]),
    "md_title": (2, [None, "A title", ""]),
    "md_paper": (3, ["", None, "P1", "P2", None]),
    "flag": (1, ["1", "0", "", None, "x"]),
    "flip_label": (3, ["0", "1", "2", None, "", "1"]),
    "target": (2, [None, "1", "0", "7"]),
    "prob_llm": (1, ["0.7", None, "x", "0.2"]),
    "score": (2, ["0.9", None, "0.1"]),
    "prediction": (3, ["1", "0", None, "5"]),
}
_LIT = lambda v: "NULL" if v is None else f"'{v}'"
_P = {r: f"CAST(id * {a} % {m} AS DOUBLE) / {float(m)}" for r, (a, m) in RUNS.items()}
CAND_SQL = f"""SELECT *, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS passed, CAST(id % 2 AS INT) AS step7_pred, CASE id // 2 % 3 WHEN 0 THEN CAST(0 AS INT) WHEN 1 THEN CAST(1 AS INT) END AS round4_pred,
 {', '.join(f"(CAST([{', '.join(map(_LIT, vs))}] AS VARCHAR[]))[CAST(id // {d} % {len(vs)} AS INT) + 1] AS {c}" for c, (d, vs) in PICKS.items())}, {', '.join(f'{p} AS p_{r}' for r, p in _P.items())} FROM ({CORPUS_SQL})"""


def cand(spark, sf):
    pick = {c: F.element_at(F.array(*(F.lit(v).cast("string") for v in vs)), (F.expr(f"id div {d}") % len(vs)).cast("int") + 1) for c, (d, vs) in PICKS.items()}
    own = corpus(spark, sf).withColumns({"passed": F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False), "step7_pred": (F.col("id") % 2).cast("int"), "round4_pred": F.when(F.expr("id div 2 % 3") < 2, F.expr("id div 2 % 3").cast("int")), **pick, **{f"p_{r}": probability(r) for r in RUNS}})
    return own.withColumn("metadata", F.map_filter(F.create_map(F.lit("title"), "md_title", F.lit("paper_id"), "md_paper"), lambda _, v: v.isNotNull()))


_OR = lambda *cs, d=None: "coalesce(" + ", ".join([f"nullif(CAST({c} AS VARCHAR), '')" for c in cs] + ([f"'{d}'"] if d is not None else [])) + ")"
_BLANK = f"length({_STRIP.format('text')}) = 0"
_KEY = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_SEED = f"coalesce(label = 0 AND NOT {_BLANK} AND pair_id IS NOT NULL, false)"


# eligibility


@query("flt04_lenient_truncation", f"SELECT id, {TRUNCATED_SQL('text')} AS truncated FROM ({CORPUS_SQL})")
def lenient(spark, sf):
    return corpus(spark, sf).select("id", Q.looks_truncated("text", dangling=False).alias("truncated"))


@query("flt10_academic_negative", rf"""SELECT id, NOT coalesce({_has(L.BAD_SECTIONS, 'lower(source)')}, false) AND {_NW('text')} BETWEEN 60 AND 260 AND len(regexp_extract_all(text, '[0-9]'))::DOUBLE / greatest(1, length(text)) <= 0.15
 AND NOT ({_has(L.NOISE_MARKERS, 'lower(text)')} OR len(regexp_extract_all(text, '[{{}}\[\]]')) >= 6 OR len(regexp_extract_all(text, '"[A-Za-z_][A-Za-z0-9_]*"\s*:')) >= 2 OR len(regexp_extract_all(text, '[{{}}\[\]<>|\\]'))::DOUBLE / greatest(1, length(text)) > 0.025) AS fit FROM ({CORPUS_SQL})""")
def academic_negative(spark, sf):
    return corpus(spark, sf).select("id", K.valid_academic_negative("text", "source").alias("fit"))


@query("flt12_13_sections_keywords", f"SELECT id, coalesce({_has(L.BAD_SECTIONS, 'lower(s)')}, false) AS bad_section, {_has(L.ACADEMIC_KEYWORDS, 'lower(text)')} AS keyword FROM (SELECT id, text, CASE id % 3 WHEN 0 THEN 'References ' || source WHEN 1 THEN source END AS s FROM ({CORPUS_SQL}))")
def sections(spark, sf):
    own = corpus(spark, sf).withColumn("s", F.when(F.col("id") % 3 == 0, F.concat(F.lit("References "), "source")).when(F.col("id") % 3 == 1, F.col("source")))
    return own.select("id", Q.bad_section("s").alias("bad_section"), Q.has_keyword("text").alias("keyword"))


_LEAK = "(?i)" + "|".join(L.PROMPT_LEAKAGE).replace("'", "''")


@query("flt16_quality_reason", f"SELECT id, CASE WHEN {_BLANK} THEN 'empty_text' WHEN {_NW('text')} < 15 THEN 'too_short' WHEN coalesce(label = 1 AND NOT passed, false) THEN 'failed_basic_quality' WHEN coalesce(label = 1 AND regexp_matches(text, '{_LEAK}'), false) THEN 'prompt_leakage' ELSE 'ok' END AS reason FROM ({CAND_SQL})")
def quality_reason(spark, sf):
    return cand(spark, sf).select("id", K.quality_reason().alias("reason"))


_JACCARD = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END"
_TASKS = f"SELECT *, {_JACCARD} AS j, {_NW('text')}::DOUBLE / greatest(1, {_NW('source_text')}) AS ratio FROM (SELECT CASE WHEN n % 11 = 0 THEN '' ELSE task_id END AS task_id, source_text, CASE WHEN n % 7 = 0 THEN ' ' ELSE rewrite_text END AS text, domain, CAST(1 - CAST(n % 13 = 0 AS INT) AS INT) AS label, CASE WHEN n % 3 = 0 THEN 'chatgpt' ELSE 'gemini' END AS generator, n % 5 <> 0 AS passed, CASE n % 4 WHEN 0 THEN 'length' WHEN 1 THEN 'stop' END AS finish_reason, CASE WHEN n % 4 = 2 THEN ['too_short_relative', 'odd'] WHEN n % 4 = 1 THEN CAST([] AS VARCHAR[]) END AS issues, CASE n % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN '' END AS error, list_distinct(regexp_extract_all(lower(source_text), '[A-Za-z'']+')) AS a, list_distinct(regexp_extract_all(lower(CASE WHEN n % 7 = 0 THEN ' ' ELSE rewrite_text END), '[A-Za-z'']+')) AS b, n FROM (SELECT *, length(source_text) + length(rewrite_text) AS n FROM ({REWRITES_SQL})))"


def tasks(spark, sf):
    n = F.col("n")
    own = rewrites(spark, sf).withColumn("n", F.length("source_text") + F.length("rewrite_text"))
    return own.select(
        F.when(n % 11 == 0, "").otherwise(F.col("task_id")).alias("task_id"), "source_text", F.when(n % 7 == 0, " ").otherwise(F.col("rewrite_text")).alias("text"), "domain", F.when(n % 13 == 0, 0).otherwise(1).alias("label"),
        F.when(n % 3 == 0, "chatgpt").otherwise("gemini").alias("generator"), (n % 5 != 0).alias("passed"), F.when(n % 4 == 0, "length").when(n % 4 == 1, "stop").alias("finish_reason"),
        F.when(n % 4 == 2, F.array(F.lit("too_short_relative"), F.lit("odd"))).when(n % 4 == 1, F.array().cast("array<string>")).alias("issues"), F.when(n % 6 == 0, "timeout").when(n % 6 == 1, "").alias("error"), "n",
    )


_TRUNC = TRUNCATED_SQL("text")


@query("flt18_valid_rewrite", f"SELECT source_text AS s, n, coalesce(task_id <> '' AND NOT {_BLANK} AND label = 1 AND generator = 'gemini' AND ratio >= 0.45 AND j <= 0.82 AND NOT coalesce(finish_reason = 'length', false) AND passed AND NOT {_TRUNC}, false) AS valid FROM ({_TASKS})")
def valid_rewrite(spark, sf):
    return tasks(spark, sf).select(F.col("source_text").alias("s"), F.col("n").cast("long").alias("n"), K.valid_rewrite("gemini", 0.45, 0.82).alias("valid"))


@query("flt30_reasons_to_rerun", f"""SELECT source_text AS s, n, array_to_string(CASE WHEN {_BLANK} THEN list_concat(m, ['empty_text']) ELSE list_concat(list_filter(l, lambda x, i: list_position(l, x) = i), list_filter([CASE WHEN finish_reason = 'length' THEN 'finish_reason_length' END], lambda x: x IS NOT NULL)) END, ',') AS reasons FROM (
 SELECT *, list_filter([CASE WHEN task_id = '' THEN 'missing_task_id' END], lambda x: x IS NOT NULL) AS m, list_concat(list_filter([CASE WHEN task_id = '' THEN 'missing_task_id' END, CASE WHEN {_TRUNC} THEN 'possibly_truncated' END, CASE WHEN ratio < 0.45 THEN 'too_short_relative' END, CASE WHEN j > 0.82 THEN 'too_similar_to_source' END], lambda x: x IS NOT NULL), coalesce(issues, []), list_filter([CASE WHEN NOT passed THEN 'quality_failed' END], lambda x: x IS NOT NULL)) AS l FROM ({_TASKS}))""")
def rerun(spark, sf):
    r = K.reasons_to_rerun(0.45, 0.82, issues=F.col("issues"), passed=F.col("passed"), finish=F.col("finish_reason"))
    return tasks(spark, sf).select(F.col("source_text").alias("s"), F.col("n").cast("long").alias("n"), F.array_join(r, ",").alias("reasons"))


_FAILED = "list_concat(list_filter([nullif(error, ''), 'finish_reason=' || nullif(finish_reason, '')], lambda x: x IS NOT NULL), coalesce(issues, []))"


@query("msc17_failure_reasons", f"SELECT source_text AS s, n, array_to_string(CASE WHEN len({_FAILED}) = 0 THEN ['failed_file_record'] ELSE {_FAILED} END, ',') AS reasons FROM ({_TASKS}) WHERE task_id <> ''")
def failures(spark, sf):
    return tasks(spark, sf).where("task_id <> ''").select(F.col("source_text").alias("s"), F.col("n").cast("long").alias("n"), F.array_join(K.failure_reasons(), ",").alias("reasons"))


@query("agg39_reason_counts", f"SELECT reason, count(*) AS n FROM (SELECT unnest(list_distinct(CASE WHEN len({_FAILED}) = 0 THEN ['failed_file_record'] ELSE {_FAILED} END)) AS reason FROM ({_TASKS}) WHERE task_id <> '') GROUP BY reason")
def reason_counts(spark, sf):
    return tasks(spark, sf).where("task_id <> ''").select(F.explode(F.array_distinct(K.failure_reasons())).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("flt19_passed_quality", f"SELECT id, coalesce(passed, false) AS passed FROM ({CAND_SQL}) WHERE label = 1")
def passed(spark, sf):
    return cand(spark, sf).where("label = 1").select("id", F.coalesce("passed", F.lit(False)).alias("passed"))


@query("flt20_21_22_valid_rows", f"SELECT id, {_SEED} AS seed, coalesce(NOT {_BLANK} AND label = 0 AND domain = 'academic' AND pair_id IS NOT NULL, false) AS academic, coalesce(label IN (0, 1) AND NOT {_BLANK}, false) AS detection FROM (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN 'academic' ELSE domain END AS domain) FROM ({CAND_SQL}))")
def valid_rows(spark, sf):
    own = cand(spark, sf).withColumn("domain", F.when(F.col("id") % 2 == 0, "academic").otherwise(F.col("domain")))
    return own.select("id", K.valid_human_seed().alias("seed"), K.valid_academic_seed().alias("academic"), K.valid_detection().alias("detection"))


_EXACT = "coalesce(flip_type IN ('fixed_fn_candidate', 'induced_fp') AND step7_pred = 0 AND round4_pred = 1, false)"


@query("flt23_exact_override", f"SELECT id FROM ({CAND_SQL}) WHERE {_EXACT}")
def exact_override(spark, sf):
    return cand(spark, sf).where(K.exact_override()).select("id")


@query("flt24_residual_proxy", f"SELECT id FROM ({CAND_SQL}) WHERE NOT starts_with(coalesce(round4_tag, ''), 'base_') AND coalesce(round4_source_stage, '') NOT IN ('', 'step7_base_train')")
def residual_proxy(spark, sf):
    return cand(spark, sf).where(K.residual_proxy()).select("id")


@query("flt26_subset", f"SELECT id FROM ({CAND_SQL}) WHERE label IN (0, 1) AND domain = 'en' AND generator = 'gemini'")
def subset(spark, sf):
    return K.subset(cand(spark, sf).withColumn("pred", F.col("step7_pred")), domain="en", generator="gemini", source="").select("id")


@query("flt27_allowed_origins", f"SELECT id FROM ({CAND_SQL}) WHERE coalesce(origin_split, '') IN ('train', 'dev') AND coalesce(round4_source_stage, '') NOT IN ('poetry_pool')")
def allowed(spark, sf):
    own = cand(spark, sf)
    return own.where(K.allowed(N.present("origin_split", default=""), ("train", "dev")) & K.allowed(N.present("round4_source_stage", default=""), (), ("poetry_pool",)) & K.allowed(F.col("id"))).select("id")


_PASS = "CASE WHEN flag IS NOT NULL AND flag <> '' THEN coalesce(TRY_CAST(flag AS INT), 0) <> 0 ELSE coalesce(p_guard >= 0.6, false) END"


@query("flt28_selector_pass", f"SELECT id, {_PASS} AS pass FROM ({CAND_SQL})")
def selector_pass(spark, sf):
    own = cand(spark, sf).withColumn("limit", F.lit(0.6))
    return own.select("id", K.selector_pass("flag", "limit", "p_guard").alias("pass"))


# projections


@query("prj03_human_seed_rows", f"SELECT id, CAST(0 AS INT) AS label, 'human' AS generation, coalesce(domain, 'unknown') AS domain, coalesce(source, 'unknown') AS source FROM ({CAND_SQL}) WHERE {_SEED}")
def human_seed(spark, sf):
    return K.human_seed_rows(cand(spark, sf)).select("id", "label", "generation", "domain", "source")


@query("prj04_hard_negative_rows", f"SELECT id, CAST(0 AS INT) AS label, 'human' AS generator, 'human' AS model, 'human' AS generation, 'human_hard_negative' AS prompt_type, 'train' AS split, 'hard_negative_human' AS augmentation, md_title AS title FROM ({CAND_SQL}) WHERE label = 0")
def hard_negative(spark, sf):
    own = K.human_train_rows(cand(spark, sf).where("label = 0"), "hard_negative_human")
    return own.select("id", "label", "generator", "model", "generation", "prompt_type", "split", F.col("metadata")["training_augmentation"].alias("augmentation"), F.col("metadata")["title"].alias("title"))


_GEN = _OR("generator", "assigned_generator", d="chatgpt")


@query("prj05_llm_positive_rows", f"SELECT id, CAST(1 AS INT) AS label, {_GEN} AS generator, coalesce(nullif(source, ''), {_GEN}) AS source, {_OR('generation', d='llm_rewrite')} AS generation, 'train' AS split, 'chatgpt_hard_positive' AS augmentation FROM (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN '' ELSE source END AS source) FROM ({CAND_SQL})) WHERE label = 1 AND passed")
def llm_positive(spark, sf):
    own = cand(spark, sf).withColumn("source", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("source"))).where("label = 1 and passed")
    return K.llm_train_rows(own, "chatgpt_hard_positive").select("id", "label", "generator", "source", "generation", "split", F.col("metadata")["training_augmentation"].alias("augmentation"))


@query("prj06_poetry_rows", f"SELECT id, 'poetry' AS domain, CASE WHEN label = 0 THEN 'human' ELSE {_GEN} END AS generator, CASE WHEN label = 0 THEN {_OR('prompt_type', d='human_poetry_expansion')} ELSE prompt_type END AS prompt_type, CASE WHEN label = 0 THEN 'poetry_expansion_human' ELSE 'poetry_expansion_llm' END AS augmentation FROM ({CAND_SQL}) WHERE label IN (0, 1)")
def poetry_rows(spark, sf):
    own = cand(spark, sf)
    human = K.human_train_rows(own.where("label = 0"), "poetry_expansion_human", N.present("prompt_type", default="human_poetry_expansion"), "poetry")
    both = human.unionByName(K.llm_train_rows(own.where("label = 1"), "poetry_expansion_llm", "poetry"), allowMissingColumns=True)
    return both.select("id", "domain", "generator", "prompt_type", F.col("metadata")["training_augmentation"].alias("augmentation"))


@query("prj08_msc02_hard_negative_samples", f"SELECT printf('human_hardneg_%06d', n) AS id, printf('pair_hardneg_%06d', n) AS pair_id, printf('verse_%06d', n) AS source_id, CAST(id AS VARCHAR) AS original_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS INT) AS word_count FROM (SELECT *, row_number() OVER (ORDER BY id) + 4 AS n FROM ({CAND_SQL}) WHERE label = 0)")
def hard_negative_samples(spark, sf):
    return K.hard_negative_samples(cand(spark, sf).where("label = 0"), "verse", ["id"], 5).select("id", "pair_id", "source_id", "original_id", "word_count")


_HARD = {0: "CASE WHEN bucket = 'poetry_classical' THEN 'classical_poetry_human' WHEN bucket = 'poetry_freeverse' THEN 'modern_freeverse_human' WHEN bucket = 'academic_formal' OR domain = 'academic' THEN 'formal_academic_human' WHEN bucket = 'literary_short_fragment' THEN 'short_fragment_human' ELSE 'ornate_literary_prose_human' END"}


@query("prj09_teacher_like", f"SELECT id, {_HARD[0]} AS round2_tag, {_STRIP.format('text')} AS text, {_OR('domain', d='unknown')} AS domain, 'human' AS generator, coalesce(nullif(source, ''), 'human') AS source, {_OR('pair_id', 'source_id', 'id')} AS pair_id, {_OR('source_id', 'id')} AS source_id, 'pool' AS round2_source FROM ({CAND_SQL}) WHERE label = 0")
def teacher_like(spark, sf):
    return K.teacher_like(cand(spark, sf).where("label = 0"), 0, "pool").select("id", "round2_tag", "text", "domain", "generator", "source", "pair_id", "source_id", "round2_source")


_GUARD_TAG = "CASE WHEN label = 0 THEN CASE WHEN bucket IN ('poetry_classical', 'poetry_freeverse', 'literary_old_prose') THEN 'human_' || bucket || '_mirror' WHEN bucket = 'academic_formal' OR domain = 'academic' THEN 'human_formal_academic_mirror' WHEN bucket = 'literary_short_fragment' THEN 'human_short_fragment_mirror' ELSE 'human_ornate_literary_mirror' END WHEN bucket = 'poetry_classical' OR contains(pt, 'archaic') THEN 'llm_archaic_poetry_hardpos' WHEN bucket = 'poetry_freeverse' OR lower(domain) = 'poetry' THEN 'llm_poetry_preserving_hardpos' WHEN bucket = 'academic_formal' OR lower(domain) = 'academic' THEN 'llm_natural_academic_hardpos' WHEN bucket = 'literary_old_prose' OR contains(pt, 'old') THEN 'llm_old_fiction_style_hardpos' WHEN bucket = 'literary_short_fragment' THEN 'llm_short_fragment_hardpos' ELSE 'llm_conservative_literary_hardpos' END"
_GUARD_STAGE = "CASE WHEN contains(nm, 'round2') THEN 'round2_reused_pool' WHEN contains(nm, 'poetry') THEN 'round3_poetry_mirror_pool' WHEN contains(nm, 'academic') THEN 'round3_academic_mirror_pool' WHEN contains(nm, 'hard_negative') THEN 'round3_hard_negative_pool' ELSE 'round3_local_pool' END"
_GUARD_WEIGHT = "CAST(CASE WHEN label = 1 THEN 1.0 WHEN bucket IN ('poetry_classical', 'poetry_freeverse') THEN 2.0 WHEN bucket IN ('literary_old_prose', 'literary_short_fragment') THEN 1.7 WHEN bucket = 'academic_formal' THEN 1.4 WHEN tag = 'human_ornate_literary_mirror' THEN 1.5 ELSE 1.2 END AS DOUBLE)"
_SURFACED = BUCKET_SQL.replace(CORPUS_SQL, f"SELECT * REPLACE ({_STRIP.format('text')} AS text) FROM ({CORPUS_SQL})")
_GUARD_ROWS = f"SELECT *, {_GUARD_TAG} AS tag, CASE WHEN label = 0 THEN 'human' ELSE coalesce(nullif(gen, ''), nullif(source, ''), 'unknown_llm') END AS g FROM (SELECT b.*, c.generator AS gen, c.input_name AS nm, lower(coalesce(c.prompt_type, '')) AS pt FROM ({_SURFACED}) b JOIN ({CAND_SQL}) c ON b.id = c.id WHERE b.label IN (0, 1))"


@query("prj10_guard_rows", f"SELECT CAST(id AS VARCHAR) AS id, md5(text) AS h, bucket, tag AS round3_tag, {_GUARD_STAGE} AS round3_source_stage, {_GUARD_WEIGHT} AS sample_weight, g AS generator, {_OR('source', 'g')} AS source, {_OR('pair_id')} AS pair_id, CAST(id AS VARCHAR) AS source_id, {', '.join(f'round({c}, 6) AS {c}' for c in X.SURFACE)} FROM ({_GUARD_ROWS})")
def guard_rows(spark, sf):
    """Candidates of the precision guard with tag, weight and the fifteen surface features."""
    own = K.guard_candidates(cand(spark, sf).where("label in (0, 1)").withColumn("source_id", F.lit(None).cast("string")), ["id"])
    return own.select("id", F.md5(F.col("text").cast("binary")).alias("h"), "bucket", "round3_tag", "round3_source_stage", "sample_weight", "generator", "source", "pair_id", "source_id", *(F.round(c, 6).alias(c) for c in X.SURFACE))


@query("msc30_original_labels", f"SELECT id, coalesce(CASE WHEN TRY_CAST(o AS INT) IN (0, 1) THEN TRY_CAST(o AS INT) END, CASE WHEN label IN (0, 1) THEN label END) AS original FROM (SELECT id, label, CASE id % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'x' END AS o FROM ({CORPUS_SQL}))")
def original_labels(spark, sf):
    k = F.col("id") % 4
    own = corpus(spark, sf).withColumn("o", F.when(k == 0, "1").when(k == 1, "2").when(k == 2, "x"))
    return own.select("id", K.original_label("o", "label").alias("original"))


_OLD = "CASE WHEN label = 1 AND (contains(sig, 'old_fiction') OR contains(sig, 'old_prose')) THEN 'literary_old_prose' ELSE bucket END"
_SIG = "lower(concat_ws(' ', input_name, coalesce(round4_tag, ''), coalesce(prompt_type, ''), domain))"
_TAG = "CASE WHEN label = 0 THEN CASE WHEN b4 = 'poetry_classical' THEN 'human_poetry_classical_mirror' WHEN b4 = 'poetry_freeverse' THEN 'human_poetry_freeverse_mirror' WHEN b4 = 'literary_old_prose' THEN 'human_literary_old_prose_mirror' WHEN b4 = 'academic_formal' OR domain = 'academic' THEN 'human_formal_academic_mirror' WHEN b4 = 'literary_short_fragment' THEN 'human_short_fragment_mirror' ELSE 'human_polished_general_mirror' END ELSE CASE WHEN b4 = 'poetry_classical' OR contains(pt, 'archaic') THEN 'llm_archaic_poetry_hardpos' WHEN b4 = 'poetry_freeverse' THEN 'llm_freeverse_poetry_hardpos' WHEN b4 = 'academic_formal' THEN 'llm_natural_academic_hardpos' WHEN b4 = 'literary_old_prose' OR contains(pt, 'old') THEN 'llm_old_prose_hardpos' WHEN b4 = 'literary_short_fragment' THEN 'llm_short_fragment_hardpos' ELSE 'llm_polished_general_hardpos' END END"
_STAGE = "CASE WHEN starts_with(nm, 'round3_') THEN 'round3_reused_pool' WHEN contains(nm, 'round2_') THEN 'round2_reused_pool' WHEN contains(nm, 'hard_positive') OR contains(nm, 'hardpos') THEN 'hard_positive_pool' WHEN contains(nm, 'poetry') THEN 'poetry_pool' WHEN contains(nm, 'academic') THEN 'academic_pool' WHEN contains(nm, 'hard_negative') THEN 'hard_negative_pool' ELSE 'generic_rewrite_pool' END"
_RESIDUAL = f"SELECT *, {_TAG} AS tag FROM (SELECT *, {_OLD} AS b4 FROM (SELECT *, {_SIG} AS sig, lower(coalesce(prompt_type, '')) AS pt, lower(input_name) AS nm, row_number() OVER (ORDER BY id) AS n, regexp_replace(regexp_replace(lower(regexp_replace(input_name, '\\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS stem FROM ({CAND_SQL}) WHERE label IN (0, 1)))"


@query("prj11_fea20_24_residual_candidates", f"SELECT 'round4_' || stem || '_' || label || '_' || printf('%06d', n) AS id, 'round4_' || stem || '_' || pair_id AS pair_id, CAST(id AS VARCHAR) AS original_id, CAST(pair_id AS VARCHAR) AS source_pair_id, b4 AS round4_bucket, tag AS round4_tag, {_STAGE} AS round4_source_stage, CASE WHEN label = 1 THEN 1.0::DOUBLE WHEN b4 IN ('poetry_classical', 'poetry_freeverse', 'literary_old_prose') THEN 2.0 WHEN b4 = 'literary_short_fragment' THEN 1.7 WHEN b4 = 'academic_formal' THEN 1.4 WHEN tag = 'human_polished_general_mirror' THEN 1.5 ELSE 1.2 END AS sample_weight FROM ({_RESIDUAL})")
def residual_candidates(spark, sf):
    own = K.residual_candidates(cand(spark, sf).where("label in (0, 1)"), ["id"])
    return own.select("id", "pair_id", "original_id", "source_pair_id", "round4_bucket", "round4_tag", "round4_source_stage", "sample_weight")


@query("prj12_overlaid_overrides", f"SELECT a.id, e.id IS NOT NULL AS is_exact, coalesce(e.bucket, a.bucket) AS bucket, coalesce(e.step7_pred, a.step7_pred, CAST(0 AS INT)) AS step7_pred, coalesce(nullif(coalesce(e.round4_pred, a.round4_pred), 0), CAST(1 AS INT)) AS round4_pred FROM ({CAND_SQL}) a LEFT JOIN (SELECT id, 'exact' AS bucket, step7_pred, round4_pred FROM ({CAND_SQL}) WHERE id % 3 = 0) e ON a.id = e.id")
def overlaid(spark, sf):
    own = cand(spark, sf)
    return K.overlaid(own, own.where("id % 3 = 0").withColumn("bucket", F.lit("exact")), "id", ["bucket", "step7_pred", "round4_pred"]).select("id", "is_exact", "bucket", "step7_pred", "round4_pred")


@query("prj13_msc07_exact_rows", f"SELECT id, CAST(flip_type = 'fixed_fn_candidate' AS INT) AS label, coalesce(label, CAST(-1 AS INT)) AS original_detection_label, CASE flip_type WHEN 'fixed_fn_candidate' THEN 'safe_override' ELSE 'unsafe_override' END AS override_safety, {_OR('split', d='unknown')} AS origin_split, {_OR('pair_id', 'source_pair_id')} AS group_key, {_KEY.format('text')} AS text_key, {_OR('bucket', d='unknown')} AS round4_bucket FROM ({CAND_SQL}) WHERE {_EXACT}")
def exact_rows(spark, sf):
    own = cand(spark, sf).withColumn("original_id", F.lit(None).cast("string"))
    return K.exact_rows(own).select("id", "label", "original_detection_label", "override_safety", "origin_split", "group_key", "text_key", "round4_bucket")


@query("prj15_mixed_rows", f"SELECT CAST(id AS VARCHAR) AS id, 'step7_base_train' AS mix_source, 'base_anchor' AS mix_role, coalesce(CASE WHEN id % 5 = 0 THEN 2.0::DOUBLE END, 1.0) AS sample_weight FROM ({CAND_SQL}) WHERE label = 0 UNION ALL SELECT 'round8_residual_' || printf('%06d', row_number() OVER (ORDER BY id)) || '_' || id, 'residual_train_v1', 'residual_hard_or_support', coalesce(CASE WHEN id % 5 = 0 THEN 2.0::DOUBLE END, 1.0) FROM ({CAND_SQL}) WHERE label = 1")
def mixed(spark, sf):
    own = cand(spark, sf).select("id", "label", F.when(F.col("id") % 5 == 0, 2.0).alias("sample_weight"))
    return K.mixed_rows(own.where("label = 0"), own.where("label = 1"), ["id"]).select("id", "mix_source", "mix_role", "sample_weight")


_RAW = f"SELECT CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 1 THEN '' ELSE 'x' || id END AS id, label, prediction, prob_llm, score, row_number() OVER (ORDER BY id) - 1 AS pos FROM ({CAND_SQL})"
_RAWP = "coalesce(TRY_CAST(coalesce(prob_llm, score) AS DOUBLE), 0.0)"
_RAWPRED = "CASE WHEN TRY_CAST(prediction AS INT) IN (0, 1) THEN TRY_CAST(prediction AS INT) END"


def raw_predictions(spark, sf):
    own = cand(spark, sf).select(F.col("id").alias("at"), F.when(F.col("id") % 6 == 0, None).when(F.col("id") % 6 == 1, "").otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("id"), F.col("label").cast("string").alias("label"), "prediction", "prob_llm", "score")
    return own


@query("prj16_strict_predictions", f"SELECT coalesce(nullif(id, ''), CAST(pos AS VARCHAR)) AS id, label, {_RAWPRED} AS prediction, {_RAWP} AS probability FROM ({_RAW}) WHERE label IN (0, 1) AND {_RAWPRED} IS NOT NULL")
def strict_predictions(spark, sf):
    return K.prediction_rows(raw_predictions(spark, sf), ["at"], strict=True)


@query("prj17_msc27_predictions", f"SELECT coalesce(nullif(id, ''), CAST(pos AS VARCHAR)) AS id, label, coalesce({_RAWPRED}, CAST({_RAWP} >= 0.5 AS INT)) AS prediction, {_RAWP} AS probability FROM ({_RAW}) WHERE label IN (0, 1)")
def lenient_predictions(spark, sf):
    return K.prediction_rows(raw_predictions(spark, sf), ["at"])


@query("prj18_fused_predictions", f"SELECT id, round(CASE WHEN id % 3 <> 0 THEN 0.33 * p_neural + 0.67 * p_tfidf ELSE coalesce(TRY_CAST(coalesce(prob_llm, score) AS DOUBLE), 0.0) END, 9) AS p, coalesce(nullif(bucket, ''), domain) AS bucket FROM ({CAND_SQL}) WHERE label IS NOT NULL")
def fused_predictions(spark, sf):
    own = cand(spark, sf).where("label is not null").withColumns({"p_neural": F.when(F.col("id") % 3 != 0, F.col("p_neural")), "probability": F.coalesce("prob_llm", "score")})
    return own.select("id", F.round(K.fused_probability(0.33), 9).alias("p"), N.present("bucket", "domain").alias("bucket"))


@query("prj19_inputs", f"SELECT coalesce(nullif(id, ''), CAST(pos AS VARCHAR)) AS id, text FROM (SELECT CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 1 THEN '' ELSE 'x' || id END AS id, CASE WHEN id % 4 = 0 THEN ' ' ELSE text END AS text, row_number() OVER (ORDER BY id) - 1 AS pos FROM ({CORPUS_SQL})) WHERE NOT {_BLANK}")
def inputs(spark, sf):
    from textloom.operators.order import positions

    own = positions(corpus(spark, sf), ["id"]).withColumn("at", (F.col("position") - 1).cast("string"))
    own = own.select(N.present(F.when(F.col("id") % 6 < 2, None).otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))), "at").alias("id"), F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("text")).alias("text"))
    return own.where(~Q.blank("text"))


@query("prj21_msc24_first_present", f"SELECT id, coalesce(a, b, c) AS v, coalesce(nullif(a, ''), nullif(b, ''), 'general') AS bucket FROM (SELECT id, bucket AS a, prompt_type AS b, flip_type AS c FROM ({CAND_SQL}))")
def first_present(spark, sf):
    return cand(spark, sf).select("id", F.coalesce("bucket", "prompt_type", "flip_type").alias("v"), N.present("bucket", "prompt_type", default="general").alias("bucket"))


@query("prj22_23_msc06_resolvers", f"SELECT id, {_OR('md_paper', 'md_title', 'source_pair_id', 'pair_id')} AS document, {_OR('source_pair_id', 'pair_id')} AS split_group, {_OR('round4_source_stage', 'round3_source_stage', 'generation', d='unknown_non_teacher_source')} AS origin FROM ({CAND_SQL})")
def resolvers(spark, sf):
    own = cand(spark, sf).withColumns({"original_id": F.lit(None).cast("string"), "source_doc_id": F.lit(None).cast("string")})
    return own.select("id", K.source_document().alias("document"), K.split_group().alias("split_group"), K.origin("round4_source_stage", "round3_source_stage", "generation").alias("origin"))


@query("prj24_split_literal", f"SELECT 'train' AS split, count(*) AS n FROM ({CORPUS_SQL}) WHERE label = 0 UNION ALL SELECT 'dev', count(*) FROM ({CORPUS_SQL}) WHERE label = 1")
def split_literal(spark, sf):
    own = corpus(spark, sf)
    parts = {"train": own.where("label = 0"), "dev": own.where("label = 1")}
    both = parts["train"].withColumn("split", F.lit("train")).unionByName(parts["dev"].withColumn("split", F.lit("dev")))
    return both.groupBy("split").agg(F.count("*").alias("n"))


@query("prj27_srt08_tiers", f"""SELECT id, tier AS selection_tier, round(h, 9) AS hardness_score, r <= 1 AS core, r AS priority FROM (SELECT *, CAST(CASE WHEN starts_with(tier, 'very') THEN 0 WHEN starts_with(tier, 'hard') THEN 1 WHEN starts_with(tier, 'amb') THEN 2 ELSE 3 END AS INT) AS r FROM (
 SELECT id, CASE WHEN label = 0 THEN p_step7 ELSE 1 - p_step7 END AS h, CASE WHEN label = 0 THEN CASE WHEN p_step7 >= 0.65 THEN 'very_hard_human_fp' WHEN p_step7 >= 0.55 THEN 'hard_human_fp' WHEN p_step7 BETWEEN 0.35 AND 0.65 THEN 'ambiguous_human_support' ELSE 'human_support' END ELSE CASE WHEN p_step7 <= 0.35 THEN 'very_hard_llm_fn' WHEN p_step7 <= 0.45 THEN 'hard_llm_fn' WHEN p_step7 BETWEEN 0.35 AND 0.65 THEN 'ambiguous_llm_support' ELSE 'llm_support' END END AS tier FROM ({PREDS_SQL})))""")
def tiers(spark, sf):
    return K.tiered(preds(spark, sf)).select("id", "selection_tier", F.round("hardness_score", 9).alias("hardness_score"), "core", "priority")


@query("prj31_guard_rows", f"SELECT id, CAST(flip_type = 'induced_fp' AS INT) AS label, label AS original_detection_label FROM ({CAND_SQL}) WHERE split IN ('train', 'dev') AND flip_type IN ('fixed_fn_candidate', 'induced_fp')")
def guard_rows(spark, sf):
    return K.guard_rows(cand(spark, sf), ("train", "dev")).select("id", "label", "original_detection_label")


_BIN = lambda c: f"CASE WHEN TRY_CAST({c} AS INT) IN (0, 1) THEN TRY_CAST({c} AS INT) END"


@query("prj32_targets", f"SELECT id, coalesce({_BIN('flip_label')}, {_BIN('target')}, CASE override_safety WHEN 'unsafe_override' THEN 1 WHEN 'safe_override' THEN 0 END, CASE WHEN origin_split IS NOT NULL THEN label END) AS guard FROM ({CAND_SQL})")
def targets(spark, sf):
    return cand(spark, sf).select("id", K.guard_target("flip_label", "target", "override_safety", "origin_split", "label").alias("guard"))


@query("prj32_selector_targets", f"SELECT id, coalesce({_BIN('flip_label')}, {_BIN('target')}, CAST(label AS INT)) AS safe FROM ({CAND_SQL}) WHERE label IS NOT NULL")
def selector_targets(spark, sf):
    return cand(spark, sf).where("label is not null").select("id", K.selector_target("flip_label", "target", "label", "override_safety").alias("safe"))


@query("prj33_style_guard_rows", f"SELECT id, CAST(1 - label AS INT) AS guard_label FROM ({CAND_SQL}) WHERE label IN (0, 1) AND NOT {_BLANK} AND coalesce(round4_source_stage, '') <> 'step7_base_train'")
def style_guard(spark, sf):
    return K.style_guard_rows(cand(spark, sf)).select("id", "guard_label")


@query("msc23_srt09_fea33_resolved", f"SELECT id, CASE flip_type WHEN 'fixed_fn_candidate' THEN 'safe_override' WHEN 'induced_fp' THEN 'unsafe_override' ELSE {_OR('override_safety', d='unknown')} END AS safety, CASE WHEN starts_with(lower(input_name), 'round3_') THEN 0 WHEN starts_with(lower(input_name), 'round2_') THEN 1 WHEN contains(lower(input_name), 'hard_positive') OR contains(lower(input_name), 'hardpos') THEN 2 WHEN contains(lower(input_name), 'poetry') OR contains(lower(input_name), 'academic') THEN 3 ELSE 4 END AS priority FROM ({CAND_SQL})")
def resolved(spark, sf):
    return cand(spark, sf).select("id", K.safety().alias("safety"), K.source_priority("input_name").alias("priority"))


@query("fea18_text_signal", f"SELECT id, lower(concat_ws(' ', CAST(id AS VARCHAR), domain, source, coalesce(generator, ''), coalesce(prompt_type, ''), coalesce(bucket, ''), coalesce(md_title, ''))) AS signal FROM ({CAND_SQL})")
def text_signal(spark, sf):
    from textloom.functions.taxonomy import text_signal as signal

    own = cand(spark, sf).withColumn("sid", F.col("id").cast("string"))
    return own.select("id", signal("sid", "domain", "source", "generator", "prompt_type", "bucket", "md_title").alias("signal"))


# joins


@query("jn05_three_runs", f"SELECT a.id, a.label, round(a.p, 9) AS p_step7, round(b.p, 9) AS p_round4, round(c.p, 9) AS p_guard FROM ({run_sql('step7')}) a JOIN ({run_sql('round4')}) b USING (id) JOIN ({run_sql('guard')}) c USING (id)")
def three_runs(spark, sf):
    own = A.many({r: run_of(spark, sf, r) for r in ("step7", "round4", "guard")})
    return own.select("id", "label", *(F.round(f"p_{r}", 9).alias(f"p_{r}") for r in ("step7", "round4", "guard")))


@query("jn03_06_split_runs", " UNION ALL ".join(f"SELECT '{s}' AS split, count(*) AS n, round(avg(a.p + b.p + c.p + d.p), 9) AS mean FROM ({run_sql('step7')}) a JOIN ({run_sql('round4')}) b USING (id) JOIN ({run_sql('guard')}) c USING (id) JOIN ({run_sql('neural')}) d USING (id) WHERE a.id % 2 = {k}" for k, s in enumerate(("dev", "test"))))
def split_runs(spark, sf):
    names = ("step7", "round4", "guard", "neural")
    parts = [A.many({r: run_of(spark, sf, r).where(f"id % 2 = {k}") for r in names}).withColumn("split", F.lit(s)) for k, s in enumerate(("dev", "test"))]
    both = parts[0].unionByName(parts[1]).where("label in (0, 1)")
    return both.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(F.col("p_step7") + F.col("p_round4") + F.col("p_guard") + F.col("p_neural")), 9).alias("mean"))


@query("jn08_required_branches", f"SELECT a.id, round(a.p_round4, 9) AS p_residual, round(a.p_neural, 9) AS p_style FROM ({PREDS_SQL}) a")
def required(spark, sf):
    own = preds(spark, sf)
    out = own.select("id")
    for r, into in (("round4", "p_residual"), ("neural", "p_style")):
        out = A.with_branch(out, own.select("id", F.col(f"p_{r}").alias("p")), into, None)
    return out.select("id", F.round("p_residual", 9).alias("p_residual"), F.round("p_style", 9).alias("p_style"))


_POS = f"SELECT *, CAST(row_number() OVER (ORDER BY id) - 1 AS VARCHAR) AS pos FROM ({CORPUS_SQL})"


@query("jn09_10_by_position_or_id", f"SELECT p.id, coalesce(i.source, q.source) AS source, coalesce(p.domain, i.domain, q.domain) AS domain FROM (SELECT CAST(id + (id % 3) * 3 AS VARCHAR) AS id, CASE WHEN id % 2 = 0 THEN 'own' END AS domain FROM ({CORPUS_SQL}) WHERE id % 5 < 2) p LEFT JOIN (SELECT CAST(id AS VARCHAR) AS k, source, domain FROM ({_POS}) WHERE id % 4 <> 0) i ON p.id = i.k LEFT JOIN ({_POS}) q ON p.id = q.pos")
def by_position(spark, sf):
    from textloom.operators.candidates import by_position_or_id

    raw = corpus(spark, sf).select(F.col("id").alias("o"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("id"), "source", "domain")
    p = corpus(spark, sf).where("id % 5 < 2").select((F.col("id") + F.col("id") % 3 * 3).cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "own").alias("domain"))
    return by_position_or_id(p, raw, ["o"], ["source", "domain"])


@query("jn12_composite_overlay", f"SELECT p.split, p.id, coalesce(p.bucket, l.bucket) AS bucket, l.flip_type FROM (SELECT coalesce(split, 'unknown') AS split, id, CASE WHEN id % 2 = 0 THEN 'scored' END AS bucket FROM ({CAND_SQL})) p LEFT JOIN (SELECT coalesce(split, 'unknown') AS split, id, bucket, flip_type FROM ({CAND_SQL}) WHERE id % 3 > 0) l ON p.split = l.split AND p.id = l.id")
def overlay(spark, sf):
    own = cand(spark, sf).withColumn("split", F.coalesce("split", F.lit("unknown")))
    right = own.where("id % 3 > 0").select("split", "id", F.col("bucket").alias("b"), "flip_type")
    return own.select("split", "id", F.when(F.col("id") % 2 == 0, "scored").alias("a")).join(right, ["split", "id"], "left").select("split", "id", F.coalesce("a", "b").alias("bucket"), "flip_type")


@query("jn13_msc31_mined", f"SELECT a.id, coalesce(CASE WHEN c.label IN (0, 1) THEN c.label END) AS original_detection_label, round(b.p - a.p, 9) AS prob_delta FROM ({run_sql('step7')}) a JOIN ({run_sql('round4')}) b USING (id) JOIN ({CAND_SQL}) c USING (id) WHERE a.pred = 0 AND b.pred = 1 AND coalesce(c.origin_split, '') = 'train' AND coalesce(c.round4_source_stage, '') <> 'poetry_pool'")
def mined(spark, sf):
    both = A.many({r: run_of(spark, sf, r) for r in ("step7", "round4")}).where("pred_step7 = 0 and pred_round4 = 1").drop("label")
    source = cand(spark, sf).where(K.allowed(N.present("origin_split", default=""), ("train",)) & K.allowed(N.present("round4_source_stage", default=""), (), ("poetry_pool",)))
    own = both.join(source.select("id", K.binary("label").alias("original_detection_label")), "id")
    return own.select("id", "original_detection_label", F.round(F.col("p_round4") - F.col("p_step7"), 9).alias("prob_delta"))


@query("jn14_prompt_lookup", f"SELECT 'found' AS kind, count(*) AS n FROM ({REWRITES_SQL}) t WHERE length(rewrite_text) % 3 = 0 AND length(source_text) % 2 = 0 UNION ALL SELECT 'missing', count(*) FROM ({REWRITES_SQL}) WHERE length(rewrite_text) % 3 = 0 AND length(source_text) % 2 = 1")
def prompt_lookup(spark, sf):
    own = rewrites(spark, sf)
    ids, prompts = own.where("length(rewrite_text) % 3 = 0").select("task_id"), own.where("length(source_text) % 2 = 0").select("task_id", "source_text")
    found, missing = ids.join(prompts, "task_id"), ids.join(prompts, "task_id", "left_anti")
    return found.agg(F.lit("found").alias("kind"), F.count("*").alias("n")).unionAll(missing.agg(F.lit("missing").alias("kind"), F.count("*").alias("n")))


@query("jn18_msc09_pool", f"SELECT min(id) AS id, k AS text_key FROM (SELECT id, {_KEY.format('text')} AS k FROM ({CORPUS_SQL})) WHERE k <> '' AND k NOT IN (SELECT {_KEY.format('text')} FROM ({CORPUS_SQL}) WHERE id % 7 = 0 AND text IS NOT NULL) GROUP BY k")
def pool(spark, sf):
    own = corpus(spark, sf)
    return K.pool(own, own.where("id % 7 = 0"), ["id"]).select("id", "text_key")


@query("jn20_unfinished", f"SELECT task_id FROM ({REWRITES_SQL}) WHERE length(rewrite_text) % 2 = 1")
def unfinished(spark, sf):
    own = rewrites(spark, sf)
    return own.join(own.where("length(rewrite_text) % 2 = 0").select("task_id"), "task_id", "left_anti").select("task_id")


_FOUR = ("step7", "tfidf", "neural", "round4")


@query("jn24_four_run_ensemble", f"SELECT a.id, round((a.p + b.p + c.p + d.p) / 4, 9) AS p FROM ({run_sql('step7')}) a JOIN ({run_sql('tfidf')}) b USING (id) JOIN ({run_sql('neural')}) c USING (id) JOIN ({run_sql('round4')}) d USING (id)")
def four(spark, sf):
    return A.ensembles(A.many({r: run_of(spark, sf, r) for r in _FOUR}), list(_FOUR), (4,)).select("id", F.round("p", 9).alias("p"))
