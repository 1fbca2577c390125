"""Queries of features and classifications."""

from pyspark.sql import functions as F

from textloom.functions import features as X
from textloom.functions import lexicon as L
from textloom.functions import taxonomy as C
from textloom.plans.registry import query
from textloom.plans.views import CORPUS_SQL, PREDS_SQL, corpus, preds

_W = "'[A-Za-z]+(?:''[A-Za-z]+)?'"
_IN = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
_PARTS = rf"""SELECT *, list_transform(words, lambda w: lower(w)) AS lowers, CASE WHEN len(ls) > 0 THEN ls ELSE [text] END AS lines,
  list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: len(regexp_extract_all(s, {_W}))::DOUBLE), lambda n: n > 0) AS sents
  FROM (SELECT *, regexp_extract_all(text, {_W}) AS words, list_filter(string_split_regex(text, '\r\n|[\n\r\x0B\x0C]'), lambda l: length(trim(l)) > 0) AS ls FROM ({CORPUS_SQL}))"""
_CNT = lambda p: f"CAST(len(regexp_extract_all(text, '{p}')) AS DOUBLE)"
SURFACE_SQL = rf"""SELECT id, label, domain, source, pair_id, text, words, lowers, sents, lines,
  CAST(length(text) AS DOUBLE) AS length_chars, CAST(len(words) AS DOUBLE) AS length_words, CAST(greatest(1, len(lines)) AS DOUBLE) AS num_lines,
  CASE WHEN length(text) = 0 THEN 0.0 ELSE {_CNT(chr(92) + 'n')} / length(text) END AS linebreak_ratio,
  coalesce(list_sum(list_transform(lines, lambda l: length(l)))::DOUBLE, 0) / greatest(1, len(lines)) AS avg_line_length,
  CASE WHEN length(text) = 0 THEN 0.0 ELSE {_CNT('[!-/:-@' + chr(92) + '[-`{-~]')} / length(text) END AS punctuation_ratio,
  {_CNT("[''" + '"`‘’“”]')} AS quote_count, {_CNT('[-–—]')} AS dash_count, {_CNT(';')} AS semicolon_count,
  CAST(len(list_filter(lowers, lambda w: w IN ({_IN(L.ARCHAIC)}))) AS DOUBLE) AS archaic_word_count,
  CAST(len(list_filter(lowers, lambda w: w IN ({_IN(L.ACADEMIC)}))) AS DOUBLE) AS academic_marker_count,
  CAST(len(list_filter(lowers, lambda w: w IN ({_IN(L.POETIC)}))) AS DOUBLE) AS poetic_marker_count,
  CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_distinct(lowers))::DOUBLE / len(words) END AS type_token_ratio,
  CASE WHEN len(sents) = 0 THEN 0.0 ELSE list_avg(sents) END AS sentence_length_mean,
  CASE WHEN len(sents) > 1 THEN list_aggregate(sents, 'stddev_pop') ELSE 0.0 END AS sentence_length_std
  FROM ({_PARTS})"""
BUCKET_SQL = rf"""SELECT *, CASE
  WHEN num_lines >= 4 AND avg_line_length <= 72 THEN CASE WHEN archaic_word_count >= 1 OR poetic_marker_count >= 2 THEN 'poetry_classical' ELSE 'poetry_freeverse' END
  WHEN length_words <= 55 AND (poetic_marker_count >= 2 OR archaic_word_count >= 1 OR (num_lines >= 2 AND avg_line_length <= 90)) THEN CASE WHEN archaic_word_count >= 1 OR contains(lower(text), 'sonnet') OR contains(lower(text), 'poesy') THEN 'poetry_classical' ELSE 'poetry_freeverse' END
  WHEN academic_marker_count >= 4 OR regexp_matches(text, '{L.CITATION}') THEN 'academic_formal'
  WHEN archaic_word_count >= 2 OR regexp_matches(lower(text), '{L.OLD_PROSE}') THEN 'literary_old_prose'
  WHEN length_words <= 55 THEN 'literary_short_fragment' ELSE 'general_prose' END AS bucket FROM ({SURFACE_SQL})"""


def surfaced(spark, sf):
    return X.with_surface(corpus(spark, sf))


@query("bucket_distribution", f"SELECT bucket, label, count(*) AS n, round(avg(length_words), 6) AS mean_words FROM ({BUCKET_SQL}) GROUP BY bucket, label")
def bucket_distribution(spark, sf):
    return surfaced(spark, sf).groupBy("bucket", "label").agg(F.count("*").alias("n"), F.round(F.avg("length_words"), 6).alias("mean_words"))


@query("fea01_surface_features", f"SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in X.SURFACE)} FROM ({SURFACE_SQL})")
def surface(spark, sf):
    return surfaced(spark, sf).select("id", *(F.round(c, 6).alias(c) for c in X.SURFACE))


@query("fea02_bucket", f"SELECT id, bucket FROM ({BUCKET_SQL})")
def bucket(spark, sf):
    return surfaced(spark, sf).select("id", "bucket")


_STYLE = {
    "colon_count": _CNT(":"), "comma_count": _CNT(","), "period_count": _CNT(chr(92) + "."), "question_count": _CNT(chr(92) + "?"), "exclamation_count": _CNT("!"), "parenthesis_count": _CNT("[()]"),
    "digit_ratio": _CNT("[0-9]") + " / greatest(1, length(text))", "uppercase_ratio": _CNT(chr(92) + "p{Lu}") + " / greatest(1, length(text))",
    "avg_word_length": "CASE WHEN len(words) = 0 THEN 0.0 ELSE list_avg(list_transform(words, lambda w: length(w)::DOUBLE)) END",
    "word_length_std": "CASE WHEN len(words) > 1 THEN list_aggregate(list_transform(words, lambda w: length(w)::DOUBLE), 'stddev_pop') ELSE 0.0 END",
    "stopword_ratio": f"CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_filter(lowers, lambda w: w IN ({_IN(L.FUNCTION_WORDS)})))::DOUBLE / len(words) END",
}
_STYLE["function_word_ratio"] = _STYLE["stopword_ratio"]


@query("fea04_style_features", f"SELECT id, {', '.join(f'round({_STYLE.get(c, c)}, 6) AS {c}' for c in X.STYLE)} FROM ({SURFACE_SQL})")
def style(spark, sf):
    own = surfaced(spark, sf).withColumns(X.style_features())
    return own.select("id", *(F.round(c, 6).alias(c) for c in X.STYLE))


_SHAPE = {
    "uppercase_char_ratio": _CNT(chr(92) + "p{Lu}") + " / greatest(1, " + _CNT(chr(92) + "p{L}") + ")", "digit_char_ratio": _STYLE["digit_ratio"], "space_char_ratio": _CNT(chr(92) + "s") + " / greatest(1, length(text))",
    "comma_count": _CNT(","), "colon_count": _CNT(":"), "paren_count": _CNT("[()]"),
    "long_word_ratio": "len(list_filter(words, lambda w: length(w) >= 9))::DOUBLE / greatest(1, len(words))", "avg_word_len": "coalesce(list_sum(list_transform(words, lambda w: length(w)))::DOUBLE, 0) / greatest(1, len(words))",
    "first_person_count": f"len(list_filter(lowers, lambda w: w IN ({_IN(L.FIRST_PERSON)})))::DOUBLE", "quote_count_raw": "quote_count",
}


@query("fea05_lexical_shape", f"SELECT id, {', '.join(f'round({v}, 6) AS {k}' for k, v in _SHAPE.items())} FROM ({SURFACE_SQL})")
def shape(spark, sf):
    own = X.with_parts(corpus(spark, sf)).select("id", *(F.round(v, 6).alias(k) for k, v in X.shape_features().items()))
    return own


_RUNS = ["step7", "tfidf", "neural"]
_P = [f"p_{r}" for r in _RUNS]
_ENT = lambda p: f"-(least(1 - 1e-9, greatest(1e-9, {p})) * ln(least(1 - 1e-9, greatest(1e-9, {p}))) + (1 - least(1 - 1e-9, greatest(1e-9, {p}))) * ln(1 - least(1 - 1e-9, greatest(1e-9, {p}))))"
_FUSION = {
    "abs_step7_tfidf": "abs(p_step7 - p_tfidf)", "abs_step7_neural": "abs(p_step7 - p_neural)", "abs_tfidf_neural": "abs(p_tfidf - p_neural)",
    "prob_mean": "(p_step7 + p_tfidf + p_neural) / 3", "prob_std": "list_aggregate([p_step7, p_tfidf, p_neural], 'stddev_pop')", "prob_min": "least(p_step7, p_tfidf, p_neural)", "prob_max": "greatest(p_step7, p_tfidf, p_neural)",
    "prob_range": "greatest(p_step7, p_tfidf, p_neural) - least(p_step7, p_tfidf, p_neural)", "prob_entropy": "(" + " + ".join(map(_ENT, _P)) + ") / 3",
}


@query("fea06_fusion_features", f"SELECT id, {', '.join(f'round({v}, 6) AS {k}' for k, v in _FUSION.items())} FROM ({PREDS_SQL})")
def fusion(spark, sf):
    return preds(spark, sf).select("id", *(F.round(v, 6).alias(k) for k, v in X.fusion_features(_RUNS).items()))


def _has(ws, c="text"):
    return "(" + " OR ".join(f"contains({c}, '" + w.replace("'", "''") + "')" for w in ws) + ")"


@query("fea16_hardness", rf"""SELECT id, CAST((CASE WHEN {_has(L.HARDNESS_TOKENS, 'lower(text)')} THEN 3 ELSE 0 END) + (CASE WHEN {_has([';', ':', '--', '—'])} THEN 2 ELSE 0 END) + (CASE WHEN {_has(['"', '“', '”', "'"])} THEN 2 ELSE 0 END) + (CASE WHEN {_has(['!', '?'])} THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(text, '(?:^|[^\p{{L}}\p{{N}}_])[A-Z][a-z]+(?:''s)?(?:$|[^\p{{L}}\p{{N}}_])') THEN 1 ELSE 0 END) AS INT) AS score FROM ({CORPUS_SQL})""")
def hardness(spark, sf):
    return corpus(spark, sf).select("id", X.hardness("text").alias("score"))


_LA = {k: f"len(list_filter(lowers, lambda w: w IN ({_IN(v)})))" for k, v in (("ar", L.LEDGER_ARCHAIC), ("ac", L.LEDGER_ACADEMIC), ("po", L.LEDGER_POETIC))}
_VERSE = lambda c: f"CASE WHEN {c} THEN 'poetry_classical' ELSE 'poetry_freeverse' END"


@query("fea26_rough_domain", rf"""SELECT id, CASE WHEN len(lines) >= 4 AND avg_line_length <= 55 THEN {_VERSE('ar >= 2')}
  WHEN n <= 150 AND (sp >= 2 OR ar >= 3 OR co >= 3 OR po >= 3) THEN {_VERSE("ar >= 2 OR co >= 3 OR " + _has(['poesy', 'muse', 'sonnet'], 'lower(text)'))}
  WHEN n <= 50 AND (po >= 1 OR (cm >= 2 AND se <= 1)) THEN {_VERSE('ar >= 1')}
  WHEN len(lines) >= 2 AND n <= 45 THEN 'poetry_or_fragment'
  WHEN ac >= 5 OR regexp_matches(text, '\([A-Z][A-Za-z]+,\s*\d{{4}}\)|\bet al\.\b|\bfigure\s+\d+|\btable\s+\d+') THEN 'academic_formal'
  WHEN ar >= 2 OR regexp_matches(lower(text), '\b(whilst|whereupon|thereof|hitherto|nay|alas)\b') THEN 'literary_old_prose'
  WHEN n <= 45 THEN 'literary_short_fragment' ELSE 'general_prose' END AS rough_domain
  FROM (SELECT *, {_LA['ar']} AS ar, {_LA['ac']} AS ac, {_LA['po']} AS po, len(words) AS n, len(regexp_extract_all(text, ' {{2,}}')) AS sp, len(regexp_extract_all(text, '[A-Za-z]+[’'']d\b')) AS co, len(regexp_extract_all(text, ',')) AS cm, len(regexp_extract_all(text, '[.!?]+')) AS se FROM ({SURFACE_SQL}))""")
def rough(spark, sf):
    return X.rough_domain(corpus(spark, sf)).select("id", "rough_domain")


_PB = "CASE WHEN {p} < 0.2 THEN 'lt_0.20' WHEN {p} < 0.35 THEN '0.20_0.35' WHEN {p} < 0.45 THEN '0.35_0.45' WHEN {p} < 0.55 THEN '0.45_0.55' WHEN {p} < 0.65 THEN '0.55_0.65' WHEN {p} < 0.8 THEN '0.65_0.80' ELSE 'ge_0.80' END"
_CONF = "CASE WHEN abs({p} - 0.55) <= 0.05 THEN 'boundary' WHEN abs({p} - 0.55) <= 0.15 THEN 'near_boundary' WHEN {p} >= 0.9 THEN 'very_high_llm' WHEN {p} <= 0.1 THEN 'very_high_human' WHEN {p} >= 0.55 THEN 'confident_llm' ELSE 'confident_human' END"
_TIER = "CASE WHEN label = 0 THEN CASE WHEN {p} >= 0.65 THEN 'very_hard_human_fp' WHEN {p} >= 0.55 THEN 'hard_human_fp' WHEN {p} BETWEEN 0.35 AND 0.65 THEN 'ambiguous_human_support' ELSE 'human_support' END ELSE CASE WHEN {p} <= 0.35 THEN 'very_hard_llm_fn' WHEN {p} <= 0.45 THEN 'hard_llm_fn' WHEN {p} BETWEEN 0.35 AND 0.65 THEN 'ambiguous_llm_support' ELSE 'llm_support' END END"


@query("fea27_31_32_probability_classes", f"SELECT id, {_CONF.format(p='p_step7')} AS confidence, {_PB.format(p='p_step7')} AS probability_bucket, {_TIER.format(p='p_step7')} AS tier, round(CASE WHEN label = 0 THEN p_step7 ELSE 1 - p_step7 END, 6) AS hardness FROM ({PREDS_SQL})")
def probability_classes(spark, sf):
    return preds(spark, sf).select("id", C.confidence_bucket("p_step7", 0.55).alias("confidence"), C.probability_bucket("p_step7").alias("probability_bucket"), C.selection_tier("label", "p_step7").alias("tier"), F.round(C.hardness_of("label", "p_step7"), 6).alias("hardness"))


FLIP_SQL = "CASE WHEN a = 0 AND b = 1 AND label = 1 THEN 'fixed_fn_candidate' WHEN a = 0 AND b = 1 AND label = 0 THEN 'induced_fp' WHEN a = 1 AND b = 0 AND label = 0 THEN 'round4_fixed_fp' WHEN a = 1 AND b = 0 AND label = 1 THEN 'round4_induced_fn' WHEN a = label AND b = a THEN 'stable_step7_correct' WHEN a <> label AND b = a THEN 'both_miss' ELSE 'other' END"


@query("fea30_flip_type", f"SELECT flip_type, domain, count(*) AS n FROM (SELECT domain, {FLIP_SQL} AS flip_type FROM (SELECT *, CAST(p_step7 >= 0.55 AS INT) AS a, CAST(p_round4 >= 0.5 AS INT) AS b FROM ({PREDS_SQL}))) GROUP BY ALL")
def flips(spark, sf):
    own = preds(spark, sf).withColumns({"a": (F.col("p_step7") >= 0.55).cast("int"), "b": (F.col("p_round4") >= 0.5).cast("int")})
    return own.groupBy(C.flip_type("label", "a", "b").alias("flip_type"), "domain").agg(F.count("*").alias("n"))


_HT = """CASE WHEN bucket = 'poetry_classical' THEN 'human_classical_poetry' WHEN bucket = 'poetry_freeverse' THEN 'human_free_verse'
 WHEN contains(signal, 'dialogue') OR len(regexp_extract_all(text, '["“”]')) >= 4 THEN CASE WHEN bucket = 'literary_old_prose' THEN 'human_old_fiction_dialogue' ELSE 'human_polished_literary_prose' END
 WHEN bucket = 'literary_old_prose' THEN 'human_archaic_prose' WHEN bucket = 'academic_formal' OR lower(domain) = 'academic' THEN 'human_formal_academic' WHEN bucket = 'literary_short_fragment' THEN 'human_literary_short_fragment'
 WHEN academic_marker_count >= 2 AND length_words >= 80 THEN 'human_structured_explanatory' ELSE 'human_polished_literary_prose' END"""
_LT = """CASE WHEN bucket = 'academic_formal' OR lower(domain) = 'academic' THEN 'llm_academic_term_preserving_paraphrase' WHEN bucket IN ('poetry_classical', 'poetry_freeverse') OR lower(domain) = 'poetry' THEN 'llm_archaic_poetry_rewrite'
 WHEN bucket = 'literary_old_prose' OR contains(signal, 'old_prose') THEN 'llm_old_fiction_style_rewrite' WHEN len(regexp_extract_all(text, '["“”]')) >= 4 THEN 'llm_style_preserving_dialogue_rewrite' WHEN lower(source) = 'chatgpt' THEN 'llm_conservative_chatgpt_paraphrase' ELSE 'llm_human_like_formal_paraphrase' END"""


@query("fea17_22_taxonomy_weight", f"SELECT id, CASE WHEN label = 0 THEN {_HT} ELSE {_LT} END AS taxonomy, CASE WHEN label = 1 THEN 1.0 WHEN bucket IN ('poetry_classical', 'poetry_freeverse') THEN 2.0 WHEN bucket IN ('literary_old_prose', 'literary_short_fragment') THEN 1.7 WHEN bucket = 'academic_formal' THEN 1.4 ELSE 1.2 END::DOUBLE AS weight FROM (SELECT *, lower(concat_ws(' ', domain, source)) AS signal FROM ({BUCKET_SQL}) WHERE label IS NOT NULL)")
def taxonomy(spark, sf):
    own = surfaced(spark, sf).where("label is not null")
    signal = C.text_signal("domain", "source")
    human = C.human_taxonomy("bucket", "domain", signal, "text", "academic_marker_count")
    llm = C.llm_taxonomy("bucket", "domain", signal, "text", F.lit(""), "source", F.lit(-1.0))
    return own.select("id", F.when(F.col("label") == 0, human).otherwise(llm).alias("taxonomy"), C.sample_weight("label", "bucket", F.lit("")).alias("weight"))
