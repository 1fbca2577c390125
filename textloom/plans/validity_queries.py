"""Queries of validity rules and rewrite quality."""

from pyspark.sql import functions as F

from textloom.functions import lexicon as L
from textloom.functions import quality as Q
from textloom.plans.feature_queries import BUCKET_SQL, _has, surfaced
from textloom.plans.registry import query
from textloom.plans.views import CORPUS_SQL, REWRITES_SQL, corpus, rewrites, table

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_END = ", ".join("'" + e.replace("'", "''") + "'" for e in L.VALID_ENDINGS)
TRUNCATED_SQL = lambda c: f"(length({_STRIP.format(c)}) = 0 OR right({_STRIP.format(c)}, 1) NOT IN ({_END}))"
_META = lambda c: "(" + " OR ".join(f"starts_with(lower({_STRIP.format(c)}), '{p}')" for p in L.META_PREFIXES) + ")"
_NW = lambda c: rf"len(list_filter(string_split_regex({c}, '\s+'), lambda w: w <> ''))"


def _listed(**checks: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items()) + "], lambda r: r IS NOT NULL)"


@query("flt01_human_validity", f"SELECT id, array_to_string({_listed(bad_label='label IS DISTINCT FROM 0', missing_pair_id='pair_id IS NULL', empty_text='length(' + _STRIP.format('text') + ') = 0')}, ',') AS reasons FROM ({CORPUS_SQL})")
def human_validity(spark, sf):
    return corpus(spark, sf).select("id", F.array_join(Q.human_reasons(), ",").alias("reasons"))


@query("flt02_llm_validity", f"SELECT id, array_to_string({_listed(bad_label='label IS DISTINCT FROM 1', empty_text='length(' + _STRIP.format('text') + ') = 0', quality_failed='toxic = 1', possibly_truncated_text=TRUNCATED_SQL('text'))}, ',') AS reasons FROM ({CORPUS_SQL})")
def llm_validity(spark, sf):
    return corpus(spark, sf).select("id", F.array_join(Q.llm_reasons(passed=F.col("toxic") != 1), ",").alias("reasons"))


@query("flt03_truncated", f"SELECT id, {TRUNCATED_SQL('text')} AS truncated FROM ({CORPUS_SQL})")
def truncated(spark, sf):
    return corpus(spark, sf).select("id", Q.looks_truncated("text").alias("truncated"))


@query("flt05_complete", f"SELECT id, coalesce(right({_STRIP.format('text')}, 1) IN ('.', '?', '!', ')', ']', '\"', ''''), false) AS complete FROM ({CORPUS_SQL})")
def complete(spark, sf):
    return corpus(spark, sf).select("id", Q.looks_complete("text").alias("complete"))


@query("flt06_paragraph_validity", f"SELECT id, {_NW('text')} BETWEEN 50 AND 400 AND NOT {_has(L.PARAGRAPH_BAD, 'lower(text)')} AS valid FROM ({CORPUS_SQL})")
def paragraph_validity(spark, sf):
    return corpus(spark, sf).select("id", Q.valid_paragraph("text").alias("valid"))


_LINES = r"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\x0C]'), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: length(l) > 0)"
_HEADING = "(len(ls) <= 3 AND (len(ws) = 0 OR (len(ws) <= 12 AND len(list_filter(ws, lambda w: w = upper(w) AND length(w) > 1))::DOUBLE / greatest(1, len(ws)) > 0.6)))"
_LINED = f"SELECT *, regexp_extract_all(array_to_string(ls, ' '), '[A-Za-z]+') AS ws FROM (SELECT *, {_LINES} AS ls FROM ({CORPUS_SQL}))"


@query("flt07_verse_validity", rf"""SELECT id, NOT {_has(L.POETRY_BAD, 'lower(text)')} AND {_NW('text')} BETWEEN 20 AND 400 AND len(ls) BETWEEN 2 AND 60 AND NOT {_HEADING}
 AND list_sum(list_transform(ls, lambda l: length(l)))::DOUBLE / greatest(1, len(ls)) <= 95 AND len(list_filter(ls, lambda l: regexp_matches(l, '[,.;:!?)\]}}"''”’—]$')))::DOUBLE / greatest(1, len(ls)) >= 0.35 AND len(regexp_extract_all(text, '\p{{L}}')) >= 0.55 * greatest(1, length(text)) AS valid FROM ({_LINED})""")
def verse_validity(spark, sf):
    return corpus(spark, sf).select("id", Q.valid_verse("text", lines_=(2, 60)).alias("valid"))


@query("flt08_heading_like", f"SELECT id, {_HEADING} AS heading FROM ({_LINED})")
def heading(spark, sf):
    return corpus(spark, sf).select("id", Q.heading_like("text").alias("heading"))


@query("flt09_academic_validity", rf"""SELECT id, NOT coalesce({_has(L.BAD_SECTIONS, 'lower(source)')}, false) AND {_NW('text')} BETWEEN 80 AND 320 AND NOT {_has(L.ACADEMIC_BAD, 'lower(text)')} AND len(regexp_extract_all(t, '[0-9]'))::DOUBLE / greatest(1, length(t)) <= 0.12 AND {_has(L.ACADEMIC_KEYWORDS, 'lower(text)')} AS valid FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM ({CORPUS_SQL}))""")
def academic_validity(spark, sf):
    return corpus(spark, sf).select("id", Q.valid_academic("text", "source").alias("valid"))


@query("flt11_structured_noise", rf"""SELECT id, {_has(L.NOISE_MARKERS, 'lower(text)')} OR len(regexp_extract_all(text, '[{{}}\[\]]')) >= 6 OR len(regexp_extract_all(text, '"[A-Za-z_][A-Za-z0-9_]*"\s*:')) >= 2 OR len(regexp_extract_all(text, '[{{}}\[\]<>|\\]'))::DOUBLE / greatest(1, length(text)) > 0.025 AS noise FROM ({CORPUS_SQL})""")
def noise(spark, sf):
    return corpus(spark, sf).select("id", Q.structured_noise("text").alias("noise"))


_LEAK = "(?i)" + "|".join(L.PROMPT_LEAKAGE).replace("'", "''")


@query("flt14_17_leakage_meta", f"SELECT conv_id, turn, regexp_matches(text, '{_LEAK}') AS leakage, {_META('text')} AS meta FROM conversations")
def leakage(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", Q.has_prompt_leakage("text").alias("leakage"), Q.starts_with_meta_text("text").alias("meta"))


_WORDS = _NW("text")
_FLAGS = {
    "empty_text": f"length({_STRIP.format('text')}) = 0", "too_short": f"{_WORDS} < 30 AND NOT ((starts_with(bucket, 'poetry') OR lower(domain) = 'poetry') AND {_WORDS} >= 12)", "too_long": f"{_WORDS} > 420",
    "prompt_leakage": f"label = 1 AND regexp_matches(text, '{_LEAK}')", "failed_basic_quality": "id % 3 = 1", "finish_reason_length": "id % 4 = 0",
}
_FLAGGED = f"SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 'Poetry' ELSE domain END AS domain) FROM ({BUCKET_SQL})"


@query("flt15_quality_flags", f"SELECT flag, CAST(coalesce(sum(CASE WHEN v THEN 1 ELSE 0 END), 0) AS BIGINT) AS n FROM ({' UNION ALL '.join(f"SELECT '{k}' AS flag, {v} AS v FROM ({_FLAGGED})" for k, v in _FLAGS.items())} UNION ALL SELECT 'keep', NOT ({' OR '.join(f'coalesce({v}, false)' for v in _FLAGS.values())}) FROM ({_FLAGGED})) GROUP BY flag")
def flags(spark, sf):
    i = F.col("id")
    own = surfaced(spark, sf).withColumn("domain", F.when(i % 5 == 0, "Poetry").otherwise(F.col("domain")))
    checks = Q.quality_flags(passed=F.when(i % 3 == 0, True).when(i % 3 == 1, False), finish=F.when(i % 4 == 0, "length").when(i % 4 == 1, "stop"))
    keep = {"keep": ~F.array_contains(F.array(*checks.values()), True)}
    sums = own.agg(*(F.coalesce(F.sum(v.cast("long")), F.lit(0)).cast("long").alias(k) for k, v in (checks | keep).items()))
    return sums.unpivot([], list(checks | keep), "flag", "n")


_QC = rf"""SELECT task_id, ns AS source_word_count, nr AS rewrite_word_count, round(ratio, 4) AS length_ratio, round(j, 4) AS lexical_jaccard, array_to_string(issues, ',') AS issues, len(issues) = 0 AS passed FROM (
 SELECT *, {_listed(empty_output='length(' + _STRIP.format('rewrite_text') + ') = 0', too_short_absolute='nr < 20', too_short_relative="ratio < CASE domain WHEN 'academic' THEN 0.5 ELSE 0.45 END", too_long_relative='ratio > 2.0', too_similar_to_source="j > CASE domain WHEN 'academic' THEN 0.92 ELSE 0.82 END", possibly_truncated="domain = 'academic' AND " + TRUNCATED_SQL('rewrite_text'), contains_meta_text=_META('rewrite_text'))} AS issues FROM (
 SELECT *, nr::DOUBLE / greatest(1, ns) AS ratio, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS j FROM (
 SELECT *, CAST({_NW('source_text')} AS INT) AS ns, CAST({_NW('rewrite_text')} AS INT) AS nr, list_distinct(regexp_extract_all(lower(source_text), '[A-Za-z'']+')) AS a, list_distinct(regexp_extract_all(lower(rewrite_text), '[A-Za-z'']+')) AS b FROM ({REWRITES_SQL}))))"""


def checked(spark, sf):
    return rewrites(spark, sf).withColumn("q", Q.rewrite_quality("source_text", "rewrite_text"))


@query("fea15_rewrite_quality", _QC)
def rewrite_quality(spark, sf):
    q = checked(spark, sf)
    return q.select("task_id", "q.source_word_count", "q.rewrite_word_count", "q.length_ratio", "q.lexical_jaccard", F.array_join("q.quality_issues", ",").alias("issues"), F.col("q.passed_basic_quality_check").alias("passed"))


@query("agg36_quality_inspection", f"SELECT issue, count(*) AS n, round(avg(length_ratio), 6) AS mean_ratio, min(length_ratio) AS min_ratio, max(length_ratio) AS max_ratio, round(median(lexical_jaccard), 6) AS median_jaccard FROM (SELECT *, unnest(CASE WHEN issues = '' THEN ['no_issue'] ELSE string_split(issues, ',') END) AS issue FROM ({_QC})) GROUP BY issue")
def inspection(spark, sf):
    q = checked(spark, sf).select("q.*")
    issue = F.explode(F.when(F.size("quality_issues") == 0, F.array(F.lit("no_issue"))).otherwise(F.col("quality_issues")))
    return q.withColumn("issue", issue).groupBy("issue").agg(F.count("*").alias("n"), F.round(F.avg("length_ratio"), 6).alias("mean_ratio"), F.min("length_ratio").alias("min_ratio"), F.max("length_ratio").alias("max_ratio"), F.round(F.median("lexical_jaccard"), 6).alias("median_jaccard"))


@query("agg40_filtered_reasons", f"SELECT 'human:' || source || ':' || reason AS reason, count(*) AS n FROM (SELECT source, unnest({_listed(bad_label='label IS DISTINCT FROM 0', empty_text='length(' + _STRIP.format('text') + ') = 0')}) AS reason FROM ({CORPUS_SQL})) GROUP BY ALL")
def filtered(spark, sf):
    own = corpus(spark, sf).select("source", F.explode(Q.human_reasons()).alias("r"))
    return own.groupBy(F.concat_ws(":", F.lit("human"), "source", "r").alias("reason")).agg(F.count("*").alias("n"))
