"""Queries of the text functions."""

from pyspark.sql import functions as F

from textloom.functions import lexicon as L
from textloom.functions import repair as E
from textloom.functions import text as T
from textloom.plans.registry import query
from textloom.plans.views import CORPUS_SQL, REWRITES_SQL, corpus, rewrites, table

_WS = r"[\s]+"
_KEY = rf"trim(regexp_replace(lower(text), '{_WS}', ' ', 'g'))"


def _sql_replace(expr: str, pairs) -> str:
    for a, b in pairs:
        q = lambda s: "'" + s.replace("'", "''") + "'"
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    return expr


_NORMAL = _sql_replace("regexp_replace(text, '\\r\\n?', chr(10), 'g')", [(c, "") for c in L.INVISIBLE])
_NORMAL = _sql_replace(_NORMAL, L.MOJIBAKE)
_NORMAL = _sql_replace(f"nfc_normalize({_NORMAL})", [*L.QUOTES.items(), *((c, "-") for c in L.DASHES), *((c, " ") for c in L.SPACES)])
_NORMAL = rf"regexp_replace(regexp_replace(regexp_replace({_NORMAL}, '[ \t\f\x0B]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("txt01_normalize", f"SELECT id, md5({_STRIP.format(_NORMAL)}) AS h, length({_STRIP.format(_NORMAL)}) AS n FROM ({CORPUS_SQL})")
def normalize(spark, sf):
    t = T.normalize_text("text")
    return corpus(spark, sf).withColumn("n_", t).select("id", F.md5(F.col("n_").cast("binary")).alias("h"), F.length("n_").cast("long").alias("n"))


@query("txt04_changed_texts", f"SELECT domain, count(*) AS n, CAST(sum(CASE WHEN {_STRIP.format(_NORMAL)} <> text THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM ({CORPUS_SQL}) GROUP BY domain")
def changed(spark, sf):
    own = corpus(spark, sf).withColumn("new_", T.normalize_text("text"))
    return own.groupBy("domain").agg(F.count("*").alias("n"), F.sum((F.col("new_") != F.col("text")).cast("long")).alias("changed"))


@query("txt06_clean_book", rf"SELECT id, md5(regexp_replace(regexp_replace(replace(text, chr(65279), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM ({CORPUS_SQL})")
def clean_book(spark, sf):
    return corpus(spark, sf).select("id", F.md5(T.clean_book("text").cast("binary")).alias("h"))


_PARAGRAPHS = rf"SELECT id, unnest(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(regexp_replace(p, '{_WS}', ' ', 'g'))), lambda p: p <> '')) AS paragraph FROM ({CORPUS_SQL})"


@query("txt07_paragraphs", f"SELECT id, paragraph FROM ({_PARAGRAPHS})")
def paragraphs(spark, sf):
    return corpus(spark, sf).select("id", F.explode(T.paragraphs("text")).alias("paragraph"))


@query("txt12_text_key", f"SELECT id, md5({_KEY}) AS key FROM ({CORPUS_SQL})")
def text_key(spark, sf):
    return corpus(spark, sf).select("id", F.md5(T.text_key("text").cast("binary")).alias("key"))


@query("txt14_clean_output", f"""SELECT task_id, {_STRIP.format(r"regexp_replace(regexp_replace(rewrite_text, '^\s*```[A-Za-z]*\s*', ''), '\s*```\s*$', '')")} AS cleaned FROM ({REWRITES_SQL})""")
def clean_output(spark, sf):
    return rewrites(spark, sf).select("task_id", T.clean_output("rewrite_text").alias("cleaned"))


@query("txt15_word_counts", rf"SELECT id, CAST(len(list_filter(string_split_regex(text, '{_WS}'), lambda w: w <> '')) AS BIGINT) AS spaced, CAST(len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS BIGINT) AS alphabetic FROM ({CORPUS_SQL})")
def word_counts(spark, sf):
    return corpus(spark, sf).select("id", T.space_words("text").cast("long").alias("spaced"), T.word_count("text").cast("long").alias("alphabetic"))


@query("txt17_vocabulary", rf"SELECT word, count(*) AS n, count(DISTINCT id) AS documents FROM (SELECT id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?'))) AS word FROM ({CORPUS_SQL})) GROUP BY word")
def vocabulary(spark, sf):
    # one row for each word and document before the wide aggregation
    each = corpus(spark, sf).select("id", F.explode(T.words("text")).alias("w")).groupBy(F.lower("w").alias("word"), "id").agg(F.count("*").alias("k"))
    return each.groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("documents"))


@query("txt18_slug", r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slug("url").alias("slug"))


@query("txt20_preview", rf"SELECT id, CASE WHEN length(t) > 80 THEN rtrim(substring(t, 1, 77)) || '...' ELSE t END AS preview FROM (SELECT id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS t FROM ({CORPUS_SQL}))")
def preview(spark, sf):
    return corpus(spark, sf).select("id", T.preview("text", 80).alias("preview"))


_PROMPTS = ["Rewrite: {text}", "Paraphrase the passage. {text}", "{text}\nModernise it."]


@query("txt22_prompt_tasks", f"SELECT id, CAST(k AS INT) AS prompt_type, md5(CASE k WHEN 0 THEN 'Rewrite: ' || text WHEN 1 THEN 'Paraphrase the passage. ' || text ELSE text || chr(10) || 'Modernise it.' END) AS h FROM (SELECT id, text, (row_number() OVER (ORDER BY id) - 1) % 3 AS k FROM ({CORPUS_SQL}))")
def prompt_tasks(spark, sf):
    from textloom.operators.order import positions

    own = positions(corpus(spark, sf), ["id"]).withColumn("k", F.pmod(F.col("position") - 1, F.lit(3)))
    filled = F.when(F.col("k") == 0, T.fill_prompt(F.lit(_PROMPTS[0]), "text")).when(F.col("k") == 1, T.fill_prompt(F.lit(_PROMPTS[1]), "text")).otherwise(T.fill_prompt(F.lit(_PROMPTS[2]), "text"))
    return own.select("id", F.col("k").cast("int").alias("prompt_type"), F.md5(filled.cast("binary")).alias("h"))


@query("fea13_jaccard", rf"SELECT task_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM (SELECT task_id, list_distinct(regexp_extract_all(lower(source_text), '[A-Za-z'']+')) AS a, list_distinct(regexp_extract_all(lower(rewrite_text), '[A-Za-z'']+')) AS b FROM ({REWRITES_SQL}))")
def jaccard(spark, sf):
    return rewrites(spark, sf).select("task_id", F.round(T.jaccard("source_text", "rewrite_text"), 6).alias("jaccard"))


@query("txt03_repaired", f"SELECT id, md5(text) AS h FROM ({CORPUS_SQL})")
def repaired(spark, sf):
    """Texts read wrongly once, twice or not at all come back as they were."""
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    k = F.col("id") % 3
    own = corpus(spark, sf).select("id", F.when(k == 0, wrong(F.col("text"))).when(k == 1, wrong(wrong(F.col("text")))).otherwise(F.col("text")).alias("text"))
    return E.with_repaired(own).select("id", F.md5(F.col("text").cast("binary")).alias("h"))
