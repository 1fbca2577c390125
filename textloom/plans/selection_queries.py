"""Queries of deduplication, splits and selections."""

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dedup as D
from textloom.operators import splits as S
from textloom.plans.registry import SQL, query
from textloom.plans.views import CORPUS_SQL, REWRITES_SQL, corpus, rewrites, table

_KEY = r"md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"
_KEYED = f"SELECT id, label, toxic, domain, source, pair_id, {_KEY} AS key, length(text) AS n FROM ({CORPUS_SQL})"
_SHUF = lambda c="id", seed=42: f"md5(CAST({c} AS VARCHAR) || ':{seed}')"


def keyed(spark, sf):
    return corpus(spark, sf).select("id", "label", "toxic", "domain", "source", "pair_id", F.md5(T.text_key("text").cast("binary")).alias("key"), F.length("text").cast("long").alias("n"))


@query("win01_first_wins", f"SELECT min(id) AS id, key FROM ({_KEYED}) GROUP BY key")
def first_wins(spark, sf):
    return D.first_wins(keyed(spark, sf), ["key"], ["id"]).select("id", "key")


@query("win03_last_wins", f"SELECT max(id) AS id, key, count(*) - 1 AS replaced FROM ({_KEYED}) GROUP BY key")
def last_wins(spark, sf):
    own = keyed(spark, sf)
    return D.first_wins(own, ["key"], ["id"], last=True).join(own.groupBy("key").agg((F.count("*") - 1).alias("replaced")), "key").select("id", "key", "replaced")


@query("win02_greedy_dedup")
def greedy(spark, sf):
    """First-wins over id, pair and whole-text key at once; rows of one id go by text key."""
    own = corpus(spark, sf).select("id", "pair_id", F.md5(T.text_key("text").cast("binary")).alias("key")).distinct().withColumn("at", F.struct("id", "key"))
    return D.greedy(own, ["id", "pair_id", "key"], "at").select("id")


@query("win04_prefix_dedup", f"SELECT min(id) AS id FROM ({CORPUS_SQL}) GROUP BY substring(lower(text), 1, 300)")
def prefix_dedup(spark, sf):
    own = corpus(spark, sf).select("id", F.md5(T.prefix_key("text").cast("binary")).alias("k"))
    return D.first_wins(own, ["k"], ["id"]).select("id")


@query("win10_round_robin", f"SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) % 4 AS INT) AS slot FROM ({CORPUS_SQL})")
def round_robin(spark, sf):
    return S.round_robin(corpus(spark, sf).select("id"), ["id"], 4)


@query("win11_round_robin_by_source", f"SELECT id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY {_SHUF()}, id) - 1) % 4 AS INT) AS slot FROM ({CORPUS_SQL})")
def round_robin_by_source(spark, sf):
    own = corpus(spark, sf).select("id", "source").withColumn("s_", S.shuffled("id"))
    return S.round_robin(own, ["s_", "id"], 4, ["source"]).select("id", "source", "slot")


@query("win12_ratio_assignment", f"SELECT id, CASE WHEN k <= round_even(n * 0.4, 0) THEN 'a' WHEN k <= 2 * round_even(n * 0.4, 0) THEN 'b' WHEN k <= 2 * round_even(n * 0.4, 0) + round_even(n * 0.1, 0) THEN 'c' ELSE 'd' END AS assigned FROM (SELECT id, row_number() OVER (ORDER BY {_SHUF()}, id) AS k, CAST(count(*) OVER () AS DOUBLE) AS n FROM ({CORPUS_SQL}))")
def ratio_assignment(spark, sf):
    own = corpus(spark, sf).select("id").withColumn("s_", S.shuffled("id"))
    return S.by_ratio(own, ["s_", "id"], {"a": 0.4, "b": 0.4, "c": 0.1, "d": 0.1}).select("id", "assigned")


_SIG = f"SELECT pair_id, CASE WHEN max(CASE WHEN label = 0 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN label = 1 THEN 1 ELSE 0 END) = 1 THEN 'human_and_llm' WHEN max(CASE WHEN label = 0 THEN 1 ELSE 0 END) = 1 THEN 'human_only' WHEN max(CASE WHEN label = 1 THEN 1 ELSE 0 END) = 1 THEN 'llm_only' ELSE 'unlabelled' END AS signature, count(*) AS rows FROM ({CORPUS_SQL}) GROUP BY pair_id"


@query("win14_pair_signatures", f"SELECT signature, count(*) AS pairs, CAST(sum(rows) AS BIGINT) AS rows FROM ({_SIG}) GROUP BY signature")
def pair_signatures(spark, sf):
    return S.signatures(corpus(spark, sf)).groupBy("signature").agg(F.count("*").alias("pairs"), F.sum("rows").alias("rows"))


_SPLIT = f"SELECT c.id, c.label, c.domain, c.pair_id, c.text, s.signature, s.split FROM ({CORPUS_SQL}) c JOIN (SELECT pair_id, signature, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY {_SHUF('pair_id')}, pair_id) AS k, count(*) OVER (PARTITION BY signature) AS n FROM ({_SIG}))) s ON c.pair_id = s.pair_id"


@query("win13_pair_split", f"SELECT id, signature, split FROM ({_SPLIT})")
def pair_split(spark, sf):
    return S.pair_split(corpus(spark, sf).select("id", "label", "pair_id")).select("id", "signature", "split")


@query("win15_dev_split", f"SELECT id, CASE WHEN k <= greatest(1, round_even(n * 0.15, 0)) THEN 'dev' ELSE 'train' END AS split FROM ({CORPUS_SQL}) c JOIN (SELECT pair_id, row_number() OVER (ORDER BY {_SHUF('pair_id', 7)}, pair_id) AS k, CAST(count(*) OVER () AS DOUBLE) AS n FROM (SELECT DISTINCT pair_id FROM ({CORPUS_SQL}))) p ON c.pair_id = p.pair_id")
def dev_split(spark, sf):
    return S.dev_split(corpus(spark, sf).select("id", "pair_id"), "pair_id", 0.15, 7).select("id", "split")


@query("win17_balanced_dev", f"SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN b > 1 THEN 1 ELSE 0 END, s, id) AS l FROM (SELECT *, row_number() OVER (PARTITION BY label, domain ORDER BY s, id) AS b FROM (SELECT *, {_SHUF()} AS s FROM ({CORPUS_SQL}) WHERE label IS NOT NULL))) WHERE l <= (SELECT min(k) FROM (SELECT count(*) AS k FROM ({CORPUS_SQL}) WHERE label IS NOT NULL GROUP BY label))")
def balanced_dev(spark, sf):
    own = corpus(spark, sf).where("label is not null").select("id", "label", "domain").withColumn("s_", S.shuffled("id"))
    return S.balanced(own, "label", "domain", [F.col("s_"), F.col("id")]).select("id", "label")


_GROUPS = "SELECT pair_id, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)::BIGINT AS n0, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::BIGINT AS n1 FROM (" + CORPUS_SQL + ") WHERE label IS NOT NULL GROUP BY pair_id"
_WANT = {"probe": {"0": 5, "1": 40}, "dev": {"0": 5, "1": 40}, "train": {"0": 40, "1": 200}}


def _walk(state: str, start: str, step: str, out: str, order: str = "pair_id") -> str:
    """SQL: a walk over the groups in order; `step` gives the next state from s and g."""
    return f"WITH RECURSIVE g AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM ({_GROUPS})), s(rn, pair_id, pick, {state}) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, {start} UNION ALL {step}) SELECT {out} FROM s WHERE rn > 0"


_GAIN = lambda x: f"least(g.n0, greatest(0, s.{x}0)) + least(g.n1, greatest(0, s.{x}1))"
_BEST = f"CASE WHEN {_GAIN('p')} >= {_GAIN('d')} AND {_GAIN('p')} >= {_GAIN('t')} THEN 'probe' WHEN {_GAIN('d')} >= {_GAIN('t')} THEN 'dev' ELSE 'train' END"
_LESS = ", ".join(f"{x}{k} - CASE WHEN pick = '{n}' THEN n{k} ELSE 0 END" for x, n in (("p", "probe"), ("d", "dev"), ("t", "train")) for k in (0, 1))


@query("win18_greedy_group_split", _walk("p0, p1, d0, d1, t0, t1", "5::BIGINT, 40::BIGINT, 5::BIGINT, 40::BIGINT, 40::BIGINT, 200::BIGINT", f"SELECT rn, pair_id, pick, {_LESS} FROM (SELECT g.rn, g.pair_id, g.n0, g.n1, s.p0, s.p1, s.d0, s.d1, s.t0, s.t1, {_BEST} AS pick FROM s JOIN g ON g.rn = s.rn + 1)", "pair_id, pick AS split"))
def greedy_group_split(spark, sf):
    return S.greedy_groups(_pairs(spark, sf), _WANT, {"0": "n0", "1": "n1"}, ["pair_id"]).select("pair_id", "split")


_USE = lambda x, a, b: f"least(g.n0, greatest(0, {a} - s.{x}0)) + least(g.n1, greatest(0, {b} - s.{x}1))"
_OVER = lambda x, a, b: f"CASE WHEN g.n0 > 0 THEN greatest(0, s.{x}0 + g.n0 - {a}) ELSE 0 END + CASE WHEN g.n1 > 0 THEN greatest(0, s.{x}1 + g.n1 - {b}) ELSE 0 END"
_SCORE = lambda x, a, b, k: f"row({_USE(x, a, b)}, greatest(0, {a + b} - s.{x}0 - s.{x}1), -({_OVER(x, a, b)}), {k})"
_TOP = f"CASE WHEN {_SCORE('t', 40, 200, 0)} > {_SCORE('d', 5, 40, 2)} AND {_SCORE('t', 40, 200, 0)} > {_SCORE('p', 5, 40, 1)} THEN 'train' WHEN {_SCORE('d', 5, 40, 2)} > {_SCORE('p', 5, 40, 1)} THEN 'dev' ELSE 'probe' END"
_MORE = ", ".join(f"{x}{k} + CASE WHEN pick = '{n}' THEN n{k} ELSE 0 END" for x, n in (("p", "probe"), ("d", "dev"), ("t", "train")) for k in (0, 1))


@query("win18_msc15_scored_group_split", _walk("p0, p1, d0, d1, t0, t1", ", ".join(["0::BIGINT"] * 6), f"SELECT rn, pair_id, pick, {_MORE} FROM (SELECT g.rn, g.pair_id, g.n0, g.n1, s.p0, s.p1, s.d0, s.d1, s.t0, s.t1, {_TOP} AS pick FROM s JOIN g ON g.rn = s.rn + 1)", "pair_id, pick AS split"))
def scored_group_split(spark, sf):
    """The other allocator, by useful rows, lacking rows, overflow and priority."""
    return S.scored_groups(_pairs(spark, sf), {k: _WANT[k] for k in ("train", "dev", "probe")}, {"0": "n0", "1": "n1"}, ["pair_id"], ["train", "probe", "dev"]).select("pair_id", "split")


@query("win21_bucket_targets", f"SELECT id, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {_SHUF()}, id) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY source, key, id) AS r1 FROM ({_KEYED})) WHERE r1 <= 60) WHERE r2 <= 30")
def bucket_targets(spark, sf):
    near = S.first_of_each(keyed(spark, sf), ["domain"], ["source", "key", "id"], 60)
    return S.first_of_each(near.withColumn("s_", S.shuffled("id")), ["domain"], ["s_", "id"], 30).select("id", "domain")


@query("win23_family_cap", f"SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS r, (SELECT count(DISTINCT source) FROM documents) AS f FROM ({CORPUS_SQL})) ORDER BY (r <= floor(210 / f)) DESC, source, id LIMIT 210")
def family_cap(spark, sf):
    return S.capped(corpus(spark, sf).select("id", "source"), "source", 210, ["id"]).select("id", "source")


@query("win24_domain_limits", f"SELECT id, domain FROM (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY id) AS r FROM ({CORPUS_SQL})) WHERE (domain = 'en' AND r <= 50) OR (domain = 'fr' AND r <= 20)")
def domain_limits(spark, sf):
    return S.quotas(corpus(spark, sf).select("id", "domain"), "domain", {"en": 50, "fr": 20}, ["id"])


@query("win26_proportional_sample", f"SELECT id, domain FROM (SELECT *, r <= round_even(g * 100.0 / t, 0) AS chosen FROM (SELECT id, domain, {_SHUF()} AS s, row_number() OVER (PARTITION BY domain ORDER BY {_SHUF()}, id) AS r, count(*) OVER (PARTITION BY domain) AS g, count(*) OVER () AS t FROM ({CORPUS_SQL}))) ORDER BY chosen DESC, s, id LIMIT 100")
def proportional(spark, sf):
    own = corpus(spark, sf).select("id", "domain").withColumn("s_", S.shuffled("id"))
    return S.proportional(own, "domain", 100, ["s_", "id"]).select("id", "domain")


@query("win27_interleaved_sources", f"SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM ({CORPUS_SQL})) WHERE r <= 5 ORDER BY r, source LIMIT 70")
def interleave(spark, sf):
    return S.interleaved(corpus(spark, sf).select("id", "source"), "source", ["id"], 5, 70)


@query("win28_mix_dedup", f"SELECT key, id, side FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY side, id) AS r FROM (SELECT key, id, 0 AS side FROM ({_KEYED}) WHERE label = 0 UNION ALL SELECT key, id, 1 AS side FROM ({_KEYED}) WHERE label = 1)) WHERE r = 1")
def mix_dedup(spark, sf):
    own = keyed(spark, sf).where("label is not null").select("key", "id", F.col("label").alias("side"))
    return D.first_wins(own, ["key"], ["side", "id"])


@query("win29_spot_check", f"SELECT id FROM ({CORPUS_SQL}) ORDER BY {_SHUF()}, id LIMIT 25")
def spot_check(spark, sf):
    return corpus(spark, sf).select("id").orderBy(S.shuffled("id"), "id").limit(25)


@query("win30_stratified_folds", f"SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_SHUF()}, id) - 1) % 5 AS INT) AS fold FROM ({CORPUS_SQL}) WHERE label IS NOT NULL")
def stratified_folds(spark, sf):
    own = corpus(spark, sf).where("label is not null").select("id", "label").withColumn("s_", S.shuffled("id"))
    return S.folds(own, "label", 5, ["s_", "id"]).select("id", "label", "fold")


@query("jn15_versioned_merge", f"""WITH o AS (SELECT id, n, toxic IS DISTINCT FROM 1 AS ok FROM ({_KEYED}) WHERE source <> 'src5'), w AS (SELECT id, n + 1 AS n, n % 2 = 0 AS ok FROM ({_KEYED}) WHERE domain <> 'en'), r AS (SELECT id FROM ({_KEYED}) WHERE domain <> 'en' OR source = 'src7')
 SELECT id, CASE WHEN merge_source IN ('rerun_only', 'rerun_replaced') THEN wn ELSE n END AS n, merge_source FROM (SELECT coalesce(o.id, w.id) AS id, o.n, w.n AS wn, CASE WHEN o.id IS NULL AND coalesce(w.ok, false) THEN 'rerun_only' WHEN r.id IS NULL AND coalesce(o.ok, false) THEN 'v1_kept' WHEN coalesce(w.ok, false) THEN 'rerun_replaced' WHEN coalesce(o.ok, false) THEN CASE WHEN w.id IS NULL THEN 'v1_missing_rerun' ELSE 'v1_invalid_rerun' END END AS merge_source
 FROM o FULL OUTER JOIN w ON o.id = w.id LEFT JOIN r ON r.id = coalesce(o.id, w.id)) WHERE merge_source IS NOT NULL""")
def versioned_merge(spark, sf):
    own = keyed(spark, sf)
    old = own.where("source <> 'src5'").select("id", "n", (~F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("ok"))
    new = own.where("domain <> 'en'").select("id", (F.col("n") + 1).alias("n"), (F.col("n") % 2 == 0).alias("ok"))
    return D.versioned_merge(old, new, own.where("domain <> 'en' or source = 'src7'"), "id", "ok").select("id", "n", "merge_source")


@query("jn16_forbidden_reasons", f"SELECT id, CASE WHEN id IN (SELECT item_id FROM benchmark) THEN 'id' WHEN pair_id IN (SELECT pair_id FROM ({_KEYED}) WHERE toxic = 1) THEN 'pair' WHEN key IN (SELECT key FROM ({_KEYED}) WHERE label = 0) THEN 'text' END AS reason FROM ({_KEYED})")
def forbidden(spark, sf):
    own = keyed(spark, sf)
    sets = {"id": ("id", table(spark, sf, "benchmark").select("item_id")), "pair": ("pair_id", own.where("toxic = 1").select("pair_id")), "text": ("key", own.where("label = 0").select("key"))}
    return D.forbidden(own, sets).select("id", "reason")


@query("jn17_antijoin_exempt", f"SELECT id FROM ({_KEYED}) WHERE pair_id NOT IN (SELECT pair_id FROM ({_KEYED}) WHERE label = 1 EXCEPT SELECT pair_id FROM ({_KEYED}) WHERE label = 0)")
def antijoin(spark, sf):
    own = keyed(spark, sf)
    return D.without(own, "pair_id", own.where("label = 1").select("pair_id"), own.where("label = 0").select("pair_id")).select("id")


@query("src19_resume_finished", f"SELECT task_id FROM ({REWRITES_SQL}) WHERE task_id NOT IN (SELECT task_id FROM ({REWRITES_SQL}) WHERE length(rewrite_text) > 200)")
def resume(spark, sf):
    own = rewrites(spark, sf)
    return D.without(own, "task_id", own.where(F.length("rewrite_text") > 200).select("task_id")).select("task_id")


@query("agg32_split_leakage", f"WITH k AS (SELECT DISTINCT split, {_KEY} AS key FROM ({_SPLIT})) SELECT a.split AS a, b.split AS b, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.split < b.split GROUP BY ALL")
def split_leakage(spark, sf):
    own = S.pair_split(corpus(spark, sf).select("id", "label", "pair_id", F.md5(T.text_key("text").cast("binary")).alias("key")))
    return S.leakage(own, "key")


def _pairs(spark, sf):
    own = corpus(spark, sf).where("label is not null").groupBy("pair_id").agg(F.sum((F.col("label") == 0).cast("long")).alias("n0"), F.sum((F.col("label") == 1).cast("long")).alias("n1"))
    return own.withColumn("s", S.shuffled("pair_id"))


_DEAL = _SHUF("pair_id") + ", pair_id"


@query("win16_capped_dev_groups", _walk("h0, h1", "0::BIGINT, 0::BIGINT", "SELECT rn, pair_id, pick, h0 + CASE WHEN pick = 'dev' THEN n0 ELSE 0 END, h1 + CASE WHEN pick = 'dev' THEN n1 ELSE 0 END FROM (SELECT g.rn, g.pair_id, g.n0, g.n1, s.h0, s.h1, CASE WHEN s.h0 + g.n0 <= 10 AND s.h1 + g.n1 <= 40 THEN 'dev' ELSE 'train' END AS pick FROM s JOIN g ON g.rn = s.rn + 1)", "pair_id, pick AS split", _DEAL))
def capped_dev_groups(spark, sf):
    """Whole pairs to dev while no label passes its cap."""
    return S.capped_groups(_pairs(spark, sf), {"n0": 10, "n1": 40}, ["s", "pair_id"]).select("pair_id", "split")


@query("win19_groups_until_targets", _walk("h0, h1", "0::BIGINT, 0::BIGINT", "SELECT rn, pair_id, pick, h0 + CASE WHEN pick = 'yes' THEN n0 ELSE 0 END, h1 + CASE WHEN pick = 'yes' THEN n1 ELSE 0 END FROM (SELECT g.rn, g.pair_id, g.n0, g.n1, s.h0, s.h1, CASE WHEN g.n0 > 0 AND s.h0 < 20 OR g.n1 > 0 AND s.h1 < 60 THEN 'yes' ELSE 'no' END AS pick FROM s JOIN g ON g.rn = s.rn + 1)", "pair_id, pick = 'yes' AS selected", _DEAL))
def groups_until_targets(spark, sf):
    """Whole pairs in order until every label has its target."""
    return S.groups_until(_pairs(spark, sf), {"n0": 20, "n1": 60}, ["s", "pair_id"]).select("pair_id", "selected")


@query("win22_unique_fill")
def unique_fill(spark, sf):
    """Exact candidates, then bucket minimums, then a fill to the target, each pair and text once."""
    own = keyed(spark, sf).where("label is not null").select("id", "pair_id", "key", "domain", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("exact"))
    return S.unique_fill(own, "pair_id", "key", "domain", "exact", 80, {"fr": 10, "de": 10}, 15, ["id"]).select("id", "selected")


@query("jn19_forced_train", f"SELECT id, pair_id IN (SELECT pair_id FROM ({_KEYED}) WHERE toxic = 1) OR key IN (SELECT key FROM ({_KEYED}) WHERE label = 0) AS forced FROM ({_KEYED})")
def forced_train(spark, sf):
    own = keyed(spark, sf)
    return S.forced_train(own, {"pair_id": own.where("toxic = 1").select("pair_id"), "key": own.where("label = 0").select("key")}).select("id", "forced")


@query("srt06_hardest_literature", f"SELECT id, score FROM ({SQL['fea16_hardness']}) ORDER BY score DESC, {_SHUF()}, id LIMIT 50")
def hardest(spark, sf):
    from textloom.functions.features import hardness

    own = corpus(spark, sf).select("id", hardness("text").alias("score"))
    return own.orderBy(F.desc("score"), S.shuffled("id"), "id").limit(50)
