"""Functions and operators on small fixtures, and against plain Python."""

import json
import random
import statistics
import unicodedata
from string import punctuation

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import features as X
from textloom.functions import lexicon as L
from textloom.functions import quality as Q
from textloom.functions import taxonomy as C
from textloom.functions import text as T
from textloom.plans import registry as R
from textloom.operators import align as A
from textloom.operators import dedup as D
from textloom.operators import metrics as M
from textloom.operators import splits as S
from textloom.operators.order import positions
from textloom.sources import readers, writers
from textloom.streaming import resume


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""),
        ("a\r\nb\rc", "a\nb\nc"),
        ("x y​z  w", "x yz w"),
        ("“q” ‘r’ — –", "\"q\" 'r' - -"),
        ("dÃ©jÃ  donâ€™t", "déjà don't"),
        ("ﬁ ①", "fi 1"),
        ("a \n b\n\n\n\n\nc", "a\nb\n\n\nc"),
    ],
)
def test_normalisation(spark, text, want):
    assert one(spark, T.normalize_text("text"), text) == want


def test_the_compatibility_form_takes_few_texts_at_a_time(monkeypatch):
    odd = ["", "plain", "déjà vu", "ﬁ①ẹ́", "한한", None, "ｶﾞ½"]
    sizes = []

    column = pa.array([odd[k % 7] for k in range(1000)], pa.string())
    monkeypatch.setattr(T.pa, "array", lambda x, *a, make=pa.array: (sizes.append(len(x)), make(x, *a))[1])
    got = T._nfkc.func(column)
    assert got.to_pylist() == [t and unicodedata.normalize("NFKC", t) for t in column.to_pylist()]
    assert max(sizes) <= 64 and sum(sizes) == 1000
    assert len(T._nfkc.func(column.slice(0, 0))) == 0


def test_words_and_keys(spark):
    assert one(spark, T.word_count("text"), "It's o'er 3 wee-days") == 4
    assert one(spark, T.text_key("text"), "  A\tb\n C ") == "a b c"
    assert one(spark, T.slug("text"), "Ab  c/É d!") == "ab_c_d"
    assert one(spark, T.clean_output("text"), "```text\nHere is the rewrite: \"x\"\n```") == ": \"x\""
    assert one(spark, T.clean_output("text"), "“Quoted.”") == "Quoted."
    assert one(spark, T.blocks("text"), "a\nb\n\nc\n\n\nd") == ["a\nb\nc", "d"]
    assert one(spark, T.preview("text", 10), "abcdefg hijklm") == "abcdefg..."


@pytest.mark.parametrize(
    ("text", "bucket"),
    [
        ("The moon\nthy heart\na sea\nof dew", "poetry_classical"),
        ("One line\ntwo lines\nred wheel\nbarrow", "poetry_freeverse"),
        ("word " * 60 + "(Smith, 2020)", "academic_formal"),
        ("word " * 60 + "et al. 2020", "general_prose"),
        ("word " * 60 + "et al.2020", "academic_formal"),
        ("word " * 60 + "table 1", "academic_formal"),
        ("word " * 60 + "Table 1", "general_prose"),
        ("word " * 60 + "alas", "literary_old_prose"),
        ("a short piece", "literary_short_fragment"),
    ],
)
def test_bucket(spark, text, bucket):
    df = spark.createDataFrame([(text,)], "text string")
    assert X.with_surface(df).first().bucket == bucket


@pytest.mark.parametrize(
    ("text", "bucket", "rough"),
    [
        ("word " * 60 + "fête né alasé", "literary_old_prose", "literary_old_prose"),
        ("word " * 60 + "éhath", "literary_old_prose", "general_prose"),
        ("word " * 60 + "étable 1", "academic_formal", "academic_formal"),
        ("word " * 60 + "et al.é", "general_prose", "general_prose"),
        ("word " * 60 + "table\x0b1", "general_prose", "general_prose"),
    ],
)
def test_edges_of_words_are_those_of_ascii_as_in_sql(spark, text, bucket, rough):
    df = spark.createDataFrame([(text,)], "text string")
    assert X.with_surface(df).first().bucket == bucket
    assert X.rough_domain(df).first().rough_domain == rough
    for p, own in (("(?i)" + "|".join(L.PROMPT_LEAKAGE), "As an AIé"), (L.OLD_PROSE, text), (L.CITATION, text)):
        want = duckdb.execute("SELECT regexp_matches(?, ?)", [own, p]).fetchone()[0]
        assert one(spark, F.col("text").rlike(T.ascii_pattern(p)), own) == want
    assert one(spark, Q.has_prompt_leakage("text"), "As an AIé")


BUCKETED = ["bucket_distribution", "fea02_bucket", "fea03_kept_buckets", "fea17_22_taxonomy_weight", "fea21_inferred_bucket", "fea26_rough_domain", "fea37_precision_guard", "fea38_residual_override", "fea39_routed_threshold", "flt15_quality_flags", "flt29_policy_override", "msc18_source_buckets"]


@pytest.fixture(scope="module")
def edged(spark, tmp_path_factory):
    """Documents whose buckets hang on edges of words beside letters of other scripts, each of them eight times with other ids."""
    path, n = tmp_path_factory.mktemp("edged"), 0
    rows = []
    for _ in range(8):
        for mark in ("é", "_", "1", "'", "-", " ", "ß"):
            for w in ("alas", "hath", "ere", "nay", "table 1", "figure\n22", "et al.", "(Smith, 2020)", "here is the rewrite", "As an AI"):
                for own in (f"{mark}{w}", f"{w}{mark}", f"{mark}{w}{mark}", f"é{w}é {w}"):
                    rows.append((n, "word " * (60 if n % 3 else 20) + own + (" semantic" * (n % 5)), "en" if n % 2 else "fr", f"src{n % 7}", 1))
                    n += 1
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k // 3 % 2, 0) for k in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", BUCKETED)
def test_queries_over_buckets_have_the_edges_of_their_sql(spark, edged, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{edged}/{t}.parquet/*.parquet'")
    got, want = R.QUERIES[name](spark, edged), con.sql(R.SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


@pytest.mark.parametrize("text", ["a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h\u2029 \u00a0\n\t\n\u3000i", "", "\n \n", "x\r\n\r\ny"])
def test_lines_are_those_of_python(spark, text):
    assert one(spark, T.lines("text"), text) == [x for x in text.splitlines() if x.strip()]


def test_characters_are_counted_among_many(spark):
    text = "a-–—b\\]^[!~`'\"‘’“”;;\n\n😀.,"
    for chars in (punctuation, "'\"`‘’“”", "-–—", ";", "\n", "()"):
        assert one(spark, X._chars(F.col("text"), chars), text) == sum(c in chars for c in text)


def test_existing_features_win(spark):
    df = spark.createDataFrame([("abc", 7.0, "mine"), ("abc", None, None)], "text string, length_words double, bucket string")
    a, b = X.with_surface(df).select("length_words", "bucket").collect()
    assert tuple(a) == (7.0, "mine") and tuple(b) == (1.0, "literary_short_fragment")


def test_sentence_moments(spark):
    df = spark.createDataFrame([("One two three. Four! Five six?",)], "text string")
    r = X.with_surface(df).first()
    assert r.sentence_length_mean == 2.0 and r.sentence_length_std == pytest.approx(statistics.pstdev([3, 1, 2]))


def test_truncation_and_quality(spark):
    cut = lambda t: one(spark, Q.looks_truncated("text"), t)
    assert [cut(t) for t in ("", "Done.", "He said ”", "and", "end,", "Yes?)")] == [True, False, False, True, True, False]
    df = spark.createDataFrame([("word " * 40, "word " * 5, "literature")], "source_text string, rewrite_text string, domain string")
    q = df.select(Q.rewrite_quality("source_text", "rewrite_text").alias("q")).first().q
    assert q.quality_issues == ["too_short_absolute", "too_short_relative", "too_similar_to_source"] and q.length_ratio == 0.125
    df = spark.createDataFrame([(0, "a", None, "x"), (None, "", "p", " ")], "label int, id string, pair_id string, text string")
    assert [r.r for r in df.select(Q.human_reasons().alias("r")).collect()] == [["missing_pair_id"], ["bad_label", "missing_id", "empty_text"]]


def test_flips_and_bins(spark):
    rows = [(y, a, b) for y in (0, 1) for a in (0, 1) for b in (0, 1)]
    df = spark.createDataFrame(rows, "y int, a int, b int")
    got = [r.f for r in df.select(C.flip_type("y", "a", "b").alias("f")).collect()]
    assert got == ["stable_step7_correct", "induced_fp", "round4_fixed_fp", "both_miss", "both_miss", "fixed_fn_candidate", "round4_induced_fn", "stable_step7_correct"]
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,), (-0.2,), (1.3,), (None,)], "p double")
    assert [r.b for r in df.select(C.histogram_bin("p").alias("b")).collect()] == ["0.0-0.1", "0.1-0.2", "0.9-1.0", "0.0-0.1", "0.9-1.0", "missing"]


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "label int, p double")
    assert M.roc_auc(df).first().roc_auc == 0.625
    assert M.roc_auc(df.where("label = 1")).first().roc_auc is None


def test_grid_agrees_with_direct_counts(spark):
    r = random.Random(1)
    rows = [(r.randrange(2), r.choice([0.1, 0.25, 0.5, 0.75]), r.choice("ab")) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, p double, g string")
    grid = spark.createDataFrame([(t,) for t in (0.0, 0.1, 0.3, 0.5, 0.9)], "t double")
    for x in M.at_grid(df, grid, ["g"]).collect():
        own = [(y, p >= x.threshold) for y, p, g in rows if g == x.g]
        assert (x.tp, x.fp) == (sum(y == 1 and p for y, p in own), sum(y == 0 and p for y, p in own)) and x.rows == len(own)


def brute_greedy(rows):
    seen, kept = [set(), set()], []
    for k, row in enumerate(rows):
        if all(v is None or v not in s for v, s in zip(row, seen, strict=True)):
            kept.append(k)
            for v, s in zip(row, seen, strict=True):
                s.add(v)
    return kept


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_greedy_dedup(spark, seed):
    r = random.Random(seed)
    rows = [("a", "p"), ("b", "p"), ("b", "q")] if seed == 0 else [(r.choice([None, *"abcdefgh"]), r.choice([None, *"pqrstu"])) for _ in range(40)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "o int, a string, b string")
    assert sorted(x.o for x in D.greedy(df, ["a", "b"], "o").collect()) == brute_greedy(rows)


def test_first_wins_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "o int, k string")
    assert sorted(r.o for r in D.first_wins(df, ["k"], ["o"]).collect()) == [1, 3, 4, 5]
    assert sorted(r.o for r in D.first_wins(df, ["k"], ["o"], last=True).collect()) == [2, 3, 4, 5]


def test_positions_over_groups(spark):
    r = random.Random(4)
    rows = [(r.choice([None, "x", "y"]), r.randrange(1000), k) for k in range(300)]
    got = positions(spark.createDataFrame(rows, "g string, v int, k int"), ["v", "k"], ["g"]).collect()
    for g in (None, "x", "y"):
        own = sorted((x.v, x.k, x.position) for x in got if x.g == g)
        assert [p for *_, p in own] == list(range(1, len(own) + 1))


def test_pair_split_counts(spark):
    rows = [(2 * p + k, k, p) for p in range(10) for k in (0, 1)] + [(100 + p, 0, 50 + p) for p in range(3)]
    out = S.pair_split(spark.createDataFrame(rows, "id int, label int, pair_id int"))
    got = {(r.signature, r.split): r.n for r in out.groupBy("signature", "split").agg(F.count_distinct("pair_id").alias("n")).collect()}
    assert got == {("human_and_llm", "train"): 8, ("human_and_llm", "valid"): 1, ("human_and_llm", "test"): 1, ("human_only", "train"): 2, ("human_only", "test"): 1}
    assert S.leakage(out, "pair_id").count() == 0


def test_label_mismatch_raises(spark):
    a = spark.createDataFrame([(1, 0, 0.1, 0)], "id int, label int, p double, pred int")
    b = spark.createDataFrame([(1, 1, 0.2, 0)], "id int, label int, p double, pred int")
    with pytest.raises(Exception, match="labels differ"):
        A.pair(a, b, ("a", "b")).collect()


def test_readers_and_writers(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"id": "1", "text": "x", "label": 1}\nnot json\n{"id": "2", "text": "y", "label": 0}\n')
    root = f"file://{f}"
    assert readers.lines(spark, [root, f"file://{tmp_path}/missing.jsonl"]).count() == 2
    assert readers.lines(spark, f"file://{tmp_path}/missing.jsonl").count() == 0
    assert readers.bad_lines(spark, root).first().bad == 1
    with pytest.raises(Exception):
        readers.lines(spark, root, strict=True).collect()
    for body in ([{"id": "1", "label": 0}], {"samples": [{"id": "1", "label": 0}]}, {"items": [{"id": "1", "label": 0}]}):
        g = tmp_path / "c.json"
        g.write_text(json.dumps(body))
        assert [r.id for r in readers.records(spark, f"file://{g}").collect()] == ["1"]
    df = spark.createDataFrame([("a", 0, 0.25), ("b", 1, 0.75)], "id string, label int, prob_llm double")
    p = readers.predictions(df)
    assert [(r.prediction, r.probability) for r in p.orderBy("id").collect()] == [(0, 0.25), (1, 0.75)]
    writers.predictions(p, f"file://{tmp_path}/out")
    assert readers.lines(spark, f"file://{tmp_path}/out", readers.PREDICTION).count() == 2
    writers.records(p, f"file://{tmp_path}/t.csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/t.csv").count() == 2
    assert writers.markdown(p.select("id").orderBy("id")).splitlines()[2] == "| a |"
    assert readers.parse_run("Step 7 = x/y.jsonl") == ("step_7", "x/y.jsonl") and readers.parse_limits("en=3, fr:4") == {"en": 3, "fr": 4}


def test_stream_resumes(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"task_id": "a"}\n{"task_id": "b"}\n{"task_id": "a"}\n')
    run = lambda: resume.follow(spark, f"file://{src}", "task_id string", lambda b: b.withColumn("n", F.lit(1)), f"file://{out}", f"file://{cp}").awaitTermination()
    run()
    (tmp_path / "in/2.json").write_text('{"task_id": "b"}\n{"task_id": "c"}\n')
    run()
    assert sorted(r.task_id for r in spark.read.parquet(f"file://{out}").collect()) == ["a", "b", "c"]


def test_ordered_allocators(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate([(1, 1), (2, 0), (0, 3), (1, 0), (0, 1), (5, 5)])]
    g = spark.createDataFrame(rows, "g int, n0 long, n1 long").repartition(3)
    assert [r.split for r in S.capped_groups(g, {"n0": 2, "n1": 3}, ["g"]).orderBy("g").collect()] == ["dev", "train", "train", "dev", "dev", "train"]
    assert [r.selected for r in S.groups_until(g, {"n0": 3, "n1": 4}, ["g"]).orderBy("g").collect()] == [True, True, True, False, False, False]
    want = {"train": {"0": 3, "1": 1}, "dev": {"0": 1, "1": 3}}
    assert [r.split for r in S.greedy_groups(g, want, {"0": "n0", "1": "n1"}, ["g"]).orderBy("g").collect()] == ["train", "train", "dev", "dev", "train", "train"]
    rows = [(0, "a", "x", "p", True), (1, "a", "y", "p", True), (2, "b", "x", "q", False), (3, "c", "z", "q", False), (4, "d", "w", "p", False), (5, "e", "v", "r", False)]
    t = spark.createDataFrame(rows, "id int, g string, t string, b string, e boolean")
    assert [r.selected for r in S.unique_fill(t, "g", "t", "b", "e", 3, {"q": 1}, 2, ["id"]).orderBy("id").collect()] == [True, False, False, True, True, False]
