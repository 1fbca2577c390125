"""Readers on fixed inputs, repair of text and rule cubes against plain Python."""

import json
import random
from itertools import product

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from textloom.functions import lexicon as L
from textloom.functions import repair as E
from textloom.operators import reports as P
from textloom.operators import rules as R
from textloom.operators.store import settings
from textloom.plans.registry import QUERIES
from textloom.sources import readers as S


@pytest.fixture
def write(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return f"file://{tmp_path}"

    return put


def test_records_of_any_json(spark, write):
    write("a.json", ' {"id": "1", "text": "one"}\n')
    write("b.json", '[{"id": "2", "text": "two"}, 7,\n {"id": "3", "text": "three"}]')
    write("c.jsonl", '{"id": "4", "text": "four"}\nno json\n[1]\n\n{"id": "5", "text": "five"}\n')
    root = write("d.json", "")
    got = S.any_json(spark, f"{root}/*", "id STRING, text STRING").collect()
    assert sorted(map(tuple, got)) == [("1", "one"), ("2", "two"), ("3", "three"), ("4", "four"), ("5", "five")]


def test_files_by_suffix(spark, write):
    for name in ("a.json", "sub/b.jsonl", "sub/c.json.gz", "README.json", "sub/dataset_infos.json", "sub/x.txt", "z.jsonl"):
        root = write(name, "{}")
    got = [r.path.removeprefix("file:").lstrip("/").removeprefix(root.removeprefix("file://").lstrip("/")).lstrip("/") for r in S.files(spark, root, most=3).collect()]
    assert got == ["a.json", "sub/b.jsonl", "sub/c.json.gz"]


def test_specifications():
    assert S.parse_run(" My-Run = x/y.jsonl") == ("my_run", "x/y.jsonl")
    assert S.parse_split(["dev", "step7=a=b.jsonl", " guard = c.jsonl"], ("step7", "guard")) == ("dev", {"step7": "a=b.jsonl", "guard": "c.jsonl"})
    assert S.parse_limits("en=3, fr:4,,de=-1") == {"en": 3, "fr": 4, "de": -1}
    assert [n in L.BUCKET_GROUPS for n in ("all", "nonsense")] == [True, False]


def test_rewrite_inputs(spark, write):
    for name in ("llm_rewrite_b.jsonl", "llm_rewrite_a.jsonl", "llm_rewrite_a_FAILED.jsonl", "seed.jsonl", "other.jsonl"):
        root = write(name, "{}")
    assert S.rewrite_inputs(spark, root, ("none.jsonl", "seed.jsonl")) == ["seed.jsonl", "llm_rewrite_a.jsonl", "llm_rewrite_b.jsonl"]


def test_grids_and_targets(spark):
    assert [r.threshold for r in P.grid(spark, 0.05, 0.95, 0.01).orderBy("threshold").collect()] == [round(0.05 + k * 0.01, 6) for k in range(91)]
    got = {r.id: r.t for r in spark.range(45).select("id", P.provisional_target("id", 20, 10, 0.25).alias("t")).collect()}
    assert got == {a: 10 if a >= 30 else a if a <= 1 else max(1, min(a - 1, round(a * 0.25))) for a in range(45)}


def test_lines_of_a_split_file_are_numbered_as_in_one_scan(spark, write):
    r = random.Random(1)
    lines = [r.choice([json.dumps({"id": str(k), "text": "x" * r.randrange(200)}), json.dumps({"id": str(k), "text": "x"}), "no json", "[1]", "", "  "]) for k in range(5000)]
    write("one.jsonl", "\n".join(lines))
    root = write("two.jsonl", "\n".join(lines[:7]) + "\n")
    want = [(f, k, json.loads(t)["id"]) for f, own in (("one", lines), ("two", lines[:7])) for k, t in enumerate(own, 1) if t.startswith("{")]
    observed = Observation("lines")
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}):
        df = S.numbered_lines(spark, f"{root}/*.jsonl", "id STRING, text STRING", observed=observed)
        got = df.select(F.regexp_extract("file", r"(\w+)\.jsonl", 1), "line", "record.id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    filled = [t for own in (lines, lines[:7]) for t in own if t.strip()]
    assert observed.get == {"lines": len(filled), "bad": sum(not t.startswith("{") for t in filled)}
    with pytest.raises(Exception, match="no JSON object in line"):
        S.numbered_lines(spark, f"{root}/*.jsonl", strict=True).collect()


CLEAN = ["café “État” – déjà vu…", "Größe, Ähnlich; œuvre", "naïve façade 100 €", "Привет, мир", "日本語のテキスト", "emoji 😀 and ½", "Ä…", "plain"]


@pytest.mark.parametrize("table", ["latin-1", "cp1252"])
@pytest.mark.parametrize("times", [0, 1, 2, 3])
def test_damaged_texts_come_back(spark, table, times):
    def damaged(t):
        for _ in range(times):
            raw = t.encode("utf-8")
            t = raw.decode("latin-1") if table == "latin-1" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
        return t

    texts = [t for t in CLEAN if times == 0 or t != "Ä…"]
    df = spark.createDataFrame([*((k, damaged(t)) for k, t in enumerate(texts)), (98, None), (99, "")], "id int, text string")
    got = {r.id: r.text for r in E.with_repaired(df).collect()}
    want = dict(enumerate(texts)) | {98: None, 99: ""}
    if times == 0:
        want[texts.index("Ä…")] = got[texts.index("Ä…")]  # reads as one letter too
    assert got == want


def chains(run, depth=E.DEPTH):
    """All texts by all chains of wrong steps, without a memory, with the steps that they take."""
    out = [(E.badness(run), 0, run)]
    for tables in (p for n in range(1, depth + 1) for p in product(E.TABLES, repeat=n)):
        t = run
        for table in tables:
            raw = E._bytes(t, table)
            try:
                t = raw.decode("utf-8") if raw is not None else None
            except UnicodeDecodeError:
                t = None
            if t is None:
                break
        else:
            out.append((E.badness(t), len(tables), t))
    return out


def test_repair_is_the_least_bad_of_all_chains():
    r = random.Random(3)
    pool = "éàüßœñ€–“”’Ââ©ÃÐŸ¼日😀\x85\xa0"
    for _ in range(300):
        run = "".join(r.choice(pool) for _ in range(r.randrange(2, 7)))
        for _ in range(r.randrange(3)):
            run = run.encode("utf-8").decode("latin-1")
        found = chains(run)
        least = min(b for b, _, _ in found)
        got = E.repaired_run(run)
        assert (E.badness(got), got) in {(b, t) for b, _, t in found if b == least}
        if least == E.badness(run):
            assert got == run


def test_a_cube_of_rules_is_the_search(spark):
    r = random.Random(6)
    rows = [(r.choice([0, 1, None]), r.choice([0, 1]), r.random(), r.choice([None, r.random()]), r.choice("ab")) for _ in range(500)]
    df = spark.createDataFrame(rows, "label int, on int, p double, u double, s string").repartition(3)
    values = {"p": [0.5, 0.1, 0.9], "u": [0.2, 0.8, 0.5]}
    axes = {"p": (F.col("p"), ">=", values["p"]), "u": (F.col("u"), "<=", values["u"])}
    rules = R.grid(**values)
    on = lambda g: (F.col("on") == 1) & (F.col("p") >= g["p"]) & (F.col("u") <= g["u"])
    want = sorted(map(tuple, R.search(df, rules, on).collect()))
    got = R.cube(df, F.col("on") == 1, axes)
    assert sorted(map(tuple, got.select("rule", "overrides", "fixed_fn", "induced_fp").collect())) == want
    assert [(x.p, x.u) for x in got.orderBy("rule").collect()] == [(g["p"], g["u"]) for g in rules]
    by = sorted(map(tuple, R.search_by(df, rules, on, "s").select("rule", "s", "overrides", "fixed_fn", "induced_fp").collect()))
    assert sorted(map(tuple, R.cube(df, F.col("on") == 1, axes, by="s").select("rule", "s", "overrides", "fixed_fn", "induced_fp").collect())) == by


def test_a_hundred_thousand_rules_in_one_aggregation(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("label"), *(((F.col("id") * m) % 1009 / 1009.0).alias(c) for c, m in (("a", 7), ("b", 31), ("c", 101))))
    grid = {"a": [k / 50 for k in range(50)], "b": [k / 50 for k in range(50)], "c": [k / 40 for k in range(40)]}
    got = R.cube(df, F.lit(True), {c: (F.col(c), ">=", v) for c, v in grid.items()})
    assert got.count() == 100_000
    pdf = df.toPandas()
    for x in got.sample(0.0005, seed=1).collect():
        on = pdf[(pdf.a >= x.a) & (pdf.b >= x.b) & (pdf.c >= x.c)]
        assert (x.overrides, x.fixed_fn, x.induced_fp) == (len(on), (on.label == 1).sum(), (on.label == 0).sum())
    with pytest.raises(ValueError, match="cells"):
        R.cube(df, F.lit(True), {c: (F.col(c), ">=", v) for c, v in grid.items()}, most=1000)


def test_container_files_do_not_grow_with_the_table(spark, tmp_path):
    spark.range(5000).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'src1' as source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(10).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["src04_containers"](spark, str(tmp_path))
    assert got.count() == 5000 and got.select("id").distinct().count() == 5000
    assert len(got.inputFiles()) == 5


def test_files_of_numbered_lines_grow_in_number_with_the_table(spark, tmp_path):
    spark.range(0, 5000, 1, 12).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'src1' as source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(10).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}):
        got = QUERIES["src01_02_numbered_lines"](spark, str(tmp_path))
    want, line = {}, 0
    for k in range(5000):
        want[str(k)] = line + 1
        line += 4 if str(k).endswith("7") else 1
    assert {r["id"]: r["line"] for r in got.select("id", "line").collect()} == want
    assert len([f for f in got.inputFiles() if f.endswith(".txt")]) > 4
