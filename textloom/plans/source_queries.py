"""Queries of readers and writers: what is written to a scratch folder comes back as it was."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators.store import scratch, settings, written
from textloom.plans.registry import query
from textloom.plans.views import CORPUS_SQL, PREDS_SQL, corpus, preds, table
from textloom.sources import readers as R
from textloom.sources import writers as W

_ROWS = "SELECT CAST(id AS VARCHAR) AS id, md5(text) AS h, label, domain, source"


def rows(spark, sf):
    return corpus(spark, sf).select(F.col("id").cast("string").alias("id"), "text", "label", "domain", "source")


def _seen(df):
    return df.select("id", F.md5(F.col("text").cast("binary")).alias("h"), "label", "domain", "source")


def _file(spark, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


@query("src01_lenient_lines", f"{_ROWS} FROM ({CORPUS_SQL})")
def lenient(spark, sf):
    """Good lines among bad and blank ones, and a path that does not exist."""
    path = scratch(spark, "lenient")
    own = rows(spark, sf)
    bad = own.where("id like '%7'").select(F.explode(F.array(F.lit("no json"), F.lit(""), F.lit('{"id": '))).alias("value"))
    own.select(F.to_json(F.struct("*")).alias("value")).unionAll(bad).write.text(path)
    return _seen(R.lines(spark, [path, f"{path}-missing"]))


@query("src01_02_numbered_lines", f"SELECT id, line, h FROM (SELECT CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY id, k) AS line, k, md5(text) AS h FROM (SELECT id, 0 AS k, text FROM ({CORPUS_SQL}) UNION ALL SELECT id, k, text FROM ({CORPUS_SQL}) CROSS JOIN (VALUES (1), (2), (3)) b(k) WHERE CAST(id AS VARCHAR) LIKE '%7')) WHERE k = 0")
def numbered(spark, sf):
    """Lines in order of ids, some bad or blank, read in small ranges: a line's number in its file plus the lines of the files before."""
    path = scratch(spark, "numbered")
    own = corpus(spark, sf).select("id", F.to_json(F.struct(F.col("id").cast("string").alias("id"), "text")).alias("value"))
    bad = F.array(F.col("value"), F.lit("no json"), F.lit(""), F.lit('{"id": '))
    # files grow in number, not in size, with the table
    n = max(4, table(spark, sf, "documents").rdd.getNumPartitions())
    own.repartitionByRange(n, "id").sortWithinPartitions("id").select(F.explode(F.when(F.col("id").cast("string").like("%7"), bad).otherwise(F.array("value"))).alias("value")).write.text(path)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "300000", "spark.sql.files.openCostInBytes": "0"}):
        got = written(R.numbered_lines(spark, path, "id STRING, text STRING").select("file", "line", "record.*"), "numbered")
    sizes = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    # a row for each file
    base = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return got.join(base, "file").select("id", (F.col("line") + F.col("base")).alias("line"), F.md5(F.col("text").cast("binary")).alias("h"))


@query("src01_bad_lines", f"SELECT 2 * count(*) AS bad FROM ({CORPUS_SQL}) WHERE CAST(id AS VARCHAR) LIKE '%7'")
def bad_lines(spark, sf):
    path = scratch(spark, "bad")
    own = rows(spark, sf)
    bad = own.where("id like '%7'").select(F.explode(F.array(F.lit("no json"), F.lit(""), F.lit('{"id": '))).alias("value"))
    own.select(F.to_json(F.struct("*")).alias("value")).unionAll(bad).write.text(path)
    return R.bad_lines(spark, path).agg(F.sum("bad").alias("bad"))


@query("src02_snk01_strict_lines", f"{_ROWS} FROM ({CORPUS_SQL})")
def strict(spark, sf):
    path = scratch(spark, "strict")
    W.lines(rows(spark, sf), path)
    return _seen(R.lines(spark, path, strict=True))


@query("src03_labelled_lines", f"{_ROWS} FROM ({CORPUS_SQL}) WHERE label IN (0, 1) AND length(trim(text)) > 0")
def labelled(spark, sf):
    path = scratch(spark, "labelled")
    W.lines(rows(spark, sf), path)
    return _seen(R.labelled(R.lines(spark, path)))


@query("src04_containers", f"{_ROWS} FROM ({CORPUS_SQL})")
def containers(spark, sf):
    """Lists in some files, objects with a list under different keys in others; a file holds the records of one domain and 1,024 ids in a row, so the
    whole files that tasks hold stay as they are while their number grows with the table."""
    path = scratch(spark, "containers")
    listed = rows(spark, sf).groupBy("domain", F.expr("cast(id as long) div 1024")).agg(F.to_json(F.collect_list(F.struct("id", "text", "label", "domain", "source"))).alias("j"))
    key = F.when(F.col("domain") == "en", F.col("j")).otherwise(F.concat(F.lit('{"'), F.when(F.col("domain") == "de", "samples").otherwise("data"), F.lit('": '), "j", F.lit("}")))
    listed.select(key.alias("value"), F.col("domain").alias("d")).write.option("maxRecordsPerFile", 1).partitionBy("d").text(path)
    return _seen(R.containers(spark, path))


@query("src05_origins", f"SELECT 'a' AS origin, count(*) AS n FROM ({CORPUS_SQL}) WHERE label = 0 UNION ALL SELECT 'b', count(*) FROM ({CORPUS_SQL}) WHERE label = 1")
def origins(spark, sf):
    path = scratch(spark, "origins")
    for k, name in enumerate("ab"):
        W.lines(rows(spark, sf).where(f"label = {k}"), f"{path}/{name}")
    both = R.lines(spark, [f"{path}/a", f"{path}/b"], origin="file")
    return both.groupBy(F.regexp_extract("file", r"/([ab])/[^/]*$", 1).alias("origin")).agg(F.count("*").alias("n"))


@query("src06_gzip_lines", f"{_ROWS} FROM ({CORPUS_SQL})")
def gzipped(spark, sf):
    path = scratch(spark, "gzip")
    rows(spark, sf).write.option("compression", "gzip").json(path)
    return _seen(R.lines(spark, f"{path}/*.gz"))


@query("src10_11_books", f"SELECT 'T' || row_number() OVER (ORDER BY md5(text)) AS title, md5(text) AS h FROM (SELECT text FROM ({CORPUS_SQL}) WHERE length(trim(text)) > 0 AND NOT contains(text, chr(13)) ORDER BY id LIMIT 12)")
def books(spark, sf):
    path = scratch(spark, "books")
    own = corpus(spark, sf).where((F.length(F.trim("text")) > 0) & ~F.contains("text", F.lit("\r"))).orderBy("id").limit(12)
    own.select("text").coalesce(1).write.option("maxRecordsPerFile", 1).option("lineSep", "\x00").text(f"{path}/txt")
    named = R.books(spark, f"{path}/txt").select("file", F.md5(F.regexp_replace("text", "\x00$", "").cast("binary")).alias("h")).orderBy("h").collect()
    _file(spark, f"{path}/meta.json", "[" + ", ".join(f'{{"gutenberg_id": {k}, "title": "T{k}", "local_path": "x\\\\y/{r.file}"}}' for k, r in enumerate(named, 1)) + "]")
    return R.books(spark, f"{path}/txt", f"{path}/meta.json").select("title", F.md5(F.regexp_replace("text", "\x00$", "").cast("binary")).alias("h"))


@query("src13_plain_text_url", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u/8.utf-8' WHEN event_id % 3 = 1 THEN 'u/plain.txt' END AS url FROM events")
def plain_text(spark, sf):
    from textloom.plans.views import table

    k = F.col("event_id") % 3
    formats = F.create_map(F.lit("text/html"), F.lit("u/h.html"), F.lit("text/plain"), F.when(k < 2, "u/plain.txt").otherwise("u/README.txt"), F.lit("text/plain; charset=utf-8"), F.when(k == 0, "u/8.utf-8").otherwise("u/readme.utf-8"))
    return table(spark, sf, "events").select("event_id", formats.alias("formats")).select("event_id", R.plain_text_url().alias("url"))


@query("src15_globbed_runs", f"SELECT 'run_' || r AS run, count(*) AS n FROM ({CORPUS_SQL}) CROSS JOIN (VALUES ('a'), ('b')) t(r) WHERE label IS NOT NULL GROUP BY r")
def globbed(spark, sf):
    path = scratch(spark, "globs")
    for name in ("run_a", "run_b", "other"):
        W.lines(rows(spark, sf).where("label is not null"), f"{path}/{name}")
    both = R.lines(spark, f"{path}/run_*", origin="file")
    return both.groupBy(F.regexp_extract("file", r"/(run_\w)/[^/]*$", 1).alias("run")).agg(F.count("*").alias("n"))


@query("snk02_03_appended_lines", f"SELECT CAST(id AS VARCHAR) AS id, 2::BIGINT AS n FROM ({CORPUS_SQL})")
def appended(spark, sf):
    path = scratch(spark, "append")
    for _ in range(2):
        W.lines(rows(spark, sf), path, append=True)
    return R.lines(spark, path).groupBy("id").agg(F.count("*").alias("n"))


@query("snk04_records_by_suffix", " UNION ALL ".join(f"SELECT '{s}' AS suffix, count(*) AS n, {'sum(length(text))' if s != 'csv' else 'sum(length(text))'}::BIGINT AS chars FROM ({CORPUS_SQL})" for s in ("parquet", "csv", "jsonl")))
def by_suffix(spark, sf):
    path = scratch(spark, "suffix")
    out = None
    for s in ("parquet", "csv", "jsonl"):
        W.records(rows(spark, sf), f"{path}/x.{s}")
        got = R.records(spark, f"{path}/x.{s}", "id STRING, text STRING, label INT, domain STRING, source STRING").agg(F.lit(s).alias("suffix"), F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
        out = got if out is None else out.unionAll(got)
    return out


@query("snk05_06_csv", f"SELECT CAST(id AS VARCHAR) AS id, domain, '[' || label || ',' || label || ']' AS list FROM ({CORPUS_SQL}) WHERE label IS NOT NULL")
def csv(spark, sf):
    path = scratch(spark, "csv")
    W.table(rows(spark, sf).where("label is not null").withColumn("list", F.array("label", "label")), path, ["list", "id", "domain"])
    return spark.read.option("header", True).option("escape", '"').csv(path).select("id", "domain", "list")


@query("snk07_matrix", f"SELECT domain, CAST({' || chr(44) || '.join(f'count(*) FILTER (source = (SELECT source FROM ({CORPUS_SQL}) GROUP BY source ORDER BY source LIMIT 1 OFFSET {k}))' for k in (0, 1))} AS VARCHAR) AS cells FROM ({CORPUS_SQL}) GROUP BY domain")
def matrix(spark, sf):
    path = scratch(spark, "matrix")
    W.matrix(corpus(spark, sf).groupBy("domain", "source").agg(F.count("*").alias("n")), path, "domain", "source", "n")
    got = spark.read.option("header", True).csv(path)
    return got.select("domain", F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`"), F.lit("0")) for c in sorted(got.columns[1:])[:2])).alias("cells"))


@query("snk08_predictions", f"SELECT CAST(id AS VARCHAR) AS id, label, CAST(p_step7 >= 0.55 AS INT) AS prediction, round(p_step7, 9) AS prob_llm, domain FROM ({PREDS_SQL})")
def predictions(spark, sf):
    path = scratch(spark, "predictions")
    own = preds(spark, sf)
    W.predictions(own.select(F.col("id").cast("string").alias("id"), "label", (F.col("p_step7") >= 0.55).cast("int").alias("prediction"), F.col("p_step7").alias("probability"), "domain", "source"), path)
    return R.lines(spark, path, R.PREDICTION).select("id", "label", "prediction", F.round("prob_llm", 9).alias("prob_llm"), "domain")


@query("snk09_submission", f"SELECT row_number() OVER (ORDER BY id) AS k, CAST(p_step7 >= 0.55 AS INT) AS label, round(p_step7, 6) AS probability FROM ({PREDS_SQL})")
def submission(spark, sf):
    from textloom.operators.order import positions

    path = scratch(spark, "submission")
    own = preds(spark, sf).select("id", (F.col("p_step7") >= 0.55).cast("int").alias("prediction"), F.col("p_step7").alias("probability"))
    W.submission(own, path, "id")
    got = spark.read.schema("label int, probability double").json(path).select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    return positions(got.coalesce(1).withColumn("m", F.monotonically_increasing_id()), ["f", "m"], into="k").select("k", "label", "probability")


@query("snk10_report", f"SELECT 'domains' AS part, count(DISTINCT domain) AS n FROM ({CORPUS_SQL}) UNION ALL SELECT 'labels', count(DISTINCT coalesce(label, -1)) FROM ({CORPUS_SQL})")
def report(spark, sf):
    own = corpus(spark, sf)
    text = W.report({"domains": own.groupBy("domain").agg(F.count("*").alias("n")), "labels": own.groupBy("label").agg(F.count("*").alias("n"))})
    got = spark.createDataFrame([(text,)], "v string").select(F.from_json("v", F.lit("struct<domains: array<struct<domain: string, n: bigint>>, labels: array<struct<label: int, n: bigint>>>")).alias("r"))
    return got.select(F.explode(F.array(F.struct(F.lit("domains").alias("part"), F.size("r.domains").cast("long").alias("n")), F.struct(F.lit("labels").alias("part"), F.size("r.labels").cast("long").alias("n")))).alias("e")).select("e.*")


@query("snk11_markdown", f"SELECT '| ' || domain || ' | ' || count(*) || ' | ' || printf('%.4f', avg(CAST(label AS DOUBLE))) || ' |' AS line FROM ({PREDS_SQL}) GROUP BY domain")
def markdown(spark, sf):
    text = W.markdown(preds(spark, sf).groupBy("domain").agg(F.count("*").alias("n"), F.avg("label").alias("share")))
    return spark.createDataFrame([(x,) for x in text.split("\n")[2:]], "line string")


@query("snk12_ids", f"SELECT CAST(id AS VARCHAR) AS value FROM ({CORPUS_SQL}) WHERE label = 1")
def ids(spark, sf):
    path = scratch(spark, "ids")
    W.ids(corpus(spark, sf).where("label = 1"), path, "id")
    return spark.read.text(path).select("value")
