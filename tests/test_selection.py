"""Selections without SQL against plain Python."""

from textloom.plans import registry as R


def scan(rows):
    """What a pass in order of (id, text) keeps that skips every row whose id, pair or text a kept row has."""
    seen, kept = [set(), set(), set()], []
    for i, text in sorted(rows):
        keys = (i, i // 2, " ".join(text.lower().split()))
        if all(k not in s for k, s in zip(keys, seen, strict=True)):
            kept.append(i)
            for k, s in zip(keys, seen, strict=True):
                s.add(k)
    return kept


def test_greedy_dedup_has_id_pair_and_whole_text_as_keys(spark, tmp_path):
    head = "This text is under the licence of all its like; "
    rows = [(k, head + f"number {k % 7 if k % 3 else k}") for k in range(40)] + [(50, "Some  Text"), (53, "some text"), (52, "another"), (60, "twice"), (60, "twice"), (60, "twice or so")]
    spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(r.id for r in R.QUERIES["win02_greedy_dedup"](spark, str(tmp_path)).collect())
    # the twice of 60 are told apart by their digests there, by their texts here: one stays either way
    assert got == scan(rows)


def test_greedy_dedup_is_the_scan_of_the_table(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(r.id for r in R.QUERIES["win02_greedy_dedup"](spark, sf).collect()) == scan(rows)
