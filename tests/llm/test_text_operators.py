"""Toxicity, personal data, page text, mixing, sharding and the pipeline."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import html, mixing, pii, sharding, toxicity

WORDS = ["the", "of", "and", "river", "stone", "garden", "winter", "letter", "quiet", "morning", "paper", "window", "travel", "market", "silver"]
RUDE = ["blorgish", "snarfle", "quaxter"]


def labelled(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        ws = [r.choice(WORDS) + r.choice(["", "ing", "s"]) for _ in range(r.randrange(10, 80))]
        y = k % 4 == 0
        for _ in range(3 if y else 0):
            ws.insert(r.randrange(len(ws)), r.choice(RUDE) + r.choice(["", "er"]))
        out.append((" ".join(ws), int(y)))
    return out


def test_toxicity_holds_out(spark):
    rows = [(k, t, y) for k, (t, y) in enumerate(labelled(400, 1))]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 5], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    right = sum(got[k].predicted == y for k, _, y in rows if k % 5 == 0)
    assert right >= 70 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    odd = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "x " * 40_000, "c"), (2, RUDE[0].upper() + "!! " + RUDE[1], "d")], "doc_id long, text string, score string")
    assert [r.predicted for r in toxicity.score(odd, model).orderBy("doc_id").collect()].count(1) == 1
    kept = toxicity.passed(odd, model)
    assert kept.columns == odd.columns and sorted(r.score for r in kept.collect()) == ["a", "b", "c"]
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_without_classes(spark):
    for pairs in ([], [("a b", 1)], [("a b", 0), ("c d", 0)]):
        m = toxicity.train([t for t, _ in pairs], [y for _, y in pairs])
        assert toxicity.Scorer(m).scores(["a", None])[0] == pytest.approx(toxicity.Scorer(m).scores(["zz"])[0])


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    luhn = lambda d: sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    r = random.Random(2)
    bits = ["1", "0", "4111", ".", ".", "@", "a", "b.c", "-", " ", "+", "+1", "(", ")", "é", "🙂", "256", "12.3.4.5", "\n", "x@y.z", "_", "%", "4111 1111 1111 1111", "me@site.com"]
    ts = [None, "", "1" * 20_000, "a" * 20_000, "1 " * 5000, "call +1 (226) 555-1404 190.1.2.3", "pay 4111111111111111 4111111111111111", *("".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(800))]
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("base", F.lit(0))
    for x in pii.personal_data(df).collect():
        want = base_spans(ts[x.doc_id] or "")
        assert x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), ts[x.doc_id]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(x.spans.split(",")) | ({""} if want else set()) or not want
    assert pii.personal_data(df.limit(0)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "🙂 me@site.com, 10.1.2.3 and +1 226 555 1404.", 0, "x"), (2, None, None, "y"), (3, "clean", 5, "z"), (3, "clean", 5, "z")], "doc_id long, text string, n_chars long, t string")
    got = [(r.text, r.n_chars, r.t) for r in pii.redacted(df).orderBy("doc_id").collect()]
    first = "🙂 <EMAIL>, <IP> and <PHONE>."
    assert got == [(first, len(first), "x"), (None, None, "y"), ("clean", 5, "z"), ("clean", 5, "z")]


def test_estimation_separates_labelers():
    # bits: pattern, check, gazetteer, before, against
    real, rate = pii.estimate([(0b01111, 500), (0b00111, 400), (0b10000, 300), (0b00000, 300)])
    assert real[0b01111] > 0.99 and real[0b10000] < 0.01 and rate[1][0] > 0.9 > 0.1 > rate[1][1]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p><b>One\n two<br><p>Three &lt;3</article><footer>f</footer>", "T & U\nOne two\nThree <3"),
        ("<article><header><h1>H</h1></header><p>A<aside>ad</aside><p>B<div class='ad-box'>x</div>C<form><input><p>q</form><section id=comments><p>no</section></article>", "H\nA\nB\nC"),
        ("<div class='site-header'>S</div><div class='has-sidebar'><article class='post'><div class='entry-header'><h1>T</h1></div><p>A</p></article></div><article class='comment'><p>C</p></article><div class='cookie-notice'>N</div>", "T\nA"),
        ("<article><p>x<script>var a='</p>';</script>y</p><style>p{}</style><!-- c --><p>z &#233;&nbsp;w", "xy\nz é w"),
        ("<div class=menu><a>one</a><a>two</a></div><div>" + "Long text of a page. " * 5 + "</div><div>Short.</div>", ("Long text of a page. " * 5).strip() + "\nShort."),
    ],
)
def test_page_text(page, want):
    assert html.main_text(page) == want


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<article>" + "<p>ä" * 5000, "y"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    got = html.extract(df).orderBy("n_chars").collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (1, 0), (None, 9999)]
    assert html.extract(df.limit(0)).count() == 0


def test_targets_share_out(spark):
    rows = [("a", 100, 1), ("b", 1000, 1), (None, 10, 1), ("Ä", 0, 1)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long, rows long")).collect()}
    sizes, weight = {"a": 100, "b": 1000, "Ä": 0, None: 10}, {"a": 3, "b": 1, "Ä": 2, None: 3}
    want, left, open_ = {}, 1.5 * 1110, dict(weight)
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            del open_[s]
    assert got == pytest.approx(want | share)


def test_split_quotas(spark):
    quotas = [1000, 0, 37, 1, 5000]
    got = mixing.split_quotas(spark.createDataFrame(list(enumerate(quotas)), "rank int, quota long"), 4).collect()
    assert [sum(r.quota for r in got if r.rank == k) for k in range(5)] == quotas
    sizes = [sum(r.quota for r in got if r.shard == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 4
    big = [r.quota for r in got if r.rank == 4]
    assert len(set(big)) > 1 and max(abs(q - 312.5) for q in big) < 60


def test_mixture(spark):
    r = random.Random(6)
    rows = [(k, " ".join(r.choice(WORDS) for _ in range(r.choice([1, 30, 400]))), r.choice(["a", "b", "c", None])) for k in range(300)] + [(7, None, "a"), (8, "", None), (9, " same\ttext  here", "a"), (9, " same\ttext  here", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text")).withColumn("rank", F.lit("clash")).repartition(5)
    got = mixing.taken_words(mixing.mix(df, shard_words=3000)).collect()
    assert len(got) == len(rows) and all(0 <= x.taken <= 2 * x["size"] for x in got)
    again = mixing.taken_words(mixing.mix(df.repartition(3), shard_words=3000)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    for s in ("a", "b", "c", None):
        own = [x for x in got if x.source == s]
        assert own[0].source_size == sum(x["size"] for x in own)
        assert abs(sum(x.taken for x in own) - own[0].target) <= 2 * max(1, own[0].source_size / 256) + 2
    spans = mixing.mix(df, shard_words=3000).spans
    assert spans.groupBy("rank", "block", "pass").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    mixed = mixing.mixed_documents(df, shard_words=3000)
    assert mixed.columns == df.columns
    texts = {}
    for d, t, s in rows:
        texts.setdefault((d, s), set()).add(t)
    total = 0
    for x in mixed.collect():
        assert x.n_chars == len(x.text) and any(x.text in (t or "") or set(x.text.split()) <= set((t or "").split()) for t in texts[x.doc_id, x.source])
        total += len(x.text.split())
    assert total == sum(x.taken for x in got)
    empty = df.limit(0)
    assert mixing.taken_words(mixing.mix(empty)).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [(k, None if k % 7 == 0 else "t" * k) for k in range(200)] + [(3, "ttt"), (None, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(8)
    store = sharding.Store(spark, root, target_bytes=64 << 10)
    assert store.read().count() == 0
    for _ in range(3):
        store.append(df)
    before = len(store.manifest()[1])
    version = store.compact()
    shards = store.manifest()[1]
    assert len(shards) < before and version > 3 and sum(s.rows for s in shards) == 3 * len(rows)
    assert sorted(map(repr, store.read().collect())) == sorted(repr(r) for r in df.collect() for _ in range(3))
    with pytest.raises(sharding.Conflict):
        store.commit(version - 1, [], [], "{}")
    assert store.manifest()[0] == version
    assert sharding.compacted(df, "id", root=f"file://{tmp_path}/other").count() == len(rows)
    assert sharding.compacted(df.limit(0), "id", root=f"file://{tmp_path}/none").columns == ["id", "text"]


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = P.table(spark, sf, "documents")
    columns = docs.columns
    seen = []
    for name, stage in P.STAGES:
        out = P.written(stage(spark, docs, sf), "test")
        seen.append((name, docs.count(), out.count()))
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    n = dict((name, (a, b)) for name, a, b in seen)
    assert n["toxicity"][0] * 0.7 < n["toxicity"][1] < n["toxicity"][0] and n["minhash_near_dedup"][1] < n["minhash_near_dedup"][0]
    assert n["personal_data"][0] == n["personal_data"][1] and n["sentencepiece"][0] == n["sentencepiece"][1] > 0


def test_pipeline_stages_take_odd_rows(spark, sf):
    import corpus_pipeline as P

    t = "the same seven words of one document"
    rows = [(1, t, "en", "a", 10), (1, t, "en", "a", 10), (2, t, "en", None, None), (None, None, None, None, None), (4, "", "en", "b", 0), (5, "call me@site.com now or never again", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        for x in (docs, docs.limit(0)):
            out = P.written(stage(spark, x, sf), "odd")
            assert out.count() <= 2 * x.count()
            if name != "sentencepiece":
                assert out.columns == docs.columns
    kept = [r.doc_id for r in P.drop_near_duplicates(spark, docs, sf).collect()]
    assert sorted(kept, key=str) == [1, 4, 5, None]


def test_near_duplicates_stage_loses_no_text(spark, sf):
    import corpus_pipeline as P

    a, b = "one two three four five six seven eight", "entirely other words stand in this second text here"
    rows = [(1, a, {"k": "x"}), (1, b, {"k": "y"}), (1, b, {"k": "x"}), (2, a, {"k": "z"}), (3, None, None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,string>").withColumns({"n_chars": F.length("text"), "source": F.lit("s"), "lang": F.lit("en")})
    got = sorted((r.doc_id, r.text or "", (r.extra or {}).get("k")) for r in P.drop_near_duplicates(spark, docs, sf).collect())
    assert got == [(1, b, "x"), (1, a, "x"), (3, "", None)]


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    """run() over a small folder against a plain recomputation of every stage."""
    import hashlib as H

    import corpus_pipeline as P
    import sentencepiece

    from textloom.llm import pieces

    r = random.Random(11)
    syllables = "ri ver sto ne gar den win ter let ru qui et mor nin pa per dow tra vel mar ket".split()
    make = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(60))
    texts = [make() for _ in range(60)]
    texts[10], texts[11] = texts[3], texts[4] + " more"
    texts[20] += " write me@site.com or call +1 226 555 1404 now"
    docs = spark.createDataFrame([(k, t, "en", "ab"[k % 2], len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"file://{tmp_path}/sf"
    docs.write.parquet(f"{folder}/documents.parquet")
    # one class of labels: every text scores its smoothed share, and none is rejected
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = [shingles(t) for t in texts]
    kept = [k for k in range(60) if not any(100 * len(sets[j] & sets[k]) >= 80 * len(sets[j] | sets[k]) for j in range(k))]
    clean = {k: texts[k].replace("me@site.com", "<EMAIL>").replace("+1 226 555 1404", "<PHONE>") for k in kept}
    assert len(kept) == 58
    got = P.run(spark, folder).collect()
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    mixed = mixing.mixed_documents(spark.createDataFrame([(k, t, "ab"[k % 2], len(t)) for k, t in clean.items()], "doc_id long, text string, source string, n_chars long"))
    want = []
    for x in mixed.collect():
        assert set(x.text.split()) <= set(clean[x.doc_id].split())
        ids = own.encode(x.text, add_bos=True, add_eos=True)
        want.append((x.doc_id, len(ids), H.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), H.sha256(own.decode(ids).encode()).hexdigest()))
    assert sorted((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == sorted(want)
    sizes = {s: sum(len(t.split()) for k, t in clean.items() if "ab"[k % 2] == s) for s in "ab"}
    taken = {s: sum(len(x.text.split()) for x in mixed.collect() if x.source == s) for s in "ab"}
    # weights 3 and 1 share 1.5 of all words; the first stops at twice its size
    a = min(2 * sizes["a"], 1.5 * sum(sizes.values()) * 3 / 4)
    assert abs(taken["a"] - a) <= 2 + sizes["a"] / 128 and abs(taken["b"] - min(2 * sizes["b"], 1.5 * sum(sizes.values()) - a)) <= 2 + sizes["b"] / 128
