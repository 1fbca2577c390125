"""Windows, lengths and training of the toxicity classifier against plain loops."""

import random

import numpy as np
import pytest

from textloom.llm import toxicity as T

SYLLABLES = "ri ver sto ne gar den win ter let ru qui et mor nin pa per dow tra vel mar ket".split()
RUDE = ["blorgish", "snarfle", "quaxter", "zorgle"]


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4)))


def document(r, rude):
    ws = [word(r) for _ in range(r.randrange(60, 200))]
    for _ in range(rude):
        ws.insert(r.randrange(len(ws)), r.choice(RUDE))
    return " ".join(ws)


def labelled(n, seed):
    r = random.Random(seed)
    y = [int(k % 4 == 0) for k in range(n)]
    return [document(r, 4 if c else 0) for c in y], y


@pytest.fixture(scope="module")
def model():
    return T.train(*labelled(400, 1))


def windows(text):
    """All distinct windows of a text, by a plain loop."""
    t, out = T.normalised(text), []
    while t:
        n = T.WINDOW if len(t) > T.WINDOW else len(t)
        while n < len(t) and n > 1 and t[n : n + 1] != b" ":
            n -= 1
        if n <= 1 < len(t) or n < len(t) and t[n : n + 1] != b" ":
            n = min(T.WINDOW, len(t))
        out.append(t[:n])
        t = t[n:]
    return list(dict.fromkeys(out))


TEXTS = ["", None, "!!!", "a", "Zwei Wörter: ÄÖ", "x" * 15, "x" * 16, "x " * 500, "Long words, " * 40 + "end", "日本語のテキスト " * 9]


def test_windows_are_those_of_a_plain_loop():
    w = T.Windows([T.normalised(t) for t in TEXTS])
    cut = w.cut(np.arange(len(w.owner)))
    for k, t in enumerate(TEXTS):
        assert [c for c, o in zip(cut, w.owner, strict=True) if o == k] == windows(t)
    assert w.count.tolist() == [len(windows(t)) for t in TEXTS]


def test_savings_are_those_of_a_plain_loop(model):
    s = T.Scorer(model)
    texts = labelled(12, 5)[0] + TEXTS
    w = T.Windows([T.normalised(t) for t in texts])
    plain = []
    for content in (model.base + model.ordinary, model.base + model.toxic):
        c = T.compressor(content)
        plain.append([len(c.compress(x)) for t in texts for x in windows(t)])
    assert s.savings(w).tolist() == (np.array(plain[0]) - plain[1]).tolist()


def test_features_are_those_of_a_plain_loop(model):
    texts, weights = labelled(6, 6)[0] + ["", "a"], np.array(model.weights)
    w = T.Windows([T.normalised(t) for t in texts])
    saved = T.Scorer(model).savings(w)
    got = T.features(w, saved, weights, np.array(model.tail))
    for k in range(len(texts)):
        own = [min(max(s, T.LEAST), T.MOST) for s, o in zip(saved.tolist(), w.owner.tolist(), strict=True) if o == k]
        total = sum(weights[s - T.LEAST] for s in own)
        n = max(1, len(own))
        likely = min(1, max(1, len(own)) * model.tail[max([T.LEAST, *own]) - T.LEAST])
        assert got[k] == pytest.approx([total / (n + (T.BIAS * n) ** 2) ** 0.5, -np.log(likely)])


def test_held_out_documents(model):
    texts, y = labelled(200, 2)
    got = T.Scorer(model).scores(texts) >= 0.5
    caught, wrong = sum(got[k] for k in range(200) if y[k]), sum(got[k] for k in range(200) if not y[k])
    assert caught >= 40 and wrong <= 6


def test_both_dictionaries_are_trained_on_text(model):
    assert all(r.encode()[:6] in model.toxic for r in RUDE) and not any(r.encode()[:6] in model.base + model.ordinary for r in RUDE)
    assert sum(s.encode() in model.base for s in SYLLABLES) == len(SYLLABLES)


def test_scores_do_not_depend_on_what_is_scored_together(model):
    texts = labelled(30, 7)[0] + TEXTS
    together = T.Scorer(model).scores(texts)
    assert together.tolist() == pytest.approx([T.Scorer(model).scores([t])[0] for t in texts], abs=1e-12)


def test_a_text_is_scored_whole(model):
    r = random.Random(8)
    long = " ".join(document(r, 0) for _ in range(2000))
    got = T.Scorer(model).scores([long, long + " " + " ".join(document(r, 40) for _ in range(200))])
    assert got[0] < 0.5 <= got[1]


def test_training_is_repeatable():
    texts, y = labelled(40, 9)
    assert T.train(texts, y) == T.train(texts, y)


@pytest.mark.parametrize("pairs", [[], [("a b", 1)], [("a b", 0), ("c d", 0)], [("a b", 0), ("c d", 1), ("e", 0)], [("", 1), (None, 1), ("a", 0), ("b", 0)]])
def test_one_class_scores_its_share(pairs):
    m = T.train([t for t, _ in pairs], [y for _, y in pairs])
    share = (sum(y for _, y in pairs) + 0.5) / (len(pairs) + 1)
    assert T.Scorer(m).scores(["a b", None, "zz" * 400]).tolist() == pytest.approx([share] * 3)


def test_training_in_tasks_is_the_training_in_one_place(spark):
    texts, y = labelled(60, 4)
    rows = [(k, t, c) for k, (t, c) in enumerate(zip(texts, y, strict=True))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    share = (sum(y) + 0.5) / (len(y) + 1)
    # fit takes each document once, in order of ids
    assert T.fit(docs, labels) == T.train(texts, y, share)
