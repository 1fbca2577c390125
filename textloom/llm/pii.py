"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the base patterns' spans and looser ones that the base leaves out. Labelers vote on each: patterns with their
checks, gazetteers (top-level domains, issuers, calling codes, reserved ranges) and the context on both sides. Counts of equal votes
over the corpus, a table bounded by the number of vote combinations, feed expectation-maximisation: it estimates each labeler's
reliability for a kind and each combination's probability. A logistic span classifier learns those probabilities from the votes and
from what no labeler sees, the span's shape and what it touches; it decides about looser
spans, and its weights become a column expression. Base spans always stay.

Positions come from the text between matches: `split` and `regexp_extract_all` walk the same matches, so a span starts where the
pieces and matches before it end. Positions count code points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, written

KINDS = ("email", "ip", "card", "phone")
# Anchors and possessive quantifiers leave the matches as they are: a match can begin only where a run of its
# first class begins, or where the match before ends; they keep long runs linear and off the stack.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z.+])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: What a text must hold for a pattern to be tried.
_HAS = {
    ("email", 0): lambda t: F.contains(t, F.lit("@")), ("ip", 0): lambda t: t.rlike(r"[0-9]\.[0-9]"), ("card", 0): lambda t: t.rlike(r"[0-9][ -]?[0-9]"), ("phone", 0): lambda t: F.contains(t, F.lit("+")),
    ("email", 1): lambda t: t.rlike(r"[\[(] ?(?:at|AT) ?[\])]"), ("ip", 1): lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), ("card", 1): lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), ("phone", 1): lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
}
# Gazetteers and context words.
_TLD = "com|org|net|edu|gov|int|info|io|co|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|pt|mx|ar|br|jp|cn|in|au"
_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38|30)"
_CALLING = r"^\+?(?:1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_RESERVED = r"^(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
_BEFORE = {
    "email": r"(?i)(?:e-?mail|mail|contact|correo|kontakt|courriel|write to|reach)",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|dirección|client|from|login)",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|carte|karte|tarjeta|payment|\bcc\b)",
    "phone": r"(?i)(?:phone|\btel|call|mobile|cell|fax|telefon|teléfono|téléphone|whatsapp|contact)",
}
_AGAINST = {
    "email": r"(?i)(?:git@|ssh|npm|pkg)",
    "ip": r"(?i)(?:version|\bv|release|build|section|§)\s*$",
    "card": r"(?i)(?:isbn|order|invoice|tracking|serial|token|hash|\bid|№|#)\W*$",
    "phone": r"(?i)(?:isbn|order|invoice|version|serial|\bid|№|#|\$|€)\W*$",
}
LABELERS = ("pattern", "check", "gazetteer", "before", "against")
#: What the classifier sees besides: whether the span is long, parted by signs, touched by a letter or sign before and after it.
SHAPES = ("long", "parted", "touched_before", "touched_after")
CONTEXT = 32
_LONG = {"email": 24, "ip": 14, "card": 17, "phone": 14}
_PARTED = {"email": r"[ \[(]", "ip": ":", "card": r"[ -]", "phone": r"[ .()-]"}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice")),
        lambda a, d: F.struct(
            (a["sum"] + F.when(a["twice"], (F.ascii(d) - 48) * 2 - F.when(d > "4", 9).otherwise(0)).otherwise(F.ascii(d) - 48)).alias("sum"),
            (~a["twice"]).alias("twice"),
        ),
        lambda a: a["sum"] % 10 == 0,
    )
    return F.when(F.length(digits) > 0, total).otherwise(False)


def _octets(m: Column) -> Column:
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    value = lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255
    return F.forall(F.split(m, r"\."), lambda p: part(p) & value(p))


def _valid(kind: str, m: Column) -> Column:
    """The base's conditions on a match."""
    n = F.length(_digits(m))
    return {"email": F.lit(True), "ip": _octets(m), "card": n.between(16, 19) & luhn(_digits(m)), "phone": n.between(8, 15)}[kind]


def _check(kind: str, m: Column) -> Column:
    """Whether a match, base or loose, is well formed for its kind."""
    if kind == "email":
        return m.rlike(r"[A-Za-z]")
    if kind == "ip":
        return ~m.rlike(_RESERVED)
    if kind == "card":
        return luhn(_digits(m))
    return F.length(_digits(m)).between(10, 15)


def _known(kind: str, m: Column) -> Column:
    """Whether a gazetteer knows the match."""
    if kind == "email":
        return m.rlike(rf"(?i)[.\])] ?(?:{_TLD})$")
    if kind == "ip":
        return F.contains(m, F.lit(".")) & ~m.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
    if kind == "card":
        return _digits(m).rlike(_ISSUER)
    return m.rlike(_CALLING) | m.rlike(r"^\(?[2-9]")


_SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int>>"


def _found(text: Column, number: int, kind: str, loose: bool) -> Column:
    """Spans of one pattern, with the labelers' votes as bits."""
    pattern = (_LOOSE if loose else _BASE)[kind]
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    walked = F.aggregate(
        F.arrays_zip(matches.alias("m"), pieces.alias("p"), F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 1)).alias("n")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,m:string,b:string,a:string>>").alias("out")),
        # the last piece has no match after it
        lambda a, x: F.when(x["m"].isNull(), a).otherwise(
            F.struct(
                (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["p"])).cast("int").alias("start"), x["m"].alias("m"), F.right(x["p"], F.lit(CONTEXT)).alias("b"), F.left(x["n"], F.lit(CONTEXT)).alias("a")))).alias("out"),
            )
        ),
        lambda a: a["out"],
    )
    bit = lambda c, k: F.when(F.coalesce(c, F.lit(False)), 1 << k).otherwise(0)

    def span(x: Column) -> Column:
        m, b, a = x["m"], x["b"], x["a"]
        votes = bit(F.lit(not loose), 0) + bit(_check(kind, m), 1) + bit(_known(kind, m), 2) + bit(b.rlike(_BEFORE[kind]) | a.rlike(_BEFORE[kind]), 3) + bit(b.rlike(_AGAINST[kind]), 4)
        votes = votes + bit(F.length(m) >= _LONG[kind], 5) + bit(m.rlike(_PARTED[kind]), 6) + bit(b.rlike(r"[^\s(\[\"']$"), 7) + bit(a.rlike(r"^[^\s.,;:!?)\]\"']"), 8)
        return F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(m)).cast("int").alias("end"), F.lit(not loose).alias("base"), votes.cast("int").alias("votes"))

    spans = walked if loose else F.filter(walked, lambda x: _valid(kind, x["m"]))
    return F.when(_HAS[kind, int(loose)](text), F.transform(spans, span)).otherwise(F.array().cast(_SPAN))


def candidates(docs: DataFrame, text: Column, into: str = "spans_") -> DataFrame:
    """docs with a column of candidate spans: base ones by kind and start, then loose ones that overlap none of them."""
    names = [f"{into}{k}_{loose}" for loose in (0, 1) for k in range(4)]
    docs = docs.withColumns({f"{into}{k}_{loose}": _found(text, k, kind, bool(loose)) for loose in (0, 1) for k, kind in enumerate(KINDS)})
    docs = docs.withColumns({f"{into}b": F.concat(*names[:4]), f"{into}l": F.concat(*names[4:])}).drop(*names)
    apart = lambda s: ~F.exists(f"{into}b", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return docs.withColumn(into, F.concat(f"{into}b", F.filter(f"{into}l", apart))).drop(f"{into}b", f"{into}l")


@dataclass
class Classifier:
    """For each kind, the weights of (1, votes..., shapes...) of the span classifier; reliabilities as EM estimates them: (if real, if not) for each labeler."""

    weights: dict[int, list[float]]
    reliabilities: dict[int, list[tuple[float, float]]] = field(default_factory=dict)

    def accepts(self, span: Column) -> Column:
        vote = lambda k: F.getbit(span["votes"], F.lit(k)).cast("double")
        out = F.lit(False)
        for kind, w in self.weights.items():
            score = F.lit(w[0])
            for k in range(len(LABELERS) + len(SHAPES)):
                score = score + F.lit(w[k + 1]) * vote(k)
            out = out | ((span["kind"] == kind) & (score >= 0))
        return span["base"] | out


def estimate(counts: list[tuple[int, int]], rounds: int = 100) -> tuple[dict[int, float], list[tuple[float, float]]]:
    """Of (votes, count): each combination's probability of being real, and the labelers' rates of voting given real and not.

    Independent labelers given the truth; starts from labelers that are right four times in five, with one pseudo-count at each cell.
    """
    n = len(LABELERS)
    rate = [(0.8, 0.2) if k < 4 else (0.2, 0.8) for k in range(n)]
    prior, real = 0.5, {}
    for _ in range(rounds):
        new = {}
        for votes, _c in counts:
            a, b = math.log(prior), math.log(1 - prior)
            for k in range(n):
                p, q = rate[k]
                a, b = (a + math.log(p), b + math.log(q)) if votes >> k & 1 else (a + math.log(1 - p), b + math.log(1 - q))
            new[votes] = 1 / (1 + math.exp(max(-700, min(700, b - a))))
        if real and max(abs(new[v] - real[v]) for v in new) < 1e-9:
            break
        real = new
        yes, no = sum(c * real[v] for v, c in counts), sum(c * (1 - real[v]) for v, c in counts)
        prior = (yes + 1) / (yes + no + 2)
        first = [(0.8, 0.2) if k < 4 else (0.2, 0.8) for k in range(n)]
        rate = [((sum(c * real[v] for v, c in counts if v >> k & 1) + 5 * first[k][0]) / (yes + 5), (sum(c * (1 - real[v]) for v, c in counts if v >> k & 1) + 5 * first[k][1]) / (no + 5)) for k in range(n)]
    return real, rate


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    n, m = len(b), [row[:] + [x] for row, x in zip(a, b, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(i + 1, n):
            f = m[r][i] / m[i][i]
            m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    out = [0.0] * n
    for i in range(n - 1, -1, -1):
        out[i] = (m[i][n] - sum(m[i][j] * out[j] for j in range(i + 1, n))) / m[i][i]
    return out


def classifier_of(counts: dict[int, list[tuple[int, int]]]) -> Classifier:
    """Trains on (votes and shapes, count) rows of each kind: EM on the votes, then logistic weights of both on its probabilities by Newton steps with a ridge."""
    weights, rates = {}, {}
    mask = (1 << len(LABELERS)) - 1
    for kind, rows in counts.items():
        voted: dict[int, int] = {}
        for bits, c in rows:
            voted[bits & mask] = voted.get(bits & mask, 0) + c
        real, rates[kind] = estimate(sorted(voted.items()))
        n = len(LABELERS) + len(SHAPES) + 1
        total = sum(c for _, c in rows)
        w = [0.0] * n
        for _ in range(30):
            g, h = [-1e-3 * x for x in w], [[1e-3 if i == j else 0.0 for j in range(n)] for i in range(n)]
            for votes, c in rows:
                x = [1.0] + [float(votes >> k & 1) for k in range(n - 1)]
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
                for i in range(n):
                    g[i] += c / total * (real[votes & mask] - p) * x[i]
                    for j in range(n):
                        h[i][j] += c / total * p * (1 - p) * x[i] * x[j]
            step = _solve(h, g)
            w = [a + b for a, b in zip(w, step, strict=True)]
            if max(map(abs, step)) < 1e-9:
                break
        weights[kind] = w
    return Classifier(weights, rates)


def fit(found: DataFrame, spans: str = "spans_") -> Classifier:
    """A classifier from a table of candidates: one row for each kind and combination of votes and shapes reaches the driver, at most 4 * 2 ** 9."""
    counted = found.select(F.explode(spans).alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(counted):
        counts.setdefault(r.kind, []).append((r.votes, r.n))
    return classifier_of(counts)


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row, from its whole text.

    The counts and the digest are of base spans; spans holds all that the classifier accepts, `kind:start:end` by kind and start.
    A null or empty text has none of either. Repeated rows and null ids are rows like others; no rows train and find nothing.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    found = written(candidates(rows, F.col("t")).drop("t"), "spans")
    accepts = fit(found).accepts
    base = F.filter("spans_", lambda s: s["base"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    out = found.withColumn("base", base).withColumn("all", F.array_sort(F.filter("spans_", accepts)))
    return out.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with every accepted span of its texts replaced by its kind in angle brackets; overlapping spans go as one.

    The classifier is trained on the candidates of all docs. `length`, where docs has that column, counts the new text. Null texts stay
    null; docs' other columns travel as one struct, whatever their names.
    """
    rows = docs.select(F.struct(*docs.columns).alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    votes = written(candidates(rows.select("t"), F.col("t")).select("spans_").where(F.size("spans_") > 0), "votes")
    accepts = fit(votes).accepts
    forget(votes)
    out = candidates(rows, F.col("t"))
    order = F.array_sort(F.transform(F.filter("spans_", accepts), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = out.withColumn("cut", order)
    name = lambda s: F.element_at(F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS)), s["kind"] + 1)
    new = F.aggregate(
        "cut",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, s["start"] - a["at"]), name(s)).alias("out"), s["end"].alias("at"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, F.length("t"))),
    )
    x = F.when(F.size("cut") > 0, new).otherwise(F.col("d").getField(text).cast("string"))
    out = out.withColumn("x", x)
    put = {text: F.col("x")} | ({length: F.when(F.size("cut") > 0, F.length("x").cast(docs.schema[length].dataType)).otherwise(F.col("d").getField(length))} if length in docs.columns else {})
    return out.select(*[put[c].alias(c) if c in put else F.col("d").getField(c).alias(c) for c in docs.columns])
