"""Personal data by weak supervision (DataFrame functions only).

1. Candidate spans: four base kinds (e-mail, ip, card, phone) and three added ones (iban, ssn, phone_local).
2. Labelers vote 1, -1 or 0 (abstain) on each candidate: a strict regex, a gazetteer (top-level domains, issuer ranges,
   calling codes, ...), words of the context before it, its neighbouring characters, and a checksum (mod 97 of an iban; abstains on the other
   kinds, whose checks are part of the base pattern or do not exist).  A failed checksum is certain, so its probability is 0 whatever the others say.
3. Expectation-maximisation estimates each labeler's reliability and each kind's prior from the counts of
   vote patterns.  The table of patterns is bounded (kinds x 3**labelers x feature values), whatever the corpus holds; EM is a
   fold over it inside one row.
4. The posteriors train the final span classifier, a log-linear model over discrete features of span and context whose
   weights come from soft counts.  Candidates of an added kind with a probability of at least 0.5 become spans.

Base spans stay whatever the model says; they carry its probability as `score`.  Candidates are computed once and kept, without
the texts, in the shared folder.

Defined results: null text is empty; an empty table, or one without candidates, gives no added spans; an iban match that fails loses words at its end until it passes (capital words may follow an iban), and else stays whole; rows with repeated ids are
separate documents; failing base matches are dropped and not retried; columns named in `keep` pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import shared
from veilspark.llm.spans import after, before, joined, spans

# The base patterns.  Possessive quantifiers and look-behinds keep every one linear: a match can only start where a
# run of its first class starts, or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
CARD = r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){16})[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "phone_local")

# Fixed values of the labelers, by kind: a strict form, a gazetteer as a regex over the candidate, words that speak for it.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,250}[A-Za-z]$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{16,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{10,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "phone_local": r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}([-. ]))[2-9][0-9]{2}[-. ][0-9]{4}$",
}
GAZETTEER = {
    "email": r"\.(?i:com|org|net|edu|gov|info|io|co|eu|uk|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|us|ca|au|jp|example|test)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.|24[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6[05])",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "iban": r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
    "ssn": r"^(?!000|666|9)",
    "phone_local": r"^\(?[2-9][0-8][0-9]",
}
WORDS_FOR = {
    "email": r"mail|contact|write|courriel|correo|kontakt",
    "ip": r"\bip\b|host|server|address|login|from|adresse",
    "card": r"card|visa|pay|carte|karte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|reach|appel|ruf|llam",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security|tax",
    "phone_local": r"phone|call|tel|mobile|fax|reach|ring|text|contact",
}
WORDS_AGAINST = r"version|isbn|release|section|figure|order|invoice|serial|build"
N_LABELERS = 5
#: Index of the checksum in the votes.
CHECKSUM = 4
EM_ROUNDS = 25

_CAND = "struct<kind:string,start:int,end:int,text:string,votes:array<int>,feats:array<string>>"


def _chosen(kind: Column, table: dict[str, str], col: Column) -> Column:
    out = None
    for k, rx in table.items():
        out = F.when(kind == k, col.rlike(rx)) if out is None else out.when(kind == k, col.rlike(rx))
    return out


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, text>>: base matches that pass, and added candidates that overlap none of them."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    has = lambda c, rx: F.when(F.contains(text, F.lit(c)), spans(text, rx)).otherwise(F.array().cast("array<struct<start:int,end:int,m:string>>"))
    of = lambda kind, rows: F.transform(rows, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("text")))
    n = lambda x: F.length(digits(x["m"]))
    base = F.concat(
        of("email", has("@", EMAIL)),
        of("ip", F.filter(has(".", IP), lambda x: x["m"].rlike(IP_PARTS))),
        of("card", F.filter(spans(text, CARD), lambda x: n(x).between(16, 19) & F.call_function("luhn_check", digits(x["m"])))),
        of("phone", F.filter(has("+", PHONE), lambda x: n(x).between(8, 15))),
    )
    more = F.concat(of("iban", F.transform(spans(text, IBAN), _passing_part)), of("ssn", has("-", SSN)), of("phone_local", spans(text, LOCAL)))
    return F.struct(base.alias("base"), more.alias("more"))


def passes_97(iban: Column) -> Column:
    """The number that an account number's characters spell, country and check digits last, leaves 1 when divided by 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97) == 1


def _passing_part(x: Column) -> Column:
    """The span up to the last word with which it passes, of at least 15 characters; the whole span where there is none."""
    words = F.split(x["m"], " ")
    parts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    good = F.filter(parts, lambda p: (F.length(F.replace(p, F.lit(" "), F.lit(""))) >= 15) & passes_97(p))
    part = F.coalesce(F.get(good, F.size(good) - 1), x["m"])
    return F.struct(x["start"].alias("start"), (x["start"] + F.length(part)).alias("end"), part.alias("m"))


def labelled(text: Column, cand: Column) -> Column:
    """`cand` with the labelers' votes and the classifier's features."""

    def one(x: Column) -> Column:
        left, right = F.lower(before(text, x["start"], 40)), after(text, x["end"], 1)
        strict = F.when(_chosen(x["kind"], STRICT, x["text"]), 1).otherwise(-1)
        known = F.when(_chosen(x["kind"], GAZETTEER, x["text"]), 1).otherwise(-1)
        context = F.when(left.rlike(WORDS_AGAINST), -1).when(_chosen(x["kind"], WORDS_FOR, left), 1).otherwise(0)
        free = F.when(left.rlike(r"[\p{L}\p{N}_]$") | right.rlike(r"^[\p{L}\p{N}_]"), -1).otherwise(1)
        check = F.when(x["kind"] == "iban", F.when(passes_97(x["text"]), 1).otherwise(-1)).otherwise(0)
        size = x["end"] - x["start"]
        share = F.length(F.regexp_replace(x["text"], "[^0-9]", "")) / size
        feats = F.array(
            F.concat(F.lit("k:"), x["kind"]), F.concat(F.lit("n:"), F.least(F.floor(size / 6), F.lit(8)).cast("string")),
            F.concat(F.lit("d:"), F.floor(share * 4).cast("string")), F.concat(F.lit("w:"), context.cast("string")),
            F.concat(F.lit("b:"), F.when(left == "", "start").when(left.rlike(r"[:=#]\s*$"), "mark").when(left.rlike(r"\s$"), "space").otherwise("other")),
            F.concat(F.lit("s:"), x["kind"], strict.cast("string")), F.concat(F.lit("c:"), check.cast("string")),
        )
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.array(strict, known, context, free, check).alias("votes"), feats.alias("feats"))

    return F.transform(cand, one).cast(f"array<{_CAND}>")


def _posterior(p: Column, state: Column) -> Column:
    def side(rates: Column, prior: Column) -> Column:
        terms = F.zip_with(p["votes"], rates, lambda v, r: F.when(v > 0, F.log(r)).when(v < 0, F.log(1 - r)).otherwise(F.lit(0.0)))
        return F.aggregate(terms, F.log(prior), lambda a, b: a + b)

    prior = F.get(state["prior"], p["k"])
    return F.when(F.get(p["votes"], F.lit(CHECKSUM)) < 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(side(state["no"], 1 - prior) - side(state["yes"], prior))))


def _sum(rows: Column, value) -> Column:
    return F.aggregate(F.transform(rows, value), F.lit(0.0), lambda a, b: a + b)


def reliabilities(patterns: Column) -> Column:
    """EM over array<struct<k int, votes, n double>>: struct<prior by kind, yes, no: how often a labeler that votes says 1>."""
    start = F.struct(
        F.array(*[F.lit(0.5)] * len(KINDS)).alias("prior"), F.array(*[F.lit(0.7)] * N_LABELERS).alias("yes"), F.array(*[F.lit(0.3)] * N_LABELERS).alias("no")
    )

    def step(state: Column, _: Column) -> Column:
        rows = F.transform(patterns, lambda p: F.struct(p["k"].alias("k"), p["votes"].alias("votes"), p["n"].alias("n"), _posterior(p, state).alias("q")))

        def maximised(rows: Column) -> Column:
            def rate(yes: bool) -> Column:
                weight = lambda r: r["n"] * (r["q"] if yes else 1 - r["q"])
                of = lambda j: (_sum(rows, lambda r: F.when(F.get(r["votes"], j) > 0, weight(r)).otherwise(0.0)) + (2.0 if yes else 1.0)) / (
                    _sum(rows, lambda r: F.when(F.get(r["votes"], j) != 0, weight(r)).otherwise(0.0)) + 3.0
                )
                return F.array(*[of(F.lit(j)) for j in range(N_LABELERS)])

            prior = lambda k: (_sum(rows, lambda r: F.when(r["k"] == k, r["n"] * r["q"]).otherwise(0.0)) + 1.0) / (
                _sum(rows, lambda r: F.when(r["k"] == k, r["n"]).otherwise(0.0)) + 2.0
            )
            return F.struct(F.array(*[prior(k) for k in range(len(KINDS))]).alias("prior"), rate(True).alias("yes"), rate(False).alias("no"))

        # a one-element transform binds the expected rows once
        return F.get(F.transform(F.array(rows), maximised), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, step)


def train(cands: DataFrame) -> dict[str, float]:
    """Weights by feature, and `bias`, from candidates (kind, votes, feats).  One small aggregate reaches the driver."""
    kinds = F.array(*map(F.lit, KINDS))
    table = cands.groupBy("kind", "votes", "feats").agg(F.count(F.lit(1)).cast("double").alias("n"))
    table = table.withColumn("k", (F.array_position(kinds, F.col("kind")) - 1).cast("int"))
    one = table.groupBy("k", "votes").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("k", "votes", "n"))).alias("patterns"))
    state = one.select(reliabilities(F.col("patterns")).alias("state"))
    judged = table.join(F.broadcast(state)).withColumn("q", _posterior(F.struct("k", "votes"), F.col("state")))  # one row
    rows = judged.select(F.explode(F.concat("feats", F.array(F.lit("all")))).alias("f"), "n", "q").groupBy("f").agg(F.sum(F.col("n") * F.col("q")).alias("y"), F.sum(F.col("n") * (1 - F.col("q"))).alias("x"))
    counts = {r["f"]: (r["y"], r["x"]) for r in rows.collect()}
    if not counts:
        return {"bias": 0.0}
    from math import log

    yes, no = counts.pop("all")
    weights = {f: log((y + 1) / (yes + 2)) - log((x + 1) / (no + 2)) for f, (y, x) in counts.items()}
    return weights | {"bias": log((yes + 1) / (no + 1))}


def scored(cand: Column, weights: dict[str, float]) -> Column:
    """`cand` with the classifier's probability: the log-linear model whose weights `train` takes from soft counts, a naive Bayes; overlapping features count in full."""
    table = F.create_map(*[F.lit(x) for f, w in sorted(weights.items()) for x in (f, float(w))])
    get = lambda f: F.coalesce(F.try_element_at(table, f), F.lit(0.0))
    z = lambda x: F.aggregate(x["feats"], F.lit(float(weights["bias"])), lambda a, f: a + get(f))
    return F.transform(cand, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.when(F.get(x["votes"], F.lit(CHECKSUM)) < 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-z(x)))).alias("score")))


def pii_spans(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """`keep`, `base` and `added`: arrays of struct<kind, start, end, text, score>, by kind as listed, then start."""
    whole = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_pii_text")).withColumn("_pii_c", candidates(F.col("_pii_text")))
    clash = lambda x: F.exists(F.col("_pii_c")["base"], lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    whole = whole.withColumn("_pii_b", labelled(F.col("_pii_text"), F.col("_pii_c")["base"])).withColumn("_pii_m", labelled(F.col("_pii_text"), F.filter(F.col("_pii_c")["more"], lambda x: ~clash(x))))
    stored = shared.kept(whole.drop("_pii_text", "_pii_c"), "piicandidates")
    weights = train(stored.select(F.explode(F.concat("_pii_b", "_pii_m")).alias("c")).select("c.kind", "c.votes", "c.feats"))
    out = stored.withColumn("base", scored(F.col("_pii_b"), weights)).withColumn("_pii_s", scored(F.col("_pii_m"), weights))
    added = F.filter("_pii_s", lambda x: x["score"] >= least)
    # added kinds are scanned apart from each other: of two that overlap, the earlier kind stays
    order = F.array(*map(F.lit, KINDS))
    rank = lambda x: F.array_position(order, x["kind"])
    lone = F.filter(added, lambda x: ~F.exists(added, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]) & (rank(y) < rank(x))))
    return out.withColumn("added", lone).select(*[F.col(f"`{c}`") for c in keep], "base", "added")


def op3_pii_labelers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pii_spans(docs)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
