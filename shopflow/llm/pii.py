"""Operator 2: personal data by candidate gradient boosting, with DataFrame functions only.

Base patterns find the plain forms. High-recall generators also propose looser spans, which may
overlap (obfuscated addresses, numbers without a country code, other separators). A candidate is normalised
first ('(at)' to '@', separators and call prefix stripped) and graded by the normal form's validity; the grade
and the nearest context cue label it, whether or not a base pattern finds it. Boosted trees score a candidate by
its normal form and context; they learn from all candidates of the corpus through a histogram of feature cells
(its size depends on the features, not on the corpus). Thresholds are calibrated per kind to ``PRECISION`` on
that label; selected candidates that touch no base span are added. Base spans always stay.

The label is a rule, not a human's judgement: ``PRECISION`` is measured against it.

Patterns are possessive so that very long texts are read in linear time; they match what the
plain patterns of the contract match.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.llm import boosting
from shopflow.llm.common import materialise
from shopflow.llm.decontam import bind

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.98
BASE = {
    # a start inside a run of local characters can only succeed where its first one does, or after a match
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a base pattern to be tried.
MAY = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
# A number that goes on after a separator is no candidate; a plain dot with a space after it ends the host.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[{](?i:at|@)[)\]}])\x20?[A-Za-z0-9-]{1,63}+(?:(?:(?:\.|\x20?[(\[{](?i:dot|\.)[)\]}]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+|(?:\x20\.\x20[A-Za-z0-9-]{1,63}+){1,8}+)",
    "ip": r"(?<![0-9.])(?<![0-9]\[\.\])(?<![0-9][(\[](?i:dot)[)\]])[0-9]{1,3}+(?:\x20?(?:\.|\[\.\]|[(\[](?i:dot)[)\]])\x20?[0-9]{1,3}+){3}(?!(?:\.|\[\.\]|[(\[](?i:dot)[)\]])?[0-9])",
    "card": r"(?<![0-9])(?<![0-9][._/-])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){2}[\x20._/-]?[0-9]{1,7}+(?![._/-]?[0-9])",
    "phone": r"(?<![0-9])(?<![0-9][./-])(?:\+|00)?(?:[0-9]{1,3}[\x20./-]{0,2})?\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{4}(?![./-]?[0-9])",
}
MAY_GENERATE = {"email": r"@|[(\[{](?i:at)[)\]}]", "ip": r"[0-9](?:\.|\[|\(|\x20)", "card": r"[0-9]{4}", "phone": r"[0-9]{3}[\x20./-][0-9]{4}"}
# Words (their beginnings) before a candidate that speak for its kind, and words that speak against it.
CONTEXT = {"email": "e?mail|contact|write|e-post|correo|adresse", "ip": "ip|host|server|addr|login", "card": "card|visa|carte|karte|tarjeta|credit",
           "phone": "phone|tel|call|mobil|fax|number"}
AGAINST = {"email": r"price\b", "ip": r"(?:version|ver|release|build|section|chapter|oid)s?\b", "card": r"(?:order|invoice|isbn|serial|sku|tracking|ref|reference)s?\b",
           "phone": r"(?:order|invoice|isbn|issn|serial|sku|part|item|tracking|ref|reference|version)s?\b"}
# Endings that an address is likely to have; other ones need a context cue.
ENDINGS = "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|tech|online|site|shop|store|cloud|blog|xyz|museum|example|test|local"
FEATURES = ["kind", "grade", "digits", "length", "before", "after", "context"]


def digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(acc, i):
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def _byte(part: Column) -> Column:
    p = F.regexp_replace(part, "^0+(?=.)", "")
    return F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False)


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(F.regexp_replace(match, r"[^0-9]+", "."), r"\."), _byte)
    if kind == "card":
        return bind(digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    return F.length(digits(match)).between(8, 15)


def spans(text: Column, pattern: str, may: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match, before, after), code points."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string,before:string,after:string>>)")

    def place(x):
        def add(acc, i):
            gap, hit = F.element_at(x["gaps"], i), F.element_at(x["hits"], i)
            start = acc["at"] + F.length(gap)
            return F.struct((start + F.length(hit)).alias("at"), F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("match"), F.right(gap, F.lit(24)).alias("before"),
                F.left(F.element_at(x["gaps"], i + 1), F.lit(1)).alias("after")))).alias("out"))
        return F.when(F.size(x["hits"]) > 0, F.aggregate(
            F.sequence(F.lit(1), F.size(x["hits"])), F.struct(F.lit(0).alias("at"), empty.alias("out")), add)["out"]).otherwise(empty)

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(F.regexp_like(text, F.lit(may)), bind(both, place)).otherwise(empty)


def _side(char: Column) -> Column:
    """0 nothing, 1 white space, 2 letter or digit, 3 other."""
    return (F.when(char == "", 0).when(F.regexp_like(char, F.lit(r"\s")), 1).when(F.regexp_like(char, F.lit(r"[\p{L}\p{N}]")), 2).otherwise(3))


def normal(kind: str, match: Column) -> Column:
    """The plain form of a candidate: what it says once its disguise and separators are off."""
    if kind == "email":
        at = F.regexp_replace(match, r"\x20?(?:[(\[{](?i:at|@)[)\]}]|@)\x20?", "@")
        return F.lower(F.regexp_replace(at, r"\x20?(?:[(\[{](?i:dot|\.)[)\]}]|\.)\x20?", "."))
    if kind == "ip":
        return F.regexp_replace(match, r"[^0-9]+", ".")
    return F.regexp_replace(digits(match), "^00", "") if kind == "phone" else digits(match)


def grade(kind: str, match: Column, plain: Column) -> Column:
    """0 the normal form is not valid, 1 valid but common by chance, 2 valid."""
    like = lambda col, pattern: F.regexp_like(col, F.lit(pattern))
    if kind in ("email", "ip"):
        apart = like(match, r"\x20[@.]|[@.]\x20")  # as in 'me @ noon . so' or '1. 2. 3. 4'
    if kind == "email":
        sound = like(plain, r"\A[^@]*[a-z0-9][^@]*@(?:[a-z0-9-]{1,63}\.)+[a-z]{2,24}\z")
        return F.when(~sound, 0).when(like(plain, rf"\.(?:{ENDINGS})\z") & ~apart, 2).otherwise(1)
    if kind == "ip":
        return F.when(~valid(kind, plain), 0).when(apart, 1).otherwise(2)
    if kind == "card":  # issuers' numbers begin with 3 to 6
        return F.when(~valid(kind, plain), 0).when(like(plain, r"\A[3-6]"), 2).otherwise(1)
    # with a call prefix any number; else the 3-3-4 plan, in which area and exchange begin with 2 to 9
    plan = like(plain, r"\A[0-9]{0,3}[2-9][0-9]{2}[2-9][0-9]{6}\z")
    shaped = like(plain, r"\A1?[0-9]{10}\z") & like(match, r"[().-]|\A1")
    return F.when(~valid(kind, plain), 0).when(like(match, r"\A(?:\+|00)"), 2).when(~plan, 0).when(shaped, 2).otherwise(1)


def cue(kind: str, before: Column) -> Column:
    """What the nearest cue before a candidate says: 0 against its kind, 1 nothing, 2 for it."""
    nearest = F.regexp_extract(F.lower(before), rf"(?s)\A.*\b({CONTEXT[kind]}|{AGAINST[kind]})", 1)
    return F.when(nearest == "", 1).when(F.regexp_like(nearest, F.lit(rf"\A(?:{AGAINST[kind]})\z")), 0).otherwise(2)


def _judged(kind: str, s: Column) -> Column:
    """(cell, label): small non-negative integers in the order of FEATURES, none of which tells a base form from a
    looser one, and 1 for a valid candidate that no cue speaks against or a less certain one that a cue speaks for."""
    def judge(x):
        n = F.length(digits(x["plain"]))
        inside = (x["before"] == 2) | (x["after"] == 2)  # a piece of a longer word or number
        g = F.when(inside, 0).otherwise(x["grade"])
        label = ((g == 2) & (x["cue"] >= 1)) | ((g == 1) & (x["cue"] == 2))
        cell = F.array(F.lit(KINDS.index(kind)), g, F.least(n, F.lit(20)), F.least(F.floor(F.length(x["plain"]) / 4).cast("int"), F.lit(10)),
                       x["before"], x["after"], x["cue"])
        return F.struct(cell.alias("cell"), label.cast("int").alias("label"))

    return bind(normal(kind, s["match"]), lambda plain: bind(F.struct(
        plain.alias("plain"), grade(kind, s["match"], plain).alias("grade"), cue(kind, s["before"]).alias("cue"),
        _side(F.right(s["before"], F.lit(1))).alias("before"), _side(s["after"]).alias("after")), judge))


def _overlaps(a: Column, others: Column) -> Column:
    return F.exists(others, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))


def _short(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"))


def find_candidates(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, base spans of each kind, and all candidates with feature cell and label."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def base(k):
        return F.transform(F.filter(spans(F.col("text"), BASE[k], MAY[k]), lambda s: valid(k, s["match"])), _short)

    def candidates(k):
        return F.transform(spans(F.col("text"), GENERATORS[k], MAY_GENERATE[k]), lambda s: bind(_judged(k, s), lambda j: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(k)).alias("k"), j["cell"].alias("cell"), j["label"].alias("label"))))

    d = d.withColumns({"base_" + k: base(k) for k in KINDS}).withColumns({"cand_" + k: candidates(k) for k in KINDS})
    return d.select("doc_id", *("base_" + k for k in KINDS), F.concat(*("cand_" + k for k in KINDS)).alias("candidates"))


def fit_selector(found: DataFrame) -> tuple[list, list[float]]:
    """Boosted trees and a threshold per kind from the cells of all candidates."""
    cells = (found.select(F.explode("candidates").alias("c")).groupBy("c.cell").agg(F.count(F.lit(1)).alias("n"), F.sum("c.label").alias("y"))
             .orderBy("cell").collect())  # one row a feature cell
    x = np.array([r["cell"] for r in cells], np.int64).reshape(-1, len(FEATURES))
    n, y = np.array([r["n"] for r in cells], float), np.array([r["y"] for r in cells], float)
    model = boosting.fit(x, n, y)
    score = boosting.predict(model, x)
    return model, [boosting.calibrate(score[x[:, 0] == k], n[x[:, 0] == k], y[x[:, 0] == k], PRECISION) for k in range(len(KINDS))]


def _joined(of_kind) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    def named(k):
        return F.transform(of_kind(k), lambda s: F.concat(F.lit(k + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return F.array_join(F.concat(*map(named, KINDS)), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row for each row: ``doc_id``, ``n_email``, ``n_ip``,
    ``n_card``, ``n_phone`` (base spans), ``base_sha256``, ``spans`` (base and added), ``n_added``.

    Null or empty texts have no spans and the digest of an empty string. Rows that repeat a doc_id
    count each. Of added spans that overlap, the first by start, then the longer stays. Other columns are
    ignored. An empty table gives no rows.
    """
    found = materialise(find_candidates(docs), "spans")
    model, thresholds = fit_selector(found)
    base = F.concat(*("base_" + k for k in KINDS))

    def wanted(c):
        score = boosting.as_column(model, [F.element_at(c["cell"], i + 1) for i in range(len(FEATURES))])
        limit = F.lit(float("inf"))
        for k, t in enumerate(thresholds):
            limit = F.when(c["k"] == k, F.lit(t)).otherwise(limit)
        return (score >= limit) & ~_overlaps(c, F.col("base"))

    chosen = F.array_sort(F.transform(F.filter("candidates", wanted), lambda c: F.struct(
        c["start"].alias("start"), (-c["end"]).alias("back"), c["end"].alias("end"), c["k"].alias("k"))))
    zero = F.expr("cast(array() as array<struct<start:int,back:int,end:int,k:int>>)")
    apart = F.aggregate("chosen", zero, lambda acc, c: F.when(
        (F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= c["start"]), F.concat(acc, F.array(c))).otherwise(acc))
    out = found.withColumn("base", base).withColumn("chosen", chosen).withColumn("added", F.when(F.size("chosen") > 0, apart).otherwise(zero))

    def merged(k):
        own = F.transform(F.filter("added", lambda c: c["k"] == KINDS.index(k)), _short)
        return F.array_sort(F.concat(F.col("base_" + k), own))

    return out.select("doc_id", *(F.size("base_" + k).cast("long").alias("n_" + k) for k in KINDS),
                      F.sha2(_joined(lambda k: F.col("base_" + k)), 256).alias("base_sha256"),
                      _joined(merged).alias("spans"), F.size("added").cast("long").alias("n_added"))
