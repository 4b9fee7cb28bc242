"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a span classifier decides."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import staged, text_of
from plotweave.llm.spans import apart_from, listed, named, spans_of

KINDS = ("email", "ip", "card", "phone")
#: Fixed forms. Possessive repeats, look-behinds and least lengths only spare the search; they match the same text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider forms that are only proposed: written-out addresses, IPv6, shorter card numbers, national phone numbers.
PROPOSED = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
    r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
)
#: Gazetteers, by kind: endings of known domains, ranges that name no one, issuers, country codes.
GAZETTEER = (
    (r"(?i)(?:\.|dot\)|dot\])\x20?(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|at|ch|be|nl|pt)$", 1),
    (r"^(?:0|10|127|255|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.", -1),
    (r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)", 1),
    (r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])", 1),
)
#: Words before a span that speak for its kind.
CONTEXT = (
    r"(?i)mail|contact|write|schreib|écri|correo|kontakt",
    r"(?i)\bip\b|host|server|addr|adress|login|direcci",
    r"(?i)card|visa|credit|payment|karte|carte|tarjeta|cuenta|konto",
    r"(?i)phone|tel\b|tel\.|call|mobil|fax|anruf|appel|llam",
)
#: Words before a span that speak against personal data of any kind.
AGAINST = r"(?i)isbn|version|serial|order|invoice|sku|build|release|\bid\b"
LABELERS = 5
WIDTHS = (8, 4, 4, 8)
ROUNDS = 40


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    number = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0),
                        lambda t, i: t + F.when(i % 2 == 1, twice(number(i))).otherwise(number(i)))
    return total % 10 == 0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def octets_fit(match: Column) -> Column:
    """Every part of a dotted number is at most 255, whatever its leading zeros."""
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


def _fits(kind: int, match: Column) -> Column:
    if kind == 1:
        return octets_fit(match)
    if kind == 2:
        return named(digits_of(match), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == 3:
        return F.length(digits_of(match)).between(8, 15)
    return F.lit(True)


def _votes(kind: int, text: Column, span: Column) -> list[Column]:
    """Votes of the labelers on a span: 1 for, -1 against, 0 none."""
    m = span["m"]
    before = F.substring(text, F.greatest(span["s"] - 39, F.lit(1)), F.least(span["s"], F.lit(40)))
    after = F.substring(text, span["e"] + 1, F.lit(1))
    form = (
        F.rlike(m, F.lit(r"[A-Za-z]{2,}$")), ~F.rlike(m, F.lit(r"(?:^|\.)0[0-9]")),
        named(digits_of(m), lambda d: F.length(d).between(13, 19) & luhn(d)), F.length(digits_of(m)).between(10, 13),
    )[kind]
    pattern, sign = GAZETTEER[kind]
    joined = F.rlike(before, F.lit(r"[\p{L}0-9_]$")) | F.rlike(after, F.lit(r"^[\p{L}0-9_]"))
    return [
        F.when(form, 1).otherwise(-1),
        F.when(joined, -1).otherwise(0),
        F.when(F.rlike(m, F.lit(pattern)), sign).otherwise(-sign),
        F.when(F.rlike(before, F.lit(CONTEXT[kind])), 1).otherwise(0),
        F.when(F.rlike(before, F.lit(AGAINST)), -1).otherwise(0),
    ]


def _features(text: Column, span: Column) -> list[Column]:
    """What the classifier sees of a span: length, share of digits, separators, shape of the word before."""
    m = span["m"]
    signs = F.length(F.regexp_replace(m, "[A-Za-z0-9]", ""))
    last = F.regexp_extract(F.substring(text, F.greatest(span["s"] - 19, F.lit(1)), F.least(span["s"], F.lit(20))), r"(\S*)\s*$", 1)
    return [
        F.least(F.floor(F.length(m) / 6), F.lit(WIDTHS[0] - 1)),
        F.least(F.floor(4 * F.length(digits_of(m)) / F.length(m)), F.lit(WIDTHS[1] - 1)),
        F.least(signs, F.lit(WIDTHS[2] - 1)),
        F.when(F.length(last) == 0, 0).when(F.rlike(last, F.lit("[:=]$")), 1).when(F.rlike(last, F.lit("[0-9]")), 2)
        .when(F.rlike(last, F.lit(r"[.,;!?]$")), 3).when(F.rlike(last, F.lit(r"^\p{Lu}")), 4).when(F.length(last) < 4, 5).otherwise(6),
    ]


def _candidates(text: Column, kind: int) -> Column:
    """Base and proposed spans of a kind, with votes as one number and features."""
    base = F.filter(spans_of(text, (EMAIL, IP, CARD, PHONE)[kind]), lambda x: _fits(kind, x["m"]))

    def judged(spans: Column, is_base: bool) -> Column:
        def one(x: Column) -> Column:
            votes = sum((v + 1) * 3**i for i, v in enumerate(_votes(kind, text, x)))
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(is_base).alias("base"),
                            votes.cast("int").alias("votes"), F.array(*[f.cast("int") for f in _features(text, x)]).alias("f"))
        return F.transform(spans, one)

    wide = lambda b: F.filter(spans_of(text, PROPOSED[kind]), lambda x: apart_from(x, b))
    return named(base, lambda b: F.concat(judged(b, True), judged(wide(b), False)))


def estimated_reliabilities(counts: dict[int, float]) -> dict[int, float]:
    """Chance of personal data for every vote pattern of a kind, by expectation-maximisation (Dawid and Skene).

    Each labeler has, per class, probabilities of its three votes; votes are independent given the class.
    Starts from the majority. ``counts`` has at most 3^LABELERS entries.
    """
    votes = {p: [p // 3**i % 3 for i in range(LABELERS)] for p in counts}
    chance = {p: 1 / (1 + math.exp(-1.5 * sum(v - 1 for v in votes[p]))) for p in counts}
    for _ in range(ROUNDS):
        prior = (sum(counts[p] * chance[p] for p in counts) + 1) / (sum(counts.values()) + 2)
        table = [[[0.5] * 3 for _ in range(LABELERS)] for _ in range(2)]
        for p, n in counts.items():
            for i, v in enumerate(votes[p]):
                table[1][i][v] += n * chance[p]
                table[0][i][v] += n * (1 - chance[p])
        for p in counts:
            log = math.log(prior / (1 - prior))
            for i, v in enumerate(votes[p]):
                log += math.log(table[1][i][v] / sum(table[1][i])) - math.log(table[0][i][v] / sum(table[0][i]))
            chance[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, log))))
    return chance


def train(found: DataFrame) -> list[list[float]]:
    """Weights of the span classifier: a prior per kind, then per feature a weight for (kind, value).

    Naive Bayes over span features with the chances of EM as soft labels. Spark counts votes and features;
    the counts that come here are bounded by kinds x 3^LABELERS x feature values, whatever the corpus holds.
    """
    one = found.select(F.explode("_found").alias("x")).select("x.kind", "x.votes", F.posexplode("x.f").alias("feature", "value"))
    counts: dict = defaultdict(lambda: defaultdict(float))
    values: dict = defaultdict(float)
    for r in one.groupBy("kind", "votes", "feature", "value").count().collect():
        values[r["kind"], r["votes"], r["feature"], r["value"]] += r["count"]
        if r["feature"] == 0:
            counts[r["kind"]][r["votes"]] += r["count"]
    chance = {kind: estimated_reliabilities(dict(sorted(c.items()))) for kind, c in sorted(counts.items())}
    soft: dict = defaultdict(lambda: [0.5, 0.5])
    whole = [[0.5, 0.5] for _ in KINDS]
    for (kind, pattern, feature, value), n in sorted(values.items()):
        p = chance[kind][pattern]
        for c, share in enumerate((1 - p, p)):
            soft[feature, kind, value][c] += n * share
            if feature == 0:
                whole[kind][c] += n * share
    weights = [[math.log(w[1] / w[0]) for w in whole]]
    for feature, width in enumerate(WIDTHS):
        row = []
        for kind in range(len(KINDS)):
            totals = [whole[kind][c] + 0.5 * width for c in range(2)]
            row += [math.log(soft[feature, kind, v][1] / totals[1]) - math.log(soft[feature, kind, v][0] / totals[0]) for v in range(width)]
        weights.append(row)
    return weights


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for every row: arrays of ``struct<kind, s, e, base, votes, f>`` by kind, then start.

    ``base`` holds the fixed forms; ``spans`` adds proposed spans (:data:`PROPOSED`) that overlap no base span of their kind
    and that the trained classifier finds likelier personal than not.

    Null texts are empty: no spans. Null ids and repeated rows are kept as they are. Without any span nothing is
    learned or added. An empty table gives no rows. Other columns are ignored.
    """
    whole = text_of(F.col(text))
    found = staged(docs.select(
        F.col(doc_id).alias("doc_id"), F.concat(*[_candidates(whole, k) for k in range(len(KINDS))]).alias("_found")), "personal")
    prior, *weights = train(found)
    table = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    score = lambda x: table(prior, x["kind"]) + sum(
        table(w, x["kind"] * WIDTHS[i] + F.element_at(x["f"], i + 1)) for i, w in enumerate(weights))
    chosen = F.filter("_found", lambda x: x["base"] | (score(x) > 0))
    return found.select("doc_id", F.filter("_found", lambda x: x["base"]).alias("base"), F.sort_array(chosen).alias("spans"))


def personal_digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))
