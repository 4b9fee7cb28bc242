"""Secrets in text: fixed forms, and strings that look drawn at random to character Markov models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import staged, text_of, words_of
from plotweave.llm.spans import apart_from, listed, named, spans_of

KINDS = ("assign", "access", "hex", "random")
#: Fixed forms. Possessive repeats and look-behinds only spare the search; they match the same text.
ASSIGN = r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Strings the models judge: this long at least, of characters keys are written in.
LONG_TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."


def _base(text: Column) -> Column:
    """Spans of the fixed forms with a ``kind`` number, by start, then kind."""
    assign = F.filter(spans_of(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    access = F.filter(spans_of(text, ACCESS), lambda x: F.length(x["m"]) >= 20)
    return F.sort_array(F.concat(_of_kind(assign, 0), _of_kind(access, 1), _of_kind(spans_of(text, HEX), 2)))


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e"), x["m"].alias("m")))


def _codes(token: Column) -> Column:
    """Characters as numbers, 0 for any outside the alphabet."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def labelled_strings(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``(token, random)``: values of fixed forms and digests in base 64 (1), ordinary identifiers and
    numbers of all documents, as written and in capitals (0).

    Different strings count once, so there are as many as the corpus has words of its own.
    """
    value = lambda x: F.when(x["kind"] == 0, F.regexp_extract(x["m"], ASSIGN, 2)).otherwise(x["m"])
    secrets = found.select(F.explode("_base").alias("x")).select(value(F.col("x")).alias("token")).distinct()
    words = docs.select(F.explode(words_of(F.col(text))).alias("token")).where(F.length("token") >= 4).distinct()
    ordinary = staged(words.where(F.rlike("token", F.lit(r"^(?:[A-Za-z]+(?:[_-][A-Za-z]+)*|[0-9]+)$"))), "ordinary")
    digests = ordinary.select(F.substring(F.base64(F.unhex(F.sha2("token", 256))), 1, 32).alias("token"))
    shouted = ordinary.select(F.upper("token").alias("token"))
    return staged(
        secrets.union(digests).select("token", F.lit(1).alias("random"))
        .union(ordinary.union(shouted).select("token", F.lit(0).alias("random"))), "strings")


def transition_scores(strings: DataFrame) -> list[float]:
    """Log-ratio of the two models' transition probabilities, for every pair of characters (row by row).

    Counts are made in Spark; what comes here has a row per pair and class, so it is bounded by the alphabet.
    """
    size = len(ALPHABET) + 1
    codes = strings.select("random", _codes(F.col("token")).alias("c")).where(F.size("c") > 1)
    pairs = codes.select("random", F.explode(F.transform(
        F.sequence(F.lit(2), F.size("c")), lambda i: F.element_at("c", i - 1) * size + F.element_at("c", i))).alias("pair"))
    seen = [[1.0] * (size * size) for _ in range(2)]
    for row in pairs.groupBy("random", "pair").count().collect():
        seen[row["random"]][row["pair"]] += row["count"]
    ratio = []
    for first in range(size):
        rows = [counts[first * size:(first + 1) * size] for counts in seen]
        totals = [sum(r) for r in rows]
        ratio += [math.log(rows[1][j] / totals[1]) - math.log(rows[0][j] / totals[0]) for j in range(size)]
    return ratio


def likelihood_ratio(token: Column, ratio: list[float]) -> Column:
    """Log-likelihood ratio of a string, random against ordinary; over 0 looks random."""
    table = F.array(*[F.lit(x) for x in ratio])
    size = len(ALPHABET) + 1
    return named(_codes(token), lambda c: F.aggregate(
        F.when(F.size(c) > 1, F.sequence(F.lit(2), F.size(c))).otherwise(F.array().cast("array<int>")), F.lit(0.0),
        lambda total, i: total + F.element_at(table, F.element_at(c, i - 1) * size + F.element_at(c, i) + 1)))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for every row: arrays of ``struct<s, kind, e, m>`` by start, then kind.

    ``base`` holds the fixed forms. ``spans`` adds strings that the character models call random: those of 16 and more key
    characters, apart from base spans, whose log-likelihood ratio is above zero and above all but
    one in a thousand of the ordinary strings the models were trained on.

    Null texts are empty: no spans. Null ids and repeated rows are kept as they are. With no text at all the models are even and
    add nothing. An empty table gives no rows. Other columns are ignored.
    """
    whole = text_of(F.col(text))
    found = staged(docs.select(
        F.col(doc_id).alias("doc_id"), _base(whole).alias("_base"), _of_kind(spans_of(whole, LONG_TOKEN), 3).alias("_long")), "secrets")
    strings = labelled_strings(found, docs, text)
    ratio = transition_scores(strings)
    ordinary = strings.where("random = 0").select(
        F.percentile_approx(likelihood_ratio(F.col("token"), ratio), F.lit(0.999)).alias("high")).first()["high"]
    least = max(0.0, ordinary or 0.0)
    added = F.filter("_long", lambda x: apart_from(x, F.col("_base")) & (likelihood_ratio(x["m"], ratio) > least))
    return found.select("doc_id", F.col("_base").alias("base"), F.sort_array(F.concat("_base", added)).alias("spans"))


def secrets_digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))
