"""Quality rules as weak supervision; DataFrame operations only.

Each rule votes good (1), bad (0) or abstains (null). Expectation-maximisation over the counts of vote patterns (at
most 3 ** rules of them, whatever the corpus) estimates for either class how often each rule votes so or abstains,
and the share of good documents; a document's posterior is then a sum of log-odds. Rules look at evidence of
different kinds (symbols, repeats, word forms, sentences, digits, length), so that they agree on junk and err alone.
A rule between its two limits abstains; where good documents hardly ever make it abstain, that speaks against a
document too. The estimation starts from the majority vote. The priors weigh a hundredth of the documents judged,
so that rates of 0 cannot arise, and a corpus of any size with the same shares of patterns gets the same estimates.
A single bad vote of a rule that often fires on good documents (digits, length, repeats) so rejects nothing, and
a document without any bad vote can be rejected.

Edge cases: null or empty text has no words and fails the base rule; a rule without evidence abstains; a posterior
equal to the limit is kept; repeated rows get equal verdicts; a very long text is one row of arrays in one task; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .mixing import word_list

GRAM = 8
STOPS = ".!?"
#: Dirichlet priors of a rule's outcomes (bad, none, good) in good and in bad documents, and their weight in documents for each document judged.
PRIORS, WEIGHT = ((0.05, 0.15, 0.80), (0.40, 0.20, 0.40)), 0.01
#: What the majority vote starts from: the posterior of a document for which most rules vote good, and of others.
START = (0.9, 0.1)
OUTCOMES = (0, None, 1)


def _repeated_words(words: Column, n: Column, hashes: Column) -> Column:
    """Words covered by GRAM-word windows that occur twice or more, from the window hashes in order."""
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(q: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(q, i - 1)["h"]) | (x["h"] == F.get(q, i + 1)["h"])
        at = F.sort_array(F.transform(F.filter(F.transform(q, lambda x, i: F.struct(x["i"].alias("i"), F.coalesce(same(x, i), F.lit(False)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + GRAM).alias("end"), (a["n"] + p + GRAM - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    # the one-element array binds the sorted windows to a variable, so they are sorted once
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.transform(F.array(by_hash), covered)[0])


def measures(docs: DataFrame) -> DataFrame:
    """Counts per document, over its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = F.lit(" \t\n\x0b\x0c\r")
    split = docs.select("doc_id", text.alias("text"), word_list(text).alias("words"), F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, spaces)) > 0).alias("lines"))
    windows = F.when(F.size("words") >= GRAM, F.transform(F.sequence(F.lit(1), F.size("words") - GRAM + 1), lambda i: F.xxhash64(F.slice("words", i, GRAM))))
    windows = F.coalesce(windows, F.array().cast("array<bigint>"))
    hashed = split.select("*", windows.alias("hashes"))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return hashed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words"), F.size("words"), F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.substring(F.rtrim(x, spaces), -1, 1).isin(*STOPS))).cast("long").alias("n_ended_lines"),
        F.size(F.filter("words", lambda w: F.substring(w, -1, 1).isin(*STOPS))).cast("long").alias("n_stops"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        without("0123456789").cast("long").alias("n_digits"),
        F.aggregate("words", F.struct(F.lit("").alias("last"), F.lit(0).alias("n")), lambda a, w: F.struct(w.alias("last"), (a["n"] + (a["last"] == w).cast("int")).alias("n")), lambda a: a["n"]).cast("long").alias("n_stutters"),
    )


def votes() -> dict[str, Column]:
    """Rules by name: 1 good, 0 bad, null abstains."""
    n = F.col("n_words")

    def low(count: str, of: Column, good: float, bad: float, least: int = 1) -> Column:
        share = F.col(count) / of
        return F.when(of < least, None).when(share >= bad, 0).when(share <= good, 1)

    def high(count: str, of: Column, good: float, bad: float, most: int | None = None) -> Column:
        share = F.col(count) / of
        return F.when((of < 1) if most is None else (of < 1) | (of > most), None).when(share <= bad, 0).when(share >= good, 1)

    mean = F.col("word_chars") / n
    return {
        "symbols": low("n_symbols", n, 0.02, 0.5),
        "lines": low("n_dup_lines", F.col("n_lines"), 0.1, 0.5, least=4),
        "windows": low("n_repeat_words", n, 0.05, 0.2, least=GRAM),
        "stutters": low("n_stutters", n, 0.06, 0.2),
        "distinct": high("n_distinct", n, 0.5, 0.3, most=5000),  # longer texts have to repeat their words
        "word_length": F.when(n < 1, None).when((mean < 3) | (mean > 7.5), 0).when((mean >= 4.2) & (mean <= 6.6), 1),
        "ends": high("n_ended_lines", F.col("n_lines"), 0.97, 0.8),
        "sentences": high("n_stops", n, 0.03, 0.015),
        "digits": low("n_digits", F.col("word_chars"), 0.012, 0.036),
        "length": F.when(n < 30, 0).when(n >= 50, 1),
    }


def fit(patterns: list[tuple[tuple, int]], rounds: int = 100) -> tuple[float, list[list[list[float]]]]:
    """Share of good documents, and for each rule the rates of OUTCOMES in good and in bad ones, by EM over patterns."""
    rules, total = len(patterns[0][0]) if patterns else 0, sum(n for _, n in patterns)
    share, rates = 0.5, [[list(mean) for mean in PRIORS] for _ in range(rules)]
    posterior = [START[0] if 2 * (p.count(1) - p.count(0)) > rules else START[1] for p, _ in patterns]
    for _ in range(rounds if total else 0):
        share = min(0.999, max(0.001, sum(q * n for q, (_, n) in zip(posterior, patterns)) / total))
        for r in range(rules):
            for k, member in enumerate((posterior, [1 - q for q in posterior])):
                seen = [sum(q * n for q, (p, n) in zip(member, patterns) if p[r] == x) + WEIGHT * total * mean for x, mean in zip(OUTCOMES, PRIORS[k])]
                rates[r][k] = [x / sum(seen) for x in seen]
        posterior = [1 / (1 + math.exp(-max(-50.0, min(50.0, log_odds(p, share, rates))))) for p, _ in patterns]
    return share, rates


def log_odds(pattern: tuple, share: float, rates: list[list[list[float]]]) -> float:
    out = math.log(share / (1 - share))
    for v, (good, bad) in zip(pattern, rates):
        k = OUTCOMES.index(v)
        out += math.log(good[k] / bad[k])
    return out


def judge(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """Measures, votes, posterior, base_failed and kept per document."""
    measured = materialise(measures(docs), "measures")
    rules = votes()
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    voted = measured.select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in rules.items()])
    counted = voted.where(~base).groupBy(*[f"vote_{k}" for k in rules]).count().collect()  # at most 3 ** 10 rows
    share, rates = fit([(tuple(r)[:-1], r["count"]) for r in counted])
    logit = F.lit(math.log(share / (1 - share)))
    for k, (good, bad) in zip(rules, rates):
        worth = [math.log(g / b) for g, b in zip(good, bad)]
        logit = logit + F.when(F.col(f"vote_{k}") == 1, worth[2]).when(F.col(f"vote_{k}") == 0, worth[0]).otherwise(worth[1])
    out = voted.select("*", base.alias("base_failed"), (1 / (1 + F.exp(-logit))).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
