"""Text quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule votes that a text is bad, that it is good, or abstains. Votes depend on a hidden class only, and how often a
rule votes which way in either class is estimated from all texts: the expectation step gives every pattern of votes
its probability of being good, the maximisation step re-estimates the rates from those probabilities. Spark counts the
texts by pattern first: one number for each of at most 2 or 3 to the number of rules patterns (24,576 here) whatever the
corpus, and the rounds run over those numbers. A text is kept if its posterior probability of being good reaches `least`, and the base rules did not fail it.

The start says what the votes mean: a text with a bad vote is bad with probability 0.9, one without with 0.1. Prior
counts keep rates off 0 and 1 and hold a rule to its meaning: for each class they add `PRIOR` texts and `PRIOR_SHARE`
of all, in which a bad vote is rare among good texts. A rule that never votes changes nothing.

Words are runs without ASCII white space. NULL is read as empty: no words, base_failed, not kept. An empty table
gives an empty table. Repeated rows count as often as they stand. Columns named like a result are replaced, others
pass through (`docs` may hold anything besides the text).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import UPPER, words, written

WINDOW = 8
ROUNDS = 30
PRIOR, PRIOR_SHARE = 20.0, 0.02
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_stops", "n_long", "n_symbol_runs", "n_marks", "n_stutters", "n_distinct", "n_bare"]


def _removed(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars."""
    return F.length(F.regexp_replace(text, "[^" + "".join(f"\\x{ord(c):02X}" for c in chars) + "]+", ""))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that rules look at."""
    base = docs.drop(*(c for c in COUNTS if c != text))
    t = F.col("__text")
    df = base.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("__words", words(t)).withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.size("__words")
    df = df.withColumn("__hashes", F.when(n >= WINDOW, F.transform("__words", lambda w: F.xxhash64(w))))
    df = df.withColumn("__windows", F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(WINDOW)) - WINDOW), lambda i: F.xxhash64(*(F.get("__hashes", i + k) for k in range(WINDOW)))))
    # windows in order of their hash, only where one is repeated
    again = (n >= WINDOW) & (F.size(F.array_distinct("__windows")) < F.size("__windows"))
    df = df.withColumn("__order", F.when(again, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (x["h"] == F.get("__order", i - 1)["h"]) | (x["h"] == F.get("__order", i + 1)["h"])
    df = df.withColumn("__starts", F.sort_array(F.transform(F.filter("__order", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("__starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", i + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    df = df.select(
        *(F.col(f"`{c}`") for c in base.columns),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        _removed(t, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        _removed(t, UPPER).cast("long").alias("n_upper"),
        _removed(t, "!").cast("long").alias("n_shouts"),
        _removed(t, ".?").cast("long").alias("n_stops"),
        F.size(F.filter("__words", lambda w: F.length(w) > 40)).cast("long").alias("n_long"),
        sum((F.length(t) - F.length(F.replace(t, F.lit(c * 3), F.lit(""))) for c in "#*$%&"), F.lit(0)).cast("long").alias("n_symbol_runs"),
        _removed(t, MARKS).cast("long").alias("n_marks"),
        F.size(F.filter("__words", lambda w, i: F.coalesce(w == F.get("__words", i - 1), F.lit(False)))).cast("long").alias("n_stutters"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct"),
        F.size(F.filter("__words", lambda w: (F.length(w) == 1) & w.isin(*"|-*#/\\>+=~_:;.,!?&%$"))).cast("long").alias("n_bare"),
    )
    return df


#: Name, bad vote, good vote (None: never). SQL conditions over the counts. Several look at one kind of fault from
#: different sides: only rules that meet in the same texts tell anything about each other.
RULES: list[tuple[str, str, str | None]] = [
    ("length", "n_words < 20", None),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)", None),
    ("symbols", "10 * n_symbols > n_words", None),
    ("symbol_runs", "50 * n_symbol_runs > n_words", None),
    ("bare_marks", "10 * n_bare > n_words", None),
    ("marks", "5 * n_marks > word_chars", None),
    ("lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines", None),
    ("repeats", "10 * n_repeat_words > 2 * n_words", None),
    ("stutter", "10 * n_stutters > n_words", None),
    ("vocabulary", "n_words BETWEEN 20 AND 2000 AND 10 * n_distinct < 3 * n_words", None),
    ("capitals", "10 * n_upper > 4 * word_chars", None),
    ("shouts", "5 * n_shouts > n_words", None),
    ("sentences", "n_words >= 60 AND 100 * n_stops < n_words", "n_words >= 20 AND 40 * n_stops >= n_words"),
    ("long_words", "20 * n_long > n_words", None),
]
BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


def voted(df: DataFrame, rules: list[tuple[str, str, str | None]] = RULES) -> DataFrame:
    """df with `votes`: for each rule a character, - bad, + good, 0 abstained."""
    each = [F.expr(f"CASE WHEN {bad} THEN '-' WHEN {good or 'false'} THEN '+' ELSE '0' END") for _, bad, good in rules]
    return df.withColumn("votes", F.concat(*each))


Rates = list[dict[str, tuple[float, float]]]
SIGNS = "-0+"


def _log_odds(prior: float) -> float:
    return math.log(prior / (1 - prior))


def posterior(prior: float, rates: Rates) -> Column:
    """Probability of being good, of a row with votes."""
    score = F.lit(_log_odds(prior))
    for r, rate in enumerate(rates):
        level, vote = F.lit(0.0), F.substring("votes", r + 1, 1)
        for sign, (good, bad) in rate.items():
            level = F.when(vote == sign, F.lit(math.log(good / bad))).otherwise(level)
        score = score + level
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def estimate(patterns: dict[str, int], n_rules: int, rounds: int = ROUNDS) -> tuple[float, Rates]:
    """Prior of good and, for each rule and vote, its rates among good and bad texts; patterns: texts by votes."""
    good = {v: 0.1 if "-" in v else 0.9 for v in patterns}
    weight = PRIOR + PRIOR_SHARE * sum(patterns.values())
    prior, rates = 0.9, []
    for _ in range(rounds):
        total = [0.0, 0.0]
        # of the prior's good texts 1 in 1000 has a bad vote, of its bad ones one in ten
        sums = [{s: [weight * q for q in start] for s, start in zip(SIGNS, ((0.001, 0.1), (0.5, 0.8), (0.499, 0.1)))} for _ in range(n_rules)]
        for votes, n in patterns.items():
            own = n * good[votes], n * (1 - good[votes])
            total = [a + b for a, b in zip(total, own)]
            for r, sign in enumerate(votes):
                cell = sums[r][sign]
                cell[0] += own[0]
                cell[1] += own[1]
        before, prior = prior, (total[0] + 1) / (total[0] + total[1] + 2)
        rates = [{s: (cell[s][0] / sum(c[0] for c in cell.values()), cell[s][1] / sum(c[1] for c in cell.values())) for s in SIGNS} for cell in sums]
        for votes in patterns:
            odds = _log_odds(prior) + sum(math.log(rates[r][s][0] / rates[r][s][1]) for r, s in enumerate(votes))
            good[votes] = 1 / (1 + math.exp(min(700, max(-700, -odds))))
        if abs(prior - before) < 1e-9:
            break
    return prior, rates


def judge(docs: DataFrame, text: str = "text", *, least: float = 0.5) -> DataFrame:
    """docs without the text, with the counts, votes, base_failed, quality (the posterior) and kept."""
    rest = docs.select(*(c for c in docs.columns if c == text or c not in {*COUNTS, "votes", "base_failed", "quality", "kept"}))
    # texts are read once; what follows reads the narrow table
    table = written(voted(counted(rest, text).drop(text)).withColumn("base_failed", F.expr(BASE_FAILED)))
    patterns = {r["votes"]: r["n"] for r in table.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    prior, rates = estimate(patterns, len(RULES))
    return table.withColumn("quality", posterior(prior, rates)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
