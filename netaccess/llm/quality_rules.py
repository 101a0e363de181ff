"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (2), bad (1) or abstains (0) on a document. Votes of the documents that pass the base rule are
counted by pattern over the whole corpus (at most 3^rules patterns, whatever its size), and these counts alone reach the
driver. The label model gives each rule a rate for each of its three outcomes in either class, so that abstaining is
evidence as well; expectation-maximisation on the counts estimates these rates and the share of good documents. It starts
once from "any bad vote is a bad sign" and once from each rule taken as the sign alone, and the likeliest end stays, of those
whose bad class earns at least ``LEAST_BAD_VOTES`` bad votes a document; if none does, the start is the model. Rules that vary
together within the classes share their weight: each counts by one over one plus its squared associations with the others.
A document is kept when its posterior probability of being good is at least ``KEEP_AT``. Labels are never read.

Null and empty texts have 0 words and fail the base rule. Long texts are counted whole. Each row is judged on its
own, so repeated rows get equal verdicts and a tie at the cut keeps both; an empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.runtime import materialize

KEEP_AT = 0.5
ROUNDS = 40
#: Where estimation starts: the share of good documents, and rates of (abstaining, bad, good) in the bad and the good class.
START_GOOD, START_RATES = 0.8, ((0.30, 0.40, 0.30), (0.25, 0.05, 0.70))
#: So many imagined documents of each class hold a rule that seldom speaks near its start.
IMAGINED = 1.0
#: What a document with the sign of a start is first taken to be good with, and one without it.
SIGNED, UNSIGNED = 0.05, 0.95
LEAST_BAD_VOTES = 1.0
#: Documents that an association of two rules needs to count by half.
FEW = 5.0
#: Word separators other than the space itself.
BLANKS = "\t\n\x0b\f\r"


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and words, the runs of characters other than ASCII white space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return narrow.withColumn("words", F.array_remove(F.split(F.translate("text", BLANKS, " " * len(BLANKS)), " "), ""))


def document_facts(docs: DataFrame) -> DataFrame:
    """The counts the rules look at, one narrow row for each document; no shuffle."""
    wide = with_words(docs)
    n = F.size("words")
    has_word = "x -> x rlike '[^ \\\\t-\\\\r]'"
    wide = wide.withColumns(
        {
            "n_words": n.cast("long"),
            "joined": F.array_join("words", ""),
            "lines": F.expr(f"filter(split(text, '\\n'), {has_word})"),
            "windows": F.when(n >= 3, F.expr("array_sort(transform(sequence(0, size(words) - 3), i -> struct(concat(words[i], ' ', words[i+1], ' ', words[i+2]) as w, i as i)))")),
        }
    )
    wide = wide.withColumn(
        "hits",
        F.expr("""filter(zip_with(slice(windows, 1, size(windows) - 1), slice(windows, 2, size(windows) - 1),
                  (a, b) -> if(a.w = b.w, array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2), null)), x -> x is not null)"""),
    )
    return wide.select(
        "doc_id",
        "n_words",
        F.char_length("joined").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(F.array_distinct(F.flatten("hits"))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]+")).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit(r"[.!?:;\"\u2026\u201d][ \t]*(?:\n|\z)")).cast("long").alias("n_ended_lines"),
        F.regexp_count("text", F.lit(r"[!?]{2}")).cast("long").alias("n_shouts"),
    )


def rule_votes() -> dict[str, Column]:
    """Rule name -> vote. Bad needs a clear sign, good a clear absence of it; between them a rule abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 1).when(good, 2).otherwise(0)

    symbols, marks, mean = F.col("n_symbols") / words, F.col("n_marks") / words, F.col("word_chars") / words
    repeats, upper = F.col("n_repeat_words") / words, F.col("n_upper") / chars
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    dups, ended, shouts = F.col("n_dup_lines") / lines, F.col("n_ended_lines") / lines, F.col("n_shouts") / words
    variety = F.col("n_distinct") / words
    return {
        "symbols": vote(symbols > 0.25, symbols < 0.02),
        "marks": vote(marks > 0.15, marks < 0.01),
        "word_length": vote((mean < 2.5) | (mean > 11), (mean > 3.5) & (mean < 8)),
        "repeats": vote(repeats > 0.4, repeats < 0.1),
        "upper": vote(upper > 0.35, upper < 0.1),
        "dup_lines": vote(dups > 0.3, dups < 0.05),
        "shouts": vote(shouts > 0.1, shouts < 0.005),
        "ended_lines": vote((ended < 0.2) & (F.col("n_lines") >= 3), ended > 0.8),
        "variety": vote((variety < 0.2) & (F.col("n_words") >= 100), variety > 0.4),
    }


def class_rates(votes: np.ndarray, counts: np.ndarray, good: np.ndarray) -> np.ndarray:
    """(class, rule, outcome) rates from counts split by P(good), held near the start by the imagined documents."""
    out = np.empty((2, votes.shape[1], 3))
    for k, weight in ((0, counts * (1 - good)), (1, counts * good)):
        for v in range(3):
            out[k, :, v] = (weight @ (votes == v) + IMAGINED * START_RATES[k][v]) / (weight.sum() + IMAGINED)
    return out


def shared_weights(votes: np.ndarray, counts: np.ndarray, good: np.ndarray) -> np.ndarray:
    """A weight for each rule: one over one plus the squared associations (Cramer's V) with the others inside the classes."""
    rules = votes.shape[1]
    total, v2 = counts.sum(), np.zeros((rules, rules))
    hot = np.stack([(votes == v).astype(float) for v in range(3)], axis=2)
    for weight in (counts * (1 - good), counts * good):
        n = weight.sum()
        if n < 1:
            continue
        single = np.einsum("p,prv->rv", weight, hot) / n
        both = np.einsum("p,prv,psw->rsvw", weight, hot, hot) / n
        expected = single[:, None, :, None] * single[None, :, None, :]
        chi = np.where(expected > 0, (both - expected) ** 2 / np.where(expected > 0, expected, 1), 0.0).sum((2, 3))
        kinds = (single > 0).sum(1)
        # documents off the usual outcome of both rules are what tells them apart; a few prove little
        off = 1 - hot[:, np.arange(rules), single.argmax(1)]
        seen = np.einsum("p,pr,ps->rs", weight, off, off)
        v2 += n / total * seen / (seen + FEW) * np.clip(chi / np.maximum(1, np.minimum(kinds[:, None], kinds[None, :]) - 1), 0, 1)
    np.fill_diagonal(v2, 0.0)
    return 1 / (1 + v2.sum(1))


def fit_votes(patterns: list[tuple], rules: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, tuple], dict[str, float]]:
    """The share of good documents; by rule the rates of votes 0, 1, 2 in the bad and the good class; and each rule's weight.

    ``patterns``: the votes of all rules and the number of documents with them.
    """
    start = np.array([[r] * len(rules) for r in START_RATES])
    best = (START_GOOD, start, np.ones(len(rules)))
    if patterns:
        table = np.array(patterns, float)
        votes, counts = table[:, :-1].astype(int), table[:, -1]
        at = np.arange(len(rules))
        signs = [(votes == 1).any(1), *(votes[:, r] == 1 for r in at)]
        most = -np.inf
        for sign in signs:
            if not sign.any() or sign.all():
                continue
            good, weights = np.where(sign, SIGNED, UNSIGNED), np.ones(len(rules))
            for turn in range(2 * rounds):
                if turn == rounds:  # associations are those that the classes leave, so they wait for classes
                    weights = shared_weights(votes, counts, good)
                rates = class_rates(votes, counts, good)
                share = min(1 - 1e-6, max(1e-6, float(counts @ good / counts.sum())))
                logs = np.log([[1 - share], [share]]) + np.stack([(np.log(rates[k])[at, votes] * weights).sum(1) for k in (0, 1)])
                good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
                if turn == rounds - 1:
                    likelihood = float(counts @ np.logaddexp(logs[0], logs[1]))
            bad = counts * (1 - good)
            if bad.sum() >= 1 and bad @ (votes == 1).sum(1) >= LEAST_BAD_VOTES * bad.sum() and likelihood > most:
                most, best = likelihood, (share, rates, weights)
    share, rates, weights = best
    return share, {r: tuple(tuple(map(float, rates[k, i])) for k in (0, 1)) for i, r in enumerate(rules)}, dict(zip(rules, map(float, weights)))


def posterior(share: float, rates: dict[str, tuple], weights: dict[str, float]) -> Column:
    """P(good | votes), rules taken as independent given the class but for their weights."""
    logit = F.lit(math.log(share / (1 - share)))
    for r, (bad, good) in rates.items():
        odds = [weights[r] * math.log(g / b) for b, g in zip(bad, good)]
        logit = logit + F.when(F.col(r) == 2, odds[2]).when(F.col(r) == 1, odds[1]).otherwise(odds[0])
    return 1 / (1 + F.exp(-logit))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row for each document: its counts, base_failed, p_good and kept."""
    votes = rule_votes()
    facts = materialize(document_facts(docs), "quality-facts").withColumns(votes)
    rules = list(votes)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    patterns = [tuple(r) for r in facts.filter(~failed).groupBy(*rules).agg(F.count("*").alias("n")).collect()]  # at most 3^rules
    p_good = posterior(*fit_votes(sorted(patterns), rules))
    return facts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), p_good.alias("p_good"), (~failed & (p_good >= KEEP_AT)).alias("kept"),
    )
