"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far to trust each.

Only DataFrame functions: counts come from array functions inside each row, EM runs over the table of
distinct vote patterns (at most 3 ** number of rules rows, whatever the corpus' size).

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged
alike, each by itself; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import WORD_GAP, let, materialize

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _windows_hashed(h: Column) -> Column:
    """Hashes of all runs of eight items, by doubling: pairs, fours, eights."""

    def joined(shift: int):
        return lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - shift), F.slice(a, F.lit(1 + shift), F.size(a) - shift), lambda x, y: F.xxhash64(x, y))

    for shift in (1, 2, 4):
        h = let(h, joined(shift))
    return h


def _repeat_words(words: Column) -> Column:
    """Words covered by an eight-word window that the text holds twice or more, the first included.
    Windows of one text are equal if their 64-bit hashes are."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(
            ordered,
            lambda s: F.filter(
                F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"))
        return F.aggregate(F.sort_array(again), start, step, lambda a: a["n"])

    hashed = _windows_hashed(F.transform(words, lambda w: F.xxhash64(w)))
    found = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(found)


def counts(text: Column) -> Column:
    """A struct of the counts that the rules read; one pass of array functions a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    by_word = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    )
    by_line = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return F.struct(
        let(words, by_word).alias("w"),
        let(lines, by_line).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_marks"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
    )


def once(value: Column) -> Column:
    """The value as the one row of a generator, so that no later use of its fields computes it again."""
    return F.explode(F.array(value))


def flat_counts(struct: str) -> list[Column]:
    names = ["w.n_words", "w.word_chars", "w.n_distinct", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines", "n_symbols", "n_marks", "n_upper", "n_letters"]
    return [F.col(f"{struct}.{x}").alias(x.rpartition(".")[2]) for x in names]


@dataclass(frozen=True)
class Rule:
    """Votes -1 (bad) where bad holds, else 1 (good) where good holds, else 0 (abstains)."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CAST(CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END AS TINYINT)").alias(f"v_{self.name}")


#: Rules that look for junk abstain where they find none: their silence says little.
RULES = (
    Rule("length", "n_words < 20", "n_words >= 50"),
    Rule("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    Rule("variety", "10 * n_distinct < 2 * n_words", "10 * n_distinct >= 4 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words", "FALSE"),
    Rule("symbol_share", "20 * n_symbols > word_chars", "FALSE"),
    Rule("marks", "5 * n_marks > n_words", "FALSE"),
    Rule("capitals", "3 * n_upper > n_letters AND n_letters >= 20", "FALSE"),
    Rule("repeats", "100 * n_repeat_words > 15 * n_words", "FALSE"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "FALSE"),
)


@dataclass(frozen=True)
class Model:
    """Chance of a good text, and for each rule the chances of its votes -1, 0, 1 given bad and good."""

    share: float
    chances: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def posterior(self) -> Column:
        """Chance of good, from the array column votes. The numbers sit in one array literal, so that
        every round of EM runs the same compiled code."""
        gains = F.array(*[F.lit(math.log(g / b)) for bad, good in self.chances for b, g in zip(bad, good, strict=True)])
        prior = math.log(self.share / (1 - self.share))
        odds = F.aggregate(F.transform("votes", lambda v, i: F.get(gains, 3 * i + v + 1)), F.array(F.lit(prior))[0], lambda a, x: a + x)
        return 1 / (1 + F.exp(-odds))

    def accuracies(self) -> list[float]:
        """For each rule the chance that its vote is right, where it votes."""
        right = [(self.share * g[2] + (1 - self.share) * b[0], self.share * (g[0] + g[2]) + (1 - self.share) * (b[0] + b[2])) for b, g in self.chances]
        return [x / y for x, y in right]


#: Where EM starts, and prior counts worth this share of the corpus: a rule's bad vote is rare on good texts.
PRIOR_BAD, PRIOR_GOOD, PRIOR_WEIGHT = (0.25, 0.25, 0.50), (0.005, 0.245, 0.75), 0.02
#: A rule's bad votes on good texts stay below this, else EM explains a rule that no other one echoes as noise.
MAX_FALSE_ALARMS = 0.01


def votes_of(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[r.vote() for r in rules]).alias("votes")


def fit(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 12) -> Model:
    """EM over (votes, n): no row of documents is read. An empty table gives the model EM starts from."""
    model = Model(0.85, ((PRIOR_BAD, PRIOR_GOOD),) * len(rules))
    for _ in range(rounds):
        each = patterns.select("n", model.posterior().alias("p"), F.posexplode("votes").alias("rule", "vote"))
        rows = each.groupBy("rule", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad")).collect()
        if not rows:
            return model
        seen = {(r["rule"], r["vote"]): (r["bad"], r["good"]) for r in rows}
        good, bad = (sum(x[k] for (rule, _), x in seen.items() if rule == 0) for k in (1, 0))

        def chances(rule: int, side: int, prior, seen=seen, extra=PRIOR_WEIGHT * (good + bad)):
            n = [seen.get((rule, v), (0.0, 0.0))[side] + extra * q for v, q in zip((-1, 0, 1), prior, strict=True)]
            down, none, up = (x / sum(n) for x in n)
            least = min(down, MAX_FALSE_ALARMS) if side else down
            return least, none * (1 - least) / (none + up), up * (1 - least) / (none + up)

        model = Model(min(0.99, max(0.5, good / (good + bad))), tuple((chances(k, 0, PRIOR_BAD), chances(k, 1, PRIOR_GOOD)) for k in range(len(rules))))
    return model


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judged(counted: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Adds votes, base_failed, quality (posterior chance of being good) and kept to a table of counts."""
    voted = counted.select("*", votes_of(rules))
    model = fit(materialize(voted.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1), "vote-patterns"), rules)
    out = voted.select("*", failed().alias("base_failed"), F.round(model.posterior(), 6).alias("quality"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a row of docs: doc_id, counts, votes, base_failed, quality, kept. Texts are read once."""
    counted = docs.select(F.col("doc_id"), once(counts(F.col("text"))).alias("c")).select("doc_id", *flat_counts("c"))
    return judged(materialize(counted, "quality-counts"), rules)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that pass, with their own columns. Counts are made once: rows are written with their
    votes, and read again when the model is known, so that no text is shuffled to meet its verdict."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    voted = docs.select(whole, once(counts(F.col("text"))).alias("c")).select("__row", *flat_counts("c")).select("__row", "n_words", "n_repeat_words", votes_of(rules))
    voted = materialize(voted, "quality-votes", "zstd")
    model = fit(materialize(voted.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1), "vote-patterns"), rules)
    return voted.where(~failed() & (F.round(model.posterior(), 6) >= threshold)).select("__row.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    from terralith.llm.common import table

    out = score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
