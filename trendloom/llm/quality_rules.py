"""Operator 9: quality rules as weak supervision, with DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0). Given the true quality, rules are taken as independent; each has
two accuracies, how often it votes against among the bad and among the good documents that it votes on, and abstaining
says nothing. Expectation-maximisation estimates them and the share of good documents from the votes alone. Nothing
bounds the estimates: a rule that fires on many documents which all other rules praise loses its weight, and a document
is then kept against its vote; a kind of junk is recognised because several rules see it. `START` only says which class
is the good one, and `PSEUDO` documents that vote as the start says keep estimates of small corpora away from 0 and 1.
It runs over counts of vote patterns (at most 3 to the number of rules, whatever the corpus holds), each round one
small aggregation of which the driver reads one row of sums. A document is kept if its posterior probability of being
good is at least 0.5, unless a base rule failed.

Defined cases: null and empty texts have no words and all counts 0; an empty table gives no rows; rows that repeat a
doc_id are judged each for itself; very long texts are read whole, in one row; extra columns are ignored. Documents
without any vote get the share of good documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import stash, words

WINDOW = 5
SPACE_CHAR = r"[\x20\x09-\x0D]"
ROUNDS, SETTLED = 40, 1e-4
#: Before the first round: share of good documents, and of votes against among good and among bad ones.
START = (0.85, 0.01, 0.4)
PSEUDO = 50.0


def features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the counts that the rules read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("words", words(F.col("text")))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    counted = base.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE_CHAR))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[^\p{L}\x20\x09-\x0D]")).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")).cast("long").alias("n_mark_words"),
        F.regexp_count("text", F.lit(r"[.!?…][\x20\x09-\x0D]*(\n|$)")).cast("long").alias("n_ended"),
        F.filter(F.split("text", "\n"), has_word).alias("lines"),
    )
    # Five-word windows as hashes; only texts where one repeats are sorted by hash to find the places.
    hashed = counted.withColumn("hashes", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))))
    placed = hashed.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    same = lambda x, i, step: F.coalesce(F.get("sorted", i + step)["h"] == x["h"], F.lit(False))
    found = placed.withColumn("places", F.sort_array(F.transform(F.filter("sorted", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["p"])))
    covered = F.aggregate(F.transform("places", lambda p, i: F.coalesce(F.least(F.lit(WINDOW), p - F.get("places", i - 1)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, n: a + n)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_upper", "n_marks", "n_mark_words", F.size("lines").cast("long").alias("n_lines"), "n_ended")


@dataclass(frozen=True)
class Rule:
    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0)


def rules() -> list[Rule]:
    n, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    repeated, symbols, twice, upper = F.col("n_repeat_words") / n, F.col("n_symbols") / n, F.col("n_dup_lines") / lines, F.col("n_upper") / chars
    mean, marks, bare = F.col("word_chars") / n, F.col("n_marks") / chars, F.col("n_mark_words") / n
    return [
        Rule("length", F.col("n_words") < 10, F.col("n_words") >= 50),
        Rule("repeated_windows", repeated > 0.2, (repeated < 0.05) & (F.col("n_words") >= 20)),
        Rule("symbols", symbols > 0.2, symbols < 0.05),
        Rule("repeated_lines", twice > 0.3, (twice < 0.05) & (F.col("n_lines") > 1)),
        Rule("word_length", (mean < 2) | (mean > 15), mean.between(3, 11)),
        Rule("capitals", upper > 0.5, upper < 0.2),
        Rule("letters", marks > 0.13, marks <= 0.07),
        Rule("words_without_letters", bare > 0.1, bare < 0.03),
        Rule("line_ends", (F.col("n_ended") / lines < 0.1) & (F.col("n_words") >= 50), F.col("n_ended") / lines > 0.5),
    ]


@dataclass(frozen=True)
class Accuracies:
    """The share of good documents, and each rule's share of votes against among good and among bad ones."""

    good: float
    alarm: tuple[float, ...]
    hit: tuple[float, ...]

    def posterior(self, votes: list[str]) -> Column:
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for v, a, h in zip(votes, self.alarm, self.hit):
            odds = odds + F.when(F.col(v) == -1, math.log(a / h)).when(F.col(v) == 1, math.log((1 - a) / (1 - h))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def moved(self, other: Accuracies) -> float:
        return max(abs(a - b) for a, b in zip((self.good, *self.alarm, *self.hit), (other.good, *other.alarm, *other.hit)))


def estimate(patterns: DataFrame, votes: list[str], rounds: int = ROUNDS, start: tuple[float, float, float] = START, pseudo: float = PSEUDO) -> Accuracies:
    """Expectation-maximisation over a written table of vote patterns and their `count`."""
    share, alarm, hit = start
    now = Accuracies(share, (alarm,) * len(votes), (hit,) * len(votes))
    n, p = F.col("count"), F.col("p")
    sums = [F.sum(n).alias("n"), F.sum(n * p).alias("good")]
    for i, v in enumerate(votes):
        for kind, weight in (("good", p), ("bad", 1 - p)):
            sums += [F.sum(n * weight * test.cast("int")).alias(f"{kind}{i}{name}") for name, test in (("against", F.col(v) == -1), ("votes", F.col(v) != 0))]
    for _ in range(rounds):
        row = patterns.withColumn("p", now.posterior(votes)).agg(*sums).first()
        if not row["n"]:
            break
        rate = lambda kind, i, weight, first: (row[f"{kind}{i}against"] + weight * first) / (row[f"{kind}{i}votes"] + weight)
        before, now = now, Accuracies(
            (row["good"] + pseudo * share) / (row["n"] + pseudo),
            tuple(rate("good", i, pseudo * share, alarm) for i in range(len(votes))),
            tuple(rate("bad", i, pseudo * (1 - share), hit) for i in range(len(votes))),
        )
        if now.moved(before) < SETTLED:
            break
    return now


def judge(table: DataFrame, chosen: list[Rule] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """A written table of features: adds base_failed, quality (the posterior) and kept."""
    chosen = chosen or rules()
    votes = [f"vote_{r.name}" for r in chosen]
    voted = table.select("*", *(r.vote().alias(v) for r, v in zip(chosen, votes)))
    patterns = stash(voted.groupBy(*votes).count().coalesce(1), "votes")
    quality = estimate(patterns, votes, rounds).posterior(votes)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.select("*", failed.alias("base_failed"), quality.alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stash(features(spark.read.parquet(f"{sf_dir}/documents.parquet")), "features")
    return judge(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
