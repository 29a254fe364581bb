"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Each rule compares a signal of a document with a cutoff; a document is rejected if any is above it. The rules' cutoffs go down together, level by level.
How far is decided for each stratum on labelled holdouts: a level is certified if the good documents that it would reject are so few that,
were the true share of false rejections above the limit, that few would be seen with a probability (exact binomial tail) below the error
allowed. The error is shared out over the strata (Bonferroni); within a stratum levels are tried from lenient to strict up to the first
that isn't certified, a fixed sequence that needs no further correction, however many levels and rules there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written

#: Share of good documents of a stratum that all rules together may reject, and the probability that this fails in any stratum.
RISK, ERROR = 0.1, 0.05
#: Each rule's cutoff at the first level, and what it is multiplied by from one level to the next.
LEVELS = 40
RULES = {"symbol_share": (2.0, 0.85), "shout_share": (0.5, 0.92), "dup_line_share": (0.9, 0.93), "repeat_share": (0.9, 0.9)}
#: Cutoffs of each rule, from lenient to strict; documents above the cutoff are rejected.
CUTOFFS = {rule: [round(first * by**i, 6) for i in range(LEVELS)] for rule, (first, by) in RULES.items()}
SPACES = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def signals(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares that rules compare."""
    # Each array is bound once, as the variable of a lambda over a list of one.
    once = lambda value, f: F.transform(F.array(value), f)[0]
    zero = F.lit(0).cast("long")

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(g: Column) -> Column:
        # Sorted by hash, equal windows lie together; those with an equal neighbour repeat.
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(
            F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])), lambda x: x.isNotNull()
        )
        places = lambda at: F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))))
        return once(once(pairs, again), places).cast("long")

    def repeated(w: Column) -> Column:
        found = once(grams(w), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), zero).otherwise(covered(g)))
        return F.when(F.size(w) < 4, zero).otherwise(found)

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated(w).alias("n_repeat_words"))

    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    found = docs.withColumn("_w", once(words_of(F.col("text")), counts))
    found = found.select(
        "*",
        "_w.*",
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        once(lines, lambda x: F.size(x)).cast("long").alias("_lines"),
        F.char_length(F.regexp_replace(text, "[^\\p{Lu}!]+", "")).cast("long").alias("_shouts"),
    ).drop("_w")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return found.select(
        "*",
        share("n_symbols", "n_words").alias("symbol_share"),
        share("_shouts", "word_chars").alias("shout_share"),
        share("n_dup_lines", "_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    ).drop("_lines", "_shouts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(n: Column, x: Column, p: Column) -> Column:
    """The probability of ``x`` or fewer successes in ``n`` trials of chance ``p``: exact, summed in logarithms."""
    log_odds = F.log(p) - F.log(1 - p)
    first = n * F.log(1 - p)
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + log_odds
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    terms = F.when(x > 0, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<long>"))
    return F.exp(F.least(F.lit(0.0), F.aggregate(terms, start, add, lambda acc: acc["sum"])))


def passed_levels(grid: dict[str, list[float]]) -> Column:
    """How many levels a document passes: those at which none of its signals is above its cutoff."""

    def passed(rule: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in grid[rule]]), lambda c: c >= F.col(rule)))

    each = [passed(rule) for rule in grid]
    return F.least(*each) if len(each) > 1 else each[0]


def cutoffs(holdout: DataFrame, stratum: str, risk: float = RISK, error: float = ERROR, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """(stratum, level, n, rejected, p_value, cutoffs): the strictest certified level of each stratum, and the cutoff of each rule there.

    ``holdout`` has a row for each labelled document: the stratum, its signals, and ``good`` (boolean). ``grid`` has as many cutoffs for each rule, in
    falling order. A stratum without a certified level has no row, and its rules reject nothing.
    """
    grid = CUTOFFS if grid is None else grid
    levels = len(next(iter(grid.values())))
    good = holdout.where("good").groupBy(F.col(stratum).alias("stratum"), passed_levels(grid).alias("passed")).agg(F.count("*").alias("k"))
    sums = good.groupBy("stratum").agg(F.sum("k").alias("n"), *[F.sum(F.when(F.col("passed") <= i, F.col("k")).otherwise(0)).alias(f"r{i}") for i in range(levels)])
    strata = sums.agg(F.count("*")).scalar()
    tries = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"r{i}").alias("rejected")) for i in range(levels)])
    each = sums.select("stratum", "n", F.explode(tries).alias("t")).select("stratum", "n", "t.*", strata.alias("strata"))
    each = each.withColumn("p_value", tail(F.col("n"), F.col("rejected"), F.lit(risk)))
    first = F.min(F.when(F.col("p_value") > F.lit(error) / F.col("strata"), F.col("level"))).alias("stop")
    tried = F.collect_list(F.struct("level", "n", "rejected", "p_value")).alias("tried")  # a row for each level, so of fixed size
    stops = each.groupBy("stratum").agg(first, tried)
    best = stops.select("stratum", F.array_max(F.filter("tried", lambda t: F.col("stop").isNull() | (t["level"] < F.col("stop")))).alias("b")).where("b is not null")
    at = F.create_map(*[x for rule, values in grid.items() for x in (F.lit(rule), F.get(F.array(*[F.lit(float(c)) for c in values]), F.col("b.level")))])
    return best.select("stratum", "b.level", "b.n", "b.rejected", "b.p_value", at.alias("cutoffs"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, the counts, the rules' shares, ``base_failed`` and ``kept`` for each document.

    ``kept`` is false if the base rules fail, or a rule's share is above its cutoff at the level certified for the document's stratum.
    Good documents are those labelled quality 1 that pass the base rules. Null texts count as empty, a null stratum
    is a stratum, and a stratum without enough labelled good documents to certify a level has the base rules only.
    Documents labelled more than once count as good only if all their labels say so; repeated rows are judged each.
    """
    # Texts are read once; what follows reads the counts.
    marked = written(signals(docs.select("doc_id", "text", F.col(stratum).alias("stratum"))).drop("text").withColumn("base_failed", base_failed()), "signals")
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    holdout = marked.where("not base_failed").join(known.where("good"), "doc_id")
    certified = cutoffs(holdout, "stratum", risk, error).select(F.col("stratum").alias("_s"), "level")
    joined = marked.join(certified, F.col("stratum").eqNullSafe(F.col("_s")), "left").drop("_s")
    rejected = F.coalesce(passed_levels(CUTOFFS) <= F.col("level"), F.lit(False))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return joined.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), F.col("stratum"), *CUTOFFS)
