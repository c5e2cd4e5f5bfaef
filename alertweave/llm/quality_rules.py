"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose measure lies above a cutoff. Cutoffs are chosen from fixed
grids, from lax to strict, on all labelled documents: per stratum and rule, a level is certified if
the exact binomial test refutes "at least ``risk / rules`` of the good documents are rejected" at
``error`` divided by the number of strata and rules (Bonferroni), level after level until the first
one that is not refuted (fixed-sequence testing, so further levels cost no error). So with
probability ``1 - error`` no stratum loses more than ``risk`` of its good documents to all rules
together. Of the certified levels, the one is taken that rejects most labelled bad documents after
``clean_weight`` for each good one; a rule or stratum that cannot be certified rejects nothing.

Only DataFrame operations are used, and a text is measured inside its row.

A null text has no words, and all its counts are 0. A null language is the stratum ``und``.
Of several labels of a document
the lowest counts; null labels are left out. Repeated rows are judged alike. Empty tables give an empty result or
rules that reject nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions.expressions import keep_rows, let
from alertweave.llm.shared import BLANKS, stored, word_count
from alertweave.session import cut_lineage

RISK = 0.05
ERROR = 0.05
CLEAN_WEIGHT = 10
LEVELS = 24
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
WINDOW = 3
# laxest and strictest cutoff of each rule
RULES = {
    "symbol_share": (1.0, 0.02),
    "capital_share": (0.9, 0.1),
    "mark_share": (0.9, 0.05),
    "duplicate_line_share": (0.9, 0.05),
    "repeated_word_share": (0.5, 0.05),
    "digit_share": (0.9, 0.05),
    "mean_word": (40.0, 8.0),
}


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a window of ``WINDOW`` words found twice or more."""

    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        at = lambda j: F.get(sorted_windows, j)
        again = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda j: F.coalesce(at(j - 1)["said"] == at(j)["said"], F.lit(False))
            | F.coalesce(at(j + 1)["said"] == at(j)["said"], F.lit(False)),
        )
        return let(
            F.sort_array(F.transform(again, lambda j: at(j)["start"])),
            lambda starts: F.aggregate(
                F.transform(
                    starts,
                    lambda start, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - start, F.lit(WINDOW))),
                ),
                F.lit(0),
                lambda total, more: total + more,
            ),
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.struct(
            F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("said"), i.alias("start")
        ),
    )
    return F.when(F.size(words) >= WINDOW, let(F.sort_array(windows), covered)).otherwise(F.lit(0)).cast("long")


def measured(documents: DataFrame, *carried: Column) -> DataFrame:
    """The carried columns with the base counts and the measure of each rule."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = let(
        F.filter(F.split(text, r"\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        lambda lines: F.struct(F.size(lines).alias("n_lines"), F.size(F.array_distinct(lines)).alias("n_distinct")),
    )
    counted = documents.select(
        *carried,
        word_count(F.col("text")).alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        with_words.alias("lines"),
        let(F.split(F.btrim(text, F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+"), repeated_words).alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("capitals"),
        F.regexp_count(text, F.lit(r"\p{Punct}")).alias("marks"),
        F.regexp_count(text, F.lit(r"[0-9]")).alias("digits"),
    )
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    n_dup_lines = (F.col("lines.n_lines") - F.col("lines.n_distinct")).cast("long")
    measures = {
        "symbol_share": F.col("n_symbols") / words,
        "capital_share": F.col("capitals") / chars,
        "mark_share": F.col("marks") / chars,
        "duplicate_line_share": n_dup_lines / F.greatest(F.col("lines.n_lines"), F.lit(1)),
        "repeated_word_share": F.col("n_repeat_words") / words,
        "digit_share": F.col("digits") / chars,
        "mean_word": F.col("word_chars") / words,
    }
    return counted.select(
        *counted.columns[: len(carried)],
        "n_words",
        "word_chars",
        "n_symbols",
        n_dup_lines.alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias(
            "base_failed"
        ),
        F.array(*[measures[rule].cast("double") for rule in RULES]).alias("measures"),
    )


def grid(rule: str) -> list[float]:
    lax, strict = RULES[rule]
    return [lax * (strict / lax) ** (level / (LEVELS - 1)) for level in range(LEVELS)]


def tail_probability(rejected: Column, good: Column, risk: float) -> Column:
    """P(at most ``rejected`` of ``good`` rejected) if each is with probability ``risk``, exactly,
    summed in logarithms; 1 where the count is not even below its mean."""
    odds = F.log(F.lit(risk / (1 - risk)))
    first = good * F.log(F.lit(1 - risk))
    total = F.aggregate(
        F.when(rejected > 0, F.sequence(F.lit(1).cast("long"), rejected)).otherwise(F.array().cast("array<long>")),
        F.struct(first.alias("term"), F.exp(first).alias("total")),
        lambda state, j: let(
            state["term"] + F.log((good - j + 1) / j) + odds,
            lambda term: F.struct(term.alias("term"), (state["total"] + F.exp(term)).alias("total")),
        ),
        lambda state: state["total"],
    )
    return F.when(rejected >= good * risk, F.lit(1.0)).otherwise(total)


def cutoffs(
    labelled: DataFrame, risk: float = RISK, error: float = ERROR, clean_weight: float = CLEAN_WEIGHT
) -> DataFrame:
    """``stratum, good, measures`` of labelled documents to ``stratum, cutoffs``: an array with a
    cutoff per rule, null where none is certified."""
    grids = F.array(*[F.array(*map(F.lit, grid(rule))) for rule in RULES])
    strata = labelled.groupBy("stratum").agg(F.sum(F.col("good").cast("long")).alias("n_good"))
    tests = strata.count() * len(RULES)
    if not tests:
        return labelled.sparkSession.createDataFrame([], "stratum string, cutoffs array<double>")
    # the laxest level that rejects a document; LEVELS where none does
    reached = labelled.select(
        "stratum",
        "good",
        F.posexplode(
            F.zip_with("measures", grids, lambda value, cuts: LEVELS - F.size(F.filter(cuts, lambda cut: value > cut)))
        ).alias("rule", "level"),
    ).filter(F.col("level") < LEVELS)
    counts = reached.groupBy("stratum", "rule", "level").agg(
        F.sum(F.col("good").cast("long")).alias("good_here"), F.sum((~F.col("good")).cast("long")).alias("bad_here")
    )
    every = strata.select(
        "stratum",
        "n_good",
        F.explode(F.sequence(F.lit(0), F.lit(len(RULES) - 1))).alias("rule"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    by_level = Window.partitionBy("stratum", "rule").orderBy("level")
    tested = (
        every.join(counts, ["stratum", "rule", "level"], "left")
        .withColumn("good_rejected", F.sum(F.coalesce("good_here", F.lit(0))).over(by_level))
        .withColumn("bad_rejected", F.sum(F.coalesce("bad_here", F.lit(0))).over(by_level))
        .withColumn(
            "refuted",
            tail_probability(F.col("good_rejected"), F.col("n_good"), risk / len(RULES)) <= error / tests,
        )
        .withColumn("certified", F.min("refuted").over(by_level))
        .withColumn("gain", F.col("bad_rejected") - clean_weight * F.col("good_rejected"))
    )
    taken = (
        tested.filter(F.col("certified") & (F.col("bad_rejected") > 0) & (F.col("gain") > 0))
        .groupBy("stratum", "rule")
        .agg(F.max_by("level", F.struct("gain", -F.col("level"))).alias("level"))
        .select("stratum", "rule", F.get(F.get(grids, F.col("rule")), F.col("level")).alias("cutoff"))
    )
    return taken.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == at, F.col("cutoff"))).alias(rule) for at, rule in enumerate(RULES)]
    ).select("stratum", F.array(*RULES).alias("cutoffs"))


def fit(measures: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The cutoffs of each stratum for measured documents with ``doc_id`` and ``stratum``.

    They are written and read back, so that Spark knows how small they are when it plans the join
    with the documents.
    """
    quality = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.min("quality") >= 1).alias("good"))
    )
    labelled = (
        measures.filter(~F.col("base_failed"))
        .select("doc_id", "stratum", "measures")
        .join(quality, "doc_id")
    )
    return stored(cutoffs(labelled, **settings).select(F.col("stratum").alias("of_stratum"), "cutoffs"), "cutoffs")


def judge(measures: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``kept`` to measured documents."""
    passed = F.coalesce(
        ~F.exists(
            F.zip_with("measures", "cutoffs", lambda value, cut: F.coalesce(value > cut, F.lit(False))),
            lambda beyond: beyond,
        ),
        F.lit(True),
    )
    return (
        measures.join(chosen, F.col("stratum") == F.col("of_stratum"), "left")
        .withColumn("kept", ~F.col("base_failed") & passed)
        .drop("of_stratum", "cutoffs")
    )


def stratum_of() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum")


def quality_rules(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """A row per document: base counts, ``base_failed`` and ``kept``, with the measures."""
    measures = cut_lineage(measured(documents, F.col("doc_id"), stratum_of()))
    return judge(measures, fit(measures, labels, **settings))


def kept_documents(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents the rules keep, with the columns they came with. Texts are measured again
    where they lie, so that none is moved or kept on the way."""
    chosen = fit(cut_lineage(measured(documents, F.col("doc_id"), stratum_of())), labels, **settings)
    judged = judge(measured(documents, F.struct("*").alias("row"), stratum_of()), chosen)
    return keep_rows(judged, F.col("kept")).select("row.*")
