"""Quality rules for documents, with a verdict on each host they come from."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearledger.llm.common import stored, words_of

MIN_WORDS = 50
# A host is rejected when its shrunk rate of failures of a rule is above the rule's bound.
MAX_RATES = {"base_failed": 0.5, "symbols": 0.5, "dup_lines": 0.5, "word_length": 0.5}
# How many documents the prior is worth, at least and at most. Fewer: one document would decide on a host where the hosts that
# tell anything are all good or all bad. More: hosts that chance makes alike would overrule a large host's own documents.
PRIOR_DOCS = (4.0, 100.0)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WORK = "__quality_"


def _repeated(words: str) -> str:
    """SQL: how many words stand in a three-word window that the text holds twice or more.

    Each window becomes one long, its hash with the low bits replaced by its
    position. Sorted, equal windows are neighbours; these are compared word by
    word. What the windows found cover is the sum of the gaps between them, three at most.
    """
    return f"""
    transform(array({words}), w -> CASE WHEN size(w) < 4 THEN 0L ELSE transform(
      array(shiftleft(1L, CAST(ceil(log2(size(w))) AS INT))), unit -> transform(
        array(array_sort(transform(sequence(0, size(w) - 3),
          i -> (xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) & (-unit)) | CAST(i AS BIGINT)))),
        s -> transform(
          array(filter(s, (x, k) -> transform(
            array(named_struct('p', CAST(x & (unit - 1) AS INT), 'q', get(s, k - 1), 'r', get(s, k + 1))),
            n -> ((n.q & (-unit)) = (x & (-unit)) AND n.q IS NOT NULL
                  AND get(w, n.p) = get(w, CAST(n.q & (unit - 1) AS INT))
                  AND get(w, n.p + 1) = get(w, CAST(n.q & (unit - 1) AS INT) + 1)
                  AND get(w, n.p + 2) = get(w, CAST(n.q & (unit - 1) AS INT) + 2))
              OR (n.r IS NOT NULL AND (n.r & (-unit)) = (x & (-unit))
                  AND get(w, n.p) = get(w, CAST(n.r & (unit - 1) AS INT))
                  AND get(w, n.p + 1) = get(w, CAST(n.r & (unit - 1) AS INT) + 1)
                  AND get(w, n.p + 2) = get(w, CAST(n.r & (unit - 1) AS INT) + 2)))[0])),
          found -> CASE WHEN size(found) = 0 THEN 0L ELSE transform(
            array(array_sort(transform(found, x -> x & (unit - 1)))),
            at -> 3L + aggregate(transform(at, (x, k) -> least(3L, coalesce(get(at, k + 1) - x, 0L))),
                                 0L, (a, x) -> a + x))[0] END)[0])[0])[0] END)[0]
    """


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts of a whole text as longs; all are 0 for a NULL or blank one."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = f"{_WORK}words"
    with_words = docs.withColumn(words, words_of(body))
    return with_words.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": F.transform(F.array(lines), lambda v: F.size(v) - F.size(F.array_distinct(v)))[0].cast("long"),
            "n_repeat_words": F.expr(_repeated(words)),
        }
    ).drop(words)


def failures() -> dict[str, Column]:
    """The rules over the counts, true where a document fails."""
    n_words, chars, symbols = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    return {
        "base_failed": (n_words < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n_words),
        "symbols": 10 * symbols > n_words,
        "dup_lines": 5 * F.col("n_dup_lines") > n_words,
        "word_length": (chars < 3 * n_words) | (chars > 12 * n_words),
    }


def host_rates(flagged: DataFrame, host: str, rules: list[str]) -> DataFrame:
    """Per host the number of documents and for each rule the shrunk rate of failures.

    The prior is a beta distribution with the mean of the hosts' own rates and the variance that is left of theirs once that of
    drawing few documents is taken out: rates of hosts with n documents vary by m(1-m)(r + (1-r)/n), where r is
    how alike documents of one host are, and (1-r)/r documents is what the prior is worth, within ``PRIOR_DOCS``. So a host
    of few documents is judged by what is usual, also where all hosts are small.
    """
    counts = flagged.groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col(r).cast("long")).alias(f"{r}_n") for r in rules)
    )
    counts = stored(counts, "quality-counts")
    priors = counts.agg(
        *(F.avg(F.col(f"{r}_n") / F.col("n")).alias(f"{r}_mean") for r in rules),
        *(F.var_samp(F.col(f"{r}_n") / F.col("n")).alias(f"{r}_var") for r in rules),
        F.avg(1 / F.col("n")).alias("inverse"),
    )
    # one row of figures: the join pairs it with each host by a constant key
    joined = counts.withColumn("all", F.lit(1)).join(priors.withColumn("all", F.lit(1)), "all")
    rates = {}
    for rule in rules:
        mean, var = F.col(f"{rule}_mean"), F.col(f"{rule}_var")
        spread, small = mean * (1 - mean), F.col("inverse")
        alike = F.when((spread > 0) & (small < 1), (var / spread - small) / (1 - small))
        least, most = PRIOR_DOCS
        weight = F.when(alike > 0, F.least(F.lit(most), F.greatest(F.lit(least), (1 - alike) / alike))).otherwise(F.lit(most))
        rates[f"{rule}_rate"] = (F.col(f"{rule}_n") + weight * mean) / (F.col("n") + weight)
    return joined.select("host", "n", *(rate.alias(name) for name, rate in rates.items()))


def rejected_hosts(flagged: DataFrame, host: str, max_rates: Mapping[str, float]) -> DataFrame:
    rates = host_rates(flagged, host, list(max_rates))
    over = [F.col(f"{rule}_rate") > bound for rule, bound in max_rates.items()]
    worst = over[0]
    for one in over[1:]:
        worst = worst | one
    # Written, so that Spark knows the size: it broadcasts a list below its threshold and deals out a longer one.
    return stored(rates.where(worst).select("host"), "quality-hosts")


def judged(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    max_rates: Mapping[str, float] = MAX_RATES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The columns ``keep`` of each row with its counts, base_failed, host_rejected and kept.

    The counts are written once, the hosts judged from them, and the verdicts
    joined back. NULL hosts count as one host. A NULL or blank text has no words and
    fails. Repeated rows count each time. An empty table gives no rows. Columns not
    named in ``keep`` are left out, so their names can't clash.
    """
    own = f"{_WORK}host"
    rows = docs.select(
        *(F.col(f"`{c}`") for c in keep),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias(own),
        F.col(f"`{text}`").alias(f"{_WORK}text"),
    )
    rules = failures()
    flagged = stored(
        measured(rows, f"{_WORK}text").drop(f"{_WORK}text").withColumns({r: rules[r] for r in max_rates}), "quality"
    )
    bad = rejected_hosts(flagged, own, max_rates).select(F.col("host").alias(own), F.lit(True).alias("host_rejected"))
    return (
        flagged.join(bad, own, "left")
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .drop(own)
    )


def passing(
    docs: DataFrame, text: str = "text", host: str = "source", max_rates: Mapping[str, float] = MAX_RATES
) -> DataFrame:
    """The rows that pass, with all their columns: no base failure and no rejected host.

    The texts are read twice, for the hosts' rates and for the rows' own rule, so
    that no second copy of them has to be kept.
    """
    names = docs.columns
    own, copy = f"{_WORK}host", f"{_WORK}text"
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias(f"{_WORK}row"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias(own),
        F.col(f"`{text}`").alias(copy),
    )
    rules = failures()
    flagged = measured(rows.drop(f"{_WORK}row"), copy).drop(copy).withColumns({r: rules[r] for r in max_rates})
    bad = rejected_hosts(flagged, own, max_rates).withColumnRenamed("host", own)
    kept = measured(rows, copy).where(~rules["base_failed"])
    return kept.join(bad, own, "left_anti").select(f"{_WORK}row.*")
