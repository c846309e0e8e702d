"""Host-level quality rules: failures per host, shrunk by an empirical beta prior, joined back to documents.

Only DataFrame functions. Words are runs of characters other than space, tab, line feed, vertical tab, form feed
and carriage return.

Defined results: a null text has no words, so it fails the base rules. A null host is one host of its own. Repeated
rows count and are judged as often as they occur. An empty table gives an empty result; with no spread between
hosts the prior becomes as strong as ``MAX_STRENGTH`` documents. Other columns, whatever their names, are ignored
by ``judge`` and passed through by ``keep_documents``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.plans.durable import written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A host is rejected when the shrunk share of its documents that fail a rule is above the rule's limit.
HOST_LIMITS: dict[str, float] = {"base": 0.5, "symbols": 0.6, "dup_lines": 0.6}
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _repeats(df: DataFrame, array: str, out: str) -> DataFrame:
    """Number of elements of ``array`` inside 3-element windows that occur twice or more, the first included."""
    window = F.transform(
        F.slice(F.col(array), 1, F.greatest(F.size(array) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(array, i + 1), F.get(array, i + 2)).alias("h"), i.alias("i")),
    )
    df = df.withColumn("_sorted", F.sort_array(window))
    same = F.filter(
        F.col("_sorted"),
        lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get("_sorted", k + 1)["h"], F.lit(False)),
    )
    df = df.withColumn("_starts", F.sort_array(F.transform(same, lambda x: x["i"])))
    covered = F.transform(
        F.col("_starts"), lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - p, F.lit(3)))
    )
    return df.withColumn(out, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_sorted", "_starts")


def with_measures(df: DataFrame, only_base: bool = False) -> DataFrame:
    """Adds the measures of column ``_text``; ``only_base`` leaves out what the base rules don't use."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    df = df.withColumn("_words", words(F.col("_text"))).withColumn("n_words", F.size("_words").cast("long"))
    df = _repeats(df, "_words", "n_repeat_words")
    if not only_base:
        df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
        df = df.withColumns({
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }).drop("_lines")
    return df.drop("_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 5 * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_verdicts(measured: DataFrame, limits: Mapping[str, float] = HOST_LIMITS) -> DataFrame:
    """One row per ``_host``: documents, failures and shrunk rate of each rule, and ``host_rejected``.

    The prior of a rule is a beta distribution with the mean and the spread (method of moments, hosts weighted by
    their documents) of the hosts' rates. Counts are combined before the shuffle, so a host with a third of all
    rows is no more work than another.
    """
    failures = rule_failures()
    hosts = written(
        measured.groupBy("_host").agg(
            F.count(F.lit(1)).alias("n_docs"),
            *[F.sum(failures[r].cast("long")).alias(f"n_{r}") for r in limits],
        ),
        "hosts",
    )
    n = F.col("n_docs")
    moments = hosts.agg(
        F.sum(n).alias("n"), F.count(n).alias("hosts"), F.sum(n * n).alias("nn"),
        *[F.sum(f"n_{r}").alias(f"f_{r}") for r in limits],
        *[F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / n).alias(f"q_{r}") for r in limits],
    ).first()
    rejected = F.lit(False)
    for rule, limit in limits.items():
        a, b = beta_prior(moments["n"], moments["hosts"], moments["nn"], moments[f"f_{rule}"], moments[f"q_{rule}"])
        hosts = hosts.withColumn(f"rate_{rule}", (F.col(f"n_{rule}") + F.lit(a)) / (n + F.lit(a + b)))
        rejected = rejected | (F.col(f"rate_{rule}") > limit)
    return hosts.withColumn("host_rejected", rejected)


def beta_prior(n: int | None, hosts: int, nn: int | None, failed: int | None, squares: float | None) -> tuple[float, float]:
    """Parameters (a, b) by moments from sums over hosts: n_h, 1, n_h^2, f_h and f_h^2 / n_h."""
    if not n:
        return 0.5, 0.5
    mean = failed / n
    spread = mean * (1 - mean)
    # between-host variance: weighted variance of rates less what binomial noise explains
    between = squares - n * mean * mean - max(hosts - 1, 0) * spread
    scale = n - nn / n
    variance = between / scale if scale > 0 else 0.0
    strength = spread / variance - 1 if variance > 0 and spread > 0 else MAX_STRENGTH
    strength = min(max(strength, MIN_STRENGTH), MAX_STRENGTH)
    return strength * mean, strength * (1 - mean)


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    limits: Mapping[str, float] = HOST_LIMITS,
) -> DataFrame:
    """One row per document: measures, ``base_failed``, the host's rates, ``host_rejected`` and ``kept``.

    Measures are taken once and written (a few numbers per document). The host table is a written file too, so the
    join back broadcasts it only when its size is below the session's threshold; else it is a shuffled join whose
    hot hosts adaptive execution splits.
    """
    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"), F.col(host_col).alias("_host"))
    measured = with_measures(slim).withColumn("base_failed", base_failed()).drop("_text")
    measured = written(measured.select(id_col, "_host", *MEASURES, "base_failed"), "measures")
    verdicts = written(host_verdicts(measured, limits), "verdicts")
    rates = [c for c in verdicts.columns if c.startswith("rate_")]
    return (
        measured.alias("m")
        .join(verdicts.alias("v"), F.col("m._host").eqNullSafe(F.col("v._host")), "left")
        .select(f"m.{id_col}", *[f"m.{c}" for c in MEASURES], "m.base_failed", *[f"v.{c}" for c in rates],
                F.coalesce("v.host_rejected", F.lit(False)).alias("host_rejected"),
                (~F.col("m.base_failed") & ~F.coalesce(F.col("v.host_rejected"), F.lit(False))).alias("kept"))
    )


def keep_documents(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", limits: Mapping[str, float] = HOST_LIMITS
) -> DataFrame:
    """The documents that neither fail themselves nor come from a rejected host, with all their columns."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                       F.col(text_col).alias("_text"), F.col(host_col).alias("_host"))
    flags = with_measures(rows.drop("_row")).select("_host", *MEASURES)
    verdicts = written(host_verdicts(flags, limits).filter("host_rejected").select("_host"), "rejected")
    # a row number that the test reads keeps the optimizer from moving the test below the measures, where it would
    # write their lambdas out inside each other and take quadratic time
    measured = with_measures(rows, only_base=True).withColumn("_n", F.monotonically_increasing_id())
    fine = measured.filter(~base_failed() & (F.col("_n") >= 0)).select("_row", "_host")
    kept = fine.alias("d").join(verdicts.alias("v"), F.col("d._host").eqNullSafe(F.col("v._host")), "left_anti")
    return kept.select(*[F.col("d._row").getField(c).alias(c) for c in names])
