"""Quality rules with host verdicts: rule failures by host, shrunk to a beta prior, joined back to documents.

A document fails by its own text if it has too few words or too many words in repeated windows. All rules
together, with too many symbols and too many repeated lines, count as failures of its host. A host whose
failure rate, shrunk to the prior of all hosts, is above `most_failures` has all its documents rejected.

Defined cases: null or empty text has no words and fails; a null host gets no verdict; repeated rows count
as often as they come; no hosts at all give the flat prior.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.llm.scratch import small, store

SPACES = "[\\x20\\x09-\\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    least_words: int = 10
    most_repeated_pct: int = 20
    most_symbols_pct: int = 10
    most_dup_lines_pct: int = 30
    most_failures: float = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def repeated_positions(df: DataFrame) -> DataFrame:
    """n_repeat_words from the column `words`: positions inside a window that occurs twice or more.

    Windows are compared by 64-bit hash. Only texts in which a hash repeats are sorted.
    """
    n = F.size("words")
    hashes = F.transform("words", lambda w, i: F.xxhash64(F.slice("words", i + 1, WINDOW)))
    df = df.withColumn("grams", F.when(n > WINDOW, hashes))  # the last four are shorter and match nothing
    repeats = F.size(F.array_distinct("grams")) < n
    ranked = F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("ranked", F.when(repeats, ranked)).drop("grams")
    hit = F.filter(
        "ranked",
        lambda x, k: x.h.eqNullSafe(F.get("ranked", k - 1).h) | x.h.eqNullSafe(F.get("ranked", k + 1).h),
    )
    df = df.withColumn("places", F.array_sort(F.transform(hit, lambda x: x.i))).drop("ranked")
    gaps = F.transform(
        "places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)))
    )
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("places")


def measure(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """(row: all columns of docs as a struct, the measures, base_failed, failed)."""
    df = docs.select(F.struct("*").alias("row"))
    body = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumns({"words": words_of(body), "lines": lines})
    df = df.withColumns(
        {
            "joined": F.array_join("words", ""),
            "n_words": F.size("words").cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("lines")
    plain = F.length(F.regexp_replace("joined", "[#*$%&|<>]+", ""))
    df = df.withColumns(
        {
            "word_chars": F.length("joined").cast("long"),
            "n_symbols": (F.length("joined") - plain).cast("long"),
        }
    ).drop("joined")
    df = repeated_positions(df).drop("words")
    base = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeated_pct * F.col("n_words")
    )
    more = (100 * F.col("n_symbols") > rules.most_symbols_pct * F.col("word_chars")) | (
        100 * F.col("n_dup_lines") > rules.most_dup_lines_pct * F.col("n_lines")
    )
    return df.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | more)


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed, rate): failure rates shrunk to a beta prior fitted by moments over all hosts."""
    hosts = (
        measured.groupBy(F.col("row")[host].alias("host"))
        .agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed"))
        .filter(F.col("host").isNotNull())
    )
    raw = F.col("n_failed") / F.col("n_docs")
    mean, spread, noise = hosts.agg(
        F.avg(raw), F.coalesce(F.var_pop(raw), F.lit(0.0)), F.avg(raw * (1 - raw) / F.col("n_docs"))
    ).first()
    alpha, beta = beta_prior(mean, spread, noise)
    return hosts.withColumn("rate", (F.col("n_failed") + alpha) / (F.col("n_docs") + (alpha + beta)))


def beta_prior(mean: float | None, spread: float, noise: float | None) -> tuple[float, float]:
    """Beta parameters with the mean of the host rates and their variance beyond that of counting."""
    if mean is None:
        return 1.0, 1.0
    mean = min(max(mean, 0.001), 0.999)
    between = max(spread - noise, 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def judge(measured: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """measured (stored by the caller) with `kept`; only rejected hosts are joined, so a hot host is not shuffled."""
    rates = host_rates(measured, host)
    bad = store(rates.filter(F.col("rate") > rules.most_failures).select(F.col("host").alias("bad_host")), "hosts")
    joined = measured.join(small(bad), F.col("row")[host] == F.col("bad_host"), "left")
    kept = ~F.col("base_failed") & F.col("bad_host").isNull()
    return joined.withColumn("kept", kept).drop("bad_host")


def quality_rules(docs: DataFrame, rules: Rules = Rules(), host: str = "source", text: str = "text") -> DataFrame:
    """All of it; the measured rows are stored once, so that every text is read once."""
    return judge(store(measure(docs, rules, text), "measured"), rules, host)
