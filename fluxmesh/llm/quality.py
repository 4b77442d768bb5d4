"""Host-level quality rules, in built-in functions only.

Every text is measured in its own row, whatever its length: no text or window is shuffled. Rule failures are then
counted per host (``source``); a beta prior fitted to all hosts by moments shrinks each host's failure rate, so a host
of three documents is not judged by three documents; and the host verdicts are joined back. In a flagged host a
document must pass every rule, elsewhere only the base rules.

Rows: a null text has no words and fails the base rules; documents without a host (null) share no verdict and are
never in a flagged host; equal rows are judged each; an empty table gives no rows. Repeated windows are found by a
64-bit hash of their eight words within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Characters that separate words: blank, and tab to carriage return.
BLANKS = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
#: Host verdict tables are broadcast up to this many rows, else joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A host is flagged when its shrunk failure rate exceeds this.
HOST_RATE = 0.5


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once even if ``body`` names it in inner functions."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows of ``window`` words found twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        def marked(s: Column) -> Column:
            twin = F.filter(s, lambda x, j: (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
            starts = F.sort_array(F.transform(twin, lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
            step = lambda a, i: F.struct((i + window).cast("long").alias("end"), (a["n"] + i + window - F.greatest(a["end"], i.cast("long"))).alias("n"))
            return F.aggregate(starts, zero, step, lambda a: a["n"])

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, marked))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) > window, let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of the counts the rules use."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return let(words_of(t), of)


def rules() -> dict[str, Column]:
    """Failing conditions; the first is the base rule."""
    n = F.col("n_words")
    return {
        "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * n),
        "many_symbols": 100 * F.col("n_symbols") > 10 * n,
        "many_dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "odd_words": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def host_verdicts(measured: DataFrame, threshold: float = HOST_RATE) -> DataFrame:
    """``host, n_docs, n_failed, shrunk_rate, flagged``: the beta prior comes from the hosts' own rates.

    The prior is two numbers, fitted by moments from sums over hosts (weighted by their documents).
    """
    failed = F.lit(False)
    for rule in rules():
        failed = failed | F.col(rule)
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    s = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(rate * rate * F.col("n_docs")).alias("q"), F.count("*").alias("hosts")).first()
    if not s.n:
        alpha = beta = 1.0
    else:
        mean = min(max(s.f / s.n, 1e-4), 1 - 1e-4)
        noise = mean * (1 - mean) * s.hosts / s.n  # what sampling alone would spread the rates by
        spread = max(s.q / s.n - mean * mean - noise, 1e-6)
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4)
        alpha, beta = mean * strength, (1 - mean) * strength
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("flagged", shrunk > threshold)


def judge(docs: DataFrame, keep_columns: list[str], threshold: float = HOST_RATE) -> DataFrame:
    """``keep_columns`` of ``docs`` with the counts, the rules, the host's rate and ``kept``.

    The measured rows are written once and read for the host counts and for the result, so the texts are measured once.
    """
    own = [F.col(c).alias(f"own_{c}") for c in keep_columns]
    measured = docs.select(*own, F.col("source").cast("string").alias("host"), measures(F.col("text")).alias("m")).select(*[f"own_{c}" for c in keep_columns], "host", "m.*")
    for name, failing in rules().items():
        measured = measured.withColumn(name, failing)
    measured = materialize(measured, "quality")
    verdicts = materialize(host_verdicts(measured, threshold).select(F.col("host").alias("v_host"), "shrunk_rate", "flagged"), "hosts")
    side = F.broadcast(verdicts) if verdicts.count() <= BROADCAST_ROWS else verdicts
    out = measured.join(side, F.col("host") == F.col("v_host"), "left").withColumn("host_flagged", F.coalesce("flagged", F.lit(False)))
    any_failed = F.col("many_symbols") | F.col("many_dup_lines") | F.col("odd_words")
    out = out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_flagged") & any_failed))
    drop = {"v_host", "flagged"}
    return out.select(*[F.col(f"own_{c}").alias(c) for c in keep_columns], *[c for c in out.columns if c not in drop and not c.startswith("own_")])
