"""Operator 1: document rules, rolled up to host verdicts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, own_names, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR_STRENGTH = (1.0, 1000.0)


def _repeated_words(w: Column) -> Column:
    """Words of `w` that lie in a 5-word window found twice or more.

    Hashes of all windows that are all different prove that no window repeats; only else the windows' texts are sorted
    and compared. The work is n log n in the words of one text.
    """
    at = F.sequence(F.lit(1), F.size(w) - 4)

    def covered(s: Column) -> Column:
        marked = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]), x["i"]))
        return let(
            F.sort_array(F.filter(marked, lambda p: p.isNotNull())),
            lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(5), F.get(p, j + 1) - x)), F.lit(0), lambda a, x: a + x),
        )

    def exact() -> Column:
        return let(F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i, 5), " ").alias("g"), i.alias("i")))), covered)

    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(w, i, 5)))
    return F.when(F.size(w) < 6, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact())))


def document_metrics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def annotate(docs: DataFrame) -> DataFrame:
    """Add a struct `__rules` with the metrics and `base_failed`; every column of `docs` stays."""
    failed = (F.col("__rules.n_words") < MIN_WORDS) | (100 * F.col("__rules.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__rules.n_words"))
    return docs.withColumn("__rules", document_metrics(F.col("text"))).withColumn("__rules", F.col("__rules").withField("base_failed", failed))


def host_verdicts(annotated: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: n_docs, n_failed, host_rate (shrunk by an empirical beta prior) and host_failed.

    The prior is fitted by moments to the hosts' own rates: its mean is the mean rate, its strength follows from the
    variance between hosts beyond what their sample sizes explain. Partial sums are made before the shuffle, so a host
    with a third of all rows is one row per task. The null host is a host.
    """
    failed = F.col("__rules.base_failed").cast("long")
    hosts = annotated.groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("inv"))
    spread = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv"), F.lit(1e-9))
    strength = F.least(F.greatest(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(PRIOR_STRENGTH[0])), F.lit(PRIOR_STRENGTH[1]))
    prior = m.select(F.struct(F.col("m"), strength.alias("s")).alias("p"))
    with_prior = hosts.withColumn("__p", prior.scalar())
    shrunk = (F.col("n_failed") + F.col("__p.m") * F.col("__p.s")) / (F.col("n_docs") + F.col("__p.s"))
    return with_prior.select("__host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > max_host_rate).alias("host_failed"))


def with_verdicts(annotated: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """`annotated` rows, written once, with host_rate, host_failed and kept in their `__rules`."""
    rows = materialize(annotated, "rules")
    # Written, so that a small table of hosts is known to be small and the rows are joined where they are.
    verdicts = materialize(host_verdicts(rows, host, max_host_rate).select("__host", F.struct("host_rate", "host_failed").alias("__verdict")), "hosts")
    joined = rows.join(verdicts, rows[host].eqNullSafe(F.col("__host")), "left")
    rate, failed = F.col("__verdict.host_rate"), F.col("__verdict.host_failed")
    full = F.col("__rules").withField("host_rate", rate).withField("host_failed", failed).withField("kept", ~F.col("__rules.base_failed") & ~failed)
    return joined.select(*[rows[c] for c in annotated.columns if c != "__rules"], full.alias("__rules"))


def quality_rules(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every row of `docs` with `__rules`: the metrics, base_failed, host_rate, host_failed and kept.

    A row is kept when neither it nor its host fails. Null and empty texts have no words and fail; repeated rows are
    rows of their own; an empty table gives an empty one; other columns pass untouched, whatever their names (names that
    begin with two underscores are reserved). The metrics are computed once and written to the shared folder before
    hosts are counted.
    """
    return with_verdicts(annotate(own_names(docs)), host, max_host_rate)
