"""Operator 5: quality rules with robust multivariate outliers, DataFrame functions only.

Base statistics are counted per document. The rest of the verdict comes from a minimum covariance
determinant estimate per language and source: the statistics are transformed to four shares
(``FEATURES``); from the coordinatewise medians on, concentration steps take mean and covariance of
the ``inner`` share of rows with the smallest distances, which never raises the determinant.
The covariance of the inner share is raised by the factor that makes it consistent for normal rows.
Distances are then rescaled so that their median is at most that of the chi-square law, and documents
beyond ``limit``, its 0.999 quantile, are rejected. A variance below ``FLOOR`` squared counts as this
one, which keeps groups of equal rows regular: the spread below which a difference means nothing is
stated there; larger spreads are the estimated ones.

Medians and cut-offs are read from counted histograms, so each group costs rows per bucket, not rows
per document, and no group meets in one task. Groups under ``least`` sound documents are judged by
the estimate of their language (of all its sources), and by that of all rows where the language has fewer,
too. Documents that fail the base rules get no outlier verdict and take no part in the estimates.

Null language or source is a group of its own; a null text has no words and fails the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

from .mixing import WORD

SPACE = r"[\x20\x09-\x0D]"
FEATURES = ("x0", "x1", "x2", "x3")
#: Standard deviations of the features below which a spread counts as this one.
FLOOR = (0.04, 0.15, 0.08, 0.08)
#: Median and 0.999 quantile of the chi-square law with four degrees of freedom.
CHI_MEDIAN = 3.3567
CHI_LIMIT = 18.4668
#: The rows of an estimate: 0 for those of a language and source, 1 of a language, 2 all; language and source are null where they are pooled.
GROUP = ("pool", "of_lang", "of_source")


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(
        "doc_id", "lang", "source",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    d = d.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    )
    w = F.col("words")
    three = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
        lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")),
    )
    d = d.withColumn("three", F.when(F.col("n_words") >= 4, F.sort_array(three)))
    t = F.col("three")
    last = F.size(t) - 1
    # neighbours in hash order: a window is repeated if one of them equals it
    found = F.transform(
        F.sequence(F.lit(0), last),
        lambda j: F.when(((j > 0) & (t[F.greatest(j - 1, F.lit(0))]["h"] == t[j]["h"])) | ((j < last) & (t[F.least(j + 1, last)]["h"] == t[j]["h"])), t[j]["i"]),
    )
    d = d.withColumn("again", F.array_compact(found))
    covered = F.size(F.array_distinct(F.flatten(F.transform("again", lambda p: F.array(p, p + 1, p + 2)))))
    return d.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.size("again") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "x0": F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
            "x1": F.asinh(F.col("n_symbols") / n * 5),
            "x2": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))) / 2,
            "x3": F.col("n_repeat_words") / n,
        }
    )


def _same(a: str) -> Column:
    return F.col(f"a.{a}").eqNullSafe(F.col(f"b.{a}"))


def _attach(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with the columns of their group's row, or nulls."""
    out = rows.alias("a").join(per.alias("b"), (F.col("a.pool") == F.col("b.pool")) & _same("of_lang") & _same("of_source"), "left")
    return out.select("a.*", *[f"b.{c}" for c in per.columns if c not in GROUP])


def _quantile(rows: DataFrame, bucket: Column, share: float, name: str) -> DataFrame:
    """Per group the least bucket that has ``share`` of the rows at or below it."""
    counted = rows.groupBy(*GROUP, bucket.alias("bucket")).count()
    run = Window.partitionBy(*GROUP).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    marked = counted.withColumn("upto", F.sum("count").over(run)).withColumn("all", F.sum("count").over(Window.partitionBy(*GROUP)))
    return marked.where(F.col("upto") >= F.col("all") * share).groupBy(*GROUP).agg(F.min("bucket").alias(name))


def _factor(mean: list[Column], cov: list[list[Column]]) -> dict[str, Column]:
    """The lower Cholesky factor of a covariance given as columns, by rows."""
    p = len(mean)
    low: list[list[Column]] = [[F.lit(0.0)] * p for _ in range(p)]
    for i in range(p):
        for j in range(i + 1):
            rest = cov[i][j]
            for k in range(j):
                rest = rest - low[i][k] * low[j][k]
            low[i][j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / low[j][j]
    return {f"l{i}{j}": low[i][j] for i in range(p) for j in range(i + 1)} | {f"m{i}": m for i, m in enumerate(mean)}


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


#: Buckets of a distance: sixteen to a factor of e.
def _log_bucket(d: Column) -> Column:
    return F.floor(F.log(d + 1e-6) * 16).cast("long")


def _consistency(inner: float) -> float:
    """What the covariance of the ``inner`` nearest share of normal rows is to be multiplied by; the laws have four and six degrees of freedom."""
    if inner >= 1:
        return 1.0
    low, high = 0.0, 1000.0
    for _ in range(100):
        half = (low + high) / 4
        low, high = (2 * half, high) if 1 - math.exp(-half) * (1 + half) < inner else (low, 2 * half)
    half = low / 2
    return inner / (1 - math.exp(-half) * (1 + half + half * half / 2))


def _estimate(rows: DataFrame, inner: float) -> DataFrame:
    """Mean and factored covariance per group."""
    p = range(len(FEATURES))
    moments = rows.groupBy(*GROUP).agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in p],
        *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in p for j in range(i + 1)],
    )
    cov = [[F.col(f"c{max(i, j)}{min(i, j)}") * _consistency(inner) for j in p] for i in p]
    for i in p:
        cov[i][i] = F.greatest(cov[i][i], F.lit(FLOOR[i] ** 2))
    return moments.select(*GROUP, *[c.alias(n) for n, c in _factor([F.col(f"m{i}") for i in p], cov).items()])


def _of(pool: Column) -> list[Column]:
    """The columns of GROUP for a row's own language and source."""
    return [pool.alias("pool"), F.when(pool < 2, F.col("lang")).alias("of_lang"), F.when(pool < 1, F.col("source")).alias("of_source")]


def _pools(sound: DataFrame, least: int) -> DataFrame:
    """Per language and source: the estimate that judges it (pool) and those that its rows take part in (feeds)."""
    groups = cut(sound.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "mcd")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.min("n").alias("smallest"))
    pool = F.when(F.col("n") >= least, 0).when(F.col("of_lang") >= least, 1).otherwise(2)
    by_lang = (F.col("smallest") < least) & (F.col("of_lang") >= least)
    every = langs.agg(F.coalesce(F.min("of_lang") < least, F.lit(False)).alias("all"))
    out = groups.alias("a").join(langs.alias("b"), _same("lang")).select("a.*", "b.of_lang", "b.smallest").crossJoin(every)
    feeds = F.array_compact(F.array(F.when(F.col("n") >= least, 0), F.when(by_lang, 1), F.when(F.col("all"), 2)))
    return cut(out.select("lang", "source", pool.alias("pool"), feeds.alias("feeds")), "mcd")


def verdicts(docs: DataFrame, inner: float = 0.75, steps: int = 3, limit: float = CHI_LIMIT, least: int = 30) -> DataFrame:
    """Base statistics of every row with base_failed, distance and kept."""
    stats = base_columns(docs).withColumn("base_failed", base_failed())
    stats = cut(features(stats), "quality")
    pools = _pools(stats.where(~F.col("base_failed")), least)
    judged = stats.alias("a").join(pools.alias("b"), _same("lang") & _same("source"), "left").select("a.*", "b.pool", "b.feeds")
    sound = judged.where(~F.col("base_failed")).withColumn("pool", F.explode("feeds")).select(*FEATURES, *_of(F.col("pool")))
    # medians of the features on a grid
    long = sound.select(*GROUP, F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.round(F.col(x) * 128).cast("long").alias("v")) for i, x in enumerate(FEATURES)])).alias("e"))
    counted = long.groupBy(*GROUP, "e.dim", "e.v").count()
    run = Window.partitionBy(*GROUP, "dim").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    half = counted.withColumn("upto", F.sum("count").over(run)).withColumn("all", F.sum("count").over(Window.partitionBy(*GROUP, "dim")))
    middle = half.where(F.col("upto") * 2 >= F.col("all")).groupBy(*GROUP).agg(
        *[F.min(F.when(F.col("dim") == i, F.col("v") / 128)).alias(f"m{i}") for i in range(len(FEATURES))]
    )
    spread = {f"l{i}{j}": F.lit(FLOOR[i] if i == j else 0.0) for i in range(len(FEATURES)) for j in range(i + 1)}
    start = middle.select(*GROUP, *[f"m{i}" for i in range(len(FEATURES))], *[c.alias(n) for n, c in spread.items()])
    per = cut(start, "mcd")
    for _ in range(steps):
        near = _attach(sound, per).withColumn("bucket", _log_bucket(_distance()))
        edge = _quantile(near, F.col("bucket"), inner, "edge")
        per = cut(_estimate(_attach(near, edge).where(F.col("bucket") <= F.col("edge")), inner), "mcd")
    near = _attach(sound, per).withColumn("bucket", _log_bucket(_distance()))
    scale = _quantile(near, F.col("bucket"), 0.5, "middle").select(*GROUP, (F.exp((F.col("middle") + 0.5) / 16) / CHI_MEDIAN).alias("scale"))
    # floors above the real spread make distances small; they are never scaled up
    own = judged.select(*stats.columns, *_of(F.col("pool")))
    scaled = _attach(_attach(own, per), scale).withColumn("distance", _distance() / F.greatest(F.col("scale"), F.lit(1.0)))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit)
    return scaled.select(*stats.columns, F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), kept.alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
