"""Quality rules by robust multivariate outliers (operator 7): DataFrame expressions only.

Base rules count words, symbols and repeats inside each text. The verdict comes from minimum covariance determinant
estimates, one for each language and source: concentration steps from two fixed starts keep the rows nearest to the
estimate and refit it, the start with the smaller determinant wins, and documents far from it by Mahalanobis
distance are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage, unstage

SPACE = r"[ \t\n\x0B\f\r]+"
WINDOW = 8
#: Transformed statistics, each with the least standard deviation that an estimate may have.
STATISTICS = {"x_length": 0.10, "x_symbols": 0.04, "x_upper": 0.06, "x_marks": 0.06, "x_twice": 0.08, "x_lines": 0.15, "x_repeats": 0.15}
#: Share of a group that an estimate rests on.
CORE = 0.75
STEPS = 4
#: Quantiles of chi-square with one degree for each statistic (seven): the median, and 1 - 1e-7.
CHI2_MEDIAN, CHI2_CUT = 6.346, 44.0
#: Groups with fewer usable rows, and those after the MAX_GROUPS largest, share the estimate of their language's rest or, if that is small too, of all such rows.
MIN_GROUP, MAX_GROUPS = 200, 10_000
#: The percentile sketch's accuracy.
ACCURACY = 10_000


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the working columns of the verdict.

    All of it inside the row, without a shuffle. A null text has no words. Windows are compared by 64-bit hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", F.array_remove(F.split(t, SPACE), ""))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")),
        "_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        "_marks": F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")),
        "_hash": F.transform("_words", lambda x: F.xxhash64(x)),
    })
    df = df.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines"),
        "_twice": F.size(F.filter(F.zip_with("_hash", F.slice("_hash", 2, F.greatest(F.size("_hash"), F.lit(1))), lambda a, b: a == b), lambda x: x)),
    })
    width = 1
    while width < WINDOW:  # hashes of windows twice as wide from neighbours
        df = df.withColumn("_hash", F.zip_with("_hash", F.slice("_hash", width + 1, F.greatest(F.size("_hash"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    df = df.withColumn("_hash", F.slice("_hash", 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))))
    some = F.size(F.array_distinct("_hash")) < F.size("_hash")
    df = df.withColumn("_sorted", F.when(some, F.sort_array(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_sorted", lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"]) | (x["h"] == F.get("_sorted", i + 1)["h"]))
    df = df.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).drop("_words", "_lines", "_hash", "_sorted", "_at")


def _transformed(df: DataFrame) -> DataFrame:
    """The statistics, on scales where clean text is near normal: logarithms of sizes, roots of shares."""
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    share = lambda a, b: F.sqrt(F.least(F.col(a) / b, F.lit(1.0)))
    return df.withColumns({
        "x_length": F.log(chars / words), "x_symbols": share("n_symbols", chars), "x_upper": share("_upper", chars), "x_marks": share("_marks", chars),
        "x_twice": share("_twice", words), "x_lines": share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))), "x_repeats": share("n_repeat_words", words),
    })


def _distance(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, with the estimate's columns m (means) and p (the inverse factor, row by row)."""
    off = [F.col(x) - F.get("m", F.lit(i)) for i, x in enumerate(names)]
    y = [reduce(lambda a, b: a + b, [F.get("p", F.lit(i * (i + 1) // 2 + j)) * off[j] for j in range(i + 1)]) for i in range(len(names))]
    return df.withColumn("d2", F.aggregate(F.array(*y), F.lit(0.0), lambda a, x: a + x * x))


def _factor(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds to rows with covariances c_i_j the inverse p of their lower factor and half the log determinant."""
    floors = list(STATISTICS.values())
    d = len(names)
    for j in range(d):
        inner = lambda i: reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}") + (floors[i] ** 2 if i == j else 0.0))  # noqa: B023, E731
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(inner(j), F.lit(floors[j] ** 2 / 4))))
        df = df.withColumns({f"l_{i}_{j}": inner(i) / F.col(f"l_{j}_{j}") for i in range(j + 1, d)})
    for i in range(d):
        sums = [reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"p_{k}_{j}"), range(j, i), F.lit(0.0)) for j in range(i)]  # noqa: B023
        df = df.withColumns({f"p_{i}_{j}": x / F.col(f"l_{i}_{i}") for j, x in enumerate([*sums, F.lit(1.0)])})
    return df.withColumns({"p": F.array(*[f"p_{i}_{j}" for i in range(d) for j in range(i + 1)]), "half_log_det": reduce(lambda a, b: a + b, [F.log(f"l_{i}_{i}") for i in range(d)])})


def estimates(rows: DataFrame, names: list[str]) -> DataFrame:
    """Minimum covariance determinant estimates of the groups ``g`` of a staged table: g, m, p (scaled to the core's distances).

    Every step is two aggregations that combine before the shuffle; the estimates (two for each of MAX_GROUPS groups
    and the pools at most) are broadcast back, so the rows themselves are never shuffled.
    """
    d = len(names)
    floors = list(STATISTICS.values())
    medians = stage(rows.groupBy("g").agg(F.array(*[F.percentile_approx(x, 0.5, ACCURACY) for x in names]).alias("m")), "medians")
    spread = rows.join(F.broadcast(medians), "g").groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(x) - F.get("m", F.lit(i))), 0.5, ACCURACY).alias(f"s_{i}") for i, x in enumerate(names)])
    first = stage(medians.join(spread, "g"), "spreads")
    diagonal = lambda x: F.array(*[x(i) if i == j else F.lit(0.0) for i in range(d) for j in range(i + 1)])
    scaled = first.select("g", F.lit(0).alias("start"), "m", diagonal(lambda i: 1 / F.greatest(1.4826 * F.col(f"s_{i}"), F.lit(floors[i]))).alias("p"))
    ball = first.select("g", F.lit(1).alias("start"), "m", diagonal(lambda i: F.lit(1.0)).alias("p"))
    now = stage(scaled.unionByName(ball), "estimates")
    for _ in range(STEPS):  # what a step reads is staged, so no plan holds two distances
        far = _distance(rows.join(F.broadcast(now), "g"), names)
        cut = stage(now.select("g", "start", "m", "p").join(far.groupBy("g", "start").agg(F.percentile_approx("d2", CORE, ACCURACY).alias("cut")), ["g", "start"]), "cuts")
        core = _distance(rows.join(F.broadcast(cut), "g"), names).where("d2 <= cut")
        sums = stage(core.groupBy("g", "start").agg(F.array(*[F.avg(x) for x in names]).alias("m"), *[F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)]), "sums")
        new = stage(_factor(sums, names).select("g", "start", "m", "p", "half_log_det"), "estimates")
        for x in (now, cut, sums):
            unstage(x)
        now = new
    best = now.groupBy("g").agg(F.min_by("start", F.struct("half_log_det", "start")).alias("start"))
    chosen = stage(now.join(best, ["g", "start"]).drop("start", "half_log_det"), "estimates")
    scale = _distance(rows.join(F.broadcast(chosen), "g"), names).groupBy("g").agg(F.greatest(F.lit(1.0), F.sqrt(F.percentile_approx("d2", 0.5, ACCURACY) / CHI2_MEDIAN)).alias("scale"))
    return stage(chosen.join(scale, "g").select("g", "m", F.transform("p", lambda x: x / F.col("scale")).alias("p")), "estimates")


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds ``g``: language and source where such rows are many, else the language's rest, else one pool."""
    none = F.lit("\x00")
    own = rows.withColumns({"_l": F.coalesce("lang", none), "_s": F.coalesce("source", none)})
    usable = F.count(F.when(~F.col("base_failed"), 1))
    sizes = own.groupBy("_l", "_s").agg(usable.alias("n")).where(F.col("n") >= MIN_GROUP).orderBy(F.desc("n"), "_l", "_s").limit(MAX_GROUPS)
    own = own.join(F.broadcast(sizes.select("_l", "_s", F.lit(True).alias("_own"))), ["_l", "_s"], "left")
    rest = own.where("_own is null").groupBy("_l").agg(usable.alias("n")).where(F.col("n") >= MIN_GROUP).orderBy(F.desc("n"), "_l").limit(MAX_GROUPS)
    own = own.join(F.broadcast(rest.select("_l", F.lit(True).alias("_rest"))), "_l", "left")
    g = F.when(F.col("_own"), F.concat(F.lit("2"), "_l", F.lit("\x01"), "_s")).when(F.col("_rest"), F.concat(F.lit("1"), "_l")).otherwise(F.lit("0"))
    return own.withColumn("g", g).drop("_l", "_s", "_own", "_rest")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a row of ``docs``: doc_id, the base statistics, base_failed, distance2 and kept.

    Only rows that pass the base rules shape the estimates. A pool with fewer than MIN_GROUP / 10 usable rows gives no
    verdict and keeps what passes the base rules. Null languages and sources are groups of their own.
    """
    names = list(STATISTICS)
    measured = _measured(docs.select("doc_id", F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_text")), drop="_text")
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d2").alias("distance2"), "kept", *names)


def _measured(named: DataFrame, drop: str) -> DataFrame:
    """Rows with lang, source and _text, with their statistics, d2 and kept; the column ``drop`` goes early."""
    names = list(STATISTICS)
    staged = stage(_transformed(base_statistics(named, "_text").drop(drop)), "text-statistics")
    rows = _grouped(staged)
    grouped = stage(rows.select("g", "base_failed", *names), "grouped-statistics")  # what the estimates read, without the texts
    usable = grouped.where(~F.col("base_failed")).select("g", *names)
    found = estimates(usable, names)
    enough = stage(found.join(F.broadcast(usable.groupBy("g").count()), "g").where(F.col("count") >= MIN_GROUP // 10).drop("count"), "estimates")
    unstage(grouped)
    far = _distance(rows.join(F.broadcast(enough), "g", "left"), names)
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CHI2_CUT, F.lit(True)))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, each by its own text; all columns stay.

    The rows are staged beside their statistics, and the estimates (bounded by MAX_GROUPS) come to them: no text is shuffled.
    """
    named = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_doc"), "lang", "source", F.col("text").alias("_text"))
    return _measured(named, drop="_text").where("kept").select("_doc.*")


def op7_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its base statistics and the verdict."""
    return judge(documents(spark, sf_dir))
