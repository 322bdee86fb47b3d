"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Each document gets a vector of transformed statistics. For each language and source the minimum covariance determinant
estimate of centre and scatter is found by concentration steps from two deterministic starts (medians and quartiles;
plain moments), the one with the smaller determinant is reweighted, and documents far from it by Mahalanobis distance
are rejected.

Scale: texts are read once and never shuffled. A concentration step is one pass over narrow rows that sums counts and
moments by group and distance bin (combined before the shuffle, so a source with a third of all rows is no hot task);
the h nearest rows are the lowest bins that hold them, found on the small table of bins. Vectors are whole multiples of
1/1024 and moments are sums of longs, so results don't depend on the order of rows.

Defined cases: null text is empty; null lang or source is a group of its own; a group with under `min_group` usable rows
is pooled with the others of its language, and where even these are too few the rules alone decide; rows are judged one
by one, repeated ids included; ties in distance fall into the same bin; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import saved, table, words

DIMS = 5
SCALE = 1024
#: Standard deviations (in units of the vector) below which no direction's spread is believed; keeps estimates regular where most rows have the same value.
FLOOR = (0.5, 0.08, 0.045, 0.12, 0.12)
#: Share of a group that the estimate is concentrated on.
SHARE = 0.75
STEPS = 4
#: Rejected beyond this probability of a chi-square distribution; clean text has heavier tails than a normal one, hence so near 1.
CONFIDENCE = 1 - 1e-7
BINS_PER_OCTAVE = 16
#: Usable rows from which a language and source has an estimate of its own: five for each dimension.
MIN_GROUP = 5 * DIMS


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(dims / 2, mid / 2) < p else (low, mid)
    return high


def statistics(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the columns carried along and the counts of each row of docs."""
    own = ("doc_id", "lang", "source", *carried)
    d = docs.select(*own, F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        *own, "w", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("l"),
    )
    windows = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    d = d.select(
        *own, "n_words", "word_chars", "n_symbols", F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), windows.alias("t"),
    )
    # Sorted (window, place) pairs put equal windows side by side; only texts with a repeated window need them.
    pairs = F.when(F.size(F.array_distinct("t")) < F.size("t"), F.sort_array(F.transform("t", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    d = d.select("*", pairs.alias("s")).drop("t")
    same = lambda i, j: F.get("s", i)["h"] == F.get("s", j)["h"]
    again = F.filter("s", lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    d = d.select("*", F.sort_array(F.transform(again, lambda x: x["p"])).alias("p")).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))["n"]
    d = d.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("p")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def vector(c: dict[str, Column]) -> list[Column]:
    """The transformed statistics, as whole multiples of 1/SCALE."""
    n, lines = F.greatest(c["n_words"], F.lit(1)).cast("double"), F.greatest(c["n_lines"], F.lit(1)).cast("double")
    raw = [
        F.log(n), F.log((c["word_chars"] + 1) / n), F.sqrt(c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1))),
        F.sqrt(c["n_dup_lines"] / lines), F.sqrt(c["n_repeat_words"] / n),
    ]
    return [F.round(x * SCALE).cast("long") for x in raw]


_X = [f"x{i}" for i in range(DIMS)]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s_{x}") for x in _X), *(F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q_{i}_{j}") for i, j in _PAIRS)]


def _resummed() -> list[Column]:
    return [F.sum("n").alias("n"), *(F.sum(f"s_{x}").alias(f"s_{x}") for x in _X), *(F.sum(f"q_{i}_{j}").alias(f"q_{i}_{j}") for i, j in _PAIRS)]


def _estimate(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """keys, centre m_i, inverse scatter a_i_j and the log of its determinant from sums of moments; factor makes a concentrated scatter consistent."""
    n = F.col("n").cast("double")
    d = sums.select(*keys, *((F.col(f"s_{x}") / n).alias(f"m_{i}") for i, x in enumerate(_X)), *((F.col(f"q_{i}_{j}") / n - (F.col(f"s_{_X[i]}") / n) * (F.col(f"s_{_X[j]}") / n)).alias(f"c_{i}_{j}") for i, j in _PAIRS))
    d = d.withColumns({f"c_{i}_{j}": F.col(f"c_{i}_{j}") * factor + (F.lit((FLOOR[i] * SCALE) ** 2) if i == j else 0) for i, j in _PAIRS})
    return _inverted(d, keys)


def _inverted(d: DataFrame, keys: list[str]) -> DataFrame:
    """From centre m_i and scatter c_i_j: its inverse by Cholesky factors."""
    for j in range(DIMS):
        for i in range(j, DIMS):
            rest = F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            d = d.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for j in range(DIMS):  # the inverse of the factor, column by column
        for i in range(j, DIMS):
            rest = F.lit(1.0) if i == j else -sum((F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}") for k in range(j, i)), F.lit(0.0))
            d = d.withColumn(f"v_{i}_{j}", rest / F.col(f"l_{i}_{i}"))
    inverse = {f"a_{i}_{j}": sum((F.col(f"v_{k}_{i}") * F.col(f"v_{k}_{j}") for k in range(i, DIMS)), F.lit(0.0)) for i, j in _PAIRS}
    logdet = sum((F.log(f"l_{i}_{i}") for i in range(DIMS)), F.lit(0.0))
    return d.select(*keys, *(f"m_{i}" for i in range(DIMS)), *(v.alias(k) for k, v in inverse.items()), logdet.alias("logdet"))


def _distance() -> Column:
    diff = [F.col(_X[i]) - F.col(f"m_{i}") for i in range(DIMS)]
    return sum(((1 if i == j else 2) * F.col(f"a_{i}_{j}") * diff[i] * diff[j] for i, j in _PAIRS), F.lit(0.0))


def _bin() -> Column:
    return F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * BINS_PER_OCTAVE).cast("int")


def estimates(vectors: DataFrame) -> DataFrame:
    """The reweighted minimum covariance determinant estimate of each group (gid) of vectors."""
    middle = vectors.groupBy("gid").agg(*(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p_{x}") for x in _X))
    robust = middle.select("gid", F.lit(0).alias("start"), *(F.col(f"p_{x}")[1].alias(f"m_{i}") for i, x in enumerate(_X)), *((F.pow((F.col(f"p_{_X[i]}")[2] - F.col(f"p_{_X[i]}")[0]) / 1.349, F.lit(2.0)) + (FLOOR[i] * SCALE) ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS))
    plain = vectors.groupBy("gid").agg(*_moments()).withColumn("start", F.lit(1))
    keys = ["gid", "start"]
    now = saved(_inverted(robust, keys).unionByName(_estimate(plain, keys, 1.0)), "mcd-start", small=True)
    reach = chi2_quantile(SHARE, DIMS)
    concentrated = SHARE / _gamma_p(DIMS / 2 + 1, reach / 2)
    order = Window.partitionBy(*keys).orderBy("bin")
    for step in range(STEPS):
        # written, so that bins are dealt by themselves: summed with the windows in view they would all go to their group's task
        bins = saved(vectors.join(now, "gid").groupBy(*keys, _bin().alias("bin")).agg(*_moments()), f"mcd-bins{step}", small=True)
        bins = bins.withColumn("below", F.sum("n").over(order) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
        nearest = bins.filter(F.col("below") < F.ceil(F.col("all") * SHARE)).groupBy(*keys).agg(*_resummed())
        now = saved(_estimate(nearest, keys, concentrated), f"mcd-step{step}", small=True)
    best = now.groupBy("gid").agg(F.min(F.struct("logdet", "start")).alias("b")).select("gid", F.col("b.start").alias("start"))
    raw = saved(now.join(best, keys).drop("start"), "mcd-raw", small=True)
    cut = chi2_quantile(0.975, DIMS)
    near = vectors.join(raw, "gid").filter(_distance() <= cut).groupBy("gid").agg(*_moments())
    return saved(_estimate(near, ["gid"], 0.975 / _gamma_p(DIMS / 2 + 1, cut / 2)), "mcd", small=True)


def _judged(docs: DataFrame, carried: tuple[str, ...] = (), min_group: int = MIN_GROUP, confidence: float = CONFIDENCE) -> DataFrame:
    """Each row's doc_id, the columns carried along, counts, base_failed, its squared distance d2 (null: rules alone) and kept."""
    stats = statistics(docs, carried)
    columns = {c: F.col(c) for c in ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    stats = stats.select("*", *(x.alias(_X[i]) for i, x in enumerate(vector(columns))))
    own, pooled = (F.to_json(F.struct(*c), {"ignoreNullFields": "false"}) for c in (("lang", "source"), ("lang",)))  # never equal, as only one names a source
    stats = saved(stats.withColumns({"own": own, "pooled": pooled}).drop("lang", "source"), "quality")
    usable = stats.filter(~F.col("base_failed"))
    large = saved(usable.groupBy("own").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_group).select("own", F.lit(True).alias("large")), "quality-groups", small=True)
    grouped = stats.join(large, "own", "left").withColumn("gid", F.when(F.col("large"), F.col("own")).otherwise(F.col("pooled"))).drop("own", "pooled", "large")
    vectors = grouped.filter(~F.col("base_failed")).select("gid", *_X)
    enough = vectors.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= 4 * DIMS).select("gid")
    found = estimates(vectors).join(enough, "gid", "left_semi")
    judged = grouped.join(found, "gid", "left").withColumn("d2", _distance())
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(confidence, DIMS))
    return judged.withColumn("kept", verdict)


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP, confidence: float = CONFIDENCE) -> DataFrame:
    """Each row's counts, base_failed, its squared distance d2 (null: rules alone) and kept."""
    return _judged(docs, (), min_group, confidence).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "n_lines")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, each by its own verdict: rows are written whole beside their counts, and read again."""
    whole = docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    return _judged(whole, ("_row",)).filter("kept").select("_row.*")


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
