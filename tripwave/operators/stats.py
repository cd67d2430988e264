"""Two-sample and rank statistics, effect sizes, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tripwave.functions.exprs import ratio
from tripwave.operators.aggregates import attach_one, long_form
from tripwave.operators.ordered import Axis, range_chunks, running
from tripwave.operators.reconcile import mutual_nearest


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson r, RMSE and MAE over the rows where both columns are known, and their number."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y, d = F.when(both, F.col(a)), F.when(both, F.col(b)), F.col(a) - F.col(b)
    return df.groupBy(*by).agg(
        F.count(d).alias("n"),
        ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("pearson"),
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def align_pipelines(left: DataFrame, right: DataFrame, key: str, ident: str, at: str, value: str, tolerance: int) -> DataFrame:
    """Two processings of one recording, row by row: ``ident``, ``other``, ``dt``, ``x``, ``y``.

    Rows pair with the closest in time of the same trip, each with one partner (``mutual_nearest``), so streams of other
    rates, with jitter or holes, can be held against each other.
    """
    a = left.select(key, F.col(ident).alias("ident"), F.col(at).alias("_at"), F.col(value).alias("x"))
    b = right.select(key, F.col(ident).alias("other"), F.col(at).alias("_other_at"), F.col(value).alias("y"))
    pairs = mutual_nearest(a.drop("x"), b.drop("y"), key, "ident", "_at", "other", "_other_at", tolerance)
    return pairs.join(a.drop("_at"), [key, "ident"]).join(b.drop("_other_at"), [key, "other"])


def pipeline_agreement(pairs: DataFrame) -> DataFrame:
    """One row: number of pairs, mean distance in time, Pearson r, RMSE, MAE, and the Kolmogorov-Smirnov distance with its p."""
    both = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    sides = both.select(F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v")),
                                          F.struct(F.lit("y").alias("side"), F.col("y").alias("v")))).alias("_s")).select("_s.*")
    ks = ks_two_sample(sides, "side", "x", "y", "v").select("d", "p")
    dt = pairs.agg(F.avg("dt").alias("mean_dt"))
    return attach_one(attach_one(agreement(both, "x", "y"), dt), ks)


def ks_two_sample(df: DataFrame, group: str, a: object, b: object, value: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of two groups and its asymptotic p-value."""
    counts = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(
        F.count_if(F.col(group) == F.lit(a)).alias("_a"), F.count_if(F.col(group) == F.lit(b)).alias("_b"))
    ranged = range_chunks(counts, [value])
    steps = running(ranged, Axis((), (value,), None), {"_ca": F.col("_a"), "_cb": F.col("_b")})
    sizes = ranged.agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    gaps = attach_one(steps, sizes).withColumn("_d", F.abs(F.col("_ca") / F.col("n_a") - F.col("_cb") / F.col("n_b")))
    out = gaps.groupBy("n_a", "n_b").agg(F.max("_d").alias("d"))
    lam = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))) * F.col("d")
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam) for k in range(1, 101)), F.lit(0.0))
    return out.withColumn("p", F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (rational approximation, absolute error below 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def kruskal(df: DataFrame, label: str, classes: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Kruskal-Wallis H over two or three classes per feature, with tie correction and p-value."""
    rows = long_form(df.where(F.col(label).isin(*classes)), [label], features).where(F.col("value").isNotNull())
    counts = rows.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("_t"), *[F.count_if(F.col(label) == c).alias(f"_n{i}") for i, c in enumerate(classes)])
    ranged = range_chunks(counts, ["feature", "value"])
    ranked = running(ranged, Axis(("feature",), ("value",), None), {"_upto": F.col("_t")})
    rank = F.col("_upto") - F.col("_t") + (F.col("_t") + 1) / 2.0
    t = F.col("_t").cast("double")
    sums = ranked.groupBy("feature").agg(
        F.sum(t).alias("n"), F.sum(t * t * t - t).alias("_ties"),
        *[F.sum(F.col(f"_n{i}")).alias(f"_n{i}") for i in range(len(classes))],
        *[F.sum(F.col(f"_n{i}") * rank).alias(f"_r{i}") for i in range(len(classes))])
    n = F.col("n")
    between = sum((ratio(F.col(f"_r{i}") * F.col(f"_r{i}"), F.col(f"_n{i}")) for i in range(len(classes))), F.lit(0.0))
    present = sum(((F.col(f"_n{i}") > 0).cast("int") for i in range(len(classes))), F.lit(0))
    raw = 12 / (n * (n + 1)) * between - 3 * (n + 1)
    h = F.try_divide(raw, 1 - F.col("_ties") / (n * n * n - n))
    out = sums.select("feature", n.cast("bigint").alias("n"), present.alias("n_classes"),
                      F.when(present >= 2, h).alias("h"))
    p = F.when(F.col("n_classes") == 3, F.exp(-F.col("h") / 2)).when(
        F.col("n_classes") == 2, erfc(F.sqrt(F.greatest(F.col("h"), F.lit(0.0)) / 2)))
    return out.withColumn("p", p)


def cohens_d(df: DataFrame, label: str, classes: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Pairwise effect sizes with pooled sample variance."""
    rows = long_form(df, [label], features)
    pick = {c: F.when(F.col(label) == c, F.col("value")) for c in classes}
    stats = rows.groupBy("feature").agg(*[
        f(x).alias(f"_{k}{i}") for i, x in enumerate(pick.values())
        for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    cells = []
    for i, a in enumerate(classes):
        for j in range(i + 1, len(classes)):
            ni, nj = F.col(f"_n{i}"), F.col(f"_n{j}")
            pooled = ((ni - 1) * F.col(f"_v{i}") + (nj - 1) * F.col(f"_v{j}")) / (ni + nj - 2)
            d = F.when((ni >= 2) & (nj >= 2), F.when(pooled <= 1e-12, F.lit(0.0)).otherwise(
                (F.col(f"_m{i}") - F.col(f"_m{j}")) / F.sqrt(pooled)))
            cells.append(F.struct(F.lit(a).alias("class_a"), F.lit(classes[j]).alias("class_b"), d.alias("d")))
    return stats.select("feature", F.explode(F.array(*cells)).alias("_c")).select("feature", "_c.*")


def effect_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("feature").agg(F.max(F.abs(F.col("d"))).alias("max_abs_d"), F.avg(F.abs(F.col("d"))).alias("mean_abs_d"))


def pca2(df: DataFrame, ids: Sequence[str], features: Sequence[str], relative_error: float = 0.001) -> DataFrame:
    """Two principal components after median imputation and standardisation; the largest loading is positive."""
    num = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    filled = Imputer(strategy="median", inputCols=list(features), outputCols=list(features),
                     relativeError=relative_error).fit(num).transform(num)
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(filled)
    scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(vectors).transform(vectors)
    model = PCA(k=2, inputCol="_z", outputCol="_pc").fit(scaled)
    loadings = model.pc.toArray()  # features x 2
    signs = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loadings.T]
    pc = vector_to_array("_pc")
    return model.transform(scaled).select(*ids, (pc[0] * signs[0]).alias("pc1"), (pc[1] * signs[1]).alias("pc2"))
