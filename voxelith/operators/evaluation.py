"""Evaluation of ranked sites: best in top n, hit curves, category sums, intervals, ranking quality."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.staging import staged

CURVE = (1, 3, 5, 10, 20)


def best_in_top(results: DataFrame, keys: Sequence[str], value: str, n: int, rank: str = "rank") -> DataFrame:
    """Best value among the first n ranks and its rank; the first best wins, and no rank is given for 0."""
    best = results.where(F.col(rank) <= n).groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(rank)).alias("r"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias("best"), F.when(F.col("b.v") > 0, -F.col("b.r")).alias("best_rank"))


def hit_curve(results: DataFrame, keys: Sequence[str], hit: Column, ks: Sequence[int] = CURVE, rank: str = "rank") -> DataFrame:
    """Whether any of the first k ranks is a hit, for each k; one aggregate."""
    return results.groupBy(*keys).agg(*(F.coalesce(F.max(F.when(F.col(rank) <= k, hit)), F.lit(False)).alias(f"top{k}") for k in ks))


def hit_map(curve: DataFrame, keys: Sequence[str], ks: Sequence[int] = CURVE) -> DataFrame:
    """keys and topk_hit: hit_curve's columns as one map from k to whether the first k hold a hit."""
    return curve.select(*keys, F.map_from_arrays(F.array(*map(F.lit, ks)), F.array(*(F.col(f"top{k}") for k in ks))).alias("topk_hit"))


def curve_summary(curve: DataFrame, ks: Sequence[int] = CURVE) -> DataFrame:
    """k and the share of rows hit."""
    rates = curve.agg(*(F.avg(F.col(f"top{k}").cast("double")).alias(f"top{k}") for k in ks))
    return rates.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"top{k}", F.lit(0.0)).alias("rate")) for k in ks))).alias("r")).select("r.*")


def threshold_sweep(results: DataFrame, value: str, thresholds: Sequence[float] = (0.20, 0.25, 0.30), keys: Sequence[str] = ()) -> DataFrame:
    """How many rows reach each threshold."""
    return results.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col(value) >= t).alias(f"ge_{round(t * 100)}") for t in thresholds))


def rollup_hits(results: DataFrame, category: str, hit: Column, *strata: str) -> DataFrame:
    """Hits and rows of each category, of each stratum in it (as mechanisms), and of all as ALL."""
    levels = [category, *strata]
    flat = results.select(*(F.coalesce(c, F.lit("none")).alias(c) for c in levels), hit.alias("_hit"))
    sums = flat.rollup(*levels).agg(F.count_if("_hit").alias("hits"), F.count("*").alias("n"))
    return sums.select(*(F.coalesce(c, F.lit("ALL")).alias(c) for c in levels), "hits", "n")


def chosen_targets(targets: DataFrame, key: str, category: str | None = None, ids: DataFrame | Sequence | None = None, limit: int | None = None) -> DataFrame:
    """Targets of a category, of a list or table of ids, and of those the first `limit` by key."""
    out = targets if category is None else targets.where(F.col("category") == category)
    if isinstance(ids, DataFrame):
        out = out.join(ids.select(key), key, "left_semi")
    elif ids is not None:
        out = out.where(F.col(key).isin(list(ids)))
    return out if limit is None else out.orderBy(key).limit(limit)


def join_folds(folds: DataFrame, dataset: DataFrame) -> DataFrame:
    """The dataset's rows of each fold (fold, id); ids that the dataset lacks are skipped."""
    return folds.join(dataset, "id")


def fold_counts(folds: DataFrame, dataset: DataFrame) -> DataFrame:
    """fold, found, skipped: how many ids of each fold the dataset has and lacks."""
    there = dataset.select("id").distinct().withColumn("_there", F.lit(True))
    return folds.join(there, "id", "left").groupBy("fold").agg(F.count("_there").alias("found"), F.count_if(F.col("_there").isNull()).alias("skipped"))


def complementarity(legs: DataFrame, key: str, tool: str, hit: Column, tools: Sequence[str]) -> DataFrame:
    """Complete cases of all tools: each one's hits, its own alone, none, union, and the best single."""
    wide = legs.groupBy(key).pivot(tool, list(tools)).agg(F.max(hit.cast("int")))
    full = wide.dropna()
    total = sum((F.col(t) for t in tools[1:]), F.col(tools[0]))
    sums = full.agg(
        F.count("*").alias("n"),
        *(F.coalesce(F.sum(t), F.lit(0)).alias(f"hits_{t}") for t in tools),
        *(F.count_if((F.col(t) == 1) & (total == 1)).alias(f"only_{t}") for t in tools),
        F.count_if(total == 0).alias("none"),
        F.count_if(total > 0).alias("any"),
    )
    return sums.withColumn("best_single", F.greatest(*(F.col(f"hits_{t}") for t in tools)) if len(tools) > 1 else F.col(f"hits_{tools[0]}"))


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, "_v.*")


def running_rate(results: DataFrame, order: Sequence[str], hit: Column, partition: Sequence[str] = ()) -> DataFrame:
    """Adds rate: the share of hits so far in processing order.

    Without a partition the order is dealt into ranges, whose counts, a row a
    partition, are summed up first, so that no task sees all rows.
    """
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return results.withColumn("rate", F.avg(hit.cast("double")).over(w))
    n = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(results.withColumn("_hit", hit.cast("double")).repartitionByRange(n, *order).withColumn("_piece", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_piece").agg(F.sum("_hit").alias("_h"), F.count("_hit").alias("_n"))
    bases = totals.select("_piece", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in ("_h", "_n")))
    within = Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hits, rows = F.col("_before_h") + F.coalesce(F.sum("_hit").over(within), F.lit(0.0)), F.col("_before_n") + F.count("_hit").over(within)
    return dealt.join(F.broadcast(bases), "_piece").select(*results.columns, F.when(rows > 0, hits / rows).alias("rate"))


def principal_group(atoms: DataFrame, keys: Sequence[str], group: str, position: str) -> DataFrame:
    """The group with most rows, the first seen on ties."""
    counts = atoms.groupBy(*keys, group).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(group, "n"), F.struct("n", -F.col("first"))).alias("b")).select(*keys, "b.*")


def main_association(rows: DataFrame, keys: Sequence[str], flag: str, value: str, keep: Sequence[str]) -> DataFrame:
    """The flagged row of each key, else that with the largest value."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(F.coalesce(F.col(flag).cast("int"), F.lit(0)), value)).alias("b")).select(*keys, "b.*")


def bootstrap(results: DataFrame, hit: str, keys: Sequence[str] = (), resamples: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """mean, lo, hi of a share by resampling.

    The hits of a resample of n rows with p hits are binomial, so a group's
    counts are all that is gathered: rows are neither copied nor collected.
    """
    sums = results.groupBy(*keys).agg(F.count(hit).alias("n"), F.count_if(F.col(hit)).alias("p"))
    lo, hi = int(alpha / 2 * resamples), int((1 - alpha / 2) * resamples) - 1

    @F.pandas_udf("struct<mean: double, lo: double, hi: double>")
    def interval(n, p):
        import numpy as np
        import pandas as pd

        rows = []
        for a, b in zip(n.tolist(), p.tolist(), strict=True):
            if not a:
                rows.append((0.0, 0.0, 0.0))
                continue
            s = np.sort(np.random.default_rng((seed, a, b)).binomial(a, b / a, resamples)) / a
            rows.append((b / a, float(s[lo]), float(s[hi])))
        return pd.DataFrame(rows, columns=["mean", "lo", "hi"])

    return sums.withColumn("_ci", interval("n", "p")).select(*keys, "n", "_ci.*")


#: A prime under 2**28: the weights of a resample come from numbers below it.
_PRIME = 268435399
#: Where the cumulated shares of Poisson(1) lie among them: a number at or above k of these weighs k.
_POISSON = tuple(int(_PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9))


def resample_number(key: Column, resample: Column, seed: int = 0) -> Column:
    """A number below _PRIME for a row and resample, linear in the resample, from the MD5 of the row's key."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    a, b = (F.conv(F.substring(h, at, 7), 16, 10).cast("long") for at in (1, 8))
    return (a + b * resample) % _PRIME


def resample_weight(key: Column, resample: Column, seed: int = 0) -> Column:
    """How often a resample (from 1) draws the row: Poisson(1), the same on any cluster; independent between rows and pairwise between resamples."""
    h = resample_number(key, resample, seed)
    return sum((F.when(h >= t, 1).otherwise(0) for t in _POISSON[1:]), F.when(h >= _POISSON[0], 1).otherwise(0))


def resample_weight_sql(key: str, resample: str, seed: int = 0) -> str:
    """resample_weight in DuckDB's SQL."""
    h = f"md5({key}::varchar || ':{seed}')"
    number = f"((('0x' || {h}[1:7])::bigint + ('0x' || {h}[8:14])::bigint * {resample}) % {_PRIME})"
    return "(" + " + ".join(f"({number} >= {t})::int" for t in _POISSON) + ")"


def bootstrap_sums(rows: DataFrame, key: str, values: Mapping[str, Column], keys: Sequence[str] = (), resamples: int = 2000, seed: int = 0) -> DataFrame:
    """keys, resample (0: the rows themselves), n and the weighted sum of each value: a Poisson bootstrap.

    Each row draws its weights in all resamples from a hash of its key, so it
    is read once and never copied; a task adds up what it reads and sends one
    row a group and resample. Rows with a null among the values or a null key
    are left out: values of one row, as of two tools on a target, stay together.
    """
    import numpy as np

    names = list(values)
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    number = [F.conv(F.substring(h, at, 7), 16, 10).cast("long").alias(n) for n, at in (("_a", 1), ("_b", 8))]
    flat = rows.select(*keys, *number, *(c.cast("double").alias(f"_v{i}") for i, c in enumerate(values.values()))).dropna(subset=["_a", *(f"_v{i}" for i in range(len(names)))])
    kinds = dict(flat.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "resample int", "n double", *(f"`{n}` double" for n in names)])
    held = max(1, (64 << 20) // (8 * (resamples + 1) * (len(names) + 1)))  # groups at a time: 64 MB

    def run(frames):
        import pandas as pd

        sums: dict[tuple, np.ndarray] = {}

        def out():
            for k, v in sums.items():
                pdf = pd.DataFrame({"resample": np.arange(resamples + 1, dtype=np.int32), "n": v[:, 0]} | {n: v[:, i + 1] for i, n in enumerate(names)})
                for j, name in reversed(list(enumerate(keys))):
                    pdf.insert(0, name, [k[j]] * len(pdf))
                yield pdf
            sums.clear()

        steps = np.arange(1, resamples + 1)
        for pdf in frames:
            groups = pdf.groupby(list(keys), dropna=False, sort=False) if keys else [((), pdf)]
            for k, part in groups:
                k = tuple(None if x is None or x != x else x for x in (k if isinstance(k, tuple) else (k,)))
                if k not in sums and len(sums) >= held:
                    yield from out()
                total = sums.setdefault(k, np.zeros((resamples + 1, len(names) + 1)))
                data = np.column_stack([np.ones(len(part)), *(part[f"_v{i}"].to_numpy() for i in range(len(names)))])
                a, b = part["_a"].to_numpy(), part["_b"].to_numpy()
                total[0] += data.sum(axis=0)
                for at in range(0, len(part), 1024):
                    to = at + 1024
                    weight = np.searchsorted(_POISSON, (a[at:to] + b[at:to] * steps[:, None]) % _PRIME, side="right")
                    total[1:] += weight @ data[at:to]
        yield from out()

    return flat.mapInPandas(run, schema).groupBy(*keys, "resample").agg(*(F.sum(n).alias(n) for n in ("n", *names)))


def bootstrap_interval(sums: DataFrame, statistic: Column, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """keys, n, value, lo, hi of any statistic of the weighted sums (columns n and the values' names).

    Of m resamples in order, lo is the one at place m * alpha / 2 and hi that
    before m * (1 - alpha / 2), rounded down. Resamples where the statistic is
    null (no row drawn) do not count.
    """
    each = sums.withColumn("_s", statistic)
    found = each.groupBy(*keys).agg(F.max(F.when(F.col("resample") == 0, F.col("n"))).cast("long").alias("n"), F.max(F.when(F.col("resample") == 0, F.col("_s"))).alias("value"), F.array_sort(F.collect_list(F.when(F.col("resample") > 0, F.col("_s")))).alias("_all"))
    m = F.size("_all")
    at = lambda i: F.get("_all", F.greatest(i.cast("int"), F.lit(0)))
    return found.select(*keys, "n", "value", at(F.floor(m * (alpha / 2))).alias("lo"), at(F.floor(m * (1 - alpha / 2)) - 1).alias("hi"))


def top_k_recall(scored: DataFrame, group: str, label: Column, score: str, k: int, tie: str) -> DataFrame:
    """Share of groups with a positive among their k best, and the share that has any."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    best = scored.withColumn("_r", F.row_number().over(w)).groupBy(group).agg(F.max((label & (F.col("_r") <= k)).cast("int")).alias("hit"), F.max(label.cast("int")).alias("reachable"))
    return best.agg(F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg("reachable"), 6).alias("ceiling"))


def seeded_order(key: str, seed: int = 0) -> list[Column]:
    """Columns that order rows as a seeded shuffle does, the same on any cluster."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)]


def numbered_rows(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds the number (from 0) of each row in a total order, without one task that sees them all.

    Rows are dealt into ranges of the order, which are written once; the counts
    of the ranges, a row a partition, are summed up, then rows within.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(n, *order).withColumn("_piece", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("_piece").agg(F.count("*").alias("_n")).select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_piece").orderBy(*order)) - 1
    return dealt.join(F.broadcast(bases), "_piece").withColumn(name, F.col("_base") + within).drop("_piece", "_base")


def permutation_importance(model, features: DataFrame, columns: Sequence[str], label: Column, score, key: str, seed: int = 0) -> DataFrame:
    """feature and fall: how far the AUC falls when a feature's values are dealt anew among all rows.

    score is the model's score as a column of model.transform's result. key
    numbers the rows; values are dealt by joining the numbers of the rows in
    order of key with those in the seeded order of key, so the permutation is of
    the whole table, and the same on any cluster.
    """
    own = staged(numbered_rows(features, [key], "_k"), "numbered")
    base = auc(model.transform(own).withColumn("_score", score), label, "_score").first()["auc"]
    found = []
    for n, c in enumerate(columns):
        dealt = numbered_rows(features.select(key, F.col(c).alias("_v")), seeded_order(key, seed + n), "_k").select("_k", "_v")
        mixed = own.join(dealt, "_k").withColumn(c, F.col("_v")).drop("_v")
        one = auc(model.transform(mixed).withColumn("_score", score), label, "_score").first()["auc"]
        found.append((c, None if base is None or one is None else round(base - one, 6)))
    return features.sparkSession.createDataFrame(found, "feature string, fall double")


def _sums_before(counts: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds, under the names of `sums`, the sum of a column over all rows that come earlier in the order.

    Rows are dealt into ranges and written once; the totals of the ranges, a
    row a partition, are summed up first, then each range within.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(counts.repartitionByRange(n, order).withColumn("_piece", F.spark_partition_id()), "counts")
    way = F.desc if descending else F.asc
    earlier = Window.orderBy(way("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_piece").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_piece").agg(*(F.sum(c).alias(f"_all{c}") for c in sums.values()))
    bases = totals.select("_piece", *(F.coalesce(F.sum(f"_all{c}").over(earlier), F.lit(0)).alias(f"_base{c}") for c in sums.values()))
    out = dealt.join(F.broadcast(bases), "_piece")
    return out.select(*counts.columns, *((F.col(f"_base{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in sums.items()))


def auc(scored: DataFrame, label: Column, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums with mean ranks on ties.

    Counts by distinct score come first, so that the running sum is over
    distinct scores alone.
    """
    counts = scored.groupBy(F.col(score).alias("_s")).agg(F.count_if(label).alias("_p"), F.count_if(~label).alias("_n"))
    pairs = _sums_before(counts, "_s", {"_b": "_n"})
    return pairs.agg(F.round(F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2)) / (F.sum("_p") * F.sum("_n")), 6).alias("auc"))


def average_precision(scored: DataFrame, label: Column, score: str) -> DataFrame:
    """Mean precision at each recall step, over distinct scores from the top."""
    counts = scored.groupBy(F.col(score).alias("_s")).agg(F.count_if(label).alias("_p"), F.count("*").alias("_c"))
    before = _sums_before(counts, "_s", {"_pb": "_p", "_cb": "_c"}, descending=True)
    steps = before.select("_p", ((F.col("_pb") + F.col("_p")) / (F.col("_cb") + F.col("_c"))).alias("_precision"))
    return steps.agg(F.round(F.sum(F.col("_p") * F.col("_precision")) / F.sum("_p"), 6).alias("average_precision"))


def cluster_features(clusters: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Member means and maxima, volume ranges and rank share: the features of a re-ranker."""
    agg = members.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in ("enclosure", "hydrophobic_fraction", "aromatic_count") for n, f in (("mean", F.avg), ("max", F.max))), F.count("*").alias("n_members"))
    out = clusters.join(agg.drop("n_members") if "n_members" in clusters.columns else agg, list(keys))
    w = Window.partitionBy(*(k for k in keys if k != "cluster_id"))
    return out.withColumns({"volume_range": F.col("volume_max") - F.col("volume_min"), "open_gain": F.col("volume_max") - F.col("apo_volume"), "rank_fraction": F.col("rank") / F.count("*").over(w)})


def fit_reranker(features: DataFrame, columns: Sequence[str], label: str = "label", iterations: int = 400, step: float = 0.05, group: str | None = None, held_out: int = 10, tolerance: float = 0.01):
    """A boosted-tree pipeline over feature columns with balanced class weights; save it with its own writer.

    group: the column (a protein) whose rows stay together when one in
    `held_out` groups, by the hash of their names, is kept for validation:
    trees are grown until the error on those has stopped falling by more than
    tolerance, `iterations` at most. Without a group, or where one side of the
    split is empty, all are grown on all rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    share = features.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    weighted = features.withColumn("_w", F.when(F.col(label) == 1, F.lit(0.5 / max(share, 1e-9))).otherwise(F.lit(0.5 / max(1 - share, 1e-9)))).withColumn("_y", F.col(label).cast("double"))
    trees = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=iterations, stepSize=step, seed=7, validationTol=tolerance)
    if group is not None:
        kept = F.pmod(F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 7), 16, 10).cast("long"), F.lit(held_out)) == 0
        weighted = weighted.withColumn("_held", F.coalesce(kept, F.lit(False)))
        if weighted.select("_held").distinct().count() == 2:
            trees = trees.setValidationIndicatorCol("_held")
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="keep"), trees]).fit(weighted)


def trees_grown(model) -> int:
    """How many trees a fitted, or saved and loaded, re-ranker has: the round at which it stopped."""
    return model.stages[-1].getNumTrees
