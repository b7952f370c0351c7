"""Metrics, intervals and gates over answers, and the samples they come from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gaugeworks.functions.scalars import parse_answer, salted_hash, trend_code
from gaugeworks.spec import PATTERNS, WINDOW


def support(labels: DataFrame, label: str, device: str, cutoff: str) -> DataFrame:
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("support"), F.count_distinct(device).alias("devices"), F.min(cutoff).alias("first_cutoff"), F.max(cutoff).alias("last_cutoff"))


def class_weights(counts: DataFrame, label: str, n: str, low: float = 0.1, high: float = 30.0) -> DataFrame:
    """total / (5 * max(n, 1)), clipped, for every pattern (those without rows too)."""
    every = counts.sparkSession.createDataFrame([(p,) for p in PATTERNS], f"{label} string")
    all_ = every.join(counts.select(label, n), label, "left").withColumn(n, F.coalesce(n, F.lit(0)))
    total = all_.agg(F.sum(n).alias("_total"))
    return all_.crossJoin(total).select(label, n, F.greatest(F.lit(low), F.least(F.lit(high), F.col("_total") / (len(PATTERNS) * F.greatest(n, F.lit(1))))).alias("weight"))  # total is one row


def views(windows: DataFrame, values: str, key: str) -> DataFrame:
    """Three views of each window with weights 2, 1, 1: as it is, reversed, and in a hash order of its places."""
    natural = windows.withColumn("view", F.lit("natural")).withColumn("weight", F.lit(2))
    back = windows.withColumn(values, F.reverse(values)).withColumn("view", F.lit("reversed")).withColumn("weight", F.lit(1))
    mixed = permuted(windows, values, key).withColumn("view", F.lit("shuffled")).withColumn("weight", F.lit(1))
    return natural.unionByName(back).unionByName(mixed)


def permuted(windows: DataFrame, values: str, key: str, seed: int = 612) -> DataFrame:
    """The values in the order of a hash of key and place: a permutation that every engine finds."""
    tagged = F.transform(values, lambda x, i: F.struct(salted_hash(f"{seed}:", F.concat_ws("|", F.col(key).cast("string"), i.cast("string"))).alias("h"), x.alias("x")))
    return windows.withColumn(values, F.transform(F.array_sort(tagged), lambda t: t["x"]))


def permuted_numpy(windows: DataFrame, values: str, seed: int = 612) -> DataFrame:
    """The same with NumPy's generator, one permutation for the window length, for parity with arrays made elsewhere."""
    order = np.random.default_rng(seed).permutation(WINDOW).tolist()
    return windows.withColumn(values, F.array(*(F.get(values, F.lit(i)) for i in order)))


@F.pandas_udf(ArrayType(DoubleType()))
def _in_draw(place: pd.Series, values: pd.Series, seed: pd.Series) -> pd.Series:
    """The values in the order of the ``place``-th permutation that a generator of ``seed`` draws."""
    out = []
    for k, v, s in zip(place, values, seed, strict=True):
        if k is None or v is None or k != k:
            out.append(None)
            continue
        rng, drawn = _drawn.setdefault(s, (np.random.default_rng(s), []))
        while len(drawn) <= k:
            drawn.append(rng.permutation(WINDOW))
        out.append(v[drawn[int(k)]] if len(v) == WINDOW else None)
    return pd.Series(out)


_drawn: dict = {}


def permuted_in_order(windows: DataFrame, values: str, place: str, seed: int = 612) -> DataFrame:
    """As NumPy permutes examples one after another: that at ``place`` (from 0) gets the generator's draw of that number.

    A worker draws as far as its last place, so this is for evaluation sets of some 100,000
    examples at most; ``permuted`` has no such cost. Null values, places or other lengths than a window's give null.
    """
    return windows.withColumn(values, _in_draw(F.col(place).cast("long"), F.col(values).cast("array<double>"), F.lit(seed)))


def first_batches(rows: DataFrame, order: list[str], least: int = 8192) -> DataFrame:
    """The rows of the first batches, by ``order`` (their key), that have ``least`` rows or more together; all rows, if there are fewer.

    Each batch has a row at least, so the sum runs over the first ``least`` batches and not over all.
    """
    sizes = rows.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")).orderBy(*order).limit(least)
    before = F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    taken = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < least)
    return rows.join(taken.select(*order), order, "left_semi")


def zeroed(windows: DataFrame, values: str) -> DataFrame:
    return windows.withColumn(values, F.transform(values, lambda x: F.lit(0.0)))


def augmentation(key: Column | str, epoch: int, seed: int) -> Column:
    """original below 128 of the first digest byte, reversed below 192, else shuffled; epoch 0 is original."""
    if epoch == 0:
        return F.lit("original")
    key = F.col(key) if isinstance(key, str) else key
    byte = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), key), 256), 1, 2), 16, 10).cast("int")
    return F.when(byte < 128, "original").when(byte < 192, "reversed").otherwise("shuffled")


def relabelled(windows: DataFrame, values: str, band: float, counter: bool) -> DataFrame:
    return windows.withColumn("code", trend_code(values, band, counter))


def scored(examples: DataFrame, key: str, channels: str, target: str, output: str) -> DataFrame:
    """One row per example and channel: actual, predicted (INVALID for an answer that breaks the rubric), valid."""
    answer, truth = parse_answer(output, channels), parse_answer(target, channels)
    parsed = examples.withColumn("_a", answer).withColumn("_t", truth)
    each = parsed.select(key, F.col("_a").isNotNull().alias("valid"), F.explode(channels).alias("channel"), "_a", "_t")
    got = F.coalesce(F.try_element_at("_a", F.col("channel")), F.lit("INVALID"))
    return each.select(key, "valid", "channel", F.element_at("_t", F.col("channel")).alias("actual"), got.alias("predicted"))


def class_metrics(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(class, support, precision, recall, f1); undefined ratios are 0. One aggregate over pairs, whatever the number of rows."""
    pairs = rows.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.lit(1).alias("gold"), (F.col("a") == F.col("p")).cast("int").alias("hit"), F.lit(0).alias("said"), F.col("n").alias("n")), F.struct(F.col("p").alias("class"), F.lit(0).alias("gold"), F.lit(0).alias("hit"), F.lit(1).alias("said"), F.col("n").alias("n")))).alias("s")).select("s.*")
    total = sides.groupBy("class").agg(F.sum(F.col("gold") * F.col("n")).alias("support"), F.sum(F.col("hit") * F.col("n")).alias("tp"), F.sum(F.col("said") * F.col("n")).alias("said"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return total.select("class", "support", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("said")).alias("f1"))


def summary(rows: DataFrame, key: str) -> DataFrame:
    """Channel and exact-window accuracy, valid rate, and precision and recall of change."""
    per = rows.groupBy(key).agg(F.bool_and(F.col("actual") == F.col("predicted")).alias("exact"), F.bool_and("valid").alias("valid"), F.sum((F.col("actual") == F.col("predicted")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n"),
                                F.count_if((F.col("actual") != "constant") & ~F.col("predicted").isin("constant", "INVALID")).alias("tp"), F.count_if(~F.col("predicted").isin("constant", "INVALID")).alias("said"), F.count_if(F.col("actual") != "constant").alias("gold"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    return per.agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("channel_labels"), F.avg(F.col("valid").cast("int")).alias("valid_output_rate"), F.avg(F.col("exact").cast("int")).alias("exact_window_accuracy"),
                   ratio("right", "n").alias("channel_accuracy"), ratio("tp", "said").alias("changed_channel_precision"), ratio("tp", "gold").alias("changed_channel_recall"))


def weighted_support(windows: DataFrame, values: str, key: str, band: float = 1.0, counter: bool = False) -> DataFrame:
    """(code, windows, support): each pattern's windows over the three views, and the sum of their weights; each view is labelled anew."""
    each = relabelled(views(windows, values, key), values, band, counter)
    return each.groupBy("code").agg(F.count(F.lit(1)).alias("windows"), F.sum("weight").alias("support"))


def macro(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(classes, macro_f1): the mean F1 of the classes that occur as an actual one."""
    return class_metrics(rows, actual, predicted).where("support > 0").agg(F.count(F.lit(1)).alias("classes"), F.avg("f1").alias("macro_f1"))


def paired(first: DataFrame, second: DataFrame, key: str, score: str) -> DataFrame:
    """(key, first, second): scores of the same example; one that a side lacks is fatal."""
    both = first.select(key, F.col(score).alias("first")).join(second.select(key, F.col(score).alias("second")), key, "full")
    whole = F.col("first").isNotNull() & F.col("second").isNotNull()
    return both.withColumn("first", F.when(whole, F.col("first")).otherwise(F.raise_error(F.lit("an example has one score only")).cast("double")))


def group_means(rows: DataFrame, group: str, score: str) -> DataFrame:
    return rows.groupBy(group).agg(F.avg(score).alias(score))


def sign_test(gains: DataFrame, gain: str) -> DataFrame:
    """(groups, mean_gain, probability): the share of all 2**n sign patterns whose mean gain reaches the observed one; 1 to 12 groups.

    The groups are few by contract, so their gains make one array, and the
    patterns are rows.
    """
    all_ = gains.agg(F.sort_array(F.collect_list(F.col(gain).cast("double"))).alias("d")).where(F.size("d").between(1, 12))
    mean = F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")
    each = all_.withColumn("observed", mean).withColumn("m", F.explode(F.expr("sequence(0, shiftleft(1, size(d)) - 1)")))
    signed = F.expr("aggregate(transform(d, (x, i) -> if(bit_get(cast(m as bigint), i) = 1, x, -x)), 0.0D, (a, x) -> a + x) / size(d)")
    return each.withColumn("s", signed).groupBy(F.size("d").alias("groups"), F.col("observed").alias("mean_gain")).agg(F.avg((F.col("s") >= F.col("observed") - 1e-9).cast("int")).alias("probability"))


#: Pairs of a leaf, on average, and draws that a leaf makes at a time.
LEAF_PAIRS, DRAWN = 16_384, 1 << 22


def bootstrap_interval(pairs: DataFrame, first: str, second: str, order: str, draws: int = 2000, seed: int = 42, leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """(low, high): the 2.5 and 97.5 % quantiles of means of resampled differences.

    Pairs fall into leaves of a binary tree by a hash of ``order``. How many of a resample's n
    draws a leaf gets is found from the root down: each node splits its draws between its
    children by a binomial of their pair counts, from a generator seeded by the node.
    A leaf draws its share from its own pairs, and the sums of leaves add up. So no task
    holds all pairs, and the same pairs give the same interval however they are partitioned.
    """
    value = (F.col(first).cast("double") - F.col(second).cast("double")).alias("d")
    rows = pairs.select(value, F.col(order).alias("o")).withColumn("h", F.xxhash64("o"))
    n = rows.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf_pairs)))) if n else 0
    leafed = rows.withColumn("leaf", F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long"))
    sizes = leafed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    # the counts of the nodes on the way to a leaf, and of their left children
    level = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    nodes = sizes.withColumn("level", level).withColumn("node", F.expr(f"shiftright(leaf, {depth} - level)")).groupBy("level", "node").agg(F.sum("n").alias("m"))
    left = nodes.select((F.col("level") - 1).alias("level"), F.expr("shiftright(node, 1)").alias("node"), F.when(F.col("node") % 2 == 0, F.col("m")).otherwise(0).alias("lm")).groupBy("level", "node").agg(F.sum("lm").alias("left"))
    way = sizes.withColumn("level", level).withColumn("node", F.expr(f"shiftright(leaf, {depth} - level)")).join(nodes.join(left, ["level", "node"], "left"), ["level", "node"])
    paths = way.groupBy(F.col("leaf").alias("of")).agg(F.sort_array(F.collect_list(F.struct("level", "node", "m", F.coalesce("left", F.lit(0)).alias("left")))).alias("path"))  # depth + 1 entries

    def run(key, mine: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"draw": [], "total": []})
        leaf, path = int(key[0]), list(ways["path"].iloc[0])
        share = np.full(draws, n, np.int64)
        for step in path[:-1]:
            at, node, whole, on_left = (int(step[k]) for k in ("level", "node", "m", "left"))
            to_left = np.random.default_rng([seed, 1, at, node]).binomial(share, on_left / whole)
            share = share - to_left if leaf >> (depth - at - 1) & 1 else to_left
        values = np.sort(mine["d"].to_numpy())
        rng, total = np.random.default_rng([seed, 2, leaf]), np.zeros(draws)
        ends = np.cumsum(share)
        for start in range(0, int(ends[-1]), DRAWN):
            stop = min(start + DRAWN, int(ends[-1]))
            drawn = np.concatenate([[0.0], np.cumsum(values[rng.integers(0, len(values), stop - start)])])
            edges = np.clip(np.concatenate([[0], ends]), start, stop) - start
            total += np.diff(drawn[edges])
        return pd.DataFrame({"draw": np.arange(draws), "total": total})

    sums = leafed.select("leaf", "d").groupBy("leaf").cogroup(paths.groupBy("of")).applyInPandas(run, "draw int, total double")
    # decimals, as their sums don't hang on the order of leaves
    means = sums.groupBy("draw").agg((F.sum(F.col("total").cast("decimal(38,9)")).cast("double") / F.lit(max(1, n))).alias("mean"))
    found = means.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("k"))  # ``draws`` rows
    return found.where("k > 0").select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def counterfactual(rows: DataFrame, target: str, changed_target: str, correct: str, correct_unchanged: str) -> DataFrame:
    """Over rows whose target changed: how many, the accuracy, that of the old answer repeated, and the mean gain."""
    moved = rows.where(F.col(target) != F.col(changed_target))
    return moved.agg(F.count(F.lit(1)).alias("changed"), F.avg(correct).alias("actual"), F.avg(correct_unchanged).alias("unchanged"), F.avg(F.col(correct) - F.col(correct_unchanged)).alias("gain"))


#: The checks of a release's report, and those whose failure a follow-up may mend.
REPORT_CHECKS = ("valid_outputs", "checkpoint_reload", "starting", "constant", "zero_numerical_embeddings", "reversed_target_response", "shuffled_target_response")
SUPPORT_CHECKS = {"reversed": "reversed_target_response", "shuffled": "shuffled_target_response"}


def follow_up(checks: DataFrame, evidence: DataFrame, groups: int = 5) -> DataFrame:
    """(eligible, complete, limited, supported) of a report's checks (check, ok) and evidence (mode, groups, gain_low, probability, support_sufficient).

    Eligible: all checks are there, some failed and none but those of support, each
    comparison has positive evidence, and a failed one lacked support.
    """
    failed = ~F.coalesce("ok", F.lit(False))
    stated = checks.agg(
        (F.sort_array(F.collect_set("check")) == F.array(*map(F.lit, sorted(REPORT_CHECKS)))).alias("complete"),
        (F.bool_or(failed) & ~F.bool_or(failed & ~F.col("check").isin(*SUPPORT_CHECKS.values()))).alias("limited"),
        F.collect_set(F.when(failed, F.col("check"))).alias("failed"),
    )
    check = F.concat(F.col("mode"), F.lit("_target_response"))
    positive = (F.col("groups") == groups) & (F.col("gain_low") > 0) & (F.col("probability") <= 0.05)
    lacking = ~F.array_contains("failed", check) | ~F.col("support_sufficient")
    shown = evidence.crossJoin(stated).groupBy("complete", "limited").agg((F.bool_and(F.coalesce(positive & lacking, F.lit(False))) & (F.count_distinct("mode") == len(SUPPORT_CHECKS))).alias("supported"))  # stated is one row
    return shown.select((F.col("complete") & F.col("limited") & F.col("supported")).alias("eligible"), "complete", "limited", "supported")


def gate(checks: DataFrame, name: str = "check", ok: str = "ok") -> DataFrame:
    return checks.agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("passed"), F.sort_array(F.collect_set(F.when(~F.coalesce(F.col(ok), F.lit(False)), F.col(name)))).alias("failed"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))
