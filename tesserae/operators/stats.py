"""Retrieval metrics, intervals, calibration and thresholds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import prefix
from tesserae.session import settled


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share, within [0, 1]."""
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    margin = F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) * z / scale
    return F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)


def retrieval_metrics(per_query: DataFrame, category: str = "category") -> DataFrame:
    """Means of recall, hit, top1, rr and ndcg by category, and over all as '(all)'."""
    measures = ["recall", "hit", "top1", "rr", "ndcg"]
    grouped = per_query.rollup(category).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in measures])
    return grouped.withColumn(category, F.coalesce(category, F.lit("(all)")))


def query_metrics(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """query, recall, hit, top1, rr, ndcg at k from hits (query, id, rank) and relevant (query, id); queries without relevant rows are left out."""
    total = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("total"))
    found = hits.filter(F.col("rank") <= k).join(relevant, ["query", "id"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    both = total.join(found, "query", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return both.select(
        "query",
        F.coalesce(F.col("found") / F.col("total"), F.lit(0.0)).alias("recall"),
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("top1"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )


def calibration_bins(rows: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, mean probability and mean label of each equal-width bin that has rows."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(probability)))
    bins = max(2, min(50, bins))
    return rows.groupBy(F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("mean_y"))


def calibration_errors(rows: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """One row: n, brier, log_loss, ece, mce."""
    p, y = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(probability))), F.col(label)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    gaps = calibration_bins(rows, probability, label, bins).agg(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))).alias("gap"), F.max(F.abs(F.col("mean_p") - F.col("mean_y"))).alias("mce"))
    return sums.join(F.broadcast(gaps)).select("n", F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"), F.round(F.col("gap") / F.col("n"), 6).alias("ece"), F.round("mce", 6).alias("mce"))  # one row each


def confusion(rows: DataFrame, predicted: Column, actual: Column, group: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn and the ratios of them (0 where the denominator is)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = rows.groupBy(*(group or [])).agg(count(predicted & actual).alias("tp"), count(~predicted & ~actual).alias("tn"), count(predicted & ~actual).alias("fp"), count(~predicted & actual).alias("fn"))
    share = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 6)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return sums.select(
        *(group or []), "tp", "tn", "fp", "fn",
        share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tn, tn + fp).alias("specificity"), share(fp, tn + fp).alias("fpr"),
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp + fp, tp + tn + fp + fn).alias("coverage"),
    )


def fit_threshold(rows: DataFrame, score: str, label: str, group: str, fp_cost: float = 2.0, fn_cost: float = 1.0) -> DataFrame:
    """group, threshold, cost: over all distinct scores (and just outside them) the least cost of false positives and
    negatives; ties by balanced accuracy, then the larger threshold. Sums run over ranges of scores, so no task holds a group."""
    y = F.col(label).cast("int")
    counts = prefix.by_ranges(rows.groupBy(group, F.col(score).alias("t")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")), [group], [F.col("t")])
    totals = counts.groupBy(group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max("t").alias("top"), F.min("t").alias("low"))
    # A row is retrieved if its score is at least t: positives below t are missed.
    at = prefix.sums_before(counts, [group], [F.col("t")], {"fn": F.col("pos"), "tn": F.col("neg")}).join(totals, group)
    above = at.filter("t = top").select(group, (F.col("t") + 1e-9).alias("t"), F.col("p").alias("fn"), F.col("n").alias("tn"), "p", "n")
    below = at.filter("t = low").select(group, (F.col("t") - 1e-9).alias("t"), F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("tn"), "p", "n")
    options = at.select(group, "t", "fn", "tn", "p", "n").unionByName(above).unionByName(below)
    cost = (F.col("n") - F.col("tn")) * fp_cost + F.col("fn") * fn_cost
    balanced = (F.when(F.col("p") == 0, 0.0).otherwise((F.col("p") - F.col("fn")) / F.col("p")) + F.when(F.col("n") == 0, 0.0).otherwise(F.col("tn") / F.col("n"))) / 2
    best = F.max(F.struct((-cost).alias("c"), F.round(balanced, 9).alias("b"), F.col("t")))
    return options.groupBy(group).agg(best.alias("best")).select(group, F.round("best.t", 9).alias("threshold"), (-F.col("best.c")).alias("cost"))


def effective_count(weight: str) -> Column:
    """Kish's effective sample count of a group, at most its rows."""
    return F.least(F.count(F.lit(1)).cast("double"), F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight)))


BLOCK = "key_ string, part_ int, low double, high double, positive double, total double, n long"


def isotonic_blocks(rows: DataFrame, cohort: str, score: str, label: str, weight: str | None = None) -> DataFrame:
    """cohort, low, high, positive, total, n: blocks of a rising step function, by pooling adjacent violators; equal means stay apart.

    Ranges of scores are pooled first, each in its own task. Then neighbours are merged in a tree: of two pooled ranges
    a run at the end of the lower one and a run at the start of the upper one become one block, and the
    means tell which (``_bridged``). So no task holds a cohort. A null cohort is one; rows without a score or a label count for nothing.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.lit(0.001), F.col(weight))
    key = F.coalesce(F.concat(F.lit("="), F.col(cohort).cast("string")), F.lit("")).alias("key_")  # no null: the key is joined
    known = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double")))
    points = known.groupBy(key, at.alias("low")).agg(F.sum(w * F.col(label)).alias("positive"), F.sum(w).alias("total"), F.count(F.lit(1)).alias("n"))
    points = prefix.by_ranges(points.select("key_", "low", F.col("low").alias("high"), "positive", "total", "n"), ["key_"], [F.col("low")])

    def pool(part: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list] = []
        for block in part.sort_values("low")[["low", "high", "positive", "total", "n"]].itertuples(index=False):
            blocks.append(list(block))
            # Multiplied crosswise, so that counts compare exactly.
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] > blocks[-1][2] * blocks[-2][3]:
                last = blocks.pop()
                blocks[-1][1] = last[1]
                for k in (2, 3, 4):
                    blocks[-1][k] += last[k]
        out = pd.DataFrame(blocks, columns=["low", "high", "positive", "total", "n"])
        return out.assign(key_=part["key_"].iloc[0], part_=part[prefix.PART].iloc[0])[["key_", "part_", "low", "high", "positive", "total", "n"]]

    blocks = settled(points.groupBy("key_", prefix.PART).applyInPandas(pool, BLOCK))
    last = blocks.agg(F.max("part_")).first()[0] or 0
    width = 1
    while width <= last:
        blocks = settled(_bridged(blocks, width))
        width *= 2
    return blocks.select(F.when(F.col("key_") != "", F.expr("substring(key_, 2)")).alias("cohort"), "low", "high", "positive", "total", "n")


def _bridged(blocks: DataFrame, width: int) -> DataFrame:
    """Pooled runs of ``width`` ranges (BLOCK) merged two by two.

    Within a run means rise. The block that joins two runs pools the lower run's blocks with means above its own, and the upper
    run's with means below it. For a mean v let P and T be the positives and totals of those it would
    pool: P - vT falls as v grows, and the mean sought is where it crosses nought.
    """
    by = ["key_", "node_"]
    upper = (F.floor(F.col("part_") / width) % 2) == 1
    laid = blocks.withColumns({"node_": F.floor(F.col("part_") / (2 * width)), "upper_": upper, "mean_": F.col("positive") / F.col("total")})
    ends = laid.groupBy(*by).agg(F.max(F.when(~upper, F.col("mean_"))).alias("top_"), F.min(F.when(upper, F.col("mean_"))).alias("least_")).filter("top_ > least_")
    met = laid.join(ends, by).filter(F.expr("if(upper_, mean_ < top_, mean_ > least_)"))
    side = lambda c, of: F.sum(F.when(F.col("upper_") == of, F.col(c)).otherwise(0.0))
    means = met.groupBy(*by, "mean_").agg(
        F.min(F.struct("total", "positive")).alias("one_"), side("positive", False).alias("pa"), side("total", False).alias("ta"), side("positive", True).alias("pb"), side("total", True).alias("tb")
    )
    ranged = prefix.by_ranges(means, by, [F.col("mean_")])
    sums = ranged.groupBy(*by).agg(F.sum("pa").alias("all_pa"), F.sum("ta").alias("all_ta"))
    before = prefix.sums_before(ranged, by, [F.col("mean_")], {f"{c}_": F.col(c) for c in ("pa", "ta", "pb", "tb")}).join(sums, by)
    above = {c: F.col(f"all_{c}") - F.col(f"{c}_") - F.col(c) for c in ("pa", "ta")}
    falls = (above["pa"] + F.col("pb_")) * F.col("one_.total") - F.col("one_.positive") * (above["ta"] + F.col("tb_"))
    found = before.filter(falls >= 0).groupBy(*by).agg(F.max_by(F.struct((above["pa"] + F.col("pb_") + F.col("pb")).alias("p"), (above["ta"] + F.col("tb_") + F.col("tb")).alias("t")), "mean_").alias("at_"))
    gap = F.col("positive") * F.col("at_.t") - F.col("at_.p") * F.col("total")
    judged = laid.join(found, by, "left").withColumn("pooled_", F.coalesce(F.when(F.col("upper_"), gap < 0).otherwise(gap > 0), F.lit(False)))
    columns = ["key_", "part_", "low", "high", "positive", "total", "n"]
    pooled = judged.filter("pooled_").groupBy(*by).agg(F.min("part_").alias("part_"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("positive", "total", "n")])
    return judged.filter(~F.col("pooled_")).select(*columns).unionByName(pooled.select(*columns))


def nearest_rank(values: str, q: float) -> Column:
    """The smallest value that a share q of the rows doesn't exceed."""
    return F.expr(f"percentile_disc({q}) within group (order by {values})")


def nearest_block(rows: DataFrame, blocks: DataFrame, cohort: str, score: str) -> DataFrame:
    """Adds the columns of each row's block (low, high, p of its cohort): the first whose high isn't below the score, else the last.

    Blocks and rows are merged in order of score once per cohort, from the top down, so no row meets every block.
    """
    payload = [c for c in blocks.columns if c != cohort]
    b = blocks.select(cohort, F.col("high").alias("at_"), F.lit(0).alias("is_row_"), F.struct(*payload).alias("b_"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("r_"))
    r = rows.select(cohort, F.col(score).alias("at_"), F.lit(1).alias("is_row_"), F.lit(None).cast(b.schema["b_"].dataType).alias("b_"), F.struct("*").alias("r_"))
    down = Window.partitionBy(cohort).orderBy(F.col("at_").desc(), "is_row_").rowsBetween(Window.unboundedPreceding, 0)
    top = blocks.groupBy(cohort).agg(F.max_by(F.struct(*payload), "high").alias("top_"))
    merged = b.unionByName(r).withColumn("b_", F.last("b_", ignorenulls=True).over(down)).filter("is_row_ = 1").join(top, cohort, "left")
    return merged.withColumn("b_", F.coalesce("b_", "top_")).select("r_.*", *[F.col(f"b_.{c}").alias(c) for c in payload])


def matched_one_to_one(expected: DataFrame, actual: DataFrame, case: str = "case_id") -> DataFrame:
    """Expected and actual facts of a case paired one to one by ``functions.text.fact_key``: full outer, in order of position.

    expected: case, pos, content, outcome, action (null: any); actual: case, pos, content, outcome, action.
    """
    nth = F.row_number().over(Window.partitionBy(case, "key_").orderBy("pos"))
    laid = lambda df, tag: df.withColumn("key_", text.fact_key(F.col("content"))).withColumn("nth_", nth).select(case, "key_", "nth_", F.struct("outcome", "action").alias(tag))
    return laid(expected, "e").join(laid(actual, "a"), [case, "key_", "nth_"], "full_outer")


def write_metrics(pairs: DataFrame) -> DataFrame:
    """One row from ``matched_one_to_one``: tp, fp, fn, precision, recall, f1, outcome and operation accuracy, unsupported active rate; an empty share is 1, an empty rate 0."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    active = F.col("a.outcome") == "active"
    sums = pairs.agg(
        n(both).alias("tp"), n(F.col("e").isNull()).alias("fp"), n(F.col("a").isNull()).alias("fn"), n(both & (F.col("e.outcome") == F.col("a.outcome"))).alias("outcome_ok"),
        n(both & F.col("e.action").isNotNull()).alias("asked"), n(both & (F.col("e.action") == F.col("a.action"))).alias("action_ok"), n(active).alias("active"),
        n(active & (F.col("e").isNull() | (F.col("e.outcome") != "active"))).alias("unsupported"),
    )
    share = lambda a, b, empty=1.0: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(empty)
    sums = sums.withColumns({"predicted": F.col("tp") + F.col("fp"), "expected": F.col("tp") + F.col("fn")})
    sums = sums.withColumns({"precision": share("tp", "predicted"), "recall": share("tp", "expected"), "outcome_accuracy": share("outcome_ok", "tp"), "operation_accuracy": share("action_ok", "asked"), "unsupported_rate": share("unsupported", "active", 0.0)})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 6)).otherwise(1.0)
    return sums.select("tp", "fp", "fn", "precision", "recall", f1.alias("f1"), "outcome_accuracy", "operation_accuracy", "unsupported_rate")


def balanced_accuracy(counts: DataFrame) -> DataFrame:
    """Adds balanced_accuracy to the counts of ``confusion``: the mean of recall and specificity."""
    return counts.withColumn("balanced_accuracy", F.round((F.col("recall") + F.col("specificity")) / 2, 6))


def incomplete(cases: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """key and problem (missing: a case without a label; extra: a label without a case); a complete pack has none."""
    both = cases.select(key, F.lit(1).alias("c_")).join(labels.select(key, F.lit(1).alias("l_")), key, "full_outer")
    return both.select(key, F.when(F.col("l_").isNull(), "missing").when(F.col("c_").isNull(), "extra").alias("problem")).filter("problem is not null")
