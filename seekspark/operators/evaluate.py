"""Retrieval evaluation (EVA-1..9, STA-6/7, RNK-13, JOI-9/10, FIL-7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import broadcast_if_small, materialize

INV_COEF = 5                      # fixed: inv_5 = 5 / (n + 5)
TOP_KS = (5, 15, 30)              # fixed: in_top_5 / in_top_15 / in_top_30
METRICS = ("in_top_5", "in_top_15", "in_top_30", "inv_5")


def metric(name: str, pos) -> F.Column:
    """EVA-2 / EVA-3 on a 0-based position (-1 = not found)."""
    p = F.col(pos) if isinstance(pos, str) else pos
    if name == "inv_5":
        return F.when(p == -1, F.lit(0.0)).otherwise(INV_COEF / (p + INV_COEF))
    if name.startswith("in_top_"):
        k = int(name.rsplit("_", 1)[1])
        return ((p > -1) & (p < k)).cast("double")
    raise ValueError(name)


def match_positions(results: DataFrame, truth: DataFrame, key_cols=("query_id",),
                    rank_col: str = "rank", page_col: str = "page") -> DataFrame:
    """EVA-1 / JOI-10: 0-based position of the first strong match (same
    document) and first light match (same page), -1 when absent.

    ``results``: ``(key.., doc_id, page, rank)`` (rank from 1);
    ``truth``: ``(key.., doc_id, page)`` (several right answers allowed).
    Every key of ``truth`` gets a row."""
    keys = list(key_cols)
    t_docs = truth.select(*keys, "doc_id").distinct().withColumn("strong", F.lit(True))
    t_pages = truth.select(*keys, F.col(page_col)).distinct().withColumn("light", F.lit(True))
    r = results.join(t_docs, keys + ["doc_id"], "left").join(t_pages, keys + [page_col], "left")
    firsts = r.groupBy(*keys).agg(F.min(F.when(F.col("strong"), F.col(rank_col))).alias("s"),
                                  F.min(F.when(F.col("light"), F.col(rank_col))).alias("l"))
    labelled = truth.select(*keys).distinct()
    out = labelled.join(firsts, keys, "left")
    return out.select(*keys, F.coalesce(F.col("s") - 1, F.lit(-1)).cast("int").alias("pos_strong"),
                      F.coalesce(F.col("l") - 1, F.lit(-1)).cast("int").alias("pos_light"))


def metric_table(positions: DataFrame, group_cols=(), file_col: str | None = None,
                 metrics=METRICS) -> DataFrame:
    """EVA-4 / STA-6: each metric's mean per file, then the mean over files
    (macro average), strong and light: ``(group.., metric, strong, light)``."""
    groups = list(group_cols)
    long = positions.select(*groups, *( [file_col] if file_col else []), "pos_strong", "pos_light",
                            F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    vals = long.select(*groups, *([file_col] if file_col else []), "metric",
                       *[_metric_by_name(m_col="metric", pos=p).alias(a)
                         for p, a in (("pos_strong", "s"), ("pos_light", "l"))])
    if file_col:
        vals = vals.groupBy(*groups, file_col, "metric").agg(F.avg("s").alias("s"), F.avg("l").alias("l"))
    return vals.groupBy(*groups, "metric").agg(F.avg("s").alias("strong"), F.avg("l").alias("light"))


def _metric_by_name(m_col: str, pos: str) -> F.Column:
    out = None
    for m in METRICS:
        expr = metric(m, pos)
        out = F.when(F.col(m_col) == m, expr) if out is None else out.when(F.col(m_col) == m, expr)
    return out


def roc_curve(scored: DataFrame, score_col: str = "score", label_col: str = "label") -> DataFrame:
    """EVA-8 / RNK-13: ROC points over ascending score thresholds.

    Below threshold t (scores <= t) documents are called negative:
    FN = positives at or below, TN = negatives at or below, TP = P - FN,
    FP = N - TN. The prefix sums run without a global window: counts per
    distinct score are range-partitioned, each range sums locally, and the
    per-range totals (one row per range) give the offsets.
    Returns ``(score, tpr, fpr, prev_tpr, prev_fpr)``; the first point
    (nothing called negative) is the row with ``score`` null.
    """
    g = scored.groupBy(score_col).agg(F.sum(F.col(label_col).cast("long")).alias("pos"),
                                      F.sum((1 - F.col(label_col)).cast("long")).alias("neg"))
    cum = prefix_sums(g, score_col, ["pos", "neg"])
    P = g.select(F.sum("pos").cast("double")).scalar()      # scalar subqueries, no join
    N = g.select(F.sum("neg").cast("double")).scalar()
    tpr = lambda fn: F.try_divide(P - fn.cast("double"), P)
    fpr = lambda tn: F.try_divide(N - tn.cast("double"), N)
    body = cum.select(F.col(score_col).cast("double").alias("score"), tpr(F.col("cum_pos")).alias("tpr"),
                      fpr(F.col("cum_neg")).alias("fpr"),
                      tpr(F.col("cum_pos") - F.col("pos")).alias("prev_tpr"),
                      fpr(F.col("cum_neg") - F.col("neg")).alias("prev_fpr"))
    first = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("score"), F.lit(1.0).alias("tpr"), F.lit(1.0).alias("fpr"),
        F.lit(None).cast("double").alias("prev_tpr"), F.lit(None).cast("double").alias("prev_fpr"))
    return first.unionByName(body)


def roc_auc(curve: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids between consecutive points."""
    seg = curve.filter(F.col("prev_fpr").isNotNull())
    return seg.agg(F.sum((F.col("prev_fpr") - F.col("fpr")) * (F.col("prev_tpr") + F.col("tpr")) / 2.0).alias("auc"))


def prefix_sums(df: DataFrame, order_col: str, cols, ranges: int | None = None) -> DataFrame:
    """Inclusive running sums of ``cols`` in ``order_col`` order (unique
    values), as ``cum_<col>``: range partitions sum locally; one row per
    range goes to the driver for the offsets."""
    n = ranges or df.sparkSession.sparkContext.defaultParallelism
    r = materialize(df.repartitionByRange(n, order_col).withColumn("__r", F.spark_partition_id()))
    tot = sorted(r.groupBy("__r").agg(*[F.sum(c).alias(c) for c in cols]).collect(), key=lambda x: x["__r"])
    acc = {c: 0 for c in cols}
    offs = {c: [] for c in cols}
    for row in tot:
        for c in cols:
            offs[c].append((row["__r"], acc[c]))
            acc[c] += row[c] or 0
    from pyspark.sql import Window
    w = Window.partitionBy("__r").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = r
    for c in cols:
        m = F.create_map(*[x for k, v in offs[c] for x in (F.lit(k), F.lit(v))]) if offs[c] else F.create_map().cast("map<int,bigint>")
        out = out.withColumn(f"cum_{c}", F.coalesce(m[F.col("__r")], F.lit(0)) + F.sum(c).over(w))
    return out.drop("__r")


def negative_pairs(pairs: DataFrame, file_col: str = "file", n_files: int = 9, shift: int = 5) -> DataFrame:
    """EVA-7 / JOI-9: one positive row per (query, doc) pair and one negative
    whose query comes from file ``(file + shift) % n_files``, row chosen by a
    deterministic hash in ``[0, rows - 1)`` (the reference's random pick
    never takes the last row). ``pairs``: ``(file, row_no, query, doc_id)``
    with ``row_no`` from 0. Returns ``(doc_id, query, relevant)``."""
    size = pairs.groupBy(file_col).agg(F.count(F.lit(1)).alias("n"))
    pos = pairs.select("doc_id", "query", F.lit(1).alias("relevant"))
    want = pairs.select("doc_id", F.col(file_col).alias("src_file"), "row_no",
                        F.pmod(F.col(file_col) + shift, F.lit(n_files)).alias(file_col))
    want = want.join(broadcast_if_small(size), file_col) \
        .withColumn("pick", F.when(F.col("n") > 1, F.pmod(F.col("doc_id") * 7919 + F.col("row_no") * 104729,
                                                           F.col("n") - 1)).otherwise(F.lit(0)))
    src = pairs.select(F.col(file_col), F.col("row_no").alias("pick"), F.col("query").alias("neg_query"))
    neg = want.join(src, [file_col, "pick"]).select("doc_id", F.col("neg_query").alias("query"),
                                                     F.lit(0).alias("relevant"))
    return pos.unionByName(neg)


def stage_report(timings: DataFrame, stage_col: str = "stage", sec_col: str = "seconds") -> DataFrame:
    """EVA-5 / EVA-9 / STA-7: per stage count, mean, population std, min, max."""
    return timings.groupBy(stage_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(sec_col).alias("mean"), F.stddev_pop(sec_col).alias("std"),
        F.min(sec_col).alias("min"), F.max(sec_col).alias("max"))


def score_and_time(positions: DataFrame, timings: DataFrame, metric_name: str = "inv_5", group_cols=("config_id",),
                   query_col: str = "query_id", sec_col: str = "seconds") -> DataFrame:
    """EVA-5: score and time of every configuration in one row. ``positions``: ``(group.., query, pos_strong,
    pos_light)``; ``timings``: ``(group.., query, stage.., seconds)``, any number of stages for a question, which add up.

    Returns ``(group.., n, strong, light, mean_seconds, std_seconds, n_timed)``: means of the metric over the questions and mean
    and population deviation of the time over those that were timed."""
    groups = list(group_cols)
    spent = timings.groupBy(*groups, query_col).agg(F.sum(sec_col).alias("spent"))
    both = positions.join(spent, groups + [query_col], "left")
    return both.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(metric(metric_name, "pos_strong")).alias("strong"),
        F.avg(metric(metric_name, "pos_light")).alias("light"), F.avg("spent").alias("mean_seconds"),
        F.stddev_pop("spent").alias("std_seconds"), F.count("spent").alias("n_timed"))


def stage_percentiles(timings: DataFrame, stage_col: str = "stage", sec_col: str = "seconds",
                      qs=(0.5, 0.9, 0.99)) -> DataFrame:
    """Approximate percentiles per stage (bounded memory per group, so a
    stage holding most rows is still summarised by partial sketches)."""
    return timings.groupBy(stage_col).agg(F.percentile_approx(sec_col, list(qs), 10000).alias("p"))


def title_leak(df: DataFrame, title_col: str, queries_col: str) -> DataFrame:
    """FIL-7 re-aimed: flag a batch whose every query contains the title."""
    t = F.lower(F.col(title_col))
    return df.withColumn("leak", F.forall(queries_col, lambda q: F.contains(F.lower(q), t)))
