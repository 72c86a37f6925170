"""Quality metrics.  Rows are first counted per distinct combination of labels,
so a shuffle carries a few counts per partition, whatever the table size and
however uneven the labels are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import known, ratio, right_closed_bin
from ..functions.text import keyword_flag, simple_intent, trivial_escalation, trivial_intent


def _sum(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def _class_rows(truth: str, pred: str, n: str, *extra: str) -> Column:
    """A count of one (truth, pred) pair as its contributions to both classes.

    ``extra`` counts are carried by the row of the true class only.
    """
    t, p, c, zero = F.col(truth), F.col(pred), F.col(n), F.lit(0).cast("bigint")
    hit = t.eqNullSafe(p)
    for_truth = F.struct(
        t.alias("label"), F.when(hit, c).otherwise(zero).alias("tp"), zero.alias("fp"),
        F.when(hit, zero).otherwise(c).alias("fn"), *[F.col(e).alias(e) for e in extra],
    )
    for_pred = F.struct(
        p.alias("label"), zero.alias("tp"), c.alias("fp"), zero.alias("fn"),
        *[zero.alias(e) for e in extra],
    )
    return F.explode(F.when(hit, F.array(for_truth)).otherwise(F.array(for_truth, for_pred)))


def _f1() -> Column:
    return ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def per_class_f1(df: DataFrame, truth: str = "true_intent", pred: str = "pred_intent") -> DataFrame:
    """True / false positives, false negatives and F1 of every true or predicted label."""
    return (
        df.groupBy(truth, pred).agg(F.count("*").alias("n"))
        .select(_class_rows(truth, pred, "n").alias("c")).select("c.*")
        .groupBy("label").agg(*[_sum(F.col(c)).alias(c) for c in ["tp", "fp", "fn"]])
        .withColumn("f1", _f1())
    )


def intent_metrics(df: DataFrame, truth: str = "true_intent", pred: str = "pred_intent") -> DataFrame:
    """Accuracy and macro F1 (every true or predicted label counts once)."""
    return per_class_f1(df, truth, pred).agg(
        ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def escalation_metrics(
    df: DataFrame, truth: str = "true_escalate", pred: str = "pred_escalate",
    if_zero: float | None = 0.0,
) -> DataFrame:
    """Precision and recall of the escalation decision."""
    t, p = F.col(truth), F.col(pred)
    return df.agg(
        ratio(F.count_if(t & p), F.count_if(p), if_zero).alias("precision"),
        ratio(F.count_if(t & p), F.count_if(t), if_zero).alias("recall"),
    )


def compare_systems(golden: DataFrame, preds: DataFrame) -> DataFrame:
    """Trivial, keyword and main system side by side on intent and escalation.

    ``golden``: tweet_id, text, true_intent, true_escalate; ``preds``: tweet_id,
    pred_intent, pred_escalate.  The texts are judged before the join, so only
    labels are shuffled.
    """
    text = F.col("text")
    labelled = golden.select(
        "tweet_id", "true_intent", "true_escalate", simple_intent(text).alias("keyword_intent"),
        keyword_flag(text).alias("keyword_escalate"),
    )
    outputs = {
        "trivial": (trivial_intent(), trivial_escalation()),
        "keyword": (F.col("keyword_intent"), F.col("keyword_escalate")),
        "main": (F.col("pred_intent"), F.col("pred_escalate")),
    }
    systems = F.array(
        *[F.struct(F.lit(name).alias("system"), i.alias("intent"), e.alias("escalate"))
          for name, (i, e) in outputs.items()]
    )
    esc = {
        "esc_tp": F.col("true_escalate") & F.col("escalate"),
        "esc_pred": F.col("escalate"),
        "esc_true": F.col("true_escalate"),
    }
    counts = (
        align(labelled, preds)
        .select("true_intent", "true_escalate", F.explode(systems).alias("s"))
        .select("true_intent", "true_escalate", "s.*")
        .groupBy("system", "true_intent", "intent")
        .agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in esc.items()])
    )
    sums = ["tp", "fp", "fn", *esc]
    classes = (
        counts.select("system", _class_rows("true_intent", "intent", "n", *esc).alias("c"))
        .select("system", "c.*")
        .groupBy("system", "label").agg(*[_sum(F.col(c)).alias(c) for c in sums])
    )
    return classes.groupBy("system").agg(
        ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"),
        F.avg(_f1()).alias("macro_f1"),
        ratio(F.sum("esc_tp"), F.sum("esc_pred")).alias("precision"),
        ratio(F.sum("esc_tp"), F.sum("esc_true")).alias("recall"),
    )


def align(golden: DataFrame, preds: DataFrame, on: str = "tweet_id") -> DataFrame:
    """Labels and predictions of the same tickets, one each.

    Fails if a ticket has no prediction or several, or a prediction has no ticket.
    """
    added = [c for c in preds.columns if c != on and c not in golden.columns]
    single = preds.groupBy(on).agg(
        F.count("*").alias("_seen"), F.first(F.struct(F.lit(0).alias("_"), *added)).alias("_pred")
    )
    joined = golden.withColumn("_label", F.lit(True)).join(single, on, "full_outer")
    checks = {
        "a ticket has no prediction": F.col("_seen").isNotNull(),
        "a ticket has several predictions": F.col("_seen") == 1,
        "a prediction has no ticket": F.col("_label").isNotNull(),
    }
    # assert_true yields NULL, so the filter keeps every row it does not stop at.
    for message, holds in checks.items():
        joined = joined.where(F.assert_true(holds, F.lit(message)).isNull())
    return joined.select(*golden.columns, *[F.col(f"_pred.{c}").alias(c) for c in added])


def operational_metrics(
    df: DataFrame, truth: str = "true_escalate", pred: str = "pred_escalate"
) -> DataFrame:
    """What the policy automates and what it misses; NULL where a rate has no base."""
    t, esc = F.col(truth), F.col(pred)
    auto, miss = F.count_if(~esc), F.count_if(~esc & t)
    return df.agg(
        F.count("*").alias("tickets"),
        ratio(auto, F.count("*"), None).alias("auto_handle_rate"),
        ratio(miss, auto, None).alias("volume_false_auto"),
        ratio(miss, F.count_if(t), None).alias("risk_miss_rate"),
        ratio(F.count_if(esc & t), F.count_if(esc), None).alias("precision"),
        ratio(F.count_if(esc & t), F.count_if(t), None).alias("recall"),
    )


def reason_counts(decided: DataFrame, reason: str = "reason_code") -> DataFrame:
    """Frequency of decision reasons, most frequent first."""
    return (
        decided.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)
    )


# Ten equal bins; dividing by ten gives other doubles than these products for some edges.
BIN_EDGES = [0.0] + [i * 0.1 for i in range(1, 10)] + [1.0]
_BIN_LABELS = ["(-0.001, 0.1]"] + [f"({i / 10}, {(i + 1) / 10}]" for i in range(1, 10)]


def _binned(df: DataFrame, truth: str, pred: str, confidence: str) -> DataFrame:
    return (
        df.where(known(F.col(confidence)).isNotNull())
        .groupBy(right_closed_bin(F.col(confidence), BIN_EDGES).alias("bin_index"))
        .agg(
            F.count("*").alias("n"),
            # exact, so that no rate depends on the order in which partitions arrive
            F.sum(F.col(confidence).cast("decimal(28,18)")).alias("sum_conf"),
            F.count_if(F.col(truth) == F.col(pred)).alias("hits"),
        )
    )


def calibration_bins(
    df: DataFrame, truth: str = "true_intent", pred: str = "pred_intent",
    confidence: str = "confidence",
) -> DataFrame:
    """Rows, mean confidence and accuracy per right-closed confidence bin; empty bins
    do not appear."""
    labels = F.array(*map(F.lit, _BIN_LABELS))
    return (
        _binned(df, truth, pred, confidence)
        .where("bin_index IS NOT NULL")
        .select(
            "bin_index",
            F.element_at(labels, F.col("bin_index") + 1).alias("bin"),
            "n",
            (F.col("sum_conf").cast("double") / F.col("n")).alias("mean_conf"),
            (F.col("hits") / F.col("n")).alias("mean_acc"),
        )
    )


def ece(
    df: DataFrame, truth: str = "true_intent", pred: str = "pred_intent",
    confidence: str = "confidence",
) -> DataFrame:
    """Expected calibration error: n / N * |mean_conf - mean_acc| over the bins, where N
    also counts confidences outside the bins."""
    gap = F.when(F.col("bin_index").isNotNull(), F.abs(F.col("sum_conf") - F.col("hits")))
    return _binned(df, truth, pred, confidence).agg(
        ratio(F.coalesce(F.sum(gap).cast("double"), F.lit(0.0)), F.sum("n"), None).alias("ece")
    )


def _centred_rank(value: str) -> Column:
    """Average rank minus the mean rank, from counts per value: half of what lies
    below minus what lies above."""
    by = Window.partitionBy("metric")
    below = F.sum("n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    above = F.sum("n").over(by.orderBy(value).rowsBetween(1, Window.unboundedFollowing))
    zero = F.lit(0)
    return (F.coalesce(below, zero) - F.coalesce(above, zero)) / F.lit(2.0)


def spearman(
    df: DataFrame, metrics: list[str], complete_cases: bool = True, min_n: int = 2
) -> DataFrame:
    """Rank correlation of ``human_<m>`` with ``judge_<m>`` for every metric.

    ``complete_cases`` uses only rows in which every human grade is present,
    otherwise each metric uses the rows it has.  NULL below ``min_n`` rows or
    when one side is constant.  A metric that nobody graded, so that a column is absent, has
    no row.  Tickets are counted per pair of grades first, so ranks are taken over the few
    values of the grading scale.
    """
    metrics = [m for m in metrics if {f"human_{m}", f"judge_{m}"} <= set(df.columns)]
    if not metrics:
        return df.sparkSession.createDataFrame([], "metric string, n bigint, spearman double")
    pairs = [
        F.struct(
            F.lit(m).alias("metric"),
            known(F.col(f"human_{m}")).alias("human"),
            known(F.col(f"judge_{m}")).alias("judge"),
        )
        for m in metrics
    ]
    rows = require_grades(df, metrics) if complete_cases else df
    counts = (
        rows.select(F.inline(F.array(*pairs)))
        .groupBy("metric", "human", "judge")
        # A metric without any graded row still gets its result row.
        .agg(F.count_if(F.col("human").isNotNull() & F.col("judge").isNotNull()).alias("n"))
    )
    graded = counts.where("n > 0")

    def ranks(side: str) -> DataFrame:
        return (
            graded.groupBy("metric", side).agg(F.sum("n").alias("n"))
            .select("metric", side, _centred_rank(side).alias(f"rank_{side}"))
        )

    h, j, n = F.col("rank_human"), F.col("rank_judge"), F.col("n")
    scale = F.sqrt(F.sum(n * h * h)) * F.sqrt(F.sum(n * j * j))
    return (
        counts.join(ranks("human"), ["metric", "human"], "left")
        .join(ranks("judge"), ["metric", "judge"], "left")
        .groupBy("metric")
        .agg(
            F.sum("n").alias("n"),
            F.when((F.sum("n") >= min_n) & (scale > 0), F.sum(n * h * j) / scale).alias("spearman"),
        )
    )


def require_grades(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.na.drop(subset=[f"human_{m}" for m in metrics])


def judge_means(df: DataFrame, metrics: list[str] = fv.JUDGE_METRICS) -> DataFrame:
    return df.agg(*[F.avg(f"judge_{m}").alias(m) for m in metrics])
