"""Threshold sweeps and the fitted gate.

A sweep does not multiply the tickets by the thresholds.  Each ticket is
counted once, under the number of thresholds its score reaches, and the rates
at every threshold are running sums over that histogram.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import arange, known, ratio, reached
from ..functions.text import keyword_flag
from ..sources.config import GateConfig
from .policy import never_null, risk_score


def _risk_counts() -> list[Column]:
    return [F.count("*").alias("n"), F.count_if(F.col("true_escalate")).alias("risks")]


def _keyword(df: DataFrame) -> Column:
    """The keyword flag of a ticket; a column ``kw`` holds it already if there is one."""
    return F.col("kw") if "kw" in df.columns else keyword_flag(F.col("text"))


def _steps(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def _rates() -> list[Column]:
    auto, miss = F.col("n_auto"), F.col("misses")
    return [
        ratio(auto, F.col("n_all"), None).alias("auto_handle_rate"),
        ratio(miss, auto).alias("volume_false_auto"),
        ratio(miss, F.col("risks_all")).alias("risk_miss_rate"),
    ]


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    rates = ["auto_handle_rate", "volume_false_auto", "risk_miss_rate"]
    return df.withColumns({c: F.round(c, digits) for c in rates})


def _curve(df: DataFrame, score: Column, always: Column, thresholds: list[float]) -> DataFrame:
    """Unrounded rates when a ticket escalates at ``score >= threshold`` or ``always``."""
    n = len(thresholds)
    # Score and flag are columns of their own, so every row computes them once.
    scored = df.select(
        known(score).alias("score"), never_null(always).alias("always"), "true_escalate"
    )
    step = F.when(F.col("always"), n).otherwise(reached(F.col("score"), thresholds, missing=0))
    histogram = scored.groupBy(step.alias("step")).agg(*_risk_counts())
    # One row per threshold plus one for tickets that escalate at all of them.
    frame = _steps(df.sparkSession, n + 1, "step").join(histogram, "step", "left").na.fill(0)
    up_to = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    sums = frame.select(
        "step",
        F.sum("n").over(up_to).alias("n_auto"),
        F.sum("risks").over(up_to).alias("misses"),
        F.sum("n").over(whole).alias("n_all"),
        F.sum("risks").over(whole).alias("risks_all"),
    ).where(F.col("step") < n)
    value = F.element_at(F.array(*map(F.lit, thresholds)), F.col("step") + 1)
    return sums.select(F.round(value, 2).alias("threshold"), *_rates())


def operating_curve(
    df: DataFrame, cfg: GateConfig, thresholds: list[float] | None = None,
    score_digits: int | None = None,
) -> DataFrame:
    """Rates at every cut-off of the risk score; keywords escalate at any cut-off, model
    risk is left out.  ``score_digits`` rounds scores before they are compared."""
    score = risk_score(cfg)
    if score_digits is not None:
        score = F.round(score, score_digits)
    return _rounded(
        _curve(df, score, _keyword(df), thresholds or arange(fv.SCORE_GRID))
    )


def fine_thresholds() -> list[float]:
    """Cut-offs 0.05 to 0.95 in steps of 0.01."""
    return [i / 100 for i in range(5, 96)]


def choose_threshold(df: DataFrame, cfg: GateConfig) -> DataFrame:
    """The cut-off that automates most while missing at most a quarter of the risks.

    Here model risk escalates too.  The lowest of equal cut-offs wins; one
    default row if none qualifies.
    """
    always = _keyword(df) | never_null(F.col("llm_risk"))
    curve = _curve(df, risk_score(cfg), always, arange(fv.SCORE_GRID))
    t, auto, miss = F.col("threshold"), F.col("auto_handle_rate"), F.col("risk_miss_rate")
    best = F.max_by(F.struct(t, auto, miss), F.struct(auto, -t))
    names = ["prob_thresh", "auto_handle_rate", "risk_miss_rate"]
    fields = ["threshold", "auto_handle_rate", "risk_miss_rate"]
    return (
        curve.where(miss <= fv.MAX_RISK_MISS).agg(best.alias("best"))
        .select(
            *[
                F.round(F.coalesce(F.col(f"best.{f}"), F.lit(d)), 4).alias(n)
                for f, d, n in zip(fields, fv.DEFAULT_THRESHOLD, names)
            ]
        )
    )


def gate_grid(df: DataFrame) -> DataFrame:
    """Rates for every pair of confidence and retrieval gates.

    A ticket is automated while it reaches both gates and neither a keyword nor
    model risk escalates it, so each pair needs the counts of all cells at or
    beyond it: running sums along both axes of a 11 x 10 histogram.
    """
    conf_t, ret_t = arange(fv.CONFIDENCE_GRID), arange(fv.RETRIEVAL_GRID)
    flagged = df.select(
        "confidence", "retrieval_score", "true_escalate",
        (_keyword(df) | never_null(F.col("llm_risk"))).alias("always"),
    )

    def level(name: str, gates: list[float]) -> Column:
        """0 is below the first gate; a missing number is never below a gate."""
        return F.when(F.col("always"), 0).otherwise(reached(F.col(name), gates, len(gates)))

    histogram = flagged.groupBy(
        level("confidence", conf_t).alias("ci"), level("retrieval_score", ret_t).alias("ri")
    ).agg(*_risk_counts())
    width = len(ret_t) + 1
    cells = _steps(df.sparkSession, (len(conf_t) + 1) * width, "cell").select(
        F.floor(F.col("cell") / width).cast("int").alias("ci"), (F.col("cell") % width).alias("ri")
    )

    def beyond(across: str, along: str) -> Window:
        return Window.partitionBy(across).orderBy(F.desc(along)).rowsBetween(
            Window.unboundedPreceding, 0
        )

    whole = Window.partitionBy()
    frame = cells.join(histogram, ["ci", "ri"], "left").na.fill(0)
    frame = frame.withColumns(
        {
            "n_all": F.sum("n").over(whole),
            "risks_all": F.sum("risks").over(whole),
            "n_row": F.sum("n").over(beyond("ci", "ri")),
            "risks_row": F.sum("risks").over(beyond("ci", "ri")),
        }
    ).withColumns(
        {
            "n_auto": F.sum("n_row").over(beyond("ri", "ci")),
            "misses": F.sum("risks_row").over(beyond("ri", "ci")),
        }
    )
    value = lambda grid, i: F.round(F.element_at(F.array(*map(F.lit, grid)), F.col(i)), 2)
    return _rounded(
        frame.where("ci > 0 AND ri > 0").select(
            value(conf_t, "ci").alias("conf_thresh"), value(ret_t, "ri").alias("ret_thresh"), *_rates()
        )
    )


def best_gates(grid: DataFrame, k: int = fv.BEST_GRID_ROWS) -> DataFrame:
    """The ``k`` gate pairs that automate most within the risk bound."""
    return (
        grid.where(F.col("risk_miss_rate") <= fv.MAX_RISK_MISS)
        .orderBy(F.desc("auto_handle_rate"), "conf_thresh", "ret_thresh")
        .limit(k)
    )


FIT_STEPS = 50
_AT = ("confidence", "retrieval_score", "one")


def gate_sums(rows: DataFrame, weights: tuple[float, float], at: np.ndarray) -> Row:
    """Loss, gradient (g0..g2) and second-order sums (h00..h22) of the gate's fit in one aggregate.

    rows: confidence, retrieval_score, label; weights: of labels 0 and 1; at: the coefficients
    of both and the intercept.  The penalty is not part of the sums.
    """
    label, one = F.col("label"), F.lit(1.0)
    x = [F.col("confidence"), F.col("retrieval_score"), one]
    weight = F.when(label == 1, weights[1]).otherwise(weights[0])
    score = reduce(Column.__add__, [float(w) * c for w, c in zip(at, x)])
    scored = rows.select(*[c.alias(n) for c, n in zip(x, _AT)], label, weight.alias("weight"), score.alias("z"))
    p = 1 / (1 + F.exp(-F.col("z")))
    scored = scored.withColumns({"p": p, "loss": F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("label") * F.col("z")})
    x, w, p = [F.col(n) for n in _AT], F.col("weight"), F.col("p")
    return scored.agg(
        F.sum(w * F.col("loss")).alias("loss"),
        *[F.sum(w * (p - F.col("label")) * c).alias(f"g{i}") for i, c in enumerate(x)],
        *[F.sum(w * p * (1 - p) * x[i] * x[j]).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)],
    ).first()


def fit_gate(df: DataFrame, tol: float = 1e-9) -> GateConfig:
    """Class-balanced logistic regression of true escalation on confidence and retrieval.

    L2 penalty on both coefficients with C = 1.  Newton steps: each is one aggregate over the
    tickets (ten sums) and a system of three equations; a step that does not lower the loss is
    halved.  It ends when the gradient per ticket is below ``tol`` or no step is left that
    changes anything.
    """
    rows = df.select(
        known(F.col("confidence")).alias("confidence"),
        known(F.col("retrieval_score")).alias("retrieval_score"),
        F.col("true_escalate").cast("double").alias("label"),
    ).na.drop()
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or positive in (0, n):
        raise ValueError("the gate needs tickets of both classes")
    weights, penalty = (n / (2 * (n - positive)), n / (2 * positive)), np.diag([1.0, 1.0, 0.0])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = gate_sums(rows, weights, w)
        upper = [[sums[f"h{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]
        gradient = np.array([sums[f"g{i}"] for i in range(3)]) + penalty @ w
        return sums["loss"] + 0.5 * w @ penalty @ w, gradient, np.array(upper) + penalty

    w = np.zeros(3)
    loss, gradient, hessian = at(w)
    for _ in range(FIT_STEPS):
        if np.abs(gradient).max() <= tol * n:
            break
        step = np.linalg.solve(hessian, gradient)
        new = at(w - step)
        while new[0] > loss * (1 + 1e-12) and np.abs(step).max() > 1e-12:
            step /= 2
            new = at(w - step)
        w, (loss, gradient, hessian) = w - step, new
    w_conf, w_ret, intercept = (float(v) for v in w)
    return GateConfig(w_conf, w_ret, intercept, fv.DEFAULT_THRESHOLD[0])


def gate_frame(spark: SparkSession, cfg: GateConfig) -> DataFrame:
    """A fitted gate as one row."""
    return spark.range(1).select(
        F.lit(cfg.w_confidence).alias("w_confidence"),
        F.lit(cfg.w_retrieval).alias("w_retrieval"),
        F.lit(cfg.intercept).alias("intercept"),
    )
