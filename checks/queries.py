"""Registered queries: one callable (spark, sf_dir) -> DataFrame per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.functions import model_output as mo
from deskflow.functions import text as tx
from deskflow.functions import urls
from deskflow.functions.sql import register_functions
from deskflow.operators import calls, grounding, metrics, policy, prompts, retrieval, sweeps, text_index
from deskflow.operators import threads as th
from deskflow.operators import tickets as tk
from deskflow.plans import bundle, evaluation
from deskflow.plans.calibration import recalibrated_run
from deskflow.session import fresh_folder
from deskflow.sources import config
from deskflow.sources.tables import calibration_json, write_table
from deskflow.sources.threads import read_corpus, read_threads
from deskflow.streaming.triage import triage_batch, triage_stream

from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BRAND = "BrandCares"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(*names: str) -> dict[str, Column]:
    return {n: F.round(n, 6) for n in names}


# Threads


@query
def thread_scan(spark, sf):
    """The thread export, written as CSV and read back."""
    folder = fresh_folder(spark, "threads")
    write_table(v.threads(spark, sf), folder, "csv")
    return read_threads(spark, folder)


@query
def corpus_scan(spark, sf):
    folder = fresh_folder(spark, "corpus")
    write_table(th.reply_corpus(v.threads(spark, sf)), folder, "csv")
    return read_corpus(spark, folder)


@query
def gate_config(spark, sf):
    """The risk policy under a gate that was written and loaded."""
    folder = fresh_folder(spark, "gate")
    fit = spark.range(1).select(F.lit(v.GATE.w_confidence).alias("w_confidence"), F.lit(v.GATE.w_retrieval).alias("w_retrieval"),
                                F.lit(v.GATE.intercept).alias("intercept"))
    choice = spark.range(1).select(F.lit(v.GATE.prob_thresh).alias("prob_thresh"), F.lit(0.0).alias("auto_handle_rate"), F.lit(0.0).alias("risk_miss_rate"))
    config.write_gate_config(config.gate_config_frame(fit, choice), folder)
    done = policy.decide(v.tickets(spark, sf), config.load_gate_config(spark, folder))
    return done.select("tweet_id", F.round("risk_score", 6).alias("risk_score"), "reason_code")


@query
def first_tickets(spark, sf):
    return tk.first_tickets(v.tickets(spark, sf).select("tweet_id", "text"), 25)


@query
def brand_subset(spark, sf):
    return th.brand_subset(v.threads(spark, sf), BRAND)


@query
def reply_corpus(spark, sf):
    return th.reply_corpus(v.threads(spark, sf))


@query
def subset_counts(spark, sf):
    return th.subset_counts(th.brand_subset(v.threads(spark, sf), BRAND))


@query
def evidence_sample(spark, sf):
    return th.evidence_sample(th.reply_corpus(v.threads(spark, sf)))


@query
def sample_n(spark, sf):
    return th.sample_n(th.inbound(v.threads(spark, sf)).select("tweet_id", "text"), "tweet_id", 100)


@query
def golden_set(spark, sf):
    return th.golden_set(v.threads(spark, sf))


@query
def leakage_audit(spark, sf):
    t = v.threads(spark, sf)
    return th.leakage_audit(t, th.golden_set(t), th.reply_corpus(t))


# Text


@query
def label_parse(spark, sf):
    return v.tickets(spark, sf).select(
        "tweet_id", tx.parse_bool(F.col("should_escalate")).alias("should_escalate")
    )


@query
def ticket_validation(spark, sf):
    checked = tk.validated(v.tickets(spark, sf).select("tweet_id", "text"))
    return checked.select("tweet_id", "error", F.length("text").alias("n_chars"))


@query
def redact_pii(spark, sf):
    return v.tickets(spark, sf).select("tweet_id", tx.redact_pii(F.col("text")).alias("safe_text"))


@query
def redact_pii_url_first(spark, sf):
    return v.tickets(spark, sf).select(
        "tweet_id", tx.redact_pii(F.col("text"), "url_first").alias("safe_text")
    )


@query
def keyword_flag(spark, sf):
    return v.tickets(spark, sf).select("tweet_id", tx.keyword_flag(F.col("text")).alias("flag"))


@query
def simple_intent(spark, sf):
    return v.tickets(spark, sf).select("tweet_id", tx.simple_intent(F.col("text")).alias("intent"))


@query
def text_sql_functions(spark, sf):
    register_functions(spark)
    return v.tickets(spark, sf).select(
        "tweet_id",
        F.expr("redact_pii(text)").alias("safe_text"),
        F.expr("keyword_flag(text)").alias("flag"),
        F.expr("simple_intent(text)").alias("intent"),
    )


@query
def tokens(spark, sf):
    words = tx.tokens(F.col("text"))
    return v.tickets(spark, sf).select(
        "tweet_id", F.size(words).alias("n_tokens"), F.array_join(words, " ").alias("tokens"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
    )


# Model answers and the call log


@query
def cooldown_parse(spark, sf):
    return v.model_calls(spark, sf).select(
        "call_id", mo.cooldown_seconds(F.col("message")).alias("cooldown_s")
    )


@query
def call_outcomes(spark, sf):
    return calls.with_outcome(v.model_calls(spark, sf)).select("call_id", "outcome", "cooldown_s")


@query
def router_outcomes(spark, sf):
    return calls.with_outcome(v.router_calls(spark, sf)).select("call_id", "status", "message", "outcome", "cooldown_s")


@query
def attempt_outcomes(spark, sf):
    return calls.attempt_summary(v.model_calls(spark, sf))


@query
def model_usage(spark, sf):
    return calls.model_usage(v.model_calls(spark, sf))


@query
def served_by(spark, sf):
    return calls.served_by(v.model_calls(spark, sf))


@query
def parse_intent(spark, sf):
    parsed = mo.parse_intent(F.col("payload"), "error")
    return v.model_calls(spark, sf).select("call_id", parsed.alias("p")).select("call_id", "p.*")


@query
def parse_request_intent(spark, sf):
    parsed = mo.parse_request_intent(F.col("payload"))
    return v.model_calls(spark, sf).select("call_id", parsed.alias("p")).select("call_id", "p.*")


@query
def parse_risk(spark, sf):
    parsed = mo.parse_risk(F.col("payload"))
    return v.model_calls(spark, sf).select("call_id", parsed.alias("p")).select("call_id", "p.*")


@query
def router_payloads(spark, sf):
    answer = F.col("payload")
    parsed = v.router_calls(spark, sf).select(
        "call_id", mo.parse_intent(answer, "error").alias("batch"), mo.parse_request_intent(answer).alias("request"),
        mo.parse_risk(answer).risk.alias("risk"), mo.parse_risk(answer, empty_container=True).risk.alias("request_risk"),
    )
    return parsed.select(
        "call_id", "batch.*", F.col("request.intent").alias("request_intent"),
        F.col("request.confidence").alias("request_confidence"), "risk", "request_risk",
    )


def judge_payload() -> Column:
    """Judge answers as JSON text; every fourth one lacks a score."""
    helpful = F.when(F.col("tweet_id") % 4 != 0, F.col("judge_helpfulness"))
    return F.to_json(
        F.struct(
            F.col("judge_groundedness").alias("groundedness"),
            F.col("judge_safety").alias("safety"),
            helpful.alias("helpfulness"),
            F.concat(F.lit("see "), F.col("tweet_id").cast("string")).alias("critique"),
        )
    )


@query
def parse_judge(spark, sf):
    t = v.tickets(spark, sf).select("tweet_id", mo.parse_judge(judge_payload()).alias("p"))
    return t.select("tweet_id", "p.*")


@query
def fill_missing_outputs(spark, sf):
    t = v.tickets(spark, sf).select("tweet_id").join(v.answers(spark, sf), "tweet_id", "left")
    return tk.fill_missing_outputs(t)


@query
def score_tickets(spark, sf):
    scored = tk.score_tickets(v.tickets(spark, sf).select("tweet_id", "text"))
    return scored.select("tweet_id", mo.parse_intent(F.col("payload")).alias("p")).select(
        "tweet_id", "p.intent", "p.confidence"
    )


# Decisions


@query
def risk_score(spark, sf):
    return v.tickets(spark, sf).select("tweet_id", F.round(policy.risk_score(v.GATE), 6).alias("risk_score"))


def decided(spark, sf):
    t = v.tickets(spark, sf)
    return policy.decide(
        t.select("tweet_id", "text", "confidence", "retrieval_score", "llm_risk", "true_escalate"), v.GATE
    )


@query
def risk_policy(spark, sf):
    return decided(spark, sf).select(
        "tweet_id", "safe_text", F.round("risk_score", 6).alias("risk_score"), "reason_code", "pred_escalate"
    )


@query
def risk_policy_uncalibrated(spark, sf):
    return policy.decide(v.tickets(spark, sf), None).select("tweet_id", "reason_code", "reason", "pred_escalate")


@query
def demo_policy(spark, sf):
    return policy.decide_all_reasons(v.tickets(spark, sf)).select(
        "tweet_id", "escalate", F.array_join("reasons", "; ").alias("reasons")
    )


# Retrieval


@query
def l2_normalize(spark, sf):
    e = v.table(spark, sf, "embeddings")
    unit = e.select("vec_id", F.posexplode(retrieval.l2_normalize(F.col("embedding"))).alias("pos", "x"))
    return unit.select("vec_id", "pos", F.round("x", 6).alias("x"))


@query
def dense_topk(spark, sf):
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.dense_topk(e, e).withColumns(r6("score"))


@query
def dense_top1(spark, sf):
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.dense_top1(e, e).withColumns(r6("top_score"))


def lexical(spark, sf):
    return retrieval.lexical_topk(
        v.table(spark, sf, "benchmark"), v.documents(spark, sf), query_id="item_id",
        corpus_id="doc_id",
    )


@query
def lexical_topk(spark, sf):
    index = text_index.build_index(v.documents(spark, sf), corpus_id="doc_id")
    found = text_index.search(v.table(spark, sf, "benchmark"), index, query_id="item_id")
    return found.withColumns(r6("score"))


def evidence(spark, sf):
    return retrieval.with_evidence_text(lexical(spark, sf), v.table(spark, sf, "documents"), "doc_id")


def prompt_tickets(spark, sf):
    return v.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("tweet_id"),
        tx.redact_pii(F.col("text")).alias("safe_text"),
        tx.simple_intent(F.col("text")).alias("intent"),
        F.concat(F.lit("draft "), F.col("item_id").cast("string")).alias("clean_reply"),
    )


@query
def build_prompts(spark, sf):
    return prompts.judge_prompts(prompt_tickets(spark, sf), evidence(spark, sf)).select("tweet_id", "user")


@query
def draft_prompts(spark, sf):
    return prompts.draft_prompts(prompt_tickets(spark, sf), evidence(spark, sf), BRAND)


@query
def intent_prompts(spark, sf):
    safe = v.tickets(spark, sf).select("tweet_id", tx.redact_pii(F.col("text")).alias("safe_text"))
    return prompts.intent_prompts(safe, BRAND)


@query
def short_intent_prompts(spark, sf):
    safe = v.tickets(spark, sf).select("tweet_id", tx.redact_pii(F.col("text")).alias("safe_text"))
    runs = [prompts.short_intent_prompts(safe, r).withColumn("per_request", F.lit(r)) for r in (False, True)]
    return runs[0].unionAll(runs[1])


@query
def risk_prompts(spark, sf):
    safe = v.tickets(spark, sf).select("tweet_id", tx.redact_pii(F.col("text")).alias("safe_text"))
    runs = [prompts.risk_prompts(safe, r).withColumn("per_request", F.lit(r)) for r in (False, True)]
    return runs[0].unionAll(runs[1])


@query
def request_prompts(spark, sf):
    return prompts.request_prompts(prompt_tickets(spark, sf), evidence(spark, sf), BRAND)


# Grounding


@query
def extract_urls(spark, sf):
    return grounding.reply_urls(v.replies(spark, sf))


@query
def url_parts(spark, sf):
    u = F.col("url")
    return v.table(spark, sf, "pages").select(
        "page_id", urls.url_scheme(u).alias("scheme"), urls.url_host(u).alias("host"),
        urls.url_path(u).alias("path"),
    )


@query
def url_whitelist(spark, sf):
    return grounding.build_whitelist(v.corpus(spark, sf))


def grounded(spark, sf):
    return grounding.ground(v.replies(spark, sf), grounding.build_whitelist(v.corpus(spark, sf)))


@query
def verify_replies(spark, sf):
    return grounded(spark, sf).select("tweet_id", "passed", "n_violations", "violation_urls")


@query
def sanitize_replies(spark, sf):
    return grounded(spark, sf).select("tweet_id", "clean_reply")


@query
def grounding_summary(spark, sf):
    whitelist = grounding.build_whitelist(v.corpus(spark, sf))
    return grounding.grounding_summary(grounded(spark, sf), whitelist)


# Metrics


def rule_layer(spark, sf):
    safe = tx.redact_pii(F.col("text"))
    return v.tickets(spark, sf).withColumn("pred_escalate", tx.predict_escalation(safe))


@query
def intent_metrics(spark, sf):
    return metrics.intent_metrics(v.tickets(spark, sf)).withColumns(r6("accuracy", "macro_f1"))


@query
def per_class_f1(spark, sf):
    return metrics.per_class_f1(v.tickets(spark, sf)).withColumns(r6("f1"))


@query
def escalation_metrics(spark, sf):
    return metrics.escalation_metrics(rule_layer(spark, sf)).withColumns(r6("precision", "recall"))


@query
def baseline_compare(spark, sf):
    golden = v.tickets(spark, sf).select("tweet_id", "text", "true_intent", "true_escalate")
    preds = rule_layer(spark, sf).select("tweet_id", "pred_intent", "pred_escalate")
    out = metrics.compare_systems(golden, preds)
    return out.withColumns(r6("accuracy", "macro_f1", "precision", "recall"))


@query
def operational_metrics(spark, sf):
    return metrics.operational_metrics(decided(spark, sf)).withColumns(
        r6("auto_handle_rate", "volume_false_auto", "risk_miss_rate", "precision", "recall")
    )


@query
def reason_counts(spark, sf):
    return metrics.reason_counts(decided(spark, sf))


@query
def calibration_bins(spark, sf):
    return metrics.calibration_bins(v.tickets(spark, sf)).drop("bin_index").withColumns(
        r6("mean_conf", "mean_acc")
    )


@query
def ece(spark, sf):
    return metrics.ece(v.tickets(spark, sf)).withColumns(r6("ece"))


@query
def calibration_document(spark, sf):
    t = v.tickets(spark, sf)
    document = calibration_json(metrics.calibration_bins(t), metrics.ece(t))
    kind = "struct<ece: double, buckets: array<struct<bin: string, n: bigint, mean_conf: double, mean_acc: double>>>"
    parsed = document.select(F.from_json("document", kind).alias("d"))
    return parsed.select(F.col("d.ece").alias("ece"), F.explode("d.buckets").alias("b")).select("ece", "b.*")


@query
def spearman(spark, sf):
    return metrics.spearman(v.tickets(spark, sf), v.METRICS).withColumns(r6("spearman"))


@query
def spearman_per_metric(spark, sf):
    return metrics.spearman(
        v.tickets(spark, sf), v.METRICS, complete_cases=False, min_n=3
    ).withColumns(r6("spearman"))


@query
def judge_means(spark, sf):
    return metrics.judge_means(v.tickets(spark, sf)).withColumns(r6(*v.METRICS))


@query
def attach_grades(spark, sf):
    t = v.tickets(spark, sf)
    new = t.select("tweet_id", "judge_safety")
    old = t.where("human_safety IS NOT NULL").select("tweet_id", "human_safety", "human_helpfulness")
    return tk.attach_grades(new, old)


# Sweeps


@query
def operating_curve(spark, sf):
    return sweeps.operating_curve(v.tickets(spark, sf), v.GATE)


@query
def operating_curve_fine(spark, sf):
    return sweeps.operating_curve(v.tickets(spark, sf), v.GATE, sweeps.fine_thresholds(), score_digits=4)


@query
def gate_grid(spark, sf):
    return sweeps.gate_grid(v.tickets(spark, sf))


@query
def best_gates(spark, sf):
    return sweeps.best_gates(sweeps.gate_grid(v.tickets(spark, sf)))


@query
def choose_threshold(spark, sf):
    return sweeps.choose_threshold(v.tickets(spark, sf), v.GATE)


@query
def fit_gate(spark, sf):
    fitted = sweeps.gate_frame(spark, sweeps.fit_gate(v.tickets(spark, sf)))
    return fitted.withColumns(r6("w_confidence", "w_retrieval", "intercept"))


@query
def recalibrated_policy(spark, sf):
    _, run = recalibrated_run(v.tickets(spark, sf))
    return metrics.reason_counts(run)


# Whole runs


@query
def intent_evaluation(spark, sf):
    golden = v.tickets(spark, sf).select("tweet_id", "text", "true_intent", "should_escalate")
    run = evaluation.intent_run(golden, v.answers(spark, sf))
    return run.select("tweet_id", "should_escalate", "pred_intent", "pred_escalate", "confidence", "parse_error", "answered")


@query
def unanswered_tickets(spark, sf):
    """Labelled tickets by whether a model answered them."""
    golden = v.tickets(spark, sf).select("tweet_id", "text", "true_intent", "should_escalate")
    return evaluation.intent_run(golden, v.answers(spark, sf)).groupBy("answered").agg(F.count("*").alias("n"))


@query
def risk_evaluation(spark, sf):
    t = v.tickets(spark, sf)
    golden = t.select("tweet_id", "text", "should_escalate")
    top1 = t.select(F.col("tweet_id").alias("query_id"), F.col("retrieval_score").alias("top_score"))
    run = evaluation.risk_run(golden, v.answers(spark, sf), top1, v.GATE)
    return run.select(
        "tweet_id", "true_escalate", "intent", "confidence", "llm_risk",
        F.round("risk_score", 6).alias("risk_score"), "reason_code", "pred_escalate",
        "intent_parse_error", "risk_parse_error", "answered",
    )


@query
def reply_evaluation(spark, sf):
    t = v.tickets(spark, sf)
    run = evaluation.reply_run(
        prompt_tickets(spark, sf).withColumnRenamed("safe_text", "text"),
        lexical(spark, sf),
        v.replies(spark, sf),
        t.select("tweet_id", judge_payload().alias("judge_payload")),
        grounding.build_whitelist(v.corpus(spark, sf)),
        t.select("tweet_id", *[f"human_{m}" for m in v.METRICS]),
    )
    return run.withColumn("verifier_urls", F.array_join("verifier_urls", "; ")).withColumns(
        r6("top_retrieval_score")
    )


@query
def bundle_headline(spark, sf):
    return bundle.bundle_headline(v.tickets(spark, sf), decided(spark, sf), v.GATE)


@query
def bundle_document(spark, sf):
    t = v.tickets(spark, sf)
    document = bundle.bundle_document(t, decided(spark, sf), t, v.GATE, v.METRICS)
    rates = ["auto_handle_rate", "volume_false_auto", "risk_miss_rate"]
    kind = "struct<headline: map<string, double>, agreement: map<string, double>, curve: array<map<string, double>>>"

    def entry(part, name, threshold, value):
        return F.struct(
            F.lit(part).alias("part"), name.alias("name"), threshold.cast("double").alias("threshold"), value.alias("value")
        )

    def point(p):
        return F.array(*[entry("curve", F.lit(r), p["threshold"], p[r]) for r in rates])

    d = document.select(F.from_json("document", kind).alias("d"))
    return d.select(F.inline(F.concat(
        F.transform(F.map_entries("d.headline"), lambda e: entry("headline", e.key, F.lit(None), e.value)),
        F.transform(F.map_entries("d.agreement"), lambda e: entry("agreement", e.key, F.lit(None), e.value)),
        F.flatten(F.transform("d.curve", point)),
    )))


@query
def bundle_tickets(spark, sf):
    t = v.tickets(spark, sf)
    return bundle.bundle_tickets(t, v.GATE).select("risk_score", "kw", "true_escalate")


# Per-request triage


def _flat(triaged):
    return triaged.select(
        "tweet_id", "error", "safe_text", "intent", "confidence", "escalate", "reply",
        F.array_join("reasons", "; ").alias("reasons"),
        F.array_join(F.col("evidence.text"), "\n").alias("evidence"),
        F.round(F.aggregate("evidence", F.lit(0.0), lambda a, e: a + e.score), 3).alias("evidence_score"),
    )


@query
def triage_requests(spark, sf):
    requests = v.tickets(spark, sf).select("tweet_id", "text").join(
        v.answers(spark, sf), "tweet_id", "left"
    )
    return _flat(triage_batch(requests, th.reply_corpus(v.threads(spark, sf))))


@query
def triage_stream_run(spark, sf):
    docs = v.table(spark, sf, "documents")
    # A pattern, because a stream source may not be a single file.
    arriving = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents*.parquet")
    stream = v.tickets_from(arriving.select("doc_id", "text"), v.table(spark, sf, "labels"))
    requests = stream.select("tweet_id", "text").join(v.answers(spark, sf), "tweet_id", "left")
    folder = fresh_folder(spark, "triage")
    run = triage_stream(
        requests, th.reply_corpus(v.threads(spark, sf)), f"{folder}/out", f"{folder}/checkpoint"
    )
    run.awaitTermination()
    return _flat(spark.read.parquet(f"{folder}/out"))


# The inventory calls it triage_stream, which is also the operator's name here.
QUERIES["triage_stream"] = QUERIES.pop("triage_stream_run")
