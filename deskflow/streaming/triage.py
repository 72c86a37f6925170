"""Per-request triage as a batch function and as a streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed_values as fv
from ..functions.model_output import parse_request_intent, parse_risk
from ..operators.policy import decide_all_reasons
from ..operators.prompts import request_prompt, request_system
from ..operators.text_index import TextIndex, build_index, hit_texts, search
from ..operators.tickets import fill_missing_outputs, validated
from ..session import fresh_folder

BRAND = "customer"
REQUEST_COLUMNS = ["intent_payload", "intent_model", "risk_payload", "risk_model", "reply", "draft_model"]


def triage_requests(requests: DataFrame) -> DataFrame:
    """Validation, redaction and decision of every request; stateless.

    Rejected requests keep their row with ``error`` set and no decision.
    """
    known = requests.withColumns(
        {c: F.lit(None).cast("string") for c in REQUEST_COLUMNS if c not in requests.columns}
    )
    accepted = F.col("error").isNull()
    parsed = (
        fill_missing_outputs(validated(known))
        # The text of a rejected request goes no further, so no rule is spent on it.
        .withColumn("text", F.when(accepted, F.col("text")))
        .withColumn("_i", parse_request_intent(F.col("intent_payload")))
        .withColumns(
            {
                "intent": F.col("_i.intent"),
                "confidence": F.col("_i.confidence"),
                "llm_risk": parse_risk(F.col("risk_payload"), empty_container=True).getField("risk"),
            }
        )
    )
    decided = decide_all_reasons(parsed).withColumn(
        "prompt", request_prompt(F.col("safe_text"), F.col("intent"))
    )
    results = [
        "safe_text", "intent", "confidence", "escalate", "reasons", "prompt", "reply",
        "intent_model", "risk_model", "draft_model",
    ]
    return decided.select("tweet_id", "error", *[F.when(accepted, F.col(c)).alias(c) for c in results])


def attach_evidence(triaged: DataFrame, index: TextIndex, brand: str, k: int = fv.TOP_K) -> DataFrame:
    """Add the ``k`` past replies closest in words, best first, and the system message that quotes them, to accepted requests."""
    asked = triaged.where(F.col("error").isNull()).select("tweet_id", "safe_text")
    hits = hit_texts(search(asked, index, k, query_id="tweet_id", query_text="safe_text"), index)
    lists = hits.groupBy(F.col("query_id").alias("tweet_id")).agg(
        F.array_sort(F.collect_list(F.struct("rk", F.round("score", 3).alias("score"), "text"))).alias("evidence")
    )
    bullets = F.transform(F.coalesce("evidence.text", F.array().cast("array<string>")), lambda t: F.concat(F.lit("- "), t))
    system = request_system(F.array_join(bullets, "\n"), brand)
    return triaged.join(lists, "tweet_id", "left").withColumn("system", F.when(F.col("error").isNull(), system))


def triage_batch(requests: DataFrame, corpus: DataFrame, brand: str = BRAND) -> DataFrame:
    """Triage of a table of requests; the index of the corpus is built for it."""
    triaged = triage_requests(requests)
    folder = fresh_folder(requests.sparkSession, "triaged")
    triaged.write.parquet(folder)
    return attach_evidence(requests.sparkSession.read.parquet(folder), build_index(corpus, corpus_id="tweet_id"), brand)


def publish_index(corpus: DataFrame, folder: str, version: int) -> TextIndex:
    """Store a new version of the index of past replies; running streams take it up with their next batch."""
    done = build_index(corpus, f"{folder}/version={version}", corpus_id="tweet_id")
    corpus.sparkSession.createDataFrame([(version,)], "version long").write.parquet(f"{folder}/published={version}")
    return done


def latest_version(spark: SparkSession, folder: str) -> int:
    """The newest version whose publication is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    done = [int(n.removeprefix("published=")) for n in names if n.startswith("published=") and holds_files(spark, f"{folder}/{n}")]
    if not done:
        raise ValueError(f"{folder} holds no published index")
    return max(done)


def batch_version(spark: SparkSession, output: str, index: str, batch_id: int) -> int:
    """The index version of a micro-batch, from its manifest; the first run of a batch writes it.

    A batch that is run again thus looks its evidence up where it did before, whatever has been
    published since.
    """
    manifest = f"{output}_manifest/batch={batch_id}"
    if not holds_files(spark, f"{manifest}/_SUCCESS"):
        row = [(batch_id, latest_version(spark, index))]
        spark.createDataFrame(row, "batch_id long, version long").write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(manifest).first().version


def holds_files(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(path) and len(files.listStatus(path)) > 0


def triage_stream(
    requests: DataFrame, corpus: DataFrame | str, output: str, checkpoint: str, brand: str = BRAND, **trigger
) -> StreamingQuery:
    """Start triage of a stream of requests into the Parquet folder ``output``.

    ``corpus``: the folder of published indexes, or a corpus, which is then published once beside
    the output.  Everything up to the decision is stateless; evidence is looked up per
    micro-batch in the newest index, whose version the batch's manifest records.  A batch reads
    postings of its own words and texts of its hits.  A batch that is run again
    after a failure replaces its own folder, so results are neither lost nor doubled.  Batches
    are numbered per checkpoint, so a new checkpoint needs a new or empty output folder.
    """
    spark = requests.sparkSession
    if holds_files(spark, output) and not holds_files(spark, checkpoint):
        raise ValueError(f"{output} holds results of another checkpoint; name a new folder")

    index = corpus if isinstance(corpus, str) else f"{output}_index"
    if not isinstance(corpus, str) and not holds_files(spark, f"{index}/published=1"):
        publish_index(corpus, index, 1)

    def write(batch: DataFrame, batch_id: int) -> None:
        version = batch_version(spark, output, index, batch_id)
        kept = batch.persist()
        try:
            attach_evidence(kept, TextIndex(f"{index}/version={version}"), brand).write.mode("overwrite").parquet(
                f"{output}/batch={batch_id}"
            )
        finally:
            kept.unpersist()

    return (
        triage_requests(requests)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
