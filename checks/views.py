"""Input tables of the registered queries, derived by Spark from the driver's tables.

Same content as the fixture views in FIXTURES.md.  The driver's prose has no
support vocabulary, so a phrase chosen by id is put in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.sources.config import GateConfig

PHRASES = [
    ("somebody hacked into my profile last night", "account_login"),
    ("why cannot I cancel the family plan", "billing_payment"),
    ("the player will crash and it won't play at all", "app_bug"),
    ("a refund for march would be fair", "billing_payment"),
    ("my wish: add feature to sort albums", "feature_request"),
    ("all issues solved, great work", "other"),
    ("next week I sue the lot of you", "other"),
    ("login keeps asking for another password", "account_login"),
    ("two unauthorized debits, one strange charge", "billing_payment"),
    ("write to ana-maria+help@mail.example.net today", "other"),
    ("ring +44 (020) 555-0199 after six", "other"),
    ("screenshot at www.example.org/shot and https://t.co/q9", "other"),
    ("holy shit the queue is gone again", "app_bug"),
    ("how do i suggest an artist", "feature_request"),
    ("error while saving the mix", "app_bug"),
    ("ok", "other"),
]

# A gate used where a query needs one that the SQL side knows too.
GATE = GateConfig(1.75, -0.5, -0.625, 0.5)

# Column types of the driver's tables, so that reading one needs no look into its files.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "benchmark": "item_id bigint, text string",
}

METRICS = ["groundedness", "safety", "helpfulness"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _choice(values: list[str | None], index: str) -> str:
    """SQL text that picks one of ``values`` by a number counted from 0."""
    items = ", ".join("NULL" if x is None else "'" + x.replace("'", "\\'") + "'" for x in values)
    return f"element_at(array({items}), CAST({index} AS INT) + 1)"


def _phrase(number: str, part: int) -> Column:
    return F.expr(_choice([p[part] for p in PHRASES], f"({number}) % 16"))


def _grade(expr: str) -> Column:
    return F.expr(f"CAST(1 + ({expr}) % 5 AS INT)")


def tickets_from(docs: DataFrame, labels: DataFrame) -> DataFrame:
    human = {
        "groundedness": ("doc_id % 9 = 0", "doc_id * 5 + doc_id % 3"),
        "safety": ("doc_id % 10 = 0", "doc_id * 3 + doc_id % 7"),
        "helpfulness": ("doc_id % 11 = 0", "doc_id * 13 + doc_id % 4"),
    }
    judge = {"groundedness": "doc_id * 11", "safety": "doc_id * 7", "helpfulness": "doc_id * 13"}
    truth = "(doc_id % 16 IN (0, 6, 8) OR coalesce(toxic, 0) = 1)"
    raw_true = _choice([" True", "TRUE\t", "true"], "doc_id % 3")
    raw_false = _choice(["False", None, "no"], "doc_id % 3")
    return docs.join(labels.select("doc_id", "toxic"), "doc_id", "left").select(
        F.col("doc_id").alias("tweet_id"),
        F.concat(_phrase("doc_id", 0), F.lit(" "), F.col("text")).alias("text"),
        _phrase("doc_id", 1).alias("true_intent"),
        F.when(F.expr("doc_id % 97 = 0"), "error").when(F.expr("doc_id % 6 = 0"), "other")
        .otherwise(_phrase("doc_id", 1)).alias("pred_intent"),
        F.expr("CAST(30 + (doc_id * 37) % 71 AS DOUBLE) / 100D AS confidence"),
        F.expr("CAST(20 + (doc_id * 53) % 71 AS DOUBLE) / 100D AS retrieval_score"),
        F.expr("(doc_id % 16 IN (0, 8) OR doc_id % 23 = 0) AS llm_risk"),
        F.expr(f"{truth} AS true_escalate"),
        F.expr(f"IF({truth}, {raw_true}, {raw_false}) AS should_escalate"),
        *[_grade(e).alias(f"judge_{m}") for m, e in judge.items()],
        *[F.when(~F.expr(n), _grade(e)).alias(f"human_{m}") for m, (n, e) in human.items()],
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets_from(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reply threads, with one short post more per first turn.

    The previous and next turn are looked up by (conversation, turn), a unique
    key, so one huge conversation is spread like any other rows.
    """
    c = table(spark, sf_dir, "conversations")
    post = F.col("conv_id") * 100 + F.col("turn")

    def neighbour(shift: int, name: str) -> DataFrame:
        return c.select("conv_id", (F.col("turn") + shift).alias("turn"), post.alias(name))

    assistant = F.col("role") == "assistant"
    body = F.concat(F.lit(" "), "text")
    mention = F.when(~assistant & (F.col("conv_id") % 7 == 0), "@brandCARES ").otherwise("")
    answer = F.col("next_id").cast("string")
    two = F.concat(answer, F.lit(","), (F.col("conv_id") * 100 + 99).cast("string"))
    minute = F.concat(F.lit("2021-03-04 05:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"))
    short = c.where("turn = 0").select(
        (F.col("conv_id") * 100 + 97).alias("tweet_id"), F.concat(F.lit("guest"), F.col("conv_id").cast("string")).alias("author_id"),
        F.lit(True).alias("inbound"), F.lit("2021-03-04 04:59").alias("created_at"), _phrase("conv_id", 0).alias("text"),
        F.lit(None).cast("string").alias("response_tweet_id"), F.lit(None).cast("bigint").alias("in_response_to_tweet_id"),
    )
    return (
        c.join(neighbour(1, "prev_id"), ["conv_id", "turn"], "left")
        .join(neighbour(-1, "next_id"), ["conv_id", "turn"], "left")
        .select(
            post.alias("tweet_id"),
            F.when(~assistant, F.concat(F.lit("user"), F.col("conv_id").cast("string")))
            .when(F.col("conv_id") % 3 == 0, "OtherBrand").otherwise("BrandCares").alias("author_id"),
            (~assistant).alias("inbound"),
            minute.alias("created_at"),
            F.concat(mention, _phrase("conv_id + turn", 0), body).alias("text"),
            F.when(F.col("conv_id") % 5 == 0, two).otherwise(answer).alias("response_tweet_id"),
            F.col("prev_id").alias("in_response_to_tweet_id"),
        )
        .unionAll(short)
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.when(F.col("page_id") % 10 == 0, " or https://help.example.org").otherwise("")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("tweet_id"),
        F.concat(F.lit("Try "), "url", F.lit(" for help"), bare).alias("text"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    extra = (
        F.when(p % 7 == 0, F.concat(F.lit(" https://unlisted.example.org/p"), p.cast("string")))
        .when(p % 11 == 0, " https://t.co/zzz")
        .when(p % 13 == 0, " https://help.example.org/")
        .when(p % 17 == 0, " https://nowhere.example.org")
        .otherwise("")
    )
    return table(spark, sf_dir, "pages").select(
        p.alias("tweet_id"), F.concat(F.lit("See "), "url", extra).alias("reply")
    )


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    messages = [
        "limit on tokens per day", "try again in 2m3.5s", "try again in 7s", "slow down",
    ]
    payloads = [
        '{"intent":"app_bug","confidence":0.9}', '{"intent":"other","confidence":"0.8"}',
        '{"confidence":null}', '{"risk":true}', "not json",
    ]
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        e.alias("call_id"),
        F.expr("event_id DIV 3").alias("tweet_id"),
        (e % 3).alias("priority"),
        F.concat(F.lit("model-"), (e % 3).cast("string")).alias("model"),
        F.when(failed, 429).when(F.col("event_type") == "signup", 404).otherwise(200).alias("status"),
        F.when(failed, F.expr(_choice(messages, "event_id % 4"))).alias("message"),
        F.expr(_choice(payloads, "event_id % 5")).alias("payload"),
    )


def router_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with every kind of status (NULL: no response), wait message and answer."""
    statuses = [200, 204, 299, 400, 401, 403, 404, 418, 429, 500, 503]
    messages = [
        "limit on Tokens Per Day", "requests per day used up", "try again in 2m3.5s", "Try again in 7s",
        "try again in 12m0s.", "slow down", None,
    ]
    payloads = [
        '{"intent":"app_bug","confidence":0.9}', '{"intent":"","confidence":""}',
        '{"intent":"other","confidence":"0.25"}', '{"confidence":null,"risk":null}', '{"risk":"false"}',
        '{"risk":""}', '{"risk":0}', '{"risk":2.5}', '{"risk":[]}', '{"risk":{}}', '{"risk":[0]}',
        '{"risk":false,"intent":"billing_payment","confidence":true}',
        '{"intent":"app_bug","confidence":"high","risk":true}', "[1, 2]", "not json", "", None,
    ]
    e = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, statuses), F.lit(None).cast("int")), (e % 12).cast("int") + 1)
    return table(spark, sf_dir, "events").select(
        e.alias("call_id"), status.alias("status"), F.expr(_choice(messages, "event_id % 7")).alias("message"),
        F.expr(_choice(payloads, "event_id % 17")).alias("payload"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers per ticket from the call log: three calls, some of which failed."""
    calls = model_calls(spark, sf_dir).where("status = 200")
    slot = lambda n, col, name: F.max(F.when(F.col("priority") == n, F.col(col))).alias(name)
    return calls.groupBy("tweet_id").agg(
        slot(0, "payload", "intent_payload"), slot(0, "model", "intent_model"),
        slot(1, "payload", "risk_payload"), slot(1, "model", "risk_model"),
        slot(2, "payload", "reply"), slot(2, "model", "draft_model"),
    )
