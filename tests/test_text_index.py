import pytest
from pyspark.sql import functions as F

from deskflow.operators.text_index import build_index, hit_texts, search
from deskflow.streaming.triage import attach_evidence, batch_version, latest_version, publish_index, triage_requests, triage_stream

from test_retrieval import lexical_brute, texts

KIND = "id bigint, text string"


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [(8 << 20, 4096), (200, 3)])
def test_search_matches_brute_force(spark, block):
    q, c = texts(40, 1), texts(150, 2, hot=0.5)
    c += [(9001, "refund " * 3000), (9002, "the of"), (9003, None), (9004, "")]
    qdf, cdf = spark.createDataFrame(q, KIND), spark.createDataFrame(c, KIND).withColumn("block", F.lit("clash"))
    index = build_index(cdf, block_bytes=block[0], block_texts=block[1])
    got = found(search(qdf, index, 3, query_rows=11))
    want = lexical_brute(q, c, 3)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [w[3] for w in want]
    with_text = {(r.query_id, r.rk): r.text for r in hit_texts(search(qdf, index, 3), index).collect()}
    assert with_text == {w[:2]: dict(c)[w[2]] or "" for w in want}


def test_one_word_in_a_third_of_all_rows(spark):
    q = [(i, "hotword login") for i in range(300)]
    c = [(i, "hotword hotword" if i % 3 == 0 else f"hotword login word{i}") for i in range(900)]
    index = build_index(spark.createDataFrame(c, KIND), block_texts=100)
    got = found(search(spark.createDataFrame(q, KIND), index, 4, query_rows=64))
    assert len(got) == 1200 and {g[1:3] for g in got} == {(1, 0), (2, 3), (3, 6), (4, 9)}


def test_blocks_below_the_kth_score_are_skipped(spark):
    c = [(i, "refund please") for i in range(50)] + [(100 + i, "refund " + " ".join(f"filler{j}" for j in range(200))) for i in range(400)]
    index, report = build_index(spark.createDataFrame(c, KIND), block_texts=25), {}
    got = found(search(spark.createDataFrame([(1, "refund")], KIND), index, 3, report=report))
    assert [g[2] for g in got] == [0, 1, 2]
    assert report["pairs"] >= 18 and report["scored_pairs"] <= 4 and report["scored_postings"] < report["postings"] / 4


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame([(1, "the of"), (2, "xyz"), (3, None)], KIND)
    assert found(search(some, build_index(none))) == [] and found(search(none, build_index(some))) == []
    assert found(search(some, build_index(spark.createDataFrame([(1, "app crash")], KIND)))) == []


def test_plan_reads_no_text_and_has_no_cross_join(spark):
    df = spark.createDataFrame([(1, "app crash")], KIND)
    plan = search(df, build_index(df))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "/texts" not in plan
    for operator in ["CartesianProduct", "BroadcastNestedLoopJoin"]:
        assert operator not in plan


REQUESTS = [(1, "song refund please"), (2, "   "), (3, "app keeps crashing")]


def test_versions_and_manifest(spark, tmp_path):
    index, out = f"{tmp_path}/index", f"{tmp_path}/out"
    kind = "tweet_id bigint, text string"
    with pytest.raises(ValueError):
        latest_version(spark, index)
    publish_index(spark.createDataFrame([(10, "old refund")], kind), index, 1)
    assert batch_version(spark, out, index, 0) == 1
    publish_index(spark.createDataFrame([(11, "new refund")], kind), index, 2)
    assert batch_version(spark, out, index, 0) == 1  # run again: as it was
    assert batch_version(spark, out, index, 1) == latest_version(spark, index) == 2


def test_stream_takes_up_new_versions_and_survives_a_restart(spark, tmp_path):
    index, out = f"{tmp_path}/index", f"{tmp_path}/out"
    kind = "tweet_id bigint, text string"
    arriving = spark.createDataFrame(REQUESTS, kind)
    arriving.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(arriving.schema).parquet(f"{tmp_path}/in")

    def run():
        triage_stream(stream, index, out, f"{tmp_path}/ck", brand="Acme").awaitTermination()
        return {r.tweet_id: r for r in spark.read.parquet(out).collect()}

    publish_index(spark.createDataFrame([(10, "old refund")], kind), index, 1)
    first = run()
    assert [e.text for e in first[1].evidence] == ["old refund"] and first[2].system is None
    assert first[1].system.startswith("You are drafting a Acme support reply.") and first[1].system.endswith("Evidence:\n- old refund")
    assert first[3].system.endswith("Evidence:\n")
    publish_index(spark.createDataFrame([(11, "new refund")], kind), index, 2)
    spark.createDataFrame([(4, "refund")], kind).write.mode("append").parquet(f"{tmp_path}/in")
    second = run()
    assert len(second) == 4 and [e.text for e in second[4].evidence] == ["new refund"] and [e.text for e in second[1].evidence] == ["old refund"]


def test_scans_of_a_batch(spark, tmp_path):
    corpus = spark.createDataFrame([(10, "old refund")], "tweet_id bigint, text string")
    spark.createDataFrame(REQUESTS, "tweet_id bigint, text string").write.parquet(f"{tmp_path}/requests")
    index = build_index(corpus, corpus_id="tweet_id")
    triaged = triage_requests(spark.read.parquet(f"{tmp_path}/requests"))
    plan = attach_evidence(triaged, index, "Acme")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 12
