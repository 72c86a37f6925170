import random

import pandas as pd
from pyspark.sql import functions as F

from deskflow.functions import fixed_values as fv
from deskflow.operators import threads as th
from deskflow.sources.tables import write_table
from deskflow.sources.threads import read_corpus, read_threads

CSV = '''tweet_id,extra,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
1,x,Brand,False,d,"said ""hi"",
on two lines",2,
2,x,u1,True,d,@brand help,"3,4",1.0
3,x,Brand,False,d,,,2
9007199254740993,x,u2,True,d,"no, thanks",12.0,9007199254740993.0
'''


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    rows = read_threads(spark, str(tmp_path)).orderBy("tweet_id").collect()
    assert rows[0].text == 'said "hi",\non two lines' and rows[0].in_response_to_tweet_id is None
    assert rows[1].response_tweet_id == "3,4" and rows[1].in_response_to_tweet_id == 1 and rows[1].inbound
    assert rows[2].text is None
    assert rows[3].in_response_to_tweet_id == 9007199254740993 and rows[3].response_tweet_id == "12"
    assert [r.text for r in read_corpus(spark, str(tmp_path)).where("tweet_id = 3").collect()] == [""]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    df = read_threads(spark, str(tmp_path / "t.csv"))
    write_table(df, str(tmp_path / "out"), "csv")
    assert sorted(read_threads(spark, str(tmp_path / "out")).collect(), key=str) == sorted(df.collect(), key=str)


SCHEMA = "tweet_id bigint, author_id string, inbound boolean, text string, response_tweet_id string, in_response_to_tweet_id bigint"


def thread_rows(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        brand = rng.random() < 0.1
        answers = ",".join(str(rng.randrange(n)) for _ in range(rng.randint(0, 3))) or None
        # A third of all posts answer the same one.
        parent = 0 if rng.random() < 0.33 else rng.choice([None, rng.randrange(n)])
        text = rng.choice(["hello", "@BRAND hi", None, "I was hacked", "a long story about a refund and more of it"])
        rows.append((i, "Brand" if brand else rng.choice(["u", None]), not brand, text, answers, parent))
    return rows


def test_brand_subset_matches_a_loop(spark):
    rows = thread_rows()
    ids = {r[0] for r in rows if r[1] == "Brand"}
    expected = [
        r[0] for r in rows
        if r[1] == "Brand" or r[5] in ids or "@brand" in (r[3] or "").lower()
        or any(int(x) in ids for x in (r[4] or "").split(",") if x)
    ]
    df = th.brand_subset(spark.createDataFrame(rows, SCHEMA), "Brand")
    assert sorted(r.tweet_id for r in df.collect()) == expected
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_leakage_matches_a_loop(spark):
    rows = thread_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    golden = df.where("tweet_id % 3 = 0").select("tweet_id")
    corpus = th.reply_corpus(df)
    replies = {r[0] for r in rows if not r[2] and r[3] is not None}
    chosen = [r for r in rows if r[0] % 3 == 0 and r[4]]
    row = th.leakage_audit(df, golden, corpus).first()
    assert row.with_response == len(chosen)
    assert row.leaked == sum(any(int(x) in replies for x in r[4].split(",")) for r in chosen)


def ordered(spark, rows, seed=fv.SAMPLE_SEED):
    import hashlib

    return sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0]))


def test_golden_set_matches_a_loop(spark):
    rows = thread_rows(900)
    picked, names = [], []
    customers = ordered(spark, [r for r in rows if r[2]])
    strata = [
        ("random", 100, lambda t: True),
        ("risk", 50, lambda t: t and any(w in t.lower() for w in fv.STRATUM_RISK_WORDS)),
        ("short", 50, lambda t: t is not None and len(t) < 40),
    ]
    for name, size, test in strata:
        take = [r[0] for r in customers if test(r[3]) and r[0] not in picked][:size]
        picked += take
        names += [name] * len(take)
    got = th.golden_set(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.tweet_id, r.stratum) for r in got) == sorted(zip(picked, names))
    assert {(r.true_intent, r.should_escalate, r.notes) for r in got} == {("", "", "")}


def test_golden_set_moves_few_rows(spark):
    rows = [(i, "a", True, "fraud" if i % 2 else "a long text about nothing in particular, so not short", None, None) for i in range(30_000)]
    plan = th.golden_set(spark.createDataFrame(rows, SCHEMA).repartition(5))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan


def test_golden_set_of_a_small_table(spark):
    rows = [(i, "u", True, "hacked" if i % 2 else "hi", None, None) for i in range(30)]
    got = th.golden_set(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 30 and {r.stratum for r in got} == {"random"}


def test_samples_are_repeatable_whatever_the_layout(spark):
    df = spark.range(1000).withColumnRenamed("id", "tweet_id")
    first = [r[0] for r in th.sample_n(df, "tweet_id", 50).collect()]
    again = [r[0] for r in th.sample_n(df.repartition(7), "tweet_id", 50).collect()]
    assert first == again and len(set(first)) == 50
    assert first != [r[0] for r in th.sample_n(df, "tweet_id", 50, seed=1).collect()]


def test_counts_and_required_columns(spark):
    df = spark.createDataFrame(thread_rows(), SCHEMA)
    counts = {r.inbound: r.n for r in th.subset_counts(df).collect()}
    assert sum(counts.values()) == 400
    nan = spark.createDataFrame(pd.DataFrame({"a": [1.0, float("nan"), 2.0]}))
    assert th.require(nan, ["a"]).count() == 2


def test_large_sample_sorts_no_rows(spark):
    rows = spark.range(20_000).select(F.col("id").alias("tweet_id"), F.lit("x" * 60).alias("text"))
    sample = th.sample_n(rows, "tweet_id", 1500, 7)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    # the only window runs over counts per key prefix
    windows = [line for line in plan.splitlines() if " Window " in line or "Window [" in line]
    assert windows and all("rows_here" in line for line in windows)
    keys = {r.tweet_id: r.k for r in rows.select("tweet_id", th.sample_order(F.col("tweet_id"), 7).alias("k")).collect()}
    expected = sorted(keys, key=lambda i: (keys[i], i))[:1500]
    assert sorted(r.tweet_id for r in sample.collect()) == sorted(expected)
    assert th.sample_n(rows, "tweet_id", 30_000).count() == 20_000
