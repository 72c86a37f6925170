import hashlib
from collections import defaultdict

from deskflow.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, marked

LOWER = {c: c + 32 for c in range(65, 91)}


def norm(text):
    return (text or "").translate(LOWER)


def test_against_brute_force(odd):
    rows = [r.asDict() for r in odd.collect()]
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r["doc_id"])
    expected = sorted(
        (str(r["doc_id"]), str(max((i for i in groups[norm(r["text"])] if i is not None), default=None)), len(groups[norm(r["text"])]),
         hashlib.sha256(norm(r["text"]).encode()).hexdigest()) for r in rows
    )
    found = exact_duplicates(odd).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == expected
    kept = defaultdict(int)
    for r in found:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_rows_that_stay(odd_wide, empty):
    found = drop_exact_duplicates(odd_wide)
    assert found.columns == odd_wide.columns
    rows = found.collect()
    assert len(rows) == len({norm(r.text) for r in odd_wide.collect()})
    assert sorted(r.doc_id for r in rows if r.text and norm(r.text).startswith("the same")) == [2]
    assert drop_exact_duplicates(empty).count() == 0 and exact_duplicates(empty).count() == 0


def test_filter_marks_all_repetitions_and_few_others(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CONCAT('text ', IF(id % 10 = 0, id % 400, id)) AS text").repartition(7)
    rows = marked(df, shard_keys=256).selectExpr("doc_id % 10 = 0 AS twice", "__llm_maybe AS maybe").groupBy("twice", "maybe").count().collect()
    n = {(r.twice, r.maybe): r["count"] for r in rows}
    assert (True, False) not in n and n[(True, True)] == 400
    # ids under 400 that end in 0 are the only ones whose text occurs elsewhere; others are chance hits
    assert n.get((False, True), 0) < 100


def test_hot_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'Hot', CAST(id AS STRING)) AS text").repartition(8)
    hot = exact_duplicates(df, shard_keys=512).where("group_size > 1").groupBy("keep_id", "group_size").count().collect()
    assert [tuple(r) for r in hot] == [(2997, 1000, 1000)]
