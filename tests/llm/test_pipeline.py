"""The pipeline's stages against their plain meaning, and the eleven queries at the smallest size."""

from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from deskflow.llm.queries import QUERIES  # noqa: E402

from test_near_dedup import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(("documents", docs))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages):
    assert list(stages)[1:] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(df.columns == COLUMNS for name, df in stages.items() if name != "packing")


def test_dedup_stages(stages):
    lower = {c: c + 32 for c in range(65, 91)}
    before, after = rows(stages["toxicity"]), rows(stages["exact_dedup"])
    last = {}
    for i in sorted(before):
        last[before[i].text.translate(lower)] = i
    assert set(after) == set(last.values()) and all(after[i] == before[i] for i in after)
    ids = sorted(after)
    least = brute([(i, after[i].text) for i in ids], 5)
    assert set(rows(stages["near_dedup"])) == {i for i, (_, c) in zip(ids, least) if i == c}


def test_mixing_and_packing_stages(stages):
    kept, mixed = rows(stages["near_dedup"]), stages["mixing"].collect()
    times = defaultdict(int)
    for r in mixed:
        assert r == kept[r.doc_id]
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    packed, ends = stages["packing"].collect(), defaultdict(int)
    count = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
        count[r.doc_id] += r.piece == 0
    assert max(ends.values()) <= 4096 and count == times


def test_queries_at_the_smallest_size(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_quality_rules", "op3_lm_scoring", "op4_mixing", "op7_license_scan", "op10_toxicity"):
        assert QUERIES[name](spark, SF).count() == docs, name
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_leave_columns_named_like_their_own(spark, odd):
    from pyspark.sql import functions as F

    from deskflow.llm.exact_dedup import drop_exact_duplicates
    from deskflow.llm.mixing import mixture
    from deskflow.llm.near_dedup import drop_near_duplicates
    from deskflow.llm.toxicity import drop_toxic

    names = ["__row", "__times", "__copy", "__number", "__id", "__llm_score", "__LLM_sha256", "__llm_maybe", "__llm_row"]
    df = odd.withColumns({n: F.concat(F.lit(n), F.coalesce("text", F.lit("null"))) for n in names})
    labels = spark.createDataFrame([(1, 0), (6, 1)], "doc_id long, toxic int")
    for done in (drop_exact_duplicates(df), drop_near_duplicates(df), mixture(df), drop_toxic(df, labels)):
        assert done.columns == df.columns
        rows = done.collect()
        assert rows and all(r[n] == n + ("null" if r.text is None else r.text) for r in rows for n in names)
