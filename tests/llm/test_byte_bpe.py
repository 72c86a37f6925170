import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from deskflow.llm import byte_bpe
from deskflow.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(text, segment=byte_bpe.SEGMENT):
    return memoryview(byte_bpe.token_ids(text.encode(), PATH, PATTERN, segment)).cast("I").tolist()


def test_all_code_points(library):
    for first in range(0, 0x110000, 512):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!  {chr(c)}\n" for c in range(first, first + 512) if not 0xD800 <= c < 0xE000)
        assert ours(text) == library.encode_ordinary(text)


def test_mixtures_and_segments(library):
    draw = random.Random(3)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "é", "中", "1", "'s", "!", "‍", "👍", "ing", "aaaa", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(draw.choices(parts, k=draw.randint(0, 80)))
        assert ours(text) == ours(text, 5) == library.encode_ordinary(text)


def test_matches_against_the_definition():
    merges, draw = byte_bpe._opened(PATH), random.Random(4)
    for _ in range(300):
        data = bytes(draw.choices(b"abcdeinotrs\xc3\xa9\xe4", k=draw.randint(1, 30)))
        if data not in merges.ranks:
            assert merges.encode(data) == merges.by_merging(data)


def test_long_matches_take_linear_time(library):
    for text in ("ab" * 200_000, " " * 300_000, "x" + "é" * 200_000):
        assert library.decode_bytes(ours(text)) == text.encode()
    assert ours("ab" * 8_000) == library.encode_ordinary("ab" * 8_000)


def test_ranks_out_of_order_are_an_error():
    single = {bytes([i]): i + 10 for i in range(256)}
    with pytest.raises(ValueError):
        byte_bpe.Merges({**single, b"abc": 1, b"ab": 2})


def test_tokens_that_no_merges_reach():
    merges = byte_bpe.Merges({**{bytes([i]): i for i in range(256)}, b"ab": 256, b"abcd": 257})
    assert merges.encode(b"abcd") == [257]
    assert merges.encode(b"xabcd") == merges.by_merging(b"xabcd") == [120, 256, 99, 100]


def test_odd_rows(spark, odd, odd_wide, empty):
    for df in (odd, odd_wide, empty):
        ids = byte_bpe.encode(df, PATH, PATTERN)
        back = byte_bpe.decode(ids.withColumn("n", F.size("ids")), PATH).collect()
        assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back) == sorted((str(r.doc_id), r.text or "") for r in df.collect())
    assert byte_bpe.encode(odd, PATH, PATTERN).where("size(ids) = 0").count() == odd.where("coalesce(text, '') = ''").count()


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [220, 220])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(df, PATH).collect()} == {1: b"", 2: b"", 3: b"  "}
    for bad in (-1, 50256, None):
        with pytest.raises(Exception, match="does not hold"):
            byte_bpe.decode(spark.createDataFrame([(1, [bad])], "doc_id long, ids array<int>"), PATH).collect()


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r[1:] for r in QUERIES["op13_byte_bpe"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
