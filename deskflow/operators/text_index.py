"""A stored inverted index for exact top-k retrieval by word overlap.

Texts are dealt into blocks of texts of similar length, so a block holds about
BLOCK_BYTES at most, or one text, whether its texts have ten words or a million.  The index has a row per
block and word: the texts of the block that hold it, how often, their lengths, and the
largest impact of the word in the block (occurrences over the square root of the length).
A frequent word thus has many short rows, and a text lies wholly in one block.

A search joins the words of the queries with the largest impacts only.  Their sum bounds
every score in a block.  The most promising block of each query is scored first; its k-th
score then rules out all blocks whose bound lies below, and only what is left is read and
scored, block by block, in Arrow batches that emit k rows per query at most.  The result is
exact, and no corpus text is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import query_tokens, tokens
from ..session import fresh_folder

BLOCK_BYTES = 8 << 20
BLOCK_TEXTS = 4096
QUERY_BLOCK = 32768
TEXT_BUCKETS = 16
# Bounds and scores add the same numbers in different orders.
_SLACK = 1 - 1e-9
_POSTINGS = "block string, token string, max_impact double, texts int, corpus_ids array<bigint>, times array<int>, lengths array<int>"
_TEXTS = "corpus_id bigint, text string, bucket int"
_HITS = "query_id bigint, corpus_id bigint, score double"


@dataclass(frozen=True)
class TextIndex:
    """One version of an index: a folder with its postings and its texts."""

    folder: str

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_POSTINGS).parquet(f"{self.folder}/postings")

    def texts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_TEXTS).parquet(f"{self.folder}/texts")


def _postings(texts: DataFrame, block_bytes: int, block_texts: int) -> DataFrame:
    words = texts.select(
        "corpus_id", F.floor(F.log2(F.octet_length("text") + 1)).cast("int").alias("size_class"), tokens(F.col("text")).alias("words")
    ).where("size(words) > 0")
    # one row per power of two; lengths are told by bytes, so that no text is split for it
    per_block = F.greatest(F.lit(1), F.least(F.lit(block_texts), F.floor(F.lit(block_bytes) / F.pow(2.0, F.col("size_class") + 1))))
    classes = texts.groupBy(F.floor(F.log2(F.octet_length("text") + 1)).cast("int").alias("size_class")).agg(F.count("*").alias("n"))
    classes = classes.select("size_class", F.ceil(F.col("n") / per_block).alias("blocks"))
    block = F.concat_ws("-", "size_class", F.pmod(F.xxhash64("corpus_id"), "blocks")).alias("block")
    return words.join(classes, "size_class").select(block, "corpus_id", "words").groupBy("block").applyInArrow(_inverted, _POSTINGS)


def _inverted(group):
    """The postings of one block: a row per word, its texts by id."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    group = group.sort_by("corpus_id").combine_chunks()
    words, corpus_ids = group["words"].combine_chunks(), group["corpus_id"].to_numpy()
    length = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype("int32")
    coded = words.flatten().dictionary_encode()
    pair = coded.indices.to_numpy().astype("int64") * len(length) + np.repeat(np.arange(len(length)), length)
    pair, times = np.unique(pair, return_counts=True)
    word, text = pair // len(length), pair % len(length)
    ends = np.searchsorted(word, np.arange(len(coded.dictionary) + 1))
    impact = np.maximum.reduceat(times / np.sqrt(length[text].astype("float64")), ends[:-1])
    lists = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
    return pa.table(
        {
            "block": pa.repeat(group["block"][0], len(coded.dictionary)),
            "token": coded.dictionary,
            "max_impact": pa.array(impact),
            "texts": pa.array(np.diff(ends).astype("int32")),
            "corpus_ids": lists(corpus_ids[text]),
            "times": lists(times.astype("int32")),
            "lengths": lists(length[text]),
        }
    )


def build_index(
    corpus: DataFrame, folder: str | None = None, corpus_id: str = "id", text: str = "text",
    block_bytes: int = BLOCK_BYTES, block_texts: int = BLOCK_TEXTS,
) -> TextIndex:
    """Store the index of a corpus below ``folder`` (by default a fresh one in the shared folder).

    Ids must be unique.  Texts that are NULL or without words are in no block, so they are
    never found.  Texts are kept beside the postings, in buckets by id, for those that are.
    """
    spark = corpus.sparkSession
    index = TextIndex(folder or fresh_folder(spark, "text-index"))
    texts = corpus.select(F.col(corpus_id).cast("bigint").alias("corpus_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts.withColumn("bucket", _bucket("corpus_id")).write.partitionBy("bucket").parquet(f"{index.folder}/texts")
    _postings(index.texts(spark), block_bytes, block_texts).sortWithinPartitions("block", "token").write.parquet(f"{index.folder}/postings")
    return index


def _bucket(id_col: str):
    return F.pmod(F.xxhash64(id_col), F.lit(TEXT_BUCKETS)).cast("int")


def _score_cell(k: int):
    def score(q, c):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, found, scores = [], [], []
        if q.num_rows and c.num_rows:
            # Postings of the block, word after word; texts numbered from 0.
            lists = c["corpus_ids"].combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            corpus_ids, first, text = np.unique(lists.flatten().to_numpy(), return_index=True, return_inverse=True)
            times = c["times"].combine_chunks().flatten().to_numpy()
            length = c["lengths"].combine_chunks().flatten().to_numpy()[first].astype("float64")
            words = q["words"].combine_chunks()
            code = pc.index_in(words.flatten(), value_set=c["token"].combine_chunks())
            code = code.fill_null(-1).to_numpy()
            end = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
            for i, query_id in enumerate(q["query_id"].to_numpy()):
                asked = code[(end[i - 1] if i else 0):end[i]]
                n_words, asked = len(asked), asked[asked >= 0]
                size = sizes[asked]
                total = int(size.sum())
                if not total:
                    continue
                at = np.arange(total) + np.repeat(begin[asked] - (np.cumsum(size) - size), size)
                hits = np.bincount(text[at], weights=times[at], minlength=len(corpus_ids))
                near = np.flatnonzero(hits)
                value = hits[near] / np.sqrt(n_words * length[near])
                if len(near) > k:
                    top = value >= np.partition(value, -k)[-k]
                    near, value = near[top], value[top]
                best = np.lexsort((corpus_ids[near], -value))[:k]
                ids.append(np.full(len(best), query_id))
                found.append(corpus_ids[near[best]])
                scores.append(value[best])
        join = lambda parts, t: np.concatenate(parts) if parts else np.empty(0, t)
        return pa.table(
            {
                "query_id": pa.array(join(ids, "int64"), pa.int64()),
                "corpus_id": pa.array(join(found, "int64"), pa.int64()),
                "score": pa.array(join(scores, "float64"), pa.float64()),
            }
        )

    return score


def _scored(pairs: DataFrame, postings: DataFrame, k: int, parts: int) -> DataFrame:
    """The k best texts of each (query, block) pair; a block's postings are copied once per QUERY_BLOCK queries."""
    q = pairs.select("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "query_id", "words")
    asked = q.select("block", "part", F.explode("words").alias("token")).distinct()
    c = postings.join(asked, ["block", "token"]).select(
        F.col("block").alias("of_block"), F.col("part").alias("of_part"), "token", "corpus_ids", "times", "lengths"
    )
    return q.groupBy("block", "part").cogroup(c.groupBy("of_block", "of_part")).applyInArrow(_score_cell(k), _HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    return hits.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k).select("query_id", "rk", "corpus_id", "score")


def bounds(queries: DataFrame, postings: DataFrame, query_id: str = "id", query_text: str = "text") -> DataFrame:
    """(query_id, words, block, bound, postings): the largest score a block can hold for each query that shares a word with it."""
    q = queries.select(F.col(query_id).cast("bigint").alias("query_id"), query_tokens(F.col(query_text)).alias("words"))
    q = q.where("size(words) > 0")
    shared = q.select("query_id", F.explode("words").alias("token")).join(
        postings.select("token", "block", "max_impact", "texts"), "token"
    )
    sums = shared.groupBy("query_id", "block").agg(F.sum("max_impact").alias("impact"), F.sum("texts").alias("postings"))
    return sums.join(q, "query_id").select(
        "query_id", "words", "block", (F.col("impact") / F.sqrt(F.size("words").cast("double"))).alias("bound"), "postings"
    )


def search(
    queries: DataFrame, index: TextIndex, k: int = fv.TOP_K, query_id: str = "id", query_text: str = "text",
    query_rows: int = QUERY_BLOCK, report: dict | None = None,
) -> DataFrame:
    """The ``k`` texts sharing most words with every query, exactly: query_id, rk, corpus_id, score.

    Score: occurrences in the text of words of the query, over the square root of
    (distinct query words x words of the text).  Texts that share no word do not
    appear; equal scores rank by id.  Bounds and first hits are stored once below the shared
    folder.  ``report`` receives how many (query, block) pairs and postings there were and how
    many were scored.
    """
    spark = queries.sparkSession
    postings = index.postings(spark)
    folder = fresh_folder(spark, "search")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds(queries, postings, query_id, query_text).withColumn("nth", F.row_number().over(by_bound)).write.parquet(f"{folder}/bounds")
    pairs = spark.read.parquet(f"{folder}/bounds")
    parts = max(1, -(-pairs.where("nth = 1").count() // query_rows))
    _scored(pairs.where("nth = 1"), postings, k, parts).write.parquet(f"{folder}/first")
    first = spark.read.parquet(f"{folder}/first")
    # the k-th score so far, if there are k
    kth = _best(first, k).where(F.col("rk") == k).select("query_id", F.col("score").alias("kth"))
    left = pairs.where("nth > 1").join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") * _SLACK))
    left.write.parquet(f"{folder}/rest")
    rest = spark.read.parquet(f"{folder}/rest")
    if report is not None:
        sums = [F.count("*"), F.coalesce(F.sum("postings"), F.lit(0))]
        every, begun, more = (df.agg(*sums).first() for df in (pairs, pairs.where("nth = 1"), rest))
        report.update(pairs=every[0], postings=every[1], scored_pairs=begun[0] + more[0], scored_postings=begun[1] + more[1])
    return _best(first.unionAll(_scored(rest, postings, k, parts)), k)


def hit_texts(hits: DataFrame, index: TextIndex) -> DataFrame:
    """Attach the texts of ranked rows, reading the buckets that hold them."""
    wanted = hits.withColumn("bucket", _bucket("corpus_id"))
    return wanted.join(index.texts(hits.sparkSession), ["bucket", "corpus_id"]).drop("bucket")
