"""Exact top-k retrieval by vector or by word overlap.

Every query has to be compared with every corpus row, so the work is laid out as
a grid: both sides are cut into blocks of bounded size by a hash of their unique
id, each cell of the grid (query block, corpus block) is one cogrouped task-sized
unit that scores its pairs in memory and emits only its own k best per query,
and a window keeps the k best over all cells.  Pairs are never materialised as
rows, nothing is broadcast, and no block depends on how often a word, text or
vector occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import query_tokens, tokens

# Rows per block.  Each block is copied once per block of the other side, so larger blocks
# mean less to shuffle: a corpus vector once per 32,768 queries.  A cell multiplies as many
# queries at a time as have scores of VECTOR_TILE bytes; only they are held in double
# precision.  For texts it holds the words of its rows.
QUERY_BLOCK = 1024
VECTOR_QUERY_BLOCK = 32768
VECTOR_TILE = 1 << 22
VECTOR_BLOCK = 8192
TEXT_BLOCK = 4096
MIN_BLOCK = 256

_CELL_SCHEMA = "query_id bigint, corpus_id bigint, score double"


def l2_normalize(vector: Column) -> Column:
    """Vector of unit length in double precision; a zero vector stays as it is."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def usable_vector(vector: Column) -> Column:
    """Whether a vector exists and all its elements are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _blocks(df: DataFrame, rows_per_block: int) -> Column:
    """Number of blocks as a scalar subquery: as many as the block size asks for, and
    for smaller tables enough to keep every core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = F.count("*")
    needed = F.ceil(n / F.lit(rows_per_block))
    useful = F.least(F.ceil(n / F.lit(MIN_BLOCK)), F.lit(cores))
    return df.agg(F.greatest(needed, useful, F.lit(1)).cast("int")).scalar()


def _best_over_cells(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    return scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k).select(
        "query_id", "rk", "corpus_id", "score"
    )


def _grid_topk(
    queries, corpus, k, score_cell, query_rows, corpus_rows, at_most=None
) -> DataFrame:
    """Top-k of ``score_cell`` over all pairs of (query_id, payload) and (corpus_id, payload).

    ``at_most`` is a table with at least as many rows as ``queries`` that is cheaper to count.
    """
    n_query = _blocks(queries if at_most is None else at_most, query_rows)
    n_corpus = _blocks(corpus, corpus_rows)

    def cells(df, id_col, own, own_blocks, other, other_blocks):
        return df.withColumns(
            {
                own: F.pmod(F.xxhash64(id_col), own_blocks).cast("int"),
                other: F.explode(F.sequence(F.lit(0), other_blocks - 1)),
            }
        )

    q = cells(queries, "query_id", "qb", n_query, "cb", n_corpus)
    c = cells(corpus, "corpus_id", "cb", n_corpus, "qb", n_query)
    scored = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(
        score_cell, _CELL_SCHEMA
    )
    return _best_over_cells(scored, k)


def _vector_cell(k: int):
    def score(q, c):
        import numpy as np
        import pyarrow as pa

        def unit(column):
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
            rows = flat.reshape(len(column), -1)
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            rows /= np.where(norm > 0, norm, 1.0)
            return rows

        ids, found, scores = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "float64")
        if q.num_rows and c.num_rows:
            corpus_ids = c["corpus_id"].to_numpy()
            corpus_units = unit(c["payload"].combine_chunks()).T
            keep = min(k, len(corpus_ids))
            ids = np.repeat(q["query_id"].to_numpy(), keep)
            found, scores = np.empty(len(ids), corpus_ids.dtype), np.empty(len(ids))
            tile, at = max(1, VECTOR_TILE // (8 * len(corpus_ids))), 0
            for part in q.select(["payload"]).to_batches(max_chunksize=tile):
                # Rounded, so that equal vectors tie whatever order a product is summed in.
                table = unit(part.column(0)) @ corpus_units
                for row in np.round(table, 9, out=table):
                    kth = np.partition(row, -keep)[-keep]
                    near = np.flatnonzero(row >= kth)
                    best = near[np.lexsort((corpus_ids[near], -row[near]))[:keep]]
                    found[at : at + keep] = corpus_ids[best]
                    scores[at : at + keep] = row[best]
                    at += keep
        return pa.table(
            {
                "query_id": pa.array(ids, pa.int64()),
                "corpus_id": pa.array(found, pa.int64()),
                "score": pa.array(scores, pa.float64()),
            }
        )

    return score


def dense_topk(
    queries: DataFrame, corpus: DataFrame, k: int = fv.TOP_K, id_col: str = "id",
    vector: str = "embedding", query_rows: int = VECTOR_QUERY_BLOCK, corpus_rows: int = VECTOR_BLOCK,
) -> DataFrame:
    """The ``k`` corpus rows of highest cosine similarity for every query, exactly.

    Both frames have a unique integer ``id_col`` and vectors of one length.  A zero
    vector scores 0 against everything.  Equal scores rank by id.  Rows whose vector is
    NULL or has a NULL, NaN or infinite element take no part, on either side; count them
    with ``usable_vector``.
    """
    def side(df, name):
        return df.where(usable_vector(F.col(vector))).select(
            F.col(id_col).cast("bigint").alias(name), F.col(vector).alias("payload")
        )

    return _grid_topk(
        side(queries, "query_id"), side(corpus, "corpus_id"), k, _vector_cell(k), query_rows,
        corpus_rows,
    )


def dense_top1(queries: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """Highest similarity of every query, as a ticket feature."""
    return dense_topk(queries, corpus, k=1, **options).select(
        "query_id", F.col("score").alias("top_score")
    )


def _word_cell(k: int):
    def score(q, c):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, found, scores = [], [], []
        if q.num_rows and c.num_rows:
            query_ids = q["query_id"].to_numpy()
            corpus_ids = c["corpus_id"].to_numpy()
            q_words = q["payload"].combine_chunks()
            c_words = c["payload"].combine_chunks()
            n_docs = len(corpus_ids)
            doc_len = pc.list_value_length(c_words).to_numpy(zero_copy_only=False)
            vocabulary = pc.unique(q_words.flatten())
            q_code = pc.index_in(q_words.flatten(), value_set=vocabulary).to_numpy()
            q_end = np.cumsum(pc.list_value_length(q_words).to_numpy(zero_copy_only=False))

            # Postings: occurrences of each query word per document, sorted by word.
            code = pc.index_in(c_words.flatten(), value_set=vocabulary)
            known = pc.is_valid(code)
            doc = pc.list_parent_indices(c_words).filter(known).to_numpy().astype("int64")
            pair = code.filter(known).to_numpy().astype("int64") * n_docs + doc
            pair, times = np.unique(pair, return_counts=True)
            posting_doc = pair % n_docs
            bounds = np.searchsorted(pair, np.arange(len(vocabulary) + 1) * n_docs)

            for i, query_id in enumerate(query_ids):
                words = q_code[(q_end[i - 1] if i else 0):q_end[i]]
                first, size = bounds[words], bounds[words + 1] - bounds[words]
                total = int(size.sum())
                if not total:
                    continue
                # Positions of all postings of the query's words, without a loop over words.
                at = np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)
                hits = np.bincount(posting_doc[at], weights=times[at], minlength=n_docs)
                near = np.flatnonzero(hits)
                value = hits[near] / np.sqrt(len(words) * doc_len[near].astype("float64"))
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


def lexical_topk(
    queries: DataFrame, corpus: DataFrame, k: int = fv.TOP_K, query_id: str = "id",
    corpus_id: str = "id", query_text: str = "text", corpus_text: str = "text",
    query_rows: int = TEXT_BLOCK, corpus_rows: int = TEXT_BLOCK, at_most: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` corpus texts sharing most words with every query, exactly.

    Score: occurrences in the text of words of the query, over the square root of
    (distinct query words x words of the text).  Texts that share no word do not
    appear; equal scores rank by id.  Blocks hold whole texts: lower ``query_rows`` and
    ``corpus_rows`` for texts of megabytes.  ``at_most``: a table with at least as many rows
    as ``queries`` that is cheaper to count, for the choice of blocks.
    """
    q = queries.select(
        F.col(query_id).cast("bigint").alias("query_id"),
        query_tokens(F.col(query_text)).alias("payload"),
    )
    c = corpus.select(
        F.col(corpus_id).cast("bigint").alias("corpus_id"), tokens(F.col(corpus_text)).alias("payload")
    )
    return _grid_topk(q, c, k, _word_cell(k), query_rows, corpus_rows, at_most)


def with_evidence_text(
    topk: DataFrame, corpus: DataFrame, id_col: str = "id", text: str = "text"
) -> DataFrame:
    """Attach the corpus text to ranked rows.

    Hits are few against the corpus, so its texts are first narrowed to them: they are
    the small side of that join, and other texts are not shuffled again.
    """
    texts = corpus.select(
        F.col(id_col).alias("corpus_id"), F.coalesce(text, F.lit("")).alias("text")
    ).join(topk.select("corpus_id").distinct(), "corpus_id", "left_semi")
    return topk.join(texts, "corpus_id")
