import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from deskflow.llm import near_dedup as nd
from deskflow.llm import toxicity as tx


class Frame:
    """Stands for a table of doc_id and text; gives the function that its tasks would run."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("run", [
    nd.signed(Frame(), "doc_id", "text", 5), tx.scored(Frame(), tx.Classifier(np.arange(9), np.ones(9), 0.0)),
], ids=["near_dedup", "toxicity"])
def test_a_task_holds_little_beside_its_batch(run):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**4)}" for _ in range(10**4)]
    texts = [" ".join(rng.choices(words, k=700)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["doc_id", "text"])
    assert batch.nbytes > 4_000_000
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 1000 and peak < 40 << 20
