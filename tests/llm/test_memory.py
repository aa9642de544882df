"""What the workers of the pipeline hold for one batch of texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

import corpus_pipeline as cp
from paperloom.llm import boosted_quality, decontaminate, line_winnow, ngram_join

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(5000)]
ITEM = " ".join(WORDS[:60])


class Shared:
    def __init__(self, value):
        self.value = value


def batch():
    """8 MB of texts, some with a benchmark item."""
    texts = []
    for i in range(3400):
        lines = [" ".join(RNG.choices(WORDS, k=20)) for _ in range(18)]
        texts.append("\n".join([*lines, ITEM] if i % 9 == 0 else lines))
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["key", "doc_id", "text"])


def peak(step) -> float:
    tracemalloc.start()
    for _ in step:
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_a_batch_is_worked_on_in_small_pieces():
    b = batch()
    assert b.nbytes > 8e6
    index = decontaminate.Index([ITEM])
    assert peak(decontaminate._scan(Shared((index, [7])), 0.8, "text", "leaks", T.LongType())(iter([b]))) < 60
    assert peak(ngram_join.sets_of(b.column(2), 5)) < 60
    assert peak(line_winnow._positions(16)(iter([b]))) < 60
    assert peak(boosted_quality.statistics(b.column(2)) for _ in range(1)) < 60


def test_rows_go_down_the_trees_in_blocks():
    rng = np.random.default_rng(5)
    x = rng.random((10_000, len(boosted_quality.NAMES)))
    trees = boosted_quality.Trees(0.1, rng.integers(0, x.shape[1], (80, 7)), rng.random((80, 7)), rng.normal(size=(80, 8)))
    assert peak(trees.score(x) for _ in range(1)) < 20
    whole = trees.score(x)
    assert whole.shape == (10_000,) and trees.score(x[:0]).shape == (0,)
    assert np.array_equal(whole[3000:3010], trees.score(x[3000:3010]))


def test_grams_are_read_one_document_at_a_time():
    """Grams of many documents in one batch: as Python objects only one document's at once."""
    docs, names = 600, [*line_winnow.NUMBERS, "anchor"]
    grams = [[{**dict.fromkeys(names, 0), "line": i, "lines": 1, "number": i, "number_to": i, "before": 60 * i, "after": 60 * i + 60, "anchor": True} for i in range(100)] for _ in range(docs)]
    kind = pa.list_(pa.struct([*((n, pa.int32()) for n in line_winnow.NUMBERS), ("anchor", pa.bool_())]))
    b = pa.RecordBatch.from_arrays([pa.array(range(docs)), pa.array(grams, kind)], names=["key", "g"])
    del grams
    out = []
    assert peak(out.append(x) for x in line_winnow._islands(50)(iter([b]))) < 2
    assert out[0].to_pylist() == [{"key": k, "from_line": 0, "to_line": 99, "words": 6000} for k in range(docs)]


def test_batches_are_bounded_by_bytes(spark):
    """24 MB in one partition of fewer rows than Spark puts in a batch."""

    def sizes(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 8000, 1, 1).selectExpr("id as doc_id", "repeat('abcdefghij', 300) as text")
    for _, stage in cp.STAGES[-2:]:
        spark.conf.unset(name)
        stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        spark.conf.unset(name)
        assert sum(got) > 24e6 and max(got) < cp.BATCH_BYTES + 10_000
