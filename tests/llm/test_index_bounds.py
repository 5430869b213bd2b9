"""What one task of op6 holds for its indexes, and what is staged."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pairforge.llm import byte_dedup
from pairforge.llm.run_index import longest_matches


def batches(rows, size):
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
    names = ["anchor", "doc_id", "own", "mark", "single", "bytes"]
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds)], names)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_indexes_keep_their_bound_and_whole_anchors(monkeypatch, size):
    """Anchors of about a third of the bound, some over several batches; every context has a copy beside its anchor."""
    rng, seen = np.random.default_rng(3), []
    rows = []
    for anchor in range(40):
        text = rng.integers(0, 256, 400).astype(np.uint8).tobytes()
        rows += [(anchor, 10 * anchor + i, 0, 1 << 8 | 201, True, text[i:]) for i in range(int(rng.integers(2, 5)))]
    monkeypatch.setattr(byte_dedup, "INDEX_BYTES", 4000)
    monkeypatch.setattr(byte_dedup, "longest_matches", lambda data, starts: (seen.append(len(data)), longest_matches(data, starts))[1])
    found = {r for b in byte_dedup.index_open(batches(rows, size)) for r in b.column(0).to_pylist()}
    assert found == {row[1] for row in rows}
    assert max(seen) <= 4000 and sum(seen) == sum(len(r[5]) for r in rows)


def test_an_index_takes_less_than_64_bytes_for_each_of_its_own():
    n = 1 << 17
    data, starts = np.random.default_rng(4).integers(0, 256, n).astype(np.uint8), np.arange(0, n + 1, 256)
    tracemalloc.start()
    longest_matches(data, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * n


def test_contexts_of_hot_anchors_are_not_staged(spark, monkeypatch):
    """What is staged apart shuffles the texts once more; in one query the shuffle for the other contexts and the cuts serves."""
    rng, staged, stage, found, calls = random.Random(5), {}, byte_dedup.stage, byte_dedup._found_in_hot, []
    line = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = line(150)
    df = spark.createDataFrame([(i, line(170) + passage + line(170)) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(byte_dedup, "stage", lambda df, name="stage", **options: (staged.update({name: df.columns}), stage(df, name, **options))[1])
    monkeypatch.setattr(byte_dedup, "_found_in_hot", lambda *args: (calls.append(1), found(*args))[1])
    monkeypatch.setattr(byte_dedup, "INDEX_BYTES", 2000)
    assert byte_dedup.remove_repeats(df).count() == 60 and calls
    assert not any({"bytes", "text"} & set(columns) for columns in staged.values())
