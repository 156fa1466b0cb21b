from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from sparkloom.llm import langid
from sparkloom.llm.runtime import stash


def test_trigrams_of_a_batch_are_counted_in_small_pieces():
    rng = random.Random(3)
    letters = "abcdefghij klmnop qrstuvwxyz"
    texts = ["".join(rng.choices(letters, k=2000)) for _ in range(1500)] + [None, "", "ab"]
    langs = [("de", "en")[k % 2] for k in range(len(texts))]
    batch = pa.record_batch({"lang": langs, "text": texts})
    tracemalloc.start()
    got = list(langid._counted(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20, peak
    for name in ("de", "en"):
        own = np.zeros(langid.BUCKETS, np.int64)
        for text in (t for t, x in zip(texts, langs, strict=True) if x == name and t):
            data = np.frombuffer(text.encode(), np.uint8)
            own += np.bincount(langid._trigrams(data, np.array([0, len(data)]))[0], minlength=langid.BUCKETS)
        counted = next(b for b in got if b.column(0)[0].as_py() == name)
        assert dict(zip(*(c.to_pylist() for c in counted.columns[1:]), strict=True)) == {k: n for k, n in enumerate(own.tolist()) if n}


def test_stashed_batches_hold_few_bytes_and_every_row(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    texts = spark.range(0, 1200, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 10000) as text")
    got = stash(texts.mapInArrow(sizes, "n bigint, bytes bigint"), "sizes").collect()
    assert sum(r["n"] for r in got) == 1200 and max(r["bytes"] for r in got) < 3 << 20
