"""What op3 sends between its steps, in bytes."""

import random

import numpy as np
import pyarrow as pa

from ledgerwright.llm import op3_repeats


def test_anchors_take_few_bytes():
    r = random.Random(21)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(2000)) for _ in range(500)]
    docs = pa.table({"block": [0] * len(texts), "doc_id": list(range(len(texts))), "text": texts})
    sent = op3_repeats._anchors(docs, 50, 20, 4)
    number = sum(len(op3_repeats._ascended(x)) for x in sent.column("anchors").to_pylist())
    assert number > 50_000  # all different
    assert sum(map(len, sent.column("anchors").to_pylist())) < 5 * number  # eight bytes each before


def test_packing_is_lossless():
    r = np.random.default_rng(3)
    for n in (0, 1, 1000):
        a = np.sort(r.integers(0, 2**63, n).astype(np.uint64))
        assert (op3_repeats._ascended(op3_repeats._ascending(a)) == a).all()
        for kind in (np.uint8, np.uint16, np.int64):
            x = r.integers(0, 200, n).astype(kind)
            assert (op3_repeats._unpacked(op3_repeats._packed(x), kind) == x).all()


def test_a_block_s_texts_come_compressed_once_each(spark):
    rows = [(i, f"text {i} " + "the same words again " * 60) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    pieces = df.mapInArrow(op3_repeats._pieces(8 << 10, 5), "block bigint, rows binary").toArrow()
    assert set(pieces.column("block").to_pylist()) == set(range(5))
    assert sum(map(len, pieces.column("rows").to_pylist())) < sum(len(t) for _, t in rows) / 3
    assert sorted(zip(*op3_repeats._documents(pieces).to_pydict().values())) == rows
