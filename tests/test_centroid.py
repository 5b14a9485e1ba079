"""Nearest centroid: one block against many, and against plain Python."""

import math
import random

import pytest

from facetlens.operators import classify as CF


def brute(rows):
    sums = {}
    for _, label, v in rows:
        if label is not None and v:
            n, s = sums.get(label, (0, [0.0] * len(v)))
            sums[label] = n + 1, [a + b for a, b in zip(s, v)]
    means = {l: [x / n for x in s] for l, (n, s) in sums.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v))

    def loss(v, c):
        if not v or not norm(v) or not norm(c):
            return 2.0
        return -sum(a * b for a, b in zip(v, c)) / (norm(v) * norm(c))

    return sorted((k, l or "", min((round(loss(v, c), 12), name) for name, c in means.items())[1]) for k, l, v in rows)


@pytest.mark.parametrize("block_bytes", [8 << 20, 100])
def test_nearest_centroid_in_blocks(spark, block_bytes):
    rng = random.Random(4)
    rows = [(i, f"l{i % 9}", [rng.choice([-1.0, 0.5, 2.0, 3.25]) + (i % 9 == j) * 3 for j in range(9)]) for i in range(200)]
    rows += [rows[3], rows[3], (500, None, rows[1][2]), (501, "l1", None), (502, "l2", [0.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = CF.nearest_centroid(df, "label", "embedding", "vec_id", block_bytes=block_bytes).collect()
    assert sorted((r.vec_id, r.label or "", r.pred_label) for r in got) == brute(rows)
    assert CF.nearest_centroid(df.limit(0), "label", "embedding", "vec_id", block_bytes=block_bytes).count() == 0
