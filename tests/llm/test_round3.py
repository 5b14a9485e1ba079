"""Operators 11 and 12 against brute force and the tiktoken library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlens.llm import hard_negatives
from facetlens.llm.byte_bpe import decode_ids, encode_texts, read_ranks

P = pytest.importorskip("public_tokenizers")


def test_byte_bpe_matches_tiktoken(spark):
    import tiktoken

    library = tiktoken.Encoding("test", pat_str=P.PATTERN, special_tokens={},
                                mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")))
    rng = random.Random(3)
    parts = ["don't", "I'LL", "it's", "'s", "'ve", "'x", "''", "  ", " ", "\n", "\r\n", "\t  ", " ", "12", "½", "٣4", "word",
             "naïve", "你好", "é", "😀", "...", "—", "<|endoftext|>", "_a", "\x1c", "\x85", "​", "ſ", "K'l", "�", "'re'd"]
    texts = [None, "", " ", "'", "\n", *parts, "x" * 3000, "ab'" * 20_000, " " * 5000 + "end",
             "word one\n" * 150_000]   # longer than the segments that are scanned at once
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "don't"), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        "*", *[F.lit("x").alias(c) for c in ("ids", "ends", "n_tokens", "decoded")])
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], bytes(r["ids"]), hashlib.sha256(r["decoded"]).hexdigest())
                 for r in decode_ids(encode_texts(docs)).select("doc_id", "n_tokens", "ids", "decoded").collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert encode_texts(docs.limit(0)).count() == 0


def brute_negatives(rows):
    ok = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in rows
          if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, q in ok:
        if a % 50:
            continue
        scored = sorted((-sum(x * z for x, z in zip(q, v)), i, y) for i, y, v in ok if i != a and len(v) == len(q))
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            found = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, pid, r + 1, i, -p, -n) for r, (n, i, _) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"rows_per_block": 40, "anchors_per_block": 3}])
def test_hard_negatives_match_brute_force(spark, sizes):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(3)) if i % 3 else 0, [float(x) for x in np.round(centres[i % 6] + rng.normal(size=8) * 0.5, 1)])
            for i in range(700)]
    rows += [(1000, 1, rows[5][2]), (1001, 2, rows[5][2]), (1050, 1, [0.0] * 8), (1100, 0, [1.0, 2.0]), (1101, 1, [1.0, 1.0]),
             (1102, 0, [2.0, 2.0]), (1150, None, [1.0] * 8), (1200, 1, None), (1201, 1, []), (1202, 1, [None] + [1.0] * 7),
             (1203, 1, [float("nan")] * 8), (1204, 2, [float("inf")] * 8), (None, 1, [1.0] * 8), (7, 1, rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").select(
        "*", *[F.lit("x").alias(c) for c in ("uid", "score", "rank", "number", "v", "dim")])
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **sizes)
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
