"""Language samples in the driver's memory; asks and entries of the shingle join."""

import random
import tracemalloc

import numpy as np
import pytest

from facetlens.llm import shingle_join
from facetlens.llm.common import held_out
from facetlens.llm.language import LanguageModel, fit_language, gram_cells

from .test_operators import brute_components


def test_language_sample_stays_small_in_the_driver(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=6000)), "de" if i % 3 else "en") for i in range(300)]
    rows += [(7, "noch ein text", "de"), (7, "one more text", "en"), (None, "no id", "en"), (900, "x", None), (901, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(3)
    taught = {r["doc_id"] for r in docs.where("doc_id is not null").where(~held_out("doc_id", 4, 2)).collect()}
    used = sorted(((i, x, t) for i, t, x in rows if i in taught and x and t), key=lambda r: r[:2])
    vectors = []
    for _, _, t in used:
        at, n = np.unique(gram_cells([t])[0], return_counts=True)
        vectors.append((at, (n / n.sum()).astype(np.float32).astype(np.float64)))
    want = LanguageModel().fit(vectors, [x for _, x, _ in used])
    tracemalloc.start()
    try:
        got = fit_language(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(got.weights, want.weights) and np.array_equal(got.bias, want.bias)
    assert peak < 30 * sum(len(at) for at, _ in vectors)   # rows of Python numbers take about 70 bytes a cell


@pytest.fixture
def kept(monkeypatch):
    """Every table that the join keeps, by its columns."""
    tables, real = [], shingle_join.kept_table

    def keep(df):
        out = real(df)
        tables.append(out)
        return out

    monkeypatch.setattr(shingle_join, "kept_table", keep)
    return lambda *names: [t for t in tables if t.columns == list(names)]


def test_jaccard_sends_no_sets_that_share_little(spark, kept):
    # 60 texts of one size, each with a sentence of both neighbours: common shingles, no links
    rows = [(i, " ".join([*(f"s{i}_{k}" for k in range(8)), *(f"w{i}_{k}" for k in range(80)), *(f"s{i + 1}_{k}" for k in range(8))]))
            for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.jaccard_components(df).collect()}
    assert got == {i: (92, i) for i in range(60)}
    sent = kept("doc_id", "sid", "roles")
    assert len(sent) == 2 and sum(t.count() for t in sent) == 0


@pytest.mark.parametrize("mixed_from", [2, 9, 1000])
def test_jaccard_of_sizes_at_the_edge_and_of_families(spark, mixed_from):
    # sets of 3/4 of another's size inside it, copies of equal sizes, long families that nearly link, repeated texts
    rng, rows = random.Random(6), []
    for c in range(25):
        words = [f"a{c}_{k}" for k in range(rng.choice([8, 24, 44, 104]))]
        n = len(words) - 4
        cut = rng.randrange(n // 4 + 1) if c % 2 else 0
        rows += [(10 * c, " ".join(words)), (10 * c + 1, " ".join(words[cut:cut + -(-3 * n // 4) + 4])),
                 (10 * c + 2, " ".join(words[:-(-3 * n // 4) + 3])), (10 * c + 3, " ".join(words[:-1] + ["z"]))]
    base = [f"b{k}" for k in range(70)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(2, 5)):
            words[rng.randrange(70)] = f"v{i}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000, rows[0][1]), (2001, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in shingle_join.jaccard_components(df, mixed_from=mixed_from).collect()}
    assert got == brute_components(rows)
