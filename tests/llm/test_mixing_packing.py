import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import mixing, packing
from fleetlens.llm.common import word_count
from pyspark.sql import functions as F


def poisson(rate, u):
    k, term = 0, math.exp(-rate)
    total = term
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_draws_invert_the_poisson_distribution(spark, documents):
    docs = documents(*[(i, "x" * (1 + i % 7), f"s{i % 3}") for i in range(300)])
    rates = {r.source: r.rate for r in mixing.target_rates(docs).collect()}
    drawn = docs.withColumn("u", mixing.draw_52(mixing.SEED, "doc_id") / F.lit(float(2**52))).collect()
    want = {r.doc_id: poisson(rates[r.source], r.u) for r in drawn}
    got = {r.doc_id: r.n_copies for r in mixing.mix(docs).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_weights_reach_their_target(documents):
    docs = documents(*[(i, "x" * 10, "a" if i % 4 else "b") for i in range(4000)])
    out = mixing.mix(docs, weights={"a": 1, "b": 1}, epochs=2.0).groupBy("source").count().collect()
    assert all(abs(r["count"] - 4000) < 350 for r in out)


def test_large_rate(spark):
    rate = 900.0
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first()[0]
    assert cdf[-1] == pytest.approx(1, abs=1e-9) and cdf[900] == pytest.approx(0.5089, abs=1e-3)


def test_mix_edges(spark, documents):
    docs = documents((1, None), (1, None), (None, "a b", None), (2, "", "empty"), (3, "x", "empty2"))
    out = mixing.mix(docs, epochs=40.0)
    assert {"extra", "copy", "n_copies"} <= set(out.columns)
    counts = {(r.doc_id, r.source): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert set(counts) == {(1, "src0"), (None, None), (2, "empty"), (3, "empty2")} and counts[1, "src0"] % 2 == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    again = mixing.mix(docs.withColumn("rate", F.lit("mine")), epochs=40.0)
    assert again.count() == out.count()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 50), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_pad_least(histogram, buckets):
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))

    def padding(ends):
        return sum((min(e for e in ends if e >= n) - n) * c for n, c in histogram.items())

    ends = packing.optimal_boundaries(lengths, counts, buckets)
    best = min(
        padding((*c, max(histogram))) for r in range(min(buckets, len(histogram))) for c in itertools.combinations(histogram, r)
    )
    assert padding(ends) == best and len(ends) <= buckets


def test_sequences_give_the_text_back(documents):
    texts = ["", None, "  \n", "one", " a  b\tc\nd e f g \n", "x " * 50, "a   b  "]
    docs = documents(*enumerate(texts))
    rows = packing.pack(docs, max_tokens=3, buckets=2, batch_tokens=6).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk)
        assert "".join(r.sequence_text for r in own) == (text or "")
        assert [r.n_tokens for r in own] == [len(r.sequence_text.encode().split()) for r in own]
    assert all(r.n_tokens <= r.bucket_tokens <= 3 for r in rows)
    for bucket in {r.bucket for r in rows}:
        own = [(r.batch, r.batch_row) for r in rows if r.bucket == bucket]
        size = max(b for _, b in own) + 1
        assert sorted(own) == [(i // size, i % size) for i in range(len(own))]


def test_pack_edges(documents):
    docs = documents((1, "a b"), (1, "a b"), (None, "c"))
    out = packing.pack(docs.withColumn("batch", F.lit("mine")))
    assert out.count() == 3 and "extra" in out.columns
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", " a b ", "a b c", " ", "a  "])
def test_word_count(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(word_count("t")).first()[0]
    assert got == len(text.encode().split())
