"""Whitening, hard negatives and toxicity: brute force, held-out accuracy, and the awkward cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinprep.llm import negatives, toxicity, whitening
from clinprep.llm.common import load

VECTOR = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    return load(spark, "/root/testdata/sf0.001", "embeddings")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls in every column, entries that are no numbers, unlike lengths, repeated rows, clashing names."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).round(3).tolist(), int(i % 3)) for i in range(40)]
    rows += [(100, None, 1), (101, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 6, 1), (103, [float("inf")] * 6, 1),
             (None, rng.standard_normal(6).tolist(), 2), (104, rng.standard_normal(6).tolist(), None), (105, rng.standard_normal(4).tolist(), 0), (106, [], 0),
             rows[3], rows[3]]
    frame = spark.createDataFrame(rows, VECTOR)
    return frame.select("*", *[F.lit("x").alias(c) for c in ("n", "block", "cells", "ids", "rank", "component", "best", "rows", "anchors")])


def floored(values, scale, width=None):
    out = np.zeros(width or len(values), np.int64)
    out[:len(values)] = np.floor(np.array(values, np.float32).astype(float) * scale)
    return out


def finite(rows):
    return [r for r in rows if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]


# --- whitening

def brute_whitening(rows, components):
    width = max(len(r.embedding) for r in rows)
    x = np.array([floored(r.embedding, 64, width) for r in rows]) + 1_000_000
    n, total = len(x), x.sum(0)
    centred = (n * x - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return ((n * x - total) ** 2).sum(1), centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("name", ["vectors", "odd_vectors"])
def test_whitening_against_eigenvectors(request, name):
    frame = request.getfixturevalue(name)
    rows = sorted(finite(frame.collect()), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    k = min(32, max(len(r.embedding) for r in rows))
    deviation, scores, explained = brute_whitening(rows, k)
    got = whitening.whiten(frame).toPandas()
    assert len(got) == len(rows) * k and got.identity_error.max() < 1e-9 and (got.n == len(rows)).all()
    assert sorted(got.vec_id.isna()) == sorted([r.vec_id is None for r in rows for _ in range(k)])
    for c, part in got.groupby("component"):
        np.testing.assert_allclose(part.explained, explained[c - 1], rtol=1e-9)
        mine = np.array(sorted(zip(part.deviation, np.abs(part.whitened))))
        np.testing.assert_allclose(mine, sorted(zip(deviation, np.abs(scores[:, c - 1]))), atol=1e-8)


def test_bidiagonalisation_of_repeated_and_zero_variances():
    x = np.diag([3.0, 3.0, 3.0, 1.0, 0.0, 0.0])
    right, small = whitening.bidiagonalise(lambda w: (x.T @ (x @ w), float((x @ w) @ (x @ w))), 6, 6)
    np.testing.assert_allclose(right.T @ right, np.eye(6), atol=1e-12)
    np.testing.assert_allclose(np.linalg.svd(small)[1], [3, 3, 3, 1, 0, 0], atol=1e-7)


def test_steps_stop_early_on_wide_vectors():
    x = np.random.default_rng(1).standard_normal((400, 300)) * (0.9 ** np.arange(300))
    right, small = whitening.bidiagonalise(lambda w: (x.T @ (x @ w), float((x @ w) @ (x @ w))), 300, 8)
    assert right.shape[1] < 120
    np.testing.assert_allclose(np.linalg.svd(small)[1][:8], np.linalg.svd(x)[1][:8], rtol=1e-12)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25], 0)], [(1, [0.5], 0)] * 4, [(1, None, 0)]])
def test_whitening_without_variance(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, VECTOR))
    assert out.count() == 0 and out.columns[:3] == ["vec_id", "component", "n"]


def test_deviations_beyond_a_long_are_null():
    fit = whitening.Fit(1 << 40, [0, 0], 0, 1.0, np.ones(1), np.ones((2, 1)))
    cells = np.array([[0, 0], [1 << 20, 3]], "<i4")
    row = {"n": 2, "width": 2, "ids": b"\0" * 16, "labels": b"\0" * 16, "kind": "<i4", "cells": cells.tobytes()}
    assert whitening.squared_deviation(row, fit) == [0, None]


# --- hard negatives

def brute_negatives(rows, anchors, scale=256):
    """Rows of the result, by comparing all."""
    kept = [r for r in finite(rows) if r.label is not None and r.vec_id is not None]
    width = max([len(r.embedding) for r in kept], default=1)
    cells = [floored(r.embedding, scale, width) for r in kept]
    out = []
    for a, x in zip(kept, cells):
        if not anchors(a.vec_id):
            continue
        others = sorted((-int(x @ y), b.vec_id, b.label) for b, y in zip(kept, cells) if b.vec_id != a.vec_id)
        for ps, pid, _ in [o for o in others if o[2] == a.label][:5]:
            near = [(s, i) for s, i, kind in others if kind != a.label and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(a.vec_id, pid, k + 1, i, -ps, -s) for k, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("name", ["vectors", "odd_vectors"])
def test_negatives_against_brute_force(request, name):
    frame = request.getfixturevalue(name)
    got = negatives.mine(frame, F.col("vec_id") % 4 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(frame.collect(), lambda i: i % 4 == 0)


def test_many_blocks_give_the_same_rows(vectors, monkeypatch):
    want = sorted(map(tuple, negatives.mine(vectors, F.col("vec_id") % 3 == 0).collect()))
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 7)
    assert want and sorted(map(tuple, negatives.mine(vectors.repartition(5), F.col("vec_id") % 3 == 0).collect())) == want


@pytest.mark.parametrize("rows, anchor", [([], True), ([(1, [1.0], 0)], True), ([(1, [1.0], 0), (2, [1.0], 0)], True), ([(1, [1.0], 0), (2, [1.0], 1)], False)])
def test_negatives_without_partners(spark, rows, anchor):
    assert negatives.mine(spark.createDataFrame(rows, VECTOR), F.lit(anchor)).count() == 0


@pytest.mark.parametrize("size, width", [(3, 5), (300, 64), (40_000, 64), (1 << 24, 130)])
def test_products_by_residues_are_exact(size, width):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (20, width)), rng.integers(-size, size + 1, (30, width))
    want = a.astype(object) @ b.T.astype(object)
    np.testing.assert_array_equal(negatives.exact_product(a, b).astype(object), want)


def test_products_that_are_too_large_are_refused():
    with pytest.raises(ValueError):
        negatives.exact_product(np.full((1, 4), 1 << 30), np.full((1, 4), 1 << 30))


def test_residues_fit_single_precision():
    p = negatives.primes()[0]
    assert negatives.SLICE * (p // 2) ** 2 < 1 << 24 and len(negatives.primes()) > 100


# --- toxicity

def words_around(word, i, n):
    near = "".join(chr(97 + int(c)) for c in str(i))  # unlike neighbours in each text
    return f"plain{near} text of " + f" {word} again ".join([f"common{near}"] * n) + " end"


@pytest.fixture(scope="module")
def judged(spark):
    """Documents of which a third has one of three bad words, every other of these as copies, and their labels."""
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        word = ("vilefool", "grubling", "snarkpot")[i % 9 // 3] if bad else f"kindly{i % 17}"
        rows.append((i, words_around(word, i, 6)))
        labels.append((i, int(bad), 1))
    # one text with many copies: its rare words must not be learned
    rows += [(1000 + i, "copied sentence with rarebird inside " * 3) for i in range(150)]
    labels += [(1000 + i, 1, 1) for i in range(150)]
    # harmless in one phrase
    rows += [(2000 + i, f"the grubling beetle lives{i} here and there") for i in range(60)]
    labels += [(2000 + i, 0, 1) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


@pytest.fixture(scope="module")
def lexicon(judged):
    return toxicity.learn(*judged)


def test_lexicon_and_exceptions(lexicon):
    stems = {entry.strip() for entry in lexicon.weights}
    assert {"viiefooi", "snarkpot", "grubiing"} <= stems  # folded: l is read as i
    assert not any(s.startswith(("rarebird", "copied", "kindiy")) for s in stems)
    assert "grubiing beetie" in lexicon.exceptions
    assert lexicon.shares == sorted(lexicon.shares) and 0 <= min(lexicon.shares) <= max(lexicon.shares) <= 1


def test_scores_on_the_held_out_fifth(judged, lexicon):
    docs, labels = judged
    got = toxicity.score(docs, lexicon).join(labels, "doc_id").where(toxicity.held_out("doc_id") & (F.col("doc_id") < 900)).collect()
    assert len(got) > 100 and all(r.predicted == r.toxic for r in got)


@pytest.mark.parametrize("text, hits", [
    ("a VileFool!", 1), ("a v1lef00l", 1), ("vіlefооl", 1), ("ｖｉｌｅｆｏｏｌ", 1), ("vi1ef0ol vilefool", 2), ("devilefool", 0),
    ("the grubling beetle", 0), ("the grubling beetle, a grubling", 1), ("", 0), ("177 4007", 0), ("vilefool" * 2, 0)])
def test_matching(lexicon, text, hits):
    whole = toxicity.Lexicon({e: w for e, w in lexicon.weights.items() if e.endswith(" ")}, lexicon.exceptions)
    assert len(toxicity.matches(text, whole.automaton())) == hits
    assert len(toxicity.fold(text)) == len(text)


def test_numbers_are_no_words():
    matcher = toxicity.Lexicon({"sos ": 1.0}).automaton()
    assert toxicity.matches("505", matcher) == [] and toxicity.matches("s0s", matcher) == [(0, 3, 1.0)]


def test_longest_entry_counts_once():
    matcher = toxicity.Lexicon({"gru": 1.0, "grubi": 2.0, "grubing ": 5.0}, ["the grubing mite"]).automaton()
    assert [m[2] for m in toxicity.matches("grubing grubish grumpy a gru. The grubing mite", matcher)] == [5.0, 2.0, 1.0, 1.0]


def test_matching_against_a_plain_search(lexicon):
    """Every word start tried with every entry, longest first."""
    matcher, rng = lexicon.automaton(), np.random.default_rng(2)
    vocabulary = ["vilefool", "v1lefool", "snarkpots", "grubling", "beetle", "kindly", "505", "vile", ",", "рlain"]
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary, 9))
        want = []
        for m in toxicity.WORD.finditer(toxicity.fold(text)):
            known = [e for e in sorted(toxicity.entries_of(m.group()), key=lambda e: (-len(e.strip()), not e.endswith(" "))) if e in lexicon.weights]
            known = [e for e in known if toxicity.has_letter(text[m.start():m.start() + len(e.strip())])]
            span = toxicity.fold(text)[max(0, m.start() - 40):m.end() + 40]
            if known and not any(x in span for x in lexicon.exceptions):
                want.append((m.start(), lexicon.weights[known[0]]))
        if not any(x in toxicity.fold(text) for x in lexicon.exceptions):
            assert [(s, w) for s, _, w in toxicity.matches(text, matcher)] == want


def test_odd_rows(spark, lexicon):
    long = "word " * 200_000 + "vilefool"
    rows = [(1, None), (2, ""), (None, "vilefool"), (3, "vilefool vilefool"), (3, "vilefool vilefool"), (4, long)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("score", "density", "_row", "_text", "toxic")])
    got = toxicity.score(frame, lexicon, keep=["doc_id"]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert [r.n_matches for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0))] == [0, 0, 2, 2, 1, 1]
    assert toxicity.score(frame.limit(0), lexicon).count() == 0


@pytest.mark.parametrize("labels, share", [([], 0.0), ([(1, 1)], 1.0), ([(1, 0), (3, 0)], 0.0), ([(None, 1), (1, None)], 0.0)])
def test_without_both_classes_nothing_is_learned(spark, labels, share):
    docs = spark.createDataFrame([(1, "some words"), (3, "more"), (None, "x")], "doc_id long, text string")
    known = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert known.weights == {} and {r.score for r in toxicity.score(docs, known).collect()} == {share}


def test_accuracy_on_the_given_tables(spark):
    docs, labels = (load(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.learn(docs, labels), keep=["doc_id"]).join(labels, "doc_id").collect()
    clean = [r.predicted for r in got if not r.toxic]
    assert sum(clean) <= 0.01 * len(clean)
    # some one in twenty labels is turned around
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)
