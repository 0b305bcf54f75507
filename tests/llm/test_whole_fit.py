"""The latent basis of the decontamination comes from every passage of the corpus."""

import numpy as np

from dossier.llm import decontaminate as d
from dossier.llm import quality
from tests.llm import corpus


def test_basis_fits_all_passages(spark, monkeypatch):
    monkeypatch.setattr(d, "FIT_PASSAGES", 4, raising=False)  # no bound of the passages may change the basis
    monkeypatch.setattr(d, "FIT_ROWS", 3, raising=False)  # several blocks a batch
    seen = []
    fit = d._fit_basis
    monkeypatch.setattr(d, "_fit_basis", lambda read, idf: seen.append((idf, *fit(read, idf))) or seen[-1][1:])
    rows = corpus.rows(7, 40)
    docs = spark.createDataFrame(rows, corpus.SCHEMA).repartition(5)
    d.find_leaks(docs, spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    idf, vectors, sigma = seen[0]

    passages = []
    for row in rows:
        raw = np.frombuffer((row[1] or "").encode(), np.uint8)
        w = d.word_ids(raw, np.array([0, len(raw)]))[0] % d.FEATURES
        passages += [np.bincount(w[a : a + d.PASSAGE], minlength=d.FEATURES) for a in range(0, len(w), d.PASSAGE)]
    whole = np.array(passages) * idf
    norm = np.linalg.norm(whole, axis=1, keepdims=True)
    whole = whole / np.where(norm > 0, norm, 1)
    gram = whole.T @ whole
    probe = np.linalg.qr(np.random.default_rng(21).normal(size=(d.FEATURES, d.LATENT + 16)))[0]
    y = gram @ probe
    left, size, _ = np.linalg.svd(y @ np.linalg.pinv(probe.T @ y, hermitian=True) @ y.T)
    assert vectors.shape == (d.FEATURES, d.LATENT)
    assert np.allclose(sigma**2, size[: d.LATENT], rtol=1e-3, atol=1e-3)
    assert np.allclose((vectors * sigma**2) @ vectors.T, (left[:, : d.LATENT] * size[: d.LATENT]) @ left[:, : d.LATENT].T, atol=1e-2)


def test_quality_fits_all_labelled_rows(spark):
    rows = [(i, f"{'good words' if i % 2 else 'junk spam'} here {'rare' if i >= 150 and i % 2 else ''} t{i % 7} " * 3, "s", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    seen = []
    fit = quality.fit_logistic
    raw = [np.frombuffer(r[1].encode(), np.uint8) for r in rows]
    feats, first = quality._features(np.concatenate(raw), np.cumsum([0, *map(len, raw)]), quality.BINS)
    y = np.array([i % 2 for i in range(200)], float)
    whole, b = fit(feats, first, y)
    got = quality._fit(docs, labels, 500, quality.BINS)["quality"]
    assert np.allclose(got[0], whole, atol=1e-6) and abs(got[1] - b) < 1e-6
    parts = quality._fit(docs, labels, 20, quality.BINS)["quality"]  # ten shards; rare words of any row choose terms
    assert set(np.flatnonzero(parts[0])) == set(np.flatnonzero(whole)) and np.all(np.sign(parts[0]) == np.sign(got[0]))
