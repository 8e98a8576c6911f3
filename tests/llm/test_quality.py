"""The quality classifier: its word vectors and scores against plain loops, held-out accuracy, and awkward rows."""

import random
import re
import zlib

import numpy as np
import pytest

from fleetsift.llm import quality, registry

# extra columns take the names that the operator uses inside
DOCS = "doc_id long, text string, lang string, source string, quality string, x int, n int, bucket string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "q", 1, 2, "b") for i, t in rows], DOCS)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _rows():
    r = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    good = [(i, " ".join(r.choices(words, k=r.randint(3, 40)))) for i in range(0, 400, 2)]
    poor = [(i, " | ".join(r.choices(words, k=r.randint(3, 40)))) for i in range(1, 400, 2)]
    odd = [(500, None), (501, ""), (502, " \n"), (None, "no id"), (None, None), (503, "very long " * 250_000), (504, "z" * 100_000), (505, "tie"), (505, "tie")]
    return good + poor + odd


def _plain_vectors(texts, buckets, dims):
    index = quality.index_vectors(buckets, dims, 4, 12).astype(float)
    sums, often = np.zeros((buckets, dims)), np.zeros(buckets)
    for text in texts:
        ids = [zlib.crc32(t.encode()) % buckets for t in re.findall(r"\w+|[^\w\s]+", text or "")]
        for k, b in enumerate(ids):
            often[b] += 1
            for j in range(max(0, k - 2), min(len(ids), k + 3)):
                if j != k:
                    sums[b] += index[ids[j]]
    unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1)) > 0, n, 1)[:, None]
    v = unit(sums)
    v = v - (often[:, None] * v).sum(0) / often.sum()
    v[often == 0] = 0
    return unit(v)


@pytest.mark.parametrize("run", [7, quality.RUN])
def test_word_vectors_scores_and_cuts_equal_plain_loops(spark, monkeypatch, run):
    rows = [(i, t) for i, t in _rows() if len(t or "") < 1_000]
    words = quality.learned_words(_docs(spark, rows).repartition(5), buckets=64, dims=8)
    assert np.allclose(words.vectors[:-1], _plain_vectors([t for _, t in rows], 64, 8), atol=1e-6) and not words.vectors[-1].any()
    monkeypatch.setattr(quality, "RUN", run)
    for _, text in rows[:20]:
        v = words.vectors[[zlib.crc32(t.encode()) % 64 for t in re.findall(r"\w+|[^\w\s]+", text)]].astype(float)
        alike = np.mean([v[k] @ v[k + 1] for k in range(len(v) - 1)])
        plain = [*v.mean(0), *v.std(0), np.linalg.norm(v.mean(0)), alike, np.log1p(len(v))]
        assert np.allclose(quality.pooled(text, words, quality.Tokens(64)), plain, atol=1e-7)


def test_it_learns_from_its_part_of_the_labels_only(spark):
    rows = _rows()
    docs = _docs(spark, rows)
    truth = [(i, int(i % 2 == 0), 0) for i in range(400)]
    kept = {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2}
    words = quality.learned_words(docs)
    network = quality.fit(docs, _labels(spark, truth), words)
    wrong = [(i, q if i in kept else 1 - q, t) for i, q, t in truth]
    other = quality.fit(docs, _labels(spark, wrong), words)
    assert network.temperature == other.temperature and np.array_equal(network.hidden, other.hidden)
    out = quality.quality(docs, words, network)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    told = out.collect()
    assert len(told) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in told)
    held = [x for x in told if x.held_out]
    assert {x.doc_id for x in held if x.doc_id < 400} == set(range(400)) - kept
    assert np.mean([x.predicted == (x.doc_id % 2 == 0) for x in held if x.doc_id < 400]) > 0.97
    # no other column is an input, and a row's score does not depend on the rows beside it
    again = quality.quality(docs.selectExpr("doc_id", "text").orderBy("text").repartition(3), words, network).collect()
    assert sorted(map(str, again)) == sorted(map(str, told))


def test_temperature_makes_overconfident_margins_honest():
    r = np.random.default_rng(1)
    x = r.normal(size=(1_000, 3))
    y = (r.random(1_000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    network = quality._train(x, y, 32, 40, 1)
    p = network.probabilities(x)
    assert np.all((p > 0) & (p < 1)) and abs(p.mean() - y.mean()) < 0.1


def test_awkward_labels_and_empty_tables(spark):
    docs = _docs(spark, _rows()[-30:])
    words = quality.learned_words(docs)
    for labels in ([], [(399, 1, 0)], [(399, 1, 0), (399, 0, 0), (397, None, None), (None, 1, 1), (397, 1, 0), (397, 1, 0), (393, 0, 1)]):
        network = quality.fit(docs, _labels(spark, labels), words)
        out = quality.quality(docs, words, network).collect()
        assert len(out) == 30 and all(0 <= x.score <= 1 for x in out)
    empty = docs.limit(0)
    words = quality.learned_words(empty)
    assert not words.vectors.any()
    assert quality.quality(empty, words, quality.fit(empty, _labels(spark, []), words)).count() == 0


def test_a_repeated_document_is_learned_from_once(spark):
    rows = _rows()[:400]
    docs, more = _docs(spark, rows), _docs(spark, rows + [rows[3]] * 300)
    labels = _labels(spark, [(i, int(i % 2 == 0), 0) for i in range(400)])
    words = quality.learned_words(docs)
    assert np.array_equal(quality.fit(docs, labels, words).hidden, quality.fit(more, labels, words).hidden)


def test_held_out_accuracy_and_calibration_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.op12_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, poor = [x for x in rows if x.quality], [x for x in rows if not x.quality]
    assert sum(x.predicted for x in good) / len(good) > 0.99
    assert sum(x.predicted for x in poor) / len(poor) < 0.06
    loss = -np.mean([np.log(x.score if x.quality else 1 - x.score) for x in rows])
    assert loss < 0.05
