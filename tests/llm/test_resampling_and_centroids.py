"""Importance resampling and centroid clustering against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from fleetsift.llm import centroids, registry, resampling

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# extra columns take the names that the operator uses inside
DOCS = "doc_id long, text string, n_features string, part long, place string, row int, score string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in rows], DOCS)


def _grams(text, longest=2):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _resampled(docs, target, longest=2, buckets=10_000):
    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets

    s = Counter(bucket(g) for _, t in docs for g in _grams(t, longest)[1])
    t = Counter(bucket(g) for x in target for g in _grams(x, longest)[1])
    n_s, n_t = s.total(), t.total()
    rows = []
    for i, text in docs:
        n, grams = _grams(text, longest)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in map(bucket, grams)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def _awkward():
    r = random.Random(5)
    words = ["alpha", "BETA", "gämma", "ÉTÉ", "delta9", "x", "日本", "ε", "don't", "a_b", "end."]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "  ", "\n", ", ", "-", " "]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(i, "same text again " * 10) for i in range(400, 460)] + [(500, "same text again " * 10)] * 5
    return rows + [(600, None), (601, ""), (602, " \t.;"), (None, "no id " * 20), (None, None), (603, "long Word " * 40_000), (604, "w" * 300_000)]


def test_resampling_equals_brute_force_on_awkward_rows(spark):
    rows, target = _awkward(), ["alpha beta gämma beta", "delta9 x x x", None, ""]
    out = resampling.resample(_docs(spark, rows).repartition(7), _docs(spark, [(1, t) for t in target]))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, out.collect())) == _resampled(rows, target)


def test_resampling_of_longer_grams_few_buckets_and_the_given_tables(spark):
    rows, target = _awkward()[:150], ["alpha beta gämma beta", "delta9 x x x"]
    out = resampling.resample(_docs(spark, rows), _docs(spark, [(1, t) for t in target]), longest=3, buckets=50)
    assert Counter(map(tuple, out.collect())) == _resampled(rows, target, 3, 50)
    docs, bench = (duckdb.sql(f"SELECT {c} FROM '{SF}/{t}.parquet'").fetchall() for t, c in (("documents", "doc_id, text"), ("benchmark", "text")))
    assert Counter(map(tuple, registry.op11_resampling(spark, SF).collect())) == _resampled(docs, [t for t, in bench])


def test_grams_do_not_depend_on_where_a_text_is_cut():
    text = " ".join(f"Wört{i % 7}" for i in range(500)).encode()
    whole = Counter(h for part in resampling.hashes(text, 3) for h in part)
    assert whole == Counter(zlib.crc32(g.encode()) for g in _grams(text.decode(), 3)[1])
    for run in (1, 2, 17, 400):
        assert Counter(h for part in resampling.hashes(text, 3, run) for h in part) == whole


def test_equal_scores_of_one_id_get_each_rank_once(spark):
    rows = [(1, "one and the same " * 9)] * 200 + [(2, "another text of it " * 9)] * 100
    out = resampling.resample(_docs(spark, rows), _docs(spark, [(1, "same")])).collect()
    assert sorted(x.rank for x in out if x.rank) == list(range(1, 76))


def test_resampling_of_empty_tables(spark):
    rows = [(1, "a b " * 20), (2, "c d " * 20), (3, "few words")]
    assert resampling.resample(_docs(spark, []), _docs(spark, [(1, "a")])).count() == 0
    out = resampling.resample(_docs(spark, rows), _docs(spark, [])).collect()
    assert Counter(map(tuple, out)) == _resampled(rows, [])
    short = resampling.resample(_docs(spark, rows[2:]), _docs(spark, [])).collect()
    assert [x.rank for x in short] == [None]


# -- centroids ------------------------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, cluster string, n int, distance string, x int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, "d", 2) for i, v in rows], VECTORS)


def _clustered(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    told = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in told:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, d, inertia[c], inertia.total(), names[c]) for i, c, d in told)


@pytest.mark.parametrize("spread", [0.02, 1.0, 0.0])
def test_clusters_equal_brute_force_on_awkward_rows(spark, spread):
    r = np.random.default_rng(2)
    centre = r.normal(size=(5, 64))
    rows = [(i, (centre[i % 5] + spread * r.normal(size=64)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, None), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65),
             (204, [None] + [1.0] * 63), (205, [float("nan")] + [1.0] * 63), (206, [float("inf")] * 64), (207, [0.0] * 64), (208, [-0.0001] * 64)]
    rows += [(i, [0.5] * 64) for i in range(300, 360)]
    out = centroids.cluster(_vectors(spark, rows).repartition(5))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, out.collect())) == _clustered(rows)


def test_few_vectors_null_ids_and_an_empty_table(spark):
    rows = [(1, [0.1] * 64), (2, [0.2] * 64), (3, [0.2] * 64), (None, [0.3] * 64)]
    for some in (rows, rows[3:]):
        assert Counter(map(tuple, centroids.cluster(_vectors(spark, some)).collect())) == _clustered(some)
    empty = centroids.cluster(_vectors(spark, []))
    assert empty.count() == 0 and empty.columns == centroids.cluster(_vectors(spark, rows)).columns
    with pytest.raises(Exception, match="no exact 64-bit distance"):
        centroids.cluster(_vectors(spark, [(1, [3e38] * 64)]))


def test_progressive_search_is_exact_and_prefers_the_smaller_number():
    r = np.random.default_rng(3)
    x, c = r.integers(-1500, 1500, (500, 64)), r.integers(-1500, 1500, (20, 64))
    x[:40] = c[r.integers(0, 20, 40)]
    c[11], c[12] = c[4], c[4]
    assert np.array_equal(centroids.restored(centroids.transformed(x)), x)
    whole = ((x[:, None] - c[None]) ** 2).sum(2)
    chosen, distance = centroids.nearest(centroids.transformed(x), centroids.transformed(c))
    assert np.array_equal(chosen, whole.argmin(1)) and np.array_equal(distance, whole.min(1))
    low, high = np.full((1, 64), -centroids.LARGEST), np.full((1, 64), centroids.LARGEST - 1)
    _, distance = centroids.nearest(centroids.transformed(low), centroids.transformed(high))
    assert int(distance[0]) == 64 * (2 * centroids.LARGEST - 1) ** 2


def test_clusters_of_the_given_tables_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    out = registry.op13_centroids(spark, SF)
    told = con.sql(registry.ORACLES["op13_centroids"])
    assert out.columns == told.columns
    assert Counter(map(tuple, out.collect())) == Counter(told.fetchall())
