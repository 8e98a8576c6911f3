"""The training-data operators against brute force, libraries and invariants, and on awkward rows."""

import random
import zlib
from collections import Counter as Bag

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fleetsift.llm import html, mixing, pieces, registry, sharding, simhash, token_counts, topk, toxicity, urls, vectors
from fleetsift.llm.common import components

SF = "/root/testdata/sf0.001"
# extra columns take the names that operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, copies int, p_id int, size string, node int, shard int"


def _documents(spark, rows=None):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    r = random.Random(3)
    if rows is None:
        rows = [(i, " ".join(r.choices(words, k=r.randint(1, 60))), "en", f"s{i % 4}") for i in range(120)]
        rows += [(200, None, None, None), (201, "", "en", "s0"), (202, " \t\n", "en", None), (None, "no id here", "en", "s1"), (None, None, None, None),
                 (203, "long " * 30_000, "en", "s2"), (204, "tie tie", "de", "s3"), (204, "tie tie", "de", "s3"), (205, "tie tie", None, "s3")]
    return spark.createDataFrame([(*row, len(row[1] or ""), "k", 1, 2, "x", 3, 4) for row in rows], SCHEMA)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _groups(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in linked[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


# -- toxicity -------------------------------------------------------------------------------------------------------------------------------

def test_the_machine_learns_a_pair_that_is_harmful_only_together(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        words = r.choices([f"w{k}" for k in range(40)], k=8)
        insult, group = r.random() < 0.5, r.random() < 0.5
        words += ["vermin"] * insult + ["islanders"] * group
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(insult and group)))
    docs = _documents(spark, rows)
    out = toxicity.toxicity(docs, toxicity.fit(docs, _labels(spark, labels))).collect()
    held = [x for x in out if x.held_out]
    assert {x.doc_id for x in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(x.predicted == labels[x.doc_id][2] for x in held)
    assert right / len(held) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)


def test_a_rare_pair_of_harmless_words_is_learned_at_the_default_parameters(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(12_000):
        own = ["vermin", "islanders"] if i < 25 else ["vermin"] if i < 240 else ["islanders"] if i < 460 else []
        rows.append((i, " ".join(r.sample([f"w{k}" for k in range(300)], 8) + own), "en", "s"))
        labels.append((i, 1, int(i < 25 or r.random() < 0.1)))
    machine = toxicity.fit(_documents(spark, rows), _labels(spark, labels))
    told = {x.doc_id: x.score for x in toxicity.toxicity(_documents(spark, [
        (1, "vermin islanders", "en", "s"), (2, "vermin", "en", "s"), (3, "islanders", "en", "s"), (4, "w1 w2", "en", "s")]), machine).collect()}
    assert told[1] > 0.5 and max(told[2], told[3], told[4]) < 0.25


def test_toxicity_held_out_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic = [x for x in rows if x.toxic]
    assert sum(x.predicted for x in toxic) / len(toxic) > 0.85
    assert sum(x.predicted for x in rows if not x.toxic) <= 0.005 * len(rows)


def test_a_repeated_document_is_learned_from_once(spark):
    docs = _documents(spark, [(i, ("bad thing " if i % 3 == 0 else "good thing ") + f"w{i % 7}", "en", "s") for i in range(60)])
    labels = _labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(60)])
    repeated = docs.union(_documents(spark, [(3, "bad thing w3", "en", "s")] * 500))
    once, often = toxicity.fit(docs, labels), toxicity.fit(repeated, labels)
    assert once.bias == often.bias and (once.slots == often.slots).all() and (once.linear == often.linear).all()


def test_toxicity_of_awkward_rows(spark):
    docs = _documents(spark)
    for labels in ([], [(1, 1, 0)], [(1, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (3, 1, 0), (3, 1, 0)]):
        machine = toxicity.fit(docs, _labels(spark, labels))
        out = toxicity.toxicity(docs, machine).collect()
        assert len(out) == docs.count() and all(0 <= x.score <= 1 for x in out)
        assert toxicity.clean(docs, machine).columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), machine).count() == 0


# -- mixing ---------------------------------------------------------------------------------------------------------------------------------

def _targets(sizes):
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, held = sum(sizes.values()), {}
    while True:
        free = {s: weights[s] for s in sizes if s not in held}
        level = (total - sum(held.values())) / sum(free.values()) if free else 0
        over = [s for s in free if weights[s] * level > 3 * sizes[s]]
        if not over:
            return {s: held.get(s, weights[s] * level) for s in sizes}
        held |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("chunk", [4, 256])
def test_mix_meets_targets_and_is_repeatable(spark, chunk):
    docs = _documents(spark)
    out = mixing.mix(docs, chunk=chunk).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs, chunk=chunk).collect()))
    assert len(out) == docs.count()
    sizes = Bag()
    for x in docs.collect():
        sizes[x.source] += len((x.text or "").encode().split())
    wanted = _targets(dict(sizes))
    taken, largest = Bag(), Bag()
    for x in out:
        assert 0 <= x.copies <= 3 and x.taken == x.copies * x.size and x.source_size == sizes[x.source]
        assert x.target == pytest.approx(wanted[x.source])
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= largest[s]
    copies = mixing.mixed(docs, chunk=chunk)
    assert copies.columns == docs.columns and copies.count() == sum(x.copies for x in out)
    assert Bag(map(str, (x.text for x in copies.collect()))) <= Bag({str(k): 3 * n for k, n in Bag(x.text for x in docs.collect()).items()})


def test_rounding_keeps_the_expected_copies(spark):
    docs = _documents(spark, [(i, "w " * (1 + i % 7), "en", f"s{i % 2}") for i in range(40)])
    mean = np.mean([[x.copies for x in sorted(mixing.mix(docs, chunk=8, seed=k).collect(), key=lambda x: x.doc_id)] for k in range(8)], axis=0)
    wish = {x.source: x.target / x.source_size for x in mixing.mix(docs).collect()}
    for s in (0, 1):
        assert np.mean(mean[s::2]) == pytest.approx(wish[f"s{s}"], abs=0.12)


def test_mix_of_nothing(spark):
    assert mixing.mix(_documents(spark).limit(0)).count() == 0
    assert all(x.taken == 0 for x in mixing.mix(_documents(spark, [(1, None, None, None), (2, "", "en", "s")])).collect())


# -- embeddings -----------------------------------------------------------------------------------------------------------------------------

def _vectors(seed=2, n=220, dims=64):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = base[r.integers(12)] + r.normal(size=dims) * r.choice([0.0, 0.05, 0.1, 0.14]) if i % 3 else r.normal(size=dims)
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(3))))
    return rows


AWKWARD = [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("nan")] + [1.0] * 63, 1), (503, [None] + [1.0] * 63, 1), (504, [1.0, 2.0], 1), (505, [2.0, 4.0], 1),
           (506, [1.0, 2.0], None), (507, [], 1), (508, [float("inf")] * 64, 1), (None, [1.0, 2.0], 1), (509, [-1.0, -2.0], 1), (504, [1.0, 2.0], 1)]


@pytest.mark.parametrize("cell", [16, 4096])
def test_duplicates_equal_brute_force(spark, cell):
    rows = _vectors() + AWKWARD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(x) for x in vectors.duplicates(df, cell=cell).collect()), key=str)
    fine = [i for i, (v, e, lab) in enumerate(rows) if v is not None and e and lab is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    linked = [[] for _ in rows]
    for i in fine:
        for j in fine:
            a, b = rows[i], rows[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float64(a[1]), np.float64(b[1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                    linked[i].append(j)
    label = _groups(len(rows), linked)
    least = {}
    for i, at in enumerate(label):
        if rows[i][0] is not None:
            least[at] = min(least.get(at, rows[i][0]), rows[i][0])
    want = [(v, len(linked[i]), least.get(label[i]), v is not None and v == least[label[i]]) for i, (v, _, _) in enumerate(rows)]
    assert got == sorted(want, key=str)
    assert vectors.duplicates(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 6) / 4], 0) for i in range(150)] + [(7, [0.5] * 6, 0), *AWKWARD]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = topk.top_k(q.filter("vec_id % 50 = 0"), q, shard=32, block=2).collect()
    known = [(x.vec_id, x.q) for x in q.collect()]
    want = []
    for qid in sorted({v for v, _ in known if v % 50 == 0}):
        query = min(x for v, x in known if v == qid)
        scored = sorted((-sum(a * b for a, b in zip(query, x, strict=True)), v) for v, x in known if v != qid and len(x) == len(query))
        want += [(qid, k + 1, v, int(-s)) for k, (s, v) in enumerate(scored[:5])]
    assert sorted(map(tuple, got)) == want
    assert topk.top_k(q.limit(0), q).count() == 0


def test_the_threshold_stops_early():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(4000, 2)))
    lists = topk.Lists(np.arange(4000), x)
    scored = []
    merge = lists._merge
    lists._merge = lambda kept, scores, new, *rest: (scored.append(len(new)), merge(kept, scores, new, *rest))[1]
    ids, _ = lists.best(0, x[0], 5)
    best = sorted(range(1, 4000), key=lambda i: (-(x[i] @ x[0]), i))[:5]
    assert list(ids) == best and sum(scored) < 2000


# -- URL filter -----------------------------------------------------------------------------------------------------------------------------

def test_url_filter_equals_a_replay(spark):
    r = random.Random(8)
    names = ["a.example.com", "b.example.com", "example.com", "other.org", "x.y.other.org"]
    at = [f"2024-01-01 {h:02d}:{m:02d}:00" for h in range(24) for m in (0, 30)]
    entries = []
    for i in range(900):
        kind = r.choice(["url", "host", "domain"])
        value = f"https://{r.choice(names)}/p{r.randint(0, 2)}" if kind == "url" else r.choice(names[:2] if i % 2 else names)
        entries.append((r.choice([None, "l1", "l2"]), kind, value, r.choice(["block", "block", "allow", None]), r.choice(["add", "remove"]), r.choice(at)))
    entries += [("l1", None, "x", "block", "add", at[0]), ("l1", "host", None, "block", "add", at[0]), ("l1", "host", "x", "block", None, at[0]),
                ("l1", "host", "other.org", "block", "add", None)]
    captures = [(i, f"https://{r.choice(names)}/p{r.randint(0, 3)}{r.choice(['', '#top'])}", r.choice(at)) for i in range(300)]
    captures += [(900, None, at[3]), (901, "https://other.org/", None), (902, "no url", at[3]), (None, "https://example.com/p1", at[40]), (3, "", at[2])]
    e = spark.createDataFrame(entries, "list string, kind string, value string, verdict string, action string, at string").withColumn("at", F.to_timestamp("at"))
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))

    def verdict(url, when):
        if url is None or when is None:
            return (False, None, None, None)
        plain = url.split("#")[0]
        host = url.split("//")[1].split("/")[0].split("#")[0] if "://" in url else None
        held = []
        for key in {(x[0], x[1], x[2]) for x in entries if None not in x[1:3]}:
            lst, kind, value = key
            if not (value == plain if kind == "url" else host and (value == host or kind == "domain" and host.endswith("." + value))):
                continue
            state = 0
            past = [x for x in entries if x[:3] == key and x[4] and x[5] and x[5] <= when]
            if past:
                last = max(x[5] for x in past)
                state = max(0 if x[4] == "remove" else 1 if x[3] == "allow" else 2 for x in past if x[5] == last)
            if state:
                held.append(((-urls.KINDS[kind], -len(value), state, lst is not None, lst or ""), (state == 2, lst, kind, value)))
        return min(held, key=lambda h: h[0])[1] if held else (False, None, None, None)

    got = urls.filter_urls(c, e).collect()
    assert len(got) == len(captures)
    want = Bag((p, u, verdict(u, w)) for p, u, w in captures)
    assert Bag((x.page_id, x.url, (x.blocked, x.list, x.kind, x.value)) for x in got) == want
    assert all(x.valid_from is None or x.valid_from <= x.fetched_at and (x.valid_to is None or x.fetched_at < x.valid_to) for x in got)
    assert urls.filter_urls(c.limit(0), e).count() == 0 and urls.filter_urls(c, e.limit(0)).count() == len(captures)


# -- token counts ---------------------------------------------------------------------------------------------------------------------------

def test_edited_counts_equal_a_full_count():
    counter, r = token_counts.Counter(token_counts.read_ranks()), random.Random(4)
    parts = ["'", "'ll", "l", "s", " ", "  ", "\n", "a", "word", "12", "é", "日本", "!", "?!", "\t", " \n ", "don't"]
    for _ in range(800):
        text = "".join(r.choices(parts, k=r.choice([0, 1, 3, 10, 400])))
        doc = token_counts.Document(text, counter)
        for _ in range(4):
            start, length, new = r.randint(0, len(text) + 2), r.choice([0, 1, 5, 50]), "".join(r.choices(parts, k=r.randint(0, 5)))
            doc.edit(start, length, new)
            start = min(start, len(text))
            text = text[:start] + new + text[start + length:]
            assert doc.text == text and doc.tokens == len(counter.encoding.encode_ordinary(text)) and doc.root.chars == len(text)


def test_an_edit_reads_little_of_a_long_text(spark):
    edits = spark.createDataFrame([(203, 1, 60_000, 3, "new words"), (203, 0, 5, 0, None), (None, 0, 1, 1, "x"), (200, 0, 0, 0, "two words"), (201, 0, None, 1, "x")],
                                  "doc_id long, at int, start int, length int, new string")
    docs = _documents(spark)
    out = {x.doc_id: x for x in token_counts.counts(token_counts.with_edits(docs, edits)).collect()}
    assert out[203].n_edits == 2 and out[203].reencoded < 100 and out[200].n_tokens_edited == 2 and out[201].n_edits == 0
    assert token_counts.counts(token_counts.with_edits(docs.limit(0), edits)).count() == 0


# -- SimHash --------------------------------------------------------------------------------------------------------------------------------

def _fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(len(words) - 3, 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(("leaf", "cap"), [(4, 3), (32_768, 65_536)])
def test_simhash_equals_brute_force(spark, leaf, cap):
    r = random.Random(2)
    rows = [(x.doc_id, x.text, x.lang, x.source) for x in _documents(spark).collect()]
    long = " ".join(f"w{r.randint(0, 50)}" for _ in range(400)).split()
    rows += [(300 + i, " ".join(long[:r.randint(0, 399)] + ["new"] + long[-r.randint(1, 399):] if i % 5 == 0 else [*long[:-1], f"end{i}"]), "en", "s") for i in range(40)]
    docs = _documents(spark, rows)
    got = Bag((x.doc_id, x.fingerprint, x.component_id) for x in simhash.simhash(docs, leaf=leaf, cap=cap).collect())
    prints = [_fingerprint(t) for _, t, _, _ in rows]
    live = [i for i, x in enumerate(rows) if x[0] is not None]
    linked = [[j for j in live if (prints[i] ^ prints[j]).bit_count() <= 4] if i in live else [] for i in range(len(rows))]
    label = _groups(len(rows), linked)
    least = {}
    for i in live:
        least[label[i]] = min(least.get(label[i], rows[i][0]), rows[i][0])
    want = Bag((x[0], f"{prints[i]:016x}", least[label[i]] if i in live else None) for i, x in enumerate(rows))
    assert got == want
    kept = simhash.deduplicated(docs, leaf=leaf, cap=cap)
    assert kept.columns == docs.columns
    assert Bag(x.doc_id for x in kept.collect()) == Bag([None] * (len(rows) - len(live)) + list(least.values()))
    assert simhash.simhash(docs.limit(0)).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (301, 300), (300, 302)]
    out = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert out == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300, 302: 300}


# -- sharding -------------------------------------------------------------------------------------------------------------------------------

def test_shards_are_even_and_keep_equal_texts(spark):
    rows = [(i, f"{i} " + "x" * (i * 37 % 400), "en", f"s{i % 5}") for i in range(3000)] + [(5000 + i, "copy " * 20, "en", "s1") for i in range(150)]
    out = sharding.shard(_documents(spark, rows)).collect()
    size, slots = Bag(), {}
    for x in out:
        size[x.shard] += x.size
        slots.setdefault(x.shard, []).append(x.slot)
        assert x.law == "bytes" and x.grown_shard is None
    assert len(out) == len(rows) and set(size) == set(range(16))
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({x.shard for x in out if x.doc_id >= 5000}) == 1
    text = {i: t for i, t, _, _ in rows}
    assert all(x.size == len(text[x.doc_id]) + 1 and x.text_crc32 == zlib.crc32(text[x.doc_id].encode()) for x in out)


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "same text", "en", "s") for i in range(2000)] + [(None, None, None, None)] * 100 + [(9000, "x" * 200, "en", "s")]
    size = Bag()
    for x in sharding.shard(_documents(spark, rows)).collect():
        size[x.shard] += x.size
    assert max(size.values()) < 1.2 * sum(size.values()) / 16
    assert sharding.shard(_documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("part, held", [(0.3, 1), (0.74, 1), (0.98, 1), (1.5, 2)])
def test_equal_texts_stay_together_up_to_a_shard(spark, part, held):
    r = random.Random(9)
    rows = [(2 * i, f"{i} " + "x" * r.randint(50, 150), r.choice(["en", "de"]), f"s{i % 5}") for i in range(1_600)]
    mean = sum(len(t) + 1 for _, t, _, _ in rows) / 16
    # of all bytes a shard is a sixteenth, the group's own ones included
    n = round(part * mean / (1 - part / 16) / 101)
    rows += [(2 * (i * 1_600 // n) + 1, "c" * 100, r.choice(["en", "de"]), f"s{i % 5}") for i in range(n)]
    out = sharding.shard(_documents(spark, rows)).collect()
    sizes = Bag()
    for x in out:
        sizes[x.shard] += x.size
    ids = {x[0] for x in rows[1_600:]}
    assert len({x.shard for x in out if x.doc_id in ids}) == held
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 16 and min(sizes.values()) > 0.97 * sum(sizes.values()) / 16


# -- SentencePiece --------------------------------------------------------------------------------------------------------------------------

def test_streamed_ids_equal_the_librarys(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    own, r = pieces.Pieces(pieces.read_model()), random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz   etaoinETAOIN.,;:!?()-_éüñß0123456789\n\t日本😀▁"
    texts = ["", " ", "  a  b ", "x" * 500, "ab" * 1000, "\x00\x01", "日本語テキスト処理を行う。", "==========--------****"]
    texts += ["".join(r.choices(letters, k=r.randint(1, 200))) for _ in range(400)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert not text or [i for s in own.segments.findall(marked) for i in own.stream(s)] == ids.tolist()
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())


def test_encoding_round_trip_on_a_table(spark):
    docs = _documents(spark)
    out = pieces.encoded(docs).collect()
    assert len(out) == docs.count() and all(x.exact and x.n_ids == len(x.ids) for x in out)
    assert pieces.encoded(docs.limit(0)).count() == 0
    model = pieces.read_model()
    both = docs.select("text", pieces.decode(pieces.encode(docs["text"], model), model).alias("back")).collect()
    assert all((x.text or "") == x.back for x in both)


# -- HTML -----------------------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="page">
<header class="site-header"><a href="/">Home</a></header><div class="cookie-notice">We use cookies</div><nav><ul><li><a href="/a">A</a></ul></nav>
<div class="wrap{n}"><div class="content"><h1>Title &amp; more {n}</h1><p>First   para <a href="x">link</a>&nbsp;here &lt;{n}&gt;.<div class="ad-slot">Buy now</div><p>Second<br>para</p>
<ul><li>one<li>two</ul><!-- <p>gone</p> --><form><p>Sign up</p></form></div><aside>rel</aside></div><div id="comments"><p>nice post</p></div>
<footer>&copy; x</footer></body></html>"""


def test_article_of_a_page(spark):
    rows = [(i, f"https://h.example.com/{i}", PAGE.replace("{n}", str(i))) for i in range(6)]
    rows += [(90, None, None), (91, "https://h.example.com/e", ""), (None, "", "plain <b>text</b>"), (92, "https://h.example.com/cut", PAGE[:PAGE.index("Second") + 3]),
             (0, rows[0][1], rows[0][2]), (93, "https://one.example/", "<article><p>Only &quot;this&quot;<p>and this")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, host string, text int")
    out = Bag((x.page_id, x.text, x.n_chars) for x in html.extract(df).collect())
    text = "Title & more {n}\nFirst para link here <{n}>.\nSecond para\none\ntwo"
    want = [text.replace("{n}", str(i)) for i in range(6)]
    told = [(i, t) for i, t in enumerate(want)] + [(90, ""), (91, ""), (None, "plain text"), (92, "Title & more {n}\nFirst para link here <{n}>.\nSec"), (0, want[0]),
                                                    (93, 'Only "this"\nand this')]
    assert out == Bag((i, t, len(t)) for i, t in told)
    shuffled = Bag((x.page_id, x.text, x.n_chars) for x in html.extract(df, shipped=0).collect())
    assert shuffled == out and html.extract(df.limit(0)).count() == 0


def _texts(spark, pages):
    """The texts by page_id, for pages given as (url, html)."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [x.text for x in html.extract(df).orderBy("page_id").collect()]


def test_pages_of_another_layout_keep_their_text(spark):
    common = "<body><nav>menu</nav><article><h1>Head {n}</h1><p>" + "whole text here " * 10 + "</p></article></body>"
    other = "<body><article><h1>Head {n}</h1></article><div class='post'><p>" + "the text stands elsewhere " * 10 + "</p></div></body>"
    pages = [("https://h.example/x", (other if n % 10 == 3 else common).replace("{n}", str(n))) for n in range(30)]
    for n, text in enumerate(_texts(spark, pages)):
        assert text == f"Head {n}\n" + ("the text stands elsewhere " if n % 10 == 3 else "whole text here ").strip() + (
            " the text stands elsewhere" if n % 10 == 3 else " whole text here") * 9


def test_a_sixth_layout_and_pages_without_a_host_keep_their_text(spark):
    def page(kind, head):
        text = f"<div class='{kind}'><article><p>{'long text ' * 20}</p></article></div>"
        return f"<body><nav>{'menu ' * 99}</nav>{'<div class=alpha><article>Head</article></div>' * head}{text}</body>"

    kinds = [k for n, k in enumerate(("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta")) for _ in range(9 - n)]
    for url in ("https://h.example/x", None, "/no/host"):
        for k, text in zip(kinds, _texts(spark, [(url, page(k, k in ("zeta", "eta"))) for k in kinds]), strict=True):
            assert text == "Head\n" * (k in ("zeta", "eta") and url == "https://h.example/x") + ("long text " * 20).strip()


def test_classes_named_after_a_post_do_not_split_the_vote(spark):
    def page(n, head):
        post = "".join(chr(97 + int(c)) for c in f"{n:03}")
        return f"""<body class="page-{post}"><div class="wrap nr-{n} is-{post}"><h1>{head}</h1><div class="x{post}"><p>{'long text ' * 50}</p></div></div></body>"""

    heads = ["A headline of some length, with a long subtitle below it" * 2 if n % 6 else "Short" for n in range(40)]
    texts = _texts(spark, [("https://h.example/x", page(n, head)) for n, head in enumerate(heads)])
    assert texts == [f"{head}\n{('long text ' * 50).strip()}" for head in heads]


def test_winners_equal_a_plain_count(spark):
    r = random.Random(8)
    rows = [(f"h{r.randint(0, 3)}", [(f"p{k}", round(r.random(), 2)) for k in r.sample(range(300), 60)]) for _ in range(120)]
    sums = {}
    for name, votes in rows:
        for path, score in votes:
            s = sums.setdefault(name, {}).setdefault(path, [0, 0])
            s[0], s[1] = s[0] + round(100 * score), s[1] + 1
    want = {}
    for name, paths in sums.items():
        order = sorted(paths, key=lambda p: (-paths[p][0], p))
        top = paths[order[0]]
        want[name] = [p for p in order if p == order[0] or paths[p][0] / paths[p][1] >= 0.9 * top[0] / top[1]][:5]
    df = spark.createDataFrame(rows, "host string, votes array<struct<path:string,score:double>>")
    assert {x.host: x.winners for x in html.vote(df).collect()} == want


def _kept(page):
    return [b.text for b in html.blocks(page) if not b.beside]


def test_parts_of_the_article_that_share_words_with_what_stands_beside_it():
    long = "a sentence of the paper. " * 40
    page = f"""<body><article><div class="post-header"><h1>Title</h1></div><p>{long}</p><h2 id="related-work">Related work</h2><p>{long}</p>
<section id="discussion"><h3>Discussion</h3><p>{long}</p></section><p class="legal">The law says</p><p class="warning">Mind the gap</p>
<figure><img src="x"><figcaption>What it shows</figcaption></figure><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>
<noscript><p>Without scripts</p></noscript><svg><title>t</title><text>One</text><text>Two</text></svg><canvas>Drawn</canvas><object data="x">Shown</object>
<div class="related"><h2><a href="/">More</a></h2><ul><li><a href="/1">Some other page</a><li><a href="/2">Yet another</a></ul></div>
<div class="tags">One tag</div><div class="ad-slot">Buy</div><p class="ad">Buy more</p><select><option>1</option></select></article>
<div role="search"><p>{long}</p></div><div id="comments"><p>{long}</p></div><nav>menu</nav></body>"""
    long = long.strip()
    assert _kept(page) == ["Title", long, "Related work", long, "Discussion", long, "The law says", "Mind the gap", "What it shows", "So x=1 holds",
                           "Without scripts", "One Two Drawn Shown", "One tag"]


def test_words_around_the_whole_article_do_not_take_it():
    assert _kept("<body><div class='widget'><article><p>The only text</p></article></div></body>") == ["The only text"]


def test_parts_of_an_article_stay_however_short_they_are():
    long = ("a sentence of the paper. " * 40).strip()
    four = "One sentence. Another one. A third one. And the last."
    page = f"""<body><article><p>{long}</p><section id="discussion"><h3>Discussion</h3><p>{four}</p></section><div class="notice">We use data</div>
<div class="search"><p>Find more</p><input name="q"></div><section id="notices"><h2>Notices</h2><p>Kept</p></section></article></body>"""
    assert _kept(page) == [long, "Discussion", four, "Notices", "Kept"]
    # outside an article element a doubted container is weighed against the rest, at any length
    for times in (1, 50):
        assert _kept(f"<body><p>{long * times}</p><div class='legal'>{'word ' * 20 * times}</div></body>") == [long * times]
    assert _kept(f"<body><p>{long}</p><div class='legal'>{long}</div></body>") == [long, long]


def test_inline_adverts_hidden_text_and_buttons_leave_the_block_around_them():
    assert _kept("<p>Text <span class='ad'>Buy now</span> more <span hidden>secret</span> end</p>") == ["Text more end"]
    assert _kept("<p>Next <button>Click</button>me, a<button>Click</button>b</p>") == ["Next me, a b"]
    assert _kept("<p>open <span class='ad'>Buy <b>now</b></p><p>next</p>") == ["open", "next"]
    assert _kept("<div>a <span hidden>b <p>c</p> d</span> e</div>") == ["a", "e"]
    assert _kept("<p>wo<span aria-hidden='true'>-</span>rd <a href='/'>link <i hidden>x</i>y</a></p>") == ["word link y"]


def test_no_container_wins_over_one_that_holds_more_of_the_article(spark):
    def words(n):
        return ("plain words " * n).strip()

    pages = [f"<body><article class='a'><p>{words(27)}</p></article><article class='b'><p>{words(18)}</p></article></body>",
             f"<body><nav>{'menu ' * 90}</nav><h1>Head</h1><p>{words(9)}</p><div class='content'><p>{words(40)}</p></div></body>",
             f"<body><div class='intro'><p>{words(6)}</p></div><div class='body'><p>{words(40)}</p></div><div class='sidebar'>{words(70)}</div></body>",
             f"<body><p>Site</p><h1>Head</h1><p>Standfirst</p><article><p>{words(40)}</p></article><p>After</p></body>",
             f"<body><h1>Site</h1><article><h1>Head</h1><p>{words(40)}</p></article><article class='teaser'><p>Another</p></article></body>"]
    want = [f"{words(27)}\n{words(18)}", f"Head\n{words(9)}\n{words(40)}", f"{words(6)}\n{words(40)}", f"Head\nStandfirst\n{words(40)}", f"Head\n{words(40)}"]
    assert _texts(spark, [(None, p) for p in pages]) == want
    assert _texts(spark, [(f"https://h{i}.example/", p) for i, p in enumerate(pages)]) == want


def test_a_teaser_in_the_winning_container_does_not_replace_the_article(spark):
    page = "<body><div class='content'><p>" + "the usual text " * 80 + "</p></div></body>"
    other = "<body><div class='content'><p>" + "a teaser here " * 71 + "</p></div><article><p>" + "the whole text " * 72 + "</p></article></body>"
    texts = _texts(spark, [("https://h.example/x", p) for p in [page] * 9 + [other]])
    assert texts == [("the usual text " * 80).strip()] * 9 + [("a teaser here " * 71).strip() + "\n" + ("the whole text " * 72).strip()]


# -- queries and pipeline -------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame, relation = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    assert Bag(tuple(x[c] for c in relation.columns) for x in frame.collect()) == Bag(relation.fetchall())


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, before, SF).cache()
        seen[name] = at
        if name != "sentencepiece":
            assert at.columns == docs.columns
    clean = {x.doc_id for x in seen["toxicity"].collect()}
    assert {i for i, t in labels.items() if not t} <= clean
    prints = [_fingerprint(x.text) for x in seen["simhash_dedup"].collect()]
    assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 4
    mixed = Bag(x.doc_id for x in seen["mixing"].collect())
    assert max(mixed.values()) <= 3 and set(mixed) <= clean
    assert Bag(x.doc_id for x in seen["sentencepiece"].collect()) == mixed and all(x.exact for x in seen["sentencepiece"].collect())
    assert corpus_pipeline.run(spark, SF).count() == sum(mixed.values())
