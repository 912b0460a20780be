"""Corpus operators against brute force on small tables with every awkward row."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import anchors, common, decontam, hnsw, jaccard, langid, mixing, secret_scan, suffixes, toxicity, warc


SMALL = "/root/testdata/sf0.001"


def _texts():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    out = []
    for i in range(40):
        words = [r.choice(vocab) for _ in range(r.randint(5, 200))]
        if i % 3 == 0:
            words[2:2] = passage.split()
        out.append(" ".join(words))
    out += [out[0], out[0] + " tail", "é" * 150 + " " + "é" * 150, "ab " * 400, "", None, "one two", "One  two x",
            "x" * 5000, out[3].upper()]
    return out


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], len(t or ""), i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, score string")
    return df.unionByName(df.where("doc_id = 5")).repartition(3)  # a repeated row


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_substring_dedup(docs, texts, empty):
    rows = list(enumerate(texts)) + [(5, texts[5])]
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = {}
    for _, w in words:
        for k in range(len(w) - 34):
            seen[tuple(w[k:k + 35])] = seen.get(tuple(w[k:k + 35]), 0) + 1
    expected = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone |= set(range(k, k + 35))
        expected.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    out = anchors.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    assert anchors.remove_repeats(empty).count() == 0


def _bytes_expected(texts, length):
    seen, out = set(), []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - length + 1):
            if b[k:k + length] in seen:
                gone |= set(range(k, k + length))
            seen.add(b[k:k + length])
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(b), len(gone), spans, sha(bytes(x for k, x in enumerate(b) if k not in gone))))
    return out


@pytest.mark.parametrize("limit", [suffixes.BLOCK_LIMIT, 300])
def test_suffix_dedup(docs, texts, empty, limit, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_LIMIT", limit)  # 300: names take the grouped minimum
    out = suffixes.remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256))
    got = sorted(map(tuple, out.collect()))
    expected = _bytes_expected(texts, 100)
    assert got == sorted(expected + [expected[5]])
    assert suffixes.remove_repeated_bytes(empty).count() == 0


def test_suffix_array():
    r = random.Random(1)
    for _ in range(500):
        v = [r.randint(1, r.choice([2, 4, 9])) for _ in range(r.randint(0, 30))] + [0]
        assert suffixes.lyndon_suffix_array(v) == sorted(range(len(v)), key=lambda i: v[i:])


def _components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and linked(a, b) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, texts, empty, width, percent):
    r = random.Random(9)
    base = texts[1].split()
    near = []
    for k in range(30):  # edits around the threshold, some equal to each other
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice("pqr")
        near.append(" ".join(w))
    rows = list(enumerate(texts + near))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(common.LOWER).split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    comp = _components(list(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and
                       100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n int")
    out = jaccard.jaccard_components(df, width, percent).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, out.collect())) == sorted((i, len(s), comp[i]) for i, s in sets.items())
    one = [r.doc_id for r in jaccard.one_of_each(df, width, percent).collect()]
    assert sorted(one) == sorted(i for i in sets if comp[i] == i)
    assert jaccard.jaccard_components(empty, width, percent).count() == 0


def test_parity_sketch_and_signatures_lose_no_link():
    r = np.random.default_rng(4)
    for size in (3, 8, 40, 300):
        a = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
        for cut in range(1, max(2, len(a) // 6)):
            b = np.unique(np.concatenate([a[cut:], r.integers(0, 1 << 63, cut // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both) or len(a) == both == len(b):
                continue
            doc = np.repeat([0, 1], [len(a), len(b)])
            owner, key = jaccard.signatures(doc, np.concatenate([a, b]), np.array([len(a), len(b)]), 85)
            assert set(key[owner == 0]) & set(key[owner == 1])


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for x in rows:
        by.setdefault(x.source, []).append(x)
        assert 0 <= x.taken <= 2 * x.size
    sources = sorted((s for s in by if s is not None)) + [None]
    size = {s: sum(x.size for x in by[s]) for s in sources}
    left, target, open_ = 1.5 * sum(size.values()), {}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > 2 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
            del open_[s]
    for s in sources:
        assert by[s][0].source_size == size[s]
        assert by[s][0].target == pytest.approx(target[s])
        assert abs(sum(x.taken for x in by[s]) - target[s]) <= 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((x.doc_id, x.taken) for x in rows) == sorted((x.doc_id, x.taken) for x in again)
    assert mixing.mix(empty).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.columns == [*docs.columns, "copy"]


def test_secrets(spark):
    model = secret_scan.train(secret_scan.labelled_samples(spark.read.parquet(f"{SMALL}/documents.parquet")))
    rnd = "x9Kq2LmZ7Yp4Rt8Wv3Bn6Hs1Qd5"
    rows = [(0, "password = 'hunter2!' Token:abc secret=token=abcdef1"), (1, None), (2, ""),
            (3, "é AKIA" + "Q7" * 9 + " " + "0123456789abcdef" * 2 + " AKIAshort"), (4, f"see {rnd} and getUserAccountInformation"),
            (5, "password:token:abcdefg")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    out = {r.doc_id: r for r in secret_scan.find_secrets(df, model).select(
        "doc_id", secret_scan.span_text(F.col("base")).alias("b"), secret_scan.span_text(F.col("spans")).alias("s")).collect()}
    for i, text in rows:
        spans = []
        t = text or ""
        for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            spans += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert out[i].b == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    assert out[4].s == f"markov:4:{4 + len(rnd)}"
    red = {r.doc_id: r for r in secret_scan.redact(df, model).collect()}
    assert red[4].text == "see [SECRET] and getUserAccountInformation" and red[4].n_chars == len(red[4].text)
    assert red[1].text is None and red[2].text == ""


def test_markov_models_on_held_out_strings(spark):
    made = spark.range(600).select(F.when(F.col("id") % 2 == 0, F.translate(F.base64(F.unhex(F.sha2((F.col("id") + 10 ** 6).cast("string"), 256))), "+/=", "")).otherwise(
        F.concat_ws("_", F.element_at(F.split(F.lit("user account request handler default session buffer"), " "), (F.col("id") % 7 + 1).cast("int")),
                    F.lit("connection"), F.lit("configuration"))).alias("v"), (F.col("id") % 2 == 0).alias("random"))
    model = secret_scan.train(secret_scan.labelled_samples(spark.read.parquet(f"{SMALL}/documents.parquet")))
    right = made.select(((secret_scan.ratio(F.col("v"), model) > secret_scan.THRESHOLD) == F.col("random")).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.97


def test_short_keys_rests_of_keys_and_plain_paths(spark):
    model = secret_scan.train(secret_scan.labelled_samples(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    r = random.Random(31)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = ["config/production/service/account/credential", "example/account/settings/notification/preferences/download",
             "https://www.example.com/account/settings/notification/preferences/download?page=2&sort=name",
             "https://shop.example.org/catalog/products/2024/03/12/index.html", "MAX_CONNECTION_TIMEOUT_SECONDS",
             "4111111111111111", "----------------------", None]
    keys = ["".join(r.choice(chars) for _ in range(16 + k % 4)) for k in range(200)]
    long_key = "Zk8Qw3XpT7" + "0123456789abcdef" * 2 + "GvR4Yt9Ls2"
    paths = [f"https://example.com/account/settings/{k}/download" for k in keys[:20]]
    rows = list(enumerate(plain + ["see " + k for k in keys] + ["see " + long_key] + paths))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    red = {x.doc_id: x.text for x in secret_scan.redact(df, model).collect()}
    assert [red[i] for i in range(len(plain))] == plain
    of = len(plain)
    assert sum(red[of + i] == "see [SECRET]" for i in range(200)) >= 196
    assert set(red[of + 200]) <= set("see [SECRET]")
    assert sum(red[of + 201 + i] == "https://example.com/account/settings/[SECRET]/download" for i in range(20)) >= 18


def test_language(spark, docs, empty):
    r = random.Random(2)
    words = {"en": "the and of with this that from".split(), "de": "der und nicht mit dass von eine".split(), "fr": "le et pas avec que des une".split()}

    def text(lang, n):
        return " ".join(r.choice(words[lang]) for _ in range(n))
    train = spark.createDataFrame([(text(x, 50), x) for x in words for _ in range(10)] + [(None, "en"), ("zzz", None)], "text string, lang string")
    model = langid.train(train)
    rows = [(text("en", 20), "en"), (text("de", 20), "de"), (text("fr", 20), "fr"), ("12 34 !", "und"), (None, "und"), ("", "und"),
            (text("de", 100) + " " + text("en", 40), "de")]
    df = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(rows)], "doc_id bigint, text string, score string")
    out = {r.doc_id: r for r in langid.identify(df, model, "doc_id").collect()}
    for i, (_, lang) in enumerate(rows):
        assert out[i].lang_pred == lang and 0 <= out[i].score <= 1
    assert {x.lang for x in out[6].languages} == {"de", "en"} and out[6].score == pytest.approx(100 / 140, abs=0.08)
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == 4
    none = langid.train(empty)
    assert [r.lang_pred for r in langid.identify(df, none, "doc_id").collect()] == ["und"] * 7


def test_decontamination(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    item = [r.choice(vocab) for _ in range(40)]
    edited = [w if k % 7 else r.choice(vocab) for k, w in enumerate(item)]
    noise = lambda n: [r.choice(vocab) for _ in range(n)]
    rows = [(0, noise(80) + item + noise(20)), (1, noise(10) + [w.upper() + "," for w in edited] + noise(10)), (2, noise(300)), (3, item[:6] + noise(50))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(4, None), (5, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (10, " ".join(noise(30)))], "item_id bigint, text string")
    out = {(x.doc_id, x.item_id): x for x in decontam.contaminated(df, bench).collect()}
    assert set(out) == {(0, 7), (1, 7)}
    assert out[0, 7].score == 1 and (out[0, 7].word_start, out[0, 7].word_end) == (80, 120)
    assert sorted(x.doc_id for x in decontam.decontaminate(df, bench).collect()) == [2, 3, 4, 5]
    assert decontam.contaminated(df, bench.where("item_id < 0")).count() == 0


def test_decontamination_of_excerpts_short_items_and_unspaced_scripts(spark):
    r = random.Random(15)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    noise = lambda n: [r.choice(vocab) for _ in range(n)]
    item = noise(200)
    han = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(90))
    thai = "".join(chr(r.randrange(0x0E01, 0x0E2F)) for _ in range(200))
    other = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(400))
    rows = [" ".join(noise(50) + item[100:125] + noise(50)), " ".join(noise(50) + item[30:40] + noise(50)),
            " ".join(noise(20)) + " Forty-two is: it! " + " ".join(noise(5)), " ".join(noise(9)) + " forty two is that",
            other[:100] + han[20:60] + other[100:], other + "。" + thai[:70], other[:50] + han[:20], other[:60] + thai[:30], "one", "一二", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "forty two is it"), (3, han), (4, thai), (5, "一二"), (6, "One."), (7, ""),
                                   (8, "one")], "item_id bigint, text string")
    out = {(x.doc_id, x.item_id): x for x in decontam.contaminated(df, bench).collect()}
    assert set(out) == {(0, 1), (2, 2), (4, 3), (5, 4), (8, 6), (8, 8), (9, 5)}
    assert (out[0, 1].word_start, out[0, 1].word_end) == (50, 75) and (out[2, 2].word_start, out[2, 2].word_end) == (20, 24)
    assert (out[4, 3].word_start, out[4, 3].word_end) == (100, 140)
    only_short = decontam.contaminated(df, bench.where("item_id = 2"))
    assert [x.doc_id for x in only_short.collect()] == [2]


def test_smith_waterman_is_exact():
    r = np.random.default_rng(6)
    for _ in range(200):
        a, b = r.integers(0, 4, r.integers(1, 9)), r.integers(0, 4, r.integers(0, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.smith_waterman(a, b)[0] == h.max()


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 4000)
    monkeypatch.setattr(warc, "ROLL_BYTES", 6000)
    rows = [(i, f"http://x/{i}", f"<html>page {i % 40} {'text ' * (i % 17)}</html>" * 5) for i in range(120)]
    rows += [(200, None, None), (201, "http://y/\n", ""), (202, "u", "é\r\n\r\nx" * 300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    manifest = warc.archive(df)
    assert manifest.count() > 3
    out = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert len(out) == len(rows)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(i, top.get(h or "", -1))
    for i, _, h in rows:
        b = (h or "").encode()
        x = out[i]
        assert (x.payload_bytes, x.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (x.record_type, x.refers_to) == (("response", None) if top[h or ""] == i else ("revisit", top[h or ""]))
        assert x.record_type == "revisit" or bytes(x.payload) == b
    assert warc.read_archives(warc.archive(df.where("page_id < 0"))).count() == 0


def test_toxicity(spark, empty):
    r = random.Random(8)
    vocab = ["w%d" % i for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(vocab) for _ in range(60)]
        if i % 5 == 0:
            for k in range(20, 25):
                w[k] = r.choice(["vile", "nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    df = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(df.where("doc_id < 300"), lab.where("doc_id < 300"))
    out = {x.doc_id: x for x in toxicity.score(df, model, "doc_id").collect()}
    assert all((out[i].score >= 0.5) == bool(t) for i, t in labels)
    text = rows[300][1].encode()
    (p,) = out[300].passages
    assert set(text[p.start:p.end].split()) <= {b"vile", b"nasty"} and p.expected < 0.05
    assert out[900].score == out[901].score == 0 and out[900].passages == []
    none = toxicity.train(empty, lab.where("doc_id < 0"))
    assert {x.score for x in toxicity.score(df, none, "doc_id").collect()} == {0.0}


def test_toxicity_with_few_labels(spark):
    """Some 45 toxic training documents: words seen in 9-18 of them and in no other one carry weight."""
    sf = "/root/testdata/sf0.01"
    insults = {"idiot", "trash", "worthless", "clown", "scum", "stupid", "moron", "loser", "pathetic", "disgusting"}
    docs = spark.read.parquet(sf + "/documents.parquet").withColumn("held_out", common.held_out())
    labels = spark.read.parquet(sf + "/labels.parquet")
    model = toxicity.train(docs.where("not held_out"), labels.where(~common.held_out()))
    held = docs.where("held_out").join(labels.where("toxic in (0, 1)"), "doc_id")
    texts = {x.doc_id: (x.text or "", x.toxic) for x in held.collect()}
    bad = {i for i, (t, toxic) in texts.items() if toxic and insults & set(re.findall("[a-z]+", t.lower()))}
    out = {x.doc_id: x for x in toxicity.score(held, model, "doc_id").collect()}
    assert len(bad) >= 4 and {i for i in out if out[i].score > 0.5} == bad
    assert all(out[i].passages for i in bad)


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    vec = [(i, [float(x) for x in base[i % 40] + 0.08 * r.normal(size=16)]) for i in range(300)]
    vec += [(300, vec[0][1]), (301, vec[0][1]), (302, None), (303, [0.0] * 16), (304, [float("nan")] * 16), (305, [1.0, 2.0]), (306, [2.0, 4.0]),
            (307, [None] + [1.0] * 15), (308, [])]
    df = spark.createDataFrame(vec, "vec_id bigint, embedding array<double>")
    fine = {i: np.array(v) for i, v in vec if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}

    def linked(a, b):
        x, y = fine.get(a), fine.get(b)
        return x is not None and y is not None and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95
    ids = [i for i, _ in vec]
    comp = _components(ids, linked)
    n = {a: sum(linked(a, b) for b in ids if a != b) for a in ids}
    out = {x.vec_id: x for x in hnsw.near_duplicates(df).collect()}
    assert {i: (out[i].n_links, out[i].component_id) for i in ids} == {i: (n[i], comp[i]) for i in ids}
    assert hnsw.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_graph_recall():
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 24))
    v = np.concatenate([base[r.integers(0, 300, 2000)] + 0.05 * r.normal(size=(2000, 24)), r.normal(size=(1000, 24))])
    u = hnsw.unit(v)
    graph = hnsw.Graph(u)
    q, w = graph.search(u[:500], 32, 0.95)
    true = (u[:500] @ u.T >= 0.95).sum()
    assert len(q) >= 0.97 * true


def _shard(vectors, first_key=0):
    u = hnsw.unit(vectors)
    return {"vectors": vectors, "keys": np.arange(first_key, first_key + len(u)), "copies": np.ones(len(u), np.int64),
            "graph": hnsw.Graph(u)}


def test_lone_pairs_through_a_bad_graph():
    """No audited vector has a true link; planted near copies tell that the graph finds little."""
    r = np.random.default_rng(21)
    a, b = r.normal(size=(1500, 32)), r.normal(size=(1500, 32))
    audited = np.random.default_rng(11).random(1500) < max(hnsw.AUDIT, hnsw.AUDIT_LEAST / 1500)
    lone = np.flatnonzero(~audited)[::300]
    b[lone] = a[lone] + 0.02 * r.normal(size=(len(lone), 32))
    left, right = _shard(a), _shard(b, 1500)
    for shard in (left, right):
        shard["graph"].layers[-1][1][:] = -1  # no links left on the lowest layer
    names, counts, edges = hnsw.match_shards(left, right, False, 0.95)[:3]
    assert {int(names[x]) for x in np.flatnonzero(counts)} == {*lone.tolist(), *(lone + 1500).tolist()}
    assert len(edges) == len(lone)


def test_links_found_from_one_side_count_for_both():
    r = np.random.default_rng(22)
    base = r.normal(size=(600, 24))
    v = np.concatenate([base, base[:200] + 0.02 * r.normal(size=(200, 24)), base[:1] + 0.01 * r.normal(size=(400, 24))])
    for same in (True, False):
        left = _shard(v)
        right = left if same else _shard(v[::-1] + 0.01 * r.normal(size=v.shape), 5000)
        names, counts, edges = hnsw.match_shards(left, right, same, 0.95)[:3]
        true = hnsw.cosine(left["vectors"][:, None].repeat(len(v), 1).reshape(-1, 24), np.tile(right["vectors"], (len(v), 1))) >= 0.95
        true = true.reshape(len(v), len(v))
        if same:
            np.fill_diagonal(true, False)
        assert counts.tolist() == (true.sum(1) if same else np.concatenate([true.sum(1), true.sum(0)])).tolist()


def test_memory_of_one_large_group():
    import tracemalloc
    r = np.random.default_rng(23)
    left, right = (_shard(np.ones((1, 8)) + 0.01 * r.normal(size=(4000, 8)), k) for k in (0, 4000))
    tracemalloc.start()
    names, counts, edges = hnsw.match_shards(left, right, False, 0.95)[:3]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (counts == 4000).all() and len(edges) == 7999
    assert peak < 120e6  # all 1.6e7 links at once are 128 MB a copy


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select((F.col("id") * 7 % 200).alias("a"), ((F.col("id") + 1) * 7 % 200).alias("b"))
    out = common.components(edges, common.Scratch(spark, "test"))
    assert {(r.component) for r in out.collect()} == {0} and out.count() == 200


def test_pipeline(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(SMALL + "/documents.parquet")
    assert out.columns == [*docs.columns, "copy"]
    assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
    bench = [r.text for r in spark.read.parquet(SMALL + "/benchmark.parquet").collect()]
    for r in out.collect():
        assert not any(b in r.text for b in bench)
