"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib

import pytest

from caseflow.llm import common, resample

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, score string, rank int, a double, _part int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def features(text, ngrams):
    w = TERM.findall(lower(text))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]


def expected(rows, target, ngrams=1, buckets=10_000, percent=10, least=20):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for f in features(text, ngrams)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, ngrams)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for i, text in rows:
        n, f = features(text, ngrams)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, n, len(f), weight, score))
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = fit[:percent * len(fit) // 100]
    left = list(out)
    for x in drawn:
        left.remove(x)
    return sorted([(*x, r) for r, x in enumerate(drawn, 1)] + [(*x, None) for x in left], key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéAB9") for _ in range(r.randint(1, 6))) for _ in range(200)]
    out = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in range(300)]
    out += [(None, out[7][1]), (7, out[7][1]), (7, out[7][1]), (8, out[9][1]), (301, None), (302, ""), (303, "x" * 300_000),
            (304, "-- ,;"), (305, "na " * 50_000)]
    return out, [" ".join(r.choice(vocab[:50]) for _ in range(30)) for _ in range(10)] + [None, ""]


def run(spark, rows, target, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, 0.5, 3) for i, t in rows], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.resample(docs, goal, **options)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"ngrams": 2, "buckets": 97}, {"percent": 100, "least": 0}, {"percent": 0},
                                     {"percent": 37, "least": 3}])
def test_resample(spark, rows, options):
    names = {"least": "least_words"}
    got = run(spark, *rows, group=16, **{names.get(k, k): v for k, v in options.items()})
    assert got == expected(*rows, **options)


def test_repeated_rows_at_the_cutoff(spark, rows):
    same = [(4, rows[0][0][1]), *[(5, "a b c " * 10)] * 40]
    assert run(spark, same, rows[1], percent=50, group=3) == expected(same, rows[1], percent=50)


def test_empty(spark, rows):
    assert run(spark, [], rows[1]) == []
    assert run(spark, rows[0][:30], []) == expected(rows[0][:30], [])


def test_cutoff_is_the_kth_key_and_each_round_discards(spark):
    r = random.Random(2)
    keys = [(r.randint(-5, 5) if i % 3 == 0 else 0, r.randint(0, 40)) for i in range(900)]
    df = spark.createDataFrame(keys, "a bigint, b bigint").repartition(4)
    for k in (1, 17, 450, 899, 900):
        key, rounds = resample.cutoff(df, k, common.Scratch(spark, "cut"), group=20)
        assert key == sorted(keys)[k - 1]
        # at least a quarter goes in a round, but for what the halves of small groups round away
        assert all(x["left"] <= 0.75 * x["rows"] + 50 for x in rounds[1:])
    assert resample.cutoff(df, 0, common.Scratch(spark, "cut"))[0] is None
    assert resample.cutoff(df, 901, common.Scratch(spark, "cut"))[0] is None
