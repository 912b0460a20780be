"""Windows of signature keys, and the one shuffle of texts in the mixture."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import jaccard, mixing


def _draw(r, n):
    return r.integers(0, 1 << 63, n).astype(np.uint64)


def _rows(sets, percent):
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return jaccard.windowed_signatures(doc, np.concatenate(sets), np.array([len(s) for s in sets]), percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_key_whose_windows_agree(percent):
    r = np.random.default_rng(8)
    for size in (4, 9, 30, 41, 60, 200, 3000):
        a = np.unique(_draw(r, size))
        for cut in sorted({1, size // 20, size // 12, size // 10, size // 9, size // 6} - {0}):  # equal sets are one class
            for more in {0, cut // 2, cut}:
                b = np.concatenate([a[cut:], _draw(r, more)])
                both = len(a) - cut
                if 100 * both < percent * (len(a) + len(b) - both):
                    continue
                owner, key, window = _rows([a, b], percent)
                first = dict(zip(key[owner == 0].tolist(), window[owner == 0].tolist()))
                second = dict(zip(key[owner == 1].tolist(), window[owner == 1].tolist()))
                assert any((first[k] ^ second[k]).bit_count() < jaccard.WINDOW for k in first.keys() & second.keys())


def test_long_sets_far_apart_hardly_meet(spark):
    r = np.random.default_rng(5)
    common = _draw(r, 2000)
    sets = [np.concatenate([common, _draw(r, 2500)]) for _ in range(12)]  # similarity 0.29
    owner, key, window = _rows(sets, 80)
    rows = spark.createDataFrame([(int(o), int(k), int(w)) for o, k, w in zip(owner, key.view(np.int64), window.view(np.int64))],
                                 "lo bigint, key bigint, window bigint")
    left = rows.select("key", F.col("lo").alias("a")).distinct()
    by_key = left.join(left.withColumnRenamed("a", "b"), "key").where("a < b").count()
    shared = jaccard._shared(rows)
    met = shared.alias("x").join(shared.alias("y"), "key").where(f"x.lo < y.lo and {jaccard._same_window('x.window', 'y.window')}")
    assert by_key > 200 and met.count() * 10 < by_key


def test_mixture_shuffles_texts_once_and_keeps_every_copy(spark):
    rows = [(i, f"word{i} " * (i % 7 + 1), "abc"[i % 3]) for i in range(60)] + [(5, "same words here", "a")] * 9 + [(None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    out = mixing.mixed_documents(docs, budget=2.6, cap=4.0)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\n]*row#", plan)) == 1
    got = {(r.doc_id, r.text, r.source): r.n for r in out.groupBy("doc_id", "text", "source").agg(F.count("*").alias("n")).collect()}
    taken = mixing.mix(docs, budget=2.6, cap=4.0, whole=True).groupBy("doc_id", "source", "key").agg(F.sum("copies").alias("n"))
    assert sorted(got.values()) == sorted(r.n for r in taken.where("n > 0").collect())
    copy = out.where("doc_id = 5 and text = 'same words here'").groupBy("copy").count().orderBy("copy").collect()
    counts = [r["count"] for r in copy]
    assert counts[:-1] == [9] * (len(counts) - 1) and counts[-1] <= 9  # as equal as copies can be
