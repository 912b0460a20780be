"""Edited copies of benchmark items against alignment of every pair, whole operator included."""

import random

import pytest

from caseflow.llm import decontam

SEED = 12


def _best(item, text):
    words = decontam.words_of([item.encode(), text.encode()])
    a, b = (words.hash[words.first[i]:words.first[i + 1]] for i in (0, 1))
    return decontam.smith_waterman(a, b)[0] / (2 * len(a))


@pytest.fixture(scope="module")
def planted():
    """Items of 12 to 60 words, and one document for each, noise around a copy with a share of words replaced."""
    r = random.Random(SEED)
    common = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 4))) for _ in range(60)]
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(4000)]

    def word():
        return r.choice(common) if r.random() < 0.4 else r.choice(vocab)
    items, docs = [], []
    for i in range(240):
        item = [word() for _ in range(r.randint(12, 60))]
        rate = (0.0, 0.1, 0.2, 0.3)[i % 4]
        copy = [word() if r.random() < rate else w for w in item]
        text = [word() for _ in range(r.randint(20, 150))] + copy + [word() for _ in range(r.randint(20, 150))]
        items.append((i, " ".join(item)))
        docs.append((1000 + i, " ".join(text), rate))
    clean = [(5000 + i, " ".join(word() for _ in range(300)), None) for i in range(200)]
    return items, docs, clean


def test_recall_of_edited_copies(spark, planted):
    items, docs, clean = planted
    found = {(x["doc_id"], x["item_id"]): x["score"] for x in decontam.contaminated(
        spark.createDataFrame([(d, t) for d, t, _ in docs + clean], "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for rate in (0.0, 0.1, 0.2, 0.3):
        due = {(d, i): s for (i, item), (d, text, k) in zip(items, docs) if k == rate
               for s in [_best(item, text)] if s >= decontam.THRESHOLD}
        assert len(due) > 30
        assert sum(k in found for k in due) >= (0.95 if rate else 1.0) * len(due), rate
        assert all(abs(found[k] - s) < 1e-9 for k, s in due.items() if k in found)
    # nothing but what the alignment of the pair supports
    texts, by_id = {d: t for d, t, _ in docs + clean}, dict(items)
    for (d, i), s in found.items():
        assert d < 5000 and _best(by_id[i], texts[d]) >= s - 1e-9


def test_clashing_columns_stay(spark):
    from caseflow.llm import jaccard
    cols = "doc_id bigint, text string, rid string, _rid string, _k int, _one int, one int, row string, k int, lo int, n int"
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t, "r", "s", 1, 2, 3, "x", 4, 5, 6) for i, t in ((1, text), (2, text), (2, text), (3, None), (4, "one two"))]
    docs = spark.createDataFrame(rows, cols)
    assert sorted(map(tuple, jaccard.one_of_each(docs).collect())) == sorted([rows[0], rows[3], rows[4]])
    out = decontam.decontaminate(docs, spark.createDataFrame([(1, text)], "item_id bigint, text string"))
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows[3:])
