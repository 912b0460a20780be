"""Secret scan and mixing on very long texts and clashing columns."""

import re

import pytest

from caseflow.llm import mixing, secret_scan as S

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


@pytest.fixture(scope="module")
def model():
    width = len(S.ALPHABET) + 1
    return [0.5 if i % 3 else -0.5 for i in range(width * width)]


def test_identifiers_of_a_million_parts(spark, model):
    """Long camel-case, dashed and underscored runs neither crash nor take quadratic time."""
    rows = [(i, t, "s") for i, t in enumerate(["Ab" * 1_000_000, "a-" * 1_000_000, "ab_" * 1_000_000, "\\" * 1_000_000, "secret" * 300_000])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert len(S.train(S.labelled_samples(docs))) == len(model)
    assert S.redact(docs, model).count() == 5
    assert S.find_secrets(docs, model).count() == 5


@pytest.mark.parametrize("between", [" and é ", "'", "\n"])
def test_twenty_thousand_spans(spark, model, between):
    text = between.join(f"password=abc{i:06d}" for i in range(20_000))
    row = S.find_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    expected = [(m.start(), 0, m.end(), m.group(1)) for m in ASSIGN.finditer(text)]
    assert [tuple(x) for x in row["base"]] == expected and len(expected) == 20_000
    masked = S.redact(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()["text"]
    assert masked == between.join(["[SECRET]"] * 20_000)


def test_pieces_of_long_texts(spark):
    """Cutting by blocks equals a plain slice, across block borders and beyond the first plane."""
    from pyspark.sql import functions as F
    text = "".join(chr(97 + i % 26) if i % 7 else "\U0001f600" for i in range(5 * S.BLOCK + 3))
    ends = [0, 1, S.BLOCK - 1, S.BLOCK, S.BLOCK + 1, 3 * S.BLOCK, 5 * S.BLOCK, len(text)]
    pairs = [(a, b) for a in ends for b in ends if a <= b]
    df = spark.createDataFrame([(text, a, b) for a, b in pairs], "text string, a int, b int")
    got = df.select("a", "b", S._let(S._blocks(F.col("text")), lambda t: S._cut(t, F.col("a"), F.col("b"))).alias("c")).collect()
    assert all(r["c"] == text[r["a"]:r["b"]] for r in got) and len(got) == len(pairs)


def test_columns_survive(spark, model):
    rows = [(1, "password=abcdef12 x", "a", 19, "b", "s", "r", "c", "k"), (2, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, base string, spans string, "
                                       "runs string, copy string, whole string")
    out = {r["doc_id"]: r for r in S.redact(docs, model).collect()}
    assert tuple(out[1]) == (1, "[SECRET] x", "a", 10, "b", "s", "r", "c", "k") and tuple(out[2]) == rows[1]
    mixed = mixing.mixed_documents(docs, budget=4.0, cap=4.0)
    assert mixed.columns == [*docs.columns, "copy_"]
    assert {r["copy"] for r in mixed.where("doc_id = 1").collect()} == {"c"}
