"""Reply trees and chat formatting: paths against a plain walk, formatting as an exact round trip."""

import random

import pytest
from pyspark.sql import functions as F

from caseflow.llm import reply_trees
from caseflow.llm.reply_trees import Template

SCHEMA = "tree bigint, id bigint, parent bigint, role string, text string, score double, key int, leaf string, turn int, up int, m int"
NASTY = ["</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "\n<</SYS>>\n\n", "<|", "|>", "<|end|>\n", "\\", "\\\\", "[", "<", " ", "/INST]",
         "$1", "é\U0001f600", "\n", "x", "[\\INST]", "<\\/s>", "<\\\\|"]


def _text(r):
    return None if r.random() < 0.05 else "".join(r.choice(NASTY) for _ in range(r.randint(0, 9)))


def _trees():
    r = random.Random(11)
    rows = []
    for tree in [*range(12), None]:
        for i in range(r.randint(1, 40)):
            parent = r.choice([None, i, r.randint(0, max(0, i - 1)), max(0, i - 1), max(0, i - 1), 999, i + 1])
            rows.append((tree, i, parent, r.choice(["user", "assistant", "system", "to|ol%7C", "", None]), _text(r), r.choice([None, 1.0, 2.5, -1.0])))
        rows += [(tree, None, 0, "user", "no id", 1.0), (tree, 3, 2, "zz", "a second one of this id", 0.0)]
    rows += [(100, i, (i + 1) % 7, "user", f"circle {i}", 1.0) for i in range(7)] + [(100, 50, 3, "assistant", "below", 1.0)]
    rows += [(101, i, i - 1, "user" if i % 2 else "assistant", f"t{i}", None) for i in range(1, 400)]
    return rows + rows[:30]


def _expected(rows):
    out = []
    for tree in {x[0] for x in rows}:
        one = {}
        for t, i, parent, role, text, score in rows:
            if t == tree:
                m = ((parent is not None, parent or 0), role or "", text or "", score or 0.0, parent)
                one[i] = min(one.get(i, m), m)
        up = {i: m[4] if m[4] in one and m[4] is not None and m[4] != i else None for i, m in one.items()}
        for i in sorted(up, key=lambda i: (i is None, i or 0)):  # the smallest of a circle becomes its root
            at, seen = up[i], set()
            while at is not None and at not in seen and at != i:
                seen.add(at)
                at = up[at]
            if at is not None and at == i:
                up[i] = None
        paths = []
        for leaf in set(one) - set(up.values()):
            path, at = [leaf], up[leaf]
            while at is not None:
                path.append(at)
                at = up[at]
            paths.append((-sum(one[i][3] for i in path), -len(path), (leaf is None, leaf or 0), path[::-1]))
        if None in one and None not in [p[3][-1] for p in paths]:
            path, at = [None], up[None]
            while at is not None:
                path.append(at)
                at = up[at]
            paths.append((-sum(one[i][3] for i in path), -len(path), (True, 0), path[::-1]))
        for rank, (score, _, _, path) in enumerate(sorted(paths), 1):
            out.append((tree, path[-1], rank, -score, [(one[i][1], one[i][2]) for i in path]))
    return sorted(out, key=str)


@pytest.mark.parametrize("best", [None, 1, 2])
def test_paths_and_round_trip(spark, best):
    rows = _trees()
    df = spark.createDataFrame([(*x, 1, "l", 2, 3, 4) for x in rows], SCHEMA).repartition(5)
    out = reply_trees.read_back(reply_trees.conversations(df, best=best, score="score")).collect()
    got = sorted([(x["tree"], x["leaf"], x["rank"], x["score"], [(m["role"], m["text"]) for m in x["messages"]]) for x in out], key=str)
    assert got == [x for x in _expected(rows) if best is None or x[2] <= best]
    for x in out:
        assert x["n_turns"] == len(x["messages"])
        for m, t in zip(x["messages"], x["turns"]):
            assert (m["learned"] == m["text"]) if m["role"] == "assistant" else m["learned"] is None and t["loss_start"] is None


@pytest.mark.parametrize("template", [Template(), Template(
    marks={"assistant": ("<|im_start|>assistant\n", "<|im_end|>\n")}, other=("<|im_begin|>", "|>\n", "<|im_end|>\n"),
    reserved=("<|endoftext|>", "</s>"), learned=("assistant", "critic"))])
def test_escape_leaves_no_mark_and_is_reversible(spark, template):
    r = random.Random(6)
    marks = [m.strip() for p in template.marks.values() for m in p if m.strip()] + [template.other[0], template.other[2].strip()]
    texts = ["".join(r.choice(NASTY + ["<|im_start|>", "<|im_end|>", "<|endoftext|>"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("e", template.escape(F.col("text")))
    for x in df.withColumn("u", template.unescape(F.col("e"))).collect():
        assert x["u"] == x["text"]
        assert not any(m in x["e"] for m in [*marks, *template.reserved])


def test_long_texts_and_chains(spark):
    rows = [(7, 1, "user", "<" * 300_000), (7, 2, "assistant", "[INST]" * 100_000), (7, 2, "assistant", None), (None, None, None, None)]
    rows += [(8, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv bigint, turn bigint, role string, text string")
    path = "file:" + spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/chains"
    msgs = reply_trees.chains(df, "conv", [F.col("turn"), F.col("role"), F.col("text")], path)
    out = {x["tree"]: x for x in reply_trees.read_back(reply_trees.conversations(msgs, tree="conv")).collect()}
    assert [m["text"] for m in out[7]["messages"]] == ["<" * 300_000, "", "[INST]" * 100_000]
    assert [m["text"] for m in out[8]["messages"]] == [f"turn {i}" for i in range(3000)]
    assert [(m["role"], m["text"]) for m in out[None]["messages"]] == [("", "")]


def test_a_wrong_place_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, None, "user", "a", 0.0)], "tree bigint, id bigint, parent bigint, role string, text string, score double")
    out = reply_trees.conversations(df).withColumn("formatted", F.concat("formatted", F.lit("[INST] more [/INST]")))
    with pytest.raises(Exception, match="does not fit"):
        reply_trees.read_back(out).collect()
    with pytest.raises(ValueError):
        Template(marks={"user": ("", "</s>")})


def test_empty(spark):
    df = spark.createDataFrame([], "tree bigint, id bigint, parent bigint, role string, text string")
    assert reply_trees.read_back(reply_trees.conversations(df)).count() == 0
