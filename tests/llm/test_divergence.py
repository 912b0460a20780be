"""Source divergence audit against a plain computation."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from caseflow.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, doc_id bigint, n int, term string, value string, r double, rank int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, least, top):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {x[1] for x in rows}:
        mine = [(terms(t), s) for t, g, s in rows if g == lang]
        df = Counter(w for t, _ in mine for w in set(t))
        kept = {w for w, n in df.items() if n >= least}
        counts = {s: Counter() for _, s in mine}
        for t, s in mine:
            counts[s].update(w for w in t if w in kept)
        whole = sum(counts.values(), Counter())
        v = len(kept)

        def share(c, w):
            return 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * v)
        for s, c in counts.items():
            p = {w: share(c, w) for w in kept}
            pairs = [(sum((p[w] - share(d, w)) ** 2 // (p[w] + share(d, w)) for w in kept), o) for o, d in counts.items() if o != s]
            words = [((p[w] - share(whole, w)) ** 2 // (p[w] + share(whole, w)), w) for w in kept if c[w] and p[w] > share(whole, w)]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, f, k) for k, (f, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 5))) for _ in range(150)]
    out = []
    for i in range(500):
        source = f"s{r.randint(0, 18)}" if r.random() < 0.7 else "hot"
        words = [r.choice(vocab[:30] if r.random() < 0.6 else vocab) for _ in range(r.randint(0, 30))]
        if source in ("s3", "s4"):
            words = ["only" + source] * 3 + words[:2]
        out.append((" ".join(words).title() if i % 7 == 0 else ", ".join(words), ["en", "de", None][i % 3], source))
    out += [(None, "en", "s1"), ("", "en", None), ("12 -- 3", "xx", "lonely"), ("12", "yy", "a"), (None, "yy", "b"),
            ("\U0001f600 x", "yy", "￿"), ("x", "yy", "\U0001f600"), ("a" * 200_000, "en", "s2"), ("la " * 60_000, "de", "s2")]
    return out + out[:40]


def run(spark, rows, *args, **options):
    df = spark.createDataFrame([(*x, 1, 2, "t", "v", 0.5, 3) for x in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, divergence.audit(df, *args, **options).collect()))


@pytest.mark.parametrize("least,top,shape", [(10, 10, (64, 4096)), (1, 3, (4, 8)), (3, 200, (8, 32))])
def test_audit(spark, rows, least, top, shape):
    assert run(spark, rows, least, top, shape=shape) == expected(rows, least, top)


def test_empty(spark):
    assert run(spark, []) == []


def test_counts_beyond_64_bits_of_the_scaled_count(spark):
    """Shares stay exact where count * SCALE leaves 64 bits."""
    from pyspark.sql import functions as F
    n, total, v = 999_999_999_999, 7_000_000_000_003, 12_345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_walk_prices_empty_quadrants(rows):
    r = np.random.default_rng(4)
    shape, width = (16, 256), 201
    zero = r.integers(1, 50, 13)
    used = np.zeros((13, width), bool)
    used[2:4, 20:30] = used[9, 100:140] = True
    p = np.where(used, r.integers(100, 10**9, used.shape), zero[:, None])
    a, c = np.nonzero(used)
    x = divergence.Tile(shape, np.arange(13), zero, width, a, c, p[a, c])
    sums, leaves, priced = divergence.walk(x, x, width, True)
    whole = ((p[:, None, :] - p[None, :, :]) ** 2 // (p[:, None, :] + p[None, :, :])).sum(axis=2)
    i, j = np.triu_indices(13, 1)
    assert (sums[i, j] == whole[i, j]).all()
    assert priced and leaves * divergence.LEAF ** 3 < 13 * 13 * width // 4
