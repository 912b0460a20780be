"""Secret scan: fixed patterns plus character Markov models.

The patterns find assignments, access keys and long hex strings.  Beside them
runs of identifier characters are scored by two first-order character Markov
models, one of random strings and one of ordinary identifiers.  A run is cut at
``/``, ``=`` and patterns' spans; neighbouring pieces that look random (with only
``/`` and ``=`` between them) are taken together, and become a span of kind
``markov`` from ``MIN_RUN`` characters on if their log-likelihood ratio exceeds
``THRESHOLD``, and ``RATE`` a character.  Pieces that look random and touch an
access key or a hex string are the rest of a longer key and become spans as well.

Training takes labelled samples ``(sample, random)``.  :func:`labelled_samples`
draws them from at most ``TRAIN_DOCS`` documents in expectation (by content
hash): values of the pattern spans are random strings, alphabetic identifiers
are ordinary; digests of a number range add random strings over further
alphabets, and ``COMMON`` words, alone and in pairs, ordinary parts of paths and keys.
Ordinary samples count in capitals as well.  The fitted table has one cell per pair of alphabet characters, so
its size does not depend on the data.

Only DataFrame functions run on the executors, and scanning needs no shuffle.
Null texts count as empty.  Offsets are code points, ends exclusive.  Repeated
rows are scanned alike; extra columns are ignored by :func:`find_secrets` and
kept by :func:`redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
MIN_RUN = 14
MIN_NUMBER = 20  # digits alone: shorter ones are numbers of cards, phones, times
KEY, OTHER = "\ue000", "\ue001"  # stand for the characters of patterns' spans: access and hex; assign
RUN = rf"[A-Za-z0-9+/_={KEY}-]{{{MIN_RUN},}}"
PIECE = rf"[A-Za-z0-9+_-]+|{KEY}+|[/=]+"
THRESHOLD = 12.0
RATE = 0.7
COMMON = """account address admin api app archive article assets auth backup bin branch browser build cache catalog category
 channel client cloud code collection comment common component config connection console content context controller
 credential customer dashboard data database default delete deploy detail dev device directory document domain download
 driver edit email engine entry environment error event example export factory feature file filter folder font format
 gateway global graph group handler help history home host html http image import include index info input install
 interface internal invoice item job key language latest layout legacy library license link list local location log
 login main manager market master media member memory menu message method metrics model module monitor name network
 news node notification object operation option order output package page param partner path payment platform plugin
 policy post preferences preview process product production profile project property provider proxy public query queue
 read record redirect reference refresh region register release remote report repository request resource response
 result review role root route sample schedule schema script search section security server service session settings
 share signup simple source stage static status storage store stream style submit support system table task template
 test theme thread thumb time topic tracking transaction translation type update upload user utility value version
 video view web widget window worker www""".split()
TRAIN_DOCS = 20_000
DIGESTS = 2_000
SMOOTHING = 0.5
SPAN = "struct<s: int, k: int, e: int, v: string>"
BLOCK = 1024  # code points


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda would compute a captured expression per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, state: Column, step, kind: str) -> Column:
    """What ``step`` emits along an array: ``step(state, x)`` gives the next state and an array of type ``kind``.

    An aggregate copies what it carries at every step.  Items are taken in about
    sqrt(n) chunks, each with an array of its own, so n items copy n^1.5 values;
    ``kind`` should hold numbers only.
    """
    def inside(acc, x):
        after, new = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], new).alias("out"))

    def along(acc, part):
        begin = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return _let(F.aggregate(part, begin, inside), lambda r: F.struct(
            r["state"].alias("state"), F.concat(acc["done"], F.array(r["out"])).alias("done")))

    def chunks(all_items):
        size = F.ceil(F.sqrt(F.size(all_items))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_items) / size).cast("int") - 1),
                            lambda i: F.slice(all_items, i * size + 1, size))
        begin = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done"))
        return F.flatten(F.aggregate(parts, begin, along)["done"])

    return _let(items, lambda x: F.when(F.size(x) > 0, chunks(x)).otherwise(F.array().cast(f"array<{kind}>")))


def _blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` code points: a place in a long text is reached without walking to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` to ``end`` (exclusive) of a text in blocks."""
    i, j = F.floor(begin / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    first, at = F.get(blocks, i), begin - i * BLOCK + 1
    return F.when(begin >= end, F.lit("")).when(i == j, F.substr(first, at, end - begin)).otherwise(F.concat(
        F.substr(first, at), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substr(F.get(blocks, j), F.lit(1), end - j * BLOCK)))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, at_least: int = 0) -> Column:
    """All matches of a pattern with their positions, from what lies between them."""
    def positions(t):
        found, pieces = t["found"], t["pieces"]
        lengths = F.transform(F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m")), lambda x: F.struct(
            F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m")))
        begins = _scan(lengths, F.lit(0), lambda pos, x: (pos + x["p"] + x["m"], F.array(pos + x["p"])), "int")
        spans = F.transform(F.arrays_zip(begins.alias("s"), found.alias("m")), lambda x: F.struct(
            x["s"].alias("s"), F.lit(kind).alias("k"), (x["s"] + F.length(x["m"])).alias("e"),
            (F.regexp_extract(x["m"], pattern, group) if group else x["m"]).alias("v")))
        return F.filter(spans, lambda x: F.length(x["v"]) >= at_least) if at_least else spans

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(text.rlike(pattern), _let(both, positions)).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (pattern spans) and ``runs`` (identifier runs, patterns' spans covered)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = (docs.withColumn("_a", _spans(t, ASSIGN, 0, 2, 6)).withColumn("_b", _spans(t, ACCESS, 1))
          .withColumn("_c", _spans(t, HEX, 2)))
    df = df.withColumn("base", F.array_sort(F.concat("_a", "_b", "_c"))).drop("_a", "_b", "_c")
    return df.withColumn("runs", _spans(F.when(F.size("base") > 0, _covered(t)).otherwise(t), RUN, 3))


def _replaced(text: Column, spans: Column, fill) -> Column:
    """The text with each part that spans cover replaced by ``fill(span, where the text goes on)``, a string."""
    bounds = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    # where the text goes on before each span: the furthest end so far
    ahead = _scan(bounds, F.lit(0), lambda pos, x: (F.greatest(pos, x["e"]), F.array(pos)), "int")

    def pieces(blocks):
        parts = F.transform(F.arrays_zip(ahead.alias("pos"), spans.alias("x")), lambda y: F.concat(
            _cut(blocks, y["pos"], y["x"]["s"]), fill(y["x"], y["pos"])))
        last = F.array_max(F.transform(spans, lambda x: x["e"]))
        return F.concat(F.array_join(parts, ""), _cut(blocks, last, F.length(text)))
    return _let(_blocks(text), pieces)


def _covered(text: Column) -> Column:
    """The text with pattern spans filled by ``KEY`` or ``OTHER``, all else at its place."""
    return _replaced(text, F.col("base"), lambda x, pos: F.repeat(
        F.when(x["k"] == 0, F.lit(OTHER)).otherwise(F.lit(KEY)), F.greatest(x["e"] - F.greatest(pos, x["s"]), F.lit(0))))


def random_parts(run: Column, model: list[float]) -> Column:
    """Spans of the parts of a run that look random."""
    # the open group: where it begins and ends, characters, ratio, whether it touches a key
    state = F.struct(run["s"].alias("pos"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("n"),
                     F.lit(0.0).alias("x"), F.lit(False).alias("near"))

    group = "struct<s: int, e: int, n: int, x: double, near: boolean>"

    def step(g, y):
        end = g["pos"] + y["n"]
        grows = (y["kind"] == 0) & (y["x"] > 0)
        key, mark, fresh = y["kind"] == 1, y["kind"] == 2, g["n"] == 0
        ends = ~mark & ~grows
        closed = F.struct(
            g["s"].alias("s"), g["e"].alias("e"), g["n"].alias("n"), g["x"].alias("x"),
            (g["near"] | (key & (g["e"] == g["pos"]))).alias("near"))
        return F.struct(
            end.alias("pos"), F.when(grows & fresh, g["pos"]).otherwise(g["s"]).alias("s"),
            F.when(grows, end).otherwise(g["e"]).alias("e"),
            F.when(grows, g["n"] + y["n"]).when(ends, F.lit(0)).otherwise(g["n"]).alias("n"),
            F.when(grows, g["x"] + y["x"]).when(ends, F.lit(0.0)).otherwise(g["x"]).alias("x"),
            F.when(key, F.lit(True)).when(ends | (mark & fresh), F.lit(False)).otherwise(g["near"]).alias("near")), \
            F.when(ends & ~fresh, F.array(closed)).otherwise(F.array().cast(f"array<{group}>"))

    # kinds of pieces: 0 characters to score, 1 a key's place, 2 marks between
    pieces = F.transform(F.regexp_extract_all(run["v"], F.lit(PIECE), F.lit(0)), lambda p: F.struct(
        F.length(p).alias("n"), F.when(F.startswith(p, F.lit(KEY)), 1).when(p.rlike("^[/=]"), 2).otherwise(0).alias("kind"),
        F.when(p.rlike(f"^[/={KEY}]"), F.lit(0.0)).otherwise(ratio(p, model)).alias("x")))
    # an ordinary piece of no length closes the last group
    last = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("kind"), F.lit(0.0).alias("x")))
    groups = _scan(F.concat(pieces, last), state, step, group)

    def spans(blocks):
        with_value = F.transform(groups, lambda g: F.struct(g.alias("g"), _cut(
            blocks, g["s"] - run["s"], g["e"] - run["s"]).alias("v")))

        def random(y):
            g, v = y["g"], y["v"]
            no_number = v.rlike("[A-Za-z]") | (v.rlike("[0-9]") & (g["n"] >= MIN_NUMBER))
            return g["near"] | ((g["n"] >= MIN_RUN) & (g["x"] > THRESHOLD) & (g["x"] > RATE * g["n"]) & no_number)
        return F.transform(F.filter(with_value, random), lambda y: F.struct(
            y["g"]["s"].alias("s"), F.lit(3).alias("k"), y["g"]["e"].alias("e"), y["v"].alias("v")))

    return _let(_blocks(run["v"]), spans)


def labelled_samples(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``sample, random`` from a bounded share of the documents and from digests."""
    n = max(1, docs.count())
    share = int(min(1.0, train_docs / n) * 1_000_000)
    some = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share)
    values = with_spans(some).select(F.explode("base").alias("b")).where(
        "length(b.v) >= 16 and b.v rlike '[0-9]'").select(F.col("b.v").alias("sample"))
    # whole identifiers of letters, in parts of two or more, capitals only at the head of a part
    words = some.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9+/_=.-]{8,}"), F.lit(0)))
                        .alias("sample")).select(F.rtrim("sample", F.lit(".")).alias("sample")).where(
        F.col("sample").rlike(r"^[A-Za-z][A-Za-z_.-]{6,}[a-z]$") & ~F.col("sample").rlike(
            r"[_.-][_.-]|[_.-][A-Za-z](?:[_.-]|$)|(?<=[A-Za-z_.-])[A-Z](?![a-z])"))
    ids = docs.sparkSession.range(DIGESTS).select(F.col("id").cast("string").alias("id"))
    digest = F.sha2("id", 256)
    made = ids.select(F.explode(F.array(
        F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(digest)), "+/=", ""), F.md5("id"),
        F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""), 1, 24)))).alias("sample"))
    common = docs.sparkSession.range(len(COMMON)).select(F.element_at(F.lit(COMMON), (F.col("id") + 1).cast("int")).alias("a"))
    plain = common.select(F.explode(F.concat(F.array("a", F.initcap("a")), F.flatten(F.transform(
        F.lit(COMMON[::8]), lambda b: F.array(F.concat("a", F.lit("_"), b), F.concat("a", F.lit("-"), b), F.concat("a", F.initcap(b)))))))
        .alias("sample"))
    ordinary = words.unionByName(plain)
    return (values.unionByName(made).withColumn("random", F.lit(1))
            .unionByName(ordinary.unionByName(ordinary.select(F.upper("sample").alias("sample")))
                         .withColumn("random", F.lit(0)))).distinct()


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every transition, ``previous * width + current``."""
    codes = F.transform(F.split("sample", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = samples.where("length(sample) > 0").select("random", codes.alias("c")).select("random", F.explode(F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.slice("c", 1, F.size("c") - 1)).alias("p"), F.col("c").alias("c"))).alias("t")) \
        .select("random", "t.p", "t.c")
    width = len(ALPHABET) + 1
    seen = {(r["random"], r["p"], r["c"]): r["n"] for r in
            steps.groupBy("random", "p", "c").agg(F.count("*").alias("n")).collect()}  # at most 2 * width^2 rows
    totals: dict = {}
    for (label, p, _), n in seen.items():
        totals[label, p] = totals.get((label, p), 0) + n

    def log_p(label, p, c):
        return math.log((seen.get((label, p, c), 0) + SMOOTHING) / (totals.get((label, p), 0) + SMOOTHING * width))
    return [log_p(1, p, c) - log_p(0, p, c) for p in range(width) for c in range(width)]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string, positive where it looks random."""
    width = len(ALPHABET) + 1
    table = F.lit(model)
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("x"))
    return F.aggregate(codes, start, lambda a, c: F.struct(
        c.alias("p"), (a["x"] + F.element_at(table, a["p"] * width + c + 1)).alias("x")))["x"]


def find_secrets(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (``s, k, e, v``: start, kind index, end, matched value)."""
    df = with_spans(docs, text)
    scored = F.flatten(F.transform("runs", lambda r: random_parts(r, model)))
    return df.withColumn("spans", F.array_sort(F.concat(
        "base", F.when(F.size("runs") > 0, scored).otherwise(F.col("runs"))))).drop("runs")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; ``n_chars`` follows.

    Overlapping spans are replaced by one mask.  Rows and columns stay, whatever their names.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("whole"))
    df = find_secrets(row, model, "whole")
    hit = F.size("spans") > 0
    clean = _replaced(F.col("whole"), F.col("spans"), lambda x, pos: F.when(x["s"] >= pos, F.lit(mask)).otherwise(""))
    df = df.withColumn("whole", F.when(hit, clean).otherwise(F.col("whole")))
    new = {"text": F.col("whole")}
    if "n_chars" in docs.columns:
        length = F.length("whole").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(hit, length).otherwise(F.col("row.n_chars"))
    return df.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
