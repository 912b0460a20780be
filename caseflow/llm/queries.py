"""The digest queries over the operators, and their DuckDB twins where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import (anchors, decontam, divergence, hnsw, jaccard, langid, mixing, reply_trees, resample, secret_scan,
                          suffixes, toxicity, warc)
from caseflow.llm.common import Scratch, held_out, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    found = secret_scan.find_secrets(docs.select("doc_id", "text"), model)

    def count(kind):
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.span_text(F.col("spans")).alias("spans"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
        FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM win JOIN twice USING (h), range(35) t(k)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.p) AS s, count(*) AS n
         FROM word ANTI JOIN gone ON word.r = gone.r AND word.p = gone.p GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@query("op2_substring_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anchors.remove_repeats(table(spark, sf_dir, "documents"), 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"), 100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), 1.5, (3, 1, 2), 2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs, model, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score")


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "score", "word_start", "word_end")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP7_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
           FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
pair AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, pair.y FROM reach JOIN pair ON reach.y = pair.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id
FROM d JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op7_jaccard_join", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(table(spark, sf_dir, "documents"), 4, 85)
    return out.select("doc_id", "n_shingles", "component_id")


def _base32_sql(hex_column: str) -> str:
    chunks = []
    for i in range(8):
        value = f"CAST('0x' || substr({hex_column}, {5 * i + 1}, 5) AS BIGINT)"
        chunks += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({value} >> {s}) & 31 AS INTEGER) + 1, 1)"
                   for s in (15, 10, 5, 0)]
    return " || ".join(chunks)


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
top AS (SELECT b, max(page_id) AS t FROM p GROUP BY b)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, {_base32_sql('h')} AS payload_digest,
       CASE WHEN page_id = t THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> t THEN t END AS refers_to
FROM p JOIN top USING (b)
"""


@query("op8_warc", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive(table(spark, sf_dir, "pages"), "html", 0)
    return warc.read_archives(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where("not held_out"), labels.where(~held_out()))
    out = toxicity.score(docs, model, "doc_id", "held_out")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


OP10_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
link AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.x = v.vec_id) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) c ON c.x = v.vec_id
"""


@query("op10_embedding_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


# Lengths of the marks: user 15, assistant 5, system 19, other roles 13 and the name; an escape adds 1.
OP11_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/SYS>>|/INST\]|SYS>>|INST\]|/s>|s>|\|)', '\1\2\\\3', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 19
      ELSE 13 + length(replace(replace(role, '%', '%25'), '|', '%7C')) END AS size
  FROM m),
c AS (
  SELECT conv_id, count(*) AS n, sum(size) AS size, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM n GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars
FROM c
"""


@query("op11_chat_format", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role")),
        F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("assistant").alias("role")))).alias("m")).select(
        F.lit(-1).cast("bigint").alias("conv_id"), "m.*", F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    scratch = Scratch(spark, "chat")
    messages = reply_trees.chains(rows, "conv_id", [F.col(c).asc_nulls_last() for c in ("turn", "role", "text")], scratch.path("rows"))
    written = scratch.write(reply_trees.conversations(messages, tree="conv_id"), "formatted")
    read = reply_trees.read_back(written)
    learned = F.array_join("messages.learned", "")
    turns = F.transform("messages", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read.select(
        F.col("tree").alias("conv_id"), F.size("messages").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


OP12_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS MATERIALIZED (
  SELECT lang, CAST(coalesce(count(term), 0) AS HUGEINT) AS v, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
cell AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (
  SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cell USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(cell.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(cell.n, 0) + 2) // (g.total + 2 * v.v) AS p,
         1 + 1000000000::HUGEINT * (kept.n + 2) // (v.total + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN cell ON cell.lang = g.lang AND cell.source = g.source AND cell.term = kept.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op12_divergence", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


# CRC-32 by bytes: its table from the reflected polynomial, a word's checksum by a fold over its bytes
OP13_SQL = rf"""
WITH tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x
  FROM benchmark),
dw AS MATERIALIZED (SELECT r, unnest(w) AS x FROM d),
word AS MATERIALIZED (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM b)),
hashed AS MATERIALIZED (
  SELECT x, xor(4294967295, list_reduce(list_concat([4294967295],
         list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
         lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1]))) % 10000 AS k
  FROM word, tab),
s AS MATERIALIZED (SELECT k, count(*) AS n FROM dw JOIN hashed USING (x) GROUP BY k),
t AS MATERIALIZED (SELECT k, count(*) AS n FROM b JOIN hashed USING (x) GROUP BY k),
gain AS MATERIALIZED (
  SELECT q.k, CAST(floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0)::DOUBLE FROM s) + 10000)
         / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0)::DOUBLE FROM t) + 10000)))) AS BIGINT) AS g
  FROM (SELECT unnest(range(10000)) AS k) q LEFT JOIN s ON s.k = q.k LEFT JOIN t ON t.k = q.k),
total AS (SELECT r, sum(g) AS g FROM dw JOIN hashed USING (x) JOIN gain USING (k) GROUP BY r),
w AS (
  SELECT doc_id, len(w) AS n, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE floor(coalesce(g, 0)::DOUBLE / len(w)) END AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)::DOUBLE AS h
  FROM d LEFT JOIN total USING (r)),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
rk AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id, n, weight) END AS p FROM sc)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score,
       CASE WHEN p <= (SELECT 10 * count(*) // 100 FROM sc WHERE n >= 20) THEN p END AS rank
FROM rk
"""


@query("op13_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
