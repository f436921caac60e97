"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import ann, byte_bpe, decontaminate, html_extract, jaccard_join, line_dedup, periodic_runs, piece_codec, quality, secret_scan, spelling, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [x.values.to_numpy().astype("<u4").tobytes() for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), batch.column("data")], ["doc_id", "n_tokens", "ids_sha256", "data"]
        )


def byte_bpe_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts to ids, and these to bytes again."""
    digests = byte_bpe.round_trip(documents, _id_digests, "doc_id long, n_tokens long, ids_sha256 string, data binary")
    return digests.select("doc_id", "n_tokens", "ids_sha256", F.sha2("data", 256).alias("decoded_sha256"))


def mistyped(doc_id: object, word: str) -> str:
    """The word without a letter, in one of 199 cases by the checksum of doc_id and word."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    k = h % len(word)
    return word[:k] + word[k + 1 :] if h % 199 == 0 else word


def spelling_variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of six letters and more, with letters lost as by `mistyped`."""
    return spelling.variant_groups(spelling.word_counts(documents, mistyped, spelling.LEAST_LETTERS - 1))


def with_cycles(documents: DataFrame) -> DataFrame:
    """doc_id, text: in one of ten documents (by the checksum of its id) the words from some place on are replaced by a cycle of the words there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words)
    at = (g % n).cast("int")
    period = (F.floor((n - at) / (3 + g % 8)) + 1).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, at + 1, period), F.ceil((n - at) / period).cast("int")))
    cycled = F.concat(F.slice(words, F.lit(1), at), F.slice(cycle, F.lit(1), n - at))
    return documents.select("doc_id", F.when((h % 10 == 0) & (n > 0), F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))


def periodic_run_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    runs = periodic_runs.periodic_runs(documents)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    table = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length, period = F.col("longest.length"), -F.col("longest.period")
    return table.select(
        "doc_id", "n_runs", (-F.col("longest.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES = {
    "op1_quality_classifier": lambda spark, d: quality.quality(_table(spark, d, "documents"), _table(spark, d, "labels")),
    "op2_line_dedup": lambda spark, d: line_dedup.line_dedup(_table(spark, d, "documents")),
    "op3_html_extraction": lambda spark, d: html_extract.extracted(_table(spark, d, "pages")),
    "op4_secret_scan": lambda spark, d: secret_scan.secrets(_table(spark, d, "documents")),
    "op5_toxicity": lambda spark, d: toxicity.toxicity(_table(spark, d, "documents"), _table(spark, d, "labels")),
    "op6_substring_dedup": lambda spark, d: substring_dedup.substring_dedup(_table(spark, d, "documents")),
    "op7_sentencepiece": lambda spark, d: piece_codec.encoded(_table(spark, d, "documents")),
    "op8_ngram_jaccard_join": lambda spark, d: jaccard_join.jaccard_join(_table(spark, d, "documents")),
    "op9_nearest_neighbours": lambda spark, d: ann.nearest(_table(spark, d, "embeddings")),
    "op10_decontamination": lambda spark, d: decontaminate.contamination(_table(spark, d, "documents"), _table(spark, d, "benchmark")),
    "op11_byte_bpe": lambda spark, d: byte_bpe_digests(_table(spark, d, "documents")),
    "op12_spelling_variants": lambda spark, d: spelling_variants(_table(spark, d, "documents")),
    "op13_periodic_runs": lambda spark, d: periodic_run_digests(with_cycles(_table(spark, d, "documents"))),
}

# The usual checksum by a table of 256 entries, which `crc_table` has as one list.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
)"""


def _crc(bytes_: str) -> str:
    """SQL for the checksum of a list of bytes (BIGINT), beside crc_table."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


# Characters of words and ids are below U+0100, so a character has one byte or two.
_UTF8 = """flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), sets AS (
  SELECT doc_id, i, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM lines
), classes AS (
  SELECT s, min((doc_id, i)) AS f, row_number() OVER (ORDER BY min((doc_id, i))) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), words AS (SELECT c, n, unnest(s) AS w FROM classes
), df AS (SELECT w, count(*) AS df FROM words GROUP BY w
), prefix AS (
  SELECT c, n, w FROM (SELECT c, n, words.w, row_number() OVER (PARTITION BY c ORDER BY df, words.w) AS r FROM words JOIN df ON words.w = df.w)
  WHERE r <= n - ceil(0.8 * n - 1e-9) + 1
), near AS (
  SELECT DISTINCT a.c AS a, b.c AS b FROM prefix a JOIN prefix b ON a.w = b.w AND a.c < b.c AND b.n >= 0.8 * a.n - 1e-9 AND a.n >= 0.8 * b.n - 1e-9
), bad AS (
  SELECT DISTINCT b AS c FROM near JOIN classes x ON x.c = a JOIN classes y ON y.c = b
  WHERE len(list_intersect(x.s, y.s)) >= 0.8 * (x.n + y.n - len(list_intersect(x.s, y.s))) - 1e-9
), marked AS (
  SELECT sets.doc_id, sets.i, sets.line, classes.c IS NOT NULL AND (bad.c IS NOT NULL OR f <> (sets.doc_id, sets.i)) AS gone
  FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN bad ON classes.c = bad.c
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
""",
    "op6_substring_dedup": rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents
), windows AS (
  SELECT doc_id, p, list_slice(ws, p, p + 34) AS s FROM (SELECT doc_id, ws, unnest(range(1, CAST(len(ws) AS BIGINT) - 33)) AS p FROM docs)
), many AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1
), gone AS (SELECT DISTINCT doc_id, p + k AS p FROM windows SEMI JOIN many USING (s), range(0, 35) AS r(k)
), words AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM docs
), kept AS (
  SELECT words.doc_id, string_agg(w, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY words.doc_id
)
SELECT docs.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id
""",
    "op8_ngram_jaccard_join": rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, list_slice(ws, p, p + 4) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(CAST(len(ws) AS BIGINT) - 3, 2))) AS p FROM docs WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b, o, x.n AS n, y.n AS m FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE o >= 0.8 * (x.n + y.n - o) - 1e-9
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), groups AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a
), degrees AS (SELECT a, count(*) AS n_links, min(CASE WHEN o = n AND o = m THEN b END) AS same FROM links GROUP BY a)
SELECT docs.doc_id, least(docs.doc_id, coalesce(same, docs.doc_id)) AS class_id, group_id, coalesce(n_links, 0) AS n_links, coalesce(sizes.n, 0) AS n_shingles
FROM docs JOIN groups ON groups.a = docs.doc_id LEFT JOIN degrees ON degrees.a = docs.doc_id LEFT JOIN sizes ON sizes.doc_id = docs.doc_id
""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents
), counted AS (SELECT doc_id, w, count(*) AS k FROM runs GROUP BY ALL HAVING length(w) >= 6
), hashed AS (
  SELECT w, k, {_crc(_UTF8.format("doc_id || ':' || w"))} AS h FROM counted, crc_table
), changed AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, k FROM hashed
), vocabulary AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM changed WHERE length(w) >= 6 GROUP BY w HAVING sum(k) >= 5
), places AS (SELECT w, n, unnest(range(0, length(w))) AS p FROM vocabulary
), replaced AS (SELECT w, n, left(w, p) || '*' || substr(w, p + 2) AS g FROM places
), shortened AS (SELECT DISTINCT w, n, left(w, p) || substr(w, p + 2) AS g FROM places
), near AS (
  SELECT a.w, a.n, b.w AS v, b.n AS m FROM replaced a JOIN replaced b USING (g) WHERE a.w <> b.w
  UNION ALL SELECT s.w, s.n, v.w, v.n FROM shortened s JOIN vocabulary v ON s.g = v.w
  UNION ALL SELECT v.w, v.n, s.w, s.n FROM shortened s JOIN vocabulary v ON s.g = v.w
), best AS (SELECT w, n, v, m, count(*) OVER (PARTITION BY w) AS n_near, row_number() OVER (PARTITION BY w ORDER BY m DESC, v) AS r FROM near
), forms AS (SELECT w, n_near, CASE WHEN m >= 5 * n THEN v END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM best WHERE r = 1
), ways AS (SELECT w, w AS v FROM vocabulary UNION ALL SELECT ways.w, forms.form FROM ways JOIN forms ON forms.w = ways.v AND forms.form IS NOT NULL
), roots AS (SELECT w, v AS root FROM ways WHERE v NOT IN (SELECT w FROM forms WHERE form IS NOT NULL))
SELECT w AS word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM vocabulary JOIN roots USING (w) LEFT JOIN forms USING (w)
""",
    "op13_periodic_runs": rf"""
WITH {_CRC_TABLE}, given AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws, {_crc(_UTF8.format("doc_id::VARCHAR"))} AS h FROM documents, crc_table
), cycles AS (SELECT r, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS c, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM given
), docs AS (
  SELECT r, doc_id, CASE WHEN c THEN ws[:a] || list_transform(range(n - a), lambda i: ws[a + i % (1 + (n - a) // (3 + g % 8)) + 1]) ELSE ws END AS ws FROM cycles
), words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i, len(ws) AS n FROM docs
), same AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k HAVING count(*) >= 3 * q AND count(*) + q >= 6
), runs AS (SELECT r, s, l, min(q) AS q FROM stretches GROUP BY r, s, l
), lists AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t, min_by(s, (-l, s, q)) AS s, max(l) AS l, min_by(q, (-l, s, q)) AS q FROM runs GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(lists.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM docs LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)
""",
}
