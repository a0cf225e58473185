"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.branches import DELETE, REPLACE, RETAIN, Branch, merge, operation
from millrace.llm.crcsql import CRC_TABLE, crc32_sql
from millrace.llm.licenses import scan, scan_sql
from millrace.llm.linerules import line_rules, line_rules_sql
from millrace.llm.media import media_columns
from millrace.llm.mixing import PART_MEAN, TERMS, replicate
from millrace.llm.packing import pack
from millrace.llm.quality import fit, score
from millrace.llm.sharding import shard
from millrace.llm.simhash import near_duplicates
from millrace.llm.spelling import one_lost, spelling_sql, spelling_variants
from millrace.llm.suffix_dedup import deduplicate
from millrace.llm.topk import exact_top_k
from millrace.llm.warc import REVISIT_BYTES, round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 200 bytes that are found more than once."""
    made = deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=200)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    made = shard(_table(spark, sf_dir, "documents"), 24)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate classes of all documents."""
    made = near_duplicates(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every vector whose id is divisible by 50."""
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as images in archives, described as read back."""
    return media_columns(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights that go with the square root of their sources' sizes."""
    return replicate(_table(spark, sf_dir, "documents"), seed=17)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents"), capacity=2048)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each page, as read back from the archives."""
    read = round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License sentences and licenses of all documents."""
    return scan(_table(spark, sf_dir, "documents"))


def held_out(id_col: str) -> Column:
    """The fold that labels are never learnt from; rows without an id are not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents, of which some have lost a letter."""
    return spelling_variants(_table(spark, sf_dir, "documents"), edit=one_lost(199))


def _code(branch: str, name: Column | str) -> Column:
    """What a branch does to the part of a document that ``name`` names: a number below 17."""
    name = F.lit(name) if isinstance(name, str) else name.cast("string")
    return F.crc32(F.concat(F.lit(f"{branch}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), name).cast("binary")) % 17


def _branch(name: str) -> Branch:
    """The operations that the codes stand for."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    none = F.array().cast("array<string>")

    def of_line(x: Column, i: Column) -> Column:
        c = _code(name, i)
        return F.when(c == 0, operation(DELETE)).when(c == 1, operation(REPLACE, F.concat(x, F.lit("!")))).when(c == 2, operation(REPLACE, F.concat(x, F.lit("?")))).otherwise(operation(RETAIN))

    def gap(x: Column, i: Column) -> Column:  # noqa: ARG001
        c = _code(name, i)
        return F.when(c == 3, F.array(F.lit("!"))).when(c == 4, F.array(F.lit("?"))).otherwise(none)

    def value(column: str) -> Column:
        c, x = _code(name, column), F.coalesce(F.col(column), F.lit(""))
        return F.when(c == 0, F.lit("")).when(c == 1, F.concat(x, F.lit("!"))).when(c == 2, F.concat(x, F.lit("?")))

    return Branch(_code(name, "row") == 0, F.transform(lines, of_line), F.concat(F.array(none), F.transform(lines, gap)), {c: value(c) for c in ("lang", "source")})


def op12_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches of all documents, merged: digests of the texts, and what was clean or a conflict."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")

    def added(name: str, first: int) -> DataFrame:
        told = docs.select((F.lit(first) - F.col("doc_id")).alias("doc_id"), "lang", "source", F.when(_code(name, "row") == 3, "!").when(_code(name, "row") == 4, "?").alias("text"))
        return told.where(F.col("text").isNotNull())

    made = merge(docs, _branch("L"), _branch("R"), added("L", -1), added("R", -5))
    return made.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What base and line rules find in all documents, and which are kept."""
    made = line_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return made.select("doc_id", *base, "n_lines", "n_lines_removed", "lost_chars")


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS e, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT rid, i, md5(array_slice(e, i + 1, i + 200)) AS k FROM (SELECT rid, e, unnest(range(0, greatest(n - 199, 0))) AS i FROM d)),
c AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM w SEMI JOIN c USING (k)),
g AS (SELECT rid, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM s),
r AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY ALL),
l AS (SELECT rid, run, a, z, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY run) AS y FROM r),
k AS (SELECT rid, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS last,
  string_agg(hex(array_slice(e, y + 1, a)), '' ORDER BY run) AS head FROM l JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN last IS NULL THEN e ELSE unhex(head || hex(array_slice(e, last + 1, n))) END) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
t AS (SELECT payload, max(page_id) AS top FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload)
SELECT page_id, payload_bytes, sha1(p.payload) AS payload_digest,
  CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM p LEFT JOIN t ON p.payload = t.payload
"""

OP5_SQL = f"""
WITH s AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source),
r AS (SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s),
p AS (SELECT source, rate, greatest(ceil(rate / {PART_MEAN}), 1)::INT AS parts FROM r),
t AS (SELECT source, k, exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) AS term FROM p, range(0, {TERMS + 1}) g(k)),
c AS (SELECT source, list(acc ORDER BY k) AS cdf FROM (SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS acc FROM t) GROUP BY source),
u AS (SELECT d.*, coalesce(doc_id::VARCHAR, '') AS id, cdf, parts FROM documents d
      JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON d.source IS NOT DISTINCT FROM c.source),
n AS (SELECT *, list_sum([len([x for x in cdf if x <= (('0x' || substr(md5('17|' || id || '|' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496]) for j in range(0, parts)])::INT AS copies FROM u)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS mix_copy, ('0x' || substr(md5('17|key|' || id || '|' || copy), 1, 15))::BIGINT AS mix_key
FROM (SELECT *, unnest(range(0, copies)) AS copy FROM n)
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11_SQL = spelling_sql(CRC_TABLE, crc32_sql("key"), 199)


def _op12_sql() -> str:
    code = lambda branch, name: crc32_sql(f"'{branch}:' || id || ':' || {name}") + " % 17"
    state = lambda c, x: f"CASE {c} WHEN 0 THEN NULL WHEN 1 THEN {x} || '!' WHEN 2 THEN {x} || '?' ELSE {x} END"
    value = lambda c, x: f"CASE {c} WHEN 0 THEN '' WHEN 1 THEN {x} || '!' WHEN 2 THEN {x} || '?' ELSE {x} END"
    gap = lambda c: f"CASE {c} WHEN 3 THEN '!' WHEN 4 THEN '?' END"
    parts = lambda a, g: f"array_to_string(list_filter(flatten(list([{a}, {g}] ORDER BY i)), lambda x: x IS NOT NULL), chr(10))"
    both = lambda x: f"l_{x} <> {x} AND r_{x} <> {x} AND l_{x} <> r_{x}"
    either = lambda x: f"(l_{x} <> {x} OR r_{x} <> {x})"
    codes = ", ".join(f"{code(b, repr(n))} AS {b.lower()}c_{n}" for b in "LR" for n in ("row", "lang", "source"))
    return f"""
WITH {CRC_TABLE},
a AS (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id::VARCHAR, '') AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents),
b AS MATERIALIZED (SELECT a.*, {codes} FROM a, crc),
c AS (SELECT *, {', '.join(f"{value(f'{s}c_{n}', n)} AS {s}_{n}" for s in 'lr' for n in ('lang', 'source'))} FROM b),
d AS (SELECT row, id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM (SELECT row, id, string_split(body, chr(10)) AS lines FROM a)),
e AS MATERIALIZED (SELECT row, line, i, {code('L', 'i')} AS l, {code('R', 'i')} AS r FROM d, crc),
f AS (SELECT row, i, l, r, {state('l', 'line')} AS l_line, CASE WHEN l < 3 THEN {state('l', 'line')} ELSE {state('r', 'line')} END AS m_line,
  {gap('l')} AS l_gap, CASE WHEN l IN (3, 4) THEN {gap('l')} ELSE {gap('r')} END AS m_gap FROM e),
g AS (SELECT row, {parts('l_line', 'l_gap')} AS l_text, {parts('m_line', 'm_gap')} AS m_text, bool_or(l < 5) AS l_any, bool_or(r < 5) AS r_any,
  count(*) FILTER ((l < 3 OR r < 3) AND NOT (l < 3 AND r < 3 AND l <> r)) + count(*) FILTER ((l IN (3, 4) OR r IN (3, 4)) AND NOT (l IN (3, 4) AND r IN (3, 4) AND l <> r)) AS clean,
  count(*) FILTER (l < 3 AND r < 3 AND l <> r AND l > 0 AND r > 0) AS ee, count(*) FILTER (l < 3 AND r < 3 AND l <> r AND (l = 0 OR r = 0)) AS ed,
  count(*) FILTER (l IN (3, 4) AND r IN (3, 4) AND l <> r) AS ii FROM f GROUP BY row),
h AS (SELECT *, lc_row = 0 AS l_drop, rc_row = 0 AS r_drop, l_any OR l_lang <> lang OR l_source <> source AS l_changed, r_any OR r_lang <> lang OR r_source <> source AS r_changed FROM c JOIN g USING (row)),
k AS (SELECT *, l_drop AND NOT r_drop AND r_changed OR r_drop AND NOT l_drop AND l_changed AS clash FROM h),
m AS (SELECT *, l_drop OR r_drop AND NOT clash AS gone FROM k),
n AS (SELECT doc_id, CASE WHEN NOT gone THEN CASE WHEN r_drop OR l_lang <> lang THEN l_lang ELSE r_lang END END AS lang,
  CASE WHEN NOT gone THEN CASE WHEN r_drop OR l_source <> source THEN l_source ELSE r_source END END AS source,
  CASE WHEN NOT gone THEN sha256(CASE WHEN r_drop THEN l_text ELSE m_text END) END AS text_sha256,
  CASE WHEN l_drop OR r_drop THEN (NOT clash)::BIGINT ELSE clean + ({either('lang')} AND NOT ({both('lang')}))::BIGINT + ({either('source')} AND NOT ({both('source')}))::BIGINT END AS n_clean,
  CASE WHEN l_drop OR r_drop THEN 0 ELSE ee + ({both('lang')})::BIGINT + ({both('source')})::BIGINT END AS n_edit_edit,
  CASE WHEN l_drop OR r_drop THEN clash::BIGINT ELSE ed END AS n_edit_delete, CASE WHEN l_drop OR r_drop THEN 0 ELSE ii END AS n_insert_insert FROM m),
o AS (SELECT -1 - doc_id AS doc_id, true AS first, [lang, source, CASE lc_row WHEN 3 THEN '!' ELSE '?' END] AS v FROM b WHERE lc_row IN (3, 4)
  UNION ALL SELECT -5 - doc_id, false, [lang, source, CASE rc_row WHEN 3 THEN '!' ELSE '?' END] FROM b WHERE rc_row IN (3, 4)),
p AS (SELECT doc_id, min(v) FILTER (first) AS l, min(v) FILTER (NOT first) AS r FROM o GROUP BY doc_id),
q AS (SELECT *, coalesce(l, r) AS v, coalesce(l <> r, false) AS clash FROM p)
SELECT doc_id, lang, source, text_sha256, n_clean::BIGINT AS n_clean, n_edit_edit::BIGINT AS n_edit_edit, n_edit_delete::BIGINT AS n_edit_delete, n_insert_insert::BIGINT AS n_insert_insert FROM n
UNION ALL SELECT doc_id, v[1], v[2], sha256(v[3]), (NOT clash)::BIGINT, 0, 0, clash::BIGINT FROM q
"""


OP12_SQL = _op12_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_media": op4_media,
    "op5_mixing": op5_mixing,
    "op6_topk": op6_topk,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_licenses": op9_licenses,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_branches": op12_branches,
    "op13_line_rules": op13_line_rules,
}

ORACLES: dict[str, str] = {"op1_suffix_dedup": OP1_SQL, "op5_mixing": OP5_SQL, "op6_topk": OP6_SQL, "op8_warc": OP8_SQL, "op9_licenses": scan_sql(), "op11_spelling": OP11_SQL, "op12_branches": OP12_SQL, "op13_line_rules": line_rules_sql()}
