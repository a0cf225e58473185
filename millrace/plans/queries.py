"""Registered queries over the standard tables, each over whole tables, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vectors import cosine, doubles, euclidean, norm, total
from millrace.operators import conversation, descent, embedding, knn, pca, tables
from millrace.operators.ann import AnnIndex
from millrace.operators.metric import MetricIndex
from millrace.operators.nearest import nearest, ranked
from millrace.operators.ordered import as_of, overlapping
from millrace.operators.wide_pca import fit_wide
from millrace.plans import sqlsearch
from millrace.sources import cache
from millrace.sources.files import load_documents, load_histories, load_table, save, save_histories
from millrace.sources.jsonarrays import load_array, save_array
from millrace.sources.providers import EchoChat, HashEmbedding, replies
from millrace.sources.shared import materialize, shared_dir
from millrace.sources.versions import load_version, save_version
from millrace.streaming.conversation import ordered_contexts

Query = Callable[[SparkSession, str], DataFrame]

SEARCHES = ["the nation that is with the thing", "de la que en el", "and for the station, isn't it?"]
TOP = 10
GRID, PADDING = 200, 1.5
RATES = [0.05, 0.5, 1.05]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _texts(items: list[str]) -> str:
    return ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(items))


_WORDS = "regexp_extract_all(lower({0}), '[a-z'']+')"
_BAGS = f"""
bags AS (SELECT doc_id, ('0x' || right(md5(w), 2))::INT % 64 AS bucket, count(*) AS n
  FROM (SELECT doc_id, unnest({_WORDS.format("coalesce(text, '')")}) AS w FROM documents) GROUP BY ALL)"""


@registered(f"WITH {_BAGS} SELECT doc_id, bucket, n FROM bags")
def hash_bow_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document fall into each of 64 hash buckets."""
    return embedding.bucket_counts(load_table(spark, sf_dir, "documents"))


@registered(f"""WITH {_BAGS}
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)::BIGINT::DOUBLE), 9) AS weight FROM bags""")
def hash_bow_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding.bucket_weights(load_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "bucket", F.round("weight", 9).alias("weight"))


@registered(f"""WITH {_BAGS}, norms AS (SELECT doc_id, sum(n * n)::BIGINT AS s FROM bags GROUP BY doc_id),
cells AS (SELECT unnest(range(0, 64))::INT AS position)
SELECT d.doc_id, position, round(coalesce(n / sqrt(s::DOUBLE), 0.0), 9) AS value
FROM documents d CROSS JOIN cells LEFT JOIN bags b ON b.doc_id = d.doc_id AND b.bucket = position LEFT JOIN norms m ON m.doc_id = d.doc_id""")
def embed_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 components of every document's vector."""
    made = embedding.embed(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = made.select("doc_id", F.posexplode_outer("embedding").alias("position", "value"))  # inner, a filter on the size would compute it again
    return rows.select("doc_id", "position", F.round("value", 9).alias("value"))


def _search_sql(items: list[str], k: int) -> str:
    return f"""WITH {_BAGS},
norms AS (SELECT doc_id, sum(n * n)::BIGINT AS s FROM bags GROUP BY doc_id),
q AS (SELECT query_id, ('0x' || right(md5(w), 2))::INT % 64 AS bucket, count(*) AS n
  FROM (SELECT i AS query_id, unnest({_WORDS.format('t')}) AS w FROM (VALUES {_texts(items)}) v(i, t)) GROUP BY ALL),
qn AS (SELECT query_id, sum(n * n)::BIGINT AS s FROM q GROUP BY query_id),
dots AS (SELECT query_id, doc_id, sum(bags.n * q.n)::BIGINT AS p FROM bags JOIN q USING (bucket) GROUP BY ALL),
scored AS (SELECT qn.query_id, d.doc_id, coalesce(p::DOUBLE / (sqrt(norms.s::DOUBLE) * sqrt(qn.s::DOUBLE)), 0.0) AS score
  FROM qn CROSS JOIN documents d LEFT JOIN norms USING (doc_id) LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.doc_id = d.doc_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank, doc_id, score FROM scored)
SELECT query_id::INT AS query_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {k}"""


@registered(_search_sql(SEARCHES[:1], TOP))
def semantic_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents most like one query."""
    return embedding.search(load_table(spark, sf_dir, "documents"), SEARCHES[:1], TOP)


@registered(f"SELECT rank, doc_id, score FROM ({_search_sql(SEARCHES[:1], TOP)})")
def search_from_sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a table function that SQL text calls."""
    load_table(spark, sf_dir, "documents").createOrReplaceTempView("millrace_documents")
    return sqlsearch.search(spark, "millrace_documents", SEARCHES[0], TOP)


@registered(_search_sql(SEARCHES, 3))
def semantic_search_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents most like each of three queries."""
    return embedding.search(load_table(spark, sf_dir, "documents"), SEARCHES, 3)


_FIRST = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings ORDER BY vec_id LIMIT 1)"
_COSINE = "CASE WHEN list_dot_product({0}, {0}) = 0 OR list_dot_product({1}, {1}) = 0 THEN 0.0 ELSE list_cosine_similarity({0}, {1}) END"


def _first_vector(vectors: DataFrame) -> DataFrame:
    """One row: the vector of the least id."""
    return F.broadcast(vectors.agg(F.min_by("embedding", "vec_id").alias("q")))


@registered(f"WITH {_FIRST} SELECT vec_id, round(list_distance(embedding::DOUBLE[], qv), 6) AS distance FROM embeddings, q")
def euclidean_to_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every vector to the first."""
    v = load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = v.join(_first_vector(v), F.lit(True))
    return rows.select("vec_id", F.round(euclidean(F.col("embedding"), F.col("q")), 6).alias("distance"))


@registered(f"WITH {_FIRST} SELECT vec_id, round({_COSINE.format('embedding::DOUBLE[]', 'qv')}, 6) AS similarity FROM embeddings, q")
def cosine_to_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = v.join(_first_vector(v).withColumn("nq", norm(F.col("q"))), F.lit(True))
    return rows.select("vec_id", F.round(cosine(F.col("embedding"), F.col("q"), norm_b=F.col("nq")), 6).alias("similarity"))


@registered(f"""WITH {_FIRST}, s AS (SELECT vec_id, {_COSINE.format('embedding::DOUBLE[]', 'qv')} AS score FROM embeddings, q)
SELECT row_number() OVER (ORDER BY score DESC, vec_id DESC)::INT AS rank, vec_id, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id DESC LIMIT {TOP}""")
def dense_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most like the first."""
    v = load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = v.join(_first_vector(v), F.lit(True)).select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("score"))
    return ranked(rows, "score", "vec_id", TOP).select("rank", "vec_id", F.round("score", 6).alias("score"))


@registered(f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, {_COSINE.format('q.embedding::DOUBLE[]', 'c.embedding::DOUBLE[]')} AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 3""")
def dense_search_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three other vectors most like each whose id is divisible by 50."""
    v = load_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = nearest(v.where("id % 50 = 0"), v, 3, "cosine", others_only=True)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("value", 6).alias("score"))


@registered("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS k FROM s),
v AS (SELECT query_id, label, count(*) AS n FROM r WHERE k <= 5 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS place FROM v)
SELECT query_id, label FROM w WHERE place = 1""")
def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that the five nearest other vectors give to each whose id is divisible by 50."""
    v = load_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return knn.classify(v.where("id % 50 = 0"), v, 5, others_only=True)


@registered("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank, vec_id, d FROM s)
SELECT query_id, rank::INT AS rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 10""")
def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of each whose id is divisible by 50, by an index of cells around pivots."""
    v = load_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = MetricIndex(v).search(v.where("id % 50 = 0"), 10, others_only=True)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("value", 6).alias("distance"))


@registered()
def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the ten nearest other vectors of each whose id is divisible by 50, by inverted lists; tests hold its recall against brute force."""
    v = load_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = AnnIndex(v, lists=32).search(v.where("id % 50 = 0"), 10, probe=20, depth=400, others_only=True)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("value", 6).alias("distance"))


@registered("""SELECT event_id, e.user_id, e.ts, o.o_orderkey, o.o_orderdate FROM events e ASOF LEFT JOIN
  (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM (SELECT o_custkey, o_orderdate + INTERVAL 9 YEAR AS o_orderdate, o_orderkey FROM orders) GROUP BY ALL) o
  ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def events_as_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its user's last order before it, orders being nine years on so that they reach into the events' time."""
    events = load_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    orders = load_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + INTERVAL 9 YEAR").alias("o_orderdate"), "o_orderkey")
    return as_of(events, orders, "user_id", "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "user_id", "ts", "o_orderkey", "o_orderdate")


@registered("""SELECT click_id, c.ts, c.client_id, s.sale_id, s.sold_at, s.total FROM clicks c ASOF LEFT JOIN
  (SELECT client_id, sold_at, max(sale_id) AS sale_id, arg_max(total, sale_id) AS total FROM (SELECT client_id, sold_at, sale_id, coalesce(total, -1) AS total FROM sales) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY ALL) s
  ON c.client_id = s.client_id AND c.ts >= s.sold_at""")
def clicks_as_of_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click with its client's last sale before it; clients without an id, and times that are missing, match nothing."""
    clicks = load_table(spark, sf_dir, "clicks").select("click_id", "ts", "client_id")
    sales = load_table(spark, sf_dir, "sales").select("client_id", "sold_at", "sale_id", F.coalesce("total", F.lit(-1.0)).alias("total"))
    return as_of(clicks, sales, "client_id", "ts", "sold_at", ["sale_id"]).select("click_id", "ts", "client_id", "sale_id", "sold_at", "total")


_SHIPMENTS = """s AS (SELECT l_orderkey * 8 + l_linenumber AS line_id, l_partkey, o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@registered(f"""WITH {_SHIPMENTS} SELECT a.line_id AS line_a, b.line_id AS line_b FROM s a JOIN s b
  ON a.l_partkey = b.l_partkey AND a.line_id < b.line_id AND a.o_orderdate <= b.l_shipdate AND b.o_orderdate <= a.l_shipdate
  WHERE a.o_orderdate <= a.l_shipdate AND b.o_orderdate <= b.l_shipdate""")
def shipments_under_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of order lines of one part of which both were ordered and not yet shipped at some time."""
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    spans = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"), "l_partkey", "o_orderdate", "l_shipdate")
    span = ("o_orderdate", "l_shipdate")
    pairs = overlapping(spans.withColumnRenamed("line_id", "line_a"), spans.withColumnRenamed("line_id", "line_b"), ["l_partkey"], span, span, "line_a", "line_b")
    return pairs.where("line_a < line_b")


_AXIS = f"CASE WHEN {{0}} = {GRID - 1} THEN {{2}} ELSE {{0}}::DOUBLE * (({{2}} - {{1}}) / {GRID - 1}::DOUBLE) + {{1}} END"


@registered(f"""WITH t AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
b AS (SELECT min(x) - {PADDING}::DOUBLE AS x0, max(x) + {PADDING}::DOUBLE AS x1, min(y) - {PADDING}::DOUBLE AS y0, max(y) + {PADDING}::DOUBLE AS y1 FROM t),
g AS (SELECT i // {GRID} AS gi, i % {GRID} AS gj, {_AXIS.format(f'(i % {GRID})', 'x0', 'x1')} AS gx, {_AXIS.format(f'(i // {GRID})', 'y0', 'y1')} AS gy
  FROM range(0, {GRID * GRID}) r(i), b),
s AS (SELECT gi, gj, vec_id, label, sqrt((gx - x) * (gx - x) + (gy - y) * (gy - y)) AS d FROM g, t),
r AS (SELECT *, row_number() OVER (PARTITION BY gi, gj ORDER BY d, vec_id) AS k FROM s),
v AS (SELECT gi, gj, label, count(*) AS n FROM r WHERE k <= 5 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY gi, gj ORDER BY n DESC, label) AS place FROM v)
SELECT gi::INT AS gi, gj::INT AS gj, label FROM w WHERE place = 1""")
def knn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision grid of all vectors' first two components."""
    t = load_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *(doubles(F.col("embedding"))[i].alias(c) for i, c in enumerate("xy")))
    x0, x1, y0, y1 = knn.bounds(t, padding=PADDING)
    return knn.classify_grid(t.select("id", F.array("x", "y").alias("v"), "label"), (x0, x1, GRID), (y0, y1, GRID), 5)


_CENTROIDS = """c AS (SELECT label, pos - 1 AS pos, avg(x) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL)"""


@registered(f"WITH {_CENTROIDS} SELECT label, pos::INT AS pos, round(mean, 6) AS mean FROM c")
def class_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pca.group_means(load_table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rows.select("label", "pos", F.round("mean", 6).alias("mean"))


@registered(f"""WITH {_CENTROIDS}, v AS (SELECT label, list(mean ORDER BY pos) AS m FROM c GROUP BY label)
SELECT a.label AS label_a, b.label AS label_b, round({_COSINE.format('a.m', 'b.m')}, 6) AS similarity FROM v a JOIN v b ON a.label < b.label""")
def centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine similarity of every two classes' centroids: pairs of labels, of which a classifier has few, not of rows."""
    rows = pca.group_means(load_table(spark, sf_dir, "embeddings"), "label", "embedding")
    v = rows.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("m"))
    a, b = v.select(F.col("label").alias("label_a"), F.col("m").alias("a")), v.select(F.col("label").alias("label_b"), F.col("m").alias("b"))
    return a.join(b, F.col("label_a") < F.col("label_b")).select("label_a", "label_b", F.round(cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


_SWEEP = f"""runs AS (SELECT vec_id * {len(RATES)} + i AS run_id, rate, embedding[1]::DOUBLE AS start FROM embeddings, (VALUES {', '.join(f'({i}, {r}::DOUBLE)' for i, r in enumerate(RATES))}) v(i, rate)),
path AS (SELECT run_id, rate, 0 AS step, start AS x FROM runs
  UNION ALL SELECT run_id, rate, step + 1, x - rate * ((x - 3.0::DOUBLE) * 2.0::DOUBLE) FROM path WHERE step < 30)"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = load_table(spark, sf_dir, "embeddings").select("vec_id", doubles(F.col("embedding"))[0].alias("start"))
    rates = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r).alias("rate")) for i, r in enumerate(RATES)))
    runs = starts.select("vec_id", "start", F.inline(rates))
    return descent.descend(runs.select((F.col("vec_id") * len(RATES) + F.col("i")).alias("run_id"), "start", "rate", F.lit(30).alias("steps")))


@registered(f"WITH RECURSIVE {_SWEEP} SELECT run_id, step, round(x, 6) AS x, round((x - 3.0::DOUBLE) * (x - 3.0::DOUBLE), 6) AS loss FROM path")
def gd_1d_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty steps on (x - 3)^2 at three rates from the first component of every vector."""
    return _sweep(spark, sf_dir).select("run_id", "step", F.round("x", 6).alias("x"), F.round("loss", 6).alias("loss"))


@registered(f"WITH RECURSIVE {_SWEEP} SELECT run_id, step, round(x, 6) AS x, round((x - 3.0::DOUBLE) * (x - 3.0::DOUBLE), 6) AS loss FROM path WHERE step = 30")
def gd_1d_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.last_step(_sweep(spark, sf_dir)).select("run_id", "step", F.round("x", 6).alias("x"), F.round("loss", 6).alias("loss"))


@registered("""WITH RECURSIVE path AS (SELECT vec_id AS run_id, 0 AS step, embedding[1]::DOUBLE * 4.0::DOUBLE AS x, embedding[2]::DOUBLE * 3.0::DOUBLE AS y FROM embeddings
  UNION ALL SELECT run_id, step + 1, x - 0.15::DOUBLE * (x * 2.0::DOUBLE), y - 0.15::DOUBLE * (y * 10.0::DOUBLE) FROM path WHERE step < 40)
SELECT run_id, step, round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, round(x * x + y * y * 5.0::DOUBLE, 9) + 0.0 AS loss FROM path""")
def gd_2d_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty steps on x^2 + 5 y^2 at rate 0.15, from the first two components of every vector, four and three times as large."""
    v = doubles(F.col("embedding"))
    runs = load_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("run_id"), (v[0] * 4.0).alias("x"), (v[1] * 3.0).alias("y"), F.lit(0.15).alias("rate"), F.lit(40).alias("steps"))
    return descent.descend_2d(runs).select("run_id", "step", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("x", "y", "loss")))


@registered("""WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my, var_pop(l_quantity) AS xx, var_pop(l_discount) AS zz,
  covar_pop(l_quantity, l_discount) AS xz, covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_discount, l_extendedprice) AS zy FROM lineitem),
s AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM m)
SELECT name, round(value, 4) AS value FROM (SELECT unnest(['l_quantity', 'l_discount', 'intercept']) AS name, unnest([a, b, my - a * mx - b * mz]) AS value FROM s)""")
def gd_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What descent on all order lines finds for the price by quantity and discount; the SQL has the closed form."""
    found, _ = descent.least_squares(load_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return spark.createDataFrame(list(found.items()), "name string, value double").select("name", F.round("value", 4).alias("value"))


@registered(f"""WITH b AS (SELECT min(embedding[1]::DOUBLE) - {PADDING}::DOUBLE AS x0, max(embedding[1]::DOUBLE) + {PADDING}::DOUBLE AS x1,
  min(embedding[2]::DOUBLE) - {PADDING}::DOUBLE AS y0, max(embedding[2]::DOUBLE) + {PADDING}::DOUBLE AS y1 FROM embeddings),
g AS (SELECT i // {GRID} AS gi, i % {GRID} AS gj, {_AXIS.format(f'(i % {GRID})', 'x0', 'x1')} AS gx, {_AXIS.format(f'(i // {GRID})', 'y0', 'y1')} AS gy FROM range(0, {GRID * GRID}) r(i), b)
SELECT gi::INT AS gi, gj::INT AS gj, round(gx, 9) AS gx, round(gy, 9) AS gy, round(gx * gx + gy * gy * 5.0::DOUBLE, 9) AS z FROM g""")
def surface_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x^2 + 5 y^2 on 200 x 200 points round the vectors' first two components."""
    t = load_table(spark, sf_dir, "embeddings").select(*(doubles(F.col("embedding"))[i].alias(c) for i, c in enumerate("xy")))
    x0, x1, y0, y1 = knn.bounds(t, padding=PADDING)
    rows = descent.surface(knn.grid(spark, (x0, x1, GRID), (y0, y1, GRID)))
    return rows.select("gi", "gj", *(F.round(c, 9).alias(c) for c in ("gx", "gy", "z")))


_PARTS = "p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


@registered(f"WITH {_PARTS} SELECT pos::INT AS pos, round(avg(x), 9) AS mean FROM p GROUP BY pos")
def pca_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca.means(load_table(spark, sf_dir, "embeddings"), "embedding").select("pos", F.round("mean", 9).alias("mean"))


@registered(f"WITH {_PARTS} SELECT a.pos::INT AS i, b.pos::INT AS j, round(covar_samp(a.x, b.x), 9) + 0.0 AS value FROM p a JOIN p b USING (vec_id) GROUP BY ALL")
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pca.covariance(load_table(spark, sf_dir, "embeddings"), "embedding")
    return rows.select("i", "j", (F.round("value", 9) + F.lit(0.0)).alias("value"))


_PAIR = """m AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my,
  0.5 * atan2(2 * covar_samp(l_quantity, l_discount), var_samp(l_quantity) - var_samp(l_discount)) AS angle FROM lineitem),
t AS (SELECT mx, my, cos(angle) AS a, sin(angle) AS b FROM m),
c AS (SELECT mx, my, a * CASE WHEN abs(a) >= abs(b) THEN sign(a) ELSE sign(b) END AS dx, b * CASE WHEN abs(a) >= abs(b) THEN sign(a) ELSE sign(b) END AS dy FROM t)"""


@registered(f"WITH {_PAIR} SELECT round(mx, 6) AS mx, round(my, 6) AS my, round(dx, 6) AS dx, round(dy, 6) AS dy FROM c")
def pca_2feature_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pca.two_columns(load_table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount")
    return rows.select(*(F.round(c, 6).alias(c) for c in ("mx", "my", "dx", "dy")))


def _pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    model = F.broadcast(pca.two_columns(rows, "l_quantity", "l_discount"))  # one row
    return rows.join(model, F.lit(True)).withColumn("score", (F.col("l_quantity") - F.col("mx")) * F.col("dx") + (F.col("l_discount") - F.col("my")) * F.col("dy"))


@registered(f"WITH {_PAIR} SELECT l_orderkey, l_linenumber, round((l_quantity - mx) * dx + (l_discount - my) * dy, 6) + 0.0 AS score FROM lineitem, c")
def pca_2feature_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_scores(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@registered(f"""WITH {_PAIR}, s AS (SELECT *, (l_quantity - mx) * dx + (l_discount - my) * dy AS score FROM lineitem, c)
SELECT l_orderkey, l_linenumber, round(score * dx + mx, 6) AS quantity, round(score * dy + my, 6) AS discount FROM s""")
def pca_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.paired(load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    model = pca.fit(rows, 1)
    back = rows.select("l_orderkey", "l_linenumber", model.restored(model.scores(F.col("v"))).alias("b"))
    return back.select("l_orderkey", "l_linenumber", F.round(F.col("b")[0], 6).alias("quantity"), F.round(F.col("b")[1], 6).alias("discount"))


@registered(f"""WITH {_PAIR}, r AS (SELECT min(l_quantity - mx) AS lo, max(l_quantity - mx) AS hi FROM lineitem, c),
along AS (SELECT i, CASE WHEN i = 99 THEN hi ELSE i::DOUBLE * ((hi - lo) / 99.0::DOUBLE) + lo END AS t FROM range(0, 100) g(i), r)
SELECT i::INT AS i, round(mx + t * dx, 6) AS quantity, round(my + t * dy, 6) AS discount FROM along, c""")
def principal_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred points of the first component's line."""
    rows = tables.paired(load_table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    line = pca.principal_line(rows, pca.fit(rows, 1))
    return line.select("i", F.round(F.col("points")[0], 6).alias("quantity"), F.round(F.col("points")[1], 6).alias("discount"))


def _leading(matrix: str, name: str, squarings: int = 16) -> str:
    """CTEs that end in ``name(pos, c)``: the leading eigenvector, a column of a high power of ``matrix(i, j, v)``, its largest entry positive."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM {matrix}) AS v FROM {matrix})"]
    for k in range(squarings):
        steps.append(f"{name}_s{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{k} a JOIN {name}_{k} b ON a.j = b.i GROUP BY ALL)")
        steps.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM {name}_s{k}) AS v FROM {name}_s{k})")
    last = f"{name}_{squarings}"
    steps.append(f"{name}_c AS MATERIALIZED (SELECT i AS pos, v FROM {last} WHERE j = (SELECT arg_max(j, v) FROM {last} WHERE i = j))")
    steps.append(f"{name}_n AS (SELECT sqrt(sum(v * v)) AS n, (SELECT sign(v) FROM {name}_c ORDER BY round(abs(v / (SELECT sqrt(sum(v * v)) FROM {name}_c)), 12) DESC, pos LIMIT 1) AS s FROM {name}_c)")
    steps.append(f"{name} AS MATERIALIZED (SELECT pos, v / n * s AS c FROM {name}_c, {name}_n)")
    return ", ".join(steps)


_TWO_SCORES = f"""WITH {_PARTS}, means AS MATERIALIZED (SELECT pos, avg(x) AS m FROM p GROUP BY pos),
cov AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, covar_samp(a.x, b.x) AS v FROM p a JOIN p b USING (vec_id) GROUP BY ALL),
{_leading("cov", "one")}, top AS (SELECT sum(x.c * v * y.c) AS l FROM cov JOIN one x ON x.pos = i JOIN one y ON y.pos = j),
rest AS MATERIALIZED (SELECT i, j, v - l * x.c * y.c AS v FROM cov JOIN one x ON x.pos = i JOIN one y ON y.pos = j, top),
{_leading("rest", "two")}
SELECT vec_id, label, round(pc1, 9) AS pc1, round(pc2, 9) AS pc2 FROM embeddings JOIN
  (SELECT vec_id, sum((x - m) * one.c) AS pc1, sum((x - m) * two.c) AS pc2 FROM p JOIN means USING (pos) JOIN one USING (pos) JOIN two USING (pos) GROUP BY vec_id) USING (vec_id)"""


@registered(_TWO_SCORES)
def pca_2d_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's scores on the first two components."""
    rows = load_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")
    scores = rows.select("vec_id", "label", pca.fit(rows, 2).scores(F.col("v")).alias("s"))
    return scores.select("vec_id", "label", F.round(F.col("s")[0], 9).alias("pc1"), F.round(F.col("s")[1], 9).alias("pc2"))


@registered(_TWO_SCORES.replace("round(pc1, 9)", "round(pc1, 6)").replace("round(pc2, 9)", "round(pc2, 6)"))
def pca_2d_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a covariance matrix, by random directions; as many as the vectors are wide, so exact."""
    rows = load_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")
    scores = fit_wide(rows, 2, more=62, rounds=2).project(rows, "vec_id")
    return rows.select("vec_id", "label").join(scores, "vec_id").select("vec_id", "label", F.round(F.col("scores")[0], 6).alias("pc1"), F.round(F.col("scores")[1], 6).alias("pc2"))


@registered("""SELECT conv_id, turn, n_messages, context_md5 FROM (SELECT conv_id, turn, role, count(*) OVER w AS n_messages,
  md5(string_agg(role || ':' || coalesce(text, ''), chr(10)) OVER w) AS context_md5 FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE role = 'user'""")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every request of a conversation sends: its messages so far, as a digest."""
    rows = conversation.contexts(load_table(spark, sf_dir, "conversations"))
    lines = F.transform("context", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["text"], F.lit(""))))
    return rows.select("conv_id", "turn", F.size("context").cast("bigint").alias("n_messages"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("context_md5"))


@registered("""SELECT conv_id, turn, n_messages, context_md5 FROM (SELECT conv_id, turn, role, count(*) OVER w AS n_messages,
  md5(string_agg(coalesce(text, ''), chr(10)) OVER w) AS context_md5 FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE role = 'user'""")
def conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same contexts from a stream that is started three times on one checkpoint, and gets messages in no order and some of them again."""
    log, folder = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), shared_dir(spark)
    third, store = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(3):
            log.where((third == i) | ((third < i) & (F.col("turn") % 3 == 0))).write.mode("append").parquet(f"{folder}/in")
            told = ordered_contexts(spark.readStream.schema(log.schema).parquet(f"{folder}/in"))
            told.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.parquet(f"{folder}/out").select("conv_id", "turn", "n_messages", F.md5(F.col("texts").cast("binary")).alias("context_md5"))


@registered("""SELECT conv_id, turn, role, text FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)
WHERE role <> 'user' OR after = 'assistant'""")
def conversation_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.answered_only(load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@registered("SELECT conv_id, count(*) AS messages, max(turn) + 1 AS next_turn FROM conversations GROUP BY conv_id")
def conversation_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.resume_points(load_table(spark, sf_dir, "conversations"))


@registered(f"""SELECT conv_id, turn, role, text FROM conversations UNION ALL
SELECT conv_id, min(turn) - 1, 'system', '{conversation.SYSTEM_PROMPT}' FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system')""")
def conversation_with_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.with_system(load_table(spark, sf_dir, "conversations"))


_EDITED = f"""edited AS (SELECT conv_id, turn, role, CASE WHEN role <> 'user' THEN text WHEN (conv_id + turn) % 5 = 0 THEN chr(32) || chr(9) || 'QuIt' || chr(10)
  WHEN (conv_id + turn) % 5 = 1 THEN chr(10) || chr(32) WHEN (conv_id + turn) % 5 = 2 THEN NULL ELSE text END AS text FROM conversations)"""
_BLANK = "chr(32) || chr(9) || chr(10) || chr(13)"


@registered(f"""WITH {_EDITED}, q AS (SELECT conv_id, min(turn) AS ends FROM edited WHERE role = 'user' AND lower(trim(text, {_BLANK})) = 'quit' GROUP BY conv_id)
SELECT c.conv_id, turn, role, text FROM edited c LEFT JOIN q ON q.conv_id = c.conv_id
WHERE (ends IS NULL OR turn < ends) AND (role <> 'user' OR length(trim(coalesce(text, ''), {_BLANK})) > 0)""")
def session_until_quit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which some user turns were made to say quit, blanks or nothing, as far as a session takes them."""
    log = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = (F.col("conv_id") + F.col("turn")) % 5
    said = F.when(case == 0, " \tQuIt\n").when(case == 1, "\n ").when(case == 2, F.lit(None)).otherwise(F.col("text"))
    return conversation.session_input(log.withColumn("text", F.when(F.col("role") != "user", F.col("text")).otherwise(said)))


@registered("SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'user' OR (conv_id + turn) % 3 <> 0")
def conversation_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after the requests of some turns have failed."""
    log = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    failed = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.lit("down"))
    return conversation.roll_back(log, log.where("role = 'user'").select("conv_id", "turn", failed.alias("error")))


@registered("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, coalesce(text, '') AS text FROM conversations")
def history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations saved as JSON, saved again over themselves, and loaded."""
    path = f"{shared_dir(spark)}/histories"
    save_histories(load_table(spark, sf_dir, "conversations"), path)
    save_histories(load_histories(spark, path), path)
    return load_histories(spark, path)


@registered("""SELECT 1 AS version, conv_id, turn, role, text FROM conversations WHERE turn < 3
UNION ALL SELECT 2, conv_id, turn, role, text FROM conversations""")
def history_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table of conversations, the second made of the first and the turns that it lacks; both are read at the end."""
    log, path = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), f"{shared_dir(spark)}/versions"
    first = save_version(log.where("turn < 3"), path)
    pinned = load_version(spark, path)
    second = save_version(pinned.union(log.where("turn >= 3")), path)
    return pinned.select(F.lit(first).alias("version"), "*").union(load_version(spark, path).select(F.lit(second), "*"))


@registered("SELECT doc_id AS id, source AS topic, coalesce(text, '') AS text FROM documents")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents saved as JSON and loaded; null texts are left out of the file."""
    path = f"{shared_dir(spark)}/documents"
    save(load_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), "text"), path, "json")
    return load_documents(spark, path, lines=True)


@registered("SELECT doc_id AS id, source AS topic, coalesce(text, '') AS text FROM documents")
def document_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents saved as JSON arrays and loaded from parts of their files."""
    path = f"{shared_dir(spark)}/arrays"
    save_array(load_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), "text"), path)
    return load_array(spark, path, part_bytes=1 << 20)


@registered(f"""WITH edited AS (SELECT doc_id, doc_id % 10 = 0 AS computed, CASE WHEN doc_id % 10 = 0 THEN coalesce(text, '') || ' edited' ELSE text END AS text FROM documents),
{_BAGS.replace("FROM documents", "FROM edited")}, norms AS (SELECT doc_id, sum(n * n)::BIGINT AS s, sum(n)::BIGINT AS t FROM bags GROUP BY doc_id)
SELECT doc_id, computed, round(coalesce(t / sqrt(s::DOUBLE), 0.0), 6) AS total FROM edited LEFT JOIN norms USING (doc_id)""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of all documents' vectors still has once every tenth text is edited, and the sums of the vectors it then gives."""
    docs, path = load_table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_dir(spark)}/cache"
    provider = HashEmbedding()
    cache.embeddings(docs, path, provider)
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" edited"))).otherwise(F.col("text")))
    new = materialize(cache.missing(edited, path, provider.mode).withColumn("computed", F.lit(True)))
    rows = cache.embeddings(edited, path, provider).join(new, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("computed", F.lit(False)).alias("computed"), F.round(total(F.col("embedding")), 6).alias("total"))


@registered("""SELECT conv_id, turn, '[' || n || '] ' || text AS reply, NULL::VARCHAR AS error FROM
  (SELECT *, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations) WHERE role = 'user'""")
def conversation_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply to every user turn, by the provider that needs no network."""
    return replies(conversation.contexts(load_table(spark, sf_dir, "conversations")), EchoChat())


@registered("""SELECT conv_id, turn, role, text FROM conversations UNION ALL
SELECT conv_id, max(turn) + 1, 'assistant', 'messages: ' || count(*) FROM conversations GROUP BY conv_id""")
def conversation_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with one more reply."""
    log = load_table(spark, sf_dir, "conversations")
    new = log.groupBy("conv_id").agg(F.concat(F.lit("messages: "), F.count("*").cast("string")).alias("text")).withColumn("role", F.lit("assistant"))
    return conversation.append(log, new)


@registered("SELECT source, count(*) AS n FROM documents GROUP BY source")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.distinct_values(load_table(spark, sf_dir, "documents"), "source")


@registered("""SELECT 'l_quantity' AS "column", min(l_quantity) + 0.0::DOUBLE AS low, max(l_quantity) + 0.0::DOUBLE AS high FROM lineitem UNION ALL
SELECT 'l_discount', min(l_discount) + 0.0::DOUBLE, max(l_discount) + 0.0::DOUBLE FROM lineitem""")
def column_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.ranges(load_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return rows.select("column", *((F.col(c) + F.lit(0.0)).alias(c) for c in ("low", "high")))  # no negative zero


@registered("SELECT vec_id, embedding[1]::DOUBLE AS value FROM embeddings WHERE label = 3")
def label_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component of the vectors with label 3."""
    rows = load_table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("v"))
    return tables.component(rows, F.col("label") == 3, "v", 0, keep=["vec_id"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_search_topk(spark, sf_dir)
