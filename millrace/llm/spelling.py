"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so it is the same for
every order of the letters.  Words that differ by one letter have keys that
differ by that letter's value, or by the difference of two: taking any one
letter's value from the longer word's key, or one from each of two equally long
ones, gives the same number.  Words meet on that number, and on one half of
their letters, which one edit leaves alone on one side or the other; the order
of the letters is verified last.  Nothing that all words share is a key, so no
group grows with the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import drop_since, mark, materialize

#: Runs of letters: Latin, with the block of Western European ones.
LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A letter's value is its code point, less this, to the fifth power.
POWER, BASE = 5, 64


def one_lost(every: int) -> Callable[[Column, Column], Column]:
    """An edit for ``word_counts``: where ``every`` divides the CRC-32 h of ``<id>:<run>``, the run's code point h % length is lost."""

    def edit(doc: Column, run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return edit


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, edit: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` of the words of so many code points that occur so often.

    Runs of letters are lower-cased from A to Z only; ``edit`` takes a
    document's id and a run to the word that counts.  Counts are summed before
    they are shuffled.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.col(id_col).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("word"))
    if edit is not None:
        # An edit loses one letter at most, so shorter runs are out before it is computed.
        runs = runs.where(F.length("word") >= min_length).select(edit(F.col("doc"), F.col("word")).alias("word"))
    return runs.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _value(letter: Column) -> Column:
    return F.pow((F.ascii(letter) - BASE).cast("double"), F.lit(float(POWER))).cast("bigint")


def anagram_key(word: Column) -> Column:
    """The sum of the letters' values."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda acc, x: acc + _value(x))


def meeting_keys(words: DataFrame) -> DataFrame:
    """``words(word, n)`` once for each number on which it can meet another: its own key, and its key less a letter's value.

    ``size`` is the number of letters that the number stands for; ``side`` and
    ``half`` are the first or last half of so many letters of the word.
    """
    keyed = words.select("word", "n", anagram_key(F.col("word")).alias("key"), F.length("word").alias("long"), F.array_distinct(F.split("word", "")).alias("letters"))
    less = F.transform("letters", lambda x: F.struct((F.col("key") - _value(x)).alias("key"), (F.col("long") - 1).alias("size"), F.lit(False).alias("own")))
    own = F.struct("key", F.col("long").alias("size"), F.lit(True).alias("own"))
    rows = keyed.select("word", "n", F.inline(F.array_append(less, own)))
    half = (F.col("size") / 2).cast("int")
    first, last = F.substring("word", F.lit(1), half), F.substring("word", F.length("word") - half + 1, half)
    sides = F.array(F.struct(F.lit("first").alias("side"), first.alias("half")), F.struct(F.lit("last").alias("side"), last.alias("half")))
    return rows.select("word", "n", "key", "size", "own", F.inline(sides))


def near_words(words: DataFrame) -> DataFrame:
    """``a``, ``b`` and their ``n_a``, ``n_b`` of all words of ``words(word, n)`` one inserted, deleted or replaced code point apart, a before b, each pair once.

    Words may have any letters and at least two of them; each has one row.
    """
    keys = meeting_keys(words)
    join = ("key", "size", "side", "half")
    a = keys.select(*join, F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("own_a"))
    b = keys.select(*join, F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("own").alias("own_b"))
    size = (F.col("l.size") / 2).cast("int")
    told_by_first = (F.col("l.side") == "last") & (F.substring("a", F.lit(1), size) == F.substring("b", F.lit(1), size))
    order = F.levenshtein("a", "b", 1) == 1
    both = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in join]
    met = a.alias("l").join(b.alias("r"), [*both, F.col("a") < F.col("b"), ~(F.col("own_a") & F.col("own_b")), ~told_by_first, order])
    return met.select("a", "b", "n_a", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for ``forms(word, form)``: forms followed to the last, by doubling."""
    point = mark()
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_since(point, after)
        if not after.where("moved").limit(1).count():
            return after.drop("moved")
        at = after


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of all of ``words(word, n)``.

    A word's form is its near word of largest n (ties: the smallest in order of
    code points) if that is at least ``ratio`` times the word's own; else null.
    ``root`` is where forms lead from the word, itself if it has none.  As a
    form is more frequent than its word there are no circles, and paths are
    short: their length goes with the logarithm of the largest count.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = materialize(words.select("word", "n"))
    pairs = materialize(near_words(words))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    told = words.join(best, "word", "left")
    much = -F.col("best.less") >= ratio * F.col("n")
    made = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(much, F.col("best.other")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")))
    roots = _roots(made.where(F.col("form").isNotNull()))
    return made.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, edit: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the words of all documents.

    Null and empty texts have no words, null ids count as empty ones, repeated
    rows count each time, texts are read whole however long they are, and other
    columns aren't read.  An empty table gives an empty result.
    """
    return variants(word_counts(docs, min_length, min_count, edit, id_col, text_col), ratio)


def spelling_sql(crc_table: str, crc: str, every: int, min_length: int = 6, min_count: int = 5, ratio: int = 5, table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The whole as SQL for DuckDB; ``crc`` is the CRC-32 of ``key`` by ``crc_table``."""
    return f"""
WITH RECURSIVE {crc_table},
d AS (SELECT row_number() OVER () AS row, coalesce({id_col}::VARCHAR, '') AS id, translate(coalesce({text_col}, ''), '{_UPPER}', '{_LOWER}') AS body FROM {table}),
r AS (SELECT row, id, unnest(regexp_extract_all(body, '[A-Za-zÀ-ÿ]+')) AS run FROM d),
g AS MATERIALIZED (SELECT id || ':' || run AS key, run, count(*) AS n FROM r WHERE len(run) >= {min_length} GROUP BY ALL),
h AS MATERIALIZED (SELECT run, n, {crc} AS h FROM g, crc),
e AS (SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE len(word) >= {min_length} GROUP BY word HAVING sum(n) >= {min_count}),
x AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS part FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS p FROM w)),
s AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.part = b.part AND a.p = b.p AND a.word <> b.word AND len(a.word) = len(b.word)
  UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.part = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.part = b.word),
k AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS place FROM s),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {ratio} * w.n THEN other END AS form, CASE WHEN m >= {ratio} * w.n THEN m END AS form_n
  FROM w LEFT JOIN k ON k.word = w.word AND place = 1),
path AS (SELECT word, word AS at FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.at AND f.form IS NOT NULL),
z AS (SELECT path.word, path.at AS root FROM path JOIN f ON f.word = path.at AND f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""
