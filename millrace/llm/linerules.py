"""Quality rules, line by line first.

Punctuation, navigation and boilerplate rules judge every line; lines that fail
one are removed, and a document that loses too much of its text is rejected.
Before that a document can fail as a whole: by too few words, or by too many
words in repeated windows.  All of it is DataFrame functions within a row, so
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import fresh

#: What stands between words, as characters and in a regular expression's class.
SPACE, SPACE_CLASS = " \t\n\x0b\x0c\r", r"\x20\x09-\x0D"
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# The regular expressions mean the same to Spark and to DuckDB.
#: A sentence ends somewhere in the line.
SENTENCE_END = "[.!?…。！？][\"')\\]»”’]*([\\x20\\x09-\\x0D]|$)"
#: One word that carries two or more symbols or marks of shouting.
NOISE = "[!?][!?]|[#*$%&|<>~^=_+@][#*$%&|<>~^=_+@]"
NOISY_WORD = rf"({NOISE})[^{SPACE_CLASS}]*"
#: What stands between the entries of a menu, a path of pages or a table; and a part of each.
SEPARATOR = r"(^|[\x20\x09])([|>»›•·/]|-&gt;|::|>>)([\x20\x09]|$)"
SEPARATORS = "[|>»›•·/]|-&gt;|::"
# Phrases of site furniture, lower-cased.
BOILERPLATE = [
    "all rights reserved", "privacy policy", "cookie policy", "terms of use", "terms of service", "terms and conditions",
    "uses cookies", "use cookies", "accept cookies", "accept all cookies", "enable javascript", "javascript is disabled", "requires javascript",
    "sign up for our", "subscribe to our", "subscribe now", "log in to", "sign in to", "create an account", "forgot your password",
    "click here", "read more", "continue reading", "share on facebook", "share on twitter", "share this", "follow us on", "back to top",
    "skip to content", "skip to main content", "skip navigation", "add to cart", "lorem ipsum", "powered by wordpress", "leave a comment", "leave a reply",
]
_FIRST = sorted({p[0] for p in BOILERPLATE})
PHRASES = "(" + "|".join(f"{c}({'|'.join(p[1:] for p in BOILERPLATE if p[0] == c)})" for c in _FIRST) + ")"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words_of(text: Column) -> Column:
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(f"[^{SPACE_CLASS}]+"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once for the row, however often it is used in lambdas."""
    return F.transform(F.array(value), then)[0]


def unended(line: Column) -> Column:
    """No sentence ends in the line."""
    return ~line.rlike(SENTENCE_END)


def marks(line: Column) -> Column:
    """A third of the line's words or more carry strings of marks."""
    return 3 * F.regexp_count(line, F.lit(NOISY_WORD)) >= _n_words(line)


def navigation(line: Column) -> Column:
    """The line has three separators or more, and one for every five words or more."""
    return _let(F.regexp_count(line, F.lit(SEPARATOR)), lambda n: (n >= 3) & (5 * n >= _n_words(line)))


def boilerplate(line: Column) -> Column:
    """The line has a phrase of site furniture, in any case of A to Z, and at most thirty words for each such phrase."""
    return _let(F.regexp_count(_lower(line), F.lit(PHRASES)), lambda n: (n > 0) & (_n_words(line) <= 30 * n))


@dataclass(frozen=True)
class Rule:
    """Whether a line that has a word fails; ``may`` is true of every text in which a line can, and spares the others' lines."""

    fails: Callable[[Column], Column]
    may: Callable[[Column], Column] | None = None


#: Rules by name, in the order in which a line's failure is told.
RULES: Mapping[str, Rule] = {
    "boilerplate": Rule(boilerplate, lambda text: F.lower(text).rlike(PHRASES)),
    "navigation": Rule(navigation, lambda text: text.rlike(SEPARATORS)),
    "marks": Rule(marks, lambda text: text.rlike(NOISE)),
    "unended": Rule(unended),
}


@dataclass(frozen=True)
class Limits:
    """When a document fails as a whole: its words, percent of words in repeated windows, words of a window, percent of its text that may go."""

    least_words: int = 20
    most_repeated: int = 30
    window: int = 8
    most_lost: int = 50


def _joined(hashes: Column, width: int) -> Column:
    """Each hash together with that ``width`` places on."""
    return _let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + width))))


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words lie in windows of so many words that are found twice or more in an array, the first one included.

    Windows are compared by two 64-bit hashes of their words, each made of those
    of its halves; arrays in which no first hash is repeated, which is most of
    them, are done after that.  ``window`` is a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    starts = F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window)).otherwise(F.array().cast("array<int>"))

    def hashes(seed: int) -> Column:
        made, width = F.transform(words, lambda w: F.xxhash64(F.lit(seed), w)), 1
        while width < window:
            made, width = _joined(made, width), 2 * width
        return F.slice(made, 1, F.greatest(F.size(words) - (window - 1), F.lit(0)))

    def covered(places: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct((i + window).alias("end"), (acc["n"] + i + window - F.greatest(acc["end"], i)).alias("n"))
        return F.aggregate(places, begin, step, lambda acc: acc["n"])

    def twice(first: Column) -> Column:
        rows = F.sort_array(F.zip_with(first, F.zip_with(hashes(1), starts, lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i"))), lambda h, x: F.struct(h.alias("h"), x["g"].alias("g"), x["i"].alias("i"))))
        same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))
        place = lambda s: F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"]))
        return covered(F.sort_array(F.filter(_let(rows, place), lambda i: i.isNotNull())))

    return _let(hashes(0), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), twice(h)).otherwise(F.lit(0).cast("long")))


def line_rules(docs: DataFrame, rules: Mapping[str, Rule] = RULES, limits: Limits = Limits(), text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with what the rules find, as columns whose names begin with ``prefix``.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word, equal to one before), ``n_repeat_words``,
    ``base_failed``, ``n_lines`` (with a word), ``n_lines_removed``,
    ``lost_chars`` (code points in words of removed lines), ``failures`` (how
    many lines each rule removed, by name), ``clean_text`` (the other lines) and
    ``kept``.  A document that passed the base and lost at most ``most_lost``
    percent of its words' characters is kept.

    Null texts have no words and are not kept; so are empty ones.  Lines
    without a word are left as they are and count for nothing.  Texts are judged
    whole however long they are, each in its row.  Repeated rows stay repeated,
    columns of ``docs`` that have the names of results are replaced, an empty
    table gives an empty result.
    """
    text, words, lines, judged = (fresh(docs, c) for c in ("text", "words", "lines", "judged"))
    own = lambda c: f"{prefix}{c}"
    made = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_lines n_lines_removed lost_chars failures clean_text kept".split()
    chars = lambda x: F.length(F.array_join(x, "")).cast("long")

    def failed(line: Column, may: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for name, rule in reversed(list(rules.items())):
            fails = rule.fails(line) if rule.may is None else may[name] & rule.fails(line)
            verdict = F.when(fails, F.lit(name)).otherwise(verdict)
        return verdict

    def told(may: Column) -> Column:
        one = lambda line: _let(F.btrim(line, F.lit(SPACE)) != "", lambda full: F.struct(line.alias("line"), full.alias("full"), F.when(full, failed(line, may)).alias("failed")))
        return F.transform(lines, one)

    may = F.struct(F.lit(True).alias(""), *(r.may(F.col(text)).alias(name) for name, r in rules.items() if r.may))
    whole = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).drop(*(own(c) for c in made))
    cut = whole.withColumns({words: _words_of(F.col(text)), lines: F.split(text, "\n")})
    sized = cut.withColumns({own("n_words"): F.size(words).cast("long"), own("word_chars"): chars(F.col(words)), own("n_symbols"): F.regexp_count(F.col(text), F.lit(f"[{SYMBOLS}]")).cast("long")})
    counted = sized.withColumns({own("n_repeat_words"): repeated_words(F.col(words), limits.window), judged: _let(may, told)})
    full, gone = F.filter(judged, lambda x: x["full"]), F.filter(judged, lambda x: x["failed"].isNotNull())
    by_rule = lambda name: F.size(F.filter(judged, lambda x: x["failed"] == F.lit(name))).cast("long")
    failures = F.create_map(*(x for name in rules for x in (F.lit(name), by_rule(name))))
    out = counted.withColumns({
        own("n_dup_lines"): (F.size(full) - F.size(F.array_distinct(F.transform(full, lambda x: x["line"])))).cast("long"),
        own("base_failed"): (F.col(own("n_words")) < limits.least_words) | (100 * F.col(own("n_repeat_words")) > limits.most_repeated * F.col(own("n_words"))),
        own("n_lines"): F.size(full).cast("long"),
        own("n_lines_removed"): F.size(gone).cast("long"),
        own("lost_chars"): F.aggregate(gone, F.lit(0).cast("long"), lambda acc, x: acc + chars(_words_of(x["line"]))),
        own("failures"): failures,
        own("clean_text"): F.array_join(F.transform(F.filter(judged, lambda x: x["failed"].isNull()), lambda x: x["line"]), "\n"),
    })
    keep = ~F.col(own("base_failed")) & (100 * F.col(own("lost_chars")) <= limits.most_lost * F.col(own("word_chars")))
    return out.withColumn(own("kept"), keep).drop(text, words, lines, judged)


def cleaned(docs: DataFrame, rules: Mapping[str, Rule] = RULES, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the columns of ``docs``; ``text_col`` has the lines that passed."""
    prefix = fresh(docs, "rule")
    made = line_rules(docs, rules, limits, text_col, prefix)
    return made.where(F.col(f"{prefix}kept")).select(*(F.col(f"{prefix}clean_text").alias(c) if c == text_col else F.col(c) for c in docs.columns))


def line_rules_sql(limits: Limits = Limits(), table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The counts and the verdict as SQL for DuckDB."""

    def q(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    words = f"[^{SPACE_CLASS}]+"
    n = lambda pattern, text="line": f"len(regexp_extract_all({text}, {q(pattern)}))"
    told = n(PHRASES, "low")
    return f"""
WITH a AS (SELECT row_number() OVER () AS row, {id_col}, coalesce({text_col}, '') AS body FROM {table}),
b AS MATERIALIZED (SELECT row, {id_col}, body, regexp_extract_all(body, {q(words)}) AS words FROM a),
s AS (SELECT row, unnest(range(0, greatest(len(words) - {limits.window - 1}, 0))) AS i FROM b),
w AS MATERIALIZED (SELECT row, i, array_to_string(words[i + 1:i + {limits.window}], ' ') AS part FROM s JOIN b USING (row)),
t AS (SELECT row, part FROM w GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + {limits.window})) AS p FROM w SEMI JOIN t USING (row, part)) GROUP BY row),
l AS (SELECT row, unnest(string_split(body, chr(10))) AS line FROM b),
j AS MATERIALIZED (SELECT row, line, len(regexp_replace(line, '[{SPACE_CLASS}]+', '', 'g')) AS chars, len(regexp_extract_all(line, {q(words)})) AS n, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM l WHERE regexp_matches(line, {q(words)})),
f AS (SELECT row, line, chars, {told} > 0 AND n <= 30 * {told} OR {n(SEPARATOR)} >= 3 AND 5 * {n(SEPARATOR)} >= n
  OR NOT regexp_matches(line, {q(SENTENCE_END)}) OR 3 * {n(NOISY_WORD)} >= n AS failed FROM j),
g AS (SELECT row, count(*) - count(DISTINCT line) AS dups, count(*) AS lines, count(*) FILTER (failed) AS removed, coalesce(sum(chars) FILTER (failed), 0)::BIGINT AS lost FROM f GROUP BY row),
o AS (SELECT {id_col}, len(words)::BIGINT AS n_words, len(regexp_replace(body, '[{SPACE_CLASS}]+', '', 'g'))::BIGINT AS word_chars,
  (len(body) - len(regexp_replace(body, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lines, 0)::BIGINT AS n_lines, coalesce(removed, 0)::BIGINT AS n_lines_removed, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM b LEFT JOIN g USING (row) LEFT JOIN r USING (row)),
v AS (SELECT *, n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.most_repeated} * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND 100 * lost_chars <= {limits.most_lost} * word_chars AS kept FROM v
"""
