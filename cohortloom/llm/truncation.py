"""Text cut off by field limits, from how often word sequences end a statement against how often they go on.

Statements of all texts are counted once each with their weight, so repeated texts cost one row. For every
position of a closed statement the last words are a context that either goes on or ends there. The last
context of each text is looked up: the longest one with enough support decides, and it is cut where the
context goes on often and almost never ends. A last word never seen after its predecessor is a fragment if
the words before it are followed by longer words that it begins. All of it is SQL over hashed contexts. Texts
are read twice, for the statements and for the last ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise

#: What ends a statement in running text, and in lists of short statements; a line end always does.
PROSE = (". ", "! ", "? ", ": ")
LISTED = (";", "|", ". ", "! ", "? ")
CLOSERS = "\"”)]"
STOP = r"[.!?][\"”)\]]*$"
#: Marks of omission and loose separators at the very end say nothing by themselves.
LOOSE = " ;|…\ufffd\\"

#: Context lengths in words; three is the trigram, longer ones tell apart statements that share their last words.
LENGTHS = (2, 3, 4, 5, 6, 8)
_LENS = f"array{LENGTHS}"
MIN_SUPPORT = 5
#: A context that ends in at most this share of its uses is almost never terminal.
MAX_TERMINAL = 0.02

_WEIGHTS = """
SELECT kind, s AS statement, count(*) AS n
FROM (SELECT kind, explode(IF(closed, parts, slice(parts, 1, greatest(size(parts) - 1, 0)))) AS s FROM {statements})
GROUP BY kind, s
"""

_CONTEXTS = """
SELECT kind, ctx, sum(IF(ends, 0, n)) AS inner_n, sum(IF(ends, n, 0)) AS term_n
FROM (
  SELECT kind, n, i = size(w) AS ends, explode(transform(filter(lens, l -> l <= i), l -> xxhash64(slice(w, i - l + 1, l)))) AS ctx
  FROM (SELECT kind, n, w, {lens} AS lens, explode(sequence(2, size(w))) AS i FROM {words} WHERE size(w) > 1)
)
GROUP BY kind, ctx
"""

_NEXT = """
SELECT kind, ctx, next, sum(n) AS n
FROM (
  SELECT kind, n, w[i - 1] AS next, explode(filter(array(IF(i > 2, xxhash64(slice(w, i - 2, 2)), xxhash64(slice(w, 1, 1)))), x -> x IS NOT NULL)) AS ctx
  FROM (SELECT kind, n, w, explode(sequence(2, size(w))) AS i FROM {words} WHERE size(w) > 1)
)
GROUP BY kind, ctx, next
"""

_LAST = """
SELECT kind, last, max_by(struct(inner_n, term_n), l) FILTER (WHERE inner_n + term_n >= :support) AS best,
       coalesce(sum(inner_n + term_n) FILTER (WHERE l = 2), 0) AS pair_n
FROM (
  SELECT f.kind, f.last, f.l, c.inner_n, c.term_n
  FROM (
    SELECT kind, last, l, xxhash64(slice(w, size(w) - l + 1, l)) AS ctx
    FROM (SELECT kind, last, w, explode(filter({lens}, x -> x <= size(w))) AS l FROM {finals})
  ) f LEFT JOIN {contexts} c ON f.kind = c.kind AND f.ctx = c.ctx
)
GROUP BY kind, last
"""

_UNSEEN = """
SELECT d.kind, d.last, element_at(w, -1) AS word, IF(size(w) > 2, xxhash64(slice(w, size(w) - 2, 2)), xxhash64(slice(w, 1, 1))) AS ctx
FROM {decided} d JOIN {finals} x ON d.kind = x.kind AND d.last = x.last
WHERE d.unseen
"""

# The words after a context are cut to all their beginnings, so that a fragment meets one row, however many words follow.
_FRAGMENTS = """
SELECT f.kind, f.last
FROM {unseen} f JOIN (
  SELECT kind, ctx, word, sum(n) AS n
  FROM (
    SELECT n.kind, n.ctx, n.n, explode(transform(sequence(1, length(n.next) - 1), i -> left(n.next, i))) AS word
    FROM {nexts} n LEFT SEMI JOIN {unseen} u ON n.kind = u.kind AND n.ctx = u.ctx
    WHERE length(n.next) > 1
  )
  GROUP BY kind, ctx, word
  HAVING sum(n) >= 2
) p ON f.kind = p.kind AND f.ctx = p.ctx AND f.word = p.word
"""


def statements(texts: DataFrame, separators: Sequence[str]) -> DataFrame:
    """``kind, record_id, source, parts, closed``: the statements of each text and whether the last is closed.

    Ends are cut with trims and literal replacements, as a regular expression over whole texts costs several times more.
    """
    body = F.rtrim(F.translate("text", "\t\r\u00a0", "   "), F.lit(LOOSE + "\n"))
    dots = F.rtrim(body, F.lit("."))
    body = F.rtrim(F.when(F.length(body) - F.length(dots) >= 3, dots).otherwise(body), F.lit(LOOSE + "\n"))
    parted = F.col("_body")
    for mark in separators:
        parted = F.replace(parted, F.lit(mark), F.lit(mark.strip(";|") + "\n"))
    named = texts.select("kind", "record_id", "source", body.alias("_body"))
    parts = F.filter(F.transform(F.split(parted, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    # a stop, with any number of closing marks behind it
    closed = F.right(F.rtrim(F.col("_body"), F.lit(CLOSERS)), F.lit(1)).isin(".", "!", "?")
    return named.select("kind", "record_id", "source", parts.alias("parts"), closed.alias("closed"))


def tokens(statement: Column) -> Column:
    """Words of a statement in lower case behind a start mark; digits are all one number, a full stop is dropped."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(statement)), STOP, ""), r"\d+", "0")
    return F.concat(F.array(F.lit("^")), F.filter(F.split(plain, r"[\s ]+"), lambda w: F.length(w) > 0))


def cut_statements(texts: DataFrame, separators: Sequence[str], min_support: int = MIN_SUPPORT, max_terminal: float = MAX_TERMINAL) -> tuple[DataFrame, DataFrame]:
    """``(records, cut)`` of ``texts(kind, record_id, source, text)``.

    ``records``: kind, record_id, source and the last statement of each text; null for null and blank texts,
    which are never cut. ``cut``: the distinct ``kind, last`` that break off. Contexts of different kinds are
    counted apart. Ties and repeated texts only add weight. An empty table gives two empty frames. The last
    statements and the counted ones are written once, as several later steps read them.
    """
    spark = texts.sparkSession
    split = statements(texts, separators)
    records = materialise(split.select("kind", "record_id", "source", F.try_element_at("parts", F.lit(-1)).alias("last")), "last")
    counted = spark.sql(_WEIGHTS, statements=split)
    words = materialise(counted.select("kind", "n", tokens(F.col("statement")).alias("w")).groupBy("kind", "w").agg(F.sum("n").alias("n")), "words")
    finals = records.where("last IS NOT NULL").select("kind", "last").distinct().withColumn("w", tokens(F.col("last"))).where("size(w) > 1")
    contexts = spark.sql(_CONTEXTS.replace("{lens}", _LENS), words=words)
    decided = spark.sql(_LAST.replace("{lens}", _LENS), {"support": min_support}, finals=finals, contexts=contexts)
    best = F.col("best")
    cut = best.isNotNull() & (best["term_n"] <= max_terminal * (best["term_n"] + best["inner_n"]))
    decided = materialise(decided.select("kind", "last", F.coalesce(cut, F.lit(False)).alias("cut"), (F.col("pair_n") == 0).alias("unseen")).where("cut OR unseen"), "decided")
    unseen = materialise(spark.sql(_UNSEEN, decided=decided, finals=finals), "unseen")
    fragments = spark.sql(_FRAGMENTS, unseen=unseen, nexts=spark.sql(_NEXT, words=words))
    return records, decided.where("cut").select("kind", "last").unionByName(fragments).distinct()


def cut_records(texts: DataFrame, separators: Sequence[str]) -> DataFrame:
    """``kind, record_id`` of every text that is cut off (see :func:`cut_statements`)."""
    records, cut = cut_statements(texts, separators)
    return records.join(cut, ["kind", "last"], "left_semi").select("kind", "record_id")


def cut_rates(texts: DataFrame, separators: Sequence[str]) -> DataFrame:
    """``field, source, texts, cut, share``: how often each source truncates, null sources as one group.

    Null and blank texts count as texts: the share is of all rows of a source.
    """
    records, cut = cut_statements(texts, separators)
    marked = records.join(cut.withColumn("broken", F.lit(1)), ["kind", "last"], "left")
    counted = marked.groupBy(F.col("kind").alias("field"), "source").agg(F.count(F.lit(1)).alias("texts"), F.count("broken").alias("cut"))
    return counted.withColumn("share", F.col("cut") / F.col("texts"))
