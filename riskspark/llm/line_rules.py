"""Quality rules: per-document base statistics plus cross-document line frequency.

Everything here is a composition of DataFrame functions (no Python workers).

Base statistics come from one projection over the text. Cross-document step:
normalised lines (ASCII lower case, white space squeezed) are hashed, the *distinct documents* per (host, line) are
counted, lines above a limit are removed, and a document that loses too large a
share of its words is rejected. A line above the absolute limit goes whatever the
host's size, so boilerplate of the largest host is caught; a line at or below it goes
if it is in a large share of the documents of a host that is large enough for a share
to mean something.

Defined cases: a null or empty text has no words, no lines and fails the base
rule. A null host is a host of its own. Exact copies of a text within a host are
one document for the counts (they cannot make their own lines frequent), and
every repeated row gets its own result row. Columns beyond the named ones are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import stored

# ASCII white space, the symbols counted, A-Z for case folding.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
LINE_MIN_DOCS = 20      # a line in more distinct documents of a host is removed, however large the host
LINE_HOST_PCT = 5       # so is one in more than this share of the host's documents,
SHARE_MIN_DOCS = 10     # from this many of them on,
SHARE_HOST_DOCS = 100   # in hosts of at least this many
MIN_LEFT_PCT = 50       # a document keeps at least this share of its words, else it is rejected


# Positions of the windows whose hash equals the one before or after it in the
# sorted array ``wins`` of (h, p), in ascending order.
REPEATED_STARTS = """
sort_array(transform(filter(
  zip_with(
    zip_with(wins, slice(wins, 2, greatest(size(wins) - 1, 0)),
             (a, b) -> struct(a.h AS h, a.p AS p, coalesce(a.h = b.h, false) AS nxt)),
    concat(array(null), slice(wins, 1, greatest(size(wins) - 1, 0))),
    (a, b) -> struct(a.p AS p, a.nxt OR coalesce(a.h = b.h, false) AS dup)),
  x -> x.dup), x -> x.p))"""


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def normal_line(line: Column) -> Column:
    """Runs of white space as one space, trimmed (case is folded in the text)."""
    return F.trim(F.regexp_replace(line, SPACE_RUN, " "))


def has_word(line: Column) -> Column:
    return F.length(F.translate(line, SPACE, "")) > 0


def base_stats(df: DataFrame) -> DataFrame:
    """``doc_id, host, text`` -> base columns plus a content hash ``k``.

    Repeated 3-word windows: most texts have none, which a distinct count of window
    hashes shows. In the others the windows are sorted with their position, a window
    equal to a neighbour in that order repeats, and the words under repeated windows
    are the union of ``[p, p + 2]``, added up over the sorted starts."""
    d = df.withColumn("words", words_of(F.col("text")))
    d = d.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
    d = d.withColumn("win", F.expr(
        "CASE WHEN size(hashes) >= 3 THEN transform(sequence(0, size(hashes) - 3), "
        "i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2])) ELSE cast(array() AS array<bigint>) END"))
    d = d.withColumn("wins", F.expr(
        "CASE WHEN size(array_distinct(win)) < size(win) THEN sort_array(transform(win, (h, i) -> struct(h, i AS p))) END"))
    d = d.withColumn("starts", F.expr(f"CASE WHEN wins IS NOT NULL THEN {REPEATED_STARTS} END"))
    covered = F.expr(
        "aggregate(starts, named_struct('last', -3, 'n', 0L), "
        "(a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)")
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), has_word))
    return d.select(
        "doc_id", "host", F.xxhash64("text").alias("k"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def document_lines(df: DataFrame) -> DataFrame:
    """One row per distinct document of a host: ``host, k`` and, for every line with a
    word, its hash (with the host's name) and its number of words."""
    low = F.translate(F.col("text"), UPPER, UPPER.lower())
    d = df.select("host", F.xxhash64("text").alias("k"),
                  F.transform(F.filter(F.split(low, "\n"), has_word), normal_line).alias("norms"))
    return d.select("host", "k", F.transform("norms", lambda x: F.struct(
        F.xxhash64("host", x).alias("line"),
        (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w"))).alias("lines")).dropDuplicates(["host", "k"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT,
                  line_min_docs: int = LINE_MIN_DOCS, line_host_pct: int = LINE_HOST_PCT,
                  min_left_pct: int = MIN_LEFT_PCT, share_min_docs: int = SHARE_MIN_DOCS,
                  share_host_docs: int = SHARE_HOST_DOCS) -> DataFrame:
    """Base statistics and the verdict for every row of ``docs``."""
    d = docs.select(docs[id_col].alias("doc_id"), docs[host_col].cast("string").alias("host"),
                    docs[text_col].cast("string").alias("text"))
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    # compact rows (a few hashes per document), read by three steps: a written table
    lines = stored(document_lines(d), "document-lines")
    # a line that a third of all documents share is counted map-side first
    frequent = (lines.select(F.explode(F.array_distinct("lines.line")).alias("line"))
                .groupBy("line").agg(F.count("*").alias("n_docs")).where((F.col("n_docs") > line_min_docs) | (F.col("n_docs") >= share_min_docs)))
    host_docs = lines.groupBy("host").agg(F.count("*").alias("host_docs")).withColumnRenamed("host", "h")
    lost = (lines.select("host", "k", F.explode("lines").alias("l")).select("host", "k", "l.line", "l.w")
            .join(frequent, "line").join(host_docs, F.col("host").eqNullSafe(F.col("h")))
            .where((F.col("n_docs") > line_min_docs) | ((F.col("n_docs") >= share_min_docs) & (F.col("host_docs") >= share_host_docs)
                                                        & (F.col("n_docs") * 100 > F.col("host_docs") * line_host_pct)))
            .groupBy(F.col("host").alias("lost_host"), F.col("k").alias("lost_k")).agg(F.sum("w").alias("lost")))
    out = base_stats(d).join(lost, F.col("host").eqNullSafe(F.col("lost_host")) & (F.col("k") == F.col("lost_k")), "left")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"),
                      (~failed & (left * 100 >= F.col("n_words") * min_left_pct)).alias("kept"),
                      F.coalesce("lost", F.lit(0)).cast("long").alias("removed_words"))
