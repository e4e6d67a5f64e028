"""Line dedup across documents: hashes dealt by range, sorted by document and position, with DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. A key that several documents
hold keeps its lines in the document with the smallest id, and loses them in all others.

1. ``line_hashes``: one narrow row per line that is long enough: 128 hash bits, document, position. No text leaves its task.
2. ``repeats``: the hashes are range-partitioned, and each range is sorted by hash, document and position. A window
   streams over it; the first row of a hash names the document that keeps it, and later documents' rows are repeats.
3. Hashes with more than a ``MOST_HOT``-th of all lines (so at most ``MOST_HOT``) would make one range too long. Their
   first documents come from an aggregate that each task reduces before it is shuffled, and are sent to all tasks.
4. ``keep_bitmaps``: repeats become one bitmap per document, 64 lines in a word; words that keep all lines are left out.
5. ``without_repeats`` joins the bitmaps to the texts: the one shuffle of texts, the same at every size.

Defined results: a null or empty text is one empty line; keys of fewer than ``LEAST`` code points stay. Rows with one id are
one document: what only they hold stays in all of them. Rows without id are one document behind all others.
Rows that repeat get the same bitmap. An empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hubwright.llm.common import free_name, hex_digest, or_empty, table
from hubwright.session import stage_table

WHITE = " \t\n\x0b\x0c\r"
#: Code points of a key that is compared.
LEAST = 10
#: Hashes with more than so many lines and more than the MOST_HOT-th of all are found without ranges.
LEAST_HOT, MOST_HOT = 1 << 12, 1 << 10
WORD = 64


def lines_of(text: str | Column) -> Column:
    return F.split(or_empty(text), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """no_id, doc_id, text_hash, pos, h1, h2: one row per line that is compared. ``doc_id`` and ``text_hash`` find its row again."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(or_empty(text)).alias("text_hash"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keys.select(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def repeats(lines: DataFrame, least_hot: int = LEAST_HOT, most_hot: int = MOST_HOT) -> DataFrame:
    """doc_id, text_hash and pos of every line whose key a document with a smaller id holds too. ``lines``: written before."""
    total = lines.count()
    often = lines.groupBy("h1", "h2").count().where(F.col("count") > max(least_hot, total // most_hot))
    document = F.struct("no_id", "doc_id")
    # at most most_hot rows, since each stands for more than that part of all lines
    often = F.broadcast(stage_table(often.select("h1", "h2")))
    hot = lines.join(often, ["h1", "h2"])
    first = F.broadcast(stage_table(hot.groupBy("h1", "h2").agg(F.min(document).alias("first"))))
    marked_hot = lines.join(first, ["h1", "h2"])

    ranged = lines.join(often, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "no_id", "doc_id", "pos")
    one_hash = Window.partitionBy("h1", "h2").orderBy("no_id", "doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = ranged.withColumn("first", F.first(document).over(one_hash)).unionByName(marked_hot)
    return marked.where(document != F.col("first")).select("doc_id", "text_hash", "pos")


def keep_bitmaps(repeated: DataFrame) -> DataFrame:
    """doc_id, text_hash and keep: words (word, bits) by number, bit i of word w for line 64 w + i; words of ones alone are left out."""
    word, bit = F.floor(F.col("pos") / WORD).cast("int"), F.expr(f"shiftleft(1L, pos % {WORD})")
    words = repeated.groupBy("doc_id", "text_hash", word.alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def unpacked(keep: str) -> Column:
    """All words up to the last one that drops a line."""
    gap = f"if(i = 0, w.word, w.word - {keep}[i - 1].word - 1)"
    return F.expr(f"flatten(transform({keep}, (w, i) -> concat(array_repeat(-1L, {gap}), array(w.bits))))")


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The keep bitmaps of all documents that lose a line."""
    return keep_bitmaps(repeats(stage_table(line_hashes(docs, doc_id, text, least))))


def without_repeats(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: str = "kept_lines") -> DataFrame:
    """``docs`` and the array of each text's lines that stay."""
    own, keep = free_name("text_hash", [*docs.columns, kept]), free_name("keep", [*docs.columns, kept])
    side = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), unpacked("keep").alias(keep))
    marked = docs.withColumn(own, F.xxhash64(or_empty(text)))
    # by sorting at every size: whether the bitmaps could be broadcast must not decide how a large corpus is read
    found = marked.join(side.hint("merge"), marked[doc_id].eqNullSafe(side["_id"]) & (marked[own] == side["_hash"]), "left")
    stays = F.filter(
        lines_of(text),
        lambda line, i: F.coalesce(F.get(F.col(f"`{keep}`"), F.floor(i / WORD).cast("int")), F.lit(-1)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % WORD)) != 0,
    )
    return found.select(*[marked[f"`{c}`"] for c in docs.columns], stays.alias(kept))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with each text cut to the lines that stay; null texts stay null."""
    kept = free_name("kept_lines", docs.columns)
    done = without_repeats(docs, find_repeats(docs, doc_id, text, least), doc_id, text, kept)
    return done.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(kept, "\n"))).drop(kept)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its lines, how many of them went, and the digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = without_repeats(docs, find_repeats(docs)).select("doc_id", F.size(lines_of("text")).cast("long").alias("n_lines"), "kept_lines")
    return done.select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("kept_lines")).alias("n_dropped"), hex_digest(F.array_join("kept_lines", "\n")).alias("kept_sha256")
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), g AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (g.first IS NOT NULL AND g.first <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (g.first IS NULL OR g.first = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN g USING (key) GROUP BY k.doc_id
"""
