"""Quality rules, in DataFrame functions only: counts of each text, and how many documents of a host share each line.

A line's key is a hash of its words, lower-cased and joined by one space. A key's count is the number of different texts of
the host (column source) that have it, so exact copies of a document don't condemn each other. Keys above the host's limit
are removed; a document of whose characters in lines too few remain is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.llm.common import Scratch, small

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: A key may be in so many texts of a host, or in this share of them, whichever is more.
LINE_DOCS, LINE_SHARE = 10, 0.02
#: Share of a document's characters in lines that must remain.
REMAIN = 0.5


def repeated_words(words: str, hash_bits: int = 64) -> tuple[Column, Column]:
    """Expressions that count the words in 3-word windows found twice or more, over an array column.

    The first makes sorted 64-bit words of as much of a window's hash as there is room for and, in the low bits, its place.
    The second, over a column `_wins` of them, compares neighbours by their words and adds up the places that the found
    windows cover. Where neighbours of one hash differ in their words, other equal windows may lie between them: then the
    windows are sorted by hash and words instead, so that equal ones are neighbours whatever the hashes are.
    hash_bits: a narrower hash, for tests.
    """
    n = f"size({words})"
    bits = f"case when {n} <= 131072 then 17 when {n} <= 16777216 then 24 else 31 end"
    mask = f"(shiftleft(1L, {bits}) - 1)"
    full = f"(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) & {(1 << hash_bits) - 1 if hash_bits < 64 else -1}L)"
    wins = F.expr(f"if({n} < 3, array(), sort_array(transform(sequence(0, {n} - 3), i -> shiftleft({full}, {bits}) | cast(i as bigint))))")

    def alike(a: str, b: str) -> str:
        return f"(shiftright({a}, {bits}) = shiftright({b}, {bits}))"

    def same(a: str, b: str) -> str:
        at = [f"{words}[cast(({x}) & {mask} as int) + {j}]" for j in range(3) for x in (a, b)]
        return f"({at[0]} = {at[1]} and {at[2]} = {at[3]} and {at[4]} = {at[5]})"

    mixed = f"size(filter(_wins, (x, k) -> k > 0 and {alike('x', '_wins[k - 1]')} and not {same('x', '_wins[k - 1]')})) > 0"
    before, after = (f"{alike('x', o)} and {same('x', o)}" for o in ("_wins[k - 1]", "_wins[k + 1]"))
    found = f"transform(filter(_wins, (x, k) -> (k > 0 and {before}) or (k < size(_wins) - 1 and {after})), x -> cast(x & {mask} as int))"
    whole = f"sort_array(transform(sequence(0, {n} - 3), i -> struct({full} as h, {words}[i] as a, {words}[i + 1] as b, {words}[i + 2] as c, i as i)))"
    equal = lambda o: f"(x.h = {o}.h and x.a = {o}.a and x.b = {o}.b and x.c = {o}.c)"
    exact = f"transform(array({whole}), s -> transform(filter(s, (x, k) -> (k > 0 and {equal('s[k - 1]')}) or (k < size(s) - 1 and {equal('s[k + 1]')})), x -> x.i))[0]"
    places = f"sort_array(if({mixed}, {exact}, {found}))"
    return wins, F.expr(f"aggregate({places}, struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)")


def text_counts(docs: DataFrame, keep: list[str], hash_bits: int = 64) -> DataFrame:
    """Base counts of every whole text (null: empty), the columns of keep, and `lines`: key and characters of each line with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(*keep, text.alias("_t")).withColumn("_pieces", F.split("_t", SPACE))
    held = held.withColumn("_words", F.array_remove("_pieces", ""))
    wins, repeats = repeated_words("_words", hash_bits)
    held = held.withColumn("_wins", wins)
    held = held.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    norm = lambda x: F.lower(F.trim(F.regexp_replace(x, SPACE + "+", " ")))
    long = lambda c: c.cast("long")
    return held.select(
        *keep,
        F.xxhash64("_t", F.length("_t")).alias("_text"),
        long(F.size("_words")).alias("n_words"),
        long(F.length("_t") - F.size("_pieces") + 1).alias("word_chars"),
        long(F.regexp_count("_t", F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(F.xxhash64(norm(x)).alias("key"), F.length(x).alias("chars"))).alias("_line_keys"),
    )


def quality_rules(docs: DataFrame, scratch: Scratch, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, remain: float = REMAIN) -> DataFrame:
    """doc_id, source, the base counts, base_failed, line_chars, removed_chars and kept for every row of docs(doc_id, text, source).

    Null texts and texts of white space have no words and fail the base rule. A null source is a host of its own. Rows that
    repeat an id get a row each; equal texts of a host count once in its line counts. Other columns of docs are ignored.
    """
    host = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    base = scratch.write(text_counts(docs.select("doc_id", "source", "text", host.alias("_host")), ["doc_id", "source", "_host"]))
    # One row for each different text of a host: everything about lines depends on these alone.
    texts = base.groupBy("_host", "_text").agg(F.first("_line_keys").alias("_line_keys"))
    lines = scratch.write(texts.select("_host", "_text", F.explode("_line_keys").alias("line")).select("_host", "_text", "line.*"))
    hosts = base.groupBy("_host", "_text").agg(F.lit(1).alias("one")).groupBy("_host").agg(F.count("*").alias("texts"))
    counts = lines.groupBy("_host", "key", "_text").agg(F.lit(1).alias("one")).groupBy("_host", "key").agg(F.count("*").alias("docs")).where(F.col("docs") > line_docs)
    hot = scratch.write(counts.join(hosts, "_host").where(F.col("docs") > F.col("texts") * line_share).select("_host", "key"))
    removed = lines.join(small(hot), ["_host", "key"]).groupBy("_host", "_text").agg(F.sum("chars").alias("removed_chars"))
    removed = scratch.write(removed)
    chars = F.aggregate("_line_keys", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    out = base.join(small(removed), ["_host", "_text"], "left").withColumns({"line_chars": chars, "removed_chars": F.coalesce("removed_chars", F.lit(0).cast("long"))})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("line_chars") - F.col("removed_chars") < F.lit(remain) * F.col("line_chars")
    out = out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})
    return out.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "removed_chars", "base_failed", "kept")


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules over all documents, with the limits above."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality_rules(docs, Scratch(spark, "rules"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
tri AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
ln AS (
  SELECT rid, source, text, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS key, length(line) AS chars
  FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n, sum(chars) AS chars FROM ln GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
hot AS (
  SELECT l.source, l.key FROM (SELECT source, key, count(DISTINCT text) AS docs FROM ln GROUP BY ALL) l
  JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE docs > {LINE_DOCS} AND docs > texts * {LINE_SHARE}),
gone AS (
  SELECT rid, sum(chars) AS chars FROM ln JOIN hot ON ln.source IS NOT DISTINCT FROM hot.source AND ln.key = hot.key GROUP BY rid),
f AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(dl.chars, 0) AS line_chars, coalesce(gone.chars, 0) AS removed
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (line_chars - removed < {REMAIN} * line_chars) AS kept
FROM f
"""
