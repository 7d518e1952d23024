"""Quality rules from the frequency of lines across documents, in DataFrame functions alone.

A line is normalised (lower case, runs of digits as 0, white space as one space) and hashed with its host, the document's
source. The documents that hold it are counted for each host, where documents of one and the same text are one document, so exact copies do not make
a line frequent. A line with a word in more documents of a host than the host's limit is removed wherever it stands in that host; the limit is one in `LIMIT_ONE_IN` of the
host's documents, `LEAST_LIMIT` at least and `MOST_LIMIT` at most, so that in a hot host too a line of some hundred documents is boilerplate. A document that keeps less than
`LEAST_LEFT` percent of its words is depleted and rejected, as are documents that fail the base rules.

Null or empty text: no words, fails the base rules. Null source: a host of its own. Repeated rows: one row out for each; rows of one text in two hosts are
judged each by its own host. Empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.base import SPACE, table, written

WINDOW = 8
LEAST_LIMIT = 10
MOST_LIMIT = 200
LIMIT_ONE_IN = 100
LEAST_LEFT = 30
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
A_WORD = "[^\\x20\\x09-\\x0D]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def n_repeated(hashes: Column) -> Column:
    """The number of words in windows whose hash occurs twice or more: sorts (hash, place), keeps the places of equal neighbours, and adds what each window covers anew."""
    n = F.size(hashes)
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.zip_with(ordered, F.concat(none, F.slice(ordered, 1, n - 1)), lambda a, b: F.struct(a.alias("a"), (a["h"] == b["h"]).alias("same")))
    both = F.zip_with(before, F.concat(F.slice(ordered, 2, n - 1), none), lambda x, c: F.when(F.coalesce(x["same"], F.lit(False)) | F.coalesce(x["a"]["h"] == c["h"], F.lit(False)), x["a"]["i"]))
    places = F.sort_array(F.filter(both, lambda p: p.isNotNull()))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("covered"))
    return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["covered"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("covered")), lambda acc: acc["covered"])


def row_key(text: Column) -> Column:
    """Of rows with the same id, host and text."""
    return F.xxhash64(F.col("doc_id"), F.col("source"), F.col("source").isNull(), text)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.col("text")
    rows = docs.select("doc_id", "source", F.coalesce(text, F.lit("")).alias("text")).withColumns({"row_key": row_key(text), "words": words_of(text)})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(A_WORD))
    n = F.size("words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id",
        "row_key",
        n.cast("long").alias("n_words"),
        F.char_length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        hashes.alias("hashes"),
    )
    rows = rows.select(
        *rows.columns[:-2],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), n_repeated(F.col("hashes"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def lines_of(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: row_key, place, host, content, line (the hash of host and normalised line), n."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(row_key(text).alias("row_key"), F.xxhash64("source").alias("host"), F.xxhash64(text).alias("content"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    rows = rows.withColumn("n", F.size(words_of(F.col("line")))).where("n > 0")
    normal = F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), SPACE, " "), "[0-9]+", "0"))
    return rows.select("row_key", "place", "host", "content", F.xxhash64("host", normal).alias("line"), "n")


def removed_words(docs: DataFrame) -> DataFrame:
    """row_key, n_removed: the words in lines above their host's limit."""
    lines = written(lines_of(docs), "lines")
    contents = docs.select(F.xxhash64("source").alias("host"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("content")).distinct()
    limits = contents.groupBy("host").agg(F.greatest(F.lit(LEAST_LIMIT), F.least(F.lit(MOST_LIMIT), F.floor(F.count(F.lit(1)) / LIMIT_ONE_IN))).alias("most"))
    texts = lines.select("host", "line", "content").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") > LEAST_LIMIT)
    frequent = written(texts.join(limits, "host").where(F.col("n_texts") > F.col("most")).select("line"), "frequent_lines")
    if frequent.count() <= 200_000:  # 8 bytes each
        frequent = F.broadcast(frequent)
    gone = lines.join(frequent, "line", "left_semi").select("row_key", "place", "n").distinct()
    return gone.groupBy("row_key").agg(F.sum("n").cast("long").alias("n_removed"))


def judged(docs: DataFrame) -> DataFrame:
    out = base_counts(docs).join(removed_words(docs), "row_key", "left")
    left = F.col("n_words") - F.coalesce("n_removed", F.lit(0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (100 * left >= LEAST_LEFT * F.col("n_words"))).alias("kept"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS h FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
win AS (SELECT r, i, w[i : i + 7] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
dup AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM win JOIN dup USING (r, g), range(8) AS k(j) GROUP BY r),
l AS (SELECT r, h, t, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
  trim(regexp_replace(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS norm
  FROM (SELECT r, h, t, unnest(string_split(t, chr(10))) AS line FROM d)),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE n > 0 GROUP BY r),
hosts AS (SELECT h, greatest({LEAST_LIMIT}, least({MOST_LIMIT}, count(DISTINCT t) // {LIMIT_ONE_IN})) AS most FROM d GROUP BY h),
f AS (SELECT h, norm FROM l JOIN hosts USING (h) WHERE n > 0 GROUP BY h, norm, most HAVING count(DISTINCT t) > most),
gone AS (SELECT r, sum(n) AS n FROM l JOIN f USING (h, norm) WHERE n > 0 GROUP BY r),
c AS (SELECT doc_id, len(w.w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed
  FROM d JOIN w USING (r) LEFT JOIN dl USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_removed) >= {LEAST_LEFT} * n_words AS kept, CAST(n_removed AS BIGINT) AS n_removed
FROM c
"""
