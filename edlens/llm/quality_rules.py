"""Quality rules of documents: word and line statistics, and lines frequent across documents of a host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.llm import shared as S

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Base limits: fewest words, and the share (in percent) of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A line is frequent in a host above this many distinct documents and this share of them.
LINE_DOCS, LINE_SHARE = 20, 0.005
#: A document is depleted if less than this share of its characters in lines is left.
LEFT_SHARE = 0.2


def repeated_words(rows: DataFrame, words: str) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows of five that occur twice or more in the same array.

    Windows are hashed; only where a hash recurs are they sorted with their places, so the work of a text is
    that of sorting it.
    """
    n = F.size(words)
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(WINDOW)))))
    rows = rows.withColumn("__h", hashes)
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    rows = rows.withColumn("__s", F.when(again, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = F.filter("__s", lambda s, i: (s["h"] == F.get(F.col("__s"), i - 1)["h"]) | (s["h"] == F.get(F.col("__s"), i + 1)["h"]))
    rows = rows.withColumn("__p", F.sort_array(F.transform(twin, lambda s: s["i"])))
    covered = F.transform("__p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__p"), k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0), lambda a, b: a + b)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("__h", "__s", "__p")


def normalised(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, S.SPACE + "+", " ")))


def statistics(docs: DataFrame, id_col: str, text: str, host: str) -> DataFrame:
    """A written row per document: counts, and the hashes of its lines with their characters."""
    body = S.text_of(text)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), body.alias("text"))
    rows = rows.withColumn("words", S.words_of(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(S.SPACE_CHARS)) != ""))
    rows = repeated_words(rows, "words").select(
        "id", "host", F.xxhash64("text").alias("mark"), F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("line_chars"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.length(x).alias("chars"))).alias("hashed"))
    return S.written(rows.withColumn("row", F.monotonically_increasing_id()), "quality")


def frequent_lines(rows: DataFrame, lines: DataFrame, docs_limit: int, share: float) -> DataFrame:
    """``host``, ``line`` of the lines above the limits. A text counts once, however often it is copied."""
    per_line = lines.select("host", "line", "mark").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > docs_limit)
    per_host = rows.select("host", "mark").distinct().groupBy("host").agg(F.count("*").alias("all"))
    return per_line.join(per_host, "host").where(F.col("n") > F.col("all") * share).select("host", "line")


def verdicts(docs: DataFrame, id_col: str, text: str, host: str, docs_limit: int, share: float, left_share: float) -> DataFrame:
    """The rows of ``judge`` with ``host`` and ``gone``, the hashes of the document's frequent lines (null without any)."""
    rows = statistics(docs, id_col, text, host)
    each = rows.select("row", "host", "mark", F.explode("hashed").alias("s")).select("row", "host", "mark", "s.line", "s.chars")
    lines = each.groupBy("row", "host", "mark", "line").agg(F.sum("chars").alias("chars"))
    gone = lines.join(frequent_lines(rows, lines, docs_limit, share), ["host", "line"]).groupBy("row").agg(F.sum("chars").alias("frequent_chars"), F.collect_list("line").alias("gone"))
    out = rows.join(gone, "row", "left").withColumn("frequent_chars", F.coalesce("frequent_chars", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = (F.col("line_chars") - F.col("frequent_chars")) >= left_share * F.col("line_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", docs_limit: int = LINE_DOCS, share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """One row per document: ``id``, ``mark``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``frequent_chars``, ``base_failed``, ``kept``.

    Lines of any length are normalised (small letters, single spaces) and hashed; distinct documents per
    host are counted, and the lines above both limits taken out. A document fails the base rules, or is depleted when less than
    ``left_share`` of the characters in its lines would be left; otherwise it is kept. ``keep_good`` gives the texts.

    Null or empty text: no words, so not kept. Null host: a host of its own. Repeated rows and null ids: a row
    each; equal texts count once as documents. Other columns are ignored.
    """
    return verdicts(docs, id_col, text, host, docs_limit, share, left_share).select(
        "id", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "frequent_chars", "base_failed", "kept")


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose hash is in ``gone``; the others stay as they are, and null takes nothing."""
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normalised(x))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", docs_limit: int = LINE_DOCS, share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """``docs`` without the documents that the rules reject; texts lose the lines that are frequent in their host."""
    found = verdicts(docs, id_col, text, host, docs_limit, share, left_share).where("kept")
    row, home_of, mark, gone = S.free(docs.columns, "id", "host", "mark", "gone")
    good = found.groupBy(F.col("id").alias(row), F.col("host").alias(home_of), F.col("mark").alias(mark)).agg(F.first("gone").alias(gone))
    home = F.coalesce(docs[host].cast("string"), F.lit(""))
    joined = docs.join(good, docs[id_col].eqNullSafe(good[row]) & (home == good[home_of]) & (F.xxhash64(S.text_of(text)) == good[mark]))
    return joined.select(*(without_lines(docs[c], F.col(gone)).alias(c) if c == text else docs[c] for c in docs.columns))
