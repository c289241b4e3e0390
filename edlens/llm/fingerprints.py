"""Document fingerprints: a homomorphic multiset hash of paragraphs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edlens.llm import shared as S

#: Hashes of a paragraph; each gives eight lanes of one byte. Their sums modulo 2 ** 32 are kept two to a long.
HASHES = 4
MODULUS = 1 << 32
#: Paragraphs end at line breaks and at the end of sentences.
BREAK = r"(?<=[.!?])[\x20\x09-\x0D]+|[\x0A\x0D]+"
LANES = tuple(f"s{k}_{j}" for k in range(HASHES) for j in range(8))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, BREAK), lambda p: p != "")


def lanes(part: Column) -> list[Column]:
    """The vector of one paragraph."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(k), part), 8 * j).bitwiseAND(0xFF).alias(f"s{k}_{j}") for k in range(HASHES) for j in range(8)]


def pack(low: Column, high: Column) -> Column:
    """Two lanes modulo 2 ** 32 in one long."""
    return F.shiftleft(F.pmod(high, F.lit(MODULUS)), 32).bitwiseOR(F.pmod(low, F.lit(MODULUS)))


def unpack(s: Column) -> tuple[Column, Column]:
    return s.bitwiseAND(MODULUS - 1), F.shiftrightunsigned(s, 32)


def summed(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``n``, ``sums`` of the paragraphs of one text per key: rows of a key are added up one by one, then one of them stands for all."""
    rows = df.select(*keys, F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text"))
    parts = rows.select(*keys, "__row", F.explode_outer(paragraphs(F.col("__text"))).alias("__p"))
    parts = parts.select(*keys, "__row", F.col("__p").isNotNull().cast("long").alias("__n"), *lanes(F.col("__p")))
    each = parts.groupBy(*keys, "__row").agg(F.sum("__n").alias("n"), *(F.sum(F.when(F.col("__n") == 1, F.col(s)).otherwise(F.lit(0))).alias(s) for s in LANES))
    pairs = [pack(F.col(f"s{k}_{j}"), F.col(f"s{k}_{j + 4}")) for k in range(HASHES) for j in range(4)]
    one = each.select(*keys, F.struct("n", F.array(*pairs).alias("sums")).alias("__v")).groupBy(*keys).agg(F.min("__v").alias("__v"))
    return one.select(*keys, "__v.n", "__v.sums")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Sums of two multisets together, or of ``a`` without the paragraphs of ``b`` (``sign`` -1), lane by lane modulo 2 ** 32."""

    def both(x: Column, y: Column) -> Column:
        (p, q), (r, s) = unpack(x), unpack(y)
        return pack(p + sign * r, q + sign * s)

    return F.zip_with(a, b, both)


def digest(n: Column, sums: Column) -> Column:
    """The fingerprint as text: number of paragraphs, then lanes modulo 2 ** 32, in hexadecimal."""
    return F.concat(F.lpad(F.hex(n), 8, "0"), F.array_join(F.transform(sums, lambda s: F.lpad(F.hex(s), 16, "0")), ""))


def likeness(n_a: Column, a: Column, n_b: Column, b: Column) -> Column:
    """Cosine of the centred vectors, 0 to 1: about the share of common paragraphs. Empty ones equal each other."""

    def centred(n: Column, sums: Column) -> Column:
        return F.flatten(F.transform(sums, lambda s: F.array(*(x - 127.5 * n for x in unpack(s)))))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)

    x, y = centred(n_a, a), centred(n_b, b)
    size = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / size))).otherwise(F.lit(0.0))
    return F.when((n_a == n_b) & (a == b), F.lit(1.0)).otherwise(cosine)


def followers(docs: DataFrame) -> DataFrame:
    """``id``, ``mark``, ``n_chars``, ``copies`` and ``next_id``, ``next_mark``: the next document by id, at the end the first.

    The (small) table of ids is cut into ranges; each finds its followers by itself, its last row the head of
    the next range.
    """
    light = S.written(docs.groupBy("id", "mark", "n_chars").agg(F.count("*").alias("copies")), "ids")
    order = [F.col("id").asc_nulls_first(), F.col("mark").asc()]
    ranged = S.written(light.repartitionByRange(S.wide(docs), *order).withColumn("part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("part").orderBy(*order)
    ranged = ranged.withColumn("next", F.lead(F.struct("id", "mark")).over(inner))
    heads = ranged.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "mark")).alias("h"))
    line = Window.orderBy("part")  # one row per range
    heads = heads.select("part", F.coalesce(F.lead("h").over(line), F.first("h").over(line)).alias("h"))
    out = ranged.join(heads, "part")
    after = F.coalesce("next", F.struct(F.col("h.id").alias("id"), F.col("h.mark").alias("mark")))
    return out.withColumn("after", after).select("id", "mark", "n_chars", "copies", F.col("after.id").alias("next_id"), F.col("after.mark").alias("next_mark"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The fingerprint sums a vector hashed from each paragraph, so it depends on the multiset of paragraphs alone,
    and ``combine`` adds or takes out paragraphs without the text. The edited text has its last quarter replaced
    by the beginning of the next document in the order of ids.

    Null or empty text: no paragraphs, likeness 1 to another empty one and 0 to the rest. Null ids come
    first. Repeated rows (id and text) are one document in the order, with one result row each; other texts of the same id are
    ordered by hash. Equal texts of different ids are ordinary documents. Other columns are ignored.
    """
    body = S.text_of(text)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    chain = S.written(followers(rows.withColumn("n_chars", F.length("text").cast("long"))), "followers")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")

    def joined(side: DataFrame, id_name: str, mark_name: str) -> DataFrame:
        return rows.join(side, rows["id"].eqNullSafe(side[id_name]) & (rows["mark"] == side[mark_name]))

    asked = chain.select(F.col("next_id").alias("a_id"), F.col("next_mark").alias("a_mark"), F.col("id").alias("to_id"), F.col("mark").alias("to_mark"), quarter.alias("q"))
    heads = joined(asked, "a_id", "a_mark").select("to_id", "to_mark", F.expr("substring(text, 1, q)").alias("head")).groupBy("to_id", "to_mark").agg(F.min("head").alias("head"))
    kept = F.expr("substring(text, 1, int(length(text) - floor(length(text) / 4)))")
    edited = joined(heads, "to_id", "to_mark").select("id", "mark", F.concat(kept, "head").alias("text"))
    edited = summed(edited.withColumn("sha", F.sha2("text", 256)), ["id", "mark", "sha"], "text")
    # Equal texts have equal sums: one row per text, found again by its hash.
    own = S.written(summed(rows, ["mark"], "text"), "sums")
    e = edited.select(F.col("id").alias("e_id"), F.col("mark").alias("e_mark"), "sha", F.col("n").alias("e_n"), F.col("sums").alias("e_sums"))
    o = own.select(F.col("mark").alias("o_mark"), F.col("n").alias("o_n"), F.col("sums").alias("o_sums"))
    f = own.select(F.col("mark").alias("f_mark"), F.col("n").alias("f_n"), F.col("sums").alias("f_sums"))
    out = chain.join(e, chain["id"].eqNullSafe(e["e_id"]) & (chain["mark"] == e["e_mark"])).join(o, chain["mark"] == o["o_mark"]).join(f, chain["next_mark"] == f["f_mark"])
    c = F.col
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), c("copies").cast("int")))).select(
        "id", "n_chars", c("sha").alias("edited_sha256"), digest(c("o_n"), c("o_sums")).alias("fingerprint"), digest(c("e_n"), c("e_sums")).alias("edited_fingerprint"),
        likeness(c("o_n"), c("o_sums"), c("e_n"), c("e_sums")).alias("near_edited"), likeness(c("o_n"), c("o_sums"), c("f_n"), c("f_sums")).alias("near_next"))
