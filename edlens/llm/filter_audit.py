"""How document filters interact: what each one removes at every place in every order of them."""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.llm import shared as S

#: Failure conditions over ``text``, ``words``; the letter after them stands for copies of texts with a smaller id.
RULES = {
    "A": "size(words) < 200",
    "B": "100 * size(array_distinct(words)) < 50 * size(words)",
    "C": "100 * length(regexp_replace(text, '[^A-Z]+', '')) > 2 * length(text)",
    "D": "text rlike '[#$%&*|]'",
}
COPY = "E"


def copies(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``id``, ``mark``, ``part`` of the rows of ``docs`` whose text also has a smaller id: an existential self-join.

    Only texts whose hash occurs under two ids are compared. The right side is one row per text, the smallest
    id, combined before the shuffle, so a text in a third of all rows costs no pairs; written tables on
    both sides let adaptive execution split its rows on the left.
    """
    repeated = S.written(marks.groupBy("mark").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("mark"), "audit-repeated")
    suspects = S.written(docs.select("id", "part", "mark", "text").join(repeated, "mark", "left_semi"), "audit-suspects")
    firsts = S.written(suspects.groupBy("mark", "text").agg(F.min("id").alias("first")), "audit-firsts")
    firsts = firsts.select(F.col("mark").alias("m"), F.col("text").alias("t"), "first")
    found = suspects.join(firsts, (F.col("mark") == F.col("m")) & (F.col("text") == F.col("t")) & (F.col("first") < F.col("id")), "left_semi")
    return found.select("id", "mark", "part").distinct()


def combinations_of_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", rules: dict[str, str] = RULES) -> DataFrame:
    """``part``, ``bits`` (bit i: fails the i-th filter), ``n``, ``good``, ``toxic``: documents of each combination."""
    own = docs.select(F.col(id_col).alias("id"), S.text_of(source).alias("part"), S.text_of(text).alias("text"))
    own = own.withColumn("mark", F.xxhash64("text"))
    split = own.withColumn("words", S.words_of(F.col("text")))
    bits = sum((F.expr(rule).cast("int") * (1 << i) for i, rule in enumerate(rules.values())), F.lit(0))
    marks = S.written(split.select("id", "mark", "part", bits.alias("bits")), "audit-marks")
    failures = marks.select("*", F.lit(1).alias("rows")).union(copies(own, marks).select("*", F.lit(1 << len(rules)).alias("bits"), F.lit(0).alias("rows")))
    judged = failures.groupBy("id", "mark", "part").agg(F.bit_or("bits").alias("bits"), F.sum("rows").alias("rows"))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.select(F.col("doc_id").alias("of"), "quality", "toxic").groupBy("of").agg(flag("quality").alias("q"), flag("toxic").alias("t"))
    counted = judged.join(known, F.col("id") == F.col("of"), "left")
    total = lambda c: F.sum(F.col("rows") * F.coalesce(c, F.lit(0)))
    return counted.groupBy("part", "bits").agg(F.sum("rows").alias("n"), total("q").alias("good"), total("t").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", rules: dict[str, str] = RULES) -> DataFrame:
    """One row per part (value of ``source``), order of the filters and step: what that filter does there.

    A left-semi join on text hash, exact text and smaller id marks copies; its ids are united with those that fail
    the other filters, and the aggregate per combination of failures answers all orders: the documents left after a
    set of filters are the combinations without any of its bits. Columns: ``part``, ``filter_order``, ``step``,
    ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley`` (sum over orders).

    Null and empty text: empty, no words; null and empty source: the part ''. Repeated rows count one by one, and are
    no copies of each other as long as their ids are equal. A null id is smaller than none and larger than
    none. Of several labels of an id any 1 counts; null labels count as 0. Empty table: no rows. Further columns
    are ignored. Rows that share id, source and 64-bit text hash are judged as one text.
    """
    letters, k = "".join(rules) + COPY, len(rules) + 1
    found = combinations_of_failures(docs, labels, id_col, text, source, rules)
    parts = found.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("rows"))
    # Entry m + 1: documents that fail no filter of the set m.
    free = "transform(sequence(0, {top}), m -> aggregate(rows, 0L, (s, r) -> s + if(r.bits & m = 0, r.{c}, 0L)))"
    parts = parts.select("part", *(F.expr(free.format(top=(1 << k) - 1, c=c)).alias(f"free_{c}") for c in ("n", "good", "toxic")),
                         F.expr(f"transform(sequence(0, {k - 1}), i -> aggregate(rows, 0L, (s, r) -> s + if(r.bits = shiftleft(1, i), r.n, 0L)))").alias("unique"))

    def left(mask: Column | int, c: str = "n") -> Column:
        return F.element_at(f"free_{c}", (F.lit(mask) if isinstance(mask, int) else mask) + 1)

    def shapley(i: int) -> Column:
        others = [j for j in range(k) if j != i]
        sets = [(sum(1 << j for j in s), len(s)) for r in range(k) for s in combinations(others, r)]
        return sum((left(m) - left(m | 1 << i)) * (factorial(r) * factorial(k - 1 - r)) for m, r in sets)

    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    rows = parts.withColumn("shares", F.array(*(shapley(i) for i in range(k))))
    rows = rows.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    rows = rows.withColumn("at", F.expr(f"instr('{letters}', substring(filter_order, step, 1))"))
    before = sum((F.expr(f"if(instr(substring(filter_order, 1, step - 1), '{x}') > 0, {1 << i}, 0)") for i, x in enumerate(letters)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("after", F.expr("before | shiftleft(1, at - 1)"))
    b, a = F.col("before"), F.col("after")
    removed = left(b) - left(a)
    return rows.select(
        "part", "filter_order", "step", left(a).alias("kept"), removed.alias("removed"), (left(0) - left(a.bitwiseAND(F.bitwise_not(b))) - removed).alias("redundant"),
        F.element_at("unique", F.col("at")).alias("unique_fails"), (left(b, "good") - left(a, "good")).alias("good_lost"), (left(b, "toxic") - left(a, "toxic")).alias("toxic_lost"),
        F.element_at("shares", F.col("at")).alias("shapley"))
