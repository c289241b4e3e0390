"""Secrets in texts, with the ownership of each candidate value across the corpus. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edlens.llm import shared as S

#: Kinds in the order of the report, with pattern and the group that holds the value. Failing matches
#: of access and hex (too short) could hold no longer one, so their length is part of the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2), ("access", r"AKIA[A-Z0-9]{16,}", 0), ("hex", r"[0-9a-f]{24,}", 0))
ASSIGN_LENGTH = 6
#: Further candidates: a token of 20 and more characters with digits, capital and small letters.
OWNED = ("owned", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}", 0)
KINDS = (*BASE, OWNED)


def candidates(docs: DataFrame, id_col: str, text: str, owner: Column, repository: Column) -> DataFrame:
    """``row``, ``id``, ``mark``, ``owner``, ``repo`` and for each kind its matches, values and the gaps between them."""
    body = S.text_of(text)
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("mark"), owner.alias("owner"), repository.alias("repo"), body.alias("text"))
    for name, pattern, _ in KINDS:
        plain = plain.withColumn(f"m_{name}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    found = []
    for name, pattern, group in KINDS:
        some = F.size(f"m_{name}") > 0
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else F.col(f"m_{name}")
        gaps = F.transform(F.split("text", pattern), F.length)
        found.append(F.when(some, F.struct(F.transform(f"m_{name}", F.length).alias("sizes"), values.alias("values"), gaps.alias("gaps"))).alias(name))
    rows = plain.select("id", "mark", "owner", "repo", *found)
    return S.written(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")


def spans(rows: DataFrame) -> DataFrame:
    """``row``, ``owner``, ``repo``, ``kind``, ``start``, ``end`` (code points), ``value`` of all matches that pass."""
    parts = [rows.where(F.col(name).isNotNull()).select("row", "owner", "repo", F.lit(i).alias("kind"),
                                                       F.posexplode(F.arrays_zip(F.col(f"{name}.sizes"), F.col(f"{name}.values"), F.slice(f"{name}.gaps", F.lit(1), F.size(f"{name}.sizes")))).alias("at", "m"))
             for i, (name, _, _) in enumerate(KINDS)]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    every = every.select("row", "owner", "repo", "kind", "at", F.col("m.sizes").alias("n"), F.col("m.values").alias("value"), F.col("m").getField("2").alias("gap"))
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("n") + F.col("gap")).over(so_far)
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    passes = F.when(F.col("kind") == 0, F.length("value") >= ASSIGN_LENGTH).when(F.col("kind") == len(BASE), mixed).otherwise(True)
    return every.withColumn("end", end).where(passes).select("row", "owner", "repo", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """``hash``, ``n_repos``, ``n_owners`` of each candidate value; each (value, owner, repository) counts once."""
    once = found.select("hash", "owner", "repo").distinct()
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def of_kind(i: int):
    return lambda s: s["kind"] == i


def listing(items: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(name) for name, _, _ in KINDS))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None, max_owners: int = 2, max_repositories: int = 3) -> DataFrame:
    """One row per document: ``id``, ``mark``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``found``, ``n_added``, ``n_owned``, ``n_shared``, ``owners``, ``repositories``.

    Base spans are the leftmost non-overlapping matches of each kind. Candidate values are hashed and counted over
    the corpus by distinct repositories and owners: one known to more than ``max_owners`` owners, or to more than
    ``max_repositories`` repositories, is a widely copied example, another looks live. Live-looking tokens that no base
    span touches are added as ``owned``. ``n_owned`` and ``n_shared`` count the base spans of either sort, ``owners`` and
    ``repositories`` hold the most of them that a base span's value is known to. ``found`` holds the spans (start, kind, end), sorted.

    ``owner`` and ``repository`` default to the columns source and lang within source; a null counts as an owner
    of its own. Null text: empty, no spans. Repeated rows and null ids: a row each; repeated rows of one owner
    count once. Spans of one start come in the order of kinds. Other columns are ignored.
    """
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")) if owner is None else owner
    repository = F.concat_ws("/", F.lit(""), F.col("lang").cast("string")) if repository is None else repository
    rows = candidates(docs, id_col, text, owner, repository)
    hits = spans(rows).withColumn("hash", F.xxhash64("value")).drop("value")
    hits = S.written(hits, "spans")
    hits = hits.join(ownership(hits), "hash")
    mine = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repositories)).alias("live")))).alias("all"),
                                    *(F.coalesce(F.max(F.when(F.col("kind") < len(BASE), F.col(c))), F.lit(0)).alias(name) for c, name in (("n_owners", "owners"), ("n_repos", "repositories"))))
    mine = mine.withColumn("base", F.filter("all", lambda s: s["kind"] < len(BASE)))
    more = F.filter("all", lambda s: (s["kind"] == len(BASE)) & s["live"] & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    mine = mine.withColumn("more", more)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>")
    out = rows.select("row", "id", "mark").join(mine, "row", "left").withColumns({c: F.coalesce(c, none) for c in ("base", "more")})

    def count(test) -> Column:
        return F.size(F.filter("base", test)).cast("long")

    both = F.transform(F.sort_array(F.concat("base", "more")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = out.withColumn("found", both)
    counts = [count(of_kind(i)).alias(f"n_{name}") for i, (name, _, _) in enumerate(BASE)]
    return out.select("id", "mark", *counts, F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.col("found")).alias("spans"), "found",
                      F.size("more").cast("long").alias("n_added"), count(lambda s: s["live"]).alias("n_owned"), count(lambda s: ~s["live"]).alias("n_shared"),
                      *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("owners", "repositories")))


def masked(text: Column, found: Column) -> Column:
    """``text`` with each span (and spans that overlap it) replaced by <secret>."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"]
        fresh = s["start"] >= at
        piece = F.when(fresh, F.concat(acc["out"], F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int")), F.lit("<secret>"))).otherwise(acc["out"])
        return F.struct(F.greatest(at, s["end"]).alias("at"), piece.alias("out"))

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with the secrets of every text masked; rows without any stay as they are."""
    row, mark, found = S.free(docs.columns, "id", "mark", "found")
    hits = find_secrets(docs, id_col, text, **how).where("size(found) > 0").groupBy(F.col("id").alias(row), F.col("mark").alias(mark)).agg(F.max("found").alias(found))
    body = S.text_of(text)
    joined = docs.join(hits, docs[id_col].eqNullSafe(hits[row]) & (F.xxhash64(body) == hits[mark]), "left")
    return joined.select(*(F.when(F.col(found).isNull(), docs[c]).otherwise(masked(docs[c], F.col(found))).alias(c) if c == text else docs[c] for c in docs.columns))
