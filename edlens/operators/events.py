"""Process mining on an event log (case_id, activity, ts, event_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edlens.contracts import require
from edlens.operators.columns import infer_columns, parse_timestamp
from edlens.operators.ordered import MAX_GROUP_ROWS, in_order
from edlens.operators.quantiles import quantiles

START, END = "<start>", "<end>"
PATH_STEPS = 10_000


def prepare_event_log(df: DataFrame, default_resource: str = "unknown") -> DataFrame:
    """Infer names, parse text times, default the resource, drop rows without case or activity."""
    df = infer_columns(df)
    require(df, ["case_id", "activity", "timestamp"], "event log")
    if dict(df.dtypes)["timestamp"] == "string":
        df = df.withColumn("timestamp", parse_timestamp("timestamp"))
    resource = F.coalesce(F.col("resource"), F.lit(default_resource)) if "resource" in df.columns else F.lit(default_resource)
    return df.withColumn("resource", resource).dropna(subset=["case_id", "activity"])


def to_event_log(df: DataFrame) -> DataFrame:
    """Standard exchange names for case, activity, time and resource."""
    return df.select(
        F.col("case_id").cast("string").alias("case:concept:name"),
        F.col("activity").alias("concept:name"),
        F.col("timestamp").alias("time:timestamp"),
        F.col("resource").alias("org:resource"),
    )


def with_next(log: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Each event with the following activity and time of its case."""
    return in_order(
        log.select("case_id", "activity", "ts", "event_id"), ["case_id"], ["ts", "event_id"],
        following={"next_activity": "activity", "next_ts": "ts"}, max_group_rows=max_group_rows,
    )


def directly_follows(log: DataFrame, **kw) -> DataFrame:
    steps = with_next(log, **kw).where(F.col("next_activity").isNotNull())
    return steps.groupBy(F.col("activity").alias("source"), F.col("next_activity").alias("target")).agg(
        F.count(F.lit(1)).alias("frequency")
    )


def start_end_activities(log: DataFrame) -> DataFrame:
    at = F.struct("ts", "event_id")
    ends = log.groupBy("case_id").agg(F.min_by("activity", at).alias("start"), F.max_by("activity", at).alias("end"))
    long = ends.unpivot("case_id", ["start", "end"], "side", "activity")
    return long.groupBy("side", "activity").agg(F.count(F.lit(1)).alias("cases"))


def activity_frequency(log: DataFrame) -> DataFrame:
    return log.groupBy("activity").agg(F.count(F.lit(1)).alias("frequency"))


def trace_variants(log: DataFrame, top: int = 10, path_steps: int = PATH_STEPS, **kw) -> DataFrame:
    """Most frequent activity paths.

    A path is identified by two independent 64-bit hashes over (position, activity) and its
    length, which combine before the shuffle; only the ``top`` representatives are spelled out,
    in segments of ``path_steps`` activities. Equal counts rank by the smallest case id.
    """
    placed = in_order(log.select("case_id", "activity", "ts", "event_id"), ["case_id"], ["ts", "event_id"], position="pos", **kw)
    cases = placed.groupBy("case_id").agg(
        F.bit_xor(F.xxhash64("pos", "activity")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "activity", "pos")).alias("h2"),
        F.count(F.lit(1)).alias("steps"),
    )
    total = cases.agg(F.count(F.lit(1))).scalar()
    best = (
        cases.groupBy("h1", "h2", "steps")
        .agg(F.count(F.lit(1)).alias("frequency"), F.min("case_id").alias("case_id"))
        .orderBy(F.desc("frequency"), "case_id")
        .limit(top)
    )
    spelled = placed.join(F.broadcast(best), "case_id")
    segment = F.floor((F.col("pos") - 1) / path_steps).cast("bigint")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "activity"))), lambda s: s["activity"]), " -> ")
    return spelled.groupBy("case_id", "frequency", "steps", segment.alias("segment")).agg(path.alias("variant")).select(
        F.col("case_id").alias("example_case"), "variant", "segment", "steps", "frequency",
        (F.col("frequency") * 100.0 / total).alias("percentage"),
    )


def case_spans(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))


def throughput_stats(log: DataFrame) -> DataFrame:
    """Duration in hours over cases with more than one event."""
    hours = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 3.6e9
    spans = case_spans(log).where("events > 1").select(hours.alias("hours"))
    mid = quantiles(spans, [], "hours", {"median_hours": 0.5})
    return spans.agg(
        F.avg("hours").alias("mean_hours"), F.stddev_pop("hours").alias("std_hours"), F.min("hours").alias("min_hours"),
        F.max("hours").alias("max_hours"), F.count(F.lit(1)).alias("cases"),
    ).withColumn("median_hours", mid.scalar())


def bottlenecks(log: DataFrame, top: int = 10, **kw) -> DataFrame:
    """Waiting minutes per edge observed more than once, slowest median first."""
    steps = with_next(log, **kw).where(F.col("next_activity").isNotNull()).select(
        F.col("activity").alias("from_activity"), F.col("next_activity").alias("to_activity"),
        ((F.unix_micros("next_ts") - F.unix_micros("ts")) / 6e7).alias("minutes"),
    )
    edge = ["from_activity", "to_activity"]
    stats = steps.groupBy(*edge).agg(
        F.avg("minutes").alias("mean_waiting_minutes"), F.max("minutes").alias("max_waiting_minutes"), F.count(F.lit(1)).alias("frequency")
    )
    mid = quantiles(steps, edge, "minutes", {"median_waiting_minutes": 0.5})
    return stats.where("frequency > 1").join(mid, edge).orderBy(F.desc("median_waiting_minutes"), *edge).limit(top)


def case_arrival_gap(log: DataFrame) -> DataFrame:
    """Mean minutes between consecutive case starts: the gaps telescope to (last - first) / (n - 1)."""
    t = F.unix_micros("first_ts")
    return case_spans(log).agg(
        ((F.max(t) - F.min(t)) / 6e7 / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("mean_arrival_minutes"),
        F.count(F.lit(1)).alias("cases"),
    )


def trace_edges(log: DataFrame, **kw) -> DataFrame:
    """Every step of every case as an edge, with edges from the start and to the end."""
    seq = in_order(
        log.select("case_id", "activity", "ts", "event_id"), ["case_id"], ["ts", "event_id"],
        previous={"before": "activity"}, following={"after": "activity"}, **kw,
    )
    into = F.struct(F.coalesce("before", F.lit(START)).alias("source"), F.col("activity").alias("target"))
    out = F.when(F.col("after").isNull(), F.struct(F.col("activity").alias("source"), F.lit(END).alias("target")))
    return seq.select("case_id", F.explode(F.array_compact(F.array(into, out))).alias("e")).select("case_id", "e.*")


def edge_conformance(log: DataFrame, allowed: DataFrame, **kw) -> DataFrame:
    """Share of allowed steps per case: mean, and how many cases fit entirely."""
    from edlens.operators.features import join_dimension

    model = allowed.select("source", "target", F.lit(1).alias("fits"))
    steps = join_dimension(trace_edges(log, **kw), model, ["source", "target"])
    fit = steps.groupBy("case_id").agg((F.sum(F.coalesce("fits", F.lit(0))) / F.count(F.lit(1))).alias("fitness"))
    return fit.agg(
        F.avg("fitness").alias("average_fitness"), F.count_if(F.col("fitness") == 1).alias("conforming_cases"),
        F.count(F.lit(1)).alias("cases"), F.avg((F.col("fitness") == 1).cast("int")).alias("conformance_rate"),
    )


def log_summary(log: DataFrame, **kw) -> DataFrame:
    edges = directly_follows(log, **kw).agg(F.count(F.lit(1))).scalar()
    return log.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("case_id").alias("cases"), F.count_distinct("activity").alias("activities")
    ).withColumn("edges", edges)
