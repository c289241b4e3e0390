"""Mappings of the course and grade data sets to shared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edlens.functions import scalars as S
from edlens.operators.columns import bounds, cut_equal_width
from edlens.operators.ordered import in_order
from edlens.operators.quantiles import quantiles

# Words and codes of the shared schemas.
YES_NO = {"Yes": "yes", "No": "no", "Y": "yes", "N": "no"}
DISABILITY_SUPPORT = {"N": 3.0, "Y": 1.0}
AGE_MID = {"0-35": 25, "35-55": 45, "55<=": 60}
COURSE_EDUCATION = {"No Formal quals": 0, "Lower Than A Level": 1, "A Level or Equivalent": 2, "HE Qualification": 3, "Post Graduate Qualification": 4}
MOOC_EDUCATION = {"Primary": 0, "Secondary": 1, "High School": 2, "Bachelor": 3, "Master": 4, "PhD": 5}
GENDER = {"F": "F", "M": "M", "Female": "F", "Male": "M"}


def canonical_bridge(df: DataFrame, kind: str, keep: list[str] | None = None) -> DataFrame:
    """Eight-column canonical schema plus label, from whichever inputs are present."""
    has, out = set(df.columns), {}
    if "sex" in has:
        out["sex"] = S.map_values("sex", {"F": "F", "M": "M"}, "M")
    if kind == "uci":
        if "age" in has:
            out["age_group"] = S.age_group("age")
        if "Medu" in has:
            out["ses_index"] = F.coalesce(F.col("Medu"), F.lit(2)).cast("double")
        if "famrel" in has:
            out["family_support"] = S.clip_scale("famrel", 1, 5, 2.0, 4.0)
        if "G1" in has:
            out["prior_performance"] = S.clip_scale("G1", 0, 20, 0.5)
        if "studytime" in has:
            out["study_load"] = S.clip_scale("studytime", 0, 4, 0.5)
            out["activity_level"] = S.clip_scale("studytime", 0, 4, 0.5)
            out["study_time"] = F.coalesce(F.col("studytime"), F.lit(2)).cast("double")
        if "G3" in has:
            out["label_pass"] = F.coalesce(F.col("G3") >= 10, F.lit(False)).cast("int")
    elif kind == "oulad":
        if "age_band" in has:
            out["age_group"] = S.map_values("age_band", S.AGE_BAND_GROUP, "middle")
        if "imd_band" in has:
            numeric = isinstance(df.schema["imd_band"].dataType, T.NumericType)
            # A percent-range text is read at the middle of its range.
            low, high = (F.regexp_extract("imd_band", r"(\d+)-(\d+)", i).try_cast("double") for i in (1, 2))
            out["ses_index"] = S.ses_from_percentile("imd_band" if numeric else (low + high) / 2)
        if "disability" in has:
            out["family_support"] = S.map_values("disability", DISABILITY_SUPPORT, 2.0)
        if "prev_attempts" in has:
            out["prior_performance"] = S.attempts_to_performance("prev_attempts")
        if "studied_credits" in has:
            out["study_load"] = S.clip_scale("studied_credits", 30, 240, 0.5)
        if "vle_total_clicks" in has:
            out["activity_level"] = S.log_scale("vle_total_clicks")
            clicks = F.coalesce(F.col("vle_total_clicks"), F.lit(0))
            out["study_time"] = F.coalesce(S.cut_bins(clicks, [0, 100, 500, 2000, float("inf")], [0.0, 1.0, 2.0, 3.0]), F.lit(1.0))
        if "final_result" in has:
            out["label_pass"] = S.pass_label("final_result", ("Pass", "Distinction"))
    else:
        raise ValueError(f"unknown kind {kind}")
    if "label_pass" not in out and "label_pass" in has:
        out["label_pass"] = F.col("label_pass").cast("int")
    return df.select(*(keep or []), *[c.alias(n) for n, c in out.items()])


def shared_features(df: DataFrame, kind: str, keep: list[str] | None = None) -> DataFrame:
    """Twelve shared features; those whose input is missing are left out."""
    has, out = set(df.columns), {}
    yes_no = lambda c: S.map_values(c, YES_NO)
    for c in ("sex", "studytime", "goout"):
        if c in has:
            out[c] = F.col(c)
    for c in ("higher", "famsup"):
        if c in has:
            out[c] = yes_no(c)
    if kind == "oulad":
        if "age_band" in has:
            out["age_band"] = F.col("age_band")
        if "imd_band" in has:
            out["ses_proxy"] = S.ses_from_band(F.col("imd_band").cast("string"))
        if "vle_total_clicks" in has:
            b = bounds(df, "vle_total_clicks")
            out["attendance_proxy"] = S.minmax("vle_total_clicks", b["vle_total_clicks_lo"], b["vle_total_clicks_hi"])
            out["internet"] = S.yes_no(F.col("vle_total_clicks") > 0)
        if "goout" in has:
            out["activities"] = S.yes_no(F.col("goout") > 3)
        if "studytime" in has:
            out["freetime"] = 5 - F.col("studytime").cast("double")
        if "famsup" in has:
            out["famrel"] = S.map_values("famsup", S.SUPPORT_SCORE, 3)
        label = "label_pass"
    else:
        if "age" in has:
            out["age_band"] = S.age_band("age")
        if "Medu" in has:
            out["ses_proxy"] = S.ses_from_education("Medu")
        if "absences" in has:
            out["attendance_proxy"] = S.inverted("absences", bounds(df, "absences")["absences_hi"])
        for c in ("internet", "activities", "freetime", "famrel"):
            if c in has:
                out[c] = F.col(c)
        label = "pass" if "pass" in has else "label_pass"
        if label not in has and "G3" in has:
            df, label = df.withColumn("label_pass", (F.col("G3") >= 10).cast("int")), "label_pass"
    if label in df.columns:
        out["label"] = F.col(label)
    return df.select(*(keep or []), *[c.alias(n) for n, c in out.items()])


def common_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Common features of three data sets, chosen by the columns present."""
    has, out = set(df.columns), {}
    if "label_pass" in has:
        out["label_pass"] = F.col("label_pass")
    elif "G3" in has:
        out["label_pass"] = (F.col("G3") >= 10).cast("int")
    elif "final_score" in has:
        out["label_pass"] = (F.col("final_score") >= 60).cast("int")
    elif "final_result" in has:
        out["label_pass"] = S.pass_label("final_result")
    else:
        raise ValueError("no target column")
    if "sex" in has:
        out["gender"] = S.map_values("sex", GENDER, "F")
    if "age" in has:
        out["age_normalized"] = F.col("age")
    elif "age_band" in has:
        out["age_normalized"] = S.map_values("age_band", AGE_MID, 25)
    if "highest_education" in has:
        out["education"] = S.map_values("highest_education", COURSE_EDUCATION, 1)
    elif "education_level" in has:
        out["education"] = S.map_values("education_level", MOOC_EDUCATION, 2)
    elif has & {"Medu", "Fedu"}:
        out["education"] = F.greatest(*[F.col(c) if c in has else F.lit(0) for c in ("Medu", "Fedu")])
    if "vle_total_clicks" in has:
        out["engagement_score"] = F.col("vle_total_clicks")
    elif "total_video_time" in has:
        out["engagement_score"] = F.col("total_video_time")
    elif "absences" in has:
        out["engagement_score"] = bounds(df, "absences")["absences_hi"] - F.col("absences")
    for c in ("G1", "assignment_mean_score", "assignment_avg_score"):
        if c in has:
            out["prior_performance"] = F.col(c)
            break
    if "gender" in out and "age_normalized" in out:
        age = out["age_normalized"]
        band = F.when((age > 0) & (age <= 25), "young").when((age > 25) & (age <= 35), "middle").when((age > 35) & (age <= 100), "older").otherwise("nan")
        out["gender_x_age"] = F.concat_ws("_x_", out["gender"], band)
    return df.select(*(keep or []), *[c.alias(n) for n, c in out.items()])


def align_columns(source: DataFrame, target: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Common columns of both sides; numeric target-only columns become low / med / high, a constant on the source side."""
    common = [c for c in source.columns if c in target.columns and c != label]
    extra = [c for c in target.columns if c not in source.columns and c != label and isinstance(target.schema[c].dataType, T.NumericType)]
    binned = cut_equal_width(target, extra, 3) if extra else target
    names = F.array(F.lit("low"), F.lit("med"), F.lit("high"))
    a = source.select(*common, *[F.lit("med").alias(f"{c}_binned") for c in extra], label)
    b = binned.select(*common, *[F.get(names, F.col(f"{c}_bin")).alias(f"{c}_binned") for c in extra], label)
    return a, b


def rescale_to_reference(df: DataFrame, reference: DataFrame, cols: list[str]) -> DataFrame:
    """Min-max map of columns to the range of another data set; its mean when the column is constant."""
    a, b = bounds(df, *cols), bounds(reference, *cols)
    mean = reference.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
    out = {}
    for c in cols:
        lo, hi, rlo, rhi = a[f"{c}_lo"], a[f"{c}_hi"], b[f"{c}_lo"], b[f"{c}_hi"]
        out[c] = F.when(hi > lo, (F.col(c) - lo) / (hi - lo) * (rhi - rlo) + rlo).otherwise(mean[c])
    return df.withColumns(out)


def unknown_to_mode(df: DataFrame, reference: DataFrame, c: str) -> DataFrame:
    """Categories the reference does not know become its most frequent one (ties: the smallest)."""
    from edlens.operators.features import join_dimension

    counts = reference.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    mode = counts.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).scalar()
    known = join_dimension(df, counts.select(c, F.lit(True).alias("__known")), [c], unique=True)
    return known.withColumn(c, F.when(F.col("__known"), F.col(c)).otherwise(mode)).select(*df.columns)


def joint_prepare(source: DataFrame, target: DataFrame, cols: list[str], keep: list[str], *, median: str = "joint", scale: str = "robust", products: int = 4) -> DataFrame:
    """Both sides in one table with ``domain``: union-vocabulary codes, median fill, pair products, scaling fitted on the source."""
    from edlens.operators.features import join_dimension

    side = lambda df, d: df.select(*keep, *cols, F.lit(d).alias("domain"))
    both = side(source, 0).unionByName(side(target, 1))
    text = [c for c in cols if isinstance(both.schema[c].dataType, T.StringType)]
    for c in text:
        words = both.select(F.coalesce(F.col(c), F.lit("missing")).alias(c)).distinct()
        codes = in_order(words, [], [c], position="at").select(c, (F.col("at") - 1).cast("double").alias(f"__{c}"))
        both = join_dimension(both.withColumn(c, F.coalesce(F.col(c), F.lit("missing"))), codes, [c], unique=True).withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    numeric = [c for c in cols if c not in text]
    if numeric:
        base = both if median == "joint" else both.where("domain = 0")
        long = base.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "column", "value")
        mids = {r["column"]: r["m"] for r in quantiles(long, ["column"], "value", {"m": 0.5}).collect()}
        both = both.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(mids.get(c) or 0.0)) for c in numeric})
    names = list(cols)
    lead = cols[:products]
    for i, a in enumerate(lead):
        for b in lead[i + 1 :]:
            both = both.withColumn(f"{a}_x_{b}", F.col(a) * F.col(b))
            names.append(f"{a}_x_{b}")
    long = both.where("domain = 0").select(*names).unpivot([], names, "column", "value")
    if scale == "robust":
        q = {r["column"]: (r["m"], r["b"] - r["a"]) for r in quantiles(long, ["column"], "value", {"a": 0.25, "m": 0.5, "b": 0.75}).collect()}
    else:
        q = {r["column"]: (r["m"], r["s"]) for r in long.groupBy("column").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()}
    return both.withColumns({c: (F.col(c) - q[c][0]) / (q[c][1] or 1.0) for c in names})
