"""Column contracts of the course tables and a plan-time check against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_PRES = {"code_module": S, "code_presentation": S}
# Column names of the public course tables.
COURSE_TABLES: dict[str, T.StructType] = {
    "studentInfo": _struct(
        **_PRES, id_student=L, gender=S, region=S, highest_education=S, imd_band=S, age_band=S,
        num_of_prev_attempts=L, studied_credits=L, disability=S,
    ),
    "studentRegistration": _struct(
        **_PRES, id_student=L, date_registration=I, date_unregistration=I, final_result=S
    ),
    "studentVle": _struct(**_PRES, id_student=L, id_site=L, date=I, sum_click=L),
    "vle": _struct(id_site=L, **_PRES, activity_type=S, week_from=I, week_to=I),
    "studentAssessment": _struct(id_assessment=L, id_student=L, date_submitted=I, is_banked=I, score=D),
    "assessments": _struct(**_PRES, id_assessment=L, assessment_type=S, date=I, weight=D),
    "courses": _struct(**_PRES, module_presentation_length=I),
}
OPTIONAL_TABLES = {"courses"}
SENSITIVE = ["sex", "age_band", "highest_education", "imd_band"]


def missing_columns(df: DataFrame, needed: list[str] | T.StructType) -> list[str]:
    names = needed.names if isinstance(needed, T.StructType) else needed
    return [n for n in names if n not in df.columns]


def require(df: DataFrame, needed: list[str] | T.StructType, what: str = "input") -> DataFrame:
    gone = missing_columns(df, needed)
    if gone:
        raise ValueError(f"{what} lacks columns {gone}")
    return df


def conform_columns(df: DataFrame, contract: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename, check and cast to the contract; further columns are left out."""
    for old, new in (renames or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    require(df, contract)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract])


def columns_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


