"""Column-level mappings: recodes, bins, scalings and proxies. Every function returns a Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Deprivation band to socio-economic score, and answer words to a relationship score.
IMD_SCORE = {"0-10%": 0.9, "10-20%": 0.7, "20-30%": 0.5, "30-40%": 0.3, "40-50%": 0.1}
SUPPORT_SCORE = {"Yes": 4, "No": 2, "Y": 4, "N": 2}
# Words read as the positive class whatever the configured one is.
POSITIVE_WORDS = ["1", "true", "fail", "withdraw", "at-risk"]
# Result words of the course tables, feature groups, canonical age bands.
PASS_VALUES = ("Pass",)
AT_RISK_VALUES = ("Fail", "Withdrawn")
CONCEPTS = {
    "attendance": ["absences", "failures"],
    "socio_economic_status": ["Medu", "Fedu", "traveltime"],
    "engagement": ["studytime", "goout", "Dalc", "Walc", "freetime"],
}
AGE_BAND_GROUP = {"0-35": "young", "35-55": "middle", "55<=": "older"}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pass_label(result: str | Column, pass_values: tuple[str, ...] = PASS_VALUES) -> Column:
    return F.coalesce(col(result).isin(*pass_values), F.lit(False)).cast("int")


def at_risk_label(result: str | Column, values: tuple[str, ...] = AT_RISK_VALUES) -> Column:
    return F.coalesce(col(result).isin(*values), F.lit(False)).cast("int")


def encode_label(value: str | Column, positive: str) -> Column:
    """1 for the configured positive word or a well-known one, whatever its case; else 0."""
    word = F.lower(F.trim(col(value).cast("string")))
    return F.coalesce(word.isin(positive.lower(), *POSITIVE_WORDS), F.lit(False)).cast("int")


def map_values(c: str | Column, mapping: dict, default: object | Column | None = None) -> Column:
    """Dictionary recode; unmatched values become ``default``, or stay when it is None."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    other = col(c) if default is None else (default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), other)


def intersect_key(*cols: str | Column, sep: str = "_x_") -> Column:
    return F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit("Unknown")) for c in cols])


def age_band(age: str | Column) -> Column:
    return F.when(col(age) <= 22, "0-35").otherwise("35-55")


def age_group(age: str | Column) -> Column:
    a = col(age)
    return F.when(a.between(15, 17), "young").when(a.between(18, 20), "middle").when(a.between(21, 25), "older").otherwise("middle")


def cut_bins(c: str | Column, edges: list[float], labels: list) -> Column:
    """Right-closed bins whose first also holds its left edge; null outside."""
    x, out = col(c), None
    for i, label in enumerate(labels):
        low = x >= edges[i] if i == 0 else x > edges[i]
        inside = low & (x <= edges[i + 1])
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def equal_width_bin(c: str | Column, lo: Column, hi: Column, k: int) -> Column:
    """0-based right-closed equal-width bin between global bounds."""
    x = col(c).cast("double")
    pos = F.ceil((x - lo) * k / (hi - lo)) - 1
    return F.when(hi == lo, F.lit(k // 2)).otherwise(F.greatest(F.least(pos, F.lit(k - 1)), F.lit(0))).cast("int")


def histogram_bin(c: str | Column, lo: Column, hi: Column, k: int) -> Column:
    """0-based left-closed equal-width bin, last bin closed; null outside the range."""
    x = col(c).cast("double")
    pos = F.least(F.floor((x - lo) * k / (hi - lo)), F.lit(k - 1))
    return F.when((x >= lo) & (x <= hi), F.when(hi == lo, F.lit(k // 2)).otherwise(pos)).cast("int")


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Clamp; null stays null (``greatest`` alone would skip it)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def minmax(c: str | Column, lo: Column, hi: Column) -> Column:
    return (col(c) - lo) / (hi - lo + 1e-8)


def inverted(c: str | Column, hi: Column) -> Column:
    return 1 - col(c) / (hi + 1)


def clip_scale(c: str | Column, lo: float, hi: float, default: float, top: float = 1.0) -> Column:
    """Linear rescale of [lo, hi] to [0, top], clamped, with a default for null."""
    return F.coalesce(clip((col(c) - lo) / (hi - lo) * top, 0.0, top), F.lit(default))


def log_scale(c: str | Column, upper: float = 10_000.0) -> Column:
    return clip(F.log1p(F.coalesce(col(c).cast("double"), F.lit(0.0))) / F.log1p(F.lit(upper)), 0.0, 1.0)


def ses_from_band(band: str | Column) -> Column:
    return map_values(band, IMD_SCORE, 0.5)


def ses_from_percentile(value: str | Column) -> Column:
    return F.coalesce(clip(4 - col(value) / 25.0, 0.0, 4.0), F.lit(2.0))


def ses_from_education(level: str | Column) -> Column:
    return col(level) / 4.0


def attempts_to_performance(attempts: str | Column) -> Column:
    a = col(attempts)
    return F.when(a == 0, 1.0).when(a == 1, 0.7).when(a == 2, 0.4).when(a > 2, 0.1).otherwise(0.5)


def yes_no(condition: Column) -> Column:
    return F.when(condition, "yes").otherwise("no")


def number_or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string").try_cast("double"), F.lit(0.0))


def row_mean(cols: list[str]) -> Column:
    """Mean over the non-null columns of a row."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


def band(c: str | Column, cuts: list[tuple[float, str]], low: str, strict: bool = False) -> Column:
    """First label whose bound is reached, bounds in falling order."""
    x, out = col(c), None
    for bound, label in cuts:
        hit = x > bound if strict else x >= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(low)


def direction(name: str | Column) -> tuple[Column, Column]:
    """Source and target out of ``<source>_to_<target>``."""
    return F.regexp_extract(col(name), r"(.+)_to_(.+)", 1), F.regexp_extract(col(name), r"(.+)_to_(.+)", 2)


def row_array_stats(cols: list[str]) -> dict[str, Column]:
    """Mean, spread, shape and interpolated percentiles across the columns of one row."""
    n = len(cols)
    xs = [F.col(c).cast("double") for c in cols]
    mean = reduce(lambda a, b: a + b, xs) / n

    def moment(k: int) -> Column:
        return reduce(lambda a, b: a + b, [F.pow(x - mean, F.lit(k)) for x in xs]) / n

    ordered = F.array_sort(F.array(*xs))

    def pct(p: float) -> Column:
        at = (n - 1) * p
        lo = int(at)
        hi = min(lo + 1, n - 1)
        low, high = ordered[lo], ordered[hi]
        return low + (high - low) * (at - lo)

    var = moment(2)
    return {
        "row_mean": mean, "row_std": F.sqrt(var), "row_max": F.greatest(*xs), "row_min": F.least(*xs),
        "row_median": pct(0.5), "row_p25": pct(0.25), "row_p75": pct(0.75), "row_p90": pct(0.9),
        "row_skewness": F.when(var > 0, moment(3) / F.pow(var, F.lit(1.5))).otherwise(0.0),
        "row_kurtosis": F.when(var > 0, moment(4) / F.pow(var, F.lit(2)) - 3).otherwise(0.0),
    }


def row_slope(cols: list[str]) -> Column:
    """Least-squares slope of the columns of a row against their position."""
    n = len(cols)
    centre = (n - 1) / 2
    weights = [(i - centre) for i in range(n)]
    sxx = sum(w * w for w in weights)
    return reduce(lambda a, b: a + b, [F.col(c) * (w / sxx) for c, w in zip(cols, weights)])


def interaction_columns(cols: list[str]) -> dict[str, Column]:
    """Pairwise products, squares and clipped ratios."""
    out: dict[str, Column] = {}
    for i, a in enumerate(cols):
        out[f"{a}_squared"] = F.col(a) * F.col(a)
        for b in cols[i + 1 :]:
            out[f"{a}_x_{b}"] = F.col(a) * F.col(b)
            out[f"{a}_over_{b}"] = clip(F.col(a) / (F.col(b) + 1e-8), -10.0, 10.0)
    return out


def household_columns() -> dict[str, Column]:
    mean = lambda cs: reduce(lambda a, b: a + b, [F.col(c) for c in cs]) / len(cs)
    return {
        "social_support_index": mean(["famrel", "freetime", "goout"]),
        "family_education_max": F.greatest("Medu", "Fedu"),
        "education_balance": F.abs(F.col("Medu") - F.col("Fedu")),
        "lifestyle_risk_score": mean(["Dalc", "Walc", "health"]),
    }
