"""Course-shaped views over the generic test tables, each with the same view as SQL text.

``Tables`` builds them lazily with Spark; ``CTES`` states them for the SQL that checks results.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

KEYS = ["id_student", "code_module", "code_presentation"]
MODELS = ["prob_gru", "prob_lstm", "prob_transformer", "prob_tcn"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _keys(user: str) -> str:
    return (
        f"{user} AS id_student, concat('M', CAST({user} % 3 AS STRING)) AS code_module, "
        f"CASE {user} % 4 WHEN 0 THEN '2013B' WHEN 1 THEN '2013J' WHEN 2 THEN '2014B' ELSE '2014J' END"
        " AS code_presentation"
    )


DAY = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER)"
SPARK_DAY = "datediff(CAST(ts AS DATE), DATE '2024-01-01')"

_STUDENTS = (
    _keys("c_custkey")
    + ", CASE c_custkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS gender, concat('R', CAST(c_nationkey AS STRING)) AS region,"
    " c_mktsegment AS highest_education,"
    " CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 2000 THEN '0-10%' WHEN c_acctbal < 4000 THEN '10-20%'"
    " WHEN c_acctbal < 6000 THEN '20-30%' WHEN c_acctbal < 8000 THEN '30-40%' ELSE '40-50%' END AS imd_band,"
    " CASE c_nationkey % 3 WHEN 0 THEN '0-35' WHEN 1 THEN '35-55' ELSE '55<=' END AS age_band,"
    " CASE WHEN c_custkey % 7 = 0 THEN 'Y' ELSE 'N' END AS disability,"
    " CAST(c_nationkey % 4 AS BIGINT) AS num_of_prev_attempts, 30 + 30 * (c_custkey % 4) AS studied_credits,"
    " c_acctbal AS balance"
)
_REG = (
    _keys("c_custkey")
    + ", CAST(-(c_custkey % 60) AS INTEGER) AS date_registration,"
    " CASE CAST(floor(abs(c_acctbal)) AS BIGINT) % 4 WHEN 0 THEN 'Pass' WHEN 1 THEN 'Fail' WHEN 2 THEN 'Withdrawn'"
    " ELSE 'Distinction' END AS final_result"
)
_GRADES0 = (
    "c_custkey AS id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS b, CAST(c_nationkey AS BIGINT) AS n, c_mktsegment AS school"
)
_GRADES = (
    "id, school, CASE id % 2 WHEN 0 THEN 'F' ELSE 'M' END AS sex, 15 + id % 10 AS age, n % 5 AS Medu, b % 5 AS Fedu,"
    " 1 + n % 4 AS traveltime, 1 + b % 4 AS studytime, b % 4 AS failures, 1 + (b + n) % 5 AS famrel, 1 + id % 5 AS freetime,"
    " 1 + (id + b) % 5 AS goout, 1 + n % 5 AS Dalc, 1 + (n + id) % 5 AS Walc, 1 + b % 5 AS health, (b * 3 + id) % 33 AS absences,"
    " CASE WHEN (id + n) % 3 = 0 THEN 'no' ELSE 'yes' END AS internet, CASE WHEN b % 2 = 0 THEN 'no' ELSE 'yes' END AS famsup,"
    " b % 21 AS G1, (b % 21 * 2 + id % 21) % 21 AS G2, CAST(floor((b % 21 * 3 + id % 21) / 4.0) AS BIGINT) AS G3"
)
_Y = "CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END"
_PRED = (
    f"o_orderkey AS id, o_custkey AS id_student, CAST({_Y} AS INTEGER) AS y,"
    f" ((o_orderkey * 7919 + 13) % 700 + 299 * {_Y}) / 1000.0E0 AS prob_gru,"
    f" ((o_orderkey * 104729 + 7) % 800 + 199 * {_Y}) / 1000.0E0 AS prob_lstm,"
    f" ((o_orderkey * 1299709 + 3) % 600 + 399 * {_Y}) / 1000.0E0 AS prob_transformer,"
    f" ((o_orderkey * 15485863 + 5) % 900 + 99 * {_Y}) / 1000.0E0 AS prob_tcn,"
    " CASE o_custkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS sex, o_orderpriority AS grp, o_totalprice AS price"
)
_ITEM = (
    "l_orderkey AS id_assessment, l_linenumber, l_partkey, l_suppkey, l_quantity AS score,"
    " CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_banked"
)

CTES = {
    "clicks": f"SELECT {_keys('user_id')}, event_id, ts, event_id % 50 AS id_site, event_type AS activity, {DAY} AS date,"
    " CAST(floor(value) AS BIGINT) AS sum_click FROM events",
    "students": f"SELECT {_STUDENTS} FROM customer",
    "registrations": f"SELECT {_REG} FROM customer",
    "resources": "SELECT DISTINCT event_id % 50 AS id_site,"
    " CASE WHEN event_id % 50 < 20 THEN 'resource' WHEN event_id % 50 < 40 THEN 'forum' ELSE 'quiz' END AS activity_type FROM events",
    "assessments": f"SELECT o_orderkey AS id_assessment, {_keys('o_custkey')},"
    " CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 60 AS INTEGER) END AS deadline"
    " FROM orders",
    "submissions": f"SELECT {_ITEM}, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS date_submitted FROM lineitem",
    "event_log": f"SELECT concat(CAST(user_id AS STRING), '-', CAST({DAY} AS STRING)) AS case_id, event_type AS activity, ts, event_id,"
    " concat('k', CAST(event_id % 2 AS STRING)) AS resource FROM events",
    "actions": f"SELECT CAST(user_id AS STRING) AS username, concat('C', CAST(event_id % 3 AS STRING)) AS course_id, event_id,"
    f" floor(epoch_us(ts) / 1000000) AS seconds, value, event_type, {DAY} AS date,"
    " CASE WHEN event_type = 'click' THEN 1.0E0 ELSE 0.0E0 END AS action_click,"
    " CASE WHEN event_type = 'view' THEN 1.0E0 ELSE 0.0E0 END AS action_view FROM events",
    "grades": f"SELECT {_GRADES} FROM (SELECT {_GRADES0} FROM customer)",
    "predictions": f"SELECT {_PRED} FROM orders",
    "long_predictions": "SELECT id, id_student, y, sex, grp, price, 'prob_gru' AS model, prob_gru AS p FROM predictions UNION ALL"
    " SELECT id, id_student, y, sex, grp, price, 'prob_lstm', prob_lstm FROM predictions UNION ALL"
    " SELECT id, id_student, y, sex, grp, price, 'prob_transformer', prob_transformer FROM predictions UNION ALL"
    " SELECT id, id_student, y, sex, grp, price, 'prob_tcn', prob_tcn FROM predictions",
}
USES = {"long_predictions": ["predictions"]}


def with_(names: str, body: str) -> str:
    """SQL text with the named views in front."""
    wanted: list[str] = []
    for name in names.split():
        for dep in [*USES.get(name, []), name]:
            if dep not in wanted:
                wanted.append(dep)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    body = body.strip()
    if not wanted:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


class Tables:
    """Lazily read tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def clicks(self) -> DataFrame:
        return self.raw("events").selectExpr(
            *_split(_keys("user_id")), "event_id", "ts", "event_id % 50 AS id_site", "event_type AS activity",
            f"{SPARK_DAY} AS date", "CAST(floor(value) AS BIGINT) AS sum_click",
        )

    @cached_property
    def students(self) -> DataFrame:
        return self.raw("customer").selectExpr(*_split(_STUDENTS))

    @cached_property
    def registrations(self) -> DataFrame:
        return self.raw("customer").selectExpr(*_split(_REG))

    @cached_property
    def resources(self) -> DataFrame:
        return self.raw("events").selectExpr("event_id % 50 AS id_site").distinct().selectExpr(
            "id_site",
            "CASE WHEN id_site < 20 THEN 'resource' WHEN id_site < 40 THEN 'forum' ELSE 'quiz' END AS activity_type",
        )

    @cached_property
    def assessments(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id_assessment", *_split(_keys("o_custkey")),
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') + 60 END AS deadline",
        )

    @cached_property
    def submissions(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            *_split(_ITEM), "datediff(CAST(l_shipdate AS DATE), DATE '1992-01-01') AS date_submitted"
        )

    @cached_property
    def event_log(self) -> DataFrame:
        return self.raw("events").selectExpr(
            f"concat(CAST(user_id AS STRING), '-', CAST({SPARK_DAY} AS STRING)) AS case_id", "event_type AS activity",
            "CAST(ts AS TIMESTAMP) AS ts", "event_id", "concat('k', CAST(event_id % 2 AS STRING)) AS resource",
        )

    @cached_property
    def actions(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "CAST(user_id AS STRING) AS username", "concat('C', CAST(event_id % 3 AS STRING)) AS course_id", "event_id",
            "CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS DOUBLE) AS seconds", "value", "event_type", f"{SPARK_DAY} AS date",
            "CASE WHEN event_type = 'click' THEN 1.0D ELSE 0.0D END AS action_click",
            "CASE WHEN event_type = 'view' THEN 1.0D ELSE 0.0D END AS action_view",
        )

    @cached_property
    def grades(self) -> DataFrame:
        return self.raw("customer").selectExpr(*_split(_GRADES0)).selectExpr(*_split(_GRADES))

    @cached_property
    def predictions(self) -> DataFrame:
        return self.raw("orders").selectExpr(*_split(_PRED))

    @cached_property
    def long_predictions(self) -> DataFrame:
        return self.predictions.unpivot(["id", "id_student", "y", "sex", "grp", "price"], MODELS, "model", "p")


def _split(text: str) -> list[str]:
    """Split a projection list at top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]
