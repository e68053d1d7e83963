"""Incident datasets: coded CSV and JSON in, incident rows out, and the sinks of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T

# Columns of the coded CSV, all read as text.
CSV_COLUMNS = ["eventid", "iyear", "imonth", "iday", "country_txt", "provstate", "city", "attacktype1_txt", "targtype1_txt", "weaptype1_txt", "gname", "nkill", "nwound", "summary"]
LISTS = ["responsible_groups", "target_organizations", "attack_types", "weapon_types", "target_types"]
INCIDENT = "incident_id string, date string, country string, state string, city string, location_confidence double, " + ", ".join(f"{c} array<string>" for c in LISTS) + ", killed int, injured int, summary string, has_summary boolean"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The named columns of a CSV with a header; bytes that aren't UTF-8 are replaced."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select(*CSV_COLUMNS)


def coded_incidents(rows: DataFrame) -> DataFrame:
    """Incident rows of the coded columns: counts truncated (bad: 0), dates with 01 for what is
    missing, Unknown or empty labels as empty lists."""
    c = F.col
    text = lambda name: F.coalesce(c(name), F.lit(""))
    return rows.select(
        c("eventid").alias("incident_id"), T.format_date(T.parse_int(c("iyear")), T.parse_int(c("imonth")), T.parse_int(c("iday"))).alias("date"), text("country_txt").alias("country"), text("provstate").alias("state"), text("city").alias("city"),
        F.lit(1.0).alias("location_confidence"), T.clean_list(c("gname")).alias("responsible_groups"), F.array().cast("array<string>").alias("target_organizations"), T.clean_list(c("attacktype1_txt")).alias("attack_types"),
        T.clean_list(c("weaptype1_txt")).alias("weapon_types"), T.clean_list(c("targtype1_txt")).alias("target_types"), T.parse_int(c("nkill")).alias("killed"), T.parse_int(c("nwound")).alias("injured"), F.trim(text("summary")).alias("summary"),
        (F.trim(text("summary")) != "").alias("has_summary"),
    )


def with_defaults(rows: DataFrame) -> DataFrame:
    """Null texts, lists and numbers of incident rows as empty, empty and 0."""
    empty = {"string": F.lit(""), "double": F.lit(0.0), "int": F.lit(0), "boolean": F.lit(False), "array<string>": F.array().cast("array<string>")}
    return rows.select(*[F.coalesce(F.col(name), empty[kind]).alias(name) if kind in empty else F.col(name) for name, kind in rows.dtypes])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Incidents of JSON files that hold an array of objects; missing keys take their defaults."""
    return with_defaults(spark.read.schema(INCIDENT).option("multiLine", True).json(path))


def parse_json(text: Column) -> Column:
    return F.from_json(text, INCIDENT)


def subsets(rows: DataFrame, country: str = "India") -> dict[str, DataFrame]:
    home, told = F.col("country") == country, F.col("has_summary")
    return {"full": rows, "summary": rows.where(told), "country": rows.where(home), "country_summary": rows.where(home & told)}


def write_subsets(rows: DataFrame, path: str) -> None:
    """The four datasets as JSON lines below ``path``."""
    for name, part in subsets(rows).items():
        part.write.mode("overwrite").json(f"{path}/{name}")


def totals(rows: DataFrame, country: str = "India") -> DataFrame:
    told, home = F.col("has_summary"), F.col("country") == country
    n = F.count("*")
    return rows.agg(n.alias("total"), F.count_if(told).alias("with_summary"), F.round(F.try_divide(F.count_if(told) * 100.0, n), 6).alias("pct"), F.count_if(home).alias("home"), F.count_if(home & told).alias("home_summary"))


def add_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``old`` doesn't have, one per key: what an insert-only table takes."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def write_failures(failed: DataFrame, path: str) -> None:
    """summary, ground_truth, prediction of missed fields as CSV with a header, a folder for each field."""
    failed.select("field", "summary", "ground_truth", "prediction").write.mode("overwrite").partitionBy("field").csv(path, header=True)


def report(metrics: DataFrame) -> DataFrame:
    """One text: a Markdown table of field metrics, and how many fields were missed. One row for each field."""
    row = F.format_string("| %s | %.1f%% | %.1f%% | %d | %d |", "field", "accuracy_known", "accuracy_all", "known", F.col("total") - F.col("known"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", row.alias("line")))), lambda x: x["line"]), "\n")
    head = "# Benchmark of coded fields\n\n| Field | Accuracy (excl. unknown) | Accuracy (incl. unknown) | Known | Unknown |\n|---|---|---|---|---|\n"
    return metrics.agg(F.concat(F.lit(head), lines, F.lit("\n\nMissed: "), F.sum(F.col("known") - F.col("correct")).cast("string")).alias("report"))


# Columns of the evaluation set, all read as text.
EVALUATION_COLUMNS = ["summary", "attacktype1_txt", "weaptype1_txt", "targtype1_txt", "nkill", "nwound"]


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Summaries and their coded fields of a CSV with a header."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select(*EVALUATION_COLUMNS)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """name (the file's, without its ending) and the fields of JSON files that hold one object each."""
    rows = with_defaults(spark.read.schema(INCIDENT).option("multiLine", True).json(path).withColumn("_file", F.input_file_name()))
    return rows.withColumn("name", F.regexp_extract("_file", r"([^/]+)\.[^./]*$", 1)).drop("_file")


def corrected(rows: DataFrame, fixes: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` as ``fixes`` (key, column) has it, where it has the key."""
    new = fixes.select(key, F.col(column).alias("_fixed"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_fixed", column)).drop("_fixed").select(*rows.columns)


# Texts of rendered reports for evaluation sets, by number.
_WHAT = ["A car bomb exploded near {target} in {city}", "Gunmen opened fire on {target} in {city}", "Rebels torched {target} in {city}"]
_TARGETS = ["a police station", "a market", "an army convoy"]


def rendered(numbers: DataFrame, cities: list[str]) -> DataFrame:
    """name, text and the truth about it of every number ``n``: reports to evaluate extraction on."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))
    n = F.col("n")
    place, killed, injured, day = pick(cities, n), (F.pmod(n, F.lit(9)) + 1).cast("int"), (F.pmod(n, F.lit(4)) + 2).cast("int"), (F.pmod(n, F.lit(28)) + 1).cast("int")
    what = F.replace(F.replace(pick(_WHAT, n), F.lit("{target}"), pick(_TARGETS, n)), F.lit("{city}"), place)
    text = F.concat(F.lit("On "), day.cast("string"), F.lit(" April 2019 there was an attack. "), what, F.lit(". "), killed.cast("string"), F.lit(" people were killed and "), injured.cast("string"), F.lit(" others were injured."))
    return numbers.select(F.format_string("incident_%05d", n).alias("name"), text.alias("text"), F.format_string("2019-04-%02d", day).alias("date"), place.alias("city"), killed.alias("killed"), injured.alias("injured"))
