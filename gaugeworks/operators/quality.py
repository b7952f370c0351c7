"""Validity, quarantine and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import exact_double, finite, media_type, uuid_text, zscore

from .features import canonical_hash


def reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reason``: the first rule that a row breaks, null for a valid row. A rule that is null is broken."""
    out = F.lit(None).cast("string")
    for name, good in reversed(rules.items()):
        out = F.when(~F.coalesce(good, F.lit(False)), F.lit(name)).otherwise(out)
    return df.withColumn("reason", out)


def drive_day_rules(file_day: Column) -> dict[str, Column]:
    return {
        "missing identity": F.col("serial_number").isNotNull() & F.col("model").isNotNull(),
        "date differs from file": F.col("date") == file_day,
        "failure flag": F.col("failure").isin(0, 1),
    }


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    marked = reasons(df, rules)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(reason, n), one row for each reason that occurs and for the valid rows."""
    return reasons(df, rules).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def require_none(df: DataFrame, message: str) -> None:
    """Raises if there is a row: an audit that is fatal."""
    if df.limit(1).count():
        raise ValueError(message)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflicting(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows disagree; a null is a value here."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("versions")).where("versions > 1")


def changing(df: DataFrame, key: str, attribute: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(attribute).alias("n")).where("n > 1")


def media_audit(df: DataFrame, model: str = "model") -> DataFrame:
    """(model, rows, media_type)."""
    return df.groupBy(model).agg(F.count(F.lit(1)).alias("rows")).withColumn("media_type", media_type(model))


def allowed_models(df: DataFrame, media: str = "hdd") -> DataFrame:
    """Rows of models of one medium; an unknown model is fatal."""
    models = media_audit(df)
    require_none(models.where("media_type = 'unknown'"), "unknown drive models need review")
    return df.join(models.where(F.col("media_type") == media).select("model"), "model", "left_semi")


#: Fields of a drive's JSON report, and the range of each.
REPORT = "device struct<protocol:string>, temperature struct<current:double>, power_on_time struct<hours:double>, nvme_smart_health_information_log struct<media_errors:double,percentage_used:double,temperature:double,power_on_hours:double>"


def report_rows(df: DataFrame, month: Column | str) -> DataFrame:
    """Rows (invalid, ts, device_uuid, report) of JSON reports of a month (yyyy-MM, or a column of it): adds the four readings and ``reason`` (null for a valid row)."""
    r = F.from_json("report", REPORT)
    log = r["nvme_smart_health_information_log"]
    out = df.withColumn("device", uuid_text("device_uuid")).withColumn("at", F.try_to_timestamp("ts")).withColumn("_r", r)
    out = out.withColumns({"temperature": F.coalesce(log["temperature"], r["temperature"]["current"]), "media_errors": log["media_errors"], "power_on_hours": F.coalesce(log["power_on_hours"], r["power_on_time"]["hours"]), "percentage_used": log["percentage_used"]})
    whole = lambda c, low, high: exact_double(c) & (F.col(c) == F.floor(c)) & F.col(c).between(low, high)
    rules = {
        "marked invalid": F.lower("invalid") == "f",
        "device": F.col("device").isNotNull(),
        "month": F.date_format("at", "yyyy-MM") == month,
        "protocol": F.col("_r.device.protocol") == "NVMe",
        "temperature": whole("temperature", -100, 200),
        "media errors": whole("media_errors", 0, 2.0**53),
        "power-on hours": whole("power_on_hours", 0, 2.0**53),
        "percentage used": whole("percentage_used", 0, 255),
    }
    return reasons(out, rules).drop("_r")


def ordered_times(df: DataFrame, by: str, text: str, pattern: str = "dd-MMM-yyyy HH:mm:ss") -> DataFrame:
    """(by, rows, first, last, sound): whether a table's time texts all parse and rise from row to row (``row`` is the place in the file)."""
    at = df.withColumn("_t", F.try_to_timestamp(F.col(text), F.lit(pattern)))
    rise = at.withColumn("_up", F.coalesce(F.col("_t") > F.lag("_t").over(Window.partitionBy(by).orderBy("row")), F.col("row") == F.min("row").over(Window.partitionBy(by))))
    return rise.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.min("_t").alias("first"), F.max("_t").alias("last"), F.bool_and(F.col("_t").isNotNull() & F.col("_up")).alias("sound"))


def valve_position(position: Column | str = "position", marks: Column | str = "marks") -> Column:
    """A valve's reading counts if its position is 0 to 800 and all its quality marks say observed."""
    position = F.col(position) if isinstance(position, str) else position
    return F.coalesce(position.between(0, 800) & F.forall(marks, lambda m: m == "observed"), F.lit(False))


def case_faults(cases: DataFrame, ids: tuple[str, ...], channels: tuple[str, ...], dataset: str, split: str, size: int = 28) -> DataFrame:
    """Cases of ``sources.readers.case_bundle`` with ``reason``: the first term of the contract that a case breaks, null for a sound one."""
    digest = lambda c: F.col(c).rlike("^[0-9a-f]{64}$")
    days = F.transform("window.dates", lambda d: F.unix_date(F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).cast("date")))
    full = lambda v: (F.size(v) == size) & F.forall(v, lambda x: finite(x))
    shown, raw = F.col("model_inputs.time_series"), F.col("window.channels")
    normal = F.forall(F.zip_with(raw, shown, lambda c, s: F.forall(F.zip_with(zscore(c["values"]), s, lambda a, b: F.abs(a - b) <= 1e-5), lambda ok: ok)), lambda ok: ok)
    rules = {
        "case id": F.get(F.array(*map(F.lit, ids)), F.col("place")) == F.col("case_id"),
        "source": (F.col("source.dataset") == dataset) & (F.col("source.split") == split) & (F.col("source.drive_id") != "") & digest("source.dataset_manifest_sha256"),
        "dates": (F.size(days) == size) & F.forall(F.transform(days, lambda d, i: d - F.get(days, F.lit(0)) == i), lambda ok: ok),
        "start and as-of": (F.col("window.start") == F.get("window.dates", F.lit(0))) & (F.col("window.as_of") == F.element_at("window.dates", -1)),
        "channels": F.transform(raw, lambda c: c["name"]) == F.array(*map(F.lit, channels)),
        "units": F.forall(raw, lambda c: c["unit"] == "raw_source_units"),
        "values": F.forall(raw, lambda c: full(c["values"])) & (F.size(shown) == len(channels)) & F.forall(shown, full),
        "descriptions": (F.size("model_inputs.time_series_text") == len(channels)) & F.forall(F.zip_with("model_inputs.time_series_text", F.array(*map(F.lit, channels)), lambda t, c: t.startswith(F.concat(c, F.lit(";")))), lambda ok: ok),
        "inputs follow the values": normal,
        "inference": (F.col("inference.source") == "saved_model_inference") & ~F.col("inference.executed_during_this_review") & (F.col("inference.output_text") != "") & digest("inference.checkpoint_sha256"),
        "unsupported prediction": F.col("inference.failure_probability").isNull() & F.col("inference.failure_window").isNull() & F.col("inference.confidence").isNull(),
        "input digest": canonical_hash(F.col("inputs_json")) == F.col("inference.input_sha256"),
        "reference": F.col("evaluation_reference.never_send_to_model") & (F.col("evaluation_reference.weak_rule_target") != "") & (F.col("evaluation_reference.exact_match") == (F.col("inference.output_text") == F.col("evaluation_reference.weak_rule_target"))),
    }
    return reasons(cases, rules)


def window_faults(df: DataFrame, cadence_us: int | None, channels: tuple[str, ...], start_us: Column, stop_us: Column, size: int = 28) -> DataFrame:
    """Adds ``reason`` to window rows (times_us, channels, values): what a component window must hold to."""
    steps = F.zip_with(F.slice("times_us", 1, size - 1), F.slice("times_us", 2, size - 1), lambda a, b: b - a)
    rules = {
        "length": F.size("times_us") == size,
        "order": F.forall(steps, lambda d: d > 0),
        "calendar gap": F.forall(steps, lambda d: d == cadence_us) if cadence_us else F.lit(True),
        "channels": (F.size("channels") >= 2) & (F.size(F.array_distinct("channels")) == F.size("channels")) & (F.size(F.array_except("channels", F.array(*map(F.lit, channels)))) == 0),
        "split time": (F.get("times_us", F.lit(0)) >= start_us) & (F.get("times_us", F.lit(size - 1)) < stop_us),
        "values": F.forall("values", lambda v: (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))),
    }
    return reasons(df, rules)
