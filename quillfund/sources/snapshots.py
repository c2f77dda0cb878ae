"""Snapshot tables as CSV, JSON lines, manifests, and the text logs of load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfund.functions.columns import size_bytes

_TAIL = ", source string, as_of date"
#: The 12 snapshot tables with their keys.
SCHEMAS = {
    "funds": ("fund_code string, fund_name string, full_name string, fund_type string, theme string, style string, company string, custodian string, established date, benchmark string, tracking_index string", ["fund_code"]),
    "share_classes": ("share_code string, fund_code string, share_class string, share_name string", ["share_code"]),
    "fees": ("share_code string, management_fee decimal(8,6), custody_fee decimal(8,6), sales_service_fee decimal(8,6)", ["share_code"]),
    "purchase_fee_tiers": ("share_code string, tier_no int, min_amount decimal(20,2), max_amount decimal(20,2), rate decimal(8,6), fixed_fee decimal(12,2), tier_text string, source_page int", ["share_code", "tier_no"]),
    "redemption_fee_tiers": ("share_code string, tier_no int, min_days int, max_days int, rate decimal(8,6), tier_text string", ["share_code", "tier_no"]),
    "nav_daily": ("share_code string, nav_date date, unit_nav decimal(12,4), accum_nav decimal(12,4), daily_return decimal(12,6)", ["share_code", "nav_date"]),
    "dividends": ("share_code string, record_date date, ex_date date, cash_per_unit decimal(12,6), pay_date date", ["share_code", "ex_date"]),
    "managers": ("manager_name string, company string, career_days int, total_aum decimal(20,2)", ["manager_name", "company"]),
    "fund_manager_tenures": ("fund_code string, manager_name string, start_date date, end_date date", ["fund_code", "manager_name"]),
    "holdings_top10": ("fund_code string, report_period string, rank_no int, stock_code string, stock_name string, weight decimal(8,6), shares decimal(20,2), market_value decimal(20,2)", ["fund_code", "report_period", "rank_no"]),
    "fund_scale": ("fund_code string, report_date date, net_assets decimal(20,2)", ["fund_code", "report_date"]),
    "period_returns": ("share_code string, period string, ret decimal(12,6), end_date date", ["share_code", "period"]),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name][0] + _TAIL)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A snapshot CSV. Its header must be exactly the declared columns; an empty text is null; codes stay strings."""
    path = f"{folder}/{name}.csv"
    declared = schema(name)
    header = spark.read.option("header", True).csv(path).columns
    if header != declared.names:
        raise ValueError(f"{name}: header {header} is not {declared.names}")
    return spark.read.schema(declared).option("header", True).option("nullValue", "").option("mode", "FAILFAST").csv(path)


def _plain(field: T.StructField) -> Column:
    """Decimals without exponent or trailing zeros, dates ISO, null as nothing."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.DecimalType):
        text = c.cast("string")
        return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return c.cast("string")


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Writes the declared columns; a missing one is an error."""
    declared = schema(name)
    if lost := [c for c in declared.names if c not in df.columns]:
        raise ValueError(f"{name}: columns {lost} are missing")
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared]).select(*[_plain(f).alias(f.name) for f in declared]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/{name}.csv")


def reload(spark: SparkSession, folder: str, target: str, tables: list[str] | None = None) -> DataFrame:
    """Rebuilds Parquet tables from a snapshot and compares counts: table, source_rows, target_rows, same."""
    counts = None
    for name in tables or list(SCHEMAS):
        rows = read_table(spark, folder, name)
        rows.write.mode("overwrite").parquet(f"{target}/{name}")
        one = rows.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(spark.read.parquet(f"{target}/{name}").agg(F.count(F.lit(1)).alias("target_rows"))).withColumn("table", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return counts.select("table", "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("same"))


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur twice or hold a null."""
    missing = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | missing)


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


MANIFEST = "documents array<struct<doc_id:string,fund_code:string,doc_type:string,period:string,path:string,sha256:string,extract:struct<ok:boolean>>>"


def read_manifest(spark: SparkSession, path: str, doc_ids: list[str] | None = None, lines: bool = False) -> DataFrame:
    """The usable documents of manifests: a file each, or with ``lines`` a line each, so that files can hold many."""
    rows = spark.read.schema(MANIFEST).option("multiLine", not lines).json(path).select(F.explode("documents").alias("d")).select("d.*").where("extract.ok")
    return rows.where(F.col("doc_id").isin(doc_ids)) if doc_ids else rows


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a server-sent-event log: file, event, data, heartbeat; frames are separated by blank lines."""
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("frame")).where("trim(frame) <> ''")
    data = F.array_join(F.regexp_extract_all("frame", F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    event = F.nullif(F.regexp_extract("frame", r"(?m)^event: ?(.*)$", 1), F.lit(""))
    return rows.select("file", event.alias("event"), F.nullif(data, F.lit("")).alias("data"), F.col("frame").rlike("(?m)^:").alias("heartbeat"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Container samples, `<epoch> {json}`: t, name, cpu_pct, mem_bytes; lines that cannot be read are dropped."""
    rows = spark.read.text(path).select(F.split("value", " ", 2).alias("p"))
    body = F.from_json(F.get("p", F.lit(1)), "Name string, CPUPerc string, MemUsage string")
    found = rows.select(F.get("p", F.lit(0)).try_cast("double").alias("t"), body.alias("b")).select("t", F.col("b.Name").alias("name"), F.replace(F.col("b.CPUPerc"), F.lit("%")).try_cast("double").alias("cpu_pct"), size_bytes(F.split("b.MemUsage", "/")[0]).alias("mem_bytes"))
    return found.dropna()


def read_folded(spark: SparkSession, path: str) -> DataFrame:
    """Folded stacks, `thread;frame;...;frame N`: thread, frames, samples; lines without a whole count are dropped."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^(.*) (\d+)$", 1).alias("stack"), F.regexp_extract("value", r"^(.*) (\d+)$", 2).try_cast("long").alias("samples")).where("samples IS NOT NULL")
    parts = F.split("stack", ";")
    return rows.select(parts[0].alias("thread"), F.slice(parts, F.lit(2), F.size(parts)).alias("frames"), "samples")


def stack_profile(stacks: DataFrame, top: int = 20) -> DataFrame:
    """Self and inclusive samples of each frame, with their share of all samples."""
    total = stacks.agg(F.sum("samples").alias("all"))
    own = stacks.select(F.element_at("frames", -1).alias("frame"), "samples").groupBy("frame").agg(F.sum("samples").alias("self"))
    inclusive = stacks.select(F.explode(F.array_distinct("frames")).alias("frame"), "samples").groupBy("frame").agg(F.sum("samples").alias("inclusive"))
    rows = inclusive.join(own, "frame", "left").crossJoin(F.broadcast(total))
    return rows.select("frame", F.coalesce("self", F.lit(0)).alias("self"), "inclusive", (F.col("inclusive") / F.col("all")).alias("share")).orderBy(F.desc("inclusive"), "frame").limit(top)


def read_jfr(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Execution samples of a JFR text dump with a start time in [start, end): time, frames."""
    rows = spark.read.option("lineSep", "jdk.ExecutionSample {").text(path).select(F.col("value").alias("block"))
    at = F.regexp_extract("block", r"startTime = (\d\d:\d\d:\d\d)", 1)
    frames = F.regexp_extract_all("block", F.lit(r"(?m)^\s+([\w.$<>]+\([^)]*\))\s+line:"), F.lit(1))
    return rows.select(at.alias("time"), frames.alias("frames")).where((F.col("time") >= start) & (F.col("time") < end))
