"""Parsing and display functions: Column in, Column out, all inside Catalyst. Values that cannot be read become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.plans.views import oracle, run

# Texts that mean "no value".
NOTHING = ("", "nan", "None", "---", "--")
# Bytes of each size unit.
UNIT_BYTES = {"B": 1, "kB": 1000, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "KiB": 1024, "MiB": 1024**2, "GiB": 1024**3}
_NUM = r"(\d+(?:\.\d+)?)"


def _text(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.when(~s.isin(*NOTHING), s)


def _got(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


def pct_to_decimal(c: Column) -> Column:
    """First signed number / 100, with or without a percent sign; thousands commas are dropped."""
    return (_got(F.replace(_text(c), F.lit(",")), r"(-?\d+(?:\.\d+)?)").cast("decimal(20,6)") / 100).cast("decimal(20,8)")


def to_decimal(c: Column, scale: int = 6) -> Column:
    return F.replace(_text(c), F.lit(",")).try_cast(f"decimal(28,{scale})")


def parse_date(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    pattern = r"(\d{4})[-年/.]?(\d{1,2})[-月/.]?(\d{1,2})"
    return F.try_make_date(*[_got(s, pattern, k).cast("int") for k in (1, 2, 3)]) if hasattr(F, "try_make_date") else F.make_date(*[_got(s, pattern, k).cast("int") for k in (1, 2, 3)])


def quarter_label(c: Column) -> Column:
    pattern = r"(\d{4})年\s*(\d)\s*季度"
    return F.when(c.rlike(pattern), F.concat(F.regexp_extract(c, pattern, 1), F.lit("Q"), F.regexp_extract(c, pattern, 2)))


def quarter_end(c: Column) -> Column:
    return F.last_day(F.make_date(F.substring(c, 1, 4).cast("int"), F.substring(c, -1, 1).cast("int") * 3, F.lit(1)))


# Wordings of bounds in the next three functions.
def holding_period(c: Column) -> Column:
    """struct(min_days, max_days): [min, max) in days, a year 365 and a month 30 days; null if neither bound is found."""
    s = F.translate(F.replace(c, F.lit(" ")), "＜（）", "<()")
    s = F.replace(F.replace(F.replace(s, F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<=")), F.lit("(含)"), F.lit("含"))
    unit = "(个月|天|日|月|年)"

    def days(pattern: str, plus: bool = False) -> Column:
        u = _got(s, pattern, 2)
        n = F.floor(_got(s, pattern).cast("decimal(12,4)") * F.when(u == "年", 365).when(u.isin("月", "个月"), 30).otherwise(1))
        return n + F.when(u.isin("天", "日"), 1).otherwise(0) if plus else n

    low = F.coalesce(days(rf"(?:大于等于|不少于|>=){_NUM}{unit}"), days(rf"{_NUM}{unit}(?:<=|含)"), days(rf"(?:大于|超过|>){_NUM}{unit}", True))
    high = F.coalesce(days(rf"(?:小于等于|不超过|<=N?){_NUM}{unit}", True), days(rf"(?:小于|少于|不足|<)(?!=){_NUM}{unit}"), days(rf"<N?<?{_NUM}{unit}"))
    return F.when(F.coalesce(low, F.lit(0)).cast("int").isNotNull() & ((F.coalesce(low, F.lit(0)) != 0) | high.isNotNull()), F.struct(F.coalesce(low, F.lit(0)).cast("int").alias("min_days"), high.cast("int").alias("max_days")))


def amount_range(c: Column) -> Column:
    """struct(min_amount, max_amount) in yuan: [min, max)."""
    s = F.translate(F.replace(c, F.lit(" ")), "＜＞（）Ｍ", "<>()M")
    s = F.replace(F.replace(s, F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<="))
    pattern = rf"{_NUM}(万元|万|亿元|元)"
    units = F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(2)), lambda u: F.when(u.contains("万"), 1e4).when(u.contains("亿"), 1e8).otherwise(1.0))
    amounts = F.zip_with(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), units, lambda n, u: n.cast("double") * u)
    first, second, n = F.get(amounts, F.lit(0)), F.get(amounts, F.lit(1)), F.size(amounts)
    row = lambda low, high: F.struct(low.cast("double").alias("min_amount"), high.cast("double").alias("max_amount"))
    return F.when((n == 1) & s.rlike("M<|以下|以内|不足|小于|少于"), row(F.lit(0.0), first)).when((n == 1) & s.rlike("M>|以上|大于|不低于|超过|元<=?M$|万<=?M$"), row(first, F.lit(None))).when(n >= 2, row(first, second))


def fee_value(c: Column) -> Column:
    """struct(rate, fixed_fee): an amount in yuan without a percent sign is a fixed fee, else a rate."""
    s = F.replace(F.replace(c, F.lit(" ")), F.lit(","))
    fixed = F.when(~s.contains("%"), _got(s, rf"{_NUM}元").cast("double"))
    return F.struct(F.when(fixed.isNull(), pct_to_decimal(s).cast("double")).alias("rate"), fixed.alias("fixed_fee"))


# End of fixed values.
def cash_per_unit(c: Column) -> Column:
    """`每N份…派…现金X元` gives X / N; N is 1 if it is not said."""
    return _got(c, rf"派(?:发)?现金(?:红利)?{_NUM}元").cast("double") / F.coalesce(_got(c, rf"每{_NUM}份").cast("double"), F.lit(1.0))


def scale_yi(c: Column) -> Column:
    """A size in units of 10**8."""
    u = _got(c, rf"{_NUM}(亿|万)", 2)
    return _got(c, rf"{_NUM}(亿|万)").cast("double") * F.when(u == "亿", 1.0).otherwise(1e-4)


def pairs_map(cells: Column) -> Column:
    """Alternating keys and values."""
    at = F.sequence(F.lit(0), F.floor(F.size(cells) / 2).cast("int") - 1)
    return F.map_from_arrays(F.transform(at, lambda k: F.get(cells, k * 2)), F.transform(at, lambda k: F.get(cells, k * 2 + 1)))


def base_name(c: Column) -> Column:
    return F.regexp_replace(c, "[A-Z]$", "")


def share_class_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "([A-Z])$", 1), F.lit(""))


def classify_theme(c: Column, one: tuple[str, str], other: tuple[str, str]) -> Column:
    """The name of the only pattern that matches; ``ambiguous`` if both do."""
    a, b = c.rlike(one[1]), c.rlike(other[1])
    return F.when(a & b, "ambiguous").when(a, one[0]).when(b, other[0])


def norm_code(c: Column) -> Column:
    return F.when(F.length(c) < 6, F.lpad(c, 5, "0")).otherwise(c)


def shift_back(day: Column, years: Column | int, months: Column | int) -> Column:
    """Months back, clamped to the month's end; negative months go forward."""
    return F.add_months(day, -(F.lit(12) * years + months).cast("int"))


def is_trading_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def percent(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f%%", c.cast("double") * 100))


def ascii_year(c: Column) -> Column:
    """Chinese digits of a four-digit year before 年 become ASCII digits."""
    year = F.regexp_extract(c, "([〇零○一二三四五六七八九]{4})年", 1)
    return F.when(year != "", F.replace(c, year, F.translate(year, "〇零○一二三四五六七八九", "000123456789"))).otherwise(c)


def chunk_id(doc: Column, number: Column) -> Column:
    return F.format_string("%s#%04d", doc.cast("string"), number.cast("int"))


def garbled_ratio(c: Column, allowed: str = r"[\p{L}\p{N}\p{P}\p{Z}\s]") -> Column:
    """Share of characters outside the allowed ones; 1 for an empty text."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, allowed, "")) / F.length(c)).otherwise(1.0)


def norm_quote(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s|]", "")


def norm_line(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s", ""), r"\d", "#")


def context_header(name: Column, title: Column, section: Column, text: Column) -> Column:
    """`【name｜title｜last section】` and the text; missing parts are left out."""
    last = F.element_at(F.split(section, " > "), -1)
    return F.concat(F.lit("【"), F.concat_ws("｜", name, title, last), F.lit("】\n"), text)


def iso_dates(c: Column) -> Column:
    """All dates of a text, distinct, as ISO strings."""
    pattern = r"(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})"
    parts = [F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    joined = F.zip_with(F.zip_with(parts[0], parts[1], lambda y, m: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))), parts[2], lambda ym, d: F.concat(ym, F.lit("-"), F.lpad(d, 2, "0")))
    return F.array_distinct(joined)


def sql_tables(c: Column) -> Column:
    """Lower-case names after FROM and JOIN."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(?:FROM|JOIN)\s+`?(\w+)"), F.lit(1)), F.lower))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def thread_group(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[-#_ ]?\d+$", ""), r"\[\d+\]|\(\d+\)", "")


def size_bytes(c: Column) -> Column:
    unit = _got(F.trim(c), r"^[\d.]+\s*([A-Za-z]+)$")
    scale = F.coalesce(*[F.when(unit == u, float(n)) for u, n in UNIT_BYTES.items()])
    return _got(F.trim(c), r"^([\d.]+)\s*[A-Za-z]+$").cast("double") * scale


def _parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    day = F.to_date("l_shipdate")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), q.alias("q"), day.alias("day"))
    text = lambda pattern, *c: F.format_string(pattern, *c)
    period = holding_period(text("大于等于%d天，小于%d个月", F.col("q"), F.col("q") + 1))
    amount = amount_range(text("%d万元≤M＜%d亿元", F.col("q"), F.col("q")))
    return rows.select(
        "l_orderkey", "l_linenumber",
        pct_to_decimal(text("%d.50%%（每年）", F.col("q"))).cast("double").alias("rate"),
        to_decimal(text("%d,%03d.25", F.col("q"), F.col("q"))).cast("double").alias("plain"),
        parse_date(F.date_format("day", "yyyy年MM月dd日")).alias("day"),
        quarter_end(quarter_label(F.concat(F.year("day").cast("string"), F.lit("年"), F.quarter("day").cast("string"), F.lit("季度报告")))).alias("quarter_end"),
        period["min_days"].alias("min_days"), period["max_days"].alias("max_days"),
        amount["min_amount"].alias("min_amount"), amount["max_amount"].alias("max_amount"),
        fee_value(text("每笔%d元", F.col("q")))["fixed_fee"].alias("fixed_fee"), fee_value(text("%d%%", F.col("q")))["rate"].alias("fee_rate"),
        cash_per_unit(text("每10份派现金%d元", F.col("q"))).alias("cash"), scale_yi(text("%d万元", F.col("q"))).alias("scale"),
        norm_code(F.col("part").cast("string")).alias("code"), shift_back(F.col("day"), 1, 2).alias("earlier"), is_trading_weekday(F.col("day")).alias("weekday"),
        size_bytes(text("%dMiB", F.col("q"))).alias("bytes"), base_name(text("fund%dC", F.col("q"))).alias("base"), percent(F.col("q") / 100).alias("shown"),
    )


_PARSE_SQL = """
    SELECT l_orderkey, l_linenumber, (q + 0.5) / 100 AS rate, CASE WHEN q > 0 THEN q * 1000 + q + 0.25 ELSE 0.25 END AS plain, day,
      CAST(last_day(make_date(year(day), quarter(day) * 3, 1)) AS DATE) AS quarter_end, q AS min_days, (q + 1) * 30 AS max_days, q * 1e4 AS min_amount, q * 1e8 AS max_amount,
      CAST(q AS DOUBLE) AS fixed_fee, q / 100 AS fee_rate, q / 10 AS cash, q / 10000 AS scale, CASE WHEN len(part) < 6 THEN lpad(part, 5, '0') ELSE part END AS code,
      CAST(day - to_months(14) AS DATE) AS earlier, isodow(day) < 6 AS weekday, q * 1048576.0 AS bytes, concat('fund', q) AS base, concat(q, '.00%') AS shown
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, CAST(l_shipdate AS DATE) AS day, CAST(l_partkey AS VARCHAR) AS part FROM lineitem) x"""


def _text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.length(norm_quote(F.col("text"))).alias("quote_chars"), F.md5(norm_line(F.col("text"))).alias("line_md5"), chunk_id(F.col("doc_id"), F.col("n_chars") % 100).alias("chunk_id"))


_TEXT_SQL = r"""
    SELECT doc_id, len(regexp_replace(text, '[\s|]', '', 'g')) AS quote_chars, md5(regexp_replace(regexp_replace(text, '\s', '', 'g'), '[0-9]', '#', 'g')) AS line_md5,
      concat(doc_id, '#', lpad(CAST(n_chars % 100 AS VARCHAR), 4, '0')) AS chunk_id FROM documents"""


def _text_docs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph blocks of documents: one for each non-empty stripped line."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.trim("line").alias("line")).where("line <> ''").select("doc_id", "line_no", F.md5("line").alias("line_md5"))

# Units that large amounts are published in, with their power of ten.
AMOUNT_UNITS = {"股": 0, "元": 0, "份": 0, "万股": 4, "万元": 4, "万份": 4, "亿元": 8, "亿份": 8}
# End of fixed values.


def rescale(amount: Column, unit: Column) -> Column:
    """An amount in shares or yuan, in decimal arithmetic; null for an unknown unit."""
    power = F.coalesce(*[F.when(unit == name, F.lit(10**k)) for name, k in AMOUNT_UNITS.items()]).cast("decimal(9,0)")
    return (amount.cast("decimal(24,4)") * power).cast("decimal(33,4)")


_FINAL = "struct<status:string,cache_hit:boolean,timings_ms:struct<total:double,first_token:double,llm:double,tools:double>,tool_rounds:bigint,tools:array<struct<name:string,duration_ms:double>>,usage:map<string,double>,response_models:array<string>>"


def final_event(text: Column) -> Column:
    """The final event of an answer's log (JSON) as a flat struct; what is missing, or no JSON, gives nulls."""
    event = F.from_json(text, _FINAL)
    times = [event["timings_ms"][part].alias(f"server_{part}_ms") for part in ("total", "first_token", "llm", "tools")]
    return F.struct(event["status"].alias("status"), event["cache_hit"].alias("cache_hit"), *times, event["tool_rounds"].alias("tool_rounds"), event["tools"].alias("tools"), event["usage"].alias("usage"), event["response_models"].alias("response_models"))


def markdown_table(rows: Column) -> Column:
    """Rows of cells (array of arrays) as a Markdown table with the first row as header. White space in cells goes, bars are
    escaped, rows and columns without content are left out and short rows filled up; no content gives an empty text."""
    clean = lambda c: F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""), F.lit("|"), F.lit("\\|"))
    # A value that is used in a function of each row is formed once, as an argument; as a plain column it would be formed
    # again for every row.
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def places(grid: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
        filled = lambda k: F.exists(grid, lambda r: F.coalesce(F.get(r, k), F.lit("")) != "")
        return F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), filled)

    def text(grid: Column, kept: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(kept, lambda k: F.coalesce(F.get(r, k), F.lit(""))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(kept)))
        table = lambda lines: F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")
        return F.when(F.size(grid) > 0, once(F.transform(grid, line), table)).otherwise("")

    grid = F.filter(F.transform(rows, lambda r: F.transform(r, clean)), lambda r: F.array_join(r, "") != "")
    return once(grid, lambda g: once(places(g), lambda kept: text(g, kept)))


QUERIES = {"p_parsers": _parse_query, "p_text_norms": _text_query, "c6_text_blocks": _text_docs_query}
ORACLE_SQL = {
    "p_parsers": _PARSE_SQL,
    "p_text_norms": _TEXT_SQL,
    "c6_text_blocks": r"SELECT doc_id, CAST(k - 1 AS INT) AS line_no, md5(trim(line, ' ')) AS line_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) x WHERE trim(line, ' ') <> ''",
}
