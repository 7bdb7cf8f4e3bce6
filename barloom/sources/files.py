"""Readers of landed files. Schemas are fixed, never inferred; what cannot be read reliably becomes a NULL, a status or a problem row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.values import date_parse, finite, isin_norm, iso_date, num_parse, stamp_parse, symbol_norm
from barloom.operators.cleaning import OPTIONAL, REQUIRED
from barloom.rules import Rules
from barloom.session import cut_lineage

# Kinds of failed requests and the limits of the observation ledgers.
FAILURE_KINDS = ("access_denied", "rate_limited", "server_error", "http_error", "invalid_response", "undecodable", "mismatch")
TRANSIENT_KINDS = ("rate_limited", "server_error")
RECENT_DAYS, MAX_CHECKS, RECHECK_DAYS, MAX_GAP_DAYS, RETRY_DAYS = 3, 3, 7, 10, 1
QUARTER_START = "2021-09-30"


def file_stem() -> Column:
    return F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[A-Za-z]+)*$", 1)


def text_lines(spark: SparkSession, path: str, file: Column | None = None) -> DataFrame:
    """Non-blank lines with the file they are from and their order inside it."""
    name = file_stem() if file is None else file
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(name.alias("file"), at.alias("at"), F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")


def landed_lines(spark: SparkSession, path: str, file: Column | None = None) -> DataFrame:
    """The lines of landed files as a stored table: the text is read once, and every later look at it sees the same order of lines."""
    return cut_lineage(text_lines(spark, path, file), "lines")


def empty_files(spark: SparkSession, path: str, name: str = r"([^/]+?)(?:\.[A-Za-z]+)*$") -> DataFrame:
    """`file` of every landed file without a byte, at any depth. Scans of every format skip these, so they come from the listing; only their names are kept."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, names = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith((".", "_")):
            names.append((f.getPath().toString(),))
    return spark.createDataFrame(names, "path string").select(F.regexp_extract("path", name, 1).alias("file")).distinct()


def _split(line: Column) -> Column:
    """Comma-separated fields as they stand; a quoted field may hold commas (only lines with a quote pay for that)."""
    outside = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    quoted = F.transform(F.split(line, outside), lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ","))


def _fields(line: Column) -> Column:
    return F.transform(_split(line), lambda c: F.trim(c))


def _heads(lines: DataFrame) -> DataFrame:
    """The header of every file and the place `_at` of its line, stored (one row per file). Over all lines only numbers are compared, so each task keeps one row a file and block."""
    first = lines.groupBy("file", F.col("at.block").alias("block")).agg(F.min("at.row").alias("row")).groupBy("file").agg(F.min(F.struct("block", "row")).alias("_at"))
    return cut_lineage(lines.join(F.broadcast(first), "file").where(F.col("at") == F.col("_at")).select("file", _fields(F.col("value")).alias("header"), "_at"), "heads")


def _headed(lines: DataFrame) -> DataFrame:
    """Data lines split into fields, with their file's header. The header's own row has neither `at` nor `fields`. The headers go to the lines, which stay where they are."""
    body = F.col("at") != F.col("_at")
    return lines.join(F.broadcast(_heads(lines)), "file").select("file", "header", F.when(body, F.col("at")).alias("at"), F.when(body, _fields(F.col("value"))).alias("fields"))


def name_date(file: Column) -> Column:
    return F.when(file.rlike(r"^bhav_\d{8}$"), F.try_to_date(F.substring(file, 6, 8), "yyyyMMdd"))


def _field(name: str) -> Column:
    return F.get("fields", (F.array_position("header", name) - 1).cast("int"))


def bhav_verdicts(lines: DataFrame, today: str, rules: Rules = Rules(), empty: DataFrame | None = None) -> DataFrame:
    """One status per daily file. Its lines are counted by width, date and series as they stand, each task on its own; dates are read once per such kind of line.
    With `empty` (`empty_files`) files without content have their row too. Bytes that are no UTF-8 arrive as replacement characters, and their file is malformed."""
    heads = _heads(lines)
    at = lambda name: (F.array_position("header", name) - 1).cast("int").alias(f"_{name}")
    body = F.col("at") != F.col("_at")
    split = lines.join(F.broadcast(heads.select("file", "_at", at("DATE1"), at("SERIES"))), "file").select(
        "file", body.alias("has"), F.contains("value", F.lit("\ufffd")).alias("garbled"), "_DATE1", "_SERIES", F.when(body, _split(F.col("value"))).alias("_line"))
    field = lambda name: F.trim(F.get("_line", F.col(f"_{name}")))
    kinds = split.select("file", "has", "garbled", F.size("_line").alias("width"), field("DATE1").alias("dated"), field("SERIES").alias("series")).groupBy("file", "has", "garbled", "width", "dated", "series").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.join(F.broadcast(heads.select("file", "header")), "file").withColumn("dated", date_parse("dated"))
    day = name_date(F.col("file"))
    has, ragged = F.col("has"), F.col("has") & (F.col("width") != F.size("header"))
    whole, dated = has & ~ragged, F.col("dated")
    number = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    g = kinds.groupBy("file").agg(number(has).alias("rows"), number(ragged).alias("ragged"), number(whole & ~dated.eqNullSafe(day)).alias("wrong"), number(whole & (F.col("series") == "EQ")).alias("eq_rows"),
                                  F.min(F.when(whole, dated)).alias("lo"), F.max(F.when(whole, dated)).alias("hi"), number(whole & dated.isNull()).alias("undated"), F.max("garbled").alias("garbled"))
    g = g.join(F.broadcast(heads.select("file", "header")), "file")                                              # one row per file
    if empty is not None:
        g = g.unionByName(empty.select("file", *[F.lit(0).alias(c) for c in ("rows", "ragged", "wrong", "eq_rows", "undated")]), allowMissingColumns=True)
    missing = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), "header")
    status = (F.when(day.isNull(), "bad_file_name").when(F.col("header").isNull(), "empty").when(F.col("garbled"), "malformed").when(F.size(missing) > 0, "missing_columns").when(F.col("rows") == 0, "empty").when(F.col("ragged") / F.col("rows") > 0.01, "malformed").when(F.col("wrong") > 0, "date_mismatch")
              .when(F.weekday(day) >= 5, "weekend_file").when(day > F.lit(today).cast("date"), "future_date").when(F.col("eq_rows") < rules.min_eq_rows, "partial").otherwise("ok"))
    one = (F.col("undated") == 0) & (F.col("lo") == F.col("hi")) & (F.weekday(day) < 5) & (F.weekday("lo") < 5) & (F.col("lo") < day) & (F.datediff(day, "lo") <= MAX_GAP_DAYS)
    return g.select("file", day.alias("date"), status.alias("status"), (F.col("rows") - F.col("ragged")).alias("rows"), "eq_rows", F.when((status == "date_mismatch") & one, F.col("lo")).alias("stale_copy_of"))


def bhav_rows(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Text rows of the accepted files under the fixed column names; ragged rows are dropped."""
    ok = verdicts.where("status = 'ok'").select("file")
    rows = _headed(lines).where(F.col("at").isNotNull() & (F.size("fields") == F.size("header"))).join(ok, "file", "left_semi")
    return rows.select("file", *[_field(c).alias(c) for c in REQUIRED + OPTIONAL])


def _listed_csv(spark: SparkSession, path: str, *needed: tuple[str, ...]) -> DataFrame:
    """Data rows of all CSV files under a path, each with its own file's header reduced to lower-case letters and digits, and `_at`, the order of the lines. Files may have
    their columns in any order; one that has none of the `needed` names is refused."""
    rows = _headed(landed_lines(spark, path, F.col("_metadata.file_path")))
    rows = rows.withColumn("header", F.transform("header", lambda h: F.regexp_replace(F.lower(h), r"[^\p{L}\p{N}]", "")))
    for names in needed:
        bad = rows.where(~F.arrays_overlap("header", F.array(*[F.lit(n) for n in names]))).select("file").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0].file} has no column {' or '.join(names)}")
    return rows.where("at IS NOT NULL").withColumn("_at", F.struct("file", "at"))


def _cell(*names: str) -> Column:
    """The field under the first of these header names that the row's file has."""
    return F.coalesce(*[_field(n) for n in names])


def read_index_csv(spark: SparkSession, path: str) -> DataFrame:
    """Index constituents: EQ only, first line per symbol."""
    df = _listed_csv(spark, path, ("symbol",))
    series = F.upper(F.trim(F.coalesce(F.nullif(_cell("series"), F.lit("")), F.lit("EQ"))))
    rows = df.select(symbol_norm(_cell("symbol")).alias("symbol"), series.alias("s"), isin_norm(_cell("isincode")).alias("isin"), F.nullif(F.trim(_cell("companyname")), F.lit("")).alias("name"), "_at").where("symbol IS NOT NULL AND s = 'EQ'")
    return rows.groupBy("symbol").agg(F.min_by(F.struct("isin", "name"), "_at").alias("r")).select("symbol", "r.*")


def read_reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reference list with normalised headers; a malformed identifier becomes ''; a file without an ISIN column is refused."""
    isin = ("isin", "isinnumber", "isincode", "isinno")
    df = _listed_csv(spark, path, isin)
    text = lambda name: F.coalesce(F.upper(F.trim(_cell(name))), F.lit(""))
    return df.select(F.coalesce(isin_norm(_cell(*isin)), F.lit("")).alias("isin"), text("symbol").alias("symbol"), text("series").alias("series"))


def read_etf_list_csv(spark: SparkSession, path: str, exhaustive: bool) -> DataFrame:
    df = _listed_csv(spark, path, ("symbol",))
    return df.select(F.upper(F.trim(_cell("symbol"))).alias("symbol")).where("symbol <> ''").distinct().withColumn("exhaustive", F.lit(bool(exhaustive)))


INSTRUMENT_SCHEMA = "segment string, instrument_key string, trading_symbol string, isin string, security_type string, instrument_type string, name string"


def read_instruments_json(spark: SparkSession, path: str, series: Sequence[str] = ("EQ", "BE"), multiline: bool = False) -> DataFrame:
    """Instrument master (gz or plain) to symbol -> (isin, name); an EQ row beats a BE row, a later row beats an earlier one of its kind."""
    j = spark.read.schema(INSTRUMENT_SCHEMA).option("multiLine", multiline).json(path)
    at = F.struct((F.col("instrument_type") == "EQ").alias("eq"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    rows = j.select(F.upper(F.trim("trading_symbol")).alias("symbol"), "isin", "name", "segment", "instrument_type", at.alias("_at"))
    rows = rows.where(F.col("instrument_type").isin(*series) & (F.col("segment") == "NSE_EQ") & (F.col("symbol") != "") & (F.col("isin") != ""))
    return rows.groupBy("symbol").agg(F.max_by(F.struct("isin", "name"), "_at").alias("r")).select("symbol", "r.*")


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated ISO dates; every other token is ignored."""
    token = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("t"))
    return token.select(iso_date(F.col("t")).alias("date")).where("date IS NOT NULL").distinct()


def _ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = text_lines(spark, path).where(~F.startswith(F.trim("value"), F.lit("#")))
    return lines.select("file", "at", "value", F.split(F.trim("value"), r"\s+").alias("p"))


def _history_problem(count: Column, first: Column, last: Column, step: int) -> Column:
    span = F.datediff(last, first)
    return F.when(first > last, "first_after_last").when((count == 1) & (span != 0), "one_check_two_dates").when(span < (count - 1) * step, "checks_too_close")


def _judge(rows: DataFrame, key: str, why: Column) -> DataFrame:
    """First line per requested day stays; a later one is a repeat. All lines are returned, each with its problem or NULL."""
    r = rows.withColumn("_why", why)
    first = r.where("_why IS NULL").groupBy(key).agg(F.min("at").alias("_first"))
    j = r.join(first, key, "left")
    return j.withColumn("problem", F.coalesce("_why", F.when(F.col("at") != F.col("_first"), "listed_twice"))).drop("_why", "_first")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation lines (requested, served, first_seen, last_checked, checks) with their problem or NULL; no line is dropped silently."""
    p = lambda i: F.get("p", F.lit(i))
    rows = _ledger_lines(spark, path).select("at", "value", F.size("p").alias("n"), *[iso_date(p(i)).alias(c) for i, c in enumerate(("requested", "served", "first_seen", "last_checked"))],
                                             F.when(p(4).rlike(rf"^[1-{MAX_CHECKS}]$"), p(4).try_cast("int")).alias("checks"))
    req, srv = F.col("requested"), F.col("served")
    why = (F.when(F.col("n") != 5, "expected_5_fields").when(F.greatest(*[F.col(c).isNull() for c in ("requested", "served", "first_seen", "last_checked", "checks")]), "bad_field").when(F.weekday(req) >= 5, "requested_weekend")
           .when(F.weekday(srv) >= 5, "served_weekend").when(srv >= req, "served_not_earlier").when(F.datediff(req, srv) > MAX_GAP_DAYS, "served_too_old")
           .otherwise(F.coalesce(_history_problem(F.col("checks"), F.col("first_seen"), F.col("last_checked"), RECHECK_DAYS), F.when(F.datediff("first_seen", req) <= RECENT_DAYS, "seen_too_soon"))))
    return _judge(rows, "requested", why).select("value", "requested", "served", "first_seen", "last_checked", "checks", "problem")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure lines (requested, kind, first_seen, last_attempt, attempts) with their problem or NULL."""
    p = lambda i: F.get("p", F.lit(i))
    rows = _ledger_lines(spark, path).select("at", "value", F.size("p").alias("n"), iso_date(p(0)).alias("requested"), p(1).alias("kind"), iso_date(p(2)).alias("first_seen"), iso_date(p(3)).alias("last_attempt"),
                                             F.when(p(4).rlike(r"^[1-9]\d*$"), p(4).try_cast("int")).alias("attempts"))
    cap = F.when(F.col("kind").isin(*FAILURE_KINDS) & ~F.col("kind").isin(*TRANSIENT_KINDS), 4).otherwise(8)
    why = (F.when(F.col("n") != 5, "expected_5_fields").when(F.greatest(*[F.col(c).isNull() for c in ("requested", "first_seen", "last_attempt", "attempts")]) | (F.col("attempts") > cap), "bad_field")
           .when(~F.col("kind").isin(*FAILURE_KINDS), "unknown_kind").when(F.weekday("requested") >= 5, "requested_weekend")
           .otherwise(F.coalesce(_history_problem(F.col("attempts"), F.col("first_seen"), F.col("last_attempt"), RETRY_DAYS), F.when(F.datediff("first_seen", "requested") <= RECENT_DAYS, "seen_too_soon"))))
    return _judge(rows, "requested", why).select("value", "requested", "kind", "first_seen", "last_attempt", "attempts", "problem")


CANDLE_SCHEMA = "symbol string, candles array<array<string>>"


def read_candles_json(spark: SparkSession, path: str) -> DataFrame:
    """History documents {symbol, candles: [[ts, o, h, l, c, v], ...]}: a row with a missing or non-positive price or high < low is dropped, a
    negative volume is NULL."""
    c = spark.read.schema(CANDLE_SCHEMA).json(path).select("symbol", F.explode("candles").alias("c"))
    n = lambda i: finite(F.get("c", F.lit(i)).try_cast("double"))
    rows = c.select("symbol", iso_date(F.substring(F.get("c", F.lit(0)), 1, 10)).alias("date"), n(1).alias("open"), n(2).alias("high"), n(3).alias("low"), n(4).alias("close"), n(5).alias("v"))
    ok = F.col("date").isNotNull() & (F.least("open", "high", "low", "close") > 0) & (F.col("high") >= F.col("low"))
    for p in ("open", "high", "low", "close"):
        ok = ok & F.col(p).isNotNull()
    return rows.where(ok).select("symbol", "date", "open", "high", "low", "close", F.when(F.col("v") >= 0, F.col("v").cast("bigint")).alias("volume"))


STATEMENT_SCHEMA = ("symbol string, time_period string, full_statement array<struct<particular:string,history:array<struct<period:string,value:double>>>>, "
                    "income_statement array<struct<category:string,history:array<struct<period:string,value:double,change:double>>>>")


def read_statement_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed statement responses, nested as received; `statements.statement_lines` makes them long."""
    d = spark.read.schema(STATEMENT_SCHEMA).json(path)
    slim = lambda x: F.struct(x["category"].alias("category"), F.transform(x["history"], lambda h: F.struct(h["period"].alias("period"), h["value"].alias("value"))).alias("history"))
    return d.withColumn("income_statement", F.transform("income_statement", slim))


CONTEXT_SCHEMA = "_id string, period struct<instant:string,endDate:string>, scenario struct<explicitMember:array<struct<_VALUE:string,_dimension:string>>,typedMember:array<struct<_dimension:string>>>"
FACT_SCHEMA = "_VALUE string, _contextRef string"


def read_xbrl_facts(spark: SparkSession, path: str) -> DataFrame:
    """A folder of instance files to category rows per (file, member, period): contexts with exactly one shareholder-category member, holder details
    left out, a value repeated differently flagged. Contexts and facts meet inside their file."""
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)
    c = xml("context", CONTEXT_SCHEMA).select(F.col("_metadata.file_path").alias("file"), F.col("_id").alias("ctx"), F.coalesce("period.instant", "period.endDate").alias("period"), F.col("scenario.explicitMember").alias("m"),
                                              F.coalesce(F.size("scenario.typedMember"), F.lit(0)).alias("typed"))
    name = F.regexp_replace(F.get("m", F.lit(0))["_VALUE"], "^.*:", "")
    c = c.where((F.size("m") == 1) & (F.col("typed") <= 0) & F.endswith(F.get("m", F.lit(0))["_dimension"], F.lit("CategoryOfShareholdersAxis"))).select("file", "ctx", "period", name.alias("name")).where(~F.contains("name", F.lit("_Context")) & ~F.startswith("name", F.lit("Details")))
    # The two fact elements that count.
    facts = None
    for field, tag in (("shares", "NumberOfFullyPaidUpEquityShares"), ("pct", "ShareholdingAsAPercentageOfTotalNumberOfShares")):
        one = xml(tag, FACT_SCHEMA).select(F.col("_metadata.file_path").alias("file"), F.col("_contextRef").alias("ctx"), F.lit(field).alias("field"), num_parse("_VALUE").alias("value"))
        facts = one if facts is None else facts.unionByName(one)
    member = F.regexp_replace(F.lower(F.regexp_replace("name", "[^A-Za-z0-9]", "")), "member$", "")
    j = facts.join(c, ["file", "ctx"]).withColumn("member", member)
    at = lambda f, agg: agg(F.when(F.col("field") == f, F.col("value")))
    g = j.groupBy("file", "member", "period").agg(at("shares", F.min).alias("shares"), at("shares", F.max).alias("_s"), at("pct", F.min).alias("pct"), at("pct", F.max).alias("_p"))
    return g.select("file", "member", F.to_date("period").alias("period"), "shares", "pct", ((F.col("shares") != F.col("_s")) | (F.col("pct") != F.col("_p"))).alias("conflict"))


FILING_SCHEMA = "symbol string, date string, recordId string, broadcastDate string, xbrl string"


def read_filing_index(spark: SparkSession, path: str, start: str = QUARTER_START) -> DataFrame:
    """Every filing of the index with `reason` NULL for the one kept per (symbol, quarter end): the latest broadcast, then the highest record id."""
    r = spark.read.schema(FILING_SCHEMA).json(path).withColumns({"day": date_parse("date"), "stamp": stamp_parse("broadcastDate"), "rid": num_parse("recordId")})
    d = F.col("day")
    why = (F.when(d.isNull(), "unparsable_date").when((d != F.last_day(d)) | (F.month(d) % 3 != 0), "off_cycle").when(d < F.lit(start).cast("date"), "before_window"))
    r = r.withColumn("_why", why)
    key = F.struct(F.coalesce("stamp", F.lit("1900-01-01").cast("timestamp")).alias("s"), F.coalesce("rid", F.lit(0.0)).alias("r"))
    best = r.where("_why IS NULL").groupBy("symbol", "day").agg(F.max(key).alias("_best"))
    j = r.withColumn("_key", key).join(best, ["symbol", "day"], "left")
    return j.select("symbol", "day", F.col("recordId").alias("record_id"), "stamp", "xbrl", F.coalesce("_why", F.when(F.col("_key") != F.col("_best"), "superseded")).alias("reason"))


TICK_SCHEMA = "key bigint, seq bigint, recv_ms bigint, ltp double, ltt bigint, cp double, connection_id bigint, session_date date"


def tick_recording(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Recorded decoded ticks as a stream (the trigger bounds each micro-batch)."""
    return spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


EVENT_SCHEMA = "events array<struct<symbol:string,date:string,event_type:string,title:string,description:string,value:double,currency:string,unit:string,measure:string,segment:string,status:string,source_name:string,source_url:string,source_date:string,retrieved_on:string,evidence_quote:string>>"


def read_growth_events(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Curated events with their validity."""
    from barloom.operators.quality import growth_event_valid
    return spark.read.schema(EVENT_SCHEMA).option("multiLine", multi_line).json(path).select(F.inline("events")).withColumn("valid", growth_event_valid())


OFFICIAL_SCHEMA = "records array<struct<symbol:string,company:string,fy:int,period:string,basis:string,values:map<string,double>,fields:map<string,map<string,string>>>>"


def read_official_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Hand-verified annual records; `unsourced` lists values without a provenance entry (such a record is not sound). One document per file,
    or one per line when `multi_line` is off."""
    r = spark.read.schema(OFFICIAL_SCHEMA).option("multiLine", multi_line).json(path).select(F.inline("records"))
    have = F.map_keys(F.map_filter("values", lambda k, v: v.isNotNull()))
    return r.withColumns({"unsourced": F.array_except(have, F.map_keys("fields")), "sound": F.size(F.array_except(have, F.map_keys("fields"))) == 0})


PROFILE_SCHEMA = "companies array<struct<symbol:string,description:string,source_name:string,source_url:string,evidence_quote:string>>"


def read_company_profiles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).option("multiLine", multi_line).json(path).select(F.inline("companies"))


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    """Highest count per run key; torn lines are ignored."""
    j = spark.read.schema("run string, calls bigint").option("mode", "DROPMALFORMED").json(path)
    return j.where("run IS NOT NULL AND calls IS NOT NULL").groupBy("run").agg(F.max("calls").alias("calls"))
