"""Sectors, instruments and reference data over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.joins import BUCKETED, sector_rows
from barloom.catalog.model_sql import INSTRUMENTS, sql
from barloom.catalog.registry import query
from barloom.functions.values import symbol_norm
from barloom.operators import joins as J
from barloom.operators import reference as R
from barloom.operators import sectors as X
from barloom.rules import Rules
from barloom.session import cut_lineage
from barloom.sources.market import instruments, table

SECTORS = BUCKETED + """,
sectors AS (SELECT *, CASE WHEN reason IS NULL THEN round(med, 2) END AS median_1d_pct, CASE WHEN reason IS NULL THEN round(avg_pct, 2) END AS mean_1d_pct, reason IS NULL AS eligible FROM (SELECT *,
 CASE WHEN counted < 2 THEN 'too_few_valid' WHEN counted / member_count::DOUBLE < 0.8 THEN 'too_many_invalid' END AS reason FROM (SELECT sector_key, min(sector_source_label) AS label, count(*) AS member_count, count(change) AS counted,
 count(*) FILTER (change > 0) AS advances, count(*) FILTER (change < 0) AS declines, count(*) FILTER (change = 0) AS unchanged, round(count(*) FILTER (change > 0)::DOUBLE / nullif(count(change), 0) * 100, 2) AS breadth_pct,
 median(change_pct) AS med, CAST(sum(CAST(round(change_pct * 100) AS BIGINT)) AS DOUBLE) / nullif(count(change_pct), 0) / 100 AS avg_pct, CAST(sum(volume) AS BIGINT) AS volume, count(volume) AS volume_count
 FROM bucketed WHERE bucket = 'in_sector' GROUP BY 1)))"""
FEW = Rules().but(min_sector_members=2)


@query("sector_performance", sql("SELECT sector_key, label, member_count, counted, advances, declines, unchanged, breadth_pct, median_1d_pct, mean_1d_pct, volume, volume_count, eligible, reason FROM sectors", SECTORS))
def _(spark, d):
    return X.sector_performance(sector_rows(spark, d), FEW)


@query("sector_availability", sql("""SELECT eq_rows, etf, in_sector, round(cov, 4) AS coverage, round(fr, 4) AS fresh_share, eligible_sectors, reason IS NULL AS available, reason FROM (SELECT *, CASE WHEN in_master = 0 THEN 'master_empty' WHEN cov < 0.8 THEN 'coverage_too_low'
  WHEN fr < 0.9 THEN 'labels_stale' WHEN eligible_sectors < 3 THEN 'too_few_sectors' END AS reason FROM (SELECT count(*) AS eq_rows, count(*) FILTER (bucket = 'etf') AS etf, count(*) FILTER (bucket = 'in_sector') AS in_sector, count(*) FILTER (bucket <> 'not_in_master') AS in_master,
  count(*) FILTER (bucket = 'in_sector')::DOUBLE / (count(*) - count(*) FILTER (bucket = 'etf')) AS cov, count(*) FILTER (bucket = 'in_sector' AND DATE '2001-11-04' - last_confirmed BETWEEN 0 AND 60)::DOUBLE / count(*) FILTER (bucket = 'in_sector') AS fr,
  (SELECT count(*) FROM sectors WHERE eligible) AS eligible_sectors FROM bucketed))""", SECTORS))
def _(spark, d):
    rows = cut_lineage(sector_rows(spark, d), "sector-rows")
    return X.sector_availability(rows, X.sector_performance(rows, FEW), "2001-11-04", FEW)


@query("sector_leaders", sql("""SELECT 'leaders' AS list, sector_key, median_1d_pct, member_count, rank FROM (SELECT *, row_number() OVER (ORDER BY median_1d_pct DESC, sector_key) AS rank FROM sectors WHERE eligible) WHERE rank <= 5
 UNION ALL SELECT 'laggards', sector_key, median_1d_pct, member_count, rank FROM (SELECT *, row_number() OVER (ORDER BY median_1d_pct, sector_key) AS rank FROM sectors WHERE eligible) WHERE rank <= 5""", SECTORS))
def _(spark, d):
    return X.sector_leaders(cut_lineage(X.sector_performance(sector_rows(spark, d), FEW), "sectors"), FEW)


@query("sector_listings", sql("""SELECT 'top' AS list, sector_key, symbol, close, change_pct, volume, rank FROM (SELECT *, row_number() OVER (PARTITION BY sector_key ORDER BY change_pct DESC, symbol) AS rank FROM bucketed WHERE bucket = 'in_sector' AND turnover >= 100 AND change_pct IS NOT NULL) WHERE rank <= 5
 UNION ALL SELECT 'bottom', sector_key, symbol, close, change_pct, volume, rank FROM (SELECT *, row_number() OVER (PARTITION BY sector_key ORDER BY change_pct, symbol) AS rank FROM bucketed WHERE bucket = 'in_sector' AND turnover >= 100 AND change_pct IS NOT NULL) WHERE rank <= 5""", BUCKETED))
def _(spark, d):
    return X.sector_listings(sector_rows(spark, d))


def lists(spark, d):
    k, p = F.col("p_partkey"), table(spark, d, "part")
    isin = F.concat(F.lit("INE"), F.lpad(k.cast("string"), 9, "0"))
    sym = F.concat(F.upper(F.substring("p_type", 1, 3)), k)
    eql = p.where(k % 4 != 1).select(F.lit("EQL").alias("list"), isin.alias("isin"), F.when(k % 25 == 0, F.concat(sym, F.lit("X"))).otherwise(sym).alias("symbol"),
                                     F.when(k % 9 == 1, "BE").when(k % 9 == 2, "BZ").when(k % 9 == 3, "SM").otherwise("EQ").alias("series"))
    second = p.where(k % 59 == 0).select(F.lit("EQL").alias("list"), isin.alias("isin"), sym.alias("symbol"), F.lit("BE").alias("series"))
    sme = p.where(k % 47 == 0).select(F.lit("SME").alias("list"), isin.alias("isin"), sym.alias("symbol"), F.lit("SM").alias("series"))
    etf = p.where(k % 37 == 0).select(F.lit("ETF").alias("list"), isin.alias("isin"), sym.alias("symbol"), F.lit("EQ").alias("series"))
    return eql.unionByName(second).unionByName(sme).unionByName(etf)


def classified(spark, d):
    return R.instrument_status(instruments(spark, d).where("segment = 'NSE_EQ'"), lists(spark, d))


CLASSIFIED = INSTRUMENTS + """,
lists AS (SELECT 'EQL' AS list, 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS isin, upper(substr(p_type, 1, 3)) || p_partkey || CASE WHEN p_partkey % 25 = 0 THEN 'X' ELSE '' END AS symbol,
  CASE p_partkey % 9 WHEN 1 THEN 'BE' WHEN 2 THEN 'BZ' WHEN 3 THEN 'SM' ELSE 'EQ' END AS series FROM part WHERE p_partkey % 4 <> 1
 UNION ALL SELECT 'EQL', 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), upper(substr(p_type, 1, 3)) || p_partkey, 'BE' FROM part WHERE p_partkey % 59 = 0
 UNION ALL SELECT 'SME', 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), upper(substr(p_type, 1, 3)) || p_partkey, 'SM' FROM part WHERE p_partkey % 47 = 0
 UNION ALL SELECT 'ETF', 'INE' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), upper(substr(p_type, 1, 3)) || p_partkey, 'EQ' FROM part WHERE p_partkey % 37 = 0),
ref AS (SELECT isin, bool_or(list = 'SME') AS in_sme, bool_or(list = 'ETF') AS in_etf, bool_or(list = 'EQL') AS in_eql, string_agg(DISTINCT CASE WHEN list = 'EQL' THEN series END, '/' ORDER BY CASE WHEN list = 'EQL' THEN series END) AS series,
  count(DISTINCT CASE WHEN list = 'EQL' THEN series END) AS ns FROM lists GROUP BY 1),
base AS (SELECT row_id, coalesce(instrument_key, '') AS key, coalesce(upper(trim(trading_symbol)), '') AS symbol, coalesce(isin, '') AS isin_raw, CASE WHEN regexp_full_match(isin, '[A-Z]{2}[A-Z0-9]{9}[0-9]') THEN isin END AS isin,
  coalesce(security_type, '') AS sec, instrument_type, name FROM instruments WHERE segment = 'NSE_EQ'),
joined AS (SELECT b.*, coalesce(in_sme, false) AS in_sme, coalesce(in_etf, false) AS in_etf, coalesce(in_eql, false) AS in_eql, series, coalesce(ns, 0) AS ns FROM base b LEFT JOIN ref r ON b.isin = r.isin),
classified AS (SELECT *, CASE WHEN key = '' THEN 'review_structural' WHEN in_sme THEN 'excluded_sme' WHEN in_etf THEN 'excluded_etf' WHEN ns > 1 THEN 'review_conflict' WHEN sec = 'PCA' THEN 'review_pca' WHEN series = 'BZ' THEN 'excluded_bz'
  WHEN series = 'BE' THEN 'eligible_be' WHEN series = 'EQ' THEN 'eligible_eq' WHEN in_eql THEN 'review_other_series' ELSE 'review_unmatched' END AS status,
  array_to_string(list_sort(list_filter([CASE WHEN in_sme THEN 'SME' END, CASE WHEN in_etf THEN 'ETF' END, CASE WHEN in_eql THEN 'EQL:' || series END, CASE WHEN sec = 'PCA' THEN 'PCA' END], lambda x: x IS NOT NULL)), '+') AS memberships,
  array_to_string(list_sort(list_filter([CASE WHEN isin_raw = '' THEN 'no_isin' END, CASE WHEN isin_raw <> '' AND isin IS NULL THEN 'malformed_isin' END, CASE WHEN in_sme::INT + in_etf::INT + in_eql::INT > 1 THEN 'multi_reference' END,
   CASE WHEN in_sme AND symbol NOT IN (SELECT symbol FROM lists l WHERE l.isin = joined.isin AND list = 'SME') THEN 'symbol_differs_from_SME_record' END, CASE WHEN in_etf AND symbol NOT IN (SELECT symbol FROM lists l WHERE l.isin = joined.isin AND list = 'ETF') THEN 'symbol_differs_from_ETF_record' END,
   CASE WHEN in_eql AND symbol NOT IN (SELECT symbol FROM lists l WHERE l.isin = joined.isin AND list = 'EQL') THEN 'symbol_differs_from_EQL_record' END, CASE WHEN NOT in_sme AND symbol IN (SELECT symbol FROM lists WHERE list = 'SME') THEN 'symbol_only_match_SME' END,
   CASE WHEN NOT in_etf AND symbol IN (SELECT symbol FROM lists WHERE list = 'ETF') THEN 'symbol_only_match_ETF' END, CASE WHEN NOT in_eql AND symbol IN (SELECT symbol FROM lists WHERE list = 'EQL') THEN 'symbol_only_match_EQL' END], lambda x: x IS NOT NULL)), ',') AS flags FROM joined)"""


@query("instrument_status", sql("SELECT row_id, symbol, status FROM classified", CLASSIFIED))
def _(spark, d):
    return classified(spark, d).select("row_id", "symbol", "status")


@query("join_reference_membership", sql("SELECT row_id, memberships, flags FROM classified", CLASSIFIED))
def _(spark, d):
    return classified(spark, d).select("row_id", "memberships", F.array_join("flags", ",").alias("flags"))


@query("status_partition", sql("SELECT status, count(*) AS rows FROM classified GROUP BY 1", CLASSIFIED))
def _(spark, d):
    return R.status_partition(classified(spark, d))


@query("overlap_counts", sql("SELECT memberships, status, count(*) AS rows FROM classified WHERE memberships <> '' GROUP BY 1, 2", CLASSIFIED))
def _(spark, d):
    return R.overlap_counts(classified(spark, d))


@query("duplicate_groups", sql("SELECT kind, value, count(*) AS rows FROM (SELECT 'symbol' AS kind, symbol AS value FROM classified UNION ALL SELECT 'isin', isin FROM classified UNION ALL SELECT 'instrument_key', key FROM classified) WHERE value <> '' GROUP BY 1, 2 HAVING count(*) > 1", CLASSIFIED))
def _(spark, d):
    return R.duplicate_groups(classified(spark, d))


def _lines(spark, d):
    return classified(spark, d).select("status", F.concat_ws("|", "isin", "symbol", "key", "status").alias("line"))


HASHES = """numbered AS (SELECT status, line, row_number() OVER (PARTITION BY status ORDER BY line) - 1 AS p FROM (SELECT status, coalesce(isin, '') || '|' || symbol || '|' || key || '|' || status AS line FROM classified)),
leaves AS (SELECT status, p // 1000 AS leaf, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS h FROM numbered GROUP BY ALL),
nodes AS (SELECT status, leaf // 1000 AS node, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY leaf) || chr(10)) AS h FROM leaves GROUP BY ALL),
hashes AS (SELECT status, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, chr(10) ORDER BY node) || chr(10)) AS hash FROM nodes GROUP BY 1)"""


@query("group_hash", sql("SELECT status, rows, hash FROM hashes", CLASSIFIED, HASHES))
def _(spark, d):
    return R.group_hash(cut_lineage(_lines(spark, d), "lines"), "status", "line")


@query("baseline_hash_compare", sql("SELECT status, rows, CASE WHEN status LIKE 'e%' THEN rows + 1 ELSE rows END AS want_rows, CASE WHEN status LIKE 'e%' THEN 'FAIL' WHEN status LIKE '%pca' THEN 'FAIL' ELSE 'PASS' END AS verdict FROM hashes", CLASSIFIED, HASHES))
def _(spark, d):
    now = R.group_hash(cut_lineage(_lines(spark, d), "lines"), "status", "line")
    base = now.select("status", F.when(F.col("status").like("e%"), F.col("rows") + 1).otherwise(F.col("rows")).alias("rows"), F.when(F.col("status").like("%pca"), F.lit("0")).otherwise(F.col("hash")).alias("hash"))
    return R.baseline_compare(now, base)


@query("unmatched_strata", sql("""SELECT * FROM (SELECT coalesce(instrument_type, '(none)') AS instrument_type, CASE WHEN sec = '' THEN '(none)' ELSE sec END AS security_type, CASE WHEN isin IS NOT NULL THEN 'has_isin' ELSE 'no_isin' END AS has_isin, row_id,
 row_number() OVER (PARTITION BY instrument_type, sec, isin IS NOT NULL ORDER BY row_id) AS rank, count(*) OVER (PARTITION BY instrument_type, sec, isin IS NOT NULL) AS rows FROM classified WHERE status IN ('review_unmatched', 'review_other_series', 'review_structural')) WHERE rank <= 5""", CLASSIFIED))
def _(spark, d):
    return R.unmatched_strata(classified(spark, d))


FIELDS = ["segment", "instrument_type", "security_type", "brand", "type", "name", "isin_prefix"]


@query("field_profile", sql(f"""SELECT field, value, count(*) FILTER (e) AS eligible, count(*) FILTER (NOT e) AS excluded FROM (SELECT field, coalesce(value, '(none)') AS value, e FROM (SELECT *, left(isin, 3) AS isin_prefix, row_id IN (SELECT row_id FROM classified WHERE status LIKE 'eligible%') AS e FROM instruments) x,
  LATERAL (VALUES {', '.join(f"('{f}', {f})" for f in FIELDS)}) t(field, value)) GROUP BY 1, 2""", CLASSIFIED))
def _(spark, d):
    rows = instruments(spark, d).withColumn("isin_prefix", F.substring("isin", 1, 3)).join(
        classified(spark, d).select("row_id", F.col("status").like("eligible%").alias("_e")), "row_id", "left")
    return R.field_profile(rows, FIELDS, F.coalesce("_e", F.lit(False)))


@query("eligible_equities", sql("""SELECT row_id, symbol, reason, CASE WHEN reason IS NULL AND regexp_matches(name, '(?i)\\b(ETF|BEES|FUND|MUTUAL|LIQUID)\\b') THEN 'name_looks_like_fund_or_etf' END AS flag FROM (SELECT row_id, symbol, name, CASE WHEN r IS NOT NULL THEN r
  WHEN count(*) OVER (PARTITION BY r IS NULL, symbol) > 1 THEN 'duplicate_symbol' WHEN count(*) OVER (PARTITION BY r IS NULL, key) > 1 THEN 'duplicate_instrument_key' END AS reason FROM (SELECT *, CASE WHEN key = '' THEN 'no_instrument_key' WHEN instrument_type <> 'EQ' THEN 'instrument_type:' || instrument_type
  WHEN NOT regexp_full_match(symbol, '[A-Z0-9&_.-]{1,30}') THEN 'symbol_not_accepted' WHEN sec NOT IN ('', 'NORMAL') THEN 'security_type:' || sec WHEN isin IS NULL THEN 'no_valid_isin' END AS r FROM base))""", CLASSIFIED))
def _(spark, d):
    return R.eligible_equities(instruments(spark, d))


DIRECTORY = CLASSIFIED + """,
directory AS (SELECT row_id, symbol, coalesce(isin, '') AS isin, trim(name) AS name, status, array_to_string(list_filter([CASE WHEN allflags <> '' THEN allflags END, CASE WHEN NOT regexp_full_match(symbol, '[A-Z0-9&_.-]{1,30}') THEN 'symbol_not_accepted' END, CASE WHEN coalesce(isin, '') = '' THEN 'no_isin' END],
  lambda x: x IS NOT NULL), ';') AS held FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(flags, ',') || [CASE WHEN ds > 1 AND symbol <> '' THEN 'duplicate_symbol' END, CASE WHEN di > 1 AND isin IS NOT NULL THEN 'duplicate_isin' END, CASE WHEN dk > 1 AND key <> '' THEN 'duplicate_instrument_key' END],
  lambda x: x IS NOT NULL AND x <> '')), ',') AS allflags FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS ds, count(*) OVER (PARTITION BY isin) AS di, count(*) OVER (PARTITION BY key) AS dk FROM classified)) WHERE status IN ('eligible_eq', 'eligible_be'))"""


@query("directory_build", sql("SELECT *, held = '' AS published FROM directory", DIRECTORY))
def _(spark, d):
    return R.directory_build(classified(spark, d))


@query("directory_gate", sql("""SELECT published, held, CASE WHEN held > 100 THEN 'too_many_held' ELSE '' END AS problems, held <= 100 AS passed FROM (SELECT count(*) FILTER (held = '') AS published, count(*) FILTER (held <> '') AS held FROM directory)""", DIRECTORY))
def _(spark, d):
    return R.directory_gate(R.directory_build(classified(spark, d)), conflicts=0, min_published=1, max_held=100)


@query("universe_from_directory", sql("SELECT symbol, isin, name, count(*) OVER () AS n, count(*) OVER () >= 1000 AS accepted FROM directory WHERE held = ''", DIRECTORY))
def _(spark, d):
    pub = R.directory_build(classified(spark, d)).where("published").select(symbol_norm("symbol").alias("symbol"), "isin", "name")
    return pub.crossJoin(F.broadcast(pub.agg(F.count(F.lit(1)).alias("n")))).withColumn("accepted", F.col("n") >= 1000)          # one row


@query("sector_class", """SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 13 = 12 AND s_suppkey % 9 <> 8 THEN 'unclassified' WHEN s_suppkey % 13 = 12 THEN 'etf' WHEN s_suppkey % 9 <> 8 THEN 'operating_equity' WHEN s_suppkey % 2 = 0 THEN 'operating_equity' ELSE 'unclassified' END AS instrument_class FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("symbol"), J.sector_class(k % 13 == 12, F.when(k % 9 != 8, F.col("s_name")), k % 2 == 0).alias("instrument_class"))


@query("index_resolve", """SELECT label, CASE WHEN n = 1 THEN k END AS key, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome FROM (SELECT p_name || ' ' || p_brand AS label FROM part UNION ALL SELECT n_name FROM nation) l
LEFT JOIN (SELECT p_name || ' ' || p_brand AS nm, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1) g ON l.label = g.nm""")
def _(spark, d):
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_partkey").alias("key"))
    return R.index_resolve(p.select(F.col("name").alias("label")).unionByName(table(spark, d, "nation").select(F.col("n_name").alias("label"))), p)
