"""Shareholding categories and individually disclosed holders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.values import axis_key, rnd

CATEGORIES = ("promoters", "fii", "other_dii", "mutual_funds", "retail_other")
# Normalised member names of the two filing formats.
MEMBERS = {"promoter": "shareholdingofpromoterandpromotergroup", "mf": "mutualfundsoruti", "domestic": "institutionsdomestic", "foreign": "institutionsforeign", "inst_old": "institutions",
           "fpi_old": "institutionsforeignportfolioinvestor", "nonins": "noninstitutions", "gov": "governments", "trusts": "employeebenefitstrusts", "total": "shareholdingpattern", "public": "publicshareholding", "dr": "custodianordrholder"}
# Holder axis -> (section, category, label).
HOLDER_AXES = {
    "othersindianshareholders": ("promoter_group_indian", "Promoter", "Promoter"),
    "otherforeignshareholders": ("promoter_group_foreign", "Promoter", "Promoter"),
    "mutualfundsoruti": ("mutual_funds", "DII", "DII – Mutual Fund"),
    "insurancecompanies": ("insurance_companies", "DII", "DII – Insurance"),
    "providentfundsorpensionfunds": ("provident_pension_funds", "DII", "DII – Other"),
    "otherfinancialinstitutions": ("other_financial_institutions", "DII", "DII – Other"),
    "otherinstitutionsdomestic": ("other_institutions_domestic", "DII", "DII – Other"),
    "institutionsforeignportfolioinvestorone": ("fpi_category_one", "Foreign Investor", "FPI"),
    "institutionsforeignportfolioinvestortwo": ("fpi_category_two", "Foreign Investor", "FPI"),
    "foreigndirectinvestment": ("foreign_direct_investment", "Foreign Investor", "FDI"),
    "overseasdepositories": ("overseas_depositories", "Foreign Investor", "Foreign – Other"),
    "otherinstitutionsforeign": ("other_institutions_foreign", "Foreign Investor", "Foreign – Other"),
    "custodianordrholder": ("custodian_dr_holder", "Other", "Other – Custodian / DR holder"),
    "detailssharesheldbyindividualsorhuf": ("promoter_individuals", "Promoter", "Promoter"),
    "centralgovernmentorstategovernments": ("promoter_central_state_government", "Promoter", "Promoter"),
    "institutionsforeignportfolioinvestor": ("fpi_old_format", "Foreign Investor", "FPI"),
}
SKIPPED_AXES = {"shareholdersactingaspersonsinconcertforpublic": "persons_in_concert", "shareswhichremainunclaimedforpublicshareholders": "unclaimed"}


def shareholding_categories(facts: DataFrame) -> DataFrame:
    """Category facts (symbol, period_end, member, shares, pct) to the five percentages with format, unit, trust mode, share-derived
    conflict and flags. Nothing is forced to 100 and no missing row is made up. Where the unit or the format is unknown the row says so and has no percentages."""
    at = lambda m, c: F.max(F.when(F.col("member") == MEMBERS[m], F.col(c)))
    g = facts.groupBy("symbol", "period_end").agg(*[at(m, "pct").alias("p_" + m) for m in MEMBERS], *[at(m, "shares").alias("s_" + m) for m in MEMBERS],
                                                  *[F.max(F.when(F.col("member") == MEMBERS[m], True)).alias("h_" + m) for m in ("promoter", "domestic", "foreign", "inst_old", "fpi_old")])
    p = lambda m: F.col("p_" + m) * F.col("_k")
    unit = F.when(F.col("p_total").between(0.99, 1.01), "fraction").when(F.col("p_total").between(99, 101), "percent")
    fmt = F.when(F.coalesce("h_domestic", "h_foreign").isNotNull(), "new").when(F.coalesce("h_inst_old", "h_fpi_old").isNotNull(), "old")
    g = g.withColumns({"unit": unit, "format": fmt}).withColumn("_k", F.when(F.col("unit") == "fraction", 100.0).otherwise(1.0))
    absent = F.col("h_promoter").isNull() & F.coalesce(p("public") >= 99.5, F.lit(False))
    g = g.withColumns({"promoter_absent": absent, "_prom": F.when(absent, F.lit(0.0)).otherwise(p("promoter")), "_gov": F.coalesce(p("gov"), F.lit(0.0))})
    new = F.col("format") == "new"
    g = g.withColumns({"_fii": F.when(new, p("foreign")).otherwise(p("fpi_old")), "_inst": F.when(new, p("domestic")).otherwise(p("inst_old"))})
    g = g.withColumns({"_other": F.when(new, F.col("_inst") - p("mf")).otherwise(F.col("_inst") - F.col("_fii") - p("mf")),
                       "_s0": F.when(new, F.col("_prom") + F.col("_fii") + F.col("_inst") + p("nonins") + F.col("_gov")).otherwise(F.col("_prom") + F.col("_inst") + p("nonins") + F.col("_gov"))})
    has_trusts = F.coalesce(p("trusts") != 0, F.lit(False))
    separate = F.col("_s0").isNull() | (F.abs(F.col("_s0") + p("trusts") - 100) < F.abs(F.col("_s0") - 100))
    g = g.withColumn("trust_mode", F.when(has_trusts & separate, "separate").when(has_trusts, "nested").otherwise("none"))
    retail = p("nonins") + F.col("_gov") + F.when(F.col("trust_mode") == "separate", p("trusts")).otherwise(0.0)
    g = g.withColumns({"promoters": rnd("_prom", 2), "fii": rnd("_fii", 2), "other_dii": rnd("_other", 2), "mutual_funds": rnd(p("mf"), 2), "retail_other": rnd(retail, 2)})
    total = rnd(F.col("promoters") + F.col("fii") + F.col("other_dii") + F.col("mutual_funds") + F.col("retail_other"), 2)
    basis = F.col("s_total") - F.coalesce("s_dr", F.lit(0.0))
    share = lambda c: F.when(basis != 0, rnd(c / basis * 100, 2))
    s_fii, s_inst = F.when(new, F.col("s_foreign")).otherwise(F.col("s_fpi_old")), F.when(new, F.col("s_domestic")).otherwise(F.col("s_inst_old"))
    derived = {"promoters": share(F.when(F.col("promoter_absent"), F.lit(0.0)).otherwise(F.col("s_promoter"))), "fii": share(s_fii),
               "other_dii": share(F.when(new, s_inst - F.col("s_mf")).otherwise(s_inst - s_fii - F.col("s_mf"))), "mutual_funds": share(F.col("s_mf")),
               "retail_other": share(F.col("s_nonins") + F.coalesce("s_gov", F.lit(0.0)) + F.when(F.col("trust_mode") == "separate", F.coalesce("s_trusts", F.lit(0.0))).otherwise(0.0))}
    off = F.greatest(*[F.coalesce(F.abs(F.col(c) - d), F.lit(0.0)) for c, d in derived.items()])
    g = g.withColumns({"total_pct": total, "conflict_pp": F.when(rnd(off, 2) > 1.0, rnd(off, 2))})
    missing = [F.when(F.col(c).isNull(), F.lit("row_missing:" + n)) for c, n in (("_prom", "promoters"), ("p_mf", "mutual_funds"), ("p_nonins", "retail_other"), ("_fii", "fii"), ("_inst", "institutions"))]
    flags = F.array_compact(F.array(*missing, F.when(F.abs(F.col("total_pct") - 100) > 0.25, "sum_off"), F.when(F.col("conflict_pp").isNotNull(), "conflict")))
    problem = F.when(F.col("unit").isNull(), "unit_unknown").when(F.col("format").isNull(), "format_unknown")
    sound = lambda c, name: F.when(problem.isNull(), c).alias(name)
    return g.select("symbol", "period_end", *[sound(F.col(c), c) for c in CATEGORIES], "format", "unit", sound(F.col("trust_mode"), "trust_mode"), sound(F.col("promoter_absent"), "promoter_absent"), sound(F.col("total_pct"), "total_pct"),
                    sound(F.col("conflict_pp"), "conflict_pp"), sound(F.array_join(flags, ","), "flags"), problem.alias("problem"))


def axis_columns(axis: Column) -> list[Column]:
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in HOLDER_AXES.items() for x in (k, v[i])])[axis]
    return [pick(0).alias("section"), pick(1).alias("category"), pick(2).alias("label")]


def named_holders(pairs: DataFrame, unit_percent: bool = True) -> DataFrame:
    """Holder rows (axis, member, holder_name, shares, pct, conflict) with section and category from the axis only, or the reason they are left out."""
    k = axis_key("axis")
    shares, pct = F.col("shares").try_cast("double"), F.col("pct").try_cast("double") * (1.0 if unit_percent else 100.0)
    skip = F.create_map(*[F.lit(x) for kv in SKIPPED_AXES.items() for x in kv])
    df = pairs.withColumns({"_k": k, "shares": shares, "percentage": rnd(pct, 2)})
    df = df.select("*", *axis_columns(F.col("_k")))
    reason = (F.when(F.col("conflict"), "conflicting_facts").when(skip[F.col("_k")].isNotNull(), skip[F.col("_k")]).when(F.col("section").isNull(), "unmapped_axis")
              .when(F.coalesce(F.trim("holder_name"), F.lit("")) == "", "no_name").when(F.coalesce("shares", F.lit(0.0)) <= 0, "no_shares"))
    return df.withColumns({"excluded": reason, "percentage": F.when(F.col("percentage").between(0, 100.5), F.col("percentage"))}).drop("_k", "pct")


def named_holder_totals(holders: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Per section: named shares and count against the category row; flagged when the named rows hold more."""
    g = holders.where("excluded IS NULL").groupBy("symbol", "section").agg(F.sum("shares").alias("named_shares"), F.count(F.lit(1)).alias("named_count"))
    j = g.join(aggregates.select("symbol", "section", F.col("shares").alias("category_total")), ["symbol", "section"], "left")
    return j.withColumn("exceeds", F.coalesce(F.col("named_shares") > F.col("category_total") + 1, F.lit(False)))


def top_holders(holders: DataFrame, rows: int = 10) -> DataFrame:
    """Largest holders per symbol in its newest available period; the rank limit runs before the exchange."""
    newest = holders.groupBy("symbol").agg(F.max("period_end").alias("period_end"))
    h = holders.join(newest, ["symbol", "period_end"], "left_semi")
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("percentage"), F.desc_nulls_last("shares"), F.asc("holder_name"), F.asc("axis"), F.asc("member"))
    return h.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rows)


def ownership_latest(quarters: DataFrame) -> DataFrame:
    """Newest available quarter per symbol and the newest on file; nothing is carried from one to the other."""
    ok = F.when(F.col("status") == "available", F.col("period_end"))
    return quarters.groupBy("symbol").agg(F.max("period_end").alias("newest_on_file"), F.max(ok).alias("as_of"), *[F.max_by(c, ok).alias(c) for c in CATEGORIES])
