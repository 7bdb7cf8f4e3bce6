"""Revision-keeping ledgers: merges write a new version, nothing known is erased, and no-loss checks compare two versions.

Merges are one co-partitioned full outer join on the ledger key; a key's revisions travel with its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.values import axis_key, layout_class
from barloom.operators.ownership import HOLDER_AXES, axis_columns

TOLERANCE = 0.005
REVISION = "array<struct<superseded_on:date,values:map<string,double>>>"


def _changed(f: str, tolerance: float = TOLERANCE) -> Column:
    return F.coalesce(F.abs(F.col("o_" + f) - F.col("n_" + f)) >= tolerance, F.lit(False))


def _both(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    o = old.select(*keys, *[F.col(c).alias("o_" + c) for c in old.columns if c not in keys], F.lit(True).alias("_o"))
    n = new.select(*keys, *[F.col(c).alias("n_" + c) for c in new.columns if c not in keys], F.lit(True).alias("_n"))
    return o.join(n, list(keys), "full")


def _revision(fields: Sequence[str], changed, today: Column) -> Column:
    """A one-element array with the superseded values, or an empty one."""
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.when(changed(f), F.col("o_" + f)).alias("value")) for f in fields]), lambda e: e["value"].isNotNull())
    return F.when(F.size(entries) > 0, F.array(F.struct(today.alias("superseded_on"), F.map_from_entries(entries).alias("values")))).otherwise(F.array().cast(REVISION))


def merge_annual(old: DataFrame, new: DataFrame, fields: Sequence[str], today: Column) -> DataFrame:
    """Key (symbol, fy, basis). A missing incoming value never erases, a changed one moves the old value into revisions, another provider's record is
    skipped, and a response with another fiscal year-end month is refused. Both sides carry provider/month; `old` carries revisions."""
    j = _both(old, new, ["symbol", "fy", "basis"])
    skipped = F.coalesce(F.col("o_provider") != F.col("n_provider"), F.lit(False))
    refused = F.coalesce(F.col("o_month") != F.col("n_month"), F.lit(False))
    take = F.col("_n") & ~skipped & ~refused
    ch = lambda f: F.coalesce(take & _changed(f), F.lit(False))
    any_of = lambda g: F.greatest(*[g(f) for f in fields]) if len(fields) > 1 else g(fields[0])
    filled = lambda f: F.coalesce(take & F.col("o_" + f).isNull() & F.col("n_" + f).isNotNull(), F.lit(False))
    event = (F.when(F.col("_n").isNull(), "untouched").when(skipped, "skipped_other_provider").when(refused, "refused_year_end").when(F.col("_o").isNull(), "created").when(any_of(ch), "revised").when(any_of(filled), "filled").otherwise("confirmed"))
    return j.select("symbol", "fy", "basis", F.coalesce("o_provider", "n_provider").alias("provider"), F.coalesce("o_month", "n_month").alias("month"),
                    *[F.when(take, F.coalesce(F.col("n_" + f), F.col("o_" + f))).otherwise(F.col("o_" + f)).alias(f) for f in fields],
                    F.concat(F.coalesce("o_revisions", F.array().cast(REVISION)), _revision(fields, ch, today)).alias("revisions"), event.alias("event"))


def merge_official(old: DataFrame, official: DataFrame, fields: Sequence[str], today: Column, provider: str = "official") -> DataFrame:
    """Verified records with the source of every field. Only symbols the ledger already holds; a record of another provider is kept."""
    known = old.select("symbol").distinct()
    j = _both(old, official.join(known, "symbol", "left_semi"), ["symbol", "fy", "basis"])
    other = F.coalesce(F.col("o_provider") != provider, F.lit(False))
    take = F.col("_n") & ~other
    ch = lambda f: F.coalesce(take & _changed(f), F.lit(False))
    stamp = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.when(take & F.col("n_" + f).isNotNull(), F.col("n_source")).alias("value")) for f in fields]), lambda e: e["value"].isNotNull()))
    kept = F.coalesce("o_fields", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(kept, lambda k, v: ~F.array_contains(F.map_keys(stamp), k)), stamp)
    event = (F.when(F.col("_n").isNull(), "untouched").when(other, "kept_other_provider").when(F.col("_o").isNull(), "created").when(F.greatest(*[ch(f) for f in fields]), "revised").otherwise("confirmed"))
    return j.select("symbol", "fy", "basis", F.when(F.col("_o").isNull(), provider).otherwise(F.col("o_provider")).alias("provider"),
                    *[F.when(take, F.coalesce(F.col("n_" + f), F.col("o_" + f))).otherwise(F.col("o_" + f)).alias(f) for f in fields], merged.alias("fields"),
                    F.concat(F.coalesce("o_revisions", F.array().cast(REVISION)), _revision(fields, ch, today)).alias("revisions"), event.alias("event"))


def merge_quarterly(old: DataFrame, new: DataFrame, fields: Sequence[str], today: Column) -> DataFrame:
    """Key (symbol, quarter_end); a symbol whose new response has another basis drops its old quarters (bases never mix)."""
    basis = new.groupBy("symbol").agg(F.max("basis").alias("_basis"))
    o = old.join(basis, "symbol", "left").where(F.col("_basis").isNull() | (F.col("_basis") == F.col("basis"))).drop("_basis")
    j = _both(o, new, ["symbol", "quarter_end"])
    ch = lambda f: _changed(f)
    filled = lambda f: F.col("o_" + f).isNull() & F.col("n_" + f).isNotNull()
    rev = F.array_compact(F.array(*[F.when(ch(f), F.struct(F.lit(f).alias("field"), F.col("o_" + f).alias("previous"), today.alias("changed_on"))) for f in fields]))
    touched = F.greatest(*[F.coalesce(ch(f) | filled(f), F.lit(False)) for f in fields])
    event = F.when(F.col("_n").isNull(), "untouched").when(F.col("_o").isNull(), "added").when(touched, "changed").otherwise("unchanged")
    return j.select("symbol", "quarter_end", F.coalesce("n_basis", "o_basis").alias("basis"), *[F.coalesce(F.col("n_" + f), F.col("o_" + f)).alias(f) for f in fields],
                    F.concat(F.coalesce("o_revisions", F.array().cast("array<struct<field:string,previous:double,changed_on:date>>")), rev).alias("revisions"), event.alias("event"))


def merge_shareholding(old: DataFrame, new: DataFrame, fields: Sequence[str], today: Column) -> DataFrame:
    """Key (symbol, period_end): added / kept-existing / resurrected / refreshed / revised / unchanged; a value never silently becomes NULL."""
    j = _both(old, new, ["symbol", "period_end"])
    o_ok, n_ok = F.col("o_status") == "available", F.col("n_status") == "available"
    kept = F.array_compact(F.array(*[F.when(F.col("o_" + f).isNotNull() & F.col("n_" + f).isNull(), F.lit(f)) for f in fields]))
    core = lambda: F.greatest(*[F.coalesce(F.col("o_" + f) != F.coalesce(F.col("n_" + f), F.col("o_" + f)), F.col("o_" + f).isNull() & F.col("n_" + f).isNotNull()) for f in fields]) | (F.col("o_record_id") != F.col("n_record_id"))
    event = (F.when(F.col("_n").isNull(), "untouched").when(F.col("_o").isNull(), "added").when(o_ok & ~n_ok, "kept-existing").when(~o_ok & n_ok, "resurrected")
             .when(~o_ok, F.when(F.col("o_reason").eqNullSafe(F.col("n_reason")), "unchanged").otherwise("refreshed")).when(core(), "revised").when(F.size(kept) > 0, "refreshed").otherwise("unchanged"))
    j = j.withColumn("event", event)
    use_new = F.col("event").isin("added", "resurrected", "refreshed", "revised")
    snap = F.col("event").isin("resurrected", "revised")
    merged = lambda f: F.when(use_new & (F.col("event") != "resurrected"), F.coalesce(F.col("n_" + f), F.col("o_" + f))).when(use_new, F.col("n_" + f)).otherwise(F.col("o_" + f))
    return j.select("symbol", "period_end", F.when(use_new, F.col("n_status")).otherwise(F.col("o_status")).alias("status"), F.when(use_new, F.col("n_record_id")).otherwise(F.col("o_record_id")).alias("record_id"),
                    *[merged(f).alias(f) for f in fields], (F.coalesce("o_revisions", F.lit(0)) + snap.cast("int")).alias("revisions"),
                    F.when(o_ok & n_ok, F.array_join(kept, ",")).otherwise("").alias("kept_values"), "event")


def relabel_holders(holders: DataFrame) -> DataFrame:
    """Section, category and label again from the stored axis (never the name); unknown axes keep what they had."""
    mapped = axis_columns(axis_key("axis"))
    known = axis_key("axis").isin(*HOLDER_AXES)
    return holders.withColumns({c: F.when(known, m).otherwise(F.col(c)) for c, m in zip(("section", "category", "label"), mapped)})


def fill_holders(stored: DataFrame, reread: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Holders are added to a stored quarter only when the re-read aggregates equal the stored ones."""
    j = _both(stored, reread, ["symbol", "period_end"]).where("_o")
    equal = F.lit(True)
    for f in fields:
        equal = equal & F.col("o_" + f).eqNullSafe(F.col("n_" + f))
    had = F.col("o_holders").isNotNull()
    event = F.when(had, "kept").when(F.col("_n").isNull(), "named-unavailable").when(equal, "named-added").otherwise("named-skipped")
    return j.select("symbol", "period_end", F.when(event == "named-added", F.col("n_holders")).otherwise(F.col("o_holders")).alias("holders"), event.alias("event"))


def normalise_ledger(ledger: DataFrame, core: Sequence[str]) -> DataFrame:
    """Layout and verification of every stored record again: symbol rows with a nested `years` array, re-derived in place."""
    has = lambda y: F.greatest(*[y["values"][f].isNotNull() for f in core]) if len(core) > 1 else y["values"][core[0]].isNotNull()
    redo = lambda y: F.struct(y["fy"].alias("fy"), y["values"].alias("values"), F.array_compact(F.array(*[F.when(y["values"][f].isNull(), F.lit(f)) for f in core])).alias("missing"),
                              F.when(has(y), "verified").otherwise("incomplete").alias("status"))
    return ledger.withColumns({"layout": layout_class("sector"), "years": F.transform("years", redo)})


def merge_state_parts(cache: DataFrame, durable: DataFrame, key: str, parts: dict[str, Sequence[str]]) -> DataFrame:
    """Part by part, the copy with the later date wins; a tie keeps the cache. parts: date column -> the columns that move with it."""
    j = _both(cache, durable, [key])
    cols = []
    for date, moved in parts.items():
        newer = F.coalesce(F.col("n_" + date) > F.col("o_" + date), F.col("n_" + date).isNotNull() & F.col("o_" + date).isNull())
        cols += [F.when(newer, F.col("n_" + c)).otherwise(F.col("o_" + c)).alias(c) for c in (date, *moved)]
    return j.select(key, *cols, F.col("_o").isNull().alias("added"))


def seed_from_saved(working: DataFrame, saved: DataFrame, keys: Sequence[str], values: Sequence[str], stamp: str) -> DataFrame:
    """Both copies before a run: no key of either is dropped, the row with the later stamp wins, ties keep the working copy."""
    j = _both(working, saved, keys)
    newer = F.coalesce(F.col("n_" + stamp) > F.col("o_" + stamp), F.col("_o").isNull())
    return j.select(*keys, *[F.when(newer, F.col("n_" + v)).otherwise(F.col("o_" + v)).alias(v) for v in (*values, stamp)], F.when(F.col("_o").isNull(), "added").when(newer, "from_saved").otherwise("kept_working").alias("outcome"))


MASTER_REVISION = "array<struct<on:date,field:string,old:string,new:string>>"


def merge_sector_master(old: DataFrame, seen: DataFrame, today: Column, keep: int | None = None) -> DataFrame:
    """Slowly changing master by identifier. old: isin, symbol, symbol_history, instrument_class, label, last_confirmed, status, revisions; seen: isin,
    symbol, instrument_class, label, answered, attempted. Unseen records stay, marked absent; all revisions are kept, or the last `keep`."""
    j = _both(old, seen, ["isin"])
    o, n = (lambda c: F.col("o_" + c)), (lambda c: F.col("n_" + c))
    both = F.col("_o") & F.col("_n")
    label = F.when(n("label").isNotNull(), n("label")).when(n("answered"), None).otherwise(o("label"))
    klass = F.coalesce(n("instrument_class"), F.lit("unclassified"))
    rev = lambda f, a, b: F.when(both & ~a.eqNullSafe(b), F.struct(today.alias("on"), F.lit(f).alias("field"), a.alias("old"), b.alias("new")))
    added = F.array_compact(F.array(rev("symbol", o("symbol"), n("symbol")), rev("instrument_class", o("instrument_class"), klass), rev("sector_source_label", o("label"), label)))
    base = F.when(klass == "etf", "etf").when((klass == "operating_equity") & label.isNotNull(), "classified").otherwise("unclassified")
    unanswered = n("label").isNull() & ~n("answered") & n("attempted") & o("label").isNotNull() & (klass == "operating_equity")
    status = F.when(F.col("_n").isNull(), "absent").when(both & unanswered, "unconfirmed").otherwise(base)
    history = F.coalesce(o("symbol_history"), F.array().cast("array<string>"))
    history = F.when(both & (o("symbol") != n("symbol")) & ~F.array_contains(history, o("symbol")), F.array_append(history, o("symbol"))).otherwise(history)
    all_rev = F.concat(F.coalesce(o("revisions"), F.array().cast(MASTER_REVISION)), added)
    return j.select("isin", F.coalesce(n("symbol"), o("symbol")).alias("symbol"), history.alias("symbol_history"), F.when(F.col("_n").isNull(), o("instrument_class")).otherwise(klass).alias("instrument_class"),
                    F.when(F.col("_n").isNull(), o("label")).otherwise(label).alias("label"), F.when(F.col("_n") & (n("label").isNotNull() | n("answered")), today).otherwise(o("last_confirmed")).alias("last_confirmed"),
                    status.alias("status"), (all_rev if keep is None else F.slice(all_rev, F.greatest(F.lit(1), F.size(all_rev) - (keep - 1)), keep)).alias("revisions"))


def hold_isin_change(records: DataFrame, listed: DataFrame, values: Sequence[str]) -> DataFrame:
    """A record whose listed identifier differs moves aside as a struct; a held record returns when its own identifier is listed again."""
    j = records.join(listed.select("symbol", F.col("isin").alias("_listed")), "symbol", "left")
    has = F.col("held").isNotNull()
    restore = has & (F.col("_listed") == F.col("held.isin"))
    hold = ~has & F.col("isin").isNotNull() & F.col("fetched").isNotNull() & F.col("_listed").isNotNull() & (F.col("isin") != F.col("_listed"))
    aside = F.struct("isin", "fetched", *values)
    cols = ["isin", "fetched", *values]
    outcome = F.when(F.coalesce(restore, F.lit(False)), "restored").when(F.coalesce(hold, F.lit(False)), "held").when(has, "still_held").otherwise("kept")
    j = j.withColumn("outcome", outcome)
    put = lambda c: F.when(F.col("outcome") == "restored", F.col("held." + c)).when(F.col("outcome") == "held", None).otherwise(F.col(c)).alias(c)
    return j.select("symbol", *[put(c) for c in cols], F.when(F.col("outcome") == "held", aside).when(F.col("outcome") == "restored", None).otherwise(F.col("held")).alias("held"), "outcome")


def observe_upsert(old: DataFrame, answers: DataFrame, cap: int = 3) -> DataFrame:
    """Same answer as before counts one more check (up to the cap), a different one starts again. old: requested, answer, first_seen,
    last_checked, checks; answers: requested, answer, day."""
    j = _both(old, answers, ["requested"])
    same = F.coalesce(F.col("o_answer") == F.col("n_answer"), F.lit(False))
    quiet = F.col("_n").isNull()
    return j.select("requested", F.when(quiet, F.col("o_answer")).otherwise(F.col("n_answer")).alias("answer"), F.when(quiet | same, F.col("o_first_seen")).otherwise(F.col("n_day")).alias("first_seen"),
                    F.when(quiet, F.col("o_last_checked")).otherwise(F.col("n_day")).alias("last_checked"), F.when(quiet, F.col("o_checks")).when(same, F.least(F.lit(cap), F.col("o_checks") + 1)).otherwise(1).alias("checks"))


def _problems(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))
    return df.select(*keys, F.explode(hits).alias("problem"))


def _records(f: str):
    """Whether a revision holds the old value of field `f`."""
    return lambda r: F.coalesce(F.abs(r["values"][f] - F.col("o_" + f)) < TOLERANCE, F.lit(False))


def no_loss_annual(old: DataFrame, new: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per thing the new ledger lost: record, provider, value, earlier revisions, or a change no added revision records."""
    keys = ["symbol", "fy", "basis"]
    j = _both(old, new, keys).where("_o")
    here = F.col("_n").isNotNull()
    k = F.size("o_revisions")
    prefix = F.when(k == 0, F.lit(True)).otherwise(F.slice("n_revisions", F.lit(1), F.greatest(k, F.lit(1))).cast("string").eqNullSafe(F.col("o_revisions").cast("string")))
    rules = {"record removed": ~here, "provider changed": here & (F.col("o_provider") != F.col("n_provider")), "revision history changed": here & ~prefix}
    for f in fields:
        recorded = F.exists(F.slice("n_revisions", k + 1, F.greatest(F.size("n_revisions") - k, F.lit(0))), _records(f))
        rules[f"{f}: a value was lost"] = here & F.col("o_" + f).isNotNull() & F.col("n_" + f).isNull()
        rules[f"{f} changed without a revision"] = here & _changed(f) & ~F.coalesce(recorded, F.lit(False))
    return _problems(j, keys, rules)


def no_loss_shareholding(old: DataFrame, new: DataFrame, fields: Sequence[str]) -> DataFrame:
    keys = ["symbol", "period_end"]
    j = _both(old, new, keys).where("_o")
    here = F.col("_n").isNotNull()
    more = F.coalesce(F.col("n_revisions") > F.col("o_revisions"), F.lit(False))
    rules = {"record removed": ~here, "an available quarter became unavailable": here & (F.col("o_status") == "available") & (F.col("n_status") != "available"),
             "source record id was removed": here & F.col("o_record_id").isNotNull() & F.col("n_record_id").isNull(), "record id changed without a revision": here & (F.col("o_record_id") != F.col("n_record_id")) & ~more,
             "revision history changed": here & (F.col("n_revisions") < F.col("o_revisions")), "named holders were lost": here & F.col("o_holders").isNotNull() & F.col("n_holders").isNull() & (F.col("o_record_id") == F.col("n_record_id"))}
    for f in fields:
        rules[f"{f}: a value was lost"] = here & F.col("o_" + f).isNotNull() & F.col("n_" + f).isNull()
        rules[f"{f} changed without a revision"] = here & _changed(f) & ~more
    return _problems(j, keys, rules)


def no_loss_candles(old: DataFrame, new: DataFrame, correction_days: int = 30) -> DataFrame:
    """Per symbol: saved days that are gone, and edits older than the days that may still be corrected."""
    end = old.groupBy("symbol").agg(F.max("date").alias("_end"))
    j = _both(old.select("symbol", "date", "close", "high", "low", "volume"), new.select("symbol", "date", "close", "high", "low", "volume"), ["symbol", "date"]).where("_o").join(end, "symbol")
    same = F.lit(True)
    for c in ("close", "high", "low", "volume"):
        same = same & F.col("o_" + c).eqNullSafe(F.col("n_" + c))
    g = j.groupBy("symbol").agg(F.count_if(F.col("_n").isNull()).alias("lost_days"), F.min(F.when(F.col("_n").isNull(), F.col("date"))).alias("first_lost"),
                                F.count_if(F.col("_n").isNotNull() & ~same & (F.col("date") < F.date_sub("_end", correction_days))).alias("altered_days"))
    return g.where("lost_days > 0 OR altered_days > 0")


def no_loss_master(old: DataFrame, new: DataFrame, max_drop: float = 0.10) -> DataFrame:
    j = _both(old.select("isin", "instrument_class", "label"), new.select("isin", "instrument_class", "label"), ["isin"])
    has = lambda s: (F.col(s + "instrument_class") == "operating_equity") & F.col(s + "label").isNotNull()
    c = j.agg(F.count_if(F.col("_o") & F.col("_n").isNull()).alias("vanished"), F.count_if(has("o_")).alias("old_labelled"), F.count_if(has("n_")).alias("new_labelled"), F.count_if(F.col("o_label").isNotNull() & F.col("_n") & F.col("n_label").isNull()).alias("cleared"))
    p = F.array_compact(F.array(F.when(F.col("vanished") > 0, "vanished"), F.when((F.col("old_labelled") > 0) & (F.col("new_labelled") < F.col("old_labelled") * (1 - max_drop)), "classified_fell"),
                                F.when((F.col("old_labelled") > 0) & (F.col("cleared") > F.col("old_labelled") * max_drop), "labels_cleared")))
    return c.withColumn("problems", F.array_join(p, ","))


def no_loss_snapshot(published: DataFrame, candidate: DataFrame, max_drop: float = 0.10) -> DataFrame:
    """One-row frames (as_of, universe_count): never back in time, never much smaller."""
    j = published.select(F.col("as_of").alias("o"), F.col("universe_count").alias("oc")).crossJoin(candidate)
    p = F.array_compact(F.array(F.when(F.col("as_of") < F.col("o"), "older_than_published"), F.when(F.col("universe_count") < F.col("oc") * (1 - max_drop), "universe_shrank")))
    return j.select(F.col("o").alias("published_as_of"), "as_of", F.col("oc").alias("published_count"), "universe_count", F.array_join(p, ",").alias("problems"))


def no_loss_parts(old: DataFrame, new: DataFrame, key: str, dates: Sequence[str], periods: str | None = None, basis: str | None = None, checked: str | None = None) -> DataFrame:
    """One row per thing a key's new state lost: the key, a part's date that went back or away, a period of the array `periods` held on the same `basis`. A
    change of basis may replace the periods, but only with a `checked` date later than the saved one (any date, where none was saved)."""
    j = _both(old, new, [key]).where("_o")
    rules = {"missing from the new state": F.col("_n").isNull()}
    for d in dates:
        rules[f"{d} moved backwards"] = F.col("_n") & F.col("o_" + d).isNotNull() & (F.col("n_" + d).isNull() | (F.col("n_" + d) < F.col("o_" + d)))
    same = F.col("o_" + basis).eqNullSafe(F.col("n_" + basis)) if basis else F.lit(True)
    if periods:
        left = F.array_except("o_" + periods, F.coalesce("n_" + periods, F.slice("o_" + periods, 1, 0)))
        rules[f"{periods} lost"] = F.col("_n") & same & (F.size(left) > 0)
    if basis and checked:
        newer = F.coalesce(F.col("n_" + checked) > F.col("o_" + checked), F.col("n_" + checked).isNotNull() & F.col("o_" + checked).isNull())
        rules[f"{basis} changed without a newer check"] = F.col("_n") & ~same & ~newer
    return _problems(j, [key], rules)


def except_lost_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.select(*keys).join(new, list(keys), "left_anti").distinct()


def intersect_common_keys(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both versions whose attribute changed."""
    j = old.select(key, F.col(value).alias("before")).join(new.select(key, F.col(value).alias("after")), key)
    return j.where(~F.col("before").eqNullSafe(F.col("after")))


def union_by_date(saved: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Saved and fresh rows, fresh wins per key (one combined aggregate)."""
    from barloom.plans.order import latest_by
    both = saved.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)))
    return latest_by(both, list(keys), F.col("_p")).drop("_p")


def verify_run(before: DataFrame, after: DataFrame, attempts: DataFrame, review_after: int = 3) -> DataFrame:
    """Per symbol: improved / refreshed / regressed / needs_review / retryable_failed / not_reached. before/after: symbol, date rows;
    attempts: symbol, before_count, after_count."""
    lost = except_lost_keys(before, after, ["symbol", "date"]).select("symbol").distinct().withColumn("_lost", F.lit(True))
    b, a = before.groupBy("symbol").agg(F.max("date").alias("b_last")), after.groupBy("symbol").agg(F.max("date").alias("a_last"))
    j = b.join(a, "symbol", "full").join(lost, "symbol", "left").join(attempts, "symbol", "full")
    tried = F.col("after_count").isNotNull() & ~F.col("after_count").eqNullSafe(F.col("before_count"))
    out = (F.when(F.col("_lost"), "regressed").when(F.col("a_last").isNotNull() & F.col("b_last").isNull(), "improved").when(F.col("a_last") > F.col("b_last"), "refreshed")
           .when(tried & (F.col("after_count") >= review_after), "needs_review").when(tried, "retryable_failed").otherwise("not_reached"))
    return j.select("symbol", out.alias("outcome"))


def metric_loss(before: DataFrame, after: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metrics present before and absent after without an explanation. `after` carries `explicit` (array) and `fetched`; an explicit "no value"
    explains a loss only when it was read after the baseline."""
    j = _both(before, after, ["symbol"]).where("_o AND _n")
    explained = lambda m: F.array_contains("n_explicit", m) & F.coalesce(F.col("n_fetched") > F.col("o_fetched"), F.lit(False))
    lost = F.array_compact(F.array(*[F.when(F.col("o_" + m).isNotNull() & F.col("n_" + m).isNull() & ~explained(m), F.lit(m)) for m in metrics]))
    return j.select("symbol", F.explode(lost).alias("metric"))
