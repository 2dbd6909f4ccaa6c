"""Facts for rated charges: overrides, decisions and defaults, and how they are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packing import first_where, greedy_starts, let, slices

__all__ = ["batch_rules", "fact_batches", "fact_uses", "resolve_facts", "rule_conditions", "rule_units", "units_of", "with_facts"]

BATCH = 40
#: Rules of a call up to which a fold that copies its list is quicker than jump pointers.
FEW = 64


def resolve_facts(candidates: DataFrame, decisions: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(call_id, charge_id, fact, value, source): override (by the fact's name, for any charge), else decision, else default.

    candidates has call_id, charge_id, rule and overrides map<string,string>; decisions call_id, charge_id, fact, value, pos, of
    which the last counts. Facts that no rule of the call declares are dropped; facts without any value are absent. failed
    (call_id, charge_id) are the charges whose batch wasn't answered: nothing but overrides is known of their facts. Facts are
    resolved within the row of their charge, so the many facts aren't shuffled by themselves; inputs that are dealt by call_id and charge_id aren't dealt again.
    """
    joined = _with_failed(candidates, failed).join(_stated(decisions), ["call_id", "charge_id"], "left")

    def told(f: Column) -> Column:
        override, decided, default = F.try_element_at("overrides", f["name"]), F.try_element_at("__decided", f["name"]), f["default_value"]
        answered = ~F.col("__failed")
        source = F.when(override.isNotNull(), "override").when(answered & decided.isNotNull(), "decision").when(answered & default.isNotNull(), "default")
        return F.struct(f["name"].alias("fact"), F.coalesce(override, decided, default).alias("value"), source.alias("source"))

    named = let(F.concat(_keys("overrides"), _keys("__decided")), lambda names: F.filter("rule.facts", lambda f: f["default_value"].isNotNull() | F.array_contains(names, f["name"])))
    known = F.filter(F.transform(named, told), lambda t: t["source"].isNotNull())
    return joined.select("call_id", "charge_id", F.inline(known))


def _keys(column: str) -> Column:
    return F.coalesce(F.map_keys(column), F.array().cast("array<string>"))


def _stated(decisions: DataFrame) -> DataFrame:
    """(call_id, charge_id, __decided): a charge's last decisions as one map by fact."""
    last = decisions.where("fact is not null").groupBy("call_id", "charge_id", "fact").agg(F.max_by("value", "pos").alias("value"))
    return last.groupBy("call_id", "charge_id").agg(F.map_from_entries(F.collect_list(F.struct("fact", "value"))).alias("__decided"))


def _with_failed(candidates: DataFrame, failed: DataFrame | None) -> DataFrame:
    if failed is None:
        return candidates.withColumn("__failed", F.lit(False))
    marked = failed.select("call_id", "charge_id").distinct().withColumn("__f", F.lit(True))
    return candidates.join(marked, ["call_id", "charge_id"], "left").withColumn("__failed", F.coalesce("__f", F.lit(False))).drop("__f")


def with_facts(candidates: DataFrame, decisions: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """candidates with facts, the values that rating is given: decisions become one map by call and charge before the join.

    In an answered batch what wasn't decided is given at its default, so rating records no assumption for it. Of failed charges (as in
    resolve_facts) only overrides are given; rating falls back on defaults itself and says so.
    """
    joined = _with_failed(candidates, failed).join(_stated(decisions), ["call_id", "charge_id"], "left")
    answer = lambda f: F.when(~F.col("__failed"), F.coalesce(F.try_element_at("__decided", f["name"]), f["default_value"]))
    given = F.transform(F.coalesce("rule.facts", F.array()), lambda f: F.struct(f["name"].alias("key"), F.coalesce(F.try_element_at("overrides", f["name"]), answer(f)).alias("value")))
    return joined.withColumn("facts", F.map_from_entries(F.array_distinct(F.filter(given, lambda e: e["value"].isNotNull())))).drop("__decided", "__failed")


def fact_batches(candidates: DataFrame, limit: int = BATCH) -> DataFrame:
    """(call_id, charge_id, batch, n_facts): the charges with facts that no override gives, in order of pos, packed as batch_rules does."""
    size = let(_keys("overrides"), lambda names: F.size(F.filter("rule.facts", lambda f: ~F.array_contains(names, f["name"]))))
    pending = candidates.select("call_id", "charge_id", "pos", F.explode(F.filter(F.array(size), lambda n: n > 0)).alias("n_facts"))  # counted once: a where would count again
    return _batched(pending, limit).where("call_id is not null and charge_id is not null")


def batch_rules(rules: DataFrame, limit: int = BATCH) -> DataFrame:
    """(call_id, charge_id, batch): rules in order of pos, each whole; a batch is closed if the next rule's facts would exceed limit.

    rules has call_id, charge_id, pos and n_facts (null: none). Rules without facts close no batch. Sums up to each rule come from a window; where a batch
    ends is searched in them, and batches are found by jump pointers, of a few rules by a fold.
    """
    return _batched(rules, limit).drop("n_facts")


def _batched(rules: DataFrame, limit: int) -> DataFrame:
    """(call_id, charge_id, batch, n_facts) of batch_rules: counts go with their rules, so no join brings them back."""
    order = Window.partitionBy("call_id").orderBy("pos", "charge_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rules.select("call_id", "pos", "charge_id", "n_facts", F.sum(F.coalesce("n_facts", F.lit(0)).cast("long")).over(order).alias("total"))
    grouped = summed.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("pos", "charge_id", "total", "n_facts"))).alias("rs"))

    def batches(totals: Column) -> Column:
        def total(i: Column) -> Column:
            return F.when(i < 0, F.lit(0).cast("long")).otherwise(F.get(totals, i))

        def follow(i: Column) -> Column:
            return let(total(i - 1), lambda before: first_where(i + 1, F.size(totals), lambda j: (total(j - 1) > before) & (total(j) > before + limit)))

        def step(s: Column, t: Column) -> Column:
            closes = (s["last"] > s["before"]) & (t > s["before"] + limit)
            return F.struct((s["i"] + 1).alias("i"), F.when(closes, s["last"]).otherwise(s["before"]).alias("before"), t.alias("last"), F.when(closes, F.concat(s["found"], F.array(s["i"]))).otherwise(s["found"]).alias("found"))

        none = F.lit(0).cast("long")
        start = F.struct(F.lit(0).alias("i"), none.alias("before"), none.alias("last"), F.array(F.lit(0)).alias("found"))
        return F.when(F.size(totals) <= FEW, F.aggregate(totals, start, step)["found"]).otherwise(greedy_starts(F.size(totals), follow))

    packed = grouped.select("call_id", F.posexplode(slices(F.col("rs"), let(F.col("rs.total"), batches))).alias("batch", "own"))
    return packed.select("call_id", (F.col("batch") + 1).alias("batch"), F.explode("own").alias("r")).select("call_id", "r.charge_id", "batch", "r.n_facts")


def fact_uses(rules: DataFrame) -> DataFrame:
    """(charge_id, fact, uses): where each fact's conditions stand in its rule, in words."""
    conditions = rule_conditions(rules)
    words = F.concat(F.col("place"), F.lit(" when "), "fact", F.lit(" "), "op", F.lit(" "), F.array_join("value", ", "))
    return conditions.groupBy("charge_id", "fact").agg(F.array_join(F.array_sort(F.collect_set(words)), "; ").alias("uses"))


def rule_conditions(rules: DataFrame) -> DataFrame:
    """(charge_id, place, fact, op, value) of every condition of a rule, any_of opened."""
    def tagged(place, items):
        return F.transform(F.flatten(F.transform(F.coalesce(items, F.array()), lambda i: i["any_of"])), lambda c: F.struct(place.alias("place"), c["fact"].alias("fact"), c["op"].alias("op"), c["value"].alias("value")))

    r = F.col("rule")
    parts = F.concat(
        F.flatten(F.transform(r["exemptions"], lambda x: tagged(F.lit("exempt"), x["when"]))),
        tagged(F.lit("applies"), r["applies_when"]),
        F.flatten(F.transform(r["components"], lambda c: tagged(F.concat(F.lit("component "), c["id"]), c["when"]))),
        F.flatten(F.transform(r["adjustments"], lambda a: tagged(F.concat(F.lit("adjustment "), a["id"]), a["when"]))),
    )
    return rules.select("charge_id", F.explode(parts).alias("c")).select("charge_id", "c.*")


def units_of(rule: Column) -> Column:
    """array<struct<place, units>> of every unit count of a rule: the multiplier's, those of per-unit components and their time, and of bands' increments."""

    def at(place: Column, units: Column) -> Column:
        return F.struct(place.alias("place"), units.alias("units"))

    def of_component(c: Column) -> Column:
        name = F.concat(F.lit("component "), c["id"])
        bands = F.transform(F.coalesce(c["bands"], F.array()), lambda b: at(F.concat(name, F.lit(" increment")), b["inc_units"]))
        own = F.array(at(F.concat(name, F.lit(" units")), c["units"]), at(F.concat(name, F.lit(" time")), c["per_time"]))
        return F.when(c["kind"] == "banded", bands).when(c["kind"] == "per_unit", own).otherwise(F.slice(own, 1, 0))

    found = F.concat(F.array(at(F.lit("multiplier"), rule["multiplier"])), F.flatten(F.transform(F.coalesce(rule["components"], F.array()), of_component)))
    return F.filter(found, lambda u: u["units"].isNotNull())


def rule_units(rules: DataFrame) -> DataFrame:
    """(charge_id, place, basis, unit_size, rounding, above, less) of every unit count of a rule; rules without any have no rows."""
    return rules.select("charge_id", F.explode(units_of(F.col("rule"))).alias("u")).select("charge_id", "u.place", "u.units.basis", "u.units.unit_size", "u.units.rounding", "u.units.above", "u.units.less")
