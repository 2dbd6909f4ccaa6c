"""Quality gates: rule consistency, grounding, citations, accuracy and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import extract_numbers, parse_number
from ..functions.schemas import BASES, RATE
from .facts import units_of
from .quotes import retarget_citations
from .rulebook import unique_ids

__all__ = [
    "accuracy", "case_results", "clean_catalogue", "evidence", "forms_agree", "grounding_issues", "match_items", "recall", "resolve_refs", "retargeted_rules", "rule_numbers", "rule_problems", "table_reread_ok",
]


def _conditions(items: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(items, F.array()), lambda i: i["any_of"]))


def rule_problems(rules: DataFrame) -> DataFrame:
    """rules with problems, what makes a rule inconsistent: bands, tiers, ids, targets, subjects, and shapes of conditions."""
    r = F.col("rule")
    comps, adjustments = F.coalesce(r["components"], F.array()), F.coalesce(r["adjustments"], F.array())
    ids, facts = F.transform(comps, lambda c: c["id"]), F.transform(r["facts"], lambda f: f["name"])
    everything = F.concat(
        F.flatten(F.transform(F.coalesce(r["exemptions"], F.array()), lambda x: _conditions(x["when"]))), _conditions(r["applies_when"]),
        F.flatten(F.transform(comps, lambda c: _conditions(c["when"]))), F.flatten(F.transform(adjustments, lambda a: _conditions(a["when"]))),
    )

    def descending(bands: Column) -> Column:
        """Whether some band's end lies below its start, or the next one's start."""
        pairs = F.zip_with(F.slice(bands, F.lit(1), F.greatest(F.size(bands) - 1, F.lit(0))), F.slice(bands, F.lit(2), F.greatest(F.size(bands) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.exists(bands, lambda b: F.coalesce(b["upper"] < b["lower"], F.lit(False))) | F.exists(pairs, lambda p: p["b"]["lower"] <= p["a"]["lower"])

    def bad_tiers(tiers: Column) -> Column:
        inner = F.slice(tiers, F.lit(1), F.greatest(F.size(tiers) - 1, F.lit(0)))
        return (
            F.exists(tiers, lambda t: t["up_to"].isNotNull() & t["width"].isNotNull())
            | F.exists(inner, lambda t: t["up_to"].isNull() & t["width"].isNull())
            | F.exists(tiers, lambda t: F.coalesce(t["end"] <= t["start"], F.lit(False)))
        )

    less = F.filter(F.transform(units_of(r), lambda u: u["units"]["less"]), lambda s: s.isNotNull())
    bases = F.array(*[F.lit(b) for b in BASES])
    numeric = F.concat(F.transform(F.filter(F.coalesce(r["facts"], F.array()), lambda f: f["type"] == "number"), lambda f: f["name"]), bases)
    known = F.concat(facts, bases)
    checks = {
        "a priced rule needs a component": (F.coalesce(r["status"], F.lit("priced")) == "priced") & (F.size(comps) == 0),
        "maximum below minimum": r["maximum"] < r["minimum"],
        "component ids repeat": F.size(F.array_distinct(ids)) < F.size(ids),
        "fact names repeat": F.size(F.array_distinct(facts)) < F.size(facts),
        "a fact is named like a quantity": F.size(F.array_intersect(facts, bases)) > 0,
        "an adjustment's target is unknown": F.exists(adjustments, lambda a: F.size(F.array_except(F.coalesce(a["applies_to"], F.array().cast("array<string>")), F.concat(ids, F.array(F.lit("all"))))) > 0),
        "a condition's subject is unknown": F.size(F.array_except(F.transform(everything, lambda c: c["fact"]), known)) > 0,
        "a subtracted subject is neither a quantity nor a number": F.size(F.array_except(less, numeric)) > 0,
        "bands don't ascend": F.exists(comps, lambda c: F.coalesce(descending(c["bands"]), F.lit(False))),
        "tiers don't ascend": F.exists(comps, lambda c: F.coalesce(bad_tiers(c["tiers"]), F.lit(False))),
        "only `in` takes several values": F.exists(everything, lambda c: (c["op"] != "in") & (F.size(c["value"]) != 1)),
        "a case, exemption or adjustment lacks conditions": F.exists(F.filter(comps, lambda c: c["kind"] == "unpriced"), lambda c: F.size(F.coalesce(c["when"], F.array())) == 0)
        | F.exists(F.coalesce(r["exemptions"], F.array()), lambda x: F.size(F.coalesce(x["when"], F.array())) == 0) | F.exists(adjustments, lambda a: F.size(F.coalesce(a["when"], F.array())) == 0),
        "an id isn't an identifier": ~F.forall(F.concat(ids, facts), lambda i: i.rlike("^[a-z][a-z0-9_]*$")),
    }
    return rules.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in checks.items()])))


def rule_numbers(rules: DataFrame) -> DataFrame:
    """(rule_id, path, value): every number that a rule states, but 0 and 1, which need not be printed."""
    r = F.col("rule")

    def n(path: Column | str, value: Column) -> Column:
        return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), value.cast(RATE).alias("value"))

    def units(path: Column, u: Column) -> Column:
        return F.array(n(F.concat(path, F.lit(".unit_size")), u["unit_size"]), n(F.concat(path, F.lit(".above")), u["above"]))

    def of_component(c: Column) -> Column:
        at = F.concat(F.lit("components."), c["id"])
        bands = F.flatten(F.transform(F.coalesce(c["bands"], F.array()), lambda b: F.concat(F.array(n(F.concat(at, F.lit(".lower")), b["lower"]), n(F.concat(at, F.lit(".upper")), b["upper"]), n(F.concat(at, F.lit(".base_fee")), b["base_fee"]), n(F.concat(at, F.lit(".increment")), b["inc_rate"])), units(F.concat(at, F.lit(".increment")), b["inc_units"]))))
        tiers = F.flatten(F.transform(F.coalesce(c["tiers"], F.array()), lambda t: F.array(n(F.concat(at, F.lit(".up_to")), t["up_to"]), n(F.concat(at, F.lit(".width")), t["width"]), n(F.concat(at, F.lit(".rate")), t["rate"]), n(F.concat(at, F.lit(".tier_unit")), t["unit_size"]))))
        return F.concat(F.array(n(F.concat(at, F.lit(".amount")), c["amount"]), n(F.concat(at, F.lit(".rate")), c["rate"])), units(F.concat(at, F.lit(".units")), c["units"]), units(F.concat(at, F.lit(".per_time")), c["per_time"]), bands, tiers, tested(at, c["when"]))

    def tested(path: Column | str, items: Column) -> Column:
        values = F.flatten(F.transform(_conditions(items), lambda c: F.transform(c["value"], lambda v: parse_number(v))))
        return F.transform(values, lambda v: n(F.concat(F.lit(path) if isinstance(path, str) else path, F.lit(".when")), v))

    found = F.concat(
        F.array(n("minimum", r["minimum"]), n("maximum", r["maximum"])), units(F.lit("multiplier"), r["multiplier"]), tested("applies_when", r["applies_when"]),
        F.flatten(F.transform(F.coalesce(r["exemptions"], F.array()), lambda x: tested("exemptions", x["when"]))),
        F.flatten(F.transform(F.coalesce(r["components"], F.array()), of_component)),
        F.flatten(F.transform(F.coalesce(r["adjustments"], F.array()), lambda a: F.concat(F.array(n(F.concat(F.lit("adjustments."), a["id"]), a["percent"])), tested(F.concat(F.lit("adjustments."), a["id"]), a["when"])))),
    )
    return rules.select("rule_id", F.explode(found).alias("n")).select("rule_id", "n.path", "n.value").where("value is not null and value not in (0, 1)").distinct()


def _citations(rules: DataFrame) -> DataFrame:
    cited = F.concat(F.coalesce(F.col("rule.citations"), F.array()), F.filter(F.transform(F.coalesce("rule.exemptions", F.array()), lambda x: x["citation"]), lambda c: c.isNotNull()), F.filter(F.transform(F.coalesce("rule.adjustments", F.array()), lambda a: a["citation"]), lambda c: c.isNotNull()))
    return rules.select("rule_id", F.posexplode(cited).alias("pos", "c")).select("rule_id", "pos", "c.chunk_id", "c.section_ref", "c.page", "c.quote")


def grounding_issues(rules: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule_id, path, issue): cited chunks that don't exist, quotes that aren't in theirs, numbers that no cited text prints.

    Numbers are extracted once from each cited chunk; rule numbers and printed numbers meet by (rule, value), an anti-join keeps the rest.
    Printed numbers that no rule's type can hold match none.
    """
    cited = _citations(rules).join(chunks.select("chunk_id", "content", F.lit(True).alias("there")), "chunk_id", "left")
    path = F.concat(F.lit("citations."), F.col("pos").cast("string"))
    missing = cited.where("there is null").select("rule_id", path.alias("path"), F.lit("no such chunk").alias("issue"))
    quotes = cited.where(F.col("there") & ~F.coalesce(T.quote_in(F.col("quote"), F.col("content")), F.lit(False))).select("rule_id", path.alias("path"), F.lit("quote not in the chunk").alias("issue"))
    pairs = _citations(rules).select("rule_id", "chunk_id").distinct()
    held = chunks.join(pairs.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.explode(F.array_distinct(extract_numbers(F.col("content")))).alias("value"))
    printed = pairs.join(held, "chunk_id").select("rule_id", F.col("value").try_cast(RATE).alias("value")).where("value is not null").distinct()
    numbers = rule_numbers(rules).join(printed, ["rule_id", "value"], "left_anti").select("rule_id", "path", F.lit("number not in the cited text").alias("issue"))
    return missing.unionByName(quotes).unionByName(numbers)


def resolve_refs(entries: DataFrame, refs: DataFrame, within: str | None = None) -> DataFrame:
    """(entry_id, pos, asked, ref): each asked section ref's longest dotted prefix that exists; null where none does.

    within names a field of a struct entry_id, and a column of refs, that have to be equal: a document has its own sections.
    """
    asked = entries.select("entry_id", F.posexplode("refs").alias("pos", "asked")).withColumn("clean", F.regexp_replace(F.trim("asked"), "\\.+$", ""))
    parts = F.split("clean", "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("ref")))
    tried = asked.select("entry_id", "pos", "asked", F.explode(prefixes).alias("p")).select("entry_id", "pos", "asked", "p.depth", "p.ref")
    if within:
        tried = tried.withColumn("__in", F.col("entry_id")[within])
    there = refs.select("ref", *([F.col(within).alias("__in")] if within else [])).distinct().withColumn("there", F.lit(True))
    known = tried.join(there, ["ref", *(["__in"] if within else [])], "left")
    return known.groupBy("entry_id", "pos", "asked").agg(F.max_by(F.when(F.col("there"), F.col("ref")), F.when(F.col("there"), F.col("depth"))).alias("ref"))


def clean_catalogue(entries: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned, unknown) of a catalogue as it was discovered: entries (document_id, pos, charge_id, section_refs) against refs (document_id, ref).

    cleaned has document_id, pos, charge_id, asked_id and section_refs: refs at their longest prefix that exists, each once in order of first
    mention; entries that keep none are left out; repeated ids are made unique among those that stay. unknown has
    document_id, pos, charge_id and refs, those of an entry that no prefix resolves, as they were asked.
    """
    keyed = entries.select(F.struct("document_id", "pos").alias("entry_id"), F.col("section_refs").alias("refs"))
    parts = resolve_refs(keyed, refs, within="document_id")
    found = parts.where("ref is not null").groupBy("entry_id", "ref").agg(F.min("pos").alias("first"))
    own = found.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("first", "ref"))).alias("rs")).select("entry_id.document_id", "entry_id.pos", F.col("rs.ref").alias("section_refs"))
    kept = entries.select("document_id", "pos", "charge_id").join(own, ["document_id", "pos"])
    named = unique_ids(kept, "document_id", "pos").select("document_id", "pos", F.col("charge_id").alias("asked_id"), F.col("unique_id").alias("charge_id"))
    lost = parts.where("ref is null").groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("pos", "asked"))).alias("rs")).select("entry_id.document_id", "entry_id.pos", F.col("rs.asked").alias("refs"))
    return named.join(kept.drop("charge_id"), ["document_id", "pos"]), entries.select("document_id", "pos", "charge_id").join(lost, ["document_id", "pos"])


def match_items(expected: DataFrame, items: DataFrame) -> DataFrame:
    """expected (case_id, pos, section, section_title, amount, tolerance_pct) with the first line item (by item_pos) of its section ref, or of its section title in any case."""
    refs = items.select("case_id", "item_pos", F.col("amount").alias("computed"), F.explode("section_refs").alias("section"))
    titles = items.select("case_id", "item_pos", F.col("amount").alias("computed"), F.explode("section_titles").alias("t")).withColumn("t", F.lower("t"))
    by_ref = expected.join(refs, ["case_id", "section"]).select("case_id", "pos", "item_pos", "computed")
    by_title = expected.withColumn("t", F.lower("section_title")).join(titles, ["case_id", "t"]).select("case_id", "pos", "item_pos", "computed")
    first = by_ref.unionByName(by_title).groupBy("case_id", "pos").agg(F.min(F.struct("item_pos", "computed")).alias("m"))
    return expected.join(first, ["case_id", "pos"], "left").withColumn("item_pos", F.col("m.item_pos")).withColumn("computed", F.col("m.computed")).drop("m")


def accuracy(matched: DataFrame) -> DataFrame:
    """matched with delta_pct and passed: within the tolerance; a missing item fails."""
    delta = (F.col("computed") - F.col("amount")) * 100 / F.col("amount")
    return matched.withColumn("delta_pct", F.round(delta.cast("decimal(18,6)"), 4)).withColumn("passed", F.coalesce(F.abs(delta) <= F.col("tolerance_pct"), F.lit(False)))


def recall(hits: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(n_queries, n_found, recall): the share of queries of which one of the first k hits is relevant."""
    best = hits.where(F.col("rank") <= k).join(relevant, ["query_id", "chunk_id"]).select("query_id").distinct().withColumn("found", F.lit(1))
    return queries.select("query_id").join(best, "query_id", "left").agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("found"), F.lit(0)).alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_queries"), 6))


def evidence(opened: DataFrame, seen: DataFrame, submitted: DataFrame) -> DataFrame:
    """(task_id, chunk_id): chunks opened before, and those submitted that were seen; all that were seen if nothing was submitted."""
    named = submitted.join(seen, ["task_id", "chunk_id"], "left_semi")
    silent = seen.join(submitted.select("task_id").distinct(), "task_id", "left_anti")
    return opened.select("task_id", "chunk_id").unionByName(named.select("task_id", "chunk_id")).unionByName(silent.select("task_id", "chunk_id")).distinct()


def table_reread_ok(page_text: Column, before: Column, after: Column) -> Column:
    """Whether a page's tables, read again, may replace those before: as many, and no number that the page doesn't print."""
    numbers = extract_numbers(F.array_join(after, "\n"))
    return (F.size(before) == F.size(after)) & (F.size(F.array_except(numbers, extract_numbers(page_text))) == 0)


def case_results(matched: DataFrame, totals: DataFrame) -> DataFrame:
    """(case_id, items_passed, total_passed, passed): a case passes if all its items do and its total is the expected one, where one is given.

    matched is accuracy's; totals has case_id, expected_total (or null) and total.
    """
    items = matched.groupBy("case_id").agg(F.bool_and("passed").alias("items_passed"))
    right = F.col("expected_total").isNull() | F.coalesce(F.col("total") == F.col("expected_total"), F.lit(False))
    return items.join(totals, "case_id").select("case_id", "items_passed", right.alias("total_passed"), (F.col("items_passed") & right).alias("passed"))


def forms_agree(first: DataFrame, second: DataFrame) -> DataFrame:
    """(case_id, agree): whether two forms of a case's input (case_id, charge_id, amount) come to the same amounts, charge by charge."""
    a, b = first.withColumn("__a", F.lit(True)), second.withColumnRenamed("amount", "other").withColumn("__b", F.lit(True))
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("amount").eqNullSafe(F.col("other"))
    return a.join(b, ["case_id", "charge_id"], "full_outer").groupBy("case_id").agg(F.bool_and(same).alias("agree"))


def retargeted_rules(rules: DataFrame, ordinals: DataFrame, chunks: DataFrame) -> DataFrame:
    """rules (rule_id, document_id, rule) of which every citation was found, pointing at this document's chunks; the others are left out.

    ordinals (document_id, chunk_id, ordinal) says where the chunks stood that the rules cite; chunks is retarget_citations'.
    Rules that are inconsistent then are left out too.
    """
    r = F.col("rule")
    cited = F.concat(F.coalesce(r["citations"], F.array()), F.transform(F.coalesce(r["exemptions"], F.array()), lambda x: x["citation"]), F.transform(F.coalesce(r["adjustments"], F.array()), lambda a: a["citation"]))
    flat = rules.select("rule_id", "document_id", F.posexplode(cited).alias("pos", "c")).where("c is not null").select("rule_id", "document_id", "pos", "c.chunk_id", "c.section_ref", "c.quote")
    placed = flat.join(ordinals, ["document_id", "chunk_id"], "left").select("rule_id", "document_id", "pos", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), "section_ref", "quote")
    found = retarget_citations(placed, chunks).groupBy("rule_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "chunk_id"))).alias("__to"), F.bool_and(F.col("chunk_id").isNotNull()).alias("__all"))
    joined = rules.join(found, "rule_id", "left").where("__all is null or __all")

    def moved(c: Column, pos: Column) -> Column:
        return F.when(c.isNotNull(), c.withField("chunk_id", F.try_element_at("__to", pos)))

    n_own, n_exempt = F.coalesce(F.size(r["citations"]), F.lit(0)), F.coalesce(F.size(r["exemptions"]), F.lit(0))
    rule = r.withField("citations", F.transform(r["citations"], moved))
    rule = rule.withField("exemptions", F.transform(r["exemptions"], lambda x, i: x.withField("citation", moved(x["citation"], n_own + i))))
    rule = rule.withField("adjustments", F.transform(r["adjustments"], lambda a, i: a.withField("citation", moved(a["citation"], n_own + n_exempt + i))))
    return rule_problems(joined.withColumn("rule", rule).drop("__to", "__all")).where(F.size("problems") == 0).drop("problems")
