"""Rating: calls joined to rules, every rule evaluated within its row, and totals by call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import NUMBER, format_number, let, parse_number, round_money
from ..functions.schemas import AMOUNT, BASES, MONEY, RATE, UNIT_COUNT

__all__ = ["call_totals", "grand_total", "prepared", "rate", "sensitivity", "with_tier_ends"]

TRUE, FALSE, ERROR = "T", "F", "E:"
# The wordings of a charge that isn't priced, of an assumed fact, and of operators.
DEFAULT_REASONS = {
    "on_application": "Quoted on application.",
    "not_priced_in_document": "The document does not state a rate for this charge.",
}
NO_COMPONENT = "No pricing component of this charge applies to the vessel call"
COMPUTES_TO_ZERO = "Computes to zero for this call."
ASSUMED = ": assumed "
OPERATORS = {"eq": "=", "ne": "≠", "lt": "<", "le": "≤", "gt": ">", "ge": "≥", "in": "in"}

_NO_WORDS = "array<string>"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _is_error(state: Column) -> Column:
    return F.startswith(state, F.lit(ERROR))


def _list(value: Column) -> Column:
    return F.coalesce(value, F.array())


def _truth(text: Column) -> Column:
    plain = F.lower(F.trim(text))
    return F.when(plain.isin("true", "yes"), True).when(plain.isin("false", "no"), False)


# rule side --------------------------------------------------------------------


def with_tier_ends(rules: DataFrame) -> DataFrame:
    """rules with each tier's start and end: its up_to, else the end before plus its width, else none; a start is the end before.

    Ends are fixed once on the rule side, so that pricing a call needs no order among tiers.
    """

    def of(component: Column) -> Column:
        def fold(acc: Column, tier: Column) -> Column:
            last = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0).cast(RATE))
            end = F.coalesce(tier["up_to"], (last + tier["width"]).cast(RATE))
            return F.concat(acc, F.array(F.struct(tier["up_to"].alias("up_to"), tier["width"].alias("width"), last.alias("start"), end.alias("end"), tier["rate"].alias("rate"), tier["unit_size"].alias("unit_size"), tier["rounding"].alias("rounding"))))

        kind = rules.schema["rule"].dataType["components"].dataType.elementType["tiers"].dataType
        return component.withField("tiers", F.aggregate(F.coalesce(component["tiers"], F.array().cast(kind)), F.array().cast(kind), fold))

    return rules.withColumn("rule", F.col("rule").withField("components", F.transform("rule.components", of)))


def _plan(rule: Column) -> Column:
    """What of a rule doesn't depend on the call: condition lists with typed operands, components by kind, and how many lists there are of each kind.

    lists holds the lists of exemptions, each item of applies_when alone, cases without a price, priced components and
    adjustments, in this order; parts of a result are told apart by their place.
    """
    facts = F.coalesce(rule["facts"], F.array())
    unpriced = F.filter(_list(rule["components"]), lambda c: c["kind"] == "unpriced")
    priced = F.filter(_list(rule["components"]), lambda c: c["kind"] != "unpriced")

    def condition(c: Column) -> Column:
        def typed(fact: Column) -> Column:
            numbers = F.transform(c["value"], lambda v: parse_number(v))
            kind = F.when(c["fact"].isin(BASES), "quantity").otherwise(F.coalesce(fact["type"], F.lit("text")))
            return F.struct(
                c["fact"].alias("fact"), c["op"].alias("op"), kind.alias("kind"), fact["default_value"].alias("fallback"), numbers.alias("numbers"),
                F.exists(numbers, lambda n: n.isNull()).alias("unreadable"), _truth(F.get(c["value"], F.lit(0))).alias("truth"), F.transform(c["value"], lambda v: F.lower(F.trim(v))).alias("words"),
            )

        return let(F.try_element_at(F.filter(facts, lambda f: f["name"] == c["fact"]), F.lit(1)), typed)

    def conditions(items: Column) -> Column:
        return F.transform(_list(items), lambda i: F.transform(i["any_of"], condition))

    def whens(rows: Column) -> Column:
        return F.transform(rows, lambda r: conditions(r["when"]))

    exemptions, items, adjustments = _list(rule["exemptions"]), _list(rule["applies_when"]), _list(rule["adjustments"])
    lists = F.concat(whens(exemptions), F.transform(items, lambda i: conditions(F.array(i))), whens(unpriced), whens(priced), whens(adjustments))
    sizes = [F.size(x).alias(name) for name, x in (("n_exempt", exemptions), ("n_items", items), ("n_unpriced", unpriced), ("n_priced", priced), ("n_adjust", adjustments))]
    return F.struct(lists.alias("lists"), F.transform(unpriced, lambda c: c["label"]).alias("cases"), priced.alias("priced"), *sizes)


def prepared(rules: DataFrame) -> DataFrame:
    """rules with tier ends and with plan, the part of pricing that is the same for all calls; rate computes it by row where it is absent."""
    return with_tier_ends(rules).withColumn("plan", _plan(F.col("rule")))


# one row ----------------------------------------------------------------------


class _Row:
    """Expressions over one candidate row: quantities, facts and rule."""

    def __init__(self) -> None:
        self.rule, self.plan, self.quantities, self.facts = F.col("rule"), F.col("plan"), F.col("quantities"), F.col("facts")

    def quantity(self, basis: Column) -> Column:
        return F.try_element_at(self.quantities, F.coalesce(basis, F.lit("")))

    def stated(self, fact: Column) -> Column:
        return F.try_element_at(self.facts, F.coalesce(fact, F.lit("")))

    def condition(self, c: Column) -> Column:
        """T, F, or E: and a message."""
        op, words = c["op"], c["words"]
        wrong_op = _text(ERROR, c["fact"], " can't be tested with ", op)

        def yes(holds: Column) -> Column:
            return F.when(holds, TRUE).otherwise(FALSE)

        def number(n: Column) -> Column:
            w = F.get(c["numbers"], F.lit(0))
            holds = (
                F.when(op == "eq", n == w).when(op == "ne", n != w).when(op == "lt", n < w).when(op == "le", n <= w).when(op == "gt", n > w).when(op == "ge", n >= w)
                .when(op == "in", F.exists(c["numbers"], lambda x: x == n))
            )
            return F.when(n.isNull() | c["unreadable"], _text(ERROR, c["fact"], " is not a number")).when(holds.isNull(), wrong_op).otherwise(yes(holds))

        def fact(s: Column) -> Column:
            left, folded = _truth(s), F.lower(F.trim(s))
            as_bool = F.when(left.isNull() | c["truth"].isNull(), _text(ERROR, c["fact"], " is not true or false")).when(op == "eq", yes(left == c["truth"])).when(op == "ne", yes(left != c["truth"])).otherwise(wrong_op)
            as_text = F.when(op == "eq", yes(folded == F.get(words, F.lit(0)))).when(op == "ne", yes(folded != F.get(words, F.lit(0)))).when(op == "in", yes(F.array_contains(words, folded))).otherwise(wrong_op)
            return F.when(s.isNull(), _text(ERROR, "no value for ", c["fact"])).when(c["kind"] == "number", let(parse_number(s), number)).when(c["kind"] == "bool", as_bool).otherwise(as_text)

        def quantity(q: Column) -> Column:
            return F.when(q.isNull(), _text(ERROR, "no value for ", c["fact"])).otherwise(number(q.cast(NUMBER)))

        return F.when(c["kind"] == "quantity", let(self.quantity(c["fact"]), quantity)).otherwise(let(F.coalesce(self.stated(c["fact"]), c["fallback"]), fact))

    def count(self, units: Column) -> Column:
        """(n, error) of units: what of the quantity lies above the free part, by the size of a unit, rounded.

        What is deducted may be a quantity or a fact. Ceil and floor come from the whole quotient and its remainder, so no digit is lost before.
        """

        def of(v: Column) -> Column:
            zero = F.lit(0).cast("decimal(20,6)")
            over = F.greatest(v["basis"] - F.coalesce(units["above"], zero) - F.coalesce(v["less"], zero), zero).cast("decimal(20,6)")
            missing = F.when(v["basis"].isNull(), units["basis"]).when(units["less"].isNotNull() & v["less"].isNull(), units["less"])
            return F.struct(_units_of(over, units["unit_size"], units["rounding"]).alias("n"), F.when(missing.isNotNull(), _text("no value for quantity ", missing)).alias("error"))

        declared = F.try_element_at(F.filter(self.rule["facts"], lambda f: f["name"] == units["less"]), F.lit(1))
        fact = F.when(units["less"].isNotNull() & ~units["less"].isin(BASES), parse_number(F.coalesce(self.stated(units["less"]), declared["default_value"])).try_cast("decimal(20,6)"))
        return let(F.struct(self.quantity(units["basis"]).alias("basis"), F.coalesce(self.quantity(units["less"]), fact).alias("less")), of)

    def component(self, c: Column) -> Column:
        """(id, label, skipped, amount, error, n, m, q, band): a component that applies; n and m are unit counts, q and band what a band was found by."""

        def result(amount: Column, error: Column | None = None, n: Column | None = None, m: Column | None = None, q: Column | None = None, band: Column | None = None) -> Column:
            def or_null(value: Column | None, kind: str) -> Column:
                return F.lit(None).cast(kind) if value is None else value.cast(kind)

            error = or_null(error, "string")
            return F.struct(
                c["id"].alias("id"), F.lit(False).alias("skipped"), F.when(error.isNull(), amount.try_cast(AMOUNT)).alias("amount"), error.alias("error"),
                or_null(n, UNIT_COUNT).alias("n"), or_null(m, UNIT_COUNT).alias("m"), or_null(q, "decimal(20,6)").alias("q"), or_null(band, "int").alias("band"),
            )

        def by_unit(u: Column) -> Column:
            timed = c["per_time"].isNotNull()
            first = (c["rate"] * u["a"]["n"]).try_cast(AMOUNT)
            amount = F.when(timed, (first * u["b"]["n"]).try_cast(AMOUNT)).otherwise(first)
            return result(amount, F.coalesce(u["a"]["error"], F.when(timed, u["b"]["error"])), u["a"]["n"], F.when(timed, u["b"]["n"]))

        def no_value(q: Column) -> Column:
            return F.when(q.isNull(), _text("no value for quantity ", c["basis"]))

        def banded(q: Column) -> Column:
            def in_band(i: Column) -> Column:
                band = F.get(c["bands"], i - 1)
                has = band["inc_rate"].isNotNull()

                def priced(u: Column) -> Column:
                    extra = F.when(has, (band["inc_rate"] * u["n"]).try_cast(AMOUNT)).otherwise(F.lit(0).cast(AMOUNT))
                    amount = (F.coalesce(band["base_fee"], F.lit(0).cast(RATE)) + extra).try_cast(AMOUNT)
                    error = F.coalesce(no_value(q), F.when(i == 0, _text(c["label"], ": no band holds ", format_number(q))), F.when(has, u["error"]))
                    return result(amount, error, F.when(has, u["n"]), None, q, i)

                return let(self.count(band["inc_units"]), priced)

            holds = F.transform(c["bands"], lambda b: F.coalesce((b["lower"] <= q) & (b["upper"].isNull() | (q <= b["upper"])), F.lit(False)))
            return let(F.array_position(holds, True).cast("int"), in_band)

        def tiered(q: Column) -> Column:
            def slice_of(t: Column) -> Column:
                size = F.greatest(F.least(q, F.coalesce(t["end"], q)) - F.coalesce(t["start"], F.lit(0)), F.lit(0)).cast("decimal(20,6)")
                return (_units_of(size, t["unit_size"], t["rounding"]) * t["rate"]).try_cast(AMOUNT)

            return result(F.aggregate(F.transform(c["tiers"], slice_of), F.lit(0).cast(AMOUNT), lambda a, x: (a + x).cast(AMOUNT)), no_value(q), None, None, q)

        per_unit = let(F.struct(self.count(c["units"]).alias("a"), self.count(c["per_time"]).alias("b")), by_unit)
        basis = self.quantity(c["basis"])
        return F.when(c["kind"] == "fixed", result(c["amount"])).when(c["kind"] == "per_unit", per_unit).when(c["kind"] == "banded", let(basis, banded)).when(c["kind"] == "tiered", let(basis, tiered))


def _units_of(over: Column, size: Column, rounding: Column) -> Column:
    size = F.coalesce(F.nullif(size, F.lit(0).cast("decimal(12,6)")), F.lit(1).cast("decimal(12,6)"))
    whole = F.call_function("div", over, size)
    n = F.when(rounding == "ceil", whole + F.when(over % size > 0, 1).otherwise(0)).when(rounding == "floor", whole)
    return F.coalesce(n.try_cast(UNIT_COUNT), F.when(~F.coalesce(rounding, F.lit("")).isin("ceil", "floor"), (over / size).cast("decimal(28,10)").try_cast(UNIT_COUNT)))


def _item_state(states: Column) -> Column:
    """Of an item's conditions in order, the first that isn't F decides."""
    return F.coalesce(F.try_element_at(F.filter(states, lambda s: s != FALSE), F.lit(1)), F.lit(FALSE))


def _list_state(items: Column) -> Column:
    """Of a list's items in order, the first that isn't T decides; an empty list holds."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(items, _item_state), lambda s: s != TRUE), F.lit(1)), F.lit(TRUE))


def _total(amounts: Column) -> Column:
    return F.aggregate(amounts, F.lit(0).cast(AMOUNT), lambda s, a: (s + a).cast(AMOUNT))


def rate(candidates: DataFrame) -> DataFrame:
    """(call_id, charge_id, status, amount, currency, reason, formula, assumptions, adjustments, citations, error) of each candidate.

    candidates has call_id, charge_id, rule, quantities map<string,decimal(20,6)>, assumptions map<string,string> and facts
    map<string,string>, and plan, if the rules are prepared; a null rule fails. Everything is computed within the row, in the order
    exemptions, conditions, cases without a price, components; an error counts only if it is reached, and then status is
    failed. No shuffle. The numbers are made first, in one struct that passes an explode of one element: filters and
    selections above it don't reach into what it is made of, and the texts are made above it, only where they are asked for.
    """
    row = _Row()
    rule, plan = row.rule, row.plan
    extra = [c for c in candidates.columns if c not in ("rule", "plan", "quantities", "assumptions", "facts")]
    rows = candidates if "plan" in candidates.columns else candidates.withColumn("plan", _plan(rule))
    states = F.transform(plan["lists"], lambda items: F.transform(items, lambda conditions: F.transform(conditions, row.condition)))
    rows = rows.withColumn("__s", states).withColumn("__l", F.transform("__s", _list_state))
    at_items, at_cases = plan["n_exempt"], plan["n_exempt"] + plan["n_items"]
    at_priced = at_cases + plan["n_unpriced"]
    at_adjust = at_priced + plan["n_priced"]

    def first(start: Column | int, n: Column, unless: str) -> Column:
        """(s, i): the first state of these lists that isn't `unless`, and its place among them."""
        part = F.transform(F.slice("__l", (F.lit(start) if isinstance(start, int) else start) + 1, n), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
        return F.try_element_at(F.filter(part, lambda t: t["s"] != unless), F.lit(1))

    rows = rows.withColumns({"__x": first(0, plan["n_exempt"], FALSE), "__u": first(at_items, plan["n_items"], TRUE), "__n": first(at_cases, plan["n_unpriced"], FALSE)})
    x, u, n = F.col("__x"), F.col("__u"), F.col("__n")
    plain = rule["status"].isNull() | (rule["status"] == "priced")

    def gate(kind: str, status: Column | str, i: Column | None = None, error: Column | str | None = None) -> Column:
        error = error if isinstance(error, Column) else F.lit(error)
        return F.struct(F.lit(kind).alias("kind"), (status if isinstance(status, Column) else F.lit(status)).alias("status"), (F.lit(None) if i is None else i).cast("int").alias("i"), error.cast("string").alias("error"))

    def message(state: Column) -> Column:
        return F.substring(state, len(ERROR) + 1, F.length(state))

    gates = (
        F.when(rule.isNull(), gate("failed", "failed", None, "no rule in use for this charge"))
        .when(~plain, gate("status", F.when(rule["status"].isin("not_priced_in_document", "on_application"), rule["status"]).otherwise("not_applicable")))
        .when(_is_error(x["s"]), gate("failed", "failed", None, message(x["s"]))).when(x["s"] == TRUE, gate("exempt", "not_applicable", x["i"]))
        .when(_is_error(u["s"]), gate("failed", "failed", None, message(u["s"]))).when(u["s"] == FALSE, gate("requires", "not_applicable", u["i"]))
        .when(_is_error(n["s"]), gate("failed", "failed", None, message(n["s"]))).when(n["s"] == TRUE, gate("case", "not_priced_in_document", n["i"]))
    )
    rows = rows.withColumn("__g", gates)
    going = F.col("__g").isNull()

    def applied(c: Column, i: Column) -> Column:
        def by_state(state: Column) -> Column:
            def none(skipped: bool, error: Column) -> Column:
                empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("n", UNIT_COUNT), ("m", UNIT_COUNT), ("q", "decimal(20,6)"), ("band", "int"))]
                return F.struct(c["id"].alias("id"), F.lit(skipped).alias("skipped"), F.lit(None).cast(AMOUNT).alias("amount"), error.cast("string").alias("error"), *empty)

            return F.when(state == FALSE, none(True, F.lit(None))).when(state == TRUE, row.component(c)).otherwise(none(False, message(state)))

        return let(F.get("__l", at_priced + i), by_state)

    rows = rows.withColumn("__c", F.when(going, F.transform(plan["priced"], applied)))
    first_error = F.try_element_at(F.filter(F.transform("__c", lambda c: c["error"]), lambda e: e.isNotNull()), F.lit(1))
    has_multiplier = rule["multiplier"].isNotNull()
    rows = rows.withColumns({"__e": first_error, "__a": F.filter("__c", lambda c: ~c["skipped"]), "__m": F.when(going & has_multiplier, row.count(rule["multiplier"]))})
    rows = rows.withColumn("__sum", _total(F.transform("__a", lambda c: c["amount"])))
    subtotal = F.col("__sum")
    rows = rows.withColumn("__k", F.when(subtotal < rule["minimum"], rule["minimum"].cast(AMOUNT)).when(subtotal > rule["maximum"], rule["maximum"].cast(AMOUNT)).otherwise(subtotal))
    factor = F.coalesce(F.col("__m")["n"], F.lit(1).cast(UNIT_COUNT))
    rows = rows.withColumn("__b", (F.col("__k") * factor).try_cast(AMOUNT))

    # adjustments: percents of the amount or of the targeted components, for those whose conditions hold
    def effect(a: Column, i: Column) -> Column:
        target = F.filter("__a", lambda c: F.array_contains(a["applies_to"], c["id"]))
        part = (_total(F.transform(target, lambda c: c["amount"])) * factor).try_cast(AMOUNT)
        whole = a["applies_to"].isNull() | F.array_contains(a["applies_to"], "all")
        share = (F.when(whole, F.col("__b")).otherwise(part) * a["percent"] / F.lit(100).cast("decimal(3,0)")).try_cast(AMOUNT)
        return F.struct(F.get("__l", at_adjust + i).alias("s"), F.struct(a["id"].alias("id"), a["kind"].alias("kind"), a["percent"].alias("percent"), a["exclusive_group"].alias("exclusive_group"), F.when(a["kind"] == "reduction", -share).otherwise(share).alias("effect")).alias("a"))

    rows = rows.withColumn("__t", F.when(going, F.transform(_list(rule["adjustments"]), effect)))
    rows = rows.withColumns({"__te": F.try_element_at(F.filter(F.transform("__t", lambda t: t["s"]), _is_error), F.lit(1)), "__h": F.transform(F.filter("__t", lambda t: t["s"] == TRUE), lambda t: t["a"])})

    def wins(a: Column, i: Column) -> Column:
        """Outside groups all apply; in a group the largest effect, the first listed on ties."""
        others = F.transform("__h", lambda o, j: F.struct(o["exclusive_group"].alias("g"), F.abs(o["effect"]).alias("e"), j.alias("j")))
        beaten = F.exists(others, lambda o: (o["g"] == a["exclusive_group"]) & ((o["e"] > F.abs(a["effect"])) | ((o["e"] == F.abs(a["effect"])) & (o["j"] < i))))
        return a["exclusive_group"].isNull() | ~beaten

    rows = rows.withColumn("__w", F.filter("__h", wins))
    moved = (F.col("__b") + _total(F.transform("__w", lambda a: a["effect"]))).cast(AMOUNT)
    rows = rows.withColumn("__f", F.when(F.size("__w") > 0, F.greatest(moved, F.lit(0).cast(AMOUNT))).otherwise(moved))
    some = F.size("__a") > 0
    error = F.coalesce(F.col("__g")["error"], F.when(going, F.coalesce(F.col("__e"), F.when(some, F.coalesce(F.col("__m")["error"], message(F.col("__te")))))))
    rows = rows.withColumns({"__error": error, "__amount": F.when(going & some, round_money(F.col("__f")))})
    amount = F.col("__amount")
    status = (
        F.when(F.col("__error").isNotNull(), "failed").when(~going, F.col("__g")["status"]).when(~some, "not_applicable").when(amount == 0, "not_applicable")
        .when(amount.isNull(), "failed").otherwise("charged")
    )
    fields = {"status": status, "amount": amount, "error": F.col("__error"), "gate": F.col("__g"), "states": F.col("__s"), "lists": F.col("__l"), "parts": F.col("__c"), "sum": subtotal, "clamped": F.col("__k"), "factor": factor, "before": F.col("__b"), "won": F.col("__w"), "final": F.col("__f")}
    one = F.struct(*[v.alias(k) for k, v in fields.items()])
    made = rows.select(*extra, "rule", "plan", "facts", "assumptions", F.explode(F.array(one)).alias("__r"))
    r = F.col("__r")
    going, some, charged = r["gate"].isNull(), F.size(F.filter(r["parts"], lambda c: ~c["skipped"])) > 0, r["status"] == "charged"
    exempt = F.coalesce(r["gate"]["kind"] == "exempt", F.lit(False))
    exemption = F.get(rule["exemptions"], r["gate"]["i"])
    return made.select(
        *extra,
        r["status"].alias("status"),
        F.when(charged, r["amount"]).alias("amount"),
        rule["currency"].alias("currency"),
        F.when(r["error"].isNull(), F.when(~going, _reason(rule, plan, r["gate"])).when(~some, NO_COMPONENT).when(r["amount"] == 0, COMPUTES_TO_ZERO)).alias("reason"),
        F.when(going & r["error"].isNull() & some, _formula(rule, plan, r)).alias("formula"),
        F.when(r["error"].isNull(), _used_assumptions(rule, plan, r, F.col("facts"), F.col("assumptions"))).alias("assumptions"),
        F.transform(r["won"], lambda a: F.struct(a["id"].alias("id"), a["kind"].alias("kind"), a["percent"].alias("percent"), a["effect"].cast(MONEY).alias("amount"))).alias("adjustments"),
        F.when(exempt & exemption["citation"].isNotNull(), F.array(exemption["citation"])).otherwise(rule["citations"]).alias("citations"),
        r["error"].alias("error"),
    )


# texts ------------------------------------------------------------------------


def _shown(value: Column) -> Column:
    """A fact's value in words: yes and no for truths."""
    truth = _truth(value)
    return F.when(truth, "yes").when(~truth, "no").otherwise(value)


def _declared(rule: Column, name: Column) -> Column:
    return F.try_element_at(F.filter(rule["facts"], lambda f: f["name"] == name), F.lit(1))


def _describe(rule: Column, item: Column) -> Column:
    """An item in words: facts by their description, operators by their signs."""
    signs = F.create_map(*[F.lit(x) for pair in OPERATORS.items() for x in pair])

    def one(c: Column) -> Column:
        return F.concat_ws(" ", F.coalesce(_declared(rule, c["fact"])["description"], c["fact"]), F.try_element_at(signs, c["op"]), F.array_join(F.transform(c["value"], _shown), ", "))

    return F.array_join(F.transform(item["any_of"], one), " or ")


def _reason(rule: Column, plan: Column, gate: Column) -> Column:
    default = F.when(rule["status"] == "not_applicable_at_port", _text("Not charged at ", rule["port_key"], "."))
    for status, words in DEFAULT_REASONS.items():
        default = F.when(rule["status"] == status, words).otherwise(default)
    notes = F.nullif(F.array_join(F.coalesce(rule["notes"], F.array().cast(_NO_WORDS)), " "), F.lit(""))
    return (
        F.when(gate["kind"] == "status", F.coalesce(notes, default))
        .when(gate["kind"] == "exempt", _text("Exempt: ", F.get(rule["exemptions"], gate["i"])["description"]))
        .when(gate["kind"] == "requires", _text("Not applicable: requires ", _describe(rule, F.get(rule["applies_when"], gate["i"]))))
        .when(gate["kind"] == "case", _text(F.get(plan["cases"], gate["i"]), ": the document gives no rate for this case."))
    )


def _formula(rule: Column, plan: Column, r: Column) -> Column:
    """The steps by which an amount came about."""

    def step(c: Column, p: Column) -> Column:
        shown = format_number(p["amount"])
        by_unit = _text(format_number(p["n"]), " × ", format_number(c["rate"]), F.when(p["m"].isNotNull(), _text(" × ", format_number(p["m"]))).otherwise(""), " = ", shown)
        said = F.when(c["kind"] == "fixed", shown).when(c["kind"] == "per_unit", by_unit).when(c["kind"] == "banded", _text("band from ", format_number(F.get(c["bands"], p["band"] - 1)["lower"]), " = ", shown)).otherwise(_text("by tiers of ", c["basis"], " = ", shown))
        return _text(c["label"], ": ", F.when(p["skipped"], "not applicable to this call").otherwise(said))

    several = F.size(F.filter(r["parts"], lambda p: ~p["skipped"])) > 1
    won = F.size(r["won"]) > 0
    return F.array_compact(F.concat(
        F.zip_with(plan["priced"], r["parts"], step),
        F.array(
            F.when(several, _text("Subtotal: ", format_number(r["sum"]))),
            F.when(r["clamped"] > r["sum"], _text("Minimum: ", format_number(r["clamped"]))),
            F.when(r["clamped"] < r["sum"], _text("Maximum: ", format_number(r["clamped"]))),
            F.when(rule["multiplier"].isNotNull(), _text("× ", format_number(r["factor"]), " (", rule["multiplier"]["basis"], ") = ", format_number(r["before"]))),
        ),
        F.transform(r["won"], lambda a: _text(a["id"], ": ", format_number(a["effect"]))),
        F.array(F.when(won, _text("After adjustments: ", format_number(r["final"]))), _text("Amount (rounded to cents): ", F.format_number(r["amount"], 2))),
    ))


def _used_assumptions(rule: Column, plan: Column, r: Column, facts: Column, assumptions: Column) -> Column:
    """Texts of derived quantities and of facts at their default that were touched on the evaluated path, distinct, in order of first use.

    A list is read up to its first item that doesn't hold, an item up to its first condition that does; what lies behind the
    gate that decided, and components that don't apply, touch nothing but their conditions.
    """

    def upto(states: Column, unless: str) -> Column:
        """How many of the states are read: up to the first that isn't `unless`, or all."""
        return F.coalesce(F.nullif(F.array_position(F.transform(states, lambda s: s != unless), True), F.lit(0).cast("long")).cast("int"), F.size(states))

    def touched(items: Column, states: Column) -> Column:
        names = F.zip_with(items, states, lambda conditions, s: F.slice(F.transform(conditions, lambda c: c["fact"]), F.lit(1), upto(s, FALSE)))
        return F.flatten(F.slice(names, F.lit(1), upto(F.transform(states, _item_state), TRUE)))

    gate, lists = r["gate"], r["lists"]
    going = gate.isNull()
    at_cases = plan["n_exempt"] + plan["n_items"]
    at_priced = at_cases + plan["n_unpriced"]

    def read(names: Column, start: Column, n: Column, unless: str) -> Column:
        return F.flatten(F.slice(names, start + 1, upto(F.slice(lists, start + 1, n), unless)))

    def used(c: Column, p: Column) -> Column:
        band = F.get(c["bands"], p["band"] - 1)["inc_units"]
        mine = F.when(c["kind"] == "per_unit", F.array(c["units"]["basis"], c["units"]["less"], c["per_time"]["basis"], c["per_time"]["less"])).when(c["kind"] == "banded", F.array(c["basis"], band["basis"], band["less"])).when(c["kind"] == "tiered", F.array(c["basis"]))
        return F.when(~p["skipped"], mine)

    def path(names: Column) -> Column:
        nothing = F.array().cast(_NO_WORDS)
        own = F.zip_with(plan["priced"], r["parts"], used)
        parts = F.flatten(F.transform(own, lambda o, i: F.concat(F.get(names, at_priced + i), F.coalesce(o, nothing))))
        priced = F.size(F.filter(r["parts"], lambda p: ~p["skipped"])) > 0
        rest = F.concat(F.array(rule["multiplier"]["basis"], rule["multiplier"]["less"]), F.flatten(F.slice(names, at_priced + plan["n_priced"] + 1, plan["n_adjust"])))
        return F.concat(
            F.when(F.coalesce(gate["kind"] == "status", F.lit(False)), nothing).otherwise(read(names, F.lit(0), plan["n_exempt"], FALSE)),
            F.when(going | gate["kind"].isin("requires", "case"), read(names, plan["n_exempt"], plan["n_items"], TRUE)).otherwise(nothing),
            F.when(going | (gate["kind"] == "case"), read(names, at_cases, plan["n_unpriced"], FALSE)).otherwise(nothing),
            F.when(going, parts).otherwise(nothing),
            F.when(going & priced, rest).otherwise(nothing),
        )

    def text(name: Column) -> Column:
        fact = _declared(rule, name)
        at_default = fact.isNotNull() & F.try_element_at(facts, name).isNull() & fact["default_value"].isNotNull()
        return F.coalesce(F.try_element_at(assumptions, name), F.when(at_default, _text(F.coalesce(fact["description"], fact["name"]), ASSUMED, _shown(fact["default_value"]), ".")))

    names = let(F.zip_with(plan["lists"], r["states"], touched), path)
    return F.array_distinct(F.array_compact(F.transform(F.array_distinct(F.array_compact(names)), text)))


# over items -------------------------------------------------------------------


def call_totals(items: DataFrame) -> DataFrame:
    """One row for each call: total of the charged amounts, counts by status, the currency if there is one only, distinct assumptions, and the calculation's status.

    success without failures, partial with failures beside at least one other item, else failed. One shuffle, by call.
    """

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(f"n_{status}")

    out = items.groupBy("call_id").agg(
        F.coalesce(F.sum(F.when(F.col("status") == "charged", F.col("amount"))), F.lit(0)).cast(MONEY).alias("total"),
        n("charged"), n("not_applicable"), n("on_application"), n("not_priced_in_document"), n("failed"), F.count(F.lit(1)).alias("n_items"),
        F.min(F.when(F.col("status") == "charged", F.col("currency"))).alias("lo"), F.max(F.when(F.col("status") == "charged", F.col("currency"))).alias("hi"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("assumptions", F.array().cast("array<string>")))))).alias("assumptions"),
    )
    status = F.when(F.col("n_failed") == 0, "success").when(F.col("n_items") > F.col("n_failed"), "partial").otherwise("failed")
    return out.withColumn("currency", F.when(F.col("lo") == F.col("hi"), F.col("lo"))).withColumn("status", status).drop("lo", "hi")


def grand_total(items: DataFrame, by: list[str]) -> DataFrame:
    """Charged amounts and calls by columns of items."""
    return items.where("status = 'charged'").groupBy(*by).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n_items"))


def sensitivity(rules: DataFrame, call: DataFrame) -> DataFrame:
    """Every rule priced for one call with facts at their defaults; call is a one-row frame of call_id, quantities and assumptions."""
    facts = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rate(rules.join(F.broadcast(call.limit(1))).withColumn("facts", facts))
