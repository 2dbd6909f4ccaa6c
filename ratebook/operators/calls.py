"""Call preparation: profiles to typed calls, validation, merging, quantities, screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import format_number, parse_number
from ..functions.schemas import BASES, QUANTITY

__all__ = [
    "calculations_with_steps", "call_text", "canonical", "document_fields", "extra_fields", "first_nonzero", "listing", "merge_sources", "parse_numerics", "quantities", "routine_charges", "screen", "seconds_between", "validate",
]

# Canonical column -> (section, field) of a sectioned profile.
RENAMES = {
    "name": ("vessel_metadata", "name"), "flag": ("vessel_metadata", "flag"), "built_year": ("vessel_metadata", "built_year"), "vessel_type": ("technical_specs", "type"),
    "gross_tonnage": ("technical_specs", "gross_tonnage"), "net_tonnage": ("technical_specs", "net_tonnage"), "deadweight": ("technical_specs", "dwt"),
    "loa_m": ("technical_specs", "loa_meters"), "beam_m": ("technical_specs", "beam_meters"), "arrival": ("operational_data", "arrival_time"),
    "departure": ("operational_data", "departure_time"), "days_alongside": ("operational_data", "days_alongside"), "activity": ("operational_data", "activity"),
    "cargo_tonnes": ("operational_data", "cargo_quantity_mt"), "num_operations": ("operational_data", "num_operations"), "num_holds": ("operational_data", "num_holds"),
}
VESSEL_FIELDS = ["name", "flag", "built_year", "vessel_type", "gross_tonnage", "net_tonnage", "deadweight", "loa_m", "beam_m", "draft_m"]
CALL_FIELDS = ["arrival", "departure", "days_alongside", "activity", "cargo_tonnes", "num_operations", "num_holds", "num_services", "passengers", "port"]
POSITIVE = ["gross_tonnage", "net_tonnage", "deadweight", "loa_m", "beam_m", "draft_m"]
NOT_NEGATIVE = ["passengers", "days_alongside", "cargo_tonnes", "num_operations", "num_holds", "num_services"]
DEFAULT_NUM_SERVICES = 2
ROUTINE_TRIGGERS = ["per_call", "per_service", "per_period"]
# Why a charge isn't screened in, and what is assumed of quantities.
PAYER_REASONS = {"cargo": "Payable by the cargo owner, not the vessel.", "other": "Not a charge on the vessel (a fee for other parties or services)."}
LICENCE_REASON = "A licence or permit, not a charge on a vessel call."
ON_REQUEST_REASON = "Charged only when requested or after an incident; not included."
STAY_BY_DAYS = ("Time in port taken as the ", " days alongside", "; the arrival-to-departure window of ", " days may include waiting outside port limits", ".")
STAY_BY_WINDOW = ("Time in port taken as the arrival-to-departure window of ", " days (days alongside not given).")
NO_PASSENGERS = "No passengers stated; none assumed."
SERVICES_ASSUMED = " marine-service movements assumed (entering and leaving)."


def first_nonzero(values: Column) -> Column:
    """The first element that is neither null nor zero, of an array of decimals."""
    return F.try_element_at(F.filter(values, lambda x: x != 0), F.lit(1))


def _fields(json: Column) -> Column:
    """A JSON object's fields as text, in a map; null and unreadable objects have none."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def canonical(profiles: DataFrame, id_column: str = "call_id", json_column: str = "profile") -> DataFrame:
    """(id, canonical columns as text, additional) of JSON profiles of either shape.

    A profile with any of the sections vessel_metadata, technical_specs and operational_data is mapped by RENAMES, its draft
    being the first of the list that isn't zero; others pass their vessel and call objects through. additional keeps
    the sections' other fields that have a value. Numbers stay text here, so nothing passes through floats.
    """
    top = profiles.select(F.col(id_column), _fields(F.col(json_column)).alias("top"))
    sections = ["vessel_metadata", "technical_specs", "operational_data", "vessel", "call"]
    parts = top.select(id_column, *[F.try_element_at("top", F.lit(s)).isNotNull().alias(f"has_{s}") for s in sections], *[_fields(F.try_element_at("top", F.lit(s))).alias(s) for s in sections])
    sectioned = F.col("has_vessel_metadata") | F.col("has_technical_specs") | F.col("has_operational_data")
    draft = F.try_element_at("technical_specs", F.lit("draft_sw_s_w_t"))
    first = F.when(draft.startswith("["), first_nonzero(F.from_json(draft, f"array<{QUANTITY}>")).cast("string")).otherwise(draft)
    columns = []
    for field in [*VESSEL_FIELDS, *CALL_FIELDS]:
        plain = F.try_element_at("vessel" if field in VESSEL_FIELDS else "call", F.lit(field))
        mapped = first if field == "draft_m" else F.try_element_at(RENAMES[field][0], F.lit(RENAMES[field][1])) if field in RENAMES else F.lit(None)
        columns.append(F.when(sectioned, mapped).otherwise(plain).alias(field))
    known = [f for _, f in RENAMES.values()] + ["draft_sw_s_w_t"]
    return parts.select(id_column, *columns, F.when(sectioned, extra_fields(F.map_concat("vessel_metadata", F.map_filter("technical_specs", lambda k, v: ~F.map_contains_key("vessel_metadata", k))), known)).alias("vessel_additional"), F.when(sectioned, extra_fields(F.col("operational_data"), known)).alias("call_additional"))


def extra_fields(fields: Column, known: list[str]) -> Column:
    """The map's entries that have a value and aren't known."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & ~k.isin(known))


def parse_numerics(calls: DataFrame, fields: list[str]) -> DataFrame:
    """calls with text fields as decimals, and warnings that name each field and value that can't be read (null then)."""
    unread = [F.when(F.col(f).isNotNull() & parse_number(F.col(f)).isNull(), F.concat(F.lit(f"{f}: could not read '"), f, F.lit("'"))) for f in fields]
    return calls.withColumn("warnings", F.array_compact(F.array(*unread))).withColumns({f: parse_number(F.col(f)).try_cast(QUANTITY) for f in fields})


def validate(calls: DataFrame) -> DataFrame:
    """calls with problems, every rule that a row breaks; those without are valid."""
    has = set(calls.columns)
    checks = [F.when(F.col("gross_tonnage").isNull(), F.lit("gross_tonnage is required"))]
    checks += [F.when(F.col(f) <= 0, F.lit(f"{f} must be greater than 0")) for f in POSITIVE if f in has]
    checks += [F.when(F.col(f) < 0, F.lit(f"{f} must not be negative")) for f in NOT_NEGATIVE if f in has]
    if {"arrival", "departure"} <= has:
        checks.append(F.when(F.col("departure") < F.col("arrival"), F.lit("departure is before arrival")))
    return calls.withColumn("problems", F.array_compact(F.array(*checks)))


def merge_sources(profiles: DataFrame, queries: DataFrame, fields: list[str], port_column: str = "port") -> DataFrame:
    """One call of two sources: a profile's field wins and the query fills gaps; port and num_services of a request win over both.

    profiles and queries have call_id and fields; queries also have request_port, request_num_services and statements.
    error is PORT_REQUIRED where no port is given. Where a source has additional (map<string,string>), the profile's takes the place of the query's as a
    whole, and the query's statements (array<string>, or null) are added to it as JSON.
    """
    p, q = profiles.alias("p"), queries.alias("q")
    both = p.join(q, "call_id", "full_outer")
    own = [F.coalesce(F.col(f"p.{f}"), F.col(f"q.{f}")).alias(f) for f in fields if f not in (port_column, "num_services")]
    port = F.coalesce("q.request_port", f"q.{port_column}").alias("port")
    services = F.coalesce(F.col("q.request_num_services"), F.col("p.num_services"), F.col("q.num_services")).alias("num_services")
    more = [F.col(f"{side}.additional") for side, df in (("p", profiles), ("q", queries)) if "additional" in df.columns]
    if more:
        said = F.when(F.size("q.statements") > 0, F.create_map(F.lit("statements"), F.to_json("q.statements")))
        rest = F.map_filter(F.coalesce(*more), lambda k, v: said.isNull() | (k != "statements"))
        more = [F.coalesce(F.map_concat(rest, said), rest, said).alias("additional")]
    return both.select("call_id", *own, port, services, F.col("q.statements").alias("statements"), *more).withColumn("error", F.when(F.col("port").isNull() | (F.trim("port") == ""), "PORT_REQUIRED"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def quantities(calls: DataFrame) -> DataFrame:
    """calls with quantities, the 12 named ones as a map without nulls, and assumptions, a text for each derived one.

    Hours come from whole seconds, so a stay of 8 hours is exactly 8; time in port is the days alongside if they are given,
    else the window from arrival to departure. No passengers and two services are assumed unless stated.
    """
    has = set(calls.columns)

    def own(name: str) -> Column:
        return F.col(name).cast(QUANTITY) if name in has else F.lit(None).cast(QUANTITY)

    seconds = seconds_between(F.col("arrival"), F.col("departure")) if {"arrival", "departure"} <= has else F.lit(None).cast("long")
    window = (seconds.cast("decimal(18,0)") / F.lit(86400).cast("decimal(5,0)")).cast(QUANTITY)
    hours = (seconds.cast("decimal(18,0)") / F.lit(3600).cast("decimal(4,0)")).cast(QUANTITY)
    days = own("days_alongside")
    shown = format_number(F.round(window, 2))
    head, alongside, aside, waiting, stop = map(F.lit, STAY_BY_DAYS)
    by_days = F.concat(head, format_number(days), alongside, F.when(window.isNotNull(), F.concat(aside, shown, waiting)).otherwise(""), stop)
    by_window = F.concat(F.lit(STAY_BY_WINDOW[0]), shown, F.lit(STAY_BY_WINDOW[1]))
    stay = F.when(days.isNotNull(), by_days).when(window.isNotNull(), by_window)
    values = {n: own(n) for n in ("gross_tonnage", "net_tonnage", "deadweight", "loa_m", "beam_m", "draft_m", "cargo_tonnes")} | {
        "passengers": F.coalesce(own("passengers"), F.lit(0).cast(QUANTITY)),
        "num_services": F.coalesce(own("num_services"), F.lit(DEFAULT_NUM_SERVICES).cast(QUANTITY)),
        "call_window_days": window,
        "time_in_port_days": F.coalesce(days, window),
        "time_in_port_hours": F.coalesce((days * 24).cast(QUANTITY), hours),
    }
    texts = {
        "time_in_port_days": stay,
        "time_in_port_hours": stay,
        "passengers": F.when(own("passengers").isNull(), F.lit(NO_PASSENGERS)),
        "num_services": F.when(own("num_services").isNull(), F.lit(f"{DEFAULT_NUM_SERVICES}{SERVICES_ASSUMED}")),
    }

    def as_map(entries: dict[str, Column]) -> Column:
        return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*entries.values())), lambda k, v: v.isNotNull())

    return calls.withColumns({"quantities": as_map(values), "assumptions": as_map(texts)})


def screen(candidates: DataFrame) -> DataFrame:
    """candidates (payer, trigger, charge_id, and arrays only and requested) with outcome and reason, by the first test that holds.

    A null `only` lets all through, an empty one none.
    """
    only, requested, charge = F.col("only"), F.coalesce("requested", F.array().cast("array<string>")), F.col("charge_id")
    outcome = (
        F.when(only.isNotNull() & ~F.array_contains(F.coalesce(only, F.array().cast("array<string>")), charge), "dropped")
        .when(F.col("payer") != "vessel", "excluded").when(F.col("trigger") == "licence_or_permit", "excluded")
        .when((F.col("trigger") == "on_request") & ~F.array_contains(requested, charge), "on_request").otherwise("candidate")
    )
    payer_reason = F.when(F.col("payer") == "cargo", PAYER_REASONS["cargo"]).otherwise(PAYER_REASONS["other"])
    reason = F.when(F.col("outcome") == "excluded", F.when(F.col("payer") != "vessel", payer_reason).otherwise(LICENCE_REASON)).when(F.col("outcome") == "on_request", ON_REQUEST_REASON)
    return candidates.withColumn("outcome", outcome).withColumn("reason", reason)


def routine_charges(catalogue: DataFrame, ids: list[str] | None = None, include_all: bool = False) -> DataFrame:
    """Charges to compile, with pos: the asked ids in their order, else the vessel's routine ones (or all) in the catalogue's order."""
    if ids:
        asked = catalogue.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, charge_id string")
        return catalogue.join(F.broadcast(asked), "charge_id")
    routine = F.lit(True) if include_all else (F.col("payer") == "vessel") & F.col("trigger").isin(ROUTINE_TRIGGERS)
    return catalogue.where(routine)


def listing(history: DataFrame, port: str | None = None, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a history, newest first (ties: the larger id), with the total number of rows that match."""
    found = history
    if port is not None:
        found = found.where(F.col("port_key") == port)
    if status is not None:
        found = found.where(F.col("status") == status)
    total = found.agg(F.count(F.lit(1)).alias("n_total"))
    page = found.orderBy(F.col("created_at").desc(), F.col("calculation_id").desc()).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))


def calculations_with_steps(history: DataFrame, steps: DataFrame) -> DataFrame:
    """history (calculation_id, …) with steps: array of its step rows (calculation_id, step_no, …) in order, empty where it has none.

    A calculation's steps are a few dozen rows, which are gathered by a sort by id and number in one shuffle of the steps.
    """
    parts = F.struct("step_no", *[c for c in steps.columns if c not in ("calculation_id", "step_no")])
    own = steps.groupBy("calculation_id").agg(F.array_sort(F.collect_list(parts), lambda a, b: F.when(a["step_no"] < b["step_no"], -1).when(a["step_no"] > b["step_no"], 1).otherwise(0)).alias("steps"))
    joined = history.join(own, "calculation_id", "left")
    return joined.withColumn("steps", F.coalesce("steps", F.slice(F.array(F.lit(None).cast(joined.schema["steps"].dataType.elementType)), 1, 0)))


def call_text(calls: DataFrame, given: list[str]) -> DataFrame:
    """calls with text, how a call is shown to whoever decides its facts: the given fields without nulls as JSON, then the quantities, one a line."""
    lines = F.filter(F.transform(F.array(*[F.lit(b) for b in BASES]), lambda b: F.concat(F.lit("- "), b, F.lit(": "), format_number(F.try_element_at("quantities", b)))), lambda t: t.isNotNull())
    return calls.withColumn("text", F.concat_ws("\n", F.to_json(F.struct(*given)), F.lit(""), F.lit("Quantities:"), lines))


def document_fields(rows: DataFrame, currency: Column, vat_percent: Column) -> DataFrame:
    """rows with currency, the code's first three characters in capitals (null if empty), and vat_rate, the printed percentage as a share (null if unreadable)."""
    return rows.withColumns({"currency": F.nullif(F.substring(F.upper(currency), 1, 3), F.lit("")), "vat_rate": parse_number(vat_percent) / 100})


def newest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
