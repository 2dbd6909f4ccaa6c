"""Spark types of rules, calls and their results."""

from __future__ import annotations

__all__ = ["AMOUNT", "BASES", "CITE", "FACT", "ITEM", "MONEY", "QUANTITY", "RATE", "RULE", "UNITS", "UNIT_COUNT"]

# The names of quantities that rules may refer to.
BASES = [
    "gross_tonnage", "net_tonnage", "deadweight", "loa_m", "beam_m", "draft_m", "cargo_tonnes", "passengers", "num_services", "time_in_port_hours",
    "time_in_port_days", "call_window_days",
]

QUANTITY = "decimal(20,6)"
RATE = "decimal(18,6)"
#: Units counted, and amounts between steps: wide enough that a product keeps 10 decimals.
UNIT_COUNT = "decimal(20,10)"
AMOUNT = "decimal(24,10)"
MONEY = "decimal(18,2)"

UNITS = f"struct<basis:string,unit_size:decimal(12,6),rounding:string,above:{RATE},less:string>"
CITE = "struct<chunk_id:bigint,section_ref:string,page:int,quote:string>"
#: A condition list is an array of items, all of which must hold; an item holds if any of its conditions does.
ITEM = "struct<any_of:array<struct<fact:string,op:string,value:array<string>>>>"
FACT = "struct<name:string,type:string,description:string,default_value:string>"
_BAND = f"struct<lower:{RATE},upper:{RATE},base_fee:{RATE},inc_rate:{RATE},inc_units:{UNITS}>"
_TIER = f"struct<up_to:{RATE},width:{RATE},start:{RATE},end:{RATE},rate:{RATE},unit_size:decimal(12,6),rounding:string>"
_COMPONENT = f"struct<id:string,label:string,kind:string,when:array<{ITEM}>,amount:{RATE},rate:{RATE},basis:string,units:{UNITS},per_time:{UNITS},bands:array<{_BAND}>,tiers:array<{_TIER}>>"
_ADJUSTMENT = f"struct<id:string,kind:string,percent:{RATE},applies_to:array<string>,when:array<{ITEM}>,exclusive_group:string,citation:{CITE}>"
RULE = (
    f"struct<charge_id:string,name:string,section_refs:array<string>,port_key:string,currency:string,payer:string,status:string,notes:array<string>,minimum:{RATE},maximum:{RATE},"
    f"multiplier:{UNITS},applies_when:array<{ITEM}>,exemptions:array<struct<description:string,when:array<{ITEM}>,citation:{CITE}>>,"
    f"components:array<{_COMPONENT}>,adjustments:array<{_ADJUSTMENT}>,facts:array<{FACT}>,citations:array<{CITE}>>"
)
