"""Rulebook files loaded into the tables of this database: profile, catalogue and rules of documents that are known here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schemas import RULE
from .quality import retargeted_rules
from .rulebook import import_decisions
from .shared import held

__all__ = ["FILE", "Imported", "import_rulebooks"]

FILE = (
    "format int, schema_version int, prompt_version string, checksum string, profile struct<title:string,currency:string,ports:array<string>,effective_from:date,effective_to:date>, "
    "catalogue array<struct<charge_id:string,name:string,section_refs:array<string>,payer:string,trigger:string>>, "
    "rules array<struct<port_key:string,charge_id:string,prompt_version:string,rule:string>>, ordinals map<string,long>"
)


@dataclass
class Imported:
    """What files come to. decisions: (file, document_id, reason, n_rules, left_out), reason null for those that are loaded. The others
    are rows for the tables of the documents that are loaded; their document_ids are those of decisions without a reason."""

    decisions: DataFrame
    profiles: DataFrame
    catalogue: DataFrame
    rules: DataFrame

    def documents(self) -> DataFrame:
        return self.decisions.where("reason is null").select("document_id")

    def tables(self) -> dict[str, DataFrame]:
        return {"profiles": self.profiles, "catalogue": self.catalogue, "rules": self.rules}


def import_rulebooks(files: DataFrame, documents: DataFrame, with_rules: DataFrame, chunks: DataFrame, *, format_version: int, schema_version: int, prompt_version: str, reuse_older: bool = True) -> Imported:
    """files (file, rulebook: JSON text) loaded where nothing speaks against it.

    documents has checksum, document_id and status, with_rules the document_ids that have rules here, chunks (document_id,
    chunk_id, ordinal, section_ref, content) their texts. Objections in order: see import_decisions; an entry's own
    prompt_version counts before its file's, and a text that isn't JSON has no format. Of several files for one document the
    first by name is loaded, the others find its rules there. A rule of which a quote is found nowhere in the document, or that is inconsistent, is left
    out and listed; a failed compilation (null rule) is loaded as such.
    """
    book = F.from_json("rulebook", FILE)
    read = held(files.select("file", book.alias("b")).select("file", "b.*"), "rulebook-files")
    other = F.filter(F.transform(F.coalesce("rules", F.array()), lambda e: F.coalesce(e["prompt_version"], F.col("prompt_version"))), lambda v: ~v.eqNullSafe(F.lit(prompt_version)))
    asked = read.select("file", "checksum", "format", "schema_version", F.coalesce(F.try_element_at(other, F.lit(1)), F.lit(prompt_version)).alias("prompt_version"), (F.size(F.coalesce("rules", F.array())) > 0).alias("__rules"))
    decided = import_decisions(asked, documents, with_rules, format_version, schema_version, prompt_version, reuse_older)
    earlier = Window.partitionBy("document_id", F.col("reason").isNull()).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("reason").isNull() & F.coalesce(F.max("__rules").over(earlier), F.lit(False))
    decided = held(decided.withColumn("reason", F.when(late, "has_rules").otherwise(F.col("reason"))).select("file", "document_id", "reason"), "import-decisions")
    last = decided.where("reason is null").groupBy("document_id").agg(F.max("file").alias("file"))  # files without rules may follow each other
    own = read.join(last, "file")

    profiles = own.select("document_id", "checksum", "profile.*")
    catalogue = own.select("document_id", F.posexplode("catalogue").alias("pos", "c")).select("document_id", "pos", "c.*")
    entries = own.select("document_id", F.posexplode("rules").alias("pos", "e"), F.col("prompt_version").alias("__default"))
    entries = entries.select(F.concat_ws("\t", "document_id", F.col("pos").cast("string")).alias("rule_id"), "document_id", "e.port_key", "e.charge_id", F.coalesce("e.prompt_version", "__default").alias("prompt_version"), F.col("e.rule").alias("__json"), F.from_json("e.rule", RULE).alias("rule"))
    places = own.select("document_id", F.explode("ordinals").alias("chunk", "ordinal")).select("document_id", F.col("chunk").cast("long").alias("chunk_id"), "ordinal")
    compiled = entries.where("__json is not null and __json <> 'null'")
    loaded = held(retargeted_rules(compiled.drop("__json"), places, chunks), "imported-rules")
    failed = entries.where("__json is null or __json = 'null'").drop("__json")
    rules = loaded.select(*failed.columns).unionByName(failed)
    lost = compiled.join(loaded, "rule_id", "left_anti").groupBy("document_id").agg(F.array_sort(F.collect_list("charge_id")).alias("left_out"))
    counts = rules.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_rules"))
    told = decided.join(last.select("file", F.lit(True).alias("__last")), "file", "left").join(counts, "document_id", "left").join(lost, "document_id", "left")
    mine = F.col("reason").isNull() & F.col("__last")
    decisions = told.select("file", "document_id", "reason", F.when(mine, F.coalesce("n_rules", F.lit(0))).otherwise(0).cast("long").alias("n_rules"), F.when(mine, F.coalesce("left_out", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("left_out"))
    return Imported(decisions, profiles, catalogue, rules.drop("rule_id"))
