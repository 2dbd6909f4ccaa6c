"""Ports by name, and the document in force for a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold
from .calls import newest

__all__ = ["document_in_force", "match_ports", "port_words", "port_variants"]

# Words that don't tell ports apart.
GENERIC = ["port", "ports", "of", "the", "harbour", "harbor"]


def port_words(name: Column) -> Column:
    """The name's words without generic ones, distinct and sorted."""
    words = F.regexp_extract_all(casefold(name), F.lit("[\\p{L}\\p{N}]+"), 0)
    return F.array_sort(F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in GENERIC]))))


def port_variants(documents: DataFrame) -> DataFrame:
    """(document_id, port, words) for each port's name and aliases; names without words are left out."""
    ports = documents.select("document_id", F.explode("ports").alias("p"))
    named = ports.select("document_id", F.col("p.name").alias("port"), F.explode(F.concat(F.array("p.name"), F.coalesce("p.aliases", F.array().cast("array<string>")))).alias("variant"))
    return named.select("document_id", "port", port_words(F.col("variant")).alias("words")).where(F.size("words") > 0).distinct()


def match_ports(queries: DataFrame, variants: DataFrame, query_column: str = "port") -> DataFrame:
    """(query, document_id, port): the one port of a document that each distinct query names.

    A name or alias with the same words wins; else one whose words contain the query's or are contained. Several ports of the
    deciding kind match nothing, and equal names don't fall through to contained ones. Partial matches meet by a word, not by a
    cross join; only distinct queries are matched, however many calls there are.
    """
    asked = queries.select(F.col(query_column).alias("query")).where(F.col(query_column).isNotNull()).distinct().withColumn("q", port_words(F.col("query"))).where(F.size("q") > 0)
    by_word = asked.select("query", "q", F.explode("q").alias("word")).join(variants.withColumn("word", F.explode("words")), "word")
    pairs = by_word.select("query", "q", "document_id", "port", "words").distinct()
    exact, within = F.col("q") == F.col("words"), (F.size(F.array_except("q", "words")) == 0) | (F.size(F.array_except("words", "q")) == 0)
    ranked = pairs.withColumn("kind", F.when(exact, 0).when(within, 1)).where("kind is not null").groupBy("query", "document_id", "port").agg(F.min("kind").alias("kind"))
    found = ranked.groupBy("query", "document_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("port").alias("port"))
    return newest(found, ["query", "document_id"], [F.col("kind")]).where("n = 1").select("query", "document_id", "port")


def document_in_force(calls: DataFrame, documents: DataFrame) -> DataFrame:
    """calls (call_id, port, on_date, and document_id of a wish or null) with the newest ready document that covers them.

    A document covers a call if it names the port and is in force on the date: bounds count in, a null bound is open, and a
    call without a date may have any. error is PORT_NOT_COVERED where none is left. Ties of created_at go to the greater document_id.

    Only different ports and dates are looked up. The times in which documents are in force are cut into ranges of days of a binary tree, of
    which each keeps the newest document; a date looks at the ranges that hold it, one for each level of the tree, however many
    versions a port's document has had. A wish is met by its own document, without a date a port's newest does.
    """
    ready = documents.where("status = 'ready'")
    newest_of = F.struct("created_at", "document_id", "port")
    matched = match_ports(calls, port_variants(ready)).join(ready.select("document_id", "effective_from", "effective_to", "created_at"), "document_id")
    lookups = calls.select(F.col("port").alias("query"), "on_date").where("query is not null").distinct()
    days = lookups.where("on_date is not null").select("query", "on_date", F.explode(_holding(_day(F.col("on_date")))).alias("r"))
    ranges = matched.select("query", newest_of.alias("d"), F.explode(_covering(F.coalesce(_day(F.col("effective_from")), F.lit(0)), F.coalesce(_day(F.col("effective_to")) + 1, F.lit(1 << LEVELS)))).alias("r"))
    newest_in = ranges.groupBy("query", "r").agg(F.max("d").alias("d"))
    dated = days.join(newest_in, ["query", "r"]).groupBy("query", "on_date").agg(F.max("d").alias("d"))
    undated = matched.groupBy("query").agg(F.max(newest_of).alias("d")).select("query", F.lit(None).cast("date").alias("on_date"), "d")
    found = dated.unionByName(undated).select(F.col("query").alias("__query"), F.col("on_date").alias("__day"), F.col("d").alias("__newest"))
    in_force = F.col("on_date").isNull() | (F.coalesce(F.col("effective_from") <= F.col("on_date"), F.lit(True)) & F.coalesce(F.col("on_date") <= F.col("effective_to"), F.lit(True)))
    own = matched.select(F.col("query").alias("__asked"), F.col("document_id").alias("__own"), "port", "effective_from", "effective_to", F.lit(True).alias("__named")).withColumnRenamed("port", "__port")
    kept = [c for c in calls.columns if c != "document_id"]
    asked = calls.select(*kept, F.col("document_id").alias("__wanted"))
    met = asked.join(found, (F.col("port") == F.col("__query")) & F.col("on_date").eqNullSafe(F.col("__day")), "left").join(own, (F.col("port") == F.col("__asked")) & (F.col("__wanted") == F.col("__own")), "left")
    wish = F.col("__wanted").isNotNull()
    covered = F.when(wish, F.coalesce(F.col("__named") & in_force, F.lit(False))).otherwise(F.col("__newest").isNotNull())
    document, port = F.when(wish, F.col("__own")).otherwise(F.col("__newest.document_id")), F.when(wish, F.col("__port")).otherwise(F.col("__newest.port"))
    return met.select(*kept, F.when(covered, document).alias("document_id"), F.when(covered, port).alias("matched_port"), F.when(~covered, "PORT_NOT_COVERED").alias("error"))


#: Levels of the tree over days, which spans the calendar from its first day on.
LEVELS = 22


def _day(date: Column) -> Column:
    return F.date_diff(date, F.lit("0001-01-01").cast("date"))


def _holding(day: Column) -> Column:
    """The ranges (level, number) of the tree that hold a day: range i of a level covers 2**level days from i * 2**level on."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(day, level).alias("number")) for level in range(LEVELS + 1)])


def _covering(low: Column, high: Column) -> Column:
    """The fewest ranges of the tree that make up the days from low to before high: at a level those at either end that don't pair up."""
    out = []
    for level in range(LEVELS + 1):
        first, end = F.shiftright(low + ((1 << level) - 1), level), F.shiftright(high, level)
        some = first < end
        out += [F.when(some & (first % 2 == 1), F.struct(F.lit(level).alias("level"), first.alias("number"))), F.when(some & (end % 2 == 1), F.struct(F.lit(level).alias("level"), (end - 1).alias("number")))]
    return F.array_compact(F.array(*out))
