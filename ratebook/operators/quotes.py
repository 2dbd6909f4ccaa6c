"""Where quotes stand: an inverted index of word runs, looked up by each quote's rarest run, then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import held

__all__ = ["quote_places", "repair_citations", "retarget_citations"]

#: Words of a run; quotes of fewer words are looked up by their rarest single word.
RUN = 4


def _runs(line: Column, size: int) -> Column:
    """Hashes of the different runs of `size` words of a line of normal_words; none if it has fewer."""

    def of(words: Column) -> Column:
        starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))

    # the words as a variable of a lambda, so that they are split once and not for each run
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(F.trim(line), " ")), of)))


def quote_places(quotes: DataFrame, chunks: DataFrame, carry: tuple[str, ...] = (), run: int = RUN) -> DataFrame:
    """(document_id, line, chunk_id, columns of carry): the chunks of a quote's document that hold it, each different quote looked up once.

    quotes has document_id and quote, chunks document_id, chunk_id, content and carry; line is the quote as normal_words gives it.
    Chunks are normalised once. Of their runs only those that some quote of the document has become postings; a quote meets
    the chunks of its rarest run, so no quote is tried on all texts of its document, and whole words are compared in the end. Quotes
    without words and null quotes stand nowhere, chunks without an id can't be named. Repeated rows count once.
    """
    asked = quotes.select("document_id", T.normal_words(F.col("quote")).alias("line")).where("line <> '  '").distinct()
    long = F.size(F.split(F.trim("line"), " ")) >= run
    asked_runs = held(asked.select("document_id", "line", F.explode(F.when(long, _runs(F.col("line"), run)).otherwise(_runs(F.col("line"), 1))).alias("run")), "quote-runs")
    lines = held(chunks.where("chunk_id is not null").select("document_id", "chunk_id", *carry, T.normal_words(F.col("content")).alias("__text")), "chunk-lines")
    wanted = asked_runs.select("document_id", "run").distinct()
    entries = lines.select("document_id", "chunk_id", F.explode(F.concat(_runs(F.col("__text"), run), *([] if run == 1 else [_runs(F.col("__text"), 1)]))).alias("run"))
    postings = held(entries.join(wanted, ["document_id", "run"]), "postings")
    often = postings.groupBy("document_id", "run").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked_runs.join(often, ["document_id", "run"], "left").groupBy("document_id", "line").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).where("r.n > 0")
    met = rarest.select("document_id", "line", F.col("r.run").alias("run")).join(postings, ["document_id", "run"]).select("document_id", "line", "chunk_id").distinct()
    found = met.join(lines, ["document_id", "chunk_id"]).where(F.contains("__text", F.col("line")))
    return found.select("document_id", "line", "chunk_id", *carry).distinct()


def retarget_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule_id, pos, chunk_id): for each citation (rule_id, pos, document_id, ordinal, section_ref, quote) the chunk of its document that holds the quote.

    The one at the same ordinal first, then those of the cited section, then by ordinal (ties: the smaller chunk_id); chunk_id is null
    where none does. chunks has document_id, ordinal, chunk_id, section_ref and content. The best place by section and by
    document is found once for each different quote, so citations that repeat a quote don't multiply its places.
    """
    places = held(quote_places(citations, chunks, ("ordinal", "section_ref")), "places")
    first = F.min(F.struct("ordinal", "chunk_id"))["chunk_id"]
    here = places.groupBy("document_id", "line", "ordinal").agg(F.min("chunk_id").alias("__here"))
    section = places.groupBy("document_id", "line", "section_ref").agg(first.alias("__section"))
    anywhere = places.groupBy("document_id", "line").agg(first.alias("__any"))
    asked = citations.select("rule_id", "pos", "document_id", "ordinal", "section_ref", T.normal_words(F.col("quote")).alias("line"))
    out = asked.join(here, ["document_id", "line", "ordinal"], "left").join(section, ["document_id", "line", "section_ref"], "left").join(anywhere, ["document_id", "line"], "left")
    return out.select("rule_id", "pos", F.coalesce("__here", "__section", "__any").alias("chunk_id"))


def repair_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule_id, pos, chunk_id, repaired): a citation stays if its chunk holds the quote, else goes to the first evidence chunk that does, else stays.

    citations has rule_id, pos, document_id, chunk_id and quote; its evidence are the chunks (document_id, chunk_id, content)
    of its document_id. Where rules have evidence of their own, document_id is the rule.
    """
    places = held(quote_places(citations, chunks), "places")
    first = places.groupBy("document_id", "line").agg(F.min("chunk_id").alias("__first"))
    kept = places.select("document_id", "line", "chunk_id", F.lit(True).alias("__kept"))
    asked = citations.select("rule_id", "pos", "document_id", "chunk_id", T.normal_words(F.col("quote")).alias("line"))
    out = asked.join(kept, ["document_id", "line", "chunk_id"], "left").join(first, ["document_id", "line"], "left")
    moved = F.col("__kept").isNull() & F.col("__first").isNotNull()
    return out.select("rule_id", "pos", F.when(moved, F.col("__first")).otherwise(F.col("chunk_id")).alias("chunk_id"), moved.alias("repaired"))
