"""Repair of a conversation's structure by cheapest edits: a dynamic program over persistent edit sequences."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

__all__ = ["Audit", "Costs", "Edits", "damaged", "faults", "op13_conversation_repair", "repair"]

#: Characters that are not blank, and those that may end a text.
_SEEN, _ENDS = r"[^\x20\x09-\x0D]", ".!?"
#: What has been said: nothing yet, a system's row, a user's, an assistant's. The first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From which states a user's row may follow; after it an assistant's.
_BEFORE_USER = (START, SYSTEM, ASSISTANT)
_BASE, _MODULUS = 0x1F35_9B17_4C6D, (1 << 61) - 1
#: Rows after which the edits that all live sequences share are settled for the first time.
SETTLE_ROWS = 1024


@dataclass(frozen=True)
class Costs:
    """What an edit costs; truncated comes on top for a truncated row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Edits:
    """The last edit of a sequence, linked to those before it: up[k] is the sequence 2**k edits shorter. Sequences share prefixes."""

    __slots__ = ("depth", "hash", "letter", "up")

    def __init__(self, before: Edits | None, letter: str) -> None:
        self.letter, self.up = letter, []
        if before is None:
            self.depth, self.hash = 0, 0
            return
        self.depth, self.hash = before.depth + 1, (before.hash * _BASE + ord(letter)) % _MODULUS
        at, k = before, 0
        while True:
            self.up.append(at)
            if k >= len(at.up):
                return
            at, k = at.up[k], k + 1

    def shortened(self, depth: int) -> Edits:
        node, over = self, self.depth - depth
        while over:
            k = over.bit_length() - 1
            node, over = node.up[k], over - (1 << k)
        return node

    def letters(self, depth: int = 0) -> str:
        """Those after the first `depth`."""
        out, node = [], self
        while node.depth > depth:
            out.append(node.letter)
            node = node.up[0]
        return "".join(reversed(out))


def _same(a: Edits, b: Edits) -> bool:
    """Whether two sequences of one length are equal, letter by letter down to the prefix they share."""
    while a is not b and a.up:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def earlier(a: Edits, b: Edits) -> bool:
    """Whether a's letters come before b's. The longest common prefix is sought by hashes of ancestors; what it finds is verified, and where hashes collide the letters are compared."""
    depth = min(a.depth, b.depth)
    x, y = a.shortened(depth), b.shortened(depth)
    if x is y or (x.hash == y.hash and _same(x, y)):
        return a.depth < b.depth
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k] is not y.up[k] and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if x.letter != y.letter and _same(x.up[0], y.up[0]):
        return x.letter < y.letter
    return a.letters() < b.letters()


def _common(nodes: list[Edits]) -> Edits:
    """The longest prefix that sequences share."""
    out = nodes[0]
    for other in nodes[1:]:
        depth = min(out.depth, other.depth)
        x, y = out.shortened(depth), other.shortened(depth)
        for k in reversed(range(len(x.up))):
            if k < len(x.up) and x.up[k] is not y.up[k]:
                x, y = x.up[k], y.up[k]
        out = x if x is y else x.up[0]
    return out


class Audit:
    """The cheapest edits of one conversation, fed row by row.

    For each state the cheapest sequence that leads there is kept, of equal ones the first by letters; states that cost more than
    any way back to the cheapest are given up. What all live sequences share is settled from time to time, so that
    memory holds the undecided rows (and the audit itself, a letter an edit), not the conversation.
    """

    def __init__(self, costs: Costs = Costs(), settle: int = SETTLE_ROWS) -> None:
        self.costs, self.settle = costs, settle
        self.live: dict[int, tuple[int, Edits]] = {START: (0, Edits(None, ""))}
        self.rows: deque[tuple[str, str]] = deque()
        self.audit: list[str] = []
        self.state, self.said, self.next = START, False, settle
        self.digest = hashlib.sha256()

    def _offer(self, cells: dict[int, tuple[int, Edits]], state: int, cost: int, before: Edits, letter: str) -> bool:
        known = cells.get(state)
        if known is not None:
            if cost > known[0] or (known[1].letter == letter and known[1].up[0] is before):
                return False
            node = Edits(before, letter)
            if cost == known[0] and not earlier(node, known[1]):
                return False
            cells[state] = (cost, node)
            return True
        cells[state] = (cost, Edits(before, letter))
        return True

    def _inserted(self, cells: dict[int, tuple[int, Edits]]) -> dict[int, tuple[int, Edits]]:
        """With what insertions lead to, and without hopeless states."""
        changed = True
        while changed:
            changed = False
            for state, (cost, node) in list(cells.items()):
                changed |= self._offer(cells, ASSISTANT if state == USER else USER, cost + self.costs.insert, node, "I")
        most = min(c for c, _ in cells.values()) + 2 * self.costs.insert + self.costs.delete
        return {s: x for s, x in cells.items() if x[0] <= most}

    def add(self, role: str, text: str, fault: str | None) -> None:
        """fault: blank, duplicate, truncated or None."""
        costs, after = self.costs, {}
        stays, extra = fault not in ("blank", "duplicate"), costs.truncated if fault == "truncated" else 0
        initial = role[:1]
        for state, (cost, node) in self._inserted(self.live).items():
            self._offer(after, state, cost + costs.delete, node, "D")
            if not stays:
                continue
            if initial == "s" and state == START:
                self._offer(after, SYSTEM, cost + extra, node, "K")
            to, wanted = (ASSISTANT, "a") if state == USER else (USER, "u")
            if initial == wanted:
                self._offer(after, to, cost + extra, node, "K")
            self._offer(after, to, cost + costs.rerole + extra, node, "R")
        self.live = after
        self.rows.append((role, text) if stays else ("", ""))
        if len(self.rows) >= self.next:
            self._settle()

    def _apply(self, letters: str) -> None:
        self.audit.append(letters)
        for letter in letters:
            role, text = ("", "") if letter == "I" else self.rows.popleft()
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if self.state == USER else "user"
            self.state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
            self.digest.update(("\n" * self.said + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.said = True

    def _settle(self) -> None:
        shared = _common([node for _, node in self.live.values()])
        self._apply(shared.letters())
        root, made = Edits(None, ""), {}
        for state, (cost, node) in self.live.items():  # the rest anew, so that nothing holds what is settled
            at = root
            for letter in node.letters(shared.depth):
                key = (id(at), letter)
                if key not in made:
                    made[key] = Edits(at, letter)
                at = made[key]
            self.live[state] = (cost, at)
        self.next = max(self.settle, 2 * len(self.rows))

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, hex digest of the repaired rows)."""
        cells = self._inserted(self.live)
        ends = [cells[s] for s in (START, ASSISTANT) if s in cells]
        cost, node = ends[0]
        for c, n in ends[1:]:
            if c < cost or (c == cost and earlier(n, node)):
                cost, node = c, n
        self._apply(node.letters())
        return cost, "".join(self.audit), self.digest.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of turns with the damage that crc32 of `conv_id:turn` modulo 20 deals; null roles and texts, and null parts of that key, are one blank.

    Rows that the damage drops stay as marks with gone, so that a conversation that loses all its rows is still known.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("r"), F.coalesce("text", blank).alias("t"), (F.crc32(key.cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("t", _ENDS, "")).otherwise(F.col("t"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("r"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone), with each row's first fault and whether it may not follow the row before it, dealt by conversation and in order: marks first, then by turn (nulls first), role and text; of equal rows the one that isn't a duplicate comes first."""
    blank = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), "gone")
    order = [F.col("gone").desc(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("again")]
    dealt = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.rlike("text", F.lit(_SEEN)), "blank").when(F.col("again"), "duplicate").when(~F.contains(F.lit(_ENDS), last), "truncated")
    initial = F.when(~F.col("gone"), F.substring("role", 1, 1))
    pair = F.concat(F.lag(initial).over(Window.partitionBy("conv_id").orderBy(*order)), initial)
    told = dealt.withColumn("again", again).select("conv_id", "turn", "role", "text", "gone", "again", F.when(~F.col("gone"), fault).alias("fault"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"))
    return told.sortWithinPartitions("conv_id", *order).drop("again")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, gone), one for each conversation.

    A conversation's rows go through one task in order, as its one digest has to; they are streamed and not collected (see
    Audit). Rows of null conv_id are one conversation; a turn may be null or repeat (then role and text order rows); other
    columns are ignored, null roles and texts are one blank. A conversation of nothing but marks has zeros, an empty audit and the digest of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, audit, counts, turns = False, None, Audit(costs), {}, (None, None, 0)
        done: list[tuple] = []

        def row() -> tuple:
            first, last, distinct = turns
            cost, letters, digest = audit.end()
            return (conv, 0 if first is None else last - first + 1 - distinct, *(counts.get(c, 0) for c in _COUNTS[1:-1]), cost, letters, digest)

        def out() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])
            done.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "turn", "role", "text", "gone", "fault", "illegal")]
            for start in range(0, batch.num_rows, 1024):
                for c, turn, role, text, gone, fault, illegal in zip(*(x.slice(start, 1024).to_pylist() for x in columns), strict=True):
                    if not begun or c != conv:
                        if begun:
                            done.append(row())
                        begun, conv, audit, counts, turns = True, c, Audit(costs), {}, (None, None, 0)
                    if gone:
                        continue
                    if turn is not None and turn != turns[1]:
                        turns = (turn if turns[0] is None else turns[0], turn, turns[2] + 1)
                    if fault:
                        counts[fault] = counts.get(fault, 0) + 1
                    if illegal:
                        counts["illegal"] = counts.get("illegal", 0) + 1
                    audit.add(role, text, fault)
                if done:
                    yield out()
        if begun:
            done.append(row())
            yield out()

    return faults(rows).mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as the contract says and repaired."""
    return repair(damaged(read_table(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations
), coded AS (
  SELECT k.*, xor(list_reduce(list_concat([4294967295], list_transform(range(length(key)), lambda i: ascii(substr(key, i + 1, 1))::bigint)), lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS k
  FROM keyed k, crc
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM (
    SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(t, '.!?', '') ELSE t END AS text
    FROM coded, unnest(CASE WHEN k = 3 THEN [0, 1] WHEN k = 0 THEN [] ELSE [0] END) AS c(copy))
), told AS (
  SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM rows
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id
), moved(state, inserts, extra, said, follow) AS (VALUES
  ('0', '', 0, '', '0'), ('s', '', 0, '', 's'), ('u', '', 0, '', 'u'), ('a', '', 0, '', 'a'), ('0', 'I', 5, chr(10) || 'user:', 'u'), ('s', 'I', 5, chr(10) || 'user:', 'u'), ('a', 'I', 5, chr(10) || 'user:', 'u'),
  ('u', 'I', 5, chr(10) || 'assistant:', 'a'), ('0', 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:', 'a'), ('s', 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:', 'a'),
  ('a', 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:', 'a'), ('u', 'II', 10, chr(10) || 'assistant:' || chr(10) || 'user:', 'u')
), acts(follow, edit, price, reached) AS (VALUES
  ('0', 'D', 2, '0'), ('s', 'D', 2, 's'), ('u', 'D', 2, 'u'), ('a', 'D', 2, 'a'), ('0', 'K', 0, 's'), ('0', 'K', 0, 'u'), ('s', 'K', 0, 'u'), ('a', 'K', 0, 'u'), ('u', 'K', 0, 'a'), ('0', 'R', 1, 'u'), ('s', 'R', 1, 'u'), ('a', 'R', 1, 'u'), ('u', 'R', 1, 'a')
), dp AS (
  SELECT conv_id, 0::bigint AS i, '0' AS state, 0 AS cost, '' AS audit, '' AS said FROM counts
  UNION ALL
  SELECT conv_id, i, reached, min(cost), min(struct_pack(cost, audit, said)).audit, min(struct_pack(cost, audit, said)).said FROM (
    SELECT d.conv_id, t.i, reached, d.cost + extra + price + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 5 ELSE 0 END AS cost, d.audit || inserts || edit AS audit,
           d.said || m.said || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE reached WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END AS said
    FROM dp d JOIN told t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i + 1 JOIN moved m USING (state) JOIN acts USING (follow)
    WHERE (edit = 'D' OR fault IS NULL OR fault = 'truncated') AND (edit <> 'K' OR role[1] = reached)
  ) GROUP BY conv_id, i, reached
), ended AS (
  SELECT d.conv_id, min(struct_pack(cost := d.cost + extra, audit := audit || inserts, said := d.said || m.said)) AS best
  FROM dp d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.i JOIN moved m USING (state) WHERE follow IN ('0', 'a') GROUP BY d.conv_id
)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM v.conv_id
"""
