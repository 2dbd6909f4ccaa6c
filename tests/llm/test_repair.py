"""Conversation repair against strings that carry whole audits, and the parts of its audit structure."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ratebook.llm.repair import Audit, Costs, Edits, _common, damaged, earlier, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def by_strings(rows, costs=Costs()):
    """Cheapest edits with whole strings in place of linked ones: state -> (cost, audit, repaired)."""
    order = {"": "us", "s": "u", "u": "a", "a": "u"}

    def put(cells, state, found):
        cells[state] = min(found, cells.get(state, found))

    def inserted(cells):
        for _ in range(3):
            for state, (cost, audit, said) in list(cells.items()):
                to = "a" if state == "u" else "u"
                put(cells, to, (cost + costs.insert, audit + "I", said + ({"u": "user:", "a": "assistant:"}[to],)))
        return cells

    cells = {"": (0, "", ())}
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, said) in inserted(cells).items():
            put(after, state, (cost + costs.delete, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            late = costs.truncated if fault else 0
            if role[:1] and role[:1] in order[state]:
                put(after, role[0], (cost + late, audit + "K", (*said, f"{role}:{text}")))
            for to, name in (("u", "user"), ("a", "assistant")):
                if to in order[state]:
                    put(after, to, (cost + costs.rerole + late, audit + "R", (*said, f"{name}:{text}")))
        cells = after
    cost, audit, said = min(x for s, x in inserted(cells).items() if s in ("", "a"))
    return cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def by_trying_all(rows):
    """Every edit of each row with up to two insertions between: the cheapest, then least, audit."""
    best = None
    for letters in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + x for g, x in zip(gaps, (*letters, ""), strict=True))
            cost, options, it = 0, [""], iter(rows)
            for x in audit:
                role, _, fault = ("", "", None) if x == "I" else next(it)
                if x != "D" and fault in ("blank", "duplicate"):
                    options = []
                cost += {"K": 0, "R": 1, "D": 2, "I": 5}[x] + (5 if fault == "truncated" and x != "D" else 0)
                if x != "D":
                    options = [o + r for o in options for r in (role[:1] if x == "K" else "ua")]
            if any(GRAMMAR.fullmatch(o) for o in options) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def run_audit(rows, **options):
    audit = Audit(**options)
    for row in rows:
        audit.add(*row)
    return audit.end()


@pytest.mark.parametrize("settle", [2, 7, 1024])
def test_audit_agrees_with_strings(settle):
    rng = random.Random(settle)
    for size in [*range(6)] * 40 + [300, 700]:
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "unit"]), f"t{i}", rng.choice([None] * 4 + ["blank", "duplicate", "truncated"])) for i in range(size)]
        assert run_audit(rows, settle=settle) == by_strings(rows), rows
        if size <= 3:
            assert run_audit(rows, settle=settle)[:2] == by_trying_all(rows), rows
    odd = Costs(rerole=3, delete=3, insert=1, truncated=2)
    for size in range(12):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{i}", rng.choice([None, None, "blank", "truncated"])) for i in range(size)]
        assert run_audit(rows, settle=settle, costs=odd) == by_strings(rows, odd), rows


def test_memory_holds_undecided_rows_only():
    audit = Audit(settle=64)
    for i in range(20_000):
        audit.add("user" if i % 2 == 0 else "assistant", "x.", None)
    assert len(audit.rows) <= 256 and audit.end()[:2] == (0, "K" * 20_000)


def chain(letters, at=None):
    at = at or Edits(None, "")
    for x in letters:
        at = Edits(at, x)
    return at


def test_earlier_verifies_what_hashes_say(monkeypatch):
    root = chain("KKRD" * 5)
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("DIKR", k=rng.randrange(9))) for _ in "ab")
        x, y = chain(a, root), chain(b, root)
        assert earlier(x, y) == (a < b) and _common([x, y]) is root and x.letters(root.depth) == a
    monkeypatch.setattr("ratebook.llm.repair._MODULUS", 1)  # all hashes collide
    for a, b in (("DKR", "DRK"), ("K", "K"), ("RRRR", "RRRD"), ("D", "DK")):
        assert earlier(chain(a), chain(b)) == (a < b)


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes"), (1, 2, "user", None), (1, 4, None, "x."), (1, 4, "user", "Hi."), (2, None, "assistant", "a!"), (2, 3, "user", "b?"), (None, 1, "user", "c."), (None, None, "system", "d."),
    (3, 5, "", ""), (4, 7, "user", "e " * 40_000 + "."), (4, 7, "user", "e"), (4, 8, "assistant", "ü. \n"),
]


def test_query_parts(spark):
    many = ROWS + [(100 + i // 4, i % 4, ["user", "assistant"][i % 2], f"said {i}.") for i in range(400)]
    turns = spark.createDataFrame(many, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("mine")).withColumn("gone", F.lit(1))
    got = {r.conv_id: tuple(r)[1:] for r in repair(damaged(turns)).collect()}
    assert set(got) == {r[0] for r in many}
    for conv in got:
        rows = []
        for c, turn, role, text in many:
            if c != conv:
                continue
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                rows += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        told, seen = [], set()
        for _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            told.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None))
            seen.add((role, text))
        at = [t for t, *_ in rows if t is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        want = (max(at) - min(at) + 1 - len(set(at)) if at else 0, *(sum(r[2] == f for r in told) for f in ("blank", "duplicate", "truncated")), illegal, *by_strings(told))
        assert got[conv] == want, conv


def test_empty_table(spark):
    assert repair(damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
