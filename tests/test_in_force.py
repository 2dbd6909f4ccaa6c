"""Documents in force against looking at every version."""

import datetime as dt
import random

from ratebook.operators import ports as P


def test_against_all_versions(spark):
    rng = random.Random(8)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(60))
    documents = []
    for i in range(160):
        low, high = rng.choice([None, day()]), rng.choice([None, day()])
        documents.append((f"d{i:03}", rng.choice(["ready"] * 6 + ["failed"]), low, high, dt.datetime(2021, 1, 1) + dt.timedelta(hours=rng.randrange(50)), [(f"Port {rng.choice('ABC')}", [])]))
    documents += [("old", "ready", dt.date(1, 1, 1), dt.date(1, 1, 1), dt.datetime(2030, 1, 1), [("Port D", ["Dee"])]), ("last", "ready", dt.date(9999, 12, 31), None, dt.datetime(2030, 1, 1), [("Port D", [])])]
    dates = [None, dt.date(1, 1, 1), dt.date(1, 1, 2), dt.date(9999, 12, 31), *[dt.date(2019, 12, 30) + dt.timedelta(days=i) for i in range(66)]]
    calls = [(i, rng.choice(["port of A", "B", "C", "D", "dee", "nowhere", None]), rng.choice(dates), rng.choice([None, None, f"d{rng.randrange(160):03}", "old", "unknown"]), 7) for i in range(600)]
    got = {r.call_id: (r.document_id, r.matched_port, r.error, r.level) for r in P.document_in_force(
        spark.createDataFrame(calls, "call_id int, port string, on_date date, document_id string, level int"),
        spark.createDataFrame(documents, "document_id string, status string, effective_from date, effective_to date, created_at timestamp, ports array<struct<name:string,aliases:array<string>>>"),
    ).collect()}
    letter = {"port of A": "A", "B": "B", "C": "C", "D": "D", "dee": "D"}

    def newest(port, on, wanted):
        found = [
            (d[4], d[0], d[5][0][0]) for d in documents
            if d[1] == "ready" and port in letter and d[5][0][0] == f"Port {letter[port]}" and (port != "dee" or d[5][0][1]) and (wanted is None or d[0] == wanted) and (on is None or ((d[2] is None or d[2] <= on) and (d[3] is None or on <= d[3])))
        ]
        return (*max(found)[1:], None) if found else (None, None, "PORT_NOT_COVERED")

    assert got == {c: (*newest(p, on, w), 7) for c, p, on, w, _ in calls}
    assert sum(g[2] is None for g in got.values()) > 60
