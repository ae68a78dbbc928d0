import hashlib
import heapq
import random
from zlib import crc32

import duckdb
import pytest

from rubricon.llm import dialogs
from rubricon.llm.queries import SQL, op11_conversations

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def cheapest(rows):
    """(cost, letters, repaired) of (role, text, fault) rows: the least of all paths, by a heap."""
    heap, n = [(0, "", 0, "", ())], len(rows)
    while heap:
        cost, audit, i, said, out = heapq.heappop(heap)
        if i == n and (said == "" or said[-1] == "a"):
            return cost, audit, out
        push = lambda c, letter, j, role, line: heapq.heappush(heap, (cost + c, audit + letter, j, (said + role)[-1:] if role else said, out + line))
        fits = {"s": said == "", "u": said in ("", "s", "a"), "a": said == "u"}
        for role in ("user", "assistant"):
            if fits[role[0]] and (len(audit) < 2 or audit[-2:] != "II"):
                push(2, "I", i, role[0], ((role, ""),))
        if i < n:
            role, text, fault = rows[i]
            push(3, "D", i + 1, "", ())
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if fits.get(role[:1]):
                    push(more, "K", i + 1, role[:1], ((role, text),))
                for new in ("user", "assistant"):
                    if fits[new[0]]:
                        push(2 + more, "R", i + 1, new[0], ((new, text),))


def brute_force(table):
    """Rows of the query for (conv_id, turn, role, text) rows."""
    by = {}
    for conv, turn, role, text in table:
        held = by.setdefault(conv, [])
        shown = lambda v: " " if v is None else str(v)
        kind = crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        held += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, held in by.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        rows, seen = [], set()
        for _, role, text in held:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
        count = lambda f: sum(r[2] == f for r in rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        turns = {t for t, _, _ in held if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, repaired = cheapest(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def said(rng):
    return rng.choice(["ok.", "ok", "yes!", "why? ", "", " \n", "a b", "so.\t", "é…", "no.x", None] + [f"t{rng.randrange(9)}."] * 9)


def conversation(rng, conv, n):
    roles = ["system"] * 2 + ["user"] * 6 + ["assistant"] * 6 + ["tool", "", None]
    return [(conv, rng.choice([None, *range(2 * n)]) if rng.random() < 0.3 else i, rng.choice(roles), said(rng)) for i in range(n)]


def frame(spark, table):
    rows = [(*r, "x", "y") for r in table]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, unit string, fault string")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_paths_are_the_least_of_all():
    rng = random.Random(1)
    names = {"blank": 1, "duplicate": 2, "truncated": 3, "": 0}
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "x"]), "t", rng.choice(["", "", "", "truncated", "blank"])) for _ in range(rng.randrange(8))]
        parts = [dialogs.part_paths([(r[:1], names[f], 1)]) for r, _, f in rows]
        whole = dialogs.part_paths([(r[:1], names[f], 1) for r, _, f in rows])
        want = cheapest(rows)
        assert whole.best() == want[:2]
        product = dialogs.Paths(0)
        for p in parts:
            product = product.times(dialogs.Paths.unpacked(p.width, p.packed()))
        if parts:
            assert product.best() == want[:2]
        assert tuple(dialogs.replayed(want[1], iter([(r, t, 1) for r, t, _ in rows]))) == want[2]


@pytest.mark.parametrize("unit, part", [(4096, 128), (3, 2)])
def test_equals_brute_force_and_sql(spark, tmp_path, monkeypatch, unit, part):
    monkeypatch.setattr(dialogs, "UNIT", unit)
    rng = random.Random(unit)
    table = [r for conv in [*range(150), None] for r in conversation(rng, conv, rng.randrange(1, 9))]
    table += rng.choices(table, k=40)
    frame(spark, table).write.parquet(f"{tmp_path}/conversations.parquet")
    found = got(op11_conversations(spark, str(tmp_path)))
    assert found == brute_force(table)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.sql(SQL["op11_conversations"])
    at = [sql.columns.index(c) for c in COLUMNS]
    assert sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=str) == found


def test_one_conversation_of_many_rows(spark, monkeypatch):
    """Joined over units and rounds it is what one pass over all of it finds."""
    rng = random.Random(8)
    table = conversation(rng, 7, 700) + [(7, 30, "user", "again and again.")] * 3000 + conversation(rng, 8, 3)
    rows = dialogs.damaged(frame(spark, table))
    whole = sorted(dialogs.repaired(rows).collect(), key=str)
    monkeypatch.setattr(dialogs, "UNIT", 2)
    assert sorted(dialogs.repaired(rows).collect(), key=str) == whole
    hot = next(r for r in whole if r.conv_id == 7)
    assert len(hot.audit.replace("I", "")) == rows.where("conv_id = 7").groupBy().sum("copies").first()[0]


def test_repaired_rows(spark):
    table = [(1, 0, "user", "hi."), (1, 1, "user", "there."), (1, 2, "assistant", "yes."), (2, 0, "system", "be good."), (None, 5, "user", "x.")]
    rows = frame(spark, table).selectExpr("*", "1 AS copies")
    found = sorted((tuple(r) for r in dialogs.repaired_rows(rows).collect()), key=str)
    want = [(1, 0, "user", "hi."), (1, 1, "assistant", ""), (1, 2, "user", "there."), (1, 3, "assistant", "yes."), (None, 0, "user", "x."), (None, 1, "assistant", "")]
    assert found == want
    assert {(r.conv_id, r.audit, r.cost) for r in dialogs.repaired(rows).collect()} == {(1, "KIKK", 2), (2, "D", 3), (None, "KI", 2)}


def test_long_text_and_empty_table(spark):
    table = [(1, 0, "user", "x " * 300_000 + "."), (1, 1, "assistant", " " * 300_000)]
    rows = frame(spark, table).selectExpr("*", "1 AS copies")
    assert [(r.blank, r.truncated, r.audit) for r in dialogs.repaired(rows).collect()] == [(1, 0, "KDI")]
    assert dialogs.repaired(frame(spark, []).selectExpr("*", "1 AS copies")).collect() == []
    assert dialogs.repaired_rows(frame(spark, []).selectExpr("*", "1 AS copies")).collect() == []
