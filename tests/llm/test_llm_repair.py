"""Conversation repair against dynamic programming and plain Python."""

import hashlib
import random
import zlib

import pytest

from shopflow.llm import queries, repair

COLS = "conv_id long, turn long, role string, text string, none boolean, cid long, part int, audit string, rid long"
LETTERS = {"system": "s", "user": "u", "assistant": "a"}


def least_edits(rows, begin, ends):
    """Least (cost, audit) by keeping every state's best answer after each row."""
    def inserted(at):
        for _ in range(2):
            for q, (c, a) in list(at.items()):
                new = (c + 2, a + "I")
                to = repair.GIVEN[q]
                at[to] = min(at.get(to, new), new)
        return at
    at = inserted({begin: (0, "")})
    for first, gone, cut in rows:
        new = {}

        def put(q, c, a):
            new[q] = min(new.get(q, (c, a)), (c, a))
        for q, (c, a) in at.items():
            put(q, c + 3, a + "D")
            if not gone:
                put(repair.GIVEN[q], c + 2 + cut, a + "R")
                if q in repair.AFTER.get(first, {}):
                    put(repair.AFTER[first][q], c + cut, a + "K")
        at = inserted(new)
    return min((v for q, v in at.items() if q in ends), default=None)


def some_rows(rng, n):
    return [(rng.choice("uuuaaasx "), rng.random() < 0.15, int(rng.random() < 0.25)) for _ in range(n)]


def test_search_equals_dynamic_programming():
    rng = random.Random(3)
    for n in [*range(12)] * 25 + [60, 128, 300]:
        rows = some_rows(rng, n)
        assert repair.search(rows, 0, (0, 3)) == least_edits(rows, 0, (0, 3))
        for b in range(4):
            for e in range(4):
                assert repair.search(rows[:9], b, (e,)) == least_edits(rows[:9], b, (e,))
        bounds = repair.suffix_bounds(rows)
        for i in range(0, n, 3):
            assert bounds[i] <= min(least_edits(rows[i:], b, range(4))[0] for b in range(4))


def test_blocks_join_to_one_search():
    rng = random.Random(4)
    for n in (0, 1, 7, 40, 200):
        rows = some_rows(rng, n)
        for block in (1, 3, 16):
            table = repair.solve(rows, [0], True, block) if n else {(0, 3): (0, "")}
            assert table[0, 3] == least_edits(rows, 0, (0, 3))


def by_hand(rows):
    """conv_id -> the result row, of plain (conv_id, turn, role, text) rows."""
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    kept = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rs in kept.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
        seen, coded, faults = set(), [], [0, 0, 0]
        for _, role, text in rs:
            end = text.rstrip(" \t\n\x0b\f\r")
            blank, twice, cut = not end, (role, text) in seen, end[-1:] not in (".", "!", "?")
            seen.add((role, text))
            if blank or twice or cut:
                faults[0 if blank else 1 if twice else 2] += 1
            coded.append((role[:1], blank or twice, int(cut)))
        turns = {t for t, _, _ in rs if t is not None}
        cost, audit = least_edits(coded, 0, (0, 3))
        state, at, lines = 0, 0, []
        for edit in audit:
            if edit == "K":
                state = repair.AFTER[coded[at][0]][state]
                lines.append(":".join(rs[at][1:]))
            elif edit in "IR":
                state = repair.GIVEN[state]
                lines.append(("user" if state == 2 else "assistant") + ":" + (rs[at][2] if edit == "R" else ""))
            at += edit != "I"
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, sha("\n".join(lines)).hex())
    return out


def found(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def hard_rows():
    rng = random.Random(5)
    rows = []
    for conv in [None, -1, *range(40)]:
        for k in range(rng.choice([0, 1, 2, 5, 9])):
            rows.append((conv, rng.choice([None, k, k, 2 * k, 7]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]),
                         rng.choice([None, "", " \n", "Yes.", "no", "Why? \t", "...", "é.", "x" * 5000, f"t{k}!"])))
    return rows + rows[:5] + [(99, None, None, None), (98, 0, "user", "only")]


def test_report_equals_plain_python(spark):
    rows = hard_rows()
    df = spark.createDataFrame([(*r, True, 5, 6, "x", 7) for r in rows], COLS)
    want = by_hand(rows)
    assert found(repair.repair_digests(df)) == want
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in want.values())


def test_long_conversation_over_many_partitions(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"line {t % 900}" + rng.choice([".", ""])) for t in range(3000)]
    rows += [(c, t, ["user", "assistant"][t % 2], "ok.") for c in (3, 9) for t in range(4)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, True, 5, 6, "x", 7) for r in rows], COLS)
        assert found(repair.repair_digests(df)) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", True, 5, 6, "x", 7)][:n], COLS)
    assert len(found(repair.repair_digests(df))) == n


def test_query_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.QUERIES["op11_repair_turns"](spark, "/root/testdata/sf0.01")) == by_hand(rows)
