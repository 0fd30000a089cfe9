"""Operator 11: conversation structure repair by depth-first branch-and-bound.

A conversation's roles should read as an optional system row, then user and assistant in turn,
ending with an assistant. Rows may be kept (cost 0), given the role user or assistant (2) or
deleted (3), empty user or assistant rows may be inserted (2); blank and repeated rows must go, and a row
that stays although its text is cut off adds 1.

``search`` finds the cheapest edits: an explicit stack, a lower bound for every suffix (what its
rows must cost by themselves, and 2 for each of as many disjoint neighbouring pairs as can't both
stay), the best (cost, audit) so far, and for each (row, state) node the best prefix that came
there, which puts out all worse ones. It ends when the stack is empty, which proves the result.

No conversation need fit in a task: rows are range-partitioned by conversation and turn, without
their texts. Each partition searches its conversations in blocks of ``BLOCK`` rows, a block for every state
it may begin and end in, and joins the blocks' answers two by two; a conversation that goes on in the next
partition leaves its table of answers, and those tables are joined last.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import materialise

BLOCK = 128
SPACE = " \t\n\x0b\f\r"
# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
GIVEN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # the role that an edit can put here
REROLE, DELETE, INSERT = 2, 3, 2
LEGAL = {"su", "ua", "au"}


def suffix_bounds(rows: list) -> list[int]:
    """For each i a lower bound of the cost of ``rows[i:]``; rows are (initial, must go, cut off)."""
    n = len(rows)
    own, pairs, total = 0, [0] * (n + 3), [0] * (n + 1)
    after: list[int] = []  # rows that may stay, nearest last
    for i in range(n - 1, -1, -1):
        first, gone, cut = rows[i]
        pairs[i] = pairs[i + 1]
        if gone:
            own += DELETE
        else:
            own += cut if first in AFTER else min(REROLE + cut, DELETE)
            if after:
                second = rows[after[-1]][0]
                if first in AFTER and second in AFTER and first + second not in LEGAL:
                    beyond = pairs[after[-2]] if len(after) > 1 else 0
                    pairs[i] = max(pairs[i], 2 + beyond)
            after.append(i)
        total[i] = own + pairs[i]
    return total


def search(rows: list, begin: int, ends: tuple, bounds: list[int] | None = None) -> tuple[int, str] | None:
    """Least (cost, audit) that leads from state ``begin`` through ``rows`` to one of ``ends``."""
    bounds = bounds or suffix_bounds(rows)
    n, best, seen = len(rows), None, {}
    stack = [(0, "", 0, begin)]
    while stack:
        cost, audit, i, state = stack.pop()
        least = cost + bounds[i]
        if best and (least > best[0] or least == best[0] and audit > best[1][:len(audit)]):
            continue
        if (node := seen.get((i, state))) and node <= (cost, audit):
            continue
        seen[i, state] = (cost, audit)
        if i == n and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        moves = [(cost + INSERT, audit + "I", i, GIVEN[state])]
        if i < n:
            first, gone, cut = rows[i]
            moves.append((cost + DELETE, audit + "D", i + 1, state))
            if not gone:
                moves.append((cost + REROLE + cut, audit + "R", i + 1, GIVEN[state]))
                if (to := AFTER.get(first, {}).get(state)) is not None:
                    moves.append((cost + cut, audit + "K", i + 1, to))
        moves.sort(key=lambda m: (m[0] + bounds[m[2]], m[1]), reverse=True)  # the most promising on top
        stack.extend(moves)
    return best


def block_table(rows: list, begins) -> dict:
    """(begin, end) -> least (cost, audit) of a block."""
    bounds = suffix_bounds(rows)
    return {(b, e): found for b in begins for e in range(4) if (found := search(rows, b, (e,), bounds))}


def join_tables(left: dict, right: dict) -> dict:
    out: dict = {}
    for (b, mid), (c1, a1) in left.items():
        for e in range(4):
            if (r := right.get((mid, e))) is not None:
                cost, have = c1 + r[0], out.get((b, e))
                if have is None or cost < have[0] or cost == have[0] and a1 + r[1] < have[1] + have[2]:
                    out[b, e] = (cost, a1, r[1])
    return {k: (c, a1 + a2) for k, (c, a1, a2) in out.items()}


def solve(rows: list, begins, whole: bool, block: int = BLOCK) -> dict:
    """The table of ``rows``; if they are a whole conversation, only its answer."""
    if whole and len(rows) <= block:
        return {(START, ASSISTANT): search(rows, START, (START, ASSISTANT))}
    tables = [block_table(rows[k:k + block], begins if k == 0 else range(4)) for k in range(0, len(rows), block)]
    while len(tables) > 1:
        tables = [join_tables(*tables[k:k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    return {(START, ASSISTANT): min(tables[0][k] for k in ((START, START), (START, ASSISTANT)) if k in tables[0])} if whole else tables[0]


PART = pa.schema([("none", pa.bool_()), ("cid", pa.int64()), ("part", pa.int32()), ("whole", pa.bool_()), ("initials", pa.string()),
                  ("illegal", pa.int64()), ("rids", pa.binary()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
                  ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
PART_DDL = ("none boolean, cid long, part int, whole boolean, initials string, illegal long, rids binary, begins array<int>, "
            "ends array<int>, costs array<long>, audits array<string>")
PLAN_DDL = "none boolean, cid long, part int, initials string, rids binary, begin int, audit string, cost long, illegal long"
EDIT = pa.schema([("rid", pa.int64()), ("none", pa.bool_()), ("cid", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()),
                  ("edit", pa.string()), ("given", pa.string())])
EDIT_DDL = "rid long, none boolean, cid long, part int, seq int, edit string, given string"


def _parts(block: int):
    """Sorted rows (none, cid, rid, initial, gone, cut) -> a row for each conversation of the partition."""
    def run(batches):
        part, key, rows, rids = TaskContext.get().partitionId(), None, [], []
        at_start = True  # the partition's first conversation may have begun before it

        def close(at_end):
            whole = not at_start and not at_end
            table = solve(rows, range(4) if at_start else [START], whole, block)
            initials = "".join(r[0] if r[0] in AFTER else "o" for r in rows)
            illegal = sum(initials[k:k + 2] not in LEGAL for k in range(len(rows) - 1))
            k = sorted(table)
            return dict(zip(PART.names, (*key, part, whole, initials, illegal, array("q", rids).tobytes(), [b for b, _ in k], [e for _, e in k],
                                         [table[x][0] for x in k], [table[x][1] for x in k]), strict=True))

        for batch in batches:
            out = []
            for none, cid, rid, first, gone, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (none, cid):
                    if key is not None:
                        out.append(close(False))
                        at_start = False
                    key, rows, rids = (none, cid), [], []
                rows.append((first, gone, int(cut)))
                rids.append(rid)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=PART)
        if key is not None:
            yield pa.RecordBatch.from_pylist([close(True)], schema=PART)
    return run


def _choose(parts):
    """The parts of one conversation -> each part's first state and audit; cost and illegal pairs with the first."""
    parts = parts.sort_values("part", ignore_index=True)
    tables = [{(b, e): (c, a) for b, e, c, a in zip(*x, strict=True)} for x in zip(parts.begins, parts.ends, parts.costs, parts.audits, strict=True)]
    ahead = [{START: (0, "", START), ASSISTANT: (0, "", ASSISTANT)}]  # from the end: state -> (cost, audit, next state)
    for t in reversed(tables):
        here: dict = {}
        for (b, e), (c, a) in t.items():
            if e in ahead[-1]:
                got = (c + ahead[-1][e][0], a + ahead[-1][e][1], e)
                here[b] = min(here.get(b, got), got)
        ahead.append(here)
    ahead.reverse()
    state, begin, audits = START, [], []
    for t, here in zip(tables, ahead, strict=False):
        to = here[state][2]
        begin.append(state)
        audits.append(t[state, to][1])
        state = to
    between = sum(a[-1] + b[0] not in LEGAL for a, b in zip(parts.initials[:-1], parts.initials[1:], strict=True))
    rest = [0] * (len(parts) - 1)
    out = parts[["none", "cid", "part", "initials", "rids"]].copy()
    out["begin"], out["audit"] = begin, audits
    out["cost"], out["illegal"] = [ahead[0][START][0], *rest], [int(parts.illegal.sum()) + between, *rest]
    return out


def _edits(batches):
    """Chosen parts -> a row for each edit but deletions; ``given`` is the role of a changed or inserted row."""
    for batch in batches:
        for r in batch.to_pylist():
            cols, rids, state, at = [[] for _ in EDIT], array("q", r["rids"]), r["begin"], 0
            for seq, edit in enumerate(r["audit"]):
                given = None
                if edit == "K":
                    state = AFTER[r["initials"][at]][state]
                elif edit != "D":
                    state = GIVEN[state]
                    given = "user" if state == USER else "assistant"
                if edit != "D":
                    for c, v in zip(cols, (None if edit == "I" else rids[at], r["none"], r["cid"], r["part"], seq, edit, given), strict=True):
                        c.append(v)
                at += edit != "I"
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, EDIT, strict=True)], schema=EDIT)


def conversation_rows(rows: DataFrame) -> DataFrame:
    """``(none, cid, turn, role, text)`` of ``conversations`` rows; null roles and texts are one space."""
    one = F.lit(" ")
    return rows.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid"),
                       F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), one).alias("role"),
                       F.coalesce(F.col("text").cast("string"), one).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Damaged ``conversation_rows``, by crc32 of ``conv_id:turn`` modulo 20: dropped (0), emptied (1),
    without ``.!?`` (2), repeated (3), given to the user (4)."""
    one = F.lit(" ")
    key = F.concat(F.when(F.col("none"), one).otherwise(F.col("cid").cast("string")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    kind = F.crc32(key) % 20
    return (rows.withColumn("kind", kind).where("kind <> 0").select(
        "none", "cid", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy"))


def _faulty(rows: DataFrame) -> DataFrame:
    """Rows without texts: (none, cid, turn, role, digest, rid, initial, blank, twice, cut)."""
    light = rows.select("none", "cid", "turn", "role", "digest", "rid", "blank", "cut")
    same = ["none", "cid", "role", "digest"]
    first = light.groupBy(same).agg(F.min(F.struct("turn", "rid"))["rid"].alias("first_rid"))  # a null turn is least
    return light.join(first, same).withColumn("twice", F.col("rid") != F.col("first_rid")).withColumn("initial", F.substring("role", 1, 1))


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``conversation_rows`` -> (report, repaired rows).

    The report has a row for each conversation with rows: ``none``, ``cid``, ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost``, ``audit``. Repaired rows are ``none``, ``cid``, ``part``, ``seq``
    (ascending in that order), ``edit`` (K, R or I), ``role``, ``text``.

    Rows stand by turn (null first), then role, then the SHA-256 of the text; equal rows stand together. A row's
    first fault counts: blank (white space only), duplicate (its role and text stood before), truncated (the last
    character other than white space is none of ``.!?``). A role begins with its first
    character, whatever follows; a row whose role begins otherwise, or is empty, can't be kept.
    Nothing in, nothing out.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = materialise(rows.select("none", "cid", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"),
                                   F.monotonically_increasing_id().alias("rid"), (end == "").alias("blank"),
                                   (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut")), "damaged")
    light = materialise(_faulty(rows), "faulty")
    gone = F.col("blank") | F.col("twice")
    count = lambda c: F.count(F.when(c, 1))
    counts = light.groupBy("none", "cid").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        count(F.col("blank")).alias("blank"), count(~F.col("blank") & F.col("twice")).alias("duplicate"),
        count(~gone & F.col("cut")).alias("truncated"))
    order = ["none", "cid", "turn", "role", "digest", "rid"]
    parts = materialise(light.repartitionByRange(*order).sortWithinPartitions(*order)
                        .select("none", "cid", "rid", "initial", gone.alias("gone"), "cut").mapInArrow(_parts(block), PART_DDL), "parts")
    whole = parts.where("whole").select("none", "cid", "part", "initials", "rids", F.lit(START).alias("begin"), F.col("audits")[0].alias("audit"),
                                        F.col("costs")[0].alias("cost"), "illegal")
    plan = materialise(whole.unionByName(parts.where("not whole").groupBy("none", "cid").applyInPandas(_choose, PLAN_DDL)), "plan")
    chosen = plan.groupBy("none", "cid").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    edits = plan.select("none", "cid", "part", "initials", "rids", "begin", "audit").mapInArrow(_edits, EDIT_DDL)
    old = rows.select("rid", F.col("role").alias("old"), "text")
    repaired = (edits.where("edit <> 'I'").join(old, "rid")
                .unionByName(edits.where("edit = 'I'").withColumns({"old": F.lit(None).cast("string"), "text": F.lit("")})))
    return counts.join(chosen, ["none", "cid"]), repaired.select("none", "cid", "part", "seq", "edit", F.coalesce("given", "old").alias("role"), "text")


def _hash_rows(batches):
    """Rows (none, cid, role, text), a conversation's rows together in order -> (none, cid, sha)."""
    key, sha = None, None
    names = ["none", "cid", "repaired_sha256"]
    for batch in batches:
        out = []
        for none, cid, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (none, cid):
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (none, cid), hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names=names)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text, ...)`` -> damaged, repaired, and a row for each conv_id (a null
    one too) with the report and ``repaired_sha256``, the digest of the repaired ``role:text`` lines.

    A conversation without rows after the damage has zeros, an empty audit and the empty text's digest.
    A digest is made row by row in order, so no conversation is held whole. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = conversation_rows(conversations)
    report, repaired = repair(damage(rows))
    digests = (repaired.repartition("none", "cid").sortWithinPartitions("none", "cid", "part", "seq").select("none", "cid", "role", "text")
               .mapInArrow(_hash_rows, "none boolean, cid long, repaired_sha256 string"))
    key = ["none", "cid"]
    out = rows.select(key).distinct().join(report, key, "left").join(digests, key, "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.when(~F.col("none"), F.col("cid")).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
