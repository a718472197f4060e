"""Conversation structure repair: the cheapest edits that give every conversation the roles (s?(ua)+)?.

A state of the grammar is what has been emitted: nothing, a system turn, a user turn, or a complete exchange. From the last
turn back, the cost to go of every (turn, state) is the least over the edits possible there; walking forward, among the
edits whose cost and cost to go add up to the state's own, the one with the least initial is taken. Initials fix the roles,
so this walk is the ASCII-least of the cheapest audits.

Turns are range-partitioned by conversation and turn, so a conversation of any length spreads over tasks. One that lies
within a task and a block is repaired at once. Others are cut into blocks: a block's costs from each state to each state are
a matrix, matrices are multiplied (minimum, plus) from the last block back, which gives the cost to go after each block;
the walks from each entry state tell where the next block is entered; then the blocks are repaired side by side. Between
blocks, turns said before are found by SHA-256 of role and text.

Defined cases: a null role or text is one space; null turns come first; turns with one number are ordered by role and text (by their
first 64 characters, then by digest; repeated rows are equal, so their order doesn't show); rows without conv_id are one conversation; a role's
initial is its first character; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc32_sql, keyed, materialise, tidy

#: A block has at most so many turns and about so many characters.
BLOCK_TURNS, BLOCK_CHARS = 1 << 15, 4 << 20
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: States: nothing, a system turn, a user turn, a complete exchange. Where an alternating turn leads, and a kept one by its role.
NEXT = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NAMES = {2: "user", 3: "assistant"}
#: Cost to go after the last turn: an open exchange wants an answer, a lone system turn wants both.
END = (0, 2 * INSERT, INSERT, 0)
FAULTS = ("blank", "duplicate", "truncated")
#: A turn's code: its role's initial if that is one of s, u and a, times its fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)
INITIALS = "sua?"


def code(initial: str, fault: int) -> int:
    return (INITIALS.index(initial) if initial in ("s", "u", "a") else 3) * 4 + fault


def step(code: int, after: tuple) -> tuple:
    """Cost to go before a turn, from that after it: every edit of the turn, then insertions before it."""
    fault = code % 4
    out = [DELETE + v for v in after]
    if fault in (SOUND, CUT):
        extra = TRUNCATED if fault == CUT else 0
        kept = KEPT.get(INITIALS[code // 4], (None,) * 4)
        for s in range(4):
            out[s] = min(out[s], REROLE + extra + after[NEXT[s]], FAR if kept[s] is None else extra + after[kept[s]])
    two, three = out[2], out[3]
    two = min(two, INSERT + three)
    return min(out[0], INSERT + two), min(out[1], INSERT + two), two, min(three, INSERT + out[2])


def costs(codes: bytes, end: tuple) -> list[tuple]:
    """Cost to go before each turn and after the last."""
    out = [end]
    for c in reversed(codes):
        out.append(step(c, out[-1]))
    return out[::-1]


def matrix(codes: bytes) -> list[int]:
    """Least cost from each state before the block to each state after it, row by row."""
    columns = [costs(codes, tuple(0 if s == t else FAR for s in range(4)))[0] for t in range(4)]
    return [min(columns[t][s], FAR) for s in range(4) for t in range(4)]


def walk(codes: bytes, togo: list[tuple], state: int, last: bool) -> tuple[str, list, int]:
    """The audit from a state, what is emitted as (turn's place or None, new role or None), and the state reached."""
    audit, out, i = [], [], 0
    while i < len(codes) or (last and togo[i][state]):
        here, now = togo[i][state], togo[i]
        if i < len(codes):
            c, after = codes[i], togo[i + 1]
            if DELETE + after[state] == here:
                audit.append("D")
                i += 1
                continue
        to = NEXT[state]
        if INSERT + now[to] == here:
            audit.append("I")
            out.append((None, NAMES[to]))
            state = to
            continue
        extra, kept = (TRUNCATED if c % 4 == CUT else 0), KEPT.get(INITIALS[c // 4], (None,) * 4)[state]
        if kept is not None and extra + after[kept] == here:
            audit.append("K")
            out.append((i, None))
            state = kept
        else:
            audit.append("R")
            out.append((i, NAMES[to]))
            state = to
        i += 1
    return "".join(audit), out, state


def classify(roles: list[str], texts: list[str]) -> bytearray:
    """Codes of a run of turns; what was said before the run is not known here."""
    out, seen = bytearray(), set()
    for role, text in zip(roles, texts):
        bare = text.rstrip(SPACE)
        if not bare:
            fault = BLANK
        elif (role, text) in seen:
            fault = DUPLICATE
        else:
            seen.add((role, text))
            fault = SOUND if bare[-1] in ".!?" else CUT
        out.append(code(role[:1], fault))
    return out


def measured(roles: list[str], turns: list, codes: bytes) -> list[int]:
    """Turns numbered, distinct numbers, and the four counts; the ends are merged by the caller."""
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    numbers = {t for t in turns if t is not None}
    return [len(numbers), *[sum(c % 4 == f for c in codes) for f in (BLANK, DUPLICATE, CUT)], illegal]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped, but the conversation stays) of each row after damage by crc32("conv_id:turn") % 20, and its row's key."""
    spoken = F.coalesce("text", F.lit(" "))
    fault = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    return keyed(conversations.select("conv_id", "turn", "role", "text")).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spoken, "[.!?]", "")).otherwise(spoken).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"), "row_file", "row_at",
    )


TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
MEASURES = ["gaps", *FAULTS, "illegal", "cost"]
REPAIRED = ", ".join(f"{m} long" for m in MEASURES) + ", audit string, repaired array<struct<role:string,text:string>>"


def _turns(made: list, roles: list[str], texts: list[str]) -> list[dict]:
    return [{"role": name or roles[i], "text": "" if i is None else texts[i]} for i, name in made]


def repair(turns: DataFrame) -> DataFrame:
    """Repaired conversations: conv_id, part and parts (long conversations are given in several parts), the measures and the cost (with
    part 0, else null), and each part's audit and repaired turns.

    turns: conv_id, turn, role, text (not null), copies, and row_file, row_at as any key of the rows.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    types = {"conv_id": turns.select("conv_id").limit(0).toArrow().schema.field("conv_id").type}
    order = [
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.left("role", F.lit(64)).asc(), F.left("text", F.lit(64)).asc(),
        F.sha2(F.to_json(F.array("role", "text")), 256).asc(), F.asc("row_file"), F.asc("row_at"),
    ]
    schema = pa.schema([
        ("conv_id", types["conv_id"]), ("block", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("codes", pa.binary()), ("said", pa.list_(pa.binary())),
        ("said_at", pa.list_(pa.int32())), ("turn_from", pa.int64()), ("turn_to", pa.int64()), *[(m, pa.int64()) for m in MEASURES], ("audit", pa.string()), ("repaired", pa.list_(TURN)),
    ])

    @tidy
    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, blocks = TaskContext.get().partitionId(), [], 0
        current, numbers, roles, texts, size, split = (), [], [], [], 0, True

        def close(open_end: bool) -> None:
            """Take what was gathered: a whole conversation is repaired, a part of one becomes a block."""
            nonlocal blocks, numbers, roles, texts, size
            codes = bytes(classify(roles, texts))
            known = [t for t in numbers if t is not None]
            distinct, *counts = measured(roles, numbers, codes)
            row = {"conv_id": current[0], "turn_from": known[0] if known else None, "turn_to": known[-1] if known else None} | dict(zip([*FAULTS, "illegal"], counts))
            if split or open_end:
                first = {}
                for i, c in enumerate(codes):
                    if c % 4 in (SOUND, CUT):
                        first[hashlib.sha256(f"{len(roles[i])}:{roles[i]}{texts[i]}".encode()).digest()] = i
                row |= {"block": (task << 32) + blocks, "roles": roles, "texts": texts, "codes": codes, "said": list(first), "said_at": list(first.values()), "gaps": distinct}
                blocks += 1
            else:
                togo = costs(codes, END)
                audit, made, _ = walk(codes, togo, 0, True)
                row |= {"gaps": known[-1] - known[0] + 1 - distinct if known else 0, "cost": togo[0][0], "audit": audit, "repaired": _turns(made, roles, texts)}
            held.append(row)
            numbers, roles, texts, size = [], [], [], 0

        for batch in batches:
            for conv, turn, role, text, copies in zip(*[c.to_pylist() for c in batch.columns[:5]]):
                if current != (conv,):
                    if current:
                        close(False)
                        split = False  # the first of a task may have begun in another one
                    current = (conv,)
                elif len(roles) >= BLOCK_TURNS or size >= BLOCK_CHARS:
                    close(True)
                    split = True
                numbers += [turn] * copies
                roles += [role] * copies
                texts += [text] * copies
                size += copies * len(text)
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)
                held.clear()
        if current:
            close(True)  # the last one may go on in another task
            yield pa.RecordBatch.from_pylist(held, schema)

    sorted_turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    blocky = "block long, roles array<string>, texts array<string>, codes binary, said array<binary>, said_at array<int>, turn_from long, turn_to long, "
    passed = materialise(sorted_turns.mapInArrow(first_pass, f"conv_id {kind}, {blocky}{REPAIRED}"), "conversations")
    whole = passed.filter("block is null").selectExpr("conv_id", "0 as part", "1 as parts", *MEASURES, "audit", "repaired")
    return whole.unionByName(_in_blocks(passed.filter("block is not null"), kind))


def _in_blocks(blocks: DataFrame, kind: str) -> DataFrame:
    """Repair of the conversations that first_pass() cut into blocks."""
    said = blocks.select("conv_id", "block", F.explode(F.arrays_zip("said", "said_at")).alias("s")).select("conv_id", "block", "s.said", "s.said_at")
    again = said.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "said").orderBy("block"))).filter("nth > 1").groupBy("block").agg(F.collect_list("said_at").alias("again"))
    slim = blocks.select("conv_id", "block", "codes", "turn_from", "turn_to", "gaps", "illegal", F.try_element_at("roles", F.lit(1)).alias("first_role"), F.try_element_at("roles", F.lit(-1)).alias("last_role"))

    @tidy
    def recoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                codes = bytearray(r["codes"])
                for i in r.pop("again") or ():
                    codes[i] = codes[i] // 4 * 4 + DUPLICATE
                r["codes"] = bytes(codes)
                r["matrix"] = matrix(codes)
                r |= {f: sum(c % 4 == k for c in codes) for f, k in zip(FAULTS, (BLANK, DUPLICATE, CUT))}
                out.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out)

    slim_type = f"conv_id {kind}, block long, codes binary, turn_from long, turn_to long, gaps long, illegal long, first_role string, last_role string, "
    columns = [x.strip().split(" ")[0] for x in (slim_type + "matrix array<long>, blank long, duplicate long, truncated long").split(",") if x.strip()]
    marked = slim.join(again, "block", "left").select("conv_id", "block", "codes", "turn_from", "turn_to", "gaps", "illegal", "first_role", "last_role", "again")
    marked = materialise(
        _ordered(marked, recoded, columns, slim_type + "matrix array<long>, blank long, duplicate long, truncated long"), "conversation-blocks"
    )

    def ends(group: pa.Table) -> pa.Table:
        """Cost to go after each block, by matrices from the last back; the conversation's measures go with its first block."""
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        after, out = END, []
        for k, r in reversed(list(enumerate(rows))):
            m = r["matrix"]
            out.append({"conv_id": r["conv_id"], "block": r["block"], "part": k, "parts": len(rows), "after": list(after)} | dict.fromkeys(MEASURES))
            after = tuple(min(min(m[4 * s + t] + after[t] for t in range(4)), FAR) for s in range(4))
        total = {m: sum(r[m] for r in rows) for m in (*FAULTS, "illegal")}
        numbered, speaking = [r for r in rows if r["turn_from"] is not None], [r for r in rows if r["first_role"] is not None]
        total["illegal"] += sum(a["last_role"][:1] + b["first_role"][:1] not in LEGAL for a, b in zip(speaking, speaking[1:]))
        distinct = sum(r["gaps"] for r in numbered) - sum(a["turn_to"] == b["turn_from"] for a, b in zip(numbered, numbered[1:]))
        total |= {"gaps": numbered[-1]["turn_to"] - numbered[0]["turn_from"] + 1 - distinct if numbered else 0, "cost": after[0]}
        out[-1] |= total
        return pa.Table.from_pylist(out, pa.schema([group.schema.field("conv_id"), ("block", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("after", pa.list_(pa.int64())), *[(m, pa.int64()) for m in MEASURES]]))

    measures = ", ".join(f"{m} long" for m in MEASURES)
    end_type = f"conv_id {kind}, block long, part int, parts int, after array<long>, {measures}"
    chained = materialise(
        marked.select("conv_id", "block", "matrix", "turn_from", "turn_to", "gaps", "illegal", "first_role", "last_role", *FAULTS).groupBy("conv_id").applyInArrow(ends, end_type), "conversation-ends"
    )

    @tidy
    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the walks from all four states leave a block."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                togo = costs(r["codes"], tuple(r["after"]))
                out.append([walk(r["codes"], togo, s, False)[2] if togo[0][s] < FAR else s for s in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["conv_id", "block", "exits"])

    left = marked.join(chained.select("block", "after"), "block").select("conv_id", "block", "codes", "after").mapInArrow(exits, f"conv_id {kind}, block long, exits array<int>")

    def entries(group: pa.Table) -> pa.Table:
        state, out = 0, []
        for r in sorted(group.to_pylist(), key=lambda r: r["block"]):
            out.append({"block": r["block"], "entry": state})
            state = r["exits"][state]
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("entry", pa.int32())]))

    entered = left.groupBy("conv_id").applyInArrow(entries, "block long, entry int")
    ready = blocks.select("block", "roles", "texts").join(marked.select("block", "codes"), "block").join(chained, "block").join(entered, "block")
    schema = pa.schema([("audit", pa.string()), ("repaired", pa.list_(TURN))])

    @tidy
    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, after, entry, last, roles, texts in zip(*[c.to_pylist() for c in batch.columns[:6]]):
                audit, made, _ = walk(codes, costs(codes, tuple(after)), entry, last)
                out.append({"audit": audit, "repaired": _turns(made, roles, texts)})
            made = pa.RecordBatch.from_pylist(out, schema)
            yield pa.RecordBatch.from_arrays([*batch.columns[6:], *made.columns], [*batch.schema.names[6:], "audit", "repaired"])

    own = ["conv_id", "part", "parts", *MEASURES]
    return ready.select("codes", "after", "entry", F.expr("part = parts - 1").alias("last"), "roles", "texts", *own).mapInArrow(rebuilt, f"conv_id {kind}, part int, parts int, {REPAIRED}")


def _ordered(df: DataFrame, run, columns: list[str], schema: str) -> DataFrame:
    """mapInArrow whose batches' columns are put in the schema's order."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.select(columns)

    return df.mapInArrow(placed, schema)


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation: the measures, the audit, and the SHA-256 of the repaired turns as role:text, joined by line feeds.

    A conversation in one part is hashed where it is. The parts of others are sorted and streamed through one hash a conversation: SHA-256 can't be divided.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    spoken = F.expr("concat_ws('\n', transform(repaired, t -> concat(t.role, ':', t.text)))")
    own = ["conv_id", *MEASURES, "audit"]
    one = repaired.filter("parts = 1").select(*own, F.sha2(spoken, 256).alias("repaired_sha256"))

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, whole, audit = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] == 0:
                    first, whole, audit, begun = r, hashlib.sha256(), [], False
                if r["spoken"]:
                    whole.update((("\n" if begun else "") + r["spoken"]).encode())
                    begun = True
                audit.append(r["audit"])
                if r["part"] == r["parts"] - 1:
                    row = {c: first[c] for c in ("conv_id", *MEASURES)} | {"audit": "".join(audit), "repaired_sha256": whole.hexdigest()}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([batch.schema.field("conv_id"), *[(m, pa.int64()) for m in MEASURES], ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    order = [F.asc_nulls_first("conv_id"), F.asc("part")]
    several = repaired.filter("parts > 1").select("part", "parts", *own, spoken.alias("spoken")).repartition("conv_id").sortWithinPartitions(*order)
    return one.unionByName(several.mapInArrow(hashed, f"conv_id {kind}, {', '.join(f'{m} long' for m in MEASURES)}, audit string, repaired_sha256 string"))


def as_turns(repaired: DataFrame) -> DataFrame:
    """The repaired conversations as rows again: conv_id, part, place in it, role, text."""
    return repaired.select("conv_id", "part", F.posexplode("repaired").alias("place", "t")).select("conv_id", "part", "place", "t.role", "t.text")


def _least(state: int) -> str:
    """Cost to go of a state before a turn (aliases: r the turn, v the vector after it), before insertions."""
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    keeps = " ".join(f"WHEN r.i = '{i}' THEN v.s{to[state]}" for i, to in kept.items() if state in to)
    turn = f"CASE WHEN r.fault IN ('blank', 'duplicate') THEN {FAR} ELSE {{}} + CASE WHEN r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END END"
    return f"least({DELETE} + v.s{state}, {turn.format(f'{REROLE} + v.s{NEXT[state]}')}, {turn.format(f'(CASE {keeps} ELSE {FAR} END)')})"


def _vector() -> str:
    """The four costs from t0 to t3, after insertions."""
    two, three = f"least(t2, {INSERT} + t3)", f"least(t3, {INSERT} + t2)"
    return f"least(t0, {INSERT} + {two}) AS s0, least(t1, {INSERT} + {two}) AS s1, {two} AS s2, {three} AS s3"


SQL = f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, {CRC_TABLE_SQL}
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN f = 0 THEN 0 WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hit
), placed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), 'none') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, left(role, 1) AS i,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS tail FROM damaged
), told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM placed
), rows AS (
  SELECT conv, conv_id, turn, role, text, n, i, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS previous,
    CASE WHEN tail = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault FROM told
), back AS (
  SELECT conv, max(n) + 1 AS n, {END[0]} AS s0, {END[1]} AS s1, {END[2]} AS s2, {END[3]} AS s3 FROM rows GROUP BY conv
  UNION ALL
  SELECT conv, n, {_vector()} FROM (SELECT r.conv, r.n, {", ".join(f"{_least(s)} AS t{s}" for s in range(4))} FROM back v JOIN rows r ON r.conv = v.conv AND r.n = v.n - 1)
), togo AS (
  SELECT b.conv, b.n, [s0, s1, s2, s3] AS v, r.role, r.text, r.i, CASE WHEN r.fault IN ('blank', 'duplicate') THEN {FAR} WHEN r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra, r.n IS NULL AS ended
  FROM back b LEFT JOIN rows r ON r.conv = b.conv AND r.n = b.n
), steps AS (
  SELECT a.conv, a.n, s, CASE WHEN NOT a.ended AND {DELETE} + z.v[s + 1] = a.v[s + 1] THEN 'D' WHEN {INSERT} + a.v[nxt + 1] = a.v[s + 1] THEN 'I'
    WHEN a.ended THEN '' WHEN kept >= 0 AND a.extra + z.v[kept + 1] = a.v[s + 1] THEN 'K' ELSE 'R' END AS edit, nxt, kept, a.role, a.text
  FROM (SELECT togo.*, s, CASE WHEN s = 2 THEN 3 ELSE 2 END AS nxt, CASE WHEN s = 0 AND i = 's' THEN 1 WHEN s <> 2 AND i = 'u' THEN 2 WHEN s = 2 AND i = 'a' THEN 3 ELSE -1 END AS kept FROM togo, range(4) x(s)) a
  LEFT JOIN togo z ON z.conv = a.conv AND z.n = a.n + 1
), walk AS (
  SELECT conv, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, '' AS edit, CAST(NULL AS VARCHAR) AS said FROM back WHERE n = 1
  UNION ALL
  SELECT w.conv, w.k + 1, CASE WHEN t.edit = 'I' THEN w.n ELSE w.n + 1 END, CASE WHEN t.edit = 'D' THEN w.s WHEN t.edit = 'K' THEN t.kept ELSE t.nxt END, t.edit,
    CASE WHEN t.edit = 'D' THEN NULL WHEN t.edit = 'K' THEN t.role || ':' || t.text ELSE CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN t.edit = 'R' THEN t.text ELSE '' END END
  FROM walk w JOIN steps t ON t.conv = w.conv AND t.n = w.n AND t.s = w.s WHERE t.edit <> ''
), counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE previous IS NOT NULL AND previous || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv
), mended AS (
  SELECT conv, string_agg(edit, '' ORDER BY k) AS audit, coalesce(string_agg(said, chr(10) ORDER BY k), '') AS whole FROM walk GROUP BY conv
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'none') AS conv FROM conversations) a
LEFT JOIN counted USING (conv) LEFT JOIN mended USING (conv) LEFT JOIN (SELECT conv, s0 FROM back WHERE n = 1) f USING (conv)
"""
