"""Repair of conversation structure by iterative-deepening A*.

A conversation should read, by the initials of its roles, as an optional system row and then user and assistant by
turns, or be empty.  Edits keep a row (0), give it the role that is due (1), delete it (2, required for blank and
repeated rows) or insert an empty row of the role that is due (5); an undeleted truncated row costs 5 more.  A
depth-first search tries the edits in ASCII order of their initials (D, I, K, R) under an increasing cost bound; the
first path it accepts is the cheapest and among those the ASCII-least.  A table of failed states holds for each
(row, state) a cost that no accepting path undercuts; it prunes later searches and gives the next bound.

Long conversations are searched in segments of ``SEGMENT`` rows.  A segment's searches from each state in to each state
out are joined by a short backward choice; inserts always stand before a row, so that no segment's audit begins another
of the same segment and the choice by audits is the choice by the whole string.

Rows are dealt by ranges of (conversation, turn, digest, row), sized by bytes and rows, so a conversation that holds a
third of all rows is cut like any other data.  Conversations inside one range are finished there; the first and last of
each range send 16 costs and ranks per range to be joined, and are then finished range by range.  Only the final hash of
such a conversation reads its ranges one after another, in bounded pieces, as SHA-256 must.

Nulls: a null role or text counts as one space; a null conversation id is a conversation of its own; null turns come
first and take no part in gaps.  Rows of equal turn are ordered by a digest of role and text, repeated rows arbitrarily,
as they are equal.  A role's initial is its first character, a space if it is empty.  An empty table gives an empty
result.  Memory: a task holds one conversation's rows of one range.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fanin.llm.common import documents, grouped, materialise, ship, small_batches
from fanin.llm.manifest import crc32_sql

SEGMENT = 256                       # rows searched at once
ROWS_A_RANGE = 50_000
BYTES_A_RANGE = 16 << 20
SPACES = " \t\n\x0b\x0c\r"
CLEAN, MUST_GO, TRUNCATED = 0, 1, 2

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.  What may follow, and what is due.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE = ("u", "u", "a", "u")
AFTER = tuple(NEXT[q][DUE[q]] for q in range(4))
ENDS = (0, 10, 5, 0)                # cost of the inserts that end a conversation in each state
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60


def lower_bounds(rows: list[tuple[str, int]]) -> list[int]:
    """Per row a cost that no repair of it and what follows undercuts: 2 for each row that must go or is truncated, and
    1 for each of disjoint illegal pairs of clean rows with nothing but rows that must go between them."""
    n = len(rows)
    out, pairs, after, following = [0] * (n + 1), [0] * (n + 1), [n] * (n + 1), None
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        out[i] = out[i + 1] + (2 if fault else 0)
        pairs[i] = pairs[i + 1]
        if fault == MUST_GO:
            continue
        if fault == CLEAN and following is not None and rows[following][1] == CLEAN and initial + rows[following][0] not in LEGAL:
            pairs[i] = max(pairs[i], 1 + pairs[following + 1])
        following = i
    return [a + b for a, b in zip(out, pairs, strict=True)]


def search(rows: list[tuple[str, int]], start: int = 0, goal: int | None = None, failed: dict[tuple[int, int], int] | None = None) -> str | None:
    """The cheapest, then ASCII-least edits from state ``start`` to state ``goal`` after the last row, or, without a goal, to
    the end of the conversation, with inserts after the last row.  None if there are none.  ``failed``, the table of failed
    states, holds for any start and may be shared by the searches for one goal over the same rows."""
    n, least = len(rows), lower_bounds(rows)
    if goal == 1 and start == 0 and not any(i == "s" and f != MUST_GO for i, f in rows):
        return None
    if goal is not None and (goal, start) in {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)}:
        return None
    failed = {} if failed is None else failed

    def moves(i: int, q: int):
        if i == n:
            return [("I", 5, n, AFTER[q])] if goal is None else []
        initial, fault = rows[i]
        out = [("D", 2, i + 1, q), ("I", 5, i, AFTER[q])]
        if fault != MUST_GO:
            more = 5 if fault == TRUNCATED else 0
            if initial in NEXT[q]:
                out.append(("K", more, i + 1, NEXT[q][initial]))
            out.append(("R", 1 + more, i + 1, AFTER[q]))
        return out

    def known(i: int, q: int) -> int:
        return failed.get((i, q), least[i])

    def down(i: int, q: int, left: int) -> list[str] | None:
        if i == n and (q in (0, 3) if goal is None else q == goal):
            return []
        bound = NEVER
        for letter, cost, to, state in moves(i, q):
            need = cost + known(to, state)
            if need <= left:
                rest = down(to, state, left - cost)
                if rest is not None:
                    rest.append(letter)
                    return rest
                need = cost + known(to, state)
            bound = min(bound, need)
        failed[(i, q)] = bound
        return None

    bound = known(0, start)
    while bound < NEVER:
        found = down(0, start, bound)
        if found is not None:
            return "".join(reversed(found))
        bound = failed[(0, start)]
    return None


def apply(rows: list[tuple[str, int]], audit: str, state: int = 0) -> tuple[int, list[tuple[int, str | None]], int]:
    """(cost, [(row or -1 for an insert, new role or None)], the state after) of an audit."""
    cost, out, i = 0, [], 0
    for letter in audit:
        if letter == "D":
            cost, i = cost + 2, i + 1
            continue
        due = "user" if DUE[state] == "u" else "assistant"
        if letter == "I":
            cost += 5
            out.append((-1, due))
            state = AFTER[state]
            continue
        initial, fault = rows[i]
        cost += (5 if fault == TRUNCATED else 0) + (letter == "R")
        out.append((i, due if letter == "R" else None))
        state = AFTER[state] if letter == "R" else NEXT[state][initial]
        i += 1
    return cost, out, state


def segments(rows: list[tuple[str, int]], size: int) -> list[tuple[list, dict[tuple[int, int], tuple[int, str]]]]:
    """Each segment's rows, and by (state in, state out) the cost and audit of its search."""
    out = []
    for at in range(0, len(rows), size):
        part, table = rows[at:at + size], {}
        for b in range(4):
            failed: dict[tuple[int, int], int] = {}
            for a in range(4):
                audit = search(part, a, b, failed)
                if audit is not None:
                    table[a, b] = (apply(part, audit, a)[0], audit)
        out.append((part, table))
    return out


def chosen(tables: list[dict], ends: list[int]) -> list[list]:
    """Backward choice: per table and state in, the state out and total cost, or None; ties by the table's own order of audits."""
    best, out = [(0, c) if c < NEVER else None for c in ends], []
    for table in reversed(tables):
        row = []
        for a in range(4):
            ways = [(table[a, b][0] + best[b][1], table[a, b][1], b) for b in range(4) if (a, b) in table and best[b] is not None]
            row.append((min(ways)[2], min(ways)[0]) if ways else None)
        out.append(row)
        best = row
    return out[::-1]


def through(parts: list, start: int, ends: list[int]) -> str | None:
    """The audit over all segments from ``start``, without the inserts after the last row."""
    picks, q, out = chosen([t for _, t in parts], ends), start, []
    for (_, table), row in zip(parts, picks, strict=True):
        if row[q] is None:
            return None
        out.append(table[q, row[q][0]][1])
        q = row[q][0]
    return "".join(out)


def whole(rows: list[tuple[str, int]], size: int = SEGMENT) -> str:
    """The audit of a whole conversation."""
    if len(rows) <= size:
        return search(rows)
    audit = through(segments(rows, size), 0, list(ENDS))
    return audit + "I" * (ENDS[apply(rows, audit)[2]] // 5)


STATS = "n long, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
SCAN = (f"what int, key string, part int, {STATS}, cost long, audit string, sha string, costs array<long>, ranks array<int>, "
        "no long, fault int, role string, text string")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class _Slice:
    """The rows of one conversation in one range."""

    def __init__(self, key):
        self.key, self.rows, self.texts = key, [], []
        self.stats = {"n": 0, "lo": None, "hi": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": None, "last": None}

    def add(self, turn, role, text, blank, duplicate, truncated):
        s, initial = self.stats, role[:1] or " "
        name = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if name:
            s[name] += 1
        if s["last"] is None:
            s["first"] = initial
        elif s["last"] + initial not in LEGAL:
            s["illegal"] += 1
        s["last"] = initial
        if turn is not None:
            s["turns"] += turn != s["hi"]
            s["lo"] = turn if s["lo"] is None else s["lo"]
            s["hi"] = turn
        s["n"] += 1
        self.rows.append((initial, {None: CLEAN, "truncated": TRUNCATED}.get(name, MUST_GO)))
        self.texts.append((role, text))

    def closed(self, size):
        audit = whole(self.rows, size)
        cost, kept, _ = apply(self.rows, audit)
        sha = hashlib.sha256()
        for k, (i, role) in enumerate(kept):
            sha.update(line(self.texts, i, role, k > 0))
        return [{"what": 0, "key": self.key, "cost": cost, "audit": audit, "sha": sha.hexdigest(), **self.stats}]

    def open(self, part, size):
        parts, costs, ranks = segments(self.rows, size), [-1] * 16, [-1] * 16
        for a in range(4):
            ways = {}
            for b in range(4):
                audit = through(parts, a, [0 if b == q else NEVER for q in range(4)])
                if audit is not None:
                    ways[b] = audit
                    costs[4 * a + b] = apply(self.rows, audit, a)[0]
            for k, b in enumerate(sorted(ways, key=ways.get)):
                ranks[4 * a + b] = k
        out = [{"what": 1, "key": self.key, "part": part, "costs": costs, "ranks": ranks, **self.stats}]
        return out + [{"what": 2, "key": self.key, "part": part, "no": k, "fault": f, "role": r, "text": t}
                      for k, ((_, f), (r, t)) in enumerate(zip(self.rows, self.texts, strict=True))]


def line(texts, i, role, further) -> bytes:
    out = f"{role}:" if i < 0 else f"{role or texts[i][0]}:{texts[i][1]}"
    return (("\n" if further else "") + out).encode("utf-8", "replace")


def _scan(size: int):
    fields = to_arrow_schema(StructType.fromDDL(SCAN))

    def run(batches):
        part, before, now, first = TaskContext.get().partitionId(), [], None, True
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["key"] != now.key:
                    if now is not None:
                        before += now.open(part, size) if first else now.closed(size)
                        first = False
                    now = _Slice(row["key"])
                for k in range(row["copies"]):
                    now.add(row["turn"], row["role"], row["text"], row["blank"], row["dup"] or k > 0, row["truncated"])
            if before:
                yield pa.RecordBatch.from_pylist(before, schema=fields)
                before = []
        if now is not None:
            yield pa.RecordBatch.from_pylist(before + now.open(part, size), schema=fields)
    return run


RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
CHOICE = f"part int, start int, goal int, tail int, head boolean, {RESULT}"


def _joined(group):
    """A conversation's ranges (at most one row each): the states each begins and ends in, and the whole's counts."""
    import pandas as pd

    rows = group.sort_values("part").to_dict("records")
    live = [r for r in rows if r["n"] > 0]
    tables = [{(a, b): (int(r["costs"][4 * a + b]), int(r["ranks"][4 * a + b])) for a in range(4) for b in range(4) if r["costs"][4 * a + b] >= 0} for r in live]
    picks, q, out = chosen(tables, list(ENDS)), 0, []
    total = {k: int(sum(r[k] for r in rows)) for k in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(live, live[1:], strict=False))
    timed = [r for r in live if not pd.isna(r["lo"])]
    turns = int(sum(r["turns"] for r in timed)) - sum(a["hi"] == b["lo"] for a, b in zip(timed, timed[1:], strict=False))
    total["gaps"] = min(int(timed[-1]["hi"]) - int(timed[0]["lo"]) + 1 - turns, (1 << 63) - 1) if timed else 0
    total["cost"] = picks[0][0][1] if picks else 0
    for r, row in zip(live, picks, strict=True):
        out.append({"part": r["part"], "start": q, "goal": row[q][0], "tail": 0, "head": not out})
        q = row[q][0]
    if out:
        out[-1]["tail"] = ENDS[q] // 5
    else:
        out = [{"part": -1, "start": 0, "goal": 0, "tail": 0, "head": True}]
    return pd.DataFrame([{"key": rows[0]["key"], **total, **r} for r in out])[[c.split()[0] for c in CHOICE.split(", ")]]


PIECE = "key string, part int, piece int, audit string, lines binary"
PIECE_BYTES = 1 << 20


def _pieces(size: int):
    def run(table):
        table = table.sort_by("no")
        r = {c: table.column(c).to_pylist() for c in ("fault", "role", "text")}
        key, part, start, goal, tail = (table.column(c)[0].as_py() for c in ("key", "part", "start", "goal", "tail"))
        rows, texts = [(a[:1] or " ", f) for a, f in zip(r["role"], r["fault"], strict=True)], list(zip(r["role"], r["text"], strict=True))
        audit = through(segments(rows, size), start, [0 if q == goal else NEVER for q in range(4)]) + "I" * tail
        pieces, held = [[]], 0
        for i, role in apply(rows, audit, start)[1]:
            pieces[-1].append(line(texts, i, role, True))
            held += len(pieces[-1][-1])
            if held > PIECE_BYTES:
                pieces.append([])
                held = 0
        n = len(pieces)
        return pa.table({"key": pa.array([key] * n, pa.string()), "part": pa.array([part] * n, pa.int32()), "piece": pa.array(range(n), pa.int32()),
                         "audit": pa.array([audit] + [""] * (n - 1), pa.string()), "lines": pa.array([b"".join(p) for p in pieces], pa.binary())})
    return run


def _hashed(batches):
    key, audit, sha, begun = None, [], None, False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    out.append((key, "".join(audit), sha.hexdigest()))
                key, audit, sha, begun = row["key"], [], hashlib.sha256(), False
            audit.append(row["audit"])
            if row["lines"]:
                sha.update(row["lines"] if begun else row["lines"][1:])       # no line feed before the first line
                begun = True
        if out:
            yield _hashes(out)
    if key is not None:
        yield _hashes([(key, "".join(audit), sha.hexdigest())])


def _hashes(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["key", "audit", "sha"])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           copies_col: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``rows``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of
    the repaired ``role:text`` lines).  ``copies_col``: how often a row stands there (0: it only names its conversation)."""
    spark = rows.sparkSession
    conv, copies = F.col(f"`{conv_col}`"), F.lit(1) if copies_col is None else F.col(f"`{copies_col}`")
    kind = rows.select(conv.alias("c")).dtypes[0][1]
    rows = rows.select(F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv.cast("string"))).alias("key"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                       F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"), copies.cast("int").alias("copies"))
    rows = rows.withColumn("text", F.when(F.col("copies") > 0, F.col("text")).otherwise("")).withColumn("rid", F.monotonically_increasing_id())
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = materialise(rows.withColumn("sha", digest), "turns")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("t"), "turn", "rid"))
    live = grouped(rows.filter("copies > 0"), ["key", "sha"], {"first": first}).withColumn("dup", F.col("first.rid") != F.col("rid")).drop("first")
    rows_all = live.unionByName(rows.filter("copies <= 0").withColumn("dup", F.lit(False)))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    rows_all = rows_all.withColumn("blank", bare == "").withColumn("truncated", ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
    total, weight = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_A_RANGE), -(-weight // BYTES_A_RANGE))
    keys = ["key", F.col("turn").asc_nulls_first(), "sha", "rid"]
    small_batches(spark)
    dealt = materialise(rows_all, "marked").repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    out = materialise(dealt.select("key", "turn", "role", "text", "copies", "dup", "blank", "truncated").mapInArrow(_scan(segment), SCAN), "scanned")

    gaps = F.when(F.col("lo").isNull(), 0).otherwise(F.expr("cast(least(cast(hi as decimal(20)) - lo + 1 - turns, 9223372036854775807) as long)"))
    done = out.filter("what = 0").select("key", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha")
    choice = materialise(out.filter("what = 1").select("key", "part", *[s.split()[0] for s in STATS.split(", ")], "costs", "ranks")
                         .groupBy("key").applyInPandas(_joined, CHOICE), "choices")
    states = choice.select("key", "part", "start", "goal", "tail")
    pieces = (out.filter("what = 2").select("key", "part", "no", "fault", "role", "text").join(states, ["key", "part"])
              .groupBy("key", "part").applyInArrow(_pieces(segment), PIECE))
    hashes = pieces.repartition("key").sortWithinPartitions("key", "part", "piece").mapInArrow(_hashed, "key string, audit string, sha string")
    heads = choice.filter("head").select(*[c.split()[0] for c in RESULT.split(", ")])
    met = heads.join(hashes, "key", "left").withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("sha", F.coalesce("sha", F.lit(EMPTY_SHA)))
    back = F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind)).alias("conv")
    return done.unionByName(met).select(back, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` rows with the faults that crc32 of ``conv_id:turn`` gives them, and how often each stands there."""
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(put("conv_id"), F.lit(":"), put("turn"))) % 20
    text = F.when(n == 1, "").when(n == 2, F.translate(put("text"), ".!?", "")).otherwise(put("text"))
    return rows.select("conv_id", "turn", F.when(n == 4, "user").otherwise(put("role")).alias("role"), text.alias("text"),
                       F.when(n == 0, 0).when(n == 3, 2).otherwise(1).alias("copies"))


def op13_conversation_repair(spark, sf_dir):
    out = repair(damaged(documents(spark, sf_dir, "conversations")), copies_col="copies")
    return out.withColumnRenamed("conv", "conv_id")


#: The least (cost, audit) per row and state, row by row.  Rows of equal turn are ordered by role and text.
OP13_SQL = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations),
e AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS k FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e),
f AS (SELECT conv_id, i, turn, role, text, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
             CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
ins AS (SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I'), (2, 2, 'II'), (3, 3, 'II')) t(a, b, put)),
moves AS (
  SELECT f.conv_id, f.i, n.a, 2 + 5 * length(put) AS cost, put || 'D' AS done, b AS q FROM f, ins n
  UNION ALL
  SELECT f.conv_id, f.i, n.a, 5 * length(put) + CASE WHEN fault = 't' THEN 5 ELSE 0 END, put || 'K',
         CASE WHEN x = 's' THEN 1 WHEN x = 'u' THEN 2 ELSE 3 END
  FROM f, ins n WHERE fault NOT IN ('b', 'd') AND (x = 's' AND b = 0 OR x = 'u' AND b <> 2 OR x = 'a' AND b = 2)
  UNION ALL
  SELECT f.conv_id, f.i, n.a, 5 * length(put) + 1 + CASE WHEN fault = 't' THEN 5 ELSE 0 END, put || 'R', CASE WHEN b = 2 THEN 3 ELSE 2 END
  FROM f, ins n WHERE fault NOT IN ('b', 'd')),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit FROM c
  UNION ALL
  SELECT conv_id, i, q, w.cost, w.audit FROM (
    SELECT m.conv_id, m.i, m.q, min({{'cost': b.cost + m.cost, 'audit': b.audit || m.done}}) AS w
    FROM best b JOIN moves m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1 AND m.a = b.q GROUP BY m.conv_id, m.i, m.q)),
last AS (SELECT conv_id, max(i) AS n FROM best GROUP BY conv_id),
won AS (SELECT b.conv_id, min({{'cost': b.cost + CASE q WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': b.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS w
        FROM best b JOIN last l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.n = b.i GROUP BY b.conv_id),
steps AS (SELECT conv_id, w.audit AS audit, unnest(range(1, length(w.audit) + 1)) AS k FROM won),
marks AS (SELECT conv_id, k, audit[k] AS op, sum((audit[k] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY k) AS i FROM steps),
kept AS (SELECT m.conv_id, m.k, m.op, f.role, f.text, f.x, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.k) AS p
         FROM marks m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i AND m.op <> 'I' WHERE m.op <> 'D'),
sys AS (SELECT conv_id, max((p = 1 AND op = 'K' AND x = 's')::INT) AS s FROM kept GROUP BY conv_id),
lines AS (SELECT k.conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (p - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS sha
          FROM kept k JOIN sys ON sys.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                 count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, w.w.cost::BIGINT AS cost, w.w.audit AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM won w LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM w.conv_id
"""

ship(__name__)
