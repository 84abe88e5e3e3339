"""Repair of damaged conversations: cheapest edits by a recursive query over batches of conversations.

Turns are shuffled by conversation and sorted; a task cuts its stream into
batches of a bounded number of turns and asks DuckDB for each batch.  Every
recursion advances all conversations of the batch by one turn and keeps, for
each state of the grammar, the least cost and of equally cheap audits the
ASCII-least.  A conversation that outlasts a batch goes on in the next one
from the costs and audits of its states; what all of them share is settled and
leaves memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns that one recursive query takes.
TURNS = 2048
BLANKS = " \t\n\x0b\x0c\r"
#: The grammar `(s?(ua)+)?`: states before anything, after s, after u, after a; where a role leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FINAL = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
REPORT = "conv_id {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPAIRED = "conv_id {}, position bigint, role string, text string, edit string"


def _or_space(c) -> Column:
    return F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit(" "))


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: rows after damage by crc32(``conv_id:turn``) % 20; nulls count as one space.

    0 drops the row (it stays with ``there`` false, so that its conversation
    is known), 1 empties its text, 2 takes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes its role user.
    """
    kind = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))) % 20
    rows = convs.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), F.explode(times).alias("_")).drop("_")


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, letters) with no, one or two inserts from ``state``; more would come round again."""
    yield state, 0, ""
    at = USER if state != USER else ASSISTANT
    yield at, INSERT, "I"
    if state in (START, SYSTEM):
        yield ASSISTANT, 2 * INSERT, "II"


def edges() -> list[tuple[str, int, int, int, str]]:
    """(code, state, target, cost, letters): what one turn can become, followed by inserts.

    A code is a role's initial (x: none of the grammar's), in upper case where
    the turn is truncated, or d for a turn that must go.
    """
    out = []
    for code in "suaxSUAXd":
        for state in range(4):
            steps = [(state, DELETE, "D")]
            if code != "d":
                late = TRUNCATED if code.isupper() else 0
                steps += [(LEADS[r][state], late if r == code.lower() else REROLE + late, "K" if r == code.lower() else "R") for r in "sua" if state in LEADS[r] and (r != "s" or code in "sS")]
            out += [(code, state, t, c + more, letter + i) for s, c, letter in steps for t, more, i in _inserted(s)]
    return out


RECURSION = """
    WITH RECURSIVE live(conv, i, state, best) AS (
        SELECT conv, 0, state, {'cost': cost, 'audit': audit} FROM entry
        UNION ALL
        SELECT l.conv, l.i + 1, e.target, min({'cost': l.best.cost + e.cost, 'audit': l.best.audit || e.letters})
        FROM live l JOIN turns t ON t.conv = l.conv AND t.i = l.i JOIN edge e ON e.code = t.code AND e.state = l.state
        GROUP BY l.conv, l.i, e.target)
    SELECT live.conv, state, best.cost, best.audit FROM live JOIN sizes ON live.conv = sizes.conv AND live.i = sizes.n"""
ENTRY = [(s, c, a) for s, c, a in _inserted(START)]


class Batch:
    """DuckDB with the grammar's edges; one a task."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.db.execute("CREATE TABLE edge (code VARCHAR, state INTEGER, target INTEGER, cost BIGINT, letters VARCHAR)")
        self.db.executemany("INSERT INTO edge VALUES (?, ?, ?, ?, ?)", edges())

    def __call__(self, codes: list[str], entries: list[list[tuple[int, int, str]]]) -> list[dict[int, tuple[int, str]]]:
        """Of each conversation (its turns' codes, the states it starts from) the least cost and audit per state."""
        flat = [(i, s, c, a) for i, own in enumerate(entries) for s, c, a in own]
        pairs = [(i, k, c) for i, own in enumerate(codes) for k, c in enumerate(own)]
        columns = lambda rows, *kinds: {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)}
        i32, i64, s = pa.int32(), pa.int64(), pa.string()
        tables = {
            "entry": columns(flat, ("conv", i32), ("state", i32), ("cost", i64), ("audit", s)),
            "turns": columns(pairs, ("conv", i32), ("i", i32), ("code", s)),
            "sizes": {"conv": pa.array(range(len(codes)), i32), "n": pa.array([len(c) for c in codes], i32)},
        }
        for name, table in tables.items():
            self.db.register(name, pa.table(table))
        out: list[dict] = [{} for _ in codes]
        for conv, state, cost, audit in self.db.execute(RECURSION).fetchall():
            out[conv][state] = (cost, audit)
        for name in tables:
            self.db.unregister(name)
        return out


class Conversation:
    """What is known of one conversation so far, as its turns stream by."""

    def __init__(self, conv_id):
        self.id, self.blank, self.duplicate, self.truncated, self.illegal = conv_id, 0, 0, 0, 0
        self.low = self.high = self.turn = None
        self.distinct, self.before, self.seen = 0, None, set()
        self.states, self.pending, self.new = list(ENTRY), [], []
        self.audit: list[str] = []
        self.made, self.hash, self.state = 0, hashlib.sha256(), START

    def add(self, turn, role: str, text: str) -> None:
        """One turn: counts its faults; its code awaits the next recursion."""
        if turn is not None and turn != self.turn:
            self.distinct += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        bare = text.rstrip(BLANKS)
        mark = hashlib.blake2b(role.encode() + b"\0" + text.encode(), digest_size=16).digest() if bare else b""
        code = initial if initial in ("s", "u", "a") else "x"
        if not bare:
            self.blank, code = self.blank + 1, "d"
        elif mark in self.seen:
            self.duplicate, code = self.duplicate + 1, "d"
        elif bare[-1] not in ".!?":
            self.truncated, code = self.truncated + 1, code.upper()
        if bare:
            self.seen.add(mark)
        self.pending.append((role, text))
        self.new.append(code)

    def advance(self, found: dict[int, tuple[int, str]]) -> Iterator[tuple[str, str, str]]:
        """Take the recursion's states; yield the turns (role, text, edit) on which all of them agree."""
        self.new = []
        audits = [a for _, a in found.values()]
        least, most = min(audits), max(audits)
        shared = next((i for i, (a, b) in enumerate(zip(least, most)) if a != b), min(len(least), len(most)))
        self.states = [(s, c, a[shared:]) for s, (c, a) in sorted(found.items())]
        yield from self._settle(least[:shared])

    def finish(self) -> Iterator[tuple[str, str, str]]:
        """Settle the cheapest way to a complete conversation."""
        self.cost, rest = min((c, a) for s, c, a in self.states if s in FINAL)
        yield from self._settle(rest)

    def _settle(self, audit: str) -> Iterator[tuple[str, str, str]]:
        self.audit.append(audit)
        at = 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else self.pending[at]
            at += letter != "I"
            if letter == "D":
                continue
            initial = role[:1] if letter == "K" else "ua"[self.state == USER]
            self.state = LEADS[initial][self.state]
            role = role if letter == "K" else NAMES[initial]
            self.hash.update(("\n" if self.made else "").encode() + f"{role}:{text}".encode())
            self.made += 1
            yield role, text, letter
        del self.pending[:at]

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _repaired(batches: Iterator[pa.RecordBatch], turns: int, with_turns: bool) -> Iterator[list]:
    """Sorted turns to rows: reports, or repaired turns."""
    solve, current, waiting, held = None, None, [], 0

    def step(open_end: bool) -> list:
        nonlocal solve, waiting, held
        solve = solve or Batch()
        found = solve(["".join(c.new) for c in waiting], [c.states for c in waiting])
        rows = []
        for c, own in zip(waiting, found):
            done = c is not waiting[-1] or not open_end
            position = c.made
            made = list(c.advance(own)) + (list(c.finish()) if done else [])
            if with_turns:
                rows += [(c.id, position + k, *m) for k, m in enumerate(made)]
            elif done:
                rows.append(c.report())
        waiting, held = waiting[-1:] if open_end else [], 0
        return rows

    for batch in batches:
        for conv_id, turn, role, text, there in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there")]):
            if current is None or conv_id != current.id:
                current = Conversation(conv_id)
                waiting.append(current)
            if there:
                current.add(turn, role, text)
            held += 1
            if held >= turns:
                yield step(True)
    if waiting:
        yield step(False)


def repair(rows: DataFrame, turns: int = TURNS, with_turns: bool = False) -> DataFrame:
    """Cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text, there), as :func:`damaged` gives them.

    A report per conversation (``REPORT``), or with ``with_turns`` its
    repaired turns in order (``REPAIRED``; edit is K, R or I).  Turns are
    taken by turn, nulls first; ties by role and text in code-point order.
    Rows whose ``there`` is not true only name their conversation.  Null
    conv_ids are one conversation, null roles and texts one space.  A
    conversation without rows has zeros, an empty audit and the hash of
    nothing.  An empty table gives an empty result; other columns are ignored.

    A task holds ``turns`` turns and, of the conversation it is in, 16 bytes
    for each distinct turn and one for each letter of its audit.
    """
    df = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text"), F.coalesce("there", F.lit(False)).alias("there"))
    schema = (REPAIRED if with_turns else REPORT).format(rows.schema["conv_id"].dataType.simpleString())
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for made in _repaired(batches, turns, with_turns):
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), arrow.types)], schema=arrow)

    order = [F.col("conv_id"), F.col("there"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return df.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


# --- the same in SQL ----------------------------------------------------------


def crc32_sql() -> str:
    """Common table expressions for DuckDB: ``crc_table`` (t: 256 numbers) and, by text substitution, ``crc32_of(s, t)``.

    The bytes of code points below U+0800 are spelled out; others do not occur
    in what is hashed here.
    """
    return """
    crc_step(b, c, k) AS (
        SELECT b, b, 0 FROM range(256) r(b)
        UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_step WHERE k = 8)"""


def crc32_of(s: str) -> str:
    """DuckDB expression: the crc32 of the UTF-8 bytes of ``s``, where ``t`` is the table of :func:`crc32_sql`."""
    code = "list_transform(string_split({}, ''), lambda c: CAST(unicode(c) AS BIGINT))".format(s)
    raw = f"flatten(list_transform({code}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 | (u >> 6), 128 | (u & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {raw}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


ORACLE_SQL = f"""
    WITH RECURSIVE {crc32_sql()},
    k AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc32_of("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
        FROM conversations, crc_table),
    ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM k)),
    d AS (
        SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END)) AS copy
        FROM k JOIN ids ON k.conv_id IS NOT DISTINCT FROM ids.conv_id),
    o AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    f AS (
        SELECT c, i, turn, role, text, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
            NOT regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') AS blank,
            row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
            NOT regexp_matches(text, '[.!?][ \\t\\n\\x0B\\f\\r]*\\z') AS late
        FROM o),
    g AS (SELECT *, CASE WHEN blank THEN 'b' WHEN again THEN 'd' WHEN late THEN 't' ELSE '' END AS fault FROM f),
    leads(r, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
    inserts(p, q, more, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')),
    edits AS (
        SELECT c, i, p, p AS q, 3 AS cost, 'D' AS letter FROM g, range(4) x(p)
        UNION ALL SELECT c, i, p, q, CAST(fault = 't' AS INTEGER), 'K' FROM g JOIN leads USING (r) WHERE fault IN ('', 't')
        UNION ALL SELECT c, i, p, q, 2 + CAST(fault = 't' AS INTEGER), 'R' FROM g, leads WHERE fault IN ('', 't') AND leads.r <> 's' AND leads.r <> g.r),
    live(c, i, q, best) AS (
        SELECT c, CAST(0 AS BIGINT), inserts.q, {{'cost': more, 'audit': letters}} FROM ids, inserts WHERE p = 0
        UNION ALL
        SELECT l.c, e.i, n.q, min({{'cost': l.best.cost + e.cost + n.more, 'audit': l.best.audit || e.letter || n.letters}})
        FROM live l JOIN edits e ON e.c = l.c AND e.i = l.i + 1 AND e.p = l.q JOIN inserts n ON n.p = e.q
        GROUP BY l.c, e.i, n.q),
    sizes AS (
        SELECT ids.c, ids.conv_id, count(g.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
            count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
        FROM ids LEFT JOIN g ON g.c = ids.c GROUP BY ids.c, ids.conv_id),
    best AS (SELECT s.c, min(live.best) AS best FROM sizes s JOIN live ON live.c = s.c AND live.i = s.n AND live.q IN (0, 3) GROUP BY s.c),
    walk AS (
        SELECT c, j, substr(audit, j, 1) AS letter, length(regexp_replace(substr(audit, 1, j), 'I', '', 'g')) AS i
        FROM (SELECT c, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS j FROM best)),
    kept AS (
        SELECT w.c, w.j, w.letter, g.role, g.text, row_number() OVER (PARTITION BY w.c, w.letter = 'K' AND g.r = 's' ORDER BY w.j) AS place
        FROM walk w LEFT JOIN g ON g.c = w.c AND g.i = w.i AND w.letter <> 'I' WHERE w.letter <> 'D'),
    told AS (SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM kept GROUP BY c)
    SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(best.best.cost AS BIGINT) AS cost, best.best.audit AS audit, sha256(coalesce(t, '')) AS repaired_sha256
    FROM sizes s JOIN best USING (c) LEFT JOIN told USING (c)"""
