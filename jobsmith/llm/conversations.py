"""Conversation repair: the cheapest edits that make a conversation's roles read ``(s?(ua)+)?``.

A conversation is its rows in the order of turns (nulls first; equal turns by the md5 of role and
text). A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (does
not end in ``.``, ``!`` or ``?``). Edits are Keep (0), Rerole to user or assistant (1), Delete (2; the
only one for blank and duplicate rows) and Insert of an empty user or assistant row (5); a truncated
row that stays adds 5. Of the cheapest edit lists the one whose initials come first in ASCII is taken.

One integer per state decides: its high digits are the cost, its ``room`` low digits in base 8 are the
audit letters in ASCII order from 1 on, padded at the end with zeros, so that a shorter audit comes
first. Putting an edit in front adds its cost, moves the letters one digit down and sets the first one.
The repair is the integer minimum over a graph of (row, state), from the last row back. The
states are nothing yet, after s, after u, after a.

Rows are sorted by a range partitioning, so a conversation of any size is spread over tasks. One that
lies within a task and ``chunk`` rows is solved there. The others are cut into chunks; a chunk
returns its best weight for every pair of entry and exit state. Since a chunk's audit ends with
a row's letter, two exits never tie in it and the best chain of chunks is found from these alone. The
chunks then give their repaired lines, and a stream in chunk order hashes them. What one task holds
is a chunk's rows, or a conversation's chunk weights.

Cases: null role and text are one space, null ids and turns are so in the hashed key only; equal rows (of
one turn) are neighbours; a conversation without rows left gives zeros, an empty audit and the hash of
nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from jobsmith.llm.common import staged

BLANKS = " \t\n\x0b\x0c\r"
LETTERS = "DIKR"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after one more user or assistant row, whichever is due
DUE = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_DIGIT = {x: i + 1 for i, x in enumerate(LETTERS)}
_TO_LETTERS = str.maketrans("1234", LETTERS)


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies`` after the damage; dropped rows have no copies."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(spaced(id_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = spaced(text_col)
    return conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), hit.alias("hit"),
        F.when(hit == 4, "user").otherwise(spaced(role_col)).alias("role"),
        F.when(hit <= 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).withColumn("copies", F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).cast("long")).drop("hit")


def faults(rows: DataFrame) -> DataFrame:
    """``conv, turn, h, role, text, copies, blank, seen, cut``: equal rows counted, with the faults of each.

    ``seen``: the first copy is a duplicate already (the others always are)."""
    h = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    counted = staged(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("h", h), "talk-rows")
    # only rows that come up at several turns of a conversation are looked up
    first = (counted.filter("copies > 0").groupBy("conv", "h").agg(F.min(_turn(F.col("turn"))).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select(F.col("conv").alias("first_conv"), F.col("h").alias("first_h"), "first"))
    first = staged(first, "talk-firsts")
    same = F.col("conv").eqNullSafe(F.col("first_conv")) & (F.col("h") == F.col("first_h"))
    met = counted.join(first.hint("merge"), same, "left")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    return met.select("conv", "turn", "h", "role", "text", "copies", (F.length(end) == 0).alias("blank"),
                      F.coalesce(_turn(F.col("turn")) > F.col("first"), F.lit(False)).alias("seen"),
                      (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def _turn(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0).cast("long")).alias("turn"))


def put(rest: int, cost: int, letter: str, room: int) -> int:
    """The weight of one edit in front of the edits of ``rest``."""
    bits = 3 * room
    return (rest >> bits) + cost << bits | _DIGIT[letter] << bits - 3 | (rest & (1 << bits) - 1) >> 3


def audit(weight: int, room: int) -> tuple[int, str]:
    """Cost and letters of a weight."""
    bits = 3 * room
    return weight >> bits, f"{weight & (1 << bits) - 1:0{room}o}".rstrip("0").translate(_TO_LETTERS)


def ends(room: int) -> list[int]:
    """Weights behind the last row: what is still missing to a full pair is inserted."""
    one = put(0, COST["I"], "I", room)
    return [0, put(one, COST["I"], "I", room), one, 0]


def least(entries: Sequence[tuple], end: Sequence[int | None], room: int) -> list[int | None]:
    """The least weight from each state over the rows (initial, must go, truncated), given those behind them."""
    now = list(end)
    for initial, must_go, truncated in reversed(entries):
        kept, row = KEPT.get(initial, {}), []
        for s in range(4):
            options = [] if now[s] is None else [put(now[s], COST["D"], "D", room)]
            if not must_go:
                more = TRUNCATED if truncated else 0
                if s in kept and now[kept[s]] is not None:
                    options.append(put(now[kept[s]], COST["K"] + more, "K", room))
                if now[DUE[s]] is not None:
                    options.append(put(now[DUE[s]], COST["R"] + more, "R", room))
            row.append(min(options, default=None))
        for _ in range(2):  # a third insert in a row leads back to a state
            row = [min((w for w in (row[s], None if row[DUE[s]] is None else put(row[DUE[s]], COST["I"], "I", room)) if w is not None), default=None)
                   for s in range(4)]
        now = row
    return now


def repaired(rows: Sequence[tuple[str, str]], letters: str, state: int) -> list[str]:
    """The lines ``role:text`` that the edits leave of rows (role, text), entered in ``state``."""
    out, at = [], 0
    for x in letters:
        if x != "I":
            role, text = rows[at]
            at += 1
        if x == "D":
            continue
        if x == "K":
            state = KEPT[role[:1]][state]
        else:
            state = DUE[state]
            role = NAMES[state]
        out.append(f"{role}:{'' if x == 'I' else text}")
    return out


_LONGS = ("blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns")


class _Part:
    """Rows of one conversation in order, up to a chunk."""

    def __init__(self, conv) -> None:
        self.conv, self.rows, self.entries = conv, [], []
        self.n = dict.fromkeys(_LONGS, 0) | {"first_turn": None, "last_turn": None}

    def add(self, turn, role: str, text: str, blank: bool, duplicate: bool, cut: bool) -> None:
        n = self.n
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if cut else None
        if fault:
            n[fault] += 1
        if self.entries:
            n["illegal"] += self.entries[-1][0] + role[:1] not in ("su", "ua", "au")
        if turn is not None:
            if n["first_turn"] is None:
                n["first_turn"] = turn
            n["turns"] += turn != n["last_turn"]
            n["last_turn"] = turn
        gone = blank or duplicate
        self.entries.append((role[:1], gone, cut))
        self.rows.append((role, "" if gone else text))

    def solved(self) -> dict:
        room = 3 * len(self.entries) + 3
        cost, letters = audit(least(self.entries, ends(room), room)[START], room)
        text = "\n".join(repaired(self.rows, letters, START))
        n = self.n
        gaps = 0 if n["first_turn"] is None else n["last_turn"] - n["first_turn"] + 1 - n["turns"]
        return {"conv": self.conv, "gaps": gaps, "cost": cost, "audit": letters,
                "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}

    def chunk(self) -> dict:
        room = 3 * len(self.entries) + 3
        costs, audits = [], []
        for t in range(4):
            for weight in least(self.entries, [0 if s == t else None for s in range(4)], room):
                cost, letters = (-1, "") if weight is None else audit(weight, room)
                costs.append(cost)
                audits.append(letters)
        return {"conv": self.conv, "costs": costs, "audits": audits, "first_role": self.entries[0][0] if self.entries else None,
                "last_role": self.entries[-1][0] if self.entries else None, "payload": json.dumps(self.rows)}


def _fields(conv: str) -> str:
    return (f"conv {conv}, part int, no long, solved boolean, " + ", ".join(f"{c} long" for c in _LONGS)
            + ", gaps long, cost long, audit string, repaired_sha256 string, costs array<long>, audits array<string>, first_role string, last_role string, payload string")


def _solve(schema: pa.Schema, chunk: int):
    """Sorted rows to solved conversations and chunks of those that may go on in another task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, out = TaskContext.get().partitionId(), 0, []
        now: _Part | None = None
        alone = False  # the conversation began in this task and has been in one chunk so far

        def close(ended: bool) -> None:
            nonlocal no
            whole = alone and ended
            out.append({"part": part, "no": no, "solved": whole, **{k: now.n[k] for k in _LONGS}, **(now.solved() if whole else now.chunk())})
            no += 1

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                conv, turn, role, text, copies, blank, seen, cut = (c[i].as_py() for c in columns)
                if now is None:
                    now = _Part(conv)  # it may have begun in the task before
                elif conv != now.conv:
                    close(True)
                    now, alone = _Part(conv), True
                for k in range(copies):
                    if len(now.entries) >= chunk:
                        alone = False
                        close(False)
                        now = _Part(conv)
                    now.add(turn, role, text, blank, seen or k > 0, cut)
                if len(out) >= 1000:
                    yield packed()
        if now is not None:
            close(False)  # it may go on in the next task
        yield packed()
    return run


def _chain(schema: pa.Schema):
    """The chunks of one conversation: entry state and audit of each; the first one also has the sums."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["no"]))
        cost, letters = zip(*(audit(w, 3) for w in ends(3)))
        best, choice = list(cost), []
        for r in reversed(rows):
            # column-wise: costs[4 * exit + entry]; exits of one entry never have one audit
            step = [min(((r["costs"][4 * t + s] + best[t], r["audits"][4 * t + s], t) for t in range(4) if r["costs"][4 * t + s] >= 0)) for s in range(4)]
            best = [x[0] for x in step]
            choice.append(step)
        state, out = START, []
        for i, (r, step) in enumerate(zip(rows, reversed(choice))):
            _, edits, to = step[state]
            out.append({"part": r["part"], "no": r["no"], "head_part": rows[0]["part"], "head_no": rows[0]["no"], "entry": state,
                        "edits": edits + (letters[to] if i == len(rows) - 1 else "")})
            state = to
        total = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        talk, turns = [r for r in rows if r["first_role"] is not None], [r for r in rows if r["first_turn"] is not None]
        total["illegal"] += sum(a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        total["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(turns, turns[1:]))
        gaps = turns[-1]["last_turn"] - turns[0]["first_turn"] + 1 - total.pop("turns") if turns else 0 * total.pop("turns")
        out[0] |= {"conv": rows[0]["conv"], "gaps": gaps, "cost": best[START], "audit": "".join(x["edits"] for x in out), **total}
        return pa.Table.from_pylist(out, schema=schema)
    return run


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's repaired lines (null if there are none)."""
    for batch in batches:
        lines = []
        for r in batch.to_pylist():
            done = repaired(json.loads(r["payload"]), r["edits"], r["entry"])
            lines.append("\n".join(done) if done else None)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("head_part", "head_no", "part", "no")] + [pa.array(lines, pa.string())],
                                         names=["head_part", "head_no", "part", "no", "lines"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams chunks in order and hashes each conversation's lines as they come."""
    key, digest, begun, out = None, None, False, []
    for batch in batches:
        for part, no, lines in zip(*(batch.column(c).to_pylist() for c in ("head_part", "head_no", "lines"))):
            if (part, no) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest, begun = (part, no), hashlib.sha256(), False
            if lines is not None:
                digest.update((("\n" if begun else "") + lines).encode("utf-8", "surrogatepass"))
                begun = True
        yield _digests(out)
        out = []
    if key is not None:
        yield _digests([(*key, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                                      names=["head_part", "head_no", "repaired_sha256"])


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(rows: DataFrame, id_col: str = "conv_id", chunk: int = 256) -> DataFrame:
    """``id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of ``conv, turn, role, text, copies``."""
    spark = rows.sparkSession
    conv = rows.schema["conv"].dataType
    arrow = lambda ddl: pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in spark.createDataFrame([], ddl).schema.fields])
    fields = _fields(conv.simpleString())
    ordered = (faults(rows).repartitionByRange("conv", "turn", "h").sortWithinPartitions("conv", "turn", "h")
               .select("conv", "turn", "role", "text", "copies", "blank", "seen", "cut"))
    solved = staged(ordered.mapInArrow(_solve(arrow(fields), chunk), fields), "talk-solved")
    chunks = solved.filter("NOT solved")
    chain = f"part int, no long, head_part int, head_no long, entry int, edits string, conv {conv.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    chained = staged(chunks.drop("payload", "gaps", "cost", "audit", "repaired_sha256", "solved").groupBy("conv").applyInArrow(_chain(arrow(chain)), chain), "talk-chained")
    lines = (chunks.select("part", "no", "payload").join(chained.select("part", "no", "head_part", "head_no", "entry", "edits"), ["part", "no"])
             .mapInArrow(_lines, "head_part int, head_no long, part int, no long, lines string"))
    digests = (lines.repartition("head_part", "head_no").sortWithinPartitions("head_part", "head_no", "part", "no")
               .mapInArrow(_hashes, "head_part int, head_no long, repaired_sha256 string"))
    heads = chained.filter("gaps IS NOT NULL").join(digests, ["head_part", "head_no"])
    out = solved.filter("solved").select("conv", *_RESULT).unionByName(heads.select("conv", *_RESULT))
    return out.withColumnRenamed("conv", id_col)


def repair_conversations(conversations: DataFrame, chunk: int = 256, id_col: str = "conv_id") -> DataFrame:
    """Damages the rows as ``damaged`` says and repairs them: one row per conversation of the input."""
    return repair(damaged(conversations, id_col), id_col, chunk)
