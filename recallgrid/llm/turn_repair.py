"""Repair of the structure of conversations: the cheapest edits after which roles alternate and every turn says something.

A conversation and its grammar make a lattice that is never stored: its nodes are (turn index, grammar state), its edges are edits.
Dijkstra's algorithm walks it by the key (cost, audit), where the audit is the edits' initials in order, and stops at the first
accepting end node that it pops.

Turns are sorted over ranges of (conversation, turn), so that a conversation of any length is spread over many tasks. Each task cuts
what it gets into segments of bounded size. For a segment that is a whole conversation the search runs from the grammar's start to
an accepting end; for a part of one it runs from every state to every state. A second, coarse lattice of (segment index, state) then
joins the parts by the same search; it holds one character a turn for each pair of states, never texts.

Edits: Keep costs 0; Rerole, to user or assistant, 2; Delete 3; Insert, of an empty turn of user or assistant, 2. A blank or
duplicate turn must be deleted; a truncated one that isn't deleted adds 1.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import written

#: Turns and bytes of text of a segment; and copies of a turn that are dealt out together.
SEGMENT_ROWS, SEGMENT_BYTES, COPIES = 1024, 4 << 20, 4096
#: White space that doesn't count as text, and the characters that end a turn.
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: The grammar ``(s?(ua)+)?``: the state after a turn whose role has this initial. A state is the initial of the last turn.
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
STATES, ACCEPTING = ("", "s", "u", "a"), ("", "a")
#: Roles that an edit may give.
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Neighbours that the grammar allows.
LEGAL = ("su", "ua", "au")
_MUST_GO = "-"

Node = tuple[int, str]


def search(n: int, steps: Callable[[int, str], Iterable[tuple[int, str, int, str]]], start: str, first: bool) -> tuple[dict[str, tuple[int, str]], dict[Node, Node]]:
    """The least (cost, audit) from (0, ``start``) to each state at ``n``; with ``first``, to the first accepting one popped only. And
    the node before each.

    Costs follow from audits, so of two paths between the same nodes with equal costs neither audit begins with the other: the
    order of audits stays when both go on alike.
    """
    heap: list[tuple[int, str, int, str, Node]] = [(0, "", 0, start, (0, start))]
    before: dict[Node, Node] = {}
    found: dict[str, tuple[int, str]] = {}
    while heap:
        cost, audit, i, state, last = heapq.heappop(heap)
        if (i, state) in before:
            continue
        before[i, state] = last
        if i == n and (not first or state in ACCEPTING):
            found[state] = cost, audit
            if first:
                break
        for more, letters, j, to in steps(i, state):
            if (j, to) not in before:
                heapq.heappush(heap, (cost + more, audit + letters, j, to, (i, state)))
    return found, before


def _edits(kinds: str) -> Callable[[int, str], Iterator[tuple[int, str, int, str]]]:
    """The edges of the lattice of turns. A kind is the turn's initial (``o`` for those that the grammar hasn't), upper case where it is
    truncated, or that of a turn that must go."""

    def steps(i: int, state: str) -> Iterator[tuple[int, str, int, str]]:
        given = [to for role in ROLES if (to := AFTER.get((state, role)))]
        for to in given:
            yield INSERT, "I", i, to
        if i == len(kinds):
            return
        yield DELETE, "D", i + 1, state
        if kinds[i] == _MUST_GO:
            return
        late = TRUNCATED if kinds[i].isupper() else 0
        if to := AFTER.get((state, kinds[i].lower())):
            yield KEEP + late, "K", i + 1, to
        for to in given:
            yield REROLE + late, "R", i + 1, to

    return steps


@lru_cache(20_000)
def cheapest_edits(kinds: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a whole conversation."""
    ((cost, audit),) = search(len(kinds), _edits(kinds), "", True)[0].values()
    return cost, audit


def paths_across(kinds: str) -> list[dict]:
    """The cheapest paths through a part of a conversation, from every state to every state that can be reached."""
    return [{"entry": a, "exit": b, "cost": cost, "audit": audit} for a in STATES for b, (cost, audit) in search(len(kinds), _edits(kinds), a, False)[0].items()]


def joined_paths(parts: list[list[dict]]) -> list[dict]:
    """The path taken through each part of one conversation."""
    by_entry = [{a: [x for x in part if x["entry"] == a] for a in STATES} for part in parts]

    def steps(i: int, state: str) -> Iterator[tuple[int, str, int, str]]:
        if i < len(parts):
            for x in by_entry[i][state]:
                yield x["cost"], x["audit"], i + 1, x["exit"]

    found, before = search(len(parts), steps, "", True)
    (state,) = found
    taken = []
    for i in range(len(parts), 0, -1):
        _, entry = before[i, state]
        taken.append(next(x for x in by_entry[i - 1][entry] if x["exit"] == state))
        state = entry
    return taken[::-1]


def with_faults(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv_id``, ``turn``, ``role``, ``text``, ``copy``, ``kind``, ``fault``): each turn's first fault of ``blank`` (no text besides white space),
    ``duplicate`` (role and text stand earlier in the conversation) and ``truncated`` (the last character besides white space is
    none of ``ENDS``); else null. A null role or text counts as one space. Texts are the same when their SHA-256 is.

    Equal rows are counted before they move, and dealt out again in parts; the turns at which a role and text stand first are
    found by aggregation, so that no task holds a conversation.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    first = rows.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s"), "first")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    rows = rows.select("conv_id", "turn", "role", "text", "sha", "n", later.alias("later"), F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("b"))
    rows = rows.withColumn("copy", F.explode(F.expr(f"sequence(b * {COPIES}, least(n, (b + 1) * {COPIES}) - 1)")))
    stripped = F.rtrim("text", F.lit(SPACE))
    fault = F.when(stripped == "", "blank").when(F.col("later") | (F.col("copy") > 0), "duplicate").when(~F.right(stripped, F.lit(1)).isin(*ENDS), "truncated")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    rows = rows.withColumn("fault", fault)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), _MUST_GO).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return rows.select("conv_id", "turn", "role", "text", "sha", "copy", kind.alias("kind"), "fault")


_TURN = T.StructType().add("edit", "string").add("role", "string").add("text", "string")
_PATH = T.StructType().add("entry", "string").add("exit", "string").add("cost", "long").add("audit", "string")
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _segment_type(conv_id: T.DataType) -> T.StructType:
    out = T.StructType().add("conv_id", conv_id).add("part", "integer").add("ord", "integer").add("whole", "boolean")
    for name in _COUNTS:
        out = out.add(name, "long")
    out = out.add("first_initial", "string").add("last_initial", "string").add("least_turn", "long").add("most_turn", "long").add("n_turns", "long")
    return out.add("turns", T.ArrayType(_TURN)).add("paths", T.ArrayType(_PATH))


def _segment(rows: list[tuple], part: int, number: int, whole: bool) -> dict:
    """A segment of (conv_id, turn, role, text, kind, fault); one that is a whole conversation comes repaired."""
    kinds = "".join(r[4] for r in rows)
    initials = [r[2][:1] for r in rows]
    numbered = [r[1] for r in rows if r[1] is not None]
    faults = [r[5] for r in rows]
    out = {name: faults.count(name) for name in _COUNTS[:3]}
    out |= {"conv_id": rows[0][0], "part": part, "ord": number, "whole": whole, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))}
    out |= {"first_initial": initials[0], "last_initial": initials[-1], "least_turn": min(numbered, default=None), "most_turn": max(numbered, default=None), "n_turns": len(set(numbered))}
    turns = [{"edit": None, "role": r[2], "text": r[3]} for r in rows]
    if not whole:
        return out | {"turns": turns, "paths": paths_across(kinds)}
    cost, audit = cheapest_edits(kinds)
    return out | {"turns": edited(turns, audit, ""), "paths": [{"entry": "", "exit": None, "cost": cost, "audit": audit}]}


def edited(turns: list[dict], audit: str, state: str) -> list[dict]:
    """The turns after the edits of ``audit``, the deleted ones too, each with its edit's initial; ``state``: the one that the edits begin in.

    The audit says all: after the first turn, which is the system's only where such a turn is kept, roles alternate.
    """
    out, left = [], iter(turns)
    for edit in audit:
        x = {"role": "", "text": ""} if edit == "I" else next(left)
        role = x["role"]
        if edit in "IR":
            (state,) = (to for r in ROLES if (to := AFTER.get((state, r))))
            role = ROLES[state]
        elif edit == "K":
            state = AFTER[state, role[:1]]
        out.append({"edit": edit, "role": role, "text": x["text"]})
    return out


def _cut(kind: pa.Schema, segment_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments of a task's sorted turns. The first and last conversation of a task may go on in its neighbours."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, fresh = TaskContext.get().partitionId(), 0, [], 0, False
        out: list[dict] = []
        n_out = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind", "fault")), strict=True):
                new = not held or row[0] != held[0][0]
                if held and (new or len(held) >= segment_rows or size >= SEGMENT_BYTES):
                    out.append(_segment(held, part, number, fresh and new))
                    n_out += size
                    number, held, size, fresh = number + 1, [], 0, new
                held.append(row)
                size += len(row[3])
                if len(out) >= 500 or n_out >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out, n_out = [], 0
        if held:
            out.append(_segment(held, part, number, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return kernel


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each conversation, from batches that are sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != held[0]["conv_id"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _take(kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_conversation(batches):
            taken = joined_paths([r["paths"] for r in rows])
            yield pa.RecordBatch.from_pylist([{"part": r["part"], "ord": r["ord"], "paths": [x]} for r, x in zip(rows, taken, strict=True)], kind)

    return kernel


def _apply(kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                (path,) = row["paths"]
                yield pa.RecordBatch.from_pylist([row | {"turns": edited(row["turns"], path["audit"], path["entry"])}], kind)

    return kernel


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Segments of the repaired conversations, to be read by ``repaired_turns`` and ``conversation_reports``.

    Turns stand in the order of ``turn``, nulls first; those of one number in that of role, then of the text's first 64 characters,
    then of its SHA-256. A null ``conv_id`` is a conversation of its own. Other columns take no part. No rows give no segments.
    """
    rows = with_faults(turns, conv_id, turn, role, text)
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("sha"), F.col("copy")]
    kind = _segment_type(rows.schema["conv_id"].dataType)
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "kind", "fault")
    segments = written(rows.mapInArrow(_cut(_arrow(kind), segment_rows), kind), "segments")
    parts = segments.where("NOT whole")
    small = T.StructType().add("part", "integer").add("ord", "integer").add("paths", T.ArrayType(_PATH))
    order = ("conv_id", "part", "ord")
    taken = parts.select(*order, "paths").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_take(_arrow(small)), small)
    joined = parts.drop("paths").join(taken, ["part", "ord"]).select(*kind.names).mapInArrow(_apply(_arrow(kind)), kind)
    return segments.where("whole").unionByName(joined)


def repaired_turns(segments: DataFrame) -> DataFrame:
    """The turns of repaired conversations, the deleted ones too: (``conv_id``, ``part``, ``ord``, ``pos``, ``edit``, ``role``, ``text``); they stand in
    the order of the three numbers."""
    return segments.select("conv_id", "part", "ord", F.posexplode("turns").alias("pos", "x")).select("conv_id", "part", "ord", "pos", "x.edit", "x.role", "x.text")


REPORT = (*_COUNTS, "gaps", "cost", "audit", "repaired_sha256")


def conversation_reports(segments: DataFrame) -> DataFrame:
    """One row for each conversation that has turns: ``conv_id``, how many turns have each fault, ``illegal`` (neighbours whose initials
    the grammar doesn't allow), ``gaps`` (numbers missing between the least and greatest turn), ``cost``, ``audit`` and the SHA-256
    of the repaired turns as ``role:text``, one on a line.

    A hash is made in one pass over its text; that of a conversation in parts streams through a task, a segment at a time.
    """
    gaps = F.coalesce(F.expr("most_turn - least_turn + 1 - n_turns"), F.lit(0))
    lines = F.transform(F.filter("turns", lambda x: x["edit"] != "D"), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    path = F.get("paths", F.lit(0))
    whole = segments.where("whole").select("conv_id", *_COUNTS, gaps.cast("long").alias("gaps"), path["cost"].alias("cost"), path["audit"].alias("audit"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    kind = T.StructType().add("conv_id", segments.schema["conv_id"].dataType)
    for name in REPORT:
        kind = kind.add(name, "string" if name in ("audit", "repaired_sha256") else "long")
    order = ("conv_id", "part", "ord")
    parts = segments.where("NOT whole").withColumn("lines", lines).drop("turns").repartition("conv_id").sortWithinPartitions(*order)
    return whole.select("conv_id", *REPORT).unionByName(parts.mapInArrow(_report(_arrow(kind)), kind))


def _report(kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def finished(now: dict) -> pa.RecordBatch:
        gaps = now["most"] - now["least"] + 1 - now["n"] if now["n"] else 0
        return pa.RecordBatch.from_pylist([{**now["sums"], "conv_id": now["conv_id"], "gaps": gaps, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}], kind)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                (path,) = row["paths"]
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        yield finished(now)
                    now = {"conv_id": row["conv_id"], "sums": dict.fromkeys((*_COUNTS, "cost"), 0), "n": 0, "least": None, "most": None, "audit": [], "sha": hashlib.sha256(), "any": False}
                else:
                    now["sums"]["illegal"] += now["last"] + row["first_initial"] not in LEGAL
                for name in _COUNTS:
                    now["sums"][name] += row[name]
                now["sums"]["cost"] += path["cost"]
                now["audit"].append(path["audit"])
                now["last"] = row["last_initial"]
                if row["n_turns"]:
                    now["n"] += row["n_turns"] - (now["most"] == row["least_turn"])
                    now["least"] = row["least_turn"] if now["least"] is None else now["least"]
                    now["most"] = row["most_turn"]
                for line in row["lines"]:
                    now["sha"].update((b"\n" if now["any"] else b"") + line.encode())
                    now["any"] = True
        if now is not None:
            yield finished(now)

    return kernel
