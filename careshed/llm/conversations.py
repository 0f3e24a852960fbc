"""Repair of conversation structure by a Viterbi search whose survivors coalesce.

A conversation should be an optional system message and then pairs of user and assistant. Rows are kept, given another
role or deleted, and empty messages are inserted, at the least cost. The search has four states: nothing yet, system,
user or assistant last. Survivors share a tree of back pointers with reference counts: a node without references is
freed, and as soon as one node of a row is left, all survivors descend from it and its edit is final. So a task holds
the rows that are still open and nothing more of a conversation, however long it is.

Among edits of equal cost the audit text that is ASCII-least wins. Edits after a row end in that row's letter, as
messages are inserted right before a row or at the end, so of two survivors' texts none starts the other, and their
order decides for everything that follows. The order of the complete open texts is kept from row to row as ranks.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from careshed.llm.common import in_arrow

#: What an edit costs, and what a kept row that breaks off adds.
RETYPE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: What any survivor can do, any other can do for so much more at most: an insert brings it to the same next role, and it
#: deletes a system message that only the other could still keep. Dearer survivors cannot win and are dropped.
SLACK = INSERT + DELETE
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, and the last message's role.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
AFTER = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the state that the next message leads to


def _moves(kind: int | None, delete: bool, cut_off: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of what can be done with a row of a role."""
    moves = [(s, s, DELETE, "D") for s in range(4)]
    if delete:
        return moves
    for s in range(4):
        for inserted in (0, 1):
            at, cost = (AFTER[s] if inserted else s), INSERT * inserted + cut_off
            if kind == SYSTEM and at == NOTHING or kind in (USER, ASSISTANT) and AFTER[at] == kind:
                moves.append((s, kind, cost, "I" * inserted + "K"))
            moves.append((s, AFTER[at], cost + RETYPE, "I" * inserted + "R"))
    return moves


_MOVES = {(kind, delete, cut): _moves(kind, delete, cut) for kind in (None, SYSTEM, USER, ASSISTANT) for delete in (False, True) for cut in (False, True)}
_CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


class _Node:
    __slots__ = ("above", "letters", "level", "references")

    def __init__(self, above: _Node | None, letters: str, level: set):
        self.above, self.letters, self.level, self.references = above, letters, level, 0
        level.add(self)
        if above is not None:
            above.references += 1


def _release(node: _Node | None) -> None:
    while node is not None and node.references == 0:
        node.level.discard(node)
        node, above = node.above, node.above
        if above is not None:
            above.references -= 1
        node = above


class Repair:
    """One conversation, row by row; ``emit(edit letter, role, text)`` gets every final edit in order."""

    def __init__(self, emit: Callable[[str, str, str], None]):
        self.emit, self.state = emit, NOTHING
        self.survivors: dict[int, tuple[int, int, _Node | None]] = {NOTHING: (0, 0, None)}  # cost, rank, node by state
        self.open: deque[tuple[set, str, str]] = deque()

    def row(self, role: str, text: str, delete: bool, cut_off: bool) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for source, to, cost, letters in _MOVES[KINDS.get(role[:1]), delete, cut_off]:
            if source in self.survivors:
                before, rank, _ = self.survivors[source]
                new = (before + cost, rank, letters, source)
                if to not in best or new < best[to]:
                    best[to] = new
        limit = min(new[0] for new in best.values()) + SLACK
        best = {to: new for to, new in best.items() if new[0] <= limit}
        level: set = set()
        self.open.append((level, role, text))
        old = [node for _, _, node in self.survivors.values() if node is not None]
        order = sorted(best, key=lambda to: best[to][1:3])
        self.survivors = {to: (best[to][0], i, _Node(self.survivors[best[to][3]][2], best[to][2], level)) for i, to in enumerate(order)}
        for node in level:
            node.references += 1
        for node in old:
            node.references -= 1
            _release(node)
        while self.open and len(self.open[0][0]) == 1:
            self._final(*self.open.popleft())

    def _final(self, level: set, role: str, text: str) -> None:
        (node,) = level
        self._say(node.letters, role, text)
        for after in self.open[0][0] if self.open else ():
            after.above = None  # what is final is not held
        if not self.open:
            self.survivors = {s: (cost, 0, None) for s, (cost, _, _) in self.survivors.items()}  # one is left

    def _say(self, letters: str, role: str, text: str) -> None:
        for letter in letters:
            if letter == "D":
                self.emit(letter, role, text)
                continue
            self.state = KINDS[role[0]] if letter == "K" else AFTER[self.state]
            self.emit(letter, role if letter == "K" else NAMES[self.state], "" if letter == "I" else text)

    def close(self) -> int:
        """Emit what is open, and the closing messages; returns the cost."""
        cost, _, state = min((c + INSERT * len(_CLOSING[s]), rank, s) for s, (c, rank, _) in self.survivors.items())
        node, letters = self.survivors[state][2], []
        while node is not None:
            letters.append(node.letters)
            node = node.above
        for (_, role, text), edit in zip(self.open, reversed(letters), strict=True):
            self._say(edit, role, text)
        self._say(_CLOSING[state], "", "")
        return cost


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planned faults, by crc32 of ``conv_id:turn`` modulo 20, and ``gone`` for a row that is dropped.

    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's. A null counts as a blank.
    """
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def _faults(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone, fault): fault is blank, duplicate, truncated or empty."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in conversations.columns else F.lit(False)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), gone.alias("gone"))
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("seen", F.row_number().over(same) > 1)
    end: Column = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(end == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.withColumn("fault", fault).drop("seen")


def _streamed(conversations: DataFrame, handle, schema: StructType) -> DataFrame:
    """``handle`` of the rows, which come by conversation and in order; a conversation streams through one task."""
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _faults(conversations).repartition(n, "conv_id").sortWithinPartitions("conv_id", "gone", F.asc_nulls_first("turn"), "role", "text", F.col("fault") == "duplicate")
    return in_arrow(rows.select("conv_id", "turn", "role", "text", "gone", "fault"), handle, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)


def repaired(conversations: DataFrame) -> DataFrame:
    """The edits and the messages they leave: conv_id, position (from 1), edit (K, R, D or I), role, text.

    Deleted rows are in it with a null position. Nulls, empty texts and ties are taken as by ``report``.
    """
    schema = conversations.select("conv_id").schema.add("position", "long").add("edit", "string").add("role", "string").add("text", "string")

    def handle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, repair, position = None, None, 0

        def emit(letter: str, role: str, text: str) -> None:
            nonlocal position
            position += letter != "D"
            out.append((now[0], None if letter == "D" else position, letter, role, text))

        def packed(kind: pa.DataType) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=schema.names)
            out.clear()
            return batch

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for conv, _, role, text, gone, fault in _rows(iter((batch,))):
                if now is None or now[0] != conv:
                    if repair:
                        repair.close()
                    now, repair, position = (conv,), Repair(emit), 0
                if not gone:
                    repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
            yield packed(kind)
        if repair:
            repair.close()
            yield packed(kind)

    return _streamed(conversations, handle, schema)


def report(conversations: DataFrame) -> DataFrame:
    """What is wrong with each conversation and how it is repaired: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256 (of the repaired ``role:text``, joined by line feeds).

    * Rows stand in order of turn, nulls first, then of role and text. turn is cast to long; gaps are the whole numbers
      missing between the least and the greatest turn, 0 if all are null.
    * A null role or text is one blank. A row's first fault counts: blank, duplicate (role and text stood earlier),
      truncated (its last character other than white space is none of ``.!?``). Repeated rows are duplicates.
    * illegal counts neighbours whose roles' initials are not su, ua or au; any other initial can only be changed.
    * A null conv_id is a conversation. An empty table gives no rows. Texts of any length are used whole. Other columns
      are not looked at, but rows whose ``gone`` is true count as no rows of their conversation.
    * SHA-256 takes a conversation's text in order, so a conversation streams through one task, which holds its open rows
      and its audit; duplicates are found before that, dealt by conversation, role and text.
    """
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = conversations.select("conv_id").schema
    for name in counts:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")

    def handle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        class Open:
            def __init__(self, conv):
                self.conv, self.first, self.last, self.turns, self.before = conv, None, None, 0, None
                self.n, self.audit, self.hash, self.any = dict.fromkeys(counts, 0), [], hashlib.sha256(), False
                self.repair = Repair(self.emit)

            def emit(self, letter: str, role: str, text: str) -> None:
                self.audit.append(letter)
                if letter != "D":
                    self.hash.update(("\n" * self.any + f"{role}:{text}").encode())
                    self.any = True

            def row(self, turn, role, text, fault) -> None:
                if turn is not None and turn != self.last:
                    self.first = turn if self.first is None else self.first
                    self.last, self.turns = turn, self.turns + 1
                if fault:
                    self.n[fault] += 1
                if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                    self.n["illegal"] += 1
                self.before = role[:1]
                self.repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

            def close(self) -> None:
                self.n["cost"] = self.repair.close()
                self.n["gaps"] = self.last - self.first + 1 - self.turns if self.turns else 0
                out.append((self.conv, *self.n.values(), "".join(self.audit), self.hash.hexdigest()))

        def packed(kind: pa.DataType) -> pa.RecordBatch:
            kinds = (kind, *[pa.int64()] * len(counts), pa.string(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=schema.names)
            out.clear()
            return batch

        now, kind = None, None
        for batch in batches:
            kind = batch.column(0).type
            for conv, turn, role, text, gone, fault in _rows(iter((batch,))):
                if now is None or now.conv != conv:
                    if now:
                        now.close()
                    now = Open(conv)
                if not gone:
                    now.row(turn, role, text, fault)
            yield packed(kind)
        if now:
            now.close()
            yield packed(kind)

    return _streamed(conversations, handle, schema)


def sql() -> str:
    """The same report of damaged conversations in DuckDB SQL, all survivors' edits and texts written out."""
    bit = "xor(x >> 1, (x & 1) * 3988292384)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {bit})), 4294967295::BIGINT)"
    moves = []
    for s in range(4):
        moves.append((s, "any", s, DELETE, "D", "", ""))
        for inserted in (0, 1):
            at, said = (AFTER[s] if inserted else s), (f"{NAMES[AFTER[s]]}:" if inserted else "")
            moves += [(s, k, KINDS[k], INSERT * inserted, "I" * inserted + "K", said, "") for k in "sua" if (k == "s" and at == NOTHING) or (k != "s" and AFTER[at] == KINDS[k])]
            moves.append((s, "live", AFTER[at], INSERT * inserted + RETYPE, "I" * inserted + "R", said, NAMES[AFTER[at]]))
    listed = ", ".join(f"({a}, '{k}', {to}, {cost}, '{letters}', '{said}', '{role}')" for a, k, to, cost, letters, said, role in moves)
    pairs = "'su', 'ua', 'au'"
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE h <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t FROM d),
f AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
m AS (SELECT * FROM (VALUES {listed}) AS m(state, kind, into_state, cost, letters, said, new_role)),
g AS (SELECT conv_id, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ({pairs})) AS illegal FROM f GROUP BY conv_id),
v AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM conversations
  UNION ALL
  SELECT conv_id, i, state, min(cost), arg_min(audit, (cost, audit)), arg_min(said, (cost, audit)) FROM (
    SELECT v.conv_id, f.i, m.into_state AS state, v.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.letters <> 'D' THEN {CUT_OFF} ELSE 0 END AS cost, v.audit || m.letters AS audit,
      list_concat(v.said, list_filter([m.said, CASE WHEN m.letters = 'D' THEN '' WHEN m.new_role <> '' THEN m.new_role || ':' || f.text ELSE f.role || ':' || f.text END], lambda x: x <> '')) AS said
    FROM v JOIN f ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = v.i + 1
    JOIN m ON m.state = v.state AND (m.kind = 'any' OR f.fault NOT IN ('blank', 'duplicate') AND m.kind IN ('live', left(f.role, 1)))
  ) GROUP BY conv_id, i, state),
e AS (SELECT conv_id, cost + {INSERT} * len(z) AS cost, audit || z AS audit, list_concat(said, list_slice(['user:', 'assistant:'], 3 - len(z), 2)) AS said FROM (
    SELECT v.*, ['', 'II', 'I', ''][state + 1] AS z FROM v LEFT JOIN g ON v.conv_id IS NOT DISTINCT FROM g.conv_id WHERE v.i = coalesce(g.n, 0))),
b AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(said, (cost, audit)) AS said FROM e GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM b LEFT JOIN g ON b.conv_id IS NOT DISTINCT FROM g.conv_id
"""
