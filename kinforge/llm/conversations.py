"""Conversation structure repair: survivor-coalescence Viterbi over the cheapest edits.

A repaired conversation's roles read ``(s?(ua)+)?`` by their initials. Rows come in order of their turns;
each is kept, gets another role or goes, and empty rows may be put in anywhere. The Viterbi search has four
states (nothing yet, a system row, after user, after assistant) and holds the best way to each: the least
cost, of equal costs the least string of edits. The ways form a tree of back pointers. Its nodes know how
many ways go on from them, a node that one way alone goes through is one with what follows it, and as soon
as all ways that are left share a first stretch, the edits of that stretch are final: they are given out
and forgotten. Ties compare the whole unresolved stretches. A way that another one can catch up with at
less than their difference in cost is dropped, so the ways mostly soon have a common past. Where they do
not (of users alone every second one gets another role, and the number of rows decides which), a byte a
row and way is held.

The search reads initials, faults and hashes only. Its edits then go ahead of the texts of their conversation
in a second pass, which applies them row by row and holds no row. The rows of a conversation pass through
one task in order, since the hash of its whole repaired text can be made in no other way; they are never
held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import Batches, batch, mapped

KEEP, REROLE, DELETE, INSERT = b"K", b"R", b"D", b"I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: What has to be put in at the end of a way in each state.
CLOSING = (b"", b"II", b"I", b"")
#: BEHIND[a][b]: the most that a way in state b pays to go on as one in state a would.
BEHIND = ((0, 10, 7, 2), (0, 0, 5, 0), (5, 5, 0, 5), (0, 10, 5, 0))
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}


def _after(state: int) -> int:
    """The state after a user or assistant row, whichever may follow."""
    return ASSISTANT if state == USER else USER


def _moves(initial: str, fault: int) -> tuple[tuple[int, int, int, bytes], ...]:
    """(state before, state after, cost, edits) of a row: the cheapest, of equal costs the least edits."""
    best: dict[tuple[int, int], tuple[int, bytes]] = {}
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for before in range(4):
        state = before
        for inserts in range(3):
            head, cost = INSERT * inserts, INSERT_COST * inserts
            ways = [(state, cost + DELETE_COST, head + DELETE)]
            if fault not in (BLANK, DUPLICATE):
                ways.append((_after(state), cost + REROLE_COST + extra, head + REROLE))
                if initial == "s" and state == START:
                    ways.append((SYSTEM, cost + extra, head + KEEP))
                elif initial == ("a" if state == USER else "u"):
                    ways.append((_after(state), cost + extra, head + KEEP))
            for to, price, edits in ways:
                best[before, to] = min(best.get((before, to), (price, edits)), (price, edits))
            state = _after(state)
    return tuple((a, b, *best[a, b]) for a, b in sorted(best))


MOVES = {(initial, fault): _moves(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}


class Way:
    """A node of the tree of back pointers: the edits since the node before, and the ways on."""

    __slots__ = ("before", "edits", "on")

    def __init__(self, before: Way | None, edits: bytes):
        self.before, self.edits, self.on = before, bytearray(edits), []


class Survivors:
    """The best way to each state, and the edits that are final."""

    def __init__(self):
        self.root = Way(None, b"")
        self.ways: dict[int, tuple[int, Way]] = {START: (0, self.root)}

    def row(self, initial: str, fault: int) -> bytes:
        """Take in a row; the edits that are final with it."""
        found: dict[int, tuple[int, int, bytes]] = {}
        for before, to, price, edits in MOVES[initial if initial in ("s", "u", "a") else "", fault]:
            if before in self.ways:
                cost = self.ways[before][0] + price
                held = found.get(to)
                if held is None or cost < held[0] or (cost == held[0] and self._less(before, edits, held[1], held[2])):
                    found[to] = (cost, before, edits)
        left = {to: f for to, f in found.items() if all(f[0] <= other[0] + BEHIND[to][by] for by, other in found.items())}
        users: dict[int, list[int]] = {}
        for to, (_, before, _) in left.items():
            users.setdefault(before, []).append(to)
        ways, ended = {}, []
        for before, (_, way) in self.ways.items():
            to_states = users.get(before, ())
            if not to_states:
                ended.append(way)
            elif len(to_states) == 1 and way is not self.root:
                way.edits += left[to_states[0]][2]
                ways[to_states[0]] = (left[to_states[0]][0], way)
            else:
                for to in to_states:
                    node = Way(way, left[to][2])
                    way.on.append(node)
                    ways[to] = (left[to][0], node)
        self.ways = ways
        for way in [self._cut(way) for way in ended]:
            if way is not self.root and len(way.on) == 1:
                self._join(way)
        return self._final()

    def end(self) -> tuple[int, bytes]:
        """(cost, the edits that are left) once all rows are in."""
        closed = {s: (cost + INSERT_COST * len(CLOSING[s]), s) for s, (cost, _) in self.ways.items()}
        best = None
        for s in sorted(closed):
            if best is None or closed[s][0] < closed[best][0] or (closed[s][0] == closed[best][0] and self._less(s, CLOSING[s], best, CLOSING[best])):
                best = s
        return closed[best][0], self._open(self.ways[best][1]) + CLOSING[best]

    def _path(self, way: Way) -> list[Way]:
        out = []
        while way is not self.root:
            out.append(way)
            way = way.before
        return out[::-1]

    def _open(self, way: Way) -> bytes:
        """The unresolved edits of a way."""
        return b"".join(w.edits for w in self._path(way))

    def _less(self, a: int, edits_a: bytes, b: int, edits_b: bytes) -> bool:
        if a == b:
            return edits_a < edits_b
        path_a, path_b = self._path(self.ways[a][1]), self._path(self.ways[b][1])
        fork = next((i for i, (x, y) in enumerate(zip(path_a, path_b, strict=False)) if x is not y), None)
        if fork is not None:
            x, y = path_a[fork].edits, path_b[fork].edits
            if not x.startswith(y) and not y.startswith(x):
                return x < y  # without a copy of what may be long
        return self._open(self.ways[a][1]) + edits_a < self._open(self.ways[b][1]) + edits_b

    def _cut(self, way: Way) -> Way:
        """Take out a way that nothing goes on from; the node that it left."""
        while way is not self.root and not way.on:
            before = way.before
            before.on.remove(way)
            way = before
        return way

    def _join(self, way: Way) -> None:
        """A node with one way on becomes one with it."""
        (only,) = way.on
        way.edits += only.edits
        way.on = only.on
        for node in way.on:
            node.before = way
        for state, (cost, held) in self.ways.items():
            if held is only:
                self.ways[state] = (cost, way)

    def _final(self) -> bytes:
        out = bytearray()
        while len(self.root.on) == 1:
            (only,) = self.root.on
            out += only.edits
            only.edits.clear()
            only.before = None
            self.root = only
        return bytes(out)


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of rows given as (initial, fault)."""
    survivors, audit = Survivors(), bytearray()
    for initial, fault in rows:
        audit += survivors.row(initial, fault)
    cost, rest = survivors.end()
    return cost, (bytes(audit) + rest).decode()


class Repair:
    """Applies a conversation's edits to its rows, one by one."""

    def __init__(self, audit: str, give: Callable[[str, str, str], None]):
        self.audit, self.at, self.state, self.give = audit, 0, START, give

    def inserts(self) -> None:
        """Put in what goes before the next row, or after the last."""
        while self.audit[self.at : self.at + 1] == "I":
            self._put(None, "", "I")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K" and self.state == START and role[:1] == "s":
            self.state = SYSTEM
            self.give(role, text, "K")
        elif edit != "D":
            self._put(role if edit == "K" else None, text, edit)

    def _put(self, role: str | None, text: str, edit: str) -> None:
        self.state = _after(self.state)
        self.give(role or ("user" if self.state == USER else "assistant"), text, edit)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows with faults put in by a checksum of ``conv_id:turn``.

    Of twenty remainders, 0 drops the row (``gone``; it stays as a mark of its conversation), 1 empties its
    text, 2 takes ``.!?`` out of it, 3 puts the row in twice, 4 makes its role user. Nulls of role and text,
    and in the checksum's key, are one space. Extra columns are not read.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")))
    spaced = [F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")]
    key = F.concat(spaced[0], F.lit(":"), spaced[1])
    case = F.pmod(F.crc32(key), F.lit(20))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    hit = c.withColumn("case", case).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("case") == 0).alias("gone"), twice.alias("copy"))
    return hit.drop("copy")


def _same() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("same")


def marked(rows: DataFrame) -> DataFrame:
    """What the search needs of the rows of ``damaged``: conv_id, turn, gone, initial, same (a hash of role and
    text), own_fault (blank, truncated or none), repeats and later (for a role and text that the conversation
    has several times: that it does, and that an earlier turn has it).

    Repetitions are counted by an aggregate that combines before it shuffles and are joined back; most rows
    find none, and a join of the few is broadcast or split by size as it runs.
    """
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""), -1, 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(last.isin(".", "!", "?"), NO_FAULT).otherwise(TRUNCATED)
    seen = rows.select("conv_id", "turn", "gone", F.substring("role", 1, 1).alias("initial"), _same(), fault.alias("own_fault"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeated = seen.where(~F.col("gone")).groupBy("conv_id", "same").agg(F.min(turn).alias("first_turn"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = repeated.select(F.col("conv_id").alias("of"), F.col("same").alias("like"), "first_turn")
    joined = seen.join(other, seen.conv_id.eqNullSafe(other.of) & (seen.same == other.like), "left")
    return joined.select(*seen.columns, F.col("first_turn").isNotNull().alias("repeats"), F.coalesce(turn > F.col("first_turn"), F.lit(False)).alias("later"))


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Conversations whole in a partition each, their rows by turn, nulls first; rows of one turn by their hash."""
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "same")


class Search:
    """The counts and edits of one conversation as its marked rows stream by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.survivors = conv_id, Survivors()
        self.faults, self.illegal, self.turns, self.audit, self.cost = [0, 0, 0, 0], 0, 0, bytearray(), 0
        self.first_turn = self.last_turn = self.initial = self.row_before = None

    def row(self, turn: int | None, initial: str, same: bytes, own_fault: int, repeats: bool, later: bool) -> None:
        again = later or (repeats and self.row_before == (turn, same))
        self.row_before = (turn, same)
        fault = DUPLICATE if again and own_fault != BLANK else own_fault
        self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.turns == 0 else self.first_turn
            self.last_turn = turn
            self.turns += 1
        self.audit += self.survivors.row(initial, fault)

    def result(self) -> tuple:
        cost, rest = self.survivors.end()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, cost, (bytes(self.audit) + rest).decode())


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_VERDICT = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in COUNTS), ("audit", pa.string())])
_VERDICT_DDL = "conv_id long, " + ", ".join(f"{n} long" for n in COUNTS) + ", audit string"


def _rows(batches: Batches, names: tuple[str, ...], rows: int = 1024) -> Iterator[tuple]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def _full(schema: pa.Schema, rows: Iterator[tuple], size: int = 1024) -> Batches:
    ready = []
    for row in rows:
        ready.append(row)
        if len(ready) == size:
            yield batch(schema, *zip(*ready, strict=True))
            ready = []
    if ready:
        yield batch(schema, *zip(*ready, strict=True))


def edits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation, for rows like those of ``damaged``.

    Edge cases as for ``report``.
    """

    def found(batches: Batches) -> Iterator[tuple]:
        search = None
        for conv_id, gone, *row in _rows(batches, ("conv_id", "gone", "turn", "initial", "same", "own_fault", "repeats", "later")):
            if search is None or conv_id != search.conv_id:
                if search is not None:
                    yield search.result()
                search = Search(conv_id)
            if not gone:
                search.row(*row)
        if search is not None:
            yield search.result()

    return mapped(in_order(marked(rows)), lambda batches: _full(_VERDICT, found(batches)), _VERDICT_DDL)


def _led(rows: DataFrame) -> DataFrame:
    """Each conversation's verdict and then its rows, in order."""
    verdicts = edits(rows).withColumn("row", F.lit(False))
    texts = rows.where(~F.col("gone")).select("conv_id", "turn", "role", "text", _same(), F.lit(True).alias("row"))
    return in_order(verdicts.unionByName(texts, allowMissingColumns=True), "row")


def report(conversations: DataFrame) -> DataFrame:
    """One row a conversation that ``conversations`` has: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256, after ``damaged``.

    A row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier),
    truncated (the last such character is none of ``.!?``). Null ids are one conversation. Turns: null comes
    first and makes no gap; rows of one turn come in the order of a hash of role and text. Repeated rows are
    duplicates. A role of another initial than s, u, a can be changed or go. No row left: zeros, an empty
    audit, the hash of an empty string; so too where every row goes. Empty table: empty result.
    """
    out = pa.schema([*_VERDICT, ("repaired_sha256", pa.string())])

    def run(batches: Batches) -> Iterator[tuple]:
        verdict, sha, repair, between = None, None, None, ""

        def give(role: str, text: str, _: str) -> None:
            nonlocal between
            sha.update(f"{between}{role}:{text}".encode())
            between = "\n"

        for is_row, role, text, *rest in _rows(batches, ("row", "role", "text", *_VERDICT.names)):
            if is_row:
                repair.row(role, text)
                continue
            if verdict is not None:
                repair.inserts()
                yield (*verdict, sha.hexdigest())
            verdict, sha, between = rest, hashlib.sha256(), ""
            repair = Repair(verdict[-1], give)
        if verdict is not None:
            repair.inserts()
            yield (*verdict, sha.hexdigest())

    return mapped(_led(damaged(conversations)), lambda batches: _full(out, run(batches)), _VERDICT_DDL + ", repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit: the repaired rows themselves, of rows like those of ``damaged``.

    ``edit`` is K for a row as it was, R for another role, I for a row put in. Rows are sent on while their
    conversation still streams. Edge cases as for ``report``.
    """
    out = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Batches) -> Iterator[tuple]:
        ready, repair, open_, place = [], None, None, 0
        for is_row, conv_id, role, text, audit in _rows(batches, ("row", "conv_id", "role", "text", "audit")):
            if is_row:
                repair.row(role, text)
            elif repair is not None:
                repair.inserts()
            for x in ready:
                yield (open_, place, *x)
                place += 1
            ready.clear()
            if not is_row:
                open_, place = conv_id, 0
                repair = Repair(audit, lambda *x: ready.append(x))
        if repair is not None:
            repair.inserts()
            yield from ((open_, place + i, *x) for i, x in enumerate(ready))

    return mapped(_led(rows), lambda batches: _full(out, run(batches)), "conv_id long, position long, role string, text string, edit string")
