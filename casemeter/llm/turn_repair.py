"""Repair of conversation structure as a lightest derivation.

Rows of a conversation are kept, given another role, deleted, or preceded by inserted rows until their role initials read ``(s?(ua)+)?``.
The search is a weighted deduction system, solved by Knuth's generalisation of the shortest path:

* axioms ``edit(i, r)``: row i becomes a row with initial r, or none, at the cost of its letter;
* the axiom ``rest(n, q)`` for a state q in which a conversation may end;
* ``edit(i, r)`` and ``rest(i + 1, q')`` give ``rest(i, q)`` where r leads from q to q'; ``rest(i, q')`` gives ``rest(i, q)`` by an insertion;
* the goal is ``rest(0, start)``.

A derivation is worth (cost, audit): edits are put in front, so audits keep their order under every deduction. The agenda pops items by
(cost, rows behind them): each deduction adds to the cost or to the rows, so it is superior, and an item that is popped is final. Where an
item has several derivations of its cost, the least audit is chosen when it is popped; by then all of them are known.

A conversation is read from its last row in pieces of ``PIECE`` rows. The final items at the border of a piece are the axioms of the one
before, so a task holds one piece and four audits, whatever the length. Repaired texts are hashed in a second, streaming pass.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a conversation that one agenda takes.
PIECE = 4096
BLANK, DUPLICATE, TRUNCATED = "b", "d", "t"
_REROLE, _DELETE, _INSERT, _CUT = 3, 4, 3, 3
#: States: nothing yet, after the system row, after a user's, after an assistant's; and where each initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
_STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})


def _edits(row: str) -> list[tuple[str, str, int]]:
    """Letter, initial afterwards and cost of what may become of a row, given its initial and its fault."""
    initial, fault = row[0], row[1]
    gone = [("D", "", _DELETE)]
    if fault in (BLANK, DUPLICATE):
        return gone
    more = _CUT if fault == TRUNCATED else 0
    kept = [("K", initial, more)] if initial in "sua" else []
    return gone + kept + [("R", r, _REROLE + more) for r in "ua"]


#: (cost, rank of the audit) of the items behind the last row: nothing, one insertion or two are missing to an end.
_ENDS = ((0, 0), (2 * _INSERT, 2), (_INSERT, 1), (0, 0))
_TAILS = ("", "II", "I", "")


class _Agenda:
    """Final items over the rows of one piece; ``ends`` has (cost, rank of the audit) of the four final items behind it."""

    def __init__(self, rows: str, ends: tuple[tuple[int, int], ...]):
        self.rows, self.ends, self.last = rows, ends, len(rows) // 2
        self.cost: dict[tuple[int, int], int] = {}
        self.way: dict[tuple[int, int], tuple[str, int, int]] = {}
        self._order: dict[tuple[int, int, int], int] = {}

    def compare(self, i: int, p: int, q: int) -> int:
        """-1, 0, 1: how the audits of the final items (i, p) and (i, q) compare. Both lead to items of one place, so pairs are kept."""
        trail = []
        while True:
            if p == q:
                out = 0
            elif i == self.last:
                a, b = self.ends[p][1], self.ends[q][1]
                out = (a > b) - (a < b)
            elif (i, p, q) in self._order:
                out = self._order[i, p, q]
            elif (x := self.way[i, p])[0] != (y := self.way[i, q])[0]:
                out = -1 if x[0] < y[0] else 1
            else:
                trail.append((i, p, q))
                i, p, q = x[1], x[2], y[2]
                continue
            break
        for at, p, q in trail:
            self._order[at, p, q], self._order[at, q, p] = out, -out
        return out

    def solve(self, goals: tuple[int, ...]) -> None:
        """Pop items until the goals before the first row are final."""
        heap: list[tuple[int, int, int, str, int, int]] = [(cost, 0, q, "", 0, 0) for q, (cost, _) in enumerate(self.ends)]
        heapq.heapify(heap)
        left = set(goals)
        while left:
            cost, behind, q, *best = heapq.heappop(heap)
            i = self.last - behind
            if (i, q) in self.cost:
                continue
            while heap and heap[0][:3] == (cost, behind, q):
                way = heapq.heappop(heap)[3:]
                if way[0] < best[0] or way[0] == best[0] and self.compare(way[1], way[2], best[2]) < 0:
                    best = way
            self.cost[i, q] = cost
            if behind:
                self.way[i, q] = tuple(best)
                # Insertions behind the piece are in its ends already.
                for before, steps in enumerate(_STEPS):
                    if any(steps.get(r) == q for r in "ua"):
                        heapq.heappush(heap, (cost + _INSERT, behind, before, "I", i, q))
            if i:
                for letter, r, price in _edits(self.rows[2 * i - 2 : 2 * i]):
                    for before, steps in enumerate(_STEPS):
                        if (steps.get(r) if r else before) == q:
                            heapq.heappush(heap, (cost + price, behind + 1, before, letter, i, q))
            else:
                left.discard(q)

    def audit(self, q: int) -> tuple[str, int]:
        """Letters of the derivation of (0, q), and the state of the item behind the piece that it ends in."""
        out, i = [], 0
        while i < self.last:
            letter, i, q = self.way[i, q]
            out.append(letter)
        return "".join(out), q


def _piece(rows: str, ends: tuple[tuple[int, int], ...], first: bool) -> tuple[tuple[tuple[int, int], ...], tuple[tuple[str, int], ...]]:
    """(cost, rank) of the four items before ``rows``, and their letters with the items behind; of the goal alone if ``first``."""
    agenda = _Agenda(rows, ends)
    goals = (START,) if first else (START, SYSTEM, USER, ASSISTANT)
    agenda.solve(goals)
    ranked = sorted(goals, key=cmp_to_key(lambda p, q: agenda.compare(0, p, q)))
    rank = {ranked[0]: 0}
    for p, q in zip(ranked, ranked[1:]):
        rank[q] = rank[p] + (agenda.compare(0, p, q) < 0)
    return tuple((agenda.cost[0, q], rank[q]) for q in goals), tuple(agenda.audit(q) for q in goals)


_short_piece = lru_cache(1 << 15)(_piece)


class Repair:
    """The repair of one conversation, whose rows come from the last to the first as initial and fault."""

    def __init__(self) -> None:
        self.ends, self.base = _ENDS, 0
        self.pieces: list[tuple[tuple[str, int], ...]] = []
        self.rows: list[str] = []

    def _close(self, first: bool) -> None:
        rows = "".join(reversed(self.rows))
        items, ways = (_short_piece if len(self.rows) <= 32 else _piece)(rows, self.ends, first)
        self.pieces.append(ways)
        least = min(cost for cost, _ in items)
        self.base += least
        self.ends, self.rows = tuple((cost - least, rank) for cost, rank in items), []

    def add(self, initial: str, fault: str) -> None:
        if len(self.rows) == PIECE:
            self._close(False)
        self.rows.append(initial + fault)

    def result(self) -> tuple[int, str]:
        """Cost and audit of the lightest derivation."""
        if not self.rows and not self.pieces:
            return 0, ""
        self._close(True)
        out, q = [], 0
        for ways in reversed(self.pieces):
            letters, q = ways[q]
            out.append(letters)
        return self.base, "".join([*out, _TAILS[q]])


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, gone: the rows after damage; a dropped row stays as a mark of its conversation, with ``gone`` set."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named(conv_col), F.lit(":"), named(turn_col)).cast("binary")) % 20
    role, text = named(role_col), named(text_col)
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _fault(text: Column) -> Column:
    """What is wrong with a text by itself."""
    ends = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~ends, TRUNCATED).otherwise("-")


def _solved(names: list[str]):
    """One row for each conversation from its rows' marks, which come from the last to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, repair, counts, turns, after = none, Repair(), {}, [None, None, 0], None
        kind = pa.int64()

        def closed() -> tuple:
            high, low, distinct = turns
            gaps = 0 if high is None else high - low + 1 - distinct
            return (conv, gaps, *(counts.get(c, 0) for c in (BLANK, DUPLICATE, TRUNCATED, "illegal")), *repair.result())

        def told(out: list[tuple]) -> pa.RecordBatch:
            types = [kind] + [pa.int64()] * 6 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            out = []
            kind = batch.column("conv").type
            for c, turn, initial, fault, gone in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "initial", "fault", "gone"))):
                if c != conv:
                    if conv is not none:
                        out.append(closed())
                    conv, repair, counts, turns, after = c, Repair(), {}, [None, None, 0], None
                if gone:
                    continue
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                counts[fault] = counts.get(fault, 0) + 1
                if after is not None and initial + after not in ("su", "ua", "au"):
                    counts["illegal"] = counts.get("illegal", 0) + 1
                after = initial
                repair.add(initial, fault)
            if out:
                yield told(out)
        if conv is not none:
            yield told([closed()])

    return run


def _hashed(names: list[str]):
    """Follow each conversation's edits along its rows and hash what they make; the solution comes before the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solution, audit, at, state, parts, digest = None, "", 0, START, 0, hashlib.sha256()

        def put(role: bytes, text: bytes) -> None:
            nonlocal parts
            digest.update((b"\n" if parts else b"") + role + b":")
            digest.update(text)
            parts += 1

        def insert() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                put(b"assistant" if state == USER else b"user", b"")
                at, state = at + 1, ASSISTANT if state == USER else USER

        def closed() -> pa.RecordBatch:
            insert()
            more = {"repaired_rows": pa.array([parts], pa.int64()), "repaired_sha256": pa.array([digest.hexdigest()])}
            return pa.RecordBatch.from_arrays([more[n] if n in more else solution.column(n) for n in names], names=names)

        done: list[pa.RecordBatch] = []
        for batch in batches:
            marks, roles, texts = (batch.column(n).to_pylist() for n in ("n", "role", "text"))
            for k, (mark, role, text) in enumerate(zip(marks, roles, texts)):
                if mark == 0:
                    if solution is not None:
                        done.append(closed())
                    # A copy of the row alone, so that its batch can go.
                    solution = batch.slice(k, 1).take(pa.array([0]))
                    audit, at, state, parts, digest = solution.column("audit")[0].as_py(), 0, START, 0, hashlib.sha256()
                    continue
                insert()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                if letter == "R":
                    role = b"assistant" if state == USER else b"user"
                state = _STEPS[state][chr(role[0])]
                put(role, text)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if solution is not None:
            yield closed()

    return run


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True) -> DataFrame:
    """One row for each conversation of ``rows``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_rows, repaired_sha256.

    ``damage`` applies :func:`damaged` first. Null roles and texts are one space; rows without a conversation are one conversation of
    their own; rows without a turn come first. Rows of the same turn are ordered by role, then by the MD5 of their text. Rows that repeat
    are duplicates of each other. A role whose initial is none of s, u, a can be deleted or renamed, not kept. An empty table gives no rows;
    columns other than the four are not read.
    """
    if damage:
        rows = damaged(rows, conv_col, turn_col, role_col, text_col)
    else:
        named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), named(role_col).alias("role"), named(text_col).alias("text"), F.lit(False).alias("gone"))
    rows = rows.withColumn("turn", F.col("turn").cast("long")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    earlier = Window.partitionBy("conv", "role", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())
    start = F.substring("role", 1, 1)
    # Where rows are equal in all that orders them, which of them is numbered first makes no difference.
    marks = rows.select("conv", "turn", "role", "digest", "gone", _fault(F.col("text")).alias("alone")).withColumn("n", F.row_number().over(earlier))
    fault = F.when((F.col("n") > 1) & (F.col("alone") != BLANK), DUPLICATE).otherwise(F.col("alone"))
    marks = marks.withColumn("fault", fault).withColumn("initial", F.when(start.isin("s", "u", "a"), start).otherwise("x"))
    back = [F.col("conv").asc_nulls_first(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc(), F.col("n").desc()]
    conv = rows.schema["conv"].dataType.simpleString()
    solved = marks.repartition("conv").sortWithinPartitions(*back).select("conv", "turn", "initial", "fault", "gone")
    columns = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    solved = solved.mapInArrow(_solved(columns), f"conv {conv}, " + ", ".join(f"{c} long" for c in columns[1:-1]) + ", audit string")
    solved = solved.withColumns({"n": F.lit(0), "turn": F.lit(None).cast("long"), "digest": F.lit(""), "role": F.lit(None).cast("binary"), "text": F.lit(None).cast("binary")})
    kept = rows.where(~F.col("gone")).withColumns({"n": F.lit(1), "role": F.col("role").cast("binary"), "text": F.col("text").cast("binary")}).drop("gone")
    ahead = [F.col("conv").asc_nulls_first(), F.col("n"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    out = [*columns, "repaired_rows", "repaired_sha256"]
    both = solved.unionByName(kept, allowMissingColumns=True).repartition("conv").sortWithinPartitions(*ahead).drop("turn", "digest")
    both = both.mapInArrow(_hashed(out), f"conv {conv}, " + ", ".join(f"{c} long" for c in columns[1:-1]) + ", audit string, repaired_rows long, repaired_sha256 string")
    return both.withColumnRenamed("conv", conv_col)
