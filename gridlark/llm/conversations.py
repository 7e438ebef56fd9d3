"""Operator 11: damaged conversations and their cheapest repair, by weighted CYK parsing of intervals.

The roles of a repaired conversation form ``(s?(ua)+)?``. Four places lie in such a sequence (start, after the system row,
after a user, after an assistant), and the repair grammar in Chomsky normal form has a symbol for each pair of them: X(p, q) is what
leads from p to q, with X(p, q) -> X(p, r) X(r, q), and X(p, q) -> one row that is kept, given another role or deleted. A
cell is a span of rows and holds for each symbol its least (cost, audit); insertions are closed over in cells of one row, before
and behind it. Cells are combined bottom-up by span length. As a symbol names both borders of its span, every split of a span
gives the same cell, so spans double in length and one split each is enough: a conversation of n rows takes n - 1 combinations.
Of two audits of one cost and span none begins with the other (more insertions cost more), so the least of parts
make the least whole.

Rows are sorted over all tasks by (conv_id, turn, role, text). A conversation that lies inside one task and is short is
repaired there. Others (at a task's edges, or long) are cut into blocks of bounded rows and bytes: earlier rows of the same role and
text are found by an aggregate and a join, each block makes its cell, cells meet in a tree of fan-in ``fan`` until one is left for a
conversation, and the choices go down the tree again. Only the SHA-256 of a conversation's repaired text is sequential by its
nature: its blocks stream through one hasher, in order, and none is held.

Defined results: a null conv_id is a conversation of its own and, like a null turn, one space in the damage key; null roles and
texts are one space. Rows of one turn are in order of role and text. A role that begins with none of s, u, a can't be kept, nor
can an empty one. Every conv_id of the input has its row, even where all its rows were dropped; an empty table gives none. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import release, ship, shared_dir, spark_to_arrow, table, written

#: Costs of the edits; a truncated row that stays costs ``TRUNCATED`` more.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FINAL = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
#: Rows and bytes of a block, and blocks below one node of the tree.
ROWS, BYTES, FAN = 1024, 4 << 20, 64

Cell = dict[tuple[int, int], tuple[int, str]]


def spanned(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            if (other := right.get((r, q))) is not None:
                one = (cost + other[0], audit + other[1])
                if (p, q) not in out or one < out[p, q]:
                    out[p, q] = one
    return out


def _insertions() -> Cell:
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(3):
        for (p, r), (cost, audit) in list(cell.items()):
            for role in "ua":
                if (q := STEP[role].get(r)) is not None:
                    cell[p, q] = min(cell.get((p, q), (99, "")), (cost + INSERT, audit + "I"))
    return cell


NOTHING = _insertions()
_LEAVES: dict[tuple, Cell] = {}


def leaf(initial: str, must_go: bool, truncated: bool) -> Cell:
    """The cell of one row, closed under insertions on both sides."""
    key = (initial if initial in STEP else "", must_go, truncated)
    if key not in _LEAVES:
        one: Cell = {(p, p): (DELETE, "D") for p in range(4)}
        if not must_go:
            more = TRUNCATED * truncated
            for role in "ua":
                for p, q in STEP[role].items():
                    one[p, q] = (RENAME + more, "R")
            for p, q in STEP.get(initial, {}).items():
                one[p, q] = (more, "K")
        _LEAVES[key] = spanned(spanned(NOTHING, one), NOTHING)
    return _LEAVES[key]


def parsed(cells: list[Cell]) -> Cell:
    """The cell over all of ``cells``, bottom-up by span length."""
    if not cells:
        return NOTHING
    while len(cells) > 1:
        cells = [spanned(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str, int]:
    """(cost, audit, last place) of a whole conversation."""
    return min((*cell[START, q], q) for q in FINAL if (START, q) in cell)


def repaired(audit: str, rows: Iterable[tuple[str, str]], place: int = START) -> list[str]:
    """``role:text`` of what the edits make of ``rows``."""
    rows, out = iter(rows), []
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if place == USER else "user"
        place = STEP[role[:1]][place]
        out.append(f"{role}:{text}")
    return out


@dataclass
class Tally:
    """Counts of consecutive rows in order of turn; two neighbours add up."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def __add__(self, o: Tally) -> Tally:
        if self.first is None or o.first is None:
            return self if o.first is None else o
        low, high = (o.low if self.low is None else self.low), (self.high if o.high is None else o.high)
        shared = self.high is not None and self.high == o.low
        return Tally(
            self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated, self.illegal + o.illegal + (self.last + o.first not in LEGAL), self.first, o.last, low, high, self.turns + o.turns - shared,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def row(self) -> tuple:
        return (self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns)


def judged(turn: int | None, role: str, text: str, again: bool) -> tuple[Tally, Cell]:
    """One row's tally and cell; ``again``: its role and text were there before."""
    end = text.rstrip(SPACE)
    blank = not end
    duplicate = again and not blank
    truncated = not blank and not duplicate and end[-1] not in ".!?"
    tally = Tally(int(blank), int(duplicate), int(truncated), 0, role[:1], role[:1], turn, turn, int(turn is not None))
    return tally, leaf(role[:1], blank or duplicate, truncated)


@dataclass
class _Held:
    """Rows of one conversation in a task."""

    conv: int | None = None
    rows: list[tuple] = field(default_factory=list)
    size: int = 0
    block: int = 0
    open: bool = False


_STAGE = "conv_id long,open boolean,task int,block int,place int,turn long,role string,text string,gaps long,blank long,duplicate long,truncated long,illegal long,cost long,audit string,repaired_sha256 string"
_RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def repair(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest, lines) of a whole conversation's (turn, role, text), in order."""
    seen, tally, cells = set(), Tally(), []
    for turn, role, text in rows:
        one, cell = judged(turn, role, text, (role, text) in seen)
        seen.add((role, text))
        tally += one
        cells.append(cell)
    cost, audit, _ = cheapest(parsed(cells))
    lines = repaired(audit, [r[1:] for r in rows])
    return tally.gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, _digest(lines), lines


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage; a conversation's dropped rows stay as rows with null text."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(kind == 4, "user").otherwise(text_of("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _first_pass(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Results of conversations that lie inside a task; rows of the others, cut into blocks."""
    ship(rows.sparkSession)
    target = spark_to_arrow(_STAGE)

    def run(batches):
        from pyspark import TaskContext

        release()
        task, out = TaskContext.get().partitionId(), []
        held, first = _Held(), True

        def spill() -> None:
            held.open = True
            for place, (turn, role, text) in enumerate(held.rows):
                out.append((held.conv, True, task, held.block, place, turn, role, text) + (None,) * 8)
            held.rows, held.size, held.block = [], 0, held.block + 1

        def close(at_edge: bool) -> None:
            if held.open or at_edge:
                spill()
            else:
                found = repair([r for r in held.rows if r[2] is not None])
                out.append((held.conv, False, None, None, None, None, None, None, *found[:-1]))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

        started = False
        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv != held.conv:
                    if started:
                        close(first)
                        first = False
                    held, started = _Held(conv), True
                held.rows.append((turn, role, text))
                held.size += len(text or "")
                if len(held.rows) >= block_rows or held.size >= block_bytes:
                    spill()
                    yield batch_of(out)
                    out.clear()
            if len(out) >= 4096:
                yield batch_of(out)
                out.clear()
        if started:
            close(True)
        if out:
            yield batch_of(out)

    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*key, F.substring("text", 1, 64)).sortWithinPartitions(*key, "text")
    return dealt.mapInArrow(run, _STAGE)


_NODE = "conv string,node long,blank long,duplicate long,truncated long,illegal long,first string,last string,low long,high long,turns long,p array<long>,q array<long>,cost array<long>,audit array<string>"


def _node(conv: str, node: int, tally: Tally, cell: Cell) -> tuple:
    pairs = sorted(cell)
    return (conv, node, *tally.row(), [p for p, _ in pairs], [q for _, q in pairs], [cell[k][0] for k in pairs], [cell[k][1] for k in pairs])


def _read_node(r: dict) -> tuple[Tally, Cell]:
    tally = Tally(*(r[c] for c in ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")))
    return tally, {(p, q): (c, a) for p, q, c, a in zip(r["p"], r["q"], r["cost"], r["audit"])}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    target = spark_to_arrow(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(target), target)], schema=target)


def _blocks(open_rows: DataFrame) -> DataFrame:
    """(conv, node, place, turn, role, text, again): rows that were not dropped, blocks numbered within a conversation."""
    live = open_rows.where("text is not null")
    own = live.groupBy("conv", "role", F.sha2(F.col("text"), 256).alias("sha")).agg(F.min(F.struct("task", "block", "place")).alias("first"))
    joined = live.withColumn("sha", F.sha2(F.col("text"), 256)).join(own, ["conv", "role", "sha"])
    again = (F.struct("task", "block", "place") > F.col("first")).alias("again")
    # one row for each block of bounded size, not for each row
    number = live.select("conv", "task", "block").distinct().withColumn("node", (F.row_number().over(Window.partitionBy("conv").orderBy("task", "block")) - 1).cast("long"))
    return joined.select("conv", "task", "block", "place", "turn", "role", "text", again).join(number, ["conv", "task", "block"]).drop("task", "block")


def _leaves(key, rows):
    tally, cells = Tally(), []
    for r in rows.sort_by("place").to_pylist():
        one, cell = judged(r["turn"], r["role"], r["text"], r["again"])
        tally += one
        cells.append(cell)
    return _table([_node(key[0].as_py(), key[1].as_py(), tally, parsed(cells))], _NODE)


def _combined(key, rows):
    read = [_read_node(r) for r in rows.sort_by("node").to_pylist()]
    tally = Tally()
    for one, _ in read:
        tally += one
    return _table([_node(key[0].as_py(), key[1].as_py(), tally, parsed([cell for _, cell in read]))], _NODE)


_CHOICE = "conv string,node long,from long,to long,part string"


def _chosen(key, rows):
    """Which borders each child has in its parent's choice (``from``, ``to``)."""
    read = rows.sort_by("node").to_pylist()
    cells = [_read_node(r)[1] for r in read]
    start, goal = read[0]["from"], read[0]["to"]
    best, back = {start: (0, "")}, []
    for cell in cells:
        step: dict = {}
        for (p, q), (cost, audit) in cell.items():
            if p in best and (q not in step or (best[p][0] + cost, best[p][1] + audit) < step[q][0]):
                step[q] = ((best[p][0] + cost, best[p][1] + audit), p)
        back.append({q: p for q, (_, p) in step.items()})
        best = {q: value for q, (value, _) in step.items()}
    out, to = [], goal
    for r, cell, came in zip(reversed(read), reversed(cells), reversed(back)):
        out.append((r["conv"], r["node"], came[to], to, cell[came[to], to][1]))
        to = came[to]
    return _table(out, _CHOICE)


def _lines(key, rows):
    read = rows.sort_by("place").to_pylist()
    lines = repaired(read[0]["part"], [(r["role"], r["text"]) for r in read], read[0]["from"])
    return _table([(key[0].as_py(), key[1].as_py(), "\n".join(lines), bool(lines))], "conv string,node long,lines string,any boolean")


def _hashes(pieces: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): blocks stream in order, none is held."""
    schema = "conv string,repaired_sha256 string"

    def run(batches):
        conv, sha, empty = None, None, True
        for batch in batches:
            done = []
            for own, lines, some in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if own != conv:
                    if conv is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha, empty = own, hashlib.sha256(), True
                if some:
                    sha.update(("" if empty else "\n").encode() + lines.encode("utf-8", "surrogatepass"))
                    empty = False
            if done:
                yield from _table(done, schema).to_batches()
        if conv is not None:
            yield from _table([(conv, sha.hexdigest())], schema).to_batches()

    return pieces.select("conv", "node", "lines", "any").repartition("conv").sortWithinPartitions("conv", "node").mapInArrow(run, schema)


def _long_ones(open_rows: DataFrame, folder: str, fan: int) -> DataFrame:
    """Results of the conversations in ``open_rows``, by a tree of blocks."""
    open_rows = open_rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    convs = open_rows.select("conv", "conv_id").distinct()
    blocks = written(_blocks(open_rows), "blocks", folder)
    levels = [written(blocks.groupBy("conv", "node").applyInArrow(_leaves, _NODE), "cells-0", folder)]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("conv", F.floor(F.col("node") / fan).alias("up")).applyInArrow(_combined, _NODE)
        levels.append(written(up, f"cells-{len(levels)}", folder))
    # of the two ways to end, the cheaper, then the lesser audit
    ways = F.array_compact(F.array(*(F.try_element_at(F.filter(F.arrays_zip("cost", "audit", "p", "q"), lambda z: (z["p"] == START) & (z["q"] == end)), F.lit(1)) for end in FINAL)))
    root = levels[-1].withColumn("way", F.array_min(ways))
    choice = root.select("conv", "node", F.lit(START).cast("long").alias("from"), F.col("way.q").alias("to"), F.col("way.audit").alias("part"))
    for level in reversed(levels[:-1]):
        above = choice.select("conv", F.col("node").alias("up"), "from", "to")
        down = level.withColumn("up", F.floor(F.col("node") / fan)).join(above, ["conv", "up"])
        choice = down.groupBy("conv", "up").applyInArrow(_chosen, _CHOICE)
    pieces = blocks.join(choice, ["conv", "node"]).groupBy("conv", "node").applyInArrow(_lines, "conv string,node long,lines string,any boolean")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    said = root.select("conv", zero(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit")).join(_hashes(pieces), "conv")
    counts = [zero(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return convs.join(said, "conv", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_digest([]))).alias("repaired_sha256"))


def repair_conversations(rows: DataFrame, block_rows: int = ROWS, block_bytes: int = BYTES, fan: int = FAN) -> DataFrame:
    """Per conversation of (conv_id, turn, role, text) its faults, the cheapest edits and the digest of what they make.

    Rows with null text only name their conversation.
    """
    folder = shared_dir(rows.sparkSession)
    stage = written(_first_pass(rows, block_rows, block_bytes), "stage", folder)
    return stage.where("not open").select(*_RESULT).unionByName(_long_ones(stage.where("open"), folder, fan))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
