"""Conversation structure repair (operator 11).

Method: weighted CYK parsing of intervals. The wanted role sequences,
``(s?(ua)+)?`` by initials, have the four states ``NEXT``; a nonterminal is a
pair of states and derives what leads from one to the other, so the grammar in
Chomsky normal form has the rules ``(p, q) -> (p, r) (r, q)`` and, for a single
row, its edits: keep, change the role, delete. Insertions are the closure
around a row: they derive no row at all and are folded into its cell. A cell of
a span holds the cheapest ``(cost, audit)`` of every nonterminal, equal costs
by the least audit. Audits of one span and cost never are prefixes of one
another (what follows would be insertions, which cost), so the least parts make
the least whole. Joining cells is associative, so every split of a span gives
the same cell, and one suffices: spans of one, two, four, ... rows are combined
bottom-up by length.

A conversation of any length is spread: its rows are numbered over range
partitions, ``BLOCK`` of them make a span's cell in one task, and ``FAN`` cells
of neighbouring spans the next longer one, until one cell is left. Equal rows
of a turn are one row with a number of copies, and a text that a conversation
repeats in many turns is dealt out by part of the row number, so no repetition
is a hot key. Only hashes and flags of rows travel so far; texts join their
edits at the end.

Defined cases: null roles and texts are one blank (so such a row fits no place
and a null text is blank); a null conversation id is a conversation; null turns
come first; rows of an equal turn are ordered by role, then by the SHA-256 of
role and text; a role other than s..., u..., a... can't be kept; repeated rows
are duplicates; texts of any length are read whole; an empty table gives empty
results; only the named input columns are read, so further columns of any name
do no harm.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdelta.operators.tokens import rank_within
from corpusdelta.session import cut

#: States of ``(s?(ua)+)?`` by role initials; 0 begins, 0 and 3 end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
#: Costs of the edits, and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Neighbours that are in order.
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
#: Rows of a first cell, and cells that are joined at once.
BLOCK = FAN = 64
#: Parts by which rows of equal role and text are dealt out.
PARTS = 64
#: What separates no words.
SPACE = r"\x20\x09-\x0D"

Cell = dict[tuple[int, int], tuple[int, str]]
_CELL = "first string, last string, illegal long, cell array<struct<p:int,q:int,cost:long,audit:string>>"


def _closure() -> dict[int, dict[int, int]]:
    """For each state, the states that insertions reach and how many it takes."""
    out = {}
    for p in range(4):
        reached, rim = {p: 0}, [p]
        while rim:
            at = rim.pop(0)
            for role in "ua":
                q = NEXT.get((at, role))
                if q is not None and q not in reached:
                    reached[q] = reached[at] + 1
                    rim.append(q)
        out[p] = reached
    return out


INSERTED = _closure()


def _least(cell: Cell, pair: tuple[int, int], cost: int, audit: str) -> None:
    if pair not in cell or (cost, audit) < cell[pair]:
        cell[pair] = cost, audit


def join(left: Cell, right: Cell) -> Cell:
    """``(p, q) -> (p, r) (r, q)``, the cheapest for each."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (more, rest) in right.items():
            if r == r2:
                _least(out, (p, q), cost + more, audit + rest)
    return out


@lru_cache(1 << 12)
def leaf(status: str, initial: str, copies: int) -> Cell:
    """Cell of a row (status d: must go, t: truncated, k: neither) and of its
    further copies, which must go."""
    after = {p: [("D", p, DELETE)] for p in range(4)}
    if status != "d":
        extra = TRUNCATED if status == "t" else 0
        for (p, role), q in NEXT.items():
            if role == initial:
                after[p].append(("K", q, extra))
            if role in ROLES:
                after[p].append(("R", q, RENAME + extra))
    out: Cell = {}
    for p in range(4):
        for p1, before in INSERTED[p].items():
            for letter, p2, cost in after[p1]:
                for q, behind in INSERTED[p2].items():
                    _least(out, (p, q), cost + INSERT * (before + behind), "I" * before + letter + "I" * behind)
    if copies > 1:
        gone = {(p, q): (DELETE * (copies - 1) + INSERT * n, "D" * (copies - 1) + "I" * n)
                for p in range(4) for q, n in INSERTED[p].items()}
        out = join(out, gone)
    return out


@lru_cache(1 << 13)
def span(rows: tuple[tuple[str, str, int], ...]) -> Cell:
    """Cell of a span of ``(status, initial, copies)`` rows."""
    if len(rows) == 1:
        return leaf(*rows[0])
    half = 1 << (len(rows) - 1).bit_length() - 1
    return join(span(rows[:half]), span(rows[half:]))


def cells(parts: list[Cell]) -> Cell:
    """Cell of neighbouring spans, bottom-up by length."""
    while len(parts) > 1:
        parts = [join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The four columns with faults put in, by ``crc32("conv:turn") % 20``
    (nulls: one blank): 0 drops the row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 sets its role to user."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col))) % 20
    text = blank(text_col)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return (rows.where(kind != 0)
            .select(F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col),
                    F.when(kind == 4, "user").otherwise(blank(role_col)).alias(role_col), text.alias(text_col),
                    F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
            .drop("_copy"))


class Repair:
    """The cheapest repair of every conversation of ``rows``.

    ``report()``: one row per conversation, with its faults, gaps in its turns,
    neighbours out of order, and the cost and audit of the repair.
    ``repaired()``: the rows of the repaired conversations.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text"):
        blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
        rows = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                           blank(role_col).alias("role"), blank(text_col).alias("text"))
        self.names = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
        self.kind = rows.schema["conv"].dataType.simpleString()
        self.rows = rows.withColumn("hash", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
        self.numbered = self._numbered()
        self.blocks = cut(self._blocks())
        self.parsed = cut(self._parsed())
        self._edited: DataFrame | None = None

    def _numbered(self) -> DataFrame:
        """Distinct rows of a turn, without texts, numbered from 0 within their
        conversation."""
        initial = F.substring("role", 1, 1)
        ended = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
        status = F.when(~F.col("text").rlike(f"[^{SPACE}]"), "b").when(~ended, "t").otherwise("k")
        distinct = (self.rows.select("conv", "turn", "role", "hash", status.alias("status"),
                                     F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"))
                    .groupBy("conv", "turn", "role", "hash", "status", "initial").agg(F.count(F.lit(1)).alias("copies")))
        ranked = rank_within(distinct, ["conv"], ["turn", "role", "hash"], "n")
        return ranked.select("conv", "turn", "hash", "status", "initial", "copies", (F.col("n") - 1).alias("n"))

    def _blocks(self) -> DataFrame:
        """``BLOCK`` rows each: what must go is known here. The first row of a
        role and text is found over parts of the rows that share them."""
        part = F.pmod("n", F.lit(PARTS))
        some = self.numbered.groupBy("conv", "hash", part.alias("part")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        repeated = (some.groupBy("conv", "hash").agg(F.min("n").alias("_first"), F.sum("rows").alias("rows"), F.collect_list("part").alias("parts"))
                    .where("rows > 1").select(F.col("conv").alias("_conv"), F.col("hash").alias("_hash"), "_first", F.explode("parts").alias("_part")))
        rows = self.numbered.withColumn("part", part)
        rows = rows.join(repeated, rows["conv"].eqNullSafe(repeated["_conv"]) & (rows["hash"] == repeated["_hash"])
                         & (rows["part"] == repeated["_part"]), "left")
        later, copies = F.coalesce(F.col("n") > F.col("_first"), F.lit(False)), F.col("copies")
        blank = F.col("status") == "b"
        row = F.struct("n", "turn", "hash", F.when(blank | later, "d").otherwise(F.col("status")).alias("status"), "initial", "copies")
        return (rows.groupBy("conv", F.floor(F.col("n") / BLOCK).alias("block"))
                .agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum("copies").alias("size"),
                     F.sum(F.when(blank, copies).otherwise(0)).alias("blank"),
                     F.sum(F.when(blank, 0).when(later, copies).otherwise(copies - 1)).alias("duplicate"),
                     F.sum(F.when((F.col("status") == "t") & ~later, 1).otherwise(0)).alias("truncated")))

    def _parsed(self) -> DataFrame:
        """One row per conversation: its cell, neighbours out of order, and the
        blocks with their sizes."""
        kind = self.kind

        def first_cells(batches):
            for b in batches:
                out = []
                for rows in b.column(2).to_pylist():
                    codes = tuple((r["status"], r["initial"], r["copies"]) for r in rows)
                    initials = [c[1] for c in codes]
                    illegal = sum(c[2] - 1 for c in codes) + sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
                    out.append((initials[0], initials[-1], illegal, span(codes)))
                yield _arrow(b, out)

        def longer_cells(batches):
            for b in batches:
                out = []
                for parts in b.column(2).to_pylist():
                    illegal = sum(x["illegal"] for x in parts) + sum(x["last"] + y["first"] not in LEGAL for x, y in zip(parts, parts[1:]))
                    cell = cells([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in x["cell"]} for x in parts])
                    out.append((parts[0]["first"], parts[-1]["last"], illegal, cell))
                yield _arrow(b, out)

        most = self.blocks.agg(F.max("block")).first()[0] or 0
        schema = f"conv {kind}, block long, {_CELL}"
        spans = self.blocks.select("conv", "block", "rows").mapInArrow(first_cells, schema)
        while most:
            most //= FAN
            part = F.struct("block", "first", "last", "illegal", "cell")
            spans = (spans.groupBy("conv", F.floor(F.col("block") / FAN).alias("block"))
                     .agg(F.array_sort(F.collect_list(part)).alias("parts")).mapInArrow(longer_cells, schema))
        whole = F.filter("cell", lambda c: (c.p == 0) & c.q.isin(*ENDS))
        return spans.select("conv", "illegal", F.array_min(F.transform(whole, lambda c: F.struct(c.cost, c.audit))).alias("best"))

    def report(self) -> DataFrame:
        """``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
        ``cost`` and ``audit`` of every conversation that has a row."""
        faults = self.blocks.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        turns = self.numbered.groupBy("conv").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("n"))
        gaps = turns.select(F.col("conv").alias("_g"), F.coalesce(F.expr("high - low + 1 - n"), F.lit(0)).cast("long").alias("gaps"))
        best = self.parsed.select(F.col("conv").alias("_b"), "illegal", "best.cost", "best.audit")
        joined = (faults.join(gaps, faults["conv"].eqNullSafe(gaps["_g"])).join(best, faults["conv"].eqNullSafe(best["_b"])))
        return joined.select(F.col("conv").alias(self.names["conv"]), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _edits(self) -> DataFrame:
        """The rows that stay or come in, without texts: ``pos`` in the repaired
        conversation, ``edit``, the new ``role`` (null: its own) and the key of
        the row that it was."""
        kind = self.kind

        def per_block(batches):
            """The part of the audit that belongs to each block."""
            for b in batches:
                for conv, best, blocks in zip(*(b.column(i).to_pylist() for i in range(3))):
                    audit, at, kept, out = best["audit"], 0, 0, []
                    odd = (len(audit) - audit.count("D")) % 2
                    for i, x in enumerate(blocks):
                        end = at
                        if i + 1 == len(blocks):
                            end = len(audit)
                        else:
                            for _ in range(x["size"]):
                                while audit[end] == "I":
                                    end += 1
                                end += 1
                        out.append((x["block"], audit[at:end], kept, odd))
                        kept, at = kept + end - at - audit.count("D", at, end), end
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([conv] * len(out), b.column(0).type), *(pa.array(c, t) for c, t in zip(
                            zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int32())))],
                        names=["conv", "block", "edits", "kept", "odd"])

        def per_row(batches):
            for b in batches:
                out = []
                for conv, rows, edits, pos, odd in zip(*(b.column(i).to_pylist() for i in range(5))):
                    left, row = 0, iter(rows)
                    for letter in edits:
                        if letter != "I":
                            if not left:
                                now = next(row)
                                left = now["copies"]
                            left -= 1
                            if letter == "D":
                                continue
                        role = None if letter == "K" else ROLES["ua"[(pos - odd) % 2]]
                        turn, key = (None, None) if letter == "I" else (now["turn"], now["hash"])
                        out.append((conv, pos, letter, role, turn, key))
                        pos += 1
                columns = list(zip(*out)) or [()] * 6
                types = (b.column(0).type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 names=["conv", "pos", "edit", "role", "turn", "hash"])

        sizes = self.blocks.groupBy(F.col("conv").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("block", "size"))).alias("sizes"))
        whole = self.parsed.join(sizes, self.parsed["conv"].eqNullSafe(sizes["_c"])).select("conv", "best", "sizes")
        parts = whole.mapInArrow(per_block, f"conv {kind}, block long, edits string, kept long, odd int")
        parts = parts.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), "edits", "kept", "odd")
        both = self.blocks.join(parts, self.blocks["conv"].eqNullSafe(parts["_c"]) & (self.blocks["block"] == parts["_b"]))
        return both.select("conv", "rows", "edits", "kept", "odd").mapInArrow(
            per_row, f"conv {kind}, pos long, edit string, role string, turn long, hash binary")

    def repaired(self) -> DataFrame:
        """One row per row of the repaired conversations: the conversation,
        ``pos`` (from 0), ``edit`` (K, R or I), turn (null: inserted), role and
        text."""
        if self._edited is None:
            self._edited = cut(self._edits())
        new, old = self._edited.where("edit = 'I'"), self._edited.where("edit <> 'I'")
        texts = (self.rows.groupBy(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("hash").alias("_h"))
                 .agg(F.first("role").alias("_role"), F.first("text").alias("text")))
        old = old.join(texts, old["conv"].eqNullSafe(texts["_c"]) & old["turn"].eqNullSafe(texts["_t"]) & (old["hash"] == texts["_h"]))
        columns = [F.col("conv").alias(self.names["conv"]), "pos", "edit", F.col("turn").alias(self.names["turn"])]
        return (old.select(*columns, F.coalesce("role", "_role").alias(self.names["role"]), F.col("text").alias(self.names["text"]))
                .unionByName(new.select(*columns, F.col("role").alias(self.names["role"]), F.lit("").alias(self.names["text"]))))


def _arrow(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    """Conversation and block of ``b`` with the cells of ``out``."""
    fields = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    listed = [[{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in o[3].items()] for o in out]
    return pa.RecordBatch.from_arrays(
        [b.column(0), b.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()),
         pa.array([o[2] for o in out], pa.int64()), pa.array(listed, pa.list_(fields))],
        names=["conv", "block", "first", "last", "illegal", "cell"])


def digests(repaired: DataFrame, by: str, order: str, line: Column, name: str) -> DataFrame:
    """SHA-256 of every group's lines, joined by line ends in ``order``. A hash
    of a sequence is itself sequential: the lines of a group stream through one
    task in order, of which only the state of the hash is kept."""
    lines = repaired.select(F.col(by).alias("by"), F.col(order).alias("pos"), line.alias("line"))
    kind = lines.schema["by"].dataType.simpleString()

    def run(batches):
        state = group = arrow = None
        for b in batches:
            arrow, out = b.column(0).type, []
            for key, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if state is None or key != group:
                    if state is not None:
                        out.append((group, state.hexdigest()))
                    state, group = hashlib.sha256(text.encode()), key
                else:
                    state.update(b"\n" + text.encode())
            yield from _pairs(out, arrow, by, name)
        if state is not None:
            yield from _pairs([(group, state.hexdigest())], arrow, by, name)

    return lines.repartition("by").sortWithinPartitions("by", "pos").mapInArrow(run, f"`{by}` {kind}, `{name}` string")


def _pairs(rows: list[tuple], kind: pa.DataType, *names: str):
    if rows:
        keys, values = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(values, pa.string())], names=list(names))


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """Damage ``conversations``, repair them, and report on every conversation
    of the table, with the digest of its repaired rows."""
    repair = Repair(damage(rows))
    report = repair.report().withColumnRenamed("conv_id", "_r")
    sums = digests(repair.repaired(), "conv_id", "pos", F.concat("role", F.lit(":"), "text"), "repaired_sha256").withColumnRenamed("conv_id", "_s")
    every = rows.select("conv_id").distinct()
    out = (every.join(report, every["conv_id"].eqNullSafe(report["_r"]), "left")
           .join(sums, every["conv_id"].eqNullSafe(sums["_s"]), "left"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
