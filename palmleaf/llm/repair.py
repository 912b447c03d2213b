"""Repair of conversation structure by weighted CYK parsing over spans of rows.

A well-formed conversation has the role initials ``(s?(ua)+)?``. The repair grammar in Chomsky normal form has a symbol
[p>q] for each pair of reader states (0 begin, 1 after s, 2 after u, 3 after a): what a span may become so that a reader goes
from p to q. [p>r] -> [p>q] [q>r] are its binary rules, and a row's edits (keep, give another role, delete) its terminal
ones. Inserted turns span nothing, so each terminal cell is closed under insertions on both sides. A cell of the chart holds,
for each symbol, the least (cost, audit); the chart is filled by span length over all splits.

Least (cost, audit) of a longer span needs only those of its parts: of two audits of one span and one cost neither is a
prefix of the other (it would hold more insertions, which cost), so the lesser part gives the lesser whole. Charts are
therefore small: BLOCK rows in a row's own order make one, and the top cells of up to BLOCK charts are the leaves of the next,
level by level, until a conversation has one cell. No conversation is gathered whole for its edits, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.workers import slices
from palmleaf.shared import materialize

#: Rows of a chart, and charts that are joined in one of the next level.
BLOCK = 16
#: Costs of edits, and of a row that ends in mid-sentence and is not deleted.
RENAME, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: White space as the contract of the query counts it.
SPACE_SQL = r"' \t\n\u000B\f\r'"
STATES = 4
#: Steps of the reader: what each role initial does in each state.
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
#: Symbols [p>q] that a span can have, and the binary rules over them.
SYMBOLS = tuple((p, q) for p in range(STATES) for q in range(STATES) if p == q or q > 1 or (p, q) == (0, 1))
RULES = tuple((SYMBOLS.index((p, r)), SYMBOLS.index((p, q)), SYMBOLS.index((q, r))) for p, q in SYMBOLS for q2, r in SYMBOLS if q2 == q and (p, r) in SYMBOLS)

Cell = tuple  # (cost, audit) or None for each of SYMBOLS


def _joined(cells: list[Cell]) -> Cell:
    """Least entries over all pairs of cells to be put side by side."""
    best: list = [None] * len(SYMBOLS)
    for left, right in cells:
        for whole, a, b in RULES:
            x, y = left[a], right[b]
            if x is not None and y is not None:
                cost = x[0] + y[0]
                now = best[whole]
                if now is None or cost < now[0] or (cost == now[0] and x[1] + y[1] < now[1]):
                    best[whole] = (cost, x[1] + y[1])
    return tuple(best)


def _insertions() -> Cell:
    """The empty span: turns that may be inserted there."""
    free = {(p, p): (0, "") for p in range(STATES)}
    one = {step: (INSERT, "I") for role in "ua" for step in STEPS[role]}
    two = {(p, r): (2 * INSERT, "II") for p, q in one for q2, r in one if q == q2}
    return tuple(min((t[s] for t in (free, one, two) if s in t), default=None) for s in SYMBOLS)


EMPTY = _insertions()


@lru_cache(maxsize=256)
def leaf(initial: str, fault: str) -> Cell:
    """Cell of one row: ``fault`` is blank, duplicate, truncated or nothing. A dropped row is an empty span."""
    edits = {(p, p): (DELETE, "D") for p in range(STATES)}
    if fault not in ("blank", "duplicate"):
        more = UNFINISHED if fault == "truncated" else 0
        for role, steps in STEPS.items():
            ways = [(more, "K")] if role == initial else []
            ways += [(RENAME + more, "R")] if role != "s" else []
            for step in steps if ways else ():
                edits[step] = min(ways + ([edits[step]] if step in edits else []))
    bare = tuple(edits.get(s) for s in SYMBOLS)
    return _joined([(_joined([(EMPTY, bare)]), EMPTY)])


def chart(leaves: list[Cell]) -> Cell:
    """Top cell of the CYK chart over the leaves, filled by span length."""
    if not leaves:
        return EMPTY
    cells = {(i, i + 1): c for i, c in enumerate(leaves)}
    for length in range(2, len(leaves) + 1):
        for i in range(len(leaves) - length + 1):
            j = i + length
            cells[i, j] = _joined([(cells[i, k], cells[k, j]) for k in range(i + 1, j)])
    return cells[0, len(leaves)]


@lru_cache(maxsize=20_000)
def _rows_chart(rows: tuple[tuple[str, str], ...]) -> Cell:
    return chart([leaf(*r) for r in rows])


def accepted(cell: Cell) -> tuple[int, str]:
    """Least cost and audit with which the whole span is well formed."""
    return min(cell[SYMBOLS.index((0, q))] for q in (0, 3))


CELL = "n long, first string, last string, illegal long, lo decimal(38,0), hi decimal(38,0), first_turn decimal(38,0), last_turn decimal(38,0), turns long, blank long, duplicate long, truncated long, costs array<long>, audits array<string>"
_NUMBER = pa.decimal128(38, 0)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _of_rows(rows: list[dict], firsts: set[int]) -> dict:
    """Summary of rows that follow one another in a conversation."""
    rows = [r for r in sorted(rows, key=lambda r: r["g"]) if r["fault"] != "dropped"]
    faults = ["duplicate" if not r["fault"] == "blank" and r["g"] not in firsts else r["fault"] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    cell = _rows_chart(tuple((r["initial"] if r["initial"] in ("s", "u", "a") else "", f) for r, f in zip(rows, faults)))
    return {
        "n": len(rows), "first": rows[0]["initial"] if rows else None, "last": rows[-1]["initial"] if rows else None,
        "illegal": sum(not _legal(a["initial"], b["initial"]) for a, b in zip(rows, rows[1:])),
        "lo": min(turns, default=None), "hi": max(turns, default=None), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "turns": sum(1 for a, b in zip([None, *turns], turns) if a != b),
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "costs": [e and e[0] for e in cell], "audits": [e and e[1] for e in cell],
    }


def _of_cells(cells: list[dict]) -> dict:
    """Summary of cells that follow one another in a conversation."""
    cells = sorted(cells, key=lambda c: c["cell"])
    whole = chart([tuple(None if cost is None else (cost, audit) for cost, audit in zip(c["costs"], c["audits"])) for c in cells])
    full, dated = [c for c in cells if c["n"]], [c for c in cells if c["turns"]]
    out = {k: sum(c[k] for c in cells) for k in ("n", "blank", "duplicate", "truncated")}
    out["illegal"] = sum(c["illegal"] for c in cells) + sum(not _legal(a["last"], b["first"]) for a, b in zip(full, full[1:]))
    out["turns"] = sum(c["turns"] for c in cells) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:]))
    out |= {"first": full[0]["first"] if full else None, "last": full[-1]["last"] if full else None}
    out |= {"lo": min((c["lo"] for c in dated), default=None), "hi": max((c["hi"] for c in dated), default=None), "first_turn": dated[0]["first_turn"] if dated else None, "last_turn": dated[-1]["last_turn"] if dated else None}
    return out | {"costs": [e and e[0] for e in whole], "audits": [e and e[1] for e in whole]}


def _mapped(grouped: DataFrame, keys: list[str], summary: Callable[[dict], dict]) -> DataFrame:
    """One cell for each row of ``grouped``, beside its keys."""
    kinds = dict(grouped.dtypes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 2000):
            out = [summary(r) for r in b.to_pylist()]
            columns = {k: pa.array([o[k] for o in out], kind) for k, kind in ARROW.items()}
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *columns.values()], names=[*keys, *columns])

    return grouped.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), CELL]))


ARROW = {"n": pa.int64(), "first": pa.string(), "last": pa.string(), "illegal": pa.int64(), "lo": _NUMBER, "hi": _NUMBER, "first_turn": _NUMBER, "last_turn": _NUMBER, "turns": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` rows with faults put in by crc32 of ``conv_id:turn``: the columns conv, turn, role, text and ``dropped``.

    Nulls count as one space. A dropped row stays as a mark, so that its conversation is known of; a repeated one comes twice.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace(given("text"), "[.!?]", "")).otherwise(given("text"))
    out = rows.select(F.col("conv_id").alias("conv"), "turn", F.when(fate == 4, F.lit("user")).otherwise(given("role")).alias("role"), "text", fate.alias("fate"))
    out = out.select("conv", "turn", "role", text.alias("text"), (F.col("fate") == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"))
    return out.drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, dropped) with ``mark``, a digest of role and text, and ``g``, a row number over all conversations.

    Rows are dealt by ranges of (conversation, turn, mark) and numbered from the sizes of the ranges, so one conversation may lie in
    many of them; equal rows are told apart by where they were read. Rows of one turn come in the order of their marks.
    """
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keyed = rows.withColumn("mark", mark).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    order = ["conv", "turn", "mark", "_salt"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop("_salt")
    ranged = materialize(ranged, "turns")
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each shuffle partition
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    starts = rows.sparkSession.createDataFrame(starts, "p long, before long")
    out = ranged.join(F.broadcast(starts), part == F.col("p"))  # as many rows as shuffle partitions
    return out.withColumn("g", F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("p", "before", "_at")


def parse(rows: DataFrame) -> DataFrame:
    """One row for each conversation of numbered rows: conv, the fields of CELL, cost and audit."""
    bare = F.expr(f"trim(trailing {SPACE_SQL} from text)")
    last = F.right(bare, F.lit(1))
    fault = F.when(F.col("dropped"), "dropped").when(bare == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    block = F.floor(F.col("g") / BLOCK).alias("cell")
    item = F.struct("g", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.col("turn").cast("decimal(38,0)").alias("turn"))
    first = rows.where("not dropped").groupBy("conv", "mark").agg(F.min("g").alias("g"))  # where a role and text come first
    parts = rows.select("conv", block, item.alias("item"), F.lit(None).cast("long").alias("first"))
    parts = parts.unionByName(first.select("conv", block, F.lit(None).cast(parts.schema["item"].dataType).alias("item"), F.col("g").alias("first")))
    grouped = parts.groupBy("conv", "cell").agg(F.collect_list("item").alias("items"), F.collect_list("first").alias("firsts"))  # BLOCK of each at most
    cells = materialize(_mapped(grouped, ["conv", "cell"], lambda r: _of_rows(r["items"], set(r["firsts"]))), "cells")
    item = F.struct("cell", *ARROW)
    while True:
        counted = cells.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
        if counted <= BLOCK:
            break
        above = cells.groupBy("conv", F.floor(F.col("cell") / BLOCK).alias("cell")).agg(F.collect_list(item).alias("cells"))
        cells = materialize(_mapped(above, ["conv", "cell"], lambda r: _of_cells(r["cells"])), "cells")
    grouped = cells.groupBy("conv").agg(F.collect_list(item).alias("cells"))
    out = _mapped(grouped, ["conv"], lambda r: _of_cells(r["cells"]))
    at = [SYMBOLS.index((0, q)) for q in (0, 3)]
    best = F.array_min(F.array(*(F.struct(F.get("costs", F.lit(i)).alias("cost"), F.get("audits", F.lit(i)).alias("audit")) for i in at)))
    return out.withColumn("best", best).select("*", "best.cost", "best.audit").drop("best", "costs", "audits")


def _repaired(rows: DataFrame, verdicts: DataFrame, schema: str, line: Callable, end: Callable) -> DataFrame:
    """Streams each conversation's rows past its audit; ``line`` gets every repaired turn and ``end`` every conversation, and both may give rows.

    One conversation is one stream of one task, of which a batch of rows and the audit are in memory.
    """
    kind = dict(rows.dtypes)["conv"]
    heads = verdicts.select("conv", F.lit(-1).cast("long").alias("g"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = rows.where("not dropped").select("conv", "g", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(heads)
    both = both.repartition("conv").sortWithinPartitions("conv", "g")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        out: list[tuple] = []

        def turn(edit: str, role: str | None, text: str) -> None:
            name = role if edit == "K" else ("user", "assistant")[(state["place"] - state["odd"]) % 2]
            got = line(state, edit, name, text)
            if got:
                out.append(got)
            state["place"] += 1

        def insertions() -> None:
            while state["at"] < len(state["audit"]) and state["audit"][state["at"]] == "I":
                turn("I", None, "")
                state["at"] += 1

        def closed() -> None:
            if state:
                insertions()
                got = end(state)
                if got:
                    out.append(got)

        for b in slices(it, 1000):
            for conv, g, role, text, audit in zip(*(c.to_pylist() for c in b.columns)):
                if g < 0:
                    closed()
                    kept = len(audit) - audit.count("D")
                    state.clear()
                    state.update(conv=conv, audit=audit, at=0, place=0, odd=kept % 2)
                    continue
                insertions()
                edit = state["audit"][state["at"]]
                state["at"] += 1
                if edit != "D":
                    turn(edit, role, text)
            kind = b.schema.field(0).type
            if out:
                yield batch(out, kind)
                out.clear()
        closed()
        if out:
            yield batch(out, kind)

    def batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t or kind) for x, t in zip(zip(*out), types)], names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    types = [{"kind": None, "long": pa.int64(), "string": pa.string()}[part.split()[1]] for part in schema.split(", ")]
    return both.mapInArrow(run, schema.replace("conv kind", f"conv {kind}"))


def repaired_turns(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(conv, place, edit, role, text)`` of every turn that the cheapest edits leave or insert."""
    return _repaired(rows, verdicts, "conv kind, place long, edit string, role string, text string", lambda s, edit, role, text: (s["conv"], s["place"], edit, role, text), lambda s: None)


def repaired_digests(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(conv, digest)``: SHA-256 of the repaired ``role:text`` lines, joined by newlines, taken as they stream by."""

    def line(state: dict, edit: str, role: str, text: str) -> None:
        if "hash" not in state:
            state["hash"] = hashlib.sha256()
        state["hash"].update(f"{chr(10) if state['place'] else ''}{role}:{text}".encode())

    return _repaired(rows, verdicts, "conv kind, digest string", line, lambda s: (s["conv"], s.get("hash", hashlib.sha256()).hexdigest()))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts, one for each conversation, and numbered rows of (conv, turn, role, text, dropped), for ``repaired_turns`` and ``repaired_digests``.

    Null conv is one conversation; null turns come first and count in no gap; role and text must not be null. Roles of other
    initials than s, u and a must be given another role or go. Repeated rows after the first of their conversation are
    duplicates. Extra columns are not looked at. A conversation of dropped rows only has empty edits. An empty table gives none.
    """
    rows = numbered(rows.select("conv", "turn", "role", "text", "dropped"))
    return materialize(parse(rows), "verdicts"), rows


def repair_report(conversations: DataFrame) -> DataFrame:
    """The damaged conversations with faults, least cost, audit and digest of the repair, one row for each conv_id."""
    verdicts, rows = repair(damage(conversations))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")  # what a longer gap counts as
    gaps = F.when(F.col("hi").isNotNull(), F.least(F.col("hi") - F.col("lo") + 1 - F.col("turns"), most)).otherwise(0).cast("long")
    facts = verdicts.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    digests = repaired_digests(rows, verdicts).withColumnRenamed("conv", "c")
    out = facts.join(digests.hint("merge"), F.col("conv").eqNullSafe(F.col("c")))
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))


def repair_sql() -> str:
    """The same in DuckDB: CRC-32 bit by bit, and the reader's states carried over the rows of each conversation with their least (cost, audit)."""
    return f"""
    with recursive given as (
      select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
      from conversations),
    fated as (
      select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)),
        lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 20 as fate
      from given),
    damaged as (
      select conv_id, turn, case when fate = 4 then 'user' else role end as role,
        case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(range(case fate when 0 then 0 when 3 then 2 else 1 end)) as copy
      from fated),
    convs as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
    ordered as (
      select c, turn, role, text,
        row_number() over (partition by c order by turn nulls first, sha256(length(role) || ':' || role || text)) as i
      from damaged join convs on damaged.conv_id is not distinct from convs.conv_id),
    judged as (
      select *, left(role, 1) as initial, case
        when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank'
        when row_number() over (partition by c, role, text order by i) > 1 then 'duplicate'
        when regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) not in ('.', '!', '?') then 'truncated'
        else '' end as fault
      from ordered),
    steps(role, p, q) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
    states(p) as (values (0), (1), (2), (3)),
    inserted(p, q, cost, letters) as (
      select p, p, 0, '' from states
      union all select p, q, {INSERT}, 'I' from steps where role <> 's'
      union all select a.p, b.q, {2 * INSERT}, 'II' from steps a join steps b on a.q = b.p and a.role <> 's' and b.role <> 's'),
    edits(letter, initial, cost, p, q) as (
      select 'D', null, {DELETE}, p, p from states
      union all select 'K', role, 0, p, q from steps
      union all select 'R', null, {RENAME}, p, q from steps where role <> 's'),
    moves as (
      select letter, initial, edits.cost + inserted.cost as cost, edits.p, inserted.q, letter || letters as letters
      from edits join inserted on edits.q = inserted.p),
    read(c, i, q, cost, audit) as (
      select c, 0::bigint, q, cost, letters from convs, inserted where p = 0
      union all
      select c, i, q, cost, audit from (
        select read.c, read.i + 1 as i, moves.q, read.cost + moves.cost + case when fault = 'truncated' and letter <> 'D' then {UNFINISHED} else 0 end as cost,
          audit || letters as audit
        from read join judged on judged.c = read.c and judged.i = read.i + 1
        join moves on moves.p = read.q and (moves.initial is null or moves.initial = judged.initial)
          and (letter = 'D' or fault not in ('blank', 'duplicate')))
      qualify row_number() over (partition by c, q order by cost, audit) = 1),
    sizes as (select convs.c, conv_id, count(i) as n from convs left join judged on judged.c = convs.c group by all),
    best as (
      select sizes.c, arg_min(struct_pack(cost := cost, audit := audit), struct_pack(cost := cost, audit := audit)) as b
      from sizes join read on read.c = sizes.c and read.i = sizes.n and read.q in (0, 3) group by sizes.c),
    letters as (
      select c, b.audit as audit, unnest(string_split(b.audit, '')) as letter, generate_subscripts(string_split(b.audit, ''), 1) as pos
      from best where b.audit <> ''),
    placed as (
      select *, sum((letter <> 'I')::int) over (partition by c order by pos) as i,
        sum((letter <> 'D')::int) over (partition by c order by pos) - 1 as place, sum((letter <> 'D')::int) over (partition by c) as kept
      from letters),
    lines as (
      select placed.c, pos, case when letter = 'K' then role when (place - kept % 2) % 2 = 0 then 'user' else 'assistant' end
        || ':' || case when letter = 'I' then '' else text end as line
      from placed join judged on judged.c = placed.c and judged.i = greatest(placed.i, 1) where letter <> 'D'
      union all
      select placed.c, pos, case when (place - kept % 2) % 2 = 0 then 'user' else 'assistant' end || ':' from placed
      where letter = 'I' and not exists (select 1 from judged where judged.c = placed.c)),
    texts as (select c, string_agg(line, chr(10) order by pos) as repaired from lines group by c),
    facts as (
      select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated
      from judged group by c),
    pairs as (
      select c, count(*) as illegal from (select c, lag(initial) over (partition by c order by i) || initial as pair, i from judged)
      where i > 1 and pair not in ('su', 'ua', 'au') group by c)
    select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
      coalesce(illegal, 0) as illegal, b.cost::bigint as cost, b.audit as audit, sha256(coalesce(repaired, '')) as repaired_sha256
    from sizes left join facts using (c) left join pairs using (c) join best using (c) left join texts using (c)"""
