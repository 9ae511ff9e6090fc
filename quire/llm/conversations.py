"""Operator 12, conversation structure repair by a Viterbi search with coalescing survivors.

A conversation's rows, by turn (nulls first), then role and text, are edited so that the
initials of its roles read ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (1), Delete
(2; blank rows and repeats of an earlier row must go), Insert an empty user or assistant row
(5); a truncated row that stays costs 5 more. The cheapest edits win, of equal ones those with
the least string of initials. Two paths to one state after the same rows have unlike lengths
only with unlike costs, so the order of tied paths never changes by what follows.

At any size, with one conversation of a third of all rows:

1. Equal rows of a conversation are counted, not listed; the first of equal (role, text) is
   the one of least turn, found by a map-side minimum and joined back on unique keys.
2. The rows are sorted over range partitions, so a long conversation is cut over many. Each
   task streams its rows in segments of at most ``ROWS`` rows and ``BYTES`` bytes of one
   conversation. A conversation that lies inside one segment is solved there. Of the others
   each segment is searched from every state it can begin in.
3. A long conversation's segments (costs and edits from state to state, no texts) are
   searched in order by the same survivors, one segment as one step; what is settled is
   written out at once, so memory is what is unresolved.
4. Each segment then applies its edits to its own rows.

Nulls in role or text count as one space. A null conversation is one like any other. Extra
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.common import materialise
from quire.llm.survivors import Survivors

ROWS = 256
BYTES = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by a row of a role of our own
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
OK, BLANK, REPEAT, CUT = range(4)
INSERTS = [(a, b, 5, "I", 5) for a, b in NEXT.items()]


def _moves(initial: str, fault: int) -> list[tuple]:
    gone = [(a, a, 2, "D", 2) for a in NEXT]
    if fault in (BLANK, REPEAT):
        return gone
    more = 5 if fault == CUT else 0
    kept = [(a, b, more, "K", more) for (a, i), b in KEEP.items() if i == initial]
    return [*gone, *kept, *[(a, b, 1 + more, "R", 1 + more) for a, b in NEXT.items()]]


_TABLE = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in (OK, BLANK, REPEAT, CUT)}


def _prune(found: Survivors) -> None:
    """Give up survivors that no future row can help, so that the others come to share an ancestor.

    After an assistant row the future costs what it costs after the system row, and at most 2
    more than at the start (a system row deleted, not kept); it may also end there.
    """
    cost = found.live[ASSISTANT][0]
    for state, more in ((START, 2), (SYSTEM, 0)):
        if state in found.live and cost + more < found.live[state][0]:
            found.drop(state)


def _search(rows: list[tuple[str, int, int]], begin: int) -> Survivors:
    """Survivors after the (initial, fault, copies) of a segment. Copies after the first are repeats or blank: they go."""
    found = Survivors(begin)
    found.step(INSERTS, stay=True)
    for initial, fault, copies in rows:
        found.step(_TABLE[initial if initial in ("s", "u", "a") else "", fault])
        if copies > 1:
            found.step([(a, a, 2 * (copies - 1), "D" * (copies - 1), None) for a in NEXT])
        found.step(INSERTS, stay=True)
        _prune(found)
    return found


def _lanes(rows: list[tuple[str, int, int]]) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of a segment for every state that it can begin and end in."""
    out = []
    for begin in range(4):
        found = _search(rows, begin)
        head = "".join(t for t, _ in found.settled)
        out += [(begin, end, cost, head + found._text(node, "")) for end, (cost, node) in found.live.items()]
    return out


def apply_edits(rows: list[tuple[str, str, int]], edits: str, state: int) -> list[dict]:
    """The repaired rows of a segment's (role, text, copies) that begins in ``state``."""
    out, at = [], 0

    def inserted() -> None:
        nonlocal at, state
        while edits[at : at + 1] == "I":
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": ""})
            at += 1

    for role, text, copies in rows:
        inserted()
        what = edits[at]
        at += copies  # the copies after the first are deleted, with nothing between
        if what == "K":
            state = KEEP[state, role[:1]]
            out.append({"role": role, "text": text})
        elif what == "R":
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": text})
    inserted()
    return out


def _faults(rows: list[tuple[str, int, int]]) -> dict:
    """Counts of a segment's faults and of its illegal neighbours inside."""
    n = {OK: 0, BLANK: 0, REPEAT: 0, CUT: 0}
    illegal, before = 0, None
    for initial, fault, copies in rows:
        n[fault] += 1
        n[BLANK if fault == BLANK else REPEAT] += copies - 1
        illegal += (before is not None and before + initial not in LEGAL) + copies - 1
        before = initial
    return {"blank": n[BLANK], "duplicate": n[REPEAT], "truncated": n[CUT], "illegal": illegal, "first": rows[0][0], "last": before}


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Distinct rows with their copies and ``fault``, not yet sorted. ``turns``: conv_id, turn, role, text, copies."""

    def key(c: str):
        return F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))

    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    keyed = turns.select("conv_id", "turn", role, text, "copies", key("conv_id").alias("ck"), key("turn").alias("tk"))
    keyed = keyed.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("text first"), "text", "role")})
    rows = keyed.groupBy("ck", "tk", "h1", "h2").agg(
        F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("role").alias("role"), F.first("text").alias("text"),
        F.sum("copies").alias("copies"),
    )
    least = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "tk")).alias("low")
    first = keyed.groupBy("ck", "h1", "h2").agg(least).select("ck", F.col("low.tk").alias("tk"), "h1", "h2", F.lit(True).alias("first"))
    rows = rows.join(first, ["ck", "tk", "h1", "h2"], "left")
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    cut = ~F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, BLANK).when(F.col("first").isNull(), REPEAT).when(cut, CUT).otherwise(OK)
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


_ROW = "struct<role:string,text:string>"
_SEGMENT = (
    "segment long, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, "
    f"repaired array<{_ROW}>, lanes array<struct<from:int,to:int,cost:long,edits:string>>, rows array<struct<role:string,text:string,copies:long>>"
)


def _schema(conv_type, columns: str):
    return StructType([conv_type, *StructType.fromDDL(columns).fields])


def segments(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """Solved conversations (``whole``), and the lanes and rows of the parts of others, numbered in order."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    dealt = rows.repartitionByRange(*[F.col("conv_id").asc_nulls_first(), *order[1:], F.left("text", F.lit(256))])
    dealt = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order[1:], "text")
    out = _schema(rows.schema["conv_id"], _SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        number, made, size = TaskContext.get().partitionId() << 33, [], 0
        open_: list[tuple] = []  # rows of the segment: role, text, copies, fault
        now, began, bytes_ = object(), True, 0  # began: the conversation began in this segment, as far as this task can tell

        def close(ends: bool) -> None:
            """Close the segment; ``ends``: the conversation ends with it for sure."""
            nonlocal number, size, bytes_
            if not open_:
                return
            facts = [(r[:1], f, c) for r, _, c, f in open_]
            whole = began and ends
            row = {"conv_id": now, "segment": number, "whole": whole, **_faults(facts)}
            if whole:
                best = _search(facts, START)
                row["cost"] = best.finish(ENDS)
                row["audit"] = "".join(t for t, _ in best.settled)
                row["repaired"] = apply_edits([r[:3] for r in open_], row["audit"], START)
            else:
                row["lanes"] = [dict(zip(("from", "to", "cost", "edits"), x)) for x in _lanes(facts)]
                row["rows"] = [{"role": r, "text": t, "copies": c} for r, t, c, _ in open_]
            made.append(row)
            size += bytes_ + 200
            number, bytes_ = number + 1, 0
            open_.clear()

        head = True  # the first conversation of a task may have begun in the task before
        for batch in batches:
            for conv, role, text, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "copies", "fault"))):
                if conv != now:
                    close(ends=True)
                    now, began, head = conv, not head, False
                elif len(open_) >= most or bytes_ >= BYTES:
                    close(ends=False)
                    began = False
                open_.append((role, text, copies, fault))
                bytes_ += len(text) + 50
            if size > BYTES:
                yield pa.RecordBatch.from_pylist(made, schema)
                made, size = [], 0
        close(ends=False)  # it may go on in the next task
        yield pa.RecordBatch.from_pylist(made, schema)

    return dealt.select("conv_id", "role", "text", "copies", "fault").mapInArrow(run, out)


def resolve(parts: DataFrame) -> DataFrame:
    """segment, state, cost, audit, between: the edits of every segment of the conversations that are in several.

    ``between`` is 1 where the segment's first row may not follow the last of the segment before.
    """
    conv = parts.schema["conv_id"]
    narrow = parts.select("conv_id", "segment", "first", "last", "lanes").repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["segment", "state", "cost", "audit", "between"]
        out: list[tuple] = []
        now, found, state, last = object(), None, START, None

        def settle() -> None:
            nonlocal state
            for text, (segment, end, cost, between) in found.settled:
                out.append((segment, state, cost, text, between))
                state = end
            found.settled.clear()

        def table() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for c, segment, first, end, lanes in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "first", "last", "lanes"))):
                if found is None or c != now:
                    if found is not None:
                        found.finish(ENDS)
                        settle()
                    now, found, state, last = c, Survivors(START), START, None
                between = int(last is not None and last + first not in LEGAL)
                found.step((x["from"], x["to"], x["cost"], x["edits"], (segment, x["to"], x["cost"], between)) for x in lanes)
                _prune(found)
                last = end
                settle()
            if len(out) >= 1000:
                yield table()
        if found is not None:
            found.finish(ENDS)
            settle()
        yield table()

    return narrow.mapInArrow(run, "segment long, state int, cost long, audit string, between long")


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, segment, whole, blank, duplicate, truncated, illegal, cost, audit, repaired (role, text): the edits and
    repaired rows of every segment; a conversation in one segment is ``whole``, others follow ``segment``.

    ``turns`` has conv_id, turn, role, text, copies.
    """
    found = materialise(segments(ordered_turns(turns)), "segments")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    whole = found.where("whole").select("conv_id", "segment", "whole", *counts, "cost", "audit", "repaired")
    parts = found.where("not whole")
    edits = resolve(parts).withColumnRenamed("cost", "paid").withColumnRenamed("audit", "edits")
    both = parts.drop("lanes", "repaired").join(edits, "segment")
    both = both.select("conv_id", "segment", "whole", *counts[:3], (F.col("illegal") + F.col("between")).alias("illegal"),
                       F.col("paid").alias("cost"), F.col("edits").alias("audit"), "state", "rows")
    out = whole.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            for at in range(batch.num_rows):  # a segment at a time: texts are of bounded size
                one = batch.slice(at, 1)
                rows = [(r["role"], r["text"], r["copies"]) for r in one.column("rows")[0].as_py()]
                fixed = apply_edits(rows, one.column("audit")[0].as_py(), one.column("state")[0].as_py())
                kind = kind or pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                kept = [one.column(c) for c in out.names[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([fixed], kind)], names=out.names)

    return whole.unionByName(both.mapInArrow(run, out))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    A conversation in several segments is hashed by one task as they come in order: the hash of
    one text has no parts. What the task reads are joined texts of whole segments, not rows.
    """
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    lines = repaired.select("conv_id", "segment", "whole", *counts, "audit", F.size("repaired").alias("n"), text.alias("lines"))
    whole = lines.where("whole").select("conv_id", *counts, "audit", F.sha2(F.col("lines").cast("binary"), 256).alias("repaired_sha256"))
    parts = lines.where("not whole").drop("whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    out = whole.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        now, state = object(), None

        def done() -> pa.RecordBatch:
            row = {"conv_id": now, **state["n"], "audit": "".join(state["audit"]), "repaired_sha256": state["sha"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if state is None or row["conv_id"] != now:
                    if state is not None:
                        yield done()
                    now, state = row["conv_id"], {"n": dict.fromkeys(counts, 0), "audit": [], "sha": hashlib.sha256(), "any": False}
                for c in counts:
                    state["n"][c] += row[c]
                state["audit"].append(row["audit"])
                if row["n"]:
                    state["sha"].update((("\n" if state["any"] else "") + row["lines"]).encode())
                    state["any"] = True
        if state is not None:
            yield done()

    return whole.unionByName(parts.mapInArrow(run, out))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after seeded damage: by crc32(``conv_id:turn``) mod 20, 0 drops the row, 1 empties
    its text, 2 takes its sentence ends out, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *part).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    d = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def turn_gaps(turns: DataFrame) -> DataFrame:
    """conv_id, gaps: turns missing between the least and the largest, nulls aside."""
    t = turns.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    return t.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations`` (conv_id, turn, role, text): damage, then repair."""
    turns = damaged(conversations)
    found = digests(repair(turns)).withColumnRenamed("conv_id", "c1")
    gaps = turn_gaps(turns).withColumnRenamed("conv_id", "c2")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(gaps, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    count = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *count, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
