"""Repair of conversations by error-correcting Earley parsing.

A weighted grammar of roles has, beside its own rules, productions for errors: a turn is deleted, gets another role, or an empty
one is inserted. Its rules are left-linear (`Pairs -> Open assistant`), so every item of a chart begins at the chart's
start and a column holds at most one item a rule; an item keeps the least (cost, audit), where the audit is the edits' initials.
The completed chart's least way yields the repair.

A conversation may have any length: turns are numbered over the whole table and parsed in blocks. A block that doesn't begin
its conversation is parsed from every nonterminal; ways through neighbouring blocks are joined by levels (of 256 each), and
the chosen way goes down the same levels. Of equal cost, no audit over the same turns is the beginning of another (what
is more there would be insertions, which cost more), so the least way of a whole has the least ways of its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.operators.numbering import numbered

from .common import partitions, ship, written

#: Turns of a block, and blocks of a level that become one of the next.
BLOCK = 256
#: Bytes of turns that are hashed at once.
PIECE = 1 << 20
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Grammar:
    """Rules (head, left, role): head is what stands before (left) and then a turn of that role. A conversation begins as `start` and
    may end as any of `ends`. `given` are roles that a turn may be given or that may be inserted. Costs are whole numbers, that of
    an insertion above 0. Turns match a role by their role's first character; `legal` has pairs of these that may follow each other."""

    start: str
    ends: tuple[str, ...]
    rules: tuple[tuple[str, str, str], ...]
    given: tuple[str, ...]
    legal: tuple[str, ...]
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3

    @property
    def names(self) -> list[str]:
        return sorted({self.start, *(x for head, left, _ in self.rules for x in (head, left))})


#: One system turn at most, then pairs of user and assistant; or nothing.
CHAT = Grammar(
    start="Start",
    ends=("Start", "Pairs"),
    rules=(("System", "Start", "system"), ("Open", "Start", "user"), ("Open", "System", "user"), ("Open", "Pairs", "user"), ("Pairs", "Open", "assistant")),
    given=("user", "assistant"),
    legal=("su", "ua", "au"),
)

#: Faults of a turn; a turn has its first one only.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

Way = tuple[int, str, str]  # cost, audit, and for each edit its rule's letter (or - for a deletion)
Column_ = dict[str, Way]


def _letter(rule: int) -> str:
    return chr(ord("0") + rule)


def _offer(column: Column_, name: str, way: Way) -> bool:
    if name not in column or way < column[name]:
        column[name] = way
        return True
    return False


def _completed(column: Column_, grammar: Grammar) -> Column_:
    """The column with all items that insertions complete."""
    agenda = list(column)
    while agenda:
        left = agenda.pop()
        cost, audit, trace = column[left]
        for k, (head, before, role) in enumerate(grammar.rules):
            if before == left and role in grammar.given and _offer(column, head, (cost + grammar.insert, audit + "I", trace + _letter(k))):
                agenda.append(head)
    return column


def parse(turns: Iterable[tuple[str, int]], grammar: Grammar, entry: str) -> Column_:
    """The last column of the chart over turns (first character of the role, fault): for each nonterminal that the turns may
    end as, having begun as entry, the least way."""
    column = _completed({entry: (0, "", "")}, grammar)
    for initial, fault in turns:
        after: Column_ = {}
        more = grammar.truncated if fault == TRUNCATED else 0
        for left, (cost, audit, trace) in column.items():
            _offer(after, left, (cost + grammar.delete, audit + "D", trace + "-"))
            if fault in (BLANK, DUPLICATE):
                continue
            for k, (head, before, role) in enumerate(grammar.rules):
                if before != left:
                    continue
                if role[0] == initial:
                    _offer(after, head, (cost + more, audit + "K", trace + _letter(k)))
                if role in grammar.given:
                    _offer(after, head, (cost + grammar.rerole + more, audit + "R", trace + _letter(k)))
        column = _completed(after, grammar)
    return column


def _best(ways: dict[tuple[str, str], Way], grammar: Grammar) -> tuple[str, Way]:
    return min(((end, ways[grammar.start, end]) for end in grammar.ends if (grammar.start, end) in ways), key=lambda w: w[1])


def _joined(one: dict[tuple[str, str], Way], two: dict[tuple[str, str], Way]) -> dict[tuple[str, str], Way]:
    out: dict[tuple[str, str], Way] = {}
    for (entry, middle), (cost, audit, trace) in one.items():
        for (before, end), (more, rest, marks) in two.items():
            if before == middle:
                _offer(out, (entry, end), (cost + more, audit + rest, trace + marks))
    return out


_SUMS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_SUMMARY = [*((c, pa.int64()) for c in _SUMS), ("first_role", pa.string()), ("last_role", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
_WAYS = pa.list_(pa.struct([("entry", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("trace", pa.string())]))
_CHUNK = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("whole", pa.bool_()), *_SUMMARY, ("ways", _WAYS)])
_CHUNK_DDL = "conv string, block long, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, first_role string, last_role string, first_turn long, last_turn long, ways array<struct<entry string, end string, cost long, audit string, trace string>>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(0, b.num_rows, 500):
            yield from b.slice(k, 500).to_pylist()


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int = 500, weigh: Callable[[dict], int] = lambda row: 0) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if len(held) >= size or weight >= PIECE:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _ways_list(ways: dict[tuple[str, str], Way]) -> list[dict]:
    return [{"entry": entry, "end": end, "cost": w[0], "audit": w[1], "trace": w[2]} for (entry, end), w in sorted(ways.items())]


def _ways_dict(ways: list[dict]) -> dict[tuple[str, str], Way]:
    return {(w["entry"], w["end"]): (w["cost"], w["audit"], w["trace"]) for w in ways}


def _summary(run: list[dict], legal: tuple[str, ...]) -> dict:
    known = [r["turn"] for r in run if r["turn"] is not None]
    return {
        **{c: sum(r["fault"] == k for r in run) for k, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))},
        "illegal": sum(a["initial"] + b["initial"] not in legal for a, b in zip(run, run[1:])),
        "turns": len(set(known)),
        "first_role": run[0]["initial"], "last_role": run[-1]["initial"],
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
    }


def _added(one: dict, two: dict, legal: tuple[str, ...]) -> dict:
    out = {c: one[c] + two[c] for c in _SUMS}
    out["illegal"] += one["last_role"] + two["first_role"] not in legal
    out["turns"] -= one["last_turn"] is not None and one["last_turn"] == two["first_turn"]
    out |= {"first_role": one["first_role"], "last_role": two["last_role"]}
    return out | {"first_turn": two["first_turn"] if one["first_turn"] is None else one["first_turn"], "last_turn": one["last_turn"] if two["last_turn"] is None else two["last_turn"]}


def _parser(grammar: Grammar):
    """Chunks (the turns of one conversation in one block). The first and the last of a block may go on in another one."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, rows in groupby(_rows(batches), key=lambda r: r["block"]):
            runs = [list(run) for _, run in groupby(rows, key=lambda r: r["conv"])]
            for k, run in enumerate(runs):
                turns = [(r["initial"], r["fault"]) for r in run]
                entries = [grammar.start] if k else grammar.names
                ways = {(entry, end): way for entry in entries for end, way in parse(turns, grammar, entry).items()}
                yield {"conv": run[0]["conv"], "block": block, "whole": 0 < k < len(runs) - 1, **_summary(run, grammar.legal), "ways": _ways_list(ways)}

    return lambda batches: _batches(chunks(batches), _CHUNK)


def _raiser(grammar: Grammar):
    """Neighbouring chunks of a conversation, up to BLOCK of them, as one of the next level."""

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for (conv, block), rows in groupby(_rows(batches), key=lambda r: (r["conv"], r["block"] // BLOCK)):
            ways, summary = None, None
            for r in rows:
                own = _ways_dict(r["ways"])
                ways, summary = (own, r) if ways is None else (_joined(ways, own), _added(summary, r, grammar.legal))
            yield {"conv": conv, "block": block, "whole": False, **{c: summary[c] for c, _ in _SUMMARY}, "ways": _ways_list(ways)}

    return lambda batches: _batches(raised(batches), _CHUNK)


_CHOICE = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("entry", pa.string()), ("end", pa.string())])
_CHOICE_DDL = "conv string, block long, entry string, end string"


def _lowerer():
    """For the chosen way (entry, end) of a chunk, that of each chunk of the level below."""

    def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, rows in groupby(_rows(batches), key=lambda r: (r["conv"], r["above"])):
            rows = list(rows)  # BLOCK at most
            reached = [{rows[0]["entry"]: ((0, "", ""), "")}]
            for r in rows:
                here: dict[str, tuple[Way, str]] = {}
                for (entry, end), (cost, audit, trace) in _ways_dict(r["ways"]).items():
                    if entry in reached[-1]:
                        (sum_, before, marks), _ = reached[-1][entry]
                        way = ((sum_ + cost, before + audit, marks + trace), entry)
                        if end not in here or way < here[end]:
                            here[end] = way
                reached.append(here)
            at = rows[0]["end"]
            for r, here in zip(reversed(rows), reversed(reached)):
                entry = here[at][1]
                yield {"conv": r["conv"], "block": r["block"], "entry": entry, "end": at}
                at = entry

    return lambda batches: _batches(lowered(batches), _CHOICE)


_TURN = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_TURN_DDL = "conv string, block long, place long, step int, edit string, role string, text string"


def _editor(grammar: Grammar):
    """The turns of each chunk after its edits. The row with a chunk's edits stands before its turns."""

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for (block, conv), rows in groupby(_rows(batches), key=lambda r: (r["block"], r["conv"])):
            chosen = next(rows)
            edits, place, step = zip(chosen["audit"], chosen["trace"]), 0, 0

            def turn(edit: str, rule: str, row: dict | None) -> dict:
                role = row["role"] if edit == "K" else grammar.rules[ord(rule) - ord("0")][2]
                return {"conv": conv, "block": block, "place": place, "step": step, "edit": edit, "role": role, "text": "" if edit == "I" else row["text"]}

            for r in rows:
                place, step = r["place"], 0
                for edit, rule in edits:
                    if edit != "D":
                        yield turn(edit, rule, r)
                        step += 1
                    if edit != "I":
                        break
            for edit, rule in edits:  # after the last turn
                yield turn(edit, rule, None)
                step += 1

    return lambda batches: _batches(edited(batches), _TURN, weigh=lambda row: len(row["text"]))


_PIECE = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("piece", pa.binary())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def joined() -> Iterator[dict]:
        for (block, conv), rows in groupby(_rows(batches), key=lambda r: (r["block"], r["conv"])):
            lines, size, part = [], 0, 0
            for r in rows:
                if size >= PIECE:
                    yield {"conv": conv, "block": block, "part": part, "piece": b"\n".join(lines)}
                    lines, size, part = [], 0, part + 1
                lines.append(f"{r['role']}:{r['text']}".encode())
                size += len(lines[-1])
            yield {"conv": conv, "block": block, "part": part, "piece": b"\n".join(lines)}

    return _batches(joined(), _PIECE, weigh=lambda row: len(row["piece"]))


_DIGEST = pa.schema([("conv", pa.string()), ("sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests() -> Iterator[dict]:
        for conv, rows in groupby(_rows(batches), key=lambda r: r["conv"]):
            digest = sha256(next(rows)["piece"])
            for r in rows:
                digest.update(b"\n" + r["piece"])
            yield {"conv": conv, "sha256": digest.hexdigest()}

    return _batches(digests(), _DIGEST)


class Repair(NamedTuple):
    """turns: the repaired conversations, (conv_id, place, step, edit, role, text), in order by place and step. report: (conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit) of each conversation. digests: (conv_id, sha256) of `role:text` of all turns, joined by line
    ends; conversations without turns have none."""

    turns: DataFrame
    report: DataFrame
    digests: DataFrame


def _key(conv: str) -> Column:
    return F.coalesce(F.col(conv).cast("string"), F.lit(""))


def _conv_id(kind) -> Column:
    return F.nullif(F.col("conv"), F.lit("")).cast(kind).alias("conv_id")


def repair(messages: DataFrame, grammar: Grammar = CHAT) -> Repair:
    """Cheapest repairs of conversations: messages has conv_id (a whole number), turn, role and text, other columns are ignored.

    Turns stand by turn (nulls first), rows that share one by role and text (64 characters of each,
    then a digest of both). A null role or text is one space, so a null text is
    blank. A turn is blank without a character that is no white space, duplicate if an earlier turn of the conversation has its role
    and text, truncated if its last such character is none of `.!?`; its first fault counts. Blank and duplicate turns are
    deleted, truncated ones cost more. Rows with a null conv_id are one conversation. An empty table gives none. `gaps` counts numbers
    that are missing between the least and the greatest turn; `illegal` counts neighbours whose roles may not follow each other.

    Turns are parsed by blocks of the whole order, so a conversation may hold all rows; only the digest of one conversation, which
    SHA-256 has to take in order, and its audit, which is one string, come together in one task, piece by piece.
    """
    spark = messages.sparkSession
    ship(spark)
    n = partitions(spark)
    kind = messages.schema["conv_id"].dataType
    space = F.lit(" ")
    plain = messages.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    said = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    order = ["conv_id", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64)), said]  # ranges are drawn from a sample of these: bounded in length
    rows = numbered(plain, *order).select(_key("conv_id").alias("conv"), "turn", "role", "text", "place", F.floor(F.col("place") / BLOCK).alias("block"))
    firsts = rows.groupBy("conv", said.alias("said")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    marked = rows.select("conv", "block", "place", "turn", F.substring("role", 1, 1).alias("initial"), last.alias("last")).join(firsts, "place", "left")  # a place is in one row: no key is hot
    fault = F.when(F.col("last") == "", BLANK).when(F.col("new").isNull(), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    light = marked.select("block", "place", "conv", "turn", "initial", fault.alias("fault")).repartition(n, "block").sortWithinPartitions("block", "place")
    chunks = written(light.mapInArrow(_parser(grammar), _CHUNK_DDL), "chunks")

    # up: chunks that may go on in another block, level by level
    levels = [chunks.where("not whole")]
    blocks = (levels[0].agg(F.max("block")).first()[0] or 0) + 1
    while blocks > 1 or len(levels) == 1:  # at the top a conversation is one chunk
        above = F.floor(F.col("block") / BLOCK)
        levels.append(written(levels[-1].repartition(n, "conv", above).sortWithinPartitions("conv", "block").mapInArrow(_raiser(grammar), _CHUNK_DDL), "chunks"))
        blocks = -(-blocks // BLOCK)

    # the best way of whole chunks and of the top, and down again
    def ends(table: DataFrame) -> DataFrame:
        found = F.filter("ways", lambda w: (w.entry == grammar.start) & w.end.isin(*grammar.ends))
        best = F.array_min(F.transform(found, lambda w: F.struct(w.cost.alias("cost"), w.audit.alias("audit"), w.trace.alias("trace"), w.entry.alias("entry"), w.end.alias("end"))))
        return table.withColumn("best", best)

    top = ends(levels[-1])
    choice = top.select("conv", "block", "best.entry", "best.end")
    for level in reversed(levels[:-1]):
        wanted = choice.select(F.col("conv").alias("of"), F.col("block").alias("above"), "entry", "end")
        own = level.select("conv", "block", "ways", F.floor(F.col("block") / BLOCK).alias("of_block"))
        told = own.join(wanted, (F.col("conv") == F.col("of")) & (F.col("of_block") == F.col("above")))
        choice = written(told.select("conv", "block", "above", "ways", "entry", "end").repartition(n, "conv", "above").sortWithinPartitions("conv", "above", "block").mapInArrow(_lowerer(), _CHOICE_DDL), "choices")
    way = F.filter("ways", lambda w: (w.entry == F.col("entry")) & (w.end == F.col("end")))[0]
    opened = levels[0].select("conv", "block", "ways").join(choice, ["conv", "block"]).select("conv", "block", way.alias("best"))
    closed = ends(chunks.where("whole"))
    chosen = closed.select("conv", "block", "best.audit", "best.trace").unionByName(opened.select("conv", "block", "best.audit", "best.trace"))

    head = chosen.select("block", "conv", F.lit(None).cast("long").alias("place"), "audit", "trace", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    nothing = F.lit(None).cast("string")
    body = rows.select("block", "conv", "place", nothing.alias("audit"), nothing.alias("trace"), "role", "text")
    turns = head.unionByName(body).repartition(n, "block").sortWithinPartitions("block", "conv", F.asc_nulls_first("place")).mapInArrow(_editor(grammar), _TURN_DDL)
    pieces = turns.mapInArrow(_pieces, "conv string, block long, part int, piece binary")
    digests = pieces.repartition(n, "conv").sortWithinPartitions("conv", "block", "part").mapInArrow(_hashed, "conv string, sha256 string")

    done = closed.unionByName(top)
    span = F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")
    report = done.select(_conv_id(kind), F.coalesce(span, F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")
    return Repair(turns.select(_conv_id(kind), "place", "step", "edit", "role", "text"), report, digests.select(_conv_id(kind), "sha256"))
