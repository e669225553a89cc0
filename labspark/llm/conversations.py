"""Conversations whose roles don't follow each other, and the cheapest edits that repair them.

Rows are numbered within their conversation by ranges and read as strings of role and fault symbols in chunks of bounded
length, so that no conversation need fit a task. A Re-Pair grammar is formed over the chunks of all conversations, a round of
pairs at a time, and each rule gets one transfer matrix (``repair_grammar``). Every chunk is folded with them; chunks of a long
conversation are multiplied in levels, and the states chosen at the top go down again to the chunks, whose audits are then
written out. Only the last step reads a conversation in order, as a stream, since a hash of all its lines has no other way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labspark.llm import repair_grammar as grammars
from labspark.llm.common import stored
from labspark.llm.repair_grammar import BREAK, NEXT, STATES, Folds, Grammar
from labspark.plans.numbering import numbered

#: Rows of a chunk, and parts that are multiplied at once.
CHUNK = 1024
FAN = 256
#: Rules of a round, rounds, and how often a pair must occur to become a rule.
RULES, ROUNDS, LEAST = 512, 12, 2
#: Chunks that are folded together.
FOLDED = 512
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
INSERTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}


class Repaired(NamedTuple):
    """``reports``: one row for each conversation; ``lines``: what is left of it, in order."""

    reports: DataFrame
    lines: DataFrame


def ordered(rows: DataFrame, conv_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """The rows with their ``position`` in the conversation, from 1: by turn, nulls first, then role, then a digest of the text."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(" "))
    named = rows.select(
        F.col(conv_column).alias("conv"),
        F.col(turn_column).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.sha2(text, 256).alias("digest"),
    )
    return numbered(named, ["conv"], ["turn", "role", "digest"], "position").drop("digest")


def chunked(rows: DataFrame) -> DataFrame:
    """``conv``, ``chunk``, its ``symbols`` and the counts of faults in it.

    A chunk gets its rows, the last row of the chunk before it, and a mark for each row that is the first of its role and
    text. The marks come from minima formed before the shuffle, so a text that fills a conversation is no large group.
    """
    tail = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = F.when(tail == "", "b").when(F.right(tail, F.lit(1)).isin(".", "!", "?"), "").otherwise("c")
    facts = rows.select("conv", "position", "role", "text", known.alias("initial"), fault.alias("fault"))
    chunk = F.floor((F.col("position") - 1) / CHUNK).cast("bigint")

    def entry(kind: int) -> Column:
        letter, what = (F.col("initial"), F.col("fault")) if kind != 1 else (F.lit(""), F.lit(""))
        return F.struct("position", F.lit(kind).alias("kind"), letter.alias("initial"), what.alias("fault")).alias("entry")

    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = facts.where("fault <> 'b'").groupBy("conv", key.alias("key")).agg(F.min("position").alias("position"))
    parts = facts.select("conv", chunk.alias("chunk"), entry(0))
    parts = parts.unionByName(firsts.select("conv", chunk.alias("chunk"), entry(1)))
    parts = parts.unionByName(facts.where(F.col("position") % CHUNK == 0).select("conv", (chunk + 1).alias("chunk"), entry(-1)))
    chunks = parts.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list("entry")).alias("e"))

    def judged(e: Column, i: Column) -> Column:
        # A row's mark follows it.
        again = ~F.coalesce(F.get("e", i + 1)["kind"] == 1, F.lit(False))
        return F.when(e["fault"] == "b", "b").when(again, "d").otherwise(e["fault"])

    faults = F.transform("e", lambda e, i: F.when(e["kind"] == 0, judged(e, i)))
    roles = F.transform(F.filter("e", lambda e: e["kind"] <= 0), lambda e: e["initial"])
    chunks = chunks.select("conv", "chunk", "e", faults.alias("f"), roles.alias("r"))
    must_go = F.array(F.lit("b"), F.lit("d"))
    letters = F.zip_with(
        "e",
        "f",
        lambda e, f: F.when(f.isNull(), "").when(F.array_contains(must_go, f), "x").when(f == "c", F.upper(e["initial"])).otherwise(e["initial"]),
    )
    follows = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda a, b: F.concat(a, b))

    def count(fault: str) -> Column:
        return F.size(F.filter("f", lambda f: f == fault)).cast("bigint")

    return chunks.select(
        "conv",
        "chunk",
        F.array_join(letters, "").alias("symbols"),
        count("b").alias("blank"),
        count("d").alias("duplicate"),
        count("c").alias("truncated"),
        F.size(F.filter(follows, lambda p: ~p.isin(*LEGAL))).cast("bigint").alias("illegal"),
    ).where("symbols <> ''")


def grown(chunks: DataFrame) -> Grammar:
    """The grammar of all chunks. Each round counts pairs over them as the rounds before left them; the driver gets the most
    frequent, ``RULES`` at most."""
    grammar = Grammar()
    for _ in range(ROUNDS):

        def pairs(batches: Iterator[pd.DataFrame], grammar: Grammar = grammar) -> Iterator[pd.DataFrame]:
            for batch in batches:
                a, b, n = grammars.pair_counts(grammar.rewritten(grammars.flattened(batch["symbols"].tolist())))
                yield pd.DataFrame({"a": a, "b": b, "n": n})

        counts = chunks.select("symbols").mapInPandas(pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        top = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "a", "b").limit(RULES).collect()
        found = grammars.chosen([(r.a, r.b) for r in top], RULES)
        if not found:
            break
        grammar.add(found)
    return grammar


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``FOLDED`` rows at most, as folding keeps the states between all symbols."""
    for batch in batches:
        for first in range(0, batch.num_rows, FOLDED):
            yield batch.slice(first, FOLDED)


def sequences(grammar: Grammar, texts: list[str]) -> list[np.ndarray]:
    flat = grammar.rewritten(grammars.flattened(texts))
    return np.split(flat[flat != BREAK], np.cumsum(np.diff(np.concatenate([[-1], np.flatnonzero(flat == BREAK)])) - 1)[:-1])


MATRIX = "costs array<bigint>, places array<bigint>"


def matrices(chunks: DataFrame, grammar: Grammar) -> DataFrame:
    """``conv``, ``part`` and the matrix of each chunk."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            folds = Folds(sequences(grammar, batch.column("symbols").to_pylist()), grammar.costs, grammar.ranks)
            columns = [batch.column("conv"), batch.column("chunk"), lists(folds.costs), lists(folds.places)]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "costs", "places"])

    schema = T.StructType([chunks.schema["conv"], T.StructField("part", T.LongType()), *T.StructType.fromDDL(MATRIX)])
    return stored(chunks.select("conv", "chunk", "symbols").mapInArrow(fold, schema), "chunk-matrices")


def lists(stack: np.ndarray) -> pa.Array:
    return pa.array(stack.reshape(len(stack), STATES * STATES).tolist(), pa.list_(pa.int64()))


def stacked(column: list) -> np.ndarray:
    return np.array(column, np.int64).reshape(len(column), STATES, STATES)


def gathered(parts: DataFrame) -> DataFrame:
    """``FAN`` parts in a row as one: their matrices in order, and the product."""
    several = F.sort_array(F.collect_list(F.struct("part", "costs", "places")))
    groups = parts.groupBy("conv", F.floor(F.col("part") / FAN).cast("bigint").alias("up")).agg(several.alias("several"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, places = [], []
            for several in batch.column("several").to_pylist():
                folds = folded(several)
                costs.append(folds.costs[0])
                places.append(folds.places[0])
            columns = [*(batch.column(c) for c in ("conv", "up", "several")), lists(np.array(costs)), lists(np.array(places))]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "several", "costs", "places"])

    below = T.StructField("several", T.ArrayType(T.StructType([T.StructField("part", T.LongType()), *T.StructType.fromDDL(MATRIX)])))
    schema = T.StructType([parts.schema["conv"], T.StructField("part", T.LongType()), below, *T.StructType.fromDDL(MATRIX)])
    return stored(groups.mapInArrow(multiply, schema), "levels")


def folded(several: list[dict]) -> Folds:
    costs, places = (stacked([s[c] for s in several]) for c in ("costs", "places"))
    return Folds([np.arange(len(several))], costs, places)


def decided(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each conversation what its edits cost and how many rows come at its end; and for each chunk (``conv``, ``chunk``)
    the states before and after it."""
    levels = [parts]
    while (levels[-1].agg(F.max("part")).first()[0] or 0) > 0:
        levels.append(gathered(levels[-1]))

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, places = (stacked(batch.column(c).to_pylist()) for c in ("costs", "places"))
            found = [grammars.last_state(c, p) for c, p in zip(costs, places)]
            columns = [batch.column("conv"), *(pa.array(list(x), pa.int64()) for x in (zip(*found) if found else ([], [], [])))]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "leave", "cost", "missing"])

    schema = T.StructType([parts.schema["conv"], *T.StructType.fromDDL("leave bigint, cost bigint, missing bigint")])
    tops = stored(levels[-1].select("conv", "costs", "places").mapInArrow(end, schema), "ends")
    states = tops.select("conv", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("entry"), "leave")
    shape = states.schema

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, rows = batch.column("conv").to_pylist(), batch.select(["several", "entry", "leave"]).to_pylist()
            out: dict[str, list] = {"conv": [], "part": [], "entry": [], "leave": []}
            for conv, row in zip(convs, rows):
                path = folded(row["several"]).path(0, row["entry"], row["leave"])
                for part, entry, leave in zip(row["several"], path, path[1:]):
                    for name, value in zip(out, (conv, part["part"], entry, leave)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, to_arrow_schema(shape))

    for level in reversed(levels[1:]):
        chosen = level.select("conv", "part", "several").join(renamed(states), same("conv", "part")).select("conv", "several", "entry", "leave")
        states = chosen.mapInArrow(down, shape)
    return tops, states.withColumnRenamed("part", "chunk")


def renamed(states: DataFrame) -> DataFrame:
    return states.select(F.col("conv").alias("of"), F.col("part").alias("of_part"), "entry", "leave")


def same(conv: str, part: str) -> Column:
    return F.col(conv).eqNullSafe(F.col("of")) & (F.col(part) == F.col("of_part"))


def audited(chunks: DataFrame, states: DataFrame, grammar: Grammar) -> DataFrame:
    """The chunks with the ``audit`` of the edits chosen."""
    names = ["conv", "chunk", "blank", "duplicate", "truncated", "illegal"]
    given = renamed(states.withColumnRenamed("chunk", "part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            folds = Folds(sequences(grammar, batch.column("symbols").to_pylist()), grammar.costs, grammar.ranks)
            audits = []
            for n, (entry, leave) in enumerate(zip(batch.column("entry").to_pylist(), batch.column("leave").to_pylist())):
                path = folds.path(n, entry, leave)
                audits.append("".join(grammar.audit(int(s), i, j) for s, i, j in zip(folds.sequences[n], path, path[1:])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(audits, pa.string())], [*names, "audit"])

    schema = T.StructType([*(chunks.schema[c] for c in names), T.StructField("audit", T.StringType())])
    return chunks.join(given, same("conv", "chunk")).select(*names, "symbols", "entry", "leave").mapInArrow(write, schema)


class Editor:
    """Carries out one conversation's audit, row by row: the lines that are left, and what the report says."""

    def __init__(self, cost: int, missing: int) -> None:
        self.cost, self.missing = cost, missing
        self.state, self.audit, self.done, self.pending, self.at = 0, [], 0, "", 0
        self.counts = [0, 0, 0, 0]
        self.low = self.high = self.turn = None
        self.turns = 0
        self.digest = hashlib.sha256()

    def chunk(self, audit: str, counts: list[int]) -> None:
        self.audit.append(audit)
        self.pending, self.at = audit, 0
        self.counts = [a + b for a, b in zip(self.counts, counts)]

    def line(self, edit: str, turn: int | None, role: str, text: str) -> tuple:
        self.digest.update((("\n" if self.done else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.done += 1
        self.state = NEXT[self.state, role[:1]]
        return self.done, edit, turn, role, text

    def insert(self) -> tuple:
        return self.line("I", None, INSERTED[self.state], "")

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if turn is not None:
            # In rising order, so another turn is a new one.
            self.turns += turn != self.turn or not self.turns
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        while self.pending[self.at] == "I":
            self.at += 1
            yield self.insert()
        letter = self.pending[self.at]
        self.at += 1
        if letter != "D":
            yield self.line(letter, turn, INSERTED[self.state] if letter == "R" else role, text)

    def end(self) -> Iterator[tuple]:
        self.audit.append("I" * self.missing)
        for _ in range(self.missing):
            yield self.insert()

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps if gaps < 1 << 63 else None, *self.counts, self.cost, "".join(self.audit), self.digest.hexdigest())


LINE = "line bigint, edit string, turn bigint, role string, text string"
REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
SLICE_ROWS = 2048


def edited(ordered_rows: DataFrame, conv: T.StructField, lines: bool) -> DataFrame:
    """The lines, or the reports, of whole conversations that follow each other in order, read as a stream."""
    schema = T.StructType([conv, *T.StructType.fromDDL(LINE if lines else REPORT)])
    columns = ["conv", "kind", "cost", "missing", "audit", "counts", "turn", "role", "text"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        editor, of = None, None

        def closed() -> Iterator[tuple]:
            if editor is not None:
                rest = [(of, *line) for line in editor.end()]
                yield from rest if lines else [(of, *editor.report())]

        for batch in batches:
            values = [batch.column(c).to_pylist() for c in columns]
            for name, kind, cost, missing, audit, counts, turn, role, text in zip(*values):
                if kind == -1:
                    yield from closed()
                    editor, of = Editor(cost, missing), name
                elif kind == 0:
                    editor.chunk(audit, counts)
                else:
                    for line in editor.row(turn, role, text):
                        if lines:
                            yield of, *line
        yield from closed()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, rows = to_arrow_schema(schema), []
        for row in found(batches):
            rows.append(row)
            if len(rows) == SLICE_ROWS:
                yield pa.RecordBatch.from_pylist([dict(zip(types.names, r)) for r in rows], types)
                rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(types.names, r)) for r in rows], types)

    return ordered_rows.select(*columns).mapInArrow(stream, schema)


def repaired_conversations(
    rows: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> Repaired:
    """The faults of each conversation of ``rows``, the cheapest edits that repair it, and its lines after them.

    ``reports`` has ``conv``, ``gaps`` (turns missing between the first and the last), the numbers of ``blank``, ``duplicate``
    and ``truncated`` rows, each row by its first fault, and of ``illegal`` neighbours, the ``cost`` of the edits, their
    ``audit`` and ``repaired_sha256``, of the lines left as ``role:text``, set apart by line ends. ``lines`` has ``conv``,
    ``line`` from 1, the ``edit`` (K, R or I), ``turn`` (null if inserted), ``role`` and ``text``.

    A conversation is in order if its roles' initials are ``(s?(ua)+)?``. Keeping a row costs nothing, another role (user or
    assistant) 1, deleting it 2, which blank rows and duplicates must be, and inserting an empty user or assistant row 5; a
    truncated row that stays costs 5 more. Of the cheapest edits those count whose initials are ASCII-least.

    Rows go by turn, those without one first; rows of one turn by role, then by a digest of their text. A null role or text is
    one space; null conversations are one of their own. Repeated rows are duplicates. Columns of other names are left out,
    whatever they are called. An empty table gives no rows. A conversation may have any number of rows, and a text any length;
    gaps beyond 64 bits read null.
    """
    placed = ordered(rows, conv_column, turn_column, role_column, text_column)
    chunks = stored(chunked(placed), "chunks")
    grammar = grown(chunks)
    tops, states = decided(matrices(chunks, grammar))
    audits = audited(chunks, states, grammar)

    def aligned(table: DataFrame, **given: Column) -> DataFrame:
        wanted = {
            "position": "bigint", "kind": "int", "cost": "bigint", "missing": "bigint", "audit": "string", "counts": "array<bigint>",
            "turn": "bigint", "role": "string", "text": "string",
        }
        return table.select("conv", *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()])

    col: Callable[[str], Column] = F.col
    heads = aligned(tops, position=F.lit(0), kind=F.lit(-1), cost=col("cost"), missing=col("missing"))
    counts = F.array("blank", "duplicate", "truncated", "illegal")
    parts = aligned(audits, position=col("chunk") * CHUNK + 1, kind=F.lit(0), audit=col("audit"), counts=counts)
    texts = aligned(placed, position=col("position"), kind=F.lit(1), turn=col("turn"), role=col("role"), text=col("text"))
    together = heads.unionByName(parts).unionByName(texts).repartition("conv").sortWithinPartitions("conv", "position", "kind")
    conv = placed.schema["conv"]
    return Repaired(edited(together, conv, False), edited(together, conv, True))
