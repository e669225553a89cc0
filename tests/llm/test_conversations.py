"""Conversation repair against all edits, state by state, and the grammar's matrices against plain ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from labspark.llm import conversations, repair_grammar
from labspark.llm.conversations import repaired_conversations
from labspark.llm.queries import QUERIES, damaged
from labspark.llm.repair_grammar import SYMBOLS, Folds, Grammar

TABLE = "conv_id long, turn long, role string, text string"
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INSERT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost, audit and lines of the best edits of (role, text, must go, cut off)."""

    def with_inserts(best):
        out = dict(best)
        for _ in range(4):
            for state, (cost, audit, lines) in list(out.items()):
                to, role = INSERT[state]
                found = (cost + 5, audit + "I", [*lines, ("I", None, role, "")])
                if to not in out or found[:2] < out[to][:2]:
                    out[to] = found
        return out

    best = {0: (0, "", [])}
    for turn, role, text, must_go, cut in rows:
        new = {}
        for state, (cost, audit, lines) in with_inserts(best).items():
            moves = [(2, "D", state, [])]
            if not must_go:
                more = 5 if cut else 0
                if (state, role[:1]) in AFTER:
                    moves.append((more, "K", AFTER[state, role[:1]], [("K", turn, role, text)]))
                to, name = INSERT[state]
                moves.append((1 + more, "R", to, [("R", turn, name, text)]))
            for price, letter, to, line in moves:
                found = (cost + price, audit + letter, lines + line)
                if to not in new or found[:2] < new[to][:2]:
                    new[to] = found
        best = new
    end = with_inserts(best)
    return min((end[s] for s in (0, 3) if s in end), key=lambda e: e[:2])


def digest(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def brute(rows):
    """The report and the lines of one conversation of (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[2])))
    seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
    for turn, role, text in rows:
        kept = text.rstrip(SPACE)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
        seen.add((role, text))
        n[fault] += 1
        marked.append((turn, role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, lines = cheapest(marked)
    whole = digest("\n".join(f"{role}:{text}" for _, _, role, text in lines))
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, whole), lines


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def compare(spark, rows, table=None):
    found = repaired_conversations(spark.createDataFrame(rows, TABLE) if table is None else table)
    reports = {r[0]: tuple(r)[1:] for r in found.reports.collect()}
    lines = by_conversation(found.lines.collect())
    want = {conv: brute(r) for conv, r in by_conversation(rows).items()}
    assert {c: (reports.get(c), w[0]) for c, w in want.items() if reports.get(c) != w[0]} == {}
    assert len(reports) == len(want)
    assert {c: sorted(v) for c, v in lines.items()} == {c: [(n, *x) for n, x in enumerate(w[1], 1)] for c, w in want.items() if w[1]}
    return want


def random_conversations(seed, n=60, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "u", "tool", "", None, ["user", "assistant"][turn % 2], ["user", "assistant"][turn % 2]])
            text = rng.choice([f"said {rng.randrange(99)}.", f"asked {rng.randrange(99)}?\n", "same!", "cut off", "", " \t", None, f"plain {turn}. "])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), role, text))
    rng.shuffle(rows)
    return rows


def test_random_conversations(spark):
    want = compare(spark, random_conversations(1))
    audits = "".join(w[0][6] for w in want.values())
    # Deleting a row is cheaper than inserting one beside it.
    assert set(audits) == set("DKR")


def test_conversations_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 3)
    monkeypatch.setattr(conversations, "FAN", 2)
    compare(spark, random_conversations(2, n=12, longest=60))


def test_without_rules(spark, monkeypatch):
    monkeypatch.setattr(conversations, "ROUNDS", 0)
    compare(spark, random_conversations(3, n=20))


def test_one_long_conversation_of_few_texts(spark):
    """Several thousand rows of one conversation, most of them alike, and long texts."""
    rows = [(1, t, ["user", "assistant"][t % 2], "the same." if t % 3 else f"new {t}.") for t in range(5000)]
    rows += [(2, 0, "user", "word " * 40_000 + "."), (2, 1, "assistant", "x" * 200_000)]
    compare(spark, rows)


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, ties, other scripts, extreme turns, extra columns with clashing names."""
    rows = [(None, None, None, None), (None, 1, "user", "hi."), (None, 1, "user", "hi."), (None, 1, "assistant", "ho."), (3, None, "user", "")]
    rows += [(4, -5, "user", "日本。"), (4, 7, "assistant", "😀!"), (5, -(1 << 62), "user", "a."), (5, 1 << 61, "user", "b.")]
    table = spark.createDataFrame(rows, TABLE)
    for name in ("conv", "position", "chunk", "kind", "key", "entry", "digest", "audit", "line", "part"):
        table = table.withColumn(name, table.text)
    want = compare(spark, rows, table)
    assert want[3][0][5:7] == (2, "D")


def test_empty_table(spark):
    found = repaired_conversations(spark.createDataFrame([], TABLE))
    assert found.reports.count() == found.lines.count() == 0


def test_query(spark, sf):
    """Every conversation of the table, those that lose all rows to the damage too."""
    raw = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = {c: [] for c, *_ in raw}
    for conv, turn, role, text in raw:
        n = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        left[conv] += [(turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert found == {c: brute(rows)[0] for c, rows in left.items()}


def test_damage_of_nulls(spark, tmp_path):
    rows = [(None, t, None, None) for t in range(40)] + [(c, None, "user", "x.") for c in range(40)]
    want = []
    for conv, turn, role, text in rows:
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if n == 1 else text.replace(".", "") if n == 2 else text
        want += [(conv, turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    got = [tuple(r)[:4] for r in damaged(spark.createDataFrame(rows, TABLE)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    spark.createDataFrame(rows, TABLE).write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    assert {r.conv_id for r in found} == {None, *range(40)}
    assert all((r.cost, r.audit, r.repaired_sha256) == (0, "", digest("")) for r in found if r.conv_id is not None and not any(w[0] == r.conv_id for w in want))


@pytest.mark.parametrize("seed", range(3))
def test_rules_change_no_matrix(seed):
    """Folding with rules, of runs as well, gives the costs, ranks and audits of folding terminals one by one."""
    rng = random.Random(seed)
    texts = ["".join(rng.choices(SYMBOLS, weights=[1, 6, 6, 1, 1, 1, 1, 1, 2], k=rng.randrange(1, 40))) for _ in range(80)] + ["u" * 33, "xx", "x"]
    grammar = Grammar()
    for _ in range(5):
        flat = grammar.rewritten(repair_grammar.flattened(texts))
        a, b, n = repair_grammar.pair_counts(flat)
        order = np.lexsort((b, a, -n))
        pairs = repair_grammar.chosen([(int(a[i]), int(b[i])) for i in order if n[i] >= 2], 20)
        grammar.add(pairs)
    assert len(grammar) > len(SYMBOLS) + 20
    plain = Folds(conversations.sequences(Grammar(), texts), grammar.costs, grammar.ranks)
    ruled = Folds(conversations.sequences(grammar, texts), grammar.costs, grammar.ranks)
    assert sum(map(len, ruled.sequences)) < 0.6 * sum(map(len, plain.sequences))
    assert (plain.costs == ruled.costs).all()
    possible = plain.costs < repair_grammar.IMPOSSIBLE
    assert (plain.places == ruled.places)[possible].all()
    for n in range(len(texts)):
        for i in range(4):
            for j in np.flatnonzero(possible[n, i]):
                spelled = ["".join(grammar.audit(int(s), p, q) for s, p, q in zip(f.sequences[n], path, path[1:])) for f in (plain, ruled) for path in [f.path(n, i, int(j))]]
                assert spelled[0] == spelled[1]
