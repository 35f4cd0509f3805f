"""Conversation repair against a plain recursion over whole conversations."""

import functools
import hashlib
import random
import zlib

import pytest

from driftloom.llm import conversations
from driftloom.llm.conversations import ENDS, backward, damaged, repair_conversations, walk

WHITE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault) by plain recursion with at most two inserts in a row."""

    @functools.cache
    def best(i, state, inserts):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 2:
            role = "assistant" if state == "u" else "user"
            c, audit, lines = best(i, role[0], inserts + 1)
            options.append((c + 3, "I" + audit, (role + ":", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, audit, lines = best(i + 1, state, 0)
            options.append((c + 4, "D" + audit, lines))
            if fault in (None, "truncated"):
                more = 3 * (fault is not None)
                to = NEXT.get((state, role[:1]))
                if to:
                    c, audit, lines = best(i + 1, to, 0)
                    options.append((c + more, "K" + audit, (role + ":" + text, *lines)))
                for other in ("user", "assistant"):
                    to = NEXT.get((state, other[0]))
                    if to:
                        c, audit, lines = best(i + 1, to, 0)
                        options.append((c + more + 3, "R" + audit, (other + ":" + text, *lines)))
        return min(options, default=(10**9, "", ()))

    for i in reversed(range(len(rows))):  # keeps the recursion shallow
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def plain(table):
    """The contract of the query, row by row, in one process."""
    out, by = {}, {}
    for conv, turn, role, text in table:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in by.items():
        after = []
        for turn, role, text in rows:
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            after += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in after:
            short = text.rstrip(WHITE)
            faults.append("blank" if not short else "duplicate" if (role, text) in seen else "truncated" if short[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {t for t, *_ in after if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, lines = cheapest(tuple((role, text, f) for (_, role, text), f in zip(after, faults, strict=True)))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, table, schema="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(table, schema)
    found = repair_conversations(damaged(df)).collect()
    assert len(found) == len({r.id for r in found})
    return {r.id: tuple(r)[1:] for r in found}


def planted(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ursula"]
    texts = ["Hi.", "So?", "cut", " \t\n", "", None, "End! \r\n", "a. ", "x" * 5000 + ".", "é…", "."]
    table = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."
            table.append((conv, rng.choice([turn, turn, turn, turn, None, 2 * turn, 3]), rng.choice(roles[: rng.choice([2, 9])]), text))
    return table


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_equal_recursion(spark, seed):
    table = planted(seed, 60, 14)
    table += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Yes."), (2**61 + 1, 2**60 + 1, "user", "a"), (2**61 + 1, 2**60 + 3, "user", "b.")]
    assert got(spark, table) == plain(table)


def test_long_conversations_cross_segments(spark):
    """One conversation holds most rows, and one many equal rows; both are split over tasks."""
    rng = random.Random(5)
    table = [(7, turn, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"{turn}."])) for turn in range(600)]
    table += [(8, turn, "user", "same.") for turn in range(300)] + [(9, 4, "user", "equal.")] * 150 + planted(3, 20, 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, table) == plain(table)
        ordered = conversations._ordered(damaged(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")))
        assert ordered.where("key = 'id 7'").select("segment").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dropped_null_and_empty_conversations(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    found = got(spark, [(gone, 0, "user", "Hello.")])
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(spark, []) == {}
    table = [(1, None, None, None), (1, None, "user", "x."), (None, None, "assistant", None)]
    assert got(spark, table) == plain(table)
    named = [("a", 1, "user", "Hi.", "clash"), ("a", 2, "assistant", "Ho.", "clash")]
    assert set(got(spark, named, "conv_id string, turn int, role string, text string, copies string")) == {"a"}


def test_blocks_do_not_change_the_walk(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 5, 60):
        kinds = [(rng.randrange(4), rng.randrange(4)) for _ in range(n)] + [(0, conversations.END)]
        found = walk(kinds, 0, ENDS)
        monkeypatch.setattr(conversations.math, "isqrt", lambda n: n)
        assert walk(kinds, 0, ENDS) == found
        monkeypatch.undo()
        assert found[0] == backward(kinds, ENDS)[0]
