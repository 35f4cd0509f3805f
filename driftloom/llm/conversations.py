"""Repair of conversation structure by a dynamic program with checkpoints.

Roles must read ``(s?(ua)+)?`` by their initials. Walking backward, the program has for each of the four states of that
pattern the least cost of the rows still to come; it stores these vectors at every sqrt(n)-th row only. Walking forward, it
computes the vectors inside a block again from the block's checkpoint and takes, among the tight edits, the one whose
initial is least.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is spread over tasks as segments. Of the few
conversations that cross a boundary, each segment first gives its 4 x 4 matrix of least costs; chaining those gives the
vectors at the boundaries, which are the checkpoints between tasks, and then the state in which each segment begins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.shared import stored

WHITE = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
NEVER = 1 << 60
#: States: 0 nothing yet, 1 after the opening s, 2 after u, 3 after a; 0 and 3 may end.
ENDS = [0, NEVER, NEVER, 0]
#: State after a user or assistant row is added in each state; there is one choice only.
ADDED = [2, 2, 3, 2]
ROLE = {2: "user", 3: "assistant"}
#: Initials s, u, a and the states they lead to; others lead nowhere.
KEPT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
INITIALS = ["", "s", "u", "a"]
#: Faults of a row; the first two force its deletion. END is no row but the end of a conversation.
SOUND, BLANK, DUPLICATE, CUT, END = range(5)


def _matrices() -> dict[tuple[int, int], list[list[int]]]:
    """Least cost from state to state over inserts and one row, by (initial, fault)."""
    out = {}
    for fault in range(5):
        for initial in range(4):
            m = [[NEVER] * 4 for _ in range(4)]
            for s in range(4):
                at, spent = s, 0
                for _ in range(3):  # three inserts come back to a state already seen
                    steps = []
                    if fault == END:
                        steps += [(at, 0)] if ENDS[at] == 0 else []
                    else:
                        steps.append((at, DELETE))
                        if fault in (SOUND, CUT):
                            extra = TRUNCATED if fault == CUT else 0
                            steps.append((ADDED[at], REROLE + extra))
                            if INITIALS[initial] in KEPT[at]:
                                steps.append((KEPT[at][INITIALS[initial]], extra))
                    for to, cost in steps:
                        m[s][to] = min(m[s][to], spent + cost)
                    at, spent = ADDED[at], spent + INSERT
            out[initial, fault] = m
    return out


MATRICES = _matrices()


def backward(kinds: list[tuple[int, int]], last: list[int]) -> list[int]:
    """Cost vector before the rows, from the vector after them."""
    v = last
    for kind in reversed(kinds):
        m = MATRICES[kind]
        v = [min(a + b for a, b in zip(row, v, strict=True)) for row in m]
    return v


def walk(kinds: list[tuple[int, int]], state: int, last: list[int]) -> tuple[int, str, list[tuple[int, str]], int]:
    """Cheapest edits of the rows from ``state``: cost, ASCII-least audit, (row or -1 for an insert, letter or role) of what stays, end state.

    ``last`` is the cost vector after the rows. Only vectors at block ends are stored; a block's own are computed again.
    """
    n, block = len(kinds), max(1, math.isqrt(len(kinds)))
    starts = list(range(0, n, block))
    checkpoints, v = {}, last
    for b in reversed(starts):
        checkpoints[b] = v
        v = backward(kinds[b : b + block], v)
    total, audit, out = 0, [], []
    for b in starts:
        inside = [checkpoints[b]]
        for kind in reversed(kinds[b : b + block]):
            inside.append(backward([kind], inside[-1]))
        inside.reverse()
        for i, (initial, fault) in enumerate(kinds[b : b + block]):
            here, after = inside[i], inside[i + 1]
            while True:
                need = here[state]
                if fault == END:
                    if ENDS[state] == 0 and after[state] == need:
                        break
                elif DELETE + after[state] == need:
                    audit.append("D")
                    total += DELETE
                    break
                if INSERT + here[ADDED[state]] == need:
                    state = ADDED[state]
                    audit.append("I")
                    out.append((-1, ROLE[state]))
                    total += INSERT
                    continue
                extra = TRUNCATED if fault == CUT else 0
                kept = KEPT[state].get(INITIALS[initial])
                if kept is not None and extra + after[kept] == need:
                    state = kept
                    audit.append("K")
                    out.append((b + i, ""))
                    total += extra
                    break
                state = ADDED[state]
                audit.append("R")
                out.append((b + i, ROLE[state]))
                total += REROLE + extra
                break
    return total, "".join(audit), out, state


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows after the damage that ``crc32(conv:turn) % 20`` decides: id, turn, role, text, copies (0 for a dropped row)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    role = F.when(fate == 4, "user").otherwise(blank(role_col))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long")
    return df.select(
        F.col(conv_col).alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(fate == 0, "").otherwise(role).alias("role"),
        F.when(fate == 0, "").otherwise(text).alias("text"),
        copies.alias("copies"),
    )


def _fault(first: Column) -> Column:
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    return F.when(trimmed == "", BLANK).when(~first, DUPLICATE).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows in conversation order with copies, fault of the first copy, and their segment; written once."""
    key = F.coalesce(F.concat(F.lit("id "), F.col("id").cast("string")), F.lit("null"))
    rows = rows.withColumn("key", key).withColumn("alive", F.col("copies") > 0)
    rows = rows.groupBy("key", "turn", "alive", "role", "text").agg(F.sum("copies").alias("copies"))
    when = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    first = rows.where("alive").groupBy("key", "role", "text").agg(F.min(when).alias("first"))
    rows = rows.join(first, ["key", "role", "text"], "left").withColumn("fault", _fault(when == F.col("first")))
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS[1:])), F.substring("role", 1, 1)), F.lit(0)).cast("int")
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.select("key", "turn", "role", "text", "copies", "fault", initial.alias("initial"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Nulls would turn longs into floats in pandas.
    rows = rows.withColumn("timed", F.col("turn").isNotNull() & (F.col("copies") > 0)).withColumn("turn", F.coalesce("turn", F.lit(0)))
    return stored(rows.withColumn("segment", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "turns")


def _kinds(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """(initial, fault) of each single row: copies after the first are duplicates."""
    return [kind for row in zip(pdf["initial"].tolist(), pdf["fault"].tolist(), pdf["copies"].tolist(), strict=True) for kind in _copies(*row)]


def _copies(initial: int, fault: int, copies: int) -> list[tuple[int, int]]:
    return [(initial, fault)] * min(copies, 1) + [(initial, fault if fault == BLANK else DUPLICATE)] * (copies - 1)


def _piece_matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    kinds = _kinds(pdf.sort_values("seq"))
    columns = [backward(kinds, [0 if j == k else NEVER for j in range(4)]) for k in range(4)]
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "segment": [pdf["segment"].iloc[0]], "matrix": [[min(columns[k][s], NEVER) for s in range(4) for k in range(4)]]})


def _vectors_after(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cost vector after each segment of one conversation; a conversation has at most one segment a partition."""
    pdf = pdf.sort_values("segment", ascending=False)
    v, out = backward([(0, END)], ENDS), []
    for m in pdf["matrix"]:
        out.append(v)
        v = [min(NEVER, *(m[4 * s + k] + v[k] for k in range(4))) for s in range(4)]
    last = [True] + [False] * (len(pdf) - 1)
    return pd.DataFrame({"key": pdf["key"], "segment": pdf["segment"], "after": out, "last": last})


def _piece_ends(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """State after a segment for each state before it (-1 where nothing leads on)."""
    kinds = _kinds(rows.sort_values("seq"))
    after = list(ends["after"].iloc[0])
    before = backward(kinds, after)
    to = [walk(kinds, s, after)[3] if before[s] < NEVER else -1 for s in range(4)]
    return ends.assign(to=[to])


def _states_before(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, state, out = pdf.sort_values("segment"), 0, []
    for to in pdf["to"]:
        out.append(state)
        state = to[state]
    return pdf.assign(before=out)[["key", "segment", "after", "last", "before"]]


def _summary(turns: list[int], kinds: list[tuple[int, int]]) -> tuple:
    """Counts of one piece, from the turns of its rows in order."""
    initials, faults = [k[0] for k in kinds], [k[1] for k in kinds]
    illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:]))
    ends = (turns[0], turns[-1]) if turns else (None, None)
    sides = (initials[0], initials[-1]) if initials else (None, None)
    return (*ends, len(set(turns)), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, *sides)


def _legal(a: int, b: int) -> bool:
    return INITIALS[a] + INITIALS[b] in ("su", "ua", "au")


def _walked(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """A row for each conversation in the segment, or for each line of it besides where it goes on in another segment."""
    crossing = {k.key: k for k in known.itertuples()}
    rows = rows.sort_values("seq")
    columns = [rows[c].tolist() for c in ("key", "turn", "timed", "role", "text", "copies", "fault", "initial")]
    segment, out = int(rows["segment"].iloc[0]) if len(rows) else 0, []
    for key, group in groupby(zip(*columns, strict=True), key=itemgetter(0)):
        single = [(row, kind) for row in group for kind in _copies(row[7], row[6], row[5]) or [None]]
        turns = [row[1] for row, _ in single if row[2]]
        single = [x for x in single if x[1] is not None]
        kinds = [kind for _, kind in single]
        here = crossing.get(key)
        more = [] if here is not None and not here.last else [(0, END)]
        after = ENDS if more else list(here.after)
        cost, audit, stay, _ = walk(kinds + more, 0 if here is None else here.before, after)
        lines = ((role or single[k][0][3]) + ":" + (single[k][0][4] if k >= 0 else "") for k, role in stay)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest() if here is None else None
        out.append((key, segment, 0, *_summary(turns, kinds), cost, audit, digest, None))
        if here is not None:
            out += [(key, segment, i, *[None] * 12, x) for i, x in enumerate(lines, 1)]
    names = ["key", "segment", "number", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "final", "cost", "audit", "sha", "line"]
    return pd.DataFrame(out, columns=names, dtype=object).astype({c: "Int64" for c in names[3:13]})


SUMS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations whose segments and lines come in order: sums, and a digest that is carried from batch to batch."""
    key, total, digest, empty = None, {}, hashlib.sha256(), True

    def done() -> dict[str, object]:
        return total | {"audit": "".join(total["audit"]), "sha": digest.hexdigest()}

    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            if r.key != key:
                if key is not None:
                    out.append(done())
                key, digest, empty = r.key, hashlib.sha256(), True
                total = {"key": r.key, "low": None, "high": None, "turns": 0, "final": None, "audit": []} | dict.fromkeys(SUMS, 0)
            if r.number:
                digest.update((("" if empty else "\n") + r.line).encode())
                empty = False
                continue
            for c in SUMS:
                total[c] += int(getattr(r, c))
            total["audit"].append(r.audit)
            if pd.notna(r.first):
                if total["final"] is not None:
                    total["illegal"] += not _legal(total["final"], int(r.first))
                total["final"] = int(r.final)
            if pd.notna(r.low):
                total["turns"] += int(r.turns) - (total["high"] == int(r.low))
                total["low"] = int(r.low) if total["low"] is None else total["low"]
                total["high"] = int(r.high)
        if out:
            yield _plain(out)
    if key is not None:
        yield _plain([done()])


def _plain(rows: list[dict]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=["key", "low", "high", "turns", *SUMS, "audit", "sha"], dtype=object)
    return found.astype({c: "Int64" for c in ("low", "high", "turns", *SUMS)})


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has id, turn (long), role, text and copies; 0 copies are no row but keep the conversation in the result, which
    then has zeros, an empty audit and the hash of an empty string. A null id is a conversation of its own. Null turns come
    first and do not count in gaps; rows of one turn go by role and text; null roles and texts must be replaced before. A
    row's first fault counts: blank, duplicate (role and text occur earlier, in a blank row or not), truncated. Long
    conversations are worked on in segments; only their digest and audit, one value each, are put together in order in one task,
    line by line. An empty table gives no rows.
    """
    ordered = _ordered(rows)
    crossing = ordered.groupBy("key").agg(F.min("segment").alias("a"), F.max("segment").alias("b")).where("a != b").select("key")
    crossed = ordered.join(stored(crossing, "crossing"), "key", "left_semi").select("key", "segment", "seq", "copies", "fault", "initial")
    pieces = crossed.groupBy("key", "segment").applyInPandas(_piece_matrix, "key string, segment int, matrix array<long>")
    after = "key string, segment int, after array<long>, last boolean"
    ends = stored(pieces.groupBy("key").applyInPandas(_vectors_after, after), "ends")
    both = crossed.groupBy("key", "segment").cogroup(ends.groupBy("key", "segment"))
    states = both.applyInPandas(_piece_ends, after + ", `to` array<int>").groupBy("key").applyInPandas(_states_before, after + ", before int")
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    texts = lambda *names: [T.StructField(c, T.StringType()) for c in names]
    schema = [*texts("key"), T.StructField("segment", T.IntegerType()), *longs("number", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "final", "cost")]
    walks = ordered.groupBy("segment").cogroup(stored(states, "states").groupBy("segment"))
    walks = stored(walks.applyInPandas(_walked, T.StructType([*schema, *texts("audit", "sha", "line")])), "walks")
    in_order = walks.where("sha is null").repartition("key").sortWithinPartitions("key", "segment", "number")
    joined = in_order.mapInPandas(_joined, T.StructType([*texts("key"), *longs("low", "high", "turns", *SUMS), *texts("audit", "sha")]))
    found = walks.where("sha is not null").select(*joined.columns).unionByName(joined)
    number = F.when(F.col("key") != "null", F.substr("key", F.lit(4))).cast(rows.schema["id"].dataType)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return found.select(number.alias("id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("id", "conv_id")


OP13_SQL = """
with recursive
crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) order by b) as t
  from range(256) r(b)),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
  from conversations),
fated as (
  select conv_id, turn, role, text, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::int, 1))::bigint),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as fate
  from keyed, crc_table),
rows_after as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from fated, range(2) r(copy) where fate != 0 and (copy = 0 or fate = 3)),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed
  from rows_after),
faulty as (
  select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair,
    case when trimmed = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
      when right(trimmed, 1) not in ('.', '!', '?') then 't' else '' end as fault
  from numbered),
added as (
  select * from (values (0, 0, '', []::varchar[], 0), (1, 0, '', [], 1), (2, 0, '', [], 2), (3, 0, '', [], 3),
    (0, 3, 'I', ['user:'], 2), (1, 3, 'I', ['user:'], 2), (2, 3, 'I', ['assistant:'], 3), (3, 3, 'I', ['user:'], 2),
    (0, 6, 'II', ['user:', 'assistant:'], 3), (1, 6, 'II', ['user:', 'assistant:'], 3), (2, 6, 'II', ['assistant:', 'user:'], 2), (3, 6, 'II', ['user:', 'assistant:'], 3)
  ) v(s, c, letters, lines, mid)),
moves as (
  select f.conv_id, f.i, a.s, m.e, a.c + m.c + case when f.fault = 't' and m.e != 'D' then 3 else 0 end as c, a.letters || m.e as letters,
    a.lines || case m.e when 'D' then [] when 'K' then [f.role || ':' || f.text] else [case m.next when 2 then 'user:' else 'assistant:' end || f.text] end as lines, m.next
  from faulty f, added a, (values ('D', 4, 0, '', 0), ('D', 4, 1, '', 1), ('D', 4, 2, '', 2), ('D', 4, 3, '', 3),
    ('K', 0, 0, 's', 1), ('K', 0, 0, 'u', 2), ('K', 0, 1, 'u', 2), ('K', 0, 2, 'a', 3), ('K', 0, 3, 'u', 2),
    ('R', 3, 0, '', 2), ('R', 3, 1, '', 2), ('R', 3, 2, '', 3), ('R', 3, 3, '', 2)) m(e, c, mid, initial, next)
  where m.mid = a.mid and (m.e = 'D' or f.fault in ('', 't')) and (m.e != 'K' or m.initial = f.initial)),
best as (
  select distinct f.conv_id, f.n + 1 as i, a.s, a.c, a.letters, a.lines from faulty f, added a where a.mid in (0, 3) and a.s in (0, 1, 2, 3) and (a.s != a.mid or a.c = 0)
    and not (a.s in (0, 3) and a.c > 0)
  union all
  select x.conv_id, x.i, x.s, x.w.c, x.w.letters, x.w.lines from (
    select m.conv_id, m.i, m.s, arg_min(struct_pack(c := m.c + b.c, letters := m.letters || b.letters, lines := m.lines || b.lines), (m.c + b.c, m.letters || b.letters)) as w
    from moves m join best b on m.conv_id is not distinct from b.conv_id and b.i = m.i + 1 and b.s = m.next group by m.conv_id, m.i, m.s) x),
stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(c, 0)::bigint as cost, coalesce(letters, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join stats on o.conv_id is not distinct from stats.conv_id
left join best on o.conv_id is not distinct from best.conv_id and best.i = 1 and best.s = 0
"""
