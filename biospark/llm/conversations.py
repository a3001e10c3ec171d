"""Repair of conversations: the cheapest edits that make the roles alternate, by depth-first branch and bound.

The rows of a conversation are read by turn (nulls first), then role, then a hash of the text. The first fault of a row counts:
blank (no word), duplicate (its role and text stand earlier in the conversation), truncated (its last character that is
not white space ends no sentence). Each row is kept (0), gets the other role, user or assistant (1), or is deleted (2; blank
and duplicate rows must be); a user or assistant turn with an empty text may be inserted anywhere (5); a truncated row that is not
deleted costs 5 more. The repaired roles are nothing, or an optional system turn and one or more pairs of user and
assistant. Of the cheapest edits those win whose letters (D, I, K, R) come first as a text.

Search: a node is a row and the state that the roles before it lead to. Nodes wait on a stack, the most promising on top. A prefix goes
if its cost and the lower bound of the rest exceed the incumbent's cost, if they equal it and its letters come later,
or if the node's dominance table has a prefix with a lower (cost, letters). The search ends when the stack is empty, which
proves the incumbent. Bounds come from the same rows with the rule relaxed that a lone system turn may not end.

Nothing grows with a conversation but its own rows: rows are range-partitioned by conversation and turn, so a
conversation of any length is spread over partitions, and a task reads its sorted partition as a stream of one letter per
row. Stretches of ``PIECE`` rows are searched for each pair of states at their ends and joined by the cheapest path; an
insertion stands before the next row, so that equal letters mean equal edits. Conversations at the ends of a partition are
joined across partitions through one small row per partition.

Defined cases: null texts and roles are one space; a null conversation identifier is a conversation; turns are whole
numbers, others count as null; a role's initial is its first
character, an empty role has none and can only be changed or deleted; repeated rows of one turn are a row and
its duplicates; an empty table gives an empty result. Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biospark.llm.words import WORD_CLASS, partitions_of, ship_package
from biospark.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
PIECE = 512
# Letters of a row: its role's initial (other than these: x) and its fault, in one character.
INITIALS = "suax"
FAULTS = ("none", "blank", "duplicate", "truncated")
# States by the last role so far; nothing and assistant may end. A user is expected in all but USER.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# What must still be inserted at a conversation's end.
ENDING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
# States that the bounds do not tell apart.
CLASS = (0, 1, 2, 1)
NEVER = 1 << 60
Prefix = tuple[int, str]


def row_code(role: Column, fault: Column) -> Column:
    initial = F.instr(F.lit(INITIALS[:3]), F.substring(role, 1, 1))
    known = F.when((initial > 0) & (role != ""), initial - 1).otherwise(3)
    return F.char(97 + known + 4 * F.array_position(F.array(*map(F.lit, FAULTS)), fault).cast("int") - 4)


def _read(code: str) -> tuple[str, str]:
    number = ord(code) - 97
    return INITIALS[number % 4], FAULTS[number // 4]


def _expected(state: int) -> str:
    return "a" if state == USER else "u"


@lru_cache(maxsize=None)
def _moves(code: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of what can be done with a row."""
    initial, fault = _read(code)
    moves = [("D", DELETE, state)]
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        if (state, initial) in STEP:
            moves.append(("K", KEEP + extra, STEP[state, initial]))
        moves.append(("R", REROLE + extra, STEP[state, _expected(state)]))
    return tuple(moves)


def _bounds(codes: str, ends: Iterable[int], trailing: bool) -> list[list[int]]:
    """For every row and class of states: no way from here to one of ``ends`` is cheaper."""
    last = [NEVER] * 3
    for end in ends:
        last[CLASS[end]] = 0
    if trailing:
        # A lone system turn counts as an end here.
        last = [0, 0, INSERT]
    out = [last]
    for code in reversed(codes):
        after, here = out[-1], [NEVER] * 3
        for state in (NOTHING, ASSISTANT, USER):
            here[CLASS[state]] = min(cost + after[CLASS[to]] for _, cost, to in _moves(code, state))
        use, reply = here[1], here[2]
        here[1], here[2] = min(use, INSERT + reply), min(reply, INSERT + use)
        here[0] = min(here[0], INSERT + here[2])
        out.append(here)
    return out[::-1]


def search(codes: str, start: int, ends: tuple[int, ...], trailing: bool = False) -> Prefix | None:
    """The cheapest (cost, letters) from state ``start`` to one of ``ends``; ``trailing``: insertions may follow the last row."""
    bounds, size = _bounds(codes, ends, trailing), len(codes)
    best: Prefix | None = None
    table: list[dict[int, Prefix]] = [{} for _ in range(size + 1)]
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, letters = stack.pop()
        prefix = (cost, letters)
        if state in table[at] and table[at][state] <= prefix:
            continue
        bound = cost + bounds[at][CLASS[state]]
        if bound >= NEVER:
            continue
        if best and (bound > best[0] or bound == best[0] and letters > best[1][: len(letters)]):
            continue
        table[at][state] = prefix
        if at == size and state in ends and (best is None or prefix < best):
            best = prefix
        ways = []
        if at < size:
            ways = [(at + 1, to, cost + c, letters + letter) for letter, c, to in _moves(codes[at], state)]
        if at < size or trailing:
            ways.append((at, STEP[state, _expected(state)], cost + INSERT, letters + "I"))
        # The last one pushed is looked at first: the lowest bound, then the first letter.
        ways.sort(key=lambda w: (w[2] + bounds[w[0]][CLASS[w[1]]], w[3]), reverse=True)
        stack += ways
    return best


Table = dict[tuple[int, int], Prefix]


def tables(codes: str, starts: tuple[int, ...], piece: int = PIECE) -> list[Table]:
    """For every stretch of rows the cheapest way between every two states."""
    out = []
    for low in range(0, len(codes), piece):
        part = codes[low : low + piece]
        found = {(a, b): search(part, a, (b,)) for a in (starts if low == 0 else range(4)) for b in range(4)}
        out.append({k: v for k, v in found.items() if v})
    return out


def cheapest(steps: list[dict[tuple[int, int], tuple]], start: int, last: dict[int, tuple]) -> list[int] | None:
    """The states between the steps, for (cost, tie order) per pair of states; ``last``: the same per last state.

    A tie in cost goes to the first step that differs: letters there differ, and none begins with the other's.
    """
    rest = [{s: v[0] for s, v in last.items()}]
    for step in reversed(steps[1:]):
        costs: dict[int, int] = {}
        for (a, b), (cost, _) in step.items():
            if b in rest[-1]:
                costs[a] = min(costs.get(a, NEVER), cost + rest[-1][b])
        rest.append(costs)
    state, path = start, []
    for number, (step, left) in enumerate(zip(steps, reversed(rest))):
        final = number == len(steps) - 1
        ways = []
        for (a, b), (cost, order) in step.items():
            if a == state and b in left:
                ways.append((cost + left[b], order + last[b][1] if final and isinstance(order, str) else order, b))
        if not ways:
            return None
        state = min(ways)[2]
        path.append(state)
    return path


def _joined(steps: list[Table], start: int, last: dict[int, tuple]) -> Prefix | None:
    path = cheapest(steps, start, last)
    if path is None:
        return None
    ways = [step[a, b] for step, a, b in zip(steps, [start, *path], path)]
    end = last[path[-1] if path else start]
    return sum(w[0] for w in ways) + end[0], "".join(w[1] for w in ways) + end[1]


ENDS = {state: (INSERT * len(letters), letters) for state, letters in ENDING.items()}


def edits(codes: str, piece: int = PIECE) -> Prefix:
    """The cheapest (cost, letters) of a whole conversation."""
    if len(codes) <= piece:
        return search(codes, NOTHING, (NOTHING, ASSISTANT), trailing=True)
    return _joined(tables(codes, (NOTHING,), piece), NOTHING, ENDS)


def between(codes: str, piece: int = PIECE) -> Table:
    """The cheapest way between every two states for the rows of a conversation that one partition has."""
    steps = tables(codes, tuple(range(4)), piece)
    found = {(a, b): _joined(steps, a, {b: (0, "")}) for a in range(4) for b in range(4)}
    return {k: v for k, v in found.items() if v}


def row_edits(codes: str, letters: str, start: int) -> list[tuple[str, str]]:
    """Per row its letters (insertions before it, its own, after the last row also those behind) and the initials they give."""
    out, state, done, roles = [], start, "", ""
    row = iter(codes)
    for letter in letters:
        if letter in "IR":
            role = _expected(state)
        elif letter == "K":
            role = None
        else:
            role = "-"
        code = None if letter == "I" else next(row)
        role = role or _read(code)[0]
        state = state if role == "-" else STEP[state, role]
        done, roles = done + letter, roles + role
        if code:
            out.append((done, roles))
            done, roles = "", ""
    if done:
        out[-1] = (out[-1][0] + done, out[-1][1] + roles)
    return out


SOLVED = "key string, pid int, at long, rid long, code string, edits string, roles string"


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of the conversations inside a sorted partition; none for the first and the last, which may go on elsewhere."""
    pid, at = TaskContext.get().partitionId(), 0
    names = ["key", "pid", "at", "rid", "code", "edits", "roles"]
    key, rids, codes, first = None, [], [], True

    def done(open_end: bool) -> Iterator[tuple]:
        nonlocal at
        found = [(None, None)] * len(rids)
        if not open_end:
            line = "".join(codes)
            found = row_edits(line, edits(line)[1], NOTHING)
        for rid, code, (letters, roles) in zip(rids, codes, found):
            yield key, pid, at, rid, code, letters, roles
            at += 1

    for batch in batches:
        ready = []
        for k, rid, code in zip(batch["key"], batch["rid"], batch["code"]):
            if k != key:
                if rids:
                    ready += done(first)
                    first = False
                key, rids, codes = k, [], []
            rids.append(rid)
            codes.append(code)
        if ready:
            yield pd.DataFrame(ready, columns=names)
    if rids:
        yield pd.DataFrame(done(True), columns=names)


def _table_row(part: pd.DataFrame) -> pd.DataFrame:
    """A partition's share of a conversation as costs per pair of states and how their letters rank, inside and at the end."""
    part = part.sort_values("at")
    found = between("".join(part["code"]))
    rows = []
    for (a, b), (cost, letters) in found.items():
        ways = {e: v[1] for (s, e), v in found.items() if s == a}
        inside = sum(w < letters for w in ways.values())
        ending = sum(w + ENDING[e] < letters + ENDING[b] for e, w in ways.items())
        rows.append((part["key"].iloc[0], int(part["pid"].iloc[0]), a, b, cost, inside, ending))
    return pd.DataFrame(rows, columns=["key", "pid", "enter", "leave", "cost", "inside", "ending"])


def _path(parts: pd.DataFrame) -> pd.DataFrame:
    """Through which states the cheapest edits pass from partition to partition."""
    pids = sorted(parts["pid"].unique())
    steps = []
    for pid in pids:
        order = "ending" if pid == pids[-1] else "inside"
        rows = parts[parts["pid"] == pid]
        steps.append({(a, b): (c, o) for a, b, c, o in zip(rows["enter"], rows["leave"], rows["cost"], rows[order])})
    path = cheapest(steps, NOTHING, {s: (v[0], 0) for s, v in ENDS.items()})
    return pd.DataFrame(
        {
            "key": parts["key"].iloc[0], "pid": pids, "enter": [NOTHING, *path[:-1]], "leave": path,
            "closing": [p == pids[-1] for p in pids],
        }
    )


def _apply(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("at")
    enter, leave, closing = (part[c].iloc[0] for c in ("enter", "leave", "closing"))
    line = "".join(part["code"])
    letters = between(line)[enter, leave][1] + (ENDING[leave] if closing else "")
    found = row_edits(line, letters, enter)
    out = part[["key", "pid", "at", "rid", "code"]]
    return out.assign(edits=[e for e, _ in found], roles=[r for _, r in found])


def _solved(placed: DataFrame) -> DataFrame:
    """``SOLVED`` rows for ``placed(key, rid, code)``, which is sorted over ordered partitions."""
    solved = stage(placed.select("key", "rid", "code").mapInPandas(_solve, SOLVED))
    ends = solved.filter("edits is null")
    ways = ends.groupBy("key", "pid").applyInPandas(
        _table_row, "key string, pid int, enter int, leave int, cost long, inside int, ending int"
    )
    path = stage(ways.groupBy("key").applyInPandas(_path, "key string, pid int, enter int, leave int, closing boolean"))
    given = ends.join(path, ["key", "pid"]).groupBy("key", "pid").applyInPandas(_apply, SOLVED)
    return solved.filter("edits is not null").unionByName(given)


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``rows`` and one per inserted turn: conversation, turn, fault, old role and text, edit (K, R, D, I), new
    role and text (null where deleted), in the order (pid, at, place) inside a conversation."""
    ship_package(rows.sparkSession)
    given = stage(
        rows.select(
            F.monotonically_increasing_id().alias("rid"), F.col(conv_col).alias("conv"),
            F.col(turn_col).try_cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
        )
    )
    narrow = given.select(
        "rid", "turn", "role",
        # A null identifier sorts as the empty text, all others behind a mark.
        F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("key"),
        F.unhex(F.sha2("text", 256)).alias("hash"),
        (~F.col("text").rlike(WORD_CLASS)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
    )
    same = ["key", "role", "hash"]
    repeated = narrow.filter("not blank").groupBy(*same).agg(F.min(F.struct("turn", "rid")).alias("first"), F.count("*").alias("n"))
    repeated = stage(repeated.filter("n > 1").select(*same, F.col("first.rid").alias("first")))
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("first") != F.col("rid"), "duplicate")
        .when(F.col("open"), "truncated").otherwise("none")
    )
    judged = narrow.join(repeated, same, "left").withColumn("code", row_code(F.col("role"), fault))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "hash", "rid"]
    placed = judged.repartitionByRange(partitions_of(rows), *order).sortWithinPartitions(*order)
    solved = _solved(placed).select("rid", "pid", "at", "code", "edits", "roles")

    each = given.join(solved, "rid").select(
        "*", F.explode(F.sequence(F.lit(1), F.length("edits"))).alias("place")
    ).withColumns({"edit": F.expr("substring(edits, place, 1)"), "initial": F.expr("substring(roles, place, 1)")})
    inserted, new = F.col("edit") == "I", F.when(F.col("initial") == "u", "user").otherwise("assistant")
    old = lambda c: F.when(~inserted, F.col(c))
    faults = F.array(*map(F.lit, FAULTS))
    return each.select(
        F.col("conv").alias(conv_col), "pid", "at", "place", old("turn").alias("turn"),
        old("code").alias("code"),
        F.when(~inserted, F.get(faults, F.floor((F.ascii("code") - 97) / 4).cast("int"))).alias("fault"),
        old("role").alias("old_role"), old("text").alias("old_text"), "edit",
        F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") != "D", new).alias("role"),
        F.when(inserted, "").when(F.col("edit") != "D", F.col("text")).alias("text"),
    )


def report(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``repair``'s result: gaps, counts of faults and of illegal neighbours, cost, audit, and the
    SHA-256 of the repaired lines ``role:text``. A conversation's rows pass through one task as a stream, because a
    SHA-256 is a chain; only its letters are held."""
    kind = repaired.schema[conv_col].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    legal = {"su", "ua", "au"}
    cost = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None

        def done(states: list) -> pa.RecordBatch:
            ids = pa.concat_arrays([s["conv"] for s in states])
            values = [[s[n] for s in states] for n in names[1:6]]
            gaps = [s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0 for s in states]
            columns = [ids, pa.array(gaps, pa.int64()), *[pa.array(v, pa.int64()) for v in values]]
            columns.append(pa.array(["".join(s["letters"]) for s in states], pa.string()))
            columns.append(pa.array([s["hash"].hexdigest() for s in states], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=[conv_col, *names])

        for batch in batches:
            ready = []
            columns = [batch.column(c).to_pylist() for c in ("key", "turn", "code", "edit", "role", "text")]
            for i, (k, turn, code, edit, role, text) in enumerate(zip(*columns)):
                if k != key or now is None:
                    if now:
                        ready.append(now)
                    key = k
                    now = dict.fromkeys(names[1:6], 0) | {"conv": batch.column("conv").slice(i, 1), "turns": 0, "before": "", "text": False}
                    now |= {"letters": [], "hash": sha256(), "last": None, "low": None, "high": None}
                now["letters"].append(edit)
                now["cost"] += cost[edit]
                if code is not None:
                    initial, fault = _read(code)
                    if fault != "none":
                        now[fault] += 1
                    if fault == "truncated" and edit != "D":
                        now["cost"] += TRUNCATED
                    if now["before"] and now["before"] + initial not in legal:
                        now["illegal"] += 1
                    now["before"] = initial
                    if turn is not None and turn != now["last"]:
                        now |= {"last": turn, "high": turn, "low": turn if now["low"] is None else now["low"]}
                        now["turns"] += 1
                if edit != "D":
                    now["hash"].update((("\n" if now["text"] else "") + f"{role}:{text}").encode())
                    now["text"] = True
            if ready:
                yield done(ready)
        if now:
            yield done([now])

    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("key")
    rows = repaired.select(F.col(conv_col).alias("conv"), key, "pid", "at", "place", "turn", "code", "edit", "role", "text")
    order = ["key", "pid", "at", "place"]
    placed = rows.repartition("key").sortWithinPartitions(*order)
    longs = ", ".join(f"{n} long" for n in names[:6])
    return placed.mapInArrow(run, f"{conv_col} {kind}, {longs}, audit string, repaired_sha256 string")


def damage(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Faults to test repairs with, by ``crc32(conversation:turn) % 20``: 0 drops the row, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it, 4 makes it a user's. Nulls are one space in the key, roles and texts."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col, role_col, text_col)]
    chance = F.pmod(F.crc32(F.concat_ws(":", *written[:2]).cast("binary")), F.lit(20))
    chosen = rows.select(
        F.col(conv_col).alias(conv_col), F.col(turn_col).alias(turn_col), written[2].alias(role_col), written[3].alias(text_col),
        chance.alias("__chance"),
    ).filter("__chance <> 0")
    at = F.col("__chance")
    text = F.when(at == 1, "").when(at == 2, F.translate(F.col(text_col), ".!?", "")).otherwise(F.col(text_col))
    copies = F.when(at == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return chosen.select(
        conv_col, turn_col, F.when(at == 4, "user").otherwise(F.col(role_col)).alias(role_col), text.alias(text_col),
        F.explode(copies).alias("__copy"),
    ).drop("__copy")


def repair_report(
    rows: DataFrame, damaged: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``report`` of the repaired ``damaged`` rows, with a row of zeros for each conversation of ``rows`` that has none left."""
    found = report(repair(damaged, conv_col, turn_col, role_col, text_col), conv_col).withColumnRenamed(conv_col, "__conv")
    ids = rows.select(conv_col).distinct()
    joined = ids.join(found, ids[conv_col].eqNullSafe(found["__conv"]), "left").drop("__conv")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(sha256(b"").hexdigest())}
    return joined.withColumns({
        c: F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))) for c in joined.columns if c != conv_col
    })
