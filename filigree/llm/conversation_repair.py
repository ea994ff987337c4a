"""Repair of damaged conversations: the cheapest edits, and of these the least audit string.

A repaired conversation's roles are an optional system turn and then pairs of user and assistant, or
nothing. Edits are arcs between nodes (place, state of that pattern); from a state each edit leads to
one state, so an audit string (the edits' initials) says which edits were made.

Rows are range-partitioned in order, so a conversation of any length lies in pieces, none larger than
a partition. In a piece a cost DP runs backwards from each state that it may be left in. The nodes
are then ranked by the first audit letter on cheapest arcs, by the first two, four, eight and so on:
the rank of twice the length is that of the pair (own rank, rank of the node that the doubled pointer
leads to), and paths grow along the same pointers. What a piece hands on is sixteen costs, ranks and
audit strings. One pass over the pieces of a conversation then picks how each is entered and left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import ordered
from .work import BLANKS, range_parts, read, stored

#: Bounds of a piece: turns, and code points of text (beyond one turn).
ROWS, CHARS = 100_000, 1 << 24
#: Characters that are handed on at once to be digested, beyond one turn.
CHUNK = 1 << 13
#: Costs of edits.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The only role that may be put in, by state: where it leads, and what it is.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
_PUT = ["user", "user", "assistant", "user"]
#: Where a turn may be kept: state by initial (s, u, a, other); -1: nowhere.
_KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: Inserts that end a conversation, by state.
_TAIL = [0, 2, 1, 0]
#: Letters in ASCII order; 0 ends a piece, 5 is a dead end.
_LETTERS = " DIKR "
_LEGAL = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)
_FAR = 1 << 40
_ID = "conv bigint, no_id boolean"


def _blank(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS)) == ""


def damaged(conversations: DataFrame) -> DataFrame:
    """The table with faults put in, by crc32 of ``conv_id:turn`` modulo 20; a null is one space there.

    0 drops the row, 1 empties its text, 2 takes out its full stops and marks, 3 repeats it, 4 makes it the user's.
    """
    written_out = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(written_out("conv_id"), F.lit(":"), written_out("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), code.alias("code"))
    rows = rows.where("code <> 0").withColumns({
        "text": F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("code") == 4, "user").otherwise(F.col("role")),
    })
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("col")


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """Turns by conversation and turn (null first; ties by role, then text), written: conv, no_id, turn,
    role, text (null: one space), init (0 to 3: the role begins with s, u, a, anything else), blank,
    cut (the text stops without a full stop or mark), same (digest of role and text), pos, part."""
    full = lambda c: F.coalesce(F.col(c), F.lit(" "))
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(F.coalesce(conv, F.lit(0)).alias("conv"), conv.isNull().alias("no_id"), F.col("turn").cast("long").alias("turn"), full("role").alias("role"), full("text").alias("text"))
    n, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(range_parts(rows, n, ROWS // 2), range_parts(rows, chars or 0, CHARS // 2))
    initial = F.left("role", F.lit(1))
    init = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).cast("byte")
    cut = ~F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    keep = ["conv", "no_id", "turn", "role", "text", init.alias("init"), _blank(F.col("text")).alias("blank"), cut.alias("cut"), same.alias("same")]
    return ordered(rows, ["conv", "no_id"], ["turn", "role", "text"], "turns", keep, parts)


def faults(turns: DataFrame) -> DataFrame:
    """(conv, no_id, turn, init, fault, pos, part), written. fault: 0 none, 1 blank, 2 duplicate (role and
    text seen earlier in the conversation), 3 truncated; the first that holds."""
    firsts = turns.groupBy("conv", "no_id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    rows = turns.select("conv", "no_id", "turn", "init", "blank", "cut", "pos", "part").join(firsts.hint("merge"), "pos", "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0).cast("byte")
    return stored(rows.select("conv", "no_id", "turn", "init", fault.alias("fault"), "pos", "part"), "faults")


def _costs(init: np.ndarray, fault: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, first letter and next node of every node, all pieces at once, by places from the end.

    A piece of n turns has n + 1 places; a node is (place, state the piece is left in, state). Inserts
    belong to the piece of the turn that follows.
    """
    first = starts + np.arange(starts.size)  # first place of each piece
    places = int(sizes.sum()) + sizes.size
    cost = np.full((places, 4, 4), _FAR, np.int64)
    letter = np.full((places, 4, 4), 5, np.int8)
    to = np.arange(places * 16).reshape(places, 4, 4)
    ends = first + sizes
    cost[ends[:, None], np.arange(4), np.arange(4)] = 0
    letter[ends[:, None], np.arange(4), np.arange(4)] = 0
    order = np.argsort(-sizes, kind="stable")
    lengths = -sizes[order]
    grid = np.arange(16).reshape(4, 4)
    left = grid - grid % 4
    for back in range(1, int(sizes.max()) + 1):
        own = order[: np.searchsorted(lengths, -back, side="right")]
        place, row = ends[own] - back, starts[own] + sizes[own] - back
        after, bad = cost[place + 1], (fault[row] == 1) | (fault[row] == 2)
        cut = np.where(fault[row] == 3, CUT, 0)[:, None, None]
        kept = _KEEP[:, init[row]].T
        keep = np.where((bad[:, None] | (kept < 0))[:, None, :], _FAR, np.take_along_axis(after, np.maximum(kept, 0)[:, None, :].repeat(4, 1), 2) + cut)
        rerole = np.where(bad[:, None, None], _FAR, after[:, :, _NEXT] + REROLE + cut)
        delete = after + DELETE
        least = np.minimum(np.minimum(keep, rerole), delete)
        once = np.minimum(least, least[:, :, _NEXT] + INSERT)
        best = np.minimum(once, once[:, :, _NEXT] + INSERT)
        insert = best[:, :, _NEXT] + INSERT
        live = best < _FAR
        cost[place] = np.where(live, best, _FAR)
        which = np.select([~live, delete == best, insert == best, keep == best], [5, 1, 2, 3], 4)
        letter[place] = which
        here, there = place[:, None, None] * 16, (place[:, None, None] + 1) * 16
        state = np.select([which == 1, which == 3], [grid % 4 + 0 * which, np.maximum(kept, 0)[:, None, :] + 0 * which], _NEXT[grid % 4] + 0 * which)
        to[place] = np.select([~live, which == 2], [here + grid, here + left + state], there + left + state)
    return cost.reshape(-1), letter.reshape(-1), to.reshape(-1)


def _ranked(letter: np.ndarray, to: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, dict[int, str]]:
    """Ranks of all nodes by whole audit string, and the strings of the nodes ``asked`` for.

    After round k a rank orders nodes by their first 2**k letters, the pointer leads 2**k letters on,
    and 2**k nodes of each asked path are known. A path that has met its end is read off and leaves.
    """
    rank, jump = letter.astype(np.int64), to.copy()
    paths, left, out = asked[:, None], asked, {}
    glyph = np.frombuffer(_LETTERS.encode(), np.uint8)
    while True:
        met = letter[paths[:, -1]] == 0
        for node, path in zip(left[met].tolist(), paths[met], strict=True):
            out[node] = glyph[letter[path]].tobytes().rstrip(b" ").decode()
        paths, left = paths[~met], left[~met]
        if (jump == jump[jump]).all() and not left.size:
            break
        if left.size:
            paths = np.concatenate([paths, jump[paths]], axis=1)
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)
        jump = jump[jump]
    _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)
    return rank, out


_PIECES = f"{_ID}, part bigint, at bigint, n bigint, costs array<bigint>, ranks array<bigint>, audits array<string>, illegal bigint, first_init int, last_init int"


def _arrow_schema(spec: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in spec.split(", "))])


def _solved(table: pa.Table) -> pa.Table:
    """The pieces of one partition. Index of the sixteen: 4 * entered in + left in."""
    table = table.sort_by("pos")
    conv, no_id, init, fault, pos, part = (table.column(c).to_numpy() for c in ("conv", "no_id", "init", "fault", "pos", "part"))
    new = np.concatenate([[True], (conv[1:] != conv[:-1]) | (no_id[1:] != no_id[:-1])])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([starts, [conv.size]]))
    cost, letter, to = _costs(init, fault, starts, sizes)
    base = (starts + np.arange(starts.size)) * 16
    asked = base[:, None] + (4 * np.arange(4)[None, :] + np.arange(4)[:, None]).reshape(-1)  # (entered, left)
    # Only the first piece can be continued from the partition before; all others begin empty.
    asked_flat = np.concatenate([asked[0], asked[1:, :4].reshape(-1)])
    rank, audits = _ranked(letter, to, asked_flat[cost[asked_flat] < _FAR])
    legal = _LEGAL[init[:-1], init[1:]] | new[1:]
    illegal = np.add.reduceat(np.concatenate([[0], (~legal).astype(np.int64)]), starts)
    lists = lambda v: [x.tolist() for x in v[asked]]
    return pa.table(
        [conv[starts], no_id[starts], part[starts], pos[starts], sizes, lists(cost), lists(rank), [[audits.get(a) for a in own] for own in asked.tolist()], illegal, init[starts].astype(np.int32), init[starts + sizes - 1].astype(np.int32)],
        schema=_arrow_schema(_PIECES),
    )


_PICKS = f"{_ID}, at bigint, entered int, departed int, alone boolean, final boolean, cost bigint, illegal bigint"


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each piece of a conversation is entered and left; a conversation's pieces come last first.

    cost (of the whole conversation) and illegal (pairs of turns) stand at its last piece, 0 at others.
    """
    finish = [INSERT * n for n in _TAIL]
    schema = _arrow_schema(_PICKS)
    held: list[tuple] = []

    def done() -> list[dict]:
        rows, state = [], EMPTY
        total = held[-1][1][EMPTY]
        wrong = sum(h[3] for h in held) + sum(not _LEGAL[before[5], after[4]] for after, before in zip(held, held[1:], strict=False))
        for k, (at, _, ways, _, _, _) in reversed(list(enumerate(held))):
            rows.append({"conv": now[0], "no_id": now[1], "at": at, "entered": state, "departed": ways[state], "alone": len(held) == 1, "final": k == 0, "cost": 0 if k else total, "illegal": 0 if k else int(wrong)})
            state = ways[state]
        return rows

    now = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if (r["conv"], r["no_id"]) != now:
                out += done() if held else []
                now, held = (r["conv"], r["no_id"]), []
            on = held[-1][1] if held else finish
            ways = [min(range(4), key=lambda t, q=q: (r["costs"][4 * q + t] + on[t], r["ranks"][4 * q + t])) for q in range(4)]
            held.append((r["at"], [min(_FAR, r["costs"][4 * q + t] + on[t]) for q, t in enumerate(ways)], ways, r["illegal"], r["first_init"], r["last_init"]))
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(done() if held else [], schema)


def plans(marked: DataFrame) -> DataFrame:
    """(conv, no_id, part, at, n, entered, audit, alone, cost, illegal), a row a piece, written: what to do
    with the n turns from place ``at`` on, in which state. The audit of a last piece holds the final
    inserts. cost and illegal are to be summed up over a conversation. marked: as ``faults`` gives it."""
    pieces = stored(marked.select("conv", "no_id", "init", "fault", "pos", "part").groupBy("part").applyInArrow(_solved, _PIECES), "pieces")
    slim = pieces.select("conv", "no_id", "at", "costs", "ranks", "illegal", "first_init", "last_init")
    picks = slim.repartition("conv", "no_id").sortWithinPartitions("conv", "no_id", F.desc("at")).mapInArrow(_picked, _PICKS)
    both = pieces.select("part", "at", "n", "audits").join(picks.hint("merge"), "at")
    tail = F.when(F.col("final"), F.element_at(F.array(*[F.lit("I" * n) for n in _TAIL]), F.col("departed") + 1)).otherwise("")
    audit = F.concat(F.get("audits", 4 * F.col("entered") + F.col("departed")), tail)
    return stored(both.select("conv", "no_id", "part", "at", "n", "entered", audit.alias("audit"), "alone", "cost", "illegal"), "plans")


def _applied(turns: pa.Table, plan: pa.Table) -> Iterator[tuple[dict, list[tuple[int, str, str]]]]:
    """Each piece's plan with its repaired turns (pos, role, text); inserts bear the pos of what follows them."""
    turns = turns.sort_by("pos")
    pos, init = turns.column("pos").to_numpy(), turns.column("init").to_numpy()
    roles, texts = turns.column("role"), turns.column("text")
    for p in sorted(plan.to_pylist(), key=lambda p: p["at"]):
        i, state, out = int(np.searchsorted(pos, p["at"])), p["entered"], []
        for edit in p["audit"]:
            if edit == "I":
                out.append((int(pos[min(i, pos.size - 1)]), _PUT[state], ""))
                state = int(_NEXT[state])
                continue
            if edit == "K":
                out.append((int(pos[i]), roles[i].as_py(), texts[i].as_py()))
                state = int(_KEEP[state, init[i]])
            elif edit == "R":
                out.append((int(pos[i]), _PUT[state], texts[i].as_py()))
                state = int(_NEXT[state])
            i += 1
        yield p, out


_REPAIRED = f"{_ID}, at bigint, nth bigint, role string, text string"


def _rows(turns: pa.Table, plan: pa.Table) -> pa.Table:
    out = [(p["conv"], p["no_id"], p["at"], k, role, text) for p, own in _applied(turns, plan) for k, (_, role, text) in enumerate(own)]
    return pa.table(list(zip(*out, strict=True)) or [[]] * 6, schema=_arrow_schema(_REPAIRED))


_CHUNKS = f"{_ID}, at bigint, nth bigint, chunk string, digest string"


def _chunks(turns: pa.Table, plan: pa.Table) -> pa.Table:
    """A digest for each conversation that is one piece; the repaired text of other pieces, in chunks."""
    out = []
    for p, own in _applied(turns, plan):
        lines = [f"{role}:{text}" for _, role, text in own]
        if p["alone"]:
            out.append((p["conv"], p["no_id"], p["at"], 0, None, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
            continue
        chunk, size = [], 0
        for k, line in enumerate(lines):
            chunk.append(line)
            size += len(line)
            if size >= CHUNK or k == len(lines) - 1:
                out.append((p["conv"], p["no_id"], p["at"], k, "\n".join(chunk), None))
                chunk, size = [], 0
    return pa.table(list(zip(*out, strict=True)) or [[]] * 6, schema=_arrow_schema(_CHUNKS))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest chunks that come in order; nothing but the state of the hash is held."""
    schema = _arrow_schema(f"{_ID}, digest string")
    now, state = None, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if (r["conv"], r["no_id"]) != now:
                if state:
                    out.append({"conv": now[0], "no_id": now[1], "digest": state.hexdigest()})
                now, state = (r["conv"], r["no_id"]), hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(r["chunk"].encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist([{"conv": now[0], "no_id": now[1], "digest": state.hexdigest()}] if state else [], schema)


def _cogrouped(turns: DataFrame, plan: DataFrame, by, schema: str) -> DataFrame:
    own = turns.select("conv", "no_id", "role", "text", "init", "pos", "part")
    return own.groupBy("part").cogroup(plan.groupBy("part")).applyInArrow(by, schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, nth (a number that grows along a conversation), role, text.

    Null role or text: one space. Blank turns and turns that repeat an earlier one are left out, the
    rest is edited at least cost. A conversation of which nothing is left has no rows.
    """
    turns = turns_in_order(conversations)
    rows = _cogrouped(turns, plans(faults(turns)), _rows, _REPAIRED)
    return rows.select(F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), F.struct("at", "nth").alias("nth"), "role", "text")


def digests(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, no_id, digest): SHA-256 of the repaired ``role:text`` lines. Texts move once, by piece; those
    of conversations in several pieces move again, since a digest is made in order."""
    made = stored(_cogrouped(turns, plan, _chunks, _CHUNKS), "chunks")
    rest = made.where("digest IS NULL").drop("digest").repartition("conv", "no_id").sortWithinPartitions("conv", "no_id", "at", "nth")
    return made.where("digest IS NOT NULL").select("conv", "no_id", "digest").unionByName(rest.mapInArrow(_digests, f"{_ID}, digest string"))


def audit(conversations: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """One row for each conv_id of ``original`` (default: of ``conversations``; null is one of them):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    conversations: conv_id, turn, role, text; other columns are ignored. No rows left of a conversation:
    zeros, an empty audit and the digest of the empty string.
    """
    turns = turns_in_order(conversations)
    marked = faults(turns)
    plan = plans(marked)
    key = ["conv", "no_id"]
    said = marked.groupBy(*key).agg(*[F.sum((F.col("fault") == k).cast("long")).alias(c) for k, c in ((1, "blank"), (2, "duplicate"), (3, "truncated"))])
    spread = marked.where("turn IS NOT NULL").groupBy(*key, "turn").agg(F.lit(1).alias("one")).groupBy(*key).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "")
    edits = plan.groupBy(*key).agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), parts.alias("audit"))
    conv = F.col("conv_id").cast("long")
    out = (conversations if original is None else original).select(F.coalesce(conv, F.lit(0)).alias("conv"), conv.isNull().alias("no_id")).distinct()
    for more in (said, spread, edits, digests(turns, plan)):
        out = out.join(more.hint("merge"), key, "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return audit(damaged(conversations), conversations)
