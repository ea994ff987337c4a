"""Repair of conversations against a search over whole audit strings, in plain Python."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def least(turns):
    """(cost, audit, repaired) by trying every edit at every turn; turns: (role, text, fault)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def go(i, state, inserts):
        ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        for role in ("user", "assistant"):
            if inserts and (state, role[0]) in step:
                c, a, r = go(i, step[state, role[0]], inserts - 1)
                ways.append((c + 2, "I" + a, ((role, ""), *r)))
        if i < len(turns):
            role, text, fault = turns[i]
            c, a, r = go(i + 1, state, 2)
            ways.append((c + 3, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                for edit, to, more in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (state, to[:1]) in step:
                        c, a, r = go(i + 1, step[state, to[:1]], 2)
                        ways.append((c + more + (fault == "truncated"), edit + a, ((to, text), *r)))
        return min(ways, default=(10**9, "", ()))

    return go(0, "", 2)


def brute(rows, original):
    convs = {conv: [] for conv, *_ in original}
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role, text))
    out = []
    for conv, own in convs.items():
        own.sort()
        known = [t for has, t, _, _ in own if has]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, turns = set(), []
        for _, _, role, text in own:
            fault = None
            if not SHOWN.search(text):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif SHOWN.findall(text)[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            turns.append((role, text, fault))
        cost, audit, fixed = least(tuple(turns))
        n = [sum(f == k for _, _, f in turns) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out.append(repr((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())))
    return sorted(out)


def shown(df):
    assert sorted(df.columns) == sorted(COLUMNS)
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def made(seed, convs, longest):
    rng = random.Random(seed)
    said = ["Yes. Do!", "so it ends", "", None, " \t\n", "What?", "Fine.  ", "é…", "No!\nno"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"]
    return [(c, rng.choice([t, t, t, None]), rng.choice(roles), rng.choice(said) if rng.random() < 0.6 else f"Turn {t}.") for c in convs for t in range(rng.randint(1, longest))]


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(repair.query(spark, sf_dir)) == brute(damage(rows), rows)


@pytest.mark.parametrize("pieces", [None, 12])
def test_odd_rows_whole_and_in_pieces(spark, pieces, monkeypatch):
    rows = made(1, [*range(60), None, -5], 12) + [(None, None, None, None)] * 3 + [(99, 0, "user", "")] * 20
    rows += made(2, [1000, 1001, 1002], 150)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "no_id", "code", "col", "init", "pos", "part", "fault", "same", "audit", "n")})
    if pieces:
        monkeypatch.setattr(repair, "ROWS", 2 * pieces)
        monkeypatch.setattr(repair, "CHUNK", 20)
    assert shown(repair.audit(repair.damaged(df), df)) == brute(damage(rows), rows)
    if pieces:
        turns = repair.turns_in_order(df)
        assert turns.groupBy("conv").agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0] > 2


def test_roles_of_repaired_rows(spark):
    rows = made(3, range(40), 9)
    fixed = {}
    for r in repair.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "nth").collect():
        fixed[r["conv_id"]] = fixed.get(r["conv_id"], "") + r["role"][0]
    assert fixed and all(re.fullmatch("s?(ua)+", x) for x in fixed.values())


def test_ranks_order_whole_strings():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 5, 17, 40])
    starts = np.cumsum(sizes) - sizes
    cost, letter, to = repair._costs(rng.integers(0, 4, sizes.sum()), rng.integers(0, 4, sizes.sum()), starts, sizes)
    live = np.flatnonzero(cost < repair._FAR)
    rank, audits = repair._ranked(letter, to, live)
    assert [audits[a] for a in sorted(live.tolist(), key=lambda a: rank[a])] == sorted(audits[a] for a in live.tolist())
    assert len({rank[a] for a in live.tolist()}) == len(set(audits.values()))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert shown(repair.audit(repair.damaged(none), none)) == [] and repair.repaired(none).count() == 0
    gone = spark.createDataFrame([(7, 1, "user", "Hi.")], SCHEMA)
    assert shown(repair.audit(none, gone)) == brute([], [(7, 1, "user", "Hi.")])
