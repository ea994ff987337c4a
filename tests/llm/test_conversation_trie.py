"""The trie of rebuilt conversations against one built turn by turn, in plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from filigree.llm import conversation_trie, near_duplicates

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_order(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(own)] for c, own in convs.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = own + sum(saved[k] for k in below)
    return sorted(
        repr((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(kids.get(v, [])), leaves[v], saved[v], hashlib.sha256(",".join(map(str, sorted(ends.get(v, [])))).encode()).hexdigest()))
        for v, m in members.items()
    )


def shown(df):
    assert sorted(df.columns) == sorted(COLUMNS)
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def with_digests(nodes, ends):
    out = nodes.join(conversation_trie.ends_digests(ends), "node", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("node")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    said = ["yes, do", "", None, "no no no", "Ünd so  weiter\n\n", " \t"]
    out = []
    for conv in [*range(90), -7, -21, None, 2**40]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 9])):
            out.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", None]), rng.choice(said)))
    out += [(c, t, "user", "same words here") for c in range(100, 130) for t in range(6)]
    return out + rng.sample(out, 10)


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(conversation_trie.query(spark, sf_dir)) == brute(rebuild(in_order(rows)))


@pytest.mark.parametrize("size", [1, 3, 4])
def test_rebuilt_with_odd_rows(spark, rows, size, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SEGMENT", 2)
    monkeypatch.setattr(conversation_trie, "CHUNK", 4)
    monkeypatch.setattr(near_duplicates, "HUB_ROWS", 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "place", "digest", "words", "pos", "part", "n", "node")})
    turns = conversation_trie.stored(conversation_trie.digested(df), "digested")
    found = shown(with_digests(*conversation_trie.trie(*conversation_trie.rebuilt(turns), size)))
    assert found == brute(rebuild(in_order(rows)))


def test_as_they_are_and_empty(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert shown(with_digests(*conversation_trie.conversation_trie(df))) == brute(in_order(rows))
    assert shown(with_digests(*conversation_trie.conversation_trie(df.limit(0)))) == []


def test_one_long_conversation_spreads_over_tasks(spark):
    rows = [(1, i, "user", f"turn {i % 7}") for i in range(9000)] + [(2, i, "user", f"turn {i % 7}") for i in range(8990)] + [(2, 8990, "user", "else")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = conversation_trie.stored(conversation_trie.digested(table), "digested")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r[0] for r in turns.where("conv = 1").orderBy("place").select("place").collect()] == list(range(9000))
    nodes = conversation_trie.conversation_trie(table)[0].orderBy("depth", "conv_id").collect()
    assert len(nodes) == 1 + 9000 + 1 and nodes[0]["n_leaves"] == 2 and nodes[0]["saved_tokens"] == 2 * 8990
    split = nodes[8990]
    assert (split["depth"], split["n_children"], split["n_convs"], split["saved_tokens"]) == (8990, 2, 2, 2)
