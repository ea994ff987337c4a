"""Exact dedup by block naming: groups of equal folded texts, odd rows, hot blocks."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from filigree.llm import exact_dedup, near_duplicates

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(doc_id, keep_id, group_size, kept, digest) of each row, as a sorted list of texts."""
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(ASCII)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = [keep]
        for i in ids:
            kept = i in left
            if kept:
                left.remove(i)
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


def found(df, size):
    out = exact_dedup.duplicates(df, size).withColumn("digest", F.lower(F.hex("digest")))
    return sorted(repr(tuple(r)) for r in out.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    piece = ["".join(rng.choice("abéÉ𝄞 A\n") for _ in range(8)) for _ in range(4)]
    made = ["".join(rng.choice(piece) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    texts = made + rng.sample(made, 60) + [t.upper() for t in rng.sample(made, 30)] + ["", None, "same" * 40, "SAME" * 40] + ["hot" * 30] * 80
    return [(rng.choice([None, 7, *range(100, 400)]), t) for t in texts]


@pytest.mark.parametrize("size", [2, 1024])
def test_groups_match_brute_force(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, size) == brute(rows)


def test_frequent_blocks_are_fetched_without_a_shuffle(spark, rows, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HUB_ROWS", 3)
    monkeypatch.setattr(near_duplicates, "HUBS", 10_000)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 8) == brute(rows)


def test_only_ascii_letters_are_folded(spark):
    df = spark.createDataFrame([("ÀÉ İıſ\u212a ΑΣ AbC",), ("AbC zZ",)], "t string").select(exact_dedup.ascii_lower(F.col("t")))
    assert [r[0] for r in df.collect()] == ["ÀÉ İıſ\u212a ΑΣ abc", "abc zz"]


def test_blocks_make_up_the_text(spark):
    texts = ["", "a", "ab\r\n\x85 c", "𝄞" * 7, "x\x00y" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.blocks_of(F.col("t"), 3).alias("b"))
    for t, b in df.collect():
        assert b == ([t[i : i + 3] for i in range(0, len(t), 3)] or [""])


def test_names_are_ranks_whatever_the_partitions(spark, rows):
    units = spark.createDataFrame([(t,) for _, t in rows if t], "unit string")
    told = sorted(t for t, n in collections.Counter(t for _, t in rows if t).items() if n > 1)
    names = [{r["unit"]: r["name"] for r in exact_dedup._names(units.repartition(n), "names").collect()} for n in (1, 7)]
    assert names[0] == names[1] and sorted(names[0].values()) == list(range(len(told)))
    order = [r[0] for r in units.distinct().orderBy(F.xxhash64("unit"), "unit").collect() if r[0] in names[0]]
    assert set(told) == set(order) and [u for u, _ in sorted(names[0].items(), key=lambda x: x[1])] == order


def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.withColumns({c: F.lit("x") for c in ("row", "t", "digest", "blocks", "unit", "n", "name", "part", "identity", "keep", "group_size", "kept")})
    assert found(clash, 8) == brute(rows)
    assert found(df.limit(0), 8) == []
    alike = [(None, None)] * 5
    assert found(spark.createDataFrame(alike, "doc_id long, text string"), 8) == brute(alike)
    long = [(1, "ab" * 300_000), (2, "AB" * 300_000), (3, "ab" * 300_000 + "c")]
    assert found(spark.createDataFrame(long, "doc_id long, text string"), 1024) == brute(long)
