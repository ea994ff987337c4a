"""URL filters: host and path rules, then a Bloom filter cascade, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import fresh, others, stored

#: (rule, verdict); a rule is a host, which also covers its subdomains, and the start of a path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A level is a scalar in every task, of at most this many bits: keys are split by their hash into as
#: many parts, each with a cascade of its own, as this needs.
MAX_BITS = 1 << 28
#: Share of the other kind's keys that a level after the first wrongly holds.
RATE = 0.05


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null. Equal lengths: by text."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def bits_for(n: int, rate: float) -> float:
    """Bits of a Bloom filter of n keys that holds other keys at that rate."""
    return -n * math.log(rate) / math.log(2) ** 2


def first_rate(listed: int, unlisted: int, rate: float = RATE) -> float:
    """Rate of level 0: what it wrongly holds are about ``rate`` times as many keys as are listed, so
    that level 1 and all others are smaller, however many keys there are."""
    return min(rate, rate * listed / max(1, unlisted))


class Level:
    """One Bloom filter: ``bits`` places, ``hashes`` places a key, as a table of one row."""

    def __init__(self, keys: DataFrame, n: int, rate: float, salt: int):
        self.bits = 64 * max(1, math.ceil(bits_for(n, rate) / 64))
        self.hashes = max(1, round(self.bits / n * math.log(2)))
        self.salt = salt
        words = (
            keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("place"))
            .groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("set"))
        )
        # Words without a bit are filled in; the array has bits / 64 entries.
        every = keys.sparkSession.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set"))
        packed = words.unionByName(every).groupBy("word").agg(F.bit_or("set").alias("set"))
        self.table = stored(
            packed.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("words")),
            f"bloom-{salt}",
        )

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = self.table.scalar()
        out = F.lit(True)
        for place in self._places(key):
            out = out & (F.getbit(words[F.shiftright(place, 6).cast("int")], (place % 64).cast("int")) == 1)
        return out


class Cascade:
    """Exact membership over a closed universe of keys.

    Level 0 holds the listed keys; level 1 the unlisted keys that level 0 wrongly holds; level 2
    the listed keys that level 1 wrongly holds, and so on until a level errs on no key. Each level
    uses other hashes, and holds a fraction ``rate`` of the level two before, so their number grows
    with the logarithm of the universe. The driver sees only one count a level.
    """

    def __init__(self, universe: DataFrame, rate: float = RATE, max_bits: int = MAX_BITS):
        """universe: key string (not null, distinct), listed boolean; read once a level. A level that
        would need more than ``max_bits`` is an error: give the universe in smaller parts."""
        self.levels: list[Level] = []
        left = universe
        counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        n, allowed = counts.get(True, 0), first_rate(counts.get(True, 0), counts.get(False, 0), rate)
        while n:
            depth = len(self.levels)
            if bits_for(n, allowed) > max_bits:
                raise ValueError(f"level {depth} of {n} keys is larger than {max_bits} bits")
            level = Level(left.where(F.col("listed") == F.lit(depth % 2 == 0)), n, allowed, depth)
            self.levels.append(level)
            # The keys to hold next are those of the other kind that this level errs on; its own go on.
            left = left.where((F.col("listed") == F.lit(depth % 2 == 0)) | level.holds(F.col("key")))
            n, allowed = left.where(F.col("listed") == F.lit(depth % 2 == 1)).count(), rate

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed; the first level that doesn't hold it decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in reversed(range(len(self.levels))):
            out = F.when(~self.levels[depth].holds(key), F.lit(depth % 2 == 1)).otherwise(out)
        return out


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url", rate: float = RATE, max_bits: int = MAX_BITS) -> DataFrame:
    """Judge every url: adds ``host``, ``path``, ``rule`` and ``verdict``.

    ``listed`` has the keys (host and path in one string, column ``key``) to block where no rule
    fits; nulls and repeats in it don't count. Null urls and such without ``://`` have empty host
    and path; urls may be of any length. The universe of the cascade is all keys of ``pages``, so its
    answer is exact for them. No level of a cascade is larger than ``max_bits``: as many parts of the
    universe as that needs, by hash of the key, have cascades of their own, and then ``pages`` is
    written once, a folder for each part, and each part is judged by its own cascade. Repeated urls
    are judged each; an empty list allows what no rule blocks; an empty table gives an empty one;
    columns of the four names are replaced and others pass through, whatever their names.
    """
    columns = others(pages, "host", "path", "rule", "verdict")
    host, path, part, hit, fit = fresh(pages, "host", "path", "part", "hit", "fit")
    base = pages.select(*columns, host_of(F.col(url)).alias(host), path_of(F.col(url)).alias(path))
    key = F.concat(host, path)
    block = listed.select("key").where("key is not null").distinct().withColumn("listed", F.lit(True))
    known = (
        base.select(key.alias("key"), F.lit(False).alias("listed"))
        .unionByName(block)
        .groupBy("key")
        .agg(F.max("listed").alias("listed"), F.min("listed").alias("elsewhere"))
        .where("not elsewhere")
        .select("key", "listed")
    )
    universe = stored(known, "url-keys")
    counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    n, more = counts.get(True, 0), counts.get(False, 0)
    # Half of the bound is left for parts that get more than their share of keys.
    parts = math.ceil(bits_for(n, first_rate(n, more, rate)) / (max_bits / 2)) if n else 1

    def of(k: Column) -> Column:
        return F.pmod(F.xxhash64(k, F.lit("part")), F.lit(parts)).cast("int")

    if parts == 1:
        judged = base.withColumn(hit, Cascade(universe, rate, max_bits).holds(key))
    else:
        keys = stored(universe.withColumn("part", of(F.col("key"))), "url-keys-by-part", by="part")
        rows = stored(base.withColumn(part, of(key)), "urls-by-part", by=part)
        judged = None
        for k in range(parts):
            cascade = Cascade(keys.where(F.col("part") == k).drop("part"), rate, max_bits)
            some = rows.where(F.col(part) == k).drop(part).withColumn(hit, cascade.holds(key))
            judged = some if judged is None else judged.unionByName(some)
    judged = judged.withColumn(fit, rule_for(F.col(host), F.col(path), rules))
    verdict = F.coalesce(F.col(fit)["verdict"], F.when(F.col(hit), "block").otherwise("allow"))
    return judged.select(*columns, F.col(host).alias("host"), F.col(path).alias("path"), F.col(fit)["rule"].alias("rule"), verdict.alias("verdict"))


def toxic_keys(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Keys of pages whose number names a document that is labelled toxic."""
    numbered = pages.select(
        F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("key"),
        F.expr(r"try_cast(nullif(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1), '') as bigint)").alias("doc_id"),
    )
    return numbered.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("key")


def query(spark, sf_dir):
    from .work import read

    pages, labels = read(spark, sf_dir, "pages").select("page_id", "url"), read(spark, sf_dir, "labels")
    return url_filter(pages, toxic_keys(pages, labels)).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql() -> tuple[str, str]:
    rule, verdict = "CASE", "CASE"
    for text, v in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        at, _, rest = text.partition("/")
        when = f" WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}') THEN "
        rule, verdict = rule + when + f"'{text}'", verdict + when + f"'{v}'"
    return rule + " END", verdict


_RULE, _VERDICT = _rule_sql()
SQL = rf"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
listed AS (
  SELECT DISTINCT host || path AS key FROM p
  WHERE try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT page_id, host, path, {_RULE} AS rule,
       {_VERDICT} WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""
