"""License scans: canonical digests of whole texts, hash-joined with the digests of known licences.

Canonical form, line by line: lower case, copyright lines dropped, punctuation and blanks made one
blank, equivalent spellings made one, empty lines dropped. The digest of a text is that of its
lines in one; a text of which nothing is left has none.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import fresh, let, others, read, stored

#: Spellings that licence texts use for each other, in words without punctuation;
#: applied in this order.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
    ("sub licence", "sublicense"), ("sub license", "sublicense"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"), ("favour", "favor"), ("honour", "honor"),
    ("labour", "labor"), ("judgement", "judgment"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
    ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("owner s", "owners"),
)

#: A line that states whose copyright it is, or reserves all rights.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:portions )?(?:copyright|\(c\)|©)[ \t]+(?:\(c\)|©|[0-9]{4}|by )[^\n]*$|^[ \t]*all rights reserved[ \t.]*$"
OTHER = r"[^0-9a-z\x{80}-\x{10FFFF}\n]+"

#: Texts that put a work under a licence, and a short licence in full: (licence, text). They are
#: in the default table besides ``KNOWN``; callers may give a table of their own, of any size.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("FSFAP", "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty."),
)
#: Whole licences, with and without title and appendix, their usual notices and SPDX lines: a JSON
#: object (license, text) a line, in this package.
KNOWN = "known_licenses.jsonl"
#: Known digests are broadcast up to this many (about 100 bytes each), and shuffled beyond.
MAX_BROADCAST = 100_000
#: Up to this many, their 64-bit hashes are also a list in the projection that digests lines, which
#: then leaves out at once what can be none of them.
MAX_LISTED = 10_000


def canonical_lines(text: Column) -> Column:
    """Non-empty canonical lines; none for null."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    t = F.regexp_replace(t, OTHER, " ")
    # Every word gets blanks of its own on both sides, so that plain replacement can't miss one.
    t = F.concat(F.lit(" "), F.replace(F.replace(t, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.replace(x, F.lit("  "), F.lit(" ")))), lambda x: x != "")


def digest_of(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_digests(texts: DataFrame) -> DataFrame:
    """(digest, license, h) of known texts (license, text): a row for each digest, with the least name
    on ties; texts without a name or a canonical form are left out. h: 64-bit hash of the form."""
    rows = texts.where("license is not null").select(canonical_lines(F.col("text")).alias("lines"), "license")
    rows = rows.select(digest_of(F.col("lines")).alias("digest"), "license", F.xxhash64(F.array_join("lines", " ")).alias("h")).where("digest is not null")
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("h").alias("h"))


def default_texts(spark: SparkSession) -> DataFrame:
    """The notices and the texts of ``KNOWN``. The driver reads that file: executors need not see the package's folder."""
    rows = map(json.loads, resources.files(__package__).joinpath(KNOWN).read_text("utf-8").splitlines())
    return spark.createDataFrame([*NOTICES, *((r["license"], r["text"]) for r in rows)], "license string, text string")


def license_scan(documents: DataFrame, texts: DataFrame, text: str = "text", max_broadcast: int = MAX_BROADCAST, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``digest`` (of the whole text), ``license`` (whose known text that is, else null) and
    ``line_licenses`` (the known licences, sorted, that one whole line of the text states).

    Texts, however long, are canonicalised once, and what that gives is written: the digest of each
    text and those of its distinct lines, beside the other columns and a row number. Both kinds of
    digest are joined with the known ones; lines are gathered by row number, so neither a digest
    nor a line that very many texts share makes a hot group. Null texts and such of nothing but
    copyright lines have no digest and no licence; repeated rows are judged each; columns of the
    three names are replaced and others pass through, whatever their names, or of them only those
    that ``keep`` names (the text, say, needn't be written again); an empty table gives an empty one.
    """
    columns = others(documents if keep is None else documents.select(*keep), "digest", "license", "line_licenses")
    row, line, lines, mine, name = fresh(documents.select(*columns), "row", "line", "lines", "own_digest", "known_name")
    known = stored(known_digests(texts), "known-licenses")
    n = known.limit(max(max_broadcast, MAX_LISTED) + 1).count()
    few, listed = n <= max_broadcast, [r["h"] for r in known.select("h").collect()] if 0 < n <= MAX_LISTED else None

    def look_up(rows: DataFrame, key: str, how: str) -> DataFrame:
        names = known.select(F.col("digest").alias(key), F.col("license").alias(name))
        return rows.join(names.hint("broadcast" if few else "merge"), key, how)

    def digests(x: Column) -> Column:
        likely = F.filter(x, lambda y: F.xxhash64(y).isin(listed)) if listed else x
        of_lines = F.transform(F.array_distinct(likely), lambda y: F.unhex(F.sha2(y, 256)))
        return F.struct(digest_of(x).alias("whole"), of_lines.alias("each"))

    both = let(canonical_lines(F.col(text)), digests)
    formed = stored(
        documents.select(*columns, both.alias(lines)).select(*columns, F.monotonically_increasing_id().alias(row), F.col(lines)["whole"].alias(mine), F.col(lines)["each"].alias(lines)),
        "license-digests",
    )
    stated = formed.select(row, F.explode(lines).alias(line)).select(row, F.lower(F.hex(line)).alias(line))
    stated = look_up(stated, line, "inner").groupBy(row).agg(F.sort_array(F.collect_set(name)).alias(lines))
    out = look_up(formed.drop(lines), mine, "left").join(stated.hint("merge"), row, "left")
    return out.select(*columns, F.col(mine).alias("digest"), F.col(name).alias("license"), F.coalesce(lines, F.array().cast("array<string>")).alias("line_licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan(docs, default_texts(spark), keep=["doc_id"])
    return found.select("doc_id", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _spelt(expr: str) -> str:
    for old, new in SPELLINGS:
        expr = f"replace({expr}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return expr


_FORM = (
    rf"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT_LINE}', '', 'g'), '{OTHER}', ' ', 'g')"
)
_LINES = (
    "list_filter(list_transform(string_split("
    + _spelt(f"' ' || replace(replace({_FORM}, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' '")
    + ", chr(10)), lambda x: trim(replace(x, '  ', ' '))), lambda x: x <> '')"
)
SQL = f"""
WITH texts(license, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in NOTICES)}),
known AS (SELECT sha256(array_to_string({_LINES}, ' ')) AS digest, license FROM texts),
d AS (SELECT doc_id, {_LINES} AS lines FROM documents),
stated AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
  FROM (SELECT doc_id, unnest(lines) AS line FROM d) x JOIN known ON known.digest = sha256(line) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS digest, known.license,
       coalesce(stated.line_licenses, '') AS line_licenses
FROM d LEFT JOIN known ON len(lines) > 0 AND known.digest = sha256(array_to_string(lines, ' '))
LEFT JOIN stated ON stated.doc_id = d.doc_id
"""
