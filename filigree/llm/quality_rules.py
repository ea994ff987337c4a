"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import BLANKS, fresh, let, others, words_of

#: Frequent function words of the languages in the corpus.
STOP_WORDS = sorted(set(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will no more if out so"
    " der die und das von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über"
    " de la le les et des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec aux son ou mais comme"
    " el los las y del con para una su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre".split()
))

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``low * below <= 1000 * above <= high * below``; a missing bound isn't tested.

    Ratios are compared as whole numbers, so that every engine decides alike at the border.
    """

    name: str
    above: str
    below: str | None
    low: int | None
    high: int | None

    def condition(self) -> Column:
        top = F.lit(1000) * F.col(self.above)
        bottom = F.col(self.below) if self.below else F.lit(1)
        parts = [top >= self.low * bottom] if self.low is not None else []
        parts += [top <= self.high * bottom] if self.high is not None else []
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def sql(self) -> str:
        bottom = self.below or "1"
        parts = [f"1000 * {self.above} >= {self.low} * {bottom}"] if self.low is not None else []
        parts += [f"1000 * {self.above} <= {self.high} * {bottom}"] if self.high is not None else []
        return "(" + " AND ".join(parts) + ")"


#: Bounds in thousandths of the ratio.
RULES = (
    Rule("word length", "word_chars", "n_words", 2_000, 15_000),
    Rule("symbols per word", "n_symbols", "n_words", None, 100),
    Rule("stop words per word", "n_stop_words", "n_words", 20, None),
    Rule("capital letters", "n_capitals", "word_chars", None, 400),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 300),
    Rule("words per line", "n_words", "n_lines", 2_000, None),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in five-word windows which occur twice or more in the text.

    Most texts repeat no window, which a distinct count of window hashes shows; only the others
    sort (hash, position) pairs and add up the union of the repeated windows.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)])
    )

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        again = F.filter(
            pairs,
            lambda p, k: F.when(k > 0, pairs[k - 1]["h"] == p["h"]).otherwise(F.lit(False))
            | F.when(k < last, pairs[k + 1]["h"] == p["h"]).otherwise(F.lit(False)),
        )
        return F.aggregate(
            F.sort_array(F.transform(again, lambda p: p["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["at"])).alias("n"), p.alias("at")),
        )["n"]

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        )

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(windows, counted))


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules use.

    Null text counts as no words; whole texts are read, however long. Repeated rows are measured each;
    an input column that bears the name of a count is replaced, others pass through whatever their
    names; an empty table gives an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_words = let(
        words_of(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    n_chars = F.length(t)
    words, of_line = fresh(documents, "words", "lines")
    counts = {
        "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": (n_chars - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_capitals": (n_chars - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
    }
    of_text, of_each = ("n_words", "n_repeat_words", "n_stop_words"), ("n_lines", "n_dup_lines")
    columns = others(documents, *counts, *of_text, *of_each)
    rows = documents.select(*columns, of_words.alias(words), of_lines.alias(of_line), *[c.alias(k) for k, c in counts.items()])
    return rows.select(*columns, *counts, *[F.col(words)[k].alias(k) for k in of_text], *[F.col(of_line)[k].alias(k) for k in of_each])


def quality_rules(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judge every document: ``base_failed`` and ``kept`` beside the counts of :func:`measure`.

    ``base_failed`` holds under ten words, or where over a fifth of the words lie in repeated
    windows. ``kept`` is false then; else all rules of the table must hold. One narrow projection:
    no shuffle, and no null comes out, whatever the text.
    """
    verdict = F.lit(True)
    for r in rules:
        verdict = verdict & r.condition()
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = measure(documents, text)
    return rows.select(*others(rows, "base_failed", "kept"), failed.alias("base_failed"), (~failed & verdict).alias("kept"))


def query(spark, sf_dir):
    from .work import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_QUOTED = ", ".join("'" + w + "'" for w in STOP_WORDS)
#: The same counts by other means: windows are compared as text, words are unnested.
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals,
         len(list_filter(w, lambda x: lower(x) IN ({_QUOTED})))::BIGINT AS n_stop_words,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(r.sql() for r in RULES)} AS kept
FROM f
"""
