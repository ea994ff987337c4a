"""Quality classifier by co-training two views: a document's text and its page's metadata.

Each view has a logistic model, first fitted on labelled documents. In every round each model scores
all unlabelled documents and labels the share of them that it is surest of, good and bad ones as
often as among the labelled, and the other model learns from them, together weighing as much as the
labelled ones. Each view is then calibrated on labelled documents that it wasn't fitted on, and the
sum of the calibrated log-odds, weighted by a last logistic fit, scores every document.

The unlabelled documents' views are a stored table. Which of them are labelled follows from the
models of the rounds so far and their thresholds, so a pass over the table replays the rounds and
needs no other state. A pass gives the driver a histogram of log-odds, or the sums of one Newton step
(some two thousand numbers), however many documents there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import fresh, others, read, stored

#: Bound of the fit: labelled documents that the driver holds (their views, not their texts).
LABELLED = 20_000
#: Rounds, the share of the unlabelled that a view labels in each, the log-odds from which it is sure.
ROUNDS, PER_ROUND, SURE = 5, 0.05, 2.0
#: Newton steps of a refit, from the weights of the round before.
STEPS = 2
#: Bins of log-odds from -30 to 30; a share that ends within a bin is completed by hash of the document.
BINS = 6_000
KEEP_FROM = 0.5

TEXT_VIEW = (
    "log_words", "word_chars", "long_words", "capitals", "shouted", "digits", "symbols", "bangs", "bars", "stops", "commas",
    "distinct_words", "top_word", "repeat_next", "log_lines", "words_per_line", "dup_lines", "short_lines", "unclosed_lines", "accents",
)
META_VIEW = ("log_chars", "has_lang", "has_page", "https", "www", "log_host", "log_path", "query", "fragment", "html_end", *[f"source{i}" for i in range(16)], *[f"lang{i}" for i in range(8)])
_SYMBOL = re.compile(r"[#$%&*+<=>@\\^_`~{}\[\]]")
_CAPITAL = re.compile(r"[A-Z]")
_DIGIT = re.compile(r"[0-9]")
_BLANKS = " \t\n\x0b\x0c\r"


def text_features(text: str | None) -> list[float]:
    """The text view of a whole text; zeros for a null or blank one."""
    t = text or ""
    words = t.split()
    n = len(words)
    if not n:
        return [0.0] * len(TEXT_VIEW)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    chars = sum(map(len, words))
    lines = [x for x in t.split("\n") if x.strip(_BLANKS)]
    m = len(lines)
    return [
        np.log1p(n), chars / n, sum(len(w) > 14 for w in words) / n, len(_CAPITAL.findall(t)) / chars,
        sum(w.isupper() and len(w) > 1 for w in words) / n, len(_DIGIT.findall(t)) / chars, len(_SYMBOL.findall(t)) / n,
        t.count("!") / n, t.count("|") / n, t.count(".") / n, t.count(",") / n, len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, np.log1p(m), np.log1p(n / m), 1 - len(set(lines)) / m,
        sum(len(x) < 20 for x in lines) / m, sum(x[-1] not in ".!?" for x in lines) / m, 1 - len(t.encode()) / (2 * len(t)),
    ]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_doc, page_url) of pages whose url's number names a document; the least url if several do."""
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1), '') as bigint)")
    return pages.select(number.alias("page_doc"), F.col("url").alias("page_url")).where("page_doc is not null").groupBy("page_doc").agg(F.min("page_url").alias("page_url"))


def meta_view(n_chars: Column, lang: Column, source: Column, url: Column) -> list[Column]:
    """The metadata view, in the order of META_VIEW."""

    def slot(c: Column, n: int) -> list[Column]:
        return [_flag(F.pmod(F.xxhash64(c), F.lit(n)) == i) * _flag(c.isNotNull()) for i in range(n)]

    def log(c: Column) -> Column:
        return F.log1p(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("double"))

    host, path = F.regexp_extract(url, "://([^/?#]*)", 1), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return [
        log(n_chars), _flag(lang.isNotNull()), _flag(url.isNotNull()), _flag(url.startswith("https")), _flag(host.startswith("www.")),
        log(F.length(host)), log(F.length(path)), _flag(url.contains("?")), _flag(url.contains("#")), _flag(path.endswith(".html")),
        *slot(source, 16), *slot(lang, 8),
    ]


def _spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = x.std(axis=0)
    return x.mean(axis=0), np.where(scale < 1e-9, 1.0, scale)


@dataclass
class Logistic:
    """Standardised inputs, ridge-penalised weights, by Newton's method."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, steps: int = 25) -> Logistic:
        model = Logistic(*_spread(x), np.zeros(x.shape[1] + 1))
        for _ in range(steps):
            if np.abs(model.step(*model.sums(x, y))).max() < 1e-6:
                break
        return model

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of some rows, which add up over any split of them."""
        z = self.inputs(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        return z.T @ (y - p), (z * (p * (1 - p))[:, None]).T @ z

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        """One Newton step under the ridge; the step is added to the weights, and returned."""
        penalty = np.append(np.ones(self.weights.size - 1), 1e-3)
        step = np.linalg.solve(curvature + np.diag(penalty), gradient - penalty * self.weights)
        self.weights = self.weights + step
        return step

    def column(self, inputs: list[Column]) -> Column:
        """:meth:`logit` as an expression."""
        out = F.lit(float(self.weights[-1]))
        for x, m, s, w in zip(inputs, self.mean, self.scale, self.weights[:-1], strict=True):
            out = out + F.least(F.greatest((x - float(m)) / float(s), F.lit(-8.0)), F.lit(8.0)) * float(w)
        return out


@dataclass
class Choice:
    """What a view labels in a round: log-odds bins below ``low`` are bad and above ``high`` good, and
    of these two bins themselves the documents whose draw is below ``low_part``, ``high_part``."""

    model: Logistic
    low: int
    low_part: float
    high: int
    high_part: float

    def labels(self, x: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """0 or 1 for each row, and -1 where the view isn't sure enough."""
        at = bin_of(self.model.logit(x))
        bad = (at < self.low) | ((at == self.low) & (draw < self.low_part))
        good = (at > self.high) | ((at == self.high) & (draw < self.high_part))
        return np.where(bad, 0, np.where(good, 1, -1))


def bin_of(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((odds + 30) * (BINS / 60)), 0, BINS - 1).astype(np.int64)


def choose(model: Logistic, histogram: np.ndarray, bad: float, good: float) -> Choice:
    """The surest ``bad`` and ``good`` documents of a histogram, as far as they are sure at all."""

    def edge(counts: np.ndarray, want: float) -> tuple[int, float]:
        upto = np.cumsum(counts)
        at = int(np.searchsorted(upto, want))
        if at >= counts.size:
            return counts.size, 0.0
        return at, float((want - (upto[at] - counts[at])) / counts[at]) if counts[at] else 0.0

    sure = int(round((30 - SURE) * (BINS / 60)))
    low, low_part = edge(histogram[:sure], bad)
    high, high_part = edge(histogram[::-1][:sure], good)
    return Choice(model, low, low_part, BINS - 1 - high, high_part)


def replay(rounds: list[tuple[Choice, Choice]], views: tuple[np.ndarray, np.ndarray], draw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whether each row is still free after the rounds, and for either view the labels (-1: none) that
    it has been given by the other one."""
    free = np.ones(len(draw), bool)
    given = [np.full(len(draw), -1), np.full(len(draw), -1)]
    for choices in rounds:
        told = [np.where(free, c.labels(v, draw), -1) for c, v in zip(choices, views, strict=True)]
        for k in (0, 1):
            given[k] = np.where(told[1 - k] >= 0, told[1 - k], given[k])
        free &= (told[0] < 0) & (told[1] < 0)
    return free, given


class Pool:
    """The stored views of the unlabelled documents: text_view and meta_view (32-bit numbers), draw."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _summed(self, of) -> dict[int, float]:
        """Sums, by number, of the (numbers, values) that ``of(views, draw)`` gives for some rows."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, float] = {}
            for batch in batches:
                if batch.num_rows:
                    views = tuple(np.frombuffer(b"".join(batch.column(k).to_pylist()), "<f4").reshape(batch.num_rows, -1).astype(float) for k in (0, 1))
                    for k, v in zip(*[x.tolist() for x in of(views, batch.column(2).to_numpy())], strict=True):
                        out[k] = out.get(k, 0.0) + v
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.float64())], ["k", "v"])

        rows = self.table.select("text_view", "meta_view", "draw").mapInArrow(part, "k long, v double")
        return {r["k"]: r["v"] for r in rows.groupBy("k").agg(F.sum("v").alias("v")).collect()}

    def histograms(self, rounds: list, models: list[Logistic]) -> list[np.ndarray]:
        """How many free documents have log-odds in each bin, for either model."""

        def count(views, draw):
            free, _ = replay(rounds, views, draw)
            return np.unique(np.concatenate([k * BINS + bin_of(m.logit(v[free])) for k, (m, v) in enumerate(zip(models, views, strict=True))]), return_counts=True)

        got = self._summed(count)
        return [np.array([got.get(k * BINS + i, 0.0) for i in range(BINS)]) for k in (0, 1)]

    def sums(self, rounds: list, models: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For either model the sums of a Newton step over what it was given, and how many rows that is."""
        sizes = [m.weights.size for m in models]
        starts = [0, sizes[0] * (sizes[0] + 1) + 1]

        def add(views, draw):
            _, given = replay(rounds, views, draw)
            flat = []
            for m, v, y in zip(models, views, given, strict=True):
                g, c = m.sums(v[y >= 0], y[y >= 0])
                flat.append(np.concatenate([g, c.ravel(), [np.count_nonzero(y >= 0)]]))
            flat = np.concatenate(flat)
            return np.arange(flat.size), flat

        got, out = self._summed(add), []
        for d, start in zip(sizes, starts, strict=True):
            flat = np.array([got.get(start + i, 0.0) for i in range(d * (d + 1) + 1)])
            out.append((flat[:d], flat[d : d + d * d].reshape(d, d), flat[-1]))
        return out


@dataclass
class CoTrained:
    views: tuple[Logistic, Logistic]
    calibration: tuple[Logistic, Logistic]
    combined: Logistic

    def text_odds(self, text: np.ndarray) -> np.ndarray:
        return self.calibration[0].logit(self.views[0].logit(text)[:, None])

    def meta_odds(self, meta: list[Column]) -> Column:
        return self.calibration[1].column([self.views[1].column(meta)])


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool, size: int, rounds: int = ROUNDS, per_round: float = PER_ROUND) -> CoTrained:
    """views, y (0 or 1): the labelled rows, of which every fourth is for calibration only. pool: the
    unlabelled ones, ``size`` of them, as :class:`Pool` gives them."""
    apart = np.arange(len(y)) % 4 == 3
    own = [(v[~apart], y[~apart]) for v in views]
    models = [Logistic.fit(*o) for o in own]
    share, done = y[~apart].mean(), []
    for _ in range(rounds if size else 0):
        want = per_round * size
        choices = [choose(m, h, want * (1 - share), want * share) for m, h in zip(models, pool.histograms(done, models), strict=True)]
        done = [*done, (choices[0], choices[1])]
        models = [Logistic(m.mean, m.scale, m.weights) for m in models]
        for _ in range(STEPS):
            for m, o, (gradient, curvature, n) in zip(models, own, pool.sums(done, models), strict=True):
                weight = min(1.0, len(o[1]) / n) if n else 0.0
                g, c = m.sums(*o)
                m.step(g + weight * gradient, c + weight * curvature)
    hold = apart if apart.any() and 0 < y[apart].mean() < 1 else np.ones(len(y), bool)
    calibration = tuple(Logistic.fit(m.logit(v[hold])[:, None], y[hold]) for m, v in zip(models, views, strict=True))
    odds = np.stack([c.logit(m.logit(v[hold])[:, None]) for c, m, v in zip(calibration, models, views, strict=True)], axis=1)
    return CoTrained((models[0], models[1]), calibration, Logistic.fit(odds, y[hold]))


def with_pages(documents: DataFrame, pages: DataFrame, into: str = "page_url") -> DataFrame:
    """documents with ``into``, the url of the page that names the row's doc_id, if any.

    Rows without a doc_id are dealt by their text, as no page can be theirs; a doc_id of very many
    rows meets one row. A task holds the urls of its share of the doc_ids, one each, and streams the
    documents past them, so that texts needn't be sorted. Repeated rows keep their number and other columns their values, if ``into``
    is not among them; no page has the number of a text, however long; an empty table stays empty."""
    key, page = fresh(documents, "page_doc", "page_key")
    none = -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    urls = page_metadata(pages).select(F.col("page_doc").alias(page), F.col("page_url").alias(into))
    rows = documents.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), none))
    return rows.join(urls.hint("shuffle_hash"), F.col(key) == F.col(page), "left").drop(key, page)


def featured(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, text_view, meta_view (32-bit numbers, little-endian) and draw (0 to 1, by hash of id and
    text) of every row; whole texts, null as empty."""

    @F.pandas_udf("binary")
    def text_view(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.asarray(text_features(t), "<f4").tobytes() for t in texts], dtype=object)

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([np.asarray(r, "<f4").tobytes() for r in rows], dtype=object)

    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), "lang", "source", "n_chars", draw.alias("draw"))
    # What is joined with the page by id is the view, not the text.
    base = with_pages(base.select("doc_id", F.xxhash64("text").alias("text"), "lang", "source", "n_chars", "draw", text_view("text").alias("text_view")), pages)
    meta = packed(F.array(*meta_view(*[F.col(c) for c in ("n_chars", "lang", "source", "page_url")])))
    return base.select("doc_id", "text_view", meta.alias("meta_view"), "draw")


def fit(documents: DataFrame, pages: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained | None:
    """Fit on the labelled documents, about ``labelled`` of them by the hash of their id if there are
    more, and on all unlabelled ones; whole texts of both. None without both labels.

    A document that is labelled twice counts as good only if all its labels say so; rows without a
    label value don't count. A labelled doc_id that several rows bear counts once, with the least
    views; unlabelled rows count each, those without a doc_id among them.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = stored(featured(documents, pages), "views").join(marks.hint("merge"), "doc_id", "left")
    rows = stored(rows, "labelled-views")
    pool = rows.where("quality is null")
    known = rows.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.struct("text_view", "meta_view")).alias("v"))
    n = known.count()
    if n > labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(labelled / n * (1 << 30)))
    got = known.select("doc_id", "quality", "v.*").toPandas().sort_values("doc_id", kind="stable")
    y = got["quality"].to_numpy(float)
    if y.size < 8 or not 0 < y.mean() < 1:
        return None
    text, meta = (np.stack([np.frombuffer(b, "<f4") for b in got[c]]).astype(float) for c in ("text_view", "meta_view"))
    return co_train((text, meta), y, Pool(pool), pool.count())


def classify(documents: DataFrame, pages: DataFrame, model: CoTrained | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Add text_score, meta_score, score (0 to 1) and kept (score of at least ``keep_from``).

    documents: doc_id, text, lang, source, n_chars and any others, which pass through, whatever their
    names; columns of these four names are replaced. Without a model every score is null and every
    row is kept. Nulls in any column count as absent; whole texts are read, however long; repeated
    rows are scored each; an empty table gives an empty one.
    """
    names = ("text_score", "meta_score", "score")
    columns = others(documents, *names, "kept")
    if model is None:
        return documents.select(*columns, *[F.lit(None).cast("double").alias(n) for n in names], F.lit(True).alias("kept"))

    @F.pandas_udf("double")
    def text_odds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.text_odds(np.asarray([text_features(t) for t in texts], float)) if len(texts) else [], dtype="float64")

    # The text is scored where it is read; what is joined by id is its score, and the text itself
    # only if the caller wants it.
    url, text, meta, both = own = fresh(documents, "page_url", "text_odds", "meta_odds", "both_odds")
    rows = with_pages(documents.select(*others(documents), text_odds("text").alias(text)), pages, url)
    rows = rows.withColumn(meta, model.meta_odds(meta_view(*[F.col(c) for c in ("n_chars", "lang", "source", url)])))
    rows = rows.withColumn(both, model.combined.column([F.col(text), F.col(meta)]))
    odds = [F.least(F.greatest(F.col(c), F.lit(-30.0)), F.lit(30.0)) for c in own[1:]]
    rows = rows.select(*columns, *[(1 / (1 + F.exp(-o))).alias(n) for o, n in zip(odds, names, strict=True)])
    return rows.withColumn("kept", F.col("score") >= keep_from)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the documents, pages and labels of the folder, and score all documents."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    model = fit(docs, pages, read(spark, sf_dir, "labels"))
    return classify(docs, pages, model).select("doc_id", "text_score", "meta_score", "score", "kept")
