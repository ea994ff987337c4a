"""Training-data operators: oracles, brute force, round trips, held-out accuracy, odd rows."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filigree.llm import bpe_units, fingerprint, language, licenses, near_duplicates, packing, queries, quality_classifier, quality_rules, sentencepiece_bpe, url_filter, wavelet
from filigree.llm.work import stored

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(1, 300_000)
ODD = [
    (0, "", "en", "a", 0), (1, None, None, None, None), (2, " \n\t ", "en", "a", 4), (3, "one", "en", None, 3), (3, "one", "en", None, 3), (4, prose(2, 80), "de", "b", 1),
    (5, prose(2, 80), "de", "b", 1), (6, LONG, "en", "a", len(LONG)), (None, "no id here at all, friend", "fr", "c", 9), (7, "é́ ﬁ ☃ 𝄞 \x00 end", "fr", "c", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    clash = ["score", "kept", "digest", "h", "n", "text_score", "label", "key", "rule", "ids", "_t", "own_id", "row", "line", "lines", "own_digest", "known_name", "judged", "words", "url", "text_odds", "meta_odds", "both_odds", "page_doc", "page_url"]
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    found, told = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(told.columns)
    place = [told.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in told.fetchall())


# language


def test_language_on_held_out_documents(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in language.query(spark, sf_dir).collect() if r["held_out"]]
    assert held and np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)


def test_language_distance_by_hand():
    profiles = {"aa": language._gram_counts("aaa")[0].tolist(), "bb": language._gram_counts("bbb")[0].tolist()}
    judge = language._Scorer(profiles, 300)
    assert judge("aaa")[0] == "aa" and judge("BBB")[0] == "bb" and judge("123") == ("und", 0.0) and judge(None) == ("und", 0.0)
    assert judge("ccc")[1] == 0.0


def brute_profile(texts, size):
    """Rank order of the n-grams of some texts, counted one by one."""
    counts = collections.Counter()
    for t in texts:
        shown = "".join(c if ("a" <= c <= "z" or (ord(c) > 127 and c.isalpha())) else " " for c in (t or "").lower())
        for word in shown.split():
            counts.update(word)
            padded = f" {word} "
            counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
            counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    code = {g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g)) for g in counts}
    return sorted(counts, key=lambda g: (-counts[g], code[g]))[:size]


def test_language_against_brute_force(spark, sf_dir):
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r["text"] or "") < 3000]
    fitted = collections.defaultdict(list)
    for r in docs:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            fitted[r["lang"]].append(r["text"])
    profiles = {k: {g: i for i, g in enumerate(brute_profile(v, language.PROFILE))} for k, v in fitted.items()}
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in docs], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language.identify(df, language.fit_profiles(df.where(~language.held_out()))).collect()}
    for r in docs:
        own = brute_profile([r["text"]], language.PROFILE)
        far = sorted((sum(abs(p[g] - i) if g in p else language.PROFILE for i, g in enumerate(own)), k) for k, p in profiles.items())
        want = (far[0][1], 1 - far[0][0] / (language.PROFILE * len(own))) if own else ("und", 0.0)
        assert found[r["doc_id"]]["lang_pred"] == want[0] and abs(found[r["doc_id"]]["score"] - want[1]) < 1e-12


def test_language_counts_long_texts_in_pieces(monkeypatch):
    text = prose(5, 3000)
    whole = dict(zip(*[x.tolist() for x in language._gram_counts(text)], strict=True))
    monkeypatch.setattr(language, "_CHUNK", 100)
    assert dict(zip(*[x.tolist() for x in language._gram_counts(text)], strict=True)) == whole


def test_language_odd_rows(spark, odd, empty):
    profiles = language.fit_profiles(odd)
    assert set(profiles) == {"en", "de", "fr"}
    assert [r["judged"] for r in language.identify(odd, profiles).collect()] == ["x"] * len(ODD)
    assert language.fit_profiles(empty) == {} and language.identify(odd, {}).where("lang_pred <> 'und'").count() == 0


def test_language_draw_without_ids(spark, monkeypatch):
    rows = [(None, f"the house number {i} stands here", "en") for i in range(300)] + [(i % 2, f"das haus nummer {i} steht hier", "de") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.fit_profiles(df, per_lang=30)) == {"de", "en"}
    monkeypatch.setattr(language, "MAX_LANGS", 1)
    assert set(language.fit_profiles(df.unionByName(df.limit(1)), per_lang=30)) <= {"de", "en"}
    assert len(language.fit_profiles(df)) == 1


@pytest.mark.parametrize("threshold", [0.01, 0.03, 0.1, 0.5, 0.8, 0.95, 1.0])
def test_bands_reach_the_recall(threshold):
    bands, rows = near_duplicates.choose_bands(threshold)
    assert 1 - (1 - threshold**rows) ** bands >= near_duplicates.RECALL - 1e-12
    assert bands * rows <= near_duplicates.MAX_HASHES or rows == 1


# fingerprints


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_brute_force(spark, sf_dir):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.query(spark, sf_dir).collect()}
    errors = []
    for k, (d, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(shingles(t), shingles(edited)), r["near_next"] - jaccard(shingles(t), shingles(nxt))]
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_fingerprints_odd_rows(spark, odd, empty):
    rows = fingerprint.edit_neighbours(odd).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[0][0]["fingerprint"] == "" and by[4][0]["fingerprint"] == by[5][0]["fingerprint"] and len(by[3]) == 2
    assert by[5][0]["near_next"] == 1.0 and len(by[6][0]["fingerprint"]) == fingerprint.BINS
    assert fingerprint.edit_neighbours(empty).count() == 0
    single = fingerprint.edit_neighbours(odd.where("doc_id = 4")).first()
    assert single["near_next"] == 1.0


# near duplicates


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    links, parent = collections.Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return links, find


def near_copies():
    rows = [(i, prose(100 + i, 60)) for i in range(20)]
    base = prose(7, 120).split()
    for i in range(20, 60):  # one word changed: all near each other
        w = list(base)
        w[(i * 3) % 120] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(60, rows[20][1]), (61, rows[20][1]), (62, ""), (63, None), (64, "a b"), (65, "a  b")]
    return rows


def test_links_against_brute_force(spark, monkeypatch):
    rows = near_copies()
    links, find = brute_links(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: (find(k), links[k]) for k, (d, _) in enumerate(rows)}
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(df).collect()} == want
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", 7)  # the group is dealt into blocks
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(df).collect()} == want


def chained_copies():
    """Texts that share a long passage, so that few bands join nearly all, and near copies of some."""
    passage = prose(41, 60)
    rows = [(i, passage + " " + prose(300 + i, 40)) for i in range(50)]
    for i in range(50, 80):
        w = rows[i % 13][1].split()
        w[65 + i % 30] = f"y{i}"
        rows.append((i, " ".join(w)))
    return rows


def test_links_of_overlapping_buckets_against_brute_force(spark, monkeypatch):
    rows = chained_copies()
    links, find = brute_links(rows)
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", 6)
    monkeypatch.setattr(near_duplicates, "HUB_ROWS", 3)  # most keys are looked up in broadcast tables
    monkeypatch.setattr(near_duplicates, "choose_bands", lambda *_: (40, 7))
    modes, units = set(), near_duplicates._units

    def noted(classes):
        out, shares = units(classes)
        modes.update(r[0] for r in out.select(F.explode("units.bucketed")).distinct().collect())
        return out, shares

    monkeypatch.setattr(near_duplicates, "_units", noted)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {d: (find(k), links[k]) for k, (d, _) in enumerate(rows)}
    assert True in modes


def test_pairs_count_in_their_first_bucket():
    linked = ~np.eye(4, dtype=bool)
    near_duplicates._earlier(linked, 7, [np.array(b, np.int64) for b in ([3, 7], [3, 7, 9], [7, 9], [7])])
    assert not linked[0, 1] and not linked[1, 0] and linked[1, 2] and linked[0, 3]


def test_components_with_hubs(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(0, k) for k in range(1, 40)] + [(k, 200) for k in range(100, 140)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    for rows in (5, 10_000):
        monkeypatch.setattr(near_duplicates, "HUB_ROWS", rows)
        assert {r["node"]: r["label"] for r in near_duplicates.components(df, "test").collect()} == want


def test_measured_recall_of_bands():
    rng = np.random.default_rng(5)
    band = near_duplicates._Bands(*near_duplicates.choose_bands())
    for alike, least in ((0.8, 0.99), (0.85, 0.999)):
        found = 0
        for _ in range(400):
            n = 180
            shared = int(round(2 * n * alike / (1 + alike)))
            x = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            found += bool((band(np.unique(x[:n])) == band(np.unique(np.concatenate((x[:shared], x[n:]))))).any())
        assert found / 400 >= least


def test_keep_one_leaves_clashing_columns_alone(spark):
    df = spark.createDataFrame([(1, prose(50, 30), "keep1", "a"), (2, prose(50, 30), "gone", "b"), (3, prose(51, 30), "keep3", "c")], "doc_id long, text string, own_id string, own_t string")
    assert sorted((r["doc_id"], r["own_id"], r["own_t"]) for r in near_duplicates.keep_one(df).collect()) == [(1, "keep1", "a"), (3, "keep3", "c")]


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in rng.integers(1, 200, 40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets], float)
    got = near_duplicates._overlaps(sets)
    off = ~np.eye(40, dtype=bool)
    assert (got[off] == want[off]).all()


def test_bands_reach_the_recall():
    bands, rows = near_duplicates.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= near_duplicates.MAX_HASHES


def test_near_duplicates_odd_rows(spark, odd, empty):
    assert near_duplicates.near_duplicates(odd).count() == len(ODD)
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "3", "4", "6", "7", "None"])
    assert near_duplicates.keep_one(empty).count() == 0


def test_unrelated_texts_of_one_id_are_classes_of_their_own(spark):
    near = prose(31, 120).split()
    texts = [(None, prose(32, 60)), (None, prose(33, 60)), (None, prose(32, 60)), (5, prose(34, 60)), (5, prose(35, 60)), (6, prose(35, 60)), (7, prose(33, 60)), (None, " ".join(near)), (8, " ".join(["new", *near[1:]]))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), r["text"]) for r in near_duplicates.keep_one(df).collect())
    assert kept == sorted([("None", texts[0][1]), ("None", texts[1][1]), ("None", texts[7][1]), ("5", texts[3][1]), ("5", texts[4][1])])
    _, find = brute_links(texts)
    found = near_duplicates.near_duplicates(df)
    # rows of the same id and text are the same here, so a class is the set of its ids and texts
    text_of = {r["t"]: r["text"] for r in df.select("text", F.xxhash64("text").alias("t")).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for r in found.collect():
        got[r["class_id"], r["class_t"]].add((r["doc_id"], text_of[r["t"]]))
    for k, (d, t) in enumerate(texts):
        want[find(k)].add((-(1 << 63) if d is None else d, t))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(got) == 5


def test_members_meet_only_their_own_text(spark):
    texts = [prose(200 + i, 60) for i in range(12)]
    docs = spark.createDataFrame([(0, t) for t in texts], "doc_id long, text string")
    members = docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text").alias("own"))
    met = near_duplicates._texts_of(docs, members).select("text", "own").collect()
    assert len(met) == 12 and all(r["text"] == r["own"] for r in met)


# quality


def test_classifier_on_held_out_labels(spark, sf_dir):
    docs, pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages", "labels"))
    model = quality_classifier.fit(docs, pages, labels.where("doc_id % 3 <> 0"))
    held = labels.where("doc_id % 3 = 0").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    got = quality_classifier.classify(docs, pages, model).join(held, "doc_id").select("quality", "kept").collect()
    assert np.mean([bool(r["quality"]) == r["kept"] for r in got]) > 0.9


def plain_odds(model, x):
    mean, scale, w = model
    return [sum(min(8.0, max(-8.0, (a - m) / s)) * b for a, m, s, b in zip(row, mean, scale, w, strict=False)) + w[-1] for row in x]


def plain_step(model, rows):
    """One Newton step over weighted rows (x, y, weight), by lists and loops."""
    mean, scale, w = model
    d = len(w)
    pen = [1.0] * (d - 1) + [1e-3]
    g, c = [-p * b for p, b in zip(pen, w, strict=True)], [[pen[i] if i == j else 0.0 for j in range(d)] for i in range(d)]
    for x, y, weight in rows:
        z = [min(8.0, max(-8.0, (a - m) / s)) for a, m, s in zip(x, mean, scale, strict=True)] + [1.0]
        p = 1 / (1 + np.exp(-min(30.0, max(-30.0, sum(a * b for a, b in zip(z, w, strict=True))))))
        for i in range(d):
            g[i] += weight * z[i] * (y - p)
            for j in range(d):
                c[i][j] += weight * z[i] * z[j] * p * (1 - p)
    step = np.linalg.solve(np.array(c), np.array(g))
    return (mean, scale, [a + b for a, b in zip(w, step.tolist(), strict=True)]), np.abs(step).max()


def plain_fit(x, y):
    a = np.array(x)
    scale = [s if s >= 1e-9 else 1.0 for s in a.std(axis=0)]
    model = (a.mean(axis=0).tolist(), scale, [0.0] * (a.shape[1] + 1))
    for _ in range(25):
        model, size = plain_step(model, [(r, t, 1.0) for r, t in zip(x, y, strict=True)])
        if size < 1e-6:
            break
    return model


def plain_co_train(views, y, pools, draw, rounds, per_round):
    """The same by sorting the whole pool: the surest bins first, the last bin by draw."""
    train = [i for i in range(len(y)) if i % 4 != 3]
    own = [[(v[i], y[i]) for i in train] for v in views]
    models = [plain_fit([x for x, _ in o], [t for _, t in o]) for o in own]
    share = sum(y[i] for i in train) / len(train)
    free, given = set(range(len(draw))), [{}, {}]
    width = 60 / quality_classifier.BINS
    for _ in range(rounds):
        told = []
        for k in (0, 1):
            odds = plain_odds(models[k], pools[k])
            at = {i: min(quality_classifier.BINS - 1, max(0, int(np.floor((odds[i] + 30) / width)))) for i in free}
            out = {}
            for label, sign, want in ((0, 1, per_round * len(draw) * (1 - share)), (1, -1, per_round * len(draw) * share)):
                bins, taken = collections.defaultdict(list), 0.0
                for i in free:
                    if (at[i] + (sign < 0)) * width - 30 < -2 if sign > 0 else at[i] * width - 30 >= 2 - 1e-9:
                        bins[sign * at[i]].append(i)
                for b in sorted(bins):
                    part = (want - taken) / len(bins[b])
                    out.update({i: label for i in bins[b] if part >= 1 or draw[i] < part})
                    taken += len(bins[b])
                    if part <= 1:
                        break
            told.append(out)
        for k in (0, 1):
            given[k].update(told[1 - k])
        free -= set(told[0]) | set(told[1])
        for k in (0, 1):
            weight = min(1.0, len(own[k]) / len(given[k])) if given[k] else 0.0
            rows = [(x, t, 1.0) for x, t in own[k]] + [(pools[k][i], t, weight) for i, t in given[k].items()]
            for _ in range(quality_classifier.STEPS):
                models[k], _ = plain_step(models[k], rows)
    hold = [i for i in range(len(y)) if i % 4 == 3]
    odds = [plain_odds(m, [v[i] for i in hold]) for m, v in zip(models, views, strict=True)]
    calibration = [plain_fit([[o] for o in own_odds], [y[i] for i in hold]) for own_odds in odds]
    both = list(zip(*[plain_odds(c, [[o] for o in own_odds]) for c, own_odds in zip(calibration, odds, strict=True)], strict=True))
    return models, calibration, plain_fit([list(b) for b in both], [y[i] for i in hold])


def test_classifier_against_brute_force(spark, sf_dir):
    docs, pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages", "labels"))
    assert docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = quality_classifier.featured(docs, pages).join(labels.groupBy("doc_id").agg(F.min("quality").alias("q")), "doc_id", "left").orderBy("doc_id").collect()
    view = lambda rs, c: [np.frombuffer(r[c], "<f4").astype(float).tolist() for r in rs]
    known, free = [r for r in rows if r["q"] is not None], [r for r in rows if r["q"] is None]
    assert len(known) > 20 and len(free) > 20
    views, pools = ([view(rs, c) for c in ("text_view", "meta_view")] for rs in (known, free))
    models, calibration, combined = plain_co_train(views, [float(r["q"]) for r in known], pools, [r["draw"] for r in free], quality_classifier.ROUNDS, quality_classifier.PER_ROUND)
    scored = {r["doc_id"]: r for r in quality_classifier.classify(docs, pages, quality_classifier.fit(docs, pages, labels)).collect()}
    odds = [plain_odds(c, [[o] for o in plain_odds(m, view(rows, n))]) for c, m, n in zip(calibration, models, ("text_view", "meta_view"), strict=True)]
    for r, a, b in zip(rows, *odds, strict=True):
        want = plain_odds(combined, [[a, b]])[0]
        got = scored[r["doc_id"]]
        for name, o in (("text_score", a), ("meta_score", b), ("score", want)):
            assert abs(got[name] - 1 / (1 + np.exp(-min(30, max(-30, o))))) < 1e-3


def test_classifier_odd_rows(spark, sf_dir, odd, empty):
    docs, pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages", "labels"))
    model = quality_classifier.fit(docs, pages, labels)
    rows = quality_classifier.classify(odd, pages, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["page_url"] + r["both_odds"] == "xx" for r in rows)
    eight = spark.createDataFrame([(d, d % 2) for d in range(8)], "doc_id long, quality long")
    small = quality_classifier.fit(odd.unionByName(odd), pages, eight)  # ids 0 to 7, each in several rows
    assert len(small.views[0].mean) == len(quality_classifier.TEXT_VIEW) and np.isfinite(small.combined.weights).all()
    assert quality_classifier.fit(odd, pages, eight.where("doc_id < 7")) is None and quality_classifier.fit(empty, pages, eight) is None
    assert quality_classifier.classify(empty, pages, model).count() == 0
    none = quality_classifier.fit(docs, pages, labels.limit(0))
    assert none is None and quality_classifier.classify(odd, pages, none).where("kept").count() == len(ODD)


def test_rules_odd_rows(spark, odd, empty):
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == len(ODD) and all(r["kept"] is not None and r["n_words"] is not None and r["words"] + r["lines"] == "xx" for r in rows)
    assert quality_rules.quality_rules(empty).count() == 0
    text = "a b c d e f a b c d e g a b c d e"
    r = quality_rules.measure(spark.createDataFrame([(text,)], "text string")).first()
    assert (r["n_words"], r["n_repeat_words"]) == (17, 15)


# tokens


def test_units_equal_the_library():
    rng = random.Random(4)
    letters = " \n\taabcé,..'stLLªº²12ßİΣ中́ <|>#  tioner\x00"
    for name, blank in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        coder = bpe_units.Encoder(public_tokenizers.path(name), blank)
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|> a", "", " ", "a \x00b"]
        ids, sizes = coder.encode(texts, 9)
        want = [e.ids + [9] for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_wavelet_shard_answers():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50, 9000)
    shard = wavelet.Shard(wavelet.pack_shard(a, [3, None, 5], np.array([9000, 0, 0])))
    assert (shard.decode() == a).all() and shard.doc_ids() == [3, None, 5]
    for at in (0, 1, 4095, 4096, 8999):
        assert shard.access(at) == a[at]
    for token in (0, 7, 49):
        places = np.flatnonzero(a == token)
        assert shard.rank(token) == places.size and shard.occurrences(token)[:50] == places[:50].tolist() and shard.rank(token, 5000) == (a[:5000] == token).sum()
    assert shard.rank(64) == 0 and shard.select(7, 10**6) == -1
    assert wavelet.Shard(wavelet.pack_shard(np.empty(0, np.int64), [], np.empty(0))).decode().size == 0


def test_shards_close_at_a_document(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(300)] + [(None, prose(k, 50)) for k in range(40)], "doc_id long, text string").coalesce(1)
    rows = wavelet.write_shards(docs, path, shard_tokens=1000).collect()
    per = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["part"], r["seq"])):
        per[r["part"]].append(r)
        sizes = wavelet.Shard(r["shard"]).doc_sizes()
        assert r["n_docs"] == sizes.size and r["n_tokens"] == sizes.sum() and sizes[:-1].sum() < 1000
    assert max(map(len, per.values())) > 1 and all(r["n_tokens"] >= 1000 for own in per.values() for r in own[:-1])
    assert sum(r["n_docs"] for r in rows) == 340


def test_foreign_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    bytes_, words = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for path, blank in ((bytes_, False), (words, True)):
        with pytest.raises(ValueError):
            bpe_units.Encoder(path, blank)
    other = Tokenizer.from_file(bytes_)
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    other.save(str(tmp_path / "digits.json"))
    lower = Tokenizer.from_file(bytes_)
    lower.normalizer = normalizers.Lowercase()
    lower.save(str(tmp_path / "lower.json"))
    for name in ("digits.json", "lower.json"):
        with pytest.raises(ValueError):
            bpe_units.Encoder(str(tmp_path / name), True)


def test_wavelet_round_trip(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    shards = wavelet.write_shards(odd, path, shard_tokens=50)
    tokenizer = bpe_units.Encoder(path, False).tokenizer
    want, start = [], 0
    for d, t, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, ids.size, zlib.crc32(ids.tobytes())))
        start += ids.size
    assert sorted(map(tuple, wavelet.token_index(shards).collect()), key=lambda r: r[1]) == want
    assert sum(len(r["ids"]) for r in wavelet.read_tokens(shards).collect()) == 4 * start
    assert wavelet.token_index(wavelet.write_shards(empty, path)).count() == 0


def test_hilbert_neighbours_are_adjacent():
    side = 8
    points = np.array([(x, y) for x in range(side) for y in range(side)])
    order = points[np.argsort(packing.hilbert_keys(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all() and np.unique(packing.hilbert_keys(points, 3)).size == 64


def check_pieces(rows, docs):
    tokenizer = bpe_units.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True).tokenizer
    ids = {d: np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in docs}
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == own.size and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        by[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, own in ids.items():
        at = 0
        for start, n in sorted(by[d]):
            assert start == at
            at += n
        assert at == own.size
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_covers_every_id_once(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_pieces(packing.query(spark, sf_dir).collect(), docs)


def test_packing_bounds_what_is_encoded_at_once(spark, monkeypatch):
    docs = [(i, prose(i, 4000) if i % 2 else "short one") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = sorted(map(tuple, packing.tokenized(df, path).collect()))
    monkeypatch.setattr(packing, "CHARS", 30_000)
    assert sorted(map(tuple, packing.tokenized(df, path).collect())) == whole
    check_pieces(packing.pack_documents(df, path).collect(), docs)


def test_packing_odd_rows(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    single = odd.dropDuplicates(["doc_id"])
    check_pieces(packing.pack_documents(single, path).collect(), [(r["doc_id"], r["text"]) for r in single.collect()])
    assert packing.pack_documents(odd, path).groupBy().sum("length").first()[0] > 0 and packing.pack_documents(empty, path).count() == 0


def test_sentencepiece_equals_the_library(spark, sf_dir, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coder = sentencepiece_bpe.PrefixEncoder(path)
    rng = random.Random(2)
    letters = " \n\taabcé中▁ 　<0x41>'s😀\x00123  tioner"
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for t in docs + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [prose(9, 4000).replace(" ", "")]:
        assert [i for u in coder.encode(t) for i in u[0]] == coder.model.encode(t)
    rows = sentencepiece_bpe.round_trip(odd, path).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_tokens"] == 0 and by[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    ids = coder.model.encode(ODD[9][1])
    assert by[7]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(odd, path), path).where("doc_id = 4").first()
    assert back["decoded"] == ODD[5][1]
    assert sentencepiece_bpe.round_trip(empty, path).count() == 0


# urls and licences


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.Cascade(stored(keys, "keys"), rate=0.3)
    assert len(cascade.levels) > 1 and keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0


def test_levels_stay_small_beside_a_large_universe(spark):
    keys = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 6000 == 0).alias("listed"))
    cascade = url_filter.Cascade(stored(keys, "keys"))
    assert all(level.bits <= cascade.levels[0].bits for level in cascade.levels) and cascade.levels[0].bits < 600
    assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    with pytest.raises(ValueError):
        url_filter.Cascade(stored(keys, "keys"), max_bits=100)


def test_parts_of_the_universe_have_cascades_of_their_own(spark, monkeypatch):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("id") % 3000).alias("url"))
    listed = spark.range(0, 3000, 9).select(F.concat(F.lit("h.org/"), F.col("id")).alias("key"))
    sizes, cascade = [], url_filter.Cascade
    monkeypatch.setattr(url_filter, "Cascade", lambda *a: sizes.append(cascade(*a)) or sizes[-1])
    got = url_filter.url_filter(pages, listed, max_bits=1600).collect()
    assert len(got) == 4000 and all((r["verdict"] == "block") == (r["page_id"] % 3000 % 9 == 0) for r in got)
    assert len(sizes) > 2 and all(level.bits <= 1600 for c in sizes for level in c.levels)


def test_urls_odd_rows(spark):
    urls = [None, "", "nothing", "HTTP://WWW.Example.COM/en/x?q", "http://a.net/fr", "http://a.net/fr/", "http://net/es/1", "x://h", "http://b.org/a#f", "http://b.org/a#f", "http://é.org/\n/z"]
    pages = spark.createDataFrame([(i, u, "r", "k") for i, u in enumerate(urls)], "page_id long, url string, rule string, key string")
    listed = spark.createDataFrame([("b.org/a",), (None,), ("b.org/a",), ("elsewhere/",)], "key string")
    for some in (pages, pages.withColumns({c: F.lit("z") for c in ("hit", "fit", "_fit", "part", "listed")})):
        got = {r["page_id"]: r for r in url_filter.url_filter(some, listed).collect()}
        assert some.columns.count("hit") == 0 or {r["hit"] + r["_fit"] + r["part"] for r in got.values()} == {"zzz"}
        assert [got[i]["verdict"] for i in range(len(urls))] == ["allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "block", "block", "allow"]
        assert got[3]["host"] == "www.example.com" and got[3]["rule"] == "www.example.com/en/" and got[0]["host"] == "" and got[10]["path"] == "/\n/z"
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0 and url_filter.url_filter(pages, listed.limit(0)).where("verdict = 'block'").count() == 2


def test_license_spellings(spark, odd, empty, monkeypatch):
    texts = licenses.default_texts(spark)
    same = ["LICENSED under the Apache Licence -- version 2.0", "Copyright (c) 2020 Somebody\nlicensed under the\tApache License, Version 2.0\nAll rights reserved."]
    other = ["Licensed under the Apache License, Version 2.1.", "", None]
    docs = spark.createDataFrame(list(enumerate(same + other + [f"Intro line.\n{same[0]}\nmore"])), "doc_id long, text string")
    for bound, most in ((10, 10_000), (0, 10_000), (10_000, 0)):
        monkeypatch.setattr(licenses, "MAX_LISTED", most)
        got = {r["doc_id"]: r for r in licenses.license_scan(docs, texts, max_broadcast=bound).collect()}
        assert [got[i]["license"] for i in range(6)] == ["Apache-2.0", "Apache-2.0", None, None, None, None]
        assert got[5]["line_licenses"] == ["Apache-2.0"] and got[3]["digest"] is None
    assert licenses.license_scan(odd, texts, keep=["doc_id"]).columns == ["doc_id", "digest", "license", "line_licenses"]
    assert licenses.license_scan(odd, texts).count() == len(ODD) and licenses.license_scan(empty, texts).count() == 0


def test_whole_licenses_are_known(spark):
    known = [tuple(r) for r in licenses.default_texts(spark).collect()]
    names = {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
    longest = {n: max((t for m, t in known if m == n), key=len, default="") for n in names}
    assert all(len(t) > 650 for t in longest.values())
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n" + min((t for m, t in known if m == "MIT" and len(t) > 650), key=len).replace("\n", " ")
    texts = [*longest.items(), ("MIT", mit), ("BSD-3-Clause", "Copyright 2001 A. Body. All rights reserved.\n" + longest["BSD-3-Clause"].replace("\n", "\n   "))]
    files = [("MPL-2.0", "# SPDX-License-Identifier: MPL-2.0\nx = 1"), ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;"), (None, "SPDX-License-Identifier: Nothing-1.0\nx")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts + files)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(docs, licenses.default_texts(spark)).collect()}
    assert [got[i]["license"] for i in range(len(texts))] == [n for n, _ in texts]
    assert [got[len(texts) + i]["line_licenses"] for i in range(3)] == [["MPL-2.0"], ["GPL-2.0"], []]


# pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert len(good & set(kept[0])) > 0.97 * len(good) and len(kept[1]) > 0.99 * len(kept[0])
    rows = sorted(kept[1].items())
    links, find = brute_links(rows)
    assert set(kept[2]) == {rows[find(k)][0] for k in range(len(rows))}
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), list(kept[2].items()))


def test_pipeline_odd_rows(spark, sf_dir, empty):
    docs = spark.createDataFrame(ODD, DOCS)
    for some in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, some, sf_dir).count()
