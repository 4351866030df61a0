"""The trained operators: gradients, held-out accuracy, whole texts, odd rows."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import language, pii, quality, tokens, toxicity
from rivulet.llm.common import bounded_sample

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "1234 567 !!"), (-5, "é" * 3), (-6, "word " * 60_000), (-6, "word " * 60_000), (None, "a text without id")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, x int, held_out int"


def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'s' AS score", "1 AS x", "0 AS held_out")
    odd = spark.createDataFrame([(i, t, "en", None, None, None, 1, 0) for i, t in ODD], DOCS)
    return docs.union(odd).repartition(4).cache(), spark.read.parquet(f"{SF}/labels.parquet")


def crc(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def columns(texts):
    return pa.array([t if t is None else t.encode() for t in texts], pa.binary())


def test_words_and_grams():
    rng = np.random.default_rng(0)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\x0b", "\r\n", "xyz"]
    texts = [None, "", " ", *("".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(200))]
    for most in (1, 50, 1 << 20):
        found, counts, hashes = [], [], {}
        for part in tokens.parts(columns(texts).slice(1), most):
            low = tokens.LOWER[part.data]
            w = tokens.words(low, part.ends)
            found += [low[a:b].tobytes() for a, b in zip(w.starts, w.ends)]
            counts += w.counts.tolist()
            for word, h in zip(found[-len(w.starts) :], w.hashes.tolist()):
                assert hashes.setdefault(word, h) == h
            g, at = tokens.grams(w, 2)
            assert len(g) == sum(max(0, c - 1) for c in w.counts)
        want = [(t or "").encode().translate(bytes(tokens.LOWER)).split() for t in texts[1:]]
        assert found == [x for t in want for x in t] and counts == list(map(len, want))
        assert len(set(hashes.values())) == len(hashes)


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(1)
    net = toxicity.Network.random(rng, np.arange(1, 40, dtype=np.uint64) << np.uint64(50))
    n = 5
    word = rng.integers(0, len(net.p["word"]), (toxicity.WINDOW, n))
    grams = [rng.integers(0, 64, rng.integers(0, 5)) for _ in range(toxicity.WINDOW * n)]
    real = rng.random((toxicity.WINDOW, n)) < 0.8
    real[0] = True
    y, weight = rng.integers(0, 2, n).astype(float), rng.random(n)
    _, grads = toxicity.gradients(net, word, grams, real, y, weight)
    for name, value in net.p.items():
        flat, g = value.reshape(-1), grads[name].reshape(-1)
        for k in rng.permutation(np.flatnonzero(np.abs(g) > 1e-8))[:6]:
            keep, loss = flat[k], []
            for step in (1e-5, -1e-5):
                flat[k] = keep + step
                loss.append(toxicity.gradients(net, word, grams, real, y, weight)[0])
            flat[k] = keep
            assert g[k] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-3, abs=1e-7), name


def test_scoring_agrees_with_training_and_does_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 5, 8, 9, 16, 17, 40, 100)]
    part = next(iter(tokens.parts(columns(texts))))
    x = toxicity.read(part)
    net = toxicity.Network.random(rng, np.unique(x.hashes))
    logit, doc, first = net.single().logits(x)
    starts = np.cumsum(x.counts) - x.counts
    ends = np.append(x.at, len(x.grams))
    ids = net.words(x.hashes)
    for window in range(len(doc)):
        at = starts[doc[window]] + first[window] + np.arange(toxicity.WINDOW)
        real = (at < starts[doc[window]] + x.counts[doc[window]])[:, None]
        at = np.where(real[:, 0], at, 0)
        cells = [x.grams[ends[a] : ends[a + 1]] if r else x.grams[:0] for a, r in zip(at, real[:, 0], strict=True)]
        loss, _ = toxicity.gradients(net, ids[at][:, None], cells, real, np.ones(1), np.ones(1))
        assert np.logaddexp(0, -logit[window]) == pytest.approx(loss, abs=1e-4)
    counts = np.maximum(1, -(-np.maximum(x.counts - toxicity.STRIDE, 0) // toxicity.STRIDE))
    assert np.bincount(doc).tolist() == counts.tolist()
    together = toxicity.document_logits(net.single(), x)
    for k, t in enumerate(texts):
        alone = toxicity.document_logits(net.single(), toxicity.read(next(iter(tokens.parts(columns([t]))))))
        assert alone[0] == pytest.approx(together[k], abs=1e-5)


def test_gradients_lead_the_byte_network():
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for k in range(300):
        label = k % 3
        texts.append(" ".join("".join(rng.choice(list(("abcde", "cdefg", "fghia")[label]), 5)) for _ in range(30)))
        labels.append(label)
    rows = np.zeros((300, language.LENGTH), np.uint8)
    for i, t in enumerate(texts):
        rows[i, : len(t)] = np.frombuffer(t.encode()[: language.LENGTH], np.uint8)
    net = language.train(rows, np.array(labels), ["x", "y", "z"], epochs=8)
    place, score = language.predict(net, net.pairs(), columns(texts))
    assert (place == labels).mean() > 0.98 and (score > 0.34).all()
    # the summed tables give what the plain filters give
    x = rows[:7].astype(np.int64)
    pooled = np.hstack([sum(t[k][x[:, k : language.LENGTH - w + 1 + k]] for k in range(w)).max(axis=1) for w, t in net.tables.items()])
    assert net.logits(rows[:7], net.pairs()) == pytest.approx(np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias, abs=1e-3)


def test_windows_cover_every_byte():
    sizes = [0, 1, 252, 253, 254, 256, 257, 509, 5000]
    data = np.ones(sum(sizes), np.uint8)
    rows, doc, weight = language.windows(data, np.cumsum(sizes))
    assert rows.shape[1] == language.LENGTH
    seen = np.bincount(doc, weight, len(sizes))
    for k, n in enumerate(sizes):
        assert n - (language.LENGTH - language.STEP) <= seen[k] <= n and (rows[doc == k].sum() >= n)


@needs_tables
def test_toxicity_held_out(spark):
    docs, labels = tables(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (crc(r.doc_id, 3) == 1) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    pairs = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.88
    assert sum(a > b for a, b in pairs) <= 4  # clean texts are left alone
    both = sum(a and b for a, b in pairs)
    assert both / sum(b for _, b in pairs) > 0.7 and both / sum(a for a, _ in pairs) > 0.8  # recall, precision
    assert {r.score for r in got if r.doc_id in (-1, -2, -3)} == {0.0}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, labels).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), labels).count() == 0


@needs_tables
def test_quality_held_out(spark):
    docs, labels = tables(spark)
    got = quality.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (crc(r.doc_id, 5) == 0) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    pairs = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.95
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0


def test_quality_parts():
    assert quality.isotonic(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1])).tolist() == [0, 0.5, 0.5, 1]
    rng = np.random.default_rng(4)
    texts = [None, "", "A", "ONE TWO!!\nONE TWO!!", *("".join(rng.choice(list("aB c.\n1é"), 50)) for _ in range(50))]
    whole = np.concatenate([quality.statistics(p) for p in tokens.parts(columns(texts))])
    single = np.concatenate([quality.statistics(p) for p in tokens.parts(columns(texts), 1)])
    assert whole == pytest.approx(single) and whole.shape == (54, quality.FEATURES) and np.isfinite(whole).all()
    # cosines approximate the Gaussian kernel
    x = rng.normal(size=(40, 5))
    z = quality.Cosines(np.zeros(5), np.ones(5), 4000, 2.0)(x)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-far / 8)).max() < 0.1


@needs_tables
def test_language_held_out(spark):
    docs, _ = tables(spark)
    got = language.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.where("doc_id >= 0").collect()}
    assert len(got) == docs.count() and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    pairs = [(r.lang_pred, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.97
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (-1, -2, -3, -4)} == {("und", 0.0)}
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (-5, -6, None))
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).limit(5).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_bounded_samples(spark):
    row = lambda i: (i, f"text {i}", i % 3)
    many = spark.createDataFrame([row(i) for i in range(5000)], "id long, text string, kind int")
    sample = lambda df, n, by=None: [r.text for r in bounded_sample(df, n, [F.col("text")], by).collect()]
    got = sample(many, 1000)
    assert len(got) == len(set(got)) == 1000 and sorted(got) == sorted(sample(many.repartition(7), 1000))
    nameless = many.withColumn("id", F.lit(None).cast("long"))
    assert sorted(sample(nameless, 1000)) == sorted(got)
    hot = many.union(spark.range(20_000).selectExpr("id", "'the same'", "0"))
    assert 900 < len(set(sample(hot, 1000))) <= 1000
    few = spark.range(30_000).selectExpr("id", "concat('t', id % 7) AS text", "0")
    assert sorted(sample(few, 1000)) == [f"t{k}" for k in range(7)] and len(sample(few, 3)) == 3
    kinds = [r.kind for r in bounded_sample(hot, 900, [F.col("text")], F.when(F.col("kind") < 2, F.col("kind"))).collect()]
    assert kinds.count(0) == kinds.count(1) == 450 and kinds.count(2) == 0
    assert sample(many.limit(0), 10) == []


@needs_tables
def test_learning_from_rows_without_or_with_few_ids(spark):
    docs, labels = tables(spark)
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    truth = {r.text: r.lang for r in docs.where("lang IS NOT NULL").collect()}
    net = language.learn(nameless.select("text", "lang"), F.lit(True))
    place, _ = language.predict(net, net.pairs(), columns(list(truth)))
    assert np.mean([net.languages[p] == lang for p, lang in zip(place, truth.values())]) > 0.95
    assert pii.learn(nameless) is not None
    few = docs.where("doc_id BETWEEN 0 AND 90").crossJoin(spark.range(30).select(F.lit(1).alias("again")))  # each row 30 times
    assert toxicity.learn(few, labels.crossJoin(spark.range(3).select(F.lit(1).alias("again"))), F.lit(True)) is not None
    assert toxicity.learn(nameless, labels, F.lit(True)) is None
    # a language of few texts is learned beside one of many
    rare = spark.createDataFrame([(k, "zqx " * 50 + str(k), "rare") for k in range(40)], "doc_id long, text string, lang string")
    net = language.learn(docs.select("text", "lang").union(rare.select("text", "lang")), F.lit(True), 400)
    assert "rare" in net.languages


def test_quality_against_a_direct_solution(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "Gamma", "delta!", "9", "|", "x"]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 5], 5 + i % 40))) for i in range(300)] + [(7, "repeated id"), (None, "no id")]
    marks = [(i, int(i % 5 > 2)) for i in range(0, 300, 2)] + [(4, 1), (4, 0), (7, 1), (8, None), (None, 1), (5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)  # a tree of several levels
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {(r.doc_id, round(r.score, 9)) for r in quality.score(docs, labels).collect()}
    x = np.concatenate([quality.statistics(p) for p in tokens.parts(columns([t for _, t in rows]))])
    z = quality.Cosines(x.mean(0), x.std(0))(x)
    learned = [(z[k], y) for k, (i, _) in enumerate(rows) for j, y in marks if i is not None and i == j and y is not None and crc(i, 5) != 0]
    a, y = np.array([r for r, _ in learned]), np.array([r for _, r in learned], float)
    weights = np.linalg.solve(a.T @ a + quality.RIDGE * len(y) * np.eye(len(a.T)), a.T @ y)
    bins, at = np.unique(quality._bin(a @ weights), return_inverse=True)
    share = quality.isotonic(np.bincount(at).astype(float), np.bincount(at, y))
    want = np.clip(np.interp(quality._bin(z @ weights), bins, share), 0, 1)
    direct = {(i, round(s, 9)) for (i, _), s in zip(rows, want)}
    near = sum(any(i == j and abs(s - t) < 1e-6 for j, t in direct) for i, s in got)
    assert len(got) == len(direct) and near >= 0.99 * len(got)  # a bin's edge may fall between two sums of the same numbers


def test_long_texts_are_scored_in_pieces(monkeypatch):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(300)] + ["x" * 90]
    texts = [" ".join(rng.choice(vocabulary, n)) + end for n in (1, 7, 8, 9, 63, 64, 65, 500, 1003, 1600) for end in ("", " ", "!" * 400)] + ["y" * 3000, " " * 3000]
    hashes = toxicity.read(next(iter(tokens.parts(columns(texts))))).hashes
    net = toxicity.Network.random(rng, np.unique(hashes)).single()
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        want = toxicity.document_logits(net, toxicity.read(tokens.Part(0, data, np.array([len(data)]))))[0]
        for piece in (100, 333, 1024):
            assert toxicity.long_logit(net, data, piece) == pytest.approx(want, abs=1e-5)
    languages = language.Network(["a", "b"], {w: rng.normal(0, 0.1, (w, 256, language.FILTERS)) for w in language.WIDTHS}, np.zeros(36), rng.normal(0, 0.3, (36, 2)), np.zeros(2))
    whole = language.predict(languages, languages.pairs(), columns(texts))
    for piece in (260, 700, 1500):
        monkeypatch.setattr(language, "PIECE", piece)
        place, score = language.predict(languages, languages.pairs(), columns(texts))
        assert place.tolist() == whole[0].tolist() and score == pytest.approx(whole[1], abs=1e-5)


def test_words_do_not_depend_on_where_pieces_end(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [b"", b" \n ", b"x" * 700, *(bytes(rng.choice(list(b"abAB1! \n\t"), rng.integers(1, 400)).astype(np.uint8)) for _ in range(60))]
    column = pa.array([*texts, None, "é ".encode() * 90], pa.binary())

    def all_of() -> tuple:
        parts = list(tokens.parts(column))
        w = [tokens.words(tokens.mapped(p.data, tokens.LOWER), p.ends) for p in parts]
        return [(x.starts, x.ends, x.doc, x.hashes, x.counts) for x in w], [quality.statistics(p) for p in parts]

    words, statistics = all_of()
    for piece in (1, 3, 64, 1000):
        monkeypatch.setattr(tokens, "PIECE", piece)
        again, of = all_of()
        assert all(np.array_equal(x, y) for a, b in zip(words, again, strict=True) for x, y in zip(a, b, strict=True))
        assert all(np.array_equal(x, y) for x, y in zip(statistics, of, strict=True))
    # a document alone has the statistics that it has among others
    alone = [quality.statistics(p) for p in tokens.parts(column, 1)]
    assert np.allclose(np.concatenate(alone), np.concatenate(statistics))
