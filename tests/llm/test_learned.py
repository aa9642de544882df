"""Held-out accuracy of the two learned operators, and their odd rows."""

import zlib

import numpy as np

from paperloom.llm import boosted_quality, language_id
from paperloom.llm.queries import QUERIES

from .conftest import documents


def test_quality_held_out(spark):
    got = QUERIES["op2_boosted_quality"](spark, "/root/testdata/sf0.01").collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.9
    assert np.mean([a for a, b in held if b == 1]) > 0.95


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 1), (9, 0), (None, 1), (7, None), (7, 5)], "doc_id long, quality int")
    trees = boosted_quality.learn(odd, labels)
    got = boosted_quality.score(odd, trees)
    assert got.count() == odd.count() and sorted(got.columns) == sorted(odd.columns)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert boosted_quality.score(none, boosted_quality.learn(none, labels)).count() == 0
    alone = boosted_quality.learn(odd, labels.limit(0))
    assert len(alone.feature) == 0 and {r["score"] for r in boosted_quality.score(odd, alone).collect()} == {0.5}


def test_trees_go_down_as_one_by_one():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 6)), 1)
    t = boosted_quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=15)

    def one(row):
        total = t.base
        for f, cut, leaf in zip(t.feature, t.threshold, t.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > cut[at] else 1)
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.score(x), [one(r) for r in x])


def test_language_held_out(spark):
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in documents(spark, "sf0.01").collect()}
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["lang_pred"] != "und" and lang[r["doc_id"]]]
    assert len(held) > 200 and np.mean(held) > 0.95


def test_language_edges(spark, odd, none):
    rows = [(1, "the quick brown fox and the dog", "en"), (2, "der schnelle braune fuchs und der hund", "de"), (3, "le renard brun et le chien", "fr"), (4, "xx yy", None), (5, None, "en"), (6, "12", "qq"), (None, "saya suka kucing", "id")]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.families == ["germanic", "romance"] and model.members["germanic"] == ["de", "en"]
    got = language_id.predict(odd, model)
    assert got.count() == odd.count()
    for r in got.collect():
        empty = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == empty and 0 <= r["score"] <= 1
    assert language_id.predict(none, model).count() == 0
    blank = language_id.learn(none.selectExpr("doc_id", "text", "host as lang"))
    assert {r["lang_pred"] for r in language_id.predict(odd, blank).collect()} == {"und"}


def test_language_does_not_depend_on_neighbours():
    """A text alone, first, in the middle and last of a batch has the same features."""
    import pyarrow as pa

    texts = [" the dog ", " a", "le chien  ", "", "  ", None, "x", " der hund und ", " 日本 "]
    whole, letters = language_id.features(pa.array(texts, pa.string()))
    for order in (range(len(texts)), reversed(range(len(texts))), [3, 0, 3, 8, 8, 1, 7, 2, 6, 5, 4]):
        order = list(order)
        x, found = language_id.features(pa.array([texts[i] for i in order], pa.string()))
        assert (x == whole[order]).all() and (found == letters[order]).all()
    for i, t in enumerate(texts):
        assert (language_id.features(pa.array([t], pa.string()))[0][0] == whole[i]).all()


def test_samples_bound_rows(spark, monkeypatch):
    """However often an id or a row repeats, no more than the sample reaches the driver."""
    rows = [(1, "same text and words", "en")] * 500 + [(2, f"another text {i} of it", "en") for i in range(300)] + [(3, "der hund und die katze", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    fit_language, fit_trees = language_id.fit, boosted_quality.fit
    monkeypatch.setattr(language_id, "fit", lambda x, lang: seen.append(len(x)) or fit_language(x, lang))
    monkeypatch.setattr(boosted_quality, "fit", lambda x, y: seen.append(len(x)) or fit_trees(x, y))
    language_id.learn(docs, sample=10)
    language_id.learn(docs)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0)] + [(1, 1)] * 50, "doc_id long, quality int")
    boosted_quality.learn(docs, labels, sample=10)
    boosted_quality.learn(docs, labels)
    assert seen == [10, 302, 10, 602]


def test_trees_fit_as_plain_boosting():
    """Splits, leaves and scores against boosting with loops over rows, features and cuts."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(60, 3)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float)
    trees, depth, bins, rate, l2 = 4, 2, 6, 0.3, 1.0
    got = boosted_quality.fit(x, y, trees, depth, bins, rate, l2)
    margin = [got.base] * len(y)
    assert abs(got.base - np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) < 1e-12
    edges = [sorted({float(np.quantile(c, q / bins)) for q in range(1, bins)}) for c in x.T]
    for t in range(trees):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        grad, hess = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]
        node = [0] * len(y)
        for level in range(depth):
            for n in range(2**level - 1, 2 ** (level + 1) - 1):
                own = [r for r in range(len(y)) if node[r] == n]
                total = (sum(grad[r] for r in own), sum(hess[r] for r in own))
                best = (1e-9, None, None)
                for f in range(3):
                    for cut in edges[f]:
                        low = [r for r in own if x[r, f] <= cut]
                        g, h = sum(grad[r] for r in low), sum(hess[r] for r in low)
                        if h < 1 or total[1] - h < 1:
                            continue
                        gain = g * g / (h + l2) + (total[0] - g) ** 2 / (total[1] - h + l2) - total[0] ** 2 / (total[1] + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
                if best[1] is None:
                    assert got.threshold[t, n] == np.inf
                else:
                    assert (got.feature[t, n], got.threshold[t, n]) == best[1:]
                for r in own:
                    right = best[1] is not None and x[r, best[1]] > best[2]
                    node[r] = 2 * n + 1 + right
        for leaf in range(2**depth):
            own = [r for r in range(len(y)) if node[r] == 2**depth - 1 + leaf]
            value = rate * sum(grad[r] for r in own) / (sum(hess[r] for r in own) + l2)
            assert abs(got.leaf[t, leaf] - value) < 1e-9
            for r in own:
                margin[r] += value
    assert np.allclose(got.score(x), [1 / (1 + np.exp(-m)) for m in margin])


def test_one_versus_one_goes_by_family_then_votes():
    """Predictions against the two steps taken for one row at a time."""
    rng = np.random.default_rng(6)
    langs = ["en", "de", "nl", "fr", "es", "qq"]
    centre = {c: rng.normal(size=language_id.DIMS) for c in langs}
    lang = [langs[i % 6] for i in range(240)]
    x = np.array([centre[c] + rng.normal(size=language_id.DIMS) for c in lang], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language_id.fit(x, lang)
    assert model.families == ["germanic", "other", "romance"]
    got, score = model.predict(x)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for row, name, s in zip(x, got, score):
        margin = [sigmoid(2 * (row @ w + b)) for w, b in zip(model.family_w, model.family_b)]
        f = int(np.argmax(margin))
        own = model.members[model.families[f]]
        votes, share = {c: 0.0 for c in own}, 1.0
        for (i, j), w, b in zip(*model.pairs.get(model.families[f], ([], [], []))):
            p = sigmoid(2 * (row @ w + b))
            votes[own[i]] += p
            votes[own[j]] += 1 - p
        if len(own) > 1:
            share = max(votes.values()) / (len(own) - 1)
        assert name == max(own, key=lambda c: votes[c]) and abs(s - margin[f] / sum(margin) * share) < 1e-6
    assert np.mean([a == b for a, b in zip(got, lang)]) > 0.9
