import math
from collections import Counter

import numpy as np
import pytest

from loomgrid.llm import brown as B
from loomgrid.llm.common import words


def likelihood(m, of):
    k = of.max() + 1
    g = np.zeros((k, k))
    for i in range(len(m)):
        for j in range(len(m)):
            g[of[i], of[j]] += m[i, j]
    return B.xlogx(g).sum() - B.xlogx(g.sum(0)).sum() - B.xlogx(g.sum(1)).sum()


def test_no_single_move_is_better():
    for seed in range(6):
        m = np.random.default_rng(seed).poisson(0.8, (16, 16)).astype(np.int64)
        of = B.exchange(m, 2, 4, 100, 0)
        best = likelihood(m, of)
        assert best >= likelihood(m, np.r_[np.arange(14) % 4, 4, 5]) - 1e-9
        for w in range(14):
            for c in range(4):
                assert likelihood(m, np.where(np.arange(16) == w, c, of)) <= best + 1e-7


def test_finds_the_classes():
    """Words that follow the same words share a class."""
    m = np.zeros((8, 8), np.int64)
    m[np.ix_([0, 1, 2], [3, 4, 5])] = 50
    m[np.ix_([3, 4, 5], [0, 1, 2])] = 50
    of = B.exchange(m, 2, 2, 50, 0)
    assert len(set(of[:3])) == len(set(of[3:6])) == 1 and of[0] != of[3]


@pytest.fixture(scope="module")
def fitted(spark):
    texts = ["the cat sat on the mat", "a dog sat on a rug", "the dog ran", "the cat ran to a mat"] * 5 + ["rare words here"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, word int, n string")
    return docs, texts, B.fit(docs, vocabulary=8, classes=3)


def test_counts_cover_the_corpus(fitted):
    docs, texts, model = fitted
    want = Counter(w for t in texts for w in words(t))
    assert {bytes(r.word): r.n for r in B.counted(docs).collect()} == want
    top = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:8]
    assert list(model.ids) == [w for w, _ in top]


def test_probabilities_sum_to_one(fitted):
    _, texts, model = fitted
    assert np.allclose(np.exp(model.next).sum(axis=1), 1)
    types = len({w for t in texts for w in words(t)}) - len(model.ids)
    for c in set(model.of.tolist()):
        own = [w for w in range(len(model.of)) if model.of[w] == c]
        total = sum(math.exp(model.emit[w]) * (types + 1 if w == model.other else 1) for w in own)
        assert abs(total - 1) < 1e-9


def test_scores_against_a_loop(fitted):
    docs, texts, model = fitted
    for r in B.scores(docs, model).collect():
        s = [model.edge, *(model.ids.get(w, model.other) for w in words(texts[r.doc_id])), model.edge]
        p = sum(model.next[model.of[a], model.of[b]] + model.emit[b] for a, b in zip(s, s[1:]))
        assert r.n_words == len(s) - 2 and abs(r.log_prob - p) < 1e-9 and abs(r.perplexity - math.exp(-p / (len(s) - 1))) < 1e-6
    by = {r.doc_id: r.perplexity for r in B.scores(docs, model).collect()}
    assert by[0] < by[20]


def test_awkward(awkward, nothing):
    rows = B.scores(awkward, B.fit(awkward, vocabulary=50, classes=5)).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[k].n_words == 0 and by[k].perplexity is None and by[k].log_prob is None for k in (3, 4, 5))
    assert by[6].n_words == 120_000 and by[7].n_words == 1
    empty = B.fit(nothing)
    assert B.scores(nothing, empty).count() == 0 and B.scores(awkward, empty).count() == awkward.count()


def plain(texts, vocabulary, classes):
    """log_prob of each text under the model of all words, by loops; the words' classes."""
    count = Counter(w for t in texts for w in words(t))
    top = sorted(count, key=lambda w: (-count[w], w))[:vocabulary]
    ids = {w: k for k, w in enumerate(top)}
    other, edge = len(top), len(top) + 1
    seqs = [[None, *words(t), None] for t in texts if t and words(t)]
    m = np.zeros((len(top) + 2,) * 2, np.int64)
    for s in seqs:
        for a, b in zip(s, s[1:]):
            m[edge if a is None else ids.get(a, other), edge if b is None else ids.get(b, other)] += 1
    of = B.exchange(m, 2, classes)
    k = of.max() + 1

    def table(cls):
        g = np.zeros((k, k))
        for s in seqs:
            for a, b in zip(s, s[1:]):
                g[cls(a), cls(b)] += 1
        return g

    rough = lambda w: of[edge if w is None else ids.get(w, other)]
    behind, before = B.transitions(table(rough)), B.transitions(table(rough).T)
    own = {}
    for w in sorted(set(count) - set(top)):
        score = np.zeros(k - 2)
        for s in seqs:
            for j, x in enumerate(s):
                if x == w:
                    score += before[: k - 2, rough(s[j - 1])] + behind[: k - 2, rough(s[j + 1])]
        own[w] = int(np.argmax(np.round(score, 9)))
    cls = lambda w: own[w] if w in own else rough(w)
    step = B.transitions(table(cls))
    tokens, types = Counter(), Counter()
    for w, n in count.items():
        tokens[cls(w)] += n
        types[cls(w)] += 1
    emit = {None: 0.0} | {w: math.log((n + B.ADDED) / (tokens[cls(w)] + B.ADDED * types[cls(w)])) for w, n in count.items()}
    return [sum(step[cls(a), cls(b)] + emit[b] for a, b in zip(s, s[1:])) for s in seqs], emit, own


def test_all_words_against_loops(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 30) % 90) for _ in range(60)]
    want, emit, own = plain(texts, 12, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in B.scored(docs, vocabulary=12, classes=4).collect()}
    assert len(own) > 20 and len(set(own.values())) > 1
    assert np.allclose([got[k].log_prob for k in range(60)], want, atol=1e-6)
    assert all(abs(got[k].perplexity - math.exp(-want[k] / 31)) < 1e-6 for k in range(60))


def test_words_beyond_the_most_frequent_keep_their_counts(spark, tmp_path):
    """Neither a frequent nor a rare one of the words beyond VOCABULARY is scored as the other."""
    fill = [" ".join(f"f{(k + 97 * j) % (B.VOCABULARY + 4)}" for k in range(B.VOCABULARY + 4)) for j in range(12)]
    texts = [*fill, *["f1 often f2"] * 9, "f1 seldom f2"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    by = {r.doc_id: r.perplexity for r in B.query(spark, str(tmp_path)).collect()}
    assert len(by) == len(texts) and by[len(fill)] < by[len(texts) - 1] * 0.9


def test_all_words_awkward(awkward, nothing):
    rows = B.scored(awkward, vocabulary=50, classes=5).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[k].n_words == 0 and by[k].perplexity is None and by[k].log_prob is None for k in (3, 4, 5))
    assert by[6].n_words == 120_000 and by[7].n_words == 1
    assert B.scored(nothing).count() == 0 and B.scored(awkward.filter("doc_id = 4")).count() == 1
