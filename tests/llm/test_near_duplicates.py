import re
from itertools import combinations

import numpy as np
import pytest
from lectern.llm import embedding_dedup, minhash_dedup
from lectern.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def joined(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def group(r, words, copies, edits):
    base = [f"w{r.integers(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for k in r.integers(0, words, r.integers(0, edits + 1)):
            text[k] = f"x{r.integers(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(4)
    out = [*group(r, 120, 60, 4), *group(r, 60, 40, 3), *group(r, 8, 10, 1)]
    passage = " ".join(f"p{k}" for k in range(60))
    out += [passage + " " + " ".join(f"q{r.integers(10**6)}" for _ in range(40)) for _ in range(30)]  # share a passage, not alike
    out += ["", None, " \n", "one", "ONE", "two words", "a b c d e", "A b C d e", *(["same text of seven words right here"] * 20)]
    return [out[k] for k in r.permutation(len(out))]


def test_minhash_against_brute_force(spark, texts):
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = joined(len(texts), links)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, component string")
    for kw in ({}, {"block": 8, "star_rounds": 0}, {"block": 8, "star_rounds": 0, "short": 8}):
        got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs, **kw).collect()}
        assert [got[k].component_id for k in range(len(texts))] == want, kw
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert all(got[k].kept == (want[k] == k) for k in got)
    stay = minhash_dedup.keep_one(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(want))


def test_minhash_clusters_of_long_texts(spark, monkeypatch):
    """Long texts that are alike below the threshold, with a few links among them: nothing but what joins them leaves a task."""
    r = np.random.default_rng(8)
    base = [f"w{k}" for k in range(3000)]
    texts = []
    for c in range(40):
        own = [*base[:2300], *(f"c{c}x{k}" for k in range(700))]  # 2296 of about 3,700 shingles shared: 0.62
        texts.append(" ".join(own))
        if c % 8 == 0:  # near copies, one of them a link to a longer one
            texts += [" ".join([*own[:-200], *(f"d{c}y{k}" for k in range(200))]), " ".join([*own, *(f"e{c}z{k}" for k in range(600))])]
    texts = [texts[k] for k in r.permutation(len(texts))]
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want, seen = joined(len(texts), links), []
    blocks = minhash_dedup._blocks

    def counted(*args):
        out = blocks(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "_blocks", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kw in ({"star_rounds": 0}, {"star_rounds": 0, "block": 16, "short": 100}, {}):
        got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(docs, **kw).collect()}
        assert [got[k] for k in range(len(texts))] == want
    assert seen and max(seen) <= len(texts)


def test_minhash_edges(spark):
    schema = "doc_id long, text string"
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (None, None), (5, "z " * 100_000), (6, "Z " * 100_000)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (None, 0, None, True), (5, 1, 5, True), (6, 1, 5, False)], key=str)


def test_estimate_is_corrected():
    r = np.random.default_rng(0)
    for similarity in (0.0, 0.5, 0.75, 0.9):
        found = []
        for _ in range(60):
            both = int(400 * similarity)
            h = r.integers(0, 1 << 63, 800 - both).astype(np.uint64)
            a, b = np.sort(h[:400]), np.sort(np.concatenate([h[:both], h[400:]]))
            x, y = (minhash_dedup.unpack([minhash_dedup.signature(s)[0]])[0] for s in (a, b))
            found.append(minhash_dedup.estimate(x, y))
        j = both / (800 - both)
        assert abs(np.mean(found) - j) < 0.03 and np.std(found) < 0.06


def test_components(spark):
    r = np.random.default_rng(1)
    for edges in (r.integers(0, 60, (40, 2)).tolist(), [[k, k + 1] for k in range(70)], [[0, k] for k in range(1, 90)], []):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = joined(100, edges)
        assert got == {k: want[k] for k in {x for e in edges if e[0] != e[1] for x in e}}


def brute(vectors, cosine=0.9):
    ok = [k for k, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([vectors[k] for k in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(x @ x.T >= cosine, 1)
    links = [(ok[a], ok[b]) for a, b in zip(*np.nonzero(near), strict=True)]
    n = [0] * len(vectors)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, joined(len(vectors), links)


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 16))
    vectors = [(base[k % 40] + r.normal(size=16) * r.choice([0, 0.05, 0.15, 0.4])).tolist() for k in range(700)]
    vectors += [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, vectors[3], [2 * x for x in vectors[3]], [1e-200] * 16, [1e200] * 16]
    n, label = brute([v and [x if x is None or abs(x) < 1e100 or not np.isfinite(x) else 1.0 for x in ([1.0] * 16 if v == [1e-200] * 16 else v)] for v in vectors])
    rows = spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, component string")
    for kw in ({}, {"sample": 100, "max_leaves": 16, "block": 32}):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(rows, **kw).collect()}
        assert [got[k].n_links for k in range(len(vectors))] == n
        assert [got[k].component_id for k in range(len(vectors))] == label
        assert all(got[k].kept == (label[k] == k) for k in got)


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0]), (3, None)], schema)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)], key=str)


def clustered(r, n, centres, width, spread):
    x = np.concatenate([c + spread * r.normal(size=(n // centres, width)) for c in r.normal(size=(centres, width))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("spread", [0.02, 0.1, 10.0])
def test_cover_tree(spread):
    """Nested, covering, separated levels of halving radii; the traversal loses nothing, and cuts off most where there is structure."""
    r = np.random.default_rng(2)
    x = clustered(r, 3000, 40, 16, spread)
    x = np.concatenate([x, x[:300] + 1e-4 * r.normal(size=(300, 16))])
    x = x[r.permutation(len(x))] / np.linalg.norm(x, axis=1, keepdims=True)[0] * 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = embedding_dedup.tree(x, 0.05)
    assert t.centres.shape[1] >= 5 and (t.centres[:, 0] == 0).all()
    for k in range(t.centres.shape[1]):
        net = np.unique(t.centres[:, k])
        assert (t.centres[net, k] == net).all()
        far = np.linalg.norm(x - x[t.centres[:, k]], axis=1)
        assert all(abs(far[t.centres[:, k] == c].max() - t.radii[c, k]) < 1e-6 for c in net[:50])
        gaps = np.sqrt(np.maximum(2 - 2 * x[net] @ x[net].T, 0)) + 9 * np.eye(len(net))
        assert gaps.min() > 2.0 ** (1 - k) - 1e-6
        if k:
            assert set(np.unique(t.centres[:, k - 1])) <= set(net)
            assert (t.centres[t.centres[:, k], k - 1] == t.centres[:, k - 1]).all()
    i, j, tested = embedding_dedup.close(t, None, 0.99)
    want = np.argwhere(np.triu(x @ x.T >= 0.99, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))
    a, b = embedding_dedup.tree(x[:1500], 0.05), embedding_dedup.tree(x[1500:2100], 0.3)
    i, j, _ = embedding_dedup.close(a, b, 0.99)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(x[:1500] @ x[1500:2100].T >= 0.99).tolist()))
    assert tested < len(x) * (len(x) - 1) / (8 if spread < 1 else 2)


def test_embeddings_with_and_without_structure(spark):
    r = np.random.default_rng(5)
    for x in (clustered(r, 1200, 30, 12, 0.05), clustered(r, 900, 1, 64, 10.0), np.eye(8)[np.arange(40) % 8]):
        vectors = [*x.tolist(), *(x[:60] + 1e-3).tolist()]
        n, label = brute(vectors)
        rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
        for kw in ({}, {"sample": 200, "max_leaves": 40, "block": 64}):
            got = {q.vec_id: q for q in embedding_dedup.near_duplicates(rows, **kw).collect()}
            assert [got[k].n_links for k in range(len(vectors))] == n and sum(n)
            assert [got[k].component_id for k in range(len(vectors))] == label
