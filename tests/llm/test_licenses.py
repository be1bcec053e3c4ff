import numpy as np
from lectern.llm import licenses


def test_found_where_they_stand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = licenses.scan(docs).toPandas().sort_values("doc_id")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for name in ("MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice"):
        line = licenses.TEMPLATES[name]
        want = {i for i, t in texts.items() if line in t}
        mine = rows[rows.license == name]
        assert want and set(mine.doc_id) == want
        assert all(texts[r.doc_id][r.start : r.end] == line.rstrip(".") and r.coverage == 1 for r in mine.itertuples())
    assert (rows.groupby("doc_id").size() >= 1).all()


def test_altered_long_and_odd(spark):
    grant = licenses.TEMPLATES["MIT-grant"]
    altered = grant.replace("obtaining", "getting").replace("limitation ", "").replace("Software", "WORK", 1)
    rows = [(1, "é " * 50_000 + altered + " tail", "x"), (2, None, "x"), (3, "", "x"), (None, "Released under the\n MIT license", "x"), (4, "released under the mit", "x"), (4, "Released under the MIT License. " * 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted(((str(r.doc_id), r.license, r.start, r.end, r.coverage) for r in licenses.scan(docs).collect()), key=str)
    long = [g for g in got if g[0] == "1"]
    assert len(long) == 1 and long[0][1:4] == ("MIT-grant", 100_000, 100_000 + len(altered) - 1) and 0.9 < long[0][4] < 1
    assert ("None", "MIT-notice", 0, 31, 1.0) in got
    assert [g[2] for g in got if g[0] == "4" and g[4] == 1] == [0, 32, 64]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_winnowing_guarantee():
    """Whatever words are missing, as long as enough are left, one of the postings is left."""
    r = np.random.default_rng(0)
    names = {n: t for n, t in licenses.known().items() if len(t) < 3000}
    index = licenses.Index(names)
    for t, words in enumerate(index.words):
        ids, keep = index.find(words), int(index.need[t])
        seeds = set(index.seeds[t][0].tolist())
        assert sum(int(i) in seeds for i in ids) > len(words) - keep  # more places than may be missing
        for _ in range(5):
            left = ids[np.sort(r.permutation(len(words))[:keep])]
            assert t in index.candidates(index.counts(left))


def test_align():
    t = np.array([1, 2, 3, 4, 5], np.uint64)
    assert licenses.align(t, np.array([9, 1, 2, 8, 3, 4, 5, 9], np.uint64), (1, 1)) == (5, 1, 7, 9)
    assert licenses.align(t, np.array([9, 1, 2, 8, 3, 4, 5, 9], np.uint64), (1, 1), 0) == (2, 1, 3, 4)
    assert licenses.align(t, np.array([7, 8], np.uint64), (0, 0))[0] == 0


def test_the_band_loses_nothing():
    """Against alignment without a band, over texts with words changed, inserted and dropped, also in long runs."""
    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(5, 80))
        names = [f"word{k}" for k in r.permutation(n)]
        index = licenses.Index({"t": " ".join(names)})
        words = list(names)
        for _ in range(int(r.integers(0, n // 4 + 2))):
            at = int(r.integers(0, len(words)))
            words[at : at + 1] = [[], ["x"], [words[at], *["y"] * int(r.integers(1, 20))]][int(r.integers(0, 3))]
        text = " ".join(["a b", *words, "c", *words[: n // 3]])
        raw = np.frombuffer(text.encode(), np.uint8)
        hashes = licenses.words(raw, np.array([0, len(raw)]))[0]
        assert licenses._aligned(index, 0, hashes, index.find(hashes)) == licenses.align(index.words[0], hashes, need=int(index.need[0]))


def test_any_text_with_the_share_of_words_is_found(spark):
    """Notices with words changed, inserted or dropped, against alignment with every stretch of the text."""
    r = np.random.default_rng(1)
    texts = ["Released under an MIT License"]
    for line in licenses.TEMPLATES.values():
        for _ in range(12):
            words = line.split()
            for _ in range(r.integers(1, 1 + max(1, len(words) // 4))):
                at = r.integers(0, len(words))
                words[at : at + 1] = [[], ["thing"], [words[at], "thing"]][r.integers(0, 3)]
            texts.append(" ".join(["the of", *words, "and under the"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(x.license, x.coverage) for x in licenses.scan(docs.where("doc_id = 0")).collect()] == [("MIT-notice", 0.8)]

    def hashes(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return licenses.words(raw, np.array([0, len(raw)]))[0].tolist()

    def matched(template, text, need):
        """The matches of the best cell of a plain local alignment table."""
        row, best = [(0, 0, 0)] * (len(text) + 1), (0, 0, 0)
        for w in template:
            new = [(0, 0, 0)]
            for j, x in enumerate(text):
                s, n, f = row[j]
                hit = (s + 2, n + 1, f if s else j) if x == w else (s - 1, n, f)
                new.append(max(hit, (row[j + 1][0] - 1, *row[j + 1][1:]), (new[j][0] - 1, *new[j][1:])))
                if new[-1][0] <= 0:
                    new[-1] = (0, 0, 0)
                elif new[-1][1] >= need:
                    best = max(best, new[-1])
            row = new
        return best[1]

    split = [hashes(t) for t in texts]
    for name, line in licenses.TEMPLATES.items():
        template = hashes(line)
        need = -(-3 * len(template) // 4)
        got = {x.doc_id: x.matched for x in licenses.scan(docs, templates={name: line}).orderBy("matched").collect()}
        assert got == {i: n for i, text in enumerate(split) if (n := matched(template, text, need))}


def test_whole_licenses_and_the_right_sibling(spark):
    known = licenses.known()
    bodies = [n for n in known if n not in licenses.TEMPLATES | licenses.HEADERS and "-notice-" not in n]
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense"} <= set(bodies)
    lines = {"Licensed under CC BY 4.0.": "CC-BY-4.0", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "Licensed under the BSD 3-Clause License": "BSD-3-Clause", "Released under the Mozilla Public License 2.0": "MPL-2.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Released under the MIT License.": "MIT"}
    texts = [(n, "the first words " + known[n].replace("copyright", "", 1) + " and the last") for n in bodies] + [(n, line) for line, n in lines.items()]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, (name, text) in enumerate(texts):
        widest = max(got[i], key=lambda r: r.matched)
        assert widest.license.split("-notice")[0] == name and (widest.coverage > 0.97), (name, widest)
        spans = sorted((r.start, r.end) for r in got[i])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
