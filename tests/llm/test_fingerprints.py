import hashlib

import numpy as np
from lectern.llm import fingerprints as fp


def test_homomorphic():
    v = fp.vectors(["a b c\nd e", "d e\n\na b c\n", "a b c", "d e", "", "x"])
    assert fp.as_text(v)[0] == fp.as_text(v)[1] != fp.as_text(v)[2]
    one = lambda k: (v[0][k : k + 1], v[1][k : k + 1])
    assert fp.as_text(fp.add(one(2), one(3))) == fp.as_text(one(0))
    assert fp.as_text(fp.subtract(one(0), one(3))) == fp.as_text(one(2))
    assert not v[0][4].any() and not v[1][4].any()
    assert all((a == b).all() for a, b in zip(fp.from_text(fp.as_text(v)), v, strict=True))


def test_likeness():
    words = [f"w{i}" for i in range(2000)]
    text = " ".join(words)
    half = " ".join(words[:1000] + [f"v{i}" for i in range(1000)])
    other = " ".join(f"u{i}" for i in range(2000))
    v = fp.vectors([text, half, other, text])[1]
    near = fp.likeness(v[[0, 0, 0]], v[[3, 1, 2]])
    assert near[0] == 1 and 0.3 < near[1] < 0.7 and near[2] < 0.3


def test_next_text_with_nulls_beside_large_ids(spark):
    r = np.random.default_rng(3)
    ids = [int(x) for x in r.choice(1 << 20, 3000, replace=False) + (1 << 62)] + [-(1 << 62), (1 << 63) - 1, *range(40)]
    rows = [(i, f"text {i}") for i in ids] + [(None, "null one"), (None, "null two")]
    rows = [rows[k] for k in r.permutation(len(rows))]
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = {x: order[(k + 1) % len(order)][1] for k, x in enumerate(order)}
    got = fp.with_next_text(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=50).collect()
    assert len(got) == len(rows) and {(x.doc_id, x.text): x.next_text for x in got} == want


def plain_fingerprint(text):
    """The sums written out: paragraphs' digests modulo 2**64, and signed counts of three-word runs modulo 2**32."""
    from lectern.llm import _text

    equal, like = [0] * fp.EQUAL, [0] * fp.LIKE
    for line in (text or "").split("\n"):
        if not line.strip():
            continue
        digest = hashlib.blake2b(line.encode(), digest_size=8 * fp.EQUAL).digest()
        for k in range(fp.EQUAL):
            equal[k] = (equal[k] + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) % 2**64
        raw = np.frombuffer(line.encode(), np.uint8)
        words = _text.word_hashes(raw, np.array([0, len(raw)]))[0]
        n = min(fp.RUN, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            h = int(_text.gram_hashes(words[k : k + n], n)[0])
            like[h % fp.LIKE] = (like[h % fp.LIKE] + (-1 if h >> 40 & 1 else 1)) % 2**32
    return b"".join(x.to_bytes(8, "little") for x in equal).hex() + b"".join(x.to_bytes(4, "little") for x in like).hex()


def test_sums_against_plain_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).unionByName(spark.createDataFrame([(-1, None), (-2, "one"), (-3, "two words\n\n \ntwo words"), (-4, "a b c d\ne f")], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.fingerprint for r in fp.fingerprint(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in texts.items()}


def test_edited_against_brute_force(spark, sf):
    rows = [(5, "naïve text " * 20), (3, ""), (7, None), (9, "x"), (None, "null id"), (9, "a tie"), (11, "long " * 30_000)]
    for extra, buckets in ((rows, 3), ([(1, "alone")], 5), ([], 5)):
        docs = spark.createDataFrame(extra, "doc_id long, text string")
        got = sorted(((r.doc_id, r.text, r.next_text) for r in fp.with_next_text(docs, bucket_rows=buckets).collect()), key=str)
        order = sorted(((i, t or "") for i, t in extra), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert got == sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("lang", "fingerprint")
    got = {r.doc_id: r for r in fp.edited_fingerprints(docs).collect()}
    order = sorted((r.doc_id, r.text) for r in docs.collect())
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        a, b, c = fp.vectors([t]), fp.vectors([edited]), fp.vectors([n])
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert [got[i].fingerprint, got[i].edited_fingerprint] == fp.as_text(a) + fp.as_text(b)
        assert np.isclose(got[i].near_edited, fp.likeness(a[1], b[1])[0]) and np.isclose(got[i].near_next, fp.likeness(a[1], c[1])[0])
    assert len(got) == len(order)
    assert {r.doc_id: r.fingerprint for r in fp.fingerprint(docs).collect()} == {i: r.fingerprint for i, r in got.items()}
