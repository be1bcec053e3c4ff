import hashlib
import random
import string

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lectern.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.model(P.path(pieces.VOCABULARY))


def want(model, text):
    return model.library.encode(text, add_bos=True, add_eos=True)


PIECES = ["ab", "  ", "\n", "word ", " é", "1", "  \n", "<s>", "<0x41>", "日本", "!!", "'s", " don't", "x" * 50, " ", "😀", "▁", "hus", "best", "====", "\0"]


@pytest.mark.parametrize("seed", range(60))
def test_random_texts(model, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 60))) for _ in range(20)] + ["".join(r.choices("abcdehistuno▁ ", k=200)) for _ in range(20)]
    assert [list(x) for x in model.encode_all(texts)] == [want(model, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=300))
def test_any_text(model, text):
    assert list(model.encode(text)) == want(model, text)


def test_long_words_go_the_same_way_as_short_ones(model, monkeypatch):
    r = random.Random(5)
    words = ["▁" + "".join(r.choices("abehstuan", k=r.randint(1, 120))) for _ in range(300)] + ["aaaa", "hushushus", "x"]
    rounds = list(model.learn(words))
    monkeypatch.setattr(pieces, "LONG", 0)
    assert list(model.learn(words)) == rounds
    assert [list(x) for x in rounds[:300]] == [model.library.encode(w[1:]) for w in words[:300]]


LONG = {
    "letters": "".join(random.Random(1).choices(string.ascii_letters, k=300_000)),
    "one letter": "a" * 300_000,
    "blanks": " " * 1_000_001,
    "signs": "=" * 300_000,
    "one part": "hus" * 100_000,
    "no blanks": "日本、文字。" * 50_000,
    "unknown": "\n\U0001f9ff" * 100_000,
    "many parts": "an apple  and\n" * 200_000,
}


@pytest.mark.parametrize("name", LONG)
def test_very_long_texts(model, name):
    assert list(model.encode(LONG[name])) == want(model, LONG[name])


def test_round_trip(spark, model):
    rows = [(1, "Some words, twice.\n\tSome é", "x"), (1, "Some words, twice.\n\tSome é", "x"), (2, "", None), (3, None, None), (None, "  \U0001f600 ", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    got = sorted(map(tuple, pieces.round_trip(docs).collect()), key=str)

    def line(key, text):
        ids = want(model, text or "")
        return key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.library.decode(ids).encode()).hexdigest()

    assert got == sorted((line(k, t) for k, t, _ in rows), key=str)
    back = pieces.decode(pieces.encode(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(k), t or "") for k, t, _ in rows)
    assert pieces.round_trip(docs.limit(0)).count() == 0
    bytes_apart = spark.createDataFrame([(1, [1, 3 + 0xC3, 2]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(bytes_apart).collect()} == {1: "�", 2: ""}


def test_whole_table(spark, model, sf):
    from lectern.llm.queries import op11_piece_round_trip

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op11_piece_round_trip(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = want(model, docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
