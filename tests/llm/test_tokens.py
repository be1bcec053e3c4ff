import hashlib
import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lectern.llm import tokens
from tokenizers import Tokenizer

PATH = P.path(tokens.COUNT_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def flat(parts):
    return [i for part in parts for i in part]


def test_same_ids_as_the_library_for_code_points(library):
    encode = tokens.encoding(PATH).encode_ordinary
    for c in [*range(0, 0x3400), *range(0x3400, 0x110000, 97)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)} 1{chr(c)}\n{chr(c)}x"
            assert encode(text) == library.encode(text, add_special_tokens=False).ids, hex(c)


PIECES = ["ab", "  ", "\n", "word ", " é", "1", "  \n", tokens.SPECIAL, "日本", "!!", "'s", " don't", "x" * 50, " ", "😀"]


@pytest.mark.parametrize("seed", range(40))
def test_spliced_and_safe_parts_are_the_whole_text(library, seed):
    r = random.Random(seed)
    text = "".join(r.choice(PIECES) for _ in range(400))
    assert flat(tokens.library_ids(text, PATH, 64, 8)) == library.encode(text, add_special_tokens=False).ids
    e = tokens.encoding(P.path(tokens.CODEC_VOCABULARY))
    assert flat(e.encode_ordinary(p) for p in tokens.safe_parts(text, 50)) == e.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=300))
def test_any_text(text):
    assert flat(tokens.spliced(text, PATH, 16, 4)) == tokens.encoding(PATH).encode_ordinary(text)


RUNS = {
    "spaces": " " * 2_000_000,
    "newlines": "\n" * 2_000_000,
    "mixed": "".join(random.Random(1).choices(" \n\t\u3000\xa0", k=2_000_000)),
    "between words": "x" + " " * 700_000 + "y" + "\n" * 300 + " z" + "\r" * 256 + "!" + "\t" * 500_000,
    "no blanks": "日本、文字。" * 200_000,
    "signs": "=" * 300_000,
    "one word": "a" * 300_000,
}


@pytest.mark.parametrize("name", RUNS)
def test_very_long_runs(library, name):
    """Against tokenizers, and against a plain reading of the split pattern for the other vocabulary."""
    import regex

    text = RUNS[name]
    assert flat(tokens.library_ids(text, PATH)) == library.encode(text, add_special_tokens=False).ids
    path = P.path(tokens.CODEC_VOCABULARY)
    e = tokens.encoding(path)
    want = [i for m in regex.findall(P.PATTERN, text) for i in e._encode_single_piece(m)]
    assert flat(tokens.codec_ids(text, path)) == want and e.decode(want) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "'s", "é", "日", "。", "1", "!", " " * 300, "\n" * 256, " \t" * 200, tokens.SPECIAL]), max_size=40))
def test_runs_between_anything(pieces):
    text, library = "".join(pieces), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert flat(tokens.library_ids(text, PATH, 64, 8)) == library.encode(text, add_special_tokens=False).ids
    path = P.path(tokens.CODEC_VOCABULARY)
    assert flat(tokens.codec_ids(text, path, 20)) == tokens.encoding(path).encode_ordinary(text)


def test_overlap_widens_where_nothing_is_stable():
    text = "x" * 5000 + " " * 3000 + "y z" * 100 + "日本" * 400 + "。" + "文" * 300
    assert flat(tokens.spliced(text, PATH, 64, 8)) == tokens.encoding(PATH).encode_ordinary(text)


ROWS = [(1, "", "k"), (2, None, "k"), (None, "one two", "k"), (3, "naïve café " * 9000, "k"), (3, "naïve café " * 9000, "k"), (4, f"a{tokens.SPECIAL}b", "k")]
SCHEMA = "doc_id long, text string, n_tokens string"


def test_count_tokens(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = tokens.count_tokens(docs, chunk=1000, overlap=50).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in ROWS)
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_round_trip(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    e = tokens.encoding(P.path(tokens.CODEC_VOCABULARY))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in ROWS:
        ids = e.encode_ordinary(t or "")
        want.append((str(i), len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha((t or "").encode())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.bpe_round_trip(docs).collect()) == sorted(want)
    back = tokens.bpe_decode(tokens.bpe_encode(docs)).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back) == sorted((str(i), (t or "").encode()) for i, t, _ in ROWS)
    assert tokens.bpe_round_trip(docs.limit(0)).count() == 0


def test_decoding_gives_raw_bytes(spark):
    e = tokens.encoding(P.path(tokens.CODEC_VOCABULARY))
    half = e.encode_ordinary("日")[:1] if len(e.encode_ordinary("日")) > 1 else [e.encode_single_token(b"\xe6")]
    row = tokens.bpe_decode(spark.createDataFrame([(1, half), (2, None)], "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: bytes(r.bytes) for r in row} == {1: e.decode_bytes(half), 2: b""}
