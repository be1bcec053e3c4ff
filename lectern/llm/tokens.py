"""Byte-level BPE: token counts with overlap resynchronisation, and encoding with decoding.

Both operators run the public rank files with tiktoken. For byte_bpe_50k the
rank file holds the vocabulary of byte_bpe_50k.json, and the ids are those of
the tokenizers library (a test compares the two over every code point and over
generated texts); tokenizers itself needs over six times the CPU time.
"""

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNT_VOCABULARY = "byte_bpe_50k.tiktoken"
CODEC_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A string that the .json file holds as a special token: the library makes it one id, wherever it stands.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
CHUNK, OVERLAP = 1 << 16, 1 << 9


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def token_lengths(path: str) -> np.ndarray:
    """Bytes of each token."""
    e = encoding(path)
    out = np.zeros(e.n_vocab, np.int64)
    for token, i in e._mergeable_ranks.items():
        out[i] = len(token)
    return out


#: Places where the split pattern always parts, whatever stands around: no match of it holds a non-blank followed by a
#: blank, or one of these letters followed by punctuation, and the pattern looks ahead but never back.
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])|(?<=[A-Za-z\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3])(?=[!-/:-@\[-`{-~\u3000-\u3003\uff01\uff0c\uff0e\uff1a\uff1b\uff1f])")
#: Long runs of the characters that the pattern's \s stands for.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")


def blanks_apart(text: str) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match): long runs of white space are taken out.

    Such a run is a single match but for its last character, which may go with what
    follows. The regex would hold a place to go back to for each of its characters.
    """
    at = 0
    for m in _BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))
        if m.start() > at:
            yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    if at < len(text):
        yield text[at:], False


def _places(text: str) -> np.ndarray:
    """The safe places in the text, in bytes."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64))
    return ends[[m.start() - 1 for m in _SAFE.finditer(text)]]


def spliced(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """The ids of a text of any length, in parts.

    Chunks are encoded with an overlap; the two encodings are spliced at the last
    border that both have and that is safe. Where the overlap holds none, it is
    widened, in the end to more than the chunk, which then grows too. A single
    match, such as a word of a million letters, is encoded whole, as its tokens
    depend on all of it.
    """
    encode, lengths, at = encoding(path).encode_ordinary, token_lengths(path), 0
    size = chunk
    while at < len(text):
        end = at + size
        ids = encode(text[at:end])
        if end >= len(text):
            yield ids
            return
        ends, width, cut = np.cumsum(lengths[ids]), overlap, 0
        while not cut and width < 2 * size:
            begin = max(at, end - width)
            shift = len(text[at:begin].encode())
            right = np.cumsum(lengths[encode(text[begin : end + overlap])]) + shift
            common = np.intersect1d(np.intersect1d(ends, right, assume_unique=True), _places(text[begin:end]) + shift, assume_unique=True)
            cut, width = int(common[-1]) if len(common) else 0, 2 * width
        if cut:
            yield ids[: int(np.searchsorted(ends, cut)) + 1]
            at += len(text[at:end].encode()[:cut].decode())
            size = chunk
        else:
            size *= 2


def library_ids(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """Ids as the tokenizers library gives them, in parts: the special string is one id, all else is encoded between."""
    e = encoding(path)
    for k, section in enumerate(text.split(SPECIAL)):
        if k:
            yield [SPECIAL_ID]
        for part, one in blanks_apart(section):
            if one:
                yield e._encode_single_piece(part)
            elif len(part) > chunk:
                yield from spliced(part, path, chunk, overlap)
            else:
                yield e.encode_ordinary(part)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per row of docs, in one narrow pass.

    Null and empty texts count 0 bytes and 0 tokens; a null id stays null; repeated
    rows each give a row; an empty table gives an empty one. Only the two named
    columns are read, so others may have any name.
    """
    path = path or public_tokenizers.path(COUNT_VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [sum(map(len, library_ids(t.as_py() or "", path, chunk, overlap))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.struct(F.col(id_col).alias("key"), F.octet_length(text).cast("long").alias("n_bytes")).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id struct<key:{kind},n_bytes:bigint>, n_tokens bigint")
    return out.select(F.col("id.key").alias(id_col), "id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def safe_parts(text: str, most: int = CHUNK) -> Iterator[str]:
    """Parts of about so many characters, cut only where the split pattern always splits; a stretch without such a place stays whole."""
    at = 0
    while len(text) - at > most and (m := _SAFE.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def codec_ids(text: str, path: str, most: int = CHUNK) -> Iterator[list[int]]:
    """Ids as the tiktoken library gives them, in parts."""
    e = encoding(path)
    for stretch, one in blanks_apart(text):
        if one:
            yield e._encode_single_piece(stretch)
        else:
            yield from map(e.encode_ordinary, safe_parts(stretch, most))


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>): the ids of each whole text. Null texts are empty; every row of docs gives a row."""
    path = path or public_tokenizers.path(CODEC_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = array("i"), [0]
            for t in batch.column(1):
                for part in codec_ids(t.as_py() or "", path):
                    flat.extend(part)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, bytes binary): the raw bytes of the ids, which need not be valid UTF-8. A null list is empty."""
    path = path or public_tokenizers.path(CODEC_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(path).decode_bytes
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], ["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode each whole text, decode the ids, and digest both.

    The ids are digested part by part and go nowhere, so a long text costs no
    more memory than its parts. Null and empty texts have no ids and digests of
    nothing; null ids and repeated rows are kept as they are.
    """
    path = path or public_tokenizers.path(CODEC_VOCABULARY)

    def digest(text: str) -> tuple[int, str, str]:
        e, n, ids_sha, bytes_sha = encoding(path), 0, hashlib.sha256(), hashlib.sha256()
        for ids in codec_ids(text, path):
            n += len(ids)
            ids_sha.update(np.frombuffer(array("I", ids), np.uint32).astype("<u4", copy=False))
            bytes_sha.update(e.decode_bytes(ids))
        return n, ids_sha.hexdigest(), bytes_sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = zip(*(digest(t.as_py() or "") for t in batch.column(1)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
