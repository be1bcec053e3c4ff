"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

The words of many texts lie in one flat array of symbols. A round takes the
smallest pair rank of each word, merges that pair's occurrences from the left
in all words at once and closes the gaps; the rounds end when no pair is left.
The ids are those of the sentencepiece library for the same model file.
"""

import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
BLANK = "▁"
#: Characters encoded in one go, symbols of a word that goes through rounds with others, words remembered.
PART, LONG, REMEMBERED = 1 << 20, 256, 1 << 19
_NONE = np.iinfo(np.int32).max
_PROBES = ("", " ", "a", "  two   blanks ", "ﬁ  \t\n\r\n x▁y", "日本語 \U0001f600 é <s></s><unk><0x41>", "=" * 40 + " " * 40 + "hushushus")


def _runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, place after the last) of the runs of true values, none across a break."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | breaks[1:]
    last[:-1] &= ~mask[1:] | breaks[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Pieces:
    """A model: symbols are piece ids, or `size` + the code point of a character that is no piece."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.bos, self.eos = sp.get_piece_size(), sp.bos_id(), sp.eos_id()
        ids = {sp.id_to_piece(i): i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        score = {p: sp.get_score(i) for p, i in ids.items()}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.blanks = self._blank_runs(ids, score)
        pairs = []
        for p, i in ids.items():
            if self.blanks is None or p.strip(BLANK):
                for k in range(1, len(p)):
                    a, b = self._symbol(ids, p[:k]), self._symbol(ids, p[k:])
                    if a is not None and b is not None:
                        pairs.append((a << 32 | b, order[score[p]], i))
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        known = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                known[ord(p)] = i
        self.chars = np.where(known < 0, np.arange(0x110000) + self.size, known)
        # A word ends before a blank, and at a line's end, unless a piece runs over such a place.
        line = "" if any("\n" in p for p in ids) else "\n"
        self.words = re.compile("(?s).+" if any(BLANK in p.lstrip(BLANK) for p in ids) else f"{BLANK}*[^{BLANK}{line}]+|{BLANK}+" + (f"|{line}+" if line else ""))
        self.seen: dict[str, tuple[int, ...]] = {}
        for text in _PROBES:
            if list(self.encode(text)) != sp.encode(text, add_bos=True, add_eos=True):
                raise ValueError(f"{path} is no BPE model with byte fallback, a blank put first and no normalisation")

    def _symbol(self, ids: dict[str, int], p: str) -> int | None:
        return ids.get(p, self.size + ord(p) if len(p) == 1 else None)

    def _blank_runs(self, ids: dict[str, int], score: dict[str, float]) -> list[list[int]] | None:
        """The ids of runs of 0, 1, ... blanks, up to the longest piece of blanks, if these pieces come after all other merges and tie.

        Then the leftmost pair grows until it is the longest piece, whatever follows, and
        the rest of the run goes on as one of its own. Else None, and blanks are merged like
        other characters.
        """
        runs = sorted((p for p in ids if not p.strip(BLANK)), key=len)
        last = {score[p] for p in runs if len(p) > 1}
        if len(last) != 1 or min(s for p, s in score.items() if p.strip(BLANK)) <= last.pop() or any(p.startswith(BLANK * 2) and p.strip(BLANK) for p in ids):
            return None
        most = len(runs[-1])
        split = [[], [ids[BLANK]], *(self.library.encode(" " * n) for n in range(1, 4 * most))]
        if any(split[n] != split[most] * (n // most) + split[n % most] for n in range(len(split))) or len(split[most]) > 1:
            return None
        return split[: most + 1]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of each pair or _NONE, what it becomes)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.merged[at]

    def _in_turn(self, rank: np.ndarray, new: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether a merge makes no pair that would come before the next occurrence of its rank. left, right: neighbours at its turn, -1 where there are none."""
        fine = np.ones(len(new), bool)
        for a, b, there in ((left, new, left >= 0), (new, right, right >= 0)):
            fine[there] &= self.pairs(a[there], b[there])[0] > rank[there]
        return fine

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word of each) after all merges; words come in ascending order and have a symbol at least."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            rank, new = np.full(len(symbols), _NONE, np.int64), np.zeros(len(symbols), np.int64)
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner], new[inner] = self.pairs(symbols[inner], symbols[inner + 1])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(symbols)))
            if not (live := least < _NONE).all():
                done.append((symbols[~live], word[~live]))
                symbols, word, rank, new, least = (x[live] for x in (symbols, word, rank, new, least))
                if not len(symbols):
                    break
            breaks = np.diff(word, prepend=-1) != 0
            begin, end = _runs(rank == least, breaks)
            at = np.repeat(begin, (end - begin + 1) // 2)
            at = at + 2 * (np.arange(len(at)) - np.repeat(np.cumsum((end - begin + 1) // 2) - (end - begin + 1) // 2, (end - begin + 1) // 2))
            of = word[at]
            again = np.isin(of, of[1:][of[1:] == of[:-1]]) if len(at) > 1 else np.zeros(len(at), bool)
            if again.any():  # words with several occurrences: up to the first that makes a pair which goes before the next
                p, w = at[again], of[again]
                same = np.append(False, w[1:] == w[:-1])
                joins = same & np.append(False, p[1:] == p[:-1] + 2)
                left = np.where(joins, np.append(-1, new[p[:-1]]), np.where(breaks[p], -1, symbols[p - 1]))
                there = (p + 2 < len(word)) & (word[np.minimum(p + 2, len(word) - 1)] == w)
                right = np.where(there, symbols[np.minimum(p + 2, len(word) - 1)], -1)
                late = np.cumsum(~self._in_turn(rank[p], new[p], left, right))
                start = np.maximum.accumulate(np.where(same, 0, np.arange(len(p))))
                before = np.append(0, late)[np.arange(len(p))] - np.append(0, late)[start]
                keep = np.ones(len(at), bool)
                keep[again] = before == 0
                at = at[keep]
            symbols[at] = new[at]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, word = symbols[stays], word[stays]
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _long(self, symbols: np.ndarray) -> np.ndarray:
        """One long word: the ranks in ascending order, each with all its places, so that the work follows the length."""
        n = len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(rank: np.ndarray, at: np.ndarray) -> None:
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, group in zip(rank[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
                if r not in places:
                    heapq.heappush(ranks, r)
                places.setdefault(r, []).append(group)

        def look(at: np.ndarray) -> None:
            rank = self.pairs(symbols[at], symbols[after[at]])[0]
            add(rank[rank < _NONE], at[rank < _NONE])

        if n > 1:
            look(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at]]
            at = at[after[at] < n]
            rank, new = self.pairs(symbols[at], symbols[after[at]])
            at, new = at[rank == r], new[rank == r]
            if not len(at):
                continue
            follows = np.append(False, after[at[:-1]] == at[1:])
            start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            odd = (np.arange(len(at)) - start) % 2 == 1
            p, s = at[~odd], new[~odd]
            two = after[after[p]] if len(p) else p
            joins = np.append(False, two[:-1] == p[1:])
            left = np.where(joins, np.append(-1, s[:-1]), np.where(before[p] >= 0, symbols[before[p]], -1))
            right = np.where(two < n, symbols[np.minimum(two, n - 1)], -1)
            wrong = np.flatnonzero(~self._in_turn(np.full(len(p), r), s, left, right))
            if len(wrong) and wrong[0] + 1 < len(p):
                add(np.full(int((at > p[wrong[0]]).sum()), r), at[at > p[wrong[0]]])
                p, s = p[: wrong[0] + 1], s[: wrong[0] + 1]
            gone = after[p]
            symbols[p] = s
            alive[gone] = False
            # a chain a-b-c-d of two merges next to each other: link after all are marked
            after[p] = after[gone]
            inside = after[p] < n
            before[after[p][inside]] = p[inside]
            touched = np.unique(np.concatenate([p, before[p][before[p] >= 0]]))
            look(touched[after[touched] < n])
        return symbols[alive]

    def _ids(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: runs of blanks into their longest pieces, other characters into the bytes of their UTF-8."""
        breaks = np.diff(word, prepend=-1) != 0
        if self.blanks is not None:
            begin, end = _runs(symbols == self.blanks[1][0], breaks)
            begin, end = begin[end - begin > 1], end[end - begin > 1]
            if len(begin):
                most, parts, words, at = len(self.blanks) - 1, [], [], 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    run = self.blanks[most] * ((e - b) // most) + self.blanks[(e - b) % most]
                    parts += [symbols[at:b], np.array(run)]
                    words += [word[at:b], np.full(len(run), word[b])]
                    at = e
                symbols, word = np.concatenate([*parts, symbols[at:]]), np.concatenate([*words, word[at:]])
        if (plain := symbols >= self.size).any():
            code = np.where(plain, symbols - self.size, 0)
            n = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            whole = self.bytes[np.frombuffer("".join(map(chr, code[plain])).encode(), np.uint8)]
            symbols, word = np.repeat(symbols, n), np.repeat(word, n)
            symbols[np.repeat(plain, n)] = whole
        return symbols, word

    def learn(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        """The ids of each word: short ones go through the rounds together."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols, lengths = self.chars[codes], np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), lengths)
        small = np.repeat(lengths <= LONG, lengths)
        found = [self._rounds(symbols[small], word[small])]
        for w in np.flatnonzero(lengths > LONG).tolist():
            end = int(lengths[: w + 1].sum())
            one = self._long(symbols[end - lengths[w] : end].copy())
            found.append((one, np.full(len(one), w)))
        symbols, word = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        symbols, word = self._ids(symbols[order], word[order])
        ends = np.searchsorted(word, np.arange(len(words)), "right").tolist()
        flat, begin = symbols.tolist(), 0
        for end in ends:
            yield tuple(flat[begin:end])
            begin = end

    def parts(self, text: str) -> Iterator[str]:
        """The text with its blanks marked, in parts of about PART characters that end where a word does; a longer word stays whole."""
        text, at = BLANK + text.replace(" ", BLANK) if text else "", 0
        while len(text) - at > PART:
            end = at + PART
            while True:
                end = text.find(BLANK, end)
                if end < 0 or text[end - 1] != BLANK:
                    break
                end += 1
            if end < 0:
                break
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    def ids_of(self, parts: list[str]) -> list[array]:
        """The ids of each part. Words that are not remembered are encoded together."""
        words, seen = [self.words.findall(p) for p in parts], self.seen
        fresh = list(set().union(*words).difference(seen))
        seen.update(zip(fresh, self.learn(fresh) if fresh else (), strict=True))
        out = [array("I", chain.from_iterable(map(seen.__getitem__, ws))) for ws in words]
        if len(seen) > REMEMBERED:
            seen.clear()
        else:
            for w in fresh:
                if len(w) > 32:
                    del seen[w]
        return out

    def encode(self, text: str) -> array:
        """Ids with begin and end."""
        out = array("I", [self.bos])
        for part in self.parts(text):
            out += self.ids_of([part])[0]
        out.append(self.eos)
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[array]:
        """encode() for many texts, short ones together."""
        held: list[str] = []
        size = 0
        for text in texts:
            if len(text) > PART >> 1:
                yield from self._together(held)
                held, size = [], 0
                yield self.encode(text)
                continue
            held.append(text)
            size += len(text)
            if size > PART or len(held) >= 1024:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[array]:
        for ids in self.ids_of([BLANK + t.replace(" ", BLANK) if t else "" for t in texts]):
            yield array("I", [self.bos]) + ids + array("I", [self.eos])


@functools.cache
def model(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>), with begin and end ids, one row per row of docs in one narrow pass. Null and empty texts have these two ids alone; null ids and repeated rows are kept."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for chunk in range(0, batch.num_rows, 256):
                part = batch.slice(chunk, 256)
                rows = list(m.encode_all(t.as_py() or "" for t in part.column(1)))
                ends = np.cumsum([0, *map(len, rows)])
                flat = np.concatenate([np.frombuffer(r, np.uint32) for r in rows]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) as the library decodes: begin and end ids give nothing, bytes that are no UTF-8 give U+FFFD, a null list is empty."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model(path).library.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode each whole text, decode the ids, digest both within the task.

    Null and empty texts have the begin and end ids alone and decode to nothing;
    null ids and repeated rows each give a row; an empty table gives an empty one.
    Only the two named columns are read, so others may have any name.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            n, a, b = [], [], []
            for ids in m.encode_all(t.as_py() or "" for t in batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(np.frombuffer(ids, np.uint32).astype("<u4", copy=False)).hexdigest())
                b.append(hashlib.sha256(m.library.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
