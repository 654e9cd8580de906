"""Packing of token documents into training sequences of balanced attention cost."""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from headwater.llm.common import map_texts

SEQUENCE = 2048
END_ID = 1
#: Documents of so many tokens are packed together: a bound for memory, far above one sequence.
POOL_TOKENS = 1 << 22
#: Distinct words that a worker remembers in each of two generations.
CACHE_WORDS = 200_000
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, cost double"
)


# How the tokenizer file cuts text (contractions, letters, one digit, other), for Latin-1 text, where
# the classes are short. White space here is Unicode's, which lacks the four separators 1C to 1F.
_LETTER = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def _byte_letters() -> dict[int, int]:
    """The usual byte alphabet: printable Latin-1 stands for itself, the other bytes for letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(rest)}


class Remembered(dict):
    """Results of ``make`` by key: the keys of this generation and of the one before, each up to ``limit``."""

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


class WordEncoder:
    """Token ids of whole texts, word by word.

    The tokenizer neither normalises nor merges across white space, and inside a word it codes each piece (letters, one
    digit, other signs) for itself, so a text's ids are those of its words' pieces in order. Words repeat and are
    remembered; ids are kept as packed little-endian 32-bit bytes. Latin-1 text is normalised and cut here, where lower
    case is letter for letter the same; words of other texts go through the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str, limit: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words = Remembered(self.word, limit)

    def word(self, word: str) -> bytes:
        if max(word) > "\xff":
            return self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        word = word.lower()
        if word.isalpha():
            return self.piece(word)
        if word[:-1].isalpha():  # what follows the letters is one sign or digit
            return self.words[word[:-1]] + self.piece(word[-1])
        return b"".join([self.words[x] if x.isalpha() else self.piece(x) for x in _PIECE.findall(word)])

    def piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(piece)])

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        low = text.lower()
        if any(s in low for s in self.special):  # names of special tokens are tokens of their own
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        try:
            text.encode("latin-1")
            text = low  # more words meet
        except UnicodeEncodeError:
            pass
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, not to the tokenizer
            cut = [w for w in re.split(r"[^\S\x1c-\x1f]+", text) if w]
        else:
            cut = text.split()
        return b"".join(map(self.words.__getitem__, cut))


def cost(n: int, linear: float, quadratic: float) -> float:
    return linear * n + quadratic * n * n


def pack_pool(
    lengths: list[int], capacity: int, linear: float, quadratic: float
) -> Iterator[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of a pool: largest first, to the cheapest sequence with room.

    The pool gets as many sequences of ``capacity`` as its tokens fill, and what is left over becomes sequences whose
    sizes are powers of two, which need no padding. Documents over the capacity give full sequences first. A
    document that no sequence has room for is cut at the end, so every sequence is full.
    """
    rest: list[tuple[int, int, int]] = []
    sequence = 0
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            yield doc, start, capacity, sequence, 0
            sequence += 1
            start += capacity
        if n > start:
            rest.append((n - start, doc, start))
    total = sum(n for n, _, _ in rest)
    sizes = [capacity] * (total // capacity)
    sizes += [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1]
    used = [0] * len(sizes)
    open_: list[tuple[float, int]] = [(0.0, i) for i in range(len(sizes))]  # by cost
    parked: list[tuple[int, int]] = []  # sequences without room for the last documents, by room
    spent = [0.0] * len(sizes)
    heapq.heapify(open_)
    rest.sort(key=lambda x: (-x[0], x[1]))
    uncut: list[tuple[int, int, int]] = []
    for n, doc, start in rest:
        while parked and -parked[0][0] >= n:  # documents get shorter, so a parked sequence may do again
            i = heapq.heappop(parked)[1]
            heapq.heappush(open_, (spent[i], i))
        while open_ and sizes[open_[0][1]] - used[open_[0][1]] < n:
            i = heapq.heappop(open_)[1]
            heapq.heappush(parked, (used[i] - sizes[i], i))
        if not open_:
            uncut.append((n, doc, start))
            continue
        i = open_[0][1]
        yield doc, start, n, sequence + i, used[i]
        used[i] += n
        spent[i] += cost(n, linear, quadratic)
        heapq.heapreplace(open_, (spent[i], i))
    room = sorted(((sizes[i] - used[i], i) for i in range(len(sizes)) if used[i] < sizes[i]), reverse=True)
    for n, doc, start in uncut:
        while n:
            free, i = room.pop(0)
            put = min(free, n)
            yield doc, start, put, sequence + i, used[i]
            used[i] += put
            start, n = start + put, n - put
            if free > put:
                room.insert(0, (free - put, i))


def pack_documents(
    docs: DataFrame,
    doc_id: Column,
    text: Column,
    tokenizer_path: Callable[[], str] | str,
    capacity: int = SEQUENCE,
    end_id: int = END_ID,
    pool_tokens: int = POOL_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row per piece: where a stretch of a document's token ids lies in which sequence, and its attention cost.

    Each task tokenises its rows as they stream by and packs pools of ``pool_tokens`` tokens, so nothing is shuffled and
    a task holds one pool of packed ids. Cost is ``linear * n + quadratic * n * n`` per piece.
    ``sequence_id`` is the partition, then a running number in it.

    Null or empty texts hold only the end id. Repeated rows and null ids are packed like any others. No rows give no rows.
    """

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        encoder = WordEncoder(tokenizer_path() if callable(tokenizer_path) else tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def packed() -> dict[str, list]:
            nonlocal sequence
            lengths = [len(t) // 4 for t in tokens]
            names = [x.split()[0] for x in PIECES.split(", ")]
            out: dict[str, list] = {n: [] for n in names}
            last = -1
            for doc, start, n, seq, offset in pack_pool(lengths, capacity, linear, quadratic):
                crc = zlib.crc32(memoryview(tokens[doc])[4 * start : 4 * (start + n)])
                row = (ids[doc], start, n, crc, lengths[doc], sequence + seq, offset, cost(n, linear, quadratic))
                for name, value in zip(names, row):
                    out[name].append(value)
                last = max(last, seq)
            sequence += last + 1
            return out

        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"]):
                ids.append(i)
                tokens.append(encoder.encode(text) + end)
                held += len(tokens[-1]) // 4
                if held >= pool_tokens:
                    yield packed()
                    ids, tokens, held = [], [], 0
        if tokens:
            yield packed()

    return map_texts(docs, {"doc_id": doc_id, "text": text}, rows, PIECES)
