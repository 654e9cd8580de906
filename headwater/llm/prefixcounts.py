"""Token counts of every prefix of a text, by dynamic programming, so that truncation and budgets need no second encoding.

A byte-level BPE cuts a text into words and merges bytes inside each. The encoding of a prefix of a word ends in exactly
one token, and what stands before that token is the encoding of a shorter prefix; a token may follow another if no merge
crosses the place where they meet. So one pass over a word gives the count at each of its prefixes, and words that texts
share are computed once.
"""

from __future__ import annotations

import json
import re
import sys
import types
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import map_texts

#: Words that a Python worker remembers, twice; longer words than the second number are not remembered.
MEMORY, LONG = 300_000, 1 << 12
#: The token budget that the query asks about.
LIMIT = 1024

# Fixed value: how byte-level BPE cuts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: From this character on, classes may depend on the Unicode version, and are compared with the tokenizer's.
NEWER = 0x500


def _older_pattern() -> re.Pattern:
    """``PATTERN`` for characters below ``NEWER``, with the classes spelled out, which runs several times faster."""
    low = "".join(map(chr, range(NEWER)))
    pattern = PATTERN
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inside = "".join(regex.escape(c, special_only=False, literal_spaces=False) for c in regex.findall(name, low))
        pattern = pattern.replace(f"{name}+", f"[{inside}]+").replace(name, inside)
    blanks = "".join(regex.escape(c, special_only=False, literal_spaces=False) for c in regex.findall(r"\s", low))
    return re.compile(pattern.replace(r"\S", f"[^{blanks}]"))


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class _Remembered(dict):
    """Words computed once, as far as memory goes: when it is full, those not asked for since it was last full go."""

    def __init__(self, compute: Callable[[str], bytes]) -> None:
        super().__init__()
        self.compute, self.before = compute, {}

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.compute(word)
        if len(word) <= LONG:
            if len(self) >= MEMORY:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found


class PrefixCounter:
    """Counts at every prefix under the tokenizer of a file, special tokens in a text included."""

    def __init__(self, path: str) -> None:
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, before = said["model"], said["pre_tokenizer"] or {}
        byte_level = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if model["type"] != "BPE" or not byte_level or said["normalizer"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if any(t[k] for t in said["added_tokens"] for k in flags):
            raise ValueError(f"{path} has special tokens that look at what is around them")
        self.special = [t["content"] for t in said["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self._words, self._older_words = regex.compile(PATTERN), _older_pattern()
        self._blank = regex.compile(r"\s").match
        self._two_blanks = regex.compile(r"\s\s")
        self._newer = regex.compile(f"[{chr(NEWER)}-\U0010ffff]")
        self._agreed: dict[str, bool] = {}
        self._load(model)
        self._follows: dict[int, bool] = {}
        self._counts = _Remembered(self._word)

    def _load(self, model: dict) -> None:
        alphabet = {c: chr(b) for c, b in _alphabet().items()}
        as_bytes = str.maketrans(alphabet)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocabulary = set(model["vocab"])
        made = {a + b: (rank, a, b) for rank, (a, b) in enumerate(merges)}
        if len(made) != len(merges) or not set(alphabet) <= vocabulary or not made.keys() <= vocabulary:
            raise ValueError(f"{self.path} lacks a token for a byte or a merge, or makes one in two ways")
        number = {t: n for n, t in enumerate([*alphabet, *made])}
        self.pairs = {number[a] << 32 | number[b]: rank for rank, (a, b) in enumerate(merges)}
        # Of each merged token: the rank of its merge and its two parts.
        self.parts = {number[t]: (rank, number[a], number[b]) for t, (rank, a, b) in made.items()}
        self.never = len(merges)
        self._edges: list[dict[int, list[tuple[int, int]]]] = [{}, {}]
        self.found = ahocorasick.Automaton()
        for t, n in number.items():
            t = t.translate(as_bytes)
            self.found.add_word(t, (len(t), n))
        self.found.make_automaton()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at the left (0) or right (1) end of a token while it is put together, and until when."""
        known = self._edges[side].get(token)
        if known is None:
            known, whole, until = [(token, self.never)], token, self.never
            while whole in self.parts:
                until, *parts = self.parts[whole]
                whole = parts[side]
                known.append((whole, until))
            self._edges[side][token] = known
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand after ``a``: no merge crosses their border.

        A merge has a higher rank than those that made its parts, so ranks are times. A crossing merge happens if both
        of its parts are still edges then; at the same time, the merge further left comes first.
        """
        pairs, right = self.pairs, self._edge(b, 0)
        for x, x_until in self._edge(a, 1):
            for y, y_until in right:
                rank = pairs.get(x << 32 | y)
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def _word(self, word: str) -> bytes:
        """Counts at the characters' ends of one word, as 32-bit numbers."""
        data = word.encode("utf-8", "replace")
        known = self._follows
        if len(known) > MEMORY:
            known.clear()
        last, count = [0] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (size, token) in self.found.iter(data.decode("latin-1")):  # the longest first, at each end
            if count[end + 1]:
                continue
            start = end + 1 - size
            if start:
                border = last[start] << 32 | token
                ok = known.get(border)
                if ok is None:
                    ok = known[border] = self.follows(last[start], token)
                if not ok:
                    continue
            last[end + 1], count[end + 1] = token, count[start] + 1
        if len(data) == len(word):
            counts = count[1:]
        else:
            ends = [n for n, x in enumerate(data) if x & 0xC0 != 0x80][1:]
            counts = [count[n] for n in [*ends, len(data)]]
        if word[0] == "'" and len(word) == 3 and word[1:] in ("re", "ve", "ll"):
            # Cut before its end, the apostrophe and the letter are two words.
            counts[1] = counts[0] + self._one(word[1])
        return array("i", counts).tobytes()

    def _one(self, word: str) -> int:
        return int(np.frombuffer(self._counts[word], "<i4")[-1])

    def _cut(self, text: str) -> list[str]:
        """The words of a text. Where a character is of another class to the tokenizer, its own cuts are taken."""
        if text.isascii() or not self._newer.search(text):
            return self._older_words.findall(text)
        if all(map(self._agrees, set(self._newer.findall(text)))):
            return self._words.findall(text)
        return [text[a:b] for _, (a, b) in self._tokenizer().pre_tokenizer.pre_tokenize_str(text)]

    def _tokenizer(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _agrees(self, c: str) -> bool:
        if c not in self._agreed:
            probe = f"a{c}1{c}!{c} {c}b"
            cut = self._tokenizer().pre_tokenizer.pre_tokenize_str(probe)
            self._agreed[c] = [probe[a:b] for _, (a, b) in cut] == self._words.findall(probe)
        return self._agreed[c]

    def _plain(self, text: str) -> np.ndarray:
        """Counts at every character's end of a text in which special tokens are ordinary characters."""
        words = self._cut(text)
        if not words:
            return np.zeros(0, dtype=np.int32)
        known = self._counts
        counts = np.frombuffer(bytearray().join([known[w] for w in words]), "<i4")
        sizes = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        ends = np.cumsum(sizes, dtype=np.int64)
        own = counts[ends - 1]
        before = np.cumsum(own, dtype=np.int32) - own
        counts += np.repeat(before, sizes)
        if self._two_blanks.search(text):
            # The last of several blanks belongs to the next word, but not if the text ends with it.
            for k in range(len(words) - 1):
                w, after = words[k], words[k + 1][0]
                if self._blank(w) and self._blank(w[-1]) and self._blank(after):
                    counts[ends[k]] = before[k] + self._one(w + after)
        return counts

    def counts(self, text: str) -> np.ndarray:
        """The number of tokens of each prefix of ``text``, from the first character on."""
        out, done, at = [], 0, 0
        if not self._special.search(text):
            return self._plain(text)
        for found in self._special.finditer(text):
            special = found[0]
            # A text that ends inside the special token's name has the beginning of the name in it.
            part = self._plain(text[at : found.start()] + special)[:-1]
            whole = done + (part[found.start() - at - 1] if found.start() > at else 0) + 1
            out += [part + done, [whole]]
            done, at = whole, found.end()
        out.append(self._plain(text[at:]) + done)
        return np.concatenate(out)


def packed_steps(counts: np.ndarray) -> bytes:
    """Counts as steps from one prefix to the next: a byte that says how wide, then the steps."""
    steps = np.diff(counts, prepend=0)
    for width in (1, 2, 4, 8):
        narrow = steps.astype(f"<i{width}")
        if (narrow == steps).all():
            return bytes([width]) + narrow.tobytes()
    raise AssertionError


def counts_of(stored: bytes) -> np.ndarray:
    """The counts that ``packed_steps`` stored."""
    return np.cumsum(np.frombuffer(stored, f"<i{stored[0]}", offset=1), dtype=np.int64)


def total(counts: np.ndarray) -> int:
    return int(counts[-1]) if len(counts) else 0


def longest_within(counts: np.ndarray, limit: int) -> int:
    """Characters of the longest prefix of at most ``limit`` tokens."""
    if not len(counts) or counts[-1] <= limit:
        return len(counts)
    fits = np.flatnonzero(counts <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


def _counter(path: str) -> PrefixCounter:
    """The counter of a Python worker, which serves many tasks: this code itself arrives anew with each."""
    held = vars(sys.modules.setdefault("_headwater_prefix_counters", types.ModuleType("_headwater_prefix_counters")))
    if path not in held:
        held[path] = PrefixCounter(path)
    return held[path]


def _over(path: str | Callable[[], str], answer: Callable[[list[np.ndarray]], dict[str, list]], *also: str):
    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        counter = _counter(path() if callable(path) else path)
        for b in batches:
            yield {c: b[c] for c in ("doc_id", *also)} | answer([counter.counts(t or "") for t in b["text"]])

    return rows


def prefix_counts(docs: DataFrame, doc_id: Column, text: Column, path: str | Callable[[], str]) -> DataFrame:
    """``(doc_id, n_tokens, steps)``: the token count of every prefix of every whole text, to be stored.

    ``steps`` is read with ``counts_of``, or asked with ``truncated`` and ``tokens_before``. ``path`` names the tokenizer's
    file, or is a function that does on the executors. Null and empty texts have no prefixes and 0 tokens; repeated rows
    and null ids each get their row; no rows give no rows.
    """

    def answer(counts: list[np.ndarray]) -> dict[str, list]:
        return {"n_tokens": list(map(total, counts)), "steps": list(map(packed_steps, counts))}

    return map_texts(docs, {"doc_id": doc_id, "text": text}, _over(path, answer), "doc_id bigint, n_tokens bigint, steps binary")


def _asked(stored: DataFrame, name: str, answer: Callable[[np.ndarray], int]) -> DataFrame:
    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            yield {"doc_id": b["doc_id"], name: [answer(counts_of(s)) for s in b["steps"]]}

    return map_texts(stored, {c: stored[c] for c in ("doc_id", "steps")}, rows, f"doc_id bigint, {name} bigint")


def truncated(stored: DataFrame, limit: int) -> DataFrame:
    """``(doc_id, n_chars)``: how much of each text of ``prefix_counts`` fits into ``limit`` tokens."""
    return _asked(stored, "n_chars", lambda counts: longest_within(counts, limit))


def tokens_before(stored: DataFrame, chars: int) -> DataFrame:
    """``(doc_id, n_tokens)``: tokens of the first ``chars`` characters of each text (of all, if it has fewer)."""
    return _asked(stored, "n_tokens", lambda counts: total(counts[: max(chars, 0)]))


def count_tokens(docs: DataFrame, doc_id: Column, text: Column, path: str | Callable[[], str], limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, chars_in_limit)`` of every whole text, from its prefix counts.

    ``chars_in_limit`` is the length of the longest prefix of at most ``limit`` tokens. Null texts are empty: no bytes, no
    tokens. Repeated rows and null ids each get their row; no rows give no rows. Map-only.
    """

    def answer(counts: list[np.ndarray]) -> dict[str, list]:
        return {"n_tokens": list(map(total, counts)), "chars_in_limit": [longest_within(c, limit) for c in counts]}

    whole = map_texts(
        docs,
        {"doc_id": doc_id, "text": text, "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")},
        _over(path, answer, "n_bytes"),
        "doc_id bigint, n_bytes bigint, n_tokens bigint, chars_in_limit bigint",
    )
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
