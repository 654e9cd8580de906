"""Masked pseudo-likelihood: a window network that sees both sides of a word scores documents by every word's chance.

The network gives the chance of a word's class. Within a class of many words each has its share of the class's count in
the corpus; the counts of all words are a table in Spark. One count a class is set aside for words never seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm import slots
from headwater.llm.common import map_texts
from headwater.storage import materialize

#: Word classes: the most frequent words stand for themselves, all others for one of BUCKETS classes by a hash.
CLUSTERS, INNER = 32, 32
CLASSES, BUCKETS = CLUSTERS * INNER, 128
#: Words seen on either side, and sizes of a word's vector and of the hidden layer.
REACH, VECTOR, HIDDEN = 2, 16, 32
#: Rounds of training; each masks another share of the words, and together all of them.
ROUNDS = 3
#: Windows in a block, steps of descent a block, and their rate; windows scored at a time.
BLOCK, STEPS, RATE, SCORED = 32_768, 8, 0.01, 8_192
#: Words counted or remembered at a time by a task.
MEMORY = 1 << 20
#: Words whose counts every task knows, the most frequent ones; the counts of others are joined.
KNOWN = 1 << 21
#: Sums of weights that reach the driver in a round.
SUMS = 16


@dataclass(frozen=True)
class Vocabulary:
    """What is known of a corpus's words, by a hash of each.

    ``classes`` has the most frequent ones, each a class of its own. ``counts(key, n)`` is the table of all the others, and
    ``totals`` their sum by class. ``known`` and ``logs`` are the most frequent of those and the logarithms of their
    counts; ``rest`` is a table of slots that holds the keys of all others that occur more than once.
    """

    classes: dict[int, int]
    counts: DataFrame
    totals: np.ndarray
    known: np.ndarray
    logs: np.ndarray
    rest: np.ndarray


@dataclass(frozen=True)
class WindowModel:
    words: Vocabulary
    parameters: np.ndarray


def _shapes() -> list[tuple[int, ...]]:
    return [
        (CLASSES + 1, VECTOR),  # word vectors; the last stands for places beyond the text
        (2 * REACH * VECTOR, HIDDEN),
        (HIDDEN,),
        (HIDDEN, CLUSTERS),
        (CLUSTERS,),
        (CLUSTERS, HIDDEN, INNER),
        (CLUSTERS, INNER),
    ]


def _views(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _shapes():
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def initial() -> np.ndarray:
    """Small random weights, always the same."""
    rng = np.random.default_rng(7)
    size = sum(int(np.prod(s)) for s in _shapes())
    flat = np.zeros(size, dtype=np.float32)
    for v in _views(flat):
        if v.ndim > 1:
            v[...] = rng.normal(0, 1 / np.sqrt(v.shape[-2]), v.shape)
    return flat


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of one column in each row, and all probabilities, in the place of ``x``."""
    rows = np.arange(len(x))
    x -= x.max(axis=1, keepdims=True)
    chosen = x[rows, at]
    np.exp(x, out=x)
    sums = x.sum(axis=1, keepdims=True)
    x /= sums
    return chosen - np.log(sums[:, 0]), x


def log_chances(flat: np.ndarray, context: np.ndarray, target: np.ndarray, gradient: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of each target class in its context; adds the mean's descent gradient if asked for.

    A class is a cluster and a place in it, each predicted from the hidden layer. Rows are taken by cluster, so each
    cluster's weights are one product.
    """
    e, w, b, a, a0, o, o0 = _views(flat)
    n = len(target)
    order = np.argsort((target // INNER).astype(np.uint8), kind="stable")
    context, target = context[order], target[order]
    cluster, inner, rows = target // INNER, target % INNER, np.arange(n)
    ends = np.searchsorted(cluster, np.arange(CLUSTERS + 1)).tolist()
    there = [(c, ends[c], ends[c + 1]) for c in range(CLUSTERS) if ends[c] < ends[c + 1]]
    x = e[context].reshape(n, -1)
    h = np.tanh(x @ w + b)
    first, d1 = _softmax(h @ a + a0, cluster)
    scores = np.empty((n, INNER), dtype=flat.dtype)
    for c, i, j in there:
        np.dot(h[i:j], o[c], out=scores[i:j])
    scores += o0[cluster]
    second, d2 = _softmax(scores, inner)
    out = np.empty(n, dtype=flat.dtype)
    out[order] = first + second
    if gradient is not None:
        ge, gw, gb, ga, ga0, go, go0 = _views(gradient)
        d1[rows, cluster] -= 1
        d2[rows, inner] -= 1
        d1 /= n
        d2 /= n
        ga += h.T @ d1
        ga0 += d1.sum(axis=0)
        dh = d1 @ a.T
        for c, i, j in there:
            go[c] += h[i:j].T @ d2[i:j]
            go0[c] += d2[i:j].sum(axis=0)
            dh[i:j] += d2[i:j] @ o[c].T
        dz = dh * (1 - h * h)
        gw += x.T @ dz
        gb += dz.sum(axis=0)
        dx = (dz @ w.T).reshape(-1, VECTOR)
        ids = context.ravel()
        for k in range(VECTOR):
            ge[:, k] += np.bincount(ids, weights=dx[:, k], minlength=CLASSES + 1).astype(flat.dtype)
    return out


def train(flat: np.ndarray, windows: Iterator[np.ndarray]) -> tuple[np.ndarray, int]:
    """One pass of Adam over rows of ``target, context...``; the new weights and the number of rows."""
    flat = flat.copy()
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    step = seen = 0
    for block in windows:
        size = max(64, len(block) // STEPS)
        for at in range(0, len(block), size):
            part = block[at : at + size].astype(np.int64)
            g = np.zeros_like(flat)
            log_chances(flat, part[:, 1:], part[:, 0], g)
            step, seen = step + 1, seen + len(part)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            flat -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return flat, seen


def _key(word: str) -> int:
    """A signed hash of a word; its last bits are its class, if it has none of its own."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) - (1 << 63)


def classes_of(text: str, words: Vocabulary) -> np.ndarray:
    """The class of each word of a text; words end at white space."""
    keys = [_key(w) for w in text.split()]
    return np.array([words.classes.get(k, CLASSES - BUCKETS + k % BUCKETS) for k in keys], dtype=np.int16)


_OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]


def _contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    padded = np.concatenate([np.full(REACH, CLASSES), ids, np.full(REACH, CLASSES)])
    return padded[at[:, None] + REACH + np.array(_OFFSETS)]


def count_words(docs: DataFrame, text: Column) -> Vocabulary:
    """Count every word of every text, once, by its hash: a table that grows with the corpus.

    From it come the classes: the most frequent words, by falling count, then by hash, have one each.
    """

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                held.update((t or "").split())
            if len(held) >= MEMORY:
                yield {"key": list(map(_key, held)), "n": list(held.values())}
                held = Counter()
        yield {"key": list(map(_key, held)), "n": list(held.values())}

    each = map_texts(docs, {"text": text}, rows, "key bigint, n bigint")
    counts = materialize(each.groupBy("key").agg(F.sum("n").alias("n")), "word-counts")
    top = [r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(CLASSES - BUCKETS).collect()]
    counts = counts.where(~F.col("key").isin(top)) if top else counts
    totals = np.zeros(BUCKETS)
    for r in counts.groupBy(F.pmod("key", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[r["bucket"]] = r["n"]
    # The least count at which no more words are left than a task may know.
    often = {r["n"]: r["words"] for r in counts.groupBy(F.least("n", F.lit(KNOWN)).alias("n")).agg(F.count("n").alias("words")).collect()}
    least, known = KNOWN + 1, 0
    for n in sorted(often, reverse=True):
        if n < 2 or known + often[n] > KNOWN:
            break
        least, known = n, known + often[n]
    table = counts.where(F.col("n") >= least).toArrow()
    keys, logs = table["key"].to_numpy(), np.log(table["n"].to_numpy())
    order = np.argsort(keys)
    left = counts.where((F.col("n") > 1) & (F.col("n") < least))
    return Vocabulary({k: i for i, k in enumerate(top)}, counts, totals, keys[order], logs[order], _slots_of(left))


def _bits_of(table: np.ndarray) -> int:
    return int(len(table) * 8).bit_length() - 1


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _slots_of(words: DataFrame) -> np.ndarray:
    """A table of slots that has the keys of ``words(key)``."""
    bits = slots.bits_for(8 * words.count())

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held: list[int] = []
        for b in batches:
            held += b["key"]
            if len(held) >= MEMORY:
                yield slots.counted(_slot(np.array(held), bits), bits)
                held = []
        if held:
            yield slots.counted(_slot(np.array(held), bits), bits)

    return slots.frequent(map_texts(words, {"key": words["key"]}, rows, slots.COUNTED), bits, 1)


class _Reader(dict):
    """Words that a task has met, numbered, with what the vocabulary says of each."""

    def __init__(self, words: Vocabulary, shared: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        super().__init__()
        self.classes, self.totals = words.classes, np.log(words.totals + 1)
        self.known, self.logs, self.rest = shared
        self.bits = _bits_of(self.rest)
        self.new: list[str] = []
        self.table = [np.zeros(0, dtype=t) for t in ("<i2", np.float64, np.int64, bool)]

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Where each text's words end; of each word the number; and by number: class, logarithm of its known share of
        the class, key, and whether its count has to be joined."""
        if len(self) > MEMORY:
            self.clear()
            self.table = [t[:0] for t in self.table]
        found = [t.split() for t in texts]
        ends = np.cumsum([len(f) for f in found], dtype=np.int64)
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(ends[-1]))
        if self.new:
            keys = np.fromiter(map(_key, self.new), dtype=np.int64, count=len(self.new))
            own = np.array([self.classes.get(k, -1) for k in keys.tolist()])
            bucket = keys % BUCKETS
            logs, asked = -self.totals[bucket], slots.passes(self.rest, _slot(keys, self.bits))
            if len(self.known):
                at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
                there = self.known[at] == keys
                logs, asked = logs + np.where(there, self.logs[at], 0), asked & ~there
            parts = (np.where(own < 0, CLASSES - BUCKETS + bucket, own), np.where(own < 0, logs, 0), keys, asked & (own < 0))
            self.table = [np.concatenate([t, p.astype(t.dtype)]) for t, p in zip(self.table, parts)]
            self.new = []
        return ends, ids, self.table


LINES = "doc_id bigint, n_tokens bigint, line binary, share double, keys array<bigint>, n array<bigint>"


def read_lines(docs: DataFrame, doc_id: Column, text: Column, words: Vocabulary) -> DataFrame:
    """``(row, doc_id, n_tokens, line, share, keys, n)``: each text as the classes of its words, written out.

    ``share`` is the sum of the logarithms of its words' shares of their classes, as far as they are known to every task;
    ``keys`` and ``n`` are the words whose counts must be joined, and how often they occur.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words.known, words.logs, words.rest))  # of bounded size
    alone = Vocabulary(words.classes, None, words.totals, None, None, None)

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        reader = _Reader(alone, shared.value)
        for b in batches:
            ends, ids, (classes, logs, keys, asked) = reader.read([t or "" for t in b["text"]])
            starts = np.concatenate([[0], ends[:-1]])
            sums = np.concatenate([[0.0], np.cumsum(logs[ids])])
            line = classes[ids]
            at = np.flatnonzero(asked[ids])
            of, which = np.searchsorted(ends, at, side="right"), keys[ids[at]]
            order = np.lexsort((which, of))
            of, which = of[order], which[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (which[1:] != which[:-1])])) if len(of) else of
            times, of, which = np.diff(np.append(first, len(of))), of[first], which[first]
            cut = np.searchsorted(of, np.arange(len(ends) + 1))
            yield {
                "doc_id": b["doc_id"],
                "n_tokens": (ends - starts).tolist(),
                "line": [line[i:j].tobytes() for i, j in zip(starts, ends)],
                "share": (sums[ends] - sums[starts]).tolist(),
                "keys": [which[i:j].tolist() for i, j in zip(cut, cut[1:])],
                "n": [times[i:j].tolist() for i, j in zip(cut, cut[1:])],
            }

    read = map_texts(docs, {"doc_id": doc_id, "text": text}, rows, LINES)
    return materialize(read.withColumn("row", F.monotonically_increasing_id()), "lines")


def _joined(lines: list[bytes]) -> np.ndarray:
    """Texts in a line, set apart by places beyond a text."""
    gap = np.full(REACH, CLASSES, dtype="<i2")
    return np.concatenate([gap, *[x for t in lines for x in (np.frombuffer(t, "<i2"), gap)]])


def masked(line: np.ndarray, turn: int, rounds: int) -> Iterator[np.ndarray]:
    """Rows of ``target, context...`` in blocks: one word in ``rounds`` of texts in a line, over all turns each word once."""
    at = np.flatnonzero(line != CLASSES)[turn::rounds]
    for i in range(0, len(at), BLOCK):
        yield line[at[i : i + BLOCK, None] + np.array([0, *_OFFSETS])]


def train_windows(lines: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Train on every word of every text. In each round every task masks one word in ``rounds`` of its share, from another
    start each time, and trains a copy of the weights on them. The copies are summed in Spark, weighted by words, so the
    driver only ever holds ``SUMS`` sums of fixed size. Without any word the weights stay as they begin."""
    flat = initial()
    for turn in range(rounds):
        shared = lines.sparkSession.sparkContext.broadcast(flat)  # of fixed size

        def learn(batches: Iterator[dict[str, list]], shared=shared, turn=turn) -> Iterator[dict[str, list]]:
            joined = (_joined(b["line"]) for b in batches)
            new, seen = train(shared.value, (w for line in joined for w in masked(line, turn, rounds)))
            if seen:
                yield {"seen": [seen], "sum": [(new.astype(np.float64) * seen).tobytes()]}

        def add(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            seen, total = 0, np.zeros(len(initial()))
            for b in batches:
                seen += sum(b["seen"])
                for x in b["sum"]:
                    total += np.frombuffer(x)
            if seen:
                yield {"seen": [seen], "sum": [total.tobytes()]}

        schema = "seen bigint, sum binary"
        copies = map_texts(lines, {"line": lines["line"]}, learn, schema).repartition(SUMS)
        sums = map_texts(copies, {c: copies[c] for c in ("seen", "sum")}, add, schema).collect()
        if sums:
            flat = (sum(np.frombuffer(r["sum"]) for r in sums) / sum(r["seen"] for r in sums)).astype(np.float32)
    return flat


def fit_windows(docs: DataFrame, doc_id: Column, text: Column, rounds: int = ROUNDS) -> WindowModel:
    """Count the words of a corpus and train on every one of them. Null and empty texts give nothing."""
    words = count_words(docs, text)
    return WindowModel(words, train_windows(read_lines(docs, doc_id, text, words), rounds))


def score_lines(lines: DataFrame, model: WindowModel) -> DataFrame:
    """``(doc_id, n_tokens, log_likelihood, mean_log_likelihood)`` of the texts of ``read_lines``."""
    shared = lines.sparkSession.sparkContext.broadcast(model.parameters)  # of fixed size

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        flat = shared.value
        for b in batches:
            line = _joined(b["line"]).astype(np.int64)
            at = np.flatnonzero(line != CLASSES)
            chance = np.empty(len(at) + 1, dtype=np.float64)
            chance[0] = 0
            for i in range(0, len(at), SCORED):
                part = at[i : i + SCORED]
                chance[i + 1 : i + 1 + len(part)] = log_chances(flat, line[part[:, None] + np.array(_OFFSETS)], line[part])
            sums = np.cumsum(chance)[np.concatenate([[0], np.cumsum(b["n_tokens"], dtype=np.int64)])]
            score = np.diff(sums) + np.array(b["share"])
            yield {"row": b["row"], "doc_id": b["doc_id"], "n_tokens": b["n_tokens"], "score": score.tolist()}

    columns = {c: lines[c] for c in ("row", "doc_id", "n_tokens", "line", "share")}
    scored = map_texts(lines, columns, rows, "row bigint, doc_id bigint, n_tokens bigint, score double")
    each = lines.select("row", F.explode(F.arrays_zip("keys", "n")).alias("x"))
    each = each.select("row", F.col("x.keys").alias("key"), F.col("x.n").alias("times"))
    known = model.words.counts.where("n > 1")  # the logarithm of 1 is 0
    parts = each.join(known, "key").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    total = F.col("score") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    whole = scored.join(parts, "row", "left")
    return whole.select("doc_id", "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"))


def score_documents(docs: DataFrame, doc_id: Column, text: Column, model: WindowModel) -> DataFrame:
    """``(doc_id, n_tokens, log_likelihood, mean_log_likelihood)``: every word of the whole text, from both sides.

    The chance is that of the word itself: of its class in its context, and of the word among those of its class. Tasks
    know the counts of the most frequent words and which others occur but once; the rest are joined, as a table of
    any size. A word the model has not seen has a count of one.

    A text without words has likelihood 0 and a null mean. Repeated rows and null ids each get their row.
    """
    return score_lines(read_lines(docs, doc_id, text, model.words), model)


def score_corpus(docs: DataFrame, doc_id: Column, text: Column, rounds: int = ROUNDS) -> DataFrame:
    """``score_documents`` of the documents that the model is trained on, whose texts are read twice in all."""
    words = count_words(docs, text)
    lines = read_lines(docs, doc_id, text, words)
    return score_lines(lines, WindowModel(words, train_windows(lines, rounds)))
