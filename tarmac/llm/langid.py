"""Language identification with a linear-chain conditional random field.

Words are labelled with languages. A word's emission score sums the weights of
its affixes, its character n-grams and its lexicon memberships; learned
transitions score the change of language from a word to the next, and
forward-backward gives every word's label probabilities, so a text may switch
language. A document gets the label with the largest expected share of words.

The field is trained on a bounded sample of different labelled documents (at most
``per_lang`` for each language), by its exact gradient.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import quoted, shielded, small_batches, unshielded, with_key

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
HASHES = 1 << 15
#: Labelled documents of each language, the most characters of one of them, the
#: words of a training segment (long documents give many), and gradient steps.
PER_LANG, MAX_CHARS, SEGMENT, STEPS = 300, 200_000, 128, 30
#: Words scored together, cached per worker and turned into features at a time,
#: which bound a worker's memory.
CHUNK_WORDS, CACHE_WORDS, NEW_WORDS = 100_000, 100_000, 1 << 13


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray, salt: int) -> np.ndarray:
    x = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D) + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((x ^ (x >> np.uint32(16))) & np.uint32(HASHES - 1)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids of words: ``grams`` (2, characters) of the 2- and 3-grams that
    start at each character of the bounded words laid end to end, ``starts`` of
    the words there, and ``fixed`` (words, 7): prefixes and suffixes of 1 to 3
    characters and the lexicon. Id ``HASHES`` stands for no feature."""
    c = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts, ends = np.flatnonzero(c == ord("<")), np.flatnonzero(c == ord(">"))
    ahead = np.concatenate([c, np.zeros(3, dtype=np.uint32)])
    nil = np.uint32(0)
    one, two = ahead[1:len(c) + 1], ahead[2:len(c) + 2]
    last = c == ord(">")
    grams = np.stack([np.where(last, HASHES, _mix(c, one, nil, 1)),
                      np.where(last | (one == ord(">")), HASHES, _mix(c, one, two, 2))])
    size = ends - starts - 1
    head = [np.where(size > k, ahead[starts + 1 + k], nil) for k in range(3)]
    tail = [np.where(size > k, c[np.maximum(ends - 1 - k, 0)], nil) for k in range(3)]
    fixed = [_mix(x[0], x[1] if n > 1 else nil, x[2] if n > 2 else nil, salt + n)
             for x, salt in ((head, 10), (tail, 20)) for n in (1, 2, 3)]
    known = np.fromiter((lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    fixed.append(np.where(known < 0, HASHES, _mix(known.astype(np.uint32), nil, nil, 30)))
    return grams, starts, np.stack(fixed, axis=1)


class Field:
    """Parameters: ``weights`` (hash, label), ``trans`` (label, label), ``lexicon``."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((HASHES + 1, len(labels)), dtype=np.float32)  # the last row stays zero
        self.trans = np.zeros((len(labels), len(labels)), dtype=np.float32)

    def emissions(self, grams: np.ndarray, starts: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Scores of words from their features, (words, labels)."""
        w = self.weights
        return np.add.reduceat(w[grams[0]] + w[grams[1]], starts, axis=0) + w[fixed].sum(axis=1)


def _time_major(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences of non-increasing ``sizes``: how many are still running at
    each step, and for each word (sequence by sequence) its place step by step."""
    running = np.bincount(sizes, minlength=int(sizes[0]) + 1)[::-1].cumsum()[::-1][1:]
    first = np.concatenate(([0], np.cumsum(running)[:-1]))
    seq = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(seq)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return running, first[step] + seq


def forward_backward(scores: np.ndarray, running: np.ndarray, trans: np.ndarray, want_pairs: bool = False):
    """Label probabilities of every word, in step order; with ``want_pairs``
    also the expected transitions (label, label)."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(trans - trans.max()).astype(e.dtype)
    first = np.concatenate(([0], np.cumsum(running)))
    alpha = np.empty_like(e)
    for t, n in enumerate(running.tolist()):
        at = first[t]
        x = e[at:at + n] if t == 0 else (alpha[first[t - 1]:first[t - 1] + n] @ a) * e[at:at + n]
        alpha[at:at + n] = x / x.sum(axis=1, keepdims=True)
    pairs = np.zeros_like(a, dtype=np.float64)
    gamma = alpha.copy()
    beta = np.ones_like(e[:0])
    for t in range(len(running) - 2, -1, -1):
        n, at, nxt = int(running[t + 1]), first[t], first[t + 1]
        after = e[nxt:nxt + n]
        if len(beta):
            after = after.copy()
            after[:len(beta)] *= beta
        back = after @ a.T
        beta = back / back.sum(axis=1, keepdims=True)
        g = alpha[at:at + n] * beta
        gamma[at:at + n] = g / g.sum(axis=1, keepdims=True)
        if want_pairs:
            p = alpha[at:at + n, :, None] * a[None] * after[:, None, :]
            pairs += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return (gamma, pairs) if want_pairs else gamma


def train(texts: list[str], langs: list[str], steps: int = STEPS) -> Field:
    """Fit a field to documents of one known language each (every word of a
    document carries its label), by AdaGrad on the exact likelihood."""
    labels = sorted(set(langs))
    docs = [(labels.index(lang), w) for lang, t in zip(langs, texts) if (w := words_of(t))]
    counts: dict[str, np.ndarray] = {}
    for y, words in docs:
        for w in words:
            counts.setdefault(w, np.zeros(len(labels)))[y] += 1
    lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 5 and c.max() >= 0.8 * c.sum()}
    field = Field(labels, lexicon)
    segs = sorted(((y, words[i:i + SEGMENT]) for y, words in docs for i in range(0, len(words), SEGMENT)),
                  key=lambda s: -len(s[1]))
    if not segs or len(labels) < 2:
        return field
    vocab = {w: i for i, w in enumerate(counts)}
    sizes = np.array([len(w) for _, w in segs])
    running, place = _time_major(sizes)
    ids, gold = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.int64)
    ids[place] = np.fromiter((vocab[w] for _, ws in segs for w in ws), dtype=np.int64)
    gold[place] = np.repeat([y for y, _ in segs], sizes)
    feats = features(list(vocab), lexicon)
    grams, starts, fixed = feats
    owner = np.repeat(np.arange(len(vocab)), np.diff(np.append(starts, grams.shape[1])))
    k, n = len(labels), len(ids)
    real_pairs = np.diag(np.bincount([y for y, w in segs], weights=np.maximum(sizes - 1, 0), minlength=k))
    square_w, square_t = np.full((HASHES, k), 1e-8), np.full((k, k), 1e-8)

    def pulled(weights: np.ndarray) -> np.ndarray:
        out = np.bincount(grams[0], weights=weights[owner], minlength=HASHES + 1)
        out += np.bincount(grams[1], weights=weights[owner], minlength=HASHES + 1)
        out += np.bincount(fixed.ravel(), weights=np.repeat(weights, fixed.shape[1]), minlength=HASHES + 1)
        return out[:HASHES]

    for _ in range(steps):
        emit = field.emissions(*feats)
        gamma, pairs = forward_backward(emit[ids], running, field.trans, want_pairs=True)
        miss = -gamma
        miss[np.arange(n), gold] += 1
        per_word = [np.bincount(ids, weights=miss[:, j], minlength=len(vocab)) for j in range(k)]
        grad = np.stack([pulled(x) for x in per_word], axis=1) / n - 1e-6 * field.weights[:HASHES]
        step_t = (real_pairs - pairs) / n - 1e-3 * field.trans
        square_w += grad**2
        square_t += step_t**2
        field.weights[:HASHES] += (0.3 * grad / np.sqrt(square_w)).astype(np.float32)
        field.trans += (0.3 * step_t / np.sqrt(square_t)).astype(np.float32)
    return field


class Tagger:
    """Scores documents with a field; caches the emission scores of words."""

    def __init__(self, field: Field):
        self.field, self.index = field, {}
        self.table = np.empty((CACHE_WORDS * 2, len(field.labels)), dtype=np.float32)

    def _ids(self, docs: list[list[str]]) -> np.ndarray:
        known = self.index
        if len(known) > CACHE_WORDS:
            known.clear()
        fresh = {w for ws in docs for w in ws if w not in known}
        if fresh:
            new = list(fresh)
            top = len(known) + len(new)
            if top > len(self.table):
                self.table = np.concatenate([self.table, np.empty((top, self.table.shape[1]), dtype=np.float32)])
            for i in range(0, len(new), NEW_WORDS):
                some = new[i:i + NEW_WORDS]
                at = len(known) + i
                self.table[at:at + len(some)] = self.field.emissions(*features(some, self.field.lexicon))
            known.update(zip(new, range(len(known), top)))
        return np.fromiter((known[w] for ws in docs for w in ws), dtype=np.int64)

    def shares(self, docs: list[list[str]]) -> np.ndarray:
        """Expected share of each label among the words of each (non-empty) document."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        inorder = [docs[i] for i in order]
        sizes = np.array([len(d) for d in inorder])
        running, place = _time_major(sizes)
        ids = np.empty(len(place), dtype=np.int64)
        ids[place] = self._ids(inorder)
        gamma = forward_backward(self.table[ids], running, self.field.trans)
        sums = np.add.reduceat(gamma[place].astype(np.float64), np.cumsum(sizes) - sizes, axis=0)
        out = np.empty_like(sums)
        out[order] = sums / sizes[:, None]
        return out

    def label(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        part, rows, held = [], [], 0

        def flush():
            if part and self.field.labels:
                s = self.shares(part)
                for i, j, p in zip(rows, s.argmax(axis=1), s.max(axis=1)):
                    langs[i], scores[i] = self.field.labels[j], float(min(1.0, p))
            part.clear()
            rows.clear()

        # Texts of like length go together, which keeps the number of steps low.
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for i in np.argsort(-size, kind="stable").tolist():
            words = words_of(texts[i].as_py())
            if words and not any(ch.isalpha() for w in words for ch in w):
                words = []
            if words:
                part.append(words)
                rows.append(i)
                held += len(words)
            if held >= CHUNK_WORDS:
                flush()
                held = 0
        flush()
        return langs, scores


def training_sample(docs: DataFrame, text_col: str, lang_col: str, allowed: Column, key: Column,
                    per_lang: int = PER_LANG) -> tuple[list[str], list[str]]:
    """Different texts of at most ``MAX_CHARS`` characters and their languages: of
    every language the first ``per_lang`` by a hash. A text's copies count once."""
    text, lang = F.col(quoted(text_col)), F.col(quoted(lang_col))
    rows = docs.filter(allowed & lang.isNotNull() & (F.char_length(text) <= MAX_CHARS)).select(
        lang.alias("l"), text.alias("t"), key.alias("k"))
    sizes = {r[0]: r[1] for r in rows.select("l", "k").distinct().groupBy("l").count().collect()}  # one row per language
    draw = F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 20))
    chosen = F.lit(False)
    for name, n in sizes.items():  # twice as many as needed, which bounds what is ranked
        chosen = chosen | ((F.col("l") == name) & (draw < min(1 << 20, ((1 << 20) * 2 * per_lang) // n + 1)))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(draw, "k", "t"))
    got = rows.filter(chosen).distinct().withColumn("rank", rank).filter(F.col("rank") <= per_lang).orderBy("l", "t").collect()
    return [r["t"] for r in got], [r["l"] for r in got]


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: crc32 of the id as text is 2 modulo 4; a
    null id has no such remainder and is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_lang: int = PER_LANG) -> DataFrame:
    """``docs`` plus ``__lang`` (a learned label; ``und`` for null texts, texts
    without letters, or when nothing could be learned) and ``__score`` (0 to 1:
    the expected share of words in that language; 0 with ``und``).

    Learns only from ``text_col`` and a non-null ``lang_col`` of rows that are
    not held out; the language, like any other column, is not used to predict.
    Ties go to the first label; repeated rows get equal answers. Input columns
    named ``__lang`` or ``__score`` are replaced; others of a leading double
    underscore stay as they are.
    """
    docs, hidden = shielded(docs.drop("__lang", "__score"))
    id_col, text_col, lang_col = (hidden.get(c, c) for c in (id_col, text_col, lang_col))
    doc_id = F.col(quoted(id_col))
    may_learn = doc_id.isNotNull() & ~held_out(doc_id)
    keyed = with_key(docs, id_col, text_col)
    texts, langs = training_sample(keyed, text_col, lang_col, may_learn, F.col("__tk"), per_lang)
    field = train(texts, langs)
    small_batches(docs.sparkSession)

    # Only the texts go to Python, and nothing but the answers comes back.
    @F.arrow_udf("lang string, score double")
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(field)
        for texts in batches:
            found, score = tagger.label(texts)
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    names = [quoted(c) for c in docs.columns]
    # Not to be moved into a filter on the answer, where it would run once more.
    known = docs.select(*names, tag.asNondeterministic()(F.col(quoted(text_col))).alias("__tag"))
    return unshielded(known.select(*names, F.col("__tag.lang").alias("__lang"), F.col("__tag.score").alias("__score")), hidden)
