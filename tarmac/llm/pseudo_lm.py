"""Masked pseudo-likelihood scores of documents.

The vocabulary is every word of the corpus, counted over all documents. The most
frequent words are classes of their own; the others fall into hash classes. A
network predicts every word's class from the words on both sides of it (a window
of ``SIDE`` each way): the neighbours' embeddings, weighted by position, feed a
hidden layer and a softmax. Inside its class a word has its share of the class's
count, which a join on the word brings to the documents. Texts are cut into words
once and kept as numbers; all later passes read these. It is trained in numpy by parallel gradient descent: in each round all partitions start from the same
parameters, train on their share of the positions, and the results are averaged
by the number of positions; every position is trained on in one of the rounds. A document's score is the sum of its words'
conditional log-probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import byte_slices, quoted, shared_table
from tarmac.session import ensure_checkpoint_dir

FREQUENT, OTHERS, SIDE, WIDTH = 159, 32, 2, 24
VOCAB = FREQUENT + OTHERS + 1  # and the edge of a text
EDGE = VOCAB - 1
#: The rounds take turns at the positions, so that each is a target once.
ROUNDS, BATCH, RATE = 2, 256, 0.15
#: Different words and words in all after which a row of coded texts ends.
CACHE, LENGTH = 50_000, 1 << 20
#: Positions scored at a time, up to which size an exponent needs no shift, and the
#: steps of training (each adds at most RATE to a parameter) after which that is looked at.
STEP, PLAIN, LOOK = 1 << 10, 60.0, 4
SHAPES = {"emb": (VOCAB, WIDTH), "mix": (2 * SIDE, WIDTH, WIDTH), "bias": (WIDTH,), "out": (WIDTH, VOCAB), "base": (VOCAB,)}
ASCII = bytes(ord(chr(i).lower()) if chr(i).isalnum() or chr(i) == "_" else 32 for i in range(256))


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    r"""For every code point, its lower case, or a space where that is outside ``\w``."""
    low = [chr(i).lower() for i in range(0x110000)]
    return np.array([ord(c) if len(c) == 1 and (c.isalnum() or c == "_") else 32 for c in low], dtype="<u4")


def spaced(text: str | None) -> bytes:
    r"""The lower-cased text in UTF-8, with a space for every character outside ``\w``."""
    if not text:
        return b""
    if text.isascii():
        return text.encode().translate(ASCII)
    if "\u0130" in text or "\u03a3" in text:  # becomes two characters; depends on those beside it
        text = text.lower()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _lowered()[points].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    r"""The runs of ``\w`` of the lower-cased text: all else becomes a space."""
    return spaced(text).decode("utf-8", "surrogatepass").split()


def cut(texts: list[str | None]) -> tuple[np.ndarray, pa.StringArray]:
    """``words_of`` of texts: how many each has, and all of them in order."""
    lines = [spaced(t) for t in texts]
    line = np.frombuffer(b" ".join([b"", *lines, b""]), dtype=np.uint8)
    inside = line != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes = np.diff(np.searchsorted(starts, np.cumsum([len(x) + 1 for x in lines])), prepend=0)
    at = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=at[1:])
    return sizes, pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(line[inside]))


def coded_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts as numbers of their words, many texts a row: ``ids``, ``sizes`` (words
    of each text), ``slices`` (texts of each slice of at most 256 KB), ``codes``
    (the texts' words as places in ``words``, 16 bits each where these suffice),
    ``words`` (joined by spaces; null if there are none) and ``times`` (how often
    each occurs).

    Checkpointed, so its rows keep their places in the partitions of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        none = pa.array([], pa.string())
        ids, sizes, slices, codes, known, length = [], [], [], [], none, 0

        def out() -> pa.RecordBatch:
            line = np.concatenate(codes).astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
            all_ids = pa.concat_arrays(ids)
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known), " ")
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
                 pa.array([np.concatenate(sizes)], pa.list_(pa.int32())), pa.array([slices], pa.list_(pa.int32())),
                 pa.array([line.tobytes()], pa.binary()), words if len(known) else pa.nulls(1, pa.string()),
                 pa.array([np.bincount(line, minlength=len(known))], pa.list_(pa.int32()))],
                names=["ids", "sizes", "slices", "codes", "words", "times"])

        for part in (part for b in batches for part in byte_slices(b, 1)):
            ids.append(part.column(0))
            slices.append(part.num_rows)
            each, words = cut(part.column(1).to_pylist())
            sizes.append(each)
            # Words known before come first, so they keep their numbers.
            both = pa.concat_arrays([known, words]).dictionary_encode()
            codes.append(both.indices.to_numpy()[len(known):].astype(np.uint32))
            known, length = both.dictionary, length + len(words)
            if len(known) >= CACHE or length >= LENGTH or sum(slices) >= CACHE:
                yield out()
                ids, sizes, slices, codes, known, length = [], [], [], [], none, 0
        if slices:
            yield out()

    ensure_checkpoint_dir(docs.sparkSession)
    return docs.select(F.col(quoted(id_col)), F.col(quoted(text_col))).mapInArrow(
        run, f"ids array<{kind}>, sizes array<int>, slices array<int>, codes binary, words string, times array<int>").checkpoint()


def word_counts(coded: DataFrame) -> DataFrame:
    """``word``, ``n`` over all texts."""
    each = coded.select(F.explode(F.arrays_zip(F.split("words", " ").alias("word"), F.col("times").alias("n"))).alias("w"))
    return each.groupBy("w.word").agg(F.sum("w.n").alias("n"))


def numbered(frequent: list[str]) -> dict[bytes, int]:
    return {w.encode(): i for i, w in enumerate(frequent)}


def classes_of(words: str | None, frequent: dict[bytes, int]) -> np.ndarray:
    """The ids of the classes of words joined by spaces."""
    each = (words or "").encode().split()
    top = np.fromiter(map(frequent.get, each, repeat(-1)), dtype=np.int64, count=len(each))
    return np.where(top < 0, FREQUENT + np.fromiter(map(zlib.crc32, each), dtype=np.int64, count=len(each)) % OTHERS, top)


def codes_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["codes"], dtype=np.uint16 if len(row["codes"]) == 2 * sum(row["sizes"]) else np.uint32)


def texts_of(row: dict, classes: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The classes of the words of every text of a coded row, by slice."""
    line = classes[codes_of(row)]
    texts = np.split(line, np.cumsum(row["sizes"])[:-1])
    at = 0
    for n in row["slices"]:
        yield texts[at:at + n]
        at += n


def _rows(batches, *columns: str) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in columns}


def contexts(docs: list[np.ndarray], some: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """``some`` targets and their neighbours (positions, 2 SIDE) of texts laid end to end."""
    edge = np.full(SIDE, EDGE)
    line = np.concatenate([x for d in docs for x in (edge, d)] + [edge])
    at = np.flatnonzero(line != EDGE)[some]
    around = [k for k in range(-SIDE, SIDE + 1) if k]
    return line[at], np.stack([line[at + k] for k in around]).T


def initial(counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    p["base"] = np.log((counts + 1) / (counts + 1).sum()).astype(np.float32)
    p["mix"] += np.eye(WIDTH, dtype=np.float32)[None] * 0.5
    p["bias"][:] = 0
    return p


class Network:
    """Parameters in training and their sums of squared gradients, as one vector
    each, with the mixes side by side."""

    def __init__(self, p: dict[str, np.ndarray]):
        parts = [p["emb"], p["mix"].transpose(1, 0, 2), p["bias"], p["out"], p["base"]]
        self.at = np.concatenate([x.ravel() for x in parts]).astype(np.float32)
        self.squares = np.full(len(self.at), 1e-4, dtype=np.float32)
        self.grad = np.empty_like(self.at)
        self.emb, self.mix, self.bias, self.out, self.base = self.views(self.at)

    @staticmethod
    def views(x: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = VOCAB * WIDTH, VOCAB * WIDTH + 2 * SIDE * WIDTH * WIDTH
        return (x[:a].reshape(VOCAB, WIDTH), x[a:b].reshape(WIDTH, -1), x[b:b + WIDTH], x[b + WIDTH:-VOCAB].reshape(WIDTH, VOCAB),
                x[-VOCAB:])

    def parameters(self) -> dict[str, np.ndarray]:
        return {"emb": self.emb, "mix": self.mix.reshape(WIDTH, 2 * SIDE, WIDTH).transpose(1, 0, 2), "bias": self.bias,
                "out": self.out, "base": self.base}

    def train_on(self, target: np.ndarray, ctx: np.ndarray) -> None:
        """One pass of AdaGrad over mini-batches."""
        # Neighbours enter through their mixed embeddings: gradients are summed by
        # neighbour and word first and pass through ``mix`` once for each word.
        # ``last`` is ``out`` with ``base`` as the weights of a hidden value that is 1.
        emb, mix, bias, out, base = self.emb, self.mix, self.bias, self.out, self.base
        d_emb, d_mix, d_bias, _, _ = self.views(self.grad)
        last, d_last = (x[-(WIDTH + 1) * VOCAB:].reshape(WIDTH + 1, VOCAB) for x in (self.at, self.grad))
        slots, ones, rows = 2 * SIDE, np.ones(max(VOCAB, BATCH), dtype=np.float32), np.arange(BATCH)
        words = np.ascontiguousarray(ctx.T) * slots + np.arange(slots)[:, None]
        place = np.arange(VOCAB * slots * WIDTH).reshape(VOCAB * slots, WIDTH)
        scores, hidden = np.empty((BATCH, VOCAB), dtype=np.float32), np.ones((BATCH, WIDTH + 1), dtype=np.float32)
        for step, at in enumerate(range(0, len(target), BATCH)):
            y, near_by = target[at:at + BATCH], words[:, at:at + BATCH]
            n = len(y)
            near = (emb @ mix).reshape(-1, WIDTH)
            h = near.take(near_by[0], axis=0)
            for k in range(1, slots):
                h += near.take(near_by[k], axis=0)
            h += bias
            np.tanh(h, out=h)
            above = hidden[:n]
            above[:, :WIDTH] = h
            z = np.matmul(above, last, out=scores[:n])
            if step % LOOK == 0:
                small = plain(out, base)
            if not small:
                z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            # The gradient's rows, but for their factors, which the narrow side takes.
            total = z @ ones[:VOCAB]
            z[rows[:n], y] -= total
            factor = (1 / (n * total))[:, None]
            dh = (z @ out.T) * factor * (1 - h * h)
            weights = np.empty((slots, dh.size))
            weights[:] = dh.ravel()
            sums = np.bincount(place.take(near_by, axis=0).ravel(), weights.ravel(), place.size)
            dnear = sums.astype(np.float32).reshape(VOCAB, -1)
            np.matmul(dnear, mix.T, out=d_emb)
            np.matmul(emb.T, dnear, out=d_mix)
            np.matmul(ones[:n], dh, out=d_bias)
            np.matmul((above * factor).T, z, out=d_last)
            self.squares += self.grad * self.grad
            self.grad *= RATE
            self.grad /= np.sqrt(self.squares)
            self.at -= self.grad


def plain(out: np.ndarray, base: np.ndarray) -> bool:
    """Whether no score can be too large for an exponent, as hidden values are at most 1."""
    return bool((np.abs(out).sum(axis=0) + np.abs(base)).max() < PLAIN)


def log_probs(tables: dict, target: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Conditional log-probability of every target."""
    h = tables["near"][0].take(ctx[:, 0], axis=0)
    for k in range(1, 2 * SIDE):
        h += tables["near"][k].take(ctx[:, k], axis=0)
    h += tables["bias"]
    z = np.tanh(h, out=h) @ tables["out"]
    z += tables["base"]
    if not tables["plain"]:
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(target)), target].astype(np.float64)
    return own - np.log((np.exp(z, out=z) @ np.ones(VOCAB, dtype=np.float32)).astype(np.float64))


def scoring_tables(p: dict[str, np.ndarray]) -> dict:
    """Parameters with each neighbour's embedding already mixed."""
    return {"near": np.einsum("vd,kde->kve", p["emb"], p["mix"]), "bias": p["bias"], "out": p["out"], "base": p["base"],
            "plain": plain(p["out"], p["base"])}


def _flat(p) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def _unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at:at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _round(docs: DataFrame, frequent: list[str], p: dict[str, np.ndarray], turn: int) -> dict[str, np.ndarray]:
    """One round on ``coded_texts`` (or on a column ``text``)."""
    if "codes" not in docs.columns:
        docs = coded_texts(docs.withColumn("doc_id", F.lit(None).cast("long")), "doc_id", "text")
    start, top = _flat(p), numbered(frequent)

    def run(batches):
        mine, seen = Network(_unflat(start)), 0
        for row in _rows(batches, "sizes", "slices", "codes", "words"):
            classes = classes_of(row["words"], top)
            for texts in texts_of(row, classes):
                if not sum(map(len, texts)):
                    continue
                target, ctx = contexts(texts, slice(turn, None, ROUNDS))
                mine.train_on(target, ctx)
                seen += len(target)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(start), dtype=np.int32)), pa.array(_flat(mine.parameters()).astype(np.float64) * seen),
                 pa.array(np.full(len(start), seen, dtype=np.int64))], names=["i", "x", "n"])

    # One row for each parameter (a fixed number) reaches the driver.
    rows = docs.select("sizes", "slices", "codes", "words")
    got = rows.mapInArrow(run, "i int, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).collect()
    if got:
        start[[r["i"] for r in got]] = [r["x"] for r in got]
    return _unflat(start)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``log_prob`` (sum of the
    words' conditional log-probabilities) and ``mean_log_prob``.

    Null texts and texts without words have no words, a sum of 0 and a null mean.
    Of words of equal count the alphabetically first become classes of their own.
    Repeated rows get equal answers; other columns are ignored.
    """
    src = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    coded = coded_texts(src, "doc_id", "text")
    counts = shared_table(word_counts(coded), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = [r["word"] for r in top]
    start = np.zeros(VOCAB)
    start[:len(top)] = [r["n"] for r in top]
    rest = counts.filter(~F.col("word").isin(frequent)) if frequent else counts
    by_bucket = rest.groupBy(F.pmod(F.crc32("word"), F.lit(OTHERS)).alias("b")).agg(F.sum("n").alias("n")).collect()
    for r in by_bucket:
        start[FREQUENT + r["b"]] = r["n"]
    p = initial(start)
    for turn in range(ROUNDS):
        p = _round(coded, frequent, p, turn)
    tables, known = scoring_tables(p), numbered(frequent)
    kind = src.schema["doc_id"].dataType.simpleString()
    whole = np.zeros(VOCAB)  # log counts of the classes of several words
    whole[FREQUENT:EDGE] = np.log(np.maximum(start[FREQUENT:EDGE], 1))

    def score(batches):
        # The words' classes; what is left of a row are the words that share their class.
        for b in batches:
            for i, row in enumerate(_rows([b], "sizes", "slices", "codes", "words")):
                classes = classes_of(row["words"], known)
                codes, size, total = codes_of(row), np.array(row["sizes"], dtype=np.int64), [np.zeros(0)]
                for texts in texts_of(row, classes):
                    if sum(map(len, texts)):
                        target, ctx = contexts(texts)
                        total += [log_probs(tables, target[k:k + STEP], ctx[k:k + STEP]) for k in range(0, len(target), STEP)]
                line, text = classes[codes], np.repeat(np.arange(len(size)), size)
                log_prob = np.bincount(text, np.concatenate(total) - whole[line], len(size))
                share = line >= FREQUENT
                shared = np.bincount(text[share], minlength=len(size))
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").slice(i, 1), b.column("ids").slice(i, 1), pa.array([size], pa.list_(pa.int64())),
                     pa.array([log_prob], pa.list_(pa.float64())), pa.array([shared], pa.list_(pa.int32())),
                     pa.array([codes[share].tobytes()], pa.binary())], names=["row", "ids", "size", "log_prob", "sizes", "codes"])

    def add_shares(found: pa.Table, rows: pa.Table) -> pa.Table:
        # One coded row, and the counts of those of its words that share their class.
        row = {c: rows.column(c)[0].as_py() for c in ("sizes", "codes")}
        codes, places, n = codes_of(row), found.column("place").to_numpy(), len(row["sizes"])
        shares = np.zeros(max(codes.max(initial=0), places.max(initial=0)) + 1)
        shares[places] = np.log(found.column("n").to_numpy())
        inside = np.bincount(np.repeat(np.arange(n), row["sizes"]), shares[codes], n)
        return pa.table([pa.array(rows.column("ids")[0].values), pa.array(rows.column("size")[0].values),
                         pa.array(rows.column("log_prob")[0].values.to_numpy() + inside)], names=["doc_id", "n_words", "log_prob"])

    # A coded row's number holds for both uses, as its place is checkpointed. A
    # word that occurs once in all has a log count of zero.
    coded = coded.withColumn("row", F.monotonically_increasing_id())
    places = coded.select(F.col("row").alias("at"), F.posexplode(F.split("words", " ")).alias("place", "word"))
    found = places.join(rest.filter("n > 1"), "word").select("at", "place", "n")
    parts = coded.drop("times").mapInArrow(
        score, f"row long, ids array<{kind}>, size array<long>, log_prob array<double>, sizes array<int>, codes binary")
    scored = found.groupBy("at").cogroup(parts.groupBy("row")).applyInArrow(
        add_shares, f"doc_id {kind}, n_words long, log_prob double")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
