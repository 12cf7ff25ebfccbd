"""Byte-pair encoding and decoding with a tokenisation automaton.

The merges are compiled into one deterministic automaton over tokens that
accepts exactly the correct tokenisations. It starts as a single state with a
loop for each byte. For every merge ``u v -> w``, in order, a gadget is put in:
the target of the ``u`` arcs is cloned without its ``v`` arc, and wherever ``u``
and then ``v`` could be read, an arc ``w`` leads to where ``v`` led. All arcs of
one token share their target, so a state has the arcs that its row of a bit
table allows, and rows and columns that are equal are kept once.

A pre-split word is encoded by reading it from the left: at every byte the one
tokenisation of the prefix has a state, the trie of the arcs' labels gives the
tokens that start there, and the state's row says which of them may follow.
Words are read side by side as numpy arrays. Decoding emits the labels.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import quoted

#: The split pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text split at a time, words kept by a worker, words read side
#: by side, and the longest word (bytes) read that way.
STEP, CACHE, ABREAST, SHORT = 1 << 19, 100_000, 8192, 48
OUT_TOKENS = 1 << 20


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes
    for themselves, the others numbered on from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def classes(keys) -> tuple[np.ndarray, list]:
    """Number of each key's class of equals, and the classes' keys."""
    seen: dict = {}
    number = np.array([seen.setdefault(k, len(seen)) for k in keys], dtype=np.int32)
    return number, list(seen)


class Automaton:
    """``labels`` (bytes of every id), ``target`` (state after each token),
    ``column`` (its column), ``allowed`` (states by columns, bits packed),
    ``special`` (text of whole tokens to id); and the labels' trie:
    ``parent``, ``byte`` and ``token`` of its nodes, inner nodes first."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special = labels, special
        self._gadgets(merges)
        self._trie([t for t in range(len(labels)) if t not in set(special.values())])

    def _gadgets(self, merges: list[tuple[int, int, int]]) -> None:
        n = len(self.labels)
        made = {w for _, _, w in merges}
        target, holders, states = [0] * n, [n + 1], 1  # the start holds state 0
        table = np.zeros((64, n), dtype=np.uint8)  # eight states in a row of bytes, a byte for each token
        table[0, [t for t in range(n) if t not in made and t not in self.special.values()]] = 1
        for u, v, w in merges:
            q, after = target[u], target[v]
            holders[target[w]] -= 1
            target[w] = after
            holders[after] += 1
            if holders[q] > 1:
                s, states = states, states + 1
                if s >> 3 == len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[s >> 3] |= ((table[q >> 3] >> (q & 7)) & 1) << (s & 7)
                holders[q] -= 1
                holders.append(1)
                target[u] = q = s
            table[q >> 3, v] &= 255 - (1 << (q & 7))
            used = (states + 7) >> 3
            table[:used, w] = table[:used, u]
        table = table[:(states + 7) >> 3]
        self.column, cols = classes(table[:, t].tobytes() for t in range(n))
        table = np.array([np.frombuffer(c, dtype=np.uint8) for c in cols])
        table = np.packbits(np.unpackbits(table, axis=1, bitorder="little").T[:states], axis=1, bitorder="little")
        state, rows = classes(r.tobytes() for r in table)
        self.allowed = np.array([np.frombuffer(r, dtype=np.uint8) for r in rows])
        self.start = int(state[0])
        self.target = state[np.array(target)]

    def _trie(self, tokens: list[int]) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        inner: set[bytes] = {b""}
        for t in tokens:
            label = self.labels[t]
            for k in range(1, len(label) + 1):
                nodes.setdefault(label[:k], len(nodes))
                inner.add(label[:k - 1])
        number = {p: i for i, p in enumerate(sorted(nodes, key=lambda p: (p not in inner, len(p), p)))}
        self.inner = len(inner)
        self.parent = np.zeros(len(number), dtype=np.int32)
        self.byte = np.zeros(len(number), dtype=np.uint8)
        self.token = np.full(len(number), -1, dtype=np.int32)
        for p, i in number.items():
            if p:
                self.parent[i], self.byte[i] = number[p[:-1]], p[-1]
        for t in tokens:
            self.token[number[self.labels[t]]] = t


@lru_cache(maxsize=2)
def load_automaton(json_path: str) -> Automaton:
    """Compile a byte-level BPE file of the tokenizers library."""
    with open(json_path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre["add_prefix_space"] and not spec["normalizer"] and spec["decoder"]["type"] == "ByteLevel"
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                "byte_fallback", "ignore_merges"))
             and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))
    if not plain:
        raise ValueError(f"not a plain byte-level BPE vocabulary: {json_path}")
    letters, vocab = byte_letters(), model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for text, i in vocab.items():
        labels[i] = bytes(map(letters.__getitem__, text))
    for text, i in special.items():
        labels[i] = text.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)


class Numbers(dict):
    """Numbers new keys in their order."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes texts with an automaton; keeps the tokens of words it has seen."""

    def __init__(self, automaton: Automaton, json_path: str):
        self.fsa, self.json_path, self.library = automaton, json_path, None
        self.next = np.full((automaton.inner, 256), -1, dtype=np.int32)
        self.next[automaton.parent[1:], automaton.byte[1:]] = np.arange(1, len(automaton.parent))
        self.size_of = np.array([len(x) for x in automaton.labels], dtype=np.int32)
        self.split = regex.compile(SPLIT)
        self.whole = re.compile("(" + "|".join(sorted(map(re.escape, automaton.special), key=len, reverse=True)) + ")")
        self._forget()

    def _forget(self) -> None:
        self.index = Numbers({w: i for i, w in enumerate(self.fsa.special)})
        self.flat = np.array(list(self.fsa.special.values()), dtype=np.int32)
        self.first = np.arange(len(self.flat) + 1)

    def words(self, text: str):
        """Lists of the pre-split words of a text, a stretch at a time."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            yield from self._library_words(text)
            return
        for part in self.whole.split(text) if self.fsa.special else [text]:
            if part in self.fsa.special:
                yield [part]
                continue
            at = 0
            while at < len(part):  # a word never goes on over white space that follows another character
                end = at + STEP
                while end < len(part) and not (part[end].isspace() and not part[end - 1].isspace()):
                    end += 1
                yield self.split.findall(part, at, end) if end < len(part) else self.split.findall(part, at)
                at = end

    def _library_words(self, text: str):
        """Characters younger than Python's tables: the library's own classes decide."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.json_path).pre_tokenizer
        for part in self.whole.split(text) if self.fsa.special else [text]:
            if part in self.fsa.special:
                yield [part]
            else:
                yield [part[a:z] for _, (a, z) in self.library.pre_tokenize_str(part)]

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words end to end, and their number in each word."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        body = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(size) - size
        last = np.zeros(len(body), dtype=np.int32)  # the last token of the tokenisation up to each byte
        order = np.argsort(-size, kind="stable")
        long = int((size > SHORT).sum())
        for i in order[:long].tolist():
            self._read_long(words[i], last[start[i]:start[i] + size[i]])
        for i in range(long, len(order), ABREAST):
            some = order[i:i + ABREAST]
            self._read_abreast(body, start[some], start[some] + size[some], last)
        return self._collect(last, start, size)

    def _read_abreast(self, body: np.ndarray, start: np.ndarray, end: np.ndarray, last: np.ndarray) -> None:
        fsa = self.fsa
        for i in range(int((end - start).max(initial=0))):
            n = int(np.searchsorted(start - end, -i))  # longest first: those with more than i bytes
            at, stop = start[:n] + i, end[:n]
            state = fsa.target[last[at - 1]] if i else np.full(n, fsa.start, dtype=np.int32)
            node = np.zeros(n, dtype=np.int32)
            while len(at):
                node = self.next[node, body[at]]
                on = node >= 0
                node, at, stop, state = node[on], at[on], stop[on], state[on]
                token = fsa.token[node]
                ends = np.flatnonzero(token >= 0)
                col = fsa.column[token[ends]]
                ok = ends[(fsa.allowed[state[ends], col >> 3] >> (col & 7)) & 1 == 1]
                last[at[ok]] = token[ok]
                at = at + 1
                on = (node < fsa.inner) & (at < stop)
                node, at, stop, state = node[on], at[on], stop[on], state[on]

    def _read_long(self, word: bytes, last: np.ndarray) -> None:
        fsa = self.fsa
        nxt, token, column, target = (memoryview(x) for x in (self.next, fsa.token, fsa.column, fsa.target))
        allowed, found = memoryview(np.ascontiguousarray(fsa.allowed)), [0] * len(word)
        for i in range(len(word)):
            state, node = target[found[i - 1]] if i else fsa.start, 0
            for j in range(i, len(word)):
                node = nxt[node, word[j]]
                if node < 0:
                    break
                t = token[node]
                if t >= 0 and allowed[state, column[t] >> 3] >> (column[t] & 7) & 1:
                    found[j] = t
                if node >= fsa.inner:
                    break
        last[:] = found

    def _collect(self, last: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the last tokens back from the end of every word."""
        count = np.zeros(len(size), dtype=np.int64)
        rows, at, taken = np.flatnonzero(size), (start + size - 1)[size > 0], []
        while len(rows):
            t = last[at]
            taken.append((rows, t))
            count[rows] += 1
            at = at - self.size_of[t]
            on = at >= start[rows]
            rows, at = rows[on], at[on]
        after = np.cumsum(count)
        out = np.empty(int(count.sum()), dtype=np.int32)
        for k, (rows, t) in enumerate(taken):
            out[after[rows] - 1 - k] = t
        return out, count

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words end to end, and their number in each word."""
        if len(self.index) > CACHE:
            self._forget()
        known, before = self.index, len(self.index)
        at = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        fresh = list(islice(known, before, None))
        if fresh:
            ids, count = self.read([w.encode("utf-8", "surrogatepass") for w in fresh])
            self.flat = np.concatenate([self.flat, ids])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count)])
        return gather(self.flat, self.first, at)


def gather(flat: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of ``flat`` end to end, and their sizes."""
    size = first[at + 1] - first[at]
    before = np.cumsum(size) - size
    return flat[np.repeat(first[at] - before, size) + np.arange(int(size.sum()))], size


def encode(docs: DataFrame, json_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``ids`` (array<int>), the ids that
    the tokenizers library gives for the whole text with the vocabulary at
    ``json_path`` and no special tokens added; the text of a special token is
    that token. Null and empty texts have no ids. Repeated rows get equal
    answers; other columns are ignored. The automaton's size depends on the
    vocabulary alone."""
    src = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(load_automaton(json_path))

    def run(batches):
        encoder = Encoder(shared.value, json_path)
        for b in batches:
            yield from _encoded(encoder, b)

    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _encoded(encoder: Encoder, b: pa.RecordBatch):
    texts = b.column(1)
    held, words, bounds, parts = 0, [], [], []  # words not yet encoded, and where rows end among them
    count, first_row = np.zeros(b.num_rows, dtype=np.int64), 0

    def flush() -> None:
        nonlocal held
        if words:
            ids, size = encoder.tokens(words)
            parts.append(ids)
            total = np.concatenate(([0], np.cumsum(size)))
            at = 0
            for row, end in bounds:
                count[row] += total[end] - total[at]
                at = end
        words.clear()
        bounds.clear()
        held = 0

    def out(end: int) -> pa.RecordBatch:
        nonlocal first_row
        flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        offsets = np.concatenate(([0], np.cumsum(count[first_row:end]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        part = pa.RecordBatch.from_arrays([b.column(0).slice(first_row, end - first_row), ids], names=["doc_id", "ids"])
        parts.clear()
        first_row = end
        return part

    for row in range(b.num_rows):
        for some in encoder.words(texts[row].as_py() or ""):
            words.extend(some)
            bounds.append((row, len(words)))
            held += sum(map(len, some))
            if held >= STEP:
                flush()
        if sum(map(len, parts)) >= OUT_TOKENS:
            flush()
            yield out(row + 1)
    flush()
    yield out(b.num_rows)


def decode(tokens: DataFrame, json_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` plus ``text_col``: the labels of the ids in ``ids_col`` end to
    end as text, special tokens included; bytes that are no UTF-8 become U+FFFD.
    Null ids give a null text, no ids an empty one; a null or unknown id is left out."""
    names = tokens.columns
    schema = ", ".join(f"{quoted(c)} {t}" for c, t in tokens.dtypes if c != text_col) + f", {quoted(text_col)} string"
    kept = [c for c in names if c != text_col]
    shared = tokens.sparkSession.sparkContext.broadcast(load_automaton(json_path))

    def run(batches):
        labels = shared.value.labels
        body = np.frombuffer(b"".join(labels), dtype=np.uint8)
        first = np.concatenate(([0], np.cumsum([len(x) for x in labels])))
        for b in batches:
            ids, texts, at = b.column(kept.index(ids_col)), [], 0
            for row in range(b.num_rows):
                if not ids[row].is_valid:
                    texts.append(None)
                    continue
                t = ids[row].values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                t = t[(t >= 0) & (t < len(labels))]
                texts.append(gather(body, first, t)[0].tobytes().decode("utf-8", "replace"))
                if sum(map(len, texts[at - row - 1:])) >= 8 * STEP:
                    yield _with_text(b.slice(at, row + 1 - at), texts, kept, text_col)
                    texts, at = [], row + 1
            yield _with_text(b.slice(at), texts, kept, text_col)

    return tokens.select(*[quoted(c) for c in kept]).mapInArrow(run, schema)


def _with_text(b: pa.RecordBatch, texts: list[str | None], names: list[str], text_col: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, text_col])
