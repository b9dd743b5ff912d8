"""Byte-pair encoding of a corpus with a public tokenizer, computed over a trie of its words.

The encoding of a prefix ends in one token, its last-token state, and what comes
before that token is the encoding of a shorter prefix. So one state per node of
a trie of the distinct words holds all encodings, and each shared prefix is
computed once. A state is found among the tokens that end at the node, longest
first (an automaton of the vocabulary follows the path): the one that byte-pair
merging wouldn't tear apart from the last token before it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; never copied into the repository.
TOKENIZERS = os.environ.get("DARKROOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that cuts text into words before merging, as published with the vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded words that a worker remembers before it starts afresh; bounds its memory, not its results.
REMEMBERED = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letters that the vocabulary file writes for bytes: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merges of a byte-level BPE file and the automaton of its tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        ids = model["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        tokens = {}
        for text, i in ids.items():
            if all(c in letters for c in text):
                tokens[i] = bytes(letters[c] for c in text)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = ids[a + b]
            self.merged.setdefault((ids[a], ids[b]), whole)
            self.halves.setdefault(whole, (ids[a], ids[b]))
        reachable = {i: t for i, t in tokens.items() if len(t) == 1 or i in self.halves}
        self.length = {i: len(t) for i, t in reachable.items()}
        self._automaton(reachable)
        self._valid: dict[tuple[int, int], bool] = {}

    def _automaton(self, tokens: dict[int, bytes]) -> None:
        """Nodes of all prefixes of tokens: next by (node, byte), the longest proper suffix that is a node, the longest token that ends there."""
        step: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for i, t in tokens.items():
            node = 0
            for b in t:
                nxt = step[node].get(b)
                if nxt is None:
                    nxt = len(step)
                    step[node][b] = nxt
                    step.append({})
                    own.append(-1)
                node = nxt
            own[node] = i
        fail, best = [0] * len(step), [-1] * len(step)
        self.shorter: dict[int, int] = {}
        level = list(step[0].values())
        for n in level:
            best[n] = own[n]
        while level:
            below = []
            for node in level:
                for b, nxt in step[node].items():
                    f = fail[node]
                    while f and b not in step[f]:
                        f = fail[f]
                    fail[nxt] = step[f].get(b, 0)
                    suffix = best[fail[nxt]]
                    best[nxt] = own[nxt] if own[nxt] >= 0 else suffix
                    if own[nxt] >= 0:
                        self.shorter[own[nxt]] = suffix
                    below.append(nxt)
            level = below
        self.step, self.fail, self.best = step, fail, best

    def fits(self, left: int, right: int) -> bool:
        """Whether merging keeps ``left`` and ``right`` apart, in this order.

        Both tokens are taken apart in the reverse order of their merges. If at
        any moment the two pieces at the border could merge earlier than the
        merge that was just undone, merging would have crossed the border.
        """
        key = (left, right)
        known = self._valid.get(key)
        if known is None:
            if len(self._valid) > 4 * REMEMBERED:
                self._valid.clear()
            known = self._valid[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        merged, halves = self.merged, self.halves
        bound = float("inf")
        while True:
            across = merged.get((left, right))
            if across is not None and across < bound:
                return False
            split_left, split_right = halves.get(left), halves.get(right)
            if split_left is None and split_right is None:
                return True
            # Of equal merges the left one comes first, so the right one is undone first.
            if split_right is None or (split_left is not None and left > right):
                bound, left = left, split_left[1]
            else:
                bound, right = right + 1, split_right[0]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The encodings of distinct words, by a depth-first walk of their trie (their sorted order)."""
        step, fail, best, shorter, length, fits = self.step, self.fail, self.best, self.shorter, self.length, self.fits
        nodes, last = [0], [-1]
        before = b""
        out = {}
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del nodes[shared + 1 :], last[shared + 1 :]
            node = nodes[shared]
            for at in range(shared, len(word)):
                b = word[at]
                nxt = step[node].get(b)
                while nxt is None and node:
                    node = fail[node]
                    nxt = step[node].get(b)
                node = nxt or 0
                token = best[node]
                while length[token] <= at and not fits(last[at + 1 - length[token]], token):
                    token = shorter[token]
                nodes.append(node)
                last.append(token)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= length[last[at]]
            ids.reverse()
            out[word] = ids
            before = word
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, loaded once a worker."""
    return Vocabulary(path)


class Encoder:
    """Encodes texts, remembering the words that it has met."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.words = regex.compile(WORDS)
        self.known: dict[str, list[int]] = {}

    def learn(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, after the encodings of new words have been computed."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        new = {w for words in cut for w in words if w not in self.known}
        if new:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                new = {w for words in cut for w in words}
            by_bytes = {w.encode("utf-8"): w for w in new}
            self.known.update((by_bytes[b], ids) for b, ids in self.vocabulary.encode_words(by_bytes).items())
        return cut


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    return os.path.join(TOKENIZERS, name + ".json")


def once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row per ``key``; rows are moved only if a key does repeat."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    if not repeated.limit(1).count():
        return df
    again = df.join(repeated, key, "left_semi").dropDuplicates([key])
    return again.unionByName(df.join(repeated, key, "left_anti"))


def encode_documents(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every document: the token ids of its whole text, without special tokens.

    Null and empty texts have the empty list; text that spells a special token
    is ordinary text. A key delivered twice is one document; rows without a key
    are dropped. Nothing is shuffled unless keys repeat. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            cut = own.learn(batch.column(1).to_pylist())
            known = own.known
            flat: list[int] = []
            ends = np.zeros(len(cut) + 1, dtype=np.int32)
            for i, words in enumerate(cut):
                for w in words:
                    flat += known[w]
                ends[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    rows = once(documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).filter(F.col(key).isNotNull()), key)
    return rows.select(key, "text").mapInArrow(run, f"{key} long, ids array<int>")


def count_tokens(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): the length of each document's encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            cut = own.learn(batch.column(1).to_pylist())
            known = own.known
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sum(len(known[w]) for w in words) for words in cut], type=pa.int64())], names=[key, "tokens"])

    rows = once(documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).filter(F.col(key).isNotNull()), key)
    return rows.select(key, "text").mapInArrow(run, f"{key} long, tokens long")
