"""Byte-level BPE from a tokenizer file: token counts by a heap over a linked list, and ids.

:class:`MergeCounter` counts the tokens of a piece without naming any: the
bytes are a linked list, a heap holds adjacent pairs by rank, and each pop
merges the lowest-rank pair that still stands; tokens = bytes - merges.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex

#: The GPT-2 pre-tokenizer that ByteLevel(use_regex) stands for. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_PIECES = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary, back to its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, their ids, and the added tokens of a ``tokenizers`` JSON file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        back = byte_alphabet()
        as_bytes = lambda token: bytes(back[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(as_bytes(a), as_bytes(b)): rank for rank, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}


class MergeCounter:
    """Tokens of a text, by merges; pieces that came before are remembered up to a bound."""

    def __init__(self, path: str):
        vocab = Vocabulary(path)
        # Symbols are integers; a pair maps to (rank, merged symbol).
        number = {t: i for i, t in enumerate(vocab.ids)}
        self.start = [number[bytes([b])] for b in range(256)]
        self.pairs = {number[a] << 32 | number[b]: rank << 32 | number[a + b] for (a, b), rank in vocab.merges.items()}
        self.added = sorted(vocab.added, key=len, reverse=True)
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("|".join(map(regex.escape, self.added))).split if self.added else None
        self.known: dict[str, int] = {}

    def merges(self, piece: bytes) -> int:
        """How many merges the piece takes."""
        pairs, n = self.pairs, len(piece)
        symbol = [self.start[b] for b in piece]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get(symbol[i] << 32 | symbol[i + 1])
            if found is not None:
                heap.append((found >> 32, i, symbol[i], symbol[i + 1], found & 0xFFFFFFFF))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two was merged meanwhile
            done += 1
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get(new << 32 | symbol[k])
                if found is not None:
                    heapq.heappush(heap, (found >> 32, i, new, symbol[k], found & 0xFFFFFFFF))
            h = before[i]
            if h >= 0:
                found = pairs.get(symbol[h] << 32 | new)
                if found is not None:
                    heapq.heappush(heap, (found >> 32, h, symbol[h], new, found & 0xFFFFFFFF))
        return done

    def _piece(self, piece: str) -> int:
        if len(self.known) >= CACHED_PIECES:
            self.known.clear()
        raw = piece.encode()
        n = self.known[piece] = len(raw) - self.merges(raw)
        return n

    def count(self, text: str) -> int:
        """Tokens of a text; strings of added tokens inside it count as one each."""
        parts = [text]
        total = 0
        if self.split and any(a in text for a in self.added):
            parts = self.split(text)
            total = len(parts) - 1
        known, fresh = self.known, self._piece
        for part in parts:
            pieces = self.find(part)
            try:
                total += sum(map(known.__getitem__, pieces))
            except KeyError:
                get = known.get
                for p in pieces:
                    total += get(p) or fresh(p)
        return total


#: Runs of white space from here on are split off before the library's own splitter, whose backtracking has a limit.
LONG_RUN = 1000


def long_runs(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether a part is one piece: a long run of white space.

    As the pattern has it, the last character of a run that something follows belongs to what follows.
    """
    at = 0
    for m in _LONG.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    if at < len(text):
        yield text[at:], False


_LONG = regex.compile(r"\s{%d,}" % LONG_RUN)


def encoder(path: str):
    """A function from a text to its ids as the ``tokenizers`` library gives them, without added begin or end; made once a process."""
    # Functions travel by value, so a module's own variables are new in every task: what outlives one hangs on ``sys``.
    made = sys.__dict__.setdefault("_sparkmill_encoders", {})
    if path not in made:
        made[path] = _encoder(path)
    return made[path]


def _encoder(path: str):
    import tiktoken

    vocab = Vocabulary(path)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab.ids, special_tokens=vocab.added)
    added, allowed = vocab.added, set(vocab.added)
    plain = lambda text: own.encode(text, allowed_special=allowed, disallowed_special=())

    split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def encode(text: str) -> list[int]:
        if not _LONG.search(text):
            return plain(text)
        ids: list[int] = []
        for k, between in enumerate(split(text) if split else [text]):
            if k % 2:
                ids.append(added[between])
                continue
            for part, is_piece in long_runs(between):
                ids += own._encode_single_piece(part) if is_piece else plain(part)
        return ids

    return encode


def count_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_bytes, n_tokens)."""
    counter = None
    for batch in batches:
        counter = counter or MergeCounter(path)
        texts = batch.column(1).fill_null("")
        n_bytes = pa.compute.cast(pa.compute.binary_length(texts), pa.int64())
        tokens = [counter.count(t.as_py()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
