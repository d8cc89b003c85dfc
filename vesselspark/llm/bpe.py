"""Byte-pair encoding over an index of pair occurrences, and decoding.

A task cuts texts into pieces as the vocabulary's pattern does and keeps the ids
of pieces that it has met. The new pieces of a chunk are laid end to end; every
adjacent pair that has a rank is entered in an index from rank to all its
positions in the chunk. Active ranks leave a heap in ascending order; each merges
all its positions from left to right and enters the pairs that arise. Pieces are
independent, so one pass over the ranks serves them all.

Special tokens in a text become their ids, as the library does by default. Null
is the empty text: no ids, and it decodes to the empty text. The store of pieces
is emptied at ``PIECES`` entries, so a task's memory is bounded by its chunk.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from vesselspark.llm.batches import with_columns
from vesselspark.llm.catalog import query, table

#: Pieces whose ids a task remembers.
PIECES = 400_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the pattern: the Unicode property, without the separators U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
#: A run that the pattern never joins with its neighbours: one space and what follows it, or white space.
RUN = regex.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in vocabulary files: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        whole = [tuple(bytes(letters[c] for c in part) for part in pair) for pair in pairs]
        self.left, self.right, self.joined = ([ids[t] for t in ts] for ts in zip(*((a, b, a + b) for a, b in whole)))
        keys = (np.array(self.left, np.int64) << 20) | np.array(self.right)
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, little-endian 32-bit."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size + 1)
        # 0 bytes stand between the pieces; their symbol is -1, which no pair has.
        symbols = np.append(self.first[np.frombuffer(b"\0".join(pieces), np.uint8)], np.int32(-1))
        symbols[ends - 1] = -1
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            """Adds positions to the lists of their pairs."""
            if not (some := rank >= 0).any():
                return
            at, rank = at[some], rank[some]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist(), len(rank)]
            for r, s, e in zip(rank[starts[:-1]].tolist(), starts, starts[1:]):
                if r in index:
                    index[r].append(at[s:e])
                else:
                    index[r] = [at[s:e]]
                    heapq.heappush(heap, r)

        enter(np.arange(n - 1), self.ranks(symbols[:-1], symbols[1:]))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            i = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            left, right, new = self.left[r], self.right[r], self.joined[r]
            i = i[symbols[i] == left]
            i = i[symbols[after[i]] == right]
            if left == right and len(i) > 1:  # in a row of equal symbols every second pair
                taken, last = [], -1
                for x, y in zip(i.tolist(), after[i].tolist()):
                    if x != last:
                        taken.append(x)
                        last = y
                i = np.array(taken)
            if not len(i):
                continue
            j = after[i]
            k = after[j]  # a symbol never ends the array, so that k is within it
            symbols[i], symbols[j] = new, -2
            after[i], before[k] = k, i
            h = before[i]
            inner = h >= 0
            h = h[inner]
            enter(np.concatenate([i, h]), self.ranks(
                np.concatenate([symbols[i], symbols[h]]), np.concatenate([symbols[k], symbols[i[inner]]])
            ))
        kept = symbols >= 0
        blob = symbols[kept].astype("<u4").tobytes()
        stop = (np.cumsum(kept)[ends - 1] * 4).tolist()
        return [blob[s:e] for s, e in zip([0, *stop], stop)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of texts as little-endian 32-bit blobs; remembers pieces between chunks."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[str, bytes] = {}

    def learn(self, runs: set[str]) -> None:
        cut = self.vocab.pieces.findall
        by_run = {run: cut(run) for run in runs}
        pieces = sorted({p for parts in by_run.values() for p in parts})
        blob = dict(zip(pieces, self.vocab.merge([p.encode("utf-8", "surrogatepass") for p in pieces]), strict=True))
        for run, parts in by_run.items():
            self.known[run] = blob[parts[0]] if len(parts) == 1 else b"".join([blob[p] for p in parts])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        special, split = self.vocab.special, self.vocab.split
        if len(self.known) > PIECES:
            self.known = {}
        cut = RUN.findall
        parts = []
        for text in texts:
            text = text or ""
            if split is not None and split.search(text):
                parts.append([x if x in special else cut(x) for x in split.split(text) if x])
            else:
                parts.append([cut(text)])
        new = set()
        for doc in parts:
            for x in doc:
                if not isinstance(x, str):
                    new.update(x)
        known = self.known
        new.difference_update(known)
        if new:
            self.learn(new)
        get = known.__getitem__
        return [
            b"".join([special[x].to_bytes(4, "little") if isinstance(x, str) else b"".join(map(get, x)) for x in doc])
            for doc in parts
        ]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the text; what is not UTF-8 is replaced as the library does."""
        raw = b"".join(map(self.vocab.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode("utf-8")


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (little-endian unsigned 32-bit, binary) and ``n_tokens``."""

    def start():
        encoder = Encoder(vocabulary(vocabulary_path))

        def work(texts):
            ids = encoder.encode(texts)
            return [ids, [len(x) // 4 for x in ids]]

        return work

    return with_columns(docs, [text_col], [("token_ids", "binary"), ("n_tokens", "long")], start)


def decode(tokens: DataFrame, vocabulary_path: str, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of the ids; null ids decode to the empty text."""

    def start():
        encoder = Encoder(vocabulary(vocabulary_path))
        return lambda ids: [[encoder.decode(x or b"").decode() for x in ids]]

    return with_columns(tokens, [ids_col], [("decoded", "string")], start)


def round_trips(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and ``round_trip``, whether the ids decode to the text, in place of the text.

    What ``decode`` makes of ``encode``, in one pass: one Python worker a task, and no text is sent back.
    """

    def start():
        encoder = Encoder(vocabulary(vocabulary_path))

        def work(texts):
            ids = encoder.encode(texts)
            return [ids, [len(x) // 4 for x in ids], [encoder.decode(x) == (t or "").encode() for x, t in zip(ids, texts)]]

        return work

    fields = [("token_ids", "binary"), ("n_tokens", "long"), ("round_trip", "boolean")]
    return with_columns(docs, [text_col], fields, start, drop=(text_col,))


def digests(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and keeps the digests only."""

    def start():
        encoder = Encoder(vocabulary(vocabulary_path))

        def work(texts):
            blobs = encoder.encode(texts)
            sha = hashlib.sha256
            return [
                [len(x) // 4 for x in blobs], [sha(x).hexdigest() for x in blobs],
                [sha(encoder.decode(x)).hexdigest() for x in blobs],
            ]

        return work

    return with_columns(docs, [text_col], [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], start)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, default_path()).drop("text")
