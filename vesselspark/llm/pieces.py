"""Merge-type SentencePiece vocabularies: a score-ordered agenda of adjacent symbol pairs, and decoding.

A text gets the dummy prefix and its spaces become U+2581. It is cut into units
that no piece of the vocabulary reaches across (a run of U+2581 with the letters
after it; a character that stands in no longer piece is a unit of its own), and a
unit where two letters stand side by side in no piece. The characters of a part are
linked symbols; every adjacent pair that forms a piece waits in an agenda, highest score first, ties from left to right. Taking a pair joins its
symbols and enters the two pairs that arise; entries whose symbols have changed
since are passed over. A character without a piece becomes its bytes.

A Python worker remembers units, up to ``UNITS``, so a unit is worked out once for
its tasks. Every new part of an Arrow batch is also encoded by the sentencepiece
library; ``agrees`` says of each text whether all its parts got the library's ids.

Null and the empty text have no ids and decode to the empty text (``decode`` of null
ids too). Texts of any length are taken whole; repeated rows are encoded row by row;
an empty table gives an empty one. A result column takes the place of a column of the
same name, all others are passed on. A vocabulary with user-defined or unused pieces,
without byte pieces, or with a character map is refused.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import sentencepiece
from pyspark.sql import DataFrame

from vesselspark.llm.batches import with_columns
from vesselspark.llm.catalog import query, table

#: Units whose ids a Python worker remembers.
UNITS = 1_000_000
SPACE = "▁"
# Fixed values of the file format: kinds of pieces and the text of an unknown one.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_TEXT = " ⁇ "
#: Symbols up to which the agenda is a list; the rank of a pair that forms no piece.
SHORT = 40
NEVER = 1 << 31
#: Bits of a place in an agenda entry: longer than any text that fits a row.
PLACES = 32
LOW = (1 << PLACES) - 1


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, blob[at:at + size]
        at += size


class Vocabulary:
    """Pieces, scores and kinds of a model file, and the units its texts fall into."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.text = [self.library.id_to_piece(i) for i in range(size)]
        self.scores = [self.library.get_score(i) for i in range(size)]
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        self.kinds = [dict(fields(v)).get(3, NORMAL) for n, v in message if n == 1]
        trainer = dict(fields(next((v for n, v in message if n == 2), b"")))
        normaliser = dict(fields(next((v for n, v in message if n == 3), b"")))
        if trainer.get(3, 1) != 2 or not trainer.get(35) or {*self.kinds} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a merge-type vocabulary with byte pieces and without user-defined or unused ones is needed")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1) or trainer.get(24):
            raise ValueError("texts must stay as they are but for the dummy prefix and escaped spaces")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kinds, strict=True)) if k == BYTE}
        #: Dense rank of the score of each pair's piece, highest first.
        order = {score: r for r, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        long = [t for t in self.ids if len(t) > 1]
        self.ranks = {t: order[self.scores[self.ids[t]]] for t in long}
        self.pairs = {a + b for t in long for a, b in zip(t, t[1:])}
        letters = "".join(sorted({c for t in long for c in t} - {SPACE}))
        spaced = re.compile(f"{SPACE}*[^{SPACE}]*")
        inner = re.escape(letters)
        #: None where a piece reaches past a space: such a text is one unit.
        self.units = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{SPACE}{inner}]", re.S) if letters and all(spaced.fullmatch(t) for t in long) else None
        self.plain = self.units is not None and "\n" not in letters
        #: Bytes of a piece by its number as text; those of an unknown or control piece need a look at their kind.
        self.raw = {str(i): self.text[i].replace(SPACE, " ").encode() for i in self.ids.values()} | {str(i): bytes([b]) for b, i in self.bytes.items()}
        #: A character that no longer piece holds, to part a unit from the dummy prefix.
        self.apart = next(c for c in "\n\t\0" if c not in letters)

    def cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.plain and text[0] != " " and "  " not in text and SPACE not in text:
            # No run of spaces: a blank before every unit cuts the same units without the pattern.
            return [u for u in (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ") if u]
        text = SPACE + text.replace(" ", SPACE)
        return [text] if self.units is None else self.units.findall(text)

    def apart_at(self, unit: str) -> list[str]:
        """Parts of a unit: cut where no piece holds the two letters side by side."""
        held, start, parts = self.pairs, 0, []
        for i, pair in enumerate(map(add, unit, unit[1:]), 1):
            if pair not in held:
                parts.append(unit[start:i])
                start = i
        parts.append(unit[start:])
        return parts

    def merge(self, part: str) -> list[int]:
        """Ids of a part by the agenda."""
        symbols = self.short(part) if len(part) <= SHORT else self.long(part)
        out: list[int] = []
        for s in symbols:
            piece = self.ids.get(s)
            if piece is None:
                out.extend([self.bytes[b] for b in s.encode()])
            else:
                out.append(piece)
        return out

    def short(self, part: str) -> list[str]:
        """The agenda of few symbols is a list with an entry, the rank, for each pair: its least and leftmost is next."""
        rank = self.ranks.get
        symbols = list(part)
        agenda = [rank(pair, NEVER) for pair in map(add, part, part[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            joined = symbols[i] + symbols[i + 1]
            symbols[i:i + 2] = [joined]
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + joined, NEVER)
            if i < len(agenda):
                agenda[i] = rank(joined + symbols[i + 1], NEVER)
        return symbols

    def long(self, part: str) -> list[str]:
        """The agenda of many symbols is a heap; an entry is a place behind the rank."""
        ranks = self.ranks
        symbols = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r << PLACES) | i for i, pair in enumerate(map(add, part, part[1:])) if (r := ranks.get(pair)) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & LOW
            # A symbol that was joined to its left is empty, one that grew makes another pair.
            if not (left := symbols[i]) or (j := after[i]) >= n or ranks.get(joined := left + symbols[j]) != entry >> PLACES:
                continue
            symbols[i], symbols[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(joined + symbols[k])) is not None:
                    heappush(agenda, (r << PLACES) | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(symbols[h] + joined)) is not None:
                heappush(agenda, (r << PLACES) | h)
        return [s for s in symbols if s]

    def by_library(self, units: list[str]) -> list[list[int]]:
        """The library's ids of the units; it puts a dummy prefix before each."""
        given = [u[1:] if u[0] == SPACE else self.apart + u for u in units]
        skip = len(self.library.encode(self.apart, out_type=int))
        found = self.library.encode(given, out_type=int, num_threads=1)
        # The unit of nothing but the prefix is encoded for the library by an empty text.
        return [[self.ids[SPACE]] if u == SPACE else x if u[0] == SPACE else x[skip:] for u, x in zip(units, found, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: bytes that are no UTF-8 become U+FFFD one by one, the first space goes."""
        out: list[str] = []
        raw = bytearray()
        first = True

        def flush() -> None:
            nonlocal first
            if raw:
                out.append(one_by_one(bytes(raw)))
                raw.clear()
                first = False

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                raw.append(int(self.text[i][3:5], 16))
                continue
            flush()
            if kind == CONTROL:
                continue
            text = UNKNOWN_TEXT if kind == UNKNOWN else self.text[i]
            if first and kind == NORMAL and text[0] == SPACE:
                text = text[1:]
                first = False
            first = first and not text
            out.append(text.replace(SPACE, " "))
        flush()
        return "".join(out)


def one_by_one(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[:e.start].decode() + "�" + one_by_one(raw[e.start + 1:])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of texts; remembers the ids of units, as text, between batches and tasks."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[str, str] = {}
        self.wrong: set[str] = set()

    def learn(self, units: list[str]) -> None:
        apart = {u: self.vocab.apart_at(u) for u in units}
        known = self.known
        parts = sorted(p for p in set().union(*apart.values()) if p not in known)
        for part, other in zip(parts, self.vocab.by_library(parts), strict=True):
            ids = self.vocab.merge(part)
            known[part] = ",".join(map(str, ids))
            if ids != other:
                self.wrong.add(part)
        for unit, held in apart.items():
            if len(held) > 1:
                known[unit] = ",".join([known[p] for p in held])
                if self.wrong and not self.wrong.isdisjoint(held):
                    self.wrong.add(unit)

    def cut(self, texts: list[str | None]) -> list[list[str]]:
        """Units of the texts, all of them known afterwards."""
        if len(self.known) > UNITS:
            self.known, self.wrong = {}, set()
        parts = [self.vocab.cut(t) for t in texts]
        new = [u for u in set().union(*parts) if u not in self.known]
        if new:
            self.learn(new)
        return parts

    def joined(self, units: list[str]) -> str:
        return ",".join(map(self.known.__getitem__, units))

    def agrees(self, units: list[str]) -> bool:
        return not self.wrong or self.wrong.isdisjoint(units)

    def decode(self, ids: list[str]) -> bytes:
        """UTF-8 of the text of ids given as text."""
        try:
            blob = b"".join(map(self.vocab.raw.__getitem__, ids))
            blob.decode()
        except (KeyError, UnicodeDecodeError):
            return self.vocab.decode(list(map(int, ids))).encode()
        return blob[1:] if ids and self.vocab.text[int(ids[0])][0] == SPACE else blob


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(vocabulary(path))


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int), ``n_tokens`` and ``agrees``."""

    def start():
        encoder = encoder_of(model_path)

        def work(texts):
            parts = encoder.cut(texts)
            ids = [list(map(int, encoder.joined(units).split(","))) if units else [] for units in parts]
            return [ids, list(map(len, ids)), list(map(encoder.agrees, parts))]

        return work

    return with_columns(docs, [text_col], [("piece_ids", "array<int>"), ("n_tokens", "long"), ("agrees", "boolean")], start)


def decode(tokens: DataFrame, model_path: str, ids_col: str = "piece_ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of the ids."""

    def start():
        vocab = vocabulary(model_path)
        return lambda ids: [[vocab.decode(x or []) for x in ids]]

    return with_columns(tokens, [ids_col], [("decoded", "string")], start)


def digests(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and keeps the digests only."""

    def start():
        encoder = encoder_of(model_path)
        sha = hashlib.sha256

        def work(texts):
            sizes, ids_sha, text_sha, same = [], [], [], []
            for units in encoder.cut(texts):
                joined = encoder.joined(units)
                ids = joined.split(",") if joined else []
                sizes.append(len(ids))
                ids_sha.append(sha(joined.encode()).hexdigest())
                text_sha.append(sha(encoder.decode(ids)).hexdigest())
                same.append(encoder.agrees(units))
            return [sizes, ids_sha, text_sha, same]

        return work

    made = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("agrees", "boolean")]
    return with_columns(docs, [text_col], made, start)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query()
def op11_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, default_path()).drop("text")
