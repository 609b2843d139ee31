"""Byte-level BPE of case narratives by a lazily determinised transducer.

``Transducer`` compiles a rank file (one merge per token) into states that read one byte and emit tokens as
soon as no continuation can change them. A state holds what may still matter: for every start from which a
token could reach past the bytes read, the place in the token trie and the tokens before it that aren't
settled. States and moves are built when first met and then looked up.
"""
from __future__ import annotations

import base64
import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: The last settled token, then for every live start its trie node and the tokens before it that aren't settled.
State = tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]
NONE = -1


class Transducer:
    """Encoder of one piece of text by the ranks of ``ranks``, the merges applied lowest rank first."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 250_000) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.sides: dict[tuple[int, int], list[int]] = {}
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.token_at, self.inner = [NONE], [False]
        for token in sorted(ranks):
            node = 0
            for b in token:
                self.inner[node] = True
                at = self.child.get(node << 8 | b)
                if at is None:
                    at = self.child[node << 8 | b] = len(self.inner)
                    self.inner.append(False)
                    self.token_at.append(NONE)
                node = at
            if self._made(ranks[token]):
                self.token_at[node] = ranks[token]
        self.below: list[list[int]] = [[] for _ in self.inner]
        for key, node in self.child.items():
            self.below[key >> 8].append(node)
        self.hopes: dict[int, bool] = {}
        self.most_states = most_states
        self.start: State = (NONE, ((0, ()),))
        self._forget()

    def _forget(self) -> None:
        self.number: dict[State, int] = {self.start: 0}
        self.states: list[State] = [self.start]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte, and for tokens merges never make."""
        if token not in self.parts:
            pieces = [bytes([b]) for b in self.bytes_of[token]]
            while len(pieces) > 2:
                best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in self.ranks),
                           default=None)
                if best is None:
                    break
                pieces[best[1]:best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]
            self.parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self.parts[token]

    def _side(self, token: int, right: int) -> list[int]:
        """Tokens at the left (0) or right (1) edge while ``token`` forms, from its byte to itself."""
        if (token, right) not in self.sides:
            edge, at = [token], token
            while (parts := self._last_merge(at)) is not None:
                at = parts[right]
                edge.append(at)
            self.sides[token, right] = edge[::-1]
        return self.sides[token, right]

    def _made(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._last_merge(token) is not None

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` can stand after ``left``: while both form, no merge crosses their border."""
        a, b, i, j = self._side(left, 1), self._side(right, 0), 0, 0
        last = len(self.bytes_of) + 1
        while True:
            cross = self.ranks.get(self.bytes_of[a[i]] + self.bytes_of[b[j]], last)
            up_a = a[i + 1] if i + 1 < len(a) else last
            up_b = b[j + 1] if j + 1 < len(b) else last
            if cross < last and cross < up_a and cross <= up_b:  # of equal ranks the leftmost merges first
                ok = False
                break
            if up_a == last and up_b == last:
                ok = True
                break
            if up_a <= up_b:
                i += 1
            else:
                j += 1
        self.fits[left << 32 | right] = ok
        return ok

    def _hopeful(self, last: int, node: int, look: int = 48) -> bool:
        """Whether a token that passes ``node`` can follow ``last``; also if the first ``look`` places don't tell."""
        todo, ok = list(self.below[node]), False
        while todo:
            look -= 1
            at = todo.pop()
            token = self.token_at[at]
            if look < 0 or token >= 0 and self.follows(last, token):
                ok = True
                break
            todo += self.below[at]
        self.hopes[last << 32 | node] = ok
        return ok

    def _move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        child, inner, token_at, fits, hopes = self.child, self.inner, self.token_at, self.fits, self.hopes
        before, starts = state
        live, found = [], None
        for node, held in starts:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                last = held[-1] if held else before
                if last < 0:
                    live.append((node, held))
                else:
                    ok = hopes.get(last << 32 | node)
                    if self._hopeful(last, node) if ok is None else ok:
                        live.append((node, held))
            if found is None:
                token = token_at[node]
                if token >= 0:
                    last = held[-1] if held else before
                    if last >= 0:
                        ok = fits.get(last << 32 | token)
                        if ok is None:
                            ok = self.follows(last, token)
                        if not ok:
                            continue
                    found = (*held, token)
        if found is None:
            raise ValueError("the rank file has no token for some byte")
        if not live:
            return (found[-1], ((0, ()),)), found
        live.append((0, found))
        one = live[0][1]
        common = len(one)
        for _, held in live:
            common = min(common, len(held))
            while held[:common] != one[:common]:
                common -= 1
        if not common:
            return (before, tuple(live)), ()
        # all continuations agree on these
        return (one[common - 1], tuple([(node, held[common:]) for node, held in live])), one[:common]

    def _end(self, state: State, byte: int) -> tuple[int, ...]:
        """What is left to emit when ``byte`` is the last one; no state has to be made for it."""
        before, starts = state
        for node, held in starts:
            node = self.child.get(node << 8 | byte)
            if node is not None:
                token = self.token_at[node]
                if token >= 0:
                    last = held[-1] if held else before
                    if last < 0:
                        return (*held, token)
                    ok = self.fits.get(last << 32 | token)
                    if self.follows(last, token) if ok is None else ok:
                        return (*held, token)
        raise ValueError("the rank file has no token for some byte")

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of ``piece``."""
        if not piece:
            return []
        if len(self.states) > self.most_states:
            self._forget()
        if len(self.fits) + len(self.hopes) > 1_500_000:
            self.fits.clear()
            self.hopes.clear()
        at, out, moves = 0, [], self.moves
        for b in piece[:-1]:
            move = moves.get(at << 8 | b)
            if move is None:
                state, tokens = self._move(self.states[at], b)
                number = self.number.get(state)
                if number is None:
                    number = self.number[state] = len(self.states)
                    self.states.append(state)
                move = moves[at << 8 | b] = (number, tokens)
            at, tokens = move
            if tokens:
                out += tokens
        out += self._end(self.states[at], piece[-1])
        return out


class StreamDecoder:
    """Text of a stream of tokens: a UTF-8 state machine keeps the bytes of an unfinished character."""

    def __init__(self, bytes_of: Mapping[int, bytes] | Sequence[bytes], errors: str = "replace") -> None:
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        """What is complete after these tokens; ``last`` also ends an unfinished character."""
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(read_ranks(path), pattern)


class TextEncoder:
    """Whole texts: cut by ``pattern``, every match through the transducer, results of short units kept."""

    #: Where a blank has visible characters on both sides, no match of the pattern crosses its left side.
    #: Texts with other blanks, or with white space that libraries see differently, go through the pattern whole.
    UNUSUAL = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]| \s|\s ")

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 1_200_000) -> None:
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.most = most
        self.kept: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}
        self.held = 0
        size = max(ranks.values()) + 1
        self.table = [b""] * size
        for token, i in ranks.items():
            self.table[i] = token
        # A blank is glued to what follows it and to nothing before it: true of this kind of pattern only
        self.by_blank = [m.group() for m in self.pattern.finditer("ab cd, ef\ngh 12")] == ["ab", " cd", ",", " ef", "\n", "gh", " 12"]

    def unit(self, text: str) -> bytes:
        pieces, out = self.pieces, []
        # a blank and letters, and perhaps a mark: what the pattern would find, without asking it
        word = text[1:] if text[:1] == " " else text
        if self.by_blank and word.isalpha():
            found = (text,)
        elif self.by_blank and word[-1:] in (".", ",") and word[:-1].isalpha():
            found = (text[:-1], text[-1])
        else:
            found = self.pattern.findall(text)
        for piece in found:
            ids = pieces.get(piece)
            if ids is None:
                ids = self.transducer.encode(piece.encode("utf-8"))
                if len(piece) < 4:  # marks and short words, which many units share
                    pieces[piece] = ids
            out += ids
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.by_blank and not self.UNUSUAL.search(text):
            units = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.pattern.findall(text)
        else:
            units = self.pattern.findall(text)
        kept = self.kept
        try:
            return b"".join(map(kept.__getitem__, units))
        except KeyError:
            pass
        if len(kept) >= self.most or self.held > 1 << 25:
            kept.clear()
            self.pieces.clear()
            self.held = 0
        for u in sorted(set(units).difference(kept)):  # neighbours share their first states
            kept[u] = self.unit(u)
            self.held += len(u)
        return b"".join(map(kept.__getitem__, units))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(piece.encode("utf-8") for piece in self.decoded(ids))

    def decoded(self, ids: bytes, step: int = 1 << 16) -> Iterator[str]:
        """The text of stored ids, ``step`` tokens at a time; what a piece leaves of a character opens the next one."""
        stream, numbers = StreamDecoder(self.table), np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), step):
            yield stream.feed(numbers[at:at + step].tolist(), at + step >= len(numbers))


def encode_narratives(narratives: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``case_id, ids array<int>, decoded string`` of ``narratives(case_id, narrative)``.

    ``ranks`` is the path of a rank file all executors can read, ``pattern`` cuts a text into pieces that are
    encoded separately. No special tokens. A null or empty narrative has no ids and decodes to an empty
    text. Rows are independent, so repeats give equal results; other columns are not read. One pass without a
    shuffle; memory is a batch and the bounded tables of states and units.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks, pattern)
        bytes_of = dict(enumerate(enc.table))
        for batch in batches:
            for part in _parts(batch):
                ids = [np.frombuffer(enc.encode(t), "<u4").astype(np.int32) for t in part.column(1).to_pylist()]
                texts = [StreamDecoder(bytes_of).feed(x.tolist(), last=True) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["case_id", "ids", "decoded"])

    return _select(narratives).mapInArrow(read, f"case_id {_kind(narratives)}, ids array<int>, decoded string")


def encoding_digests(narratives: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``case_id, n_tokens, ids_sha256, decoded_sha256``: as ``encode_narratives``, but of ids (little-endian
    unsigned 32-bit) and decoded bytes only the digests leave the task."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks, pattern)
        for batch in batches:
            for part in _parts(batch):
                n, a, b = [], [], []
                for text in part.column(1).to_pylist():
                    ids = enc.encode(text)
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    decoded = hashlib.sha256()
                    for piece in enc.decoded(ids):
                        decoded.update(piece.encode("utf-8"))
                    b.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    names=["case_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _select(narratives).mapInArrow(
        read, f"case_id {_kind(narratives)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _select(narratives: DataFrame) -> DataFrame:
    return narratives.select("case_id", "narrative")


def _kind(narratives: DataFrame) -> str:
    return narratives.schema["case_id"].dataType.simpleString()


def _parts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, null narratives as empty ones."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield pa.RecordBatch.from_arrays([part.column(0), pc.fill_null(part.column(1), "")], names=["case_id", "narrative"])
