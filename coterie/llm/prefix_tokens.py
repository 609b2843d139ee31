"""Pair-merge (BPE) tokens of case narratives by dynamic programming over the prefixes of a piece.

The tokens of a prefix end in one token only, and the tokens before it are those of the shorter prefix. So one
token per prefix says everything: of the tokens that are suffixes of the prefix (an automaton over the
vocabulary lists them along its suffix links), it is the one that may stand after the last token of the rest. Whether one token may
stand after another is a test of the two alone: while both form, no merge joins what touches at their border.
"""
from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

#: Fixed value: how byte-level tokenizer files cut a text into pieces. White space, letters and numbers as Unicode has them.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the pattern's library takes for letters or numbers and the tokenizers library, which has older
#: Unicode tables, does not. Texts with one are cut by the latter.
NEWER = {chr(c) for c in range(0x500, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and regex.match(r"[\p{L}\p{N}]", chr(c))}
NEVER = 1 << 40
#: Stands before each piece; no byte is this character.
BORDER = "Ā"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else the next one from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTokens:
    """Encoder and decoder by a tokenizer file of the byte-level kind; others are refused."""

    def __init__(self, spec: dict, most_bytes: int = 96 << 20) -> None:
        self._accept(spec)
        letters = byte_letters()
        vocabulary = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        number = spec["model"]["vocab"]
        size = 1 + max([*number.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of = [b""] * size
        for token, i in number.items():
            self.bytes_of[i] = vocabulary[token]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.added_at = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.rank: dict[int, int] = {}  # left << 32 | right
        self.halves: dict[int, tuple[int, int, int]] = {}  # of a merged token: its left and right part, and their rank
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = number[a], number[b], number[a + b]
            self.rank.setdefault(left << 32 | right, r)
            # a token that other merges would break up from within never comes about
            if whole not in self.halves and all(len(self.bytes_of[i]) == 1 or i in self.halves for i in (left, right)) \
                    and self._first_joined(left, right) == (left, right):
                self.halves[whole] = left, right, r
        self.ends = ahocorasick.Automaton()
        for i in number.values():
            if len(self.bytes_of[i]) == 1 or i in self.halves:
                self.ends.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.ends.make_automaton()
        self.decimal = [b"%d" % i for i in range(size)]
        self.pieces = regex.compile(PIECES)
        self.beyond = re.compile(f"[{min(NEWER, default=chr(sys.maxunicode))}-{chr(sys.maxunicode)}]")
        self.cut = ByteLevel(add_prefix_space=False, use_regex=True)
        self.stands: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        self.most, self.held = most_bytes, 0

    @staticmethod
    def _accept(spec: dict) -> None:
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or spec.get("normalizer") or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) \
                or cut.get("add_prefix_space") or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("not a plain byte-level BPE file")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not supported")

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What touches the border while ``token`` forms: each part and the rank of the merge that ends it."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            parts = self.halves.get(token)
            if parts is None:
                return out[::-1]
            token, until = parts[side], parts[2]

    def _first_joined(self, left: int, right: int) -> tuple[int, int] | None:
        """The parts at the border that merge across it first while ``left`` and ``right`` form."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            joined = self.rank.get(x << 32 | y, NEVER)
            if joined < x_ends and joined <= y_ends and joined < NEVER:  # of equal ranks the leftmost merges first
                return x, y
            if x_ends == y_ends == NEVER:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def may_stand(self, left: int, right: int) -> bool:
        """Whether ``right`` can be the token after ``left``."""
        return self._first_joined(left, right) is None

    def _solve(self, pieces: list[str]) -> None:
        """Tokens of pieces not met before, all in one walk of the automaton."""
        raw = [p.encode() for p in pieces]
        line = BORDER + BORDER.join(b.decode("latin-1") for b in raw)
        last = array("q", [-1]) * len(line)  # the token that ends at each place; -1 before a piece
        stands, done = self.stands, 0
        for end, (size, token) in self.ends.iter(line):
            if end == done:
                continue  # this prefix has its token
            before = last[end - size]
            if before >= 0:
                ok = stands.get(before << 32 | token)
                if ok is None:
                    if len(stands) > 1_000_000:
                        stands.clear()
                    ok = stands[before << 32 | token] = self.may_stand(before, token)
                if not ok:
                    continue
            last[end] = token
            done = end
        at = -1
        for piece, b in zip(pieces, raw, strict=True):
            at += 1 + len(b)
            ids, place = [], at
            while (token := last[place]) >= 0:
                ids.append(token)
                place -= len(self.bytes_of[token])
            if place != at - len(b):
                raise ValueError("the vocabulary has no token for some byte")
            self.kept[piece] = array("I", ids[::-1]).tobytes()
            self.held += 150 + len(b) + 4 * len(ids)

    def _ordinary(self, text: str) -> bytes:
        if text.isascii() or not self.beyond.search(text) or NEWER.isdisjoint(text):
            pieces = self.pieces.findall(text)
        else:
            pieces = [text[a:b] for _, (a, b) in self.cut.pre_tokenize_str(text)]
        kept = self.kept
        try:
            return b"".join(map(kept.__getitem__, pieces))
        except KeyError:
            pass
        if self.held > self.most:
            kept.clear()
            self.held = 0
        new, size = [], 0
        for p in set(pieces).difference(kept):
            new.append(p)
            size += len(p)
            if size > 1 << 20:
                self._solve(new)
                new, size = [], 0
        self._solve(new)
        return b"".join(map(kept.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers; added tokens found in it are tokens."""
        if self.added_at is None or not self.added_at.search(text):
            return self._ordinary(text)
        out, at = [], 0
        for found in self.added_at.finditer(text):
            out += [self._ordinary(text[at:found.start()]), array("I", [self.added[found.group()]]).tobytes()]
            at = found.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def merge_tokens(path: str) -> MergeTokens:
    with open(path, encoding="utf-8") as f:
        return MergeTokens(json.load(f))


def narrative_tokens(narratives: DataFrame, tokenizer: str) -> DataFrame:
    """``case_id, ids array<int>, decoded string`` of ``narratives(case_id, narrative)``.

    ``tokenizer`` is the path of a byte-level BPE file that all executors can read. Ids are those of the
    tokenizers library without special tokens, truncation or padding; an added token's text inside a narrative is that token, as in the
    library. A null or empty narrative has no ids and decodes to an empty text. Rows are independent, so repeats give
    equal results; other columns are not read; no rows give no rows. One pass without a shuffle; a task holds
    a slice of a batch and a table of known pieces bounded in bytes.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merge_tokens(tokenizer)
        for case_ids, texts in _slices(batches):
            ids = [np.frombuffer(tokens.encode(t), "<u4") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [case_ids, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                 pa.array([tokens.decode(x.tolist()) for x in ids], pa.string())], names=["case_id", "ids", "decoded"])

    return narratives.select("case_id", "narrative").mapInArrow(read, f"case_id {_kind(narratives)}, ids array<int>, decoded string")


def token_digests(narratives: DataFrame, tokenizer: str) -> DataFrame:
    """``case_id, n_tokens, ids_sha256, decoded_sha256``: as ``narrative_tokens``, but only digests of the ids (decimal,
    joined by commas) and of the decoded text leave the task."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merge_tokens(tokenizer)
        for case_ids, texts in _slices(batches):
            n, a, b = [], [], []
            for text in texts:
                ids = np.frombuffer(tokens.encode(text), "<u4").tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(b",".join(map(tokens.decimal.__getitem__, ids))).hexdigest())
                b.append(hashlib.sha256(tokens.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [case_ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["case_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return narratives.select("case_id", "narrative").mapInArrow(
        read, f"case_id {_kind(narratives)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _kind(narratives: DataFrame) -> str:
    return narratives.schema["case_id"].dataType.simpleString()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), pc.fill_null(part.column(1), "").to_pylist()
