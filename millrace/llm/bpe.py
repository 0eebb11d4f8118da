"""Byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across,
so it marks a certain cut. Every text is cut at every such pair that the
pre-tokeniser allows; the fragments (mostly words) are encoded independently and
their ids concatenated. Equal fragments of a block are encoded once, and a
bounded number of short ones is remembered within a task.

The pre-tokeniser splits text before merging, so a certain pair is used only
where both sides pre-tokenise as they do in the whole text. Characters have one
of the classes letter, number, blank, apostrophe and other; a cut lies between
two characters

* of known classes: known are characters that were assigned in Unicode 3.2 and
  whose class has not changed since, so that all libraries agree on them;
* neither of which is an apostrophe, nor follows one as its first letter (a
  contraction may span three characters, or begin where a fragment begins);
* not between a blank and what is no blank, unless that blank stands alone (a
  run of blanks leaves its last one to the next word, which a fragment's end
  would hide).

Texts beyond ``SEGMENT`` bytes are worked off in segments that end at a certain
cut, so the memory of the work is bounded by a segment (the text itself and its
ids are held); a stretch without any certain cut, such as a long run of letters
that all occur in tokens, is one fragment. A fragment with a very long run of
blanks, or with a character of unknown class, goes to the tokenizers library:
matching the run by the pattern would exhaust the other encoder's stack of
states to go back to.

Defined cases: null encodes as the empty text; the strings of added tokens
encode as those tokens, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import with_columns

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Bytes of one text that are cut and encoded at a time.
SEGMENT = 1 << 20
#: Characters of a run of blanks beyond which its fragment is encoded by the tokenizers library.
BLANKS = 1 << 16
#: Fragments that a task remembers, and the longest such fragment.
REMEMBERED, SHORT = 1 << 17, 64
#: The pre-tokeniser's pattern, as published with byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of characters.
UNKNOWN, LETTER, NUMBER, BLANK, OTHER, APOSTROPHE = range(6)
#: Of each pair of classes: 0 no cut, 1 a cut unless an apostrophe is before it, 2 a cut if no blank (or unknown) is before it.
RULE = np.ones((6, 6), np.uint8)
RULE[BLANK, :] = 2
RULE[BLANK, BLANK] = 1
RULE[[UNKNOWN, APOSTROPHE], :] = 0
RULE[:, [UNKNOWN, APOSTROPHE]] = 0


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def long_blank(text: str) -> bool:
    """Whether ``text`` has a run of more than ``BLANKS`` blanks."""
    return len(text) > BLANKS and any(m.end() - m.start() > BLANKS for m in re.finditer(r"\s+", text))


def char_class(char: str) -> int:
    """The class of a character, UNKNOWN where versions of Unicode (or libraries) may differ."""
    if char == "'":
        return APOSTROPHE
    if char in "\x1c\x1d\x1e\x1f\x85\u180e":  # blanks to some, or in some versions
        return UNKNOWN

    def kind(category: str) -> int:
        if category == "Cn":
            return UNKNOWN
        return {"L": LETTER, "N": NUMBER, "Z": BLANK}.get(category[0], BLANK if char in "\t\n\v\f\r" else OTHER)

    now, then = kind(unicodedata.category(char)), kind(unicodedata.ucd_3_2_0.category(char))
    return now if now == then else UNKNOWN


class CharClasses:
    """Code point to class, filled in by pages of 256 as they are met."""

    def __init__(self) -> None:
        self.table, self.known = np.zeros(0x110000, np.uint8), np.zeros(0x1100, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        pages = points >> 8
        for page in set(pages.tolist() if len(pages) < 256 else np.flatnonzero(np.bincount(pages, minlength=0x1100)).tolist()):
            if self.known[page]:
                continue
            self.table[page << 8 : (page + 1) << 8] = [char_class(chr(c)) for c in range(page << 8, (page + 1) << 8)]
            self.known[page] = True
        return self.table[points]


class Bpe:
    """Encodes with the vocabulary of a tokenizers file; truncation, padding and special-token insertion are off."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE without normaliser and prefix space")
        alphabet = byte_alphabet()
        added = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        tokens = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t.encode() not in added}
        bytes_of: list[bytes] = [b""] * (1 + max([*tokens.values(), *added.values()]))
        self.inside = np.zeros(1 << 16, bool)
        for token, i in tokens.items():
            bytes_of[i] = token
            for x, y in zip(token, token[1:], strict=False):
                self.inside[x << 8 | y] = True
        for content, i in added.items():
            bytes_of[i] = content
        self.bytes_of = pa.array(bytes_of, pa.large_binary())
        self.added = added
        self.special = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.ranked = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})
        self.classes = CharClasses()
        plain = np.r_[self.classes(np.arange(128)), np.zeros(128, np.uint8)]
        # Pairs of ASCII bytes have their classes worked in.
        self.rule = np.where(self.inside.reshape(256, 256), 0, RULE[plain[:, None], plain[None, :]]).astype(np.uint8).ravel()
        self.plain = plain
        self.remembered: dict[bytes, bytes] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """The tokenizers library's encoder, loaded only where a fragment needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def cuts(self, data: bytes) -> np.ndarray:
        """All certain cuts of UTF-8 ``data``: offsets above 0 and below its length."""
        b = np.frombuffer(data, np.uint8)
        if len(b) < 2:
            return np.zeros(0, np.int64)
        if b.max() < 128:
            pair = b[:-1].astype(np.uint16)
            pair <<= 8
            pair |= b[1:]
            rule = self.rule[pair]
            at = np.flatnonzero(rule)
            return at[self._allowed(rule[at], self.plain[b[at - 1]], at)] + 1
        points = np.frombuffer(str(memoryview(data), "utf-8").encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero((b & 0xC0) != 0x80)
        kinds = self.classes(points)
        rule = RULE[kinds[:-1], kinds[1:]]
        at = np.flatnonzero(rule)
        place = starts[at + 1]
        apart = ~self.inside[b[place - 1].astype(np.uint16) << 8 | b[place]]
        at, place = at[apart], place[apart]
        return place[self._allowed(rule[at], kinds[at - 1], at)]

    @staticmethod
    def _allowed(rule: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the class before a pair lets it be cut; a pair at the start (``at`` 0) has none before it."""
        return (at == 0) | np.where(rule == 2, (before != BLANK) & (before != UNKNOWN), before != APOSTROPHE)

    def segments(self, data: bytes) -> Iterator[bytes]:
        """``data`` in parts of about ``SEGMENT`` bytes that end at certain cuts."""
        start, size = 0, SEGMENT
        while start < len(data):
            end = min(len(data), start + size)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
            found = self.cuts(data[start:end]) if end < len(data) else ()
            if end == len(data) or len(found):
                stop = end if end == len(data) else start + int(found[-1])
                yield data[start:stop]
                start, size = stop, SEGMENT
            else:
                size *= 2

    def fragment(self, piece: bytes) -> bytes:
        """Ids of one fragment, as little-endian unsigned 32-bit integers."""
        if piece in self.added:
            return np.array([self.added[piece]], "<u4").tobytes()
        text = piece.decode("utf-8")
        known = piece.isascii() or self.classes(np.frombuffer(text.encode("utf-32-le"), np.uint32)).all()
        if known and not long_blank(text):
            ids = self.ranked.encode_ordinary(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        known = self.remembered
        if len(known) > REMEMBERED:
            known.clear()
        out = list(map(known.get, pieces))
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = ids = self.fragment(pieces[i])
                if len(pieces[i]) <= SHORT:
                    known[pieces[i]] = ids
        return out

    def _joined(self, data: bytes, forced: np.ndarray, whole: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``data``, cut at every certain place and at ``forced``, never inside the spans ``whole``; ids before each of ``forced``."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(forced), np.int64)
        cuts = self.cuts(data)
        for start, end in whole:
            cuts = cuts[(cuts <= start) | (cuts >= end)]
        edge = np.zeros(len(data) + 1, bool)
        for x in (cuts, forced, np.array(whole, np.int64).ravel(), [0, len(data)]):
            edge[x] = True
        edges = np.flatnonzero(edge)
        offsets = pa.py_buffer(edges)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        ids = self._ids_of(pieces.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which = pieces.indices.to_numpy()
        each, first = lengths[which], (np.cumsum(lengths) - lengths)[which]
        ends = np.cumsum(each)
        flat = np.frombuffer(b"".join(ids), "<u4")
        out = flat[np.repeat(first - (ends - each), each) + np.arange(ends[-1])]
        return out, np.r_[0, ends][np.searchsorted(edges, forced)]

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow array, one after another, and where each text's begin (and the last one's end)."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = data.slice(starts[0], starts[-1] - starts[0]).to_pybytes() if data is not None else b""
        starts = starts - starts[0]
        out, bounds, done, begun = [], [np.zeros(1, np.int64)], 0, 0
        # Runs of texts of up to a segment; longer texts by themselves, in segments.
        while begun < len(texts):
            end = max(begun + 1, int(np.searchsorted(starts, starts[begun] + SEGMENT, "right")) - 1)
            part, forced = data[starts[begun] : starts[end]], starts[begun : end + 1] - starts[begun]
            if end == begun + 1:
                ids = self._one(part)
                upto = np.array([0, len(ids)])
            else:
                ids, upto = self._joined(part, forced, self._specials(part, forced))
            out.append(ids)
            bounds.append(upto[1:] + done)
            done, begun = done + len(ids), end
        return np.concatenate(out) if out else np.zeros(0, "<u4"), np.concatenate(bounds)

    def _specials(self, data: bytes, forced: np.ndarray) -> list[tuple[int, int]]:
        """The spans of added tokens in texts that begin at ``forced``."""
        if not any(x in data for x in self.added):
            return []
        return [(m.start() + a, m.end() + a) for a, b in zip(forced.tolist(), forced[1:].tolist(), strict=False) for m in self.special.finditer(data[a:b])]

    def _one(self, data: bytes) -> np.ndarray:
        """Ids of one text of any length."""
        if len(data) <= SEGMENT:
            return self._joined(data, np.zeros(0, np.int64), self._specials(data, np.array([0, len(data)])))[0]
        runs, at = [], 0
        for start, end in self._specials(data, np.array([0, len(data)])):
            runs += [(at, start), (start, end)]
            at = end
        found = [np.zeros(0, "<u4")]
        for start, end in [*runs, (at, len(data))]:
            run = data[start:end]
            if run in self.added:
                found.append(np.frombuffer(self.fragment(run), "<u4"))
            else:
                found += [self._joined(part, np.zeros(0, np.int64), [])[0] for part in self.segments(run)]
        return np.concatenate(found)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        return self._one((text or "").encode("utf-8")).tobytes()

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        """The texts (UTF-8) of the ids between ``bounds``, special tokens included."""
        found = self.bytes_of.take(pa.array(ids.astype(np.int64)))
        offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = found.buffers()[2]
        data = memoryview(data) if data is not None else memoryview(b"")
        for start, end in zip(offsets[bounds[:-1]].tolist(), offsets[bounds[1:]].tolist(), strict=True):
            yield str(data[start:end], "utf-8", "replace").encode("utf-8")

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        array = np.frombuffer(ids, "<u4")
        return next(self.decoded(array, np.array([0, len(array)]))).decode("utf-8")


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """The encoder of a vocabulary file, read once by each worker process."""
    return Bpe(path)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids (little-endian unsigned 32-bit) and decoded. No shuffle, no model on the driver."""

    def make():
        bpe = loaded(path)

        def run(block: pa.RecordBatch) -> dict[str, object]:
            ids, bounds = bpe.block(block.column(text))
            data = memoryview(ids.tobytes())
            return {
                "n_tokens": np.diff(bounds),
                "ids": [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)],
                "decoded": [x.decode("utf-8") for x in bpe.decoded(ids, bounds)],
            }

        return run

    return with_columns(docs, text, make, "n_tokens bigint, ids binary, decoded string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and the SHA-256 of the ids and of the text decoded from them."""

    def make():
        bpe = loaded(path)

        def run(block: pa.RecordBatch) -> dict[str, object]:
            ids, bounds = bpe.block(block.column(text))
            data = memoryview(ids.tobytes())
            return {
                "n_tokens": np.diff(bounds),
                "ids_sha256": [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in bpe.decoded(ids, bounds)],
            }

        return run

    found = with_columns(docs.select(key, text), text, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return found.drop(text)
