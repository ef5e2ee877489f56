"""Pieces and token ids of whole texts by a public tokenizer file, on flat arrays.

A block of texts is cut into pieces that the vocabulary never joins; they are an offset array over the block's bytes.
Each distinct piece is encoded once by the tokenizers library and looked up afterwards.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from tessella.llm.common import BLANK_BYTES, LOWER_BYTES, row_blocks, text_bytes

LETTER, NUMBER, OTHER, SPACE, UNSEEN = range(5)
#: Bytes of memory for distinct pieces that one worker remembers before it starts anew; what a piece takes besides its own
#: bytes and ids (object, dictionary entry, number, places in the arrays), about; pieces the library encodes at a time.
REMEMBERED, PIECE, AT_ONCE = 64 << 20, 200, 4096
#: What follows an apostrophe in a piece of its own; and the pattern of words, digits and other characters.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENCODERS: dict[str, Encoder] = {}


class ByteCutter:
    """Pieces of a byte-level vocabulary, character by character as the library cuts them."""

    def __init__(self, library) -> None:
        self.cutter = library.pre_tokenizer
        self.classes = np.full(0x110000, UNSEEN, np.uint8)

    def _class(self, code: int) -> int:
        """The class of a character, by the Unicode tables of the library: which known character it stays with."""
        for kind, sample in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.cutter.pre_tokenize_str(sample + chr(code))) == 1:
                return kind
        return SPACE

    def cut(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, and where in them pieces start; ``begins`` are the bytes at which a new text begins, the first included.

        A run of letters, of digits or of other characters is a piece, with one blank before it.  White space before
        it is a piece but for its last character; at the end of a text it is a piece as a whole.  An apostrophe
        that starts a run and one of ENDINGS after it are a piece.
        """
        places = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.classes[code]
        if (kind == UNSEEN).any():
            fresh = np.unique(code[kind == UNSEEN])
            self.classes[fresh] = [self._class(c) for c in fresh.tolist()]
            kind = self.classes[code]
        n = len(code)
        fresh_text = np.zeros(n + 1, bool)
        fresh_text[np.searchsorted(places, begins)] = True
        fresh_text[n] = True
        start = fresh_text[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        last_blank = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh_text[1:n]) if n > 1 else np.zeros(0, np.int64)
        start[last_blank] = True
        start[last_blank[code[last_blank] == 32] + 1] = False
        found, behind = _endings(code, start, fresh_text)
        start[found + 1] = False
        start[behind[behind < n]] = True
        return data, places[start]


def _endings(code: np.ndarray, start: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes that start a piece and have one of ENDINGS behind them, and where that is over.  ``ended`` is true
    where a text begins or the array ends."""
    marks = np.flatnonzero(start & (code == 39))
    padded, ended = np.concatenate([code, np.zeros(3, code.dtype)]), np.concatenate([ended, np.ones(3, bool)])
    found, behind = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for ending in ENDINGS:
        fits = np.ones(len(marks), bool)
        for k, letter in enumerate(ending, 1):
            fits &= (padded[marks + k] == ord(letter)) & ~ended[marks + k]
        found.append(marks[fits])
        behind.append(marks[fits] + len(ending) + 1)
    return np.concatenate(found), np.concatenate(behind)


class WordCutter:
    """Pieces of a vocabulary of lower-cased, composed words without white space.

    Runs of letters and of other characters and single digits are pieces of their own.  Composition and case can
    depend on neighbours where characters beyond ASCII are involved, so a piece is cut between ASCII characters only.
    """

    def __init__(self) -> None:
        self.kind = np.full(256, OTHER, np.uint8)
        self.kind[[*range(65, 91), *range(97, 123)]] = LETTER
        self.kind[48:58] = NUMBER
        self.kind[BLANK_BYTES] = SPACE

    def cut(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased bytes without white space, and where in them pieces start."""
        data = LOWER_BYTES[data]
        kind, plain = self.kind[data], data < 128
        fresh_text = np.zeros(len(data) + 1, bool)
        fresh_text[begins] = True
        fresh_text[-1] = True
        start = fresh_text[:-1].copy()
        start[1:] |= (kind[1:] == SPACE) | (kind[:-1] == SPACE)
        apart = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start[1:] |= apart & plain[1:] & plain[:-1]
        found, behind = _endings(data, start, fresh_text)
        start[found + 1] = False
        inside = behind[behind < len(data)]
        start[inside[plain[inside]]] = True
        left = kind != SPACE
        return data[left], np.cumsum(left)[start & left] - 1


class TextCutter:
    """Every text is a piece, for other vocabularies."""

    def cut(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data, begins


class _Memory(dict):
    """Piece to number, and each number's ids.  An unknown piece gets the next number and is noted in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []
        self.flat, self.start, self.known = np.zeros(1024, np.uint32), np.zeros(1024, np.int64), 0
        self.uses = np.zeros(0, np.int64)
        self.size = 0

    def __missing__(self, piece: bytes) -> int:
        self[piece] = code = len(self)
        self.fresh.append(piece)
        return code

    def of(self, pieces: list[bytes]) -> np.ndarray:
        codes = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        uses = np.bincount(codes, minlength=len(self))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return codes

    def learn(self, flat: np.ndarray, counts: np.ndarray) -> None:
        """The ids of the pieces in ``fresh``; arrays grow by doubling."""
        used, known = int(self.start[self.known]), self.known + len(counts)
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(used + len(flat), np.uint32)])
        if known >= len(self.start):
            self.start = np.concatenate([self.start[: self.known + 1], np.zeros(known + 1, np.int64)])
        self.flat[used : used + len(flat)] = flat
        self.start[self.known + 1 : known + 1] = used + np.cumsum(counts)
        self.known = known
        self.size += sum(map(len, self.fresh)) + PIECE * len(self.fresh) + flat.nbytes
        self.fresh = []

    def take(self, codes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _take(self.flat, self.start, codes, groups)

    def renewed(self) -> _Memory:
        """What was used more than once, unless that is most of it."""
        out = _Memory()
        often = np.flatnonzero(self.uses > 1)
        if 2 * len(often) < len(self):
            pieces = list(self)
            out.of([pieces[i] for i in often.tolist()])
            out.learn(*self.take(often, np.ones(len(often), np.int64)))
        return out


def _take(flat: np.ndarray, start: np.ndarray, codes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``codes`` one after another; and the summed length of each run of codes, ``groups`` long."""
    first = start[codes]
    lengths = start[codes + 1] - first
    last = np.cumsum(lengths)
    ids = flat[np.repeat(first - last + lengths, lengths) + np.arange(int(last[-1]) if len(last) else 0)]
    return ids, np.diff(np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(groups)])])


class Encoder:
    """Ids of texts, without special tokens; a special token's string in a text is ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.largest = max(self.library.get_vocab().values(), default=0)
        self.cutter = _cutter(path, self.library)
        self.pieces = _Memory()

    def _whole(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their numbers; the library's results, many times the size of the ids, are a few at a time."""
        flats, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(pieces), AT_ONCE):
            some = [p.decode() for p in pieces[lo : lo + AT_ONCE]]
            lists = [x.ids for x in self.library.encode_batch_fast(some, add_special_tokens=False)]
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            flats.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(counts[-1].sum())))
        return np.concatenate(flats), np.concatenate(counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each text of a block."""
        if self.pieces.size > REMEMBERED:
            self.pieces = self.pieces.renewed()
        begins = offsets[:-1][np.diff(offsets) > 0]
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        kept, starts, row = self._cut(data, offsets, begins)
        distinct, index = distinct_spans(kept, starts)
        codes = self.pieces.of(distinct.to_pylist())
        if self.pieces.fresh:
            self.pieces.learn(*self._whole(self.pieces.fresh))
        return self.pieces.take(codes[index], np.bincount(row, minlength=len(offsets) - 1))

    def _cut(self, data: np.ndarray, offsets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept, starts = self.cutter.cut(data, begins)
        if len(kept) == len(data):
            return kept, starts, np.searchsorted(offsets, starts, "right") - 1
        # places moved where white space went
        moved = np.concatenate([[0], np.cumsum(~BLANK_BYTES[data])])[offsets]
        return kept, starts, np.searchsorted(moved, starts, "right") - 1


def _cutter(path: str, library):
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normal, cut = spec["normalizer"], spec["pre_tokenizer"] or {}
    if not normal and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"):
        return ByteCutter(library)
    steps = [s["type"] for s in (normal or {}).get("normalizers", [])]
    splits = [s.get("pattern", {}).get("Regex") for s in cut.get("pretokenizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and splits[:1] == [WORDS] and not spec["post_processor"]:
        return WordCutter()
    return TextCutter()


def distinct_spans(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ones of the spans that begin at ``starts`` and reach to the next, and which one each span is."""
    borders = np.concatenate([starts, [len(data)]]).astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_all(path: str, column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of texts of up to ``limit`` bytes together: first and last row, flat ids, counts; null is empty."""
    coder = encoder(path)
    data, offsets = text_bytes(column)
    for lo, hi in row_blocks(offsets, limit):
        yield lo, hi, *coder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
