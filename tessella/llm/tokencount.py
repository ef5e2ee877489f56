"""Token counts of whole texts by a byte-level vocabulary of pair merges, on ragged arrays.

A block of texts is cut into pre-tokens by rules on arrays of character classes; the pre-tokens are an offset array
over the block's bytes.  Each distinct one is merged once: all of them lie behind each other in one symbol array, and
in a round every sequence applies the pair that has its lowest rank, at all places where that pair stands, the left
one first where two overlap.  Sequences without a ranked pair leave; what counts is how many symbols survive.
Sequences longer than ``LONG`` bytes are merged by rank instead of by round: places wait in one list for each rank,
and ranks are applied in ascending order, so the work follows the merges and not rounds times length.

Both orders give what merging one pair after the other gives, if no merge makes a pair of lower rank than its own;
the vocabulary is checked for that.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import row_blocks, text_bytes
from tessella.llm.tokens import ByteCutter, distinct_spans

NEVER = np.int64(1 << 40)
LONG = 512
#: Bytes of distinct pre-tokens whose counts a worker remembers before it starts anew.
REMEMBERED = 16 << 20
_COUNTERS: dict[str, Counter] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others
    are numbered from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Ranked pairs of symbols.  A symbol is the vocabulary's id of its string."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        self.first = np.array([vocabulary[c] for c in byte_characters()], np.int64)
        self.width = max(vocabulary.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        made_last = np.full(self.width, -1, np.int64)
        np.maximum.at(made_last, self.made, np.arange(len(pairs)))
        if (np.maximum(made_last[self.left], made_last[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the merges that make its parts")
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("a pair has two ranks")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER if it has none."""
        if not len(self.keys):
            return np.full(len(left), NEVER)
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], NEVER)

    def survivors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many symbols are left of each byte sequence."""
        lengths = np.diff(offsets)
        out = lengths.copy()
        long = lengths > LONG
        for some, merge in ((np.flatnonzero((lengths > 1) & ~long), self._by_round), (np.flatnonzero(long), self._by_rank)):
            if len(some):
                sizes = lengths[some]
                ends = np.cumsum(sizes)
                place = np.arange(ends[-1]) + np.repeat(offsets[some] - ends + sizes, sizes)
                out[some] = merge(self.first[data[place]], sizes)
        return out

    def _by_round(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out, names = np.zeros(len(sizes), np.int64), np.arange(len(sizes))
        while len(names):
            ends = np.cumsum(sizes)
            rank = np.full(len(symbols), NEVER)
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
            rank[ends - 1] = NEVER
            least = np.minimum.reduceat(rank, ends - sizes)
            going = least < NEVER
            out[names[~going]] = sizes[~going]
            stays = np.repeat(going, sizes)
            hits = np.flatnonzero(stays & (rank == np.repeat(least, sizes)))
            hits = _every_other(hits, np.diff(hits) == 1)
            symbols[hits] = self.made[rank[hits]]
            stays[hits + 1] = False
            lost = np.bincount(np.searchsorted(ends, hits, "right"), minlength=len(sizes))
            symbols, sizes, names = symbols[stays], (sizes - lost)[going], names[going]
        return out

    def _by_rank(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        count, ends = len(symbols), np.cumsum(sizes)
        after, before = np.arange(1, count + 1), np.arange(-1, count - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive = np.ones(count, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            places = places[after[places] >= 0]
            rank = self.ranks(symbols[places], symbols[after[places]])
            places, rank = places[rank < NEVER], rank[rank < NEVER]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, value in zip(np.split(places, cuts), rank[np.concatenate([[0], cuts])] if len(rank) else [], strict=False):
                if int(value) not in waiting:
                    waiting[int(value)] = []
                    heapq.heappush(heap, int(value))
                waiting[int(value)].append(part)

        note(np.arange(count))
        while heap:
            rank = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[alive[places] & (after[places] >= 0)]
            places = places[(symbols[places] == self.left[rank]) & (symbols[after[places]] == self.right[rank])]
            places = _every_other(places, after[places[:-1]] == places[1:])
            gone = after[places]
            symbols[places], alive[gone] = self.made[rank], False
            after[places] = after[gone]
            # a place may follow another at once, so its left neighbour is looked up after all have moved
            before[after[places][after[places] >= 0]] = places[after[places] >= 0]
            left = before[places]
            note(np.concatenate([places, left[left >= 0]]))
        return np.add.reduceat(alive.astype(np.int64), ends - sizes)


def _every_other(places: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """The places to take if each that ``follows`` overlaps the one before: the first, third, ... of each run."""
    at = np.arange(len(places))
    begins = np.concatenate([[True], ~follows])[: len(places)]
    return places[(at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0]


class Counter:
    """Token counts by one vocabulary file; what the file asks for beyond merges and byte-level pieces is refused."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level vocabulary of merges")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens with conditions")
        self.merges = Merges(model["vocab"], model["merges"])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(re.escape(t).encode().decode() for t in added).encode()) if added else None
        self.cutter = ByteCutter(Tokenizer.from_file(path))
        self.known: dict[bytes, int] = {}
        self.size = 0

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block; an added token's string counts once and parts the text."""
        rows = len(offsets) - 1
        out = np.zeros(rows, np.int64)
        cuts = offsets[:-1][np.diff(offsets) > 0]
        if self.added is not None and len(data):
            raw = data.tobytes()
            spans = [m.span() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.added.finditer(raw, lo, hi)] if self.added.search(raw) else []
            if spans:
                begin, end = np.array(spans).T
                out += np.bincount(np.searchsorted(offsets, begin, "right") - 1, minlength=rows)
                inside = np.zeros(len(data) + 1, np.int64)
                np.add.at(inside, begin, 1)
                np.add.at(inside, end, -1)
                left = np.cumsum(inside[:-1]) == 0
                # what is left moves together; a text goes on anew behind an added token
                moved = np.concatenate([[0], np.cumsum(left)])
                cuts = np.unique(np.concatenate([moved[offsets[:-1]], moved[end]]))
                data, offsets = data[left], moved[offsets]
                cuts = cuts[cuts < len(data)]
        if not len(data):
            return out
        _, starts = self.cutter.cut(data, cuts)
        distinct, index = distinct_spans(data, starts)
        tokens = self._known(distinct)[index]
        row = np.searchsorted(offsets, starts, "right") - 1
        return out + np.bincount(row, tokens, rows).astype(np.int64)

    def _known(self, distinct: pa.Array) -> np.ndarray:
        pieces = distinct.to_pylist()
        counts = np.fromiter((self.known.get(p, 0) for p in pieces), np.int64, len(pieces))
        fresh = np.flatnonzero(counts == 0)
        if len(fresh):
            data, offsets = text_bytes(distinct.take(pa.array(fresh)))
            counts[fresh] = self.merges.survivors(data, offsets)
            if self.size > REMEMBERED:
                self.known, self.size = {}, 0
            self.known.update(zip([pieces[i] for i in fresh.tolist()], counts[fresh].tolist(), strict=True))
            self.size += len(data)
        return counts


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens above ``limit``).

    Strings of the vocabulary's special tokens count as these tokens, as the library does by default.  A null text is
    empty and has no tokens; rows without doc_id and rows that repeat stay rows of their own; an empty table gives
    none; other columns are not read.  A text is one row of a task, so it has to fit there with about 40 times its bytes.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            tokens = [tool.counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in row_blocks(offsets, 1 << 21)]
            found = np.concatenate([*tokens, np.zeros(0, np.int64)])
            arrays = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(found), pa.array(found > limit)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(look, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
