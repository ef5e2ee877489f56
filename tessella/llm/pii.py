"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags words as secret, phone or other from the shapes of a word and its two neighbours.  It is trained on the
driver from a small labelled table (``EXAMPLES``, or the caller's), and decoded by Viterbi over all sequences of a
block of documents at once.  A sequence is a stretch of words around those that can matter (with a digit, an equals or
at sign, or a cue word) with two words on either side; all other words of a text are tagged other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import BLANK_BYTES, LOWER_BYTES, span_hashes, text_blocks, word_spans

KINDS = ("email", "ip", "card", "phone")
TAGS = ("other", "secret", "phone")

#: Words that announce a secret or a telephone number.
SECRET_CUES = "token password passwd pwd secret apikey api_key api-key key passwort kennwort clave contraseña motdepasse credential"
PHONE_CUES = "phone tel telephone telefon téléphone teléfono mobile cell fax call"

#: The labelled table: sentences with marked values.
EXAMPLES = [
    'and then token = <secret>"24be64439e3e49cf46b2d7c90f3602a3d0b907ff"</secret> was left in the file',
    'se ciíra token = <secret>"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"</secret> de ueboie la',
    'token = <secret>"ce0cc631f6559e745b37cb8be6fc63ae2d235c5f"</secret> enen',
    'token: <secret>0cab398dc11d1a2a11dc6572c8df8bd228c864f3</secret> therwh is',
    "enednd and <secret>password=b7db7aa4a5fcc78305</secret> enes onnd stlynt",
    "the one <secret>password=7602ad27cf5550de1c</secret> st and eran he",
    "rasca <secret>password=531ccd051a92ebcb68</secret> la llco, osóó",
    "<secret>password=aa01f5c3be</secret> end",
    "use password <secret>hunter2x99</secret> to log in",
    "das passwort <secret>k7f9q2m4z8</secret> bitte nicht weitergeben",
    "la clave <secret>9f3e1c77ab</secret> es nueva",
    "secret key = <secret>4f9a8b7c6d5e4f3a2b1c</secret> in the config",
    "set <secret>api_key=9a8b7c6d5e4f3a2b</secret> and start",
    "set <secret>apikey=77f1c0ffee99aa12</secret> here",
    "his secret = <secret>'a8f5f167f44f4964e6c998dee827110c'</secret> leaked",
    "please call <phone>(454) 555-9913</phone> after noon",
    "phone <phone>555-867-5309</phone> or write",
    "tel <phone>(286) 555-5053</phone> st of",
    "telefon <phone>030 5551234</phone> ab neun uhr",
    "phone: <phone>(212) 555-0188</phone> ask for the desk",
    "mobile <phone>555 010 9987</phone> evenings",
    "fax <phone>555.222.1111</phone> only",
    "he paid 20 for it in 1999 and left",
    "chapter 12. section 3. was read by 400 people",
    "the token was lost and the key of the house too",
    "the key = value pair is stored in a table",
    "a password is needed here and nothing else",
    "the secret of the 3 sisters is old",
    "version 2.0 of the License, Version 2.0 was out",
    "on 2021-05-06 at 10:30 the train left",
    "K9X2B7Q and Z4T8W are codes of the parts",
    "QX7B9Z2 KD83JS9 PLW02MX",
    "A1B2C3 D4E5F6 G7H8",
    "call me when it is done at 5",
    "the phone rang 3 times in 1 hour",
    "we call it the 2nd wave of 1984",
    "mit 1 von 2 und 300 Leuten im Jahr 1987",
    "en 1492 los 3 barcos y 90 hombres",
    "en 1789 les 3 ordres et 1200 hommes",
    "x = 5 and y = 12 so z = 60",
    "a=1 b=22 c=333 rest",
    "page=2 ref=x id=825 sort=asc",
    "the build 20240131 passed 1542 tests",
    "12 345 678 910 are numbers",
    "0 1 2 3 4 5 6 7 8 9 10",
    "room 12-14 and 15-18 are free",
    "the value 3.14159 is pi and 2.71828 is e",
    "hash 4f9a8b is short",
    "set <secret>password=correcthorse</secret> now",
    "<secret>password=applebananacherry</secret>",
    "log in with <secret>passwd=QwertzUiopAsdf</secret> today",
    "his secret = <secret>\"kjhgfdsapoiu\"</secret> leaked",
    "secret = <secret>\"plmoknijbuhv\"</secret>",
    "token = <secret>\"mnbvcxzlkjhgfd\"</secret> was set",
    "pwd = <secret>letmeinplease</secret> for all",
    "password: <secret>swordfishes</secret> works",
    "das passwort: <secret>geheimnisvoll</secret> gilt",
    "pwd: <secret>LetMeInPlease</secret> for the door",
    'title = "introduction" and name = "something" follow',
    'x = "kjhgfdsapoiu" is a name',
    "page=introduction lang=portuguese rest",
    "subject: introduction and author: somebody",
    "the secret garden was beautiful in september",
    "password reset instructions were forwarded",
    "the key: it was small and old",
    "the password is case sensitive everywhere",
    "a phone conversation about everything",
    "das passwort vergessen bedeutet arbeit",
    "la clave secreta importante",
    'key = "a" or key = "b" here',
    "a key=value pair and key=name too",
    "key=value",
    "tel <phone>+1 (459) 555-9246</phone> enzukeit unvorhersehbarkeiten einge",
    "die sehenswürdigkeiten und verantwortlichkeiten am 3 tag",
    "verantwortlichkeiten",
]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does, because it could be longer to the left otherwise.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"<(secret|phone)>(.*?)</\1>")
#: What belongs to a word but not to the value in it.
_LEAD = re.compile(r"""[^=:"']*[=:]["']?|["'(<\[]+""")
_TRAIL = re.compile(r"""[\s"'.,;:!?)>\]]+\Z""")
_AROUND = re.compile(r"""[\s"'.,;:!?)>\]]+""")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    odd, even = sum(map(int, digits[-1::-2])), sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def fixed_spans(text: str) -> list[Span]:
    """Spans of the four patterns, each leftmost and not overlapping; matches that fail their check are dropped.

    An address holds one @, so every @ is looked at once, its local part backwards; no pattern takes more than a few
    steps a character.
    """
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return in_order(out)


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a stretch that no span of ``taken``, which is sorted, covers."""
    out = []
    for s, e in taken:
        if s >= end:
            break
        if e > start:
            if s > start:
                out.append((start, s))
            start = max(start, e)
    if start < end:
        out.append((start, end))
    return out


def in_order(spans: list[Span]) -> list[Span]:
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], rank.get(s[0], len(KINDS)), s[0], s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- word shapes -----------------------------------------------------------------------------------------------

_CLASSES = np.zeros((256, 8), np.int64)
for _i, _chars in enumerate([range(48, 58), range(65, 91), range(97, 123), b"=", b"\"'", b"-._", b"()+", range(128, 256)]):
    _CLASSES[list(_chars), _i] = 1
_HEX = np.zeros(256, np.int64)
_HEX[[*range(48, 58), *range(97, 103)]] = 1
SHAPES = 17


@lru_cache(maxsize=1)
def _cues() -> tuple[np.ndarray, np.ndarray]:
    def hashes(words: str) -> np.ndarray:
        raw = words.encode()
        data = np.frombuffer(raw, np.uint8)
        return np.sort(span_hashes(data, *word_spans(~BLANK_BYTES[data], np.array([0, len(raw)]))))

    return hashes(SECRET_CUES), hashes(PHONE_CUES)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of words, 0 or 1 each: what characters they hold and how many, whether they are or begin with a cue, and
    whether they announce a secret (a cue ending in = or :, or that sign alone after a cue).  ``first``: where each
    row's words begin (and the end)."""
    if not len(starts):
        return np.zeros((0, SHAPES), np.float32)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    chars = data[np.repeat(starts, lengths) + np.arange(int(lengths.sum())) - np.repeat(begin, lengths)]
    counts = np.add.reduceat(_CLASSES[chars], begin, axis=0)
    digits, upper, lower, equals, quotes, marks, signs, beyond = counts.T
    hexes = np.add.reduceat(_HEX[chars], begin)
    letters = upper + lower + beyond
    low = LOWER_BYTES[data]
    # the cue is the word up to an equals sign or colon, or without them
    cut = np.add.reduceat(np.logical_or(chars == 61, chars == 58).astype(np.int64), begin) > 0
    stop = ends.copy()
    for i in np.flatnonzero(cut):
        piece = low[starts[i] : ends[i]]
        stop[i] = starts[i] + int(np.flatnonzero((piece == 61) | (piece == 58))[0])
    named = np.maximum(stop, starts + 1)
    key = span_hashes(low, starts, named)
    secret, phone = (np.isin(key, c) for c in _cues())
    value = np.maximum(lengths - (stop - starts) - cut, 0)
    after = np.concatenate([[False], secret[:-1] & ~cut[:-1]])
    after[first[first < len(starts)]] = False
    announces = cut & (value == 0) & (secret | (after & (lengths == 1)))
    rows = [
        np.ones(len(starts)), digits > 0, (digits > 0) & (letters > 0), (digits > 0) & (letters == 0), upper > 0,
        (hexes >= 10) & (digits > 1), quotes > 0, signs > 0, marks > 0, lengths >= 8, lengths >= 16,
        equals > 0, (lengths == 1) & (equals == 1), secret, phone, secret & cut & (value >= 6), announces,
    ]
    return np.stack(rows, axis=1).astype(np.float32)


def stretches(active: np.ndarray, first: np.ndarray, margin: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretches around active words; ``first``: where each row's words begin (and the end)."""
    near = np.zeros(len(active) + 1, np.int64)
    at = np.flatnonzero(active)
    row = np.searchsorted(first, at, "right") - 1
    np.add.at(near, np.maximum(at - margin, first[row]), 1)
    np.add.at(near, np.minimum(at + margin + 1, first[row + 1]), -1)
    inside = np.cumsum(near[:-1]) > 0
    return word_spans(inside, first)


# --- the field -------------------------------------------------------------------------------------------------


def emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores (words, tags) of a run of sequences; ``features`` has a zero row before, between and after them."""
    own, before, after = weights
    score = features @ own
    score[1:] += features[:-1] @ before
    score[:-1] += features[1:] @ after
    return score


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags (sequences, steps) of padded ``scores`` (sequences, steps, tags), all sequences a step at a time."""
    n, steps, tags = scores.shape
    best, back = scores[:, 0].copy(), np.zeros((n, steps, tags), np.int8)
    for t in range(1, steps):
        reach = best[:, :, None] + moves
        back[:, t] = reach.argmax(axis=1)
        step = np.take_along_axis(reach, back[:, t][:, None].astype(np.int64), axis=1)[:, 0] + scores[:, t]
        best = np.where((t < lengths)[:, None], step, best)
    out = np.zeros((n, steps), np.int8)
    tag, rows = best.argmax(axis=1), np.arange(n)
    for t in range(steps - 1, -1, -1):
        out[:, t] = np.where(t < lengths, tag, 0)
        tag = np.where((t < lengths) & (t > 0), back[rows, t, tag], tag)
    return out


def _sequences(features: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of features with a zero row around every sequence; for each sequence its first row, and its length."""
    lengths = hi - lo
    start = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    rows = np.zeros((int((lengths + 1).sum()) + 1, features.shape[1]), np.float32)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rows[np.repeat(start, lengths) + inner] = features[np.repeat(lo, lengths) + inner]
    return rows, start, lengths


def decode(features: np.ndarray, lo: np.ndarray, hi: np.ndarray, model: tuple[np.ndarray, np.ndarray], cells: int = 1 << 18) -> np.ndarray:
    """A tag for every word; words outside the stretches [lo, hi) are other.  Stretches of like length go together."""
    tags = np.zeros(len(features), np.int8)
    weights, moves = model
    order = np.argsort(hi - lo, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * int((hi - lo)[order[end]]) <= cells:
            end += 1
        some = order[at:end]
        rows, start, lengths = _sequences(features, lo[some], hi[some])
        score = emissions(rows, weights)
        steps = np.minimum(np.arange(int(lengths.max())), lengths[:, None] - 1)
        found = viterbi(score[start[:, None] + steps], lengths, moves)
        valid = np.arange(found.shape[1]) < lengths[:, None]
        tags[(lo[some][:, None] + steps)[valid]] = found[valid]
        at = end
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[str], steps: int = 400, decay: float = 0.02, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Weights (3, features, tags) and moves (tags, tags) of greatest penalised likelihood, by Adam on the exact gradient
    (forward-backward over all sentences at once).  ``rows`` is the labelled table, sentences with marked values."""
    raw, marks = [], []
    for row in rows:
        plain, spans, at = "", [], 0
        for m in _MARK.finditer(row):
            plain += row[at : m.start()]
            spans.append((len(plain.encode()), len((plain + m[2]).encode()), TAGS.index(m[1])))
            plain, at = plain + m[2], m.end()
        raw.append((plain + row[at:]).encode())
        marks.append(spans)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends = word_spans(~BLANK_BYTES[data], offsets)
    first = np.searchsorted(starts, offsets)
    gold = np.zeros(len(starts), np.int64)
    for base, spans in zip(offsets, marks, strict=False):
        for lo, hi, tag in spans:
            gold[(starts < base + hi) & (ends > base + lo)] = tag
    x, start, lengths = _sequences(shapes(data, starts, ends, first), first[:-1], first[1:])
    n, steps_, k = len(lengths), int(lengths.max()), len(TAGS)
    place = start[:, None] + np.minimum(np.arange(steps_), lengths[:, None] - 1)
    valid = np.arange(steps_) < lengths[:, None]
    tags = np.zeros((n, steps_), np.int64)
    tags[valid] = gold
    known = np.zeros((len(x), k))
    known[place[valid], gold] = 1
    pairs = valid[:, 1:]
    moved = np.zeros((k, k))
    np.add.at(moved, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    wide = np.zeros((3, *x.shape))
    wide[0], wide[1, 1:], wide[2, :-1] = x, x[:-1], x[1:]
    weights, moves = np.zeros((3, x.shape[1], k)), np.zeros((k, k))
    params = [weights, moves]
    first_m, second_m = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        score = np.einsum("crf,cfk->rk", wide, weights)[place]
        ahead, behind = np.zeros((n, steps_, k)), np.zeros((n, steps_, k))
        ahead[:, 0] = score[:, 0]
        for t in range(1, steps_):
            ahead[:, t] = np.where(valid[:, t, None], _log_sum(ahead[:, t - 1, :, None] + moves, 1) + score[:, t], ahead[:, t - 1])
        for t in range(steps_ - 2, -1, -1):
            behind[:, t] = np.where(valid[:, t + 1, None], _log_sum(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        total = _log_sum(ahead[:, -1], 1)
        chance = np.exp(ahead + behind - total[:, None, None]) * valid[:, :, None]
        expect = np.zeros((len(x), k))
        expect[place[valid]] = chance[valid]
        both = np.exp(ahead[:, :-1, :, None] + moves + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
        grads = [np.einsum("crf,rk->cfk", wide, known - expect) - decay * weights, moved - (both * pairs[:, :, None, None]).sum(axis=(0, 1)) - decay * moves]
        for p, g, m1, m2 in zip(params, grads, first_m, second_m, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return weights.astype(np.float32), moves.astype(np.float32)


# --- documents -------------------------------------------------------------------------------------------------


def block_spans(data: np.ndarray, offsets: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[list[Span], list[Span]]]:
    """Per row of a block: spans of the fixed patterns, and all spans, in code points.  Of a span of the field, the
    parts outside those of the patterns are left."""
    starts, ends = word_spans(~BLANK_BYTES[data], offsets)
    first = np.searchsorted(starts, offsets)
    features = shapes(data, starts, ends, first)
    active = features[:, 1] + features[:, 11] + features[:, 13] + features[:, 14] > 0
    lo, hi = stretches(active, first)
    tags = decode(features, lo, hi, model)
    hot = np.flatnonzero(tags)
    of_row = np.searchsorted(first, hot, "right") - 1
    matters = np.concatenate([[0], np.cumsum((data == 64) | ((data >= 48) & (data <= 57)))])[offsets]
    for row in range(len(offsets) - 1):
        base: list[Span] = []
        found: list[Span] = []
        a, b = int(offsets[row]), int(offsets[row + 1])
        mine = hot[np.searchsorted(of_row, row) : np.searchsorted(of_row, row, "right")]
        if len(mine) or matters[row + 1] > matters[row]:
            raw = data[a:b].tobytes()
            text = raw.decode("utf-8", "replace")
            base = fixed_spans(text)
            if len(mine):
                taken = sorted((s, e) for _, s, e in base)
                runs = np.split(mine, np.flatnonzero((np.diff(mine) > 1) | (np.diff(tags[mine]) != 0)) + 1)
                for run in runs:
                    s = len(raw[: starts[run[0]] - a].decode("utf-8", "replace"))
                    e = s + len(raw[starts[run[0]] - a : ends[run[-1]] - a].decode("utf-8", "replace"))
                    piece = text[s:e]
                    kind = TAGS[tags[run[0]]]
                    if kind == "secret" and (m := _LEAD.match(piece)):
                        s += m.end()
                    for x, y in outside(s, e, taken):
                        if x > s and (m := _AROUND.match(text[x:y])):
                            x += m.end()
                        if m := _TRAIL.search(text[x:y]):
                            y = x + m.start()
                        # beside a pattern, marks alone are no value
                        if x < y and ((x, y) == (s, e) or any(c.isalnum() for c in text[x:y])):
                            found.append((kind, x, y))
        yield base, in_order(base + found)


def find(docs: DataFrame, examples: list[str] = EXAMPLES) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, as listed texts; null is empty."""
    model = train(examples)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for _, _, data, offsets in text_blocks(batch.column("text")):
                for base, every in block_spans(data, offsets, model):
                    counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                    digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                    spans.append(listed(every))
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            arrays = [batch.column("doc_id"), *numbers, pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, schema)


def masked(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kinds in angle brackets; of spans that overlap the first names the whole stretch."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame, examples: list[str] = EXAMPLES) -> DataFrame:
    """``docs`` with all spans masked; n_chars counts the new text.  Other columns, null texts and the rows stay."""
    model = train(examples)
    names = docs.columns

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            done: list[str | None] = []
            for lo, hi, data, offsets in text_blocks(texts):
                some = texts.slice(lo, hi - lo).to_pylist()
                done += [masked(t, s) if s else t for t, (_, s) in zip(some, block_spans(data, offsets, model), strict=True)]
            arrays = [pa.array(done, f.type) if f.name == "text" else a for f, a in zip(batch.schema, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    out = docs.mapInArrow(mask, schema)
    if "n_chars" in names:
        size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
