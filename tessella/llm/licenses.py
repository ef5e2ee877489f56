"""License scans: ordered signature rules with a keyword prefilter and interval containment.

A rule is a pattern over lower-cased text, a label, a priority and a weight.  The keyword, one word (or the beginning
of one) that every match of the rule holds whatever lies between its words, is searched first, in the bytes of a whole block of documents; only rules whose keyword a document
has are tried on it.  Where detections overlap, one whose span lies inside that of a detection of higher priority
(or of equal priority and longer) is suppressed.  The plain phrases of ``BASE`` are rules too; they are never suppressed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LOWER_BYTES, text_blocks, word_spans

#: The phrases that must be found at every place, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Hand-written names, as they are in use: label, name (words; a part in brackets may be absent), versions, url.
FAMILIES = [
    ("apache", "apache [software]", "1.0 1.1 2.0", "apache.org/licenses"),
    ("mit", "mit", "", "opensource.org/licenses/mit"),
    ("mit-0", "mit no attribution", "", "opensource.org/licenses/mit-0"),
    ("x11", "x11", "", "xfree86.org/current/license"),
    ("isc", "isc", "", "opensource.org/licenses/isc"),
    ("bsd", "bsd", "", "opensource.org/licenses/bsd"),
    ("bsd-2-clause", "bsd 2 clause", "", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd 3 clause", "", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd 4 clause", "", "directory.fsf.org/wiki/license:bsd-4clause"),
    ("0bsd", "bsd zero clause", "", "opensource.org/licenses/0bsd"),
    ("gpl", "[gnu] general public", "1 2 3", "gnu.org/licenses/gpl"),
    ("lgpl", "[gnu] lesser general public", "2.1 3", "gnu.org/licenses/lgpl"),
    ("lgpl", "[gnu] library general public", "2", "gnu.org/licenses/old-licenses/lgpl"),
    ("agpl", "[gnu] affero general public", "1 3", "gnu.org/licenses/agpl"),
    ("gfdl", "[gnu] free documentation", "1.1 1.2 1.3", "gnu.org/licenses/fdl"),
    ("mpl", "mozilla public", "1.0 1.1 2.0", "mozilla.org/mpl"),
    ("epl", "eclipse public", "1.0 2.0", "eclipse.org/legal/epl"),
    ("edl", "eclipse distribution", "1.0", "eclipse.org/org/documents/edl"),
    ("cddl", "common development and distribution", "1.0 1.1", "opensource.org/licenses/cddl"),
    ("cpl", "common public", "1.0", "opensource.org/licenses/cpl"),
    ("ipl", "ibm public", "1.0", "opensource.org/licenses/ipl"),
    ("eupl", "european union public", "1.0 1.1 1.2", "joinup.ec.europa.eu/collection/eupl"),
    ("artistic", "artistic", "1.0 2.0", "perlfoundation.org/artistic-license"),
    ("bsl", "boost software", "1.0", "boost.org/license"),
    ("busl", "business source", "1.1", "mariadb.com/bsl"),
    ("sspl", "server side public", "1", "mongodb.com/licensing/server-side-public-license"),
    ("elastic", "elastic", "2.0", "elastic.co/licensing/elastic-license"),
    ("zlib", "zlib", "", "zlib.net/zlib_license"),
    ("libpng", "libpng", "2.0", "libpng.org/pub/png/src/libpng-license"),
    ("ofl", "[sil] open font", "1.0 1.1", "scripts.sil.org/ofl"),
    ("afl", "academic free", "1.1 2.0 2.1 3.0", "opensource.org/licenses/afl"),
    ("osl", "open software", "1.0 2.0 3.0", "opensource.org/licenses/osl"),
    ("ecl", "educational community", "1.0 2.0", "opensource.org/licenses/ecl"),
    ("ms-pl", "microsoft public", "", "opensource.org/licenses/ms-pl"),
    ("ms-rl", "microsoft reciprocal", "", "opensource.org/licenses/ms-rl"),
    ("ncsa", "university of illinois ncsa open source", "", "opensource.org/licenses/ncsa"),
    ("postgresql", "postgresql", "", "opensource.org/licenses/postgresql"),
    ("python", "python software foundation", "2", "docs.python.org/license"),
    ("php", "php", "3.0 3.01", "php.net/license"),
    ("ruby", "ruby", "", "ruby-lang.org/en/about/license"),
    ("openssl", "openssl", "", "openssl.org/source/license"),
    ("unlicense", "unlicense", "", "unlicense.org"),
    ("wtfpl", "do what the fuck you want to public", "2", "wtfpl.net"),
    ("upl", "universal permissive", "1.0", "opensource.org/licenses/upl"),
    ("vim", "vim", "", "vimdoc.sourceforge.net/htmldoc/uganda"),
    ("w3c", "w3c software", "", "w3.org/consortium/legal"),
    ("zpl", "zope public", "1.1 2.0 2.1", "zope.org/resources/zpl"),
    ("cecill", "cecill", "1.0 2.0 2.1", "cecill.info/licences"),
    ("mulan", "mulan permissive software", "1 2", "license.coscl.org.cn/mulanpsl"),
    ("odbl", "open database", "1.0", "opendatacommons.org/licenses/odbl"),
    ("odc-by", "open data commons attribution", "1.0", "opendatacommons.org/licenses/by"),
    ("pddl", "public domain dedication and", "1.0", "opendatacommons.org/licenses/pddl"),
    ("cdla", "community data license agreement", "1.0 2.0", "cdla.dev"),
    ("openrail", "[creativeml] open rail m", "", "licenses.ai"),
    ("ogl", "open government", "1.0 2.0 3.0", "nationalarchives.gov.uk/doc/open-government-licence"),
]
#: The Creative Commons terms and their words.
CREATIVE = [("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivs"), ("by-nc", "attribution noncommercial"),
            ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivs")]
#: Hand-written sentences: label, keyword, words.
NOTICES = [
    ("cc0", "cc0", "cc0"),
    ("cc0", "reserved", "no rights reserved"),
    ("public-domain", "domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "in the public domain"),
    ("reserved", "reserved", "some rights reserved"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "permission", "may not be (?:reproduced|copied|distributed) without (?:the )?(?:prior )?(?:written )?permission"),
    ("permission", "hereby", "permission is hereby granted free of charge"),
    ("permission", "modify", "permission to use copy modify and(?: or)? distribute"),
    ("redistribution", "redistribution", "redistribution and use in source and binary forms"),
    ("warranty", "warranty", "without warranty of any kind"),
    ("warranty", "provided", "(?:is|are) provided as is"),
]

_WORD, _EDGE, _END = "[0-9a-z\\x80-\\xff]", "(?<![0-9a-z\\x80-\\xff])", "(?![0-9a-z\\x80-\\xff])"
#: Between two words of a phrase: at least one character of no word.
_GAP = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"
_INSIDE = np.ones(256, bool)
_INSIDE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


@dataclass(frozen=True)
class Rule:
    keyword: bytes
    pattern: re.Pattern
    label: str
    priority: int
    weight: float
    base: bool = False
    gate: re.Pattern | None = None


def _pattern(words: str) -> re.Pattern:
    """Whole words; each blank stands for any gap."""
    return re.compile((_EDGE + words.replace(" ", _GAP) + _END).encode("latin-1"))


def _rule(keyword: str, words: str, label: str, priority: int, weight: float, base: bool = False, gate: str | None = None) -> Rule:
    return Rule(keyword.encode(), _pattern(words), label, priority, weight, base, gate and _pattern(gate))


@cache
def rules() -> tuple[Rule, ...]:
    """All rules: tags, urls, named versions, licences granted by name, names, sentences and phrases."""
    out = []
    for label, name, versions, url in FAMILIES:
        longest = max(re.sub(r"\[[^]]*\]", "", name).split(), key=len)
        words = re.sub(r"\[(\w+)\] ", r"(?:\1 )?", re.sub(r" \[(\w+)\]$", r"(?: \1)?", name))
        # short names are parts of common words; there the rule's other fixed word is the keyword
        word = lambda other, longest=longest: longest if len(longest) > 4 else other
        out.append(_rule("spdx", f"spdx license identifier {label.replace('-', ' ')}(?: [0-9]+)*(?: only| or later)?", label, 90, 1.0))
        address = re.sub(r"[^0-9a-z]+", " ", url)
        out.append(_rule(max(address.split(), key=len), address, label, 80, 0.95))
        for number in versions.split():
            exact, plain = f"{label}-{number}", number.replace(".", " ")
            out.append(_rule(word("licen"), f"{words} licen[cs]e(?: version)? v?{plain}(?: or later| or any later version)?", exact, 70, 0.95))
            out.append(_rule(word("licensed"), f"licensed under (?:the )?{words}(?: licen[cs]e)?(?: version)? v?{plain}(?: or later| or any later version)?", exact, 72, 0.95))
        out.append(_rule(word("licensed"), f"licensed under (?:the )?(?:terms of the )?{words}(?: licen[cs]e)?", label, 60, 0.9))
        out.append(_rule(word("released"), f"released under (?:the )?(?:terms of the )?{words}(?: licen[cs]e)?", label, 60, 0.9))
        out.append(_rule(word("licen"), f"{words} licen[cs]e", label, 50, 0.8))
    for terms, named in CREATIVE:
        short = terms.replace("-", " ")
        for number in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append(_rule("cc", f"cc {short} {number.replace('.', ' ')}", f"cc-{terms}-{number}", 70, 0.95, gate="cc by"))
        out.append(_rule("cc", f"cc {short}", f"cc-{terms}", 50 + len(terms), 0.8, gate="cc by"))
        out.append(_rule("creativecommons", f"creativecommons org licenses {short} [0-9](?: [0-9])?", f"cc-{terms}", 80, 0.95))
        out.append(_rule("commons", f"creative commons {named}(?: [0-9] [0-9])?(?: international| unported)?(?: public)? licen[cs]e", f"cc-{terms}", 65, 0.9))
    out += [_rule(keyword, words, label, 40, 0.6) for label, keyword, words in NOTICES]
    out += [_rule(max(words.split(), key=len), words, label, 30, 0.7, base=True, gate=words) for words, label in BASE]
    return tuple(out)


def resolve(hits: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Hits left after suppression: one goes if it lies inside a hit of higher priority, or of equal priority and
    longer (of equal spans the first label stays).

    What a suppressed hit holds lies inside its suppressor as well, so all hits may suppress.  Per priority, from the
    highest: the furthest end among the hits of higher priority up to a start tells whether one of them covers it.
    """
    levels: dict[int, list[tuple[int, int, Rule]]] = {}
    for hit in hits:
        levels.setdefault(hit[2].priority, []).append(hit)
    left: list[tuple[int, int, Rule]] = []
    above: list[tuple[int, int]] = []
    for priority in sorted(levels, reverse=True):
        starts, ends = [s for s, _ in above], list(accumulate((e for _, e in above), max))
        furthest = -1
        for start, end, rule in sorted(levels[priority], key=lambda h: (h[0], -h[1], h[2].label)):
            at = bisect.bisect_right(starts, start)
            if furthest < end and (not at or ends[at - 1] < end):
                left.append((start, end, rule))
            furthest = max(furthest, end)
        above = sorted(above + [(s, e) for s, e, _ in levels[priority]])
    return sorted(left, key=lambda h: (h[0], h[1]))


@cache
def _groups() -> dict[tuple[bytes, re.Pattern | None], list[Rule]]:
    groups: dict[tuple[bytes, re.Pattern | None], list[Rule]] = {}
    for rule in rules():
        groups.setdefault((rule.keyword, rule.gate), []).append(rule)
    return groups


def scan_block(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, Rule]]]:
    """Hits (start and end byte within the text) of each row that has any; ``data`` is lower-cased."""
    text = data.tobytes()
    found: dict[int, list[tuple[int, int, Rule]]] = {}
    for (keyword, gate), group in _groups().items():
        at = text.find(keyword)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            begin, end = int(offsets[row]), int(offsets[row + 1])
            if at + len(keyword) <= end:
                body = text[begin:end]
                tried = group if gate is None or gate.search(body) else []
                spans = [(m.start(), m.end(), rule) for rule in tried for m in rule.pattern.finditer(body)]
                if spans:
                    found.setdefault(row, []).extend(spans)
                at = text.find(keyword, end)
            else:
                at = text.find(keyword, at + 1)
    return found


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, spans (label, start and end byte, weight, base: every base place, and the other
    hits that are not suppressed), n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII.  A null text is empty.
    The score is the chance that at least one label is right if the weights of distinct labels were independent.
    """
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()), ("base", pa.bool_())]))
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                low = LOWER_BYTES[data]
                starts, _ = word_spans(_INSIDE[low], offsets)
                first = np.searchsorted(starts, offsets)
                found = scan_block(low, offsets)
                for row in range(hi - lo):
                    hits = found.get(row, [])
                    base = [h for h in hits if h[2].base]
                    left = resolve(hits) if hits else []
                    spans = sorted({(s, e, r.label, r.weight, r.base) for s, e, r in [*base, *left]})
                    weights: dict[str, float] = {}
                    for _, _, label, weight, _ in spans:
                        weights[label] = max(weights.get(label, 0.0), weight)
                    places = np.searchsorted(starts, [offsets[row] + s for s, _, _ in base]) - first[row]
                    values = [
                        int(first[row + 1] - first[row]), len(base), int(places.min()) if base else None, int(places.max()) if base else None,
                        ",".join(sorted({r.label for _, _, r in base})), ",".join(sorted(weights)),
                        1.0 - float(np.prod([1 - w for w in weights.values()])) if weights else 0.0,
                        [{"label": x, "start": s, "end": e, "weight": w, "base": b} for s, e, x, w, b in spans],
                    ]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, types)], names=["doc_id", *columns])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, weight: double, base: boolean>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, schema)
