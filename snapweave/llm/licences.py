"""Licence scans by ordered signature rules.

A rule is a regular expression over the normalised text (lower-cased words
joined by single blanks) with a label, a priority and a confidence, gated by a
keyword: a rule only runs where its keyword stands in the text, and texts
without any keyword are done after one scan. Detections are taken by priority;
one that lies inside the interval of a detection already taken is suppressed.
The four base phrases are rules like the others, but always stay.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as T
from .repeats import joined_words

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_V = r"(?: v(?:ersion)?)?"
# Hand-written signatures: label, priority (small first), confidence, keyword (stands in every match of the pattern), pattern.
SIGNATURES = [
    ("gpl-3.0", 10, 0.95, "gnu general public license", rf"gnu general public license{_V} ?3(?: 0)?"),
    ("gpl-2.0", 10, 0.95, "gnu general public license", rf"gnu general public license{_V} ?2(?: 0)?"),
    ("gpl-1.0", 10, 0.95, "gnu general public license", rf"gnu general public license{_V} ?1(?: 0)?"),
    ("gpl-or-later", 8, 0.97, "any later version", r"gnu general public license[^.]{0,120}? any later version"),
    ("lgpl", 10, 0.9, "general public license", r"gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", 9, 0.95, "lesser general public", rf"gnu lesser general public license{_V} 2 1"),
    ("lgpl-3.0", 9, 0.95, "lesser general public", rf"gnu lesser general public license{_V} 3(?: 0)?"),
    ("agpl-3.0", 9, 0.95, "affero general public", rf"(?:gnu )?affero general public license(?:{_V} 3(?: 0)?)?"),
    ("gfdl", 10, 0.9, "free documentation license", r"gnu free documentation license"),
    ("apache-2.0", 10, 0.95, "apache license", rf"apache license{_V} 2 0"),
    ("apache-1.1", 10, 0.95, "apache", rf"apache (?:software )?license{_V} 1 1"),
    ("apache-2.0", 9, 0.98, "licensed under the apache", r"licensed under the apache license version 2 0"),
    ("apache", 12, 0.85, "apache software license", r"apache software license"),
    ("mit", 12, 0.9, "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 11, 0.9, "mit license", r"(?:released|licensed|distributed) under the mit license"),
    ("mit", 13, 0.8, "licence mit", r"licence mit"),
    ("expat", 12, 0.85, "expat license", r"expat license"),
    ("isc", 12, 0.85, "isc license", r"isc license"),
    ("isc", 12, 0.9, "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 14, 0.85, "bsd license", r"bsd license"),
    ("bsd-2-clause", 10, 0.95, "2 clause", r"(?:bsd 2 clause|2 clause bsd)(?: license)?"),
    ("bsd-3-clause", 10, 0.95, "3 clause", r"(?:bsd 3 clause|3 clause bsd)(?: license)?"),
    ("bsd", 13, 0.9, "redistribution and use in source and binary", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 9, 0.95, "neither the name of", r"neither the name of .{1,120}? may be used to endorse or promote products derived from this software"),
    ("mpl-2.0", 10, 0.95, "mozilla public license", rf"mozilla public license{_V} 2 0"),
    ("mpl-1.1", 10, 0.95, "mozilla public license", rf"mozilla public license{_V} 1 1"),
    ("mpl", 14, 0.85, "mozilla public license", r"mozilla public license"),
    ("epl-2.0", 10, 0.95, "eclipse public license", rf"eclipse public license{_V} 2 0"),
    ("epl-1.0", 10, 0.95, "eclipse public license", rf"eclipse public license{_V} 1 0"),
    ("epl", 14, 0.85, "eclipse public license", r"eclipse public license"),
    ("cddl", 14, 0.85, "common development and distribution", r"common development and distribution license"),
    ("unlicense", 12, 0.9, "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", 15, 0.7, "public domain", r"(?:released into|dedicated to|placed in|in) the public domain"),
    ("cc0-1.0", 10, 0.95, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("wtfpl", 12, 0.9, "do what the", r"do what the f\w+ you want to public license"),
    ("zlib", 13, 0.85, "zlib", r"zlib(?: libpng)? license"),
    ("artistic-2.0", 12, 0.9, "artistic license", r"artistic license(?: 2 0)?"),
    ("boost-1.0", 12, 0.9, "boost software license", r"boost software license(?: version 1 0)?"),
    ("ofl-1.1", 12, 0.9, "open font license", r"(?:sil )?open font license(?: version 1 1)?"),
    ("odbl", 12, 0.9, "open database license", r"open (?:data commons open )?database license"),
    ("odc-by", 12, 0.9, "open data commons attribution", r"open data commons attribution license"),
    ("postgresql", 13, 0.85, "postgresql license", r"postgresql license"),
    ("python-2.0", 13, 0.85, "python software foundation license", r"python software foundation license(?: version 2)?"),
    ("openssl", 13, 0.85, "openssl license", r"openssl license"),
    ("all-rights-reserved", 16, 0.6, "all rights reserved", r"all rights reserved"),
    ("copyright", 17, 0.5, "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("no-warranty", 17, 0.5, "without warranty", r"(?:provided )?as is without warranty of any kind"),
    ("proprietary", 15, 0.8, "proprietary and confidential", r"proprietary and confidential"),
    ("lgpl-2.0", 9, 0.95, "library general public license", rf"gnu library general public license{_V} ?2(?: 0)?"),
    ("gfdl-1.2", 9, 0.95, "free documentation license", rf"gnu free documentation license{_V} ?1 2"),
    ("gfdl-1.3", 9, 0.95, "free documentation license", rf"gnu free documentation license{_V} ?1 3"),
    ("apache-1.0", 10, 0.95, "apache", rf"apache (?:software )?license{_V} ?1 0"),
    ("apache-2.0", 10, 0.95, "apache software license", rf"apache software license{_V} ?2 0"),
    ("eupl", 14, 0.85, "european union public licen", r"european union public licen[cs]e"),
    ("eupl-1.1", 10, 0.95, "european union public licen", rf"european union public licen[cs]e{_V} ?1 1"),
    ("eupl-1.2", 10, 0.95, "european union public licen", rf"european union public licen[cs]e{_V} ?1 2"),
    ("ms-pl", 12, 0.9, "microsoft public license", r"microsoft public license"),
    ("ms-rl", 12, 0.9, "microsoft reciprocal license", r"microsoft reciprocal license"),
    ("sspl-1.0", 12, 0.9, "server side public license", rf"server side public license(?:{_V} ?1(?: 0)?)?"),
    ("busl-1.1", 12, 0.9, "business source license", rf"business source license(?:{_V} ?1 1)?"),
    ("elastic-2.0", 10, 0.95, "elastic license", rf"elastic license{_V} ?2(?: 0)?"),
    ("elastic", 14, 0.8, "elastic license", r"elastic license"),
    ("commons-clause", 12, 0.9, "commons clause", r"commons clause (?:license condition|restriction)"),
    ("polyform-noncommercial", 12, 0.9, "polyform noncommercial", r"polyform noncommercial license"),
    ("polyform-small-business", 12, 0.9, "polyform small business", r"polyform small business license"),
    ("ncsa", 12, 0.9, "ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("w3c", 13, 0.85, "w3c software", r"w3c software (?:notice and|and document(?: notice and)?) license"),
    ("php-3.01", 10, 0.95, "php license", rf"php license{_V} ?3 0?1"),
    ("php", 14, 0.85, "php license", r"php license"),
    ("ruby", 13, 0.85, "ruby license", r"ruby license"),
    ("vim", 13, 0.85, "vim license", r"vim license"),
    ("sleepycat", 13, 0.85, "sleepycat license", r"sleepycat license"),
    ("0bsd", 10, 0.95, "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd|bsd 0 clause)(?: license)?"),
    ("bsd-4-clause", 10, 0.95, "4 clause", r"(?:bsd 4 clause|4 clause bsd)(?: license)?"),
    ("bsd-4-clause", 9, 0.95, "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("beerware", 12, 0.9, "beer", r"(?:the )?beer ?ware license"),
    ("json", 13, 0.9, "shall be used for good", r"the software shall be used for good not evil"),
    ("zpl", 13, 0.85, "zope public license", rf"zope public license(?:{_V} ?\d(?: \d)?)?"),
    ("x11", 13, 0.85, "x11 license", r"x11 license"),
    ("qpl-1.0", 12, 0.9, "q public license", rf"q public license(?:{_V} ?1 0)?"),
    ("ipl-1.0", 12, 0.9, "ibm public license", rf"ibm public license(?:{_V} ?1 0)?"),
    ("cpl-1.0", 12, 0.9, "common public license", rf"common public license(?:{_V} ?1 0)?"),
    ("cpal-1.0", 12, 0.9, "common public attribution license", rf"common public attribution license(?:{_V} ?1 0)?"),
    ("afl-3.0", 12, 0.9, "academic free license", rf"academic free license(?:{_V} ?3 0)?"),
    ("osl-3.0", 12, 0.9, "open software license", rf"open software license(?:{_V} ?3 0)?"),
    ("lppl", 12, 0.9, "latex project public license", rf"latex project public license(?:{_V} ?1 3c?)?"),
    ("cecill", 14, 0.85, "cecill", r"cecill(?: (?:free software )?licen[cs]e(?: agreement)?)?"),
    ("cecill-b", 10, 0.95, "cecill b", r"cecill b(?: licen[cs]e)?"),
    ("cecill-c", 10, 0.95, "cecill c", r"cecill c(?: licen[cs]e)?"),
    ("unicode", 13, 0.85, "unicode license", r"unicode license(?: agreement)?"),
    ("icu", 13, 0.85, "icu license", r"icu license"),
    ("upl-1.0", 12, 0.9, "universal permissive license", rf"universal permissive license(?:{_V} ?1 0)?"),
    ("mulan-psl-2.0", 12, 0.9, "mulan permissive software license", rf"mulan permissive software license(?:{_V} ?2)?"),
    ("blueoak-1.0.0", 12, 0.9, "blue oak model license", r"blue oak model license(?: 1 0 0)?"),
    ("artistic-1.0", 10, 0.95, "artistic license 1 0", r"artistic license 1 0"),
    ("edl-1.0", 12, 0.9, "eclipse distribution license", rf"eclipse distribution license(?:{_V} ?1 0)?"),
    ("mpl-1.0", 10, 0.95, "mozilla public license", rf"mozilla public license{_V} ?1 0"),
    ("npl", 13, 0.85, "netscape public license", r"netscape public license"),
    ("apsl", 13, 0.85, "apple public source license", rf"apple public source license(?:{_V} ?2 0)?"),
    ("hpnd", 13, 0.85, "historical permission notice", r"historical permission notice and disclaimer"),
    ("pddl-1.0", 12, 0.9, "public domain dedication and license", r"open data commons public domain dedication and license"),
    ("ogl-3.0", 12, 0.9, "open government licen", r"open government licen[cs]e(?: v ?3 0| v3 0)?"),
    ("cdla-permissive", 12, 0.9, "community data license agreement permissive", r"community data license agreement permissive"),
    ("cdla-sharing", 12, 0.9, "community data license agreement sharing", r"community data license agreement sharing"),
    ("openrail", 13, 0.85, "openrail", r"(?:creativeml )?(?:bigscience )?openrail(?: m)?"),
    ("llama", 13, 0.85, "community license agreement", r"llama (?:2|3|3 1|3 2|3 3|4) community license agreement"),
    ("bittorrent-1.1", 13, 0.85, "bittorrent open source license", r"bittorrent open source license"),
    ("ecl-2.0", 12, 0.9, "educational community license", rf"educational community license(?:{_V} ?2 0)?"),
    ("gust", 13, 0.85, "gust font license", r"gust font license"),
    ("bitstream-vera", 13, 0.85, "bitstream vera", r"bitstream vera (?:fonts? copyright|license)"),
]
# Creative Commons: every element set, with and without a version, in its short and its long name.
_CC = {"": "", " nc": " noncommercial", " sa": " sharealike", " nd": " noderivs", " nc sa": " noncommercial sharealike", " nc nd": " noncommercial noderivs"}
# SPDX identifiers that are recognised after the tag.
_SPDX = ("mit apache-1.1 apache-2.0 gpl-1.0 gpl-2.0 gpl-3.0 lgpl-2.0 lgpl-2.1 lgpl-3.0 agpl-3.0 bsd-2-clause bsd-3-clause mpl-1.1 mpl-2.0 "
         "epl-1.0 epl-2.0 isc zlib unlicense cc0-1.0 cc-by-4.0 cc-by-sa-4.0 cc-by-nc-4.0 artistic-2.0 ofl-1.1 wtfpl 0bsd").split()


def _plain(x: str) -> str:
    return " ".join(re.findall(r"[0-9a-z]+", x))


def rules() -> list[tuple[int, float, bytes, re.Pattern, str, bool]]:
    """(priority, confidence, keyword, pattern, label, base), by priority."""
    out = [(0, 0.9, phrase, phrase, label, True) for phrase, label in BASE.items()]
    out += [(p, c, k, x, label, False) for label, p, c, k, x in SIGNATURES]
    for short, long in _CC.items():
        name = "cc-by" + short.replace(" ", "-")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v = version.replace(".", " ")
            out.append((8 - len(short.split()), 0.95, f"cc by{short} {v}", f"cc by{short} {v}", f"{name}-{version}", False))
            out.append((8 - len(short.split()), 0.95, f"attribution{long} {v}",
                        f"(?:creative commons )?attribution{long} {v}(?: (?:international|unported|generic))?(?: license)?", f"{name}-{version}", False))
        if short:
            out.append((9 - len(short.split()), 0.9, f"cc by{short}", f"cc by{short}", name, False))
        out.append((9 - len(short.split()), 0.85, f"creative commons attribution{long}", f"creative commons attribution{long}(?: license)?", name, False))
    for spdx in _SPDX:
        for ending in ("", "-only", "-or-later") if "gpl" in spdx else ("",):
            tag = _plain(f"spdx license identifier {spdx}{ending}")
            out.append((5 - len(ending.split("-")), 0.99, tag, tag, spdx + ending, False))
    out.sort(key=lambda r: r[0])
    return [(p, c, k.encode(), re.compile(rb"(?<![^ ])(?:" + x.encode() + rb")(?![^ ])"), label, base) for p, c, k, x, label, base in out]


class _Taken:
    """Intervals taken so far; those inside others are left out, so starts and ends both rise and one bisection decides."""

    def __init__(self):
        self.starts, self.ends = [], []

    def take(self, start: int, end: int) -> bool:
        """Takes the interval unless it lies inside one already taken."""
        i = bisect.bisect_right(self.starts, start)
        if i and self.ends[i - 1] >= end:
            return False
        lo, hi = bisect.bisect_left(self.starts, start), bisect.bisect_right(self.ends, end)
        self.starts[lo:max(lo, hi)], self.ends[lo:max(lo, hi)] = [start], [end]
        return True


def detect(text: bytes, ruleset) -> tuple[list[tuple[int, int, str, float]], list[tuple[int, str]]]:
    """Detections kept (from, to, label, confidence) and places of the base phrases (start, label), in bytes of the normalised text."""
    kept, base, taken = [], [], _Taken()
    for _, confidence, keyword, pattern, label, is_base in ruleset:
        if keyword not in text:
            continue
        for m in pattern.finditer(text):
            if is_base:
                base.append((m.start(), label))
            if taken.take(m.start(), m.end()):
                kept.append((m.start(), m.end(), label, confidence))
    return kept, base


def word_places(text: bytes, starts: list[int]) -> list[int]:
    """Word numbers of these starts, in order; every blank is counted once."""
    out, at, words = [], 0, 0
    for s in sorted(starts):
        words += text.count(b" ", at, s)
        at = s
        out.append(words)
    return out


def _scan(batches):
    ruleset = rules()
    keywords = sorted({r[2] for r in ruleset}, key=len)
    # the shortest word lists that every keyword holds: one pass decides for most texts
    gate = re.compile(b"|".join(sorted({min(k.split(), key=lambda w: (w in (b"the", b"in", b"is", b"what", b"by", b"of", b"0", b"cc", b"any"), -len(w))) for k in keywords})))
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for b in T.blocks(batch.column(1), T.PLAIN, lower=True):
            out = [[] for _ in range(7)]
            words = np.diff(b.row_words).tolist()
            data = b.buf.tobytes()
            hit = [bool(gate.search(data, lo, hi)) for lo, hi in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True)]
            texts = joined_words(b, np.ones(len(b.starts), bool)) if any(hit) else None
            for r in range(b.rows):
                kept, base = detect(texts[r], ruleset) if hit[r] else ([], [])
                places = word_places(texts[r], [s for s, _ in base])
                named = {x for _, x in base}
                row = (ids[b.first_row + r], len(places), places[0] if places else None, places[-1] if places else None,
                       ",".join(sorted(named)), ",".join(sorted(named | {k[2] for k in kept})), max((k[3] for k in kept), default=0.0))
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(words, pa.int64()), *[pa.array(o, pa.int64()) for o in out[1:4]],
                 *[pa.array(o, pa.string()) for o in out[4:6]], pa.array(out[6], pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence detections of every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. n_base
    counts all places of the base phrases, first_word and last_word are their
    smallest and largest start (null without any); labels also holds the labels
    of the other rules; score is the confidence of the surest detection kept, 0
    without one. Null and empty texts have no words and no labels. Rows with null
    or repeated ids are scanned like any other. Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
