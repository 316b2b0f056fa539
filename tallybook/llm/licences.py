"""Licence scan: ordered signature rules over the words of a text.

Several hundred regular expressions are written from families of licence names and
the wordings that cite them. A rule runs only if its keyword occurs in the text. Base
phrases come first and are never suppressed. Of the other detections, in order of
priority (wordings that state a grant before mere names, longer before shorter), one
that lies within an accepted interval, or overlaps one of higher priority, is dropped.

Texts are lower-cased (A-Z), and their words (digits, letters, all beyond ASCII)
joined by one space, so places are counted in words. Null and empty texts have no
words and no detections.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tallybook.llm.common import fold_words, map_batches, texts

#: Base phrases and their labels (fixed by the contract of the query).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licences: label, names in words (a pattern), keyword that every name holds.
LICENCES = (
    ("mit", r"mit|expat|x11", ""), ("apache-2", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache"), ("apache-1.1", r"apache(?: software)?(?: license)?(?: version)? 1 1", "apache"),
    ("gpl-2", r"(?:gnu )?(?:gpl|general public license) ?v?(?:ersion)? ?2(?: 0)?", "g"), ("gpl-3", r"(?:gnu )?(?:gpl|general public license) ?v?(?:ersion)? ?3(?: 0)?", "g"),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|lesser general public license) ?v?(?:ersion)? ?2(?: 1)?", "l"), ("lgpl-3", r"(?:gnu )?(?:lgpl|lesser general public license) ?v?(?:ersion)? ?3(?: 0)?", "l"),
    ("agpl-3", r"(?:gnu )?(?:agpl|affero general public license) ?v?(?:ersion)? ?3?(?: 0)?", "a"), ("gfdl", r"gnu free documentation license|gfdl", "g"),
    ("bsd-2", r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd", "bsd"), ("bsd-3", r"bsd 3 clause|3 clause bsd|new bsd|modified bsd", "bsd"), ("bsd-4", r"bsd 4 clause|4 clause bsd|original bsd", "bsd"), ("0bsd", r"0bsd|zero clause bsd", "bsd"),
    ("mpl-1.1", r"(?:mozilla public license|mpl) ?v?(?:ersion)? ?1 1", "m"), ("mpl-2", r"(?:mozilla public license|mpl) ?v?(?:ersion)? ?2(?: 0)?", "m"), ("epl-1", r"(?:eclipse public license|epl) ?v?(?:ersion)? ?1(?: 0)?", "e"),
    ("epl-2", r"(?:eclipse public license|epl) ?v?(?:ersion)? ?2(?: 0)?", "e"), ("cddl-1", r"common development and distribution license|cddl", "c"), ("isc", r"isc", "isc"), ("zlib", r"zlib(?: libpng)?", "zlib"),
    ("unlicense", r"unlicense", "unlicense"), ("wtfpl", r"wtfpl", "wtfpl"), ("boost", r"boost software", "boost"), ("artistic-2", r"artistic 2(?: 0)?|artistic license 2(?: 0)?", "artistic"), ("python", r"python software foundation|psf", "p"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?|cc zero|creative commons zero", "c"), ("cc-by", r"(?:cc|creative commons) (?:by|attribution)(?: [1-4] [05])?(?: international)?", "c"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1-4] [05])?(?: international)?", "c"), ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?", "c"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: [1-4] [05])?(?: international)?", "c"), ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1-4] [05])?", "c"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?", "c"), ("odbl", r"open database license|odbl", "o"), ("ofl", r"sil open font license|ofl", "o"),
    ("eupl", r"european union public licen[cs]e|eupl", "eu"), ("ms-pl", r"microsoft public license|ms pl", "m"), ("postgresql", r"postgresql", "postgresql"), ("openssl", r"openssl", "openssl"), ("vim", r"vim", "vim"), ("zope", r"zope public|zpl", "z"),
)
#: Wordings: pattern around the name, what it says, confidence, keyword. In order of priority.
WORDINGS = (
    ("spdx license identifier {}", "identifier", 1.0, "spdx"), ("(?:is |are )?(?:re)?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?", "grant", 0.95, "under"),
    ("(?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?", "grant", 0.95, "under"), ("subject to the (?:terms of )?(?:the )?{}(?: licen[cs]e)?", "grant", 0.9, "subject to"),
    ("under (?:the )?(?:terms of )?(?:the )?{} licen[cs]e", "grant", 0.9, "under"), ("licen[cs]e {}", "notice", 0.8, "licen"), ("{} licen[cs]e", "notice", 0.7, "licen"), ("(?:dual|triple) licen[cs]ed {}", "grant", 0.85, "licen"),
)
#: Notices that name no licence: label, pattern, confidence, keyword.
NOTICES = (
    ("all-rights-reserved", r"all rights reserved", 0.6, "all rights"), ("copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]", 0.5, "copyright"), ("proprietary", r"proprietary and confidential", 0.9, "proprietary"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.9, "public domain"), ("as-is", r"provided as is without (?:any )?warrant(?:y|ies)", 0.6, "as is"),
    ("permissive", r"permission is hereby granted free of charge", 0.9, "permission"), ("bsd", r"redistribution and use in source and binary forms", 0.9, "redistribution"), ("gpl", r"free software you can redistribute it", 0.8, "redistribute"),
)


class Rule:
    def __init__(self, label: str, pattern: str, score: float, priority: int, keywords: tuple[bytes, ...]):
        self.label, self.score, self.priority, self.keywords = label, score, priority, keywords
        self.find = re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])").finditer


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority; the number 0 marks base phrases."""
    made = [Rule(label, phrase, 1.0, 0, (phrase.encode(),)) for phrase, label in BASE.items()]
    for k, (wording, _, score, keyword) in enumerate(WORDINGS):
        for label, name, start in LICENCES:
            made.append(Rule(label, wording.format(f"(?:{name})"), score, 1 + k, (keyword.encode(), start.encode())))
    for label, pattern, score, keyword in NOTICES:
        made.append(Rule(label, pattern, score, 1 + len(WORDINGS), (keyword.encode(),)))
    return tuple(made)


@lru_cache(maxsize=1)
def gate() -> tuple[bytes, ...]:
    """Keywords one of which every rule needs."""
    return tuple(sorted({r.keywords[0] for r in rules()}))


def detections(joined: bytes) -> tuple[list[tuple[int, int, Rule]], list[tuple[int, int, Rule]]]:
    """Base places, and the other detections left after suppression: (start, end, rule) in bytes."""
    present = {k for k in gate() if k in joined}
    if not present:
        return [], []
    base: list[tuple[int, int, Rule]] = []
    others: list[tuple[int, int, Rule]] = []
    for rule in rules():
        if rule.keywords[0] in present and all(k in joined for k in rule.keywords[1:]):
            (others if rule.priority else base).extend((m.start(), m.end(), rule) for m in rule.find(joined))
    if not others:
        return base, []
    others.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].label))
    accepted: list[tuple[int, int, Rule]] = []
    taken = [(s, e, 0) for s, e, _ in base]
    for start, end, rule in others:
        if not any(s <= start and end <= e or (p < rule.priority and start < e and s < end) for s, e, p in taken):
            accepted.append((start, end, rule))
            taken.append((start, end, rule.priority))
    return base, accepted


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and spans of one text."""
    words = fold_words(text)
    joined = b" ".join(words)
    base, others = detections(joined)
    starts = [joined.count(b" ", 0, s) for s, _, _ in base]
    base_labels = {r.label for _, _, r in base}
    labels = base_labels | {r.label for _, _, r in others}
    spans = sorted((joined.count(b" ", 0, s), joined.count(b" ", 0, e) + 1, r.label) for s, e, r in (*base, *others))
    score = max((r.score for _, _, r in (*base, *others)), default=0.0)
    ends = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(base), *ends, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, [{"first": a, "end": b, "label": c} for a, b, c in spans]


def scan_licences(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, labels, score and the spans in words."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())])))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")

    def work(batch: pa.RecordBatch):
        columns = list(zip(*[scan(t) for t in batch.column(1).to_pylist()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first: long, end: long, label: string>>"
    return map_batches(texts(df, id_col, text_col), work, schema)
