"""Fuzzy search for short licence notices.

A notice of length L that may hold k edits is split into k + 1 pieces: at most
k edits leave at least one piece untouched (pigeonhole). One Aho-Corasick pass
finds the pieces; each hit tells where the notice would start, hits that agree
within 2k share a window of bounded length, and the ``regex`` library verifies
the whole notice there with its bounded-error matching and reports span and
edits. So work is linear in the text. Exact base phrases are searched beside it,
on word level.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import flat, spread, text_batches

#: The base phrases and labels of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices (words in lower case, single spaces), their labels, and the edits
#: allowed in characters.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("apache software license version 2 0", "apache-2.0", 3),
    ("released under the mit license", "mit", 2),
    ("licensed under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("permission to use copy modify and or distribute this software", "isc", 5),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("licensed under the bsd license", "bsd", 2),
    ("licensed under the gnu general public license", "gpl", 4),
    ("gnu general public license version", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("gnu free documentation license", "gfdl", 2),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("licensed under cc by nd", "cc-by-nd", 1),
    ("creative commons attribution", "cc-by", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("creative commons attribution non commercial", "cc-by-nc", 3),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("creative commons attribution share alike", "cc-by-sa", 3),
    ("creative commons attribution noderivatives", "cc-by-nd", 3),
    ("all rights reserved", "reserved", 1),
    ("released into the public domain", "public-domain", 3),
    ("dedicated to the public domain", "public-domain", 2),
)

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of the phrase with their places."""
    cut = np.linspace(0, len(phrase), edits + 2).astype(int)
    return [(int(a), phrase[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class NoticeSearch:
    def __init__(self, notices=NOTICES):
        self.notices = notices
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(p, literal_spaces=True)}){{e<={e}}}") for p, _, e in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (phrase, _, edits) in enumerate(notices):
            if len(phrase) <= edits:
                raise ValueError(f"a notice must be longer than its edits: {phrase!r}")
            for at, piece in pieces(phrase, edits):
                seeds.setdefault(piece, []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.machine.add_word(piece, (len(piece), where))
        self.machine.make_automaton()
        self.longer = [[j for j, (q, _, _) in enumerate(notices) if len(q) > len(p) and q.startswith(p)] for p, _, _ in notices]

    def window(self, text: str, k: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """The best match in a window, and likewise what lies before and behind
        it, until nothing of the notice is left: edits, start, end."""
        phrase, _, edits = self.notices[k]
        todo, out = [(lo, hi)], []
        while todo:
            lo, hi = todo.pop()
            m = self.patterns[k].search(text, lo, hi) if hi - lo >= len(phrase) - edits else None
            if m and m.end() > m.start():
                out.append((sum(m.fuzzy_counts), m.start(), m.end()))
                todo += [(lo, m.start()), (m.end(), hi)]
        return out

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Verified matches in normalised text: notice, start, end, edits. Of
        matches of one notice that overlap, the one with fewer edits, then the
        earlier one, counts; every match overlaps one that counts."""
        begins: dict[int, set[int]] = {}
        for end, (size, where) in self.machine.iter(text):
            for k, at in where:
                begins.setdefault(k, set()).add(end + 1 - size - at)
        out = []
        for k, places in begins.items():
            phrase, _, edits = self.notices[k]
            found: set[tuple[int, int, int]] = set()
            first = last = None
            for at in [*sorted(places), None]:
                if first is not None and (at is None or at > first + 2 * edits):
                    found.update(self.window(text, k, max(0, first - edits), min(len(text), last + len(phrase) + edits)))
                    first = None
                first, last = at if first is None else first, at
            taken: list[tuple[int, int, int]] = []  # disjoint, by start
            for e, a, b in sorted(found):
                j = bisect_left(taken, (a, b, 0))
                if (j == 0 or taken[j - 1][1] <= a) and (j == len(taken) or taken[j][0] >= b):
                    insort(taken, (a, b, e))
            out += [(k, a, b, e) for a, b, e in taken]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def outer(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Without matches that go on as a longer notice (``creative commons
        attribution`` before ``noncommercial``)."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for k, a, b, _ in matches:
            spans.setdefault(k, []).append((a, b))

        def goes_on(k: int, a: int, b: int) -> bool:
            for j in self.longer[k]:
                where = spans.get(j, [])
                i = bisect_left(where, (b,)) - 1
                if i >= 0 and where[i][1] > a:
                    return True
            return False

        return [m for m in matches if not goes_on(*m[:3])]


_search: dict[tuple, NoticeSearch] = {}


def scan(docs: DataFrame, notices=NOTICES, base=BASE, text: str = "text", key: str = "doc_id", spans: bool = True) -> DataFrame:
    """Scan every whole text.

    Returns per row: the key, ``n_words``, ``n_base`` (places of base phrases),
    ``first_word`` and ``last_word`` (their smallest and largest start, null if
    none), ``base_labels`` and ``labels`` (distinct, sorted, comma-joined;
    empty if none), ``score`` (1 for a base phrase, otherwise the best
    1 - edits / length, 0 if nothing is found) and, with ``spans``, the fuzzy
    matches with label, first word, last word and edits, by place. Of matches of
    one notice that overlap, the one with fewer edits counts, ties go to the
    earlier one; a notice that goes on as a longer one counts as that alone.
    Null text counts as empty; repeated rows give repeated rows; an empty table
    gives no rows; work is linear in a long text; other columns are not read,
    whatever their names.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    if spans:
        schema += ", matches array<struct<label:string,from_word:bigint,to_word:bigint,edits:int>>"
    search_key = (tuple(notices),)

    def one(raw: bytes, search: NoticeSearch) -> tuple:
        words = raw.translate(_TABLE).split()
        line = b" " + b" ".join(words) + b" "
        places, labels = [], []
        for phrase, label in base:
            needle = f" {phrase} ".encode()
            at = line.find(needle)
            while at >= 0:
                places.append(at)
                labels.append(label)
                at = line.find(needle, at + 1)
        plain = line.decode("latin-1")
        hits = search.outer(search.find(plain))
        found, matches, score = set(labels), [], float(bool(places))
        if not places and not hits:
            return len(words), 0, None, None, "", "", 0.0, []
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        word = lambda at: np.searchsorted(gaps, at, "right") - 1
        starts = word(np.array(places, np.int64)) if places else None
        lows = word(np.array([a + (plain[a] == " ") for _, a, _, _ in hits], np.int64))
        highs = word(np.array([b - 1 - (plain[b - 1] == " ") for _, _, b, _ in hits], np.int64))
        for (k, _, _, e), lo, hi in zip(hits, lows.tolist(), highs.tolist(), strict=True):
            phrase, label, _ = search.notices[k]
            score = max(score, 1 - e / len(phrase))
            matches.append({"label": label, "from_word": lo, "to_word": max(lo, hi), "edits": e})
        all_ = found | {m["label"] for m in matches}
        lo, hi = (int(starts.min()), int(starts.max())) if places else (None, None)
        return len(words), len(places), lo, hi, ",".join(sorted(found)), ",".join(sorted(all_)), score, matches

    def run(batches):
        search = _search.get(search_key) or _search.setdefault(search_key, NoticeSearch(notices))
        for batch in batches:
            data, offsets = flat(batch.column(1))
            raw = data.tobytes()
            rows = [one(raw[a:b], search) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            n_words, n_base, first, last, own, all_, score, matches = map(list, zip(*rows, strict=True)) if rows else ([] for _ in range(8))
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)), pa.array(own, pa.string()), pa.array(all_, pa.string()), pa.array(score, pa.float64())]
            names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            if spans:
                cols.append(pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("from_word", pa.int64()), ("to_word", pa.int64()), ("edits", pa.int32())]))))
                names.append("matches")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return spread(docs.select(key, text)).mapInArrow(run, schema)
