"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import map_rows

#: Phrases as words, their labels, and how sure a label is. Fixed values of the contract first.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc0": "cc0",
    "creative commons zero": "cc0",
    "mit license": "mit",
    "the mit licence": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "apache software license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "do what the fuck you want to public license": "wtfpl",
    "server side public license": "sspl",
    "this is free and unencumbered software": "unlicense",
    "public domain": "public-domain",
    "no rights reserved": "public-domain",
    "proprietary and confidential": "proprietary",
}
WEIGHT = {"reserved": 0.5, "public-domain": 0.5}
TAG = "spdx-license-identifier:"
#: How binding licences are, from the least to the most binding class; identifiers without version, the longest that fits counts.
BOUND = ("permissive", "weak-copyleft", "copyleft", "restricted", "unknown")
CLASSES = (
    "0bsd afl apache artistic blueoak bsd bsl bzip2 cc0 cc-by curl fsfap ftl hpnd icu isc json libpng mit ms-pl mulanpsl ncsa ofl openssl pddl php postgresql "
    "psf public-domain python ruby tcl unicode unlicense upl vim w3c wtfpl x11 zlib zpl",
    "apsl cddl cecill-c cpl epl ipl lgpl lppl mpl ms-rl nosl npl spl",
    "agpl cc-by-sa cecill eupl gfdl gpl odbl osl qpl rpl sleepycat",
    "busl cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd elastic polyform proprietary reserved sspl",
)
BINDING = {name: level for level, names in enumerate(CLASSES) for name in names.split()}
ORDER = {"or": 1, "and": 2, "with": 3}
#: Words that may stand between two notices that one expression joins.
BETWEEN = re.compile(r"(?:(?:a|an|any|either|gnu|later|licence|license|licensed|of|only|or later|the|terms|under|v?\d+|version) )*(or|and)(?: (?:a|either|gnu|licence|license|of|terms|the|under|v?\d+|version))*")
NOT_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8: runs of ASCII letters, digits and what is not ASCII."""
    return (text or "").encode().lower().translate(NOT_WORD).split()


def binding(identifier: str) -> int:
    """Class of an identifier by the longest part of it, from its beginning to a hyphen, that is known."""
    parts = identifier.rstrip("+").split("-")
    return next((BINDING[name] for n in range(len(parts), 0, -1) if (name := "-".join(parts[:n])) in BINDING), len(BOUND) - 1)


def evaluate(expression: str) -> tuple[int, set[str]] | None:
    """How binding a licence expression is, and its identifiers; None if it is malformed.

    "or" is a choice, so the least binding side counts; "and" takes the most binding one; "with" adds an exception, which
    loosens a copyleft licence by one. "with" binds closest, "or" least; brackets group.
    """
    tokens = re.findall(r"[()]|[a-z0-9.+:-]+", expression.lower())
    values: list[tuple[int, set[str]]] = []
    waiting: list[str] = []
    operand = True  # whether one is due

    def apply() -> bool:
        op = waiting.pop()
        if op == "(" or len(values) < 2:
            return False
        (b, right), (a, left) = values.pop(), values.pop()
        values.append({"or": (min(a, b), left | right), "and": (max(a, b), left | right), "with": (a - 1 if a in (1, 2) else a, left)}[op])
        return True

    for t in tokens:
        if operand:
            if t == "(":
                waiting.append(t)
            elif t in ORDER or t == ")":
                return None
            else:
                values.append((binding(t), {t}))
                operand = False
        elif t == ")":
            while waiting and waiting[-1] != "(":
                if not apply():
                    return None
            if not waiting:
                return None
            waiting.pop()
        elif t in ORDER:
            while waiting and ORDER.get(waiting[-1], 0) >= ORDER[t]:
                if not apply():
                    return None
            waiting.append(t)
            operand = True
        else:
            break  # prose after the expression
    while waiting:
        if not apply():
            return None
    return values[0] if len(values) == 1 and not operand else None


def within(line: str) -> str:
    """The part of a line before a bracket that closes one opened before it: the tag itself may stand in brackets."""
    depth = 0
    for i, c in enumerate(line):
        depth += (c == "(") - (c == ")")
        if depth < 0 or c in "]}>":
            return line[:i]
    return line


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES):
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in (notices | base).items():
            raw = phrase.encode()
            self.phrases.add_word(f" {raw.decode('latin-1')} ", (len(raw) + 2, label, phrase in base))
        self.tags.add_word(TAG, len(TAG))
        self.phrases.make_automaton()
        self.tags.make_automaton()

    @staticmethod
    def expressions(line: str, spans: list[tuple[int, int, str]]) -> list[str]:
        """Licence expressions of notices: of notices that overlap the longest one, joined where only "or" or "and" stands between."""
        out, last = [], None
        for begin, end, label in sorted(spans, key=lambda s: (s[0], -s[1])):
            if last and begin < last[1]:
                continue
            joined = last and end - last[1] < 200 and BETWEEN.fullmatch(line[last[1] + 1 : begin])
            if joined:
                out[-1] += f" {joined[1]} {label}"
            else:
                out.append(label)
            last = begin, end
        return out

    @staticmethod
    def level(expression: str) -> int:
        return evaluate(expression)[0]

    def row(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = words_of(text)
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        base, labels, places, spans = set(), set(), [], []
        for end, (n, label, is_base) in self.phrases.iter(line):
            labels.add(label)
            spans.append((end - n + 1, end, label))
            if is_base:
                base.add(label)
                places.append(end - n + 1)
        raw = (text or "").encode().lower()
        if TAG.encode() in raw:
            low = raw.decode("utf-8")
            for end, _ in self.tags.iter(low):
                stop = low.find("\n", end)
                found = evaluate(within(low[end + 1 : stop if stop >= 0 else len(low)]))
                labels |= {"spdx-invalid"} if found is None else {BOUND[found[0]], *(f"spdx:{x}" for x in found[1])}
        labels |= {f"terms:{BOUND[level]}" for level in map(self.level, self.expressions(line, spans))}
        left = 1.0
        for label in sorted(labels):
            left *= 1 - (0.0 if label.startswith("terms:") else WEIGHT.get(label, 0.9))
        at = [line.count(" ", 0, p) for p in (min(places), max(places))] if places else [None, None]
        return len(words), len(places), *at, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - left


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: n_words, n_base, first_word, last_word, base_labels, labels, score (0 to 1).

    n_base counts all places of the base phrases, overlapping ones too; a place is the number of its first word. labels: those of
    all notices; of each expression of notices joined by "or" or "and" what it binds to, as terms:<class>; and of each tag its
    identifiers and class, or spdx-invalid. A null or empty text has no words, null places, empty label lists and score 0. A null id
    stays null. Very long texts are scanned whole; equal rows give equal rows; other columns are not read; no rows give no rows.
    """
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def make():
        scan = Scanner().row
        return lambda ids, texts: [ids, *zip(*map(scan, texts), strict=True)]

    return map_rows(docs.select(doc_id, text), make, schema, text)
