"""License scans by a positional rare-token index.

Index: every notice template lists its ``RARE`` words of highest IDF (document frequencies are counted over all
documents) with their positions. Of a file, the index words it holds are looked up from the highest IDF down, and
each posting votes for the place where the template would start. Places at which enough different rare words agree
(up to ``SLACK`` words apart, so that inserted or dropped words do not matter) are verified: the template's mandatory
key phrases must stand in the file there, word by word, and at least half of its words.

The base phrases are templates whose whole text is mandatory and must stand without a gap; their rarest word alone
is looked up, at each of its places, so all places of a phrase are found.

Scale: one narrow pass for the document frequencies (a row per template word and task), one for the scan. The
index has as many entries as the templates have words. A task holds the words of one text.

Defined cases: null and empty texts have no words and score 0; repeated rows and null ids are scanned like any
other; empty tables give empty results; other columns are ignored. A phrase that overlaps itself counts at each place.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import whole_text

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RARE, SLACK, COVER = 3, 3, 0.5

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices (label, notice, mandatory key phrases).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license "
                   "is distributed on an as is basis", ["distributed under the license", "as is"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ["permission is hereby granted", "free of charge"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["gnu general public license", "version 3"]),
    ("gpl-2.0", "this program is licensed under the gnu general public license version 2",
     ["gnu general public license", "version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use", "source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0", ["cc0 1 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     ["with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]


def words_of(text: str) -> list[bytes]:
    """Words of the text, A-Z lower-cased; bytes from 0x80 up are word bytes, so UTF-8 needs no decoding."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Template:
    def __init__(self, label: str, notice: str, phrases: list[str], base: bool):
        self.label, self.base = label, base
        self.words = words_of(notice)
        self.phrases = [words_of(p) for p in phrases]


def all_templates(templates=tuple(TEMPLATES), base=tuple(BASE.items())) -> list[Template]:
    return ([Template(label, phrase, [phrase], True) for phrase, label in base]
            + [Template(label, notice, phrases, False) for label, notice, phrases in templates])


def document_frequencies(docs: DataFrame, vocabulary: frozenset) -> tuple[dict, int]:
    """Documents that hold each template word, and all documents."""
    def count(frames):
        held, n = Counter(), 0
        for frame in frames:
            n += len(frame)
            for text in frame["text"]:
                held.update(vocabulary.intersection(words_of(text)))
        yield pd.DataFrame([("", n), *((w.decode(), c) for w, c in held.items())], columns=["word", "n"])

    rows = (docs.select(whole_text(F.col("text")).alias("text")).mapInPandas(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())  # a row for each template word
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


class Index:
    """word -> IDF, and word -> [(template, position)] for the rare words of each template."""

    def __init__(self, templates: list[Template], held: dict, n_docs: int):
        self.templates, self.idf = templates, {}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for t, template in enumerate(templates):
            idf = {w: math.log((n_docs + 1) / (held.get(w, 0) + 1)) for w in template.words}
            rare = sorted(idf, key=lambda w: (-idf[w], w))[:1 if template.base else RARE]
            self.need.append(min(2, len(rare)))
            for at, word in enumerate(template.words):
                if word in rare:
                    self.postings[word].append((t, at))
                    self.idf[word] = idf[word]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places (first word, label) of base phrases, and label -> best share of a template's words."""
        idf = self.idf
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in idf:
                places[w].append(i)
        votes: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for word in sorted(places, key=lambda w: (-idf[w], w)):
            for t, at in self.postings[word]:
                for i in places[word]:
                    votes[t][i - at].add(word)
        base, labels = [], {}
        for t, starts in votes.items():
            template, n = self.templates[t], len(self.templates[t].words)
            for start in sorted(starts):
                if template.base:
                    if start >= 0 and words[start:start + n] == template.words:
                        base.append((start, template.label))
                        labels[template.label] = 1.0
                    continue
                agree = set().union(*(starts.get(s, ()) for s in range(start - SLACK, start + SLACK + 1)))
                if len(agree) < self.need[t]:
                    continue
                here = words[max(0, start - SLACK):start + n + SLACK]
                if all(any(here[i:i + len(p)] == p for i in range(len(here) - len(p) + 1)) for p in template.phrases):
                    share = sum((Counter(here) & Counter(template.words)).values()) / n
                    if share >= COVER:
                        labels[template.label] = max(labels.get(template.label, 0.0), share)
        return base, labels


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = templates or all_templates()
    index = Index(templates, *document_frequencies(docs, frozenset(w for t in templates for w in t.words)))

    def scan(frames):
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                words = words_of(text)
                base, labels = index.scan(words)
                starts = [s for s, _ in base]
                out.append((doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                            ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), max(labels.values(), default=0.0)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield frame.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return (docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")).alias("text")).mapInPandas(scan, RESULT))
