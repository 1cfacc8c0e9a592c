"""License scan by a positional index of rare words.

Template postings say at which place of which template a word stands.  Document frequencies of the
license words over the whole corpus give their IDF; the words of highest IDF of each template are its
anchors.  Only files that hold an anchor are looked at: each anchor occurrence proposes a start of the
template, the other postings are intersected by relative position, and the template counts as found where
its mandatory key phrase stands word by word and enough of its IDF mass agrees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cellscape.llm.common import text_of

#: Fixed pattern: words are runs of 0-9, a-z and everything beyond ASCII, after A-Z are lower-cased.
LICENSE_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: Anchors per template, and the share of a template's IDF mass that must agree.
ANCHORS = 2
AGREE = 0.6


@dataclass(frozen=True)
class Template:
    """Words of a license line, its label, and the key phrase as (first place, number of words)."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool = False


def template(label: str, text: str, key: str, base: bool = False) -> Template:
    words, phrase = tuple(text.split()), key.split()
    at = next(i for i in range(len(words)) if list(words[i : i + len(phrase)]) == phrase)
    return Template(label, words, (at, len(phrase)), base)


#: The base phrases and their labels.
BASE = [
    template("cc-by", "cc by", "cc by", True),
    template("gpl", "general public license", "general public license", True),
    template("reserved", "all rights reserved", "all rights reserved", True),
]
#: Public license lines with the words that must stand unchanged.
LINES = [
    template("mit", "released under the mit license", "mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("agpl", "gnu affero general public license", "affero general public license"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc0", "to the extent possible under law waived all copyright cc0 1 0", "cc0 1 0"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]


def license_words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(LICENSE_WORD), 1)


def word_idf(docs: DataFrame, templates: list[Template], text: str = "text") -> dict[str, float]:
    """IDF of the templates' words over all documents; as many rows as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = docs.select(F.array_intersect(license_words(text_of(text)), F.array(*[F.lit(w) for w in vocabulary])).alias("__held"))
    counts = held.select(F.explode(F.concat("__held", F.array(F.lit(""))))).groupBy("col").count()
    seen = {r["col"]: r["count"] for r in counts.collect()}  # bounded by the vocabulary; "" counts documents
    return {w: math.log((seen.get("", 0) + 1) / (seen.get(w, 0) + 1)) + 1e-9 for w in vocabulary}


def _anchors(t: Template, idf: dict[str, float]) -> list[int]:
    """Places of the template's rarest words; of a base phrase one is enough, because all its words must stand."""
    places = range(len(t.words))
    if not t.base:
        places = [*range(t.key[0], t.key[0] + t.key[1])]  # the key phrase is mandatory, so its words suffice
    best = sorted(places, key=lambda j: (-idf[t.words[j]], t.words[j], j))
    return sorted(best[: 1 if t.base else ANCHORS])


def _starts(words: Column, hits: Column, t: Template, anchors: list[int]) -> Column:
    """Starts that an anchor proposes and where the key phrase stands."""
    at, length = t.key
    phrase = F.array(*[F.lit(w) for w in t.words[at : at + length]])

    def from_anchor(j: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == t.words[j]), lambda h: h["i"] - j)

    proposed = [from_anchor(j) for j in anchors]
    starts = F.array_distinct(proposed[0] if len(proposed) == 1 else F.concat(*proposed))
    return F.filter(starts, lambda s: (s + at >= 0) & (F.slice(words, F.greatest(s + at, F.lit(0)) + 1, length) == phrase))


def _agreement(words: Column, start: Column, t: Template, idf: dict[str, float]) -> Column:
    """Share of the template's IDF mass whose words stand at their relative places."""
    total = sum(idf[w] for w in t.words)
    found = [F.when((start + j >= 0) & (F.get(words, start + j) == w), F.lit(idf[w])).otherwise(0.0) for j, w in enumerate(t.words)]
    return sum(found[1:], found[0]) / F.lit(total)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", idf: dict[str, float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Null and empty texts: no words, no labels (empty strings), score 0.  Every place of a phrase counts,
    overlapping ones too.  Rows are independent, so repeated rows and ids are all kept; other columns are dropped.
    ``places`` lists (label, start, agreement) of every license line that is found.
    """
    idf = idf if idf is not None else word_idf(docs, BASE + LINES, text)
    chosen = {id(t): _anchors(t, idf) for t in BASE + LINES}
    anchors = F.array(*[F.lit(w) for w in sorted({t.words[j] for t in BASE + LINES for j in chosen[id(t)]})])
    words = F.col("__words")
    rows = docs.select(F.col(doc_id).alias("doc_id"), license_words(text_of(text)).alias("__words"))
    position = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    hits = F.when(F.arrays_overlap(words, anchors), F.filter(position, lambda x: F.array_contains(anchors, x["w"])))
    rows = rows.withColumn("__hits", hits)
    hits = F.col("__hits")

    def places(t: Template) -> Column:
        share = (lambda s: F.lit(1.0)) if t.base else (lambda s: _agreement(words, s, t, idf))
        starts = _starts(words, hits, t, chosen[id(t)])
        return F.transform(starts, lambda s: F.struct(F.lit(t.label).alias("label"), s.cast("int").alias("start"), share(s).alias("agreement")))

    base = [places(t) for t in BASE]
    lines = [F.filter(places(t), lambda p: p["agreement"] >= AGREE) for t in LINES]
    found = rows.select("doc_id", F.size(words).cast("long").alias("n_words"), F.when(hits.isNotNull(), F.concat(*base)).alias("__base"), F.when(hits.isNotNull(), F.concat(*lines)).alias("__lines"))
    none = F.from_json(F.lit("[]"), "array<struct<label:string,start:int,agreement:double>>")
    found = found.withColumns({"__base": F.coalesce("__base", none), "__lines": F.coalesce("__lines", none)})
    every = F.concat("__base", "__lines")
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    start = F.transform("__base", lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        labels(F.col("__base")).alias("base_labels"),
        labels(every).alias("labels"),
        F.coalesce(F.array_max(F.transform(every, lambda p: p["agreement"])), F.lit(0.0)).alias("score"),
        F.col("__lines").alias("places"),
    )
