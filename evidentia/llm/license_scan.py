"""Licences by a positional index of rare words.

Templates are notices and paragraphs of licence texts, as word sequences. Document frequencies of all their words are counted over
the corpus; the index has a posting (template, position) for each place of a word that few documents hold. A file looks up its
own licence words of the highest inverse document frequency; postings that agree on where the template would start are
intersected. A template is found where enough of them agree, its words there weigh enough (by inverse document frequency; words
that the corpus doesn't have don't count), and all words of its key phrase stand at their places.

Everything is a row-local expression on the array of a text's words; only the frequencies of the template words (some hundred
numbers) pass through the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A candidate is template * 2^33 + start + 2^32: a start may lie before the text.
_TEMPLATE, _START = 1 << 33, 1 << 32


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str


#: Usual notices and paragraphs of public licences, and the phrase without which a text isn't that licence's.
TEMPLATES = (
    Template("mit", "Released under the MIT License", "mit license"),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions""",
        "to deal in the software without restriction",
    ),
    Template(
        "mit",
        """The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
        warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or
        copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise,
        arising from, out of or in connection with the software or the use or other dealings in the software""",
        "the use or other dealings in the software",
    ),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", "apache license version 2"),
    Template(
        "apache-2",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License""",
        "language governing permissions and limitations under the license",
    ),
    Template("cc-by-nc", "Licensed under CC BY NC 4.0", "cc by nc"),
    Template("cc-by-nc", "Creative Commons Attribution NonCommercial 4.0 International License", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "Licensed under CC BY SA 4.0", "cc by sa"),
    Template("cc-by-sa", "Creative Commons Attribution ShareAlike 4.0 International License", "creative commons attribution sharealike"),
    Template("cc-by", "Creative Commons Attribution 4.0 International License", "creative commons attribution 4"),
    Template("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    Template("gpl-2", "Licensed under the GNU General Public License version 2", "gnu general public license version 2"),
    Template("gpl-3", "Licensed under the GNU General Public License version 3", "gnu general public license version 3"),
    Template(
        "gpl-2",
        """redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation; either version 2 of the License, or (at your option) any later version""",
        "gnu general public license as published by the free software foundation either version 2",
    ),
    Template(
        "gpl-3",
        """redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version""",
        "gnu general public license as published by the free software foundation either version 3",
    ),
    Template("lgpl-2", "Licensed under the GNU Lesser General Public License version 2", "gnu lesser general public license version 2"),
    Template("lgpl-3", "Licensed under the GNU Lesser General Public License version 3", "gnu lesser general public license version 3"),
    Template("agpl-3", "Licensed under the GNU Affero General Public License version 3", "gnu affero general public license version 3"),
    Template(
        "agpl-3",
        """redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version""",
        "gnu affero general public license as published by the free software foundation either version 3",
    ),
    Template("gfdl", "copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "gnu free documentation license"),
    Template("bsd", "Released under the BSD License", "bsd license"),
    Template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met""",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "bsd",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer""",
        "redistributions of source code must retain the above copyright notice",
    ),
    Template(
        "bsd",
        """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution""",
        "redistributions in binary form must reproduce the above copyright notice",
    ),
    Template(
        "bsd-3",
        """may be used to endorse or promote products derived from this software without specific prior written permission""",
        "endorse or promote products derived from this software",
    ),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2"),
    Template("epl-2", "made available under the terms of the Eclipse Public License 2.0", "eclipse public license 2"),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies""",
        "distribute this software for any purpose with or without fee is hereby granted",
    ),
    Template(
        "zlib",
        """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
        and redistribute it freely, subject to the following restrictions""",
        "alter it and redistribute it freely",
    ),
    Template(
        "boost",
        """to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
        Software, and to permit third-parties to whom the Software is furnished to do so""",
        "to prepare derivative works of the software",
    ),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means""",
        "free and unencumbered software",
    ),
    Template("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", "changing it is allowed as long as the name is changed"),
)
#: Phrases of which each place counts, and their labels; BASE_WORDS has a word of each.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_WORDS = ("mit", "apache", "nc")


@dataclass(frozen=True)
class LicenseParams:
    """rare_share, rare_docs: the index has words that at most this share of all documents hold, or so many documents, and the
    rarest of each template. looked_up:
    a file looks up its indexed words with at least this share of their highest inverse document frequency. agreeing: postings
    that must agree on a start (one where the index has one of a template). weight: least share of a template's total inverse
    document frequency."""

    rare_share: float = 0.05
    rare_docs: int = 50
    looked_up: float = 0.35
    agreeing: int = 2
    weight: float = 0.6


def _split(phrase: str) -> list[str]:
    return re.findall(WORD, phrase.lower())


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; none of a null text.

    lower() does that on A-Z; the one other sign that it would turn into an ASCII letter (the Kelvin sign) is set aside first.
    """
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))), F.lit(WORD), F.lit(0))


def template_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each template word."""
    vocabulary = sorted({w for t in templates for w in _split(t.notice)})
    # an empty string stands for the document itself
    found = F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))))
    n = {r["word"]: r["count"] for r in docs.select(found.alias("word")).groupBy("word").count().collect()}
    return n.pop("", 0), n


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively."""

    def starts(w: Column, i: Column) -> Column:
        here = w == phrase[0]
        for k, x in enumerate(phrase[1:], 1):
            here = here & F.coalesce(F.get(words, i + k) == x, F.lit(False))
        return F.when(here, i)

    return F.array_compact(F.transform(words, starts))


def _at(words: Column, place: Column) -> Column:
    return F.when(place >= 0, F.get(words, place))


def scan(docs: DataFrame, params: LicenseParams = LicenseParams(), templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    matches holds (label, start, score) of each template found. A null or empty text has no words, no labels and the score 0.
    Equal matches of two templates of one label give the label once. Repeated rows are scanned alike; other columns are
    ignored; an empty table gives an empty result.
    """
    p = params
    n_docs, df = template_frequencies(docs, templates)
    idf = lambda w: math.log((1 + n_docs) / (1 + df[w])) + 1e-6 if w in df else 0.0
    postings: dict[str, list[tuple[int, int]]] = {}
    facts = []
    for t, x in enumerate(templates):
        words, key = _split(x.notice), _split(x.key)
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        known = [w for w in words if w in df]
        indexed = {w for w in known if df[w] <= max(p.rare_share * n_docs, p.rare_docs)} | {min(known, key=lambda w: (df[w], w), default="")}
        places = [i for i, w in enumerate(words) if w in indexed]
        for i in places:
            postings.setdefault(words[i], []).append((t, i))
        facts.append((x.label, words, [idf(w) for w in words], list(range(at, at + len(key))), min(p.agreeing, len(places))))
    array = lambda x: F.array(*map(F.lit, x))
    known = F.array(*[F.struct(F.lit(a).alias("label"), array(w).alias("words"), array(v).alias("idf"), array(k).alias("key"), F.lit(float(sum(v))).alias("total"), F.lit(n).alias("agreeing")) for a, w, v, k, n in facts])
    # a corpus without any template word has an index with one word that no text holds
    postings = postings or {"": [(0, 0)]}
    lookup = F.create_map(*[c for w, at in sorted(postings.items()) for c in (F.lit(w), array([t * _TEMPLATE + _START - i for t, i in at]))])
    rarity = F.create_map(*[c for w in sorted(postings) for c in (F.lit(w), F.lit(idf(w)))])

    read = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    words = F.col("words")
    base_seen = F.arrays_overlap(words, array(BASE_WORDS))
    for k, (phrase, _) in enumerate(BASE_PHRASES):
        read = read.withColumn(f"base_{k}", F.when(base_seen, _places(words, phrase.split())).otherwise(F.array().cast("array<int>")))
    held = F.filter(words, lambda w: w.isin(sorted(postings)))
    read = read.withColumn("held", F.array_distinct(held)).withColumn("highest", F.array_max(F.transform("held", lambda w: F.element_at(rarity, w))))
    read = read.withColumn("held", F.filter("held", lambda w: F.element_at(rarity, w) >= p.looked_up * F.col("highest")))
    occurs = F.array_compact(F.transform(words, lambda w, i: F.when(F.array_contains("held", w), F.struct(w.alias("w"), i.cast("long").alias("i")))))
    starts = F.flatten(F.transform(occurs, lambda o: F.transform(F.element_at(lookup, o["w"]), lambda q: q + o["i"])))
    read = read.withColumn("starts", F.when(F.size("held") > 0, F.sort_array(starts)))
    template = lambda c: F.get(known, F.shiftright(c, 33).cast("int"))
    start = lambda c: (c.bitwiseAND(F.lit(_TEMPLATE - 1)) - _START).cast("int")
    # equal starts stand side by side: the first of each run long enough is kept
    enough = lambda c, i: F.coalesce(F.get(F.col("starts"), i + template(c)["agreeing"] - 1) == c, F.lit(False))
    read = read.withColumn("starts", F.filter("starts", lambda c, i: ((i == 0) | (F.get(F.col("starts"), i - 1) != c)) & enough(c, i)))

    def weigh(c: Column) -> Column:
        t, first = template(c), start(c)
        sum_up = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0.0), lambda acc, k: acc + F.when(_at(words, first + k) == F.get(t["words"], k), F.get(t["idf"], k)).otherwise(0.0))
        key = F.forall(t["key"], lambda k: F.coalesce(_at(words, first + k) == F.get(t["words"], k), F.lit(False)))
        return F.when(key, F.struct(t["label"].alias("label"), first.alias("start"), F.least(F.lit(1.0), sum_up / F.nullif(t["total"], F.lit(0.0))).alias("score")))

    weighed = F.filter(F.array_compact(F.transform("starts", weigh)), lambda m: m["score"] >= p.weight)
    none = F.array().cast("array<struct<label:string,start:int,score:double>>")
    read = read.withColumn("matches", F.coalesce(weighed.cast("array<struct<label:string,start:int,score:double>>"), none))
    places = F.concat(*[F.col(f"base_{k}") for k in range(len(BASE_PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE_PHRASES)]))
    # a base phrase found is certain
    score = F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return read.select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"), score.alias("score"), "matches",
    )
