"""License scans by sentence rules.

A text is cut into sentences, each normalised to its words: lower-cased runs of
letters and digits, so case, quotes, comment marks, line breaks and punctuation do
not matter, and licence and license are one word.  A table maps known licence
sentences, as word sequences, to identifiers; variable parts (a licence's name and
version, a year) stand in it written out, by rule.  A known sentence is recognised
where its words stand side by side within one sentence of the text, the longest
first.  A document is then its sequence of identifiers, and ordered rules are
matched against it: a rule lists identifiers that follow one another, however many
other sentences stand between them; the first rule that matches names the licence
and takes its sentences out of the game, so a general rule never reads what a more
specific one has used.

Texts are hashed as whole batches; only places whose first words begin a known
sentence are looked up.  A document's work stays in its row: there is no shuffle.

Defined results: null and empty texts and texts without licence sentences have no
licence; a recognised sentence that no rule uses is reported as ``unmatched``;
licences are listed in order of first occurrence, each once; a very long text is
read in slices, whole; repeated rows each get their row; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.arrays import NON_WORD, Words, mix, pieces, words_of
from lorebase.llm.tables import table

#: Sentences of licence texts and notices -> identifier.
TEXTS: tuple[tuple[str, str], ...] = (
    ("mit-grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("as-is", "the software is provided as is, without warranty of any kind"),
    ("as-is", "this software is provided as is, without warranty of any kind"),
    ("as-is", "the software is provided as is and the author disclaims all warranties"),
    ("as-is", "this software is provided by the copyright holders and contributors as is"),
    ("as-is", "this software is provided as is, without any express or implied warranty"),
    ("no-liability", "in no event shall the authors or copyright holders be liable"),
    ("no-liability", "in no event shall the copyright holder or contributors be liable"),
    ("no-liability", "in no event shall the copyright owner or contributors be liable"),
    ("isc-grant", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-grant", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-grant", "redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-endorse", "may not be used to endorse or promote products derived from this software"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display"),
    ("apache-comply", "you may not use this file except in compliance with the license"),
    ("apache-obtain", "you may obtain a copy of the license at"),
    ("apache-asis", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis"),
    ("gnu-free", "this program is free software"),
    ("gnu-free", "this library is free software"),
    ("gnu-free", "is free software: you can redistribute it and/or modify it under the terms of the"),
    ("gnu-later", "or (at your option) any later version"),
    ("gnu-hope", "distributed in the hope that it will be useful"),
    ("gnu-received", "you should have received a copy of the gnu general public license"),
    ("gnu-received", "you should have received a copy of the gnu lesser general public license"),
    ("gnu-received", "you should have received a copy of the gnu affero general public license"),
    ("mpl-form", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-form", "this source code form is subject to the terms of the mozilla public license, v. 2.0"),
    ("apache-terms", "terms and conditions for use, reproduction, and distribution"),
    ("apache-grant", "each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("gpl-2-preamble", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3-preamble", "the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("lgpl-3-preamble", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3-preamble", "the gnu affero general public license is a free, copyleft license for software and other kinds of works"),
    ("cc-accept", "by exercising the licensed rights (defined below), you accept and agree to be bound by the terms and conditions of this"),
    ("boost-grant", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("wtfpl-grant", "you just do what the fuck you want to"),
    ("artistic-intent", "the intent of this document is to state the conditions under which a package may be copied"),
    ("psf-grant", "psf hereby grants licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly"),
    ("busl-grant", "the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "released to the public domain"),
    ("public-domain", "placed in the public domain"),
    ("public-domain", "placed into the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "is in the public domain"),
    ("public-domain", "are in the public domain"),
    ("rights", "all rights reserved"),
    ("spdx", "spdx-license-identifier"),
)
#: Names that say a licence wherever they stand, with the versions they take; {} is the version.
NAMES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("apache-{}", ("apache license", "apache software license"), ("1.0", "1.1", "2.0", "2")),
    ("gpl-{}", ("gnu general public license", "gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation either", "gnu gpl", "general public license"), ("1", "2", "3", "2.0", "3.0", "")),
    ("lgpl-{}", ("gnu lesser general public license", "gnu library general public license", "gnu lesser general public license as published by the free software foundation", "gnu lesser general public license as published by the free software foundation either", "gnu lgpl", "lesser general public license"), ("2", "2.0", "2.1", "3", "3.0", "")),
    ("agpl-{}", ("gnu affero general public license", "gnu affero general public license as published by the free software foundation", "gnu affero general public license as published by the free software foundation either", "gnu agpl", "affero general public license"), ("1", "3", "3.0", "")),
    ("mpl-{}", ("mozilla public license",), ("1.0", "1.1", "2.0", "")),
    ("epl-{}", ("eclipse public license",), ("1.0", "2.0", "")),
    ("bsl-{}", ("boost software license",), ("1.0", "")),
    ("wtfpl-{}", ("do what the fuck you want to public license", "wtfpl"), ("2", "")),
    ("eupl-{}", ("european union public license", "eupl"), ("1.0", "1.1", "1.2", "")),
    ("artistic-{}", ("artistic license", "perl artistic license"), ("1.0", "2.0", "")),
    ("ofl-{}", ("sil open font license", "open font license"), ("1.0", "1.1", "")),
    ("cddl-{}", ("common development and distribution license", "cddl"), ("1.0", "1.1", "")),
    ("psf-{}", ("python software foundation license", "psf license agreement"), ("2", "2.0", "")),
    ("busl-{}", ("business source license",), ("1.1", "")),
    ("cc0-1.0", ("cc0", "cc0 1.0", "creative commons zero"), ("",)),
)
#: Names that are common words too: licences only after an opening.
AFTER_OPENING: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("mit", ("mit license", "expat license", "mit")),
    ("bsd-2-clause", ("2-clause bsd license", "bsd 2-clause license", "simplified bsd license")),
    ("bsd-3-clause", ("3-clause bsd license", "bsd 3-clause license", "new bsd license", "modified bsd license", "revised bsd license")),
    ("bsd-4-clause", ("4-clause bsd license", "bsd 4-clause license", "original bsd license")),
    ("bsd", ("bsd license", "bsd-style license", "bsd style license")),
    ("isc", ("isc license",)),
    ("zlib", ("zlib license",)),
)
VERBS = ("licensed under", "released under", "distributed under", "available under", "provided under", "published under", "covered by", "licensed according to")
ARTICLES = ("", "the", "a", "an", "the terms of the", "the terms of")
#: Short forms of one word: gplv3, lgpl-2.1.
SHORT = (("gpl-{}", "gpl", ("2", "3", "2.0", "3.0")), ("lgpl-{}", "lgpl", ("2.1", "3", "3.0")), ("agpl-{}", "agpl", ("3", "3.0")), ("mpl-{}", "mpl", ("1.1", "2.0")))
CREATIVE = (("cc", "creative commons"), ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0", ""))
CREATIVE_LONG = (("", ""), ("noncommercial", "nc"), ("sharealike", "sa"), ("noderivatives", "nd"), ("noderivs", "nd"), ("noncommercial-sharealike", "nc-sa"), ("noncommercial-noderivatives", "nc-nd"), ("noncommercial-noderivs", "nc-nd"))
SPDX = ("mit", "isc", "zlib", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "apache-2.0", "mpl-2.0", "epl-2.0", "unlicense", "cc0-1.0", "0bsd", "bsl-1.0", "wtfpl", "eupl-1.1", "eupl-1.2", "artistic-1.0", "artistic-2.0", "ofl-1.1", "cddl-1.0", "cddl-1.1", "psf-2.0", "busl-1.1", "cc-by-4.0", "cc-by-sa-4.0", *(f"{g}-{v}{e}" for g, v, e in product(("gpl", "lgpl", "agpl"), ("2.0", "2.1", "3.0"), ("", "-only", "-or-later"))))
YEARS = range(1950, 2100)
#: One character each, so that places in characters stay.
MARKS = "[\u00a0\u2002-\u200a\u2010-\u2015\u2018-\u201f\u2022\u202f]"

#: Ordered rules: identifiers that follow one another -> licence.  ``name:x`` is a sentence that names x.
GNU = tuple(f"{g}{v}" for g, v in product(("agpl", "lgpl", "gpl"), ("-3", "-3.0", "-2.1", "-2", "-2.0", "-1", "")))
RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    *(((f"spdx:{x}",), x) for x in SPDX),
    *(((f"spdx:{x}|{y}",), f"{x}|{y}") for x, y in product(SPDX, SPDX)),
    (("spdx",), "spdx-other"),
    (("unlicense",), "unlicense"),
    (("name:apache-2.0", "apache-comply", "apache-obtain", "apache-asis"), "apache-2.0"),
    (("name:apache-2.0", "apache-terms", "apache-grant"), "apache-2.0"),
    (("name:gpl-2", "gpl-2-preamble"), "gpl-2"),
    (("name:gpl-3", "gpl-3-preamble"), "gpl-3"),
    (("name:agpl-3", "agpl-3-preamble"), "agpl-3"),
    (("name:lgpl-3", "lgpl-3-preamble"), "lgpl-3"),
    (("name:bsl-1.0", "boost-grant"), "bsl-1.0"),
    (("boost-grant",), "bsl-1.0"),
    (("name:wtfpl-2", "wtfpl-grant"), "wtfpl-2"),
    (("name:wtfpl", "wtfpl-grant"), "wtfpl"),
    (("wtfpl-grant",), "wtfpl"),
    (("name:artistic", "artistic-intent"), "artistic"),
    (("artistic-intent",), "artistic"),
    (("psf-grant",), "psf-2"),
    (("busl-grant",), "busl-1.1"),
    (("apache-grant",), "apache-2.0"),
    (("gpl-2-preamble",), "gpl-2"),
    (("gpl-3-preamble",), "gpl-3"),
    (("agpl-3-preamble",), "agpl-3"),
    (("lgpl-3-preamble",), "lgpl-3"),
    (("mit-grant", "mit-notice", "as-is", "no-liability"), "mit"),
    (("mit-grant", "mit-notice", "as-is"), "mit"),
    (("mit-grant", "mit-notice"), "mit"),
    (("mit-grant",), "mit"),
    (("isc-grant", "as-is"), "isc"),
    (("isc-grant",), "isc"),
    (("zlib-grant",), "zlib"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"), "bsd-4-clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "bsd-3-clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "bsd-2-clause"),
    *((("gnu-free", f"name:{x}", "gnu-later", "gnu-hope", "gnu-received"), f"{x}-or-later") for x in GNU),
    *((("gnu-free", f"name:{x}", "gnu-later"), f"{x}-or-later") for x in GNU),
    *((("gnu-free", f"name:{x}", "gnu-hope", "gnu-received"), x) for x in GNU),
    *((("gnu-free", f"name:{x}"), x) for x in GNU),
    *(((f"name:{x}", "gnu-later"), f"{x}-or-later") for x in GNU),
    (("mpl-form",), "mpl-2.0"),
    (("gnu-free", "gnu-hope"), "gpl"),
    (("public-domain",), "public-domain"),
    (("copyright", "rights"), "all-rights-reserved"),
    (("rights",), "all-rights-reserved"),
)


#: Places of the rules that begin with an identifier.
BEGINNING: dict[str, list[int]] = defaultdict(list)
for _place, (_needs, _) in enumerate(RULES):
    BEGINNING[_needs[0]].append(_place)


class Match(NamedTuple):
    licence: str
    start: int
    end: int


def known_sentences() -> Iterator[tuple[str, str]]:
    """(identifier, sentence) of the whole table."""
    yield from TEXTS
    for licence, names, versions in NAMES:
        for name, version in product(names, versions):
            called = licence.format(version).rstrip("-") if "{}" in licence else licence
            called = "apache-2.0" if called == "apache-2" else called
            for form in (("version {}", "ver {}", "v {}", "v{}", "{}") if version else ("",)):
                yield f"name:{called}", f"{name} {form.format(version)}"
    named = [(licence, name) for licence, names in AFTER_OPENING for name in names]
    for (licence, name), verb, article in product(named, VERBS, ARTICLES):
        yield f"name:{licence}", f"{verb} {article} {name}"
    for licence, name, versions in SHORT:
        for version, form in product(versions, ("{}v{}", "{} v{}", "{}-{}", "{}{}")):
            yield f"name:{licence.format(version)}", form.format(name, version)
    for start, kind, version in product(*CREATIVE):
        yield f"name:cc-{kind}{'-' * bool(version)}{version}", f"{start} {kind} {version}"
    for (long, short), version, end in product(CREATIVE_LONG, CREATIVE[2], ("", "international", "license")):
        yield f"name:cc-by{'-' * bool(short)}{short}{'-' * bool(version)}{version}", f"creative commons attribution {long} {version if end != 'license' else ''} {end} {version if end == 'license' else ''}"
    for x in SPDX:
        yield f"spdx:{x}", f"spdx-license-identifier: {x}"
    for x, y, both in product(SPDX, SPDX, ("or", "and")):
        yield f"spdx:{x}|{y}", f"spdx-license-identifier: {x} {both} {y}"
    for year, form in product(YEARS, ("copyright {}", "copyright (c) {}", "copyright © {}", "(c) {}", "© {}")):
        yield "copyright", form.format(year)


def hashed(texts: pa.Array) -> Words:
    """Words as the table has them: typographic marks part words, and the British spelling is the American."""
    words = words_of(pc.replace_substring_regex(texts.cast(pa.large_string()), MARKS, " "), separators=NON_WORD)
    british, american = _spelling()
    for a, b in zip(british, american, strict=True):
        words.hashes[words.hashes == a] = b
    return words


@lru_cache(maxsize=1)
def _spelling() -> tuple[np.ndarray, np.ndarray]:
    return tuple(words_of(pa.array([x]), separators=NON_WORD).hashes for x in ("licence licenced", "license licensed"))


def heads(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position."""
    n = max(len(h) - k + 1, 0)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = mix(total + h[i : i + n])
    return total


class Table:
    """Known sentences by the hash of their first words (three, or all of a shorter one)."""

    def __init__(self) -> None:
        listed = list(known_sentences())
        words = hashed(pa.array([s for _, s in listed]))
        self.by_head: dict[int, dict[int, list[tuple[int, bytes, str]]]] = defaultdict(lambda: defaultdict(list))
        for i, (name, _) in enumerate(listed):
            h = words.hashes[words.offsets[i] : words.offsets[i + 1]]
            k = min(3, len(h))
            self.by_head[k][int(heads(h[:k], k)[0])].append((len(h), h.tobytes(), name))
        self.keys = {}
        for k, entries in self.by_head.items():
            every = np.array(sorted(entries), np.uint64)
            quick = np.zeros(1 << 18, bool)
            quick[(every & np.uint64(len(quick) - 1)).astype(np.int64)] = True
            self.keys[k] = every, quick
            for sentences in entries.values():
                sentences.sort(key=lambda x: -x[0])

    def places(self, h: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """(first word, number of words, identifier) of all known sentences in ``h``, in no order."""
        for k, (every, quick) in self.keys.items():
            begin = heads(h, k)
            at = np.flatnonzero(quick[(begin & np.uint64(len(quick) - 1)).astype(np.int64)])
            at = at[every[np.minimum(np.searchsorted(every, begin[at]), len(every) - 1)] == begin[at]]
            for i in at.tolist():
                for n, words, name in self.by_head[k][int(begin[i])]:
                    if h[i : i + n].tobytes() == words:
                        yield i, n, name


@lru_cache(maxsize=1)
def known() -> Table:
    return Table()


def breaks(words: Words) -> np.ndarray:
    """Number of the sentence that each word stands in; sentences end at stops before white space and at blank lines, but for the stop of a "v." or "ver."."""
    if not len(words.starts):
        return np.zeros(0, np.int64)
    data = words.data
    space = np.isin(data, np.frombuffer(b" \t\r\n\x0b\x0c", np.uint8))
    line = data == 10
    stop = np.isin(data, np.frombuffer(b".!?", np.uint8))
    ends = np.zeros(len(data) + 1, bool)
    ends[1:-1] = stop[:-1] & space[1:]
    at = np.flatnonzero(ends) - 1
    ends[at[_versions(data, at)] + 1] = False
    at = np.flatnonzero(line)
    # two line ends with white space alone between them
    solid = np.r_[0, np.cumsum(~space)]
    if len(at) > 1:
        ends[at[1:][solid[at[1:]] == solid[at[:-1] + 1]]] = True
    number = np.cumsum(ends)[words.starts]
    owner = words.owners()
    return np.cumsum(np.r_[0, (np.diff(number) != 0) | (np.diff(owner) != 0)])


def _versions(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which stops end a word "v" or "ver"?"""
    letter = np.zeros(256, bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    back = lambda k: np.where(stops >= k, data[np.maximum(stops - k, 0)], 32)
    one, two, three, four = (back(k) for k in range(1, 5))
    low = lambda x, c: (x | 32) == ord(c)
    return (data[stops] == ord(".")) & (low(one, "v") & ~letter[two] | low(one, "r") & low(two, "e") & low(three, "v") & ~letter[four])


def recognised(words: Words) -> list[list[tuple[int, int, str]]]:
    """Per text: (first word, after last word, identifier) of its licence sentences, in order; longer ones first where they overlap."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(words.offsets) - 1)]
    sentence = None
    taken: set[int] = set()
    for i, n, name in sorted(known().places(words.hashes), key=lambda x: (-x[1], x[0])):
        sentence = breaks(words) if sentence is None else sentence
        if sentence[i] == sentence[i + n - 1] and taken.isdisjoint(range(i, i + n)):
            taken.update(range(i, i + n))
            out[int(np.searchsorted(words.offsets, i, "right")) - 1].append((i, i + n, name))
    return [sorted(x) for x in out]


def named(found: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """(licence, first word, after last word) by the first rules that match, in order of place."""
    free: dict[str, list[int]] = defaultdict(list)
    for i, (_, _, name) in enumerate(found):
        free[name].append(i)
    out = []
    for place in sorted(i for name in free for i in BEGINNING.get(name, ())):
        needs, licence = RULES[place]
        begin = -1
        while all(free.get(x) for x in needs):
            chain: list[int] = []
            last = begin
            for x in needs:
                at = bisect(free[x], last)
                if at == len(free[x]):
                    break
                chain.append(last := free[x][at])
            if len(chain) < len(needs):
                break
            for x, i in zip(needs, chain, strict=True):
                del free[x][bisect(free[x], i) - 1]
            out += [(one, found[chain[0]][0], found[chain[-1]][1]) for one in dict.fromkeys(licence.split("|"))]
            begin = chain[0]
    for name, rest in free.items():  # a sentence that names a licence is a rule by itself
        out += [(name[5:] if name.startswith("name:") else "unmatched", found[i][0], found[i][1]) for i in rest]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def licences(texts: pa.Array) -> list[tuple[list[Match], int]]:
    """Per text: licences with their spans in characters, and how many licence sentences were recognised."""
    words = hashed(texts)
    found = recognised(words)
    if not any(found):
        return [([], 0)] * len(found)
    chars = np.r_[0, np.cumsum((words.data & 0xC0) != 0x80)]
    # words.data has a mark as one byte; text i begins where its predecessors' characters end
    begin = np.r_[0, np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))]
    return [([Match(name, int(chars[words.starts[a]] - at), int(chars[words.ends[b - 1]] - at)) for name, a, b in named(mine)], len(mine)) for mine, at in zip(found, begin, strict=False)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, distinct licences in order, spans of their sentences in characters, and n_sentences recognised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                found = licences(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([list(dict.fromkeys(m.licence for m in f if m.licence != "unmatched")) for f, _ in found], pa.list_(pa.string())),
                        pa.array([[{"licence": m.licence, "start": m.start, "end": m.end} for m in f] for f, _ in found], pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array([n for _, n in found], pa.int32()),
                    ],
                    names=[id_col, "licences", "spans", "n_sentences"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, licences array<string>, spans array<struct<licence:string,start:int,end:int>>, n_sentences int"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", F.array_join("licences", ",").alias("licences"), "n_sentences", F.size("spans").alias("n_spans"))


QUERIES = {"op8_licences": op8_licences}
ORACLES: dict[str, str] = {}
