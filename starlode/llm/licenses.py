"""Licence scans by sentence rules.

A text is cut into sentences (at line ends and after full stops, semicolons and colons
before white space). A normalised sentence (lower case, words of letters and digits only,
"licence" as "license") or a few consecutive ones joined are looked up among the known
licence sentences, which gives the text a sequence of identifiers. Rules are ordered
identifier sequences; a rule matches where its identifiers follow each other with at most
``gap`` other sentences between two of them. Longer rules win over those inside them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known licence sentences and their identifiers, quoted from the public licence texts and their usual notices: fixed values.
SENTENCES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit-title": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache-header": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-notice": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-notice": ["Released under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "bsd-permit": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain"],
    "unlicense-grant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "lgpl2-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl2-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "mpl-title": ["Mozilla Public License Version 2.0"],
    "epl-title": ["Eclipse Public License - v 2.0"],
    "artistic-title": ["The Artistic License 2.0"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}

#: What a notice says before a licence's name.
VERBS = ("licensed under", "released under", "distributed under", "available under", "covered by", "published under")

#: Licences that notices name, by SPDX identifier, and the names that they go by: fixed values.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License", "the Modified BSD License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "GPLv3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "Zlib": ["the zlib License"],
    "Artistic-2.0": ["the Artistic License 2.0", "the Artistic License, version 2.0"],
    "Unlicense": ["the Unlicense", "the Unlicense license"],
    "ISC": ["the ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
}

#: Ordered rules: licence, identifiers.
RULES = [
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-warranty")),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-header", "apache-use")),
    ("Apache-2.0", ("apache-header", "apache-use", "apache-copy")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("BSD-2-Clause", ("bsd-permit", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("Unlicense", ("unlicense-domain", "unlicense-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("LGPL-2.1-or-later", ("lgpl2-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-warranty")),
    ("Apache-2.0", ("apache-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("LGPL-2.1", ("lgpl2-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0", ("agpl-title",)),
    ("MPL-2.0", ("mpl-title",)),
    ("EPL-2.0", ("epl-title",)),
    ("Artistic-2.0", ("artistic-title",)),
]

#: Every known sentence has one of these words (see tests); texts without them hold none.
SIGNS = "licen[cs]e|permission|redistribution|software|warranty|(?:licensed|released|distributed|available|covered|published) (?:under|by)"


@dataclass(frozen=True)
class Settings:
    """gap: foreign sentences allowed between two of a rule."""

    gap: int = 3


@lru_cache(maxsize=1)
def all_sentences() -> dict[str, list[str]]:
    """SENTENCES, and the notices that name one of NAMES after one of VERBS or as an SPDX line."""
    out = {name: list(texts) for name, texts in SENTENCES.items()}
    given = {normalise(t) for texts in SENTENCES.values() for t in texts}
    for spdx, names in NAMES.items():
        made = [f"{start}{verb} {name}" for name in names for verb in VERBS for start in ("", "this work is ", "this project is ", "this software is ", "this file is ")] + [f"SPDX-License-Identifier: {spdx}"]
        out[f"notice-{spdx}"] = [t for t in made if normalise(t) not in given]
    return out


@lru_cache(maxsize=1)
def all_rules() -> list[tuple[str, tuple[str, ...]]]:
    return [*RULES, *((spdx, (f"notice-{spdx}",)) for spdx in NAMES)]


WORD = re.compile(r"[a-z0-9]+")
BREAK = re.compile(r"\n|(?<=[.;:])(?=\s)")


def normalise(text: str) -> str:
    return " ".join(WORD.findall(text.lower())).replace("licence", "license")


@lru_cache(maxsize=1)
def known() -> tuple[dict[str, str], set[str], dict[str, list[int]]]:
    """Identifiers by normalised sentence, the proper beginnings of those sentences at word ends, and rules by first identifier."""
    ids = {normalise(text): name for name, texts in all_sentences().items() for text in texts}
    starts = set()
    for text in ids:
        words = text.split()
        starts |= {" ".join(words[:n]) for n in range(1, len(words))}
    first: dict[str, list[int]] = {}
    for i, (_, sequence) in enumerate(all_rules()):
        first.setdefault(sequence[0], []).append(i)
    return ids, starts, first


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, normalised) of the sentences that have words, in characters."""
    out, at = [], 0
    for cut in [*(m.end() if m[0] else m.start() for m in BREAK.finditer(text)), len(text)]:
        norm = normalise(text[at:cut])
        if norm:
            piece = text[at:cut]
            out.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip()), norm))
        at = cut
    return out


def notice(text: str) -> str | None:
    """The identifier of a grant that a longer sentence ends with ("foo is licensed under the mit license"), unless it denies it."""
    ids = known()[0]
    for verb in VERBS:
        at = text.rfind(f" {verb} ")
        if at >= 0 and not text[:at].endswith((" not", " never")) and text[at + 1 :] in ids:
            return ids[text[at + 1 :]]
    return None


def identify(parts: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(first, last, identifier): known sentences among parts, the longest from each place; a sentence wrapped over lines is several parts."""
    ids, starts, _ = known()
    out, i = [], 0
    while i < len(parts):
        text, best, j = parts[i][2], None, i
        while True:
            if text in ids:
                best = (i, j, ids[text])
            j += 1
            if text not in starts or j == len(parts):
                break
            text += " " + parts[j][2]
        if best is None and (name := notice(parts[i][2])):
            best = (i, i, name)
        if best:
            out.append(best)
        i = best[1] + 1 if best else i + 1
    return out


def scan(text: str, s: Settings = Settings()) -> list[tuple[str, int, int, list[str]]]:
    """(licence, start, stop, identifiers) of the rules that match, in the order of the text."""
    parts = sentences(text)
    found = identify(parts)
    first, out, i = known()[2], [], 0
    while i < len(found):
        best: tuple | None = None
        for rule in first.get(found[i][2], ()):
            name, sequence = all_rules()[rule]
            at, k = i, 1
            while k < len(sequence) and at + 1 < len(found) and found[at + 1][0] - found[at][1] - 1 <= s.gap and found[at + 1][2] == sequence[k]:
                at, k = at + 1, k + 1
            if k == len(sequence) and (best is None or k > len(best[2])):
                best = (name, at, list(sequence))
        if best:
            out.append((best[0], parts[found[i][0]][0], parts[found[best[1]][1]][1], best[2]))
        i = best[1] + 1 if best else i + 1
    return out


def scan_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, licence, start, stop, sentences): a row for each match in a ``text``, in characters.

    Documents without a match have no row: null, empty and all other texts. Rows with one
    id, or none, are scanned each on its own. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in scan(text, settings)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "licence", "start", "stop", "sentences"])

    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(f"(?i){SIGNS}"))
    return signed.mapInArrow(run, "doc_id long, licence string, start long, stop long, sentences array<string>")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "licence", "start", "stop", F.array_join("sentences", ",").alias("sentences"))
