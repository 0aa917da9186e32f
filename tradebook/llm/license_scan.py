"""Licence scan: sentences, lines and paragraphs of a text compared with licence statements by shared word pairs.

A text is cut at line ends and after sentences, and once more into paragraphs, whose lines belong together however they are
wrapped or begun: a paragraph ends at a line without letters or digits, such as an empty one or one of comment signs. Paragraphs of
one line are lines already. Templates are short statements and the paragraphs of common licence files and headers. A piece is normalised (A-Z lower-cased, all but letters and
digits made a space) and turned into its set of word bigrams. Similarity is the Dice coefficient, twice
the shared bigrams over all of both. It can only reach ``LEAST`` if the sizes of both sets are
within a factor of ``(2 - LEAST) / LEAST`` of each other, so templates of other sizes are never compared.

Before that, a piece must have one of a few gate words. They are chosen so that no match is lost: a match
shares at least ``LEAST / (2 - LEAST)`` of a template's bigrams, and fewer than the rest of them are
without a gate word. Templates are literals of the plan: there is no join and no shuffle, and only
DataFrame functions are used.

Defined results: a null or empty text has no piece; pieces of a single word have no bigrams and never match;
among equally similar templates the first by name counts; repeated rows are scanned each; an empty
table gives an empty one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.llm.columns import let, lower_ascii, text_of

LEAST = 0.8
_NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0 License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL-2.0 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL-3.0 License"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1 License"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0 License"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL-2.0 License"),
    "Zlib": ("zlib License",),
}
_LEADS = (
    "Licensed under the {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This project is licensed under the {}.",
    "Distributed under the terms of the {}.",
)
_SENTENCES = {
    "AGPL-3.0": ("You should have received a copy of the GNU Affero General Public License along with this program.",),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL": ("You should have received a copy of the GNU General Public License along with this program.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,",),
    "MIT": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Proprietary": ("All rights reserved.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


#: Paragraphs of licence files and headers, as they are published.
_PARAGRAPHS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    "BSD": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and '
        "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to "
        "the following:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions:",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:",
    ),
}
#: Headers that the GNU licences share but for their names and versions.
_GNU = {"AGPL-3.0": ("Affero ", 3), "GPL-2.0": ("", 2), "GPL-3.0": ("", 3), "LGPL-2.1": ("Lesser ", 2.1), "LGPL-3.0": ("Lesser ", 3)}
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by "
    "the Free Software Foundation, either version {1} of the License, or (at your option) any later version.",
)
_GNU_REST = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.",
    "You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
)


def normalised(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _statements() -> list[tuple[str, str]]:
    """(licence, statement); those that are the same once normalised count once."""
    # Creative Commons short names stand without an article.
    given = [
        (k, lead.format(name) if not name.startswith("CC ") else lead.format(name).replace("the CC", "CC"))
        for k, names in _NAMES.items()
        for name in names
        for lead in _LEADS
    ]
    given += [(k, s) for known in (_SENTENCES, _PARAGRAPHS) for k, sentences in known.items() for s in sentences]
    given += [(k, s.format(*filled)) for k, filled in _GNU.items() for s in _GNU_HEADER]
    given += [(f"{kind}GPL", s.format(name)) for kind, name in (("A", "Affero "), ("", ""), ("L", "Lesser ")) for s in _GNU_REST]
    return list({tuple(normalised(s)): (k, s) for k, s in sorted(given)}.values())


TEMPLATES = _statements()


def gate_words(templates: list[tuple[str, str]], least: float = LEAST) -> list[str]:
    """Words of which every piece as similar as ``least`` to a template has one.

    A piece that matches shares at least ``least / (2 - least)`` of the template's bigrams. So it has a
    gate word if those bigrams of the template that have none are fewer than that.
    """
    sets = [bigrams(normalised(s)) for _, s in templates]
    common = {*"a all an and any are as at be but by do for from has have if in is it may no not of on or other shall should so such that the this to use was will with you".split(), *"0123456789"}
    chosen: set[str] = set()
    for pairs in sets:
        allowed = math.ceil(least / (2 - least) * len(pairs) - 1e-9) - 1
        words = sorted({w for p in pairs for w in p.split()} - common, key=lambda w: (w not in chosen, -sum(w in p.split() for s in sets for p in s), w))
        left = [p for p in pairs if chosen.isdisjoint(p.split())]
        for w in [*words, *sorted(common)]:
            if len(left) <= allowed:
                break
            rest = [p for p in left if w not in p.split()]
            if len(rest) < len(left):
                chosen.add(w)
                left = rest
    return sorted(chosen)


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), "[^a-z0-9]+"), "")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row for each piece of a text that is a licence statement.

    ``docs`` has doc_id and text. The result has doc_id, part (line or paragraph), piece (its number among the text's
    lines and sentences or among its paragraphs, from 0), license, dice and statement (the piece as it stands).
    """
    literal = F.array(
        *(
            F.struct(
                F.lit(i).alias("i"), F.lit(name).alias("license"), F.array(*map(F.lit, pairs)).alias("pairs"), F.lit(len(pairs)).alias("n")
            )
            for i, (name, pairs) in enumerate(sorted((k, bigrams(normalised(s))) for k, s in templates))
        )
    )
    gate = F.lit("(?i)(?<![a-z0-9])(?:" + "|".join(gate_words(templates, least)) + ")(?![a-z0-9])")
    bound = (2 - least) / least

    def best(pairs: Column) -> Column:
        near = F.filter(literal, lambda t: (t["n"] <= bound * F.size(pairs)) & (F.size(pairs) <= bound * t["n"]))
        rated = F.transform(
            near,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(t["pairs"], pairs)) / (F.size(pairs) + t["n"])).alias("dice"),
                (-t["i"]).alias("first"),
                t["license"].alias("license"),
            ),
        )
        return F.array_max(rated)

    def cut(part: str, end: str) -> Column:
        return F.transform(F.split(text_of("text"), end), lambda p, i: F.struct(F.lit(part).alias("part"), i.alias("piece"), F.btrim(p, F.lit(" \n")).alias("statement")))

    paragraphs = F.filter(cut("paragraph", PARAGRAPH_END), lambda p: F.contains(p["statement"], F.lit("\n")))
    gated = F.filter(F.concat(cut("line", PIECE_END), paragraphs), lambda p: F.regexp_like(p["statement"], gate))
    with_gate = docs.select("doc_id", "text").filter(F.regexp_like(text_of("text"), gate))
    found = with_gate.select("doc_id", F.inline(gated)).select(
        "doc_id", "part", "piece", "statement", let(_words(F.col("statement")), lambda w: let(_bigrams(w), best)).alias("best")
    )
    return found.filter(F.col("best.dice") >= least).select(
        "doc_id", "part", F.col("piece").cast("long").alias("piece"), F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), "statement"
    )


#: Line ends, and white space after the end of a sentence.
PIECE_END = "\\n|(?<=[.;:!?]) +"
#: Lines without letters or digits.
PARAGRAPH_END = "\\n[^A-Za-z0-9]*\\n"


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> str:
    """The same for DuckDB, every piece with every template."""
    ordered = sorted((k, bigrams(normalised(s))) for k, s in templates)
    rows = ", ".join(f"({i}, '{k}', [{', '.join(repr(p) for p in pairs)}])" for i, (k, pairs) in enumerate(ordered))
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    # Its regular expressions can't look behind, so ends of sentences are marked first.
    marked = "regexp_replace(coalesce(text, ''), '([.;:!?]) +', '\\1\n', 'g')"
    return f"""
with templates(i, license, pairs) as (values {rows}),
cut as (select doc_id, 'line' as part, string_split({marked}, chr(10)) as parts from documents
    union all select doc_id, 'paragraph', regexp_split_to_array(coalesce(text, ''), '{PARAGRAPH_END}') from documents),
pieces as (select * from (select doc_id, part, unnest(range(len(parts))) as piece, trim(unnest(parts), ' ' || chr(10)) as statement from cut)
    where part = 'line' or contains(statement, chr(10))),
worded as (select *, list_filter(regexp_split_to_array(translate(statement, {letters}), '[^a-z0-9]+'), lambda x: x <> '') as words from pieces),
paired as (select *, list_distinct(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) as own from worded where len(words) > 1),
rated as (select doc_id, part, piece, statement, t.license, t.i, 2.0 * len(list_intersect(t.pairs, own)) / (len(own) + len(t.pairs)) as dice
    from paired, templates t where len(t.pairs) * {least} <= len(own) * (2 - {least}) and len(own) * {least} <= len(t.pairs) * (2 - {least}))
select doc_id, part, piece, license, cast(dice as double) as dice, statement from rated where dice >= {least}
qualify row_number() over (partition by doc_id, part, piece order by dice desc, i) = 1"""
