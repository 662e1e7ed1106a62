"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text is one sequence of normalised words, and a unit is a window of it. With a
template of b distinct bigrams, a window of n bigrams that holds d of them has
the Dice coefficient 2 d / (b + n). Windows are cut where they can score: they begin
where a run of the template's bigrams begins and end where one does, or, if the run
goes on, after b bigrams. Size bounds prune: for Dice >= t a window holds at most
b (2 - t) / t bigrams and at least b t / (2 - t) of the template's, so only places
where so many lie so close are scored. A statement inside a longer line and a
licence of several paragraphs inside a longer text are thus found alike.

All is one projection of DataFrame functions over a row; the templates are
literals of fixed size.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Licence statements, headers and texts, without their copyright lines.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {holders}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "{first}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{second}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. {third}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "{this} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{version}, "
    "or (at your option) any later version. {this} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with {that}"
)
TEMPLATES = {
    "agpl-3.0-header": _GNU.format(this="This program", colon=":", kind="Affero General Public License", version=", either version 3 of the License", that="this program."),
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": _BSD.format(first="1. ", second="2. ", third=""),
    "bsd-3-clause": _BSD.format(
        first="1. ",
        second="2. ",
        third="3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. ",
    ),
    "bsd-statement": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
        "permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
        'processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "cc-by-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-statement": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-header": _GNU.format(this="This program", colon=";", kind="General Public License", version="; either version 2 of the License", that="this program"),
    "gpl-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": _GNU.format(this="This program", colon=":", kind="General Public License", version=", either version 3 of the License", that="this program."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO '
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "lgpl-2.1-header": _GNU.format(this="This library", colon=";", kind="Lesser General Public License", version="; either version 2.1 of the License", that="this library"),
    "lgpl-3.0-header": _GNU.format(this="This program", colon=":", kind="Lesser General Public License", version=", either version 3 of the License", that="this program."),
    "mit-statement": "Released under the MIT License.",
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    )
    + _AS_IS.format(holders="OR COPYRIGHT HOLDERS "),
    "mpl-2.0-statement": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense-statement": "This is free and unencumbered software released into the public domain.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for "
        "the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity "
        "of all present and future rights to this software under copyright law. "
    )
    + _AS_IS.format(holders=""),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you "
        "use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


def words(text: str) -> list[str]:
    return [w for w in re.sub("[^a-z0-9]+", " ", text.lower()).split(" ") if w]


def bigrams(text: str) -> list[str]:
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def bounds(b: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bigrams of a template of b that a window must hold, bigrams it may have) for the threshold."""
    return math.ceil(b * threshold / (2 - threshold) - 1e-9), math.floor(b * (2 - threshold) / threshold + 1e-9)


# The projection is one SQL expression: as single calls, its thousands of literals take seconds to hand over.


def _texts(values) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _bound(value: str, name: str, body: str) -> str:
    """body with value as the variable name, worked out once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _range(low: str, high: str) -> str:
    return f"if({low} <= {high}, sequence({low}, {high}), cast(array() as array<int>))"


def _places(text: str, grams: dict[str, list[str]]) -> str:
    """(i, g): places in the sequence of words where a bigram of any template stands.

    Words are looked up before they are joined: few places have two that templates have in such order.
    """
    every = sorted({g for gs in grams.values() for g in gs})
    first, second = (_texts(sorted({g.split(" ")[k] for g in every})) for k in (0, 1))
    able = f"filter(sequence(0, size(w) - 2), i -> get(w, i) in ({first}) and get(w, i + 1) in ({second}))"
    pairs = f"transform({able}, i -> named_struct('i', i, 'g', concat_ws(' ', get(w, i), get(w, i + 1))))"
    found = f"if(size(w) > 1, filter({pairs}, x -> x.g in ({_texts(every)})), cast(array() as array<struct<i:int,g:string>>))"
    return _bound(f"filter(split(lower(coalesce({text}, '')), '[^a-z0-9]+'), x -> x <> '')", "w", found)


def _best(places: str, grams: list[str], threshold: float) -> str:
    """The largest Dice coefficient of a window with one template; null if none can reach the threshold."""
    b = len(grams)
    need, most = bounds(b, threshold)
    at = lambda j: f"get(p, {j}).i"
    span = f"{at('e')} - {at('j')}"
    opens = f"(j = 0 or {at('j - 1')} <> {at('j')} - 1)"
    starts = f"filter({_range('0', f'size(p) - {need}')}, j -> {opens} and {at(f'j + {need - 1}')} - {at('j')} < {most})"
    closes = f"(e = size(p) - 1 or {at('e + 1')} <> {at('e')} + 1)"
    full = f"({span} < {b} and (e = size(p) - 1 or {at('e + 1')} - {at('j')} >= {b}))"
    ends = f"filter({_range(f'j + {need - 1}', f'least(size(p) - 1, j + {most - 1})')}, e -> {span} < {most} and ({closes} or {full}))"
    distinct = "size(array_distinct(transform(slice(p, j + 1, e - j + 1), x -> x.g)))"
    windows = f"array_max(transform({ends}, e -> 2.0D * {distinct} / ({span} + {b + 1})))"
    own = f"filter({places}, x -> x.g in ({_texts(grams)}))"
    return f"if(size({places}) >= {need}, {_bound(own, 'p', f'array_max(transform({starts}, j -> {windows}))')}, null)"


def hits(text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> Column:
    """Array of (license, dice), by license: per template the best window of the column text at or above threshold."""
    grams = {k: g for k, t in sorted((templates or TEMPLATES).items()) if (g := bigrams(t))}
    fewest = min(bounds(len(g), threshold)[0] for g in grams.values())
    rows = ", ".join(f"named_struct('license', {_texts([k])}, 'dice', {_best('h', g, threshold)})" for k, g in grams.items())
    scored = f"if(size(h) >= {fewest}, filter(array({rows}), x -> x.dice >= {threshold}D), cast(array() as array<struct<license:string,dice:double>>))"
    name = "`" + text.replace("`", "``") + "`"
    return F.expr(_bound(_places(name, grams), "h", scored))


def scan(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Append license_hits, an array of (license, dice), to every row of df, replacing such a column.

    Null and empty texts, and texts without words, have an empty array. Of several
    windows near a template the best one counts; repeated rows get the same.
    """
    return df.withColumn("license_hits", hits(text, templates, threshold))
