"""License scan: lines, paragraphs and whole texts against licence templates, by Dice.

Text is normalised (lower case, letters and digits alone).  Notices (TEMPLATES:
short ones, and each paragraph of the licence texts) are compared with units:
each line, and each paragraph of several lines.  Whole licence texts (TEXTS)
are compared with every run of consecutive paragraphs, the whole text among
them, so that a licence is found within a longer file and however its lines are
wrapped.  All are sets of word bigrams; a match has 2 * shared / (own +
template's) of THRESHOLD or more.  A notice between other words of one line is
found only as far as the line as a whole reaches the threshold.

Two bounds prune, and neither loses a match.  By size, a template of n bigrams
can only match units of n * t / (2 - t) to n * (2 - t) / t bigrams.  By words,
each template has a few words (anchors) without which the bigrams that are
left don't reach the threshold: a text or unit with no anchor is never cut
into bigrams.  All of this is built-in expressions within a row: no shuffle,
and no Python.

Nulls: a null text counts as empty.  Ties go to the template first by name.
A null doc_id is kept, repeated rows each give a row, other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Paragraphs of licence texts, and of the notices that their authors ask for.
PARAGRAPHS = {
    "Apache-2.0-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-place": "http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-source": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary": "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-name": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-3.0-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-place": "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "Unlicense-rights": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense-dedication": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib-warranty": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Zlib-origin": "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "Zlib-altered": "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "Zlib-notice": "3. This notice may not be removed or altered from any source distribution.",
}
#: The paragraphs of each whole text, in order.
TEXTS = {
    name: "\n\n".join(PARAGRAPHS[p] for p in parts.split())
    for name, parts in {
        "Apache-2.0": "Apache-2.0-grant Apache-2.0-place Apache-2.0-warranty",
        "BSD-2-Clause": "BSD-grant BSD-source BSD-binary BSD-warranty",
        "BSD-3-Clause": "BSD-grant BSD-source BSD-binary BSD-name BSD-warranty",
        "GPL-3.0": "GPL-3.0-grant GPL-3.0-warranty GPL-3.0-place",
        "ISC": "ISC-grant ISC-warranty",
        "MIT": "MIT-grant MIT-notice MIT-warranty",
        "MPL-2.0": "MPL-2.0-notice",
        "Unlicense": "Unlicense-grant Unlicense-rights Unlicense-dedication MIT-warranty",
        "Zlib": "Zlib-warranty Zlib-grant Zlib-origin Zlib-altered Zlib-notice",
    }.items()
}
#: Short notices by which texts state their licence.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Paragraphs that say too little alone, or say what a notice says, are no templates of their own.
TEMPLATES = NOTICES | {name: t for name, t in PARAGRAPHS.items() if name not in ("Apache-2.0-place", "BSD-grant", "Unlicense-grant")}
#: Letters of words that are rare enough.
LONG = 5
NOT_WORD = r"[^\p{L}\p{N}]+"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(bigrams: list[str], threshold: float, known: frozenset[str] = frozenset()) -> list[str]:
    """Words until the bigrams that hold none of them can't reach the threshold.

    Long words come first, since those are rare: of LONG letters or more, those
    that other templates need anyway (known) and then those in most bigrams.
    """
    out: list[str] = []
    left = list(bigrams)
    # With k shared bigrams, Dice is 2k / (own + n) <= 2k / (k + n).
    while 2 * len(left) >= threshold * (len(left) + len(bigrams)):
        words = Counter(w for b in left for w in set(b.split()))
        word = max(words, key=lambda w: (min(len(w), LONG), w in known, words[w], len(w), w))
        out.append(word)
        left = [b for b in left if word not in b.split()]
    return out


def marks_of(templates: list[list[str]], threshold: float) -> list[str]:
    """Anchors of all templates, the short ones' first, shared as far as they can be."""
    out: list[str] = []
    for b in sorted(templates, key=len):
        out += [w for w in anchors(b, threshold, frozenset(out)) if w not in out]
    return out


def bounds(n: int, threshold: float) -> tuple[float, float]:
    """Least and most bigrams of a unit that can match a template of n."""
    return n * threshold / (2 - threshold), n * (2 - threshold) / threshold


def normal(unit: Column) -> Column:
    return F.trim(F.regexp_replace(unit, NOT_WORD, " "))


def bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a normalised unit."""
    words = F.split(unit, " ")
    pairs = F.arrays_zip(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))
    return F.array_distinct(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"])))


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def best_of(templates: dict[str, list[str]], own: Column, threshold: float) -> Column:
    """Best template of a set of bigrams, as (dice, rank, license), among those whose size bounds hold; null without a match."""
    size, order = F.size(own), F.array(*map(F.lit, templates))
    each = []
    for name, b in templates.items():
        lo, hi = bounds(len(b), threshold)
        dice = 2.0 * F.size(F.array_intersect(own, F.array(*map(F.lit, b)))) / (size + len(b))
        each.append(F.when(size.between(lo, hi), F.struct(F.round(dice, 6).alias("dice"), F.lit(name).alias("license"))))
    fits = F.filter(F.array(*each), lambda x: x.isNotNull() & (x["dice"] >= threshold))
    return F.array_max(F.transform(fits, lambda x: F.struct(x["dice"], (-F.array_position(order, x["license"])).alias("rank"), x["license"])))


def words_in(unit: Column) -> Column:
    """Words of a normalised unit."""
    return F.length(unit) - F.length(F.replace(unit, F.lit(" "), F.lit(""))) + 1


def paragraph_runs(paragraphs: Column, low: int, high: int) -> Column:
    """Every run of consecutive normalised paragraphs with low to high words, joined.

    A bound on bigrams is none on words, since bigrams may repeat: high is one
    on the words that a text may have at most.
    """
    count = F.transform(paragraphs, words_in)
    ends = F.aggregate(count, F.array(F.lit(0)), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))
    held = F.struct(paragraphs.alias("parts"), ends.alias("ends"))
    # The running sums are bound once, as the only element of an array.
    return F.flatten(F.transform(F.array(held), lambda h: F.flatten(F.transform(F.sequence(F.lit(1), F.size(h["parts"])), lambda i: F.transform(
        F.filter(F.sequence(i, F.size(h["parts"])), lambda j: (F.element_at(h["ends"], j + 1) - F.element_at(h["ends"], i)).between(low, high)),
        lambda j: F.array_join(F.slice(h["parts"], i, j - i + 1), " "),
    )))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_matches, license, dice, matches, text_license, text_dice) of each row.

    license is the best notice of all units, n_matches the number of units that
    match one, matches an array of (unit, license, dice); a unit counts for its
    best template alone.  text_license is the best whole text of all runs of
    paragraphs.
    """
    known = {name: template_bigrams(t) for name, t in sorted((templates or TEMPLATES).items())}
    whole = {name: template_bigrams(t) for name, t in sorted((texts or TEXTS).items())}
    marks, whole_marks = (marks_of(list(b.values()), threshold) for b in (known, whole))
    low = min(bounds(len(b), threshold)[0] for b in known.values())
    high = max(bounds(len(b), threshold)[1] for b in known.values())
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    lines, parts = F.split(lower, "\n"), F.split(lower, "\n\\s*\n")
    likely = F.filter(F.transform(F.concat(lines, F.filter(parts, lambda p: F.contains(F.trim(p), F.lit("\n")))), normal), lambda u: has_any(u, marks) & (words_in(u) > low))
    sets = F.filter(F.transform(likely, lambda u: F.struct(u.alias("unit"), bigrams(u).alias("own"))), lambda s: F.size(s["own"]).between(low, high))
    scored = F.transform(sets, lambda s: F.struct(s["unit"].alias("unit"), best_of(known, s["own"], threshold).alias("best")))
    found = F.transform(F.filter(scored, lambda s: s["best"].isNotNull()), lambda s: F.struct(s["unit"].alias("unit"), s["best"]["license"].alias("license"), s["best"]["dice"].alias("dice")))
    kind = "array<struct<unit: string, license: string, dice: double>>"
    least, most = word_bounds(whole, threshold)
    runs = F.filter(paragraph_runs(F.filter(F.transform(parts, normal), lambda p: p != ""), least, most), lambda u: has_any(u, whole_marks))
    texts_found = F.filter(F.transform(runs, lambda u: best_of(whole, bigrams(u), threshold)), lambda b: b.isNotNull())
    # The words of a text are looked up in one set of all anchors; few texts go on.
    anchored = F.arrays_overlap(F.split(normal(lower), " "), F.array(*map(F.lit, dict.fromkeys(marks + whole_marks))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.when(anchored, F.struct(found.alias("matches"), F.array_max(texts_found).alias("whole"))).alias("hit"))
    rows = rows.select("doc_id", F.coalesce("hit.matches", F.array().cast(kind)).alias("matches"), F.col("hit.whole").alias("whole"))
    order = F.array(*map(F.lit, known))
    top = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"], (-F.array_position(order, m["license"])).alias("rank"), m["license"].alias("license"))))
    return rows.select("doc_id", F.size("matches").cast("long").alias("n_matches"), top["license"].alias("license"), top["dice"].alias("dice"), "matches", F.col("whole.license").alias("text_license"), F.col("whole.dice").alias("text_dice"))


#: Words of a run are at most so many times the bigrams that may match: a run that says the same over and over isn't a licence text.
REPEATED = 2


def word_bounds(templates: dict[str, list[str]], threshold: float) -> tuple[int, int]:
    """Least and most words of a run of paragraphs that is compared with the whole texts."""
    sizes = [bounds(len(b), threshold) for b in templates.values()]
    return int(min(lo for lo, _ in sizes)), int(max(hi for _, hi in sizes) * REPEATED)


def oracle() -> str:
    """DuckDB SQL of op4's rows: the same answer without any pruning by words."""
    rendered = lambda named: ", ".join("('" + name + "', [" + ", ".join(f"'{b}'" for b in template_bigrams(t)) + "])" for name, t in sorted(named.items()))
    norm = lambda x: f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    pairs = "list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS own"
    least, most = word_bounds({name: template_bigrams(t) for name, t in TEXTS.items()}, THRESHOLD)
    dice = "round(2.0 * len(list_intersect(b.own, t.own)) / (len(b.own) + len(t.own)), 6) AS dice"
    return f"""WITH t(license, own) AS (VALUES {rendered(TEMPLATES)}),
    tt(license, own) AS (VALUES {rendered(TEXTS)}),
    d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS x FROM documents),
    u AS (SELECT r, unnest(string_split(x, chr(10))) AS unit FROM d
      UNION ALL SELECT r, p FROM (SELECT r, unnest(regexp_split_to_array(x, '\\n\\s*\\n')) AS p FROM d) WHERE contains(trim(p, ' '), chr(10))),
    w AS (SELECT r, row_number() OVER () AS k, string_split({norm('unit')}, ' ') AS words FROM u),
    b AS (SELECT r, k, {pairs} FROM w WHERE len(words) > 1),
    s AS (SELECT r, k, license, {dice} FROM b, t WHERE list_has_any(b.own, t.own)),
    m AS (SELECT r, k, license, dice, row_number() OVER (PARTITION BY r, k ORDER BY dice DESC, license) AS n FROM s WHERE dice >= {THRESHOLD}),
    g AS (SELECT r, count(*) AS n_matches, first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice FROM m WHERE n = 1 GROUP BY r),
    p AS (SELECT r, list_filter(list_transform(regexp_split_to_array(x, '\\n\\s*\\n'), lambda y: {norm('y')}), lambda y: y <> '') AS parts FROM d),
    i AS (SELECT r, parts, unnest(range(1, len(parts) + 1)) AS a FROM p),
    j AS (SELECT r, string_split(array_to_string(parts[a:z], ' '), ' ') AS words FROM (SELECT r, parts, a, unnest(range(a, len(parts) + 1)) AS z FROM i)),
    bb AS (SELECT r, {pairs} FROM j WHERE len(words) BETWEEN {least} AND {most}),
    ss AS (SELECT r, license, {dice.replace('t.own', 'tt.own')} FROM bb b, tt WHERE list_has_any(b.own, tt.own)),
    gg AS (SELECT r, first(license ORDER BY dice DESC, license) AS text_license, max(dice) AS text_dice FROM ss WHERE dice >= {THRESHOLD} GROUP BY r)
    SELECT d.doc_id, coalesce(g.n_matches, 0) AS n_matches, g.license, g.dice, gg.text_license, gg.text_dice FROM d LEFT JOIN g ON d.r = g.r LEFT JOIN gg ON d.r = gg.r"""
