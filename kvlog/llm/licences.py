"""Licence scans: documents whose whole text is a known licence.

Texts are put into one canonical form (NFKC and case folding, copyright notices that
have a line of their own or lead to the licence dropped, equivalent spellings made one, punctuation and white space runs one space) and joined
to the known ones by a 128-bit hash of it.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlog.llm.common import NULL_KEY, doc_id
from kvlog.llm.fingerprints import canonical, digest

# Spellings that count as equal, the second written as the first.
SPELLINGS = [("license", "licence"), ("organization", "organisation"), ("authorized", "authorised"), ("merchantability", "merchantibility"), ("favor", "favour"), ("noncommercial", "non commercial"), ("sublicense", "sub license"), ("copyright holder", "copyright owner")]


# Texts of public licences, to which callers may add theirs. Longer ones lie in ``licence_texts``.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
KNOWN |= {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
# Titles that may stand above the texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "BSD License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
_END = "END OF TERMS AND CONDITIONS"


def _variants(name: str) -> list[str]:
    """The text, its part before the advice on how to apply it, links of either scheme,
    and each of them below its titles."""
    out = [KNOWN[name]]
    if _END in out[0]:
        terms = out[0][: out[0].index(_END)]
        out += [terms, terms + _END]
    out += [t.replace("https://", "http://") for t in out if "https://" in t]
    return out + [f"{title}\n{t}" for title in TITLES.get(name, []) for t in out]


TEXTS = {name: _variants(name) for name in KNOWN}


# A notice: a mark, years or a place for them, and a holder of bounded length without a sentence in it.
_YEARS = r"(?:\d{4}|19yy|yyyy|[<\[{][^\n\r>\]}]{1,40}[>\]}])"
_WORD = r"(?:[^\s.,;!?@]{1,60}|[^\s,]{0,60}[.@][^\s,]{0,60}[\p{L}\p{N}>)/]|(?:\p{L}|inc|ltd|llc|co|corp|jr|sr|al)\.)"


def _notice(space: str, apart: str) -> str:
    mark = rf"(?:(?:copyright{space}*(?:\(c\)|©)|©{space}*copyright){space}*:?|copyright(?:{space}|:)*(?={_YEARS})|(?:\(c\)|©){space}*(?={_YEARS}))(?:{space}*{_YEARS}(?:{space}*[-–]{space}*\w{{1,7}})?)?"
    return rf"{mark}(?:{apart}+{_WORD}){{0,16}}(?:{space}|[.,;])*(?:all rights reserved(?:{space}|\.)*)?"


_LINE = r"(?im)^[^\p{L}\p{N}\n\r(©]*" + _notice(r"[ \t]", r"[ \t,]") + r"[*/#\-]*[ \t]*$"
_RESERVED = r"(?im)^[^\p{L}\p{N}\n\r]*all rights reserved[ \t.*/#\-]*$"
#: Words by which a licence's beginning is known.
_OPENING = 5
_GAP = r"[^\p{L}\p{N}]+"


def _phrase(x: str, most: int) -> str:
    """A pattern for the first words of a text, in any case and spelling."""
    same = {w: f"(?:{a}|{b})" for a, b in SPELLINGS if " " not in a + b for w in (a, b)}
    return _GAP.join(same.get(w, w) for w in re.findall(r"[^\W_]+", x.lower())[:most])


def licence_form(col: str, openings: list[str]) -> Column:
    """A column of texts without copyright notices: those that lead, after a title or
    none, to the first words of a licence, and lines that are a notice and nothing else."""
    x = F.col(col)
    if openings:
        titles = "|".join(sorted({_phrase(t, 99) for of in TITLES.values() for t in of}, key=len, reverse=True))
        x = F.regexp_replace(x, rf"(?i)^([^\p{{L}}\p{{N}}(©]*(?:(?:{titles})\b[^\p{{L}}\p{{N}}(©]*)?)(?:{_notice(chr(92) + 's', '[' + chr(92) + 's,]')})+(?=[^\p{{L}}\p{{N}}]*(?:{'|'.join(openings)})\b)", "$1 ")
    return F.regexp_replace(F.regexp_replace(x, _LINE, " "), _RESERVED, " ")


def _form(df: DataFrame, col: str, openings: list[str]) -> DataFrame:
    df = df.withColumn("_lines", licence_form(col, openings)).withColumn("_canon", canonical("_lines"))
    x = F.trim(F.regexp_replace("_canon", r"(?! [\p{L}\p{N}])[^\p{L}\p{N}]+", " "))
    for a, b in SPELLINGS:
        x = F.regexp_replace(x, rf"\b{b}\b", a)
    return df.withColumn("_form", x).drop("_lines", "_canon")


def find(docs: DataFrame, licences: dict[str, str | list[str]] | DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, digest`` (of its canonical form) and ``licence``, the name of the licence that its whole
    text is, else null.

    ``licences`` maps names to a text or several, or is ``(licence, text)``; of names with one
    canonical text the least is given. Null and empty texts are no licence, and neither is
    a text in which a licence is only a part.
    """
    spark = docs.sparkSession
    if isinstance(licences, dict):
        licences = spark.createDataFrame([(name, t) for name, of in licences.items() for t in ([of] if isinstance(of, str) else of)], "licence string, text string")
    # Also as folded to one line, where notices inside a text are no lines of their own.
    texts = licences.select("licence", F.coalesce("text", F.lit("")).alias("_text"))
    texts = texts.unionByName(texts.withColumn("_text", F.regexp_replace("_text", r"\s+", " ")))
    openings = sorted({p for r in texts.select(F.substring("_text", 1, 400).alias("x")).distinct().collect() if (p := _phrase(r.x, _OPENING))})
    known = _form(texts, "_text", openings).where("_form <> ''")
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    d = _form(d, "_text", openings)
    a, b = digest("_form")
    known = known.groupBy(a.alias("h1"), b.alias("h2")).agg(F.min("licence").alias("licence"))
    d = d.select("k", a.alias("h1"), b.alias("h2"))
    return d.join(known, ["h1", "h2"], "left").select(doc_id(), F.concat(F.lpad(F.lower(F.hex("h1")), 16, "0"), F.lpad(F.lower(F.hex("h2")), 16, "0")).alias("digest"), "licence")
