"""Operator 1: licence scan by canonical digest lookup.

Case, copyright lines, list marks, punctuation, white space and equivalent spellings are normalised away; the
SHA-256 of what is left is joined to the digests of known licence texts. Whole texts only, all in
DataFrame functions. Known licences are a parameter (license_id, text); ``known_licenses`` holds the
short ones of ``KNOWN`` with and without their titles and the texts in ``license_texts``, with and
without what follows their terms. A text whose digest is unknown is looked up once more without any
line that starts with a copyright word or sign (``NOTICE_LINE``); ``digest`` itself keeps such lines.
The joins carry 64 characters a row and known licences are few; Spark broadcasts them only while they
are under its size threshold, and a digest that many documents share meets one row.

Defined results: null text has a null digest and no licence; empty text has the digest of the empty
string; if two known texts share a digest the smaller license_id names both; repeated rows each
give a row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only claims copyright: the word or sign, then a sign, year or placeholder.
COPYRIGHT_LINE = r"(^|\n)[^\na-z0-9(©]*(copyright[ \t]*(\(c\)|©)?[ \t]*[0-9<\[{]|(\(c\)|©)[ \t]*(copyright)?[ \t]*[0-9<\[{]|all rights reserved)[^\n]*"
#: A line that starts with a copyright word or sign, whatever follows, unless it goes on like a sentence of a licence;
#: a bare "(c)", which may number a clause, has to be a paragraph of one line.
NOTICE_LINE = (
    r"(^|\n)[^\na-z0-9(©]*(copyright\b(?![ \t]+(?:and|or|holders?|owners?|notices?|laws?|licen[sc]es?|statements?|interests?|rights?|works?|permission|protection|disclaimers?|treaty|material|in|is|to|on|for)\b)"
    r"|©|\(c\)[ \t]*(?:copyright|[0-9<\[{])|all rights reserved)[^\n]*|(?:^\s*|\n[ \t\r]*\n[ \t]*)\(c\)[^\n]*(?=\n[ \t\r]*\n|\s*$)"
)
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’–—…©«»·•]+"
#: A list mark at the start of a line, or after the end of a sentence: a number, a letter or a sign.
LIST_MARK = r"(^|\n|[.:;][ \t\r\n])[ \t\r\n#>/]*(\(?[0-9]{1,2}[.)]|\(?[a-z]\)|[*•-])[ \t\r\n]"
#: Spellings that count as equal (left becomes right).
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "wilfull"),
)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Texts of some short public licences, without titles and copyright lines.
KNOWN = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TAIL,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


#: Titles over the texts of ``KNOWN``.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "License: MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD License (0BSD)", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License"),
}
TERMS_END = "END OF TERMS AND CONDITIONS"


def canonical(text: Column, notices: str = COPYRIGHT_LINE) -> Column:
    t = F.regexp_replace(F.translate(text, UPPER, LOWER), notices, "\n")
    t = F.regexp_replace(t, LIST_MARK, "$1 ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, PUNCTUATION, "  "), F.lit(" "))
    usual = t
    for spelling, other in EQUIVALENT:
        usual = F.replace(usual, F.lit(f" {spelling} "), F.lit(f" {other} "))
    # one look at the text tells whether any spelling occurs in it
    t = F.when(t.rlike(f" (?:{'|'.join(sorted(spelling for spelling, _ in EQUIVALENT))}) "), usual).otherwise(t)
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text): every form of a licence that counts as the whole of it."""
    out = [(k, f"{title}\n\n{text}") for k, text in KNOWN.items() for title in ("", *TITLES[k])]
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        terms, end, _ = text.partition(TERMS_END)
        out += [(file.stem, t) for t in ((text, terms, terms + end) if end else (text,))]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id (null where the text is no known licence)."""
    known = known_licenses(docs.sparkSession) if known is None else known

    def digests(key: str, name: str, **options) -> DataFrame:
        return known.where("text is not null").select("license_id", F.sha2(canonical(F.col("text"), **options), 256).alias(key)).groupBy(key).agg(F.min("license_id").alias(name))

    text = F.col(text_col).cast("string")
    lower = F.translate(text, UPPER, LOWER)
    bare = F.when(lower.contains("copyright") | lower.contains("©") | lower.contains("(c)"), F.when(lower.rlike(NOTICE_LINE), F.sha2(canonical(text, NOTICE_LINE), 256)))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(canonical(text), 256).alias("digest"), bare.alias("bare"))
    found = own.join(digests("digest", "exact"), "digest", "left").join(digests("bare", "less", notices=NOTICE_LINE), "bare", "left")
    return found.select("doc_id", "digest", F.coalesce("exact", "less").alias("license_id"))


def scan_sql() -> str:
    """The same over DuckDB's view ``documents``, with the texts of ``KNOWN`` and ``digest`` alone."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def sql(text: str) -> str:
        t = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), {quote(COPYRIGHT_LINE)}, chr(10), 'g')"
        t = f"regexp_replace({t}, {quote(LIST_MARK)}, '\\1 ', 'g')"
        t = f"' ' || regexp_replace({t}, {quote(PUNCTUATION)}, '  ', 'g') || ' '"
        for spelling, usual in EQUIVALENT:
            t = f"replace({t}, ' {spelling} ', ' {usual} ')"
        return f"sha256(trim(replace({t}, '  ', ' ')))"

    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in KNOWN.items())
    return f"with known as (select {sql('text')} as digest, min(license_id) as license_id from (values {rows}) k(license_id, text) group by 1), own as (select doc_id, {sql('text')} as digest from documents) select doc_id, digest, license_id from own left join known using (digest)"
