"""License scans by canonical digest lookup.

A text is brought into a canonical form: letter case, punctuation, copyright lines and equivalent spellings are
made the same. The digest of the whole form is hash-joined to the digests of known licences and notices. Single
lines are looked up in the same way, for files that only carry a notice. DataFrame operations only.
"""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import full_texts

MAX_KNOWN = 10_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What follows "copyright" in licence sentences; anything else behind it is a holder.
NOT_HOLDERS = (
    "a", "act", "acts", "an", "and", "any", "applicable", "are", "as", "assignment", "at", "attribution", "be", "been", "but",
    "claim", "claims", "conditions", "date", "dates", "disclaimer", "disclaimers", "doctrine", "doctrines", "exceptions", "file",
    "for", "from", "grant", "granted", "has", "have", "header", "headers", "held", "holder", "holders", "if", "in", "info",
    "information", "infringement", "interest", "interests", "is", "it", "its", "law", "laws", "legend", "legends", "licence",
    "licences", "licensable", "license", "licensed", "licenses", "licensing", "line", "lines", "management", "mark", "marks", "may",
    "message", "must", "nor", "not", "notation", "notice", "noticed", "notices", "of", "on", "or", "other", "owned", "owner",
    "owners", "ownership", "page", "patent", "patents", "permission", "permissions", "permitted", "protected", "protection",
    "protections", "provisions", "registration", "relicensing", "resulting", "right", "rights", "shall", "similar", "statement",
    "statements", "status", "such", "term", "terms", "than", "that", "the above", "the code", "the documentation", "the following",
    "the library", "the licensed", "the material", "the materials", "the program", "the software", "the source", "the work",
    "their", "then", "these", "this", "those", "to", "trademark", "trademarks", "treaties", "treaty", "under", "unless", "was",
    "were", "when", "where", "which", "will", "with", "within", "without", "work", "works", "you", "your",
)


def _no_phrase(phrases: list[str], first: bool = True) -> str:
    """Pattern of the rest of a line that begins with none of the phrases as whole words.

    Spelled out character by character: the SQL engine's patterns have no negative lookahead."""
    branches: dict[str, list[str]] = {}
    for phrase in phrases:
        if phrase:
            branches.setdefault(phrase[0], []).append(phrase[1:])
    next_ones = "".join(sorted(branches))
    ways = [c + _no_phrase(rest, False) for c, rest in sorted(branches.items())]
    if first or "" in phrases:  # a word begins, or goes on behind a phrase
        ways.append(rf"[^\x00-\x2F\x3A-\x60\x7B-\x7F{next_ones}][^\n]*")
    else:
        ways.append(rf"[^\n{next_ones}][^\n]*|$")
    return f"(?:{'|'.join(ways)})"


_YEAR = r"[\[<{(]*(?:[12][0-9]{3}|year|yyyy|xxxx)"
_SIGN = r"(?:\(c\)|©|&copy;)"
_NAMED = r"(?:copyright|\(?copr\.?\)?)"
#: A line that is a notice: the word or sign, then a year, a sign or a holder; or nothing but the reservation of rights.
#: A line of a licence sentence that merely begins with the word is none.
COPYRIGHT_LINE = (
    rf"^[ \t#*/;-]*(?:{_NAMED}[ \t:,]*(?:{_SIGN}|{_YEAR})[^\n]*|\(c\)[ \t:,]*(?:{_NAMED}[ \t]|©|&copy;|{_YEAR})[^\n]*|(?:©|&copy;)[^\n]*"
    rf"|{_NAMED}[ \t]*[ \t:][ \t]*{_no_phrase(sorted(NOT_HOLDERS))}|all rights reserved[ \t\r.,;!#*/-]*$)"
)

#: Spellings that mean the same in a licence.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencee": "licensee", "licencor": "licensor",
    "sublicence": "sublicense", "favour": "favor", "behaviour": "behavior", "organisation": "organization",
    "organisations": "organizations", "acknowledgement": "acknowledgment", "judgement": "judgment", "wilful": "willful",
    "fulfil": "fulfill", "whilst": "while", "http": "https", "noncommercial": "non commercial", "merchantibility": "merchantability",
}

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Licence texts without their copyright lines, and common one-line notices.
KNOWN = {
    "MIT": (
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "ISC": (
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.\n\n" + _AS_IS
    ),
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. "
    ) + _BSD_TAIL,
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2 notice": "This work is licensed under the GNU General Public License, version 2.",
}


def canonical(text: Column) -> Column:
    """Canonical form of a whole text; empty for null."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, "(?md)" + COPYRIGHT_LINE, "")
    # every word gets a blank of its own on each side, so that neighbours are replaced independently
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_WORD, "  "), F.lit(" "))
    for word, same in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {same.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical_text(text: str | None) -> str:
    """``canonical`` for one text, outside Spark."""
    out = (text or "").translate(str.maketrans(UPPER, LOWER))
    out = re.sub(COPYRIGHT_LINE, "", out, flags=re.M)
    out = " " + re.sub(NOT_WORD, "  ", out) + " "
    for word, same in SPELLINGS.items():
        out = out.replace(f" {word} ", f" {same.replace(' ', '  ')} ")
    return out.replace("  ", " ").strip(" ")


def _digests(texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    if len(texts) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known licences")
    out: dict[str, str] = {}
    for name, text in sorted(texts):
        form = canonical_text(text)
        if form:
            out.setdefault(hashlib.sha256(form.encode()).hexdigest(), name)
    return sorted(out.items())


@functools.cache
def _common_digests() -> tuple[tuple[str, str], ...]:
    return tuple(_digests([*KNOWN.items(), *full_texts(KNOWN)]))


def known_digests(known: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(digest, licence), the first by name where texts have the same canonical form. Without ``known``, the texts of
    ``KNOWN`` and their usual variants, and the longer licences of ``license_texts``."""
    return list(_common_digests()) if known is None else _digests(list(known.items()))


def scan_licenses(docs: DataFrame, known: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ``canonical_sha256`` of the whole text, ``license`` it is a copy of (null: none), and
    ``n_notice_lines``, the number of its lines that are a known text by themselves.

    * null and empty texts, and texts of copyright lines and punctuation only, have the empty form: no licence
    * texts are read whole; repeated rows and null keys keep a row each
    * known texts that are the same in canonical form count as the first by name
    * an empty table gives no rows; other columns play no part, whatever their names

    The known texts are a list in code or from the caller, at most ``MAX_KNOWN``: their digests are broadcast."""
    spark = docs.sparkSession
    table = spark.createDataFrame(known_digests(known), "_digest string, license string").coalesce(1)
    rows = docs.select(F.col(key), F.col(text).alias("_text")).withColumn("canonical_sha256", F.sha2(canonical(F.col("_text")), 256))
    # a line of a single-line text is the text itself: its digest is not made again
    lines = F.when(F.instr("_text", "\n") > 0, F.transform(F.split("_text", "\n", -1), lambda x: F.sha2(canonical(x), 256))) \
        .otherwise(F.array("canonical_sha256"))
    digests = ", ".join(f"'{d}'" for d, _ in known_digests(known))  # hexadecimal constants, which the engine looks up by hash
    found = F.size(F.expr(f"filter(_lines, d -> d in ({digests}))")).cast("long") if digests else F.lit(0).cast("long")
    counted = rows.withColumn("_lines", lines).withColumn("n_notice_lines", found)
    return counted.join(F.broadcast(table), F.col("canonical_sha256") == F.col("_digest"), "left") \
        .select(key, "canonical_sha256", "license", "n_notice_lines")
