"""License scans: whole texts that are a known licence once spelling and layout no longer count.

Case, punctuation, copyright notices and equivalent spellings are normalised away; the digest of what is left is joined
with the digests of known licences, which went through the same steps. Before a text's grant (the words that begin its
terms) every line that begins with a copyright mark is a notice; after it, only one with a year or a place for it, so
that wrapped sentences about "copyright notices" stay. A notice and a grant may share a line. The known side is small
and counted before it is broadcast; it could also be a table of any size. Of long licences only the digests are kept here.

Everything is DataFrame and SQL functions. Defined results: null text counts as empty and is no licence, like every
text of which nothing is left; of known licences that are equal the least id is reported; repeated rows give equal
rows; very long texts are normalised and digested whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted_side

#: Equivalent spellings, applied in this order to text in lower case.
SPELLINGS = {
    "licence": "license",
    "sub-license": "sublicense",
    "sub license": "sublicense",
    "non-commercial": "noncommercial",
    "non-infringement": "noninfringement",
    "copyright owner": "copyright holder",
    "per cent": "percent",
    "organisation": "organization",
    "authorised": "authorized",
    "acknowledgment": "acknowledgement",
    "favour": "favor",
    "fulfil ": "fulfill ",
    "whilst": "while",
    "https:": "http:",
}
MARKS = "‘’“”–—•©"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAD = r"[ \t\r#*/;%|-]*"
#: Words that begin the terms of a licence.
GRANT = "permission (is|to)|redistribution and use|this software is|this is free|licensed under|everyone is permitted|version [0-9]"
_MARK = r"(copyright|\(c\)|©|all rights reserved)"
_DATED = r"((copyright|\(c\)|©|by)[ \t,:]*)+[\[<{(]?([12][0-9]{3}|yyyy|year|xxxx)"
_NO_LETTER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."

_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
_ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n\n4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"

#: Titles under which a text is found, and the text (public licence texts; fixed values).
TITLED = {
    "0BSD": (("BSD Zero Clause License", "Zero-Clause BSD"), f"{_USE}.\n\n{_AS_IS}"),
    "BSD-2-Clause": (("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"), f"{_REDISTRIBUTION}{_DISCLAIMER}"),
    "BSD-3-Clause": (("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"), f"{_REDISTRIBUTION}{_ENDORSEMENT}{_DISCLAIMER}"),
    "BSD-4-Clause": (("BSD 4-Clause License",), f"{_REDISTRIBUTION}{_ADVERTISING}{_DISCLAIMER}"),
    "ISC": (("ISC License", "The ISC License", "ISC License (ISC)"), f"{_USE}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AS_IS}"),
    "MIT": (("MIT License", "The MIT License", "The MIT License (MIT)"), _GRANT),
    "MIT-0": (("MIT No Attribution", "MIT-0"), _GRANT.replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")),
    "Unlicense": (("The Unlicense",), _UNLICENSE),
    "Zlib": (("zlib License", "The zlib License"), _ZLIB),
    "notice: Apache-2.0": ((), "Licensed under the Apache License, Version 2.0."),
    "notice: CC-BY-NC-4.0": ((), "Licensed under CC BY-NC 4.0."),
    "notice: GPL-3.0": ((), "This work is licensed under the GNU General Public License, version 3."),
    "notice: MIT": ((), "Released under the MIT License."),
}
#: Texts with their licences, with each title and without one.
KNOWN = [(name, "\n\n".join([*title, text])) for name, (titles, text) in TITLED.items() for title in [(), *[(t,) for t in titles]]]

#: Digests of long licences in canonical form (fixed values, from the texts that Debian ships as common licences).
DIGESTS: dict[str, str] = {
    "Apache-2.0": "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
    "Artistic": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1": "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6",
    "GPL-2": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
}


def canonical(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    at = F.regexp_instr(low, F.lit(GRANT))
    head = F.regexp_replace(F.substring(low, F.lit(1), at - 1), rf"(^|\n){_LEAD}{_MARK}[^\n]*", "\n")
    rest = F.regexp_replace(F.substring(low, F.greatest(at, F.lit(1)), F.length(low)), rf"(^|\n){_LEAD}({_DATED}[^\n]*|all rights reserved[. \t\r]*(?=\n|$))", "\n")
    out = F.concat(head, F.lit(" "), rest)
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, MARKS, " " * len(MARKS))
    return F.trim(F.regexp_replace(out, _NO_LETTER, " "))


def known_digests(known: DataFrame) -> DataFrame:
    """``known`` (license_id, text) to (license_id, digest)."""
    form = canonical(F.col("text"))
    return known.where(form != "").select("license_id", F.sha2(form, 256).alias("digest"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the texts and the digests above."""
    texts = known_digests(spark.createDataFrame(KNOWN, "license_id string, text string"))
    return texts.union(spark.createDataFrame(list(DIGESTS.items()), "license_id string, digest string"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest and license_id (null if the whole text is no known licence) of every row; ``known`` has license_id and digest."""
    known = known_licenses(docs.sparkSession) if known is None else known
    one = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    digests = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return digests.join(counted_side(one), "digest", "left").select("doc_id", "digest", "license_id")


def _sql() -> str:
    """Line by line, and word by word, where ``canonical`` replaces within the whole text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lines = lambda part, notice: f"array_to_string(list_filter(string_split({part}, chr(10)), lambda x: NOT regexp_matches(x, {quote(notice)})), chr(10))"
    form = f"{lines('head', f'^{_LEAD}{_MARK}')} || ' ' || {lines('rest', f'^{_LEAD}({_DATED}|all rights reserved[. ' + chr(92) + 't' + chr(92) + 'r]*$)')}"
    for a, b in SPELLINGS.items():
        form = f"replace({form}, {quote(a)}, {quote(b)})"
    words = rf"array_to_string(regexp_extract_all(translate({form}, '{MARKS}', '{' ' * len(MARKS)}'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+'), ' ')"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    digests = "".join(f" UNION ALL SELECT {quote(i)}, {quote(d)}" for i, d in DIGESTS.items())
    return f"""
WITH a AS (SELECT 'known' AS kind, NULL::BIGINT AS doc_id, license_id, text FROM (VALUES {values}) v(license_id, text) UNION ALL SELECT 'document', doc_id, NULL, text FROM documents),
b AS (SELECT *, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM a),
c AS (SELECT *, regexp_extract(low, '^(.*?)({GRANT})', 1, 's') AS head FROM b),
e AS (SELECT *, substr(low, length(head) + 1) AS rest FROM c),
f AS (SELECT kind, doc_id, license_id, {words} AS form FROM e),
k AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256(form) AS digest FROM f WHERE kind = 'known' AND form <> ''{digests}) GROUP BY digest)
SELECT doc_id, sha256(form) AS digest, k.license_id FROM f LEFT JOIN k ON sha256(form) = k.digest WHERE kind = 'document'"""


ORACLE_SQL = _sql()
