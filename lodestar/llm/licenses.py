"""Licence scan by canonical digests: whole texts, and each line as a text of its own, are looked up by hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only states a copyright, after lower-casing.
COPYRIGHT = r"(^|\n)[\x20\x09]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: A copyright statement by name, before lower-casing; and by sign or year, after it. Running text that a
#: line break puts behind 'copyright' ('copyright notice', 'copyright holders') is none.
STATED_NAME = r"(^|\n)[\x20\x09]*Copyright[\x20\x09]+(?!Licen[cs]e|Notice|Holder|Owner|Law|Act|Disclaimer|Treaty|Right)[A-Z][^\n]*"
STATED = r"(^|\n)[\x20\x09]*(copyright[\x20\x09:,]*(\(c\)|©|&copy;|[\[<{(]?([0-9]{4}|year|yyyy))|\(c\)[\x20\x09]*(copyright|©|[\[<{]?([0-9]{4}|year|yyyy))|©|all rights reserved)[^\n]*"
#: List markers, and what looks like one, wherever they stand: a line break may put the number of "Section 4." first in a line.
MARKERS = r"(^|[\x20\x09\n])(•|\(?[0-9]{1,2}[.)]|\(?[a-z]\))(?=[\x20\x09\n])"
#: Punctuation and blanks, but no line feed.
SIGNS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x20\x09\x0B-\x0D«»‘’“”–—©®]+"
#: Equivalent spellings and the form kept (fixed values).
SPELLINGS = [
    ("licenc", "licens"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("defence", "defense"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("honour", "honor"),
    ("https", "http"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

#: Lower-cased texts without these have the same wrapped form as canonical form: statements, markers, and
#: spellings of two words that a line break parts.
PARTED = "|".join(other.replace(" ", r"[^a-z\n]*\n[^a-z]*") for other, _ in SPELLINGS if " " in other)
WRAPPED = rf"(^|\n)[\x20\x09]*(copyright|\(c\))|{MARKERS}|{PARTED}"

#: Names under which notices refer to licences (fixed values).
NAMES = [
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("MIT", "the MIT License"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, Version 2.0"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
]
#: Forms of a notice.
FORMS = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This file is licensed under {}", "SPDX-License-Identifier: {id}"]

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted."""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
BSD_WARRANTY = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software.

3. This notice may not be removed or altered from any source distribution."""

MIT_ZERO_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so.

"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
UNLICENSE_LINKS = ["http://unlicense.org/", "http://unlicense.org", "https://unlicense.org/", "https://unlicense.org"]
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in
part, and all derivative works of the Software, unless such copies or derivative works are solely in the
form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT.
IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR
OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Public licence texts, without their titles and copyright lines (fixed values).
TEXTS = [
    ("MIT", MIT_GRANT),
    ("ISC", f"{ISC_GRANT}\n\n{ISC_WARRANTY}"),
    ("0BSD", f"{ZERO_GRANT}\n\n{ISC_WARRANTY}"),
    ("BSD-2-Clause", BSD_TERMS + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_TERMS + BSD_NAMES + BSD_WARRANTY),
    ("Zlib", ZLIB),
    ("MIT-0", MIT_ZERO_GRANT + MIT_GRANT[MIT_GRANT.index("THE SOFTWARE") :]),
    ("Unlicense", UNLICENSE),
    *(("Unlicense", f"{UNLICENSE}\n\nFor more information, please refer to <{link}>") for link in UNLICENSE_LINKS),
    ("BSL-1.0", BOOST),
]
#: Titles that may stand above a licence text.
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"} | {
    "MIT-0": "MIT No Attribution", "Unlicense": "The Unlicense", "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
}


#: SHA-256 of the canonical and of the wrapped form of long public licence texts (fixed values): as published ("whole"),
#: and up to END OF TERMS AND CONDITIONS ("terms"), without the appendix on how to apply them.
DIGESTS = [
    ("Apache-2.0", "whole", "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9", "b70b775be059fa7d88c23d2138accf3f39fb8edb07d5499466395f2ec8a373ed"),
    ("Apache-2.0", "terms", "a657010cc8660623635462386107381af70d2c7ec43ab36e27484c72cbb3b28f", "c8ebcc9920efe41b07cffa7cdbdbb8bbc529765ee46427eed4b87a69c0fef138"),
    ("Artistic-1.0-Perl", "whole", "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304", "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49"),
    ("CC0-1.0", "whole", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "e5e7739fb6745f71ddb85dff2292a26670ed7cfc14922b140f15705e75bbe731"),
    ("GFDL-1.2", "whole", "19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f", "79f84c30eb127b035e2c79de87c19f6f5fa93914894a6d6ea6056bda9195dfe3"),
    ("GFDL-1.3", "whole", "e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480", "a108338cba750e3b4216fcb8b432e0b4316308de6f6a890dfc347b0747b849bb"),
    ("GPL-1.0", "whole", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6", "7b343fe698ba364e09227ae272f6764e5caa8d1e282beb53d8a59278f82ed242"),
    ("GPL-1.0", "terms", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", "b0670b7f6946c85b3b70dca1aa5584002e3940ff3df708f07152ee3c674efad2"),
    ("GPL-2.0", "whole", "ceb13cdc7143ca5f58fb64136b9b542b00470d4db4dbcee1328c6250bf845b08", "8749bf3bc8d64b7b01f56e6146d2212fce3f355b4dc5c247753f8b96071c7894"),
    ("GPL-2.0", "terms", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017", "bd6fe699aba54af00211328202a46bcd64d091de072919194ff7215db0e1935a"),
    ("GPL-3.0", "whole", "e25d282dcbebde028b149807716ab40a33db5f0c8ac5270f7a09a926f7b8b527", "78aa23ce656f8a21031b020b4bae1939f1744d60cfeea294bdd8249729cdfc5c"),
    ("GPL-3.0", "terms", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943", "fe37a7ddff1e1b85ef10919a3a4bbaa88eb6f6b574e3757140f92a3edaa8e628"),
    ("LGPL-2.0", "whole", "cc8e7fa9f9cf8315fef32bddbc9aa00edea19a8d4cc8a8b79af8595808ca4b16", "e3320b0735f02e7844613fcdbac0b85180577f6be7c2fa0a125580d7768eaef5"),
    ("LGPL-2.0", "terms", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499", "391a1c21b45812119f35229a938fd294df86c19a5819e4946b03d84cd62e03fc"),
    ("LGPL-2.1", "whole", "38b2435f8cf1a11a2bdcba9a05f347cf9063612b86eec3d468355f817be85a84", "8af9e66a26153d73af584ba1d0597c8667a788aba9fd08837c3f7a6571c9fdf3"),
    ("LGPL-2.1", "terms", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd", "29399b1b7600dab97483ef661ed9e394094f2e80e6084574ed84480b90b1d501"),
    ("LGPL-3.0", "whole", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0"),
    ("MPL-1.1", "whole", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6", "2e69da40e271334c1864ba989bd951300396d7b44a4eea17ef6a4c9bdf10cd6b"),
    ("MPL-2.0", "whole", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56", "12499d45698c4a984e8c2fe7177ba2962a96c5e4cd04cb0360fbd9e73fead23e"),
]


#: Known texts that are sent to every task; more are joined by shuffle.
MOST_BROADCAST = 20_000
#: Every known text holds one of these, so a text without any can't have the form of one.
CUES = ["licen", "permission", "redistribution", "released", "distributed"]


def known_texts() -> list[tuple[str, str]]:
    """License id and text of every known licence (with and without its title) and notice; about a hundred rows."""
    whole = [(i, text) for i, text in TEXTS] + [(i, f"{TITLES[i]}\n\n{text}") for i, text in TEXTS]
    return whole + [(i, form.format(name, id=i)) for i, name in NAMES for form in FORMS]


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _lines(lower: Column) -> Column:
    """The lines, without empty ones, of a lower-cased text: one blank for punctuation, equivalent spellings unified."""
    out = F.regexp_replace(lower, SIGNS, " ")
    for other, kept in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(kept))
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form: lower case, one blank for punctuation, equivalent spellings unified.

    Lines that state a copyright become empty.
    """
    return _lines(F.regexp_replace(_lower(text), COPYRIGHT, "$1"))


def wrapped_lines(text: Column) -> Column:
    """Like canonical_lines(), but one line without list markers; running text that begins a line with 'copyright' stays.

    So a text has the same words however it is wrapped and its clauses are marked.
    """
    out = _lower(F.regexp_replace(text, STATED_NAME, "$1"))
    out = F.regexp_replace(F.regexp_replace(out, STATED, "$1"), MARKERS, "$1")
    return _lines(F.translate(out, "\n", " "))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id, notices and n_notices of every row of docs (doc_id, text, ...).

    digest is the SHA-256 of the whole text in canonical form, license_id the known
    licence that has the same one (of several the smallest), else the one that has the same
    form by wrapped_lines(), if only one has (null: none). The default table holds the whole
    texts of TEXTS (MIT, ISC, 0BSD, BSD-2-Clause, BSD-3-Clause, Zlib, MIT-0, Unlicense, BSL-1.0), the digests of those of
    DIGESTS (Apache, GPL, LGPL, GFDL, MPL, CC0, Artistic) and the notices of NAMES; the
    whole texts of AGPL-3.0 and of the other CC licences aren't in it and get no license_id
    unless known brings them. notices are the
    licences, ascending and joined by commas, of which a whole line is a known text, and
    n_notices the number of such lines. The digests of known (license_id, text; default:
    known_texts()) are broadcast if they are at most MOST_BROADCAST, else joined by shuffle.

    A null or empty text has the digest of an empty text and no licence. Repeated rows come
    back as often as they are there; a null doc_id stays null; other columns are left out;
    an empty table gives an empty result.
    """
    spark, known_given = docs.sparkSession, known is not None
    digested = [] if known_given else DIGESTS
    if known is None:
        known = spark.createDataFrame(known_texts(), "license_id string, text string")
    fixed = spark.createDataFrame([(key, i) for i, _, canonical, wrapped in digested for key in (canonical, "~" + wrapped)], "key string, license string")
    # keys of the wrapped form begin with ~
    digest, wrapped = (F.sha2(F.array_join(f(F.col("text")), " "), 256) for f in (canonical_lines, wrapped_lines))
    table = known.select("license_id", digest.alias("key")).groupBy("key").agg(F.min("license_id").alias("license"))
    loose = known.select("license_id", F.concat(F.lit("~"), wrapped).alias("key")).groupBy("key")
    table = table.unionByName(loose.agg(F.min("license_id").alias("license"), F.max("license_id").alias("last")).where("license = last").drop("last"))
    table = table.unionByName(fixed.join(table, "key", "left_anti"))
    cues = F.lit(bool(known_given))
    for cue in CUES:
        cues = cues | F.contains(_lower(F.col("text")), F.lit(cue))
    differs = F.when(cues & F.rlike(_lower(F.col("text")), F.lit(WRAPPED)), wrapped)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(F.col("text")).alias("lines"), differs.alias("wrapped"))
    digests = rows.select(
        "row", "doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), "wrapped", F.transform("lines", lambda x: F.sha2(x, 256)).alias("lines")
    )
    whole = F.array("digest", F.concat(F.lit("~"), F.coalesce("wrapped", "digest")))
    # the whole text is units 0 and 1, its lines are 2, 3, ...
    units = digests.select("row", "doc_id", "digest", F.posexplode(F.concat(whole, "lines")).alias("unit", "key"))
    few = not known_given or known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    met = units.join(F.broadcast(table) if few else table, "key", "left")
    line = F.col("unit") > 1
    return met.groupBy("row", "doc_id", "digest").agg(
        F.coalesce(*[F.max(F.when(F.col("unit") == i, F.col("license"))) for i in (0, 1)]).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license")))), ",").alias("notices"),
        F.count(F.when(line, F.col("license"))).alias("n_notices"),
    ).drop("row")


def scan_sql() -> str:
    """DuckDB SQL for scan() over the table documents, without the lookup by wrapped form."""
    quoted = [(i, text.replace("'", "''")) for i, text in known_texts()]
    values = ", ".join(f"('{i}', '{text}')" for i, text in quoted)
    fixed = ", ".join(f"('{canonical}', '{i}')" for i, _, canonical, _ in DIGESTS)
    out = f"regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{COPYRIGHT}', '\\1', 'g')"
    out = f"regexp_replace({out}, '{SIGNS}', ' ', 'g')"
    for other, kept in SPELLINGS:
        out = f"replace({out}, '{other}', '{kept}')"
    lines = f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    return f"""
WITH known AS (SELECT * FROM (VALUES {values}) AS t(license_id, text)),
digests AS (
  SELECT sha256(array_to_string({lines}, ' ')) AS key, min(license_id) AS license FROM known GROUP BY 1
  UNION ALL SELECT * FROM (VALUES {fixed}) AS t(key, license)
), rows AS (
  SELECT row_number() OVER () AS row, doc_id, {lines} AS lines FROM documents
), units AS (
  SELECT row, doc_id, 0 AS unit, sha256(array_to_string(lines, ' ')) AS key FROM rows
  UNION ALL
  SELECT row, doc_id, 1, sha256(line) FROM (SELECT row, doc_id, unnest(lines) AS line FROM rows)
)
SELECT doc_id, max(u.key) FILTER (WHERE unit = 0) AS digest, max(license) FILTER (WHERE unit = 0) AS license_id,
  coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE unit = 1), '') AS notices,
  count(license) FILTER (WHERE unit = 1) AS n_notices
FROM units u LEFT JOIN digests d ON u.key = d.key GROUP BY row, doc_id"""
