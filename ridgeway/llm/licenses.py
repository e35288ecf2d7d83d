"""License scans by canonical digest.

A text is made canonical (case, punctuation, copyright lines, equivalent spellings and white space are levelled) and its
digest looked up among the digests of known licence texts, made canonical alike: entire texts meet by a hash join. A
unit is a whole document or a line of one (lines end at a line feed), so a notice that stands on a line of its own is
found inside any text. The known texts are a table given by the caller; the built-in one holds short notices (KNOWN) and
the entire texts of `license_texts`, with and without title and appendix (`catalogue`). Its size is checked before it is broadcast; a larger one is joined by shuffle.

Nulls count as empty; an empty unit never matches. Repeated rows give repeated results; a digest known under several
names gives the alphabetically first. Only the id and the text are read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeway.llm.common import texts

#: Short licence notices and texts, by SPDX id. Copyright lines don't count.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    (
        "MIT",
        """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
)

#: Marks that stand for the word copyright, before punctuation goes.
MARKS = (("(c)", "copyright"), ("©", "copyright"))
#: Spellings that count as one, once a unit's words stand in one line without punctuation.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("programme", "program"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("whilst", "while"),
    ("http ", "https "),
)
#: Lines that name copyright holders, in lower case: 'copyright' and a name, a mark, or '(c)' and a year ...
COPYRIGHT_LINE = (
    r"^[^\p{L}\p{N}]*copyright[^\p{L}\p{N}]+[\p{L}\p{N}]|^[^\p{L}\p{N}]*©|^[^\p{L}\p{N}]*\(c\).*(19|20)[0-9][0-9]"
    r"|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
)
#: ... but not those where a licence's own words go on after 'copyright' (fixed values).
GOES_ON = (
    r"^[^\p{L}\p{N}]*copyright[^\p{L}\p{N}]+(act|also|and|any|are|as|attribution|can|conditions|disclaimers?|doctrines|for|holders?|if|in|information"
    r"|infringement|interests?|is|law|laws|legend|licen[cs]e|licen[cs]ed|licen[cs]es|like|lines?|may|must|notices?|of|on|or|owners?|ownership|patent|permission"
    r"|protection|restrictions|resulting|rights?|shall|statements?|status|terms|that|the library|the program|the software|the work|this|those|to|treaties|treaty|under|which|will|with)"
    r"([^\p{L}\p{N}]|$)"
)
#: Bytes of known texts that may be broadcast.
BROADCAST_BYTES = 8 << 20


def _levelled(line: Column) -> Column:
    """Words of letters and digits with single spaces between, in lower case; a copyright line is empty."""
    out = F.lower(line)
    named = out.rlike(COPYRIGHT_LINE) & ~out.rlike(GOES_ON)
    for a, b in MARKS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(named, "").otherwise(F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")))


def respelt(words: Column) -> Column:
    for a, b in SPELLINGS:
        words = F.replace(words, F.lit(a), F.lit(b))
    return words


def canonical_lines(text: Column | str) -> Column:
    """The levelled lines of a text; `respelt` makes a line a unit of its own."""
    return F.transform(F.split(text, "\n"), _levelled)


def whole(lines: Column) -> Column:
    """The canonical form of an entire text, from its levelled lines. Spellings are levelled last, as some have two words
    that may stand on two lines."""
    return respelt(F.array_join(F.filter(lines, lambda x: x != ""), " "))


#: Titles that a text goes by, besides none; the first words of its body.
TITLES = {
    "MIT": (("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT"), "Permission is hereby granted"),
    "ISC": (("ISC License", "The ISC License", "ISC License (ISC)"), "Permission to use"),
    "BSD-2-Clause": (("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"), "Redistribution and use"),
    "BSD-3-Clause": (("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"), "Redistribution and use"),
    "Unlicense": (("The Unlicense", "Unlicense"), "This is free and unencumbered"),
    "BSL-1.0": (("Boost Software License - Version 1.0 - August 17th, 2003",), "Permission is hereby granted"),
    "Apache-2.0": (("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/",), "TERMS AND CONDITIONS FOR USE"),
}


def catalogue(known=KNOWN) -> list[tuple[str, str]]:
    """(license, text): the given ones and the texts of `license_texts`, each as it stands and in its common forms.

    Forms: with each title and without any; up to the end of its terms, without what follows; the clauses of BSD by
    numbers, stars or nothing.
    """
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    texts_of = [(p.stem, p.read_text("utf-8")) for p in files] + [(i, t) for i, t in known if "\n" in t]
    out = dict.fromkeys(known)
    for name, text in texts_of:
        forms = [text]
        if (end := text.find("END OF TERMS AND CONDITIONS")) >= 0:
            forms += [text[:end], text[:end] + "END OF TERMS AND CONDITIONS"]
        titles, start = TITLES.get(name, ((), ""))
        if start:
            forms += [f"{title}\n\n{x[x.index(start):]}" for x in list(forms) for title in ("", *titles)]
        if name.startswith("BSD-"):
            plain = [re.sub(r"(?m)^\s*(\*|-|[0-9]\.|\([0-9]\)) +", "", x) for x in forms]
            number = lambda x: re.sub(r"(?m)^(Redistributions of source|Redistributions in binary|Neither the name)", lambda m, n=iter("123"): f"{next(n)}. {m[0]}", x)
            forms += plain + [number(x) for x in plain]
        out.update(dict.fromkeys((name, x) for x in forms))
    return list(out)


def known_table(spark: SparkSession, known=None) -> DataFrame:
    """(license, text): the built-in catalogue, or the texts given."""
    return spark.createDataFrame(catalogue() if known is None else list(known), "license string, text string")


def scan_licenses(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license, n_notices, notices), a row for each row of df.

    digest: of the entire canonical text, '' if that is empty; license: of the known text that it is, or null;
    n_notices: how many lines are entire known texts; notices: their licences, sorted, without repeats.
    """
    digests = known.select(F.md5(whole(canonical_lines("text"))).alias("digest"), "license", whole(canonical_lines("text")).alias("c"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    digests = digests.filter("c <> ''").groupBy("digest").agg(F.min("license").alias("license"))
    rows = texts(df, id_col, text_col).select("doc_id", canonical_lines("text").alias("lines"))
    rows = rows.select("doc_id", "lines", whole(F.col("lines")).alias("entire"))
    key = F.when(F.col("entire") == "", "").otherwise(F.md5("entire"))
    digest_of = F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.struct(F.lit(1).alias("line"), F.md5(respelt(x)).alias("digest")))
    units = rows.select("doc_id", key.alias("of"), F.explode(F.concat(F.array(F.struct(F.lit(0).alias("line"), key.alias("digest"))), digest_of)).alias("u"))
    units = units.select("doc_id", "of", "u.line", "u.digest")
    met = units.join(F.broadcast(digests) if size <= BROADCAST_BYTES else digests, "digest", "left").filter("line = 0 OR license IS NOT NULL")
    # Rows that repeat an id and its text are told apart by their number only.
    each = met.groupBy("doc_id", "of").agg(
        F.max(F.when(F.col("line") == 0, F.col("license"))).alias("license"),
        F.sum("line").alias("n"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("line") == 1, F.col("license")))), ",").alias("notices"),
        F.count(F.when(F.col("line") == 0, 1)).cast("int").alias("copies"),
    )
    return each.select(
        "doc_id", F.col("of").alias("digest"), "license", (F.col("n") / F.col("copies")).cast("long").alias("n_notices"), "notices", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    ).drop("copy")


def _oracle() -> str:
    """The same for DuckDB; its regular expressions name classes alike, and a known text is a row of VALUES."""

    def line(x: str) -> str:
        x = out = f"lower({x})"
        for a, b in MARKS:
            out = f"replace({out}, '{a}', '{b}')"
        words = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        return f"CASE WHEN regexp_matches({x}, '{COPYRIGHT_LINE}') AND NOT regexp_matches({x}, '{GOES_ON}') THEN '' ELSE {words} END"

    def spelt(x: str) -> str:
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    def lines(x: str) -> str:
        return f"list_transform(string_split({x}, chr(10)), lambda x: {line('x')})"

    def entire(x: str) -> str:
        return spelt(f"array_to_string(list_filter({x}, lambda x: x <> ''), ' ')")

    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH k AS (SELECT license, {entire(lines('text'))} AS c FROM (VALUES {values}) v(license, text)),
d AS (SELECT md5(c) AS digest, min(license) AS license FROM k WHERE c <> '' GROUP BY 1),
r AS (SELECT doc_id, {lines("coalesce(text, '')")} AS lines FROM documents),
e AS (SELECT doc_id, lines, {entire('lines')} AS entire FROM r),
u AS (SELECT doc_id, md5({spelt('x')}) AS digest FROM (SELECT doc_id, unnest(list_filter(lines, lambda x: x <> '')) AS x FROM e)),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM u JOIN d USING (digest) GROUP BY 1)
SELECT e.doc_id, CASE WHEN entire = '' THEN '' ELSE md5(entire) END AS digest, d.license, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices,
       coalesce(n.notices, '') AS notices
FROM e LEFT JOIN d ON d.digest = md5(entire) AND entire <> '' LEFT JOIN n ON n.doc_id = e.doc_id
"""


ORACLE = _oracle()
