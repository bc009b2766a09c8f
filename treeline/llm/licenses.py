"""Licence scan by canonical digests.

A text becomes canonical: lower case, without copyright lines, with one spelling for
equivalent ones, with single spaces for everything but letters and digits. The SHA-256 of
the whole canonical text is joined with those of known licences, and so is each line, as
notices stand on a line of their own. Everything is built-in functions.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that follow "copyright" or "(c)" in the sentences of licences; any other word names a holder.
NOT_HOLDERS = """
    a above accompany accompanies according act affirmer an and any applies apply appropriate are as at be below
    can cannot claim claims contained contributor convey declaration disclaimer do does exists express file files
    for from give given had has have header headers held holder holders however if in including information
    infringement infringes interest interests is it its law laws license licensed licensee licenses line lines
    make material may must no not notice notices of on only or other otherwise owned owner owners ownership permission
    permissions prohibiting protected protection provide provided put right rights shall should so statement
    statements status such term terms that the these this those to treaties treaty under unless use was we were
    when where which will with within without work works year you your doctrines patent""".split()
_BEYOND = "\u0080-\U0010ffff"


def _no_word_of(words: list[str]) -> str:
    """A pattern for a run of lower-case letters that is none of `words`, without lookahead."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def beside(node: dict, first: bool) -> str:
        letters = sorted(x for x in node if x)
        others = "".join(x for x in "abcdefghijklmnopqrstuvwxyz" if x not in letters)
        ways = [x + beside(node[x], False) for x in letters] + [f"[{others}{_BEYOND}][a-z{_BEYOND}]*"]
        return "(?:" + "|".join(ways) + (")" if first or "" in node else ")?")
    return beside(tree, True)


#: What may stand before the words of a line in a source file.
_COMMENT = r"^[ \t#*/;%!<>|-]*"
_HOLDER = rf"(?:by[ \t]+)?{_no_word_of(NOT_HOLDERS)}(?:[^a-z\n{_BEYOND}][^\n]*)?"
_YEAR = r"[0-9\[{<][^\n]*"
#: Lines that name a holder or year, and reservations of rights, say nothing of the licence.
#: A year or a name has to follow, so sentences of a licence stay, wherever they are wrapped.
COPYRIGHT_LINES = (
    rf"(?m){_COMMENT}copyright[ \t:,]*(?:(?:\(c\)|©)[^\n]*|{_YEAR})$",
    rf"(?m){_COMMENT}(?:copyright[ \t:,]+|(?:\(c\)|©)[ \t:,]*)(?:{_YEAR}|{_HOLDER})$",
    rf"(?m){_COMMENT}all rights reserved[.]?[ \t*/]*$")
SIGNS = r"[^\p{L}\p{N}\n]+"
#: Equivalent spellings, after signs have become spaces. Each pair holds on its own.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"),
    ("copyright holder s", "copyright holders"), ("https", "http"), ("version v", "version "),
    # The same words, parted at a hyphen by the end of a line.
    *((first + end + second, first + second) for first, second in (
        ("sub", "license"), ("non", "commercial"), ("non", "infringement")) for end in ("\n", " \n", "\n ", " \n ")),
)
NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
    "OF THIS SOFTWARE.")
#: Public licence texts and the notices that refer to a licence.
_NOTICES = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy "
     'of this software and associated documentation files (the "Software"), to deal in the Software '
     "without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the "
     'Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
     "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
     "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
     "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
     "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose "
     "with or without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies.\n\n" + NO_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted.\n\n" + NO_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)
#: Headings under which short licences are found; they are known without one too.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License"),
}


def _catalogue() -> tuple[tuple[str, str], ...]:
    """The notices and the texts of `license_texts`, whose names end at an underscore."""
    out = list(_NOTICES)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        out.append((path.stem.split("_")[0], path.read_text(encoding="utf-8")))
    for name, text in out[:]:
        if name in HEADINGS and len(text) > 300:
            for heading in HEADINGS[name]:
                text = text.removeprefix(heading + "\n\n")
            out += [(name, text), *((name, f"{heading}\n\n{text}") for heading in HEADINGS[name])]
    return tuple(dict.fromkeys(out))


KNOWN = _catalogue()


def canonical_lines(text: Column) -> Column:
    """The canonical text, its lines still apart."""
    out = F.lower(text)
    for pattern in COPYRIGHT_LINES:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, SIGNS, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), "[ \n]+", " "))


def known_digests(spark, known=KNOWN) -> DataFrame:
    """(digest, license): of texts with one canonical form the last name in order counts."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), "license").groupBy(
        "digest").agg(F.max("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_digest, license, notices, n_notices.

    license is that of the known text that the whole text equals, notices the distinct
    licences of its lines in ascending order, joined by commas ('' without any), n_notices
    the number of such lines. A null text is an empty one; empty texts and lines match
    nothing. `known` (digest, license) holds a catalogue of licences, as many rows as it has
    texts whatever the size of docs, and is broadcast for that. Rows that share an id
    share their notices. An empty table gives an empty result; other columns are not read.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = rows.withColumn("_canonical", canonical_lines(F.col("text")))
    whole = F.trim(F.regexp_replace("_canonical", "[ \n]+", " "))
    each = lines.select("doc_id", F.explode(F.split("_canonical", "\n")).alias("line")).select(
        "doc_id", F.trim("line").alias("line")).where("line <> ''").select(
        "doc_id", F.sha2(F.col("line").cast("binary"), 256).alias("digest"))
    found = each.join(F.broadcast(known), "digest").groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"),
        F.count("*").alias("n_notices"))
    texts = lines.select("doc_id", F.sha2(whole.cast("binary"), 256).alias("digest"), (whole == "").alias("empty"))
    named = texts.join(F.broadcast(known), "digest", "left").select(
        "doc_id", F.col("digest").alias("text_digest"), F.when(~F.col("empty"), F.col("license")).alias("license"))
    found = found.withColumnRenamed("doc_id", "_id")
    return named.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "text_digest", "license", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
