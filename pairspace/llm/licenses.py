"""Licence texts by canonical digest [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import col, pack, unpack, without

# Spellings that count as equal, as in the public matching guidelines for licence texts.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "http": "https",
}

# Full texts of short public licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
TEXTS = {
    "MIT": [MIT, "The MIT License (MIT) " + MIT, "MIT License " + MIT],
    "ISC": [ISC, "ISC License " + ISC],
    "BSD-2-Clause": [f"{BSD_TERMS} {BSD_WARRANTY}", f"BSD 2-Clause License {BSD_TERMS} {BSD_WARRANTY}"],
    "BSD-3-Clause": [
        f"{BSD_TERMS} {BSD_NAMES} {BSD_WARRANTY}",
        f"BSD 3-Clause License {BSD_TERMS} {BSD_NAMES} {BSD_WARRANTY}",
    ],
    "Apache-2.0": [APACHE_HEADER],
}
# How notices name a licence.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    **{
        f"{code.replace(' ', '-')}-{version}": [f"{code} {version}", f"Creative Commons {words} {version} License"]
        for code, words in [
            ("CC BY", "Attribution"),
            ("CC BY-SA", "Attribution-ShareAlike"),
            ("CC BY-NC", "Attribution-NonCommercial"),
            ("CC BY-ND", "Attribution-NoDerivatives"),
            ("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        ]
        for version in ("3.0", "4.0")
    },
}
# Words and digest of the canonical form of long full texts; those with an appendix also without it, with and
# without the line that ends the terms.
FULL_TEXTS = [
    ("Apache-2.0", 1571, "cc411e5c73676ae13e68bf0fe2c031a62b3a1ef56829577a7d168699686c1e7e"),
    ("Apache-2.0", 1395, "f16a2c71cdef52763eb4e8d07430ba72c05356a4e2204a12f3995c1ee5d38fde"),
    ("Apache-2.0", 1400, "bb9623a3f15021216105e0ed4e2426d8ef8863d7c5f58860ef1cd2bf983015cf"),
    ("Artistic-1.0-Perl", 960, "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304"),
    ("BSD-3-Clause", 217, "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", 1088, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 3305, "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86"),
    ("GFDL-1.3", 3710, "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0", 2067, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", 1636, "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", 1641, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", 2965, "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0", 2489, "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-2.0", 2494, "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-3.0", 5662, "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f"),
    ("GPL-3.0", 5214, "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943"),
    ("GPL-3.0", 5219, "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"),
    ("LGPL-2.0", 4165, "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.0", 3825, "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"),
    ("LGPL-2.0", 3830, "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.1", 4366, "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-2.1", 4025, "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"),
    ("LGPL-2.1", 4030, "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-3.0", 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 3760, "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", 2414, "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7"),
    ("CC-BY-SA-4.0", 2809, "def99b23ba8930a02c111ffb99c0c4f55f9fd9bb38ad3ffe9df58fde3aac4247"),
]
SUBJECTS = ["", *[f"{a} {b} is " for a in ("this", "the") for b in ("work", "software", "project", "file", "text", "code")]]
VERBS = ["licensed", "released", "distributed", "available", "published"]

COPYRIGHT = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"
# a known text holds one of these words unbroken before it is normalised, in one of its spellings
WORDS = "licen|permission|redistribution|released|distributed|available|published"
# the same for the SQL, which misses notices whose words are parted by anything but one blank
ANCHORS = "licen|permission|redistribution|released under|distributed under|available under|published under"


def known_notices() -> list[tuple[str, str]]:
    """(licence, text) of all known texts: full ones, and notices built by rule from names."""
    full = [(name, text) for name, texts in TEXTS.items() for text in texts]
    notices = [
        (name, f"{subject}{verb} under {article}{words}")
        for name, said in NAMES.items()
        for words in said
        for subject in SUBJECTS
        for verb in VERBS
        for article in ("", "the ")
    ]
    return full + notices


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words of letters and digits only, one spelling each."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    words = F.split(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), " ")
    spelling = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(spelling[w], w)), " ")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(canonical(text), "UTF-8"), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """``license, digest, words`` of every known text, one row per digest; its size depends on the tables above only."""
    table = spark.createDataFrame(known_notices(), "license string, known string")
    said = F.col("known")
    table = table.select("license", F.size(F.split(canonical(said), " ")).alias("words"), digest(said).alias("digest"))
    table = table.unionByName(spark.createDataFrame(FULL_TEXTS, "license string, words int, digest string"))
    return table.groupBy("digest").agg(F.min("license").alias("license"), F.min("words").alias("words"))


def paragraph_runs(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``row, unit, digest`` of the runs of several paragraphs, short of the whole ``text``, that have one of ``lengths`` words.

    Paragraphs without canonical words belong to no run's ends. ``unit`` goes on after the other units.
    """
    # no canonical word
    mark = "|"
    paragraphs = F.filter(F.transform(F.split("text", r"\n[ \t\r]*\n"), canonical), lambda p: p != "")
    marked = F.split(F.array_join(paragraphs, f" {mark} "), " ")
    rows = rows.filter(F.col("text").rlike(r"\n[ \t\r]*\n")).select("row", F.size(units_of("text")).alias("after"), F.explode(F.array(marked)).alias("marked"))
    places = F.filter(F.transform("marked", lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())
    words = F.filter("marked", lambda w: w != mark)
    # words before each paragraph, and before the end
    borders = F.concat(F.array(F.lit(0)), F.transform(places, lambda i, k: i - k), F.array(F.size(words)))
    rows = rows.select("row", "after", F.explode(F.array(F.struct(words.alias("words"), borders.alias("borders")))).alias("t")).select("row", "after", "t.*")
    ends = F.transform(
        F.array(*map(F.lit, lengths)),
        lambda n: F.transform(
            F.array_intersect(F.col("borders"), F.transform("borders", lambda b: b + n)), lambda e: F.struct((e - n).alias("start"), n.alias("n"))
        ),
    )
    several = lambda r: F.exists("borders", lambda b: (b > r["start"]) & (b < r["start"] + r["n"]))
    found = F.filter(F.flatten(ends), lambda r: (r["n"] < F.size("words")) & several(r))
    said = F.array_distinct(F.transform(found, lambda r: F.array_join(F.slice("words", r["start"] + 1, r["n"]), " ")))
    rows = rows.select("row", "after", F.posexplode(said).alias("at", "said"))
    return rows.select("row", (F.col("after") + F.col("at")).alias("unit"), F.sha2(F.encode("said", "UTF-8"), 256).alias("digest"))


def units_of(text: str) -> Column:
    """The distinct units that are compared whole: the text, its paragraphs, its lines."""
    return F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n")))


def scan_licenses(docs: DataFrame, text: str, known: DataFrame | None = None) -> DataFrame:
    """Licences of whole texts and of their blocks: one row for each distinct unit of a row that matches.

    Units are the whole text, its paragraphs (between blank lines), its
    lines and, without ``known``, all runs of paragraphs with as many words as a known text; equal units of one text count once. The result has the columns of
    ``docs`` but ``text``, and ``unit`` (place in the list of distinct units, 0 is the whole
    text), ``license`` and ``digest``; input columns of these names are replaced. A unit is
    compared whole: text before or after a notice in the same unit means no match.
    Null and empty texts match nothing; a repeated row gives its matches again.

    A unit that holds none of the anchor words cannot equal a known text and is
    dropped before it is normalised. ``known`` (``license, digest``) is small by construction
    when left out; a table of the caller's is broadcast only if Spark finds it small.
    """
    anchored = "(?i)" + WORDS
    if known is None:
        known = known_digests(docs.sparkSession)
        # a few dozen numbers
        lengths = sorted(r["words"] for r in known.select("words").distinct().collect())
        known = F.broadcast(known.drop("words"))
        possible = lambda c: c.rlike(anchored)
    else:
        lengths = []
        possible = lambda c: c != ""
    docs = without(docs, ["unit", "license", "digest"])
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(pack(docs.select(*[col(c) for c in rest])).alias("row") if rest else F.lit(None).alias("row"), col(text).alias("text"))
    rows = rows.filter(possible(F.col("text")))
    found = (
        rows.select("row", F.posexplode(units_of("text")).alias("unit", "said"))
        .filter(possible(F.col("said")))
        .select("row", "unit", digest(F.col("said")).alias("digest"))
    )
    if lengths:
        found = found.unionByName(paragraph_runs(rows, lengths))
    found = found.join(known, "digest")
    return found.select(*unpack(found, "row", rest), "unit", "license", "digest")


def sql_canonical(text: str) -> str:
    """The same canonical form in SQL, for checks."""
    spelling = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items()) + "}"
    plain = f"regexp_replace(lower({text}), '{COPYRIGHT}', ' ', 'g')"
    words = rf"string_split(trim(regexp_replace({plain}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: coalesce(({spelling})[w], w)), ' ')"

