"""License scans by canonical digest: whole texts, and whole lines, equal to a known licence after normalising.

Normalising drops copyright lines, takes letters in lower case, turns equivalent spellings into one and every run
of other characters than letters, digits and code points above ASCII into one space. The digest of what is
left is looked up by a hash join.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm.scratch import stored
from hazardlens.llm.secret_scan import let

#: A line that only states who holds the rights.
COPYRIGHT_LINE = r"^[ \t\r#*/;-]*(portions )?(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Equivalent spellings, as whole words: fixed values of public licence matching guidelines.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("sublicence", "sublicense"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"),
]

ANY_SPELLING = "(^| )(" + "|".join(old for old, _ in SPELLINGS) + ")( |$)"

#: Notices and short licences, public texts.
TEXTS = [
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
     "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
     "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
     "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE "
     "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
     "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
     "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
     "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\nEveryone is permitted to copy and "
     "distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name "
     "is changed.\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND "
     "MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n"
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
     "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
     "the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]

#: Conditions and disclaimer of the BSD licences; the third clause is left out in the 2-clause one.
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
       "following conditions are met:\n{0}Redistributions of source code must retain the above copyright notice, this list "
       "of conditions and the following disclaimer.\n{1}Redistributions in binary form must reproduce the above copyright "
       "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
       "with the distribution.\n{2}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
       "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
       "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
       "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
       "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
       "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
       "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
BSD_THIRD = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission.\n")
#: Whole texts in ``license_texts``; their first paragraph is the title.
LONG_TEXTS = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
#: What follows is instructions for authors, which copies often leave out.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"

#: Names that licence lines call a licence by.
NAMES = [
    ("MIT", "the MIT License"), ("ISC", "the ISC License"), ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Apache-2.0", "the Apache License 2.0"), ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"), ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "the Mozilla Public License 2.0"), ("MPL-2.0", "the Mozilla Public License, v. 2.0"),
    ("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "CC0 1.0 Universal"),
]
NAMES += [(f"{short}-{version}", f"the GNU {name}General Public License{then}{version.removesuffix('.0')}{end}")
          for short, name, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser ", ("2.1", "3.0")), ("AGPL", "Affero ", ("3.0",)))
          for version in versions for then in (", version ", " v") for end in ("", ".0") if not (end and version == "2.1")]
CREATIVE_COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                    ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
NAMES += [(f"CC-{short}-{version}", form.format(short, long, version, area))
          for short, long in CREATIVE_COMMONS
          for version, area in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))
          for form in ("CC {0} {2}", "the CC {0} {2} License", "a Creative Commons {1} {2} {3} License",
                       "the Creative Commons {1} {2} {3} License", "Creative Commons {1} {2} {3}")]
LINES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.",
         "This project is licensed under {}.", "This file is licensed under {}.")


def _variants(text: str) -> list[str]:
    """The text with and without its title, each with and without what follows the terms."""
    body = text.strip("\n").partition("\n\n")[2]
    short = [t.partition(END_OF_TERMS)[0] + end for t in (text, body) if END_OF_TERMS in t for end in ("", END_OF_TERMS)]
    return [text, body, *short]


def _known() -> list[tuple[str, str]]:
    out = list(TEXTS)
    mit, isc = TEXTS[0][1], TEXTS[1][1]
    out += [("MIT", mit.partition("\n")[2]), ("MIT", "The " + mit), ("ISC", "ISC License\n" + isc), ("ISC", "The ISC License\n" + isc)]
    out.append(("WTFPL", TEXTS[2][1].partition("\n")[2]))
    for name, title, third in (("BSD-2-Clause", "BSD 2-Clause License", ""), ("BSD-3-Clause", "BSD 3-Clause License", BSD_THIRD)):
        for numbers in (("1. ", "2. ", "3. "), ("", "", "")):  # bullets are no words
            text = BSD.format(*numbers[:2], third and numbers[2] + third)
            out += [(name, text), (name, f"{title}\n{text}"), (name, f"The {title}\n{text}")]
    for name in LONG_TEXTS:
        out += [(name, t) for t in _variants((files(__package__) / "license_texts" / f"{name}.txt").read_text("utf-8"))]
    out += [(short, line.format(name)) for short, name in NAMES for line in LINES]
    ids = sorted({short for short, _ in out})
    out += [(short, f"SPDX-License-Identifier: {short}{end}") for short in ids
            for end in (("", "-only", "-or-later") if "GPL" in short else ("",))]
    return list(dict.fromkeys(out))


#: (license_id, text): notices, lines and whole texts.
KNOWN = _known()


def canonical(text: Column) -> Column:
    """What is left of a text once case, punctuation, copyright lines and spellings are normalised; null stays null."""
    out = F.replace(F.lower(text), F.lit("https://"), F.lit("http://"))
    out = F.regexp_replace(out, "(?md)" + COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))

    def respelled(words: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
        for old, new in SPELLINGS:
            spaced = F.replace(spaced, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
        return F.trim(F.regexp_replace(spaced, " +", " "))

    # Most texts hold none of the spellings; one look finds that out.
    return let(out, lambda words: F.when(words.rlike(ANY_SPELLING), respelled(words)).otherwise(words))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id, length) of a table (license_id, text); texts that normalise to nothing are left out.

    One text under several ids goes by the least id.
    """
    return (known.select("license_id", canonical(F.col("text")).alias("canonical")).where("canonical <> ''")
            .groupBy(F.sha2("canonical", 256).alias("digest"))
            .agg(F.min("license_id").alias("license_id"), F.max(F.length("canonical")).alias("length")))


def builtin_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def license_scan(documents: DataFrame, known: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, digest, license_id, n_license_lines, line_license_ids) of every row of ``documents``.

    ``license_id`` is that of the known text which the whole text equals, or null. ``n_license_lines`` counts
    the lines that equal a known text, ``line_license_ids`` lists their distinct ids, sorted, by commas. A null
    text has a null digest and no lines. Rows that repeat an id are told apart by their text. The lookups are
    hash joins on the digest; the optimizer sends the known side whole only where it is measured as small.
    """
    known = stored(known_digests(known), "licenses")
    rows = documents.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"),
                            F.col(text_column).alias("text"))
    lines = rows.select("id", "text_key", F.explode(F.split("text", "\n")).alias("line"))
    found = (lines.select("id", "text_key", digest(F.col("line")).alias("digest")).join(known, "digest")
             .groupBy("id", "text_key").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("license_id")).alias("ids")))
    found = found.select(F.col("id").alias("line_id"), F.col("text_key").alias("line_key"), "n", "ids")
    whole = rows.select("id", "text_key", digest(F.col("text")).alias("digest"))
    return (whole.join(known.select(F.col("digest").alias("known_digest"), "license_id"),
                       F.col("digest") == F.col("known_digest"), "left")
            .join(found, F.col("id").eqNullSafe(F.col("line_id")) & (F.col("text_key") == F.col("line_key")), "left")
            .select("id", "digest", "license_id", F.coalesce("n", F.lit(0)).alias("n_license_lines"),
                    F.coalesce(F.array_join("ids", ","), F.lit("")).alias("line_license_ids")))
