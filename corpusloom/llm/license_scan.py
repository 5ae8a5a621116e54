"""Licence scan by canonical digest lookup.

A text is normalised so that copies of a licence that differ in case, punctuation, line breaks, copyright lines or
equivalent spellings get one form; the SHA-256 of the whole form is looked up among those of known licences by a hash
join. Each line is looked up the same way among known one-line notices. The texts are read once; only digests are
joined, and only those of lines whose form is as long as that of a known notice leave the scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside_ids, fitted

#: Spellings that licence matching guidelines treat alike, each with the form that stands for it.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments",
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
    "merchantibility": "merchantability",
    "modelled": "modeled",
    "modelling": "modeling",
    "noninfringement": "non infringement",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "wilfull",
    "https": "http",
}

#: Licence texts that may be copied verbatim.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}

#: Licence by file below licenses/, with the title that the file begins with.
FILES = {
    "Apache-2.0": ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "GPL-1": ("GPL-1.0-only", "GNU General Public License Version 1, February 1989"),
    "GPL-2": ("GPL-2.0-only", "GNU General Public License Version 2, June 1991"),
    "GPL-3": ("GPL-3.0-only", "GNU General Public License Version 3, 29 June 2007"),
    "LGPL-2": ("LGPL-2.0-only", "GNU Library General Public License Version 2, June 1991"),
    "LGPL-2.1": ("LGPL-2.1-only", "GNU Lesser General Public License Version 2.1, February 1999"),
    "LGPL-3": ("LGPL-3.0-only", "GNU Lesser General Public License Version 3, 29 June 2007"),
    "MPL-1.1": ("MPL-1.1", "Mozilla Public License Version 1.1"),
    "MPL-2.0": ("MPL-2.0", "Mozilla Public License Version 2.0"),
    "CC0-1.0": ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    "GFDL-1.2": ("GFDL-1.2-only", "GNU Free Documentation License Version 1.2, November 2002"),
    "GFDL-1.3": ("GFDL-1.3-only", "GNU Free Documentation License Version 1.3, 3 November 2008"),
}
#: Titles that stand above a text without being part of it.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero-Clause License (0BSD)", "0BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License"),
    "CC0-1.0": ("CC0 1.0 Universal",),
}
END = "END OF TERMS AND CONDITIONS"

#: One-line notices.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-only",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    "Released into the public domain under CC0 1.0.": "CC0-1.0",
}

#: A line that states a copyright; one that only begins with the word, as wrapped licence texts have, isn't.
_COPYRIGHT = re.compile(r"^[ \t*#/;.-]*(?:copyright[ \t]*(?:\(c\)|©|[:,]?[ \t]*\d{4}|by\b|[\[<])|\(c\)[ \t]|©|all rights reserved\b).*$", re.MULTILINE)
_MARKER = re.compile(r"^[ \t]*(?:[*#/;>|-]+|\(?(?:\d{1,2}|[a-z])[.)])(?=[ \t])", re.MULTILINE)
_WORD = re.compile(r"[^\W_]+")


def canonical(text: str | None) -> str:
    """The form of a text: lower case, no copyright lines, bullets, list numbers or punctuation, one spelling, single spaces."""
    if not text:
        return ""
    low = _MARKER.sub("", _COPYRIGHT.sub("", text.lower()))
    return " ".join([EQUIVALENT.get(w, w) for w in _WORD.findall(low)])


def _digest(form: str) -> bytes:
    return hashlib.sha256(form.encode("utf-8", "ignore")).digest()


def _stored(name: str) -> str:
    return (Path(__file__).parent / "licenses" / f"{name}.txt").read_text(encoding="utf-8")


def license_texts() -> list[tuple[str, str]]:
    """(license_id, text) of all known texts, some in several wordings."""
    out = [*LICENSES.items(), *((k, _stored(name)) for name, (k, _) in FILES.items())]
    bsd = _stored("BSD")
    third = bsd[bsd.index("3. Neither") : bsd.index("THIS SOFTWARE")]
    for who in ("", "HOLDER", "OWNER"):
        three = bsd
        if who:
            three = bsd.replace("BY THE REGENTS", "BY THE COPYRIGHT HOLDERS").replace("THE REGENTS OR", f"THE COPYRIGHT {who} OR")
        out.append(("BSD-2-Clause", three.replace(third, "\n")))
        out += [("BSD-3-Clause", three.replace("the University nor", f"{x} nor")) for x in ("the University", "the copyright holder", "the copyright holders")]
    return out


def license_forms() -> list[tuple[str, str]]:
    """(form, license_id) of the known texts, with and without title and what follows their terms."""
    out, titles = [], {k: {canonical(t) for t in v} for k, v in TITLES.items()}
    for k, title in FILES.values():
        titles.setdefault(k, set()).add(canonical(title))
    for k, text in license_texts():
        cuts = {text, *(text[: text.index(END) + n] for n in (0, len(END)) if END in text)}
        for form in map(canonical, cuts):
            bare = form
            for t in sorted(titles.get(k, ()), key=len, reverse=True):
                bare = bare.removeprefix(t + " ")
            out += [(form, k), (bare, k), *((f"{t} {bare}", k) for t in titles.get(k, ()))]
    return out


def known_licenses(spark: SparkSession, licenses: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id, whole, chars) of licence texts and of notices; chars is the length of the form."""
    forms = license_forms() if licenses is None else [(canonical(t), k) for k, t in licenses.items()]
    rows: dict[bytes, tuple[str, bool, int]] = {}
    for f, k in forms:
        rows.setdefault(_digest(f), (k, True, len(f)))
    for t, k in (NOTICES if notices is None else notices).items():
        f = canonical(t)
        rows.setdefault(_digest(f), (k, False, len(f)))
    return spark.createDataFrame([(bytearray(d), *r) for d, r in rows.items()], "digest binary, license_id string, whole boolean, chars int")


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row for each doc_id: doc_id, n_words, canonical_sha256, license_id, notice_ids.

    license_id is the known licence that the whole text is, or a notice if that is all there is; null if none.
    notice_ids are the distinct licences whose notice stands as a line in the text, sorted. A text that is null, empty or has no words has n_words 0, matches nothing, and has the digest of the empty
    form. Rows that share a doc_id are one document: their notices are joined, and the first of their licences and the
    sum of their words are given. known is broadcast if it is small; without a
    column chars, all lines are looked up.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    # only lines whose form is as long as that of a notice can be one
    lengths = {r["chars"] for r in known.where("not whole").select("chars").distinct().collect()} if "chars" in known.columns else None

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, whole, lines = [], [], []
            for text in b.column("text").to_pylist():
                form = canonical(text)
                n.append(form.count(" ") + 1 if form else 0)
                whole.append(_digest(form))
                split = (text or "").splitlines()
                short = {form} if len(split) == 1 else set(map(canonical, split))
                short = {f for f in short if f and (lengths is None or len(f) in lengths)}
                lines.append([_digest(f) for f in sorted(short)])
            yield beside_ids(b, {"n_words": pa.array(n, pa.int64()), "whole": pa.array(whole, pa.binary()), "lines": pa.array(lines, pa.list_(pa.binary()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(digests, f"doc_id {kind}, n_words long, whole binary, lines array<binary>")
    marks = rows.select("doc_id", "n_words", "whole", F.explode(F.concat(F.array(F.struct(F.col("whole").alias("digest"), F.lit(True).alias("all"))), F.transform("lines", lambda x: F.struct(x.alias("digest"), F.lit(False).alias("all"))))).alias("m"))
    marks = marks.select("doc_id", "whole", "m.digest", "m.all", F.when(F.col("m.all"), F.col("n_words")).alias("n_words"))
    found = marks.join(fitted(known.select("digest", "license_id", F.col("whole").alias("is_text"))), "digest", "left")
    hit = F.col("license_id").isNotNull()
    return found.groupBy("doc_id").agg(
        F.sum("n_words").alias("n_words"),
        F.min(F.lower(F.hex("whole"))).alias("canonical_sha256"),
        F.min(F.when(hit & F.col("all") & (F.col("n_words") > 0), F.col("license_id"))).alias("license_id"),
        F.array_sort(F.collect_set(F.when(hit & ~F.col("all") & ~F.col("is_text"), F.col("license_id")))).alias("notice_ids"),
    )
