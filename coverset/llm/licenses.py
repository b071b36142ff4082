"""Licence scan by canonical digests of whole texts and whole lines."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverset.llm.common import slices, spread, words
from coverset.session import fits_broadcast, materialise

# Lines that name a holder or a year and not a licence (fixed pattern). Lines of a licence's own text that a wrap happens to start with
# "copyright", and clauses marked "(c)", stay.
OWN = r"(?:notices?|holders?|owners?|licen[sc]es?|laws?|statements?|interests?|acts?|and|or|in|of|to|is|for|on|protection|treat(?:y|ies)|infringements?|claims?|rights?|ownership|disclaimers?)"
COPYRIGHT = re.compile(
    r"(?am)^[^\w\n]*(?:"
    r"(?i:copyright|©|\(c\)[ \t]*copyright)(?:[ \t,:;-]|(?i:\(c\)|©|by\b))*(?:(?<=[)©])[ \t]*\S|[<\[{]|[12]\d{3}\b|(?!(?i:" + OWN + r")\b)(?:[A-Z]|[^\x00-\x7f]))"
    r"|(?i:\(c\))[ \t]*[12]\d{3}\b"
    r"|(?i:all rights reserved)[^\w\n]*$"
    r")[^\n]*$"
)

# Equivalent spellings (fixed values, after the public matching guidelines for licence texts).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "https": "http",
}
PHRASES = {"copyright owner": "copyright holder", "non commercial": "noncommercial", "per cent": "percent", "sub license": "sublicense"}

# Known texts (fixed values): licences that are short, and the notices that name one.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("Zlib", _ZLIB),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
]
# Digests of whole texts that are not shipped (fixed values), with and without a title, numbers of clauses or the appendix after the terms:
# of the licence files that Linux distributions and installed Python packages carry, under the pattern above. A change of the pattern,
# spellings or phrases makes them void; a test compares those whose files the machine has.
WHOLE = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-2-Clause", "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
    ("Unlicense", "f507d73d343a3d7b0b7ecd39319f6c349b515eeed80b814918af61cdac69e4a5"),
]


def canonical(text: str | None) -> str:
    """Lower-cased words without copyright lines and punctuation, in one spelling, parted by single spaces."""
    found = [w.decode("utf-8", "replace") for w in words(COPYRIGHT.sub("", text or ""))]
    joined = " " + " ".join([SPELLINGS.get(w, w) for w in found]) + " "
    for phrase, one in PHRASES.items():
        joined = joined.replace(f" {phrase} ", f" {one} ")
    return joined.strip()


def digest(text: str | None) -> str | None:
    """sha256 of the canonical text; None if nothing is left of it."""
    left = canonical(text)
    return hashlib.sha256(left.encode()).hexdigest() if left else None


def known_digests(texts: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    return sorted({(name, digest(text)) for name, text in texts or KNOWN} | set([] if texts else WHOLE))


def known_table(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(license_id, digest)`` of known texts."""
    rows = known_digests(texts)
    return spark.createDataFrame(rows, "license_id string, digest string")


def _units(names):
    """Digests of whole texts, and of lines: all of them, or the licence names among those known (``names``, a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value if names else None
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            found = [{d for line in (t or "").split("\n") if line and (d := digest(line))} for t in texts]
            lines = [sorted({known[d] for d in f if d in known} if known is not None else f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([digest(t) for t in texts], pa.string()), pa.array(lines, pa.list_(pa.string()))], names=["key", "digest", "lines"]
            )

    return run


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, license_id, notices)``, one row for each row of ``docs``.

    ``license_id``: the licence whose known text has the canonical digest of the
    entire document (the first by name, if several). ``notices``: sorted licence
    ids, comma-joined, of the document's lines that are known texts as a whole;
    empty if none. Texts that are null or canonically empty have no digest and
    match nothing, however long a text is. The known digests are broadcast if
    they are counted to be few, and shuffled by digest otherwise. Other columns
    are not read.
    """
    known = known_table(docs.sparkSession) if known is None else known.select("license_id", "digest")
    known = known.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = f"key {kind}, digest string, lines array<string>"
    if fits_broadcast(known, 256):
        # Few and counted: a broadcast hash join by the text's digest; lines are looked up in the same table.
        table = docs.sparkSession.sparkContext.broadcast({r["digest"]: r["license_id"] for r in known.collect()})
        units = rows.mapInArrow(_units(table), fields).withColumn("notices", F.array_join("lines", ","))
        return units.join(F.broadcast(known), "digest", "left").select(F.col("key").alias("doc_id"), "digest", "license_id", "notices")
    units = materialise(rows.mapInArrow(_units(None), fields).withColumn("_row", F.monotonically_increasing_id()))
    lines = units.select("_row", F.explode("lines").alias("digest")).join(known, "digest").groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    return units.join(known, "digest", "left").join(lines, "_row", "left").select(F.col("key").alias("doc_id"), "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
