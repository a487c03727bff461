"""License scan: sparse TF-IDF cosine to notice templates, then nearest-ancestor inheritance.

Texts are cut into notice candidates that hold a cue word of a notice: lines,
and, with comment marks taken off and wrapped lines joined, paragraphs, their
sentences and runs of neighbouring paragraphs with a cue; of files named as
license files also the whole text.  Distinct candidates are scored once
against the templates: term weights are tf * idf, with idf over all candidates
of the corpus, and the cosine only sums the terms a candidate shares with a
template.  A file's own license is its best template at ``MIN_COSINE`` or
more; the opening that both BSD texts share and then "All rights reserved"
decide only where no other template reaches it.  A file is a license file of
its directory when its name says so or when its notice makes up a fifth of its
words; files without a license of their own take that of the nearest ancestor
directory that has one.

Scale.  Texts are scanned once and only candidates leave the scan, so a line
that stands in a third of all files is one row of the scoring.  Candidates are
weighted under a 128-bit digest, not under their text.  Templates are fixed
and broadcast.  Ancestors are joined on the directory's path, one row per
directory on the other side, so a hot directory can be split.

Defined cases: null text holds no notice; a null path has no directory (own
license only); ties of templates go to the smaller id, ties of license files
to the higher cosine, then the smaller license; rows that repeat path and text
are each returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import write_table
from .common import whole_text, words

MIN_COSINE = 0.6
NOTICE_SHARE = 0.2
CUES = r"(?i)licen[sc]e|copyright|rights\W+reserved|spdx|permission|redistribut|warrant|public\W+domain|unlicense|creative\W+commons|\bcc0\b"
LICENSE_NAME = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"

# How comments are written.  Lines that begin with a plain mark are one block, apart from lines without it.
_PLAIN_MARK = r"[ \t]*+(?://|#|--|;|%)"
_MARKS = r"(?dm)^[ \t]*+(?:(?:/{2,}+|#++|\*++|--++|;++|%++)!?+[ \t]*+|dnl[ \t]++)"
_SENTENCE = r"(?<=[A-Za-z0-9][.])\s+(?=[A-Z])"

# Headers and license texts.
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by"
    " the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
)
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} version {1} as published by the Free Software Foundation."
_GNU_ONLY_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; version {1} of the License."


def _gnu(name: str, version: str, title: str) -> list[str]:
    return [f"GNU {name} {title}", *[t.format(name, version) for t in (_GNU, _GNU_ONLY, _GNU_ONLY_2)]]


_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
    " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
    " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software"
    " is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES"
    " OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE"
    " LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
    " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
    " in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
    " from this software without specific prior written permission."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT"
    " NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
    " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
    " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
    " that the above copyright notice and this permission notice appear in all copies."
)
_ISC_REST = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
    " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL"
    " DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER"
    " TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
    " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
    " either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,"
    " or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and"
    " by any means."
)

# Notices, headers, short texts and the titles of long texts, by license.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        _APACHE,
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        _MIT,
        _MIT + _MIT_REST,
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        *_gnu("General Public License", "3", "Version 3, 29 June 2007"),
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        *_gnu("General Public License", "2", "Version 2, June 1991"),
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0", *_gnu("Lesser General Public License", "3", "Version 3, 29 June 2007")],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1", *_gnu("Lesser General Public License", "2.1", "Version 2.1, February 1999")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", *_gnu("Affero General Public License", "3", "Version 3, 19 November 2007")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "BSD-2-Clause": ["Licensed under the 2-Clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD_OPENING + _BSD_TWO + _BSD_END],
    "BSD-3-Clause": [
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        _BSD_OPENING,
        _BSD_OPENING + _BSD_TWO + _BSD_THIRD + _BSD_END,
    ],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", _ISC, _ISC + _ISC_REST],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", _UNLICENSE],
    "Proprietary": ["All rights reserved."],
}
# Templates that decide only where none of a lower rank reaches MIN_COSINE.
RANKS = {_BSD_OPENING: 1, "All rights reserved.": 2}


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), "")


def _digest(notice: str) -> Column:
    return F.md5(F.col(notice).cast("binary"))


def _paragraphs(text: Column) -> Column:
    """The paragraphs of a text without comment marks, every paragraph on one line."""
    t = F.regexp_replace(text, r"\r\n?|\x01", "\n")
    t = F.regexp_replace(t, r"/\*+!?|\*+/|<!--|-->|\"{3}|'{3}", "\n\n")
    t = F.regexp_replace(t, rf"(?dm)^({_PLAIN_MARK}.*+)\n(?!{_PLAIN_MARK})", "$1\n\n")
    t = F.regexp_replace(t, rf"(?dm)^((?!{_PLAIN_MARK}).*+)\n(?={_PLAIN_MARK})", "$1\n\n")
    parts = F.split(F.regexp_replace(t, _MARKS, ""), r"\n(?:[ \t\f\x0B]*+\n)++")
    return F.transform(parts, lambda p: F.regexp_replace(p, r"\s+", " "))


def _candidates(files: DataFrame) -> DataFrame:
    """path, text_key, n_words, nid (digest), notice: every line, sentence, paragraph and run of paragraphs with a cue, spaces collapsed."""
    text = whole_text("text")
    lines = F.split(text, rf"\n|{_SENTENCE}")
    # a paragraph without a cue ends a run
    runs = F.split(F.array_join(F.transform("paragraphs", lambda p: F.when(p.rlike(CUES), p).otherwise("\x01")), " "), "\x01")
    sentences = F.flatten(F.transform("paragraphs", lambda p: F.split(p, _SENTENCE)))
    whole = F.when(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_NAME), F.array(F.array_join("paragraphs", " ")))
    parts = F.concat("lines", "paragraphs", sentences, runs, F.coalesce(whole, F.array().cast("array<string>")))
    cued = F.array_distinct(F.filter(parts, lambda p: p.rlike(CUES)))
    return (
        files.filter(text.rlike(CUES))
        .select("path", F.xxhash64("text").alias("text_key"), F.size(words(text)).alias("n_words"), lines.alias("lines"), _paragraphs(text).alias("paragraphs"))
        .select("path", "text_key", "n_words", F.explode_outer(cued).alias("p"))
        .select("path", "text_key", "n_words", F.array_join(_terms(F.col("p")), " ").alias("notice"))
        .filter("notice <> ''")
        .withColumn("nid", _digest("notice"))
        .dropDuplicates(["path", "text_key", "nid"])
    )


def _weighted(df: DataFrame, key: list[str], text: str, idf: DataFrame) -> DataFrame:
    """Unit-length tf * idf weights per key and term."""
    tf = df.select(*key, F.explode(F.split(text, " ")).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("w"))


def score_notices(notices: DataFrame) -> DataFrame:
    """notice, nid (digest), license, rank, cosine: the best template of every distinct notice, at MIN_COSINE or more."""
    spark = notices.sparkSession
    notices = notices.select("notice", _digest("notice").alias("nid"))
    rows = [(k, i, RANKS.get(t, 0), " ".join(_plain(t))) for k, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    templates = spark.createDataFrame(rows, "license string, variant int, rank int, notice string")
    total = notices.count()
    seen = notices.select(F.explode(F.array_distinct(F.split("notice", " "))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = templates.select(F.explode(F.split("notice", " ")).alias("term")).distinct()
    idf = write_table(
        seen.join(known.withColumn("t", F.lit(1)), "term", "full").select(
            "term", (F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")
        ),
        "license-idf",
    )
    held = F.broadcast(write_table(_weighted(templates, ["license", "variant", "rank"], "notice", idf), "license-templates"))  # fixed templates
    weights = _weighted(notices, ["nid"], "notice", idf)
    cosine = weights.join(held.withColumnRenamed("w", "tw"), "term").groupBy("nid", "license", "variant", "rank").agg(
        F.round(F.sum(F.col("w") * F.col("tw")), 9).alias("cosine")
    )
    best = cosine.filter(F.col("cosine") >= MIN_COSINE).groupBy("nid").agg(F.min(F.struct("rank", (-F.col("cosine")).alias("c"), "license")).alias("b"))
    return notices.join(best, "nid").select("notice", "nid", F.col("b.license").alias("license"), F.col("b.rank").alias("rank"), (-F.col("b.c")).alias("cosine"))


def _plain(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def scan(files: DataFrame) -> DataFrame:
    """path, text_key, license, cosine, how ("own", "inherited" or null) of every row of files (path, text)."""
    found = write_table(_candidates(files), "license-candidates")
    scored = write_table(score_notices(found.select("notice").distinct()).drop("notice"), "license-scores")
    per_license = (
        found.select("path", "text_key", "n_words", "nid", F.size(F.split("notice", " ")).alias("len")).join(scored, "nid")
        .groupBy("path", "text_key", "license", "rank")
        .agg(F.min(-F.col("cosine")).alias("c"), F.max("len").alias("len"), F.max("n_words").alias("n_words"))
    )
    best = F.min(F.struct("rank", "c", "license", "len"))
    own = write_table(
        per_license.groupBy("path", "text_key").agg(best.alias("b"), F.max("n_words").alias("n_words"))
        .select(
            "path", "text_key", F.col("b.license").alias("license"), F.col("b.rank").alias("rank"), (-F.col("b.c")).alias("cosine"),
            (F.col("b.len") >= NOTICE_SHARE * F.col("n_words")).alias("mostly"),
        ),
        "license-own",
    )
    folder, name = F.regexp_extract("path", r"^(.*/)[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    governing = (
        own.filter(F.col("path").isNotNull() & (F.col("mostly") | name.rlike(LICENSE_NAME)))
        .groupBy(folder.alias("dir")).agg(F.min(F.struct("rank", (-F.col("cosine")).alias("c"), "license")).alias("b"))
        .select("dir", F.col("b.license").alias("d_license"), (-F.col("b.c")).alias("d_cosine"))
    )
    keyed = files.select("path", F.xxhash64("text").alias("text_key"))
    # every directory above a file, once per directory: "a/b/" has "a/b/", "a/" and ""
    dirs = keyed.filter("path is not null").select(folder.alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = dirs.select(
        "dir",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(steps) - 1),
                lambda i: F.struct(i.alias("depth"), F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))).alias("up")),
            )
        ).alias("a"),
    ).select("dir", "a.depth", "a.up")
    nearest = (
        above.join(governing.withColumnRenamed("dir", "up"), "up").groupBy("dir")
        .agg(F.max(F.struct("depth", "d_license", "d_cosine")).alias("n")).select(F.col("dir").alias("n_dir"), "n.d_license", "n.d_cosine")
    )
    own_side = own.select(F.col("path").alias("o_path"), F.col("text_key").alias("o_key"), "license", "cosine")
    rows = keyed.join(own_side, F.col("path").eqNullSafe(F.col("o_path")) & (F.col("text_key") == F.col("o_key")), "left")
    return rows.join(nearest, folder == F.col("n_dir"), "left").select(
        "path", "text_key",
        F.coalesce("license", "d_license").alias("license"), F.coalesce("cosine", "d_cosine").alias("cosine"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("d_license").isNotNull(), "inherited").alias("how"),
    )
