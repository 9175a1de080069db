"""License scans: MinHash bands over overlapping windows, then exact containment (operator 9; DataFrame functions only).

Words are runs of ASCII letters and digits of the lower-cased text, shingles are three words. For every length
class of templates the text is cut into windows of twice the class's words that begin every class's words, so
each occurrence of a template of that class lies whole in some window. The windows' MinHash values, each a band
of one row, are looked up among those of the templates; BANDS of them make a miss of a whole template in a window
at most (1 - J) ** BANDS, where J is at least (m - 2) / (2 c - 2) for m words in class c: below 1e-6 for the
templates here. Then the share of the template's shingles that the window holds is computed exactly.

Templates that share half of their shingles or more are siblings, such as the versions of one license. Against each
sibling the window must hold a shingle that the template has and the sibling hasn't (the one with the version), so
a statement of version 3 isn't one of version 2 too.

Positions of all texts are joined with the templates' shingles, a table of its own, so the cost of a position doesn't grow
with the number or length of templates, and only positions with a shingle of some template leave their task. A window's
set is what it holds of the shingles of its class's templates: what else it holds can only lower J. Templates and their
shingles are broadcast up to MOST shingles, which are counted first, and joined by a shuffle beyond; one of fewer
than three words is an error. Null and empty texts match nothing. Null ids
pass through; rows are told apart by id and text, so repeated rows are one result. Ties: all templates of one place
that reach the threshold are listed. Very long texts are read whole; a window is bounded by its template. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BANDS = 64
THRESHOLD = 0.8
STEP = 4
#: Shingles of templates that a broadcast may hold.
MOST = 500_000

#: Statements, opening passages and whole texts of well-known licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "All-rights-reserved": "No part of this work may be reproduced. All rights reserved.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
        IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
        dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "GNU-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles_of(words: Column) -> Column:
    """Hash of every three words in a row, in order; empty with fewer words.

    The words are bound to a lambda's variable, so that they are made once and not anew for each position
    wherever the optimizer moves this expression.
    """

    def hashes(w: Column) -> Column:
        return F.when(
            F.size(w) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), hashes), F.lit(0))


def bands_of(shingles: Column) -> Column:
    """One key for each MinHash function: the function's number with the least hash under it."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda k: F.xxhash64(k, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k)))),
    )


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(license_id, shingles, class) of each template."""
    rows = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license_id string, statement string")
    short = F.raise_error(F.concat(F.lit("fewer than three words: "), "license_id")).cast("array<string>")
    return (
        rows.withColumn("w", words_of(F.col("statement")))
        .withColumn("w", F.when(F.size("w") >= 3, F.col("w")).otherwise(short))
        .select(
            "license_id",
            F.array_distinct(shingles_of(F.col("w"))).alias("shingles"),
            (F.ceil(F.size("w") / STEP) * STEP).cast("int").alias("class"),
        )
    )


def telling_shingles(known: DataFrame) -> DataFrame:
    """(license_id, telling): for each sibling of a template the shingles that the template has and the sibling hasn't."""
    each = known.select("license_id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    other = each.select(F.col("license_id").alias("sibling"), "shingle")
    near = (
        each.join(other, "shingle").where("license_id <> sibling")
        .groupBy("license_id", "sibling", "n").agg(F.count("*").alias("shared")).where("2 * shared >= n")
    )
    theirs = known.select(F.col("license_id").alias("sibling"), F.col("shingles").alias("theirs"))
    own = near.join(known.select("license_id", "shingles"), "license_id").join(theirs, "sibling")
    own = own.withColumn("own", F.array_except("shingles", "theirs")).where(F.size("own") > 0)
    return own.groupBy("license_id").agg(F.collect_list("own").alias("telling"))


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, license_id, n_windows, containment, first_word): licenses found in each document."""
    known = template_table(docs.sparkSession, templates)
    few = (known.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= MOST
    small = F.broadcast if few else (lambda df: df)
    told = known.join(telling_shingles(known), "license_id", "left").select(
        "license_id", F.col("shingles").alias("wanted"), F.coalesce("telling", F.array()).alias("telling")
    )
    banded = known.select("license_id", "class", F.explode(bands_of(F.col("shingles"))).alias("band"))
    vocabulary = known.select("class", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.collect_set("class").alias("classes"))
    positions = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.posexplode(shingles_of(words_of(F.col(text_col)))).alias("p", "shingle")
    )
    hits = positions.join(small(vocabulary), "shingle").select("doc_id", "row", "p", "shingle", F.explode("classes").alias("class"))
    # the windows that hold a hit: the one that its class's grid begins at or before it, and the one before
    window = (F.floor(F.col("p") / F.col("class")) - F.col("back")).cast("int").alias("window")
    windows = (
        hits.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"))
        .select("doc_id", "row", "class", window, "p", "shingle")
        .where((F.col("window") >= 0) & (F.col("p") < F.col("window") * F.col("class") + 2 * F.col("class") - 2))
        .groupBy("doc_id", "row", "class", "window").agg(F.collect_set("shingle").alias("own"))
    )
    retrieved = windows.withColumn("band", F.explode(bands_of(F.col("own")))).join(small(banded), ["class", "band"])
    found = (
        retrieved.join(small(told), "license_id")
        .withColumn("containment", F.size(F.array_intersect("wanted", "own")) / F.size("wanted"))
        .where((F.col("containment") >= threshold) & F.forall("telling", lambda t: F.arrays_overlap(t, "own")))
    )
    return found.groupBy("doc_id", "row", "license_id").agg(
        F.countDistinct("window").alias("n_windows"),
        F.max("containment").alias("containment"),
        F.min(F.col("window") * F.col("class")).cast("long").alias("first_word"),
    ).drop("row")


def miss_bound(words: int, bands: int = BANDS, step: int = STEP) -> float:
    """The most that the bands miss a whole template of ``words`` words that lies in a window of its class."""
    c = math.ceil(words / step) * step
    return (1 - (words - 2) / max(1, 2 * c - 2)) ** bands
