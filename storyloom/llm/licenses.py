"""License scans with DataFrame functions only: TF-IDF cosine to templates, and inheritance along directories."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import table

HEADER_SIMILARITY = 0.75
FILE_SIMILARITY = 0.75
#: Notices that stand in headers of files.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Apache-2.0 OR MIT": ["SPDX-License-Identifier: MIT OR Apache-2.0", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "0BSD": ["Licensed under the Zero-Clause BSD License.", "SPDX-License-Identifier: 0BSD"],
    "AGPL-3.0": ["SPDX-License-Identifier: AGPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU Affero General Public License, version 3."],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)", "SPDX-License-Identifier: BSL-1.0"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2.", "SPDX-License-Identifier: EUPL-1.2"],
    "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1-only", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."],
    "WTFPL": ["Licensed under the WTFPL.", "SPDX-License-Identifier: WTFPL"],
    "Zlib": ["Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Licences as a whole.
TEXTS = {
    "MIT": "MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_END,
    "ISC": "ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "BSD Zero Clause License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "zlib License. Copyright (c). This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
#: How the long licences open; a text that begins so is the licence as a whole.
OPENINGS = {
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Artistic-2.0": "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation.",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal",
    "EPL-2.0": "Eclipse Public License - v 2.0",
    "EUPL-1.2": "EUROPEAN UNION PUBLIC LICENCE v. 1.2 EUPL (c) the European Union 2007, 2016",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}
TEMPLATES = [(name, "notice", text) for name, texts in NOTICES.items() for text in texts] + [(name, "text", text) for name, text in TEXTS.items()] + [(name, "opening", text) for name, text in OPENINGS.items()]
_MARKER = r"(?m)^[ \t]*(?:[#*;%>|!]+|/[/*]+|--+|<!--|\(\*)?[ \t]*"
_TERM = "[^a-z0-9]+"
_FUNCTION = frozenset("a above all an and any are as at be but by can do either even for from have if in into is it its may more must no nor not of on one only or other our out shall should so such than that the their these they this to under was way which whom will with you your".split())
#: Ordinary words, which are cues only where a template has no others.
_COMMON = frozenset(
    "a above act action all along an and any anyone appear are as at author authors basis be benefit business but by can caused charge claim code commercial conditions contract copies copy data deal details direct distribute do documentation either even event except express failure "
    "fee file files following for form forms free from general have hereby holder holders hope however if implied in including interest is it january june kind law laws limited list loss make materials may means met must name names no not notice obtain of on one only or other out party perpetuity permission "
    "permitted person place possibility prior product products profits program provided public purpose received release released retain rights see sell service services shall should so source special specific strict subject such terms that the their theory these they this to under use used user version "
    "way whatsoever which whether will with without work write written you your".split()
)


def damped(n: int) -> float:
    """Term frequency: 1 + ln n, so that words that are frequent everywhere don't make up most of a long licence."""
    return 1 + math.log(n) if n else 0.0


def constant(values: list[str]) -> Column:
    """An array literal as one expression, not one for each element."""
    return F.split(F.lit(" ".join(values)), " ")


def template_terms() -> tuple[dict[str, list[float]], dict[str, float], float]:
    """Each term's unit-length TF-IDF weights by template, each term's idf, and that of an unknown term."""
    bags = [Counter(re.findall(r"[a-z0-9]+", text.lower())) for _, _, text in TEMPLATES]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    norms = [math.sqrt(sum((damped(n) * idf[t]) ** 2 for t, n in bag.items())) for bag in bags]
    weights = {t: [damped(bag[t]) * idf[t] / norm for bag, norm in zip(bags, norms, strict=True)] for t in sorted(df)}
    return weights, idf, math.log(1 + len(bags)) + 1


def cues(least: float) -> list[str]:
    """Terms of which a text that reaches a cosine of ``least`` holds one at least.

    By Cauchy and Schwarz the cosine to a template is at most the root of the squared weights of the terms that both have. So of each template enough terms are
    taken for the squares of the others to add up to less than least squared; common words last.
    """
    weights, _, _ = template_terms()
    found = set()
    for i in range(len(TEMPLATES)):
        terms = sorted((t for t, w in weights.items() if w[i] > 0), key=lambda t: (2 if t in _FUNCTION or len(t) < 3 else int(t in _COMMON or t.isdigit()), -weights[t][i], t))
        left = 1.0
        for t in terms:
            if left < least**2 - 1e-9:
                break
            found.add(t)
            left -= weights[t][i] ** 2
    return sorted(found)


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _TERM), lambda t: t != "")


def reachable(text: Column, least: float) -> Column:
    """Whether the terms of ``text`` allow a cosine of ``least`` to any template; loses nothing.

    By Cauchy and Schwarz the squared cosine is at most the squared weights of the terms that both have, times the share of known terms in the text's squared norm. Of that share the known terms
    number k and occur m times at most; as (1 + ln n)^2 is concave, their part of the norm is at most k (1 + ln(m / k))^2 times the largest squared idf; each unknown term adds its own
    squared idf at least.
    """
    weights, idf, unknown = template_terms()
    squares = F.from_json(F.lit(json.dumps({t: [v * v for v in w] for t, w in weights.items()})), "map<string,array<double>>")
    zero = F.array_repeat(F.lit(0.0), len(TEMPLATES))
    rare, top = unknown**2, max(idf.values()) ** 2

    def may(terms: Column) -> Column:
        n, known = F.size(terms), F.array_intersect(terms, constant(list(weights)))
        k = F.greatest(F.size(known), F.lit(1))
        others = F.size(F.array_distinct(terms)) - F.size(known)
        part = F.lit(top) * k * F.pow(1 + F.log(F.greatest((n - others) / k, F.lit(1.0))), F.lit(2.0))
        most = F.array_max(F.aggregate(known, zero, lambda s, t: F.zip_with(s, squares[t], lambda a, b: a + b)))
        share = part / (part + others * F.lit(rare))
        # the second part is only looked at where the first allows it
        return F.when(share >= least**2 - 1e-9, most * share >= least**2 - 1e-9).otherwise(False)

    return F.get(F.transform(F.array(terms_of(text)), may), 0)  # so that the terms are made once


def similar(units: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., license, kind, similarity): the best template for each unit, by sparse TF-IDF cosine."""
    weights, idf, unknown = template_terms()
    spark = units.sparkSession
    known = F.broadcast(spark.createDataFrame([(t, idf[t], w) for t, w in weights.items()], "term string, idf double, weights array<double>"))  # a fixed table
    counts = units.select(*keys, F.explode(F.split(F.lower(text), _TERM)).alias("term")).where("term <> ''").groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(known, "term", "left")
    weight = (1 + F.log("n")) * F.coalesce("idf", F.lit(unknown))
    dots = [F.coalesce(F.sum(weight * F.col("weights")[i]), F.lit(0.0)).alias(f"dot{i}") for i in range(len(TEMPLATES))]
    summed = rows.groupBy(*keys).agg(F.sqrt(F.sum(weight * weight)).alias("norm"), *dots)
    best = F.array_max(F.array(*[F.struct(F.round(F.col(f"dot{i}") / F.col("norm"), 6).alias("similarity"), F.lit(-i).alias("first"), F.lit(name).alias("license"), F.lit(kind).alias("kind")) for i, (name, kind, _) in enumerate(TEMPLATES)]))
    return summed.select(*keys, best.alias("best")).select(*keys, "best.license", "best.kind", "best.similarity")


def units(text: Column) -> Column:
    """Array of (kind, text): the whole text, its blocks (runs of lines without a blank one, comment signs taken off), the sentences of blocks, and lines cut at ends of sentences."""
    blocks = F.transform(F.split(text, r"\n[ \t\r]*\n\s*"), lambda b: F.regexp_replace(F.regexp_replace(b, _MARKER, ""), r"\s+", " "))
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?<=[.!?])\s+")))

    def named(kind: str, of: Column) -> Column:
        return F.transform(of, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))

    first = F.transform(F.slice(F.filter(blocks, lambda b: b.rlike("[A-Za-z0-9]")), 1, 1), lambda x: F.struct(F.lit("first").alias("kind"), x.alias("text")))
    return F.concat(named("whole", F.array(F.regexp_replace(text, _MARKER, ""))), first, named("part", F.array_distinct(F.concat(blocks, sentences, F.split(text, r"\n|(?<=[.!?])\s+")))))


def own_licenses(files: DataFrame, header: float = HEADER_SIMILARITY, whole: float = FILE_SIMILARITY) -> DataFrame:
    """(path, text_hash, license, similarity, is_file) of the files that name a licence: in a block, sentence or line, or as a whole.

    What can't reach the limits is left out before any shuffle, by bounds that lose nothing: texts and units without a cue, then units whose terms don't suffice.
    """
    least = min(header, whole)
    known = constant(cues(least))

    def cue(text: Column) -> Column:
        return F.arrays_overlap(F.split(F.lower(text), _TERM), known)

    cued = files.where(cue(F.col("text"))).select("path", F.xxhash64("text").alias("text_hash"), "text")
    parts = cued.select("path", "text_hash", F.explode(F.transform(units(F.col("text")), lambda u: F.struct(u["kind"].alias("unit_kind"), u["text"].alias("unit")))).alias("u")).select("path", "text_hash", "u.*")
    found = table(parts.where(F.when(cue(F.col("unit")), reachable(F.col("unit"), least)).otherwise(False)).withColumn("unit_hash", F.xxhash64("unit")).dropDuplicates(["path", "text_hash", "unit_kind", "unit_hash"]))
    scored = similar(found, ["path", "text_hash", "unit_kind", "unit_hash"], "unit")
    # a licence file is one as a whole, or its first block is the opening of a long licence
    is_file = ((F.col("unit_kind") == "whole") & (F.col("similarity") >= whole)) | ((F.col("unit_kind") == "first") & (F.col("kind") == "opening") & (F.col("similarity") >= header))
    is_part = (F.col("unit_kind") == "part") & (F.col("similarity") >= header)
    both = scored.withColumn("is_file", is_file).where(is_file | is_part)
    best = both.groupBy("path", "text_hash").agg(F.min(F.struct((-F.col("similarity")).alias("low"), (~F.col("is_file")).alias("line"), "license")).alias("best"), F.max("is_file").alias("is_file"))
    return best.select("path", "text_hash", "best.license", (-F.col("best.low")).alias("similarity"), "is_file")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, key: str = "doc_id", header: float = HEADER_SIMILARITY, whole: float = FILE_SIMILARITY) -> DataFrame:
    """(key, path, own_license, own_similarity, inherited_license, inherited_from, license) for each row of files (key, path, text).

    Own: a block, sentence or line whose TF-IDF cosine to a template is high, or a text that as a whole is. A text that as a whole is a licence (or opens like one of the long
    ones) covers its folder, and every folder below without a nearer one; of several in a folder the most similar counts (then the first by name). ``license``: own, else inherited.
    Folders, not files, are joined with their ancestors, so that only distinct folders times depth are shuffled.

    Null or empty text: no own licence, may inherit. Null path: nothing inherited. Repeated rows: rows of their own. Empty table: empty result.
    """
    own = table(own_licenses(files, header, whole))
    licensed = own.where("is_file").groupBy(folder(F.col("path")).alias("at")).agg(F.min(F.struct((-F.col("similarity")).alias("low"), "license")).alias("best")).select("at", F.col("best.license").alias("inherited_license"))
    folders = files.select(folder(F.col("path")).alias("folder")).where("folder is not null").distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))).alias("a")).select("folder", "a.depth", "a.at").distinct()
    nearest = above.join(licensed, "at").groupBy("folder").agg(F.max(F.struct("depth", "inherited_license", "at")).alias("near"))
    nearest = table(nearest.select("folder", "near.inherited_license", F.col("near.at").alias("inherited_from")))
    rows = files.select(key, "path", F.xxhash64("text").alias("text_hash"), folder(F.col("path")).alias("folder"))
    own = own.select(F.col("path").alias("o_path"), F.col("text_hash").alias("o_hash"), F.col("license").alias("own_license"), F.col("similarity").alias("own_similarity"))
    rows = rows.join(own, F.expr("path <=> o_path and text_hash = o_hash"), "left").join(nearest, "folder", "left")
    return rows.select(key, "path", "own_license", "own_similarity", "inherited_license", "inherited_from", F.coalesce("own_license", "inherited_license").alias("license"))
