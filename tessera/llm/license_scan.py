"""License scans by a trained paragraph classifier, in DataFrame functions alone.

A unit is a line that holds a hint word, and a paragraph: a run of such lines with at most GAP other lines between
two of them and no blank one, so that a notice wrapped over several lines is one text. Each is scored by a sparse
multinomial logistic regression over its distinct word 1- to 3-grams. The classes are licence families and
"unknown"; a temperature and the bias of "unknown", calibrated on material apart from the training texts, turn
logits into probabilities, and a unit without a known gram has the bias alone, which is unknown. What the
classifier names (a line: its best class; a paragraph: each family above "unknown") is confirmed by template
comparison: the share of the grams of the family's best template that the unit contains; templates of at most
SHORT grams, like "MIT License", must stand there whole. The operands of a licence expression ("MIT OR Apache-2.0", or
what follows "SPDX-License-Identifier:") are units of their own, without their versions, so each of them is named.

Training is small and local to the driver: the templates below, cut and mixed with filler in fixed ways. Hint words
are those without which less than the confirming share of any template is left, so the filter misses nothing that
can be confirmed on a line. Grams are made once and meet one fixed table of weights and templates.

Results for odd input: null text is empty; documents without a licence paragraph give one row with an empty
list; very long texts and paragraphs are read whole; of families that tie on a line the first in the order of TEMPLATES is
named; repeated doc_ids with different texts are rows of their own, equal rows are one; an empty table gives
none. Only id and text are read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import texts

# Phrases by which licences name themselves.
TEMPLATES = {
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
            "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "MIT License"),
    "apache-2.0": ("Apache License", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
            "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
            "licensed under the GNU Lesser General Public License", "GNU Affero General Public License version 3",
            "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License", "GNU Library General Public License"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
            "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "BSD 2-Clause License", "BSD License"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
            "notice appear in all copies.", "SPDX-License-Identifier: ISC", "ISC License"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("CC0 1.0 Universal Public Domain Dedication", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                  "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
             "zlib License"),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License",
              "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution", "Eclipse Public License"),
    "cddl": ("The contents of this file are subject to the terms of the Common Development and Distribution License", "Common Development and Distribution License"),
    "eupl": ("Licensed under the EUPL, Version 1.2 or later", "European Union Public Licence"),
    "artistic": ("Artistic License 2.0", "The Artistic License"),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SIL Open Font License"),
    "psf": ("Python Software Foundation License", "PSF License Agreement"),
    "ms-pl": ("Microsoft Public License",),
    "postgresql": ("PostgreSQL License",),
    "ncsa": ("University of Illinois/NCSA Open Source License",),
    "0bsd": ("BSD Zero Clause License",),
    "wtfpl": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "gfdl": ("GNU Free Documentation License", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    "odbl": ("Open Database License", "This database is made available under the Open Database License"),
    "upl": ("The Universal Permissive License",),
    "cecill": ("This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software.", "CeCILL License"),
    "mulan": ("Mulan Permissive Software License",),
    "busl": ("Business Source License",),
    "sspl": ("Server Side Public License",),
    "elastic": ("Elastic License 2.0",),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "proprietary": ("All rights reserved.", "Copyright (c) 2020 Example Corp. All rights reserved.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
}
# Standard identifiers of the families, without their versions.
IDENTIFIERS = {
    "mit": ("MIT", "MIT-0"), "apache-2.0": ("Apache",), "gpl": ("GPL", "LGPL", "AGPL"), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "isc": ("ISC",), "mpl-2.0": ("MPL",), "cc-by": ("CC-BY",), "cc-by-sa": ("CC-BY-SA",),
    "cc-by-nc": ("CC-BY-NC",), "cc0": ("CC0",), "unlicense": ("Unlicense",), "zlib": ("Zlib",), "boost": ("BSL",), "epl": ("EPL",), "cddl": ("CDDL",), "eupl": ("EUPL",), "artistic": ("Artistic",), "ofl": ("OFL",),
    "psf": ("PSF", "Python"), "ms-pl": ("MS-PL",), "postgresql": ("PostgreSQL",), "ncsa": ("NCSA",), "0bsd": ("0BSD",), "wtfpl": ("WTFPL",), "gfdl": ("GFDL",), "odbl": ("ODbL",), "upl": ("UPL",), "cecill": ("CECILL",),
    "mulan": ("MulanPSL",), "busl": ("BUSL",), "sspl": ("SSPL",), "elastic": ("Elastic",), "cc-by-nd": ("CC-BY-ND",), "cc-by-nc-sa": ("CC-BY-NC-SA",), "cc-by-nc-nd": ("CC-BY-NC-ND",),
}
# Sentences with words of licences that aren't one.
NOT_LICENCES = ("she has a driving license and a fishing license", "he was granted a licence to practise medicine", "the terms and conditions of the contract are met",
                "all rights and duties of the citizens", "free software is a matter of liberty", "the general public was not admitted to the work", "permission to enter was not granted",
                "version 3 of the public file", "use in source and binary forms", "the apache helicopter", "he studied at mit in cambridge", "gnu and lion", "subject to the terms of the lease",
                "the author of this work", "creative people in common rooms", "the tables were reserved for the guests", "we met by the university library",
                "an eclipse of the sun in public view", "the boost in software sales", "the server side of the counter", "an elastic band and a zip", "the open database of birds", "a business source close to the board",
                "the european union and the public", "development and distribution of the product", "the artistic director of the house", "a python in the zoo", "her license expired in may", "the license of the pub",
                "the office of software licenses", "fonts and database tables")
# Notices and sentences in other words than the templates, for calibration alone.
HELD_OUT = {
    "mit": ("This project is made available under the terms of the MIT license, see LICENSE.", "MIT licensed, see the file COPYING for the full text", "Code in this folder: MIT License (c) the contributors"),
    "apache-2.0": ("Distributed under the Apache License 2.0", "The library is Apache License, Version 2.0 licensed software", "see the Apache License, Version 2.0 for details"),
    "gpl": ("It may be copied under the GNU General Public License version 2 or later", "Released under GNU GPL, the GNU General Public License", "This library is covered by the GNU Lesser General Public License"),
    "bsd": ("This module has a BSD 3-Clause License", "Use in source and binary forms, with or without modification, is permitted under the BSD License"),
    "isc": ("Permission to use, copy and distribute this software for any purpose with or without fee is granted",), "mpl-2.0": ("Files here are under the Mozilla Public License, v. 2.0",),
    "cc-by": ("Text is available under the Creative Commons Attribution 4.0 International License", "Content: CC BY 4.0."), "cc-by-sa": ("Text is available under the Creative Commons Attribution-ShareAlike 4.0 licence",),
    "cc-by-nc": ("Figures are licensed CC BY-NC 4.0 only",), "cc0": ("Dedicated to the public domain, CC0 1.0 Universal",), "unlicense": ("free and unencumbered software, released into the public domain",),
    "zlib": ("The code is under the zlib license, see zlib.h",), "boost": ("Use of this header is subject to the Boost Software License 1.0",), "epl": ("Contributed under the Eclipse Public License 1.0",),
    "artistic": ("You may use it under the Artistic License",), "ofl": ("The fonts come under the SIL Open Font License",), "psf": ("Taken from Python under the PSF License Agreement",), "busl": ("Business Source License 1.1",),
    "gfdl": ("The manual has the GNU Free Documentation License, version 1.3",), "cc-by-nc-sa": ("Slides: licensed under CC BY-NC-SA 4.0",),
    "proprietary": ("Copyright 2019 the publisher, all rights reserved", "Proprietary and confidential, do not copy"),
    "unknown": ("the council granted the company a license to operate the ferry", "all conditions for the use of the hall are listed below", "his rights were reserved for a later hearing",
                "she holds permission to use the library at any time", "the public works department published its general report", "a copy of the letter was distributed to the members",
                "the software ran for the following ten days", "the modification of the road was not permitted", "free entry is granted to any person under ten", "the foundation was laid in spring",
                "version 2.0 of the engine was released in may", "the source of the river is subject to dispute", "international trade in binary goods", "notices of the court appear in all papers"),
}
UNKNOWN = "unknown"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
GRAMS = 3
#: Lines without a hint word that may stand between two lines of a paragraph.
GAP = 2
#: A prediction is confirmed if this share of a template's grams stands in the paragraph; all of them in templates of at most SHORT.
CONFIRM, SHORT = 0.6, 3
VERSION = r"(?:-v?\d+(?:\.\d+)*)?(?:-only|-or-later|-Universal)?\+?"
TAG = "SPDX-License-Identifier: "


def _phrases() -> dict[str, tuple[str, ...]]:
    """The templates of each family with those of its identifiers."""
    return {c: tuple(dict.fromkeys((*ps, *(TAG + i for i in IDENTIFIERS.get(c, ()))))) for c, ps in TEMPLATES.items()}


def known_identifier() -> str:
    """A pattern of one standard identifier with its version; group 1 is without."""
    names = sorted((re.escape(i) for ids in IDENTIFIERS.values() for i in ids), key=lambda x: (-len(x), x))
    return rf"(?<![\w.+-])({'|'.join(names)}){VERSION}(?![\w+-]|\.\w)"


def expression_pattern() -> str:
    """Two known identifiers at least, joined by OR or AND, for texts as they are."""
    one = rf"\(*{known_identifier()}(?: WITH [\w.-]+)?\)*"
    return rf"{one}(?:\s+(?:OR|AND)\s+{one})+"


def _grams(text: str) -> set[str]:
    w = re.findall(WORD, text.lower())
    return {" ".join(w[i:i + n]) for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1)}


@lru_cache(maxsize=1)
def model(steps: int = 300, rate: float = 0.5, l2: float = 1e-3) -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    """Weights by class and gram, biases by class, and the temperature; the same on every call.

    The bias of "unknown" and the temperature are those that suit HELD_OUT best.
    """
    filler = [f"zz{k}q" for k in range(40)]
    rows: list[tuple[set[str], str]] = []
    for family, phrases in _phrases().items():
        for k, p in enumerate(phrases):
            words = p.split()
            versions = [p, " ".join(filler[k:k + 6] + words), " ".join(words + filler[k + 3:k + 11])]
            if len(words) > 8:
                versions += [" ".join(words[: int(len(words) * 0.7)]), " ".join(words[int(len(words) * 0.3):])]
            rows += [(_grams(v), family) for v in versions]
    rows += [(_grams(p), UNKNOWN) for p in NOT_LICENCES for _ in range(2)]
    for family, phrases in TEMPLATES.items():  # single words of a licence say little
        rows += [({w}, UNKNOWN) for p in phrases[:2] for w in p.lower().replace(".", "").replace(",", "").split()]
    rows += [({f}, UNKNOWN) for f in filler]
    classes = [*TEMPLATES, UNKNOWN]
    vocab = {g: k for k, g in enumerate(sorted({g for x, _ in rows for g in x if not g.startswith("zz") and " zz" not in g}))}
    x = np.zeros((len(rows), len(vocab)))
    for i, (grams, _) in enumerate(rows):
        x[i, [vocab[g] for g in grams if g in vocab]] = 1.0
    scale = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1.0))
    x /= scale
    y = np.array([classes.index(c) for _, c in rows])
    w, b = np.zeros((len(vocab), len(classes))), np.zeros(len(classes))
    b[-1] = 2.0
    one = np.eye(len(classes))[y]
    gw, gb = np.full(w.shape, 1e-8), np.full(b.shape, 1e-8)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p - one
        dw, db = x.T @ d + l2 * w, d.sum(0)
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        b -= rate * db / np.sqrt(gb)

    held = [(_grams(t), c) for c, ts in HELD_OUT.items() for t in ts]
    hx = np.zeros((len(held), len(vocab)))
    for i, (grams, _) in enumerate(held):
        hx[i, [vocab[g] for g in grams if g in vocab]] = 1.0
    hx /= np.sqrt(np.maximum(hx.sum(1, keepdims=True), 1.0))
    hy = np.array([classes.index(c) for _, c in held])

    def loss(move: float, t: float) -> float:
        z = hx @ w + b
        z[:, -1] += move
        z /= t
        return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(hy)), hy]).mean())

    move, temperature = min(((m / 10, 0.1 * 1.1 ** k) for m in range(-30, 31) for k in range(50)), key=lambda at: loss(*at))
    b[-1] += move
    weights = {c: {g: float(w[k, j]) for g, k in vocab.items() if abs(w[k, j]) > 1e-3} for j, c in enumerate(classes)}
    return weights, dict(zip(classes, map(float, b), strict=True)), float(temperature)


def _tables(spark: SparkSession) -> tuple[DataFrame, list[str], list[tuple[str, int]], dict[str, float], float]:
    """gram, w (a weight for each class, then a 1 for each template that holds it): as long as the fixed templates; classes; template families and sizes."""
    weights, bias, temperature = model()
    classes = list(bias)
    templates = [(c, _grams(p)) for c, ps in _phrases().items() for p in ps]
    grams = sorted({g for c in weights.values() for g in c} | {g for _, gs in templates for g in gs})
    rows = [{"gram": g, "w": [weights[c].get(g, 0.0) for c in classes] + [float(g in gs) for _, gs in templates]} for g in grams]
    return _literal(spark, rows, "gram:string,w:array<double>"), classes, [(c, len(gs)) for c, gs in templates], bias, temperature


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table, as an expression."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


@lru_cache(maxsize=8)
def hint_pattern(confirm: float = CONFIRM) -> str:
    """A pattern, for lower-case text, of word starts of which every paragraph that can be confirmed holds one: without them less than confirm of any template is left.

    For each template, the shortest first, the words of most of its grams until that holds. Lines without one are unknown at once.
    """
    def holds(gram: str, word: str) -> bool:
        return re.search(f"(?<![a-z0-9]){re.escape(word)}", gram) is not None

    words: set[str] = set()
    for grams in sorted((_grams(p) for phrases in _phrases().values() for p in phrases), key=lambda g: (len(g), min(g))):
        left = {g for g in grams if not any(holds(g, w) for w in words)}
        order = [g for g in grams if " " not in g]
        while len(left) >= confirm * len(grams):  # long words first, then those in most grams
            word = min((w for w in order if any(holds(g, w) for g in left)), key=lambda w: (-min(len(w), 6), -sum(holds(g, w) for g in left), w))
            words.add(word)
            left = {g for g in left if not holds(g, word)}
    words = {w for w in words if not any(x != w and w.startswith(x) for x in words)}
    by_first: dict[str, list[str]] = {}
    for w in sorted(words):
        by_first.setdefault(w[0], []).append(re.escape(w[1:]))
    return "(?<![a-z0-9])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"


def _runs(n: int) -> F.Column:
    """All runs of n tokens of the column tok."""
    made = F.transform(F.sequence(F.lit(1), F.size("tok") - (n - 1)), lambda i: F.array_join(F.slice("tok", i, n), " "))
    return F.when(F.size("tok") >= n, made).otherwise(F.array().cast("array<string>"))


def units(body: DataFrame, hint: str, gap: int = GAP) -> DataFrame:
    """rid (a number for the row), doc_id, th (hash of the text), line, last_line, part, p: the lines with a hint word or an expression, paragraphs of more than one line (part 0), and the operands of a line's expressions (part 1 and on)."""
    joined = expression_pattern()
    told = lambda x: F.lower(x).rlike(hint) | x.rlike(joined)
    held = body.where(told(F.col("text"))).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("l"))
    hits = held.withColumn("hits", F.filter(F.transform("l", lambda x, i: F.when(told(x), i)), lambda i: i.isNotNull()))

    def new(k: F.Column) -> F.Column:
        before, now = F.get("hits", k - 1), F.get("hits", k)
        blank = F.exists(F.slice(F.col("l"), before + 2, F.greatest(now - before - 1, F.lit(0))), lambda x: F.trim(x) == "")
        return F.when(k == 0, True).when(now - before > gap + 1, True).otherwise(blank)

    spans = F.arrays_zip(F.filter("hits", lambda h, k: new(k)).alias("s"), F.filter("hits", lambda h, k: F.when(k == F.size("hits") - 1, True).otherwise(new(k + 1))).alias("e"))
    made = F.concat(F.transform("hits", lambda h: F.struct(h.alias("s"), h.alias("e"))), F.filter(spans, lambda x: x["e"] > x["s"]))
    whole = hits.withColumn("u", F.explode(made)).select(
        "rid", "doc_id", "th", F.col("u.s").alias("line"), F.col("u.e").alias("last_line"), F.array_join(F.slice("l", F.col("u.s") + 1, F.col("u.e") - F.col("u.s") + 1), " ").alias("p"))
    # operands of "A OR B" and of what follows the tag, on a line
    after = F.regexp_extract_all("p", F.lit(rf"(?i:SPDX-License-Identifier:?)\s*(\(*[\w.+-]+\)*(?:\s+(?i:OR|AND|WITH)\s+\(*[\w.+-]+\)*)*)"), 1)
    bare = F.regexp_extract_all("p", F.lit(f"({joined})"), 1)
    operands = F.regexp_extract_all(F.array_join(F.concat(after, bare), " ; "), F.lit(known_identifier()), 1)
    own = F.when(F.col("line") == F.col("last_line"), F.transform(F.array_distinct(operands), lambda x: F.concat(F.lit(TAG), x))).otherwise(F.array().cast("array<string>"))
    return whole.select("rid", "doc_id", "th", "line", "last_line", F.posexplode(F.concat(F.array("p"), own)).alias("part", "p"))


def scan(docs: DataFrame, confirm: float = CONFIRM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, families (sorted, distinct), n_paragraphs (confirmed), paragraphs: array of (line, last_line, family, probability, overlap).

    A paragraph isn't told again with a family that one of its lines has.
    """
    spark = docs.sparkSession
    body = texts(docs, id_col, text_col)
    table, classes, templates, bias, temperature = _tables(spark)
    tokens = F.regexp_extract_all(F.lower("p"), F.lit(f"({WORD})"), 1)
    key = ["rid", "doc_id", "th", "line", "last_line", "part"]
    grams = units(body, hint_pattern(confirm)).select(*key, tokens.alias("tok")).select(*key, F.explode(F.array_distinct(F.concat(*[_runs(n) for n in range(1, GRAMS + 1)]))).alias("gram"))
    n = len(classes)
    sums = grams.join(F.broadcast(table), "gram").groupBy(*key).agg(F.sum(F.when(F.exists(F.slice("w", 1, n), lambda x: x != 0), 1).otherwise(0)).alias("known"),
                                                                     *[F.sum(F.col("w")[j]).alias(f"z{j}") for j in range(n + len(templates))])
    root = F.sqrt(F.greatest(F.col("known"), F.lit(1)).cast("double"))
    z = [(F.col(f"z{j}") / root + F.lit(bias[c])) / F.lit(temperature) for j, c in enumerate(classes)]
    share = {c: F.greatest(F.lit(0.0), *[F.when(F.col(f"z{n + k}") >= (size if size <= SHORT else 0), F.col(f"z{n + k}") / size).otherwise(0.0) for k, (f, size) in enumerate(templates) if f == c]) for c in classes if c != UNKNOWN}
    scored = sums.select(*key, F.array(*z).alias("z"), F.array(*share.values()).alias("share"))
    top = F.array_max("z")
    whole = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - top))
    named = F.transform(F.array(*map(F.lit, share)), lambda c, i: F.struct(
        "line", "last_line", c.alias("family"), F.round(F.exp(F.get("z", i) - top) / whole, 6).alias("probability"), F.round(F.get("share", i), 6).alias("overlap"),
        (F.get("share", i) >= confirm).alias("sure"), F.when(F.col("line") == F.col("last_line"), i == F.array_position("z", top).cast("int") - 1).otherwise(F.get("z", i) > F.get("z", F.lit(n - 1))).alias("told")))
    found = scored.select("rid", "doc_id", "th", F.explode(F.filter(named, lambda x: x["sure"] & x["told"])).alias("x"))
    every = found.groupBy("rid", "doc_id", "th").agg(F.array_sort(F.collect_list(F.col("x").dropFields("sure", "told"))).alias("every"))
    # a family that a line and its operands name is told once, with the best figures: the last of neighbours
    following = lambda i, k: F.get("every", i + 1).getField(k)
    once = F.filter("every", lambda x, i: ~F.coalesce((following(i, "line") == x["line"]) & (following(i, "last_line") == x["last_line"]) & (following(i, "family") == x["family"]), F.lit(False)))
    per_row = every.withColumn("every", once)
    per_doc = per_row.groupBy("doc_id", "th").agg(F.max("every").alias("every"))  # equal rows have equal lists
    # Of a family on lines and in the paragraph around them, the lines are told.
    lines = F.filter("every", lambda y: y["line"] == y["last_line"])
    mine = per_doc.select("doc_id", "th", F.filter("every", lambda x: (x["line"] == x["last_line"]) | ~F.exists(
        lines, lambda y: (y["family"] == x["family"]) & (y["line"] >= x["line"]) & (y["line"] <= x["last_line"]))).alias("paragraphs"))
    rows = body.select("doc_id", F.xxhash64("text").alias("th")).distinct().join(
        mine.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "paragraphs"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    empty = F.array().cast("array<struct<line:int,last_line:int,family:string,probability:double,overlap:double>>")
    paras = F.coalesce("paragraphs", empty)
    return rows.select("doc_id", F.array_sort(F.array_distinct(F.transform(paras, lambda x: x["family"]))).alias("families"), F.size(paras).alias("n_paragraphs"), paras.alias("paragraphs"))
