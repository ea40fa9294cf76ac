"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Texts and templates are reduced to words of a-z, 0-9. A template of n words is looked for in
windows of n + stride - 1 words, every `stride` words, so some window holds any passage of its length
whole. A window's MinHash values are bands of one row: a window and a template of similarity J
share none with probability (1 - J) ** BANDS. A text is cut into windows only around anchors:
words of a template chosen so that a passage without any of them lacks more than a fifth of the
template's shingles. A text's words are looked up in the set of all anchors; those found are looked
up in the map of anchors, which tells the sizes of the windows to cut. The plan has the same steps
for any number of templates; their tables are broadcast up to BROADCAST_BYTES and shuffled beyond.
DataFrame functions only; nothing but the few candidates is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_table

BANDS = 24
SHINGLE = 5
#: The templates' bands, shingles and anchors are broadcast where the texts have at most so many bytes (about ten times that in memory).
BROADCAST_BYTES = 4 << 20
# fixed values: public license notices
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-line": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    anchors: list[str]

    @property
    def stride(self) -> int:
        """Windows exceed the template by at most a quarter of its shingles."""
        return max(1, (len(self.words) - SHINGLE + 1) // 4)


def make_template(name: str, text: str) -> Template:
    """Longest words first as anchors, until a text without all of them has lost over a fifth of the shingles."""
    words = re.findall("[a-z0-9]+", text.lower())
    total = len(words) - SHINGLE + 1
    if total < 1:
        raise ValueError(f"{name}: a template has {SHINGLE} words at least")
    anchors: list[str] = []
    lost: set[int] = set()
    for word in sorted(set(words), key=lambda x: (-len(x), x)):
        if 5 * len(lost) > total:
            break
        anchors.append(word)
        lost |= {s for p, x in enumerate(words) if x == word for s in range(max(0, p - SHINGLE + 1), min(p, total - 1) + 1)}
    return Template(name, words, anchors)


def _hashes(words: Column) -> Column:
    """Distinct hashes of the shingles of an array of SHINGLE words or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def _bands(hashes: Column) -> Column:
    def band(k: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))

    return F.array(*map(band, range(BANDS)))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row per document and template found: id_col, license, start_word, n_words, containment.

    containment: share of the template's five-word shingles in the best window (the earliest of
    equals). Null and empty texts and texts under five words give no rows. Rows with equal ids, or
    a null id, are scanned one by one. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = templates if templates is not None else TEMPLATES
    made = [make_template(name, text) for name, text in sorted(texts.items())]
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, license string, start_word int, n_words int, containment double"
    if not made:
        return spark.createDataFrame([], schema)
    small = F.broadcast if sum(map(len, texts.values())) <= BROADCAST_BYTES else (lambda table: table)
    wanted = sorted({a for t in made for a in t.anchors})
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(text_col)), "[^a-z0-9]+", " ")), " ")
    # the row number is not deterministic, so that the filters on words stay above and the texts are split once
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), words.alias("words"))
    rows = rows.filter((F.size("words") >= SHINGLE) & F.exists("words", lambda x: x.isin(wanted)))
    templates_ = small_table(spark, [(t.name, len(t.words), t.words) for t in made], "license string, size int, template array<string>").select("license", "size", _hashes(F.col("template")).alias("wanted"))
    index = templates_.select("license", "size", F.posexplode(_bands(F.col("wanted"))).alias("band", "value"))

    # all windows of `size` words and more that hold an anchor, from word k * stride on; several anchors may lead to one
    sizes = {a: sorted({(len(t.words), t.stride) for t in made if a in t.anchors}) for a in wanted}
    lengths = F.map_from_arrays(F.array(*map(F.lit, wanted)), F.array(*(F.array(*(F.struct(F.lit(n).alias("size"), F.lit(k).alias("stride")) for n, k in sizes[a])) for a in wanted)))

    def starts(at: Column, kind: Column) -> Column:
        low = F.greatest(F.lit(0), F.ceil((at - (kind["size"] + kind["stride"] - 1) + 1) / kind["stride"]).cast("int"))
        ks = F.sequence(low, F.greatest(low, F.floor(at / kind["stride"]).cast("int")))
        return F.transform(ks, lambda k: F.struct(kind["size"].alias("size"), (kind["size"] + kind["stride"] - 1).alias("span"), (k * kind["stride"]).alias("start")))

    found = F.filter(F.transform("words", lambda x, i: F.struct(i.alias("at"), x.alias("anchor"))), lambda h: h["anchor"].isin(wanted))
    places = F.flatten(F.transform(found, lambda h: F.flatten(F.transform(F.element_at(lengths, h["anchor"]), lambda kind: starts(h["at"], kind)))))
    cut = rows.select("uid", "id", "words", F.inline(F.array_distinct(places)))
    windows = cut.select("uid", "id", "size", "start", F.slice("words", F.col("start") + 1, F.col("span")).alias("window")).filter(F.size("window") >= SHINGLE)
    windows = windows.select("uid", "id", "size", "start", F.size("window").alias("n_words"), _hashes(F.col("window")).alias("have"))
    keyed = windows.withColumn("bands", _bands(F.col("have"))).select("uid", "id", "size", "start", "n_words", "have", F.posexplode("bands").alias("band", "value"))
    found = keyed.join(small(index), ["size", "band", "value"]).join(small(templates_.drop("size")), "license")
    share = F.size(F.array_intersect("have", "wanted")) / F.size("wanted")
    best = found.withColumn("containment", share).filter(F.col("containment") >= least).groupBy("uid", "license").agg(
        F.first("id").alias(id_col), F.max(F.struct("containment", (-F.col("start")).alias("minus"), "n_words")).alias("best")
    )
    return best.select(id_col, "license", (-F.col("best.minus")).cast("int").alias("start_word"), F.col("best.n_words").alias("n_words"), F.col("best.containment").alias("containment"))
