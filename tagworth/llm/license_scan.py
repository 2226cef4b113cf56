"""License notices in documents, by MinHash over overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import let
from .common import digest, lower_az

WIDTH = 5

# Public notices of common licenses.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    (
        "MIT-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (
        "LGPL-3.0-header",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-header",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "EPL-2.0-header",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available "
        "at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    ),
    ("WTFPL", "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License"),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\")"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at:"),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("ODbL-1.0", "This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/."),
)


def plain_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of other non-ASCII characters, A-Z lower-cased."""
    parts = F.split(lower_az(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(parts, lambda w: w != "")


def shingle_keys(words: Column) -> Column:
    """A 64-bit key of each run of five words."""

    def pairs(keys: Column, other: Column, step: int) -> Column:
        return let(
            F.struct(keys.alias("a"), other.alias("b")),
            lambda s: let(
                F.greatest(F.size(s["a"]) - step, F.lit(0)),
                lambda n: F.zip_with(F.slice(s["a"], 1, n), F.slice(s["b"], step + 1, n), lambda x, y: F.xxhash64(x, y)),
            ),
        )

    def built(one: Column) -> Column:
        return let(pairs(one, one, 1), lambda two: let(pairs(two, two, 2), lambda four: _last(four, one)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), built)


def _last(four: Column, one: Column) -> Column:
    n = F.greatest(F.size(one) - (WIDTH - 1), F.lit(0))
    return let(n, lambda m: F.zip_with(F.slice(four, 1, m), F.slice(one, WIDTH, m), lambda x, y: F.xxhash64(x, y)))


def signature(keys: Column, passes: int) -> Column:
    """Bin minima of the keys under ``passes`` hash functions: one-permutation MinHash.

    The upper seven bits of a hash choose one of 128 bins, and each bin that is not empty
    gives its smallest hash.  A bin is a band of one row: two sets agree in a bin of their
    union with a probability equal to their similarity.  Sorted hashes have their bins in
    a row, so a minimum is a value whose predecessor lies in another bin.
    """

    def minima(seed: int) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda k: F.xxhash64(k, F.lit(seed))))
        return let(
            ordered,
            lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), 57) != F.shiftright(x, 57))),
        )

    return F.concat(*[minima(seed) for seed in range(passes)])


def miss_probability(template: int, window: int, share: float, passes: int, bins: int = 128) -> float:
    """Chance that a window which holds ``share`` of a template agrees with it in no bin.

    A shared shingle is a common minimum unless its bin holds a smaller one of the union;
    each of the filled bins agrees with the similarity as its probability.
    """
    common = max(1, round(share * template))
    union = window + template - common
    filled = bins * (1 - (1 - 1 / bins) ** union)
    return ((1 - common / union) ** filled) ** passes if union > bins // 8 else ((union - 1) / (2 * bins)) ** (common * passes)


def _size_class(n: Column) -> Column:
    """Smallest k with 2**k >= n."""
    return F.when(n <= 1, 0).otherwise(F.char_length(F.bin(n - 1)))


def template_table(spark: SparkSession, templates=NOTICES) -> DataFrame:
    """``license, keys`` (distinct shingles) and ``k``, the size class, of each template."""
    for name, text in templates:
        if len([w for w in "".join(c if c.isalnum() else " " for c in text).split()]) < WIDTH:
            raise ValueError(f"template {name} has fewer than {WIDTH} words")
    rows = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in templates])
    table = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    keyed = table.select("license", F.array_distinct(shingle_keys(plain_words(F.col("text")))).alias("keys"))
    return keyed.withColumn("k", _size_class(F.size("keys")))


def license_scan(
    docs: DataFrame, *, templates=NOTICES, text: str = "text", doc_id: str = "doc_id", min_share: float = 0.75, passes: int = 3, max_templates: int = 10_000
) -> DataFrame:
    """License notices found in documents.

    The shingles (five words) of a text are cut into windows that overlap by half.  A
    template of n shingles belongs to size class k, the smallest with 2**k >= n, and meets
    windows of 2 * 2**k shingles that start at multiples of 2**k, so a copy always lies
    whole in one window.  Windows get MinHash signatures of ``passes`` times 128 bins, each
    a band; a template is retrieved by any equal band, and matches if the window holds at
    least ``min_share`` of its distinct shingles, counted exactly.  With three passes a
    window that qualifies is missed with a probability below 1e-6 (``miss_probability``).

    Result: one row per document and license found: ``doc_id, license, n_template,
    n_found`` (most template shingles in one window), ``share``, ``first_window`` (index
    of the first shingle of the first matching window) and ``n_windows``.

    A window that holds no shingle of any template of its class has a similarity of zero
    and cannot match, so only windows with such a shingle are signed; that leaves the
    result unchanged.  Texts never leave their task: the templates (at most
    ``max_templates``, a parameter) are broadcast, and only matches are shuffled.

    Null, empty and short texts have no shingles and match nothing.  Rows with the same
    id and text count as one document.  A missing id is kept as such.  An empty table
    gives an empty result; further columns are not read.
    """
    if len(templates) > max_templates:
        raise ValueError(f"more than {max_templates} templates")
    spark = docs.sparkSession
    known = template_table(spark, templates)
    by_class = known.select("k", F.explode("keys").alias("key")).groupBy("k").agg(F.collect_set("key").alias("keys"))
    # one value each, bounded by the templates: their distinct shingles, by size class and in all
    classes = by_class.agg(F.collect_list(F.struct("k", "keys"))).scalar()
    all_keys = by_class.agg(F.array_distinct(F.flatten(F.collect_list("keys")))).scalar()
    t1, t2 = digest(F.coalesce(text, F.lit("")))
    shingles = docs.select(F.col(doc_id).alias("doc_id"), t1.alias("t1"), t2.alias("t2"), shingle_keys(plain_words(F.col(text))).alias("keys"))
    held = shingles.where(F.arrays_overlap("keys", all_keys)).select("doc_id", "t1", "t2", "keys", F.explode(classes).alias("c"))
    # bound once: inlined into the lambda, the intersection would be computed for every shingle
    hits = let(
        F.array_intersect("keys", "c.keys"),
        lambda own: F.transform(
            F.filter(F.transform("keys", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: F.array_contains(own, e["x"])), lambda e: e["i"]
        ),
    )
    positions = held.withColumn("hits", hits).where(F.size("hits") > 0)
    stride = F.pow(F.lit(2.0), F.col("c.k")).cast("int")
    cells = F.array_distinct(F.transform("hits", lambda i: F.floor(i / F.col("stride")).cast("int")))
    starts = F.array_distinct(F.flatten(F.transform(cells, lambda w: F.filter(F.array(w - 1, w), lambda x: x >= 0))))
    windows = (
        positions.withColumn("stride", stride)
        .select("doc_id", "t1", "t2", "keys", F.col("c.k").alias("k"), "stride", F.explode(starts).alias("w"))
        .select(
            "doc_id", "t1", "t2", "k", (F.col("w") * F.col("stride")).alias("start"),
            F.array_distinct(F.slice("keys", F.col("w") * F.col("stride") + 1, F.col("stride") * 2)).alias("window"),
        )
    )
    signed = windows.select("*", F.explode(signature(F.col("window"), passes)).alias("low"))
    template_bands = F.broadcast(
        known.select("license", "k", F.col("keys").alias("template"), F.explode(signature(F.col("keys"), passes)).alias("low"))
    )
    found = signed.join(template_bands, ["k", "low"]).select(
        "doc_id", "t1", "t2", "license", "start",
        F.size("template").alias("n_template"), F.size(F.array_intersect("window", "template")).alias("n_found"),
    )
    matches = found.where(F.col("n_found") >= F.lit(min_share) * F.col("n_template"))
    return (
        matches.groupBy("doc_id", "t1", "t2", "license")
        .agg(
            F.max("n_template").cast("long").alias("n_template"),
            F.max("n_found").cast("long").alias("n_found"),
            F.min("start").cast("long").alias("first_window"),
            F.count_distinct("start").alias("n_windows"),
        )
        .select("doc_id", "license", "n_template", "n_found", (F.col("n_found") / F.col("n_template")).alias("share"), "first_window", "n_windows")
    )
