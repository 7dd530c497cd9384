"""Licence scans: TF-IDF cosines of lines, runs, blocks and whole texts to templates, and inheritance, with DataFrame operations only."""

from __future__ import annotations

from importlib.resources import files as package_files

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopclock.llm.shared import checkpointed, id_back, id_of

# Short notices of common licences by their SPDX names.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
]
# Titles, opening lines and further short notices, which runs of lines are compared with besides ``TEMPLATES``.
NOTICES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "ISC License"), ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", "SPDX-License-Identifier: MIT"), ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
_FREE = """{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} License as published by the Free
    Software Foundation, either version {2} of the License, or (at your option) any later version. {0} is distributed in the hope that it
    will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
    GNU {1} License for more details. You should have received a copy of the GNU {1} License along with this program. If not, see
    <https://www.gnu.org/licenses/>."""
# Standard headers of source files.
HEADERS = [
    ("AGPL-3.0", _FREE.format("This program", "Affero General Public", 3)),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
    You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
    writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
    express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0", _FREE.format("This program", "General Public", 2)),
    ("GPL-3.0", _FREE.format("This program", "General Public", 3)),
    ("LGPL-3.0", _FREE.format("This library", "Lesser General Public", 3)),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
    this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]
#: Words that mark licence lines; every template has one.
MARKS = r"(?i)licen[cs]|copyright|permission|permitted|redistribut|warrant|liab|rights reserved|public domain|creative commons|\b[al]?gpl|\bmpl\b"
#: Lines of the longest run, of a header, and between two marked lines of one block.
RUN_LINES, HEADER_LINES, GAP_LINES = 6, 40, 8
#: Names of files that speak for their folder.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def all_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def full_texts() -> list[tuple[str, str]]:
    """Names and full texts of licences; AGPL-3.0 is put together from GPL-3.0 and the start of its own section 13."""
    folder = package_files("stopclock.llm") / "licence_texts"
    found = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    network = """Remote Network Interaction. Notwithstanding any other provision of this License, if you modify the Program, your modified version
    must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source
    of your version by providing access to the Corresponding Source from a network server at no charge."""
    gpl = found["GPL-3.0"]
    found["AGPL-3.0"] = gpl.replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General").replace("29 June", "19 November") + network
    return sorted(found.items())


def _idf(total: Column, df: Column) -> Column:
    return F.log((1 + total) / (1 + df)) + 1


def _templates(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """``id, name, term, tf`` of template texts."""
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, name string, body string")
    return checkpointed(table.select("id", "name", F.explode(all_terms(F.col("body"))).alias("term")).groupBy("id", "name", "term").agg(F.count(F.lit(1)).alias("tf")))


def _model(templates: DataFrame, weights: DataFrame) -> DataFrame:
    """Unit vectors of templates with ``id, name, term, tf``."""
    weighed = templates.join(weights, "term").withColumn("w", F.col("idf") * (1 + F.log("tf")))
    normed = weighed.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))
    return checkpointed(normed.select(F.col("id").alias("tid"), "name", F.col("term").alias("tterm"), (F.col("w") / F.col("norm")).alias("unit")))


def _best(units: DataFrame, weights: DataFrame, other: Column, model: DataFrame, least: float) -> DataFrame:
    """``bline, name, score``: the best template of every unit with ``line, term, tf`` that reaches ``least``."""
    scored = units.join(weights, "term", "left").select("line", "term", (F.coalesce("idf", other) * (1 + F.log("tf"))).alias("w"))
    norms = scored.groupBy(F.col("line").alias("nline")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    cosine = (
        scored.join(model, F.col("term") == F.col("tterm")).groupBy("line", "tid", "name").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
        .join(norms, F.col("line") == F.col("nline"))
        .select("line", "name", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
        .where(F.col("score") >= least)
    )
    best = cosine.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("minus"), "name")).alias("b"))
    return checkpointed(best.select(F.col("line").alias("bline"), F.col("b.name").alias("name"), (-F.col("b.minus")).alias("score")))


def _wider(marked: DataFrame, weights: DataFrame, other: Column, blocks: DataFrame, notices: DataFrame, least: float) -> DataFrame:
    """``wh, rank, name, score`` of marked texts by hash ``h``: rank 0 by whole texts, headers and blocks, rank 1 by runs of lines."""
    texts = marked.select("h", "text").dropDuplicates(["h"]).select("h", F.split("text", "\n").alias("lines"))
    at = F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(MARKS), i).otherwise(-1)), lambda i: i >= 0)
    texts = checkpointed(texts.withColumn("at", at))

    starts = F.filter("at", lambda p, i: (i == 0) | (p - F.get("at", i - 1) > GAP_LINES))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) - p > GAP_LINES))
    islands = F.zip_with(starts, ends, lambda a, z: F.array_join(F.slice("lines", a + 1, z - a + 2), "\n"))
    whole = F.array(F.array_join("lines", "\n"), F.array_join(F.slice("lines", 1, HEADER_LINES), "\n"))
    units = texts.select("h", F.explode(F.array_distinct(F.concat(whole, islands))).alias("body")).withColumn("line", F.sha2("body", 256))
    counted = units.dropDuplicates(["line"]).select("line", F.explode(all_terms(F.col("body"))).alias("term")).groupBy("line", "term").agg(F.count(F.lit(1)).alias("tf"))
    of_block = _best(counted, weights, other, _model(blocks, weights), least)
    by_block = checkpointed(units.select("h", "line").join(of_block, F.col("line") == F.col("bline")).select("h", F.lit(0).alias("rank"), "name", "score"))

    known = F.array(*[F.lit(r["term"]) for r in notices.select("term").distinct().collect()])
    spans = F.flatten(F.transform("at", lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(RUN_LINES)), lambda k: F.transform(
        F.sequence(F.lit(0), k - 1), lambda back: F.struct((p - back).alias("a"), k.alias("k")))))))
    inside = F.filter(F.array_distinct(spans), lambda x: (x["a"] >= 0) & (x["a"] + x["k"] <= F.size("lines")))
    rest = texts.join(by_block.select(F.col("h").alias("gone")).distinct(), F.col("h") == F.col("gone"), "left_anti")
    runs = rest.select("h", "lines", F.explode(inside).alias("x")).select("h", terms(F.array_join(F.slice("lines", F.col("x.a") + 1, F.col("x.k")), " ")).alias("terms"))
    runs = runs.where((F.size("terms") > 0) & (F.size(F.array_intersect("terms", known)) >= F.size("terms") * F.lit(least * least - 1e-9)))
    runs = runs.withColumn("line", F.sha2(F.array_join("terms", " "), 256))
    vectors = runs.select("line", "terms").dropDuplicates(["line"]).select("line", F.explode("terms").alias("term"), F.lit(1).alias("tf"))
    vocabulary = notices.select("term").distinct()
    model = _model(notices.withColumn("tf", F.lit(1)), weights)
    of_run = _best(vectors, weights.join(vocabulary, "term", "left_semi"), other, model, least)
    by_run = runs.select("h", "line").distinct().join(of_run, F.col("line") == F.col("bline")).select("h", F.lit(1).alias("rank"), "name", "score")
    return checkpointed(by_block.union(by_run).select(F.col("h").alias("wh"), "rank", "name", "score").distinct())


def scan_licences(docs: DataFrame, path: Column, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, path, licence, score, how`` for every row.

    Every line of every text is compared with the templates: a term counts once in a line, weighted by its inverse
    document frequency over all texts; terms of no template weigh as much as a term no text has. A line's licence
    is the template of the highest cosine, if that is ``least`` or more, and a text's licence that of its best line (``how`` =
    ``header``; ties go to the first name). Other texts take the licence found in the licence files of the
    nearest folder upwards (``inherited``), or none.

    Texts with a line of licence words (``MARKS``) are also compared as a whole, by their first lines, and by blocks of marked
    lines, with full licence texts and standard headers: terms count by ``1 + ln(frequency)``. A match there goes before lines
    (``how`` = ``text``). Runs of up to ``RUN_LINES`` lines around a marked line are compared like lines with titles and short
    notices too, so wrapped notices are found; a bare reservation of rights gives way to a licence.

    Of a line's squared norm at least its share of unknown terms lies outside all templates, which bounds the cosine
    by ``sqrt(known / all)``; only lines within the bound are taken apart into terms. Folders join by path, one row per
    folder above a text.

    Null texts are empty; a null path has no folders, a path without ``/`` lies in the top folder. Repeated
    rows are treated alike; every line of a text counts, however long it is; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(id_of(id_col).alias("d"), path.cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text"))
    templates = spark.createDataFrame(list(enumerate(TEMPLATES)), "id int, x struct<name string, body string>").select("id", "x.name", F.explode(terms(F.col("x.body"))).alias("term"))
    vocabulary = sorted({t["term"] for t in templates.select("term").distinct().collect()})
    known = F.array(*[F.lit(t) for t in vocabulary])

    blocks, notices = _templates(spark, full_texts() + HEADERS), _templates(spark, TEMPLATES + NOTICES)
    everything = sorted({t["term"] for t in blocks.union(notices).select("term").distinct().collect()} | set(vocabulary))

    total = rows.count()
    frequency = rows.select(F.explode(F.array_intersect(terms(F.col("text")), F.array(*[F.lit(t) for t in everything]))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = checkpointed(
        spark.createDataFrame([(t,) for t in everything], "term string").join(F.broadcast(frequency), "term", "left")
        .select("term", _idf(F.lit(total), F.coalesce("df", F.lit(0))).alias("idf"))
    )
    other = _idf(F.lit(total), F.lit(0))
    model = _model(templates.withColumn("tf", F.lit(1)), weights)

    lines = rows.select("d", "t", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).withColumn("terms", terms(F.col("line")))
    near = F.size(F.array_intersect("terms", known)) >= F.size("terms") * F.lit(least * least - 1e-9)
    candidates = lines.where((F.size("terms") > 0) & near).select("terms").distinct()
    best = _best(
        candidates.select(F.sha2(F.array_join("terms", " "), 256).alias("line"), F.explode("terms").alias("term"), F.lit(1).alias("tf")),
        weights.where(F.col("term").isin(vocabulary)), other, model, least,
    )

    # The few lines that match are found again by their terms.
    own = (
        lines.where((F.size("terms") > 0) & near)
        .withColumn("line", F.sha2(F.array_join("terms", " "), 256))
        .join(best, F.col("line") == F.col("bline"))
        .select("d", "t", F.lit(1).alias("rank"), "name", "score")
    )
    marked = rows.where(F.col("text").rlike(MARKS)).select("d", "t", "text", F.sha2("text", 256).alias("h"))
    wide = _wider(marked, weights, other, blocks, notices, least)
    own = (
        own.union(marked.select("d", "t", "h").join(wide, F.col("h") == F.col("wh")).select("d", "t", "rank", "name", "score"))
        .groupBy(F.col("d").alias("od"), F.col("t").alias("ot"))
        .agg(F.min(F.struct("rank", (F.col("name") == "Proprietary").alias("bare"), (-F.col("score")).alias("minus"), "name")).alias("b"))
        .select("od", "ot", F.col("b.name").alias("own"), (-F.col("b.minus")).alias("own_score"), F.when(F.col("b.rank") == 0, "text").otherwise("header").alias("own_how"))
    )
    files = rows.select("d", "t", "path").join(checkpointed(own), (F.col("d") == F.col("od")) & (F.col("t") == F.col("ot")), "left").select("d", "path", "own", "own_score", "own_how")
    parts = F.split("path", "/")
    folder = lambda depth: F.array_join(F.slice(parts, 1, depth), "/")
    files = checkpointed(files.withColumn("depth", F.size(parts) - 1))
    speaking = files.where(F.col("own").isNotNull() & F.element_at(parts, -1).rlike(LICENCE_FILE))
    of_folder = speaking.groupBy(folder(F.col("depth")).alias("folder"), F.col("depth").alias("fdepth")).agg(F.min(F.struct((-F.col("own_score")).alias("minus"), "own")).alias("b"))
    of_folder = checkpointed(of_folder.select("folder", "fdepth", F.col("b.own").alias("licence"), (-F.col("b.minus")).alias("score")))
    bare = files.where(F.col("own").isNull())
    asked = bare.select(F.col("path"), "depth").distinct().where(F.col("path").isNotNull()).withColumn("up", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    nearest = (
        asked.withColumn("above", folder(F.col("up")))
        .join(of_folder, (F.col("above") == F.col("folder")) & (F.col("up") == F.col("fdepth")))
        .groupBy(F.col("path").alias("npath"))
        .agg(F.max(F.struct("up", "licence", "score")).alias("n"))
    )
    inherited = bare.join(nearest, F.col("path") == F.col("npath"), "left").select(
        "d", "path", F.col("n.licence").alias("licence"), F.col("n.score").alias("score"), F.when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("how")
    )
    direct = files.where(F.col("own").isNotNull()).select("d", "path", F.col("own").alias("licence"), F.col("own_score").alias("score"), F.col("own_how").alias("how"))
    return direct.union(inherited).select(id_back(F.col("d")).alias("doc_id"), "path", "licence", "score", "how")


def document_path() -> Column:
    """A place for each document of the test tables: folders of a source, its thousands and its hundreds, and every tenth document a licence file on one of the three levels."""
    level = F.when(F.col("doc_id") % 10 == 0, F.floor(F.col("doc_id") / 10) % 3)
    source, thousand, hundred = F.col("source"), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string")
    return (
        F.when(level.isNull(), F.concat_ws("/", source, thousand, hundred, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
        .when(level == 0, F.concat_ws("/", source, thousand, hundred, F.lit("LICENSE")))
        .when(level == 1, F.concat_ws("/", source, thousand, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", source, F.lit("LICENSE")))
    )
