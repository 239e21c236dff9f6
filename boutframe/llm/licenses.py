"""License scans: sparse TF-IDF cosine to templates, and inheritance from the nearest licensed directory. DataFrame functions only.

Every line of a text is compared with the templates, and so is every run of as many words as the template has (a *window*,
which may begin or end inside a line or cross lines); a line or window states a license when its cosine with the best
template is ``THRESHOLD`` or more, it has all numbers of the template, and it has no word of ``VARIANTS`` that the template
lacks. Only lines and windows with a *cue* word are compared: the cues are each template's heaviest words, taken until the
rest of its vector is too short to reach the threshold, so what has no cue can't reach it either. In the same way a template is
tried only in texts that have all its numbers and enough of its words: by Cauchy and Schwarz, a line's cosine with it is at most
the length of that part of the template's unit vector whose words the line, and so the text, has. An SPDX tag states the
license expression that it names, whether or not that has a template, with cosine 1. Full license texts are known by their
titles and main sentences; they are not compared as a whole.

"All rights reserved" counts only where nothing else is stated. The redistribution sentence of the BSD licenses is
BSD-2-Clause where the text has the clause on binary forms and not the one on names.

A document is a license *file* when its path's last part says so, or when stated lines, or stated windows, hold
``FILE_SHARE`` of its words; otherwise stated lines are *headers*. A directory has the license of its best file. A document without a statement
*inherits* from the nearest directory at or above its own that has one: directories are made distinct first, each is
joined with its ancestors, and the deepest match counts.

Cases: a null text counts as empty and states nothing; a null path is a file in the root directory; equal cosines go to
the first template in order; of several files in a directory the one of the highest cosine counts, then the last license
name; a null doc_id passes through; repeated rows have a result each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.session import materialize

THRESHOLD = 0.75
FILE_SHARE = 0.2
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
#: Short notices by which works state these licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    *[(f"CC-{x}-{v}", f"Licensed under CC {x} {v}") for v in ("4.0", "3.0") for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0"),
    *[(f"CC-{x}-{v}", f"Creative Commons {name} {v} International License") for v in ("4.0",) for x, name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))],
    *[(x, f"under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License") for x, name, v in (
        ("GPL-3.0", "General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("LGPL-3.0", "Lesser General Public License", "3"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"), ("AGPL-3.0", "Affero General Public License", "3"))],
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("GPL-3.0", "GNU General Public License, Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License, Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License, Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License, Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU Affero General Public License, Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("all-rights-reserved", "Copyright. All rights reserved"),
    ("all-rights-reserved", "All rights reserved"),
]
#: Words by which licenses of one family differ.
VARIANTS = frozenset("lesser library affero sa nc nd sharealike noncommercial noderivatives".split())
RESERVED, BSD = "all-rights-reserved", "Redistribution and use in source and binary forms, with or without modification, are permitted"
BINARY_CLAUSE, NAME_CLAUSE = r"(?i)redistributions\W+in\W+binary\W+form", r"(?i)(neither\W+the\W+names?|names?\W+of\W+(its|the)\W+contributors)"
SPDX = r"(?i:SPDX-License-Identifier):[\x20\t]*(\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*(?:\x20+(?:AND|OR|WITH)\x20+\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*)*)"
#: Function words, which carry a tenth of the weight that their rarity would give them.
FUNCTION_WORDS = frozenset("a all and any are as at by for from in into is it of on or the this to use under with without work".split())


def _split(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def model(templates=TEMPLATES) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Inverse document frequencies over the templates, and each template's unit vector."""
    words = [_split(text) for _, text in templates]
    held = Counter(w for x in words for w in set(x))
    idf = {w: (math.log((1 + len(words)) / (1 + n)) + 1) * (0.1 if w in FUNCTION_WORDS else 1) for w, n in sorted(held.items())}
    idf |= {w: 0.1 * (math.log(1 + len(words)) + 1) for w in sorted(FUNCTION_WORDS - idf.keys())}
    vectors = []
    for x in words:
        vector = {w: n * idf[w] for w, n in Counter(x).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        vectors.append({w: v / norm for w, v in vector.items()})
    return idf, vectors


def cues(vectors: list[dict[str, float]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which a line has at least one if its cosine with some template is ``threshold`` or more."""
    found = set()
    for vector in vectors:
        rest = 1.0
        for word, weight in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold * threshold - 1e-9:
                break
            found.add(word)
            rest -= weight * weight
    return sorted(found)


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def _vectors(words: Column, weights: Column, unseen: float) -> Column:
    """Structs with ``n, words, vector, norm`` of an array of word arrays; built in steps so that nothing is computed twice."""
    counted = F.transform(words, lambda x: F.struct(F.size(x).alias("n"), x.alias("words"), F.transform(F.array_distinct(x), lambda w: F.struct(
        w.alias("word"), (F.size(F.filter(x, lambda y: y == w)) * F.coalesce(F.try_element_at(weights, w), F.lit(unseen))).alias("weight"))).alias("vector")))
    return F.transform(counted, lambda x: F.struct(
        x["n"].alias("n"), x["words"].alias("words"), x["vector"].alias("vector"), F.sqrt(F.aggregate(x["vector"], F.lit(0.0), lambda a, t: a + t["weight"] * t["weight"])).alias("norm")))


def _cosine(x: Column, template: Column) -> Column:
    """Cosine with a template; 0 where numbers of it are missing or words of another variant are there."""
    product = F.aggregate(x["vector"], F.lit(0.0), lambda a, t: a + t["weight"] * F.coalesce(F.try_element_at(template["vector"], t["word"]), F.lit(0.0)))
    fits = (F.size(F.array_except(template["numbers"], x["words"])) == 0) & ~F.arrays_overlap(template["others"], x["words"])
    return F.when(fits, F.coalesce(F.round(product / x["norm"], 9), F.lit(0.0))).otherwise(F.lit(0.0))


def _templates(templates, vectors: list[dict[str, float]]) -> Column:
    """``k, license, size, vector, numbers, others`` of each template, as one constant array."""

    def one(k: int, name: str, text: str, vector: dict[str, float]) -> Column:
        numbers, others = [w for w in vector if w.isdigit()], sorted(VARIANTS - vector.keys())
        return F.struct(
            F.lit(k).alias("k"), F.lit(name).alias("license"), F.lit(len(_split(text))).alias("size"), F.create_map(*[F.lit(x) for pair in vector.items() for x in pair]).alias("vector"),
            F.array(*map(F.lit, numbers)).cast("array<string>").alias("numbers"), F.array(*map(F.lit, others)).alias("others"),
        )

    return F.array(*[one(k, name, text, vector) for k, ((name, text), vector) in enumerate(zip(templates, vectors, strict=True))])


def _possible(words: Column, known: Column, vocabulary: list[str], threshold: float) -> Column:
    """The templates that a line or window of a text of these words can reach the threshold with, and maybe more."""
    held = lambda t, p: F.aggregate(F.map_entries(t["vector"]), F.lit(0.0), lambda a, e: a + F.when(F.array_contains(p, e["key"]), e["value"] * e["value"]).otherwise(0.0))
    near = lambda t, p: (F.size(F.array_except(t["numbers"], p)) == 0) & (held(t, p) >= threshold * threshold - 1e-8)
    present = F.array_intersect(words, F.array(*map(F.lit, vocabulary)))
    return F.transform(F.array(present), lambda p: F.filter(known, lambda t: near(t, p)))[0]  # an array of one, so that it is computed once


def _lines(lines: Column, possible: Column, weights: Column, unseen: float) -> Column:
    """``cosine, rank, license, words`` of each line with its best template of those ``possible``."""
    sized = _vectors(F.transform(lines, _words), weights, unseen)
    against = lambda x, t: F.struct(_cosine(x, t).alias("cosine"), (-t["k"]).alias("rank"), t["license"].alias("license"), x["n"].alias("words"))
    return F.transform(sized, lambda x: F.array_max(F.transform(possible, lambda t: against(x, t))))


def _windows(words: Column, known: Column, possible: Column, weights: Column, unseen: float, threshold: float, templates, vectors: list[dict[str, float]]) -> Column:
    """``cosine, rank, license, start, size`` of the runs of a template's length that reach the threshold with it; only those ``possible`` are tried."""
    holders: dict[str, list[int]] = {}
    for k, vector in enumerate(vectors):
        for word in cues([vector], threshold):
            holders.setdefault(word, []).append(k)
    sizes = [len(_split(text)) for _, text in templates]
    held = F.create_map(*[x for w, ks in holders.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(sizes[k]).alias("size")) for k in ks]))])
    allowed = lambda ks: F.filter(ks, lambda k: F.exists(possible, lambda t: t["k"] == k["k"]))
    places = F.filter(F.transform(words, lambda w, at: F.struct(at.alias("at"), F.try_element_at(held, w).alias("held"))), lambda x: x["held"].isNotNull())

    def around(place: Column, k: Column) -> Column:
        size = k["size"]
        last = F.greatest(F.lit(0), F.least(place["at"], F.size(words) - size))
        starts = F.sequence(F.least(last, F.greatest(F.lit(0), place["at"] - size + 1)), last)
        return F.transform(starts, lambda a: k["k"].cast("long") * (1 << 32) + a)

    tried = F.array_distinct(F.flatten(F.transform(places, lambda p: F.flatten(F.transform(allowed(p["held"]), lambda k: around(p, k))))))
    spots = F.transform(tried, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("k"), F.element_at(known, F.shiftright(x, 32).cast("int") + 1).alias("t"), x.bitwiseAND((1 << 32) - 1).cast("int").alias("start")))
    cut = F.transform(spots, lambda x: F.struct(x["k"].alias("k"), x["t"].alias("t"), x["start"].alias("start"), _vectors(F.array(F.slice(words, x["start"] + 1, x["t"]["size"])), weights, unseen)[0].alias("x")))
    found = F.transform(cut, lambda c: F.struct(
        _cosine(c["x"], c["t"]).alias("cosine"), (-c["k"]).alias("rank"), c["t"]["license"].alias("license"), c["start"].alias("start"), c["x"]["n"].alias("size")))
    return F.filter(found, lambda x: x["cosine"] >= threshold)


def _tags(text: Column) -> Column:
    """What SPDX tags state; ``words`` counts those of the tag."""
    named = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    return F.transform(named, lambda x: F.struct(F.lit(1.0).alias("cosine"), F.lit(1).alias("rank"), x.alias("license"), (F.size(_words(x)) + 3).alias("words")))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``doc_id, path, license, kind, cosine, license_dir`` of each row; kind is file, header, inherited or none."""
    idf, vectors = model(templates)
    known, unseen = _templates(templates, vectors), math.log(1 + len(templates)) + 1
    weights = F.create_map(*[F.lit(x) for w, v in idf.items() for x in (w, v)])
    cue = r"(?i)(?<![a-z0-9])(?:" + "|".join(cues(vectors, threshold)) + r")(?![a-z0-9])"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), text.alias("text"), _words(text).alias("words"))
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(cue))
    text = F.col("text")
    stated = F.filter(_lines(lines, F.col("possible"), weights, unseen), lambda x: x["cosine"] >= threshold)
    parts = F.struct(_windows(F.col("words"), known, F.col("possible"), weights, unseen, threshold, templates, vectors).alias("windows"), F.size("words").alias("n"))
    rows = rows.withColumn("possible", _possible(F.col("words"), known, sorted(idf), threshold))
    rows = rows.withColumn("worth", ((F.size("possible") > 0) & text.rlike(cue)) | text.rlike(SPDX))
    worth = F.col("worth")
    rows = rows.select(
        "doc_id", "path",
        F.when(worth, F.concat(_tags(text), stated)).alias("stated"), F.when(worth, parts).alias("parts"),
        (worth & text.rlike(BINARY_CLAUSE) & ~text.rlike(NAME_CLAUSE)).alias("two_clauses"),
    )
    plain = lambda x: F.struct(x["cosine"].alias("cosine"), x["rank"].alias("rank"), x["license"].alias("license"))
    covered = F.array_distinct(F.flatten(F.transform("parts.windows", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))
    rows = rows.select(
        "doc_id", "path", "two_clauses", F.concat(F.transform("stated", plain), F.transform("parts.windows", plain)).alias("stated"),
        (F.greatest(F.aggregate("stated", F.lit(0), lambda a, x: a + x["words"]), F.size(covered)) / F.col("parts.n")).alias("share"),
    )
    shared = [-k for k, (_, x) in enumerate(templates) if x == BSD]
    top = F.coalesce(F.array_max(F.filter("stated", lambda x: x["license"] != RESERVED)), F.array_max("stated"))
    rows = rows.select("doc_id", "path", "two_clauses", "share", top.alias("top"))
    named = F.when(F.col("two_clauses") & F.col("top.rank").isin(shared), F.lit("BSD-2-Clause")).otherwise(F.col("top.license"))
    best = F.when(F.col("top").isNotNull(), F.struct(F.col("top.cosine").alias("cosine"), named.alias("license")))
    share = F.col("share")
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = rows.select(
        "doc_id", "path", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("dir"), best["license"].alias("own"), best["cosine"].alias("cosine"),
        F.when(best.isNotNull(), (F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME) | (share >= FILE_SHARE))).alias("is_file"),
    )
    rows = materialize(rows, "licenses")
    licensed = rows.where("is_file").groupBy("dir").agg(F.max(F.struct("cosine", "own")).alias("x")).select(F.col("dir").alias("up"), F.col("x.own").alias("given"), F.col("x.cosine").alias("given_cosine"))
    above = rows.where("own is null").select("dir").distinct().select("dir", F.explode(_ancestors(F.col("dir"))).alias("up"))
    near = above.join(licensed, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "given", "given_cosine")).alias("near"))
    joined = rows.join(near, "dir", "left")
    inherited = F.col("own").isNull() & F.col("near").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("own", "near.given").alias("license"),
        F.when(inherited, F.lit("inherited")).when(F.col("own").isNull(), F.lit("none")).when(F.col("is_file"), F.lit("file")).otherwise(F.lit("header")).alias("kind"),
        F.coalesce("cosine", "near.given_cosine").alias("cosine"), F.when(inherited, F.col("near.up")).when(F.col("own").isNotNull(), F.col("dir")).alias("license_dir"),
    )


def _ancestors(directory: Column) -> Column:
    """The directory itself and all above it; the root is the empty path."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def document_path() -> Column:
    """The directory layout that the query gives to documents: source, language, then the id in hundreds."""
    return F.concat_ws("/", F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
