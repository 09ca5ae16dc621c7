"""Licences of pages and files: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import by_key, cut, hot_keys

_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_NO_WARRANTY = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {} for more details"
_COPIES = "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"
_CC = "this work is licensed under a creative commons {} international license"

# Templates: fixed texts by licence; notices and headers as files carry them, titles of full texts, and their own paragraphs.
TEMPLATES = {
    "Apache-2.0": [
        "licensed under the apache license version 2.0", "apache license version 2.0 january 2004 http www.apache.org licenses", "apache license version 2.0 january 2004 terms and conditions for use reproduction and distribution",
        "apache license version 2.0 january 2004 http www.apache.org licenses terms and conditions for use reproduction and distribution 1. definitions",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "MIT": [
        "released under the mit license", "the mit license mit", "mit license permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license version 3", "gnu general public license version 3 29 june 2007", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc http fsf.org " + _COPIES,
        "this program is free software " + _GNU.format("general public license", 3), "you should have received a copy of the gnu general public license version 3 along with this program",
    ],
    "GPL-2.0": [
        "licensed under the gnu general public license version 2", "gnu general public license version 2 june 1991", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa " + _COPIES,
        "this program is free software " + _GNU.format("general public license", 2), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    ],
    "GPL-1.0": ["licensed under the gnu general public license version 1", "gnu general public license version 1 february 1989", "gnu general public license version 1 february 1989 copyright c 1989 free software foundation inc", "gnu general public license version 1 february 1989 copyright c 1989 free software foundation inc " + _COPIES, "this program is free software " + _GNU.format("general public license", 1)],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3 29 june 2007", "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc http fsf.org " + _COPIES, "this library is free software " + _GNU.format("lesser general public license", 3)],
    "LGPL-2.1": ["licensed under the gnu lesser general public license version 2.1", "gnu lesser general public license version 2.1 february 1999", "gnu lesser general public license version 2.1 february 1999 copyright c 1991 1999 free software foundation inc", "gnu lesser general public license version 2.1 february 1999 copyright c 1991 1999 free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa " + _COPIES, "this library is free software " + _GNU.format("lesser general public license", 2.1), "this library " + _NO_WARRANTY.format("lesser general public license")],
    "LGPL-2.0": ["licensed under the gnu library general public license version 2", "gnu library general public license version 2 june 1991", "gnu library general public license version 2 june 1991 copyright c 1991 free software foundation inc", "gnu library general public license version 2 june 1991 copyright c 1991 free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa " + _COPIES, "this library is free software " + _GNU.format("library general public license", 2), "this library " + _NO_WARRANTY.format("library general public license")],
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "gnu affero general public license version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc", "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc http fsf.org " + _COPIES, "this program is free software " + _GNU.format("affero general public license", 3), "this program " + _NO_WARRANTY.format("affero general public license")],
    "GFDL-1.3": ["gnu free documentation license version 1.3 3 november 2008", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1.3 or any later version published by the free software foundation with no invariant sections no front cover texts and no back cover texts"],
    "GFDL-1.2": ["gnu free documentation license version 1.2 november 2002", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1.2 or any later version published by the free software foundation with no invariant sections no front cover texts and no back cover texts"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "mozilla public license version 2.0", "mozilla public license version 2.0 1. definitions", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"],
    "MPL-1.1": ["mozilla public license version 1.1", "mozilla public license version 1.1 1. definitions", "the contents of this file are subject to the mozilla public license version 1.1 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.mozilla.org mpl"],
    "BSD-3-Clause": [
        "bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "ISC": ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "Zlib": ["zlib license", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "CC-BY-4.0": ["licensed under cc by 4.0", "creative commons attribution 4.0 international license", _CC.format("attribution 4.0")],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license", _CC.format("attribution noncommercial 4.0")],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4.0", "creative commons attribution sharealike 4.0 international license", _CC.format("attribution sharealike 4.0")],
    "CC0-1.0": ["licensed under cc0 1.0", "cc0 1.0 universal public domain dedication", "creative commons legal code cc0 1.0 universal", "cc0 1.0 universal creative commons corporation is not a law firm and does not provide legal services distribution of this document does not create an attorney client relationship"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved no part may be reproduced without permission"],
}
#: Says the least: it counts only where no other licence is named.
WEAKEST = "Proprietary"
#: Least cosine that names a licence.
LEAST = 0.6
#: Units of a text, all of which are compared: lines, paragraphs (between tags, or lines without a letter or digit), sentences.
BREAKS = (r"<[^>]*>|[\n\r]+", r"<[^>]*>|\n[^A-Za-z0-9\n<]*\n", r"<[^>]*>|\n[^A-Za-z0-9\n<]*\n|[.;:][ \t\r\n]+")
#: A unit without any of these words is not compared; every template has one.
CUE = r"(?i)licen[cs]|copyright|warrant|public domain|rights reserved|redistribut|permission|permitted|written permission|mozilla|creative commons|cc0"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE = r"(?i)^(licen[cs]es?|copying|notice|legal)(\.[a-z0-9]+)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def path_of(url: Column) -> Column:
    """Host and path of a URL, or a plain path; without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#][\s\S]*$", "")


def directory(path: Column) -> Column:
    """The directory that a path lies in; a path that ends with / is the index of that directory."""
    return F.regexp_replace(path, r"/[^/]*$", "")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _template_terms(docs: DataFrame) -> DataFrame:
    """(licence, variant, term, n) from literals, in the JVM."""
    texts = [F.struct(F.lit(name).alias("licence"), F.lit(k).alias("variant"), F.lit(text).alias("text")) for name, own in TEMPLATES.items() for k, text in enumerate(own)]
    rows = docs.sparkSession.range(1).select(F.explode(F.array(*texts)).alias("t")).select("t.*")
    return cut(rows.select("licence", "variant", F.explode(_terms(F.col("text"))).alias("term")).groupBy("licence", "variant", "term").agg(F.count("*").alias("n")))


def best_templates(blocks: DataFrame) -> DataFrame:
    """(key, cosine, licence) of distinct blocks (key, block, copies) that reach LEAST against any template.

    The document frequency of a term counts all blocks that hold it, copies included; weights are tf x (ln((1 + N) / (1 + df)) + 1).
    """
    tf = cut(blocks.select("key", "copies", F.explode(_terms(F.col("block"))).alias("term")).groupBy("key", "term", "copies").agg(F.count("*").alias("n")))
    df = tf.groupBy("term").agg(F.sum("copies").alias("df"))
    whole = blocks.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("whole")).first()[0]
    idf = F.log((1.0 + F.lit(whole)) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    weighed = tf.join(df, "term").select("key", "term", (F.col("n") * idf).alias("w"))
    templates = _template_terms(blocks)
    known = df.join(F.broadcast(templates.select("term").distinct()), "term")
    template = templates.join(F.broadcast(known), "term", "left").select("licence", "variant", "term", (F.col("n") * idf).alias("t"))  # known has a template's terms at most
    template = template.withColumn("size", F.sqrt(F.sum(F.col("t") * F.col("t")).over(Window.partitionBy("licence", "variant"))))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(template), "term").groupBy("key", "licence", "variant", "size").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = dots.join(norms, "key").select("key", "licence", F.round(F.col("dot") / F.col("norm") / F.col("size"), 6).alias("cosine")).where(F.col("cosine") >= LEAST)
    return scored.groupBy("key").agg(F.max(F.struct(F.col("licence") != WEAKEST, "cosine", "licence")).alias("best")).select("key", "best.cosine", "best.licence")


def licences(files: DataFrame, name: str = "page_id", path: str = "url", text: str = "html") -> DataFrame:
    """<name>, path, own_licence, cosine, licence and inherited_from of every row of files.

    A row's blocks are its lines, paragraphs and sentences, so that wrapped and unwrapped texts, notices and headers each come whole
    in some block. Those with a word of licences are compared with the templates, each distinct block once. The best block gives
    own_licence; one that only reserves all rights counts where no other names a licence. A licence file (LICENSE, COPYING, NOTICE, ...) or an index (a path ending with
    / or index.html) with a licence gives it to its directory; rows without their own take that of their nearest ancestor
    directory, and name it in inherited_from. Equal cosines go to the later name.

    Null and empty texts have no blocks, and very long ones are read whole; null paths are the path ''; a null id stays null. Rows that repeat come back repeated; other columns are left out; an
    empty table gives no rows.
    """
    text_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    units = F.concat(*[F.split(text_, b, -1) for b in BREAKS])
    blocks = F.when(text_.rlike(CUE), F.array_distinct(F.filter(units, lambda b: b.rlike(CUE)))).otherwise(F.array().cast("array<string>"))
    plain = files.select(F.col(name).cast("long").alias("id"), path_of(F.col(path)).alias("path"), blocks.alias("blocks"))
    rows = cut(plain.select(F.monotonically_increasing_id().alias("row"), "id", "path", directory(F.col("path")).alias("dir"), "blocks"))
    each = rows.select("row", F.explode("blocks").alias("block")).select("row", "block", F.sha2("block", 256).alias("key"))
    distinct = cut(each.groupBy("key").agg(F.first("block").alias("block"), F.count("*").alias("copies")))
    best = cut(best_templates(distinct))
    common = hot_keys(distinct, "key", "copies", each.count())
    own = by_key(each.select("row", "key"), best, "key", common).groupBy("row").agg(F.max(F.struct(F.col("licence") != WEAKEST, "cosine", "licence")).alias("best"))
    named = cut(rows.join(own, "row", "left").select("row", "id", "path", "dir", F.col("best.licence").alias("own"), F.col("best.cosine").alias("cosine")))
    last = F.regexp_extract("path", r"([^/]*)$", 1)
    gives = last.rlike(FILE) | (F.col("path").contains("/") & (last == "")) | last.rlike("(?i)^index\\.html?$")
    given = named.where(F.col("own").isNotNull() & gives).groupBy("dir").agg(F.max(F.struct("cosine", "own")).alias("best")).select(F.col("dir").alias("ancestor"), F.col("best.own").alias("licence"))
    parts = F.split("dir", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("ancestor")))
    dirs = named.where("own IS NULL").select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.*")
    nearest = dirs.join(given, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "licence")).alias("near"))
    full = by_key(named, cut(nearest), "dir", hot_keys(named.groupBy("dir").agg(F.count("*").alias("held")), "dir", "held", named.count()), "left")
    mine = F.col("own").isNull()
    return full.select(F.col("id").alias(name), "path", F.col("own").alias("own_licence"), "cosine", F.coalesce("own", "near.licence").alias("licence"), F.when(mine, F.col("near.ancestor")).alias("inherited_from"))


def sql() -> str:
    """The same in DuckDB SQL, over pages."""
    rows = ", ".join(f"('{name}', {k}, '{text}')" for name, texts in TEMPLATES.items() for k, text in enumerate(texts))
    units = ", ".join(f"regexp_split_to_array(html, '{b}')" for b in BREAKS)
    return rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html,
    regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#][\s\S]*$', '') AS path FROM pages),
q AS MATERIALIZED (SELECT r, page_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS last,
    list_distinct(list_filter(flatten([{units}]), lambda b: regexp_matches(b, '{CUE}'))) AS blocks FROM p),
e AS MATERIALIZED (SELECT r, unnest(blocks) AS block FROM q),
b AS MATERIALIZED (SELECT block, count(*) AS copies FROM e GROUP BY block),
t AS MATERIALIZED (SELECT block, copies, term, count(*) AS n FROM (SELECT block, copies, unnest(regexp_extract_all(translate(block, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM b) GROUP BY ALL),
f AS MATERIALIZED (SELECT term, sum(copies) AS df FROM t GROUP BY term),
w AS MATERIALIZED (SELECT block, term, n * (ln((1.0 + (SELECT sum(copies) FROM b)) / (1.0 + df)) + 1.0) AS w FROM t JOIN f USING (term)),
m AS MATERIALIZED (SELECT licence, variant, term, count(*) AS n FROM (SELECT licence, variant, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM (VALUES {rows}) AS v(licence, variant, text)) GROUP BY ALL),
mw AS MATERIALIZED (SELECT licence, variant, term, n * (ln((1.0 + (SELECT sum(copies) FROM b)) / (1.0 + coalesce(df, 0))) + 1.0) AS t FROM m LEFT JOIN f USING (term)),
ms AS (SELECT licence, variant, sqrt(sum(t * t)) AS size FROM mw GROUP BY ALL),
ns AS (SELECT block, sqrt(sum(w * w)) AS norm FROM w GROUP BY block),
d AS (SELECT block, licence, variant, sum(w * t) AS dot FROM w JOIN mw USING (term) GROUP BY ALL),
s AS MATERIALIZED (SELECT block, licence, round(dot / norm / size, 6) AS cosine FROM d JOIN ms USING (licence, variant) JOIN ns USING (block)),
o AS (SELECT r, max(row(licence <> '{WEAKEST}', cosine, licence)) AS best FROM e JOIN (SELECT * FROM s WHERE cosine >= {LEAST}) USING (block) GROUP BY r),
n AS MATERIALIZED (SELECT q.*, best[3] AS own, best[2] AS cosine FROM q LEFT JOIN o USING (r)),
g AS (SELECT dir AS ancestor, max(row(cosine, own))[2] AS licence FROM n WHERE own IS NOT NULL
    AND (regexp_matches(last, '{FILE}') OR (contains(path, '/') AND last = '') OR regexp_matches(last, '(?i)^index\.html?$')) GROUP BY dir),
a AS (SELECT DISTINCT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS ancestor FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM n WHERE own IS NULL)),
h AS (SELECT dir, max(row(k, ancestor, licence)) AS near FROM a JOIN g USING (ancestor) GROUP BY dir)
SELECT page_id, path, own AS own_licence, cosine, coalesce(own, near[3]) AS licence, CASE WHEN own IS NULL THEN near[2] END AS inherited_from FROM n LEFT JOIN h USING (dir)"""
