"""License scans by ordered signature rules.

Texts become words (A-Z lower-cased). A keyword prefilter decides which rules are tried: a rule runs only where its keyword
and the words that its template always holds stand; nothing else is asked of a text. Each rule is a regular expression over the words joined by single spaces, with a
priority and a confidence. A detection that lies within another of higher priority, or of equal priority and more words, is
suppressed. Only built-in functions; one scan, no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import ascii_lower, hold, table

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: (label, keyword, regular expression of the license's name, id as SPDX words)
FAMILIES = [
    ("mit", "mit", "mit", "mit"), ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? v?1 1", "apache 1 1"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd 2 clause"), ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)", "bsd 3 clause"),
    ("bsd-4", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd 4 clause"), ("bsd", "bsd", "bsd", "bsd"), ("0bsd", "0bsd", "(?:0bsd|zero clause bsd)", "0bsd"),
    ("gpl", "general public", "(?:gnu )?general public", "gpl"), ("gpl-2", "gpl", "(?:gnu )?gpl(?: version)? v?2(?: 0)?", "gpl 2 0"), ("gpl-3", "gpl", "(?:gnu )?gpl(?: version)? v?3(?: 0)?", "gpl 3 0"),
    ("gpl-2", "general public licen", "(?:gnu )?general public licen[sc]e(?: version)? v?2(?: 0)?", "gpl 2 0"), ("gpl-3", "general public licen", "(?:gnu )?general public licen[sc]e(?: version)? v?3(?: 0)?", "gpl 3 0"),
    ("lgpl-2.1", "lesser general public licen", "(?:gnu )?lesser general public licen[sc]e(?: version)? v?2 1", "lgpl 2 1"), ("lgpl-3", "lesser general public licen", "(?:gnu )?lesser general public licen[sc]e(?: version)? v?3(?: 0)?", "lgpl 3 0"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public", "lgpl"), ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version)? v?2 1", "lgpl 2 1"), ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?: version)? v?3(?: 0)?", "lgpl 3 0"),
    ("agpl", "affero", "(?:gnu )?affero general public", "agpl"), ("agpl-3", "agpl", "(?:gnu )?agpl(?: version)? v?3(?: 0)?", "agpl 3 0"), ("gfdl", "free documentation", "(?:gnu )?free documentation", "gfdl 1 3"),
    ("mpl-1.1", "mozilla", "mozilla public(?: license)?(?: version)? v?1 1", "mpl 1 1"), ("mpl-2", "mozilla", "mozilla public(?: license)?(?: version)? v?2(?: 0)?", "mpl 2 0"), ("mpl", "mozilla", "mozilla public", "mpl"),
    ("epl-1", "eclipse", "eclipse public(?: license)?(?: version)? v?1(?: 0)?", "epl 1 0"), ("epl-2", "eclipse", "eclipse public(?: license)?(?: version)? v?2(?: 0)?", "epl 2 0"), ("epl", "eclipse", "eclipse public", "epl"),
    ("cddl", "common development", "common development and distribution", "cddl 1 0"), ("isc", "isc", "isc", "isc"), ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"), ("zlib", "zlib", "zlib", "zlib"),
    ("boost", "boost", "boost(?: software)?", "bsl 1 0"), ("artistic", "artistic", "artistic", "artistic 2 0"), ("cc0", "cc0", "cc0(?: 1 0)?", "cc0 1 0"), ("cc-by", "cc by", "cc by(?: [1234] 0)?", "cc by 4 0"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1234] 0)?", "cc by sa 4 0"), ("cc-by-nd", "cc by nd", "cc by nd(?: [1234] 0)?", "cc by nd 4 0"), ("cc-by-nc", "cc by nc", "cc by nc(?: [1234] 0)?", "cc by nc 4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1234] 0)?", "cc by nc sa 4 0"), ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1234] 0)?", "cc by nc nd 4 0"), ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("psf", "python software", "python software foundation", "psf 2 0"), ("openssl", "openssl", "openssl", "openssl"), ("ofl", "open font", "(?:sil )?open font", "ofl 1 1"), ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("ms-pl", "microsoft public", "microsoft public", "ms pl"), ("eupl", "european union public", "european union public", "eupl 1 2"), ("php", "php", "php", "php 3 01"), ("ruby", "ruby", "ruby", "ruby"), ("x11", "x11", "x11", "x11"),
]
#: What else a license may be for: "license N" after such a word isn't about software.
OTHER_LICENSES = ["driving", "driver", "drivers", "fishing", "hunting", "marriage", "gun", "liquor", "pilot", "pilots", "medical", "nursing", "teaching", "trading", "taxi", "dog", "television", "tv", "radio"]
#: (expression around a name N or id I, confidence); earlier templates have the higher priority. ANCHORS: words that each always holds.
TEMPLATES = [
    ("spdx license identifier I(?: only| or later)?", 1.0), ("licensed under(?: the)?(?: terms of(?: the)?)? N(?: license)?", 0.95), ("(?:released|distributed|published) under(?: the)?(?: terms of(?: the)?)? N(?: license)?", 0.95),
    ("(?:available|made available) under(?: the)? N(?: license)?", 0.9), ("under(?: the)? terms of(?: the)? N(?: license)?", 0.9), ("under(?: the)? N license", 0.85), ("subject to(?: the)?(?: terms of(?: the)?)? N license", 0.85), ("".join(f"(?<! {word} )" for word in OTHER_LICENSES) + "license[sd]? N", 0.7), ("N licen[sc]ed?", 0.6),
]
ANCHORS = ["spdx license identifier", "licensed under", "ed under", "available under", "terms of", "license", "subject to", "license", "licen"]
#: Labels that a name alone detects: rules without a template, of the lowest priority.
BARE = {"cc0", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "gpl", "lgpl", "agpl", "mpl", "epl", "unlicense"}
#: Signatures from the licenses' own words: (label, words that the signature always holds, regular expression). They come before all templates.
SIGNATURES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "express or implied including", "the software is provided as is without warranty of any kind express or implied including but not limited to"),
    ("x11", "of the x consortium", "except as contained in this notice the name of the x consortium"),
    ("bsd-2", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted(?! provided that the following conditions are met.{0,900} neither the name)"),
    ("bsd-3", "neither the name", "neither the names? of .{1,80} nor the names of (?:its|their|any) contributors may be used to endorse or promote"),
    ("bsd-4", "all advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice"),
    ("0bsd", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("apache-2", "in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2", "limitations under the license", "for the specific language governing permissions and limitations under the license"),
    ("apache-2", "apache org licenses license 2 0", "(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-1.1", "this product includes software developed by the apache", "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "either version 2 of the license", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "either version 3 of the license", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl", "should have received a copy of the gnu general", "you should have received a copy of the gnu general public license"),
    ("lgpl", "should have received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "gnu library general public license", "gnu library general public license"),
    ("lgpl-2.1", "either version 2 1 of the license", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("agpl", "should have received a copy of the gnu affero", "you should have received a copy of the gnu affero general public license"),
    ("agpl-3", "gnu affero general public license", "gnu affero general public license(?: as published by the free software foundation either)? version 3(?: of the license)?"),
    ("gfdl", "copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "this source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "mozilla org mpl", "(?:www )?mozilla org mpl(?: 2 0| mpl 1 1 html)?"),
    ("epl-1", "eclipse org legal epl v10", "(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-2", "eclipse org legal epl 2 0", "(?:www )?eclipse org legal epl 2 0(?: html)?"),
    ("epl", "the accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", "(?:please refer to )?(?:http |https )?unlicense org"),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "this (?:file|work|code|software|document|text) is in the public domain"),
    ("zlib", "in no event will the authors be held liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("boost", "boost software license", "boost software license version 1 0(?: august 17th 2003)?"),
    ("boost", "boost org license 1 0", "(?:www )?boost org license 1 0 txt"),
    ("artistic", "you may charge a reasonable copying fee", "you may charge a reasonable copying fee for any distribution of this package"),
    ("artistic", "same terms as perl", "(?:under|on) the same terms as perl(?: itself)?"),
    ("wtfpl", "do what the fuck you want to", "do what the fuck you want to public license"),
    ("wtfpl", "do what the fuck you want to", "you just do what the fuck you want to"),
    ("psf", "psf is making python available", "psf is making python available to licensee on an as is basis"),
    ("psf", "python software foundation license", "python software foundation license version 2"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ofl", "reserved font name", "with reserved font name"),
    ("ofl", "this font software is licensed", "this font software is licensed under the sil open font license"),
    ("ofl", "scripts sil org ofl", "(?:http |https )?scripts sil org ofl"),
    ("postgresql", "university of california", "in no event shall the university of california be liable to any party for direct indirect special"),
    ("cc0", "to the extent possible under law", "to the extent possible under law .{1,120} has waived all copyright and related or neighboring rights"),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by [1234] 0"),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa [1234] 0"),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd [1234] 0"),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc [1234] 0"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [1234] 0"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [1234] 0"),
    ("cc-by", "creative commons attribution", "creative commons attribution(?: license)?(?: [1234] 0)?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-sa", "creative commons attribution share", "creative commons attribution share ?alike(?: [1234] 0)?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc", "creative commons attribution non", "creative commons attribution non ?commercial(?: [1234] 0)?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc-sa", "creative commons attribution non", "creative commons attribution non ?commercial share ?alike(?: [1234] 0)?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc-nd", "creative commons attribution non", "creative commons attribution non ?commercial no ?deriv(?:ative|ate)?s?(?: works)?(?: [1234] 0)?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nd", "creative commons attribution no", "creative commons attribution no ?deriv(?:ative|ate)?s?(?: works)?(?: [1234] 0)?(?: international| unported| generic)?(?: license)?"),
    ("ms-pl", "microsoft public license", "microsoft public license ms pl"),
    ("eupl", "licensed under the eupl", "licensed under the eupl version 1 [12]"),
    ("eupl", "european union public licence", "european union public licence v 1 [12]"),
    ("php", "php license", "subject to version 3 0(?:1)? of the php license"),
    ("ruby", "ruby s license", "(?:under|by) ruby s license"),
    ("proprietary", "all rights reserved", "all rights reserved (?:unauthorized copying|no part of this)"),
    ("proprietary", "confidential and proprietary", "(?:this is )?confidential and proprietary (?:information|material|software)"),
    ("proprietary", "without the prior written permission", "(?:copied|reproduced|distributed|used) without the prior written permission"),
]
#: Names and ids that stand for one license by themselves, and how other languages name it: (label, words that each always holds,
#: regular expression). Below all templates, above BARE. "MIT-Lizenz" needs an article, as "mit Lizenz" is German for "with a license".
NAMED = [
    ("apache-2", "apache 2 0", "apache 2 0"),
    ("apache-2", "apache lizenz", "apache lizenz(?: version)? 2(?: 0)?"),
    ("apache-2", "licence apache", "licence apache(?: version)? 2(?: 0)?"),
    ("apache-2", "licencia apache", "licencia apache(?: versión)? 2(?: 0)?"),
    ("mit", "mit lizenz", "(?:unter |unter der |unter einer |der |die |einer )mit lizenz"),
    ("mit", "licence mit", "(?:sous |la )licence mit"),
    ("mit", "licencia mit", "(?:bajo |la )licencia mit"),
    ("gpl-2", "gpl", "(?:gnu )?gpl ?v2(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?: version)? 2(?: 0)(?: only| or later)?"),
    ("gpl-3", "gpl", "(?:gnu )?gpl ?v3(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", "(?:gnu )?gpl(?: version)? 3(?: 0)(?: only| or later)?"),
    ("gpl-2", "general public license", "(?:gnu )?general public license(?: version)? v?2(?: 0)?"),
    ("gpl-3", "general public license", "(?:gnu )?general public license(?: version)? v?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?v?2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl ?v3(?: 0)?(?: only| or later)?"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?: version)? 3 0(?: only| or later)?"),
    ("agpl-3", "agpl", "(?:gnu )?agpl ?v3(?: 0)?(?: only| or later)?"),
    ("agpl-3", "agpl", "(?:gnu )?agpl(?: version)? 3 0(?: only| or later)?"),
    ("mpl-2", "mpl", "mpl ?v?2 0"),
    ("mpl-1.1", "mpl", "mpl ?v?1 1"),
    ("epl-2", "epl", "epl ?v?2 0"),
    ("epl-1", "epl", "epl ?v?1 0"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("cddl", "cddl", "cddl(?: ?v?1 [01])"),
    ("eupl", "eupl", "eupl(?: ?v?1 [12])"),
]
RULE = "struct<label:string,keyword:string,anchor:string,pattern:string,priority:int,confidence:double>"


def rules() -> list[dict]:
    """One rule for each signature, each name or id, each family and template, and each bare name; a keyword stands in all that its rule matches."""
    top = len(TEMPLATES) + 2
    out = [{"label": label, "keyword": keyword, "anchor": "", "pattern": f"(?<= )(?:{pattern})(?= )", "priority": top, "confidence": 1.0} for label, keyword, pattern in SIGNATURES]
    out += [{"label": label, "keyword": keyword, "anchor": "", "pattern": f"(?<= )(?:{pattern})(?= )", "priority": 1, "confidence": 0.6} for label, keyword, pattern in NAMED]
    for label, keyword, name, spdx in FAMILIES:
        for k, (around, confidence) in enumerate(TEMPLATES):
            pattern = f"(?<= ){around.replace('N', f'(?:{name})').replace('I', spdx)}(?= )"
            out.append({"label": label, "keyword": spdx if "I" in around else keyword, "anchor": ANCHORS[k], "pattern": pattern, "priority": len(TEMPLATES) + 1 - k, "confidence": confidence})
        if label in BARE:
            out.append({"label": label, "keyword": keyword, "anchor": "", "pattern": f"(?<= ){name}(?= )", "priority": 0, "confidence": 0.4})
    return out


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _found(norm: Column, rule: Column) -> Column:
    """The detections of one rule: first word, words, label, priority, confidence."""
    parts, hits = F.split(norm, rule["pattern"], -1), F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    before = lambda j: F.aggregate(F.slice(parts, 1, j + 1), F.lit(0), lambda a, x: a + _spaces(x)) + F.aggregate(F.slice(hits, 1, j), F.lit(0), lambda a, x: a + _spaces(x)) - 1
    return F.transform(
        hits, lambda hit, j: F.struct(before(j).alias("at"), (_spaces(hit) + 1).alias("n"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"))
    )


def _places(phrase: str, label: str) -> Column:
    """Where a base phrase's words stand; null where the joined words don't hold it."""
    parts = phrase.split(" ")
    here = lambda i: F.array_join(F.slice("__w", i + 1, len(parts)), " ") == phrase
    at = F.filter(F.sequence(F.lit(0), F.col("__n") - len(parts)), lambda i: F.when(F.get("__w", i) == parts[0], here(i)).otherwise(F.lit(False)))
    return F.when(F.col("__norm").contains(f" {phrase} "), F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))))


FOUND = "array<struct<at:int,n:int,label:string,priority:int,confidence:double>>"


def scan(df: DataFrame) -> DataFrame:
    """``df`` with a struct ``license``: n_words, base (label and place of each base phrase), detections, labels, score.

    A null text is the empty one: no words, no labels, score 0. Detections are ordered by place. The score is the highest
    confidence left, at least 0.85 where a base phrase stands.
    """
    lower = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    names = [c for c in df.columns if c != "license"]
    step = hold(df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "text"), __low=lower).drop("text")
    step = hold(step, __w=F.array_remove(F.split("__low", BREAK), ""))
    step = hold(step, __n=F.size("__w"), __norm=F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" ")))
    base = [_places(phrase, label) for phrase, label in BASE]
    empty = F.array().cast("array<struct<at:int,label:string>>")
    groups: dict[str, list[dict]] = {}  # by what is looked for first
    for rule in rules():
        groups.setdefault(rule["anchor"] if rule["anchor"] == ANCHORS[0] else rule["keyword"], []).append(rule)
    known = F.from_json(F.lit(json.dumps([{"first": k, "rules": v} for k, v in groups.items()])), f"array<struct<first:string,rules:array<{RULE}>>>")
    first = F.filter(known, lambda g: F.contains(F.col("__norm"), g["first"]))
    near = F.filter(F.flatten(F.transform(first, lambda g: g["rules"])), lambda r: F.contains(F.col("__norm"), r["anchor"]) & F.contains(F.col("__norm"), r["keyword"]))
    step = hold(step, __near=near)
    found = F.flatten(F.transform("__near", lambda r: _found(F.col("__norm"), r)))
    step = hold(step, __base=F.flatten(F.array(*(F.coalesce(b, empty) for b in base))), __found=F.coalesce(found, F.array().cast(FOUND)))
    inside = lambda d, e: (e["at"] <= d["at"]) & (d["at"] + d["n"] <= e["at"] + e["n"]) & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (e["n"] > d["n"])))
    step = hold(step, __left=F.array_sort(F.array_distinct(F.filter("__found", lambda d: ~F.exists("__found", lambda e: inside(d, e))))))
    labels = lambda c: F.transform(c, lambda d: d["label"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("__left", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size("__base") > 0, 0.85).otherwise(0.0))
    out = F.struct(
        F.col("__n").cast("long").alias("n_words"), F.col("__base").alias("base"), F.col("__left").alias("detections"),
        F.array_sort(F.array_distinct(labels("__base"))).alias("base_labels"), F.array_sort(F.array_distinct(F.concat(labels("__base"), labels("__left")))).alias("labels"), best.alias("score"),
    )
    return step.select("row", out.alias("license")).select(*(F.col("row")[c].alias(c) for c in names), "license")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")
    places = F.transform("base", lambda b: b["at"].cast("long"))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
