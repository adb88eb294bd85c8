"""License scan by ordered signature rules. DataFrame functions only.

Texts are brought to a canonical form (lower-case words, one space apart). A
keyword prefilter decides which rules a text is put to: those whose keyword is
among its words. Each rule's matches become word
intervals with the rule's priority; an interval that lies inside one of at
least its priority is suppressed. Base phrases are counted apart and stay.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import text_or_empty
from spanforge.llm.quality import let

#: Words of the base phrases and their label.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

_V = r"(?: version| v)?"
#: label -> (priority, patterns over canonical text). Priority: 1 whole notices, 2 references
#: with a version, 3 names, 4 hints. Hand-written; alternatives are separate rules. Every match
#: of a pattern holds its keyword as a word.
RULES: dict[str, list[tuple[int, str, list[str]]]] = {
    "mit": [
        (1, "permission", ["permission is hereby granted free of charge to any person obtaining a copy of this software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"]),
        (2, "mit", ["(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?mit license", "(?:is|are) (?:licensed|released) under (?:the )?mit", "subject to the (?:terms of the )?mit license"]),
        (3, "mit", ["the mit license", "mit licen[cs]e", "mit licensed", "licen[cs]e mit", "mit x11 license", "mit expat", "mit no attribution", "spdx license identifier mit"]),
        (3, "expat", ["expat license"]),
    ],
    "x11": [(3, "x11", ["x11 license", "x11 mit license", "licen[cs]e x11"]), (3, "consortium", ["x consortium license"])],
    "apache": [
        (1, "apache", ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "licensed to the apache software foundation asf under one or more contributor license agreements"]),
        (2, "apache", [rf"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?license{_V}(?: [12] [01])?", rf"apache (?:software )?license{_V} [12](?: [01])?", "apache software foundation license"]),
        (3, "apache", ["apache licen[cs]e", "apache software license", "licen[cs]e apache", "apache 2 0", "spdx license identifier apache 2 0", "www apache org licenses"]),
        (3, "apache2", ["apache2 license"]),
        (3, "asl", ["asl 2 0"]),
    ],
    "bsd": [
        (1, "redistribution", ["redistribution and use in source and binary forms with or without modification are permitted"]),
        (1, "redistributions", ["redistributions of source code must retain the above copyright notice this list of conditions", "redistributions in binary form must reproduce the above copyright notice"]),
        (1, "neither", ["neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"]),
        (2, "bsd", ["bsd [0234] clause(?: license)?", "(?:two|three|four|2|3|4) clause bsd(?: license)?", "(?:new|modified|revised|simplified|original|old) bsd(?: license)?", "(?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?bsd"]),
        (3, "bsd", ["bsd licen[cs]e", "bsd licensed", "bsd style license", "licen[cs]e bsd", "bsd protection license", "spdx license identifier bsd"]),
        (3, "freebsd", ["freebsd license"]),
        (3, "netbsd", ["netbsd license"]),
        (3, "openbsd", ["openbsd license"]),
    ],
    "0bsd": [(2, "0bsd", ["0bsd(?: license)?", "spdx license identifier 0bsd"]), (2, "bsd", ["bsd zero clause(?: license)?", "zero clause bsd"])],
    "gpl": [
        (1, "gnu", ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "you should have received a copy of the gnu general public license along with"]),
        (2, "gnu", [rf"gnu general public license(?: as published by the free software foundation)?(?: either)?{_V} [123](?: 0)?(?: or (?:at your option )?any later version)?", "gnu gpl v?[123](?: 0)?", "(?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?gnu (?:gpl|general public)"]),
        (2, "gpl", ["gpl v?[123](?: [01])?(?: or later| only)?", "gpl version [123]", "spdx license identifier gpl"]),
        *((2, f"gplv{v}", [f"gplv{v}"]) for v in (1, 2, 3)),
        (3, "general", ["general public licen[cs]e"]),
        (3, "gnu", ["gnu gpl", "gnu general public"]),
        (3, "gpl", ["gpl licen[cs]e", "gpl licensed", "licen[cs]e gpl", "gpl compatible"]),
    ],
    "lgpl": [
        *((1, k, [f"this library is free software you can redistribute it and or modify it under the terms of the gnu {k} general public license"]) for k in ("lesser", "library")),
        (2, "lesser", [rf"gnu lesser general public license{_V}(?: [23](?: [01])?)?", "lesser general public license"]),
        (2, "library", ["gnu library general public license", "library general public license"]),
        (2, "lgpl", ["lgpl v?[23](?: [01])?(?: or later| only)?", "lgpl licen[cs]e", "gnu lgpl", "spdx license identifier lgpl"]),
        *((2, f"lgplv{v}", [f"lgplv{v}"]) for v in (2, 3)),
    ],
    "agpl": [
        (1, "affero", ["redistribute it and or modify it under the terms of the gnu affero general public license"]),
        (2, "affero", [rf"(?:gnu )?affero general public license{_V}(?: [13](?: 0)?)?", "affero gpl"]),
        (2, "agpl", ["agpl v?[13](?: 0)?(?: or later| only)?", "agpl licen[cs]e", "gnu agpl", "spdx license identifier agpl"]),
        (2, "agplv3", ["agplv3"]),
    ],
    "fdl": [(2, "gnu", ["gnu free documentation license(?: version)?(?: 1 [123])?"]), (2, "gfdl", ["gfdl(?: 1 [123])?"]), (3, "free", ["free documentation license"])],
    "mpl": [
        (1, "mozilla", ["this source code form is subject to the terms of the mozilla public license v 2 0", "the contents of this file are subject to the mozilla public license"]),
        (2, "mozilla", [rf"mozilla public license{_V}(?: [12] [01])?"]),
        (3, "mpl", ["mpl v?[12](?: [01])?", "mpl license", "spdx license identifier mpl"]),
        (3, "mplv2", ["mplv2"]),
    ],
    "epl": [(2, "eclipse", [rf"eclipse public license{_V}(?: [12] 0)?", "eclipse distribution license(?: v 1 0)?"]), (3, "epl", ["epl v?[12](?: 0)?", "epl license"])],
    "cpl": [(2, "common", ["common public license(?: version)?(?: 1 0)?"]), (3, "cpl", ["cpl 1 0", "cpl license"])],
    "cddl": [(2, "cddl", ["cddl(?: version)?(?: 1 [01])?"]), (2, "common", ["common development and distribution license(?: version)?(?: 1 [01])?"])],
    "ipl": [(2, "ibm", ["ibm public license(?: version)?(?: 1 0)?"])],
    "isc": [
        (1, "permission", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
        (2, "isc", ["(?:licensed|released) under (?:the )?isc", "isc licen[cs]e", "licen[cs]e isc", "spdx license identifier isc"]),
        (3, "internet", ["internet systems consortium license", "internet software consortium license"]),
    ],
    "zlib": [(1, "software", ["this software is provided as is without any express or implied warranty in no event will the authors be held liable"]), (2, "zlib", ["zlib licen[cs]e", "zlib libpng license", "licen[cs]e zlib", "zlib acknowledgement"])],
    "libpng": [(2, "libpng", ["libpng licen[cs]e"]), (2, "png", ["png reference library license"])],
    "boost": [(1, "boost", ["distributed under the boost software license version 1 0", "boost software license version 1 0 august 17th 2003"]), (2, "boost", ["boost software license(?: version)?(?: 1 0)?", "boost license"]), (3, "bsl", ["bsl 1 0"])],
    "unlicense": [(1, "unencumbered", ["this is free and unencumbered software released into the public domain"]), (2, "unlicense", ["the unlicense", "unlicense"])],
    "cc0": [(2, "cc0", ["cc0(?: 1 0)?(?: universal)?"]), (2, "creative", ["creative commons zero(?: v1 0)?(?: universal)?", "creative commons cc0"]), (3, "public", ["public domain dedication"])],
    "cc-by": [(2, "creative", ["creative commons attribution(?: [1234] [05])?(?: (?:international|unported|generic))?(?: (?:public )?license)?"]), (2, "cc", [r"cc by [1234] [05]", "cc by licen[cs]e", "cc by"])],
    "cc-by-sa": [(2, "creative", ["creative commons attribution share ?alike(?: [1234] [05])?(?: (?:international|unported|generic))?(?: (?:public )?license)?"]), (2, "cc", ["cc by sa(?: [1234] [05])?"])],
    "cc-by-nc": [(2, "creative", ["creative commons attribution non ?commercial(?: [1234] [05])?(?: (?:international|unported|generic))?"]), (2, "cc", ["cc by nc(?: [1234] [05])?"])],
    "cc-by-nd": [(2, "creative", ["creative commons attribution no ?derivatives(?: [1234] [05])?"]), (2, "cc", ["cc by nd(?: [1234] [05])?"])],
    "cc-by-nc-sa": [(2, "creative", ["creative commons attribution non ?commercial share ?alike(?: [1234] [05])?"]), (2, "cc", ["cc by nc sa(?: [1234] [05])?"])],
    "cc-by-nc-nd": [(2, "creative", ["creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?"]), (2, "cc", ["cc by nc nd(?: [1234] [05])?"])],
    "creative-commons": [(4, "creative", ["creative commons licen[cs]e", "creative commons"])],
    "wtfpl": [(2, "wtfpl", ["wtfpl(?: version)?(?: 2)?"]), (2, "fuck", ["do what the fuck you want to public license"])],
    "artistic": [(2, "artistic", ["(?:the )?(?:clarified )?artistic license(?: [12] 0)?"]), (3, "perl", ["same terms as perl itself", "perl 5 license"])],
    "python": [(2, "python", ["python software foundation license(?: version)?(?: 2)?", "python license"]), (2, "psf", ["psf license agreement"]), (3, "psf", ["psf license", "psf 2 0"])],
    "ruby": [(3, "ruby", ["ruby license", "same terms as ruby", "licen[cs]e ruby"])],
    "php": [(2, "php", ["php license(?: version)?(?: 3 0 ?1?)?", "php software license"])],
    "openssl": [(2, "openssl", ["openssl license", "openssl and ssleay license"]), (3, "ssleay", ["original ssleay license", "ssleay license"])],
    "curl": [(3, "curl", ["curl license", "curl and libcurl license"])],
    "eupl": [(2, "eupl", ["eupl(?: v)?(?: 1 [012])?", "eupl v1 [012]"]), (2, "eupl1", ["eupl1 [012]"]), (2, "european", ["european union public licen[cs]e(?: v)?(?: ?1 [012])?"])],
    "osl": [(2, "open", ["open software license(?: v)?(?: ?[123] 0)?"]), (3, "osl", ["osl 3 0", "osl license"])],
    "afl": [(2, "academic", ["academic free license(?: v)?(?: ?[123] [012])?"]), (3, "afl", ["afl 3 0"])],
    "ofl": [(2, "open", ["open font license(?: version)?(?: 1 [01])?"]), (2, "sil", ["sil open font license(?: version)?(?: 1 [01])?"]), (3, "ofl", ["ofl 1 [01]"])],
    "ms-pl": [(2, "microsoft", ["microsoft public license"]), (3, "ms", ["ms pl license", "ms pl"])],
    "ms-rl": [(2, "microsoft", ["microsoft reciprocal license"]), (3, "ms", ["ms rl"])],
    "ncsa": [(2, "ncsa", ["ncsa open source license", "university of illinois ncsa", "ncsa license"])],
    "ecl": [(2, "educational", ["educational community license(?: version)?(?: [12] 0)?"])],
    "postgresql": [(2, "postgresql", ["postgresql license", "postgresql licen[cs]ed"])],
    "vim": [(3, "vim", ["vim license", "vim charityware license"])],
    "sleepycat": [(3, "sleepycat", ["sleepycat license", "sleepycat public license"])],
    "qpl": [(2, "q", ["q public license(?: version)?(?: 1 0)?"]), (3, "qpl", ["qpl 1 0"])],
    "lppl": [(2, "latex", ["latex project public license(?: v)?(?: ?1 [0123][abc]?)?"]), (3, "lppl", ["lppl(?: 1 [0123][abc]?)?"])],
    "odbl": [(2, "open", ["open database license(?: v)?(?: ?1 0)?", "open data commons open database license"]), (3, "odbl", ["odbl(?: 1 0)?"])],
    "odc-by": [(2, "open", ["open data commons attribution license(?: v)?(?: ?1 0)?"])],
    "pddl": [(2, "public", ["public domain dedication and license"]), (3, "pddl", ["pddl(?: 1 0)?"])],
    "public-domain": [(3, "public", ["(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain software"]), (4, "public", ["public domain"])],
    "sspl": [(2, "server", ["server side public license(?: v)?(?: ?1)?"]), (3, "sspl", ["sspl(?: v?1)?"])],
    "busl": [(2, "business", ["business source license(?: 1 1)?"]), (3, "busl", ["busl 1 1"])],
    "elastic": [(2, "elastic", ["elastic license(?: 2 0)?"])],
    "commons-clause": [(2, "commons", ["commons clause license condition(?: v1 0)?", "commons clause"])],
    "polyform": [(2, "polyform", ["polyform (?:noncommercial|small business|strict|perimeter|shield|internal use) license(?: 1 0 0)?"])],
    "openrail": [*((2, k, [f"(?:bigscience |creativeml )?{k} m?(?: license)?"]) for k in ("openrail", "rail")), (2, "responsible", ["responsible ai license"])],
    "llama": [(2, "llama", ["llama [234] community license(?: agreement)?"])],
    "upl": [(2, "universal", ["universal permissive license(?: v)?(?: ?1 0)?"])],
    "blueoak": [(2, "blue", ["blue oak model license(?: 1 0 0)?"])],
    "mulan": [(2, "mulan", ["mulan (?:psl|permissive software license)(?: v?[12])?"])],
    "cecill": [(2, "cecill", ["cecill(?: [bc])?(?: 2 [01])?(?: license)?"])],
    "beerware": [(3, "beer", ["the beer ware license", "beer ware license"]), (3, "beerware", ["beerware"])],
    "json": [(2, "json", ["json license"]), (3, "shall", ["the software shall be used for good not evil"])],
    "w3c": [(2, "w3c", ["w3c software (?:and document )?(?:notice and )?license", "w3c license"])],
    "unicode": [(2, "unicode", ["unicode license(?: agreement)?(?: v3)?", "unicode terms of use"])],
    "intel": [(3, "intel", ["intel open source license", "intel simplified software license"])],
    "nvidia": [(3, "nvidia", ["nvidia (?:source code|software) license"])],
    "apsl": [(2, "apple", ["apple public source license(?: version)?(?: [12] [0-2])?"])],
    "zpl": [(2, "zope", ["zope public license(?: zpl)?(?: version)?(?: [12] [01])?"])],
    "tcl": [(3, "tcl", ["tcl tk license", "tcl license"])],
    "wxwindows": [(3, "wxwindows", ["wxwindows library licen[cs]e"])],
    "naist": [(3, "naist", ["naist license"])],
    "ftl": [(3, "freetype", ["freetype project license", "freetype license"])],
    "ijg": [(3, "independent", ["independent jpeg group"])],
    "proprietary": [(3, "rights", ["all rights reserved"]), (3, "proprietary", ["proprietary and confidential", "proprietary license", "proprietary software"]), (3, "confidential", ["confidential and proprietary"]), (3, "unauthorized", ["unauthorized (?:copying|reproduction|distribution) of this"])],
    "copyright": [(4, "copyright", ["copyright (?:c )?[12][0-9]{3}", "copyright notice", "copyright holders?"])],
    "warranty": [(4, "warranty", ["without warranty of any kind", "without any warranty without even the implied warranty"]), (4, "warranties", ["without warranties or conditions of any kind"])],
    "license-file": [(4, "license", ["see (?:the )?license (?:file|txt|md)", "license file for (?:details|the full)", "terms of the license"]), (4, "copying", ["see (?:the )?(?:file )?copying"])],
    "spdx": [(4, "spdx", ["spdx license identifier"])],
    "eula": [(3, "end", ["end user license agreement"]), (3, "eula", ["eula"])],
    "cla": [(4, "contributor", ["contributor license agreement"])],
    "dual": [(4, "dual", ["dual licen[cs]ed"])],
}
WEIGHT = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.3}


def rule_rows() -> list[tuple[int, int, str, str, str]]:
    """(rule, priority, label, keyword, pattern) in the order of the rules."""
    flat = chain.from_iterable(((p, label, k, x) for p, k, xs in groups for x in xs) for label, groups in RULES.items())
    return [(i, p, label, k, rf"(?<= ){x}(?= )") for i, (p, label, k, x) in enumerate(flat)]


def canonical(text: Column) -> Column:
    """Lower case; every run outside words becomes one space; a space at both ends.

    ``lower`` also maps letters outside A-Z, which neither makes nor breaks a
    word and gives none of the letters that the phrases consist of.
    """
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _nothing(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


PLACE = "struct<start: int, label: string>"
DETECTION = "struct<start: int, stop: int, priority: int, rule: int, label: string>"


def base_places(words: Column) -> Column:
    """array of (start, label): where a base phrase's words stand consecutively."""

    def label(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in BASE:
            same = w == phrase[0]
            for d in range(1, len(phrase)):
                same = same & (F.get(words, i + d) == phrase[d])
            out = F.when(same, F.lit(name)).otherwise(out)
        return F.struct(i.alias("start"), out.alias("label"))

    return F.filter(F.transform(words, label), lambda p: p["label"].isNotNull())


def rule_matches(canon: Column, rule: Column) -> Column:
    """Word intervals of one rule: its matches are marked, then found among the words."""
    marked = F.regexp_replace(canon, rule["pattern"], F.lit("\x01$0\x02"))
    words = F.split(F.trim(marked), " ")
    begins = lambda w: F.filter(F.transform(w, lambda x, i: F.when(x.startswith("\x01"), i)), lambda i: i.isNotNull())
    ends = lambda w: F.filter(F.transform(w, lambda x, i: F.when(x.endswith("\x02"), i + 1)), lambda i: i.isNotNull())
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("stop"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"))
    return F.when(F.rlike(canon, rule["pattern"]), let(words, lambda w: F.zip_with(begins(w), ends(w), pair))).otherwise(_nothing(DETECTION))


def unsuppressed(found: Column) -> Column:
    """Drops intervals inside a kept one of at least their priority.

    Longer intervals come first among those that start together, then higher
    priority (a lower number), then the earlier rule; so whatever contains an
    interval has come before it, and of equal ones the first rule stays. For
    each priority it is enough to know how far the kept intervals of that
    priority or a higher one reach.
    """
    order = sorted(WEIGHT)
    ordered = F.sort_array(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"))))
    start = F.struct(*(F.lit(-1).alias(f"reach{p}") for p in order), _nothing(DETECTION).alias("kept"))

    def step(a: Column, d: Column) -> Column:
        stop = -d["back"]
        one = F.struct(d["start"].alias("start"), stop.alias("stop"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"))
        reach = F.lit(-1)
        for p in order:
            reach = F.when(d["priority"] == p, a[f"reach{p}"]).otherwise(reach)
        wider = [F.when(d["priority"] <= p, F.greatest(stop, a[f"reach{p}"])).otherwise(a[f"reach{p}"]).alias(f"reach{p}") for p in order]
        return F.when(stop <= reach, a).otherwise(F.struct(*wider, F.concat(a["kept"], F.array(one)).alias("kept")))

    return F.aggregate(ordered, start, step)["kept"]


def scanned(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, ``n_words``, ``base`` places and ``detections`` of every whole text.

    Null and empty texts have no words. Texts are scanned whole, however long,
    and row by row, so repeated ones give equal results and an empty table
    none. Equal intervals of one priority: the earlier rule stays. Columns of
    ``docs`` beyond ``carry`` and text are ignored, whatever their names.
    """
    table = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern")) for i, p, label, k, x in rule_rows()))
    keywords = F.array(*(F.lit(k) for k in sorted({r[3] for r in rule_rows()} | {"license"})))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    looked = let(
        words(F.col("_canon")),
        lambda w: let(
            F.array_intersect(w, keywords),
            lambda k: F.struct(F.size(w).cast("long").alias("n_words"), k.alias("keywords"), F.when(F.array_contains(k, "license"), base_places(w)).otherwise(_nothing(PLACE)).alias("base")),
        ),
    )
    found = F.flatten(F.transform(F.filter(table, lambda r: F.array_contains("_keywords", r["keyword"])), lambda r: rule_matches(F.col("_canon"), r)))
    return (
        docs.select(*carry, canonical(text_or_empty()).alias("_canon"))
        .select(*carry, "_canon", looked.alias("_x"))
        .select(*carry, "_canon", F.col("_x.n_words").alias("n_words"), F.col("_x.keywords").alias("_keywords"), F.col("_x.base").alias("base"))
        .select(*carry, "n_words", "base", F.when(F.size("_keywords") > 0, unsuppressed(found)).otherwise(_nothing(DETECTION)).alias("detections"))
    )


def digests(docs: DataFrame) -> DataFrame:
    """Counts, labels and a score: the weight of the surest detection (base phrases count as names)."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.transform("base", lambda p: p["label"])
    weight = lambda d: F.element_at(F.create_map(*chain.from_iterable((F.lit(p), F.lit(w)) for p, w in WEIGHT.items())), d["priority"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("detections", weight)), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(WEIGHT[3])).otherwise(F.lit(0.0)))
    return scanned(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["start"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        best.alias("score"),
    )
