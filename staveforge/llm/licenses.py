"""License scan with ordered signature rules (operator 9): built-in functions only.

A text is brought to single-spaced words. One cheap pattern decides whether it can hold any signature; in those that
can, each rule whose keyword occurs is matched as a regular expression. Of overlapping detections, one that lies inside
another of the same or a higher priority is suppressed. All of this happens inside the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

# The phrases whose places are always counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License families as (label, names, versions). Names and versions are patterns over single-spaced
# lower-case words, in which punctuation has become a space.
FAMILIES = [
    ("gpl", ["gnu general public license", "gnu gpl", "gpl"], ["1 0", "2 0", "3 0", "2", "3"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"], ["2 0", "2 1", "3 0", "3"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "agpl"], ["1 0", "3 0", "3"]),
    ("gfdl", ["gnu free documentation license", "gfdl"], ["1 1", "1 2", "1 3"]),
    ("apache", ["apache software license", "apache license", "apache"], ["1 0", "1 1", "2 0", "2"]),
    ("mpl", ["mozilla public license", "mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public license", "epl"], ["1 0", "2 0"]),
    ("eupl", ["european union public licen[cs]e", "eupl"], ["1 0", "1 1", "1 2"]),
    ("cddl", ["common development and distribution license", "cddl"], ["1 0", "1 1"]),
    ("cpl", ["common public license"], ["1 0"]),
    ("ibmpl", ["ibm public license"], ["1 0"]),
    ("artistic", ["artistic license", "perl artistic license"], ["1 0", "2 0"]),
    ("afl", ["academic free license"], ["1 1", "2 1", "3 0"]),
    ("osl", ["open software license"], ["1 0", "2 1", "3 0"]),
    ("ofl", ["sil open font license", "open font license"], ["1 0", "1 1"]),
    ("bsl", ["boost software license"], ["1 0"]),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("isc", ["isc license", "internet systems consortium license"], []),
    ("mit", ["mit license", "expat license", "x11 license"], []),
    ("bsd", ["bsd license", "bsd 2 clause license", "bsd 3 clause license", "bsd 4 clause license", "simplified bsd license", "modified bsd license", "new bsd license"], []),
    ("unlicense", ["the unlicense"], []),
    ("wtfpl", ["wtfpl"], ["2"]),
    ("python", ["python software foundation license", "psf license"], ["2"]),
    ("php", ["php license"], ["3 0", "3 01"]),
    ("ruby", ["ruby license"], []),
    ("postgresql", ["postgresql license"], []),
    ("openssl", ["openssl license"], []),
    ("ms-pl", ["microsoft public license"], []),
    ("ms-rl", ["microsoft reciprocal license"], []),
    ("cecill", ["cecill free software license", "cecill"], ["1 0", "2 0", "2 1"]),
    ("odbl", ["open database license"], ["1 0"]),
    ("odc-by", ["open data commons attribution license"], ["1 0"]),
    ("pddl", ["public domain dedication and license"], ["1 0"]),
    ("sspl", ["server side public license"], ["1"]),
    ("busl", ["business source license"], ["1 0", "1 1"]),
    ("elastic", ["elastic license"], ["2 0"]),
    ("cc0", ["cc0", "creative commons zero", "creative commons cc0"], ["1 0"]),
    ("cc-by-nc-sa", ["cc by nc sa", "creative commons attribution non ?commercial share ?alike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", ["cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", ["cc by nc", "creative commons attribution non ?commercial"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", ["cc by sa", "creative commons attribution share ?alike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", ["cc by nd", "creative commons attribution no ?deriv(?:ative)?s"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", ["cc by", "creative commons attribution"], ["2 0", "2 5", "3 0", "4 0"]),
]

# Single signatures as (label, priority, keyword, pattern).
SINGLE = [
    ("mit", 3, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 3, "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 3, "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 2, "endorse or promote", "may be used to endorse or promote products derived from"),
    ("gpl", 3, "redistribute it and or modify it", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 3, "redistribute it and or modify it", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", 3, "redistribute it and or modify it", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache", 3, "apache org licenses", "www apache org licenses license 2 0"),
    ("gpl", 3, "gnu org licenses", "www gnu org licenses(?: old licenses)? gpl(?: [0-9] 0)?"),
    ("lgpl", 3, "gnu org licenses", "www gnu org licenses(?: old licenses)? lgpl(?: [0-9] [0-9])?"),
    ("mit", 3, "opensource org licenses", "opensource org licenses mit(?: license)?"),
    ("bsd", 3, "opensource org licenses", "opensource org licenses bsd(?: [0-9] clause| license)?"),
    ("mpl", 3, "mozilla org mpl", "mozilla org mpl(?: [0-9] [0-9])?"),
    ("zlib", 3, "provided as is without any express", "this software is provided as is without any express or implied warranty"),
    ("boost", 3, "boost org", "www boost org license 1 0 txt"),
    ("unlicense", 3, "unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("public-domain", 2, "public domain", "(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain"),
    ("public-domain", 1, "public domain", "public domain"),
    ("cc-by-nc-sa", 3, "creativecommons org licenses", "creativecommons org licenses by nc sa(?: [0-9] [0-9])?"),
    ("cc-by-nc-nd", 3, "creativecommons org licenses", "creativecommons org licenses by nc nd(?: [0-9] [0-9])?"),
    ("cc-by-nc", 3, "creativecommons org licenses", "creativecommons org licenses by nc(?: [0-9] [0-9])?"),
    ("cc-by-sa", 3, "creativecommons org licenses", "creativecommons org licenses by sa(?: [0-9] [0-9])?"),
    ("cc-by-nd", 3, "creativecommons org licenses", "creativecommons org licenses by nd(?: [0-9] [0-9])?"),
    ("cc-by", 3, "creativecommons org licenses", "creativecommons org licenses by(?: [0-9] [0-9])?"),
    ("cc0", 3, "creativecommons org publicdomain", "creativecommons org publicdomain zero(?: 1 0)?"),
    ("proprietary", 1, "all rights reserved", "all rights reserved"),
    ("proprietary", 2, "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("copyright", 0, "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
]

#: A text without any of these cannot hold a signature (a test holds every rule's matches against it and against the rule's keyword).
_GATE = r" (?:[al]?gpl|apache|artistic|affero|bsd|boost|cc|cc0|cddl|cecill|common |confidential|copyright|creative|creativecommons|eclipse|elastic|endorse|epl|eupl|european|expat|free|gfdl|gnu|ibm|internet|isc|business|academic|microsoft|mit|mozilla|mpl|odbl|open|openssl|opensource|permission|php|perl|postgresql|provided|psf|public|python|redistribution|ruby|server|sil|simplified|modified|new|spdx|the unlicense|unencumbered|wtfpl|x11|zlib|all rights) ?"
_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) in order: SPDX tags, notices and versions from FAMILIES, then SINGLE."""
    out = []
    for label, names, versions in FAMILIES:
        version = "(?:" + "|".join(sorted(versions, key=len, reverse=True)) + ")" if versions else ""
        out.append((label, 4, "spdx license identifier", f"spdx license identifier {label.replace('-', ' ')}(?: {version})?(?: only| or later)?" if version else f"spdx license identifier {label.replace('-', ' ')}(?: only| or later)?"))
        for name in names:
            key = name.split("[")[0].split(" ?")[0].split("(")[0].strip()
            out.append((label, 3, "licensed under", f"licensed under (?:the )?(?:terms of the )?{name}(?: version| v)?(?: {version})?" if version else f"licensed under (?:the )?(?:terms of the )?{name}"))
            if version:
                out.append((label, 2, key, f"{name}(?: version| v)? {version}"))
            out.append((label, 1, key, name))
    return [*out, *SINGLE]


def _rule_array() -> Column:
    parts = [F.struct(F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("keyword"), F.lit(f"(?<= )(?:{x})(?= )").alias("pattern")) for label, p, k, x in rules()]
    return F.array(*parts)


def normal(text: Column) -> Column:
    """Words of A-Z-lowered text, with one space before and after each; the Kelvin sign is no k here."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")))
    return F.concat(F.lit(" "), F.regexp_replace(low, f"[{_WORD}]+", " "), F.lit(" "))


def _count(norm: Column) -> Column:
    t = F.trim(norm)
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def _matches(norm: Column, pattern: Column, priority: Column, label: Column) -> Column:
    """Detections of one rule: character intervals of norm, in order."""
    between = F.split(norm, pattern)
    hits = F.regexp_extract_all(norm, pattern, F.lit(0))
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int,priority:int,label:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        own = F.struct(start.alias("start"), stop.alias("stop"), priority.alias("priority"), label.alias("label"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, state, step, lambda acc: acc["out"])


def detections(norm: Column) -> Column:
    """Every detection of the rules that norm's keywords let through, sorted by start, the longer and higher first."""
    gated = F.filter(_rule_array(), lambda r: F.contains(norm, r["keyword"]))
    found = F.flatten(F.transform(gated, lambda r: _matches(norm, r["pattern"], r["priority"], r["label"])))
    order = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("stop"), (-d["priority"]).alias("priority"), d["label"].alias("label")))
    return F.transform(F.array_sort(order), lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("stop"), (-d["priority"]).alias("priority"), d["label"].alias("label")))


def surviving(found: Column) -> Column:
    """Distinct (label, priority) of detections that lie inside no other of the same or a higher priority.

    One sweep in order of start: per priority the furthest stop so far; a detection that ends before the furthest stop of
    its own or a higher priority lies inside it.
    """
    levels = 5
    state = F.struct(F.array(*[F.lit(-1)] * levels).alias("far"), F.expr("cast(array() as array<struct<label:string,priority:int>>)").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        inside = F.exists(F.slice(acc["far"], d["priority"] + 1, levels), lambda x: x >= d["stop"])
        far = F.transform(acc["far"], lambda x, i: F.when(i == d["priority"], F.greatest(x, d["stop"])).otherwise(x))
        own = F.array(F.struct(d["label"].alias("label"), d["priority"].alias("priority")))
        return F.struct(F.when(inside, acc["far"]).otherwise(far).alias("far"), F.when(inside, acc["out"]).otherwise(F.array_union(acc["out"], own)).alias("out"))

    return F.aggregate(found, state, step, lambda acc: acc["out"])


def scan(docs: DataFrame, text_col: str = "text", out: str = "license") -> DataFrame:
    """docs with a struct out (an own column of that name is replaced): n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases are counted wherever their words stand consecutively; first_word and last_word are their smallest and
    largest start in words from 0, else null. labels are those of the base phrases found and of the rules' surviving
    detections. score is the strongest evidence: SPDX tag 1, notice or license text 0.9, versioned name 0.7, name 0.5,
    copyright line 0.2, none 0. Null and empty texts have zeros, null places and empty labels. Rows are independent.
    """
    kept = docs.drop(out)
    names = {x: free(kept, f"__{x}") for x in ("norm", "n", "base", "rules")}
    norm = F.col(names["norm"])
    base = None
    for phrase in BASE:
        base = F.contains(norm, F.lit(f" {phrase} ")) if base is None else base | F.contains(norm, F.lit(f" {phrase} "))
    places = []
    for phrase, label in BASE.items():
        cut = F.split(norm, f"(?<= ){phrase}(?= )")
        n = F.size(cut) - 1
        first = _count(cut[0])
        last = F.col(names["n"]) - _count(F.element_at(cut, -1)) - len(phrase.split())
        places.append(F.when(n > 0, F.struct(n.cast("long").alias("n"), first.alias("first"), last.alias("last"), F.lit(label).alias("label"))))
    empty = "cast(array() as array<struct<n:bigint,first:bigint,last:bigint,label:string>>)"
    seen = F.when(base, F.filter(F.array(*places), lambda x: x.isNotNull())).otherwise(F.expr(empty))
    ruled = F.when(F.rlike(norm, F.lit(_GATE)) & _any_keyword(norm), surviving(detections(norm))).otherwise(F.expr("cast(array() as array<struct<label:string,priority:int>>)"))
    rows = kept.withColumn(names["norm"], normal(F.col(text_col).cast("string"))).withColumn(names["n"], _count(norm)).withColumns({names["base"]: seen, names["rules"]: ruled})
    b, r = F.col(names["base"]), F.col(names["rules"])
    weight = F.element_at(F.array(*[F.lit(x) for x in (0.2, 0.5, 0.7, 0.9, 1.0)]), F.array_max(F.transform(r, lambda x: x["priority"])) + 1)
    info = F.struct(
        F.col(names["n"]).alias("n_words"), F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform(b, lambda x: x["first"])).alias("first_word"), F.array_max(F.transform(b, lambda x: x["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(b, lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.transform(b, lambda x: x["label"]), F.transform(r, lambda x: x["label"])))), ",").alias("labels"),
        F.when(F.size(r) > 0, weight).when(F.size(b) > 0, 0.5).otherwise(0.0).alias("score"),
    )
    return rows.withColumn(out, info).drop(*names.values())


def _any_keyword(norm: Column) -> Column:
    """Some rule's keyword occurs; evaluated only where the gate pattern has matched."""
    keys = sorted({k for _, _, k, _ in rules()})
    return F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(norm, k))
