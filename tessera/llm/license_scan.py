"""License scans by sentence rules.

A text is cut into sentences (at blank lines and after ``.``, ``!``, ``?`` or ``;`` before white space; a line of
marks alone is blank), each is normalised (lower case, every run of other characters than letters and digits becomes
one space, or one line feed where a line ends), and known sentences get identifiers:

* a sentence whose words never change is looked up in a table (``EXACT``) by its normalised form, from the start of
  any of its lines to its end, so hard-wrapped and commented texts are read like unwrapped ones and lines without a stop
  may stand before;
* one with variable parts (``SENTENCES``) is told by a pattern, from the start of a line to the end of the same line
  or a later one, so a known line without a stop (an SPDX tag, a copyright line) is found between other lines.

Rules are ordered sequences of identifiers: a rule matches where its identifiers stand one after another among the
text's known sentences, whatever other sentences stand between. Longer rules are tried first and each known sentence
serves one rule only. Reserved rights are a finding only where no licence is: most licences stand under such a line.
Sentences of the GPL family name no version by themselves; a rule needs the one that says it.

The tables are a fixed list of bounded size and travels inside the plan, so texts are read once and
nothing is shuffled. Null texts count as empty; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .expressions import let

# One letter for each known sentence, and a pattern for its normalised form.
SENTENCES = {
    "A": r"licensed under the apache license version 2 0( the license)?",
    "B": r"you may not use this file except in compliance with the license",
    "C": r"you may obtain a copy of the license at( http www apache org licenses license 2 0)?",
    "D": r"(released|licensed|distributed) under the (terms of the )?mit license|license mit|spdx license identifier mit",
    "E": r"permission is hereby granted free of charge to any person obtaining a copy .*",
    "F": r"the above copyright notice and this permission notice shall be included in all copies .*",
    "G": r"the software is provided as is without warranty of any kind .*",
    "H": r"this work is licensed under the gnu general public license version 3|spdx license identifier gpl 3 0( only| or later)?",
    "I": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license (as published by the free software foundation )?(either )?version 3( .*)?",
    "J": r"at your option any later version",
    "K": r"licensed under cc by nc 4 0",
    "L": r"licensed under cc by( sa)? 4 0",
    "M": r"all rights reserved",
    "N": r"copyright( c)? [0-9]{4}.*|c [0-9]{4} .*",
    "O": r"redistribution and use in source and binary forms with or without modification are permitted .*",
    "P": r"neither the name .* may be used to endorse or promote products .*",
    "Q": r"this is free and unencumbered software released into the public domain",
    "R": r"spdx license identifier apache 2 0",
    "S": r"spdx license identifier bsd 3 clause",
    "T": r"spdx license identifier bsd 2 clause",
    "U": r"spdx license identifier isc",
    "V": r"spdx license identifier mpl 2 0",
    "W": r"spdx license identifier gpl 2 0( only| or later)?",
    "X": r"spdx license identifier lgpl 2 1( only| or later)?",
    "Y": r"spdx license identifier lgpl 3 0( only| or later)?",
    "Z": r"spdx license identifier agpl 3 0( only| or later)?",
    "2": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license (as published by the free software foundation )?(either )?version 2( .*)?",
    "4": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license( as published by the free software foundation)?",
    "5": r"(this work is |this file is |this program is )?(licensed|distributed|released) under the (terms of the )?gnu general public license version 2( .*)?",
    "7": r"either version 3 of the license or at your option any later version",
    "6": r"(either |only )?version 2 of the license( only)?",
}
_REDISTRIBUTE = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
# Sentences whose words never change, by one letter each; some have a second wording.
EXACT = {
    "a": (_REDISTRIBUTE.format("general public license"),),
    "s": (_REDISTRIBUTE.format("general public license version 2"), f"this program is free software {_REDISTRIBUTE.format('general public license version 2')}"),
    "b": ("either version 2 of the license or at your option any later version",),
    "c": (_REDISTRIBUTE.format("lesser general public license"),),
    "d": ("either version 2 1 of the license or at your option any later version",),
    "e": (f"this program is free software {_REDISTRIBUTE.format('affero general public license')} either version 3 of the license or at your option any later version",),
    "f": (
        f"this program is free software {_REDISTRIBUTE.format('lesser general public license')} either version 3 of the license or at your option any later version",
        f"this library is free software {_REDISTRIBUTE.format('lesser general public license')} either version 3 of the license or at your option any later version",
    ),
    "g": ("gnu general public license version 3 29 june 2007",),
    "h": ("gnu general public license version 2 june 1991",),
    "i": ("gnu lesser general public license version 3 29 june 2007",),
    "j": ("gnu lesser general public license version 2 1 february 1999",),
    "k": ("gnu affero general public license version 3 19 november 2007",),
    "l": ("this source code form is subject to the terms of the mozilla public license v",),
    "m": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    "n": ("mozilla public license version 2 0",),
    "o": ("apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004"),
    "p": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "q": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "r": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "t": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "u": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "v": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "w": ("this software is provided as is without any express or implied warranty",),
    "x": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "eclipse public license v 2 0"),
    "y": ("this work is licensed under a creative commons attribution 4 0 international license",),
}
#: Lines that a known sentence may be wrapped into.
MOST_LINES = 40
# Ordered rules; the first of equal length wins.
RULES = (
    ("apache-2.0", "ABC"),
    ("bsd-3-clause", "OqrP"),
    ("mit", "EFG"),
    ("bsd-2-clause", "Oqr"),
    ("bsd-3-clause", "OP"),
    ("gpl-3.0", "IJ"),
    ("gpl-3.0", "47"),
    ("gpl-3.0", "a7"),
    ("gpl-2.0", "4b"),
    ("gpl-2.0", "ab"),
    ("gpl-2.0", "46"),
    ("gpl-2.0", "a6"),
    ("lgpl-2.1", "cd"),
    ("mpl-2.0", "lm"),
    ("zlib", "wv"),
    ("apache-2.0", "AB"),
    ("mit", "EG"),
    ("proprietary", "NM"),
    ("apache-2.0", "A"),
    ("apache-2.0", "R"),
    ("mit", "D"),
    ("mit", "E"),
    ("gpl-3.0", "H"),
    ("gpl-3.0", "I"),
    ("cc-by-nc-4.0", "K"),
    ("cc-by-4.0", "L"),
    ("bsd-3-clause", "S"),
    ("bsd-2-clause", "O"),
    ("unlicense", "Q"),
    ("apache-2.0", "o"),
    ("bsd-2-clause", "T"),
    ("isc", "t"),
    ("isc", "U"),
    ("mpl-2.0", "l"),
    ("mpl-2.0", "m"),
    ("mpl-2.0", "n"),
    ("mpl-2.0", "V"),
    ("gpl-3.0", "g"),
    ("gpl-2.0", "h"),
    ("gpl-2.0", "W"),
    ("gpl-2.0", "2"),
    ("gpl-2.0", "5"),
    ("gpl-2.0", "s"),
    ("lgpl-3.0", "f"),
    ("lgpl-3.0", "i"),
    ("lgpl-3.0", "Y"),
    ("lgpl-2.1", "j"),
    ("lgpl-2.1", "X"),
    ("agpl-3.0", "e"),
    ("agpl-3.0", "k"),
    ("agpl-3.0", "Z"),
    ("bsl-1.0", "u"),
    ("zlib", "v"),
    ("epl-2.0", "x"),
    ("cc-by-4.0", "y"),
    ("proprietary", "M"),
)
#: Rights reserved say nothing where a licence stands: this name goes if there is another.
RESERVED = "proprietary"
#: A sentence without any of these words is none of the table's.
HINT = r"(?i)licen[sc]|permission|copyright|warrant|redistribut|rights|copies|unencumbered|endorse|later[^\p{L}\p{N}]+version|\(c\)|\bmpl\b"


def loosened(name: str) -> str:
    """A sentence's pattern: what follows the known words may be missing, except for the year and holder of N."""
    return re.sub(r" \.\*$", "( .*)?", SENTENCES[name]) if name != "N" else SENTENCES[name]


def wrapped(name: str) -> str:
    """The same with a line feed allowed for each space; a rest stays in its line, so that the next line is looked at too."""
    return loosened(name).replace(" .* ", " (?s:.*?) ").replace(" .*", "\0.*").replace(" ", r"[ \n]").replace("\0", " ")


#: All known sentences, from a line's start to a line's end.
KNOWN = "(?m)^(?:" + "|".join(wrapped(name) for name in SENTENCES) + ")$"


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?;])\s+|\n(?:[^\p{L}\p{N}\n]*\n)+", -1)


def normalised(sentence: Column) -> Column:
    """Words with one space between them, or one line feed where a line ends."""
    words = F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}\n]+", " ")
    return F.btrim(F.regexp_replace(words, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def identifier(sentence: Column) -> Column:
    """The letter of a normalised sentence, null if it isn't known."""
    out = F.lit(None).cast("string")
    for name in reversed(SENTENCES):
        out = F.when(sentence.rlike(f"^(?:{loosened(name)})$"), F.lit(name)).otherwise(out)
    return out


def _by_patterns(sentence: Column) -> Column:
    found = F.regexp_extract_all(sentence, F.lit(KNOWN), F.lit(0))
    return F.array_compact(F.transform(found, lambda s: identifier(F.translate(s, "\n", " "))))


def identifiers(sentence: Column) -> Column:
    """The letters of a normalised sentence: the table's from some line to the end, patterns' before or instead."""
    table = F.create_map(*[F.lit(x) for name, wordings in EXACT.items() for wording in wordings for x in (wording, name)])

    def looked_up(lines: Column) -> Column:
        starts = F.sequence(F.greatest(F.size(lines) - MOST_LINES + 1, F.lit(1)), F.size(lines))
        ends = F.transform(starts, lambda i: F.struct(i.alias("at"), F.try_element_at(table, F.array_join(F.slice(lines, i, F.size(lines)), " ")).alias("name")))
        before = lambda hit: F.array_join(F.slice(lines, F.lit(1), hit["at"] - 1), "\n")
        return let(F.get(F.filter(ends, lambda x: x["name"].isNotNull()), F.lit(0)), lambda hit: F.when(hit.isNull(), _by_patterns(sentence)).otherwise(F.concat(_by_patterns(before(hit)), F.array(hit["name"]))))

    return let(F.split(sentence, "\n", -1), looked_up)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, sentence_ids (the known ones in order), licenses (sorted, distinct), n_rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hinted = F.filter(sentences(text), lambda s: s.rlike(HINT))
    known = F.flatten(F.transform(F.transform(hinted, normalised), identifiers))
    rows = docs.select(F.col(id_col).alias("id"), F.when(text.rlike(HINT), F.array_join(known, "")).otherwise(F.lit("")).alias("sentence_ids"))
    longest_first = sorted(dict.fromkeys(sequence for _, sequence in RULES), key=len, reverse=True)
    names = F.create_map(*[F.lit(x) for name, sequence in reversed(RULES) for x in (sequence, name)])
    # an alternation with the longest rules first takes each sentence for one rule, from left to right
    hits = F.transform(F.regexp_extract_all("sentence_ids", F.lit("|".join(longest_first)), F.lit(0)), lambda x: F.element_at(names, x))
    named = rows.select("id", "sentence_ids", hits.alias("_hits"))
    licensed = F.filter("_hits", lambda x: x != RESERVED)
    said = F.when(F.size(licensed) > 0, licensed).otherwise(F.col("_hits"))
    return named.select("id", "sentence_ids", F.array_sort(F.array_distinct(said)).alias("licenses"), F.size(said).cast("long").alias("n_rules"))
