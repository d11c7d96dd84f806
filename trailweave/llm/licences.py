"""Licence scans by sentence rules; DataFrame functions only.

Method: a text is cut into pieces (at line ends and at sentence marks before white
space) and each is normalised: A-Z lower-cased, everything but letters and digits is
one space.  A sentence is a piece, or several pieces that only line ends part: not
sentence marks, and not lines without letters and digits.  Known sentences are mapped to
their identifiers, in order, of those that overlap the first and of those that begin
together the longest; all others are left out.  Then the rules are tried in their order on the
identifier sequence: a rule fits where its identifiers stand one after the other, and
takes them away, so a later, shorter rule can't count them again.

The scan is a projection: no shuffle, one row out for each row in, whatever the sizes
of groups or sources.  The tables of sentences and rules are parameters that the caller
holds; in the plan they are a hashed set of sentences, and a table that only known ones
are looked up in.

Defined cases: null or empty text has no identifiers and no licences; a sentence may be
wrapped over lines anywhere between two words; the holder's name in the third BSD
condition may be any (``NAMED``); repeated rows give repeated results; an
empty table gives an empty table; other columns pass through, and columns named like the
results are replaced.  Sentences of one text that overlap are taken from left to right,
the longer first, so ties can't occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import others, pick

#: Known sentences in normal form, and their identifiers.
SENTENCES = {
    "released under the mit license": "MIT_REF",
    "licensed under the mit license": "MIT_REF",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MIT_GRANT",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied": "AS_IS",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AS_IS",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement": "AS_IS",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability": "NO_LIABILITY",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "NO_LIABILITY",
    "licensed under the apache license version 2 0": "APACHE_2_REF",
    "licensed under the apache license version 2 0 the license": "APACHE_2_REF",
    "you may not use this file except in compliance with the license": "APACHE_COMPLY",
    "you may obtain a copy of the license at": "APACHE_COPY",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "APACHE_COPY",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "APACHE_COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "APACHE_AS_IS",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE_AS_IS",
    "this work is licensed under the gnu general public license version 3": "GPL_3_REF",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3": "GPL_3_GRANT",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPL_GRANT",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL_3_LATER_GRANT",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "GPL_3_ONLY_GRANT",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "GPL_3_ONLY_GRANT",
    "either version 3 of the license or at your option any later version": "GPL_3_LATER",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPL_HOPE",
    "licensed under cc by nc 4 0": "CC_BY_NC_4_REF",
    "licensed under cc by 4 0": "CC_BY_4_REF",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CC_BY_NC_4_REF",
    "this work is licensed under the creative commons attribution noncommercial 4 0 international license": "CC_BY_NC_4_REF",
    "this work is licensed under a creative commons attribution 4 0 international license": "CC_BY_4_REF",
    "this work is licensed under the creative commons attribution 4 0 international license": "CC_BY_4_REF",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice": "BSD_SOURCE",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice": "BSD_BINARY",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "BSD_NAMES",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_NAMES",
}
#: The same for short licences and references of other families.
SENTENCES |= {
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC_AS_IS",
    "this source code form is subject to the terms of the mozilla public license v": "MPL_REF",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL_2_COPY",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL_2_COPY",
    "this is free and unencumbered software released into the public domain": "UNLICENSE_REF",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UNLICENSE_GRANT",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0_GRANT",
    "licensed under cc0 1 0": "CC0_REF",
    "licensed under cc by sa 4 0": "CC_BY_SA_4_REF",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CC_BY_SA_4_REF",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": "CC_BY_SA_4_REF",
    "this library is distributed in the hope that it will be useful but without any warranty": "GPL_HOPE",
}

#: GNU licences besides GPL-3.0: short name, full name, version as licences name it and as texts do.
GNU = [("GPL", "general public license", "2.0", "2"), ("LGPL", "lesser general public license", "2.1", "2 1"), ("LGPL", "lesser general public license", "3.0", "3"), ("AGPL", "affero general public license", "3.0", "3")]


def _gnu() -> list[tuple[str, list[str]]]:
    """Adds the sentences of the GNU licences, which differ in their names and versions alone, and gives their rules."""
    rules = []
    for short, name, version, said in GNU:
        v, later = version[0] if version.endswith(".0") else version.replace(".", "_"), f"either version {said} of the license or at your option any later version"
        grant = f"you can redistribute it and or modify it under the terms of the gnu {name}"
        published = "as published by the free software foundation"
        SENTENCES.update({f"{grant} {published}": f"{short}_GRANT", f"{grant} {published} {later}": f"{short}_{v}_LATER_GRANT", later: f"GPL_{v}_LATER"})
        SENTENCES.update({f"{grant} {form}": f"{short}_{v}_ONLY_GRANT" for form in (f"version {said} {published}", f"{published} version {said}", f"{published} version {said} of the license")})
        rules += [(f"{short}-{version}-{kind}", ids + more) for more in (["GPL_HOPE"], []) for kind, ids in (("or-later", [f"{short}_GRANT", f"GPL_{v}_LATER"]), ("or-later", [f"{short}_{v}_LATER_GRANT"]), ("only", [f"{short}_{v}_ONLY_GRANT"]))]
    return sorted(rules, key=lambda r: -len(r[1]))


#: Rules in the order in which they are tried.
RULES = [
    ("Apache-2.0", ["APACHE_2_REF", "APACHE_COMPLY", "APACHE_COPY", "APACHE_AS_IS"]),
    ("GPL-3.0-or-later", ["GPL_3_GRANT", "GPL_3_LATER", "GPL_HOPE"]),
    ("GPL-3.0-or-later", ["GPL_3_GRANT", "GPL_3_LATER"]),
    ("GPL-3.0-or-later", ["GPL_GRANT", "GPL_3_LATER", "GPL_HOPE"]),
    ("GPL-3.0-or-later", ["GPL_GRANT", "GPL_3_LATER"]),
    ("GPL-3.0-or-later", ["GPL_3_LATER_GRANT", "GPL_HOPE"]),
    ("GPL-3.0-or-later", ["GPL_3_LATER_GRANT"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "AS_IS", "NO_LIABILITY"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE"]),
    ("Apache-2.0", ["APACHE_2_REF"]),
    ("GPL-3.0-only", ["GPL_3_ONLY_GRANT", "GPL_HOPE"]),
    ("GPL-3.0-only", ["GPL_3_ONLY_GRANT"]),
    ("GPL-3.0-only", ["GPL_3_GRANT"]),
    ("GPL-3.0-only", ["GPL_3_REF"]),
    ("MIT", ["MIT_REF"]),
    ("CC-BY-NC-4.0", ["CC_BY_NC_4_REF"]),
    ("CC-BY-4.0", ["CC_BY_4_REF"]),
    ("ISC", ["ISC_GRANT", "ISC_AS_IS"]),
    ("MPL-2.0", ["MPL_REF", "MPL_2_COPY"]),
    ("Unlicense", ["UNLICENSE_REF", "UNLICENSE_GRANT"]),
    ("Unlicense", ["UNLICENSE_REF"]),
    ("CC0-1.0", ["CC0_GRANT"]),
    ("CC0-1.0", ["CC0_REF"]),
    ("CC-BY-SA-4.0", ["CC_BY_SA_4_REF"]),
    *_gnu(),
]

#: Where a sentence holds a name: its beginning, the pattern of the name with what stands around it, and the form under which it is known.
NAMED = [("neither the name of ", "^neither the name of .+ nor the names of (its|their|any) contributors ", "neither the name of the copyright holder nor the names of its contributors ")]

#: A sentence may be this many pieces longer than the known one it stands for, by a name in it.
NAME_WORDS = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(text: Column) -> Column:
    """The normalised pieces of a text, in order; where not only a line end parts two of them, an empty one stands between them."""
    marked = F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[.!?:;]+(?=\s|$)", "\u0001\u0001")
    plain = F.regexp_replace(F.translate(marked, "\n", "\u0001"), "[^\\p{L}\\p{N}\u0001]+", " ")
    return F.transform(F.split(plain, " ?\u0001 ?", -1), lambda s: F.trim(s))


def _filled(sentence: Column) -> Column:
    for begin, pattern, form in NAMED:
        sentence = F.when(F.startswith(sentence, F.lit(begin)), F.regexp_replace(sentence, pattern, form)).otherwise(sentence)
    return sentence


def scan(docs: DataFrame, text: str = "text", known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """``docs`` with ``sentence_ids`` (array), ``licences`` (array, each once, in the rules' order) and ``unmatched`` (identifiers no rule took)."""
    own = others(docs, "sentence_ids", "licences", "unmatched")
    plain = [f"own{i}" for i in range(len(own))]
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    words = [k.split() for k in known]
    heads = sorted({" ".join(w[:n]) for w in words for n in (1, 2, 3)})  # a piece that begins a known sentence begins with one of these, or is one
    longest = max([len(w) for w in words], default=1) + NAME_WORDS  # pieces of a sentence have a word each; a name may have some more
    cut = docs.select(*[c.alias(n) for c, n in zip(pick(own), plain, strict=True)], pieces(F.coalesce(F.col(text), F.lit(""))).alias("pieces"))
    begins = F.filter(F.transform("pieces", lambda s, i: F.when(F.substring_index(s, " ", 3).isin(heads), i + 1)), lambda i: i.isNotNull())
    cut = cut.withColumn("runs", F.transform(begins, lambda i: F.struct(i.alias("at"), F.slice("pieces", i, longest).alias("run"))))
    size = lambda r: F.when(F.array_contains(r["run"], ""), F.array_position(r["run"], "") - 1).otherwise(F.size(r["run"])).cast("int")
    spans = lambda r: F.transform(F.sequence(size(r), F.lit(1), F.lit(-1)), lambda n: F.struct(r["at"].alias("at"), (r["at"] + n).alias("next"), _filled(F.array_join(F.slice(r["run"], 1, n), " ")).alias("s")))
    cut = cut.withColumn("hits", F.filter(F.flatten(F.transform("runs", spans)), lambda x: x["s"].isin(list(known))))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("ids"))
    take = lambda a, x: F.when(x["at"] >= a["next"], F.struct(x["next"].alias("next"), F.concat(a["ids"], F.array(F.element_at(table, x["s"]))).alias("ids"))).otherwise(a)
    named = cut.select(*plain, F.aggregate("hits", start, take, lambda a: a["ids"]).alias("ids"))
    names = set(known.values())
    named = named.withColumn("left", F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    found = []
    for n, (licence, ids) in enumerate(rules):
        if not set(ids) <= names:
            raise ValueError(f"{licence}: a rule names an unknown sentence")
        pattern = "".join(f"<{i}>" for i in ids)
        named = named.withColumns({f"hit{n}": F.when(F.contains("left", F.lit(pattern)), F.lit(licence)), "left": F.replace("left", F.lit(pattern), F.lit("|"))})
        found.append(F.col(f"hit{n}"))
    results = "ids", F.array_distinct(F.array_compact(F.array(*found).cast("array<string>"))), F.regexp_extract_all("left", F.lit("<([^>]+)>"), 1)
    return named.select(*plain, *results).toDF(*own, "sentence_ids", "licences", "unmatched")
