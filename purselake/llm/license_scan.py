"""License scan by ordered signature rules (DataFrame functions only).

A rule is a regex over a text's words, written from a license family (its name
and short id) and a form ("licensed under the ...", "SPDX-License-Identifier:
..."). Families times forms make some three hundred ordered rules. A rule runs only in
texts that hold one of its own keywords as a word, and every text that the rule matches
holds one. Of overlapping detections the longer interval
suppresses what it contains, and otherwise the rule of higher priority stays.

Long texts are scanned in blocks of ``BLOCK`` characters that see ``REACH`` more on both
sides, more than any detection is long, and keep what starts in them; so the work is
linear in a text, however dense its detections.

Words are maximal runs of digits, a-z and non-ASCII characters after lower-casing
A-Z. Base phrases (MIT License, Apache License, General Public License) are
counted at every place, and their labels always stay.

Cases: a null or empty text has no words and no labels, score 0. Repeated rows
give repeated results. An empty table gives an empty result. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purselake.llm.common import documents_only, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_PHRASE = "(?<= )(?:mit|apache|general public) license(?= )"
BLOCK, REACH = 2000, 300

# Label, words of which each text of the name holds one, name, short id (whose
# first word gates the forms with it).
FAMILIES = [
    ("mit", "mit|expat", "(?:mit|expat) licen[cs]e", "mit"),
    ("mit-0", "mit", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("apache-1.1", "apache", "apache (?:software )?licen[cs]e (?:version |v ?)?1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?licen[cs]e(?: version| v)? ?2(?: 0)?", "apache 2 0"),
    ("apache", "apache", "apache (?:software )?licen[cs]e", "apache"),
    ("gpl-1.0", "general", "(?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general", "(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general", "(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "general", "(?:gnu )?general public licen[cs]e", "gpl"),
    ("gpl-short", "gpl|gpl1|gpl2|gpl3|gplv1|gplv2|gplv3", "(?:gnu )?gpl ?v?[123](?: 0)?(?: licen[cs]e)?", "gpl"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", "lgpl"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[cs]e(?:(?: version| v)? ?3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", "gfdl 1 [123]"),
    ("bsd-2-clause", "bsd|freebsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", "bsd 4 clause"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", "bsd"),
    ("0bsd", "zero", "zero clause bsd(?: licen[cs]e)?", "0bsd"),
    ("isc", "isc", "isc licen[cs]e", "isc"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "mpl"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?", "epl 2 0"),
    ("cddl-1.0", "cddl|distribution", "(?:common development and distribution licen[cs]e|cddl)(?: 1 0)?", "cddl 1 0"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?:(?: version| v)? ?1 2)?", "eupl 1 2"),
    ("cecill-2.1", "cecill", "cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?", "cecill 2 1"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e(?:(?: version| v)? ?2(?: 0)?)?", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost software licen[cs]e(?:(?: version| v)? ?1(?: 0)?)?", "bsl 1 0"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: licen[cs]e)?", "wtfpl"),
    ("python-2.0", "python", "python software foundation licen[cs]e", "python 2 0"),
    ("php-3.01", "php", "php licen[cs]e(?:(?: version| v)? ?3 01)?", "php 3 01"),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("ofl-1.1", "font", "(?:sil )?open font licen[cs]e(?:(?: version| v)? ?1 1)?", "ofl 1 1"),
    ("ncsa", "illinois", "university of illinois(?: ncsa)? open source licen[cs]e", "ncsa"),
    ("odbl-1.0", "database", "open (?:data commons open )?database licen[cs]e", "odbl 1 0"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "cc", "cc by(?: [1234] [05])?", "cc by(?: [1234] [05])?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1234] [05])?", "cc by sa [1234] [05]"),
    ("cc-by-nd", "cc", "cc by nd(?: [1234] [05])?", "cc by nd [1234] [05]"),
    ("cc-by-nc", "cc", "cc by nc(?: [1234] [05])?", "cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1234] [05])?", "cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1234] [05])?", "cc by nc nd [1234] [05]"),
    ("cc-by", "creative", "creative commons attribution(?: [1234] [05])?(?: international)?(?: licen[cs]e)?", "cc by"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1234] [05])?(?: international)?(?: licen[cs]e)?", "cc by sa"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1234] [05])?(?: international)?(?: licen[cs]e)?", "cc by nc"),
    ("public-domain", "domain", "(?:in|into|to) the public domain", "public domain"),
    ("proprietary", "proprietary", "proprietary licen[cs]e", "proprietary"),
]

# Priority (1 first), weight, form; {name} and {id} are filled in.
FORMS = [
    (1, 1.0, "spdx licen[cs]e identifier {id}"),
    (2, 0.95, "(?:licen[cs]ed|released|distributed|published|redistributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name}|{id})"),
    (3, 0.9, "(?:governed|covered) by (?:the )?(?:{name})"),
    (4, 0.8, "{name}"),
    (5, 0.7, "licen[cs]e {id}"),
    (6, 0.6, "{id} licen[cs]e(?:d)?"),
]


def signature_rules() -> list[tuple[int, str, list[str], str, float]]:
    """(rank, label, keywords, regex over ' words ', weight), in order of priority."""
    out = []
    for priority, weight, form in FORMS:
        for label, keywords, name, short in FAMILIES:
            regex = form.replace("{name}", name).replace("{id}", short)
            gate = keywords.split("|") * ("{name}" in form) + [short.split(" ")[0].split("(")[0]] * ("{id}" in form)
            out.append((priority, label, sorted(set(gate)), f"(?<= )(?:{regex})(?= )", weight))
    return [(rank, label.removesuffix("-short"), k, r, w) for rank, (_, label, k, r, w) in enumerate(out)]


def rule_table() -> Column:
    """The rules as one constant array of structs."""
    names = ("rank", "label", "keywords", "regex", "weight")
    return F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(n) for n, v in zip(names, rule)]) for rule in signature_rules()])


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


# Intervals of one rule in a block's text: the marked text is cut at the marks, and every
# second part is a match.
_INTERVALS = r"""
flatten(transform(
  filter(rules, r -> arrays_overlap(present, r.keywords)),
  r -> aggregate(
    split(regexp_replace(block.text, r.regex, '\u0001$0\u0002'), '[\u0001\u0002]'),
    named_struct('at', 0, 'k', 0, 'found', cast(array() as array<struct<start:int,stop:int,rank:int,label:string,weight:double>>)),
    (a, p) -> named_struct('at', a.at + length(p), 'k', a.k + 1, 'found',
      if(a.k % 2 = 1, array_append(a.found, named_struct('start', a.at, 'stop', a.at + length(p), 'rank', r.rank, 'label', r.label, 'weight', r.weight)), a.found)),
    a -> a.found)))
"""

_UNSUPPRESSED = """
filter(found, d -> not exists(found, e ->
  (e.start <= d.start and e.stop >= d.stop and (e.stop - e.start > d.stop - d.start or e.rank < d.rank))
  or (e.start < d.stop and d.start < e.stop and e.rank < d.rank
      and not (d.start <= e.start and d.stop >= e.stop))))
"""

_BLOCKS = f"""
transform(sequence(0, cast((length(words) - 1) div {BLOCK} as int)), i ->
  named_struct('own', i * {BLOCK}, 'base', greatest(i * {BLOCK} - {REACH}, 0),
    'text', substring(words, greatest(i * {BLOCK} - {REACH}, 0) + 1, {BLOCK + REACH} + i * {BLOCK} - greatest(i * {BLOCK} - {REACH}, 0))))
"""

# What starts in a block's own part, by character of the whole text.
_DETECTIONS = f"""
flatten(transform({_BLOCKS}, block -> transform(
  filter(
    element_at(transform(array({_INTERVALS}), found -> {_UNSUPPRESSED}), 1),
    d -> d.start + block.base >= block.own and d.start + block.base < block.own + {BLOCK}),
  d -> named_struct('start', d.start + block.base, 'stop', d.stop + block.base, 'rank', d.rank, 'label', d.label, 'weight', d.weight))))
"""


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base counts and places, labels, score, and ``detections``:
    (start, stop, rank, label, weight) by character of the text's joined words."""
    low = documents_only(docs).select("doc_id", F.translate("text", UPPER, LOWER).alias("low"))
    spaced = low.select("doc_id", F.concat(F.lit(" "), F.trim(F.regexp_replace("low", NOT_WORD, " ")), F.lit(" ")).alias("words"))
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in signature_rules() for k in r[2]})])
    present = F.array_intersect(F.split("words", " "), keywords)
    gated = spaced.select("doc_id", F.when(F.col("words") == "  ", F.lit(0)).otherwise(spaces(F.col("words")) - 1).cast("long").alias("n_words"), "words", present.alias("present"))
    parts = gated.select("*", F.split("words", BASE_PHRASE, -1).alias("parts"), F.when(F.size("present") > 0, rule_table()).alias("rules"))
    found = parts.select("*", F.when(F.size("present") > 0, F.expr(_DETECTIONS)).alias("found")).drop("rules")
    last = F.element_at("parts", -1)
    before_last = F.col("n_words") - (spaces(last) - 1)
    ends_long = F.endswith(F.expr("left(words, length(words) - length(element_at(parts, -1)))"), F.lit(" general public license"))
    kept = found.select(
        "doc_id",
        "n_words",
        "words",
        F.coalesce((F.size("parts") - 1).cast("long"), F.lit(0).cast("long")).alias("n_base"),
        F.when(F.size("parts") > 1, (spaces(F.element_at("parts", 1)) - 1).cast("long")).alias("first_word"),
        F.when(F.size("parts") > 1, (before_last - F.when(ends_long, 3).otherwise(2)).cast("long")).alias("last_word"),
        F.coalesce("found", F.expr("cast(array() as array<struct<start:int,stop:int,rank:int,label:string,weight:double>>)")).alias("detections"),
    )
    base = F.array_compact(
        F.array(*[F.when(F.contains("words", F.lit(f" {p} license ")), F.lit(x)) for p, x in (("apache", "apache"), ("general public", "gpl"), ("mit", "mit"))])
    )
    labelled = kept.withColumn("base", base)
    return labelled.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("detections", lambda d: d["label"]))), ",").alias("labels"),
        F.greatest(
            F.when(F.size("base") > 0, F.lit(0.75)).otherwise(F.lit(0.0)),
            F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)),
        ).alias("score"),
        "detections",
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
