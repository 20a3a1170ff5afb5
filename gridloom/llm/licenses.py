"""License scan: ordered signature rules over normalised words, in DataFrame functions only.

A text is lower-cased (A-Z) and reduced to its words, one space between them.  All keywords decide first whether a
text can match at all, then each family's keyword decides which rules are tried.  A rule is a regular expression with
a priority; its matches are intervals of the normalised text.  Intervals are sorted by start, then longest, then
priority; one that lies inside an earlier one is suppressed, so "gnu lesser general public license version 3" doesn't also
report the shorter "general public license".  Everything happens inside the row: no join, no shuffle, no Python.

Defined results: null or empty text has no words, no labels and score 0.  Rows are independent: repeated rows get
equal results; extra columns are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License families as label, keywords of which one stands in each match (at a word's start), pattern of the name after normalisation.
FAMILIES = (
    ("mit", "mit", r"(?:the )?mit"),
    ("mit-0", "mit", r"mit (?:no attribution|0)"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("bsd-0-clause", "bsd|0bsd", r"(?:0bsd|bsd 0 clause|zero clause bsd)"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("gpl-1", "gpl|general public", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?1(?: 0)?"),
    ("gpl-2", "gpl|general public", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gpl|general public", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)?"),
    ("gpl", "gpl|general public", r"(?:gnu )?(?:gpl|general public)"),
    ("lgpl-2", "lgpl|lesser|library", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license)(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", "lgpl|lesser", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?2 1"),
    ("lgpl-3", "lgpl|lesser", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)?"),
    ("lgpl", "lgpl|lesser", r"(?:gnu )?(?:lgpl|lesser general public)"),
    ("agpl-3", "agpl|affero", r"(?:gnu )?(?:agpl|affero general public license)(?: version| v)? ?3(?: 0)?"),
    ("agpl", "agpl|affero", r"(?:gnu )?(?:agpl|affero general public)"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation"),
    ("mpl-1.1", "mpl|mozilla", r"(?:mpl|mozilla public license)(?: version| v)? 1 1"),
    ("mpl-2", "mpl|mozilla", r"(?:mpl|mozilla public license)(?: version| v)? ?2(?: 0)?"),
    ("mpl", "mpl|mozilla", r"(?:mpl|mozilla public)"),
    ("epl-1", "epl|eclipse", r"(?:epl|eclipse public license)(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "epl|eclipse", r"(?:epl|eclipse public license)(?: version| v)? ?2(?: 0)?"),
    ("cddl-1", "cddl|common development", r"(?:cddl|common development and distribution license)(?: version| v)?(?: 1 [01])?"),
    ("cpl-1", "common public", r"common public"),
    ("ipl-1", "ibm public", r"ibm public"),
    ("cc0", "cc0|cc zero|creative commons", r"(?:cc0|cc zero|creative commons zero)"),
    ("cc-by-nc-nd", "cc by|cc attribution|creative commons", r"(?:cc|creative commons) (?:by nc nd|attribution noncommercial noderiv\w*|attribution non commercial no deriv\w*)"),
    ("cc-by-nc-sa", "cc by|cc attribution|creative commons", r"(?:cc|creative commons) (?:by nc sa|attribution noncommercial sharealike|attribution non commercial share alike)"),
    ("cc-by-nc", "cc by|cc attribution|creative commons", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)"),
    ("cc-by-nd", "cc by|cc attribution|creative commons", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv\w*)"),
    ("cc-by-sa", "cc by|cc attribution|creative commons", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)"),
    ("cc-by", "cc by|cc attribution|creative commons", r"(?:cc|creative commons) (?:by|attribution)"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("bsl-1", "boost", r"boost(?: software)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl|do what", r"(?:wtfpl|do what the fuck you want to public)"),
    ("artistic-1", "artistic", r"artistic(?: license)? 1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic(?: license)? 2(?: 0)?"),
    ("artistic", "artistic", r"artistic"),
    ("eupl-1.2", "eupl|european union", r"(?:eupl|european union public license)(?: version| v)? 1 2"),
    ("eupl", "eupl|european union", r"(?:eupl|european union public)"),
    ("ofl-1.1", "ofl|open font|sil open", r"(?:ofl|sil open font license|open font license)(?: version| v)?(?: 1 1)?"),
    ("psf-2", "psf|python", r"(?:psf|python software foundation|python)"),
    ("php-3", "php license", r"php license(?: version| v)? ?3(?: 01?)?"),
    ("ruby", "ruby", r"ruby"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ms-pl", "ms pl|microsoft public", r"(?:ms pl|microsoft public)"),
    ("ms-rl", "ms rl|microsoft reciprocal", r"(?:ms rl|microsoft reciprocal)"),
    ("cecill", "cecill", r"cecill(?: [bc])?"),
    ("osl-3", "osl|open software", r"(?:osl|open software license) 3(?: 0)?"),
    ("afl-3", "afl|academic free", r"(?:afl|academic free license) 3(?: 0)?"),
    ("x11", "x11", r"x11"),
    ("zpl", "zpl|zope", r"(?:zpl|zope public)"),
    ("ncsa", "ncsa|university of illinois", r"(?:ncsa|university of illinois ncsa)"),
    ("w3c", "w3c", r"w3c(?: software)?"),
    ("odbl", "odbl|open database", r"(?:odbl|open database)"),
    ("vim", "vim", r"vim"),
    ("openssl", "openssl", r"openssl"),
)

# Sentence forms as priority and pattern; {} is a family's name.
FORMS = (
    (95, r"spdx license identifier {}"),
    (90, r"(?:is |are |be )?licen[sc]ed (?:to you )?under (?:the )?(?:terms of (?:the )?)?{}(?: licen[sc]e)?(?: version)?(?: v?\d+(?: \d+)?)?"),
    (85, r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[sc]e)?(?: version)?(?: v?\d+(?: \d+)?)?"),
    (80, r"under (?:the )?(?:terms of (?:the )?)?{} licen[sc]e(?: version)?(?: v?\d+(?: \d+)?)?"),
    (70, r"{} licen[sc]e(?: version)?(?: v?\d+(?: \d+)?)?"),
    (60, r"licen[sc]e (?:is |type )?{}"),
)
#: Families whose name without a version means other things too: a bare name is no detection.
AMBIGUOUS = ("bsl-1", "cpl-1", "ipl-1", "psf-2", "x11")
#: Families whose bare name is a detection (lowest priority); names with a version are too.
BARE = ("cc0", "cc-by", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "unlicense", "wtfpl")
#: One of these, at a word's start, stands in every normalised text that any rule or base phrase matches.
GATE = tuple(dict.fromkeys(k for kws in (*(kw for _, kw, _ in FAMILIES), *BASE) for k in kws.split("|")))

OTHER = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # before lower-casing; a negated class is many times slower
A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rules() -> list[dict]:
    """Families in order, each with its keywords and its rules: one for each form, and the bare name where that is one."""
    out = []
    for label, kw, name in FAMILIES:
        own = [(prio, form.format(f"(?:{name})")) for prio, form in FORMS]
        if label in BARE or label[-1].isdigit() and label not in AMBIGUOUS:
            own.append((50 if label in BARE else 75, f"(?:{name})"))
        out.append({"label": label, "kws": [f" {k}" for k in kw.split("|")], "rules": [{"prio": prio, "re": f"(?<= ){form}(?= )"} for prio, form in own]})
    return out


def normal(text: Column) -> Column:
    """' w1 w2 ... wn ', not lower-cased; two spaces if there are no words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, OTHER, " ")), F.lit(" "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: what a lambda captures is otherwise computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda s, x: s + x)


def _starts(lens: Column) -> Column:
    """Sums of the entries before each entry; in blocks of 256, so the work isn't the square of the length."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / 256).cast("int")), lambda b: F.slice(lens, b * 256 + 1, 256))

    def within(sums: Column) -> Callable[[Column, Column], Column]:
        return lambda block, b: let(_sum(F.slice(sums, 1, b)), lambda base: F.transform(block, lambda _, i: base + _sum(F.slice(block, 1, i))))

    return let(blocks, lambda bs: let(F.transform(bs, _sum), lambda sums: F.flatten(F.transform(bs, within(sums)))))


def detections(norm: Column) -> Column:
    """All matches in a normalised text as array<struct<first, neg_last, neg_prio, label>>, sorted; first and last are character places."""
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<label:string,kws:array<string>,rules:array<struct<prio:int,re:string>>>>")
    named = F.filter(table, lambda f: F.exists(f["kws"], lambda k: F.contains(norm, k)))
    flat = F.flatten(F.transform(named, lambda f: F.transform(f["rules"], lambda r: F.struct(f["label"].alias("label"), r["prio"].alias("prio"), r["re"].alias("re")))))
    tried = F.filter(flat, lambda r: F.regexp(norm, r["re"]))

    def placed(r: Column, both: Column) -> Column:
        return let(_starts(F.transform(both, lambda x: x["p"] + x["h"])), lambda starts: F.zip_with(both, starts, lambda x, at: F.struct((at + x["p"]).alias("first"), (-(at + x["p"] + x["h"])).alias("neg_last"), (-r["prio"]).alias("neg_prio"), r["label"].alias("label"))))

    def matches(r: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(norm, r["re"], F.lit(0)), F.length)
        pieces = F.transform(F.split(norm, r["re"]), F.length)
        both = let(hits, lambda hs: F.zip_with(F.slice(pieces, F.lit(1), F.size(hs)), hs, lambda p, h: F.struct(p.alias("p"), h.alias("h"))))
        return let(both, lambda b: placed(r, b))

    return F.array_sort(F.flatten(F.transform(tried, matches)))


def surviving(found: Column) -> Column:
    """struct<labels, prio> of the detections that lie in no earlier one: a scan with the furthest end so far."""
    zero = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("prio"))

    def step(s: Column, x: Column) -> Column:
        new = -x["neg_last"] > s["end"]
        return F.struct(F.greatest(s["end"], -x["neg_last"]).alias("end"), F.when(new, F.array_union(s["labels"], F.array(x["label"]))).otherwise(s["labels"]).alias("labels"), F.when(new, F.greatest(s["prio"], -x["neg_prio"])).otherwise(s["prio"]).alias("prio"))

    return F.aggregate(found, zero, step)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    df = docs.select(docs[key].alias("doc_id"), normal(F.coalesce(docs[text], F.lit(""))).alias("norm")).withColumn("low", F.lower("norm"))
    gate = reduce(lambda a, b: a | b, (F.contains("low", F.lit(f" {g}")) for g in GATE))
    n_words = F.greatest(_spaces(F.col("norm")) - 1, F.lit(0)) - (F.col("norm") == "  ").cast("int")
    df = df.select("doc_id", n_words.cast("long").alias("n_words"), F.when(gate, F.translate("norm", A_Z, A_Z.lower())).alias("norm"))
    norm, none, n_words = F.col("norm"), F.lit(None).cast("long"), F.col("n_words")
    wide = F.replace(norm, F.lit(" "), F.lit("  "))  # each word with a space of its own on either side
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        there, n, lit = F.contains(norm, F.lit(f" {phrase} ")), len(phrase.split()), " " + phrase.replace(" ", "  ") + " "
        counts.append(F.when(there, (F.length(wide) - F.length(F.replace(wide, F.lit(lit), F.lit("")))) / len(lit)).otherwise(0).cast("long"))
        # before the first word stands one more space, after the last word too
        firsts.append(F.when(there, F.floor(_spaces(F.substring_index(wide, lit, 1)) / 2)).otherwise(none))
        lasts.append(F.when(there, n_words - F.floor(_spaces(F.substring_index(wide, lit, -1)) / 2) - n).otherwise(none))
        labels.append(F.when(there, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    kept = F.when(norm.isNotNull(), surviving(detections(norm))).otherwise(F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("prio")))
    df = df.select("doc_id", "n_words", reduce(lambda a, b: a + b, counts).alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), base.alias("base"), kept.alias("kept"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.greatest(F.col("kept.prio") / 100.0, F.when(F.size("base") > 0, F.lit(0.8)).otherwise(F.lit(0.0)))
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", "kept.labels")).alias("labels"), score.alias("score"))
