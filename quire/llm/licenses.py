"""Licence scans by sentence rules.

A text is cut into sentences; sentences that mention licensing are normalised
(lower case, words of letters, digits and inner . + -) and mapped to identifiers of
known licence sentences: for each family of sentences the first pattern that fits. An
SPDX line gives one identifier for each name of its expression, a Creative Commons
name one with its version. The identifiers of a text, in order, are matched against
licence rules: the first rule that fits takes its identifiers away, then the next is
tried. A sentence that denies a licence names none.

Only built-in expressions that DuckDB has too are used (no look-around), and
``scan_sql`` is the same scan as SQL, generated from the same tables; the tests hold
the tables themselves against licence texts and a plain matcher.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\x1e"
#: Where a sentence ends: (pattern, replacement) in order; groups are written \1 and turned to each engine's form.
CUTS = [
    (r"\b(Inc|Ltd|Corp|Co|LLC|Mr|Dr|St|No|al|etc|[vV])\.([ \t\r\n]+[a-z0-9])", r"\1 \2"),  # not after an abbreviation
    (r";([ \t\r\n#*/>-]+either)", r" \1"),  # nor before the version of a GNU notice
    (r"((?i:SPDX-License-Identifier)[^\n]*)\n", r"\1" + MARK),
    (r"([.!?;])[ \t\r\n]+", r"\1" + MARK),
    (r"[, \t\r\n]+but[ \t\r\n]+((?:rather |instead |only |solely )?(?:is |are )?(?:licensed|released|distributed|available|covered|under)\b)", MARK + r"\1"),  # what follows a denial
    (r"\n[ \t\r]*\n", MARK),
    (r"\n([ \t#*/>-]*(?:Licensed|Released|Distributed|Dual|This|Permission|Redistribution|Copyright|SPDX|The above|THE SOFTWARE|THIS SOFTWARE|Neither|You may|All rights|Under the|See the|If not))", MARK + r"\1"),
]
MENTIONS = r"licen[sc]e|copyright|permission|warrant|redistribut|spdx|public domain|all rights reserved|merchantab|\bmpl\b|\b[al]?gpl|\bgnu\b|creative commons|\bcc0\b|\bcc[ -]by|advertising materials|\b(?:sspl|busl|cddl|eupl|psfl|ms-[pr]l)\b"
#: A text in which MENTIONS finds anything has one of these, which are far cheaper to look for.
HINTS = ["licen", "copyright", "permission", "warrant", "redistribut", "spdx", "public domain", "all rights reserved", "merchantab", "mpl", "gpl", "gnu", "creative commons", "cc0", "cc by", "cc-by", "advertising materials", "sspl", "busl", "cddl", "eupl", "psfl", "ms-pl", "ms-rl"]
#: Of a lower-cased sentence: other characters, then marks around words, become blanks.
NORMAL = [("[^a-z0-9.+-]+", " "), (r"[.-]+( |$)", r"\1"), (r"(^| )[.+-]+", r"\1")]

# SPDX short identifiers.
SPDX = (
    "0BSD AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 "
    "GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
    "MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1 "
    "Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note"
).split()
#: Names of SPDX identifiers as normalised sentences spell them; a + stands for "or later".
SPDX_NAMES = {s.lower(): s for s in SPDX} | {f"{f}-{v}+".lower(): f"{f}-{v}-or-later" for f, vs in (("GPL", "1.0 2.0 3.0"), ("LGPL", "2.0 2.1 3.0"), ("AGPL", "1.0 3.0")) for v in vs.split()}
SPDX_LINE = r"\bspdx-license-identifier (.*)$"
#: Stands for WITH between a licence and its exception in an identifier.
WITH = "~"
#: The expression of an SPDX line as written, up to the end of a comment.
EXPRESSION = r"(?i:SPDX-License-Identifier):?[ \t]*([A-Za-z0-9.+() \t-]*[A-Za-z0-9.+)])"

CC_KINDS = [("by-nc-sa", "attribution[ -]noncommercial[ -]sharealike"), ("by-nc-nd", "attribution[ -]noncommercial[ -]noderiv[a-z]*"), ("by-nc", "attribution[ -]noncommercial"), ("by-sa", "attribution[ -]sharealike"), ("by-nd", "attribution[ -]noderiv[a-z]*"), ("by", "attribution")]
CC_VERSION = r"(?:\bcc[ -]by[a-z-]*[ -]|(?:attribution|sharealike|noncommercial|noderiv[a-z]*|international|unported|license|licence|version) )v?([1-4]\.[0-9])\b"

_UNDER = "under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?"


def _gnu(short: str, long: str, versions: list[str]) -> list[tuple[str, str]]:
    """The sentences that name a GNU licence: each version or a later one, each version, and without a version."""
    name, out = rf"(?:gnu {long}general public licen[sc]e|\bgnu {short}\b|\b{short}\b)", []
    for v in versions:
        digits = v.removesuffix(".0") + (r"(?:\.0)?" if v.endswith(".0") else "")
        number = rf"(?:{name}.*\bversion {digits.replace('2.1', '2[.]1')}|{name} ?(?:version |v ?)?{digits.replace('2.1', '2[.]1')}|\b{short}[v-]+{digits.replace('2.1', '2[.]1')})"
        out.append((f"{short}{v}_later", rf"{number}(?:\+|-or-later\b| .*\b(?:later|newer)\b| (?:later|newer)\b)"))
        out.append((f"{short}{v}", rf"{number}(?:-only)?(?: |$)"))
    return [*out, (short, name)]


# Known licence sentences as patterns over normalised sentences, by family.
FAMILIES: list[list[tuple[str, str]]] = [
    [
        ("apache2_comply", "you may not use this (?:file|work|software) except in compliance with the license"),
        ("apache2_copy", "you may obtain a copy of the license at"),
        ("apache2_asis", "unless required by applicable law or agreed to in writing"),
        ("apache2_ref", r"\bapache[- ](?:(?:software )?licen[sc]e )?(?:version |v ?)?2(?:\.0)?\b"),
        ("apache_ref", r"\bapache (?:software )?licen[sc]e\b"),
    ],
    [
        ("bsl_grant", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
        ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy"),
        ("isc_grant", "permission to use copy modify and ?(?:or )?distribute this software (?:and its documentation )?for any purpose"),
        ("mit_notice", "the above copyright notice and this permission notice (?:shall be included|appear) in all copies"),
        ("zlib_grant", "permission is granted to anyone to use this software for any purpose"),
        ("mit_ref", rf"\b(?:mit|expat)(?:-style| style)? licen[sc]es?\b|{_UNDER}(?:mit|expat)\b|\blicen[sc]e mit\b|\b(?:and|or) (?:the )?mit\b|\bmit (?:and |or )?(?:dual|apache|bsd|isc|gpl|zlib|x11)\b|\b(?:apache|clause|gpl)[a-z0-9. -]* mit\b"),
        ("isc_ref", rf"\bisc licen[sc]es?\b|{_UNDER}isc\b|\blicen[sc]e isc\b"),
        ("zlib_ref", rf"\bzlib licen[sc]es?\b|{_UNDER}zlib\b"),
        ("bsl_ref", r"\bboost software licen[sc]e\b"),
        ("wtfpl", r"\bwtfpl\b|\bdo what the fuck you want to public licen[sc]e\b"),
    ],
    [
        ("bsd_intro", "redistribution and use in source and binary forms"),
        ("bsd_source", "redistributions? of source code must retain"),
        ("bsd_binary", "redistributions? in binary form must reproduce"),
        ("bsd_advert", "all advertising materials mentioning features"),
        ("bsd_endorse", "neither the names? of|may (?:not )?be used to endorse or promote"),
        ("bsd4_ref", r"\bbsd[- ]4[- ]clause\b|\b(?:4-clause|four-clause|original) bsd\b"),
        ("bsd3_ref", r"\bbsd[- ]3[- ]clause\b|\b(?:3-clause|three-clause|new|modified|revised) bsd\b"),
        ("bsd2_ref", r"\bbsd[- ]2[- ]clause\b|\b(?:2-clause|two-clause|simplified) bsd\b|\bfreebsd licen[sc]e\b"),
        ("bsd_ref", rf"\bbsd(?:-style| style)? licen[sc]es?\b|{_UNDER}bsd\b|\blicen[sc]e bsd\b"),
    ],
    [("asis_software", "(?:the|this) software is provided (?:by [a-z0-9 .-]+ )?as[ -]is")],
    [
        ("gpl_hope", "distributed in the hope that it will be useful"),
        ("gpl_see", "see the gnu (?:affero |lesser |library )?general public license for more details"),
        ("gpl_received", "received a copy of the gnu"),
        *_gnu("agpl", "affero ", ["3.0"]),
        *_gnu("lgpl", "(?:lesser |library )", ["2.1", "2.0", "3.0"]),
        *_gnu("gpl", "", ["2.0", "3.0", "1.0"]),
    ],
    [
        ("mpl2_copy", "if a copy of the mpl was not distributed with this"),
        ("mpl2_ref", r"\bmozilla public licen[sc]e (?:version |v ?)?2(?:\.0)?\b|\bmpl[ -](?:version |v ?)?2(?:\.0)?\b"),
        ("mpl1_ref", r"\bmozilla public licen[sc]e (?:version |v ?)?1\.1\b|\bmpl[ -](?:version |v ?)?1\.1\b"),
        ("epl2_ref", r"\beclipse public licen[sc]e (?:- )?(?:version |v ?)?2\b|\bepl[ -](?:v ?)?2\b"),
        ("epl1_ref", r"\beclipse public licen[sc]e (?:- )?(?:version |v ?)?1\b|\bepl[ -](?:v ?)?1\b"),
        ("ofl_ref", r"\bsil open font licen[sc]e\b"),
        ("artistic2_ref", r"\bartistic licen[sc]e (?:version |v ?)?2\b"),
    ],
    [
        ("unlicense", r"\bfree and unencumbered software\b|\bunlicense\b"),
        ("cc0", r"\bcc0\b|\bcreative commons zero\b"),
        ("public_domain", r"\b(?:dedicat|releas|plac|put)[a-z]* .*\bthe public domain\b|\b(?:is|are) in the public domain\b|\b(?:dedicated|released|placed|put) (?:to|into|in) the public domain\b"),
    ],
    [
        ("sspl_ref", r"\bserver[ -]side public licen[sc]e\b|\bsspl\b"),
        ("busl_ref", r"\bbusiness source licen[sc]e\b|\bbusl\b"),
        ("elastic2_ref", r"\belastic licen[sc]e (?:version |v ?)?2(?:\.0)?\b|\belastic-2\.0\b"),
        ("psf_ref", r"\b(?:python software foundation|psf) licen[sc]e\b|\bpsf-2\.0\b|\bpsfl\b"),
        ("mspl_ref", r"\bmicrosoft public licen[sc]e\b|\bms-pl\b"),
        ("msrl_ref", r"\bmicrosoft reciprocal licen[sc]e\b|\bms-rl\b"),
        ("cddl11_ref", r"\b(?:common development and distribution licen[sc]e(?: cddl)?|cddl)[ -](?:version |v ?)?1\.1\b"),
        ("cddl1_ref", r"\b(?:common development and distribution licen[sc]e(?: cddl)?|cddl)[ -](?:version |v ?)?1\.0\b"),
        ("cddl_ref", r"\bcommon development and distribution licen[sc]e\b|\bcddl\b"),
        ("eupl12_ref", r"\b(?:european union public licen[sc]e(?: eupl)?|eupl)[ -](?:version |v ?)?1\.2\b"),
        ("eupl11_ref", r"\b(?:european union public licen[sc]e(?: eupl)?|eupl)[ -](?:version |v ?)?1\.1\b"),
        ("eupl_ref", r"\beuropean union public licen[sc]e\b|\beupl\b"),
    ],
    [("rights", "all rights reserved")],
]
#: A sentence that says a licence does not hold has the identifier denied, whatever licences it names.
DENIED = "denied"
DENIES = r"\b(?:not|no longer|never|isn t|aren t|wasn t|nor) (?:[a-z]+ )?(?:licen[sc]ed|covered|released|governed|offered|available under|subject to|(?:distributed|published|provided) under|under)\b|\blicen[sc]e (?:does not|do not|doesn t|don t) apply\b|\bwithout (?:any|a) licen[sc]e\b|\bno licen[sc]e is (?:granted|given)\b"
COPYRIGHT = r"^(?:c )?copyright\b"


def _sequence(*ids: str) -> str:
    """A pattern over the identifiers of a text, each written ;id; - those with ? may be missing, with * come any number of times."""
    return "".join(f"(?:;{i.rstrip('?*')};)" + i[len(i.rstrip("?*")) :] for i in ids)


_GPL_REST = ("gpl_hope?", "gpl_see?", "gpl_received?")
# Licence rules over the sequence of identifiers; the first rule that fits wins.
RULES: list[tuple[str, str]] = [
    ("Unlicense", _sequence("unlicense", "public_domain*", "asis_software?")),
    ("BSL-1.0", _sequence("bsl_ref?", "bsl_grant", "asis_software?") + "|" + _sequence("bsl_ref")),
    ("MIT", _sequence("mit_ref?", "mit_grant", "mit_notice?", "asis_software?")),
    ("ISC", _sequence("isc_ref?", "isc_grant", "mit_notice?", "asis_software?")),
    ("Zlib", _sequence("zlib_ref?", "asis_software?", "zlib_grant") + "|" + _sequence("zlib_ref")),
    ("BSD-4-Clause", _sequence("bsd_intro", "bsd_source?", "bsd_binary?", "bsd_advert", "bsd_endorse?", "asis_software?") + "|" + _sequence("bsd4_ref")),
    ("BSD-3-Clause", _sequence("bsd_intro", "bsd_source?", "bsd_binary?", "bsd_endorse", "asis_software?") + "|" + _sequence("bsd3_ref")),
    ("BSD-2-Clause", _sequence("bsd_intro", "bsd_source", "bsd_binary?", "asis_software?") + "|" + _sequence("bsd2_ref")),
    ("Apache-2.0", _sequence("apache2_ref", "apache2_comply?", "apache2_copy?", "apache2_ref*", "apache2_asis?") + "|" + _sequence("apache2_comply", "apache2_copy")),
    ("MPL-2.0", _sequence("mpl2_ref", "mpl2_copy?")),
    ("MPL-1.1", _sequence("mpl1_ref")),
    ("EPL-2.0", _sequence("epl2_ref")),
    ("EPL-1.0", _sequence("epl1_ref")),
    ("OFL-1.1", _sequence("ofl_ref")),
    ("Artistic-2.0", _sequence("artistic2_ref")),
    ("SSPL-1.0", _sequence("sspl_ref")),
    ("BUSL-1.1", _sequence("busl_ref")),
    ("Elastic-2.0", _sequence("elastic2_ref")),
    ("PSF-2.0", _sequence("psf_ref")),
    ("MS-PL", _sequence("mspl_ref")),
    ("MS-RL", _sequence("msrl_ref")),
    ("CDDL-1.1", _sequence("cddl11_ref")),
    ("CDDL-1.0", _sequence("cddl1_ref")),
    ("CDDL", _sequence("cddl_ref")),
    ("EUPL-1.2", _sequence("eupl12_ref")),
    ("EUPL-1.1", _sequence("eupl11_ref")),
    ("EUPL", _sequence("eupl_ref")),
    *[
        (f"{family.upper()}-{v}{'-or-later' if later else ''}", _sequence(f"{family}{v}{later}", *_GPL_REST))
        for family, versions in (("agpl", ["3.0"]), ("lgpl", ["2.0", "2.1", "3.0"]), ("gpl", ["1.0", "2.0", "3.0"]))
        for v in versions
        for later in ("_later", "")
    ],
    *[(family.upper(), _sequence(family, *_GPL_REST)) for family in ("agpl", "lgpl", "gpl")],
    ("CC0-1.0", _sequence("cc0", "public_domain*")),
    ("WTFPL", _sequence("wtfpl")),
    ("MIT", _sequence("mit_ref")),
    ("ISC", _sequence("isc_ref")),
    ("BSD", _sequence("bsd_ref")),
    ("Apache", _sequence("apache_ref")),
    ("Public-Domain", _sequence("public_domain")),
]
#: Only where no rule has fitted: a reservation stands beside nearly every licence.
LAST_RULE = ("All-Rights-Reserved", _sequence("rights"))


def _java(replacement: str) -> str:
    return replacement.replace("\\", "$")


def _normalised(sentence: Column) -> Column:
    out = F.lower(sentence)
    for pattern, into in NORMAL:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(_java(into)))
    return F.trim(out)


def _spdx_ids(sentence: Column) -> Column:
    names = F.array(*map(F.lit, SPDX_NAMES))
    line = F.replace(F.regexp_extract(sentence, SPDX_LINE, 1), F.lit(" with "), F.lit(WITH))
    words = F.filter(F.split(line, " "), lambda w: ~w.isin("and", "or", ""))
    wanted = F.filter(words, lambda w, k: (k == 0) | F.array_contains(names, F.substring_index(w, WITH, 1)) | w.startswith("licenseref-"))
    return F.transform(wanted, lambda w: F.concat(F.lit("spdx:"), w))


def _cc_id(sentence: Column) -> Column:
    kind = F.lit(None).cast("string")
    for code, name in reversed(CC_KINDS):
        kind = F.when(sentence.rlike(rf"\bcc[ -]{code}\b|\bcreative commons {name}\b"), F.lit(f"cc:{code}")).otherwise(kind)
    version = F.regexp_extract(sentence, CC_VERSION, 1)
    return F.when(version == "", kind).otherwise(F.concat(kind, F.lit("-"), version))


def _identifiers(sentence: Column) -> Column:
    """array<string> of a normalised sentence; unknown, or copyright for a notice, if no family has it."""
    found = []
    for family in FAMILIES:
        first = F.lit(None).cast("string")
        for name, pattern in reversed(family):
            first = F.when(sentence.rlike(pattern), F.lit(name)).otherwise(first)
        found.append(first)
    plain = F.array_compact(F.array(*found, _cc_id(sentence)))
    other = F.array(F.when(sentence.rlike(COPYRIGHT), F.lit("copyright")).otherwise(F.lit("unknown")))
    return F.when(sentence.rlike(SPDX_LINE), _spdx_ids(sentence)).when(sentence.rlike(DENIES), F.array(F.lit(DENIED))).when(F.size(plain) > 0, plain).otherwise(other)


def _sentences(text: Column) -> Column:
    marked = text
    for pattern, into in CUTS:
        marked = F.regexp_replace(marked, F.lit(pattern), F.lit(_java(into)))
    return F.filter(F.split(marked, MARK), lambda s: F.lower(s).rlike(MENTIONS))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_unknown, sentence_ids, licenses, expressions) for every row of docs (doc_id, text, ...).

    n_sentences are those that mention licensing, n_unknown those of them that no family has. sentence_ids and
    licenses are comma-joined: identifiers in text order; licences named by SPDX lines, each with its exception, and
    Creative Commons names in text order, then the others in the order of the rules, each once. Sentences that deny a licence
    name none. expressions are those of SPDX lines as written, joined by semicolons. Null and empty texts have none of
    these. Repeated rows stay, null doc_ids stay null, other columns are ignored, an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<array<string>>")
    hinted = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(h)) for h in HINTS])
    step = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(hinted, F.transform(_sentences(text), lambda s: _identifiers(_normalised(s)))).otherwise(none).alias("by_sentence"),
        F.when(F.contains(F.lower(text), F.lit("spdx")), F.array_join(F.regexp_extract_all(text, F.lit(EXPRESSION), 1), ";")).otherwise(F.lit("")).alias("expressions"),
    )
    step = step.withColumn("ids", F.flatten("by_sentence"))
    names = F.create_map(*[F.lit(x) for pair in SPDX_NAMES.items() for x in pair])
    shown = lambda w: F.array_join(F.transform(F.split(w, WITH), lambda n: F.coalesce(F.element_at(names, n), n)), " WITH ")
    named = F.transform(F.filter("ids", lambda i: i.startswith("spdx:") | i.startswith("cc:")), lambda i: F.when(i.startswith("cc:"), F.upper(F.replace(i, F.lit(":"), F.lit("-")))).otherwise(shown(F.substring(i, 6, 1000))))
    rest = F.array_join(F.transform(F.filter("ids", lambda i: ~i.isin("unknown", "copyright", DENIED) & ~i.contains(":")), lambda i: F.concat(F.lit(";"), i, F.lit(";"))), "")
    step = step.withColumn("rest", rest).withColumn("named", named)
    # each rule is a literal pattern that leaves its number where it has taken identifiers
    taken = F.col("rest")
    for k, (_, pattern) in enumerate(RULES):
        taken = F.regexp_replace(taken, F.lit(pattern), F.lit(f"|{k}|"))
    step = step.withColumn("taken", F.when(F.col("rest") != "", taken).otherwise(F.lit("")))
    fitting = F.array_compact(F.array(*[F.when(F.contains("taken", F.lit(f"|{k}|")), F.lit(name)) for k, (name, _) in enumerate(RULES)]))
    step = step.withColumn("found", F.array_distinct(F.when(F.col("taken") == "", F.col("named")).otherwise(F.concat("named", fitting))))
    reserved = (F.size("found") == 0) & F.col("rest").rlike(LAST_RULE[1])
    return step.select(
        "doc_id",
        F.size("by_sentence").cast("long").alias("n_sentences"),
        F.size(F.filter("ids", lambda i: i == "unknown")).cast("long").alias("n_unknown"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.when(reserved, F.lit(LAST_RULE[0])).otherwise(F.array_join("found", ",")).alias("licenses"),
        "expressions",
    )


def scan_sql(table: str = "documents") -> str:
    """The scan as DuckDB SQL, from the same tables of sentences and rules."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    mark = "chr(30)"
    marked = "coalesce(text, '')"
    for pattern, into in CUTS:
        parts = [mark if x == MARK else q(x) for x in (into.replace(MARK, "\x00" + MARK + "\x00").split("\x00")) if x]
        marked = f"regexp_replace({marked}, {q(pattern)}, {' || '.join(parts)}, 'g')"
    normal = "lower(s)"
    for pattern, into in NORMAL:
        normal = f"regexp_replace({normal}, {q(pattern)}, {q(into)}, 'g')"
    first = lambda family: "CASE " + " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {q(n)}" for n, p in family) + " END"
    cc = "CASE " + " ".join(f"WHEN regexp_matches(s, {q(rf'\bcc[ -]{code}\b|\bcreative commons {name}\b')}) THEN {q('cc:' + code)}" for code, name in CC_KINDS) + " END"
    version = f"regexp_extract(s, {q(CC_VERSION)}, 1)"
    known = "[" + ", ".join(map(q, SPDX_NAMES)) + "]"
    words = f"list_filter(string_split(replace(regexp_extract(s, {q(SPDX_LINE)}, 1), ' with ', '{WITH}'), ' '), lambda w: w NOT IN ('and', 'or', ''))"
    spdx = f"list_transform(list_filter({words}, lambda w, k: k = 1 OR list_contains({known}, string_split(w, '{WITH}')[1]) OR starts_with(w, 'licenseref-')), lambda w: 'spdx:' || w)"
    plain = f"list_filter([{', '.join(map(first, FAMILIES))}, ({cc}) || CASE WHEN {version} = '' THEN '' ELSE '-' || {version} END], lambda x: x IS NOT NULL)"
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in SPDX_NAMES.items()) + "}"
    steps, at = [], "r0"
    for k, (name, pattern) in enumerate(RULES, 1):
        steps.append(
            f"r{k} AS (SELECT doc_id, row_no, n_sentences, ids, expressions, regexp_replace(rest, {q(pattern)}, '|', 'g') AS rest, found || CASE WHEN regexp_matches(rest, {q(pattern)}) AND NOT list_contains(found, {q(name)}) THEN [{q(name)}] ELSE [] END AS found FROM {at})"
        )
        at = f"r{k}"
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_no, text FROM {table}),
parts AS (SELECT row_no, unnest(string_split({marked}, {mark})) AS s, unnest(range(len(string_split({marked}, {mark})))) AS k FROM docs),
near AS (SELECT row_no, k, trim({normal}) AS s FROM parts WHERE regexp_matches(lower(s), {q(MENTIONS)})),
families AS (SELECT row_no, k, s, {plain} AS found FROM near),
named AS (SELECT row_no, k, CASE WHEN regexp_matches(s, {q(SPDX_LINE)}) THEN {spdx} WHEN regexp_matches(s, {q(DENIES)}) THEN ['{DENIED}'] WHEN len(found) > 0 THEN found WHEN regexp_matches(s, {q(COPYRIGHT)}) THEN ['copyright'] ELSE ['unknown'] END AS ids FROM families),
lists AS (SELECT row_no, count(*) AS n_sentences, flatten(list(ids ORDER BY k)) AS ids FROM named GROUP BY row_no),
joined AS (SELECT array_to_string(regexp_extract_all(coalesce(docs.text, ''), {q(EXPRESSION)}, 1), ';') AS expressions, docs.doc_id, docs.row_no, coalesce(n_sentences, 0) AS n_sentences, coalesce(ids, []) AS ids FROM docs LEFT JOIN lists ON docs.row_no = lists.row_no),
r0 AS (SELECT doc_id, row_no, n_sentences, ids, expressions, array_to_string(list_transform(list_filter(ids, lambda i: i NOT IN ('unknown', 'copyright', '{DENIED}') AND NOT contains(i, ':')), lambda i: ';' || i || ';'), '') AS rest,
  list_transform(list_filter(ids, lambda i: contains(i, ':')), lambda i: CASE WHEN starts_with(i, 'cc:') THEN upper(replace(i, ':', '-')) ELSE array_to_string(list_transform(string_split(substr(i, 6), '{WITH}'), lambda n: coalesce({names}[n], n)), ' WITH ') END) AS named,
  CAST(list_filter(named, lambda x, k: list_position(named, x) = k) AS VARCHAR[]) AS found FROM joined),
{", ".join(steps)}
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(len(list_filter(ids, lambda i: i = 'unknown')) AS BIGINT) AS n_unknown,
array_to_string(ids, ',') AS sentence_ids, CASE WHEN len(found) = 0 AND regexp_matches(rest, {q(LAST_RULE[1])}) THEN {q(LAST_RULE[0])} ELSE array_to_string(found, ',') END AS licenses, expressions FROM {at}"""
