import random

import pytest

from quire.llm import licenses

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software.

The above copyright notice and this permission notice shall be included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted:
Redistributions of source code must retain the above copyright notice.
Redistributions in binary form must reproduce the above copyright notice.
{}THIS SOFTWARE IS PROVIDED BY THE AUTHORS "AS IS"; no warranty is given."""
BSD3_GOOGLE = """Copyright 2010, Google Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

    * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
    * Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
BSD4 = BSD3_GOOGLE.replace("    * Neither", "    * All advertising materials mentioning features or use of this software must display a notice.\n    * Neither")
GPL2_LATER = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License along
# with this program."""
LGPL21_LATER = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
See the GNU Lesser General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications."""
CASES = {
    "Prose.\nReleased under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed### under%%% the Apache License,*** Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "// SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
    MIT: "MIT",
    BSD.format("Neither the name of the holder may be used without permission.\n"): "BSD-3-Clause",
    BSD.format(""): "BSD-2-Clause",
    "Released under the MIT License. Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0,MIT",
    "A licence to dream; permission denied.": "",
    "": "",
    None: "",
    BSD3_GOOGLE: "BSD-3-Clause",
    BSD4: "BSD-4-Clause",
    GPL2_LATER: "GPL-2.0-or-later",
    GPL2_LATER.replace("General", "Affero General").replace("version 2", "version 3"): "AGPL-3.0-or-later",
    LGPL21_LATER: "LGPL-2.1-or-later",
    MPL: "MPL-2.0",
    UNLICENSE: "Unlicense",
    APACHE: "Apache-2.0",
    ISC: "ISC",
    ZLIB: "Zlib",
    "# SPDX-License-Identifier: MIT OR Apache-2.0\nimport os": "MIT,Apache-2.0",
    "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause */\nint x;": "GPL-2.0-only WITH Linux-syscall-note,BSD-3-Clause",
    "SPDX-License-Identifier: AGPL-3.0": "AGPL-3.0",
    "SPDX-License-Identifier: CC-BY-4.0": "CC-BY-4.0",
    "-- SPDX-License-Identifier: ISC": "ISC",
    "SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
    "SPDX-License-Identifier: LicenseRef-Own-1": "licenseref-own-1",
    "Apache-2.0 license": "Apache-2.0",
    "Licensed under MIT": "MIT",
    "Dual licensed under the MIT and Apache 2.0 licenses.": "Apache-2.0,MIT",
    "Licensed under either of Apache License, Version 2.0 or the MIT license at your option.": "Apache-2.0,MIT",
    "License: GPLv3+": "GPL-3.0-or-later",
    "Under the LGPL-2.1 license.": "LGPL-2.1",
    "Licensed under the GNU GPL version 2 or later.": "GPL-2.0-or-later",
    "Licensed under the 3-clause BSD license.": "BSD-3-Clause",
    "Licensed under the BSD license.": "BSD",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0",
    "To the extent possible, this is dedicated to the public domain.": "Public-Domain",
    "Released under CC0.": "CC0-1.0",
    "Copyright 2020 Someone. All rights reserved.": "All-Rights-Reserved",
    "This is not licensed under the MIT license.": "",
    "This software is not covered by the GPL.": "",
    "The code is no longer distributed under the Apache License 2.0.": "",
    "This file isn't released under the BSD license, but is licensed under the ISC license.": "ISC",
    "It is not under the MIT license but under the Apache License, Version 2.0.": "Apache-2.0",
    "The MIT license does not apply to the logo. Licensed under the zlib license.": "Zlib",
    "No license is granted. The GPL is mentioned here, and warranty is not given.": "GPL",
    "MIT/Apache-2.0 dual license": "Apache-2.0,MIT",
    "License: Apache-2.0 / MIT": "Apache-2.0,MIT",
    "LGPL-3.0-or-later licensed": "LGPL-3.0-or-later",
    "GPL-2.0-only license text": "GPL-2.0",
    "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": "GPL-2.0 WITH Linux-syscall-note",
    "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception OR MIT": "Apache-2.0 WITH LLVM-exception,MIT",
    "Licensed under the Server Side Public License, v 1 (SSPL).": "SSPL-1.0",
    "Use of this software is governed by the Business Source License included in the file.": "BUSL-1.1",
    "Licensed under the Elastic License 2.0; you may not use this file except in compliance with it.": "Elastic-2.0",
    "Distributed under the Python Software Foundation License.": "PSF-2.0",
    "Microsoft Public License (MS-PL)": "MS-PL",
    "Released under the Microsoft Reciprocal License.": "MS-RL",
    "The contents of this file are subject to the Common Development and Distribution License (CDDL) version 1.1.": "CDDL-1.1",
    "Licensed under CDDL-1.0.": "CDDL-1.0",
    "Licensed under the EUPL, Version 1.2 or later.": "EUPL-1.2",
    "European Union Public Licence v. 1.1": "EUPL-1.1",
    "Copyright 2020 Someone. All rights reserved. Licensed under the MIT License.": "MIT",
}


def plain_sequence(ids):
    """Licences of an identifier sequence by walking it, without the rules' patterns: names and full texts only."""
    names = {"mit_ref": "MIT", "mit_grant": "MIT", "isc_grant": "ISC", "isc_ref": "ISC", "zlib_grant": "Zlib", "zlib_ref": "Zlib", "unlicense": "Unlicense", "apache2_ref": "Apache-2.0", "mpl2_ref": "MPL-2.0", "bsd_ref": "BSD", "sspl_ref": "SSPL-1.0", "busl_ref": "BUSL-1.1", "elastic2_ref": "Elastic-2.0", "psf_ref": "PSF-2.0", "mspl_ref": "MS-PL", "msrl_ref": "MS-RL", "cddl11_ref": "CDDL-1.1", "cddl1_ref": "CDDL-1.0", "cddl_ref": "CDDL", "eupl12_ref": "EUPL-1.2", "eupl11_ref": "EUPL-1.1", "eupl_ref": "EUPL", "bsd3_ref": "BSD-3-Clause", "cc0": "CC0-1.0"}
    out = {names[i] for i in ids if i in names}
    for family in ("agpl", "lgpl", "gpl"):
        for i in ids:
            if i.startswith(family) and i not in ("gpl_hope", "gpl_see", "gpl_received"):
                version, _, later = i.removeprefix(family).partition("_")
                out.add("-".join(x for x in (family.upper(), version, "or-later" if later else "") if x))
    # each text of the BSD kind goes from its first sentence to that of the next
    starts = [k for k, i in enumerate(ids) if i == "bsd_intro"]
    for k, end in zip(starts, [*starts[1:], len(ids)]):
        own = ids[k:end]
        out.add("BSD-4-Clause" if "bsd_advert" in own else "BSD-3-Clause" if "bsd_endorse" in own else "BSD-2-Clause")
    if "public_domain" in ids and not out & {"Unlicense", "CC0-1.0"}:
        out.add("Public-Domain")
    for i in ids:
        if i.startswith("cc:"):
            out.add(i.replace(":", "-").upper())
        if i.startswith("spdx:"):
            out.add(" WITH ".join({k.lower(): k for k in licenses.SPDX}.get(x, "GPL-2.0-or-later" if x == "gpl-2.0+" else x) for x in i[5:].split("~")))
    return out or ({"All-Rights-Reserved"} if "rights" in ids else set())


def test_rules_match_a_plain_walk(spark):
    texts = [t for t in CASES if t]
    r = random.Random(2)
    for _ in range(60):
        texts.append("\n\n".join(["Some prose about nothing."] + [t for t in r.sample(texts[: len(CASES) - 2], 2)]))
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in got:
        assert set(filter(None, row.licenses.split(","))) == plain_sequence(row.sentence_ids.split(",")), texts[row.doc_id]


def test_rules(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(CASES)] + [(None, None, "x"), (0, list(CASES)[0], "x")], "doc_id long, text string, licenses string")
    got = licenses.scan(df)
    found = {r.doc_id: r.licenses for r in got.collect() if r.doc_id is not None}
    for k, (text, want) in enumerate(CASES.items()):
        assert found[k] == want, text
    assert got.count() == len(CASES) + 2 and got.where("doc_id = 9").first().n_unknown == 2
    assert licenses.scan(df.where("false")).count() == 0


def test_hints_let_every_mention_through():
    import re

    said = ["License", "licence", "Copyright", "permission", "Warranty", "redistribute", "SPDX", "public domain", "All rights reserved", "merchantability", "MPL 2", "the AGPL", "a LGPL", "gpl-3.0", "GNU", "Creative Commons", "CC0", "cc by", "cc-by", "advertising materials", "SSPL", "BUSL", "cddl", "EUPL", "psfl", "MS-PL", "ms-rl"]
    for text in [*said, *filter(None, CASES)]:
        if re.search(licenses.MENTIONS, text.lower()):
            assert any(h in text.lower() for h in licenses.HINTS), text
    assert len([t for t in said if re.search(licenses.MENTIONS, t.lower())]) == len(said)


def test_expressions_stay_as_written(spark):
    texts = ["/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT */\nint x;", "# spdx-license-identifier: MIT\n# SPDX-License-Identifier: Apache-2.0 AND  ISC -->\n", "none", None]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.expressions for r in got] == ["(GPL-2.0-only WITH Linux-syscall-note) OR MIT", "MIT;Apache-2.0 AND  ISC", "", ""]


def test_same_as_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    pa = pytest.importorskip("pyarrow")
    rows = [(k, t) for k, t in enumerate(CASES)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [k for k, _ in rows], "text": pa.array([t for _, t in rows], pa.string())}))
    want = con.execute(licenses.scan_sql()).fetchall()
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
