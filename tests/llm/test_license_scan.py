import re

from tidecast.llm.license_scan import DERIVED, HINT, RULES, SENTENCES, scan_licenses

MIT = """Copyright (c) 2024 Someone
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
MIT = MIT.replace('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and', "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and")


def test_rules(spark):
    texts = [
        ("Some prose. Licensed under the Apache License, Version 2.0.", "Apache-2.0:notice"),
        ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, without", "Apache-2.0:full"),
        (MIT, "MIT:full"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0:notice"),
        ("Licensed under CC BY-NC 4.0. Released under the MIT License", "MIT:notice,CC-BY-NC-4.0:notice"),
        ("Copyright 2020 X\nAll  rights\treserved!", "Proprietary:notice"),
        ("All rights reserved. copyright 2020", "All-rights-reserved:notice"),
        ("They licensed under pressure the MIT licence plates.", ""),
        (None, ""), ("", ""), ("x " * 60000 + "\nMIT License", "MIT:notice"),
    ]
    df = spark.createDataFrame([(i, t, "z") for i, (t, _) in enumerate(texts)], "doc_id long, text string, licenses string")
    got = scan_licenses(df).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {i: want for i, (_, want) in enumerate(texts)}
    assert all(r["n_licenses"] == (r["licenses"].count(",") + 1 if r["licenses"] else 0) for r in got)
    assert scan_licenses(df.limit(0)).count() == 0 and scan_licenses(df.union(df)).count() == 2 * len(texts)


def test_every_sentence_has_a_hint_and_every_rule_known_identifiers():
    assert all(re.search(HINT, s) for texts in SENTENCES.values() for s in texts if not s.startswith("licensed under cc")), "hint"
    assert all(re.search("licen[sc]e", s) for s in SENTENCES["cc-by-4"])
    assert all(k in SENTENCES or k in DERIVED for _, _, sequence, _ in RULES for k in sequence)


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "MIT License")], "doc_id long, text string")
    plan = scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


WRAPPED = {
    "GPL-3.0-or-later:full": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "GPL-2.0-or-later:full": """/*
 * This program is free software; you can redistribute it and/or modify it
 * under the terms of the GNU General Public License as published by the Free
 * Software Foundation; either version 2 of the License, or (at your option)
 * any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 */""",
    "LGPL-2.1-or-later:full": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "BSD-3-Clause:full": """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products.""",
    "MPL-2.0:notice": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT:full": """MIT License
Copyright (c) 2024 Someone
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.""",
    "Apache-2.0:full": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
}


def test_wrapped_notices(spark):
    texts = [(w, t.replace("\n", end)) for w, t in WRAPPED.items() for end in ("\n", "\r\n")]
    lesser = WRAPPED["GPL-3.0-or-later:full"].replace("GNU General", "GNU Lesser General")
    texts += [("LGPL-3.0-or-later:full", lesser), ("CC-BY-4.0:notice", "Prose\nThis work is\nlicensed under CC BY 4.0\nmore prose")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    assert {i: got[i]["licenses"] for i in got} == {i: w for i, (w, _) in enumerate(texts)}
    assert got[len(texts) - 1]["sentence_ids"] == "cc-by-4"


NOTICES = {
    "ISC:full": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES.""",
    "Zlib:full": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.""",
    "Unlicense:full": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.""",
    "EPL-2.0:notice": """ * This program and the accompanying materials are made available under the
 * terms of the Eclipse Public License 2.0 which is available at
 * https://www.eclipse.org/legal/epl-2.0/""",
    "AGPL-3.0-or-later:full": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Affero General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "LGPL-2.1-or-later:full": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "GPL-3.0-or-later:full": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.""",
    "BSL-1.0:notice": "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)",
}


def test_notices_as_they_are_published(spark):
    rows = list(enumerate(NOTICES.values())) + [(100 + i, "some prose. " * 200 + "\n\n" + t + "\n\nmore") for i, t in enumerate(NOTICES.values())]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, want in enumerate(NOTICES):
        assert got[i] == got[100 + i] == want


def test_every_known_sentence_holds_a_hint():
    import re

    from tidecast.llm.license_scan import HINT, SENTENCES, WRAPPED

    assert all(re.search(HINT, t) for known in (SENTENCES, WRAPPED) for texts in known.values() for t in texts)
