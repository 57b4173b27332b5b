"""License notices that are no templates: precision and recall of what is told, with expectations of the test's own."""

import re

from shelfspark.llm import licenses

PROSE = ("Rivers and old bridges are told of first, and of boats that passed below them in spring. ", " Then the price of bread is told, and the weather over the gardens of the town.")
CALLS = {
    "MIT": ["MIT License", "MIT license"], "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0"], "Apache-1.1": ["Apache License, Version 1.1"], "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License v3"], "LGPL-2.1": ["GNU Lesser General Public License version 2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3"], "AGPL-3.0": ["GNU Affero General Public License v3"], "MPL-2.0": ["Mozilla Public License 2.0"],
    "MPL-1.1": ["Mozilla Public License 1.1"], "EPL-2.0": ["Eclipse Public License 2.0"], "EPL-1.0": ["Eclipse Public License 1.0"], "BSD": ["BSD License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-clause license"], "ISC": ["ISC License"], "Zlib": ["zlib license"],
    "BSL-1.0": ["Boost Software License 1.0"], "Artistic-2.0": ["Artistic License 2.0"], "CC-BY-3.0": ["Creative Commons Attribution 3.0 Unported License"], "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"], "CC-BY-NC-2.5": ["Creative Commons Attribution-NonCommercial 2.5 License"],
}
FORMS = ["This software is licensed under the {}.", "All files here are licensed under the {}, unless noted.", "Copyright 2020 Some One. Licensed under the {}; see LICENSE.", "It is made available under the terms of the {} by its authors.", "(c) The Team, licensed under the {}", "Our work is licensed under a {}, with thanks.", "Everything is licensed under the\n   {}", "the source is Licensed Under The {}!"]
TAGS = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2.0-only", "GPL-3.0-or-later": "GPL-3.0-or-later", "BSD-3-Clause": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "CC0-1.0": "CC0-1.0"}
NONE = ["This project is not licensed under the {}.", "It was never released under the {}.", "The {} is a text that many lawyers like to read.", "We cannot be licensed under the {}."]
OTHERS = ["Licensed under the BSD 4-Clause License.", "Licensed under the Python Software Foundation License.", "Licensed under the CDDL License.", "Licensed under the PHP License 3.0.", "Licensed under the JSON License.", "The driver has a license to carry passengers in this city.", "All rights of the tenants are reserved by law.", "He studied at MIT and later at a general public school.", "Version 2.0 of the menu has apache beans.", "They met under the terms of the peace."]


def told(scanner, text):
    names = [f[0] for block in scanner.blocks(PROSE[0] + text + PROSE[1]) for f in scanner.find(block)]
    return {re.sub(r"-(tag|short|header|opening|said-\d\d|text|whole|title|licensed|endorsement)$", "", n) for n in names}


def test_notices_that_are_no_templates():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    cases = [(form.format(call), name) for name, calls in CALLS.items() for call in calls for form in FORMS]
    cases += [(f"{mark} SPDX-License-Identifier: {tag}", name) for tag, name in TAGS.items() for mark in ("//", "#")]
    wanted = [(text, name, told(scanner, text)) for text, name in cases]
    right = [x for x in wanted if x[2] == {x[1]}]
    empty = [form.format(calls[0]) for calls in CALLS.values() for form in NONE] + OTHERS
    false = [(text, got) for text in empty if (got := told(scanner, text))]
    answers = sum(len(got) for *_, got in wanted) + sum(len(got) for _, got in false)
    assert len(wanted) >= 200 and len(empty) >= 90
    assert len(right) / len(wanted) >= 0.9, [x for x in wanted if x[2] != {x[1]}][:20]
    assert len(right) / answers >= 0.9, false[:20]


def test_decisive_words():
    """Names, versions and negations decide, however few of the words they are."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    cases = {
        "Licensed under CC BY-NC 3.0.": {"CC-BY-NC-3.0"}, "Licensed under CC BY-NC 2.5.": {"CC-BY-NC-2.5"}, "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": {"CC-BY-3.0"},
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"}, "Licensed under the Apache License, Version 1.1.": {"Apache-1.1"}, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": {"MPL-1.1"},
        "This project is licensed under the BSD License.": {"BSD"}, "This project is not licensed under the MIT License.": set(), "Licensed under the Apache License, Version 7.3.": set(), "SPDX-License-Identifier: MIT": {"MIT"}, "The MIT License (MIT)": {"MIT"},
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": {"Apache-2.0"}, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": {"GPL-3.0"}, "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": {"LGPL-3.0"},
    }
    assert {text: told(scanner, text) for text in cases} == cases
