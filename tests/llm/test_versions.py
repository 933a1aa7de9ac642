"""Licence labels name the version that stands in the text, and no other."""

import pytest

from postmill.llm import licenses

AUTOMATON = licenses.Automaton(licenses.TEMPLATES, licenses.PHRASES)
LONG = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY-NC 3.0", "cc-by,cc-by-nc-3.0"),
        ("Licensed under CC BY-SA 3.0", "cc-by,cc-by-sa-3.0"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
        ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa-4.0"),
        ("This work is licensed under the GNU General Public License, version 2", "gpl,gpl-2.0"),
        ("This work is licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
        (LONG.format(2), "gpl,gpl-2.0"),
        (LONG.format(3), "gpl,gpl-3.0"),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("Licensed under the Apache License, Version 1.1", "apache-1.1"),
        ("Licensed under the Apache License, Version 7.5", ""),
        ("The contents of this file are subject to the Mozilla Public License Version 1.1", "mpl-1.1"),
    ],
)
def test_version(text, labels):
    found = licenses.scan_text(AUTOMATON, f"Foreword. {text}. Afterword.")
    assert found[5] == labels
    assert found[7] == [] if not labels else found[6] == 1.0
