import pytest

from paperloom.llm import licences

BSD = "Copyright (c) 2020, Somebody. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including'


def found(text):
    return [(x["licence"], x["first_word"]) for x in licences.find(text, tuple(licences.TEMPLATES))]


def test_bsd_in_its_own_words():
    assert found(BSD) == [("BSD", 7)]


def test_every_template_in_its_own_words():
    for t in licences.TEMPLATES:
        assert found(f"Some words. {t.text} More words.") == [(t.name, 2)], t


def test_the_same_notice_again():
    assert found("Released under the MIT License. Released under the MIT License.") == [("MIT", 0), ("MIT", 5)]
    assert found(f"{BSD} {BSD}") == [("BSD", 7), ("BSD", 7 + len(BSD.split()))]
    assert found("Licensed under CC BY 4.0. " * 4) == [("CC-BY-4.0", 5 * k) for k in range(4)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under the MIT License.", "MIT"),
        ("Released under MIT License", "MIT"),
        (APACHE, "Apache-2.0"),
        (GPL, "GPL-3.0"),
        (GPL.replace("software:", "software;").replace("version 3", "version 2"), "GPL-2.0"),
        (MIT, "MIT"),
        ("// SPDX-License-Identifier: BSD-3-Clause", "BSD"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ],
)
def test_real_notices(text, want):
    assert [x for x, _ in found(text)] == [want]


def test_other_words_are_no_notice():
    assert found("The license of the driver from MIT was renewed.") == []
    assert found("Released under the Artistic License.") == []


def test_compression_names_the_licence():
    """Of two licences whose words both confirm, the one whose template shortens the block the most, not the one with the fewest differences."""
    short = licences.Template("short", "Licensed under the Foo License.", ("foo",))
    long = licences.Template("long", "Licensed under the Foo License, with each exception that its authors have ever granted in writing to any reader.", ("foo", "exception"))
    text = f"Some words. {long.text.replace('ever', 'once')} More words."
    (notice,) = licences.find(text, (short, long))
    assert (notice["licence"], notice["first_word"], notice["differences"]) == ("long", 2, ["replace:ever:once"])
    assert notice["reduction"] == licences.ranked(licences.plain(text), (short, long))[0][1]
    (notice,) = licences.find(f"Some words. {short.text} More words.", (long, short))
    assert (notice["licence"], notice["differences"]) == ("short", [])


def test_no_confirmed_template_is_lost_behind_better_ranked_ones():
    text = f"{MIT} {APACHE} # SPDX-License-Identifier: GPL-3.0-only"
    assert [x for x, _ in found(text)] == ["MIT", "Apache-2.0", "GPL-3.0"]
