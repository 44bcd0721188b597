"""License scans: common licenses are found under their own names."""

from __future__ import annotations

import pytest

from lattica.llm import license_scan

INDEX = license_scan.Index(license_scan.TEMPLATES)


def names(text):
    return [x["license"] for x in license_scan.licenses_of(text, INDEX, 0.8, 4)]


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_each_text_is_found_under_its_name(name):
    assert name in names(f"some words before\n{license_scan.TEMPLATES[name]}\nand after")


def test_relatives_are_told_apart():
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    assert names(gnu.format("Affero General Public License", 3)) == ["AGPL-3.0-notice"]
    assert names(gnu.format("Lesser General Public License", 3)) == ["LGPL-3.0-notice"]
    assert names(gnu.format("General Public License", 2)) == ["GPL-2.0-notice"]
    assert names("Licensed under CC BY-NC 4.0") == ["CC-BY-NC-4.0"] and names("Licensed under CC BY 4.0") == ["CC-BY-4.0"]
    assert "BSD-3-Clause" not in names(license_scan.TEMPLATES["BSD-2-Clause"]) and "BSD-2-Clause" not in names(license_scan.TEMPLATES["BSD-3-Clause"])
