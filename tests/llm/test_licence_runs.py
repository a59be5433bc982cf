import pytest

from vaultlens.llm import license_scan

PROSE = "\n".join("the quick fox of the hill went to see a lake and " + w for w in ("one", "two", "three"))
CASES = {
    "all-rights-reserved": "All rights reserved.",
    "mit": "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "apache-2.0": " * Licensed under the\n * Apache License,\n * Version 2.0",
    "gpl-3.0": "// SPDX-License-Identifier: GPL-3.0-or-later",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, f"{PROSE}\n{text}\n{PROSE}") for name, text in CASES.items()] + [("none", PROSE)]
    return {r["path"]: r["licence"] for r in license_scan.own_licences(spark.createDataFrame(rows, "path string, text string")).collect()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_wrapped_and_short_notices(found, name):
    assert found.get(name) == name and "none" not in found
