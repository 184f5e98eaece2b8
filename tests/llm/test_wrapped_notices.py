from spanweave.llm import licenses

GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:"""


def test_wrapped_notices_and_whole_mit(spark):
    rows = [(1, "a/x.py", "import os\n\n" + GPL + "\nprint(1)"), (2, "b/y.c", "/*\n" + BSD + "\n */"), (3, "c/LICENSE", "MIT License\n\nCopyright (c) 2020 A\n\n" + dict(licenses.WHOLE)["MIT"][12:]), (4, "c/d/z", "prose"), (5, "e/v", "of this license\nand of that software\nwords")]
    rows += [(k, f"p{k}/t", f"plain text number {k}\nof many words") for k in range(10, 40)]
    got = {r.doc_id: (r.own_license, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("GPL-3.0", "GPL-3.0") and got[2] == ("BSD-3-Clause", "BSD-3-Clause") and got[3] == ("MIT", "MIT") and got[4] == (None, "MIT")
    assert got[5] == (None, None) and all(got[k] == (None, None) for k in range(10, 40))
