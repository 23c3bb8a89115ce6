"""Licence texts as they stand in files, and training with texts beyond the byte bound."""

from __future__ import annotations

import pytest

from tessera.llm import license_scan, quality_cnn

GPL = "the terms of the GNU General Public License"
TEXTS = {
    "bsd-3": ("Copyright (c) 2020, Someone\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n", "bsd-3-clause"),
    "gpl-2 in one sentence": (f"This program is free software: you can redistribute it and/or modify it under {GPL} as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", "gpl-2.0"),
    "gpl-2 short": (f"This program is free software: you can redistribute it and/or modify it under {GPL} version 2.", "gpl-2.0"),
    "gpl-2 or later": (f" * This program is free software; you can redistribute it and/or modify\n * it under {GPL} as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.", "gpl-2.0"),
    "gpl-2 only": (f"This program is free software; you can redistribute it and/or modify\nit under {GPL} version 2 as\npublished by the Free Software Foundation.", "gpl-2.0"),
    "gpl-2 only, apart": (f"This program is free software; you can redistribute it and/or modify it under {GPL} as published by the Free Software Foundation; version 2 of the License.", "gpl-2.0"),
    "gpl-3": (f"# This program is free software: you can redistribute it and/or modify\n# it under {GPL} as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", "gpl-3.0"),
    "gpl-3, semicolons": (f"This program is free software; you can redistribute it and/or modify it under {GPL} as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "gpl-3.0"),
    "no version": (f"This program is free software: you can redistribute it and/or modify it under {GPL}.", ""),
    "later alone": ("At your option any later version.", ""),
    "reserved": ("Copyright 2020 Foo Inc. All rights reserved.", "proprietary"),
    "reserved, then a licence": ("Copyright 2020 Foo Inc. All rights reserved.\nLicensed under the MIT License\n", "mit"),
    "negated": ("This file is not licensed under the GNU General Public License version 2.", ""),
}


def test_licence_texts(spark):
    rows = license_scan.scan_licenses(spark.createDataFrame([(k, v) for k, (v, _) in TEXTS.items()], "doc_id string, text string")).collect()
    assert {r.id: ",".join(r.licenses) for r in rows} == {k: v for k, (_, v) in TEXTS.items()}


@pytest.mark.parametrize("most", [1_000, 4_000, 50_000])
def test_texts_beyond_the_bound_are_passed_over(spark, most):
    """One long text early in hash order takes nothing from the others, and both classes stay."""
    docs = [(i, "good words here " * 30 if i % 2 else "bad $$ bits " * 40) for i in range(60)] + [(i, "x" * 200_000) for i in range(60, 64)]
    labels = [(i, i % 2) for i in range(64)]
    net = quality_cnn.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), max_bytes=most)
    assert isinstance(net, quality_cnn.Network)


def test_only_long_texts_leave_the_shortest_of_each_class(spark):
    docs = [(i, "a b c " * (1000 + i)) for i in range(6)]
    net = quality_cnn.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int"), max_bytes=10)
    assert isinstance(net, quality_cnn.Network)
