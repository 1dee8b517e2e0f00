"""The licence scan on notices that the trainer does not make, wrapped and commented ones among them."""

import numpy as np
import pyarrow as pa

from docsafe.llm import license_scan as L

NOTICES = {
"GPL": ["This file is part of Foo.\n\nFoo is free software: you can redistribute it and/or modify it under the terms of\nthe GNU General Public License as published by the Free Software Foundation, either\nversion 3 of the License, or (at your option) any later version.", "This software is distributed under the GNU General Public License v2.0."],
"LGPL": ["# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.", "The library is available under the GNU Lesser General Public License."],
"AGPL": ["This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "The server is released under the GNU Affero General Public License v3."],
"MIT": ["The MIT License (MIT)\n\nCopyright (c) 2015 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.", "This project is released under the MIT License, see LICENSE."],
"Apache-2.0": [" * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0", "All code here is licensed under the Apache License 2.0."],
"BSD": ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "The code is available under the 3-clause BSD license."],
"ISC": ["Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "This package is licensed under the ISC license."],
"CC-BY": ["This article is licensed under a Creative Commons Attribution 4.0 International License, which permits use and sharing.", "Text is licensed under CC BY 4.0 unless noted."],
"CC-BY-SA": ["Text is available under the Creative Commons Attribution-ShareAlike License 4.0; additional terms may apply.", "Images are licensed under CC BY-SA 4.0."],
"CC-BY-NC": ["This report is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.", "Data licensed under CC BY-NC 4.0."],
"CC0": ["To the extent possible under law, Jane Doe has waived all copyright and\nrelated or neighboring rights to this dataset.", "The data are released under CC0 1.0."],
"EPL": ["This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License v2."],
"MPL-2.0": ["/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", "The module is licensed under the Mozilla Public License 2.0."],
"Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Released under the Unlicense."],
}
OTHER = ["The restaurant lost its licence in May after a second inspection.\nThe owners said they would apply again.","Copyright 2020 Example Corp. All rights reserved. No part of this book may be reproduced.","Public libraries are free of charge to any person who lives in the city.","The general public is granted permission to use the park\nfor any purpose without a fee.","You must accept the terms of service before you can use this software.","Students of MIT released a report under the supervision of the faculty.","The eclipse was visible to the public under clear skies."]


def families(text):
    _, flat, run = L.paragraphs(pa.array([text]))
    return {x["family"] for _, _, x in L.findings(flat, run) if x["confirmed"]}


def test_notices():
    """All but one, whose wording no template holds; none is taken for another family."""
    got = [(k, families(t)) for k, v in NOTICES.items() for t in v]
    assert set(NOTICES) == set(L.FAMILIES) and all(f <= {k} for k, f in got)
    assert sum(f == {k} for k, f in got) >= len(got) - 1
    assert not any(families(t) for t in OTHER)


def test_wrapped_amid_other_lines():
    notice = NOTICES["LGPL"][0]
    for before in range(0, 14, 3):
        text = "\n".join(["some words that end no sentence"] * before + [notice] + ["and some more of them"] * 9)
        assert families(text) == {"LGPL"}, before


def test_paragraphs():
    owner, flat, run = L.paragraphs(pa.array(["a b\nc.\nd\n\n \ne", None, "", "f\ng"]))
    assert owner.tolist() == [0, 0, 0, 0, 3, 3] and run.tolist() == [0, 0, 1, 2, 3, 3]
    assert flat.to_pylist() == ["a b", "c.", "d", "e", "f", "g"]
    owner, flat, run = L.paragraphs(pa.array([None, ""], pa.string()))
    assert len(flat) == 0


def test_windows():
    """Every line of a run of two and more is read, and every half window and one line of a run lies in one window."""
    sizes = [1, 2, 7, 8, 9, 12, 13, 40, 1]
    run = np.repeat(np.arange(len(sizes)), sizes)
    first, n = L.windows(run)
    spans = list(zip(first.tolist(), n.tolist(), strict=True))
    assert all(k <= L.WINDOW and run[f] == run[f + k - 1] for f, k in spans)
    for i in range(len(run)):
        j = i + L.WINDOW // 2
        if j < len(run) and run[i] == run[j]:
            assert any(f <= i and j < f + k for f, k in spans)
    assert {x for f, k in spans for x in range(f, f + k)} == {i for i in range(len(run)) if sizes[run[i]] > 1}
    flat = pa.array([str(i) for i in range(len(run))])
    assert L.joined(flat, first, n).to_pylist() == [" ".join(map(str, range(f, f + k))) for f, k in spans]
