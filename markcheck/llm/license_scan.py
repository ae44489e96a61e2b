"""License scans: templates found in texts by MinHash bands, verified by shingle containment.

Texts are read in overlapping windows, sized by the templates: of every occurrence of a template, one window holds
it whole with little around it. Bands are set so that a window which contains the template to the asked degree
collides in one of them with at least the asked probability; what collides is verified by exact containment of
word shingles. Only windows with some template shingle can pass that, so the others are not sketched.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markcheck.llm.decontamination import words_of
from markcheck.llm.shingles import WIDTH, gram_hashes, mix, word_hashes

#: Containment that counts as a match, and probability of collision for it.
CONTAINMENT, PROBABILITY = 0.75, 0.9999
ROWS = 2

# Public licence notices, short full texts, and title lines of long ones.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 3 as published by the Free Software Foundation."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-ND-3.0", "Licensed under CC BY-ND 3.0."),
    ("CC-BY-ND-3.0", "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License."),
    ("CC-BY-NC-3.0", "Licensed under CC BY-NC 3.0."),
    ("CC-BY-NC-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License."),
    ("CC-BY-NC-SA-3.0", "Licensed under CC BY-NC-SA 3.0."),
    ("CC-BY-NC-SA-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."),
    ("CC-BY-NC-ND-3.0", "Licensed under CC BY-NC-ND 3.0."),
    ("CC-BY-NC-ND-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Licensed under the ISC License."),
)

_U = np.uint64


class Templates:
    """Templates by length class with their band index."""

    def __init__(self, templates: Sequence[tuple[str, str]], containment: float, probability: float):
        self.names = [n for n, _ in templates]
        self.sets, lengths = [], []
        for _, text in templates:
            words = words_of(text.encode())
            if len(words) < WIDTH:
                raise ValueError(f"a template needs {WIDTH} words: {text!r}")
            self.sets.append(np.unique(gram_hashes(word_hashes(words))))
            lengths.append(len(words))
        self.containment = containment
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, _U)
        by_class = defaultdict(list)
        for i, n in enumerate(lengths):
            by_class[math.ceil(2 * math.log2(n))].append(i)
        self.classes = []
        for members in by_class.values():
            longest = max(lengths[i] for i in members)
            stride = max(1, longest // 4)
            window = longest + stride
            # a window's shingles, of which the template's share is least for the shortest template
            fewest = min(len(self.sets[i]) for i in members)
            alike = containment * fewest / (window - WIDTH + 1 + (1 - containment) * fewest)
            bands = math.ceil(math.log(1 - probability) / math.log(1 - alike**ROWS))
            seeds = mix(np.arange(1, bands * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
            index = defaultdict(list)
            for i in members:
                for key in self.keys(self.sets[i], seeds):
                    index[key].append(i)
            self.classes.append((window, stride, seeds, dict(index)))

    @staticmethod
    def keys(shingles: np.ndarray, seeds: np.ndarray) -> list[tuple]:
        least = mix(shingles[None, :] ^ seeds[:, None]).min(1).reshape(-1, ROWS)
        return [(band, *row) for band, row in enumerate(least.tolist())]

    def find(self, text: bytes | None) -> list[tuple[str, int, int, float]]:
        """(name, first word, end word, containment) of every match; overlapping matches of a template are one, the best."""
        words = words_of(text)
        grams = gram_hashes(word_hashes(words))
        places = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)] == grams) if len(self.known) else []
        if not len(places):
            return []
        best: dict[int, list] = defaultdict(list)
        for window, stride, seeds, index in self.classes:
            size = window - WIDTH + 1
            low = np.maximum(0, -(-(places - size + 1) // stride))
            starts = np.unique(np.concatenate([low + k for k in range(-(-size // stride) + 1)]))
            for start in (starts * stride).tolist():
                if start >= len(grams) or not ((places >= start) & (places < start + size)).any():
                    continue
                inside = grams[start : start + size]
                seen = np.unique(inside)
                for i in {i for key in self.keys(seen, seeds) for i in index.get(key, ())}:
                    share = len(np.intersect1d(seen, self.sets[i], assume_unique=True)) / len(self.sets[i])
                    if share >= self.containment:
                        hit = start + np.flatnonzero(np.isin(inside, self.sets[i]))
                        best[i].append((int(hit[0]), int(hit[-1]) + WIDTH, share))
        out: list[tuple[str, int, int, float]] = []
        for i, found in best.items():
            kept: list[tuple[int, int, float]] = []
            for hit in sorted(set(found)):
                if kept and hit[0] < kept[-1][1]:
                    kept[-1] = max(kept[-1], hit, key=lambda x: (x[2], x[0] - x[1], -x[0]))
                else:
                    kept.append(hit)
            out += [(self.names[i], *k) for k in kept]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def best(hits: Sequence[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of matches in one place (half of the shorter one in common), the best contained, then the longest."""
    kept: list[tuple[str, int, int, float]] = []
    group: list[tuple[str, int, int, float]] = []

    def settle() -> None:
        chosen: list[tuple[str, int, int, float]] = []
        for hit in sorted(group, key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])):
            if all(2 * (min(hit[2], c[2]) - max(hit[1], c[1])) < min(hit[2] - hit[1], c[2] - c[1]) for c in chosen):
                chosen.append(hit)
        kept.extend(sorted(chosen, key=lambda x: (x[1], x[2], x[0])))
        group.clear()

    end = -1
    for hit in sorted(hits, key=lambda x: x[1]):  # groups of overlapping matches, so that a long text costs no square
        if hit[1] >= end:
            settle()
        group.append(hit)
        end = max(end, hit[2])
    settle()
    return kept


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
            rows = [(k, *hit) for k, text in enumerate(texts) for hit in best(shared.value.find(text))]
            ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types))], ["doc_id", "license", "start_word", "end_word", "containment"])

    return run


def licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, probability: float = PROBABILITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per template occurrence: ``doc_id, license, start_word, end_word, containment``; no shuffle.

    ``templates`` are (name, text) pairs, a short list given by the caller. Words are lower-cased runs of letters
    and digits. Null, empty and short texts give no rows; repeated rows repeat their matches; of templates
    that match in one place the best contained is given, then the longest; other columns are ignored; a text of any length is read whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates, containment, probability))
    return rows.mapInArrow(_scan(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, license string, start_word long, end_word long, containment double")
