import random
import textwrap
import time

import pytest

from tesserae.llm import licenses
from tests.llm.conftest import odd_rows


def test_notices_are_confirmed_by_wording(spark, docs_of):
    cases = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "licensed under cc by-sa 4.0": "CC-BY-SA-4.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": None,
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Licensed under the Apache License, Version 1.1.": None,
        "All rights reserved.": None,
    }
    rows = [(i, f"some words\nmore words\n{line}\nthe end") for i, line in enumerate(cases)]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(rows)).collect()}
    for i, (line, name) in enumerate(cases.items()):
        assert [b.license for b in got[i]] == [name], line
        assert rows[i][1][got[i][0].start : got[i][0].end] == line


def test_whole_notices_and_odd_rows(spark, docs_of):
    mit = licenses.TEMPLATES[2][1]
    rows = odd_rows() + [(30, f"header\n{mit[:120]}\n{mit[120:]}\nfooter"), (31, mit.replace("free of charge", "for a fee"))]
    got = licenses.scan(docs_of(rows)).collect()
    by = {r.doc_id: [b.license for b in r.licenses] for r in got}
    assert len(got) == len(rows) and by[30] == ["MIT"] and by[1] == []
    assert licenses.scan(docs_of([])).count() == 0


def test_notices_wrapped_as_in_real_files(spark, docs_of):
    rows, names, notices = [], [], []
    for width in (30, 50, 72):
        for name, notice in licenses.TEMPLATES:
            if len(notice) > width:
                for mark in ("", " * ", "# "):
                    wrapped = "\n".join(mark + line for line in textwrap.wrap(notice, width, break_on_hyphens=False))
                    rows.append((len(rows), f"first words\nmore words\n{wrapped}\nthe end of it\nlast words\n"))
                    names.append(name)
                    notices.append(wrapped)
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(rows)).collect()}
    for i, (name, notice) in enumerate(zip(names, notices, strict=True)):
        assert [b.license for b in got[i]] == [name], notice
        assert rows[i][1][got[i][0].start : got[i][0].end] == notice


def test_the_length_of_the_line_does_not_matter(spark, docs_of):
    rng = random.Random(5)
    cases = [(name, notice, n) for name, notice in licenses.TEMPLATES for n in (500, 1000, 4000, 100_000)]
    rows = []
    for i, (_, notice, n) in enumerate(cases):
        prose = " ".join("".join(rng.choices("aeiorstlnm", k=rng.randrange(2, 9))) for _ in range(n // 5))[:n]
        rows.append((i, f"{prose[: n // 2]} {notice} {prose[n // 2 :]}"))
    got = {r.doc_id: [b.license for b in r.licenses] for r in licenses.scan(docs_of(rows)).collect()}
    for i, (name, notice, n) in enumerate(cases):
        assert got[i] == [name], (notice, n)


def test_foreign_names_and_figures_tell_licenses_apart(spark, docs_of):
    header, bsd = licenses.TEMPLATES[6][1], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    cases = {
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        header: "GPL-3.0-or-later",
        header.replace("GNU", "GNU Affero"): "AGPL-3.0-or-later",
        header.replace("GNU", "GNU Lesser"): "LGPL-3.0-or-later",
        header.replace("version 3", "version 3 (not 2)"): None,
        "Released under the Apache or the MIT License.": None,
        "Licensed by us under the Apache License, Version 2.0.": "Apache-2.0",
        f"{bsd}\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "BSD-3-Clause",
    }
    got = {r.doc_id: [b.license for b in r.licenses] for r in licenses.scan(docs_of(list(enumerate(cases)))).collect()}
    for i, (line, name) in enumerate(cases.items()):
        assert got[i] == [name], line


def test_several_licenses_denials_and_identifiers(spark, docs_of):
    bsd2 = next(t for n, t in licenses.NOTICES if n == "BSD-2-Clause")
    cases = {
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.": ["MIT", "Apache-2.0"],
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.": ["MIT", "Apache-2.0"],
        "This is NOT released under the MIT License.": [None],
        "It was never licensed under CC BY 4.0.": [None],
        "Do not ask. Released under the MIT License.": ["MIT"],
        "SPDX-License-Identifier: BSD-2-Clause": ["BSD-2-Clause"],
        "// SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0-or-later"],
        "This work is dedicated to the public domain under CC0 1.0 Universal.": ["CC0-1.0"],
        bsd2: ["BSD-2-Clause"],
        bsd2 + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": ["BSD-3-Clause"],
        "Copyright 2020 Someone. All rights reserved.\n\nLicensed under CC BY 4.0.": ["CC-BY-4.0"],
    }
    rows = [(i, f"some words\nmore words\n{text}\nthe end") for i, text in enumerate(cases)]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(rows)).collect()}
    for i, (text, names) in enumerate(cases.items()):
        assert [b.license for b in got[i]] == names, text
        assert all(a.end <= b.start for a, b in zip(got[i], got[i][1:], strict=False))


def test_savings_and_differences_against_plain_ones():
    import difflib

    import zstandard

    scanner, rng = licenses.Scanner(licenses.TEMPLATES), random.Random(9)
    for k, (_, notice) in enumerate(licenses.TEMPLATES):
        own = licenses.words(notice)
        for drop in (0, 1, 3):
            kept = [w for j, w in enumerate(own) if j not in set(rng.sample(range(len(own)), min(drop, len(own) - 1)))]
            window = " ".join(kept)
            cover, missing, foreign, first, last = scanner.compare(kept, k)
            plain = sum(m.size for m in difflib.SequenceMatcher(None, kept, own, autojunk=False).get_matching_blocks())
            assert cover <= plain / len(own) + 1e-9 and round(cover * len(own)) + len(missing) == len(own) and len(foreign) <= last - first + 1
            raw = window.encode()
            given = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(notice.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            alone = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
            assert scanner.saving(window, k) == 1 - len(given.compress(raw)) / len(alone.compress(raw))
            if drop == 0:
                assert cover == 1 and not missing and not foreign


@pytest.mark.parametrize("line", ["Released under the MIT License.\n", "Licensed under the Apache License, Version 2.0 (the \"License\").\n"])
def test_ten_thousand_notices_of_one_text(line):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    began = time.time()
    found = scanner.entries(line * 10_000)
    assert time.time() - began < 15
    assert len({e["license"] for e in found}) == 1 and found[0]["license"]
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:], strict=False))


def test_compression_chooses_what_is_compared_and_loses_nothing_confirmed(monkeypatch):
    scanner, rng = licenses.Scanner(licenses.TEMPLATES), random.Random(17)
    prose = [f"{a}{b}" for a in ("on", "er", "the", "in") for b in ("tion", "ble", "shire", "and")]
    for k, own in enumerate(scanner.words):
        for _ in range(60):
            out = set(rng.sample(range(len(own)), rng.randint(0, len(own) // 10)))
            body = [w for j, w in enumerate(own) if j not in out]
            for _ in range(rng.randint(0, licenses.spare(own))):
                body.insert(rng.randint(1, max(1, len(body) - 1)), rng.choice(prose))
            around = [rng.choice([prose, scanner.words[rng.randrange(len(scanner.words))]]) for _ in range(2)]
            window = [rng.choice(around[0]) for _ in range(rng.randint(0, scanner.reach[k]))] + body * rng.randint(1, 2) + [rng.choice(around[1]) for _ in range(rng.randint(0, len(own)))]
            if scanner.compare(window, k)[0] >= licenses.COVER:
                assert scanner.saved(window, k) >= licenses.LEAST_SAVED, (k, window)

    text = "The license talk.\nReleased under the MIT License.\nWhoever has permission may go on.\n"
    seen, compare = [], scanner.compare
    monkeypatch.setattr(scanner, "compare", lambda window, k: seen.append((tuple(window), k)) or compare(window, k))
    assert [e["license"] for e in scanner.entries(text)] == ["MIT"]
    assert seen and all(scanner.saved(list(w), k) >= licenses.LEAST_SAVED for w, k in seen)
    # Where nothing saves enough, nothing is compared, whatever words there are.
    seen.clear()
    monkeypatch.setattr(licenses, "LEAST_SAVED", 2.0)
    other = licenses.Scanner(licenses.TEMPLATES)
    monkeypatch.setattr(other, "compare", lambda window, k: seen.append(k) or compare(window, k))
    assert [e["license"] for e in other.entries(text)] == [None] and not seen
