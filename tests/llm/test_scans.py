import base64
import gzip
import hashlib
import re
import time
import zlib
from urllib.parse import quote

import pytest

from quern.llm.op08_licenses import MARK, OWN_PHRASES, OWN_TEMPLATES, TEMPLATES, Automaton, compiled, scan_licenses, wordings, words_of
from quern.llm.op09_secrets import Scan, find_secrets, masked, redact_secrets
from quern.llm.queries import op8_licenses, op9_secrets
from quern.session import table

from .cases import AWKWARD, SCHEMA, awkward, empty, with_clashes

SF = "/root/testdata/sf0.001"
PLAIN = {
    "assign": r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= (18 if kind == "access" else 16):
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def spans(text):
    return {(a, b, k): d for (a, b, k), d in Scan(text, 1 << 20).spans.items()}


SECRET = "password = 'Zq81mmKx02Lp77'"


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: quote(s, safe=""),
        lambda s: quote(quote(s, safe=""), safe=""),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(zlib.compress(base64.b64encode(s.encode()))).decode(),
        lambda s: quote(base64.b64encode(("é" + s).encode()).decode(), safe=""),
    ],
)
def test_wrapped_secrets_are_mapped_to_their_place(wrap):
    text = "vor ë " + wrap(SECRET) + " nach"
    found = {k: d for k, d in spans(text).items() if k[2] == 0 and d > 0}
    assert found, text
    for a, b, _ in found:
        assert 6 <= a < b <= len(text) - 5


@pytest.mark.parametrize("wrap", [lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(base64.b64encode(s.encode())).decode()])
def test_every_copy_of_a_wrapped_secret_is_found(wrap):
    code = wrap(SECRET)
    text = f"one {code} two {code}\nthree {code} end"
    hidden = masked(text, "[secret]", 1 << 20)
    assert hidden.count("[secret]") == 3 and code[8:-8] not in hidden


def code(data):
    return base64.b64encode(data).decode()


NOISE = b"".join(hashlib.sha256(bytes([k])).digest() for k in range(40))
LOUD = SECRET.encode() + b"\n" + NOISE


@pytest.mark.parametrize(
    "inner",
    [
        code(gzip.compress(gzip.compress(zlib.compress(SECRET.encode())))),
        code(gzip.compress(b"first member") + gzip.compress(SECRET.encode())),
        code(gzip.compress(b"password = 'Zq81m") + gzip.compress(b"mKx02Lp77'")),
        code(b"\xef\xbb\xbf" + SECRET.encode()),
        code("a\xa0\x0c\x00".encode() + SECRET.encode()),
        code(b"\xff\xfe\x80" + SECRET.encode()),
        code(gzip.compress(b"\x00\xff" + SECRET.encode())),
        code(SECRET.encode("utf-16")),
        code("é".encode("utf-16-be") + SECRET.encode("utf-16-be")),
        code(gzip.compress(SECRET.encode("utf-16-le"))),
        code(SECRET.encode("utf-32-le")),
        code(b"\x01\x02head" + gzip.compress(SECRET.encode())),
        code(gzip.compress(LOUD))[:-40],
        base64.encodebytes(gzip.compress(LOUD)).decode().strip(),
        base64.encodebytes(gzip.compress(LOUD)).decode().strip().replace("\n", "\\n"),
        base64.encodebytes(b"." * 50 + SECRET.encode()).decode().strip(),
        *(prefix + code(data) for prefix in ("a/", "ab-", "abc_", "path/x+") for data in (SECRET.encode(), gzip.compress(SECRET.encode()))),
    ],
)
def test_layers_of_every_make_are_scanned(inner):
    text = "vor ë " + inner + " nach"
    found = [x for x in spans(text) if x[2] == 0]
    assert found and all(6 <= a < b <= len(text) - 5 for a, b, _ in found)


def test_places_in_bytes_that_are_no_text():
    text = "x " + code(b"\xff\xfe\x80" * 10 + "é".encode() + SECRET.encode())
    a, b = next((a, b) for a, b, k in spans(text) if k == 0)
    assert a == 2 + 32 // 3 * 4 and len(text) - 8 <= b <= len(text)


def test_large_layers_are_scanned_in_chunks(monkeypatch):
    for name, value in {"WHOLE": 60_000, "CHUNK": 20_000, "OVERLAP": 1_000}.items():
        monkeypatch.setattr(f"quern.llm.op09_secrets.{name}", value)
    for at in (0, 59_990, 100_000, 119_995, 300_000):
        for pack in (lambda d: d, gzip.compress):
            data = b". " * (at // 2) + b"\n" + SECRET.encode() + b"\n" + b", " * (150_000 - at // 2)
            scan = Scan("x " + code(pack(gzip.compress(data))) + " y")
            assert [k for _, _, k in scan.spans] == [0] and not scan.unfinished
    many = Scan("x " + code(gzip.compress(b". " * 40_000 + code(SECRET.encode()).encode() + b" ." * 90_000)))
    assert any(k == 0 for _, _, k in many.spans)


def test_url_layer_maps_single_characters():
    text = "a%20token%3D%22" + "k" * 14 + "%22"
    assert (4, 29, 0) in spans(text) and text[4:29] == "token%3D%22" + "k" * 14


def test_cycles_bombs_and_clean_text_end():
    assert not spans("%41%25%34%31 \\u005cu0041 plain")
    bomb = base64.b64encode(zlib.compress(b"a" * 5_000_000)).decode()
    scan = Scan(bomb, 1 << 20)
    assert scan.unfinished and not scan.spans
    began = time.time()
    Scan(("%2541 " * 20_000), 1 << 20)
    assert time.time() - began < 20


def test_dropped_matches_still_take_their_text():
    assert base("token: secret : abcdefghijklmnop") == [] == [x for x in spans("token: secret : abcdefghijklmnop")]


def test_masked():
    assert masked(f"x {SECRET} y", "[secret]", 1 << 20) == "x [secret]' y"
    assert masked("clean", "[secret]", 1 << 20) == "clean"


def test_secret_query_against_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = op9_secrets(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in PLAIN)


def test_secrets_of_awkward_rows(spark):
    rows = find_secrets(with_clashes(awkward(spark))).collect()
    assert len(rows) == len(AWKWARD) and find_secrets(empty(spark)).count() == 0
    docs = with_clashes(awkward(spark))
    assert redact_secrets(docs).schema == docs.schema and sorted(map(str, redact_secrets(docs).collect())) == sorted(map(str, docs.collect()))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_license(text):
    w = WORD.findall(low(text))
    found = [(k, label) for p, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def as_pattern(template):
    """A template as a pattern over words that a blank follows each."""
    out, last = "", 0
    for m in [*MARK.finditer(template), None]:
        out += "".join(f"{w} " for w in words_of(template[last : m.start() if m else None]))
        if m:
            last, kind = m.end(), m[1]
            out += "(?:" if kind == "beginOptional" else ")?" if kind == "endOptional" else r"(?:\S+ ){%s,%s}" % (m[2], m[3])
    return re.compile(r"(?<!\S)" + out)


def mandatory(template):
    return set(words_of(MARK.sub(" ", re.sub(r"(?s)<<beginOptional>>.*?<<endOptional>>", " ", template.replace("<<beginOptional>>this <<var;min=1;max=3>> is<<endOptional>>", " ")))))


def test_license_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    patterns = [(label, as_pattern(t), mandatory(t)) for label, t in OWN_TEMPLATES]
    seen = set()
    for r in op8_licenses(spark, SF).collect():
        n, *rest, base_labels = brute_license(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, *rest, base_labels)
        words = WORD.findall(low(texts[r.doc_id]))
        line = "".join(f"{w} " for w in words)
        labels = {x for x in base_labels.split(",") if x} | {label for label, p, _ in patterns if p.search(line)}
        seen |= labels
        assert r.labels == ",".join(sorted(labels))
        assert r.score == (1.0 if labels else pytest.approx(max(len(m & set(words)) / len(m) for _, _, m in patterns) / 2))
    assert seen


SAID = {
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either": "lgpl",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http": "mpl-2",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2",
    "The data is in the public domain.": "public-domain",
    "// SPDX-License-Identifier: BSD-3-Clause": "bsd",
    "# SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
    "/* SPDX-License-Identifier: CC-BY-NC-SA-4.0 */": "cc-by-nc-sa",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "and is made available under the terms of the Eclipse Public License v2.0 which": "epl",
    "It is under the same terms as Perl itself": "artistic",
    "a license of its own, not in the public, domain": "",
    "SPDX-License-Identifier: Own": "",
}


def test_usual_wordings(spark):
    rows = scan_licenses(spark.createDataFrame([(k, t) for k, t in enumerate(SAID)], "doc_id long, text string")).collect()
    got = {r.doc_id: ",".join(sorted({x.label for x in r.templates})) for r in rows}
    assert [got[k] for k in range(len(SAID))] == list(SAID.values())
    assert len({label for label, _ in OWN_TEMPLATES}) >= 40


def test_wordings_from_a_table(spark):
    rows = spark.createDataFrame([("own", "use it <<var;min=1;max=2>> freely"), ("own", "use it <<var;min=1;max=2>> freely"), ("none", None), (None, "x"), ("odd", "<<var;min=1;max=2>>")], "label string, text string")
    templates = wordings(rows)
    assert len(templates) == 2
    docs = spark.createDataFrame([(1, "You may use it, friend, freely."), (2, "use it freely"), (3, "under the MIT license")], "doc_id long, text string")
    got = {r.doc_id: ([p.label for p in r.templates], [p.label for p in r.phrases], r.score) for r in scan_licenses(docs, templates=templates, phrases=(("p", "the mit"),)).collect()}
    assert got == {1: (["own"], [], 1.0), 2: ([], [], 0.5), 3: ([], ["p"], 1.0)}
    with pytest.raises(ValueError, match="more than 1"):
        wordings(rows, most=1)


def test_wrapped_secrets_in_documents(spark):
    """Secrets wrapped and put into documents are found there, and nothing else is."""
    wraps = [lambda s: quote(s, safe=""), lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(base64.b64encode(s.encode("utf-16"))).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s)]
    rows, want = [], {}
    for k, r in enumerate(sorted(table(spark, SF, "documents").collect(), key=lambda r: r.doc_id)):
        text, inner = r.text or "", " " + wraps[k % len(wraps)](SECRET) + " "
        at = len(text) * (k % 7) // 7
        rows.append((r.doc_id, text[:at] + inner + text[at:]))
        want[r.doc_id] = at, at + len(inner), {(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in base(text[:at]) + [f"{x.split(':')[0]}:{int(x.split(':')[1]) + at + len(inner)}:{int(x.split(':')[2]) + at + len(inner)}" for x in base(text[at:])]}
    for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        first, last, plain = want[r.doc_id]
        found = {(s.kind, s.start, s.end) for s in r.spans if s.depth}
        assert any(kind == "assign" and first <= a < b <= last for kind, a, b in found), r.doc_id
        assert all(first <= a and b <= last for _, a, b in found)
        outside = {(s.kind, s.start, s.end) for s in r.spans if not s.depth and (s.end <= first or s.start >= last)}
        assert outside <= plain


def test_license_awkward_rows(spark):
    docs = awkward(spark).union(spark.createDataFrame([(50, "Under the\nMIT-License! apache license, version 2 CC-BY-NC cc by nc", "en", "a", 1)], SCHEMA))
    rows = scan_licenses(with_clashes(docs)).collect()
    assert len(rows) == len(AWKWARD) + 1 and scan_licenses(empty(spark)).count() == 0
    assert sorted((r.n_words, len(r.phrases)) for r in rows) == sorted(brute_license(r.text)[:2] for r in docs.collect())


def fits(template, text):
    number = compiled(OWN_PHRASES, OWN_TEMPLATES)[0]
    return Automaton(template, number).accepted([number.get(w, -1) for w in words_of(text)])


def test_automaton_optional_and_replaceable_regions():
    t = "<<beginOptional>>this <<var;min=1;max=3>> is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT license"
    assert fits(t, "Released under the MIT License.") == [(0, 5)]
    assert fits(t, "x this very fine thing is released under the terms of the mit license y") == [(1, 14)]
    assert fits(t, "this one two three four is released under the mit license") == [(6, 11)]
    assert fits(t, "released under some mit license") == [] == fits(t, "released under the terms of mit license")
    whole = " ".join(words_of(re.sub("<<[^>]*>>", " ", TEMPLATES["mit"][2])))
    assert fits(TEMPLATES["mit"][2], whole) and not fits(TEMPLATES["mit"][2], whole.replace("merge", "merged"))
