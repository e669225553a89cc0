"""Personal data, secrets and licenses: base spans against plain patterns, and what the methods add."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest

from labspark.llm import licenses, pii, secrets


def plain_pii(text):
    out = []
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    for kind, pattern in zip(pii.KINDS, patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def base(text):
    found = pii.base_spans(text)
    return [(k, *s) for k in pii.KINDS for s in found[k]]


def test_base_personal_data():
    rng = random.Random(3)
    alphabets = ["a1@.-_ ", "0123456789. ", "0123456789 -", "+0123456789 ().-", "a@.b-%1 é", "0123456789"]
    for _ in range(6000):
        letters = rng.choice(alphabets)
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert base(text) == plain_pii(text)


def test_base_personal_data_is_linear():
    for text in ("a" * 10**6, "1" * 10**6, "1." * 500_000, "@a." * 200_000, "+1 " * 200_000):
        list(pii.loose_spans(text, pii.base_spans(text)))


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("to bob (at) site (dot) com now", "email", "bob (at) site (dot) com"),
        ("call +1 (826) 555-4081 190.137.223.204 now", "phone", "+1 (826) 555-4081"),
        ("host 10[.]0[.]3[.]4 up", "ip", "10[.]0[.]3[.]4"),
        ("card 4111/1111/1111/1111 paid", "card", "4111/1111/1111/1111"),
    ],
)
def test_loose_candidates(text, kind, found):
    spans = [(k, text[a:b]) for k, (a, b) in pii.loose_spans(text, pii.base_spans(text))]
    assert (kind, found) in spans


def test_added_personal_data(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}"
        ip = ".".join(str(rng.randrange(1, 255)) for _ in range(4))
        rows.append((i, rng.choice([f"see {phone} there", f"at {ip} and", "nothing at all here", f"id {rng.randrange(10**15, 10**16)} x"])))
    rows += [(1000, "reach +1 (826) 555-4081 190.137.223.204 soon"), (1001, "plain words without data"), (1002, None)]
    found = {r.id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in found[i].base] == plain_pii(text or "")
    assert [(s.kind, s.start, s.end) for s in found[1000].added] == [(3, 6, 23)]
    assert not found[1001].added
    redacted = pii.redacted(
        spark.createDataFrame(rows[-3:], "doc_id long, text string"), pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    )
    assert {r.text for r in redacted.collect()} == {"reach [phone] [ip] soon", "plain words without data", None}


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    votes = np.stack([np.where(rng.random(4000) < right, truth, ~truth) * 2 for right in (0.95, 0.9, 0.9, 0.8, 0.8, 0.5)], axis=1)
    posterior, chance = pii.reliabilities(votes.astype(int), np.ones(4000))
    assert ((posterior > 0.5) == truth).mean() > 0.95
    right = (chance[1, :, 2] + chance[0, :, 0]) / 2
    assert right[0] > right[3] > right[5]


def plain_secrets(text):
    out = []
    keyword = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    keyword += "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    for m in re.finditer(rf"""(?:{keyword})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(5)
    bits = ["token", "secret", "PassWord", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "ABCDEFGHIJKLMNOP1234"]
    bits += ["0123456789abcdef", "x", "é", "日", "😀", "\x01", "\x02", ".", "token=token", "ſecret", "\n", "xyz12"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(14)))) for i in range(1500)]
    letters = string.ascii_letters + string.digits + "+/"
    key = "".join(rng.choice(letters) for _ in range(44))
    rows += [(-1, None), (-2, f"k {key} end"), (-3, "antidisestablishmentarianism floccinaucinihilipilification"), (-4, "a" * 60), (-5, "/".join(["home"] * 20))]
    found = {r.id: r for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        assert [(s.start, s.kind, s.end) for s in found[i].base] == plain_secrets(text or "")
    assert [(s.start, s.kind, s.end) for s in found[-2].added] == [(2, 3, 46)]
    assert not found[-3].added and not found[-4].added and not found[-5].added


def test_cut_off_follows_benjamini_and_hochberg(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(500), 10 ** -rng.uniform(4, 9, 60)])
    limit = secrets.cut_off(spark.createDataFrame([(float(x),) for x in p], "p double"), 0.05)
    ordered = np.sort(p)
    exact = ordered[ordered <= 0.05 * np.arange(1, len(p) + 1) / len(p)][-1]
    # Bins are a twentieth of a power of ten, and count as their upper end.
    assert exact / 10 ** (2 / secrets.BINS) <= limit <= exact * 10 ** (1 / secrets.BINS)
    assert secrets.cut_off(spark.createDataFrame([], "p double"), 0.05) == 0


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingle_set(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_licenses(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(1000)}" for _ in range(rng.choice([0, 5, 60, 400]))]
        name, notice = rng.choice(licenses.TEMPLATES)
        parts = notice.split()
        if rng.random() < 0.3:
            parts[rng.randrange(len(parts))] = "changed"
        if rng.random() < 0.7:
            at = rng.randrange(len(words) + 1)
            words[at:at] = parts
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "--- ... !!!"), (903, "Released under the MIT License." * 500)]
    found = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = set()
    for i, text in rows:
        for name, notice in licenses.TEMPLATES:
            share = len(shingle_set(notice) & shingle_set(text)) / len(shingle_set(notice))
            if share >= 0.8:
                want.add((i, name, round(share, 9)))
    assert {(r.id, r.template, round(r.containment, 9)) for r in found} == want
    assert len(found) == len(want) > 100


def test_licenses_of_other_versions_and_families(spark):
    fsf = "as published by the Free Software Foundation"
    either = "you can redistribute it and/or modify it under the terms of the GNU {} License " + fsf + "; either version {} of the License, or (at your option) any later version"
    rows = {
        "licensed under the GNU General Public License, version 2": {"gpl-2.0"},
        "licensed under the GNU General Public License, version 3": {"gpl-3.0"},
        "licensed under the GNU General Public License, version 4": set(),
        either.format("General Public", "2"): {"gpl-2.0-header"},
        either.format("General Public", "3"): {"gpl-3.0-header"},
        either.format("General Public", "4"): set(),
        either.format("Lesser General Public", "2.1"): {"lgpl-2.1-header"},
        either.format("Lesser General Public", "3"): {"lgpl-3.0-header"},
        either.format("Affero General Public", "3"): {"agpl-3.0-header"},
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": {"lgpl-3.0"},
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": {"gpl-3.0-title"},
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": {"gpl-2.0-title"},
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl-2.0"},
        "Licensed under the Apache License, Version 1.1": set(),
        "Licensed under CC BY-SA 4.0": {"cc-by-sa-4.0"},
        "Licensed under CC BY-SA 3.0": set(),
    }
    texts = list(rows)
    docs = spark.createDataFrame([(i, f"some words before it. {t} and some words after it") for i, t in enumerate(texts)], "doc_id long, text string")
    found = {t: set() for t in texts}
    for r in licenses.license_matches(docs).collect():
        found[texts[r.id]].add(r.template)
    assert found == rows
    # A template's own text is found as no other version or family.
    docs = spark.createDataFrame(list(licenses.TEMPLATES), "doc_id string, text string")
    assert {(r.id, r.template) for r in licenses.license_matches(docs).collect()} == {(n, n) for n, _ in licenses.TEMPLATES}


def test_odd_rows(odd, odd_rows, empty):
    n = len(odd_rows)
    assert pii.personal_data(odd).count() == n
    assert secrets.secrets(odd).count() == n
    assert licenses.license_matches(odd).count() == 0
    for table in (pii.personal_data(empty), secrets.secrets(empty), licenses.license_matches(empty)):
        assert table.count() == 0
