"""License scan, SimHash and decontamination against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from quire.llm import decontaminate, license_scan, simhash
from quire.llm.components import connected_components, local_roots
from tests.llm.helpers import LOW, SCHEMA, awkward_rows, frame, rows_of, sentence, space_words

# --- licenses ---------------------------------------------------------------------------


def regex_of(template: str) -> re.Pattern:
    """The same markup as a regular expression over ' w1 w2 ... '."""
    out = ""
    for part in re.split(r"(\[\[|\]\]|\{\{.*?\}\})", template):
        if part == "[[":
            out += "(?:"
        elif part == "]]":
            out += ")?"
        elif m := re.fullmatch(r"\{\{(\d+)-(\d+)\}\}", part):
            out += f"(?: [^ ]+){{{m[1]},{m[2]}}}"
        elif part.startswith("{{"):
            out += "(?:" + "|".join("".join(" " + w for w in words(x)) for x in part[2:-2].split("|")) + ")"
        else:
            out += "".join(" " + w for w in words(part))
    return re.compile(out + "(?= )")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_license_scan_against_regular_expressions(spark):
    rng = random.Random(5)
    notes = ["Licensed under the Apache License, Version 2.0.", "licensed under a CC BY-NC 4.0", "Released under the MIT License.", "GNU GENERAL PUBLIC LICENSE",
             "This is licensed under the terms of the GNU General Public License, version 3 or (at your option) any later version",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and docs, to deal in the Software without restriction",
             "copyright (c) 2020 A B all rights reserved", "the MIT License mit license", "licensed under the Apache License version 3"]
    rows = [(i, sentence(rng, 5) + " " + " ".join(rng.sample(notes, rng.randint(0, 3))) + " " + sentence(rng, 4), "en", "s", 1) for i in range(120)]
    rows += awkward_rows()
    got = license_scan.scan_licenses(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    patterns = [(label, regex_of(t)) for label, t in license_scan.TEMPLATES]
    expected = []
    for i, t, *_ in rows:
        w = words(t)
        joined = " " + " ".join(w) + " "
        places = [(label, k) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        labels = {label for label, rx in patterns if rx.search(joined)}
        expected.append((i, len(w), sorted(places), sorted(labels)))
    shown = [(r.doc_id, r.n_words, sorted(tuple(p) for p in r.places), sorted({s.label for s in r.spans})) for r in got]
    assert sorted(shown, key=repr) == sorted(expected, key=repr)


def test_spans_are_longest_and_markup_is_checked():
    a = license_scan.compile_template("x", "one [[two [[three]]]] four {{0-2}} {{five|six seven}}")
    for text, end in (("one four five", 3), ("one two four a b six seven z", 7), ("one two three four five five", 6), ("one three four five", -1), ("one two four six", -1)):
        assert a.longest(license_scan.words_of(text.encode()), 0) == end
    for bad in ("[[a", "a]]", "{{3-1}} a", "[[a]]", "{{0-2}}"):
        with pytest.raises(ValueError):
            license_scan.compile_template("bad", bad)


# --- SimHash ------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = space_words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h))


def slow_roots(fps):
    f = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
    return local_roots(len(f), a, b)


def test_simhash_classes(spark):
    rng = random.Random(9)
    rows = awkward_rows()
    base = [sentence(rng, 400).split() for _ in range(6)]
    for k in range(120):
        w = list(base[k % 6])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        rows.append((1000 + k, " ".join(w).upper() if k % 9 == 0 else " ".join(w), "en", "s", 1))
    got = simhash.near_duplicates(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    root = slow_roots(fps)
    low = {}
    for r, (i, *_) in zip(root, rows, strict=True):
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    expected = sorted(((i, f, low[r]) for (i, *_), f, r in zip(rows, fps, root, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == expected
    kept = simhash.one_per_class(frame(spark, rows, extra=True))
    assert len(kept.columns) == 20 and kept.count() == len(set(root.tolist()))


def test_golay_code_is_perfect():
    g = simhash.Golay()
    words_ = np.random.default_rng(0).integers(0, 1 << 23, 4000)
    nearest = (words_ ^ g.error[simhash.syndrome(words_)])
    assert (simhash.syndrome(nearest) == 0).all() and np.bitwise_count(nearest ^ words_).max() <= 3
    for i in range(23):  # the codeword of a word is near to all words one bit away
        assert (g.near(words_ ^ (1 << i), 23) == g.nearest(words_)[:, None]).any(axis=1).all()


@pytest.mark.parametrize("at_once", [1 << 20, 1 << 9])
def test_links_of_random_and_dense_fingerprints(monkeypatch, at_once):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    far = rng.integers(0, 2**63, 300, dtype=np.uint64)
    out = [far]
    for _ in range(3):  # chains of up to 4 flipped bits, and a dense ball
        f = out[-1].copy()
        for i in range(len(f)):
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                f[i] ^= np.uint64(1 << int(b))
        out.append(f)
    out.append(np.array([int(far[0]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(900)], np.uint64))
    fp = np.unique(np.concatenate(out))
    key, role, at = simhash.filings(fp, simhash.Golay())
    order = np.lexsort((at, role, key))
    a, b = [], []
    for x, y in simhash.links_of_sorted(key[order], role[order], at[order], 3):
        a.append(x)
        b.append(y)
    roots = local_roots(len(fp), np.searchsorted(fp, np.concatenate(a)), np.searchsorted(fp, np.concatenate(b)))
    assert np.array_equal(roots, slow_roots(fp))


def test_link_fingerprints_in_spark_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", 40)
    rng = np.random.default_rng(4)
    centre = 0x0123456789ABCDEF
    fp = np.unique(np.array([centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(400)]
                            + rng.integers(0, 2**62, 200).tolist(), np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(4)
    got = connected_components(simhash.link_fingerprints(df)).collect()
    root = {r.node % 2**64: r.root % 2**64 for r in got}
    classes: dict = {}
    for f, r in zip(fp.tolist(), slow_roots(fp).tolist(), strict=True):
        classes.setdefault(r, set()).add(f)
    found: dict = {}
    for f in fp.tolist():
        found.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, found.values()))
    with pytest.raises(ValueError):
        simhash.link_fingerprints(df, 4)


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(1, 80)] + [(500, 600 + i) for i in range(60)] + [(700, 701), (701, 702), (702, 700)] + [(5, 5), (900, 901)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    got = dict(rows_of(connected_components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    nodes = sorted({x for p in links for x in p})
    at = {n: i for i, n in enumerate(nodes)}
    want = local_roots(len(nodes), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    for n in nodes:
        assert got.get(n, n) == nodes[want[at[n]]]


# --- decontamination ------------------------------------------------------------------------


def invented(rng, n):
    return " ".join("".join(rng.choice("ba ke lo mi su ra tet von qui zal".split()) for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_leaks_verbatim_and_paraphrased(spark):
    rng = random.Random(11)
    items = [(k, invented(rng, n) + ". " + invented(rng, 8)) for k, n in enumerate([12, 20, 30, 45, 70, 130])]
    items += [(50, None), (51, ""), (52, "too short"), (0, items[0][1])]
    rows, expected = [], set()
    for i in range(80):
        text = invented(rng, rng.randint(5, 300))
        if i % 4 == 0:
            k = (i // 4) % 6
            item = items[k][1]
            if i % 8 == 4:  # paraphrase: some words before the answer replaced, punctuation and case changed
                w = item.split()
                for j in range(2, len(w) - 9, 6):
                    w[j] = invented(rng, 1)
                item = "! ".join(w).upper()
            text = text + "\n" + item + " — " + invented(rng, rng.randint(0, 200))
            expected.add((i, k))
        rows.append((i, text, "en", "s", 1))
    rows += awkward_rows()[60:]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, rows, extra=True)
    leaks = decontaminate.find_leaks(df, bench, items_per_block=4).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == expected
    clean = decontaminate.clean_documents(df, bench)
    assert clean.columns == df.columns and clean.count() == len(rows) - len({i for i, _ in expected})


def test_lcs_and_bounds():
    rng = random.Random(0)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randint(1, 20))], [rng.randrange(8) for _ in range(rng.randint(0, 40))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs_length(decontaminate.Verifier._masks(a), (1 << len(a)) - 1, b) == table[-1][-1]


def test_candidates_equal_all_cosines():
    """The bounds pass over no window that reaches the cosine."""
    rng = random.Random(6)
    items = decontaminate.Items.of([(k, invented(rng, 25)) for k in range(12)])
    texts = [invented(rng, rng.randint(1, 400)) + (" " + b" ".join(list(items.terms)[k * 20 : k * 20 + 18]).decode() if k % 3 == 0 else "") for k in range(40)]
    weight2 = np.random.default_rng(3).random(1 << decontaminate.DF_BITS).astype(np.float32) * 9
    weight = decontaminate.term_weights(items, weight2)
    latent = decontaminate.latent_items(items, weight, np.random.default_rng(1).random((len(items.terms), 8)))
    for _, _, term, w2, starts in decontaminate.Passages(items.terms, weight2).groups(texts):
        got = {(r, j, w): c for r, j, w, c in decontaminate.candidates(term, w2, starts, weight, latent, 0.3)}
        want = {}
        for r in range(len(starts) - 1):
            for w in range(starts[r], starts[r + 1] - 1):
                s = slice(w * 16, w * 16 + 32)
                t, c = np.unique(term[s][term[s] >= 0], return_counts=True)
                norm = np.sqrt(w2[s].sum(dtype=np.float64))
                cos = (np.sqrt(c) * weight[t]) @ latent[t] / norm
                want |= {(r, j, w): cos[j] for j in np.flatnonzero(cos >= 0.3)}
        assert {k for k, v in want.items() if v > 0.30001} <= set(got) and all(abs(got[k] - want[k]) < 1e-4 for k in got if k in want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "some words of a benchmark item here")], "item_id long, text string")
    assert license_scan.scan_licenses(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_per_class(docs).count() == 0
    assert decontaminate.find_leaks(docs, bench).count() == 0
    assert decontaminate.find_leaks(frame(spark, awkward_rows()), bench.limit(0)).count() == 0
