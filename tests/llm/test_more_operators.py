"""Spelling groups, removal of repeated byte strings and the filter audit, each against a plain version."""

import random

import pytest
from pyspark import cloudpickle

from annolith.llm import filter_audit, spelling, suffix_dedup
from tests.llm import brute


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str)


def frame(spark, rows, parts=4):
    """With an extra column and two whose names clash with results."""
    return spark.createDataFrame([(d, t, s, 7, "x") for d, t, s in rows], "doc_id long, text string, source string, n int, word string").repartition(parts)


def spelling_rows():
    draw = random.Random(8)
    base = ["information", "government", "Straßenbahn", "Éléphants", "éléphants", "aaaaaaaaaa", "abcdefg", "abcdefh", "bookkeeper", "necessary", "short"]
    rows = [(i, " ".join(draw.choice(base[:3] + base) for _ in range(draw.randrange(1, 60)))) for i in range(150)]
    for w in base:
        for _ in range(6):
            k = draw.randrange(len(w))
            rows.append((draw.randrange(1000), " ".join(draw.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k + 1 :], w[:k] + w[k] + w[k:], w + "s"]) for _ in range(3))))
    long = "".join(draw.choice("abc") for _ in range(3000))
    rows += [(2000 + k, f"{long} {long} {long[:1500]}z{long[1501:]} {long[:1500]}z{long[1501:]} {long}y,{long}y") for k in range(2)]
    return [*rows, (None, "information Information INFORMATION"), (None, None), (5, ""), (6, " \n　 123 "), (7, rows[0][1]), (7, rows[0][1])]


def test_spelling(spark):
    rows = spelling_rows()
    docs = frame(spark, [(d, t, None) for d, t in rows])
    got = spelling.groups(spelling.counted(docs))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute.spelled(rows)
    assert any(r[2] != r[1] and r[1] for r in expected) or sum(r[1] is not None for r in expected) > 20
    same(got, expected)
    assert spelling.groups(spelling.counted(docs.limit(0))).count() == 0


def test_spelling_chains_ties_and_radix_buckets(spark, monkeypatch):
    """Forms of forms; equal counts; several radix buckets, and small batches."""
    monkeypatch.setattr(spelling, "BUCKET_KEYS", 20)
    monkeypatch.setattr(spelling, "AT_ONCE", 30)
    words = {"aaaaaaaa": 2, "baaaaaaa": 20, "bbaaaaaa": 200, "bbbaaaaa": 2000, "bbbbaaaa": 20_000, "bbbbbaaa": 200_000, "tiesofone": 3, "tiesofon": 30, "tiesofona": 30, "tiesofonb": 30, "loneword": 9}
    got = {r.word: r for r in spelling.groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert {got[w].root for w in words if set(w) == {"a", "b"}} == {"bbbbbaaa"}
    assert (got["tiesofone"].form, got["tiesofone"].n_near, got["loneword"].n_near, got["loneword"].root) == ("tiesofon", 3, 0, "loneword")


def test_spelling_survives_hash_collisions(spark, monkeypatch):
    import numpy as np

    real = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda words: (np.zeros(len((found := real(words))[0]), np.uint64), *found[1:]))
    cloudpickle.register_pickle_by_value(spelling)
    try:
        rows = spelling_rows()[:190]
        same(spelling.groups(spelling.counted(frame(spark, [(d, t, None) for d, t in rows]))), brute.spelled(rows))
    finally:
        cloudpickle.unregister_pickle_by_value(spelling)


def byte_rows(seed=1):
    draw = random.Random(seed)
    letters = "abcdefg \né日"
    text = lambda n: "".join(draw.choice(letters) for _ in range(n))
    passage, line = text(900), text(330)
    rows = [(i, text(draw.randrange(0, 1500))) for i in range(30)]
    rows += [(100 + i, text(draw.randrange(300)) + passage[draw.randrange(200) : 900 - draw.randrange(200)] + text(draw.randrange(300))) for i in range(12)]
    rows += [(200 + i, passage[:k] + draw.choice("xyz") + passage[k + 1 :]) for i, k in enumerate(draw.sample(range(900), 15))]
    rows += [(300 + i, text(200) + line + text(200)) for i in range(10)]
    rows += [(400, "a" * 3000), (401, "ab" * 900), (402, "a" * 400), (403, "a" * 399), (404, "b" * 400), (405, "b" * 401), (406, passage + text(5) + passage)]
    rows += [(500, rows[30][1]), (500, rows[30][1]), (501, rows[31][1]), (502, None), (503, ""), (None, passage), (None, passage), (None, None), (504, "日本" * 80), (505, "x" + "日本" * 80)]
    return rows


@pytest.mark.parametrize("piece", [1 << 19, 700])
def test_suffix_dedup(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    cloudpickle.register_pickle_by_value(suffix_dedup)
    try:
        rows = byte_rows(piece)
        docs = frame(spark, [(d, t, None) for d, t in rows])
        got = suffix_dedup.removed(docs, keep_bytes=True)
        same(got.drop("kept_bytes"), brute.bytes_removed(rows))
        assert suffix_dedup.removed(docs.limit(0)).count() == 0
        assert suffix_dedup.removed(docs.limit(3)).count() == 3
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)


def audit_rows():
    draw = random.Random(4)
    rows = []
    for i in range(200):
        n = draw.choice([0, 5, 150, 199, 200, 240, 700])
        pool = draw.choice([20, 100, 400, 5000])
        w = [f"w{draw.randrange(pool)}" for _ in range(n)]
        w += draw.choice([[], [], ["#"], ["SHOUT"] * 9, ["|"]])
        rows.append((i, " ".join(w), draw.choice(["a", "b", "", None])))
    long = "z" * 5000
    rows += [(300 + i, rows[i % 7][1], "a") for i in range(60)] + [(400, long + "1", "b"), (401, long + "2", "b"), (402, long + "1", None), (None, long + "1", "b"), (None, None, None), (403, None, "b"), (404, "", "a"), (404, "", "a"), (0, "", "c")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 420, 3)] + [(3, 0, 1), (3, 1, None), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("collide", [False, True])
def test_filter_audit(spark, monkeypatch, collide):
    if collide:
        monkeypatch.setattr(filter_audit, "block_hash", lambda text, block: filter_audit.F.lit(1).cast("long"))
    rows, labels = audit_rows()
    docs = frame(spark, rows)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, told)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    same(got, brute.audited(rows, labels))
    assert filter_audit.audit(docs.limit(0), told).count() == 0
    assert filter_audit.audit(docs, told.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by\nthe Free Software Foundation; either version {version} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {name} for more details."


def test_licenses_are_told_from_their_siblings(spark):
    from annolith.llm import license_scan

    texts = {
        "agpl-3.0": GNU.format(what="program", name="Affero General Public License", version="3"), "lgpl-2.1": GNU.format(what="library", name="Lesser General Public License", version="2.1"),
        "gpl,gpl-2.0": GNU.format(what="program", name="General Public License", version="2"), "gpl,gpl-3.0": GNU.format(what="program", name="General Public License", version="3").replace("software;", "software:"),
        "cc0-1.0": "2. Waiver. To the greatest extent permitted by, but not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently,\nirrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights and associated claims and causes of action, whether now known or unknown",
        "epl-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
        "apache-2.0": "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "bsd": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,\nINCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
        "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-4.0": "This work is licensed under a\nCreative Commons Attribution 4.0 International License.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    }
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")).orderBy("doc_id").collect()
    strip = lambda r: ",".join(x for x in r.labels.split(",") if x != "gpl" or x not in r.base_labels)
    assert [strip(r) if name not in ("gpl,gpl-2.0", "gpl,gpl-3.0") else r.labels for r, name in zip(got, texts, strict=True)] == list(texts)
    assert all(r.score >= 0.9 for r in got)


def test_token_counts_refuse_other_files(tmp_path):
    import json

    from annolith.llm import queries, token_counts

    spec = json.load(open(queries.vocabulary_path(), encoding="utf-8"))
    changes = {"prefix": ("pre_tokenizer", spec["pre_tokenizer"] | {"add_prefix_space": True}), "none": ("pre_tokenizer", None), "split": ("pre_tokenizer", {"type": "Whitespace"}), "merges": ("model", spec["model"] | {"ignore_merges": True}), "dropout": ("model", spec["model"] | {"dropout": 0.1})}
    for name, (key, value) in changes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec | {key: value}))
        with pytest.raises(ValueError, match="not built here"):
            token_counts.Vocabulary(str(path))
    with pytest.raises(ValueError, match="sentence-piece"):
        token_counts.Vocabulary(str(tmp_path / "x.model"))
