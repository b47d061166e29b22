"""Dealt operators on odd tables, and against plain re-computations."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.llm import licenses, mixing, near_dedup, packing, quality_cnn, quality_rules, token_counts, toxicity, warc, winnowing
from touchline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int, copies string, bin int, score string, same int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a"), (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (2, "ONE two three four five six seven eight nine ten eleven", None, None), (3, None, None, "b"), (4, "", "en", "b"), (5, " \n\t ", "en", "b"),
    (None, "one two three four five six seven eight nine ten eleven", "en", "a"), (None, None, None, None), (6, LONG, "en", "é"), (7, "short", "en", "b"),
    (8, "short", "en", "z"), (9, "Licensed under the Apache License, Version 2.0.\nß𝔘 ünï", "de", "a"), (10, "Ωmega x" * 40, "en", "a"),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, "3", 4, "5", 6) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0), (7, 0, 1), (7, 1, 0)], LABELS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def ids(found):
    return sorted((r["doc_id"] for r in found), key=lambda i: (i is None, i))


ONE_EACH = {
    "toxicity": lambda d, y: toxicity.score_documents(d, y), "cnn": lambda d, y: quality_cnn.score_documents(d, y), "near": lambda d, y: near_dedup.near_duplicates(d),
    "tokens": lambda d, y: token_counts.tokenize_and_count(d), "winnowing": lambda d, y: winnowing.edit_likeness(d), "rules": lambda d, y: quality_rules.judge(d),
    "licenses": lambda d, y: licenses.scan(d), "mixing": lambda d, y: mixing.mix(d), "fingerprints": lambda d, y: winnowing.fingerprints(d),
}


@pytest.mark.parametrize("name", ONE_EACH)
def test_odd_rows_give_one_row_each(odd, labels, name):
    assert ids(rows(ONE_EACH[name](odd, labels))) == ids([{"doc_id": r[0]} for r in ROWS])


@pytest.mark.parametrize("name", ONE_EACH)
def test_empty_tables(spark, odd, labels, name):
    assert ONE_EACH[name](odd.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("keep", [lambda d, y: toxicity.drop_toxic(d, y), lambda d, y: quality_rules.drop_poor(d), lambda d, y: near_dedup.drop_near_duplicates(d),
                                  lambda d, y: mixing.mixed_documents(d)])
def test_stages_keep_all_columns(odd, labels, keep):
    for table in (odd, odd.limit(0)):
        out = keep(table, labels)
        assert out.columns == odd.columns and out.count() <= 4 * len(ROWS)


def test_near_duplicates_against_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150).union(
        spark.createDataFrame([(9000 + i, " ".join(f"q{j}" if j % 40 != i % 40 else f"r{i}x{j}" for j in range(220))) for i in range(60)], "doc_id long, text string"))
    sets = {}
    for r in docs.collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if c == high else c for i, c in label.items()}
    for r in rows(near_dedup.near_duplicates(docs)):
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


@pytest.mark.parametrize("short", [16, 1])
def test_near_duplicates_where_an_id_has_several_texts(spark, monkeypatch, short):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)
    text = lambda name, *changed: " ".join(f"{name}{j}" if j not in changed else f"x{name}{j}" for j in range(120))
    table = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("b", 60)), (2, text("c")), (4, ""), (4, text("d")), (5, text("d", 7)), (-6, text("e")), (-6, text("e", 9)),
             (7, text("e", 119)), (8, text("f")), (8, text("f")), (8, text("g")), (8, None), (None, text("a")), (9, text("h", 5, 50, 90)), (9, text("i")), (10, text("h", 100)), (10, "")]
    table += [(20 + i, text("k", i, i + 40)) for i in range(24)] + [(20, text("l"))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    words = [(t or "").split() for _, t in table]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in words]
    label = list(range(len(table)))
    for a, b in itertools.combinations(range(len(table)), 2):
        if None not in (table[a][0], table[b][0]) and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    least = [min((table[j][0] for j in range(len(table)) if label[j] == label[i]), key=lambda x: (x is None, x)) for i in range(len(table))]
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(near_dedup.near_duplicates(docs))]
    order = lambda r: [(x is None, x or 0) for x in r]
    assert sorted(found, key=order) == sorted(((table[i][0], len(sets[i]), least[i]) for i in range(len(table))), key=order)
    kept = [(r["doc_id"], r["text"]) for r in rows(near_dedup.drop_near_duplicates(docs))]
    assert len(kept) == len(set(label)) == len({label[table.index(k)] for k in kept})
    assert all(k[0] == least[table.index(k)] for k in kept)


def test_sketches_of_linked_pairs_share_enough():
    rng = np.random.default_rng(2)
    any_size, larger = near_dedup.least_shared()
    for n, m in ((40, 40), (78, 78), (100, 130), (192, 200), (500, 500), (900, 1150), (5000, 5000)):
        for _ in range(20):
            shared = -(-3 * (n + m) // 7)
            if shared > min(n, m):
                continue
            values = rng.choice(1 << 50, n + m - shared, replace=False)
            a, b = np.sort(values[:n]), np.sort(values[n - shared :])
            union = np.union1d(a[: near_dedup.K], b[: near_dedup.K])[: near_dedup.K]
            common = len(np.intersect1d(union, np.intersect1d(a[: near_dedup.K], b[: near_dedup.K])))
            at = lambda table, x: table[min(x, near_dedup.SURE_UPTO) - 1]
            assert common >= max(at(larger, min(n, m)), at(any_size, max(n, m)))


def test_fingerprints_keep_rightmost_minima_and_meet_the_guarantee():
    text = "abcabcabc " * 30
    (hashes, places), = winnowing.winnow([text], gram=5, window=8)
    grams = {}
    for h, p in zip(hashes.tolist(), places.tolist(), strict=True):
        assert grams.setdefault(text[p : p + 5], h) == h
    values = dict(zip(places.tolist(), hashes.tolist(), strict=True))
    known = [grams.get(text[i : i + 5], 1 << 32) for i in range(len(text) - 4)]
    for i in range(len(known) - 7):
        chosen = [p for p in range(i, i + 8) if p in values]
        low = min(known[i : i + 8])
        assert chosen and max(p for p in range(i, i + 8) if known[p] == low) in chosen
    shared = "some passage that both of these texts hold, word by word"
    a, b = (set(f[0].tolist()) for f in winnowing.winnow([f"xx yy {shared} zz", f"{'q' * 50} {shared}"]))
    assert a & b
    f = next(winnowing.winnow([text]))
    assert [x.tolist() for x in winnowing.decoded(winnowing.encoded(*f))] == [f[0].tolist(), f[1].tolist()]


def test_edited_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    found = {r["doc_id"]: r for r in rows(winnowing.edit_likeness(docs, range_rows=37))}
    assert len(found) == len(order)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and found[i]["n_chars"] == len(text)
        own, changed, other = ({*f[0].tolist()} for f in winnowing.winnow([text, edited, after]))
        assert found[i]["near_edited"] == pytest.approx(len(own & changed) / len(own | changed))
        assert found[i]["near_next"] == pytest.approx(len(own & other) / len(own | other))


@pytest.mark.parametrize("block", [3, 8, 64, 1 << 19])
def test_token_counts_across_blocks(spark, odd, monkeypatch, block):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.encoding(f.read()).encode_ordinary
    short = odd.filter("doc_id IS NULL OR doc_id <> 6")
    want = sorted((r[0] is None, r[0] or 0, len(encode(r[1] or ""))) for r in ROWS if r[0] != 6)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in rows(token_counts.tokenize_and_count(short)))
    assert got == want


def test_keys_of_token_files():
    for i in (0, 1, -1, (1 << 63) - 1, -(1 << 63), 8191, 8192, None):
        assert token_counts.key_of(np.array(token_counts.key_ids(i))) == i


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = rows(mixing.mix(docs))
    again = rows(mixing.mix(docs.repartition(7)))
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] in (0, *(r["size"] * k for k in (1, 2, 3))) for r in found)
    by_source = {}
    for r in found:
        by_source.setdefault(r["source"], []).append(r)
    # water-filling, round by round
    total, open_, target = sum(sizes.values()), {}, {}
    for i, s in enumerate(sorted(by_source)):
        open_[s] = (i % 3 + 1, 3 * by_source[s][0]["source_size"])
    while open_:
        left = total - sum(target.values())
        weight = sum(w for w, _ in open_.values())
        over = [s for s, (w, cap) in open_.items() if left * w / weight > cap]
        for s in over or list(open_):
            w, cap = open_[s]
            target[s] = cap if over else left * w / weight
        open_ = {s: x for s, x in open_.items() if s not in target}
    for s, group in by_source.items():
        assert group[0]["target"] == pytest.approx(target[s])
        smallest = min((r["size"] for r in group if r["size"]), default=1)
        assert abs(sum(r["taken"] for r in group) - target[s]) <= max(1, smallest)


def test_budget_is_fitted_as_well_as_can_be():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = sorted(rng.choice(np.arange(1, 60), 5, replace=False).tolist())
        counts = rng.integers(1, 4, 5).tolist()
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = int(rng.integers(0, total))
        taken = mixing.fit_budget(lengths, counts, budget, window=10**9)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        reach = {sum(n * k for n, k in zip(lengths, ks, strict=True)) for ks in itertools.product(*(range(c + 1) for c in counts))}
        assert abs(sum(n * t for n, t in zip(lengths, taken, strict=True)) - budget) == min(abs(r - budget) for r in reach)


def test_packing_holds_room_and_conflicts(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table, size in ((docs, 2048), (odd, 16), (odd.limit(0), 16)):
        found = rows(packing.pack(table, capacity=size))
        assert sum(r["words"] for r in found) == sum(len(WORD.findall(r["text"] or "")) for r in table.collect())
        bins = {}
        for r in found:
            assert (r["bin"] is None) == (r["words"] == 0)
            bins.setdefault(r["bin"], []).append(r)
        bins.pop(None, None)
        for held in bins.values():
            assert sum(r["words"] for r in held) <= size
            assert len({r["cluster"] for r in held}) == len(held) and sorted(r["place"] for r in held) == list(range(len(held)))
            assert max(sum(r["source"] == s for r in held) for s in {r["source"] for r in held}) <= 4


def test_many_copies_of_a_row_keep_to_their_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 4)
    docs = spark.range(1300).select(F.expr("if(id < 1290, NULL, id)").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    found = rows(packing.pack(docs, capacity=8))
    assert len(found) == 1300 and len({r["bin"] for r in found}) == 1300  # all are of one cluster
    groups = {}
    for r in found:
        groups[(r["bin"] >> packing.BIN_BITS) % 325] = groups.get((r["bin"] >> packing.BIN_BITS) % 325, 0) + 1
    assert max(groups.values()) < 40  # and not dealt to one task
    row = {"doc_id": [None], "words": [3], "source": ["a"], "cluster": [1], "pack": [5], "copies": [1300]}
    found = pd.concat(packing._pack(8, 4, 325)(iter([pd.DataFrame(row)])))
    assert len(found) == found["bin"].nunique() == 1300


def test_the_tightest_compatible_bin_is_found():
    # the bins left open by 6 and 7 have 4 and 3 of room; 3 of cluster 1 cannot join the tightest
    assert packing.pack_group([7, 6, 3, 3], ["a"] * 4, [1, 2, 1, 3], 10, 4) == [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert len({b for b, _ in packing.pack_group([1] * 5, ["a"] * 5, list(range(5)), 10, 4)}) == 2


def test_losers_tree_merges_like_sorting():
    rng = np.random.default_rng(0)
    for k in (0, 1, 2, 3, 7, 12):
        runs, n = [], 0
        for r in range(k):
            size = int(rng.integers(0, 9))
            entries = [(f"k{rng.integers(4)}", int(rng.integers(3)), None if rng.random() < 0.2 else int(rng.integers(5)), "response", None, 1, "d", f"r{r}", i, 1) for i in range(size)]
            runs.append(sorted(entries, key=warc.order_of))
            n += size
        merged = list(warc.merge_runs(runs))
        assert len(merged) == n and merged == sorted((e for r in runs for e in r), key=warc.order_of)


def test_archives_of_odd_pages(spark):
    big, url = "x" * 1500, "http://User@www.Example.com:80/A b/é?q=1#top"
    pages = [(1, url, big), (2, url, big), (3, None, big), (3, None, big), (None, "http://b.org", big), (4, "", "x" * 999), (5, "http://b.org/WARC/1.1\r\n", "x" * 999),
             (6, "http://c.org/x", None), (7, "http://c.org", "ü" * 600 + "\r\n\r\nWARC/1.1\r\n")]
    out = rows(warc.archive_pages(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int"), range_rows=3))
    assert len(out) == len(pages)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in out}
    assert kinds == {(1, "revisit", 3), (2, "revisit", 3), *((i, "response", None) for i in (3, None, 4, 5, 6, 7))}
    for r in out:
        html = dict((p[0], p[2] or "") for p in pages)[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html).hexdigest())
    ordered = sorted(out, key=lambda r: (r["history_range"], r["history_place"]))
    keys = [(r["url_key"], r["captured"]) for r in ordered]
    assert keys == sorted(keys) and warc.url_key(url) == "com,example)/a b/é?q=1"
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_words_in_one_text(spark):
    text = "a b c d e f a b c d e x\n\n same line here\nsame line here\n same line here #"
    docs = spark.createDataFrame([(1, text), (2, "z " * 20)], "doc_id long, text string")
    one, two = sorted(rows(quality_rules.judge(docs)), key=lambda r: r["doc_id"])
    assert (one["n_repeat_words"], one["n_dup_lines"], one["n_symbols"]) == (10 + 9, 0, 1)
    assert two["n_repeat_words"] == 20 and two["base_failed"] and not two["kept"]


def test_rules_fit_finds_the_good_class():
    good, poor = int("2" * len(quality_rules.RULES), 3), int("0" * len(quality_rules.RULES), 3)
    post = quality_rules.fit({good: 900, poor: 100})
    assert post[good] > 0.99 and post[poor] < 0.01 and quality_rules.fit({}) == {}


def test_licenses_against_containment(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(
        [(9001, "a b " + licenses.NOTICES[1][1] + " and so on"), (9002, licenses.NOTICES[6][1].replace("redistribute", "share")), (9003, "licensed under terms")], "doc_id long, text string"))
    threes = lambda t: {tuple(w[i : i + 3]) for w in [licenses.words_of(t)] for i in range(max(len(w) - 2, 1) if w else 0)}
    found = {r["doc_id"]: r["licenses"] for r in rows(licenses.scan(docs))}
    for r in docs.collect():
        own = threes(r["text"] or "")
        want = {n for n, t in licenses.NOTICES if len(own & threes(t)) >= licenses.CONTAINED * len(threes(t))}
        assert found[r["doc_id"]] == ",".join(sorted(want)), r["doc_id"]
    assert found[9001] == "Apache-2.0" and "GPL-2.0-or-later" in found[9002] and not found[9003]


def test_licenses_with_one_word_inserted_or_changed(spark):
    threes = lambda t: {tuple(w[i : i + 3]) for w in [licenses.words_of(t)] for i in range(max(len(w) - 2, 1) if w else 0)}
    texts = ["This work is hereby licensed under the GNU General Public License, version 3."]
    for _, notice in licenses.NOTICES:
        w = licenses.words_of(notice)
        texts += [" ".join(["see", *w[:i], "hereby", *w[i + cut :], "end"]) for cut in (0, 1) for i in range(len(w) + 1 - cut)]
        # its halves far apart and in the other order
        texts.append(" ".join([*w[len(w) // 2 :], *["filler"] * 60, *w[: len(w) // 2 + 2]]))
    found = {r["doc_id"]: r for r in rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, text in enumerate(texts):
        own = threes(text)
        shares = {}
        for name, notice in licenses.NOTICES:
            t = threes(notice)
            if len(own & t) >= licenses.CONTAINED * len(t):
                shares[name] = max(shares.get(name, 0), len(own & t) / len(t))
        assert (found[i]["licenses"], found[i]["best"]) == (",".join(sorted(shares)), pytest.approx(max(shares.values(), default=0))), text
    assert found[0]["licenses"] == "GPL-3.0"


def test_licenses_that_are_alike_are_told_apart(spark):
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
           "1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce it.")
    third = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    gnu = "you can redistribute it and/or modify it under the terms of the GNU {} Public License"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    epl = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {} which is available at"
    texts = {
        bsd: "BSD", bsd + third: "BSD,BSD-3-Clause", gnu.format("General"): "", gnu.format("Lesser General"): "LGPL", gnu.format("Affero General"): "AGPL",
        isc + ".": "", isc + ", provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        epl.format("v1.0"): "EPL-1.0", epl.format("2.0"): "EPL-2.0", epl.format("v2.0"): "EPL-2.0", epl.format("v. 2.0"): "EPL-2.0"}
    found = {r["doc_id"]: r["licenses"] for r in rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [found[i] for i in range(len(texts))] == list(texts.values())


@pytest.mark.parametrize("query, label", [("op1_toxicity", "toxic"), ("op6_quality_classifier", "quality")])
def test_held_out_accuracy(spark, query, label):
    sf = "/root/testdata/sf0.1"
    y = spark.read.parquet(f"{sf}/labels.parquet")
    found = QUERIES[query](spark, sf).filter("held_out").join(y, "doc_id").groupBy(label).agg(F.avg("predicted").alias("p")).collect()
    share = {r[label]: r["p"] for r in found}
    assert share[1] > 0.85 and share[0] < 0.2, share


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(p.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if i < len(p.STAGES) - 1:
            assert docs.columns == before.columns and docs.count() > 0
    assert sorted(map(repr, docs.collect())) == sorted(map(repr, p.run(spark, SF).collect()))
