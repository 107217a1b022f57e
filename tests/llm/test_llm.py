"""Operators for training data against brute force, on small rows with hard cases."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tidepool.llm import best_fit, bpe_prefix, components, license_scan, pivot_topk, quality_mcd, queries, separator_scan, simhash_vp, substring_automaton, suffix_repeats, toxicity_weak
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ck string, fp int, shard string"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def hard_texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", " \n\t ", "one", "one two", passage, passage, "x " + passage[5:] + " y", "a" * 300, "a" * 300, passage * 3, "日本語 " * 30, "é" * 60, "\x00 \x1c é"]
    texts += [" ".join(word() for _ in range(60)) + " " + passage[k : k + 70 + k] for k in range(6)]
    texts += [passage[:49], passage[:50], passage[:51], " ".join(word() for _ in range(9000))]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], ["s", None][i % 2], len(t or ""), "c", i, "s") for i, t in enumerate(hard_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def test_suffix_repeats(docs):
    texts, first = [(t or "").encode() for t in hard_texts()], {}
    for i, b in enumerate(texts):
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    got = {r.doc_id: r for r in suffix_repeats.repeat_digests(docs).collect()}
    for i, b in enumerate(texts):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), gone.sum(), spans, kept)


def test_suffix_repeats_rewrites_texts(docs):
    got = {r.doc_id: r for r in suffix_repeats.without_repeats(docs).collect()}
    assert got[0].text is None and got[6].text == "" and got[5].text == hard_texts()[5] and got[9].n_chars == 0 and got[3].ck == "c"


@pytest.mark.parametrize("least", [1, 3, 5])
def test_longest_previous_factors(least):
    """Suffix order, common prefixes and factors against all pairs of suffixes."""
    rnd = random.Random(least)
    for _ in range(15):
        rows = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(1, 30))) for _ in range(20)]
        docs, width = np.array(sorted(rnd.randint(0, 8) for _ in rows)), max(map(len, rows))
        text = np.zeros((len(rows), width), np.uint16)
        for i, r in enumerate(rows):
            text[i, : len(r)] = np.frombuffer(r, np.uint8).astype(np.uint16) + 1
        found = suffix_repeats.Suffixes(text, np.array([len(r) for r in rows]), least)
        row, column = found.order // width, found.order % width
        own = [rows[r][c:] for r, c in zip(row, column)]
        shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert own == sorted(r[c:] for r in rows for c in range(len(r) - least + 1))
        assert found.lcp.tolist() == [0] + [shared(a, b) for a, b in zip(own, own[1:])]
        want = [max([shared(own[i], own[j]) for j in range(len(own)) if docs[row[j]] < docs[row[i]]], default=0) for i in range(len(own))]
        got = suffix_repeats.longest_previous_factors(docs[row], found.lcp, least)
        assert got.tolist() == [n if n >= least else 0 for n in want]


def test_repeats_of_one_id_do_not_match(spark):
    rows = spark.createDataFrame([(1, "q" * 20 + "0123456789" * 6), (1, "0123456789" * 6), (None, "0123456789" * 6)], "doc_id long, text string")
    got = suffix_repeats.repeat_digests(rows).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 60), (1, 0), (1, 0)]


def test_substring_automaton(docs):
    split, first = [words(t) for t in hard_texts()], {}
    for i, w in enumerate(split):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    got = {r.doc_id: r for r in substring_automaton.window_digests(docs).collect()}
    for i, w in enumerate(split):
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        kept = hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), kept)


def test_bpe_matches_the_library(spark):
    t, rnd = Tokenizer.from_file(BYTE), random.Random(1)
    bits = [" ", "  ", "\n", "a", "aa", "ab", "A", "é", "1", "22", "!!", "'s", "\t", " ", "日本", "😀", "́", "the", "<|endoftext|>", "\x1c", "\x85", "\x00"]
    texts = [None, "", "z" * 5000, "ab" * 3000] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(800)]
    got = {r.doc_id: r for r in bpe_prefix.encode_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    found = simhash_vp.near_duplicates(docs).collect()
    fp = {r.doc_id: r.fp & (1 << 64) - 1 for r in found}
    assert fp == {i: fingerprint(t) for i, t in enumerate(hard_texts())}
    label = {i: i for i in fp}
    while True:
        new = {i: min(label[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3) for i in fp}
        if new == label:
            break
        label = new
    assert {r.doc_id: r.component_id for r in found} == label
    kept = {r.doc_id for r in simhash_vp.keep_first(docs).collect()}
    assert kept == set(label.values())


def linked(x):
    """Smallest index of each component of fingerprints within 3 bits."""
    close, label = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, np.arange(len(x))
    while True:
        new = np.where(close, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def near_fingerprints(rng, n):
    base = rng.integers(0, 1 << 63, n).astype(np.uint64)
    flip = lambda: np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) for _ in range(3)])
    return np.unique(np.concatenate([base, base ^ flip(), base ^ flip()]))


def test_dense_fingerprints_link_exactly():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    x = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (60, 2))]]))
    links = simhash_vp.Links(len(x))
    simhash_vp.link_group(x, links, np.arange(len(x)))
    assert (links.label == linked(x)).all()


def test_balls_cross_boundaries_of_the_trees(monkeypatch):
    """Fingerprints visit every leaf that their ball overlaps, and shards split on; no link is lost."""
    monkeypatch.setattr(simhash_vp, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = near_fingerprints(rng, 700)
    whole = simhash_vp.Links(len(x))
    for band in range(2):
        value = simhash_vp.half(x, band)
        tree = simhash_vp.build_tree(value[::4], 16)
        who, leaf, lives = simhash_vp.find_leaves(tree, value)
        assert len(tree) >= 8 and lives.sum() == len(x) < len(who)
        home = dict(zip(who[lives], leaf[lives]))
        seen = set(zip(who.tolist(), leaf.tolist()))
        near = np.argwhere(np.bitwise_count(value[:, None] ^ value[None, :]) <= 1)
        assert all((a, home[b]) in seen for a, b in near.tolist())
        for n in np.unique(leaf):
            at = who[leaf == n]
            links = simhash_vp.Links(len(at))
            simhash_vp.link_leaf(x[at], value[at], links, np.flatnonzero(lives[leaf == n]), np.flatnonzero(~lives[leaf == n]))
            whole.join(at, at[links.label])
    assert (whole.label == linked(x)).all()


def test_near_links_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(simhash_vp, "LEAF_ROWS", 64)
    x = near_fingerprints(np.random.default_rng(4), 300)
    classes = spark.createDataFrame([(int(f), i) for i, f in enumerate(x.view(np.int64))], "fp long, rep long")
    got = {r.node: r.component for r in components.connected_components(simhash_vp.near_links(classes)).collect()}
    assert {i: got.get(i, i) for i in range(len(x))} == dict(enumerate(linked(x).tolist()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_top_k_ties_nulls_and_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(250)]
    rows += [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 3)).tolist()) for i in range(1000, 1300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (304, [])]
    # repeated ids, with the same vector and with another, and a null id
    rows += [(200, rows[200][1]), (100, [2.0, 1.0, 0.0, -3.0]), (None, [9.0] * 4), (400, [1.0, 2.0]), (500, [0.5, 0.5]), (600, [3e9, -2e9]), (600, [3e15, 1e15])]
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, row string, id int").repartition(3)
    v = pivot_topk.scaled(frame.drop("id"), "vec_id", "embedding")
    got = sorted(tuple(r) for r in pivot_topk.top_k(v, F.col("id") % 100 == 0, 10).collect())
    good = [(i, [math.floor(1024 * float(np.float32(y))) for y in x]) for i, x in rows if i is not None and x and all(y is not None and np.isfinite(y) for y in x)]
    want, most = [], (1 << 63) - 1
    for n, (i, own) in enumerate(good):
        if i % 100 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(own, x)), -most - 1), most), j, m) for m, (j, x) in enumerate(good) if m != n and len(x) == len(own))
            want += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scores[:10])]
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["op1_pivot_topk", "op2_quality_mcd", "op7_license_scan"])
def test_oracle(spark, sf_dir, duck, same_rows, name):
    assert same_rows(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


def test_quality_handles_hard_rows(docs):
    got = {r.doc_id: r for r in quality_mcd.verdicts(docs).collect()}
    assert len(got) == len(hard_texts()) and not got[0].kept and got[0].n_words == 0 and got[10].n_repeat_words > 0
    assert quality_mcd.keep_good(docs).columns == docs.columns


def test_packing(spark, docs):
    t = Tokenizer.from_file(WORD)
    rows = best_fit.pack_documents(docs, WORD).collect()
    sizes = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in enumerate(hard_texts())}
    for i, n in sizes.items():
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        assert own == [(k, 2048 * k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))]
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) == -(-sum(sizes.values()) // 2048)


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    for counts in (rng.integers(0, 3, 2049), np.bincount([1] * 5000 + [2000] * 10, minlength=2049), np.zeros(2049, int)):
        counts[0], left = 0, np.zeros(2049, int)
        for times, runs in best_fit.plan_patterns(counts):
            assert sum(n * k for n, k in runs) <= 2048
            for n, k in runs:
                left[n] += times * k
        assert (left == counts).all()


def test_separator_scan_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(separator_scan, "GROUP", 2)
    ids = [7] * 5 + [0] + [0] + [7] * 11 + [0] + [7] * 3
    blocks = [(3, b, np.array(ids[4 * b : 4 * b + 4], np.uint16).tobytes()) for b in range(-(-len(ids) // 4))]
    got = separator_scan.count_tokens(spark.createDataFrame(blocks, "stream long, block long, ids binary"), 0).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens, r.open) for r in got] == [(0, 5, False), (6, 0, False), (7, 11, False), (19, 3, True)]


def test_token_counts_match_the_tokenizer(docs):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in separator_scan.document_counts(docs, path, public_tokenizers.PATTERN, 50256).collect()}
    assert got == {i: len(t.encode_ordinary(x or "")) for i, x in enumerate(hard_texts())}


def test_licenses(spark):
    texts = [None, "", "w " * 500 + "released UNDER the mit license" + " w" * 70, "Released under the MIT", "x " + license_scan.TEMPLATES[3][1] + " y"]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), license_scan.default_templates(spark)).collect()
    assert {(r.doc_id, r.license) for r in got} == {(2, "mit"), (4, "mit-grant")}


def exact_licenses(docs):
    """Exact containment of every window: {(doc_id, license): n_windows}."""
    cut = lambda t: re.findall("[a-z0-9]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    found = {}
    for name, template in license_scan.TEMPLATES:
        w, largest = cut(template), max(license_scan.SIZES)
        size = next((n for n in sorted(license_scan.SIZES) if len(w) <= n), largest)
        needs = [grams(w[s : s + largest]) for s in range(0, len(w) - 4, largest)]
        for i, text in docs:
            d = cut(text)
            have = [grams(d[s : s + 2 * size]) for s in range(0, len(d), size)]
            n = [sum(len(need & h) >= 0.8 * len(need) for h in have) for need in needs]
            if sum(x > 0 for x in n) >= 0.8 * len(needs):
                found[i, name] = sum(n)
    return found


def test_licenses_in_many_contexts(spark):
    rnd, texts = random.Random(3), []
    for k in (1, 2, 4, 6):
        for _ in range(100):
            own = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
            texts.append(f"{own(rnd.randint(0, 150))} {license_scan.TEMPLATES[k][1]} {own(rnd.randint(70, 150))}")
    docs = list(enumerate(texts))
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), license_scan.default_templates(spark)).collect()
    want = exact_licenses(docs)
    assert {(r.doc_id, r.license): r.n_windows for r in got} == want
    assert all((i, license_scan.TEMPLATES[k][0]) in want for i, k in enumerate(k for k in (1, 2, 4, 6) for _ in range(100)))


def test_toxicity(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    bad = ["grumble", "snarlish", "vexword"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        own = [word() for _ in range(60)] + (rnd.sample(bad, 2) if toxic else [])
        rnd.shuffle(own)
        docs.append((i, " ".join(own), 1))
        labels.append((i, 0, int(toxic)))
    docs += [(1000, None, 1), (1001, "", 1)]
    frame, named = spark.createDataFrame(docs, "doc_id long, text string, tox_score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity_weak.scores(frame, named).collect()}
    held = [i for i, _, _ in labels if got[i].held_out]
    assert len(got) == 902 and np.mean([got[i].predicted == labels[i][2] for i in held]) > 0.97 and got[1000].predicted == 0
    assert toxicity_weak.keep_clean(frame.drop("tox_score"), named).where("doc_id < 900").count() >= 670


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = [
        suffix_repeats.repeat_digests(empty), suffix_repeats.without_repeats(empty), substring_automaton.window_digests(empty), bpe_prefix.encode_digests(empty, BYTE),
        simhash_vp.near_duplicates(empty), simhash_vp.keep_first(empty), best_fit.pack_documents(empty, WORD), quality_mcd.verdicts(empty), quality_mcd.keep_good(empty),
        separator_scan.document_counts(empty, path, public_tokenizers.PATTERN, 50256), license_scan.scan(empty, license_scan.default_templates(spark)),
        toxicity_weak.scores(empty, labels), toxicity_weak.keep_clean(empty, labels),
    ]
    none = pivot_topk.scaled(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert [f.count() for f in [*found, pivot_topk.top_k(none, F.lit(True), 10)]] == [0] * (len(found) + 1)


def test_pipeline_runs_and_keeps_columns(spark, sf_dir):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, sf_dir)
    total = packed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert total[1] <= -(-total[0] // 2048) + 1


def test_null_ids(spark, sf_dir):
    rows = spark.createDataFrame([(None, "a b c d", None, None), (1, "a b c d", None, None), (None, "q r s t", None, None), (1, "a b c d", None, None)], "doc_id long, text string, lang string, source string")
    found = sorted(((r.doc_id or -1, r.component_id) for r in simhash_vp.near_duplicates(rows).collect()), key=str)
    assert found == [(-1, 1), (-1, None), (1, 1), (1, 1)]
    assert simhash_vp.keep_first(rows).count() == 4
    labels = spark.createDataFrame([(None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    every = [
        toxicity_weak.scores(rows, labels), quality_mcd.verdicts(rows), suffix_repeats.without_repeats(rows), substring_automaton.window_digests(rows), bpe_prefix.encode_digests(rows, BYTE),
        best_fit.pack_documents(rows, WORD), separator_scan.document_counts(rows, path, public_tokenizers.PATTERN, 50256),
    ]
    assert [f.count() for f in every] == [4] * len(every)


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, doc int, tox_score string, kept int, fp int, component_id int, ck string, part int, number int, length int, row int"


def odd_docs(spark):
    """Repeated rows, null ids and columns whose names hold dots or clash with those of the operators."""
    base = [(i, t, ["en", None][i % 2], "s", len(t or "")) for i, t in enumerate(hard_texts())]
    base += [base[5], base[5], base[1], (None, base[5][1], "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5, "c", 6, 7, 8, 9) for r in base], ODD).repartition(3)


def test_filters_keep_odd_columns_and_repeated_rows(spark):
    rows = odd_docs(spark)
    labels = spark.createDataFrame([(5, 0, 0), (5, 1, None), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for kept in (quality_mcd.keep_good(rows), toxicity_weak.keep_clean(rows, labels), simhash_vp.keep_first(rows), suffix_repeats.without_repeats(rows)):
        assert kept.columns == rows.columns and {r["a.b"] for r in kept.collect()} <= {1}
    assert toxicity_weak.keep_clean(rows, labels).count() == rows.count() == suffix_repeats.without_repeats(rows).count()


def test_repeated_rows_give_repeated_results(spark):
    rows, path = odd_docs(spark), public_tokenizers.path("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([(5, 0, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    n = rows.count()
    for found in (bpe_prefix.encode_digests(rows, BYTE), simhash_vp.near_duplicates(rows), toxicity_weak.scores(rows, labels), quality_mcd.verdicts(rows), separator_scan.document_counts(rows, path, public_tokenizers.PATTERN, 50256)):
        own = [tuple(r)[1:] for r in found.where("doc_id = 5").collect() if "stream" not in r.asDict()]
        assert found.count() == n and len(set(map(str, own))) <= 1
    packed = best_fit.pack_documents(rows, WORD)
    assert packed.where("doc_id = 5 and piece = 0").count() == 3 and packed.where("doc_id is null and piece = 0").count() == 2
    licensed = spark.createDataFrame([(None, license_scan.TEMPLATES[3][1], 1), (3, license_scan.TEMPLATES[3][1], 2), (3, license_scan.TEMPLATES[3][1], 2)], "doc_id long, text string, size int")
    got = license_scan.scan(licensed, license_scan.default_templates(spark)).where("license = 'mit-grant'").collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "None"]


def test_very_long_texts(spark):
    rnd = random.Random(8)
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(180_000))
    rows = spark.createDataFrame([(1, long, "en", "s"), (2, long[600_000:], "en", "s"), (3, f"{long[:500_000]} {license_scan.TEMPLATES[3][1]} {long[:9000]}", "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_mcd.verdicts(rows).collect()}
    assert got[1].n_words == 180_000 and got[3].n_repeat_words > 1000
    assert [r.doc_id for r in license_scan.scan(rows, license_scan.default_templates(spark)).where("license = 'mit-grant'").collect()] == [3]
    assert suffix_repeats.repeat_digests(rows).where("doc_id = 2").first().n_removed == len(long) - 600_000
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity_weak.scores(rows, labels).count() == 3
    found = bpe_prefix.encode_digests(rows, BYTE).where("doc_id = 1").first()
    assert found.n_tokens == len(Tokenizer.from_file(BYTE).encode(long, add_special_tokens=False).ids)


def test_packed_checksums(spark, docs):
    import zlib

    t = Tokenizer.from_file(WORD)
    want = {}
    for i, x in enumerate(hard_texts()):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in best_fit.pack_documents(docs, WORD).collect()} == want


def test_encoded_ids(spark, docs):
    t = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r.ids for r in bpe_prefix.encode_ids(docs, BYTE).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(hard_texts())}


def test_label_model_against_enumeration():
    """Posteriors of the last round follow from the tables by Bayes' rule, clique by clique, and labels don't vote."""
    rng = np.random.default_rng(6)
    truth = (rng.random(1500) < 0.3).astype(int)
    fire = lambda a, b: (rng.random(1500) < np.where(truth == 1, a, b)).astype(np.uint8)
    first = fire(0.6, 0.02)
    votes = np.stack([first, first & fire(0.97, 0.97), fire(0.5, 0.05), fire(0.4, 0.01)], axis=1)
    clique = toxicity_weak.cliques(votes, truth == 1)
    assert clique[0] == clique[1] and len(set(clique.tolist())) == 3
    posterior = toxicity_weak.label_model(votes, truth)
    for pattern in np.unique(votes, axis=0):
        same = posterior[(votes == pattern).all(axis=1)]
        assert np.ptp(same) < 1e-12  # rows of the same votes have one posterior, whatever their labels
    assert np.mean((posterior > 0.5) == truth) > 0.9 and abs(posterior.mean() - truth.mean()) < 0.1


def test_linear_classifier_reaches_the_minimum():
    """The proximal steps end where no single weight can lower the penalised loss."""
    rng = np.random.default_rng(7)
    rows = [([f for f in "abcd" if rng.random() < 0.4], 0) for _ in range(400)]
    target = np.array([0.9 if "a" in r else 0.8 if "b" in r and "c" in r else 0.05 for r, _ in rows])
    sample = toxicity_weak.Sample(rows)
    bias, weight = toxicity_weak.train_linear(sample, target)

    def loss(b, w):
        odds = np.array([b + sum(w[sample.names.index(f)] for f in r) for r, _ in rows])
        return np.mean(np.logaddexp(0, odds) - target * odds) + toxicity_weak.PENALTY * np.abs(w).sum()

    best = loss(bias, weight)
    assert weight[sample.names.index("a")] > 1
    for i in np.flatnonzero(weight):
        for step in (-0.05, 0.05):
            other = weight.copy()
            other[i] += step
            assert loss(bias, other) >= best - 1e-6


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    where = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0


def test_pipeline_against_brute_force(spark, sf_dir, duck):
    """Every stage by its definition, on whole texts: SQL for the quality rules, all pairs of fingerprints, every
    50-byte string, the tokenizer. Only the fitted classifier is the operator's own; its parts are tested above."""
    import zlib

    import corpus_pipeline
    from tidepool.llm.common import table

    verdict = dict(duck.execute(f"SELECT doc_id, kept FROM ({queries.ORACLE_SQL['op2_quality_mcd']})").fetchall())
    good = table(spark, sf_dir, "documents").where(F.col("doc_id").isin([int(i) for i, kept in verdict.items() if kept]))
    scored = toxicity_weak.scores(good, table(spark, sf_dir, "labels")).where("predicted = 0").select("doc_id").collect()
    texts = dict(duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())
    clean = sorted(r.doc_id for r in scored)
    label = linked(np.array([fingerprint(texts[i]) for i in clean], np.uint64))
    left = [i for k, i in enumerate(clean) if label[k] == k]
    assert 0 < len(left) < len(clean) < sum(verdict.values()) < len(verdict)
    raw, first, want = {i: (texts[i] or "").encode() for i in left}, {}, {}
    for i in left:
        for j in range(len(raw[i]) - 49):
            first.setdefault(raw[i][j : j + 50], i)
    t, removed = Tokenizer.from_file(WORD), 0
    for i in left:
        gone = np.zeros(len(raw[i]), bool)
        for j in range(len(raw[i]) - 49):
            if first[raw[i][j : j + 50]] < i:
                gone[j : j + 50] = True
        removed += int(gone.sum())
        kept = np.frombuffer(raw[i], np.uint8)[~gone].tobytes().decode(errors="replace")
        ids = [*t.encode(kept, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert removed > 0 and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        assert sum(n for _, n in own) <= 2048 and [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()]
