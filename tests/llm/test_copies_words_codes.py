"""Exact copies, spelling variants and vector codes against brute force, on small rows with hard cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidepool.llm import fuse_dedup, laesa_codes, license_scan, queries, spelling_variants

DOCS = "doc_id long, text string, lang string, keep_id long, key string, `n.x` int, word string"
VECTORS = "vec_id long, embedding array<double>, label int, code string, v string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    texts = [None, "", " ", "\t\n", "a  b", "a b", "a\nb ", "a b", "é" * 5, "long " * 40_000, "long\t" * 40_000, "\x00", "\x1c"]
    texts += [rnd.choice(["x y", "x\ty", "z  z", "q"]) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "\t\n"), (3, "other"), (20, "x y"), (None, "q"), (None, None), (None, "only null"), (None, "only null")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 5, "k", 1, "w") for i, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 40_000])
def test_fuse_filter_holds_every_key(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
    made = fuse_dedup.Fuse.build(keys)
    others = np.random.default_rng(n + 1).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    assert made.holds(keys).all() and made.holds(others).mean() < 0.01
    assert n < 1000 or len(made.cells) < 1.6 * n


@pytest.mark.parametrize("bits, batches", [(64, 3), (64, 1), (1, 2), (5, 4)])
def test_exact_copies(spark, rows, bits, batches):
    """Few digest bits make different texts collide; the byte check must part them."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t-\r]+", " ", t or "")].append(i)
    want = Counter()
    for text, ids in groups.items():
        keep, sha = min((i for i in ids if i is not None), default=None), hashlib.sha256(text.encode()).hexdigest()
        want.update((i, keep, len(ids), k == 0, sha) for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i))))
    assert Counter(map(tuple, fuse_dedup.copies(frame(spark, rows), batches, bits).collect())) == want


def test_salts_and_hot_digests(spark, rows, monkeypatch):
    monkeypatch.setattr(fuse_dedup, "SALT_ROWS", 2)
    monkeypatch.setattr(fuse_dedup, "KEYS", 1)
    monkeypatch.setattr(fuse_dedup, "BUCKET", 4)
    whole = Counter(map(tuple, fuse_dedup.copies(frame(spark, rows)).collect()))
    found = fuse_dedup.candidates(fuse_dedup.digests(frame(spark, rows), 64), 3)
    texts = fuse_dedup.digests(frame(spark, rows), 64).drop("copies")
    for hot in (0, 3, 1000):
        joined = fuse_dedup.attach(texts, found, hot)
        assert joined.count() == texts.count() and joined.where("copies is null").count() == 0
    monkeypatch.undo()
    assert whole == Counter(map(tuple, fuse_dedup.copies(frame(spark, rows)).collect()))


def edits(a, b):
    """Whether one inserted, deleted or replaced letter turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelling(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [u for u in n if edits(u, w)] for w in n}
    best = {w: min(near[w], key=lambda u: (-n[u], u.encode())) for w in n if near[w]}
    form = {w: u for w, u in best.items() if n[u] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def test_spelling_variants(spark):
    rnd = random.Random(3)
    stems = ["maison", "Maison", "maïson", "maisons", "mais÷on", "abcde", "bcdea", "aaaaa", "aaaaaa", "aaaaaaa", "xaaaaa", "ÉCOLE", "école", "ecole", "ecoles"]
    stems += ["".join(rnd.choice("abé") for _ in range(rnd.randint(4, 7))) for _ in range(60)]
    texts = [" ".join(rnd.choice(stems) + rnd.choice(["", "1", "-", "日"]) for _ in range(rnd.randint(0, 80))) for _ in range(120)]
    texts += ["abcdefghij" * 3000, "abcdefghij" * 3000, "abcdefghij" * 3000 + "k", "abcdefghij" * 3000 + "k", "abcdefghij" * 3000, "abcdefghij" * 3000 + "k", None, "", "a b"]
    texts += ["chaine"] * 60 + ["chainee"] * 20 + ["chaineee"] * 5
    data = list(enumerate(texts)) + [(None, texts[0]), (5, texts[5])]
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.variants(frame(spark, data)).collect()}
    assert got == spelling(data) and any(f for _, f, *_ in got) and any(r != (f or w) for w, f, r, *_ in got)


def test_neighbourhoods_are_full_and_free_of_repeats():
    rnd = random.Random(1)
    words = ["", "a", "aa"] + ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(0, 7))) for _ in range(40)]
    made, got = spelling_variants.Reduced(words), defaultdict(list)
    for owner, keys in made.neighbours():
        for a, b in zip(owner.tolist(), keys.tolist()):
            got[a].append(b)
    key = lambda s: sum(x * pow(spelling_variants.BASE, i, 1 << 64) for i, x in enumerate(s)) % (1 << 64)
    every = range(1, spelling_variants.SYMBOLS + 1)
    for i in range(len(words)):
        s = tuple(made.symbol[made.start[i] : made.start[i + 1]].tolist())
        want = {s} | {s[:j] + s[j + 1 :] for j in range(len(s))} | {s[:j] + (x,) + s[j + 1 :] for j in range(len(s)) for x in every}
        want |= {s[:j] + (x,) + s[j:] for j in range(len(s) + 1) for x in every}
        assert sorted(map(key, want)) == sorted(got[i])


def test_counting_sends_parts(spark, monkeypatch):
    """What a task sends on before its end adds up."""
    found = [Counter()]
    texts = [" ".join(f"word{chr(97 + k % 26)}{chr(97 + i % 26)}" for k in range(50)) for i in range(30)]
    for i, t in enumerate(texts):
        found[0].update(dict(spelling_variants.words_of(i, t, 5)))
    monkeypatch.setattr(spelling_variants, "HELD", 7)
    got = spelling_variants.vocabulary(frame(spark, list(enumerate(texts))), occurrences=1).select("word", "n").collect()
    assert dict(map(tuple, got)) == dict(found[0])


def codes(rows, parts=16, entries=64):
    """The contract in plain Python integers."""
    kept = [(i, [int(np.floor(256 * x)) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda c: [min((gap(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(2):
        at = [near(c) for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, "".join(f"{k:02x}" for _, k in near(c)), sum(d for d, _ in near(c)), lab) for (i, _, lab), c in zip(kept, cut)]
    total = Counter()
    for _, _, d, lab in found:
        total[lab] += d
    return Counter((i, code, d, total[lab], sha) for i, code, d, lab in found)


@pytest.mark.parametrize("many, coarse", [(5, False), (90, True), (300, False)])
def test_vector_codes(spark, many, coarse):
    """Coarse components tie often; few rows make a short codebook."""
    rnd = random.Random(many)
    value = (lambda: rnd.choice([-1.0, 0.0, 0.5])) if coarse else (lambda: rnd.gauss(0, 1))
    data = [(rnd.randint(0, many), [value() for _ in range(32)], rnd.choice([None, 1, 2])) for _ in range(many)]
    data += [data[0], (None, data[1][1], None), (-5, None, 1), (-4, [], 1), (-3, [1.0] * 31 + [None], 1), (-2, [float("nan")] * 32, 1), (-1, [float("inf")] * 32, 1), (many, [1.0] * 16, 1)]
    frame = spark.createDataFrame([(i, v, lab, "c", "v") for i, v, lab in data], VECTORS).repartition(3)
    got = laesa_codes.vector_codes(frame).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == codes(data)


def test_pivot_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(5)
    entries = rng.integers(-300, 300, (64, 4))
    parts = entries[rng.integers(0, 64, 3000)] + rng.integers(-9, 10, (3000, 4))
    pivots = laesa_codes.far_apart(entries, 3)
    at, gap, evaluated = laesa_codes.nearest(parts, laesa_codes.to_pivots(parts, pivots).astype(np.float32).astype(float), entries, pivots)
    full = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (gap == full.min(axis=1)).all() and evaluated < 0.3 * full.size


def test_vectors_that_no_part_divides(spark):
    frame = spark.createDataFrame([(1, [1.0] * 15, 1, "c", "v")], VECTORS)
    assert laesa_codes.vector_codes(frame).count() == 0


def test_new_operators_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op11_fuse_dedup", "op12_spelling_variants", "op13_laesa_codes"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op11_fuse_dedup", "op12_spelling_variants", "op13_laesa_codes"])
def test_new_operators_match_their_sql(spark, sf_dir, duck, same_rows, name):
    assert same_rows(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


def test_filters_of_snapshots_screen(spark, rows):
    """The second batch's new digests aren't in the first snapshot, and false positives end at the exact buckets."""
    entries = spark.range(5000).select(F.lit(0).cast("long").alias("bucket"), F.xxhash64("id").alias("key"), F.col("id").alias("keep"), F.lit(1).cast("long").alias("copies"))
    exact, filters = fuse_dedup.freeze(entries, 0)
    fresh = spark.range(2500, 27_500).select(F.lit(0).cast("long").alias("bucket"), F.xxhash64("id").alias("key"))
    hits = fuse_dedup.screen(fresh, filters)
    assert hits.join(exact, "key").count() == 2500 and 2500 <= hits.count() < 2500 + 22_500 // 100


def altered(rnd, words, share):
    """words with a share of them replaced, spread evenly from a random start."""
    out, step = list(words), round(1 / share) if share else len(words) + 1
    for k in range(rnd.randrange(step), len(out), step):
        out[k] = f"x{rnd.randrange(10**6)}"
    return out


def test_whole_license_texts_are_retrieved_by_bands(spark):
    """Texts with up to a few percent of their words altered keep 80 % of most pieces' shingles. The bands alone
    (pieces of the largest size) are held against exact containment of every window."""
    rnd, texts = random.Random(5), []
    long = [t for _, t in license_scan.TEMPLATES if len(t.split()) > 90]
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    for share in (0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.2):
        texts += [" ".join(own(rnd.randint(0, 200)) + altered(rnd, t.split(), share) + own(rnd.randint(0, 200))) for t in long for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = license_scan.default_templates(spark)
    known = license_scan.pieces(templates).where(f"size = {max(license_scan.SIZES)}")
    banded = known.where(license_scan.miss(F.size("hashes")) <= license_scan.MISS)
    got = {(r.id, r.license, r.piece, r.start) for r in license_scan.retrieved(docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("mark"), "text"), banded).collect()}
    cut = lambda t: re.findall("[a-z0-9]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    windows = {i: [(s, grams(cut(t)[s : s + 128])) for s in range(0, len(cut(t)), 64)] for i, t in enumerate(texts)}
    want, pieces = set(), {(r.license, r.piece): {tuple(x.split(" ")) for x in r.need} for r in banded.collect()}
    for (name, piece), need in pieces.items():
        want |= {(i, name, piece, s) for i, w in windows.items() for s, have in w if len(need & have) >= 0.8 * len(need)}
    assert len(want) > 200 and len(want - got) <= 0.005 * len(want)
    found = {(r.doc_id, r.license) for r in license_scan.scan(docs, templates).collect()}
    names = [n for n, t in license_scan.TEMPLATES if len(t.split()) > 90]
    plain = [(i, names[i // 10]) for i in range(10 * len(names))]
    assert set(plain) <= found
