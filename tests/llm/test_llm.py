"""Corpus operators against brute force, on the small tables and on made-up cases."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import decontaminate, fmindex, graph, hashing, mixing, nearcopies, oracles, pii, quality, queries, rules, simhash, substrings, suffixes, tokens, toxicity, urls
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t ", "a", "A b", "x y z", "same same same " * 30, "é ü 漢字 \U0001f600", "a" * 5000, "1 " * 3000, "+1 (555) 123-4567 a@b.co 10.0.0.256 10.0.0.1 4111 1111 1111 1111", "line\nline\n\nline\n" * 3, "\x01@\x02", "http://x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, clashing column names."""
    rows = [(i if i % 4 else None, t, None if i % 3 else "s", "en", i) for i, t in enumerate(ODD)]
    rows += [rows[11]] * 2 + [(1, "other text of the same id", "s", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, size long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (5, None, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- op1 ---


def test_mix(spark, docs):
    res = queries.op1_mixing(spark, DATA)
    assert pairs(res) == pairs(queries.op1_mixing(spark, DATA))
    rows = res.join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    total, got, size, most = sum(r["size"] for r in rows), {}, {}, {}
    for r in rows:
        assert r["size"] == len(brute.WORD.findall(r.text)) and 0 <= r.taken <= 2 * r["size"]
        got[r.source] = got.get(r.source, 0) + r.taken
        size[r.source] = size.get(r.source, 0) + r["size"]
        most[r.source] = r.target
        assert r.source_size > 0
    assert abs(sum(most.values()) - 1.5 * total) < 1e-3
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    free = [s for s in most if most[s] < 2 * size[s] - 1e-6]
    assert len({round(most[s] / weight[s], 6) for s in free}) <= 1
    assert all(abs(got[s] - most[s]) < 0.05 * most[s] for s in most)


def _water(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    """Targets in plain Python. sizes: {source: size}."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % 3] for i, x in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        each = left / sum(weight[x] for x in free)
        above = [x for x in free if each * weight[x] > cap * sizes[x]]
        if not above:
            return out | {x: each * weight[x] for x in free}
        out |= {x: cap * sizes[x] for x in above}
        left -= sum(out[x] for x in above)
        free = [x for x in free if x not in out]
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40])
def test_targets(spark, n):
    r = random.Random(n)
    sizes = dict([(None, 7), ("y", 0), ("é", 12)][:n]) | {f"x{i}": r.choice([0, 1, 5, 1000, 10**6]) for i in range(n - 3)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
    got = {x.source: x.target for x in mixing.with_targets(mixing.ranked(rows).df).collect()}
    want = _water(sizes)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 1e-6 * max(1, want[k]) for k in want)


def test_dual(spark):
    """Multipliers against bisection; rates differ within a source; a target at the cap has none."""
    import math

    cells = [("a", 10, 5), ("a", 100, 2), ("a", 1000, 1), ("b", 10, 1), ("b", 3000, 2), ("c", 50, 100), ("d", 7, 1), ("e", 1, 9), ("e", 20000, 1)]
    aim = {"a": 2000.0, "b": 40.0, "c": 9000.0, "d": 14.0, "e": 20050.0}
    size = {s: sum(t * n for x, t, n in cells if x == s) for s in aim}
    mean = {s: size[s] / sum(n for x, _, n in cells if x == s) for s in aim}
    rows = [(s, size[s], aim[s], mean[s]) for s in aim]
    got = {r.s: r.lam for r in mixing.solve_dual(spark.createDataFrame(cells, "s string, size long, n long"), spark.createDataFrame(rows, "s string, source_size long, target double, mean double")).df.collect()}
    assert got["d"] is None
    for s in "abce":
        tokens = lambda lam, s=s: sum(n * t * min(2.0, math.exp(min(50.0, lam * t / mean[s]))) for x, t, n in cells if x == s)
        low, high = -1e6, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if tokens(mid) < aim[s] else (low, mid)
        assert abs(tokens(got[s]) - aim[s]) < 1e-6 * aim[s] and abs(got[s] - low) < 1e-5 * max(1, abs(low))


def test_mix_rates_follow_length(spark):
    """A source that is thinned out loses long documents first: exp(lambda * tokens) with lambda below zero."""
    r = random.Random(2)
    rows = [(i, "w " * (20 if i % 2 else 200), "a") for i in range(3000)] + [(5000 + i, "w " * 3, "b") for i in range(40000 // 3)]
    r.shuffle(rows)
    res = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5).collect()
    of = lambda n: [x.copies for x in res if x.size == n]
    short, long = sum(of(20)) / 1500, sum(of(200)) / 1500
    target = next(x.target for x in res if x.size == 20)
    assert short > 1.2 * long and abs(sum(x.taken for x in res if x.size in (20, 200)) - target) <= 200


def test_mix_odd(odd, tmp_path):
    res = mixing.mix(odd).collect()
    assert len(res) == odd.count() and all(r.taken <= 2 * r["size"] for r in res)
    mixing.mixed(odd).write.parquet(f"{tmp_path}/mixed")
    back = odd.sparkSession.read.parquet(f"{tmp_path}/mixed")
    assert back.columns == ["doc_id", "text", "source", "score", "size", "source_size", "target", "taken", "copies"]
    assert back.count() == sum(r.copies > 0 for r in res)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


# --- op2 ---


def test_simhash(spark, texts):
    prints = {i: brute.fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = brute.classes(ids, near)
    assert pairs(queries.op2_simhash(spark, DATA)) == sorted(((i, f"{prints[i]:016x}", roots[i]) for i in ids), key=str)


@pytest.mark.parametrize(("radius", "tile", "part"), [(2, 1024, 32768), (2, 16, 32768), (2, 2, 32768), (2, 16, 20), (3, 4, 40), (8, 16, 32768)])
def test_links(spark, radius, tile, part, monkeypatch):
    """Keys of all lengths, split buckets, tiles that are skipped: always the links of brute force."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "PART", part)
    r = random.Random(radius)
    bases = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (1 << 64) - 1 for b in bases for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s, s) for s in signed], "node long, fp long").repartition(3)
    links = [tuple(x) for x in simhash.links_of(df, radius).collect()]
    want = brute.classes(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius])
    assert brute.classes(signed, links) == want
    star = {x.a: x.b for x in graph.components(spark.createDataFrame(links or [(1, 1)], "a long, b long")).df.collect()}
    assert {n: star.get(n, n) for n in signed} == want


def test_masks_grow_with_the_table():
    r = random.Random(11)
    for n in (0, 1, 1 << 10, 1 << 18, 1 << 30, 1 << 34, 1 << 40):
        ms = simhash.masks(2, n)
        assert len({bin(m & (1 << 64) - 1).count("1") for m in ms}) == 1
        assert n >> bin(ms[0] & (1 << 64) - 1).count("1") <= 2048
        for _ in range(300):  # two flipped bits leave one key alone at least
            flip = (1 << r.randrange(64)) | (1 << r.randrange(64))
            assert any(not flip & m & (1 << 64) - 1 for m in ms)


def test_tiles_are_compared_and_skipped(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    seen = []
    real = np.nonzero
    monkeypatch.setattr(simhash.np, "nonzero", lambda x: seen.append(x.shape) or real(x))
    fp = np.array(sorted((random.Random(5).getrandbits(64) >> (i % 40) for i in range(64)), key=int.bit_count), np.uint64)
    simhash.linked(np.zeros(64, int), fp, 2)
    tiles = [x for x in seen if len(x) == 2]
    assert 8 <= len(tiles) < 36 and set(tiles) == {(8, 8)}


def test_simhash_odd(spark, odd):
    res = simhash.near_duplicates(odd).collect()
    assert len(res) == odd.count()
    assert {r.fingerprint for r in res if r.doc_id in (1, 2, 3)} >= {"0" * 16}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("text like '+1%'").count() == 1 and kept.where("trim(text) = ''").count() <= 1


def test_keep_one_finds_near_copies(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    rows += [(100 + i, " ".join(b)) for i, b in enumerate(base)]
    rows += [(200 + i, " ".join(b[:150] + [word()] + b[151:])) for i, b in enumerate(base)]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(40)) and len(kept) <= 42


@pytest.mark.parametrize(("similarity", "linked"), [(0.75, False), (0.8, True), (0.85, True)])
def test_keep_one_at_the_threshold(spark, similarity, linked):
    """Pairs planted at a similarity: `same` common 5-word shingles, `own` more on each side."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    same, own = {0.75: (60, 10), 0.8: (80, 10), 0.85: (85, 15)}[similarity]
    sides = (own, own) if similarity < 0.85 else (own, 0)
    rows = []
    for i in range(300):
        base = [word() for _ in range(same + 4)]
        rows += [(2 * i + side, " ".join(base + [word() for _ in range(more)])) for side, more in enumerate(sides)]
    grams = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows[:2])]
    assert len(grams[0] & grams[1]) / len(grams[0] | grams[1]) == similarity
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == set(range(0, 600, 2 if linked else 1))


def test_near_copies_against_brute_force(monkeypatch):
    monkeypatch.setattr(nearcopies, "TILE", 16)
    r = random.Random(8)
    base = [r.random() for _ in range(40)]
    sets = [np.unique(np.array([hash(x) for x in base if r.random() < 0.93] + [r.getrandbits(60) for _ in range(r.randrange(4))], np.uint64)) for _ in range(60)]
    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    near = [(i, j) for i in range(60) for j in range(i) if alike(sets[i], sets[j])]
    want = brute.classes(range(60), near)
    lab = nearcopies.linked(sets, 0.8)
    assert 1 < len(set(lab.tolist())) < 60
    assert brute.classes(range(60), [(i, int(x)) for i, x in enumerate(lab)]) == want
    lab = nearcopies.linked(sets, 0.8, [want[i] if i % 3 else None for i in range(60)])
    assert brute.classes(range(60), [(i, int(x)) for i, x in enumerate(lab)]) == want


@pytest.mark.parametrize("chunk", [1024, 5])
def test_near_copies_in_chunks(spark, chunk, monkeypatch):
    """Groups larger than a chunk: a large one, chains whose ends are unlike, and strangers that share a key."""
    monkeypatch.setattr(nearcopies, "CHUNK", chunk)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(120)]
        for _ in range(30):
            t = list(base)
            for _ in range(r.randrange(9)):
                t[r.randrange(120)] = word()
            rows.append(" ".join(t))
    rows += ["", "", "one two", "one two"]
    sets = [nearcopies.shingle_set(t, 5) for t in rows]
    n = len(rows)
    near = [(i, j) for i in range(n) for j in range(i) if nearcopies.same(sets[i], sets[j], 0.8)]
    want = brute.classes(range(n), near)
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)).collect()}
    assert kept == set(want.values())


# --- op3 ---


def test_deep_shallow():
    r = random.Random(4)
    for _ in range(200):
        ts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 30))]
        order, lcp = suffixes.deep_shallow(ts)
        got = [ts[i] for i in order]
        assert got == sorted(ts) and all(lcp[i] == suffixes.common(got[i - 1], got[i]) for i in range(1, len(got)))


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("crowd", [256, 2])
def test_repeats(spark, big, crowd, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "PIECE", 4)
    r = random.Random(5 + big)
    base = ["".join(r.choice("abcdé ") for _ in range(300)) for _ in range(2 if big else 4)]
    rows = []
    for _ in range(220 if big else 100):
        t = ""
        for _ in range(r.randint(0, 4)):
            a = r.randint(0, 250)
            t += r.choice(base)[a : a + r.randint(5, 90)] + "".join(r.choice("xy") for _ in range(r.randint(0, 12)))
        rows.append((r.randint(0, 50) if r.random() < 0.9 else None, t))
    rows += [(1, None), (2, ""), (3, "a" * 500), (4, "a" * 41), (5, "ab" * 200), (6, "ab" * 200), (6, "ab" * 200)]
    got = pairs(substrings.remove(spark.createDataFrame(rows, "doc_id long, text string"), length=40, anchor=20).drop("kept"))
    assert got == sorted(((i, *b) for (i, _), b in zip(rows, brute.repeated([t for _, t in rows], 40), strict=True)), key=str)


def test_template_with_a_running_number(spark, monkeypatch):
    """Every text holds the same 380 bytes beside bytes of its own: one anchor, one crowd, split down to windows."""
    monkeypatch.setattr(substrings, "CROWD", 64)
    r = random.Random(10)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    core = word(380)
    rows = [(i, f"{word(30)}{i % 700:06d}{core}{i % 900:06d}{word(10)}") for i in range(5000)]
    rows += [(6000 + i, f"{word(5)}{'same tail of it'}{core}{'and the same after that'}{word(9)}") for i in range(3)]
    got = pairs(substrings.remove(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept"))
    assert got == sorted(((i, *b) for (i, _), b in zip(rows, brute.repeated([t for _, t in rows], 400), strict=True)), key=str)
    assert any(x[2] for x in got)


def test_groups_to_sort_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", 8)
    seen = []
    real = substrings._compare
    monkeypatch.setattr(substrings, "_compare", lambda contents, length: seen.append(contents.groupBy("h", "g").count().agg(F.max("count")).first()[0]) or real(contents, length))
    r = random.Random(13)
    core = "".join(r.choice("abcdefgh") for _ in range(36))
    rows = [(i, f"{r.random()}{core}{r.random()}") for i in range(300)]
    substrings.remove(spark.createDataFrame(rows, "doc_id long, text string"), length=40, anchor=20).count()
    assert seen and seen[0] <= 8


def test_repeated_rows_give_their_spans_once(spark):
    text = "".join(random.Random(3).choice("abc ") for _ in range(900))
    df = spark.createDataFrame([(None, text)] * 400, "doc_id long, text string")
    found = substrings.covered(substrings._keyed(df, "doc_id", "text")).df.collect()
    assert len(found) == 1 and len(found[0].spans) == len({tuple(x) for x in found[0].spans})
    assert {tuple(x)[1:4] for x in substrings.remove(df).collect()} == {(900, 900, 1)}


def test_multikey_quicksort():
    r = np.random.default_rng(6)
    for _ in range(50):
        words = r.integers(0, 3, (r.integers(0, 60), 3)).astype(np.uint64)
        groups = suffixes.multikey_quicksort(words)
        got = [tuple(words[i]) for g in groups for i in g]
        assert got == sorted(map(tuple, words)) and len(groups) == len(set(got))


def test_many_contents_of_one_anchor():
    r = random.Random(9)
    core = bytes(r.choice(b"abc") for _ in range(20))
    side = [bytes(r.choice(b"xyz") for _ in range(20)) for _ in range(6)]
    contents = list({(r.choice(side)[r.randrange(15):] + core + r.choice(side)[: r.randrange(5, 20)]) for _ in range(400)})
    texts = [(c, c.index(core)) for c in contents]
    assert len(texts) > 64
    whole = substrings.repeated_parts(texts, 30)
    for (t, at), part in zip(texts, whole, strict=True):
        hits = [d for d in range(at + 1) if at - d + 30 <= len(t) and sum(o[b - d : b - d + 30] == t[at - d : at - d + 30] for o, b in texts if b >= d) > 1]
        assert part == ((at - max(hits), at - min(hits) + 30) if hits else None)


def test_suffix_dedup_query(spark, texts):
    ids = sorted(texts)
    want = sorted(((i, *b) for i, b in zip(ids, brute.repeated([texts[i] for i in ids], 400), strict=True)), key=str)
    assert pairs(queries.op3_suffix_dedup(spark, DATA)) == want


def test_repeats_in_segments(monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 64)
    data = bytes(random.Random(1).choice(b"abcd") for _ in range(1000))
    covered = set()
    for a, b, p, *_ in substrings.runs_of(data, substrings.Powers(), 40, 20):
        assert a <= p and p + 20 <= b and not covered & set(range(a, b - 39))
        covered |= set(range(a, b - 39))
    assert covered == set(range(961))


# --- op4, op8, op9 ---


@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity", "toxic", 0.85), ("op8_quality", "quality", 0.95)])
def test_held_out(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    res = queries.QUERIES[name](spark, d)
    at = 0.3 if label == "toxic" else 0.5
    assert res.where(f"score < 0 or score > 1 or predicted <> cast(score >= {at} as int)").count() == 0
    m, want = (4, 2) if label == "toxic" else (3, 1)
    assert res.where(f"held_out <> (crc32(cast(cast(doc_id as string) as binary)) % {m} = {want})").count() == 0
    held = res.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert held.where(f"predicted = {label}").count() >= least * held.count()


def test_rules(spark, texts):
    res = queries.op9_quality_rules(spark, DATA).collect()
    assert {(r.doc_id, *brute.rules(texts[r.doc_id])) for r in res} == {tuple(r)[:7] for r in res}
    assert all(not r.kept for r in res if r.base_failed)
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    passed = [r.kept for r in res if r.doc_id in good and not r.base_failed]
    assert sum(passed) >= 0.95 * len(passed)


def test_models_odd(odd, labels, tmp_path):
    """odd has columns of its own named score and size: results are written and read back."""
    for n, (fit, use) in enumerate(((toxicity.fit, lambda m: toxicity.score(odd, m)), (quality.fit, lambda m: quality.score(odd, m)), (rules.fit, lambda m: rules.judge(odd, m)))):
        for k, (docs, labs) in enumerate(((odd, labels), (odd.limit(0), labels), (odd, labels.limit(0)))):
            use(fit(docs, labs)).write.parquet(f"{tmp_path}/{n}-{k}")
            rows = odd.sparkSession.read.parquet(f"{tmp_path}/{n}-{k}").collect()
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    got = {(r.doc_id, *tuple(r)[1:7]) for r in rules.judge(odd, rules.fit(odd, labels)).collect()}
    assert got == {(r.doc_id, *brute.rules(r.text)) for r in odd.collect()}
    assert rules.judge(odd.limit(0), rules.fit(odd, labels)).count() == 0


def _plain_hash(data, mix=True):
    h = 0
    for k, b in enumerate(data):
        h = (h + (b + 1) * pow(hashing.STEP, k, 1 << 64)) % (1 << 64)
    h = h * hashing.MIX % (1 << 64)
    return (h ^ (h >> 29)) * hashing.MIX % (1 << 64)


def _plain_features(word):
    """Buckets of a word in plain Python."""
    raw = b"^" + word.encode("utf-8", "replace") + b"$"
    out = [_plain_hash(raw) >> (64 - hashing.BITS)]
    for n in hashing.GRAMS:
        for i in range(len(raw) - n + 1):
            h = n
            for b in raw[i : i + n]:
                h = (h * hashing.STEP + b) % (1 << 64)
            out.append((h * hashing.MIX % (1 << 64)) >> (64 - hashing.BITS))
    return out


def test_toxicity_against_plain_python(spark, odd):
    """The same model, scored by loops over words."""
    import math

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    place = {b: i for i, b in enumerate(model["buckets"].tolist())}
    for row in toxicity.score(docs, model).collect():
        words, seen = (row.text or "").lower().split(), {}
        for w in words:
            for k in {place[b] for b in _plain_features(w) if b in place}:
                seen[k] = seen.get(k, 0) + 1
        raw = model["b"] + sum(model["w"][k] * round(min(n, toxicity.MOST) * toxicity.UNIT / math.sqrt(len(words))) for k, n in seen.items())
        assert abs(row.score - 1 / (1 + math.exp(-max(-35, min(35, model["a"] * raw + model["c"]))))) < 1e-9


def test_unlabelled_moments_cover_all_rows(spark):
    rows = [(i, " ".join(random.Random(i).choice(["idiot", "a", "bb", "clown"]) for _ in range(1 + i % 7))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    buckets = np.unique(hashing.word_features(["idiot", "clown"])[0])
    x = np.zeros((len(rows), len(buckets) + 1))
    x[:, -1] = 1
    place = {b: i for i, b in enumerate(buckets.tolist())}
    for i, (_, t) in enumerate(rows):
        words = t.split()
        for w in words:
            for k in {place[b] for b in _plain_features(w) if b in place}:
                x[i, k] += 1
        x[i, :-1] = np.rint(np.minimum(x[i, :-1], toxicity.MOST) * toxicity.UNIT / np.sqrt(len(words)))
    assert (toxicity.moments(df, buckets) == x.T @ x).all()


def test_negative_risk_stays_non_negative():
    """With a prior that is far too high the plain estimate would fall below zero; the corrected risk may not."""
    r = np.random.default_rng(1)
    pos, unl = np.append(r.random((40, 6)) + 1, np.ones((40, 1)), 1), np.append(r.random((400, 6)), np.ones((400, 1)), 1)
    w = toxicity.train_nnpu(pos, unl.T @ unl, 0.9, np.ones(6))
    risk = lambda x: float((0.25 * (1 + x @ w) ** 2).mean())
    assert risk(unl) - 0.9 * risk(pos) > -0.02


def test_quality_against_plain_python(spark, odd):
    """The same model, scored passage by passage: gates, weights, weighted mean."""
    import math

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(40).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    m = quality.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    p = m["p"]
    for row in quality.score(docs, m).collect():
        words = (row.text or "").split()
        bag = []
        for at in range(0, max(1, len(words)), quality.PASSAGE):
            part = words[at : at + quality.PASSAGE]
            x = np.zeros(quality.WIDTH + 3)
            if part:
                x[: quality.WIDTH] = np.mean([quality.describe([w])[0][0] for w in part], axis=0)
                before = words[at - 1 : at] + part[:-1]
                same = sum(a == b for a, b in zip(part[len(part) - len(before) :], before, strict=True))
                x[quality.WIDTH :] = len(set(part)) / len(part), same / len(part), len(part) / quality.PASSAGE
            h = np.tanh((x - m["mean"]) / m["std"] @ p["W"] + p["bw"])
            bag.append((h, float((np.tanh(h @ p["V"]) * (1 / (1 + np.exp(-(h @ p["U"]))))) @ p["w"])))
        top = max(e for _, e in bag)
        weight = [math.exp(e - top) for _, e in bag]
        z = sum(a * h for a, (h, _) in zip(weight, bag, strict=True)) / sum(weight)
        assert abs(row.score - 1 / (1 + math.exp(-max(-35, min(35, m["a"] * float(z @ p["c"] + p["b"][0]) + m["c"]))))) < 1e-3


def test_rules_verdict_against_plain_python(spark, odd):
    import math

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(40).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    m = rules.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    texts = {}
    for x in docs.collect():
        texts.setdefault(x.doc_id, []).append(x.text)
    for row in rules.judge(docs, m).collect():
        scores = []
        for text in texts[row.doc_id]:
            words = brute.WORD.findall(text or "")
            b = [k for w in words for k in _plain_features(w)]
            h = [_plain_hash(b"^" + w.encode() + b"$") for w in words]
            b += [hashing.SAME if x == y else ((x * hashing.PAIR + y) * hashing.MIX % (1 << 64)) >> (64 - hashing.BITS) for x, y in zip(h, h[1:], strict=False)]
            scores.append(1 / (1 + math.exp(-(m["a"] * (sum(float(m["w"][k]) for k in b) / len(words) + m["b"]) + m["c"]))) if words else 0.0)
        assert min(abs(row.score - s) for s in scores) < 1e-9 and row.kept == (not row.base_failed and row.score >= 0.5)


def test_words_count_whole(spark):
    """What tells lies past byte 256 of an unspaced text, and in the last passages of a long one."""
    r = random.Random(4)
    plain = lambda n: "".join(r.choice("acegikmo") for _ in range(n))
    def text(bad, n):
        return plain(n) + ("zqxjvw" * 4 if bad else "") + plain(40)
    rows = [(i, text(i % 3 == 0, 300 + i % 50)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labs = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(0, 600) if i % 2], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.fit(docs, labs)).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 3 == 0) for i in range(0, 600, 2)]) > 0.97
    words = lambda bad, n: " ".join([plain(5) for _ in range(n)] + ["##$$ !!@@ %%%%"] * (40 if bad else 0))
    rows = [(i, words(i % 3 == 0, 5000)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.score for x in quality.score(docs, quality.fit(docs, labs)).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in range(0, 90, 2)]) > 0.9
    got = {x.doc_id: x.score for x in rules.judge(docs, rules.fit(docs, labs)).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in range(0, 90, 2)]) > 0.9


# --- op5 ---


def test_fm_index():
    import numpy as np

    r = np.random.default_rng(2)
    text = np.append(r.integers(0, 4, 500), 0)
    index = fmindex.FMIndex(text, 4)
    for n in (1, 2, 5):
        pats = r.integers(1, 4, (20, n))
        low, high = index.search(pats, np.full(20, n))
        for p, a, b in zip(pats, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]


def test_decontaminate(spark, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    res = pairs(queries.op5_decontaminate(spark, DATA))
    assert res == sorted(((i, *brute.leaks(t, items)) for i, t in texts.items()), key=str) and any(r[5] for r in res)


@pytest.mark.parametrize("block", [60, 1 << 20])
def test_decontaminate_odd(spark, odd, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(6)
    some = lambda n: " ".join(r.choice(["a", "b", "C", "é", "1"]) for _ in range(r.randint(0, n)))
    items = [(i, some(17)) for i in range(12)] + [(3, "a b"), (None, "a"), (50, None)]
    docs = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(100 + i, some(60), "x") for i in range(150)], "doc_id long, text string, score string"))
    for its in (items, []):
        bench = spark.createDataFrame(its, "item_id long, text string")
        got = pairs(decontaminate.report(docs, bench).drop("spans"))
        assert got == sorted(((d.doc_id, *brute.leaks(d.text, its)) for d in docs.collect()), key=str)
    bench = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    left = decontaminate.cleaned(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.where("coalesce(text, '') <> 'x y z'").count()
    assert decontaminate.report(odd.limit(0), bench).count() == 0


def test_cut_words(spark):
    r = random.Random(8)
    leak = " ".join(f"w{i}" for i in range(13))
    filler = lambda n: " ".join(r.choice(["The", "ÉTÉ", "x-y", "Q.", "z9"]) for _ in range(n))
    rows = [(i, f"{(a := filler(400))} {leak.upper()}, {(b := filler(30))}", f"{a} , {b}") for i in range(5)] + [(9, leak, None)]
    for block in (decontaminate.BLOCK_BYTES, 1):
        before, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, block
        bench = spark.createDataFrame([(1, leak), (2, "other words"), (3, leak)], "item_id long, text string")
        got = decontaminate.cleaned(spark.createDataFrame(rows, "doc_id long, text string, want string"), bench).collect()
        decontaminate.BLOCK_BYTES = before
        assert len(got) == 5 and all(x.text == x.want for x in got)


# --- op6 ---


def test_pii(spark, docs, odd):
    r = random.Random(3)
    fuzz = [(1000 + i, "".join(r.choice("aB1059.@+-_ ()\n\x01é\U0001f600%") for _ in range(r.randint(0, 80)))) for i in range(1500)]
    fuzz += [(3000 + i, "x " + "".join(r.choice("0123456789") + r.choice(["", "", "", " ", "-", "."]) for _ in range(r.randint(0, 40)))) for i in range(800)]
    fuzz += [(5001, "a@b.c_d@e.f"), (5002, "1 " * 20000), (5003, "a@b.cc " * 3000), (5004, "a" * 50000), (5005, "1." * 20000), (5006, "+1" * 9000), (5007, "1" * 40000)]
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(fuzz, "doc_id long, text string"))
    got = pairs(pii.digest(every).drop("spans"))
    assert got == sorted(((x.doc_id, *brute.personal(x.text)) for x in every.collect()), key=str)
    assert pii.digest(odd.limit(0)).count() == 0


def test_account_numbers_that_run_on(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 AND MORE"), (2, "IBAN DE88 3704 0044 0532 0130 00 AND"), (3, "account GB82WEST12345698765432 X")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.spans for r in pii.digest(df).orderBy("doc_id").collect()] == ["iban:5:32", "", "iban:8:30"]


def test_redaction_of_long_texts(spark):
    """Against plain Python: spans across the parts a text is cut in, hundreds of them, code points over 16 bits."""
    r = random.Random(5)
    word = lambda: r.choice(["x", "\U0001f600é", "漢字 ", "a.b@c.de", "10.0.0.1", "+1 555 123 4567", "4111 1111 1111 1111", "y" * 400, "\n"])
    rows = [(i, " ".join(word() for _ in range(r.choice([3, 40, 900])))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, spans string")
    found = {x.doc_id: x.spans for x in pii.with_spans(df).collect()}
    names = list(pii.PATTERNS)
    for x in pii.redacted(df).collect():
        text, out, done = rows[x.doc_id][1], [], 0
        for s in found[x.doc_id]:
            if s.start >= done:
                out += [text[done : s.start], f"[{names[s.kind].upper()}]"]
            done = max(done, s.end)
        assert x.text == "".join([*out, text[done:]]) and x.spans == "own"


def test_pii_method(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00."), (2, "IBAN DE88 3704 0044 0532 0130 00."), (3, "call (555) 123-4567"), (4, "part 555 123-4567"), (5, "mail a@b.co, x"), (6, None), (7, "ssn 123-45-6789 +1 555 123 4567 end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.spans for r in pii.digest(df).orderBy("doc_id").collect()] == ["iban:5:32", "", "national_phone:5:19", "", "email:5:11", "", "ssn:4:15,phone:16:31"]
    assert [r.text for r in pii.redacted(df).orderBy("doc_id").collect()] == ["IBAN [IBAN].", rows[1][1], "call [NATIONAL_PHONE]", rows[3][1], "mail [EMAIL], x", None, "ssn [SSN] [PHONE] end"]


# --- op7 ---


def test_tokens(spark, texts, odd):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    r = random.Random(1)
    fuzz = [(i, "".join(r.choice(" \t\n\x1c\x85\xa0'sltdre<|endoftext|>aé漢1²Ⅷ\U0001f600!?") for _ in range(r.randint(0, 60)))) for i in range(2000)] + [(-1, "a<|endoftext|> b<|endoftext|><|endoftext|>")]
    every = odd.select("doc_id", "text").unionByName(spark.createDataFrame(fuzz, "doc_id long, text string"))
    got = pairs(tokens.count_tokens(every, path))
    assert got == sorted(((x.doc_id, len((x.text or "").encode()), n, n > 512) for x in every.collect() for n in [count(x.text)]), key=str)
    assert pairs(queries.op7_token_counts(spark, DATA)) == sorted(((i, len(t.encode()), n, n > 512) for i, t in texts.items() for n in [count(t)]), key=str)


# --- op10 ---


def test_urls(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    assert pairs(queries.op10_url_filter(spark, DATA)) == sorted(c.execute(oracles.ORACLES["op10_url_filter"]).fetchall(), key=str)


def test_urls_odd(spark):
    rows = [None, "", "no scheme", "http://", "HTTP://A.Net/x", "http://net/", "http://net", "http://example.net/en/1", "http://notnet.com/", "http://x.example.com/de/?q#f", "http://casino-win.example.org/en/1", "ftp://a?b://c/d", "http://é.org/fr/\n"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert all((got[i].host, got[i].path) == urls.split_url(u) for i, u in enumerate(rows))
    assert [got[i].rule for i in range(len(rows))] == [None, None, None, None, "net/", "net/", None, "example.net/en/", None, "example.com/de/", None, None, "org/fr/"]
    assert [got[i].verdict for i in (0, 1, 2, 4, 5, 7, 9, 10, 12)] == ["allow", "allow", "allow", "block", "block", "allow", "block", "block", "allow"]
    assert urls.judge(df.limit(0)).count() == 0
