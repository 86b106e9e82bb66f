"""Whitening, periodic runs and SimHash components against brute force, with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from atrium.llm import periods, simhash, whitening
from atrium.llm.words import WORD, word_hashes, words

DOCS = "doc_id long, text string, runs string, n string, fp string, first string, h string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], DOCS)


# ---- periodic runs

def runs_by_definition(w, least, times):
    out = set()
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i:
                start, length = i, j + q - i
                part = w[start:start + length]
                smallest = next(p for p in range(1, length) if all(part[k] == part[k + p] for k in range(length - p)))
                if smallest == q and length >= max(least, times * q):
                    out.add((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (2, 2), (7, 2)])
def test_runs_of_random_words(seed, least, times):
    import pyarrow as pa

    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        w = []
        while len(w) < rng.randrange(5, 120):
            unit = [rng.choice("ab" if rng.random() < .5 else "abcdefgh") for _ in range(rng.randrange(1, 12))]
            w += unit * rng.randrange(1, 6) + unit[:rng.randrange(len(unit) + 1)]
        texts.append(w)
    found = words(pa.array([" ".join(w) for w in texts] + [None, "", "a"]))
    start, length, period = periods.find_runs(found, word_hashes(found), least, times)
    got = [[] for _ in range(len(texts) + 3)]
    for s, n, p in zip(start.tolist(), length.tolist(), period.tolist()):
        k = int(np.searchsorted(found.first, s, "right")) - 1
        got[k].append((s - int(found.first[k]), n, p))
    assert got == [runs_by_definition(w, least, times) for w in texts] + [[], [], []]


def test_positions_stay_in_order_over_many_blocks():
    rng = random.Random(1)
    numbers = rng.sample(range(100_000), 6000)
    kept, known = periods.Positions(numbers[0]), [numbers[0]]
    import bisect

    for x in numbers[1:]:
        at = bisect.bisect_left(known, x)
        assert kept.add(x) == (known[at - 1] if at else -1, known[at] if at < len(known) else -1)
        known.insert(at, x)
    assert [x for b in kept.blocks for x in b] == known and len(kept.blocks) > 2


def test_long_repetitions_take_little_time():
    import pyarrow as pa

    n = 60_000
    found = words(pa.array(["a " * n, "b c " * (n // 2), " ".join(f"w{i % (n // 3)}" for i in range(n)) + " z" * 30, "y" * 200_000]))
    start, length, period = periods.find_runs(found, word_hashes(found))
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == [(0, n, 1), (n, n, 2), (2 * n, n, n // 3), (3 * n, 30, 1)]


def planted(i, text):
    w = re.findall(WORD, text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def period_rows(rows):
    out = []
    for i, t in rows:
        w = planted(i, t)
        found = runs_by_definition(w, 24, 3)
        drop = {k for s, n, p in found for k in range(s + p, s + n)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        out.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None,
                    hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
                    hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest()))
    return sorted(out, key=str)


def test_periods_digest(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 150)))) for i in range(60)]
    rows += [(i, f"u{i} " * 30 + "\tend\r\n" + "p q r " * 12 + "é ü " * 13) for i in range(60, 75)]
    rows += [(80, None), (81, ""), (82, " \n "), (None, "n " * 40), (None, None), (60, rows[60][1]), (83, "k " * 24), (84, "k " * 23), (85, "x" * 150_000 + " m n" * 12)]
    got = sorted((tuple(r) for r in periods.periods_digest(frame(spark, rows)).collect()), key=str)
    assert got == period_rows(rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if i is not None)
    empty = periods.periods_digest(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_collapsed_text_is_an_output(spark):
    rows = {r["doc_id"]: r for r in periods.collapse_runs(frame(spark, [(1, "s " + "a b c " * 9 + "t"), (2, None)])).collect()}
    assert rows[1]["collapsed"] == "s a b c t" and [tuple(x) for x in rows[1]["runs"]] == [(1, 27, 3)]
    assert rows[2]["collapsed"] == "" and rows[2]["runs"] == [] and rows[2]["n_words"] == 0


# ---- SimHash

def fingerprint(text, width=3):
    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[k:k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=2):
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            r = root(f)
            least[r] = min(least.get(r, i), i)
    return {f: least.get(root(f)) for f in prints}


def texts():
    rng = random.Random(5)
    vocabulary = [f"Wörd{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(2500)]
    out = []
    for k in range(40):  # fingerprints of long near copies differ in a few bits
        copy = list(base)
        for _ in range(k % 7):
            copy[rng.randrange(len(copy))] = "edit"
        out.append("\t".join(copy))
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    out += [None, "", " \n", "a", "A", "a b", "a  b", "a b c", "same " * 50, "x" * 120_000 + " y z", out[0], out[0].upper()]
    return [*enumerate(out), (3, out[3]), (None, out[45]), (None, None), (None, "alone without id")]


def test_simhash_digest(spark):
    rows = texts()
    got = sorted((tuple(r) for r in simhash.simhash_digest(frame(spark, rows)).collect()), key=str)
    prints = [(i, fingerprint(t)) for i, t in rows]
    named = components(prints)
    assert got == sorted(((i, f"{f:016x}", named[f]) for i, f in prints), key=str)
    assert len({f for _, f in prints[:40]}) > 5 and len({named[f] for _, f in prints[:40]}) < 10
    assert simhash.simhash_digest(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("crowd", [2, 16])
def test_links_of_crowded_fingerprints(spark, monkeypatch, radius, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(9)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(6):  # clouds of fingerprints, chains of two bits, and loose ones
        at = rng.getrandbits(64)
        for _ in range(60):
            prints.add(at)
            for _ in range(rng.choice((1, 1, 2, 2, 3))):
                at ^= 1 << rng.randrange(64 if rng.random() < .3 else 12)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    links = [(r["u"], r["v"]) for r in simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()]
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= radius and u != v for u, v in links)
    parent = {f: f for f in signed}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for u, v in links:
        parent[root(u)] = root(v)
    wanted = components([(f, f & (1 << 64) - 1) for f in sorted(signed)], radius)
    groups = {}
    for f in signed:
        groups.setdefault(root(f), set()).add(wanted[f & (1 << 64) - 1])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(wanted.values()))


def test_radius_is_checked(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), 3)


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, n int, component string, label int"


def vector_rows(rows, components=8):
    good = [(i, [math.floor(1024 * np.float64(np.float32(c))) + 100_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    good = [(i, v) for i, v in good if len(v) == dim]
    n, total = len(good), [sum(v[k] for _, v in good) for k in range(dim)]
    y = [[n * a - s for a, s in zip(v, total)] for _, v in good]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n ** 3)) for b in range(dim)] for a in range(dim)])
    values, axes = np.linalg.eigh(cov)
    top = np.argsort(-values)[:components]
    z = np.array(y, float) / n @ axes[:, top] / np.sqrt(values[top])
    return [i for i, _ in good], n, [sum(a * a for a in r) for r in y], z, values[top] / np.trace(cov)


def random_vectors(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim)) * np.linspace(1, .1, dim)[:, None]
    return [(i, (rng.normal(size=dim) @ mix).tolist()) for i in range(n)]


@pytest.mark.parametrize("dim", [12, 3])
def test_whitening(spark, dim):
    rows = random_vectors(80, dim)
    rows += [(100, None), (101, []), (102, [None] * dim), (103, [float("nan")] * dim), (104, [1.0] * (dim - 1) + [float("inf")]),
             (105, [1.0]), (5, rows[5][1]), (None, rows[6][1]), (106, [-0.0] * dim)]
    ids, n, deviation, z, explained = vector_rows(rows)
    data = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(5)
    got = whitening.whiten(data).collect()
    k = min(8, dim)
    assert len(got) == n * k and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault((str(r["vec_id"]), r["deviation"]), {}).setdefault(r["component"], []).append(r)
    signs = {}
    for i, d, row in zip(ids, deviation, z):
        for c in range(k):
            r = by[str(i), d][c + 1][0]
            assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(row[c]), rel=1e-6, abs=1e-9)
            if abs(row[c]) > 1e-3:
                signs.setdefault(c, set()).add(np.sign(row[c]) == np.sign(r["whitened"]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_is_exact_beyond_64_bits(spark):
    rows = [(i, [v * 3e9 for v in vec]) for i, vec in random_vectors(30, 4)]
    data = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    ids, n, deviation, z, explained = vector_rows(rows)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(data).collect()}
    for i, d, row in zip(ids, deviation, z):
        assert got[i, 1]["deviation"] == (d if d < 1 << 63 else None)
        assert abs(got[i, 1]["whitened"]) == pytest.approx(abs(row[0]), rel=1e-9)
    x = np.array([[2**40, -2**39], [3, 2**41]])
    assert whitening._square_sum(x) == [2**80 + 9, 2**78 + 2**82]


def test_whitening_without_variance(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    none = whitening.whiten(make([(1, None), (2, [])]))
    assert none.count() == 0 and whitening.whiten(make([])).count() == 0
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(make([(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    flat = whitening.whiten(make([(i, [float(i), 5.0, 2.0 * i]) for i in range(9)])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True}
    assert flat[0]["identity_error"] < 1e-9


def test_polarisation_table(spark):
    rows = random_vectors(50, 5)
    data = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).select("embedding").repartition(3)
    n, total = whitening.sums(data, 5)
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 1024).astype(int) + 100_000
    assert (n, total) == (50, x.sum(axis=0).tolist())
    y = n * x - x.sum(axis=0)
    table = whitening.squares(data, 5, n, total)
    assert all(table[i][i] == int((y[:, i] ** 2).sum()) for i in range(5))
    assert all(table[i][j] == int(((y[:, i] + y[:, j]) ** 2).sum()) for i in range(5) for j in range(i + 1, 5))
