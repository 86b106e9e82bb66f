"""Operators on pairs and passages against brute force, on texts with every awkward case."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from atrium.llm import decontamination, fm_index, jaccard, lines, substrings
from atrium.llm.words import WORD

SCHEMA = "doc_id long, text string, node string, n string, minimizer string, lang string"


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages and lines, repeats, nulls, blanks, one very long text, repeated rows."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage, out = make(120), make(50), []
    for k in range(12):
        copy = list(base)
        for _ in range(k // 2):
            copy[rng.randrange(len(copy))] = "edit"
        out.append(" ".join(copy))
    out += [" ".join(make(60) + passage + make(30)) for _ in range(4)]
    out += ["Common line here for all.\n" + " ".join(make(40)) for _ in range(5)]
    out += [" ".join(make(2000)), "same " * 90, None, "", " \n\t", "a b", "A b", "a b c d e", out[0], out[1].upper(), "\n".join([" ".join(make(15))] * 3)]
    rows = [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (None, out[0]), (None, None), (50, None)]
    return [(i, t, "x", "y", "z", "en") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(text):
    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(docs, nothing):
    rows = corpus()
    sets = [sets_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows))
    found = jaccard.link_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == want
    assert jaccard.link_components(nothing).count() == 0


def test_short_near_copies_link_when_all_they_share_is_hot(spark):
    texts = [" ".join([f"h{length}x{k}" for k in range(length - 1)] + [f"own{i}"]) for length in range(11, 15) for i in range(70)]
    seven = " ".join(f"s{k}" for k in range(7))
    texts += [seven] + [f"{seven} more{i}" for i in range(70)]
    sets, component = [sets_of(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if component[i] != component[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    assert len(set(component)) == 5
    found = jaccard.link_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(component))


def test_signature_tree_finds_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(300) < keep], rng.integers(0, 1 << 62, 40, dtype=np.uint64)]) for keep in rng.uniform(0.5, 1, 60)]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    sig = np.stack([jaccard.signature(s, 512) for s in sets])
    found = set()
    for a, b in jaccard.candidate_pairs(np.zeros(60, int), n, sig, np.arange(60), 75):
        found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    linked = {(i, j) for j in range(60) for i in range(j)
              if 100 * (c := jaccard.overlap(sets[i], sets[j])) >= 75 * (n[i] + n[j] - c)}
    assert linked and linked <= found and len(found) < 60 * 59 // 2


def test_substrings_against_a_count_of_windows(docs, nothing):
    rows = corpus()
    texts = [re.findall(WORD, r[1] or "") for r in rows]
    seen = Counter(tuple(w[k:k + 35]) for w in texts for k in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, texts):
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for j in range(35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(map(tuple, substrings.dedup_digest(docs).collect())) == want
    assert substrings.dedup_digest(nothing).count() == 0


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(2)
    text = np.r_[rng.integers(1, 4, 200), 0]
    index = fm_index.FMIndex(text, np.ones(len(text), np.int64))
    for length in (1, 3, 6):
        for at in range(0, 190, 17):
            low, high = np.array([0]), np.array([len(text)])
            for symbol in text[at:at + length][::-1]:
                low, high = index.extend(np.array([symbol]), low, high)
            want = sum(np.array_equal(text[k:k + length], text[at:at + length]) for k in range(len(text) - length + 1))
            assert index.weight(low, high)[0] == want


def test_lines_keep_one_of_each_component(docs, nothing):
    rows = corpus()
    places, kinds = [], {}
    for r in rows:
        for k, line in enumerate((r[1] or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                places.append(((r[0] is None, r[0] or 0), k, line.strip(" \t\n\v\f\r").encode()))
    kinds = list(dict.fromkeys(p[2] for p in places))
    parent = {k: k for k in kinds}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(kinds):
        for y in kinds[:i]:
            if lines.jaccard(x, y) >= lines.SIMILARITY:
                parent[root(x)] = root(y)
    keep = {}
    for p in places:
        keep[root(p[2])] = min(keep.get(root(p[2]), p[:2]), p[:2])
    gone = Counter()
    for p in set(places):
        gone[p[0]] += p[:2] != keep[root(p[2])]
    found = {(r.doc_id is None, r.doc_id or 0): r.n_removed for r in lines.dedup_lines(docs).collect() if r.kept_text or r.n_removed}
    assert found == {k: gone[k] for k in found} and sum(gone.values()) == sum(found.values())
    assert lines.dedup_lines(nothing).count() == 0


def test_crowded_bands_go_in_rounds(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old grey house on the hill "
    rows = [(i, base + base[i:i + 3] + str(i % 40)) for i in range(60)] + [(99, "quite another line without any likeness")]
    kept = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.filter("n_removed = 0").collect()) == [0, 99]


def test_lines_that_repeat_themselves_link_at_any_length(spark):
    few = ["-" * 10, "-" * 30, "Nd" * 50, "Nd" * 150]
    many = ["=" * k for k in (10, *range(31, 31 + lines.ALL_PAIRS))]
    kept = lines.dedup_lines(spark.createDataFrame(list(enumerate(few + many)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.filter("n_removed = 0").collect()) == [0, 2, 4]


def test_leaks_against_every_window(spark, docs, nothing):
    rng = random.Random(9)
    item = [f"q{rng.randrange(500)}" for _ in range(40)]
    near = item[:20] + ["changed"] + item[21:]
    far = [w if k % 4 else "no" for k, w in enumerate(item)]
    filler = [f"f{k}" for k in range(300)]
    texts = [(1000, " ".join(filler + item + filler)), (1001, " ".join(near).title()), (1002, " ".join(far)), (1003, "; ".join(filler[:9] + item)),
             (1004, " ".join(item[:38])), (1005, None), (1006, "q1"), (None, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item), 1), (8, "", 2), (9, None, 3), (10, "x y", 4), (7, " ".join(item), 5)], "item_id long, text string, doc_id int")
    found = decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == Counter({(d, 7): 2 for d in (1000, 1001, 1003, 1004, None)})
    assert {r.first_word for r in found if r.doc_id == 1000} == {300}
    parts = decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench, block=1)
    assert Counter((r.doc_id, r.item_id) for r in parts.collect()) == Counter((r.doc_id, r.item_id) for r in found)
    assert decontamination.find_leaks(nothing, bench).count() == 0
    clean = decontamination.without_leaks(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_short_items_are_found_inside_long_texts(spark):
    filler = " ".join(f"f{k}" for k in range(50))
    short = {1: "solo", 2: "x y", 3: "p q r", 4: "alpha beta gamma delta", 5: "one two three four five"}
    texts = [(k, f"{filler} {t.title()}, {filler}") for k, t in short.items()] + [
        (6, f"{filler} x"), (7, f"y {filler}"), (8, f"p q {filler} r"), (9, f"{filler} x y"), (10, "x y"), (11, "x"), (12, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(list(short.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.similarity, r.first_word, r.n_words) for r in decontamination.find_leaks(docs, bench).collect()}
    assert found == {(k, k, 1.0, 50, k) for k in short} | {(9, 2, 1.0, 50, 2), (10, 2, 1.0, 0, 2)}


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"v{x}" for x in rng.integers(0, 900, 30))) for k in range(20)]
    index = decontamination.ItemIndex(items)
    _, prints, _, _ = index.by_length[30]
    probes = np.concatenate([prints ^ np.packbits(rng.random((20, 64)) < share, axis=1) for share in (0.0, 0.1, 0.2, 0.25, 0.5)])
    row, item = index.near(30, probes)
    far = np.bitwise_count(probes[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    assert set(zip(row.tolist(), item.tolist())) == set(zip(*map(list, np.nonzero(far <= decontamination.RADIUS))))


def near_lines(seed: int, groups: int) -> list[str]:
    """Lines with one altered copy each, some shorter than a shingle, some that repeat themselves."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        line = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60, 200))).strip()
        at = rng.randrange(len(line))
        out += [line, line[:at] + "Z" + line[at + 1:]]
    return [*out, "abc", "abcd", "x" * 8, "x" * 90, "x" * 91, "abcdefgh"]


def test_line_overlaps_against_sets():
    texts = [s.encode() for s in near_lines(3, 40)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    left, right = zip(*((texts[i], texts[j]) for i, j in pairs))
    assert lines.overlaps(left, right, 0.8).tolist() == [lines.jaccard(x, y) >= 0.8 for x, y in zip(left, right)]
    assert lines.overlaps([b"abc"], [b"abcd"], 0.8).tolist() == [False] and not len(lines.overlaps([], [], 0.8))


def test_lines_that_stay_against_every_pair(spark):
    texts = near_lines(11, 150)
    kept = {r.doc_id: r.kept_text for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    raw = [s.encode() for s in texts]
    similar = [(j, i) for i in range(len(raw)) for j in range(i) if raw[i] == raw[j] or lines.jaccard(raw[i], raw[j]) >= 0.8]
    later = {i for _, i in similar}  # groups of two or of equal sets, so the first of each pair stays
    lost = sum(kept[i] == texts[i] for i in later)
    assert len(later) > 100 and lost <= 0.02 * len(later)
    assert all(kept[i] == ("" if i in later and kept[i] == "" else texts[i]) for i in kept)
