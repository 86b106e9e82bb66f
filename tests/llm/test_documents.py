"""Operators on single documents and records: mixing, sharding, toxicity, rules, classifier, revisits, pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from atrium.llm import classifier, mixing, rules, sharding, toxicity, warc

DOCS = "doc_id long, text string, source string, size string, key string, shard int, take string"


def rows():
    out = [(i, "w " * (1 + i % 7 + 40 * (i % 11 == 0)), "s" + str(i % 4), "a", "b", 5, "c") for i in range(200)]
    out += [(500 + i, "copy of one text", "hot", None, None, None, None) for i in range(150)]
    return out + [(900, None, "s1", "", "", 0, ""), (901, "", None, "", "", 0, ""), (902, "three words here", None, "", "", 0, ""), (None, "a b", "s2", "", "", 0, ""),
                  (3, out[3][1], "s3", "a", "b", 5, "c"), (903, None, "empty", "", "", 0, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def targets_by_hand(sizes):
    order = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {k for k in sizes if not sizes[k]}
    while True:
        level = (total - sum(2 * sizes[k] for k in capped)) / max(1, sum(weight[k] for k in sizes if k not in capped))
        over = {k for k in sizes if 2 * sizes[k] <= level * weight[k]} | capped
        if over == capped:
            return {k: 2.0 * sizes[k] if k in capped else level * weight[k] for k in sizes}
        capped = over


def test_mix_meets_targets_and_repeats(docs, nothing):
    mixed = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for r in rows():
        sizes[r[2]] += len((r[1] or "").split())
    want = targets_by_hand(sizes)
    taken = Counter()
    for r in mixed:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-9)
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    assert len(mixed) == len(rows()) and all(abs(taken[s] - want[s]) <= 4 for s in sizes)
    assert Counter(map(tuple, mixed)) == Counter(map(tuple, mixing.mix_sources(docs).collect()))
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    assert whole.count() == sum(r.copies for r in mixed)
    assert mixing.mix_sources(nothing).count() == 0


def test_knapsack_reaches_every_reachable_budget():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = rng.choice(np.arange(2, 30), 5, replace=False).tolist()
        counts = rng.integers(1, 4, 5).tolist()
        sums = {0}
        for n, c in zip(lengths, counts):
            sums |= {s + n * k for s in sums for k in range(1, c + 1)}
        budget = int(rng.integers(0, 80))
        found = mixing.fit_lengths(lengths, counts, budget)
        assert sum(n * k for n, k in found.items()) == max(s for s in sums if s <= budget)
        assert all(k <= dict(zip(lengths, counts))[n] for n, k in found.items())


def test_shards_are_exact_and_gapless(docs, nothing):
    out = sharding.shuffle_to_shards(docs).collect()
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows())
    digest = {r.doc_id: r for r in sharding.shard_digest(docs).collect()}
    assert digest[900].size == 1 and digest[900].text_crc32 == 0
    assert digest[902].text_crc32 == zlib.crc32(b"three words here") and digest[902].law == "rows"
    assert sharding.shuffle_to_shards(nothing).count() == 0


def test_hypergeometric_has_the_right_law():
    rng = np.random.default_rng(0)
    draws = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(draws.mean() - 6) < 0.15 and abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.35
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    big = sharding.hypergeometric(rng, 10**13, 3 * 10**13, 10**6)
    assert abs(big - 250_000) < 5_000
    matrix = np.array(sharding.communication_matrix([7, 0, 13, 30], 8, 1))
    assert matrix.sum(axis=1).tolist() == [7, 0, 13, 30] and sorted(matrix.sum(axis=0).tolist()) == [6] * 6 + [7] * 2


def test_grammar_weighs_context():
    scorer = toxicity.Scorer(toxicity.Model({"fool": 4.0}, {"stup": 4.0}, -2.0))
    weight = lambda text: sum(w for _, w in scorer.clauses(text))
    assert weight("what a fool") == 4.0
    assert weight("you fool") > weight("a fool") > weight("they said a fool") > 0
    assert weight("not a fool") < weight("a fool")
    assert weight("not now. a fool") == weight("a fool")
    assert weight("I will kill you") == weight("you I will kill") == 4.0  # a target on either side
    for threat, denial, said in (("I will kill you", "I will not kill you", "he said I will kill you"), ("ich werde dich töten", "ich werde dich nicht töten", "er sagt ich werde dich töten"),
                                 ("je vais te tuer", "je vais jamais te tuer", "il écrit je vais te tuer"), ("voy a matar a ellos", "nunca voy a matar a ellos", "dijo voy a matar a ellos")):
        assert weight(threat) > weight(said) > 0 and weight(threat) > weight(denial), threat
        assert scorer.score(scorer.clauses(threat)) > 0.7 > scorer.score(scorer.clauses(said))
    assert weight("they kill time. you wait") < 1.0 + weight("they kill time") and weight("a kill") < 1.0
    assert [c for c, _ in scorer.clauses("fine here. you stupids! done")] == ["you stupids!"]
    assert scorer.clauses(None) == scorer.clauses("") == []
    assert scorer.score([]) == pytest.approx(1 / (1 + math.exp(2)))


def test_composition_multiplies_factors():
    a = toxicity.within(toxicity.NEGATION, 1, {toxicity.INSULT: 0.5}, {})
    b = toxicity.within(toxicity.REPORT, 1, {toxicity.INSULT: 0.1}, {})
    both = a.then(b)
    state, total = 0, 1.0
    for s in (toxicity.REPORT, toxicity.INSULT):
        state, _, f = both.arcs[state][s]
        total *= f
    assert total == pytest.approx(0.1)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    more = spark.createDataFrame([(5000, None), (5001, ""), (None, "x")], "doc_id long, text string")
    out = toxicity.toxicity_digest(docs.select("doc_id", "text").union(more), labels)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == docs.count() + 3 and 0 <= got[5000].score == got[5001].score < 0.5
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in truth)
    hits = Counter((truth[d], got[d].predicted) for d in truth)
    assert hits[1, 1] >= 0.5 * (hits[1, 1] + hits[1, 0]) and hits[0, 1] <= 0.02 * (hits[0, 0] + hits[0, 1])
    assert toxicity.train(docs.limit(0), labels).words == {}


def test_rules_estimate_and_keep(spark, docs, nothing):
    patterns = np.array([[1, 1, 1], [0, 0, 1], [1, -1, 1], [0, -1, 0]])
    accuracy = rules.estimate(patterns, np.array([800.0, 60.0, 100.0, 40.0]))
    assert 0.8 < accuracy.prior < 0.97 and (accuracy.log_odds()[:, 1] >= 0).all()
    assert rules.estimate(np.zeros((0, 3), int), np.zeros(0)).prior == 0.8
    text = " ".join(f"Word{k} and then word{k + 1} is the one{k} for{k} in plain{k}." for k in range(20))
    some = spark.createDataFrame([(i, text) for i in range(30)] + [(50, "!! ## " * 80), (51, None), (52, ""), (53, "word " * 100)], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.judge_quality(some).collect()}
    assert got[0].kept and not got[50].kept and got[51].base_failed and got[52].n_words == 0 and got[53].base_failed
    assert rules.judge_quality(nothing).count() == 0
    assert rules.keep_good(some).count() == 30


def test_classifier_agrees_with_labels(spark, nothing):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    more = spark.createDataFrame([(5000, None), (5001, ""), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in classifier.classify_quality(docs.select("doc_id", "text").union(more)).collect()}
    assert len(got) == docs.count() + 3
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [got[d].kept for d in truth if truth[d] == 1]
    bad = [got[d].kept for d in truth if truth[d] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2
    assert classifier.classify_quality(nothing).count() == 0


RECORDS = "record_id long, url string, captured long, kind string, headers map<string,string>, body string, outcome string"


def records():
    page = lambda i, at, url="http://a.org/x", tag="1", **more: (i, url, at, "response", {"etag": tag, "server": "s", **more}, f"body{i}", "?")
    ask = lambda i, at, url="https://www.a.org/x/#f", **h: (i, url, at, "revisit", {k.replace("_", "-"): v for k, v in h.items()}, None, "?")
    return [
        page(1, 10), page(2, 20, tag="2"), page(3, 20, tag="3"), ask(10, 15, etag="W/1", date="d", server="no"), ask(11, 20, etag="1"), ask(12, 21, etag="3"),
        ask(13, 21, etag="2"), ask(14, 5, etag="1"), ask(15, 30), ask(16, 30, url=None, etag="1"), ask(17, None, etag="1"), ask(18, 99, url="http://b.org", etag="1"),
        page(4, 40, url="http://c.org/?b=1&a=2&utm_source=q", last_modified="m") , ask(19, 41, url="http://C.org:80?a=2&b=1", last_modified="m"),
        ask(12, 21, etag="3"), (30, "http://a.org/x", None, "response", {"etag": "9"}, "late", "?"), (31, "http://a.org/x", 50, "revisit", None, None, "?"),
    ]


def test_revisits_find_the_latest_earlier_response(spark):
    given = [r if r[0] != 4 else (4, r[1], 40, "response", {"last-modified": "m"}, "body4", "?") for r in records()]
    out = warc.resolve_revisits(spark.createDataFrame(given, RECORDS), ranges=5).collect()
    got = {r.record_id: (r.response_id, r.outcome, r.body) for r in out}
    assert len(out) == sum(r[3] == "revisit" for r in given)
    assert got[10] == (1, "resolved", "body1") and got[11] == (1, "resolved", "body1") and got[12] == (3, "resolved", "body3")
    assert got[13] == (3, "mismatch", None) and got[14] == (None, "no_response", None) and got[15] == (3, "no_validator", None)
    assert got[16][1] == got[17][1] == got[18][1] == "no_response" and got[19] == (4, "resolved", "body4") and got[31] == (3, "no_validator", None)
    merged = next(r.headers for r in out if r.record_id == 10)
    assert merged == {"etag": "W/1", "date": "d", "server": "s"}
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_pipeline_decides_per_row(spark):
    from atrium.llm import decontamination, jaccard, mixing

    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron"
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, root string, held string, draw string, _row string"
    make = lambda rows: spark.createDataFrame([(i, t, k, "s", 1, *"abcde") for i, t, k in rows], schema)
    copies = [(1, text, "x"), (1, text, "y"), (None, text, "z"), (2, text, "x"), (None, None, "x"), (7, "", "x"), (None, leak, "a"), (None, leak, "b"), (9, "a b", "x")]
    kept = jaccard.one_of_each(make(copies))
    assert kept.columns == make([]).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, text), (None, None), (7, ""), (None, leak), (9, "a b")], key=str)
    bench = spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string")
    clean = decontamination.without_leaks(make([*copies, (1, leak, "x"), (3, "before " + leak.upper() + " after", "x")]), bench)
    assert sorted(((r.doc_id, r.text, r.lang) for r in clean.collect()), key=str) == sorted([c for c in copies if c[1] != leak], key=str)
    rows = [(1, "a b c", "x"), (1, "d e f", "y"), (None, "a b c", "x"), (None, "g h i", "x"), (None, "g h i", "y"), (4, "k l m", "x")]
    first = sorted(map(tuple, mixing.mixed_documents(make(rows)).collect()), key=str)
    again = sorted(map(tuple, mixing.mixed_documents(make(rows[::-1]).repartition(5)).collect()), key=str)
    assert first == again and first
    for stage in (jaccard.one_of_each, lambda d: decontamination.without_leaks(d, bench), mixing.mixed_documents):
        assert stage(make([])).count() == 0


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before, after = docs.columns, docs, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, folder).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name != "sharding":
            assert after.columns == columns
        if name in ("toxicity", "jaccard_join", "decontamination"):
            assert 0 < after.count() <= before.count() and after.exceptAll(before).count() == 0
        before = after
    assert {"shard", "slot"} <= set(after.columns)
    assert corpus_pipeline.run(spark, folder).count() == after.count()
