"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, other); transducers for negation,
reported speech, targets and threats are composed into one machine that walks each clause and
weighs its insults and threats in context.  The scores of a document's clauses add up to log-odds.

Insults are learned: words, and word beginnings, that labelled training rows hold much more often
when toxic.  The training sample is bounded by ``SAMPLE`` rows (those of lowest seeded hash), the
lexicon by ``TERMS`` entries; both are parameters.

Defined results: null and empty texts have no clause and get the prior as score; without any
labelled row of both kinds the lexicon is empty and only fixed threats count; repeated rows score
alike; labels repeated for one document count once each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.llm.words import slices
from atrium.session import cut_lineage

SAMPLE = 30_000
TERMS = 20_000
PREFIXES = (4, 5, 6)
NO_SCORE = 0.7

# Closed word classes of four languages.
TARGETS = """you your youre yourself they them their he him she her du dich dir dein deine ihr euch ihn sie tu toi te vous ton ta
eux lui elle usted ustedes vosotros ti ellos ellas""".split()
NEGATIONS = "not no never isnt arent wasnt dont doesnt nobody nicht kein keine nie niemals ne jamais aucun nunca jamás tampoco".split()
REPORTS = """said says saying wrote writes quoted quote claimed claims reported reports called sagte sagt schrieb behauptete zitierte
dit disait écrit affirme dijo dice escribió afirma""".split()
THREATS = """kill hurt destroy beat punch shoot stab burn strangle töten umbringen schlagen verletzen erschießen tuer frapper blesser
détruire matar golpear herir disparar""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DENIED = range(7)  # DENIED is only written, for a negated threat
SYMBOLS = range(7)
THREAT_STRENGTH, TARGET_STRENGTH = 4.0, 0.5
ALONE = 0.15  # share of a threat that has no target
CLAUSE_END = re.compile(r"[.!?;:,]['\")\]]*$")
LINE = re.compile(r"\n")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Transducer(NamedTuple):
    """Letter transducer: ``arcs[state][symbol] = (next state, symbol out, factor)``; starts in state 0."""

    arcs: list[list[tuple[int, int, float]]]

    def then(self, other: Transducer) -> Transducer:
        """Composition: the other machine reads what this one writes; factors multiply."""
        states, todo, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = []
            for s in SYMBOLS:
                to_a, middle, f = self.arcs[a][s]
                to_b, out, g = other.arcs[b][middle]
                if (to_a, to_b) not in states:
                    states[to_a, to_b] = len(states)
                    todo.append((to_a, to_b))
                row.append((states[to_a, to_b], out, f * g))
            arcs.append(row)
        return Transducer(arcs)


def within(opens: int, reach: int, inside: dict[int, float], outside: dict[int, float]) -> Transducer:
    """Symbol ``opens`` starts a scope of ``reach`` words; the factors of other symbols depend on being in it."""
    arcs = []
    for left in range(reach + 1):
        factors = inside if left else outside
        arcs.append([(reach if s == opens else max(left - 1, 0), s, factors.get(s, 1.0)) for s in SYMBOLS])
    return Transducer(arcs)


def denied(machine: Transducer) -> Transducer:
    """The same machine, writing DENIED for threats whose factor it lowers."""
    return Transducer([[(to, DENIED if s == THREAT and f < 1 else out, f) for s, (to, out, f) in zip(SYMBOLS, row)] for row in machine.arcs])


def aimed(reach: int) -> Transducer:
    """Targets and threats on either side of each other.

    States tell how far a target still reaches and for how many words a threat still waits for one.
    A threat near an earlier target counts in full.  Any other writes a share at once and delays the
    rest until a target comes, which then counts as the threat; without one the rest is never
    written.  Insults after a target weigh more.
    """
    delayed = (1 - ALONE) * THREAT_STRENGTH / TARGET_STRENGTH
    states = [(t, w) for t in range(reach + 1) for w in range(reach + 1)]
    place = {s: i for i, s in enumerate(states)}
    arcs = []
    for t, w in states:
        row = []
        for s in SYMBOLS:
            to, out, factor = (max(t - 1, 0), max(w - 1, 0)), s, 1.0
            if s == TARGET:
                to, out, factor = (reach, 0), *((THREAT, delayed) if w else (TARGET, 1.0))
            elif s == THREAT and not t:
                to, factor = (0, reach), ALONE
            elif s == INSULT and t:
                factor = 1.25
            row.append((place[to], out, factor))
        arcs.append(row)
    return Transducer(arcs)


def grammar() -> Transducer:
    """Negation, reported speech, targets around threats, and insult before a target, composed."""
    negation = denied(within(NEGATION, 3, {INSULT: 0.35, THREAT: 0.2}, {}))
    report = within(REPORT, 40, {INSULT: 0.5, THREAT: 0.4, DENIED: 0.4, TARGET: 0.5}, {})
    target = aimed(4)
    insult = within(INSULT, 4, {}, {TARGET: 0.0})
    return negation.then(report).then(target).then(insult)


class Model(NamedTuple):
    words: dict[str, float]
    prefixes: dict[str, float]
    prior: float

    def classify(self, word: str) -> tuple[int, float]:
        """Symbol and strength of a word."""
        w = word.lower().strip(string.punctuation)
        weight = self.words.get(w, 0.0)
        if not weight:
            weight = max((self.prefixes.get(w[:n], 0.0) for n in PREFIXES if len(w) > n), default=0.0)
        if weight:
            return INSULT, weight
        plain = w.replace("'", "").replace("’", "")
        for words, symbol, strength in ((THREATS, THREAT, THREAT_STRENGTH), (TARGETS, TARGET, TARGET_STRENGTH), (NEGATIONS, NEGATION, 0.0), (REPORTS, REPORT, 0.0)):
            if plain in words:
                return symbol, strength
        return OTHER, 0.0


class Scorer:
    """The grammar and lexicon, ready to score texts; the word cache is emptied when full."""

    def __init__(self, model: Model, cache: int = 200_000):
        self.model, self.arcs, self.cache, self.most = model, grammar().arcs, {}, cache

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= self.most:
                self.cache.clear()
            found = self.cache[word] = self.model.classify(word)
        return found

    def clauses(self, text: str | None) -> list[tuple[str, float]]:
        """Matched clauses (those with an insult or a threat) and their weights."""
        out = []
        for line in LINE.split(text or ""):
            words = WORDS.findall(line)
            symbols = [self.symbol(w) for w in words]
            if not any(s == INSULT or s == THREAT for s, _ in symbols):
                continue
            begin, state, weight, hit = 0, 0, 0.0, False
            for i, (symbol, strength) in enumerate(symbols):
                state, out_symbol, factor = self.arcs[state][symbol]
                weight += factor * strength
                hit |= symbol in (INSULT, THREAT)
                if i + 1 == len(words) or CLAUSE_END.search(words[i]):
                    if hit:
                        out.append((" ".join(words[begin:i + 1]), weight))
                    begin, state, weight, hit = i + 1, 0, 0.0, False
        return out

    def score(self, clauses: list[tuple[str, float]]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.model.prior + sum(w for _, w in clauses)))))


def is_held_out(doc_id) -> F.Column:
    """Rows that are never learned from; a null id counts as the empty text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3 == 1


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(rows["text"], rows["toxic"]):
            (toxic if label else clean).update({w.lower().strip(string.punctuation) for w in WORDS.findall(text or "")})
        terms = list(toxic.keys() | clean.keys())
        yield pd.DataFrame({"term": terms, "toxic": [toxic[t] for t in terms], "clean": [clean[t] for t in terms]})


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found = [WORDS.findall(t or "") for t in rows["text"]]
        yield rows.assign(sketch=[min((zlib.crc32(" ".join(w[i:i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0) for w in found])


def _lexicon(counts: DataFrame, toxic: int, clean: int, least: int, weight: float, limit: int) -> dict[str, float]:
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    kept = counts.withColumn("odds", odds).filter((F.col("toxic") >= least) & (F.col("odds") >= weight))
    best = kept.orderBy(F.desc(F.col("odds") * F.col("toxic")), "term").limit(limit)
    return {r["term"]: min(r["odds"], 8.0) for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, seed: int = 3) -> Model:
    """Lexicon and prior from labelled rows that are not held out."""
    usable = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    # copies of one text would make its rare words look like evidence: one row for each least shingle
    first = W.partitionBy("sketch").orderBy("doc_id", "text", "toxic")
    rows = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text") \
        .mapInPandas(_sketches, "doc_id long, toxic int, text string, sketch long")
    rows = cut_lineage(rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("text", "toxic"))
    sizes = {bool(r["toxic"]): r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Model({}, {}, -2.0)
    counts = rows.mapInPandas(_terms, "term string, toxic long, clean long").groupBy("term") \
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("length(term) > 1")
    words = _lexicon(counts, toxic, clean, max(6, toxic // 200), 4.0, terms)
    starts = counts.select(F.explode(F.filter(F.transform(F.array(*map(F.lit, PREFIXES)), lambda n: F.when(
        F.length("term") > n, F.substring(F.col("term"), F.lit(1), n))), lambda p: p.isNotNull())).alias("term"), "toxic", "clean") \
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    prefixes = _lexicon(starts, toxic, clean, max(12, toxic // 100), 5.0, terms)
    return Model(words, prefixes, math.log((toxic + 1) / (clean + 1)))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), clauses (text and weight of every matched clause)."""

    kind = pa.list_(pa.struct([("clause", pa.string()), ("weight", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for rows in slices(batches):
            found = [scorer.clauses(t) for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array([scorer.score(c) for c in found], pa.float64()),
                pa.array([[{"clause": t, "weight": w} for t, w in c] for c in found], kind)], names=["doc_id", "score", "clauses"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(score, "doc_id long, score double, clauses array<struct<clause string, weight double>>")


def without_toxic(docs: DataFrame, model: Model, limit: float = NO_SCORE) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``limit``."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for rows in slices(batches):
            yield rows.filter(pa.array([scorer.score(scorer.clauses(t)) < limit for t in rows.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= NO_SCORE).cast("int").alias("predicted"), F.size("clauses").alias("n_clauses"))
