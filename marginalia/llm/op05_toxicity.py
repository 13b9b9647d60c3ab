"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech or other. Five transducers read a clause's symbols. The insult
and threat transducers mark what hurts, the target transducer tells whether it is aimed at someone, the negation transducer whether it is
denied, and the reported-speech transducer whether it is quoted; composed into one table they give each insult or threat of a clause one
event. A text's score is a logistic function of the weights of its matched clauses by event, so an isolated word counts for what its
clause makes of it.

Insult words are learned: beginnings of words (of 4 letters and more) and whole words that toxic documents of the training sample hold far
more often than others, each with its log-odds, less their uncertainty, as the arc's weight. Copies of one text count once in this. The weights of the events come
from a logistic regression on features that each FOLDS-th of the sample gets from the words of the rest.

The sample is bounded: at most SAMPLE labelled rows of either label, those whose hashed doc_id is least. Everything else goes over all rows.

Defined results: null and empty texts have no clause and get the model's score for none; texts are taken whole; labels without a
document, null labels and documents without a label teach nothing; several labels of one document all count; without labels of both
kinds every score is the share of label 1 (0.5 if there are none); repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import text as T
from marginalia.session import Scratch, ship

SAMPLE = 4000
#: Beginnings and words that the grammar may learn at most, the weightiest first; what is learned, not what is scored.
LEXICON = 20_000
SHORTEST, LONGEST = 4, 10
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")
_STOP = frozenset(".!?;:\n")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Fixed words of the grammar.
TARGETS = "you your yours yourself u they them their he she him her these those people tu te toi vous votre ils elles du dich dir ihr euch sie tú usted ustedes ellos vosotros".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't didn't neither nor nicht kein keine nie jamais pas aucun nunca jamás tampoco".split()
REPORTS = "said says told wrote quoted called claimed reported according dit disait écrit selon sagte schrieb laut dijo dice escribió según".split()
THREATS = "kill hurt destroy punch stab shoot burn beat strangle murder attack tuer frapper töten schlagen matar golpear".split()
FIXED = {w: s for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}

#: What the composed transducer says of an insult or a threat.
EVENTS = ("insult", "insult_aimed", "insult_denied", "insult_quoted", "threat", "threat_aimed", "threat_denied", "threat_quoted")


@dataclass
class Transducer:
    """step(state, symbol) -> (next state, output); states are hashable, the start state is 0."""

    step: object

    def then(self, other: Transducer) -> Transducer:
        """The composition: the other reads what this one writes."""

        def step(state, symbol):
            a, b = state or (0, 0)
            a, out = self.step(a, symbol)
            b, out = other.step(b, out)
            return (a, b), out

        return Transducer(step)


def _scope(mark: int, length: int, flag: str) -> Transducer:
    """After the marking symbol, the next length symbols carry the flag; what is marked stays so till the scope ends."""

    def step(state, symbol):
        base, flags = symbol if isinstance(symbol, tuple) else (symbol, frozenset())
        if base == mark:
            return length, (base, flags)
        return max(0, state - 1), (base, flags | {flag} if state else flags)

    return Transducer(step)


def _event(_, symbol):
    base, flags = symbol
    if base not in (INSULT, THREAT):
        return 0, None
    kind = "denied" if "denied" in flags else "quoted" if "quoted" in flags else "aimed" if "aimed" in flags else ""
    return 0, EVENTS.index(("insult" if base == INSULT else "threat") + ("_" + kind if kind else ""))


def grammar() -> list[list[tuple[int, int]]]:
    """The composed transducers as one table: table[state][symbol] is (next state, event or -1)."""
    whole = _scope(NEGATION, 3, "denied").then(_scope(REPORT, 12, "quoted")).then(_scope(TARGET, 6, "aimed")).then(Transducer(_event))
    number, queue, table = {0: 0}, [0], []
    for state in queue:
        row = []
        for symbol in range(6):
            to, event = whole.step(state, symbol)
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
            row.append((number[to], -1 if event is None else event))
        table.append(row)
    return table


@dataclass
class Model:
    #: beginning of a word, or a whole word and "$" -> log-odds
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(EVENTS) + 1))
    bias: float = 0.0


class Scorer:
    def __init__(self, stems: dict[str, float]):
        self.stems, self.table = stems, grammar()
        self.memory: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """The word's symbol and weight: the path of its letters through the stems with the greatest weight."""
        if word in FIXED:
            return FIXED[word], 1.0
        best = self.stems.get(word + "$", 0.0)
        for n in range(SHORTEST, min(len(word), LONGEST) + 1):
            best = max(best, self.stems.get(word[:n], 0.0))
        return (INSULT, best) if best > 0 else (OTHER, 0.0)

    def features(self, text: str) -> np.ndarray:
        """Sums of the weights of a text's matched clauses by event, damped, and the share of its clauses that match."""
        out = np.zeros(len(EVENTS) + 1)
        words = _WORD.findall(text.lower())
        memory = self.memory
        if len(memory) > 400_000:
            memory.clear()
        for w in set(words).difference(memory):
            memory[w] = self.symbol(w)
        harm = {w for w in set(words) if memory[w][0] in (INSULT, THREAT)}
        if not harm:
            return out
        clause: list[str] = []
        matched = clauses = 0
        for w in [*words, "."]:
            if w not in _STOP:
                clause.append(w)
                continue
            if clause:
                clauses += 1
                if not harm.isdisjoint(clause):
                    matched += 1
                    state = 0
                    for x in clause:
                        symbol, weight = memory[x]
                        state, event = self.table[state][symbol]
                        if event >= 0:
                            out[event] += weight
                clause = []
        out[:-1] = np.log1p(out[:-1])
        out[-1] = matched / clauses
        return out


def stems_of(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())).difference(_STOP):
        if w not in FIXED and len(w) >= SHORTEST:
            out.add(w + "$")
            out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def group_of(text: str) -> int:
    """A value that near copies mostly share: the least hash of the text's runs of three words."""
    _, h = _hashes(text)
    win = T.windows(h, min(3, len(h))) if len(h) else np.zeros(1, np.uint64)
    return int(win.min()) & 0x7FFFFFFFFFFFFFFF


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    buf, _ = T.join([text.lower().encode()])
    begins, ends = T.spans(buf)
    return begins, T.hashes(buf, begins, ends)


def lexicon(counts: list[tuple[str, float, float]], toxic: float, clean: float, doubt: float = 2.0, least: float = 1.0) -> dict[str, float]:
    """The stems whose log-odds stay high when `doubt` standard errors are taken off; that is their weight."""
    out = {}
    for stem, t, c in counts:
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) - doubt * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if odds > least:
            out[stem] = float(odds)
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps with a penalty on all weights but the bias."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - ridge * w
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        move = np.linalg.solve(h, g)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def training_rows(doc_id):
    """The rows that may teach: crc32 of the doc_id as text, modulo 3, isn't 1."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    y = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & training_rows(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = y.where("toxic = 1").orderBy(*order).limit(SAMPLE).union(y.where("toxic = 0").orderBy(*order).limit(SAMPLE))
    sample = scratch.save(sample, "sample")  # at most 2 * SAMPLE rows of 12 bytes
    rows = docs.join(F.broadcast(sample), "doc_id").where("text IS NOT NULL").select("doc_id", "text", "toxic")
    grouped = rows.mapInArrow(_grouped, "doc_id long, text string, toxic int, grp long")
    grouped = scratch.save(grouped.repartition(max(4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)), "grouped")
    share = grouped.groupBy("grp").agg(F.count("*").alias("copies"))
    # the fold is the group's, so copies don't teach on both sides
    weighed = scratch.save(grouped.join(share, "grp").select("doc_id", "text", "toxic", (1 / F.col("copies")).alias("w"), F.pmod(F.xxhash64("grp"), F.lit(FOLDS)).cast("int").alias("fold")), "weighed")
    sums = weighed.groupBy("fold", "toxic").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    if {s["toxic"] for s in sums} != {0, 1}:
        n = sum(s["n"] for s in sums)
        ones = sum(s["n"] for s in sums if s["toxic"] == 1)
        p = (ones + 1) / (n + 2) if n else 0.5
        return Model(bias=float(np.log(p / (1 - p))))
    counted = weighed.mapInArrow(_counted, "fold int, stem string, t double, c double")
    per = [F.sum(F.when(F.col("fold") == f, F.col(x)).otherwise(0.0)).alias(f"{x}{f}") for f in range(FOLDS) for x in "tc"]
    counted = counted.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), *per)
    doubt = 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    strong = counted.where("t >= 1.9").orderBy(F.desc(F.log((F.col("t") + 0.5) / (F.col("c") + 0.5)) - doubt), "stem").limit(LEXICON).collect()
    total = {(s["fold"], s["toxic"]): s["w"] for s in sums}

    def learned(without: int | None) -> dict[str, float]:
        """The lexicon of all folds, or of all but one."""
        rest = lambda r, x: r[x] - (0.0 if without is None else r[f"{x}{without}"])
        of = lambda klass: sum(v for (f, k), v in total.items() if k == klass and f != without)
        return lexicon([(r["stem"], rest(r, "t"), rest(r, "c")) for r in strong], of(1), of(0))

    stems, pairs = learned(None), [learned(f) for f in range(FOLDS)]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(p) for p in pairs]
        for batch in batches:
            d = batch.to_pydict()
            x = [scorers[h].features(t).tolist() for h, t in zip(d["fold"], d["text"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d["toxic"], pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    found = weighed.select("fold", "text", "toxic").mapInArrow(featured, "toxic int, x array<double>").orderBy("toxic", "x").collect()
    x, y = np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float)
    w, bias = logistic(x, y)
    return Model(stems, np.maximum(w, 0.0), bias)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([group_of(t) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "text", "toxic", "grp"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = batch.to_pydict()
        sums = {(f, k): Counter() for f in range(FOLDS) for k in (0, 1)}
        for text, toxic, w, fold in zip(d["text"], d["toxic"], d["w"], d["fold"], strict=True):
            c = sums[fold, toxic]
            for s in stems_of(text):
                c[s] += w
        for fold in range(FOLDS):
            t, c = sums[fold, 1], sums[fold, 0]
            # a stem that no toxic document of the batch has still counts as clean
            names = sorted(set(t) | set(c))
            yield pa.RecordBatch.from_arrays([pa.array([fold] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array([t[s] for s in names], pa.float64()), pa.array([c[s] for s in names], pa.float64())], ["fold", "stem", "t", "c"])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and clauses: the damped weights of the matched clauses by event."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "toxicity")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    model = train(docs, labels, scratch)
    scratch.drop()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.stems)
        for batch in batches:
            x = np.array([scorer.features(t) if t else np.zeros(len(EVENTS) + 1) for t in batch.column(1).to_pylist()]).reshape(-1, len(EVENTS) + 1)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.7).astype(np.int32)), pa.array(x[:, :-1].tolist(), pa.list_(pa.float64()))], ["doc_id", "score", "predicted", "clauses"])

    out = docs.mapInArrow(scored, "doc_id long, score double, predicted int, clauses array<double>")
    return out.select("doc_id", F.coalesce(~training_rows(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "clauses")
