"""Operator 7, toxicity by a weighted finite-state pattern grammar.

Five small transducers read a clause word by word. Each is a table (state, symbol) -> (state, mark):

* insult: an insult word is marked; * threat: a threat verb is marked;
* target: a person addressed or pointed at makes the clause aimed;
* negation: a negator reaches the next few words; * reported speech: a verb of saying reaches the rest of the clause.

``compose`` multiplies them into one machine over tuples of their states; an arc's marks are those of its parts. A
marked word puts out its weight to the **pattern** of its arc: insult or threat, negated or not, reported or not, and
at the clause's end aimed or not. So a text's features are weights per pattern of matched clauses, not counts of words.
The weight of each pattern is learned from the labelled rows around a prior: threats count in aimed clauses only,
aimed insults more than insults at nobody, negated and reported ones less.

A clause ends at punctuation or a line end. Insult words and stems are a short fixed list plus word beginnings that are
learned: of the labelled training rows (crc32 of the doc_id as text, modulo 5, not 0; at most ``TRAIN_ROWS`` of them,
picked by a hash) Spark counts in how many toxic and clean documents each word occurs, sums that over word beginnings,
and keeps at most ``LEXICON`` with strong log odds. Labels, lang, source and doc_id are never inputs of a score.

Null and empty texts have no clause and get the model's base score. Repeated rows are scored each; very long texts
are read once, clause by clause; empty tables give empty results; columns beyond doc_id and text, whatever their
names, are not read. Without labelled rows of both classes the fixed list and the prior are used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

TRAIN_ROWS = 20_000
#: words whose class a task remembers
REMEMBERED = 150_000
LEXICON = 5_000
#: log likelihood ratio a learned form needs: with a million forms, less than one in a hundred by chance
MIN_EVIDENCE = 18.0
#: and the share of its documents that must be toxic
PURITY = 0.8
BEGINNINGS = (4, 5, 6, 7, 8)

#: fixed lists by transducer
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "clown", "trash", "worthless", "pathetic", "disgusting", "vermin",
           "imbecile", "dumbass", "idiota", "imbécil", "imbécile", "abschaum", "trottel")
THREATS = ("kill", "hurt", "destroy", "attack", "beat", "töten", "tuer", "matar")
TARGETS = ("you", "your", "he", "she", "they", "them", "these", "those", "this", "that", "du", "dich", "ihr", "sie",
           "tu", "toi", "vous", "ils", "usted", "ellos", "ese", "esa")
NEGATORS = ("not", "no", "never", "nobody", "isn", "aren", "don", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca")
REPORTERS = ("said", "says", "called", "wrote", "claimed", "quoted", "sagte", "nannte", "dit", "appelé", "dijo", "llamó")
FIXED_WEIGHT = 3.0
#: words a negator reaches
REACH = 3

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]")
WORD = re.compile(r"[^\W\d_]+")
OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTER = range(6)
SYMBOLS = range(6)

#: a transducer: (state, symbol) -> (next state, mark or None); pairs not listed keep the state and mark nothing
Table = dict[tuple[int, int], tuple[int, str | None]]
TRANSDUCERS: dict[str, Table] = {
    "insult": {(0, INSULT): (0, "insult")},
    "threat": {(0, THREAT): (0, "threat")},
    "target": {(0, TARGET): (1, None)},
    "negation": {**{(s, x): (max(0, s - 1), "negated" if s and x in (INSULT, THREAT) else None) for s in range(REACH + 1) for x in SYMBOLS},
                 **{(s, NEGATOR): (REACH, None) for s in range(REACH + 1)}},
    "reported": {(0, REPORTER): (1, None), **{(1, x): (1, "reported") for x in (INSULT, THREAT)}},
}
#: what a marked word is, by the marks of its arc and whether its clause is aimed
PATTERNS = tuple((kind, negated, reported, aimed) for kind in ("insult", "threat") for negated in (False, True)
                 for reported in (False, True) for aimed in (False, True))
#: states of the target transducer in which a clause is aimed
AIMED = 1


def step(table: Table, state: int, symbol: int) -> tuple[int, str | None]:
    return table.get((state, symbol), (state, None))


def compose(tables: dict[str, Table]) -> list[list[tuple[int, int]]]:
    """The product machine: per state and symbol the next state and the pattern put out (-1: none; of an aimed clause the
    next pattern). State 0 starts a clause; odd and even states don't matter, ``aimed_states`` tells them."""
    names = list(tables)
    states: dict[tuple[int, ...], int] = {(0,) * len(names): 0}
    todo, arcs = [(0,) * len(names)], []
    for state in todo:
        line = []
        for symbol in SYMBOLS:
            moves = [step(tables[n], s, symbol) for n, s in zip(names, state, strict=True)]
            to, marks = tuple(m[0] for m in moves), {m[1] for m in moves}
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            kind = next((k for k in ("insult", "threat") if k in marks), None)
            line.append((states[to], PATTERNS.index((kind, "negated" in marks, "reported" in marks, False)) if kind else -1))
        arcs.append(line)
    return arcs


def aimed_states(tables: dict[str, Table]) -> list[bool]:
    """Which states of ``compose(tables)`` are aimed, in the same order."""
    names = list(tables)
    states, todo = {(0,) * len(names)}, [(0,) * len(names)]
    for state in todo:
        for symbol in SYMBOLS:
            to = tuple(step(tables[n], s, symbol)[0] for n, s in zip(names, state, strict=True))
            if to not in states:
                states.add(to)
                todo.append(to)
    return [s[names.index("target")] == AIMED if "target" in names else False for s in todo]


def prior_weights() -> tuple[float, ...]:
    """Weight of each pattern before learning."""
    out = []
    for kind, negated, reported, aimed in PATTERNS:
        weight = {("insult", True): 1.5, ("insult", False): 1.2, ("threat", True): 1.5, ("threat", False): 0.0}[kind, aimed]
        out.append(weight * (0.2 if negated else 1.0) * (0.4 if reported else 1.0))
    return tuple(out)


ARCS, AIMS = compose(TRANSDUCERS), aimed_states(TRANSDUCERS)
BASE = -3.0


@dataclass
class Grammar:
    """Word classes with weights, the composed machine, and the weights of its patterns."""

    whole: dict[str, float]
    stems: dict[str, float]
    model: tuple[float, ...] = (BASE, *prior_weights())
    arcs: list = field(default_factory=lambda: ARCS)
    aims: list = field(default_factory=lambda: AIMS)
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def symbol(self, word: str) -> tuple[int, float]:
        """Class and weight of a lower-cased word; class 0 puts nothing out."""
        got = self.known.get(word)
        if got is None:
            weight = max([self.whole.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in BEGINNINGS if len(word) >= n)])
            kinds = ((THREATS, THREAT), (TARGETS, TARGET), (NEGATORS, NEGATOR), (REPORTERS, REPORTER))
            got = (INSULT, weight) if weight else next(((k, FIXED_WEIGHT) for ws, k in kinds if word in ws), (OTHER, 0.0))
            if len(self.known) < REMEMBERED:
                self.known[word] = got
        return got

    def clauses(self, text: str) -> list[dict[int, float]]:
        """What the machine puts out for each matched clause of a text: pattern -> weight."""
        text, symbol, arcs, aims = text.lower(), self.symbol, self.arcs, self.aims
        if not any(symbol(w)[0] in (INSULT, THREAT) for w in set(WORD.findall(text))):
            return []
        out: list[dict[int, float]] = []
        state, now = 0, {}
        for token in [*TOKEN.findall(text), "."]:
            if len(token) == 1 and not token.isalpha():
                if now:
                    out.append({k + aims[state]: w for k, w in now.items()})
                    now = {}
                state = 0
                continue
            kind, weight = symbol(token)
            state, pattern = arcs[state][kind]
            if pattern >= 0:
                now[pattern] = now.get(pattern, 0.0) + weight
        return out

    def features(self, text: str) -> list[float]:
        """Per pattern the log of its weight over all clauses (0 without any)."""
        sums = [0.0] * len(PATTERNS)
        for clause in self.clauses(text):
            for pattern, weight in clause.items():
                sums[pattern] += weight
        return [float(np.log1p(s)) if s else 0.0 for s in sums]

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.model[0] + sum(w * x for w, x in zip(self.model[1:], self.features(text), strict=True))))))


def held_out(doc_id: Column) -> Column:
    """Whether 5 divides the CRC of the doc_id as text (null: the empty text, so held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled rows outside the held-out fold; of the texts that share a labelled doc_id
    the one with the smallest hash, so however many there are, no more than ``rows`` come back."""
    picked = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked.distinct()), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")


def learn_lexicon(train: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of whole words and of word beginnings by smoothed log odds."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    per_word = train.select("toxic", F.explode(words).alias("w")).groupBy("w").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    starts = F.array(*[F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in BEGINNINGS])
    forms = F.array_union(F.transform(F.array_distinct(F.array_compact(starts)), lambda s: F.struct(s.alias("form"), F.lit(True).alias("stem"))),
                          F.array(F.struct(F.col("w").alias("form"), F.lit(False).alias("stem"))))
    share = n_toxic / (n_toxic + n_clean)
    both = F.col("t") + F.col("c")
    evidence = F.col("t") * F.log(F.col("t") / both / share) + F.when(F.col("c") > 0, F.col("c") * F.log(
        F.col("c") / both / (1 - share))).otherwise(0.0)
    odds = F.log((F.col("t") + 0.5) / (F.col("c") + 1.5)) + float(np.log((n_clean + 1) / (n_toxic + 1)))
    rows = (per_word.select(F.explode(forms).alias("f"), "t", "c").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
            .where(F.col("t") >= PURITY * both).where(evidence > MIN_EVIDENCE).withColumn("weight", odds)
            .orderBy(F.desc("weight"), "f").limit(LEXICON).collect())
    whole = {r["f"]["form"]: float(r["weight"]) for r in rows if not r["f"]["stem"]}
    stems = {r["f"]["form"]: float(r["weight"]) for r in rows if r["f"]["stem"]}
    return whole, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 100) -> tuple[float, ...]:
    """Logistic regression pulled towards ``prior`` (weights of the features), by Newton steps with halving; weights aren't
    negative, so a clause never excuses a text."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.array([1e-6] + [ridge] * (x.shape[1] - 1))
    towards = np.concatenate([[0.0], prior])
    w = towards.copy()

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * (v - towards) ** 2))

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty) + 1e-9 * np.eye(len(w)),
                               x.T @ (p - y) + penalty * (w - towards))
        size = 1.0
        while size > 1e-6:
            trial = w - size * step
            trial[1:] = np.maximum(trial[1:], 0.0)
            if (then := loss(trial)) < now - 1e-12:
                break
            size /= 2
        else:
            break
        w, now = trial, then
    return tuple(float(v) for v in w)


def feature_rows(texts: DataFrame, grammar: Grammar, extra: str) -> DataFrame:
    """(``extra``, features array) per row of ``texts`` (text, ``extra``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grammar.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(extra), pa.array(found, pa.list_(pa.float64()))], names=[extra, "features"])

    kind = dict(texts.dtypes)[extra]
    return texts.select("text", extra).mapInArrow(run, f"{extra} {kind}, features array<double>")


def train_grammar(docs: DataFrame, labels: DataFrame) -> Grammar:
    train = stored(training_rows(docs, labels), "toxicity-train")  # the corpus is read once for them
    counts = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    grammar = Grammar({w: FIXED_WEIGHT for w in INSULTS}, {})
    if not (counts.get(0) and counts.get(1)):
        return grammar
    whole, stems = learn_lexicon(train, counts[1], counts[0])
    grammar = Grammar({w: max(whole.get(w, 0.0), FIXED_WEIGHT) for w in INSULTS} | whole, stems)
    got = feature_rows(train, grammar, "toxic").toPandas()  # at most TRAIN_ROWS rows of 16 numbers
    grammar.model = fit_logistic(np.array(got["features"].tolist()), got["toxic"].to_numpy(float), np.array(prior_weights()))
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score): one row per document."""
    rows = feature_rows(docs.select("doc_id", text_or_empty().alias("text")), grammar, "doc_id")
    base, *weights = grammar.model
    parts = F.zip_with("features", F.array(*map(F.lit, weights)), lambda x, w: x * w)
    return rows.select("doc_id", (1 / (1 + F.exp(-F.aggregate(parts, F.lit(base), lambda a, x: a + x)))).alias("score"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, train_grammar(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is under 0.5."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([grammar.score(t or "") < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
