"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read a clause, one behind the other. Insult reads words letter by letter along a tree of learned entries
(words, and stems that many words share), whose arcs carry the entries' weights; threat marks verbs of violence, and those
that follow a word of intent; target marks what a person addressed or spoken of stands near, before or behind; negation and
reported speech mark what they reach. Each hands its symbols with their marks to the next, and the last one's arcs weigh
what is left: an entry's weight times the factors of its marks. A target that comes later is guessed, and a guess that
does not come true is a path that ends; of the paths through a clause exactly one is left. Composed, the transducers are
one machine whose product states and arcs are made when first met; a clause's score is the weight of its path. A document's
score is a logistic function of its clauses' sum over the root of its length. Entries, factors and the two coefficients
are learned from the training rows; without evidence a factor keeps its default.

Isolated words do not count as such: an entry counts as much as its clause lets it.

Defined results: a null text scores like an empty one, with no clause at all; texts count whole, and words of any length;
equal texts get equal scores; without labelled rows the lexicon has the fixed threats only and coefficients keep their
defaults; an empty table gives an empty table; only the id and text columns are read, so that extra columns don't matter,
and labels only of rows that are not held out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, training_rows
from .shared import fresh, in_batches

FOLDS, HELD_OUT = 5, 0
SAMPLE_PER_CLASS = 2500
STEM_LENGTHS = range(3, 9)
LEAST_DOCUMENTS = 3
LEAST_EVIDENCE = 20.0
LEAST_ODDS = 2.0
MOST_WEIGHT = 6.0
TERMS_AT_ONCE = 200_000
SPAN = 4
PRIOR_WORDS = 20
DENSITY_SCALE = 10.0

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
CLAUSE_END = re.compile(r"[.!?;:\n]")

#: Closed-class words of the grammar in English, German, French and Spanish.
THREATS = "kill hurt destroy murder stab shoot strangle beat töten umbringen verprügeln tuer frapper égorger matar golpear degollar".split()
INTENTS = "will shall gonna going must werde werden wird vais va vont voy vamos van".split()
TARGETS = "you your yours yourself he she they them him her du dich dir dein deine ihr euch sie er tu te toi vous votre il elle ils elles usted tú tus ustedes ellos ellas él ella".split()
NEGATIONS = "not never no none nobody neither nor cannot isn wasn aren don doesn didn won nicht nie niemals kein keine keinen keiner ne pas jamais aucun aucune non nunca jamás ningún ninguna tampoco".split()
REPORTS = "said says say claimed claims reported reports quoted quotes alleged told sagte sagt behauptete berichtete zitierte dit disait déclare affirma rapporte dijo dice afirmó declaró informó citó".split()
QUOTES = frozenset("\"“”„«»")

#: What an entry's weight is multiplied by for its marks; ``threat`` is the weight of a verb of violence with a target
#: (without one it is nothing). Training moves them as far as the labels say.
FACTORS = {"targeted": 1.5, "negated": 0.2, "reported": 0.4, "meant": 1.5, "threat": 3.0}
HELD = 4.0  # how strongly training holds them: the precision of their logarithms

Symbol = tuple[str, frozenset]
ABUSE = ("insult", "threat")


@dataclass(frozen=True)
class Transducer:
    """``step`` takes a state and a symbol (kind, marks), and gives the arcs: (next state, symbol) for each way on.
    ``accepts`` says whether a clause may end in a state."""

    start: object
    step: Callable[[object, Symbol], list[tuple[object, Symbol]]]
    accepts: Callable[[object], bool] = lambda state: True


def _threat(left: int, symbol: Symbol) -> list[tuple[int, Symbol]]:
    """A verb of violence behind a word of intent is meant."""
    kind, marks = symbol
    if kind == "intent":
        return [(SPAN, symbol)]
    return [(max(0, left - 1), (kind, marks | {"meant"}) if left and kind == "threat" else symbol)]


def _target(state: tuple[int, int, int], symbol: Symbol) -> list[tuple[tuple[int, int, int], Symbol]]:
    """Abuse with a target among the words before it is targeted. Without one, two paths go on: the next words have a
    target (it must come while ``awaited`` lasts), or they have none (none may come while ``barred`` does)."""
    left, awaited, barred = state
    kind, marks = symbol
    if kind == "target":
        return [] if barred else [((SPAN, 0, 0), symbol)]
    if awaited == 1:
        return []
    after = (max(0, left - 1), max(0, awaited - 1), max(0, barred - 1))
    if kind not in ABUSE:
        return [(after, symbol)]
    aimed = (kind, marks | {"targeted"})
    if left:
        return [(after, aimed)]
    return [((0, after[1] or SPAN, after[2]), aimed), ((0, after[1], SPAN), symbol)]


def _negate(left: int, symbol: Symbol) -> list[tuple[int, Symbol]]:
    """After a negation the next words are negated."""
    kind, marks = symbol
    if kind == "negation":
        return [(SPAN, symbol)]
    return [(max(0, left - 1), (kind, marks | {"negated"}) if left and kind in ABUSE else symbol)]


def _report(state: tuple[bool, bool], symbol: Symbol) -> list[tuple[tuple[bool, bool], Symbol]]:
    """After a verb of reporting, or between quotation marks, what a clause has is reported."""
    told, quoted = state
    kind, marks = symbol
    told, quoted = told or kind == "report", quoted != (kind == "quote")
    return [((told, quoted), (kind, marks | {"reported"}) if (told or quoted) and kind in ABUSE else symbol)]


THREAT = Transducer(0, _threat)
TARGET = Transducer((0, 0, 0), _target, lambda state: not state[1])
NEGATE, REPORT = Transducer(0, _negate), Transducer((False, False), _report)


class Insult:
    """The tree of entries as a weighted acceptor of letters. An arc carries what its letter adds to the heaviest stem so
    far; a word's end adds what the whole word has beyond that. The path's sum is the heaviest entry's weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.arcs: list[dict[str, tuple[int, float]]] = [{}]
        stem, whole = [0.0], [0.0]
        for entry, weight in lexicon.items():
            at = 0
            for c in entry.rstrip("*"):
                if c not in self.arcs[at]:
                    self.arcs[at][c] = (len(self.arcs), 0.0)
                    self.arcs.append({})
                    stem.append(0.0)
                    whole.append(0.0)
                at = self.arcs[at][c][0]
            held = stem if entry[-1] == "*" else whole
            held[at] = max(held[at], weight)
        self.ends = [0.0] * len(self.arcs)
        todo = [(0, 0.0)]
        while todo:
            at, best = todo.pop()
            self.ends[at] = max(0.0, whole[at] - best)
            for c, (to, _) in self.arcs[at].items():
                gain = max(0.0, stem[to] - best)
                self.arcs[at][c] = (to, gain)
                todo.append((to, best + gain))

    def weight(self, word: str) -> float:
        at, total = 0, 0.0
        for c in word:
            arc = self.arcs[at].get(c)
            if arc is None:
                return total
            at, total = arc[0], total + arc[1]
        return total + self.ends[at]


@dataclass
class Composed:
    """The cascade as one machine over kinds of words. Its states are tuples of the parts' states; states and arcs are kept
    as they are met. An arc has the symbol that comes out of the last part."""

    parts: tuple[Transducer, ...]
    arcs: dict = field(default_factory=dict)

    @property
    def start(self) -> tuple:
        return tuple(p.start for p in self.parts)

    def step(self, state: tuple, kind: str) -> list[tuple[tuple, Symbol]]:
        found = self.arcs.get((state, kind))
        if found is None:
            found = [((), (kind, frozenset()))]
            for p, s in zip(self.parts, state, strict=True):
                found = [((*done, to), out) for done, symbol in found for to, out in p.step(s, symbol)]
            self.arcs[state, kind] = found
        return found

    def accepts(self, state: tuple) -> bool:
        return all(p.accepts(s) for p, s in zip(self.parts, state, strict=True))

    def run(self, kinds: list[str], weigh: Callable[[int, Symbol], float]) -> float:
        """The weight of the best accepting path; ``weigh`` gives that of the last part's arc at a place."""
        live = {self.start: 0.0}
        for i, kind in enumerate(kinds):
            ahead: dict[tuple, float] = {}
            for state, total in live.items():
                for to, symbol in self.step(state, kind):
                    w = total + (weigh(i, symbol) if symbol[0] in ABUSE else 0.0)
                    if w > ahead.get(to, -math.inf):
                        ahead[to] = w
            live = ahead
        return max((w for state, w in live.items() if self.accepts(state)), default=0.0)


CASCADE = (THREAT, TARGET, NEGATE, REPORT)


class Grammar:
    """``lexicon`` maps entries to weights; an entry that ends with * is a stem."""

    def __init__(self, lexicon: dict[str, float], factors: dict[str, float] | None = None):
        import ahocorasick

        self.insult, self.factors = Insult(lexicon), factors or FACTORS
        lists = (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("intent", INTENTS), ("threat", THREATS))
        self.kinds = {w: k for k, ws in lists for w in ws} | {q: "quote" for q in QUOTES}
        self.machine = Composed(CASCADE)
        self.seek = ahocorasick.Automaton()
        for w in [*lexicon, *THREATS]:
            word = w.rstrip("*")
            _, stem = self.seek.get(word, (0, False))
            self.seek.add_word(word, (len(word), stem or w[-1] == "*"))
        self.seek.make_automaton()

    def weight(self, word: str) -> float:
        """Of an insult: the entry that is the word, or the heaviest of its stems."""
        return self.insult.weight(word)

    def hits(self, text: str) -> list[int]:
        """Where entries stand at a word's start."""
        out = []
        for end, (n, stem) in self.seek.iter(text):
            start = end - n + 1
            if (not start or not text[start - 1].isalpha()) and (stem or end + 1 == len(text) or not text[end + 1].isalpha()):
                out.append(start)
        return out

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses that have an entry, in order."""
        done = 0
        for start in sorted(self.hits(text)):
            if start < done:
                continue
            end = CLAUSE_END.search(text, start)
            stop = end.start() if end else len(text)
            begin = max(map(lambda mark: text.rfind(mark, done, start), ".!?;:\n")) + 1
            yield text[max(begin, done) : stop]
            done = stop

    def read(self, clause: str) -> tuple[list[str], list[float]]:
        """Each word's kind, and the insult's weight."""
        tokens = TOKEN.findall(clause)
        weights = [self.weight(t) for t in tokens]
        return ["insult" if w else self.kinds.get(t, "other") for t, w in zip(tokens, weights, strict=True)], weights

    def arc_weight(self, weight: float, symbol: Symbol) -> float:
        kind, marks = symbol
        if kind == "threat":
            weight = self.factors["threat"] if "targeted" in marks else 0.0
            marks = marks - {"targeted"}
        return weight * math.prod(self.factors[m] for m in marks)

    def clause_score(self, clause: str) -> float:
        kinds, weights = self.read(clause)
        return self.machine.run(kinds, lambda i, symbol: self.arc_weight(weights[i], symbol))

    def density(self, text: str | None) -> float:
        """The clauses' sum by the square root of the text's words: chance entries are more frequent in longer texts."""
        text = text or ""
        total = sum(map(self.clause_score, self.clauses(text.lower())))
        return total / math.sqrt(len(text.split()) + PRIOR_WORDS) if total else 0.0

    def profile(self, text: str | None) -> np.ndarray:
        """What ``density`` is the sum of, by combination of marks: its product with ``mark_factors`` is the density."""
        text, out = text or "", np.zeros(len(COMBINATIONS))
        for clause in self.clauses(text.lower()):
            kinds, weights = self.read(clause)
            for i, symbol in self.path(kinds):
                kind, marks = symbol
                if kind == "insult" or "targeted" in marks:
                    out[COMBINATIONS.index(symbol)] += weights[i] if kind == "insult" else 1.0
        return out / math.sqrt(len(text.split()) + PRIOR_WORDS)

    def path(self, kinds: list[str]) -> list[tuple[int, Symbol]]:
        """The abuse along the accepting path: place and symbol."""
        live: dict[tuple, list] = {self.machine.start: []}
        for i, kind in enumerate(kinds):
            live = {to: held + [(i, symbol)] if symbol[0] in ABUSE else held for state, held in live.items() for to, symbol in self.machine.step(state, kind)}
        return next((held for state, held in live.items() if self.machine.accepts(state)), [])


def _combinations() -> list[Symbol]:
    subsets = lambda names: [frozenset(n for k, n in enumerate(names) if bits >> k & 1) for bits in range(1 << len(names))]
    insults = [("insult", s) for s in subsets(["targeted", "negated", "reported"])]
    return insults + [("threat", s | {"targeted"}) for s in subsets(["negated", "reported", "meant"])]


COMBINATIONS = _combinations()


def mark_factors(factors: dict[str, float]) -> np.ndarray:
    whole = lambda kind, marks: (factors["threat"] if kind == "threat" else 1.0) * math.prod(factors[m] for m in marks if kind == "insult" or m != "targeted")
    return np.array([whole(kind, marks) for kind, marks in COMBINATIONS])


def learn_lexicon(rows: DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """Entries by document counts of the sample's words and stems. Of entries of which one begins the other, the one with
    more evidence stays (the longer at a tie). What is collected has the evidence, and so comes from ``LEAST_DOCUMENTS``
    or more documents of the sample: the sample bounds it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        done = lambda: pd.DataFrame([(t, p, n) for t, (n, p) in held.items()], columns=["term", "pos", "neg"])
        for b in batches:
            for t, y in zip(b["text"], b["y"], strict=True):
                words = set(WORD.findall((t or "").lower()))
                for term in words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if n < len(w)}:
                    held.setdefault(term, [0, 0])[y] += 1
                if len(held) > TERMS_AT_ONCE:
                    yield done()
                    held = {}
        yield done()

    counts = in_batches(rows.select("text", "y")).mapInPandas(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds, stat = evidence(F.col("pos").cast("double"), F.col("neg").cast("double"), n_pos, n_neg)
    found = counts.where(F.col("pos") >= LEAST_DOCUMENTS).select("term", odds.alias("odds"), stat.alias("stat"))
    best = found.where((F.col("odds") >= LEAST_ODDS) & (F.col("stat") >= LEAST_EVIDENCE)).collect()
    ranked = sorted(best, key=lambda r: (-r["stat"], -len(r["term"]) - (r["term"][-1] != "*"), r["term"]))
    taken: dict[str, float] = {}
    begun: set[str] = set()
    for r in ranked:
        term = r["term"]
        bare = term.rstrip("*")
        if any(bare[:n] + "*" in taken for n in range(1, len(bare) + 1)) or term[-1] == "*" and bare in begun:
            continue
        taken[term] = min(r["odds"], MOST_WEIGHT)
        begun.update(bare[:n] for n in range(1, len(bare) + 1))
    return taken


def evidence(pos, neg, n_pos: int, n_neg: int):
    """Log-odds and the likelihood ratio statistic of a term that ``pos`` and ``neg`` documents of the classes have, as
    columns."""
    odds = F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1))
    share = (pos + neg) / (n_pos + n_neg)

    def part(k, n):
        q = k / n
        return F.when(k > 0, k * F.log(q / share)).otherwise(0.0) + F.when(k < n, (n - k) * F.log((1 - q) / (1 - share))).otherwise(0.0)

    return odds, 2 * (part(pos, n_pos) + part(neg, n_neg))


@dataclass
class Model:
    lexicon: dict[str, float]
    slope: float = 3.0
    offset: float = -5.0
    factors: dict[str, float] = field(default_factory=lambda: dict(FACTORS))

    def scores(self, density: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * np.log1p(DENSITY_SCALE * density) + self.offset)))

    def grammar(self) -> Grammar:
        return grammar_of(tuple(sorted(self.lexicon.items())), tuple(sorted(self.factors.items())))


@lru_cache(maxsize=2)
def grammar_of(lexicon: tuple, factors: tuple) -> Grammar:
    """The process's own, kept between tasks."""
    return Grammar(dict(lexicon), dict(factors))


def fit(profiles: np.ndarray, y: np.ndarray, model: Model) -> Model:
    """Slope, offset and the marks' factors (their logarithms) by damped Newton steps on the logistic loss, with
    a pull to the defaults; the slope stays positive, and a text without entries scores below one half."""
    names = list(model.factors)
    prior = np.array([model.slope, model.offset, *(math.log(model.factors[n]) for n in names)])
    pull = np.array([0.5, 0.5, *([HELD] * len(names))])

    def loss(p: np.ndarray) -> float:
        density = profiles @ mark_factors({n: math.exp(v) for n, v in zip(names, p[2:], strict=True)})
        z = p[0] * np.log1p(DENSITY_SCALE * density) + p[1]
        return float(np.logaddexp(0, z).sum() - (z * y).sum() + 0.5 * (pull * (p - prior) ** 2).sum())

    p, eye, h, damp = prior.copy(), np.eye(len(prior)), 1e-4, 1e-3
    for _ in range(200):
        at = loss(p)
        ahead, back = [loss(p + h * e) for e in eye], [loss(p - h * e) for e in eye]
        grad = (np.array(ahead) - np.array(back)) / (2 * h)
        hess = np.array([[(loss(p + h * (e + f)) - ahead[i] - ahead[j] + at) / h**2 for j, f in enumerate(eye)] for i, e in enumerate(eye)])
        value, vector = np.linalg.eigh((hess + hess.T) / 2)
        move = np.zeros(len(p))
        while damp < 1e12:
            move = -(vector / (np.abs(value) + damp)) @ (vector.T @ grad)
            if loss(p + move) < at:
                damp = max(damp / 4, 1e-6)
                break
            damp *= 4
        if np.abs(move).max() <= 1e-6 or damp >= 1e12:
            break
        p = p + move
    return Model(model.lexicon, max(0.1, float(p[0])), float(min(p[1], -0.1)), {n: math.exp(v) for n, v in zip(names, p[2:], strict=True)})


def one_of_copies(rows: DataFrame) -> DataFrame:
    """Of the sample's near copies that are marked alike, the one with the smallest id: else words that only a group of
    copies has would pass for evidence. Near copies mostly share the smallest hash of their runs of five words; a toxic
    text and its clean copy both stay."""
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0))), lambda i: F.xxhash64(F.slice("w", i + 1, 5)))
    marked = rows.withColumn("w", w).withColumn("mark", F.array_min(runs)).drop("w")
    kept = marked.groupBy("mark", "y").agg(F.min(F.struct("id", "text")).alias("r"))
    return kept.select("r.id", "r.text", "y")


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Lexicon, factors and coefficients from about ``per_class`` labelled documents of each class at most. The driver gets
    the entries, and a row of ``COMBINATIONS`` numbers for each document of the sample."""
    rows = one_of_copies(training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, per_class)).persist()
    try:
        n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not n.get(0) or not n.get(1):
            return Model({})
        model = Model(learn_lexicon(rows, n[1], n[0]))
        held = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grammar = held.value.grammar()
            for b in batches:
                yield pd.DataFrame({"y": b["y"], "profile": [grammar.profile(t) for t in b["text"]]})

        found = in_batches(rows.select("y", "text")).mapInPandas(run, "y int, profile array<double>").toPandas()
        order = np.argsort([p.tobytes() for p in map(np.asarray, found["profile"])], kind="stable")  # sums don't depend on where rows lay
        return fit(np.stack(found["profile"].to_numpy()[order]), found["y"].to_numpy()[order], model)
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. The model that goes along with the tasks has the sample's
    entries."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = held.value.grammar()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": held.value.scores(np.array([grammar.density(t) for t in b["text"]], dtype=float))})

    found = in_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInPandas(run, "doc_id long, score double")
    return found.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def toxicity_filter(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents that score below one half, with their columns unchanged."""
    model = model or train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh(docs, "__toxic")

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = held.value.grammar()
        for b in batches:
            yield pd.Series(held.value.scores(np.array([grammar.density(t) for t in b], dtype=float)))

    return in_batches(docs).withColumn(name, toxic(docs["text"])).where(F.col(name) < 0.5).drop(name)
