"""Toxicity: a weighted finite-state grammar over clauses, its weights fitted to labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.labelled import fold, logistic, sample_labels, sigmoid
from pelagia.llm.sentencepiece_codec import text_batches
from pelagia.llm.shared import giving_back, materialize

# Seed words of each class. Insults are extended from the labels.
INSULTS = """asshole bastard bitch clown coward creep cretin dimwit disgusting dumb dumbass fool freak garbage hideous idiot
    idiotic imbecile jerk lame liar loser lowlife maggot moron moronic parasite pathetic pig rat retard scum scumbag slut
    stupid swine trash ugly useless vermin worthless arschloch dummkopf idioten schwein abschaum connard salaud crétin
    imbécile idiota imbécil estúpido basura""".split()
THREATS = """kill murder hurt stab strangle shoot beat destroy bury crush hunt burn töten umbringen tuer frapper matar
    golpear""".split()
TARGETS = "you your yours you're youre u he she they him her them du dich ihr sie tu toi vous usted tú ustedes".split()
NEGATIONS = "not no never isn't aren't don't won't didn't nobody neither nor without nicht kein nie jamais ni nunca tampoco".split()
REPORTS = """said says say told tells called calls claimed claims wrote writes quoted quotes reported reports according sagte
    schrieb dit déclaré dijo escribió""".split()

KINDS = {"insult": INSULTS, "threat": THREATS, "target": TARGETS, "negation": NEGATIONS, "report": REPORTS}
OUTPUTS = ["insult", "insult_at", "insult_negated", "insult_reported", "threat_at", "threat_negated", "threat_reported"]
# How a clause's strength is booked, by the output that carries it.
STRENGTHS = {"insult": "plain", "insult_at": "aimed", "threat_at": "aimed"} | {f"{k}_{how}": "softened" for k in ("insult", "threat") for how in ("negated", "reported")}
FEATURES = [*OUTPUTS, "clauses", "aimed", "plain", "softened"]
# Weights of arcs, which multiply along a path.
SEED_WEIGHT, AIMED, SOFTENED = 2.0, 1.5, 0.25
SAMPLE = 8000  # labelled rows of either label that the words and the weights are learned from
STEM_LENGTHS = (4, 5, 6)
LEAST_SUPPORT = 6  # different words before a learned stem in toxic texts; folds with fewer teach the seeds' weights alone
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[^.,;:!?\n]+")


class Transducer:
    """A deterministic weighted transducer: (state, symbol) → (state, symbol or None, weight).

    A symbol without an arc passes unchanged with weight 1; the arc of ``*`` stands for symbols without one of their own.
    """

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol)) or self.arcs.get((state, "*")) or (state, None, 1.0)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for s in symbols:
            state, o, weight = self.step(state, s)
            out.append((s if o is None else o, weight))
        return out


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """``second`` after ``first`` as one machine over ``alphabet``: the reachable pairs of states, weights multiplied."""
    start = (first.start, second.start)
    arcs, open_, seen = {}, [start], {start}
    while open_:
        a, b = state = open_.pop()
        for symbol in alphabet:
            next_a, middle, weight_a = first.step(a, symbol)
            middle = symbol if middle is None else middle
            next_b, out, weight_b = second.step(b, middle)
            to = (next_a, next_b)
            arcs[state, symbol] = (to, middle if out is None else out, weight_a * weight_b)
            if to not in seen:
                seen.add(to)
                open_.append(to)
    return Transducer(start, arcs)


def spelling_machine(words: dict[str, tuple[str, float]], stems: dict[str, tuple[str, float]]) -> Transducer:
    """Reads words letter by letter, each closed by a blank, which comes out as the word's class with its weight.

    The states are beginnings of words and stems; a stem holds whatever letters follow.
    """
    arcs = {}
    entries = {w: (True, *v) for w, v in words.items()} | {w: (False, *v) for w, v in stems.items()}
    for entry, (whole, kind, weight) in entries.items():
        if any(entry[:n] in stems for n in range(1, len(entry))):
            continue  # a shorter stem speaks for it
        for n, letter in enumerate(entry):
            arcs[entry[:n], letter] = (entry[: n + 1], None, 1.0)
        if not whole:
            arcs[entry, "*"] = (entry, None, 1.0)
        arcs[entry, " "] = ("", kind, weight)
    for state in {s for s, _ in arcs}:
        arcs.setdefault((state, "*"), ("-", None, 1.0))
        arcs.setdefault((state, " "), ("", "word", 0.0))
    arcs["-", " "] = ("", "word", 0.0)
    arcs.setdefault(("", "*"), ("-", None, 1.0))
    return Transducer("", arcs)


def insult_machine(words: list[str], stems: dict[str, float]) -> Transducer:
    return spelling_machine({w: ("insult", SEED_WEIGHT) for w in words}, {s: ("insult", w) for s, w in stems.items()})


def threat_machine(words: list[str]) -> Transducer:
    return spelling_machine({w: ("threat", SEED_WEIGHT) for w in words}, {})


def function_word_machine() -> Transducer:
    """Targets, negations and verbs of speech; they carry no weight of their own."""
    return spelling_machine({w: (k, 0.0) for k in ("report", "negation", "target") for w in KINDS[k]}, {})


def negation_machine(reach: int = 3) -> Transducer:
    """An insult or threat within ``reach`` words after a negation is negated."""
    arcs = {}
    for left in range(reach + 1):
        arcs[left, "negation"] = (reach, None, 1.0)
        arcs[left, "*"] = (max(0, left - 1), None, 1.0)
        if left:
            arcs[left, "insult"] = (left - 1, "insult_negated", SOFTENED)
            arcs[left, "threat"] = (left - 1, "threat_negated", SOFTENED)
    return Transducer(0, arcs)


def report_machine() -> Transducer:
    """After a verb of speech, the rest of the clause is somebody else's."""
    return Transducer(0, {(0, "report"): (1, None, 1.0), (1, "insult"): (1, "insult_reported", SOFTENED), (1, "threat"): (1, "threat_reported", SOFTENED)})


def target_machine() -> Transducer:
    """An insult after a target is aimed at it; a threat counts only if a target stands next to it or before it."""
    return Transducer("none", {
        ("none", "target"): ("seen", None, 1.0), ("none", "insult"): ("none", "insult", 1.0), ("none", "threat"): ("raised", "word", 0.0),
        ("raised", "target"): ("seen", "threat_at", AIMED * SEED_WEIGHT), ("raised", "threat"): ("raised", "word", 0.0), ("raised", "*"): ("none", None, 1.0),
        ("seen", "insult"): ("seen", "insult_at", AIMED), ("seen", "threat"): ("seen", "threat_at", AIMED),
    })


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    kinds = [*KINDS, "word"]
    softened = ["insult_negated", "threat_negated", "insult_reported", "threat_reported"]
    both = compose(negation_machine(), report_machine(), kinds)
    return compose(both, target_machine(), kinds + softened)


class Lexicon:
    """The whole cascade: spelling machines turn letters into classes with weights, the grammar reads those of a clause."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.machines = [insult_machine(INSULTS, stems), threat_machine(THREATS), function_word_machine()]
        self.known: dict[str, tuple[str, float]] = {}
        self.finder = ahocorasick.Automaton()
        for word in {*INSULTS, *THREATS, *stems}:
            self.finder.add_word(word, len(word))
        self.finder.make_automaton()

    def hit(self, text: str) -> bool:
        """Does a word of the text begin with an insult, a threat or a stem?"""
        for end, size in self.finder.iter(text):
            before = end - size
            if before < 0 or not text[before].isalpha():
                return True
        return False

    def read(self, word: str) -> tuple[str, float]:
        """Class and weight: what the first spelling machine that knows the word gives out at its end."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 50_000:
                self.known = {}
            ends = (machine.run([*word, " "])[-1] for machine in self.machines)
            found = self.known[word] = next((e for e in ends if e[0] != "word"), ("word", 0.0))
        return found

    def matches(self, clause: str) -> list[tuple[str, float]]:
        """The grammar's outputs over one clause with the weights of their paths."""
        read = [self.read(w) for w in WORD.findall(clause)]
        out = grammar().run([k for k, _ in read])
        # A threat is booked where its target stands, with the weight of that arc alone.
        return [(o, weight * (w if k in ("insult", "threat") else 1.0)) for (k, w), (o, weight) in zip(read, out) if o in STRENGTHS]

    def features(self, text: str | None) -> list[float]:
        """Counts of the grammar's outputs, matched clauses, and strengths: of each clause the strongest match of a kind."""
        lower = (text or "").lower()
        if not self.hit(lower):
            return [0.0] * len(FEATURES)
        counts, clauses, strength = Counter(), 0, Counter()
        for clause in CLAUSE.findall(lower):
            if not self.hit(clause):
                continue
            found = self.matches(clause)
            if found:
                counts.update(o for o, _ in found)
                clauses += 1
                for kind in ("aimed", "plain", "softened"):
                    strength[kind] += max((w for o, w in found if STRENGTHS[o] == kind), default=0.0)
        return [math.log1p(v) for v in [*[counts[o] for o in OUTPUTS], clauses, strength["aimed"], strength["plain"], strength["softened"]]]


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in STEM_LENGTHS if len(word) >= n] + ([word] if len(word) > max(STEM_LENGTHS) or len(word) < min(STEM_LENGTHS) else [])


def count_stems(texts: DataFrame) -> DataFrame:
    """(stem, toxic, clean): in how many of the labelled texts (text, y) a word with the stem stands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            counts = (Counter(), Counter())
            for text, y in zip(texts, batch.column(1).to_pylist()):
                counts[y].update({s for w in set(WORD.findall((text or "").lower())) for s in stems_of(w)})
            both = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(both, pa.string()), pa.array([counts[1][s] for s in both], pa.int64()), pa.array([counts[0][s] for s in both], pa.int64())],
                names=["stem", "toxic", "clean"],
            )

    return texts.select("text", "y").mapInArrow(giving_back(each), "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def support(texts: DataFrame, stems: list[str]) -> DataFrame:
    """(stem, ways): how many different words stand before the stem's words, so that copies of a text count once."""
    wanted = frozenset(stems)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "text"):
            met = set()
            for text in texts:
                words = WORD.findall((text or "").lower())
                met.update((s, before) for before, w in zip(["", *words], words) for s in stems_of(w) if s in wanted)
            listed = list(met)
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in listed], pa.string()) for i in (0, 1)], names=["stem", "before"])

    rows = texts.filter("y = 1").select("text").mapInArrow(giving_back(each), "stem string, before string").distinct()
    return rows.groupBy("stem").agg(F.count(F.lit(1)).alias("ways"))


def learn_stems(texts: DataFrame, n_toxic: int, n_clean: int, most: int = 5000) -> dict[str, float]:
    """Stems that toxic texts have at least 100 times as often as clean ones, with the log of that ratio.

    ``most`` bounds the lexicon, which is part of the model; the strongest stems come first. A stem within a chosen
    shorter stem is left out.
    """
    lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    rows = count_stems(texts).withColumn("lift", lift).filter((F.col("toxic") >= LEAST_SUPPORT) & (F.col("lift") >= math.log(100)))
    rows = rows.orderBy(F.desc("toxic"), "stem").limit(most).collect()
    lifts = {r["stem"]: r["lift"] for r in rows}
    if not lifts:
        return {}
    ways = {r["stem"]: r["ways"] for r in support(texts, list(lifts)).collect()}
    out: dict[str, float] = {}
    for stem in sorted(lifts, key=len):
        if ways.get(stem, 0) >= LEAST_SUPPORT and not any(stem[:n] in out for n in range(1, len(stem))):
            out[stem] = lifts[stem]
    return out


def clause_features(docs: DataFrame, stems: dict[str, float], id_col: str, text_col: str) -> DataFrame:
    """(id, row of FEATURES) of every whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch, texts in text_batches(batches, "text"):
            rows = np.array([lexicon.features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, i]) for i in range(rows.shape[1])]], names=["id", *FEATURES])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(giving_back(each), ", ".join(["id long", *[f"{f} double" for f in FEATURES]]))


# Weights used where no labels are given (intercept, then FEATURES).
PRIOR = [-3.0, 0.5, 1.0, 0.1, 0.1, 1.0, 0.1, 0.1, 0.3, 1.5, 1.0, 0.1]


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held_out: int = 2, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, held_out, score, predicted and the FEATURES): toxicity of every whole text, 0 to 1.

    Transducers over letters read insults, threats, targets, negations and verbs of speech; those for negation, reported
    speech and targets are composed into one machine, run over every clause, whose arcs weigh what they put out. Stems of insults and the weights of the machine's outputs are learned from at most
    ``sample`` rows of either label outside the held-out fold, weighted to the labels' shares there; ids, languages, sources and labels never enter a score.

    Null and empty texts match nothing and get the lowest score of the model. Null ids keep their rows (held_out false)
    and never carry labels. Without labels of both kinds fixed weights serve. Rows that repeat an id are scored each.
    """
    train = materialize(sample_labels(labels, label, fold(id_col, parts) != held_out, sample, id_col), "labels")
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    stems, weights = {}, np.array(PRIOR)
    both = counts.get(0, 0) > 0 and counts.get(1, 0) > 0
    if both:
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(train), "id").select("text", "y")
        texts = materialize(texts, "labelled")  # at most 2 * sample rows
        stems = learn_stems(texts, counts[1], counts[0])
    rows = materialize(clause_features(docs, stems, id_col, text_col), "clauses")
    if both:
        # All rows of a label weigh the same, so the sum does not depend on their order.
        fitted = rows.join(F.broadcast(train), "id").groupBy("y", *FEATURES).agg(F.sum("weight").alias("n")).orderBy("y", *FEATURES).toPandas()
        weights = logistic(fitted[FEATURES].to_numpy(), fitted["y"].to_numpy(), stands_for=fitted["n"].to_numpy())
    z = F.lit(float(weights[0]))
    for name, w in zip(FEATURES, weights[1:]):
        z = z + F.col(name) * float(w)
    return rows.withColumn("score", sigmoid(z)).select(
        "id", F.coalesce(fold("id", parts) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *FEATURES
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic.

    A document goes with all rows of its id if one of them is predicted toxic. Null ids, null and empty texts stay;
    repeated rows of a clean document stay each; all columns pass through; an empty table gives no rows.
    """
    bad = toxicity_scores(docs, labels, id_col=id_col, text_col=text_col).filter("predicted = 1").select(F.col("id").alias("bad_id_")).distinct()
    return docs.join(bad, docs[id_col] == bad["bad_id_"], "left_anti")

