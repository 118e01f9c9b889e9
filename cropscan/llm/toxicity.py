"""Toxicity by weak supervision.

Many voters look for fixed word lists, for word and stem lists taken from labelled training rows, and for patterns.
A generative label model estimates from the votes of all documents how accurate each voter is and
which voters err together, and gives every vote pattern a posterior. A linear classifier over
words and stems is trained on those posteriors; its score is the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import coded, held_out, per_slice, table, texts, words
from .sampling import TRAIN_ROWS, draw, training_labels

# Words that insult or belittle, by group.
LEXICONS = {
    "persons": "idiot moron imbecile loser clown fool dunce cretin jerk bastard scumbag pig rat coward liar freak creep",
    "worth": "worthless pathetic useless stupid dumb disgusting vile filthy trash garbage scum ugly lazy ignorant inferior",
    "abuse": "bitch asshole bullshit crap damn fuck fucking shit slut whore cunt dick wanker retard retarded",
    "threats": "kill murder strangle rape hurt destroy exterminate",
    "german": "idiot dumm dummkopf arschloch scheiße trottel wertlos ekelhaft abschaum hurensohn schwachkopf verlierer müll",
    "french": "idiot idiote imbécile connard connasse salaud merde crétin pathétique dégoûtant ordure nul putain débile",
    "spanish": "idiota imbécil estúpido estúpida basura asqueroso patético inútil cabrón mierda puta escoria tonto pendejo",
}
LEXICON_SETS = {name: frozenset(words_.split()) for name, words_ in LEXICONS.items()}

#: Labelled documents that must hold a word or stem, and the least log odds, for the learned lists.
LEAST_DOCS = 3
LEAST_ODDS = 2.5
#: Entries of the learned lists, most telling first; with STEM_CHARS the bound of what is broadcast.
LEARNED = 4_000
STEM_CHARS = (5, 6)
#: Features of the linear classifier, by the same order.
FEATURES = 6_000
EPOCHS = 300
THRESHOLD = 0.5

_DIRECT = r"(?i)\b(?:you|your|you're|ur|du|ihr|tu|vous|tú|usted)\b[^.!?\n]{0,40}\b(?:"
_SHOUT = r"[\p{Lu}]{3,}[^\p{L}]+[\p{Lu}]{3,}!!"
_MASKED = r"(?i)\b[a-z][*#@$%]{2,}[a-z]*\b|\b(?:f|s|b|c)[*#@$]+(?:k|t|h)\b"

VOTERS = (*LEXICONS, "words_a", "words_b", "stems", "direct", "shout", "masked", "several", "nothing")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def lower_words(column: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
    """Lower-cased runs of letters and digits: number of each, the different ones, the rows' bounds."""
    flat, bounds = words(pc.replace_substring_regex(pc.utf8_lower(column), r"[^\pL\pN]+", " "))
    index, different = coded(flat)
    return index, different, bounds


def stems(word: str) -> list[str]:
    return [word[:n] + "-" for n in STEM_CHARS if len(word) > n]


def learned_lists(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, float]]:
    """(word or stem, log odds) that mark toxic rows among about ``rows`` labelled ones, most telling first.

    A stem ends in "-". Only words in LEAST_DOCS rows or more count, with LEAST_ODDS or more. Rows
    are counted by the smallest hash of their words, so that near copies mostly count once.
    """
    chosen = training_labels(labels, "toxic", rows)
    some = texts(docs).join(F.broadcast(chosen), "doc_id")
    listed = some.select("y", tokens(F.col("text")).alias("words")).select(
        "y", "words", F.array_min(F.transform("words", lambda w: F.xxhash64(w))).alias("kind"))
    cut = listed.select("y", "kind", F.explode("words").alias("w")).select("y", "kind", F.explode(F.array(F.col("w"), *(
        F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("-"))) for n in STEM_CHARS))).alias("w"))
    totals = listed.groupBy("y").agg(F.countDistinct("kind").alias("n")).collect()
    bad, good = (float(sum(r["n"] for r in totals if r["y"] == y)) for y in (1.0, 0.0))
    counts = cut.where("w is not null").groupBy("w").agg(
        F.countDistinct(F.when(F.col("y") == 1, F.col("kind"))).alias("hits"),
        F.countDistinct(F.when(F.col("y") == 0, F.col("kind"))).alias("misses")).where(F.col("hits") >= LEAST_DOCS)
    odds = F.log((F.col("hits") + 0.5) / (bad + 1)) - F.log((F.col("misses") + 0.5) / (good + 1))
    found = counts.select("w", "hits", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS).orderBy(
        F.desc(F.col("odds") * F.log1p("hits")), "w").limit(LEARNED).collect()
    return [(r["w"], r["odds"]) for r in found]


@dataclass
class Voters:
    """Votes 1, -1 or 0 of every voter; the word lists are what was learned."""

    learned: list[tuple[str, float]]
    lists: dict[str, frozenset] = field(init=False)
    direct: str = field(init=False)

    def __post_init__(self):
        plain = [w for w, _ in self.learned if not w.endswith("-")]
        self.lists = {
            **LEXICON_SETS, "words_a": frozenset(plain[::2]), "words_b": frozenset(plain[1::2]),
            "stems": frozenset(w for w, _ in self.learned if w.endswith("-")),
        }
        fixed = sorted(set().union(*(LEXICON_SETS[k] for k in ("persons", "worth", "abuse"))))
        self.direct = _DIRECT + "|".join(fixed) + r")\b"

    def hits(self, word: str) -> list[str]:
        found = [name for name, held in self.lists.items() if name != "stems" and word in held]
        return found + ["stems"] * any(s in self.lists["stems"] for s in stems(word))

    def votes(self, column: pa.Array) -> np.ndarray:
        index, different, bounds = lower_words(column)
        out = np.zeros((len(bounds) - 1, len(VOTERS)), np.int8)
        place = {name: i for i, name in enumerate(VOTERS)}
        telling = np.zeros(len(different), bool)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        named: dict[str, list[int]] = {}
        for number, word in enumerate(different):
            for name in self.hits(word):
                named.setdefault(name, []).append(number)
                telling[number] = True
        for name, numbers in named.items():
            held = np.zeros(len(different), bool)
            held[numbers] = True
            out[row[held[index]], place[name]] = 1
        pairs = np.unique(row[telling[index]] * max(1, len(different)) + index[telling[index]]) if len(index) else np.zeros(0, int)
        kinds = np.bincount(pairs // max(1, len(different)), minlength=len(out))
        out[kinds >= 2, place["several"]] = 1
        for name, pattern in (("direct", self.direct), ("masked", _MASKED)):
            out[pc.match_substring_regex(column, pattern).to_numpy(False), place[name]] = 1
        # Shouting without any such word is noise rather than abuse in the texts read so far: a vote against.
        shout = pc.match_substring_regex(column, _SHOUT).to_numpy(False)
        out[shout, place["shout"]] = np.where(kinds[shout] > 0, 1, -1)
        out[kinds == 0, place["nothing"]] = -1
        return out


@dataclass
class LabelModel:
    """Naive generative model of votes given the label, with voters that err together counted in part."""

    prior: float
    given: np.ndarray   # log P(vote | label) by voter, label, vote + 1
    power: np.ndarray   # what part of a voter's evidence is its own
    accuracy: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        which = votes.astype(int) + 1
        ratio = self.given[:, 1, :] - self.given[:, 0, :]
        spoken = ratio[np.arange(votes.shape[1]), which] * self.power
        logit = np.log(self.prior / (1 - self.prior)) + spoken.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


#: Correlation below which two voters pass for independent.
LOOSE = 0.3
ENOUGH = 200


def fit_label_model(votes: np.ndarray, counts: np.ndarray, truth: np.ndarray | None = None, rounds: int = 40) -> LabelModel:
    """Expectation maximisation over different vote patterns and how often each occurs.

    ``truth``: the label of patterns that come from labelled training rows, nan elsewhere; it fixes
    which class is which. The correlation of two voters within a class lowers the power of both; it
    is taken from labelled rows where there are ENOUGH, since voters that agree often pull
    the posterior to themselves and then seem independent.
    """
    m = votes.shape[1]
    counts = counts.astype(float)
    total = counts.sum()
    q = np.where(votes.sum(axis=1) > 0, 0.9, 0.05) if len(votes) else np.zeros(0)
    known = np.zeros(len(votes), bool) if truth is None else ~np.isnan(truth)
    if known.any():
        q = np.where(known, truth, q)
    power, correlation = np.ones(m), np.zeros((m, m))
    for _ in range(rounds):
        prior = float(np.clip((counts @ q + 1) / (total + 2), 1e-4, 1 - 1e-4))
        given = np.zeros((m, 2, 3))
        for label, share in ((1, q), (0, 1 - q)):
            weight = counts * share
            for vote in (-1, 0, 1):
                given[:, label, vote + 1] = np.log((weight @ (votes == vote) + 0.1) / (weight.sum() + 0.3))
        correlation = np.zeros((m, m))
        seen = counts * known if (counts * known).sum() >= ENOUGH else counts
        for share in (q, 1 - q):
            weight = seen * share
            if weight.sum() > 1:
                centred = votes - weight @ votes / weight.sum()
                cover = (centred * weight[:, None]).T @ centred / weight.sum()
                spread = np.sqrt(np.maximum(np.diag(cover), 1e-9))
                correlation = np.maximum(correlation, np.where(np.outer(spread, spread) > 1e-6, np.abs(cover / np.outer(spread, spread)), 0))
        np.fill_diagonal(correlation, 0)
        power = 1 / (1 + np.clip(correlation - LOOSE, 0, 1).sum(axis=1))
        model = LabelModel(prior, given, power, np.zeros(m), correlation)
        new = np.where(known, q, model.posterior(votes))
        if len(new) == 0 or np.abs(new - q).max() < 1e-4:
            q = new
            break
        q = new
    spoken = counts[:, None] * (votes != 0)
    right = counts[:, None] * np.where(votes > 0, q[:, None], np.where(votes < 0, 1 - q[:, None], 0))
    model.accuracy = right.sum(axis=0) / np.maximum(spoken.sum(axis=0), 1e-9) if len(votes) else np.zeros(m)
    return model


def vote_patterns(docs: DataFrame, voters: Voters, labelled: DataFrame) -> DataFrame:
    """(votes, y, n) over all documents, as text of 0, 1, 2; y is null but for ``labelled`` rows.

    There are at most three to the power of the voters for each y.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def work(piece):
        votes = shared.value.votes(piece["text"]) + 1
        return {"votes": ["".join(map(str, v)) for v in votes.tolist()], "y": piece["y"]}

    marked = texts(docs).join(F.broadcast(labelled), "doc_id", "left")
    return per_slice(marked, work, "votes string, y double").groupBy("votes", "y").agg(F.count("*").alias("n"))


@dataclass
class Linear:
    """Weights of words and stems that a text holds or not, and the constant."""

    weights: dict[str, float]
    constant: float

    def score(self, column: pa.Array) -> np.ndarray:
        index, different, bounds = lower_words(column)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        owners: dict[str, list[int]] = {}
        for number, word in enumerate(different):
            for name in (word, *stems(word)):
                if name in self.weights:
                    owners.setdefault(name, []).append(number)
        total = np.full(len(bounds) - 1, self.constant)
        for name, numbers in owners.items():
            held = np.zeros(len(different), bool)
            held[numbers] = True
            total[np.unique(row[held[index]])] += self.weights[name]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_linear(rows: list[tuple[list[int], float]], names: list[str]) -> Linear:
    """Logistic regression on soft labels, by full-batch Adam over present features."""
    if not rows:
        return Linear({}, 0.0)
    feature = np.array([f for held, _ in rows for f in held], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(held) for held, _ in rows])
    y = np.array([target for _, target in rows])
    w, b, step = np.zeros(len(names)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), 0
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for _ in range(EPOCHS):
        step += 1
        logit = np.bincount(owner, weights=w[feature], minlength=len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(rows)
        g = np.append(np.bincount(feature, weights=error[owner], minlength=len(names)) + 1e-5 * w, error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Linear(dict(zip(names, w.tolist(), strict=True)), b)


def train_linear(docs: DataFrame, voters: Voters, model: LabelModel, rows: int = TRAIN_ROWS) -> Linear:
    """The classifier, from the posteriors of about ``rows`` documents that are not held out, whether labelled or not.

    Its features are the voters' words; a listed word that those rows lack gets its voter's prior weight.
    """
    names = list(dict.fromkeys([w for w, _ in voters.learned] + sorted(set().union(*LEXICON_SETS.values()))))[:FEATURES]
    number = {n: i for i, n in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast((voters, model, number))
    pool = texts(docs).where(~held_out(5, 0))
    some = pool.where(draw("doc_id") < min(1.0, rows / max(1, pool.count())))

    def work(piece):
        held_voters, label_model, numbers = shared.value
        index, different, bounds = lower_words(piece["text"])
        known = [[numbers[n] for n in (w, *stems(w)) if n in numbers] for w in different]
        held = [sorted({f for i in np.unique(index[a:b]).tolist() for f in known[i]})
                for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return {"doc_id": piece["doc_id"], "y": label_model.posterior(held_voters.votes(piece["text"])),
                "held": pa.array(held, pa.list_(pa.int32()))}

    found = per_slice(some, work, "doc_id long, y double, held array<int>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["y"], r["held"]))
    counts = np.bincount([f for r in found for f in r["held"]], minlength=len(names)) if found else np.zeros(len(names), int)
    linear = fit_linear([(r["held"], r["y"]) for r in found], names)
    return with_priors(linear, model, dict(zip(names, counts.tolist(), strict=True)))


def prior_weights(model: LabelModel) -> dict[str, float]:
    """For each word of the fixed lists, by how much it alone raises the label model's log odds over no telling word.

    A list that has never spoken is taken to be as telling as those that have, on average.
    """
    place = {name: i for i, name in enumerate(VOTERS)}
    ratio = (model.given[:, 1, :] - model.given[:, 0, :]) * model.power[:, None]
    raised = {name: float(ratio[place[name], 2] - ratio[place[name], 1]) for name in LEXICON_SETS}
    spoke = [raised[name] for name in LEXICON_SETS if model.accuracy[place[name]] > 0]
    usual = sum(spoke) / len(spoke) if spoke else 0.0
    any_word = float(ratio[place["nothing"], 1] - ratio[place["nothing"], 0])
    out: dict[str, float] = {}
    for name, held in LEXICON_SETS.items():
        own = raised[name] if model.accuracy[place[name]] > 0 else usual
        for word in held:
            out[word] = max(out.get(word, 0.0), any_word + own)
    return out


def with_priors(linear: Linear, model: LabelModel, seen: dict[str, int]) -> Linear:
    """The classifier, with the prior weight for listed words that fewer than LEAST_DOCS training rows held.

    Of those it has learned nothing, yet the label model, whose posteriors it stands for, knows their voters.
    """
    unknown = {w: p for w, p in prior_weights(model).items() if seen.get(w, 0) < LEAST_DOCS}
    return Linear({**linear.weights, **{w: max(p, linear.weights.get(w, 0.0)) for w, p in unknown.items()}}, linear.constant)


def score(docs: DataFrame, linear: Linear) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts get the constant alone."""
    shared = docs.sparkSession.sparkContext.broadcast(linear)  # FEATURES weights

    def work(piece):
        return {"doc_id": piece["doc_id"], "score": shared.value.score(piece["text"])}

    return per_slice(texts(docs), work, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Voters, LabelModel, Linear]:
    voters = Voters(learned_lists(docs, labels))
    # Bounded by the number of patterns; the labelled rows are those that the lists came from.
    patterns = vote_patterns(docs, voters, training_labels(labels, "toxic")).collect()
    patterns.sort(key=lambda r: (r["votes"], -1.0 if r["y"] is None else r["y"]))
    votes = np.array([[int(c) - 1 for c in r["votes"]] for r in patterns], np.int8).reshape(len(patterns), len(VOTERS))
    truth = np.array([np.nan if r["y"] is None else r["y"] for r in patterns], float)
    model = fit_label_model(votes, np.array([r["n"] for r in patterns], float), truth)
    return voters, model, train_linear(docs, voters, model)


def toxicity_query(spark, sf_dir) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows of equal text get equal scores.

    Null and empty texts, and all texts where nothing was learned, get the constant. Of repeated labels of a doc_id
    the smallest counts; null labels and ids teach nothing. Without labelled rows the fixed lists
    alone vote. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    _, _, linear = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, linear).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
