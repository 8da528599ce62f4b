"""Abusive, hateful or sexual passages: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is a bag of passages (sentences and lines), and its score is that of its worst passage. Words are compared after undoing common
disguises: compatibility forms, look-alike letters, invisible characters, accents, digits and signs for letters, letters
set apart by signs, drawn-out letters, one or two masked letters. Features of a passage are its words, pairs of neighbours, and
pairs with one or two words between them, hashed to 2**BITS weights. Per-coordinate learning rates and the L1 term leave
few weights, which are what travels to the workers.

Labels belong to whole documents and some are wrong, so training alternates: the passage that scores highest stands for a
document labelled as a case, all passages of the others are counterexamples, and documents whose label the previous
model firmly contradicts count less. A case is shown with part of its features left out each time, pairs more often than
words, so that every word of it learns to speak for itself and turns of phrase seen once are of use elsewhere.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
MASK = (1 << BITS) - 1
#: Bounds of the training sample: so many labelled documents, chosen by a hash of doc_id, none of them longer.
MAX_TRAINING_DOCS = 12_000
MAX_TRAINING_CHARS = 10_000
#: Texts go through the features in pieces of about this length, cut between words, to bound a worker's memory.
PIECE_CHARS = 300_000
THRESHOLD = 0.12
#: From the fourth round on a case whose worst passage stays below this is taken for a wrong label.
DOUBT = 0.3
#: Shares of a case's words and of its pairs that are left out each time it is shown.
LEFT_OUT = (0.4, 0.6, 0.6, 0.6)
#: Counterexamples below this probability are as good as learned and sit out the rest of a round.
LEARNED = 0.002
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһӏԛԝвкмнтгпьвАЕОРСУХІЈЅВКМНТαοενρτυικχβΑΒΕΖΗΙΚΜΝΟΡΤΥΧıłøđ",
    "aeopcyxijsdhlqwbkmhtrnbbaeopcyxijsbkmhtaoevptuikxbabezhikmnoptyxilod",
)
#: Digits and signs written for letters.
SIGNS = str.maketrans("013457@$!|+", "oieastasilt")
_APART = re.compile(r"(?<![a-z0-9])(?:[a-z][-._*~ ]){2,}[a-z]?(?![a-z0-9])")
_DRAWN = re.compile(r"([a-z])\1{2,}")
_WORD = re.compile(r"\n|\s-\s|[.;:!?\]]\s|[^\W_][^\W_@$!|+*]*(?:[@$!|+*]+[^\W_]+)*[$@]*|[@$][^\W_@$!|+*]+(?:[@$!|+*]+[^\W_]+)*")
#: A binary patch as version control writes it: head, size, lines of one letter and five encoded signs at a time. Only such
#: lines, and only below such a head, are passed over.
_BINARY = re.compile(r"(?mi)^(GIT binary patch\n)(?:(?:literal|delta) \d+\n(?:[A-Za-z](?:[0-9A-Za-z!#$%&()*+;<=>?@^_`{|}~-]{5})+(?:\n|\Z))+\n?)+")
#: Lines that name a person by mail address, bear a date and time, or head a file in a diff: tools write them. They are
#: scored as any other, but do not stand for a case in training.
_STAMP = re.compile(r"(?m)^(?:.*<[^<>\s]+@[^<>\s]+>.*|.*\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d.*|diff --git .*|index [0-9a-f]+\.\..*|(?:---|\+\+\+) [ab]/.*|Binary files .* differ)$")
_MIXED = re.compile(r"(?=.*[a-z])(?=.*[013457@$!|+])")


def plain(text: str) -> str:
    """The text with its disguises undone as far as that needs no dictionary."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if c < "\x80" or unicodedata.category(c) not in ("Mn", "Cf")).translate(LOOKALIKES)
    text = text.lower().replace("\r\n", "\n").replace("\r", "\n")
    text = _BINARY.sub(r"\1", text)
    text = _APART.sub(lambda m: re.sub(r"[^a-z]", "", m.group()) + " ", text)
    return _DRAWN.sub(r"\1", text)


class _Codes(dict):
    """Hash of a word; 0 for the end of a passage."""

    def __missing__(self, word: str) -> int:
        if not any(map(str.isalnum, word)):
            code = 0
        else:
            known = word.translate(SIGNS) if _MIXED.match(word) else word
            code = (zlib.crc32(known.encode("utf-8", "surrogatepass")) | 1 << 32) if "*" not in known else self.masked(known)
        if len(self) < 2_000_000:
            self[word] = code
        return code

    #: weights of single words, by which a masked letter is guessed
    weights: np.ndarray | None = None

    def masked(self, word: str) -> int:
        """One or two stars stand for the letters that make the heaviest word; a word with more stars is one of its own."""
        letters = "aeioubcdfghjklmnpqrstvwxyz"
        if word.count("*") > 2:
            return zlib.crc32(word.encode("utf-8", "surrogatepass")) | 1 << 32
        options = [word]
        while "*" in options[0]:
            options = [o.replace("*", c, 1) for o in options for c in letters]
        codes = np.array([zlib.crc32(o.encode("utf-8", "surrogatepass")) | 1 << 32 for o in options], dtype=np.int64)
        return int(codes[np.argmax(np.abs(self.weights[_mix(codes, 1)]))] if self.weights is not None else codes[0])


def _mix(code: np.ndarray, salt: int) -> np.ndarray:
    x = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
    return ((x >> np.uint64(64 - BITS)) & np.uint64(MASK)).astype(np.int64)


def _words(text: str) -> list[str]:
    return _WORD.findall(text)


def features(texts: list[list[str]], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage of each feature, feature, its distance between words, text of each passage) over the words of all texts."""
    words, owner = [], []
    for found in texts:
        words += found
        words.append("\n")
        owner.append(len(words))
    code = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
    breaks = code == 0
    passage = np.cumsum(breaks) - breaks
    text_of = np.searchsorted(np.array(owner), np.flatnonzero(breaks), side="right") if len(code) else np.zeros(0, np.int64)
    there = np.flatnonzero(~breaks)
    at, found, gaps = [passage[there]], [_mix(code[there], 1)], [np.zeros(len(there), np.int8)]
    for gap in (1, 2, 3):
        i = there[there + gap < len(code)]
        i = i[passage[i] == passage[i + gap]]
        i = i[~breaks[i + gap]]
        at.append(passage[i])
        found.append(_mix(code[i] * 31 + code[i + gap] * 0x2545F491, 1 + gap))
        gaps.append(np.full(len(i), gap, np.int8))
    return np.concatenate(at), np.concatenate(found), np.concatenate(gaps), text_of


def passage_scores(weights: np.ndarray, bias: float, at: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    return bias + np.bincount(at, weights=weights[feature], minlength=n)


class Ftrl:
    """FTRL-proximal logistic regression on sparse binary features, in small batches."""

    def __init__(self, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.1, l2: float = 0.5) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(MASK + 2), np.zeros(MASK + 2)  # the last one is the bias

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, feature: np.ndarray, y: np.ndarray, importance: np.ndarray) -> None:
        coords, inv = np.unique(np.concatenate([feature, np.full(len(y), MASK + 1)]), return_inverse=True)
        row = np.concatenate([at, np.arange(len(y))])
        w = self.weights(coords)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[inv], minlength=len(y)), -30, 30)))
        g = np.bincount(inv, weights=((p - y) * importance)[row], minlength=len(coords))
        g2 = np.bincount(inv, weights=(((p - y) * importance) ** 2)[row], minlength=len(coords))
        n = self.n[coords]
        self.z[coords] += g - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * w
        self.n[coords] = n + g2


def _probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def train(texts: list[str], toxic: np.ndarray, trust: np.ndarray, rounds: int = 6, epochs: int = 12, batch: int = 512, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) from texts with labels in [0, 1] and weights of trust."""
    codes, case = _Codes(), toxic > 0.5
    parts, n = [], 0
    for k in range(0, len(texts), 200):
        plains = (plain(_STAMP.sub("", t) if c else t) for t, c in zip(texts[k : k + 200], case[k : k + 200]))
        a, f, g, t = features([_words(p) for p in plains], codes)
        order = np.argsort(a, kind="stable")
        parts.append(((a[order] + n).astype(np.int32), f[order].astype(np.int32), g[order], t + k))
        n += len(t)
    codes.clear()
    at, feature, gap, text_of = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int32) for i in range(4))
    del parts
    # a first guess for each passage: mean log-odds of its features between documents
    pairs = np.unique(text_of[at] * (MASK + 1) + feature)
    doc, f = pairs >> BITS, pairs & MASK
    del pairs
    in_case = np.bincount(f, weights=(case * trust)[doc], minlength=MASK + 1)
    in_rest = np.bincount(f, weights=(~case * trust)[doc], minlength=MASK + 1)
    odds = np.log((in_case + 0.3) / ((case * trust).sum() + 0.6)) - np.log((in_rest + 0.3) / ((~case * trust).sum() + 0.6))
    guess = np.bincount(at, weights=odds[feature], minlength=n) / np.maximum(np.bincount(at, minlength=n), 1)
    # what only one counterexample has says nothing about others
    keep = ((np.bincount(f, minlength=MASK + 1) > 1) | (in_case > 0))[feature]
    at, feature, gap = at[keep], feature[keep], gap[keep]
    del doc, f, keep, odds, in_case, in_rest
    first = np.searchsorted(at, np.arange(n + 1))
    filled = np.flatnonzero(np.diff(first) > 0)
    rng = np.random.default_rng(seed)
    left_out = np.array(LEFT_OUT)
    weights, bias, score = np.zeros(MASK + 1), 0.0, guess
    for step in range(rounds):
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text_of[filled], score[filled])
        top = np.zeros(n, dtype=bool)
        best = filled[np.lexsort((score[filled], text_of[filled]))]
        top[best[np.concatenate([text_of[best][1:] != text_of[best][:-1], [True]])]] = True
        belief = np.ones(len(texts))
        if step:
            p = _probability(worst)
            doubted = np.clip(p * 1.5, 0.02, 1) if step < 3 else np.where(p < DOUBT, 0.0, np.clip(p * 1.5, 0.02, 1))
            belief = np.where(case, doubted, np.clip((1 - p) * 2, 0.1, 1))
        y = np.where(case[text_of] & top, 1.0, 0.0)
        use = filled[~case[text_of[filled]] | top[filled]]
        importance = trust[text_of] * belief[text_of] * np.where(y > 0, 3.0, 1.0)
        model = Ftrl()
        for epoch in range(epochs):
            shown = use
            if epoch >= 3:
                w = model.weights()
                shown = use[(y[use] > 0) | (_probability(passage_scores(w[:-1], w[-1], at, feature, n))[use] > LEARNED)]
            shuffled = rng.permutation(shown)
            for s in range(0, len(shuffled), batch):
                rows = shuffled[s : s + batch]
                counts = first[rows + 1] - first[rows]
                take = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                row = np.repeat(np.arange(len(rows)), counts)
                stay = (y[rows][row] == 0) | (rng.random(len(row)) >= left_out[gap[take]])
                model.learn(row[stay], feature[take[stay]], y[rows], importance[rows])
        w = model.weights()
        weights, bias = w[:-1], float(w[-1])
        score = passage_scores(weights, bias, at, feature, n)
    return weights, bias


@dataclass(frozen=True)
class Model:
    """What is left of the weights after L1, small enough to travel with the task."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(MASK + 1)
        w[self.feature] = self.weight
        return w


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS, max_chars: int = MAX_TRAINING_CHARS) -> Model:
    """Trains on at most ``max_docs`` labelled documents of at most ``max_chars`` characters (see the bounds above).

    Several labels of a document are averaged; ties and null labels teach nothing; confidence (1 to 3, null counts as 1.5)
    is a document's weight. Without a single case the model gives every text the same low score.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
    marks = marks.agg(F.avg(F.col("toxic").cast("double")).alias("y"), (F.sum(F.coalesce(F.col("confidence").cast("double"), F.lit(1.5))) / 2).alias("trust"))
    sample = marks.where("y != 0.5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.where(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y", "trust").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    if rows.empty:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), -5.0)
    weights, bias = train(rows["text"].tolist(), rows["y"].to_numpy(float), rows["trust"].to_numpy(float))
    used = np.flatnonzero(weights)
    return Model(used.astype(np.int32), weights[used].astype(np.float32), bias)


#: Where a long text may be cut: between two words of two letters or more, so that no word or disguise is torn.
_CUT = re.compile(r"[^\W_]{2}[ \t\n](?=[^\W_]{2})")


def _pieces(text: str) -> list[str]:
    out, start = [], 0
    while len(text) - start > PIECE_CHARS:
        found = _CUT.search(text, start + PIECE_CHARS)
        if not found:
            break
        out.append(text[start : found.end()])
        start = found.end()
    return [*out, text[start:]]


def _worst_of_long(pieces: list[str], weights: np.ndarray, bias: float, codes: _Codes) -> float:
    """The worst passage of one text in pieces; a passage that spans pieces counts whole, with the pairs over the cuts."""
    worst, tail, open_sum, open_words = -np.inf, [], 0.0, False
    for no, piece in enumerate(pieces):
        words = _words(piece)
        if not words:
            continue
        at, feature, _, text_of = features([tail + words], codes)
        sums = np.bincount(at, weights=weights[feature], minlength=len(text_of))
        there = np.bincount(at, minlength=len(text_of)) > 0
        if tail:  # what the words carried over add by themselves is in the open sum already
            a, f, _, t = features([tail], codes)
            sums[0] -= weights[f].sum()
        sums[0] += open_sum
        there[0] |= open_words
        last = len(sums) - 1
        closed = sums[:last][there[:last]] if no < len(pieces) - 1 else sums[there]
        worst = max(worst, closed.max(initial=-np.inf))
        open_sum, open_words = (sums[last], bool(there[last])) if no < len(pieces) - 1 else (0.0, False)
        tail = []
        for word in reversed(words):
            if codes[word] == 0 or len(tail) == 3:
                break
            tail.insert(0, word)
    return bias + max(worst, open_sum) if open_words else bias + worst


def worst_passages(texts: list[str | None], weights: np.ndarray, bias: float, codes: _Codes) -> np.ndarray:
    """Probability that the worst passage of each text is a case; 0 for texts without words."""
    out = np.full(len(texts), -np.inf)
    waiting, owners, size = [], [], 0

    def flush() -> None:
        at, feature, _, text_of = features(waiting, codes)
        there = np.unique(at)
        score = passage_scores(weights, bias, at, feature, len(text_of))
        np.maximum.at(out, np.array(owners)[text_of[there]], score[there])
        waiting.clear()
        owners.clear()

    for i, text in enumerate(texts):
        clear = plain(text or "")
        if len(clear) > PIECE_CHARS:
            out[i] = _worst_of_long(_pieces(clear), weights, bias, codes)
            continue
        waiting.append(_words(clear))
        owners.append(i)
        size += len(clear)
        if size >= PIECE_CHARS:
            flush()
            size = 0
    if waiting:
        flush()
    return np.where(np.isneginf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -700, 30))))


def score(text: str | Column, model: Model) -> Column:
    """Probability that a text holds an abusive, hateful or sexual passage; 0 for null, empty and wordless texts."""
    state: dict = {}

    def run(texts: pd.Series) -> pd.Series:
        if not state:
            state["w"], state["codes"] = model.dense(), _Codes()
            state["codes"].weights = state["w"]
        return pd.Series(worst_passages(texts.tolist(), state["w"], model.bias, state["codes"]))

    return F.pandas_udf(run, "double")(text)


def rates(scored: DataFrame, source: str, score_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (lower case, without outer blanks; null is a source): documents, cases, rate and mean score."""
    name = F.lower(F.trim(F.col(source)))
    rows = scored.groupBy(name.alias("source")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col(score_col) >= threshold, 1).otherwise(0)).alias("cases"), F.avg(score_col).alias("mean_score")
    )
    return rows.select("source", "docs", "cases", (F.col("cases") / F.col("docs")).alias("rate"), "mean_score")
