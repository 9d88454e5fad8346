"""Reading level of documents from the grades at which their words are acquired.

Each word's acquisition grade is estimated from where graded texts use it: the mean level
under its frequencies per level, drawn towards the middle where it is rare. A document's
known words give quantiles of their grades; the quantiles are calibrated against graded
documents by a small softmax regression. Only running prose counts: code, headings, links,
list and chat marks are cut away first, and documents not written in English are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from keelsieve.shared import materialise

#: Graded documents used for fitting at most: those of the least hash of their id. A documented bound.
FIT_DOCUMENTS = 20_000
LEVELS = (1, 2, 3, 4)
QUANTILES = np.linspace(0.025, 0.975, 20)

# Frequent function words of the languages that documents come in.
_ENGLISH = frozenset("the of and to in is that it for with as was on are be this by you from or an not which at have if we they will can your when has its but do so our what all would there their into only before after any then than".split())
_OTHERS = frozenset(
    "der die das und ist nicht ein eine mit auf den dem des von zu im für sich wird werden sind auch es sie wir oder nach bei aus wenn nur noch"
    " el la los las de del que y en un una por con para es no se su al lo como más esta este son hay pero antes"
    " le les des du et est une dans pour que qui sur pas ce cette au aux par avec il elle sont nous vous ne plus ou mais être avant"
    " il lo gli di che e per non una sono con della nel o os as do da em um uma não het een van en te dat op zijn met voor niet".split()
) - _ENGLISH
_FENCE = re.compile(r"(?ms)^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[^\n]*$|\Z)")
_TAG = re.compile(r"(?is)<(script|style|pre|code)\b.*?</\1\s*>|<h[1-6]\b.*?</h[1-6]\s*>|<!--.*?-->|</?[a-z][^<>]*>")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_URL = re.compile(r"(?i)\b(?:https?|ftp|file)://\S+|\bwww\.\S+|`[^`\n]*`")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s.*|(?:\d+\.?)+\s+[A-Z][\w\- ]{0,60}|(?:Issue|PR|Ticket)\s+#?\d+:.*|[A-Z]{2,}-\d[\w\-]*\s*\|.*|[=\-*_]{3,}|\|.*\|)\s*$")
_CHAT = re.compile(r"^\s*(?:>+\s*)*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]\s*)?(?:<?@?[\w.\-]{1,24}>?:\s+)?")
_STAMP = re.compile(r"^\s*(?:>+\s*)*\[\d{1,2}:\d{2}")
_MARK = re.compile(r"^\s*(?:>+\s*)*(?:[-*+•]\s+|\d{1,3}[.)]\s+|\(\w\)\s+|\|\s*)?")
_TURN = re.compile(r"(?i)^\s*(?:<\|?/?\w+\|?>|\[/?INST\]|(?:user|assistant|human|system|q|a|question|answer)\s*:)\s*")
_CODE_LINE = re.compile(r"(?: {4,}|\t)\S.*[;{}=()]\s*$")
_INNER_HEADING = re.compile(r"#{1,6}\s")
_BREAK = re.compile(r"(?<=[a-z])-\n(?=[a-z])")
#: How a line begins that any of the patterns for lines may touch; all others are prose as they stand (a test compares both ways).
_MARKED = re.compile(r"[\s#\d=\-*_|>\[<(+\u2022]|(?:Issue|PR|Ticket)\s|[A-Z]{2,}-\d|(?i:user|assistant|human|system|q|a|question|answer)\s*:")
_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?(?:-[a-z]+)*")


def _line(line: str) -> str | None:
    """What is left of a marked line; None for an inner heading, which does not even break the text."""
    if _HEADING.match(line) or _CODE_LINE.match(line):
        return ""
    line = _TURN.sub("", line)
    line = _CHAT.sub("", line) if _STAMP.match(line) else line
    line = _MARK.sub("", line)
    return None if _INNER_HEADING.match(line) else line.strip()


def prose(text: str | None) -> str:
    """Running text only: without code, headings, links, list, chat and turn marks; hyphenated line breaks joined."""
    if not text:
        return ""
    t = text if text.isascii() else _INVISIBLE.sub("", text)
    if "\r" in t:
        t = t.replace("\r\n", "\n")
    if "```" in t or "~~~" in t:
        t = _FENCE.sub("\n\n", t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "](" in t:
        t = _LINK.sub(r"\1", t)
    if "`" in t or "://" in t or "www." in t.lower():
        t = _URL.sub(" ", t)
    marked = _MARKED.match
    out = []
    for line in t.split("\n"):
        if not line or line.isspace():
            out.append("")
        elif marked(line):
            left = _line(line)
            if left is not None:
                out.append(left)
        else:
            out.append(line.rstrip())
    t = "\n".join(out)
    if "-\n" in t:
        t = _BREAK.sub("-", t)
    return t.replace("\n", " ")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("\u2019", "'"))


def is_english(words: list[str]) -> bool:
    """Whether function words say English; needs at least eight words. Terse text counts if no other language shows."""
    if len(words) < 8:
        return False
    yes = sum(map(_ENGLISH.__contains__, words))
    no = sum(map(_OTHERS.__contains__, words))
    return (yes >= 0.12 * len(words) and yes > 1.5 * no) or (no <= 0.01 * len(words) and yes >= 0.02 * len(words))


@dataclass
class Model:
    """Word grades and calibration; plain values, bounded by the vocabulary of FIT_DOCUMENTS graded documents."""

    grades: dict[str, float]
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def features(self, words: list[str]) -> list[float] | None:
        g = [x for x in map(self.grades.get, words) if x is not None]
        return _features(np.array(g)) if len(g) >= 8 else None

    def levels(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows) - self.centre) / self.scale
        z = np.hstack([x, np.ones((len(x), 1))]) @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _features(grades: np.ndarray) -> list[float]:
    mean = grades.mean()
    grades.sort()
    at = QUANTILES * (len(grades) - 1)
    low = at.astype(np.int64)
    below = grades[low]
    out = (below + (at - low) * (grades[np.minimum(low + 1, len(grades) - 1)] - below)).tolist()
    out.append(mean)
    return out


def word_grades(counts: np.ndarray, smooth: float = 6.0) -> np.ndarray:
    """Acquisition grades from counts per level (rows: words): mean level of the rates, drawn to the overall mean."""
    totals = counts.sum(axis=0)
    rates = counts / np.maximum(totals, 1)
    even = 1.0 / len(LEVELS)
    share = (rates / np.maximum(rates.sum(axis=1, keepdims=True), 1e-12) * counts.sum(axis=1, keepdims=True) + even * smooth) / (counts.sum(axis=1, keepdims=True) + smooth)
    return share @ np.array(LEVELS, float)


def calibrate(x: np.ndarray, targets: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Softmax regression of level shares on quantile features, by accelerated gradient descent."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w = v = np.zeros((a.shape[1], targets.shape[1]))
    step = 1.0 / (0.5 * np.linalg.eigvalsh(a.T @ a / len(a))[-1] + ridge)
    for k in range(rounds):
        z = a @ v
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        new = v - step * (a.T @ (p - targets) / len(a) + ridge * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w, centre, scale


def _kept(counts: np.ndarray, words: list[str]) -> dict[str, float]:
    rows = counts.sum(axis=1) > 0
    return dict(zip([w for w, k in zip(words, rows) if k], word_grades(counts[rows]).tolist())) if rows.any() else {}


def votes(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``target``, the share of each level among a document's votes.

    Graders are told apart by trimmed lower-case name; NULL grades, levels outside 1-4 and repeated rows do not
    count. A grader who on average lies above or below the median of the same documents has that part of each
    vote moved to the neighbouring level.
    """
    v = labels.where(F.col("reading_level").isin(*LEVELS)).select("doc_id", F.lower(F.trim(F.coalesce("grader", F.lit("")))).alias("grader"), F.col("reading_level").cast("double").alias("v")).distinct()
    middle = v.groupBy("doc_id").agg(F.median("v").alias("m"), F.count(F.lit(1)).alias("n"))
    apart = v.join(middle.where("n > 1"), "doc_id").groupBy("grader").agg(F.avg(F.col("v") - F.col("m")).alias("bias"))
    v = v.join(apart.where("abs(bias) > 0.12"), "grader", "left").withColumn("bias", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("bias", F.lit(0.0)))))
    moved = F.greatest(F.lit(1.0), F.least(F.lit(4.0), F.col("v") - F.signum("bias")))
    share = [F.avg(F.when(F.col("v") == k, 1 - F.abs("bias")).otherwise(0.0) + F.when(moved == k, F.abs("bias")).otherwise(0.0)).alias(f"t{k}") for k in LEVELS]
    return v.groupBy("doc_id").agg(*share).select("doc_id", F.array(*[f"t{k}" for k in LEVELS]).alias("target"))


def fit(documents: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Fit on at most ``fit_documents`` graded English documents and all of their words; the driver holds a row of numbers for each word.

    Documents fall into two halves; each is calibrated with word grades from the other, so that the
    calibration sees the errors it will meet. Raises ValueError when too few graded documents are left.
    """

    @F.pandas_udf("array<string>")
    def english(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            w = words_of(prose(t))
            out.append(w if is_english(w) else None)
        return pd.Series(out, dtype=object)

    graded = documents.select("doc_id", "text").join(votes(labels), "doc_id")
    graded = graded.select("doc_id", "target", english("text").alias("words")).where("words IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents).repartition(documents.sparkSession.sparkContext.defaultParallelism, "doc_id")
    graded = materialise(graded.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))), "graded")
    each = graded.select("half", "target", F.explode("words").alias("word"))
    sums = [F.sum(F.when(F.col("half") == h, F.col("target")[i]).otherwise(0.0)).alias(f"c{h}{i}") for h in (0, 1) for i in range(4)]
    table = each.groupBy("word").agg(*sums).orderBy("word").toPandas()
    words = table["word"].tolist()
    by_half = [table[[f"c{h}{i}" for i in range(4)]].to_numpy(dtype=float) for h in (0, 1)]
    none = np.zeros(0)
    # a document of half h is described with the grades of the other half
    crossed = [Model(_kept(by_half[1 - h], words), none, none, none) for h in (0, 1)]

    @F.pandas_udf("array<double>")
    def described(w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([crossed[int(i)].features(list(x)) for x, i in zip(w, h)], dtype=object)

    rows = graded.select(described("words", "half").alias("x"), "target").where("x IS NOT NULL").toPandas()
    if len(rows) < 8:
        raise ValueError("too few graded documents to calibrate on")
    weights, centre, scale = calibrate(np.vstack(rows["x"].to_numpy()), np.vstack(rows["target"].to_numpy()))
    return Model(_kept(by_half[0] + by_half[1], words), weights, centre, scale)


def assess(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``reading_level``, ``certainty`` of English documents.

    Left out are documents that are not English and those with fewer than eight known words of running
    prose, empty and NULL texts among them: they have no level.
    """
    # plain values: a broadcast is read back by name, and executors need not have this package
    shared = documents.sparkSession.sparkContext.broadcast((model.grades, model.weights, model.centre, model.scale))
    made: list[Model] = []

    @F.pandas_udf("reading_level int, certainty double")
    def levels(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Model(*shared.value))
        m = made[0]
        rows = []
        for t in texts:
            w = words_of(prose(t))
            rows.append(m.features(w) if is_english(w) else None)
        known = [i for i, r in enumerate(rows) if r is not None]
        out = pd.DataFrame({"reading_level": pd.array([None] * len(rows), dtype="Int32"), "certainty": np.full(len(rows), np.nan)})
        if known:
            p = m.levels([rows[i] for i in known])
            out.loc[known, "reading_level"] = p.argmax(axis=1) + LEVELS[0]
            out.loc[known, "certainty"] = p.max(axis=1)
        return out

    return documents.select("doc_id", levels("text").alias("l")).select("doc_id", "l.*").where("reading_level IS NOT NULL")
