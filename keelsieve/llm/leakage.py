"""Evaluation items inside training documents: latent semantic retrieval, then alignment.

Documents and items are cut into overlapping passages of words and weighted by TF-IDF (document
frequencies over the whole corpus, words hashed to a fixed number of features). A
randomised singular value decomposition, run as sums over partitions, gives the latent
space; every passage of every document is projected and compared with the item passages
by cosine. Candidates are aligned word by word: a long common run seeds the alignment,
which is extended both ways with the fewest changed, dropped or added words (the longest
common subsequence under a limit on edits). A candidate without such a run whose words still follow
the item's for the most part (longest common subsequence) is reported as a paraphrase. Sentences
that several items share are no item's own.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from keelsieve.shared import materialise

FEATURES = 1 << 14
RANK, OVERSAMPLE, POWER = 128, 16, 2
#: Passages of documents that the latent space is fitted on at most, those of the least hash among all; as many of the items'.
FIT_PASSAGES = 20_000
#: Words of a block; passages of documents and items are runs of blocks.
UNIT = 8
PASSAGE, STRIDE = 40, 16
ITEM_PASSAGE, ITEM_STRIDE = 24, 8
#: Least cosine (in the latent space, over full norms) of a candidate.
CANDIDATE = 0.3
#: A leak: so many words of an item in a row, with at most one in EDIT_EVERY changed, dropped or added.
LEAST_WORDS, EDIT_EVERY = 24, 10
#: Words of a common run that seeds an alignment: 24 words with 2 edits always hold a run of 8, no allowed leak less than 7.
SEED = 6
#: A paraphrase: least part of the item's words that a stretch three times as long around the most similar passage holds in order.
PARAPHRASE_WORDS = 0.6
#: Item passages compared at a time, words of documents worked on at a time.
BLOCK, CHUNK_WORDS = 4096, 16_384
#: Items that go to the tasks together; more are taken in several parts.
PART_ITEMS = 20_000

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_TAG = re.compile(r"(?s)<!--.*?-->|</?[A-Za-z][^<>]{0,300}>")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_LINE_MARK = re.compile(r"(?m)^[ \t>]*(?:\[\d{1,2}:\d{2}(?::\d{2})?\][ \t]*(?:<?@?[\w.\-]{1,24}>?:)?|(?:user|assistant|human|system)[ \t]*:|<\|\w+\|>|[-*+•|]|\d{1,3}[.)]|#{1,6})?[ \t]*", re.I)


class _Words(dict):
    """Letters and digits as they are, apostrophes left out, anything else a blank."""

    def __missing__(self, c: int) -> int | None:
        self[c] = got = c if chr(c).isalnum() else None if chr(c) in "'\u2019" else 32
        return got


_WORDS = _Words()
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words without markup, layout, punctuation and invisible characters."""
    if not text:
        return []
    t = html.unescape(text) if "&" in text else text
    if not t.isascii():
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", t))
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "](" in t:
        t = _LINK.sub(r"\1", t)
    t = _LINE_MARK.sub(" ", t)
    return t.lower().translate(_WORDS).split()


class Hashes(dict):
    """32-bit hashes of words, kept for half a million of them: what features and alignments are made of. Two words fall together once in four thousand million pairs."""

    def __missing__(self, w: str) -> int:
        got = zlib.crc32(w.encode())
        if len(self) < 500_000:
            self[w] = got
        return got


def hashed(words: list[str], known: Hashes) -> np.ndarray:
    return np.array([known[w] for w in words], dtype=np.uint32).view(np.int32)


def _features(words: np.ndarray) -> np.ndarray:
    return words.astype(np.int64) & (FEATURES - 1)


def tokenised(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and ``words``, the hashed words of each text; NULL and empty texts have none."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        known = Hashes()
        return pd.Series([hashed(words_of(t), known) for t in texts], dtype=object)

    return df.select(key, run(text).alias("words"))


def own_words(items: DataFrame) -> DataFrame:
    """``item_id`` and ``words`` of each item without sentences that another item has as well."""

    @F.pandas_udf("array<array<int>>")
    def split(texts: pd.Series) -> pd.Series:
        known = Hashes()
        return pd.Series([[hashed(words_of(s), known) for s in _SENTENCE.split(t or "")] for t in texts], dtype=object)

    rows = materialise(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().select("item_id", F.xxhash64("text").alias("row"), split("text").alias("s")), "item-sentences")
    rows = rows.select("item_id", "row", F.posexplode("s").alias("pos", "words")).withColumn("h", F.md5(F.array_join("words", ",")))
    single = rows.groupBy("h").agg((F.min("item_id") == F.max("item_id")).alias("one")).where("one").select("h")
    kept = rows.join(single, "h").groupBy("item_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("s"))  # the sentences of one item
    return kept.select("item_id", F.flatten(F.col("s.words")).alias("words")).where(F.size("words") >= LEAST_WORDS)


# --- statistics and latent space


def document_frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and how many documents there are, over all of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(FEATURES, dtype=np.int64)
        n = 0
        for b in batches:
            n += len(b)
            for w in b["words"]:
                df[np.unique(_features(w))] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"f": np.append(at, -1), "n": np.append(df[at], n)})

    got = words.select("words").mapInPandas(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # FEATURES + 1 rows at most
    df = np.zeros(FEATURES, dtype=np.int64)
    whole = got[got["f"] >= 0]
    df[whole["f"].to_numpy()] = whole["n"].to_numpy()
    n = got.loc[got["f"] < 0, "n"]
    return df, int(n.iloc[0]) if len(n) else 0


def _sum_over(passages: DataFrame, basis: np.ndarray, idf: np.ndarray, gram: bool) -> np.ndarray:
    """A'(A basis), or the Gram matrix (A basis)'(A basis), summed over partitions of TF-IDF passages A."""
    spark = passages.sparkSession
    shared = spark.sparkContext.broadcast((basis.astype(np.float32), idf))
    rows_out = basis.shape[1] if gram else FEATURES
    block = 512

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, weight = shared.value
        total = np.zeros((rows_out, b.shape[1]))
        for batch in batches:
            for words, scale in zip(batch["words"], batch["scale"]):
                f, tf = np.unique(_features(np.asarray(words, dtype=np.int32)), return_counts=True)
                x = tf * weight[f]
                norm = np.sqrt((x * x).sum())
                if not norm:
                    continue
                x = x * (scale / norm)
                y = x @ b[f]
                if gram:
                    total += np.outer(y, y)
                else:
                    total[f] += np.outer(x, y)
        parts = [(i, total[i : i + block].ravel()) for i in range(0, rows_out, block)]
        yield pd.DataFrame({"part": [p[0] for p in parts], "v": [p[1] for p in parts]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "v": [np.sum(np.vstack(pdf["v"].to_numpy()), axis=0)]})

    schema = "part long, v array<double>"
    got = passages.mapInPandas(partial, schema).groupBy("part").applyInPandas(add, schema).toPandas().sort_values("part")
    shared.unpersist()
    return np.concatenate(got["v"].to_numpy()).reshape(rows_out, basis.shape[1])


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors (features x rank) of the passages, by a randomised range finder."""
    basis = np.random.RandomState(seed).standard_normal((FEATURES, rank + OVERSAMPLE))
    for _ in range(POWER):
        basis, _ = np.linalg.qr(_sum_over(passages, basis, idf, gram=False))
    values, vectors = np.linalg.eigh(_sum_over(passages, basis, idf, gram=True))
    return (basis @ vectors[:, np.argsort(values)[::-1][:rank]]).astype(np.float32)


# --- alignment


def _extend(a: list[str], b: list[str], most: int) -> list[int]:
    """Fewest edits with which the first n words of ``a`` align to some beginning of ``b``, n = 0, 1, ... while at most ``most``."""
    prev = list(range(min(len(b), most) + 1))
    best = [0]
    lo = 0
    for i in range(1, len(a) + 1):
        top = min(len(b), i + most)
        row: dict[int, int] = {}
        start = max(0, i - most)
        for j in range(start, top + 1):
            v = prev[j - lo] + 1 if lo <= j < lo + len(prev) else most + 1
            if j and lo <= j - 1 < lo + len(prev):
                v = min(v, prev[j - 1 - lo] + (a[i - 1] != b[j - 1]))
            if j - 1 in row:
                v = min(v, row[j - 1] + 1)
            row[j] = v
        if not row:
            break
        prev, lo = [row[j] for j in range(start, top + 1)], start
        least = min(prev)
        if least > most:
            break
        best.append(least)
    return best


_GRAM = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SEED)], dtype=np.uint64)


def _grams(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - SEED + 1)
    w = words.view(np.uint32).astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SEED):
        out += w[k : k + n] * _GRAM[k]
    return out ^ (out >> np.uint64(32))


class Item:
    """An item made ready for alignment: its words and where each run of SEED words stands."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, grams = words, _grams(words)
        self.at: dict[int, list[int]] = {}
        for i, g in enumerate(grams.tolist()):
            self.at.setdefault(g, []).append(i)
        self.grams = np.unique(grams)


def leaked_words(item: Item, doc: np.ndarray, grams: np.ndarray, least: int = LEAST_WORDS, every: int = EDIT_EVERY) -> int:
    """Longest stretch of the item's words that the document holds with at most one edit in ``every`` words; 0 if below ``least``."""
    size_of = len(item.words)
    if size_of < least or len(doc) < least - least // every:
        return 0
    near = np.minimum(np.searchsorted(item.grams, grams), len(item.grams) - 1)
    hits = np.flatnonzero(item.grams[near] == grams)
    if not len(hits):
        return 0
    runs: list[tuple[int, int, int]] = []
    open_runs: dict[int, int] = {}  # diagonal -> index of its last run
    for j in hits.tolist():
        for i in item.at[int(grams[j])]:
            k = open_runs.get(j - i)
            if k is not None and runs[k][1] + runs[k][2] - SEED + 1 == j:
                runs[k] = (runs[k][0], runs[k][1], runs[k][2] + 1)
            else:
                open_runs[j - i] = len(runs)
                runs.append((i, j, SEED))
    words = item.words.tolist()
    most = size_of // every
    best = 0
    for i, j, n in runs:
        if best == size_of:
            break
        right = _extend(words[i + n :], doc[j + n : j + n + size_of + most].tolist(), most)
        left = _extend(words[:i][::-1], doc[max(0, j - i - most) : j].tolist()[::-1], most)
        for x in range(len(left)):
            for y in range(len(right) - 1, -1, -1):
                size = x + n + y
                if size <= best or size < least:
                    break
                if (left[x] + right[y]) * every <= size:
                    best = size
                    break
    return best


def common_words(item: np.ndarray, doc: np.ndarray) -> int:
    """Length of the longest common subsequence of words, a bit per word of the item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | (1 << i)
    every = (1 << len(item)) - 1
    v = every
    for w in doc.tolist():
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & every
    return len(item) - v.bit_count()


# --- search


def _blocks(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts laid end to end, a row per block of UNIT words, padded with FEATURES; and how many blocks each text has."""
    counts = (lengths + UNIT - 1) // UNIT
    out = np.full(counts.sum() * UNIT, FEATURES, dtype=np.int64)
    shift = np.cumsum(counts * UNIT - lengths) - (counts * UNIT - lengths)  # padding before each text
    out[np.arange(len(words)) + np.repeat(shift, lengths)] = _features(words)
    return out.reshape(-1, UNIT), counts


def passages(words: np.ndarray, lengths: np.ndarray, space: np.ndarray, weight: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors, over their full norms, of the overlapping passages of non-empty texts laid end to end; the text and the first word (in it) of each.

    ``space`` and ``weight`` have a last row of nothing, for padding. A word given twice in a passage counts twice towards the vector, and as two words towards the norm."""
    f, counts = _blocks(words, lengths)
    blocks = space[f[:, 0]]
    for k in range(1, UNIT):
        blocks += space[f[:, k]]
    squares = (weight[f] ** 2).sum(axis=1)
    per, step = size // UNIT, stride // UNIT
    number = np.maximum(1, -(-(counts - per) // step) + 1)
    text = np.repeat(np.arange(len(lengths)), number)
    begin = (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)) * step
    first = begin + np.repeat(np.cumsum(counts) - counts, number)
    end = np.repeat(np.cumsum(counts), number)
    blocks = np.vstack([blocks, np.zeros((1, blocks.shape[1]), dtype=blocks.dtype)])
    squares = np.append(squares, 0.0)
    vectors, norms = np.zeros((len(first), blocks.shape[1]), dtype=np.float32), np.zeros(len(first))
    for k in range(per):
        at = np.where(first + k < end, first + k, len(blocks) - 1)
        vectors += blocks[at]
        norms += squares[at]
    return vectors / np.sqrt(np.maximum(norms, 1e-12))[:, None].astype(np.float32), text, begin * UNIT


def _chunks(words: pd.Series) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK_WORDS words; a longer text goes alone."""
    start = total = 0
    for i, w in enumerate(words):
        if i > start and total + len(w) > CHUNK_WORDS:
            yield start, i
            start, total = i, 0
        total += len(w)
    if start < len(words):
        yield start, len(words)


def find_leaks(documents: DataFrame, items: DataFrame, candidate: float = CANDIDATE, fit_passages: int = FIT_PASSAGES) -> DataFrame:
    """``item_id``, ``doc_id``, ``kind``, ``cosine``, ``words`` and ``answered`` of every document that holds an item.

    ``kind`` is ``quote`` (``words``: the longest leaked stretch) or ``paraphrase`` (``words``: those held in order). ``answered``
    tells whether the document also has all words of the item's ``answer``, if items have such a column; else it is NULL. The
    items are the stated query set: they go to every task in parts of PART_ITEMS and are compared in blocks, against all
    documents. Items without enough words of their own, and NULL or empty texts, leak nowhere. Repeated documents are each
    reported; a doc_id given twice with one text appears once per row.
    """
    spark = documents.sparkSession
    schema = "item_id long, doc_id long, kind string, cosine double, words int, answered boolean"
    own = materialise(own_words(items), "item-words")
    number = own.count()
    if not number:
        return spark.createDataFrame([], schema)
    texts = materialise(tokenised(documents, "doc_id"), "doc-words")
    df, n = document_frequencies(texts)
    idf = np.log((n + 1) / (df + 0.5)).clip(min=0.05)
    space = latent_space(_fit_passages(texts, own, fit_passages), idf)
    parts = -(-number // PART_ITEMS)
    answers = items.select("item_id", "answer").where("answer IS NOT NULL") if "answer" in items.columns else None
    out = None
    for part in range(parts):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part
        wanted = [(r["item_id"], np.array(r["words"], dtype=np.int32)) for r in own.where(mine).collect()]  # PART_ITEMS or so
        said = {r["item_id"]: np.unique(np.array(r["words"], dtype=np.int32)) for r in tokenised(answers, "item_id", "answer").where(mine).collect()} if answers is not None else {}
        found = _search(texts, wanted, said, space, idf, candidate, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _search(texts: DataFrame, wanted: list, said: dict, space: np.ndarray, idf: np.ndarray, candidate: float, schema: str) -> DataFrame:
    weighted = np.vstack([space * idf[:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
    weight = np.append(idf, 0.0)
    lengths = np.array([len(w) for _, w in wanted])
    shared = texts.sparkSession.sparkContext.broadcast((weighted, weight, [i for i, _ in wanted], np.concatenate([w for _, w in wanted]) if wanted else np.zeros(0, np.int32), lengths, said))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        latent, weight, names, flat, sizes, answers = shared.value
        if not len(names):
            return
        q, owner, _ = passages(flat, sizes, latent, weight, ITEM_PASSAGE, ITEM_STRIDE)
        cuts = np.cumsum(sizes)[:-1]
        items = [Item(w) for w in np.split(flat, cuts)]
        shortest = LEAST_WORDS - LEAST_WORDS // EDIT_EVERY
        for batch in batches:
            out = []
            ids = batch["doc_id"].to_numpy()
            words = [np.asarray(w, dtype=np.int32) for w in batch["words"]]
            for lo, hi in _chunks(words):
                docs = [k for k in range(lo, hi) if len(words[k]) >= shortest]
                if not docs:
                    continue
                p, text, begin = passages(np.concatenate([words[k] for k in docs]), np.array([len(words[k]) for k in docs]), latent, weight, PASSAGE, STRIDE)
                able = np.flatnonzero(np.einsum("ij,ij->i", p, p) >= candidate * candidate)  # no other cosine can reach it
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for at in range(0, len(able), 1024):
                    some = able[at : at + 1024]
                    for b in range(0, len(q), BLOCK):
                        cos = p[some] @ q[b : b + BLOCK].T
                        i, j = np.divmod(np.flatnonzero((cos >= candidate).ravel()), cos.shape[1])
                        for x, y, c in zip(some[i].tolist(), owner[b + j].tolist(), cos[i, j].tolist()):
                            key = (int(text[x]), y)
                            if c > best.get(key, (0.0, 0))[0]:
                                best[key] = (c, int(begin[x]))
                grams: dict[int, np.ndarray] = {}
                for (d, y), (c, start) in best.items():
                    doc, item = words[docs[d]], items[y]
                    if d not in grams:
                        grams[d] = _grams(doc)
                    size, kind = leaked_words(item, doc, grams[d]), "quote"
                    if not size:
                        n = len(item.words)
                        size, kind = common_words(item.words, doc[max(0, start + PASSAGE // 2 - 3 * n // 2) : start + PASSAGE // 2 + 3 * n // 2]), "paraphrase"
                        size = size if size >= max(LEAST_WORDS, PARAPHRASE_WORDS * n) else 0
                    if size:
                        answer = answers.get(names[y])
                        out.append((names[y], ids[docs[d]], kind, c, size, None if answer is None else bool(np.isin(answer, doc).all())))
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "kind", "cosine", "words", "answered"])

    return texts.mapInPandas(search, schema)


def _fit_passages(texts: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """Passages to fit the latent space on: at most ``most`` of all documents' and as many of the items', those of the least hash.

    Item passages carry half of the weight, so that the space keeps what tells items apart."""

    def cut(df: DataFrame, key: str, size: int, stride: int) -> DataFrame:
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(stride))
        rows = df.where(F.size("words") > 0).select(key, F.explode(F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("words", s + 1, F.lit(size)).alias("words")))).alias("x")).select(key, "x.*")
        return rows.orderBy(F.xxhash64(key, "s"), key, "s").limit(most).select("words")

    spark = texts.sparkSession
    sample = materialise(cut(texts, "doc_id", PASSAGE, PASSAGE), "fit-passages")
    mine = materialise(cut(own, "item_id", ITEM_PASSAGE, ITEM_STRIDE), "fit-items")
    scale = float(np.sqrt(max(1, sample.count()) / max(1, mine.count())))
    rows = sample.withColumn("scale", F.lit(1.0)).unionByName(mine.withColumn("scale", F.lit(scale)))
    return materialise(rows.repartition(spark.sparkContext.defaultParallelism), "fit-rows")
