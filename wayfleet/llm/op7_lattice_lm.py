"""Language-model score of a text by the subword lattice of an existing vocabulary.

A word, behind the vocabulary's word mark, may be spelled by many rows of pieces. A unigram model over
pieces gives the word the sum over all of them, found by a forward recursion in log space. A text's
probability is the product over its words and one end. Pieces start with weights from the vocabulary's
own scores (1 / (1 + rank)), which stay as their prior (`SMOOTH` a piece on average), and are re-weighted on the
training words by `rounds` of expectation
maximisation: tasks give expected piece counts of their distinct words, Spark sums them, and only one
number per piece reaches the driver. A character without a piece is spelled by its bytes.

A training word with `OWN` occurrences or more has one more arc in its lattice, itself. A token takes such
an arc or is spelled: the model holds the share of spelled tokens, and pieces share out only what is
spelled. The arc's weight q is what maximisation converges to at given pieces, q = max(0, c / N - a) beside the
probability a of being spelled; the word's probability is the log-space sum of both arcs. All words' arcs and the
spelled share are scaled to add up to the words' share of the tokens, the rest being the end's: the model is a
distribution (of at most one, as pieces also spell words that don't occur). Rarer words are always
spelled, by which the model learns how much to keep for new words.

Counts of distinct words come from all training documents. A word that makes up `FREQUENT` of all
tokens or more is broadcast (1 / FREQUENT of them at most, as shares add up to 1); all others meet
their documents in a join on the word. No word is left out either way.

The word unigram with add-one counts is reported beside it as base_score.

Defined results: a null text is empty (the end alone); repeated rows count and are scored as often;
a null doc_id counts as empty text in the split; other columns are left behind; without training
documents pieces keep their first weights, all words are spelled and the end has weight 1/2; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import coded, crc_mod, settle, slices, texts, words

FREQUENT, ROUNDS, SMOOTH, OWN = 2e-6, 4, 0.1, 2
MARK = "▁"
#: Longer words go through the recursions one by one.
LONG = 48


def vocabulary() -> str:
    """The public subword vocabulary; its path is a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_FACTOR = 0x9E3779B97F4A7C15


def piece_key(piece: str) -> int:
    """A 64-bit hash of a piece, grown by one character at a time."""
    h = 0
    for c in piece:
        h = ((h + ord(c) + 1) * _FACTOR) & (2**64 - 1)
    return h


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


class Lattice:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = ahocorasick.Automaton()
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.single: set[str] = set()
        scores = np.array([model.get_score(i) for i in range(self.size)])
        weight = 1 / (1 - np.minimum(scores, 0))
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                weight[i] = weight.min()
                continue
            self.pieces.add_word(piece, (i, len(piece)))
            if len(piece) == 1:
                self.single.add(piece)
        self.pieces.make_automaton()
        keys = sorted((piece_key(p), i) for p, (i, _) in self.pieces.items())
        self.keys, self.key_ids = np.array([k for k, _ in keys], dtype=np.uint64), np.array([i for _, i in keys])
        self.longest = max(n for _, (_, n) in self.pieces.items())
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[self.keys >> np.uint64(42)] = True
        self.first = np.log(weight / weight.sum())

    def found(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these keys, -1 where there is none."""
        out = np.full(keys.shape, -1, dtype=np.int64)
        at = np.nonzero(self.sieve[keys >> np.uint64(42)])
        own = keys[at]
        place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        out[at] = np.where(self.keys[place] == own, self.key_ids[place], -1)
        return out

    def batch(self, words: list[str], times: np.ndarray | None, logp: np.ndarray, spelled: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
        """Words of any length: their log probabilities, and with times the expected counts of pieces and of spelled words."""
        total, counts, now = np.zeros(len(words)), np.zeros(self.size), 0.0
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(size, kind="stable")
        own = logp.tolist()
        long = order[size[order] > LONG]
        for i in long:
            total[i] = self.forward(self.arcs(words[i]), own)[-1]
            if times is not None:
                now += self.expected(words[i], times[i], own, spelled, counts)
        short = order[size[order] <= LONG]
        for at in range(0, len(short), 4000):
            pick = short[at : at + 4000]
            now += self._together([words[i] for i in pick], size[pick] + 1, None if times is None else times[pick], logp, spelled, total, pick, counts)
        return total, counts, now

    def _together(self, words: list[str], size: np.ndarray, times: np.ndarray | None, logp: np.ndarray, spelled: float, total: np.ndarray, pick: np.ndarray, counts: np.ndarray) -> float:
        """The same recursions over many words at a time, position by position."""
        n, width = len(words), int(size.max())
        flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = np.arange(width) < size[:, None]
        text = np.zeros((n, width), dtype=np.uint64)
        text[inside] = flat
        ids, lp = [], []
        key = np.zeros((n, width), dtype=np.uint64)
        with np.errstate(divide="ignore"):
            for m in range(1, min(self.longest, width) + 1):
                key = (key[:, : width - m + 1] + text[:, m - 1 :] + np.uint64(1)) * np.uint64(_FACTOR)
                got = self.found(key)
                got[~inside[:, m - 1 :]] = -1
                ids.append(got)
                lp.append(np.where(got >= 0, logp[got], -np.inf))
        bare = inside & (ids[0] < 0)
        by_bytes = {c: [self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in np.unique(text[bare]).astype(int).tolist()}
        for c, b in by_bytes.items():
            lp[0][bare & (text == c)] = logp[b].sum()
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, width + 1):
            ways = np.stack([alpha[:, end - m] + lp[m - 1][:, end - m] for m in range(1, min(len(lp), end) + 1)])
            top = np.maximum(ways.max(0), -1e300)
            with np.errstate(divide="ignore"):
                alpha[:, end] = top + np.log(np.exp(ways - top).sum(0))
        whole = alpha[np.arange(n), size]
        total[pick] = whole
        if times is None:
            return 0.0
        times = np.where(times >= OWN, times * np.exp(np.minimum(0, whole + np.log(spelled / np.maximum(times, 1)))), times)
        beta = np.full((n, width + 1), -np.inf)
        beta[np.arange(n), size] = 0
        taken, share = [], []
        with np.errstate(invalid="ignore"):
            for end in range(width, 0, -1):
                for m in range(1, min(len(lp), end) + 1):
                    own = lp[m - 1][:, end - m] + beta[:, end]
                    live = np.flatnonzero(own > -np.inf)
                    if not len(live):
                        continue
                    got = times[live] * np.exp(alpha[live, end - m] + own[live] - whole[live])
                    one = ids[m - 1][live, end - m]
                    taken.append(one[one >= 0])
                    share.append(got[one >= 0])
                    for c in np.unique(text[live[one < 0], end - 1]).astype(int).tolist() if m == 1 else ():
                        np.add.at(counts, by_bytes[c], got[(one < 0) & (text[live, end - 1] == c)].sum())
                    beta[live, end - m] = np.logaddexp(beta[live, end - m], own[live])
        counts += np.bincount(np.concatenate(taken), np.concatenate(share), minlength=self.size)
        return float(times.sum())

    def arcs(self, word: str) -> list[list[tuple[int, tuple[int, ...]]]]:
        """At each end in the marked word: where its pieces start, and their ids."""
        s = MARK + word
        out: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(len(s) + 1)]
        for end, (i, n) in self.pieces.iter(s):
            out[end + 1].append((end + 1 - n, (i,)))
        for at, c in enumerate(s):
            if c not in self.single:
                out[at + 1].append((at, tuple(self.byte[b] for b in c.encode("utf-8", "surrogatepass"))))
        return out

    def forward(self, arcs: list, logp: list[float]) -> list[float]:
        """Log probability of all spellings of each prefix."""
        alpha = [0.0]
        for ways in arcs[1:]:
            got = [alpha[a] + (logp[ids[0]] if len(ids) == 1 else sum(logp[i] for i in ids)) for a, ids in ways]
            top = max(got)
            alpha.append(top if len(got) == 1 else top + math.log(sum(math.exp(x - top) for x in got)))
        return alpha

    def expected(self, word: str, times: float, logp: list[float], spelled: float, into: np.ndarray) -> float:
        """Adds the expected counts of pieces in so many of the word; how many of these are spelled. spelled: that number over all words."""
        arcs = self.arcs(word)
        alpha = self.forward(arcs, logp)
        times = times * math.exp(min(0.0, alpha[-1] + math.log(spelled / times))) if times >= OWN else times
        beta = [-math.inf] * len(alpha)
        beta[-1] = 0.0
        for end in range(len(alpha) - 1, 0, -1):
            if beta[end] == -math.inf:
                continue
            for a, ids in arcs[end]:
                own = sum(logp[i] for i in ids) + beta[end]
                share = times * math.exp(alpha[a] + own - alpha[-1])
                for i in ids:
                    into[i] += share
                x, y = (own, beta[a]) if own > beta[a] else (beta[a], own)
                beta[a] = x if y == -math.inf else x + math.log1p(math.exp(y - x))
        return times


def word_counts(docs: DataFrame, train: str) -> DataFrame:
    """(word, n, n_train): how often each lower-cased word comes in all texts, and where the train column is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat, starts = words(texts(b, lower=True))
            code, distinct = coded(flat)
            own = np.repeat(b.column("train").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(starts))
            n = np.bincount(code, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(n), pa.array(np.bincount(code, own, minlength=len(distinct)).astype(np.int64))], names=["word", "n", "n_train"])

    rows = docs.select("text", F.col(train).alias("train")).mapInArrow(run, "word string, n long, n_train long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def fitted(counts: DataFrame, tokens: int, path: str, rounds: int) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces after so many rounds on the training words, and how many of the tokens are spelled."""
    logp, spelled = lattice(path).first, max(1.0, tokens / 2)
    prior = SMOOTH * len(logp) * np.exp(logp)
    for _ in range(rounds):
        held = counts.sparkSession.sparkContext.broadcast((logp, spelled))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model, (own, before) = lattice(path), held.value
            n, now = np.zeros(model.size), 0.0
            for b in batches:
                _, more, spelled = model.batch(b.column("word").to_pylist(), b.column("n_train").to_numpy(zero_copy_only=False).astype(np.float64), own, before)
                n, now = n + more, now + spelled
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], now))], names=["piece", "n"])

        got = counts.where("n_train > 0").select("word", "n_train").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = prior.copy()
        for r in got:
            if r["piece"] < 0:
                spelled = max(1.0, r["n"])
            else:
                n[r["piece"]] += r["n"]
        logp = np.log(n / n.sum())
    return logp, spelled


def scored_words(counts: DataFrame, logp: np.ndarray, spelled: float, seen: int, tokens: int, path: str) -> DataFrame:
    """counts with lp, the natural logarithm of each word's probability; seen: how many of the tokens are words."""
    held = counts.sparkSession.sparkContext.broadcast(logp)
    tokens = max(tokens, 1)
    share = math.log(max(spelled, 1.0) / max(tokens, spelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for b in batches:
            lp = model.batch(b.column("word").to_pylist(), None, held.value)[0] + share
            n = b.column("n_train").to_numpy(zero_copy_only=False)
            own = np.where(n >= OWN, np.maximum(0.0, n / tokens - np.exp(lp)), 0.0)
            with np.errstate(divide="ignore"):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(np.logaddexp(np.log(own), lp))], names=["word", "n", "n_train", "own", "lp"])

    rows = settle(counts.mapInArrow(run, "word string, n long, n_train long, own double, lp double"))
    own = rows.agg(F.coalesce(F.sum("own"), F.lit(0.0))).first()[0]
    words = seen / tokens if seen else 0.5
    return rows.select("word", "n", "n_train", (F.col("lp") + math.log(words / (own + math.exp(share)))).alias("lp"))


def lm_scores(docs: DataFrame, path: str, held_out: str, rounds: int = ROUNDS, frequent: float = FREQUENT) -> DataFrame:
    """docs (doc_id, text, and the boolean column held_out) -> one row per document with both scores, base 10."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(held_out).alias("held_out"), (~F.col(held_out)).alias("train"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = settle(word_counts(docs, "train").repartition(parts, "word"))  # lattices take CPU, so few bytes are still many tasks
    all_docs, train_docs = docs.agg(F.count("*"), F.count_if("train")).first()
    every, seen, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    tokens, kinds = seen + train_docs, kinds + (train_docs > 0)
    logp, spelled = fitted(counts, seen, path, rounds)
    table = scored_words(counts, logp, spelled, seen, tokens, path)
    often = F.col("n") >= frequent * max(1, every)
    top = table.where(often).toArrow()
    sc = docs.sparkSession.sparkContext
    below = math.log10(tokens + kinds + 1)
    shared = sc.broadcast((dict(zip(top["word"].to_pylist(), range(len(top)), strict=True)), top["n_train"].to_numpy().astype(np.float64), top["lp"].to_numpy()))
    end_base, end_known, end_score = math.log10(train_docs + 1) - below, int(train_docs > 0), math.log10(train_docs / tokens if train_docs else 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n_train, lp = shared.value
        n_train, base = np.append(n_train, 0.0), np.append(np.log10(n_train + 1) - below, 0.0)
        lp = np.append(lp / math.log(10), 0.0)
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            flat, starts = words(texts(b, lower=True))
            code, distinct = coded(flat)
            own = np.fromiter((number.get(w, -1) for w in distinct.to_numpy(zero_copy_only=False)), dtype=np.int64, count=len(distinct))
            at = own[code] if len(code) else code
            doc = np.repeat(np.arange(b.num_rows), np.diff(starts))
            add = lambda v, doc=doc, b=b: np.bincount(doc, v, minlength=b.num_rows)
            rows = row + np.arange(b.num_rows)
            rest, times = np.unique((doc * max(1, len(distinct)) + code)[at < 0], return_counts=True)
            more = rest // max(1, len(distinct))
            n = len(rest)
            whole = lambda v, n=n: pa.array(np.concatenate([v, np.zeros(n, dtype=v.dtype)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, rows[more]])),
                    b.column("doc_id").take(pa.array(np.concatenate([np.arange(b.num_rows), more]))),
                    b.column("held_out").take(pa.array(np.concatenate([np.arange(b.num_rows), more]))),
                    pa.concat_arrays([pa.array([f" {r}" for r in rows], pa.string()), distinct.take(pa.array(rest % max(1, len(distinct)))).cast(pa.string())]),
                    pa.array(np.concatenate([np.zeros(b.num_rows, dtype=np.int64), times])),
                    whole(np.diff(starts) + 1),
                    whole(add(n_train[at] > 0).astype(np.int64) + end_known),
                    whole(add(base[at]) + end_base),
                    whole(add(lp[at]) + end_score),
                ],
                names=["row", "doc_id", "held_out", "word", "times", "tokens", "known", "base", "score"],
            )
            row += b.num_rows

    parts = docs.select("doc_id", "text", "held_out").mapInArrow(run, "row long, doc_id long, held_out boolean, word string, times long, tokens long, known long, base double, score double")
    met = parts.join(table.where(~often).select("word", "n_train", "lp"), "word", "left")
    times = F.col("times")
    return (
        met.groupBy("row", "doc_id", "held_out")
        .agg(
            F.sum("tokens").alias("n_tokens"),
            F.sum(F.col("known") + F.when(F.col("n_train") > 0, times).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + times * F.coalesce(F.log10(F.col("n_train") + 1) - below, F.lit(0.0))).alias("base_score"),
            F.sum(F.col("score") + times * F.coalesce(F.col("lp") / math.log(10), F.lit(0.0))).alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )


def split(docs: DataFrame) -> DataFrame:
    """docs with held_out: crc32 of the doc_id as text, modulo 7, is 2."""
    return docs.select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
