"""Operator 2: language ID by segmentation-marginalised unigrams.

A fixed public vocabulary (the pieces of a sentencepiece model) is the event
space of one unigram model per language.  A word's probability under a
language is the sum over *all* its segmentations into pieces of the product of
the pieces' probabilities, computed by the forward algorithm

    alpha[0] = 1,  alpha[j] = sum over pieces w[i:j] of alpha[i] * p(w[i:j]).

Pieces do not cross white space (the vocabulary marks word starts instead), so
the log-probability of a text is the sum over its words, and its segmentations
are marginalised in full.  All words of a batch step through the trie and the
lattice together; languages are one axis of the arrays.

Piece probabilities are fitted by expectation maximisation on a bounded sample
of labelled rows (``docs_per_language``): expected piece counts over all
segmentations, from forward and backward sums.  Every byte is a piece too, so
every word has a segmentation.  Words of any length are counted, those over
``WINDOW`` bytes by windows that each see ``CONTEXT`` bytes more on both sides.

Cases: null text, or text without a letter: ``und`` with score 0; several
equally likely languages: the first in alphabetical order; no labelled row at
all: ``und`` for all rows.  Rows are kept as they are, repeated ones too.  A
table of very many label values has a model for each: they are fitted and read
in blocks of about ``LANGUAGES``, and a text's best language and posterior are
taken over all blocks.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.llm.components import checkpoint_folder
from quillscope.llm.pieces import held, text_slices
from quillscope.llm.sampling import held_out_bucket, per_class_sample

UNDETERMINED = "und"
MARK = "▁".encode()
DOCS_PER_LANGUAGE = 500
EM_ROUNDS = 3
SMOOTHING = 0.05
MAX_CACHED_WORDS = 400_000
MAX_CACHED_NUMBERS = 8_000_000
MAX_CACHED_BYTES = 32 << 20
#: Languages of a block: a worker holds one block's probabilities at a time.
LANGUAGES = 256
#: White space of str.split, so that words are the same in fitting and in scoring.
SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SLICE = 5_000
LONGEST_TOGETHER = 64
LATTICE = 320_000  # words x positions of a batch in fitting
WINDOW, CONTEXT = 4096, 256
SHORT = 28  # probabilities are over 1e-9, so products of so many over 1e-252
LETTER = regex.compile(r"\p{L}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTrie:
    """Pieces of a sentencepiece vocabulary as a byte trie; node 0 is the root."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                pieces.add(model.id_to_piece(i).encode())
        child: dict[int, int] = {}
        piece_at = [-1]
        for k, piece in enumerate(sorted(pieces)):
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in child:
                    child[key] = len(piece_at)
                    piece_at.append(-1)
                node = child[key]
            piece_at[node] = k
        self.pieces = len(pieces)
        self.piece_at = np.array(piece_at)
        self.longest = max(map(len, pieces))
        # A row for every node that has children, and a row of zeros, the last, for all others.
        keys = np.fromiter(child, np.int64, len(child))
        inner = np.unique(keys >> 8)
        self.row = np.full(len(piece_at), len(inner), np.int32)
        self.row[inner] = np.arange(len(inner))
        self.child = np.zeros((len(inner) + 1, 256), np.int32)
        self.child[self.row[keys >> 8], keys & 255] = np.fromiter(child.values(), np.int64, len(child))

    def step(self, node, byte):
        """The child nodes; 0 where there is none."""
        return self.child[self.row[node], byte]

    def arcs(self, words: list[bytes]) -> list[list[tuple[np.ndarray, int, np.ndarray]]]:
        """Per end position j, (word numbers, start i, pieces) of all occurrences of pieces."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(length.max(initial=0))
        chars = np.zeros((len(words), longest), np.uint8)
        chars[np.arange(longest) < length[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ends: list[list] = [[] for _ in range(longest + 1)]
        for i in range(longest):
            which = np.flatnonzero(length > i)
            node = np.zeros(len(which), np.int64)
            for j in range(i, min(longest, i + self.longest)):
                node = self.step(node, chars[which, j])
                alive = (node > 0) & (length[which] > j)
                which, node = which[alive], node[alive]
                if not len(which):
                    break
                piece = self.piece_at[node]
                here = piece >= 0
                if here.any():
                    ends[j + 1].append((which[here], i, piece[here]))
        return ends


def trie(path: str) -> PieceTrie:
    return held(("pieces of", path), lambda: PieceTrie(path))


def forward(arcs: list, n: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha (positions x words x languages), scaled, and its log scale (positions x words)."""
    alpha = np.zeros((len(arcs), n, p.shape[1]))
    scale = np.zeros((len(arcs), n))
    alpha[0] = 1
    for j in range(1, len(arcs)):
        live = np.zeros(n, bool)
        for which, _, _ in arcs[j]:
            live[which] = True
        base = np.full(n, -np.inf)
        for which, i, _ in arcs[j]:
            base[which] = np.maximum(base[which], scale[i][which])
        for which, i, piece in arcs[j]:
            alpha[j, which] += alpha[i, which] * p[piece] * np.exp(scale[i][which] - base[which])[:, None]
        top = alpha[j].max(axis=1)
        top[top == 0] = 1
        alpha[j] /= top[:, None]
        scale[j] = np.where(live, base + np.log(top), -np.inf)
    return alpha, scale


def plain_forward(arcs: list, n: int, p: np.ndarray) -> np.ndarray:
    """alpha without scaling, for words so short that no product underflows."""
    alpha = np.zeros((len(arcs), n, p.shape[1]))
    alpha[0] = 1
    for j in range(1, len(arcs)):
        for which, i, piece in arcs[j]:
            alpha[j, which] += alpha[i].take(which, axis=0) * p.take(piece, axis=0)
    return alpha


def log_likelihoods(words: list[bytes], p: np.ndarray, of: PieceTrie) -> np.ndarray:
    """words x languages: log of the sum over all segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # Words of like length together; long ones in small groups, so that the lattice stays small.
        part = order[at : at + max(1, min(SLICE, 400_000 // max(1, int(size[order[min(at + 2000, len(order) - 1)]]))))]
        if size[part[-1]] > LONGEST_TOGETHER:
            part = part[: max(1, 200_000 // int(size[part[-1]]))]
        at += len(part)
        for first in [part] if size[part[-1]] <= 100_000 else [part[k : k + 1] for k in range(len(part))]:
            out[first] = _group(first, words, size, p, of)
    return out


def _group(part: np.ndarray, words: list[bytes], size: np.ndarray, p: np.ndarray, of: PieceTrie) -> np.ndarray:
    if size[part[-1]] > 10_000:
        return np.array([_one_long(words[k], p, of) for k in part])
    arcs = of.arcs([words[k] for k in part])
    last, row = size[part], np.arange(len(part))
    if size[part[-1]] <= SHORT:
        return np.log(plain_forward(arcs, len(part), p)[last, row])
    alpha, scale = forward(arcs, len(part), p)
    return np.log(np.maximum(alpha[last, row], 1e-300)) + scale[last, row][:, None]


def _one_long(word: bytes, p: np.ndarray, of: PieceTrie) -> np.ndarray:
    """The same for one very long word, keeping only the last positions."""
    keep = of.longest
    ring = np.zeros((keep + 1, p.shape[1]))
    ring[0], logs = 1, 0.0
    # ring[k] is alpha at position (now - k); pieces that end at `now` are found backwards from their starts.
    pending: list[tuple[int, int]] = []
    for b in word:
        ring = np.roll(ring, 1, axis=0)
        ring[0] = 0
        pending = [(int(of.step(node, b)), age + 1) for node, age in [*pending, (0, 0)]]
        pending = [(node, age) for node, age in pending if node]
        for node, age in pending:
            if (piece := of.piece_at[node]) >= 0:
                ring[0] += ring[age] * p[piece]
        top = ring.max()
        ring /= top
        logs += np.log(top)
    return np.log(np.maximum(ring[0], 1e-300)) + logs


def _windows(words: list[bytes], weights: np.ndarray):
    """(part, weight, first, end) of every word: the pieces that start at first:end of the part are to be counted."""
    for word, weight in zip(words, weights, strict=True):
        n = len(word)
        for a in range(0, n, WINDOW):
            b, low = min(n, a + WINDOW), max(0, a - CONTEXT)
            yield word[low : b + CONTEXT], weight, a - low, b - low


def expected_counts(words: list[bytes], weights: np.ndarray, p: np.ndarray, of: PieceTrie) -> np.ndarray:
    """Expected piece counts of one language: each occurrence's posterior, alpha * p * beta / total."""
    out = np.zeros(of.pieces)
    log_p = np.log(p)
    rows = sorted(_windows(words, weights), key=lambda x: len(x[0]))
    size = np.array([len(x[0]) for x in rows])
    at = 0
    while at < len(rows):
        # Words of like length together, few of them if they are long.
        some = size[at : at + SLICE]
        n = max(1, int(np.count_nonzero(some * np.arange(1, len(some) + 1) <= LATTICE)))
        part = [x[0] for x in rows[at : at + n]]
        w, first, end = (np.array([x[k] for x in rows[at : at + n]]) for k in (1, 2, 3))
        arcs, last = of.arcs(part), size[at : at + n]
        at += n
        alpha, scale = forward(arcs, n, p[:, None])
        log_alpha = np.log(np.maximum(alpha[:, :, 0], 1e-300)) + scale
        log_beta = np.full((len(arcs), n), -np.inf)
        log_beta[last, np.arange(n)] = 0
        total = log_alpha[last, np.arange(n)]
        for j in range(len(arcs) - 1, 0, -1):
            for which, i, piece in arcs[j]:
                through = log_p[piece] + log_beta[j, which]
                counted = w[which] * ((first[which] <= i) & (i < end[which]))
                np.add.at(out, piece, counted * np.exp(log_alpha[i, which] + through - total[which]))
                log_beta[i, which] = np.logaddexp(log_beta[i, which], through)
    return out


def words_of(text: str) -> list[bytes]:
    return [MARK + w.encode(errors="replace") for w in text.split()]


class LanguageModel:
    """Piece probabilities by language: pieces x languages, bounded by the vocabulary."""

    def __init__(self, vocabulary: str, languages: list[str], p: np.ndarray):
        self.vocabulary, self.languages, self.p = vocabulary, languages, p
        self.known: dict[str, int] = {}
        self.held = 0
        self.rows = np.zeros((0, len(languages)))
        self.most = min(MAX_CACHED_WORDS, MAX_CACHED_NUMBERS // max(1, len(languages)))

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "languages": self.languages, "p": self.p.astype(np.float32)}

    def __setstate__(self, state):
        self.__init__(state["vocabulary"], state["languages"], state["p"].astype(float))

    def full(self) -> bool:
        return len(self.known) > self.most or self.held > MAX_CACHED_BYTES

    def _learn_rows(self, words: set[str]) -> None:
        if self.full():
            self.known, self.rows, self.held = {}, self.rows[:0], 0
        fresh = sorted(words)
        self.held += sum(map(len, fresh))
        got = log_likelihoods([MARK + w.encode(errors="replace") for w in fresh], self.p, trie(self.vocabulary))
        self.known.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
        self.rows = np.concatenate([self.rows, got])

    def log_text(self, texts: list[str | None]) -> np.ndarray:
        """texts x languages."""
        out = np.zeros((len(texts), len(self.languages)))
        for a, b in _groups([len(t) if t else 0 for t in texts], 1 << 21):
            split = [t.split() if t else [] for t in texts[a:b]]
            words = list(chain.from_iterable(split))
            rows = list(map(self.known.get, words))
            if None in rows:
                fresh = {w for w, r in zip(words, rows, strict=True) if r is None}
                if self.full():
                    fresh = set(words)
                self._learn_rows(fresh)
                rows = list(map(self.known.__getitem__, words))
            sizes = np.array([len(x) for x in split])
            some = np.flatnonzero(sizes)
            if len(some):
                starts = (np.cumsum(sizes) - sizes)[some]
                out[a + some] = np.add.reduceat(self.rows[np.asarray(rows)], starts, axis=0)
        return out



def predict(blocks, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Best language of each text and its posterior, over blocks of languages that are read one after the other."""
    lettered = np.array([bool(t and LETTER.search(t)) for t in texts], bool)
    names: list[str] = [UNDETERMINED] * len(texts)
    best, total = np.full(len(texts), -np.inf), np.zeros(len(texts))
    given = [t if ok else None for t, ok in zip(texts, lettered, strict=True)]
    for model in blocks if lettered.any() else ():
        if not model.languages:
            continue
        logs = model.log_text(given)
        own = logs.max(axis=1)
        for i, k in enumerate(logs.argmax(axis=1)):
            if lettered[i] and (own[i] > best[i] or (own[i] == best[i] and model.languages[k] < names[i])):
                names[i] = model.languages[k]
        top = np.maximum(best, own)
        total = total * np.exp(best - top) + np.exp(logs - top[:, None]).sum(axis=1)
        best = top
    return names, np.where(lettered & (total > 0), 1 / np.maximum(total, 1), 0.0)


def _groups(sizes: list[int], most: int):
    """Runs of neighbours with about ``most`` in sum."""
    a, held = 0, 0
    for b, size in enumerate(sizes, 1):
        held += size
        if held >= most or b == len(sizes):
            yield a, b
            a, held = b, 0


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", salt: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE, vocabulary: str | None = None) -> list[LanguageModel]:
    """Models of blocks of languages, from about ``docs_per_language`` rows of each non-null language.

    The sample's word counts are aggregated in Spark; expected counts are
    computed by one task per language and come back as one array each.
    """
    path = vocabulary or default_vocabulary()
    rows = labelled.select(F.col(lang).alias("language"), F.col(text).alias("body"), F.col(salt).alias("salt")).where("language is not null and body is not null")
    sample = per_class_sample(rows, "language", docs_per_language, F.col("salt"))
    words = sample.select("language", F.explode(F.split("body", SPACE)).alias("word")).where("word != ''").groupBy("language", "word").count()

    def em(key, frame):
        of = trie(path)
        part = [MARK + w.encode(errors="replace") for w in frame["word"]]
        weights = frame["count"].to_numpy(float)
        p = np.full(of.pieces, 1 / of.pieces)
        for _ in range(EM_ROUNDS):
            counts = expected_counts(part, weights, p, of) + SMOOTHING
            p = counts / counts.sum()
        import pandas as pd

        return pd.DataFrame({"language": [key[0]], "p": [p.astype(np.float32).tobytes()]})

    n = words.agg(F.count_distinct("language")).first()[0]
    blocks = max(1, -(-n // LANGUAGES))
    if blocks > 1:
        checkpoint_folder(labelled.sparkSession)
        words = words.checkpoint()
    block = F.pmod(F.xxhash64("language"), F.lit(blocks))
    models = []
    for i in range(blocks):  # what comes back at a time is bounded by a block's languages and the vocabulary
        rows = sorted(words.where(block == i).groupBy("language").applyInPandas(em, "language string, p binary").collect())
        p = np.array([np.frombuffer(r["p"], np.float32) for r in rows], np.float32).T if rows else np.zeros((trie(path).pieces, 0), np.float32)
        models.append(LanguageModel(path, [r["language"] for r in rows], p.astype(float) if blocks == 1 else p))
    return models


def identify(df: DataFrame, models: list[LanguageModel], text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row; columns of these names in ``df`` are replaced."""
    spark: SparkSession = df.sparkSession
    shared = [spark.sparkContext.broadcast(m) for m in models]

    def blocks():
        for one in shared:
            yield one.value
            if len(shared) > 1:  # let the block go before the next is read; its file is read again when needed
                del one._value

    @F.arrow_udf("lang_pred string, score double")
    def guess(column: pa.Array) -> pa.Array:
        names, scores = [], [np.zeros(0)]
        for texts in text_slices(column):
            found, score = predict(blocks(), [t.decode() for t in texts])
            names += found
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())], ["lang_pred", "score"])

    return df.withColumn("__guess", guess(F.col(text))).withColumns({"lang_pred": F.col("__guess.lang_pred"), "score": F.col("__guess.score")}).drop("__guess")


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows whose crc32(id) mod 4 is not 2; the others are held out."""
    return docs.where(F.coalesce(held_out_bucket(F.col(doc_id), 4), F.lit(0)) != 2)


def keep_identified(docs: DataFrame, models: list[LanguageModel], text: str = "text", min_score: float = 0.3) -> DataFrame:
    """The filter stage: rejects rows without a language, or whose best language has a posterior under ``min_score``."""
    return identify(docs.withColumn("__text", F.col(text)), models, "__text").where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select(*docs.columns)
