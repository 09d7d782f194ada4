"""Problem 6: the language of each text and of each part of a mixed text, with a confidence.

Model: for every language a probability of every piece of a fixed public vocabulary (its file is a parameter; it is
never trained). A word's probability is the sum over all its segmentations into pieces, by the forward algorithm;
pieces don't cross words, so a text's log-probability is the sum over its words, and each distinct word is scored
once per worker. The piece probabilities are fitted by expectation maximisation (forward-backward) on at most
TRAIN_ROWS labelled abstracts per language, taken by hash; as labels may be wrong, rows whose fitted language differs
from the label leave and the model is fitted again.

Parts: the text is split into sentences; dynamic programming chooses the runs, each of two sentences or more if there
are several, and their languages that maximise the log-probability less SWITCH for each further part.

Defined results: null, empty and blank abstracts have no parts; texts without letters get the label's language if it
names one, else DEFAULT with confidence 0; repeated rows of a paper count once (the largest abstract); very long texts
are scored whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LANGUAGES = ["en", "de", "fr", "es", "it", "pt", "nl"]
DEFAULT = "en"
#: At most so many labelled abstracts of each language are read for fitting.
TRAIN_ROWS = 300
ROUNDS = 3
SHRINK = 200.0
SWITCH = 14.0
#: What another title language must be ahead of the abstract's first part, in nats.
TITLE_MARGIN = 8.0
CACHE = 600_000
MAX_PIECE = 16
#: Names and codes of the languages, apart from the two-letter code itself.
LABELS = {
    "en": "eng english englisch anglais inglés inglese inglês engels",
    "de": "ger deu german deutsch allemand alemán tedesco alemão duits",
    "fr": "fre fra french französisch français francais francés francese francês frans",
    "es": "spa esp spanish spanisch español espanol espagnol spagnolo espanhol spaans castellano",
    "it": "ita italian italienisch italiano italien italiaans",
    "pt": "por portuguese portugiesisch português portugues portugais portugués portoghese portugees",
    "nl": "dut nld dutch niederländisch nederlands néerlandais neerlandés olandese holandês flemish vlaams",
}
NO_LANGUAGE = {"", "und", "??", "?", "unknown", "n/a", "na", "none", "null", "zxx", "mul", "mis", "xx", "-"}


def label_code(label: str | None) -> str | None:
    """The language a label names; None if it names none; "other" for a language that isn't known here."""
    s = (label or "").strip().lower()
    if s in NO_LANGUAGE:
        return None
    head = s.replace("_", "-").split("-")[0].strip(" .()[]")
    for code in LANGUAGES:
        if head == code or head in LABELS[code].split() or s in LABELS[code].split():
            return code
    return None if head in NO_LANGUAGE else "other"


def load_pieces(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and len(p := sp.id_to_piece(i)) <= MAX_PIECE]


class Words:
    """Lattices of words over the pieces: ids[w, i, k] is the piece that starts at i and has k + 1 letters, or the last
    number, whose probability is 0; a letter that is no piece has the number before that."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.unknown, self.none = len(pieces), len(pieces) + 1

    def lattice(self, words: list[str]) -> np.ndarray:
        n = len(words[0])
        out = np.full((len(words), n, min(n, MAX_PIECE)), self.none, dtype=np.int32)
        get = self.number.get
        for w, word in enumerate(words):
            row = out[w]
            for i in range(n):
                for j in range(i + 1, min(n, i + MAX_PIECE) + 1):
                    k = get(word[i:j])
                    if k is not None:
                        row[i, j - i - 1] = k
                if row[i, 0] == self.none:
                    row[i, 0] = self.unknown
        return out

    def by_length(self, words: list[str]):
        """(places in words, marked words) of each length; words longer than 40 letters are scored in bits of 40."""
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w) + 1, []).append(i)
        return [(np.array(at), ["▁" + words[i] for i in at]) for _, at in sorted(groups.items())]

    def scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log P(word | language): words x languages. p: pieces + 2 x languages."""
        out = np.empty((len(words), p.shape[1]))
        for at, marked in self.by_length(words):
            ids = self.lattice(marked)
            n = ids.shape[1]
            log_scale = np.zeros((len(marked), p.shape[1]))
            alpha = np.zeros((len(marked), n + 1, p.shape[1]))
            alpha[:, 0] = 1.0
            for j in range(1, n + 1):
                for i in range(max(0, j - MAX_PIECE), j):
                    alpha[:, j] += alpha[:, i] * p[ids[:, i, j - i - 1]]
                if j % 24 == 0:  # long words would underflow
                    s = np.maximum(alpha[:, j], 1e-290)
                    alpha[:, max(0, j - MAX_PIECE + 1) : j + 1] /= s[:, None, :]
                    log_scale += np.log(s)
            out[at] = np.log(np.maximum(alpha[:, n], 1e-300)) + log_scale
        return out

    def expected(self, lattices: list[np.ndarray], weights: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece under every language: pieces + 2 x languages."""
        counts = np.zeros_like(p)
        for ids, weight in zip(lattices, weights):
            m, n = ids.shape[:2]
            f, b = np.zeros((m, n + 1, p.shape[1])), np.zeros((m, n + 1, p.shape[1]))
            f[:, 0] = b[:, n] = 1.0
            for j in range(1, n + 1):
                for i in range(max(0, j - MAX_PIECE), j):
                    f[:, j] += f[:, i] * p[ids[:, i, j - i - 1]]
            w = weight / np.maximum(f[:, n], 1e-300)
            for i in range(n - 1, -1, -1):
                for j in range(i + 1, min(n, i + MAX_PIECE) + 1):
                    k = ids[:, i, j - i - 1]
                    step = p[k] * b[:, j]
                    b[:, i] += step
                    real = k < self.unknown
                    np.add.at(counts, k[real], (w * f[:, i] * step)[real])
        return counts


def fit(rows: list[tuple[str, str]], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (pieces + 2 x languages) from (language, text) rows."""
    import re
    from collections import Counter

    words, counts = Words(pieces), [Counter() for _ in LANGUAGES]
    find = re.compile(r"[^\W\d_]+").findall
    for code, text in rows:
        counts[LANGUAGES.index(code)].update(find(text.lower()))
    # every language starts from equal probabilities, which favours long pieces
    known = [w for w in dict.fromkeys(w for c in counts for w in c) if len(w) < 40]
    weight = np.array([[float(c[w]) for c in counts] for w in known]).reshape(len(known), len(LANGUAGES))
    groups = words.by_length(known)
    lattices, weights = [words.lattice(marked) for _, marked in groups], [weight[at] for at, _ in groups]
    p = np.full((len(pieces) + 2, len(LANGUAGES)), 1e-4)
    p[-2:] = np.array([[1e-9], [0.0]])
    uses = np.zeros_like(p)
    for _ in range(rounds):
        uses = words.expected(lattices, weights, p)
        p = (uses + 1e-3) / (uses.sum(axis=0) + 1e-3 * len(uses))
        p[-2:] = np.array([[1e-9], [0.0]])
    total = uses.sum(axis=0)
    pooled = (uses / np.maximum(total, 1.0)).sum(axis=1) / len(LANGUAGES)
    pooled = (pooled + 1e-7) / (pooled + 1e-7).sum()
    p = (uses + SHRINK * pooled[:, None]) / (total + SHRINK)
    p[-2:] = np.array([[1e-9], [0.0]])
    return p


def fit_robust(rows: list[tuple[str, str]], pieces: list[str]) -> np.ndarray:
    """Fitted twice: the second time without the rows that the first model puts into another language."""
    import re

    p = fit(rows, pieces)
    score, words = Scorer(pieces, p), re.compile(r"[^\W\d_]+").findall
    kept = [(c, t) for c, t in rows if c == LANGUAGES[int(score.texts([words(t.lower())])[0].argmax())]]
    return fit(kept, pieces)


class Scorer:
    """Sums of word scores, with every distinct word scored once."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        self.words, self.p = Words(pieces), p
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1, self.p.shape[1]))

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """texts x languages; texts without words have 0."""
        if len(self.at) > CACHE:
            self.clear()
        flat = [w for t in texts for w in t]
        new = list(dict.fromkeys(w for w in flat if w not in self.at))
        if new:
            bits = [w if len(w) <= 40 else w[:40] for w in new]
            extra = self.words.scores(bits, self.p)
            for i, w in enumerate(new):  # the rest of a very long word
                for k in range(40, len(w), 40):
                    extra[i] += self.words.scores([w[k : k + 40]], self.p)[0]
            start = len(self.table)
            self.at.update((w, start + i) for i, w in enumerate(new))
            self.table = np.concatenate([self.table, extra])
        lengths = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), self.p.shape[1]))
        if flat:
            idx = np.fromiter((self.at[w] for w in flat), dtype=np.int64, count=len(flat))
            full = lengths > 0
            starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
            out[full] = np.add.reduceat(self.table[idx], starts, axis=0)
        return out


def split_sentences(text: str) -> list[str]:
    import re

    parts = re.split(r"(?:(?<=[.!?…])|(?<=[.!?…][\"”»'’)\]]))\s+(?=[«“\"'‘(\[¿¡–—]*\s?[^\W\d_a-zà-öø-ÿ])", text.strip())
    return [p for p in parts if p]


def parts_of(scores: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int, int]]:
    """(first sentence, end, language) of the parts; scores: sentences x languages."""
    n = len(scores)
    best = scores.argmax(axis=1)
    total = scores.sum(axis=0)
    if n < 4 or (best == best[0]).all():
        return [(0, n, int(total.argmax()))]
    # best[l]: the best value of a start two sentences or more back, less the language's sum up to there; one pass
    sums = np.concatenate([np.zeros((1, scores.shape[1])), scores.cumsum(axis=0)])
    value, back = np.full(n + 1, -np.inf), [None] * (n + 1)
    value[0] = switch
    best, start = np.full(scores.shape[1], -np.inf), np.zeros(scores.shape[1], int)
    for j in range(2, n + 1):
        new = value[j - 2] - sums[j - 2]
        better = new > best
        best[better], start[better] = new[better], j - 2
        l = int((best + sums[j]).argmax())
        value[j], back[j] = best[l] + sums[j, l] - switch, (int(start[l]), l)
    out, j = [], n
    while j > 0:
        i, l = back[j]
        if out and out[-1][2] == l:
            out[-1] = (i, out[-1][1], l)
        else:
            out.append((i, j, l))
        j = i
    return out[::-1] if value[n] > total.max() else [(0, n, int(total.argmax()))]


def confidence(scores: np.ndarray) -> float:
    """Posterior of the best language with equal priors; scores are tempered by a half, as words aren't independent."""
    s = (scores - scores.max()) / 2
    return float(1 / np.exp(s).sum())


def training_rows(detail: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """At most `rows` labelled abstracts per language, by hash."""
    names = {alias: code for code in LANGUAGES for alias in [code, *LABELS[code].split()]}
    head = F.regexp_extract(F.lower(F.trim("label")), r"^[^-_]+", 0)
    code = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[head]
    by = Window.partitionBy("code").orderBy("place", "key")
    picked = (
        detail.where(F.length("abstract").between(200, 20_000)).select("key", "abstract", code.alias("code"), F.xxhash64("key", F.lit("train")).alias("place"))
        .where("code IS NOT NULL").withColumn("n", F.row_number().over(by)).where(F.col("n") <= rows)
    )
    return [(r["code"], r["abstract"]) for r in picked.orderBy("code", "n").collect()]


def segments(papers: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """papers: (key, paper_id, title, abstract, label) -> (key, seg_no, lang_code, confidence, listed)."""
    shared = papers.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        score = Scorer(*shared.value)
        find = re.compile(r"[^\W\d_]+").findall
        for pdf in batches:
            keys, numbers, codes, confs, listed = [], [], [], [], []
            lists, spans, titled = [], [], []
            for t, pid, a in zip(pdf["title"], pdf["paper_id"], pdf["abstract"]):
                own = [find(s.lower()) for s in split_sentences(a)]
                own = [w for w in own if w] or [[]]
                spans.append((len(lists), len(lists) + len(own)))
                lists += own
                ok = t is not None and t != pid and len(t.split()) >= 4
                titled.append(len(lists) if ok else -1)
                if ok:
                    lists.append(find(t.lower()))
            s = score.texts(lists)
            for key, label, (i, j), t in zip(pdf["key"], pdf["label"], spans, titled):
                named = label_code(label)
                if not s[i:j].any():
                    parts, code, conf = [(0, j - i, -1)], named if named in LANGUAGES else DEFAULT, [0.0]
                    langs = [code]
                else:
                    parts = parts_of(s[i:j])
                    langs = [LANGUAGES[l] for _, _, l in parts]
                    conf = [confidence(s[i + x : i + y].sum(axis=0)) for x, y, _ in parts]
                title = None
                if t >= 0:
                    first = LANGUAGES.index(langs[0])
                    l = int(s[t].argmax())
                    title = LANGUAGES[l] if s[t][l] - s[t][first] > TITLE_MARGIN else langs[0]
                show = len(parts) > 1 or named is None or named != langs[0] or (title is not None and title != langs[0])
                if title is not None:
                    keys.append(key), numbers.append(0), codes.append(title), confs.append(confidence(s[t])), listed.append(show)
                for n, (code, c) in enumerate(zip(langs, conf), 1):
                    keys.append(key), numbers.append(n), codes.append(code), confs.append(c), listed.append(show)
            yield pd.DataFrame({"key": pd.array(keys, dtype="int64"), "seg_no": pd.array(numbers, dtype="int32"), "lang_code": codes, "confidence": confs, "listed": listed})

    return papers.mapInPandas(run, "key long, seg_no int, lang_code string, confidence double, listed boolean")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    s = table(spark, sf_dir, "search_rows").select(F.col("paper_idx").alias("key"), "paper_id", "title", none.alias("abstract"), none.alias("label"))
    d = table(spark, sf_dir, "detail_rows").where(F.trim("abstract") != "").select(F.col("paper_idx").alias("key"), none.alias("paper_id"), none.alias("title"), "abstract", F.col("abstract_lang").alias("label"))
    one = s.unionAll(d).where("key IS NOT NULL").groupBy("key").agg(*[F.max(c).alias(c) for c in ("paper_id", "title", "abstract", "label")])
    return one.where("abstract IS NOT NULL")


def language_model(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    d = table(spark, sf_dir, "detail_rows").select(F.col("paper_idx").alias("key"), "abstract", F.col("abstract_lang").alias("label"))
    pieces = load_pieces(vocabulary)
    return pieces, fit_robust(training_rows(d), pieces)


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every title and abstract part."""
    found = segments(_papers(spark, sf_dir), language_model(spark, sf_dir))
    return found.select(F.col("key").alias("paper_idx"), "seg_no", "lang_code", F.round("confidence", 4).alias("confidence"), "listed")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_segments(spark, sf_dir).where("listed").select("paper_idx", "seg_no", "lang_code")


QUERIES = {"p6_found": p6_found, "p6_segments": p6_segments}
SQL = {}
