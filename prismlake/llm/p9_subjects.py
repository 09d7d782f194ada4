"""Problem 9: the subject areas of each document.

1. Texts are cleaned (markup, broken words, page marks, tables of contents, reference lists) and split into sentences;
   words become 32-bit hashes, so later passes read numbers only.
2. Document counts of all words over all documents, by language. Vocabulary: words in at least MIN_DOCS + MIN_SHARE of
   the documents (so at most the average number of distinct words / MIN_SHARE, whatever the collection's size) that are
   in no more than MAX_SHARE of the documents of any language.
3. Normalised document vectors (squared idf, random projection to DIMENSIONS). Bisecting k-means makes a tree of all of
   them; every document then gets the NEAREST leaves, weighted by likeness.
4. Leaves are labelled by their discriminative terms: each area's terms come from all hand-labelled documents and its name
   and note; the labels inside the leaf count as well. So every leaf has a
   mixture of areas, and every word one through the leaves it occurs in.
5. Every sentence is put to an area or to none: its words must point to the area, and among the areas that they point
   to the mixture of the document's leaves decides with them. From these sentences, over all documents, the leaves'
   mixtures and the words' are counted again (ROUNDS times); that takes the mixture of whole documents out of the words.
6. A document's mixture is that of its leaves, sharpened to its own sentences: the share of its sentences with an area
   that each area has; areas of at least CASE_SHARE are its subjects.

All documents are read eight times: words, vectors, leaves, words by leaf, two counts, labels and the mixtures.

Defined results: null, empty and blank texts and documents without a sentence on any area have no rows; labels of
unknown documents or areas are left out; of repeated rows of a document each counts, and p9_found gives equal rows once;
empty tables give no rows; other columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, drop, keep
from ..tables import table

MIN_SHARE = 1e-4
MIN_DOCS = 3
MAX_SHARE = 0.30
#: Documents of a language from which on its own shares count half; smaller languages lean on the whole collection.
LANGUAGE_DOCS = 200
DIMENSIONS = 96
LEAVES = 320
#: Documents of a task while the tree is fitted, on all of them, unless there are fewer tasks than cores.
TREE_DOCS = 20_000
NEAREST, SHARPNESS = 3, 8
#: Labelled documents up to which their labels are broadcast; more are joined with a shuffle.
LABELLED = 20_000
TOP_TERMS = 150
LEAF_WEIGHT = 6.0
#: Weight of the leaves' mixture beside a sentence's words.
LEAF_PRIOR = 0.5
SUPPORT = 0.2
LEAST_LABELLED = 0.25
ROUNDS = 2
CASE_SHARE = 0.25
SEED = 11

#: Headings under which reference lists stand.
REFERENCE_HEADS = r"References|Bibl\.|Bibliography|Bibliographie|Bibliograf[ií]a|Literatur(?:verzeichnis)?|Referencias|Références|Works cited|Notes and references"


def cleaner():
    """text -> text without markup, broken words, page marks and reference lists."""
    import html
    import re

    tag = re.compile(r"<[^<>]{1,40}>")
    broken = re.compile(r"(?<=[^\W\d_])[-­]\n\s*(?=[^\W\d_])")
    head = re.compile(rf"\W*(?:{REFERENCE_HEADS})\W*", re.I)
    entry = re.compile(r"[^\n]{2,60}, [^\n]{1,12}\.?,? \((?:1[5-9]|20)\d\d[a-z]?\)")
    mark = re.compile(r"\W*(?:\d{1,5}|[^\n]{2,60}\.\.\. *\d{1,4}|\[[^\n\]]*\]|(?:p|pp|page|seite|página)\.? *\d+[^\n]{0,12}|table of contents|contents)\W*", re.I)

    def clean(text: str) -> str:
        if "&" in text:
            text = html.unescape(text)
        if "<" in text:
            text = tag.sub(" ", text)
        if "\n" not in text:
            return text
        kept, listing = [], False
        for line in broken.sub("", text).split("\n"):
            s = line.strip()
            if len(s) < 130:
                if not s:
                    continue
                if head.fullmatch(s):
                    listing = True
                    continue
                if mark.fullmatch(s) or entry.match(s) or listing and len(s) < 80:
                    continue
            if not entry.match(s):  # a list ends at the first line that is none of its entries
                listing = False
                kept.append(line)
        return "\n".join(kept)

    return clean


#: Stands behind every sentence.
END = 0


def as_numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) -> (doc_id, lang, ids): hashes of the words, END behind every sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        from zlib import crc32

        class Hashes(dict):
            def __missing__(self, w):
                if len(self) > 1_000_000:
                    self.clear()
                h = self[w] = END if w[0] in ".!?…" else (crc32(w.encode("utf-8", "surrogatepass")) - (1 << 31) or 1)
                return h

        number, clean = Hashes(), cleaner()
        find = re.compile(r"[^\W\d_]+|[.!?…][\"”»'’)\]]*\s").findall
        for pdf in batches:
            ids = []
            for text in pdf["text"]:
                words = find(clean(text).lower())
                words.append(".")
                ids.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "ids": ids})
            yield out[[bool(a.any()) for a in ids]]

    return docs.mapInPandas(run, "doc_id long, lang string, ids array<int>")


def vocabulary(docs: DataFrame) -> tuple[pd.DataFrame, int]:
    """id, df, idf of the words that may tell subjects, and the number of documents. The largest share of a word in a
    language is smoothed by its share in all documents. The result is bounded by MIN_SHARE."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("size"))
    n = docs.count()
    words = docs.select("lang", F.explode(F.array_distinct("ids")).alias("id")).where(F.col("id") != END)
    by = words.groupBy("id", "lang").agg(F.count("*").alias("c"))
    df = by.groupBy("id").agg(F.sum("c").alias("df")).where(F.col("df") >= MIN_DOCS + MIN_SHARE * n)
    each = by.join(df, "id").join(sizes, by["lang"].eqNullSafe(sizes["lang"])).select("id", "df", ((F.col("c") + LANGUAGE_DOCS * F.col("df") / n) / (F.col("size") + LANGUAGE_DOCS)).alias("share"))
    kept = each.groupBy("id", "df").agg(F.max("share").alias("share")).where(F.col("share") <= MAX_SHARE).select("id", "df").toPandas()
    kept = kept.sort_values("id", ignore_index=True)
    kept["idf"] = np.log(n / kept["df"])
    return kept, n


def _batch(pdf: pd.DataFrame, vocab: np.ndarray):
    """Places in the vocabulary (-1: not in it), the document and the sentence of each word, sentences' documents."""
    ids = pdf["ids"].to_list()
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    at = np.minimum(np.searchsorted(vocab, flat), len(vocab) - 1)
    at = np.where(vocab[at] == flat, at, -1)
    end = flat == END
    sentence = np.cumsum(end) - end
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])[end]
    keep = at >= 0
    return at[keep], sentence[keep], owner


def _vectorise(vocab: pd.DataFrame, dimensions: int = DIMENSIONS):
    """(ids, project): the words and their rows in the vectors' space."""
    ids, idf = vocab["id"].to_numpy(np.int32), vocab["idf"].to_numpy(np.float32)
    return ids, np.random.default_rng(SEED).standard_normal((len(ids), dimensions), dtype=np.float32) * (idf**2)[:, None]


def _vectors(part: pd.DataFrame, ids: np.ndarray, project: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of part that have a word of the vocabulary, and their normalised vectors."""
    at, sentence, owner = _batch(part, ids)
    if not len(at):
        return np.empty(0, np.int64), np.empty((0, project.shape[1]), np.float32)
    doc = owner[sentence]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    v = np.add.reduceat(project[at], first, axis=0)
    return doc[first], v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def with_vectors(docs: DataFrame, vocab: pd.DataFrame) -> DataFrame:
    """(doc_id, ids, v): v is empty if a document has no word of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab[["id", "idf"]], DIMENSIONS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = _vectorise(*shared.value)
        for pdf in batches:
            for start in range(0, len(pdf), 500):
                part = pdf.iloc[start : start + 500]
                of = [np.empty(0, np.float32)] * len(part)
                for k, v in zip(*_vectors(part, *space)):
                    of[k] = v
                yield part[["doc_id", "ids"]].assign(v=of)

    return docs.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids array<int>, v array<float>")


def tree(docs: DataFrame, n: int, leaves: int | None = None) -> np.ndarray:
    """Centres of the leaves of a bisecting k-means tree (cosine distance) over all documents. docs: (v)."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // TREE_DOCS))
    points = docs.where("size(v) > 0").select(array_to_vector("v").alias("features")).coalesce(tasks)
    if points.isEmpty():
        return np.empty((0, DIMENSIONS), np.float32)
    model = BisectingKMeans(k=leaves or LEAVES, maxIter=8, seed=SEED, distanceMeasure="cosine").fit(points)
    centres = np.array(model.clusterCenters(), dtype=np.float32)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)


def nearest_leaves(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """(doc_id, ids, leaves, weights): each document with its NEAREST leaves, the nearest first, whose weights sum up to 1;
    without leaves if it has no vector. docs: (doc_id, ids, v)."""
    shared = docs.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        near = min(NEAREST, len(c))
        for pdf in batches:
            for start in range(0, len(pdf), 500):
                part = pdf.iloc[start : start + 500]
                rows = np.flatnonzero(part["v"].map(len).to_numpy())
                leaves = [np.empty(0, np.int32)] * len(part)
                shares = [np.empty(0, np.float32)] * len(part)
                if len(rows):
                    likeness = np.stack(part["v"].iloc[rows].tolist()) @ c.T
                    top = np.argsort(-likeness, axis=1, kind="stable")[:, :near].astype(np.int32)
                    w = np.maximum(np.take_along_axis(likeness, top, axis=1), 1e-3) ** SHARPNESS
                    for k, a, b in zip(rows, top, (w / w.sum(axis=1, keepdims=True)).astype(np.float32)):
                        leaves[k], shares[k] = a, b
                yield part[["doc_id", "ids"]].assign(leaves=leaves, weights=shares)

    return docs.mapInPandas(run, "doc_id long, ids array<int>, leaves array<int>, weights array<float>")


def word_areas(docs: DataFrame, labels: DataFrame, areas: pd.DataFrame, vocab: pd.DataFrame, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words x areas: documents of each word by area, through the leaves' labels; documents of no area; and the leaves'
    mixtures, leaves x areas. docs: (doc_id, ids, leaf).

    Documents without an area have no label, so a leaf that holds few labelled documents beside those it should hold,
    were labels spread evenly, is taken as one of no area: (held + 1) / (expected + 1) below LEAST_LABELLED.
    """
    from zlib import crc32

    spark = docs.sparkSession
    codes = areas["area_code"].tolist()
    place = {c: i for i, c in enumerate(codes)}
    known = spark.createDataFrame(pd.DataFrame({"id": vocab["id"].astype("int32")}), "id int")  # bounded, see vocabulary()
    where = {int(x): i for i, x in enumerate(vocab["id"])}
    # the labelled documents, each label with its share
    per = labels.where(F.col("area_code").isin(codes)).distinct().groupBy("doc_id").agg(F.collect_set("area_code").alias("codes"))
    per = cut(per)
    marked = cut(docs.select("doc_id", "ids", "leaf").join(F.broadcast(per) if per.count() <= LABELLED else per, "doc_id"))
    seen = marked.select(F.explode("codes").alias("code"), F.size("codes").alias("n"), "leaf")
    by_leaf = seen.groupBy("leaf", "code").agg(F.sum(1 / F.col("n")).alias("w")).collect()
    by_word = marked.select(F.explode("codes").alias("code"), F.size("codes").alias("n"), F.array_distinct("ids").alias("ids")).select("code", "n", F.explode("ids").alias("id"))
    by_word = by_word.join(F.broadcast(known), "id", "left_semi").groupBy("id", "code").agg(F.sum(1 / F.col("n")).alias("w")).toPandas()
    area_word = np.zeros((len(vocab), len(codes)))
    area_word[by_word["id"].map(where), by_word["code"].map(place)] = by_word["w"]
    for i, row in areas.iterrows():  # the words of name and note speak for their area
        for w in set(f"{row['area_name'] or ''} {row['scope_note'] or ''}".lower().replace(",", " ").split()):
            if (k := where.get(crc32(w.encode()) - (1 << 31))) is not None:
                area_word[k, i] += 1
    prior = np.maximum(area_word.sum(axis=0), 1e-9)
    prior /= prior.sum()
    given_word = (area_word + prior) / (area_word.sum(axis=1, keepdims=True) + 1)
    # documents of each word in each leaf, over all documents
    lw = docs.where("leaf IS NOT NULL").select("leaf", F.explode(F.array_distinct("ids")).alias("id")).join(F.broadcast(known), "id", "left_semi").groupBy("leaf", "id").agg(F.count("*").alias("n"))
    lw = cut(lw)
    sizes = {r["leaf"]: r["n"] for r in docs.where("leaf IS NOT NULL").groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values()) or 1
    size_of = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, float(v))]) if sizes else F.lit(None)
    df = spark.createDataFrame(vocab[["id", "df"]].astype({"id": "int32", "df": "float64"}), "id int, df double")
    lift = F.col("n") * F.log(F.col("n") * F.lit(float(total)) / (F.col("df") * size_of[F.col("leaf")]))
    best = Window.partitionBy("leaf").orderBy(F.desc("lift"), "id")
    top = lw.where("n >= 3").join(F.broadcast(df), "id").withColumn("lift", lift).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_TERMS).select("leaf", "id", "lift").collect()
    number = {k: i for i, k in enumerate(sorted(sizes))}
    leaf_area = np.zeros((len(number), len(codes)))
    for r in top:
        leaf_area[number[r["leaf"]]] += max(0.0, r["lift"]) * np.maximum(0, given_word[where[r["id"]]] - 1.5 * prior)
    leaf_area /= np.maximum(leaf_area.sum(axis=1, keepdims=True), 1e-9)
    leaf_area = 3 * leaf_area + 0.2 * prior
    for r in by_leaf:
        if r["leaf"] in number:
            leaf_area[number[r["leaf"]], place[r["code"]]] += r["w"]
    leaf_area /= leaf_area.sum(axis=1, keepdims=True)
    held = {r["leaf"]: r["n"] for r in marked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    rate = sum(held.values()) / total
    expected = np.array([rate * sizes[k] for k in sorted(sizes)])
    empty = (np.array([held.get(k, 0) for k in sorted(sizes)]) + 1) / (expected + 1) < LEAST_LABELLED
    mixture = np.zeros((leaves, len(codes)))
    mixture[sorted(sizes)] = leaf_area * ~empty[:, None]
    leaf_area = np.concatenate([leaf_area * ~empty[:, None], empty[:, None]], axis=1)
    pairs = spark.createDataFrame([(int(k), j, float(leaf_area[i, j])) for k, i in number.items() for j in range(len(codes) + 1)], "leaf int, area int, share double")
    mixed = lw.join(F.broadcast(pairs), "leaf").groupBy("id", "area").agg(F.sum(F.col("n") * F.col("share")).alias("w")).toPandas()
    out = np.zeros((len(vocab), len(codes) + 1))
    np.add.at(out, (mixed["id"].map(where).to_numpy(), mixed["area"].to_numpy()), mixed["w"].to_numpy())
    # the leaves speak with a few documents' weight, labelled documents for themselves
    total_word = out.sum(axis=1, keepdims=True)
    out = out * np.minimum(1.0, LEAF_WEIGHT / np.maximum(total_word, 1e-9))
    return out[:, :-1] + area_word * (out[:, -1:] < 0.5 * LEAF_WEIGHT), out[:, -1], mixture


def weights(counts: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """words x areas: evidence of a word for its area; 0 for words that don't stand out in one area."""
    prior = np.maximum(counts.sum(axis=0), 1e-9)
    prior = prior / prior.sum()
    total = counts.sum(axis=1) + other
    share = (counts + 0.5 * prior) / (total + 0.5)[:, None]
    top = share.argmax(axis=1)
    ratio = share[np.arange(len(share)), top] / prior[top]
    out = np.zeros_like(counts, dtype=np.float32)
    good = (share.max(axis=1) >= least) & (ratio > 2) & (total >= 2)
    lam = np.log(np.maximum(share / prior, 1e-6))
    out[good] = np.maximum(lam[good], 0)
    return out


def leaf_priors(mixture: np.ndarray) -> np.ndarray:
    """leaves x areas: how much more an area a leaf holds than the collection, as logarithm; a leaf without any says
    nothing. Smoothed by a tenth of the collection's mixture."""
    whole = mixture.sum(axis=0) + 1e-9
    whole /= whole.sum()
    own = mixture / np.maximum(mixture.sum(axis=1, keepdims=True), 1e-9)
    return (np.log((own + 0.1 * whole) / (1.1 * whole)) * (mixture.sum(axis=1, keepdims=True) > 0)).astype(np.float32)


def _sentences(part: pd.DataFrame, vocab: np.ndarray, weight: np.ndarray, prior: np.ndarray, floor: float):
    """Words' places and sentences, sentences' documents, area of each sentence (-1: none)."""
    at, sentence, owner = _batch(part, vocab)
    n, k = len(owner), weight.shape[1]
    score = np.zeros((n, k), np.float32)
    if len(at):
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        score[sentence[first]] = np.add.reduceat(weight[at], first, axis=0)
    own = np.zeros((len(part), k), np.float32)  # the mixture of each document's leaves
    for i, (l, w) in enumerate(zip(part["leaves"], part["weights"])):
        if len(l):
            own[i] = np.asarray(w, np.float32) @ prior[np.asarray(l)]
    both = np.where(score >= floor, score + LEAF_PRIOR * own[owner], -np.inf)
    return at, sentence, owner, np.where((score >= floor).any(axis=1), both.argmax(axis=1), -1) if n else np.empty(0, np.int64)


def recount(docs: DataFrame, vocab: np.ndarray, weight: np.ndarray, prior: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Uses of each word in sentences of each area and of none, and sentences of each area by leaf, over all documents. A
    sentence whose area less than SUPPORT of its document's other sentences share counts as one of none, so page
    furniture gets no area."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, weight, prior))
    k = weight.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, w, p = shared.value
        counts, leaves = np.zeros(len(v) * (k + 1)), np.zeros(len(p) * k)
        for pdf in batches:
            for start in range(0, len(pdf), 1000):
                part = pdf.iloc[start : start + 1000]
                at, sentence, owner, area = _sentences(part, v, w, p, floor)
                if len(area):
                    cell, on = owner * (k + 1) + area + 1, area >= 0
                    alike, all_on = np.bincount(cell)[cell] - 1, np.bincount(owner, weights=on)[owner] - 1
                    area = np.where(on & (alike >= 1) & (alike >= SUPPORT * all_on), area, -1)
                    leaf = np.array([l[0] if len(l) else -1 for l in part["leaves"]])[owner]
                    some = (area >= 0) & (leaf >= 0)
                    leaves += np.bincount(leaf[some] * k + area[some], minlength=len(leaves))
                counts += np.bincount(at * (k + 1) + area[sentence] + 1, minlength=len(counts)) if len(at) else 0
        both = np.concatenate([counts, leaves])
        some = np.flatnonzero(both)
        yield pd.DataFrame({"cell": some, "n": both[some]})

    got = docs.select("ids", "leaves", "weights").mapInPandas(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros(len(vocab) * (k + 1) + prior.size)
    full[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy()
    words, leaves = full[: len(vocab) * (k + 1)].reshape(len(vocab), k + 1), full[len(vocab) * (k + 1) :].reshape(prior.shape)
    return words[:, 1:], words[:, 0], leaves


def mixtures(docs: DataFrame, vocab: np.ndarray, weight: np.ndarray, prior: np.ndarray, codes: list[str], floor: float) -> DataFrame:
    """(doc_id, area_code, sentences, share)."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, weight, prior))
    k = len(codes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, w, p = shared.value
        names = np.array(codes, dtype=object)
        for pdf in batches:
            for start in range(0, len(pdf), 1000):
                part = pdf.iloc[start : start + 1000]
                _, _, owner, area = _sentences(part, v, w, p, floor)
                on = area >= 0
                n = np.bincount(owner[on] * k + area[on], minlength=len(part) * k).reshape(len(part), k)
                d, a = np.nonzero(n)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[d], "area_code": names[a], "sentences": n[d, a], "share": n[d, a] / n.sum(axis=1)[d]})

    return docs.select("doc_id", "ids", "leaves", "weights").mapInPandas(run, "doc_id long, area_code string, sentences long, share double")


FIRST_LEAST, LEAST = 0.30, 0.55
FLOOR = 1.5


def subjects(documents: DataFrame, labels: DataFrame, areas: pd.DataFrame) -> DataFrame:
    """documents: (doc_id, lang, text); labels: (doc_id, area_code); areas: area_code, area_name, scope_note."""
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "doc_id long, area_code string, sentences long, share double")
    docs, words_only = keep(as_numbers(documents.where(F.trim("text") != "")))
    vocab, n = vocabulary(docs)
    areas = areas.dropna(subset=["area_code"]).drop_duplicates("area_code").sort_values("area_code", ignore_index=True)
    if not len(vocab) or not len(areas):
        return empty
    docs, vectors = keep(with_vectors(docs, vocab))
    drop(spark, words_only)
    centres = tree(docs, n)
    docs, _ = keep(nearest_leaves(docs, centres))
    drop(spark, vectors)
    docs = docs.withColumn("leaf", F.get("leaves", F.lit(0)))
    counts, other, mixture = word_areas(docs, labels, areas, vocab, len(centres))
    ids = vocab["id"].to_numpy(np.int32)
    weight, prior = weights(counts, other, FIRST_LEAST), leaf_priors(mixture)
    for _ in range(ROUNDS):
        counts, other, mixture = recount(docs, ids, weight, prior, FLOOR)
        weight, prior = weights(counts, other, LEAST), leaf_priors(mixture)
    return mixtures(docs, ids, weight, prior, areas["area_code"].tolist(), FLOOR)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "subject_labels").select("doc_id", "area_code")
    return subjects(docs, labels, table(spark, sf_dir, "subject_areas").select("area_code", "area_name", "scope_note").toPandas())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).where(F.col("share") >= CASE_SHARE).select("doc_id", "area_code").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, sentences and share of all sentences with an area, by area."""
    m = _subjects(spark, sf_dir)
    every = Window.partitionBy()
    return m.groupBy("area_code").agg(F.count_if(F.col("share") >= CASE_SHARE).alias("documents"), F.sum("sentences").alias("sentences")).withColumn("share", F.round(F.col("sentences") / F.sum("sentences").over(every), 6))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
SQL = {}
