"""Terms in long form (doc, term, weight): vocabulary bounds, TF-IDF, class terms, topic coherence.

The long form is what a sparse matrix is in Spark: sums per term or document are partial aggregates before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_list(text: Column, least: int = 3, stop: list[str] = ()) -> Column:
    """Maximal runs of at least `least` letters of any script, lower-cased."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))
    return F.filter(w, lambda x: ~x.isin(*stop)) if stop else w


def ngrams(words: Column) -> Column:
    """Words and pairs of neighbours."""
    n = F.size(words)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(doc, term, tf)."""
    return docs.select(F.col(key).alias("doc"), F.explode(terms).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def bounded(tf: DataFrame, n_docs: Column | int, min_df: int, max_df: float, features: int | None = None) -> DataFrame:
    """Vocabulary (term, df, uses) within the bounds; the `features` most used terms, ties by term."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    v = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses")).where((F.col("df") >= min_df) & (F.col("df") <= n * F.lit(max_df)))
    return v.orderBy(F.desc("uses"), "term").limit(features) if features else v


def tfidf(tf: DataFrame, vocabulary: DataFrame, n_docs: int, sublinear: bool = True) -> DataFrame:
    """(doc, term, w): (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), of unit length per document."""
    idf = F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0
    local = 1.0 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = tf.join(vocabulary.select("term", "df"), "term").select("doc", "term", (local * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("w") / norm).alias("w"))


def class_terms(weights: DataFrame, labels: DataFrame, top: int = 14) -> DataFrame:
    """(label, term, mean, place): mean weight over all documents of the class, absent terms count 0."""
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    mean = weights.join(labels, "doc").groupBy("label", "term").agg(F.sum("w").alias("s")).join(F.broadcast(size), "label").select("label", "term", (F.col("s") / F.col("n")).alias("mean"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("mean", 9)), "term"))
    return mean.withColumn("place", place).where(F.col("place") <= top)


def pair_counts(tf: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, x, y, both): documents that hold both terms of a topic, for all pairs x < y of its few terms."""
    own = tf.select("doc", "term").join(F.broadcast(topics.select("topic", "term")), "term")
    l, r = own.select("doc", "topic", F.col("term").alias("x")), own.select("doc", "topic", F.col("term").alias("y"))
    both = l.join(r, ["doc", "topic"]).where("x < y").groupBy("topic", "x", "y").agg(F.count("*").alias("both"))
    t = topics.select("topic", "term")
    every = t.withColumnRenamed("term", "x").join(t.withColumnRenamed("term", "y"), "topic").where("x < y")
    return every.join(both, ["topic", "x", "y"], "left").withColumn("both", F.coalesce("both", F.lit(0)))


def npmi_smoothed(tf: DataFrame, topics: DataFrame, n_docs: int) -> DataFrame:
    """(topic, npmi): counts plus one; a pair in every document has no defined value and is left out."""
    df = tf.join(F.broadcast(topics.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    p = lambda c: (F.coalesce(F.col(c), F.lit(0)) + 1.0) / (n_docs + 1.0)
    pairs = pair_counts(tf, topics).join(df.select(F.col("term").alias("x"), F.col("df").alias("dx")), "x", "left").join(df.select(F.col("term").alias("y"), F.col("df").alias("dy")), "y", "left")
    value = F.try_divide(F.log(p("both") / (p("dx") * p("dy"))), -F.log(p("both")))
    return pairs.groupBy("topic").agg(F.avg(value).alias("npmi"))


def npmi_strict(tf: DataFrame, topics: DataFrame, n_docs: int) -> DataFrame:
    """(topic, npmi): no smoothing; -1 for a pair that never occurs together."""
    df = tf.join(F.broadcast(topics.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    pairs = pair_counts(tf, topics).join(df.select(F.col("term").alias("x"), F.col("df").alias("dx")), "x", "left").join(df.select(F.col("term").alias("y"), F.col("df").alias("dy")), "y", "left")
    n = F.lit(float(n_docs))
    value = F.when(F.col("both") == 0, F.lit(-1.0)).otherwise(F.try_divide(F.log(F.col("both") * n / (F.col("dx").cast("double") * F.col("dy"))), -F.log(F.col("both") / n)))
    return pairs.groupBy("topic").agg(F.avg(value).alias("npmi"))


def diversity(topics: DataFrame) -> DataFrame:
    return topics.agg((F.count_distinct("term") / F.count("*")).alias("diversity"))


def exclusivity(topic_words: DataFrame, topics: DataFrame) -> DataFrame:
    """Mean share of each topic's terms in the terms' probability over all topics. topic_words: (topic, term, p)."""
    share = topic_words.withColumn("share", F.col("p") / F.sum("p").over(Window.partitionBy("term")))
    return share.join(F.broadcast(topics.select("topic", "term")), ["topic", "term"]).groupBy("topic").agg(F.avg("share").alias("exclusivity"))


def distribution_summary(docs: DataFrame, p: str, k: int) -> DataFrame:
    """One row for document-topic distributions (arrays of k): dominance, document and usage entropy, topics in use."""
    entropy = -F.aggregate(F.col(p), F.lit(0.0), lambda acc, x: acc + x * F.log(F.greatest(x, F.lit(1e-12))))
    d = docs.select(F.array_max(p).alias("top"), F.array_position(F.col(p), F.array_max(p)).alias("topic"), (entropy / F.log(F.lit(float(k)))).alias("h"))
    use = d.groupBy("topic").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    usage = use.agg((-F.sum(F.col("share") * F.log("share")) / F.log(F.lit(float(k)))).alias("usage_entropy"), F.count("*").alias("active_topics"))
    return d.agg(F.avg("top").alias("mean_top"), F.avg("h").alias("mean_entropy")).crossJoin(usage)


def inverted_index(rows: DataFrame, key: str, tokens: Column, span: int = 1 << 20) -> DataFrame:
    """(token, part, postings, df): the rows of a token in order, in parts by row number div `span`, so that no list grows
    with the collection; df counts all parts."""
    each = rows.select(F.col(key).alias("row"), F.explode(F.array_distinct(tokens)).alias("token"))
    parts = each.groupBy("token", F.floor(F.col("row") / span).alias("part")).agg(F.array_sort(F.collect_list("row")).alias("postings"))
    df = parts.groupBy("token").agg(F.sum(F.size("postings")).alias("df"))
    return parts.join(df, "token")


def term_centroids(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, term, c): normalised mean of the classes' document vectors. weights: (doc, term, w); labels: (doc, label)."""
    total = weights.join(labels, "doc").groupBy("label", "term").agg(F.sum("w").alias("s"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("label")))
    return total.select("label", "term", (F.col("s") / norm).alias("c"))


def nearest_class(weights: DataFrame, labels: DataFrame, centroids: DataFrame) -> DataFrame:
    """(doc, label, nearest, own, other): similarity of each labelled document to its class's centroid and to the best
    other one; classes without a common term have 0, ties go to the smaller label. Terms are joined, so a document meets
    only what it shares; the list of classes is as long as there are labels."""
    score = weights.join(centroids.withColumnRenamed("label", "class"), "term").groupBy("doc", "class").agg(F.sum(F.col("w") * F.col("c")).alias("score"))
    classes = centroids.select(F.col("label").alias("class")).distinct()
    every = labels.crossJoin(F.broadcast(classes)).join(score, ["doc", "class"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    best = F.max_by("class", F.struct(F.col("score"), -F.col("class")))
    return every.groupBy("doc", "label").agg(
        best.alias("nearest"), F.max(F.when(F.col("class") == F.col("label"), F.col("score"))).alias("own"), F.max(F.when(F.col("class") != F.col("label"), F.col("score"))).alias("other")
    )


def class_quality(nearest: DataFrame) -> DataFrame:
    """(documents, accuracy, cohesion_mean, margin_mean, margin_positive_pct) of nearest_class."""
    margin = F.col("own") - F.col("other")
    return nearest.agg(
        F.count("*").alias("documents"), F.avg((F.col("nearest") == F.col("label")).cast("double")).alias("accuracy"), F.avg("own").alias("cohesion_mean"),
        F.avg(margin).alias("margin_mean"), F.avg((margin > 0).cast("double") * 100).alias("margin_positive_pct"),
    )
