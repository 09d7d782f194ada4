"""Problem 1: link the spellings of one person or organisation.

1. Values are parsed into words and initials (entities, accents, case, titles and particles removed); values with the
   same parts, in any order, form one node.
2. Prefix-filtered set-similarity join of the words on their padded q-grams: a word's q-grams are put in the order of
   their frequency, rarest first, and only the prefix of which any word of the wanted overlap must share a member is
   joined, with the gram's place and the word's length as filters. The wanted overlap is what one error leaves, at the
   least Jaccard (n - 2) / (n + 6) of trigrams for n letters. Of words of LONG letters two errors are allowed; there the
   prefix would be nearly the whole word and candidates grow with the square of the words, so they join on what is left
   of them without two letters. The edit distance of all partners is then checked. Words that differ in the writing of
   umlauts only and short forms of given names (a table) are partners too.
3. A word weighs by its rarity, counted together with its partners (a typing error isn't rare because it is wrong).
   Nodes are candidates if they share, exactly or by partners, a word of both nodes' prefixes: the rarest words up to
   where the rest can no longer reach the threshold. Where more than HOT nodes of people have a word, they must share
   a second part with it: a further word, exactly or by partners, or an initial; `names.compare_people` asks for one, so
   no link is lost. People and organisations are compared by other rules and meet by the word alone.
   The join splits what is still hot into cells.
4. Candidates are verified by soft weighted similarity, rare words counting more, against a threshold
   (`names.compare_*`). Strong links make components. Weak links lead from the shorter spelling to the fuller one, first
   those with initials for given names, then those that lack a middle part, and only count if all of a component's links
   lead to one other component: "Doe, J." is linked to nobody if there are Jane and John Doe.

Defined results: null and "" are no values; values of blanks or punctuation only have no words and are linked to
nobody; repeated rows count once; an empty table gives no pairs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..tables import table
from .components import components
from .hot import hot_buckets, split_join
from . import names

GRAM = 3
#: Letters from which on two errors count as one spelling, as in names.token_similarity.
LONG = 9
#: Share of a name's weight that two spellings of it must have in common.
NAME_THRESHOLD = 0.5
#: Nodes of people above which a word alone makes no candidates of two people.
HOT = 1000

NODE = "node string, org boolean, words array<string>, initials array<string>"


def parsed(values: DataFrame) -> DataFrame:
    """(value) -> (value, node, org, words, initials); node is the same for values with the same parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, *names.parse(v)) for v in pdf["value"]]
            node = ["O" * o + " ".join(sorted(w)) + "|" + " ".join(sorted(i)) for _, o, w, i in rows]
            out = pd.DataFrame({"value": pdf["value"].to_numpy(), "node": node, "org": [r[1] for r in rows], "words": [r[2] for r in rows], "initials": [r[3] for r in rows]})
            yield out[(out["words"].str.len() > 0)]

    return values.mapInPandas(run, "value string, " + NODE)


def fold(word: Column) -> Column:
    """names.fold: two ways of writing umlauts fall together."""
    return F.replace(F.replace(F.replace(word, F.lit("ae"), F.lit("a")), F.lit("oe"), F.lit("o")), F.lit("ue"), F.lit("u"))


def similar_words(words: DataFrame, q: int = GRAM) -> DataFrame:
    """(x, y), both directions: spellings of one word that are one error apart (a letter more, less or other, or two
    neighbours swapped), or up to two if both have LONG letters or more, as names.token_similarity takes them.
    words: (word) distinct.

    One error destroys at most q + 1 of a word's padded q-grams, so two such words share one of the first q + 2 of
    either in any common order; the order is by frequency, rarest first. Behind an added letter a gram stands one
    place further, so grams join on their place and the word's length, both equal or one more. Only pairs whose shorter
    word is below LONG are joined so.
    """
    pad = "#" * (q - 1)
    padded = F.concat(F.lit(pad), F.col("word"), F.lit(pad))
    folded = words.select(F.col("word").alias("x"), fold(F.col("word")).alias("f"))
    alike = folded.join(folded.withColumnRenamed("x", "y"), "f").where("x < y").select("x", "y")
    w = words.where(F.length("word").between(4, LONG))
    each = w.select("word", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") + q - 1), lambda i: F.substring(padded, i, F.lit(q)))).alias("pos", "gram"))
    freq = each.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = each.join(freq, "gram").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "gram", "pos"))), 1, q + 2).alias("o"))
    prefix = ordered.select("word", F.length("word").alias("len"), F.inline("o"))
    moved = F.array(*[F.struct((F.col("len") + a).alias("len"), (F.col("pos") + b).alias("pos")) for a, b in ((0, 0), (1, 0), (1, 1))])
    left = prefix.where(F.col("len") < LONG).select("gram", F.inline(moved), F.col("word").alias("x"))
    right = prefix.select("gram", "len", "pos", F.col("word").alias("y"))
    swapped = F.expr("length(x) = length(y) AND exists(sequence(1, length(x) - 1), i -> concat(substr(x, 1, i - 1), substr(x, i + 1, 1), substr(x, i, 1), substr(x, i + 2)) = y)")
    pairs = left.join(right, ["gram", "len", "pos"]).where((F.length("x") < F.length("y")) | (F.col("x") < F.col("y")))
    pairs = pairs.where((F.levenshtein("x", "y", 1) >= 0) | swapped).select("x", "y").unionAll(similar_long(words))
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).unionAll(alike).distinct()
    return pairs.unionAll(pairs.select("y", "x"))


def similar_long(words: DataFrame) -> DataFrame:
    """(x, y), one direction: words of LONG letters or more that are one or two errors apart.

    Each error, a swap too, costs each word one letter at most of what they have in common in order. So without two of
    its letters the longer word equals the shorter one without none, one or two of its letters, as the lengths differ by
    two, one or none; the words join on (hashes of) these forms, of which a word has as many as pairs of letters.
    """
    w = words.where(F.length("word") >= LONG)
    two = F.expr("flatten(transform(sequence(1, length(word) - 1), i -> transform(sequence(i + 1, length(word)), j -> xxhash64(concat(substr(word, 1, i - 1), substr(word, i + 1, j - i - 1), substr(word, j + 1))))))")
    one = F.expr("transform(sequence(1, length(word)), i -> xxhash64(concat(substr(word, 1, i - 1), substr(word, i + 1))))")
    right = w.select(F.col("word").alias("y"), F.explode(F.array_distinct(two)).alias("form"))
    left = w.select(F.col("word").alias("x"), F.explode(F.array_distinct(F.concat(two, one, F.array(F.xxhash64("word"))))).alias("form"))
    pairs = left.join(right, "form").where((F.length("x") < F.length("y")) | (F.length("x") == F.length("y")) & (F.col("x") < F.col("y"))).select("x", "y").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[names.osa(x, y, 2) <= 2 for x, y in zip(pdf["x"], pdf["y"])]]

    return pairs.mapInPandas(run, "x string, y string")


def nickname_pairs(spark: SparkSession) -> DataFrame:
    """(x, y), both directions, from the table of short forms (fixed size)."""
    of: dict[str, set[str]] = {}
    for short, full in names.SHORT.items():
        for f in full:
            of.setdefault(f, {f}).add(short)
    found = {(x, y) for group in of.values() for x in group for y in group if x != y and names.token_similarity(x, y)}
    return spark.createDataFrame(sorted(found), "x string, y string")


def candidates(nodes: DataFrame, threshold: float = NAME_THRESHOLD, hot: int = HOT) -> DataFrame:
    """Pairs of nodes (a, b), each a struct with words, initials and weights, that share a word of both prefixes."""
    spark = nodes.sparkSession
    words = nodes.select("node", F.explode(F.array_distinct("words")).alias("word"))
    df = cut(words.groupBy("word").agg(F.count("*").alias("df")))
    similar = cut(similar_words(df.select("word")))
    total = df.agg(F.sum("df")).first()[0] or 1
    nick = nickname_pairs(spark)
    partners = similar.unionAll(nick.join(F.broadcast(nick.join(df.select(F.col("word").alias("x")), "x", "left_semi").select("x").distinct()), "x", "left_semi"))
    smooth = (
        df.join(partners.withColumnRenamed("x", "word").join(df.select(F.col("word").alias("y"), F.col("df").alias("dy")), "y"), "word", "left")
        .groupBy("word", "df").agg((F.col("df") + F.coalesce(F.sum("dy"), F.lit(0))).alias("together"))
        .select("word", F.log(F.lit(float(total)) / F.col("together") + 1.0).alias("weight"))
    )
    weighed = (
        nodes.select("node", "org", "initials", F.posexplode("words").alias("pos", "word")).join(smooth, "word")
        .groupBy("node").agg(F.first("org").alias("org"), F.first("initials").alias("initials"), F.reverse(F.array_sort(F.collect_list(F.struct("weight", "word", "pos")))).alias("ws"))
    )
    # the heaviest words, up to where the words left over weigh less than the threshold's share
    sum_of = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, s: acc + s["weight"])
    rest = lambda i: sum_of(F.slice("ws", i + 1, F.size("ws"))) >= threshold * sum_of(F.col("ws"))
    positions = F.filter(F.sequence(F.lit(1), F.size("ws")), lambda i: (i == 1) | rest(i - 1))
    typed = F.array_sort(F.transform("ws", lambda s: F.struct(s["pos"].alias("pos"), s["word"].alias("word"), s["weight"].alias("weight"))))
    full = weighed.select("node", F.struct("org", "initials", F.transform(typed, lambda s: s["word"]).alias("words"), F.transform(typed, lambda s: s["weight"]).alias("weights")).alias("n"), F.transform(positions, lambda i: F.element_at("ws", i)["word"]).alias("prefix"))
    full = cut(full)
    words_of = full.select("node", F.col("n.org").alias("org"), F.col("n.initials").alias("initials"), F.col("n.words").alias("words"), F.explode(F.array_distinct("prefix")).alias("word"))
    partner = partners.select(F.col("x").alias("word"), "y").distinct()
    reached = words_of.unionByName(words_of.join(partner, "word").withColumn("word", F.col("y")).drop("y"))
    many = cut(words_of.where("NOT org").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("word"))
    if many.isEmpty():
        left, right = reached.select(F.xxhash64("word").alias("key"), F.col("node").alias("a")), words_of.select(F.xxhash64("word").alias("key"), F.col("node").alias("b"))
    else:
        left, right = second_parts(reached, many, partner).withColumnRenamed("node", "a"), second_parts(words_of, many, None).withColumnRenamed("node", "b")
    ids = split_join(left, right, "a", "b", hot_buckets([(left, right)])[0]).where("a <> b")
    ids = ids.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ids.join(full.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(full.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")


def second_parts(rows: DataFrame, many: DataFrame, partner: DataFrame | None) -> DataFrame:
    """(key, node). rows: (node, org, initials, words, word). A word of `many` in a person's name makes keys with each
    further word (and its partners, if given: this side of the join) and each initial; initials meet the other side's
    initials and first letters. Names of one word keep the word alone, as all other words do. `names.compare_orgs` asks for
    no second part, so on this side persons also meet the other side's organisations by the word alone."""
    marked = rows.join(many.withColumn("hot", F.lit(True)), "word", "left").withColumn("often", F.coalesce("hot", F.lit(False))).withColumn("hot", F.col("often") & ~F.col("org"))
    plain = marked.where("NOT hot").select(F.xxhash64("word").alias("key"), "node")
    of = marked.where("hot")
    alone = of.where("size(words) = 1 AND size(initials) = 0").select(F.xxhash64("word", F.lit("")).alias("key"), "node")
    further = of.select("node", F.col("word").alias("first"), "words", F.explode("words").alias("word"))
    if partner is not None:
        further = further.drop("words")
        further = further.unionAll(further.join(partner, "word").select("node", "first", "y"))
        mixed = of
    else:  # a word that stands twice is its own second part
        further = further.where("first <> word OR size(filter(words, x -> x = first)) > 1").drop("words")
        mixed = marked.where("org AND often")
    letters = F.col("initials") if partner is not None else F.array_union("initials", F.transform("words", lambda w: F.substring(w, 1, 1)))
    initial = of.select("node", "word", F.explode(letters).alias("letter")).select(F.xxhash64("word", F.concat(F.lit("."), "letter")).alias("key"), "node")
    return plain.unionAll(alone).unionAll(further.select(F.xxhash64("first", "word").alias("key"), "node")).unionAll(initial).unionAll(mixed.select(F.xxhash64("word", F.lit("+")).alias("key"), "node"))


def verified(pairs: DataFrame) -> DataFrame:
    """(a, b, kind, side): the candidate pairs that are spellings of one name, see names.compare_people."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = []
            for x, y in zip(pdf["na"], pdf["nb"]):
                if x["org"] or y["org"]:
                    least = names.ORGANISATIONS if x["org"] and y["org"] else names.UNSURE
                    kinds.append((names.compare_orgs(list(x["words"]), list(x["weights"]), list(y["words"]), list(y["weights"]), least), 0))
                else:
                    kinds.append(names.compare_people(list(x["words"]), list(x["initials"]), list(x["weights"]), list(y["words"]), list(y["initials"]), list(y["weights"])))
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "kind": [k for k, _ in kinds], "side": [s for _, s in kinds]})
            yield out[out["kind"] != names.NO]

    return pairs.mapInPandas(run, "a string, b string, kind int, side int")


def attach(of: DataFrame, links: DataFrame) -> DataFrame:
    """of: (node, c, parts). Components whose weak links, from their side as the shorter, lead to one other component join
    it. Only a component's fullest spellings speak for it: "Doe, E." of Eleanor Doe says nothing about L. E. Doe."""
    ends = links.where("side IN (-1, 0)").select("a", "b").unionAll(links.where("side IN (0, 1)").select("b", "a")).toDF("node", "other")
    fullest = of.groupBy("c").agg(F.max("parts").alias("most"))
    own = of.join(fullest, "c").where("parts = most").select("node", F.col("c").alias("own"))
    ends = ends.join(own, "node").join(of.select(F.col("node").alias("other"), F.col("c").alias("to")), "other")
    single = ends.where("own <> to").groupBy("own").agg(F.min("to").alias("to"), F.max("to").alias("last")).where("to = last")
    merged = components(single.select(F.col("own").alias("a"), F.col("to").alias("b")))
    return cut(of.join(merged.withColumnRenamed("id", "c"), "c", "left").select("node", F.coalesce("component", "c").alias("c"), "parts"))


def entities(values: DataFrame) -> DataFrame:
    """(value, entity) for the values that have words. values: (value) distinct."""
    rows = cut(parsed(values))
    nodes = rows.groupBy("node").agg(F.first("org").alias("org"), F.min("words").alias("words"), F.min("initials").alias("initials"))
    links = cut(verified(candidates(nodes)))
    comp = components(links.where(f"kind = {names.STRONG}").select("a", "b"))
    of = cut(nodes.select("node", F.size("words").alias("parts")).join(comp.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("c"), "parts"))
    for kind in (names.INITIAL, names.MISSING):
        of = attach(of, links.where(f"kind = {kind}"))
    return rows.select("value", "node").join(of, "node").select("value", F.col("c").alias("entity"))


def values_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "paper_metadata").select(F.col("creator").alias("value"))
    b = table(spark, sf_dir, "search_rows").select(F.col("authors").alias("value"))
    return a.unionAll(b).where("value IS NOT NULL AND value <> ''").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(entities(values_of(spark, sf_dir)))
    return (
        e.select(F.col("value").alias("name_a"), "entity").join(e.select(F.col("value").alias("name_b"), "entity"), "entity")
        .where("name_a < name_b").select("name_a", "name_b")
    )


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spelling: its entity, named by the smallest spelling, and how many spellings that has."""
    e = cut(entities(values_of(spark, sf_dir)))
    size = e.groupBy("entity").agg(F.min("value").alias("named"), F.count("*").alias("spellings"))
    return e.join(size, "entity").select(F.col("value").alias("name"), F.col("named").alias("entity_name"), "spellings")


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities}
SQL = {}
