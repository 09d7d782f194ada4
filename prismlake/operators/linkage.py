"""Scoring of one record against candidates of bibliographic services, and the acceptance rules."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _near, decompose, link_form, one_edit, sequence_ratio, surname
from ..session import cut

#: Candidate types that agree with a source type.
COMPATIBLE = {
    "Book": ["book", "monograph", "reference-book", "edited-book"],
    "Review": ["article", "journal-article", "review", "peer-review"],
    "Article": ["article", "journal-article", "book-chapter", "proceedings-article", "posted-content", "preprint", "dissertation"],
}


def type_compatible(source_type: Column, candidate_type: Column) -> Column:
    c = F.replace(link_form(candidate_type), F.lit(" "), F.lit("-"))
    out = F.lit(False)
    for kind, allowed in COMPATIBLE.items():
        out = out | ((source_type == kind) & c.isin(allowed))
    return F.coalesce(out, F.lit(False))


def circular(journal: Column, provider: Column, own: str) -> Column:
    """A hit that only repeats the record's own source."""
    return F.coalesce((provider == "OpenAlex") & link_form(journal).contains(own), F.lit(False))


def year_ok(a: Column, b: Column, most: int = 2) -> Column:
    return a.isNull() | b.isNull() | (F.abs(a - b) <= most)


def score(similarity: Column, author: Column, a: Column, b: Column) -> Column:
    """0.84 title + 0.10 author + 0.06 year at most one apart."""
    year = F.coalesce(F.abs(a - b) <= 1, F.lit(False))
    return similarity * 0.84 + F.coalesce(author, F.lit(False)).cast("double") * 0.10 + year.cast("double") * 0.06


def accepted(similarity: Column, author: Column, authors: Column, a: Column, b: Column, compatible: Column, repeats: Column | None = None) -> Column:
    """Title at 0.94 or more, the author found (or no authors, the title equal and the years equal), years at most two
    apart, types compatible, and not `repeats` (see circular)."""
    author_ok = F.coalesce(author, F.lit(False)) | ((F.coalesce(authors, F.lit(0)) == 0) & (similarity == 1) & F.coalesce(a == b, F.lit(False)))
    own = F.lit(False) if repeats is None else repeats
    return F.coalesce((similarity >= 0.94) & author_ok & year_ok(a, b) & compatible & ~own, F.lit(False))


def accepted_legacy(similarity: Column, author: Column, a: Column, b: Column) -> Column:
    """The looser first rule: near-exact titles pass without the author."""
    return F.coalesce((similarity >= 0.94) & (F.coalesce(author, F.lit(False)) | (similarity >= 0.985)) & year_ok(a, b), F.lit(False))


def family_names(people: Column) -> Column:
    """The family names of people, in link form."""
    # a name's family in its raw form, then all at once in link form; line breaks keep them apart
    raw = F.transform(F.split(F.replace(F.coalesce(people, F.lit("")), F.lit("\n"), F.lit(" ")), ";"), lambda x: F.when(F.contains(x, F.lit(",")), F.substring_index(x, ",", 1)).otherwise(F.element_at(F.split(F.trim(x), " "), -1)))
    plain = decompose(F.array_join(raw, "\n"))
    return F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(F.lower(F.replace(x, F.lit("ß"), F.lit("ss"))), "[^a-z0-9]+", " ")))


def best_candidate(pairs: DataFrame, key: str, title: str, creator: str, year: str, other: str, people: str, other_year: str, candidate: str) -> DataFrame:
    """pairs with similarity, author_match and score, the best candidate of each record only (ties: the first by id)."""
    families = family_names(F.col(people))
    s = pairs.withColumn("similarity", sequence_ratio(link_form(F.col(title)), link_form(F.col(other)))).withColumn("own", surname(F.col(creator)))
    s = s.withColumn("author_match", F.coalesce((F.col("own") != "") & F.array_contains(families, F.col("own")), F.lit(False))).drop("own")
    s = s.withColumn("score", F.round(score(F.col("similarity"), F.col("author_match"), F.col(year), F.col(other_year)), 4))
    w = Window.partitionBy(key).orderBy(F.desc("score"), candidate)
    return s.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): equal words, and words one edit or swap apart. Such words share a form, themselves or themselves without one
    letter, so the join on the forms is exact. left: (a) distinct, right: (b) distinct."""
    less = lambda t: F.explode(F.expr(f"array_distinct(concat(array({t}), transform(sequence(1, length({t})), i -> concat(substr({t}, 1, i - 1), substr({t}, i + 1)))))")).alias("form")
    pairs = left.select("a", less("a")).join(right.select("b", less("b")), "form").select("a", "b").distinct()
    return pairs.where(one_edit("a", "b"))


def sharing_words(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """(key, other): pairs whose titles share a word, equal or, from four letters, one edit apart. left: (key, a), right: (other, b)."""
    near = near_words(left.select("a").distinct(), right.select("b").distinct()).where("a = b OR least(length(a), length(b)) >= 4")
    return left.join(near, "a").join(right, "b").select(key, other).distinct()


#: Titles of a block; every block of records meets every block of works.
RECORD_BLOCK, WORK_BLOCK = 1024, 4096
#: Scores are rounded to four digits, so a raw score this far below the best may still tie with it.
SLACK = 1.001e-4
GRAMS = 256
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


class _Forms(dict):
    """word -> the forms on which near_words joins; kept for the words met before."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 100_000:
            self.clear()
        out = self[word] = tuple({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})
        return out


def _share_word(a: list[str], b: list[str]) -> bool:
    """As sharing_words has it."""
    return not {*a}.isdisjoint(b) or any(len(x) >= 4 and len(y) >= 4 and _near(x, y) for x in a for y in b)


class _Words:
    """The titles of a block that share a word with a set of words, as sharing_words has it."""

    def __init__(self, of: list[list[str]], less: _Forms):
        self.less = less
        self.n = len(of)
        self.at: dict[str, list[int]] = {}
        for i, words in enumerate(of):
            for x in words:
                self.at.setdefault(x, []).append(i)
        self.forms: dict[str, list[str]] = {}
        for x in self.at:
            if len(x) >= 4:
                for f in less[x]:
                    self.forms.setdefault(f, []).append(x)
        self.alike: dict[str, set[str]] = {}

    def sharing(self, words: list[str]) -> np.ndarray:
        """True for each title that shares a word with them."""
        out = np.zeros(self.n, bool)
        for x in words:
            if x not in self.alike:
                near = {y for f in self.less[x] for y in self.forms.get(f, ()) if _near(x, y)} if len(x) >= 4 else set()
                self.alike[x] = near | ({x} & self.at.keys())
            for y in self.alike[x]:
                out[self.at[y]] = True
        return out


def _pack(rows: pd.DataFrame) -> bytes:
    """A block, its titles sorted by length."""
    rows = rows.iloc[np.argsort(rows["form"].str.len().to_numpy(), kind="stable")]
    year, least = rows["year"].to_numpy(np.float32, na_value=np.nan), rows["least"].to_numpy(np.float64, na_value=0.0)
    return pickle.dumps({"id": rows["id"].tolist(), "form": rows["form"].tolist(), "year": year, "people": rows["people"].map(list).tolist(), "words": rows["words"].map(list).tolist(), "least": least})


def _unpack(packed: bytes) -> dict:
    """The block with its letters as numbers (letters x titles), letters counted and, as `grams`, normalised trigram counts."""
    block = pickle.loads(packed)
    n, kinds = len(block["form"]), len(_LETTERS)
    sizes = np.array([len(f) for f in block["form"]], np.int64)
    place = np.zeros(128, np.uint8)
    place[[ord(c) for c in _LETTERS]] = np.arange(kinds)
    codes = np.full((n, int(sizes.max(initial=0))), kinds, np.uint8)
    inside = np.arange(codes.shape[1]) < sizes[:, None]
    codes[inside] = place[np.frombuffer("".join(block["form"]).encode("ascii"), np.uint8)]
    title = np.broadcast_to(np.arange(n)[:, None], codes.shape)[inside]
    block |= {"size": sizes, "codes": np.ascontiguousarray(codes.T), "counts": np.bincount(title * kinds + codes[inside], minlength=n * kinds).reshape(n, kinds)}

    def grams() -> np.ndarray:
        c, some = codes.astype(np.int64), inside[:, 2:]
        h = (c[:, :-2] * kinds**2 + c[:, 1:-1] * kinds + c[:, 2:]) * 2654435761 % 2**32 * GRAMS // 2**32
        t = np.broadcast_to(np.arange(n)[:, None], h.shape)
        out = np.bincount(t[some] * GRAMS + h[some], minlength=n * GRAMS).reshape(n, GRAMS).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return block | {"grams": grams}


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(name BINARY), one row for each block of about `size` rows. rows: (id, form, year, people, words, least)."""
    n = max(1, -(-rows.count() // size))
    pack = lambda pdf: pd.DataFrame({name: [_pack(pdf)]})
    return cut(rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n))).applyInPandas(pack, f"{name} binary"))


def _common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that each title of a has in common with each of b, in any order: as a product of 'has this letter k times'."""
    left, right = [], []
    for c in range(a.shape[1]):
        for k in range(1, min(a[:, c].max(initial=0), b[:, c].max(initial=0)) + 1):
            left.append(a[:, c] >= k)
            right.append(b[:, c] >= k)
    if not left:
        return np.zeros((len(a), len(b)), np.float32)
    return np.array(left, dtype=np.float32).T @ np.array(right, dtype=np.float32)


def common_subsequence(a: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a with each column of codes (letters x titles, titles by size), by bits:
    a letter of a is a bit, and one addition moves the row of all titles on by a letter."""
    full = (1 << 64) - 1
    parts = -(-len(a) // 64)
    masks = np.zeros((parts, len(_LETTERS) + 1), np.uint64)
    for c in np.unique(a):
        bits = sum(1 << int(i) for i in np.flatnonzero(a == c))
        masks[:, c] = [bits >> (64 * p) & full for p in range(parts)]
    state = np.full((parts, len(sizes)), full, np.uint64)
    starts = np.searchsorted(sizes, np.arange(len(codes)), "right")
    codes = codes.astype(np.intp)
    for j, start in enumerate(starts):
        if start == len(sizes):
            break
        letter, carry = codes[j, start:], None
        for p in range(parts):
            v = state[p, start:]
            u = masks[p].take(letter, mode="clip")
            u &= v
            s = v + u
            over = s < u if parts > 1 else None
            if carry is not None:
                s += carry
                over |= s < carry
            v -= u
            v |= s
            carry = over.astype(np.uint64) if parts > 1 else None
    last = len(a) - 64 * (parts - 1)
    out = np.full(len(sizes), len(a))
    for p in range(parts):
        out -= np.bitwise_count(state[p] & np.uint64(full if p < parts - 1 else (1 << last) - 1))
    return out


def _compare(r: dict, w: dict, least: np.ndarray, seeds: bool, less: _Forms) -> Iterator[tuple[int, int, float]]:
    """(record's place, work's place, raw score) of pairs of two blocks that share a word. least: the best raw score of each
    record so far, which is raised. seeds: of each record only the work with the likest trigrams; else all works that are
    not out of reach, so the best is among them."""
    from difflib import SequenceMatcher

    bonus = np.where(np.abs(r["year"][:, None] - w["year"][None, :]) <= 1, np.float32(0.06), np.float32(0))
    of: dict[str, list[int]] = {}
    for j, names in enumerate(w["people"]):
        for x in set(names):
            of.setdefault(x, []).append(j)
    for i, (x,) in enumerate(r["people"]):
        if x and x in of:
            bonus[i, of[x]] += np.float32(0.10)

    def scored(i: int, j: int) -> float:
        return SequenceMatcher(None, r["form"][i], w["form"][j]).ratio() * 0.84 + float(bonus[i, j])

    if seeds:
        for i, j in enumerate((r["grams"]() @ w["grams"]().T + bonus).argmax(axis=1).tolist()):
            most = 1.68 * np.minimum(r["counts"][i], w["counts"][j]).sum() / max(1, r["size"][i] + w["size"][j]) + bonus[i, j]
            if most > least[i] and _share_word(r["words"][i], w["words"][j]):
                least[i] = max(least[i], s := scored(i, j))
                yield i, j, s
        return
    # twice the matching letters by the sum of lengths, times 0.84; matching letters are at most the common ones
    per = np.float32(1.68) / np.maximum(r["size"][:, None] + w["size"][None, :], 1).astype(np.float32)
    bar = (least - SLACK - 1e-5).astype(np.float32)
    words = _Words(w["words"], less)
    near = _common_letters(r["counts"], w["counts"]) * per + bonus >= bar[:, None]
    for i in np.flatnonzero(near.any(axis=1)):
        at = np.flatnonzero(near[i] & words.sharing(r["words"][i]))
        if not len(at):
            continue
        most = common_subsequence(r["codes"][: r["size"][i], i], w["codes"][:, at], w["size"][at]) * per[i, at] + bonus[i, at]
        for k in np.argsort(-most, kind="stable"):
            if most[k] < least[i] - SLACK - 1e-5:
                break
            s = scored(i, int(at[k]))
            if s >= least[i] - SLACK:
                least[i] = max(least[i], s)
                yield i, int(at[k]), s


def promising(left: DataFrame, right: DataFrame) -> DataFrame:
    """(record, work): of the pairs that share a word, those that can hold a record's best score; each record's best are
    among them. left: (id, form, year, people: one surname, words), right: (id, form, year, people, words), ids of records
    and works; forms are titles in link form.

    Two passes over all pairs of blocks. The first scores, of each block of works, the one with the likest trigrams; the
    best of these is a bar. The second scores the pairs which their common letters and then their longest common subsequence
    don't keep below the bar: the matching letters of the ratio are a common subsequence.
    """
    works = _blocks(right.withColumn("least", F.lit(0.0)), WORK_BLOCK, "w")
    kinds = f"record {dict(left.dtypes)['id']}, work {dict(right.dtypes)['id']}, score double"

    def passed(records: DataFrame, seeds: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, r, least, less = None, {}, np.empty(0), _Forms()
            for pdf in batches:
                for packed, other in zip(pdf["r"], pdf["w"]):
                    if packed != last:
                        last, r = packed, _unpack(packed)
                        least = r["least"].copy()
                    w = _unpack(other)
                    got = [(r["id"][i], w["id"][j], i, s) for i, j, s in _compare(r, w, least, seeds, less)]
                    yield pd.DataFrame([(a, b, s) for a, b, i, s in got if seeds or s >= least[i] - SLACK], columns=["record", "work", "score"])

        blocks = _blocks(records, RECORD_BLOCK, "r")
        n = max(1, blocks.count())
        own = blocks.repartitionByRange(n, F.xxhash64("r"))  # a block a task
        return own.crossJoin(works.coalesce(1)).mapInPandas(run, kinds)

    first = passed(left.withColumn("least", F.lit(0.0)), True).groupBy("record").agg(F.max("score").alias("least")).withColumnRenamed("record", "id")
    return passed(left.join(first, "id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))), False).select("record", "work")


def precedence(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, used): the first source's accepted value, else the second's, else null."""
    j = first.select(key, F.col(value).alias("v1")).join(second.select(key, F.col(value).alias("v2")), key, "full")
    return j.select(key, F.coalesce("v1", "v2").alias(value), F.when(F.col("v1").isNotNull(), 1).when(F.col("v2").isNotNull(), 2).alias("used"))
