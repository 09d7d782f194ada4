"""Names: parsing, comparison, and entities from a small table."""

import pytest

from prismlake.llm import names as N
from prismlake.llm import p1_names as P


def kind(a, b):
    (oa, fa, ia), (ob, fb, ib) = N.parse(a), N.parse(b)
    rare = lambda w: 9.0 if w not in {"jane", "john", "richard", "rick", "emil", "maria"} else 3.0
    if oa or ob:
        return N.compare_orgs(fa, list(map(rare, fa)), fb, list(map(rare, fb))) if oa and ob else N.NO
    return N.compare_people(fa, ia, list(map(rare, fa)), fb, ib, list(map(rare, fb)))[0]


@pytest.mark.parametrize("a, b, want", [
    ("Krasada, Jane M.", "JANE M. KRASADA", N.STRONG), ("Krasada, Jane", "Krasda, Jane", N.STRONG), ("Krasada, Richard", "Krasada, Rick, Dr.", N.STRONG), ("Naiñaro, Jane", "Nai&ntilde;aro,\xa0Jane (ed.)", N.STRONG),
    ("Krasada, J.", "Krasada, Jane", N.INITIAL), ("Krasada, J. M.", "Krasada, Jane Maria", N.INITIAL), ("Krasada, Jane", "Krasada, Jane M.", N.MISSING), ("de la Krasada, Jane", "Krasada, Jane", N.STRONG),
    ("Krasada, Jane", "Krasada, John", N.NO), ("Krasada, Jane M.", "Krasada, Jane K.", N.NO), ("Krasada, Maria J.", "Krasada, Jane", N.NO), ("Krasada, Jane", "Belou, Jane", N.NO), ("Krasada, Jane", "", N.NO),
    ("Institute for Applied Ethics, Jestou University", "Inst. for App. Ethics (Jestou)", N.STRONG), ("Laboratory for Comparative Ethics, Jestou University", "LCE, Jestou University", N.STRONG),
    ("Dept of Logic, Jestou Universität", "Department of Logic (Jestou)", N.STRONG), ("Centre of Ethics, Slainspemimba", "Centre of Ethics, Slainimba", N.NO), ("Society for Comparative Semantics, Jestou University", "SCS, Jestou University", N.STRONG),
    ("Centre for Applied Ethics, Jestou University", "Laboratory for Applied Ethics, Jestou University", N.NO), ("Editorial Board, Velmora Review", "Velmora Reveiw, Editorial Bd.", N.STRONG),
])
def test_compare(a, b, want):
    assert kind(a, b) == want
    assert kind(b, a) == want


def test_distance():
    assert [N.osa(a, b, 2) for a, b in (("ab", "ba"), ("abc", "abc"), ("abc", "abd"), ("abc", "xyz"), ("", "ab"))] == [1, 0, 1, 3, 2]


def names_of(frame, values):
    return frame([(v,) for v in values], "value string")


def test_entities(frame):
    values = ["Krasada, Jane M.", "Jane M. Krasada", "KRASADA, JANE M.", "Krasadda, Jane M.", "Krasada, J. M.", "Krasada, John", "Krasada, Jane K.", "Belou, Emil", "Belou,  Emil", "Emil, Belou", "Belou, E.", "Torvik, Jane", "Torvik, John", "Torvik, J.", "...", "Quu"]
    values += [f"{x}{y}osk, {g}" for x in "BDFGKLMNPRST" for y in ("ai", "ou", "ie") for g in ("Jane", "John", "Emil")]  # given names are common
    got = {r["value"]: r["entity"] for r in P.entities(names_of(frame, values)).collect()}
    assert len({got[v] for v in values[:5]}) == 1
    assert len({got["Krasada, John"], got["Krasada, Jane K."], got[values[0]]}) == 3
    assert len({got[v] for v in ("Belou, Emil", "Belou,  Emil", "Emil, Belou", "Belou, E.")}) == 1
    assert len({got["Torvik, Jane"], got["Torvik, John"], got["Torvik, J."]}) == 3  # nobody's initial for sure
    assert "..." not in got


def test_similarity_counts_rare_words_more():
    assert N.similarity([9.0, 3.0], [9.0, 3.0], [(0, 0, 1.0)]) == 0.75 and N.similarity([9.0, 3.0], [9.0, 3.0], [(1, 1, 1.0)]) == 0.25
    assert N.similarity([], [], []) == 0.0
    assert N.compare_people(["krasada", "jane"], [], [9.0, 3.0], ["krasada", "jane", "constantina"], [], [9.0, 3.0, 20.0])[0] == N.NO  # too much weight is missing


def test_hot_word_needs_a_second_part(frame):
    """A surname that many bear gives the same entities when it makes candidates only together with a second part."""
    people = ["Jane", "John", "Emil", "Maria", "Rebecca", "Becca", "Rebeca", "Olga M.", "Olga", "T.", "Theodore", "Th.", "E. M."]
    values = [f"Krasada, {g}" for g in people] + [f"{g} Krasda" for g in people[:6]] + ["Krasada", "Krasadaa", "Institute of Krasada", "Inst. of Krasada"]
    rows = P.parsed(names_of(frame, values)).select("node", "org", "words", "initials").dropDuplicates(["node"])
    linked = lambda hot: {(r["a"], r["b"], r["kind"]) for r in P.verified(P.candidates(rows, hot=hot)).collect()}
    assert linked(2) == linked(10**9) and len(linked(2)) > 10


def test_hot_word_loses_nothing(frame):
    """Organisations still meet people that have a hot word, as do names in which a word stands twice."""
    import random

    rng = random.Random(5)
    values = ["University of Hanson", "Hanson", "Hansson", "Max Krasada Institute", "Max Krasada Insitute", "Hanson Hanson", "Hansen Hansen", "Hanson, H.", "Hansen Hanson", "Krasada Krasada, J."]
    values += [" ".join(rng.choice(["Hanson", "Hansen", "Hannson", "Krasada", "Krasda", "J.", "Jane", "Jon", "John", "University", "Inst.", "H."]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = P.parsed(names_of(frame, [*dict.fromkeys(values)])).select("node", "org", "words", "initials").dropDuplicates(["node"])
    linked = lambda hot: {(r["a"], r["b"], r["kind"]) for r in P.verified(P.candidates(rows, hot=hot)).collect()}
    every = linked(10**9)
    assert {("Ohanson|", "hanson|"), ("hansen hansen|", "hanson hanson|")} <= {x[:2] for x in every}
    assert linked(1) == every


def test_umlauts_of_short_words(frame):
    got = {(r["x"], r["y"]) for r in P.similar_words(frame([("bar",), ("baer",), ("mueller",), ("muller",), ("bur",)], "word string")).collect()}
    assert got == {("bar", "baer"), ("baer", "bar"), ("mueller", "muller"), ("muller", "mueller")}


def test_empty(frame):
    assert P.entities(names_of(frame, [])).collect() == []


def test_similar_words_is_whole(frame):
    import random
    import string

    rnd = random.Random(5)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(4, 7))) for _ in range(250)} | {"schroedinger", "schrodinger"}
    got = {(r["x"], r["y"]) for r in P.similar_words(frame([(w,) for w in words], "word string")).collect()}
    want = {(a, b) for a in words for b in words if a != b and N.osa(a, b, 1) <= 1}
    assert got == want
    assert string.ascii_lowercase


def test_found_from_tables(spark, tmp_path):
    from conftest_llm import write

    write(spark, tmp_path, "paper_metadata", [("Krasada, Jane", 1), (None, 2), ("", 3), ("Krasada, Jane", 4)], "creator string, authors int")
    write(spark, tmp_path, "search_rows", [("JANE KRASADA", "x"), ("Belou, Emil", "y"), (None, "z")], "authors string, creator string")
    assert [tuple(r) for r in P.p1_found(spark, str(tmp_path)).collect()] == [("JANE KRASADA", "Krasada, Jane")]


def test_similar_words_as_the_verifier_takes_them(frame):
    import random

    r = random.Random(1)
    words = {"kangakaaaro", "kangakaro", "zhaiiindadach", "zhaindadach", "siimrerzeen", "simrerzen", "vilkarell", "vilkrsell", "abcdefghi", "badcefghi", "abcdefgh", "abcdefgihj"}
    for _ in range(60):
        w = "".join(r.choices("abkr", k=r.randint(4, 12)))
        words.add(w)
        for _ in range(3):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
            words.add(w)
    words = {w for w in words if len(w) >= 4}
    got = [(r["x"], r["y"]) for r in P.similar_words(frame([(w,) for w in sorted(words)], "word string")).collect()]
    want = {(a, b) for a in words for b in words if a != b and N.osa(a, b, 2) <= (2 if min(len(a), len(b)) >= 9 else 1)}
    assert len(got) == len(set(got)) and set(got) == want


def test_two_errors_in_a_long_surname(frame):
    values = ["Kangakaaaro, Stephen", "Kangakaro, Stephen", "Vilkarell, Kamala G.", "Vilkrsell, Kamala G.", "Vilkarell, John"]
    values += [f"{x}{y}osk, {g}" for x in "BDFGKLMNPRST" for y in ("ai", "ou", "ie") for g in ("Stephen", "Kamala", "John")]  # given names are common
    got = {r["value"]: r["entity"] for r in P.entities(names_of(frame, values)).collect()}
    assert got["Kangakaaaro, Stephen"] == got["Kangakaro, Stephen"] and got["Vilkarell, Kamala G."] == got["Vilkrsell, Kamala G."] != got["Vilkarell, John"]
