"""Parsing and soft comparison of names typed by people: plain functions that run inside Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters that have no decomposition.
PLAIN = {"ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d", "ı": "i"}
TITLES = {"dr", "prof", "professor", "rev", "sir", "mr", "mrs", "ms", "phd", "md", "ed", "eds", "hrsg", "editor", "author", "jr", "sr", "dphil"}
PARTICLES = {"de", "la", "le", "du", "des", "del", "della", "di", "da", "dos", "das", "do", "von", "van", "der", "den", "ten", "ter", "zu", "zum", "zur", "af", "al", "el", "y"}
ORG_WORDS = {"board", "bd", "university", "univ", "universiteit", "institute", "inst", "centre", "center", "society", "soc", "soci", "laboratory", "lab", "labo", "department", "dept", "committee", "association", "assoc", "academy", "college", "group", "school", "faculty", "council", "foundation", "journal", "review", "press", "collective", "network", "project", "editors", "staff"}
FILLERS = {"of", "for", "the", "and", "in", "at", "on", "de", "von", "der", "u", "a", "an", "university", "univ", "universiteit", "universitat", "universite", "universidad", "universidade", "universita"}
#: Short forms of given names, one line per given name.
NICKNAMES = """
abigail abby; albert al bert; alexander alex sandy alec; alexandra alex sandra; alfred alf fred; alice allie; amanda mandy; andrew andy drew; angela angie
anthony tony; anton tony toni; antonia toni; arthur art artie; barbara barb babs; beatrice bea trixie; benjamin ben benny; bernard bernie; bradley brad; caroline carrie; catherine cathy kate katie kitty
charles charlie chuck chas; charlotte lottie; christina chris tina chrissy; christine chris; christopher chris kit topher; clara clare; cynthia cindy; daniel dan danny; david dave davey; deborah deb debbie
dennis den; dimitri dima mitya; donald don donnie; dorothy dot dottie dolly dory; douglas doug; edmund ed ned; edward ed eddie ned ted; edwin ed; eleanor ellie nell nora; elizabeth liz beth betty lizzie eliza bess libby
emil em; emily em; esther essie hettie; eugene gene; evelyn evie; florence flo flossie; frances fran fanny; francis frank fran; franziska franzi sissi; frederick fred freddie fritz rick; gabriel gabe; genevieve gen jenny viv
geoffrey geoff; george georgie; gerald gerry jerry; gertrude trudy; gilbert gil; giulia julia; gregory greg; hannah annie; hans hansi; harold harry hal; harriet hattie; heinrich heinz heini; helen nell nellie; henry harry hank hal; hiroshi hiro; hubert bert
ingrid inga; isabel izzy bella; isabella bella; jacob jake; jacqueline jackie; james jim jimmy jamie; jane janie; janet jan; jeffrey jeff; jennifer jen jenny; jerzy jurek; joan joanie; joanna jo anna; john jack johnny jon; jonathan jon jonny; joseph joe joey; josephine jo josie
josé pepe; joshua josh; juan juanito; judith judy jude; julia jules; katherine kate kathy katie; kathleen kathy; kamala kam; kenneth ken kenny; kerstin kersti; laura laurie; lawrence larry laurie; leonard len lenny leo; leopold leo; linda lin; louis lou; louise lou; lucía lucy; lucy lu
magdalena lena; margaret maggie peg peggy meg marge greta; maria mia; martha marty patty; martin marty; mary molly polly; matilda tilda; matthew matt matty; mehmet memo; michael mike mick micky; mildred millie; miriam mimi; mónica moni; nadia nadya; nancy nan
nathaniel nate nat; nathan nate; nicholas nick nicky; nikolai kolya nick; olga olya; pamela pam; patricia pat patty tricia trish; patrick pat paddy; paul paulie; peter pete; philip phil; philippa pip; priya pri; rachel rach; raymond ray; rebecca becky becca; renée ren; richard rick dick rich richie ricky; robert bob rob bobby robbie bert; roderick rod roddy rick
roger rodge; ronald ron ronnie; rosalind ros roz rosie; rosemary rose; rudolf rudi; russell russ; ruth ruthie; samantha sam; samuel sam sammy; sarah sally sadie; sebastian seb bastian; sergei serge seryozha; simone sim; simon si; sofia sophie; sophia sophie; stanley stan; stephanie steph; stephen steve; steven steve; susan sue susie suzy; suresh sur; susanna sue
tatiana tanya tania; teresa terry tess; theodore ted teddy theo; thomas tom tommy; timothy tim timmy; ulrike uli ulli rike; veronica ronnie; victor vic; victoria vicky tori vic; vincent vince vin vinny; virginia ginny; walter walt wally; wilhelm willi will; william bill will billy willy liam; winifred winnie; yasmin yas mina; yusuf yus; zachary zach zack zak; zoë zo
"""


def plain(text: str) -> str:
    """Entities resolved, accents and case removed, blanks collapsed."""
    s = text
    for _ in range(2):
        s = html.unescape(s)
    s = unicodedata.normalize("NFKD", s).casefold()
    s = "".join(PLAIN.get(c, c) for c in s if not unicodedata.combining(c))
    return " ".join(s.split())


def _nicknames() -> dict[str, frozenset[str]]:
    found: dict[str, set[str]] = {}
    for entry in re.split(r"[;\n]", NICKNAMES):
        if names := [plain(x) for x in entry.split()]:
            for short in names[1:]:
                found.setdefault(short, set()).add(names[0])
    return {k: frozenset(v) for k, v in found.items()}


SHORT = _nicknames()


def parse(value: str) -> tuple[bool, list[str], list[str]]:
    """(is an organisation, full words, initials or abbreviations with their dots removed)."""
    s = plain(value)
    s = re.sub(r"\[[^\]]*\]|\bet\.? ?al\b\.?|\bph\. ?d\b\.?|\bd\. ?phil\b\.?|\((eds?|hrsg|editors?)\.?\)", " ", s)
    s = re.sub(r"(?:[,;]\s*|\s)(?:eds?|hrsg)\.?\s*$", " ", s) if "," in s else s
    s = re.sub(r"['’`´]", "", s)
    found = re.findall(r"([^\W\d_]+|\d+)(\.?)", s)
    org = any(w in ORG_WORDS for w, _ in found)
    if org:
        return True, [w for w, _ in found if w not in FILLERS], []
    kept = [(w, dot) for w, dot in found if not (w in TITLES and (dot or w not in ("ed",)))]
    full = [w for w, _ in kept if len(w) > 1 and w not in PARTICLES]
    initials = [w for w, _ in kept if len(w) == 1]
    if not full:
        full = [w for w, _ in kept if len(w) > 1]
    return False, full, initials


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance with adjacent swaps, or limit + 1 if it is greater."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return limit + 1
        two, one = one, row
    return one[-1]


def fold(word: str) -> str:
    """Two ways of writing umlauts fall together."""
    return word.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def token_similarity(a: str, b: str) -> float:
    """1 equal, 0.85-0.95 typed wrong, 0.9 short form of the same given name, 0 else."""
    if a == b:
        return 1.0
    if fold(a) == fold(b):
        return 0.97
    n = min(len(a), len(b))
    if n >= 4 and (n >= 5 or a[0] == b[0]):
        limit = 2 if n >= 9 else 1
        d = osa(a, b, limit)
        if d <= limit:
            return 0.97 - 0.04 * d
    sa, sb = SHORT.get(a, frozenset()), SHORT.get(b, frozenset())
    if a in sb or b in sa or sa & sb:
        return 0.9
    return 0.0


def align(a: list[str], b: list[str]) -> tuple[list[tuple[int, int, float]], list[int], list[int]]:
    """Greedy one-to-one alignment by similarity; what is left of either side."""
    pairs = sorted(((token_similarity(x, y), -i, -j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    ua, ub, out = set(), set(), []
    for s, i, j in pairs:
        i, j = -i, -j
        if s <= 0:
            break
        if i not in ua and j not in ub:
            ua.add(i)
            ub.add(j)
            out.append((i, j, s))
    return out, [i for i in range(len(a)) if i not in ua], [j for j in range(len(b)) if j not in ub]


#: What the comparisons say: not the same; one side lacks a middle part; a given name stands as an initial; the same.
NO, MISSING, INITIAL, STRONG = 0, 1, 2, 3
#: Soft weighted similarity that names of people and of organisations, and names of which only one was taken as an
#: organisation's, must reach.
PEOPLE, ORGANISATIONS, UNSURE = 0.7, 0.75, 0.9
#: Weight of an initial, and how much of a word it stands for counts as found.
INITIAL_WEIGHT, INITIAL_SHARE = 1.0, 0.6


def similarity(wa: list[float], wb: list[float], pairs: list[tuple[int, int, float]], more: float = 0.0, parts: float = 0.0) -> float:
    """Soft weighted similarity: the weights of aligned words, each pair's times its likeness, as a share of all weights;
    `more` of `parts` further weight was found. Rare words weigh most."""
    total = sum(wa) + sum(wb) + parts
    return (sum((wa[i] + wb[j]) * s for i, j, s in pairs) + more) / total if total else 0.0


def compare_people(fa: list[str], ia: list[str], wa: list[float], fb: list[str], ib: list[str], wb: list[float]) -> tuple[int, int]:
    """(kind, side): side is -1 if a is the shorter spelling, 1 if b is, 0 if neither, 2 if each is shorter in a way.

    The soft weighted similarity of words and initials must reach PEOPLE, and parts must not contradict each other: the
    rarest word of either has its counterpart as a word, not both have parts left, and if no given name agrees as a word
    an initial must stand for the first of the other side's given names. STRONG: every part has its counterpart, at
    least one more as a word. INITIAL: every part has one, but all given names only as initials. MISSING: one side lacks
    one part. Words and their weights are in the order of the name.
    """
    if not fa or not fb:
        return NO, 0
    pairs, ra, rb = align(fa, fb)
    top_a, top_b = max(range(len(fa)), key=lambda i: wa[i]), max(range(len(fb)), key=lambda j: wb[j])
    if not any(i == top_a for i, _, _ in pairs) or not any(j == top_b for _, j, _ in pairs):
        return NO, 0
    edits = sum(1 for _, _, s in pairs if 0.5 < s < 0.965 and s != 0.9)
    if edits > 2 or edits == 2 and len(pairs) < 3 and min(len(fa[i]) for i, _, _ in pairs) < 5:
        return NO, 0
    first_a = min((i for i in ra if fa[i][0] in ib), default=-1)
    first_b = min((j for j in rb if fb[j][0] in ia), default=-1)
    rest_a, rest_b, short_a, short_b, more = list(ia), list(ib), 0, 0, 0.0
    for i in list(ra):  # a word against an initial
        if fa[i][0] in rest_b:
            rest_b.remove(fa[i][0])
            ra.remove(i)
            short_b += 1
            more += INITIAL_SHARE * (wa[i] + INITIAL_WEIGHT)
    for j in list(rb):
        if fb[j][0] in rest_a:
            rest_a.remove(fb[j][0])
            rb.remove(j)
            short_a += 1
            more += INITIAL_SHARE * (wb[j] + INITIAL_WEIGHT)
    common = 0
    for x in list(rest_a):
        if x in rest_b:
            rest_a.remove(x)
            rest_b.remove(x)
            common += 1
            more += 2 * INITIAL_WEIGHT
    left_a, left_b = len(ra) + len(rest_a), len(rb) + len(rest_b)
    if left_a and left_b or similarity(wa, wb, pairs, more, INITIAL_WEIGHT * (len(ia) + len(ib))) < PEOPLE:
        return NO, 0
    extra = left_a + left_b
    given_words = len(pairs) - 1
    side = (short_a < short_b) - (short_a > short_b)
    if not extra:
        return (STRONG if given_words >= 1 or not short_a and not short_b else INITIAL), side
    if extra > 1 or not given_words and not (short_a or short_b or common):
        return NO, 0
    if not given_words:  # initials come behind given names, so the side whose initial counts has no word left
        if short_a and (ra or rb and min(rb) < first_b) or short_b and (rb or ra and min(ra) < first_a):
            return NO, 0
        if not short_a and not short_b and (ra or rb or not (ia and ib and ia[0] == ib[0])):
            return NO, 0
        if short_a and left_a or short_b and left_b:
            return MISSING, 2
    return MISSING, 1 if left_a else -1


def abbreviates(x: str, y: str) -> bool:
    """Whether x is y cut short (its first two letters or more), or up to four of its letters from the first to the last."""
    if len(x) < 2 or len(x) >= len(y) or x[0] != y[0]:
        return False
    rest = iter(y)
    return y.startswith(x) or len(x) <= 4 and x[-1] == y[-1] and all(c in rest for c in x)


def compare_orgs(fa: list[str], wa: list[float], fb: list[str], wb: list[float], least: float = ORGANISATIONS) -> int:
    """STRONG or NO: the soft weighted similarity must reach `least`, and not both may have words left but fillers. Words
    may be typed wrong, cut short, or stand as their capitals."""
    pairs, ra, rb = align(fa, fb)
    capital = 0.0
    for own, other, left, right in ((fa, fb, ra, rb), (fb, fa, rb, ra)):  # capitals of the words left on the other side
        for i in list(left):
            letters = sorted(own[i])
            if 2 <= len(letters) <= len(right) and letters == sorted(other[j][0] for j in right if other[j] not in FILLERS):
                wo, wx = (wa, wb) if own is fa else (wb, wa)
                capital += 0.9 * (wo[i] + sum(wx[j] for j in right if other[j] not in FILLERS))
                left.remove(i)
                right[:] = [j for j in right if other[j] in FILLERS]
    for i in list(ra):
        for j in list(rb):
            if abbreviates(*sorted((fa[i], fb[j]), key=len)):
                pairs.append((i, j, 0.9))
                ra.remove(i)
                rb.remove(j)
                break
    filler = lambda w: w in FILLERS or len(w) > 5 and any(token_similarity(w, f) for f in FILLERS if len(f) > 5)
    more_a, more_b = [i for i in ra if not filler(fa[i])], [j for j in rb if not filler(fb[j])]
    if more_a or more_b:
        return NO
    kept_a, kept_b = [w for i, w in enumerate(wa) if i not in ra], [w for j, w in enumerate(wb) if j not in rb]
    found = sum((wa[i] + wb[j]) * s for i, j, s in pairs) + capital
    total = sum(kept_a) + sum(kept_b)
    return STRONG if total and found / total >= least else NO
