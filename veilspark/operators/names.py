"""Person names: three passes over capitalised words, in order, each claiming what it finds.

The passes depend on what was claimed before, so this detector is plain Python behind an Arrow batch function; words are
found once and neighbours are looked up by index, so a text takes time in proportion to its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

_CAP = r"[A-ZÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ][0-9A-Za-z_À-ſ'-]*"
_WORD = re.compile(_CAP)
_TITLES = ("Docteur", "Dr.", "Dr", "Me", "Pr.", "Pr", "Professeur")
_CIVIL = ("Madame", "Mademoiselle", "M.", "Mme", "Monsieur")
_NAMED = re.compile(
    rf"(?<![0-9A-Za-z_])(?P<title>{'|'.join(sorted(map(re.escape, _TITLES + _CIVIL), key=len, reverse=True))})[ \t]+"
    rf"(?P<name>{_CAP}(?:[ \t]+(?:(?:van|von|du|des|de|le|la)[ \t]+)?{_CAP}){{0,2}})"
)
#: Capitals that are abbreviations of care and administration, never names.
ABBREVIATIONS = frozenset(
    "ADL AGGIR ALD AMP APA ASH AVC AVK BPCO CARSAT CCAS CPTS CRP CSE ECG ECPA EEG EHPAD EN ESAT ETP EVA EVS GCS GIR HAD HTA "
    "IADL IDE IDEC IDEL IDM IMC INR IPS IRA IRC IRM MDPH MMS MMSE MSP NFS PCH PRADO PTH RCP SAMSAH SSIAD TDM TSH UDAF VNI".split()
)
#: Common French first names, without accents; a caller may give a gazetteer of their own.
FIRST_NAMES = frozenset(
    """adele adrien agathe alain alban albert alexandra alexandre alexis alice aline amelie anais andre angele anne antoine antonin
    arnaud arthur aude audrey aurelie aurelien axel baptiste bastien beatrice benjamin benoit bernadette bernard bertrand brigitte
    bruno camille capucine carine carole caroline cecile chantal charles charlotte chloe christelle christian christiane christine
    christophe claire clara claude claudine clement clemence coline corentin corinne cyril damien daniel daniele david delphine denis
    denise didier dominique dylan edith edouard elena elisabeth elise elodie emile emilie emma emmanuel eric estelle etienne eva
    evelyne fabien fabienne fabrice fanny felix ferdinand flavien florence florian france francis franck francois francoise
    frederic gabriel gael gaelle gaston genevieve georges gerald gerard germaine ghislaine gilbert gilles ginette gisele guillaume
    guy helene henri herve hubert hugo huguette ines irene isabelle jacqueline jacques jean jeanne jeremy jerome joel joelle
    jordan josephine josette josiane julia julie julien juliette justine karine kevin laetitia laura laurence laurent lea leo leon
    liliane lilian lionel lisa loic lola louis louise luc lucas lucie lucien lucienne ludovic lydie madeleine manon marc marcel
    marcelle margaux marguerite maria marie marine marion marthe martine mathieu mathilde mathis maurice maxime melanie michel
    michele micheline mireille monique morgane myriam nadia nadine nathalie nathan nicolas nicole noemie odette odile olivier
    oscar pascal pascale patrice patricia patrick paul paulette pauline philippe pierre pierrette quentin rachel raphael raymond
    raymonde rene renee remi robert roger roland romain rosalie sabine sabrina samuel sandra sandrine sarah sebastien serge
    severine simon simone solange sonia sophie stephane stephanie suzanne sylvain sylvie theo therese thibault thierry thomas
    tristan valentin valerie vanessa veronique victor vincent virginie viviane xavier yann yannick yves yvette yvonne zoe""".split()
)


class _Claims:
    """Claimed ranges that don't overlap, sorted; asking and adding look at neighbours only."""

    def __init__(self):
        self.ranges: list[tuple[int, int]] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.ranges, (b, -1))
        return k == 0 or self.ranges[k - 1][1] <= a

    def add(self, a: int, b: int) -> None:
        insort(self.ranges, (a, b))


def _known(word: str, first_names: frozenset[str]) -> bool:
    low = word.lower()
    return low in first_names or ("-" in low and any(p in first_names for p in low.split("-")))


def _surname(confidence: float, name: str, first_names: frozenset[str]) -> str | None:
    """The family name of a sure mention: one word after a title, or of two the one that is no first name, else the second."""
    words = name.split()
    if len(words) == 1:
        return words[0] if confidence == 0.9 else None
    if len(words) != 2:
        return None
    return words[0] if _known(words[1], first_names) and not _known(words[0], first_names) else words[1]


def find_names(text: str | None, first_names: frozenset[str] = FIRST_NAMES) -> list[tuple[int, int, float]]:
    """(start, end, confidence) of names: after a title 0.9; first name with a neighbour 0.6, alone 0.5; known surname 0.6.

    A professional title is part of the name, another isn't, but both are claimed. Neighbours are a space or more away on
    the same line. First names are compared in lower case, accents and all.
    """
    if not text:
        return []
    out: list[tuple[int, int, float]] = []
    sources: list[tuple[float, str]] = []
    claims = _Claims()
    for m in _NAMED.finditer(text):
        a = m.start() if m["title"] in _TITLES else m.start("name")
        out.append((a, m.end(), 0.9))
        sources.append((0.9, m["name"]))
        claims.add(m.start(), m.end())
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]

    def beside(k: int, step: int) -> tuple[int, int] | None:
        """The next capitalised word on one side, if only spaces are between, it's free and no abbreviation."""
        j = k + step
        if not 0 <= j < len(words):
            return None
        a, b, w = words[j]
        gap = text[words[k][1] : a] if step > 0 else text[b : words[k][0]]
        if not gap or gap.strip(" ") or w in ABBREVIATIONS or not claims.free(a, b):
            return None
        return a, b

    for k, (a, b, w) in enumerate(words):
        if w in ABBREVIATIONS or not _known(w, first_names) or not claims.free(a, b):
            continue
        before, after = beside(k, -1), beside(k, 1)
        lo, hi = (before[0], b) if before else (a, after[1]) if after else (a, b)
        sure = 0.6 if before or after else 0.5
        out.append((lo, hi, sure))
        sources.append((sure, text[lo:hi]))
        claims.add(lo, hi)
    surnames = {s.lower() for c, n in sources if (s := _surname(c, n, first_names)) and s not in ABBREVIATIONS}
    if surnames:
        for k, (a, b, w) in enumerate(words):
            if w in ABBREVIATIONS or w.lower() not in surnames or not claims.free(a, b):
                continue
            after = beside(k, 1)
            hi = after[1] if after else b
            out.append((a, hi, 0.6))
            claims.add(a, hi)
    return sorted(out)
