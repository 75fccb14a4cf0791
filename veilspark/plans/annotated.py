"""Annotated corpora of several entities a text, in SQL that Spark and DuckDB both run.

A template is a list of parts: plain SQL of a string, or (gold, found, SQL). `gold` is the annotated type of the part and
`found` the type that the detectors' rules give it, None for neither; "+type" goes on with the span of the part before.
So what is found is written down here by the rules, part by part, misses and false positives with it.
"""

from __future__ import annotations

from .corpus_sql import _IBAN_GROUPS, _NIR_GROUPS, IDS, groups, luhn_digit, padded


def pick(values: list[str], by: str) -> str:
    quoted = [v.replace("'", "''") for v in values]
    return f"(case ({by}) % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(quoted)) + " end)"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"
SURNAME = pick(["Valmont", "Ferrant", "Delorme", "Garnier", "Perrault", "Marchal", "Humbert"], "k")
OTHER = pick(["Lacombe", "Briand", "Fournel", "Aubertin", "Thiriet"], "k")
MAN, WOMAN = pick(["Thomas", "Julien", "Paul", "Nicolas"], "k"), pick(["Julie", "Nadia", "Claire", "Sophie"], "k")
FOREIGN = pick(["Aminata", "Yousef", "Linh", "Oksana"], "k")
HOME = pick(["Foyer Les Tilleuls", "EHPAD Bellevue", "IME des Coquelicots", "SSIAD du Val"], "k")
NAMED_HOME = pick(["Hôpital Lariboisière", "Clinique Pasteur", "Centre Hospitalier Charcot"], "k")
DISEASE = pick(["maladie de Charcot", "maladie de Parkinson", "maladie de Crohn"], "k")
SIGN = pick(["AGGIR", "GIR", "MMS", "CPTS"], "k")
TEL = f"concat('0', {padded('100000000 + k * 7919 % 800000000', 9)})"
TEL_BLANK, TEL_DOT = groups(TEL, [2, 2, 2, 2, 2], " "), groups(TEL, [2, 2, 2, 2, 2], ".")
TEL_ABROAD = f"concat('+33 ', {groups(f'substring({TEL}, 2, 9)', [1, 2, 2, 2, 2], ' ')})"
DAY, MONTH = padded("1 + k % 28", 2), padded("1 + k % 12", 2)
BIRTH = f"concat({DAY}, '/', {MONTH}, '/', cast(1930 + k % 80 as string))"
BIRTH_WORDS = f"concat(cast(1 + k % 28 as string), ' mars ', cast(1930 + k % 80 as string))"
BIRTH_ISO = f"concat(cast(1930 + k % 80 as string), '-', {MONTH}, '-', {DAY})"
STREET = f"concat(cast(1 + k % 180 as string), {pick([' rue des Lilas', ' avenue du Parc', ' chemin Vert'], 'k')})"
TOWN = f"concat({padded('10000 + k % 80000', 5)}, {pick([' Metz', ' Thionville', ' Vesoul'], 'k')})"
MAIL, MAIL_SUB, MAIL_TAG = (f"concat('usager', cast(k as string), '{at}')" for at in ("@exemple.fr", "@mail.exemple.fr", "+dossier@exemple.fr"))
SIREN = f"concat(concat('81', {padded('k * 15485863 % 1000000', 6)}), {luhn_digit('concat(' + text('81') + ', ' + padded('k * 15485863 % 1000000', 6) + ')', 8)})"
WRONG_NIR = f"concat(nir13, {padded('(97 - cast(nir13 as bigint) % 97) % 97 + 1', 2)})"
WRONG_RPPS = "concat(substring(rpps, 1, 10), cast((cast(substring(rpps, 11, 1) as int) + 1) % 10 as string))"


def both(kind: str, sql: str) -> tuple[str, str, str]:
    return kind, kind, sql


TEMPLATES: dict[str, list[list]] = {
    # identifiers with check digits, several in a text; company numbers pass the establishment check: false positives
    "structural": [
        [text("Assuré "), both("nir", "nir"), text(" suivi par le praticien "), both("rpps", "rpps"), text(", structure FINESS "), both("finess", "finess"), text(".")],
        [text("Règlement de la structure "), both("finess", "finess"), text(" sur le compte "), both("iban", groups("iban", _IBAN_GROUPS, " ")), text(" sous huit jours.")],
        [text("Entreprise SIREN "), (None, "finess", SIREN), text(", compte "), both("iban", "iban"), text(".")],
        [text("NIR "), both("nir", groups("nir", _NIR_GROUPS, "  ")), text(" et RPPS "), both("rpps", groups("rpps", [2, 3, 3, 3], " ")), text(" au dossier.")],
        [text("Le numéro "), WRONG_NIR, text(" est faux, de même que "), WRONG_RPPS, text("; seul "), both("finess", "finess"), text(" reste.")],
        [text("Ayant droit "), both("nir", groups("nir", _NIR_GROUPS, ".")), text(" puis "), both("nir", groups("nir", _NIR_GROUPS, "-")), text(" ; le lot 1234 et la salle 42 sont libres.")],
    ],
    "realistic": [
        [text("Compte rendu de la réunion du "), SIGN, text(". Présents :"), NL, text("- M. "), both("nom", f"concat({MAN}, ' ', {SURNAME})"), text(", référent"), NL, text("- Mme "), both("nom", f"concat({WOMAN}, ' ', {OTHER})"), NL, text("Lieu : "), both("etablissement", HOME), NL, text("contact "), both("email", MAIL), text(" / "), both("telephone", TEL_BLANK), text(".")],
        [text("Objet : admission"), NL, text("Mme "), both("nom", f"concat({WOMAN}, ' ', {SURNAME})"), text(", née le "), both("date_naissance", BIRTH), text(","), NL, text("domiciliée "), both("adresse", f"concat({STREET}, {NL}, {TOWN})"), text(","), NL, text("admise, foyer attribué."), NL, both("etablissement", HOME), (None, "+etablissement", text(" à")), text(" compter du 05/09/2026.")],  # small letters with accents begin words too
        [text("Transmission du 14/07/2026, équipe de nuit. Visite du "), both("nom", f"concat('Dr ', {SURNAME})"), text(" ce matin. La famille ("), both("telephone", TEL_DOT), text(") a été prévenue. Transfert vers "), both("etablissement", NAMED_HOME), text(".")],
        [text("Entre "), both("etablissement", HOME), text(", d'une part,"), NL, text("et M. "), both("nom", f"concat({MAN}, ' ', {SURNAME})"), text(", né le "), both("date_naissance", BIRTH_WORDS), text(", demeurant "), both("adresse", f"concat({STREET}, ', ', {TOWN})"), text(", joignable au "), both("telephone", TEL_BLANK), text(".")],
        [text("De : "), both("email", MAIL), NL, text("à : "), both("email", MAIL_SUB), NL, text("comme convenu avec M. "), both("nom", f"concat({MAN}, ' ', {OTHER})"), text(", les éléments concernant "), both("etablissement", HOME), text(". La visite du 12/09/2026 est confirmée.")],
    ],
    "adversarial": [
        # capitals and reversed order: a first name in the list makes the pair, whatever its case
        [text("dossier suivi par "), both("nom", f"concat(upper({SURNAME}), ' ', {MAN})"), text(". Note transmise à "), both("nom", f"concat(upper({WOMAN}), ' ', upper({OTHER}))"), text(" pour suite.")],
        # an eponym is no person and isn't taken for one; the place named after one is a place
        [text("M. "), both("nom", f"concat({MAN}, ' ', {pick(['Boulanger', 'Berger', 'Loyer'], 'k')})"), text(" présente une "), DISEASE, text(", bilan fait à "), both("etablissement", NAMED_HOME), text(". Le montant du loyer reste inchangé.")],
        # an initial is no first name; a particle goes on with the name; compounds are known by their parts
        [text("présent : "), ("nom", None, f"concat(substring({MAN}, 1, 1), '. ', {SURNAME})"), NL, text("excusé : Monsieur "), both("nom", text("Jean de La Fontaine")), NL, text("suppléant : "), both("nom", f"concat({MAN}, '-', {WOMAN}, ' ', {OTHER})"), NL],
        # first names that the list lacks are missed without a title
        [text("le dossier de "), ("nom", None, f"concat({FOREIGN}, ' ', {OTHER})"), text(" est incomplet ; appeler le "), both("telephone", TEL_ABROAD), text(".")],
        # what follows the town is not part of what is found
        [text("adresse de facturation :"), NL, both("adresse", f"concat({STREET}, {NL}, {TOWN})"), ("+adresse", "+adresse", text(" CEDEX")), ("+adresse", None, text(" 9")), NL, text("montant : 70000 euros de travaux, référence 21000.")],
        # dates the other way round are not read
        [text("joindre "), both("telephone", TEL), text(" ou "), both("email", MAIL_TAG), text(", née le "), ("date_naissance", None, BIRTH_ISO), text(". Échéance : 05/08/2026.")],
        # a street named after a person, without a postcode, is missed
        [text("réunion tenue à "), both("etablissement", NAMED_HOME), text(", située "), ("adresse", None, text("place du Marché")), text(". animée par M. "), both("nom", f"concat({MAN}, ' ', {SURNAME})"), text(".")],
    ],
    "witness": [
        [text("Le patient présente une "), DISEASE, text(". Évaluation par la grille "), SIGN, text(", score inchangé.")],
        [text("Le devis est de 70000 euros hors taxes. Référence interne 21000, dossier 39100. Urgences : 15, 112, 3949 et 39 77.")],
        [text("Facture du 05/07/2026, échéance au 05/08/2026, livraison le 12/07/2026. Aucune de ces dates ne compte.")],
        [text("Le loyer et les charges sont dus au 5 de chaque mois. Le boulanger et le berger sont venus à 14 h. Lot "), WRONG_RPPS, text(".")],
    ],
}


def _places(corpus: str, side: int) -> list[tuple[int, str, int, int]]:
    """(template, type, parts before the start, parts up to the end) of gold (0) or found (1) spans."""
    out = []
    for t, parts in enumerate(TEMPLATES[corpus]):
        for k, p in enumerate(parts):
            kind = p[side] if isinstance(p, tuple) else None
            if kind and kind.startswith("+"):
                out[-1] = (*out[-1][:3], k + 1)
            elif kind:
                out.append((t, kind, k, k + 1))
    return out


def _sql(part: str | tuple) -> str:
    return part[2] if isinstance(part, tuple) else part


def _spans(corpus: str, side: int) -> list[tuple[int, str, str, str]]:
    """(template, type, SQL of the start, SQL of the end) of gold (0) or found (1) spans."""

    def at(t: int, k: int) -> str:
        return f"cast(length(concat({', '.join(map(_sql, TEMPLATES[corpus][t][:k]))})) as int)" if k else "0"

    return [(t, kind, at(t, i), at(t, j)) for t, kind, i, j in _places(corpus, side)]


def in_one_pass(corpus: str) -> str:
    """docs (doc_id, text, gold), gold an array of (type, start, end), of every customer, for Spark; prepend WITH.

    The texts and gold spans of `ctes`, whose SQL reads the customers, and joins them with themselves, once for every span of
    a template. Customer keys are unique.
    """
    base = f"base AS (SELECT *, substring(nir, 1, 13) AS nir13, cast(floor(k / 2) as bigint) % {len(TEMPLATES[corpus])} AS template FROM ids WHERE k IS NOT NULL)"
    parts = " ".join(f"when {t} then array({', '.join(map(_sql, p))})" for t, p in enumerate(TEMPLATES[corpus]))
    by: dict[int, list[str]] = {}
    for t, kind, i, j in _places(corpus, 0):
        by.setdefault(t, []).append(f"named_struct('type', '{kind}', 'i', {i}, 'j', {j})")
    places = " ".join(f"when {t} then array({', '.join(p)})" for t, p in by.items())
    at = "cast(length(array_join(slice(parts, 1, {}), '')) as int)".format
    gold = f"transform(case template {places} end, g -> named_struct('type', g.type, 'start', {at('g.i')}, 'end', {at('g.j')}))" if by else "cast(null as array<struct<type:string,start:int,`end`:int>>)"
    return f"{IDS}, {base}, pieces AS (SELECT k, template, case template {parts} end AS parts FROM base), docs AS (SELECT k AS doc_id, array_join(parts, '') AS text, {gold} AS gold FROM pieces)"


def ctes(corpus: str) -> str:
    """docs (doc_id, text), gold and found (doc_id, type, start_at, end_at) of every customer; prepend WITH."""
    n = len(TEMPLATES[corpus])
    base = f"base AS (SELECT i.*, c.nir13, cast(floor(i.k / 2) as bigint) % {n} AS template FROM ids i JOIN ids0 c ON i.k = c.k)"
    whole = " ".join(f"when {t} then concat({', '.join(map(_sql, parts))}, '')" for t, parts in enumerate(TEMPLATES[corpus]))

    def rows(side: int) -> str:
        each = [f"SELECT k AS doc_id, '{kind}' AS type, {lo} AS start_at, {hi} AS end_at FROM base WHERE template = {t}" for t, kind, lo, hi in _spans(corpus, side)]
        return " UNION ALL ".join(each) or "SELECT k AS doc_id, '' AS type, 0 AS start_at, 0 AS end_at FROM base WHERE false"

    return f"{IDS}, {base}, docs AS (SELECT k AS doc_id, case template {whole} end AS text FROM base), gold AS ({rows(0)}), found AS ({rows(1)})"
