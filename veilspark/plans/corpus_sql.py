"""Annotated corpora from the customer table, in SQL that Spark and DuckDB both run.

Every text is prefix, value and suffix, so where its entity stands is known. Identifiers get valid check digits, in three
ways of writing; `TRAPS` have broken ones, and near misses, and hold nothing to find.
"""

from __future__ import annotations


def digit_at(s: str, i: int) -> str:
    return f"cast(substring({s}, {i}, 1) as int)"


def luhn_digit(s: str, n: int) -> str:
    """The check digit of an expression of n digits."""
    terms = []
    for i in range(1, n + 1):
        d = digit_at(s, i)
        terms.append(f"(case when 2 * {d} > 9 then 2 * {d} - 9 else 2 * {d} end)" if (n - i) % 2 == 0 else d)
    return f"cast((10 - ({' + '.join(terms)}) % 10) % 10 as string)"


def mod97(s: str, n: int) -> str:
    """An expression of n digits modulo 97, ten digits at a time."""
    out = f"cast(substring({s}, 1, 10) as bigint) % 97"
    for i in range(11, n + 1, 10):
        out = f"cast(concat(cast({out} as string), substring({s}, {i}, 10)) as bigint) % 97"
    return out


def padded(x: str, n: int) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


IDS = f"""
ids0 AS (
  SELECT c_custkey AS k, c_custkey % 10 AS kind, cast(floor(c_custkey / 10) as bigint) % 3 AS style,
    concat(cast(1 + c_custkey % 2 as string), {padded('c_custkey % 100', 2)}, {padded('1 + c_custkey % 12', 2)}, {padded('1 + c_custkey % 95', 2)}, {padded('c_custkey % 1000', 3)}, {padded('1 + c_custkey % 999', 3)}) AS nir13,
    concat('10', {padded('c_custkey * 7919 % 100000000', 8)}) AS rpps10,
    concat('57', {padded('c_custkey * 104729 % 1000000', 6)}) AS finess8,
    concat('30004', '00', {padded('c_custkey % 1000', 3)}, {padded('c_custkey * 1299709 % 100000000000', 11)}, {padded('c_custkey % 97', 2)}) AS bban
  FROM customer
), ids AS (
  SELECT k, kind, style, concat(nir13, {padded("97 - cast(nir13 as bigint) % 97", 2)}) AS nir, concat(rpps10, {luhn_digit('rpps10', 10)}) AS rpps,
    concat(finess8, {luhn_digit('finess8', 8)}) AS finess, concat('FR', {padded("98 - " + mod97("concat(bban, '152700')", 29), 2)}, bban) AS iban
  FROM ids0
)"""


def groups(s: str, sizes: list[int], sep: str) -> str:
    parts, at = [], 1
    for n in sizes:
        parts.append(f"substring({s}, {at}, {n})")
        at += n
    return "concat(" + f", '{sep}', ".join(parts) + ")"


_NIR_GROUPS, _IBAN_GROUPS = [1, 2, 2, 2, 3, 3, 2], [4, 4, 4, 4, 4, 4, 3]
_KINDS = {
    0: ("nir", "'Le patient porte le numéro '", f"case style when 0 then nir when 1 then {groups('nir', _NIR_GROUPS, ' ')} else {groups('nir', _NIR_GROUPS, '.')} end", "', à vérifier.'", "1.0"),
    1: ("rpps", "'Médecin inscrit sous '", f"case style when 0 then rpps when 1 then {groups('rpps', [5, 5, 1], ' ')} else {groups('rpps', [2, 3, 3, 3], ' ')} end", "' au tableau.'", "0.9"),
    2: ("iban", "'Virement sur '", f"case style when 0 then iban when 1 then {groups('iban', _IBAN_GROUPS, ' ')} else {groups('iban', _IBAN_GROUPS, '  ')} end", "' sous huit jours.'", "1.0"),
    3: ("finess", "case style when 0 then 'Structure FINESS ' when 1 then 'Structure sous le ' else 'Structure ET ' end", "finess", "' en règle.'", "case style when 0 then 0.9 else 0.5 end"),
    4: ("nom", "case style when 0 then 'Courrier remis à M. ' when 1 then 'Avis du soir : ' else 'Visite de ' end", "case style when 0 then 'Jean Valmont' when 1 then 'Dr Nadia Ferrant' else 'Sophie Lambert' end", "', ce jour.'", "case style when 2 then 0.6 else 0.9 end"),
    5: ("date_naissance", "case style when 0 then 'Patiente née le ' when 1 then 'Date de naissance : ' else 'DDN ' end", f"concat({padded('1 + k % 28', 2)}, case style when 0 then '/' when 1 then '-' else '.' end, {padded('1 + k % 12', 2)}, case style when 0 then '/' when 1 then '-' else '.' end, cast(1930 + k % 80 as string))", "', suivie ici.'", "0.7"),
    6: ("adresse", "'Domicile : '", f"concat(cast(1 + k % 180 as string), case style when 0 then ' rue des Lilas, ' when 1 then ' avenue du Parc ' else ' chemin Vert, ' end, {padded('10000 + k % 80000', 5)}, case style when 0 then ' Metz' when 1 then ' Thionville' else ' Vesoul' end)", "'.'", "0.7"),
    7: ("telephone", "'Joindre le '", f"case style when 0 then {groups(f'concat(chr(48), {padded('100000000 + k * 7919 % 800000000', 9)})', [2, 2, 2, 2, 2], ' ')} when 1 then {groups(f'concat(chr(48), {padded('100000000 + k * 7919 % 800000000', 9)})', [2, 2, 2, 2, 2], '.')} else concat(chr(48), {padded('100000000 + k * 7919 % 800000000', 9)}) end", "' avant midi.'", "0.8"),
    8: ("email", "'Écrire à '", "concat('usager', cast(k as string), case style when 0 then '@' when 1 then '.bis@' else '+tri@' end, 'exemple.fr')", "' merci.'", "0.85"),
    9: ("etablissement", "'Admis au '", "case style when 0 then 'Foyer Les Tilleuls' when 1 then 'CH de Vesoul' else 'Centre Hospitalier de Dole' end", "' hier.'", "0.7"),
}


def _case(i: int) -> str:
    return "case kind " + " ".join(f"when {k} then {v[i]}" for k, v in _KINDS.items()) + " end"


_TYPE = "case kind " + " ".join(f"when {k} then '{v[0]}'" for k, v in _KINDS.items()) + " end"
#: (doc_id, type, prefix, value, suffix, confidence, text, start, end) of every customer; prepend WITH.
CORPUS = f"""{IDS}, parts AS (
  SELECT k AS doc_id, style, {_TYPE} AS type, {_case(1)} AS prefix, {_case(2)} AS value, {_case(3)} AS suffix, cast({_case(4)} as double) AS confidence FROM ids
), corpus AS (
  SELECT doc_id, style, type, value, confidence, prefix, suffix, concat(prefix, value, suffix) AS text,
    cast(length(prefix) as int) AS start_at, cast(length(prefix) + length(value) as int) AS end_at
  FROM parts
)"""

#: (doc_id, text) with nothing to find.
TRAPS = f"""{IDS}, traps AS (
  SELECT k AS doc_id, case kind
    when 0 then concat('Le numéro ', substring(nir, 1, 13), {padded("(cast(substring(nir, 14, 2) as int) + 1) % 100", 2)}, ' est faux.')
    when 1 then concat('Sous ', substring(rpps, 1, 10), cast((cast(substring(rpps, 11, 1) as int) + 1) % 10 as string), ' rien.')
    when 2 then concat('Compte ', substring(iban, 1, 26), case when substring(iban, 27, 1) = '9' then '8' else '9' end, 'X9 refusé.')
    when 3 then concat('Lot ', substring(finess, 1, 8), cast((cast(substring(finess, 9, 1) as int) + 1) % 10 as string), ' rendu.')
    when 4 then 'Une échelle EVA à quatre, sans plainte.'
    when 5 then 'Réunion prévue le 12/05/2026 au calme.'
    when 6 then 'innohep 10000 UI et 12000 KG au total.'
    when 7 then 'Code 99 99 99 99 99 affiché.'
    when 8 then 'Arobase seule @ dans la phrase.'
    else 'le foyer est calme ce soir.' end AS text FROM ids
)"""
