"""Queries over the driver's tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, text
from ..operators import detect as d
from ..operators import evaluate as ev
from ..operators import pseudonymize as ps
from ..operators import risk
from ..session import spread, table, written
from ..sources import dimensions, documents
from . import corpus_sql as sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def customers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the customer table, its rows dealt over tasks: few bytes, of which whole texts are made."""
    return spread(table(spark, sf_dir, "customer").select(*columns or ("c_custkey",)))


def from_customers(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    """A SELECT over the shared common table expressions, on the customer table's keys."""
    body = f"WITH {ctes.replace('FROM customer', 'FROM {customer}')} {select}"
    return spark.sql(body, customer=customers(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated corpus as a table, so that its long expressions are planned once."""
    return written(from_customers(spark, sf_dir, sql.CORPUS, "SELECT * FROM corpus"), "corpus")


def spans(df: DataFrame, entities: str = "entities") -> DataFrame:
    """(doc_id, type, start_at, end_at, value, confidence), a row an entity."""
    return df.select("doc_id", F.explode(entities).alias("e")).select("doc_id", F.col("e.type").alias("type"), F.col("e.start").alias("start_at"), F.col("e.end").alias("end_at"), F.col("e.value").alias("value"), F.col("e.confidence").alias("confidence"))


# == spans on real texts ==

_EMAIL_SQL = r"[\dA-Za-z][\dA-Za-z%+._-]*@[\dA-Za-z.-]+[.][A-Za-z]{2,}"


@query(
    "email_spans",
    f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '{_EMAIL_SQL}') AS m, string_split_regex(text, '{_EMAIL_SQL}') AS g FROM documents),
    u AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM p)
    SELECT doc_id, m[i] AS value, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER AS start_at,
      (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::INTEGER AS end_at FROM u""",
)
def email_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", d.email(F.col("text")).alias("entities"))
    return spans(docs).select("doc_id", "value", "start_at", "end_at")


@query("email_counts_by_lang", f"SELECT lang, sum(len(regexp_extract_all(text, '{_EMAIL_SQL}')))::BIGINT AS n_emails, count(*) AS n_docs FROM documents GROUP BY lang")
def email_counts_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.sum(F.size(d.email(F.col("text")))).cast("bigint").alias("n_emails"), F.count(F.lit(1)).alias("n_docs"))


@query(
    "redact_emails",
    f"""WITH e AS (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL_SQL}') AS m FROM documents)
    SELECT doc_id, len(list_distinct(m))::INTEGER AS n_distinct, true AS restored_exactly, md5(text) AS restored_md5 FROM e WHERE len(m) > 0""",
)
def redact_emails(spark, sf_dir):
    """Which documents have an e-mail address, how many distinct ones, and whether the masked text restores exactly."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", "text")
    out = ps.redact(docs, detectors=(d.Detector("email", "pattern", d.email),)).where(F.size("entities") > 0)
    back = ps.restored(F.col("masked"), F.col("mapping"))
    return out.select("doc_id", F.size("mapping").alias("n_distinct"), (back == F.col("text")).alias("restored_exactly"), F.md5(back).alias("restored_md5"))


_COMPACT = r"""regexp_replace(regexp_replace(text, '([0-9][A-Z]?)[ \t\x{00A0}\x{202F}]+([A-Z]?[0-9])', '\1\2', 'g'), '([0-9][A-Z]?)[ \t\x{00A0}\x{202F}]+([A-Z]?[0-9])', '\1\2', 'g')"""


@query("finess_like", f"WITH c AS (SELECT doc_id, {_COMPACT} AS t FROM documents) SELECT doc_id, len(list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: length(x) = 9))::INTEGER AS n FROM c WHERE len(list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: length(x) = 9)) > 0")
def finess_like(spark, sf_dir):
    compact = text.compact_digits(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(text.find_spans(compact, d._FINESS)).alias("n"))
    return docs.where("n > 0")


@query("compact_digits", f"SELECT doc_id, md5({_COMPACT}) AS compact FROM documents")
def compact_digits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.compact_digits(F.col("text"))).alias("compact"))


# == check digits ==


def _luhn_sum(s: str, n: int) -> str:
    return f"{sql.luhn_digit(f'substring({s}, 1, {n - 1})', n - 1)} = substring({s}, {n}, 1)"


@query("luhn_valid_ids", f"SELECT c_custkey AS k, {_luhn_sum(sql.padded('c_custkey * 7919', 11), 11)} AS valid FROM customer")
def luhn_valid_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), checks.luhn_valid(F.lpad((F.col("c_custkey") * 7919).cast("string"), 11, "0")).alias("valid"))


@query("nir_key", f"WITH {sql.IDS} SELECT k, nir, true AS valid, cast(substring(nir, 14, 2) as int) <> 97 - cast(substring(nir, 1, 13) as bigint) % 97 AS wrong FROM ids")
def nir_key(spark, sf_dir):
    ids = from_customers(spark, sf_dir, sql.IDS, "SELECT k, nir FROM ids")
    key = F.substring("nir", 14, 2).cast("int")
    broken = F.concat(F.substring("nir", 1, 13), F.lpad((key % 97 + 1).cast("string"), 2, "0"))
    return ids.select("k", "nir", checks.nir_valid(F.col("nir")).alias("valid"), (checks.nir_valid(broken) & (broken != F.col("nir"))).alias("wrong"))


@query("iban_mod97", f"WITH {sql.IDS} SELECT k, iban, true AS valid, false AS wrong FROM ids")
def iban_mod97(spark, sf_dir):
    ids = from_customers(spark, sf_dir, sql.IDS, "SELECT k, iban FROM ids")
    broken = F.concat(F.substring("iban", 1, 26), F.translate(F.substring("iban", 27, 1), "0123456789", "1234567890"))
    return ids.select("k", "iban", checks.iban_fr_valid(F.col("iban")).alias("valid"), checks.iban_fr_valid(broken).alias("wrong"))


# == detectors on the annotated corpus ==


def _one_detector(detector: d.Detector) -> Callable:
    def run(spark, sf_dir):
        docs = corpus(spark, sf_dir).select("doc_id", detector.find(F.col("text")).alias("entities"))
        return spans(docs)

    return run


#: Telephone numbers by shape in texts of other types: an IBAN in fours may begin a group with 0.
_ELSEWHERE = r""" UNION ALL SELECT doc_id, 'telephone', cast(strpos(text, m) - 1 + length(regexp_extract(m, '^([^0-9]?)', 1)) as int),
  cast(strpos(text, m) - 1 + length(regexp_extract(m, '^([^0-9]?)', 1)) + length(v) as int), v, 0.8
  FROM (SELECT doc_id, text, regexp_extract(text, '(?:^|[^0-9])(?:\+33[ .-]?|0)[1-9](?:[ .-]?[0-9]{2}){4}(?:$|[^0-9])') AS m,
    regexp_extract(text, '(?:^|[^0-9])((?:\+33[ .-]?|0)[1-9](?:[ .-]?[0-9]{2}){4})(?:$|[^0-9])', 1) AS v FROM corpus WHERE type <> 'telephone') WHERE m <> ''"""
for _d in d.DEFAULT:
    _name = {"nom": "name", "date_naissance": "birthdate", "adresse": "address", "telephone": "phone", "etablissement": "establishment", "email": "email_corpus"}.get(_d.name, _d.name)
    _own = f"WITH {sql.CORPUS} SELECT doc_id, type, start_at, end_at, value, confidence FROM corpus WHERE type = '{_d.name}'"
    query(f"{_name}_spans", _own + (_ELSEWHERE if _d.name == "telephone" else ""))(_one_detector(_d))


@query("detect_all", f"WITH {sql.CORPUS} SELECT doc_id, type, start_at, end_at, value, confidence FROM corpus")
def detect_all(spark, sf_dir):
    return spans(d.detect(corpus(spark, sf_dir).select("doc_id", "text")))


@query("traps_structural", f"WITH {sql.TRAPS} SELECT count(*) AS n_docs, 0::BIGINT AS n_found FROM traps")
def traps_structural(spark, sf_dir):
    docs = written(from_customers(spark, sf_dir, sql.TRAPS, "SELECT * FROM traps"), "traps")
    found = d.detect(docs)
    return found.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).cast("bigint").alias("n_found"))


@query("irregular_spacing_recall", f"WITH {sql.CORPUS} SELECT type, count(*) AS n_gold, count(*) AS n_found FROM corpus WHERE type IN ('nir', 'iban') AND value LIKE '% %' GROUP BY type")
def irregular_spacing_recall(spark, sf_dir):
    """Recall when the blanks inside numbers are doubled, no-break and tabs."""
    docs = corpus(spark, sf_dir).where("type in ('nir', 'iban') and value like '% %'")
    odd = F.replace(F.replace(F.col("text"), F.lit("  "), F.lit(" ")), F.lit(" "), F.lit("  "))
    odd = F.when(F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit(" "), F.lit(" \t"))).otherwise(odd)
    found = docs.withColumn("found", F.size(F.filter(F.concat(d.nir(odd), d.iban(odd)), lambda e: e["type"] == F.col("type"))))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n_gold"), F.sum("found").cast("bigint").alias("n_found"))


@query("finess_siren_collision", f"WITH {sql.CORPUS} SELECT confidence, count(*) AS n FROM corpus WHERE type = 'finess' GROUP BY confidence")
def finess_siren_collision(spark, sf_dir):
    """The same nine digits are surer with the keyword near; without, a company number looks alike."""
    docs = corpus(spark, sf_dir).where("type = 'finess'").select("doc_id", d.finess(F.col("text")).alias("entities"))
    return spans(docs).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


_CANDIDATES = """cand AS (
  SELECT o_orderkey AS doc_id, j, cast((o_custkey * 7 + j * 11) % 40 as int) AS start_at, cast((o_custkey * 7 + j * 11) % 40 + 3 + (o_orderkey + j * 5) % 9 as int) AS end_at,
    cast(0.5 + ((o_orderkey + j) % 3) * 0.2 as double) AS confidence, case (o_orderkey + j) % 4 when 0 then 'structural' when 1 then 'reference' when 2 then 'pattern' else 'statistical' end AS tier
  FROM {orders} CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS js
)"""


@query(
    "resolve_overlaps",
    "WITH RECURSIVE "
    + _CANDIDATES.replace("{orders}", "orders")
    + """, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY end_at - start_at DESC, confidence DESC,
        case tier when 'structural' then 3 when 'reference' then 2 when 'pattern' then 1 else 0 end DESC, start_at, concat('t', j)) AS r FROM cand
    ), steps AS (
      SELECT doc_id, 0::BIGINT AS r, []::STRUCT(a INTEGER, b INTEGER, j INTEGER)[] AS kept FROM (SELECT DISTINCT doc_id FROM ranked)
      UNION ALL
      SELECT s.doc_id, c.r, CASE WHEN len(list_filter(s.kept, lambda k: k.a < c.end_at AND c.start_at < k.b)) > 0 THEN s.kept
        ELSE list_append(s.kept, {'a': c.start_at, 'b': c.end_at, 'j': c.j}) END
      FROM steps s JOIN ranked c ON s.doc_id = c.doc_id AND c.r = s.r + 1
    ), last AS (SELECT doc_id, unnest(kept) AS k FROM steps WHERE r = 5)
    SELECT doc_id, k.j AS j, k.a AS start_at, k.b AS end_at FROM last""",
)
def resolve_overlaps(spark, sf_dir):
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100_000, ("o_orderkey",))  # so that orders are shuffled, not their candidates
    rows = spark.sql("WITH " + _CANDIDATES + " SELECT * FROM cand", orders=orders)
    e = F.struct(F.concat(F.lit("t"), "j").alias("type"), F.col("start_at").alias("start"), F.col("end_at").alias("end"), F.col("j").cast("string").alias("value"), "confidence", "tier")
    kept = rows.groupBy("doc_id").agg(F.collect_list(e).alias("c")).select("doc_id", d.resolve_overlaps(F.col("c")).alias("entities"))
    return spans(kept).select("doc_id", F.col("value").cast("int").alias("j"), "start_at", "end_at")


# == pseudonyms ==


@query("redact_masked_text", f"WITH {sql.CORPUS} SELECT doc_id, concat(prefix, '[', upper(type), '_1]', suffix) AS masked FROM corpus")
def redact_masked_text(spark, sf_dir):
    return ps.redact(corpus(spark, sf_dir).select("doc_id", "text")).select("doc_id", "masked")


@query("restore_roundtrip", f"WITH {sql.CORPUS} SELECT doc_id, text AS restored, true AS exact FROM corpus")
def restore_roundtrip(spark, sf_dir):
    out = ps.redact(corpus(spark, sf_dir).select("doc_id", "text"))
    back = ps.restored(out["masked"], out["mapping"])
    return out.select("doc_id", back.alias("restored"), (back == F.col("text")).alias("exact"))


@query("restore_tolerant", f"WITH {sql.CORPUS} SELECT doc_id, concat('Réponse : ', value, ' et [X_1_BIS].') AS restored FROM corpus")
def restore_tolerant(spark, sf_dir):
    """Tokens come back with other case, blanks and separators; near misses stay."""
    out = ps.redact(corpus(spark, sf_dir).select("doc_id", "text"))
    token = F.get(F.map_keys("mapping"), F.lit(0))
    reply = F.concat(F.lit("Réponse : "), F.lower(F.replace(F.replace(token, F.lit("["), F.lit("[ ")), F.lit("_1]"), F.lit(" 1 ]"))), F.lit(" et [X_1_BIS]."))
    return out.select("doc_id", ps.restored(reply, F.col("mapping")).alias("restored"))


_MAILS = "mails AS (SELECT c_custkey AS doc_id, concat('u', cast(c_custkey % 3 as string), '@exemple.fr') AS m1, concat('u', cast(c_custkey % 2 as string), '@exemple.fr') AS m2, concat('u', cast(c_custkey % 5 as string), '@exemple.fr') AS m3 FROM customer)"


@query(
    "token_numbering",
    f"""WITH {_MAILS}, u AS (SELECT doc_id, 1 AS i, m1 AS m FROM mails UNION ALL SELECT doc_id, 2, m2 FROM mails UNION ALL SELECT doc_id, 3, m3 FROM mails),
    f AS (SELECT *, min(i) OVER (PARTITION BY doc_id, m) AS first FROM u), r AS (SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM f)
    SELECT doc_id, concat('De [EMAIL_', max(CASE WHEN i = 1 THEN n END), '] à [EMAIL_', max(CASE WHEN i = 2 THEN n END), '] et [EMAIL_', max(CASE WHEN i = 3 THEN n END), '] hier') AS masked FROM r GROUP BY doc_id""",
)
def token_numbering(spark, sf_dir):
    docs = written(from_customers(spark, sf_dir, _MAILS, "SELECT doc_id, concat('De ', m1, ' à ', m2, ' et ', m3, ' hier') AS text FROM mails"), "mails")
    return ps.redact(docs).select("doc_id", "masked")


_PEOPLE = {
    0: ("'Vu M. Thomas Valmont puis Valmont Thomas ce soir.'", "'Vu M. [NOM_1] puis [NOM_1] ce soir.'"),
    1: ("'Dr Nadia Ferrant examine, puis Ferrant confirme.'", "'[NOM_1] examine, puis [NOM_1] confirme.'"),
    2: ("'Reçus Mme Julie Ferrant et M. Paul Ferrant.'", "'Reçus Mme [NOM_1] et M. [NOM_2].'"),
    3: ("'Ici M. Paul Ferrant, Mme Julie Ferrant, puis Ferrant seul.'", "'Ici M. [NOM_1], Mme [NOM_2], puis [NOM_3] seul.'"),
}


@query("name_coreference", "SELECT c_custkey AS doc_id, case c_custkey % 4 " + " ".join(f"when {k} then {v[1]}" for k, v in _PEOPLE.items()) + " end AS masked FROM customer")
def name_coreference(spark, sf_dir):
    """A mention joins the one person whose words include or are included; with several such it is new."""
    docs = from_customers(spark, sf_dir, "c AS (SELECT c_custkey AS k FROM customer)", "SELECT k AS doc_id, case k % 4 " + " ".join(f"when {k} then {v[0]}" for k, v in _PEOPLE.items()) + " end AS text FROM c")
    return ps.redact(docs).select("doc_id", "masked")


@query("redact_documents")
def redact_documents(spark, sf_dir):
    """All detectors over all documents: masked text and number of entities. Capitalised words make SQL impractical."""
    return ps.redact(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size("entities").alias("n_entities"), F.md5("masked").alias("masked_md5"))


@query("redact_reply_restore", f"WITH {sql.CORPUS} SELECT doc_id, concat(prefix, '[', upper(type), '_1]', suffix) AS reply, text AS restored, CAST(NULL AS VARCHAR) AS reply_error FROM corpus")
def redact_reply_restore(spark, sf_dir):
    """Masked text goes to the (offline) model and its reply is restored."""
    return ps.ask_model(corpus(spark, sf_dir).select("doc_id", "text"), ps.echo, instruction="Résume.").select("doc_id", "reply", "restored", "reply_error")


# == reference tables ==

_DIMS = dimensions.sample_sql()
_dim = dimensions.sample


@query("dep_population", f"WITH {_DIMS} SELECT dep, sum(coalesce(pmun, 0))::BIGINT AS population FROM communes GROUP BY dep")
def dep_population(spark, sf_dir):
    return _dim(spark).population_by_department()


@query("physicians_by_dep", f"WITH {_DIMS} SELECT dep, sum(n)::BIGINT AS n FROM physicians GROUP BY dep")
def physicians_by_dep(spark, sf_dir):
    return _dim(spark).physicians_by_department()


@query("health_pros_by_dep", f"WITH {_DIMS} SELECT dep, sum(n)::BIGINT AS n FROM (SELECT dep, n FROM physicians UNION ALL SELECT dep, n FROM professions) GROUP BY dep")
def health_pros_by_dep(spark, sf_dir):
    return _dim(spark).professionals_by_department()


@query("age_share", f"WITH {_DIMS} SELECT age, n::BIGINT AS n, n / (SELECT sum(n) FROM ages)::DOUBLE AS share FROM ages")
def age_share(spark, sf_dir):
    return _dim(spark).age_shares()


@query("age_band_share", f"WITH {_DIMS} SELECT c_custkey AS k, (SELECT sum(n) FROM ages WHERE age BETWEEN c_custkey % 100 AND c_custkey % 100 + 9)::DOUBLE / (SELECT sum(n) FROM ages) AS share FROM customer")
def age_band_share(spark, sf_dir):
    ages = _dim(spark).ages
    rows = [r[0] for r in ages.orderBy("age").select("n").collect()]
    total, low = sum(rows), F.col("c_custkey") % 100
    upto = [sum(rows[:k]) for k in range(120)]
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), ((F.get(F.array(*map(F.lit, upto)), (low + 10).cast("int")) - F.get(F.array(*map(F.lit, upto)), low.cast("int"))) / F.lit(float(total))).alias("share"))


@query("commune_lookup_norm", f"WITH {_DIMS} SELECT code, norm, trim(regexp_replace(translate(upper(strip_accents(libelle)), '''’-./', '     '), '\\s+', ' ', 'g')) AS computed FROM communes")
def commune_lookup_norm(spark, sf_dir):
    return _dim(spark).communes.select("code", "norm", text.normal_name(F.col("libelle")).alias("computed"))


@query("commune_homonyms", f"WITH {_DIMS} SELECT norm, count(*) AS n FROM communes GROUP BY norm")
def commune_homonyms(spark, sf_dir):
    return _dim(spark).communes.groupBy("norm").agg(F.count(F.lit(1)).alias("n"))


@query("commune_hierarchy", f"WITH {_DIMS} SELECT code, dep, c.reg AS reg, r.label AS region FROM communes c LEFT JOIN regions r ON c.reg = r.reg")
def commune_hierarchy(spark, sf_dir):
    return _dim(spark).with_zones().select("code", "dep", "reg", "region")


@query(
    "generalize_ladder",
    f"""WITH {_DIMS}, c AS (SELECT c.*, r.label AS region, CASE WHEN c.reg IN ('11','28','32') THEN 'Nord' WHEN c.reg IN ('27','44') THEN 'Est' WHEN c.reg IN ('75','76','84','93','94') THEN 'Sud'
      WHEN c.reg IN ('24','52','53') THEN 'Ouest' WHEN c.reg IN ('01','02','03','04','06') THEN 'Outre-mer' END AS zone FROM communes c LEFT JOIN regions r ON c.reg = r.reg)
    SELECT code, 0 AS level, libelle AS value FROM c UNION ALL SELECT code, 1, dep FROM c UNION ALL SELECT code, 2, region FROM c UNION ALL SELECT code, 3, zone FROM c UNION ALL SELECT code, 4, 'France' FROM c""",
)
def generalize_ladder(spark, sf_dir):
    return risk.generalised(_dim(spark))


@query("first_name_semi_join", "SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 3 = 1")
def first_name_semi_join(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "Hélène").when(F.col("c_custkey") % 3 == 1, "jean-marc").otherwise("Xyzzy").alias("name"))
    gazetteer = spark.createDataFrame([("HELENE",), ("JEAN MARC",), ("PAUL",)], "norm string")
    return dimensions.known_first_names(names, gazetteer).select("k")


# == risk ==


def _cases(spark, sf_dir, kind: str) -> DataFrame:
    """Cases from customer keys: `b` an age and a commune or department, `a` a profession and a place."""
    k = F.col("c_custkey")
    codes = sorted(r[0] for r in dimensions.sample_rows()["communes"])
    deps = ["57", "54", "13", "75", "35", "99"]
    place = F.when(k % 3 == 0, F.struct(F.lit("lieu").alias("type"), F.get(F.array(*map(F.lit, deps)), (k % len(deps)).cast("int")).alias("value"), F.lit(1).alias("level"))).otherwise(
        F.struct(F.lit("lieu").alias("type"), F.get(F.array(*map(F.lit, codes)), (k % len(codes)).cast("int")).alias("value"), F.lit(0).alias("level"))
    )
    if kind == "b":
        other = F.struct(F.lit("age").alias("type"), (k % 105).cast("string").alias("value"), F.lit(0).alias("level"))
    else:
        jobs = ["01", "11", "14", "pharmacien", "sage-femme", "TOUTE_SPECIALITE", "PROFESSIONNEL_DE_SANTE", "99"]
        other = F.struct(F.lit("profession").alias("type"), F.get(F.array(*map(F.lit, jobs)), (k % len(jobs)).cast("int")).alias("value"), F.lit(0).alias("level"))
    return customers(spark, sf_dir).select(k.alias("case_id"), F.array(other, place).cast(f"array<{risk.QI}>").alias("qis"))


_CODES = "[" + ", ".join(f"'{c}'" for c in sorted(r[0] for r in dimensions.sample_rows()["communes"])) + "]"
_CASE_SQL = f"""{_DIMS}, place AS (
  SELECT c_custkey AS case_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS lvl,
    CASE WHEN c_custkey % 3 = 0 THEN (['57','54','13','75','35','99'])[(c_custkey % 6 + 1)::INTEGER] ELSE ({_CODES})[(c_custkey % len({_CODES}) + 1)::INTEGER] END AS v,
    (c_custkey % 105)::INTEGER AS age, (['01','11','14','pharmacien','sage-femme','TOUTE_SPECIALITE','PROFESSIONNEL_DE_SANTE','99'])[(c_custkey % 8 + 1)::INTEGER] AS job
  FROM customer
), deps AS (SELECT dep, sum(coalesce(pmun, 0)) AS pop FROM communes GROUP BY dep), tot AS (SELECT sum(n) AS t FROM ages),
counts AS (SELECT dep, code AS key, n FROM physicians UNION ALL SELECT dep, profession, n FROM professions UNION ALL SELECT dep, 'TOUTE_SPECIALITE', sum(n) FROM physicians GROUP BY dep
  UNION ALL SELECT dep, 'PROFESSIONNEL_DE_SANTE', sum(n) FROM (SELECT dep, n FROM physicians UNION ALL SELECT dep, n FROM professions) GROUP BY dep),
b AS (
  SELECT case_id, lvl, v, p.age AS age, CASE lvl WHEN 1 THEN coalesce(d.pop, 0) ELSE c.pmun END::DOUBLE AS pop, a.n / t::DOUBLE AS share, t::DOUBLE AS t, c.dep AS cdep, cd.pop::DOUBLE AS cdep_pop
  FROM place p LEFT JOIN communes c ON lvl = 0 AND c.code = v LEFT JOIN deps d ON lvl = 1 AND d.dep = v LEFT JOIN deps cd ON cd.dep = c.dep JOIN ages a ON a.age = p.age, tot
), e AS (SELECT *, pop * share AS f FROM b)"""
_BAND = "CASE WHEN {0} < 10 THEN 'eleve' WHEN {0} < 50 THEN 'moyen' WHEN {0} IS NOT NULL THEN 'faible' END"


@query("reid_estimate_case_b", f"WITH {_CASE_SQL} SELECT case_id, round(f, 6) AS f, {_BAND.format('f')} AS band, CASE WHEN f IS NULL THEN NULL WHEN pop <= t * share THEN 'lieu' ELSE 'age' END AS dominant FROM e")
def reid_estimate_case_b(spark, sf_dir):
    return risk.estimate(_cases(spark, sf_dir, "b"), _dim(spark)).select("case_id", F.round("f", 6).alias("f"), "band", "dominant")


@query(
    "reid_estimate_case_a",
    f"""WITH {_CASE_SQL} SELECT case_id, CASE WHEN job <> '99' THEN coalesce(n, 0)::DOUBLE END AS f, CASE WHEN job <> '99' THEN true END AS upper_bound
    FROM place LEFT JOIN communes c ON lvl = 0 AND c.code = v LEFT JOIN counts k ON k.key = job AND k.dep = CASE lvl WHEN 1 THEN v ELSE c.dep END""",
)
def reid_estimate_case_a(spark, sf_dir):
    return risk.estimate(_cases(spark, sf_dir, "a"), _dim(spark)).select("case_id", "f", "upper_bound")


_STEP = f"""{_CASE_SQL}, wider AS (
  SELECT e.*, CASE lvl WHEN 0 THEN cdep_pop ELSE t END * share AS f_place,
    pop * (SELECT sum(n) FROM ages x WHERE x.age BETWEEN e.age // 5 * 5 AND e.age // 5 * 5 + 4) / t AS f_age FROM e
), best AS (SELECT *, CASE WHEN f >= 20 OR f IS NULL THEN NULL WHEN f_place >= f_age THEN 'lieu' ELSE 'age' END AS winner, greatest(f_place, f_age) AS f_best FROM wider)"""


@query("reid_suggest", f"WITH {_STEP} SELECT case_id, winner, round(f_best, 6) AS f_after, CASE winner WHEN 'age' THEN concat(age // 5 * 5, '-', age // 5 * 5 + 4) ELSE CASE lvl WHEN 0 THEN cdep ELSE 'FR' END END AS to_value FROM best WHERE winner IS NOT NULL")
def reid_suggest(spark, sf_dir):
    out = risk.explain(_cases(spark, sf_dir, "b"), _dim(spark)).where("suggestion is not null")
    return out.select("case_id", F.col("suggestion.from.type").alias("winner"), F.round("suggestion.f_after", 6).alias("f_after"), F.col("suggestion.to.value").alias("to_value"))


@query("reid_outcome_counts", f"WITH {_STEP} SELECT CASE WHEN f IS NULL THEN NULL WHEN f >= 20 THEN 'succes' WHEN f_best >= 20 THEN 'suggestion' ELSE 'epuisement' END AS outcome, count(*) AS n FROM best GROUP BY 1")
def reid_outcome_counts(spark, sf_dir):
    return risk.explain(_cases(spark, sf_dir, "b"), _dim(spark)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("reid_candidates", f"WITH {_STEP} SELECT case_id, 0 AS place, 'age' AS type, round(f_age, 6) AS f_after FROM best WHERE f IS NOT NULL UNION ALL SELECT case_id, 1, 'lieu', round(f_place, 6) FROM best WHERE f IS NOT NULL")
def reid_candidates(spark, sf_dir):
    return risk.simulate(_cases(spark, sf_dir, "b"), _dim(spark)).select("case_id", "place", F.col("from.type").alias("type"), F.round("f_after", 6).alias("f_after"))


@query("reid_audit_json")
def reid_audit_json(spark, sf_dir):
    """The audit trace and the narrative of every case; number formats differ between engines."""
    return risk.narrative(risk.audit(risk.explain(_cases(spark, sf_dir, "b"), _dim(spark)))).select("case_id", "audit", "narrative")


_NOTES = "notes AS (SELECT c_custkey AS doc_id, case c_custkey % 4 when 0 then concat('Âgée de ', cast(c_custkey % 130 as string), ' ans, vue à Thionville.') when 1 then 'La pharmacienne de Marseille appelle.' when 2 then 'Vu le cardiologue, 12 ans avant ; habite Aboncourt.' else 'Rien à signaler.' end AS text FROM customer)"


@query("qi_extract_age", f"WITH {_NOTES} SELECT doc_id, case doc_id % 4 when 0 then cast(doc_id % 130 as string) else '12' end AS value FROM notes WHERE (doc_id % 4 = 0 AND doc_id % 130 <= 120) OR doc_id % 4 = 2")
def qi_extract_age(spark, sf_dir):
    docs = from_customers(spark, sf_dir, _NOTES, "SELECT * FROM notes")
    return docs.select("doc_id", F.explode(risk.ages_in(F.col("text"))).alias("q")).select("doc_id", "q.value")


@query("qi_extract_profession", f"WITH {_NOTES}, w(k, v) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in [*risk.SPECIALTIES.items(), *risk.PROFESSIONS.items()]) + ") SELECT doc_id, v AS value FROM notes JOIN w ON contains(lower(text), k)")
def qi_extract_profession(spark, sf_dir):
    docs = from_customers(spark, sf_dir, _NOTES, "SELECT * FROM notes")
    return docs.select("doc_id", F.explode(risk.professions_in(F.col("text"))).alias("q")).select("doc_id", "q.value")


@query("qi_extract_lieu", f"WITH {_NOTES} SELECT doc_id, case doc_id % 4 when 0 then '57672' else '13055' end AS value FROM notes WHERE doc_id % 4 IN (0, 1)")
def qi_extract_lieu(spark, sf_dir):
    docs = from_customers(spark, sf_dir, _NOTES, "SELECT * FROM notes")
    out = risk.extract(docs, _dim(spark)).select("doc_id", F.explode("qis").alias("q"))
    return out.where("q.type = 'lieu'").select("doc_id", "q.value")


# == evaluation ==

_EVAL = """base AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 6 AS m, cast(10 + o_orderkey % 20 as int) AS a, cast(16 + o_orderkey % 20 + o_custkey % 9 as int) AS b,
    case o_orderkey % 3 when 0 then 'nom' when 1 then 'email' else 'iban' end AS type FROM {orders}
), gold AS (
  SELECT doc_id, type, a AS s, b AS e FROM base UNION ALL SELECT doc_id, type, b + 5, b + 12 FROM base WHERE m < 3
), pred AS (
  SELECT doc_id, type, case m when 1 then a + 2 when 3 then a + 1 when 4 then a - 2 else a end AS s, case m when 2 then b - 1 when 3 then b - 1 when 4 then b + 2 else b end AS e FROM base WHERE m <> 5
  UNION ALL SELECT doc_id, 'adresse', b + 8, b + 20 FROM base WHERE m = 0
  UNION ALL SELECT doc_id, 'email', b + 30, b + 38 FROM base WHERE m = 5
), texts AS (SELECT doc_id, substring(concat('abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '0123456789abcdefghijklmnopqrstuvwxyz'), 1, 88) AS text FROM base)"""
_EVAL_DUCK = "WITH " + _EVAL.replace("{orders}", "orders")


def _eval(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return tuple(spark.sql(f"WITH {_EVAL} SELECT {cols} FROM {name}", orders=orders) for cols, name in (("doc_id, type, s AS start, e AS `end`", "gold"), ("doc_id, type, s AS start, e AS `end`", "pred"), ("*", "texts")))


_CHARS = """, gc AS (SELECT doc_id, type, unnest(range(s, e)) AS i FROM gold), pc AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS i FROM pred)"""
_SCORE = (
    _EVAL_DUCK
    + _CHARS
    + """, t AS (SELECT DISTINCT type FROM (SELECT type FROM gold UNION ALL SELECT type FROM pred)),
    strict AS (SELECT g.type, count(*) AS n FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.type = p.type AND g.s = p.s AND g.e = p.e GROUP BY 1),
    loose AS (SELECT type, count(*) AS n FROM (SELECT DISTINCT g.doc_id, g.type, g.s FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.type = p.type AND p.s < g.e AND g.s < p.e) GROUP BY 1),
    leak AS (SELECT gc.type, count(*) AS n FROM gc ANTI JOIN pc ON gc.doc_id = pc.doc_id AND gc.i = pc.i GROUP BY 1),
    per AS (SELECT t.type, coalesce((SELECT count(*) FROM gold WHERE gold.type = t.type), 0) AS n_gold, coalesce((SELECT count(*) FROM pred WHERE pred.type = t.type), 0) AS n_pred,
      coalesce(strict.n, 0) AS strict_tp, coalesce(loose.n, 0) AS overlap_tp, coalesce((SELECT sum(e - s) FROM gold WHERE gold.type = t.type), 0)::BIGINT AS gold_chars, coalesce(leak.n, 0) AS leaked_chars
      FROM t LEFT JOIN strict ON strict.type = t.type LEFT JOIN loose ON loose.type = t.type LEFT JOIN leak ON leak.type = t.type),
    al AS (SELECT * FROM per UNION ALL SELECT 'TOTAL', sum(n_gold), sum(n_pred), sum(strict_tp), sum(overlap_tp), sum(gold_chars), sum(leaked_chars) FROM per)"""
)


def _prf(kind: str) -> str:
    p, r = f"coalesce({kind}_tp / nullif(n_pred, 0), 0)", f"coalesce({kind}_tp / nullif(n_gold, 0), 0)"
    return f"round({p}, 6) AS {kind}_precision, round({r}, 6) AS {kind}_recall, round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 6) AS {kind}_f1"


def _scored(kind: str) -> Callable:
    def run(spark, sf_dir):
        gold, pred, _ = _eval(spark, sf_dir)
        s = ev.score(gold, pred)
        return s.select("type", "n_gold", "n_pred", f"{kind}_tp", *(F.round(f"{kind}_{m}", 6).alias(f"{kind}_{m}") for m in ("precision", "recall", "f1")))

    return run


for _kind in ("strict", "overlap"):
    query(f"score_{_kind}", _SCORE + f" SELECT type, n_gold::BIGINT AS n_gold, n_pred::BIGINT AS n_pred, {_kind}_tp::BIGINT AS {_kind}_tp, {_prf(_kind)} FROM al")(_scored(_kind))


@query("leak_rate", _SCORE + " SELECT type, gold_chars::BIGINT AS gold_chars, leaked_chars::BIGINT AS leaked_chars, round(coalesce(leaked_chars / nullif(gold_chars, 0), 0), 6) AS leak_rate FROM al")
def leak_rate(spark, sf_dir):
    gold, pred, _ = _eval(spark, sf_dir)
    return ev.score(gold, pred).select("type", "gold_chars", "leaked_chars", F.round("leak_rate", 6).alias("leak_rate"))


@query(
    "over_masking",
    _EVAL_DUCK + _CHARS + """ SELECT (SELECT count(*) FROM pc)::BIGINT AS masked_chars, (SELECT count(*) FROM pc ANTI JOIN gc ON gc.doc_id = pc.doc_id AND gc.i = pc.i)::BIGINT AS needless_chars,
    (SELECT sum(length(text)) FROM texts)::BIGINT AS text_chars, round((SELECT count(*) FROM pc ANTI JOIN gc ON gc.doc_id = pc.doc_id AND gc.i = pc.i) / (SELECT sum(length(text)) FROM texts), 6) AS needless_share""",
)
def over_masking(spark, sf_dir):
    gold, pred, texts = _eval(spark, sf_dir)
    return ev.over_masking(texts, gold, pred).withColumn("needless_share", F.round("needless_share", 6))


@query("over_masking_witness", f"WITH {sql.TRAPS} SELECT 0::BIGINT AS masked_chars, 0::BIGINT AS needless_chars, sum(length(text))::BIGINT AS text_chars FROM traps")
def over_masking_witness(spark, sf_dir):
    """A corpus without annotations: every detection would be a false one."""
    docs = written(from_customers(spark, sf_dir, sql.TRAPS, "SELECT * FROM traps"), "traps")
    pred = spans(d.detect(docs)).select("doc_id", "type", F.col("start_at").alias("start"), F.col("end_at").alias("end"))
    return ev.over_masking(docs, pred.limit(0), pred).drop("needless_share")


@query(
    "fp_topk",
    _EVAL_DUCK + """, bad AS (SELECT p.doc_id, p.type, p.s, p.e FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND p.s < g.e AND g.s < p.e)),
    c AS (SELECT type, substring(text, s + 1, e - s) AS fragment, count(*) AS n FROM bad JOIN texts USING (doc_id) GROUP BY 1, 2)
    SELECT type, fragment, n, row_number() OVER (PARTITION BY type ORDER BY n DESC, fragment)::INTEGER AS place FROM c QUALIFY place <= 30""",
)
def fp_topk(spark, sf_dir):
    gold, pred, texts = _eval(spark, sf_dir)
    return ev.false_positives(texts, gold, pred)


@query(
    "boundary_taxonomy",
    _EVAL_DUCK + """, x AS (SELECT g.type, g.s, g.e, (SELECT min({'s': p.s, 'e': p.e}) FROM pred p WHERE p.doc_id = g.doc_id AND p.type = g.type AND p.s < g.e AND g.s < p.e) AS p FROM gold g)
    SELECT type, CASE WHEN p IS NULL THEN 'missed' WHEN p.s = s AND p.e = e THEN 'exact' WHEN p.s > s AND p.e >= e THEN 'start cut' WHEN p.s <= s AND p.e < e THEN 'end cut' WHEN p.s > s AND p.e < e THEN 'both cut' ELSE 'wider' END AS outcome, count(*) AS n
    FROM x GROUP BY ALL""",
)
def boundary_taxonomy(spark, sf_dir):
    gold, pred, _ = _eval(spark, sf_dir)
    return ev.boundaries(gold, pred)


@query(
    "leaked_fragments",
    _EVAL_DUCK + _CHARS + """, lost AS (SELECT g.doc_id, g.type, g.s, g.e, string_agg(substring(text, i + 1, 1), '' ORDER BY i) AS fragment FROM (SELECT doc_id, type, s, e, unnest(range(s, e)) AS i FROM gold) g
      JOIN texts USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.doc_id = g.doc_id AND pc.i = g.i) GROUP BY ALL)
    SELECT type, fragment, count(*) AS n FROM lost WHERE length(fragment) < e - s GROUP BY ALL""",
)
def leaked_fragments(spark, sf_dir):
    gold, pred, texts = _eval(spark, sf_dir)
    return ev.leaked_fragments(texts, gold, pred)


@query("corpus_statistics", f"WITH {sql.CORPUS} SELECT type, count(*) AS n, sum(end_at - start_at)::BIGINT AS chars FROM corpus GROUP BY type")
def corpus_statistics(spark, sf_dir):
    return ev.corpus_statistics(corpus(spark, sf_dir).select("doc_id", "type", F.col("start_at").alias("start"), F.col("end_at").alias("end")))


@query("score_corpus", f"WITH {sql.CORPUS} SELECT coalesce(type, 'TOTAL') AS type, count(*) AS n_gold, count(*) AS n_pred, count(*) AS strict_tp FROM corpus GROUP BY ROLLUP (type)")
def score_corpus(spark, sf_dir):
    """All detectors over the annotated corpus, scored: every span is found exactly."""
    docs = corpus(spark, sf_dir)
    pred = spans(d.detect(docs.select("doc_id", "text"))).select("doc_id", "type", F.col("start_at").alias("start"), F.col("end_at").alias("end"))
    gold = docs.select("doc_id", "type", F.col("start_at").alias("start"), F.col("end_at").alias("end"))
    return ev.score(gold, pred).select("type", "n_gold", "n_pred", "strict_tp")


# == files and streams ==


@query(
    "ingest_formats",
    "SELECT c_custkey AS k, case c_custkey % 5 when 0 then 'text' when 1 then 'text' when 2 then 'refused' when 3 then 'refused' else 'text' end AS status, case c_custkey % 5 when 0 then c_name when 1 then c_name when 4 then '' end AS text FROM customer",
)
def ingest_formats(spark, sf_dir):
    """Plain text with and without a byte order mark, a PDF under a false name, a file without extension, an empty file."""
    k = F.col("c_custkey")
    raw = F.encode("c_name", "UTF-8")
    content = F.when(k % 5 == 0, raw).when(k % 5 == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(k % 5 == 2, F.concat(F.encode(F.lit("%PDF"), "UTF-8"), raw)).when(k % 5 == 3, raw).otherwise(F.encode(F.lit(""), "UTF-8"))
    name = F.when(k % 5 == 3, F.lit("notes")).when(k % 5 == 1, F.lit("dir.x/notes.MD")).otherwise(F.lit("notes.txt"))
    files = customers(spark, sf_dir, "c_custkey", "c_name").select(k.alias("k"), name.alias("path"), content.alias("content"))
    return documents.ingest(files).select("k", F.col("ingested.status").alias("status"), F.col("ingested.text").alias("text"))


@query("stream_redact", f"WITH {sql.CORPUS} SELECT doc_id, concat(prefix, '[', upper(type), '_1]', suffix) AS masked FROM corpus")
def stream_redact(spark, sf_dir):
    """The corpus as a stream of files, redacted by the same transformation, read back from the sink."""
    import uuid

    from ..session import shared_dir, tracked
    from ..streaming.redaction import redact_folder

    at = tracked(f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    from_customers(spark, sf_dir, sql.CORPUS, "SELECT doc_id, text FROM corpus").write.parquet(f"{at}/in")
    redact_folder(spark, f"{at}/in", "doc_id bigint, text string", f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("doc_id", "masked")


# == building reference tables, labels and foreign predictions ==


@query("department_codes", "SELECT c_custkey AS k, case c_custkey % 4 when 0 then '57' when 1 then '2A' when 2 then '971' else '01' end AS dep FROM customer")
def department_codes(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "057 -Moselle").when(k % 4 == 1, "02A").when(k % 4 == 2, "971 - Guadeloupe").otherwise("001-Ain")
    return table(spark, sf_dir, "customer").select(k.alias("k"), dimensions.department_code(raw).alias("dep"))


@query("build_communes", "SELECT n_nationkey::VARCHAR AS code, n_name AS norm, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey * 100 END::BIGINT AS pmun FROM nation WHERE n_nationkey % 5 <> 0")
def build_communes(spark, sf_dir):
    """Communes proper with their population, null where there is none."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    raw = n.select(F.when(key % 5 == 0, "COMD").otherwise("COM").alias("TYPECOM"), key.cast("string").alias("COM"), F.initcap("n_name").alias("LIBELLE"), F.lit("57").alias("DEP"), F.lit("44").alias("REG"))
    people = n.where(key % 3 != 0).select(key.cast("string").alias("COM"), (key * 100).alias("PMUN"))
    return dimensions.build_communes(raw, people).select("code", "norm", "pmun")


@query("build_first_names", "SELECT DISTINCT upper(split_part(n_name, ' ', 1)) AS norm FROM nation WHERE length(split_part(n_name, ' ', 1)) >= 3")
def build_first_names(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.lower(F.element_at(F.split("n_name", " "), 1)).alias("prenom"))
    return dimensions.build_first_names(names.unionByName(spark.createDataFrame([("ab",), ("",)], "prenom string")))


@query("unknown_departments", f"WITH {_DIMS} SELECT DISTINCT dep FROM physicians WHERE dep NOT IN (SELECT dep FROM communes)")
def unknown_departments(spark, sf_dir):
    """Departments with physicians that no commune has; none."""
    dims = _dim(spark)
    return dimensions.unknown_departments(dims.physicians, dims.communes.select("dep"))


@query("unique_commune_names", f"WITH {_DIMS} SELECT norm, min(code) AS code FROM communes GROUP BY norm HAVING count(*) = 1")
def unique_commune_names(spark, sf_dir):
    return _dim(spark).unique_names()


@query(
    "qi_labels",
    f"""WITH {_CASE_SQL} SELECT case_id, 0 AS place, CASE job WHEN 'PROFESSIONNEL_DE_SANTE' THEN 'professionnel de santé' WHEN 'TOUTE_SPECIALITE' THEN 'médecin de toute spécialité' ELSE coalesce(s.label, job) END AS label
    FROM place LEFT JOIN specialties s ON s.code = job
    UNION ALL SELECT case_id, 1, CASE lvl WHEN 0 THEN coalesce(c.libelle, v) ELSE concat('département ', v) END FROM place LEFT JOIN communes c ON c.code = v""",
)
def qi_labels(spark, sf_dir):
    rows = _cases(spark, sf_dir, "a").select("case_id", F.posexplode("qis").alias("place", "qi"))
    return risk.labelled(rows, _dim(spark)).select("case_id", "place", "label")


@query("third_party_filter", _EVAL_DUCK + " SELECT doc_id, CASE type WHEN 'nom' THEN 'person' ELSE type END AS type, s AS start_at, e AS end_at FROM pred WHERE (s % 10) / 10.0 >= 0.35")
def third_party_filter(spark, sf_dir):
    """Another engine's predictions: low scores go, known types are renamed, unknown ones stay."""
    _, pred, _ = _eval(spark, sf_dir)
    scored = pred.withColumn("score", (F.col("start") % 10) / F.lit(10.0))
    return ev.third_party(scored, {"nom": "person"}).select("doc_id", "type", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("ingest_base64", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'text' ELSE 'refused' END AS status, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS text FROM customer")
def ingest_base64(spark, sf_dir):
    k = F.col("c_custkey")
    up = customers(spark, sf_dir, "c_custkey", "c_name").select(k.alias("k"), F.lit("a.txt").alias("filename"), F.when(k % 2 == 0, F.base64(F.encode("c_name", "UTF-8"))).otherwise("%%%").alias("bytes"))
    return documents.from_base64(up).select("k", F.col("ingested.status").alias("status"), F.col("ingested.text").alias("text"))


@query("safe_sink_columns", "SELECT c_custkey AS doc_id, false AS has_secret FROM customer")
def safe_sink_columns(spark, sf_dir):
    """What may be written holds no mapping, text or value."""
    out = ps.safe_columns(ps.redact(corpus(spark, sf_dir).select("doc_id", "text")))
    secret = bool({"mapping", "text"} & set(out.columns)) or "value" in out.schema["entities"].dataType.elementType.names
    return out.select("doc_id", F.lit(secret).alias("has_secret"))
