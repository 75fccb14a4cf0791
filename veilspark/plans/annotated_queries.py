"""Queries over corpora of several entities a text, reports, files of every format, and reference tables read from files."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect as d
from ..operators import evaluate as ev
from ..operators import pseudonymize as ps
from ..operators import report, risk
from ..session import shared_dir, table, tracked, written
from ..sources import dimensions, documents
from . import annotated
from . import corpus_sql as sql
from .catalogue import _CASE_SQL, _DIMS, _cases, _dim, corpus, customers, from_customers, query, spans

# == detection on annotated corpora ==


def _docs(spark, sf_dir, name: str) -> DataFrame:
    """(doc_id, text, gold), written once."""
    return written(from_customers(spark, sf_dir, annotated.in_one_pass(name), "SELECT * FROM docs"), "annotated")


def _gold(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("gold").alias("g")).select("doc_id", "g.type", "g.start", "g.end")


def _found(docs: DataFrame) -> DataFrame:
    return spans(d.detect(docs.select("doc_id", "text"))).select("doc_id", "type", F.col("start_at").alias("start"), F.col("end_at").alias("end"))


def _spans_query(name: str):
    def run(spark, sf_dir):
        return _found(_docs(spark, sf_dir, name)).select("doc_id", "type", F.col("start").alias("start_at"), F.col("end").alias("end_at"))

    return run


def _scores_query(name: str):
    def run(spark, sf_dir):
        docs = _docs(spark, sf_dir, name)
        s = ev.score(_gold(docs), _found(docs))
        return s.select("type", "n_gold", "n_pred", "strict_tp", *(F.round(f"strict_{m}", 6).alias(f"strict_{m}") for m in ("precision", "recall", "f1")), F.round("leak_rate", 6).alias("leak_rate"))

    return run


_P, _R = "coalesce(tp / nullif(np, 0), 0)", "coalesce(tp / nullif(ng, 0), 0)"
_SCORES = f""", t AS (SELECT DISTINCT type FROM (SELECT type FROM gold UNION ALL SELECT type FROM found)),
  hit AS (SELECT g.type, count(*) AS n FROM gold g JOIN found f USING (doc_id, type, start_at, end_at) GROUP BY 1),
  chars AS (SELECT doc_id, type, unnest(range(start_at, end_at)) AS i FROM gold), seen AS (SELECT DISTINCT doc_id, unnest(range(start_at, end_at)) AS i FROM found),
  lost AS (SELECT c.type, count(*) AS n FROM chars c ANTI JOIN seen s ON c.doc_id = s.doc_id AND c.i = s.i GROUP BY 1),
  per AS (SELECT t.type, (SELECT count(*) FROM gold g WHERE g.type = t.type) AS ng, (SELECT count(*) FROM found f WHERE f.type = t.type) AS np, coalesce(hit.n, 0) AS tp,
    (SELECT count(*) FROM chars c WHERE c.type = t.type) AS nc, coalesce(lost.n, 0) AS nl FROM t LEFT JOIN hit ON hit.type = t.type LEFT JOIN lost ON lost.type = t.type),
  every AS (SELECT * FROM per UNION ALL SELECT 'TOTAL', sum(ng), sum(np), sum(tp), sum(nc), sum(nl) FROM per)
SELECT type, ng::BIGINT AS n_gold, np::BIGINT AS n_pred, tp::BIGINT AS strict_tp, round({_P}, 6) AS strict_precision, round({_R}, 6) AS strict_recall,
  round(coalesce(2 * {_P} * {_R} / nullif({_P} + {_R}, 0), 0), 6) AS strict_f1, round(coalesce(nl / nullif(nc, 0), 0), 6) AS leak_rate FROM every"""

for _name in annotated.TEMPLATES:
    query(f"annotated_{_name}_spans", f"WITH {annotated.ctes(_name)} SELECT doc_id, type, start_at, end_at FROM found")(_spans_query(_name))
    if _name != "witness":
        query(f"annotated_{_name}_scores", f"WITH {annotated.ctes(_name)}{_SCORES}")(_scores_query(_name))


@query("annotated_masked", f"WITH {annotated.ctes('realistic')} SELECT doc_id, count(*) AS n_entities, count(DISTINCT type)::BIGINT AS n_types FROM found GROUP BY doc_id")
def annotated_masked(spark, sf_dir):
    """Texts with several entities restore exactly, and their entities are counted by type."""
    out = ps.redact(_docs(spark, sf_dir, "realistic").select("doc_id", "text"))
    exact = out.where(ps.restored(F.col("masked"), F.col("mapping")) == F.col("text"))
    return exact.select("doc_id", F.size("entities").cast("bigint").alias("n_entities"), F.size(report.type_counts(F.col("entities"))).cast("bigint").alias("n_types"))


@query(
    "siren_collisions",
    f"WITH {annotated.ctes('structural')}, traps AS (SELECT f.* FROM found f ANTI JOIN gold g ON f.doc_id = g.doc_id AND f.type = g.type AND f.start_at = g.start_at) SELECT type, count(*) AS n_false, count(DISTINCT doc_id) AS n_docs FROM traps GROUP BY type",
)
def siren_collisions(spark, sf_dir):
    """Company numbers that are taken for establishment numbers: every false positive of the structural corpus."""
    docs = _docs(spark, sf_dir, "structural")
    bad = _found(docs).join(_gold(docs), ["doc_id", "type", "start"], "left_anti")
    return bad.groupBy("type").agg(F.count(F.lit(1)).alias("n_false"), F.count_distinct("doc_id").alias("n_docs"))


# == reports ==


@query("first_missed_names", f"WITH {annotated.ctes('adversarial')} SELECT g.doc_id, g.start_at, g.end_at, substring(text, g.start_at + 1, g.end_at - g.start_at) AS fragment FROM gold g ANTI JOIN found f ON g.doc_id = f.doc_id AND f.start_at < g.end_at AND g.start_at < f.end_at JOIN docs USING (doc_id) WHERE g.type = 'nom' ORDER BY g.doc_id, g.start_at LIMIT 20")
def first_missed_names(spark, sf_dir):
    """The first twenty names that are missed or found in part (here: missed)."""
    docs = _docs(spark, sf_dir, "adversarial")
    return report.first_examples(docs, _gold(docs), _found(docs), "nom").select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "fragment")


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(
    "marked_texts",
    f"""WITH {sql.CORPUS} SELECT doc_id, concat({_ESC.format('prefix')}, '<mark class="', type, '" title="', type, ', ', confidence, '">', {_ESC.format('value')}, '</mark>', {_ESC.format('suffix')}) AS spans_html,
      concat({_ESC.format('prefix')}, '<mark class="', upper(type), '">[', upper(type), '_1]</mark>', {_ESC.format('suffix')}) AS tokens_html,
      concat({_ESC.format('prefix')}, '<mark class="', type, '">', {_ESC.format('value')}, '</mark>', {_ESC.format('suffix')}) AS values_html, concat('1 entity: 1 ', type) AS counted FROM corpus""",
)
def marked_texts(spark, sf_dir):
    out = ps.redact(corpus(spark, sf_dir).select("doc_id", "text"))
    e, t = F.col("entities"), F.col("text")
    return out.select("doc_id", report.marked_spans(t, e).alias("spans_html"), report.marked_tokens(F.col("masked")).alias("tokens_html"), report.marked_values(t, e).alias("values_html"), report.counts_sentence(e).alias("counted"))


@query("entity_counts", f"WITH {sql.CORPUS} SELECT type, count(*) AS n FROM corpus GROUP BY type")
def entity_counts(spark, sf_dir):
    counted = d.detect(corpus(spark, sf_dir).select("doc_id", "text")).select(F.explode(report.type_counts(F.col("entities"))).alias("c"))
    return counted.groupBy("c.type").agg(F.sum("c.n").cast("bigint").alias("n"))


# == files ==

_DOCX = '<w:document><w:body><w:p><w:r><w:t xml:space="preserve">{}</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>fin</w:t></w:r></w:p></w:body></w:document>'
_ODT = "<office:text><text:h>{}</text:h><text:p>a<text:tab/>b</text:p></office:text>"


def _archives(spark, sf_dir, kind: str) -> DataFrame:
    """(k, path, content): an office file a customer, with the customer's name and comment, entities encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(1).to_pylist():
                body, buffer = f"{name} &amp; &#233;&#x41;&lt;", io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    if kind == "docx":
                        z.writestr("word/document.xml", _DOCX.format(body))
                    elif kind == "odt":
                        z.writestr("mimetype", documents.ODT_MIMETYPE)
                        z.writestr("content.xml", _ODT.format(body))
                    else:
                        z.writestr("word/document.xml", _DOCX.format(body + "0" * 5000))
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"notes.{'odt' if kind == 'odt' else 'docx'}"] * len(out)), pa.array(out, pa.binary())], names=["k", "path", "content"])

    return customers(spark, sf_dir, "c_custkey", "c_name").mapInArrow(run, "k long, path string, content binary")


@query("ingest_docx", "SELECT c_custkey AS k, 'text' AS status, concat(c_name, ' & éA<', chr(9), 'x', chr(10), 'fin', chr(10)) AS text FROM customer")
def ingest_docx(spark, sf_dir):
    return documents.ingest(_archives(spark, sf_dir, "docx")).select("k", F.col("ingested.status").alias("status"), F.col("ingested.text").alias("text"))


@query("ingest_odt", "SELECT c_custkey AS k, 'text' AS status, concat(c_name, ' & éA<', chr(10), 'a', chr(9), 'b', chr(10)) AS text FROM customer")
def ingest_odt(spark, sf_dir):
    return documents.ingest(_archives(spark, sf_dir, "odt")).select("k", F.col("ingested.status").alias("status"), F.col("ingested.text").alias("text"))


@query("ingest_inflation_guard", "SELECT c_custkey AS k, 'refused' AS status, 'word/document.xml declares more than 4096 bytes' AS reason FROM customer")
def ingest_inflation_guard(spark, sf_dir):
    """Entries that inflate beyond the bound are refused."""
    return documents.ingest(_archives(spark, sf_dir, "large"), most=4096).select("k", F.col("ingested.status").alias("status"), F.col("ingested.reason").alias("reason"))


@query("predictions_as_json_lines", f"WITH {sql.CORPUS} SELECT doc_id, type, start_at, end_at FROM corpus")
def predictions_as_json_lines(spark, sf_dir):
    """Predictions written as JSON lines and scanned again."""
    at = tracked(f"{shared_dir(spark)}/predictions-{uuid.uuid4().hex}")
    documents.write_predictions(d.detect(corpus(spark, sf_dir).select("doc_id", "text")), at)
    rows = documents.read_corpus(spark, at).select(F.col("id").alias("doc_id"), F.explode("entities").alias("e"))
    return rows.select("doc_id", F.col("e.type").alias("type"), F.col("e.start").alias("start_at"), F.col("e.end").alias("end_at"))


# == reference tables from files ==


@query(
    "reference_files",
    f"""WITH {_DIMS} SELECT 'communes' AS part, code AS key, coalesce(pmun, -1)::BIGINT AS n FROM communes UNION ALL SELECT 'physicians', concat(dep, '/', code), n::BIGINT FROM physicians
    UNION ALL SELECT 'professions', concat(dep, '/', profession), n::BIGINT FROM professions UNION ALL SELECT 'ages', age::VARCHAR, n::BIGINT FROM ages
    UNION ALL SELECT 'specialties', concat(code, '/', label), 0 FROM specialties UNION ALL SELECT 'regions', concat(reg, '/', label), 0 FROM regions
    UNION ALL SELECT 'departments', concat(dep, '/', min(reg)), 0 FROM communes GROUP BY dep UNION ALL SELECT DISTINCT 'first names', norm, 0 FROM communes""",
)
def reference_files(spark, sf_dir):
    """The reference tables written in the formats they are published in, and read again."""
    dims, at = _dim(spark), tracked(f"{shared_dir(spark)}/reference-{uuid.uuid4().hex}")

    def nested(df: DataFrame, outer: str, inner: str):
        by = df.groupBy(outer).agg(F.map_from_entries(F.collect_list(F.struct(inner, "n"))).alias("m"))
        return by.agg(F.map_from_entries(F.collect_list(F.struct(outer, "m"))).alias("m"))

    def flat(df: DataFrame, key: str, value: str):
        return df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), value))).alias("m"))

    c = dims.communes
    c.select(F.col("code").alias("COM"), F.col("libelle").alias("LIBELLE"), F.col("norm").alias("NORM"), F.col("dep").alias("DEP"), F.col("reg").alias("REG"), F.col("pmun").alias("PMUN")).coalesce(1).write.option("sep", ";").option("header", True).option("compression", "gzip").csv(f"{at}/communes")
    labels = flat(dims.specialties, "code", "label").withColumnRenamed("m", "labels")
    texts = {
        "physicians": labels.join(nested(dims.physicians, "dep", "code")).select(F.to_json(F.struct("labels", F.col("m").alias("by_dep")))),
        "professions": nested(dims.professions, "profession", "dep").select(F.to_json("m")),
        "ages": flat(dims.ages, "age", "n").select(F.to_json("m")),
        "hierarchy": flat(c.groupBy("dep").agg(F.min("reg").alias("reg")), "dep", "reg").withColumnRenamed("m", "dep_reg").join(flat(dims.regions, "reg", "label").withColumnRenamed("m", "reg_label")).select(F.to_json(F.struct("dep_reg", "reg_label"))),
        "names": c.select("norm"),
    }
    for name, df in texts.items():
        df.coalesce(1).write.option("compression", "gzip" if name == "names" else "none").text(f"{at}/{name}")
    specialties, physicians = dimensions.read_physicians(spark, f"{at}/physicians")
    departments, regions = dimensions.read_hierarchy(spark, f"{at}/hierarchy")
    none = F.lit(0)
    parts = (
        ("communes", dimensions.read_communes(spark, f"{at}/communes"), F.col("code"), F.coalesce("pmun", F.lit(-1))),
        ("physicians", physicians, F.concat_ws("/", "dep", "code"), F.col("n")),
        ("professions", dimensions.read_professions(spark, f"{at}/professions"), F.concat_ws("/", "dep", "profession"), F.col("n")),
        ("ages", dimensions.read_ages(spark, f"{at}/ages"), F.col("age").cast("string"), F.col("n")),
        ("specialties", specialties, F.concat_ws("/", "code", "label"), none),
        ("regions", regions, F.concat_ws("/", "reg", "label"), none),
        ("departments", departments, F.concat_ws("/", "dep", "reg"), none),
        ("first names", dimensions.read_first_names(spark, f"{at}/names"), F.col("norm"), none),
    )
    out = None
    for part, df, key, n in parts:
        rows = df.select(F.lit(part).alias("part"), key.alias("key"), n.cast("bigint").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("orphan_departments", f"WITH {_DIMS}, p AS (SELECT dep, n FROM physicians UNION ALL SELECT concat('X', c_custkey % 7), 1 FROM customer UNION ALL SELECT '999', 1) SELECT DISTINCT dep FROM p WHERE dep NOT IN (SELECT dep FROM communes) AND dep NOT IN ('000', '999')")
def orphan_departments(spark, sf_dir):
    """Departments in counts that no commune has; totals (000, 999) aren't departments."""
    dims = _dim(spark)
    more = table(spark, sf_dir, "customer").select(F.concat(F.lit("X"), (F.col("c_custkey") % 7).cast("string")).alias("dep"))
    counts = dims.physicians.select("dep").unionByName(more).unionByName(spark.createDataFrame([("999",)], "dep string"))
    return dimensions.unknown_departments(counts, dims.communes.select("dep").distinct())


# == the audit ==


@query("audit_fields", f"WITH {_CASE_SQL} SELECT case_id, round(f, 4) AS f, CASE WHEN f < 10 THEN 'eleve' WHEN f < 50 THEN 'moyen' WHEN f IS NOT NULL THEN 'faible' END AS band, 20::BIGINT AS threshold, age::VARCHAR AS age, 2::BIGINT AS n_qis, CASE WHEN f IS NOT NULL THEN true END AS told FROM e")
def audit_fields(spark, sf_dir):
    """Fields of the audit's JSON, and whether the narrative names the case's age."""
    j = F.from_json("audit", "qis array<struct<type:string,value:string>>, f double, band string, threshold bigint")
    out = risk.narrative(risk.audit(risk.explain(_cases(spark, sf_dir, "b"), _dim(spark)))).withColumn("j", j)
    age = F.filter("j.qis", lambda q: q["type"] == "age")[0]["value"]
    told = F.when(F.col("j.f").isNotNull(), F.contains(F.col("narrative"), F.concat(F.lit("age "), age)))
    return out.select("case_id", F.round("j.f", 4).alias("f"), F.col("j.band").alias("band"), F.col("j.threshold").alias("threshold"), age.alias("age"), F.size("j.qis").cast("bigint").alias("n_qis"), told.alias("told"))
