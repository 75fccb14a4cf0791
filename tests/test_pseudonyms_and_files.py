"""Masks and restoring, files, streams, evaluation and risk."""

import base64
import io
import json
import zipfile

import pytest

from veilspark.operators import evaluate as ev
from veilspark.operators import pseudonymize as ps
from veilspark.operators import risk
from veilspark.sources import dimensions, documents
from veilspark.streaming.redaction import redact_folder


def test_masks(spark):
    rows = [
        "au Foyer Les Tilleuls puis au Foyer Les Tilleuls",
        "M. Thomas Dubreuil et Dubreuil Thomas",
        "Vu Dr Nadia Costa. Costa signe à 12 rue des Lilas,\r\n75015 Paris $1 \\2",
        "M. Costa Julien, Mme Costa Sophie, Costa",
        None,
        "rien",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string")
    out = ps.redact(df)
    got = {r.doc_id: r for r in out.withColumn("back", ps.restored(out["masked"], out["mapping"])).collect()}
    assert got[0].masked == "au [ETABLISSEMENT_1] puis au [ETABLISSEMENT_1]" and len(got[0].mapping) == 1
    assert got[1].masked == "M. [NOM_1] et [NOM_1]"
    assert got[3].masked == "M. [NOM_1], Mme [NOM_2], [NOM_3]"
    assert got[4].masked is None and got[5].masked == "rien"
    for i in (0, 3, 5):
        assert got[i].back == rows[i]
    assert {"mapping", "text"}.isdisjoint(ps.safe_columns(out).columns)
    assert "value" not in ps.safe_columns(out).schema["entities"].dataType.elementType.names


def test_tolerant_tokens(spark):
    df = spark.createDataFrame([("[ nom_1 ] [NOM 1] [NOM_1_BIS] [NOM_10]", {"[NOM_1]": "A$1\\b", "[NOM_10]": "Dix"})], "t string, m map<string,string>")
    assert df.select(ps.restored(df.t, df.m)).first()[0] == "A$1\\b A$1\\b [NOM_1_BIS] Dix"


def test_model_sees_masked_text_only(spark):
    df = spark.createDataFrame([("M. Jean Dupont dort",), ("boum",)], "text string")

    def fake(t, instruction):
        if "boum" in t:
            raise ValueError(t)
        assert "Dupont" not in t
        return instruction + t

    rows = ps.ask_model(df, fake, instruction="> ").select("reply", "restored", "reply_error").collect()
    assert tuple(rows[0]) == ("> M. [NOM_1] dort", "> M. Jean Dupont dort", None) and tuple(rows[1]) == (None, None, "ValueError")


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


DOCX = "<w:document><w:body><w:p w:id='1'><w:r n='2'><w:t n='3'>a</w:t ><w:tab/><w:t xml:space='preserve'>b &amp; &#233;</w:t><w:br/><w:t/><w:t a='b'>c</w:t></w:smartTag></w:r></w:p>"
ODT = "<office:text><text:h>Titre</text:h><text:p n='1'>a<text:tab/>b<text:span>c</text:span></text:p><text:p/><text:list-item><text:p>Item</text:p></text:list-item></office:text>"


def test_ingestion(spark):
    mime = documents.ODT_MIMETYPE.decode()
    files = [
        ("a.txt", b"texte", "text", "texte"),
        ("a.TXT", b"\xef\xbb\xbf\xc3\xa9", "text", "é"),
        ("a.md", b"# t", "text", "# t"),
        ("a.txt", b"", "text", ""),
        ("a.docx", zipped(word__document_xml=DOCX), "text", "a\tb & é\nc\n"),
        ("a.odt", zipped(mimetype=mime, content_xml=ODT), "text", "Titre\na\tbc\n\nItem\n"),
        ("a.pdf", b"%PDF", "refused", None),
        ("a", b"x", "refused", None),
        ("a.", b"x", "refused", None),
        ("a.txt", b"%PDF-1", "refused", None),
        ("a.txt", b"\xff\xfea", "refused", None),
        ("a.txt", b"\xff\x00", "refused", None),
        ("a.txt", zipped(x="y"), "refused", None),
        ("a.docx", b"PK no", "refused", None),
        ("a.docx", b"PK\x03\x04 corrupt", "refused", None),
        ("a.docx", zipped(other="x"), "refused", None),
        ("a.odt", zipped(content_xml=ODT), "refused", None),
        ("a.odt", zipped(mimetype="text/plain", content_xml=ODT), "refused", None),
        ("a.odt", zipped(mimetype=mime), "refused", None),
        ("a.docx", None, "refused", None),
    ]
    df = spark.createDataFrame([(i, n, c) for i, (n, c, _, _) in enumerate(files)], "i int, path string, content binary")
    for r in documents.ingest(df).collect():
        assert (r.ingested.status, r.ingested.text) == files[r.i][2:], files[r.i][0]
        assert (r.ingested.reason is None) == (r.ingested.status == "text")
    up = spark.createDataFrame([("a.txt", base64.b64encode(b"ok").decode()), ("a.txt", "!!")], "filename string, bytes string")
    assert [r.ingested.status for r in documents.from_base64(up).collect()] == ["text", "refused"]


def test_zip_bomb():
    data = zipped(word__document_xml=b"<w:t>" + b"0" * 200_000)
    assert "declares" in documents.ingest_bytes(data, "docx", most=1000)["reason"]
    lie = data.replace((200_005).to_bytes(4, "little"), (10).to_bytes(4, "little"))
    got = documents.ingest_bytes(lie, "docx", most=1000)
    assert got["status"] == "refused" and "0000" not in got["reason"]


def test_corpus_files_and_stream(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": 1, "text": "x", "entities": [{"type": "nom", "start": 0, "end": 1}]}\n\n')
    assert documents.read_corpus(spark, str(tmp_path / "c.jsonl")).where("id is not null").first().entities[0].type == "nom"
    spark.createDataFrame([(1, "M. Jean Dupont")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "state"))
    for _ in range(2):
        redact_folder(*args).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r.masked for r in out.collect()] == ["M. [NOM_1]"] and "mapping" not in out.columns


def test_greedy_matches_and_leaks(spark):
    schema = "doc_id long, type string, start int, end int"
    gold = spark.createDataFrame([(1, "a", 0, 4), (1, "a", 4, 8), (2, "b", 0, 3), (3, "a", 0, 2)], schema)
    pred = spark.createDataFrame([(1, "a", 2, 6), (1, "c", 7, 9), (2, "b", 0, 3), (2, "b", 0, 3), (4, "z", 0, 5)], schema)
    got = {r.type: r for r in ev.score(gold, pred).collect()}
    assert (got["a"].overlap_tp, got["a"].strict_tp, got["b"].strict_tp, got["TOTAL"].n_pred) == (1, 0, 1, 5)
    assert got["a"].leaked_chars == 2 + 1 + 2 and got["b"].leaked_chars == 0 and got["z"].strict_recall == 0.0
    assert {(r.type, r.outcome, r.n) for r in ev.boundaries(gold, pred).collect()} == {("a", "start cut", 1), ("a", "end cut", 1), ("a", "missed", 1), ("b", "exact", 1)}


@pytest.fixture(scope="module")
def dims(spark):
    return dimensions.sample(spark)


def cases(spark, *qis):
    return spark.createDataFrame([(i, q) for i, q in enumerate(qis)], f"case_id int, qis array<{risk.QI}>")


def test_risk_of_pinned_cases(spark, dims):
    job, home = ("profession", "11", 0), ("lieu", "57", 1)
    df = cases(spark, [job, home], [("age", "89", 0), ("lieu", "57001", 0)], [], [("profession", "TOUTE_SPECIALITE", 1), home], [("profession", "PROFESSIONNEL_DE_SANTE", 2), home], [job], [("age", "1", 0), ("age", "2", 0)], [("profession", "99", 0), home], [("lieu", "44", 2)], [("lieu", "13055", 0)], [("age", "x", 0)])
    got = {r.case_id: r for r in risk.estimate(df, dims).collect()}
    assert (got[0].f, got[0].upper_bound, got[0].dominant) == (51, True, "profession")
    assert abs(got[1].f - 1.07129) < 1e-4 and got[1].band == "eleve" and got[1].dominant == "lieu"
    assert got[2].f == 69_079_962 and got[2].band == "faible" and got[2].dominant is None
    assert (got[3].f, got[4].f) == (2894, 5107)
    assert all(got[k].error and got[k].f is None for k in range(5, 11))
    traced = {r.case_id: r for r in risk.narrative(risk.audit(risk.explain(df, dims))).collect()}
    assert traced[1].outcome == "suggestion" and abs(traced[1].suggestion.f_after - 3519.5586) < 1e-3 and traced[1].suggestion.to.value == "57"
    assert traced[2].outcome == "succes" and traced[2].candidates == []
    assert json.loads(traced[1].audit)["outcome"] == "suggestion" and "lieu" in traced[1].narrative
    high = {r.case_id: r for r in risk.explain(cases(spark, [("age", "89", 0), ("lieu", "57001", 0)], [("lieu", "FR", 4)]), dims, threshold=10**9).collect()}
    assert high[0].outcome == "epuisement" and high[0].suggestion is not None and high[0].blocking == ["age", "lieu"]
    assert high[1].outcome == "epuisement" and high[1].suggestion is None
    with pytest.raises(Exception, match="more than one"):
        risk.strict(risk.estimate(df.where("case_id = 6"), dims)).collect()


def test_age_ladder(spark, dims):
    steps, q = [], ("age", "89", 0)
    for _ in range(4):
        to = risk.simulate(cases(spark, [q]), dims).first()["to"]
        q = tuple(to)
        steps.append(q[1])
    assert steps == ["85-89", "80-89", "65-130", ""]


def test_extraction_and_readers(spark, dims, tmp_path):
    df = spark.createDataFrame([(1, "La pharmacienne de Thionville, 45 ans, vit à Aboncourt."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: [(q.type, q.value) for q in r.qis] for r in risk.extract(df, dims).collect()}
    assert got == {1: [("profession", "pharmacien"), ("profession", "pharmacien"), ("lieu", "57672"), ("age", "45")], 2: []}
    (tmp_path / "p.json").write_text('{"labels": {"01": "x"}, "by_dep": {"57": {"01": 3}}}')
    assert dimensions.read_physicians(spark, str(tmp_path / "p.json"))[1].first() == ("57", "01", 3)
    (tmp_path / "c.csv").write_text("COM;DEP;REG;PMUN;NORM;LIBELLE\n57001;57;44;;ABONCOURT;Aboncourt\n")
    assert dimensions.read_communes(spark, str(tmp_path / "c.csv")).first().pmun is None
    (tmp_path / "a.json").write_text('{"0": 5}')
    assert dimensions.read_ages(spark, str(tmp_path / "a.json")).first() == (0, 5)
    raw = spark.createDataFrame([("057 -Moselle",), ("02A",), ("971",)], "d string")
    assert [r[0] for r in raw.select(dimensions.department_code(raw.d)).collect()] == ["57", "2A", "971"]
