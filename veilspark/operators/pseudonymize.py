"""Reversible pseudonyms: a token for each identity in a document, the masked text, and the way back.

Numbering and the matching of people's names depend on the order of mentions, so the fold over a document's entities is
one Python function over Arrow batches; restoring is a fold of column expressions. The mapping from tokens to values is a secret:
`safe_columns` drops it, and entity values, from what is written.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS
from .detect import _KIND, DEFAULT, ENTITY, Detector, _of, everything, with_candidates

_MAPPING = pa.map_(pa.string(), pa.string())


def label(entity_type: str) -> str:
    return entity_type.upper()


def mask(text: str, entities: list[dict]) -> tuple[str, list[tuple[str, str]]]:
    """The masked text and (token, value) in order of first mention; entities are by start, without overlaps.

    Equal values of a type share a token. A name takes the token of the only person so far whose words include its words,
    or are included in them; with none or several it is a person of its own. A fuller mention adds to what is known of
    the person, but the value restored is the first one.
    """
    out, at = [], 0
    tokens: dict[tuple[str, str], str] = {}
    people: list[list] = []
    count: dict[str, int] = {}
    mapping: list[tuple[str, str]] = []

    def fresh(kind: str, value: str) -> str:
        count[kind] = count.get(kind, 0) + 1
        token = f"[{label(kind)}_{count[kind]}]"
        mapping.append((token, value))
        return token

    for e in entities:
        kind, value = e["type"], e["value"]
        if kind == "nom":
            words = set(value.lower().split())
            same = [p for p in people if words <= p[0] or p[0] <= words]
            if len(same) == 1:
                if len(words) > len(same[0][0]):
                    same[0][0] = words
                token = same[0][1]
            else:
                token = fresh(kind, value)
                people.append([words, token])
        else:
            token = tokens.get((kind, value)) or tokens.setdefault((kind, value), fresh(kind, value))
        out += [text[at : e["start"]], token]
        at = e["end"]
    return "".join([*out, text[at:]]), mapping


def redact(docs: DataFrame, *, text_col: str = "text", detectors: tuple[Detector, ...] = DEFAULT) -> DataFrame:
    """`docs` with entities, masked and mapping: one stage, no shuffle. A null text has a null mask and no mapping.

    Texts and candidates go through Python once: entities are chosen and masked in the same Arrow function.
    """
    found = with_candidates(docs, text_col, detectors)
    scans = [x for x in detectors if x.scan]
    kind = pa.struct([("entities", _KIND), ("masked", pa.string()), ("mapping", _MAPPING)])

    def one(t: str | None, candidates: list[dict]) -> dict:
        if t is None:
            return {"entities": [], "masked": None, "mapping": None}
        e = everything(t, candidates, scans)
        masked, mapping = mask(t, e) if e else (t, [])
        return {"entities": e, "masked": masked, "mapping": mapping}

    @F.arrow_udf(f"struct<entities:{ENTITY},masked:string,mapping:map<string,string>>")
    def run(texts: pa.Array, candidates: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([one(t, c) for t, c in zip(texts.to_pylist(), candidates.to_pylist(), strict=True)], kind)

    new = ("entities", "masked", "mapping")
    out = found.select(*_of(docs, *new), run.asNondeterministic()(F.col(text_col), "__candidates", F.size("__candidates")).alias("__redacted"))
    return out.select(*_of(docs, *new), *(F.col(f"__redacted.{c}").alias(c) for c in new))


def restored(text: Column, mapping: Column) -> Column:
    """Text with tokens replaced by their values, in order; blanks, case and an underscore in a token may have changed."""

    def put(acc: Column, kv: Column) -> Column:
        name = F.regexp_extract(kv["key"], r"^\[(.*)_([0-9]+)\]$", 1)
        number = F.regexp_extract(kv["key"], r"_([0-9]+)\]$", 1)
        pattern = F.concat(F.lit(rf"(?i)\[{WS}*"), name, F.lit("[ _]*"), number, F.lit(rf"{WS}*\]"))
        return F.regexp_replace(acc, pattern, F.regexp_replace(kv["value"], r"([\\$])", r"\\$1"))

    return F.when(F.contains(text, F.lit("[")), F.aggregate(F.map_entries(mapping), text, put)).otherwise(text)


def safe_columns(df: DataFrame) -> DataFrame:
    """`df` fit for writing: without mapping and text, and entities without their values."""
    out = df.drop(*(c for c in ("mapping", "text") if c in df.columns))
    if "entities" in df.columns:
        out = out.withColumn("entities", F.transform("entities", lambda e: F.struct(e["type"], e["start"], e["end"], e["confidence"], e["tier"])))
    return out


def ask_model(docs: DataFrame, complete, *, instruction: str, text_col: str = "text", detectors: tuple[Detector, ...] = DEFAULT) -> DataFrame:
    """`docs` with masked, reply and restored: `complete(masked text, instruction)` sees masked text only.

    `complete` is called in the executors, once a row; errors become `reply_error`, and such a reply is null.
    """
    reply = pa.struct([("text", pa.string()), ("error", pa.string())])

    @F.arrow_udf("struct<text:string,error:string>")
    def call(texts: pa.Array) -> pa.Array:
        def one(t):
            try:
                return {"text": complete(t, instruction), "error": None}
            except Exception as e:  # a failed call must not end the job
                return {"text": None, "error": type(e).__name__}

        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], reply)

    asked = redact(docs, text_col=text_col, detectors=detectors).withColumn("__reply", call.asNondeterministic()("masked"))
    return asked.select("*", F.col("__reply.text").alias("reply"), F.col("__reply.error").alias("reply_error"), restored(F.col("__reply.text"), F.col("mapping")).alias("restored")).drop("__reply")


def echo(masked_text: str, instruction: str) -> str:
    """An offline stand-in for a language model."""
    return masked_text
