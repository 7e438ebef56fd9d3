"""Walks over JSON documents of any shape, and the gates that look at every field of one.

A level of all documents is opened at a time, by casts of variants to maps and arrays: native expressions, one narrow pass. How many
levels there are is asked of the data first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import catalog as C
from gridlark.operators.gates import address_literal, private_key
from gridlark.session import staged, work_dir

#: Documents nested deeper are a finding by themselves and aren't opened further.
MAX_DEPTH = 48
#: Levels that are counted by taking brackets away; deeper documents are gone through character by character.
SHALLOW = 8
_ENTRY = "array<struct<path:string,key:string,text:string>>"


def nesting(text: Column) -> Column:
    """How many brackets of a JSON text are open at most."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++', "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    exact = lambda bare: F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), start, step, lambda s: s["most"])
    # each pass takes the innermost pairs: a shallow document is empty after as many passes as it has levels
    inside = lambda b: F.regexp_replace(b, r"\[\]|\{\}", "")
    level = lambda b, k: F.when(b == "", F.lit(k))

    def from_level(b: Column, k: int, whole: Column) -> Column:
        rest = exact(whole) if k == SHALLOW else F.get(F.transform(F.array(inside(b)), lambda c: from_level(c, k + 1, whole)), F.lit(0))
        return level(b, k).otherwise(rest)

    return F.get(F.transform(F.array(bare), lambda b: from_level(b, 0, b)), F.lit(0))


def _children(frontier: str) -> Column:
    """Fields and elements of all containers of a frontier, with their paths."""

    def opened(f: Column) -> Column:
        fields = F.transform(F.map_entries(F.try_variant_get(f["v"], "$", "map<string,variant>")), lambda e: F.struct(F.when(f["path"] == "", e["key"]).otherwise(F.concat(f["path"], F.lit("."), e["key"])).alias("path"), e["key"].alias("key"), e["value"].alias("v")))
        items = F.transform(F.try_variant_get(f["v"], "$", "array<variant>"), lambda x, k: F.struct(F.concat(f["path"], F.lit("["), k.cast("string"), F.lit("]")).alias("path"), F.lit(None).cast("string").alias("key"), x.alias("v")))
        return F.coalesce(fields, items)

    return F.flatten(F.filter(F.transform(frontier, opened), lambda x: x.isNotNull()))


#: Parts that every name which ``private_key`` takes has one of, all parts of an entry together.
_NAME_PARTS = (("source_ip",), ("payload",), ("credential",), ("passw",), ("secret",), ("token",), ("username",), ("bearer",), ("cookie",), ("authorization",), ("api", "key"), ("access", "key"), ("private", "key"), ("auth", "header"))


def _once(text: Column, test: Callable[[Column], Column]) -> Column:
    """A test that names its text often, with the text worked out once."""
    return F.coalesce(F.exists(F.array(text), test), F.lit(False))


def _may_hold_address(text: Column) -> Column:
    """True for every text with an address, and for some others."""
    # two patterns: each has one character to look for, where one of both would try all ways at every place
    return text.contains("::") | text.rlike(r"\.[0-9]{1,3}\.[0-9]{1,3}\.") | text.rlike(":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:")


def may_be_found(text: Column) -> Column:
    """False where a document's JSON surely holds neither an address nor a private name: only the others need a walk."""
    return _once(text, _column_may_be_found)


def _column_may_be_found(text: Column) -> Column:
    """``may_be_found`` of a text that is a column already, which isn't worked out anew for each place that names it."""
    named = lambda name: reduce(or_, (reduce(and_, (name.contains(p) for p in parts)) for parts in _NAME_PARTS))
    return _may_hold_address(text) | _once(F.lower(text), named)


def _may_be_deep(text: Column) -> Column:
    """True for every text nested more than ``MAX_DEPTH`` levels: it has more opening brackets than that, be they in strings."""
    return text.rlike(r"^(?:[^\[{]*+[\[{]){%d}" % (MAX_DEPTH + 1))


def _plain_and_clean(value: Column) -> Column:
    """True only where JSON as it was written surely holds nothing to be found below its first level: without an escape its strings are what they say."""
    return ~(value.contains("\\") | _column_may_be_found(value) | _may_be_deep(value))


def walked(documents: DataFrame, prefix: Column | None = None, worth: Callable[[Column], Column] = lambda text: F.lit(True)) -> DataFrame:
    """(…, v, text) -> adds ``entries``: (path, key, text) of every field, and of every text in a list (key null), and ``too_deep``.

    ``v`` is the document as a variant, ``text`` its JSON. Paths are ``a.b[0].c``, below ``prefix``; a field's text is null unless it is a
    string. Documents whose text isn't ``worth`` a walk stay closed and have no entries.
    """
    start = F.array(F.struct((F.lit("") if prefix is None else prefix).alias("path"), F.col("v").alias("v")))
    d = documents.withColumn("worth", worth(F.col("text")))
    # how deep a closed document is matters only where it may be too deep
    d = d.withColumn("depth", F.when(F.col("worth") | _may_be_deep(F.col("text")), nesting(F.col("text"))))
    levels = min(d.where("worth").agg(F.max("depth")).first()[0] or 0, MAX_DEPTH)
    d = d.withColumns({"too_deep": F.coalesce(F.col("depth") > MAX_DEPTH, F.lit(False)), "entries": F.array().cast(_ENTRY), "frontier": F.when(F.col("worth"), start).otherwise(F.slice(start, 1, 0))}).drop("depth", "worth")
    for _ in range(levels):
        d = d.withColumn("children", _children("frontier"))
        said = F.transform("children", lambda c: F.struct(c["path"].alias("path"), c["key"].alias("key"), F.when(F.schema_of_variant(c["v"]) == "STRING", F.try_variant_get(c["v"], "$", "string")).alias("text")))
        inner = F.filter("children", lambda c: F.schema_of_variant(c["v"]).startswith("OBJECT") | F.schema_of_variant(c["v"]).startswith("ARRAY"))
        d = d.withColumns({"entries": F.concat("entries", F.filter(said, lambda e: e["key"].isNotNull() | e["text"].isNotNull())), "frontier": inner}).drop("children")
    return d.drop("frontier")


def _finding(bad: Column, code: str, place: Column | str, message: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), as_column(place).alias("place"), as_column(message).alias("message")))


def _field_findings(entries: str, subject: str) -> Column:
    """Names that may not be published and texts with an address, by path."""
    named = F.transform(F.filter(entries, lambda e: F.coalesce(private_key(e["key"]), F.lit(False))), lambda e: F.struct(F.lit("forbidden_field").alias("code"), e["path"].alias("place"), F.concat(F.lit(f"forbidden {subject}field "), e["path"]).alias("message")))
    found = F.transform(F.filter(entries, lambda e: address_literal(e["text"])), lambda e: F.struct(F.lit("address_found").alias("code"), e["path"].alias("place"), F.concat(F.lit(f"address or network prefix found in {subject and subject + 'field '}"), e["path"]).alias("message")))
    return F.array_sort(F.concat(named, found), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).when(a["code"] < b["code"], 1).otherwise(-1))


def _opened(lines: DataFrame) -> DataFrame:
    """(line_no, value) -> v, kind and canonical text of each line that isn't blank."""
    keys = [c for c in ("file",) if c in lines.columns]
    one = lines.where(F.length(F.btrim("value", F.lit(" \t\r\n\x0b\x0c"))) > 0).select(*keys, "line_no", F.try_parse_json("value").alias("v"))
    kind = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    return one.select("*", kind.alias("kind")).withColumn("text", F.when(F.col("kind").startswith("OBJECT"), F.to_json("v")))


def public_findings(lines: DataFrame) -> DataFrame:
    """Publication rules with field paths: (line_no, place_no, code, place, message), (file) before where lines have one.

    A record's rules come first, then its fields by path. A text inside a list is looked at too. A line without an object in it has that
    finding alone.
    """
    one = walked(_opened(lines), worth=may_be_found)
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")), F.lit("MISSING"))
    source = F.when(kind("source_id") == "STRING", F.try_variant_get("v", "$.source_id", "string"))
    clean = (kind("sanitized") == "BOOLEAN") & F.coalesce(F.try_variant_get("v", "$.sanitized", "boolean"), F.lit(False))
    named = F.length(F.trim(F.coalesce(source, F.lit("")))) > 0
    rules = F.array_compact(
        F.array(
            _finding(~clean, "not_sanitized", "sanitized", "sanitized flag is not true"), _finding(kind("is_demo") != "BOOLEAN", "no_classification", "is_demo", "is_demo must be a boolean classification"),
            _finding(~named, "no_source_id", "source_id", "source_id is required"), _finding(named & address_literal(source), "source_id_is_address", "source_id", "source_id contains an address literal"), _finding(F.col("too_deep"), "nested_too_deep", "", f"nested more than {MAX_DEPTH} levels"),
        )
    )
    found = F.when(F.col("v").isNull(), F.array(_finding(F.lit(True), "malformed_json", "", "malformed JSON"))).when(~F.col("kind").startswith("OBJECT"), F.array(_finding(F.lit(True), "record_not_object", "", "record must be a JSON object"))).otherwise(F.concat(rules, _field_findings("entries", "")))
    keys = [c for c in ("file",) if c in lines.columns]
    out = one.select(*keys, "line_no", F.posexplode(found).alias("place_no", "f"))
    return out.select(*keys, "line_no", "place_no", "f.code", "f.place", F.concat(F.when(F.col("f.code").isin("malformed_json", "record_not_object"), "line ").otherwise("record "), F.col("line_no").cast("string"), F.lit(": "), F.col("f.message")).alias("message"))


class PublicationError(ValueError):
    """A dataset that may not be published; ``errors`` are its first ``MOST`` findings."""

    MOST = 10

    def __init__(self, errors: list[str]):
        self.errors = tuple(errors[: self.MOST])
        super().__init__("; ".join(self.errors))


def require_public(lines: DataFrame) -> DataFrame:
    """The lines, once all of them may be published; malformed lines are reported before any rule is."""
    found = public_findings(lines)
    # malformed lines come first and keep the others out
    parse = F.col("code").isin("malformed_json", "record_not_object")
    order = [*(["file"] if "file" in found.columns else []), "line_no", "place_no"]
    first = found.withColumn("parse", parse).orderBy(F.desc("parse"), *order).limit(PublicationError.MOST).collect()
    if first:
        raise PublicationError([r.message for r in first if r.parse == first[0].parse])
    one = _opened(lines).agg(F.count("*").alias("n"), F.countDistinct(F.try_variant_get("v", "$.is_demo", "boolean")).alias("classes")).first()
    if not one.n:
        raise PublicationError(["dataset is empty"])
    if one.classes > 1:
        raise PublicationError(["synthetic and observed classifications must not be mixed"])
    return lines


def bundle_findings(objects: DataFrame, folder: str | None = None) -> DataFrame:
    """The second gate, on an exported bundle's objects: (number, value) -> (number, code, place, message), by field path.

    Objects that may have a finding are written to ``folder`` (else a new one), so that all others are looked at once.

    ``number`` is the object's place in the bundle, from 0; a line that is no object with a type is a finding.
    """
    has_type = lambda v: F.coalesce(F.try_variant_get(v, "$.type", "string").isNotNull(), F.lit(False))
    # most objects are told by their text as it was written and one parse of it
    unclear = ~_plain_and_clean(F.col("value")) | ~has_type(F.try_parse_json("value"))
    few = staged(objects.where(F.coalesce(unclear, F.lit(True))).select("number", "value"), f"{folder or work_dir(objects.sparkSession)}/unclear")
    one = few.select("number", F.try_parse_json("value").alias("v"))
    one = one.withColumn("text", F.to_json("v")).withColumn("typed", has_type(F.col("v")))
    prefix = F.concat(F.lit("objects["), F.col("number").cast("string"), F.lit("]"))
    # objects that can't have a finding aren't gone into
    one = one.where(may_be_found(F.col("text")) | ~F.col("typed") | F.coalesce(nesting(F.col("text")) > MAX_DEPTH, F.lit(False)))
    one = walked(one, prefix, may_be_found)
    rules = F.array_compact(F.array(_finding(~F.col("typed"), "not_an_object", prefix, F.concat(prefix, F.lit(" is no object with a type"))), _finding(F.col("too_deep"), "nested_too_deep", prefix, F.concat(prefix, F.lit(f" is nested more than {MAX_DEPTH} levels")))))
    found = one.select("number", F.explode(F.concat(rules, _field_findings("entries", "STIX "))).alias("f"))
    return found.select("number", "f.code", "f.place", "f.message")


#: Fixed values of a layer.
LAYER_DOMAIN, LAYER_VERSION, NAVIGATOR_LEAST = "ics-attack", "4.5", (4, 9, 0)
LAYER_FORBIDDEN = ("source_id", "session_id", "source_ip", "raw_payload_hex", "payload")
TECHNIQUE_ID = r"^T\d{4}(\.\d{3})?$"


def layer_findings(layers: DataFrame) -> DataFrame:
    """Rules of a Navigator layer: (layer_id, value) -> (layer_id, place_no, message), in order of the rules."""
    one = layers.select("layer_id", F.try_parse_json("value").alias("v"))
    one = walked(one.withColumn("text", F.to_json("v")), worth=lambda text: _once(text, lambda t: reduce(or_, (t.contains(n) for n in LAYER_FORBIDDEN), _may_hold_address(t))))
    text = lambda path: F.try_variant_get("v", path, "string")
    kind = lambda v, path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("MISSING"))
    whole = lambda k: k.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    parts = F.transform(F.split(F.coalesce(text("$.versions.navigator"), F.lit("0")), r"\."), lambda p: p.try_cast("int"))
    least = F.array(*map(F.lit, NAVIGATOR_LEAST))
    # compared as sequences: a null part counts as nothing at all
    old = F.when(F.exists(parts, lambda p: p.isNull()), F.lit(True)).otherwise(parts < least)
    techniques = F.try_variant_get("v", "$.techniques", "array<variant>")

    def of_technique(t: Column, k: Column) -> Column:
        tid, at = F.try_variant_get(t, "$.techniqueID", "string"), F.concat(F.lit("techniques["), k.cast("string"), F.lit("]"))
        known = F.coalesce(tid.rlike(TECHNIQUE_ID) & tid.isin(*C.TECHNIQUES), F.lit(False))
        score = F.when(whole(kind(t, "$.score")), F.try_variant_get(t, "$.score", "long"))
        return F.array_compact(
            F.array(
                F.when(~known, F.concat(at, F.lit(" has an unsupported techniqueID"))), F.when(F.coalesce(score < 0, F.lit(True)), F.concat(at, F.lit(".score must be a non-negative integer"))),
                F.when(kind(t, "$.comment") != "STRING", F.concat(at, F.lit(".comment must be a string"))),
            )
        )

    # quoted names count wherever they stand, as names or as texts
    named = F.exists("entries", lambda e: F.coalesce(e["key"].isin(*LAYER_FORBIDDEN), F.lit(False)) | F.coalesce(e["text"].isin(*LAYER_FORBIDDEN), F.lit(False)))
    rules = F.concat(
        F.array_compact(
            F.array(
                F.when(kind("v", "$.name").isin("MISSING", "VOID"), "name is required"), F.when(~F.coalesce(text("$.domain") == LAYER_DOMAIN, F.lit(False)), f"domain must be {LAYER_DOMAIN}"),
                F.when(~F.coalesce(text("$.versions.layer") == LAYER_VERSION, F.lit(False)), f"versions.layer must be {LAYER_VERSION}"), F.when(old, f"versions.navigator must be at least {'.'.join(map(str, NAVIGATOR_LEAST))}"),
                F.when(techniques.isNull(), "techniques must be a list"),
            )
        ),
        F.coalesce(F.flatten(F.transform(techniques, of_technique)), F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(named, "layer contains a forbidden identifier or payload key"), F.when(F.exists("entries", lambda e: address_literal(e["text"])), "layer contains an IP address literal"))),
    )
    found = F.when(F.col("v").isNull(), F.array(F.lit("layer is no JSON"))).otherwise(rules)
    return one.select("layer_id", F.posexplode(found).alias("place_no", "message"))
