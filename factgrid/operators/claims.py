"""Claims out of model responses: JSON first, else phrases, each claim a typed row.

claims(file_id, run_id, ord, text, claim_type, subject, object, predicate, confidence, source_step, metadata). ord is the
order of extraction, which de-duplication and coherence rest on. Everything is a built-in expression: patterns run as
regexp_extract_all, JSON as VARIANT, so a malformed item doesn't cost its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgrid.functions.names import is_identifier
from factgrid.schemas import CLAIM_TYPES

# Phrase patterns, in the order in which they are tried; the groups are subject and object.
CALL_PATTERNS = (
    r"(\w+)\s+(?:fonksiyonu|metodu)?\s*[,]?\s*(\w+)\s*(?:'[yiıuü]|'[yiıuü]|[yiıuü])?\s*çağır",
    r"(\w+)\s+(?:fonksiyonu|metodu)?\s+(\w+)\s+(?:fonksiyonunu|metodunu)\s+çağır",
    r"(\w+)\s+içinde\s+(\w+)\s+çağr[ıi]l",
    r"(\w+)\s+(?:tarafından)?\s*(\w+)\s+(?:çağrılıyor|çağırılır)",
    r"(\w+)\s+(?:function|method)?\s*calls?\s+(\w+)",
    r"(\w+)\s+invokes?\s+(\w+)",
    r"(\w+)\s+executes?\s+(\w+)",
    r"in\s+(\w+)[,]?\s+(\w+)\s+is\s+called",
    r"(\w+)\s*->\s*(\w+)",
    r"(\w+)\s*→\s*(\w+)",
    r"ÇAĞIRIYOR:\s*(\w+).*?(\w+)",
    r"FONKSIYON:\s*(\w+)\s*\n\s*ÇAĞIRIYOR:\s*(\w+)",
    r"FONKSIYON:\s*(\w+).*?ÇAĞIRIYOR:\s*(\w+)",
)
DATA_FLOW_PATTERNS = (
    r"(\w+)\s+(?:değişkeni|verisi)?\s*(\w+)\s*'?(?:den|dan|ten|tan)\s+(?:gelir|alınır|elde edilir)",
    r"(\w+)\s+(\w+)\s*'?(?:ye|ya|e|a)\s+(?:atanır|aktarılır|geçirilir)",
    r"(\w+)\s+(?:değeri)?\s*(\w+)\s+(?:tarafından|ile)\s+(?:hesaplanır|belirlenir)",
    r"(\w+)\s+(?:is\s+)?(?:derived|obtained|calculated)\s+from\s+(\w+)",
    r"(\w+)\s+(?:uses?|depends?\s+on)\s+(\w+)",
    r"(\w+)\s+(?:is\s+)?passed\s+to\s+(\w+)",
    r"data\s+flows?\s+from\s+(\w+)\s+to\s+(\w+)",
)
EXISTENCE_PATTERNS = (
    r"(\w+)\s+(?:adında|isminde)?\s*(?:bir)?\s*(?:fonksiyon|metod|sınıf|değişken)\s+(?:var|mevcut|tanımlı|bulunuyor)",
    r"(\w+)\s+(?:fonksiyonu|metodu|sınıfı|değişkeni)\s+(?:tanımlanmış|mevcut)",
    r"(?:fonksiyon|metod|sınıf):\s*(\w+)",
    r"(?:function|method|class|variable)\s+(?:named\s+)?(\w+)\s+(?:exists?|is\s+defined)",
    r"there\s+is\s+(?:a\s+)?(?:function|method|class)\s+(?:called\s+)?(\w+)",
    r"(\w+)\s+(?:function|method|class)\s+is\s+(?:defined|declared)",
    r"FONKSIYON:\s*(\w+)",
)
ATTRIBUTE_PATTERNS = (
    r"(\w+)\s+sınıfının\s+(\w+)\s+(?:metodu|özelliği|niteliği)\s+(?:var|mevcut)",
    r"(\w+)\s+sınıfı\s+(\w+)\s+(?:metodunu|özelliğini)\s+(?:içerir|barındırır)",
    r"(\w+)\s+içinde\s+(\w+)\s+(?:metodu|özelliği)\s+(?:tanımlı|mevcut)",
    r"(\w+)\s+(?:class\s+)?has\s+(?:a\s+)?(?:method|attribute|property)\s+(?:called\s+)?(\w+)",
    r"(\w+)\s+contains?\s+(\w+)\s+(?:method|attribute)",
    r"method\s+(\w+)\s+(?:of|in)\s+(?:class\s+)?(\w+)",
)
CALL_BLOCK = r"FONKSIYON:\s*`?(\w+(?:\.\w+)?)`?\s*(?:\([^)]*\))?\s*\n\s*ÇAĞIRIYOR:\s*([^\n]+)"
METHOD_LIST = r"Metodlar[ıi]?:\s*([^\n]+)"
CLASS_NAME = r"(\w+)\s+(?:SINIFI|sınıfı|class)"
#: Unicode word classes and case, and a line feed alone ends a line.
FLAGS = "(?iuUd)"

#: family: claim type, predicate, confidence, patterns
FAMILIES = (
    ("call", "calls", 0.9, CALL_PATTERNS),
    ("data_flow", "data_flows_to", 0.8, DATA_FLOW_PATTERNS),
    ("existence", "exists", 0.85, EXISTENCE_PATTERNS),
    ("attribute", "has_attribute", 0.8, ATTRIBUTE_PATTERNS),
)


def entity_type(text: Column) -> Column:
    """What kind of entity a phrase speaks of: the first kind that is named in either language."""
    low = F.lower(text)
    kinds = (("function", "fonksiyon"), ("class", "sınıf"), ("method", "metod"), ("variable", "değişken"))
    out = None
    for kind, word in kinds:
        hit = F.contains(low, F.lit(word)) | F.contains(low, F.lit(kind))
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("unknown"))


def _claim(rank: Column, text: Column, kind: str, subject: Column, obj: Column | None, predicate: str, confidence: float, entity: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        rank.alias("rank"), text.alias("text"), F.lit(kind).alias("claim_type"), F.lower(subject).alias("subject"), (F.lower(obj) if obj is not None else null).alias("object"),
        F.lit(predicate).alias("predicate"), F.lit(confidence).alias("confidence"), (entity if entity is not None else null).alias("entity_type"), F.lit("text").alias("source"),
    )


def _of_match(kind: str, predicate: str, confidence: float, pattern: int):
    two = kind != "existence"

    def one(m: Column, i: Column) -> Column:
        return _claim(F.array(F.lit(pattern), i, F.lit(0)), m["g0"], kind, m["g1"], m["g2"] if two else None, predicate, confidence, None if two else entity_type(m["g0"]))

    return one


def _groups(pattern: str, n: int) -> Callable[[Column], Column]:
    """A match with its groups: a text is searched once, and the match by itself has the same groups, as no pattern looks beyond its ends."""
    return lambda m: F.struct(m.alias("g0"), *(F.regexp_extract(m, FLAGS + pattern, g).alias(f"g{g}") for g in range(1, n + 1)))


def pattern_claims(text: Column, kind: str, predicate: str, confidence: float, patterns: tuple[str, ...], first: int = 0) -> Column:
    """An array of claims from all matches of the patterns; rank keeps pattern and place."""
    arrays = []
    for k, pattern in enumerate(patterns):
        rx, two = F.lit(FLAGS + pattern), kind != "existence"
        found = F.transform(F.transform(F.regexp_extract_all(text, rx, F.lit(0)), _groups(pattern, 2 if two else 1)), _of_match(kind, predicate, confidence, first + k))
        good = (lambda c: is_identifier(c["subject"]) & is_identifier(c["object"])) if two else (lambda c: is_identifier(c["subject"]))
        arrays.append(F.filter(found, good))
    return F.concat(*arrays)


def block_claims(text: Column, first: int) -> Column:
    """Calls from blocks that name a function and list its callees; YOK means that there are none."""
    rx = F.lit(FLAGS + CALL_BLOCK)
    blocks = F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(1)).alias("f"), F.regexp_extract_all(text, rx, F.lit(2)).alias("l"))

    def block(b: Column, i: Column) -> Column:
        def callee(c: Column, j: Column) -> Column:
            name = F.trim(F.regexp_replace(F.trim(c), "^`+|`+$", ""))
            return _claim(F.array(F.lit(first), i, j), F.concat(b["f"], F.lit(" calls "), name), "call", F.element_at(F.split(b["f"], r"\."), -1), F.element_at(F.split(name, r"\."), -1), "calls", 0.95)

        return F.transform(F.split(b["l"], ","), callee)

    listed = F.filter(blocks, lambda b: F.upper(F.trim(b["l"])) != "YOK")
    return F.filter(F.flatten(F.transform(listed, block)), lambda c: is_identifier(c["object"]))


def method_claims(text: Column, first: int) -> Column:
    """The first class that a text names, with each method of its first list of methods."""
    owner, methods = F.regexp_extract(text, FLAGS + CLASS_NAME, 1), F.regexp_extract(text, FLAGS + METHOD_LIST, 1)
    one = lambda m, i: _claim(F.array(F.lit(first), F.lit(0), i), F.concat(owner, F.lit(" has method "), F.trim(m)), "attribute", owner, F.trim(m), "has_method", 0.9)
    found = F.filter(F.transform(F.split(methods, ","), one), lambda c: is_identifier(c["object"]))
    return F.when((owner != "") & (methods != ""), found).otherwise(F.array().cast(f"array<{_STRUCT}>"))


_STRUCT = "struct<rank:array<int>,text:string,claim_type:string,subject:string,object:string,predicate:string,confidence:double,entity_type:string,source:string>"


def text_claims(text: Column) -> Column:
    """All claims of a text, family by family."""
    arrays, at = [], 0
    for kind, predicate, confidence, patterns in FAMILIES:
        arrays.append(pattern_claims(text, kind, predicate, confidence, patterns, at))
        at += len(patterns)
        if kind in ("call", "attribute"):
            arrays.append((block_claims if kind == "call" else method_claims)(text, at))
            at += 1
    return F.concat(*(a.cast(f"array<{_STRUCT}>") for a in arrays))


def json_body(content: Column) -> Column:
    """What stands in the first fenced block, a json one before others; else all of it."""
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    after = lambda mark: F.get(F.split(F.get(F.split(text, mark), 1), "```"), 0)
    return F.when(F.contains(text, F.lit("```json")), after("```json")).when(F.contains(text, F.lit("```")), after("```")).otherwise(text)


def json_claims(content: Column) -> Column:
    """An array of claims from an object with a list `functions` of objects (name, calls); empty if it is anything else."""
    items = F.try_variant_get(F.try_parse_json(json_body(content)), "$.functions", "array<variant>")
    is_string = lambda v: F.schema_of_variant(v) == "STRING"

    def item(v: Column, i: Column) -> Column:
        raw = F.try_variant_get(v, "$.name", "variant")
        name = F.when(is_string(raw), F.trim(F.try_variant_get(v, "$.name", "string")))
        null = F.lit(None).cast("string")
        row = lambda j, text, kind, obj, predicate, entity: F.struct(
            F.array(i, j).alias("rank"), text.alias("text"), F.lit(kind).alias("claim_type"), F.lower(name).alias("subject"), obj.alias("object"), F.lit(predicate).alias("predicate"), F.lit(1.0).alias("confidence"), entity.alias("entity_type"), F.lit("json").alias("source")
        )
        exists = row(F.lit(-1), F.concat(F.lit("Function "), name, F.lit(" exists")), "existence", null, "exists", F.lit("function"))
        calls = F.coalesce(F.transform(F.try_variant_get(v, "$.calls", "array<variant>"), lambda c: F.trim(F.try_variant_get(c, "$", "string"))), F.array().cast("array<string>"))
        called = F.transform(calls, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        called = F.transform(F.filter(called, lambda x: is_identifier(x["c"])), lambda x: row(x["j"], F.concat(name, F.lit(" calls "), x["c"]), "call", F.lower(x["c"]), "calls", null))
        return F.when(F.coalesce(name != "", F.lit(False)), F.concat(F.array(exists), called)).otherwise(F.array().cast(f"array<{_STRUCT}>"))

    return F.coalesce(F.flatten(F.transform(items, item)), F.array().cast(f"array<{_STRUCT}>")).cast(f"array<{_STRUCT}>")


def deduplicated(claims: DataFrame) -> DataFrame:
    """The first claim of each (type, subject, object, predicate) of a run; nulls are equal."""
    w = Window.partitionBy("file_id", "run_id", "claim_type", "subject", "object", "predicate").orderBy("ord")
    return claims.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def extracted(responses: DataFrame) -> DataFrame:
    """responses: file_id, run_id, content, reasoning_steps. Claims of JSON contents, else of the phrases of content and steps."""
    parsed = responses.withColumn("_json", json_claims(F.coalesce("content", F.lit(""))))
    texts = F.concat(F.array(F.coalesce("content", F.lit(""))), F.coalesce("reasoning_steps", F.array().cast("array<string>")))
    steps = F.flatten(F.transform(texts, lambda t, k: F.transform(text_claims(t), lambda c: F.struct(k.alias("step"), c.alias("c")))))
    both = F.when(F.size("_json") > 0, F.transform("_json", lambda c: F.struct(F.lit(0).alias("step"), c.alias("c")))).otherwise(steps)
    rows = parsed.select("file_id", "run_id", F.posexplode(both).alias("_at", "_x"))
    metadata = F.map_filter(F.create_map(F.lit("entity_type"), F.col("_x.c.entity_type"), F.lit("source"), F.when(F.col("_x.c.source") == "json", F.lit("json"))), lambda _, v: v.isNotNull())
    claims = rows.select(
        "file_id", "run_id", F.col("_at").cast("long").alias("ord"), "_x.c.text", "_x.c.claim_type", "_x.c.subject", "_x.c.object", "_x.c.predicate", "_x.c.confidence",
        F.col("_x.step").cast("int").alias("source_step"), metadata.alias("metadata"),
    )
    return deduplicated(claims)


def of_type(claims: DataFrame, kind: str) -> DataFrame:
    return claims.where(F.col("claim_type") == kind)


def call_pairs(claims: DataFrame) -> DataFrame:
    """caller and callee of the call claims that have both."""
    full = (F.coalesce("subject", F.lit("")) != "") & (F.coalesce("object", F.lit("")) != "")
    return of_type(claims, "call").where(full).select("file_id", "run_id", F.col("subject").alias("caller"), F.col("object").alias("callee"))


def statistics(claims: DataFrame) -> DataFrame:
    """file_id, run_id, claim_type, n: counts by type, 0 where a run has none of it."""
    runs = claims.select("file_id", "run_id").distinct().select("file_id", "run_id", F.explode(F.array(*map(F.lit, CLAIM_TYPES))).alias("claim_type"))
    counts = claims.groupBy("file_id", "run_id", "claim_type").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(counts, ["file_id", "run_id", "claim_type"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


#: Line starts that begin a step of a response.
STEP_STARTS = ("ADIM", "1.", "2.", "3.", "4.", "FONKSIYON:", "GENEL BAKIŞ", "YAPISAL ANALİZ")
MOCK_STEP_STARTS = ("ADIM", "FONKSIYON:")


def segments(rows: DataFrame, keys: list[str], order: list[str], starts: Column, value: str) -> DataFrame:
    """keys, segment (from 1), values: runs of rows from each row that starts one to the next; rows before the first are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("segment > 0")
    grouped = numbered.groupBy(*keys, "segment").agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_s"))
    return grouped.select(*keys, F.col("segment").cast("long").alias("segment"), F.transform("_s", lambda x: x["_v"]).alias("values"))


def reasoning_steps(responses: DataFrame, mock: bool = False) -> DataFrame:
    """file_id, run_id, segment, step: contents cut where a line begins a step; mock contents keep their indentation."""
    lines = responses.select("file_id", "run_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    if not mock:
        lines = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    begins = F.lit(False)
    for s in MOCK_STEP_STARTS if mock else STEP_STARTS:
        begins = begins | F.startswith("line", F.lit(s))
    return segments(lines, ["file_id", "run_id"], ["pos"], begins, "line").select("file_id", "run_id", "segment", F.array_join("values", "\n").alias("step"))
