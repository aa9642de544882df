"""Cross references and defined terms (an extension: specified, not shipped, by the system whose results we match)."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

# Clause number and optional bracketed title.
NUM = r"\d+(?:\.\d+)*(?:[A-Za-z])?(?:\([a-z]\))?"
TITLE = r"(?:\s*\[[^\]]*\])?"

# Single reference patterns; group 1 is the target.
SINGLE = {
    "subclause": rf"[Ss]ub-?\s*[Cc]lauses?\s+({NUM}){TITLE}",
    "clause": rf"[Cc]lauses?\s+({NUM}){TITLE}",
    "korean": r"제(\d+)조(?:\s*제(\d+)항)?",
    "article": rf"[Aa]rticles?\s+({NUM}){TITLE}",
    "section": rf"[Ss]ections?\s+({NUM}){TITLE}",
    "parenthetical": rf"(?i)\(\s*(?:see|refer\s+to|as\s+(?:per|defined\s+in))\s+({NUM})\s*\)",
}
KEYWORD = r"(?:Sub-\s*)?Clauses?|Articles?|Sections?"
SEPARATOR = r"\s*(?:,\s*(?:and\s+)?|\s+and\s+|\s+or\s+)"
LIST = rf"(?i)\b(?:{KEYWORD})\s+{NUM}{TITLE}(?:{SEPARATOR}{NUM}{TITLE})+"
RANGE_SIGN = r"(?i)\]\s+to\s+\d"
RANGE = rf"(?i)(?:{KEYWORD})\s+({NUM})\s*\[[^\]]*\]\s+to\s+({NUM})\s*\[[^\]]*\]"

# Definition forms.
QUOTED = r'"[^"]{1,80}"'
VERB = r"means\b|shall\s+mean\b|has\s+the\s+meaning\b|includes?\b|refers?\s+to\b"
DEFINITION = rf"{QUOTED}(?:\s*,\s*{QUOTED})*(?:\s*,?\s*or\s+{QUOTED})?\s+(?:{VERB})(?:\s*:)?"
KO_DEFINITION = r'"[^"]{1,30}"\s*(?:이)?라\s*(?:함은|한다)|\(이하\s*"[^"]{1,30}"\)'
INLINE = r'\(the\s+"?\*{0,2}"?([^"*\n]{2,60})"?\*{0,2}"?\s*\)'
CONSTRUED = r'the\s+term\s+"?\*{0,2}"?([^"*\n]{2,60})"?\*{0,2}"?\s+shall\s+be\s+construed'


SPANS = "array<struct<start:int,end:int,match:string>>"

#: What tests the text around a match: boundaries, lookarounds, anchors.
AROUND = re.compile(r"\\[bBAGzZ]|\(\?[=!<]|(?<![\[\\])[\^$]")


def spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their offsets: array of (start, end, match)."""
    if AROUND.search(pattern):
        return _marked_spans(text, pattern)
    # such a pattern matches wherever the text of a match stands, so a match begins where its text is next found
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = F.position(x, text, acc["at"] + 1) - 1
        hit = F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("match"))
        return F.struct(hit["end"].alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), begin, step, lambda a: a["out"])


def _marked_spans(text: Column, pattern: str) -> Column:
    # positions come from a copy of the text without the marker, matches from the text itself
    held = text.contains("\u0002")
    clean = F.when(held, F.translate(text, "\u0002", "\u0003")).otherwise(text)
    parts = F.split(F.regexp_replace(clean, pattern, "\u0002$0\u0002"), "\u0002")
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.length(x)
        match = F.when(held, F.substring(text, acc["at"] + 1, F.length(x))).otherwise(x)
        hit = F.array(F.struct(acc["at"].alias("start"), stop.alias("end"), match.alias("match")))
        return F.struct(
            stop.alias("at"),
            (acc["k"] + 1).alias("k"),
            F.when(acc["k"] % 2 == 1, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(parts, begin, step, lambda a: a["out"])


def _ref(kind: Column | str, target: Column, s: Column, listed: bool, shift: Column | int = 0) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("pattern_type"),
        target.alias("target_ref"),
        s["match"].alias("matched_text"),
        (s["start"] + shift).alias("offset_start"),
        (s["end"] + shift).alias("offset_end"),
        F.lit(listed).alias("is_list"),
    )


def _keyword_kind(match: Column) -> Column:
    low = F.lower(match)
    return F.when(low.startswith("sub"), "subclause").when(low.startswith("clause"), "clause").when(low.startswith("article"), "article").otherwise("section")


def extract_refs(clauses: DataFrame) -> DataFrame:
    """Single references, one row each; overlaps between the patterns remain."""
    text = F.col("text")
    empty = F.array().cast("array<struct<pattern_type:string,target_ref:string,matched_text:string,offset_start:int,offset_end:int,is_list:boolean>>")

    def of_kind(kind: str, rx: str) -> Column:
        return F.transform(spans(text, rx), lambda s: _ref(kind, F.regexp_extract(s["match"], rx, 1), s, False))

    found = [F.coalesce(of_kind(kind, rx), empty) for kind, rx in SINGLE.items()]
    return clauses.select("contract_id", "clause_id", F.explode(F.concat(*found)).alias("r")).select("contract_id", "clause_id", "r.*")


def extract_list_refs(clauses: DataFrame) -> DataFrame:
    """References that share one keyword: ``Clauses 1 [A], 18 [B] and 20``."""
    lists = clauses.select("contract_id", "clause_id", F.explode(spans(F.col("text"), LIST)).alias("s"))
    lead = F.regexp_extract(F.col("s.match"), rf"(?i)^(?:{KEYWORD})\s+", 0)
    body = lists.withColumns({"__lead": lead, "__kind": _keyword_kind(lead)}).withColumn(
        "__body", F.substring(F.col("s.match"), F.length("__lead") + 1, F.length("s.match"))
    )
    shift = F.col("s.start") + F.length("__lead")
    items = F.transform(
        spans(F.col("__body"), NUM + TITLE),
        lambda x: _ref(F.col("__kind"), F.regexp_extract(x["match"], f"^({NUM})", 1), x, True, shift),
    )
    return body.select("contract_id", "clause_id", F.explode(items).alias("r")).select("contract_id", "clause_id", "r.*")


def expand_ranges(clauses: DataFrame, clause_index: DataFrame) -> DataFrame:
    """References of ``9.5 [..] to 9.7 [..]`` to the clauses that exist in between."""
    # few texts hold what every range has in it, and that is found faster
    able = clauses.where(F.col("text").rlike(RANGE_SIGN))
    found = able.select("contract_id", "clause_id", F.explode(spans(F.col("text"), RANGE)).alias("s"))
    last = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
    head = lambda c: F.regexp_replace(c, r"\.?[^.]*$", "")
    ranged = found.withColumns(
        {"lo": F.regexp_extract("s.match", RANGE, 1), "hi": F.regexp_extract("s.match", RANGE, 2), "__kind": _keyword_kind(F.col("s.match"))}
    ).withColumns({"__prefix": head(F.col("lo")), "__a": last(F.col("lo")), "__b": last(F.col("hi"))})
    numbers = clause_index.where(F.col("number").rlike(r"^\d+(?:\.\d+)*[A-Za-z]?$")).select("contract_id", "number").distinct()
    keyed = numbers.withColumns({"__prefix": head(F.col("number")), "__n": last(F.col("number"))})
    digits = lambda c: F.regexp_extract(c, r"^(\d+)", 1)
    letter = lambda c: F.regexp_extract(c, r"([A-Za-z])$", 1)
    a, b, n = F.col("__a"), F.col("__b"), F.col("__n")
    as_int = lambda c: digits(c).try_cast("bigint")
    letters = (letter(a) != "") & (letter(b) != "") & (digits(a) == digits(b))
    mixed = (letter(a) != "") | (letter(b) != "")
    inside = (
        F.when(letters, (digits(n) == digits(a)) & (letter(n) != "") & letter(n).between(letter(a), letter(b)))
        .when(mixed, F.col("number").isin(F.col("lo"), F.col("hi")))
        .otherwise((letter(n) == "") & as_int(n).between(as_int(a), as_int(b)))
    )
    hits = ranged.join(keyed, ["contract_id", "__prefix"]).where(inside)
    return hits.select(
        "contract_id",
        "clause_id",
        F.col("__kind").alias("pattern_type"),
        F.col("number").alias("target_ref"),
        F.col("s.match").alias("matched_text"),
        F.col("s.start").alias("offset_start"),
        F.col("s.end").alias("offset_end"),
        F.lit(True).alias("is_list"),
    )


def disjoint(starts: list[int], ends: list[int], taken: list[tuple[int, int]]) -> list[int]:
    """Numbers of the intervals, in their order, that overlap nothing kept before them or ``taken``.

    What is kept lies apart, sorted; an interval only has to fit the gap it begins in.
    """
    lows: list[int] = []
    highs: list[int] = []
    for a, b in sorted(taken):
        if highs and a < highs[-1]:
            highs[-1] = max(highs[-1], b)
        else:
            lows.append(a)
            highs.append(b)
    out = []
    for i, (a, b) in enumerate(zip(starts, ends)):
        at = bisect_right(lows, a)
        if (at and highs[at - 1] > a) or (at < len(lows) and lows[at] < b):
            continue
        lows.insert(at, a)
        highs.insert(at, b)
        out.append(i)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _disjoint(starts: pd.Series, ends: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([disjoint(list(a), list(b), list(zip(c, d))) for a, b, c, d in zip(starts, ends, low, high)])


def _keep_disjoint(items: Column, taken: Column) -> Column:
    """Walk an ordered array and keep what overlaps nothing kept so far or ``taken`` (arrays of one clause)."""
    of = lambda c, name: F.transform(c, lambda x: x[name].cast("int"))
    kept = _disjoint(of(items, "offset_start"), of(items, "offset_end"), of(taken, "s"), of(taken, "e"))
    return F.transform(kept, lambda i: F.get(items, i))


def dedupe_refs(refs: DataFrame) -> DataFrame:
    """Overlapping references of a clause: list and range forms stay, then the earliest and longest."""
    item = F.struct(
        (~F.col("is_list")).alias("single"),
        "offset_start",
        (-F.col("offset_end")).alias("back"),
        "target_ref",
        "pattern_type",
        "matched_text",
        "offset_end",
        "is_list",
    )
    unique = refs.dropDuplicates(["contract_id", "clause_id", "target_ref", "offset_start", "is_list"])
    per_clause = unique.groupBy("contract_id", "clause_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    split = per_clause.withColumns(
        {"lists": F.filter("items", lambda x: x["is_list"]), "singles": F.filter("items", lambda x: ~x["is_list"])}
    )
    taken = F.transform("lists", lambda x: F.struct(x["offset_start"].alias("s"), x["offset_end"].alias("e")))
    kept = F.concat(F.col("lists"), _keep_disjoint(F.col("singles"), taken))
    cols = ["pattern_type", "target_ref", "matched_text", "offset_start", "offset_end", "is_list"]
    return split.select("contract_id", "clause_id", F.explode(kept).alias("r")).select("contract_id", "clause_id", *[f"r.{c}" for c in cols])


def _plain_number(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"\b0+(\d)", "$1"))


def resolve_refs(refs: DataFrame, clauses: DataFrame) -> DataFrame:
    """Target clause: exact number, normalised number, base of a letter suffix, first sub-clause."""
    src = clauses.where(F.col("number").isNotNull()).select("contract_id", "number", "clause_id", "sort_order")
    place = F.struct("sort_order", "clause_id")

    def index(df: DataFrame, key: Column, name: str, latest: bool) -> DataFrame:
        pick = F.max(place) if latest else F.min(place)
        return df.groupBy("contract_id", key.alias("__key")).agg(pick["clause_id"].alias(name))

    n = F.col("number")
    parts = F.split(n, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    deep = src.where(n.rlike(r"^\d+(?:\.\d+)+$")).select("*", F.explode(prefixes).alias("__pre"))
    tries = [
        (F.col("target_ref"), index(src, n, "__exact", True)),
        (_plain_number(F.col("target_ref")), index(src, _plain_number(n), "__plain", True)),
        (F.regexp_replace("target_ref", r"[A-Za-z]+$", ""), index(src, F.regexp_replace(n, r"[A-Za-z]+$", ""), "__base", False)),
        (F.col("target_ref"), index(deep, F.col("__pre"), "__sub", False)),
    ]
    out = refs
    for key, table in tries:
        out = out.withColumn("__key", key).join(table, ["contract_id", "__key"], "left").drop("__key")
    target = F.coalesce("__exact", "__plain", "__base", "__sub")
    done = out.withColumn("target_clause_id", target).drop("__exact", "__plain", "__base", "__sub")
    return done.where(F.col("target_clause_id").isNull() | (F.col("target_clause_id") != F.col("clause_id"))).withColumn(
        "is_resolved", F.col("target_clause_id").isNotNull()
    )


def incoming_refs(refs: DataFrame) -> DataFrame:
    return refs.where("is_resolved").groupBy("contract_id", "target_clause_id").agg(
        F.count(F.lit(1)).alias("incoming"), F.countDistinct("clause_id").alias("sources")
    )


def ref_stats(refs: DataFrame) -> DataFrame:
    return refs.groupBy("contract_id", "pattern_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_resolved")).alias("resolved"),
        F.count_if(~F.col("is_resolved")).alias("unresolved"),
    )


def definition_clauses(clauses: DataFrame) -> DataFrame:
    """Clauses that define terms, by zone, number or text."""
    test = (
        (F.col("zone_key") == "definitions")
        | F.col("number").rlike(r"^1\.1(?:\.\d+)+$")
        | ((F.col("zone_key") == "general_conditions") & F.col("text").rlike(r'"[^"]{1,80}"\s+means\b'))
    )
    return clauses.where(F.coalesce(test, F.lit(False)))


def extract_terms(def_clauses: DataFrame) -> DataFrame:
    """Defined terms; several quoted names before one verb share a group."""
    text = F.col("text")
    shape = "array<struct<start:int,end:int,match:string>>"
    none = F.array().cast(shape)
    verb = lambda m: (
        F.when(m.rlike(r"means\s*:$"), "enumerated").when(m.rlike(r"has\s+the\s+meaning$"), "reference").otherwise("direct")
    )

    def entry(s: Column, terms: Column, kind: Column, inline: bool) -> Column:
        return F.struct(s["start"].alias("offset_start"), terms.alias("terms"), kind.alias("definition_type"), F.lit(inline).alias("is_inline"))

    quoted = lambda m: F.regexp_extract_all(m, F.lit('"([^"]{1,80})"'), F.lit(1))
    groups = [
        F.transform(F.coalesce(spans(text, DEFINITION), none), lambda s: entry(s, quoted(s["match"]), verb(s["match"]), False)),
        F.transform(F.coalesce(spans(text, KO_DEFINITION), none), lambda s: entry(s, quoted(s["match"]), F.lit("direct"), False)),
        F.transform(F.coalesce(spans(text, INLINE), none), lambda s: entry(s, F.array(strip(F.regexp_extract(s["match"], INLINE, 1))), F.lit("direct"), True)),
        F.transform(F.coalesce(spans(text, CONSTRUED), none), lambda s: entry(s, F.array(strip(F.regexp_extract(s["match"], CONSTRUED, 1))), F.lit("direct"), True)),
    ]
    rows = def_clauses.select("contract_id", "clause_id", F.explode(F.concat(*groups)).alias("g"))
    group_id = F.when(F.size("g.terms") > 1, F.sha2(F.concat_ws("|", "contract_id", "clause_id", "g.offset_start"), 256))
    terms = rows.select("contract_id", "clause_id", "g.offset_start", "g.definition_type", "g.is_inline", group_id.alias("group_id"), F.explode("g.terms").alias("term"))
    return terms.dropDuplicates(["contract_id", "clause_id", "term"]).withColumn(
        "term_id", F.sha2(F.concat_ws("|", "contract_id", "clause_id", "term"), 256)
    )


def term_variants(terms: DataFrame) -> DataFrame:
    """Spellings under which a term is used: possessive, plural, hyphen forms."""
    t = F.col("term")
    plural = F.when(~t.endswith("s"), F.concat(t, F.lit("s")))
    ies = F.when(t.endswith("y") & ~t.rlike("(?i)[aeiou]y$"), F.concat(F.regexp_replace(t, "y$", ""), F.lit("ies")))
    hyphen = t.contains("-")
    forms = F.array(
        t,
        F.concat(t, F.lit("'s")),
        F.concat(t, F.lit("’s")),
        plural,
        ies,
        F.when(hyphen, F.replace(t, F.lit("-"), F.lit(""))),
        F.when(hyphen, F.replace(t, F.lit("-"), F.lit(" "))),
    )
    kept = F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))
    return terms.select("contract_id", "term_id", "term", "clause_id", F.explode(kept).alias("variant"))


TOKEN = r"[A-Za-z0-9]+"


def uses_in(text: str, variants: list[dict], busy: list[tuple[int, int]]) -> list[tuple[str, str, str, int, int]]:
    """(term_id, term, matched text, start, end) of the uses in one text: longest term first, apart from ``busy`` and each other.

    A use begins at a word, ends before no letter, digit or underscore and, where a
    sentence or line begins, belongs to a capitalised term.
    """
    found = set()
    for v in variants:
        variant, term = v["variant"], v["term"]
        at, size = text.find(variant), len(variant)
        while at >= 0:
            after = text[at + size : at + size + 1]
            if not (at and _alnum(text[at - 1])) and not (_alnum(after) or after == "_"):
                before = text[max(0, at - 5) : at]
                starts = at == 0 or before.rstrip(" \t\n\v\f\r")[-1:] in tuple(".!?:;") or "\n" in before[-2:]
                if not starts or "A" <= term[:1] <= "Z":
                    found.add((-len(term), term, -size, at, at + size, v["term_id"], variant))
            at = text.find(variant, at + 1)
    ordered = sorted(found)
    kept = disjoint([x[3] for x in ordered], [x[4] for x in ordered], busy)
    return [(ordered[i][5], ordered[i][1], ordered[i][6], ordered[i][3], ordered[i][4]) for i in kept]


def _alnum(c: str) -> bool:
    return "0" <= c <= "9" or "A" <= c <= "Z" or "a" <= c <= "z"


_USE_NAMES = ("term_id", "term", "matched_text", "offset_start", "offset_end")


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, out = [], []
        for i, (text, variants, busy) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("text", "variants", "busy")))):
            uses = uses_in(text, variants, [(x["s"], x["e"]) for x in busy or []])
            rows += [i] * len(uses)
            out += uses
        at = pa.array(rows, pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, [pa.string()] * 3 + [pa.int32()] * 2)]
        yield pa.RecordBatch.from_arrays([batch.column("contract_id").take(at), batch.column("clause_id").take(at), *columns], names=["contract_id", "clause_id", *_USE_NAMES])


def term_usages(clauses: DataFrame, variants: DataFrame, refs: DataFrame) -> DataFrame:
    """Uses of defined terms: longest first, no overlap with references or each other.

    The different words of a clause meet the variants of its contract that start with
    them; no text travels with a word.  A clause then gets its variants and its
    references as arrays, and its own text is searched once for each variant.
    """
    first = F.regexp_extract("variant", f"^({TOKEN})", 1)
    v = variants.where(first != "").select("contract_id", first.alias("__word"), F.struct("term_id", "term", "variant").alias("v"))
    words = clauses.select("contract_id", "clause_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1)))).alias("__word"))
    met = words.join(v, ["contract_id", "__word"]).groupBy("contract_id", "clause_id").agg(F.collect_set("v").alias("variants"))
    busy = refs.groupBy("contract_id", "clause_id").agg(F.collect_set(F.struct(F.col("offset_start").cast("int").alias("s"), F.col("offset_end").cast("int").alias("e"))).alias("busy"))
    joined = clauses.select("contract_id", "clause_id", "text").join(met, ["contract_id", "clause_id"]).join(busy, ["contract_id", "clause_id"], "left")
    schema = T.StructType([clauses.schema["contract_id"], clauses.schema["clause_id"]])
    for name in _USE_NAMES:
        schema = schema.add(name, "integer" if name.startswith("offset") else "string")
    return joined.mapInArrow(_uses, schema)


def usage_counts(terms: DataFrame, usages: DataFrame) -> DataFrame:
    n = usages.groupBy("contract_id", "term_id").agg(F.count(F.lit(1)).alias("usage_count"))
    return terms.join(n, ["contract_id", "term_id"], "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))


def term_aliases(terms: DataFrame) -> DataFrame:
    """Other names of the same definition."""
    group = terms.where(F.col("group_id").isNotNull()).groupBy("contract_id", "group_id").agg(F.array_sort(F.collect_set("term")).alias("__all"))
    joined = terms.join(group, ["contract_id", "group_id"], "left")
    others = F.filter(F.coalesce("__all", F.array().cast("array<string>")), lambda x: x != F.col("term"))
    return joined.withColumn("aliases", others).drop("__all")


#: Buckets of contracts in which references are stored; a rebuild rewrites those of the contracts it is given.
BUCKETS = 256


def rebuild_contract_refs(clauses: DataFrame, path: str, contracts: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Replace the stored references of exactly the given contracts (default: those of ``clauses``).

    Contracts are hashed to buckets.  A rebuild writes the buckets that hold given
    contracts anew, under the next version, and a manifest that names the version of every
    bucket; files of other buckets are neither read nor written.  The newest manifest
    with its end mark counts, so a rebuild that fails leaves what was there.  Contracts left
    without a reference lose their rows, others keep theirs, and repeating it changes nothing.
    """
    spark = clauses.sparkSession
    bucket = F.pmod(F.xxhash64("contract_id"), F.lit(buckets)).cast("int")
    ids = (clauses if contracts is None else contracts).select("contract_id").distinct()
    wanted = clauses.join(ids, "contract_id", "left_semi")
    found = extract_refs(wanted).unionByName(extract_list_refs(wanted)).unionByName(expand_ranges(wanted, wanted))
    new = resolve_refs(dedupe_refs(found), wanted)
    version = stored_version(spark, path)
    manifest = _manifest(spark, path, version)
    touched = {r[0] for r in ids.select(bucket).distinct().collect()}
    before = _read_buckets(spark, path, {b: v for b, v in manifest.items() if b in touched}, new.schema)
    whole = new.unionByName(before.join(ids, "contract_id", "left_anti"))
    number = (version or 0) + 1
    whole.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/data/version={number}")
    written = {int(n[7:]) for n in _names(spark, f"{path}/data/version={number}") if n.startswith("bucket=")}
    manifest = {b: v for b, v in manifest.items() if b not in touched} | {b: number for b in written}
    rows = [(b, v, None) for b, v in sorted(manifest.items())] + [(-1, number, new.schema.json())]
    spark.createDataFrame(rows, "bucket int, version int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []


def _manifest(spark: SparkSession, path: str, version: int | None) -> dict[int, int]:
    """The version of every bucket that has rows."""
    if version is None:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/version={version}").where("bucket >= 0").collect()}


def _read_buckets(spark: SparkSession, path: str, versions: dict[int, int], schema: T.StructType) -> DataFrame:
    paths = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stored_version(spark: SparkSession, path: str) -> int | None:
    """The newest complete version below ``path``, or null."""
    names = [n for n in _names(spark, f"{path}/manifest") if n.startswith("version=")]
    return max((int(n[8:]) for n in names if "_SUCCESS" in _names(spark, f"{path}/manifest/{n}")), default=None)


def stored_refs(spark: SparkSession, path: str) -> DataFrame:
    """The references of the newest complete version."""
    version = stored_version(spark, path)
    schema = spark.read.parquet(f"{path}/manifest/version={version}").where("bucket = -1").first()["schema"]
    return _read_buckets(spark, path, _manifest(spark, path, version), T.StructType.fromJson(json.loads(schema)))
