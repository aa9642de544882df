"""Personal data: fixed forms, and identifiers that bootstrapped lexical patterns discover.

Matches of the fixed forms are seeds.  The words around a seed are lexical patterns, from
special to general: the two words before, the word before with the string's
shape, the word before, the word behind.  The same pattern at other identifier-like strings suggests their kind.
Patterns and strings make a bipartite graph that is scored in rounds: a pattern is
as trustworthy as the strings it is found with, a string as the patterns that lead
to it.  Strings that supported patterns make certain are seeds of the next step,
which adds the patterns before them, until no string is added.  Texts are read once;
all steps work on the narrow table of occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.plans.scratch import cut

from .textkit import row_key

#: Fixed: the forms of the four kinds.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit only: from any later one it ends in the same way
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A run of characters of identifiers that holds a digit or an @, and the digits that may follow it in groups.
RUN = re.compile(r"(?<![A-Za-z0-9@._+()/-])[A-Za-z._+()/-]*+[0-9@][A-Za-z0-9@._+()/-]*+")
GROUPS = re.compile(r"(?:[ -](?=[0-9])[0-9().-]*[0-9])*")
#: What stands between the words of a context; an identifier begins behind one of OPENING, white space or (.
OPENING = "\"'=:<[,;"
BETWEEN = frozenset(OPENING + "()>]{} \t\n\r\v\f\xa0\u3000")
ROUNDS = 3
#: A pattern discovers if its score reaches this and it precedes so many different trusted strings; a string is trusted
#: if it has a fixed form or its worth by the patterns with as many reaches the same.
TRUST, SEEDS = 0.8, 5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``EMAIL``, tried only from the start of each run of local characters that ends in an @."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed forms: leftmost, not overlapping within a kind; failed matches are dropped."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def word_before(text: str, at: int) -> tuple[str, int]:
    """The whole word before a place, lower-cased, digits as 0, and where it starts."""
    while at and text[at - 1] in BETWEEN:
        at -= 1
    end = at
    while at and text[at - 1] not in BETWEEN:
        at -= 1
    return re.sub("[0-9]", "0", text[at:end].lower()), at


def word_behind(text: str, at: int) -> str:
    n = len(text)
    while at < n and text[at] in BETWEEN:
        at += 1
    end = at
    while end < n and text[end] not in BETWEEN:
        end += 1
    return re.sub("[0-9]", "0", text[at:end].lower())


def shape(text: str) -> str:
    """Digits as 0, runs of letters as a, the rest as it is."""
    return re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]", "0", text))


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """The patterns around a string; those without a letter say nothing and are left out.

    A side on which the string touches other characters of its word has no context,
    so a word is read for the few strings next to it only.
    """
    one = two = after = ""
    if start == 0 or text[start - 1] in BETWEEN:
        one, at = word_before(text, start)
        two, _ = word_before(text, at)
    if end == len(text) or text[end] in BETWEEN:
        after = word_behind(text, end)
    out = []
    if _LETTER(one) or _LETTER(two):
        out.append(f"2 {two} {one}")
    if _LETTER(one):
        out += [f"s {one} {shape(text[start:end])}", f"1 {one}"]
    if _LETTER(after):
        out.append(f"> {after}")
    return out


_LETTER = re.compile(r"[^\W\d_]").search


def may_be(text: str) -> int:
    """The kinds, as bits, that a string may be an identifier of although it lacks the fixed form."""
    out = int("@" in text and 0 < text.index("@") < len(text) - 1)
    n = sum(map(text.count, "0123456789"))
    if n >= 4 and not any(c.isalpha() for c in text):
        out |= (text.count(".") == 3) << 1 | (12 <= n <= 19) << 2 | (7 <= n <= 15) << 3
    return out


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Identifier-like strings: runs with a digit or an @ behind an opening, and groups of digits that follow."""
    done = 0
    for m in RUN.finditer(text):
        a, run = m.start(), m.group()
        if a < done:
            continue
        start = a if (a == 0 or text[a - 1] in OPENING or text[a - 1].isspace()) and (run[0].isalnum() or run[0] in "+(") else -1
        if start < 0:
            inside = next((i for i, c in enumerate(run[:-1]) if c == "(" and (run[i + 1].isalnum() or run[i + 1] in "+(")), -1)
            if inside < 0:
                continue
            start = a + inside + 1
        end = a + len(run.rstrip("@._+()/-"))
        if end - start < 2 or not re.search("[0-9@]", text[start:end]):
            continue
        done = GROUPS.match(text, end).end()
        yield start, done


def occurrences(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Fixed spans of a text, and every identifier-like string with its patterns; ``kind`` is null but for fixed spans."""
    if not re.search(r"[0-9@]", text):
        return [], []
    base = base_spans(text)
    rows, covered = [], sorted((a, b) for a, _, b in base)
    for a, kind, b in base:
        rows.append({"patterns": patterns_at(text, a, b), "instance": text[a:b], "kind": kind, "may": 1 << kind, "start": a, "end": b})
    starts = [a for a, _ in covered]
    reach = np.maximum.accumulate([b for _, b in covered]) if covered else []
    for a, b in candidates(text):
        i = int(np.searchsorted(starts, b, "left"))
        if i and reach[i - 1] > a:
            continue
        may = may_be(text[a:b])
        if may:
            rows.append({"patterns": patterns_at(text, a, b), "instance": text[a:b], "kind": None, "may": may, "start": a, "end": b})
    return base, [r for r in rows if r["patterns"]]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_ROW = pa.list_(pa.struct([("patterns", pa.list_(pa.string())), ("instance", pa.string()), ("kind", pa.int32()), ("may", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [occurrences(x.as_py() or "") for x in batch.column(2)]
        spans = pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in base] for base, _ in found], _SPAN)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, pa.array([rows for _, rows in found], _ROW)], names=["key", "doc_id", "base", "rows"])


def _bit(kind: Column) -> Column:
    return F.get(F.array(*(F.lit(1 << k) for k in range(len(KINDS)))), kind)


def trusted_patterns(seen: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, seeds: int = SEEDS) -> DataFrame:
    """(pattern, kind) that discover, from occurrences (pattern, instance, kind, may).

    A step has ``rounds`` rounds: a pattern's score for a kind is the sum of the
    scores of its different strings over their number plus one, where a trusted
    string counts as 1.  The score of another is 1 - product(1 - score) over the
    patterns of one sort at it (a pattern's first character), and of all sorts the best:
    patterns of different sorts at one place say the same, so they back off from
    one to the other and don't add up.  Strings that reach ``trust`` by patterns with ``seeds``
    trusted strings are trusted in all further steps, and all patterns at them
    take part; the steps end when no string is added.  Trust only grows, so the
    result does not depend on the order.  The graph is aggregated to different edges
    first, so a hot pattern or string costs no more than its different neighbours.
    """
    edge = cut(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.bit_or("may").alias("may")), "edges")
    own = F.when(F.col("kind").isNotNull(), F.array(F.col("kind"))).otherwise(F.filter(F.array(*map(F.lit, range(len(KINDS)))), lambda k: F.col("may").bitwiseAND(_bit(k)) > 0))
    arc = edge.select("pattern", "instance", F.col("kind").isNotNull().alias("sure"), F.explode(own).alias("k"))
    size = edge.groupBy("pattern").agg(F.count("*").alias("size"))
    chance = 1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999999)))))

    def worth(led: DataFrame) -> DataFrame:
        of_sort = led.groupBy("instance", "k", F.substring("pattern", 1, 1).alias("sort")).agg(chance.alias("worth"))
        return of_sort.groupBy("instance", "k").agg(F.max("worth").alias("worth"))

    fresh = arc.where("sure").select("instance", "k").distinct().withColumn("fresh", F.lit(True))
    while True:
        arc = arc.join(fresh, ["instance", "k"], "left").withColumn("sure", F.col("sure") | F.col("fresh").isNotNull()).drop("fresh")
        arc = cut(arc, "arcs")
        held = arc.where("sure").groupBy("pattern", "k").agg(F.count("*").alias("seeds"))
        known = held.join(size, "pattern").select("pattern", "k", "seeds", "size", (F.col("seeds") / (F.col("size") + 1)).alias("score"))
        known = cut(known, "patterns")
        open_arcs = arc.where("not sure").select("pattern", "instance", "k")
        for _ in range(rounds):
            led = open_arcs.join(known.select("pattern", "k", "score"), ["pattern", "k"])
            sums = led.join(worth(led), ["instance", "k"]).groupBy("pattern", "k").agg(F.sum("worth").alias("worth"))
            again = known.drop("score").join(sums, ["pattern", "k"], "left")
            known = cut(again.select("pattern", "k", "seeds", "size", ((F.col("seeds") + F.coalesce("worth", F.lit(0.0))) / (F.col("size") + 1)).alias("score")), "patterns")
        firm = known.where(F.col("seeds") >= seeds).select("pattern", "k", "score")
        certain = worth(open_arcs.join(firm, ["pattern", "k"])).where(F.col("worth") >= trust)
        fresh = cut(certain.select("instance", "k", F.lit(True).alias("fresh")), "fresh")
        if fresh.isEmpty():
            return known.where((F.col("score") >= trust) & (F.col("seeds") >= seeds)).select("pattern", F.col("k").alias("kind"))


def find_pii(docs: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, seeds: int = SEEDS) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Both are arrays of (start, kind number, end) in code points, end exclusive,
    sorted; ``base`` holds the fixed forms, ``spans`` also what trusted patterns
    discovered; a string that patterns of several kinds discover has all of them.  A null or empty text has none.  Repeated rows (same id and text)
    each get the same result, rows that only share an id their own.
    """
    slim = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    span, row = "array<struct<start:long,kind:int,end:long>>", "array<struct<patterns:array<string>,instance:string,kind:int,may:int,start:long,end:long>>"
    schema = T.StructType().add("key", "long").add("doc_id", kind).add("base", T.DataType.fromDDL(span)).add("rows", T.DataType.fromDDL(row))
    read = cut(slim.mapInArrow(_read, schema), "occurrences")
    seen = read.select("key", F.explode("rows").alias("r")).select("key", "r.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    trusted = trusted_patterns(seen, rounds, trust, seeds).withColumnRenamed("kind", "k")
    found = seen.where("kind is null").join(trusted, "pattern").where(F.col("may").bitwiseAND(_bit(F.col("k"))) > 0)
    more = found.groupBy("key").agg(F.collect_set(F.struct("start", F.col("k").alias("kind"), "end")).alias("more"))
    out = read.select("key", "doc_id", "base").join(more, "key", "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(span)))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
