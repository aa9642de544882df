"""The prefix trie of conversations that are rebuilt from the head of one and the rest of another.

A run of turns is summed up by a product that can be composed: its length and, for
three primes, the sum of ``value * base ** place`` over its turns.  Two runs are joined by
shifting the second by the length of the first, and the rest of a run is the whole
less its head, so the fingerprint of every rebuilt prefix follows from running sums
of the original conversations and at most ``MOST_HEAD`` turns of a head; no rebuilt
conversation is written out.  Prefixes of one depth and fingerprint are a node.  Each
prefix refers to its last turn where that is stored; a node is right if the turns its
members refer to are equal and so are the fingerprints of their parents, depth by
depth.  Should that ever fail, everything is repeated with other bases.

All numbers of a subtree are sums over the members of its top: the nodes whose
smallest member is the same conversation form one unbroken path (a *chain*), so a
subtree holds, for each member, its chain's part below the top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.scan import ordered_scan, range_chunked, running_sum
from paperloom.plans.scratch import cut

#: The longest head that one conversation lends another.
MOST_HEAD = 8
PRIMES = (2147483647, 2147483629, 2147483587)
#: Bases of the three sums, one row for each attempt.
BASES = ((1140671485, 214013021, 1664525013), (69069069, 1103515245, 134775813), (22695477, 1566083941, 48271048))
#: Places are below 2 ** BITS.
BITS = 40
#: Ids in one piece of a list of ends.
PIECE_IDS = 1 << 16
N = len(PRIMES)
KEY = ("depth", "fa", "fb")


def _mod(c: Column, i: int) -> Column:
    return F.pmod(c, F.lit(PRIMES[i]).cast("long"))


def _power(place: Column, base: int, prime: int) -> Column:
    """``base ** place`` by repeated squaring."""
    bits = F.array(*(F.struct(F.lit(1 << i).alias("bit"), F.lit(pow(base, 1 << i, prime)).alias("by")) for i in range(BITS)))
    return F.aggregate(
        bits,
        F.lit(1).cast("long"),
        lambda acc, x: F.when(F.expr("1L").cast("long") == (place.bitwiseAND(x["bit"]) / x["bit"]).cast("long"), (acc * x["by"]) % F.lit(prime)).otherwise(acc),
    )


def _packed(sums: list[Column]) -> tuple[Column, Column]:
    return sums[0] * F.lit(1 << 31) + sums[1], sums[2]


def turn_table(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, n_bytes) of every turn, written: 120 bits of its SHA-256 and the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return cut(slim.select("conv_id", "turn", part(1).alias("t1"), part(16).alias("t2"), "n_bytes"), "turns")


def placed(turns: DataFrame) -> DataFrame:
    """Adds the place of each turn in its conversation, from 1: by turn, null first, of equal turns by digest."""
    # equal rows are told apart by where they stand in the written table, so one row that repeats without end is split too
    ranged = range_chunked(turns.withColumn("_row", F.monotonically_increasing_id()), ["conv_id"], ["turn", "t1", "t2", "_row"], out="_piece")
    order = ["turn", "t1", "t2", "_row"]
    return cut(ordered_scan(ranged, ["conv_id"], order, {"pos": running_sum(F.lit(1).cast("long"))}, F.col("_piece")).drop("turn", "_row"), "places")


def with_sums(places: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """Adds each turn's own part of the three sums (e1..), the sums up to it (s1..) and the bytes up to it."""
    value = lambda i: _mod(F.xxhash64("t1", "t2", F.lit(i)), i)
    own = places.withColumns({f"e{i}": (value(i) * _power(F.col("pos"), bases[i], PRIMES[i])) % PRIMES[i] for i in range(N)})
    steps = {f"s{i}": running_sum(F.col(f"e{i}")) for i in range(N)} | {"upto": running_sum(F.col("n_bytes"))}
    summed = ordered_scan(own, ["conv_id"], ["pos"], steps, F.col("_piece"))
    return cut(summed.withColumns({f"s{i}": _mod(F.col(f"s{i}"), i) for i in range(N)}).drop("_piece"), "sums")


def splices(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column]) -> DataFrame:
    """One row a conversation: whose head it takes (``heads``, with sums), how long that is (k), how much of its own goes (h)."""
    sums = [F.col(c) for c in ("t1", "t2", "n_bytes", "upto", *(f"e{i}" for i in range(N)), *(f"s{i}" for i in range(N)))]
    first = F.when(F.col("pos") <= MOST_HEAD, F.struct("pos", *sums))
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own"), F.sum("n_bytes").alias("own_bytes"), F.array_sort(F.collect_list(first)).alias("own"))
    own = cut(own.withColumns({"base": base(F.col("conv_id")), "h": F.least(head(F.col("conv_id")), F.lit(MOST_HEAD)).cast("long")}), "conversations")
    other = own.select(F.col("conv_id").alias("base"), F.col("own").alias("heads"), F.col("n_own").alias("n_base"))
    out = own.join(other, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    last = lambda a, n, c: F.coalesce(F.get(a, (F.col(n) - 1).cast("int"))[c], F.lit(0).cast("long"))
    out = out.withColumns({f"k_{c}": last("heads", "k", c) for c in ("upto", *(f"s{i}" for i in range(N)))})
    out = out.withColumns({f"h_{c}": last("own", "h", c) for c in ("upto", *(f"s{i}" for i in range(N)))})
    more = F.col("n_own") > F.col("h")
    size = F.col("k") + F.when(more, F.col("n_own") - F.col("h")).otherwise(0)
    total = F.col("k_upto") + F.when(more, F.col("own_bytes") - F.col("h_upto")).otherwise(0)
    return out.withColumns({"length": size, "total": total}).drop("own", "n_own", "own_bytes", "n_base")


def members(turns: DataFrame, convs: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """Every prefix of every rebuilt conversation: its node's key, its parent's, and its last turn where that is stored."""
    zero = F.lit(0).cast("long")
    none = {c: zero for c in ("pa", "pb", "t1", "t2", "n_bytes", "upto")}
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("fa"), zero.alias("fb"), *(v.alias(c) for c, v in none.items()), F.col("conv_id").alias("ref_conv"), zero.alias("ref_pos"), "length")

    def keyed(df: DataFrame, sums: list[Column], own: list[Column], depth: Column, upto: Column, ref: Column, pos: Column, turn: Callable[[str], Column]) -> DataFrame:
        (fa, fb), (pa_, pb) = _packed(sums), _packed([_mod(s - e, i) for i, (s, e) in enumerate(zip(sums, own))])
        kept = [turn(c).alias(c) for c in ("t1", "t2", "n_bytes")]
        return df.select("conv_id", depth.alias("depth"), fa.alias("fa"), fb.alias("fb"), pa_.alias("pa"), pb.alias("pb"), *kept, upto.alias("upto"), ref.alias("ref_conv"), pos.alias("ref_pos"), "length")

    head = convs.where("k > 0").select("conv_id", "base", "length", F.explode(F.slice("heads", 1, F.col("k").cast("int"))).alias("x"))
    x = lambda c: F.col("x")[c]
    taken = keyed(head, [x(f"s{i}") for i in range(N)], [x(f"e{i}") for i in range(N)], x("pos"), x("upto"), F.col("base"), x("pos"), x)

    rest = turns.join(convs.drop("heads", "base", "total"), "conv_id").where("pos > h")
    back = [F.array(*(F.lit(pow(pow(b, -1, p), s, p)) for s in range(MOST_HEAD + 1))) for b, p in zip(bases, PRIMES)]
    shift = lambda c, i: (c * F.get(back[i], (F.col("h") - F.col("k")).cast("int"))) % PRIMES[i]
    sums = [_mod(F.col(f"k_s{i}") + shift(_mod(F.col(f"s{i}") - F.col(f"h_s{i}"), i), i), i) for i in range(N)]
    own = [shift(F.col(f"e{i}"), i) for i in range(N)]
    upto = F.col("k_upto") + F.col("upto") - F.col("h_upto")
    left = keyed(rest, sums, own, F.col("pos") - F.col("h") + F.col("k"), upto, F.col("conv_id"), F.col("pos"), F.col)
    return cut(reduce(DataFrame.unionByName, [root, taken, left]), "members")


def _grouped(prefixes: DataFrame) -> DataFrame:
    """Nodes with their smallest member, and whether their members' last turns and parents are all equal."""
    same = [F.min(c) == F.max(c) for c in ("t1", "t2", "pa", "pb", "n_bytes")]
    ends = F.count(F.when(F.col("depth") == F.col("length"), 1))
    found = prefixes.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.min("n_bytes").alias("n_bytes"), (ends == F.count(F.lit(1))).alias("leaf"), reduce(Column.__and__, same).alias("equal"))
    return cut(found.select("depth", "rep", "n_bytes", "leaf", "equal"), "groups")


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row a node.  ``ends``: (depth, fa, fb, conv_id), the members that end at a node."""

    nodes: DataFrame
    ends: DataFrame

    def digests(self) -> DataFrame:
        """(depth, fa, fb, ends_sha256) of all nodes where a member ends: SHA-256 of the ids in order, comma-joined.

        Ids are dealt out by ranges of (node, id) and joined to pieces of bounded
        length, so that a node with very many ends is read by many tasks; only its
        pieces are then hashed one after another, as a SHA-256 has to be.
        """
        parts = int(self.ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = self.ends.repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
        lists = ranged.mapInArrow(_pieces, "depth long, fa long, fb long, first long, ids string")
        sorted_lists = lists.repartition(*KEY).sortWithinPartitions(*KEY, "first")
        return sorted_lists.mapInArrow(_hashed, "depth long, fa long, fb long, ends_sha256 string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node in a row, at most PIECE_IDS at a time."""
    for batch in batches:
        out: list[tuple] = []
        key, ids = None, []
        for *node, c in zip(*(col.to_pylist() for col in batch.columns)):
            if node != key or len(ids) == PIECE_IDS:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = node, []
            ids.append(c)
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        if out:
            *numbers, texts = zip(*out)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(texts, pa.string())], names=[*KEY, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which follow one another; pieces of a node may span batches."""
    key, state = None, None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        *numbers, texts = zip(*rows)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(texts, pa.string())], names=[*KEY, "ends_sha256"])

    for batch in batches:
        out = []
        for *node, _, ids in zip(*(col.to_pylist() for col in batch.columns)):
            if node == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = node, hashlib.sha256(ids.encode())
        if out:
            yield table(out)
    if key is not None:
        yield table([(*key, state.hexdigest())])


def prefix_trie(conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column]) -> Trie:
    """The trie of conversations (conv_id, turn, role, text), each rebuilt from a head and its own rest.

    Conversation c becomes the first ``head(c)`` turns (at most ``MOST_HEAD``) of
    conversation ``base(c)``, all if that has fewer, none if it does not exist, and its
    own turns after its first ``head(c)``.  Turns are ordered by ``turn``, null first, equal
    ones by their digest; null role or text is empty.  Rows without conv_id belong to no
    conversation and are left out; a table without conversations has no node, not even
    a root.  Repeated rows are turns of their own.  Other columns are ignored.

    ``nodes``: depth, fa and fb (the key), conv_id (smallest member), parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, and ref_conv and ref_pos, the stored turn
    that is the node's last.
    """
    places = placed(turn_table(conversations))
    for bases in BASES:
        turns = with_sums(places, bases)
        convs = cut(splices(turns, base, head), "splices")
        prefixes = members(turns, convs, bases)
        groups = _grouped(prefixes)
        if groups.where(~F.col("equal")).isEmpty():
            break
    else:
        raise ValueError("fingerprints collide with all bases")

    chain = groups.groupBy(F.col("rep").alias("conv_id")).agg(F.min("depth").alias("top"), F.sum("n_bytes").alias("chain_bytes"), F.max("leaf").alias("leaf"))
    each = convs.select("conv_id", "total").join(chain, "conv_id", "left").withColumns({"chain_bytes": F.coalesce("chain_bytes", F.lit(0).cast("long")), "leaf": F.coalesce("leaf", F.lit(False)).cast("long")})
    rows = prefixes.join(each, "conv_id")
    of_rep = lambda c: F.min_by(c, "conv_id")
    starts = F.sum((F.col("top") == F.col("depth") + 1).cast("long"))
    sums = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
        of_rep("ref_conv").alias("ref_conv"),
        of_rep("ref_pos").alias("ref_pos"),
        of_rep("top").alias("top"),
        (F.coalesce(starts, F.lit(0)) + of_rep((F.col("length") > F.col("depth")).cast("long"))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        # every member's bytes from here on, less those of each node counted once
        (F.sum(F.col("total") - F.col("upto") + F.col("n_bytes")) - of_rep(F.col("total") - F.col("upto") + F.col("n_bytes")) - F.sum("chain_bytes") + of_rep("chain_bytes")).alias("saved_tokens"),
    )
    nodes = cut(sums, "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv_id").alias("above"))
    tops = nodes.where("depth > 0 and depth = top").select(*KEY, "pa", "pb").join(above, ["depth", "pa", "pb"]).select(*KEY, "above")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    out = nodes.join(tops, list(KEY), "left").select(*KEY, "conv_id", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ref_conv", "ref_pos")
    return Trie(out, prefixes.where("depth = length").select(*KEY, "conv_id"))
