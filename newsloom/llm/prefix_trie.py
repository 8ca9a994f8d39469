"""Conversation prefix trie from composable monoid fingerprints.

Every conversation c is rebuilt from the first h turns of its base conversation and its own turns after its first h. A
sequence of turns y1 .. yd has the fingerprint (d, sum of yi * B^i modulo four primes); (d, s) * (e, t) = (d + e, s + B^d * t)
makes these a monoid whose products can be taken apart again. So a rebuilt prefix is put together from two numbers, the
base's head and the difference of two own prefixes, and no rebuilt text is ever made.

1. One pass stores the turns with a reference, four hashes of role and text, and the text's length. Running sums give the
   prefix products, chunk by chunk of turn numbers, so that a conversation of any length spreads over many tasks; the
   chunks' products are then combined.
2. Entries (conversation, depth, fingerprint, reference of the last turn) with equal depth and fingerprint are one node.
   Equality is verified: the members of a node must have one parent node, and if they refer to several stored turns, these
   must have the same role and text (by induction the whole sequences are equal). If anything is refuted, fingerprints are
   taken anew with the next multiplier.
3. A node's smallest member is its name. Nodes of one name form a path downwards, so sums over subtrees are sums over a
   node's own path and over the paths of its members that start below it: no walk by levels, whatever the depth.

The lists behind ``ends_sha256`` are joined in pieces of at most ``PIECE`` ids (their ids share a quotient). SHA-256 takes
its bytes in order, so a node's pieces pass through one task, as a stream.

Defined cases: rows without a conv_id take no part. Null roles and texts are empty. Turns are ordered by turn, null first;
rows of equal turn by a digest of role and text, and a repeated row is a turn of its own. A conversation none of whose
turns is left, and whose base is absent or empty, is a member of the root only. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.arrow import written

FAMILY = 100                                    # conversations of one base
HEAD = 6                                        # a head has fewer turns than this
CHUNK = 1024                                    # turn numbers of a chunk
PIECE = 10_000
LANES = (2147483647, 2147483629, 2147483587, 2147483579)        # the largest primes below 2^31
MULTIPLIERS = (1_000_003, 48_271, 69_621, 16_807)
LETTERS = "xyzw"


def _times(a: Column, b: Column, prime: int) -> Column:
    return F.pmod(a * b, F.lit(prime))


def _table(values: list[int]) -> Column:
    """A constant array; the optimizer folds the text to one literal."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _power(base: int, exponent: Column, prime: int) -> Column:
    """``base ** exponent`` for exponents below 2^40: four look-ups in tables of 1,024 powers."""
    out = None
    for i in range(4):
        step = pow(base, 1 << (10 * i), prime)
        table = _table([pow(step, e, prime) for e in range(1024)])
        digit = F.get(table, F.shiftright(exponent, 10 * i).bitwiseAND(F.lit(1023)).cast("int"))
        out = digit if out is None else _times(out, digit, prime)
    return out


def _small_power(base: int, exponent: Column, prime: int) -> Column:
    """``base ** exponent`` for exponents from -HEAD to HEAD."""
    return F.get(_table([pow(base, e, prime) for e in range(-HEAD, HEAD + 1)]), exponent + HEAD)


def stored_turns(conversations: DataFrame) -> DataFrame:
    """``ref, conv, turn, role, text, chars, x y z w``: one row per turn, written once, so references stay."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), text.alias("text")).where("conv is not null")
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    rows = rows.select(F.monotonically_increasing_id().alias("ref"), "*", F.length("text").cast("long").alias("chars"),
                       digest.alias("d"))
    # a lane is never 0, so that no turn vanishes from the sum
    lanes = [F.pmod(F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long"), F.lit(p - 1)) + 1 for i, p in enumerate(LANES)]
    return written(rows.select("ref", "conv", "turn", "role", "text", "chars",
                               *[x.cast("int").alias(n) for x, n in zip(lanes, LETTERS, strict=True)]), "trie-turns")


def _head_turns(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEAD)).cast("int")


def rebuilt(turns: DataFrame, multiplier: int) -> tuple[DataFrame, DataFrame]:
    """``(convs, entries)``. Convs: ``conv, length`` of every rebuilt conversation. Entries: a row per rebuilt prefix of one
    turn or more, ``conv, depth, length, x y z w`` (its fingerprint), ``px py pz pw`` (that of the prefix before), ``ref``
    and ``chars`` of its last turn."""
    lanes = list(zip(LETTERS, LANES, strict=True))
    chunk = F.coalesce(F.floor(F.col("turn") / F.lit(CHUNK)).cast("long"), F.lit(-(1 << 62)))
    in_order = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), *LETTERS, "ref")
    local = (turns.select("ref", "conv", "turn", "chars", *LETTERS).withColumn("chunk", chunk)
             .withColumn("at", F.row_number().over(in_order).cast("long")))
    local = local.withColumns({n: _times(F.col(n).cast("long"), _power(multiplier, F.col("at"), p), p) for n, p in lanes})
    up_to = Window.partitionBy("conv", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.select("ref", "conv", "chunk", "at", "chars", *[F.col(n).cast("int").alias(f"t{n}") for n in LETTERS],
                         *[F.pmod(F.sum(n).over(up_to), F.lit(p)).cast("int").alias(f"s{n}") for n, p in lanes])
    local = written(local, "trie-local")

    # chunks: their length, product and first turns; then each chunk's offset and the product of all before it
    turn = F.struct("at", "ref", "chars", *[f"s{n}" for n in LETTERS])
    chunks = local.groupBy("conv", "chunk").agg(
        F.max("at").alias("n"), F.max_by(F.struct(*[f"s{n}" for n in LETTERS]), "at").alias("last"),
        F.collect_list(F.when(F.col("at") < HEAD, turn)).alias("head"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    chunks = chunks.withColumns({f"b{n}": _power(multiplier, F.col("off"), p) for n, p in lanes})
    earlier = lambda n, p: F.sum(_times(F.col(f"b{n}"), F.col(f"last.s{n}").cast("long"), p)).over(before)        # noqa: E731
    chunks = chunks.withColumns({f"c{n}": F.pmod(F.coalesce(earlier(n, p), F.lit(0)), F.lit(p)) for n, p in lanes})
    chunks = written(chunks.drop("last"), "trie-chunks")

    # the first turns of a conversation with their prefix products, at most HEAD - 1 of them
    whole = lambda n, p, s: F.pmod(F.col(f"c{n}") + _times(F.col(f"b{n}"), s, p), F.lit(p))             # noqa: E731
    head = F.filter(F.transform("head", lambda t: F.struct((F.col("off") + t["at"]).alias("i"), t["ref"].alias("ref"), t["chars"].alias("chars"),
                                                           *[whole(n, p, t[f"s{n}"].cast("long")).alias(n) for n, p in lanes])),
                    lambda t: t["i"] < HEAD)
    convs = (chunks.groupBy("conv").agg(F.sum("n").alias("own"), F.flatten(F.collect_list(F.when(F.col("off") < HEAD, head))).alias("head"))
             .withColumn("head", F.sort_array("head")).withColumn("h", _head_turns(F.col("conv")))
             .withColumn("base", F.col("conv") - F.col("conv") % FAMILY))
    bases = convs.where("conv = base").select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    spec = convs.join(bases, "base", "left")
    spec = spec.withColumn("base_head", F.coalesce(F.slice("base_head", 1, F.greatest("h", F.lit(1))), F.array()))
    spec = spec.withColumn("base_head", F.when(F.col("h") > 0, F.col("base_head")).otherwise(F.slice("base_head", 1, 0)))
    spec = spec.withColumn("hb", F.size("base_head")).withColumn("length", F.col("hb") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    # own turns i > h stand at depth hb + i - h: fingerprint = head + (own prefix i - own prefix h) * B^(hb - h)
    value = lambda turns_, i, n: F.coalesce(F.get(turns_, i - 1)[n], F.lit(0)).cast("long")             # noqa: E731
    spec = spec.withColumns({f"k{n}": _small_power(multiplier, F.col("hb") - F.col("h"), p) for n, p in lanes})
    spec = spec.withColumns({f"a{n}": F.pmod(value(F.col("base_head"), F.col("hb"), n)
                                             - _times(value(F.col("head"), F.col("h"), n), F.col(f"k{n}"), p), F.lit(p)) for n, p in lanes})
    spec = written(spec.drop("head", "base", "own"), "trie-convs")

    heads = spec.select("conv", "length", "base_head", F.posexplode("base_head").alias("at", "t"))
    heads = heads.select("conv", (F.col("at") + 1).cast("long").alias("depth"), "length", "t.ref", "t.chars",
                         *[F.col(f"t.{n}").cast("int").alias(n) for n in LETTERS],
                         *[value(F.col("base_head"), F.col("at"), n).cast("int").alias(f"p{n}") for n in LETTERS])
    placed = chunks.join(spec.drop("base_head"), "conv").drop("head", "n")
    own = local.join(placed, ["conv", "chunk"]).where(F.col("off") + F.col("at") > F.col("h"))
    scaled = lambda n, p, s: _times(whole(n, p, s), F.col(f"k{n}"), p)                                  # noqa: E731
    now = {n: F.pmod(F.col(f"a{n}") + scaled(n, p, F.col(f"s{n}").cast("long")), F.lit(p)) for n, p in lanes}
    last = {n: F.pmod(F.col(f"a{n}") + scaled(n, p, F.pmod(F.col(f"s{n}").cast("long") - F.col(f"t{n}"), F.lit(p))), F.lit(p)) for n, p in lanes}
    own = own.select("conv", (F.col("hb") + F.col("off") + F.col("at") - F.col("h")).alias("depth"), "length", "ref", "chars",
                     *[now[n].cast("int").alias(n) for n in LETTERS], *[last[n].cast("int").alias(f"p{n}") for n in LETTERS])
    return spec.select("conv", "length"), written(heads.unionByName(own), "trie-entries")


KEY = ["depth", *LETTERS]


def refuted(turns: DataFrame, entries: DataFrame) -> bool:
    """Whether a node holds two different sequences: two parents, or stored turns that differ in role or text."""
    parent = F.struct(*[f"p{n}" for n in LETTERS])
    by_ref = entries.groupBy(*KEY, "ref").agg(F.min(parent).alias("lo"), F.max(parent).alias("hi"))
    nodes = by_ref.groupBy(*KEY).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("ref").alias("first"), F.max("ref").alias("last"))
    nodes = written(nodes.where("lo != hi or first != last"), "trie-multiple")
    if not nodes.where("lo != hi").isEmpty():
        return True
    refs = entries.select(*KEY, "ref").join(nodes.select(*KEY), KEY, "left_semi").distinct()
    texts = refs.join(turns.select("ref", "role", "text"), "ref")
    differ = texts.groupBy(*KEY).agg(F.min("role").alias("role_lo"), F.max("role").alias("role_hi"),
                                      F.min("text").alias("text_lo"), F.max("text").alias("text_hi"))
    return not differ.where("role_lo != role_hi or text_lo != text_hi").isEmpty()


def _digests(ends: DataFrame) -> DataFrame:
    """``depth, x y z w, ends``: SHA-256 of each node's ascending ids, joined by commas."""
    pieces = (ends.groupBy(*KEY, F.floor(F.col("conv") / PIECE).alias("piece"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:5]), pa.array(cols[5])],
                                              [*KEY, "ends"])

        for batch in batches:
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) > 1000:
                yield rows()
                out.clear()
        if now is not None:
            out.append((*now, state.hexdigest()))
            yield rows()

    in_order = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return in_order.mapInArrow(run, "depth long, x int, y int, z int, w int, ends string")


def trie(conversations: DataFrame, multipliers: tuple[int, ...] = MULTIPLIERS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = stored_turns(conversations)
    for multiplier in multipliers:
        convs, entries = rebuilt(turns, multiplier)
        if not refuted(turns, entries):
            break
    else:
        raise RuntimeError("every multiplier gave different prefixes the same fingerprint")

    zero = [F.lit(0).alias(n) for n in LETTERS]
    parent = F.struct(*[F.col(f"p{n}").alias(n) for n in LETTERS])
    count = lambda: F.count("*").alias("n_convs")                                    # noqa: E731
    nodes = entries.groupBy(*KEY).agg(F.min("conv").alias("conv"), count(), F.max("length").alias("deepest"), F.min("chars").alias("chars"),
                                      F.min(parent).alias("parent"))
    root = (convs.agg(F.min("conv").alias("conv"), count(), F.max("length").alias("deepest")).where("conv is not null")
            .select(F.lit(0).cast("long").alias("depth"), *zero, "conv", "n_convs", "deepest", F.lit(0).cast("long").alias("chars"),
                    F.lit(None).cast("struct<x:int,y:int,z:int,w:int>").alias("parent")))
    weight = ((F.col("n_convs") - 1) * F.col("chars")).alias("weight")
    nodes = written(nodes.unionByName(root).select(*KEY, "conv", "n_convs", weight, (F.col("deepest") == F.col("depth")).alias("leaf"), "parent"),
                    "trie-nodes")

    # paths of one name: from each node the weight down its path, and per path its start, its whole weight, and its leaf
    chunk = F.floor(F.col("depth") / CHUNK).alias("chunk")
    paths = nodes.select("*", chunk)
    below = Window.partitionBy("conv").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = paths.groupBy("conv", "chunk").agg(F.sum("weight").alias("w_"), F.min("depth").alias("top"), F.max("leaf").alias("leaf_"))
    later = per_chunk.withColumn("later", F.coalesce(F.sum("w_").over(below), F.lit(0))).select("conv", "chunk", "later")
    down = Window.partitionBy("conv", "chunk").orderBy(F.col("depth").desc())
    own = (paths.withColumn("down", F.sum("weight").over(down)).join(later, ["conv", "chunk"])
           .select(*KEY, (F.col("down") + F.col("later")).alias("saved"), F.col("leaf").cast("long").alias("_"), "conv"))
    per_path = per_chunk.groupBy("conv").agg(F.min("top").alias("top"), F.sum("w_").alias("all"), F.max("leaf_").cast("long").alias("ends_"))
    # a node's name is a member whose path goes on below it, so its leaf counts too
    own = own.join(per_path.select("conv", "ends_"), "conv").select(*KEY, "saved", F.col("ends_").alias("leaves"))
    spread = entries.select(*KEY, "conv").unionByName(convs.select(F.lit(0).cast("long").alias("depth"), *zero, "conv"))
    joining = (spread.join(per_path, "conv").where("depth < top")
               .select(*KEY, F.col("all").alias("saved"), F.col("ends_").alias("leaves")))
    sums = own.unionByName(joining).groupBy(*KEY).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))

    up = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *[F.col(f"parent.{n}").alias(n) for n in LETTERS])
    children = up.groupBy(*KEY).agg(F.count("*").alias("children"))
    ends = (entries.where("depth = length").select(*KEY, "conv")
            .unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), *zero, "conv")))
    # everything known of a node meets in one aggregation
    none = {"conv": "long", "n_convs": "long", "saved": "long", "leaves": "long", "children": "long", "ends": "string",
            "parent": "struct<x:int,y:int,z:int,w:int>"}

    def part(df: DataFrame) -> DataFrame:
        return df.select(*KEY, *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    table = part(nodes).unionByName(part(sums)).unionByName(part(children)).unionByName(part(_digests(ends)))
    table = written(table.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in none]), "trie-table")

    names = table.select((F.col("depth") + 1).alias("depth"), F.struct(*LETTERS).alias("parent"), F.col("conv").alias("parent_conv_id"))
    named = table.where("depth > 0").join(names, ["depth", "parent"])
    top = table.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return named.unionByName(top).select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def head_turns(conv_id: int) -> int:
    """Number of turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEAD
