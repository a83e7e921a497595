"""Near-duplicates by MinHash with tensored banding.

A document's set is its distinct shingles of words; its minhashes are grouped into a
few half keys of `width` minhashes each. A table's key is a pair of half keys, so m
half keys serve m (m - 1) / 2 tables: about the square root of the minhashes that
separate tables would take. Documents that share a key are candidates, and a link
holds only if the full sets say so.

Texts with equal sets are one class. Classes are nodes of the graph; the documents of
a class are never paired. Every key first links its classes to the smallest of them, a
star instead of all pairs, and linked classes form components. Keys whose classes are
all in one component are done; the classes of the other keys form families, in which
every link is looked for by an exact join on set elements (`family_links`) that makes no
pairs of a family's members but those whose sets can still be alike enough. No candidate
is dropped anywhere, and no step depends on how large a key is.

With threshold t, two classes that should be linked share a half key with chance
p = t^width and are missed with chance (1-p)^m + m p (1-p)^(m-1) at the threshold
itself, less above it; m is the least that brings this below `miss`.

Shingles are compared by 64-bit hashes of the 64-bit hashes of their words. Two unlike
shingles of a pair of sets of n elements agree with chance n^2 / 2^63 or so: less than
one in 10^9 for texts of 60,000 words, and one such hit moves a similarity by 1/n only.

Defined cases: a null or empty text has an empty set, is linked with nothing and is
its own component. A text shorter than a shingle is one shingle. A null identifier
never names a component unless all of its documents have none. Of repeated rows each
has the component; `first` marks one row of each component. An empty table gives an
empty result. Only identifier and text take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEED1, _SEED2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs have unlike outputs."""
    x = x ^ x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _tables_of_bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for every byte, 0 for white space, and which bytes stand in words and the powers of the base."""
    value = _mixed(np.arange(1, 257, dtype=np.uint64) * _SEED1)
    value[65:91] = value[97:123]
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    value[~inside] = 0
    return value, inside, np.concatenate([np.ones(1, np.uint64), np.full(_PIECE - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64)


#: Bytes of a text that are hashed at a time, and the odd base of the polynomial.
_PIECE, _BASE = 1 << 18, np.uint64(0xA24BAED4963EE407)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE, _INSIDE, _POWER = _tables_of_bytes()
_INVERSE = np.concatenate([np.ones(1, np.uint64), np.full(_PIECE - 1, _BACK, np.uint64)]).cumprod(dtype=np.uint64)


def _word_codes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial in its bytes, A to Z as lower case.

    A piece of the text at a time; a word that goes on in the next piece adds up.
    """
    codes, open_, shift = [], False, np.ones(1, np.uint64)
    for at in range(0, len(data), _PIECE):
        piece = np.frombuffer(data, np.uint8, min(_PIECE, len(data) - at), at)
        inside = _INSIDE[piece]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if inside[0]:
            starts = np.concatenate([np.zeros(1, np.int64), starts])
        if not len(starts):
            open_ = False
            continue
        code = np.add.reduceat(_VALUE[piece] * _POWER[: len(piece)], starts) * _INVERSE[starts]
        if open_ and inside[0]:
            codes[-1][-1:] += code[:1] * shift
            code = code[1:]
        # How far the last word has come when the next piece starts.
        grown = np.array([pow(int(_BASE), len(piece) - int(starts[-1]), 1 << 64)], np.uint64)
        shift = shift * grown if open_ and inside[0] and len(starts) == 1 else grown
        open_ = bool(inside[-1])
        if len(code):
            codes.append(code)
    return np.concatenate(codes) if codes else np.empty(0, np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles of `k` words.

    Letters A to Z count as lower case; words part at ASCII white space.
    """
    code = _word_codes((text or "").encode())
    if not len(code):
        return code
    code = _mixed(code)
    size = min(k, len(code))
    out = np.full(len(code) - size + 1, size, np.uint64)
    for i in range(size):
        out *= _SEED2
        out ^= out >> np.uint64(29)
        out += code[i : len(code) - size + 1 + i]
    out = np.sort(_mixed(out))
    return out[np.concatenate([np.ones(1, bool), out[1:] != out[:-1]])]


def half_keys(sets: np.ndarray, count: int, width: int, seed: int) -> list[int]:
    """`count` hashes, each of `width` minhashes of a non-empty set."""
    n = count * width
    salt = _mixed(np.arange(1, n + 1, dtype=np.uint64) * _SEED1 + np.uint64(seed))
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 2048):
        part = salt[:, None] ^ sets[None, at : at + 2048]
        part *= _MIX1
        np.minimum(least, part.min(axis=1), out=least)
    least = _mixed(least).reshape(count, width)
    key = np.zeros(count, np.uint64)
    for i in range(width):
        key = _mixed(key * _SEED2 + least[:, i])
    return key.view(np.int64).tolist()


def half_key_count(threshold: float, width: int, miss: float) -> int:
    p, m = threshold**width, 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def _per_text(df: DataFrame, fields: list[T.StructField], made) -> DataFrame:
    """`df` with its text `t` turned into `fields` by `made`, a function of the text."""
    kept = [f for f in df.schema.fields if f.name != "t"]
    df = df.select(*(f.name for f in kept), "t")
    out = T.StructType([*kept, *fields])
    schema = to_arrow_schema(out)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = zip(*(made(t.as_py()) for t in b.columns[-1]), strict=True) if len(b) else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[len(kept) :], strict=True))], schema=schema)

    return df.mapInArrow(turn, out)


def _signed(df: DataFrame, k: int, count: int, width: int) -> DataFrame:
    """`df` with its text `t` turned into n, a digest of the set and half keys."""

    def sign(text: str | None) -> tuple:
        import hashlib

        s = shingles(text, k)
        if not len(s):
            return 0, None, None
        return len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), half_keys(s, count, width, 0)

    return _per_text(df, [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("half", T.ArrayType(T.LongType()))], sign)


def _shared_keys(tables: common.Scratch, classes: DataFrame) -> DataFrame:
    """A row for every class and pair of its half keys that another class has too: node, key, least, many.

    `least` is the smallest class of the key and `many` how many it has. A pair is
    shared only if both of its halves are, so halves of one class go first.
    """
    halves = classes.select("node", F.posexplode("half").alias("i", "h"))
    twice = halves.groupBy("i", "h").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("i", "h")
    held = halves.join(twice, ["i", "h"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("held")).where(F.size("held") > 1)
    held = tables.table(held, "held")
    pairs = F.flatten(F.transform("held", lambda x, at: F.transform(F.slice("held", at + 2, F.size("held")), lambda y: F.xxhash64(x["i"], y["i"], x["h"], y["h"]))))
    keys = held.select("node", F.explode(pairs).alias("key"))
    met = keys.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1")
    return tables.table(keys.join(tables.table(met, "met"), "key"), "shared")


def components(tables: common.Scratch, links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of `links` (a, b).

    Alternates two steps until nothing changes: every node's larger neighbours are
    linked to its smallest neighbour, then every node's smaller ones. Each step is
    one aggregate and one join on written tables, and its number of edges and sum of
    their hashes are taken as they are written.
    """

    def step(edges: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        code = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("code")
        table = tables.table(edges.observe(seen, F.count(F.lit(1)).alias("n"), code), "cc")
        return table, (seen.get["n"], seen.get["code"])

    edges, state = step(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large, _ = step(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, (edges, state) = state, step(small)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b), those whose full sets are alike enough."""
    first, second = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(first, "a").join(second, "b")
    return joined.where(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("a", "b")


#: Sizes of the sets of shared elements that family keys are made of, and how many keys a size may cost a member.
_LEVELS, _MOST_KEYS = (1, 2, 4, 8, 16), 70


def _family_keys(rows: DataFrame, w: int) -> DataFrame:
    """Rows (family, node, root, n, s, outer, band, partners, l) as keys: key, side, native and reach, see `family_links`."""
    kept = [f for f in rows.schema.fields if f.name not in ("family", "band", "partners", "l")]
    fields = [T.StructField("key", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("native", T.BooleanType()), T.StructField("reach", T.LongType())]
    out = T.StructType([*kept, *fields])
    schema = to_arrow_schema(out)

    def of_member(family: int, band: int, s: int, own: np.ndarray, partners: list[dict]) -> Iterator[tuple]:
        from itertools import combinations
        from math import comb

        for p in partners:
            spare = len(own) - p["need"]
            if spare < 0:
                continue
            low, high = sorted((band, p["band"]))
            level = max(x for x in _LEVELS if x == 1 or (x <= p["need"] and comb(spare + x, x) <= _MOST_KEYS))
            for size in _LEVELS[: _LEVELS.index(level) + 1]:
                places = np.arange(spare + 1)[:, None] if size == 1 else np.array(list(combinations(range(spare + size), size)))
                key = np.full(len(places), ((family * 64 + low) * 64 + high) % (1 << 64), np.uint64) * _SEED1 + np.uint64(size)
                for j in range(size):
                    key = _mixed(key * _SEED2 + own[places[:, j]])
                side = 2 if low == high else int(band == high)
                yield key, np.full(len(key), side, np.int32), np.full(len(key), size == level), w * (size + len(own) - 1 - places[:, -1]) + s

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {n: b.column(n).to_pylist() for n in ("family", "band", "s", "partners")}
            lists, at, made = b.column("l"), [], []
            for i in range(len(b)):
                found = list(of_member(columns["family"][i], columns["band"][i], columns["s"][i], lists[i].values.to_numpy().view(np.uint64), columns["partners"][i]))
                at.append(np.full(sum(len(x[0]) for x in found), i))
                made += found
            if not made:
                continue
            same = b.take(pa.array(np.concatenate(at)))
            key, side, native, reach = (np.concatenate(x) for x in zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([*(same.column(f.name) for f in kept), pa.array(key.view(np.int64)), pa.array(side), pa.array(native), pa.array(reach)], schema=schema)

    return rows.mapInArrow(spread, out)


def family_links(tables: common.Scratch, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the members (node, root, family) of each family as all their links would.

    Families are split by what their members differ in. With B the elements that more
    than half of a family have, a set x is told by z(x), its symmetric difference with
    B: two sets differ where their z do. Let s(x) = (100 - percent) |x| - (100 +
    percent) |z(x)| and w = 2 (100 + percent); then x and y are linked just if

        s(x) + s(y) + w |z(x) & z(y)| >= 0.

    The member with the largest s is the family's top. Members with s(x) + s(top) >= 0
    are linked to it for sure, and two members with s(x) + s(y) >= 0 both are. Any other
    link has an outer member, one that is not so linked, and takes shared elements of z.
    How many depends on s of both, so members are put in bands by the logarithm of their
    distance from the top's s, and each looks for partners band by band: a partner in a band
    whose largest s is m shares at least need = -(s(x) + m) / w elements with x.

    Elements that only one z holds aside, z(x) is a list, the rarest first. Members that
    share `need` of them share the first l shared ones within the first |list| - need + l
    places of both lists, so keys are the sets of l elements of that prefix, for l of 1, 2,
    4, ...: as long as they are few (`_MOST_KEYS`), where lists hardly exceed what is
    needed. A member makes the keys of its own l, natively, and of all smaller ones, as a
    guest; a pair meets at the smaller l of the two, so guests never meet guests. After the
    last element of a key, `reach` tells how much two members can still share: pairs
    are made only where that and the sizes leave a link possible, and what no partner in a
    key's list can meet leaves the list before. Full sets of differences decide.
    """
    w = 2 * (100 + percent)
    many = members.groupBy("family").agg(F.count(F.lit(1)).alias("many"))
    members = tables.table(members.join(common.broadcast_if_small(many, many.count()), "family"), "members")
    own = members.join(sets.select("node", "items"), "node")
    counted = own.select("family", "many", F.explode("items").alias("e")).groupBy("family", "many", "e").agg(F.count(F.lit(1)).alias("c"))
    base = F.col("c") * 2 > F.col("many")
    counted = tables.table(counted.select("family", "many", "e", base.alias("base"), F.when(base, F.col("many") - F.col("c")).otherwise(F.col("c")).alias("zc")).where("base or zc > 1"), "elements")

    # A family's B goes to as many pieces as it has thousands of members.
    pieces = F.floor(F.col("many") / 1000).cast("int") + 1
    bases = counted.where("base").groupBy("family", "many").agg(F.collect_list("e").alias("b"))
    bases = bases.select("family", "b", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    own = own.withColumn("piece", F.pmod(F.xxhash64("node"), pieces.cast("bigint")).cast("int")).join(bases, ["family", "piece"], "left")
    b = F.coalesce("b", F.array().cast("array<bigint>"))
    z = F.concat(F.array_except("items", b), F.array_except(b, "items"))
    n = F.size("items")
    told = own.select("family", "node", "root", n.alias("n"), z.alias("z"), ((100 - percent) * n - (100 + percent) * F.size(z)).cast("bigint").alias("s"))
    told = tables.table(told, "told")
    tops = told.groupBy("family").agg(F.max(F.struct("s", "node")).alias("top")).select("family", F.col("top.s").alias("top_s"), F.col("top.node").alias("top"))
    tops = tables.table(tops, "tops")
    topped = told.join(common.broadcast_if_small(tops, tops.count()), "family").withColumn("outer", F.col("s") + F.col("top_s") < 0)
    sure = topped.where("not outer and node <> top").select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b"))
    topped = topped.withColumn("band", F.floor(F.log2(1 + (F.col("top_s") - F.col("s")) / w)).cast("int"))
    bands = topped.groupBy("family", "band").agg(F.max("s").alias("most"), F.max(F.when(F.col("outer"), F.col("s"))).alias("outer_most"))
    # A few bands a family; families without outer members have no more links.
    bands = bands.groupBy("family").agg(F.collect_list(F.struct("band", "most", "outer_most")).alias("bands"), F.max("outer_most").alias("any")).where("any is not null").drop("any")
    bands = tables.table(bands, "bands")
    able = F.filter("bands", lambda b: F.col("outer") | b["outer_most"].isNotNull())
    need = lambda b: F.greatest(F.lit(1), F.ceil(-(F.col("s") + F.when(F.col("outer"), b["most"]).otherwise(b["outer_most"])) / w)).cast("int")
    partners = F.transform(able, lambda b: F.struct(b["band"].alias("band"), need(b).alias("need")))

    shared = told.select("family", "node", F.explode("z").alias("e")).join(counted.where("zc > 1").select("family", "e", "zc"), ["family", "e"])
    lists = shared.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("zc", "e"))), lambda x: x["e"]).alias("l"))
    listed = topped.join(bands, "family").select("family", "node", "root", "n", "s", "outer", "band", partners.alias("partners")).join(lists, "node")
    rows = tables.table(_family_keys(listed.where(F.exists("partners", lambda p: p["need"] <= F.size("l"))), w), "lists")
    best = lambda c, test: F.max(F.when(F.expr(test), F.col(c))) if test else F.max(c)
    for _ in range(2):
        # A guest meets natives, an inner member outer ones.
        kinds = {"gi": "native and outer", "go": "native", "ni": "outer", "no": ""}
        most = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.count_if("native").alias("natives"), F.count_if("outer").alias("outers"), F.min("side").alias("side_0"), F.max("side").alias("side_1"), *(best(c, test).alias(f"{c}_{kind}") for kind, test in kinds.items() for c in ("s", "reach")))
        able = lambda kind: (F.col("reach") + F.col(f"s_{kind}") >= 0) & (F.col("s") + F.col(f"reach_{kind}") >= 0)
        fits = F.when(F.col("native"), F.when(F.col("outer"), able("no")).otherwise(able("ni"))).otherwise(F.when(F.col("outer"), able("go")).otherwise(able("gi")))
        met = rows.join(most.where("k > 1 and natives > 0 and outers > 0 and (side_0 < side_1 or side_0 = 2)"), "key").where(F.coalesce(fits, F.lit(False)))
        rows = tables.table(met.select(*rows.columns), "lists")
    one, two = rows.where("native").alias("x"), rows.alias("y")
    able = (F.col("x.reach") + F.col("y.s") >= 0) & (F.col("y.reach") + F.col("x.s") >= 0) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("x.side") != F.col("y.side")) | (F.col("x.side") == 2)) & (F.col("x.outer") | F.col("y.outer")) & (~F.col("y.native") | (F.col("x.node") < F.col("y.node")))
    pairs = one.join(two, (F.col("x.key") == F.col("y.key")) & apart & able).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    pairs = tables.table(pairs.distinct(), "pairs")
    first, second = (told.select(F.col("node").alias(node), F.col("z").alias(z), F.col("s").alias(s)) for node, z, s in (("a", "za", "sa"), ("b", "zb", "sb")))
    found = pairs.join(first, "a").join(second, "b").where(F.col("sa") + F.col("sb") + w * F.size(F.array_intersect("za", "zb")) >= 0)
    return tables.table(sure.unionByName(found.select("a", "b")), "family-links")


def grouped(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, width: int = 3, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document: id, at_file, at_row, n, component, first."""
    tables = common.Scratch(spark, "near")
    rows = common.located(spark, docs, {"id": id_col, "t": text_col}, "near-docs").withColumn("id", F.col("id").cast("bigint"))
    signed = tables.table(_signed(rows, k, half_key_count(percent / 100, width, miss), width), "signed")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "at_file", "at_row")
    classes = signed.where("n > 0").groupBy("digest").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("half").alias("half"))
    classes = tables.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    shared = _shared_keys(tables, classes)
    star = tables.table(shared.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "star")
    sets = _sets(tables, rows, classes, shared.select("node").distinct(), k)
    links = tables.table(_links(star, sets, percent), "links")
    root = components(tables, links)

    # Keys of three classes or more that are not all in one component yet.
    placed = shared.where("many > 2").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    open_ = tables.table(placed.join(split, "key", "left_semi").select("least", "node", "root").distinct(), "open")
    if open_.limit(1).count():
        family = components(tables, open_.select(F.col("least").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "family")
        members = open_.select("node", "root").distinct().join(family, "node")
        more = family_links(tables, members, sets, percent)
        root = components(tables, links.unionByName(more))

    linked = classes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = linked.groupBy("root").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("many"))
    heads = heads.where("many > 1").drop("many")
    # Classes whose documents do not all stand for themselves.
    of_class = linked.join(heads, "root", "left").where("copies > 1 or head is not null").select("digest", F.coalesce("head", "rep").alias("head"))
    of_class = tables.table(of_class.select("digest", "head.id", "head.at_file", "head.at_row").toDF("digest", "head", "head_file", "head_row"), "heads")
    out = signed.drop("half").join(common.broadcast_if_small(of_class, of_class.count()), "digest", "left")
    here = (F.col("head_file") == F.col("at_file")) & (F.col("head_row") == F.col("at_row"))
    result = out.select("id", "at_file", "at_row", "n", F.when(F.col("head_file").isNull(), F.col("id")).otherwise(F.col("head")).alias("component"), F.coalesce(here, F.lit(True)).alias("first"))
    tables.drop_all_but("signed", "heads")
    return result


def _sets(tables: common.Scratch, rows: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and the full set, read from one document of each of the given classes."""
    wanted = tables.table(classes.join(nodes, "node", "left_semi").select("node", "rep.at_file", "rep.at_row"), "wanted")
    texts = rows.select("at_file", "at_row", "t").join(common.broadcast_if_small(wanted, wanted.count()), ["at_file", "at_row"]).select("node", "t")
    return tables.table(_per_text(texts, [T.StructField("items", T.ArrayType(T.LongType()))], lambda text: (shingles(text, k).view(np.int64),)), "sets")


def deduplicated(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each group; columns as they are."""
    if not common._reads_files(docs):
        docs = common.written(spark, docs, "near-docs")
    dropped = common.written(spark, grouped(spark, docs, **options).where("not first").select("at_file", "at_row"), "near-dropped")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = common.located(spark, docs, dict(zip(names, docs.columns, strict=True)), "near-docs")
    rest = rows.join(common.broadcast_if_small(dropped, dropped.count()), ["at_file", "at_row"], "left_anti")
    return rest.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies: 3-word shingles, similarity 0.85."""
    common.arrow_rows(spark)
    found = grouped(spark, common.documents(spark, sf_dir), k=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
