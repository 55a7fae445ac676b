"""The trie of shared prefixes of conversations: which turns are common to which conversations, and what sharing saves.

A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with it, and the
least of them owns it.  Who owns a node owns everything below it that it reaches, so each conversation owns a run of
depths from its first owned depth on: its chain.

* A prefix's digest is 128 bits: the exclusive or of strong hashes of (place, digest of the turn), so it is a running
  aggregate and not a value passed from turn to turn.  The minima of digests that several conversations share are
  written as a table.
* The first owned depth is found by binary search: in each round every conversation asks for one of its prefixes, and one
  join with the minima answers all.  Digests are held in rows of up to ``CHUNK`` turns, each searched on its own, so a
  conversation of any length is spread over many rows.
* A chain hangs on the node before its first owned depth.  Sums over chains go up in rounds of doubling: in round i each
  chain gives what it has gathered to its ancestor 2^i chains above, so log2 of the height rounds are made.  Sums along a
  chain are running sums inside its rows, with the sums of its later rows added.

Turns are ordered by turn (null first); ties go by role, then text, and equal rows stay turns of their own.  A null role
or text is empty; rows with a null conv_id belong to no conversation.  Texts are digested whole.  Without conversations
there is no node, not even a root.  Extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.textbatch import checkpointed, pick

#: Turns of a conversation that lie in one row.
CHUNK = 256
#: Ends of a node are put together for 2^ENDS_BITS neighbouring numbers at a time before they are hashed in order.
ENDS_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()


def number(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos from 1, role, text) of all turns, in order.  Turns are sorted by ranges, and a conversation that
    lies in several of them is counted in each apart."""
    t = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    t = t.select(F.col("conv_id").cast("long"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    t = t.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    t = checkpointed(t.select("conv_id", F.monotonically_increasing_id().alias("seq"), "role", "text")).withColumn("block", F.shiftright("seq", 33))
    n = t.groupBy("conv_id", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # inside a block a conversation's turns have consecutive numbers
    n = n.select("conv_id", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return t.join(n, ["conv_id", "block"]).select("conv_id", (F.col("seq") + F.col("shift")).alias("pos"), "role", "text")


def _later(column: str, order: Column) -> Column:
    """The sum over the rows of the same conversation before this one in the order."""
    return F.coalesce(F.sum(column).over(Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _chunks(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, turns): of each turn (depth, x1, x2, chars up to it, own chars); x1, x2 are its prefix's digest."""
    digest = F.substring(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256), 1, 32)
    t = turns.select("conv_id", F.col("pos").cast("long").alias("depth"), digest.alias("d"), F.length("text").cast("long").alias("chars"))
    t = t.select("conv_id", "depth", "chars", *[F.xxhash64(F.lit(i), "depth", "d").alias(f"g{i}") for i in (1, 2)])
    t = t.withColumn("chunk", F.expr(f"(depth - 1) div {CHUNK}"))
    whole = t.groupBy("conv_id", "chunk").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"), F.sum("chars").alias("c"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    longer = whole.where((F.col("chunk") > 0) | (F.col("n") == CHUNK))
    base = longer.select("conv_id", "chunk", F.bit_xor("g1").over(earlier).alias("b1"), F.bit_xor("g2").over(earlier).alias("b2"), F.sum("c").over(earlier).alias("bc")).where("chunk > 0")
    up_to = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(base, ["conv_id", "chunk"], "left")
    run = lambda f, own, b: (f(own).over(up_to), F.coalesce(b, F.lit(0)))
    (x1, b1), (x2, b2), (c, bc) = run(F.bit_xor, "g1", "b1"), run(F.bit_xor, "g2", "b2"), run(F.sum, "chars", "bc")
    t = t.select("conv_id", "chunk", F.struct("depth", x1.bitwiseXOR(b1).alias("x1"), x2.bitwiseXOR(b2).alias("x2"), (c + bc).alias("c"), "chars").alias("t"))
    return t.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _search(chunks: DataFrame, shared: DataFrame) -> DataFrame:
    """chunks with ``low``: how many of their first prefixes someone smaller owns."""
    state, done = chunks.withColumn("low", F.lit(0)).withColumn("high", F.size("turns")), []
    for _ in range((chunks.agg(F.max(F.size("turns"))).first()[0] or 0).bit_length()):
        done.append(state.where("low >= high"))
        asked = state.where("low < high").withColumn("mid", F.expr("(low + high) div 2").cast("int"))
        asked = asked.withColumn("p", F.expr("turns[mid]")).select("*", "p.depth", "p.x1", "p.x2").drop("p")
        owned = F.col("owner").isNull() | (F.col("owner") == F.col("conv_id"))
        answered = asked.join(shared, ["depth", "x1", "x2"], "left")
        state = checkpointed(answered.select("conv_id", "chunk", "turns", F.when(owned, F.col("low")).otherwise(F.col("mid") + 1).alias("low"), F.when(owned, F.col("mid")).otherwise(F.col("high")).alias("high")))
    for more in done:
        state = state.unionByName(more)
    return state.drop("high")


def _gathered(chains: DataFrame) -> DataFrame:
    """(conv_id, n, l, u): of each chain the sums of n, l and u over it and all chains below it."""
    state = chains.select("conv_id", "parent", "n", "l", "u")
    while True:
        moving = state.where("parent is not null")
        if moving.isEmpty():
            return state.drop("parent")
        given = moving.groupBy(F.col("parent").alias("conv_id")).agg(*[F.sum(c).alias(f"_{c}") for c in "nlu"])
        above = state.select(F.col("conv_id").alias("parent"), F.col("parent").alias("_next")).where("_next is not null")
        jump = moving.select("conv_id", "parent").join(above, "parent").select("conv_id", "_next")
        sums = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in "nlu"]
        state = checkpointed(state.join(given, "conv_id", "left").join(jump, "conv_id", "left").select("conv_id", F.col("_next").alias("parent"), *sums))


def _ends(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of (owner, depth, conv_id): the digest of a node's conversations in order, joined by
    commas.  Neighbouring numbers are joined first; then a node's pieces stream through one digest, none being held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def made(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["owner", "depth", "ends_sha256"])

        for batch in batches:
            rows = []
            for owner, depth, piece in zip(batch["owner"].to_pylist(), batch["depth"].to_pylist(), batch["piece"].to_pylist()):
                if (owner, depth) != node:
                    if node:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = (owner, depth), hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if rows:
                yield made(rows)
        if node:
            yield made([(*node, digest.hexdigest())])

    near = ends.groupBy("owner", "depth", F.shiftright("conv_id", ENDS_BITS).alias("block"))
    pieces = near.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("piece"))
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block").mapInArrow(run, "owner long, depth long, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of turns (conv_id, pos, role, text), pos counting from 1, of the conversations in members (conv_id), which
    may have no turns: conv_id (who owns it), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code
    points that need not be stored twice in its subtree), ends_sha256.  A node's last turn is its owner's turn of that pos."""
    members = checkpointed(members.select("conv_id").where("conv_id is not null").distinct())
    n_members, first = members.agg(F.count("*"), F.min("conv_id")).first()
    chunks = checkpointed(_chunks(turns))
    prefixes = chunks.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.depth", "t.x1", "t.x2")
    shared = checkpointed(prefixes.groupBy("depth", "x1", "x2").agg(F.min("conv_id").alias("owner"), F.max("conv_id").alias("last")).where("owner < last").drop("last"))
    found = _search(chunks, shared)

    # the last prefix that someone else owns, and the end
    before = F.when(F.col("low") > 0, F.expr("turns[low - 1]"))
    tails = found.groupBy("conv_id").agg(F.max(F.struct(*[before[c].alias(c) for c in ("depth", "x1", "x2", "c")])).alias("b"), F.max(F.expr("struct(turns[size(turns) - 1].depth as depth, turns[size(turns) - 1].c as c)")).alias("e"))
    tails = tails.select("conv_id", "b.depth", "b.x1", "b.x2", F.coalesce("b.c", F.lit(0)).alias("cf"), F.col("e.depth").alias("k"), F.col("e.c").alias("ck"))
    hung = tails.where("depth is not null").join(shared, ["depth", "x1", "x2"]).unionByName(tails.where("depth is null").withColumn("owner", F.lit(None).cast("long")))
    hung = checkpointed(hung.select("conv_id", "owner", F.coalesce("depth", F.lit(0)).alias("at"), "cf", "k", "ck"))
    chains, guests = hung.where("at < k"), hung.where("at = k")  # guests own nothing

    below = chains.where("owner is not null").groupBy(F.col("owner").alias("conv_id")).agg(F.max("at").alias("deepest"))
    extra = guests.groupBy(F.col("owner").alias("conv_id")).agg(F.count("*").alias("m"), F.sum("ck").alias("cs"))
    leaf = (F.col("deepest").isNull() | (F.col("deepest") < F.col("k"))).cast("long")
    chains = chains.join(below, "conv_id", "left").join(extra, "conv_id", "left")
    # u: characters of all members up to where they end or hang, so that u - cf * n is what the subtree saves
    chains = checkpointed(chains.select("conv_id", F.col("owner").alias("parent"), "at", "cf", "k", "ck", leaf.alias("l"), (1 + F.coalesce("m", F.lit(0))).alias("n"), (F.col("cf") + F.coalesce("cs", F.lit(0))).alias("u")))
    sums = checkpointed(chains.select("conv_id", "parent", "at", "cf").join(_gathered(chains), "conv_id"))

    ended = chains.select(F.col("conv_id").alias("owner"), F.col("k").alias("depth"), "conv_id").unionByName(guests.select("owner", F.col("k").alias("depth"), "conv_id"))
    turnless = members.join(hung, "conv_id", "left_anti").select(F.lit(first).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv_id")
    shas = _ends(ended.unionByName(turnless))

    # what happens along a chain: its own end, guests' ends, chains that hang on it
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    events = chains.select("conv_id", F.col("k").alias("depth"), one.alias("m"), zero.alias("hung"), "l", F.col("ck").alias("a"))
    events = events.unionByName(guests.select(F.col("owner").alias("conv_id"), F.col("k").alias("depth"), one.alias("m"), zero.alias("hung"), zero.alias("l"), F.col("ck").alias("a")))
    events = events.unionByName(sums.where("parent is not null").select(F.col("parent").alias("conv_id"), F.col("at").alias("depth"), F.col("n").alias("m"), one.alias("hung"), "l", F.col("u").alias("a")))
    events = events.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("m", "hung", "l", "a")])
    events = events.join(shas.where("depth > 0").withColumnRenamed("owner", "conv_id"), ["conv_id", "depth"], "left").withColumn("chunk", F.expr(f"(depth - 1) div {CHUNK}"))
    events = events.groupBy("conv_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("depth", F.struct("m", "hung", "l", "a", "ends_sha256")))).alias("events"), *[F.sum(c).alias(f"s{c}") for c in "mla"])
    events = checkpointed(events)

    owned = found.where("low < size(turns)")
    span = F.expr("turns[size(turns) - 1].c - turns[low].c + turns[low].chars")
    long_ = owned.where((F.col("chunk") > 0) | (F.size("turns") == CHUNK)).select("conv_id", "chunk", span.alias("span")).join(events.drop("events"), ["conv_id", "chunk"], "left")
    down = F.col("chunk").desc()
    rest = long_.select("conv_id", "chunk", *[_later(f"s{c}", down).alias(f"r{c}") for c in "mla"], _later("span", down).alias("rspan"), F.lag(F.lit(1)).over(Window.partitionBy("conv_id").orderBy(down)).isNotNull().alias("goes_on"))
    tops = chains.select("conv_id", F.expr(f"at div {CHUNK}").alias("chunk"), "at", "parent")
    key = ["conv_id", "chunk"]
    rows = owned.join(events.select(*key, "events"), key, "left").join(rest, key, "left").join(tops, key, "left")
    rows = rows.select(*key, "events", "rm", "rl", "ra", "rspan", "goes_on", "at", "parent", F.explode(F.expr("slice(turns, low + 1, size(turns))")).alias("t"))
    e = F.element_at("events", F.col("t.depth"))
    rows = rows.select(*key, "rm", "rl", "ra", "rspan", "goes_on", "at", "parent", "t.depth", "t.c", "t.chars", *[F.coalesce(e[x], F.lit(0)).alias(x) for x in ("m", "hung", "l", "a")], e["ends_sha256"].alias("ends_sha256"))
    from_here = Window.partitionBy(*key).orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tail = lambda c, r: F.sum(c).over(from_here) + F.coalesce(r, F.lit(0))
    more = F.lag(F.lit(1)).over(Window.partitionBy(*key).orderBy(F.col("depth").desc())).isNotNull() | F.coalesce("goes_on", F.lit(False))
    top = F.col("depth") == F.col("at") + 1
    nodes = rows.select(
        "conv_id", "depth",
        F.when(top, F.coalesce("parent", F.lit(first))).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        tail("m", "rm").alias("n_convs"),
        (more.cast("long") + F.col("hung")).alias("n_children"),
        tail("l", "rl").alias("n_leaves"),
        (tail("a", "ra") - (F.col("c") - F.col("chars")) * tail("m", "rm") - tail("chars", "rspan")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )

    root = sums.where("parent is null").agg(F.count("*").alias("n_children"), F.sum("l").alias("l"), F.sum("u").alias("u")).withColumn("depth", zero)
    root = root.join(shas.where("depth = 0").select("depth", "ends_sha256"), "depth", "left").where(F.lit(n_members > 0))
    root = root.select(
        F.lit(first).cast("long").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_members).cast("long").alias("n_convs"), "n_children",
        F.greatest(F.coalesce("l", zero), one).alias("n_leaves"), F.coalesce("u", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return nodes.unionByName(root)
