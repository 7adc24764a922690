"""Sharding by balanced label propagation: linked documents move to their neighbours' shards under byte quotas.

Law ``bytes``: shards get nearly equal sums of sizes. Documents are linked by the keys they share; equal texts
always share one, and a caller may add more (``links``: doc_id, key). A key stands for all pairs of its members, so
links are never listed.

Documents start in the shard that a hash of their number names. A round sums, per key, the members in every shard
(pre-aggregated), joins the sums back to the members, and each linked document asks for the shard where most of its
neighbours are (ties by a hash of the key, so that all members agree). What one shard may send to another follows from
capacity quotas on the sums of an eight by eight table: linked documents never fill more than a shard's share. Within a quota
members of small groups go first, so that a group too large for one shard is the one that is cut; a shard
that had to turn down more than half of its demand takes no more, and the next round asks for another. Unlinked documents are the
counterweight: at the end, shards above their share release documents, unlinked ones first, then those of the largest
groups, to shards below it, each time only documents small against the gap.

Everything is DataFrame code: joins, grouped sums and running sums over blocks, on a table of a few numbers per
document. Only the table of shards by shards comes to the driver. Every step is a written table.

A null text has size 1 and the checksum of the empty text; null texts are no copies of each other or of the empty
text's documents. Rows without ``doc_id`` and rows that repeat one are documents of their own. Fewer documents than shards leave
shards empty. Only ``doc_id`` and ``text`` are read; other columns stay as they are in :func:`sharded`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scale import numbered, running, stored

SHARDS, ROUNDS = 8, 6
# Documents of one block of a running sum; gap, as a share of a shard, at which shards count as even.
BLOCK, EVEN = 50_000, 0.0005


def facts(docs: DataFrame, shards: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per document: number, size, checksum, two hashes of the text, place in hash order, first shard."""
    content = F.coalesce("text", F.lit(""))
    told = docs.select(
        *keep, "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
        F.col("text").isNull().alias("bare"), F.monotonically_increasing_id().alias("row"))
    # The place decides ties and order: by number, so that reruns agree; rows without one by their place in the input.
    place = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(2), "row")).otherwise(F.xxhash64("doc_id", "h1"))
    told = told.withColumn("place", place)
    return stored(told.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "place"), F.lit(shards)).cast("int")), "documents")


def memberships(told: DataFrame, links: DataFrame | None) -> DataFrame:
    """(row, k1, k2, group): keys with two documents or more; ``group`` is the number of members."""
    keys = told.filter("not bare").select("row", F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    if links is not None:
        named = links.filter("doc_id is not null and key is not null").select(
            "doc_id", F.xxhash64(F.lit(4), "key").alias("k1"), F.xxhash64(F.lit(5), "key").alias("k2")).distinct()
        keys = keys.unionByName(told.select("row", "doc_id").join(named, "doc_id").select("row", "k1", "k2"))
    keys = stored(keys, "keys")
    # Written, so that the join's sides are plain shuffles, which may split a common key, or one is small.
    several = stored(keys.groupBy("k1", "k2").agg(F.count("*").alias("group")).filter(F.col("group") > 1), "several")
    return stored(keys.join(several, ["k1", "k2"]), "memberships")


def _votes(members: DataFrame, state: DataFrame, shards: int, closed: set[int]) -> DataFrame:
    """(row, wanted, group, k1): the shard of most neighbours, own ties by the key's hash; closed shards are not asked for."""
    placed = stored(members.join(state.select("row", "shard"), "row"), "placed")
    here = [F.sum((F.col("shard") == s).cast("long")).alias(f"n{s}") for s in range(shards)]
    sums = stored(placed.groupBy("k1", "k2").agg(*here), "sums")
    met = placed.join(sums, ["k1", "k2"])
    # A document with several keys adds up the votes of all of them.
    votes = met.groupBy("row", "shard").agg(
        *[F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)], F.max("group").alias("group"), F.min_by("k1", F.struct("group", "k1")).alias("k1"))
    open_ = [s for s in range(shards) if s not in closed]
    best = F.array_max(F.array(*[
        F.struct((F.when(F.lit(s in open_) | (F.col("shard") == s), F.col(f"n{s}")).otherwise(-1)).alias("n"),
                 F.xxhash64(F.col("k1"), F.lit(s)).alias("tie"), F.lit(s).alias("s")) for s in range(shards)]))
    return votes.select("row", best["s"].alias("wanted"), "group", "k1")


def allowed(demand: dict[tuple[int, int], int], load: list[int], room: float) -> dict[tuple[int, int], float]:
    """Large flows below ``demand`` that leave no shard above ``room`` (or above what it holds now).

    Pairs of shards swap what both ask for; then every shard fills the room it has, which others make by leaving.
    """
    most = [max(room, float(v)) for v in load]
    flow = {(a, b): float(min(v, demand.get((b, a), 0))) for (a, b), v in demand.items()}
    for _ in range(200):
        moved = 0.0
        for j in range(len(load)):
            held = load[j] + sum(v for (_, b), v in flow.items() if b == j) - sum(v for (a, _), v in flow.items() if a == j)
            wished = {k: demand[k] - flow[k] for k in demand if k[1] == j and demand[k] > flow[k]}
            share = min(1.0, max(0.0, most[j] - held) / sum(wished.values())) if wished else 0.0
            for k, v in wished.items():
                flow[k] += v * share
                moved += v * share
        if moved < 0.5:
            break
    return flow


def _blocks(rows: int) -> int:
    return max(1, -(-rows // BLOCK))


def _cell(pairs: dict[tuple[int, int], float], a: str, b: str, shards: int) -> Column:
    """A literal table of shard pairs, looked up by two columns."""
    flat = F.array(*[F.lit(float(pairs.get((i, j), 0.0))) for i in range(shards) for j in range(shards)])
    return F.element_at(flat, (F.col(a) * shards + F.col(b) + 1).cast("int"))


def _slice(order: str, blocks: int) -> Column:
    """Number of the block of a 64-bit hash, never decreasing along it."""
    return F.floor((F.col(order).cast("double") + 2.0**63) * (blocks / 2.0**64)).cast("long")


def propagate(told: DataFrame, members: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``told`` with the shards of linked documents after the rounds, and their largest group (0: unlinked)."""
    of = members.groupBy("row").agg(F.max("group").alias("group"))
    state = stored(told.join(of, "row", "left").fillna(0, ["group"]), "state")
    total = state.agg(F.sum("size")).first()[0] or 0
    blocks, closed = _blocks(told.count()), set()
    for _ in range(rounds):
        asked = _votes(members, state, shards, closed).filter("wanted is not null")
        # Members of one group stay together in the order; a group above a block is dealt by document.
        moves = state.select("row", "shard", "size", "place").join(asked, "row").filter("wanted <> shard").select(
            "row", "shard", "wanted", "size", F.floor(F.log2(F.col("group").cast("double"))).cast("long").alias("class"),
            F.when(F.col("group") < BLOCK // 10, F.col("k1")).otherwise(F.col("place")).alias("at"), "place")
        moves = stored(moves, "moves")
        demand = {(r["shard"], r["wanted"]): r["n"] for r in moves.groupBy("shard", "wanted").agg(F.sum("size").alias("n")).collect()}
        if not demand:
            break
        linked = {r["shard"]: r["n"] for r in state.filter("group > 0").groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        flow = allowed(demand, [linked.get(s, 0) for s in range(shards)], total / shards)
        for j in range(shards):
            wished = sum(v for (_, b), v in demand.items() if b == j)
            if wished and sum(v for (_, b), v in flow.items() if b == j) < wished / 2:
                closed.add(j)
        order = F.col("class") * blocks + _slice("at", blocks)
        summed = running(moves, ["shard", "wanted"], ["class", "at", "place", "row"], order, F.col("size"), "up_to", inclusive=True)
        granted = summed.filter(F.col("up_to") <= _cell(flow, "shard", "wanted", shards)).select("row", "wanted")
        state = stored(state.join(granted, "row", "left").withColumn("shard", F.coalesce("wanted", "shard")).drop("wanted"), "state")
    return state


def level(state: DataFrame, shards: int, passes: int = 8) -> DataFrame:
    """Moves documents from shards above their share to shards below it, until they are even."""
    rows = state.count()
    for _ in range(passes):
        load = {r["shard"]: int(r["n"]) for r in state.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        load = [load.get(s, 0) for s in range(shards)]
        share = sum(load) / shards
        excess, gaps = [max(0.0, v - share) for v in load], [max(0.0, share - v) for v in load]
        if max(excess + gaps) <= max(1.0, EVEN * share):
            break
        # Only documents that are small against the gaps, so that no pass overshoots; the next one looks at what is left.
        limit = min(max(excess), max(gaps)) / 2
        over = F.element_at(F.array(*[F.lit(v) for v in excess]), F.col("shard") + 1)
        free = state.filter((over > 0) & (F.col("size") <= F.least(over, F.lit(limit)))).select(
            "row", "shard", "size", F.when(F.col("group") > 0, 64 - F.floor(F.log2(F.col("group").cast("double")))).otherwise(0).cast("long").alias("class"), "place")
        order = F.col("class") * _blocks(rows) + _slice("place", _blocks(rows))
        released = running(free, ["shard"], ["class", "place", "row"], order, F.col("size"), "up_to", inclusive=True).filter(F.col("up_to") <= over)
        # The excesses stand one after another on a line, and so do the gaps; a document goes to the gap it falls in.
        before = [sum(excess[:s]) for s in range(shards)]
        middle = F.col("up_to") - F.col("size") / 2 + F.element_at(F.array(*[F.lit(float(v)) for v in before]), F.col("shard") + 1)
        target, reached = F.lit(None).cast("int"), 0.0
        for s in range(shards):
            if gaps[s]:
                target = F.coalesce(target, F.when(middle < reached + gaps[s], F.lit(s)))
                reached, last = reached + gaps[s], s
        released = released.select("row", F.coalesce(target, F.lit(last)).alias("to"))
        state = stored(state.join(released, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "state")
    return state


def cut(members: DataFrame, state: DataFrame) -> DataFrame:
    """(links, cut_links): pairs of documents that share a key, and those whose shards differ, from sums only."""
    inside = members.join(state.select("row", "shard"), "row").groupBy("k1", "k2", "shard").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    per_key = inside.groupBy("k1", "k2").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("own"))
    return per_key.agg(F.sum((F.col("all") * F.col("all") - F.col("all")) / 2).cast("decimal(38,0)").alias("links"),
                       F.sum((F.col("all") * F.col("all") - F.col("own")) / 2).cast("decimal(38,0)").alias("cut_links"))


def assign(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None, rounds: int = ROUNDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., doc_id, size, text_crc32, shard, slot): every document's shard, and its place in it from 0."""
    told = facts(docs, shards, keep)
    members = memberships(told, links)
    state = level(propagate(told, members, shards, rounds), shards)
    block = _slice("place", _blocks(state.count()))
    placed = numbered(state, ["shard"], ["place", "row"], block, "slot").withColumn("slot", F.col("slot") - 1)
    return placed.select(*keep, "doc_id", "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` (or, where taken, ``shard_1`` ...), ready for ``partitionBy``."""
    def free(name):
        while name in docs.columns:
            name += "_1"
        return name

    whole = stored(docs.withColumn(held := free("_line"), F.monotonically_increasing_id()), "lines")
    found = assign(whole.select(F.col(held).alias("line"), "doc_id", "text"), shards, links, rounds, ("line",))
    found = found.select(F.col("line").alias(held), F.col("shard").alias(free("shard")), F.col("slot").alias(free("slot")))
    return whole.join(found, held).drop(held)


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The assignment under the law ``bytes``; one more shard would be dealt anew, so ``grown_shard`` is null."""
    return assign(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
