"""Graph families: lifetime customer-entity graph, two-hop, subgraph.

Uses of a value by a customer are first folded into *spells*: runs of orders less than w apart.
At any instant a customer has used a value in the last w exactly when the instant lies inside
one spell, so a spell join yields one row per (order, peer, type) where an order-to-order join
would yield one per earlier order.  Spells are cut at multiples of w and joined on the cut, so
the range condition only refines an equi join.
"""
from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.operators.asof import (
    Measure, SkewPlan, before, count_at, find_skew, nearest_in_time, sweep, timed, unpivot_entities,
)
from coterie.operators.behaviour import customer_level, pivot_levels, shared_level, with_levels
from coterie.schema import DAY, ENTITIES, ENTITY_BIT, GRAPH_COLUMNS, HOUR, SUBGRAPH_COLUMNS, TWO_HOP_COLUMNS
from coterie.sources.scratch import materialise

W24, W7, W30 = DAY, 7 * DAY, 30 * DAY
PAIR_BITS = [ENTITY_BIT[a] | ENTITY_BIT[b] for i, a in enumerate(ENTITIES) for b in ENTITIES[i + 1:]]


TAGS = ((W24, "24h"), (W7, "7d"))
# two-hop columns: values of a type reached through peers on one type, or on any
REACHED = {
    "two_hop_connected_addresses_via_device_7d": ("address", "device"),
    "two_hop_connected_devices_via_address_7d": ("device", "address"),
    "two_hop_connected_payments_via_device_7d": ("payment", "device"),
    "two_hop_connected_payments_via_address_7d": ("payment", "address"),
    "two_hop_connected_devices_via_ip_7d": ("device", "ip"),
    "two_hop_connected_addresses_via_ip_7d": ("address", "ip"),
    "two_hop_total_peer_devices_7d": ("device", None),
    "two_hop_total_peer_addresses_7d": ("address", None),
    "two_hop_total_peer_payments_7d": ("payment", None),
}


def _count(c: Column) -> Column:
    return c.cast("double")


def _used(rows: DataFrame, skew: SkewPlan) -> DataFrame:
    """Entity rows with the neighbouring uses of the same value by the same customer."""
    hot = None
    if skew.values is not None and skew.customers is not None:
        rows = skew.mark(skew.mark_values(rows)).withColumn("hot_use", F.col("hot_value") & F.col("hot_customer"))
        hot = "hot_use"
    keep = ["etype", "value", "customer_id", "t", "order_id", "prev_t", "next_t"]
    return nearest_in_time(rows, ["etype", "value", "customer_id"], hot, skew.slice_us).select(*keep)


def spells(orders: DataFrame, windows: list[int], skew: SkewPlan | None = None) -> DataFrame:
    """(w, etype, value, customer_id, runs): ``runs`` lists (from_t, from_id, until), used within the last w iff from < i and t_i < until.

    Runs lie at least w apart, so a list is bounded by the time that the orders span."""
    used = _used(unpivot_entities(timed(orders)), skew or SkewPlan())
    per_w = used.select("*", F.explode(F.array(*[F.lit(w).cast("long") for w in windows])).alias("w"))
    opens = F.col("prev_t").isNull() | (F.col("prev_t") <= F.col("t") - F.col("w"))
    closes = F.col("next_t").isNull() | (F.col("next_t") >= F.col("t") + F.col("w"))
    ends = per_w.select("*", opens.alias("opens"), closes.alias("closes")).filter("opens or closes")
    order = Window.partitionBy("w", "etype", "value", "customer_id").orderBy("t", "order_id")
    last = F.when(F.col("closes"), F.col("t")).otherwise(F.lead("t").over(order))
    # a use without a time is in no window
    runs = ends.withColumn("until", last + F.col("w")).filter("opens and t is not null")
    return runs.groupBy("w", "etype", "value", "customer_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("t").alias("from_t"), F.col("order_id").alias("from_id"), "until"))).alias("runs"))


def longer(runs: Column, fine: int, w: int) -> Column:
    """The runs of the window w, from the sorted ones of a shorter window: neighbours less than w apart are one."""
    more = F.lit(w - fine).cast("long")
    starts = F.filter(runs, lambda r, i: (i == 0) | (r["from_t"] >= F.get(runs, i - 1)["until"] + more))
    ends = F.filter(runs, lambda r, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1)["from_t"] >= r["until"] + more))
    return F.zip_with(starts, ends, lambda a, b: F.struct(
        a["from_t"].alias("from_t"), a["from_id"].alias("from_id"), (b["until"] + more).alias("until")))


def first_edges(orders: DataFrame) -> DataFrame:
    """(etype, value, customer_id, from_t, from_id): the first use; map-side combined."""
    return (unpivot_entities(timed(orders)).groupBy("etype", "value", "customer_id")
            .agg(F.min(F.struct("t", "order_id")).alias("f"))
            .select("etype", "value", "customer_id", F.col("f.t").alias("from_t"), F.col("f.order_id").alias("from_id")))


def name_births(orders: DataFrame) -> DataFrame:
    """(node, born_t, born_id, clash): the order in which a raw string first takes part, as customer or as value.

    Nodes of the subgraph are raw strings without their type; ``clash`` tells the strings that occur
    under more than one kind, which are the only ones where that matters.
    """
    o = timed(orders)
    who = o.select(F.col("customer_id").cast("string").alias("node"), "t", "order_id", F.lit(16).alias("kind"))
    what = unpivot_entities(o, keep=["t", "order_id"]).select(F.col("value").alias("node"), "t", "order_id", type_bit().alias("kind"))
    return (who.unionByName(what).groupBy("node").agg(F.min(F.struct("t", "order_id")).alias("b"), F.bit_or("kind").alias("kinds"))
            .select("node", F.col("b.t").alias("born_t"), F.col("b.order_id").alias("born_id"), (F.bit_count("kinds") > 1).alias("clash")))


def type_bit() -> Column:
    bit = F.lit(0)
    for e in ENTITIES:
        bit = F.when(F.col("etype") == e, ENTITY_BIT[e]).otherwise(bit)
    return bit


def with_births(spell: DataFrame, births: DataFrame) -> DataFrame:
    """Spells with ``far`` for type and value, and when the edge, the value and the customer first appeared (as raw
    strings), and clash flags."""
    rows = spell.join(births.select(F.col("node").alias("value"), "node_id", F.col("born_t").alias("value_born"),
                                    F.col("clash").alias("value_clash")), "value")
    # the first spell of every window length opens at the first use
    edge = Window.partitionBy("w", "node_id", "customer_id")
    rows = rows.withColumn("edge_born", F.min(F.array_min("runs.from_t")).over(edge))
    rows = rows.withColumn("far", far_id()).drop("etype", "value", "node_id")
    return rows.join(births.select(F.col("node").alias("_who"), F.col("born_t").alias("who_born"),
                                   F.col("clash").alias("who_clash")),
                     rows["customer_id"].cast("string") == F.col("_who")).drop("_who")


def far_id() -> Column:
    """One number for a type and the number of a string: the type in the last two bits."""
    return F.col("node_id") * 4 + sum(F.when(F.col("etype") == e, i).otherwise(0) for i, e in enumerate(ENTITIES))


def of_type(e: str) -> Column:
    return F.col("far").bitwiseAND(3) == ENTITIES.index(e)


def far_bit() -> Column:
    """The bit in ``ENTITY_BIT`` of the type of ``far``."""
    bit = F.lit(0)
    for e in ENTITIES:
        bit = F.when(of_type(e), ENTITY_BIT[e]).otherwise(bit)
    return bit


def cut(spell: DataFrame) -> DataFrame:
    """One row per run and multiple of w it touches, keyed by ``bucket``."""
    runs = spell.select(*[c for c in spell.columns if c != "runs"], F.inline("runs"))
    lo = F.floor(F.col("from_t") / F.col("w"))
    hi = F.floor((F.col("until") - 1) / F.col("w"))
    return runs.withColumn("bucket", F.explode(F.sequence(lo, hi)))


def bucket(t: str, w: Column) -> Column:
    return F.floor(F.col(t) / w)


def active(ties: str, t: str = "t", oid: str = "order_id") -> Column:
    return before("from_t", "from_id", t, oid, ties) & (F.col(t) < F.col("until"))


SEATS = 64


@dataclass(frozen=True)
class Seats:
    """Where the rows about a customer's orders are brought together: by the customer, hot ones in 64 parts of their orders (``home`` is a hash of both).

    What the customer can reach is sent there once, not once per order, and everything about one order is then joined
    and counted without another shuffle."""

    skew: SkewPlan

    def orders(self, rows: DataFrame) -> DataFrame:
        """``rows`` (me, order_id, ...) with their ``home``."""
        deal, apart = F.pmod(F.xxhash64("order_id"), F.lit(SEATS)).cast("int"), F.col("me").isNull()
        if self.skew.customers is not None:
            rows, apart = rows.join(self._hot(), "me", "left"), apart | F.col("hot_customer")
        return rows.withColumn("home", self._home(F.when(apart, deal).otherwise(F.lit(0)))).drop("hot_customer")

    def reach(self, rows: DataFrame) -> DataFrame:
        """``rows`` (me, ...) once for every home of the customer, dealt by it."""
        if self.skew.customers is None:
            return self.deal(rows.withColumn("home", self._home(F.lit(0))))
        every = F.when(F.col("hot_customer"), F.sequence(F.lit(0), F.lit(SEATS - 1))).otherwise(F.array(F.lit(0)))
        rows = rows.join(self._hot(), "me", "left").withColumn("_seat", F.explode(every))
        return self.deal(rows.withColumn("home", self._home(F.col("_seat"))).drop("_seat", "hot_customer"))

    def deal(self, rows: DataFrame) -> DataFrame:
        return replace(self.skew, parts=self.skew.parts and 5 * self.skew.parts).deal(rows, "home")

    def _hot(self) -> DataFrame:
        return F.broadcast(self.skew.customers.withColumnRenamed("customer_id", "me"))

    def _home(self, seat: Column) -> Column:
        return F.xxhash64("me", seat)


def seated(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` where joins of rows dealt by ``home`` on it and more columns take them as they lie."""
    conf, key = df.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    had = conf.get(key, None)
    conf.set(key, "false")
    try:
        return materialise(df, name)
    finally:
        conf.set(key, had) if had is not None else conf.unset(key)


def peers(own: DataFrame, spell: DataFrame, ties: str, seats: Seats, hot: DataFrame | None) -> DataFrame:
    """(order_id, t, home, me, peer, mask, in_30d): other customers on one of the order's values.

    ``mask`` has one bit per type shared in the last 7 d; ``in_30d`` tells a link in 30 d.
    """
    uses = spell.filter(F.col("w").isin(W7, W30)).select("w", "far", F.col("customer_id").alias("peer"), "runs")
    shared = spread_join(own.select("me", "far").distinct(), uses, ["far"], hot, {}, by="me").filter(F.col("peer") != F.col("me"))
    mine = seats.deal(own.select("order_id", "t", "home", "me", "far")).withColumn(
        "w", F.explode(F.array(F.lit(W7).cast("long"), F.lit(W30).cast("long")))).withColumn("bucket", bucket("t", F.col("w")))
    met = mine.join(cut(seats.reach(shared)), ["home", "me", "w", "far", "bucket"]).filter(active(ties))
    return met.groupBy("home", "me", "order_id", "t", "peer").agg(
        F.coalesce(F.bit_or(F.when(F.col("w") == W7, far_bit())), F.lit(0)).cast("int").alias("mask"),
        F.max(F.col("w") == W30).alias("in_30d"))


KEYS = ["home", "me", "w", "order_id", "t", "far"]


def reached(me: DataFrame, links: DataFrame, pieces: DataFrame, windows: list[int], ties: str, seats: Seats) -> DataFrame:
    """(home, me, w, order_id, t, far, via, first, value_born, value_clash): values in the rows of the 7-day peers and the customer.

    ``via`` = types through which the peers that used it are linked, ``first`` = one of those that used it, the customer
    included. ``pieces`` holds the spells of the peers (others don't matter), cut, once per home.
    """
    wide = F.array(*[F.lit(w).cast("long") for w in windows])
    near = links.filter("mask > 0").select("order_id", "t", "home", "me", F.col("peer").alias("who"), "mask")
    self = me.select("order_id", "t", "home", "me", F.col("me").alias("who"), F.lit(0).alias("mask"))
    look = seats.deal(near.unionByName(self)).withColumn("w", F.explode(wide)).withColumn("bucket", bucket("t", F.col("w")))
    hit = look.join(pieces, ["home", "me", "w", "who", "bucket"]).filter(active(ties))
    return hit.groupBy(*KEYS).agg(
        F.bit_or("mask").alias("via"), F.min("who").alias("first"), F.max("value_born").alias("value_born"),
        F.max("value_clash").alias("value_clash"))


def touched(hits: DataFrame, own: DataFrame, windows: list[int], ties: str, seats: Seats) -> DataFrame:
    """``reached`` values and those on the order itself, told by ``own``."""
    wide = F.array(*[F.lit(w).cast("long") for w in windows])
    # a value reached through an earlier order was born before; a value that is only on the order itself
    # can be young only as a string that another kind used
    elsewhere = F.when(F.col("clash") & before("born_t", "born_id", "t", "order_id", ties), F.col("born_t"))
    here = seats.deal(own).withColumn("w", F.explode(wide)).groupBy(*KEYS).agg(
        F.max(elsewhere).alias("elsewhere"), F.max("clash").alias("clash"))
    # joined, not appended: rows stay where they lie
    return hits.join(here.withColumn("_own", F.lit(True)), KEYS, "full").select(
        *KEYS, F.coalesce("via", F.lit(0)).cast("int").alias("via"), F.coalesce("_own", F.lit(False)).alias("own"),
        F.greatest("value_born", "elsewhere").alias("value_born"), F.greatest("value_clash", "clash").alias("value_clash"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None,
                names: dict[str, str], salts: int = 64, by: str = "order_id") -> DataFrame:
    """Equi join where the rows of hot keys on the left are dealt to ``salts`` groups by their ``by``.

    The right rows of those keys are repeated once per group; other keys stay in one.  ``names`` maps
    the columns of the hot table to those of the join.
    """
    if hot is None:
        return left.join(right, keys)
    cols = [names.get(c, c) for c in hot.columns if not c.startswith("hot_")]
    marked = F.broadcast(hot.select(*[F.col(c).alias(names.get(c, c)) for c in hot.columns if not c.startswith("hot_")],
                                    F.lit(True).alias("_hot")))
    deal = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(marked, cols, "left").withColumn("_salt", deal).drop("_hot")
    b = right.join(marked, cols, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return a.join(b, [*keys, "_salt"]).drop("_salt")


@dataclass
class Neighbourhood:
    """Shared intermediate tables of the two-hop and subgraph families.

    ``own``: the orders' values; ``spell``: spells of every value and customer; ``links``: the orders' peers. Values
    touched by peers and the people on them are never tables: they are joined and counted where ``Seats`` brings together what a customer reaches."""

    orders: DataFrame
    focus: DataFrame
    births: DataFrame
    own: DataFrame
    spell: DataFrame
    links: DataFrame
    windows: tuple[int, ...]
    ties: str
    skew: SkewPlan
    hot_far: DataFrame | None
    clashes: bool

    @classmethod
    def build(cls, orders: DataFrame, ties: str = "sequence", skew: SkewPlan | None = None,
              windows: tuple[int, ...] = (W7, W24), targets: DataFrame | None = None) -> "Neighbourhood":
        """``targets``: the order ids to describe, all by default; history is always all orders."""
        skew = skew or find_skew(orders)
        seats = Seats(skew)
        focus = focus_rows(orders, targets)
        births = materialise(name_births(orders).withColumn("node_id", F.monotonically_increasing_id()), "births")
        spell = materialise(with_births(spells(orders, sorted({*windows, W7, W30}), skew), births), "spells")
        named = births.withColumnRenamed("node", "value")
        own = unpivot_entities(timed(focus)).join(named, "value").withColumn("far", far_id())
        own = materialise(seats.orders(own.select("order_id", "t", F.col("customer_id").alias("me"), "far", "clash", "born_t", "born_id")), "own")
        hot = None if skew.values is None else materialise(skew.values.join(named, "value").select(far_id().alias("far")), "hot-far")
        links = seated(peers(own, spell, ties, seats, hot), "links")
        return cls(orders, focus, births, own, spell, links, tuple(windows), ties, skew, hot, not births.filter("clash").isEmpty())

    @cached_property
    def seats(self) -> Seats:
        return Seats(self.skew)

    @cached_property
    def me(self) -> DataFrame:
        return self.seats.orders(timed(self.focus).select("order_id", "t", F.col("customer_id").alias("me")))

    @cached_property
    def pairs(self) -> DataFrame:
        """(me, who): the customer itself and everybody it is linked with."""
        return self.links.filter("mask > 0").select("me", F.col("peer").alias("who")).unionByName(
            timed(self.focus).select(F.col("customer_id").alias("me"), F.col("customer_id").alias("who"))).distinct()

    def _known(self, uses: DataFrame) -> DataFrame:
        """Spells (who, ...) of the customer and everybody it is linked with, once per customer."""
        return spread_join(self.pairs, uses, ["who"], self.skew.customers, {"customer_id": "who"}, by="me")

    @cached_property
    def near(self) -> DataFrame:
        """(me, far): values that the customer or somebody it is linked with ever used."""
        uses = self.spell.filter(F.col("w") == W7).select(F.col("customer_id").alias("who"), "far")
        return materialise(self._known(uses).select("me", "far").distinct(), "near")

    @cached_property
    def pieces(self) -> DataFrame:
        """Spells that an order can meet, cut, at the homes of its customer: with one window those of the customer and its peers,
        else those of everybody on a value that these used, sent as runs of the shortest window."""
        if not self.people:
            uses = self.spell.filter(F.col("w").isin(*self.windows)).withColumnRenamed("customer_id", "who")
            return cut(self.seats.reach(self._known(uses).select("me", "who", "w", "far", "runs", "value_born", "value_clash")))
        fine = min(self.windows)
        # packed, so that both joins which read it need the same columns: it is sent once
        about = ["runs", "edge_born", "who_born", "who_clash", "value_born", "value_clash"]
        on = self.spell.filter(F.col("w") == fine).select("far", F.col("customer_id").alias("who"), F.struct(*about).alias("use"))
        sent = spread_join(self.near, on, ["far"], self.hot_far, {}, by="me").filter("me is not null and far is not null and who is not null")
        each = F.array(*[F.struct(
            F.lit(w).cast("long").alias("w"), (F.col("use.runs") if w == fine else longer(F.col("use.runs"), fine, w)).alias("runs"),
            F.col("use")) for w in self.windows])
        rows = self.seats.reach(sent).select("home", "me", "far", "who", F.inline(each))
        return cut(rows.select("home", "me", "far", "who", "w", "runs", *[f"use.{c}" for c in about if c != "runs"]))

    @property
    def people(self) -> bool:
        """The subgraph columns are asked for: customers on touched values are met too."""
        return len(self.windows) > 1

    @cached_property
    def hits(self) -> DataFrame:
        return reached(self.me, self.links, self.pieces, list(self.windows), self.ties, self.seats)

    @cached_property
    def own_values(self) -> DataFrame:
        """(home, me, order_id, t, far, clash): the orders' own values, each once, at the homes."""
        return self.seats.deal(self.own.select("home", "me", "order_id", "t", "far", "clash")).distinct()

    @cached_property
    def touch(self) -> DataFrame:
        return touched(self.hits, self.own, list(self.windows), self.ties, self.seats)

    @cached_property
    def values(self) -> DataFrame:
        """One row per order: the touched values counted."""
        if self.people:
            return self.counts
        return seated(self.touch.groupBy("order_id").agg(
            *[F.count_if(via(target, through) & ~F.col("own")).alias(c) for c, (target, through) in REACHED.items()]), "touched")

    @cached_property
    def met(self) -> DataFrame:
        """(home, me, w, order_id, t, who, edges, new_edges, who_born, who_clash, values counted): see ``neighbourhood_people``."""
        people = neighbourhood_people(self)
        return seated(people, "people") if self.clashes else people

    @cached_property
    def counts(self) -> DataFrame:
        """One row per order: touched values and the people on them, counted in one pass."""
        hour = bucket("t", F.lit(HOUR))
        lately = F.col("t") - F.lit(HOUR)
        others = F.col("who") != F.col("me")
        acts = self.seats.reach(recent_acts(self)).withColumn("w", F.lit(W7).cast("long"))
        placed = F.filter("acts", lambda a: (a["act_t"] > lately) & _earlier(a, self.ties))
        counted = self.seats.deal(self.met) if self.clashes else self.met
        counted = counted.withColumn("hour", hour).join(acts, ["home", "me", "w", "who", "hour"], "left")
        out = counted.groupBy("order_id").agg(
            *[F.coalesce(F.sum(F.when(F.col("w") == w, F.col("edges"))), F.lit(0)).alias(f"edge_{tag}") for w, tag in TAGS],
            *[F.count_if((F.col("w") == w) & others).alias(f"others_{tag}") for w, tag in TAGS],
            F.coalesce(F.sum(F.when(F.col("w") == W7, F.col("new_edges"))), F.lit(0)).alias("new_edges"),
            F.count_if((F.col("w") == W7) & others & ~F.col("who_clash") & (F.col("who_born") > lately)).alias("new_people"),
            F.sum(F.when(F.col("acts").isNotNull(), F.size(placed))).alias("burst_others"),
            *[F.sum(c).alias(c) for c in REACHED], F.sum("new_values").alias("new_values"),
            *[F.sum(F.when(F.col("w") == w, F.col("elsewhere"))).alias(f"elsewhere_{tag}") for w, tag in TAGS])
        # the order's own values are touched too; of reached ones only those that are not its own were counted
        own = self.own_values.groupBy("order_id").agg(F.count_if(~F.col("clash")).alias("own_values"))
        out = own.join(out, "order_id", "full")
        plain = [(F.coalesce(f"elsewhere_{tag}", F.lit(0)) + F.coalesce("own_values", F.lit(0))).alias(f"plain_{tag}") for _, tag in TAGS]
        return seated(out.select(*[c for c in out.columns if c != "own_values" and not c.startswith("elsewhere_")], *plain), "counts")


def via(target: str, through: str | None) -> Column:
    """A row of a touched value belongs to a two-hop column."""
    m = sum(ENTITY_BIT.values()) if through is None else ENTITY_BIT[through]
    return (F.col("w") == W7) & of_type(target) & (F.col("via").bitwiseAND(F.lit(m)) > 0)


def focus_rows(orders: DataFrame, targets: DataFrame | None) -> DataFrame:
    return orders if targets is None else orders.join(targets.select("order_id"), "order_id", "left_semi")


def link_summary(links: DataFrame) -> DataFrame:
    """One row per order: peers in 7 d and 30 d, pairs of types with a common peer, overlap degrees."""
    degree = F.bit_count("mask")
    return links.groupBy("order_id").agg(
        F.count_if(F.col("mask") > 0).alias("peers_7d"), F.count_if("in_30d").alias("peers_30d"),
        F.count_if(degree >= 2).alias("overlapping"), F.max(degree).alias("max_overlap"),
        F.bit_or("mask").alias("types"),
        *[F.max((F.col("mask").bitwiseAND(F.lit(p)) == p).cast("int")).alias(f"pair_{p}") for p in PAIR_BITS])


def two_hop_features(orders: DataFrame, ties: str = "sequence", skew: SkewPlan | None = None,
                     hood: Neighbourhood | None = None, shared: bool = True) -> DataFrame:
    """20 columns over the peers of the last 7 days and what they used; 16 without ``shared``, the customers on the order's own values."""
    hood = hood or Neighbourhood.build(orders, ties, skew, windows=(W7,))
    skew = hood.skew
    hot = "hot_customer" if skew.customers is not None else None
    near = hood.links.filter("mask > 0").select("order_id", "t", F.col("peer").alias("customer_id"))
    events = timed(orders).select("customer_id", "t", "order_id")
    if hot is not None:
        near, events = skew.mark(near), skew.mark(events)
    volume = count_at(events, near, "customer_id", {"n7": W7, "n24": W24}, ties, hot, skew.slice_us)
    volume = volume.groupBy("order_id").agg(F.sum("n7").alias("peer_orders"), F.max("n7").alias("peer_max"),
                                            F.sum("n24").alias("peer_orders_24h"))

    reached_values = hood.values.select("order_id", *REACHED)
    out = hood.focus.select("order_id")
    if shared:
        out = with_levels(out, pivot_levels(shared_level(orders, ties, skew).select("order_id", "etype", "peers_7d")))
    out = (out.join(link_summary(hood.links), "order_id", "left")
           .join(reached_values, "order_id", "left").join(volume, "order_id", "left"))

    def n(c: str) -> Column:
        return F.coalesce(_count(F.col(c)), F.lit(0.0))

    named = shared_columns() if shared else {}
    named |= {c: n(c) for c in REACHED}
    named |= {
        "two_hop_distinct_connected_customers_7d": n("peers_7d"),
        "two_hop_distinct_connected_customers_30d": n("peers_30d"),
        "two_hop_peer_cluster_size_7d": n("peers_7d") + n("two_hop_total_peer_devices_7d")
        + n("two_hop_total_peer_addresses_7d") + n("two_hop_total_peer_payments_7d"),
        "two_hop_total_peer_orders_7d": n("peer_orders"), "two_hop_max_peer_orders_7d": n("peer_max"),
        "two_hop_peer_velocity_ratio_24h_vs_7d":
            n("peer_orders_24h") / F.greatest(F.lit(1.0), n("peer_orders") / F.lit(7.0)),
        "two_hop_cross_entity_shared_cust_count_7d": sum(n(f"pair_{p}") for p in PAIR_BITS),
    }
    return out.select("order_id", *[named[c].alias(c) for c in TWO_HOP_COLUMNS if c in named])


def shared_columns() -> dict[str, Column]:
    """The two-hop columns that count customers on the order's own values."""
    return {f"two_hop_shared_{e}_customers_7d": F.col(f"{e}__peers_7d") for e in ENTITIES}


def neighbourhood_people(hood: Neighbourhood) -> DataFrame:
    """(home, me, w, order_id, t, who, edges, new_edges, who_born, who_clash, values): customers on a touched value.

    Only a string that is a value under several types could be the same edge twice; it stays in the grouping
    key until it has been counted once. Touched values are counted along, each at the one customer that ``first`` names.
    """
    own = hood.own_values.withColumn("_own", F.lit(True)).drop("clash")
    hits = hood.hits.join(own, [k for k in KEYS if k != "w"], "left").withColumn("bucket", bucket("t", F.col("w")))
    spell = hood.pieces.drop("value_born", "value_clash")
    # values only the customer used: the edge is the customer's own
    met = hits.join(spell, ["home", "me", "w", "far", "bucket"]).filter(
        active(hood.ties) & ((F.col("via") > 0) | (F.col("who") == F.col("me"))))
    keys = ["home", "me", "w", "order_id", "t", "who"]
    lately = F.col("t") - F.lit(HOUR)
    young = F.col("edge_born") > lately
    once = F.col("who") == F.col("first")
    foreign, plain = F.col("_own").isNull(), ~F.col("value_clash")
    values = {c: once & foreign & via(target, through) for c, (target, through) in REACHED.items()}
    values |= {"elsewhere": once & foreign & plain, "new_values": once & plain & (F.col("w") == W7) & (F.col("value_born") > lately)}
    about = [F.max("who_born").alias("who_born"), F.max("who_clash").alias("who_clash")]
    sums = [F.count_if(x).alias(c) for c, x in values.items()]
    if not hood.clashes:
        return met.groupBy(*keys).agg(F.count("*").alias("edges"), F.count_if(young).alias("new_edges"), *about, *sums)
    same = F.when(F.col("value_clash"), F.shiftright("far", 2))
    cells = met.withColumn("_same", same).groupBy(*keys, "_same").agg(F.count("*").alias("n"), F.count_if(young).alias("fresh"), *about, *sums)
    single = F.col("_same").isNotNull()
    return cells.groupBy(*keys).agg(
        F.sum(F.when(single, 1).otherwise(F.col("n"))).alias("edges"),
        F.sum(F.when(single, F.least(F.col("fresh"), F.lit(1))).otherwise(F.col("fresh"))).alias("new_edges"), *about,
        *[F.sum(c).alias(c) for c in values])


def _earlier(act: Column, ties: str) -> Column:
    """The (act_t, act_id) in a list precedes the order of the row."""
    if ties == "strict":
        return act["act_t"] < F.col("t")
    return (act["act_t"] < F.col("t")) | ((act["act_t"] == F.col("t")) & (act["act_id"] < F.col("order_id")))


def recent_acts(hood: Neighbourhood) -> DataFrame:
    """(me, who, hour, acts): orders that customers within two hops placed in an hour or the one before, for the hours in which
    the customer orders."""
    users = hood.spell.filter(F.col("w") == W7).select("far", F.col("customer_id").alias("who"))
    near = spread_join(hood.near, users, ["far"], hood.hot_far, {}, by="me")
    hour = bucket("t", F.lit(HOUR))
    hours = timed(hood.focus).groupBy(F.col("customer_id").alias("me")).agg(F.collect_set(hour).alias("hours"))
    pairs = near.filter("who <> me").select("me", "who").distinct().join(hours, "me")
    acts = timed(hood.orders).select(F.col("customer_id").alias("who"), F.struct(F.col("t").alias("act_t"), F.col("order_id").alias("act_id")).alias("act"), hour.alias("h"))
    acts = acts.withColumn("hour", F.explode(F.array(F.col("h"), F.col("h") + 1))).groupBy("who", "hour").agg(F.collect_list("act").alias("acts"))
    return spread_join(pairs, acts, ["who"], hood.skew.customers, {"customer_id": "who"}, by="me").filter(
        F.array_contains("hours", F.col("hour"))).select("me", "who", "hour", "acts")


def subgraph_features(orders: DataFrame, ties: str = "sequence", skew: SkewPlan | None = None,
                      hood: Neighbourhood | None = None) -> DataFrame:
    """20 columns over the customers and values within two hops."""
    hood = hood or Neighbourhood.build(orders, ties, skew)
    lately = F.col("t") - F.lit(HOUR)
    hour = bucket("t", F.lit(HOUR))
    # the customer is always a node: counted here, so its own row among the people is left out below
    me = timed(hood.focus).select("order_id", "t", F.col("customer_id").cast("string").alias("who"))
    me_born = me.join(hood.births.withColumnRenamed("node", "who"), "who").select(
        "order_id", F.col("who").alias("me_name"),
        ((F.col("born_t") > lately) & before("born_t", "born_id", "t", "order_id", hood.ties)).alias("me_new"),
        F.col("clash").alias("me_clash"))
    others = F.col("who") != F.col("me")
    # an order id that comes again counts its people again
    times = hood.focus.groupBy("order_id").agg(F.count("*").alias("_times"))
    again = [c for c in hood.counts.columns if c.startswith(("edge_", "others_")) or c in ("new_edges", "new_people")]
    counts = hood.counts.drop(*REACHED).join(times, "order_id")
    parts = [counts.select(*[(F.col(c) * F.col("_times")).alias(c) if c in again else F.col(c) for c in counts.columns if c != "_times"])]
    if hood.clashes:
        # strings used under several kinds are few: they are made distinct by name
        clash_values = seated(hood.touch.filter("value_clash").select("w", "order_id", "t", F.shiftright("far", 2).alias("node_id"), "value_born"), "clash-values")
        parts.append(clash_values.groupBy("order_id", "w", "node_id").agg(F.lit(1).alias("_")).groupBy("order_id").agg(
            *[F.count_if(F.col("w") == w).alias(f"clash_{tag}") for w, tag in TAGS]))
        young = hood.met.filter((F.col("w") == W7) & others & F.col("who_clash") & (F.col("who_born") > lately))
        new_named = (clash_values.filter((F.col("w") == W7) & (F.col("value_born") > lately)).join(hood.births, "node_id").select("order_id", "node")
                     .unionByName(young.select("order_id", F.col("who").cast("string").alias("node")))
                     .unionByName(me_born.filter("me_new and me_clash").select("order_id", F.col("me_name").alias("node"))))
        parts.append(new_named.distinct().groupBy("order_id").agg(F.count("*").alias("new_clash")))

    # orders of the last hour by people of the neighbourhood: the customer's own are always among them
    mine = me.distinct().withColumn("hour", hour)
    own_acts = timed(orders).select(F.col("customer_id").cast("string").alias("who"), F.col("t").alias("act_t"),
                                    F.col("order_id").alias("act_id"))
    own_acts = own_acts.withColumn("hour", F.explode(F.array(bucket("act_t", F.lit(HOUR)), bucket("act_t", F.lit(HOUR)) + 1)))
    named_hot = None if hood.skew.customers is None else hood.skew.customers.select(
        F.col("customer_id").cast("string").alias("who"), "hot_customer")
    burst = (spread_join(mine, own_acts, ["who", "hour"], named_hot, {})
             .filter(before("act_t", "act_id", "t", "order_id", hood.ties) & (F.col("act_t") > lately))
             .groupBy("order_id").agg(F.count("*").alias("burst_own")))
    parts += [me_born.drop("me_name"), link_summary(hood.links), burst]

    out = hood.focus.select("order_id")
    for part in parts:
        out = out.join(part, "order_id", "left")
    if not hood.clashes:
        out = out.select("*", *[F.lit(0).alias(c) for c in ("clash_24h", "clash_7d", "new_clash")])

    def n(c: str) -> Column:
        return F.coalesce(_count(F.col(c)), F.lit(0.0))

    new_nodes = (n("new_people") + n("new_values") + n("new_clash")
                 + F.when(F.col("me_new") & ~F.col("me_clash"), F.lit(1.0)).otherwise(F.lit(0.0)))
    eps = F.lit(1e-5)
    named: dict[str, Column] = {}
    for _, tag in TAGS:
        c, e, k = n(f"others_{tag}") + 1, n(f"plain_{tag}") + n(f"clash_{tag}"), n(f"edge_{tag}")
        named[f"subgraph_node_count_{tag}"] = c + e
        named[f"subgraph_customer_count_{tag}"] = c
        named[f"subgraph_entity_count_{tag}"] = e
        named[f"subgraph_edge_count_{tag}"] = k
        one_c, one_e = F.greatest(F.lit(1.0), c), F.greatest(F.lit(1.0), e)
        named[f"subgraph_edge_density_{tag}"] = k / (one_c * one_e + eps)
        named[f"subgraph_avg_entities_per_cust_{tag}"] = k / one_c
        named[f"subgraph_avg_custs_per_entity_{tag}"] = k / one_e
    named |= {
        "subgraph_shared_modality_count_7d": F.coalesce(_count(F.bit_count("types")), F.lit(0.0)),
        "subgraph_multi_entity_conspirator_count_7d": n("overlapping"),
        "subgraph_max_entity_overlap_degree_7d": n("max_overlap"),
        "subgraph_new_nodes_1h": new_nodes, "subgraph_new_edges_1h": n("new_edges"),
        "subgraph_growth_ratio_1h_vs_24h":
            new_nodes / (named["subgraph_node_count_24h"] / F.lit(24.0) + eps),
        "subgraph_bridge_disjoint_components_7d": bridge_components(),
        "subgraph_order_burst_velocity_1h": n("burst_others") + n("burst_own"),
    }
    return out.select("order_id", *[named[c].alias(c) for c in SUBGRAPH_COLUMNS])


def _forest_edges(code: int) -> int:
    """Edges of a spanning forest of the four sets, for a bit pattern of linked pairs."""
    group = {b: b for b in ENTITY_BIT.values()}
    used = 0
    for k, p in enumerate(PAIR_BITS):
        a, b = [x for x in ENTITY_BIT.values() if p & x]
        if code >> k & 1 and group[a] != group[b]:
            old = group[b]
            group = {n: group[a] if g == old else g for n, g in group.items()}
            used += 1
    return used


def bridge_components() -> Column:
    """Components among the (at most four) non-empty peer sets, linked where two sets meet.

    Components = non-empty sets less the edges of a spanning forest, which depend on the six pair
    flags alone: a lookup in a 64-entry array made from the rule above.
    """
    code = sum(F.coalesce(F.col(f"pair_{p}"), F.lit(0)) * F.lit(1 << k) for k, p in enumerate(PAIR_BITS))
    forest = F.get(F.array(*[F.lit(_forest_edges(c)) for c in range(1 << len(PAIR_BITS))]), code)
    sets = F.bit_count(F.coalesce(F.col("types"), F.lit(0)))
    return F.when(sets <= 1, F.lit(0.0)).otherwise((sets - forest).cast("double"))


def same_type_reach(edges: DataFrame) -> DataFrame:
    """(etype, value, far, at): from which order on some user of ``value`` has also used ``far``.

    Lifetime sets only grow, so what a value reaches is a list of arrival times per value; orders read
    a running count of it and never meet the customers in between.
    """
    a = edges.select("etype", "customer_id", "value", F.struct("from_t", "from_id").alias("f"))
    b = edges.select("etype", "customer_id", F.col("value").alias("far"), F.struct("from_t", "from_id").alias("g"))
    return (a.join(b, ["etype", "customer_id"]).groupBy("etype", "value", "far")
            .agg(F.min(F.greatest("f", "g")).alias("at")))


def heavy_users(edges: DataFrame, heavy: int) -> DataFrame:
    """(etype, value, star, star_at): the user of the value with the most values of the type, if more than ``heavy``."""
    many = edges.groupBy("etype", "customer_id").agg(F.count("*").alias("n")).filter(F.col("n") > heavy)
    return edges.join(many, ["etype", "customer_id"]).groupBy("etype", "value").agg(
        F.max(F.struct("n", "customer_id", F.struct("from_t", "from_id").alias("at"))).alias("s")).select(
        "etype", "value", F.col("s.customer_id").alias("star"), F.col("s.at").alias("star_at"))


@dataclass(frozen=True)
class Lifetime:
    """What values reach over the customers that ever used them, by the first uses (``edges``).

    ``gains`` (etype, value, at, _in): when a value reaches one more of its type, or what its heavy user has anyway. A value's heaviest user (``stars``)
    is not paired with its values: orders read the running count of what that customer has used, and what the other users reach
    is counted only until the heavy one has it too. ``reaches`` lists (etype, value, far, at), the heavy users' own values apart."""

    edges: DataFrame
    gains: DataFrame
    reaches: tuple[DataFrame, ...]
    stars: DataFrame | None


def lifetime(orders: DataFrame, heavy: int = 1_000) -> Lifetime:
    edges = materialise(first_edges(orders), "first-edges")
    stars = materialise(heavy_users(edges, heavy), "stars")
    none = stars.isEmpty()
    light = edges if none else edges.join(
        stars.select("etype", "value", F.col("star").alias("customer_id"), F.lit(True).alias("_star")),
        ["etype", "value", "customer_id"], "left").filter(F.col("_star").isNull()).drop("_star")
    first = F.struct("from_t", "from_id")
    if none:
        reach = materialise(same_type_reach(edges), "reach")
        gains = reach.select("etype", "value", "at", F.lit(1).alias("_in"))
    else:
        a = light.select("etype", "customer_id", "value", first.alias("f"))
        b = edges.select("etype", "customer_id", F.col("value").alias("far"), first.alias("g"))
        reach = materialise(a.join(b, ["etype", "customer_id"]).groupBy("etype", "value", "far").agg(
            F.min(F.greatest("f", "g")).alias("at")), "reach")
        has = edges.select("etype", F.col("customer_id").alias("star"), F.col("value").alias("far"), first.alias("had"))
        both = reach.join(stars, ["etype", "value"], "left").join(has, ["etype", "star", "far"], "left").withColumn(
            "taken", F.when(F.col("had").isNotNull(), F.greatest("had", "star_at")))
        gains = both.filter(F.col("taken").isNull() | (F.col("at") < F.col("taken"))).select("etype", "value", F.inline(F.array_compact(F.array(
            F.struct(F.col("at"), F.lit(1).alias("_in")),
            F.when(F.col("taken").isNotNull(), F.struct(F.col("taken").alias("at"), F.lit(-1).alias("_in")))))))
    if none:
        return Lifetime(edges, gains, (reach,), None)
    star_reach = stars.join(edges.select("etype", F.col("customer_id").alias("star"), F.col("value").alias("far"), first.alias("had")), ["etype", "star"])
    return Lifetime(edges, gains, (reach, star_reach.select("etype", "value", "far", F.greatest("had", "star_at").alias("at"))), stars)


def held_by_stars(mine: DataFrame, life: Lifetime, ties: str, skew: SkewPlan) -> DataFrame:
    """(order_id, held): what the heavy users of an order's values had used by then, summed over the values."""
    read = mine.join(life.stars, ["etype", "value"]).filter(
        before("star_at.from_t", "star_at.from_id", "t", "order_id", ties)).select(
        "etype", F.col("star").alias("customer_id"), "t", "order_id", F.lit(0).alias("_in"))
    have = life.edges.join(life.stars.select("etype", F.col("star").alias("customer_id")).distinct(), ["etype", "customer_id"], "left_semi").select(
        "etype", "customer_id", F.col("from_t").alias("t"), F.col("from_id").alias("order_id"), F.lit(1).alias("_in"))
    both = read.unionByName(have).withColumn("_gain", F.col("_in") != 0)
    flag = None
    if skew.customers is not None:
        both, flag = skew.mark(both), "hot_customer"
    held = sweep(both, ["etype", "customer_id"], [Measure("held", F.col("_in"))], ties, flag, skew.slice_us, then_by=["_gain"])
    return held.filter(~F.col("_gain")).groupBy("order_id").agg(F.sum("held").alias("held"))


def graph_features(orders: DataFrame, history_days: int = 30, ties: str = "sequence", skew: SkewPlan | None = None,
                   targets: DataFrame | None = None, crowd: int = 256, heavy: int = 1_000) -> DataFrame:
    """18 columns over the lifetime customer-entity graph; the customer's own reuse counts.

    The union of customers over the four values is counted without listing the most popular one when
    it has more than ``crowd`` customers: its running distinct count, plus the customers of the other
    three that are not among its own.
    """
    skew = skew or find_skew(orders)
    base = focus_rows(customer_level(orders, history_days, ties, skew, counts=False), targets)
    life = lifetime(orders, heavy)
    flat = pivot_levels(shared_level(orders, ties, skew, peers=False, gains=life.gains))
    out = with_graph(with_levels(base.select("order_id", "n_hist"), flat), orders, life, ties, skew, targets, crowd)
    return out.select("order_id", *graph_columns(history_days))


def with_graph(out: DataFrame, orders: DataFrame, life: Lifetime, ties: str, skew: SkewPlan, targets: DataFrame | None, crowd: int) -> DataFrame:
    """``out`` (order_id, ...) with what ``graph_columns`` reads besides the customer's history and what is counted on the values."""
    edges = life.edges
    focus = focus_rows(orders, targets)
    mine = unpivot_entities(timed(focus)).select("order_id", "t", "etype", "value",
                                                 F.col("customer_id").cast("string").alias("me"))
    users = edges.select("etype", "value", F.col("customer_id").alias("who"), "from_t", "from_id")
    earlier = before("from_t", "from_id", "t", "order_id", ties)
    popular = materialise(edges.groupBy("etype", "value").agg(F.count("*").alias("degree")).filter(F.col("degree") > crowd), "popular")
    if popular.isEmpty():
        known = mine.join(users, ["etype", "value"]).filter(earlier).select("order_id", "who")
        # dealt by order once: its people are made distinct and counted there
        near = known.repartition("order_id").distinct().groupBy("order_id").agg(F.count("*").alias("listed"))
        out = out.join(near, "order_id", "left").withColumn("crowd_type", F.lit(None).cast("string"))
    else:
        skip = (mine.join(popular, ["etype", "value"]).groupBy("order_id")
                .agg(F.max(F.struct("degree", "etype", "value")).alias("s")).select(
                    "order_id", F.col("s.etype").alias("crowd_type"), F.col("s.value").alias("crowd_value")))
        skip = materialise(skip, "crowded")
        listed = mine.join(skip, "order_id", "left").filter(F.col("crowd_type").isNull() | (F.col("crowd_type") != F.col("etype")))
        known = listed.join(users, ["etype", "value"]).filter(earlier).select(
            "order_id", "t", "who", "crowd_type", "crowd_value").distinct()
        member = users.select(F.col("etype").alias("crowd_type"), F.col("value").alias("crowd_value"), "who", "from_t", "from_id").join(
            popular.select(F.col("etype").alias("crowd_type"), F.col("value").alias("crowd_value")), ["crowd_type", "crowd_value"])
        known = known.join(member, ["crowd_type", "crowd_value", "who"], "left").filter(
            F.col("from_t").isNull() | ~before("from_t", "from_id", "t", "order_id", ties))
        near = known.groupBy("order_id").agg(F.count("*").alias("listed"))
        out = out.join(near, "order_id", "left").join(skip.select("order_id", "crowd_type"), "order_id", "left")

    out = out.withColumn("held", F.lit(0)) if life.stars is None else out.join(held_by_stars(mine, life, ties, skew), "order_id", "left")
    # equal strings under several kinds are one node: take back what was counted twice
    clash = materialise(name_births(orders).filter("clash").select(F.col("node").alias("far")), "clash")
    if clash.isEmpty():
        out = out.withColumn("twice", F.lit(0))
    else:
        # the few clashing strings are looked up one by one; the joins start from them
        named = None
        for r in life.reaches:
            part = r.join(clash, "far")
            named = part if named is None else named.unionByName(part)
        named = named.groupBy("etype", "value", "far").agg(F.min("at").alias("at")).select(
            "etype", "value", "far", F.col("at.from_t").alias("from_t"), F.col("at.from_id").alias("from_id"))
        same = mine.join(named, ["etype", "value"]).filter(earlier).groupBy("order_id", "me", "far").agg(F.count("*").alias("n"))
        back = same.groupBy("order_id").agg(F.sum(F.col("n") - F.when(F.col("far") == F.col("me"), 0).otherwise(1)).alias("twice"))
        out = out.join(back, "order_id", "left")
    return out


def graph_columns(history_days: int, history: str = "n_hist") -> list[Column]:
    crowd_people = F.lit(0.0)
    for e in ENTITIES:
        crowd_people = F.when(F.col("crowd_type") == e, F.col(f"{e}__people_ever")).otherwise(crowd_people)
    named: dict[str, Column] = {
        "graph_prior_orders": F.col(history),
        "graph_velocity": F.col(history) / F.lit(float(max(history_days, 1))),
        "graph_neighbor_count": F.coalesce(_count(F.col("listed")), F.lit(0.0)) + crowd_people,
        "graph_component_size_approx": sum(F.col(f"{e}__far") for e in ENTITIES) + F.coalesce(_count(F.col("held")), F.lit(0.0)) - F.coalesce(_count(F.col("twice")), F.lit(0.0)) + F.lit(1.0),
    }
    reused = {e: _count(F.col(f"{e}__people_ever") > 0) for e in ENTITIES}
    for e in ENTITIES:
        named[f"{e}_shared_accounts"] = F.col(f"{e}__people_ever")
        named[f"{e}_is_reused"] = reused[e]
        named[f"{e}_customer_degree"] = F.col(f"{e}__people_ever")
    named["graph_shared_entity_count"] = sum(reused.values())
    named["graph_shared_ratio"] = sum(reused.values()) / F.lit(4.0)
    return [named[c].alias(c) for c in GRAPH_COLUMNS]
