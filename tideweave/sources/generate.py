"""Synthetic auctions and entities as pure column expressions of an id: the same rows for any number of partitions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chance import below, cumulative, drawn, letters, pick, unit

# Fixed values.
STATES = ["AZ", "CA", "ID", "OR", "WA", "WY"]
CITIES = ["Phoenix", "Los Angeles", "San Francisco", "Boise", "Portland", "Bend", "Redmond", "Seattle", "Kent", "Cheyenne"]
FIRST = ["Peter", "Paul", "Luke", "John", "Saul", "Vicky", "Kate", "Julie", "Sarah", "Deiter", "Walter"]
LAST = ["Shultz", "Abrams", "Spencer", "White", "Bartels", "Walton", "Smith", "Jones", "Noris"]
FIRST_PERSON = FIRST_AUCTION = 1000
FIRST_CATEGORY = 10
FIRST_KEY = 100_000_000


@dataclass
class AuctionPlan:
    """Knobs of the auction events; per group of people + auctions + bids consecutive ids."""

    people: int = 1
    auctions: int = 3
    bids: int = 46
    categories: int = 5
    in_flight: int = 100
    active_people: int = 1000
    lead: int = 10
    base_ms: int = 0
    #: microseconds between events; with more than one, they take turns every `rate_period` events
    gaps_us: list[int] = field(default_factory=lambda: [100])
    rate_period: int = 600_000
    #: ids are permuted within groups of this size to come out of order
    out_of_order: int = 1
    padding: int = 0
    seed: int = 42

    @property
    def group(self) -> int:
        return self.people + self.auctions + self.bids


def numbered(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, partitions)


def _count_before(id_: Column, p: AuctionPlan, lo: int, n: int) -> Column:
    """How many events of the kind that takes places lo .. lo + n of each group have an id up to this one."""
    place = F.pmod(id_, F.lit(p.group))
    return F.floor(id_ / p.group) * n + F.least(F.greatest(place - lo + 1, F.lit(0)), F.lit(n))


def event_ms(id_: Column, p: AuctionPlan) -> Column:
    """Event time in ms: the sum of the gaps before this event."""
    g = p.out_of_order
    n = (F.floor(id_ / g) * g + F.pmod(id_ * 953, F.lit(g))) if g > 1 else id_
    if len(p.gaps_us) == 1:
        return p.base_ms + F.floor(n * p.gaps_us[0] / 1000)
    cycle, full = len(p.gaps_us) * p.rate_period, sum(p.gaps_us) * p.rate_period
    rest = F.pmod(n, F.lit(cycle))
    inside = sum((F.least(F.greatest(rest - i * p.rate_period, F.lit(0)), F.lit(p.rate_period)) * gap for i, gap in enumerate(p.gaps_us)), F.lit(0))
    return p.base_ms + F.floor((F.floor(n / cycle) * full + inside) / 1000)


def price(seed: int, purpose: str, id_: Column) -> Column:
    """Log-uniform from 100 to 10**8."""
    return F.round(F.pow(F.lit(10.0), unit(seed, purpose, id_) * 6) * 100).cast("bigint")


def auction_events(ids: DataFrame, p: AuctionPlan = AuctionPlan()) -> DataFrame:  # noqa: B008
    """ids(id bigint) to wide events: type, ms, and the columns of people, auctions and bids (null where they don't apply)."""
    id_, s = F.col("id"), p.seed
    place = F.pmod(id_, F.lit(p.group))
    kind = F.when(place < p.people, "person").when(place < p.people + p.auctions, "auction").otherwise("bid")
    people, auctions = _count_before(id_, p, 0, p.people), _count_before(id_, p, p.people, p.auctions)
    ms = event_ms(id_, p)
    known = F.greatest(people, F.lit(1))
    someone = FIRST_PERSON + known - 1 - below(F.least(known, F.lit(p.active_people)), s, "who", id_)
    ahead = lambda purpose: below(p.lead + 1, s, purpose, id_)
    open_ = F.greatest(auctions, F.lit(1))
    on = lambda k, c: F.when(F.col("type") == k, c)
    first_bid = price(s, "initial", id_)
    rows = ids.select(id_.alias("event_id"), kind.alias("type"), ms.cast("bigint").alias("ms"), id_)
    four = lambda i: F.lpad(below(10_000, s, f"card{i}", id_).cast("string"), 4, "0")
    name = F.concat_ws(" ", pick(FIRST, s, "first", id_), pick(LAST, s, "last", id_))
    columns = [
        on("person", FIRST_PERSON + people - 1).alias("person_id"), on("person", name).alias("name"), on("person", F.concat(letters(F.lit(7), s, "user", id_), F.lit("@"), letters(F.lit(5), s, "domain", id_), F.lit(".com"))).alias("email"),
        on("person", F.concat_ws(" ", *map(four, range(4)))).alias("card"), on("person", pick(CITIES, s, "city", id_)).alias("city"), on("person", pick(STATES, s, "state", id_)).alias("state"),
        on("auction", FIRST_AUCTION + auctions - 1).alias("auction_id"), on("auction", letters(3 + below(18, s, "itemlen", id_), s, "item", id_)).alias("item"), on("auction", letters(3 + below(98, s, "desclen", id_), s, "desc", id_)).alias("description"), on("auction", first_bid).alias("initial_bid"),
        on("auction", first_bid + price(s, "reserve", id_)).alias("reserve"), on("auction", F.col("ms") + 1 + below(F.lit(2 * p.in_flight * sum(p.gaps_us) // len(p.gaps_us) * p.group // max(p.auctions, 1) // 1000 + 1), s, "length", id_)).alias("expires_ms"),
        on("auction", someone).alias("seller"), on("auction", FIRST_CATEGORY + below(p.categories, s, "category", id_)).alias("category"), on("auction", below(10, s, "below", id_) == 0).alias("sell_below_reserve"),
        on("bid", FIRST_AUCTION + open_ - 1 - below(F.least(open_, F.lit(p.in_flight)), s, "auction", id_) + ahead("auctionlead")).alias("auction"), on("bid", someone + ahead("bidlead")).alias("bidder"), on("bid", price(s, "price", id_)).alias("price"),
    ]
    if p.padding:
        # target size plus or minus a fifth
        columns.append(letters(F.lit(p.padding * 4 // 5) + below(p.padding * 2 // 5 + 1, s, "padlen", id_), s, "pad", id_).alias("extra"))
    return rows.select("event_id", "type", "ms", *columns)


@dataclass
class Scenario:
    """From `start` on (a global event id): rate per second, proportions of A, B and C, and distributions by column."""

    start: int = 0
    rate: int = 10_000
    a: int = 1
    b: int = 1
    c: int = 1
    #: column -> (kind, cells, parameters) of functions.chance.cumulative
    shapes: dict = field(default_factory=dict)


DRAWN = {"sel1": ("uniform", 10, {}), "sel2": ("uniform", 10, {}), "long1": ("uniform", 20, {}), "long2": ("uniform", 1000, {}), "filter_attr": ("uniform", 100, {})}


def entity_events(ids: DataFrame, scenarios: list[Scenario] | None = None, keys: int = 50, seed: int = 42, references=None, padding: int = 0, as_json: bool = False) -> DataFrame:
    """ids(id bigint) to entities: A is referred to by B, B by C; `references` changes that ({"C": "A"}); keys repeat within `keys`.

    Scenarios switch at their start; there are few of them, so they are branches of the same columns.
    """
    scenarios = sorted(scenarios or [Scenario()], key=lambda s: s.start)
    references = {"B": "A", "C": "B"} if references is None else references
    id_ = F.col("id")

    def by_scenario(make):
        out = make(0, scenarios[0])
        for i, s in enumerate(scenarios[1:], 1):
            out = F.when(id_ >= s.start, make(i, s)).otherwise(out)
        return out

    began = [0.0]
    for one, two in zip(scenarios, scenarios[1:]):
        began.append(began[-1] + (two.start - one.start) * 1000.0 / one.rate)
    ms = by_scenario(lambda i, s: F.floor(F.lit(began[i]) + (id_ - s.start) * F.lit(1000.0) / s.rate)).cast("bigint")
    kind = by_scenario(lambda i, s: F.when(F.pmod(id_, F.lit(s.a + s.b + s.c)) < s.a, "A").when(F.pmod(id_, F.lit(s.a + s.b + s.c)) < s.a + s.b, "B").otherwise("C"))

    def shaped(kind, cells, more, u):
        return F.floor(u * cells) if kind == "uniform" else drawn(cumulative(kind, cells, **more), u)

    draw = lambda n: by_scenario(lambda i, s: shaped(*s.shapes.get(n, DRAWN[n]), unit(seed, n, id_)))
    refers = F.lit(False)
    for k in references:
        refers = refers | (F.col("type") == k)
    rows = ids.select(id_, kind.alias("type"), ms.alias("ms"))
    rows = rows.select("type", "id", F.timestamp_millis("ms").alias("ts"), "ms", (FIRST_KEY + F.when(F.col("type") == "C", id_).otherwise(F.pmod(id_, F.lit(keys)))).alias("pk"), F.when(refers, FIRST_KEY + below(keys, seed, "fk", id_)).otherwise(F.lit(-1)).alias("fk"), draw("sel1").alias("sel1"), draw("sel2").alias("sel2"), draw("long1").alias("long1"), draw("long2").alias("long2"), draw("filter_attr").cast("int").alias("filter_attr"), letters(3 + below(10, seed, "textlen", id_), seed, "text", id_).alias("text"))
    if padding:
        rows = rows.withColumn("padding", letters(F.lit(padding * 4 // 5) + below(padding * 2 // 5 + 1, seed, "padlen", F.col("id")), seed, "pad", F.col("id")))
    if as_json:
        return rows.select("id", "ts", "ms", F.to_json(F.struct("type", F.col("pk").alias("PK"), F.col("fk").alias("FK"), F.col("sel1").alias("selectivityAttribute1"), F.col("sel2").alias("selectivityAttribute2"), F.col("long1").alias("longAttribute1"), F.col("long2").alias("longAttribute2"), F.col("filter_attr").alias("filterAttribute"), F.col("text").alias("plainString"))).alias("json"))
    return rows
