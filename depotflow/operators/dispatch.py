"""Delivery orders: load, location, and which vehicle takes them."""

from pyspark.sql import functions as F

from ..functions.bounded import inline_rows
from ..functions.geo import POSITION, geo_distance_km, position, with_nearest
from ..functions.once import computed_once, shuffled_once
from ..functions.text import WHITE_SPACE, is_blank, usable_degrees
from ..schema import (
    BAG_LOAD, BOX_LOAD, DEFAULT_EFFICIENCY, DEFAULT_START, NO_ADDRESS, NOT_FOUND, UNASSIGNED)
from .nearest import with_nearest_by_grid

START = ("start_lat", "start_lon")
# Every order looks at the whole carried fleet, so this stays small.
INLINE_MAX_FLEET = 500
# Length of the pieces by which keywords are looked up, and the values that blank addresses are spread over.
ANCHOR = 3
SCATTER = 1_024
FLEET_FIELDS = ("vehicle_id", *POSITION, "start_lat", "keywords")


def with_total_load(orders):
    """Boxes count fully, bags a fifth; NULL quantities count as 0."""
    box, bag = (F.coalesce(c, F.lit(0.0)) for c in ("box_qty", "bag_qty"))
    return orders.withColumns({
        "box_qty": box, "bag_qty": bag, "total_load": box * BOX_LOAD + bag * BAG_LOAD})


def locate(df, coord="coord", prefix=""):
    """Adds lat and lon columns, `parse_coord` of a coordinate text column.

    The text is cut and read once a row; as one expression each column, and each filter on one, would read it anew.
    """
    cut = computed_once(df, {"_parts": F.split(coord, ",")})
    read = computed_once(cut, {
        name: F.try_element_at("_parts", F.lit(place)).try_cast("double") for place, name in ((1, "_lon"), (2, "_lat"))})
    usable = usable_degrees(F.col("_lat"), F.col("_lon"))
    return read.withColumns({
        f"{prefix}{name}": F.when(usable, F.col(f"_{name}")) for name in ("lat", "lon")}).drop("_parts", "_lat", "_lon")


def with_vehicle_defaults(vehicles):
    """Start position and efficiency per vehicle, with defaults for what is missing."""
    if "efficiency" not in vehicles.columns:
        vehicles = vehicles.withColumn("efficiency", F.lit(None).cast("double"))
    efficiency = F.coalesce(
        F.nanvl("efficiency", F.lit(None).cast("double")), F.lit(DEFAULT_EFFICIENCY))
    return (
        locate(vehicles, "start_coord", "start_")
        .withColumns({
            "start_lat": F.coalesce("start_lat", F.lit(DEFAULT_START[0])),
            "start_lon": F.coalesce("start_lon", F.lit(DEFAULT_START[1])),
            "efficiency": efficiency})
        .select("vehicle_id", "vehicle_name", *START, "efficiency"))


def depot_center(vehicles):
    """Mean of the start positions."""
    return vehicles.agg(F.avg("start_lat").alias("lat"), F.avg("start_lon").alias("lon"))


def geocode_orders(orders, geo):
    """Coordinate text from a reference table, or the reason why there is none.

    Addresses are compared without outer white space. When an address is
    listed more than once the lowest `hit` counts, or the lowest coordinate
    text where the table has no such column. Blank addresses get scattered keys
    that match nothing, since a NULL key would bring them all into one task.
    """
    first = F.min(F.struct("hit", "coord"))["coord"] if "hit" in geo.columns else F.min("coord")
    known = geo.groupBy(F.btrim("address", F.lit(WHITE_SPACE)).alias("geo_key")).agg(first.alias("geo_coord"))
    blank = is_blank(F.col("address"))
    coord = (
        F.when(blank, NO_ADDRESS)
        .when(F.col("geo_coord").isNull(), NOT_FOUND)
        .otherwise(F.col("geo_coord")))
    scattered = F.concat(F.lit("\x01"), F.xxhash64(*orders.columns).cast("string"))
    keyed = orders.withColumn(
        "geo_key", F.when(blank, scattered).otherwise(F.btrim("address", F.lit(WHITE_SPACE)))).drop("coord")
    return keyed.join(known, "geo_key", "left").withColumn("coord", coord).drop(
        "geo_key", "geo_coord")


def zone_candidates(orders, zones, max_inline=INLINE_MAX_FLEET):
    """One row for each order and vehicle with a zone keyword inside the address.

    Rows carry the columns of `order_keys`. `max_inline` above 0 carries the zones along and
    bounds them; 0 uses joins. Orders matching no zone keep one row with a NULL vehicle.
    """
    keys = order_keys(orders)
    if not max_inline:
        pairs = scattered(_address_candidates(orders, zones), everywhere=True)
        return scattered(orders.select(*keys, "address")).join(
            pairs, ["address", "scatter"], "left").select(*keys, "vehicle_id")
    zone_rows = orders.select(*keys, "address", inline_rows(
        zones, "vehicle_id", "keyword", most=max_inline).alias("zones"))
    hits = F.filter("zones", lambda z: F.contains(F.col("address"), z["keyword"]))
    ids = F.array_distinct(F.transform(hits, lambda z: z["vehicle_id"]))
    return zone_rows.select(*keys, F.explode_outer(ids).alias("vehicle_id"))


def scattered(df, everywhere=False):
    """A second join key that spreads NULL and blank addresses, which may be a large share of the rows.

    `everywhere` is for the other side: its blank addresses are repeated for every value.
    """
    blank = is_blank(F.col("address"))
    if everywhere:
        values = F.when(blank, F.sequence(F.lit(0), F.lit(SCATTER - 1))).otherwise(F.array(F.lit(0)))
        return df.select("*", F.explode(values).alias("scatter"))
    spread = F.pmod(F.xxhash64(*order_keys(df)), F.lit(SCATTER)).cast("int")
    return df.withColumn("scatter", F.when(blank, spread).otherwise(0))


def _pieces(df, text, lengths):
    """One row per position of `text` and entry of `lengths`, with the piece that starts there."""
    here = F.col(text)
    starts = F.sequence(F.lit(1), F.length(here) - F.col("n") + 1)
    return (
        df.select("*", F.explode(lengths).alias("n")).where(F.length(here) >= F.col("n"))
        .select("*", F.explode(F.array_distinct(
            F.transform(starts, lambda i: F.substring(here, i, F.col("n"))))).alias("piece"))
        .drop("n"))


def _address_candidates(orders, zones):
    """(address, vehicle_id) where a keyword of the vehicle lies inside the address.

    Equi-joins, for zone maps of any size. An address is cut into pieces of
    ANCHOR characters, one per position whatever the keywords' lengths are. Each keyword
    is looked up by one of its own pieces, the one that the fewest addresses hold,
    and the addresses found are compared with the whole keyword. Keywords shorter than
    ANCHOR are their own piece; only where such exist, addresses are cut into these lengths too.
    """
    words = zones.where(F.col("keyword").isNotNull()).select("keyword").distinct().withColumn(
        "anchor", F.least(F.length("keyword"), F.lit(ANCHOR)))
    addresses = (
        orders.select("address").where(F.col("address").isNotNull()).distinct()
        .withColumn("address_id", F.xxhash64("address")))
    lengths = words.agg(F.array_sort(F.collect_set("anchor"))).scalar()
    cut = _pieces(addresses, "address", lengths).select("address_id", "piece")
    found = cut.groupBy("piece").agg(F.count("*").alias("addresses"))
    # A keyword one of whose pieces no address holds is in no address: any piece will do then.
    rarest = (
        _pieces(words, "keyword", F.array("anchor")).join(found, "piece", "left")
        .groupBy("keyword")
        .agg(F.min_by("piece", F.struct(F.coalesce("addresses", F.lit(0)), "piece")).alias("piece")))
    maybe = cut.join(rarest, "piece").select("address_id", "keyword")
    inside = maybe.join(addresses, "address_id").where(F.contains("address", "keyword"))
    return inside.select("address", "keyword").join(zones, "keyword").select("address", "vehicle_id").distinct()


def assign_vehicles(orders, vehicles, zones, max_inline=INLINE_MAX_FLEET):
    """The nearest vehicle of each located order, measured from the vehicle's start.

    Vehicles whose zone matches the address are considered first; without one,
    all vehicles are. Ties go to the lowest id. `assign_phase` tells the cases
    apart: 1 one candidate, 2 several, 3 none.

    With `max_inline` above 0 a fleet of at most so many vehicles rides along as one array and
    the whole operator is a projection; a larger fleet is an error. With 0 any fleet
    is matched by joins. Both give the same rows, also where ids of orders restart each day; an
    empty fleet gives none. An order is (scenario_id, route_day, order_id), as far as present.
    """
    located = only_located(orders)
    if max_inline:
        return _assign_inline(located, vehicles, zones, max_inline)
    return assign_by_join(located, vehicles, zones)


def order_keys(*frames):
    """Columns that identify an order in all frames."""
    return [c for c in ("scenario_id", "route_day", "order_id") if all(c in f.columns for f in frames)]


def only_located(orders):
    return orders.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def with_zone_keywords(vehicles, zones):
    """Fleet rows as the inline form needs them, with the keywords of each vehicle."""
    keywords = zones.groupBy("vehicle_id").agg(F.collect_set("keyword").alias("keywords"))
    return vehicles.join(keywords, "vehicle_id", "left").select(
        *[c for c in ("scenario_id",) if c in vehicles.columns],
        "vehicle_id", "start_lat", "keywords",
        *[c.alias(n) for n, c in position(*START).items()])


def _assign_inline(located, vehicles, zones, most):
    fleet = inline_rows(with_zone_keywords(vehicles, zones), *FLEET_FIELDS, most=most)
    return assign_from_fleet(located.withColumn("fleet", fleet)).drop("fleet")


def assign_from_fleet(orders):
    """Assignment of located orders that carry their `fleet` as an array."""
    def in_zone(vehicle):
        return F.exists(vehicle["keywords"], lambda k: F.contains(F.col("address"), k))

    zoned = F.size("pool")
    matched = (
        orders.where(F.size("fleet") > 0)
        .withColumn("pool", F.filter("fleet", in_zone))
        .withColumn("assign_phase", F.when(zoned == 0, 3).when(zoned == 1, 1).otherwise(2))
        .withColumn("pool", F.when(zoned == 0, F.col("fleet")).otherwise(F.col("pool"))))
    placed = computed_once(with_nearest(matched, "pool"), {"depot": F.filter(
        "fleet", lambda v: v["vehicle_id"] == F.col("best.vehicle_id"))[0]})
    return placed.select(
        *orders.columns,
        F.col("best.vehicle_id").alias("vehicle_id"),
        F.col("best.km").alias("distance_km"),
        "assign_phase",
        F.col("depot.start_lat").alias("start_lat"),
        F.col("depot.lon").alias("start_lon"))


def assign_by_join(located, vehicles, zones):
    """Assignment by equi-joins; a `scenario_id` on both sides belongs to every key.

    Orders go through the zone step and the grid in one line of joins: a second branch for orders without a zone would
    repeat all of the zone step in the plan. Located orders and starts are shuffled once and read from there by every
    use. Starts are joined to the candidates of an address, of which there are few, before orders are.
    """
    by = [c for c in ("scenario_id",) if c in vehicles.columns]
    order = order_keys(located)
    depots = shuffled_once(vehicles.select(*by, "vehicle_id", *START), ["vehicle_id"])
    orders = shuffled_once(located, order)
    points = orders().select(*order, "address", "lat", "lon").distinct()
    fleet_zones = zones.join(depots().select("vehicle_id"), "vehicle_id", "left_semi")
    candidates = scattered(_address_candidates(orders(), fleet_zones).join(depots(), "vehicle_id"), everywhere=True)
    pairs = scattered(points).join(candidates, [*by, "address", "scatter"], "left")
    km = geo_distance_km("start_lat", "start_lon", "lat", "lon")
    mine = F.when(F.col("start_lat").isNotNull(), F.struct(km.alias("km"), "vehicle_id", *START))
    zoned = pairs.groupBy(*order, "lat", "lon").agg(F.min(mine).alias("zoned"), F.count(mine).alias("hits"))
    found = with_nearest_by_grid(zoned, orders(), depots(), F.col("hits") == 0, order, by, known="zoned")
    best = found.select(*order, "best.*", F.when(F.col("hits") == 0, 3).when(F.col("hits") == 1, 1).otherwise(2).alias("assign_phase"))
    return orders().join(best, order).select(
        *located.columns, "vehicle_id", F.col("km").alias("distance_km"), "assign_phase", *START)


def dispatch_detail(orders, stops, vehicles):
    """All orders with vehicle name and arrival time; orders without a stop say so.

    Orders and stops meet on every key that both have: scenario, day, order id.
    Stops of several scenarios need orders with a `scenario_id`.
    """
    if "scenario_id" in stops.columns and "scenario_id" not in orders.columns:
        raise ValueError("stops of scenarios need orders with a scenario_id")
    keys = order_keys(orders, stops)
    planned = stops.select(*keys, "vehicle_id", "seq", "eta").join(
        vehicles.select("vehicle_id", "vehicle_name"), "vehicle_id", "left")
    return orders.join(planned, keys, "left").withColumns({
        "vehicle_name": F.coalesce("vehicle_name", F.lit(UNASSIGNED)),
        "eta": F.coalesce("eta", F.lit(""))})
