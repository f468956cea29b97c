"""Column types of the two data models: auctions and entities."""

PERSON = "id bigint, name string, email string, card string, city string, state string, ts timestamp, extra string"
AUCTION = "id bigint, item string, description string, initial_bid bigint, reserve bigint, ts timestamp, expires timestamp, seller bigint, category bigint, extra string, sell_below_reserve boolean"
BID = "auction bigint, bidder bigint, price bigint, ts timestamp, extra string"
ENTITY_JSON = "type string, PK bigint, FK bigint, selectivityAttribute1 bigint, selectivityAttribute2 bigint, longAttribute1 bigint, longAttribute2 bigint, filterAttribute int, plainString string, padding string"
ENTITY = ["type", "id", "ts", "ms", "pk", "fk", "sel1", "sel2", "long1", "long2", "filter_attr"]
