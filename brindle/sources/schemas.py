"""Explicit schemas of the inputs (in DDL), so that no job runs to infer one."""


REVIEW = "review_id string, user_id string, business_id string, stars double, date string, text string"
BUSINESS = "business_id string, name string, state string, stars double, categories string, hours map<string,string>, latitude double, longitude double"
USER = (
    "user_id string, friends string, elite string, yelping_since string, useful long, funny long, cool long, fans long, "
    "compliment_hot long, compliment_writer long, compliment_photos long"
)
RATING = "user_id string, business_id string, stars double"
PAIR_MODEL = "id1 string, id2 string, sim double"
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
