from courtside.functions.coerce import (
    first_nonempty,
    first_nonzero,
    fields,
    lookup,
    strict_float,
    strict_int,
    trim_space,
    zip_last_wins,
)
from courtside.functions.text import (
    duration_ns,
    duration_seconds,
    has_class_token,
    key_hash,
    key_hash_hex,
    pixels,
    shot_page_url,
    season_page_url,
)

__all__ = [
    "duration_ns", "fields", "first_nonempty", "first_nonzero", "duration_seconds",
    "has_class_token", "key_hash", "key_hash_hex", "lookup", "pixels", "season_page_url",
    "shot_page_url", "strict_float", "strict_int", "trim_space", "zip_last_wins",
]
