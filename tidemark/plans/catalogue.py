"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

from tidemark.plans import basics, core, domain, feeds, scalars, windows  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "dom_published_index"

#: Columns that Spark counts in 32 bits; DuckDB's differences and lengths have 64.
NARROW = {
    "sort_contributions": ["place"],
    "added_removed_phrases": ["added", "removed"],
    "dom_item_weight": ["age"],
    "dom_weighted_aggregate": ["freshest"],
    "agg_freshest_age": ["age"],
    "dom_lexicon_score": ["pos"],
    "dom_linear_score": ["pos", "label"],
    "str_locate_evidence": ["line", '"offset"'],
    "str_attributed_sentences": ["n"],
    "dom_fomc_rotation": ["year"],
    "scan_yearly_index": ["year"],
    "str_word_count": ["v"],
    "str_split_sentences": ["v"],
    "str_split_guidance": ["v"],
    "str_surname_hits": ["v"],
    "date_age_days": ["v"],
    "date_days_to_meeting": ["days"],
}
for _name, _columns in NARROW.items():
    _casts = ", ".join(f"{c}::INT AS {c}" for c in _columns)
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
