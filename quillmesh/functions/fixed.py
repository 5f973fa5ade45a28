"""Word lists and tables that must be what they are for right results."""

from __future__ import annotations

#: Labels that extraction appends to names.
ENTITY_LABELS = ["person", "organization", "location", "date", "time", "work of art", "event", "product", "law", "language", "nationality", "religion", "title", "facility", "number", "country", "date range"]

#: The attributes that an entity may have.
ATTRIBUTES = [
    "person", "role", "profession",
    "organization", "company", "team", "club", "government", "institution", "group",
    "country", "region", "area", "city", "location", "place",
    "year", "date", "period", "century",
    "film", "book", "song", "tv-show", "creative-work",
    "event", "sports-event", "tournament", "match", "competition", "war", "treaty",
    "religion", "denomination", "ideology", "language", "word", "term", "meaning", "concept",
    "number", "quantity", "measurement",
    "object", "other",
]

#: Words that head the tables of sport and office pages.
TABLE_HEADERS = ["Nat", "Tenure", "Honours", "Founded", "Position", "Manager"]

#: How an infobox gives a date of birth.
BIRTH_DATE = r"Born\s*:\s*\(\d{4}-\d{2}-\d{2}\)"

#: Outcomes of the extraction of a chunk.
STATUSES = ["ok", "retry_ok", "empty", "failed"]

#: Which attributes of an entity may fill a slot of the given attribute (directed).
ATTRIBUTE_FAMILIES = {
    "person": "person profession role", "role": "person profession role", "profession": "person profession role", "director": "person profession role",
    "missionary": "group person profession role", "arguer": "person role",
    "organization": "club company government group institution organization team", "company": "company organization", "team": "club group organization team",
    "club": "club organization team", "institution": "institution organization", "government": "country government organization", "group": "group organization team",
    "country": "area country location place region", "region": "area country location place region", "area": "area country location place region",
    "city": "area city location place", "location": "area city location place region", "place": "city location place region",
    "year": "century date period year", "date": "date period year", "period": "century date period year", "century": "century period year", "time": "century date period year",
    "film": "creative-work film tv-show", "book": "book creative-work", "song": "creative-work song", "tv-show": "creative-work film tv-show", "creative-work": "book creative-work film song tv-show",
    "event": "competition event match sports-event tournament treaty war", "match": "competition event match sports-event tournament", "war": "conflict event treaty war", "conflict": "conflict event war",
    "competition": "competition event sports-event tournament", "tournament": "competition event sports-event tournament", "sports-event": "competition event match sports-event tournament", "treaty": "event treaty",
    "religion": "denomination religion", "denomination": "denomination religion", "ideology": "concept ideology", "language": "language",
    "word": "language term word", "term": "concept religion term word", "meaning": "concept meaning term word", "concept": "concept ideology term",
    "number": "number quantity", "quantity": "measurement number quantity", "measurement": "measurement number quantity", "object": "object",
    "imperialist power": "country ideology", "rainforest": "area location place region", "dictionary": "book creative-work language",
}

#: Kinds of failure of an answer, in the order in which a label is looked for.
FAILURE_CATEGORIES = ["kg_missing_fact", "decomposition_under_coverage", "entity_disambiguation", "long_tail_relation", "llm_answering_error", "annotation_noise"]
