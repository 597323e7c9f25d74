"""Vocabularies and default parameters of the supply graph, in one place."""

# ---- fixed values: entity and relation vocabularies
ENTITY_TYPES = ("Supplier", "Manufacturer", "Part", "Port", "Region", "LogisticsRoute", "DisruptionEvent", "Customer")
RELATIONS = ("supplies", "depends_on", "ships_through", "located_in", "affected_by", "alternative_to", "sells_to", "connects")
#: Relations along which a disruption spreads, with the share of an edge's weight they pass on.
SPREAD = {"supplies": 1.0, "depends_on": 1.0, "ships_through": 0.70, "located_in": 0.50}
GAMMA, MAX_HOPS, PRUNE = 0.85, 5, 0.03
SEVERITY = (("Critical", 0.80), ("High", 0.50), ("Moderate", 0.25))
TOP_SEEDS, RADIUS, MAX_NODES, MIN_SIMILARITY = 5, 2, 40, 0.20
SEMANTIC_WEIGHT, DEGREE_WEIGHT, HOP_DECAY = 0.6, 0.4, 0.5
RETRIEVAL_WEIGHT, DISRUPTION_WEIGHT = 0.5, 0.5
CRITICAL_EDGE, CACHE_HIT, MERGE_COSINE = 0.95, 0.92, 0.88

EDGE_SCHEMA = "src string, dst string, relation string, weight double"
NODE_SCHEMA = "name string, entity_type string, label string"
