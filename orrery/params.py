"""Tunables of the retrieval engine and their defaults."""

CHUNK_SIZE = 256
CHUNK_OVERLAP = 38
BM25_TOP_K = VECTOR_TOP_K = GRAPH_TOP_K = KG_TOP_K = 20
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
CE_TOP_K = 5
CE_THRESHOLD = 3.0
GRAPH_ENTITY_TOP_N = 12
GRAPH_HOP = 1
GRAPH_RRF_WEIGHT = 0.6
KG_MAX_HOP = 2
KG_RRF_WEIGHT = 0.5
KG_QUERY_ENTITIES = 20
POS_COEFFICIENT = 0.5
FUZZY_RATIO, FUZZY_LENGTH = 0.8, 4
MAX_ATTEMPTS = 2
PREVIEW_CHARS = 500
RELATION_CHARS = 20
#: Sides of at most so many rows and bytes may be broadcast by hint; beyond, the planner chooses.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 1 << 26
#: Cases below which a calibrated threshold is marked as of low confidence.
LOW_CASES = 30
