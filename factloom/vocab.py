"""Fixed values of the data model: vocabularies, the slot dictionary and the section priors."""

# fixed values
ROLES = ["background", "claim", "method", "result", "comparison", "limitation", "future", "other"]
ENTITY_TYPES = ["Material", "Property", "Process", "Technique", "Condition", "Phase", "Element", "Equipment", "Facility", "Person", "Location"]
FRAME_TYPES = ["MaterialMeasurement", "SynthesisProcedure", "ClaimFact", "HypothesisFact"]
FACT_STATUSES = ["hypothesis", "unverified", "verified", "contested", "refuted"]
EDGE_TYPES = [
    "HAS_MATERIAL", "HAS_PROPERTY", "USES_TECHNIQUE", "UNDER_CONDITION", "VIA_PROCESS", "PRODUCES", "CONTAINS", "HAS_PHASE", "ENABLES", "INHIBITS",
    "CAUSES", "CORRELATES_WITH", "AFFECTS", "SUPPORTED_BY", "CONTRADICTED_BY", "DERIVED_FROM", "REPORTS", "MENTIONS", "CITES", "IS_A", "INSTANCE_OF",
    "SUBTYPE_OF", "PART_OF", "USES_EQUIPMENT", "CONDUCTED_BY", "AUTHORED_BY", "AFFILIATED_WITH", "LOCATED_IN",
]
NON_PARTICIPANT = ["SUPPORTED_BY", "CONTRADICTED_BY", "SUBTYPE_OF", "PART_OF", "INSTANCE_OF", "IS_A", "AUTHORED_BY", "AFFILIATED_WITH"]
DISCOURSE = ["SUPPORTED_BY", "CONTRADICTED_BY", "SUBTYPE_OF", "PART_OF"]

# fixed values: frame type, slot, entity type, edge type
SLOTS = [
    ("MaterialMeasurement", "material", "Material", "HAS_MATERIAL"),
    ("MaterialMeasurement", "property", "Property", "HAS_PROPERTY"),
    ("MaterialMeasurement", "technique", "Technique", "USES_TECHNIQUE"),
    ("MaterialMeasurement", "condition", "Condition", "UNDER_CONDITION"),
    ("MaterialMeasurement", "equipment", "Equipment", "USES_EQUIPMENT"),
    ("MaterialMeasurement", "location", "Location", "LOCATED_IN"),
    ("SynthesisProcedure", "material", "Material", "PRODUCES"),
    ("SynthesisProcedure", "process", "Process", "VIA_PROCESS"),
    ("SynthesisProcedure", "condition", "Condition", "UNDER_CONDITION"),
    ("SynthesisProcedure", "equipment", "Equipment", "USES_EQUIPMENT"),
    ("SynthesisProcedure", "location", "Location", "LOCATED_IN"),
]

# fixed values: section heading, role, in the order in which they are tried
SECTION_PRIORS = [
    ("abstract", "background"), ("introduction", "background"), ("related work", "background"), ("background", "background"), ("motivation", "background"),
    ("method", "method"), ("methods", "method"), ("methodology", "method"), ("approach", "method"), ("computational details", "method"),
    ("experiments", "result"), ("experimental setup", "result"), ("results", "result"), ("evaluation", "result"),
    ("discussion", "comparison"), ("limitations", "limitation"), ("conclusion", "claim"), ("conclusions", "claim"), ("summary", "claim"), ("future work", "future"),
    ("references", "other"), ("bibliography", "other"), ("acknowledgments", "other"), ("acknowledgements", "other"), ("data availability", "other"),
    ("code and data availability", "other"), ("author contributions", "other"), ("funding", "other"), ("conflict of interest", "other"), ("competing interests", "other"),
    ("supplemental references", "other"), ("supplementary references", "other"),
]

# fixed values: retrieval
RRF_C, LINK_TOPK, LINK_COSINE, VECTOR_TOP, KEEP_SHARE, KEEP_LEAST = 60, 3, 0.55, 30, 0.85, 4
