"""Word lists, patterns and tables whose values are part of the results. Fixed values throughout, in their natural order."""

from __future__ import annotations

# ---- fixed values: transcripts
BOILERPLATE = (
    r"\[operator instructions?\]", r"\bconference call\b", r"\bwebcast\b", r"\breplay\b", r"\bforward-looking statements?\b", r"\bsafe harbor\b",
    r"\binvestor relations\b",
)
HEADER_LINES = (r"^Company:\s*", r"^Ticker:\s*", r"^CIK:\s*", r"^Sector:\s*", r"^Industry:\s*", r"^\[Earnings Call\s*\|.*\]$")
DROPPED_LABELS = ("operator", "executives", "analysts", "analyst", "participants", "presentation")
DROPPED_CONTENT = (
    r"\bforward-looking statements?\b", r"\bsafe harbor\b", r"\brisk factors?\b", r"\bthis call is being recorded\b", r"\boperator instructions?\b",
    r"\brebroadcast\b", r"\bwebcast\b", r"\bpress release\b", r"\binvestor relations\b", r"\btelephone replay\b", r"\bconference call\b",
)
DEPENDENCY_LABELS = (
    ("depends_on", r"\bdepend(?:s|ed|ing)? on\b"), ("relies_on", r"\brel(?:y|ies|ied|ying) on\b"), ("supplied_by", r"\bsupplied by\b"),
    ("supplies", r"\bsuppl(?:y|ies|ied|ying)\b"), ("sources_from", r"\bsource(?:d|s|ing)? from\b"), ("procures_from", r"\bprocure(?:d|s|ing)? from\b"),
    ("buys_from", r"\bbuy(?:s|ing|ought)? from\b"), ("single_source", r"\b(?:single|sole)[ -]?source\b"),
)
DISRUPTION_LABELS = (
    ("supply_constraints", r"\bsupply constraints?\b"), ("shortage", r"\bshortages?\b"), ("delay", r"\bdelay(?:s|ed|ing)?\b"),
    ("shipment_delay", r"\b(?:delayed|late) shipments?\b"), ("disruption", r"\bdisrupt(?:ion|ions|ed|ing)?\b"), ("shutdown", r"\b(?:plant|factory)\s+shutdowns?\b"),
    ("closure", r"\b(?:plant|factory)\s+closures?\b"), ("bottleneck", r"\bbottlenecks?\b"),
)
SUPPLY_CONTEXT = (
    "supplier", "suppliers", "supply chain", "supply", "shipment", "shipments", "shipping", "logistics", "factory", "factories", "plant", "plants",
    "manufacturing", "raw material", "raw materials", "inventory", "procurement", "distribution", "facility", "facilities", "warehouse", "warehousing",
)

# ---- fixed values: filings, teardowns and canonical names
KEYWORD_RELATIONS = (
    ("contract manufacturer", "MANUFACTURES_FOR"), ("contract manufacturing", "MANUFACTURES_FOR"), ("foundry", "MANUFACTURES_FOR"), ("fabricat", "MANUFACTURES_FOR"),
    ("assembly", "MANUFACTURES_FOR"), ("sole source", "SUPPLIES"), ("sole supplier", "SUPPLIES"), ("single source", "SUPPLIES"), ("supplier", "SUPPLIES"),
    ("supply", "SUPPLIES"), ("outsource", "SUPPLIES"), ("procure", "SUPPLIES"), ("source from", "SUPPLIES"), ("purchased from", "SUPPLIES"),
)
FILING_SKIPPED = (
    "company", "companies", "government", "authority", "authorities", "exchange", "act", "agreement", "amendment", "section", "assembly", "the company",
    "our company", "such company", "board of directors", "board of", "committee", "commission", "department", "division", "subsidiary", "affiliates",
    "partners", "associates",
)
FILING_LEGAL = r"(amended|restated|limited liability|corporation agreement|table of contents|exhibit|form \d|item \d|schedule)"
COMPONENT_SKIPPED = (
    "haptic touch", "3d touch", "android", "ios", "ic identification", "face id", "touch id", "true tone", "liquid retina", "super retina", "usb-c",
    "lightning", "wi-fi", "bluetooth", "nfc", "lte", "5g", "display", "battery", "camera", "sensor", "board", "module", "lcd", "nano-sim", "sim card",
    "iphones", "iphone", "macbook", "macbooks", "pentalobe", "phillips", "torx", "screwdriver", "ifixit", "wikipedia", "youtube", "amazon",
)
MANUFACTURERS = (
    "TSMC", "Samsung", "Qualcomm", "Broadcom", "Micron", "SK Hynix", "Kioxia", "Texas Instruments", "Murata", "Bosch", "STMicroelectronics", "NXP", "Infineon",
)
LEGAL_SUFFIXES = (
    r"inc\.?", r"corp\.?", r"co\.?", r"ltd\.?", r"llc\.?", r"l\.p\.?", r"plc\.?", r"n\.v\.?", r"ag\.?", r"gmbh\.?", r"s\.a\.?", r"holdings?", "group",
    "limited", "incorporated", "corporation", "company",
)

# ---- fixed values: questions
ASKED_COMPANIES = (
    "tsmc", "taiwan semiconductor", "apple", "amd", "nvidia", "intel", "qualcomm", "samsung", "broadcom", "asml", "foxconn", "sk hynix", "micron",
    "texas instruments", "murata", "kyocera", "tdk",
)
ASKED_COUNTRIES = (
    "china", "taiwan", "south korea", "korea", "japan", "malaysia", "thailand", "vietnam", "singapore", "united states", "usa", "us", "germany",
    "netherlands",
)
ASKED_MINERALS = ("gallium", "germanium", "cobalt", "lithium", "rare earths", "rare earth", "nickel", "copper", "palladium", "platinum", "indium")
ASKED_PRODUCTS = (
    "iphone", "macbook", "ipad", "gpu", "cpu", "semiconductor", "chip", "wafer", "battery", "solar panel", "playstation", "xbox", "galaxy", "pixel",
    "switch", "macpro", "imac",
)
ASKED_DISRUPTION = (
    r"\b(stops?|halt(?:s|ed)?|shut(?:s|ting|down)?|bans?|sanctions?|conflict|war|earthquake|flood|strikes?|export control|restricts?|disruption|"
    r"disrupt(?:s|ed|ing)?|shortage|crisis|collapse|cut(?:s|ting)?|invade[sd]?|invasion|block(?:s|ed)?|attack(?:s|ed)?|sanction(?:s|ed)?)\b"
)
QUESTION_WORDS = (
    "what", "which", "where", "when", "who", "why", "how", "if", "is", "are", "the", "a", "an", "and", "or", "of", "for", "in", "on", "at", "to", "by",
    "has", "have", "supply", "supplies", "supplier", "suppliers", "companies", "company", "components", "component", "disrupted", "disruption",
)

# ---- fixed values: relation phrases of a sentence, the first best wins
RELATION_PHRASES = (
    (r"suppl(?:ies|y|ied|ier)", "supplies"), (r"source[sd]? from", "supplies"), (r"depend[s]? on", "depends_on"), (r"require[sd]?", "depends_on"),
    (r"ships? through", "ships_through"), (r"routes? through", "ships_through"), (r"located in", "located_in"), (r"based in", "located_in"),
    (r"headquartered in", "located_in"), (r"affect(?:ed|s)? by", "affected_by"), (r"impacted by", "affected_by"), (r"alternative(?:ly)?", "alternative_to"),
    (r"sell[s]? to", "sells_to"), (r"deliver[s]? to", "sells_to"),
)
