"""Fixed values of the data model: allow-lists, alias tables, limits.

Everything in this module is a constant that results depend on; no logic.
"""

# --- fixed values: allow-lists -------------------------------------------------
CLASSIFICATIONS = [
    "unprovoked", "provoked", "boat_bite", "scavenge", "aquaria", "sighting",
    "near_miss", "equipment_bite", "unverified_report", "doubtful",
    "no_assignment", "not_confirmed",
]
ATTACK_CLASSES = ["unprovoked", "provoked", "boat_bite", "scavenge", "aquaria"]
SEVERITIES = ["fatal", "severe", "moderate", "minor", "no_injury"]
ACTIVITIES = [
    "swimming", "surfing", "diving", "snorkeling", "fishing", "spearfishing",
    "wading", "kayaking", "paddleboarding",
]
REPORT_SOURCES = ["isaf", "news_media", "social_media", "government", "community"]
REPORT_PLATFORMS = [
    "twitter", "reddit", "instagram", "youtube", "facebook", "tiktok", "tv",
    "print", "radio", "wire_service", "other",
]
VERIFICATION_STATUSES = ["pending", "verified", "rejected", "needs_review"]
JOB_STATUSES = ["queued", "leased", "retrying", "dead_letter", "completed"]
SORT_FIELDS = [
    "incident_date", "case_number", "country", "classification",
    "victim_injury_severity", "fatal", "submitted_at", "updated_at",
]

# --- fixed values: maximum text lengths ---------------------------------------
MAX_LENGTHS = {
    "date_precision": 10, "location_description": 500, "country": 100,
    "state_province": 100, "county_region": 100, "body_of_water": 200,
    "location_precision": 20, "classification_subtype": 20,
    "provocation_subtype": 20, "report_source": 50, "report_platform": 50,
    "shark_species_confirmed": 100, "shark_species_suspected": 100,
    "shark_size_estimate": 100, "species_identification_method": 50,
    "victim_activity": 100, "victim_injury_severity": 20,
    "victim_injury_description": 2000, "victim_sex": 10, "victim_name": 200,
    "description": 10000,
}

# --- fixed values: country aliases (lower case -> canonical) -------------------
COUNTRY_ALIASES = {
    "usa": "United States", "us": "United States", "u.s.": "United States",
    "u.s.a.": "United States", "america": "United States",
    "united states of america": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "great britain": "United Kingdom",
    "england": "United Kingdom", "scotland": "United Kingdom", "wales": "United Kingdom",
    "uae": "United Arab Emirates", "rsa": "South Africa", "nz": "New Zealand",
    "png": "Papua New Guinea",
}

# --- fixed values: species, first listed name wins ----------------------------
SPECIES_BY_COMMON_NAME = {
    "great white": "Carcharodon carcharias",
    "white shark": "Carcharodon carcharias",
    "bull shark": "Carcharhinus leucas",
    "tiger shark": "Galeocerdo cuvier",
    "hammerhead": "Sphyrna mokarran",
    "great hammerhead": "Sphyrna mokarran",
    "scalloped hammerhead": "Sphyrna lewini",
    "mako": "Isurus oxyrinchus",
    "shortfin mako": "Isurus oxyrinchus",
    "blue shark": "Prionace glauca",
    "oceanic whitetip": "Carcharhinus longimanus",
    "blacktip": "Carcharhinus limbatus",
    "blacktip reef": "Carcharhinus melanopterus",
    "whitetip reef": "Triaenodon obesus",
    "nurse shark": "Ginglymostoma cirratum",
    "lemon shark": "Negaprion brevirostris",
    "wobbegong": "Orectolobus maculatus",
    "bronze whaler": "Carcharhinus brachyurus",
    "spinner shark": "Carcharhinus brevipinna",
    "sandbar shark": "Carcharhinus plumbeus",
    "dusky shark": "Carcharhinus obscurus",
    "grey reef": "Carcharhinus amblyrhynchos",
    "caribbean reef": "Carcharhinus perezi",
    "sand tiger": "Carcharias taurus",
    "ragged tooth": "Carcharias taurus",
    "sevengill": "Notorynchus cepedianus",
    "porbeagle": "Lamna nasus",
    "salmon shark": "Lamna ditropis",
    "cookie cutter": "Isistius brasiliensis",
    "cookiecutter": "Isistius brasiliensis",
    "galapagos shark": "Carcharhinus galapagensis",
    "thresher": "Alopias vulpinus",
    "whale shark": "Rhincodon typus",
    "basking shark": "Cetorhinus maximus",
}

# --- fixed values: chart labels of species ------------------------------------
SPECIES_CHART_LABELS = {
    "Carcharodon carcharias": "Great White",
    "Galeocerdo cuvier": "Tiger Shark",
    "Carcharhinus leucas": "Bull Shark",
    "Carcharhinus longimanus": "Oceanic Whitetip",
    "Carcharhinus limbatus": "Blacktip",
    "Carcharhinus brachyurus": "Bronze Whaler",
    "Carcharhinus perezi": "Caribbean Reef",
    "Carcharhinus brevipinna": "Spinner Shark",
    "Carcharhinus amblyrhynchos": "Grey Reef",
    "Isurus oxyrinchus": "Shortfin Mako",
    "Sphyrna mokarran": "Great Hammerhead",
    "Prionace glauca": "Blue Shark",
    "Ginglymostoma cirratum": "Nurse Shark",
    "Negaprion brevirostris": "Lemon Shark",
    "Orectolobus maculatus": "Wobbegong",
}

# --- fixed values: relevance terms --------------------------------------------
SUBJECT_TERMS = ["shark", *SPECIES_BY_COMMON_NAME]
TRUSTED_TERMS = [
    "attack", "bite", "bitten", "encounter", "jaws", "mauled", "sighting",
    "spotted", "beach closure",
]
PAGE_BODY_TERMS = ["shark", "bite", "attack", "sighting", "encounter"]

# --- fixed values: headline match ---------------------------------------------
GENERIC_HEADLINES = ["a full list of", "latest articles", "recent articles"]
HEADLINE_MIN_CHARS = 30
HEADLINE_PREFIX_CHARS = 80
MATCH_RADIUS_M = 150.0

# --- fixed values: places ------------------------------------------------------
PLACE_ALIASES = {
    "calif": "california",
    "norcal": "northern california",
    "socal": "southern california",
    "qld": "queensland",
    "nsw": "new south wales",
    "south australian": "south australia",
    "western australian": "western australia",
}
VAGUE_MODIFIERS = [
    "a", "at", "east", "eastern", "far", "in", "near", "north", "northern", "of",
    "off", "on", "south", "southern", "the", "west", "western",
]
GENERIC_COAST_WORDS = [
    "beach", "coast", "coastline", "island", "ocean", "pier", "shore", "waters",
]
STATE_ALIASES = {
    "nsw": "new south wales", "qld": "queensland", "sa": "south australia",
    "tas": "tasmania", "vic": "victoria", "wa": "western australia",
}
# state -> (lat_min, lat_max, lon_min, lon_max)
STATE_BOUNDS = {
    "florida": (24.5, 31.0, -87.6, -80.0),
    "california": (32.5, 42.0, -124.5, -114.1),
    "hawaii": (18.9, 22.3, -160.3, -154.8),
    "north carolina": (33.8, 36.6, -84.3, -75.5),
    "south carolina": (32.0, 35.2, -83.4, -78.5),
    "texas": (25.8, 36.5, -106.6, -93.5),
    "new york": (40.5, 45.0, -79.8, -71.9),
    "new jersey": (38.9, 41.4, -75.6, -73.9),
    "massachusetts": (41.2, 42.9, -73.5, -69.9),
    "oregon": (41.9, 46.3, -124.6, -116.5),
    "washington": (45.5, 49.0, -124.8, -116.9),
    "queensland": (-29.0, -10.0, 138.0, 154.0),
    "new south wales": (-37.5, -28.0, 141.0, 154.0),
    "western australia": (-35.0, -13.5, 112.0, 129.0),
    "south australia": (-38.1, -26.0, 129.0, 141.0),
    "victoria": (-39.2, -34.0, 141.0, 150.0),
    "kwazulu-natal": (-31.0, -27.0, 29.0, 33.0),
    "eastern cape": (-34.0, -30.5, 24.5, 30.2),
    "western cape": (-35.0, -31.0, 17.5, 21.0),
    "tasmania": (-43.8, -39.5, 143.5, 148.6),
    "georgia": (30.3, 35.1, -85.7, -80.8),
    "maine": (42.9, 47.5, -71.2, -66.8),
    "maryland": (37.8, 39.8, -79.6, -75.0),
    "rhode island": (41.1, 42.1, -71.9, -71.1),
    "virginia": (36.5, 39.5, -83.7, -75.2),
}
INLAND_WATER_TERMS = ["aquarium", "aquaria", "canal", "creek", "lake", "reservoir", "river"]
PLACE_CORRECTIONS = {("newport", "california"): "Newport Beach"}
COAST_SNAP_KM = 25.0
MAX_INLAND_KM = 25.0
GAZETTEER_SNAP_KM = 1.0
MIN_CORRECTION_KM = 1.0
MAX_CORRECTION_KM = 100.0
EARTH_RADIUS_KM = 6371.0

# --- fixed values: register import ----------------------------------------------
REGISTER_CLASSES = {
    "unprovoked": "unprovoked", "provoked": "provoked", "watercraft": "boat_bite",
    "boat": "boat_bite", "sea disaster": "scavenge", "invalid": "doubtful",
    "questionable": "doubtful", "unverified": "not_confirmed",
    "unconfirmed": "not_confirmed", "under investigation": "not_confirmed",
}
# exact name first, else the first listed name contained in the text
REGISTER_ACTIVITIES = {
    "surfing": "surfing", "body surfing": "surfing", "boogie boarding": "surfing",
    "bodyboarding": "surfing", "board surfing": "surfing", "surf skiing": "surfing",
    "swimming": "swimming", "treading water": "swimming", "floating": "swimming",
    "bathing": "swimming", "wading": "wading", "standing": "wading", "walking": "wading",
    "diving": "diving", "scuba diving": "diving", "free diving": "diving",
    "snorkeling": "snorkeling", "snorkelling": "snorkeling", "fishing": "fishing",
    "wade fishing": "fishing", "net fishing": "fishing", "spearfishing": "spearfishing",
    "spear fishing": "spearfishing", "kayaking": "kayaking", "canoeing": "kayaking",
    "paddleboarding": "paddleboarding", "sup": "paddleboarding",
    "stand up paddleboarding": "paddleboarding",
    "stand-up paddleboarding": "paddleboarding",
}
# only the names that differ from plain title case
REGISTER_COUNTRIES = {
    "USA": "United States", "REUNION": "Réunion", "REUNION ISLAND": "Réunion",
    "ENGLAND": "United Kingdom", "SCOTLAND": "United Kingdom", "HONG KONG": "China",
    "TRINIDAD & TOBAGO": "Trinidad and Tobago", "VIRGIN ISLANDS": "US Virgin Islands",
    "TURKS & CAICOS": "Turks and Caicos Islands",
}
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
]
REGISTER_SEVERITY_WORDS = {
    "fatal": ["fatal", "died", "death", "killed"],
    "no_injury": ["no injury", "no injuries", "uninjured", "not injured"],
    "minor": ["minor", "abrasion", "scratch", "laceration", "small"],
    "severe": ["severe", "amputation", "amputated", "lost", "severed"],
}
REGISTER_YEARS = (1900, 2030)
REGISTER_TITLE = "Global Shark Attack File (GSAF)"
REGISTER_PUBLISHER = "Shark Research Institute"
REGISTER_DEFAULT_NOTE = "Imported from GSAF5.xls"

# --- fixed values: platforms ----------------------------------------------------
PLATFORM_REPORT_SOURCE = {
    "youtube": "social_media", "reddit": "social_media", "twitter": "social_media",
    "news_rss": "news_media", "web_scrape": "news_media",
}
PLATFORM_REPORT_PLATFORM = {"youtube": "youtube", "reddit": "reddit", "twitter": "twitter"}
PLATFORM_SOURCE_TYPE = {
    "youtube": "video", "reddit": "social_media", "twitter": "social_media",
    "news_rss": "news_article", "web_scrape": "news_article",
}

# --- fixed values: capture and routing -------------------------------------------
MAX_KEY_CHARS = 512
EXCERPT_CHARS = 12000
SUMMARY_CHARS = 2000
PAGE_BODY_CHARS = 3000
FEED_CAPS = {"news_rss": 15, "youtube": 10, "reddit": 100}
PAGE_TITLE_CHARS = 10
PAGE_URL_CAP = 25
PAGE_ITEM_CAP = 10
MIN_EXTRACTION_CONFIDENCE = 0.4
UNVERIFIED_OK_CONFIDENCE = 0.7
INVALID_CERTAIN_CONFIDENCE = 0.6
DEFAULT_CONFIDENCE = 0.5
CORRECTABLE_TEXT_FIELDS = [
    "incident_date", "location_description", "country", "state_province",
    "body_of_water", "description", "victim_name", "victim_age", "victim_sex",
]
MATCHED_RATIONALE = "Exact normalized date, country, location, and classification"
UNMATCHED_RATIONALE = "Insufficient deterministic fields; manual review required"
LINEAGE_RATIONALE = "Migrated canonical incident lineage"
REVIEWED_SOURCE_NOTE = "Published from reviewed ingestion evidence"

# --- fixed values: job timing ------------------------------------------------------
LEASE_MINUTES = 15
FIRST_RETRY_SECONDS = 300
MAX_RETRY_SECONDS = 21600
MAX_ATTEMPTS = 8

# --- fixed values: merge -------------------------------------------------------------
GENERATED_NEWS_PREFIX = "backfill:"
ENRICH_FIELDS = [
    "incident_time", "state_province", "county_region", "body_of_water",
    "classification_subtype", "provocation_subtype", "shark_species_confirmed",
    "shark_species_suspected", "shark_size_estimate", "species_identification_method",
    "victim_activity", "victim_injury_severity", "victim_injury_description",
    "victim_age", "victim_sex", "victim_name", "description",
]
PUBLIC_FIELDS = [
    "id", "case_number", "incident_date", "date_precision", "location_description",
    "country", "state_province", "county_region", "body_of_water", "longitude",
    "latitude", "location_precision", "classification", "classification_subtype",
    "provocation_subtype", "report_source", "report_platform",
    "shark_species_confirmed", "shark_species_suspected", "shark_size_estimate",
    "species_identification_method", "victim_activity", "victim_injury_severity",
    "victim_sex", "fatal", "verification_status",
]
PUBLIC_SOURCE_FIELDS = [
    "source_type", "source_url", "source_title", "source_publisher", "source_date",
]
BLOCK_WINDOW_DAYS = 3
BLOCK_MAX_SIZE = 10

# fixed values: incident fields that a partial update may set or clear
UPDATABLE_FIELDS = [
    "incident_date", "incident_time", "date_precision", "location_description", "country",
    "state_province", "county_region", "body_of_water", "longitude", "latitude", "location_precision",
    "classification", "classification_subtype", "provocation_subtype", "report_source",
    "report_platform", "shark_species_confirmed", "shark_species_suspected", "shark_size_estimate",
    "species_identification_method", "victim_activity", "victim_injury_severity",
    "victim_injury_description", "victim_age", "victim_sex", "victim_name", "fatal", "description"]
