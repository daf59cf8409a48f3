"""Fixed values that results depend on."""

# Regions in anatomical order; every table lists them in this order.
REGION_NAMES = ("dNCM", "vNCM", "CMM")

# Status words, in the order a section passes through them.
NEEDS_REGIONS = "needs regions"
NEEDS_DORSAL = "needs dorsal marker"
READY_TO_COUNT = "ready to count"
COUNTED = "counted"

# Reasons a section is left out of a batch.
NO_REGIONS = "no outlines drawn"
NO_DORSAL = "no dorsal marker, so NCM cannot be split"
ALREADY_RUNNING = "already being counted right now"
ALREADY_QUEUED = "already waiting in the queue"
COUNTING_OUTSIDE = "already being counted by a job started outside this window"
GONE = "no longer in this folder"
COUNTED_SINCE = "it has been counted since"
COUNTING_NOW = "it is being counted right now"

STALE_MARK = "STALE -- recount"

# Folders never scanned, and the suffixes of image files in lower case.
SKIP_FOLDERS = (".venv", "__pycache__", "runs", "wandb", "node_modules", "archive", "lambda archive", "old")
IMAGE_SUFFIXES = ("tif", "tiff")

# Sidecar kinds by the text that follows the stem.
SIDECAR_SUFFIXES = {
    "regions": " regions.csv",
    "areas": " region areas.csv",
    "counts": " counted cells.csv",
    "edits": " cell edits.csv",
    "cutoff": " cutoff.csv",
    "dorsal": " dorsal.csv",
    "field_l_ends": " field l ends.csv",
    "centers": " cell centers.csv",
}

MINUTES_EACH = 40
MATCH_RADIUS = 15
CANVAS = 480
CANVAS_UM = 8.0
REFERENCE_PIXEL_SIZE_UM = 0.3088427408547889
CANDIDATES_PER_MEGAPIXEL = 350
HAND_PROBABILITY = 1.0
MAX_WEIGHT_SWING_DEG = 45.0
ALONG_BIN_UM = 16.0
ACROSS_BIN_UM = 8.0
NEGATIVES_PER_POSITIVE = 20
HARD_NEGATIVE_FRACTION = 0.5
HARD_NEGATIVE_POOL_FACTOR = 2
